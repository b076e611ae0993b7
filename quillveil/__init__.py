"""Spark-native pseudonymization of mails and texts."""

from quillveil.config import Settings, get_workflow_settings
from quillveil.operators.review import highlight
from quillveil.plans.pipeline import pseudonymize
from quillveil.sinks.files import write_output
from quillveil.sources.tabular import get_input

__all__ = ["Settings", "get_input", "get_workflow_settings", "highlight", "pseudonymize", "write_output"]

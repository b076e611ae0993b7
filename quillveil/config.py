"""Settings of the pseudonymization pipeline: defaults, validation, overlay, load and save (driver side)."""

from __future__ import annotations

import json
import os
import socket
import warnings
from copy import deepcopy
from dataclasses import dataclass, field, fields, replace
from datetime import datetime
from typing import Any

# The default pool of pseudonyms by language, in order.
DEFAULT_FIRST_NAMES = {
    "es": ["Marta", "Alejandro", "Isabel", "Sergio", "Raquel", "Carlos", "Dayana", "Ferran", "Elena", "José"],
    "fr": ["Julien", "Manon", "Stéphane", "Nathalie", "Georges", "Denise", "Idriss", "Aïcha", "Hugo", "Léa"],
    "de": ["Mika"],
}


@dataclass(frozen=True)
class Settings:
    """One immutable set of options; each field is documented by its validator in `_CHECKS`."""

    default_lang: str = "fr"
    pseudo_fields: tuple[str, ...] = ("subject", "content")
    pseudo_emailaddresses: bool = True
    pseudo_ne: bool = True
    pseudo_numbers: bool = True
    datetime_detection: bool = True
    time_parsing: str = "strict"
    pseudo_first_names: dict[str, list[str]] = field(default_factory=lambda: deepcopy(DEFAULT_FIRST_NAMES))
    lang_detection_lib: str = "langid"
    lang_pipeline: dict | None = None
    spacy_model: str = "default"
    ner_pipeline: dict | None = None
    csv_col_unmatched_keyword: str = "unmatched"

    def as_dict(self) -> dict[str, Any]:
        return {f.name: list(v) if isinstance(v := getattr(self, f.name), tuple) else deepcopy(v) for f in fields(self)}


def _text(v: Any) -> bool:
    return isinstance(v, str)


def _flag(v: Any) -> bool:
    return isinstance(v, bool)


def _pipeline(v: Any) -> bool:
    return v is None or (isinstance(v, dict) and {"task", "model"} <= v.keys() and all(_text(v[k]) for k in v.keys() & {"task", "model", "revision", "aggregation_strategy"}))


_CHECKS = {
    "default_lang": _text,
    "pseudo_fields": lambda v: isinstance(v, list | tuple) and all(map(_text, v)),
    "pseudo_emailaddresses": _flag,
    "pseudo_ne": _flag,
    "pseudo_numbers": _flag,
    "datetime_detection": _flag,
    "time_parsing": lambda v: v in ("strict", "non-strict"),
    "pseudo_first_names": lambda v: isinstance(v, dict) and len(v) > 0,
    "lang_detection_lib": lambda v: v in ("langid", "langdetect", "trans"),
    "lang_pipeline": _pipeline,
    "spacy_model": _text,
    "ner_pipeline": _pipeline,
    "csv_col_unmatched_keyword": _text,
}


def is_valid_settings(settings: Any) -> bool:
    """Whether every key is known and its value of the right kind; no key is required."""
    return isinstance(settings, dict) and all(k in _CHECKS and _CHECKS[k](v) for k, v in settings.items())


def from_dict(settings: dict[str, Any]) -> Settings:
    """Settings from a valid dict; missing keys keep their defaults."""
    if not is_valid_settings(settings):
        raise ValueError("invalid settings")
    return replace(Settings(), **{k: tuple(v) if k == "pseudo_fields" else deepcopy(v) for k, v in settings.items()})


def update_settings(base: Settings | None, new: dict[str, Any]) -> tuple[Settings, bool]:
    """Overlay: unknown or invalid entries are skipped with a warning. Returns whether anything changed."""
    if base is None:
        raise ValueError("there are no settings to update")
    now = base.as_dict()
    changed = {}
    for key, value in new.items():
        if key not in _CHECKS:
            warnings.warn(f"unknown setting {key} is skipped", stacklevel=2)
        elif not _CHECKS[key](value):
            warnings.warn(f"invalid value for the setting {key} is skipped", stacklevel=2)
        elif now[key] != value:
            changed[key] = tuple(value) if key == "pseudo_fields" else deepcopy(value)
    return (replace(base, **changed), True) if changed else (base, False)


def save_settings(settings: Settings, directory: str) -> str:
    """Write the settings under a name with the time and the host; the directory is made if it is missing."""
    if os.path.isfile(directory):
        raise ValueError(f"{directory} is a file, not a directory")
    os.makedirs(directory, exist_ok=True)
    now = datetime.now()
    name = f"updated_workflow_settings_{now:%Y%m%d_%H%M%S}.{now.microsecond // 1000:03d}_{socket.gethostname()}.json"
    path = os.path.join(directory, name)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings.as_dict(), f, ensure_ascii=False, indent=2)
    return path


def get_workflow_settings(path: str = "default", new_settings: dict[str, Any] | None = None, updated_setting_dir: str | None = None, save_updated_settings: bool = True) -> Settings:
    """Defaults or the file's settings, overlaid by ``new_settings``. What can't be read or is invalid gives the defaults, with a warning."""
    settings = Settings()
    if path != "default":
        try:
            with open(path, encoding="utf-8") as f:
                settings = from_dict(json.load(f))
        except (OSError, ValueError) as e:
            warnings.warn(f"settings from {path} can't be used ({e}); the defaults are", stacklevel=2)
    changed = False
    if new_settings:
        settings, changed = update_settings(settings, new_settings)
    if changed and save_updated_settings:
        save_settings(settings, updated_setting_dir or os.getcwd())
    return settings

"""The stateless part of the pipeline over a stream, and exactly-once writing of its micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillveil.plans.pipeline import mask_only


def masked_stream(stream: DataFrame, field: str, out: str = "masked") -> DataFrame:
    """A stream with the field masked; it keeps no state."""
    return stream.withColumn(out, mask_only(field))


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all rows that are there now; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)

"""CSV as a table of strings with mapped columns, and the choice of a source by its kind."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillveil.sources.mail import complete_fields, read_mail_dir

FIELDS = ["content", "date", "attachment", "attachment_type", "subject"]


def map_columns(df: DataFrame, col_names: Sequence[str], fields: Sequence[str], unmatched: str = "unmatched") -> DataFrame:
    """Columns by position: the first names give the fields; one that is missing gives the stand-in. Further names keep
    their own and are left out if missing; further fields are null. All other columns are dropped."""
    if not col_names:
        raise ValueError("column names are needed")
    n = min(len(col_names), len(fields))
    out = [(F.col(f"`{c}`") if c in df.columns else F.lit(unmatched)).alias(f) for c, f in zip(col_names[:n], fields[:n], strict=True)]
    out += [F.col(f"`{c}`") for c in col_names[n:] if c in df.columns and c not in fields]
    out += [F.lit(None).cast("string").alias(f) for f in fields[n:]]
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, col_names: Sequence[str], fields: Sequence[str] = tuple(FIELDS), unmatched: str = "unmatched") -> DataFrame:
    """A CSV file, all columns as strings (nothing is guessed), mapped by `map_columns`. Quoted values may hold line breaks."""
    if not col_names:
        raise ValueError("column names are needed")
    local = path.removeprefix("file://")
    if "://" not in local:
        if not os.path.exists(local):
            raise OSError(f"the file {path} doesn't exist")
        if os.path.isfile(local) and os.path.getsize(local) == 0:
            return spark.createDataFrame([], ", ".join(f"`{f}` string" for f in fields))
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return map_columns(raw, col_names, fields, unmatched)


def get_input(spark: SparkSession, path: str, kind: str = "dir", col_names: Sequence[str] = ("message",), init_data_fields: Sequence[str] = tuple(FIELDS), unmatched: str = "unmatched", suffixes: Sequence[str] = (".eml", ".html")) -> DataFrame:
    """``csv``: a CSV file, ``parquet``: a table, anything else: a directory of mails."""
    if kind == "csv":
        return read_csv(spark, path, col_names, init_data_fields, unmatched)
    if kind == "parquet":
        return complete_fields(spark.read.parquet(path), init_data_fields)
    return read_mail_dir(spark, path, suffixes, init_data_fields)


def records(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time."""
    return df.toLocalIterator()

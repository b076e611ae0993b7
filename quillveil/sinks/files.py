"""Results as CSV, XML, Parquet and text files. Writing stays distributed unless a single file is asked for."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def list_repr(values: Column) -> Column:
    """A list of strings as ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", "), F.lit("]"))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as text: simple lists of strings by `list_repr`, all else as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = list_repr(c)
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; an empty table is an error."""
    if df.limit(1).count() == 0:
        raise ValueError("there is nothing to write")
    flat(df).write.mode(mode).csv(path, header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


_KINDS = {"string": "str", "int": "int", "bigint": "int", "double": "float", "float": "float", "boolean": "bool", "timestamp": "str", "date": "str"}


def _typed(c: Column, kind: T.DataType) -> Column:
    """A value with its kind as an attribute, nested as the data are; a map has an element ``key`` with its name for each entry."""
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: _typed(x, kind.elementType))
        return F.struct(F.lit("list").alias("_type"), items.alias("item"))
    if isinstance(kind, T.StructType):
        return F.struct(F.lit("dict").alias("_type"), *[_typed(c[f.name], f.dataType).alias(f.name.replace(" ", "_")) for f in kind.fields])
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("_name"), _typed(e["value"], kind.valueType).alias("value")))
        return F.struct(F.lit("dict").alias("_type"), entries.alias("key"))
    return F.struct(F.lit(_KINDS.get(kind.simpleString(), "str")).alias("_type"), c.cast("string").alias("_VALUE"))


def to_xml_rows(df: DataFrame) -> DataFrame:
    """Columns with their kinds as attributes, spaces in names as underscores."""
    return df.select(F.lit("dict").alias("_type"), *[_typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name.replace(" ", "_")) for f in df.schema.fields])


def write_xml(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """XML with the root ``email_list`` and an element ``email`` for each row."""
    to_xml_rows(df).write.mode(mode).format("xml").option("rootTag", "email_list").option("rowTag", "email").option("declaration", 'version="1.0" encoding="UTF-8"').save(path)


def write_text(text: str, path: str) -> None:
    """A short text as one UTF-8 file; an empty one is an error."""
    if not text:
        raise ValueError("there is nothing to write")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def write_output(df: DataFrame, path: str, overwrite: bool = False, single_file: bool = False) -> None:
    """By the suffix: csv, xml or parquet. Checked in this order: an empty path, a non-empty file in the way, the suffix.

    ``single_file`` gathers the parts into one local file of that name; for results that one machine can hold.
    """
    if not path:
        raise ValueError("a path is needed")
    local = path.removeprefix("file://")
    if not overwrite and os.path.exists(local) and (os.path.isdir(local) and os.listdir(local) or os.path.isfile(local) and os.path.getsize(local)):
        raise ValueError(f"{path} exists already")
    suffix = os.path.splitext(local)[1].lower()
    if suffix not in (".csv", ".xml", ".parquet"):
        raise ValueError("the suffix must be .csv, .xml or .parquet")
    target = local + ".parts" if single_file else path
    mode = "overwrite" if overwrite or single_file else "errorifexists"
    if not single_file and os.path.isfile(local):
        os.remove(local)
    rows = df.coalesce(1) if single_file else df
    if suffix == ".csv":
        write_csv(rows, target, mode)
    elif suffix == ".xml":
        write_xml(rows, target, mode)
    else:
        rows.write.mode(mode).parquet(target)
    if single_file:
        part = next(p for p in sorted(os.listdir(target)) if p.startswith("part-"))
        shutil.move(os.path.join(target, part), local)
        shutil.rmtree(target)

"""Mail and page files as a table: a distributed binary scan, decoded with the standard library in Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from email import message_from_bytes, policy
from glob import glob
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_name string, content string, date timestamp, attachment int, attachment_type array<string>, subject string"


class _Text(HTMLParser):
    """Text nodes of a page, without scripts and styles; entities are decoded."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.tags = self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:  # noqa: ARG002
        self.tags += 1
        self.silent += tag in ("script", "style")

    def handle_startendtag(self, tag: str, attrs: list) -> None:  # noqa: ARG002
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.silent = max(0, self.silent - (tag in ("script", "style")))

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def html_text(text: str | None) -> str | None:
    """Text of a string with at least one tag; other strings and null as they are."""
    if not text or "<" not in text:
        return text
    page = _Text()
    page.feed(text)
    page.close()
    return "".join(page.parts) if page.tags else text


def decode_mail(data: bytes) -> tuple[str, object, int, list[str], str | None]:
    """Content, date, number of attachments, their extensions, subject. An empty first body gives way to the second."""
    message = message_from_bytes(data, policy=policy.default)
    bodies, extensions, attached = [], [], 0
    for part in message.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if part.get_content_disposition() == "attachment" or name:
            attached += 1
            if name and "." in name:
                extensions.append(name.rsplit(".", 1)[1].lower())
        elif part.get_content_maintype() == "text":
            try:
                bodies.append(part.get_content())
            except (LookupError, UnicodeDecodeError):
                bodies.append((part.get_payload(decode=True) or b"").decode("utf-8", "replace"))
    content = next((b for b in bodies[:2] if b.strip()), bodies[0] if bodies else "")
    try:
        sent = message["date"].datetime if message["date"] is not None else None
    except (AttributeError, TypeError, ValueError):
        sent = None
    subject = message["subject"]
    return html_text(content) or "", sent, attached, extensions, None if subject is None else str(subject)


def _decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for path, data in zip(pdf["path"], pdf["content"], strict=True):
            content, sent, n, kinds, subject = decode_mail(bytes(data))
            stamp = pd.Timestamp(sent) if sent is not None else pd.NaT
            if stamp is not pd.NaT:
                stamp = stamp.tz_convert("UTC") if stamp.tzinfo else stamp.tz_localize("UTC")
            rows.append((os.path.basename(path), content, stamp, n, kinds, subject))
        out = pd.DataFrame(rows, columns=["file_name", "content", "date", "attachment", "attachment_type", "subject"])
        out["date"] = pd.to_datetime(out["date"], utc=True)
        yield out


def list_files(path: str, suffixes: Sequence[str] = (".eml", ".html")) -> list[str]:
    """Local files below a directory by suffix, sorted. A missing directory is an OSError, no match a ValueError."""
    if not os.path.isdir(path):
        raise OSError(f"the directory {path} doesn't exist")
    found = sorted(p for s in suffixes for p in glob(os.path.join(path, "**", f"*{s}"), recursive=True))
    if not found:
        raise ValueError(f"{path} holds no file with one of {list(suffixes)}")
    return found


def read_mail_dir(spark: SparkSession, path: str, suffixes: Sequence[str] = (".eml", ".html"), init_data_fields: Sequence[str] = ()) -> DataFrame:
    """Records of all mail and page files below a directory; missing fields are added as null."""
    local = path.removeprefix("file://")
    if "://" not in local:
        list_files(local, suffixes)
    pattern = "*{" + ",".join(s.lstrip("*") for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")
    records = files.mapInPandas(_decode, SCHEMA)
    return complete_fields(records, init_data_fields)


def complete_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Add the fields that a table lacks, as null strings."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns}) if names else df

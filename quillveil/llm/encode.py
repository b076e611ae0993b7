"""Encode whole corpora with a public byte-level tokenizer by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged across, so the text may be cut between
its two bytes, the fragments encoded independently, and their ids concatenated: the result is that of the whole text.
Most cuts fall between words, so a corpus has few distinct fragments, and each worker encodes each of them about once.

The split into pieces that precedes the merges looks at its neighbours in two places only, after white space and at
an apostrophe; a cut is therefore made only after an ASCII letter or digit, or after another character that is neither
ASCII nor white space, and in the latter case not before an apostrophe. `ForcedBoundaryEncoder` holds the argument.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; blank texts,
unpaired marks and texts of any length are encoded whole. The stage is a map without shuffle; extra columns pass by.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillveil.llm.batches import uncollected

#: Folder of the vocabulary files; a parameter of every function here.
TOKENIZER_DIR = "/opt/tokenizers"
#: Split of a text into pieces before the merges, as the rank files are published with.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct fragments that a worker keeps; beyond that it starts afresh, which costs time but changes nothing.
CACHE_FRAGMENTS = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks, from the bytes of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class ForcedBoundaryEncoder:
    """Encoder of one vocabulary.

    Why fragments can stand alone: let the cut lie between characters x and y whose adjoining bytes are in no token.
    If y is white space, the piece of x ends at the cut anyway, as only leading spaces belong to pieces. If both are of
    one class (letter, number, other), the cut lies inside a piece, whose two sides never merge, and each side is again
    one piece of that class. If they are of different classes, a piece ends at the cut. The alternatives for
    contractions change this only where an apostrophe follows an "other" character, which is never cut.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        never = np.ones((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                pairs = np.frombuffer(token, np.uint8)
                never[pairs[:-1], pairs[1:]] = False
        left = np.zeros(256, bool)
        left[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
        left[0x80:] = True
        never[~left] = False
        never[:, 0x80:0xC0] = False  # inside a character
        never[0x80:, ord("'")] = False
        self.cuttable = never.reshape(-1)
        self.known: dict[bytes, list[int]] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in UTF-8 bytes before which the text may be cut."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        found = np.flatnonzero(self.cuttable[(data[:-1].astype(np.uint16) << 8) | data[1:]])
        wide = found[data[found] >= 0x80]
        if len(wide):  # white space beyond ASCII
            c, b, a = data[wide], data[np.maximum(wide - 1, 0)], data[np.maximum(wide - 2, 0)]
            space = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
            space |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
            space |= ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
            found = np.setdiff1d(found, wide[space], assume_unique=True)
        return found + 1

    def fragment(self, piece: bytes) -> list[int]:
        ids = self.known.get(piece)
        if ids is None:
            ids = self.encoding.encode_ordinary(piece.decode("utf-8"))
            if len(self.known) >= CACHE_FRAGMENTS:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = ids
        return ids

    def encode_batch(self, texts: pa.Array) -> tuple[list[int], np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text in them."""
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        if len(texts) == 0 or buffer is None:
            return [], np.zeros(len(texts) + 1, np.int32)
        start = int(bounds[0])
        raw = memoryview(buffer)[start : int(bounds[-1])].tobytes()
        bounds = bounds - start
        points = np.union1d(self.cuts(np.frombuffer(raw, np.uint8)), bounds).tolist()
        flat: list[int] = []
        extend, known, miss = flat.extend, self.known, self.fragment
        ends: dict[int, int] = dict.fromkeys(bounds.tolist(), 0)
        a = points[0]
        for b in points[1:]:
            piece = raw[a:b]
            extend(known.get(piece) or miss(piece))
            if b in ends:
                ends[b] = len(flat)
            a = b
        return flat, np.array([ends[b] for b in bounds.tolist()], np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch(pa.array([text or ""]))[0]


class _Worker:
    """The encoder of this Python worker; built once, from the broadcast rank file."""

    made: dict[str, ForcedBoundaryEncoder] = {}

    @classmethod
    def of(cls, path: str, ranks) -> ForcedBoundaryEncoder:  # noqa: ANN001
        if path not in cls.made:
            cls.made = {path: ForcedBoundaryEncoder(read_ranks(ranks.value))}
        return cls.made[path]


def _rank_file(spark: SparkSession, path: str):  # noqa: ANN202
    """The rank file's bytes as a broadcast; vocabulary files have a fixed size, under 1 MB here."""
    if not os.path.exists(path):
        raise ValueError(f"no rank file of a byte-level tokenizer at {path}")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, lengths_only: bool = False) -> DataFrame:
    """Add the column ``out``: the ids of ``text`` as array<int>, or with ``lengths_only`` their number.

    A column that is already called ``out`` is replaced. All other columns are kept as they are.
    """
    spark = df.sparkSession
    path = os.path.join(tokenizer_dir, f"{tokenizer}.tiktoken")
    ranks = _rank_file(spark, path)
    if out in df.columns and out != text:
        df = df.drop(out)
    keep = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, T.IntegerType() if lengths_only else T.ArrayType(T.IntegerType()))])

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Worker.of(path, ranks)
        for batch in batches:
            texts = batch.column(text)
            flat, ends = encoder.encode_batch(texts.fill_null("") if texts.null_count else texts)
            made = pa.array(np.diff(ends), pa.int32()) if lengths_only else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), made], names=[*(f.name for f in keep), out])

    return df.mapInArrow(run, schema)

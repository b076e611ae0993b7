"""Reduce e-mails to the text newly written by their sender.

Lines are labelled by the sequence model of `anatomy`; new text is what it calls greeting, text, list item, closing or
name under a closing. The model is fitted on the driver on a bounded sample of messages and sent to the workers (under
2 MB); labelling is a map without shuffle.

Defined results: null, empty and blank messages have no lines and an empty new text (null for null). LF and CRLF both
end a line; numbers count LFs. A message that is quotation only has an empty new text. Very long messages are labelled
whole. Repeated row ids keep a row each. With no message to train from, every line counts as new text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillveil.llm.anatomy import LABELS, NEW, TRAIN_MESSAGES, LineModel, line_view, sample_messages, train_line_model
from quillveil.llm.batches import uncollected

#: Messages that a worker decodes together.
CHUNK = 1500
#: Labels of lines that are not the sender's new text.
OTHER = frozenset(LABELS) - NEW


def fitted(samples: DataFrame, train_messages: int = TRAIN_MESSAGES) -> LineModel:
    return fitted_on(sample_messages(samples, train_messages))


def fitted_on(messages: list[str]) -> LineModel:
    """The line model of some messages; without any it has no weights."""
    if not messages:
        k = len(LABELS)
        return LineModel({}, np.zeros((2, k)), np.zeros((k, k)), np.zeros(k), frozenset())
    return train_line_model(messages)


def labelled(messages: list[str], model: LineModel, pinned: bool = False) -> Iterator[tuple[list[tuple[int, int, list[int]]], str, list[int]]]:
    """Logical lines, a letter for each ('-' for blank ones) and their flags, for each message in order.

    With ``pinned``, lines whose sign admits one reading keep it whatever the model says.
    """
    for at in range(0, len(messages), CHUNK):
        views = [line_view(m) for m in messages[at : at + CHUNK]]
        letters, flags = model.label_many([t for _, t in views], pinned)
        for (lines, _), row, f in zip(views, letters, flags, strict=True):
            yield lines, row, f


def other_lines(samples: DataFrame, model: LineModel) -> DataFrame:
    """``row_id, line_no`` of each non-blank physical line that isn't the sender's new text."""
    shared = samples.sparkSession.sparkContext.broadcast(model)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = [], []
            rows = batch.column("row_id").to_pylist()
            for row, (lines, letters, _) in zip(rows, labelled([m or "" for m in batch.column("message").to_pylist()], shared.value), strict=True):
                found = [k for (_, _, physical), c in zip(lines, letters, strict=True) if c in OTHER for k in physical]
                ids += [row] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64())], names=["row_id", "line_no"])

    return samples.select("row_id", "message").mapInArrow(run, "row_id bigint, line_no bigint")


def new_texts(samples: DataFrame, model: LineModel) -> DataFrame:
    """``row_id, new_text``: the message without the lines of `other_lines` and without blank lines at its ends."""
    shared = samples.sparkSession.sparkContext.broadcast(model)

    @uncollected
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            messages, texts = batch.column("message").to_pylist(), []
            for message, (lines, letters, _) in zip(messages, labelled([m or "" for m in messages], shared.value), strict=True):
                gone = {k for (_, _, physical), c in zip(lines, letters, strict=True) if c in OTHER for k in physical}
                kept = [x.rstrip("\r") for k, x in enumerate((message or "").split("\n")) if k not in gone]
                texts.append(None if message is None else "\n".join(kept).strip("\n"))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(texts, pa.string())], names=["row_id", "new_text"])

    return samples.select("row_id", "message").mapInArrow(run, "row_id bigint, new_text string")


def p6_found(samples: DataFrame) -> DataFrame:
    return other_lines(samples, fitted(samples))


def p6_new_text(samples: DataFrame) -> DataFrame:
    return new_texts(samples, fitted(samples))

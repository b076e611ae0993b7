"""Helpers for work on Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def uncollected(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The map without cyclic garbage collection while it runs.

    The lists and tuples of a batch hold no cycles, so they are freed by their reference counts; the collector would walk
    through all of them again and again.
    """

    def paused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()

    return paused

"""Written intermediate tables and code shipping, as the rest of the library has them, and workers that give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shipping import ship
from ..sources.snapshots import Scratch

__all__ = ["Scratch", "freeing", "packed", "ship", "unpacked"]


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with all columns but ``names`` in one, ``_rest``, so that none has the name of a column that an operator adds."""
    rest = [c for c in docs.columns if c not in names]
    return docs.select(*(c for c in docs.columns if c in names), *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")] if rest else []))


def unpacked(rows: DataFrame, columns: list[str], names: tuple[str, ...], *more: Column) -> DataFrame:
    """The original ``columns`` of rows :func:`packed` but for ``names``, in their order, and ``more``."""
    return rows.select(*(F.col(c) if c in names else F.col("_rest").getField(c).alias(c) for c in columns), *more)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after whose partition the worker gives unused memory back: workers stay, and wait beside later stages."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return go

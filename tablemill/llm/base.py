"""Small helpers that all corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablemill.functions.numbers import quoted
from tablemill.session import shared_root

#: Texts that Python works on at once, in bytes; a longer text is worked on alone.
GROUP_BYTES = 1 << 19
#: Rows go to Python in batches of at most so many bytes, however long their texts are.
BATCH_BYTES = 2 << 20
#: Words as the contracts of the quality rules count them.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), use).getItem(0)


def attach(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; an input column of the same name (in any case) is replaced."""
    taken = {c.lower() for c in columns}
    kept = [quoted(c) for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in columns.items()])


def slim(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names; all others, whatever they are called, are left out."""
    return df.select(*[quoted(c).alias(n) for n, c in columns.items()])


def prepared(spark: SparkSession) -> SparkSession:
    """Names the folder for checkpoints where the cluster did not, and bounds what Python gets at once by bytes."""
    shared_root(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def release() -> None:
    """Give memory that a Python worker has used, but needs no more, back to the machine.

    Workers live on between stages, several to an executor, and otherwise each keeps its highest mark.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def text_groups(batches: Iterable[pd.DataFrame], column: str = "text",
                limit: int = GROUP_BYTES) -> Iterator[pd.DataFrame]:
    """Consecutive rows of at most ``limit`` characters together, or one longer row."""
    for pdf in batches:
        if not len(pdf):
            continue
        ends = pdf[column].str.len().fillna(0).add(1).cumsum().to_numpy()
        start, base = 0, 0
        while start < len(pdf):
            stop = max(int(ends.searchsorted(base + limit, "right")), start + 1)
            yield pdf.iloc[start:stop]
            start, base = stop, ends[stop - 1]
        del pdf, ends
        release()

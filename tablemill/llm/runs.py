"""Runs of rows with equal keys in sorted batches, each handed on whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablemill.llm.base import release


def starts_of(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Positions where a run of equal keys begins, and the length at the end."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(pdf))


def whole_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows again, cut so that no run is split between two frames. Runs are bounded by their maker."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pd.concat([*rest, pdf], ignore_index=True) if rest else pdf
        last = starts_of(pdf, keys)[-2]
        if last:
            yield pdf.iloc[:last].reset_index(drop=True)
        rest = [pdf.iloc[last:]]
    if rest:
        yield rest[0].reset_index(drop=True)


def map_runs(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
             schema: str, order: list[str] | None = None) -> DataFrame:
    """``work(rows, starts)`` over frames of whole runs: rows of a run meet in one task, many runs per call."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_runs(batches, keys):
            yield work(pdf, starts_of(pdf, keys))
        release()

    dealt = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *(order or []))
    return dealt.mapInPandas(each, schema)


class Forest:
    """Union of row numbers; the root of a set is its smallest number."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)

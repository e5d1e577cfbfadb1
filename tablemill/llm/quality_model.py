"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal steps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.llm.base import attach, prepared, slim, text_groups
from tablemill.llm.words import BASE, hashed_words, mix
from tablemill.session import checkpointed, materialised


@dataclass(frozen=True)
class Settings:
    """``max_rows``: bound of the labelled rows that are learned from; a fixed share by hash beyond it.
    ``parts``: learners that run side by side and are averaged after each of the ``epochs``."""

    bits: int = 18
    max_rows: int = 40_000
    parts: int = 8
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0005
    l2: float = 0.001
    threshold: float = 0.7


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray = field(repr=False)


def features(texts, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, row) of the features of each text, sorted by row, values of length 1 per row.

    Words are runs of letters and digits or runs of symbols. Single words, pairs of neighbours, and pairs that
    stand twice in the text are hashed; a constant stands at index 0. Counts enter by their square root.
    """
    hashes, counts = hashed_words(texts, lower=False, shapes=True)
    rows = len(counts)
    owner = np.repeat(np.arange(rows), counts)
    pairs = mix(hashes[:-1] * np.uint64(BASE) + hashes[1:])
    inside = owner[:-1] == owner[1:]
    index = np.concatenate([hashes, pairs[inside]]) >> np.uint64(64 - bits)
    who = np.concatenate([owner, owner[:-1][inside]])
    key = who.astype(np.int64) << bits | np.maximum(index.astype(np.int64), 2)
    key, times = np.unique(key, return_counts=True)
    value = np.sqrt(times)
    row = key >> bits
    norm = np.sqrt(np.bincount(row, times, rows))
    share = np.bincount(row, times > 1, rows) / np.maximum(np.bincount(row, minlength=rows), 1)
    key = np.concatenate([key & ((1 << bits) - 1), np.zeros(rows, np.int64), np.ones(rows, np.int64)])
    value = np.concatenate([value / norm[row], np.ones(rows), share])
    row = np.concatenate([row, np.arange(rows), np.arange(rows)])
    order = np.argsort(row, kind="stable")
    return key[order], value[order], row[order]


def _weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """The FTRL-proximal weights that belong to the sums z and n."""
    pull = np.sign(z) * s.l1 - z
    return np.where(np.abs(z) <= s.l1, 0.0, pull / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def _epoch(s: Settings, z: np.ndarray, n: np.ndarray):
    """One pass of a learner over its rows, from the averaged sums; yields the sums that it changed."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_z, own_n = z.copy(), n.copy()
        touched = np.zeros(len(z), bool)
        for pdf in text_groups(batches):
            index, value, row = features(pdf["text"].tolist(), s.bits)
            cuts = np.searchsorted(row, np.arange(len(pdf) + 1))
            for k, label in enumerate(pdf["label"].to_numpy()):
                i, x = index[cuts[k]:cuts[k + 1]], value[cuts[k]:cuts[k + 1]]
                zi, ni = own_z[i], own_n[i]
                w = _weights(zi, ni, s)
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - label) * x
                own_z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
                own_n[i] = ni + g * g
                touched[i] = True
        at = np.flatnonzero(touched)
        yield pd.DataFrame({"index": at, "z": own_z[at], "n": own_n[at]})

    return learn


def crc_remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A NULL id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn ``quality`` from the labelled documents that are not held out.

    At most about ``max_rows`` labels are used: their ids are picked by hash before any text is read, so
    only that bounded table is broadcast. Repeated labels of an id are averaged. Rows are split by hash over
    a fixed number of learners, each goes through them in order, and the sums are averaged after every
    epoch (iterative parameter mixing): what reaches the driver is as long as the model, not as the data.
    Without usable labels all weights stay 0 and every score is 0.5.
    """
    prepared(docs.sparkSession)
    s = settings
    usable = slim(labels, id="doc_id", label="quality").where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & (crc_remainder(F.col("id")) != 2))
    usable = checkpointed(usable.groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("label")))
    found = usable.count()
    if found > s.max_rows:
        share = F.shiftrightunsigned(F.xxhash64(F.lit("train"), "id"), 11).cast("double") * F.lit(2.0 ** -53)
        usable = usable.where(share < s.max_rows / found)
    picked = slim(docs, doc_id="doc_id", text="text").join(F.broadcast(usable), F.col("doc_id") == F.col("id"))
    rows = materialised(picked.select("id", "text", "label"), "training")
    z, n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    # dealt once and kept on disk for all epochs; a lost part is dealt again from the written table
    dealt = rows.repartition(s.parts, "id").sortWithinPartitions(F.xxhash64("id", "text"))
    dealt = dealt.select("text", "label").persist(StorageLevel.DISK_ONLY)
    for _ in range(s.epochs):
        sums = dealt.mapInPandas(_epoch(s, z, n), "index long, z double, n double")
        mean = sums.groupBy("index").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()
        z[mean["index"]], n[mean["index"]] = mean["z"], mean["n"]
    dealt.unpersist()
    return Model(s, _weights(z, n, s).astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` from the text alone, as sparse dot products.

    A NULL or empty text gets the score of the constant. Input columns called like a result are replaced.
    """
    prepared(docs.sparkSession)
    weights, bits = model.weights, model.settings.bits

    @F.pandas_udf("double")
    def points(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts))
            done = 0
            for pdf in text_groups([pd.DataFrame({"text": texts})]):
                index, value, row = features(pdf["text"].tolist(), bits)
                out[done:done + len(pdf)] = np.bincount(row, weights[index] * value, len(pdf))
                done += len(pdf)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    scored = attach(docs, {"score": points(quoted("text"))})
    return attach(scored, {"predicted": (F.col("score") >= model.settings.threshold).cast("int")})

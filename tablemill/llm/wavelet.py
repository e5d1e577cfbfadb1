"""Token ids as wavelet matrices, one per shard: access, counting and occurrence lookup on compressed bit-planes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablemill.llm.base import prepared, slim, text_groups
from tablemill.llm.encode import SLICE, encoder
from tablemill.operators.joins import small_side
from tablemill.session import work_path

#: Bits of an id, tokens after which a shard is closed, and bits per entry of the rank directory.
BITS, SHARD_TOKENS, BLOCK = 16, 1 << 20, 512
MAGIC = b"WVM1"


class WaveletMatrix:
    """A sequence of ids below 2^16 as bit-planes, the highest bit first; each plane is ordered by the planes above.

    ``planes`` are the packed bits, ``zeros`` the zeros of a plane, ``ranks`` the ones before each block of
    512 bits. rank and select on a plane read one entry of the directory and at most one block.
    """

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes
        self.ranks, self.zeros = [], []
        for plane in planes:
            ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.int64)
            self.ranks.append(np.concatenate([[0], np.cumsum(ones)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        rows, planes = np.asarray(ids, np.uint16), []
        for bit in range(BITS - 1, -1, -1):
            one = (rows >> bit & 1).astype(bool)
            planes.append(np.packbits(one))
            rows = np.concatenate([rows[~one], rows[one]])
        return cls(len(rows), planes)

    def dumps(self) -> bytes:
        """The file: a mark, the length, the size of each compressed plane, and the planes."""
        packed = [zlib.compress(p.tobytes(), 1) for p in self.planes]
        return MAGIC + struct.pack(f"<Q{BITS}Q", self.n, *map(len, packed)) + b"".join(packed)

    @classmethod
    def loads(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, *sizes = struct.unpack_from(f"<Q{BITS}Q", raw, 4)
        ends = np.cumsum(sizes) + 4 + 8 * (BITS + 1)
        planes = [np.frombuffer(zlib.decompress(raw[e - s:e]), np.uint8) for e, s in zip(ends, sizes)]
        return cls(n, planes)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones before position ``at`` of a plane."""
        block = at // BLOCK
        part = np.unpackbits(self.planes[level][block * BLOCK // 8:(at + 7) // 8])[:at - block * BLOCK]
        return int(self.ranks[level][block]) + int(part.sum())

    def _find(self, level: int, k: int, one: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level]
        before = ranks if one else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8])[:self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(BITS):
            bit, ones = self._bit(level, at), self._ones(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _interval(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(BITS):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (BITS - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token from position low up to, but without, high."""
        low, high = self._interval(token, low, self.n if high is None else high)
        return high - low

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token, or -1."""
        low, high = self._interval(token, 0, self.n)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for level in range(BITS - 1, -1, -1):
            one = token >> (BITS - 1 - level) & 1
            at = self._find(level, at - self.zeros[level] if one else at, one)
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence: from the lowest plane up, each plane's order is undone."""
        rows = np.zeros(self.n, np.uint16)
        for level in range(BITS - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).astype(bool)
            up = np.empty_like(rows)
            up[~one], up[one] = rows[:self.zeros[level]], rows[self.zeros[level]:] | np.uint16(1 << (BITS - 1 - level))
            rows = up
        return rows


def _shards(name: str, limit: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, here = encoder(name), TaskContext.get().partitionId()
        number, docs, held, size = 0, [], [], 0

        def close() -> pd.DataFrame:
            return pd.DataFrame({"part": [here], "number": [number], "tokens": [size], "doc_ids": [docs],
                                 "lengths": [[len(x) for x in held]],
                                 "matrix": [WaveletMatrix.build(np.concatenate(held)).dumps()]})

        for pdf in text_groups(batches, limit=SLICE):
            for doc_id, ids in zip(pdf["doc_id"], own.ids(pdf["text"].tolist())):
                docs.append(None if pd.isna(doc_id) else doc_id)
                held.append(ids)
                size += len(ids)
                if size >= limit:
                    yield close()
                    number, docs, held, size = number + 1, [], [], 0
        if held:
            yield close()

    return each


def write_shards(docs: DataFrame, path: str, name: str = "word_bpe_49k.json", limit: int = SHARD_TOKENS) -> None:
    """Write the ids of all documents, in ascending doc_id order, as one wavelet matrix per shard.

    Texts are dealt by ranges of doc_id (NULL first, ties by text) and encoded in the task that writes them; a
    shard is closed after the document with which it reaches ``limit`` tokens. A shard is one row of the
    written table: part, number, tokens, doc_ids, lengths and the compressed matrix. NULL and empty texts are
    one end id; repeated rows are written each; an empty table gives no shard.
    """
    prepared(docs.sparkSession)
    light = slim(docs, doc_id="doc_id", text="text")
    kind = light.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = light.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInPandas(_shards(name, limit), f"part int, number int, tokens long, doc_ids array<{kind}>, lengths array<long>, matrix binary"
                        ).write.option("compression", "uncompressed").parquet(path)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            ids = WaveletMatrix.loads(row.matrix).ids().astype("<u4")
            ends = np.cumsum(row.lengths)
            if len(ids) != (ends[-1] if len(ends) else 0):
                raise ValueError(f"shard {row.part}/{row.number} is not whole")
            yield pd.DataFrame({
                "part": row.part, "number": row.number, "doc_id": pd.Series(list(row.doc_ids), dtype=object),
                "inner": ends - row.lengths, "n_tokens": row.lengths,
                "ids_crc32": [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends, row.lengths)]})


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written shards alone."""
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    found = shards.mapInPandas(_digests, f"part int, number int, doc_id {kind}, inner long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "number", "tokens")
    sizes = sizes.withColumn("own", F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens"))
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.withColumn("parts_before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # one line per task
    begin = sizes.join(parts, "part").select("part", "number", (F.col("own") + F.col("parts_before")).alias("begin"))
    return found.join(small_side(begin), ["part", "number"]).select(
        "doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards to the shared folder and give the digests of what was written."""
    path = work_path(prepared(docs.sparkSession), "wavelet")
    write_shards(docs, path, name, limit)
    return read_digests(docs.sparkSession, path)

"""Order-preserving packing of documents into token sequences by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tablemill.llm.base import prepared, release, slim, text_groups
from tablemill.llm.encode import SLICE, encoder, forget
from tablemill.operators.joins import small_side
from tablemill.session import materialised

WINDOW = 2048
#: Costs in tokens of padding: a cut after a sentence and a cut inside one; after a document it is free.
SENTENCE_COST, INNER_COST = 4, 64
#: A sentence longer than this may be cut inside, at every so many tokens.
INNER_STEP = 128
#: Tokens for which cuts are chosen together; the last window goes over to the next lot.
LOT = 400_000


def choose_cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indexes of ``places`` where windows end, least in padding plus costs.

    best[j] = min over i of best[i] + window - (p[j] - p[i]) + cost[j] with p[j] - p[i] <= window. The part that
    depends on i alone, best[i] + p[i], is kept in a queue of rising values, so every place enters and leaves
    it once. ``places`` begin with 0, and neighbours are at most a window apart.
    """
    p, cost = places.tolist(), costs.tolist()
    key, back = [0] * len(p), [0] * len(p)
    queue = deque([0])
    for j in range(1, len(p)):
        while p[queue[0]] < p[j] - window:
            queue.popleft()
        back[j] = queue[0]
        value = key[queue[0]] + window + cost[j]  # best[j] + p[j]
        while queue and key[queue[-1]] > value:
            queue.pop()
        key[j] = value
        queue.append(j)
    out, j = [], len(p) - 1
    while j > 0:
        out.append(j)
        j = back[j]
    return out[::-1]


@dataclass
class Part:
    """Some ids of a document, from ``start`` on; ``last`` if the document ends with them."""

    doc_id: object
    start: int
    ids: np.ndarray
    tokens: int
    last: bool


class Packer:
    """Takes documents in order and gives finished pieces; see ``pack_documents`` for their columns."""

    def __init__(self, sentence_ends: np.ndarray, window: int):
        self.sentence_ends, self.window = sentence_ends, window
        self.parts: list[Part] = []
        self.held = self.sequence = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        for at in range(0, len(ids), LOT):
            cut = ids[at:at + LOT]
            self.parts.append(Part(doc_id, at, cut, len(ids), at + LOT >= len(ids)))
            self.held += len(cut)
            if self.held >= LOT:
                yield from self.pack(final=False)

    def _places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cost = np.full(len(ids) + 1, -1, np.int64)
        cost[np.flatnonzero(self.sentence_ends[ids]) + 1] = SENTENCE_COST
        ends = np.cumsum([len(p.ids) for p in self.parts])
        cost[[e for e, p in zip(ends, self.parts) if p.last]] = 0
        cost[0] = cost[-1] = 0
        at = np.flatnonzero(cost >= 0)
        step = min(INNER_STEP, self.window)
        for a, b in zip(at[:-1][np.diff(at) > step], at[1:][np.diff(at) > step]):
            inner = cost[a + step:b:step]
            inner[inner < 0] = INNER_COST
        at = np.flatnonzero(cost >= 0)
        return at, cost[at]

    def pack(self, final: bool) -> Iterator[list]:
        if not self.parts:
            return
        ids = np.concatenate([p.ids for p in self.parts])
        places, costs = self._places(ids)
        cuts = [0] + places[choose_cuts(places, costs, self.window)].tolist()
        keep = len(cuts) - 1 if final or len(cuts) == 2 else len(cuts) - 2
        k, done = 0, 0  # the current part, and where it begins
        for begin, b in zip(cuts[:keep], cuts[1:keep + 1]):
            a = begin
            while a < b:
                part = self.parts[k]
                stop = min(b, done + len(part.ids))
                first = part.start + a - done
                raw = ids[a:stop].astype("<u4").tobytes()
                yield [part.doc_id, first, stop - a, zlib.crc32(raw), part.tokens, self.sequence, a - begin,
                       ids[a:stop]]
                if stop == done + len(part.ids):
                    done, k = stop, k + 1
                a = stop
            self.sequence += 1
        end = cuts[keep]
        rest = []
        for part in self.parts[k:]:
            skip = max(end - done, 0)
            done += len(part.ids)
            if skip < len(part.ids):
                rest.append(Part(part.doc_id, part.start + skip, part.ids[skip:], part.tokens, part.last))
        self.parts, self.held = rest, sum(len(p.ids) for p in rest)


def _pack(name: str, window: int, with_ids: bool, keep_encoder: bool):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(name)
        vocabulary = own.library.get_vocab()
        ends = np.zeros(1 << 16, bool)
        ends[[i for word, i in vocabulary.items() if word.removesuffix("</w>")[-1:] in (".", "!", "?") and word.endswith("</w>")]] = True
        packer, here = Packer(ends, window), TaskContext.get().partitionId()
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids"]

        def frame(rows: list[list]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=columns)
            out["part"] = here
            if not with_ids:
                return out.drop(columns="ids")
            out["ids"] = [x.astype(np.int32) for x in out["ids"]]
            return out

        for pdf in text_groups(batches, limit=SLICE):
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], own.ids(pdf["text"].tolist())):
                rows += packer.add(None if pd.isna(doc_id) else doc_id, ids)
            if rows:
                yield frame(rows)
        if not keep_encoder:
            del own
            forget(name)
        rows = list(packer.pack(final=True))
        if rows:
            yield frame(rows)
        del rows, packer
        release()

    return each


def pack_documents(docs: DataFrame, name: str = "word_bpe_49k.json", window: int = WINDOW, with_ids: bool = False,
                   keep_encoder: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of every piece.

    Documents follow each other by doc_id (NULL first, ties by text) and keep that order in the sequences.
    They are dealt by ranges of doc_id; each task encodes its documents as a stream and chooses the window ends
    that waste least: padding, plus a cost for a cut after a sentence and a higher one for a cut inside.
    Only the last window of a task may stay largely empty. Every document has an end id, so a NULL or
    empty text is one token; a long document goes through in lots and may fill many sequences; repeated rows
    are packed each. Sequences are numbered without gaps. Workers keep the words they have encoded for later
    tasks; without ``keep_encoder`` they drop them after each task, for jobs whose other stages need the memory.
    """
    prepared(docs.sparkSession)
    light = slim(docs, doc_id="doc_id", text="text")
    kind = light.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = light.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long, part int"
    pieces = materialised(ordered.mapInPandas(_pack(name, window, with_ids, keep_encoder), schema + (", ids array<int>" if with_ids else "")), "pieces")
    parts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one line per task
    placed = pieces.join(small_side(parts.select("part", before.alias("before"))), "part")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                         (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []))

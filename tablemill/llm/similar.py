"""Join of texts on the Jaccard similarity of their word n-grams, with Bayesian pruning of candidates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.llm.base import prepared, slim, text_groups
from tablemill.llm.runs import Forest, map_runs
from tablemill.llm.words import distinct_grams, hashed_words, minhash
from tablemill.operators.cluster.components import connected_components
from tablemill.operators.joins import small_side
from tablemill.session import checkpointed, materialised

WORDS = 5
THRESHOLD = 0.8
#: 20 bands of 3 values: a pair at the threshold meets in none of them once in 1.7 million.
BANDS, ROWS = 20, 3
HASHES = BANDS * ROWS
#: Values compared before the posterior is looked at again.
STEP = 15
#: A pair is dropped when its similarity reaches the threshold with less than this probability.
TOLERANCE = 1e-6
#: Rows of two blocks that one task compares by signature, and rows and characters that it compares exactly.
SIGNATURE_BLOCK, EXACT_BLOCK, EXACT_CHARS = 1024, 512, 4_000_000


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the matches below which a pair is dropped.

    With a uniform prior the similarity has the posterior Beta(m + 1, n - m + 1); its mass above t is
    the probability of at most m successes in n + 1 trials of chance t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingle_sets(texts: list[str | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted different shingles of every text. A shorter text is one shingle."""
    return distinct_grams(*hashed_words(texts), size)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in text_groups(batches):
        value, counts = shingle_sets(pdf["text"].tolist())
        signed = minhash(value, counts, HASHES)
        ends = np.cumsum(counts)
        nodes = [hashlib.md5(value[e - c:e].tobytes()).digest() if c else None for e, c in zip(ends, counts)]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "print": pdf["print"], "node": nodes,
                            "sign": [s.tobytes() if c else None for s, c in zip(signed, counts)]})


def _candidates(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Edges that hold together, in each bucket, the members whose signatures survive the pruning."""
    bounds = least_matches()
    sign = np.frombuffer(b"".join(pdf["sign"]), np.uint32).reshape(len(pdf), HASHES)

    def survive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
        for n, least in bounds.items():
            matches = matches + (sign[a[alive], n - STEP:n] == sign[b[alive], n - STEP:n]).sum(1)
            stays = matches >= least
            alive, matches = alive[stays], matches[stays]
        return alive

    left, right = [], []
    sizes = np.diff(starts)
    for size in np.unique(sizes[sizes <= 32]):
        first = starts[:-1][sizes == size]
        i, j = np.triu_indices(size, 1)
        a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
        for at in range(0, len(a), 200_000):
            x, y = a[at:at + 200_000], b[at:at + 200_000]
            kept = survive(x, y)
            left.append(x[kept])
            right.append(y[kept])
    for first, size in zip(starts[:-1][sizes > 32], sizes[sizes > 32]):
        # members already held together need no further comparison between them
        members, forest = np.arange(size), Forest(size)
        for k in range(size):
            roots = forest.roots()
            others = members[(roots != roots[k]) & (members > k)]
            if len(others):
                kept = others[survive(np.full(len(others), first + k), first + others)]
                for o in kept:
                    forest.join(k, o)
                left.append(np.full(len(kept), first + k))
                right.append(first + kept)
            elif (roots == 0).all():
                break
    node = pdf["node"].to_numpy()
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    return pd.DataFrame({"a": node[a], "b": node[b]}).drop_duplicates()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for low in range(0, len(values), 8192):
        lo, hi = np.searchsorted(at, [low, low + 8192])
        block = np.zeros((len(sets), min(8192, len(values) - low)), np.float32)
        block[row[lo:hi], at[lo:hi] - low] = 1
        out += block @ block.T
    return out


def _verify(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Per row of each block pair: the documents linked to it by the exact similarity, and a linked row."""
    links, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
    copies, side, ids = pdf["copies"].to_numpy(), pdf["block"].to_numpy(), pdf["node"].to_numpy()
    one, two = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    for a, b in zip(starts[:-1], starts[1:]):
        value, counts = shingle_sets(pdf["text"].iloc[a:b].tolist())
        sets = np.split(value, np.cumsum(counts)[:-1])
        both = shared_counts(sets)
        linked = both >= THRESHOLD * (counts[:, None] + counts[None, :] - both) - 1e-6
        np.fill_diagonal(linked, False)
        if one[a] != two[a]:  # rows of one block meet in a task of their own
            linked &= side[a:b, None] != side[None, a:b]
        links[a:b] = linked @ copies[a:b]
        forest = Forest(b - a)
        x, y = np.nonzero(np.triu(linked))
        for p, q in zip(x.tolist(), y.tolist()):
            forest.join(p, q)
        root[a:b] = a + forest.roots()
    return pd.DataFrame({"node": ids, "links": links, "root": ids[root]})


def _edges(reps: DataFrame) -> DataFrame:
    """Candidate edges between the different sets: buckets of equal bands, pruned by the posterior."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(
        k, F.substring(F.col("sign"), k * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    rows = reps.select("node", F.explode(band).alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = rows.join(full, "bucket").join(reps.select("node", "sign"), "node")
    # a bucket beyond one task's share is cut into blocks, and every pair of blocks meets once
    half = SIGNATURE_BLOCK // 2
    blocks = F.when(F.col("n") <= SIGNATURE_BLOCK, 1).otherwise(F.ceil(F.col("n") / half)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks)
    members = members.select("node", "sign", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    members = members.select("node", "sign", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return map_runs(members, ["bucket", "i", "j"], _candidates, "a binary, b binary").distinct()


def exact_links(texts: DataFrame) -> DataFrame:
    """(node, links, root): exact links of every text (node, group, copies, text) to the others of its group.

    ``links`` counts the copies of the texts linked to it, ``root`` is a linked node (or itself). A group
    beyond one task's share is cut into blocks, and every pair of blocks meets once.
    """
    size = texts.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))
    need = F.greatest(F.col("n") / EXACT_BLOCK, F.col("chars") / EXACT_CHARS)
    blocks = F.when(need <= 1, 1).otherwise(F.ceil(2 * need)).cast("int")
    dealt = texts.join(small_side(size.select("group", blocks.alias("blocks"))), "group")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "node", "group", "copies", "text", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return checkpointed(map_runs(dealt, ["group", "i", "j"], _verify, "node binary, links long, root binary"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, print, class_id, n_links, n_copies, first) of every document.

    Two documents are linked when the Jaccard similarity of their sets of five-word shingles (words between
    white space, A-Z as a-z) is 0.8 or more; a class is a connected set of links and ``class_id`` its
    smallest doc_id. ``n_links`` counts the other documents linked to this one, copies included, ``n_copies``
    those with the same set. ``first`` marks the rows of the class's smallest (doc_id, print).

    Documents with equal sets are one node. Nodes that share a band are compared value by value and
    dropped by the posterior; the components of what remains are compared exactly, in blocks, so that no row
    is written per pair. A text of fewer than five words is one shingle. A text without words, or NULL, is
    alone: class_id is its doc_id and it has no links. Repeated rows are copies of each other.
    """
    prepared(docs.sparkSession)
    light = slim(docs, doc_id="doc_id", text="text").withColumn("print", F.xxhash64("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    signed = materialised(light.select("doc_id", "print", "text").mapInPandas(
        _sign, f"doc_id {kind}, print long, node binary, sign binary"), "signatures")
    reps = signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "print")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("sign").alias("sign"))
    reps = materialised(reps, "sets")
    groups = connected_components(_edges(reps)).withColumnRenamed("label", "group")
    members = checkpointed(groups.join(reps.select("node", "rep", "copies"), "node"))

    wanted = small_side(members.select(F.col("rep.doc_id").alias("__llm_id"), F.col("rep.print").alias("__llm_print"), "node", "group", "copies"), True)
    texts = light.join(wanted, light["doc_id"].eqNullSafe(F.col("__llm_id")) & (light["print"] == F.col("__llm_print")))
    texts = materialised(texts.select("node", "group", "copies", "text").dropDuplicates(["node"]), "members")
    found = exact_links(texts)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = reps.select("node", "rep", "copies").join(small_side(links), "node", "left").join(
        small_side(classes), "node", "left").select(
        "node", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))
    nodes = materialised(nodes, "nodes")
    first = nodes.groupBy("label").agg(F.min("rep").alias("top"))
    nodes = nodes.join(first, "label").select("node", "copies", "links", "top")
    out = signed.select("doc_id", "print", "node").join(nodes, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id", "print", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, 0).otherwise(F.col("copies") - 1).cast("long").alias("n_copies"),
        (alone | (F.struct("doc_id", "print").eqNullSafe(F.col("top")))).alias("first"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest doc_id; all columns as they are.

    Of repeated rows with the kept doc_id and text one stays, unless they have no words.
    """
    found = materialised(similar_documents(docs), "classes")
    own = F.xxhash64(quoted("text"))
    marked = docs.withColumn("__llm_own", own)

    def same(table: DataFrame):
        named = small_side(table.select(F.col("doc_id").alias("__llm_id"), F.col("print").alias("__llm_print")).distinct())
        return named, quoted("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_own") == F.col("__llm_print"))

    drop, on = same(found.where("NOT first"))
    kept = marked.join(drop, on, "left_anti")
    repeated = found.where("first AND n_copies > 0").groupBy("doc_id", "print").count().where("count > 1")
    twice, on = same(repeated)
    single = kept.join(twice, on, "left_anti")
    more = kept.join(twice, on, "left_semi").dropDuplicates(["doc_id", "__llm_own"])
    return single.unionByName(more).drop("__llm_own")

"""Substring dedup: repeated paragraphs by MinHash banding, and repeated passages that lie inside paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.llm.base import prepared, release, slim, text_groups
from tablemill.llm.similar import THRESHOLD, WORDS, exact_links
from tablemill.llm.words import distinct_grams, grams, hashed_words, minhash, sequence_hashes, spans
from tablemill.operators.cluster.components import connected_components
from tablemill.operators.joins import small_side
from tablemill.session import checkpointed, materialised

#: Paragraphs with fewer words are left alone: short lines repeat by chance and by custom.
LEAST_WORDS = 25
#: Passages are found by equal runs of RUN words, of which the least hash in every RUN_WINDOW neighbours is
#: kept: two texts that share PASSAGE = RUN + RUN_WINDOW - 1 words in a row share a kept run for certain.
RUN, RUN_WINDOW = 20, 31
PASSAGE = RUN + RUN_WINDOW - 1


def tune(threshold: float = THRESHOLD, recall: float = 0.999, most: int = 10) -> tuple[int, int]:
    """(bands, rows): the most values per band with which ``most`` bands still find a pair at the threshold
    with the wanted probability, and the fewest bands that do so."""
    for rows in range(8, 0, -1):
        for bands in range(1, most + 1):
            if 1 - (1 - threshold ** rows) ** bands >= recall:
                return bands, rows
    return most, 1


BANDS, ROWS = tune()
RUN_MARK = "run"


def winnow(value: np.ndarray, who: np.ndarray, window: int = RUN_WINDOW) -> np.ndarray:
    """Positions of the values that are least in some stretch of ``window`` neighbours of one text."""
    n = len(value) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(value, window).min(1)
    inside = who[:n] == who[window - 1:]
    least = np.where(inside, least, 0)  # no value is 0 but by a chance of 2^-64, and then it is only kept
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    best = np.lib.stride_tricks.sliding_window_view(padded, window).max(1)
    return np.flatnonzero(best == value)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in text_groups(batches):
        texts = pdf["text"].tolist()
        hashes, counts, first, _ = hashed_words(texts, with_places=True)
        begins = np.cumsum(counts) - counts
        line = np.zeros(len(hashes), np.int64)
        for k, text in enumerate(texts):
            if counts[k]:
                breaks = np.flatnonzero(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) == 10)
                own = slice(begins[k], begins[k] + counts[k])
                line[own] = np.searchsorted(breaks, first[own])
        owner = np.repeat(np.arange(len(texts)), counts)
        new = np.ones(len(hashes), bool)
        new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(hashes)))
        one, two = (_as_long(sequence_hashes(hashes, sizes, seed)) for seed in (0, 1))
        sets, set_sizes = distinct_grams(hashes, sizes, WORDS)
        signed = minhash(sets, set_sizes, BANDS * ROWS).reshape(len(sizes), BANDS, ROWS).astype(np.uint64)
        band = signed[:, :, 0] * np.uint64(0x9E3779B97F4A7C15)
        for r in range(1, ROWS):
            band = (band ^ signed[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
        band = _as_long(band ^ np.arange(BANDS, dtype=np.uint64))
        whole = np.flatnonzero(sizes >= LEAST_WORDS)
        who = owner[starts[whole]]
        lines = pd.DataFrame({"who": who, "start": starts[whole] - begins[who], "size": sizes[whole],
                              "one": one[whole], "two": two[whole], "bands": list(band[whole])})
        value, who, at = grams(hashes, counts, RUN)
        kept = winnow(value, who)
        other, _, _ = grams(hashes ^ np.uint64(0x5555555555555555), counts, RUN)
        runs = pd.DataFrame({"who": who[kept], "start": at[kept], "size": RUN, "one": _as_long(value[kept]),
                             "two": _as_long(other[kept])})
        runs["bands"] = None
        out = pd.concat([lines, runs], ignore_index=True)
        out["doc_id"], out["print"] = pdf["doc_id"].to_numpy()[out["who"]], pdf["print"].to_numpy()[out["who"]]
        yield out[["doc_id", "print", "start", "size", "one", "two", "bands"]]


def _texts_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Text of each wanted paragraph of a document."""
    for pdf in batches:
        out = []
        for text, wanted in zip(pdf["text"], pdf["wanted"]):
            raw = text.encode("utf-8", "surrogatepass")
            starts, ends = spans(np.frombuffer(raw, np.uint8))
            for w in wanted:
                a, b = starts[w["start"]], ends[w["start"] + w["size"] - 1]
                out.append((w["node"], w["group"], raw[a:b].decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(out, columns=["node", "group", "text"])
        del pdf, out
        release()


def _node() -> Column:
    return F.concat(F.unhex(F.lpad(F.hex("one"), 16, "0")), F.unhex(F.lpad(F.hex("two"), 16, "0")))


def _near_paragraphs(light: DataFrame, lines: DataFrame) -> DataFrame:
    """(node, label) of the paragraphs that have a near copy: bands, exact similarity, components."""
    rows = lines.select("one", F.explode("bands").alias("bucket")).distinct()
    full = rows.groupBy("bucket").agg(F.min("one").alias("a"), F.max("one").alias("z")).where("a < z").select("bucket", "a")
    edges = rows.join(full, "bucket").where("one <> a").select("a", F.col("one").alias("b")).distinct()
    groups = connected_components(edges).select(F.col("node").alias("one"), F.col("label").alias("group"))
    place = F.min(F.struct("doc_id", "print", "start", "size")).alias("at")
    reps = lines.join(small_side(groups), "one").groupBy("one", "two", "group").agg(place)
    reps = reps.select(_node().alias("node"), "group", "at.*")
    wanted = reps.groupBy(F.col("doc_id").alias("__llm_id"), F.col("print").alias("__llm_print")).agg(
        F.collect_list(F.struct("node", "group", "start", "size")).alias("wanted"))
    same = light["doc_id"].eqNullSafe(F.col("__llm_id")) & (light["print"] == F.col("__llm_print"))
    texts = light.join(small_side(wanted), same).select("text", "wanted")
    texts = texts.mapInPandas(_texts_of, "node binary, group long, text string").dropDuplicates(["node"])
    found = exact_links(materialised(texts.withColumn("copies", F.lit(1).cast("long")), "paragraphs"))
    return connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, print, start, size, cluster, kept_doc_id, kept_print, kept_start): the passages to remove.

    Units are the paragraphs (lines of 25 words or more) and the kept 20-word runs of a document, as word
    positions. Paragraphs that share a band are brought together, compared exactly by the Jaccard similarity of
    their five-word shingles (0.8 or more), and clustered by components; equal runs are a cluster. Runs make sure
    that any passage of 50 words or more is found, wherever it stands in its paragraph. Of each cluster
    the first unit in (doc_id, text, position) order stays, all others are listed, with the one that stays. A run is
    grown to the whole stretch of words that its document shares with the one that keeps it.

    Near copies are settled first. A run inside a line that goes as a near copy is not the one that stays, and runs
    grow only over words that their keeper keeps, so the words of a run that is listed always remain at an earlier place;
    only what near copies of a paragraph have of their own, and nothing but such copies holds, is lost with them. In a text that repeats one word or phrase the
    first place stays, which may be shorter than a run, since the places overlap.

    Every place of a repeated run and of a repeated paragraph counts, across documents and within one. Rows that
    agree in doc_id and text are one document. NULL or empty texts have no units. An empty table has no passages.
    """
    prepared(docs.sparkSession)
    light = slim(docs, doc_id="doc_id", text="text").withColumn("print", F.xxhash64("text"))
    kind = light.schema["doc_id"].dataType.simpleString()
    units = materialised(light.select("doc_id", "print", "text").mapInPandas(
        _units, f"doc_id {kind}, print long, start int, size int, one long, two long, bands array<long>"), "units")
    lines, runs = units.where("bands IS NOT NULL"), units.where("bands IS NULL").drop("bands")
    near = _near_paragraphs(light, lines)

    def repeated(table: DataFrame) -> DataFrame:
        often = table.groupBy("one").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one")
        return table.join(often, "one")

    plain = lines.drop("bands").withColumn("node", _node())
    near_lines = plain.join(small_side(near), "node").withColumn("cluster", F.col("label"))
    equal_lines = repeated(plain.join(small_side(near.select("node")), "node", "left_anti")).withColumn("cluster", F.col("node"))
    equal_runs = repeated(runs).withColumn("cluster", F.concat(F.lit(RUN_MARK).cast("binary"), _node()))
    columns = ["doc_id", "print", "start", "size", "cluster"]
    out = _later(materialised(near_lines.select(*columns).unionByName(equal_lines.select(*columns)).distinct(), "lines"), F.lit(False))
    gone = materialised(out, "removed_lines")
    cuts = checkpointed(gone.groupBy(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))).alias("cuts")))
    # words of a near copy go without standing anywhere else, so no run is kept where such a line goes
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print"))
    covered = F.coalesce(F.exists("cuts", lambda c: (c["start"] < F.col("start") + F.col("size")) & (c["stop"] > F.col("start"))), F.lit(False))
    placed = equal_runs.select(*columns).distinct().join(small_side(cuts, True), same, "left").withColumn("covered", covered)
    runs = materialised(_later(materialised(placed.select(*columns, "covered"), "occurrences"), F.col("covered")), "repeated")
    return gone.unionByName(_whole_passages(light, runs, cuts))


def _later(found: DataFrame, covered: Column) -> DataFrame:
    """Of each cluster all uncovered units but the first, with the place of the first."""
    place = F.struct("doc_id", "print", "start")
    open_ = found.where(~covered)
    first = open_.groupBy("cluster").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n"))
    out = open_.join(first.where("n > 1").drop("n"), "cluster").where(~place.eqNullSafe(F.col("kept")))
    return out.select("doc_id", "print", "start", "size", "cluster", F.col("kept.doc_id").alias("kept_doc_id"),
                      F.col("kept.print").alias("kept_print"), F.col("kept.start").alias("kept_start"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """The number of equal values that both begin with, looked for in steps that double."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        other = np.flatnonzero(a[done:min(done + step, n)] != b[done:min(done + step, n)])
        if len(other):
            return done + int(other[0])
        done, step = done + step, 2 * step
    return n


def _extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The longest common stretch of words around each pair of equal runs of two documents, or of two places of one."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples():
            hashes, (m, _) = hashed_words([row.text, row.kept_text])
            own, kept = hashes[:m], hashes[m:]
            cuts = [] if row.cuts is None else [(c["start"], c["stop"]) for c in row.cuts]
            done, grown = {}, []
            for start, other in sorted((x["start"], x["kept_start"]) for x in row.seeds):
                lag = other - start
                if start < done.get(lag, 0):
                    continue
                low = max((stop for _, stop in cuts if stop <= other), default=0)  # words that go are not kept
                high = min((begin for begin, _ in cuts if begin >= other + RUN), default=len(kept))
                first = start - _common(own[:start][::-1], kept[low:other][::-1])
                last = start + _common(own[start:], kept[other:high])
                done[lag] = last
                if last - first >= RUN:
                    grown.append((first, -last, lag))
            reach = 0
            for first, last, lag in sorted(grown):  # a stretch inside another one adds nothing
                if -last > reach:
                    reach = -last
                    out.append((row.doc_id, row.print, first, reach - first, row.kept_doc_id, row.kept_print, first + lag))
        found = pd.DataFrame(out, columns=["doc_id", "print", "start", "size", "kept_doc_id", "kept_print", "kept_start"])
        yield found.astype({"doc_id": "Int64", "kept_doc_id": "Int64"}) if pdf["doc_id"].dtype.kind in "if" else found
        del pdf, out, found
        release()


def _whole_passages(light: DataFrame, runs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Equal runs grown to the whole passages that the two documents share, word by word, as far as the keeper keeps them."""
    key = ["doc_id", "print", "kept_doc_id", "kept_print"]
    pairs = runs.groupBy(*key).agg(F.collect_set(F.struct("start", "kept_start")).alias("seeds"))
    ends = pairs.select("doc_id", "print").unionByName(pairs.select(
        F.col("kept_doc_id").alias("doc_id"), F.col("kept_print").alias("print"))).distinct()
    ends = ends.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print"))
    wanted = light.join(small_side(ends), light["doc_id"].eqNullSafe(F.col("_id")) & (light["print"] == F.col("_print")), "left_semi")
    texts = materialised(wanted.dropDuplicates(["doc_id", "print"]), "texts")
    named = lambda id_, print_, text: texts.select(F.col("doc_id").alias(id_), F.col("print").alias(print_), F.col("text").alias(text))
    same = lambda a, b, c, d: F.col(a).eqNullSafe(F.col(b)) & (F.col(c) == F.col(d))
    both = pairs.join(named("_id", "_print", "text"), same("doc_id", "_id", "print", "_print")).drop("_id", "_print")
    both = both.join(named("_id", "_print", "kept_text"), same("kept_doc_id", "_id", "kept_print", "_print")).drop("_id", "_print")
    both = both.join(small_side(cuts, True), same("kept_doc_id", "_id", "kept_print", "_print"), "left").drop("_id", "_print")
    kind = light.schema["doc_id"].dataType.simpleString()
    found = both.mapInPandas(_extended, f"doc_id {kind}, print long, start int, size int, kept_doc_id {kind}, kept_print long, kept_start int")
    place = F.concat_ws("/", "kept_doc_id", "kept_print", "kept_start", "size")
    return found.select("doc_id", "print", "start", "size", F.md5(place).cast("binary").alias("cluster"),
                        "kept_doc_id", "kept_print", "kept_start")


def covered_words(pieces: Column) -> Column:
    """Words inside any of the (start, size) pieces."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["start"] + s["size"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
        F.greatest(a["end"], s["start"] + s["size"]).alias("end"))
    return F.aggregate(F.array_sort(pieces), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, kept_doc_id, n_passages, n_words: for each document with passages to remove, where they stay."""
    found = repeated_passages(docs)
    pieces = found.groupBy("doc_id", "print", "kept_doc_id").agg(F.collect_set(F.struct("start", "size")).alias("pieces"))
    return pieces.select("doc_id", "kept_doc_id", F.size("pieces").cast("long").alias("n_passages"),
                         covered_words(F.col("pieces")).cast("long").alias("n_words"))


def _without(texts: pd.Series, pieces: pd.Series) -> pd.Series:
    out = []
    for text, cuts in zip(texts, pieces):
        if cuts is None or not isinstance(text, str):
            out.append(text)
            continue
        raw = text.encode("utf-8", "surrogatepass")
        starts, ends = spans(np.frombuffer(raw, np.uint8))
        stays = np.ones(len(starts), bool)
        for c in cuts:
            stays[c["start"]:c["start"] + c["size"]] = False
        keep = np.ones(len(raw), bool)
        edges = np.append(starts, len(raw))
        for k in np.flatnonzero(~stays):  # a word goes with the white space after it
            keep[edges[k]:edges[k + 1]] = False
        left = np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass")
        out.append(left.rstrip() if len(stays) and not stays[-1] else left)
    release()
    return pd.Series(out, dtype=object)


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated passages; documents that lose all their words go. A column ``n_chars`` is kept true."""
    found = repeated_passages(docs).groupBy(F.col("doc_id").alias("__llm_id"), F.col("print").alias("__llm_print")).agg(
        F.collect_set(F.struct("start", "size")).alias("__llm_pieces"))
    same = quoted("doc_id").eqNullSafe(F.col("__llm_id")) & (F.xxhash64(quoted("text")) == F.col("__llm_print"))
    # called so, it is not worked out a second time for the filter below, by a second worker beside each task's first one
    without = F.pandas_udf(_without, "string").asNondeterministic()
    joined = docs.join(small_side(found), same, "left").withColumn("__llm_left", without(quoted("text"), F.col("__llm_pieces")))
    emptied = F.col("__llm_pieces").isNotNull() & ~F.coalesce(F.col("__llm_left"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = {"text": F.col("__llm_left"), "n_chars": F.when(F.col("__llm_pieces").isNull(), quoted("n_chars")).otherwise(
        F.char_length("__llm_left")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return joined.where(~emptied).select(*[own[c].alias(c) if c in own else quoted(c) for c in docs.columns])

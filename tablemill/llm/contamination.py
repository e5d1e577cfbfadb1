"""Benchmark decontamination by a broadcast set of hashed test n-grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.llm.base import prepared, slim
from tablemill.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS, small_side
from tablemill.session import checkpointed

WINDOW = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
#: Key of the line that every document meets once, which carries its number of words.
PRESENT = 0


def normalised_words(text: Column) -> Column:
    """Words after A-Z became a-z; other letters keep their case. ASCII texts take the faster built-in."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(F.coalesce(lower, F.lit("")), F.lit(WORD), F.lit(0))


def _windows(words: Column, length: Column | int, hashed: bool) -> Column:
    """All windows of a length, or their hashes; an empty array where there are too few words."""
    n = length if isinstance(length, Column) else F.lit(length)
    starts = F.sequence(F.lit(1), F.size(words) - n + 1)
    if hashed:
        windows, kind = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, n))), "array<bigint>"
    else:
        windows, kind = F.transform(starts, lambda i: F.slice(words, i, n)), "array<array<string>>"
    return F.when(F.size(words) >= n, windows).otherwise(F.array().cast(kind))


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, size, gram, items): every different window of the items and the items that hold it.

    Items without words have no window; a shorter item is one window.
    """
    items = slim(benchmark, item="item_id", text="text").select(
        F.col("item").cast("string").alias("item"), normalised_words(F.col("text")).alias("words"))
    size = F.least(F.size("words"), F.lit(window))
    items = items.where(F.size("words") > 0).withColumn("size", size)
    grams = items.select("item", "size", F.explode(F.array_distinct(_windows(F.col("words"), F.col("size"), False))).alias("gram"))
    grams = grams.groupBy("size", "gram").agg(F.collect_set("item").alias("items"))
    return grams.select(F.xxhash64("gram").alias("key"), "size", "gram", "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, print, n_words, spans, items) of every document, in one scan of the texts.

    Each window of a document is hashed, looked up in the broadcast grams, and confirmed on the words, so a
    clash of hashes adds nothing. A benchmark too large for one broadcast is looked up in slices. Rows that
    agree in doc_id and text give one line. ``spans`` is the sorted list of (start, size) of the hit windows.
    """
    prepared(docs.sparkSession)
    grams = checkpointed(benchmark_grams(benchmark, window))
    width = F.sum(F.octet_length(F.array_join("gram", " ")) + 16 * (F.size("gram") + F.size("items")) + 32)
    rows, width, sizes = grams.agg(F.count(F.lit(1)), F.coalesce(width, F.lit(0)), F.collect_set("size")).first()
    slices = max(1, -(-rows // BROADCAST_ROWS), -(-width // BROADCAST_BYTES))
    sizes = sorted(sizes)
    n = F.size("words")
    scan = slim(docs, doc_id="doc_id", text="text").select(
        "doc_id", F.xxhash64("text").alias("print"), normalised_words(F.col("text")).alias("words"))
    hashed = [_windows(F.col("words"), s, True) for s in sizes]
    place, offset = F.col("at"), F.lit(0)
    starts = {}
    for s in sizes:
        starts[s] = offset
        offset = offset + F.greatest(n - s + 1, F.lit(0))
    start = reduce(lambda other, s: F.when(F.col("size") == s, place - starts[s]).otherwise(other), sizes, F.lit(0))
    found = []
    for k in range(slices):
        table = grams.where(F.pmod("key", F.lit(slices)) == k)
        present = []
        if k == 0:
            none = F.array().cast("array<string>")  # a row of Spark's own: one from Python starts workers that stay
            table = table.unionByName(docs.sparkSession.range(1).select(
                F.lit(PRESENT).cast("long").alias("key"), F.lit(0).alias("size"), none.alias("gram"), none.alias("items")))
            present = [F.array(F.lit(PRESENT).cast("long"))]
        seen = scan.select("*", F.posexplode(F.concat(*present, *hashed)).alias("at", "key"))
        if not present:  # places count from 1 only where the line for the document stands before them
            seen = seen.withColumn("at", place + 1)
        met = seen.join(F.broadcast(table), "key").withColumn("start", start)
        real = F.when(F.col("size") == 0, place == 0).otherwise(
            (place > 0) & (F.col("start") >= 1) & (F.slice("words", F.greatest("start", F.lit(1)), F.greatest("size", F.lit(1))) == F.col("gram")))
        found.append(met.where(real).select("doc_id", "print", n.alias("n_words"), "start", "size", "items"))
    hits = reduce(DataFrame.unionByName, found)
    span = F.when(F.col("size") > 0, F.struct("start", "size"))
    return hits.groupBy("doc_id", "print").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["start"] + s["size"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
        F.greatest(a["end"], s["start"] + s["size"]).alias("end"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, print and spans of every document.

    A NULL or empty text has no words, no hits and is clean; without benchmark rows every document is.
    """
    hits = find_hits(docs, benchmark, window)
    hit = F.col("n_hit")
    return hits.withColumn("n_hit", covered(F.col("spans")).cast("long")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"), "print", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated documents, or (``mode="spans"``) without the hit words of any document.

    All columns stay as they are; a span goes with the separators before each of its words.
    """
    found = contamination(docs, benchmark, window)
    own = F.xxhash64(quoted("text"))
    if mode == "documents":
        bad = found.where("contaminated").select(F.col("doc_id").alias("__llm_bad_id"), F.col("print").alias("__llm_bad_print"))
        same = quoted("doc_id").eqNullSafe(F.col("__llm_bad_id")) & (own == F.col("__llm_bad_print"))
        return docs.join(small_side(bad), same, "left_anti")
    if mode != "spans":
        raise ValueError("mode is 'documents' or 'spans'")
    hit = found.where("n_hit > 0").select(
        F.col("doc_id").alias("__llm_bad_id"), F.col("print").alias("__llm_bad_print"), F.col("spans").alias("__llm_spans"))
    same = quoted("doc_id").eqNullSafe(F.col("__llm_bad_id")) & (own == F.col("__llm_bad_print"))
    separator = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*"
    mixed = WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    separator = separator.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    pieces = F.regexp_extract_all(quoted("text"), F.lit(separator + mixed), F.lit(0))
    tail = F.regexp_extract(quoted("text"), separator + r"\z", 0)
    stays = lambda p, i: ~F.exists("__llm_spans", lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["size"]))
    text = F.when(F.col("__llm_spans").isNull(), quoted("text")).otherwise(F.concat(F.array_join(F.filter(pieces, stays), ""), tail))
    joined = docs.join(small_side(hit), same, "left")
    return joined.select(*[text.alias(c) if c == "text" else quoted(c) for c in docs.columns])

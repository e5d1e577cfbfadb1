"""Document fingerprints by consistent weighted sampling: equal samples are as likely as two texts are alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablemill.llm.base import WORD, attach, let, prepared, slim

#: Words in a shingle, and samples in a fingerprint.
WORDS, SAMPLES = 5, 48
#: Stands for a missing doc_id in the order of documents: before all others.
FIRST_ID = -(1 << 63)


def weighted_terms(text: Column, size: int = WORDS) -> Column:
    """array<struct<term long, weight long>>: the different runs of ``size`` lower-case words with their counts.

    A text of fewer words, but some, is one term; a text without words, or NULL, has none.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)
    run = lambda w: lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
    runs = let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), run(w))))

    def counted(s: Column) -> Column:
        new = lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), new)
        one = lambda b: F.transform(b, lambda at, k: F.struct(
            F.get(s, at).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - at).cast("long").alias("weight")))
        return F.when(F.size(s) == 0, F.array().cast("array<struct<term:long,weight:long>>")).otherwise(let(starts, one))

    return let(F.sort_array(runs), counted)


def _even(bits: str, n: int) -> str:
    """A number between 0 and 1 from n random bits, never 0 or 1."""
    return f"(({bits} + 0.5D) * {2.0 ** -n!r}D)"


def _plain(j: str | int) -> str:
    """Sample j of a term of weight 1: 52 random bits, of which the greatest of a text wins."""
    return f"shiftrightunsigned(xxhash64(term, 2 * {j}), 12)"


def _heavy(n: int) -> Column:
    """Samples 0 to n - 1 of a term of any weight, as numbers to be compared with those of weight 1.

    Improved consistent weighted sampling (Ioffe, 2010) draws r and c from Gamma(2, 1) and b evenly from 0 to 1
    for each term and sample, takes t = floor(ln w / r + b), and keeps the term with the least
    a = c / exp(r (t - b + 1)). Here three even numbers u, v1, v2 give all of it: c = -ln(v1 v2) is of that law and
    s = ln v1 / ln(v1 v2) is even and independent of c, so r = -ln(u s) and b = ln u / ln(u s) are as asked for. Then
    a = -ln(v1) exp(-r t). A weight of 1 has t = 0, so among such terms the greatest v1 is the least a and no
    logarithm is needed; other terms get the v1 of the same a. It depends on the term and on t alone and stands for
    the pair that the method samples.
    """
    v1, more = _even(_plain("j"), 52), "xxhash64(term, 2 * j + 1)"
    u, v2 = _even(f"shiftrightunsigned({more}, 32)", 32), _even(f"({more} & 4294967295L)", 32)
    r = f"(-ln({u} * ln({v1}) / ln({v1} * {v2})))"
    t = f"floor((ln(weight) - ln({u})) / {r})"
    moved = f"cast(exp(ln({v1}) * exp(-{r} * {t})) * {2.0 ** 52!r}D as long)"
    return F.expr(f"transform(sequence(0, {n - 1}), j -> CASE WHEN {t} <= 0 THEN {_plain('j')} ELSE {moved} END)")


def samples(df: DataFrame, keys: list[str], terms: str, n: int = SAMPLES) -> DataFrame:
    """``keys`` and ``samples`` (array<long>): the samples of the weighted terms of each key; NULL without any term.

    They are plain aggregates of numbers, partial before any exchange, so no term is moved.
    """
    each = df.select(*keys, F.explode_outer(terms).alias("_t")).select(*keys, "_t.term", "_t.weight")
    each = each.withColumn("heavy", F.when(F.col("weight") > 1, _heavy(n)))
    least = each.groupBy(*keys).agg(*[F.expr(f"max(coalesce(heavy[{j}], {_plain(j)}))").alias(f"_s{j}") for j in range(n)],
                                    F.max("term").alias("_any"))
    signed = F.array(*[F.xxhash64(f"_s{j}").bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(n)])
    return least.select(*keys, F.when(F.col("_any").isNotNull(), signed).alias("samples"))


def as_text(signed: Column) -> Column:
    """A fingerprint as eight hexadecimal digits per sample; empty for a text without words."""
    digits = F.transform(signed, lambda x: F.lower(F.lpad(F.hex(x), 8, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples, which estimates the generalised Jaccard similarity of the weighted terms. Two texts
    without words are alike (1), one without and one with words are not (0)."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).otherwise(F.coalesce(equal.cast("double"), F.lit(0.0)))


def fingerprint(docs: DataFrame, text: str = "text", n: int = SAMPLES) -> DataFrame:
    """``docs`` with a column ``fingerprint``; equal texts have equal ones.

    NULL, empty and wordless texts have the empty fingerprint. Each row is fingerprinted, also repeated ones and
    those with a NULL doc_id; input columns keep their names, but one named ``fingerprint`` is replaced.
    """
    prepared(docs.sparkSession)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_n"),
                      weighted_terms(F.col(f"`{text}`")).alias("_terms"))
    found = samples(row, ["_n", "_row"], "_terms", n)
    return attach(found.select("_row.*", "samples"), {"fingerprint": as_text(F.col("samples"))}).drop(
        *([] if "samples" in docs.columns else ["samples"]))


def _ranges(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (key, mark, ...) with the number of their range of keys, in ascending order; about equal counts per range.

    The bounds are quantiles of the keys. A key that is several of them is split by mark (31 bits of a hash).
    """
    at = rows.agg(F.percentile_approx("key", F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n)).first()[0] if n > 1 else None
    bounds = sorted(at or [])
    step = max(int(len(bounds) ** 0.5), 1)
    coarse = [bounds[i] for i in range(step - 1, len(bounds), step)]
    many = lambda values: F.expr("cast(array() as array<long>)") if not values else F.expr(f"array({', '.join(f'{v}L' if v != FIRST_ID else 'cast(-9223372036854775808BD as long)' for v in values)})")
    key = F.col("key")
    below = let(F.size(F.filter(many(coarse), lambda x: x < key)) * step, lambda skip: skip + F.size(
        F.filter(F.slice(many(bounds), skip + 1, step), lambda x: x < key)))
    hot = sorted({b for b in bounds if bounds.count(b) > 1}) if len(set(bounds)) < len(bounds) else []
    share = F.lit(0)
    for b in hot:
        share = F.when(key == F.lit(b), F.floor(F.col("mark") / F.lit(2.0 ** 31) * (bounds.count(b) + 1)).cast("int")).otherwise(share)
    return rows.withColumn("range", below + share)


def with_next_text(docs: DataFrame) -> DataFrame:
    """range, at, doc_id, text, next_text, own: every document beside the one that follows it.

    Documents are ordered by doc_id (NULL first, ties by a hash of the text, then the text); the last is followed by the first. NULL
    texts are empty. Documents are dealt once, by ranges of doc_id; the first of each range also goes, with
    ``own`` false, to the end of the range before, so no window spans the table.
    """
    spark = prepared(docs.sparkSession)
    light = slim(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = light.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("key"),
                        F.shiftrightunsigned(F.xxhash64("text"), 33).alias("mark"), "doc_id", "text")
    rows = _ranges(rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    least = rows.groupBy("range").agg(F.min("key").alias("least"))
    line = Window.orderBy("range")  # one line per range
    before = F.coalesce(F.lag("range").over(line), F.max("range").over(Window.partitionBy()))
    least = F.broadcast(least.select("least", F.col("range").alias("own_range"), before.alias("before")))
    edge = rows.join(least, (F.col("key") == F.col("least")) & (F.col("range") == F.col("own_range")))
    edge = edge.groupBy("before").agg(F.min(F.struct("key", "mark", "text", "doc_id")).alias("first"))
    edge = edge.select(F.col("first.key"), F.col("first.mark"), F.col("first.doc_id"), F.col("first.text"),
                       F.col("before").alias("range"), F.lit(False).alias("own"))
    both = rows.withColumn("own", F.lit(True)).unionByName(edge)
    order = Window.partitionBy("range").orderBy(F.desc("own"), "key", "mark", "text")
    return both.select("range", F.row_number().over(order).alias("at"), "doc_id", "text",
                       F.lead("text").over(order).alias("next_text"), "own")


def edited(text: Column, other: Column) -> Column:
    """``text`` whose last half is replaced by the beginning of ``other``, as long or all of it."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one line per row.

    Each text is fingerprinted beside an edited copy of itself and compared with that and with the next document,
    see ``with_next_text`` for order, ties and NULLs. A table of one row is followed by itself; an empty one gives
    no line. A text is worked on in one task row, so a task needs memory in proportion to its longest text.
    """
    pairs = with_next_text(docs).withColumn("other", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                    F.struct(F.lit(1).alias("kind"), F.col("other").alias("body")))
    pairs = pairs.select("range", "at", "doc_id", "own", F.char_length("text").cast("long").alias("n_chars"),
                         F.sha2(F.encode("other", "UTF-8"), 256).alias("edited_sha256"), F.explode(kinds).alias("_k"))
    pairs = pairs.where("own OR _k.kind = 0").withColumn("kind", F.col("_k.kind")).withColumn("terms", weighted_terms(F.col("_k.body")))
    keys = ["range", "at", "kind", "doc_id", "own", "n_chars", "edited_sha256"]
    found = samples(pairs, keys, "terms")  # range is the key of the exchange above, so nothing is moved
    order = Window.partitionBy("range").orderBy("at", "kind")
    mine, copy, following = F.col("samples"), F.lead("samples", 1).over(order), F.lead("samples", 2).over(order)
    found = found.select("*", copy.alias("copy"), following.alias("following")).where("own AND kind = 0")
    return found.select("doc_id", "n_chars", "edited_sha256", as_text(mine).alias("fingerprint"),
                        as_text(F.col("copy")).alias("edited_fingerprint"), likeness(mine, F.col("copy")).alias("near_edited"),
                        likeness(mine, F.col("following")).alias("near_next"))

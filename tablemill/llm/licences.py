"""Licence scan: TF-IDF cosine of statements to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.llm.base import attach, prepared
from tablemill.llm.licence_table import must, templates, terms
from tablemill.operators.joins import small_side
from tablemill.session import checkpointed, materialised

#: Least cosine of a statement that counts.
LEAST = 0.7
#: A file of which at least one word in so many stands in its best statement is a licence file, whatever its name.
SHARE = 4
TERM = r"[\p{L}\p{N}]+"
FILE_NAME = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)[^/]*$"
#: Line ends and full stops end a statement; in a block, from one line without a term to the next, line ends do not.
LINE_STOP, BLOCK_STOP, BLANK = r"([.!?])[ \t]+", r"([.!?])[ \t\n]+", r"\n[^\p{L}\p{N}]*\n"


def vocabulary() -> list[str]:
    return sorted({w for _, s in templates() for w in terms(s)})


def sql(pattern: str) -> str:
    """A pattern inside an SQL string."""
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def lowered(text_col: str):
    return F.lower(F.coalesce(quoted(text_col), F.lit("")))


def term_frequencies(files: DataFrame, text_col: str) -> DataFrame:
    """(term, n): in how many files each term stands. It stays in Spark."""
    found = F.regexp_extract_all(lowered(text_col), F.lit(TERM), F.lit(0))
    return files.select(F.explode(F.array_distinct(found)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def rarity(found: int, files: int) -> float:
    """idf of a term that stands in ``found`` of ``files``."""
    return math.log((1 + files) / (1 + found)) + 1


def template_rows(idf: dict[str, float]) -> list[tuple[int, str, str | None, str, float]]:
    """(template, licence, name it must hold, term, weight) with templates of length 1."""
    out = []
    for k, (licence, statement) in enumerate(templates()):
        weights = {w: n * idf[w] for w, n in sorted(Counter(terms(statement)).items())}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        out += [(k, licence, must(statement), w, v / norm) for w, v in weights.items()]
    return out


def cue_terms(idf: dict[str, float], least: float = LEAST) -> list[str]:
    """Terms of which every statement with the least cosine holds one: a name that a template asks for, else so
    many of its terms that what they leave is too short a part of its length. The rarest terms are taken first."""
    every = [s for _, s in templates()]
    cues = {must(s) for s in every} - {None}
    for statement in every:
        if must(statement):
            continue
        squares = {w: (k * idf[w]) ** 2 for w, k in Counter(terms(statement)).items()}
        left, whole = sum(v for w, v in squares.items() if w not in cues), sum(squares.values())
        for w in sorted(squares, key=lambda w: (-idf[w], -len(w), w)):
            if left < 0.99 * least * least * whole:
                break
            if w not in cues:
                cues.add(w)
                left -= squares[w]
    return sorted(cues)


def candidates(files: DataFrame, text_col: str, idf: dict[str, float], least: float = LEAST) -> DataFrame:
    """(key, words), each once: statements that could reach the least cosine, under the md5 of their text.

    A text is cut at line ends and full stops, and, so that wrapped notices are whole, also at full stops alone
    inside blocks without an empty line (lines of comment marks are empty). A statement needs a cue term. With s
    as the sum of squared idf over its template terms, m as the most often one may be repeated and d other words,
    none weighing less than 1, the squared cosine is at most s * m / (s * m + d).
    """
    cues = cue_terms(idf, least)
    text = lowered(text_col)
    short = [c for c in cues if not any(o != c and o in c for o in cues)]
    maybe = F.lit(False)
    for c in short:  # a cheap look over the bytes before any cutting
        maybe = maybe | text.contains(c)
    lines = F.split(F.regexp_replace(text, LINE_STOP, "$1\n"), "\n")
    blocks = F.split(F.regexp_replace(F.regexp_replace(text, BLANK, "\x01"), BLOCK_STOP, "$1\x01"), "\x01")
    known = "map(" + ", ".join(f"'{w}', {v * v!r}D" for w, v in sorted(idf.items())) + ")"
    listed = "array(" + ", ".join(f"'{c}'" for c in cues) + ")"
    square = least * least * 0.999
    words = f"transform(units, u -> regexp_extract_all(u, '{sql(TERM)}', 0))"
    cued = f"filter({words}, w -> arrays_overlap(w, {listed}))"
    room = (f"filter({cued}, w -> transform(array(filter(transform(w, x -> {known}[x]), v -> v IS NOT NULL)), v -> "
            f"aggregate(v, 0D, (s, x) -> s + x) * (1 + size(w) - size(array_distinct(w))) * {1 - square!r} >= "
            f"(size(w) - size(v)) * {square!r})[0])")
    cut = files.where(maybe).select(F.md5(F.coalesce(quoted(text_col), F.lit(""))).alias("key"),
                                    F.array_distinct(F.concat(lines, blocks)).alias("units"))
    each = F.explode(F.array_distinct(F.expr(f"transform({room}, w -> array_join(w, ' '))")))
    return cut.select("key", each.alias("words")).distinct()


def best_statements(found: DataFrame, frequencies: DataFrame, n_files: int, idf: dict[str, float], least: float = LEAST) -> DataFrame:
    """(words, best) for the statements that reach the least cosine with a template whose name they hold.

    ``best`` is struct(minus the cosine, minus the words, licence); of equal cosines the longer statement counts,
    then the first name. Each different statement is compared once, however many texts hold it.
    """
    spark = found.sparkSession
    tf = found.select("words").distinct().select("words", F.explode(F.split("words", " ")).alias("term")).groupBy(
        "words", "term").agg(F.count(F.lit(1)).alias("tf"))
    tf = materialised(tf, "statement_terms")
    needed = frequencies.join(small_side(tf.select("term").distinct()), "term", "left_semi")
    idf_of = F.log(F.lit(1.0 + n_files) / (1 + F.col("n"))) + 1
    weighed = materialised(tf.join(small_side(needed), "term").withColumn("x", F.col("tf") * idf_of), "statement_weights")
    rows = spark.createDataFrame(template_rows(idf), "template int, licence string, must string, term string, v double")
    named = F.max((F.col("term") == F.col("must")) | F.col("must").isNull())
    dots = weighed.join(F.broadcast(rows), "term").groupBy("words", "template", "licence").agg(
        F.sum(F.col("x") * F.col("v")).alias("dot"), named.alias("named")).where("named")
    norms = weighed.groupBy("words").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.sum("tf").cast("int").alias("size"))
    minus = -F.round(F.col("dot") / F.col("norm"), 6)
    scored = dots.join(norms, "words").select("words", F.struct(minus.alias("minus"), (-F.col("size")).alias("less"), "licence").alias("best"))
    return scored.where(F.col("best.minus") <= -least).groupBy("words").agg(F.min("best").alias("best"))


def verdicts(files: DataFrame, text_col: str) -> DataFrame:
    """(key, best) for the md5 of each text with a licence of its own."""
    frequencies = materialised(term_frequencies(files, text_col), "term_frequencies")
    n = files.count()
    words = vocabulary()
    counted = dict(frequencies.where(F.col("term").isin(words)).collect())  # one line per template term
    idf = {w: rarity(counted.get(w, 0), n) for w in words}
    found = materialised(candidates(files, text_col, idf), "statements")
    best = best_statements(found, frequencies, n, idf)
    return found.join(small_side(best), "words").groupBy("key").agg(F.min("best").alias("best"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``files`` with licence, score, found ('own', 'inherited' or NULL) and from_dir.

    A file's own licence is that of its best statement, wherever in its text it stands; equal cosines go to the
    longer statement, then to the first name. The weight of a term is its count times its idf over all files. A licence file (by name, or because the statement is a quarter of its words or more) speaks for
    its directory; several of one directory are settled by the best cosine, then the first name. A file
    without a licence of its own takes that of the nearest directory at or above its own that has one.

    NULL and empty texts have no licence of their own; a file with a NULL path inherits nothing. Repeated rows
    are judged alike. Columns of the result's names are replaced. Each directory is resolved once and joined
    to its files, so a directory with very many files is no hot spot.
    """
    prepared(files.sparkSession)
    judged = verdicts(files, text_col).select(F.col("key").alias("__llm_key"), F.col("best").alias("__llm_best"))
    size = F.size(F.regexp_extract_all(lowered(text_col), F.lit(TERM), F.lit(0)))
    own = F.col("__llm_best")
    marked = attach(files, {"__llm_key": F.md5(F.coalesce(quoted(text_col), F.lit("")))})
    marked = marked.join(small_side(judged), "__llm_key", "left").drop("__llm_key")
    marked = attach(marked, {"__llm_dir": F.regexp_extract(quoted(path_col), r"^(.*)/[^/]*$", 1)})
    speaks = F.when(own.isNotNull(), F.coalesce(quoted(path_col).rlike(FILE_NAME), F.lit(False)) | (-SHARE * own["less"] >= size)
                    ).otherwise(False)
    marked = attach(marked, {"__llm_speaks": speaks})
    keys = marked.select("__llm_dir", "__llm_speaks", "__llm_best")
    keys = materialised(keys.where("__llm_dir IS NOT NULL").groupBy("__llm_dir").agg(
        F.min(F.when(F.col("__llm_speaks"), F.struct(own["minus"], own["licence"]))).alias("said")), "directories")
    said = checkpointed(keys.where("said IS NOT NULL").select(F.col("__llm_dir").alias("above"), "said"))
    steps = F.split("__llm_dir", "/")
    level = F.explode(F.sequence(F.lit(1), F.size(steps))).alias("level")
    chain = keys.select("__llm_dir", level).withColumn("above", F.array_join(F.slice(steps, F.lit(1), F.col("level")), "/"))
    nearest = chain.join(small_side(said, True), "above").groupBy("__llm_dir").agg(
        F.max(F.struct("level", "above", "said")).alias("__llm_near"))
    out = marked.join(small_side(nearest), "__llm_dir", "left")
    near = F.col("__llm_near")
    none = own.isNull()
    return attach(out, {
        "licence": F.when(none, near["said"]["licence"]).otherwise(own["licence"]),
        "score": -F.when(none, near["said"]["minus"]).otherwise(own["minus"]),
        "found": F.when(~none, "own").when(near.isNotNull(), "inherited"),
        "from_dir": F.when(none, near["above"]),
    }).drop("__llm_best", "__llm_dir", "__llm_speaks", "__llm_near")


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path and text. The documents table has no paths; they are laid out by source, language and block of
    100 ids, every tenth document one directory higher and every hundredth two."""
    i = F.coalesce(F.col("doc_id"), F.lit(-1))
    name = lambda c: F.coalesce(F.regexp_replace(F.col(c), "/", "_"), F.lit("none"))
    parts = F.concat_ws("/", F.lit("corpus"), name("source"),
                        F.when(i % 100 != 0, name("lang")), F.when(i % 10 != 0, F.floor(i / 100).cast("string")),
                        F.concat(i.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", parts.alias("path"), "text")

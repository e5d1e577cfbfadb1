"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablemill.functions.numbers import quoted
from tablemill.llm.base import WORD, attach, let

#: Very common words of English, German, French and Spanish.
STOP_WORDS = ("the of and to in is that it for on as with by are this be from or an "
              "der die und das den von zu mit ist nicht ein eine im "
              "le la les de des et en un une que qui dans pour par "
              "el los las y del se con su al es").split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``over / per`` must lie in [least, most]; a missing bound does not bind. An empty ``per`` stands for 1."""

    name: str
    over: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


RULES = [
    Rule("length", "n_words", least=20),
    Rule("word_length", "word_chars", "n_words", least=2, most=24),
    Rule("symbols", "n_symbols", "word_chars", most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", least=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
]


def _covered(hashes: Column, words: Column) -> Column:
    """Words in 8-word windows whose hash occurs twice or more; equal hashes are confirmed on the words."""
    same = lambda a, b: (a["h"] == b["h"]) & (F.slice(words, a["i"], WINDOW) == F.slice(words, b["i"], WINDOW))
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))

    def marked(rows: Column) -> Column:
        twin = lambda x, j: F.coalesce(same(x, F.get(rows, j + 1)), F.lit(False)) | (
            F.when(j > 0, F.coalesce(same(x, F.get(rows, j - 1)), F.lit(False))).otherwise(False))
        return F.array_sort(F.transform(F.filter(rows, twin), lambda x: x["i"]))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end"))
    return F.aggregate(let(ordered, marked), start, step, lambda a: a["n"])


def repeat_words(words: Column) -> Column:
    """Words of the row that stand in an 8-word window found twice or more in it, the first one included."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, words)).otherwise(0)
    return F.when(F.size(words) > WINDOW, let(windows, some)).otherwise(0)


def measures(text: Column) -> Column:
    """All counts of a text as one struct of longs; NULL counts as an empty text."""
    whole = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
        stops = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
        return let(lines, lambda ls: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(stops).cast("long").alias("n_stop_words"),
            F.size(ls).cast("long").alias("n_lines")))

    return let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), of_words)


def passes(m: Column, rules: list[Rule]) -> Column:
    """One boolean of all rules, as products instead of quotients, so that nothing is divided by zero."""
    out = F.lit(True)
    for r in rules:
        over, per = m[r.over], m[r.per] if r.per else F.lit(1)
        if r.least is not None:
            out = out & (over >= per * F.lit(float(r.least)))
        if r.most is not None:
            out = out & (over <= per * F.lit(float(r.most)))
    return out


def apply_rules(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Add the counts, ``base_failed`` and ``kept`` to every row, in one projection without a shuffle.

    A NULL or empty text has no words and fails the base rule. Rows are judged one by one, so repeated
    rows, ties and an empty table need no care; an input column named like a result is replaced. Very
    long texts are sorted only if an 8-word window repeats in them.
    """
    m = F.col("__llm_measures")
    words = m["n_words"]
    failed = (words < 20) | (100 * m["n_repeat_words"] > 30 * words)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = attach(df, {"__llm_measures": measures(quoted(text_col))})
    out = attach(out, {n: m[n] for n in names} | {
        "base_failed": failed, "kept": ~failed & passes(m, RULES if rules is None else rules)})
    return out.drop("__llm_measures")

"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SERVING_FORMAT = r"^\d+(?:\.\d+)?\s*[a-zA-Z]+$"

# Frequent function words per language, used to tell languages apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit ein eine den von zu auf für im sich des dem auch als".split(),
    "en": "the and of to in is that it for was with as on be at by this are from or".split(),
    "es": "el la los las de que y en un una por con para del se no es al lo su".split(),
    "fr": "le la les de des et un une du dans est que pour qui sur pas au avec il ce".split(),
    "it": "il lo gli di che e un una per con non del della sono è nel alla le si da".split(),
    "nl": "de het een en van is dat op te in voor met niet zijn er aan ook als bij door".split(),
    "pt": "o a os as de que e do da em um uma para com não por mais dos se na".split(),
}


def clean_text(c: Column) -> Column:
    """Lower case, punctuation to blanks, single blanks, trimmed. Keeps accented letters."""
    words_only = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(words_only, r"\s+", " "))


def matches_serving_format(c: Column) -> Column:
    return c.rlike(SERVING_FORMAT)


def comma_items(c: Column) -> Column:
    """Number of comma separated items."""
    return F.regexp_count(c, F.lit(",")) + 1


def short_hash(c: Column) -> Column:
    """First eight hex digits of the md5 digest."""
    return F.substring(F.md5(c.cast("string")), 1, 8)


def function_words(c: Column) -> Column:
    """The words of the whole text that are a function word of some language."""
    known = sorted({w for vocab in FUNCTION_WORDS.values() for w in vocab})
    return F.filter(F.split(clean_text(c), " "), lambda w: w.isin(known))


def language_of(words: Column) -> Column:
    """Language that most of the given function words belong to.

    ``unknown`` for NULL or when there is none; ties go to the alphabetically first language.
    """

    def hits(vocab: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(vocab)))

    ranked = [F.struct(hits(vocab).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
              for i, (lang, vocab) in enumerate(FUNCTION_WORDS.items())]
    best = F.greatest(*ranked)
    return F.when(best["n"] > 0, best["lang"]).otherwise(F.lit("unknown"))


def stratum_key(cols: list[Column], missing: str = "nan") -> Column:
    """Values joined with dashes, missing ones written out."""
    return F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(missing)) for c in cols])

"""Spelling variants: words one edit apart, found by composing acceptors of the vocabulary with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablemill.llm.base import prepared, slim
from tablemill.operators.joins import small_side
from tablemill.session import materialised

#: Letters of a run (fixed by the contract), and the words that are looked at.
LETTERS = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many loses a letter, picked by its hash.
DAMAGE = 97
#: A group of more words is split by the place of the edit before an acceptor is built.
GROUP_WORDS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the letter runs of all texts, lower-cased in A-Z, some without one letter, that are long and frequent enough.

    NULL texts have no words; a NULL doc_id counts as an empty one. Counts are partial before the exchange.
    """
    light = slim(docs, doc_id="doc_id", text="text")
    runs = light.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), 1)).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run")).where(F.char_length("run") >= LEAST_LENGTH)
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"), "UTF-8"))
    runs = runs.withColumn("h", h)
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % DAMAGE == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """A minimal acyclic automaton, built from sorted words; states are shared by all languages added to it.

    ``edges`` of a state lead to states by letter, in order, and ``sizes`` count the words accepted from it, so a
    path also numbers the word it spells among the sorted words of its language.
    """

    def __init__(self):
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.sizes: list[int] = []
        self.known: dict[tuple, int] = {}
        self.apart: set[tuple[int, int]] = set()

    def _state(self, edges: dict[str, int], final: bool) -> int:
        key = (final, *edges.items())
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(final)
            self.sizes.append(final + sum(self.sizes[s] for s in edges.values()))
        return found

    def language(self, words: list[str]) -> int:
        """The initial state of the sorted different words; equal ends of the words become the same states."""
        open_, finals, letters, last = [{}], [False], [], ""

        def close(depth: int) -> None:
            while len(letters) > depth:
                state = self._state(open_.pop(), finals.pop())
                open_[-1][letters.pop()] = state

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same)
            for letter in word[same:]:
                letters.append(letter)
                open_.append({})
                finals.append(False)
            finals[-1] = True
            last = word
        close(0)
        return self._state(open_[0], finals[0])

    def _leads(self, state: int, first: int) -> list[tuple[str, int, int]]:
        """(letter, next state, number of its first word) of a state whose first word has number ``first``."""
        out, at = [], first + self.final[state]
        for letter, to in self.edges[state].items():
            out.append((letter, to, at))
            at += self.sizes[to]
        return out

    def _common(self, p: int, i: int, q: int, j: int, without: str = "") -> Iterator[tuple[int, int]]:
        """Numbers of the words that are accepted from both states; not those that begin with ``without``."""
        if not without and (p, q) in self.apart:
            return
        todo, none = [(p, i, q, j, without)], True
        while todo:
            a, i, b, j, skip = todo.pop()
            if a == b and not skip:
                none = False
                yield from ((i + k, j + k) for k in range(self.sizes[a]))
                continue
            if self.final[a] and self.final[b]:
                none = False
                yield i, j
            if self.edges[a] and self.edges[b]:
                other = {letter: (to, at) for letter, to, at in self._leads(b, j)}
                todo += [(to, at, *other[letter], "") for letter, to, at in self._leads(a, i) if letter in other and letter != skip]
        if none and not without:
            self.apart.add((p, q))

    def one_edit_pairs(self, start: int, reach: int) -> Iterator[tuple[int, int]]:
        """Numbers of all pairs of words accepted from ``start`` that the one-edit transducer relates.

        The composition (acceptor, transducer, acceptor) walks equal letters in its first state; from there an edit,
        after fewer than ``reach`` letters, leads to its second state, in which both sides must spell the same.
        The edit is placed where the two words first differ, so each pair is accepted on one path.
        """
        todo = [(start, 0, 0)]
        while todo:
            state, first, depth = todo.pop()
            leads = self._leads(state, first)
            for k, (letter, to, at) in enumerate(leads):
                for _, other, there in leads[k + 1:]:
                    yield from self._common(to, at, other, there)  # replaced
                yield from self._common(to, at, state, first, letter)  # inserted
                if depth + 1 < reach and self.sizes[to] > 1:
                    todo.append((to, at, depth + 1))


def _halves(groups: DataFrame) -> DataFrame:
    """Split groups (m, low, high, tail): pairs that first differ at place low or later, but before high.

    Such words agree in ``low`` letters at the front and in ``tail`` at the end. Pairs that differ from the middle on
    agree in more letters in front, and pairs that differ before it agree in all letters after it, since only
    one edit is there; either is the key of a smaller group.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    late = F.struct(middle.alias("low"), F.col("high"), F.col("tail"))
    early = F.struct(F.col("low"), middle.alias("high"), F.greatest(F.col("tail"), F.col("m") - middle).alias("tail"))
    return groups.withColumn("_half", F.explode(F.array(late, early))).select("word", "n", "m", "_half.*")


def _composed(limit: int):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["a", "a_n", "b", "b_n", "m", "low", "high", "tail"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("a_n", "b_n", "m", "low", "high", "tail")})

        def pairs(acceptor: Acceptor, group: list[tuple], m: int, low: int, high: int, tail: int) -> Iterator[tuple]:
            if len(group) < 2:
                return
            cut = sorted((word[low:len(word) - tail], word, n) for word, n in group)
            for i, j in acceptor.one_edit_pairs(acceptor.language([c[0] for c in cut]), high - low):
                (_, a, n), (_, b, k) = cut[i], cut[j]
                if min(len(a), len(b)) == m:
                    yield a, n, b, k, None, None, None, None

        group, place, large, acceptor, out = [], None, False, Acceptor(), []
        for pdf in batches:
            for word, n, m, low, high, tail, key in pdf[["word", "n", "m", "low", "high", "tail", "key"]].itertuples(index=False, name=None):
                here = (key, m, low, high, tail)
                if here != place:
                    if place and not large:
                        out += pairs(acceptor, group, *place[1:])
                    group, place, large = [], here, False
                    if len(acceptor.edges) > 50 * limit:
                        acceptor = Acceptor()
                group.append((word, n))
                if large or (len(group) > limit and high - low > 1):  # handed on to be split, a part at a time
                    large = True
                    out += [(w, k, None, None, m, low, high, tail) for w, k in group]
                    group = []
                if len(out) > 20_000:
                    yield frame(out)
                    out = []
        if place and not large:
            out += pairs(acceptor, group, *place[1:])
        if out:
            yield frame(out)

    return each


def near_words(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """a, a_n, b, b_n: each pair of different words (word, n) that one inserted, deleted or replaced letter relates, once.

    Pairs whose shorter word has m letters meet in groups of words that agree before and after the place of the
    edit, see ``_halves``. All groups of a task share one acceptor, each from an initial state of its own. A group of more than
    ``limit`` words is split again; at a single place at most two letters are open, so every group becomes small.
    Words must be different and not NULL; an empty table has no pairs.
    """
    prepared(words.sparkSession)
    length = F.char_length("word")
    groups = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= 1)
    groups = groups.select("word", "n", "m", F.lit(0).alias("low"), (F.col("m") + 1).alias("high"), F.lit(0).alias("tail"))
    found = None
    while True:
        groups = _halves(groups)
        key = F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("|"),
                       F.substring("word", F.char_length("word") - F.col("tail") + 1, F.col("tail")))
        columns = ["key", "m", "low", "high", "tail"]
        dealt = groups.withColumn("key", key).repartition("key", "m").sortWithinPartitions(*columns)
        done = materialised(dealt.mapInPandas(_composed(limit), "a string, a_n long, b string, b_n long, m int, low int, high int, tail int"), "near")
        pairs = done.where("b IS NOT NULL").select("a", "a_n", "b", "b_n")
        found = pairs if found is None else found.unionByName(pairs)
        groups = done.where("b IS NULL").select(F.col("a").alias("word"), F.col("a_n").alias("n"), "m", "low", "high", "tail")
        if groups.isEmpty():
            return found


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, form) end; each step doubles the way that is known."""
    table = materialised(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = small_side(table.select(F.col("word").alias("_at"), F.col("root").alias("_next")), ready=True)
        joined = materialised(table.join(ahead, F.col("root") == F.col("_at"), "left"), "roots")
        if joined.where("_at IS NOT NULL").isEmpty():
            return table
        table = joined.select("word", F.coalesce("_next", "root").alias("root"))


def _best(n: Column, word: Column) -> Column:
    return F.min(F.struct((-n).alias("n"), word.alias("word")))


def variants(words: DataFrame) -> DataFrame:
    """word, n, form, form_n, root, n_near for a table (word, n) of different words.

    The form of a word is its near word of largest n (ties: the first in code-point order) if that is at least
    twice its own n, else NULL; root follows the forms to the last. n at least doubles with each form, so there are no
    circles. Counts and choices per word are partial before the exchange.
    """
    words = materialised(words, "words")
    near = near_words(words)
    both = near.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        near.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), _best(F.col("near_n"), F.col("near")).alias("best"))
    joined = words.join(best, "word", "left")
    strong = -F.col("best.n") >= 2 * F.col("n")
    out = materialised(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(strong, F.col("best.word")).alias("form"),
                                     F.when(strong, -F.col("best.n")).cast("long").alias("form_n")), "forms")
    ends = roots(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among all words of ``docs``; see ``vocabulary`` and ``variants``. No words, no rows."""
    prepared(docs.sparkSession)
    return variants(vocabulary(docs))

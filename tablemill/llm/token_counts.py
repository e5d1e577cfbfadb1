"""Token counts of whole texts: long ones in overlapping chunks that are spliced where both sides agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablemill.llm.base import GROUP_BYTES, prepared, slim, text_groups
from tablemill.llm.encode import tokenizer_path
from tablemill.operators.joins import small_side
from tablemill.session import checkpointed, materialised

#: Characters from which a text is cut, of a chunk, and by which neighbours first overlap.
LONG, CHUNK, OVERLAP = 16_384, 16_384, 256
LIMIT = 4096
BLANK = "▁"


class PieceEncoder:
    """Counts and token places by the sentencepiece library.

    ``splits`` tells whether a blank can only begin a piece or follow blanks in it: then no merge ever reaches
    over the place between another character and a blank, whatever stands around it, and such a place is a
    stable boundary. It is read off the vocabulary. The normalizer must leave texts as they are.
    """

    def __init__(self, name: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        vocabulary = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.splits = all(BLANK not in p.lstrip(BLANK) for p in vocabulary)
        control = [self.library.is_control(i) or self.library.is_unknown(i) for i in range(len(vocabulary))]
        self.width = np.array([1 if self.library.is_byte(i) else len(p.replace(BLANK, " ").encode())
                               for i, p in enumerate(vocabulary)])
        self.width[control] = 0

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets in the text where its tokens end; the blank that the library puts before it has none."""
        ids = np.array(self.library.encode(text, num_threads=1), np.int64)
        return np.cumsum(self.width[ids]) - 1


_encoders: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    if name not in _encoders:
        _encoders[name] = PieceEncoder(name)
    return _encoders[name]


def _short_counts(name: str):
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(name)
        for texts in batches:
            out = []
            for pdf in text_groups([pd.DataFrame({"text": texts})]):
                out += own.count(pdf["text"].tolist())
            yield pd.Series(out, dtype="int64")

    return F.pandas_udf(count, "long")


def stable_cut(text: str, low: int, high: int) -> int:
    """Byte offset of the last place in characters low to high where a blank follows another character, or -1."""
    for at in range(min(high, len(text)) - 1, max(low, 1) - 1, -1):
        if text[at] == " " and text[at - 1] != " ":
            return len(text[:at].encode("utf-8", "surrogatepass"))
    return -1


def _chunk_counts(name: str):
    """Tokens of a chunk between its two cuts, or NULL where an overlap has no agreed stable boundary.

    Both neighbours look for the boundary in their common characters by the same rule, so they choose the same
    one, and each checks that one of its tokens ends there.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(name)
        for pdf in batches:
            found = []
            for text, left, right in zip(pdf["text"], pdf["left"], pdf["right"]):
                first = stable_cut(text, 0, left) if left else 0
                last = stable_cut(text, len(text) - right + 1, len(text)) if right else None
                if ((left or right) and not own.splits) or first == -1 or last == -1:
                    found.append(None)
                    continue
                ends = own.ends(text)
                agreed = all(ends[min(np.searchsorted(ends, c), len(ends) - 1)] == c for c in (first, last) if c)
                upto = len(ends) if last is None else np.searchsorted(ends, last, "right")
                before = np.searchsorted(ends, first, "right") if first else 0
                found.append(int(upto - before) if agreed else None)
            yield pd.DataFrame({"key": pdf["key"], "chunk": pdf["chunk"], "tokens": pd.array(found, "Int64")})

    return each


def _chunks(size: int, overlap: int):
    """Rows (key, chunk, left, right, text): chunks of ``size`` characters, each with ``overlap`` more of the next.

    ``left`` and ``right`` are the characters that a chunk has in common with its neighbours. A text is walked
    through once, and its chunks leave the task a few at a time.
    """
    names = ["key", "chunk", "left", "right", "text"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"]):
                n = len(text)
                for chunk, begin in enumerate(range(0, n, size)):
                    stop = min(begin + size, n)
                    right = min(overlap, n - stop)
                    out.append((key, chunk, min(overlap, n - begin) if chunk else 0, right, text[begin:stop + right]))
                    held += stop + right - begin
                    if held > GROUP_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return each


def count_tokens(docs: DataFrame, name: str = "piece_bpe_32k.model", long: int = LONG, chunk: int = CHUNK,
                 overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document, as the library counts its whole text.

    Texts up to ``long`` characters are encoded as they are, in the scan. A longer one is cut into chunks that
    reach ``overlap`` characters over each cut, the chunks are dealt over all tasks and encoded, and
    neighbours are spliced at a boundary in their common characters that is proven stable and that both
    encodings hold. Where one has no such boundary, the text is cut again with chunks and overlaps four times
    as long, until it fits one chunk, which needs no boundary; a long text without a count is an error. NULL and empty texts have no tokens; repeated rows each keep a row.
    """
    prepared(docs.sparkSession)
    light = slim(docs, doc_id="doc_id", text="text").withColumn("text", F.coalesce("text", F.lit("")))
    n = F.char_length("text")
    size = F.octet_length("text").cast("long").alias("n_bytes")
    short = light.where(n <= long).select("doc_id", size, _short_counts(name)("text").alias("n_tokens"))
    print_ = F.struct(F.xxhash64("text"), F.xxhash64(F.reverse("text")), F.octet_length("text"))
    whole = light.where(n > long).select("doc_id", size, print_.alias("key"), "text")
    # texts that are the same are counted once
    rest = whole.select("key", "text").dropDuplicates(["key"])
    rest = materialised(rest, "long-texts")
    longest = rest.agg(F.max(F.char_length("text"))).first()[0] or 0
    counted, width, reach = [], chunk, overlap
    kind = light.select(print_.alias("key")).schema["key"].dataType.simpleString()
    while longest:
        parts = rest.mapInPandas(_chunks(width, reach), f"key {kind}, chunk long, left int, right int, text string")
        dealt = parts.repartition(F.xxhash64("key", "chunk"))
        found = checkpointed(dealt.mapInPandas(_chunk_counts(name), f"key {kind}, chunk long, tokens long"))
        total = found.groupBy("key").agg(F.sum("tokens").alias("n_tokens"), F.count(F.when(F.col("tokens").isNull(), 1)).alias("failed"))
        total = checkpointed(total)
        counted.append(total.where("failed = 0").select("key", "n_tokens"))
        failed = total.where("failed > 0").select("key")
        if width >= longest or not failed.head(1):
            break
        rest = materialised(rest.join(small_side(failed, True), "key", "left_semi"), "long-texts")
        width, reach = 4 * width, 4 * reach
    if not counted:
        return short
    table = counted[0]
    for more in counted[1:]:
        table = table.unionByName(more)
    counted = whole.drop("text").join(small_side(table), "key", "left")
    known = F.coalesce("n_tokens", F.raise_error(F.lit("a long text has no count")).cast("long"))
    return short.unionByName(counted.select("doc_id", "n_bytes", known.alias("n_tokens")))

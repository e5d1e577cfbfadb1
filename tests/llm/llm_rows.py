"""Rows that the tests of the corpus operators share."""

import random

CLASH = ["size", "text_crc32", "law", "shard", "slot", "n_words", "kept", "base_failed", "score", "predicted", "node",
         "print", "part", "rows", "path", "licence", "found", "class_id", "first", "start", "length", "ids", "tokens",
         "spans", "items", "key", "label", "group", "word", "value", "count", "_id", "id"]
LEXICON = [a + b for a in ("the", "of", "ham", "ber", "sil", "tor", "vex", "wun") for b in ("", "en", "ly", "ish", "or")]


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(LEXICON) for _ in range(n)]


def prose(seed, n):
    """n invented words in sentences and lines."""
    r, out = random.Random(f"p{seed}"), []
    for k, w in enumerate(words(seed, n)):
        out.append(w + (".\n" if r.random() < .03 else ". " if r.random() < .1 else " "))
    return "".join(out).strip()


def sample():
    """(doc_id, text): nulls, empty texts, one very long text, copies, near copies, shared passages, repeated rows."""
    rows = [(i, prose(i, 30 + 7 * i)) for i in range(24)]
    passage = " ".join(words("passage", 60))
    rows += [(30, rows[3][1]), (31, rows[3][1]), (32, rows[10][1].replace("of", "ov", 1)), (33, rows[20][1] + " end.")]
    rows += [(40, prose(40, 45) + " " + passage + " " + prose(41, 30)), (42, prose(42, 50) + " " + passage + " tail")]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one two"), (54, "one two"), (55, "É, naïve ǅ ½ 日本 \U0001f600 &&& #"),
             (56, prose(56, 30_000)), (57, "same line here\n" * 40), (58, "w " * 400), (59, "x" * 5000)]
    rows += [(None, prose(60, 40)), (None, None), (5, rows[5][1]), (5, rows[5][1]), (6, "another text of the same id")]
    return rows

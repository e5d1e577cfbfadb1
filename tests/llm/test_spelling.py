"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

from conftest import frame
from llm_rows import words
from tablemill.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        near = [v for v in n if v != w and abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best and n[best] >= 2 * n[w] else None, n[w], len(near)]
    ends = {}
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        ends[w] = (out[w][0], at, n[w], out[w][2], n[out[w][0]] if out[w][0] else None)
    return ends


def result(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def made_up(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcéÿxy") for _ in range(r.randint(4, 9))) for _ in range(40)]
    rows = []
    for i in range(n):
        out = []
        for _ in range(60):
            w = r.choice(base)
            k = r.randrange(len(w) + 1)
            out.append(r.choice([w, w, w.upper(), w[:k] + w[k + 1:], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("bx") + w[k + 1:]]))
        rows.append((i, " ".join(out) + r.choice([".", "1", "-É\n"])))
    return rows


def test_equals_all_pairs(spark, docs, rows):
    assert result(spelling.spelling_variants(docs)) == brute(rows)
    more = made_up(1, 150)
    want = brute(more)
    assert len(want) > 250 and sum(v[0] is not None for v in want.values()) > 50 and any(v[1] != v[0] for v in want.values() if v[0])  # chains too
    assert result(spelling.spelling_variants(frame(spark, more))) == want


def test_nothing_and_large_groups(spark, empty):
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, None), (2, ""), (3, "to be or not")])).count() == 0
    r = random.Random(3)
    vocab = sorted({"prefix" + "".join(r.choice("ab") for _ in range(r.randint(3, 6))) + "tail" for _ in range(400)} | {"b" * k for k in range(5, 9)} | {"z" * 3000, "z" * 3001})
    table = spark.createDataFrame([(w, 3 + i % 50) for i, w in enumerate(vocab)], "word string, n long")
    want = {(a, b) for i, a in enumerate(vocab) for b in vocab[i + 1:] if one_edit(a, b)}
    for limit in (2, 7, 4096):
        got = [tuple(sorted((x["a"], x["b"]))) for x in spelling.near_words(table, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want, limit


def test_equal_ends_share_states():
    acceptor = spelling.Acceptor()
    start = acceptor.language(sorted(a + b for a in ("ham", "sil", "tor") for b in ("", "en", "ly")))
    assert acceptor.sizes[start] == 9 and len(acceptor.edges) == 11

"""Fingerprints against the exact generalised Jaccard similarity and a plain walk over the ordered documents."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from conftest import frame
from llm_rows import CLASH, words
from tablemill.llm import fingerprints


def shingles(text, size=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(" ".join(found[i:i + size]) for i in range(max(len(found) - size + 1, 1))) if found else Counter()


def generalised_jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_edits_of_all_documents(spark, docs, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], []).append(r)
    known = sorted({d for d, _ in rows if d is not None})
    single = [d for d in known if sum(d == x for x, _ in rows) == 1]
    by_id = {d: t or "" for d, t in rows}
    checked = 0
    for d in single:
        at = known.index(d)
        after = known[at + 1] if at + 1 < len(known) else None
        if after not in single:
            continue
        text, other = by_id[d], by_id[after]
        half = len(text) // 2
        copy = text[:len(text) - half] + other[:half]
        r = texts[d][0]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(copy.encode()).hexdigest(), d
        assert abs(r["near_edited"] - generalised_jaccard(text, copy)) < 0.3, d
        assert abs(r["near_next"] - generalised_jaccard(text, other)) < 0.3, d
        assert r["near_next"] == (1.0 if r["fingerprint"] == texts[after][0]["fingerprint"] else r["near_next"])
        checked += 1
    assert checked > 25
    by_text = {}
    for d in single:
        by_text.setdefault(by_id[d], set()).add(texts[d][0]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert texts[50][0]["fingerprint"] == texts[51][0]["fingerprint"] == "" and texts[50][0]["near_next"] == 1.0


def test_last_is_followed_by_first_and_one_row_by_itself(spark, empty):
    a, b = " ".join(words(1, 40)), " ".join(words(2, 30))
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(frame(spark, [(9, a), (2, b)])).collect()}
    assert got[9]["edited_sha256"] == hashlib.sha256((a[:len(a) - len(a) // 2] + b[:len(a) // 2]).encode()).hexdigest()
    alone = fingerprints.fingerprint_edits(frame(spark, [(None, a)])).first()
    assert alone["near_next"] == 1.0 and alone["doc_id"] is None
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_many_rows_of_one_id_are_split_and_chained(spark):
    rows = [(7, " ".join(words(i, 12))) for i in range(300)] + [(1, "a b c"), (8, "d e f")]
    got = fingerprints.with_next_text(frame(spark, rows)).where("own").collect()
    assert len(got) == 302 and len({r["range"] for r in got}) > 3
    assert sorted(r["next_text"] for r in got) == sorted(t for _, t in rows)


def test_likeness_is_the_generalised_jaccard_similarity(spark):
    base = words(5, 60)
    rows = []
    for k in range(200):  # heavy terms: whole blocks repeated by different counts
        own = [f"{w}{k}" for w in base]
        rows.append((k, " ".join(own * (1 + k % 4)), " ".join((own * (1 + (k // 4) % 5))[:len(own) * (1 + (k // 4) % 5) - k % 30])))
    df = spark.createDataFrame(rows, "doc_id long, a string, b string").select("*", *[F.lit("own").alias(c) for c in CLASH])
    both = fingerprints.fingerprint(df, "a", 64).withColumnRenamed("fingerprint", "fa")
    both = fingerprints.fingerprint(both, "b", 64).withColumnRenamed("fingerprint", "fb")
    error, n = 0.0, 0
    for r in both.select("a", "b", "fa", "fb").collect():
        fa, fb = (re.findall("." * 8, r[c]) for c in ("fa", "fb"))
        error += sum(x == y for x, y in zip(fa, fb)) / 64 - generalised_jaccard(r["a"], r["b"])
        n += 1
    assert abs(error / n) < 0.02  # mean error of 200 estimates, each with a deviation below 0.0625

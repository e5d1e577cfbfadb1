"""The other corpus operators against brute force, round trips and held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import encode, packing, paragraphs, quality_model, similar, stages, token_counts, wavelet, words as W
from tablemill.sources.tables import read_table
from conftest import frame
from llm_rows import CLASH, prose, words

SMALL = "/root/testdata/sf0.001"


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = split(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_word_hashes():
    texts = ["A b  c", "", None, "a B c d e f", "x" * 10 + " a", "é　b\x85c"]
    for limit in (1 << 20, 4):  # in one go, and in pieces
        W.SLICE, old = limit, W.SLICE
        try:
            h, n, first, last = W.hashed_words(texts, with_places=True)
        finally:
            W.SLICE = old
        assert n.tolist() == [3, 0, 0, 6, 2, 1]
        assert h[0] == h[3] == h[-2] and h[1] == h[4] and len(set(h.tolist())) == 8
        assert first[:3].tolist() == [0, 2, 5] and last[:3].tolist() == [1, 3, 6]
    runs, who, at = W.grams(h, n, 3, short=True)
    assert who.tolist() == [0, 3, 3, 3, 3, 4, 5] and at.tolist() == [0, 0, 1, 2, 3, 0, 0] and runs[0] == runs[1]
    value = np.random.RandomState(0).randint(0, 50, 300).astype(np.uint64)
    who = np.repeat([0, 1, 2], 100)
    kept = set(paragraphs.winnow(value, who, 7).tolist())
    want = {i for s in range(294) if who[s] == who[s + 6] for i in range(s, s + 7) if value[i] == value[s:s + 7].min()}
    assert want <= kept and all(value[i] == 0 or i in want for i in kept)


def brute_similar(rows):
    keys = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    linked = [(a, b) for a in keys for b in keys[:a] if sets[a] and len(sets[a] & sets[b]) >= .8 * len(sets[a] | sets[b])]
    links, copies = Counter(), Counter()
    for a, b in linked:
        for k in (a, b):
            links[k] += 1
            copies[k] += sets[a] == sets[b]
    of = groups(linked, keys)
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0)
    least = {}
    for k in keys:
        least[of[k]] = min(least.get(of[k], k), k, key=order)
    return [(rows[k][0], rows[least[of[k]]][0], links[k], copies[k]) for k in keys]


def near_family(seed, n, edits):
    """A text and copies of it with some words exchanged."""
    base, r = words(seed, 150), random.Random(seed)
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(150)] = f"new{r.randrange(999)}"
        out.append(" ".join(w))
    return out


def test_similar(spark, docs, rows, empty, monkeypatch):
    family = [(1000 + k, t) for k, t in enumerate(near_family("f", 90, 3) + near_family("g", 40, 1))]
    more = spark.createDataFrame(family, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in CLASH])
    both = docs.unionByName(more)
    want = Counter(brute_similar(rows + family))
    for block in (512, 16):  # in one task per group, and in blocks
        monkeypatch.setattr(similar, "EXACT_BLOCK", block)
        monkeypatch.setattr(similar, "SIGNATURE_BLOCK", 2 * block)
        found = similar.similar_documents(both).collect()
        assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in found) == want
    kept = similar.one_per_class(both)
    assert kept.columns == both.columns
    kept = Counter(r["doc_id"] for r in kept.collect())
    classes = {c for i, c, _, _ in want if i is not None}
    assert set(kept) - {None} == classes and kept[5] == 1 and kept[None] == 2
    assert similar.similar_documents(empty).count() == 0 and similar.one_per_class(empty).count() == 0


def test_pruning_bounds():
    bounds = similar.least_matches()
    assert list(bounds) == [15, 30, 45, 60] and bounds[15] < bounds[30] < bounds[60] < 48
    random_state = np.random.RandomState(1)
    missed = sum(any((random_state.rand(n) < .8).sum() < m for n, m in bounds.items()) for _ in range(20_000))
    assert missed <= 2
    assert 1 - (1 - .8 ** similar.ROWS) ** similar.BANDS > 0.999999
    bands, rows = paragraphs.tune()
    assert 1 - (1 - .8 ** rows) ** bands >= .999


def shared_runs(rows, size):
    where = defaultdict(set)
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - size + 1):
            where[tuple(w[k:k + size])].add(i)
    return [s for s in where.values() if len(s) > 1]


def test_paragraphs(spark, docs, rows, empty):
    near = words("near", 120)
    changed = list(near)
    changed[60] = "changed"
    more = [(200, "Head of one.\n" + " ".join(near)), (201, " ".join(changed) + "\nTail of two."), (202, "All rights reserved.\n" + prose(202, 60)),
            (203, "All rights reserved.\n" + prose(203, 60))]
    both = docs.where("doc_id IS NOT NULL").unionByName(
        spark.createDataFrame(more, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in CLASH]))
    known = [r for r in rows if r[0] is not None] + more
    found = paragraphs.repeated_pairs(both).collect()
    pairs = {(r["doc_id"], r["kept_doc_id"]) for r in found}
    flagged = {i for p in pairs for i in p}
    assert set().union(*shared_runs(known, 50)) <= flagged and {(201, 200), (42, 40), (30, 3)} <= pairs
    assert flagged <= set().union(*shared_runs(known, 20), {57, 58}) and not flagged & {202, 203}
    assert all(r["n_words"] >= 20 and r["n_passages"] >= 1 for r in found)
    out = paragraphs.remove_repeated(both.withColumn("n_chars", F.length("text")))
    left = [(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()]
    assert out.columns == both.columns + ["n_chars"]
    assert not shared_runs([(k, t) for k, (i, t, _) in enumerate(left) if i != 5], 50)
    texts = {i: t for i, t, _ in left}
    assert texts[40] == dict(known)[40] and "All rights reserved" in texts[203] and texts[201].strip() == "Tail of two."
    assert 31 not in texts and texts[42] == prose(42, 50) + " tail" and not shared_runs([(i, t) for i, t, _ in left if i in (3, 31, 40, 42)], 20)
    assert all(n == (None if t is None else len(t)) for _, t, n in left) and {50, 51, 52} <= set(texts)
    assert paragraphs.repeated_passages(empty).count() == 0


def test_all_places_of_a_passage(spark):
    """A passage that stands twice in a later document, and one that stands twice in one document only."""
    shared, own = " ".join(words("shared", 60)), " ".join(words("own", 60))
    texts = [(1, prose(301, 30) + " " + shared + " " + prose(302, 30)),
             (2, prose(303, 30) + " " + shared + " " + prose(304, 45) + " " + shared + " tail"),
             (3, prose(305, 30) + " " + own + " " + prose(306, 45) + " " + own + " tail"), (4, "w " * 300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    left = dict(paragraphs.remove_repeated(df).collect())
    assert left[1] == texts[0][1] and left[2] == prose(303, 30) + " " + prose(304, 45) + " tail"
    assert left[3] == prose(305, 30) + " " + own + " " + prose(306, 45) + " tail" and left[4] == "w"
    found = {(r["doc_id"], r["kept_doc_id"]): r["n_words"] for r in paragraphs.repeated_pairs(df).collect()}
    assert found == {(2, 1): 120, (3, 3): 60, (4, 4): 299}


def library_counts(rows):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=encode.tokenizer_path("piece_bpe_32k.model"))
    return Counter((i, len((t or "").encode()), len(own.encode(t or ""))) for i, t in rows)


@pytest.mark.parametrize("chunk,overlap", [(16_384, 256), (300, 16), (64, 4)])
def test_token_counts(spark, docs, rows, empty, chunk, overlap):
    odd = [(80, "a b " * 900), (81, " " * 400), (82, "word " * 50 + "x" * 2500 + " end " + "  double  " * 200), (83, "日本語" * 300 + " " + "ab" * 400),
           (84, "<s> </s> <unk> ▁a b\tc" * 30), (85, "\n".join(f"line {i}  " for i in range(200))), (86, "a" * 150 + " " + "b" * 3000 + " c")]
    some = [r for r in rows if chunk > 1000 or r[0] != 56]
    df = docs.where(F.lit(chunk > 1000) | ~F.col("doc_id").eqNullSafe(56)).unionByName(
        spark.createDataFrame(odd, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in CLASH]))
    found = token_counts.count_tokens(df, long=chunk, chunk=chunk, overlap=overlap)
    assert Counter(map(tuple, found.collect())) == library_counts(some + odd)
    assert token_counts.count_tokens(empty).count() == 0


def test_one_huge_text_is_cut_in_linear_time(spark):
    """Chunks leave in one walk: four times the length takes about four times as long."""
    import time
    part = prose(77, 20_000) + "\n"
    took = {}
    for times in (2, 8):
        rows = [(1, part * times), (2, "short")]
        start = time.time()
        got = token_counts.count_tokens(frame(spark, rows).coalesce(1), long=4096, chunk=4096, overlap=256).collect()
        took[times] = time.time() - start
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == library_counts(rows)
    assert took[8] < 8 * took[2] + 20


def library_ids(rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(encode.tokenizer_path("word_bpe_49k.json"))
    return [np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in rows]


def test_encoder(rows, monkeypatch):
    odd = [(0, "é́ ﬁ　x <s></s> <|endoftext|>a<|startoftext|> don't I'LL \x1c \xa0 ́b ÅÅ İK 12345 \t\n\r\x0b\x0c z"),
           (1, "İ İ ſ K ǅ ½ ² ١ a_b a-b 'tis ''s 's'll"), (2, "é" * 50), (3, " a b\x85c")]
    own = encode.WordEncoder()
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(own.ids([t for _, t in rows + odd]), library_ids(rows + odd)))
    monkeypatch.setattr(encode, "REMEMBERED", 50)
    monkeypatch.setattr(encode, "SLICE", 300)
    own = encode.WordEncoder()
    assert all(a.tolist() == b.tolist() for a, b in zip(own.ids([t for _, t in rows[:30]]), library_ids(rows[:30])))


def test_packing(docs, rows, empty):
    coded = Counter((i, x.tobytes()) for (i, _), x in zip(rows, library_ids(rows)))
    found = packing.pack_documents(docs, with_ids=True).collect()
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in found:
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append(r)
    for k, pieces in by_sequence.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            by_document[k, r["offset"]] = r
        assert at <= packing.WINDOW
    assert set(by_sequence) == set(range(len(by_sequence)))
    whole, ids, last = Counter(), [], None
    for key in sorted(by_document):  # documents one after another, each in one go
        r = by_document[key]
        assert r["start"] == sum(map(len, ids)) and (last is None or r["doc_id"] is None or r["doc_id"] >= last)
        ids.append(r["ids"])
        if sum(map(len, ids)) == r["doc_tokens"]:
            whole[r["doc_id"], np.array(sum(ids, []), "<u4").tobytes()] += 1
            ids, last = [], r["doc_id"]
    assert whole == coded and not ids
    assert packing.pack_documents(empty).count() == 0


def test_cuts_are_least():
    r = random.Random(5)
    for _ in range(200):
        places = np.concatenate([[0], np.cumsum([r.randint(1, 10) for _ in range(r.randint(1, 12))])])
        costs, window = np.array([r.randint(0, 9) for _ in places]), r.randint(10, 20)
        best = [0]
        for j in range(1, len(places)):
            best.append(min(best[i] + window - (places[j] - places[i]) + costs[j] for i in range(j) if places[j] - places[i] <= window))
        cuts = [0] + packing.choose_cuts(places, costs, window)
        assert all(places[b] - places[a] <= window for a, b in zip(cuts, cuts[1:])) and cuts[-1] == len(places) - 1
        assert sum(window - (places[b] - places[a]) + costs[b] for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_packing_in_lots(monkeypatch):
    """Lots much smaller than documents, and windows smaller than sentences, lose nothing."""
    monkeypatch.setattr(packing, "LOT", 50)
    ends = np.zeros(1 << 16, bool)
    ends[7] = True
    r = np.random.RandomState(2)
    given = [r.randint(2, 60, r.randint(1, 400)).astype(np.uint16) for _ in range(30)]
    packer, rows = packing.Packer(ends, 32), []
    for k, ids in enumerate(given):
        rows += packer.add(k, ids)
    rows += packer.pack(final=True)
    assert (np.concatenate([x[-1] for x in rows]) == np.concatenate(given)).all()
    sizes = Counter()
    for x in rows:
        assert x[6] == sizes[x[5]]
        sizes[x[5]] += x[2]
    assert max(sizes.values()) <= 32


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.RandomState(n).randint(0, 40, n).astype(np.uint16)
    ids[::7] = 49_407
    m = wavelet.WaveletMatrix.loads(wavelet.WaveletMatrix.build(ids).dumps())
    assert (m.ids() == ids).all() and [m[i] for i in range(0, n, max(1, n // 50))] == ids[::max(1, n // 50)].tolist()
    for t in (0, 3, 39, 49_407, 5000):
        at = np.flatnonzero(ids == t)
        assert m.count(t) == len(at) and m.count(t, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [m.find(t, k) for k in range(min(len(at), 40))] == at[:40].tolist() and m.find(t, len(at)) == -1
    with pytest.raises(IndexError):
        m[n]


def test_wavelet_shards(docs, rows, empty):
    for limit in (1 << 20, 500):
        found = sorted((tuple(r) for r in wavelet.encode_documents(docs, limit=limit).collect()), key=lambda r: r[1])
        assert Counter((r[0], r[2], r[3]) for r in found) == Counter(
            (i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, library_ids(rows)))
        at = 0
        for r in found:
            assert r[1] == at
            at += r[2]
        ids = [r[0] for r in found if r[0] is not None]
        assert ids == sorted(ids) and found[0][0] is None and found[1][0] is None
    assert wavelet.encode_documents(empty).count() == 0


def test_classifier(spark, docs, empty):
    good = [(i, prose(i, 60)) for i in range(400)]
    bad = [(i, " ".join(w + "%%%" for w in words(i, 60))) for i in range(400, 600)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(600)] + [(3, 1), (None, 0), (5, None), (9999, 1)], "doc_id long, quality int")
    for bound in (40_000, 150):
        model = quality_model.train(table, labels, quality_model.Settings(max_rows=bound, parts=3))
        found = quality_model.score(table.withColumn("held", quality_model.crc_remainder(F.col("doc_id")) == 2), model).collect()
        held = [r for r in found if r["held"]]
        assert len(held) > 100 and sum(r["predicted"] == (r["doc_id"] < 400) for r in held) > .97 * len(held)
        assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
        assert all(r["predicted"] == int(r["score"] >= .7) for r in found)
    flipped = labels.select("doc_id", F.when(quality_model.crc_remainder(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    again = quality_model.train(table, flipped, quality_model.Settings(max_rows=150, parts=3))
    assert (again.weights == model.weights).all()  # held-out labels are never looked at, and training is repeatable
    out = quality_model.score(docs, model)
    assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert set(out.columns) == set(docs.columns)
    assert quality_model.score(empty, quality_model.train(empty, labels.limit(0))).count() == 0


def test_features_by_definition():
    index, value, row = quality_model.features(["a b, a b", None, ""], 18)
    assert set(row.tolist()) == {0, 1, 2} and sorted(index[row == 1].tolist()) == [0, 1]
    inner = value[(row == 0) & (index > 1)]
    assert np.isclose((inner ** 2).sum(), 1) and len(inner) == 6  # a, b, comma; a-b, b-comma, comma-a
    assert value[(row == 0) & (index == 1)] == pytest.approx(.5)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = read_table(spark, SMALL, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SMALL).cache()
        assert docs.count() > 100 and (k == 4 or docs.columns == columns)
    assert [f for _, f in corpus_pipeline.STAGES] == [
        stages.good_documents, stages.different_documents, stages.unrepeated_passages, stages.uncontaminated, stages.packed]


def test_no_passage_loses_its_last_copy(spark):
    """A near copy that goes may not be what another document's passage is kept by."""
    p, x = words("long", 700), words("inner", 60)
    rows = [(1, " ".join(p)), (2, " ".join(p[:350] + x + p[350:])), (3, " ".join(words("other", 40) + x + words("end", 40)))]
    rows += [(4, " ".join(words("fourth", 30) + x + words("tail", 30)))]
    left = dict(paragraphs.remove_repeated(frame(spark, rows).select("doc_id", "text")).collect())
    assert 2 not in left and left[1] == rows[0][1] and left[3] == rows[2][1] and left[4] == " ".join(words("fourth", 30) + words("tail", 30))
    r = random.Random(9)
    pool = [words(f"pool{k}", r.choice([30, 60, 90, 200])) for k in range(14)]
    many = []
    for i in range(40):  # lines put together from shared blocks, some with a few words changed
        lines = []
        for _ in range(r.randint(1, 3)):
            line = [w for b in r.sample(range(14), r.randint(1, 3)) for w in pool[b]]
            lines.append(" ".join(w if r.random() > .01 else "zz" for w in line) if r.random() < .4 else " ".join(line))
        many.append((i, "\n".join(lines)))
    found = paragraphs.repeated_passages(frame(spark, many)).collect()
    text = {i: t.split() for i, t in many}
    line_ends = {i: [0, *np.cumsum([len(x.split()) for x in t.split("\n")])] for i, t in many}
    whole = lambda p: p["start"] in line_ends[p["doc_id"]] and p["start"] + p["size"] in line_ends[p["doc_id"]]
    equal = lambda p: text[p["doc_id"]][p["start"]:p["start"] + p["size"]] == text[p["kept_doc_id"]][p["kept_start"]:p["kept_start"] + p["size"]]
    near = [p for p in found if not equal(p)]
    assert all(whole(p) for p in near) and len(near) > 3 and len(found) - len(near) > 20
    for p in found:
        assert (p["kept_doc_id"], p["kept_start"]) < (p["doc_id"], p["start"])
        if p not in near:  # what stands for equal words is in no near copy that goes
            last = p["kept_start"] + p["size"]
            lost = [q for q in near if q["doc_id"] == p["kept_doc_id"] and q["start"] < last and q["start"] + q["size"] > p["kept_start"]]
            assert not lost or whole(p), (p, lost)

"""Sharding, quality rules, decontamination and licence scan against plain Python."""

import hashlib
import re
import zlib
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from tablemill.llm import contamination, licences, quality_rules, sharding
from llm_rows import CLASH, prose, words
from tablemill.llm.licence_table import must, templates, terms

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def crc(text):
    return zlib.crc32((text or "").encode())


def test_shards(docs, rows, empty):
    found = [r.asDict() for r in sharding.shard_documents(docs).collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, crc(t)) for i, t in rows)
    sizes = Counter(r["shard"] for r in found)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, k) for s in range(8) for k in range(sizes[s])]
    assert sharding.shard_documents(empty).collect() == []


def test_shards_keep_columns_and_runs(docs, rows):
    out = sharding.uniform_shards(docs, 3, ["doc_id", "text"], seed=4, run_rows=5)
    found = out.collect()
    assert set(out.columns) == set(docs.columns)
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and {r["size"] for r in found} == {"own"}
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, k) for s in range(3) for k in range(sizes[s])]


def test_matrix_and_draw(spark):
    counts = spark.createDataFrame([(0, 10), (3, 0), (4, 37), (9, 5), (11, 100)], "part long, rows long")
    for shards in (1, 2, 5, 8):
        found = sharding.communication_matrix(counts, shards, 1).collect()
        by_part, by_shard = Counter(), Counter()
        for r in found:
            assert r["sent"] >= 0
            by_part[r["part"]] += r["sent"]
            by_shard[r["shard"]] += r["sent"]
        assert {k: v for k, v in by_part.items() if v} == {0: 10, 4: 37, 9: 5, 11: 100}
        assert sum(by_shard.values()) == 152 and max(by_shard.values()) - min(by_shard.values()) <= 1
    u = "double(shiftrightunsigned(xxhash64(5, id), 11)) * pow(2D, -53)"
    drawn = spark.range(20_000).select(F.expr(sharding.hypergeometric("50", "20", "12", u)).alias("x"))
    seen = dict(drawn.groupBy("x").count().collect())
    for k in range(13):
        assert abs(seen.get(k, 0) / 20_000 - comb(20, k) * comb(30, 12 - k) / comb(50, 12)) < 0.015
    edges = spark.range(1).select(*[F.expr(sharding.hypergeometric(*map(str, c), "0.5D")) for c in (
        (0, 0, 0), (5, 5, 3), (5, 0, 3), (5, 2, 5))]).first()
    assert tuple(edges) == (0, 3, 0, 2)


def plain_rules(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    chars, dup = sum(map(len, w)), len(lines) - len(set(lines))
    stops = sum(x.lower() in quality_rules.STOP_WORDS for x in w)
    kept = not failed and 2 * len(w) <= chars <= 24 * len(w) and symbols <= .1 * chars and stops >= .02 * len(w) and dup <= .5 * len(lines)
    return len(w), chars, symbols, dup, len(hit), failed, kept


def test_rules(docs, rows, empty):
    out = quality_rules.apply_rules(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    found = Counter((r["doc_id"], r["text"], *(r[n] for n in names)) for r in out.collect())
    assert found == Counter((i, t, *plain_rules(t)) for i, t in rows)
    assert out.schema["kept"].dataType.simpleString() == "boolean" and set(CLASH) - set(out.columns) == set()
    assert quality_rules.apply_rules(empty).count() == 0


BENCH = [(7, " ".join(words("b7", 30))), (12, " ".join(words("b12", 13))), (3, "Short Item"), (4, ""), (5, None),
         (6, " ".join(words("b7", 30)).upper())]


def plain_contamination(rows, bench):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    grams = {}
    for i, t in bench:
        w = pattern.findall(lower(t))
        size = min(13, len(w))
        for k in range(len(w) - size + 1) if w else []:
            grams.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    out = set()
    for i, t in rows:
        w, hit, items = pattern.findall(lower(t)), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in grams:
                    items |= grams[tuple(w[k:k + size])]
                    hit |= set(range(k, k + size))
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.add((i, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark, docs, rows, empty, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    more = [(70, prose(70, 40) + "\n" + " ".join(words("b7", 30)[4:26]) + "."), (71, "A short, ITEM!"), (72, "short Éitem"),
            (73, prose(73, 400) + " " + " ".join(words("b12", 13)) + ", " + prose(74, 100)), (74, "ﬁ short item K")]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string").select("*", *[F.lit("own").alias(c) for c in CLASH]))
    want = plain_contamination(rows + more, BENCH)
    for limit in (contamination.BROADCAST_ROWS, 7):  # in one broadcast, and in slices
        monkeypatch.setattr(contamination, "BROADCAST_ROWS", limit)
        found = contamination.contamination(both, bench).drop("print", "spans").collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
    clean = contamination.decontaminate(both, bench)
    assert clean.columns == both.columns
    bad = {r[0] for r in want if r[5]}
    assert bad == {70, 71, 74} and Counter(r["doc_id"] for r in clean.collect()) == Counter(
        i for i, _ in rows + more if i not in bad)
    cut = contamination.decontaminate(both, bench, "spans")
    assert not contamination.contamination(cut, bench).where("n_hit > 0").count()
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[73] == prose(73, 400) + ", " + prose(74, 100) and texts[71] == "A!" and texts[0] == rows[0][1]
    assert contamination.contamination(empty, bench).count() == 0
    none = contamination.contamination(docs, bench.limit(0)).collect()
    assert not any(r["contaminated"] for r in none) and none[0]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_licences(spark, docs, empty):
    files = [("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/x.py", "print(1)\n" * 30), ("a/b/c/y.py", "no header"),
             ("a/b/z.py", "# Released under the MIT License.\n" + "code here\n" * 50), ("a/b/w.py", None),
             ("q/readme", "All rights reserved."), ("q/r/s.txt", "text " * 50), ("t/u.txt", ""), (None, "Released under the MIT License."),
             ("v/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("v/k.py", "the of this is a work"),
             ("a/x.py", "print(1)\n" * 30)]
    df = spark.createDataFrame(files, "path string, text string").withColumn("score", F.lit("own"))
    out = licences.scan(df)
    found = Counter((r["path"], r["licence"], r["found"], r["from_dir"]) for r in out.collect())
    assert found == Counter([
        ("a/LICENSE", "Apache-2.0", "own", None), ("a/x.py", "Apache-2.0", "inherited", "a"), ("a/x.py", "Apache-2.0", "inherited", "a"),
        ("a/b/c/y.py", "Apache-2.0", "inherited", "a"), ("a/b/z.py", "MIT", "own", None), ("a/b/w.py", "Apache-2.0", "inherited", "a"),
        ("q/readme", "proprietary", "own", None), ("q/r/s.txt", "proprietary", "inherited", "q"), ("t/u.txt", None, None, None),
        (None, "MIT", "own", None), ("v/COPYING", "GPL-3.0", "own", None), ("v/k.py", "GPL-3.0", "inherited", "v")])
    assert licences.scan(licences.document_paths(empty.withColumn("source", F.lit("s")).withColumn("lang", F.lit(None).cast("string")))).count() == 0


def licence_by_definition(texts):
    """(score, licence) of every text from the definition, without any short cut."""
    words = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    df = Counter(w for ws in words for w in set(ws))
    weigh = lambda ws: {w: k * licences.rarity(df[w], len(texts)) for w, k in Counter(ws).items()}
    norm = lambda v: sum(x * x for x in v.values()) ** .5
    known = [(n, must(s), weigh(terms(s))) for n, s in templates()]
    for text in texts:
        parts = re.split(r"\n|(?<=[.!?])[ \t]+", text) + [
            s for b in re.split(r"\n(?:[\W_]*\n)", text) for s in re.split(r"(?<=[.!?])[ \t\n]+", b)]
        best = None
        for part in parts:
            ws = re.findall(r"[^\W_]+", part.lower())
            a = weigh(ws)
            for n, name, b in known:
                if not ws or name is not None and name not in a:
                    continue
                score = sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b)
                if score >= licences.LEAST and (best is None or (-round(score, 6), -len(ws), n) < best):
                    best = (-round(score, 6), -len(ws), n)
        yield best and (-best[0], best[2])


def test_licence_cosine(spark):
    """Score and licence against the definition, over notices between common words."""
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under the License, Version 2.0 and more", "MIT MIT License released", "of the work",
             "License", "Released under the same license", "Public License", "licensed by the mit license and by the board", "the the the",
             "This project is released under the Apache License 2.0 by us. More text.", "gnu gnu gnu public license license", "Apache web server"]
    texts += [prose(i, 60) + ".\n" + f"{s} {words(i, i % 4)}" for i, (_, s) in enumerate(templates()[::3])]
    df = spark.createDataFrame([(f"d{i}/f", t) for i, t in enumerate(texts)], "path string, text string")
    out = {r["path"]: (r["score"], r["licence"]) if r["found"] == "own" else None for r in licences.scan(df).collect()}
    for i, best in enumerate(licence_by_definition(texts)):
        found = out[f"d{i}/f"]
        assert (found is None) == (best is None), texts[i]
        assert best is None or found == (pytest.approx(best[0], abs=2e-6), best[1]), texts[i]


NOTICES = [
    ("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n"), ("MIT", "The MIT License (MIT)"), ("MIT", "# Licensed under the MIT license."),
    ("MIT", "This project is licensed under the MIT License"), ("MIT", "// SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
            "(the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do "
            "so, subject to the following conditions:\n"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", "                                 Apache License\n"
     "                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"),
    ("Apache-2.0", "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance "
                   "with the License.\n */"),
    ("Apache-2.0", "Released under the Apache License 2.0."), ("Apache-2.0", "## License\n\nThis project is licensed under the Apache License 2.0.\n"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
    ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as "
                "published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"), ("GPL-3.0", "Licensed under the GPLv3."),
    ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n"),
    ("GPL-2.0", " * This program is free software; you can redistribute it and/or\n * modify it under the terms of the GNU General Public License\n"
                " * as published by the Free Software Foundation; either version 2\n * of the License, or (at your option) any later version.\n"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"), ("GPL-1.0-or-later", "GNU GENERAL PUBLIC LICENSE"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
                 "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n"), ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n"),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not "
                "distributed with this\n * file, You can obtain one at the site. */"),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, the authors"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following "
                     "conditions are met:\n"),
    ("ISC", "ISC License\n"), ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is "
     "hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n"), ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("BSL-1.0", "// Distributed under the Boost Software License, Version 1.0."), ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
]
NO_NOTICES = ["License", "The license of the house was lost.", "Public License office hours", "Released under the same license as before.",
              "You need a license to drive", "mit der Bahn", "General Motors", "Apache helicopters flew", "She asked for permission to use the software.",
              "This project is licensed.", "free software", "All right, reserved seats", "version 2.0", "the common good"]


def test_real_notices(spark):
    """Standard notices, wrapped and in comment marks, in files of other text; nothing is found in ordinary sentences."""
    files = [(f"n{i}/f", f"{prose(i, 30)}\n\n{t}\n\n{prose(i + 500, 80)}", n) for i, (n, t) in enumerate(NOTICES)]
    files += [(f"m{i}/f", f"{prose(i + 900, 30)}\n{t}\n{prose(i + 1500, 80)}", None) for i, t in enumerate(NO_NOTICES)]
    files += [(f"p{i}/f", prose(i + 3000, 200), None) for i in range(300)]
    found = licences.scan(spark.createDataFrame(files, "path string, text string, truth string")).collect()
    right = [r for r in found if r["truth"] is not None and r["licence"] == r["truth"]]
    missed = [(r["truth"], r["licence"], r["score"]) for r in found if r["truth"] is not None and r["licence"] != r["truth"]]
    assert len(right) >= 0.9 * len(NOTICES), missed
    assert [(r["text"][:300], r["licence"]) for r in found if r["truth"] is None and r["licence"] is not None] == []

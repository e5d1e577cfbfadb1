"""The packer's workers: small lots of new words, and no encoder left behind where a job asks for that."""

from __future__ import annotations

import numpy as np

from tablemill.llm import encode, packing


def test_new_words_in_lots_have_the_ids_of_one_lot(monkeypatch):
    texts = ["".join(chr(97 + (i * k) % 26) for k in range(1, 9)) + f" é{i} x-{i}." for i in range(300)]
    whole = encode.WordEncoder().ids([" ".join(texts), None, "The end."])
    lots = []
    coder = encode.WordEncoder()
    plain = coder._coded
    monkeypatch.setattr(coder, "_coded", lambda words: (lots.append(len(words)), plain(words))[1])
    monkeypatch.setattr(encode, "CODED", 7)
    parts = coder.ids([" ".join(texts), None, "The end."])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert max(lots) <= 7 and len(lots) > 40


def test_forgotten_encoder_is_made_anew():
    first = encode.encoder()
    encode.forget()
    encode.forget()
    assert encode.encoder() is not first


def test_pieces_do_not_depend_on_the_kept_encoder(spark):
    rows = [(i, None if i % 9 == 0 else f"Row {i} of many. " * (i * 40)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted(map(tuple, df.drop("ids").collect()))
    assert key(packing.pack_documents(docs, with_ids=True, keep_encoder=False)) == key(packing.pack_documents(docs))

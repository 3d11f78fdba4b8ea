"""Odd input of the operators that read one text at a time."""

import random

import numpy as np

from tandem.llm import encoding, langid, media, packing, pii

from .helpers import documents, words


def test_subwords_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 999):
        text = "".join(rng.choice("abé ß. 12Zz") for _ in range(n))
        whole = np.sort(langid.subwords(text))
        for block in (1, 2, 3, 64):
            monkeypatch.setattr(langid, "BLOCK", block)
            assert np.array_equal(np.sort(langid.subwords(text)), whole)
        monkeypatch.undo()


def test_a_language_of_one_row_is_learned():
    rng = random.Random(2)
    rows = []
    for lang, letters, n in (("aa", "abcdef", 30), ("bb", "uvwxyz", 1), ("cc", "mnopqr", 4)):
        for _ in range(n):
            b, c = np.unique(langid.subwords(" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))), return_counts=True)
            rows.append((lang, b, c))
    model = langid.train(rows)
    assert model.languages == ["aa", "bb", "cc"]
    assert langid.judge(model, "uvwx zyxw vuvu wxyz zzyx")[0] == "bb"


def test_junk_is_not_trusted(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice(("abcde", "vwxyz")[i % 2]) for _ in range(5)) for _ in range(60)), ("aa", "bb")[i % 2]) for i in range(400)]
    rows += [(1000 + i, t, None) for i, t in enumerate(["0000 1111", "", None, "....", "😀 12"])]
    found = {r.doc_id: r for r in langid.identify(documents(spark, rows)).collect()}
    assert all(found[1000 + i].lang_pred == "und" and found[1000 + i].score == 0 and found[1000 + i].rejected for i in range(5))
    held = [i for i in range(400) if found[i].held_out]
    assert held and sum(found[i].lang_pred == ("aa", "bb")[i % 2] for i in held) >= 0.99 * len(held)
    assert sum(found[i].rejected for i in range(400)) <= 4


def test_empty_tables_and_null_ids(spark):
    empty, odd = documents(spark, []), documents(spark, [(None, "no id", "en"), (None, None, None)])
    for run in (encoding.encode_digests, encoding.encode_texts, media.wav_features, packing.pack_documents, pii.personal_data, langid.identify):
        assert run(empty).count() == 0
        found = run(odd).collect()
        assert len(found) == 2 and all(r.doc_id is None for r in found)


def test_very_long_texts_are_whole(spark):
    rng = random.Random(4)
    long = words(rng, 150_000) + " end@of.text"
    docs = documents(spark, [(1, long, "en")])
    told = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert told[1].n_email == 1 and f"email:{len(long) - 11}:{len(long)}" in told[1].spans
    ids = encoding.encode_texts(docs)
    assert encoding.decode_texts(ids).first().text == long
    assert media.wav_features(docs).first().n_bytes == len(long.encode())
    pieces = packing.pack_documents(docs).collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens and sorted(p.start for p in pieces) == [4096 * i for i in range(len(pieces))]

"""Stages of the pipeline against brute force, and on odd tables."""

import random

import corpus_pipeline

from .helpers import awkward, documents, words


def test_stage_drops_pairs_between_80_and_85(spark):
    rng = random.Random(3)
    rows = []
    for i, (n, changed) in enumerate([(104, 9), (104, 11), (300, 6), (300, 10), (604, 11)]):
        base = [f"{w}{k}" for k, w in enumerate(words(rng, n).split())]
        copy = [*base]
        if n == 104:
            copy = base[changed:]  # one end gone
        else:
            for k in range(changed):
                copy[5 + k * (n - 10) // changed] = f"new{k}"
        rows += [(2 * i, " ".join(base), "en"), (2 * i + 1, " ".join(copy), "en")]
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, _ in rows]
    alike = {2 * i + 1: len(sets[2 * i] & sets[2 * i + 1]) / len(sets[2 * i] | sets[2 * i + 1]) for i in range(len(rows) // 2)}
    assert any(0.8 <= x < 0.85 for x in alike.values()) and any(x < 0.8 for x in alike.values())
    docs = documents(spark, rows)
    kept = lambda frame: sorted(r.doc_id for r in frame.collect())
    assert kept(corpus_pipeline.drop_near_duplicates(spark, docs, "")) == sorted(i for i, _, _ in rows if alike.get(i, 0) < 0.8)
    assert kept(corpus_pipeline.dedup.keep_one_of_each(docs)) == sorted(i for i, _, _ in rows if alike.get(i, 0) < 0.85)


def test_stages_take_empty_tables_and_clashing_columns(spark):
    clash = ("rep", "family", "kept", "component_id", "spans", "registers", "length", "start", "lang_pred", "rejected")
    for rows in ([], awkward()):
        docs = documents(spark, rows, clash)
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, "")
            told = found.collect()
            if name != "packing":
                assert found.columns == docs.columns
            if name == "personal_data":
                assert len(told) == len(rows)
            assert bool(rows) or not told

"""Recall of the neighbour search on a table larger than the sample, with uneven norms, and what it costs."""

import numpy as np

from tandem.llm import neighbours


def uneven(n=20_000, dim=64, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(200, dim))
    x = (centres[rng.integers(0, 200, n)] + 0.5 * rng.normal(size=(n, dim))) * rng.uniform(0.5, 2, size=(n, 1))
    x[neighbours.SAMPLE + 5] *= 12  # a long vector
    return x


def test_recall_and_probed_share_with_uneven_norms(spark):
    x = uneven()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    seen = []
    original = neighbours.fitted
    try:
        neighbours.fitted = lambda *a, **more: seen.append(original(*a, **more)) or seen[-1]
        found = neighbours.nearest(frame, frame.where("vec_id % 100 = 0")).select("query_id", "vec_id").toPandas()
    finally:
        neighbours.fitted = original
    coder = seen[0]
    assert abs(coder.norm - float(np.sqrt((x**2).sum(axis=1).max()))) < 1e-9
    got = {q: set(g) for q, g in found.groupby("query_id")["vec_id"]}
    codes, hits, share = coder.rows(x), [], []
    for q in range(0, len(x), 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits.append(len(got[q] & set(np.argsort(-score)[:20].tolist())) / 20)
        share.append((neighbours.distances(coder.queries(x[q : q + 1]), codes) <= coder.reach).any(axis=1).mean())
    assert np.mean(hits) >= 0.9
    assert np.mean(share) < 0.25


def answers(spark, rows, parts, sample=None):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts, "vec_id")
    more = {} if sample is None else {"sample": sample}
    return sorted(tuple(r) for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), **more).collect())


def test_answers_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 16)))]
    assert answers(spark, rows, 3, 400) == answers(spark, rows[::-1], 7, 400)


def test_ties_give_no_flood_of_pairs(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(1200):
        v = np.zeros(128)
        v[rng.choice(128, 2, replace=False)] = rng.integers(1, 3, 2)
        rows.append((i, v.tolist()))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = neighbours.classes(neighbours.usable(frame), "vectors")
    asked = neighbours.classes(neighbours.usable(frame.where("vec_id % 20 = 0")), "queries")
    n, m = index.count(), asked.count()
    pairs = neighbours.compared(index, asked, n, m, 20)
    assert pairs.count() <= 21 * m * max(1, -(-n // neighbours.BLOCK))
    found = neighbours.ranked(pairs, index, asked, neighbours.usable(frame), neighbours.usable(frame.where("vec_id % 20 = 0")), 20)
    got = sorted(tuple(r) for r in found.collect())
    x = np.array([v for _, v in rows])
    for q in range(0, 1200, 20):
        score = x @ x[q]
        order = [j for j in sorted(range(1200), key=lambda j: (-score[j], j)) if j != q][:20]
        assert [(g[2], g[3]) for g in got if g[0] == q] == [(j, score[j]) for j in order]

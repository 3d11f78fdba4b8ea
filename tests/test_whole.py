"""Queries without SQL twins against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.plans import whole
from tandem.sources.fixtures import cells as cells_of


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_distance_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert X.edit_distance(a, b) == brute_distance(a, b)


def test_distance_of_many_distinct_tokens(spark):
    a = [f"w{i}" for i in range(7000)]
    b = ["new", *a[:3000], *a[3002:], "end"]
    frame = spark.createDataFrame([(1, a, b), (2, ["x", "y"], ["y"]), (3, None, ["y"])], "k int, a array<string>, b array<string>")
    assert sorted(tuple(r) for r in frame.select("k", X.token_distance(F.col("a"), F.col("b"))).collect()) == [(1, 4), (2, 1), (3, None)]


def test_edits_of_whole_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    base = [word() for _ in range(400)]
    turns = [(0, " ".join(base)), (1, " ".join(base[:390]) + " one, two"), (2, " ".join(["x", *base])), (3, None), (4, "Alone"), (7, "alone !")]
    rows = [(9, t, text) for t, text in turns] + [(8, 0, "one turn")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, text string")
    found = sorted(tuple(r) for r in whole.edit_features_of(frame, "conv_id", "turn").collect())
    expected = []
    for (i, a), (j, b) in zip(turns, turns[1:]):
        if a is not None and b is not None:
            x, y = (re.findall(r"\w+|[^\w\s]", t.lower()) for t in (a, b))
            expected.append((9, i, j, brute_distance(x, y), round(brute_distance(x, y) / max(len(x), len(y)), 9)))
    assert found == expected and found[0][3] > 0


def test_long_edit_distances_are_exact_and_quick(spark):
    import time

    rng = random.Random(5)
    for n, m, kinds in ((0, 9, 3), (64, 65, 4), (300, 280, 9), (200, 1, 2), (129, 128, 50)):
        a, b = ([rng.randrange(kinds) for _ in range(k)] for k in (n, m))
        assert X.edit_distance(a, b) == X.edit_distance(b, a) == brute_distance(a, b)
    a = [f"w{rng.randrange(900)}" for _ in range(6000)]
    b = [w if rng.random() < 0.7 else f"w{rng.randrange(900)}" for w in a if rng.random() < 0.9]
    frame = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").select(X.tokens(F.col("a")).alias("x"), X.tokens(F.col("b")).alias("y"))
    told = frame.select(X.token_distance(F.col("x"), F.col("y")))
    first = told.first()[0]
    start = time.perf_counter()
    assert told.first()[0] == first and time.perf_counter() - start < 3
    assert abs(len(a) - len(b)) <= first <= 3000


def test_flips_are_exact_up_to_twenty_clusters(spark):
    from tandem.operators import resampling

    rng = random.Random(7)
    for n in (0, 1, 5, 15):
        each = [rng.randint(-3, 3) / 3 for _ in range(n)]
        k = sum(abs(sum(s * x for s, x in zip(signs, each, strict=True))) >= abs(sum(each)) - 1e-9 for signs in itertools.product((1, -1), repeat=n))
        found = resampling.sign_flip(spark.createDataFrame(list(enumerate(each)), "c int, effect double"), "c", 500).first()
        assert tuple(found) == ((None, 0, 0) if n == 0 else (k / 2**n, 2**n, n))


def test_drawn_flips_follow_their_digests(spark):
    import hashlib

    from tandem.operators import resampling

    rng = random.Random(8)
    each = [rng.gauss(0.1, 1) for _ in range(300)]
    k = 0
    for draw in range(5000):
        bits = "".join(f"{int(hashlib.md5(f'3|{draw}|{block}'.encode()).hexdigest(), 16):0128b}" for block in range(3))
        k += abs(sum(-x if bit == "1" else x for x, bit in zip(each, bits, strict=False))) >= abs(sum(each)) - 1e-9
    frame = spark.createDataFrame(list(enumerate(each)), "c int, effect double").repartition(5)
    assert tuple(resampling.sign_flip(frame, "c", 5000, seed=3).first()) == ((k + 1) / 5001, 5000, 300)


def test_rejected_draws_are_drawn_again(spark):
    from tandem.operators import resampling, studies

    # a draw that has one page alone has no deviation: half of the draws of two pages
    sums = spark.createDataFrame([("p", 2, 3.0, 1.5, 0.5, 0.25, 4.0, 8.0), ("q", 2, 1.0, 0.5, -0.5, -0.25, 8.0, 32.0)], "page string, n long, delta_sum double, delta_mean double, up_sum double, up_mean double, reference_sum double, reference_squares double")
    assert {r.valid_draws for r in studies.scale_bootstrap(sums, "page", 300).collect()} == {300}
    valid = lambda times: times.rows().groupBy("draw").agg(F.count(F.lit(1)).alias("pages")).where("pages = 2")
    kept = [r.draw for r in resampling.redrawn(sums, "page", 300, valid, 1000).collect()]
    drawn = resampling.multiplicities(sums, "page", 2000).rows().groupBy("draw").count().where("count = 2").orderBy("draw").limit(300).collect()
    assert sorted(kept) == [r.draw for r in drawn] and max(kept) > 500
    with pytest.raises(ValueError, match="rejected"):
        studies.scale_bootstrap(sums.where("page = 'p'"), "page", 20)
    rows = spark.createDataFrame([("p", "a", "a"), ("q", "b", "a")], "page string, gold string, said string")
    assert {r.valid_draws for r in studies.joint_bootstrap(rows, "page", "gold", {"x": "said"}, 2, 200).collect()} == {200}
    with pytest.raises(ValueError, match="rejected"):
        studies.joint_bootstrap(rows.where("page = 'p'"), "page", "gold", {"x": "said"}, 2, 10)


def test_draws_are_the_same_as_sums_and_as_rows(spark, monkeypatch):
    import hashlib

    from tandem.operators import resampling

    rng = random.Random(9)
    names = [f"c{i:03}" for i in range(57)]
    values = {c: (rng.random(), rng.randint(0, 9)) for c in names[:50]}  # some clusters have no values
    clusters = spark.createDataFrame([(c,) for c in names], "c string")
    frame = spark.createDataFrame([(c, *v) for c, v in values.items()], "c string, x double, `y|z` int")
    draws = resampling.multiplicities(clusters, "c", 40, seed=5, first=3)
    expected = {}
    for draw in range(3, 43):
        taken = [names[int(hashlib.md5(f"5|{draw}|{slot // 4}".encode()).hexdigest()[8 * (slot % 4) :][:8], 16) % 57] for slot in range(57)]
        expected[draw] = tuple(sum(values.get(c, (0, 0))[k] for c in taken) for k in (0, 1))
    found = {r.draw: tuple(r)[1:] for r in draws.sums(frame, ["x", "y|z"]).collect()}
    assert found.keys() == expected.keys() and all(found[d] == pytest.approx(expected[d]) for d in expected)
    ends = lambda by: sorted(tuple(r) for r in resampling.bootstrap_interval(frame.withColumn("g", F.col("`y|z`") % 3), "c", draws, by, "x").collect())
    held = ends(("g",)), ends(())
    monkeypatch.setattr(resampling, "HELD", 1)
    monkeypatch.setattr(resampling, "WIDE", 1)
    again = {r.draw: tuple(r)[1:] for r in draws.sums(frame, ["x", "y|z"]).collect()}
    assert all(again[d] == pytest.approx(expected[d]) for d in expected)
    assert [x for rows in (ends(("g",)), ends(())) for r in rows for x in r] == pytest.approx([x for rows in held for r in rows for x in r])


def test_digests_are_streamed_in_order(spark):
    import hashlib

    from tandem.operators import selection

    ids = [(g, i) for g in ("a", None, "b") for i in random.Random(3).sample(range(3000), 700)] + [("a", None)]
    found = {r.g: (r.ids, r.digest) for r in selection.id_digest(spark.createDataFrame(ids, "g string, id int").repartition(6), "id", ("g",)).collect()}
    for g in ("a", None, "b"):
        own = sorted(str(i) for h, i in ids if h == g and i is not None)
        assert found[g] == (700, hashlib.sha256("".join(f"{i}\n" for i in own).encode()).hexdigest())
    whole_list = selection.id_digest(spark.createDataFrame(ids, "g string, id int"), "id").collect()
    assert [(r.ids, r.digest) for r in whole_list] == [(2100, hashlib.sha256("".join(f"{i}\n" for i in sorted(str(i) for _, i in ids if i is not None)).encode()).hexdigest())]


def test_large_quotas_are_ranked_over_ranges(spark, monkeypatch):
    from tandem.operators import selection

    rows = spark.createDataFrame([(i, i % 17, "xyz"[i % 3] if i % 11 else None) for i in range(1200)], "k int, c int, s string")
    pick = lambda **more: sorted(map(tuple, selection.round_robin(rows, "k", "c", 4, **more).collect()), key=str)
    few, alone = pick(stratum="s", total=400), pick(total=90)
    assert len(alone) == 90 and sorted(x[2] for x in alone) == list(range(1, 91))
    monkeypatch.setattr(selection, "FEW", 3)
    assert pick(stratum="s", total=400) == few and pick(total=90) == alone
    plan = selection._first(rows, ["s"], ["k"], "place", 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and after the shuffle


def test_ten_thousand_draws(spark, sf_dir):
    found = whole.QUERIES["bootstrap_interval_whole"](spark, sf_dir).first()
    assert found.valid_draws == 10_000 and found.lower < found.upper


def test_all_cells_are_paired(spark, sf_dir):
    cells = cells_of(spark, sf_dir).collect()
    only = [sum((c.base_pred == c.gold) == left and (c.treat_pred == c.gold) != left for c in cells) for left in (True, False)]
    found = whole.QUERIES["mcnemar_whole"](spark, sf_dir).first()
    assert [found.only_left, found.only_right] == only
    assert found.statistic == round(max(abs(only[0] - only[1]) - 1, 0) ** 2 / sum(only), 6) and 0 <= found.p <= 1
    status = {r.case_id: r.status for r in whole.QUERIES["paired_cases_whole"](spark, sf_dir).collect()}
    assert status == {c.case_id: "ok" if all(x.treat_ok for x in group) else "only_left" for group in _cases(cells) for c in group[:1]}


def _cases(cells):
    return [list(g) for _, g in itertools.groupby(sorted(cells, key=lambda c: c.case_id), key=lambda c: c.case_id)]

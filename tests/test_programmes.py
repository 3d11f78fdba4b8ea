"""Contexts and repeated runs: numbers by hand and every failure."""

import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tandem.operators import contexts, repeats


def test_series_of_repeats(spark):
    rows = [([1.0, 2.0, 3.0],), ([-1.0, 1.0],), ([0.0, 0.0],), ([1e-13, 1.0],), ([2.0, None],), ([],), ([-4.0, -5.0],), ([0.5, 0.7],)]
    frame = spark.createDataFrame(rows, "v array<double>").select("v", repeats.series(F.col("v")).alias("s"), repeats.series(F.col("v"), 0.5).direction_stable.alias("half"))
    found = {tuple(r.v): (*r.s, r.half) for r in frame.collect()}
    assert found == {
        (1.0, 2.0, 3.0): (2.0, 2.0, True, True), (-1.0, 1.0): (2.0, 2.0, False, False), (0.0, 0.0): (0.0, None, True, True), (1e-13, 1.0): (1.0 - 1e-13, None, True, False),
        (2.0, None): (None, None, None, None), (): (None, None, None, None), (-4.0, -5.0): (1.0, 0.25, True, True), (0.5, 0.7): (pytest.approx(0.2), pytest.approx(0.4), True, False),
    }


def test_a_unit_needs_every_repeat_once(spark):
    rows = [("m", u, k, 1.0 + u, "A") for u in range(3) for k in (1, 2, 3)]
    names = "model string, unit int, repeat int, score double, label string"
    report = lambda more: {r.model: r for r in repeats.span_report(spark.createDataFrame(more, names), ["model"], "unit", "repeat", 3, "score", "label").collect()}["m"]
    same = report(rows)
    assert (same.units, same.largest, same.flips, same.outcome) == (3, 0.0, 0, "identical_outputs")
    drift = report([(*r[:3], r[3] + 1e-7 * (r[2] == 2), r[4]) for r in rows])
    assert drift.outcome == "within_engineering_threshold" and drift.largest == pytest.approx(1e-7, rel=1e-6) and drift.largest_ratio == pytest.approx(1e-7, rel=1e-6)
    assert report([(*r[:3], r[3] + (r[2] == 2), r[4]) for r in rows]).outcome == "requires_investigation"
    turned = report([(*r[:4], "B" if r[1:3] == (1, 3) else "A") for r in rows])
    assert (turned.flips, turned.flip_rate, turned.outcome) == (1, pytest.approx(1 / 3), "requires_investigation")
    for broken in (rows[1:], rows + rows[:1]):
        with pytest.raises(Exception, match="lacks a repeat"):
            report(broken)


def test_route_effects_run_by_run(spark):
    rows = [(m, r, k, c, c % 3, (c * 7 % 5) + {"a": 0.5, "f": 0.0}[r] * (1 if m == "x" else -1) * k) for m in "xy" for r in "af" for k in (1, 2) for c in range(10)]
    names = "model string, route string, repeat int, case int, page int, value double"
    effects = repeats.route_effects(spark.createDataFrame(rows, names), "model", "route", "repeat", 2, "case", "page", "value", {"a-f": ("a", "f")})
    found = {(r.model, r.weighting, r.endpoint): r for r in effects.collect()}
    sd = statistics.stdev(c * 7 % 5 for c in range(10))
    for weighting in ("page_balanced", "case_weighted"):
        assert found["x", weighting, "difference"]["values"] == pytest.approx([0.5, 1.0]) and found["y", weighting, "standardised"]["values"] == pytest.approx([-0.5 / sd, -1.0 / sd])
        assert found["x", weighting, "directional"]["values"] == [1.0, 1.0] and found["y", weighting, "directional"].direction_stable
    cross = {(r.weighting, r.endpoint): r for r in repeats.cross_effects(effects, [("x", "y")]).collect()}
    assert cross["page_balanced", "directional"]["values"] == [1.0, 1.0] and cross["case_weighted", "standardised"].span == pytest.approx(1 / sd) and len(cross) == 4
    with pytest.raises(Exception, match="lacks a route"):
        repeats.route_effects(spark.createDataFrame(rows[1:], names), "model", "route", "repeat", 2, "case", "page", "value", {"a-f": ("a", "f")}).collect()


def test_context_effects_by_hand(spark):
    rows = [("gold", q, k % 2 == 0, (q + k) % 3 > 0, None if (q + k) % 4 == 0 else 0.1 * q - 0.3, None if k == 2 else 0.05 * k) for q in range(6) for k in range(3)]
    names = "kind string, query int, a boolean, b boolean, x double, y double"
    frame = spark.createDataFrame(rows, names)
    report = lambda f: {r.metric: r for r in contexts.context_effects(f, "query", "kind", ["gold"], ("a", "b"), ("x", "y"), 300, 100).collect()}
    found = report(frame)
    hit = [statistics.fmean(r[3] - r[2] for r in rows if r[1] == q) for q in range(6)]
    assert found["binary"].estimate == pytest.approx(statistics.fmean(hit)) and (found["binary"].clusters, found["binary"].pairs, found["binary"].total) == (6, 18, 18)
    extreme = sum(abs(math.fsum(s * x for s, x in zip(signs, hit, strict=True))) >= abs(math.fsum(hit)) - 1e-9 for signs in itertools.product((1, -1), repeat=6))
    assert found["binary"].p == extreme / 64 and found["binary"].lower <= found["binary"].estimate <= found["binary"].upper
    pairs = [r for r in rows if r[4] is not None and r[5] is not None]
    use = [statistics.fmean(r[5] - r[4] for r in pairs if r[1] == q) for q in sorted({r[1] for r in pairs})]
    told = found["continuous"]
    assert told.estimate == pytest.approx(statistics.fmean(use)) and (told.clusters, told.pairs, told.total) == (len(use), len(pairs), 18)
    low = statistics.fmean(statistics.fmean((-1 if r[5] is None else r[5]) - (1 if r[4] is None else r[4]) for r in rows if r[1] == q) for q in range(6))
    assert told.least == pytest.approx(low) and told.least <= told.estimate <= told.most
    empty = report(frame.withColumn("x", F.lit(None).cast("double")))["continuous"]
    assert (empty.estimate, empty.clusters, empty.pairs, empty.total) == (None, 0, 0, 18)
    for broken in (frame.where("kind = 'none'"), frame.withColumn("a", F.when(F.col("query") > 0, F.col("a")))):
        with pytest.raises(ValueError, match="context kind gold"):
            report(broken)


def test_coverage_counts_pairs(spark):
    frame = spark.createDataFrame([("g", True, True, None, True), ("g", True, False, True, True), ("i", None, None, None, None)], "kind string, a boolean, b boolean, c boolean, d boolean")
    found = {(r.kind, r.stage): (r.left_ok, r.right_ok, r.paired_ok, r.total) for r in contexts.coverage(frame, "kind", {"hard": ("a", "b"), "probability": ("c", "d")}).collect()}
    assert found == {("g", "hard"): (2, 1, 1, 2), ("g", "probability"): (1, 2, 1, 2), ("i", "hard"): (0, 0, 0, 1), ("i", "probability"): (0, 0, 0, 1)}

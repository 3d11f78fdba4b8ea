"""Draws and flips of any number of clusters: digests at once, times by blocks, several columns under the same flips."""

import hashlib
import random

import numpy as np
import pytest

from tandem.functions import digests
from tandem.operators import resampling
from tandem.plans import procedures, studies


@pytest.mark.parametrize(("head", "tail", "numbers"), [("20260711|7|", "", range(0, 20000)), ("x|", "|41", range(95, 1205)), ("", "", range(9, 11)), ("a" * 40, "b" * 13, range(98, 102)), ("a" * 40, "b" * 20, range(0, 12)), ("é|", "|", range(10**9 - 2, 10**9 + 2)), ("s|", "", range(5, 5))])
def test_digests_of_numbers_are_those_of_hashlib(head, tail, numbers):
    found = digests.numbered_md5(head, numbers, tail)
    assert [row.tobytes() for row in found] == [hashlib.md5(f"{head}{k}{tail}".encode()).digest() for k in numbers]


def test_digests_come_by_runs_of_the_last_digits():
    """One run for many numbers, of which only the last digits are columns; the first words of a message cost nothing for each number."""
    heads = ["20260711|7|", "x|", "ab", "a" * 45]
    for head in heads:
        numbers = range(99_990, 252_345)
        runs = [(at, np.column_stack(words).view(np.uint8)) for at, words in digests.numbered_words(head, numbers)]
        assert len(runs) <= 10 and max(len(told) for _, told in runs) == digests.RUN
        assert [at for at, _ in runs] == [numbers.start, *np.cumsum([len(told) for _, told in runs])[:-1] + numbers.start]
        assert all(told[k].tobytes() == hashlib.md5(f"{head}{at + k}".encode()).digest() for at, told in runs for k in range(0, len(told), 997))


def test_places_are_counted_in_bytes_and_never_wrap(monkeypatch):
    for n in (1, 7, 1000, 70_001):
        slots = [int(hashlib.md5(f"5|3|{s // 4}".encode()).hexdigest()[s % 4 * 8 : s % 4 * 8 + 8], 16) % n for s in range(n)]
        told = resampling._times(n, 5, 3)
        assert told.dtype == np.uint8 and told.tolist() == np.bincount(slots, minlength=n).tolist()
    monkeypatch.setattr(resampling, "numbered_words", lambda head, numbers, tail="": iter([(numbers.start, [np.zeros(len(numbers), np.uint32)] * 4)]))
    assert resampling._times(600, 5, 3).tolist() == [600] + [0] * 599


def test_intervals_read_their_cells_once(spark, sf_dir, monkeypatch):
    """Names and values of the clusters come from one written table, not from two runs over all lines."""
    for plans, name in ((procedures, "bootstrap_interval"), (studies, "accuracy_interval")):
        monkeypatch.setattr(plans, "DRAWS", 20)
        kept, before = [], resampling.multiplicities
        monkeypatch.setattr(resampling, "multiplicities", lambda frame, *a, **b: kept.append(frame) or before(frame, *a, **b))
        plans.QUERIES[name](spark, sf_dir).collect()
        monkeypatch.setattr(resampling, "multiplicities", before)
        assert "l_orderkey" not in kept[0]._jdf.queryExecution().optimizedPlan().toString()


def test_layers_add_up():
    times = np.array([0, 15, 16, 40, 3])
    layers = list(resampling._layers(times))
    assert all(layer.max() <= 15 for layer in layers) and sum(x.astype(int) for x in layers).tolist() == times.tolist()


def test_values_beyond_what_a_task_may_hold_meet_their_draws_by_blocks(spark, monkeypatch):
    rng = random.Random(4)
    n = resampling.PLACES + 1203
    frame = spark.createDataFrame([(i, rng.random(), float(i % 7)) for i in range(n) if i % 5], "c long, x double, y double")
    draws = resampling.multiplicities(spark.range(n).withColumnRenamed("id", "c"), "c", 35, seed=8)
    held = {r.draw: tuple(r)[1:] for r in draws.sums(frame, ["x", "y"]).collect()}
    monkeypatch.setattr(resampling, "HELD", 1)
    monkeypatch.setattr(resampling, "DIGESTS", 1000)
    frames = draws.sums(frame, ["x", "y"])
    found = {r.draw: tuple(r)[1:] for r in frames.collect()}
    assert found.keys() == held.keys() and all(found[d] == pytest.approx(held[d]) for d in held)
    assert "Join" not in frames._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]  # no row for each draw and cluster
    alone = resampling.multiplicities(spark.range(1).withColumnRenamed("id", "c"), "c", 3, seed=8)
    assert [tuple(r) for r in alone.sums(spark.createDataFrame([(0, 2.5)], "c long, x double"), ["x"]).orderBy("draw").collect()] == [(0, 2.5), (1, 2.5), (2, 2.5)]


def test_columns_share_their_flips(spark):
    rng = random.Random(2)
    for n in (9, 300):
        frame = spark.createDataFrame([(i, rng.gauss(0.05, 1), None if i % 6 == 0 else rng.gauss(0, 1)) for i in range(n)], "c long, x double, y double")
        both = {r.of: (r.p, r.draws, r.clusters) for r in resampling.sign_flips(frame, "c", 20000, ["x", "y"]).collect()}
        assert both == {i: tuple(resampling.sign_flip(frame, "c", 20000, v).first()) for i, v in enumerate("xy")}
    signs = lambda draw: [1 - 2 * (byte >> (7 - i) & 1) for b in range(3) for byte in hashlib.md5(f"{resampling.SEED}|{draw}|{b}".encode()).digest() for i in range(8)]
    x = np.array([r.x for r in frame.orderBy("c").collect()])
    k = sum(abs(np.dot(signs(draw)[:300], x)) >= abs(x.sum()) - 1e-9 for draw in range(500))
    assert resampling.sign_flip(frame, "c", 500, "x").first().p == pytest.approx((k + 1) / 501)

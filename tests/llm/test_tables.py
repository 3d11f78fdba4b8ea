"""Operators 3, 5, 8, 9 and 10 against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tandem.llm import components, dedup, neighbours, sharding, urlfilter, warc
from tandem.llm.common import written

from .helpers import awkward, documents, words


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    nodes = defaultdict(set)
    for i, text, _ in rows:
        if i is not None:
            nodes[i].add(shingle_set(text))
    up = {i: i for i in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(nodes), 2):
        if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in nodes[a] for y in nodes[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in nodes}


def near_copies(seed=8):
    rng = random.Random(seed)
    rows, n = [*awkward()], 100
    for group in range(8):
        base = words(rng, rng.choice([12, 60, 200, 600])).split()
        for _ in range(rng.randint(2, 14)):
            copy = [*base]
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            text = " ".join(copy)
            rows.append((n, text.upper() if rng.random() < 0.1 and text.isascii() else text, "en"))
            n += 1
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_copies()
    found = dedup.near_duplicates(documents(spark, rows, ("rep", "band", "kept", "registers"))).collect()
    expected = brute_components(rows)
    assert len(found) == len(rows)
    sizes = Counter((i, len(shingle_set(t))) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_shingles) for r in found) == sizes
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_one_of_each_component_stays(spark):
    rows = near_copies(9)
    docs = documents(spark, rows, ("dropped", "possible"))
    expected = brute_components(rows)
    kept = dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(expected.values())
    assert kept.where("doc_id IS NULL").count() == 2


def test_no_documents(spark):
    empty = documents(spark, [])
    assert dedup.near_duplicates(empty).count() == 0
    assert dedup.keep_one_of_each(empty).count() == 0
    assert sharding.histogram_sort(sharding.sort_keys(empty)).count() == 0


def test_large_buckets_and_families_are_dealt_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(dedup, "FAMILY_BLOCK", 5)
    monkeypatch.setattr(dedup, "LEADERS", 1)
    rows = near_copies(10)
    found = dedup.near_duplicates(documents(spark, rows)).collect()
    expected = brute_components(rows)
    assert all(r.component_id == expected[r.doc_id] for r in found if r.doc_id is not None)


def test_families_that_do_not_hang_together(spark, monkeypatch):
    """Copies about as far from one another as links allow: many pairs of a family are no links."""
    monkeypatch.setattr(dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(dedup, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(dedup, "LEADERS", 2)
    rng = random.Random(12)
    base = words(rng, 400).split()
    rows = []
    for n in range(120):
        copy = [*base]
        for at in rng.sample(range(0, 400, 5), rng.choice([3, 6, 7, 8])):
            copy[at] = words(rng, 1) + str(n)
        rows.append((n, " ".join(copy), "en"))
    found = {r.doc_id: r.component_id for r in dedup.near_duplicates(documents(spark, rows)).collect()}
    expected = brute_components(rows)
    assert found == expected and 1 < len(set(expected.values())) < 120


def test_a_family_of_thousands_of_near_copies(spark):
    rng = random.Random(13)
    base = words(rng, 200).split()
    rows = [(7 + n, " ".join([*base[: (at := rng.randrange(200))], f"w{n}", *base[at + 1 :]]), "en") for n in range(5000)]
    rows += [(n, words(rng, 200), "en") for n in range(6000, 6050)] + [(3, rows[70][1], "en")]
    found = {r.doc_id: r.component_id for r in dedup.near_duplicates(documents(spark, rows)).collect()}
    assert found == {**{i: 3 for i, _, _ in rows if i < 6000}, **{i: i for i in range(6000, 6050)}}


def test_rows_that_share_a_doc_id_are_one_document(spark):
    rng = random.Random(14)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = " ".join([*c.split()[:58], "x", "y"])
    rows = [(5, a, "en"), (7, a, "en"), (3, b, "en"), (5, b, "en"), (9, c, "en"), (8, near, "en"), (5, near, "en"), (2, words(rng, 60), "en")]
    found = {(r.doc_id, r.component_id) for r in dedup.near_duplicates(documents(spark, rows)).collect()}
    assert found == {(i, brute_components(rows)[i]) for i, _, _ in rows} == {(5, 3), (7, 3), (3, 3), (9, 3), (8, 3), (2, 2)}


def test_frequent_keys_are_joined_like_others(spark, monkeypatch):
    from tandem.llm import common

    monkeypatch.setattr(common, "FREQUENT_ROWS", 5)
    rows = spark.createDataFrame([(k % 7 if k % 3 else 0, k) for k in range(100)] + [(None, 100), (50, 101)], "k long, v long")
    found = rows.where("k < 5").groupBy("k").count().withColumn("w", common.F.col("k") * 2)
    for how in ("inner", "left"):
        told = {tuple(r) for r in common.by_key(rows, found, ["k"], "count", how).select("k", "v", "w").collect()}
        assert told == {tuple(r) for r in rows.join(found, "k", how).select("k", "v", "w").collect()}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    b = np.concatenate([a[:2400], np.unique(rng.integers(0, 2**64, 600, dtype=np.uint64))])
    ra, rb, both = dedup.registers([np.sort(a), np.sort(b), np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()
    e = dedup.estimate(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
    assert abs(e - 2400 / 3600) < 0.15


def test_components_of_a_chain_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    found = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 201: 200}


def expected_shards(rows, shards=8):
    keyed = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), -(2**63) if i is None else i, len((t or "").encode()) + 1, i, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    total, before, out, slots = sum(k[2] for k in keyed), 0, [], Counter()
    at = 0
    while at < len(keyed):
        same = [k for k in keyed[at:] if k[:2] == keyed[at][:2]]
        shard = before * shards // total
        for k in same:
            out.append((k[3], k[2], k[4], shard, slots[shard]))
            slots[shard] += 1
        before, at = before + sum(k[2] for k in same), at + len(same)
    return out


@pytest.mark.parametrize("hot", [0, 300])
def test_histogram_sort_equals_a_global_sort(spark, hot):
    rng = random.Random(3)
    rows = [*awkward(), *((50 + i, words(rng, rng.randint(1, 40)), "en") for i in range(200)), *((1000 + i, "hot text of many copies", "en") for i in range(hot))]
    keys = written(sharding.sort_keys(documents(spark, rows, ("key", "size", "shard"))), "test-keys")
    found = [tuple(r) for r in sharding.histogram_sort(keys, rows_per_range=20).select("doc_id", "size", "text_crc32", "shard", "slot").collect()]
    assert sorted(found, key=repr) == sorted(expected_shards(rows), key=repr)


def brute_verdict(pages, links):
    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        return rest[:cut].lower(), path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]

    def rule(url):
        host, path = split(url)
        fit = [(len(h) + len(p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else (None, None)

    group = {}
    for a, b in links:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    out = []
    for i, url, _ in pages:
        name, verdict = rule(url)
        if verdict is None:
            told = {rule(x)[1] for x in group.get((url or "").split("#")[0], ())}
            verdict = "block" if "block" in told and "allow" not in told else "allow"
        out.append((i, *split(url), name, verdict))
    return sorted(out, key=repr)


def test_url_rules_spread_over_aliases(spark):
    pages = [
        (1, "https://a.b.com/x", '<LINK href="https://q.foo.net/y" REL="canonical">'), (2, "https://a.b.com/x#frag", None), (3, "http://z.org/fr/1", '<meta http-equiv="refresh" content="0; url=/plain">'),
        (4, "http://z.org/plain", "<link rel='canonical' href='https://www.example.com/de/9'>"), (5, None, None), (6, "nourl", ""), (7, "https://net", ""), (8, "https://NET/", ""), (9, "http://x.example.net/en/1", ""),
        (10, "http://example.net/enough", ""), (11, "http://c.com/1", '<link rel=canonical href=http://c.com/2>'), (11, "http://c.com/1", '<link rel=canonical href=http://c.com/2>'), (12, "http://c.com/3", ""), (None, "http://c.com/3?q#f", ""),
    ]
    links = [("https://a.b.com/x", "https://q.foo.net/y"), ("http://z.org/fr/1", "http://z.org/plain"), ("http://z.org/plain", "https://www.example.com/de/9"), ("http://c.com/1", "http://c.com/2"), ("http://c.com/3", "http://c.com/2"), ("http://c.com/2", "http://spam.net/")]
    redirects = spark.createDataFrame([("http://c.com/3", "http://c.com/2"), ("http://c.com/2", "http://spam.net/"), (None, "http://c.com/1")], "source string, target string")
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    found = sorted((tuple(r) for r in urlfilter.filter_urls(frame, redirects).collect()), key=repr)
    assert found == brute_verdict(pages, links)
    assert urlfilter.filter_urls(frame.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "<html>" + "é" * 60
    pages = [(3, "http://a/1", big), (1, "http://a/2", big), (2, None, big), (4, "http://a/4\r\nX: y", "small"), (5, "http://a/5", "small"), (6, "http://a/6", None), (7, "u", "\r\n\r\n" * 40), (7, "u", "\r\n\r\n" * 40), (None, "n", big), (8, "z", "")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = warc.archive_folder(spark)
    index = warc.write_archives(frame, folder)
    found = sorted((tuple(r) for r in warc.read_records(index, folder).collect()), key=repr)
    first = {}
    for i, _, h in pages:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    expected = []
    for i, u, h in pages:
        b = (h or "").encode()
        refers = first[b] if i is not None and len(b) >= 100 and first[b] != i else None
        expected.append((i, u, len(b), hashlib.sha256(b).hexdigest(), "response" if refers is None else "revisit", refers))
    assert found == sorted(expected, key=repr)
    some = warc.read_records(index.where("page_id IN (1, 4)"), folder)
    assert sorted(r.page_id for r in some.collect()) == [1, 4]
    assert warc.read_records(warc.write_archives(frame.limit(0), warc.archive_folder(spark)), folder).count() == 0


def brute_nearest(rows, k):
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in range(len(rows)):
        if ids[q] % 20 == 0:
            score = (x * x[q]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_neighbours_reach_recall_and_rank_exactly(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[700:900] = x[20]  # many copies of one vector, so that ties are many
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(len(x))]
    rows += [(2000, None), (2020, [0.0] * 32), (2040, [float("nan")] * 32), (2060, [None] + [1.0] * 31), (None, [1.0] * 32), (40, rows[40][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    found = defaultdict(list)
    for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    expected = brute_nearest(rows, 20)
    assert found.keys() == expected.keys()
    hits = 0
    for q, best in expected.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        hits += len({v for v, _ in best} & {v for _, v, _ in got})
    assert hits / (20 * len(expected)) >= 0.9
    tied = sorted(found[20])
    assert [v for _, v, _ in tied] == list(range(700, 720))


def test_neighbours_of_few_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0")).collect())
    assert found == [(0, 1, 20, 4.0), (0, 2, 3, 0.0), (20, 1, 0, 4.0), (20, 2, 3, -1.5)]
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).count() == 0
    one = frame.where("vec_id = 0")
    assert neighbours.nearest(one, one).count() == 0


def retrieved_pairs(coder, lead, codes, asked):
    """What all cells of all substrings retrieve, and what of it is kept."""
    every, kept = set(), []
    for part in range(coder.parts):
        for prefix in range(1 << lead):
            rows = np.flatnonzero(codes[:, part].astype(int) >> (neighbours.BITS - lead) == prefix)
            for i, j in neighbours.probed(coder, part, prefix, lead, codes[rows], asked):
                every |= set(zip(i.tolist(), rows[j].tolist()))
                near = neighbours.kept(coder, part, codes[rows], asked, i, j)
                kept += zip(i[near].tolist(), rows[j[near]].tolist())
    return every, kept


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, (8, 6), dtype=np.uint16)
    flips = np.packbits(rng.random((400, 6, 16)) < rng.uniform(0, 0.5, (400, 1, 1)), axis=2).view(np.uint16).reshape(400, 6)
    codes, queries = base[rng.integers(0, 8, 400)] ^ flips, base.copy()
    far = neighbours.distances(queries[:, None], codes[None])
    for reach, lead in ((0, 0), (1, 3), (2, 0), (2, 5), (3, 4)):
        coder = neighbours.Coder(None, None, 1.0, reach, 6, 6 * (reach + 1) + 8)
        every, kept = retrieved_pairs(coder, lead, codes, queries)
        assert every == {(i, j) for i, j in np.argwhere((far <= reach).any(axis=2)).tolist()}  # no pair outside the buckets
        within = {(i, j) for i, j in np.argwhere(far.sum(axis=2) <= 6 * (reach + 1) - 1).tolist()}
        assert within and within <= set(kept)  # pigeonhole
        assert len(kept) == len(set(kept)) and set(kept) == {(i, j) for i, j in every if far[i, j].sum() <= coder.radius}


def test_large_cells_are_dealt_as_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 1200)] + 0.05 * rng.normal(size=(1200, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    told = lambda: sorted(tuple(r) for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0")).collect())
    whole = told()
    monkeypatch.setattr(neighbours, "CELL", 30)
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    dealt = told()
    expected = brute_nearest([(i, v.tolist()) for i, v in enumerate(x)], 20)
    for found in (whole, dealt):
        assert len(found) == 20 * len(expected)
        assert sum(v in {w for w, _ in expected[q]} for q, _, v, _ in found) >= 0.9 * len(found)


def test_vectors_of_several_lengths_take_part(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8 if i % 3 else 5 + i % 2 * 6).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    padded = [(i, (v + [0.0] * 11)[:11]) for i, v in rows]
    found = defaultdict(list)
    for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    expected = brute_nearest(padded, 20)
    scores = {(q, v): s for q in expected for v, s in ((j, float(np.dot(dict(padded)[q], x))) for j, x in padded)}
    assert found.keys() == expected.keys()
    assert all(abs(scores[q, v] - s) < 1e-9 for q, some in found.items() for _, v, s in some)
    assert sum(v in {w for w, _ in expected[q]} for q, some in found.items() for _, v, _ in some) >= 0.9 * 20 * len(expected)

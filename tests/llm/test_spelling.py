"""Operator 11 against brute force over deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter, defaultdict

from tandem.llm import spelling
from tandem.llm.automata import Automaton

from .helpers import awkward, documents, words


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    slots, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            slots[key].add(w)
    for members in slots.values():
        for a in members:
            near[a].update(b for b in members if one_apart(a, b))
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def brute_counts(rows):
    found = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def found_variants(spark, counts):
    return {tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}


def test_automata_number_words_and_find_one_error():
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    automaton = Automaton(names)
    assert len(automaton.edges) < len(names)
    for w in names:
        assert names[automaton._walked(automaton.start, w, 0, 0)[1]] == w
        for half in (0, len(w) // 2, len(w)):
            got = [names[i] for i in automaton.with_one_error(w[:half], w[half:])]
            assert len(got) == len(set(got))
            assert set(got) == {v for v in names if v[:half] == w[:half] and len(v) >= len(w) and one_apart(w[half:], v[half:])}
    assert list(Automaton([]).with_one_error("", "a")) == []


def test_words_long_prefixes_and_dense_groups(spark, monkeypatch):
    rng = random.Random(2)
    counts = {}
    for letters, most, prefix in (("ab", 9, ""), ("abc", 6, "everyonesprefix"), ("àbéç", 5, "ü")):
        for _ in range(300):
            counts[prefix + "".join(rng.choice(letters) for _ in range(rng.randint(5, most) if not prefix else rng.randint(4, most)))] = rng.randint(3, 300)
    for _ in range(8):
        long = "".join(rng.choice("xyz") for _ in range(rng.randint(120, 700)))
        for _ in range(5):
            i = rng.randrange(len(long))
            counts[long[:i] + rng.choice(["", "q", "qq", long[i]]) + long[i + 1 :]] = rng.randint(3, 300)
    expected = brute_variants(counts)
    assert found_variants(spark, counts) == expected
    monkeypatch.setattr(spelling, "GROUP", 20)
    assert found_variants(spark, counts) == expected


def test_blocks_do_not_matter(spark, monkeypatch):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 8))): rng.randint(3, 99) for _ in range(300)}
    rows = spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"))
    batches = rows.orderBy("forward", "group", "word").select("forward", "group", "word", "n", "asks", "deep", "head", "tail", "below").toArrow().to_batches()
    totals = []
    for block in (10, 100_000):
        monkeypatch.setattr(spelling, "BLOCK", block)
        near = Counter()
        for b in spelling._searched(iter(batches)):
            for w, n in zip(b.column("word").to_pylist(), b.column("n_near").to_pylist(), strict=True):
                near[w] += n
        totals.append(near)
    assert totals[0] == totals[1] == Counter({w: n for w, _, _, _, n, _ in brute_variants(counts) if n})


def test_odd_documents(spark, monkeypatch):
    rng = random.Random(4)
    rows = awkward() + [(100 + i, words(rng, 400), "en") for i in range(30)] + [(None, "Straße STRASSE naïve Naïve naive naives naivé " * 3, None)]
    docs = documents(spark, rows, ["word", "n", "form"])
    counts = brute_counts(rows)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == counts
    assert {tuple(r) for r in spelling.variants(spelling.word_counts(docs)).collect()} == brute_variants(counts)
    assert spelling.variants(spelling.word_counts(documents(spark, []))).count() == 0
    text = "Ab cdÉ  efg" * 50
    for piece in (1, 3, 1000):
        monkeypatch.setattr(spelling, "PIECE", piece)
        assert spelling.runs_of(text) == Counter(r.lower() if r.isascii() else "cdÉ" for r in re.findall("[A-Za-zÀ-ÿ]+", text))


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(40)], "word string, form string")
    assert {r.root for r in spelling.roots(links).collect()} == {"w40"}


def test_query_over_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in spelling.op11_halves_automata(spark, sf_dir).collect()} == brute_variants(brute_counts(rows))

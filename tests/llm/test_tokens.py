"""Operators 1 and 7 against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tandem.llm import packing
from tandem.llm.bpe import vocabulary_path
from tandem.llm.encoding import ByteLevelBPE, decode_texts, encode_digests, encode_texts

from .helpers import awkward, documents

PARTS = ["a", "b", "B", " ", "  ", "\n", "\t", "'s", "'LL", "é", "É", "ß", "1", "٣", "²", " ", " ", "\x1c", "\x85", "!", "<|endoftext|>", "<|ENDOFTEXT|>", "<|end", "日", "😀", "́", "e", "the", "ing", "Σ", "İ", "ª", "ﬁ", ",", "..", "ǅ", "_", "-"]


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_byte_level_ids_equal_the_library(byte_library):
    bpe = ByteLevelBPE("byte_bpe_50k.json")
    for text in random_texts(1500, 1) + ["ab" * 3000 + "x" * 500 + "aeiou" * 300, "a" * 63, "a" * 64, "a" * 65, "a" * 66]:
        ids = byte_library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == byte_library.decode(ids, skip_special_tokens=False)
    bpe.forget()


def test_word_ids_equal_the_library(word_library):
    coder = packing.WordIds("word_bpe_49k.json")
    for text in random_texts(1500, 2):
        assert coder.encode(text) == word_library.encode(text, add_special_tokens=False).ids


def test_digests_of_awkward_documents(spark, byte_library):
    rows = awkward()
    got = sorted((tuple(r) for r in encode_digests(documents(spark, rows, ("n_tokens", "ids"))).collect()), key=repr)
    expected = []
    for i, text, _ in rows:
        ids = byte_library.encode(text or "", add_special_tokens=False).ids
        back = byte_library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(expected, key=repr)


def test_texts_round_trip(spark):
    rows = [r for r in awkward() if r[0] is not None]
    back = {(r.doc_id, r.text) for r in decode_texts(encode_texts(documents(spark, rows))).collect()}
    assert back == {(i, t or "") for i, t, _ in rows}


def test_packing_holds_every_id_once(spark, word_library):
    rows = [*awkward(), *((100 + i, "word " * (37 * i % 900), "en") for i in range(150))]
    found = packing.pack_documents(documents(spark, rows, ("rank", "kind", "slot", "offset"))).collect()
    ids = defaultdict(list)
    for i, text, _ in rows:
        ids[i].append(word_library.encode(text or "", add_special_tokens=False).ids + [2])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in found:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for i, versions in ids.items():
        expected = sorted((at, len(v[at : at + 4096]), zlib.crc32(np.array(v[at : at + 4096], dtype="<u4").tobytes()), len(v)) for v in versions for at in range(0, len(v), 4096))
        assert sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[i]) == expected
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    tokens = sum(p.length for p in found)
    assert len(sequences) <= -(-tokens // 4096) * 1.03 + 1  # little padding
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_column_generation_reaches_the_bound_on_a_known_case():
    demand = np.zeros(10, dtype=np.int64)
    demand[[2, 3, 6]] = 40, 30, 20  # sizes 3, 4 and 7 in bins of 10
    plan = packing.rounded(demand, *packing.column_generation(demand, 10), 10)
    used = sum(times * copies for copies, times in plan)
    assert (used == demand).all()
    assert all(int((copies * np.arange(1, 11)).sum()) <= 10 for copies, _ in plan)
    # 20 bins hold a 7 each, and a 3 beside it fills them; 20 threes are left for 10 bins of 3 + 3 + 4, 20 fours for 10 of 4 + 4
    assert sum(times for _, times in plan) == 40


def test_hot_length_class_is_spread(spark):
    rows = [(i, "same words again and again", "en") for i in range(4000)]
    found = packing.pack_documents(documents(spark, rows))
    assert found.count() == 4000
    assert found.select("sequence_id", "offset").distinct().count() == 4000

"""Operators 2, 4 and 6, and the pipeline."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
from tandem.llm import langid, media, pii

from .helpers import awkward, documents, words


def plain_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub(r"[ -]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = [*"a.@-+ 0123456789()", "é", "4111111111111111", "1.2.3.4", "a@b.c", "+1 (555) 555-1234", " ", "٣"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(text) == plain_base(text)


def personal_rows():
    rng = random.Random(6)
    rows = [*awkward()]
    for i in range(120):
        text = words(rng, 30)
        if i % 3 == 0:
            text += f' token = "{hashlib.sha1(str(i).encode()).hexdigest()}" ' + words(rng, 5)
        if i % 4 == 0:
            text += f" mail a{i}@b.example.com or +1 (555) 555-1{i:03d} from 10.0.0.{i} card 4111 1111 1111 1111"
        if i % 5 == 0:
            text += f" commit {hashlib.md5(str(i).encode()).hexdigest()[:24]}"
        rows.append((500 + i, text, "en"))
    return rows


def test_personal_data_rows(spark):
    rows = personal_rows()
    found = pii.personal_data(documents(spark, rows, ("spans", "kinds", "base"))).collect()
    assert len(found) == len(rows)
    texts = {i: t or "" for i, t, _ in rows if i is not None}
    for r in found:
        if r.doc_id is None:
            continue
        base = plain_base(texts[r.doc_id])
        named = [f"{k}:{a}:{z}" for k, a, z in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert (r.spans.split(",") if r.spans else [])[: len(named)] == named
        if r.doc_id >= 500:
            assert ("secret:" in r.spans) == ((r.doc_id - 500) % 3 == 0)
    assert pii.personal_data(documents(spark, [])).count() == 0


def test_redaction(spark):
    rows = personal_rows()
    docs = documents(spark, rows, ("n_email",))
    found = {r.doc_id: r for r in pii.redact(docs).collect() if r.doc_id is not None}
    assert found[500].text.count("[EMAIL]") == 1 and "[SECRET]" in found[500].text and "@" not in found[500].text
    assert found[500].n_chars == len(found[500].text) and found[500].n_email == "x"
    assert found[501].text == dict((i, t) for i, t, _ in rows)[501]
    assert found[0].text is None


def test_reliabilities_separate_good_from_bad_votes():
    p = pii.reliabilities({("secret", "++0+0"): 60, ("secret", "+000-"): 50, ("secret", "0-000"): 80, ("secret", "00000"): 10})
    assert p["secret", "++0+0"] > 0.95 > 0.5 > p["secret", "0-000"]


def test_wav_rows(spark):
    rows = awkward()
    found = media.wav_features(documents(spark, rows, ("media", "feature")), keep_media=True).collect()
    texts = {i: t for i, t, _ in rows if i is not None}
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(full)) and len(full) % 64 == 0 and full
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-64:])
        assert media.from_wav(bytes(r.media)) == full
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert r.fingerprint == sorted(r.fingerprint)
    by_text = {}
    for r in found:
        if r.doc_id is not None:
            assert by_text.setdefault(texts[r.doc_id] or "", r.feature) == r.feature
    assert media.wav_features(documents(spark, [])).count() == 0


def test_peaks_of_a_tone_and_blocks_of_frames(monkeypatch):
    import numpy as np

    t = np.arange(256 * 40)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 40 / 256) * (1 + (t // 256) % 3)).clip(0, 255).astype(np.uint8).tobytes()
    bins, _ = media.band_peaks(tone)
    assert (bins[:, 3] == 40).all()
    whole = media.fingerprint(tone)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert (media.fingerprint(tone) == whole).all() and len(whole)


LANGUAGES = {"en": "the of and that with this from they have been were which their would", "de": "der die und nicht mit auch eine wird sich über für können schön größe", "fr": "le la les des est dans pour que une avec été très où être"}


def language_rows(n=240):
    rng = random.Random(12)
    return [(i, " ".join(rng.choice(LANGUAGES[g].split()) for _ in range(rng.randint(8, 60))), g) for i in range(n) for g in [sorted(LANGUAGES)[i % 3]]]


def test_languages_of_held_out_documents(spark):
    rows = language_rows()
    found = {r.doc_id: r for r in langid.identify(documents(spark, rows + [(1000, None, "en"), (1001, "123 !", "en"), (1002, "la été pour", None)], ("rate", "score", "lang_pred"))).collect()}
    gold = {i: g for i, _, g in rows}
    assert {i for i, r in found.items() if r.held_out} == {i for i in found if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [i for i in gold if found[i].held_out]
    assert sum(found[i].lang_pred == gold[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und", "und", "fr"]


def test_nothing_to_learn(spark):
    assert langid.identify(documents(spark, [])).count() == 0
    found = langid.identify(documents(spark, [(1, "some text", None), (None, "x", "en")])).collect()
    assert {r.lang_pred for r in found} == {"und"}


def test_awkward_documents_get_a_language_row_each(spark):
    rows = awkward() + [(10_000 + i, t, g) for i, t, g in language_rows()]
    found = langid.identify(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    docs = documents(spark, rows, ("rejected",))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {10_000 + i for i, _, _ in language_rows()}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = awkward() + [(10_000 + i, t, g) for i, t, g in language_rows()]
    base = words(rng, 80)
    rows += [(20_000, base, "en"), (20_001, base + " more", "en"), (20_002, words(rng, 50) + " a@b.example.com", "en")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        columns = columns or docs.columns
        assert docs.columns == columns, k
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 20_000 in texts and 20_001 not in texts and "[EMAIL]" in texts[20_002] and 1 not in texts
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)

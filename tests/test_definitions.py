"""Definitions against values made by hand or by Python's own functions."""

import math
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions import scalars as S
from tandem.functions import text as X
from tandem.operators import audit, inference, metrics
from tandem.plans import whole

TEXTS = [
    "Don't pay 1,234.5% on 3 May 2001, nor -7 or +8.25; it isn’t 2020-01-02 or 1/2/99.",
    "MAY 3rd, 2001 and June 4 1999; 12,34 a12 12a 5%x 1.2.3 NO no No",
    "Straße ſo ΣΟΦΟΣ İx ıy NOT没有 不 没 cannot can't CAN'T",
    "", "  ", "007 1,000,000 1,0000 .5 5. x_1 _7",
]


def numbers(text):
    return sorted(m[0].casefold() for m in re.finditer(r"(?<!\w)[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?!\w)", text))


def dates(text):
    return sorted(m[0].casefold() for m in re.finditer(X.DATE.replace("(?iU)", "(?i)"), text))


def negations(text):
    words = [w.casefold() for w in re.findall(r"\w+|[^\w\s]", text)]
    return sorted([w for w in words if w in X.NEGATIONS] + [m[0].casefold() for m in re.finditer(r"(?i)\b\w+n['’]t\b", text)])


def test_signatures(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, text string")
    found = frame.select("k", X.signature(F.col("text"), X.NUMBER).alias("n"), X.signature(F.col("text"), X.DATE).alias("d"), X.negations(F.col("text")).alias("g"), X.tokens(F.col("text")).alias("w")).collect()
    for r in found:
        t = TEXTS[r.k]
        assert (r.n, r.d, r.g) == (numbers(t), dates(t), negations(t))
        assert r.w == [w.casefold() for w in re.findall(r"\w+|[^\w\s]", t)]
    assert {"don't", "isn’t", "nor"} <= set(found[0].g) and "1,234.5%" in found[0].n and len(found[0].d) == 2


def test_folding_is_casefold(spark):
    points = [c for c in range(0x20, 0x3000) if chr(c).isprintable() and not 0x13A0 <= c <= 0x13FF and not 0x1C80 <= c <= 0x1CBF]
    frame = spark.createDataFrame([(chr(c),) for c in points], "c string")
    wrong = [(r.c, r.f) for r in frame.select("c", X.folded(F.col("c")).alias("f")).collect() if r.f != r.c.casefold()]
    assert len(wrong) <= 10, wrong


def test_signatures_of_whole_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in whole.table(spark, sf_dir, "documents").collect()}
    for r in whole.edit_signatures_whole(spark, sf_dir).collect():
        assert (r.numbers, r.dates, r.negations) == tuple(" ".join(f(texts[r.doc_id])) for f in (numbers, dates, negations))


def test_feature_row(spark):
    claims, evidences = ("It is 3 km.", "It isn't 4 km!"), ("On May 3, 2001 no one", "On May 4, 2001 no one")
    row = spark.createDataFrame([(*claims, *evidences)], "a string, b string, c string, d string")
    found = row.select(*(c.alias(n) for n, c in X.edit_features((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).items())).first().asDict()
    assert found == {
        "claim_distance": 5, "claim_distance_normalised": 5 / 7, "claim_left_tokens": 5, "claim_right_tokens": 7, "claim_numeric_change": True, "claim_date_change": False, "claim_negation_change": True,
        "evidence_distance": 1, "evidence_distance_normalised": 1 / 7, "evidence_left_tokens": 7, "evidence_right_tokens": 7, "evidence_numeric_change": True, "evidence_date_change": True, "evidence_negation_change": False,
    }


def test_stable_probe_is_the_first(spark):
    rows = [([0.0, 0.2, 0.2000001, 0.9],), ([0.2, 0.3],), ([0.5],), ([1.0, 0.4, 0.4],), (None,)]
    found = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(S.stable_probe(F.col("v"), 1e-3)).collect()]
    assert found == [0.2, None, None, 0.4, None]


def test_claim_gate(spark):
    rows = [(1.0, 0.01, 2.0, 0.01), (1.0, 0.01, 2.0, 0.2), (1.0, 0.01, -2.0, 0.01), (-1.0, 0.2, -1.0, 0.049), (0.0, 0.01, 1.0, 0.01), (1.0, 0.05, 1.0, 0.05)]
    frame = spark.createDataFrame(rows, "s double, ps double, d double, pd double")
    found = [r[0] for r in frame.select(inference.gate(*(F.col(c) for c in ("s", "ps", "d", "pd")))).collect()]
    assert found == ["bounded_scale_robust", "qualitative_scale_robust", "fixed_protocol_descriptive", "qualitative_scale_robust", "fixed_protocol_descriptive", "fixed_protocol_descriptive"]


def test_mcnemar_of_equal_counts(spark):
    frame = spark.createDataFrame([(1, 0)] * 3 + [(0, 1)] * 3 + [(1, 1)] * 4, "a int, b int")
    found = inference.mcnemar(frame, F.col("a") == 1, F.col("b") == 1).first()
    assert (found.only_left, found.only_right, found.p) == (3, 3, 1.0) and abs(found.statistic - 1 / 6) < 1e-12
    assert inference.mcnemar(frame.where("a = b"), F.col("a") == 1, F.col("b") == 1).first().statistic == 0.0


def test_an_absent_class_is_an_error(spark):
    frame = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B")], "gold string, p string")
    assert metrics.balanced_accuracy(frame, "gold", "p", ["A", "B"]).first()[0] == 0.75
    with pytest.raises(Exception, match="declared class"):
        metrics.balanced_accuracy(frame, "gold", "p", ["A", "B", "C"]).collect()


def test_omnibus_of_four_means(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) + [0, 0.1, 0.3, -0.2]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    for columns in ("ab", "abc", "abcd"):
        d = x[:, 1 : len(columns)] - x[:, :1]
        b, v = d.mean(axis=0), np.atleast_2d(np.cov(d.T))
        expected = 60 * b @ np.linalg.solve(v, b)
        found = inference.omnibus_wald(frame, list(columns)).first()
        assert found.clusters == 60 and abs(found.statistic - expected) < 1e-9
    k = 3  # chi-square tail of 3 df in closed form
    tail = math.erfc(math.sqrt(expected / 2)) + math.sqrt(2 * expected / math.pi) * math.exp(-expected / 2)
    assert k == 3 and abs(found.p - tail) < 1e-6


def quartet(case, **changes):
    rows = [dict(case=case, kind="real", claim=c, evidence=e, page="p", unit=f"{case}{c}{e}", label="Y" if (c == "c0") == (e == "e0") else "N") for c in ("c0", "c1") for e in ("e0", "e1")]
    for key, change in changes.items():
        rows[int(key[1:])] |= change
    return rows


def test_reasons_of_quartets(spark):
    cases = {
        "ok": quartet("ok"), "turned": [r | {"label": "N" if r["label"] == "Y" else "Y"} for r in quartet("turned")],
        "non_real": quartet("non_real", r1={"kind": "x"}), "invalid_claim": quartet("invalid_claim", r1={"claim": " \t"}), "invalid_evidence": quartet("invalid_evidence", r2={"evidence": None}),
        "invalid_page": quartet("invalid_page", r0={"page": ""}), "invalid_unique_id": quartet("invalid_unique_id", r0={"unit": None}), "invalid_label": quartet("invalid_label", r3={"label": " "}),
        "duplicate_unique_id": quartet("duplicate_unique_id", r3={"unit": "duplicate_unique_idc0e0"}), "dimensions": quartet("dimensions", r3={"claim": "c9"}), "duplicate_cartesian_cell": quartet("duplicate_cartesian_cell", r1={"evidence": "e0"}),
        "label_pattern": quartet("label_pattern", r0={"label": "N"}), "unsupported_label": [r | {"label": "Z" if r["label"] == "N" else "Y"} for r in quartet("unsupported_label")], "row_count": quartet("row_count")[:3],
    }
    rows = [r for some in cases.values() for r in some] + quartet(None)[:2] + quartet(" ")[:3]
    names = "case kind claim evidence page unit label".split()
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    found = {(r.case, r.rows, r.reason) for r in audit.audit_quartets(frame, *names, "real", "Y", ["N"]).collect()}
    assert found == {(c, len(some), None if c in ("ok", "turned") else c) for c, some in cases.items()} | {(None, 5, "missing_case_id")}
    turned = {r.case: r for r in audit.oriented_quartets(frame, *names, "real", "Y", ["N"]).collect()}
    assert set(turned) == {"ok", "turned"} and all(r.labels == ["Y", "N", "N", "Y"] for r in turned.values())
    assert turned["ok"].evidences == ["e0", "e1"] and turned["turned"].evidences == ["e1", "e0"] and turned["turned"].units[0] == "turnedc0e1"
    assert Counter(len(r.claims) for r in turned.values()) == {2: 2} and sys.version_info


def test_tails_keep_their_relative_error(spark):
    z = [i / 8 for i in range(0, 297)] + [1.9999, 2.8284, 2.82843, -3.5, -12.0]
    frame = spark.createDataFrame([(x,) for x in z], "z double")
    for x, p in ((r.z, r.p) for r in frame.select("z", inference.normal_tail(F.col("z")).alias("p")).collect()):
        expected = math.erfc(abs(x) / math.sqrt(2))
        assert abs(p - expected) <= 1e-10 * expected, x
    assert spark.range(1).select(inference.normal_tail(F.lit(None))).first()[0] is None


def test_chi_square_tails_of_small_p(spark):
    def tail(x, df):
        p = math.erfc(math.sqrt(x / 2)) if df % 2 else math.exp(-x / 2)
        term, k = (math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 3) if df % 2 else (x / 2 * math.exp(-x / 2), 4)
        for _ in range(k, df + 1, 2):
            p, term, k = p + term, term * x / k, k + 2
        return p

    frame = spark.createDataFrame([(float(x),) for x in (0, 0.5, 3.84, 30, 99.56, 700, 1320)], "x double")
    for df in (1, 2, 3, 4, 7):
        for r in frame.select("x", inference.chi_square_tail(F.col("x"), df).alias("p")).collect():
            assert abs(r.p - tail(r.x, df)) <= 1e-10 * tail(r.x, df)
    # a published p of a statistic of one degree of freedom
    assert f"{spark.range(1).select(inference.normal_tail(F.lit(36.3017))).first()[0]:.1e}" == f"{math.erfc(36.3017 / math.sqrt(2)):.1e}"


WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def test_white_space_is_that_of_unicode(spark):
    texts = [None, "", "A", "A\n", " a\t", "\xa0b ", "\x1cA\x85", "　 ", "ab", "a b", "ß", "Z", "\x00a", "​a", WHITE, WHITE + "a" + WHITE, "a\n\n"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    choice, reason = S.parse_choice(F.col("t"), ["A", "B"])
    for r in frame.select("k", choice.alias("c"), reason.alias("r"), S.stripped(F.col("t")).alias("s"), S.normal_text(F.col("t")).alias("n")).collect():
        t = texts[r.k]
        assert r.s == (None if t is None else t.strip())
        assert r.n == re.sub(r"\s+", " ", (t or "").strip()).casefold()
        plain = None if t is None else t.strip().upper()
        expected = "invalid_response_type" if t is None else "empty_response" if not plain else "not_single_choice" if len(plain) != 1 else None if plain in "AB" else "disallowed_choice"
        assert r.r == expected and r.c == (plain if expected is None else None)


def test_use_of_a_context_ignores_white_space_of_answers(spark):
    rows = [("irrelevant", " Yes\n", "yes\xa0", None, True), ("irrelevant", "yes", "no", None, False), ("gold", "x", "\tTRUE ", "True", True), ("gold", "x", "true", " True", False)]
    frame = spark.createDataFrame(rows, "kind string, a string, b string, target string, expected boolean")
    assert all(r[0] == r[1] for r in frame.select(S.binary_use(*(F.col(c) for c in ("kind", "a", "b", "target"))), "expected").collect())


def test_names_are_registered_once():
    from tandem import queries

    assert len(queries.QUERIES) == sum(len(p.QUERIES) for p in queries.PLANS)
    with pytest.raises(ValueError, match="registered twice: a"):
        queries.merged({"a": 1}, {"b": 2}, {"a": 3})


def test_reports_keep_small_p_values(spark):
    from tandem.operators import studies

    values = spark.createDataFrame([("x", i, 5 + (i % 2) * 1e-3) for i in range(40)] + [("y", i, float(i % 7 - 3)) for i in range(40)], "contrast string, page int, value double")
    found = {r.contrast: r for r in studies.contrast_report(values, "page", ["x", "y"]).collect()}
    assert 0 <= found["x"].p < 1e-200 and found["x"].adjusted == 2 * found["x"].p and found["y"].p > 1e-3

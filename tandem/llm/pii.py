"""Personal data by weak supervision (operator 2).

Base spans come from fixed patterns. Beyond them, candidate spans (secrets, titled names,
national numbers, bank accounts, telephone numbers without a plus) are voted on by labelers
that may abstain: regular expressions (strict shape and checksums, charset), gazetteers (known
prefixes, given names, country codes, number ranges) and context (words on either side of the
span, words that speak against it). Expectation-maximisation over the counts of vote patterns,
which Spark sums over all documents, estimates for each kind how reliable each labeler is and
how likely each pattern is personal.
Those probabilities train the final span classifier, a logistic regression on votes, kind
and hashed character shapes, on at most ``SAMPLE`` candidates. A candidate that it accepts
becomes a span unless it overlaps a base span or an accepted span before it.

Only a narrow table of candidates without text is written between the passes.

Defined results: a null text counts as the empty text and has no spans; with no candidates
there is nothing to learn and base spans are all; repeated rows give repeated results; a
null doc_id is carried along; very long texts are searched whole; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, small, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "name", "national", "account", "local_phone")
#: At most this many candidates train the span classifier.
SAMPLE = 5000
ACCEPT, LABELERS, SHAPES = 0.9, 5, 512

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SECRET = re.compile(r"[A-Za-z0-9_+/-]{20,}")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora|Señor|Sra|Sr)\.? ([A-Z][a-zà-öø-ÿ]+(?: [A-Z][a-zà-öø-ÿ]+)?)")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}\b")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Monsieur", "Madame", "Señor", "Sr")

#: Gazetteers of context words for and against each kind.
FOR = {
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key", "credential", "bearer"),
    "name": ("dear", "contact", "signed", "regards", "attn", "patient", "kontakt", "monsieur"),
    "national": ("ssn", "social security", "national id", "tax id", "passport"),
    "account": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
}
#: Words after a span that speak for it.
AFTER = {
    "secret": ("expires", "revoke", "rotate"),
    "name": ("said", "wrote", "born", "md", "phd", "jr", "called", "lives"),
    "national": ("ssn", "social", "issued"),
    "account": ("bic", "swift", "bank", "iban"),
    "local_phone": ("ext", "fax", "mobile", "cell"),
}
#: Given names that are frequent in the languages at hand, and capitalised words after a title that are no names.
GIVEN = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Sandra "
    "Mark Margaret Paul Ashley Steven Emily Andrew Donna Peter Anna Hans Ursula Klaus Monika Wolfgang Petra Dieter Sabine Jürgen Karin Stefan Julia Jean Marie Pierre Nathalie Michel Isabelle Philippe Sylvie "
    "Alain Catherine François Martine Antonio José Manuel Francisco Juan Javier Carlos Jesús Carmen Ana Isabel Laura Cristina Marta Pilar Lucía Elena Rosa Ali Mohammed Fatima Ivan Olga Maria Eva Max Alice Bob".split()
)
NO_NAMES = frozenset("President Minister Chairman Speaker Director Ambassador Doctor Professor Secretary General Judge Court House Strange Who Right Universe Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split())
COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TR".split())
AGAINST = ("sha", "md5", "commit", "checksum", "isbn", "issn", "version", "http", "www.", "href", "src=", "doi", "part no", "digest", "integrity")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping addresses. A match holds the first @ after its start, so each @ is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds, by kind, then start."""
    spans = [("email", a, z) for a, z in emails(text)]
    if not DIGIT.search(text):
        return spans
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def shape(span: str) -> str:
    """Character classes with runs shortened: what the classifier may see of a span."""
    s = re.sub(r"[a-zà-öø-ÿ]+", "a", re.sub(r"[A-ZÀ-ÖØ-Þ]+", "A", re.sub(r"[0-9]+", "9", span)))
    return f"{s[:12]}|{min(9, len(span) // 8)}"


def votes(kind: str, span: str, before: str, after: str = "") -> str:
    """One vote of each labeler (strict, charset, gazetteer, context, against): + personal, - not, 0 abstains."""
    before, after = before.lower(), after.lower()
    digits = [c for c in span if "0" <= c <= "9"]
    context = "+" if any(w in before for w in FOR[kind]) or any(w in after for w in AFTER[kind]) else "0"
    against = "-" if any(w in before for w in AGAINST) else "0"
    if kind == "secret":
        hex_ = all(c in "0123456789abcdef" for c in span) or all(c in "0123456789ABCDEF" for c in span)
        strict = "+" if hex_ and len(span) in (32, 40, 48, 64, 96, 128) else "0"
        variety = len(set(span)) / min(len(span), 16)
        charset = "+" if variety >= 0.6 and len(digits) >= 3 else "-"
        gazetteer = "+" if span.startswith(("sk_", "pk_", "ghp_", "AKIA", "xox", "eyJ")) else "-" if "/" in span or span.count("-") > 3 or span.count("_") > 3 else "0"
    elif kind == "name":
        words = span.split(" ")
        strict = "+" if len(words) == 2 and min(map(len, words)) > 2 else "0"
        charset = "-" if len(span) < 3 else "0"
        gazetteer = "-" if words[0] in NO_NAMES or words[-1] in NO_NAMES else "+" if words[0] in GIVEN else "0"
    elif kind == "national":
        strict, charset = "0", "-" if len(set(digits)) < 3 else "0"
        gazetteer = "-" if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else "+"
    elif kind == "account":
        plain = span.replace(" ", "")
        number = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        strict = "+" if int(number) % 97 == 1 else "-"  # the checksum of account numbers
        charset, gazetteer = "+" if 15 <= len(plain) <= 34 and digits[2:] else "-", "+" if plain[:2] in COUNTRIES else "-"
    else:
        strict = "+" if span.startswith("(") or span[3] == span[7] else "-"
        charset = "-" if len(set(digits)) < 3 else "0"
        gazetteer = "-" if digits[0] in "01" else "+"
    return strict + charset + gazetteer + context + against


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, votes, shape) of spans beyond the base spans that may be personal."""
    found = []
    digits = DIGIT.search(text) is not None
    if digits:
        for m in SECRET.finditer(text):
            s = m[0]
            if DIGIT.search(s) and re.search("[A-Za-z]", s):
                found.append(("secret", *m.span()))
        for kind, pattern in (("national", NATIONAL), ("account", ACCOUNT), ("local_phone", LOCAL_PHONE)):
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if any(t in text for t in TITLES):
        found += [("name", *m.span(1)) for m in NAME.finditer(text)]
    taken = sorted((a, z) for _, a, z in base)
    starts = [a for a, _ in taken]
    reach = [*accumulate((z for _, z in taken), max)]  # the furthest end of the base spans up to each
    out = []
    for kind, a, z in found:
        i = bisect_right(starts, a)
        if i and reach[i - 1] > a or i < len(starts) and starts[i] < z:
            continue
        out.append((kind, a, z, votes(kind, text[a:z], text[max(0, a - 24) : a], text[z : z + 24]), shape(text[a:z])))
    return out


def reliabilities(patterns: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """P(personal) of each (kind, votes), by expectation-maximisation over their counts.

    For each kind on its own, each labeler has a chance of each vote given the truth.
    Pseudo-counts hold the labelers on the side of their votes when data are few.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _ in patterns}):
        own = {v: n for (k, v), n in patterns.items() if k == kind}
        out |= {(kind, v): p for v, p in zip(own, _estimated([*own], [*own.values()], rounds).tolist())}
    return out


def _estimated(keys: list[str], counts: list[int], rounds: int) -> np.ndarray:
    n = np.array(counts, dtype=float)
    vote = np.array([["-0+".index(v) for v in k] for k in keys]).reshape(len(keys), LABELERS)
    score = (vote - 1).sum(axis=1)
    p = 1 / (1 + np.exp(-score.astype(float)))
    weak = np.array([[3.0, 3.0, 1.0], [1.0, 3.0, 3.0]])  # pseudo-counts of -, 0, + given not personal, personal
    for _ in range(rounds):
        chance = np.empty((2, LABELERS, 3))
        for y, w in ((0, (1 - p) * n), (1, p * n)):
            for j in range(LABELERS):
                c = np.bincount(vote[:, j], weights=w, minlength=3) + weak[y]
                chance[y, j] = c / c.sum()
        prior = ((p * n).sum() + 1) / (n.sum() + 2)
        log = np.log(np.repeat([[1 - prior], [prior]], len(keys), axis=1))
        for j in range(LABELERS):
            log += np.log(chance[:, j, vote[:, j]])
        new = 1 / (1 + np.exp(log[0] - log[1]))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p


def features(kind: str, vote: str, form: str) -> list[int]:
    """Places of the features of a span: votes, kind, hashed shape trigrams."""
    at = [0] + [1 + 3 * j + "-0+".index(v) for j, v in enumerate(vote)]
    at.append(1 + 3 * LABELERS + KINDS.index(kind))
    first = 1 + 3 * LABELERS + len(KINDS)
    text = f"{kind}^{form}$"
    return at + [first + zlib.crc32(text[i : i + 3].encode()) % SHAPES for i in range(len(text) - 2)]


WIDTH = 1 + 3 * LABELERS + len(KINDS) + SHAPES


@dataclass
class SpanClassifier:
    weights: np.ndarray

    def probability(self, kind: str, vote: str, form: str) -> float:
        z = float(self.weights[features(kind, vote, form)].sum())
        return 1 / (1 + np.exp(-min(50.0, max(-50.0, z))))


def train(rows: list[tuple[str, str, str]], truth: dict[tuple[str, str], float], epochs: int = 30) -> SpanClassifier:
    """Logistic regression on (kind, votes, shape) with the estimated probabilities as soft labels."""
    weights = np.zeros(WIDTH)
    if rows:
        x = [np.array(features(*r)) for r in rows]
        y = np.array([truth[r[:2]] for r in rows])
        rng = np.random.default_rng(11)
        for epoch in range(epochs):
            rate = 0.3 / (1 + epoch / 5)
            for i in rng.permutation(len(x)):
                p = 1 / (1 + np.exp(-np.clip(weights[x[i]].sum(), -50, 50)))
                np.add.at(weights, x[i], rate * (y[i] - p) / len(x[i]) ** 0.5)
            weights *= 1 - 1e-3
    return SpanClassifier(weights)


FOUND = "doc_id long, base array<string>, kinds array<string>, starts array<int>, ends array<int>, votes array<string>, shapes array<string>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        base, rest = [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text or "")
            base.append([f"{k}:{a}:{z}" for k, a, z in spans])
            rest.append(candidates(text or "", spans))
        columns = [pa.array([[c[i] for c in cs] for cs in rest], pa.list_(t)) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.string())), *columns], names=[x.split()[0] for x in FOUND.split(", ")])


def find_spans(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every document, written: no text, only places, votes and shapes."""
    return written(mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _find, FOUND), "span-candidates")


def fit(found: DataFrame, sample: int = SAMPLE) -> SpanClassifier:
    each = found.select("doc_id", F.explode(F.arrays_zip("kinds", "votes", "shapes", "starts")).alias("c")).select("doc_id", "c.*")
    patterns = {(r["kinds"], r["votes"]): r["count"] for r in each.groupBy("kinds", "votes").count().collect()}  # at most kinds x 3 ** LABELERS rows
    if not patterns:
        return SpanClassifier(np.full(WIDTH, -1.0))
    drawn = each.orderBy(F.xxhash64("doc_id", "starts"), "doc_id", "starts", "kinds").limit(sample).collect()
    return train([(r["kinds"], r["votes"], r["shapes"]) for r in drawn], reliabilities(patterns))


def accepted(model: SpanClassifier, rows: list[tuple[str, int, int, str, str]]) -> list[tuple[str, int, int]]:
    """Candidates that the classifier accepts, without overlaps, by kind, then start."""
    out, end = [], -1
    for kind, a, z, vote, form in sorted(rows, key=lambda r: (r[1], -r[2])):
        if a >= end and model.probability(kind, vote, form) >= ACCEPT:
            out.append((kind, a, z))
            end = z
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans of every document."""
    found = find_spans(docs)
    told = docs.sparkSession.sparkContext.broadcast(fit(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for _, base, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                more = [f"{k}:{a}:{z}" for k, a, z in accepted(told.value, [*zip(*rest)])]
                counts = [sum(s.startswith(k + ":") for s in base) for k in BASE]
                rows.append((*counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + more), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[x.split()[0] for x in RESULT.split(", ")])

    return mapped(found, run, RESULT)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; n_chars follows, other columns stay."""
    told = docs.sparkSession.sparkContext.broadcast(fit(find_spans(docs)))
    place = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(place).to_pylist()
            sizes = batch.column(count).to_pylist() if count is not None else []
            for i, text in enumerate(texts):
                if not text:
                    continue
                base = base_spans(text)
                spans = sorted((a, z, k) for k, a, z in base + accepted(told.value, candidates(text, base)))
                if not spans:
                    continue
                out, at = [], 0
                for a, z, kind in spans:
                    if z <= at:
                        continue
                    out += [text[at : max(a, at)], f"[{kind.upper()}]"]
                    at = z
                texts[i] = "".join(out) + text[at:]
                if sizes:
                    sizes[i] = len(texts[i])
            columns = batch.columns
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if count is not None:
                columns[count] = pa.array(sizes, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return mapped(docs, run, docs.schema)


def op2_weak_supervision(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

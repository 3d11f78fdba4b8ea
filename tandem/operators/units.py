"""Units of a study: quartets to units, condition exports, their alignment, subsets, lookups, paired contexts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .audit import violations

#: The controls of a quartet, and the names of its label strata.
CONTROLS = ("full", "no_evidence", "knowledge_only")
STRATA = {"REFUTES": "S/R", "NOT ENOUGH INFO": "S/NEI"}


def quartet_units(quartets: DataFrame) -> DataFrame:
    """Eight units of each quartet (case_id, page, claims, evidences, units, labels): four cells, two claims in each control without evidence."""
    cell = F.struct("pos", F.floor(F.col("pos") / 2).cast("int").alias("claim_index"), (F.col("pos") % 2).alias("evidence_index"))
    full = quartets.select("case_id", "page", "claims", "evidences", F.posexplode(F.arrays_zip("units", "labels")).alias("pos", "x")).withColumn("at", cell)
    full = full.select(
        F.concat(F.lit("full:"), F.col("x.units")).alias("owner_key"), F.lit("full").alias("control"), "case_id", "page", F.col("pos").alias("cell_index"), "at.claim_index", "at.evidence_index",
        F.get("claims", F.col("at.claim_index")).alias("claim"), F.get("evidences", F.col("at.evidence_index")).alias("evidence"), F.col("x.labels").alias("gold"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    claims = quartets.select("case_id", "page", F.posexplode("claims").alias("claim_index", "claim"))
    rest = claims.withColumn("control", F.explode(F.array(*map(F.lit, CONTROLS[1:]))))
    rest = rest.select(
        F.concat_ws(":", "control", "case_id", F.lit("claim"), "claim_index").alias("owner_key"), "control", "case_id", "page", none("int").alias("cell_index"), "claim_index", none("int").alias("evidence_index"),
        "claim", none("string").alias("evidence"), none("string").alias("gold"),
    )
    return full.unionByName(rest)


def cell_rows(cases: DataFrame, arrays: list[str]) -> DataFrame:
    """Arrays of a case, one entry for each cell, as rows."""
    return cases.select("case_id", F.posexplode(F.arrays_zip(*arrays)).alias("cell_index", "x")).select("case_id", "cell_index", "x.*")


def label_stratum(negative: Column, strata: dict[str, str] = STRATA) -> Column:
    """The stratum of a negative label; another label is an error."""
    found = reduce(lambda c, x: c.when(negative == x[0], x[1]), [*strata.items()][1:], F.when(negative == next(iter(strata)), strata[next(iter(strata))]))
    return found.otherwise(F.raise_error(F.concat(F.lit("unsupported negative label: "), F.coalesce(negative, F.lit("null")))).cast("string"))


def subset(condition: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of an id list, written once; an id without a row is an error."""
    wanted = written(ids.select(key).distinct(), "ids")
    kept = written(condition.join(wanted, key, "left_semi"), "subset")
    if kept.select(key).distinct().count() < wanted.count():
        lacking = wanted.join(kept.select(key), key, "left_anti").first()
        raise ValueError(f"ids without rows: {lacking[0]}")
    return kept


def looked_up(keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of a lookup for each key, with whether there is one."""
    return keys.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def unique_row(rows: DataFrame, condition: Column) -> DataFrame:
    """The one row for which the condition holds; none or several are an error."""
    found = rows.where(condition)
    if (n := found.limit(2).count()) != 1:
        raise ValueError("no row" if not n else "more than one row")
    return found


def export_rows(owners: DataFrame, stages: dict[str, DataFrame], key: str = "owner_key") -> DataFrame:
    """Owners with the results of all their stages, in key order; an owner that lacks a stage drops out."""
    joined = reduce(lambda a, x: a.join(x[1].select(key, *(F.col(c).alias(f"{x[0]}_{c}") for c in x[1].columns if c != key)), key), stages.items(), owners)
    return joined.orderBy(key)


def pair_gate(left: DataFrame, right: DataFrame, same: list[str], stages: list[str], key: str = "owner_key") -> DataFrame:
    """How many owners of two exports break each check: a side missing, fields that differ, stages that failed."""
    fields = [*same, *(f"{s}_ok" for s in stages)]
    a = left.select(key, F.lit(True).alias("has_l"), *(F.col(c).alias(f"{c}_l") for c in fields))
    b = right.select(key, F.lit(True).alias("has_r"), *(F.col(c).alias(f"{c}_r") for c in fields))
    both = a.join(b, key, "full_outer")
    there = F.col("has_l").isNotNull() & F.col("has_r").isNotNull()
    checks = {"owner_set": there} | {f"same_{c}": ~there | F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")) for c in same} | {f"{s}_ok": ~there | (F.col(f"{s}_ok_l") & F.col(f"{s}_ok_r")) for s in stages}
    return violations(both, checks)


def alignment_gate(exports: DataFrame, conditions: int, same: list[str], key: str = "owner_key") -> DataFrame:
    """Of N exports: owners that lack a condition or stand twice, and owners on which a field differs, in one shuffle."""
    each = exports.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.size(F.collect_set("condition")).alias("of"), *(F.min(F.struct(F.col(c).isNull(), F.col(c))).eqNullSafe(F.max(F.struct(F.col(c).isNull(), F.col(c)))).alias(f"same_{c}") for c in same))
    return violations(each, {"owner_set": (F.col("rows") == conditions) & (F.col("of") == conditions)} | {f"same_{c}": F.col(f"same_{c}") for c in same})


def control_structure(export: DataFrame) -> DataFrame:
    """Rows of each control and how many have each stage; a null stage counts as none."""
    return export.groupBy("control").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(F.col("hard_ok").cast("long"), F.lit(0))).alias("hard"), F.sum(F.coalesce(F.col("probability_ok").cast("long"), F.lit(0))).alias("probability"))


def pair_contexts(left: DataFrame, right: DataFrame, identity: list[str], target: str, kind: str, values: list[str], key: str = "sample_id") -> DataFrame:
    """Two context exports side by side: identities must agree, and the target where the context is relevant; status says what does not."""
    names = [*identity, target, *values]
    a = left.select(key, F.lit(True).alias("has_l"), *(F.col(c).alias(f"{c}_l") for c in names))
    b = right.select(key, F.lit(True).alias("has_r"), *(F.col(c).alias(f"{c}_r") for c in names))
    differs = reduce(lambda x, y: x | y, (~F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")) for c in identity))
    turned = (F.col(f"{kind}_l") != "irrelevant") & ~F.col(f"{target}_l").eqNullSafe(F.col(f"{target}_r"))
    status = F.when(F.col("has_l").isNull() | F.col("has_r").isNull(), "sample_missing").when(differs, "identity_differs").when(turned, "target_differs").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, F.coalesce(f"{kind}_l", f"{kind}_r").alias(kind), *(F.col(f"{c}_{s}") for c in values for s in "lr"), status.alias("status"))


def canonical_context(rows: DataFrame, true_targets: list[str], new_targets: list[str]) -> DataFrame:
    """Contexts with their first failing reason, and the digest of their canonical JSON where none fails."""
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"\S"), F.lit(False))
    true, new = F.trim("target_true"), F.trim("target_new")
    kind = F.col("context_type")
    reason = F.when(blank("sample_id") | blank("claim") | blank("claimant") | blank("evidence"), "missing_text").when(F.col("relevant").isNull(), "relevant").when(~F.coalesce(kind.isin("gold", "edited", "irrelevant"), F.lit(False)), "context_type")
    reason = reason.when(~F.coalesce(true.isin(true_targets), F.lit(False)), "target_true").when(new.isNotNull() & ~new.isin(new_targets), "target_new").when((kind == "gold") & ~new.eqNullSafe(true), "gold_target")
    reason = reason.when((kind == "edited") & (new.isNull() | (new == true)), "edited_target").when((kind == "irrelevant") & new.isNotNull(), "irrelevant_target")
    # keys in order, no spaces, text as it is: the canonical form of JSON
    text = F.to_json(F.struct("claim", "claimant", "context_type", "evidence", "relevant", "sample_id", new.alias("target_new"), true.alias("target_true")), {"ignoreNullFields": "false"})
    return rows.select("sample_id", reason.alias("reason"), F.when(reason.isNull(), F.sha2(text, 256)).alias("digest"))


def choice_logprobs(top: Column, choices: list[str]) -> Column:
    """Logarithms of the probabilities of wanted tokens in an array of (token, prob); null if one lacks or is not positive."""
    named = F.transform(top, lambda x: F.struct(F.upper(F.trim(x["token"])).alias("token"), x["prob"].alias("prob")))
    of = lambda c: F.element_at(F.transform(F.filter(named, lambda x: x["token"] == c), lambda x: x["prob"]), -1)
    wanted = F.filter(named, lambda x: x["token"].isin(choices))
    whole = (F.size(F.array_distinct(F.transform(wanted, lambda x: x["token"]))) == len(choices)) & F.forall(wanted, lambda x: x["prob"] > 0)
    return F.when(whole, F.create_map(*(y for c in choices for y in (F.lit(c), F.ln(of(c))))))


def token_mass(logits: Column, places: list[int]) -> Column:
    """Log-softmax over a whole vocabulary at chosen places, and the probability mass that they hold."""
    top = F.array_max(logits)
    total = top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    chosen = [F.get(logits, p) - total for p in places]
    return F.struct(F.array(*chosen).alias("logprobs"), sum((F.exp(c) for c in chosen[1:]), F.exp(chosen[0])).alias("mass"))

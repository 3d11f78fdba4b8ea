"""Gates over exports of runs: how many rows break each check, and an error where one may not be broken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("hard", "probability")


def full_pair_gate(left: DataFrame, right: DataFrame, metadata: list[str], aligned: list[str], controls: dict[str, int], scores: str = "scores", key: str = "owner_key") -> DataFrame:
    """(check, broken) of two exports of the same owners, without looking at any outcome.

    Rows have ``key``, control, the ``metadata`` fields, and for each stage <stage>_status and
    <stage>_payload, a struct with the ``aligned`` fields (what was asked: digests of prompts and
    token ids) and ``scores``. Owners must be the same and stand once, metadata, control and
    aligned fields equal, stages complete, and both stages of a row have the same scores, since
    they come from one pass. Controls must be as many as expected.
    """
    fields = ["control", *metadata, *(f"{s}_{x}" for s in STAGES for x in ("status", "payload"))]
    side = lambda frame, n: frame.groupBy(key).agg(F.count(F.lit(1)).alias(f"rows_{n}"), *(F.first(c).alias(f"{c}_{n}") for c in fields))
    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    there = F.col("rows_l").isNotNull() & F.col("rows_r").isNotNull()
    either = lambda ok: ~there | F.coalesce(ok, F.lit(False))
    same = lambda c: either(F.col(f"{c}_l").eqNullSafe(F.col(f"{c}_r")))
    checks: dict[str, Column] = {"owner_set": there, "owner_once": (F.coalesce("rows_l", F.lit(1)) == 1) & (F.coalesce("rows_r", F.lit(1)) == 1)}
    checks |= {f"same_{c}": same(c) for c in ("control", *metadata)} | {"known_control": either(F.col("control_l").isin(*controls))}
    for s in STAGES:
        checks[f"{s}_complete"] = either((F.col(f"{s}_status_l") == "ok") & (F.col(f"{s}_status_r") == "ok") & F.col(f"{s}_payload_l").isNotNull() & F.col(f"{s}_payload_r").isNotNull())
        checks |= {f"{s}_{f}": either(F.col(f"{s}_payload_l")[f].eqNullSafe(F.col(f"{s}_payload_r")[f])) for f in aligned}
    of = lambda n: F.col(f"hard_payload_{n}")[scores].eqNullSafe(F.col(f"probability_payload_{n}")[scores])
    checks["one_pass"] = either(of("l") & of("r"))
    broken = [F.count_if(~ok).alias(name) for name, ok in checks.items()]
    broken += [F.abs(F.count_if(there & (F.col("control_l") == c)) - n).alias(f"rows_of_{c}") for c, n in controls.items()]
    told = both.agg(*broken)
    return told.unpivot([], told.columns, "check", "broken")


def cell_gate(exports: DataFrame, units: DataFrame, cells: DataFrame, key: str = "owner_key", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each expected or present cell (condition, variant): what is wrong with it, in numbers, and whether it passes.

    ``units`` (key, variant, prompt): every owner and the digest of its prompt under each variant.
    ``exports``: rows with condition, variant, key, <stage>_status and <stage>_prompt. A cell
    must hold exactly the owners of its variant, once, complete, asked by their own prompt in
    both stages. ``cells`` (condition, variant): the design.

    ``by``: columns of units and exports that an owner has only one value of, such as its case, by
    which both are dealt to the same number of parts; all rows of an owner then stay where they
    are. Else they are sent once, by owner. Counts are summed first by prompt and then without it,
    so nothing is sorted, and no list of an owner's rows is held.
    """
    design = cells.select("condition", "variant").distinct()
    names = [*by, key, "condition", "variant"]
    failed = (F.col("hard_status") != "ok") | (F.col("probability_status") != "ok")
    told_as = lambda *n: [F.lit(x).alias(c) if isinstance(x, int) else F.coalesce(x.cast("int"), F.lit(0)).alias(c) for c, x in zip(("asked", "n", "failed", "alike"), n)]
    wanted = units.select(*by, key, "variant", "prompt").join(F.broadcast(design), "variant").select(*names, "prompt", *told_as(1, 0, 0, 0))
    rows = exports.select(*names, F.col("hard_prompt").alias("prompt"), *told_as(0, 1, failed, F.col("hard_prompt").eqNullSafe(F.col("probability_prompt"))))
    both = wanted.unionByName(rows)
    both = both if by else both.repartition(key)
    prompts = both.groupBy(*names, "prompt").agg(*(F.sum(c).alias(c) for c in ("asked", "n", "failed", "alike")))
    each = prompts.groupBy(*names).agg(*(F.sum(c).alias(c) for c in ("asked", "n", "failed")), F.sum(F.col("asked") * F.col("alike")).alias("own"))
    times = F.greatest("asked", F.lit(1))  # a unit that stands twice counts its rows twice
    told = each.groupBy("condition", "variant").agg(
        F.count_if(F.col("n") > 0).alias("owners"), F.count_if((F.col("asked") > 0) & (F.col("n") == 0)).alias("missing"), F.count_if(F.col("asked") == 0).alias("extra"), F.count_if(F.col("n") * times > 1).alias("repeated"),
        F.sum(F.col("failed") * times).alias("failed"), F.sum(F.col("n") * F.col("asked") - F.col("own")).alias("other_prompts"),
    )
    told = told.join(F.broadcast(design.withColumn("in_design", F.lit(True))), ["condition", "variant"], "left").withColumn("in_design", F.coalesce("in_design", F.lit(False)))
    clean = F.col("in_design") & (F.col("owners") > 0)
    for c in ("missing", "extra", "repeated", "failed", "other_prompts"):
        clean &= F.col(c) == 0
    return told.withColumn("passes", clean)


def require(gate: DataFrame) -> None:
    """An error that names every broken check of a gate (check, broken): a row for each check."""
    if broken := gate.where("broken > 0").orderBy("check").collect():
        raise ValueError("the gate is broken: " + ", ".join(f"{b['check']} {b['broken']}" for b in broken))

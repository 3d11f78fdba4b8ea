"""Deterministic selection by hash ranks: the same rows whatever the partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import stable_rank
from .ranks import ranges, ranked


def quotas(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """Each stratum's share of ``total``, rounded half to even."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("quota", F.bround(F.lit(total) * F.col("n") / F.sum("n").over(Window.partitionBy()), 0).cast("long")).drop("n")


#: Up to so many rows a stratum a window keeps no more than those; a quota beyond is ranked over ranges.
FEW = 1000


def _first(rows: DataFrame, by: list[str], order: list[str], place: str, most: int) -> DataFrame:
    """At least the first ``most`` rows of each group, with their place from 1; small quotas cost no more state than their rows in each task."""
    if most <= FEW:
        return rows.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(place) <= most)
    return ranked(rows, order, tuple(by), place).withColumn(place, F.col(place) + 1).where(F.col(place) <= most)


def round_robin(rows: DataFrame, key: str, cluster: str, seed: int, quota: Column | None = None, stratum: str | None = None, total: int = 0) -> DataFrame:
    """Cluster-first selection: the first case of every cluster, then the second of every one, until the quota.

    Clusters and cases within them go by hash rank. ``place`` is the order of selection
    within the stratum. The largest quota bounds what a cluster, and then a stratum, may give,
    so a task keeps no more rows of either than that.
    """
    by = [stratum] if stratum else []
    most = total
    if stratum:
        shares = quotas(rows, stratum, total)
        most = shares.agg(F.max("quota")).first()[0] or 0
    hashed = rows.select(key, cluster, *by).withColumn("cluster_hash", stable_rank(seed, "cluster", F.col(cluster))).withColumn("case_hash", stable_rank(seed, "case", F.col(key)))
    passes = _first(hashed, [*by, cluster], ["case_hash", key], "turn", most)
    if not stratum:
        lead = passes.orderBy("turn", "cluster_hash", key).limit(total)
        return _first(lead, [], ["turn", "cluster_hash", key], "place", total).select(key, cluster, "place")
    placed = _first(passes, by, ["turn", "cluster_hash", key], "place", most)
    shares = shares.withColumnRenamed(stratum, "__stratum")
    return placed.join(shares, F.col(stratum).eqNullSafe(F.col("__stratum"))).where("place <= quota").select(key, cluster, stratum, "place")


def lowest_ranked(rows: DataFrame, key: str, seed: int, namespace: str, k: int, stratum: str | None = None) -> DataFrame:
    """The k keys of lowest hash rank, in each stratum if there is one."""
    hashed = rows.withColumn("hash", stable_rank(seed, namespace, F.col(key)))
    if stratum is None:
        return hashed.orderBy("hash", key).limit(k).drop("hash")
    return hashed.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy("hash", key))).where(F.col("place") <= k).drop("hash", "place")


def two_sets(rows: DataFrame, key: str, cluster: str, stratum: str, quotas: tuple[dict[str, int], dict[str, int]], seed: int, names: tuple[str, str] = ("pilot", "discovery")) -> DataFrame:
    """(key, cluster, stratum, part): two sets by hash rank in each stratum, the second from clusters that the first doesn't touch.

    A stratum with fewer free rows than its quota is an error.
    """
    out: DataFrame | None = None
    for name, wanted in zip(names, quotas, strict=True):
        free = rows.select(key, cluster, stratum).where(F.col(stratum).isin(*wanted))
        free = free if out is None else without_exposed(free, out, cluster)
        hashed = free.withColumn("hash", stable_rank(seed, name, F.col(key)))
        placed = _first(hashed, [stratum], ["hash", key], "place", max(wanted.values()))
        quota = F.element_at(F.create_map(*(F.lit(x) for item in wanted.items() for x in item)), F.col(stratum))
        picked = placed.where(F.col("place") <= quota).select(key, cluster, stratum, F.lit(name).alias("part"))
        found = {r[stratum]: r["count"] for r in picked.groupBy(stratum).count().collect()}  # a row for each stratum with a quota
        if short := [s for s, n in wanted.items() if found.get(s, 0) < n]:
            raise ValueError(f"{name}: stratum {short[0]} has {found.get(short[0], 0)} free rows, not {wanted[short[0]]}")
        out = picked if out is None else out.unionByName(picked)
    return out


def of_roles(rows: DataFrame, roles: list[str], role: str = "source_role", order: tuple[str, ...] = ("model_key", "route", "scope")) -> DataFrame:
    """Ledger rows of some roles, sorted by three keys; a missing key counts as empty."""
    return rows.where(F.col(role).isin(roles)).orderBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))


def split_clusters(rows: DataFrame, cluster: str, seed: int, share: float) -> DataFrame:
    """Every row with ``part``: recovery for the share of clusters of lowest hash rank (rounded half to even), else main."""
    names = rows.select(cluster).distinct().withColumn("hash", stable_rank(seed, "split", F.col(cluster)))
    dealt = ranges(names, ["hash", cluster])
    part = F.when(F.col("place") < F.bround(F.col("n") * share, 0), "recovery").otherwise("main")
    return rows.join(dealt.placed("place", "n").select(cluster, part.alias("part")), cluster)


def greedy_disjoint(rows: DataFrame, key: str, cluster: str, kind: str, kinds: list, seed: int, k: int) -> DataFrame:
    """k rows of each kind, one for a cluster, no cluster twice across kinds; earlier kinds choose first."""
    chosen = None
    for wanted in kinds:
        free = rows.where(F.col(kind) == wanted)
        if chosen is not None:
            free = free.join(chosen.select(cluster), cluster, "left_anti")
        hashed = free.withColumn("hash", stable_rank(seed, "greedy", F.col(key)))
        first = hashed.withColumn("turn", F.row_number().over(Window.partitionBy(cluster).orderBy("hash", key))).where("turn = 1")
        picked = first.orderBy("hash", key).limit(k).select(key, cluster, kind)
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return chosen


def without_exposed(rows: DataFrame, exposed: DataFrame, cluster: str) -> DataFrame:
    return rows.join(exposed.select(cluster).distinct(), cluster, "left_anti")


def missing_cells(found: DataFrame, dimensions: dict[str, list]) -> DataFrame:
    """Cells of the design (the product of small dimensions) that ``found`` lacks."""
    spark = found.sparkSession
    design = None
    for name, values in dimensions.items():
        side = spark.createDataFrame([(v,) for v in values], [name])
        design = side if design is None else design.join(F.broadcast(side))
    return design.join(found.select(*dimensions).distinct(), [*dimensions], "left_anti")


def _streamed(groups: list[str]):
    """The digest of each group's ids, fed one by one: rows come sorted by group and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, ids = None, hashlib.sha256(), 0
        kept: list[pa.RecordBatch] = []

        def told() -> Iterator[pa.RecordBatch]:
            columns = [kept[0].column(c) for c in groups]
            yield pa.record_batch([*columns, pa.array([ids], pa.int64()), pa.array([state.hexdigest()])], [*groups, "ids", "digest"])

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in groups), strict=True)) if groups else [()] * batch.num_rows
            for i, (name, value) in enumerate(zip(names, batch.column("id").to_pylist(), strict=True)):
                if not kept or name != last:
                    if kept:
                        yield from told()
                    last, state, ids, kept = name, hashlib.sha256(), 0, [batch.slice(i, 1)]
                if value is not None:
                    state.update(value.encode() + b"\n")
                    ids += 1
        if kept:
            yield from told()

    return run


def id_digest(rows: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of ids and the digest of their sorted list, each ended by a newline; null ids are left out.

    A digest of one list is made in order, so a group is one task's work, but a stream in it:
    Spark sorts (and spills) the narrow ids, and the state of a digest is all that is held.
    """
    narrow = rows.select(*by, F.col(key).cast("string").alias("id"))
    dealt = narrow.repartition(*by) if by else narrow.coalesce(1)
    schema = ", ".join([*(f"`{c}` {dict(narrow.dtypes)[c]}" for c in by), "ids long", "digest string"])
    return dealt.sortWithinPartitions(*by, "id").mapInArrow(_streamed(list(by)), schema)



"""References to records that do not exist, were removed, or arrived later (problem 1).

Method: keys that a large part of all references share are split off and looked up through a
broadcast of bounded size, the others through a shuffle join, and the two results are united. The
report joins references pre-aggregated per key and period; the list of the references themselves
needs the rows, where the pre-aggregation only finds the heavy keys. No group of rows ever meets in
one task because of its key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A key is heavy when more than this share of all references points to it; so there are at most
#: 1 / HEAVY_SHARE heavy keys, whatever the size of the input.
HEAVY_SHARE = 1 / 2000


@dataclass(frozen=True)
class Reference:
    """A column of `table` that holds ids of `target`, and that table's kind in the removal log."""

    table: str
    field: str
    target: str
    entity: str


def references(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """(table_name, field_name, entity, row_id, value, since, ref_month), one row per id and field.

    Values of 0 and below and null say "no reference" and are left out, as are rows without an id.
    since is the earliest stamp at which the row carries the value; a row whose value changes
    between deliveries counts with the value of its latest one.
    """
    parts = []
    for name in dict.fromkeys(r.table for r in refs):
        own = [r for r in refs if r.table == name]
        packed = F.array(*[F.struct(F.lit(r.field).alias("field_name"), F.lit(r.entity).alias("entity"), F.col(r.field).cast("long").alias("value")) for r in own])
        rows = (
            tables[name]
            .select("id", "loaded_at", "creation_date", F.explode(F.filter(packed, lambda x: x["value"] > 0)).alias("r"))
            .where("id is not null")
            .select(F.lit(name).alias("table_name"), "r.*", F.col("id").alias("row_id"), "loaded_at", "creation_date")
        )
        parts.append(rows)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # Partitioned by id once: neither of the two aggregations below has to shuffle again.
    return (
        rows.repartition("row_id")
        .groupBy("row_id", "table_name", "field_name", "entity", "value")
        .agg(F.min("loaded_at").alias("since"), F.max("loaded_at").alias("until"), F.min("creation_date").alias("creation_date"))
        .groupBy("row_id", "table_name", "field_name", "entity")
        .agg(F.max(F.struct("until", "value", "since", "creation_date")).alias("x"))
        .select("table_name", "field_name", "entity", "row_id", "x.value", "x.since", F.coalesce(F.date_format("x.creation_date", "yyyy-MM"), F.lit("none")).alias("ref_month"))
    )


def target_status(tables: dict[str, DataFrame], deletions: DataFrame, refs: list[Reference]) -> DataFrame:
    """(entity, value, present, removed, first, latest, removed_at) of every id that has a row or a log entry."""
    parts = [
        tables[t].select(F.lit(e).alias("entity"), F.col("id").cast("long").alias("value"), "loaded_at", F.lit(None).cast("timestamp_ntz").alias("deleted_at"), F.lit(1).alias("present"), F.lit(0).alias("removed"))
        for t, e in dict.fromkeys((r.target, r.entity) for r in refs)
    ]
    stamp = dict(tables[refs[0].target].dtypes)["loaded_at"]
    log = deletions.where(F.col("entity").isin(sorted({r.entity for r in refs}))).select("entity", F.col("entity_id").cast("long").alias("value"), F.lit(None).cast(stamp).alias("loaded_at"), "deleted_at", F.lit(0).alias("present"), F.lit(1).alias("removed"))
    rows = log
    for p in parts:
        rows = p.withColumn("deleted_at", F.col("deleted_at").cast(dict(log.dtypes)["deleted_at"])).unionByName(rows)
    return (
        rows.where("value > 0")
        .groupBy("entity", "value")
        .agg(F.max("present").alias("present"), F.max("removed").alias("removed"), F.min("loaded_at").alias("first"), F.max("loaded_at").alias("latest"), F.max("deleted_at").alias("removed_at"))
    )


def heavy_keys(tables: dict[str, DataFrame], refs: list[Reference], share: float = HEAVY_SHARE) -> list[tuple[str, int]]:
    """(entity, value) pairs that more than `share` of all references point to: at most 1 / share.

    References are pre-aggregated per key where they are read; only the keys that pass the test
    reach the driver.
    """
    parts = None
    for r in refs:
        p = tables[r.table].where(F.col(r.field) > 0).select(F.lit(r.entity).alias("entity"), F.col(r.field).cast("long").alias("value"))
        parts = p if parts is None else parts.unionByName(p)
    by_key = parts.groupBy("entity", "value").agg(F.count("*").alias("n"))
    total = parts.count()
    rows = by_key.where(F.col("n") > F.lit(max(1.0, total * share))).select("entity", "value").collect()
    return [(r.entity, r.value) for r in rows]


def orphan_references(tables: dict[str, DataFrame], deletions: DataFrame, refs: list[Reference], share: float = HEAVY_SHARE) -> DataFrame:
    """(table_name, field_name, row_id, reason, ref_month): one row per id and field whose reference is broken.

    reason is the first that applies: 'missing' (no row and no entry in the removal log), 'deleted'
    (logged, and without a row or logged after its latest delivery), 'late' (first delivered after
    the referring record had the value). Null stamps never make a reference late. Columns beyond
    the named ones are ignored, exact repeats collapse, empty tables give an empty result.
    """
    rows = references(tables, refs)
    judged = _judged(rows, target_status(tables, deletions, refs), heavy_keys(tables, refs, share))
    return judged.select("table_name", "field_name", "row_id", "reason", "ref_month")


def _judged(rows: DataFrame, status: DataFrame, heavy: list[tuple[str, int]]) -> DataFrame:
    """rows (entity, value, since, ...) whose reference is broken, with the reason."""
    if heavy:
        keys = rows.sparkSession.createDataFrame(heavy, "entity string, value long")
        few = F.broadcast(status.join(F.broadcast(keys), ["entity", "value"], "left_semi"))
        marked = rows.join(F.broadcast(keys.withColumn("heavy", F.lit(True))), ["entity", "value"], "left")
        joined = marked.where("heavy").drop("heavy").join(few, ["entity", "value"], "left")
        rest = marked.where("heavy is null").drop("heavy").join(status, ["entity", "value"], "left")
        joined = joined.unionByName(rest)
    else:
        joined = rows.join(status, ["entity", "value"], "left")
    present, removed = F.coalesce("present", F.lit(0)) == 1, F.coalesce("removed", F.lit(0)) == 1
    reason = (
        F.when(~present & ~removed, "missing")
        .when(removed & (~present | (F.col("removed_at") > F.col("latest"))), "deleted")
        .when(F.col("first") > F.col("since"), "late")
    )
    return joined.withColumn("reason", reason).where("reason is not null")


def orphan_report(tables: dict[str, DataFrame], deletions: DataFrame, refs: list[Reference], share: float = HEAVY_SHARE) -> DataFrame:
    """(table_name, field_name, ref_month, reason, n_refs): broken references counted, see orphan_references.

    References are counted per key, month and stamp first, so a key that a third of all rows name is
    a row per month and load; what is joined with the targets are these counts, the heavy keys'
    through a broadcast and the others' through a shuffle.
    """
    counts = references(tables, refs).groupBy("table_name", "field_name", "entity", "value", "ref_month", "since").agg(F.count("*").alias("n"))
    # Read for the total, the heavy keys and the join.
    counts = cut(counts)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = counts.groupBy("entity", "value").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(max(1.0, total * share))).select("entity", "value").collect()
    judged = _judged(counts, target_status(tables, deletions, refs), [(r.entity, r.value) for r in heavy])
    return judged.groupBy("table_name", "field_name", "ref_month", "reason").agg(F.sum("n").alias("n_refs"))

"""The client's side: deltas, batches, transport, acknowledgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH, BULK_BATCHES, BULK_ROWS = 100, 10, 1_000


def deltas(scanned: DataFrame, known: DataFrame, quarantined: DataFrame, *, complete_read: bool) -> DataFrame:
    """Entries to send: items that are new or whose revision moved and is not quarantined, and, after a complete read, deletions.

    All frames have source_item_id and revision.
    """
    old = known.select("source_item_id", F.col("revision").alias("old_revision"))
    changed = scanned.join(old, "source_item_id", "left").filter(~F.col("revision").eqNullSafe(F.col("old_revision"))).join(quarantined, ["source_item_id", "revision"], "left_anti")
    upserts = changed.select("source_item_id", "revision", F.lit("Upsert").alias("operation"))
    if not complete_read:
        return upserts
    return upserts.unionByName(known.join(scanned, "source_item_id", "left_anti").select("source_item_id", "revision", F.lit("Deleted").alias("operation")))


def batched(entries: DataFrame, *order: str | Column, size: int = BATCH, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries with a batch number.  Without keys the order is global: numbers come from ranges, not from one task."""
    if keys:
        return entries.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))
    ranged = entries.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_start"))
    n = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_start") - 1
    return ranged.join(F.broadcast(starts), "_p").withColumn("batch", F.floor(n / size)).drop("_p", "_start")


def transport(entries: DataFrame) -> DataFrame:
    """Whether a source's entries go in bulk: many, all hashed upserts, under one permission and cursor."""
    return entries.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.when(
            ((F.count(F.lit(1)) >= BULK_ROWS) | (F.ceil(F.count(F.lit(1)) / BATCH) >= BULK_BATCHES)) & F.bool_and((F.col("operation") == "Upsert") & F.col("content_sha256").isNotNull())
            & (F.count_distinct("permission") <= 1), "Bulk",
        ).otherwise("Incremental").alias("transport"),
    )


def acknowledge(sent: DataFrame, results: DataFrame) -> DataFrame:
    """Each sent entry as Accepted or Quarantined; one without a result has failed."""
    rows = sent.join(results.select("source_item_id", "outcome", "error_code"), "source_item_id", "left")
    failed = F.col("outcome").isNull() | (F.col("outcome") == "Rejected")
    return rows.withColumns({"state": F.when(failed, "Quarantined").otherwise("Accepted"), "error_code": F.when(F.col("outcome").isNull(), "MissingResult").otherwise(F.col("error_code"))})


def apply_known(known: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """What the client knows after accepted entries: upserts replace, deletions remove."""
    accepted = acknowledged.filter("state = 'Accepted'")
    kept = known.join(accepted, "source_item_id", "left_anti")
    return kept.unionByName(accepted.filter("operation = 'Upsert'").select(*known.columns))


def quarantine_of(failed: DataFrame) -> DataFrame:
    """(source_item_id, revision) from stored failure JSON: an object of items and revisions."""
    return failed.select(F.explode(F.from_json("failed_json", "map<string,string>")).alias("source_item_id", "revision"))

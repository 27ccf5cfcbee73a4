"""The incremental twin of the bulk merge: deletions, pending hashes, relinks, trash.

It differs from the bulk path on purpose: provenance is united instead of filled, an item may move to other content,
assets that lose their last occurrence go to the trash, and coordinates take over a resolved neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import public_id
from .merge import COMPARED, reject, reject_size_conflicts

MAX_BATCH = 500
UNSAFE_PERMISSIONS = ["Limited", "Denied", "Unavailable"]
PURGE_DAYS = 30


def check_batch(rows: DataFrame) -> None:
    n = rows.count()
    if not 1 <= n <= MAX_BATCH:
        raise ValueError(f"a batch has 1 to {MAX_BATCH} entries, not {n}")


def united_provenance(old: Column, new: Column) -> Column:
    """Old items, then new ones whose (field, source) is not there yet; the first of each pair stays."""
    empty = F.coalesce(old, F.array().cast("array<struct<field:string,source:string,confidence:string,processorVersion:string,observedAtUtc:string>>"))
    return F.aggregate(
        F.coalesce(new, F.array().cast("array<struct<field:string,source:string,confidence:string,processorVersion:string,observedAtUtc:string>>")), empty,
        lambda have, x: F.when(F.exists(have, lambda h: h["field"].eqNullSafe(x["field"]) & h["source"].eqNullSafe(x["source"])), have).otherwise(F.concat(have, F.array(x))),
    )


def outcomes(rows: DataFrame, occurrences: DataFrame, assets: DataFrame, *, reliable: bool, permission: str) -> DataFrame:
    """Each entry's outcome: rows have operation and position besides the columns of validated entries.

    Later entries of an item are rejected.  A deletion counts if detection is reliable, the permission is not limited and the
    item is active.  An entry without a hash is pending: it creates or updates the occurrence and lets go of the asset if the revision moved.
    """
    w = Window.partitionBy("source_item_id", "validation_state").orderBy("row_number")
    rows = rows.withColumn("_n", F.row_number().over(w))
    rows = reject(rows, F.col("_n") > 1, "DuplicateManifestEntry", "The source item stands in an earlier row.").drop("_n")
    rows = reject_size_conflicts(rows, assets)
    old = occurrences.select("source_item_id", "occurrence_id", F.col("asset_id").alias("linked_id"), F.col("deletion_state").alias("old_deletion"), F.col("hash_status").alias("old_hash"), *[F.col(c).alias(f"old_{c}") for c in COMPARED if c != "asset_id"])
    rows = rows.join(old, "source_item_id", "left")
    known, delete = F.col("occurrence_id").isNotNull(), F.col("operation") == "Deleted"
    may_delete = F.lit(reliable and permission not in UNSAFE_PERMISSIONS) & known & (F.col("old_deletion") == "Active")
    pending = F.col("content_sha256").isNull()
    asset_id = F.coalesce("old_asset_id", F.when(~pending, public_id("asset", F.col("content_sha256"))))
    moved = known & ~F.col("old_revision").eqNullSafe(F.col("source_revision"))
    same_facts = F.col("old_file_name").eqNullSafe(F.col("file_name")) & F.col("old_locator").eqNullSafe(F.col("locator")) & F.col("old_revision").eqNullSafe(F.col("source_revision")) & F.col("old_observed_size").eqNullSafe(F.col("byte_size")) & (F.col("old_deletion") == "Active")
    same = same_facts & (pending | (F.col("linked_id").eqNullSafe(asset_id) & (F.col("old_hash") == "Complete")))
    new_content = F.col("old_asset_id").isNull() & ~pending & (F.col("row_number") == F.col("first_row"))
    outcome = (
        F.when(F.col("validation_state") != "Valid", "Rejected").when(delete & may_delete, "Deleted").when(delete, "IgnoredDeletion").when(same, "Unchanged")
        .when(known, "UpdatedOccurrence").when(pending | new_content, "CreatedOccurrence").otherwise("DuplicateLinked")
    )
    link = F.when(delete, F.col("linked_id")).when(~pending, asset_id).when(moved, F.lit(None).cast("string")).otherwise(F.col("linked_id"))
    return rows.withColumns({"outcome": outcome, "asset_id": link, "relinked": known & ~pending & F.col("linked_id").isNotNull() & (F.col("linked_id") != asset_id), "occurrence_id": F.coalesce("occurrence_id", public_id("occurrence", F.col("source_item_id")))})


def apply_occurrences(classified: DataFrame, occurrences: DataFrame, user_id: int, source_id: int, as_of: Column) -> DataFrame:
    """Occurrences after the batch."""
    facts = {"file_name": "file_name", "locator": "locator", "revision": "source_revision", "observed_size": "byte_size"}
    acted = classified.filter("outcome in ('Deleted', 'UpdatedOccurrence', 'Unchanged')").select("occurrence_id", "outcome", F.col("asset_id").alias("in_asset_id"), F.col("content_sha256").alias("in_sha"), *[F.col(v).alias(f"in_{k}") for k, v in facts.items()])
    rows = occurrences.join(acted, "occurrence_id", "left")
    updated, gone = F.coalesce(F.col("outcome") == "UpdatedOccurrence", F.lit(False)), F.coalesce(F.col("outcome") == "Deleted", F.lit(False))
    kept = rows.withColumns({k: F.when(updated, F.col(f"in_{k}")).otherwise(F.col(k)) for k in facts} | {
        "asset_id": F.when(updated, F.col("in_asset_id")).otherwise(F.col("asset_id")), "deletion_state": F.when(gone, "Deleted").when(updated, "Active").otherwise(F.col("deletion_state")),
        "hash_status": F.when(updated, F.when(F.col("in_asset_id").isNull(), "Pending").otherwise("Complete")).otherwise(F.col("hash_status")), "last_seen": F.when(F.col("outcome").isNotNull(), as_of).otherwise(F.col("last_seen")),
    }).select(*occurrences.columns)
    new = classified.filter("outcome in ('CreatedOccurrence', 'DuplicateLinked')").select(
        "occurrence_id", F.lit(user_id).cast("long").alias("user_id"), F.lit(source_id).cast("long").alias("source_id"), "asset_id", "source_item_id", *[F.col(v).alias(k) for k, v in facts.items()],
        F.when(F.col("asset_id").isNull(), "Pending").otherwise("Complete").alias("hash_status"), F.lit("Available").alias("availability_state"), F.lit("Active").alias("deletion_state"), as_of.alias("first_seen"), as_of.alias("last_seen"),
    )
    return kept.unionByName(new.select(*occurrences.columns))


def trash_cascade(assets: DataFrame, occurrences: DataFrame, jobs: DataFrame, as_of: Column, *, touched: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assets, jobs, change rows): assets without an active occurrence go to the trash, with their open jobs; others come back.

    touched limits this to assets that lost or gained an occurrence.
    """
    active = occurrences.filter("deletion_state = 'Active' and asset_id is not null").select("asset_id").distinct().withColumn("_active", F.lit(True))
    rows = assets.join(active, "asset_id", "left")
    if touched is not None:
        rows = rows.join(touched.select("asset_id").distinct().withColumn("_touched", F.lit(True)), "asset_id", "left")
    concerned = F.coalesce("_touched", F.lit(False)) if touched is not None else F.lit(True)
    lost = concerned & F.col("_active").isNull() & (F.col("lifecycle_state") == "Active")
    back = concerned & F.col("_active").isNotNull() & (F.col("lifecycle_state") == "Trashed")
    rows = rows.withColumns({"_lost": lost, "_back": back})
    out = rows.withColumns({
        "lifecycle_state": F.when(F.col("_lost"), "Trashed").when(F.col("_back"), "Active").otherwise(F.col("lifecycle_state")),
        "purge_after": F.when(F.col("_lost"), as_of + F.make_dt_interval(F.lit(PURGE_DAYS))).when(~F.col("_back"), F.col("purge_after")),
    })
    gone = rows.filter("_lost").select("asset_id")
    changes = rows.filter("_lost or _back").select(F.col("asset_id").alias("entity_public_id"), F.when(F.col("_lost"), "Delete").otherwise("Upsert").alias("change_type"))
    open_ = jobs.join(gone.withColumn("_gone", F.lit(True)), "asset_id", "left")
    cancelled = open_.withColumn("status", F.when(F.col("_gone") & F.col("status").isin("Preparing", "Queued", "Running", "DeferredQuota"), "Cancelled").otherwise(F.col("status"))).drop("_gone")
    return out.select(*assets.columns), cancelled.select(*jobs.columns), changes


def remove_source(occurrences: DataFrame, sources: DataFrame, source_id: int, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(occurrences, sources): all active occurrences of the source are deleted, then the source is a tombstone."""
    hit = (F.col("source_id") == source_id) & (F.col("deletion_state") == "Active")
    gone = occurrences.withColumns({"last_seen": F.when(hit, as_of).otherwise(F.col("last_seen")), "deletion_state": F.when(hit, "Deleted").otherwise(F.col("deletion_state"))})
    return gone, sources.withColumn("source_status", F.when(F.col("source_id") == source_id, "Removed").otherwise(F.col("source_status")))

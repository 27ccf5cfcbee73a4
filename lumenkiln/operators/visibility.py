"""Which assets a device may see, and the occurrence that stands for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def occurrences_with_sources(occurrences: DataFrame, sources: DataFrame) -> DataFrame:
    """Occurrences with their source's device, mode and status.  Spark broadcasts the sources where they are small enough."""
    return occurrences.join(sources.select("source_id", "device_id", "storage_mode", "source_status"), "source_id")


def visible_assets(assets: DataFrame, occurrences: DataFrame, sources: DataFrame, device_id: int, *, with_trash: bool = False) -> DataFrame:
    """Assets with an occurrence the device may see.

    Without trash: an active, not unavailable occurrence in a source that is not removed and is remote or the device's own.  With
    trash, assets in the trash also count by deleted occurrences and by removed sources; that condition mixes both sides and
    stays in the semi join.
    """
    seen = occurrences_with_sources(occurrences, sources).filter((F.col("storage_mode") == "Remote") | (F.col("device_id") == device_id))
    live = (F.col("deletion_state") == "Active") & (F.col("availability_state") != "Unavailable")
    if not with_trash:
        keys = seen.filter(live & (F.col("source_status") != "Removed")).select("user_id", "asset_id")
        return assets.join(keys, ["user_id", "asset_id"], "left_semi")
    seen = seen.select(F.col("user_id").alias("o_user"), F.col("asset_id").alias("o_asset"), "deletion_state", "availability_state", "source_status")
    trashed = F.col("lifecycle_state") == "Trashed"
    fits = (live | (trashed & (F.col("deletion_state") == "Deleted"))) & ((F.col("source_status") != "Removed") | trashed)
    return assets.join(seen, (F.col("user_id") == F.col("o_user")) & (F.col("asset_id") == F.col("o_asset")) & fits, "left_semi")


def preferred_occurrence(occurrences: DataFrame, sources: DataFrame, device_id: int) -> DataFrame:
    """One occurrence an asset: the device's own first, then active, then the latest id."""
    rows = occurrences_with_sources(occurrences, sources).filter((F.col("storage_mode") == "Remote") | (F.col("device_id") == device_id))
    order = F.struct((F.col("device_id") == device_id).alias("own"), (F.col("deletion_state") == "Active").alias("active"), F.col("occurrence_id").alias("id"))
    # max_by combines before it moves, unlike a window
    best = F.max_by(F.struct("occurrence_id", "file_name", F.col("storage_mode").alias("source_mode")), order)
    return rows.filter("asset_id is not null").groupBy("user_id", "asset_id").agg(best.alias("best")).select("user_id", "asset_id", "best.*")


def availability(occurrences: DataFrame, sources: DataFrame, device_id: int) -> DataFrame:
    """has_remote and local_here of each asset, in one pass."""
    rows = occurrences_with_sources(occurrences, sources).filter((F.col("deletion_state") == "Active") & (F.col("source_status") != "Removed"))
    return rows.groupBy("user_id", "asset_id").agg(
        F.bool_or(F.col("storage_mode") == "Remote").alias("has_remote"),
        F.bool_or((F.col("availability_state") == "Available") & (F.col("device_id") == device_id)).alias("local_here"),
    )


def latest_current(rows: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """The current row with the greatest id of each asset."""
    best = F.max_by(F.struct(id_col, *columns), F.col(id_col))
    return rows.filter("is_current").groupBy("user_id", "asset_id").agg(best.alias("best")).select("user_id", "asset_id", "best.*")


#: Job statuses in order of precedence, with what the user is told.
STATES = [("DeferredQuota", "WaitingForMonthlyQuota"), ("Failed", "NeedsAttention"), ("Preparing", "Preparing"), ("Queued", "Processing"), ("Running", "Processing")]


def user_facing_state(jobs: DataFrame) -> DataFrame:
    """The state of each asset that has jobs, by precedence of their statuses."""
    rank = F.lit(len(STATES))
    for i, (status, _) in reversed(list(enumerate(STATES))):
        rank = F.when(F.col("status") == status, i).otherwise(rank)
    first = jobs.groupBy("user_id", "asset_id").agg(F.min(rank).alias("first"))
    said = F.lit("Ready")
    for i, (_, word) in reversed(list(enumerate(STATES))):
        said = F.when(F.col("first") == i, word).otherwise(said)
    return first.select("user_id", "asset_id", said.alias("state"))


def first_in_group(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each group, whole; the window keeps one row a group before the shuffle already."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

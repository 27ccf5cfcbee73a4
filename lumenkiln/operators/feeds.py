"""Change feed, jobs, devices and sources, and enrichment candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ingest.client import batched
from ..functions.text import blank, coordinate_revision, previewable


def keyset(rows: DataFrame, id_col: str, after: int | None, limit: int, *, descending: bool = False) -> DataFrame:
    """limit + 1 rows after an id, in its order."""
    if after is not None:
        rows = rows.filter(F.col(id_col) < after if descending else F.col(id_col) > after)
    return rows.orderBy(F.desc(id_col) if descending else F.asc(id_col)).limit(limit + 1)


#: Pages that an iteration over all of them goes through at most.
MAX_PAGES = 1_000


def all_pages(rows: DataFrame, *order: Column, size: int) -> DataFrame:
    """What going from page to page gives, in one go: each row with the number of its page, up to the thousandth."""
    return batched(rows, *order, size=size).withColumnRenamed("batch", "page").filter(F.col("page") < MAX_PAGES)


def changes_for(changes: DataFrame, visible: DataFrame, device_id: int) -> DataFrame:
    """Changes of no asset, of the device itself, or of an asset it may see."""
    seen = visible.select("asset_id").distinct().withColumn("seen", F.lit(True))
    rows = changes.join(seen, "asset_id", "left")
    return rows.filter(F.col("asset_id").isNull() | (F.col("device_id") == device_id) | F.coalesce("seen", F.lit(False))).drop("seen")


def can_retry() -> Column:
    return (F.col("status") == "DeferredQuota") | ((F.col("status") == "Failed") & (F.col("attempt_count") < F.col("max_attempts")))


def job_state() -> Column:
    return (
        F.when(F.col("status") == "DeferredQuota", "WaitingForMonthlyQuota").when(F.col("status") == "Failed", "NeedsAttention")
        .when(F.col("status").isin("Queued", "Running"), "Processing").when(F.col("status") == "Succeeded", "Ready").otherwise(F.col("status"))
    )


def due_jobs(jobs: DataFrame, as_of: Column, *, stale_seconds: int = 300) -> DataFrame:
    """Jobs to send again: queued, due and untouched for five minutes; running past the lease; deferred and due."""
    due = F.coalesce(F.col("next_attempt") <= as_of, F.lit(True))
    stale = F.col("updated_at") <= as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(stale_seconds))
    queued = (F.col("status") == "Queued") & due & stale
    running = (F.col("status") == "Running") & (F.col("lease_expires") <= as_of)
    deferred = (F.col("status") == "DeferredQuota") & due
    return jobs.filter(queued | running | deferred)


def sweep(jobs: DataFrame, as_of: Column) -> DataFrame:
    """What the recovery sweep makes of due jobs: exhausted ones fail, deferred descriptions prepare, others queue again."""
    after = (
        F.when(F.col("attempt_count") >= F.col("max_attempts"), "Failed")
        .when((F.col("status") == "DeferredQuota") & (F.col("job_type") == "Description"), "Preparing").otherwise("Queued")
    )
    return due_jobs(jobs, as_of).withColumn("new_status", after)


def unresolved_location() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("provider").isNull() | F.col("provider_updated").isNull())


def enrichment_candidates(assets: DataFrame, occurrences: DataFrame, locations: DataFrame, descriptions: DataFrame, jobs: DataFrame, *, limit: int = 64) -> DataFrame:
    """Assets that lack a description or a resolved location, with the jobs they would get.

    An asset stands for its smallest active occurrence.  Photos that can be previewed and have no current, non-blank
    description want one; located assets without a provider's answer want geocoding.  Assets that have a job of the kind are left out of it.
    """
    keys = ["user_id", "asset_id"]
    first = occurrences.filter("deletion_state = 'Active' and asset_id is not null").groupBy(*keys).agg(F.min_by(F.struct("occurrence_id", "file_name"), "occurrence_id").alias("first"))
    described = descriptions.filter("is_current").filter(~blank(F.col("description_text"))).select(*keys).distinct().withColumn("described", F.lit(True))
    has = jobs.groupBy(*keys).agg(F.bool_or(F.col("job_type") == "Geocode").alias("has_geocode"), F.bool_or(F.col("job_type") == "Description").alias("has_description"))
    rows = assets.filter("lifecycle_state = 'Active'").join(first, keys).join(locations, keys, "left").join(described, keys, "left").join(has, keys, "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumns({
        "wants_geocode": F.coalesce(unresolved_location(), F.lit(False)) & no("has_geocode"),
        "wants_description": (F.col("media_type") == "Photo") & previewable(F.col("first.file_name")) & no("described") & no("has_description"),
        "coordinate_revision": coordinate_revision(F.col("latitude"), F.col("longitude")),
    })
    rows = rows.filter("wants_geocode or wants_description").orderBy("asset_id").limit(limit)
    return rows.select(*keys, "first.occurrence_id", "first.file_name", "wants_geocode", "wants_description", "coordinate_revision")

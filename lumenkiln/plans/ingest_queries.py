"""Bulk merge, incremental batches, client deltas and catalog upserts on the role views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import upsert
from ..functions import text as X
from ..functions.text import public_id
from ..ingest import client, incremental, merge
from ..schemas import PROVENANCE
from ..views import numbered
from .registry import ORACLE_SQL, QUERIES, Roles, query

AS_OF = "2024-03-01 00:00:00"


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _none(frame):
    return frame.withColumn("provenance", F.lit(None).cast(PROVENANCE))


def _locations(r: Roles):
    """Old locations of old assets, some resolved."""
    at = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    key = F.substring("asset_id", 2, 10).cast("long")
    rows = r.old_asset.filter(key % 4 == 0).select("asset_id", "user_id", (key % 80).cast("decimal(9,6)").alias("latitude"), F.lit(0).cast("decimal(10,6)").alias("longitude"))
    return rows.withColumns({
        "altitude_m": F.lit(None).cast("decimal(10,3)"), "accuracy_m": F.lit(None).cast("decimal(10,3)"), "location_source": F.lit("Device"), "provider": F.lit("maps"), "place_id": F.lit("p"),
        "street_address": F.lit("1 Quay"), "city": F.lit("Town"), "state": F.lit("S"), "country": F.lit("C"), "rule_version": F.lit(None).cast("string"), "provider_updated": at,
    })


def _manifest(r: Roles) -> merge.Source:
    """The manifest's rows, kept as the numbered rows that the role makes them of; its digests are of sha2, so always 64 digits."""
    shares, make = numbered(r.spark, r.sf_dir, "manifest")
    return merge.Source(shares, _none(r.manifest.drop("operation")).columns, lambda kept: _none(make(kept).drop("operation")).withColumn("content_sha256", F.unhex("content_sha256")))


def _undated(source: merge.Source) -> merge.Source:
    """The same rows without their capture time, which no decision looks at."""
    kind = source.shares[0].schema["l_shipdate"].dataType
    return merge.Source(
        [share.drop("l_shipdate") for share in source.shares], [c for c in source.columns if c != "captured_local"],
        lambda kept: source.make(kept.withColumn("l_shipdate", F.lit(None).cast(kind))).drop("l_shipdate", "captured_local"))


def merged(r: Roles) -> merge.Merged:
    return merge.merge(_manifest(r), _none(r.old_asset), r.old_occurrence, _locations(r), user_id=1, source_id=1, as_of=now())


def decided(r: Roles, only: list[str] | None = None):
    """What `merged` decides on each row, where nothing else of it is asked for."""
    return merge.decided_rows(_undated(_manifest(r)), r.old_asset, r.old_occurrence, user_id=1, only=only)


STEPS = """
with v1 as (select *, row_number() over (partition by source_item_id, validation_state order by row_number) as dup from manifest),
v2 as (select * replace (case when validation_state = 'Valid' and dup > 1 then 'Rejected' else validation_state end as validation_state, case when validation_state = 'Valid' and dup > 1 then 'DuplicateManifestEntry' else error_code end as error_code) from v1),
canon as (select content_sha256, min(row_number) as first_row, min_by(byte_size, row_number) as canon_size from v2 where validation_state = 'Valid' group by 1),
v3 as (select v2.*, c.first_row, c.canon_size, a.asset_id as old_asset_id, a.byte_size as old_size from v2 left join canon c using (content_sha256) left join old_asset a using (content_sha256)),
v4 as (select * replace (case when bad then 'Rejected' else validation_state end as validation_state, case when bad then 'ContentHashMetadataMismatch' else error_code end as error_code)
  from (select *, validation_state = 'Valid' and first_row is not null and byte_size <> coalesce(old_size, canon_size) as bad from v3) x),
rows_ as (select v4.*, o.occurrence_id as known_id, o.asset_id as linked_id, o.deletion_state as old_deletion, o.file_name as o_file, o.locator as o_locator, o.revision as o_revision, o.observed_size as o_size
  from v4 left join old_occurrence o on o.source_item_id = v4.source_item_id and v4.validation_state = 'Valid'),
outcomes as (select *, case when validation_state <> 'Valid' then 'Rejected'
  when known_id is null and old_asset_id is null and row_number = min(case when known_id is null and validation_state = 'Valid' then row_number end) over (partition by content_sha256) then 'CreatedOccurrence'
  when known_id is null then 'DuplicateLinked'
  when linked_id is not distinct from old_asset_id and o_file = file_name and o_locator = locator and o_revision = source_revision and o_size = byte_size and old_deletion = 'Active' then 'Unchanged'
  else 'UpdatedOccurrence' end as outcome from rows_)
"""


def _step(name: str, select: str):
    return query(name, STEPS + select)


def _size_conflicts(r: Roles):
    """The rows, with the sizes that they were compared with."""
    rows = merge.reject_size_conflicts(merge.reject_duplicates(r.manifest.drop("operation")), r.old_asset)
    bad = rows.filter("error_code = 'ContentHashMetadataMismatch'")
    first = r.manifest.select(F.col("row_number").alias("first_row"), F.col("byte_size").alias("canon_size"))
    old = r.old_asset.select(F.col("asset_id").alias("old_asset_id"), F.col("byte_size").alias("old_size"))
    return bad.join(first, "first_row", "left").join(old, "old_asset_id", "left").select("row_number", "content_sha256", "byte_size", "old_size", "canon_size")


_OUTCOMES = "select row_number, outcome, error_code from outcomes"
_step("M15_outcomes", _OUTCOMES)(lambda r: decided(r).select("row_number", "outcome", "error_code"))
_step("M7_reject_duplicates", "select row_number, source_item_id from v2 where error_code = 'DuplicateManifestEntry'")(
    lambda r: merge.reject_duplicates(r.manifest.drop("operation")).filter("error_code = 'DuplicateManifestEntry'").select("row_number", "source_item_id"))
_step("M10_size_conflicts", "select row_number, content_sha256, byte_size, old_size, canon_size from v4 where error_code = 'ContentHashMetadataMismatch'")(_size_conflicts)
_step("M16_first_created", "select content_sha256, min(row_number) as row_number from rows_ where validation_state = 'Valid' and known_id is null and old_asset_id is null group by 1")(
    lambda r: decided(r).filter("outcome = 'CreatedOccurrence'").select("content_sha256", "row_number"))
_step("M24_counters", "select count(*) as processed, " + ", ".join(f"count(*) filter (where outcome = '{o}') as {n}" for n, o in merge.OUTCOMES.items()) + " from outcomes")(
    lambda r: merge.outcome_counts(decided(r, ["outcome"])).withColumnsRenamed({n: n for n in merge.OUTCOMES}))
_step("M25_status", "select case when count(*) filter (where outcome = 'Rejected') > 0 then 'CompletedWithErrors' else 'Completed' end as status from outcomes")(
    lambda r: decided(r, ["outcome"]).agg(F.when(F.count_if(F.col("outcome") == "Rejected") > 0, "CompletedWithErrors").otherwise("Completed").alias("status")))
_step("M24_result_rows", "select row_number as rowNumber, source_item_id as sourceItemId, outcome, error_code as errorCode from outcomes")(
    lambda r: merge.result_rows(decided(r)).select("rowNumber", "sourceItemId", "outcome", "errorCode"))
_step("M22_failures", "select row_number, source_item_id, error_code from outcomes where outcome = 'Rejected'")(lambda r: merge.failures(decided(r), now()).select("row_number", "source_item_id", "error_code"))
_step("M11_new_assets", "select content_sha256, byte_size, width, captured_local, case when captured_local is not null then 'Unknown' end as capture_source from outcomes where validation_state = 'Valid' and old_asset_id is null and row_number = first_row")(
    lambda r: merged(r).assets.filter("length(asset_id) = 64").select("content_sha256", "byte_size", "width", "captured_local", "capture_source"))
_GAP = """select a.asset_id, case when c.changed then coalesce(a.width, c.width) else a.width end as width, case when c.changed then coalesce(a.captured_local, c.captured_local) else a.captured_local end as captured_local,
  case when c.changed then 'Active' else a.lifecycle_state end as lifecycle_state from old_asset a left join (select o.old_asset_id as asset_id, o.width, o.captured_local,
    a.lifecycle_state = 'Trashed' or (a.width is null and o.width is not null) or (a.captured_local is null and o.captured_local is not null) as changed
    from outcomes o join old_asset a on a.asset_id = o.old_asset_id where o.validation_state = 'Valid' and o.row_number = o.first_row) c using (asset_id)"""
_step("M13_gap_fill", _GAP)(lambda r: merged(r).old_assets.select("asset_id", "width", "captured_local", "lifecycle_state"))
_CHANGED = """select o.old_asset_id as asset_id from outcomes o join old_asset a on a.asset_id = o.old_asset_id where o.validation_state = 'Valid' and o.row_number = o.first_row
    and (a.lifecycle_state = 'Trashed' or (a.width is null and o.width is not null) or (a.captured_local is null and o.captured_local is not null))"""
_step("M12_changed_assets", _CHANGED)(lambda r: merged(r).changes.filter("entity_type = 'MediaAsset' and length(asset_id) < 64").select("asset_id"))
_step("M17_occurrences", """select source_item_id, max(file_name) as file_name, max(deletion_state) as deletion_state, max(revision) as revision from (
  select source_item_id, file_name, 'Active' as deletion_state, source_revision as revision from outcomes where outcome in ('CreatedOccurrence', 'DuplicateLinked', 'UpdatedOccurrence')
  union all select o.source_item_id, o.file_name, o.deletion_state, o.revision from old_occurrence o where o.occurrence_id not in (select known_id from outcomes where outcome = 'UpdatedOccurrence')) x group by 1""")(
    lambda r: merged(r).occurrences.select("source_item_id", "file_name", "deletion_state", "revision"))
_step("M18_changes", """select 'MediaAsset' as entity_type, (select count(*) from outcomes where validation_state = 'Valid' and old_asset_id is null and row_number = first_row) + (select count(*) from outcomes o join old_asset a on a.asset_id = o.old_asset_id
    where o.validation_state = 'Valid' and o.row_number = o.first_row and (a.lifecycle_state = 'Trashed' or (a.width is null and o.width is not null) or (a.captured_local is null and o.captured_local is not null))) as n
  union all select 'MediaOccurrence', count(*) from outcomes where outcome in ('CreatedOccurrence', 'DuplicateLinked', 'UpdatedOccurrence') union all select 'MediaSource', 1""")(
    lambda r: merged(r).changes.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")))
_step("M14_asset_changes", f"select content_sha256, 'Upsert' as change_type from outcomes where validation_state = 'Valid' and old_asset_id is null and row_number = first_row union all select content_sha256, 'Upsert' from old_asset where asset_id in ({_CHANGED})")(
    lambda r: merged(r).asset_changes.select("content_sha256", "change_type"))
query("M23_source_change", f"select 'source-1' as entity_public_id, 'Upsert' as change_type, timestamp '{AS_OF}' as created_at, timestamp '{AS_OF}' as last_complete_scan, 'snapshot-1' as snapshot_id")(
    lambda r: (lambda m: m.changes.filter("entity_type = 'MediaSource'").select("entity_public_id", "change_type", "created_at").join(
        merge.refreshed(r.spark.createDataFrame([(1, None, None), (2, None, "old")], "source_id long, last_complete_scan timestamp_ntz, snapshot_id string"), 1, "snapshot-1", now())
        .filter("source_id = 1").select(F.concat(F.lit("source-"), "source_id").alias("entity_public_id"), "last_complete_scan", "snapshot_id"), "entity_public_id"))(merged(r)))
_step("M19_locations", """select coalesce(l.asset_id, n.content) as asset, coalesce(n.latitude, l.latitude) as latitude, case when n.latitude is null or (n.latitude = l.latitude and n.longitude = l.longitude) then l.provider end as provider
  from (select asset_id, cast(cast(substr(asset_id, 2) as bigint) % 80 as decimal(9,6)) as latitude, cast(0 as decimal(10,6)) as longitude, 'maps' as provider from old_asset where cast(substr(asset_id, 2) as bigint) % 4 = 0) l
  full join (select max(old_asset_id) as asset_id, case when max(old_asset_id) is null then content_sha256 end as content, max_by(latitude, row_number) as latitude, max_by(longitude, row_number) as longitude
    from outcomes where validation_state = 'Valid' and latitude is not null group by content_sha256) n on n.asset_id = l.asset_id""")(
    lambda r: (lambda m: m.locations.join(m.assets.select("asset_id", "content_sha256"), "asset_id", "left").select(F.when(F.length("asset_id") < 64, F.col("asset_id")).otherwise(F.col("content_sha256")).alias("asset"), "latitude", "provider"))(merged(r)))
query("M8_relinks", "select count(*) as relinks from manifest m join old_occurrence o using (source_item_id) join old_asset a using (asset_id) where m.validation_state = 'Valid' and a.content_sha256 <> m.content_sha256")(
    lambda r: merge.relinks(r.manifest, r.old_occurrence, r.old_asset).agg(F.count(F.lit(1)).alias("relinks")))


def _rerun(r: Roles):
    """The same manifest again over what it made: everything valid is unchanged."""
    m = merged(r)
    return merge.outcome_counts(merge.decided_rows(_undated(m.again), m.assets, m.occurrences, user_id=1, check_relinks=False, only=["outcome"]))


_step("M_rerun_unchanged", "select count(*) as processed, " + ", ".join(
    f"cast({'count(*) filter (where outcome <> ' + chr(39) + 'Rejected' + chr(39) + ')' if n == 'unchanged' else 'count(*) filter (where outcome = ' + chr(39) + 'Rejected' + chr(39) + ')' if n == 'rejected' else '0'} as bigint) as {n}" for n in merge.OUTCOMES) + " from outcomes")(_rerun)
query("M20_geocode_jobs", "select 'geocode:' || location_id || ':' || location_id as idempotency_key from location where latitude is not null and provider is null and location_id not in (select asset_id from job where job_type = 'Geocode' and asset_id is not null)")(
    lambda r: merge.geocode_jobs(
        r.location.select("user_id", F.col("location_id").cast("string").alias("asset_id"), "latitude", "provider", "location_id"),
        r.job.filter("job_type = 'Geocode' and asset_id is not null").select((F.col("asset_id") % 3).alias("user_id"), F.concat(F.lit("geocode:"), "asset_id", F.lit(":"), "asset_id").alias("idempotency_key"), "job_id", "status"),
        F.col("location_id").cast("string"))[0].select("idempotency_key"))
query("M21_description_jobs", "select asset_id, min(row_no) as row_no from (select content_key as asset_id, row_no, file_name from stage where file_name is not null) s where asset_id not in (select asset_id from description where is_current) group by 1")(
    lambda r: merge.description_jobs(
        r.stage.filter("file_name is not null").select(F.col("content_key").alias("asset_id"), F.col("row_no").alias("row_number"), F.col("import_id").cast("string").alias("occurrence_id"), "file_name"), r.description,
        r.spark.createDataFrame([], "idempotency_key string"), X.previewable(F.col("file_name")), F.concat(F.lit("d:"), "asset_id")).select("asset_id", F.col("row_number").alias("row_no")))

# ---- incremental


def _incremental(r: Roles, reliable: bool = True, permission: str = "Full"):
    rows = r.manifest.withColumn("content_sha256", F.when(F.col("row_number") % 13 != 0, F.col("content_sha256")))
    rows = rows.withColumn("byte_size", F.when(F.col("content_sha256").isNotNull(), F.col("byte_size")))
    return incremental.outcomes(rows, r.old_occurrence, r.old_asset, reliable=reliable, permission=permission)


def _incremental_sql(may_delete: str) -> str:
    steps = STEPS.replace("from manifest)", "from (select * replace (case when row_number % 13 <> 0 then content_sha256 end as content_sha256, case when row_number % 13 <> 0 then byte_size end as byte_size) from manifest) m)").split("rows_ as (")[0]
    return steps + f"""rows_ as (select v4.*, o.occurrence_id as known_id, o.asset_id as linked_id, o.deletion_state as old_deletion, o.file_name as o_file, o.locator as o_locator, o.revision as o_revision, o.observed_size as o_size
      from v4 left join old_occurrence o on o.source_item_id = v4.source_item_id)
    select row_number, case when validation_state <> 'Valid' then 'Rejected' when operation = 'Deleted' and {may_delete} and known_id is not null and old_deletion = 'Active' then 'Deleted' when operation = 'Deleted' then 'IgnoredDeletion'
      when known_id is not null and o_file = file_name and o_locator = locator and o_revision = source_revision and o_size is not distinct from byte_size and old_deletion = 'Active'
        and (content_sha256 is null or linked_id is not distinct from old_asset_id) then 'Unchanged'
      when known_id is not null then 'UpdatedOccurrence' when content_sha256 is null or (old_asset_id is null and row_number = first_row) then 'CreatedOccurrence' else 'DuplicateLinked' end as outcome from rows_"""


query("N5_outcomes", _incremental_sql("true"))(lambda r: _incremental(r).select("row_number", "outcome"))
query("N1_batch_duplicates", _incremental_sql("true").rsplit("select row_number, case", 1)[0] + "select row_number, source_item_id from rows_ where error_code = 'DuplicateManifestEntry'")(
    lambda r: _incremental(r).filter("error_code = 'DuplicateManifestEntry'").select("row_number", "source_item_id"))
for _name, _where in (("N3_pending_upserts", "content_sha256 is null"), ("N4_hashed_upserts", "content_sha256 is not null")):
    query(_name, _incremental_sql("true") + f" where {_where} and operation = 'Upsert'")(
        lambda r, w=_where: _incremental(r).filter(f"{w} and operation = 'Upsert'").select("row_number", "outcome"))
query("N2_ignored_deletions", _incremental_sql("false"))(lambda r: _incremental(r, permission="Denied").select("row_number", "outcome"))
query("N6_relinked_items", "select count(*) as relinked from (select m.row_number from manifest m join old_occurrence o using (source_item_id) join old_asset a on a.asset_id = o.asset_id where m.content_sha256 <> a.content_sha256) x")(
    lambda r: _incremental(r).filter("relinked").agg(F.count(F.lit(1)).alias("relinked")))
query("N7_trash_cascade", "select asset_id, case when asset_id in (select asset_id from occurrence where deletion_state = 'Active') then 'Active' else 'Trashed' end as lifecycle_state from asset where lifecycle_state = 'Active'")(
    lambda r: incremental.trash_cascade(r.asset.filter("lifecycle_state = 'Active'").withColumn("purge_after", F.lit(None).cast("timestamp_ntz")), r.occurrence, r.job, now())[0].select("asset_id", "lifecycle_state"))
query("N8_restored", "select asset_id from asset where lifecycle_state = 'Trashed' and asset_id in (select asset_id from occurrence where deletion_state = 'Active')")(
    lambda r: incremental.trash_cascade(r.asset.filter("lifecycle_state = 'Trashed'").withColumn("purge_after", F.lit(None).cast("timestamp_ntz")), r.occurrence, r.job, now())[0].filter("lifecycle_state = 'Active'").select("asset_id"))
query("N7_cancelled_jobs", "select job_id from job where status in ('Preparing', 'Queued', 'Running', 'DeferredQuota') and asset_id in (select asset_id from asset where lifecycle_state = 'Active' and asset_id not in (select asset_id from occurrence where deletion_state = 'Active' and source_id % 3 = 0))")(
    lambda r: incremental.trash_cascade(r.asset.withColumn("purge_after", F.lit(None).cast("timestamp_ntz")), r.occurrence.filter("source_id % 3 = 0"), r.job, now())[1].filter("status = 'Cancelled'").select("job_id"))
query("N10_source_removal", "select occurrence_id, case when source_id = 5 then 'Deleted' else deletion_state end as deletion_state from occurrence")(
    lambda r: incremental.remove_source(r.occurrence, r.source, 5, now())[0].select("occurrence_id", "deletion_state"))

# ---- client


def _scan(r: Roles):
    s = r.occurrence.filter("import_id % 3 <> 0").select(F.col("occurrence_id").cast("string").alias("source_item_id"), F.concat(F.lit("r"), (F.col("observed_size") % 7).cast("string")).alias("revision"))
    k = r.occurrence.filter("import_id % 5 <> 0").select(F.col("occurrence_id").cast("string").alias("source_item_id"), F.concat(F.lit("r"), (F.col("asset_id") % 7).cast("string")).alias("revision"))
    q = r.occurrence.filter("row_no = 2").select(F.col("occurrence_id").cast("string").alias("source_item_id"), F.concat(F.lit("r"), (F.col("observed_size") % 7).cast("string")).alias("revision"))
    return s, k, q


query("P2_deltas", """with s as (select cast(occurrence_id as string) as i, 'r' || (observed_size % 7) as r from occurrence where import_id % 3 <> 0), k as (select cast(occurrence_id as string) as i, 'r' || (asset_id % 7) as r from occurrence where import_id % 5 <> 0)
  select s.i as source_item_id, s.r as revision, 'Upsert' as operation from s left join k on k.i = s.i where s.r is distinct from k.r and s.i not in (select cast(occurrence_id as string) from occurrence where row_no = 2)
  union all select k.i, k.r, 'Deleted' from k where k.i not in (select i from s)""")(lambda r: client.deltas(*_scan(r), complete_read=True))
query("P2_global_batches", "select occurrence_id, (row_number() over (order by occurrence_id) - 1) // 100 as batch from occurrence")(lambda r: client.batched(r.occurrence.select("occurrence_id"), "occurrence_id"))
query("P3_transport", "select source_id, count(*) as entries, case when (count(*) >= 1000 or ceil(count(*) / 100e0) >= 10) and bool_and(deletion_state = 'Active' or source_id % 2 = 0) then 'Bulk' else 'Incremental' end as transport from occurrence group by 1")(
    lambda r: client.transport(r.occurrence.select("source_id", F.when((F.col("deletion_state") == "Active") | (F.col("source_id") % 2 == 0), "Upsert").otherwise("Deleted").alias("operation"), F.lit("x").alias("content_sha256"), F.lit("Full").alias("permission"))))
query("P4_rebatched", "select source_id, occurrence_id, (row_number() over (partition by source_id order by occurrence_id) - 1) // 37 as batch from occurrence")(
    lambda r: client.batched(r.occurrence.select("source_id", "occurrence_id"), "occurrence_id", size=37, keys=("source_id",)))
query("P5_acknowledged", "select cast(s.occurrence_id as string) as source_item_id, case when r.flag is null or r.flag = 'R' then 'Quarantined' else 'Accepted' end as state, case when r.flag is null then 'MissingResult' end as error_code from occurrence s left join (select import_id * 1000 + row_no as id, flag from stage where row_no < 5) r on r.id = s.occurrence_id")(
    lambda r: client.acknowledge(r.occurrence.select(F.col("occurrence_id").cast("string").alias("source_item_id")), r.stage.filter("row_no < 5").select((F.col("import_id") * 1000 + F.col("row_no")).cast("string").alias("source_item_id"), F.when(F.col("flag") == "R", "Rejected").otherwise("Ok").alias("outcome"), F.lit(None).cast("string").alias("error_code"))).select("source_item_id", "state", "error_code"))
query("P6_quarantine_json", "select unnest(json_keys(props)) as source_item_id, json_extract_string(props, '$.k') as revision from events")(lambda r: client.quarantine_of(r.events.select(F.col("props").alias("failed_json"))))
query("P7_result_pages", "select row_no, (row_no - 1) // 3 as page from stage where import_id = 7 and row_no > 2")(lambda r: r.stage.filter("import_id = 7 and row_no > 2").select("row_no", F.floor((F.col("row_no") - 1) / 3).alias("page")))
query("P8_fast_add", "select 'path:' || sha256(file_name) as source_item_id, sha256(concat_ws(':', cast(observed_size as string), cast(row_no as string), 'pending')) as revision from occurrence")(
    lambda r: r.occurrence.select(X.item_id(F.col("file_name")).alias("source_item_id"), X.item_revision(F.col("observed_size"), F.col("row_no")).alias("revision")))
query("P1_item_ids", "select occurrence_id, 'path:' || sha256(file_name) as item_id, sha256(concat_ws(':', cast(observed_size as string), cast(row_no as string), sha256(file_name))) as revision from occurrence")(
    lambda r: r.occurrence.select("occurrence_id", X.item_id(F.col("file_name")).alias("item_id"), X.item_revision(F.col("observed_size"), F.col("row_no"), F.sha2("file_name", 256)).alias("revision")))

# ---- legacy writes
_L1 = "select coalesce(o.location_id, n.asset_id) as location_id, case when n.asset_id is not null then n.media_type else o.city end as city, case when o.location_id is not null then o.category else n.category end as category, coalesce(o.street_address, n.content_sha256) as street_address from location o full join (select asset_id, media_type, category, content_sha256 from asset where asset_id % 2 = 0) n on n.asset_id = o.location_id"


@query("L1_upsert", _L1)
def _(r: Roles):
    old = r.location.select("location_id", "city", "category", "street_address")
    new = r.asset.filter("asset_id % 2 = 0").select(F.col("asset_id").alias("location_id"), F.col("media_type").alias("city"), "category", F.col("content_sha256").alias("street_address"))
    return upsert(old, new, ["location_id"], {"category": "keep", "street_address": "coalesce_old"})


query("L2_update_columns", "select a.asset_id, coalesce(l.category, a.category) as category from asset a left join location l on l.asset_id = a.asset_id")(
    lambda r: r.asset.select("asset_id", "category").join(r.location.select("asset_id", F.col("category").alias("new")), "asset_id", "left").select("asset_id", F.coalesce("new", "category").alias("category")))
query("L3_manual_tag", "select location_id, case when city = 'Town3' then 'Harbour' else category end as category, case when city = 'Town3' then 'Manual' else category_source end as category_source from location")(
    lambda r: r.location.join(r.location.filter("city = 'Town3'").select("location_id", F.lit(True).alias("hit")), "location_id", "left").select(
        "location_id", F.when(F.col("hit"), "Harbour").otherwise(F.col("category")).alias("category"), F.when(F.col("hit"), "Manual").otherwise(F.col("category_source")).alias("category_source")))
query("L5_backfill_times", "select asset_id, coalesce(captured_utc, captured_local + to_minutes(240), created_at) as utc, cast(coalesce(captured_local, created_at) as date) as day, strftime(coalesce(captured_local, created_at), '%H:%M:%S') as time_of_day from asset")(
    lambda r: r.asset.select("asset_id", F.coalesce("captured_utc", F.col("captured_local") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(240)), "created_at").alias("utc"), F.to_date(F.coalesce("captured_local", "created_at")).alias("day"), F.date_format(F.coalesce("captured_local", "created_at"), "HH:mm:ss").alias("time_of_day")))
query("L6_recaption_rule", "select description_id from description where description_text is null or trim(description_text) = '' or language <> 'en' or created_at < timestamp '2020-01-01 01:00:00'")(
    lambda r: r.description.filter(X.blank(F.col("description_text")) | (F.col("language") != "en") | (F.col("created_at") < F.lit("2020-01-01 01:00:00").cast("timestamp_ntz"))).select("description_id"))
query("M_public_ids", "select asset_id, sha256('asset|' || user_id || '|' || content_sha256) as public_id from asset")(lambda r: r.asset.select("asset_id", public_id("asset", F.col("user_id"), F.col("content_sha256")).alias("public_id")))

"""Filters, joins, aggregates, windows, pages and set operations of the catalog, on the role views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..functions import times as T
from ..functions.address import address_matches
from ..operators import feeds
from ..operators.media import LOCATION_FIELDS, located
from ..operators.visibility import availability, first_in_group, latest_current, preferred_occurrence, user_facing_state, visible_assets
from .registry import Roles, query

DEVICE = 3

# ---- filters

query("S16_tenant_scan", "select asset_id, byte_size from asset where user_id = 1")(lambda r: r.asset.filter("user_id = 1").select("asset_id", "byte_size"))


@query("F1_point_lookup", "select asset_id, content_sha256 from asset where user_id = 1 and content_sha256 = (select content_sha256 from asset where asset_id = 7)")
def _(r: Roles):
    key = r.asset.filter("asset_id = 7").select("content_sha256")
    return r.asset.filter("user_id = 1").join(key, "content_sha256", "left_semi").select("asset_id", "content_sha256")


@query("F2_key_prefetch", "select occurrence_id, asset_id from occurrence where asset_id in (select p_partkey from part where p_size < 3)")
def _(r: Roles):
    keys = r.part.filter("p_size < 3").select(F.col("p_partkey").alias("asset_id"))
    return r.occurrence.join(keys, "asset_id", "left_semi").select("occurrence_id", "asset_id")


query("F3_type_and_category", "select asset_id from asset where media_type = 'Photo' and category = 'Brand#11'")(lambda r: r.asset.filter("media_type = 'Photo' and category = 'Brand#11'").select("asset_id"))


@query("F4_capture_window", "select asset_id, captured_utc from asset where captured_utc >= timestamp '2020-01-02' and captured_utc < timestamp '2020-01-09'")
def _(r: Roles):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return r.asset.filter((F.col("captured_utc") >= at("2020-01-02")) & (F.col("captured_utc") < at("2020-01-09"))).select("asset_id", "captured_utc")


query("F5_trash_state", "select asset_id from asset where lifecycle_state = 'Trashed'")(lambda r: r.asset.filter("lifecycle_state = 'Trashed'").select("asset_id"))


@query("F6_text_search", r"""
select asset_id, user_id from asset a where
  exists (select 1 from occurrence o where o.user_id = a.user_id and o.asset_id = a.asset_id and lower(o.file_name) like '%g_1%')
  or exists (select 1 from description d where d.user_id = a.user_id and d.asset_id = a.asset_id and d.is_current and lower(d.description_text) like '%g_1%')
  or exists (select 1 from transcript t where t.user_id = a.user_id and t.asset_id = a.asset_id and t.is_current and lower(t.transcript_text) like '%g_1%')
  or exists (select 1 from location l where l.user_id = a.user_id and l.asset_id = a.asset_id and (lower(l.street_address) like '%g_1%' or lower(l.city) like '%g_1%' or lower(l.state) like '%g_1%' or lower(l.country) like '%g_1%'))
  or lower(category) like '%g_1%' or lower(media_type) like '%g_1%' or strftime(captured_local, '%Y-%m-%d %H:%M:%S.%f') like '%g_1%' or strftime(captured_utc, '%Y-%m-%d %H:%M:%S.%f') like '%g_1%'
""")
def _(r: Roles):
    from ..operators.media import search

    return search(catalog(r), r.asset, "G_1").select("asset_id", "user_id")


@query("F7_date_as_text", "select asset_id from asset where strftime(captured_utc, '%Y-%m-%d %H:%M:%S.%f') like '%-01-0_ 1%'")
def _(r: Roles):
    return r.asset.filter(T.as_search_text(F.col("captured_utc")).like("%-01-0_ 1%")).select("asset_id")


@query("F8_previewable_files", r"select occurrence_id from occurrence where regexp_matches(lower(file_name), '\.(jpg|jpeg|png|webp|heic|heif|gif|bmp|tif|tiff)$')")
def _(r: Roles):
    return r.occurrence.filter(X.previewable(F.col("file_name"))).select("occurrence_id")


query("F9_unresolved_location", "select location_id from location where latitude is not null and longitude is not null and (provider is null or provider_updated is null)")(lambda r: r.location.filter(feeds.unresolved_location()).select("location_id"))

_DUE = """(status = 'Queued' and next_attempt <= timestamp '2024-02-01' and updated_at <= timestamp '2024-02-01' - interval 300 second)
  or (status = 'Running' and lease_expires <= timestamp '2024-02-01') or (status = 'DeferredQuota' and next_attempt <= timestamp '2024-02-01')"""


def as_of():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


query("F10_due_work", f"select job_id, status from job where {_DUE}")(lambda r: feeds.due_jobs(r.job, as_of()).select("job_id", "status"))


@query("F11_address_tokens", "select location_id from location where lower(street_address) like '%12%' and lower(street_address) like '%quay%' and (lower(street_address) like '%ave%' or lower(street_address) like '%avenue%')")
def _(r: Roles):
    return r.location.filter(~X.blank(F.col("street_address"))).filter(address_matches(F.col("street_address"), "12 Quay Ave, Oldtown")).select("location_id")


_HAV = "2 * {R} * atan2(sqrt({v}), sqrt(greatest(0, 1 - ({v}))))"
_V = "(sin(radians({b1} - {a1}) / 2) ** 2 + cos(radians({a1})) * cos(radians({b1})) * sin(radians({b2} - {a2}) / 2) ** 2)"


def _dist(a1, a2, b1, b2, radius="6371008.8"):
    v = _V.format(a1=a1, a2=a2, b1=b1, b2=b2)
    return _HAV.format(R=radius, v=v)


@query("F12_box_and_radius", f"select location_id, cast(round({_dist('10e0', '20e0', 'latitude', 'longitude', '6371000.0')}, 1) as double) as distance_m from location where {_dist('10e0', '20e0', 'latitude', 'longitude', '6371000.0')} <= 3000000")
def _(r: Roles):
    d = geo.haversine(F.lit(10.0), F.lit(20.0), F.col("latitude"), F.col("longitude"), geo.LEGACY_EARTH_M)
    box = (F.abs(F.col("latitude") - 10) <= geo.lat_delta(3_000_000)) & (geo.lon_apart(F.col("longitude"), F.lit(20.0)) <= geo.lon_delta(F.lit(38.0), 3_000_000))
    return r.location.filter(box & (d <= 3_000_000)).select("location_id", F.round(d, 1).alias("distance_m"))


query("F13_unclassified", "select asset_id from asset where coalesce(trim(category), '') = ''")(lambda r: r.asset.filter(X.blank(F.col("category"))).select("asset_id"))


@query("F14_missing_gps", r"select occurrence_id from occurrence o where not regexp_matches(lower(file_name), '\.(png|webp)$') and asset_id not in (select asset_id from location where latitude is not null)")
def _(r: Roles):
    rows = r.occurrence.filter(~F.lower("file_name").rlike(r"\.(png|webp)$"))
    return rows.join(r.location.filter("latitude is not null").select("asset_id"), "asset_id", "left_anti").select("occurrence_id")


query("F15_local_day", "select asset_id from asset where cast(captured_local as date) = date '2020-01-05'")(lambda r: r.asset.filter(F.to_date("captured_local") == F.lit("2020-01-05").cast("date")).select("asset_id"))


@query("F16_temporal_audit", "select asset_id from asset where abs(date_sub('second', captured_local - to_minutes(cast(-240 + asset_id % 2 as bigint)), captured_utc)) > 1")
def _(r: Roles):
    return r.asset.filter(F.abs(T.seconds_off(F.col("captured_local"), F.lit(-240) + F.col("asset_id") % 2, F.col("captured_utc"))) > 1).select("asset_id")


query("F17_non_blank_text", "select description_id from description where length(trim(description_text)) > 0")(lambda r: r.description.filter(F.length(F.trim("description_text")) > 0).select("description_id"))


@query("F18_locator_redaction", f"select occurrence_id, case when device_id = {DEVICE} then file_name end as locator from occurrence join source using (source_id)")
def _(r: Roles):
    return r.occurrence.join(r.source, "source_id").select("occurrence_id", F.when(F.col("device_id") == DEVICE, F.col("file_name")).alias("locator"))


query("F19_null_safe_equality", "select a.asset_id, a.category is not distinct from l.category as same from asset a left join location l on l.asset_id = a.asset_id")(
    lambda r: r.asset.join(r.location.select("asset_id", F.col("category").alias("l_category")), "asset_id", "left").select("asset_id", F.col("category").eqNullSafe(F.col("l_category")).alias("same")))


@query("F20_media_and_mime", """select occurrence_id, case when e in ('mp4') then 'Video' when e in ('png', 'nef', 'jpg') then 'Photo' end as media_type,
  case e when 'mp4' then 'video/mp4' when 'png' then 'image/png' when 'jpg' then 'image/jpeg' else 'application/octet-stream' end as mime_type
  from (select occurrence_id, lower(regexp_extract(file_name, '\\.([a-zA-Z0-9]+)$', 1)) as e from occurrence) x""")
def _(r: Roles):
    return r.occurrence.select("occurrence_id", X.media_type(F.col("file_name")).alias("media_type"), X.mime_type(F.col("file_name")).alias("mime_type"))


@query("F21_cutoff_with_zone", "select occurrence_id from occurrence where last_seen >= timestamp '1996-07-01 04:00:00'")
def _(r: Roles):
    cutoff = T.utc_from_local("America/New_York", F.lit("1996-07-01 00:00:00").cast("timestamp_ntz"))
    return r.occurrence.filter(F.col("last_seen") >= cutoff).select("occurrence_id")


query("F22_outbox_filter", "select job_id from job where status = 'Failed' and source_id = 3 order by job_id limit 1000")(lambda r: r.job.filter("status = 'Failed' and source_id = 3").orderBy("job_id").limit(1000).select("job_id"))


@query("F23_selector", "select source_id, count(*) over () as matches from source where source_key = 'src-3' or cast(source_id as string) = 'src-3' or lower(display_name) = 'src-3'")
def _(r: Roles):
    one = r.source.filter((F.col("source_key") == "src-3") | (F.col("source_id").cast("string") == "src-3") | (F.lower("display_name") == "src-3"))
    return one.agg(F.max("source_id").alias("source_id"), F.count(F.lit(1)).alias("matches"))


# ---- joins

VISIBLE = """exists (select 1 from occurrence o join source s on s.source_id = o.source_id where o.user_id = a.user_id and o.asset_id = a.asset_id
  and o.deletion_state = 'Active' and o.availability_state <> 'Unavailable' and s.source_status <> 'Removed' and (s.storage_mode = 'Remote' or s.device_id = {d}))"""
VISIBLE_TRASH = """exists (select 1 from occurrence o join source s on s.source_id = o.source_id where o.user_id = a.user_id and o.asset_id = a.asset_id
  and ((o.deletion_state = 'Active' and o.availability_state <> 'Unavailable') or (a.lifecycle_state = 'Trashed' and o.deletion_state = 'Deleted'))
  and (s.source_status <> 'Removed' or a.lifecycle_state = 'Trashed') and (s.storage_mode = 'Remote' or s.device_id = {d}))"""


def catalog(r: Roles):
    from ..operators.media import Catalog

    return Catalog(r.asset, r.occurrence, r.source, r.location, r.description, r.transcript, r.segment, r.job)


query("J1_visible_assets", f"select asset_id from asset a where {VISIBLE.format(d=DEVICE)}")(lambda r: visible_assets(r.asset, r.occurrence, r.source, DEVICE).select("asset_id"))
query("J1_visible_with_trash", f"select asset_id from asset a where {VISIBLE_TRASH.format(d=DEVICE)}")(lambda r: visible_assets(r.asset, r.occurrence, r.source, DEVICE, with_trash=True).select("asset_id"))
query("J2_in_source", "select asset_id from asset a where exists (select 1 from occurrence o where o.asset_id = a.asset_id and o.user_id = a.user_id and o.source_id = 5)")(
    lambda r: r.asset.join(r.occurrence.filter("source_id = 5"), ["user_id", "asset_id"], "left_semi").select("asset_id"))
query("J3_has_location", "select asset_id from asset where asset_id in (select asset_id from location where latitude is not null and longitude is not null)")(
    lambda r: r.asset.join(located(r.location), ["user_id", "asset_id"], "left_semi").select("asset_id"))
query("J3_has_no_location", "select asset_id from asset where asset_id not in (select asset_id from location where latitude is not null and longitude is not null)")(
    lambda r: r.asset.join(located(r.location), ["user_id", "asset_id"], "left_anti").select("asset_id"))
_J4 = "select asset_id from asset a where exists (select 1 from occurrence o where o.asset_id = a.asset_id and lower(o.file_name) like '%_7.%') or exists (select 1 from location l where l.asset_id = a.asset_id and lower(l.city) like '%town3%')"


@query("J4_existence_join", _J4)
def _(r: Roles):
    return r.spark.sql(_J4.replace("from asset a", "from {asset} a").replace("from occurrence o", "from {occurrence} o").replace("from location l", "from {location} l"), asset=r.asset, occurrence=r.occurrence, location=r.location)


_PREFERRED = f"""select user_id, asset_id, occurrence_id, file_name, storage_mode as source_mode from (select o.*, s.storage_mode, row_number() over (partition by o.user_id, o.asset_id
  order by (s.device_id = {DEVICE}) desc, (o.deletion_state = 'Active') desc, o.occurrence_id desc) as n from occurrence o join source s on s.source_id = o.source_id where s.storage_mode = 'Remote' or s.device_id = {DEVICE}) x where n = 1"""
for _name in ("J5_preferred_occurrence", "T3_preferred_top1", "W0d_preferred_window"):
    query(_name, _PREFERRED)(lambda r: preferred_occurrence(r.occurrence, r.source, DEVICE))


@query("J6_change_feed_join", f"select change_id from change c where c.asset_id is null or c.device_id = {DEVICE} or c.asset_id in (select a.asset_id from asset a where {VISIBLE.format(d=DEVICE)})")
def _(r: Roles):
    return feeds.changes_for(r.change, visible_assets(r.asset, r.occurrence, r.source, DEVICE), DEVICE).select("change_id")


@query("J7_detail_fan_out", """select a.asset_id, (select count(*) from occurrence o join source s on s.source_id = o.source_id where o.asset_id = a.asset_id) as occurrences, l.city, d.description_text
  from asset a left join location l on l.asset_id = a.asset_id left join (select asset_id, max_by(description_text, description_id) as description_text from description where is_current group by asset_id) d on d.asset_id = a.asset_id""")
def _(r: Roles):
    keys = ["user_id", "asset_id"]
    n = r.occurrence.join(r.source, "source_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))
    d = latest_current(r.description, "description_id", "description_text")
    rows = r.asset.join(n, keys, "left").join(r.location.select(*keys, "city"), keys, "left").join(d, keys, "left")
    return rows.select("asset_id", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "city", "description_text")


@query("J8_enrichment_candidates", r"""with f as (select user_id, asset_id, min(occurrence_id) as occurrence_id, min_by(file_name, occurrence_id) as file_name from occurrence where deletion_state = 'Active' group by 1, 2),
  j as (select user_id, asset_id, bool_or(job_type = 'Geocode') as g, bool_or(job_type = 'Description') as d from job group by 1, 2),
  dd as (select distinct user_id, asset_id from description where is_current and coalesce(trim(description_text), '') <> ''),
  x as (select a.user_id, a.asset_id, f.occurrence_id, f.file_name,
    coalesce(l.latitude is not null and l.longitude is not null and (l.provider is null or l.provider_updated is null), false) and not coalesce(j.g, false) as wants_geocode,
    a.media_type = 'Photo' and regexp_matches(lower(f.file_name), '\.(jpg|jpeg|png|webp|heic|heif|gif|bmp|tif|tiff)$') and dd.asset_id is null and not coalesce(j.d, false) as wants_description,
    case when l.latitude is not null and l.longitude is not null then sha256(cast(cast(l.latitude as decimal(9,6)) as string) || ',' || cast(cast(l.longitude as decimal(10,6)) as string)) end as coordinate_revision
  from asset a join f using (user_id, asset_id) left join location l using (user_id, asset_id) left join j using (user_id, asset_id) left join dd using (user_id, asset_id) where a.lifecycle_state = 'Active')
  select * from x where wants_geocode or wants_description order by asset_id limit 64""")
def _(r: Roles):
    return feeds.enrichment_candidates(r.asset, r.occurrence, r.location, r.description, r.job)


query("Q10_prepare_enrichment", None)(lambda r: feeds.enrichment_candidates(r.asset, r.occurrence, r.location, r.description, r.job, limit=64))
from .registry import ORACLE_SQL as _O  # noqa: E402

_O["Q10_prepare_enrichment"] = _O["J8_enrichment_candidates"]

query("J9_promotion", "select asset_id from asset where media_type = 'Photo' and asset_id in (select asset_id from occurrence where source_id = 4 and deletion_state = 'Active')")(
    lambda r: r.asset.filter("media_type = 'Photo'").join(r.occurrence.filter("source_id = 4 and deletion_state = 'Active'"), "asset_id", "left_semi").select("asset_id"))
query("J10_stage_with_existing", "select s.import_id, s.row_no, o.occurrence_id from stage s left join occurrence o on o.import_id = s.import_id and o.row_no = s.row_no and o.deletion_state = 'Active'")(
    lambda r: r.stage.join(r.occurrence.filter("deletion_state = 'Active'").select("import_id", "row_no", "occurrence_id"), ["import_id", "row_no"], "left").select("import_id", "row_no", "occurrence_id"))
_DUP = "select import_id, row_no from (select import_id, row_no, row_number() over (partition by import_id, source_item_id order by row_no) as n from stage) x where n > 1"


def _duplicates(r: Roles):
    w = Window.partitionBy("import_id", "source_item_id").orderBy("row_no")
    return r.stage.withColumn("n", F.row_number().over(w)).filter("n > 1").select("import_id", "row_no")


query("J11_stage_duplicates", _DUP)(_duplicates)
query("W0a_first_per_item", _DUP.replace("n > 1", "n = 1"))(
    lambda r: r.stage.groupBy("import_id", "source_item_id").agg(F.min("row_no").alias("row_no")).select("import_id", "row_no"))
query("J12_relinks", "select count(*) as relinks from stage s join part p on p.p_partkey = s.source_id where s.content_key <> p.p_size")(
    lambda r: r.stage.join(r.part, F.col("source_id") == F.col("p_partkey")).filter("content_key <> p_size").agg(F.count(F.lit(1)).alias("relinks")))
query("J13_hash_resolution", "select w.content_key, a.asset_id from (select distinct content_key from stage) w left join asset a on a.asset_id = w.content_key and a.user_id = w.content_key % 3")(
    lambda r: r.stage.select("content_key").distinct().join(r.asset.select("asset_id", "user_id"), (F.col("asset_id") == F.col("content_key")) & (F.col("user_id") == F.col("content_key") % 3), "left").select("content_key", "asset_id"))
_LAST = "select import_id, content_key, row_no from stage e where not exists (select 1 from stage l where l.import_id = e.import_id and l.content_key = e.content_key and l.row_no > e.row_no)"
for _name in ("J14_no_later_row", "W0b_last_located_row"):
    query(_name, _LAST)(lambda r: r.stage.groupBy("import_id", "content_key").agg(F.max("row_no").alias("row_no")))
query("J15_job_anti_insert", "select 'geocode:' || l.asset_id || ':' || l.location_id as job_key from location l where 'geocode:' || l.asset_id || ':' || l.location_id not in (select 'geocode:' || asset_id || ':' || asset_id from job where job_type = 'Geocode' and asset_id is not null)")(
    lambda r: r.location.select(F.concat(F.lit("geocode:"), "asset_id", F.lit(":"), "location_id").alias("job_key")).join(
        r.job.filter("job_type = 'Geocode'").select(F.concat(F.lit("geocode:"), "asset_id", F.lit(":"), "asset_id").alias("job_key")), "job_key", "left_anti"))
query("J16_orphan_assets", "select asset_id from asset where asset_id not in (select asset_id from occurrence where deletion_state = 'Active')")(
    lambda r: r.asset.join(r.occurrence.filter("deletion_state = 'Active'"), "asset_id", "left_anti").select("asset_id"))
query("J17_import_claim", "select o.o_orderkey as import_id, s.source_key, c.c_name as owner from orders o join source s on s.source_id = o.o_orderkey % 7 join customer c on c.c_custkey = o.o_custkey where o.o_orderstatus = 'O'")(
    lambda r: r.orders.filter("o_orderstatus = 'O'").join(r.source, F.col("source_id") == F.col("o_orderkey") % 7).join(r.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("import_id"), "source_key", F.col("c_name").alias("owner")))
query("J18_dispatchable_jobs", "select distinct j.job_id from stage s join job j on j.asset_id = s.content_key where j.status = 'Queued'")(
    lambda r: r.job.filter("status = 'Queued'").join(r.stage.select(F.col("content_key").alias("asset_id")), "asset_id", "left_semi").select("job_id"))


@query("J19_page_then_aggregate", "select count(*) as n, count(l.location_id) as mapped, coalesce(min(p.asset_id), 0) as first_id, coalesce(max(p.asset_id), 0) as last_id from (select asset_id from asset where asset_id > 20 order by asset_id limit 100) p left join location l on l.asset_id = p.asset_id")
def _(r: Roles):
    page = r.asset.filter("asset_id > 20").orderBy("asset_id").limit(100).select("asset_id")
    rows = page.join(r.location.select("asset_id", "location_id"), "asset_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("location_id").alias("mapped"), F.coalesce(F.min("asset_id"), F.lit(0)).alias("first_id"), F.coalesce(F.max("asset_id"), F.lit(0)).alias("last_id"))


query("J20_deletions", "select occurrence_id from occurrence where deletion_state = 'Active' and asset_id not in (select p_partkey from part where p_size % 2 = 0)")(
    lambda r: r.occurrence.filter("deletion_state = 'Active'").join(r.part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("asset_id")), "asset_id", "left_anti").select("occurrence_id"))
query("J21_deltas", "select a.asset_id from asset a left join location k on k.asset_id = a.asset_id where (k.location_id is null or k.location_id % 5 <> a.byte_size % 5) and a.asset_id not in (select asset_id from job where status = 'Failed' and asset_id is not null)")(
    lambda r: r.asset.join(r.location.select("asset_id", "location_id"), "asset_id", "left").filter("location_id is null or location_id % 5 <> byte_size % 5").join(r.job.filter("status = 'Failed'").select("asset_id"), "asset_id", "left_anti").select("asset_id"))
query("J22_result_match", "select s.import_id, s.row_no, case when o.occurrence_id is null then 'Failed' else 'Accepted' end as outcome from stage s left join occurrence o on o.occurrence_id = s.import_id * 1000 + s.row_no and o.observed_size > 10")(
    lambda r: r.stage.withColumn("occurrence_id", F.col("import_id") * 1000 + F.col("row_no")).join(r.occurrence.filter("observed_size > 10").select("occurrence_id", F.lit(True).alias("there")), "occurrence_id", "left").select("import_id", "row_no", F.when(F.col("there").isNull(), "Failed").otherwise("Accepted").alias("outcome")))
query("J27_latest_candidate", "select asset_id, description_id from (select asset_id, description_id, row_number() over (partition by asset_id order by created_at desc, description_id) as n from description) x where n = 1")(
    lambda r: first_in_group(r.description, ["asset_id"], F.desc("created_at"), F.asc("description_id")).select("asset_id", "description_id"))
for _name in ("J28_idle_check",):
    query(_name, "select (select count(*) from job where status in ('Queued', 'Running')) as active_jobs, (select count(*) from orders where o_orderstatus = 'O') as active_imports")(
        lambda r: r.job.agg(F.count_if(F.col("status").isin("Queued", "Running")).alias("active_jobs")).crossJoin(r.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("active_imports"))))

# ---- aggregates

query("A1_active_occurrences", "select asset_id, count(*) filter (where deletion_state = 'Active') - 1 as others from occurrence group by asset_id having count(*) filter (where deletion_state = 'Active') > 0")(
    lambda r: r.occurrence.groupBy("asset_id").agg(F.count_if(F.col("deletion_state") == "Active").alias("n")).filter("n > 0").select("asset_id", (F.col("n") - 1).alias("others")))
query("A2_availability", f"""select user_id, asset_id, bool_or(storage_mode = 'Remote') as has_remote, bool_or(availability_state = 'Available' and device_id = {DEVICE}) as local_here
  from occurrence o join source s on s.source_id = o.source_id where deletion_state = 'Active' and source_status <> 'Removed' group by 1, 2""")(lambda r: availability(r.occurrence, r.source, DEVICE))
_FLAGS = [("A", "created"), ("N", "unchanged"), ("R", "rejected")]


@query("A3_outcome_counters", "select import_id, count(*) as processed, " + ", ".join(f"count(*) filter (where flag = '{f}') as {n}" for f, n in _FLAGS) + " from stage group by import_id")
def _(r: Roles):
    return r.stage.groupBy("import_id").agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("flag") == f).alias(n) for f, n in _FLAGS])


query("A4_stage_counters", "select count(*) as loaded, count(file_name) as validated, count(*) - count(file_name) as rejected from stage")(
    lambda r: r.stage.agg(F.count(F.lit(1)).alias("loaded"), F.count("file_name").alias("validated"), F.count_if(F.col("file_name").isNull()).alias("rejected")))
query("A5_first_of_repeated", "select import_id, source_item_id, min(row_no) as first_row from stage group by 1, 2 having count(*) > 1")(
    lambda r: r.stage.groupBy("import_id", "source_item_id").agg(F.min("row_no").alias("first_row"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
_A6 = "select import_id, content_key, min(row_no) as row_no, min_by(byte_size, row_no) as byte_size from stage group by 1, 2"
for _name in ("A6_canonical_row", "A7_first_new_row", "M9_asset_work"):
    query(_name, _A6)(lambda r: r.stage.groupBy("import_id", "content_key").agg(F.min("row_no").alias("row_no"), F.min_by("byte_size", "row_no").alias("byte_size")))
query("A8_first_eligible_row", r"select content_key, min(import_id * 1000 + row_no) as first_row from stage where regexp_matches(file_name, '\.jpg$') group by 1")(
    lambda r: r.stage.filter(X.previewable(F.col("file_name"))).groupBy("content_key").agg(F.min(F.col("import_id") * 1000 + F.col("row_no")).alias("first_row")))
query("A9_first_occurrence", "select asset_id, min(occurrence_id) as occurrence_id from occurrence group by 1")(lambda r: r.occurrence.groupBy("asset_id").agg(F.min("occurrence_id").alias("occurrence_id")))
query("A10_distinct_statuses", "select distinct asset_id, status from job")(lambda r: r.job.select("asset_id", "status").distinct())
query("A11_user_facing_state", """select user_id, asset_id, case when bool_or(status = 'DeferredQuota') then 'WaitingForMonthlyQuota' when bool_or(status = 'Failed') then 'NeedsAttention' when bool_or(status = 'Preparing') then 'Preparing'
  when bool_or(status in ('Queued', 'Running')) then 'Processing' else 'Ready' end as state from job group by 1, 2""")(lambda r: user_facing_state(r.job))
_STATES = ["Preparing", "Queued", "Running", "Succeeded", "Failed", "DeferredQuota", "Cancelled"]
query("A12_count_by_state", "select " + ", ".join(f"count(*) filter (where status = '{s}') as {s.lower()}" for s in _STATES) + " from job")(lambda r: r.job.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in _STATES]))
query("A13_pending_failed_remaining", "select count(*) filter (where status in ('Queued', 'Preparing')) as pending, count(*) filter (where status = 'Failed') as failed, count(*) filter (where status <> 'Succeeded') as remaining from job")(
    lambda r: r.job.agg(F.count_if(F.col("status").isin("Queued", "Preparing")).alias("pending"), F.count_if(F.col("status") == "Failed").alias("failed"), F.count_if(F.col("status") != "Succeeded").alias("remaining")))
query("A14_status_histogram", "select status, count(*) as n from job group by 1 order by 2 desc, 1")(lambda r: r.job.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "status"))
_COUNTED = ["asset", "occurrence", "source", "location", "job"]


@query("A15_table_counts", " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in _COUNTED))
def _(r: Roles):
    from functools import reduce

    return reduce(lambda a, b: a.union(b), [getattr(r, t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("n")) for t in _COUNTED])


query("A16_page_statistics", "select count(*) as n, coalesce(min(event_id), 0) as first_id, coalesce(max(event_id), 0) as last_id, count(*) filter (where json_extract_string(props, '$.k') is null) as without_k, count(*) filter (where value > 50) as large from (select * from events order by event_id limit 500) p")(
    lambda r: r.events.orderBy("event_id").limit(500).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("event_id"), F.lit(0)).alias("first_id"), F.coalesce(F.max("event_id"), F.lit(0)).alias("last_id"),
        F.count_if(F.get_json_object("props", "$.k").isNull()).alias("without_k"), F.count_if(F.col("value") > 50).alias("large")))
_SNAP = """select count(*) as total, count(l.latitude) as with_gps, count(*) - count(l.latitude) as without_gps, count(d.asset_id) as with_description, count(*) - count(d.asset_id) as without_description,
  min(cast(captured_local as date)) as first_date, max(cast(captured_local as date)) as last_date from asset a left join location l on l.asset_id = a.asset_id left join (select distinct asset_id from description where is_current) d on d.asset_id = a.asset_id"""


def _snapshot(r: Roles):
    d = r.description.filter("is_current").select("asset_id").distinct().withColumn("has", F.lit(1))
    rows = r.asset.join(r.location.select("asset_id", "latitude"), "asset_id", "left").join(d, "asset_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("latitude").alias("with_gps"), F.count_if(F.col("latitude").isNull()).alias("without_gps"), F.count("has").alias("with_description"),
        F.count_if(F.col("has").isNull()).alias("without_description"), F.min(F.to_date("captured_local")).alias("first_date"), F.max(F.to_date("captured_local")).alias("last_date"))


for _name in ("A17_snapshot", "Q14_snapshot"):
    query(_name, _SNAP)(_snapshot)
_CATS = "select coalesce(nullif(trim(category), ''), '(NULL)') as category, count(*) as n from asset group by 1 order by 2 desc, 1"
for _name in ("A18_category_summary", "Q18_category_summary"):
    query(_name, _CATS)(lambda r: r.asset.groupBy(F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("(NULL)")).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category"))
_ADDR = "select street_address, street_number, category, category_source, count(*) as n from location group by 1, 2, 3, 4"
for _name in ("A19_address_audit", "Q19_address_audit"):
    query(_name, _ADDR)(lambda r: r.location.groupBy("street_address", "street_number", "category", "category_source").agg(F.count(F.lit(1)).alias("n")))
query("A20_coverage", "select count(*) as total, count(latitude) as gps, count(street_address) as addressed, count(category) as categorised, max(modified_at) as last_modified from location")(
    lambda r: r.location.agg(F.count(F.lit(1)).alias("total"), F.count("latitude").alias("gps"), F.count("street_address").alias("addressed"), F.count("category").alias("categorised"), F.max("modified_at").alias("last_modified")))
query("A21_scan_summary", "select count(*) as scanned, count(*) filter (where observed_size % 3 = 0) as cached, count(*) filter (where observed_size % 3 = 1) as hashed, count(*) filter (where observed_size % 3 = 2) as failed, round(count(*) / 31.04e0, 1) as files_per_second from occurrence")(
    lambda r: r.occurrence.agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.col("observed_size") % 3 == i).alias(n) for i, n in enumerate(("cached", "hashed", "failed"))], F.round(F.count(F.lit(1)) / 31.04, 1).alias("files_per_second")))
query("A22_manifest_counts", "select flag as outcome, count(*) as n from stage group by 1")(lambda r: r.stage.groupBy(F.col("flag").alias("outcome")).agg(F.count(F.lit(1)).alias("n")))
query("A23_reject_reconciliation", "select import_id, count(*) filter (where flag = 'R') as reported, count(*) filter (where file_name is null) as observed, count(*) filter (where flag = 'R') = count(*) filter (where file_name is null) as agree from stage group by 1")(
    lambda r: r.stage.groupBy("import_id").agg(F.count_if(F.col("flag") == "R").alias("reported"), F.count_if(F.col("file_name").isNull()).alias("observed")).withColumn("agree", F.col("reported") == F.col("observed")))
query("A24_progress", "select source_id, round(100e0 * count(*) filter (where status = 'Succeeded') / count(*), 1) as percent from job group by 1")(
    lambda r: r.job.groupBy("source_id").agg(F.round(F.lit(100.0) * F.count_if(F.col("status") == "Succeeded") / F.count(F.lit(1)), 1).alias("percent")))
query("A25_monthly_usage", "select user_id, provider, usage_month, cast(sum(units) as bigint) as processed, cast(sum(usd) as decimal(30,6)) as usd from usage group by 1, 2, 3")(
    lambda r: r.usage.groupBy("user_id", "provider", "usage_month").agg(F.sum("units").alias("processed"), F.sum("usd").alias("usd")))
query("A26_more_probe", "select count(*) > 0 as more from (select 1 from asset where asset_id > 150 limit 1) x")(lambda r: r.asset.filter("asset_id > 150").limit(1).agg((F.count(F.lit(1)) > 0).alias("more")))

# ---- windows

query("W0c_latest_description", "select user_id, asset_id, max(description_id) as description_id, max_by(description_text, description_id) as description_text from description where is_current group by 1, 2")(lambda r: latest_current(r.description, "description_id", "description_text"))
query("T4_latest_transcript", "select user_id, asset_id, max(transcript_id) as transcript_id, max_by(transcript_text, transcript_id) as transcript_text from transcript where is_current group by 1, 2")(lambda r: latest_current(r.transcript, "transcript_id", "transcript_text"))
query("W0e_first_matching_segment", "select transcript_id, min(sequence_number) as sequence_number, min_by(start_ms, sequence_number) as start_ms from segment where lower(segment_text) like '%ing%' group by 1")(
    lambda r: r.segment.filter(X.matches(F.col("segment_text"), "ing")).groupBy("transcript_id").agg(F.min("sequence_number").alias("sequence_number"), F.min_by("start_ms", "sequence_number").alias("start_ms")))
query("W0f_latest_per_job", "select asset_id, job_id, status from (select *, row_number() over (partition by asset_id order by updated_at desc, job_id) as n from job) x where n = 1")(
    lambda r: first_in_group(r.job, ["asset_id"], F.desc("updated_at"), F.asc("job_id")).select("asset_id", "job_id", "status"))
query("W0h_duplicates_in_batch", "select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id, role order by turn) as n from conversations) x where n > 1")(
    lambda r: r.conversations.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))).filter("n > 1").select("conv_id", "turn"))
query("W0i_batches_of_100", "select source_id, occurrence_id, (row_number() over (partition by source_id order by occurrence_id) - 1) // 100 as batch from occurrence")(
    lambda r: r.occurrence.select("source_id", "occurrence_id", F.floor((F.row_number().over(Window.partitionBy("source_id").orderBy("occurrence_id")) - 1) / 100).alias("batch")))
_PREFIX = "select source_id, import_id, n from (select *, sum(n) over (partition by source_id order by import_id rows between unbounded preceding and current row) as total, row_number() over (partition by source_id order by import_id) as k from (select source_id, import_id, count(*) as n from occurrence group by 1, 2) b) x where total <= 100 or k = 1"


@query("W0j_bounded_prefix", _PREFIX)
def _(r: Roles):
    w = Window.partitionBy("source_id").orderBy("import_id")
    rows = r.occurrence.groupBy("source_id", "import_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumns({"total": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(w)})
    return rows.filter("total <= 100 or k = 1").select("source_id", "import_id", "n")


# ---- pages and top-k

query("T2_keyset_desc", "select job_id from job where job_id < 700 order by job_id desc limit 51")(lambda r: feeds.keyset(r.job, "job_id", 700, 50, descending=True).select("job_id"))
query("T2_keyset_asc", "select change_id from change where change_id > 100 order by change_id limit 51")(lambda r: feeds.keyset(r.change, "change_id", 100, 50).select("change_id"))
query("T5_cursor_column", """select asset_id, rtrim(translate(base64(encode('{"v":1,"k":"media","p":["' || asset_id || '","' || byte_size || '"]}')), '+/', '-_'), '=') as cursor from asset""")(
    lambda r: r.asset.select("asset_id", X.cursor_column("media", F.col("asset_id"), F.col("byte_size")).alias("cursor")))
query("T7_manual_first", "select street_address, location_id from (select *, row_number() over (partition by street_address order by case when category_source = 'Manual' then 0 else 1 end, modified_at desc, location_id desc) as n from location where street_address is not null and category is not null) x where n = 1")(
    lambda r: first_in_group(r.location.filter("street_address is not null and category is not null"), ["street_address"], F.when(F.col("category_source") == "Manual", 0).otherwise(1), F.desc("modified_at"), F.desc("location_id")).select("street_address", "location_id"))
query("T8_due_order", f"select job_id from job where {_DUE} order by next_attempt, job_id limit 100")(lambda r: feeds.due_jobs(r.job, as_of()).orderBy("next_attempt", "job_id").limit(100).select("job_id"))
_LATEST = "select asset_id, captured_local from asset where captured_local is not null order by captured_local desc, asset_id desc limit 25"
for _name in ("T9_latest_25", "Q15_latest_photos"):
    query(_name, _LATEST)(lambda r: r.asset.filter("captured_local is not null").orderBy(F.desc("captured_local"), F.desc("asset_id")).limit(25).select("asset_id", "captured_local"))
query("T10_preview_10", "select location_id from location where lower(city) like '%town3%' order by location_id limit 10")(lambda r: r.location.filter(X.matches(F.col("city"), "town3")).orderBy("location_id").limit(10).select("location_id"))
query("T11_path_order", "select occurrence_id, file_name from occurrence order by lower(file_name), occurrence_id")(lambda r: r.occurrence.orderBy(F.lower("file_name"), "occurrence_id").select("occurrence_id", "file_name"))
query("T12_result_order", "select row_no, source_item_id from stage where import_id = 7 order by row_no")(lambda r: r.stage.filter("import_id = 7").orderBy("row_no").select("row_no", "source_item_id"))
query("T13_checkpoint_page", "select asset_id from asset where asset_id > 20 order by asset_id limit 100")(lambda r: r.asset.filter("asset_id > 20").orderBy("asset_id").limit(100).select("asset_id"))

# ---- set operations

query("E1_union_by_id", "select location_id, case when location_id % 3 = 0 then 'radius' else 'address' end as found_by from location where location_id % 2 = 0 or location_id % 3 = 0")(
    lambda r: r.location.filter("location_id % 2 = 0").select("location_id", F.lit(1).alias("k")).unionByName(r.location.filter("location_id % 3 = 0").select("location_id", F.lit(2).alias("k")))
    .groupBy("location_id").agg(F.max("k").alias("k")).select("location_id", F.when(F.col("k") == 2, "radius").otherwise("address").alias("found_by")))
query("E2_set_difference", "select asset_id from asset except select asset_id from occurrence")(lambda r: r.asset.select("asset_id").subtract(r.occurrence.select("asset_id")))
query("E3_set_equality", "select (select count(*) from (select asset_id from asset except all select asset_id from location) x) + (select count(*) from (select asset_id from location except all select asset_id from asset) y) = 0 as equal_sets")(
    lambda r: r.asset.select("asset_id").exceptAll(r.location.select("asset_id")).union(r.location.select("asset_id").exceptAll(r.asset.select("asset_id"))).agg((F.count(F.lit(1)) == 0).alias("equal_sets")))


@query("E4_provenance_union", "select asset_id, list_sort(list_distinct([category, 'exif', media_type, category])) as merged from (select asset_id, coalesce(category, 'none') as category, media_type from asset) a")
def _(r: Roles):
    a = r.asset.withColumn("category", F.coalesce("category", F.lit("none")))
    return a.select("asset_id", F.array_sort(F.array_union(F.array("category", F.lit("exif")), F.array("media_type", "category"))).alias("merged"))


@query("E5_ordered_distinct", "select asset_id, case when media_type = category then [media_type, 'x'] else [media_type, category, 'x'] end as items from (select asset_id, media_type, coalesce(category, 'none') as category from asset) a")
def _(r: Roles):
    return r.asset.select("asset_id", F.array_distinct(F.array("media_type", F.coalesce("category", F.lit("none")), "media_type", F.lit("x"))).alias("items"))

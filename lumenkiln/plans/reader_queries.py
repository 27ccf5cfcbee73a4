"""What readers ask: timeline, search, detail, feed, jobs, analyst reports, spatial lookups, propagation."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.address import Rule, address_matches, first_rule
from ..operators import feeds, media, spatial
from ..operators.media import MediaQuery
from ..operators.visibility import visible_assets
from .catalog_queries import _ADDR, _PREFERRED, DEVICE, VISIBLE, VISIBLE_TRASH, _dist, as_of, catalog
from .registry import ORACLE_SQL, QUERIES, Roles, query

_SUMMARY = f"""summary as (
  select p.*, o.file_name as display_file_name, o.occurrence_id, case when coalesce(f.has_remote, false) then 'Remote' else o.source_mode end as storage_mode,
    case when coalesce(f.local_here, false) then 'LocalOnThisDevice' else 'Unavailable' end as availability, coalesce(j.state, 'Ready') as state,
    left(d.description_text, 500) as description_excerpt, p.lifecycle_state = 'Trashed' as is_trashed
  from page p join ({_PREFERRED}) o using (user_id, asset_id)
  left join (select o.user_id, o.asset_id, bool_or(storage_mode = 'Remote') as has_remote, bool_or(availability_state = 'Available' and device_id = {DEVICE}) as local_here
    from occurrence o join source s on s.source_id = o.source_id where deletion_state = 'Active' and source_status <> 'Removed' group by 1, 2) f using (user_id, asset_id)
  left join (select user_id, asset_id, case when bool_or(status = 'DeferredQuota') then 'WaitingForMonthlyQuota' when bool_or(status = 'Failed') then 'NeedsAttention'
    when bool_or(status = 'Preparing') then 'Preparing' when bool_or(status in ('Queued', 'Running')) then 'Processing' else 'Ready' end as state from job group by 1, 2) j using (user_id, asset_id)
  left join (select user_id, asset_id, max_by(description_text, description_id) as description_text from description where is_current group by 1, 2) d using (user_id, asset_id))"""
_KEY = "coalesce(captured_utc, captured_local, created_at)"
_COLUMNS = ["asset_id", "sort_key", "display_file_name", "storage_mode", "availability", "state", "description_excerpt", "is_trashed"]


def _timeline_sql(where: str, order: str, limit: int, key: str = _KEY, visible: str = VISIBLE) -> str:
    return f"with page as (select a.*, {key} as sort_key from asset a where {visible.format(d=DEVICE)} and {where} order by {order} limit {limit + 1}), {_SUMMARY} select {', '.join(_COLUMNS)} from summary"


@query("Q1_timeline", _timeline_sql("lifecycle_state = 'Active'", "sort_key desc, asset_id desc", 50))
def _(r: Roles):
    return media.timeline(catalog(r), MediaQuery(device_id=DEVICE)).select(*_COLUMNS)


@query("Q1_timeline_filtered", _timeline_sql(
    "lifecycle_state = 'Active' and media_type = 'Photo' and captured_utc >= timestamp '2020-01-02' and captured_utc < timestamp '2020-03-01' and asset_id in (select asset_id from location where latitude is not null and longitude is not null)",
    "sort_key, asset_id", 20))
def _(r: Roles):
    q = MediaQuery(device_id=DEVICE, media_type="Photo", captured_after="2020-01-02", captured_before="2020-03-01", has_location=True, sort="CapturedAtAsc", limit=20)
    return media.timeline(catalog(r), q).select(*_COLUMNS)


@query("T1_keyset_timeline", _timeline_sql(
    f"lifecycle_state = 'Active' and ({_KEY} < timestamp '2020-01-08 08:35:49' or ({_KEY} = timestamp '2020-01-08 08:35:49' and asset_id < 187))", "sort_key desc, asset_id desc", 10))
def _(r: Roles):
    cursor = X.encode_cursor("media", ["2020-01-08T08:35:49", 187])
    return media.timeline(catalog(r), MediaQuery(device_id=DEVICE, cursor=cursor, limit=10)).select(*_COLUMNS)


@query("Q1_trash_page", _timeline_sql("lifecycle_state = 'Trashed'", "sort_key desc, asset_id desc", 30, key="updated_at", visible=VISIBLE_TRASH))
def _(r: Roles):
    return media.timeline(catalog(r), MediaQuery(device_id=DEVICE, trash="Trashed", sort="UpdatedAtDesc", limit=30)).select(*_COLUMNS)


query("Q3_summaries", f"with page as (select *, created_at as sort_key from asset), {_SUMMARY} select {', '.join(_COLUMNS)} from summary")(
    lambda r: media.summaries(catalog(r), r.asset.withColumn("sort_key", F.col("created_at")), DEVICE, page=False).select(*_COLUMNS))


def _search_sql(text: str, limit: int) -> str:
    like = f"like '%{text.lower()}%'"
    place = ["street_address", "city", "state", "country"]
    date = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
    hit = lambda c: f"coalesce(contains(lower({c}), '{text.lower()}'), false)"
    where = f"""(exists (select 1 from occurrence o where o.user_id = a.user_id and o.asset_id = a.asset_id and lower(o.file_name) {like})
      or exists (select 1 from description d where d.user_id = a.user_id and d.asset_id = a.asset_id and d.is_current and lower(d.description_text) {like})
      or exists (select 1 from transcript t where t.user_id = a.user_id and t.asset_id = a.asset_id and t.is_current and lower(t.transcript_text) {like})
      or exists (select 1 from location l where l.user_id = a.user_id and l.asset_id = a.asset_id and ({' or '.join(f'lower(l.{f}) {like}' for f in place)}))
      or lower(category) {like} or lower(media_type) {like} or {date('captured_local')} {like} or {date('captured_utc')} {like})"""
    cases = [
        ("FileName", hit("display_file_name"), "display_file_name"), ("Description", hit("d_text"), "left(d_text, 1000)"),
        ("Transcript", hit("transcript_text"), "left(coalesce(segment_text, transcript_text), 1000)"), ("Category", hit("category"), "category"), ("MediaType", hit("media_type"), "media_type"),
        ("Location", " or ".join(hit(f) for f in place), "coalesce(" + ", ".join(f"case when {hit(f)} then {f} end" for f in place) + ", street_address)"),
    ]
    field = "case " + " ".join(f"when {c} then '{n}'" for n, c, _ in cases) + " else 'Date' end"
    shown = "case " + " ".join(f"when {c} then {v}" for _, c, v in cases) + f" else {date('coalesce(captured_local, captured_utc, created_at)')} end"
    return f"""with page as (select a.*, updated_at as sort_key from asset a where {VISIBLE.format(d=DEVICE)} and lifecycle_state = 'Active' and {where} order by sort_key desc, asset_id desc limit {limit + 1}), {_SUMMARY},
      shown as (select s.*, d.d_text, t.transcript_text, g.sequence_number, g.start_ms, g.segment_text, l.street_address, l.city, l.state as place_state, l.country
        from (select * exclude (state) from summary) s
        left join (select user_id, asset_id, max_by(description_text, description_id) as d_text from description where is_current group by 1, 2) d using (user_id, asset_id)
        left join (select user_id, asset_id, max(transcript_id) as transcript_id, max_by(transcript_text, transcript_id) as transcript_text from transcript where is_current group by 1, 2) t using (user_id, asset_id)
        left join (select transcript_id, min(sequence_number) as sequence_number, min_by(start_ms, sequence_number) as start_ms, min_by(segment_text, sequence_number) as segment_text from segment where lower(segment_text) {like} group by 1) g using (transcript_id)
        left join location l using (user_id, asset_id)),
      fielded as (select *, {field.replace("lower(state)", "lower(place_state)")} as matched_field, {shown.replace("lower(state)", "lower(place_state)").replace("then state ", "then place_state ")} as highlight from shown)
      select asset_id, matched_field, highlight, case when matched_field = 'Transcript' then sequence_number end as segment_number, case when matched_field = 'Transcript' then start_ms end as seek_to_ms from fielded"""


def _hits(r: Roles, text: str, limit: int):
    return media.hits(catalog(r), MediaQuery(device_id=DEVICE, text=text, limit=limit)).select("asset_id", "matched_field", "highlight", "segment_number", "seek_to_ms")


for _name, _text, _limit in (("Q2_search", "town3", 40), ("Q2_search_wildcard", "g_1", 40), ("Q4_attribution_date", "2020-01", 60), ("Q4_attribution_spoken", "thing", 60)):
    query(_name, _search_sql(_text, _limit))(lambda r, t=_text, n=_limit: _hits(r, t, n))


@query("Q5_detail", f"""select a.asset_id, o.n as occurrences, o.own as own_locators, l.city, d.description_text, t.transcript_id, g.n as segments from asset a
  left join (select user_id, asset_id, count(*) as n, count(*) filter (where device_id = {DEVICE}) as own from occurrence o join source s on s.source_id = o.source_id group by 1, 2) o using (user_id, asset_id)
  left join location l using (user_id, asset_id) left join (select user_id, asset_id, max_by(description_text, description_id) as description_text from description where is_current group by 1, 2) d using (user_id, asset_id)
  left join (select user_id, asset_id, max(transcript_id) as transcript_id from transcript where is_current group by 1, 2) t using (user_id, asset_id)
  left join (select transcript_id, count(*) as n from segment group by 1) g using (transcript_id) where {VISIBLE_TRASH.format(d=DEVICE)}""")
def _(r: Roles):
    rows = media.detail(catalog(r), r.asset.select("asset_id"), DEVICE)
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    own = F.when(F.col("occurrences").isNotNull(), F.size(F.filter("occurrences", lambda o: o["locator"].isNotNull()))).cast("long")
    return rows.select("asset_id", size("occurrences").alias("n"), own.alias("own_locators"), "city", "description_text", "transcript_id", size("segments").alias("segments")).withColumnRenamed("n", "occurrences")


@query("Q6_change_feed", f"select change_id, entity_public_id, change_type from change c where change_id > 50 and (c.asset_id is null or c.device_id = {DEVICE} or c.asset_id in (select a.asset_id from asset a where {VISIBLE.format(d=DEVICE)})) order by change_id limit 101")
def _(r: Roles):
    seen = feeds.changes_for(r.change.filter("change_id > 50"), visible_assets(r.asset, r.occurrence, r.source, DEVICE), DEVICE)
    return feeds.keyset(seen, "change_id", 50, 100).select("change_id", "entity_public_id", "change_type")


query("Q7_job_page", """select job_id, status, case status when 'DeferredQuota' then 'WaitingForMonthlyQuota' when 'Failed' then 'NeedsAttention' when 'Queued' then 'Processing' when 'Running' then 'Processing' when 'Succeeded' then 'Ready' else status end as state,
  status = 'DeferredQuota' or (status = 'Failed' and attempt_count < max_attempts) as can_retry from job where job_type = 'Geocode' and job_id < 900 order by job_id desc limit 51""")(
    lambda r: feeds.keyset(r.job.filter("job_type = 'Geocode'"), "job_id", 900, 50, descending=True).select("job_id", "status", feeds.job_state().alias("state"), feeds.can_retry().alias("can_retry")))
query("Q8_devices", "select device_id, count(*) as sources from source where device_id < 20 group by 1 order by 1 desc limit 21")(
    lambda r: feeds.keyset(r.source.groupBy("device_id").agg(F.count(F.lit(1)).alias("sources")), "device_id", 20, 20, descending=True))
query("Q8_sources", f"select source_id, source_key, storage_mode, source_status from source where device_id = {DEVICE} or storage_mode = 'Remote' order by source_id desc limit 51")(
    lambda r: feeds.keyset(r.source.filter(f"device_id = {DEVICE} or storage_mode = 'Remote'"), "source_id", None, 50, descending=True).select("source_id", "source_key", "storage_mode", "source_status"))
query("Q9_import_status", "select o_orderkey as import_id, o_orderstatus as status, s.n as processed, s.rejected, case when s.rejected > 0 then 'CompletedWithErrors' else 'Completed' end as result from orders join (select import_id, count(*) as n, count(*) filter (where file_name is null) as rejected from stage group by 1) s on s.import_id = o_orderkey")(
    lambda r: r.orders.join(r.stage.groupBy("import_id").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("file_name").isNull()).alias("rejected")), F.col("import_id") == F.col("o_orderkey")).select(
        "import_id", F.col("o_orderstatus").alias("status"), "processed", "rejected", F.when(F.col("rejected") > 0, "CompletedWithErrors").otherwise("Completed").alias("result")))
query("Q11_legacy_audit", "select 'status:' || status as item, count(*) as n from job group by 1 union all select 'rows:asset', count(*) from asset union all select 'inconsistent', count(*) from asset where abs(date_sub('second', captured_local - to_minutes(cast(-240 + asset_id % 2 as bigint)), captured_utc)) > 1")(
    lambda r: r.job.groupBy(F.concat(F.lit("status:"), "status").alias("item")).agg(F.count(F.lit(1)).alias("n")).union(r.asset.agg(F.lit("rows:asset").alias("item"), F.count(F.lit(1)).alias("n"))).union(
        QUERIES["F16_temporal_audit"](r.spark, r.sf_dir).agg(F.lit("inconsistent").alias("item"), F.count(F.lit(1)).alias("n"))))
for _new, _old in (("Q12_migration_preview", "J19_page_then_aggregate"), ("Q16_local_day", "F15_local_day"), ("Q17_missing_gps", "F14_missing_gps"), ("Q13_status_dashboard", "A12_count_by_state")):
    QUERIES[_new], ORACLE_SQL[_new] = QUERIES[_old], ORACLE_SQL[_old]
query("Q20_description_backfill", "select asset_id, file_name from (select a.asset_id, min_by(o.file_name, o.occurrence_id) as file_name from asset a join occurrence o using (user_id, asset_id) where a.media_type = 'Photo' and a.asset_id not in (select asset_id from description where is_current) group by 1) x order by asset_id limit 50")(
    lambda r: r.asset.filter("media_type = 'Photo'").join(r.description.filter("is_current").select("asset_id"), "asset_id", "left_anti").join(r.occurrence.groupBy("user_id", "asset_id").agg(F.min_by("file_name", "occurrence_id").alias("file_name")), ["user_id", "asset_id"])
    .orderBy("asset_id").limit(50).select("asset_id", "file_name"))


@query("Q21_manual_tagging", f"select location_id from location where coalesce(trim(category), '') = '' and ((lower(street_address) like '%7%' and lower(street_address) like '%quay%' and (lower(street_address) like '%st%' or lower(street_address) like '%street%')) or {_dist('-60e0', '-140e0', 'latitude', 'longitude', '6371000.0')} <= 4000000)")
def _(r: Roles):
    from ..functions import geo

    d = geo.haversine(F.lit(-60.0), F.lit(-140.0), F.col("latitude"), F.col("longitude"), geo.LEGACY_EARTH_M)
    chosen = address_matches(F.col("street_address"), "7 Quay Street") | (d <= 4_000_000)
    return r.location.filter(X.blank(F.col("category")) & F.coalesce(chosen, F.lit(False))).select("location_id")


query("Q22_import_verification", "select (select count(*) from stage where import_id = 7) as staged, (select count(distinct content_key) from stage where import_id = 7) as assets, (select count(*) from stage where import_id = 7 and file_name is null) as failures, (select count(*) from occurrence where import_id = 7) as occurrences")(
    lambda r: r.stage.filter("import_id = 7").agg(F.count(F.lit(1)).alias("staged"), F.count_distinct("content_key").alias("assets"), F.count_if(F.col("file_name").isNull()).alias("failures")).crossJoin(r.occurrence.filter("import_id = 7").agg(F.count(F.lit(1)).alias("occurrences"))))
query("Q23_acceptance_state", "select count(distinct asset_id) as assets, count(*) as occurrences, count(distinct file_name) as paths from occurrence where asset_id = 7")(
    lambda r: r.occurrence.filter("asset_id = 7").agg(F.count_distinct("asset_id").alias("assets"), F.count(F.lit(1)).alias("occurrences"), F.count_distinct("file_name").alias("paths")))
query("Q24_recent_scans", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 10")(lambda r: r.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey", "o_orderdate"))

# ---- spatial and propagation

RADIUS = 400_000.0


def _points(r: Roles):
    p = r.location.select("user_id", F.col("location_id").alias("p_id"), F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    t = r.location.filter("provider is not null").select("user_id", F.col("location_id").alias("t_id"), F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lon"), F.col("provider_updated").alias("t_updated"))
    return p, t


_D = _dist("p.latitude", "p.longitude", "t.latitude", "t.longitude")
_NEAR = f"select p.location_id as p_id, t.location_id as t_id, t.provider_updated, {_D} as d from location p join location t on t.user_id = p.user_id and t.provider is not null and {_D} <= {RADIUS}"
query("J23_within_radius", f"select p_id, t_id, round(d, 1) as distance_m from ({_NEAR}) x")(lambda r: spatial.within_radius(*_points(r), RADIUS, on=["user_id"]).select("p_id", "t_id", F.round("distance_m", 1).alias("distance_m")))
_NEAREST = f"select p_id, t_id, round(d, 1) as distance_m from (select *, row_number() over (partition by p_id order by d, provider_updated desc, t_id desc) as n from ({_NEAR}) y) x where n = 1"
query("J23_nearest_resolved", _NEAREST)(lambda r: spatial.nearest_resolved(*_points(r), RADIUS, key="p_id").select("p_id", "t_id", F.round("distance_m", 1).alias("distance_m")))
_BOX = f"abs(p.latitude - t.latitude) <= {RADIUS} / 111320e0 and (abs(cos(radians(p.latitude))) < 1e-8 or {RADIUS} / (111320e0 * abs(cos(radians(p.latitude)))) >= 180 or least(abs(p.longitude - t.longitude), 360 - abs(p.longitude - t.longitude)) <= {RADIUS} / (111320e0 * abs(cos(radians(p.latitude)))))"
query("T6_nearest_of_latest", f"""select p_id, t_id, round(d, 1) as distance_m from (select *, row_number() over (partition by p_id order by d, n) as m from (select *, row_number() over (partition by p_id order by provider_updated desc, t_id desc) as n from (
  select p.location_id as p_id, t.location_id as t_id, t.provider_updated, {_D} as d from location p join location t on t.user_id = p.user_id and t.provider is not null and {_BOX}) b) c where n <= 3 and d <= {RADIUS}) x where m = 1""")(
    lambda r: spatial.nearest_resolved(*_points(r), RADIUS, key="p_id", candidate_cap=3).select("p_id", "t_id", F.round("distance_m", 1).alias("distance_m")))


def _rows(r: Roles):
    return r.location.withColumn("category_source", F.when(F.coalesce(F.trim("category"), F.lit("")) != "", F.col("category_source")))


def _propagated(r: Roles):
    return spatial.propagated_category(_rows(r), radius_m=RADIUS)


_LD = _dist("p.latitude", "p.longitude", "t.latitude", "t.longitude", "6371000.0")
_PROP = f"""with base as (select * replace (case when coalesce(trim(category), '') <> '' then category_source end as category_source) from location), todo as (select * from base where coalesce(trim(category), '') = ''), seed as (select * from base where coalesce(trim(category), '') <> ''),
  addr as (select location_id, category from (select p.location_id, t.category, row_number() over (partition by p.location_id order by case when t.category_source = 'Manual' then 0 else 1 end, t.modified_at desc, t.location_id desc) as n from todo p join seed t on t.street_address = p.street_address and t.location_id <> p.location_id) x where n = 1),
  near as (select location_id, category from (select p.location_id, t.category, row_number() over (partition by p.location_id order by {_LD}, case when t.category_source = 'Manual' then 0 else 1 end, t.location_id desc) as n from todo p join seed t on t.location_id <> p.location_id and {_LD} <= {RADIUS}) x where n = 1)
  select p.location_id, coalesce(a.category, n.category) as new_category, case when a.category is not null then 'AddressPropagation' else 'RadiusPropagation10m' end as new_source from todo p left join addr a using (location_id) left join near n using (location_id) where coalesce(a.category, n.category) is not null"""
query("L4_category_propagation", _PROP)(_propagated)
_WITH = _PROP.rsplit("select p.location_id, coalesce(a.category", 1)[0]
query("J24_category_by_radius", _WITH + "select location_id, category as radius_category from near")(lambda r: spatial.category_by_radius(*spatial.todo_and_seeds(_rows(r)), RADIUS))
query("J25_category_by_address", _WITH + "select location_id, category as address_category from addr")(lambda r: spatial.category_by_address(*spatial.todo_and_seeds(_rows(r))))

RULES = [
    Rule("harbour", "Harbour Quarter", city="Town3", street_contains=["quay"]),
    Rule("west", "West Bank", states=["S1", "S2"], countries=["C1", "C2"]),
    Rule("low-numbers", "Old Row", street_numbers=["1", "2", "3"]),
]
query("J26_first_rule", """select location_id, case when lower(trim(city)) = 'town3' and contains(lower(street_address), 'quay') then 'harbour' when lower(trim(state)) in ('s1', 's2') and lower(trim(country)) in ('c1', 'c2') then 'west'
  when street_number in ('1', '2', '3') then 'low-numbers' end as rule from location""")(
    lambda r: r.location.select("location_id", first_rule(RULES, "v1", city=F.col("city"), state=F.col("state"), country=F.col("country"), street=F.col("street_address"), number=F.col("street_number"))["name"].alias("rule")))

query("F10_sweep_outcome", None)(lambda r: feeds.sweep(r.job, as_of()).select("job_id", "new_status"))
ORACLE_SQL["F10_sweep_outcome"] = ORACLE_SQL["F10_due_work"].replace("select job_id, status from job", "select job_id, case when attempt_count >= max_attempts then 'Failed' when status = 'DeferredQuota' and job_type = 'Description' then 'Preparing' else 'Queued' end as new_status from job")

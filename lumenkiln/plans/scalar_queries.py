"""The scalar library on the role views."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import geo, usage
from ..functions import text as X
from ..functions import times as T
from .catalog_queries import _dist
from .registry import Roles, query

query("X1_haversine", f"select location_id, round({_dist('latitude', 'longitude', '51.5e0', '-0.12e0')}, 2) as meters from location")(
    lambda r: r.location.select("location_id", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(51.5), F.lit(-0.12)), 2).alias("meters")))
query("X2_haversine_legacy", f"select location_id, round({_dist('latitude', 'longitude', '51.5e0', '-0.12e0', '6371000.0')}, 2) as meters from location")(
    lambda r: r.location.select("location_id", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(51.5), F.lit(-0.12), geo.LEGACY_EARTH_M), 2).alias("meters")))
query("X3_box_deltas", "select location_id, 5e0 / 111320e0 as d_lat, case when abs(cos(radians(latitude))) < 1e-8 then 180 else least(180, 5e0 / (111320e0 * abs(cos(radians(latitude))))) end as d_lon from location where latitude is not null")(
    lambda r: r.location.filter("latitude is not null").select("location_id", F.lit(geo.lat_delta(5.0)).alias("d_lat"), geo.lon_delta(F.col("latitude"), 5.0).alias("d_lon")))
query("X4_dms", "select location_id, round(case when location_id % 2 = 0 then -1 else 1 end * (location_id % 89 + 1 + (location_id % 60) / 60e0 + (location_id % 7) / 3600e0), 9) as decimal_degrees from location")(
    lambda r: r.location.select("location_id", F.round(geo.dms_to_decimal(F.col("location_id") % 89 + 1, F.col("location_id") % 60, F.col("location_id") % 7, F.when(F.col("location_id") % 2 == 0, "S").otherwise("N")), 9).alias("decimal_degrees")))
query("X5_exif_datetime", "select asset_id, date_trunc('second', captured_local) as t from asset")(lambda r: r.asset.select("asset_id", T.exif_datetime(F.date_format("captured_local", "yyyy:MM:dd HH:mm:ss")).alias("t")))


@query("X6_offset_parse", "select location_id, case when h <= 14 and not (h = 14 and m > 0) then case when location_id % 2 = 0 then -1 else 1 end * (h * 60 + m) end as minutes from (select location_id, location_id % 16 as h, location_id % 60 as m from location) x")
def _(r: Roles):
    text = F.format_string("%s%02d:%02d", F.when(F.col("location_id") % 2 == 0, "-").otherwise("+"), F.col("location_id") % 16, F.col("location_id") % 60)
    return r.location.select("location_id", T.parse_offset(text).alias("minutes"))


query("X7_offset_label", "select location_id, 'UTC' || case when m >= 0 then '+' else '-' end || lpad(cast(abs(m) // 60 as string), 2, '0') || ':' || lpad(cast(abs(m) % 60 as string), 2, '0') as label from (select location_id, location_id % 1600 - 800 as m from location) x")(
    lambda r: r.location.select("location_id", T.offset_label(F.col("location_id") % 1600 - 800).alias("label")))
query("X8_local_from_utc", "select asset_id, captured_utc + to_hours(1) as local_time from asset where captured_utc is not null and captured_utc < timestamp '2020-03-01'")(
    lambda r: r.asset.filter("captured_utc is not null and captured_utc < timestamp_ntz '2020-03-01'").select("asset_id", T.local_from_utc("Europe/Paris", F.col("captured_utc")).alias("local_time")))
query("X9_capture_time", "select asset_id, coalesce(captured_local, captured_utc, created_at) as t, case when captured_local is not null then 'Exif' when captured_utc is not null then 'Existing' else 'FileMtime' end as origin from asset")(
    lambda r: r.asset.select("asset_id", T.capture_time(F.col("captured_local"), F.col("captured_utc"), F.col("created_at")).alias("t"), T.capture_source(F.col("captured_local"), F.col("captured_utc"), F.col("created_at")).alias("origin")))
query("X10_tag_priority", "select asset_id, coalesce(captured_utc, captured_local, created_at) as t from asset")(lambda r: r.asset.select("asset_id", F.coalesce("captured_utc", "captured_local", "created_at").alias("t")))


@query("X11_iso6709", "select location_id, round(latitude, 2) as lat, round(longitude, 2) as lon from location where latitude is not null")
def _(r: Roles):
    rows = r.location.filter("latitude is not null")
    lat, lon = geo.iso6709(F.concat(F.format_string("%+.2f", "latitude"), F.format_string("%+.2f", "longitude"), F.lit("/")))
    return rows.select("location_id", lat.alias("lat"), lon.alias("lon"))


query("X12_zone_fill", "select asset_id, captured_local - to_hours(1) as utc, 60 as offset_minutes from asset where captured_local is not null and captured_local < timestamp '2020-03-01'")(
    lambda r: r.asset.filter("captured_local is not null and captured_local < timestamp_ntz '2020-03-01'").withColumn("utc", T.utc_from_local("Europe/Paris", F.col("captured_local"))).select("asset_id", "utc", T.offset_minutes(F.col("captured_local"), F.col("utc")).alias("offset_minutes")))
query("X13_consistency", "select asset_id, coalesce(abs(epoch_us(captured_local + to_minutes(240)) - epoch_us(captured_utc + to_seconds(asset_id % 3))) <= 1000000, true) as consistent from asset")(
    lambda r: r.asset.select("asset_id", T.consistent(F.col("captured_local"), F.lit(-240), T.plus(F.col("captured_utc"), secs=F.col("asset_id") % 3)).alias("consistent")))
query("X14_street_number", r"select location_id, nullif(regexp_extract(street_address, '^\s*(\d+[A-Za-z\-]?)\b', 1), '') as number from location")(lambda r: r.location.select("location_id", A.street_number(F.col("street_address")).alias("number")))
query("X15_rule_predicate", "select location_id from location where lower(city) = 'town3' and lower(state) in ('s1', 's2', 's3')")(
    lambda r: r.location.filter(A.Rule("a", "b", city="TOWN3", states=["s1", "S2", "S3"]).fits(city=F.col("city"), state=F.col("state"), country=F.col("country"), street=F.col("street_address"), number=F.col("street_number"))).select("location_id"))
query("X16_rule_version", "select location_id, left(city || '@sha256:' || left(sha256(country), 16), 64) as version from location")(
    lambda r: r.location.select("location_id", F.left(F.concat("city", F.lit("@sha256:"), F.left(F.sha2("country", 256), F.lit(16))), F.lit(64)).alias("version")))
query("X17_display_name", "select location_id, concat_ws(', ', nullif(trim(street_address), ''), city, nullif(concat_ws(' ', state, street_number), ''), country) as name from location")(
    lambda r: r.location.select("location_id", A.display_name(F.col("street_address"), F.col("city"), F.col("state"), F.col("street_number"), F.col("country")).alias("name")))
query("X18_reuse_guard", "select location_id, street_address is not null or category is null or coalesce(category = 'BUILDING', false) as allowed from location")(
    lambda r: r.location.select("location_id", A.reuse_allowed(F.col("street_address"), F.col("category"), F.lit("BUILDING")).alias("allowed")))
query("X19_address_tokens", "select location_id, regexp_extract_all(lower(street_address), '[a-z0-9]+') as tokens from location where street_address is not null")(
    lambda r: r.location.filter("street_address is not null").select("location_id", A.address_tokens(F.col("street_address")).alias("tokens")))
query("X20_gps_range", "select location_id, latitude between -90 and 90 and longitude between -180 and 180 as valid from location")(lambda r: r.location.select("location_id", geo.in_range(F.col("latitude"), F.col("longitude")).alias("valid")))
_CLEAN = r"trim(regexp_replace(description_text, '\s+', ' ', 'g'))"
_FIRST = rf"case when regexp_matches(c, '^.*?[.!?] ') then regexp_extract(c, '^(.*?[.!?]) ', 1) else c end"
query("X21_caption", rf"select description_id, case when cut = '' then '' when regexp_matches(cut, '[.!?]$') then cut else cut || '.' end as caption from (select description_id, array_to_string(list_slice(string_split({_FIRST}, ' '), 1, 12), ' ') as cut from (select description_id, {_CLEAN} as c from description) a) b")(
    lambda r: r.description.select("description_id", X.clip_caption(F.col("description_text"), 12).alias("caption")))
query("X22_description", rf"""select segment, case when c <> '' and not regexp_matches(c, '[.!?]["'')\]]*\s+\S') then case when regexp_matches(cut, '[.!?]$') then cut else cut || '.' end end as normal from (select segment, c, case when len(string_split(c, ' ')) > 8 then regexp_replace(array_to_string(list_slice(string_split(c, ' '), 1, 8), ' '), '[.!?]+$', '') else c end as cut from (select transcript_id * 100 + sequence_number as segment, trim(regexp_replace(segment_text, '\s+', ' ', 'g')) as c from segment) a) b""")(
    lambda r: r.segment.select((F.col("transcript_id") * 100 + F.col("sequence_number")).alias("segment"), X.normal_description(F.col("segment_text"), 8).alias("normal")))
query("X23_response_text", "select transcript_id, sequence_number, case when sequence_number % 2 = 0 then trim(segment_text) else 'from ' || speaker end as said from segment")(
    lambda r: r.segment.withColumn("body", F.when(F.col("sequence_number") % 2 == 0, F.to_json(F.struct(F.col("segment_text").alias("output_text")))).otherwise(
        F.to_json(F.struct(F.lit(" ").alias("output_text"), F.array(F.struct(F.array(F.struct(F.lit(" ").alias("text")), F.struct(F.concat(F.lit("from "), "speaker").alias("text"))).alias("content"))).alias("output"))))).select("transcript_id", "sequence_number", usage.response_text(F.col("body")).alias("said")))
query("X24_usage_counts", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as tokens from events")(lambda r: r.events.select("event_id", usage.usage_count(F.col("props"), "$.usage.input_tokens", "$.k").alias("tokens")))
_COST = "cast(ceil(((i - c) * 2000000 + c * 200000 + o * 12000000) / 1000000) as bigint)"
query("X25_cost_usd", f"select o_orderkey, case when c <= i and i <= 2560 and o <= 100 then cast({_COST.replace('/ 1000000', '// 1000000 + case when ((i - c) * 2000000 + c * 200000 + o * 12000000) % 1000000 > 0 then 1 else 0 end')} as decimal(20,6)) / 1000000 end as usd from (select o_orderkey, o_orderkey % 2561 as i, o_orderkey % 2561 // 3 as c, o_custkey % 120 as o from orders) t")(
    lambda r: r.orders.select("o_orderkey", usage.cost_usd(F.col("o_orderkey") % 2561, F.floor(F.col("o_orderkey") % 2561 / 3), F.col("o_custkey") % 120).cast("double").alias("usd")))
query("X26_max_request_cost", "select cast(0.006320 as decimal(20,6)) as usd")(lambda r: r.spark.range(1).select(F.lit(usage.max_request_cost()).cast("decimal(20,6)").alias("usd")))
query("X27_legacy_id", "select occurrence_id, sha1(lower(file_name)) as id from occurrence")(lambda r: r.occurrence.select("occurrence_id", X.legacy_id(F.col("file_name")).alias("id")))
query("X28_request_hash", """select asset_id, sha256('{"a":' || asset_id || ',"b":"' || media_type || '"}') as h from asset""")(lambda r: r.asset.select("asset_id", F.sha2(F.to_json(F.struct(F.col("asset_id").alias("a"), F.col("media_type").alias("b"))), 256).alias("h")))
query("X29_next_month", "select event_id, cast(date_trunc('month', ts) + interval 1 month as date) as next_month from events")(lambda r: r.events.select("event_id", T.first_of_next_month(F.col("ts")).alias("next_month")))
query("X30_backoff_and_purge", "select job_id, least(3600, 300 * power(2, attempt_count - 1))::bigint as delay, updated_at + interval 30 day as purge_after from job where attempt_count > 0")(
    lambda r: r.job.filter("attempt_count > 0").select("job_id", T.retry_delay_seconds(F.col("attempt_count")).alias("delay"), T.plus(F.col("updated_at"), days=30).alias("purge_after")))
query("X31_normal_mime", "select asset_id, lower(trim(string_split(' Image/JPEG ; q=' || asset_id, ';')[1])) as mime from asset")(lambda r: r.asset.select("asset_id", X.normal_mime(F.concat(F.lit(" Image/JPEG ; q="), "asset_id")).alias("mime")))
query("X32_safe_text", rf"select description_id, nullif(left({_CLEAN}, 40), '') as safe from description")(lambda r: r.description.select("description_id", X.safe_text(F.col("description_text"), 40).alias("safe")))


@query("X33_provider_address", "select location_id, nullif(trim(concat_ws(' ', street_number, street_address)), '') as street, city, coalesce(state, country) as state, 'T' || location_id as shown from location")
def _(r: Roles):
    payload = F.to_json(F.struct(F.concat(F.lit("T"), "location_id").alias("Title"), F.struct(F.col("street_number").alias("AddressNumber"), F.col("street_address").alias("Street"), F.col("city").alias("Locality"), F.struct(F.col("state").alias("Name")).alias("Region")).alias("Address")))
    a = A.provider_address(payload)
    return r.location.select("location_id", a.alias("a")).select("location_id", F.col("a.street_address").alias("street"), "a.city", "a.state", F.col("a.display_name").alias("shown"))


_PROVENANCE = '[{"field":"gps","source":"Exif"},{"other":"x"},{"field":null,"source":"AI"}]'
query("X34_provenance_parse", "select asset_id, case when asset_id % 2 = 0 then 1 end as items from asset")(
    lambda r: r.asset.select("asset_id", F.size(F.filter(F.from_json(F.when(F.col("asset_id") % 2 == 0, _PROVENANCE).otherwise("{not json"), "array<struct<field:string,source:string>>"), lambda p: p["field"].isNotNull() & p["source"].isNotNull())).alias("items")))
query("X35_json_path", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing') as missing from events")(lambda r: r.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing")))
query("X36_json_build", """select asset_id, '{"assetId":' || asset_id || ',"type":"' || media_type || '"}' as request from asset""")(lambda r: r.asset.select("asset_id", F.to_json(F.struct(F.col("asset_id").alias("assetId"), F.col("media_type").alias("type"))).alias("request")))
query("X37_preferred_original", "select location_id, coalesce(street_address, city) as shown from location")(
    lambda r: r.location.select("location_id", F.coalesce(F.get_json_object(F.to_json(F.struct(F.col("street_address").alias("OriginalAddress"))), "$.OriginalAddress"), "city").alias("shown")))
query("X38_string_set", "select location_id, lower(city) as a, trim('  ' || city || ' ') as b, length(city) as c, strlen(city) as d, lpad(street_number, 5, '0') as e, left(city, 3) as f, replace(city, 'Town', 'T') as g, nullif(city, 'Town1') as h from location")(
    lambda r: r.location.select("location_id", F.lower("city").alias("a"), F.trim(F.concat(F.lit("  "), "city", F.lit(" "))).alias("b"), F.length("city").alias("c"), F.octet_length("city").alias("d"), F.lpad("street_number", 5, "0").alias("e"),
        F.left("city", F.lit(3)).alias("f"), F.replace("city", F.lit("Town"), F.lit("T")).alias("g"), F.nullif("city", F.lit("Town1")).alias("h")))

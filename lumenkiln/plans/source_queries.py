"""Sources, sinks and validation: files written to the shared folder and read back, lines judged rule by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import enrich, storage
from ..functions.address import reuse_allowed
from ..functions.text import coordinate_revision
from ..ingest import client
from ..ingest.validate import validate
from ..operators import feeds, spatial
from ..schemas import ENTRY
from ..sources import files, manifest
from ..state import ledger
from ..streaming import feeds as streams
from .catalog_queries import _dist
from .ingest_queries import now
from .reader_queries import RADIUS, _points
from .registry import Roles, query


def scratch(r: Roles, name: str) -> str:
    """A new folder that all executors share."""
    return storage.scratch(r.spark, name)


# ---- entries made of parts, with errors in some fields

def k():
    return F.col("p_partkey")


def _text(condition, bad, good):
    return F.when(condition, F.lit(bad) if isinstance(bad, str) else bad).otherwise(good)


def lines(r: Roles):
    """One JSON line a part: (k, value)."""
    key = k().cast("string")
    place = F.struct(
        F.concat((k() % 200 - 100).cast("string"), F.lit(".1234565")).alias("latitude"), F.concat((k() % 90).cast("string"), F.lit(".5")).alias("longitude"),
        F.lit("12.3454").alias("altitudeMeters"), F.lit(None).cast("string").alias("horizontalAccuracyMeters"),
    )
    entry = F.struct(
        F.lit("Entry").alias("recordType"), (k() + 1).alias("rowNumber"), F.lit("Upsert").alias("operation"), F.concat(F.lit("item-"), key).alias("sourceItemId"), F.lit("r").alias("sourceRevision"),
        _text(k() % 31 == 0, "", F.concat(F.lit("f"), key, F.lit(".jpg"))).alias("fileName"), F.concat(F.lit("/p/"), key).alias("localLocator"), _text(k() % 37 == 0, "xyz", F.upper(F.sha2(key, 256))).alias("contentSha256"),
        _text(k() % 41 == 0, "Song", F.lit("Photo")).alias("mediaType"), F.lit("image/jpeg").alias("mimeType"), (k() % 29).alias("byteSize"), F.when(k() % 2 == 0, k()).alias("widthPixels"),
        (k() % 1000).cast("string").alias("utcOffsetMinutes"), F.when(k() % 3 == 0, place).alias("location"),
        F.when(k() % 3 == 0, F.array(F.struct(F.lit("GPS").alias("field"), F.when(k() % 43 == 0, "Nobody").otherwise("Exif").alias("source")))).alias("provenance"),
    )
    return r.part.select(k().alias("k"), F.to_json(entry).alias("value"))


def validated(r: Roles):
    return validate(lines(r).select(F.from_json("value", ENTRY).alias("e")).select("e.*"))


_ERROR = """case when p_partkey % 31 = 0 then 'fileName has to have 1 to 512 characters' when p_partkey % 37 = 0 then 'contentSha256 is no SHA-256' when p_partkey % 41 = 0 then 'mediaType is unknown'
  when p_partkey % 29 = 0 then 'byteSize is out of range' when p_partkey % 2 = 0 and p_partkey = 0 then 'widthPixels is out of range' when p_partkey % 1000 > 840 then 'utcOffsetMinutes is out of range'
  when p_partkey % 3 = 0 and abs(cast((p_partkey % 200 - 100) || '.1234565' as decimal(30,12))) > 90 then 'location is out of range' when p_partkey % 3 = 0 and p_partkey % 43 = 0 then 'provenance source is unknown' end"""
_LAT = "round_even(cast((p_partkey % 200 - 100) || '.1234565' as decimal(30,12)), 6)"
_BASE = f"(select p_partkey, {_ERROR} as error from part) v"
query("M3_validated_entries", f"select p_partkey + 1 as row_number, case when error is null then 'Valid' else 'Rejected' end as validation_state, error as error_message, case when error is null then p_partkey % 29 end as byte_size, case when error is null then 'f' || p_partkey || '.jpg' end as file_name from {_BASE}")(
    lambda r: validated(r).select("row_number", "validation_state", "error_message", "byte_size", "file_name"))
query("M4_field_rules", f"select error as error_message, count(*) as n, min(p_partkey) + 1 as first_row from {_BASE} where error is not null group by 1")(
    lambda r: validated(r).filter("validation_state = 'Rejected'").groupBy("error_message").agg(F.count(F.lit(1)).alias("n"), F.min("row_number").alias("first_row")))
query("M5_location_and_revision", f"select p_partkey + 1 as row_number, cast({_LAT} as decimal(9,6)) as latitude, sha256(cast(cast({_LAT} as decimal(9,6)) as string) || ',' || (p_partkey % 90) || '.500000') as coordinate_revision, 'Exif' as location_source, cast(12.345 as decimal(10,3)) as altitude_m from {_BASE} where error is null and p_partkey % 3 = 0")(
    lambda r: validated(r).filter("latitude is not null").select("row_number", "latitude", "coordinate_revision", "location_source", "altitude_m"))


@query("M1_ill_formed_lines", "select p_partkey as k, p_partkey % 3 > 0 as ill_formed from part")
def _(r: Roles):
    twice = F.regexp_replace("value", r"\}$", ',"operation":"Upsert"}')
    return lines(r).select("k", manifest.ill_formed(F.when(F.col("k") % 3 == 1, twice).when(F.col("k") % 3 == 2, F.lit("[1")).otherwise(F.col("value"))).alias("ill_formed"))


query("M2_other_operations", "select count(*) filter (where l_linenumber = 3) as refused from lineitem")(
    lambda r: r.lineitem.select(F.to_json(F.struct(F.when(F.col("l_linenumber") == 3, "Deleted").otherwise("Upsert").alias("operation"))).alias("value")).agg(F.count_if(F.get_json_object("value", "$.operation") != "Upsert").alias("refused")))
query("M6_identity_checks", "select o_orderkey as import_id, coalesce(n, 0) as entries from orders left join (select import_id, count(*) as n from stage group by 1) s on s.import_id = o_orderkey where coalesce(n, 0) <> o_orderkey % 7")(
    lambda r: r.orders.join(r.stage.groupBy(F.col("import_id").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n")), "o_orderkey", "left").select(F.col("o_orderkey").alias("import_id"), F.coalesce("n", F.lit(0)).alias("entries"), (F.col("o_orderkey") % 7).alias("claimed")).filter("entries <> claimed").drop("claimed"))

# ---- round trips through files


@query("S8_manifest_source", "select cast(p_partkey + 1 as string) as row_number, p_name || '.jpg' as file_name from part")
def _(r: Roles):
    entries = r.part.select((k() + 1).cast("string").alias("rowNumber"), F.lit("Upsert").alias("operation"), F.concat(F.lit("item-"), k()).alias("sourceItemId"), F.concat("p_name", F.lit(".jpg")).alias("fileName"))
    read = []
    for n, part in manifest.parted(entries):
        at = scratch(r, "manifest")
        manifest.write_manifest({"schemaVersion": manifest.MANIFEST_VERSION, "storageMode": "Local", "kind": "Full", "deletionDetectionReliable": "false", "sourceId": "s", "snapshotId": "n", "entryCount": str(n)}, part, at)
        read.append(manifest.read_manifest(r.spark, at)[1].select(F.col("rowNumber").alias("row_number"), F.col("fileName").alias("file_name")))
    return reduce(DataFrame.unionByName, read)


def _results(r: Roles):
    """A result row a part, numbered from 1 on."""
    least = r.part.agg(F.min("p_partkey").alias("least"))
    return r.part.crossJoin(least).select((k() - F.col("least") + 1).alias("rowNumber"), F.col("p_name").alias("sourceItemId"), F.col("p_brand").alias("outcome"), *[F.lit(None).cast("string").alias(c) for c in ("occurrenceId", "mediaAssetId", "errorCode", "errorMessage")])


_NUMBERED = "select p_partkey - (select min(p_partkey) from part) + 1 as row_number, p_name as source_item_id, p_brand as outcome from part"


@query("S13_result_sink", _NUMBERED)
def _(r: Roles):
    at = scratch(r, "result")
    rows = _results(r)
    manifest.write_result(rows, {"created": rows.count()}, "import-7", at)
    return manifest.read_result(r.spark, at)[1].select(F.col("rowNumber").alias("row_number"), F.col("sourceItemId").alias("source_item_id"), "outcome")


@query("S14_result_resume", f"select * from ({_NUMBERED}) x where row_number > (select count(*) // 3 from part)")
def _(r: Roles):
    """Resumed behind a third of the rows."""
    at = scratch(r, "result")
    rows = _results(r)
    manifest.write_result(rows, {"created": rows.count()}, "import-7", at)
    return manifest.read_result(r.spark, at, after=r.part.count() // 3)[1].select(F.col("rowNumber").alias("row_number"), F.col("sourceItemId").alias("source_item_id"), "outcome")


_FAULTS = ["schemaVersion", "storageMode", "sourceId", "entryCount", "kind", "permissionState", "deletionDetectionReliable", "clientCursor", "none"]


@query("S9_header_checks", """select p_partkey as k, case p_partkey % 9 when 0 then 'ManifestHeaderInvalid' when 1 then 'BulkRemoteUnsupported' when 2 then 'ManifestHeaderInvalid' when 3 then 'ManifestHeaderInvalid'
  when 4 then 'BulkManifestKindUnsupported' when 5 then 'ManifestHeaderInvalid' when 6 then 'BulkDeletionDetectionUnsupported' when 7 then 'ManifestHeaderInvalid' end as code from part""")
def _(r: Roles):
    """A header a part, each with one fault or none."""
    uuid = F.lit("12345678-1234-4234-8234-123456789abc")
    good = {
        "recordType": F.lit("Manifest"), "schemaVersion": F.lit(manifest.MANIFEST_VERSION), "storageMode": F.lit("Local"), "sourceId": uuid, "snapshotId": uuid, "entryCount": (k() % manifest.MAX_ENTRIES + 1).cast("string"),
        "kind": F.lit("Full"), "permissionState": F.lit("Full"), "deletionDetectionReliable": F.lit("false"), "clientCursor": F.lit(None).cast("string"),
    }
    bad = {"schemaVersion": "V0", "storageMode": "Remote", "sourceId": "not-a-uuid", "entryCount": "0", "kind": "Delta", "permissionState": "Perhaps", "deletionDetectionReliable": "true", "clientCursor": "x" * 1025}
    header = F.struct(*[F.when(k() % 9 == _FAULTS.index(c), bad[c]).otherwise(v).alias(c) if c in bad else v.alias(c) for c, v in good.items()])
    return r.part.select(k().alias("k"), header.alias("h")).select("k", manifest.header_code(F.col("h")).alias("code"))


@query("S15_manifest_bytes", "select count(*) + 1 as lines, true as same from part")
def _(r: Roles):
    """The manifest's bytes don't depend on how its entries are dealt out."""
    entries = r.part.select((k() + 1).cast("string").alias("rowNumber"), F.concat(F.lit("item-"), k()).alias("sourceItemId"))
    header = {"schemaVersion": manifest.MANIFEST_VERSION, "entryCount": str(entries.count())}
    ats = [scratch(r, "manifest") for _ in range(2)]
    for at, dealt in zip(ats, (entries, entries.repartition(5, "sourceItemId"))):
        manifest.write_manifest(header, dealt, at)
    sums = manifest.file_facts(r.spark, ats[0]).unionByName(manifest.file_facts(r.spark, ats[1])).agg((F.count_distinct("sha256") == 1).alias("same"))
    return r.spark.read.text(ats[0]).agg(F.count(F.lit(1)).alias("lines")).crossJoin(sums)


@query("S10_csv_round_trip", "select import_id, row_no, file_name || ', \"x\" \\y' as name from stage where file_name is not null")
def _(r: Roles):
    rows = r.stage.filter("file_name is not null").select("import_id", "row_no", F.concat("file_name", F.lit(', "x" \\y')).alias("name"))
    at = scratch(r, "csv")
    manifest.write_csv(rows, at)
    return manifest.read_csv_strict(r.spark, at, "import_id long, row_no int, name string")


query("S11_typed_load", "select import_id, row_no, nullif(file_name, '') as file_name, try_cast(case when row_no % 5 = 0 then 'x' else cast(byte_size as string) end as bigint) as byte_size from stage")(
    lambda r: r.stage.select("import_id", "row_no", F.nullif("file_name", F.lit("")).alias("file_name"), F.when(F.col("row_no") % 5 == 0, "x").otherwise(F.col("byte_size").cast("string")).try_cast("long").alias("byte_size")))
query("S12_one_file_load", "select count(*) as loaded, count(*) filter (where occurrence_id % 3 <> 0) as inserted, count(*) filter (where occurrence_id % 3 = 0) as already_present, count(*) filter (where occurrence_id % 3 <> 0) as change_rows from occurrence")(
    lambda r: manifest.load_one_file(
        r.occurrence.select("occurrence_id", F.col("occurrence_id").alias("change_id"), F.col("occurrence_id").alias("source_item_id"), "file_name"), r.occurrence.filter("occurrence_id % 3 = 0").select(F.col("occurrence_id").alias("source_item_id")), now())[2])

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _listed(r: Roles, pattern: str):
    """Tables whose entry in the folder, a file or a folder of files, fits the pattern."""
    found, _ = files.stat_pass(files.list_files(r.spark, f"{r.sf_dir}/{pattern}", pattern="*.parquet"))
    return found.select(F.regexp_extract("path", r"(\w+)\.parquet", 1).alias("table_name")).distinct()


query("S1_listing", f"select unnest({_TABLES}) as table_name")(lambda r: _listed(r, "*.parquet"))


@query("S3_stat_pass", "select o_orderkey as key, o_orderkey % 4 as byte_size, o_orderkey % 4 > 0 as kept, o_orderdate as modified_at from orders")
def _(r: Roles):
    """Sizes and times go through, and files without bytes are told apart."""
    listed = r.orders.select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 4).alias("byte_size"), F.col("o_orderdate").alias("modified_at"))
    full, skipped = files.stat_pass(listed)
    return full.withColumn("kept", F.lit(True)).unionByName(skipped.withColumn("kept", F.lit(False)))


query("S2_filtered_listing", "select unnest(['pages', 'part']) as table_name")(lambda r: _listed(r, "pa*.parquet"))
query("S4_content_hash", "select doc_id, sha256(text) as content_sha256 from documents")(lambda r: r.documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_sha256")))
query("S5_cache_hits", "select a.asset_id, l.location_id is not null as hit from asset a left join location l on l.asset_id = a.asset_id and l.location_id % 5 = a.byte_size % 5")(
    lambda r: (lambda f, c: files.cached(f, c)[0].select("asset_id", F.lit(True).alias("hit")).unionByName(files.cached(f, c)[1].select("asset_id", F.lit(False).alias("hit"))))(
        r.asset.select("asset_id", F.col("asset_id").alias("path"), (F.col("byte_size") % 5).alias("byte_size"), F.lit(0).alias("modified_at")), r.location.select(F.col("asset_id").alias("path"), (F.col("location_id") % 5).alias("byte_size"), F.lit(0).alias("modified_at"))))
def _hex(value, digits: int):
    return F.lpad(F.hex(value.cast("long") if not isinstance(value, int) else F.lit(value)), digits, "0")


def _photo(r: Roles):
    """A JPEG header a part: APP1 with capture time, offset, place and height, then the frame's size.

    Directories stand at 8, 38 and 68 of the TIFF structure, and what doesn't fit into their entries from 146 on.
    """
    text = lambda value, size: F.rpad(F.hex(F.encode(value, "US-ASCII")), 2 * size, "0")
    when = F.concat(F.lit("2020:01:"), F.lpad((k() % 28 + 1).cast("string"), 2, "0"), F.lit(" 10:"), F.lpad((k() % 60).cast("string"), 2, "0"), F.lit(":00"))
    entry = lambda tag, kind, count, value: F.concat(F.lit(tag + kind), _hex(count, 8), value if not isinstance(value, str) else F.lit(value))
    ref = lambda plus, minus, odd: F.when(odd, text(F.lit(minus), 4)).otherwise(text(F.lit(plus), 4))
    rational = lambda a, b: F.concat(_hex(a, 8), _hex(b, 8))
    tiff = F.concat(
        F.lit("4D4D002A000000080002"), entry("8769", "0004", 1, "00000026"), entry("8825", "0004", 1, "00000044"), F.lit("00000000"),
        F.lit("0002"), entry("9003", "0002", 20, "00000092"), entry("9011", "0002", 7, "000000A6"), F.lit("00000000"),
        F.lit("0006"), entry("0001", "0002", 2, ref("N", "S", k() % 2 == 0)), entry("0002", "0005", 3, "000000AE"), entry("0003", "0002", 2, ref("E", "W", k() % 3 == 0)), entry("0004", "0005", 3, "000000C6"),
        entry("0005", "0001", 1, F.when(k() % 5 == 0, "01000000").otherwise("00000000")), entry("0006", "0005", 1, "000000DE"), F.lit("00000000"),
        text(when, 20), text(F.lit("+04:00"), 8), rational(k() % 90, 1), rational(30, 1), rational(0, 1), rational(k() % 180, 1), rational(0, 1), rational(900, 100), rational(k() % 1000, 8),
    )
    frame = F.concat(F.lit("FFC0001108"), _hex(F.col("p_size"), 4), _hex(k() % 60000 + 1, 4), F.lit("03" + "00" * 9 + "FFD9"))
    return r.part.select(k().cast("string").alias("path"), F.unhex(F.concat(F.lit("FFD8FFE100EE457869660000"), tiff, frame)).alias("content"))


query("S6_photo_metadata", """select cast(p_partkey as string) as path, p_partkey % 60000 + 1 as width, p_size as height, printf('2020:01:%02d 10:%02d:00', p_partkey % 28 + 1, p_partkey % 60) as exif_time, '+04:00' as exif_offset,
  case when p_partkey % 2 = 0 then -1 else 1 end * (p_partkey % 90 + 0.5e0) as latitude, case when p_partkey % 3 = 0 then -1 else 1 end * (p_partkey % 180 + 0.0025e0) as longitude, case when p_partkey % 5 = 0 then -1 else 1 end * (p_partkey % 1000 / 8e0) as altitude from part""")(
    lambda r: files.photo_metadata(_photo(r)).select("path", "width", "height", "exif_time", "exif_offset", "latitude", "longitude", "altitude"))
query("S7_video_metadata", "select cast(p_partkey as string) as path, p_partkey + 1 as width, p_size * 500 as duration_ms, cast(p_partkey % 90 as double) + 0.5 as latitude from part")(
    lambda r: files.video_metadata(r.part.select(k().cast("string").alias("path"), F.to_json(F.struct(
        F.array(F.struct(F.lit("audio").alias("codec_type"), F.lit(0).cast("long").alias("width")), F.struct(F.lit("video").alias("codec_type"), (k() + 1).alias("width"))).alias("streams"),
        F.struct((F.col("p_size") / 2).cast("string").alias("duration"), F.struct(F.concat(F.lit("+"), (k() % 90).cast("string"), F.lit(".5-010.25/")).alias("location")).alias("tags")).alias("format"))).alias("probe"))).select("path", "width", "duration_ms", "latitude"))
query("S19_rules_source", "select unnest(['harbour', 'west']) as rule, unnest(['Harbour Quarter', 'West Bank']) as street")(lambda r: _rules(r))


def _rules(r: Roles):
    at = scratch(r, "rules")
    body = '{"Rules": [{"Name": "harbour", "CityEquals": "Town3", "NormalizedStreetAddress": "Harbour Quarter"}, {"Name": "west", "StateIn": ["S1"], "NormalizedStreetAddress": "West Bank"}]}'
    r.spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(at)
    return r.spark.createDataFrame([(x.name, x.normalized_street) for x in files.read_rules(r.spark, at)], "rule string, street string")


query("S21_pending_migrations", "select unnest(['002', '003']) as version")(lambda r: files.pending_migrations(r.spark, ["003", "001", "002"], r.spark.createDataFrame([("001",)], "version string")))
query("S20_previews", None)(lambda r: files.previews(_photo(r)).select("path", F.col("preview").isNotNull().alias("made")))


@query("N9_reused_neighbour", f"""select p_id, t_id from (select p.location_id as p_id, t.location_id as t_id, row_number() over (partition by p.location_id order by {_dist('p.latitude', 'p.longitude', 't.latitude', 't.longitude')}, t.provider_updated desc, t.location_id desc) as n,
    t.street_address is not null or t.category is null or coalesce(t.category = 'BUILDING', false) as allowed from location p join location t on t.user_id = p.user_id and t.provider is not null and {_dist('p.latitude', 'p.longitude', 't.latitude', 't.longitude')} <= {RADIUS}) x where n = 1 and allowed""")
def _(r: Roles):
    near = spatial.nearest_resolved(*_points(r), RADIUS, key="p_id")
    guard = r.location.select(F.col("location_id").alias("t_id"), reuse_allowed(F.col("street_address"), F.col("category"), F.lit("BUILDING")).alias("allowed"))
    return near.join(guard, "t_id").filter("allowed").select("p_id", "t_id")


query("M5_revision_of_rows", "select location_id, case when latitude is not null then sha256(cast(cast(latitude as decimal(9,6)) as string) || ',' || cast(cast(longitude as decimal(10,6)) as string)) end as revision from location")(
    lambda r: r.location.select("location_id", coordinate_revision(F.col("latitude"), F.col("longitude")).alias("revision")))


# ---- enrichment from tables, objects, pages, watching, queues


@query("U2_table_geocoder", """select location_id, case when hit then 'P' || location_id || ' Pier' else street_address end as street_address, case when hit then 'Port' else city end as city, case when hit then 'maps' else provider end as provider
  from (select *, provider is null and latitude is not null and longitude is not null and location_id % 3 <> 0 as hit from location) x""")
def _(r: Roles):
    """Two thirds of the places have a stored answer; coordinates are told apart by their revision."""
    revision = coordinate_revision(F.col("latitude"), F.col("longitude"))
    payload = F.to_json(F.struct(F.struct(F.concat(F.lit("P"), "location_id").alias("AddressNumber"), F.lit("Pier").alias("Street"), F.lit("Port").alias("Locality")).alias("Address")))
    stored = r.location.filter("location_id % 3 <> 0").select(revision.alias("coordinate_revision"), payload.alias("payload"), "location_id")
    # several places may share coordinates: the geocoder is asked with the place's own revision
    own = lambda asked: enrich.TableGeocoder(stored)(asked).filter(F.col("a.street_number") == F.concat(F.lit("P"), "location_id"))
    return enrich.geocoded(r.location, own, "maps", now()).select("location_id", "street_address", "city", "provider")


@query("U2_table_captioner", "select asset_id, 'a photo of ' || content_sha256 as description_text from asset where media_type = 'Photo' and content_sha256 in (select content_sha256 from asset where asset_id % 7 > 0) and asset_id not in (select asset_id from description where is_current)")
def _(r: Roles):
    stored = r.asset.filter("asset_id % 7 > 0").select("content_sha256", F.concat(F.lit("a photo of "), "content_sha256").alias("text"))
    return enrich.described(r.asset, r.description, enrich.TableCaptioner(stored))


@query("S18_put_get", "select sum(length(n_name) + 1)::bigint as bytes, true as same from nation")
def _(r: Roles):
    """A file put under a checked name has the size and checksum of its source; a wrong checksum refuses it."""
    made, kept = scratch(r, "object"), scratch(r, "kept")
    r.nation.select("n_name").repartition(1).sortWithinPartitions("n_name").write.text(made)
    source = manifest.file_facts(r.spark, made).first()
    manifest.put_object(r.spark, source.path, f"{kept}/nation.txt", sha256=source.sha256)
    try:
        manifest.put_object(r.spark, source.path, f"{kept}/bad.txt", sha256="0" * 64)
    except manifest.ManifestError:
        pass
    got = manifest.file_facts(r.spark, f"{kept}/*.txt")
    return got.agg(F.sum("length").alias("bytes"), (F.count_if(F.col("sha256") == source.sha256) == F.count(F.lit(1))).alias("same"))


query("T14_all_pages", "select job_id, (row_number() over (order by job_id desc) - 1) // 50 as page from job qualify row_number() over (order by job_id desc) <= 50000")(
    lambda r: feeds.all_pages(r.job.select("job_id"), F.col("job_id").desc(), size=50))
query("S17_fetched_batches", "select job_id, (row_number() over (order by job_id) - 1) // 100 as batch from job where job_type = 'Geocode' and status = 'Queued'")(
    lambda r: client.batched(r.job.filter("job_type = 'Geocode' and status = 'Queued'").select("job_id"), "job_id", size=100))


@query("P9_watch", f"select unnest({_TABLES}) as table_name")
def _(r: Roles):
    """One round of the watch over the folder of the tables."""
    at, kept = scratch(r, "watched"), scratch(r, "watch-checkpoint")
    stream = streams.watch(r.spark, r.sf_dir, pattern="*.parquet")
    streams.run_available(stream.select("path"), lambda batch, i: batch.write.mode("overwrite").parquet(f"{at}/batch={i}"), kept)
    return r.spark.read.parquet(at).select(F.regexp_extract("path", r"(\w+)\.parquet", 1).alias("table_name")).distinct()


query("Z12_partial_batch", """select event_id as message_id, case when event_id % 10 = 0 then 'Dead' when event_id % 7 = 0 and event_id % 3 < 2 then 'Retry' when event_id % 7 = 0 then 'Dead' else 'Done' end as state from events""")(
    lambda r: ledger.delivered(
        r.events.select(F.col("event_id").alias("message_id"), F.when(F.col("event_id") % 10 == 0, F.lit("{bad")).otherwise(F.col("props")).alias("body"), (F.col("event_id") % 3 + 1).alias("receive_count")),
        "k long", lambda body: F.col("message_id") % 7 != 0, max_receives=3).select("message_id", "state"))

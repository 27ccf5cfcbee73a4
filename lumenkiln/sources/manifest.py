"""Gzip-NDJSON manifests and results: reading with guardrails, writing deterministically."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENTRY, HEADER, RESULT_FIELDS

#: Limits of one manifest: bytes packed, bytes of a line, entries.
MAX_PACKED, MAX_LINE, MAX_ENTRIES = 256 << 20, 256 << 10, 250_000
MANIFEST_VERSION, RESULT_VERSION = "ManifestNdjsonV1", "ManifestResultNdjsonV1"


class ManifestError(ValueError):
    """The whole manifest is refused."""


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """Packed size and SHA-256 of the files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def ill_formed(line: Column) -> Column:
    """Whether a line is no JSON object, repeats a key, or is too long."""
    parsed = F.try_parse_json(line)
    return (F.octet_length(line) > MAX_LINE) | parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT")


def read_manifest(spark: SparkSession, path: str, *, sha256: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(header, entries) of a manifest; ManifestError if anything of the transport is wrong.

    The checks are one aggregation over the lines; entries keep their texts, for `validate` to judge.
    """
    facts = file_facts(spark, path).collect()
    if any(f.length > MAX_PACKED for f in facts) or (sha256 and [f.sha256 for f in facts] != [sha256]):
        raise ManifestError("size or checksum is not what was announced")
    lines = spark.read.text(path)
    kind = F.get_json_object("value", "$.recordType")
    bad = lines.agg(
        F.count_if(ill_formed(F.col("value"))).alias("ill_formed"), F.count_if(kind == "Manifest").alias("headers"), F.count_if(kind == "Entry").alias("entries"),
        F.count(F.lit(1)).alias("lines"), F.count_if(F.coalesce(F.get_json_object("value", "$.operation"), F.lit("Upsert")) != "Upsert").alias("others"),
    ).first()
    header = lines.filter(kind == "Manifest").select(F.from_json("value", HEADER).alias("h")).select("h.*")
    if bad.ill_formed or bad.headers != 1 or bad.headers + bad.entries != bad.lines:
        raise ManifestError("lines are malformed, or it is not one header and entries")
    if bad.others:
        raise ManifestError("only Upsert is allowed")
    said = header.first()
    problems = header_problems(said.asDict())
    if problems or int(said.entryCount) != bad.entries or bad.entries > MAX_ENTRIES:
        raise ManifestError("; ".join(problems) or "the entry count differs")
    entries = lines.filter(kind == "Entry").select(F.from_json("value", ENTRY).alias("e")).select("e.*")
    return header, entries


def header_problems(h: dict) -> list[str]:
    wanted = {"schemaVersion": MANIFEST_VERSION, "storageMode": "Local", "kind": "Full", "deletionDetectionReliable": "false"}
    found = [f"{k} is {h.get(k)!r}" for k, v in wanted.items() if h.get(k) != v]
    return found + [f"{k} is missing" for k in ("sourceId", "snapshotId") if not h.get(k)] + ([] if str(h.get("entryCount") or "").isdigit() else ["entryCount is no number"])


#: What permissionState may say.
PERMISSIONS = ("NotApplicable", "Full", "Limited", "Denied", "Unavailable")
_UUID = "^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def header_code(h: Column) -> Column:
    """The code under which a header (a struct of texts) is refused, or null: its first fault in the order of the checks."""
    known = lambda c: F.coalesce(h[c].rlike(_UUID), F.lit(False))
    count = h["entryCount"].try_cast("long")
    checks = [
        ((h["recordType"] == "Manifest") & (h["schemaVersion"] == MANIFEST_VERSION), "ManifestHeaderInvalid"),
        (F.coalesce(h["storageMode"], F.lit("Local")) == "Local", "BulkRemoteUnsupported"),
        (known("sourceId") & known("snapshotId") & (count >= 1) & (count <= MAX_ENTRIES), "ManifestHeaderInvalid"),
        (h["kind"] == "Full", "BulkManifestKindUnsupported"),
        (h["permissionState"].isin(*PERMISSIONS), "ManifestHeaderInvalid"),
        (h["deletionDetectionReliable"] == "false", "BulkDeletionDetectionUnsupported"),
        (h["clientCursor"].isNull() | ((F.length(h["clientCursor"]) <= 1024) & ~F.contains(h["clientCursor"], F.lit("\0"))), "ManifestHeaderInvalid"),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in checks])


def parted(entries: DataFrame) -> list[tuple[int, DataFrame]]:
    """(number, entries) of manifests that keep to the limit, in the order of row numbers; one that is empty where there are no entries.

    So many neighbouring row numbers hold no more entries than one manifest may have, and bands of them are put together as they fit.
    """
    band = F.floor((F.col("rowNumber").cast("long") - 1) / MAX_ENTRIES)
    made = []
    for at, n in sorted(tuple(x) for x in entries.groupBy(band.alias("band")).count().collect()):
        if n > MAX_ENTRIES:
            raise ManifestError("row numbers repeat")
        if made and made[-1][0] + n <= MAX_ENTRIES:
            made[-1] = (made[-1][0] + n, made[-1][1], at)
        else:
            made.append((n, at, at))
    return [(n, entries.filter(band.between(lo, hi))) for n, lo, hi in made] or [(0, entries)]


def write_manifest(header: dict, entries: DataFrame, path: str) -> None:
    """One gzip file: the header line, then entries by row number."""
    spark = entries.sparkSession
    first = spark.createDataFrame([(-1, None)], "n long, value string").select("n", F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted({"recordType": "Manifest", **header}.items())])).alias("value"))
    body = entries.select(F.col("rowNumber").cast("long").alias("n"), F.to_json(F.struct(F.lit("Entry").alias("recordType"), *sorted(c for c in entries.columns if c != "recordType"))).alias("value"))
    _one_file(first.unionByName(body), path)


def write_result(results: DataFrame, counts: dict, import_id: str, path: str) -> None:
    """The result artifact: header with the counts, then rows in order.  One task: it is one file in one order by contract."""
    spark = results.sparkSession
    head = {"recordType": "Result", "schemaVersion": RESULT_VERSION, "importId": import_id}
    body = F.struct(*[F.lit(v).alias(k) for k, v in sorted(head.items())], F.struct(*[F.lit(v).alias(k) for k, v in sorted(counts.items())]).alias("counts"))
    first = spark.range(1).select(F.lit(-1).cast("long").alias("n"), F.to_json(body).alias("value"))
    rows = results.select(F.col("rowNumber").cast("long").alias("n"), F.to_json(F.struct(F.lit("EntryResult").alias("recordType"), *RESULT_FIELDS)).alias("value"))
    _one_file(first.unionByName(rows), path)


def _one_file(rows: DataFrame, path: str) -> None:
    rows.repartition(1).sortWithinPartitions("n").select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def read_result(spark: SparkSession, path: str, *, after: int = 0) -> tuple[dict, DataFrame]:
    """(header, rows after a row number); ManifestError unless the rows are numbered 1 to n."""
    lines = spark.read.text(path)
    kind = F.get_json_object("value", "$.recordType")
    schema = ", ".join(f"{c} {'long' if c == 'rowNumber' else 'string'}" for c in RESULT_FIELDS)
    rows = lines.filter(kind == "EntryResult").select(F.from_json("value", schema).alias("r")).select("r.*")
    found = rows.agg(F.count("rowNumber").alias("n"), F.min("rowNumber").alias("lo"), F.max("rowNumber").alias("hi"), F.count_distinct("rowNumber").alias("d")).first()
    if found.n and not (found.lo == 1 and found.hi == found.n == found.d):
        raise ManifestError("row numbers are not contiguous")
    header = lines.filter(kind == "Result").select(F.from_json("value", "importId string, schemaVersion string, counts map<string,long>").alias("h")).select("h.*").first()
    return header.asDict(), rows.filter(F.col("rowNumber") > after)


def put_object(spark: SparkSession, source: str, target: str, *, sha256: str, most: int = MAX_PACKED) -> None:
    """A copy of a file under its name if size and checksum are right; nothing is left of it otherwise."""
    path, util = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    part, whole = path(f"{target}.part"), path(target)
    there = whole.getFileSystem(conf)
    util.copy(path(source).getFileSystem(conf), path(source), there, part, False, True, conf)
    facts = file_facts(spark, f"{target}.part").first()
    if facts.length > most or facts.sha256 != sha256:
        there.delete(part, False)
        raise ManifestError("size or checksum is not what was announced")
    there.rename(part, whole)


def read_csv_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifest CSV with backslash escapes; a malformed line fails the read."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", escape="\\", quote='"')


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape="\\", quote='"')


def load_one_file(stage: DataFrame, occurrences: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new pending occurrences, their change rows, counts) of a listing; items that are there already stay as they are.

    stage: occurrence_id, change_id, source_item_id, revision, file_name, locator, observed_size.
    """
    new = stage.join(occurrences.select("source_item_id"), "source_item_id", "left_anti")
    pending = new.drop("change_id").withColumns({"hash_status": F.lit("Pending"), "deletion_state": F.lit("Active"), "first_seen": as_of})
    changes = new.select("change_id", F.lit("MediaOccurrence").alias("entity_type"), F.col("occurrence_id").alias("entity_public_id"), F.lit("Upsert").alias("change_type"), as_of.alias("created_at"))
    counts = stage.agg(F.count(F.lit(1)).alias("loaded")).crossJoin(new.agg(F.count(F.lit(1)).alias("inserted"))).withColumn("already_present", F.col("loaded") - F.col("inserted")).withColumn("change_rows", F.col("inserted"))
    return pending, changes, counts

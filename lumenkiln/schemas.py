"""Schemas of the catalog's tables and of the manifest formats; keys are what the merges keep unique."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: str) -> T.StructType:
    kinds = {
        "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "ntz": T.TimestampNTZType(), "date": T.DateType(),
        "lat": T.DecimalType(9, 6), "lon": T.DecimalType(10, 6), "meters": T.DecimalType(10, 3), "units": T.DecimalType(20, 6), "share": T.DecimalType(5, 4), "provenance": PROVENANCE,
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()])


PROVENANCE = T.ArrayType(T.StructType([
    T.StructField("field", T.StringType()), T.StructField("source", T.StringType()), T.StructField("confidence", T.StringType()),
    T.StructField("processorVersion", T.StringType()), T.StructField("observedAtUtc", T.StringType()),
]))

ASSET = _table(
    asset_id="string", user_id="long", content_sha256="string", media_type="string", mime_type="string", byte_size="long", width="long", height="long", duration_ms="long",
    captured_local="ntz", captured_utc="ntz", time_zone="string", utc_offset_minutes="int", capture_source="string", category="string", storage_state="string", lifecycle_state="string",
    purge_after="ntz", provenance="provenance", created_at="ntz", updated_at="ntz",
)
OCCURRENCE = _table(
    occurrence_id="string", user_id="long", source_id="long", asset_id="string", source_item_id="string", file_name="string", locator="string", revision="string", observed_size="long",
    hash_status="string", availability_state="string", deletion_state="string", first_seen="ntz", last_seen="ntz",
)
LOCATION = _table(
    asset_id="string", user_id="long", latitude="lat", longitude="lon", altitude_m="meters", accuracy_m="meters", location_source="string", provider="string", place_id="string", street_address="string",
    city="string", state="string", country="string", rule_version="string", provider_updated="ntz",
)
DESCRIPTION = _table(description_id="string", user_id="long", asset_id="string", description_text="string", provider="string", model="string", prompt_version="string", status="string", is_current="boolean", created_at="ntz")
JOB = _table(
    job_id="string", user_id="long", asset_id="string", source_id="long", idempotency_key="string", job_type="string", status="string", attempt_count="int", max_attempts="int", next_attempt="ntz",
    lease_hash="string", lease_expires="ntz", failure_class="string", request_json="string", updated_at="ntz",
)
CHANGE = _table(user_id="long", entity_type="string", entity_public_id="string", asset_id="string", change_type="string", created_at="ntz")
USAGE = _table(user_id="long", provider="string", usage_month="date", unit_type="string", processed="units", reserved="units", hard_limit="units", circuit_state="string")

#: A manifest's header and entry lines, every scalar as the text that stood there.
HEADER = T.StructType([T.StructField(c, T.StringType()) for c in (
    "recordType", "schemaVersion", "storageMode", "sourceId", "snapshotId", "entryCount", "kind", "permissionState", "deletionDetectionReliable", "clientCursor",
)])
_LOCATED = T.StructType([T.StructField(c, T.StringType()) for c in ("latitude", "longitude", "altitudeMeters", "horizontalAccuracyMeters")])
ENTRY = T.StructType([
    *[T.StructField(c, T.StringType()) for c in (
        "recordType", "rowNumber", "operation", "sourceItemId", "sourceRevision", "fileName", "localLocator", "contentSha256", "mediaType", "mimeType", "byteSize", "widthPixels", "heightPixels",
        "durationMs", "capturedAtLocal", "capturedAtUtc", "timeZoneId", "utcOffsetMinutes",
    )],
    T.StructField("location", _LOCATED), T.StructField("provenance", PROVENANCE),
])
RESULT_FIELDS = ["rowNumber", "sourceItemId", "outcome", "occurrenceId", "mediaAssetId", "errorCode", "errorMessage"]

KEYS = {"asset": ["user_id", "content_sha256"], "occurrence": ["source_id", "source_item_id"], "location": ["user_id", "asset_id"], "job": ["user_id", "idempotency_key"]}


def drift(actual: T.StructType, expected: T.StructType) -> list[str]:
    """What keeps a frame from the schema: columns that miss or have another type."""
    have = {f.name: f.dataType for f in actual}
    return [f"{f.name}: {have.get(f.name)} instead of {f.dataType}" for f in expected if have.get(f.name) != f.dataType]

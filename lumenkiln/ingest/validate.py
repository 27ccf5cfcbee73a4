"""Entry validation: texts to typed columns, with the first rule that fails as the row's error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import coordinate_revision
from ..functions.times import consistent

# Whole numbers of 64 bits are stored as long, so its greatest value bounds them.
UINT32, UINT64 = (1 << 32) - 1, (1 << 63) - 1
# What may stand in the closed fields.
PROVENANCE_SOURCES = ["Exif", "Device", "FileMtime", "Google", "Manual", "AI", "Legacy", "Unknown"]
MEDIA_TYPES = ["Photo", "Video"]
LOCATION_FIELDS = ["location", "gps", "latitude", "longitude"]
LENGTHS = {"sourceItemId": 512, "sourceRevision": 255, "fileName": 512, "localLocator": 4096, "mimeType": 255}
_WHOLE, _DECIMAL, _ZONE = r"^-?\d{1,20}$", r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", r"(Z|[+-]\d{2}:?\d{2})$"


def _number(name: str, least: int, most: int) -> tuple[Column, Column]:
    text = F.col(name)
    value = F.when(text.rlike(_WHOLE), text.try_cast("decimal(20,0)"))
    return value, text.isNotNull() & ~F.coalesce(value.between(least, most), F.lit(False))


def _decimal(name: str, bound: int | None, scale: int, low: int | None = None) -> tuple[Column, Column]:
    """HALF_EVEN at the scale, as the wire's decimals are quantised."""
    text = F.col(f"location.{name}")
    value = F.when(text.rlike(_DECIMAL), F.bround(text.try_cast("decimal(30,12)"), scale))
    inside = F.lit(True) if bound is None else F.abs(value) <= bound
    return value, text.isNotNull() & ~F.coalesce(inside & (value >= low if low is not None else F.lit(True)) & value.isNotNull(), F.lit(False))


def validate(entries: DataFrame) -> DataFrame:
    """Typed entries with validation_state, error_code and error_message.

    Rules are tried in the order of the fields and the first that fails names the error.  Rejected rows keep their
    identity and lose the rest.
    """
    size, bad_size = _number("byteSize", 1, UINT64)
    width, bad_width = _number("widthPixels", 1, UINT32)
    height, bad_height = _number("heightPixels", 1, UINT32)
    duration, bad_duration = _number("durationMs", 0, UINT64)
    offset, bad_offset = _number("utcOffsetMinutes", -840, 840)
    lat, bad_lat = _decimal("latitude", 90, 6)
    lon, bad_lon = _decimal("longitude", 180, 6)
    alt, bad_alt = _decimal("altitudeMeters", None, 3)
    acc, bad_acc = _decimal("horizontalAccuracyMeters", None, 3, 0)
    local = F.when(~F.col("capturedAtLocal").rlike(_ZONE), F.col("capturedAtLocal").try_cast("timestamp_ntz"))
    utc = F.when(F.col("capturedAtUtc").rlike(_ZONE), F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("capturedAtUtc").try_cast("timestamp").cast("timestamp_ntz")))
    missing = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    p = F.col("provenance")
    wrong_source = F.coalesce(F.exists(p, lambda x: ~F.coalesce(x["source"].isin(*PROVENANCE_SOURCES), F.lit(False))), F.lit(False))
    wrong_trust = F.coalesce(F.exists(p, lambda x: x["confidence"].isNotNull() & ~F.coalesce(x["confidence"].try_cast("double").between(0, 1), F.lit(False))), F.lit(False))
    rules = [
        *[(missing(n) | (F.length(n) > most), f"{n} has to have 1 to {most} characters") for n, most in LENGTHS.items()],
        (~F.coalesce(F.lower("contentSha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "contentSha256 is no SHA-256"),
        (~F.coalesce(F.col("mediaType").isin(*MEDIA_TYPES), F.lit(False)), "mediaType is unknown"),
        (F.col("byteSize").isNull() | bad_size, "byteSize is out of range"), (bad_width, "widthPixels is out of range"), (bad_height, "heightPixels is out of range"), (bad_duration, "durationMs is out of range"),
        (F.col("capturedAtLocal").isNotNull() & local.isNull(), "capturedAtLocal is no local time"), (F.col("capturedAtUtc").isNotNull() & utc.isNull(), "capturedAtUtc is no time with a zone"),
        (F.length("timeZoneId") > 64, "timeZoneId is too long"), (bad_offset, "utcOffsetMinutes is out of range"),
        (~consistent(local, offset.cast("int"), utc), "local time, offset and utc disagree"),
        (bad_lat | bad_lon | (F.col("location").isNotNull() & (lat.isNull() | lon.isNull())), "location is out of range"), (bad_alt | bad_acc, "altitude or accuracy is out of range"),
        (F.coalesce(F.size(p) > 100, F.lit(False)), "provenance has over 100 items"), (wrong_source, "provenance source is unknown"), (wrong_trust, "provenance confidence is not 0 to 1"),
    ]
    error = F.get(F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(said)) for bad, said in rules]), lambda e: e.isNotNull()), F.lit(0))
    rows = entries.withColumn("_error", error)
    ok = F.col("_error").isNull()
    keep = lambda c, kind: F.when(ok, c).cast(kind)
    located = lat.isNotNull() & lon.isNotNull()
    first = F.get(F.filter(p, lambda x: F.lower(x["field"]).isin(*LOCATION_FIELDS)), F.lit(0))["source"]
    return rows.select(
        F.col("rowNumber").try_cast("long").alias("row_number"), F.col("sourceItemId").alias("source_item_id"), keep(F.col("sourceRevision"), "string").alias("source_revision"),
        keep(F.col("fileName"), "string").alias("file_name"), keep(F.col("localLocator"), "string").alias("locator"), keep(F.lower("contentSha256"), "string").alias("content_sha256"),
        keep(F.col("mediaType"), "string").alias("media_type"), keep(F.col("mimeType"), "string").alias("mime_type"), keep(size, "long").alias("byte_size"), keep(width, "long").alias("width"),
        keep(height, "long").alias("height"), keep(duration, "long").alias("duration_ms"), keep(local, "timestamp_ntz").alias("captured_local"), keep(utc, "timestamp_ntz").alias("captured_utc"),
        keep(F.col("timeZoneId"), "string").alias("time_zone"), keep(offset, "int").alias("utc_offset_minutes"), keep(lat, "decimal(9,6)").alias("latitude"), keep(lon, "decimal(10,6)").alias("longitude"),
        keep(alt, "decimal(10,3)").alias("altitude_m"), keep(acc, "decimal(10,3)").alias("accuracy_m"), F.when(ok, p).alias("provenance"),
        F.when(ok, coordinate_revision(lat, lon)).alias("coordinate_revision"), F.when(ok & located, F.coalesce(first, F.lit("Unknown"))).alias("location_source"),
        F.when(ok, "Valid").otherwise("Rejected").alias("validation_state"), F.when(~ok, "InvalidManifestEntry").alias("error_code"), F.col("_error").alias("error_message"),
    )

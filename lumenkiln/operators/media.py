"""Media queries: filters, keyset pages, summaries, search hits, details."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.times import as_search_text
from .visibility import availability, latest_current, preferred_occurrence, user_facing_state, visible_assets

SORTS = {"CapturedAtDesc": ("captured", True), "CapturedAtAsc": ("captured", False), "UpdatedAtDesc": ("updated_at", True)}
LOCATION_FIELDS = ["street_address", "city", "state", "country"]


@dataclass(frozen=True)
class Catalog:
    """The frames a media query reads, in the column names of `views`."""

    assets: DataFrame
    occurrences: DataFrame
    sources: DataFrame
    locations: DataFrame
    descriptions: DataFrame
    transcripts: DataFrame
    segments: DataFrame
    jobs: DataFrame


@dataclass(frozen=True)
class MediaQuery:
    device_id: int
    user_id: int | None = None
    source_id: int | None = None
    storage_mode: str | None = None
    media_type: str | None = None
    category: str | None = None
    captured_after: str | datetime | None = None
    captured_before: str | datetime | None = None
    has_location: bool | None = None
    trash: str = "Active"
    text: str | None = None
    sort: str = "CapturedAtDesc"
    cursor: str | None = None
    limit: int = 50

    def __post_init__(self):
        if self.trash not in ("Active", "Trashed", "All"):
            raise ValueError(f"no trash state {self.trash!r}")
        if self.sort not in SORTS:
            raise ValueError(f"no sort {self.sort!r}")
        if not 1 <= self.limit <= 200:
            raise ValueError("limit is 1 to 200")
        if self.captured_after and self.captured_before and str(self.captured_after) >= str(self.captured_before):
            raise ValueError("captured_after has to lie before captured_before")


def capture_key() -> Column:
    """Capture time for sorting: utc, else local, else creation; the clocks are mixed on purpose."""
    return F.coalesce("captured_utc", "captured_local", "created_at")


def located(locations: DataFrame) -> DataFrame:
    return locations.filter("latitude is not null and longitude is not null")


def filtered(c: Catalog, q: MediaQuery) -> DataFrame:
    """Visible assets under all filters of the query but its page."""
    rows = visible_assets(c.assets, c.occurrences, c.sources, q.device_id, with_trash=q.trash != "Active")
    keys = ["user_id", "asset_id"]
    if q.user_id is not None:
        rows = rows.filter(F.col("user_id") == q.user_id)
    if q.trash != "All":
        rows = rows.filter(F.col("lifecycle_state") == q.trash)
    for name in ("media_type", "category"):
        if getattr(q, name) is not None:
            rows = rows.filter(F.col(name) == getattr(q, name))
    if q.captured_after is not None:
        rows = rows.filter(F.col("captured_utc") >= F.lit(str(q.captured_after)).cast("timestamp_ntz"))
    if q.captured_before is not None:
        rows = rows.filter(F.col("captured_utc") < F.lit(str(q.captured_before)).cast("timestamp_ntz"))
    if q.source_id is not None:
        rows = rows.join(c.occurrences.filter(F.col("source_id") == q.source_id), keys, "left_semi")
    if q.storage_mode is not None:
        rows = rows.join(c.occurrences.join(c.sources.filter(F.col("storage_mode") == q.storage_mode), "source_id"), keys, "left_semi")
    if q.has_location is not None:
        rows = rows.join(located(c.locations), keys, "left_semi" if q.has_location else "left_anti")
    return search(c, rows, q.text) if q.text else rows


def search(c: Catalog, assets: DataFrame, text: str) -> DataFrame:
    """Assets with the text in a file name, the current description or transcript, category, type, a date's text or the location.

    Each side is reduced to the keys that match before it meets the assets, so texts don't move.
    """
    keys = ["user_id", "asset_id"]
    hit = lambda rows, column: rows.filter(X.matches(F.col(column), text)).select(*keys)
    located_hit = c.locations.filter(reduce(or_, [F.coalesce(X.matches(F.col(f), text), F.lit(False)) for f in LOCATION_FIELDS])).select(*keys)
    found = hit(c.occurrences, "file_name").unionByName(hit(c.descriptions.filter("is_current"), "description_text"))
    found = found.unionByName(hit(c.transcripts.filter("is_current"), "transcript_text")).unionByName(located_hit)
    found = found.distinct().withColumn("found", F.lit(True))
    own = [F.col("category"), F.col("media_type"), as_search_text(F.col("captured_local")), as_search_text(F.col("captured_utc"))]
    here = reduce(or_, [F.coalesce(X.matches(col, text), F.lit(False)) for col in own])
    return assets.join(found, keys, "left").filter(F.coalesce("found", F.lit(False)) | here).drop("found")


def page(assets: DataFrame, q: MediaQuery, kind: str = "media") -> DataFrame:
    """limit + 1 rows after the cursor, so the reader can tell whether there are more; ``sort_key`` is kept."""
    key, descending = SORTS[q.sort]
    rows = assets.withColumn("sort_key", capture_key() if key == "captured" else F.col(key))
    position = X.decode_cursor(q.cursor, kind)
    if position is not None:
        at, last = F.lit(position[0]).cast("timestamp_ntz"), position[1]
        k, i = F.col("sort_key"), F.col("asset_id")
        rows = rows.filter((k < at) | ((k == at) & (i < last)) if descending else (k > at) | ((k == at) & (i > last)))
    order = [F.desc("sort_key"), F.desc("asset_id")] if descending else [F.asc("sort_key"), F.asc("asset_id")]
    return rows.orderBy(*order).limit(q.limit + 1)


def next_cursor(rows: list, q: MediaQuery, kind: str = "media") -> tuple[list, str | None, bool]:
    """(page, cursor of the next page, has more) from the rows of `page`."""
    shown = rows[: q.limit]
    more = len(rows) > q.limit
    return shown, X.encode_cursor(kind, [shown[-1]["sort_key"].isoformat(), shown[-1]["asset_id"]]) if more else None, more


def summaries(c: Catalog, assets: DataFrame, device_id: int, *, page: bool = True) -> DataFrame:
    """What a list shows of each asset.  With page, ``assets`` has 201 rows at most, so every join has a small side; else nothing is broadcast."""
    keys = ["user_id", "asset_id"]
    few = assets.select(*keys)
    near = lambda rows: rows.join(F.broadcast(few) if page else few, keys, "left_semi")
    occurrences = near(c.occurrences)
    chosen = preferred_occurrence(occurrences, c.sources, device_id)
    flags = availability(occurrences, c.sources, device_id)
    described = latest_current(near(c.descriptions), "description_id", "description_text")
    states = user_facing_state(near(c.jobs))
    rows = assets.join(chosen, keys).join(flags, keys, "left").join(described, keys, "left").join(states, keys, "left")
    return rows.select(
        *assets.columns, F.col("file_name").alias("display_file_name"), "occurrence_id",
        F.when(F.coalesce("has_remote", F.lit(False)), "Remote").otherwise(F.col("source_mode")).alias("storage_mode"),
        F.when(F.coalesce("local_here", F.lit(False)), "LocalOnThisDevice").otherwise("Unavailable").alias("availability"),
        F.coalesce("state", F.lit("Ready")).alias("state"), F.left("description_text", F.lit(500)).alias("description_excerpt"),
        (F.col("lifecycle_state") == "Trashed").alias("is_trashed"),
    )


def timeline(c: Catalog, q: MediaQuery) -> DataFrame:
    """A page of the timeline: keys are chosen first, then the few rows get their summaries."""
    return summaries(c, page(filtered(c, q), q), q.device_id)


def hits(c: Catalog, q: MediaQuery) -> DataFrame:
    """A page of search results, each with the field that is shown for it.

    The field is the first that literally holds the text, folding case, of the preferred file name only; so an asset found
    by a wildcard or another occurrence's name is attributed to a later field, in the end to its date.
    """
    q = MediaQuery(**{**q.__dict__, "sort": "UpdatedAtDesc"})
    keys = ["user_id", "asset_id"]
    rows = summaries(c, page(filtered(c, q), q), q.device_id)
    few = F.broadcast(rows.select(*keys))
    described = latest_current(c.descriptions.join(few, keys, "left_semi"), "description_id", "description_text")
    described = described.select(*keys, F.col("description_text").alias("d_text"))
    spoken = latest_current(c.transcripts.join(few, keys, "left_semi"), "transcript_id", "transcript_text")
    spoken = spoken.select(*keys, "transcript_id", "transcript_text")
    first = c.segments.join(F.broadcast(spoken.select("transcript_id")), "transcript_id", "left_semi").filter(X.matches(F.col("segment_text"), q.text)).groupBy("transcript_id").agg(
        F.min_by(F.struct("sequence_number", "start_ms", "segment_text"), "sequence_number").alias("segment"),
    )
    rows = rows.join(described, keys, "left").join(spoken, keys, "left").join(first, "transcript_id", "left")
    rows = rows.join(c.locations.join(few, keys, "left_semi").select(*keys, *[F.col(f).alias(f"place_{f}") for f in LOCATION_FIELDS]), keys, "left")
    holds = lambda column: X.contains(F.col(column), q.text)
    places = [f"place_{f}" for f in LOCATION_FIELDS]
    in_place = reduce(or_, [holds(f) for f in places])
    place = F.coalesce(*[F.when(holds(f), F.col(f)) for f in places], F.col(places[0]))
    heard = holds("transcript_text")
    cases = [
        ("FileName", holds("display_file_name"), F.col("display_file_name")),
        ("Description", holds("d_text"), F.left("d_text", F.lit(1000))),
        ("Transcript", heard, F.left(F.coalesce("segment.segment_text", "transcript_text"), F.lit(1000))),
        ("Category", holds("category"), F.col("category")),
        ("MediaType", holds("media_type"), F.col("media_type")),
        ("Location", in_place, place),
    ]
    field_, shown = F.lit("Date"), as_search_text(F.coalesce("captured_local", "captured_utc", "created_at"))
    for name, when, value in reversed(cases):
        field_, shown = F.when(when, name).otherwise(field_), F.when(when, value).otherwise(shown)
    rows = rows.withColumns({"matched_field": field_, "highlight": shown})
    return rows.withColumns({
        "segment_number": F.when(F.col("matched_field") == "Transcript", F.col("segment.sequence_number")),
        "seek_to_ms": F.when(F.col("matched_field") == "Transcript", F.col("segment.start_ms")),
    })


def detail(c: Catalog, asset_ids: DataFrame, device_id: int, *, page: bool = False) -> DataFrame:
    """Assets with all that hangs on them, nested; trashed ones too.  Locators show only to the device that owns the source.

    Every side is reduced to the assets asked for before it is grouped; with page, these are 201 at most and are broadcast.
    """
    keys = ["user_id", "asset_id"]
    asset_ids = asset_ids.select("asset_id").distinct()
    few = F.broadcast(asset_ids) if page else asset_ids
    near = lambda rows: rows.join(few, "asset_id", "left_semi")
    occurrences = near(c.occurrences)
    assets = visible_assets(near(c.assets), occurrences, c.sources, device_id, with_trash=True)
    own = F.when(F.col("device_id") == device_id, F.col("file_name"))
    files = occurrences.join(c.sources, "source_id").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("occurrence_id", "source_key", "deletion_state", own.alias("locator")))).alias("occurrences"),
    )
    described = latest_current(near(c.descriptions), "description_id", "description_text")
    spoken = latest_current(near(c.transcripts), "transcript_id", "transcript_text")
    said = c.segments.join(F.broadcast(spoken) if page else spoken, "transcript_id", "left_semi").groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("sequence_number", "start_ms", "speaker"))).alias("segments"))
    return (
        assets.join(files, keys, "left").join(near(c.locations).select(*keys, "latitude", "longitude", "city"), keys, "left")
        .join(described, keys, "left").join(spoken, keys, "left").join(said, "transcript_id", "left")
    )

"""The set-based merge of a manifest into the catalog: pure functions from old frames to new ones.

Nothing here acts; the caller writes the frames of `Merged` as the catalog's next version.  Numbers of
rows are in the millions, and every step is an aggregation or an equi-join on the content hash or the source item.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import public_id
from ..storage import discard, discard_parts, durable, size_of

GAPS = ["width", "height", "duration_ms", "captured_local", "captured_utc", "time_zone", "utc_offset_minutes"]
RESOLVED = ["provider", "place_id", "street_address", "city", "state", "country", "rule_version", "provider_updated"]
COMPARED = ["asset_id", "file_name", "locator", "revision", "observed_size"]
OUTCOMES = {
    "created": "CreatedOccurrence", "updated": "UpdatedOccurrence", "duplicatesLinked": "DuplicateLinked", "deleted": "Deleted", "ignoredDeletions": "IgnoredDeletion",
    "unchanged": "Unchanged", "rejected": "Rejected",
}


#: Why valid rows are rejected here; tables keep a fault's number, from 1.
FAULTS = [("DuplicateManifestEntry", "The source item stands in an earlier row."), ("ContentHashMetadataMismatch", "Rows of one content disagree on the size.")]


class RelinkError(ValueError):
    """A source item is known with other content; the bulk path refuses such manifests whole."""


@dataclass
class Source:
    """A manifest's rows as they are kept on disk, in frames that are staged one after another.

    ``make`` gives a kept row the manifest's ``columns`` that follow from it, the content's digest packed; other columns stay beside them.  So
    digests, names and locators that an expression makes of less are written and moved by nothing.
    """

    shares: list[DataFrame]
    columns: list[str]
    make: Callable[[DataFrame], DataFrame]

    @classmethod
    def of(cls, rows: DataFrame, kept: list[str]) -> Source:
        """Rows of which nothing is known: these columns are kept as they are."""
        return cls([rows.select(kept).withColumn("content_sha256", packed(F.col("content_sha256")))], rows.columns, lambda rows: rows)

    @property
    def kept(self) -> list[str]:
        return self.shares[0].columns

    def joined(self, rows: DataFrame, key: str, *sides: DataFrame) -> DataFrame:
        """Kept rows left-joined to frames of one row a key.  Only kept columns and the key move, and small sides are hashed, so nothing is sorted."""
        for side in sides:
            rows = rows.join(side.hint("shuffle_hash"), key, "left")
        return self.make(rows if key in self.kept else rows.drop(key))


@dataclass
class Merged:
    assets: DataFrame
    #: Of these the ones that were there before, gaps filled; read without the created ones.
    old_assets: DataFrame
    occurrences: DataFrame
    locations: DataFrame
    changes: DataFrame
    failures: DataFrame
    rows: DataFrame
    results: DataFrame
    #: What was decided on each row, without the facts that `rows` has besides; both are read from one table, nothing is joined.
    decided: DataFrame
    #: The manifest's rows as they came, for another merge of it: read from the same table.
    staged: DataFrame
    #: The same rows as the merge keeps them, which move in less room.
    again: Source
    #: The change rows of assets, with the content they are of.
    asset_changes: DataFrame

    def counts(self) -> dict[str, int]:
        return outcome_counts(self.decided).first().asDict()

    def status(self) -> str:
        return final_status(self.counts()["rejected"])


def final_status(rejected: int) -> str:
    return "CompletedWithErrors" if rejected else "Completed"


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("outcome") == o).alias(n) for n, o in OUTCOMES.items()])


def reject(rows: DataFrame, bad: Column, code: str, message: str) -> DataFrame:
    """Valid rows with ``bad`` become rejected; null is not bad."""
    hit = (F.col("validation_state") == "Valid") & F.coalesce(bad, F.lit(False))
    return rows.withColumns({
        "error_code": F.when(hit, code).otherwise(F.col("error_code")), "error_message": F.when(hit, message).otherwise(F.col("error_message")),
        "validation_state": F.when(hit, "Rejected").otherwise(F.col("validation_state")),
    })


def reject_duplicates(rows: DataFrame) -> DataFrame:
    """The first valid row of a source item stays.  The rows are staged first, as they are read several times and validation is long."""
    rows = durable(rows.sparkSession, rows, "stage")
    # an aggregate combines before it moves; rows without an item, which are rejected by now, meet nothing
    first = rows.filter("validation_state = 'Valid'").groupBy("source_item_id").agg(F.min("row_number").alias("_first"))
    rows = rows.join(first, "source_item_id", "left")
    return reject(rows, F.col("row_number") > F.col("_first"), *FAULTS[0]).drop("_first")


def relinks(rows: DataFrame, occurrences: DataFrame, assets: DataFrame) -> DataFrame:
    """Valid rows whose item is known with other content."""
    known = occurrences.filter("asset_id is not null").select("source_item_id", "asset_id").join(assets.select("asset_id", F.col("content_sha256").alias("old_sha")), "asset_id")
    return rows.filter("validation_state = 'Valid'").join(known, "source_item_id").filter("old_sha <> content_sha256")


def reject_size_conflicts(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows must agree on the size with the asset of their content, or with its first valid row where it is new.

    Adds old_asset_id, and first_row of the content's first valid row.
    """
    valid = rows.filter("validation_state = 'Valid'")
    canonical = valid.groupBy("content_sha256").agg(F.min("row_number").alias("first_row"), F.min_by("byte_size", "row_number").alias("_canonical_size"))
    old = assets.select("content_sha256", F.col("asset_id").alias("old_asset_id"), F.col("byte_size").alias("_old_size"))
    # full: a content of invalid rows alone has its old asset too
    rows = rows.join(canonical.join(old, "content_sha256", "full"), "content_sha256", "left")
    rows = reject(rows, F.col("byte_size") != F.coalesce("_old_size", "_canonical_size"), *FAULTS[1])
    return rows.drop("_old_size", "_canonical_size")


def merge(rows: DataFrame | Source, assets: DataFrame, occurrences: DataFrame, locations: DataFrame, *, user_id: int, source_id: int, as_of: Column, check_relinks: bool = True) -> Merged:
    """Merge validated rows of one source; all old frames are the user's, occurrences the source's.

    Later duplicates of an item are rejected; then an item with new content refuses the manifest (`RelinkError`); then sizes are
    compared.  Assets are created from a content's first row or get their gaps filled; items are inserted, revived or found
    unchanged; an asset's last located row sets its coordinates and clears what was resolved for others.
    """
    spark, source = assets.sparkSession, rows if isinstance(rows, Source) else Source.of(rows, list(dict.fromkeys([*rows.columns, *DECIDED, *FACTS.values()])))
    table = decide(source, assets, occurrences, user_id, check_relinks)
    again = Source([table.select(source.kept)], source.columns, source.make)
    staged = source.make(again.shares[0]).withColumn("content_sha256", unpacked(F.col("content_sha256"))).select(source.columns)
    rows = with_ids(source, table, user_id)
    decided = rows.select(WITH_IDS)
    valid = rows.filter("validation_state = 'Valid'")

    new_assets, old_assets, gaps_filled = merge_assets(valid, assets, user_id, as_of)
    created = valid.filter("row_number = first_row and not has_old")
    merged_occurrences = merge_occurrences(valid, occurrences, user_id, source_id, as_of)
    touched = decided.filter("validation_state = 'Valid' and outcome <> 'Unchanged'").select(F.col("occurrence_id").alias("entity_public_id"), "asset_id")
    merged_locations = merge_locations(valid, locations, user_id)
    asset_changes = gaps_filled.unionByName(created.select(F.col("asset_id").alias("entity_public_id"), "asset_id", "content_sha256"))
    change = lambda frame, kind, *more: frame.select(F.lit(user_id).cast("long").alias("user_id"), F.lit(kind).alias("entity_type"), "entity_public_id", "asset_id", F.lit("Upsert").alias("change_type"), as_of.alias("created_at"), *more)
    source_change = spark.range(1).select(F.lit(f"source-{source_id}").alias("entity_public_id"), F.lit(None).cast("string").alias("asset_id"))
    changes = change(asset_changes, "MediaAsset").unionByName(change(touched, "MediaOccurrence")).unionByName(change(source_change, "MediaSource"))
    return Merged(old_assets.unionByName(new_assets.select(*assets.columns)), old_assets, merged_occurrences, merged_locations, changes, failures(decided, as_of), rows, result_rows(decided), decided, staged, again, change(asset_changes, "MediaAsset", "content_sha256"))


def decided_rows(rows: DataFrame | Source, assets: DataFrame, occurrences: DataFrame, *, user_id: int, check_relinks: bool = True, only: list[str] | None = None) -> DataFrame:
    """`Merged.decided` alone: the same steps over all rows, without the facts that only the catalog's new frames need.

    ``only``: of what `classify` adds to a row, all that is asked for; then nothing else of the rows is written.
    """
    source = rows if isinstance(rows, Source) else Source.of(rows, list(dict.fromkeys([*DECIDED, *FACTS.values()])))
    table = decide(source, assets, occurrences, user_id, check_relinks, only)
    return table if only else with_ids(source, table, user_id).select(WITH_IDS)


def decide(source: Source, assets: DataFrame, occurrences: DataFrame, user_id: int, check_relinks: bool, only: list[str] | None = None) -> DataFrame:
    """One table of all rows as they are kept, with what was decided, ids packed; or of all rows with these columns only.

    The rows are staged once, as validation is long; then they move twice, to their item and to their content, a part at a time, and
    of each table the parts go as the next one's come.
    """
    staged = None
    for n, share in enumerate(source.shares):
        dealt = source.make(share).withColumn("_part", part(F.coalesce("source_item_id", F.col("row_number").cast("string")))).select(*source.kept, "_part")
        # a share is as large as those before it
        staged = durable(assets.sparkSession, in_files(dealt, size_of(staged) // n) if n else dealt, "stage", small=True, by="_part", to=staged)
    items = in_parts(staged, "items", lambda some, here: known_items(source, some, here(occurrences, part(F.col("source_item_id"))), assets if check_relinks else None, user_id), by="_part", times=ITEM_TURN)
    if check_relinks and items.filter("_relinked").limit(1).take(1):
        raise RelinkError("BulkRelinkUnsupported")
    return in_parts(items, "decisions", lambda some, here: classify(source, some, here(assets, content_part(F.col("content_sha256"))), user_id).select(only or "*"))


def told(rows: DataFrame) -> DataFrame:
    """Made rows with the faults that were found here."""
    for n, fault in enumerate(FAULTS, 1):
        rows = reject(rows, F.col("_fault") == n, *fault)
    return rows


def failures(decided: DataFrame, as_of: Column) -> DataFrame:
    return decided.filter("outcome = 'Rejected'").select("row_number", "source_item_id", "error_code", "error_message", as_of.alias("created_at"))


def refreshed(sources: DataFrame, source_id: int, snapshot_id: str, as_of: Column) -> DataFrame:
    """Sources after a complete import of one of them: its scan time and snapshot are the import's."""
    here = F.col("source_id") == source_id
    return sources.withColumns({"last_complete_scan": F.when(here, as_of).otherwise(F.col("last_complete_scan")), "snapshot_id": F.when(here, F.lit(snapshot_id)).otherwise(F.col("snapshot_id"))})


def merge_assets(valid: DataFrame, assets: DataFrame, user_id: int, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new assets, old ones with gaps filled, keys of changed old ones)."""
    first = valid.filter("row_number = first_row")
    has_time = F.col("captured_local").isNotNull() | F.col("captured_utc").isNotNull()
    created = first.filter("not has_old").select(
        "asset_id", F.lit(user_id).cast("long").alias("user_id"), "content_sha256", "media_type", "mime_type", "byte_size", *GAPS,
        F.when(has_time, "Unknown").alias("capture_source"), F.lit(None).cast("string").alias("category"), F.lit("LocalOnly").alias("storage_state"), F.lit("Active").alias("lifecycle_state"),
        F.lit(None).cast("timestamp_ntz").alias("purge_after"), "provenance", as_of.alias("created_at"), as_of.alias("updated_at"),
    )
    incoming = first.filter("has_old").select("asset_id", *[F.col(g).alias(f"in_{g}") for g in GAPS], F.col("provenance").alias("in_provenance"), F.lit(True).alias("incoming"))
    rows = assets.join(incoming, "asset_id", "left")
    here = F.coalesce("incoming", F.lit(False))
    gap = F.lit(False)
    for g in GAPS:
        gap = gap | (F.col(g).isNull() & F.col(f"in_{g}").isNotNull())
    gap = gap | (F.col("provenance").isNull() & (F.coalesce(F.size("in_provenance"), F.lit(0)) > 0))
    changed = here & (gap | (F.col("lifecycle_state") == "Trashed"))
    rows = rows.withColumn("changed", changed)
    filled = {g: F.when(F.col("changed"), F.coalesce(g, f"in_{g}")).otherwise(F.col(g)) for g in [*GAPS, "provenance"]}
    filled |= {
        "lifecycle_state": F.when(F.col("changed"), "Active").otherwise(F.col("lifecycle_state")), "purge_after": F.when(~F.col("changed"), F.col("purge_after")),
        "updated_at": F.when(F.col("changed"), as_of).otherwise(F.col("updated_at")),
    }
    kept = rows.withColumns(filled)
    return created, kept.select(*assets.columns), kept.filter("changed").select(F.col("asset_id").alias("entity_public_id"), "asset_id", "content_sha256")


#: What is decided about a row is told by these columns and what `classify` adds.
DECIDED = ["row_number", "source_item_id", "content_sha256", "byte_size", "validation_state", "error_code", "error_message"]
WITH_IDS = [*DECIDED, "old_asset_id", "first_row", "is_new", "outcome", "asset_id", "occurrence_id"]
#: What of a known occurrence is compared with a row, and the row's columns.
FACTS = {"file_name": "file_name", "locator": "locator", "revision": "source_revision", "observed_size": "byte_size"}
#: Rows are dealt into so many parts, a power of two; a table is read in half as many turns, and so on, if a turn then has up to so many bytes of it.
PARTS, PART_BYTES = 8, 48 << 20
#: To their item rows move in less room, so a turn may have so many times that.
ITEM_TURN = 2
PART_FILE = 1 << 20


def part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def content_part(text: Column) -> Column:
    """The part of a content; the digest, which may be long to make, is asked for once where it is one."""
    return part(F.coalesce(F.unhex(text), F.encode(text, "UTF-8")))


def in_files(rows: DataFrame, size: int) -> DataFrame:
    """Rows of so many bytes in so few tasks that the files which each writes, one a part, have PART_FILE bytes or so."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, size // (PARTS * PART_FILE)))


def in_parts(table: DataFrame, name: str, step: Callable[[DataFrame, Callable[[DataFrame, Column], DataFrame]], DataFrame], *, by: str | None = None, times: int = 1) -> DataFrame:
    """What step(rows, here) makes of a table written by _part, some parts at a time; here(frame, its part) is what of a frame the same parts meet.

    All of the table is read, once; a part is removed when what came of it is written, and its shuffle files with it.
    ``by``: the result's last column, of the parts it is dealt into.  ``times``: a turn has up to so many times PART_BYTES.
    """
    size, turns, made = size_of(table), 1, None
    while turns < PARTS and size > turns * times * PART_BYTES:
        turns *= 2
    for turn in range(turns):
        mine = [p for p in range(PARTS) if p % turns == turn]
        out = step(table.filter(F.col("_part").isin(mine)).drop("_part"), lambda frame, its, mine=mine: frame.filter(its.isin(mine)) if turns > 1 else frame)
        if by:
            out = in_files(out, size // turns)
        made = durable(table.sparkSession, out, name, small=True, by=by, to=made)
        discard_parts(table, "_part", mine)
    discard(table)
    return made


def packed(text: Column) -> Column:
    """A text as bytes, hex digests in half the length: all that is longer than 32 bytes is another text behind 33 zeros."""
    return F.when((F.octet_length(text) == 64) & (F.lower(F.hex(F.unhex(text))) == text), F.unhex(text)).otherwise(F.concat(F.lit(b"\0" * 33), F.encode(text, "UTF-8")))


def unpacked(value: Column) -> Column:
    return F.when(F.octet_length(value) == 32, F.lower(F.hex(value))).otherwise(F.decode(F.substring(value, 34, 1 << 30), "UTF-8"))


def marked(value: Column, usual: Column) -> Column:
    """An id packed, and no bytes at all where it is the usual one."""
    return F.when(value == usual, F.lit(b"")).otherwise(packed(value))


def known_items(source: Source, rows: DataFrame, occurrences: DataFrame, assets: DataFrame | None, user_id: int) -> DataFrame:
    """Staged rows with what is known of their item, later duplicates faulty; one move of the rows.  Ids are packed.

    _same_facts: everything compared but the asset is equal (nulls too), and the occurrence is active and complete; _relinked, where assets
    are given: the item's content was another.  Last the part of the content.
    """
    made = source.make(rows)
    # most items stand in one row, and those need no partner
    first = made.filter("validation_state = 'Valid'").groupBy("source_item_id").agg(F.min("row_number").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    old = occurrences.select(
        "source_item_id", marked(F.col("occurrence_id"), public_id("occurrence", F.col("source_item_id"))).alias("known_id"), "asset_id", *[F.col(c).alias(f"old_{c}") for c in FACTS],
        ((F.col("deletion_state") == "Active") & (F.col("hash_status") == "Complete")).alias("_whole"))
    if assets is None:
        old = old.withColumn("_old_sha", F.lit(None).cast("binary"))
    else:
        old = old.join(assets.select("asset_id", packed(F.col("content_sha256")).alias("_old_sha")), "asset_id", "left")
    old = old.withColumn("_linked", packed(F.col("asset_id"))).drop("asset_id")
    rows = source.joined(made.select(*dict.fromkeys([*source.kept, "source_item_id"])), "source_item_id", first, old)
    valid = F.col("validation_state") == "Valid"
    late = valid & F.coalesce(F.col("row_number") > F.col("_first"), F.lit(False))
    same = F.col("_whole")
    for old_name, name in FACTS.items():
        same = same & F.col(f"old_{old_name}").eqNullSafe(F.col(name))
    own = packed(public_id("asset", F.lit(user_id), unpacked(F.col("content_sha256"))))
    # only what is linked is compared with the id that the content's asset would get
    linked = F.when(F.col("_linked").isNotNull(), F.when(F.col("_linked") == own, F.lit(b"")).otherwise(F.col("_linked")))
    sha = F.col("content_sha256")
    content = F.when(sha.isNull(), part(F.col("row_number"))).when(F.octet_length(sha) == 32, part(sha)).otherwise(content_part(unpacked(sha)))
    return rows.select(
        *source.kept, F.when(late, 1).cast("tinyint").alias("_fault"), "known_id", linked.alias("linked_id"), same.alias("_same_facts"), ((F.col("_old_sha") != F.col("content_sha256")) & valid & ~late).alias("_relinked"),
        content.alias("_part"))


def content_facts(items: DataFrame) -> DataFrame:
    """One row a content of valid rows: its first row, the size of that row, and its first row with a new item, of that size or any.

    Rows are counted by content and size before they move, so content that very many rows share is no single task's.  All that is
    gathered is a whole number, so nothing is sorted.
    """
    new = F.when(F.col("known_id").isNull(), F.col("row_number"))
    sizes = items.filter("validation_state = 'Valid'").groupBy("content_sha256", "byte_size").agg(F.min("row_number").alias("_row"), F.min(new).alias("_new"))
    contents = sizes.groupBy("content_sha256").agg(
        F.min("_row").alias("first_row"), F.min_by("byte_size", "_row").alias("_first_size"), F.min_by("_new", "_row").alias("_own"), F.min("_new").alias("_any"),
        F.min(F.when(F.col("byte_size").isNull(), F.col("_new"))).alias("_unsized"))
    # rows without a size agree with every size, and all rows do where the first has none
    first_new = F.when(F.col("_first_size").isNull(), F.col("_any")).otherwise(F.least("_own", "_unsized"))
    return contents.select("content_sha256", "first_row", "_first_size", first_new.alias("_first_new"))


def classify(source: Source, items: DataFrame, assets: DataFrame, user_id: int) -> DataFrame:
    """Kept rows with their outcome; one move of the rows.

    Rows that disagree on their content's size are faulty.  Invalid rows are Rejected.  Known items are Unchanged if everything compared is
    equal, else UpdatedOccurrence.  Of new items the first of a created asset is CreatedOccurrence, all others DuplicateLinked.
    """
    old = assets.select(
        packed(F.col("content_sha256")).alias("content_sha256"), marked(F.col("asset_id"), public_id("asset", F.lit(user_id), F.col("content_sha256"))).alias("old_asset_id"), F.col("byte_size").alias("_old_size"))
    made = told(source.make(items.drop("_relinked")))
    keyed = made.select(*dict.fromkeys([*source.kept, "_fault", "known_id", "linked_id", "_same_facts", "content_sha256"]))
    rows = told(source.joined(keyed, "content_sha256", content_facts(made), old))
    valid = F.col("validation_state") == "Valid"
    conflict = valid & F.coalesce(F.col("byte_size") != F.coalesce("_old_size", "_first_size"), F.lit(False))
    ok = valid & ~conflict
    new = ok & F.col("known_id").isNull()
    # ids of one content's rows: no bytes stand for the one that its new asset gets
    same = F.col("_same_facts") & F.col("linked_id").eqNullSafe(F.coalesce("old_asset_id", F.lit(b"")))
    created = new & F.col("old_asset_id").isNull() & (F.col("row_number") == F.col("_first_new"))
    outcome = F.when(~ok, "Rejected").when(created, "CreatedOccurrence").when(new, "DuplicateLinked").when(same, "Unchanged").otherwise("UpdatedOccurrence")
    fault = F.when(conflict, F.lit(2).cast("tinyint")).otherwise(F.col("_fault"))
    return rows.select(*source.kept, "known_id", fault.alias("_fault"), "old_asset_id", "first_row", new.alias("is_new"), outcome.alias("outcome"))


def with_ids(source: Source, table: DataFrame, user_id: int) -> DataFrame:
    """Decided rows with the manifest's columns, asset_id and occurrence_id; hashes and ids are texts again.  Usual ids are made here, not kept in tables."""
    ok = F.col("validation_state") == "Valid"
    own = {"old_asset_id": public_id("asset", F.lit(user_id), F.col("content_sha256")), "known_id": public_id("occurrence", F.col("source_item_id"))}
    # has_old tells what old_asset_id is null tells, without making ids to look at them
    rows = told(source.make(table)).withColumns({"content_sha256": unpacked(F.col("content_sha256")), "has_old": F.col("old_asset_id").isNotNull()})
    rows = rows.withColumns({c: F.when(F.octet_length(c) == 0, usual).otherwise(unpacked(F.col(c))) for c, usual in own.items()})
    rows = rows.withColumns({
        "asset_id": F.coalesce("old_asset_id", F.when(ok, own["old_asset_id"])),
        "occurrence_id": F.when(ok, F.coalesce("known_id", own["known_id"])),
    })
    return rows.select(*dict.fromkeys([*(c for c in source.columns if c in rows.columns), *WITH_IDS, "has_old"]))


def merge_occurrences(classified: DataFrame, occurrences: DataFrame, user_id: int, source_id: int, as_of: Column) -> DataFrame:
    facts = {"asset_id": "asset_id", "file_name": "file_name", "locator": "locator", "revision": "source_revision", "observed_size": "byte_size"}
    incoming = classified.filter("not is_new").select("occurrence_id", "outcome", *[F.col(v).alias(f"in_{k}") for k, v in facts.items()])
    rows = occurrences.join(incoming, "occurrence_id", "left")
    seen, touched = F.col("outcome").isNotNull(), F.coalesce(F.col("outcome") == "UpdatedOccurrence", F.lit(False))
    kept = rows.withColumns(
        {k: F.when(touched, F.col(f"in_{k}")).otherwise(F.col(k)) for k in facts}
        | {"deletion_state": F.when(touched, "Active").otherwise(F.col("deletion_state")), "hash_status": F.when(touched, "Complete").otherwise(F.col("hash_status")),
           "availability_state": F.when(touched, "Available").otherwise(F.col("availability_state")), "last_seen": F.when(seen, as_of).otherwise(F.col("last_seen"))}
    )
    added = classified.filter("is_new").select(
        "occurrence_id", F.lit(user_id).cast("long").alias("user_id"), F.lit(source_id).cast("long").alias("source_id"), "source_item_id", *[F.col(v).alias(k) for k, v in facts.items()],
        F.lit("Complete").alias("hash_status"), F.lit("Available").alias("availability_state"), F.lit("Active").alias("deletion_state"), as_of.alias("first_seen"), as_of.alias("last_seen"),
    )
    return kept.select(*occurrences.columns).unionByName(added.select(*occurrences.columns))


def merge_locations(valid: DataFrame, locations: DataFrame, user_id: int) -> DataFrame:
    """Coordinates of each asset's last located row; what was resolved stays only where they are the same."""
    own = ["latitude", "longitude", "altitude_m", "accuracy_m", "location_source"]
    last = valid.filter("latitude is not null and longitude is not null").groupBy("asset_id").agg(F.max_by(F.struct(*own), "row_number").alias("l"))
    incoming = last.select("asset_id", *[F.col(f"l.{c}").alias(f"in_{c}") for c in own])
    rows = locations.join(incoming, "asset_id", "full")
    arrived = F.col("in_latitude").isNotNull()
    same = F.col("latitude").eqNullSafe(F.col("in_latitude")) & F.col("longitude").eqNullSafe(F.col("in_longitude"))
    out = {c: F.when(arrived & ~same, F.lit(None)).otherwise(F.col(c)) for c in RESOLVED if c in locations.columns}
    out |= {c: F.when(arrived, F.col(f"in_{c}")).otherwise(F.col(c)) for c in own if c in locations.columns}
    out["user_id"] = F.coalesce("user_id", F.lit(user_id).cast("long"))
    return rows.withColumns(out).select(*locations.columns)


def result_rows(rows: DataFrame) -> DataFrame:
    """What the client gets for each row; rows without an item id get a placeholder."""
    item = F.coalesce(F.nullif("source_item_id", F.lit("")), F.concat(F.lit("__invalid_row__:"), F.lpad(F.col("row_number").cast("string"), 10, "0")))
    ok = F.col("outcome") != "Rejected"
    return rows.select(
        F.col("row_number").alias("rowNumber"), item.alias("sourceItemId"), "outcome", F.when(ok, F.col("occurrence_id")).alias("occurrenceId"), F.when(ok, F.col("asset_id")).alias("mediaAssetId"),
        F.col("error_code").alias("errorCode"), F.col("error_message").alias("errorMessage"),
    )


def geocode_jobs(locations: DataFrame, jobs: DataFrame, revision: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs to insert, jobs to queue again) of unresolved locations; a finished job of the same coordinates runs again."""
    wanted = locations.filter("latitude is not null and provider is null").select("user_id", "asset_id", F.concat(F.lit("geocode:"), "asset_id", F.lit(":"), revision).alias("idempotency_key"))
    old = jobs.select("user_id", "idempotency_key", "job_id", "status")
    again = wanted.join(old, ["user_id", "idempotency_key"]).filter(F.col("status").isin("Succeeded", "Failed", "Cancelled"))
    return wanted.join(old, ["user_id", "idempotency_key"], "left_anti"), again


def description_jobs(valid: DataFrame, descriptions: DataFrame, jobs: DataFrame, eligible: Column, key: Column) -> DataFrame:
    """Jobs for eligible photos without a current description, from an asset's first row."""
    first = valid.filter(eligible).groupBy("asset_id").agg(F.min_by(F.struct("occurrence_id", "row_number"), "row_number").alias("f")).select("asset_id", "f.*")
    first = first.join(descriptions.filter("is_current").select("asset_id"), "asset_id", "left_anti").withColumn("idempotency_key", key)
    return first.join(jobs.select("idempotency_key"), "idempotency_key", "left_anti")

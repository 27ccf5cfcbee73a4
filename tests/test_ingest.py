"""Manifests end to end: read, validate, merge, result; the incremental twin; snapshots."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lumenkiln import schemas
from lumenkiln.catalog import Snapshots, upsert
from lumenkiln.ingest import client, incremental, merge, validate
from lumenkiln.sources import files, manifest

def now():
    return F.lit("2026-08-27 16:00:00").cast("timestamp_ntz")



def entry(n, **more):
    return {
        "recordType": "Entry", "rowNumber": n, "operation": "Upsert", "sourceItemId": f"run:row:{n}", "sourceRevision": "r1", "fileName": f'photo, "{n}".JPG', "localLocator": f"/a b/{n}.jpg",
        "contentSha256": "a" * 64, "mediaType": "Photo", "mimeType": "image/jpeg", "byteSize": 101, **more,
    }


def write(path, entries, **header):
    head = {"recordType": "Manifest", "schemaVersion": "ManifestNdjsonV1", "storageMode": "Local", "sourceId": "s", "snapshotId": "x", "entryCount": len(entries), "kind": "Full", "permissionState": "Full", "deletionDetectionReliable": False, **header}
    with gzip.open(path, "wt") as f:
        f.writelines(json.dumps(x) + "\n" if not isinstance(x, str) else x + "\n" for x in [head, *entries])
    return str(path)


def empty(spark):
    return [spark.createDataFrame([], s) for s in (schemas.ASSET, schemas.OCCURRENCE, schemas.LOCATION)]


def canary(spark, path):
    rows = [entry(1), entry(2), entry(3, contentSha256="B" * 64, byteSize=202), entry(4, contentSha256="c" * 64, byteSize=0)]
    _, entries = manifest.read_manifest(spark, write(path, rows))
    return validate.validate(entries).cache()


def test_four_row_canary_and_rerun(spark, tmp_path):
    rows = canary(spark, tmp_path / "m.ndjson.gz")
    done = merge.merge(rows, *empty(spark), user_id=1, source_id=1, as_of=now())
    counts = done.counts()
    assert {k: counts[k] for k in ("processed", "created", "updated", "duplicatesLinked", "unchanged", "rejected")} == {"processed": 4, "created": 2, "updated": 0, "duplicatesLinked": 1, "unchanged": 0, "rejected": 1}
    assert (done.assets.count(), done.occurrences.count(), done.failures.count(), done.locations.count(), done.status()) == (2, 3, 1, 0, "CompletedWithErrors")
    again = merge.merge(rows, done.assets, done.occurrences, done.locations, user_id=1, source_id=1, as_of=now()).counts()
    assert again["unchanged"] == 3 and again["rejected"] == 1 and again["created"] == 0
    manifest.write_result(done.results, counts, "import-1", str(tmp_path / "result"))
    header, back = manifest.read_result(spark, str(tmp_path / "result"), after=2)
    assert header["counts"]["created"] == 2 and [r.rowNumber for r in back.collect()] == [3, 4]


def test_validation_rounds_and_names_the_first_error(spark, tmp_path):
    good = entry(1, location={"latitude": 40.6687, "longitude": -74.1143, "altitudeMeters": 12.3454}, provenance=[{"field": "GPS", "source": "Exif", "confidence": 0.5}], capturedAtLocal="2026-08-20T12:30:00", capturedAtUtc="2026-08-20T16:30:00Z", utcOffsetMinutes=-240)
    bad = [
        entry(2, mediaType="Song", byteSize=-1), entry(3, capturedAtLocal="2026-08-20T12:30:00Z"), entry(4, location={"latitude": 91, "longitude": 0}), entry(5, utcOffsetMinutes=900),
        entry(6, capturedAtLocal="2026-08-20T12:30:00", capturedAtUtc="2026-08-20T16:30:02Z", utcOffsetMinutes=-240), entry(7, contentSha256="xyz"), entry(8, provenance=[{"field": "x", "source": "Nobody"}]), entry(9, byteSize=True),
    ]
    _, entries = manifest.read_manifest(spark, write(tmp_path / "v.gz", [good, *bad]))
    rows = {r.row_number: r for r in validate.validate(entries).collect()}
    assert (str(rows[1].altitude_m), str(rows[1].latitude), rows[1].location_source, rows[1].file_name) == ("12.345", "40.668700", "Exif", 'photo, "1".JPG')
    assert rows[1].validation_state == "Valid" and all(rows[n].validation_state == "Rejected" and rows[n].file_name is None and rows[n].source_item_id for n in range(2, 10))
    assert rows[2].error_message.startswith("mediaType") and rows[5].error_message.startswith("utcOffset") and rows[6].error_message.startswith("local time")


@pytest.mark.parametrize("entries, header", [
    ([entry(1, operation="Deleted")], {}), ([entry(1)], {"entryCount": 2}), ([entry(1)], {"kind": "Incremental"}), ([entry(1)], {"deletionDetectionReliable": True}),
    (['{"recordType": "Entry", "rowNumber": 1, "rowNumber": 2}'], {}), (["not json"], {}), ([json.dumps(entry(1, localLocator="x" * (300 << 10)))], {}),
])
def test_refused_manifests(spark, tmp_path, entries, header):
    with pytest.raises(manifest.ManifestError):
        manifest.read_manifest(spark, write(tmp_path / "bad.gz", entries, **header))


def test_relink_refuses_the_manifest(spark, tmp_path):
    done = merge.merge(canary(spark, tmp_path / "m.gz"), *empty(spark), user_id=1, source_id=1, as_of=now())
    _, entries = manifest.read_manifest(spark, write(tmp_path / "n.gz", [entry(1, contentSha256="d" * 64)]))
    with pytest.raises(merge.RelinkError):
        merge.merge(validate.validate(entries), done.assets, done.occurrences, done.locations, user_id=1, source_id=1, as_of=now())


def test_moved_coordinates_clear_what_was_resolved(spark, tmp_path):
    at = lambda n, lat: entry(n, location={"latitude": lat, "longitude": 1})
    merged = lambda rows, old: merge.merge(validate.validate(manifest.read_manifest(spark, write(tmp_path / f"{len(str(rows))}.gz", rows))[1]), *old, user_id=1, source_id=1, as_of=now())
    first = merged([at(1, 10)], empty(spark))
    resolved = first.locations.withColumns({"provider": F.lit("maps"), "city": F.lit("Town")})
    same = merged([at(1, 10), at(2, 10.0)], (first.assets, first.occurrences, resolved)).locations.first()
    moved = merged([at(1, 10), at(2, 11)], (first.assets, first.occurrences, resolved)).locations.first()
    assert (same.provider, same.city) == ("maps", "Town") and (moved.provider, moved.city, float(moved.latitude)) == (None, None, 11.0)


def test_deletions_and_trash(spark, tmp_path):
    done = merge.merge(canary(spark, tmp_path / "m.gz"), *empty(spark), user_id=1, source_id=1, as_of=now())
    gone = validate.validate(spark.createDataFrame([json.dumps(entry(3, contentSha256="b" * 64, byteSize=202))], "string").select(F.from_json("value", schemas.ENTRY).alias("e")).select("e.*")).withColumn("operation", F.lit("Deleted"))
    out = lambda permission: incremental.outcomes(gone, done.occurrences, done.assets, reliable=True, permission=permission)
    assert out("Denied").first().outcome == "IgnoredDeletion"
    after = incremental.apply_occurrences(out("Full"), done.occurrences, 1, 1, now())
    jobs = spark.createDataFrame([], schemas.JOB)
    assets, _, changes = incremental.trash_cascade(done.assets, after, jobs, now())
    assert {r.content_sha256[0]: r.lifecycle_state for r in assets.collect()} == {"a": "Active", "b": "Trashed"} and changes.first().change_type == "Delete"


def test_snapshots_and_upsert(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/store")
    frame = lambda *rows: spark.createDataFrame(rows, "id long, a string, b string")
    assert store.version() == 0
    store.commit({"t": frame((1, "x", None), (2, "y", "q"))})
    new = upsert(store.read("t"), frame((1, "z", "n"), (3, "w", "m")), ["id"], {"a": "keep", "b": "coalesce_old"})
    assert store.commit({"t": new}) == 2
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "x", "n"), (2, "y", "q"), (3, "w", "m")] and store.read("t", 1).count() == 2
    assert not store.done("merge") and not store.mark("merge") and store.done("merge")


def test_two_writers(spark, tmp_path):
    """The second writer of a version fails and leaves the first one's files as they are."""
    root = f"file://{tmp_path}/store"
    one, two = Snapshots(spark, root), Snapshots(spark, root)
    frame = lambda n: spark.createDataFrame([(n,)], "id long")
    one.commit({"t": frame(1), "u": frame(10)})

    class Late:
        """A frame whose write lets the other writer go first."""

        @property
        def write(self):
            one.commit({"t": frame(2)})
            return frame(3).write

    with pytest.raises(RuntimeError, match="another writer"):
        two.commit({"t": Late()})
    assert two.version() == 2 and [r.id for r in two.read("t").collect()] == [2] and [r.id for r in two.read("t", 1).collect()] == [1]
    assert [r.id for r in two.read("u").collect()] == [10]  # tables that a commit leaves out stay what they were
    (tmp_path / "store/_commit-3").touch()  # begun, not ended
    assert two.version() == 2 and two.commit({"t": frame(4)}) == 4 and [r.id for r in one.read("t").collect()] == [4]
    with pytest.raises(LookupError):
        one.read("none")


def test_claims_keep_other_leases(spark):
    from lumenkiln.state import ledger

    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = [(1, "Queued", None, 0, None, None, None), (2, "Running", "Merged", 1, "x", "2024-01-01 00:00:01", None), (3, "Running", "Staged", 2, "x", "2023-12-31 00:00:00", None), (4, "Queued", None, 1, None, None, "2024-01-02 00:00:00")]
    imports = spark.createDataFrame(rows, "import_id long, status string, phase string, attempt_count int, lease_hash string, lease_expires string, next_attempt string")
    imports = imports.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("lease_expires", "next_attempt")})
    got = {r.import_id: r for r in ledger.claim_imports(imports, "me", at).collect()}
    assert {i: (r.claimed, r.next_step, r.attempt_count) for i, r in got.items()} == {1: (True, "Download", 1), 2: (False, None, 1), 3: (True, "Merge", 3), 4: (False, None, 1)}
    assert got[2].lease_hash == "x" and got[3].lease_expires.isoformat() == "2024-01-01T00:15:00"
    told = spark.createDataFrame([(2, "x", True), (3, "y", True)], "import_id long, lease_hash string, retryable boolean")
    after = {r.import_id: r for r in ledger.failed_imports(imports, told, at).collect()}
    assert (after[2].status, after[2].next_attempt.isoformat(), after[3].status) == ("Queued", "2024-01-01T00:05:00", "Running")


def test_client_round(spark):
    rows = lambda *r: spark.createDataFrame(list(r) or [], "source_item_id string, revision string")
    sent = client.deltas(rows(("a", "1"), ("b", "2"), ("c", "9")), rows(("a", "1"), ("b", "1"), ("d", "1")), rows(("c", "9")), complete_read=True)
    assert sorted(map(tuple, sent.collect())) == [("b", "2", "Upsert"), ("d", "1", "Deleted")]
    assert [r.source_item_id for r in client.deltas(rows(), rows(("d", "1")), rows(), complete_read=False).collect()] == []
    results = spark.createDataFrame([("b", "UpdatedOccurrence", None)], "source_item_id string, outcome string, error_code string")
    seen = {r.source_item_id: (r.state, r.error_code) for r in client.acknowledge(sent, results).collect()}
    assert seen == {"b": ("Accepted", None), "d": ("Quarantined", "MissingResult")}


def test_files(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    (tmp_path / "in/a.png").write_bytes(png)
    (tmp_path / "in/deep/b.jpg").write_bytes(b"")
    (tmp_path / "in/c.txt").write_text("x")
    listed = files.supported(files.list_files(spark, f"file://{tmp_path}/in"))
    full, skipped = files.stat_pass(listed)
    assert (listed.count(), full.count(), skipped.count()) == (1, 1, 0)  # the reader passes over empty files itself
    hits, misses = files.cached(full, full.select("path", "byte_size", "modified_at").withColumn("width", F.lit(1)))
    assert (hits.count(), misses.count()) == (1, 0)
    meta = files.photo_metadata(spark.read.format("binaryFile").load(f"file://{tmp_path}/in/a.png")).first()
    assert (meta.width, meta.height) == (640, 480)
    assert files.hashed(spark, f"file://{tmp_path}/in").count() == 2
    probe = json.dumps({"streams": [{"codec_type": "video", "width": 3, "height": 4}], "format": {"duration": "1.5", "tags": {"creation_time": "2024-01-02T03:04:05Z", "location": "+1.5-002.25/"}}})
    v = files.video_metadata(spark.createDataFrame([("p", probe)], "path string, probe string")).first()
    assert (v.width, v.duration_ms, v.longitude, v.captured_utc.hour) == (3, 1500, -2.25, 3)
    (tmp_path / "rules.json").write_text('{"Rules": [{"Name": "n", "CityEquals": "C", "NormalizedStreetAddress": "S"}]}')
    assert [(r.name, r.city) for r in files.read_rules(spark, f"file://{tmp_path}/rules.json")] == [("n", "C")]
    assert files.split_statements("create a; insert 'x;y';\n") == ["create a", "insert 'x;y'"]
    done = spark.createDataFrame([("001",)], "version string")
    assert [r.version for r in files.pending_migrations(spark, ["002", "001", "003"], done).collect()] == ["002", "003"]


def test_one_file_load(spark, tmp_path):
    ddl = "occurrence_id string, change_id string, source_item_id string, revision string, file_name string, locator string, observed_size long"
    stage = spark.createDataFrame([("o1", "c1", "i1", "r", 'a "q", x', "C:\\p", 1), ("o2", "c2", "i2", "r", "b", "/p", 2)], ddl)
    manifest.write_csv(stage, str(tmp_path / "csv"))
    back = manifest.read_csv_strict(spark, str(tmp_path / "csv"), ddl)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, stage.collect()))
    _, changes, counts = manifest.load_one_file(back, spark.createDataFrame([], "source_item_id string"), now())
    assert tuple(counts.first()) == (2, 2, 0, 2) and changes.count() == 2

"""What the review of round 2 found, on small rows."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenkiln import plans
from lumenkiln.ingest import incremental, merge
from lumenkiln.plans import ingest_queries
from lumenkiln.plans.registry import Roles
from lumenkiln.sources import manifest
from lumenkiln.state import ledger
from lumenkiln.views import TABLES

SF = "/root/testdata/sf0.01"


def on_disk(spark):
    """Bytes of shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_merge_leaves_little_on_disk(spark):
    """The merge's own steps leave no shuffle files, and keep of each row the stage and what was decided, once."""
    from lumenkiln import storage

    r, before = Roles(spark, SF), on_disk(spark)
    rows, written, durable = r.manifest.count(), [], storage.durable
    known = on_disk(spark) - before
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(merge, "durable", lambda *a, **b: written.append(durable(*a, **b)) or written[-1])
        done = ingest_queries.merged(r)
    left = 0
    for table in written:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._lumenkiln_table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        left += there.getContentSummary(path).getLength() if there.exists(path) else 0
    assert left < 110 * rows and on_disk(spark) - before - known < 20 * rows
    assert "Exchange" not in done.decided._jdf.queryExecution().executedPlan().toString()


def test_texts_survive_packing(spark):
    texts = ["ab" * 32, "AB" * 32, "ab" * 32 + "\n", "", "x", "y" * 31, "z" * 32, "é" * 40, None]
    found = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", merge.packed(F.col("t")).alias("p")).select("n", F.octet_length("p"), merge.unpacked(F.col("p")))
    found = {n: (size, t) for n, size, t in found.collect()}
    assert [found[i][1] for i in range(len(texts))] == texts and [i for i, x in found.items() if x[0] == 32] == [0]


def plain_rows(name, spark, sf):
    """(rows of the query, rows of its SQL) over a folder of tables."""
    con = duckdb.connect()
    for t in TABLES:
        if (sf / f"{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet{'/*' if (sf / f'{t}.parquet').is_dir() else ''}'")
    found = con.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    return sorted(map(tuple, plans.QUERIES[name](spark, str(sf)).select(*columns).collect())), sorted(found.fetchall())


def test_more_entries_than_a_manifest_may_have(spark, tmp_path, monkeypatch):
    """Several manifests, each within the limit; row numbers may have gaps."""
    duckdb.sql(f"copy (select p_partkey + case when p_partkey % 2 = 0 then 0 else 100000 end as p_partkey, p_name from '{SF}/part.parquet' where p_partkey < 300) to '{tmp_path}/part.parquet'")
    monkeypatch.setattr(manifest, "MAX_ENTRIES", 120)
    mine, sql = plain_rows("S8_manifest_source", spark, tmp_path)
    assert mine == sql and len(mine) == 300
    dealt = manifest.parted(spark.range(1, 301).select(F.col("id").cast("string").alias("rowNumber")))
    assert [(n, part.count()) for n, part in dealt] == [(120, 120), (120, 120), (60, 60)]
    assert [n for n, _ in manifest.parted(spark.createDataFrame([], "rowNumber string"))] == [0]


def test_rejected_rows_of_known_content(spark):
    """Where all rows of a content are rejected, its asset is still the old one."""
    old_asset = spark.createDataFrame([("a1", "s1", 5)], "asset_id string, content_sha256 string, byte_size long")
    known = spark.createDataFrame([("o1", "a1", "i1", "f", "/p", "r", 5, "Active", "Complete")], "occurrence_id string, asset_id string, source_item_id string, file_name string, locator string, revision string, observed_size long, deletion_state string, hash_status string")
    rows = spark.createDataFrame([(n, "i1", "r", "f", "/p", sha, 5, "Valid", None, None, "Upsert") for n, sha in ((1, None), (2, "s1"), (3, "s2"))], "row_number long, source_item_id string, source_revision string, file_name string, locator string, content_sha256 string, byte_size long, validation_state string, error_code string, error_message string, operation string")
    found = incremental.outcomes(rows, known, old_asset, reliable=True, permission="Full").orderBy("row_number").select("outcome", "relinked").collect()
    assert [tuple(x) for x in found] == [("Unchanged", False), ("Rejected", False), ("Rejected", True)]


def test_listing_of_tables_that_are_folders(spark, tmp_path):
    """The pattern is of the folder's entries, not of the files in them."""
    for t in ("pages", "part", "orders"):
        (tmp_path / f"{t}.parquet").mkdir()
        (tmp_path / f"{t}.parquet/part-0000.parquet").write_bytes(b"x")
    (tmp_path / "labels.parquet").write_bytes(b"x")
    listed = lambda name: sorted(x.table_name for x in plans.QUERIES[name](spark, str(tmp_path)).collect())
    assert listed("S2_filtered_listing") == ["pages", "part"] and listed("S1_listing") == ["labels", "orders", "pages", "part"]


def test_headers_of_large_keys(spark, tmp_path):
    """A header has one fault or none, however large its part's key is."""
    duckdb.sql(f"copy (select p_partkey + 249990 as p_partkey from '{SF}/part.parquet' where p_partkey < 100) to '{tmp_path}/part.parquet'")
    mine, sql = plain_rows("S9_header_checks", spark, tmp_path)
    assert mine == sql and sum(code is None for _, code in mine) == 11


def test_expiry_to_the_microsecond(spark):
    """A little less than 24 hours is within the expiry, 24 hours are not."""
    at = lambda s: datetime.datetime.fromisoformat(s)
    arrivals = {"a": ["2024-01-01 00:00:00.900000", "2024-01-02 00:00:00.100000"], "b": ["2024-01-01 00:00:00.900000", "2024-01-02 00:00:00.900000"], "c": ["2024-01-01 00:00:00.900000", "2024-01-01 20:00:00", "2024-01-02 00:00:00.899999", "2024-01-02 00:00:00.900000"]}
    rows = [(1, k, "POST", "r", "s", at(t), None, i) for k, times in arrivals.items() for i, t in enumerate(times)]
    found = ledger.idempotency(spark.createDataFrame(rows, "user_id long, idempotency_key string, method string, route string, request_sha256 string, arrived_at timestamp_ntz, answered_at timestamp_ntz, seq long")).collect()
    said = {k: [x.outcome for x in sorted(found, key=lambda x: x.seq) if x.idempotency_key == k] for k in arrivals}
    assert said == {"a": ["New", "RequestInProgress"], "b": ["New", "New"], "c": ["New", "RequestInProgress", "RequestInProgress", "New"]}

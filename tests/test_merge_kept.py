"""The merge keeps a manifest's rows as what the role makes them of: its disk stays within a few times the input."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenkiln import plans, storage, views
from lumenkiln.ingest import merge
from lumenkiln.plans import ingest_queries
from lumenkiln.plans.registry import Roles

from test_findings_r02 import on_disk, plain_rows

SF = "/root/testdata/sf0.01"


@pytest.fixture
def shares(monkeypatch):
    """Every share and every part by itself."""
    monkeypatch.setattr(merge, "PART_BYTES", 1)
    monkeypatch.setattr(views, "SHARE_BYTES", 1, raising=False)


def most_on_disk(spark, monkeypatch, run):
    """Bytes of tables and shuffle files beyond those at the start, at most, whenever a table's shares or parts have been written or go."""
    storage.release(spark)
    before, most, durable, parts = on_disk(spark), [0], storage.durable, storage.discard_parts

    def now():
        top = spark._jvm.org.apache.hadoop.fs.Path(storage.scratch(spark, "x").rsplit("/", 1)[0])
        files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        most.append(on_disk(spark) - before + (files.getContentSummary(top).getLength() if files.exists(top) else 0))

    monkeypatch.setattr(merge, "durable", lambda *a, **b: (durable(*a, **b), now())[0])
    monkeypatch.setattr(merge, "discard_parts", lambda *a: (now(), parts(*a))[0])
    run()
    return max(most)


def test_rows_are_kept_small(spark, shares, monkeypatch):
    """digests, names and locators that follow from less are not written; they were most of 50 bytes a row."""
    r = Roles(spark, SF)
    rows = r.manifest.count()
    assert (most := most_on_disk(spark, monkeypatch, lambda: ingest_queries.decided(r))) < 36 * rows, most / rows


@pytest.mark.parametrize("name", ["M25_status", "M_rerun_unchanged"])
def test_counts_write_outcomes_alone(spark, shares, monkeypatch, name):
    """of the rows only their outcome is written where only that is counted."""
    written, durable = [], storage.durable
    monkeypatch.setattr(merge, "durable", lambda *a, **b: (written.append((a[2], a[1].columns)), durable(*a, **b))[1])
    mine, sql = plain_rows(name, spark, Path("/root/testdata/sf0.001"))
    assert mine == sql and written[-1] == ("decisions", ["outcome"])


@pytest.mark.parametrize("name", ["M13_gap_fill", "M14_asset_changes", "M22_failures", "M24_counters", "M24_result_rows"])
def test_shares_change_nothing(spark, shares, name):
    mine, sql = plain_rows(name, spark, Path("/root/testdata/sf0.001"))
    assert Counter(mine) == Counter(sql)


def test_shares_have_all_rows(spark, shares):
    """The shares of a numbered table, put together, make the role's rows, with the same numbers."""
    source, role = ingest_queries._manifest(Roles(spark, "/root/testdata/sf0.001")), Roles(spark, "/root/testdata/sf0.001").manifest
    assert len(source.shares) == 8 and {"key", "rn"} < set(source.kept) and not {"content_sha256", "locator"} & set(source.kept)
    columns, made = [c for c in source.columns if c != "provenance"], source.make(source.shares[0])
    for share in source.shares[1:]:
        made = made.unionByName(source.make(share))
    made = made.withColumn("content_sha256", merge.unpacked(made.content_sha256)).select(columns)
    assert made.count() == role.count() and not made.exceptAll(role.select(columns)).take(1)


def test_plain_rows_are_decided_alike(spark, shares):
    """Rows of which nothing is known, kept as they are, are decided alike."""
    r = Roles(spark, "/root/testdata/sf0.001")
    plain = merge.decided_rows(r.manifest.drop("operation"), r.old_asset, r.old_occurrence, user_id=1)
    made = ingest_queries.decided(r)
    assert plain.columns == made.columns and plain.count() == made.count() and not plain.exceptAll(made).take(1)


def filters(frame):
    """The conditions of a frame's plan."""
    return [line for line in frame._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter " in line]


def test_old_assets_are_read_alone(spark):
    """what fills gaps of old assets reads no created ones; they were made, ids and all, to be left out."""
    assert "Union" not in plans.QUERIES["M13_gap_fill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["M14_asset_changes", "M18_changes"])
def test_no_id_is_made_for_a_condition(spark, name):
    """whether a content had an asset is told by what is kept, not by ids made of digests."""
    found = filters(plans.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert found and not any("isnull(CASE" in line or "isnotnull(CASE WHEN (octet_length(old_asset_id" in line for line in found)


@pytest.mark.parametrize("name", ["M15_outcomes", "M16_first_created", "M17_occurrences", "M22_failures", "M24_result_rows", "M25_status"])
def test_parts_of_assets_take_one_digest(spark, shares, monkeypatch, name):
    """Every turn looks for its part of the old assets, which made each digest twice and matched a pattern."""
    seen, durable = [], storage.durable
    monkeypatch.setattr(merge, "durable", lambda *a, **b: (seen.extend(filters(a[1]) if a[2] == "decisions" else []), durable(*a, **b))[1])
    plans.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    parts = [line.split("pmod(")[1].split(f", {merge.PARTS})")[0] for line in seen if "p_partkey" in line]
    # the second is of texts that are no digests
    assert len(parts) == merge.PARTS and all(x.count("sha2(") == 2 and x.count("unhex(sha2(") == 1 and "RLIKE" not in x for x in parts)


def test_contents_meet_in_their_part(spark):
    """A row's part is its content's, in whatever form digests are kept, and texts that are no digests have parts too."""
    texts = ["ab" * 32, "AB" * 32, "ab" * 32 + "\n", "", "x", "abc", "é" * 40]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    kept = frame.select("n", merge.content_part(F.col("t")).alias("a"), merge.content_part(merge.unpacked(merge.packed(F.col("t")))).alias("b"), merge.part(merge.packed(F.col("t"))).alias("c")).collect()
    assert all(x.a == x.b for x in kept) and kept[0].a == kept[0].c

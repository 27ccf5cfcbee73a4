"""The merge goes over its rows a part at a time: small on disk, and with equal results however many turns it takes."""

from collections import Counter
from pathlib import Path

import pytest

from lumenkiln import storage
from lumenkiln.ingest import merge
from lumenkiln.plans import ingest_queries
from lumenkiln.plans.registry import Roles

from test_findings_r02 import SF, plain_rows

SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture
def turns(monkeypatch):
    """Every part in a turn of its own."""
    monkeypatch.setattr(merge, "PART_BYTES", 1, raising=False)


def test_parts_go_as_the_next_come(spark, turns, monkeypatch):
    """The merge's tables together, whenever one has been written; it was the sum of four."""
    r, most, durable = Roles(spark, SF), [0], storage.durable
    rows = r.manifest.count()

    def watched(*a, **b):
        made = durable(*a, **b)
        top = spark._jvm.org.apache.hadoop.fs.Path(made._lumenkiln_table.rsplit("/", 1)[0])
        most.append(top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(top).getLength())
        return made

    storage.release(spark)
    monkeypatch.setattr(merge, "durable", watched)
    ingest_queries.merged(r)
    assert max(most) < 78 * rows, max(most) / rows


@pytest.mark.parametrize("name", ["M15_outcomes", "M16_first_created", "M17_occurrences", "M18_changes", "M_rerun_unchanged"])
def test_turns_change_nothing(spark, turns, name):
    mine, sql = plain_rows(name, spark, SMALL)
    assert Counter(mine) == Counter(sql)


def test_staged_rows_come_back(spark, turns):
    """The rows that another merge of the same manifest reads are those that came in, before any was rejected."""
    r = Roles(spark, str(SMALL))
    came, back = ingest_queries._none(r.manifest.drop("operation")), ingest_queries.merged(r).staged
    assert back.columns == came.columns and back.count() == came.count()
    assert not came.exceptAll(back).take(1)

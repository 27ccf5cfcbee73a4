"""op7 links vectors of every length that occurs, each with those of its own length."""

from lumenkiln.llm.embedding_dedup import embedding_dedup


def test_minority_lengths_link(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 0.1]), (6, [2.0])]
    got = sorted((r.id, r.n_links, r.component_id) for r in embedding_dedup(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 0, 6)]

"""op7 finds links where embeddings share a common direction, as centring widens their angles."""

import math

import numpy as np
import pytest

from lumenkiln.llm.embedding_dedup import at_threshold, embedding_dedup, itq, plan


def _pairs(common: float, n: int, dims: int, seed: int = 3):
    """Unit vectors around one direction, then as many whose cosine with them is 0.95 to 0.97."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one = unit(common * unit(r.normal(size=(1, dims))) + math.sqrt(1 - common**2) * unit(r.normal(size=(n, dims))))
    aside = r.normal(size=one.shape)
    aside = unit(aside - (aside * one).sum(axis=1, keepdims=True) * one)
    cos = r.uniform(0.95, 0.97, size=(n, 1))
    return one, cos * one + np.sqrt(1 - cos**2) * aside


@pytest.mark.parametrize("common", [0.0, 0.9])
def test_recall_off_centre(spark, common):
    vectors = np.concatenate(_pairs(common, 2000, 64))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = int((unit @ unit.T >= 0.95).sum()) - len(unit)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in embedding_dedup(spark, frame).select("n_links").collect())
    assert want >= 4000 and 0.99 * want <= got <= want


@pytest.mark.parametrize("common", [0.0, 0.8, 0.9, 0.99])
def test_plan_follows_the_measured_codes(common):
    one, two = _pairs(common, 4000, 64)
    fits = [itq(one, 64, seed) for seed in range(4)]
    for rows in (500_000, 20_000_000):
        bits, tables = plan(rows, 64, 0.95, at_threshold(one, 0.95, fits))
        differ = np.concatenate([((one - m) @ p >= 0) != ((two - m) @ p >= 0) for m, p in fits], axis=1).mean(axis=1)
        missed = 1 - (1 - differ) ** bits - bits * differ * (1 - differ) ** (bits - 1)
        assert (missed**tables).mean() < 0.004


def test_plan_of_codes_that_say_nothing_compares_all():
    assert plan(1000, 64, 0.95, np.array([1.0])) == (1, 1)

"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

Vectors that are equal are one class from the start.  A rotation learned on a bounded sample gives balanced binary
codes; the tables index disjoint substrings of the codes of *all* classes.  A pair is a candidate if a
substring differs in at most one bit and the first 128 bits of the codes in no more than pairs at the threshold
do, and is a link if the cosine of the original vectors in double precision says so.  How pairs at the
threshold differ is measured on the sample: codes are of centred vectors, and centring widens angles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import durable, keyed, table
from ._components import components

#: Vectors that the rotations are learned from.
SAMPLE = 20_000
ROUNDS = 30
#: Vectors that are moved to the threshold to measure how codes differ there, and code bits that are compared at least.
PAIRS, PAIR_BITS = 5_000, 256
#: Chance that a pair right at the threshold is missed by every table.
MISS = 0.002


#: Bits of a code that travel with a probe, as two words: enough to tell pairs that can't be links from those that may.
SKETCH = 128


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0))[1])


def itq(sample: np.ndarray, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions rotated so that the signs lose least."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    principal = vectors[:, ::-1][:, :bits]
    flat = centred @ principal
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(principal.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        u, _, vt = np.linalg.svd(np.where(flat @ rotation >= 0, 1.0, -1.0).T @ flat)
        rotation = (u @ vt).T
    return mean, principal @ rotation


def at_threshold(sample: np.ndarray, cosine: float, fits: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shares of code bits in which unit vectors and others right at the threshold from them differ, one a pair."""
    unit = sample[:PAIRS]
    aside = np.random.default_rng(len(unit)).normal(size=unit.shape)
    aside -= (aside * unit).sum(axis=1, keepdims=True) * unit
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    other = cosine * unit + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-9)
    return np.concatenate([((unit - m) @ p >= 0) != ((other - m) @ p >= 0) for m, p in fits], axis=1).mean(axis=1)


def _tables(flips: np.ndarray, bits: int) -> int:
    """The fewest tables that miss a share of at most MISS of pairs whose codes differ in these shares of bits."""
    miss = 1 - (1 - flips) ** bits - bits * flips * (1 - flips) ** (bits - 1)
    low, high = 0, 1
    while (miss**high).mean() > MISS:
        low, high = high, high * 2
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if (miss**middle).mean() > MISS else (low, middle)
    return high


def most_bits(rows: int, dims: int) -> int:
    """Bits of a substring at most: they grow with the rows, so a bucket's size does not."""
    return max(8, min(60, dims, math.ceil(math.log2(max(rows, 2)))))


def plan(rows: int, dims: int, cosine: float, flips: np.ndarray) -> tuple[int, int]:
    """(bits of a substring, tables): tables make up for what a substring misses, and substrings get shorter where that takes too many.

    Pairs differ as the measured ones do, or as random directions do if that is more.  One bit and one table hold all pairs.
    """
    flips = np.clip(flips, math.acos(cosine) / math.pi, 1.0)
    found = [(bits, _tables(flips, bits)) for bits in range(most_bits(rows, dims), 0, -1) if bits == 1 or flips.max() < 1]
    return min(found, key=lambda x: x[1] * (x[0] + 1) * (1 + rows / 2 ** x[0]))  # probes, and what they meet


def _usable(v: np.ndarray | None, dims: int) -> bool:
    return v is not None and len(v) == dims and bool(np.isfinite(v).all()) and bool(v.any())


def _coder(shared, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, projections, bits, tables = shared.value
        for batch in batches:
            rows = scaled(np.array(batch.column("v").to_pylist(), np.float64).reshape(-1, dims))
            unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            signs = np.concatenate([(unit - m) @ p >= 0 for m, p in zip(mean, projections)], axis=1)[:, : bits * tables]
            keys = signs.reshape(-1, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            sketch = np.pad(signs[:, :SKETCH], ((0, 0), (0, max(0, SKETCH - signs.shape[1]))))
            words = np.ascontiguousarray(np.packbits(sketch, axis=1)).view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(list(keys), pa.list_(pa.int64())), pa.array(words[:, 0]), pa.array(words[:, 1])], ["rep", "keys", "s0", "s1"])

    return run


def _reranker(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (scaled(np.array(batch.column(c).to_pylist(), np.float64)) for c in ("va", "vb"))
                cos = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                batch = batch.filter(pa.array(cos >= cosine))
            yield batch.select(["a", "b"])

    return run


def embedding_dedup(spark: SparkSession, vectors: DataFrame, *, cosine: float = 0.95, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links of cosine >= ``cosine`` among all vectors: id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths don't link.  Repeated or null ids are vectors of their own, nulls first; an empty table gives no rows; other
    columns are ignored.  component_id is the smallest id reachable, kept tells the row that bears it.  The sample bounds only
    what the rotation is learned from.  Candidates carry recall (see `MISS`), links are exact.
    """
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    base = keyed(spark, chosen, "id", "v")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    base = base.withColumn("v", F.when(finite, F.col("v")))
    classes = durable(spark, base.filter("v is not null").groupBy("v").agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    sizes = classes.groupBy(F.size("v").alias("dims")).count().filter("count > 1").orderBy("dims").collect()
    links = reduce(DataFrame.union, [_links(spark, classes, s["dims"], s["count"], cosine, sample) for s in sizes], spark.createDataFrame([], "a long, b long"))
    labels = components(spark, links)
    size_of = classes.select(F.col("rep").alias("b"), "size")
    both = links.union(links.select("b", "a"))
    linked = both.join(size_of, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("size").alias("others"))
    found = classes.join(linked, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = durable(spark, found.select("v", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component")), "found")
    out = base.join(found, "v", "left").select("_key", *(["id"] if "id" in base.columns else []), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_key").alias("component"))
    if "id" in base.columns:
        out = out.join(base.select(F.col("_key").alias("component"), F.col("id").alias("component_id")), "component")
    else:
        out = out.withColumns({"id": F.col("_key"), "component_id": F.col("component")})
    return out.select("id", "n_links", "component_id", (F.col("_key") == F.col("component")).alias("kept"))


def _links(spark: SparkSession, classes: DataFrame, dims: int, rows: int, cosine: float, sample: int) -> DataFrame:
    usable = classes.filter(F.size("v") == dims).select("rep", "v")
    share = min(1.0, sample / rows)
    learned = usable.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < share * (1 << 20)).select("v").toPandas()["v"]
    learned = np.array(learned.tolist(), np.float64).reshape(-1, dims) if len(learned) else np.eye(dims)
    learned = scaled(learned)
    learned /= np.linalg.norm(learned, axis=1, keepdims=True)
    fits = [itq(learned, dims, seed) for seed in range(max(1, -(-PAIR_BITS // dims)))]
    flips = at_threshold(learned, cosine, fits)
    bits, tables = plan(rows, dims, cosine, flips)
    fits = fits[: -(-bits * tables // dims)] + [itq(learned, dims, seed) for seed in range(len(fits), -(-bits * tables // dims))]
    shared = spark.sparkContext.broadcast(([m for m, _ in fits], [p for _, p in fits], bits, tables))
    flip, total = max(math.acos(cosine) / math.pi, flips.max()), min(SKETCH, bits * tables)
    # even the pair at the threshold that differs most, give or take; bits of one code lean on each other a little
    most = math.ceil(total * flip + 6 * math.sqrt(total * flip * (1 - flip)))

    codes = durable(spark, usable.mapInArrow(_coder(shared, dims), "rep long, keys array<long>, s0 long, s1 long"), "codes")
    keyed_ = codes.select("rep", "s0", "s1", F.posexplode("keys").alias("t", "key"))
    probes = F.concat(F.array("key"), F.array(*[F.col("key").bitwiseXOR(F.lit(1 << i)) for i in range(bits)]))
    left = keyed_.select(F.col("rep").alias("a"), F.col("s0").alias("a0"), F.col("s1").alias("a1"), "t", F.explode(probes).alias("key"))
    right = keyed_.select(F.col("rep").alias("b"), F.col("s0").alias("b0"), F.col("s1").alias("b1"), "t", "key")
    apart = F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))) + F.bit_count(F.col("a1").bitwiseXOR(F.col("b1")))
    pairs = left.join(right, ["t", "key"]).filter((F.col("a") < F.col("b")) & (apart <= most)).select("a", "b").distinct()
    pairs = pairs.join(usable.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(usable.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
    return durable(spark, pairs.select("a", "b", "va", "vb").mapInArrow(_reranker(cosine), "a long, b long"), "links")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark, table(spark, sf_dir, "embeddings"), cosine=0.95).withColumnRenamed("id", "vec_id")

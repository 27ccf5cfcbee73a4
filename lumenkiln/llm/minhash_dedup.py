"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

Documents with the same shingle set are one class, found by hash before anything else, so copies
cost no pairs.  Classes meet in banded buckets.  A bucket of n classes first gives n - 1 candidate pairs,
all with its smallest member.  Similar documents may both be unlike that hub; so in buckets whose
members are not in one component afterwards, the pairs across components are compared too, as only
these can still change a component.  There a bitmap of each set bounds the intersection from
above, and pairs that the bound rules out are never emitted.  Candidates are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, durable, frugal, keyed, others, table
from ._components import components
from ._repeats import byte_columns
from ._winnow import mix64

BANDS, ROWS = 24, 5
_BINS = BANDS * ROWS
_EDGES = np.array([(i << 64) // _BINS for i in range(_BINS)], np.uint64)
#: Codes (8 bytes each) of a block of sets in a deal, about, and document keys (8 bytes each) that may be broadcast.
BLOCK_CODES, MAX_BROADCAST_KEYS = 100_000, 1_000_000
#: 64-bit words of a bitmap, and codes that it holds at most; larger sets are thinned by powers of two.
WORDS, HELD = 32, 256
#: Standard deviations by which a thinned set's similarity may fall short before a pair is ruled out.
SLACK = 5.5


def shingles(raw: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the ``size``-word shingles; fewer words are one shingle, none give none."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(codes.tobytes(), n)], np.uint64)
    h = codes[: n - size + 1].copy()
    for j in range(1, size):
        h = mix64(h) + codes[j : n - size + 1 + j]
    return np.unique(mix64(h))


def _donors() -> np.ndarray:
    """For each bin the bins to borrow from, in the order of its own hash sequence, each bin once."""
    rng = np.random.default_rng(7)
    return np.array([rng.permutation(_BINS) for _ in range(_BINS)])


_DONORS = _donors()


def signature(codes: np.ndarray) -> np.ndarray:
    """One-permutation MinHash: the smallest code in each bin, empty bins densified from random donors.

    Every bin has a hash sequence of donors of its own and takes the first that isn't
    empty (optimal densification), so two sets agree in a bin with the probability of their similarity.
    """
    at = np.searchsorted(codes, _EDGES)
    full = np.diff(np.append(at, len(codes))) > 0
    out = np.zeros(_BINS, np.uint64)
    out[full] = codes[at[full]]
    empty = np.flatnonzero(~full)
    if len(empty):
        donors = _DONORS[empty]
        out[empty] = out[donors[np.arange(len(empty)), full[donors].argmax(axis=1)]]
    return out


_BAND_MULT = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BAND_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def bands(sign: np.ndarray) -> np.ndarray:
    rows = sign.reshape(BANDS, ROWS)
    return mix64((mix64(rows) * _BAND_MULT).sum(axis=1, dtype=np.uint64) + _BAND_SALT).view(np.int64)


def bitmaps(codes: np.ndarray) -> tuple[int, list[tuple[int, int, np.ndarray]]]:
    """The level of thinning, and (codes, bits short of codes, bitmap) at this level and the next."""
    level = max(0, int(np.ceil(np.log2(max(len(codes), 1) / HELD))))
    out = []
    for t in (level, level + 1):
        held = codes[: np.searchsorted(codes, np.uint64((1 << 64 - t) - 1), "right")] if t else codes
        bits = np.zeros(WORDS * 64, bool)
        bits[(held & np.uint64(WORDS * 64 - 1)).astype(np.int64)] = True
        out.append((len(held), len(held) - int(bits.sum()), np.packbits(bits).view("<i8")))
    return level, out


def _may_be_similar(percent: int) -> Column:
    """Whether the bitmaps (columns x0 ... and y0 ...) leave room for the similarity."""
    common = reduce(add, [F.bit_count(F.col(f"x{i}").bitwiseAND(F.col(f"y{i}"))) for i in range(WORDS)])
    most = common + F.least("x_short", "y_short")
    both = F.col("x_held") + F.col("y_held")
    least = percent / 100 - F.when(F.col("level") > 0, SLACK * F.sqrt(0.25 / F.greatest(both, F.lit(1)))).otherwise(1e-9)
    return most >= least * (both - most)


def _with_bitmaps(rows: DataFrame, letter: str) -> DataFrame:
    """Each row once for its own level of thinning and once for the next, the bitmap as columns."""
    levels = F.explode(F.array(F.struct(F.col("sketch.level").alias("level"), F.col("sketch.own").alias("map")), F.struct((F.col("sketch.level") + 1).alias("level"), F.col("sketch.next").alias("map"))))
    rows = rows.withColumn("own_level", F.col("sketch.level")).withColumn("at", levels)
    return rows.select(
        *[c for c in rows.columns if c not in ("at", "sketch", "own_level")], F.col("at.level").alias("level"), (F.col("at.level") > F.col("own_level")).alias(f"{letter}_next"),
        F.col("at.map.held").alias(f"{letter}_held"), F.col("at.map.short").alias(f"{letter}_short"), *[F.col("at.map.bits")[i].alias(f"{letter}{i}") for i in range(WORDS)],
    )


_MAP = "struct<held:int,short:int,bits:array<long>>"
FEATURES = f"_key long, n_shingles long, class binary, bands array<long>, sketch struct<level:int,own:{_MAP},next:{_MAP}>"


def _features(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct({"held": pa.int32(), "short": pa.int32(), "bits": pa.list_(pa.int64())})
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.struct({"level": pa.int32(), "own": one, "next": one}))
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column("_key").to_pylist(), byte_columns(batch, "text")):
                codes = shingles(raw, size)
                if not len(codes):
                    rows.append((key, 0, None, None, None))
                    continue
                level, maps = bitmaps(codes)
                own, then = ({"held": h, "short": s, "bits": b} for h, s, b in maps)
                rows.append((key, len(codes), xxhash.xxh3_128_digest(codes.tobytes()), bands(signature(codes)), {"level": level, "own": own, "next": then}))
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_key", "n_shingles", "class", "bands", "sketch"])
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["_key", "n_shingles", "class", "bands", "sketch"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(raw, size).tobytes() for raw in byte_columns(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], ["_key", "n", "codes"])

    return run


def _confirm(percent: int):
    """Rows of a deal: the sets of its documents first (b null), then its pairs; yields the pairs that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, sets = None, {}
        for batch in batches:
            links = []
            for *at, a, b, codes in zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "a", "b", "codes"))):
                if at != deal:
                    deal, sets = at, {}
                if b is None:
                    sets[a] = np.frombuffer(codes, np.uint64)
                    continue
                x, y = sets[a], sets[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def minhash_dedup(spark: SparkSession, docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Groups of documents with 100 * intersection >= percent * union of their shingle sets.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lowered.  Returns id (with carry the input as
    ``row`` and ``text``), n_shingles, component_id (smallest id of the group) and kept (whether this row is the
    group's first).  Null, empty and wordless texts have no shingles and stay alone.  Rows with null or repeated ids are documents
    of their own; of equal ids in a group the first by text is kept.  An empty table gives no rows.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([others(docs, text_col)] if carry else []))
    base = keyed(spark, chosen, "id", *chosen.columns[1:])
    texts = base.select("_key", "text")
    features = durable(spark, texts.mapInArrow(frugal(_features(shingle_words)), FEATURES), "features")
    used: list[DataFrame] = []

    def held_(df: DataFrame, name: str) -> DataFrame:
        """A written table that is not needed once every class has its component."""
        used.append(durable(spark, df, name))
        return used[-1]

    classes = held_(features.filter("n_shingles > 0").groupBy("class").agg(F.min("_key").alias("rep")), "classes")
    firsts = features.join(classes.select(F.col("rep").alias("_key")), "_key", "left_semi").withColumnRenamed("_key", "rep").withColumnRenamed("n_shingles", "n")
    members = held_(firsts.select("rep", "n", F.explode("bands").alias("bucket")).distinct(), "members")
    sizes = held_(members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "buckets")
    members = held_(members.join(sizes, "bucket"), "met")
    length = F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent

    sets = _sets_of(spark, texts, held_(members.select(F.col("rep").alias("_key")).distinct(), "keys"), shingle_words)
    used.append(sets)
    stars = members.filter("rep <> hub.rep").select(F.col("rep").alias("a"), F.col("hub.rep").alias("b"), "n", F.col("hub.n").alias("nb"))
    stars = held_(stars.filter(length).select(F.col("b").alias("group"), "a", "b").distinct(), "pairs")
    labels = components(spark, _confirmed(spark, stars, sets, percent))

    # buckets whose members are in several components
    open_ = members.filter("size > 2").select("bucket", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_ = held_(open_, "labelled")
    by_label = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    several = by_label.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("k", "label")).alias("most")).filter("labels > 1")
    open_ = open_.join(held_(several.select("bucket", F.col("most.label").alias("largest")), "several"), "bucket")
    open_ = held_(open_.join(firsts.select("rep", "n", "sketch"), "rep"), "open")
    outside = open_.filter("label <> largest").select("bucket", F.col("rep").alias("h"), F.col("n").alias("nb"), F.col("label").alias("lb"), "sketch")
    # each pair across components once: the one outside the bucket's largest component, or the larger of two such
    across = (F.col("label") != F.col("lb")) & ((F.col("label") == F.col("largest")) | (F.col("rep") < F.col("h"))) & length & ~(F.col("x_next") & F.col("y_next"))
    x, y = _with_bitmaps(open_, "x"), _with_bitmaps(outside, "y").withColumnsRenamed({"bucket": "yb", "level": "yl"})
    pairs = x.join(y, (F.col("bucket") == F.col("yb")) & (F.col("level") == F.col("yl")) & across & _may_be_similar(percent))
    pairs = pairs.groupBy(F.greatest("rep", "h").alias("a"), F.least("rep", "h").alias("b")).agg(F.min("largest").alias("group")).join(stars.drop("group"), ["a", "b"], "left_anti")
    labels = _joined(spark, labels, _confirmed(spark, held_(pairs.select("group", "a", "b"), "pairs"), sets, percent))

    classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("label", "rep").alias("component"))
    classes = durable(spark, classes, "components")
    discard(*used)
    out = features.select("_key", "n_shingles", "class").join(classes, "class", "left")
    out = out.select("_key", "n_shingles", F.coalesce("component", "_key").alias("component"))
    own = "id" in base.columns
    if carry or own:
        out = out.join(base.select("_key", *(["row", "text"] if carry else []), *(["id"] if own else [])), "_key")
    if own:
        out = out.join(base.select(F.col("_key").alias("component"), F.col("id").alias("component_id")), "component")
    else:
        out = out.withColumns({"id": F.col("_key"), "component_id": F.col("component")})
    return out.select(*(["row", "text"] if carry else ["id"]), "n_shingles", "component_id", (F.col("_key") == F.col("component")).alias("kept"))


def _confirmed(spark: SparkSession, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (group, a, b) that hold on full sets.

    A group's pairs are dealt out by blocks of a and blocks of b, of about BLOCK_CODES codes each, so a deal holds two blocks'
    sets whatever the number of its pairs, and a set travels once for each deal that needs it and not for each pair.
    """
    def blocks(side: str) -> DataFrame:
        members = pairs.select("group", F.col(side).alias("_key")).distinct().join(sets.select("_key", "n"), "_key")
        return members.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_CODES).alias(f"blocks_{side}"))

    dealt = pairs.join(blocks("a"), "group").join(blocks("b"), "group").select("group", F.pmod(F.xxhash64("a"), "blocks_a").alias("i"), F.pmod(F.xxhash64("b"), "blocks_b").alias("j"), "a", "b")
    dealt = durable(spark, dealt, "dealt")
    needs = dealt.select("group", "i", "j", F.explode(F.array("a", "b")).alias("_key")).distinct()
    rows = needs.join(sets, "_key").select("group", "i", "j", F.col("_key").alias("a"), F.lit(None).cast("long").alias("b"), "codes")
    rows = rows.unionByName(dealt.withColumn("codes", F.lit(None).cast("binary")))
    rows = rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", F.col("b").asc_nulls_first())
    return durable(spark, rows.mapInArrow(frugal(_confirm(percent)), "a long, b long"), "confirmed")


def _sets_of(spark: SparkSession, texts: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """The shingle sets (_key, n, codes) of some documents, written once; the keys are broadcast if they are few enough, else both sides are dealt out."""
    few = keys.count() <= MAX_BROADCAST_KEYS
    chosen = texts.join(F.broadcast(keys) if few else keys, "_key", "left_semi")
    return durable(spark, chosen.mapInArrow(frugal(_sets(size)), "_key long, n long, codes binary"), "sets")


def _joined(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the links between labels so far, applied to their nodes."""
    if not links.take(1):
        return labels
    old = labels.withColumnRenamed("node", "a").withColumnRenamed("label", "la")
    between = links.join(old, "a", "left").join(old.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b", "left")
    between = between.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(spark, between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    kept = labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    alone = moved.select(F.col("label").alias("node"), F.col("to").alias("label")).join(labels, "node", "left_anti")
    return durable(spark, kept.unionByName(alone), "labels")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_dedup(spark, table(spark, sf_dir, "documents"), shingle_words=5, percent=85)
    return out.withColumnRenamed("id", "doc_id")

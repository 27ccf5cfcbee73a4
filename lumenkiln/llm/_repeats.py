"""Repeated windows of ``span`` units across a corpus, without moving every window.

1. Each text is cut into content-defined segments (`_winnow`), written once.
2. Anchor fingerprints are counted; only segments whose fingerprint recurs go on.
3. Segments with equal hashes are put down as a class, with its first and its last
   place.  Both places are cut out of their texts, and the cuts meet in shards where the
   operator's ``resolve`` decides on the units themselves which windows recur:
   - a fingerprint with one class: neighbouring classes with the same two documents
     are cut as one stretch, and a shard is such a stretch at both places;
   - a fingerprint with several classes: all of them are one shard;
   - a fingerprint with very many: its windows are grouped by their content first, which
     combines before it moves, and each distinct window is a shard at two places.
4. What recurs comes back as *passages*: the units, how many windows they hold and
   where these stand first, under the class they were found in.
5. Documents are dealt out in chunks of bounded size.  Each chunk gets the passages of the
   classes that it holds, each once, and the operator finds them in its documents.

No list grows with a hot fingerprint, class or document: a chunk gets a passage once
however many of its documents hold it, and a class has two cuts however many members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _winnow
from ._common import discard, durable, frugal, give_back, runs

#: Classes of one fingerprint from which its windows are grouped by content.
SPLIT_CLASSES = 48
#: Units of a shard's cuts resolved at once; a shard is never divided.
SHARD_UNITS = 60_000
#: Classes in one stretch at most.
STRETCH = 16
#: Bytes of text and documents of a chunk, about; a longer document is a chunk by itself or nearly so.
CHUNK_BYTES, CHUNK_ROWS = 2 << 20, 20_000

#: A reader turns a text's UTF-8 bytes into unit codes; a cutter returns the bytes of units [a, b).
Reader = Callable[[bytes], np.ndarray]


def byte_columns(batch: pa.RecordBatch | pa.Table, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _extract(reader: Reader, span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            raw = byte_columns(batch, "text")
            for lo, hi in runs([len(x) for x in raw], 2 << 20):
                units = [reader(x) for x in raw[lo:hi]]
                lengths = np.array([len(u) for u in units], np.int64)
                for group in _winnow.pieces(lengths, span):
                    joined = np.concatenate([units[i][a:b] for i, a, b in group])
                    bounds = np.cumsum([0] + [b - a for _, a, b in group])
                    found = _winnow.segments(joined, bounds, span, k)
                    owner = np.array([i for i, _, _ in group])[found["seq"]] + lo
                    start = found["start"] + np.array([a for _, a, _ in group])[found["seq"]]
                    yield pa.RecordBatch.from_pydict({"_key": keys[owner], "start": start.astype(np.int32), "n": found["n"].astype(np.int32), "fp": found["fp"], "sh": found["sh"]})

    return run


#: A cut: its shard (a, b), its place, whether this is its classes' first place, its bytes, and its classes (``at`` and ``n`` are windows).
PART = "a long, b int, _key long, start int, own boolean, data binary, cls array<struct<fp:long,sh:long,at:int,n:int>>"
ALONE, TOGETHER, MANY = 1, 0, 2
_CLS = ("fp", "sh", "at", "n")


def _flat(lists: pa.Array, names: tuple[str, ...]) -> tuple[list[int], list[list]]:
    """Offsets of a column of lists of structs, and the fields of all structs as lists."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    return (offsets - offsets[0]).tolist(), [values.field(n).to_pylist() for n in names]


def _cut(cutter, span: int):
    """Cuts of a document's wanted segments; those of fingerprints with one class as stretches of neighbours with the same two places."""
    kinds = {"a": pa.int64(), "b": pa.int32(), "_key": pa.int64(), "start": pa.int32(), "own": pa.bool_(), "data": pa.binary()}
    cls_kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def stretches(segs: list[tuple]) -> Iterator[list[tuple]]:
        open_: dict[tuple, list[tuple]] = {}
        for s in segs:
            if s[5] > 1:
                yield [s]
                continue
            start, own, k1, s1, k2, s2 = s[0], s[1], *s[6:]
            held = open_.get((own, k1, k2, s2 - s1))
            if held and held[-1][0] + held[-1][2] == start and len(held) < STRETCH:
                held.append(s)
                continue
            if held:
                yield held
            open_[own, k1, k2, s2 - s1] = [s]
        yield from open_.values()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, keys = byte_columns(batch, "text"), batch.column("_key").to_pylist()
            offsets, fields = _flat(batch.column("segs"), ("start", "own", "n", "fp", "sh", "classes", "k1", "s1", "k2", "s2"))
            segs = list(zip(*fields))
            for lo, hi in runs([len(x) for x in raw], 2 << 20):
                rows, cls, ends = [], [], [0]
                for i in range(lo, hi):
                    take = cutter(raw[i])
                    for held in stretches(sorted(segs[offsets[i] : offsets[i + 1]])):
                        start, own, _, fp, _, classes, k1, s1, k2, _ = held[0]
                        if classes == 1:
                            a, b = xxhash.xxh3_64_intdigest(b"%d %d %d" % (k1, s1, k2)) - (1 << 63), ALONE
                        else:
                            a, b = fp, TOGETHER if classes <= SPLIT_CLASSES else MANY
                        rows.append((a, b, keys[i], start, own, take(start, held[-1][0] + held[-1][2] + span - 1)))
                        cls += [(s[3], s[4], s[0] - start, s[2]) for s in held]
                        ends.append(len(cls))
                if rows:
                    structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*cls), cls_kinds)], list(_CLS))
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], [*kinds, "cls"])

    return run


#: Windows at, ..., at + n - 1 of a class recur; they stand first at unit fstart, fstart + 1, ... of the document fkey.
PASSAGE = "fp long, sh long, at int, n int, fkey long, fstart int, data binary"
_PASSAGE = {"fp": pa.int64(), "sh": pa.int64(), "at": pa.int32(), "n": pa.int32(), "fkey": pa.int64(), "fstart": pa.int32(), "data": pa.binary()}


def _passage_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_PASSAGE)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _PASSAGE.values())], list(_PASSAGE))


def contiguous(on: np.ndarray, new: np.ndarray, fkey: np.ndarray, fstart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, length) of maximal runs of ``on`` in which no item is ``new`` but the first and the first places go on by one."""
    if not len(on):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = on.copy()
    begins[1:] &= ~on[:-1] | new[1:] | (fkey[1:] != fkey[:-1]) | (fstart[1:] != fstart[:-1] + 1)
    at = np.flatnonzero(begins)
    return at, np.bincount(np.cumsum(begins)[on] - 1, minlength=len(at))


def _compare(resolve, cutter, span: int):
    """Shards of complete (a, b) through ``resolve``; the passages of each class, once."""

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        keys, starts, own, cuts, classes = zip(*parts)
        sizes = np.array([c[-1][2] + c[-1][3] for c in classes])
        base = np.cumsum(sizes) - sizes
        key = np.repeat(np.array(keys, np.int64), sizes)
        place = np.arange(len(key)) + np.repeat(np.array(starts, np.int64) - base, sizes)
        recurs, first = resolve(cuts, sizes, key, place)
        flat = [(p, c) for p, (mine, cls) in enumerate(zip(own, classes)) if mine for c in cls]
        class_at = np.array([base[p] + c[2] for p, c in flat], np.int64)
        new = np.zeros(len(key), bool)
        new[class_at] = True
        fkey, fstart = key[first], place[first]
        at, length = contiguous(recurs & np.repeat(np.array(own), sizes), new, fkey, fstart)
        rows, part, take = [], -1, None
        of_class = np.searchsorted(class_at, at, side="right") - 1
        for w, n, k, s, c in zip(at.tolist(), length.tolist(), fkey[at].tolist(), fstart[at].tolist(), of_class.tolist()):
            p, (fp, sh, _, _) = flat[c]
            if p != part:
                part, take = p, cutter(cuts[p])
            a = w - int(base[p])
            rows.append((fp, sh, w - int(class_at[c]), n, k, s, take(a, a + n + span - 1)))
        return _passage_batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        units, last = 0, None
        for batch in batches:
            offsets, fields = _flat(batch.column("cls"), _CLS)
            cls = list(zip(*fields))
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "_key", "start", "own", "data")]
            for i, (a, b, *part) in enumerate(zip(*columns)):
                if (a, b) != last and units >= SHARD_UNITS:
                    yield flush(held)
                    held, units = [], 0
                own = cls[offsets[i] : offsets[i + 1]]
                held.append((*part, own))
                units += own[-1][2] + own[-1][3] + span
                last = (a, b)
        if held:
            yield flush(held)

    return run


def _windows(cutter, span: int):
    """Every window of a cut by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["data", "_key", "start", "own", "fp", "sh", "at"]
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            rows = []
            for part in batch.to_pylist():
                take, (c,) = cutter(part["data"]), part["cls"]  # a cut of its own has one class
                rows += [(take(j, j + span), part["_key"], part["start"] + j, part["own"], c["fp"], c["sh"], j) for j in range(c["n"])]
                if len(rows) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return run


def _gathered(cutter, span: int):
    """Passages of a class from its cut and the first places of the windows that recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fp, sh, data, windows in zip(*(batch.column(c).to_pylist() for c in ("fp", "sh", "data", "windows"))):
                take = cutter(data)
                at, key, start = (np.array(x, np.int64) for x in zip(*sorted((w["at"], w["fkey"], w["fstart"]) for w in windows)))
                apart = np.concatenate(([True], at[1:] != at[:-1] + 1))
                for w, n in zip(*(x.tolist() for x in contiguous(np.ones(len(at), bool), apart, key, start))):
                    a = int(at[w])
                    rows.append((fp, sh, a, n, int(key[w]), int(start[w]), take(a, a + n + span - 1)))
            yield _passage_batch(rows)

    return run


def passages(spark: SparkSession, docs: DataFrame, *, reader: Reader, cutter, resolve, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(instances, passages): the segments that may repeat, as _key, start, n, fp, sh, and what recurs in their classes.

    docs has ``_key`` (unique, not null) and ``text``.  resolve takes a shard's cuts (bytes), their windows, and each window's
    document and place; it returns per window whether it recurs and the index of its first place by (document, place).
    """
    segs = durable(spark, docs.mapInArrow(frugal(_extract(reader, span, k)), "_key long, start int, n int, fp long, sh long"), "segments")
    # written, so that the join below deals out both sides itself and a skewed fingerprint can be split
    recurring = durable(spark, segs.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("fp"), "recurring")
    # what recurs is hashed instead of sorting all segments; a partition's share of it is small
    instances = durable(spark, segs.join(recurring.hint("shuffle_hash"), "fp").select(*segs.columns), "instances")
    discard(segs, recurring)
    place = F.struct("_key", "start")
    classes = instances.groupBy("fp", "sh").agg(F.count(F.lit(1)).alias("members"), F.min(place).alias("one"), F.max(place).alias("last"), F.min("n").alias("n"))
    classes = durable(spark, classes, "classes")
    several = classes.groupBy("fp").agg(F.count(F.lit(1)).cast("int").alias("classes"))
    wanted = classes.join(several, "fp").filter("members > 1 or classes > 1")
    ends = F.when(F.col("members") > 1, F.array(F.struct("one.*", F.lit(True).alias("own")), F.struct("last.*", F.lit(False).alias("own")))).otherwise(F.array(F.struct("one.*", F.lit(True).alias("own"))))
    segs_of = (
        wanted.select("fp", "sh", "n", "classes", F.col("one._key").alias("k1"), F.col("one.start").alias("s1"), F.col("last._key").alias("k2"), F.col("last.start").alias("s2"), F.explode(ends).alias("end"))
        .groupBy(F.col("end._key").alias("_key")).agg(F.collect_list(F.struct(F.col("end.start").alias("start"), F.col("end.own").alias("own"), "n", "fp", "sh", "classes", "k1", "s1", "k2", "s2")).alias("segs"))
    )
    parts = durable(spark, docs.join(segs_of, "_key").select("_key", "text", "segs").mapInArrow(frugal(_cut(cutter, span)), PART), "parts")
    compare = lambda rows: rows.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(frugal(_compare(resolve, cutter, span)), PASSAGE)
    found = durable(spark, compare(parts.filter(F.col("b") != MANY)), "passages")

    many = parts.filter(F.col("b") == MANY)
    windows = durable(spark, many.mapInArrow(frugal(_windows(cutter, span)), "data binary, _key long, start int, own boolean, fp long, sh long, at int"), "windows")
    twice = windows.groupBy("data").agg(F.min(place).alias("one"), F.max(place).alias("last")).filter("one < last")
    one_window = F.array(F.struct(F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("sh"), F.lit(0).alias("at"), F.lit(1).alias("n")))
    ends = F.explode(F.array(F.struct("one.*", F.lit(True).alias("own")), F.struct("last.*", F.lit(False).alias("own"))))
    pairs = twice.select("data", ends.alias("end")).select(F.xxhash64("data").alias("a"), F.lit(MANY).alias("b"), "end._key", "end.start", "end.own", "data", one_window.alias("cls"))
    again = durable(spark, compare(pairs).select("data", "fkey", "fstart"), "again")
    of_class = durable(spark, windows.filter("own").join(again, "data").select("fp", "sh", F.struct("at", "fkey", "fstart").alias("w")), "recurring_windows")
    own = many.filter("own").select(F.col("cls")[0]["fp"].alias("fp"), F.col("cls")[0]["sh"].alias("sh"), "data")
    gathered = of_class.groupBy("fp", "sh").agg(F.collect_list("w").alias("windows")).join(own, ["fp", "sh"])
    rest = durable(spark, gathered.mapInArrow(_gathered(cutter, span), PASSAGE), "passages")
    discard(classes, parts, windows, again, of_class)
    return instances, found.unionByName(rest)


def in_chunks(spark: SparkSession, base: DataFrame, instances: DataFrame, found: DataFrame, work, schema: T.StructType, *, places: bool) -> DataFrame:
    """All rows of base (``_key``, ``text`` and more) in chunks through ``work`` (documents, passages -> rows).

    A chunk's passages are those of its classes, with ``places`` (where the class stands in the chunk) if asked for.
    """
    size = base.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    chunks = 1 + (size["bytes"] or 0) // CHUNK_BYTES + size["rows"] // CHUNK_ROWS
    chunk = F.pmod(F.xxhash64("_key"), F.lit(chunks)).alias("chunk")
    if places:
        held = instances.groupBy(chunk, "fp", "sh").agg(F.collect_list(F.struct("_key", "start")).alias("places"))
    else:
        held = instances.select(chunk, "fp", "sh").distinct()
    dealt = held.join(found, ["fp", "sh"]).drop("fp", "sh")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        done = work(left.drop_columns("chunk"), right)
        give_back()
        return done

    return base.withColumn("chunk", chunk).groupBy("chunk").cogroup(dealt.groupBy("chunk")).applyInArrow(one, schema)


def covered(starts: list[int], ends: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of units in any of the ranges."""
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    inside = np.cumsum(step[:n]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2]

"""Removal of repeated byte strings by longest-previous-factor arrays over suffix order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import keyed, table
from ._repeats import byte_columns, covered, in_chunks, passages

#: Random but fixed codes of the 256 byte values.
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


#: Bits of a position or a rank in a packed sort key; longer data are sorted without packing.
_BITS = 19


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices in the order of their keys (below 2 ** (64 - _BITS)), and the sorted keys; one sort of packed words where it fits."""
    if len(key) >> _BITS:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    packed = np.sort((key << np.uint64(_BITS)) | np.arange(len(key), dtype=np.uint64))
    return (packed & np.uint64((1 << _BITS) - 1)).astype(np.int64), packed >> np.uint64(_BITS)


def _dense(order: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Order-preserving codes 0, 1, ... of the distinct values, from the sorted order."""
    code = np.empty(len(order), np.uint64)
    code[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    return code


def suffix_ranks(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks of all positions' suffixes cut to that length) for lengths that double up to ``depth``.

    Prefix doubling; the last step overlaps, which orders the same as the bytes left to compare.
    """
    have = 1
    rank = data.astype(np.uint64)
    levels = [(1, rank)]
    while have * 2 <= min(depth, 8):
        rank = (rank[:-have] << np.uint64(8 * have)) | rank[have:]
        have *= 2
        levels.append((have, rank))
    order = np.argsort(rank)
    rank = _dense(order, rank[order])
    levels[-1] = (have, rank)
    width = np.uint64(_BITS if not len(rank) >> _BITS else 32)
    while have < depth:
        step = min(have, depth - have)
        pair = (rank[:-step] << width) | rank[step:]
        rank = _dense(*_order(pair))
        have += step
        levels.append((have, rank))
    return levels


def common_prefix(levels: list[tuple[int, np.ndarray]], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at p and at q, cut at the depth of the last level.

    From the longest level down: where a level's ranks are equal, that length is common and both go on behind it.
    """
    depth, last = levels[-1]
    whole = last[p] == last[q]
    out = np.where(whole, depth, 0)
    left = np.flatnonzero(~whole)
    p, q, have = p[left].copy(), q[left].copy(), np.zeros(len(left), np.int64)
    # a length that does not double the one below may fit again behind itself
    steps = [levels[i] for i in range(len(levels) - 2, -1, -1)]
    for n, rank in steps:
        fits = (p < len(rank)) & (q < len(rank))
        fits[fits] = rank[p[fits]] == rank[q[fits]]
        p, q, have = p + n * fits, q + n * fits, have + n * fits
    out[left] = np.minimum(have, depth)
    return out


def _nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each index the nearest one before it with a smaller value, else -1; all between are larger.

    Pointers jump along pointers: what lies between an index and the one pointed at is larger than either.
    """
    near = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero(near >= 0)
    open_ = open_[x[near[open_]] > x[open_]]
    while len(open_):
        near[open_] = near[near[open_]]
        open_ = open_[near[open_] >= 0]
        open_ = open_[x[near[open_]] > x[open_]]
    return near


def longest_previous_factor(levels: list[tuple[int, np.ndarray]], at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors of the suffixes at positions ``at``, and the indices of the suffixes they are found at (-1: none).

    ``place`` says what is previous: a permutation of 0 to n - 1, in the order of texts.  In suffix order the longest match with
    an earlier place is at the previous or at the next smaller place, as all between them are later; both are looked at and
    the longer one counts.  Lengths are cut at the depth of the last level.
    """
    n = len(at)
    here = np.empty(n, np.int64)
    here[place] = np.arange(n)
    rank = levels[-1][1][at]
    if n >> _BITS:
        order = np.lexsort((place, rank))
    else:
        order = here[(np.sort((rank << np.uint64(_BITS)) | place.astype(np.uint64)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
    ordered = place[order]
    before, after = _nearest_smaller(ordered), _nearest_smaller(ordered[::-1])[::-1]
    after = np.where(after >= 0, n - 1 - after, -1)
    best, source = np.zeros(n, np.int64), np.full(n, -1)
    for near in (before, after):
        has = np.flatnonzero((near >= 0) & (best[order] < levels[-1][0]))  # none is longer than the depth
        mine, other = order[has], order[near[has]]
        length = common_prefix(levels, at[mine], at[other])
        longer = length > best[mine]
        best[mine[longer]], source[mine[longer]] = length[longer], other[longer]
    return best, source


def _resolve(span: int):
    def resolve(cuts: list[bytes], sizes: np.ndarray, key: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By longest previous factors: windows with one of ``span`` bytes, and those that they are found at."""
        lengths = np.array([len(c) for c in cuts])
        levels = suffix_ranks(np.frombuffer(b"".join(cuts), np.uint8), span)
        at = np.arange(len(key)) + np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(sizes) - sizes), sizes)
        order = np.lexsort((byte, key))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        length, source = longest_previous_factor(levels, at, place)
        again = length >= span
        recurs = again.copy()
        recurs[source[again]] = True
        first = np.where(again, source, np.arange(len(key)))
        while (first[first] != first).any():  # sources of sources, up to the first copy
            first = first[first]
        return recurs, first

    return resolve


def _remove(span: int, keep: str, fields: list[str]):
    """Documents of a chunk without the passages that stand where their classes do, compared byte by byte."""

    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        keys, texts = docs.column("_key").to_pylist(), byte_columns(docs, "text")
        hits: list[tuple[list[int], list[int]]] = [([], []) for _ in texts]
        index = {key: i for i, key in enumerate(keys)}
        for batch in found.to_batches():
            for at, first, start, data, places in zip(*(batch.column(c).to_pylist() for c in ("at", "fkey", "fstart", "data", "places"))):
                for place in places:
                    key, a = place["_key"], place["start"] + at
                    i = index[key]
                    if (keep == "none" or (first, start) != (key, a)) and texts[i].startswith(data, a):
                        hits[i][0].append(a)
                        hits[i][1].append(a + len(data))
        removed, spans, left = [], [], []
        for raw, (starts, ends) in zip(texts, hits):
            a, b = covered(starts, ends, len(raw))
            kept, at = [], 0
            for lo, hi in zip(a.tolist(), b.tolist()):
                kept.append(raw[at:lo])
                at = hi
            kept.append(raw[at:])
            removed.append(int((b - a).sum()))
            spans.append(len(a))
            left.append(b"".join(kept))
        put = {"n_bytes": pa.array([len(x) for x in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(left, pa.binary())}
        return pa.table([put[c] if c in put else docs.column(c) for c in fields], fields)

    return work


def suffix_dedup(spark: SparkSession, docs: DataFrame, *, min_bytes: int = 200, keep: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes covered by a string of ``min_bytes`` that stands elsewhere too, removed from each text.

    keep="first" leaves each string's first copy by (id, byte); keep="none"
    removes all.  Strings are judged on the input.  Returns id, n_bytes,
    n_removed, n_spans, kept (binary).  A null or short text keeps everything;
    null or repeated ids are documents of their own; an empty table gives no rows;
    columns besides id and text are ignored, whatever their names.

    Which strings recur is decided by longest-previous-factor arrays over shards of cuts; documents lose what
    equals a passage found so, byte by byte.
    """
    base = keyed(spark, docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), "id", "text")
    instances, found = passages(
        spark, base.select("_key", "text"), reader=_reader, cutter=_cutter, resolve=_resolve(min_bytes), span=min_bytes, k=max(1, min_bytes // 3),
    )
    shape = T._parse_datatype_string("id long, n_bytes long, n_removed long, n_spans long, kept binary")
    chosen = base.select("_key", "text", F.col("id" if "id" in base.columns else "_key").alias("id"))
    return in_chunks(spark, chosen, instances, found, _remove(min_bytes, keep, shape.names), shape, places=True)


def _reader(raw: bytes) -> np.ndarray:
    return _CODES[np.frombuffer(raw, np.uint8)]


def _cutter(raw: bytes):
    return lambda a, b: raw[a:b]


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark, table(spark, sf_dir, "documents"), min_bytes=200, keep="none")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

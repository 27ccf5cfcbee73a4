"""Removal of repeated word passages: sharded Aho-Corasick automata of confirmed passages."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import keyed, others, table
from ._repeats import byte_columns, covered, in_chunks, passages

#: Words of the passages in one automaton; a chunk with more takes several.
SHARD_WORDS = 400_000


def _reader(raw: bytes) -> np.ndarray:
    # bytes.split() splits at exactly 0x20 and 0x09-0x0D
    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _cutter(raw: bytes):
    words = raw.split()
    return lambda a, b: b" ".join(words[a:b])


def _resolve(span: int):
    def resolve(cuts: list[bytes], sizes: np.ndarray, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the windows' words: which stand at several places, and where first."""
        seen: dict[bytes, int] = {}
        like, first, recurs = [], list(range(len(key))), [False] * len(key)
        keys, places, w = key.tolist(), place.tolist(), 0
        for cut, size in zip(cuts, sizes.tolist()):
            at = [0]
            for word in cut.split(b" "):
                at.append(at[-1] + len(word) + 1)
            for j in range(size):
                same = seen.setdefault(cut[at[j] : at[j + span] - 1], w)
                like.append(same)
                if same != w:
                    recurs[w] = recurs[same] = True
                    if (keys[w], places[w]) < (keys[first[same]], places[first[same]]):
                        first[same] = w
                w += 1
        return np.array(recurs, bool), np.array(first, np.int64)[like]

    return resolve


class Automaton:
    """An Aho-Corasick automaton over passages, stepping by words.

    A word is two code points, of two alphabets, so no match begins inside a word; a node's children are
    searched one by one, and a word as one code point would give the root as many children as there are first words.
    """

    _BASE, _HIGH = 256, 0x1000
    _UNKNOWN = "\x01\x01"

    def __init__(self, found: list[tuple[bytes, tuple[int, int]]]):
        self._codes: dict[bytes, str] = {}
        self._automaton = ahocorasick.Automaton()
        code = self._code
        for data, first in found:
            words = data.split(b" ")
            self._automaton.add_word("".join([code(w) for w in words]), (len(words), first))
        self._automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        code = self._codes.get(word)
        if code is None:
            n = len(self._codes)
            code = self._codes[word] = chr(self._HIGH + n // self._BASE) + chr(2 + n % self._BASE)
        return code

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, int]]]:
        """(first word, words, first place) of every passage in the text."""
        get, unknown = self._codes.get, self._UNKNOWN
        for end, (size, first) in self._automaton.iter("".join([get(w, unknown) for w in words])):
            yield end // 2 - size + 1, size, first


def _shards(found: pa.Table) -> Iterator[list[tuple[bytes, tuple[int, int]]]]:
    """The passages by SHARD_WORDS words."""
    shard, held = [], 0
    for batch in found.to_batches():
        for data, k, s in zip(*(batch.column(c).to_pylist() for c in ("data", "fkey", "fstart"))):
            shard.append((data, (k, s)))
            held += data.count(b" ") + 1
            if held >= SHARD_WORDS:
                yield shard
                shard, held = [], 0
    if shard:
        yield shard


def _remove(keep: str, fields: list[str]):
    """Every document of a chunk through the automata of the chunk's passages, and without what they find."""

    def work(docs: pa.Table, found: pa.Table) -> pa.Table:
        keys, texts = docs.column("_key").to_pylist(), [raw.split() for raw in byte_columns(docs, "text")]
        hits: list[tuple[list[int], list[int]]] = [([], []) for _ in texts]
        for shard in _shards(found):
            automaton = Automaton(shard)
            for key, words, (starts, ends) in zip(keys, texts, hits):
                for at, size, first in automaton.occurrences(words):
                    if keep == "none" or first != (key, at):
                        starts.append(at)
                        ends.append(at + size)
        removed, kept = [], []
        for words, (starts, ends) in zip(texts, hits):
            a, b = covered(starts, ends, len(words))
            left, at = [], 0
            for lo, hi in zip(a.tolist(), b.tolist()):
                left += words[at:lo]
                at = hi
            left += words[at:]
            removed.append(int((b - a).sum()))
            kept.append(b" ".join(left))
        put = {"n_words": pa.array([len(w) for w in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())}
        return pa.table([put[c] if c in put else docs.column(c) for c in fields], fields)

    return work


def substring_dedup(spark: SparkSession, docs: DataFrame, *, min_words: int = 20, keep: str = "first", id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Words covered by a passage of ``min_words`` words that stands earlier too, removed.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged.  Earlier
    is a smaller id, or an earlier start in the same text; keep="none"
    removes first copies as well.  Returns id (with carry the input as ``row`` and ``original``), n_words, n_removed,
    kept (the words left, joined by one space).  Null, empty and short texts keep all they have; null or repeated ids
    are documents of their own, nulls first; an empty table gives no rows; other columns are ignored.

    Passages that recur are confirmed on their words in shards; the automata of a chunk's passages then read every
    document of the chunk, and what they find, but for a passage's first place, is what goes.
    """
    row = [others(docs, text_col)] if carry else []
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *row)
    base = keyed(spark, chosen, "id", *chosen.columns[1:])
    instances, found = passages(
        spark, base.select("_key", "text"), reader=_reader, cutter=_cutter, resolve=_resolve(min_words), span=min_words, k=max(1, min_words // 3),
    )
    own = [F.col("row"), F.col("text").alias("original")] if carry else [F.col("id" if "id" in base.columns else "_key").alias("id")]
    chosen = base.select("_key", "text", *own)
    shape = T.StructType([*chosen.schema.fields[2:], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return in_chunks(spark, chosen, instances, found, _remove(keep, shape.names), shape, places=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark, table(spark, sf_dir, "documents"), min_words=20)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

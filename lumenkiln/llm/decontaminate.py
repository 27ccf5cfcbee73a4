"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._common import NORMAL, annotated, durable, keyed, others, table

#: Item words in one automaton (about 400 bytes each); larger benchmarks take several scans.
MAX_ITEM_WORDS = 400_000
_PATTERN = r"[a-z\x80-\x{10FFFF}A-Z0-9]+"
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BUILT: dict[str, tuple] = {}


def _words(raw: bytes | None) -> list[bytes]:
    return raw.translate(NORMAL).split() if raw else []


def _build(items: list[tuple[str, bytes]], window: int):
    """Automaton over windows as strings of one code point a word, the codes, and the items of each window."""
    codes: dict[bytes, str] = {}
    owners: dict[str, set[str]] = {}
    for item, raw in items:
        text = []
        for word in _words(raw):
            if word not in codes:
                n = len(codes) + 2  # code 1 stands for any word that no item has
                codes[word] = chr(n if n < 0xD800 else n + 0x800)
            text.append(codes[word])
        text = "".join(text)
        for j in range(max(1, len(text) - window + 1) if text else 0):
            owners.setdefault(text[j : j + window], set()).add(item)
    automaton = ahocorasick.Automaton()
    for phrase, who in owners.items():
        automaton.add_word(phrase, (len(phrase), tuple(who)))
    if owners:
        automaton.make_automaton()
    return automaton, codes, bool(owners)


def _merge(found) -> list[list[int]]:
    """Sorted disjoint ranges from ranges in the order of their ends."""
    runs: list[list[int]] = []
    for a, b in found:
        while runs and runs[-1][0] >= a:
            runs.pop()
        if runs and runs[-1][1] >= a:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def _scanner(shared, token: str, window: int):
    def work(texts: list[bytes | None]):
        if token not in _BUILT:
            _BUILT.clear()
            _BUILT[token] = _build(shared.value, window)
        automaton, codes, any_item = _BUILT[token]
        get = codes.get
        n_words, n_hit, items, spans, hits = [], [], [], [], []
        for raw in texts:
            words = _words(raw)
            n_words.append(len(words))
            found: set[str] = set()
            places: list[tuple[int, int]] = []
            if any_item and words:
                for end, (size, who) in automaton.iter("".join([get(w, "\x01") for w in words])):
                    found.update(who)
                    places.append((end - size + 1, end + 1))
            runs = _merge(places)
            n_hit.append(sum(b - a for a, b in runs))
            items.append(sorted(found))
            hits.append([{"a": a, "b": b} for a, b in runs])
            # normalising changes no byte's place, so words stand where they stood
            at = [m.span() for m in _WORD.finditer(raw.translate(NORMAL))] if runs else []
            spans.append([{"a": at[a][0], "b": at[b - 1][1]} for a, b in runs])
        return n_words, n_hit, items, spans, hits

    return work


def decontaminate(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", carry: bool = False, max_item_words: int = MAX_ITEM_WORDS,
) -> DataFrame:
    """Where texts hold ``window`` consecutive words of a benchmark item, or a whole shorter item.

    Words are runs of non-ASCII characters, letters and digits, A-Z lowered.  Returns id (with carry the input as ``row`` and ``text``),
    n_words, n_hit (words inside any occurrence), items (ids as strings, sorted as strings) and
    spans (byte ranges of the original text).  A null text has no words; null or wordless items
    have no windows, very long ones are cut into pieces that overlap by a window; a null item id counts as the empty string; repeated rows get equal results, empty tables no rows;
    other columns don't matter.  hits are the word ranges.  The items are broadcast; a benchmark of over
    max_item_words words is split by item, scanned in as many passes and put together by row.
    """
    ranges = "array<struct<a:int,b:int>>"
    ddl = f"n_words long, n_hit long, items array<string>, spans {ranges}, hits {ranges}"
    chosen = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = F.coalesce(F.regexp_count("text", F.lit(_PATTERN)), F.lit(0))
    words = chosen.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-words // max_item_words))
    if shards > 1:
        step = max(1, max_item_words // 4)
        pieces = F.when(size <= step + window, F.array("text")).otherwise(F.transform(
            F.sequence(F.lit(0), F.floor((size - window) / step).cast("int")),
            lambda i: F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_PATTERN), F.lit(0)), i * step + 1, F.lit(step + window - 1)), " "),
        ))
        chosen = chosen.select("item", F.explode(pieces).alias("text"))

    def scan(over: DataFrame, key: str, text: str, shard: int, keep: bool) -> DataFrame:
        items = chosen.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        shared = spark.sparkContext.broadcast([(r.item, (r.text or "").encode()) for r in items.collect()])
        return annotated(over, _scanner(shared, uuid.uuid4().hex, window), ddl, id_col=key, text_col=text, carry=keep)

    if shards == 1:
        return scan(docs, id_col, text_col, 0, carry)
    kept = others(docs, text_col) if carry else F.col(id_col).alias("id")
    base = docs.select(kept, F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    base = keyed(spark, base, "_id", "text", base.columns[0])
    each = [durable(spark, scan(base, "_key", "text", i, False), "scan") for i in range(shards)]
    both = reduce(DataFrame.unionByName, each).groupBy("id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        *[F.array_sort(F.flatten(F.collect_list(c)), lambda x, y: x["b"] - y["b"]).alias(c) for c in ("spans", "hits")],
    )

    def join_ranges(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                for c in ("spans", "hits"):
                    row[c] = [{"a": a, "b": b} for a, b in _merge((r["a"], r["b"]) for r in row[c])]
                row["n_hit"] = sum(r["b"] - r["a"] for r in row["hits"])
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    shape = T.StructType([T.StructField("id", T.LongType()), *T._parse_datatype_string(ddl).fields])
    arrow = to_arrow_schema(shape)
    done = both.mapInArrow(join_ranges, shape).withColumnRenamed("id", "_key")
    return base.join(done, "_key").select(*(["row", "text"] if carry else ["id"]), *[f.name for f in shape.fields[1:]])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )

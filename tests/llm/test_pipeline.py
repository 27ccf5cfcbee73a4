"""The pipeline's stages: columns, decisions, odd rows, and the whole run against a brute-force pipeline."""

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lumenkiln.llm import queries

from test_brute_force import naive_bayes

SF = "/root/testdata/sf0.001"


def test_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.write.parquet(str(tmp_path / name))
        seen = spark.read.parquet(str(tmp_path / name))
    tokens = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    run = corpus_pipeline.run(spark, SF)
    key = lambda frame: sorted(map(tuple, frame.select("doc_id", "n_tokens", "ids_sha256").collect()))
    assert key(tokens) == key(run) and 0 < seen.count() <= docs.count()


def test_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r.doc_id for r in queries.QUERIES["op8_decontaminate"](spark, SF).filter("contaminated").collect()}
    clean = corpus_pipeline.decontamination_stage(spark, docs, SF)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - bad
    odd = spark.createDataFrame([(1, None, None, "s", None), (2, "123 456", None, "s", 7), (3, docs.first().text, "en", "s", 1)], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.language_stage(spark, docs.filter("false").unionByName(odd).unionByName(docs.limit(50).withColumn("doc_id", docs.doc_id + 1000)), SF).filter("doc_id < 10").collect()] == [3]
    near = corpus_pipeline.near_dedup_stage(spark, docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 10_000)), SF)
    assert near.filter("doc_id >= 10000").count() == 0


def brute_force(rows, items):
    """{doc_id: (tokens, digest of ids)} of the rows (doc_id, text, lang) that the pipeline keeps, by the definitions."""
    known = naive_bayes(rows)
    docs = [(i, t) for i, t, _ in sorted(rows) if known[i][0] != "und" and known[i][1] >= 0.5]

    # near-duplicates: five words, similarity 0.8
    sets = {}
    for i, t in docs:
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    docs = [(i, t) for i, t in docs if root(i) == i]

    # passages of 20 words that stand earlier
    seen, left = set(), []
    for i, t in docs:
        words = t.encode().split()
        gone = np.zeros(len(words), bool)
        for j in range(len(words) - 19):
            key = tuple(words[j : j + 20])
            if key in seen:
                gone[j : j + 20] = True
            seen.add(key)
        if not gone.any():
            left.append((i, t))
        elif not gone.all():
            left.append((i, b" ".join(w for w, g in zip(words, gone) if not g).decode()))

    # ten words of a benchmark item, or a whole shorter one
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    normal = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = {tuple(w[j : j + 10]) for w in map(normal, items) for j in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = [(i, t) for i, t in left if not any(tuple(w[j : j + n]) in windows for w in [normal(t)] for n in sizes for j in range(len(w) - n + 1))]

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: library.encode_ordinary(t) for i, t in clean}
    return {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items()}


def test_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    want = brute_force(rows, items)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_odd_rows(spark):
    """An empty table, null and repeated ids, null texts and columns with clashing names and of unordered types, through all stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["row", "_key", "id", "ranges", "kept", "component_id", "n_words", "chunk"]
    odd = docs.limit(60).withColumns({n: F.lit(n) for n in names}).withColumns({"m": F.create_map(F.lit("k"), F.col("doc_id")), "doc_id": F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 7)})
    null = odd.limit(3).withColumns({"text": F.lit(None).cast("string")})
    for start in (odd.unionByName(null).unionByName(odd.limit(5)), odd.filter("false")):
        seen = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, seen, SF)
            assert out.columns == start.columns and [f.dataType for f in out.schema] == [f.dataType for f in start.schema], name
            kept = out.collect()
            assert {r.text for r in kept} <= {None} | {r.text for r in seen.collect()} or name == "substring_dedup"
            seen = out
        tokens = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
        assert len(tokens) == seen.count() and (len(tokens) > 0) == (start.count() > 0)

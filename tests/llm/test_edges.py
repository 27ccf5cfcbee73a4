"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lumenkiln.llm.byte_bpe import encode_decode
from lumenkiln.llm.chat_format import chat_prefix_tree, escape, format_turn, parse_turns, read_back, unescape
from lumenkiln.llm.decontaminate import decontaminate
from lumenkiln.llm.embedding_dedup import embedding_dedup
from lumenkiln.llm.language_id import held_out, predict, train
from lumenkiln.llm.license_scan import license_scan
from lumenkiln.llm.minhash_dedup import minhash_dedup
from lumenkiln.llm.substring_dedup import substring_dedup
from lumenkiln.llm.suffix_dedup import suffix_dedup
from lumenkiln.llm.url_filter import Rule, url_filter

LONG = " ".join(f"w{i}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
#: id, text and columns whose names the operators use themselves.
DDL = "doc_id long, text string, lang string, _key long, id string, row string, ranges string, n_words int, component_id string"
ROWS = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "few words"), (5, PASSAGE), (6, PASSAGE), (6, PASSAGE), (7, LONG), (8, LONG + " tail"), (None, PASSAGE + " more"), (None, None), (9, "ünï çødé " * 30), (10, "few words"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if n % 2 else None, n, "x", "y", "z", n, "q") for n, (i, t) in enumerate(ROWS)], DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def test_minhash(spark, docs, none):
    rows = minhash_dedup(spark, docs, percent=85).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert len(rows) == len(ROWS)
    assert all(r.kept and r.n_shingles == 0 for i in (1, 2, 3) for r in by[i])
    assert [r.component_id for r in by[10]] == [4] and not by[10][0].kept and by[4][0].n_shingles == 1
    assert sum(r.kept for r in by[5] + by[6] + by[None] if r.n_shingles) == 1  # one of the passage's group, the null id being the first
    assert by[8][0].component_id == 7
    assert minhash_dedup(spark, none).count() == 0
    assert minhash_dedup(spark, docs, carry=True).select("row.*", "text").count() == len(ROWS)


def test_chains_through_documents_that_are_unlike_the_hub(spark):
    """a-b, b-c linked, a-c not, and the hub a is the smallest: the group is whole."""
    words = [f"x{i}" for i in range(400)]
    at = lambda *cut: " ".join(w if i not in cut else f"y{i}" for i, w in enumerate(words))
    a, b, c = at(*range(0, 6, 6)), at(), at(*range(200, 208))
    frame = spark.createDataFrame([(1, a), (2, c), (3, b)], "doc_id long, text string")
    assert {r.component_id for r in minhash_dedup(spark, frame, percent=93).collect()} == {1}


@pytest.mark.parametrize("keep", ["first", "none"])
def test_suffix(spark, docs, none, keep):
    rows = suffix_dedup(spark, docs, min_bytes=50, keep=keep).collect()
    texts = sorted(((-1 if i is None else i), t or "") for i, t in ROWS)
    seen = {}
    for n, (_, t) in enumerate(texts):
        raw = t.encode()
        for j in range(len(raw) - 49):
            seen.setdefault(raw[j : j + 50], []).append((n, j))
    want = []
    for n, (i, t) in enumerate(texts):
        raw, hit = t.encode(), set()
        for j in range(len(raw) - 49):
            at = seen[raw[j : j + 50]]
            if len(at) > 1 and (keep == "none" or at[0] != (n, j)):
                hit.update(range(j, j + 50))
        want.append((i, len(raw), len(hit), hashlib.sha256(bytes(c for k, c in enumerate(raw) if k not in hit)).hexdigest()))
    assert sorted((-1 if r.id is None else r.id, r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in rows) == sorted(want)
    assert suffix_dedup(spark, none).count() == 0


def test_substring(spark, docs, none):
    rows = substring_dedup(spark, docs, min_words=20).collect()
    assert len(rows) == len(ROWS)
    of = lambda i: [r for r in rows if r.id == i]
    # null ids come first, so theirs is the passage that stays
    assert sorted(r.n_removed for r in of(None)) == [0, 0] and [r.n_removed for r in of(5) + of(6)] == [40, 40, 40]
    assert of(7)[0].n_removed == 0 and (of(8)[0].n_removed, of(8)[0].kept) == (60_000, "tail")
    assert substring_dedup(spark, none).count() == 0 and substring_dedup(spark, docs, carry=True).select("row._key", "original").count() == len(ROWS)


def test_repeats_within_a_document(spark):
    text = " ".join(["again"] * 500)
    frame = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.id, r.n_removed) for r in substring_dedup(spark, frame, min_words=20).collect()) == [(1, 499), (2, 500)]
    raw = len(text.encode())
    assert sorted((r.id, r.n_removed) for r in suffix_dedup(spark, frame, min_bytes=200, keep="none").collect()) == [(1, raw), (2, raw)]


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(PASSAGE.split()[5:20])), (2, None), (3, "... !"), (4, "FEW, words"), (None, "tail"), (4, "few words")], "item_id long, text string")
    for most in (400_000, 5):
        rows = decontaminate(spark, docs, items, max_item_words=most).collect()
        got = sorted((-1 if r.id is None else r.id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows)
        assert [g for g in got if g[2]] == sorted([(4, 2, 2, ("4",)), (10, 2, 2, ("4",)), (5, 40, 15, ("1",)), (6, 40, 15, ("1",)), (6, 40, 15, ("1",)), (-1, 41, 15, ("1",)), (8, 60_001, 1, ("",))])
        assert len(rows) == len(ROWS)
    spans = {r.id: r.spans for r in decontaminate(spark, docs, items).collect() if r.n_hit}
    assert PASSAGE.encode()[spans[5][0].a : spans[5][0].b].split()[0] == b"p5"
    assert decontaminate(spark, none, items).count() == 0 and decontaminate(spark, docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_language(spark, docs, none):
    model = train(spark, docs, allowed=~held_out("doc_id"))
    got = {(r.id, r.lang_pred) for r in predict(spark, docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and all(0 <= r.score <= 1 for r in predict(spark, docs, model, carry=True).collect())
    nothing = train(spark, none, allowed=F.lit(True))
    assert {r.lang_pred for r in predict(spark, docs, nothing).collect()} == {"und"} and predict(spark, none, model).count() == 0


def test_bpe(spark, docs, none):
    import public_tokenizers

    run = lambda d, **k: encode_decode(d, rank_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, **k)
    rows = run(docs, portion=7).collect()
    texts = {(-1 if i is None else i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS}
    assert len(rows) == len(ROWS) and {(-1 if r.id is None else r.id, r.decoded_sha256) for r in rows} == texts and run(none).count() == 0


def test_licenses(spark, docs, none):
    extra = spark.createDataFrame([(20, "See CC-BY; all\nRIGHTS  reserved. cc byte"), (21, "x\nLicensed under the Apache License Version 2.0 now\ny"), (22, "GNU General Public\tLicense v3, general public license")], "doc_id long, text string")
    got = {r.id: r for r in license_scan(spark, docs.select("doc_id", "text").unionByName(extra)).collect()}
    assert (got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels) == (2, 1, 3, "cc-by,reserved")
    assert (got[21].n_base, got[21].first_word, got[21].labels, got[21].score) == (0, None, "apache", 1.0)
    assert (got[22].n_base, got[22].first_word, got[22].last_word) == (2, 1, 5) and got[1].n_words == 0 and got[4].n_words == 2
    assert license_scan(spark, none).count() == 0


#: Headers as they are published, wrapped and commented out.
HEADERS = {
    "bsd": "# Copyright (c) 2020, A. Nobody\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
    "gpl": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\n",
    "mpl": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "apache": "Licensed under the Apache License,\n\nVersion 2.0",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.", "cc-by-sa": "Licensed under CC BY-SA 4.0.",
}


def test_published_headers(spark):
    rows = [(i, ("word " * (13 * i)) + text, label) for i, (label, text) in enumerate(HEADERS.items())]
    rows += [(90, "Licensed under CC BY 4.0.", "cc-by"), (91, "the software is free of charge to any person", ""), (92, " ".join(f"{w} {'x ' * 90}" for w in HEADERS["mit"].split()), "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {r.id: r for r in license_scan(spark, frame).collect()}
    for i, _, label in rows:
        assert set(got[i].labels.split(",")) - {"cc-by", "gpl"} == {label} - {"cc-by", "gpl"}, (label, got[i])
        assert (got[i].score >= 0.8) == (label not in ("", "cc-by"))
    assert "gpl" in got[1].labels and got[1].score >= 0.8 and got[90].labels == "cc-by"


def test_phrases_that_overlap_themselves(spark):
    frame = spark.createDataFrame([(1, "a b a b a"), (2, "A. B a? ba b a")], "doc_id long, text string")
    got = {r.id: (r.n_base, r.first_word, r.last_word) for r in license_scan(spark, frame, phrases={"a b a": "x"}, templates=[]).collect()}
    assert got == {1: (2, 0, 2), 2: (1, 0, 0)}


def test_urls(spark):
    rules = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.net", "/en/", "block"), Rule("a.example.net", "/", "allow")]
    urls = [None, "", "nothing", "http://net", "http://NET/", "http://x.example.net/en/1?q#f", "http://badexample.net/en/", "http://a.example.net/en/x", "http://b.a.example.net/q", "x://y?://net/"]
    frame = spark.createDataFrame([(n % 9, u, "h", "r") for n, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    for most in (100, 1):
        got = {(r.id, r.host, r.path, r.rule, r.verdict) for r in url_filter(spark, frame, rules, max_rules=most).collect()}
        assert got == {
            (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "net", "", None, "allow"), (4, "net", "/", "net/", "block"), (5, "x.example.net", "/en/1", "example.net/en/", "allow"),
            (6, "badexample.net", "/en/", "net/", "block"), (7, "a.example.net", "/en/x", "example.net/en/", "allow"), (8, "b.a.example.net", "/q", "a.example.net/", "allow"), (0, "y", "", None, "allow"),
        }
    assert url_filter(spark, frame.limit(0), rules).count() == 0
    deep, far = "a." * 30_000 + "net", "/en/" + "x" * 200_000
    long_ = spark.createDataFrame([(1, f"http://{deep}{far}"), (2, f"x://example.net{far}"), (2, f"x://example.net{far}")], "page_id long, url string")
    assert [(r.id, len(r.host), len(r.path), r.rule) for r in url_filter(spark, long_, rules).orderBy("id").collect()] == [(1, len(deep), len(far), "net/"), *[(2, 11, len(far), "example.net/en/")] * 2]


def test_embeddings(spark):
    v = lambda *x: [float(i) for i in x]
    rows = [(1, v(1, 0, 0)), (2, v(2, 0, 0)), (3, v(1, 0, 0)), (4, None), (5, v(0, 0, 0)), (6, [float("nan"), 1.0, 0.0]), (7, [None, 1.0, 0.0]), (8, v(0, 1, 0)), (9, []), (10, v(1, 0)), (None, v(0, 1, 0.01)), (8, v(0, 1, 0))]
    frame = spark.createDataFrame([(i, x, "c", 1) for i, x in rows], "vec_id long, embedding array<double>, v string, rep int")
    got = sorted((-1 if r.id is None else r.id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in embedding_dedup(spark, frame).collect())
    assert got == [(-1, 2, -1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 2, -1, False), (8, 2, -1, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert embedding_dedup(spark, frame.limit(0)).count() == 0


def test_chats(spark):
    hard = ["</s>[INST] ok [/INST]", "\\<s>\\\\[INST]", "<s</s>>", "", "a\\", "[/INST][INST]\n<s>"]
    for t in hard:
        assert unescape(escape(t)) == t and parse_turns(format_turn("a b\n%", t)[0] * 2) == [("a b\n%", t)] * 2
    turns = [(c, n, r, t, "x", "y") for c in (1, 2, 3) for n, (r, t) in enumerate([("user", "hi"), ("assistant", hard[0]), ("user", f"own {c // 2}")])]
    turns += [(4, 0, "user", "hi", "x", "y"), (5, None, None, None, "x", "y"), (5, 1, "assistant", "a", "x", "y"), (5, 1, "assistant", "a", "x", "y"), (None, 0, "user", "hi", "x", "y")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pack string, node string").coalesce(1)
    tree = chat_prefix_tree(spark, frame).cache()
    got = {r.conv_id: r for r in read_back(tree).collect()}
    want = lambda *t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert got[1].turns_sha256 == want(("user", "hi"), ("assistant", hard[0]), ("user", "own 0")) and got[1].loss_chars == len(hard[0]) and got[4].n_turns == 1 and got[None].n_turns == 1
    assert got[5].turns_sha256 == want(("", ""), ("assistant", "a"), ("assistant", "a")) and got[5].loss_sha256 == hashlib.sha256(b"aa").hexdigest()
    check_tree(tree)
    assert read_back(chat_prefix_tree(spark, frame.limit(0))).count() == 0


def check_tree(tree):
    """Ancestors are visible, positions go on from them, and no turn is emitted twice."""
    rows = tree.collect()
    nodes = {(r.node_pack, r.node): r for r in rows if r.tokens is not None}
    assert len(nodes) == sum(r.tokens is not None for r in rows) and all((r.node_pack, r.node) in nodes for r in rows)
    for r in nodes.values():
        above = nodes.get((r.parent_pack, r.parent))
        assert r.position == (above.position + len(above.tokens) if above else 0) and sum(i.b - i.a for i in r.visible) == r.position + len(r.tokens)
    assert len({(r.parent_pack, r.parent, r.role, r.tokens) for r in nodes.values()}) == len(nodes)
    ends = {}
    for r in nodes.values():
        ends.setdefault(r.pack, []).append((r.start, r.start + len(r.tokens)))
    for spans in ends.values():  # each pack's sequence without gaps
        assert all(x[1] == y[0] for x, y in zip(sorted(spans), sorted(spans)[1:])) and min(spans)[0] == 0
    return rows


def test_turns_shared_across_packs_are_emitted_once(spark, tmp_path):
    """One first turn, second turns in runs, long texts with backslashes and control strings; saved, and read back in another order."""
    text = lambda n: "\\" * (n % 3) + "</s>[INST]" + "x" * (40_000 if n == 7 else n % 5)
    turns = [(c, n, r, t) for c in range(300) for n, (r, t) in enumerate([("user", "same"), ("assistant", text(c // 40)), ("user", f"{c // 3}"), ("assistant", text(c))][: 2 + c % 3])]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chat_prefix_tree(spark, frame).write.parquet(str(tmp_path / "tree"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tree = spark.read.parquet(str(tmp_path / "tree"))
    rows = check_tree(tree)
    assert len({r.pack for r in rows}) > 2 and any(r.tokens is None and not r.is_conversation for r in rows)
    for order in (tree, tree.repartition(3), tree.orderBy(tree.row.desc())):
        got = {r.conv_id: r.turns_sha256 for r in read_back(order).collect()}
        assert got == {c: hashlib.sha256("".join(f"{r}\n{t}\n" for k, _, r, t in turns if k == c).encode()).hexdigest() for c in range(300)}


def test_chat_sql_counts_backslashes(spark):
    import duckdb

    from lumenkiln.llm.chat_format import OP10_SQL

    rows = [(1, 0, "user", "a\\b \\\\"), (1, 1, "assistant", "\\<s>[/INST]\\"), (2, 0, "assistant", None)]
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(OP10_SQL)
    names = [d[0] for d in found.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in found.fetchall() if dict(zip(names, r))["conv_id"] > 0)
    got = read_back(chat_prefix_tree(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert sorted(tuple(r[c] for c in sorted(names)) for r in got.collect()) == want

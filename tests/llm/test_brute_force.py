"""The queries against brute force, round trips and held-out accuracy at the smallest scale, and SQL where there is some."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenkiln.llm import queries
from lumenkiln.llm.byte_bpe import Encoder, Utf8Decoder, read_ranks
from lumenkiln.llm.substring_dedup import _resolve as resolve_words
from lumenkiln.llm.suffix_dedup import _resolve, longest_previous_factor, suffix_dedup, suffix_ranks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, text from documents order by 1").fetchall()


def result(spark, name, key=None):
    frame = queries.QUERIES[name](spark, SF)
    return {r[0]: r for r in frame.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in found.description)
    assert sorted(frame.columns) == columns
    have = Counter(tuple(r[c] for c in columns) for r in frame.collect())
    names = [d[0] for d in found.description]
    assert have == Counter(tuple(dict(zip(names, r))[c] for c in columns) for r in found.fetchall())


def test_op1(spark, texts):
    sets = {}
    for i, t in texts:
        w = t.encode().lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    label = {i: i for i in sets}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    got = result(spark, "op1_minhash_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}


def naive_bayes(rows):
    """(language, score) of every text by the definition: counts of hashed 1- to 3-grams, half a count added, priors with one."""
    low, masked = (1 << 32) - 1, defaultdict(Counter)
    by_lang = Counter()

    def grams(text):
        codes = [2, 2, *map(ord, text.lower()), 2, 2]
        for order in (1, 2, 3):
            for i in range(len(codes) - order + 1):
                h = codes[i] * 0x9E3779B1 & low
                for c in codes[i + 1 : i + order]:
                    h = (h * 0x85EBCA77 + c * 0x9E3779B1) & low
                h ^= h >> 15
                yield (h * 0xC2B2AE3D & low) >> 16

    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            by_lang[lang] += 1
            masked[lang].update(grams(text))
    out = {}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out[i] = ("und", 0.0)
            continue
        own, scores = Counter(grams(text)), {}
        for lang, n in sorted(by_lang.items()):
            total = sum(masked[lang].values()) + 0.5 * 65536
            scores[lang] = math.log(n + 1) - math.log(sum(by_lang.values()) + len(by_lang)) + sum(k * math.log((masked[lang][g] + 0.5) / total) for g, k in own.items())
        best = max(scores, key=lambda x: scores[x])
        out[i] = (best, 1 / sum(math.exp(s - scores[best]) for s in scores.values()))
    return out


def test_op1_in_small_deals(spark, monkeypatch):
    """Deals of a few sets give the same groups."""
    from lumenkiln.llm import minhash_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shared = " ".join(f"s{i}" for i in range(400))
    words = shared.split()
    # one hub that many are unlike, chains of like ones beside it, and words that all share
    more = [(1000 + i, " ".join([*words[:300], *(f"g{i // 4}x{k}" for k in range(60)), *(f"t{i}x{k}" for k in range(4))])) for i in range(80)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    told = []
    for codes in (100_000, 700):
        monkeypatch.setattr(minhash_dedup, "BLOCK_CODES", codes)
        told.append({(r.id, r.component_id) for r in minhash_dedup.minhash_dedup(spark, docs, percent=90).collect()})
    assert told[0] == told[1] and len({c for i, c in told[0] if i >= 1000}) == 20


def test_op2(spark, duck):
    rows = duck.execute("select doc_id, text, lang from documents").fetchall()
    want, langs = naive_bayes(rows), {i: lang for i, _, lang in rows}
    got = result(spark, "op2_language_id")
    assert {i: r.lang_pred for i, r in got.items()} == {i: w[0] for i, w in want.items()}
    assert all(abs(got[i].score - want[i][1]) < 1e-3 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in want)
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 20 and sum(got[i].lang_pred == langs[i] for i in held) >= 0.98 * len(held)


def test_op2_shards_and_ties(spark, monkeypatch):
    from lumenkiln.llm import language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    tie = spark.createDataFrame([(-1, "zqxw " * 40, "b2"), (-1, "zqxw " * 40, "a1"), (-2, "zqxw " * 9, None), (-3, None, None), (-4, "12 3", None)], docs.schema)
    docs = docs.unionByName(tie)
    told = []
    for most in (64, 2):
        monkeypatch.setattr(language_id, "SHARD_LANGUAGES", most)
        model = language_id.train(spark, docs, allowed=~language_id.held_out("doc_id") | (docs.doc_id < 0))
        assert len(model) == -(-len([x for s in model for x in s.languages]) // most)
        told.append({(r.id, r.lang_pred): round(r.score, 6) for r in language_id.predict(spark, docs, model).collect()})
        carried = language_id.predict(spark, docs, model, carry=True)
        assert carried.columns == ["row", "text", "lang_pred", "score"] and {(r.row.doc_id, r.lang_pred) for r in carried.collect()} == set(told[-1])
    assert told[0] == told[1] and {(-1, "a1"), (-2, "a1"), (-3, "und"), (-4, "und")} <= set(told[0])


def test_op3_and_op9(spark, texts):
    seen, done = Counter(), set()
    for _, t in texts:
        raw = t.encode()
        seen.update(raw[j : j + 200] for j in range(len(raw) - 199))
    three, nine = result(spark, "op3_suffix_dedup"), result(spark, "op9_substring_dedup")
    for i, t in texts:
        raw, words = t.encode(), t.encode().split()
        hit, out = np.zeros(len(raw), bool), np.zeros(len(words), bool)
        for j in range(len(raw) - 199):
            if seen[raw[j : j + 200]] > 1:
                hit[j : j + 200] = True
        for j in range(len(words) - 19):
            key = tuple(words[j : j + 20])
            if key in done:
                out[j : j + 20] = True
            done.add(key)
        kept = hashlib.sha256(bytes(c for c, h in zip(raw, hit) if not h)).hexdigest()
        assert (three[i].n_bytes, three[i].n_removed, three[i].kept_sha256) == (len(raw), hit.sum(), kept)
        assert three[i].n_spans == int((np.diff(np.concatenate(([0], hit.astype(int)))) == 1).sum())
        left = hashlib.sha256(b" ".join(w for w, o in zip(words, out) if not o)).hexdigest()
        assert (nine[i].n_words, nine[i].n_removed, nine[i].kept_sha256) == (len(words), out.sum(), left)


@pytest.fixture(scope="module")
def reference_encoder():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Encoder(read_ranks(path), public_tokenizers.PATTERN)


def test_op6(spark, texts, reference_encoder):
    theirs, _ = reference_encoder
    got = result(spark, "op6_byte_bpe")
    for i, t in texts:
        ids = theirs.encode_ordinary(t)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_states_pieces_and_streams(reference_encoder):
    theirs, ours = reference_encoder
    r = random.Random(4)
    tokens = [t for t in ours.transducer.ranks if len(t) > 1]
    for _ in range(4000):
        piece = b"".join(r.choice(tokens) for _ in range(r.randint(1, 4)))
        want = ours.transducer.merge(piece)
        assert ours.transducer.encode_piece(piece) == (want if piece not in ours.transducer.ranks else [ours.transducer.ranks[piece]])
    text = "naïve 東京 🙂 text\n\n  it's 12345" * 20
    ids = theirs.encode_ordinary(text)
    decoder = Utf8Decoder(ours.transducer.bytes_of)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(reference_encoder, text):
    theirs, ours = reference_encoder
    assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == theirs.encode_ordinary(text)


def test_op7(spark, duck):
    rows = duck.execute("select vec_id, embedding from embeddings order by 1").fetchall()
    x = np.array([v for _, v in rows], float)
    dots = x @ x.T
    near = dots / np.sqrt(np.outer(np.diag(dots), np.diag(dots))) >= 0.95
    np.fill_diagonal(near, False)
    got = result(spark, "op7_embedding_dedup")
    counts = np.array([got[i].n_links for i, _ in rows])
    assert (counts <= near.sum(axis=1)).all() and counts.sum() >= 0.99 * near.sum()


def test_op7_at_the_threshold_and_at_the_ends_of_doubles(spark):
    from lumenkiln.llm.embedding_dedup import embedding_dedup

    at = [[1.0, 0.0, 0.0], [3.0, 4.0, 0.0], [0.6, 0.8, 0.0]]
    wide = [[1e200, 1e199, 0.0], [2e200, 2.1e199, 0.0], [1e-200, 1e-201, 0.0], [0.0, 0.0, 1e-310]]
    frame = spark.createDataFrame(list(enumerate([*at, *wide])), "vec_id int, embedding array<double>")
    got = {r.id: r.n_links for r in embedding_dedup(spark, frame, cosine=0.6).collect()}
    assert got == {0: 5, 1: 5, 2: 5, 3: 5, 4: 5, 5: 5, 6: 0}
    exact = {r.id: r.n_links for r in embedding_dedup(spark, frame.filter("vec_id < 2"), cosine=0.6).collect()}
    assert exact == {0: 1, 1: 1}  # 3 / 5 is the threshold
    assert {r.n_links for r in embedding_dedup(spark, frame.filter("vec_id < 2"), cosine=0.6000001).collect()} == {0}


def test_op8(spark, duck, texts):
    import re

    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    windows = defaultdict(set)
    for i, t in duck.execute("select item_id, text from benchmark").fetchall():
        w = word.findall(t.translate(low))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    got = result(spark, "op8_decontaminate")
    for i, t in texts:
        w = word.findall(t.translate(low))
        hit, items = np.zeros(len(w), bool), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit[j : j + n] = True
                    items |= windows[tuple(w[j : j + n])]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), hit.sum(), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit.any()))


def thue_morse(n: int) -> bytes:
    return bytes(97 + bin(i).count("1") % 2 for i in range(n))


@settings(max_examples=80, deadline=None)
@given(st.one_of(st.binary(min_size=12, max_size=200), st.integers(12, 300).map(thue_morse)), st.integers(2, 13), st.randoms())
def test_longest_previous_factors(data, depth, random):
    if data[:1] != b"a":
        data = bytes(b % 3 for b in data)
    at = np.arange(len(data) - depth + 1)
    place = np.array(random.sample(range(len(at)), len(at)), np.int64)
    levels = suffix_ranks(np.frombuffer(data, np.uint8), depth)
    assert levels[-1][0] == depth
    length, source = longest_previous_factor(levels, at, place)

    def common(i, j):
        n = 0
        while n < depth and data[i + n] == data[j + n]:
            n += 1
        return n

    for i in at:
        want = max([common(i, j) for j in at if place[j] < place[i]], default=0)
        assert length[i] == want
        assert want == 0 or (place[source[i]] < place[i] and common(i, source[i]) == want)


def test_resolve_words():
    cuts = [b"a b c d", b"x a b c", b"a b c d"]
    recurs, first = resolve_words(3)(cuts, np.array([2, 2, 2]), np.repeat([7, 3, 5], 2), np.tile(np.arange(2), 3) + 10)
    assert recurs.tolist() == [True, True, False, True, True, True] and first.tolist() == [3, 5, 2, 3, 3, 5]


def test_resolve_tells_first_places():
    cuts = [b"abcdeab", b"xxabcde", b"abcdeab"]
    sizes = np.array([3, 3, 3])
    recurs, first = _resolve(5)(cuts, sizes, np.repeat([7, 3, 5], 3), np.tile(np.arange(3), 3) + 10)
    # abcde stands at (7, 10), (3, 12) and (5, 10); the other windows of the first and last cut at two places
    assert recurs.tolist() == [True, True, True, False, False, True, True, True, True] and first.tolist()[0::3] + [first[5]] == [5, 3, 5, 5] and first.tolist()[1:3] == [7, 8]


def test_thue_morse_texts(spark):
    """Texts on which polynomial hashes modulo a power of two collide."""
    a = thue_morse(4096)
    swapped = bytes(195 - c for c in a)
    rows = [(1, a[:1024]), (2, swapped[:1024]), (3, a[100:900]), (4, bytes(reversed(a[:1000])))]
    frame = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    seen = Counter(t[j : j + 200] for _, t in rows for j in range(len(t) - 199))
    for r in suffix_dedup(spark, frame, min_bytes=200, keep="none").collect():
        raw = dict(rows)[r.id]
        hit = np.zeros(len(raw), bool)
        for j in range(len(raw) - 199):
            if seen[raw[j : j + 200]] > 1:
                hit[j : j + 200] = True
        assert (r.n_removed, bytes(r.kept)) == (hit.sum(), bytes(c for c, h in zip(raw, hit) if not h))

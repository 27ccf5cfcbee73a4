"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import annotated, durable, table

#: Bits of a bucket, and languages in one broadcast matrix (16 MB); more are scored in several passes.
BUCKET_BITS, SHARD_LANGUAGES = 16, 64
ORDERS = (1, 2, 3)
#: Training texts per language at most (in expectation); rarer languages give all they have.
SAMPLE_PER_LANGUAGE = 4000
#: Language values that training accepts (their counts go to the driver); a column with more holds something else.
MAX_LANGUAGES = 100_000
UNKNOWN = "und"
_PIECE = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")
_MULT = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    h = codes * _MULT[0]
    for j in range(1, order):
        h = h[:-1] * _MULT[1] + codes[j:] * _MULT[0]
    h ^= h >> np.uint32(15)
    h *= _MULT[2]
    return h >> np.uint32(32 - BUCKET_BITS)


def _pieces(text: str):
    """The lower-cased text between two marks on each side, in overlapping pieces."""
    text = f"\x02\x02{text.lower()}\x02\x02"
    for at in range(0, max(1, len(text) - 2), _PIECE):
        yield np.frombuffer(text[at : at + _PIECE + 2].encode("utf-32-le", "replace"), np.uint32), at + _PIECE + 2 >= len(text)


def _grams(text: str):
    """Buckets of all n-grams, piece by piece; each n-gram once."""
    for codes, last in _pieces(text):
        for order in ORDERS:
            n = len(codes) - order + 1 if last else _PIECE
            yield _buckets(codes, order)[:n]


class Shard:
    """Some languages and their (buckets x languages) matrix of log probabilities."""

    def __init__(self, languages: list[str], counts: np.ndarray, prior: np.ndarray):
        self.languages, self.prior = languages, prior
        smooth = counts + 0.5
        self.matrix = (np.log(smooth) - np.log(smooth.sum(axis=0))).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """Log of prior times likelihood, one row a text: counts are sparse, so rows of the matrix are gathered and summed."""
        out = np.tile(self.prior, (len(texts), 1))
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if held:
                joined = np.concatenate([h for _, h in held])
                starts = np.cumsum([0] + [len(h) for _, h in held[:-1]])
                np.add.at(out, [i for i, _ in held], np.add.reduceat(self.matrix[joined], starts, axis=0, dtype=np.float64))

        for i, text in enumerate(texts):
            for grams in _grams(text):
                if len(grams):
                    held.append((i, grams))
                    size += len(grams)
                if size > _PIECE:
                    flush()
                    held, size = [], 0
        flush()
        return out


#: Shards of at most SHARD_LANGUAGES languages, in the order of their names.
Model = list[Shard]


def train(spark: SparkSession, docs: DataFrame, *, allowed: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from the rows where ``allowed`` holds and text and language are not null.

    Each language's rows are thinned to about sample_per_language by a hash of id and text, so copies of a text are taken one by
    one; priors count all rows.  No such rows, or an empty table, give a model without languages; rarer languages give all they have.
    """
    rows = docs.filter(allowed).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MAX_LANGUAGES} values")
    languages, total = sorted(sizes), sum(sizes.values())
    buckets = 1 << BUCKET_BITS

    def count(batches):
        import pandas as pd

        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["i"]):
                total = totals.setdefault(lang, np.zeros(buckets, np.int64))
                for grams in _grams(text):
                    total += np.bincount(grams, minlength=buckets)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"i": np.int32(lang), "bucket": used.astype(np.int32), "n": total[used]})

    model: Model = []
    for lo in range(0, len(languages), SHARD_LANGUAGES):
        own = languages[lo : lo + SHARD_LANGUAGES]
        share = spark.createDataFrame([(i, x, min(1.0, sample_per_language / sizes[x])) for i, x in enumerate(own)], "i int, lang string, share double")
        sample = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
        counted = sample.select("text", "i").mapInPandas(count, "i int, bucket int, n long").groupBy("i", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((buckets, len(own)))
        counts[counted["bucket"], counted["i"]] = counted["n"]
        model.append(Shard(own, counts, np.log(np.array([sizes[x] for x in own]) + 1.0) - np.log(total + len(languages))))
    return model


def predict(spark: SparkSession, docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Language and its posterior (0 to 1) for every whole text: id (with carry the input as ``row`` and ``text``), lang_pred, score.

    Texts that are null or without a letter, and all texts under a model without languages, get ``und`` and 0.
    Equal texts get equal results; null or repeated ids give a row each; an empty table gives no rows; ties go to the language first by name;
    long texts are read piece by piece; other columns are ignored or, with carry, kept in ``row`` whatever their names.
    A model of several shards takes a pass for each, so that a worker holds one matrix.
    """
    several = len(model) > 1
    ddl = "lang_pred string, best double, whole double"
    broadcast = spark.sparkContext.broadcast
    # the last shard's pass may drop the texts
    found = annotated(docs, _scorer(broadcast(model[0] if model else None)), ddl, id_col=id_col, text_col=text_col, carry=carry or several)
    for shard in model[1:]:
        more = annotated(durable(spark, found, "scored"), _scorer(broadcast(shard)), ddl, id_col="", text_col="text", carry=True)
        ahead = F.col("best") > F.col("row.best")
        # the sum of likelihoods, from the larger one's logarithm
        high, low = F.greatest("whole", "row.whole"), F.least("whole", "row.whole")
        whole = F.when(high == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))
        lang = F.when(ahead, F.col("lang_pred")).otherwise(F.col("row.lang_pred"))
        found = more.select(F.col("row.row").alias("row"), "text", lang.alias("lang_pred"), F.greatest("best", "row.best").alias("best"), whole.alias("whole"))
    score = F.when(F.col("best") == float("-inf"), 0.0).otherwise(F.least(F.lit(1.0), F.exp(F.col("best") - F.col("whole"))))
    own = [F.col("row"), F.col("text")] if carry else [F.col(f"row.`{id_col}`" if several else "id").alias("id")]
    return found.select(*own, "lang_pred", score.alias("score"))


def _scorer(shared):
    def work(texts: list[bytes | None]):
        shard = shared.value
        decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
        known = [i for i, t in enumerate(decoded) if _LETTER.search(t)]
        langs, best, whole = [UNKNOWN] * len(texts), [float("-inf")] * len(texts), [float("-inf")] * len(texts)
        if known and shard:
            found = shard.score([decoded[i] for i in known])
            for i, at, row, total in zip(known, found.argmax(axis=1).tolist(), found, np.logaddexp.reduce(found, axis=1)):
                langs[i], best[i], whole[i] = shard.languages[at], float(row[at]), float(total)
        return langs, best, whole

    return work


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, allowed=~held_out("doc_id"))
    out = predict(spark, docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")

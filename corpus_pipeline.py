"""The corpus pipeline: language ID, near-dedup, passage dedup, decontamination, tokenising.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next stage's docs.  All but the last return the columns of documents, whatever other columns they hold.  Empty tables
give empty tables; rows with null or repeated ids are documents of their own, nulls first.  The pipeline has
no SQL form, since its stages learn a model, hash and tokenise; the tests compare it with a brute-force pipeline.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkiln.llm._common import durable, restored, table
from lumenkiln.llm.byte_bpe import encode_decode
from lumenkiln.llm.decontaminate import decontaminate
from lumenkiln.llm.language_id import UNKNOWN, held_out, predict, train
from lumenkiln.llm.minhash_dedup import minhash_dedup
from lumenkiln.llm.substring_dedup import substring_dedup

#: Posterior below which a text's language counts as unknown.
MIN_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language can't be told: null, empty, without a letter, or with no language of MIN_SCORE.

    Where no row has a language to learn from, none can be told and all go.  Equal texts share their fate.
    """
    model = train(spark, docs, allowed=~held_out("doc_id"))
    found = predict(spark, docs, model, carry=True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*restored(docs, "text"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates (five words, similarity 0.8); of repeated ids the first by text.

    Null and empty texts are like no other and stay.
    """
    return minhash_dedup(spark, docs, shingle_words=5, percent=80, carry=True).filter("kept").select(*restored(docs, "text"))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words covered by a 20-word passage that stands earlier; texts without such words stay as they are.

    A text of which nothing is left goes; null, empty and shorter texts stay.  n_chars follows the text.
    """
    cut = substring_dedup(spark, docs, min_words=20, carry=True)
    cut = cut.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("original")))
    out = cut.filter("n_removed = 0 or n_removed < n_words").select(*restored(docs, "text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item; null and empty texts hold none.  An empty benchmark drops nothing."""
    found = decontaminate(spark, docs, table(spark, sf_dir, "benchmark"), window=10, carry=True)
    return found.filter("n_hit = 0").select(*restored(docs, "text"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256.  Null and empty texts have no tokens."""
    out = encode_decode(docs, rank_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern=public_tokenizers.PATTERN, carry=True)
    return out.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", passage_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

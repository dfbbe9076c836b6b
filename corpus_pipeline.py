"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet
to the shared folder and read again as the next one's docs. All but the last keep the
columns of documents; all keep rows that they have nothing against, null ids included.

1. language_id: documents without a language (null text, no letter) go.
2. simhash_near_dedup: of every near-duplicate component one document stays, the one
   with the smallest doc_id.
3. suffix_array_dedup: every string of 400 bytes that occurs twice, and every passage of
   over 50 words that three or more documents hold, is cut out of all texts; n_chars
   follows; documents of which nothing but white space is left go.
4. benchmark_decontamination: documents that hold a benchmark item go.
5. byte_level_bpe: the ids of every document, and whether they decode to its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import bpe, decontaminate, langid, queries, repeats, simhash
from evalspark.llm.common import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, queries.language_model(docs))
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_group(docs, shingle=3)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = repeats.without_repeats(docs, length=400, words=51)
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode_and_decode(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same = F.col("decoded").eqNullSafe(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return encoded.select(*(c for c in docs.columns if c != "text"), F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [(f.__name__, f) for f in (language_id, simhash_near_dedup, suffix_array_dedup, benchmark_decontamination, byte_level_bpe)]
# SimHash components and BPE ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""One registered query per corpus operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversations, cuckoo, decontaminate, html_text, langid, repeats, simhash, token_files, topk, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int):
    """crc32 of the document's id, as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def language_model(docs: DataFrame) -> langid.Model:
    """The model of the query and the pipeline: learned from the rows whose remainder is not 2."""
    return langid.fit(docs.where(remainder(4) != 2), langid.sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model")))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op2_simple8b_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op3_recursive_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_and_decode(docs, tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@query("op4_template_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op5_suffix_array_repeats")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_report(table(spark, sf_dir, "documents"), length=400)


@query("op6_norm_bucketed_topk")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op7_golay_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


@query("op8_weak_supervision_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), remainder(3) != 1)
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op9_layout_aware_html")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.with_text(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


@query("op10_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


@query("op12_cuckoo_exact_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


ORACLE: dict[str, str] = {"op4_template_decontamination": decontaminate.oracle(), "op6_norm_bucketed_topk": topk.oracle(), "op10_url_filter": url_filters.oracle(), "op12_cuckoo_exact_dedup": cuckoo.oracle()}


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}

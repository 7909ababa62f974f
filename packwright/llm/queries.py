"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm.common import held_out
from packwright.llm.conversations import repaired_conversations
from packwright.llm.decontaminate import contamination
from packwright.llm.importance import importance_resample
from packwright.llm.langid import fit_language_net, identify_languages, teaching_rows
from packwright.llm.licenses import license_scan
from packwright.llm.mixing import placed_words
from packwright.llm.ngram_join import jaccard_components
from packwright.llm.pii import personal_data, pii_digest
from packwright.llm.quality import fit_quality, score_quality
from packwright.llm.secrets import secret_digest, secret_scan
from packwright.llm.token_counts import length_histogram, suffix_sums
from packwright.llm.topk import top_inner_products
from packwright.llm.url_filter import url_verdicts

#: Where the public vocabularies lie.
TOKENIZERS = "/opt/tokenizers"
#: From this score on a document counts as good.
GOOD = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_words(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = fit_language_net(teaching_rows(docs))
    return identify_languages(docs, net).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = length_histogram(_table(spark, sf_dir, "documents"), f"file://{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return suffix_sums(histogram)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secret_scan(_table(spark, sf_dir, "documents")))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(personal_data(_table(spark, sf_dir, "documents")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(_table(spark, sf_dir, "conversations"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_verdicts(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_source_mixing,
        op3_language_id,
        op4_ngram_jaccard_join,
        op5_token_counts,
        op6_quality_classifier,
        op7_exact_topk,
        op8_secret_scans,
        op9_license_scans,
        op10_pii,
        op11_conversation_repair,
        op12_importance_resampling,
        op13_url_filters,
    )
}

"""A corpus pipeline: quality, near duplicates, benchmark decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; the
runner writes it as Parquet and reads it again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm.common import released, shared_folder, written
from packwright.llm.decontaminate import contamination
from packwright.llm.mixing import placed_words
from packwright.llm.ngram_join import jaccard_components
from packwright.llm.pii import personal_data, redacted
from packwright.llm.quality import fit_quality, score_quality

#: From this score on a document counts as good.
GOOD = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; its labels are the table's.

    Null and empty texts get the score of the bias and stay or go by it; very long texts are scored whole; repeated
    rows and ties share their score; all rows stay where the labels lack a class; an empty table stays empty; columns
    named like a result stay as they are.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model, column="_pw_quality")
    return scored.where(F.col("_pw_quality") >= GOOD).select(*docs.columns) if model else docs


def _same_row() -> Column:
    """Whether a document is the one that _pw_doc and _pw_mark (its text's hash) name; null ids match null ids."""
    return F.col("doc_id").eqNullSafe(F.col("_pw_doc")) & (F.xxhash64("text") == F.col("_pw_mark"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; texts without words all stay.

    Near duplicates share at least 0.8 of their distinct five-word shingles. The row with the smallest id stays, null
    last, then the one with the least hash of its text. Rows are told apart by id and text: rows that share an id, or
    have none, go only if their own texts are linked; of rows equal in both one stays. Very long texts are compared
    whole; an empty table stays empty; further columns, whatever their names, only travel along.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_pw_key"))
    found = jaccard_components(rows, size=5, percent=80, tie_col="_pw_key").where("n_shingles > 0")
    pairs = found.groupBy(F.col("doc_id").alias("_pw_doc"), F.col("_pw_key").alias("_pw_mark"))
    marks = pairs.agg(F.max("_pw_first").alias("_pw_stays"), F.count(F.lit(1)).alias("_pw_rows"))
    marks = written(marks.where(~F.col("_pw_stays") | (F.col("_pw_rows") > 1)).select("_pw_doc", "_pw_mark", "_pw_stays"))
    released(spark)
    joined = docs.join(marks, _same_row(), "left")
    repeated = joined.where("_pw_stays").dropDuplicates(["_pw_doc", "_pw_mark"])
    return joined.where("_pw_stays is null").unionByName(repeated).select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none; very long texts are searched whole; rows are judged by id and text, so repeated
    rows and null ids fare alike; without items, or rows, nothing goes; further columns only travel along.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = found.where("contaminated").select(F.col("doc_id").alias("_pw_doc"), F.col("_pw_key").alias("_pw_mark")).distinct()
    return docs.join(dirty, _same_row(), "left_anti").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind in brackets; n_chars follows the text.

    Null and empty texts stay; very long texts are searched whole; overlapping spans merge; repeated rows and null ids
    fare alike; an empty table stays empty; further columns, whatever their names, only travel along.
    """
    found = personal_data(docs)
    spans = found.where(F.size("all") > 0).select(F.col("doc_id").alias("_pw_doc"), F.col("_pw_key"), F.col("all").alias("_pw_all"))
    spans = spans.dropDuplicates(["_pw_doc", "_pw_key"])
    same = F.col("doc_id").eqNullSafe(F.col("_pw_doc")) & (F.xxhash64("text") == F.col("_pw_key"))
    joined = docs.join(spans, same, "left")
    text = F.when(F.col("_pw_all").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("_pw_all")))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("_pw_all").isNull(), F.col("n_chars")).otherwise(length))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it and the output shards that get them.

    Null and empty texts have no words; null sources are one source; very long texts are one row; repeated rows each
    count; ties are ordered as drawn_words says; an empty table gives no rows.
    """
    return placed_words(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
]

#: The classifier and the boosted trees have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written under the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/packwright/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs

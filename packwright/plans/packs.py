"""Packs: Parquet folders of docs, code or configuration tables with a manifest beside them."""

from __future__ import annotations

import json
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import fold, hash_id
from packwright.operators import fts

#: Columns of a docs pack that full-text search reads.
INDEXED = ["name", "payload"]


def numbered(docs: DataFrame) -> DataFrame:
    """docs with doc_id, a digest of what identifies a row, and folded keys for exact lookups."""
    key = hash_id(F.col("domain"), F.col("name"), F.col("topic_path"), F.col("version"), F.sha2("payload", 256))
    return docs.withColumn("doc_id", key).withColumn("name_key", fold("name")).withColumn("path_key", fold("topic_path"))


def write_docs(docs: list[DataFrame], path: str, extra: dict | None = None) -> dict:
    """A docs pack: partitioned by domain, sorted by folded name so that row groups can be skipped. Returns its manifest."""
    began = time.time()
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [numbered(d) for d in docs])
    rows = rows.repartitionByRange("domain", "name_key").sortWithinPartitions("domain", "name_key")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("domain").parquet(f"{path}/docs")
    saved = rows.sparkSession.read.parquet(f"{path}/docs")
    counts = {r["domain"]: r["n"] for r in saved.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    versions = [r["v"] for r in saved.select(F.explode("versions").alias("v")).distinct().orderBy("v").collect()]
    totals = write_index(saved, path)
    return write_manifest(saved.sparkSession, path, {"format": "packwright_docs_v1", "text_index": totals, "domain_counts": counts, "versions_seen": versions, "duration_sec": round(time.time() - began, 3), **(extra or {})})


def write_index(docs: DataFrame, path: str) -> dict:
    """The text index of a docs pack: postings by ranges of terms, lengths, and the totals that ranking needs."""
    fts.write_postings(fts.postings(docs, "doc_id", INDEXED), f"{path}/postings")
    lengths = fts.document_lengths(docs, "doc_id", INDEXED)
    lengths.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/lengths")
    found = fts.corpus_stats(docs.sparkSession.read.parquet(f"{path}/lengths")).first()
    return {"n_docs": found["n_docs"], "avg_len": found["avg_len"]}


def write_vectors(vectors: DataFrame, path: str) -> dict:
    """Adds (doc_id, vector) rows to a docs pack, so that its searches may blend in nearness; rows of no document are left out."""
    spark = vectors.sparkSession
    known = table(spark, path, "docs").select("doc_id")
    vectors.select("doc_id", "vector").join(known, "doc_id", "left_semi").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
    manifest = read_manifest(spark, path)
    return write_manifest(spark, path, manifest | {"tables": sorted({*manifest.get("tables", []), "vectors"})})


def write_tables(tables: dict[str, DataFrame], path: str, kind: str, extra: dict | None = None) -> dict:
    """A pack of several tables (code, configuration, metadata) with row counts in its manifest."""
    began, counts = time.time(), {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    spark = next(iter(tables.values())).sparkSession
    return write_manifest(spark, path, {"format": f"packwright_{kind}_v1", "rows": counts, "duration_sec": round(time.time() - began, 3), **(extra or {})})


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> dict:
    """One JSON row beside the tables, in whatever store the path is."""
    text = json.dumps(manifest, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def config_stats(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per entry type: entries, bytes and compressed bytes."""
    joined = entries.join(blobs.select("rel_path", "blob_size"), "rel_path", "left")
    return joined.groupBy("entry_type").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.coalesce(F.sum("blob_size"), F.lit(0)).alias("blob_size")
    )


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

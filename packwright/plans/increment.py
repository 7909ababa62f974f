"""Docs packs that follow their source: an update reads changed files only and adds a generation of rows.

Rows of docs, postings and lengths carry the generation that wrote them. An update appends rows of changed and new files
and lists what they replace as dead; the manifest names the generations that count, so rows of an update that failed half way are never
seen. ``compacted`` writes the living rows as one generation.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.operators import fts
from packwright.plans import packs
from packwright.plans.shared import written
from packwright.sources.listing import listing, matches, with_content

TRACKED = ("docs", "postings", "lengths")
_SOURCE = ["rel_path", "length", "modified"]
#: Makes pack rows of files (rel_path, length, modified, content); topic_path must be the file's path.
Maker = Callable[[DataFrame], DataFrame]


def _put(df: DataFrame, generation: int):
    """A writer of rows as one generation; the first one replaces what is there."""
    stamped = df.withColumn("generation", F.lit(generation).cast("long"))
    return stamped.write.mode("append" if generation else "overwrite").option("compression", "zstd")


def _add(rows: DataFrame, path: str, generation: int) -> None:
    """Writes numbered rows and their part of the text index as one generation."""
    ordered = rows.repartitionByRange("domain", "name_key").sortWithinPartitions("domain", "name_key")
    _put(ordered, generation).partitionBy("domain").parquet(f"{path}/docs")
    index = fts.postings(rows, "doc_id", packs.INDEXED).repartitionByRange("term").sortWithinPartitions("term", "doc_id")
    _put(index, generation).parquet(f"{path}/postings")
    _put(fts.document_lengths(rows, "doc_id", packs.INDEXED), generation).parquet(f"{path}/lengths")


def _end(paths: DataFrame, docs: DataFrame, path: str, generation: int) -> None:
    """Lists paths (rel_path) and rows (doc_id) that end with a generation."""
    _put(paths.select("rel_path"), generation).parquet(f"{path}/dead_rel_path")
    _put(docs.select("doc_id"), generation).parquet(f"{path}/dead_doc_id")


def live(spark: SparkSession, path: str, name: str, manifest: dict | None = None) -> DataFrame:
    """A pack's table; of a tracked pack the rows that are neither dead nor of a generation that doesn't count."""
    manifest = packs.read_manifest(spark, path) if manifest is None else manifest
    rows = packs.table(spark, path, name)
    if "generations" not in manifest or name not in (*TRACKED, "sources"):
        return rows
    counted = manifest["generations"]
    rows = rows.where(F.col("generation").isin(counted))
    if len(counted) == 1:
        return rows
    key = "rel_path" if name == "sources" else "doc_id"
    dead = packs.table(spark, path, f"dead_{key}").where(F.col("generation").isin(counted)).select(F.col(key).alias("_key"), F.col("generation").alias("_since"))
    return rows.join(dead, (F.col(key) == F.col("_key")) & (F.col("generation") < F.col("_since")), "left_anti")


def _finish(spark: SparkSession, path: str, generations: list[int], began: float, extra: dict) -> dict:
    manifest = {"format": "packwright_docs_v1", "generations": generations}
    docs = live(spark, path, "docs", manifest)
    counts = {r["domain"]: r["n"] for r in docs.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a domain
    found = fts.corpus_stats(live(spark, path, "lengths", manifest)).first()
    seen = [r["v"] for r in docs.select(F.explode("versions").alias("v")).distinct().orderBy("v").collect()]
    totals = {"n_docs": found["n_docs"], "avg_len": found["avg_len"]}
    return packs.write_manifest(spark, path, manifest | {"text_index": totals, "domain_counts": counts, "versions_seen": seen, "duration_sec": round(time.time() - began, 3), **extra})


def build(spark: SparkSession, root: str, pattern: str, make: Maker, path: str) -> dict:
    """A tracked pack of all files of a folder that fit a pattern."""
    began = time.time()
    now = written(listing(spark, root).where(~F.col("is_dir") & matches(F.col("rel_path"), pattern)).select(*_SOURCE))
    rows = written(packs.numbered(make(with_content(now.withColumn("is_dir", F.lit(False)), root))))
    _add(rows, path, 0)
    _put(now, 0).parquet(f"{path}/sources")
    _end(now.limit(0), rows.limit(0), path, 0)
    return _finish(spark, path, [0], began, {"files_read": now.count()})


def update(spark: SparkSession, root: str, pattern: str, make: Maker, path: str) -> dict:
    """Brings a tracked pack up to its folder: only files whose size or time is new are read; rows of changed and gone files die.

    Nothing is rewritten: new rows are appended and dead ones listed. An unchanged folder changes nothing.
    """
    began, manifest = time.time(), packs.read_manifest(spark, path)
    known = live(spark, path, "sources", manifest).select(*_SOURCE)
    now = written(listing(spark, root).where(~F.col("is_dir") & matches(F.col("rel_path"), pattern)).select(*_SOURCE))
    changed = written(now.join(known, _SOURCE, "left_anti"))
    stale = written(known.join(now, _SOURCE, "left_anti").select("rel_path"))
    n = changed.count()
    if not n and stale.isEmpty():
        return manifest | {"files_read": 0}
    generation = max(time.time_ns() // 1_000_000, max(manifest["generations"]) + 1)
    docs = live(spark, path, "docs", manifest)
    ended = written(docs.join(stale, docs["topic_path"] == stale["rel_path"], "left_semi").select("doc_id"))
    _add(written(packs.numbered(make(with_content(changed.withColumn("is_dir", F.lit(False)), root)))), path, generation)
    _put(changed, generation).parquet(f"{path}/sources")
    _end(stale, ended, path, generation)
    extra = {k: v for k, v in manifest.items() if k not in ("format", "generations", "text_index", "domain_counts", "versions_seen", "duration_sec")}
    return _finish(spark, path, [*manifest["generations"], generation], began, extra | {"files_read": n})


def compacted(spark: SparkSession, path: str, out: str) -> dict:
    """The same pack with its living rows only, as one generation, in another folder."""
    began, manifest = time.time(), packs.read_manifest(spark, path)
    living = {name: live(spark, path, name, manifest).drop("generation") for name in (*TRACKED, "sources")}
    docs, postings = living["docs"], living["postings"]
    _put(docs.repartitionByRange("domain", "name_key").sortWithinPartitions("domain", "name_key"), 0).partitionBy("domain").parquet(f"{out}/docs")
    _put(postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id"), 0).parquet(f"{out}/postings")
    for name in ("lengths", "sources"):
        _put(living[name], 0).parquet(f"{out}/{name}")
    _end(living["sources"].limit(0), docs.limit(0), out, 0)
    return _finish(spark, out, [0], began, {"files_read": 0})

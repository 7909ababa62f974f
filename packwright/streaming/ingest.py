"""Incremental ingest: new records stream in and are merged into a docs table by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.operators.merge import merge_by_content


def stream_records(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def merge_into(records: DataFrame, out: str, checkpoint: str, *, language: str, content: list[str], version: str, order: str, suffix: str):
    """Starts a query that keeps ``out`` a sequence of tables, each the merge of the last one and a batch.

    A batch writes a folder of its own number and points to it last, so a batch that runs twice gives the same table.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        before = latest(spark, out, number - 1)
        wanted = [language, *content, version, order]
        rows = df.select(*wanted)
        if before is not None:
            rows = rows.unionByName(before.select(language, *content, F.explode_outer("versions").alias(version), order))
        merged = merge_by_content(rows, language=language, content=content, version=version, order=order, suffix=suffix)
        merged.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, number: int) -> DataFrame | None:
    """The table as of a batch, or None before the first."""
    return spark.read.parquet(f"{out}/batch={number}") if number >= 0 else None


def windowed_counts(events: DataFrame, time: str, kind: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per window and kind of a stream or a table; rows later than the watermark don't count in a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, every).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")

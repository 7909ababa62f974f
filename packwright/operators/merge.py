"""Merging equal records across versions, first and last per key, result deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.functions.text import hash_id, newest_first, normalized, once, version_key


def content_hash(*cols: Column | str) -> Column:
    """A digest of the normalised columns, each with its length before it, so that no two rows run together."""
    parts = []
    for c in cols:
        t = normalized(c)
        parts += [F.length(t).cast("string"), t]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def merge_by_content(records: DataFrame, *, language: str, content: list[str], version: str, order: str, suffix: str) -> DataFrame:
    """One row per (language, content): the last record by ``order``, its versions united, newest first, and a new id.

    Aggregates only: versions are few per content, however many records share it, because the set is built
    from partial sets before the shuffle.
    """
    keyed = records.withColumn("content_hash", content_hash(*content)).withColumn("_lang", F.coalesce(F.col(language), F.lit("")))
    kept = [c for c in records.columns if c not in (version, language)]
    merged = keyed.groupBy("_lang", "content_hash").agg(
        F.max_by(F.struct(*kept), F.col(order)).alias("_last"), F.collect_set(version).alias("_versions")
    )
    merged = merged.withColumn("versions", newest_first(F.col("_versions")))
    return merged.select(
        hash_id(F.lit(suffix), F.col("_lang"), F.col("content_hash")).alias("id"),
        F.col("_lang").alias(language),
        "content_hash",
        "versions",
        F.get("versions", F.lit(0)).alias(version),
        *[F.col(f"_last.{c}").alias(c) for c in kept],
    )


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; ranking stops at one row per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def latest_per_path(df: DataFrame, path: str, version: str) -> DataFrame:
    """The row of the greatest version of each path."""
    last = df.groupBy(path).agg(F.max_by(F.struct(*df.columns), F.struct(version_key(F.col(version)), F.col(version))).alias("_row"))
    return last.select("_row.*")


def distinct_results(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_row")).select("_row.*")


def distinct_in_order(values: Column, ignore_case: bool = True) -> Column:
    """Distinct array members in their order, the first spelling kept.

    Sorted by folded member and place, the first of each run of equals is kept, and those are sorted by place again:
    n log n steps for n members.
    """
    if not ignore_case:
        return F.array_distinct(values)
    placed = F.transform(values, lambda v, i: F.struct(F.lower(v).alias("key"), i.alias("at"), v.alias("value")))

    def firsts(row: Column) -> Column:
        # get() at -1 is null: the first has none before it, and a null key comes first
        return F.filter(row, lambda x, i: (i == 0) | ~x["key"].eqNullSafe(F.get(row, i - 1)["key"]))

    kept = F.transform(once(F.sort_array(placed), firsts), lambda x: F.struct(x["at"], x["value"]))
    return F.transform(F.sort_array(kept), lambda x: x["value"])

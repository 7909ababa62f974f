"""Platform packs: pages of help to merged records, their tables and searchable rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.operators import merge
from packwright.plans import packs
from packwright.plans.shared import written
from packwright.sources import api_records, records

#: Columns that pack rows are made of; a table that lacks one has nulls there.
PARTS = ("name", "object_name", "member_name", "title", "summary", "description", "signature", "syntax", "purpose", "returns", "exceptions", "text")
TABLES = ("members", "objects", "examples", "links", "topics")


def merged(rows: DataFrame, suffix: str) -> DataFrame:
    """Records that differ in nothing but version and id as one, with all their versions, newest first."""
    told = [c for c in rows.columns if c not in ("id", "version")]
    whole = rows.withColumns({"_all": F.to_json(F.struct(*told)), "_order": F.concat_ws("|", "version", "topic_path")})
    made = merge.merge_by_content(whole.drop("id"), language="language", content=["_all"], version="version", order="_order", suffix=suffix)
    return made.drop("_all", "_order")


def shaped(rows: DataFrame) -> DataFrame:
    missing = [c for c in PARTS if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing})


def platform_tables(topics: DataFrame) -> dict[str, DataFrame]:
    """The tables of a pack from pages of any number of versions and books; pages are parsed once and kept."""
    rows = written(api_records.with_stubs(api_records.with_surface(api_records.records(topics))))
    of = {role: rows.where(F.col("role") == role).drop("role", "example") for role in ("member", "object", "topic")}
    return {
        "members": merged(of["member"].drop("object_name"), "member"), "objects": merged(of["object"].drop("owner_name", "member_name"), "object"),
        "examples": merged(api_records.examples(rows), "example"), "links": api_records.relations(rows),
        "topics": merged(of["topic"].where("description <> ''").drop("owner_name", "member_name", "object_name"), "topic"),
    }


def build_platform(sources: list[DataFrame], out: str) -> dict:
    """A platform pack of pages (``help_topics``): five tables, and searchable rows of each of them."""
    spark = sources[0].sparkSession
    for name, df in platform_tables(reduce(DataFrame.unionByName, sources)).items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}")
    saved = {name: packs.table(spark, out, name) for name in TABLES}
    told = F.concat_ws(" -> ", "source_full_name", F.substring("target_name", 1, 200))
    edges = saved["links"].select(F.col("source_full_name").alias("full_name"), told.alias("text"), F.lit("").alias("topic_path"), F.lit(None).cast("string").alias("version"), "versions")
    above = F.array_join("breadcrumb", " > ")
    articles = saved["topics"].withColumn("text", F.concat_ws("\n", F.nullif(above, F.lit("")), F.nullif("book_label", F.lit(""))))
    docs = [
        records.help_docs(shaped(saved["members"]), "api_members"), records.help_docs(shaped(saved["objects"]), "api_objects"),
        records.help_docs(shaped(saved["examples"]), "api_examples", extra=("code",)), records.help_docs(shaped(edges), "api_links"),
        records.help_docs(shaped(articles), "api_topics"),
    ]
    return packs.write_docs(docs, out, {"tables": list(TABLES)})

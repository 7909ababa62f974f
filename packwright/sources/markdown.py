"""Markdown standards as pack rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.paths import file_name, stem
from packwright.functions.text import compact, strip
from packwright.sources.files import decoded


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?s)\A---\n.*?\n---\n+", "")


def title_and_description(text: Column, fallback: Column) -> Column:
    """struct(title, description): the first heading and the first paragraph that is no heading."""
    body = without_front_matter(text)
    heading = F.filter(F.transform(F.split(body, "\n"), lambda line: strip(line)), lambda line: line.startswith("# "))
    title = F.coalesce(F.nullif(strip(F.substring(F.get(heading, F.lit(0)), 3, 10_000)), F.lit("")), fallback)
    parts = F.filter(F.transform(F.split(body, "\n\n"), lambda p: compact(p, 500)), lambda p: (p != "") & ~p.startswith("#"))
    return F.struct(title.alias("title"), F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("description"))


def standards(files: DataFrame, version: str, most: int = 4000) -> DataFrame:
    """Pack rows of Markdown files; names with a leading underscore, empty and non-UTF-8 files are left out."""
    rows = files.where(F.col("rel_path").endswith(".md") & ~file_name(F.col("rel_path")).startswith("_")).withColumn("_d", decoded("content"))
    rows = rows.where((F.col("_d.encoding") == "utf-8") & (strip(F.col("_d.text")) != ""))
    both = title_and_description(F.col("_d.text"), stem(F.col("rel_path")))
    return rows.select(
        F.lit("standards").alias("domain"), both["title"].alias("name"), F.col("rel_path").alias("topic_path"), F.lit(version).alias("version"),
        F.array(F.lit(version)).alias("versions"), compact(F.concat_ws(" ", both["description"], without_front_matter(F.col("_d.text"))), most).alias("payload"),
    )


def sections(text: Column) -> Column:
    """array<struct<heading, body>> of level-two sections; marks inside fenced code don't count.

    Fences split the text into plain and code parts in turn; hashes at line starts are masked in code parts.
    """
    parts = F.split(F.coalesce(text, F.lit("")), "(?m)(?=^```)")
    masked = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, "(?m)^## ", "\u0001")).otherwise(p))
    pieces = F.split(F.array_join(masked, ""), "(?m)^## ")
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            strip(F.substring_index(p, "\n", 1)).alias("heading"),
            strip(F.replace(F.regexp_replace(p, r"\A[^\n]*\n?", ""), F.lit("\u0001"), F.lit("## "))).alias("body"),
        ),
    )

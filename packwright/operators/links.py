"""Links: extraction from pages, resolution against topics, the edges of a knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.text import hash_id, squeezed


def html_links(html: Column) -> Column:
    """Distinct struct(href, text) of the anchors of a page, in order."""
    anchors = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>"""), F.lit(0))
    one = lambda a: F.struct(
        F.regexp_extract(a, r'(?is)href="([^"]*)"', 1).alias("href"),
        squeezed(F.regexp_replace(F.regexp_replace(a, r"(?is)^<a\s[^>]*>|</a>$", ""), "<[^>]*>", "")).alias("text"),
    )
    return F.array_distinct(F.transform(anchors, one))


def markdown_links(text: Column) -> Column:
    """Distinct struct(href, text) of Markdown links, images aside."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!!)\[[^\]]*\]\([^)\s]+\)"), F.lit(0))
    one = lambda a: F.struct(
        F.regexp_extract(a, r"\]\(([^)\s]+)\)$", 1).alias("href"), squeezed(F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).alias("text")
    )
    return F.array_distinct(F.transform(found, one))


def resolved_links(links: DataFrame, targets: DataFrame, key: str, target_key: str, lookup: str) -> DataFrame:
    """links with target_lookup: ``lookup`` where a target of that key exists, else ``topic_path``.

    An equi-join on distinct keys; Spark broadcasts them by itself while they are small.
    """
    keys = targets.select(F.col(target_key).alias("_target")).where("_target is not null").distinct()
    joined = links.join(keys, F.col(key) == F.col("_target"), "left")
    return joined.withColumn("target_lookup", F.when(F.col("_target").isNotNull(), lookup).otherwise("topic_path")).drop("_target")


def edges(rows: DataFrame, source: str, target: str, kind: str, reason: str = "") -> DataFrame:
    """Labelled edges with a stable id."""
    s, t = F.col(source), F.col(target)
    return rows.where(s.isNotNull() & (F.coalesce(t, F.lit("")) != "")).select(
        hash_id(s, t, F.lit(kind)).alias("id"), s.alias("source_full_name"), t.alias("target_name"), F.lit(kind).alias("link_kind"), F.lit(reason).alias("reason")
    )


def see_also(rows: DataFrame, name: str, targets: str) -> DataFrame:
    return edges(rows.select(name, F.explode(targets).alias("_t")), name, "_t", "see_also")


def typed_edges(rows: DataFrame, name: str, types: str) -> DataFrame:
    """An edge from a member to every type that its values can have."""
    return edges(rows.select(name, F.explode(types).alias("_t")), name, "_t", "returns_type", "value_types")


def with_workflow(links: DataFrame, steps: list[tuple[str, str, str]]) -> DataFrame:
    """links and a fixed list of (source, target, reason) next steps."""
    fixed = links.sparkSession.createDataFrame(steps, "s string, t string, r string")
    made = fixed.select(
        hash_id(F.col("s"), F.col("t"), F.lit("workflow_next_step")).alias("id"), F.col("s").alias("source_full_name"),
        F.col("t").alias("target_name"), F.lit("workflow_next_step").alias("link_kind"), F.col("r").alias("reason"),
    )
    return links.unionByName(made)


def related(links: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """A name's edges by kind and target."""
    return links.where(F.col("source_full_name") == name).orderBy("link_kind", "target_name").limit(limit)


def owner_titles(pages: DataFrame, path: str, title: str) -> DataFrame:
    """pages with owner_title: the title of the page that a ``<parent>/fields/<page>`` path belongs to."""
    parent = F.concat(F.regexp_extract(path, "^(.*)/fields/[^/]*$", 1), F.lit(".html"))
    titles = pages.select(F.col(path).alias("_parent"), F.col(title).alias("owner_title"))
    return pages.withColumn("_own", parent).join(titles, F.col("_own") == F.col("_parent"), "left").drop("_own", "_parent")

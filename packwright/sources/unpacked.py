"""Unpacked help: a folder for each version, in it one for each book, with pages, contents and a description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.functions.text import first_nonblank
from packwright.sources import files

_INFO = "language string, version string, label string"
_CONTENTS = "array<struct<path string, title_ru string, title_en string, entity_type string, breadcrumb array<string>>>"


def topics(tree: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a page of a tree of version/book/... files: rel_path, path, title, version, language, book_label, entity_type, breadcrumb, and columns of the tree to keep.

    Titles, kinds and the titles above come from the book's toc.json, by path; of several entries of a path the last
    counts. Version, language and label come from its hbk_info.json, else from the folders. Both files may start with
    a dot where the tree has such names (Spark lists none). Missing or broken ones leave the defaults: file name, topic.
    """
    parts = F.split("rel_path", "/")
    named = tree.withColumns({"_version": F.get(parts, F.lit(0)), "_book": F.get(parts, F.lit(1)), "_page": F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "/"))})
    named = named.where(F.size(parts) > 2)
    text = F.col("content").cast("string")
    info = named.where(F.col("_page").rlike("^/[.]?hbk_info[.]json$")).select("_version", "_book", F.from_json(text, _INFO).alias("_info"))
    info = info.groupBy("_version", "_book").agg(F.max("_info").alias("_info"))
    items = named.where(F.col("_page").rlike("^/[.]?toc[.]json$")).select("_version", "_book", F.posexplode(F.from_json(text, _CONTENTS)).alias("_at", "_item"))
    items = items.withColumn("_page", F.trim("_item.path")).where("_page <> ''").groupBy("_version", "_book", "_page").agg(F.max_by("_item", "_at").alias("_item"))
    pages = named.where(files.is_page(F.col("rel_path"), F.col("content"))).select("rel_path", "_version", "_book", "_page", *keep)
    known = pages.join(items, ["_version", "_book", "_page"], "left").join(info, ["_version", "_book"], "left")
    version = first_nonblank("_info.version", "_version")
    stem = F.regexp_replace(F.substring_index("rel_path", "/", -1), r"(.)\.[^.]*$", "$1")
    return known.select(
        "rel_path", F.concat(version, F.lit("/"), F.col("_book"), F.col("_page")).alias("path"), first_nonblank("_item.title_ru", "_item.title_en", stem).alias("title"),
        version.alias("version"), F.coalesce("_info.language", F.lit("")).alias("language"), first_nonblank("_info.label", "_book").alias("book_label"),
        first_nonblank("_item.entity_type", F.lit("topic")).alias("entity_type"), F.coalesce("_item.breadcrumb", F.array().cast("array<string>")).alias("breadcrumb"), *keep,
    )


def owner_stubs(members: DataFrame, objects: DataFrame) -> DataFrame:
    """A bare record for each (owner_name, version, language) of members that no object_name of objects has."""
    keys = members.select(F.trim("owner_name").alias("object_name"), "version", "language").where("object_name <> ''").distinct()
    known = objects.select("object_name", "version", "language").distinct()
    missing = keys.join(known, ["object_name", "version", "language"], "left_anti")
    empty = {c: F.lit("") for c in ("summary", "description", "notes", "restrictions", "topic_path")}
    return missing.withColumns({"full_name": F.col("object_name"), "title": F.col("object_name"), "kind": F.lit("type"), "resolver_kind": F.lit("stub"), **empty})

"""Pages of help together with what their books say of them: from plain trees, unpacked books and containers.

All three give the same columns: key, path (without its version's folder), title, version, language, book_label,
entity_type, breadcrumb (titles above the page) and html.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import first_nonblank, hash_id, html_title, topic_path
from packwright.plans.shared import written
from packwright.sources import container, files, help_books, listing, unpacked

_NONE = "array<string>"


def _shaped(rows: DataFrame, path: Column) -> DataFrame:
    plain = topic_path(path, F.col("version"))
    return rows.select(
        hash_id(F.col("version"), F.col("language"), plain).alias("key"), plain.alias("path"), "title", "version", "language", "book_label",
        "entity_type", F.coalesce("breadcrumb", F.array().cast(_NONE)).alias("breadcrumb"), files.old_text("content").alias("html"),
    )


def of_tree(tree: DataFrame, version: str, language: str) -> DataFrame:
    """Pages of a tree without contents: titles come from the pages, kinds from their paths."""
    rows = tree.where(files.is_page(F.col("rel_path"), F.col("content")))
    named = rows.select("rel_path", "content", html_title(files.old_text("content")).alias("title"), F.lit(version).alias("version"), F.lit(language).alias("language"), F.lit("").alias("book_label"), F.lit("topic").alias("entity_type"), F.lit(None).cast(_NONE).alias("breadcrumb"))
    return _shaped(named, F.col("rel_path"))


def of_unpacked(tree: DataFrame) -> DataFrame:
    """Pages of a tree of version/book/... folders, with the titles of each book's contents file."""
    return _shaped(unpacked.topics(tree, keep=("content",)), F.col("path"))


def of_books(spark: SparkSession, root: str, versions: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Pages inside the containers below a folder, with titles, kinds and breadcrumbs of their contents.

    Containers are found by their listing, unpacked one a task, and pages meet contents entries by book and path;
    of several entries of a path the last counts. A page without an entry keeps its own title and the kind topic.
    """
    listed = listing.listing(spark, root)
    books = help_books.help_books(listed, help_books.version_folders(listed, root, versions), languages)
    held = files.scan(spark, root, f"*.{help_books.CONTAINER}").join(books.select("rel_path").distinct(), "rel_path", "left_semi")
    inside = container.unpacked(held).where(files.is_page(F.col("rel_path"), F.col("content")))
    listed_pages = written(container.contents_rows(container.contents_texts(held), "archive", "text"))  # walked level by level
    entries = container.contents_paths(listed_pages)
    last = entries.groupBy(F.col("book").alias("archive"), F.regexp_replace("path", "^/+", "").alias("_page")).agg(
        F.max_by(F.struct("title", "entity_type", "breadcrumb"), "id").alias("_item")
    )
    paged = inside.withColumn("_page", F.regexp_replace("rel_path", "^/+", "")).join(last, ["archive", "_page"], "left")
    rows = paged.join(books.withColumnRenamed("rel_path", "archive"), "archive").select(
        F.concat_ws("/", "stem", "_page").alias("_path"), "content", "version", "language", F.col("label").alias("book_label"),
        first_nonblank("_item.title", html_title(files.old_text("content"))).alias("title"),
        first_nonblank("_item.entity_type", F.lit("topic")).alias("entity_type"), F.col("_item.breadcrumb").alias("breadcrumb"),
    )
    return _shaped(rows, F.col("_path"))

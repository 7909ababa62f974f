"""Category files: a folder's contents as nested brackets, put together to one tree of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.functions.paths import file_name
from packwright.functions.text import html_title
from packwright.operators.tree import breadcrumbs, folders
from packwright.plans.shared import written
from packwright.sources.files import old_text

#: The file that lists a folder's items.
CATEGORIES = "__categories__"
#: Title of a page without one.
UNTITLED = "Untitled"


def category_items(files: DataFrame) -> DataFrame:
    """(folder, position, item) of every category file: names behind ``{number,`` or ``},``; the root's folder is empty."""
    own = files.where(file_name(F.col("rel_path")) == CATEGORIES)
    names = F.regexp_extract_all(old_text("content"), F.lit(r'(?:\{\d+|\}),"([^"]+)"'), F.lit(1))
    return own.select(F.regexp_replace("rel_path", f"/?{CATEGORIES}$", "").alias("folder"), F.posexplode(names).alias("position", "item"))


def categories_root(files: DataFrame) -> str | None:
    """The folder whose categories stand above all others: the shortest path, then the least; None without any."""
    row = category_items(files).select("folder").distinct().orderBy(F.length("folder"), "folder").first()
    return row["folder"] if row else None


def _folder_of(path: str):
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def category_tree(files: DataFrame, dirs: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """(path, parent, position, title, page, depth, breadcrumb) of the tree below the root's category file.

    Folders are nodes with their own name and an empty page; pages (``.html``, ``.htm`` or no dot in the name) have
    their heading or title, wherever it stands. Items that aren't there have no row, nor have folders that the root's
    tree doesn't reach; a folder without a category file has its pages and folders by name. An item named twice in a
    folder counts where it first stands. Without any category file there are no rows. Empty folders come from ``dirs``
    (rel_path).
    """
    root = categories_root(files) if root is None else root
    every = folders(files, "rel_path").withColumnRenamed("folder", "path")
    every = (every if dirs is None else every.unionByName(dirs.select(F.col("rel_path").alias("path")))).distinct()
    pages = files.where(file_name(F.col("rel_path")) != CATEGORIES).select(F.col("rel_path").alias("path"), "content")
    name = file_name(F.col("path"))
    pages = pages.where(name.rlike(r"\.html?$") | ~F.contains(name, F.lit(".")))
    title = html_title(old_text("content"))
    there = every.select("path", F.lit(True).alias("is_dir"), name.alias("title")).unionByName(pages.select("path", F.lit(False).alias("is_dir"), title.alias("title")))
    # Titles and lists are read from contents once; what follows, level by level, joins a few short columns.
    there = written(there.withColumn("folder", _folder_of("path")).where(F.lit(root is not None)))
    listed = written(category_items(files))
    own = listed.groupBy("folder", "item").agg(F.min("position").alias("position"))
    below = F.when(F.col("folder") == "", F.col("item")).otherwise(F.concat_ws("/", "folder", "item"))
    named = own.select(below.alias("path"), "position").join(there, "path")
    plain = there.where(F.col("is_dir") | F.col("path").endswith(".html")).join(listed.select("folder").distinct(), "folder", "left_anti")
    nodes = named.unionByName(plain.withColumn("position", F.lit(None).cast("int")), allowMissingColumns=True)
    top = F.when(F.col("folder") == (root or ""), F.lit(None)).otherwise(F.col("folder"))
    nodes = nodes.select("path", top.alias("parent"), "position", "title", F.when(F.col("is_dir"), "").otherwise(F.col("path")).alias("page"))
    inside = written(nodes if not root else nodes.where(F.col("path").startswith(f"{root}/")))
    crumbs = breadcrumbs(inside, "path", "parent", "title").select(F.col("id").alias("path"), "depth", "breadcrumb")
    return inside.join(crumbs, "path")

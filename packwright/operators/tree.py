"""Parent chains and path ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.plans.shared import written


def breadcrumbs(nodes: DataFrame, id_col: str, parent_col: str, title_col: str) -> DataFrame:
    """(id, depth, breadcrumb): titles from the root down to each node, joined level by level.

    One equi-join a level: the level's rows alone are joined, and written, so that no level is computed twice. Nodes
    that no root reaches (their parent is missing or below them) have no row; a node that is below itself and below a
    root ends in an error.
    """
    base = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(title_col).alias("title"))
    front = base.where("parent is null").select("id", F.lit(0).alias("depth"), F.array("title").alias("breadcrumb"))
    levels, most = [front], nodes.count()
    for depth in range(1, most + 2):
        if depth > max(most, 1):
            raise ValueError("a node stands below itself")
        up = front.select(F.col("id").alias("_up"), F.col("breadcrumb").alias("_crumb"))
        front = base.join(up, F.col("parent") == F.col("_up")).select(
            "id", F.lit(depth).alias("depth"), F.concat("_crumb", F.array("title")).alias("breadcrumb")
        )
        front = written(front)
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def folders(paths: DataFrame, path_col: str) -> DataFrame:
    """Every folder above the given files, once."""
    parts = F.split(F.col(path_col), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.where(F.contains(F.col(path_col), F.lit("/"))).select(F.explode(above).alias("folder")).distinct()

"""Cosine neighbours and a blend of text and vector ranks, extensions beside the text tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_topk(vectors: DataFrame, query: list[float], *, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """The k rows nearest to one query vector by cosine; each task keeps k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(vector_col)
    cosine = dot(v, q) / (F.sqrt(dot(v, v)) * F.sqrt(dot(q, q)))
    return vectors.select(id_col, F.round(cosine, 6).alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)


def placed(scores: DataFrame, id_col: str, order: Column | str, most: int) -> DataFrame:
    """(id, place) of the ``most`` rows that come first, ties by id; each task keeps that many before they meet in one."""
    first = scores.orderBy(order, id_col).limit(most)
    return first.select(id_col, F.row_number().over(Window.orderBy(order, id_col)).alias("place"))


def blended(text_scores: DataFrame, vector_scores: DataFrame, id_col: str, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked tables (id, place)."""
    both = text_scores.select(id_col, F.col("place").alias("p1")).join(vector_scores.select(id_col, F.col("place").alias("p2")), id_col, "full")
    share = lambda p: F.coalesce(1.0 / (F.col(p) + constant), F.lit(0.0))
    return both.select(id_col, (share("p1") + share("p2")).alias("score"))


def record_text(*parts: Column) -> Column:
    """The text that stands for a record in a vector index: its non-blank parts, one a line."""
    return F.concat_ws("\n", *[F.nullif(F.trim(F.coalesce(p, F.lit(""))), F.lit("")) for p in parts])

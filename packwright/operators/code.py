"""Lookups over a code pack: modules, symbols and the call graph."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.functions.text import fold
from packwright.operators.fts import bm25
from packwright.plans.shared import written


def callers(calls: DataFrame, modules: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Calls of a name with their modules, by path and line."""
    met = calls.where(fold(F.col("callee_name"), "ascii") == fold(F.lit(name), "ascii"))
    return met.join(modules, "module_id").select("rel_path", "line", "caller_name", "callee_name", "args_count").orderBy("rel_path", "line").limit(limit)


def callees(calls: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Names called by a name, most called first."""
    met = calls.where(fold(F.col("caller_name"), "ascii") == fold(F.lit(name), "ascii"))
    return met.groupBy("callee_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "callee_name").limit(limit)


def symbols(symbols_: DataFrame, modules: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Symbols of a name; if none, full text over name, signature and comment."""
    place = modules.select("module_id", "rel_path")
    exact = symbols_.where(fold(F.col("name"), "ascii") == fold(F.lit(name), "ascii"))
    if not exact.isEmpty():
        return exact.join(place, "module_id").orderBy("rel_path", "line").limit(limit)
    scored = bm25(symbols_, "symbol_id", ["name", "signature", "doc_comment"], name).withColumnRenamed("doc_id", "symbol_id")
    found = symbols_.join(scored, "symbol_id").join(place, "module_id")
    return found.orderBy("score", F.length("rel_path"), "line").drop("score").limit(limit)


def modules(modules_: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Modules of a path or object name; if none, full text."""
    wanted = fold(F.lit(name), "ascii")
    exact = modules_.where((fold(F.col("rel_path"), "ascii") == wanted) | (fold(F.col("object_name"), "ascii") == wanted))
    if not exact.isEmpty():
        return exact.orderBy("rel_path").limit(limit)
    columns = ["rel_path", "object_type", "object_name", "module_kind", "excerpt"]
    scored = bm25(modules_, "module_id", columns, name).withColumnRenamed("doc_id", "module_id")
    return modules_.join(scored, "module_id").orderBy("score", F.length("rel_path"), "rel_path").drop("score").limit(limit)


def reachable(calls: DataFrame, name: str, depth: int | None = None) -> DataFrame:
    """Names that a name calls, directly or not (in at most depth steps if given), with the fewest steps; one join a step."""
    edge = calls.where("caller_name is not null").select(F.lower("caller_name").alias("a"), F.lower("callee_name").alias("b")).distinct()
    seen = calls.sparkSession.range(1).select(F.lower(F.lit(name)).alias("name"), F.lit(0).alias("steps"))
    front = seen
    for step in itertools.count(1) if depth is None else range(1, depth + 1):
        met = front.join(edge, front["name"] == edge["a"]).select(F.col("b").alias("name")).distinct()
        front = met.join(seen.select("name"), "name", "left_anti").withColumn("steps", F.lit(step))
        front = written(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.where("steps > 0")

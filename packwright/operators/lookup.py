"""Exact, substring and multi-field lookups, rank keys and token scores."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.text import fold, version_key


def equal_rows(docs: DataFrame, query: str, columns: list[str], how: str = "unicode") -> DataFrame:
    """Rows in which any column equals the query after folding."""
    wanted = fold(F.lit(query), how)
    return docs.where(reduce(lambda a, b: a | b, [fold(F.col(c), how) == wanted for c in columns]))


def containing_rows(docs: DataFrame, query: str, columns: list[str], wildcards: bool = False) -> DataFrame:
    """Rows in which any column contains the query, ASCII case aside; % and _ are plain unless ``wildcards``."""

    def has(c: str) -> Column:
        if wildcards:
            return fold(F.col(c), "ascii").like(f"%{query}%".lower())
        return F.contains(fold(F.col(c), "ascii"), fold(F.lit(query), "ascii"))

    return docs.where(reduce(lambda a, b: a | b, map(has, columns)))


def find(docs: DataFrame, query: str, *, path_col: str, name_col: str, columns: list[str], limit: int = 20) -> DataFrame:
    """Equal path or name; if none, rows that contain the query; if none, full text. Shortest paths first."""
    from packwright.operators.fts import bm25

    equal = equal_rows(docs, query, [path_col, name_col], "ascii")
    if not equal.isEmpty():
        return equal.orderBy(path_col).limit(limit)
    inside = containing_rows(docs, query, [path_col, name_col])
    if not inside.isEmpty():
        return inside.orderBy(F.length(path_col), path_col).limit(limit)
    scored = bm25(docs, path_col, columns, query).withColumnRenamed("doc_id", path_col)
    return docs.join(scored, path_col).orderBy("score", F.length(path_col), path_col).drop("score").limit(limit)


def applies_to(version_col: Column, versions_col: Column, version: str | None) -> Column:
    """Whether a record holds for a version: as its own or among its versions; no version asks for nothing."""
    if not version or not version.strip():
        return F.lit(True)
    return F.coalesce(F.trim(version_col) == version.strip(), F.lit(False)) | F.coalesce(
        F.array_contains(versions_col, version.strip()), F.lit(False)
    )


def any_field(docs: DataFrame, value: str, columns: list[str], arrays: list[str]) -> DataFrame:
    """Rows in which a column equals the value or an array holds it, case kept."""
    tests = [F.col(c) == value for c in columns] + [F.array_contains(a, value) for a in arrays]
    return docs.where(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]))


def exact_rank(query: str, full: Column, member: Column, aliases: Column | None = None, suffix: bool = True) -> Column:
    """0 full name, 1 member name, 2 an alias, 3 the end behind a dot (or last for objects), 4 else."""
    q = query.strip().lower()

    def low(c: Column) -> Column:
        return F.lower(F.trim(F.coalesce(c, F.lit(""))))

    rank = F.when(low(full) == q, 0).when(low(member) == q, 1)
    if aliases is not None:
        rank = rank.when(F.coalesce(F.exists(aliases, lambda a: F.lower(F.trim(a)) == q), F.lit(False)), 2)
    return rank.when(low(full).endswith(f".{q}"), 3).otherwise(4) if suffix else rank.otherwise(3)


def newest(version: Column) -> Column:
    """A key by which newer versions sort first."""
    return F.transform(version_key(F.coalesce(version, F.lit(""))), lambda x: -x)


# Owners whose members come first among equal names.
GLOBAL_OWNERS = ("глобальный контекст", "встроенные функции языка")


def exact_members(members: DataFrame, query: str, version: str | None = None, limit: int = 10) -> DataFrame:
    """Members called like the query: by rank, members of the global context first, then the newest version, then path.

    A name is a full or member name, an alias, a surface alias or what stands behind a dot. Null names and a blank query match nothing.
    """
    known = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("surface_aliases", F.array().cast("array<string>")))
    ranked = members.where(applies_to(F.col("version"), F.col("versions"), version)).withColumn("rank", exact_rank(query, F.col("full_name"), F.col("member_name"), known))
    owner = F.when(F.lower(F.trim(F.coalesce("owner_name", F.lit("")))).isin(*GLOBAL_OWNERS), 0).otherwise(1)
    kept = ranked.where(F.col("rank") < 4) if query.strip() else ranked.where("false")
    return kept.orderBy("rank", owner, newest(F.col("version")), F.coalesce("topic_path", F.lit("")), "full_name").limit(limit)


def exact_objects(objects: DataFrame, query: str, version: str | None = None, limit: int = 10) -> DataFrame:
    """Objects called like the query by full or object name, alias or surface alias: by rank, then the newest version, then path."""
    known = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("surface_aliases", F.array().cast("array<string>")))
    ranked = objects.where(applies_to(F.col("version"), F.col("versions"), version)).withColumn("rank", exact_rank(query, F.col("full_name"), F.col("object_name"), known, suffix=False))
    kept = ranked.where(F.col("rank") < 3) if query.strip() else ranked.where("false")
    return kept.orderBy("rank", newest(F.col("version")), F.coalesce("topic_path", F.lit("")), "full_name").limit(limit)


def token_score(query: str, primary: Column, *others: Column) -> Column:
    """100 if the query is the primary field, 40 if it is inside it, and 5 for each token found in any field."""
    q = query.strip().lower()
    words = [t for t in re.findall(r"[А-Яа-яA-Za-z0-9_.-]+", q) if len(t) >= 2]
    first = F.lower(F.coalesce(primary, F.lit("")))
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (primary, *others)]))
    score = F.when(first == q, 100).when(F.contains(first, F.lit(q)), 40).otherwise(0)
    for w in words:
        score = score + F.when(F.contains(hay, F.lit(w)), 5).otherwise(0)
    return score if q else F.lit(0)


def ranked_examples(examples: DataFrame, query: str, limit: int) -> DataFrame:
    """The examples that score highest for a query; ties by full name, title and description. Rows without any score have no place."""
    score = token_score(query, F.col("full_name"), F.col("title"), F.col("description"), F.col("code"))
    return examples.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "full_name", "title", "description").limit(limit)

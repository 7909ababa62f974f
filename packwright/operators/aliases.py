"""Surface aliases of help records and the typed relations between them, as joins with generated names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import resolver
from packwright.functions.grammar import is_link_target
from packwright.functions.text import hash_id

# Names at the root of the surface.
GLOBAL, ROOT, CATALOG = "Глобальный контекст", "ОбъектМетаданныхКонфигурация", "ПеречислимыеСвойстваОбъектовМетаданных"
METADATA, PROPERTIES, ITEM = "Метаданные", "СвойстваОбъектов", "ОбъектМетаданных: "
#: Kinds of relations whose targets must look like a type.
TYPED = ("returns_type", "global_property_returns_type", "metadata_property_returns_type", "metadata_enum_property_returns_system_enum", "metadata_collection_contains_object_type")


def alias_rules(spark: SparkSession) -> DataFrame:
    """(lookup, key, alias, adds_member, rank): what a record is found by, and the alias that gives it; least rank first.

    lookup is full (a member's full name), owner (its owner's) or object (an object's). Rank 0 stands alone: no other alias
    counts beside it. The table is fixed: a few rows a family.
    """
    dotted = lambda *parts: F.concat_ws(".", *[F.lit(p) if isinstance(p, str) and p in (GLOBAL, ROOT, METADATA) else p for p in parts])
    fixed = spark.createDataFrame(
        [
            ("full", f"{GLOBAL}.{METADATA}", METADATA, False), ("full", f"{ROOT}.{PROPERTIES}", f"{METADATA}.{PROPERTIES}", False), ("owner", CATALOG, f"{METADATA}.{PROPERTIES}", True),
            ("owner", GLOBAL, "", True), ("object", ROOT, METADATA, False), ("object", CATALOG, f"{METADATA}.{PROPERTIES}", False),
        ],
        "lookup string, key string, alias string, adds_member boolean",
    ).withColumn("rank", F.lit(0))
    collections = resolver.collections(spark).select(F.lit("full"), dotted(ROOT, F.col("family")), dotted(METADATA, F.col("family")), F.lit(False), F.lit(0))
    families = spark.createDataFrame([(*f, k + 1) for k, f in enumerate(resolver.FAMILIES)], "family string, manager string, placeholder string, item string, rank int")
    of_family = lambda lookup, key, alias, adds: families.select(F.lit(lookup), key, alias, F.lit(adds), "rank")
    family, shelf = F.col("family"), dotted(F.col("family"), F.col("placeholder"))
    template = dotted(F.col("item"), F.col("placeholder"))
    made = [
        of_family("full", dotted(F.col("manager"), F.col("placeholder")), shelf, False), of_family("owner", template, shelf, True),
        of_family("object", F.col("manager"), family, False), of_family("object", template, shelf, False),
    ]
    return reduce(DataFrame.union, [fixed, collections, *made])


def with_aliases(records: DataFrame, *, key: str, full: str, owner: str, member: str, is_object: Column) -> DataFrame:
    """records with surface_aliases: the generated names that a record is known by, in order of rank, repeats in another case dropped.

    ``key`` tells records apart. The rules are a fixed table, so they are sent to every task; a record meets at most a few.
    """
    rules = F.broadcast(alias_rules(records.sparkSession))  # fixed: some hundred rows
    f, o = F.col(full), F.col(owner)
    found = F.when(is_object, F.array(F.struct(F.lit("object").alias("lookup"), f.alias("key")))).otherwise(
        F.array(F.struct(F.lit("full").alias("lookup"), f.alias("key")), F.struct(F.lit("owner").alias("lookup"), o.alias("key")))
    )
    asked = records.select(F.col(key).alias("_k"), F.col(member).alias("_m"), F.explode(found).alias("q")).select("_k", "_m", "q.*")
    met = asked.join(rules, ["lookup", "key"]).where(~F.col("adds_member") | (F.coalesce("_m", F.lit("")) != ""))
    alias = F.when(F.col("adds_member"), F.concat_ws(".", F.nullif("alias", F.lit("")), "_m")).otherwise(F.col("alias"))
    each = met.groupBy("_k").agg(F.array_sort(F.collect_set(F.struct("rank", alias.alias("alias")))).alias("all"), F.min("rank").alias("least"))
    kept = F.transform(F.filter("all", lambda x: (F.col("least") > 0) | (x["rank"] == 0)), lambda x: x["alias"])
    folded = F.transform(kept, F.lower)
    names = each.select("_k", F.filter(kept, lambda n, i: F.array_position(folded, F.lower(n)) == i + 1).alias("surface_aliases"))
    joined = records.join(names, F.col(key) == F.col("_k"), "left").drop("_k")
    return joined.withColumn("surface_aliases", F.coalesce("surface_aliases", F.array().cast("array<string>")))


def typed_relations(records: DataFrame, *, full: str, owner: str, member: str, is_object: Column, types: str = "value_types", aliases: str = "surface_aliases") -> DataFrame:
    """(id, source_full_name, target_name, target_lookup, source_lookup, link_kind, reason): six kinds of edges out of records.

    A record's types, its aliases, and what the root's properties and collections stand for. Targets of types that don't look like one
    give no edge; objects have aliases only.
    """
    kinds = resolver.collections(records.sparkSession).select(F.concat_ws(".", F.lit(ROOT), "family").alias("_full"), F.col("kind").alias("_kind"))
    rows = records.join(F.broadcast(kinds), F.col(full) == F.col("_full"), "left")  # 21 fixed rows
    is_member, f = ~is_object, F.col(full)

    def edges(what: Column, targets: Column, kind: str, lookup: Column, reason: str = "") -> DataFrame:
        each = rows.where(what).select(f.alias("source_full_name"), is_object.alias("_o"), F.explode(targets).alias("target_name"), lookup.alias("target_lookup"))
        each = each.where(F.trim("target_name") != "").withColumns({"link_kind": F.lit(kind), "reason": F.lit(reason)})
        return each.where(is_link_target(F.col("target_name"))) if kind in TYPED else each

    one = lambda c: F.array(F.lit(c) if isinstance(c, str) else c)
    of_object = F.lit("object")
    made = [
        edges(is_member, F.col(types), "returns_type", of_object, "value_types"),
        edges(F.lit(True), F.col(aliases), "surface_alias", F.lit("alias"), "surface name"),
        edges(is_member & (f == f"{GLOBAL}.{METADATA}"), one(ROOT), "global_property_returns_type", of_object),
        edges(is_member & (F.col(owner) == ROOT) & (F.col(member) == PROPERTIES), one(CATALOG), "metadata_property_returns_type", of_object),
        edges(is_member & (F.col(owner) == CATALOG), F.col(types), "metadata_enum_property_returns_system_enum", of_object),
        edges(is_member & F.col("_kind").isNotNull(), one(F.concat(F.lit(ITEM), "_kind")), "metadata_collection_contains_object_type", of_object),
    ]
    every = reduce(DataFrame.unionByName, made)
    return every.select(
        hash_id(F.col("source_full_name"), F.col("target_name"), F.col("link_kind")).alias("id"), "source_full_name", "target_name", "target_lookup",
        F.when(F.col("_o"), "object").otherwise("member").alias("source_lookup"), "link_kind", "reason",
    )

"""JSON-lines records: schemas, tolerant and strict reads, snapshots as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import compact, first_nonblank, joined, row_versions

_NAMES = "full_name string, name string, object_name string, member_name string, title string, id string"
_TEXTS = "summary string, description string, signature string, syntax string, purpose string, returns string, exceptions string, text string"
#: Fields that the pack reads of any help record; others are ignored, missing ones are null.
HELP_SCHEMA = f"{_NAMES}, {_TEXTS}, topic_path string, version string, versions array<string>, language string, kind string, code string, body string"
OBJECT_SCHEMA = "id string, object_type string, name string, full_name string, path string, config_name string, config_version string"
FIELD_SCHEMA = (
    "object_id string, object_name string, object_type string, config_version string, `group` string, name string, synonym string, kind string, type string, "
    "defined_type string, form_name string, tabular_section string, constant_bsl_hint string, comment string, usage string, indexing boolean, types array<string>, length int, precision array<int>"
)
DOMAINS = ("api_members", "api_objects", "api_examples", "api_links", "api_topics")


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _chosen(versions: Column, chosen: list[str] | None) -> Column:
    return F.array_intersect(versions, F.array(*map(F.lit, chosen))) if chosen else versions


def help_docs(records: DataFrame, domain: str, chosen: list[str] | None = None, most: int = 4000, extra: tuple[str, ...] = ()) -> DataFrame:
    """Help records as pack rows: domain, name, topic_path, version, versions, payload.

    Records without versions go, as do those without a chosen one; the version is the least in text order. The
    code and body of records are searchable only if named in ``extra``.
    """
    fields = ("summary", "description", "signature", "syntax", "purpose", "returns", "exceptions", "text", *extra)
    rows = records.withColumn("_versions", _chosen(row_versions(F.col("versions"), F.col("version")), chosen)).where(F.size("_versions") > 0)
    return rows.select(
        F.lit(domain).alias("domain"), first_nonblank("full_name", "name", "object_name", "member_name", "title").alias("name"),
        F.trim(F.coalesce("topic_path", F.lit(""))).alias("topic_path"), F.array_min("_versions").alias("version"), F.col("_versions").alias("versions"),
        joined(most, *fields).alias("payload"),
    )


def object_docs(objects: DataFrame, most: int = 4000) -> DataFrame:
    version = compact("config_version")
    return objects.select(
        F.lit("metadata_objects").alias("domain"), compact("name").alias("name"), compact("id").alias("topic_path"), version.alias("version"),
        F.array(version).alias("versions"), joined(most, "object_type", "name", "full_name", "path").alias("payload"),
    )


def field_docs(fields: DataFrame, most: int = 4000) -> DataFrame:
    from packwright.functions.paths import field_identity

    named = field_identity(F.col("object_id"), F.col("group"), F.col("name"), F.col("tabular_section"), F.col("form_name"))
    version = compact("config_version")
    parts = ("object_id", "object_name", "name", "synonym", "kind", "group", "tabular_section", "type", "defined_type", "constant_bsl_hint")
    return fields.select(
        F.lit("metadata_fields").alias("domain"), named["display_name"].alias("name"), named["topic_path"].alias("topic_path"), version.alias("version"),
        F.array(version).alias("versions"), joined(most, *parts).alias("payload"),
    )


def merged_snapshots(snapshots: list[DataFrame]) -> DataFrame:
    """Snapshots of several exports as one table; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), snapshots)

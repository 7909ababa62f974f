"""Metadata exports: found by their first bytes, read record by record in many tasks, kept as snapshots of JSON lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.plans import packs
from packwright.sources import config_xml
from packwright.sources.listing import heads, is_hidden, listing

#: Format that loaders check, and the version of several configurations together.
FORMAT, MULTIPLE, NO_VERSION = "packwright_snapshot_v1", "multiple", "0.0.0.0"
#: Groups whose fields are rows of a snapshot's fields, in this order; values stay inside their object.
FIELD_GROUPS = ("requisites", "dimensions", "resources", "properties", "constants", "tabular_sections", "tabular_section_requisites")
_RECORD = "CatalogObject."
_ATTRIBUTES = r"""(?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""
_TAG = re.compile(rf"<(/?)(?:[\w.-]+:)?([\w.-]+){_ATTRIBUTES}(/?)>")
_FIELD = "struct<name string, synonym string, comment string, kind string, type string, types array<string>, tabular_section string, constant_bsl_hint string>"
OBJECT_ROW = f"id string, object_type string, name string, full_name string, config_name string, config_version string, attributes struct<comment string, groups map<string, array<{_FIELD}>>>"
FIELD_ROW = (
    "object_id string, object_name string, object_type string, config_version string, `group` string, name string, synonym string, comment string, kind string, "
    "type string, types array<string>, tabular_section string, constant_bsl_hint string"
)


_DECLARED = re.compile(rb"""^(?:\xef\xbb\xbf)?\s*<\?xml[^>]*encoding\s*=\s*["']([\w.-]+)""")


@F.pandas_udf(T.StructType().add("encoding", T.StringType()).add("text", T.StringType()))
def _decoded_head(head: pd.Series) -> pd.DataFrame:
    """The encoding that a file's first bytes declare (UTF-8 if none, or one unknown), and their text."""

    def one(b: bytes) -> tuple[str, str]:
        said = _DECLARED.match(b)
        try:
            return (name := said[1].decode().lower() if said else "utf-8"), b.decode(name, "ignore")
        except LookupError:
            return "utf-8", b.decode("utf-8", "ignore")

    return pd.DataFrame([one(bytes(b)) for b in head], columns=["encoding", "text"])


def exports_in(spark: SparkSession, folder: str) -> DataFrame:
    """(rel_path, modified, encoding, prefix, root_name) of the exports right in a folder, known by their first bytes.

    Files with a DTD are none. The prefix stands before the names of records; the root's name is that of its attribute.
    """
    files = listing(spark, folder).where(~F.col("is_dir") & ~F.contains("rel_path", F.lit("/")) & F.lower("rel_path").endswith(".xml") & ~is_hidden(F.col("rel_path")))
    known = heads(files, folder).select("rel_path", "modified", _decoded_head("head").alias("h")).select("rel_path", "modified", "h.*")
    return known.where(config_xml.is_export(F.encode("text", "UTF-8"))).select(
        "rel_path", "modified", "encoding",
        F.regexp_extract("text", rf"<((?:[\w.-]+:)?){re.escape(_RECORD)}", 1).alias("prefix"),
        F.trim(F.regexp_extract("text", r"""<(?:[\w.-]+:)?Конфигурация\s(?:[^>]*\s)?Имя\s*=\s*["']([^"']*)""", 1)).alias("root_name"),
    )


def newest_export(exports: DataFrame) -> str | None:
    """The export that was written last; of equally old ones the first by name."""
    row = exports.orderBy(F.desc("modified"), "rel_path").select("rel_path").first()
    return row["rel_path"] if row else None


def _record(piece: str, prefix: str) -> tuple[str, dict[str, str], list[str]] | None:
    """The record that a piece ends in; the piece stops where its closing tag begins."""
    at = piece.rfind(f"<{prefix}{_RECORD}")
    if at < 0:
        return None
    body = piece[at:]
    tag = re.match(rf"<{re.escape(prefix)}{re.escape(_RECORD)}([^\s/>]+)", body)
    if tag is None:
        return None
    try:
        e = ET.fromstring(_TAG.sub(r"<\1\2\3>", f"{body}</{_RECORD}{tag[1]}>"))
    except ET.ParseError:
        return None
    text = lambda x: (x.text or "").strip()
    kinds = next((c for c in e if c.tag == "Типы"), ())
    return tag[1], {c.tag: text(c) for c in e}, [text(t) for k in kinds for t in k if t.tag == "Тип" and text(t)]


def export_records(spark: SparkSession, path: str, *, encoding: str = "utf-8", prefix: str = "") -> DataFrame:
    """(rel_path, tag, fields, types) of every catalog record of one export, however large the file is.

    Spark cuts the file at the records' closing tags, so byte ranges of it are read by tasks of their own, and each task
    parses one record at a time. Malformed records are left out and entities of a DTD are never read: a record that uses one
    is malformed. Comments go before a record is looked for, and with them a record inside one; a comment around several
    records hides only the first, as later pieces don't show it. Encodings must spell ASCII in one byte.
    """
    pieces = spark.read.option("lineSep", f"</{prefix}{_RECORD}").text(path).select(F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for piece in batch.column(0).to_pylist():
                text = re.sub(r"<!--.*?-->", "", piece.decode(encoding, "replace"), flags=re.S).partition("<!--")[0]
                found = _record(text, prefix)
                if found is not None:
                    rows.append((found[0], list(found[1].items()), found[2]))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            kinds = (pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["tag", "fields", "types"])

    made = pieces.mapInArrow(run, "tag string, fields map<string,string>, types array<string>")
    return made.select(F.lit(path.rstrip("/").rsplit("/", 1)[-1]).alias("rel_path"), "tag", "fields", "types")


def export_identity(records: DataFrame, root_name: str = "") -> tuple[str, str]:
    """(name, version) of an export's configuration: its record's, else the root's name, else the file's stem."""
    f = lambda k: F.trim(F.coalesce(F.col("fields")[k], F.lit("")))
    own = records.where("tag = 'Конфигурации'").select(F.coalesce(F.nullif(f("Имя"), F.lit("")), f("Description")).alias("n"), f("Версия").alias("v")).orderBy("n", "v").first()
    if own and own["n"]:
        return own["n"], own["v"] or NO_VERSION
    stem = records.select("rel_path").first()
    return root_name or (stem["rel_path"].rsplit(".", 1)[0] if stem else "config"), (own["v"] if own else "") or NO_VERSION


def nested_objects(objects: DataFrame, fields: DataFrame, name: str, version: str) -> DataFrame:
    """Objects with their fields by group, as a snapshot keeps them; fields of a group are in order of section and name."""
    field = F.struct(*[F.col(c) for c in ("name", "synonym", "comment", "kind", "type", "types", "tabular_section", "constant_bsl_hint")])
    by_group = fields.groupBy("object_id", "group").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("tabular_section", F.lit("")).alias("a"), F.col("name").alias("b"), field.alias("f")))).alias("all"))
    entry = F.struct(F.col("group").alias("key"), F.transform("all", lambda x: x["f"]).alias("value"))
    groups = by_group.groupBy("object_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("groups"))
    joined = objects.join(groups, objects["id"] == groups["object_id"], "left")
    none = F.create_map().cast(f"map<string, array<{_FIELD}>>")
    return joined.select(
        "id", "object_type", "name", "full_name", F.lit(name).alias("config_name"), F.lit(version).alias("config_version"),
        F.struct(F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("groups", none).alias("groups")).alias("attributes"),
    )


def nested_fields(objects: DataFrame) -> DataFrame:
    """The fields of nested objects as rows, one a field; values are none."""
    each = objects.select(F.col("id").alias("object_id"), F.col("name").alias("object_name"), "object_type", "config_version", F.explode("attributes.groups").alias("group", "all"))
    return each.where(F.col("group").isin(*FIELD_GROUPS)).select("object_id", "object_name", "object_type", "config_version", "group", F.explode("all").alias("f")).select("*", "f.*").drop("f")


def write_snapshot(objects: DataFrame, out: str, name: str, version: str) -> dict:
    """Nested objects and their fields as JSON lines, and a manifest with counts that loaders check; returns the manifest."""
    spark = objects.sparkSession
    objects.write.mode("overwrite").json(f"{out}/objects")
    saved = spark.read.schema(OBJECT_ROW).json(f"{out}/objects")
    nested_fields(saved).write.mode("overwrite").json(f"{out}/fields")
    counts = {"objects": saved.count(), "fields": spark.read.schema(FIELD_ROW).json(f"{out}/fields").count()}
    return packs.write_manifest(spark, out, {"format": FORMAT, "config_name": name, "config_version": version, **counts})


def read_snapshot(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, objects, fields) of a snapshot; another format, or tables with other counts than its manifest's, end in an error."""
    manifest = packs.read_manifest(spark, path)
    if manifest.get("format") != FORMAT:
        raise ValueError(f"no snapshot of format {FORMAT}: {path} is {manifest.get('format')}")
    objects, fields = spark.read.schema(OBJECT_ROW).json(f"{path}/objects"), spark.read.schema(FIELD_ROW).json(f"{path}/fields")
    counts = {"objects": objects.count(), "fields": fields.count()}
    if any(manifest.get(k) != n for k, n in counts.items()):
        raise ValueError(f"snapshot {path} holds {counts}, its manifest says {manifest}")
    return manifest, objects, fields


def read_snapshots(spark: SparkSession, paths: list[str]) -> tuple[dict, DataFrame, DataFrame]:
    """Several snapshots as one: all rows, the version ``multiple`` and up to three configurations in the name."""
    if not paths:
        raise FileNotFoundError("no snapshots")
    each = [read_snapshot(spark, p) for p in paths]
    if len(each) == 1:
        return each[0]
    labels = list(dict.fromkeys(f"{m['config_name']} ({m['config_version']})" for m, _, _ in each))
    objects, fields = each[0][1], each[0][2]
    for _, more, others in each[1:]:
        objects, fields = objects.unionByName(more), fields.unionByName(others)
    total = {k: sum(m[k] for m, _, _ in each) for k in ("objects", "fields")}
    return {"format": FORMAT, "config_name": ", ".join(labels[:3]) + ("…" if len(labels) > 3 else ""), "config_version": MULTIPLE, **total}, objects, fields


def snapshots_in(spark: SparkSession, path: str) -> list[str]:
    """The snapshot that a folder is, or those right in its ``snapshots`` folder by name; only names are looked at."""
    rows = listing(spark, path).where("is_dir").select("rel_path")
    parts = F.split("rel_path", "/")
    home = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    full = rows.select(home.alias("home"), F.element_at(parts, -1).alias("name")).where("name in ('manifest', 'objects')").groupBy("home").agg(F.count_distinct("name").alias("n")).where("n = 2")
    found = [r["home"] for r in full.where(F.col("home").rlike("^(snapshots/[^/]+)?$")).orderBy("home").collect()]  # one row a snapshot
    return [path.rstrip("/")] if "" in found else [f"{path.rstrip('/')}/{h}" for h in found]

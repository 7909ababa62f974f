"""Metadata packs from whatever describes a configuration: snapshots, configuration trees or exports, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import slug
from packwright.plans import packs
from packwright.sources import config_xml, exports, files, records
from packwright.sources.listing import listing


def metadata_inputs(spark: SparkSession, *, snapshots: str | None = None, config: str | None = None, source: str | None = None) -> list[tuple[str, str]]:
    """(kind, path) of what metadata is built from; kinds are snapshot, config and export.

    ``snapshots`` must be a snapshot or hold some; else ``config`` must be a configuration tree or hold some; else
    ``source`` is a snapshot, a folder of snapshots, or one with exports right in it. Nothing found is an error.
    """
    if snapshots:
        found = [("snapshot", p) for p in exports.snapshots_in(spark, snapshots)]
        asked = snapshots
    elif config:
        tree = listing(spark, config).where("not is_dir").select("rel_path")
        roots = [r["root"] for r in config_xml.config_roots(tree).orderBy("root").collect()]  # one row a configuration
        found, asked = [("config", f"{config.rstrip('/')}/{r}".rstrip("/")) for r in roots], config
    elif source:
        found, asked = [("snapshot", p) for p in exports.snapshots_in(spark, source)], source
        if not found:
            met = exports.exports_in(spark, source).orderBy("rel_path").select("rel_path")
            found = [("export", f"{source.rstrip('/')}/{r['rel_path']}") for r in met.collect()]  # one row an export
    else:
        raise ValueError("name snapshots, a configuration tree or a source")
    if not found:
        raise FileNotFoundError(f"nothing to build metadata from in {asked}")
    return found


def snapshot_of_export(spark: SparkSession, path: str, out: str) -> str:
    """The snapshot of one export, in a folder named like the file below OUT/snapshots; returns it."""
    folder, _, name = path.rpartition("/")
    row = exports.exports_in(spark, folder).where(F.col("rel_path") == name).first()
    if row is None:
        raise FileNotFoundError(f"no export: {path}")
    read = exports.export_records(spark, path, encoding=row["encoding"], prefix=row["prefix"])
    config, version = exports.export_identity(read, row["root_name"])
    objects = exports.nested_objects(config_xml.export_objects(read), config_xml.export_fields(read), config, version)
    key = spark.range(1).select(slug(F.lit(name.rsplit(".", 1)[0]), "config").alias("k")).first()["k"]
    to = f"{out}/snapshots/{key}"
    exports.write_snapshot(objects, to, config, version)
    return to


def snapshot_of_tree(spark: SparkSession, path: str, out: str) -> str:
    """The snapshot of one configuration tree below OUT/snapshots; returns it."""
    crawled = config_xml.crawl(files.scan(spark, path))
    row = config_xml.identity(crawled).first()
    config, version = (row["config_name"], row["config_version"]) if row else (path.rstrip("/").rsplit("/", 1)[-1], exports.NO_VERSION)
    own = config_xml.fields(crawled).withColumns({"comment": F.lit(""), "constant_bsl_hint": F.lit(None).cast("string")})
    own = own.withColumn("types", F.filter(F.split("type", r" \| "), lambda x: x != ""))
    objects = exports.nested_objects(config_xml.objects(crawled).withColumn("comment", F.lit("")), own, config, version)
    key = spark.range(1).select(F.concat_ws("_", slug(F.lit(config)), slug(F.lit(version)), slug(F.lit(path.rstrip("/").rsplit("/", 1)[-1]))).alias("k")).first()["k"]
    exports.write_snapshot(objects, f"{out}/snapshots/{key}", config, version)
    return f"{out}/snapshots/{key}"


def snapshot_docs(objects: DataFrame, fields: DataFrame) -> list[DataFrame]:
    """Rows of a metadata pack from a snapshot's tables."""
    named = objects.withColumn("path", F.col("id"))
    more = fields.withColumns({"defined_type": F.lit(""), "form_name": F.lit(None).cast("string")})
    return [records.object_docs(named), records.field_docs(more)]


def build_metadata(spark: SparkSession, inputs: list[tuple[str, str]], out: str) -> dict:
    """A metadata pack of all inputs, each made a snapshot first; returns the pack's manifest."""
    makers = {"snapshot": lambda p: p, "export": lambda p: snapshot_of_export(spark, p, out), "config": lambda p: snapshot_of_tree(spark, p, out)}
    made = [makers[kind](path) for kind, path in inputs]
    about, objects, fields = exports.read_snapshots(spark, made)
    return packs.write_docs(snapshot_docs(objects, fields), f"{out}/metadata", {"config_name": about["config_name"], "config_version": about["config_version"]})

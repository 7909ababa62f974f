"""Builds: from a source folder to the packs of a target, from help pages and standards to shared packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.text import slug
from packwright.operators import stats
from packwright.plans import packs, platform
from packwright.plans.catalog import PROFILES, Workspace, profile_for, source_snapshot
from packwright.sources import code_modules, config_xml, files, help_topics, markdown, records


def build_target(spark: SparkSession, source: str, out: str, profile: str = "full", sample: int = 25) -> tuple[str, dict]:
    """(name, target): the packs that a profile asks for, each from one scan of the source's files."""
    tree = files.scan(spark, source)
    crawled = config_xml.crawl(tree)
    row = config_xml.identity(crawled).first()
    name, version = (row["config_name"], row["config_version"]) if row else (source.rstrip("/").rsplit("/", 1)[-1], "0.0.0.0")
    target = spark.range(1).select(F.concat_ws("_", slug(F.lit(name)), slug(F.lit(version))).alias("t")).first()["t"]
    made, wanted = {}, PROFILES[profile]
    if "metadata" in wanted:
        objects = config_xml.objects(crawled).withColumns({"config_name": F.lit(name), "config_version": F.lit(version)})
        extra = {"config_version": F.lit(version), "defined_type": F.lit(""), "constant_bsl_hint": F.lit("")}
        fields = config_xml.fields(crawled).withColumns(extra)
        made["metadata"] = f"{out}/{target}/metadata"
        packs.write_docs([records.object_docs(objects), records.field_docs(fields)], made["metadata"])
        packs.write_json_lines(objects, f"{made['metadata']}/snapshot/objects")
        packs.write_json_lines(fields, f"{made['metadata']}/snapshot/fields")
    if "code" in wanted:
        modules, symbols, calls = code_modules.code_pack(code_modules.modules(tree))
        made["code"] = f"{out}/{target}/code"
        packs.write_tables({"modules": modules, "symbols": symbols, "calls": calls}, made["code"], "code")
    if "full" in wanted:
        made["full"] = f"{out}/{target}/full"
        build_full(tree, made["full"], sample, files.empty_folders(spark, source))
    return target, {"kind": "configuration", "config_name": name, "config_version": version, "source_path": source, "source": source_snapshot(tree), "packs": made}


def build_full(tree: DataFrame, out: str, sample: int = 25, empty: DataFrame | None = None) -> dict:
    """Entries (``empty`` folders among them) and blobs of all files but those with an exclusion reason; a sample is unpacked and compared."""
    entries = files.entries(tree, empty=empty)
    kept = entries.where("excluded_reason is null")
    reasons = {r["excluded_reason"]: r["n"] for r in stats.counter(entries.where("excluded_reason is not null"), "excluded_reason").collect()}
    blobs = files.blobs(tree.join(kept.where("entry_type = 'file'").select("rel_path"), "rel_path", "left_semi"))
    manifest = packs.write_tables({"entries": kept, "blobs": blobs}, out, "config", {"excluded": reasons})
    spark = tree.sparkSession
    saved = packs.table(spark, out, "blobs")
    chosen = stats.even_sample(saved.select("rel_path"), "rel_path", sample)
    stored = saved.join(F.broadcast(chosen), "rel_path").select("rel_path", files.decompressed("data").alias("content"))  # at most ``sample`` paths
    source = tree.select("rel_path", "content").join(F.broadcast(chosen), "rel_path")
    bad = [r["rel_path"] for r in stats.digest_mismatches(stored, source, "rel_path", "content").collect()]
    if bad:
        raise RuntimeError(f"packed files differ from their source: {bad}")
    return manifest


def build_help(trees: list[tuple[DataFrame, str, str]], out: str) -> dict:
    """A platform pack of (file tree, version, language) sources: equal records of several versions become one."""
    return platform.build_platform([help_topics.of_tree(tree, version, language) for tree, version, language in trees], out)


def build_standards(tree: DataFrame, version: str, out: str) -> dict:
    return packs.write_docs([markdown.standards(tree, version)], out)


def ensure(spark: SparkSession, workspace: Workspace, needs: list[str], sources: dict[str, str], out: str) -> list[str]:
    """Builds the targets that lack a needed pack or whose source has changed; returns their names."""
    workspace.profile = profile_for(workspace.profile, needs)
    built, wanted = [], PROFILES[workspace.profile][1:]
    by_path = {t["source_path"]: (n, t) for n, t in workspace.targets.items() if "source_path" in t}
    for source in sources.values():
        _, known = by_path.get(source, (None, None))
        fresh = known and known["source"] == source_snapshot(files.scan(spark, source)) and all(r in known["packs"] for r in wanted)
        if not fresh:
            name, target = build_target(spark, source, out, workspace.profile)
            workspace.targets[name] = target
            built.append(name)
    return built

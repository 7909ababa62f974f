"""Bundles: a copy of all packs of a workspace, and its archive in parts that tasks write and read side by side."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.operators import fts
from packwright.plans import increment, packs
from packwright.plans.catalog import Workspace
from packwright.sources.listing import listing, opened

#: Every entry of an archive has this time, so the same files give the same bytes.
TIME = (1980, 1, 1, 0, 0, 0)
#: Bytes of files in a part, about, and bytes copied at a time.
PART_BYTES, CHUNK = 1 << 30, 8 << 20
FORMAT = "packwright_archive_v1"


def copy_pack(spark: SparkSession, pack: str, out: str) -> dict:
    """All tables of a pack in another place, text index and links among them; tracked packs as one generation."""
    manifest = packs.read_manifest(spark, pack)
    if "generations" in manifest:
        return increment.compacted(spark, pack, out)
    is_docs = "domain_counts" in manifest
    if is_docs:
        docs = packs.table(spark, pack, "docs").repartitionByRange("domain", "name_key").sortWithinPartitions("domain", "name_key")
        docs.write.mode("overwrite").option("compression", "zstd").partitionBy("domain").parquet(f"{out}/docs")
    indexed = is_docs and manifest.get("text_index")
    if indexed:
        fts.write_postings(packs.table(spark, pack, "postings"), f"{out}/postings")
    others = [*(["lengths"] if indexed else []), *manifest.get("tables", []), *([] if is_docs else manifest["rows"])]
    for name in others:
        packs.table(spark, pack, name).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}")
    return packs.write_manifest(spark, out, manifest)


def export(spark: SparkSession, workspace: Workspace, out: str) -> dict:
    """A copy of all packs under one folder, with a manifest without absolute paths."""
    moved: dict[str, dict] = {"packs": {}, "targets": {}}
    for role, pack in workspace.packs.items():
        copy_pack(spark, pack, f"{out}/{role}")
        moved["packs"][role] = role
    for name, t in workspace.targets.items():
        for role, pack in t["packs"].items():
            copy_pack(spark, pack, f"{out}/{name}/{role}")
        kept = {k: v for k, v in t.items() if k in ("kind", "config_name", "config_version", "source")}
        moved["targets"][name] = {**kept, "packs": {role: f"{name}/{role}" for role in t["packs"]}}
    return packs.write_manifest(spark, out, {"format": "packwright_bundle_v1", "profile": workspace.profile, **moved})


def imported(spark: SparkSession, folder: str) -> Workspace:
    """The workspace of a bundle, its packs where the bundle lies."""
    saved, base = packs.read_manifest(spark, folder), folder.rstrip("/")
    place = lambda found: {role: f"{base}/{path}" for role, path in found.items()}
    targets = {name: {**t, "packs": place(t["packs"])} for name, t in saved["targets"].items()}
    return Workspace(saved.get("profile", "base"), place(saved["packs"]), targets)


def _zipped(root: str, out: str):
    """Writes parts from rows (part, rel_path) in order: entries stream in chunks, a part gets its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        target, to = opened(out)
        rows = ((p, n) for b in batches for p, n in zip(b.column("part").to_pylist(), b.column("rel_path").to_pylist(), strict=True))
        part, done, sink, zipped = None, [], None, None

        def close() -> None:
            if part is not None:
                zipped.close()
                sink.close()
                target.move(f"{to}/{part}.zip.part", f"{to}/{part}.zip")

        for name, path in rows:
            if name != part:
                close()
                part = name
                target.create_dir(to, recursive=True)
                sink = target.open_output_stream(f"{to}/{part}.zip.part")
                zipped = zipfile.ZipFile(io.BufferedWriter(sink, CHUNK), "w", zipfile.ZIP_STORED)  # tables are compressed already
            entry, digest, size = zipfile.ZipInfo(path, TIME), hashlib.sha256(), 0
            entry.external_attr = 0o644 << 16
            with store.open_input_stream(f"{base}/{path}") as source, zipped.open(entry, "w", force_zip64=True) as into:
                while chunk := source.read(CHUNK):
                    into.write(chunk)
                    digest.update(chunk)
                    size += len(chunk)
            done.append((f"{part}.zip", path, size, digest.hexdigest()))
        close()
        columns = zip(*done, strict=True) if done else [[]] * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["part", "rel_path", "size", "sha256"])

    return run


def archive(spark: SparkSession, folder: str, out: str, part_bytes: int = PART_BYTES) -> dict:
    """A folder as zip parts in another one, with an index of digests; the same folder gives the same bytes.

    Files are dealt to parts by a hash of their paths and each part is written by one task, in order of paths and in chunks.
    Names that start with a dot, and success marks, are left out.
    """
    name = F.substring_index("rel_path", "/", -1)
    files = listing(spark, folder).where(~F.col("is_dir") & ~name.startswith(".") & (name != "_SUCCESS")).select("rel_path", "length")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    dealt = files.withColumn("part", F.format_string("part-%05d", F.crc32(F.col("rel_path").cast("binary")) % parts))
    ordered = dealt.repartition(parts, "part").sortWithinPartitions("part", "rel_path").select("part", "rel_path")
    ordered.mapInArrow(_zipped(folder, out), "part string, rel_path string, size long, sha256 string").write.mode("overwrite").json(f"{out}/index")
    found = spark.read.schema("part string, rel_path string, size long, sha256 string").json(f"{out}/index")
    sums = found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_distinct("part").alias("parts")).first()
    return packs.write_manifest(spark, out, {"format": FORMAT, **sums.asDict()})


def _extracted(root: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(root)
        target, to = opened(out)
        for batch in batches:
            rows = []
            for part in batch.column("part").to_pylist():
                with store.open_input_file(f"{base}/{part}") as f, zipfile.ZipFile(f) as z:
                    for entry in z.infolist():
                        parts = entry.filename.split("/")
                        if "" in parts or ".." in parts or "\\" in entry.filename:
                            raise ValueError(f"no path inside a folder: {entry.filename}")
                        digest = hashlib.sha256()
                        target.create_dir("/".join([to, *parts[:-1]]), recursive=True)
                        with z.open(entry) as source, target.open_output_stream(f"{to}/{entry.filename}") as into:
                            while chunk := source.read(CHUNK):
                                into.write(chunk)
                                digest.update(chunk)
                        rows.append((entry.filename, digest.hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["rel_path", "found"])

    return run


def unpack(spark: SparkSession, folder: str, out: str) -> int:
    """Puts an archive's files below another folder, a part in each task; returns how many. Missing or altered files are an error."""
    if packs.read_manifest(spark, folder).get("format") != FORMAT:
        raise ValueError(f"no archive: {folder}")
    index = spark.read.schema("part string, rel_path string, size long, sha256 string").json(f"{folder}/index")
    parts = index.select("part").distinct()
    written_files: DataFrame = parts.mapInArrow(_extracted(folder, out), "rel_path string, found string")
    both = index.join(written_files, "rel_path", "full")
    row = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("sha256").eqNullSafe(F.col("found"))).alias("bad")).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} files of {folder} are missing or altered")
    return row["n"]

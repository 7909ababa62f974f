"""Discovery of help books: which folders hold which version, and the containers in the wanted languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.functions.paths import file_name
from packwright.functions.text import is_version, language_of_file, safe_stem

#: Extension of a help container.
CONTAINER = "hbk"


def version_folders(listing: DataFrame, root: str, versions: list[str] | None = None) -> DataFrame:
    """(folder, version): the folders of a listing that hold help books; the root itself is the empty folder.

    With ``versions``, each has its best folder: of that name below the root, the root of that name, the root if it is
    a bin folder of that name's, then the first of that name anywhere below. Versions without one have no row. Without:
    the root if it, or the folder above its bin, is named like a version; else the version folders right below it; else
    all below; else the root under its own name. No file is read.
    """
    spark = listing.sparkSession
    parts = [p for p in root.replace("\\", "/").split("://")[-1].split("/") if p]
    own, above = (parts[-1] if parts else ""), (parts[-2] if len(parts) > 1 else "")
    in_bin = own.lower() == "bin"
    folders = listing.where(F.col("is_dir") & ~file_name(F.col("rel_path")).startswith("."))
    found = folders.select(F.col("rel_path").alias("folder"), file_name(F.col("rel_path")).alias("version"), F.size(F.split("rel_path", "/")).alias("depth"))
    if versions:
        wanted = spark.createDataFrame([(v.strip(),) for v in dict.fromkeys(versions) if v.strip()], "version string")
        ranked = found.select("folder", "version", F.when(F.col("depth") == 1, 0).otherwise(3).alias("rank"))
        roots = wanted.where(F.col("version") == own).select(F.lit("").alias("folder"), "version", F.lit(1).alias("rank"))
        if in_bin:
            roots = roots.unionByName(wanted.where(F.col("version") == above).select(F.lit("").alias("folder"), "version", F.lit(2).alias("rank")))
        best = Window.partitionBy("version").orderBy("rank", "folder")
        every = ranked.join(F.broadcast(wanted), "version").unionByName(roots)  # as many rows as versions were named
        return every.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("folder", "version")
    likely = found.where(is_version(F.col("version")))
    own_version = spark.createDataFrame([(own,), (above if in_bin else "",)], "version string").where(is_version(F.col("version"))).first()
    if own_version:
        return spark.createDataFrame([("", own_version["version"])], "folder string, version string")
    near = likely.where("depth = 1").select("folder", "version")
    if not near.isEmpty():
        return near
    far = likely.select("folder", "version")
    return far if not far.isEmpty() else spark.createDataFrame([("", own or "default")], "folder string, version string")


def help_books(listing: DataFrame, sources: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(rel_path, version, language, stem, label) of the containers in version folders, in the named languages (None: all).

    The language stands before the extension; containers without one are no books. A container below two version
    folders is a book of both. The label is the stem without its language.
    """
    files = listing.where(~F.col("is_dir") & F.lower("rel_path").endswith(f".{CONTAINER}")).select("rel_path")
    named = files.withColumn("language", language_of_file(file_name(F.col("rel_path")))).where("language is not null")
    if languages:
        named = named.where(F.col("language").isin([x.strip().lower() for x in languages]))
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = named.withColumn("folder", F.explode(above)).join(sources, "folder").drop("folder")
    stem = safe_stem("rel_path")
    return held.select("rel_path", "version", "language", stem.alias("stem"), F.regexp_replace(stem, "_[A-Za-z]{2}$", "").alias("label"))

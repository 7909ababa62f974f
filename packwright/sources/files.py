"""Scans of file trees: entries with hints, sniffed texts, compressed blobs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.functions import paths as P
from packwright.functions.text import compact, without_embedded_images
from packwright.operators.tree import folders
from packwright.sources import listing

#: Encodings of old text files, tried in this order.
ENCODINGS = ("utf-8", "cp1251", "cp866", "latin-1")
HTML_BYTES = 10 * 1024 * 1024
_CYRILLIC, _BOXES = re.compile("[\u0400-\u04ff]+"), re.compile("[─-╿]")


def scan(spark: SparkSession, root: str, pattern: str = "*", hidden: bool | None = None) -> DataFrame:
    """rel_path, length, modified, content of every file below a folder; content is read only where it is used.

    Spark's reader passes over names that start with a dot or an underscore; those come from the listing source, if the
    root is a local path or ``hidden`` says so (stores that pyarrow opens).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    rel = F.expr(
        "substring(path, instr(path, _base) + length(_base) + 1)"
    )
    seen = files.withColumn("_base", base).select(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("rel_path"), "length", F.col("modificationTime").alias("modified"), "content")
    if hidden is None:
        hidden = "://" not in root or root.startswith("file:")
    return seen.unionByName(listing.hidden_files(spark, root, pattern)) if hidden else seen


def empty_folders(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path) of folders without anything in them."""
    rows = listing.listing(spark, root)
    parents = rows.where(F.contains("rel_path", F.lit("/"))).select(F.regexp_replace("rel_path", "/[^/]*$", "").alias("rel_path"))
    return rows.where("is_dir").select("rel_path").join(parents, "rel_path", "left_anti")


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("encoding", T.StringType()))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Text and encoding of bytes without NUL that are UTF-8 or else Windows Cyrillic; nulls for binary data."""

    def one(b: bytes | None) -> tuple[str | None, str | None]:
        if b is None or b"\0" in b:
            return None, None
        for e in ("utf-8", "cp1251"):
            try:
                return b.decode(e), e
            except UnicodeDecodeError:
                continue
        return None, None

    return pd.DataFrame([one(b) for b in content], columns=["text", "encoding"])


def _garbled(text: str) -> bool:
    """Whether UTF-8 bytes look as if they had been read as an old encoding, by the Cyrillic letters of the whole text.

    Markup and other letters don't count, however many there are; a text of under ten Cyrillic letters goes by all but blanks.
    """
    if text.isascii():
        return False
    if bad := text.count("Р") + text.count("С"):
        letters = len(text) - len(_CYRILLIC.sub("", text))
        if bad > 0.25 * (letters if letters >= 10 else len("".join(text.split()))):
            return True
    return len(_BOXES.findall(text)) > 5


@F.pandas_udf(T.StringType())
def old_text(content: pd.Series) -> pd.Series:
    """Text of a page in any of the old encodings; garbled text is read once more the other way round."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for e in ENCODINGS:
            try:
                text = b.decode(e)
            except UnicodeDecodeError:
                continue
            if _garbled(text):
                try:
                    return text.encode("cp1251").decode("utf-8")
                except (UnicodeEncodeError, UnicodeDecodeError):
                    pass
            return text
        return b.decode("utf-8", "replace")

    return content.map(one)


def charset(content_type: Column, content: Column) -> Column:
    """A page's charset, lower case: as its header says, else as its first 8192 bytes say, else UTF-8 if it is, else Windows Cyrillic."""
    said = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)(?:^|;)\s*charset=\s*[\"']?([^;\"'\s]*)", 1)
    head = F.regexp_replace(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), r"[^\x00-\x7F]", "")
    meta = F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)
    guess = F.when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("windows-1251")
    return F.lower(F.coalesce(F.nullif(said, F.lit("")), F.nullif(meta, F.lit("")), guess))


def entries(files: DataFrame, excerpt: int = 400, empty: DataFrame | None = None) -> DataFrame:
    """One row per file and folder: kind, name, size, digest, text kind, hints, excerpt and exclusion reason.

    Folders are those above the files, and the ``empty`` ones (rel_path).
    """
    head = F.lower(F.decode(F.substring("content", 1, 1_000_000), "ISO-8859-1"))
    ext = P.extension(F.col("rel_path"))
    text = F.when(ext.isin(*P.TEXT_EXTENSIONS), decoded("content"))
    rows = files.withColumn("_d", text).withColumn("excluded_reason", P.exclusion_reason(F.col("rel_path"), F.col("length"), head))
    hint = P.object_hint(F.col("rel_path"), F.lit(True))
    of_files = rows.select(
        "rel_path", F.lit("file").alias("entry_type"), P.file_name(F.col("rel_path")).alias("name"), ext.alias("ext"), F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"), F.when(F.col("_d.text").isNotNull(), "text").otherwise("binary").alias("content_kind"),
        F.col("_d.encoding").alias("text_encoding"), hint["object_type"].alias("object_type"), hint["object_name"].alias("object_name"),
        compact(without_embedded_images(F.col("_d.text")), excerpt).alias("text_excerpt"), "excluded_reason",
    )
    dir_hint = P.object_hint(F.col("folder"), F.lit(False))
    every = folders(files, "rel_path")
    if empty is not None:
        every = every.unionByName(tree_with_parents(empty)).distinct()
    of_dirs = every.select(
        F.col("folder").alias("rel_path"), F.lit("dir").alias("entry_type"), P.file_name(F.col("folder")).alias("name"), F.lit("").alias("ext"), F.lit(0).cast("long").alias("size_bytes"),
        dir_hint["object_type"].alias("object_type"), dir_hint["object_name"].alias("object_name"),
    )
    return of_files.unionByName(of_dirs, allowMissingColumns=True)


def tree_with_parents(empty: DataFrame) -> DataFrame:
    """(folder): the given folders and all above them."""
    own = empty.select(F.col("rel_path").alias("folder"))
    return own.unionByName(folders(own, "folder"))


@F.pandas_udf(T.BinaryType())
def compressed(content: pd.Series) -> pd.Series:
    import zstandard

    c = zstandard.ZstdCompressor(level=10)
    return content.map(lambda b: None if b is None else c.compress(b))


@F.pandas_udf(T.BinaryType())
def decompressed(blob: pd.Series) -> pd.Series:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return blob.map(lambda b: None if b is None else d.decompress(b))


def blobs(files: DataFrame) -> DataFrame:
    """rel_path, data, blob_size: each file's bytes, compressed by themselves."""
    data = files.select("rel_path", compressed("content").alias("data"))
    return data.withColumn("blob_size", F.length("data").cast("long"))


def bytes_of(pack_blobs: DataFrame, rel_path: str) -> bytes:
    """A file's bytes out of a pack, text or not."""
    row = pack_blobs.where(F.col("rel_path") == rel_path).select(decompressed("data").alias("raw")).first()
    if row is None or row["raw"] is None:
        raise FileNotFoundError(f"no file in the pack: {rel_path}")
    return bytes(row["raw"])


def text_of(pack_entries: DataFrame, pack_blobs: DataFrame, rel_path: str) -> str:
    """A text file's text out of a pack; bytes that don't fit the recorded encoding are replaced."""
    row = (
        pack_entries.where((F.col("rel_path") == rel_path) & (F.col("entry_type") == "file"))
        .join(pack_blobs.where(F.col("rel_path") == rel_path), "rel_path", "left")
        .select("text_encoding", decompressed("data").alias("raw"))
        .first()
    )
    if row is None or row["raw"] is None or row["text_encoding"] is None:
        raise FileNotFoundError(f"no text in the pack: {rel_path}")
    return bytes(row["raw"]).decode(row["text_encoding"], "replace")


def is_page(path: Column, content: Column) -> Column:
    """Files that hold HTML: by extension, or without one if they start like a page."""
    start = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    ext = P.extension(path)
    plain = (ext == "") & (start.contains("<html") | start.contains("<!doctype"))
    return ~P.file_name(path).startswith(".") & (ext.isin("html", "htm") | plain) & (F.length(content) <= HTML_BYTES)

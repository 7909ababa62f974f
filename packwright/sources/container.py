"""Help containers: the files inside one, its contents tree, and plain zip archives."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from packwright.operators.tree import breadcrumbs

END = 0x7FFFFFFF
_BLOCK = re.compile(rb"\r\n([0-9a-fA-F]{8}) ([0-9a-fA-F]{8}) ([0-9a-fA-F]{8}) \r\n")


def chain(data: bytes, at: int) -> bytes:
    """The payload of a chain of blocks: each has its payload's size, its own size and the next block's place."""
    out, wanted, seen = b"", None, set()
    while at not in seen:
        seen.add(at)
        head = _BLOCK.match(data, at)
        if head is None:
            raise ValueError(f"no block at {at}")
        payload, size, following = (int(x, 16) for x in head.groups())
        wanted = payload if wanted is None else wanted
        out += data[head.end() : head.end() + min(size, wanted - len(out))]
        if len(out) >= wanted or following in (END, 0xFFFFFFFF):
            break
        at = following
    return out


def entities(data: bytes) -> dict[str, bytes]:
    """Named bodies of a container: a 16-byte header, then a chain of 12-byte descriptions."""
    table, found = chain(data, 16), {}
    for head, body, mark in struct.iter_unpack("<iii", table[: len(table) // 12 * 12]):
        if mark != END or body in (END, -1):
            continue
        try:
            name = chain(data, head)[20:-4].decode("utf-16-le", "replace").strip("\0")
            found[name] = chain(data, body)
        except ValueError:
            continue
    return found


def members(data: bytes) -> list[tuple[str, bytes]]:
    """Files of an archive: a container's file storage, a zip with or without bytes before it, or what zip headers show."""
    try:
        data = entities(data).get("FileStorage", data)
    except (ValueError, struct.error):
        pass
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error):
        return _by_headers(data)


def _by_headers(data: bytes) -> list[tuple[str, bytes]]:
    """Stored and deflated files after local headers, for archives without a readable directory."""
    out, names, at = [], {}, data.find(b"PK\x03\x04")
    while at >= 0 and at + 30 <= len(data):
        method, packed, n, extra = (*struct.unpack_from("<H", data, at + 8), *struct.unpack_from("<I", data, at + 18), *struct.unpack_from("<HH", data, at + 26))
        raw, start = data[at + 30 : at + 30 + n], at + 30 + n + extra
        name = raw.decode("utf-8", "replace")
        try:
            body = zlib.decompressobj(-15).decompress(data[start:]) if method == 8 else data[start : start + packed] if method == 0 else None
        except zlib.error:
            body = None
        if body is not None and name and not name.endswith("/"):
            k = names[name] = names.get(name, -1) + 1
            out.append((f"{name}_{k}" if k else name, body))
        at = data.find(b"PK\x03\x04", at + 4)
    return out


def contents_text(data: bytes) -> str:
    """The contents of a container, which it holds as an archive of one file; empty if it has none."""
    try:
        packed = entities(data).get("PackBlock", b"")
    except (ValueError, struct.error):
        packed = b""
    found = members(packed)
    return found[0][1].decode("utf-8-sig", "replace") if found else ""


@F.pandas_udf(StringType())
def _contents_texts(content: pd.Series) -> pd.Series:
    return content.map(lambda c: contents_text(bytes(c)))


def contents_texts(files: DataFrame) -> DataFrame:
    """(archive, text): the contents of each container."""
    return files.select(F.col("rel_path").alias("archive"), _contents_texts("content").alias("text"))


def unpacked(files: DataFrame) -> DataFrame:
    """(archive, rel_path, content): the files inside archives, one archive at a time in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["rel_path"], b["content"], strict=True):
                yield pd.DataFrame([(path, n, body) for n, body in members(bytes(content))], columns=["archive", "rel_path", "content"])

    return files.select("rel_path", "content").mapInPandas(run, "archive string, rel_path string, content binary")


_CHUNK = re.compile(r'\{\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*((?:,\s*\d+\s*)*),\s*\{\s*\d+\s*,\s*\d+\s*,\s*\{\s*\d+\s*,\s*\d+((?:\s*,\s*\{\s*"(?:[^"]|"")*"\s*,\s*"(?:[^"]|"")*"\s*\})*)\s*\}\s*,\s*"((?:[^"]|"")*)"\s*\}\s*\}')
_NAME = re.compile(r'\{\s*"((?:[^"]|"")*)"\s*,\s*"((?:[^"]|"")*)"\s*\}')


def contents(text: str) -> list[tuple[int, int, str, str, str]]:
    """(id, parent, path, title_ru, title_en) of each entry of a contents text; quotes inside names are doubled."""
    rows = []
    for m in _CHUNK.finditer(text.removeprefix("﻿")):
        names = {k: v.replace('""', '"') for k, v in _NAME.findall(m[5])}
        rows.append((int(m[1]), int(m[2]), m[6].replace('""', '"'), names.get("ru", names.get("", "")), names.get("en", "")))
    return rows


def contents_rows(texts: DataFrame, book: str, text: str) -> DataFrame:
    """(book, id, parent, path, title): contents entries of every book; Russian titles first, then English."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b["book"], b["text"], strict=True) for r in contents(t or "")]
            yield pd.DataFrame(rows, columns=["book", "id", "parent", "path", "title_ru", "title_en"])

    source = texts.select(F.col(book).alias("book"), F.col(text).alias("text"))
    out = source.mapInPandas(run, "book string, id long, parent long, path string, title_ru string, title_en string")
    return out.withColumn("title", F.coalesce(F.nullif("title_ru", F.lit("")), "title_en"))


def contents_paths(rows: DataFrame) -> DataFrame:
    """rows with the titles above each, and whether its parent's title names methods, properties or types."""
    key = lambda c: F.concat_ws("#", "book", F.col(c).cast("string"))
    known = rows.select(key("id").alias("_id"))
    nodes = rows.select(key("id").alias("id"), key("parent").alias("parent"), "title").join(known, F.col("parent") == F.col("_id"), "left")
    crumbs = breadcrumbs(nodes.select("id", F.col("_id").alias("parent"), "title"), "id", "parent", "title")
    joined = rows.withColumn("_key", key("id")).join(crumbs.select(F.col("id").alias("_key"), F.expr("slice(breadcrumb, 1, size(breadcrumb) - 1)").alias("breadcrumb")), "_key").drop("_key")
    last = F.lower(F.coalesce(F.try_element_at("breadcrumb", F.lit(-1)), F.lit("")))
    kind = F.when(last.rlike("метод|method"), "method").when(last.rlike("свойств|propert"), "property").when(last.rlike("тип|type"), "type").otherwise("topic")
    return joined.withColumn("entity_type", kind)


def with_aliases(rows: DataFrame) -> DataFrame:
    """Each path and, for pages, the same without its extension, as keys for lookups."""
    return rows.withColumn("key", F.explode(F.array_distinct(F.array("path", F.regexp_replace("path", r"\.html$", "")))))

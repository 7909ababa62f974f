import json

import pytest
from pyspark.sql import functions as F

from packwright.functions import text as T
from packwright.operators import fts
from packwright.sources import config_xml, files, pages, unpacked


@pytest.fixture(scope="module")
def help_tree(tmp_path_factory, spark):
    root = tmp_path_factory.mktemp("unpacked")
    toc = [
        {"path": "/a/Get.html", "title_ru": "old"},
        {"path": "/a/Get.html", "title_ru": "", "title_en": "Get", "entity_type": "method", "breadcrumb": ["Types", "Conn"]},
        {"path": "", "title_ru": "no path"},
    ]
    made = {
        "8.3.1/book/hbk_info.json": json.dumps({"language": "ru", "label": "Book"}),
        "8.3.1/book/toc.json": json.dumps(toc),
        "8.3.1/book/a/Get.html": "<html>x</html>",
        "8.3.1/book/a/b.c.html": "<html>y</html>",
        "old/bare/page": "<!DOCTYPE html><html>z</html>",
        "old/bare/toc.json": "{broken",
        "old/bare/picture.png": "p",
        "old/loose.html": "<html>in no book</html>",
    }
    for name, body in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body, encoding="utf-8")
    return files.scan(spark, str(root))


def test_pages_of_unpacked_books(help_tree):
    rows = {r["path"]: r for r in unpacked.topics(help_tree).collect()}
    assert sorted(rows) == ["8.3.1/book/a/Get.html", "8.3.1/book/a/b.c.html", "old/bare/page"]
    r = rows["8.3.1/book/a/Get.html"]
    assert (r["title"], r["language"], r["version"], r["book_label"], r["entity_type"], r["breadcrumb"]) == ("Get", "ru", "8.3.1", "Book", "method", ["Types", "Conn"])
    r = rows["8.3.1/book/a/b.c.html"]
    assert (r["title"], r["entity_type"], r["breadcrumb"]) == ("b.c", "topic", [])
    r = rows["old/bare/page"]
    assert (r["title"], r["language"], r["version"], r["book_label"]) == ("page", "", "old", "bare")


def test_names_and_noise(spark):
    rows = spark.createDataFrame(
        [
            (1, "Get (Get)", "method", ["Conn", "Методы", "get"], "Get (x)\n\n conn \r\nbody\x0bМетоды\nlast"),
            (2, "A.Get", "method", ["Conn"], "a.get"),
            (3, "Get", "topic", ["Conn"], None),
            (4, "Get", "event", None, ""),
        ],
        "id int, title string, kind string, crumb array<string>, body string",
    )
    out = rows.select("id", T.qualified_name(F.col("title"), F.col("kind"), F.col("crumb")).alias("q"), T.without_title_lines("body", F.col("title"), F.col("crumb")).alias("b"))
    got = {r["id"]: (r["q"], *r["p"], r["b"]) for r in out.withColumn("p", T.name_parts("q")).collect()}
    assert got == {1: ("Conn.Get", "Conn", "Get", "body\nlast"), 2: ("A.Get", "A", "Get", ""), 3: ("Get", "", "Get", ""), 4: ("Get", "", "Get", "")}


def test_owner_stubs(spark):
    members = spark.createDataFrame([("A", "1", "ru"), ("A", "1", "ru"), ("A", "2", "ru"), ("", "1", "ru"), (None, "1", "ru"), ("B", "1", "ru")], "owner_name string, version string, language string")
    objects = spark.createDataFrame([("A", "1", "ru")], "object_name string, version string, language string")
    got = unpacked.owner_stubs(members, objects).collect()
    assert sorted((r["full_name"], r["version"], r["resolver_kind"], r["description"]) for r in got) == [("A", "2", "stub", ""), ("B", "1", "stub", "")]


def test_export_sniffing(spark):
    texts = ["\ufeff<?xml version='1.0'?>\n<!-- <x> -->\n<v:Конфигурация a='1'>", "<Конфигурация/>", "<Конфигурации>", "<a><Конфигурация/></a>", "", "<!-- <Конфигурация> -->"]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)] + [(9, None)], "i int, content binary")
    got = {r["i"]: r["x"] for r in rows.select("i", config_xml.is_export(F.col("content")).alias("x")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 9: False}


def test_dotted_query():
    assert fts.dotted_query_tokens(" Conn.Get  a_b ") == ["Conn", "Get", "a_b"]


def test_inline_sections_of_plain_texts(spark):
    texts = ["Intro\nОписание: a\n b Пример:\nОписание варианта метода: c", "no labels", "", None, "Поля:"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pages.inline_sections("t").alias("s"))
    got = {r["i"]: (r["s"]["intro"], r["s"]["sections"]) for r in rows.collect()}
    assert got == {0: ("Intro", {"description": "a\n b\n\nc"}), 1: ("no labels", {}), 2: ("", {}), 3: ("", {}), 4: ("", {})}


def test_charset(spark):
    page = "<html><META http-equiv=x content='text/html; charset=KOI8-R'>".encode()
    cases = [("text/html; Charset='UTF-8'", page), ("text/html", page), (None, "я".encode()), ("", "я".encode("cp1251")), (None, b""), (None, None)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h string, c binary").select("i", files.charset(F.col("h"), F.col("c")).alias("x"))
    assert [r["x"] for r in rows.orderBy("i").collect()] == ["utf-8", "koi8-r", "utf-8", "windows-1251", "utf-8", "windows-1251"]

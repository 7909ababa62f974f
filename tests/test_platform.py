import io
import struct
import zipfile

import pytest
from test_sources import PAGE, _block

from packwright import cli
from packwright.functions import paths as P
from packwright.sources import api_records, container, help_topics

PLAIN = "<html><h1>Соединение (Connection)</h1><p>Соединение (x)</p><p>Описание: Holds a line. Доступность: Сервер. Пример: none</p></html>"
ARTICLE = "<html><h1>Reading</h1><p>How to read.</p><p>Types</p></html>"
PROPERTY = '<html><h1 class="V8SH_pagetitle">Адрес (Address)</h1><p class="V8SH_chapter">Описание:</p>Тип: Строка. <p class="V8SH_chapter">Примечание:</p>Только на клиенте.</html>'
TOC = """﻿{4,{1,0,0,{1,1,{1,0,{"ru","Соединение"},{"en","Connection"}},"/objects/Conn.html"}},{2,1,0,{1,1,{1,0,{"ru","Методы"}},""}},
{3,2,0,{1,1,{1,0,{"ru","Получить"},{"en","Get"}},"/objects/Conn/methods/get.html"}},{4,1,0,{1,1,{1,0,{"ru",""},{"en","Address"}},"/objects/Conn/properties/address.html"}}}"""
FILES = {"objects/Conn.html": PLAIN, "objects/Conn/methods/get.html": PAGE, "objects/Conn/properties/address.html": PROPERTY, "notes/zif1_a.html": ARTICLE, "notes/empty.html": "", "pic.png": "x"}


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _container(parts: dict[str, bytes]) -> bytes:
    at = 16 + 31 + 12 * len(parts)
    rows, bodies = b"", b""
    for name, data in parts.items():
        head = _block(b"\0" * 20 + name.encode("utf-16-le") + b"\0" * 4)
        rows += struct.pack("<iii", at + len(bodies), at + len(bodies) + len(head), container.END)
        bodies += head + _block(data)
    return b"\0" * 16 + _block(rows) + bodies


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    data = _container({"FileStorage": _zip(FILES), "PackBlock": _zip({"toc": TOC})})
    for version in ("8.3.9", "8.3.10"):
        (root / version / "bin").mkdir(parents=True)
        (root / version / "bin" / "shcntx_ru.hbk").write_bytes(data)
        (root / version / "bin" / "shcntx_en.hbk").write_bytes(_zip({"x.html": ARTICLE}))
    return str(root)


def test_pages_of_containers(spark, books):
    rows = {(r["version"], r["path"]): r for r in help_topics.of_books(spark, books, languages=["ru"]).collect()}
    assert len(rows) == 10
    r = rows["8.3.10", "shcntx_ru/objects/Conn/methods/get.html"]
    assert (r["title"], r["entity_type"], r["breadcrumb"], r["book_label"], r["language"]) == ("Получить", "method", ["Соединение", "Методы"], "shcntx", "ru")
    assert rows["8.3.9", "shcntx_ru/notes/zif1_a.html"]["title"] == "Reading"
    assert help_topics.of_books(spark, books, versions=["8.3.9"]).count() == 6 and help_topics.of_books(spark, books, versions=["9.9.9"]).count() == 0


def test_platform_pack_of_containers(spark, books, tmp_path, capsys):
    (tmp_path / "w.json").write_text("{}")
    out = str(tmp_path / "w")
    assert cli.main([str(tmp_path / "w.json"), "build-kb", "--books", books, "--languages", "ru", "--out", out]) == 0
    read = lambda name: spark.read.parquet(f"{out}/platform/{name}")
    members = {r["full_name"]: r for r in read("members").collect()}
    assert sorted(members) == ["Соединение.Адрес", "Соединение.Получить"]
    get, address = members["Соединение.Получить"], members["Соединение.Адрес"]
    assert (get["owner_name"], get["member_name"], get["kind"], get["versions"]) == ("Соединение", "Получить", "method", ["8.3.10", "8.3.9"])
    assert get["description"] == get["summary"] == "Gets it." and get["returns"] == "Тип: Строка, Число." and get["value_types"] == ["Строка", "Число"]
    assert get["aliases"] == ["Получить (Get)", "Get"] and get["page_descriptor"] == "[метод, 8.3.13]"
    assert (address["kind"], address["syntax"], address["returns"], address["restrictions"]) == ("property", "Соединение.Адрес", "Строка", "Только на клиенте.")
    # The contents name no page of another version, so both versions' objects are one; no stub is needed beside it.
    objects = {r["full_name"]: r for r in read("objects").collect()}
    assert list(objects) == ["Соединение"] and objects["Соединение"]["aliases"] == ["Соединение", "Соединение (Connection)", "Connection"]
    conn = objects["Соединение"]
    assert (conn["kind"], conn["description"], conn["availability"], conn["resolver_kind"]) == ("type", "Holds a line.", "Сервер.", "platform_object")
    assert [(r["title"], r["code"]) for r in read("examples").collect()] == [("Получить (Get) — пример 1", "a = 1;\nb = 2;")]
    topics = read("topics").collect()
    assert [(r["title"], r["kind"], r["description"]) for r in topics] == [("Reading", "cli_help", "How to read.\nTypes")]
    edges = {(r["target_name"], r["link_kind"]): r["versions"] for r in read("links").collect()}
    assert edges["Закрыть", "see_also"] == ["8.3.10", "8.3.9"] and ("Открыть", "see_also") in edges
    saved = f"{out}/workspace/manifest"
    capsys.readouterr()
    for what, q, found in (("members", "get", "Соединение.Получить"), ("objects", "connection", "Holds a line."), ("examples", "соединение.получить", "a = 1;"), ("related", "Соединение.Получить", "Закрыть")):
        assert cli.main([saved, "query-api", what, "--q", q]) == 0 and found in capsys.readouterr().out
    assert cli.main([saved, "query-api", "members", "--q", "get", "--version", "8.2.1"]) == 0 and capsys.readouterr().out.strip() == ""
    assert cli.main([saved, "query-kb", "--q", "how to read"]) == 0 and "api_topics" in capsys.readouterr().out
    assert cli.main([saved, "benchmark", "--loops", "2"]) == 0 and '"runs": 6' in capsys.readouterr().out


TOPICS = "key long, path string, title string, version string, language string, book_label string, entity_type string, breadcrumb array<string>, html string"


def _records(spark, *rows):
    filled = [(i, path, title, "8.3", "ru", label, kind, crumb, html) for i, (path, title, label, kind, crumb, html) in enumerate(rows)]
    return api_records.with_stubs(api_records.with_surface(api_records.records(spark.createDataFrame(filled, TOPICS))))


def test_roles_kinds_stubs_and_edge_cases(spark):
    shaped = '<h1 class="V8SH_pagetitle">A.B</h1><p class="V8SH_chapter">Синтаксис:</p>B()'
    made = _records(
        spark,
        ("x/a.html", "", "", "topic", None, shaped),  # a dotted name with syntax is a method
        ("x/b.html", "B", "", "topic", None, shaped.replace("A.B", "B")),  # a plain one is an article
        ("x/c.html", "B", "embedlang_ru", "topic", None, shaped.replace("A.B", "C")),  # in a book of the language a method
        ("shlang_ru/d.html", "", "shlang_ru", "topic", None, shaped.replace("A.B", "D.E")),  # an operator of the language stays an object
        ("o/methods/f.html", "", "", "topic", [], "<h1>Встроенные функции языка.F</h1>"),
        ("o/g.html", "", "", "topic", [], "<h1>G.По умолчанию</h1>"),
        ("o/tables/h.html", "H", "", "topic", [], shaped),
        ("nothing.html", None, None, None, None, None),
        ("long.html", "L", "", "topic", None, "<h1>L</h1>" + "<p>" + "word " * 50_000 + "</p>"),
    )
    got = {(r["topic_path"], r["full_name"]): (r["role"], r["kind"], r["owner_name"]) for r in made.collect()}
    assert got["x/a.html", "A.B"] == ("member", "method", "A") and got["", "A"][:2] == ("object", "type")
    assert got["x/b.html", "B"][:2] == ("topic", "article") and got["x/c.html", "C"] == ("member", "method", "")
    assert got["shlang_ru/d.html", "D.E"][:2] == ("object", "language_topic")
    assert got["o/methods/f.html", "Встроенные функции языка.F"][:2] == ("member", "function") and got["o/g.html", "G.По умолчанию"][:2] == ("member", "constructor")
    assert got["o/tables/h.html", "A.B"][:2] == ("object", "table") and got["nothing.html", "nothing.html"][0] == "topic"
    long = made.where("topic_path = 'long.html'").first()
    assert len(long["description"]) == 249_999 and len(long["summary"]) == 500
    flat = {r["topic_path"]: r for r in api_records.flat_records(made).collect()}
    assert flat["x/a.html"]["syntax"] == "B()" and flat["shlang_ru/d.html"]["syntax"] == "" and flat["x/b.html"]["kind"] == "topic"
    assert len(flat["long.html"]["description"]) == 1200 and flat["nothing.html"]["description"] == ""
    assert _records(spark).count() == 0


def test_object_kinds(spark):
    cases = [
        ("/o/tables/a", "x", "table"), ("/shquery_ru/a", "", "query_topic"), ("/EMBEDLANG/a", None, "language_topic"), ("/a", "Глобальный контекст (Global)", "global_context"),
        ("/a", "ОбъектМетаданных: X", "metadata_object"), ("/a", "СправочникМенеджер.X", "manager"), ("/o/Global Context.html", "", "global_context"), ("/o/enums/a", "", "enum"),
        ("\\objects\\a", "Коллекция строк", "collection"), ("/objects/a", "A", "type"), (None, None, "topic"),
    ]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(cases, "p string, t string, k string").select("k", P.object_kind(F.col("p"), F.col("t")).alias("got"))
    assert [r["got"] for r in rows.collect()] == [c[2] for c in cases]


def test_pages_of_unpacked_books_become_records(spark, tmp_path):
    import json

    from packwright.sources import files

    folder = tmp_path / "8.3.1" / "shcntx_ru"
    (folder / "objects").mkdir(parents=True)
    (folder / "objects/get.html").write_text(PAGE, encoding="utf-8")
    (folder / "toc.json").write_text(json.dumps([{"path": "/objects/get.html", "title_ru": "Получить", "entity_type": "method", "breadcrumb": ["Conn"]}]))
    pages = help_topics.of_unpacked(files.scan(spark, str(tmp_path)))
    r = pages.first()
    assert (r["path"], r["version"], r["entity_type"], r["breadcrumb"]) == ("shcntx_ru/objects/get.html", "8.3.1", "method", ["Conn"]) and "Gets it." in r["html"]
    assert [(x["role"], x["full_name"]) for x in api_records.records(pages).collect()] == [("member", "Conn.Получить")]

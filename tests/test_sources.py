import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from packwright.functions import resolver
from packwright.plans import catalog, packs
from packwright.sources import code_modules, config_xml, container, files, markdown, pages, records

OBJECT = """<?xml version="1.0" encoding="UTF-8"?><MetaDataObject xmlns="http://v8.1c.ru/8.3/MDClasses" xmlns:v8="http://v8.1c.ru/8.1/data/core">
<Document><Properties><Name>D1</Name><Synonym><v8:item><v8:lang>ru</v8:lang><v8:content>Док</v8:content></v8:item></Synonym></Properties>
<ChildObjects><Attribute><Properties><Name>A1</Name><Type><v8:Type>xs:string</v8:Type></Type></Properties></Attribute>
<TabularSection><Properties><Name>T1</Name></Properties><ChildObjects><Attribute><Properties><Name>B1</Name></Properties></Attribute></ChildObjects></TabularSection>
</ChildObjects></Document></MetaDataObject>"""
FORM = '<Form xmlns="x"><Attributes><Attribute name="FA"/></Attributes><Commands><Command name="FC"/></Commands></Form>'
CODE = "\n\n// Adds up\n// two numbers\nFunction Sum(A,\n  B) Export\n  Total = Add(A, Neg(B, (1, 2)));\n  Obj.Call(1);\n  Return Total;\nEndFunction\n\nПроцедура Шаг()\n  Если Готово() Тогда Sum(1, 2); КонецЕсли;\nКонецПроцедуры\nVar X, Y Export;\n"
PAGE = """<html><head><title>t</title></head><body><h1 class="V8SH_pagetitle">Получить (Get)</h1>[метод, 8.3.13]
<p class="V8SH_chapter">Описание:</p>Gets it. <p class="V8SH_chapter">Параметры:</p><div class="V8SH_rubric">x</div>- **Имя** (Строка) — name
<p class="V8SH_chapter">Возвращаемое значение:</p>Тип: Строка, Число. <p class="V8SH_chapter">Пример:</p><pre>a = 1;
b = 2;</pre><p class="V8SH_chapter">См. также:</p><a href="q.html">Закрыть</a><br><a href="r.html">Открыть</a><script>x("</p>")</script><p><b>open"""


@pytest.fixture(scope="module")
def tree_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    made = {
        "Configuration.xml": '<MetaDataObject><Configuration><Properties><Name>Conf</Name><Version>1.2</Version></Properties></Configuration></MetaDataObject>',
        "Documents/D1.xml": OBJECT, "Documents/D1/Forms/F1/Ext/Form.xml": FORM, "CommonModules/M/Ext/Module.bsl": CODE, "a/pic.png": "x", "Documents/bad.xml": "<a>",
        "docs/one.md": "---\nid: 1\n---\n# Title\n\nSome text here.\n\n## Part\nbody\n```\n## not a part\n```\n## Next\nx", "docs/_skip.md": "# no", "a/пример файла.txt": "привет",
    }
    for name, text in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    (root / "a/old.txt").write_bytes("Привет, мир".encode("cp1251"))
    (root / "a/nul.txt").write_bytes(b"a\0b")
    return str(root)


@pytest.fixture(scope="module")
def tree(spark, tree_root):
    return files.scan(spark, tree_root).cache()


def test_entries_and_blobs(tree):
    e = {r["rel_path"]: r for r in files.entries(tree).collect()}
    assert e["a/old.txt"]["text_encoding"] == "cp1251" and e["a/old.txt"]["text_excerpt"] == "Привет, мир"
    assert e["a/nul.txt"]["content_kind"] == "binary" and e["a/pic.png"]["excluded_reason"] == "image-asset"
    assert e["a/пример файла.txt"]["text_excerpt"] == "привет" and e["Documents/D1"]["entry_type"] == "dir" and "docs" in e
    b = files.blobs(tree)
    assert b.select(F.sha2(files.decompressed("data"), 256).alias("s"), "rel_path").join(tree.select("rel_path", F.sha2("content", 256).alias("t")), "rel_path").where("s <> t").count() == 0
    assert files.text_of(files.entries(tree), b, "a/old.txt") == "Привет, мир"
    with pytest.raises(FileNotFoundError):
        files.text_of(files.entries(tree), b, "a/nul.txt")
    assert tree.where("rel_path = 'a/old.txt'").select(files.old_text("content").alias("t")).first()["t"] == "Привет, мир"


def test_markdown(tree):
    row = markdown.standards(tree, "v1").collect()
    assert [(r["name"], r["topic_path"], r["payload"][:15]) for r in row] == [("Title", "docs/one.md", "Some text here.")]
    parts = tree.where("rel_path = 'docs/one.md'").select(F.explode(markdown.sections(F.decode("content", "UTF-8"))).alias("s")).select("s.*").collect()
    assert [(p["heading"], p["body"]) for p in parts] == [("Part", "body\n```\n## not a part\n```"), ("Next", "x")]


def test_configuration(tree):
    r = config_xml.crawl(tree).cache()
    assert tuple(config_xml.identity(r).first()) == ("Conf", "1.2")
    assert [tuple(x) for x in config_xml.objects(r).collect()] == [("Document.D1", "Document", "D1", "Док", "Document.D1")]
    got = {(x["group"], x["name"], x["type"], x["form_name"], x["tabular_section"]) for x in config_xml.fields(r).collect()}
    assert got == {("requisites", "A1", "xs:string", None, None), ("tabular_sections", "T1", "", None, None), ("tabular_section_requisites", "B1", "", None, "T1"), ("form_attributes", "FA", "", "F1", None), ("form_commands", "FC", "", "F1", None)}
    docs = records.field_docs(config_xml.fields(r).withColumn("config_version", F.lit("1.2")).withColumn("defined_type", F.lit("")).withColumn("constant_bsl_hint", F.lit("")))
    assert "Document.D1.Forms.F1.FA" in {x["topic_path"] for x in docs.collect()}
    assert [x["root"] for x in config_xml.config_roots(tree).collect()] == [""]


def test_code(tree):
    m, s, c = code_modules.code_pack(code_modules.modules(tree))
    assert m.select("object_type", "object_name", "module_kind", "symbol_count").first() == ("CommonModules", "M", "Module", 4)
    got = [tuple(r)[1:] for r in s.orderBy("line", "name").collect()]
    assert got[0] == ("Sum", "function", 5, 10, True, "Function Sum(A,\n  B) Export", "Adds up two numbers")
    assert got[1][:4] == ("Шаг", "procedure", 12, 14) and got[2][:2] == ("X", "variable")
    calls = [tuple(r)[1:] for r in c.orderBy("line", "callee_name").collect()]
    assert ("Sum", "Add", 7, 2) in calls and ("Шаг", "Sum", 13, 2) in calls and not any(x[1] == "Call" for x in calls)


def test_pages(spark):
    df = spark.createDataFrame([(1, PAGE, "Получить (Get)", "o/methods/get.html", "8.3", "ru"), (2, None, "x", "y", "8.3", "ru")], "id long, html string, title string, path string, version string, language string")
    runs = pages.runs(df, "id", "html").cache()
    got = {(r["section"]): r["body"] for r in pages.sections(runs).collect()}
    assert got["description"] == "Gets it." and got["example"] == "```bsl\na = 1;\nb = 2;\n```"
    rec = {r["full_name"]: r for r in pages.records(df, runs, "id", title="title", path="path", version="version", language="language").collect()}["Получить"]
    assert rec["kind"] == "method" and rec["see_also"] == ["Закрыть", "Открыть"] and rec["value_types"] == ["Строка", "Число"] and rec["aliases"] == ["Get"]
    assert [tuple(p) for p in rec["params"]] == [("x", "", ""), ("Имя", "Строка", "name")] and rec["page_descriptor"] == "[метод, 8.3.13]"
    assert "## Описание:" in pages.markdown(runs).where("id = 1").first()["markdown"]


def _block(payload: bytes, following: int = container.END) -> bytes:
    return b"\r\n%08x %08x %08x \r\n" % (len(payload), len(payload), following) + payload


def test_container_round_trip(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        f.writestr("a/b.html", "hello" * 50)
    name = b"\0" * 20 + "FileStorage".encode("utf-16-le") + b"\0" * 4
    table_size = 31 + 12
    head = 16 + table_size
    body = head + 31 + len(name)
    data = b"\0" * 16 + _block(struct.pack("<iii", head, body, container.END)) + _block(name) + _block(z.getvalue())
    assert container.members(data) == [("a/b.html", b"hello" * 50)]
    assert container.members(b"junk" + z.getvalue()) == [("a/b.html", b"hello" * 50)]
    assert container._by_headers(z.getvalue()[:-40]) == [("a/b.html", b"hello" * 50)] and container.members(b"nothing") == []
    df = spark.createDataFrame([("x.hbk", bytearray(data))], "rel_path string, content binary")
    assert [(r["archive"], r["rel_path"]) for r in container.unpacked(df).collect()] == [("x.hbk", "a/b.html")]


def test_contents(spark):
    text = '{2,{1,0,1,2,{0,0,{0,0,{"ru","Методы ""A"""},{"en","Methods"}},""}},{2,1,0,{0,0,{0,0,{"ru","Взять"}},"m/get.html"}}}'
    rows = container.contents_rows(spark.createDataFrame([("b", text)], "book string, text string"), "book", "text")
    got = {r["id"]: r for r in container.contents_paths(rows).collect()}
    assert got[1]["title"] == 'Методы "A"' and got[2]["breadcrumb"] == ['Методы "A"'] and got[2]["entity_type"] == "method"
    assert {r["key"] for r in container.with_aliases(rows).where("id = 2").collect()} == {"m/get.html", "m/get"}


def test_export_joins(spark):
    rec = lambda tag, **f: f"<CatalogObject.{tag}>" + "".join(f"<{k}>{v}</{k}>" for k, v in f.items()) + f"</CatalogObject.{tag}>"
    xml = "<Конфигурация>" + rec("Объекты", Ref="o1", Тип="Документ", Имя="D") + rec("Объекты", Ref="o2", Тип="Прочее", Имя="Z") + rec("Объекты", Ref="o3", Тип="Справочник", Имя="Cat") + rec("Свойства", Ref="t1", Owner="o1", Вид="ТабличнаяЧасть", Имя="T") + rec("Свойства", Ref="p1", Owner="o1", Parent="t1", Вид="Реквизит", Имя="B", Типы="<Строка><Тип>o3</Тип></Строка><Строка><Тип>zz</Тип></Строка>") + rec("Свойства", Ref="p2", Owner="gone", Вид="Реквизит", Имя="N") + rec("Значения", Owner="o1", Имя="V") + "</Конфигурация>"
    r = config_xml.export_records(spark.createDataFrame([("e.xml", bytearray(xml.encode()))], "rel_path string, content binary")).cache()
    assert {x["id"] for x in config_xml.export_objects(r).collect()} == {"Document.D", "Catalog.Cat"}
    got = {x["name"]: (x["group"], x["tabular_section"], x["types"]) for x in config_xml.export_fields(r).collect()}
    assert got == {"T": ("tabular_sections", None, []), "B": ("tabular_section_requisites", "T", ["Cat", "zz"]), "V": ("values", None, None)}
    profile = {(x["measure"], x["key"]): x["n"] for x in config_xml.export_profile(r).collect()}
    assert profile[("missing", "owner")] == 1 and profile[("tag", "Свойства")] == 3


def test_records_tolerate_bad_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"full_name": "A.B", "versions": ["8.3.9", "8.3.10"], "summary": "s", "code": "c"}\n\n{bad\n{"title": "no versions"}\n', encoding="utf-8")
    rows = records.tolerant(spark, str(tmp_path / "r.jsonl"), records.HELP_SCHEMA)
    got = [(r["name"], r["version"], r["payload"]) for r in records.help_docs(rows, "api_members").collect()]
    assert got == [("A.B", "8.3.10", "s")]
    assert [r["version"] for r in records.help_docs(rows, "x", ["8.3.9"], extra=("code",)).collect()] == ["8.3.9"]
    with pytest.raises(Exception):
        records.strict(spark, str(tmp_path / "r.jsonl"), records.HELP_SCHEMA).collect()


def test_resolver(spark):
    df = spark.createDataFrame([("Документы.Заказ.Найти",), ("Метаданные.Справочники.К",), ("Нет.Такого",), ("Метаданные.СвойстваОбъектов.Хран",)], "q string")
    got = {r["q"]: [c["name"] for c in r["candidates"]] for r in resolver.resolved(df, "q").collect()}
    assert got["Документы.Заказ.Найти"][:3] == ["ДокументМенеджер.<Имя документа>.Найти", "Глобальный контекст.Документы", "ДокументыМенеджер"]
    assert got["Метаданные.Справочники.К"] == ["ОбъектМетаданныхКонфигурация.Справочники", "ОбъектМетаданных: Справочник", "Справочники.К", "Глобальный контекст.Метаданные", "ОбъектМетаданныхКонфигурация"]
    assert got["Нет.Такого"] == [] and got["Метаданные.СвойстваОбъектов.Хран"][1] == "Хран"


def test_packs_engine_and_rpc(spark, tree, tmp_path):
    from packwright.api import Engine
    from packwright.cli import answer, parser, plain
    from packwright.rpc import handle

    rows = spark.createDataFrame([("HTTP.Get", ["8.3.9", "8.3.10"], "gets a resource"), ("HTTP.Put", ["8.3.9"], "puts a resource")], "full_name string, versions array<string>, summary string")
    extra = spark.createDataFrame([], records.HELP_SCHEMA).unionByName(rows, allowMissingColumns=True)
    manifest = packs.write_docs([records.help_docs(extra, "api_members"), markdown.standards(tree, "v1")], str(tmp_path / "p"))
    assert manifest["domain_counts"] == {"api_members": 2, "standards": 1} and packs.read_manifest(spark, str(tmp_path / "p")) == manifest
    m, s, c = code_modules.code_pack(code_modules.modules(tree))
    packs.write_tables({"modules": m, "symbols": s, "calls": c}, str(tmp_path / "c"), "code")
    packs.write_tables({"entries": files.entries(tree), "blobs": files.blobs(tree)}, str(tmp_path / "f"), "config")
    w = catalog.Workspace("full", {"platform": str(tmp_path / "p")}, {"conf": {"packs": {"code": str(tmp_path / "c"), "full": str(tmp_path / "f")}, "source": {"files": 1}}})
    e = Engine(spark, w)
    assert [r["name"] for r in e.search("http.get").collect()] == ["HTTP.Get"] and e.search("puts resource").first()["name"] == "HTTP.Put"
    assert e.search("http.get", version="8.3.9").count() == 1 and e.search("HTTP.Put", version="8.3.10", exact=True).count() == 0
    assert e.code("callers", "sum").first()["line"] == 13 and e.code("symbols", "Sum").count() == 1 and e.code("modules", "M").count() == 1
    assert e.config("read", "a/old.txt") == "Привет, мир" and e.config("find", "Module.bsl").first()["rel_path"] == "CommonModules/M/Ext/Module.bsl"
    assert e.config("stats").where("entry_type = 'file'").first()["n"] == 11
    assert json.loads(plain(answer(e, parser().parse_args(["w", "query-code", "callees", "--q", "Sum"]))).split("\n")[0])["callee_name"] == "Add"
    ask = lambda m, p=None: handle(e, json.dumps({"id": 1, "method": m, "params": p or {}}))
    assert len(ask("tools/list")["result"]["tools"]) == 6 and handle(e, "{")["error"]["code"] == -32700 and handle(e, '{"method": "x"}') is None
    assert "HTTP.Get" in ask("tools/call", {"name": "query_kb", "arguments": {"q": "http.get"}})["result"]["content"][0]["text"]
    assert ask("tools/call", {"name": "query_kb", "arguments": {"q": "x", "role": "metadata"}})["result"]["isError"] and ask("nope")["error"]["code"] == -32000
    assert catalog.verify(packs.table(spark, str(tmp_path / "p"), "docs"), ["HTTP.Get"]).where("ok").count() == 2
    assert ("conf", "stale") in w.issues({"conf": {"files": 2}}, ["8.3.9"], ["8.3.11"]) and ("platform", "missing version 8.3.11") in w.issues({}, [], ["8.3.11"])


def test_catalog():
    w = catalog.Workspace(packs={"platform": "p"}, targets={"a": {"packs": {"code": "c1"}}, "b": {"packs": {"code": "c2"}}})
    assert w.resolve("code", "a") == "c1" and w.resolve_all() == {"platform": "p"} and not w.satisfies(["metadata"])
    with pytest.raises(LookupError):
        w.resolve("code")
    assert catalog.profile_for("base", ["code", "standards"]) == "dev" and catalog.profile_for("full", []) == "full"
    assert catalog.public({"a": ["/x/y/z", "rel/b"], "c": "C:\\k\\l"}) == {"a": ["z", "rel/b"], "c": "l"}


def test_stream_merges_batches(spark, tmp_path):
    from packwright.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"lang":"en","text":"a","version":"8.3.9","n":1}\n{"lang":"en","text":"b","version":"8.3.9","n":2}\n')
    (src / "2.json").write_text('{"lang":"en","text":"a ","version":"8.3.10","n":3}\n')
    stream = ingest.stream_records(spark, str(src), "lang string, text string, version string, n long", 1)
    ingest.merge_into(stream, str(tmp_path / "out"), str(tmp_path / "ck"), language="lang", content=["text"], version="version", order="n", suffix="s").awaitTermination()
    got = {r["text"].strip(): r["versions"] for r in ingest.latest(spark, str(tmp_path / "out"), 1).collect()}
    assert got == {"a": ["8.3.10", "8.3.9"], "b": ["8.3.9"]}
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert ingest.windowed_counts(e, "ts", "event_type").agg(F.sum("n")).first()[0] == e.count()


def test_records_without_versions_outlive_batches(spark, tmp_path):
    from packwright.streaming import ingest

    schema, folder = "lang string, text string, version string, n long", tmp_path / "in"
    folder.mkdir()
    for k, row in enumerate(('{"lang": "en", "text": "no version", "n": 1}', '{"lang": "en", "text": "other", "version": "1.0", "n": 2}')):
        (folder / f"{k}.json").write_text(row + "\n")
        stream = ingest.stream_records(spark, str(folder), schema)
        ingest.merge_into(stream, str(tmp_path / "out"), str(tmp_path / "ck"), language="lang", content=["text"], version="version", order="n", suffix="s").awaitTermination()
    assert {r["text"] for r in ingest.latest(spark, str(tmp_path / "out"), 1).collect()} == {"no version", "other"}


def test_phrases_from_postings(spark):
    from packwright.operators import fts

    rows = [(1, "of the sea", "x"), (2, "the of sea of", "the"), (3, "sea of the of the", "of the"), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    index, lengths = fts.postings(docs, "doc_id", ["text", "name"]), fts.document_lengths(docs, "doc_id", ["text", "name"])
    for q in ("of_the", "sea", "of_the sea", "the of", "none_at all", ""):
        scan = {r["doc_id"]: round(r["score"], 9) for r in fts.bm25(docs, "doc_id", ["text", "name"], q).collect()}
        assert {r["doc_id"]: round(r["score"], 9) for r in fts.bm25_indexed(index, lengths, q).collect()} == scan
    assert {r["doc_id"] for r in fts.bm25_indexed(index, lengths, "of_the").collect()} == {1, 3}


def test_pack_has_a_text_index(spark, tmp_path):
    from packwright.operators import fts
    from packwright.plans import packs

    rows = [("d", f"Name{i}", f"t/{i}", "8.3", ["8.3"], f"body of the text {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "domain string, name string, topic_path string, version string, versions array<string>, payload string")
    manifest = packs.write_docs([docs], str(tmp_path))
    assert manifest["text_index"]["n_docs"] == 5
    index = packs.table(spark, str(tmp_path), "postings")
    assert "IsNotNull(term), EqualTo(term,body)" in index.where("term = 'body'")._jdf.queryExecution().executedPlan().toString()
    found = fts.bm25_indexed(index, packs.table(spark, str(tmp_path), "lengths"), "of_the 3", manifest["text_index"])
    assert found.count() == 1


def test_search_blends_vectors(spark, tmp_path):
    from packwright.api import Engine

    rows = [("d", f"Name{i}", f"t/{i}", "8.3", ["8.3"], f"body {'rare' if i == 1 else 'plain'} {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "domain string, name string, topic_path string, version string, versions array<string>, payload string")
    packs.write_docs([docs], str(tmp_path))
    ids = {r["name"]: r["doc_id"] for r in packs.table(spark, str(tmp_path), "docs").collect()}
    rows = [(ids[f"Name{i}"], [1.0, float(i)]) for i in range(5)] + [(-1, [0.0, 1.0])]
    assert packs.write_vectors(spark.createDataFrame(rows, "doc_id long, vector array<double>"), str(tmp_path))["tables"] == ["vectors"]
    e = Engine(spark, catalog.Workspace("base", {"platform": str(tmp_path)}))
    assert [r["name"] for r in e.search("rare").collect()] == ["Name1"]
    assert [r["name"] for r in e.search("rare", vector=[0.0, 1.0]).collect()] == ["Name1", "Name4", "Name3", "Name2", "Name0"]


def test_code_tokens():
    from packwright.sources.code_modules import parsed

    text = '''// About
// it
Function Sum(A, B = "x)") Export
  Return Add(A, Inner(B, 2), "Text(1)"); // Call(3)
EndFunction
Var One, Two Export;
Obj.Method(Arg());
'''
    rows = parsed(text)
    assert [r[1:8] for r in rows if r[0] == "symbol"] == [
        ("Sum", "function", 3, 5, True, 'Function Sum(A, B = "x)") Export', "About it"),
        ("One", "variable", 6, 6, True, "Var One", ""), ("Two", "variable", 6, 6, True, "Var Two", ""),
    ]
    assert [(r[8], r[1], r[3], r[9]) for r in rows if r[0] == "call"] == [("Sum", "Add", 4, 3), ("Sum", "Inner", 4, 2), (None, "Arg", 7, 0)]


def test_trees_of_any_depth(spark):
    import pytest

    from packwright.operators import code, tree

    n = 40
    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"t{i}") for i in range(n)], "id long, parent long, title string")
    assert tree.breadcrumbs(nodes, "id", "parent", "title").agg({"depth": "max"}).first()[0] == n - 1
    calls = spark.createDataFrame([(f"f{i}", f"f{i + 1}") for i in range(14)] + [("f14", "f0")], "caller_name string, callee_name string")
    assert code.reachable(calls, "f0").count() == 14 and code.reachable(calls, "f0", 3).count() == 3
    looped = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (1, 2, "a")], "id long, parent long, title string")
    with pytest.raises(ValueError):
        tree.breadcrumbs(looped, "id", "parent", "title")


def test_files_with_a_dtd_give_no_records(spark):
    body = b"<R><CatalogObject.X><Ref>1</Ref></CatalogObject.X></R>"
    dtd = b"<?xml version='1.0'?>" + b"<!-- <a> -->" + b" " * 9000 + b"<!DOCTYPE R [<!ENTITY e 'x'>]>" + body
    text = b"<R><CatalogObject.X><Ref><![CDATA[<!DOCTYPE html>]]></Ref></CatalogObject.X></R>"
    files = spark.createDataFrame([(n, bytearray(c)) for n, c in (("dtd", dtd), ("plain", body), ("text", text))], "rel_path string, content binary")
    found = {r["rel_path"]: r["fields"]["Ref"] for r in config_xml.export_records(files).collect()}
    assert found == {"plain": "1", "text": "<!DOCTYPE html>"}
    assert config_xml.parsed(dtd) == [] and config_xml.parsed(text)

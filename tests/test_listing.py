"""The listing source, category trees and the discovery of help books."""

import json

import duckdb
import pytest
from oracle_check import differences
from pyspark.sql import functions as F

from packwright.api import Engine
from packwright.plans import build, oracles, packs, registry
from packwright.plans.catalog import Workspace
from packwright.sources import categories, files, help_books, unpacked
from packwright.sources.listing import is_hidden, listing


def plant(root, made):
    for name, body in made.items():
        path = root / name
        if body is None:
            path.mkdir(parents=True, exist_ok=True)
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(root)


def test_ten_thousand_files(spark, tmp_path):
    for d in range(50):
        deep = tmp_path / f"d{d}" / "x" / "y"
        deep.mkdir(parents=True)
        for k in range(200):
            (deep / f"{'._'[k % 2] if k % 10 < 2 else 'f'}{k}").write_text(str(k))
    (tmp_path / "none" / "at all").mkdir(parents=True)
    rows = listing(spark, str(tmp_path), tasks=16)
    got = rows.groupBy("is_dir").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b"), F.count_distinct("rel_path").alias("d")).collect()
    assert {r["is_dir"]: (r["n"], r["b"], r["d"]) for r in got} == {False: (10_000, 50 * 490, 10_000), True: (152, 0, 152)}
    assert 16 <= rows.rdd.getNumPartitions() <= 64
    assert rows.where(is_hidden(F.col("rel_path"))).count() == 2000
    tree = files.scan(spark, str(tmp_path))
    assert tree.count() == 10_000 and tree.where("rel_path = 'd7/x/y/_1' and decode(content, 'UTF-8') = '1'").count() == 1
    assert files.scan(spark, str(tmp_path), "_*").count() == 1000
    assert [r["rel_path"] for r in files.empty_folders(spark, str(tmp_path)).collect()] == ["none/at all"]


def test_entries_hold_hidden_files_and_empty_folders(spark, tmp_path):
    source = plant(tmp_path / "s", {"a/.hidden": "h", "_b/c d+%41.txt": "t", "e/f": None, "k=v/_x=1/z": "z"})
    made = files.entries(files.scan(spark, source), empty=files.empty_folders(spark, source))
    assert sorted((r["rel_path"], r["entry_type"]) for r in made.collect()) == [
        ("_b", "dir"), ("_b/c d+%41.txt", "file"), ("a", "dir"), ("a/.hidden", "file"), ("e", "dir"), ("e/f", "dir"), ("k=v", "dir"), ("k=v/_x=1", "dir"), ("k=v/_x=1/z", "file"),
    ]
    manifest = build.build_full(files.scan(spark, source), str(tmp_path / "p"), empty=files.empty_folders(spark, source))
    assert manifest["rows"] == {"entries": 9, "blobs": 3}
    assert files.scan(spark, plant(tmp_path / "n", {"x": None})).count() == 0


def test_dotted_contents_need_no_renaming(spark, tmp_path):
    made = {"8.3.1/book/.hbk_info.json": json.dumps({"language": "ru"}), "8.3.1/book/.toc.json": json.dumps([{"path": "/a.html", "title_ru": "T"}]), "8.3.1/book/a.html": "<html>x</html>"}
    row = unpacked.topics(files.scan(spark, plant(tmp_path, made))).first()
    assert (row["title"], row["language"]) == ("T", "ru")


def test_category_tree(spark, tmp_path):
    made = {
        "__categories__": '{4,"b"},"missing",{1,"a"},"page",{0,"b"},{3,"pic.png"},plain,"not this"',
        "a/__categories__": '{2,"x.html",{1,"y.htm"},"sub"}', "a/x.html": "<h1>X <i>one</i></h1><title>no</title>", "a/y.htm": "<TITLE>Y</TITLE>", "a/left.html": "<h1>not listed</h1>",
        "a/sub/q.html": "nothing", "a/sub/p.txt": "t", "a/sub/deep": None,
        "b": None, "page": "<h1>P</h1>", "pic.png": "p", "c/unreached.html": "<h1>U</h1>",
    }
    source = plant(tmp_path, made)
    tree, empty = files.scan(spark, source), files.empty_folders(spark, source)
    got = {r["path"]: (r["parent"], r["position"], r["title"], r["page"], "/".join(r["breadcrumb"])) for r in categories.category_tree(tree, empty).collect()}
    assert got == {
        "b": (None, 0, "b", "", "b"), "a": (None, 2, "a", "", "a"), "page": (None, 3, "P", "page", "P"),
        "a/x.html": ("a", 0, "X one", "a/x.html", "a/X one"), "a/y.htm": ("a", 1, "Y", "a/y.htm", "a/Y"), "a/sub": ("a", 2, "sub", "", "a/sub"),
        "a/sub/q.html": ("a/sub", None, "Untitled", "a/sub/q.html", "a/sub/Untitled"), "a/sub/deep": ("a/sub", None, "deep", "", "a/sub/deep"),
    }
    assert categories.category_tree(tree.where("rel_path like 'c/%'")).count() == 0


def garbled(text):
    return text.encode().decode("cp1251")


def test_category_tree_uses_whole_texts(spark, tmp_path):
    far, mark = "<!-- " + "x" * 9000 + " -->", "<p class='a'>"
    title = "страница привета"
    made = {
        "__categories__": '{1,"none.html"},' * 400 + garbled(f'{{1,"{title}.html"}}') + ',{1,"h.html"},{1,"t.html"},{1,"long.html"},{1,"front.html"},{1,"back.html"},{1,"plain.html"}',
        f"{title}.html": "<h1>A</h1>", "h.html": f"{far}<h1>H</h1>", "t.html": f"{far}<title>T</title>", "long.html": f"<title>no</title><h1>L{'<b></b>' * 900}!</h1>",
        "front.html": garbled(f"<h1>{title}</h1>") + far, "back.html": mark * 900 + garbled(f"<h1>{title}</h1>"), "plain.html": f"{far}<h1>ССР — Рим, Росс</h1>",
    }
    found = categories.category_tree(files.scan(spark, plant(tmp_path, made)), root="").select("path", "title")
    assert dict(found.collect()) == {f"{title}.html": "A", "h.html": "H", "t.html": "T", "long.html": "L!", "front.html": title, "back.html": title, "plain.html": "ССР — Рим, Росс"}


def test_category_tree_agrees_with_sql_on_late_headings(spark, tmp_path):
    far = "<p>" + "word " * 1000
    html = F.concat(F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.lit(far)), F.when(F.col("id") % 2 == 0, F.lit("<h1>Над ")).otherwise(F.lit("<title>T <b>")), "id", F.lit("</h1></title>"))
    spark.range(60).select(F.col("id").alias("page_id"), html.alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert differences(spark, con, registry.QUERIES["category_tree"], oracles.ORACLES["category_tree"], str(tmp_path)) == ""
    assert registry.QUERIES["category_tree"](spark, str(tmp_path)).where("title = 'Untitled'").count() == 0


@pytest.mark.parametrize(
    ("root", "made", "versions", "want"),
    [
        ("8.3.9", {"shcntx_ru.hbk": ""}, None, {("", "8.3.9")}),
        ("8.3.9/bin", {"shcntx_ru.hbk": ""}, None, {("", "8.3.9")}),
        ("all", {"8.3.9/bin/a_ru.hbk": "", "8.3.10.5/a_ru.hbk": "", "x/8.3.11/a_ru.hbk": "", ".8.3.12/a": ""}, None, {("8.3.9", "8.3.9"), ("8.3.10.5", "8.3.10.5")}),
        ("all", {"x/8.3.11/a_ru.hbk": "", "y/z/8.3.9/b": ""}, None, {("x/8.3.11", "8.3.11"), ("y/z/8.3.9", "8.3.9")}),
        ("plain", {"a_ru.hbk": ""}, None, {("", "plain")}),
        ("all", {"8.3.9/a": "", "x/8.3.9/a": "", "w/8.3.8/a": "", "v/8.3.8/b": ""}, ["8.3.8", "8.3.9", "8.3.7"], {("8.3.9", "8.3.9"), ("v/8.3.8", "8.3.8")}),
        ("8.3.9/bin", {"a": ""}, ["8.3.9", "bin"], {("", "8.3.9"), ("", "bin")}),
    ],
)
def test_version_folders(spark, tmp_path, root, made, versions, want):
    source = plant(tmp_path / root, made)
    got = help_books.version_folders(listing(spark, source), source, versions)
    assert {(r["folder"], r["version"]) for r in got.collect()} == want


def test_books_by_language(spark, tmp_path):
    source = plant(tmp_path, {"8.3.9/shcntx_RU.HBK": "", "8.3.9/d/my help_en.hbk": "", "8.3.9/nolang.hbk": "", "8.3.9/a_ru.txt": "", "other/b_ru.hbk": ""})
    rows = listing(spark, source)
    sources = help_books.version_folders(rows, source)
    got = {(r["rel_path"], r["version"], r["language"], r["stem"], r["label"]) for r in help_books.help_books(rows, sources).collect()}
    assert got == {("8.3.9/shcntx_RU.HBK", "8.3.9", "ru", "shcntx_RU", "shcntx"), ("8.3.9/d/my help_en.hbk", "8.3.9", "en", "my_help_en", "my_help")}
    assert help_books.help_books(rows, sources, ["EN "]).count() == 1


def test_packs_are_read_back(spark, tmp_path):
    source = plant(tmp_path / "s", {".a/b": b"\0bin", "c": "text"})
    build.build_full(files.scan(spark, source), str(tmp_path / "p"))
    assert packs.table(spark, str(tmp_path / "p"), "blobs").count() == 2
    engine = Engine(spark, Workspace("full", {}, {"t": {"packs": {"full": str(tmp_path / "p")}}}))
    assert engine.extract(".a/b", str(tmp_path / "got")) == {"path": ".a/b", "bytes": 4} and (tmp_path / "got").read_bytes() == b"\0bin"
    with pytest.raises(FileNotFoundError):
        engine.extract("missing", str(tmp_path / "none"))

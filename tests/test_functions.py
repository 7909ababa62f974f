import sqlite3

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packwright.functions import paths as P
from packwright.functions import text as T
from packwright.operators import code, fts, links, lookup, merge, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_compact_cuts_and_squeezes(spark):
    assert one(spark, T.compact(F.lit(" a  b\tc "), 10)) == "a b c"
    assert one(spark, T.compact(F.lit("abcdef ghij"), 8)) == "abcdef…"
    assert one(spark, T.summary(F.lit("abcdefghij"), 6)) == "abc..."
    assert one(spark, T.compact(F.lit(None).cast("string"))) == ""


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=40))
def test_compact_never_exceeds(spark, text):
    assert len(one(spark, T.compact(F.lit(text), 7))) <= 7
    assert one(spark, T.squeezed(F.lit(text))) == " ".join(text.split())


def test_normalized(spark):
    assert one(spark, T.normalized(F.lit("  a \r\nb\t\n\n c  \n"))) == "a\nb\n\n c"


def test_slug_titles_and_paths(spark):
    assert one(spark, T.slug(F.lit("  Привет, Мир! "))) == "привет-мир"
    assert one(spark, T.slug(F.lit("..."))) == "unnamed"
    assert one(spark, T.title_synonym(F.lit("Имя (Name)"))) == "Name"
    assert one(spark, T.topic_path(F.lit("/8.3.1\\a/b"), F.lit("8.3.1"))) == "a/b"
    assert one(spark, T.safe_stem(F.lit("x/shlang ru.tar.gz"))) == "shlang_ru.tar"
    assert one(spark, T.language_of_file(F.lit("shlang_RU.hbk"))) == "ru"


def test_versions(spark):
    assert one(spark, T.newest_first(F.array(*map(F.lit, ("8.3.9", " 8.3.10", "8.3.x", "8.3.9"))))) == ["8.3.10", "8.3.9", "8.3.x"]
    assert one(spark, T.is_version(F.lit("8.3.10"))) and not one(spark, T.is_version(F.lit("8.3")))


def test_module_hint(spark):
    hint = one(spark, P.module_hint(F.lit("Documents/D/Forms/F/Ext/Module.bsl")))
    assert tuple(hint) == ("Documents", "D", "FormModule:F")
    assert tuple(one(spark, P.module_hint(F.lit("CommonModules/M/Ext/Module.bsl")))) == ("CommonModules", "M", "Module")


def test_links(spark):
    got = one(spark, links.html_links(F.lit('<p><a class="x" href="/a"> A <b>b</b></a><a href="/a"> A b</a>')))
    assert [tuple(x) for x in got] == [("/a", "A b")]
    assert [tuple(x) for x in one(spark, links.markdown_links(F.lit("[a](b.md) ![i](c.png)")))] == [("b.md", "a")]


def test_bm25_agrees_with_sqlite(spark):
    rows = [(1, "Größe und Länge der Zahl", "a"), (2, "die Zahl der Zahl", "b"), (3, "été ou café", "c"), (4, "snake_case word and snake case", "d"), (5, "case snake", "e"), (6, "", "f")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(text, name)")
    con.executemany("INSERT INTO t(rowid, text, name) VALUES (?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "id long, text string, name string")
    for query, match in (("Zahl der", '"Zahl" AND "der"'), ("cafe", '"cafe"'), ("snake_case", '"snake_case"'), ("grosse", '"grosse"')):
        want = {r: round(s, 9) for r, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
        got = {r["doc_id"]: round(r["score"], 9) for r in fts.bm25(docs, "id", ["text", "name"], query).collect()}
        assert got == want, query
    assert fts.query_tokens("a AND OR-b") == ["a", "AND", "OR", "b"]
    assert fts.bm25(docs, "id", ["text"], " ! ").count() == 0


def test_merge_is_idempotent(spark):
    rows = [(1, "ru", "x ", "8.3.9"), (2, "ru", "x", "8.3.10"), (3, "en", "x", "8.3.9"), (4, None, "y", "8.3.1")]
    df = spark.createDataFrame(rows, "id_ long, lang string, text string, version string")
    args = {"language": "lang", "content": ["text"], "version": "version", "order": "id_", "suffix": "m"}
    merged = merge.merge_by_content(df, **args)
    got = {(r["lang"], r["id_"]): (r["version"], r["versions"]) for r in merged.collect()}
    assert got == {("ru", 2): ("8.3.10", ["8.3.10", "8.3.9"]), ("en", 3): ("8.3.9", ["8.3.9"]), ("", 4): ("8.3.1", ["8.3.1"])}
    again = merge.merge_by_content(merged.select("id_", "lang", "text", "version"), **args)
    assert {r["id"] for r in again.collect()} == {r["id"] for r in merged.collect()}


def test_even_sample_has_the_last(spark):
    df = spark.range(103).select(F.format_string("%04d", "id").alias("p"))
    got = sorted(r["p"] for r in stats.even_sample(df, "p", 10).collect())
    assert got == [f"{i:04d}" for i in range(0, 90, 10)] + ["0102"]
    assert stats.even_sample(df.limit(3), "p", 10).count() == 3 and stats.even_sample(df.limit(0), "p", 10).count() == 0


def test_lookup_ranks(spark):
    r = lookup.exact_rank("get", F.lit("Conn.Get"), F.lit("Get"), F.array(F.lit("Fetch")))
    assert one(spark, r) == 1
    assert one(spark, lookup.exact_rank("get", F.lit("Conn.Get"), F.lit("x"))) == 3
    assert one(spark, lookup.token_score("conn get", F.lit("Conn.Get"), F.lit("get it"))) == 10


def test_call_graph(spark):
    calls = spark.createDataFrame([(1, "A", "B", 3, 0), (1, "B", "C", 5, 1), (2, None, "A", 1, 0), (2, "C", "A", 9, 0)], "module_id long, caller_name string, callee_name string, line long, args_count int")
    modules = spark.createDataFrame([(1, "m1"), (2, "m2")], "module_id long, rel_path string")
    assert [r["line"] for r in code.callers(calls, modules, "a").collect()] == [1, 9]
    assert {(r["name"], r["steps"]) for r in code.reachable(calls, "A").collect()} == {("b", 1), ("c", 2)}

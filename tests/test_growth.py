"""Work per row that must not grow with the row's length, and work that must not stay in one task."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from packwright.functions import grammar as G
from packwright.functions import text as T
from packwright.operators import fts, merge
from packwright.plans import registry
from packwright.sources import api_records, categories, code_modules, pages


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_distinct_in_order_cuts_its_words_once(spark, capsys):
    rows = spark.createDataFrame([(0, "b A a B c"), (1, ""), (2, None), (3, "É é x É X")], "i int, t string")
    made = rows.select("i", merge.distinct_in_order(F.split("t", " ")).alias("w"))
    assert dict(made.collect()) == {0: ["b", "A", "c"], 1: [""], 2: None, 3: ["É", "x"]}
    assert plan(made, capsys).count("split(") == 1
    held = spark.range(1).select(merge.distinct_in_order(F.array(F.lit("a"), F.lit(None), F.lit("A"), F.lit(None), F.lit("b"))).alias("w"))
    assert held.first()["w"] == ["a", None, "b"]
    long = spark.range(1).select(merge.distinct_in_order(F.transform(F.sequence(F.lit(0), F.lit(49_999)), lambda i: F.concat(F.lit("W"), (i % 20_000).cast("string")))).alias("w"))
    assert long.first()["w"] == [f"W{i}" for i in range(20_000)]


def test_phrases_cut_their_texts_once(spark, capsys):
    rows = spark.createDataFrame([(0, "of the of the", "x"), (1, "of", "the"), (2, "of a the", "of the"), (3, None, None)], "i int, a string, b string")
    counts = fts.match_counts(rows, "i", ["a", "b"], "of_the of")
    assert sorted(map(tuple, counts.collect())) == [(0, 5, 2, 2), (1, 2, 0, 1), (2, 5, 1, 2), (3, 0, 0, 0)]
    assert plan(counts.where("tf0 > 0 and tf1 > 0"), capsys).count("regexp_extract_all(") == 2  # one a column
    long = spark.createDataFrame([(0, "of the " * 20_000, "")], "i int, a string, b string")
    assert fts.match_counts(long, "i", ["a", "b"], "of_the").where("tf0 > 0").first()["tf0"] == 20_000


def test_hits_are_read_from_counts_that_are_kept(spark, capsys):
    rows = spark.createDataFrame([(i, f"the w{i % 3} erthor", "src7") for i in range(9)], "i int, a string, b string")
    found = fts.bm25(rows, "i", ["a", "b"], "the AND src7 w1")
    assert found.count() == 0  # no text holds the word "and"
    found = fts.bm25(rows, "i", ["a", "b"], "the src7 w1")
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 4, 7]
    assert "regexp_extract_all(" not in plan(found, capsys)


def test_strip_and_normalized_take_every_blank(spark):
    ws = "".join(chr(c) for c in range(0x3001) if re.match(f"[{T.WS}]", chr(c)))
    assert T.WS_CHARS == ws and len(ws) > 25 and set(T.LINE_END_CHARS) < set(ws)
    texts = [ws + "a" + ws + "b" + ws, ws, "", None, "a \r\n\x85 b\t c \n\nd", " é　\n ы "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.strip("t").alias("s"), T.normalized("t").alias("n"))

    def normal(x):
        lines = re.sub(f"[{T.LINE_ENDS}]", "\n", x.replace("\r\n", "\n"))
        return re.sub(f"[{T.WS_IN_LINE}]+\n", "\n", lines).strip(ws)

    want = [(i, (t or "").strip(ws), normal(t or "")) for i, t in enumerate(texts)]
    assert sorted(map(tuple, rows.collect())) == want


def test_inline_sections_are_read_once(spark, capsys):
    rows = spark.createDataFrame([(0, "x Синтаксис: a Поля:\nПараметры: b Описание варианта метода: c Описание: d"), (1, None)], "i int, t string")
    made = rows.select("i", pages.inline_sections("t").alias("s")).select("i", "s.intro", F.col("s.sections")["syntax"].alias("a"), F.col("s.sections")["description"].alias("d"), F.size("s.sections").alias("n"))
    assert sorted(map(tuple, made.collect())) == [(0, "x", "a", "c\n\nd", 3), (1, "", None, None, 0)]
    assert plan(made, capsys).count("regexp_extract_all(") == 1
    every = spark.createDataFrame([(k,) for k in pages.INLINE_LABELS], "k string").select("k", F.map_keys(pages.inline_sections(F.concat("k", F.lit(" b")))["sections"]).alias("got"))
    assert {r["k"]: r["got"] for r in every.collect()} == {k: [v] for k, v in pages.INLINE_LABELS.items()}


def test_titles_to_leave_out_are_made_once(spark, capsys):
    rows = spark.createDataFrame([("Name (Имя)", ["Above", " "], "name\n ABOVE (x)\n\nbody \nAbove it"), ("T", None, None)], "t string, b array<string>, x string")
    made = rows.select(T.without_title_lines("x", F.col("t"), F.col("b")).alias("x"))
    assert [r["x"] for r in made.collect()] == ["body\nAbove it", ""]
    text = plan(made, capsys)
    inside = text[text.index("array_contains(") :]
    assert "array_append(" not in inside[: inside.index(")")]


def _tasks(df) -> int:
    return df.select(F.spark_partition_id()).distinct().count()


def test_modules_of_one_file_are_parsed_in_many_tasks(spark):
    rows = spark.range(0, 200, 1, 1).select(F.col("id").alias("module_id"), F.lit("Procedure Run()\n Log(1, 2);\nEndProcedure\n").alias("text"))
    tagged = code_modules.tagged(rows)
    assert _tasks(tagged) > 3
    assert code_modules.symbols(tagged).count() == code_modules.calls(tagged).count() == 200


def test_parameter_texts_are_cut_into_lines_once_and_in_many_tasks(spark, capsys):
    texts = ["<A> (обязательный)\nТип: Число .\nодин", "- **B** (Строка) — два\n<C>\nТип:\nтри", "- \n<D", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", G.parameters(F.col("t")).alias("p"))
    got = {r["i"]: [tuple(p) for p in r["p"]] for r in rows.collect()}
    assert got == {0: [("<A>", "Число", "один")], 1: [("B", "Строка", "два"), ("<C>", "—", "три")], 2: [("<D", "", "")], 3: [], 4: []}
    assert plan(rows, capsys).count("split(") == 1
    assert _tasks(registry.QUERIES["parameter_lines"](spark, "/root/testdata/sf0.001")) > 3


def test_category_tree_reads_contents_once(spark, capsys):
    files = spark.createDataFrame(
        [("__categories__", b'{1,"s"}'), ("s/__categories__", b'{2,"b.html","a.html"},"b.html"'), ("s/a.html", b"<h1>A</h1>"), ("s/b.html", b"<title>B</title>")], "rel_path string, content binary"
    )
    found = categories.category_tree(files, root="")
    assert [(r["path"], r["position"], r["title"]) for r in found.orderBy("path").collect()] == [("s", 0, "s"), ("s/b.html", 0, "B")]
    assert "old_text" not in plan(found, capsys)


def test_titles_of_pages_that_close_nothing_are_searched_once(spark):
    n = 100_000
    texts = {"<h1>" * n: "Untitled", "<h1 " * n: "Untitled", "<title>x" * n + "</TITLE>": "x" * n, "<title>x" * n: "Untitled", "<h1>" + "<" * n + "</h1>": "<" * n, "<h1></h1><h1>x</h1><title>T <": "Untitled"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert dict(rows.select("t", T.html_title("t")).collect()) == texts


def test_code_calls_deals_its_table_to_many_tasks(spark):
    assert _tasks(registry.QUERIES["code_calls"](spark, "/root/testdata/sf0.001")) > 3


def test_pages_of_one_file_are_parsed_in_many_tasks(spark):
    rows = api_records.records(registry.part_pages(spark, "/root/testdata/sf0.001"))
    assert len(rows.inputFiles()) > 3  # of the parsed pages, one a task
    assert rows.count() == registry.table(spark, "/root/testdata/sf0.001", "part").count()


def test_runs_of_pages_are_handed_on_in_pieces():
    html = "<p>" + "word " * 40_000
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(60), pa.int64()), "html": pa.array([html] * 59 + [None])})
    sizes = [b.num_rows for b in pages._flattened(iter([batch]))]
    assert sum(sizes) == 59 and max(sizes) <= 6


def test_runs_keep_ids_and_order(spark):
    rows = spark.createDataFrame([("a", "x<p>y"), ("b", None), ("c", "")], "k string, h string")
    assert sorted(map(tuple, pages.runs(rows, "k", "h").collect())) == [("a", 0, "", "text", "x"), ("a", 1, "", "text", "y")]


def test_flat_records_of_one_file_are_parsed_in_many_tasks(spark):
    rows = registry.QUERIES["flat_api_records"](spark, "/root/testdata/sf0.001")
    assert len(rows.inputFiles()) > 3


def test_matches_are_found_without_cutting_texts(spark, capsys):
    texts = ["of the", "of  -The", "ofthe", "of a the", "xof the", "of thex", "1of the of_the", "of the", "óf thé", "\U0001d400of the", "of the\U000f0000", "oF. ThE!", "", None, "the of", "off of the"]
    rows = spark.createDataFrame([(i, t, "the" if i % 3 else "of é") for i, t in enumerate(texts)], "i int, a string, b string")
    queries = ["of_the", "the of", "off", "e", "", "- _", "OF AND the", "of_the_of"]
    found = fts.matches(rows, "i", ["a", "b"], *queries)
    got = {n: sorted(r["doc_id"] for r in found.where(F.col("query") == n).collect()) for n in range(len(queries))}
    assert got == {n: sorted(r["doc_id"] for r in fts.bm25(rows, "i", ["a", "b"], q).collect()) for n, q in enumerate(queries)}
    assert got[0] == [0, 1, 6, 8, 11, 15]
    text = plan(registry.QUERIES["fts_match_and"](spark, "/root/testdata/sf0.001"), capsys)
    assert "regexp_extract_all(" not in text and text.count("FileScan") == 1
    assert text.count("translate(") == 2  # one a column


def test_modules_are_cut_into_tokens_without_gaps():
    text = 'Функция Ф(А, "x\n""y", Б[1, (2, 3)]) Экспорт // Нет(1)\n  Get(1, [2, 3], Sum()); a.No(1); Open((\n'
    assert "".join(code_modules._TOKEN.findall(text)) == text
    assert [(r[1], r[3], r[8], r[9]) for r in code_modules.parsed(text) if r[0] == "call"] == [("Get", 3, "Ф", 3), ("Open", 3, "Ф", 1), ("Sum", 3, "Ф", 0)]
    assert [r[1:7] for r in code_modules.parsed(text) if r[0] == "symbol"] == [("Ф", "function", 1, 1, True, 'Функция Ф(А, "x\n""y", Б[1, (2, 3)]) Экспорт')]


def test_modules_are_handed_on_without_pandas(spark, capsys):
    tagged = code_modules.tagged(spark.createDataFrame([(1, "Var A;"), (2, "")], "module_id long, text string"))
    assert "MapInArrow" in plan(tagged, capsys)
    assert [(r["module_id"], r["name"], r["line"], r["args_count"]) for r in tagged.collect()] == [(1, "A", 1, None)]


def test_texts_of_parts_are_made_in_many_tasks(spark):
    assert _tasks(registry._modules(spark, "/root/testdata/sf0.001")) > 3


def test_pages_of_parts_are_made_in_many_tasks(spark):
    assert _tasks(registry.part_pages(spark, "/root/testdata/sf0.001")) > 3

"""Parameter and type grammars, limits, surface aliases, typed relations and tables."""

import random
import re

from pyspark.sql import functions as F

from packwright.functions import grammar as G
from packwright.operators import aliases
from packwright.sources import pages


def plain_parameters(text):
    """The three forms of parameter sections, line by line in Python."""
    lines = [x.strip() for x in (text or "").splitlines() if x.strip()]
    head = r"<[^>]+>\s*\((?:обязательный|необязательный)\)"
    out = []
    if not any("**" in x for x in lines):
        whole = " ".join(lines)
        starts = [m.start() for m in re.finditer(head, whole, re.I)]
        for a, b in zip(starts, [*starts[1:], len(whole)]):
            chunk = " ".join(whole[a:b].split())
            kind = re.search(r"Тип:\s*(.+?)(?:\s+\.\s+|\.$)", chunk)
            out.append((re.match("<[^>]+>", chunk)[0], kind[1].strip() if kind else "—", chunk[kind.end() :].strip() if kind else chunk))
    if out:
        return out
    todo = list(lines)
    while todo:
        x = todo.pop(0)
        x = x.lstrip("- ").strip() if x.startswith("-") else x
        if x.startswith("<") and ">" in x:
            kind = (todo.pop(0)[4:].strip() or "—") if todo and todo[0].startswith("Тип:") else "—"
            out.append((x, kind, todo.pop(0) if todo else ""))
        elif m := re.match(r"\*\*(.+?)\*\*\s+\((.+?)\)(?:\s+—\s+(.*))?$", x):
            out.append((m[1].strip(), m[2].strip(), (m[3] or "").strip()))
        elif x:
            out.append((x, "", ""))
    return out


def test_parameters_agree_with_plain_version(spark):
    r = random.Random(4)
    parts = ["<Имя> (обязательный)", "<Ключ>", "Тип: Строка .", "Тип: Число.", "Тип:", "- **Имя** (Строка) — текст", "**К** (Число)", "описание . ещё", "- <А> хвост", "--", "", "  слово ", "<B> (НЕОБЯЗАТЕЛЬНЫЙ) Тип: X . d"]
    texts = ["\n".join(r.choice(parts) for _ in range(r.randrange(0, 8))) for _ in range(400)] + [None, "", "<А> (обязательный) Тип: Строка . Имя. <Б> (необязательный) без типа", "a\r\n\r\nb\x0bc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", G.parameters(F.col("t")).alias("p")).collect()
    for x in rows:
        assert [tuple(p) for p in x["p"]] == plain_parameters(texts[x["i"]]), texts[x["i"]]


def test_types_and_limits(spark):
    cases = {
        "Тип: HTTPОтвет .": ["HTTPОтвет"], "СтандартноеХранилищеНастроекМенеджер , ХранилищеНастроекМенеджер. < Имя хранилища >": ["СтандартноеХранилищеНастроекМенеджер", "ХранилищеНастроекМенеджер.<Имя хранилища>"],
        "Тип: Строка, число; СТРОКА. хвост": ["Строка", "число", "СТРОКА. хвост"], "просто слова, Строка, строка": ["Строка"], "": [], None: [], "Тип: А . дальше, б": ["А", "б"], "ОбъектМетаданных: Х": ["ОбъектМетаданных: Х"],
    }
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r["v"] for r in rows.select("i", G.value_types(F.col("t")).alias("v")).orderBy("i").collect()] == list(cases.values())
    limits = [("Доступен.\n Только на СЕРВЕРЕ. \nи ещё", "Клиент"), ("Ничего\nтакого", None), ("я" * 500, ""), (None, None)]
    got = spark.createDataFrame(limits, "a string, b string").select(G.restrictions(F.col("a"), F.col("b")).alias("r"), G.described_type(F.concat_ws(" ", "a", F.lit("Тип: Дата .  x"))).alias("d")).collect()
    assert [r["r"] for r in got] == ["Только на СЕРВЕРЕ.\nКлиент", "Ничего такого", "я" * 397 + "...", ""] and got[3]["d"] == "Дата"
    targets = [("A b c d e", False), ("Метод.Х", True), ("слово", False), ("АА" * 61, False), ("X\nY", False)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t, _ in targets], "t string").select(G.is_link_target(F.col("t"))).collect()] == [w for _, w in targets]


def test_aliases_and_relations(spark):
    rows = [
        (1, "Глобальный контекст.Метаданные", "Глобальный контекст", "Метаданные", False, ["HTTPОтвет"], ["Метаданные"], {("HTTPОтвет", "returns_type"), ("Метаданные", "surface_alias"), ("ОбъектМетаданныхКонфигурация", "global_property_returns_type")}),
        (2, "ОбъектМетаданныхКонфигурация.СвойстваОбъектов", "ОбъектМетаданныхКонфигурация", "СвойстваОбъектов", False, [], ["Метаданные.СвойстваОбъектов"], {("Метаданные.СвойстваОбъектов", "surface_alias"), ("ПеречислимыеСвойстваОбъектовМетаданных", "metadata_property_returns_type")}),
        (3, "ПеречислимыеСвойстваОбъектовМетаданных.Вид", "ПеречислимыеСвойстваОбъектовМетаданных", "Вид", False, ["ВидДаты", "слова без вида"], ["Метаданные.СвойстваОбъектов.Вид"], {("ВидДаты", "returns_type"), ("ВидДаты", "metadata_enum_property_returns_system_enum"), ("Метаданные.СвойстваОбъектов.Вид", "surface_alias")}),
        (4, "ОбъектМетаданныхКонфигурация.Документы", "ОбъектМетаданныхКонфигурация", "Документы", False, None, ["Метаданные.Документы"], {("Метаданные.Документы", "surface_alias"), ("ОбъектМетаданных: Документ", "metadata_collection_contains_object_type")}),
        (5, "ДокументыМенеджер.<Имя документа>", "ДокументыМенеджер", "<Имя документа>", False, [], ["Документы.<Имя документа>"], {("Документы.<Имя документа>", "surface_alias")}),
        (6, "ДокументМенеджер.<Имя документа>.Найти", "ДокументМенеджер.<Имя документа>", "Найти", False, [], ["Документы.<Имя документа>.Найти"], {("Документы.<Имя документа>.Найти", "surface_alias")}),
        (7, "ОтчетыМенеджер", "", "ОтчетыМенеджер", True, ["Строка"], ["Отчеты", "Отчёты"], {("Отчеты", "surface_alias"), ("Отчёты", "surface_alias")}),
        (8, "Прочее.Имя", "Прочее", "Имя", False, [], [], set()), (9, None, None, None, True, None, [], set()),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "id int, full string, owner string, member string, obj boolean, value_types array<string>")
    named = {"full": "full", "owner": "owner", "member": "member", "is_object": F.col("obj")}
    made = aliases.with_aliases(df, key="id", **named).cache()
    assert {r["id"]: r["surface_aliases"] for r in made.collect()} == {r[0]: r[6] for r in rows}
    got = {}
    for e in aliases.typed_relations(made, **named).collect():
        got.setdefault(e["source_full_name"], set()).add((e["target_name"], e["link_kind"]))
    assert got == {r[1]: r[7] for r in rows if r[7]}


def test_tables_become_markdown():
    table = lambda html: [(k, t) for _, k, t in pages.flat(html)]
    assert table("a<table><tr><th>H|1<th>H2</tr><tr><td>x<br>y</td><td><a href=q>L</a> z</table>b") == [("text", "a"), ("cell_link", "L"), ("table", "| H\\|1 | H2 |\n| --- | --- |\n| x y | L z |"), ("text", "b")]
    spans = "<table><tr><td colspan=2>w<td>c</tr><tr><td rowspan=2>d<td>e<td>f</tr><tr><td>g<td>h</tr><tr><td>i</tr></table>"
    assert table(spans)[0][1].split("\n") == ["| w |  | c |", "| --- | --- | --- |", "| d | e | f |", "|  | g | h |", "| i |  |  |"]
    nested = "<table><tr><td>o<table><tr><td>in<td>ner</table>p<tr><td>q</table>"
    assert table(nested)[0][1] == "| o in ner p |\n| --- |\n| q |"
    assert table("<table><tr><td>only</table>") == [("table", "| only |")] and table("<table></table>x") == [("text", "x")]
    laid = "<table><tr><td>left<td><p class='V8SH_chapter'>Пример:</p>é</table>"
    assert pages.flat(laid) == [("", "text", "left"), ("Пример:", "text", "é")]
    assert table("<table><tr><td>never closed") == [("table", "| never closed |")]

"""Bilingual code modules: modules, symbols and calls, read from the language's tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.functions.paths import module_hint
from packwright.functions.text import compact
from packwright.plans.shared import spread, written
from packwright.sources.files import decoded

# The language's words in both tongues.
PROCEDURE = {"процедура", "procedure"}
FUNCTION = {"функция", "function"}
END = {"конецпроцедуры", "endprocedure", "конецфункции", "endfunction"}
VARIABLE = {"перем", "var"}
EXPORT = {"экспорт", "export"}
HEADS = PROCEDURE | FUNCTION
OPEN, CLOSE = {"(", "["}, {")", "]"}
# Words that may stand before a bracket without being calls.
NO_CALL = {
    "если", "пока", "для", "каждого", "из", "по", "цикл", "процедура", "функция", "перем", "возврат", "новый", "попытка", "исключение", "конецпопытки",
    "if", "while", "for", "each", "in", "do", "loop", "procedure", "function", "var", "return", "new", "try", "except", "endtry",
}
#: What a text consists of, without gaps: comments, strings (a doubled quote is part of one), dates, names, numbers, line ends, blanks, single signs.
_TOKEN = re.compile(r"""//[^\n]*|"(?:[^"]|"")*"?|'[^'\n]*'?|[^\W\d]\w*|\d[\w.]*|\n|[^\S\n]+|\S""")
_ROWS = (
    "module_id long, row string, name string, kind string, line int, end_line int, is_export boolean, signature string, doc_comment string, caller_name string, args_count int"
)
_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}.get(c.split()[1], pa.string())) for c in _ROWS.split(", ")])


#: Text, a name's lower case or nothing, line, whether it is the line's first, place. A plain tuple, as millions are made.
Token = tuple[str, str, int, bool, int]


def modules(files: DataFrame, excerpt: int = 400) -> DataFrame:
    """module_id, rel_path, hints, size, digest, excerpt and text of every module."""
    rows = files.where(F.lower("rel_path").endswith(".bsl")).withColumn("_d", decoded("content"))
    hint = module_hint(F.col("rel_path"))
    return rows.select(
        F.conv(F.substring(F.sha2("rel_path", 256), 1, 14), 16, 10).cast("long").alias("module_id"), "rel_path", hint["object_type"].alias("object_type"),
        hint["object_name"].alias("object_name"), hint["module_kind"].alias("module_kind"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"),
        compact(F.col("_d.text"), excerpt).alias("excerpt"), F.coalesce("_d.text", F.lit("")).alias("text"),
    )


def tokens_of(text: str) -> tuple[list[Token], dict[int, str]]:
    """The tokens that are no comments, and the comments that begin a line, by their lines."""
    code, comments = [], {}
    line, last, at = 1, 0, 0
    for t in _TOKEN.findall(text):
        head = t[0]
        if head == "\n":
            line += 1
        elif head == "/" and t[:2] == "//":
            if line != last:
                comments[line] = t
            last = line
        elif not head.isspace():
            name = (head.isalnum() or head == "_") and not head.isdecimal()
            code.append((t, t.lower() if name else "", line, line != last, at))
            last = line
            if head == '"':
                line += t.count("\n")
        at += len(t)
    return code, comments


def _brackets(code: list[Token]) -> tuple[dict[int, int], dict[int, int]]:
    """Where each bracket that is closed closes, and the commas right inside each."""
    ends, commas, opened = {}, {}, []
    for k, (text, _, _, _, _) in enumerate(code):
        if text in OPEN:
            opened.append(k)
            commas[k] = 0
        elif opened:
            if text in CLOSE:
                ends[opened.pop()] = k
            elif text == ",":
                commas[opened[-1]] += 1
    return ends, commas


def _comment_above(comments: dict[int, str], line: int) -> str:
    """The comment lines that stand right above a line, joined."""
    notes = []
    while (line := line - 1) in comments:
        notes.append(comments[line].strip("/ \t\r"))
    return " ".join(n for n in reversed(notes) if n)


def parsed(text: str) -> list[tuple]:
    """(row, name, kind, line, end_line, is_export, signature, doc_comment, caller_name, args_count) of one module.

    Names before brackets are calls unless a point stands before them or they are words of the language; those in
    comments, strings and headers are none.
    """
    code, comments = tokens_of(text)
    closed, commas = _brackets(code)
    out, ends, inside, k = [], [], None, 0
    heads: list[list] = []
    while k < len(code):
        name, low, line, first, _ = code[k]
        if not low:
            k += 1
            continue
        follows = code[k + 1][0] if k + 1 < len(code) else ""
        if first and low in HEADS and k + 2 < len(code) and code[k + 1][1] and code[k + 2][0] == "(":
            end = closed.get(k + 2, len(code))
            export = end + 1 < len(code) and code[end + 1][1] in EXPORT
            kind = "function" if low in FUNCTION else "procedure"
            params = text[code[k + 2][4] + 1 : code[end][4] if end < len(code) else len(text)].strip()
            russian = bool(re.search("[А-ЯЁа-яё]", follows))
            word = {("function", True): "Функция", ("procedure", True): "Процедура"}.get((kind, russian), kind.title())
            mark = (" Экспорт" if russian else " Export") if export else ""
            heads.append([follows, kind, line, line, export, f"{word} {follows}({params}){mark}", _comment_above(comments, line)])
            inside, k = follows, end + 1 + export
            continue
        if first and low in END:
            ends.append(line)
            inside = None
        elif first and low in VARIABLE:
            stop = next((j for j in range(k, len(code)) if code[j][0] == ";"), len(code))
            listed = [(x, w) for x, w, *_ in code[k + 1 : stop] if w]
            export = any(w in EXPORT for _, w in listed)
            out += [("symbol", x, "variable", line, line, export, f"Var {x}", "", None, None) for x, w in listed if w not in EXPORT]
            k = stop
        elif follows == "(" and low not in NO_CALL and not (k and code[k - 1][0] == "."):
            end = closed.get(k + 1, len(code))
            out.append(("call", name, None, line, None, None, None, None, inside, commas[k + 1] + 1 if end > k + 2 else 0))
        k += 1
    for h in heads:  # a body ends at the next end behind its header
        h[3] = next((e for e in ends if e > h[2]), h[2])
        out.append(("symbol", *h, None, None))
    return sorted(out, key=lambda r: (r[0], r[3], r[1].lower()))


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i, *row) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for row in parsed(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def tagged(modules_: DataFrame, dealt: bool = False) -> DataFrame:
    """Symbols and calls of all modules, one kind of row each; texts are parsed once, where they are if they are dealt out already."""
    rows = modules_.select("module_id", "text")
    return (rows if dealt else spread(rows)).mapInArrow(_tagged, _ROWS)


def symbols(rows: DataFrame) -> DataFrame:
    """Procedures, functions and variables among tagged rows."""
    return rows.where("row = 'symbol'").select("module_id", "name", "kind", "line", "end_line", "is_export", "signature", "doc_comment")


def calls(rows: DataFrame) -> DataFrame:
    """Calls among tagged rows."""
    return rows.where("row = 'call'").select("module_id", "caller_name", F.col("name").alias("callee_name"), "line", "args_count")


def code_pack(modules_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """modules with symbol and call counts, symbols, calls."""
    rows = written(tagged(modules_))
    counts = rows.groupBy("module_id").agg(F.count_if(F.col("row") == "symbol").alias("symbol_count"), F.count_if(F.col("row") == "call").alias("call_count"))
    counted = modules_.drop("text").join(counts, "module_id", "left").fillna(0, ["symbol_count", "call_count"])
    return counted, symbols(rows), calls(rows)

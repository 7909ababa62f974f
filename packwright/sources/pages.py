"""Help pages: a tolerant parser that only flattens markup, and sections put together by DataFrame operations."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.functions.text import normalized, once, squeezed, strip

# How the chapters of a help page begin, and the section each is.
CHAPTERS = (
    ("Описание", "description"), ("Синтаксис", "syntax"), ("Поля", "fields"), ("Параметры", "params"), ("Возвращаемое значение", "returns"),
    ("Пример", "example"), ("См. также", "see_also"), ("Примечание", "note"), ("Использование в версии", "version"), ("Доступность", "availability"),
)
_BLOCKS = frozenset("p div li tr table ul ol h1 h2 h3 h4 h5 h6 br hr pre article section td th body".split())
#: Characters of pages that are parsed before their runs are handed on.
PIECE = 1 << 20
_SILENT = frozenset(("script", "style", "nav", "footer", "head"))


def _span(value: str | None) -> int:
    return min(int(value), 1000) if value and value.isascii() and value.isdigit() and int(value) else 1


class Grid:
    """The cells of a table: each takes the first free places of its row, and those of its spans stay empty."""

    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.below: dict[int, int] = {}  # column: rows that a cell above still takes
        self.cell: list[str] | None = None

    def row(self):
        self.below = {c: n - 1 for c, n in self.below.items() if n > 1} if self.rows else {}
        self.rows.append({})
        self.cell = None

    def open(self, across: int, down: int):
        if not self.rows:
            self.row()
        row, at = self.rows[-1], 0
        while at in row or at in self.below:
            at += 1
        self.cell = row[at] = []
        for c in range(at, at + across):
            row.setdefault(c, [])
            if down > 1:
                self.below[c] = down
        self.below = {c: n for c, n in self.below.items() if c not in row or n > 1}

    def text(self) -> list[list[str]]:
        rows = [{c: " ".join("".join(t).split()) for c, t in r.items()} for r in self.rows]
        width = max((max(r, default=-1) + 1 for r in rows), default=0)
        return [[r.get(c, "") for c in range(width)] for r in rows if r]

    def markdown(self) -> str:
        """Rows between bars, the first one above a line if there are others; bars inside cells are escaped."""
        rows = [[c.replace("|", "\\|") for c in r] for r in self.text() if any(r)]
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        if len(lines) > 1:
            lines.insert(1, "|" + " --- |" * len(rows[0]))
        return "\n".join(lines)


class _Flat(HTMLParser):
    """Runs of text as (chapter, kind, text): kind is text, code, link, cell_link (a link that its table's text holds as well), table, rubric, title or version.

    A table is one run; tables inside its cells are text of the cell. A table around chapters only lays out the page:
    its cells so far become plain runs.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.chapter, self.kind, self.buffer, self.silent, self.into = [], "", "text", [], 0, None
        self.grid, self.depth, self.cell_link = None, 0, None

    def end_table(self, as_text: bool = False):
        grid, self.grid = self.grid, None
        if grid is not None:
            texts = [c for r in grid.text() for c in r if c] if as_text else [grid.markdown()]
            self.out += [(self.chapter, "text" if as_text else "table", unicodedata.normalize("NFC", t)) for t in texts if t]

    def table_tag(self, tag, attrs):
        """Whether a tag was the open table's business."""
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.flush()
                self.into, self.grid = None, Grid()
            return True
        if self.grid is None:
            return False
        if self.depth == 1 and tag == "tr":
            self.grid.row()
        elif self.depth == 1 and tag in ("td", "th"):
            self.grid.open(_span(attrs.get("colspan")), _span(attrs.get("rowspan")))
        elif self.grid.cell is not None and tag in _BLOCKS:
            self.grid.cell.append(" ")
        if tag == "a":
            self.cell_link = []
        return True

    def flush(self):
        text = unicodedata.normalize("NFC", "".join(self.buffer))
        text = text.strip("\n") if self.kind == "code" else " ".join(text.split())
        self.buffer = []
        if text.strip():
            if self.into == "chapter":
                self.chapter = text
            else:
                self.out.append((self.chapter, self.into or self.kind, text))

    def handle_starttag(self, tag, attrs):
        cls = dict(attrs).get("class") or ""
        if tag in _SILENT:
            self.silent += 1
        if "V8SH_" in cls and self.grid is not None:
            self.end_table(as_text=True)
        if self.table_tag(tag, dict(attrs)):
            return
        if tag in _BLOCKS or "V8SH_" in cls:
            self.flush()
            self.into = next((k for mark, k in (("V8SH_chapter", "chapter"), ("V8SH_pagetitle", "title"), ("V8SH_rubric", "rubric"), ("V8SH_versionInfo", "version")) if mark in cls), None if tag in _BLOCKS else self.into)
            if tag == "h1" and self.into is None:
                self.into = "title"
        if tag == "pre":
            self.kind = "code"
        if tag == "a" and self.into is None:
            self.flush()
            self.into = "link"

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "table":
            self.depth = max(0, self.depth - 1)
            if self.depth == 0:
                self.end_table()
        if self.grid is not None:
            if self.grid.cell is not None and tag in _BLOCKS:
                self.grid.cell.append(" ")
            if tag == "a" and self.cell_link is not None:
                text = " ".join("".join(self.cell_link).split())
                self.out += [(self.chapter, "cell_link", unicodedata.normalize("NFC", text))] if text else []
                self.cell_link = None
            return
        if tag in _BLOCKS or tag == "a":
            self.flush()
            if tag != "a" or self.into == "link":
                self.into = None
        if tag == "pre":
            self.kind = "text"

    def handle_data(self, data):
        if self.silent:
            return
        if self.grid is None:
            self.buffer.append(data)
        elif self.grid.cell is not None:
            self.grid.cell.append(data)
            if self.cell_link is not None:
                self.cell_link.append(data)


def flat(html: str | None) -> list[tuple[str, str, str]]:
    parser = _Flat()
    parser.feed(html or "")
    parser.close()
    parser.end_table()
    parser.flush()
    return parser.out


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a few pages at a time, so that a task holds its input batch and the runs of about PIECE characters."""
    for b in batches:
        ids, where = b.column(0), pa.schema([("id", b.schema.field(0).type), ("position", pa.int32()), *[(n, pa.string()) for n in ("chapter", "kind", "text")]])
        rows, size = [], 0

        def piece() -> pa.RecordBatch:
            at, *parts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *[pa.array(p, f.type) for p, f in zip(parts, list(where)[1:], strict=True)]], schema=where)  # noqa: B023

        for k in range(b.num_rows):
            html = b.column(1)[k].as_py()
            rows += [(k, n, *r) for n, r in enumerate(flat(html))]
            size += len(html or "")
            if size >= PIECE and rows:
                yield piece()
                rows, size = [], 0
        if rows:
            yield piece()


def runs(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, position, chapter, kind, text) of every run of text of every page."""
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return source.mapInArrow(_flattened, f"id {kind}, position int, chapter string, kind string, text string")


def section_of(chapter: Column) -> Column:
    """The section a chapter heading stands for, or null."""

    def named(head: Column) -> Column:
        out = F.lit(None).cast("string")
        for start, key in reversed(CHAPTERS):
            out = F.when(head.startswith(start.lower()), F.lit(key)).otherwise(out)
        return out

    return once(F.lower(F.regexp_replace(strip(chapter), ":+$", "")), named)


# Labels that start a section inside a plain text.
INLINE_LABELS = {
    "Синтаксис:": "syntax", "Поля:": "fields", "Параметры:": "params", "Возвращаемое значение:": "returns", "Описание:": "description", "Описание варианта метода:": "description",
    "Доступность:": "availability", "Пример:": "example", "Примечание:": "note", "Использование в версии:": "platform_since",
}

# The same as one pattern, factored so that few alternatives are tried at each character.
_INLINE = "Синтаксис:|П(?:оля|араметры|ример|римечание):|Возвращаемое значение:|Описание(?: варианта метода)?:|Доступность:|Использование в версии:"


def inline_sections(text: Column | str) -> Column:
    """struct<intro, sections map<string,string>> of a text with labels; bodies of one section are joined by a blank line, empty ones left out."""
    label = _INLINE
    keys = F.create_map(*[F.lit(x) for pair in INLINE_LABELS.items() for x in pair])

    def read(whole: Column, parts: Column) -> Column:
        found = F.transform(F.regexp_extract_all(whole, F.lit(label), F.lit(0)), lambda x, i: F.struct(F.element_at(keys, x).alias("key"), normalized(F.get(parts, i + 1)).alias("body")))
        return once(F.filter(found, lambda x: x["body"] != ""), lambda kept: F.struct(strip(F.get(parts, F.lit(0))).alias("intro"), by_key(kept).alias("sections")))

    def by_key(kept: Column) -> Column:
        body = lambda k: F.array_join(F.transform(F.filter(kept, lambda x: x["key"] == k), lambda x: x["body"]), "\n\n")
        return F.map_from_entries(F.transform(F.array_distinct(F.transform(kept, lambda x: x["key"])), lambda k: F.struct(k.alias("key"), body(k).alias("value"))))

    return once(normalized(text), lambda whole: once(F.split(whole, label, -1), lambda parts: read(whole, parts)))


def sections(page_runs: DataFrame) -> DataFrame:
    """(id, section, body): runs of a chapter joined in their order; code between fences."""
    text = F.when(F.col("kind") == "code", F.concat(F.lit("```bsl\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    named = page_runs.withColumn("section", section_of(F.col("chapter"))).where("section is not null and kind <> 'cell_link'")
    kept = named.withColumn("_t", F.struct("position", text.alias("t")))
    joined = kept.groupBy("id", "section").agg(F.array_sort(F.collect_list("_t")).alias("_all"))
    return joined.select("id", "section", F.array_join("_all.t", "\n").alias("body"))


def see_also(page_runs: DataFrame) -> DataFrame:
    """(id, targets): link texts of the chapter that lists related pages, distinct and in order."""
    met = page_runs.where((section_of(F.col("chapter")) == "see_also") & F.col("kind").isin("link", "cell_link"))
    return met.groupBy("id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"])).alias("targets"))


def descriptor(page_runs: DataFrame) -> DataFrame:
    """(id, descriptor): the bracketed note below a page's title, before the first chapter."""
    head = page_runs.where("chapter = '' and kind in ('text', 'link')").groupBy("id")
    blob = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda s: s["text"]), " ")
    found = head.agg(F.regexp_extract(F.substring(blob, 1, 400), r"\[[^\]]{2,240}\]", 0).alias("descriptor"))
    return found.where("descriptor <> ''")


def markdown(page_runs: DataFrame) -> DataFrame:
    """(id, markdown): titles and chapters as headings, code between fences, tables between bars, other runs as paragraphs."""
    before = F.lag("chapter", 1, "").over(_in_order())
    head = F.when((F.col("chapter") != "") & (F.col("chapter") != before), F.concat(F.lit("## "), "chapter", F.lit("\n\n"))).otherwise("")
    body = F.when(F.col("kind") == "title", F.concat(F.lit("# "), "text")).when(F.col("kind") == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    parts = page_runs.where("kind <> 'cell_link'").withColumn("_m", F.concat(head, body))
    joined = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("position", "_m"))).alias("_all"))
    return joined.select("id", F.array_join("_all._m", "\n\n").alias("markdown"))


def _in_order():
    from pyspark.sql import Window

    return Window.partitionBy("id").orderBy("position")


def article(text: Column, least: int = 150) -> Column:
    """Article text without control characters and navigation lines; null if too short."""
    lines = F.filter(
        F.transform(F.split(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), "\n"), lambda x: squeezed(x)),
        lambda x: (x != "") & ~x.rlike(r"(?i)^(?:home|menu|back|next|previous|print|login|назад|далее|главная|печать|войти)$"),
    )
    kept = F.array_join(lines, "\n")
    return F.when(F.length(kept) >= least, kept)


def records(pages: DataFrame, page_runs: DataFrame, id_col: str, *, title: str, path: str, version: str, language: str) -> DataFrame:
    """One API record per page: title parts, kind, sections as columns, parameters, types and related names."""
    from packwright.functions import grammar as G
    from packwright.functions import paths as P
    from packwright.functions import text as T

    types = G.value_types(F.coalesce(F.nullif("returns", F.lit("")), G.described_type(F.col("description"))))
    keys = [k for _, k in CHAPTERS]
    wide = sections(page_runs).groupBy("id").pivot("section", keys).agg(F.first("body")).withColumnRenamed("version", "platform_since")
    base = pages.select(F.col(id_col).alias("id"), F.col(title).alias("title"), F.col(path).alias("topic_path"), F.col(version).alias("version"), F.col(language).alias("language"))
    joined = base.join(wide, "id", "left").join(see_also(page_runs), "id", "left").join(descriptor(page_runs), "id", "left")
    return joined.select(
        T.hash_id(F.col("version"), F.col("language"), F.col("topic_path")).alias("id"), "title", T.title_base("title").alias("full_name"),
        F.array_compact(F.array(T.title_synonym("title"))).alias("aliases"), P.member_kind(F.col("topic_path"), F.lit(None).cast("string")).alias("kind"),
        "description", "syntax", G.parameters(F.col("params")).alias("params"), "returns", types.alias("value_types"),
        F.col("example").alias("code"), F.col("note").alias("notes"), "platform_since", "availability", G.restrictions(F.col("note"), F.col("availability")).alias("restrictions"),
        F.col("descriptor").alias("page_descriptor"), F.coalesce("targets", F.array().cast("array<string>")).alias("see_also"), "topic_path", "version", "language",
    )

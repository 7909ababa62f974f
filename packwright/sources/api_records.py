"""API records of help pages: members, objects, examples and articles, shaped by column expressions.

The parser only flattens a page into runs; a page is one row from then on, so nothing is shuffled before records are merged.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from packwright.functions import grammar as G
from packwright.functions import paths as P
from packwright.functions import text as T
from packwright.operators import aliases, links
from packwright.plans.shared import spread, written
from packwright.sources import pages, unpacked

# How titles of functions of the language and of default constructors look, and bodies that only repeat a heading.
LANGUAGE_FUNCTIONS, DEFAULT_CONSTRUCTOR = "Встроенные функции языка.", ".По умолчанию"
EMPTY_BODIES = ("Описание:", "Тип:", "```", "```\n```")
MEMBERS = ("method", "property", "event", "constructor", "field", "function")
EXAMPLE = " — пример "
_RUN = types.StructType([types.StructField(n, types.StringType()) for n in ("chapter", "kind", "text")])


@F.pandas_udf(types.ArrayType(_RUN))
def page_runs(html: pd.Series) -> pd.Series:
    """The runs of text of each page, in order."""
    return html.map(lambda h: [{"chapter": c, "kind": k, "text": t} for c, k, t in pages.flat(h)])


def _joined(runs: Column, keep, fenced: bool = True) -> Column:
    def text(r: Column) -> Column:
        return F.when((r["kind"] == "code") & F.lit(fenced), F.concat(F.lit("```bsl\n"), r["text"], F.lit("\n```"))).otherwise(r["text"])

    return T.normalized(F.array_join(F.transform(F.filter(runs, keep), text), "\n"))


def read_pages(topics: DataFrame) -> DataFrame:
    """topics with page_title, intro, sections (section: body), see_also and page_descriptor in place of html.

    A page without chapters is read once more as plain text with labels inside. Lines of the intro that repeat the title
    or a title above are left out. Null and empty pages have neither intro nor sections.
    """
    sorted_runs = F.transform("_raw", lambda r: F.struct(pages.section_of(r["chapter"]).alias("section"), r["chapter"].alias("chapter"), r["kind"].alias("kind"), r["text"].alias("text")))
    rows = topics.withColumn("_raw", page_runs("html")).drop("html").withColumn("_runs", sorted_runs).drop("_raw")
    body = lambda r: ~r["kind"].isin("title", "cell_link", "version")
    keys = [k for _, k in pages.CHAPTERS]
    held = F.filter(F.array(*map(F.lit, keys)), lambda k: F.exists("_runs", lambda r: (r["section"] == k) & body(r)))  # most pages have few sections
    bodies = F.transform(held, lambda k: F.struct(k.alias("key"), _joined(F.col("_runs"), lambda r: (r["section"] == k) & body(r)).alias("value")))
    links_of = F.filter("_runs", lambda r: (r["section"] == "see_also") & r["kind"].isin("link", "cell_link"))
    head = _joined(F.col("_runs"), lambda r: (r["chapter"] == "") & r["kind"].isin("text", "link"))
    rows = rows.select(
        "*", T.first_nonblank(F.get(F.filter("_runs", lambda r: r["kind"] == "title"), F.lit(0))["text"], "title", "path").alias("page_title"),
        F.map_from_entries(F.filter(bodies, lambda b: b["value"] != "")).alias("_chapters"), F.array_distinct(F.transform(links_of, lambda r: r["text"])).alias("see_also"),
        F.regexp_extract(F.substring(head, 1, 400), r"\[[^\]]{2,240}\]", 0).alias("page_descriptor"),
        _joined(F.col("_runs"), lambda r: r["section"].isNull() & body(r)).alias("_loose"), F.array_join(F.transform(F.filter("_runs", lambda r: r["kind"] == "version"), lambda r: r["text"]), "\n").alias("_since"),
    ).drop("_runs")
    rows = rows.withColumn("_inline", F.when(F.size("_chapters") == 0, pages.inline_sections("_loose")))
    intro = F.coalesce(F.col("_inline.intro"), F.col("_loose"))
    plain = F.when(F.col("page_descriptor") != "", F.replace(intro, F.col("page_descriptor"), F.lit(""))).otherwise(intro)
    made = rows.withColumns({"intro": T.without_title_lines(plain, F.col("page_title"), F.col("breadcrumb")), "sections": F.coalesce(F.col("_inline.sections"), F.col("_chapters"))})
    since = T.first_nonblank(F.col("sections")["version"], F.col("sections")["platform_since"], "_since")
    return made.withColumn("platform_since", since).drop("_inline", "_chapters", "_loose", "_since")


def _section(key: str) -> Column:
    return T.strip(F.col("sections")[key])


def _bare(c: Column) -> Column:
    """A body without a fence around it, and nothing where it only repeats a heading."""
    unfenced = T.strip(F.regexp_replace(c, r"(?s)^```[^\n]*\n(.*?)\n?```$", "$1"))
    return F.when(c.isin(*EMPTY_BODIES), F.lit("")).otherwise(unfenced)


def kinds(rows: DataFrame) -> DataFrame:
    """rows with object_kind, kind (of a member, else topic) and role: member, object or topic."""
    path, title = F.concat(F.lit("/"), "path"), F.col("page_title")
    base = T.title_base("page_title")
    named = P.member_kind(path, F.col("entity_type"))
    told = F.lower(F.trim("entity_type")).isin(*MEMBERS)
    shaped = (_section("syntax") != "") | (_section("params") != "") | (_section("returns") != "")
    object_kind = P.object_kind(path, title)
    dotted = F.contains(base, F.lit(".")) | P.language_book(F.col("book_label"), path)
    method = shaped & dotted & ~F.lower(path).contains("/tables/") & (object_kind != "language_topic")
    kind = F.when((named == "method") & ~told & title.startswith(LANGUAGE_FUNCTIONS), "function").when(named != "topic", named)
    kind = kind.when(title.contains(DEFAULT_CONSTRUCTOR), "constructor").when(method, "method").otherwise("topic")
    rows = rows.withColumns({"object_kind": object_kind, "kind": kind})
    indexed = P.indexable(path, F.col("object_kind"), shaped | (_section("availability") != ""))
    return rows.withColumn("role", F.when(F.col("kind") != "topic", "member").when(indexed, "object").otherwise("topic"))


def records(topics: DataFrame, dealt: bool = False) -> DataFrame:
    """One row a page: role, names, texts, parameters, types, aliases and related names; articles have texts only.

    A member's full name has the title above it as its owner; a page whose title is blank is named by its path. Ties and
    repeated pages stay rows of their own until they are merged. Columns other than those of topics are not read. Topics
    that are dealt out to tasks already are parsed where they are.
    """
    # Pages are parsed once: what they hold is kept, so that later columns don't repeat the reading of their runs.
    topics = topics.select("key", "path", "title", "version", "language", "book_label", "entity_type", "breadcrumb", "html")
    rows = kinds(written(read_pages(topics if dealt else spread(topics))))
    member, topic = F.col("role") == "member", F.col("role") == "topic"
    title, base = F.col("page_title"), T.title_base("page_title")
    described = T.first_nonblank(_section("description"), "intro", _section("note"))
    syntax, returns = _bare(_section("syntax")), _bare(_section("returns"))
    rows = rows.withColumns({
        "full_name": F.when(member, T.qualified_name(title, F.col("kind"), F.col("breadcrumb"))).otherwise(base), "description": described,
        "summary": T.summary(T.first_nonblank(_section("description"), "intro", returns, syntax, title), 500),
    })
    typed = F.when((returns == "") & F.col("kind").isin("property", "field"), T.first_nonblank(G.described_type(_section("description")), G.described_type(F.col("summary")))).otherwise(returns)
    rows = rows.withColumns({
        "returns": typed, "syntax": F.when((syntax == "") & (F.col("kind") == "property"), F.col("full_name")).otherwise(syntax),
        "kind": F.when(member, F.col("kind")).when(topic, P.article_kind(F.col("path"))).when(F.col("object_kind") == "topic", "type").otherwise(F.col("object_kind")),
    })
    parts = T.name_parts("full_name")
    names = F.array(F.when(~member & ~topic, F.col("full_name")), F.when(title != F.col("full_name"), title), T.title_synonym(title))
    return rows.select(
        F.col("key").alias("id"), "role", F.when(member, parts["owner"]).otherwise(F.lit("")).alias("owner_name"), F.when(member, parts["member"]).otherwise(F.lit("")).alias("member_name"),
        F.when(F.col("role") == "object", F.col("full_name")).otherwise(F.lit("")).alias("object_name"), "full_name", "kind", title.alias("title"), "summary", "description",
        _section("note").alias("notes"), G.restrictions(_section("availability"), _section("note")).alias("restrictions"), "syntax", G.parameters(_section("params")).alias("params"), "returns",
        F.when(topic, F.array().cast("array<string>")).otherwise(G.value_types(T.first_nonblank("returns", "description", "summary"))).alias("value_types"), _section("availability").alias("availability"),
        "platform_since", "page_descriptor", "breadcrumb", "book_label", F.array_distinct(F.array_compact(names)).alias("aliases"), "see_also", _section("example").alias("example"),
        F.col("sections").alias("source_sections"), F.col("path").alias("topic_path"), "version", "language",
    )


def with_surface(rows: DataFrame) -> DataFrame:
    """Records with surface_aliases; articles have none."""
    api = aliases.with_aliases(rows.where("role <> 'topic'"), key="id", full="full_name", owner="owner_name", member="member_name", is_object=F.col("role") == "object")
    return api.unionByName(rows.where("role = 'topic'").withColumn("surface_aliases", F.array().cast("array<string>")))


def with_stubs(rows: DataFrame) -> DataFrame:
    """Records and, for each owner that no object record of its version and language is named like, a bare one."""
    stubs = unpacked.owner_stubs(rows.where("role = 'member'"), rows.where("role = 'object'"))
    key = T.hash_id(F.col("version"), F.col("language"), F.concat(F.lit("object:"), "full_name"))
    made = stubs.withColumns({"id": key, "role": F.lit("object"), "source_sections": F.create_map().cast("map<string,string>")})
    whole = rows.withColumn("resolver_kind", F.when(F.col("role") == "topic", F.lit("")).otherwise(F.concat(F.lit("platform_"), "role")))
    return whole.unionByName(made, allowMissingColumns=True)


def examples(rows: DataFrame) -> DataFrame:
    """One row for each code block of a member's example section, numbered in its title."""
    found = rows.where("role = 'member'").select("*", F.posexplode(F.filter(T.code_blocks("example"), lambda c: c != "")).alias("_at", "code"))
    title = F.concat("title", F.lit(EXAMPLE), (F.col("_at") + 1).cast("string"))
    told = T.summary(F.regexp_replace("example", r"(?s)```[^\n]*\n.*?```", ""), 300)
    return found.select(
        T.hash_id(F.col("version"), F.col("language"), F.concat("topic_path", F.lit("#example-"), (F.col("_at") + 1).cast("string"))).alias("id"), "owner_name", "member_name", "full_name", "kind",
        title.alias("title"), told.alias("description"), "code", "topic_path", "version", "language",
    )


def relations(rows: DataFrame) -> DataFrame:
    """Edges of all seven kinds between records, each once, with the versions of the records they start at."""
    api = rows.where("role <> 'topic' and full_name <> ''")
    told = links.resolved_links(links.see_also(api, "full_name", "see_also"), api, "target_name", "full_name", "topic")
    typed = aliases.typed_relations(api, full="full_name", owner="owner_name", member="member_name", is_object=F.col("role") == "object")
    edges = told.unionByName(typed, allowMissingColumns=True).dropDuplicates(["id"])
    held = api.groupBy("full_name").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    return edges.join(held, edges["source_full_name"] == held["full_name"]).drop("full_name")


def flat_records(rows: DataFrame) -> DataFrame:
    """One plain API record a page: a member with all its parts, an object without syntax, parameters and returns, an article with its text alone.

    Articles describe themselves in at most 1200 characters and have no notes, restrictions or sections.
    """
    member, topic = F.col("role") == "member", F.col("role") == "topic"
    only = lambda c, what=~topic: F.when(what, F.col(c)).otherwise(F.lit("")).alias(c)
    none = F.array().cast("array<struct<name:string,type:string,description:string>>")
    kind = F.when(topic, F.lit("topic")).otherwise(F.col("kind"))
    return rows.select(
        "id", F.col("full_name").alias("name"), kind.alias("kind"), "title", "summary", F.when(topic, T.summary("description", 1200)).otherwise(F.col("description")).alias("description"),
        only("notes"), only("restrictions"), only("syntax", member), F.when(member, F.col("params")).otherwise(none).alias("params"), only("returns", member),
        "value_types", only("availability"), only("platform_since"), only("page_descriptor"), "version", "language", "topic_path", "breadcrumb", kind.alias("entity_type"),
        F.when(topic, F.create_map().cast("map<string,string>")).otherwise(F.col("source_sections")).alias("source_sections"),
    )

"""Queries over the given tables, one per operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions import grammar as G
from packwright.functions import paths as P
from packwright.functions import resolver
from packwright.functions import text as T
from packwright.operators import aliases, code, fts, links, lookup, merge, stats, tree, vectors
from packwright.plans.shared import spread
from packwright.sources import api_records, categories, code_modules, config_xml, container, exports, help_books, markdown, pages, records, unpacked
from packwright.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with versions made from their ids, as records of several releases have."""
    d = F.col("doc_id")
    made = F.array(*[F.concat(F.lit("8.3."), (d % m).cast("string")) for m in (7, 11, 13)])
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(d % 5 > 0, made).otherwise(F.array().cast("array<string>")).alias("versions"))


# --- scalar functions ---------------------------------------------------------------------------------------


@query
def compact_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.compact("text", 200).alias("compacted"))


@query
def compact_summary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.summary("text", 150).alias("summary"))


@query
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.normalized("text"), 256).alias("digest"), F.length(T.normalized("text")).alias("n"))


@query
def hash_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.hash_id(F.lit("8.3"), F.lit("ru"), F.col("url")).alias("id"))


@query
def sha256_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query
def slug_source(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query
def safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_stem(F.concat("url", F.lit(".html"))).alias("stem"))


@query
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_title("html").alias("title"))


@query
def title_parts(spark, sf):
    title = F.concat_ws(" (", "p_name", F.concat("p_type", F.lit(")")))
    return table(spark, sf, "part").select("p_partkey", T.title_base(title).alias("base"), T.title_synonym(title).alias("synonym"))


@query
def qualified_names(spark, sf):
    title = F.concat_ws(" (", "p_name", F.concat("p_type", F.lit(")")))
    above = F.array(F.col("p_brand"), F.lit(" Methods "), F.lit(""), F.upper("p_name"))
    name = T.qualified_name(title, F.when(F.col("p_size") > 25, "method").otherwise("topic"), above)
    rows = table(spark, sf, "part").select("p_partkey", name.alias("qualified"))
    return rows.select("*", T.name_parts("qualified")["owner"].alias("owner"), T.name_parts("qualified")["member"].alias("member"))


@query
def text_without_titles(spark, sf):
    text = F.concat_ws("\n", F.concat("source", F.lit(" (heading)")), F.lit(" "), "text", F.upper("lang"))
    return table(spark, sf, "documents").select("doc_id", T.without_title_lines(text, F.col("source"), F.array("lang")).alias("body"))


@query
def inline_sections(spark, sf):
    text = F.concat_ws("\n", F.lit("Над ними"), F.concat(F.lit("Синтаксис: "), "source"), F.concat(F.lit("Описание:"), "text"), F.lit("Поля: "), F.concat(F.lit("Описание варианта метода: "), "lang"))
    rows = table(spark, sf, "documents").select("doc_id", pages.inline_sections(text).alias("s"))
    return rows.select("doc_id", "s.intro", F.col("s.sections")["syntax"].alias("syntax"), F.col("s.sections")["description"].alias("description"), F.size("s.sections").alias("n"))


@query
def owner_stubs(spark, sf):
    docs = table(spark, sf, "documents").where("source is not null and lang is not null")
    members = docs.select(F.col("source").alias("owner_name"), F.col("lang").alias("version"), F.lit("ru").alias("language"))
    objects = docs.select(F.col("source").alias("object_name"), F.lit("en").alias("version"), F.lit("ru").alias("language"))
    return unpacked.owner_stubs(members, objects).select("full_name", "version", "kind", "resolver_kind", "summary")


@query
def ranked_examples(spark, sf):
    part = table(spark, sf, "part")
    examples = part.select(F.concat_ws(".", "p_brand", "p_name").alias("full_name"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("code"))
    return lookup.ranked_examples(examples, "cold widget", 20)


@query
def code_blocks(spark, sf):
    fenced = F.concat(F.lit("a\n```sql\n"), F.translate("text", "`", "'"), F.lit("\n```\nb"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.code_blocks(fenced), "|").alias("code"))


@query
def search_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(T.tokens("text"), " ").alias("tokens"))


# --- versions -----------------------------------------------------------------------------------------------


@query
def version_sort(spark, sf):
    return versioned(spark, sf).select("doc_id", F.array_join(T.newest_first(F.col("versions")), ",").alias("versions"))


@query
def version_filter(spark, sf):
    """Rows without versions go; others keep the chosen ones among theirs."""
    chosen = F.array(F.lit("8.3.1"), F.lit("8.3.3"), F.lit("8.3.10"))
    rows = versioned(spark, sf).where((F.size("versions") > 0) & F.arrays_overlap("versions", chosen))
    return rows.select("doc_id", F.array_join(F.array_sort(F.array_intersect("versions", chosen)), ",").alias("versions"))


@query
def primary_version(spark, sf):
    """The least version in text order: 8.3.10 before 8.3.9."""
    return versioned(spark, sf).where(F.size("versions") > 0).select("doc_id", F.array_min("versions").alias("version"))


@query
def versions_seen(spark, sf):
    distinct = versioned(spark, sf).withColumn("versions", F.array_distinct("versions"))
    return stats.versions_seen(distinct, "versions")


@query
def version_match(spark, sf):
    rows = versioned(spark, sf).withColumn("version", F.array_min("versions"))
    return rows.where(lookup.applies_to(F.col("version"), F.col("versions"), "8.3.3")).select("doc_id")


# --- projections and predicates -----------------------------------------------------------------------------


@query
def first_nonblank_name(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.first_nonblank(F.when(F.col("doc_id") % 3 == 0, "  "), F.when(F.col("doc_id") % 2 == 0, F.col("source")), "lang").alias("name"))


@query
def record_payload(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.joined(30, "p_name", F.lit(" "), "p_brand", "p_type").alias("payload"))


@query
def field_identity(spark, sf):
    o = table(spark, sf, "lineitem")
    group = F.element_at(F.array(*map(F.lit, ("tabular_sections", "tabular_section_requisites", "form_attributes", "requisites"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    named = P.field_identity(F.concat(F.lit("Document.D"), F.col("l_suppkey")), group, F.concat(F.lit("f"), F.col("l_partkey")), F.col("l_returnflag"), F.when(F.col("l_orderkey") % 3 > 0, F.col("l_linestatus")))
    return o.select("l_orderkey", "l_linenumber", named["display_name"].alias("display_name"), named["topic_path"].alias("topic_path"))


@query
def exact_lookup_ascii(spark, sf):
    return lookup.equal_rows(table(spark, sf, "part"), "SMALL Ring", ["p_name", "p_type"], "ascii").select("p_partkey", "p_name")


@query
def exact_lookup_unicode(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Ünité "), "source").alias("name"), "text")
    first = d.where("doc_id = 0").select("text").first()
    return lookup.equal_rows(d, "üNITÉ SRC3", ["name"]).union(lookup.equal_rows(d, first["text"].swapcase() if first["text"].isascii() else first["text"], ["text"])).select("doc_id", "name")


@query
def like_find(spark, sf):
    met = lookup.containing_rows(table(spark, sf, "pages"), "EXAMPLE.com", ["url"])
    return met.orderBy(F.length("url"), "url", "page_id").limit(20).select("page_id", "url")


@query
def blank_and_form_check(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count_if(T.strip("text") == "").alias("n_blank"), F.count_if(F.contains(F.lower("text"), F.lit("licensed under"))).alias("n_form"))


@query
def exclusion_reasons(spark, sf):
    """Paths of every excluded class made from part rows, with the reason each is given."""
    shapes = ("Documents/D/Templates/T/Template.bin", "XDTOPackages/X/Package.bin", "Reports/R/Templates/T/Ext/Template/_files/a.txt", "Reports/R/Templates/T/Ext/Template/i.html", "a/b.PNG", "a/b.mxl", "Documents/D/Templates/T/Template.xml", "Documents/D/Templates/T/a.xml", "CommonModules/M/Ext/Module.bsl")
    path = F.element_at(F.array(*map(F.lit, shapes)), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    head = F.when(F.col("p_partkey") % 9 == 6, "<document xmlns=data/spreadsheet>").otherwise("<a>data:image/png;base64,aa</a>")
    rows = table(spark, sf, "part").select("p_partkey", path.alias("path"), P.exclusion_reason(path, F.col("p_size") * 100_000, head).alias("reason"))
    return rows.withColumn("reason", F.coalesce("reason", F.lit("kept")))


@query
def path_object_hint(spark, sf):
    rel = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    hint = P.object_hint(rel, F.lit(True))
    return table(spark, sf, "pages").select("page_id", hint["object_type"].alias("object_type"), hint["object_name"].alias("object_name"))


@query
def classify_kind(spark, sf):
    shapes = ("o/methods/a.html", "x/script functions/methods/a.html", "t/tables/q/fields/f.html", "o/properties/p.html", "o/events/e.html", "o/ctors/c.html", "a/form_x.html", "a/zif2_y.html")
    path = F.element_at(F.array(*[F.lit(f"/{s}") for s in shapes]), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", P.member_kind(path, F.lit("")).alias("kind"), P.article_kind(path).alias("article"))


@query
def json_props_project(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k >= 50")


# --- full text ----------------------------------------------------------------------------------------------


@query
def fts_postings(spark, sf):
    return fts.postings(table(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id", ["text"]).select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first_position"))


@query
def fts_corpus_stats(spark, sf):
    s = fts.corpus_stats(fts.document_lengths(table(spark, sf, "documents"), "doc_id", ["text", "source"]))
    return s.select("n_docs", "n_tokens", F.round("avg_len", 6).alias("avg_len"))


@query
def fts_match_and(spark, sf):
    return fts.matches(table(spark, sf, "documents"), "doc_id", ["text", "source"], "the AND erthor src7", "that src7").select("doc_id")


@query
def fts_phrase(spark, sf):
    return fts.matches(table(spark, sf, "documents"), "doc_id", ["text", "source"], "of_the").select("doc_id")


@query
def bm25_topk(spark, sf):
    scored = fts.bm25(table(spark, sf, "documents"), "doc_id", ["text", "source"], "that with from")
    rounded = scored.select("doc_id", F.round("score", 6).alias("score"))
    return rounded.orderBy("score", "doc_id").limit(10)


@query
def bm25_postings_topk(spark, sf):
    """The same ranking read from a postings table."""
    docs = table(spark, sf, "documents")
    index, lengths = fts.postings(docs, "doc_id", ["text", "source"]), fts.document_lengths(docs, "doc_id", ["text", "source"])
    scored = fts.bm25_indexed(index, lengths, "that with from")
    return scored.select("doc_id", F.round("score", 6).alias("score")).orderBy("score", "doc_id").limit(10)


@query
def search_cascade(spark, sf):
    """No name equals the query, so the text tier answers."""
    docs = table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")))
    found = fts.search(docs, "that with", id_col="doc_id", name_col="source", path_col="path", columns=["text", "source"], limit=10)
    return found.select("doc_id", "name", "tier", F.round("score", 5).alias("score"))


@query
def search_exact_tier(spark, sf):
    docs = table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "lang", "source"))
    return fts.search(docs, "EN/src3", id_col="doc_id", name_col="lang", path_col="path", columns=["text"], limit=15).drop("score")


@query
def exact_or_fts(spark, sf):
    return fts.exact_or_text(table(spark, sf, "documents"), "src5", id_col="doc_id", name_col="source", columns=["text"])


@query
def token_score_rank(spark, sf):
    score = lookup.token_score("the src1", F.col("source"), F.col("lang"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


def named_parts(spark, sf):
    """Parts as records with names, aliases and versions, as a pack's tables hold them."""
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(".", "p_brand", "p_name").alias("full_name"), F.col("p_name").alias("member_name"), F.col("p_name").alias("object_name"),
        F.when(F.col("p_size") % 3 == 0, "Глобальный контекст").otherwise(F.col("p_brand")).alias("owner_name"), F.array("p_type").alias("aliases"), F.array("p_brand").alias("surface_aliases"),
        F.concat(F.lit("8.3."), size).alias("version"), F.array(F.concat(F.lit("8.3."), size)).alias("versions"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("topic_path"),
    )


@query
def members_in_order(spark, sf):
    name = table(spark, sf, "part").agg(F.min("p_name")).first()[0]  # one name, to ask for
    return lookup.exact_members(named_parts(spark, sf), name, limit=50).select("p_partkey", "rank", "owner_name", "version", "topic_path")


@query
def objects_in_order(spark, sf):
    name = table(spark, sf, "part").agg(F.max("p_type")).first()[0]  # one type, which parts have as an alias
    return lookup.exact_objects(named_parts(spark, sf), name, limit=50).select("p_partkey", "rank", "version", "topic_path")


def part_pages(spark, sf):
    """Parts as pages of help: properties, methods, types and articles by size, each with a title, its brand above and chapters."""
    chapter = lambda name, c: F.concat(F.lit(f'<p class="V8SH_chapter">{name}:</p><p>'), c, F.lit("</p>"))
    kind = F.element_at(F.array(*map(F.lit, ("property", "method", "objects", "notes"))), (F.col("p_size") % 4 + 1).cast("int"))
    title = F.concat("p_name", F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    body = F.concat(F.lit('<html><h1 class="V8SH_pagetitle">'), title, F.lit("</h1>"), F.when(kind == "notes", F.concat(F.lit("<p>"), "p_type", F.lit("</p>"))).otherwise(F.concat(chapter("Описание", F.col("p_type")), chapter("Возвращаемое значение", F.col("p_brand")))), F.lit("</html>"))
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))  # dealt out before pages are made
    return parts.select(
        F.col("p_partkey").cast("long").alias("key"), F.concat_ws("/", kind, F.col("p_partkey").cast("string")).alias("path"), F.lit("").alias("title"), F.lit("8.3.1").alias("version"), F.lit("en").alias("language"),
        F.lit("").alias("book_label"), F.when(kind.isin("property", "method"), kind).otherwise("topic").alias("entity_type"), F.array("p_brand", F.lit("Methods")).alias("breadcrumb"), body.alias("html"),
    )


@query
def page_records(spark, sf):
    rows = api_records.records(part_pages(spark, sf), dealt=True)
    return rows.select(F.col("id").alias("p_partkey"), "role", "kind", "owner_name", "member_name", "full_name", "title", "summary", "description", "syntax", "returns", "topic_path")


@query
def flat_api_records(spark, sf):
    rows = api_records.flat_records(api_records.records(part_pages(spark, sf), dealt=True))
    return rows.select(F.col("id").alias("p_partkey"), "name", "kind", "description", "syntax", "returns", F.size("source_sections").alias("n_sections"))


@query
def member_exact_rank(spark, sf):
    full = F.concat_ws(".", "p_type", "p_name")
    rank = lookup.exact_rank("small ring", full, F.col("p_name"), F.array("p_brand", "p_type"))
    return table(spark, sf, "part").select("p_partkey", rank.alias("rank"))


@query
def any_field_lookup(spark, sf):
    rows = table(spark, sf, "part").withColumn("aliases", F.array("p_brand", "p_type"))
    return lookup.any_field(rows, "Brand#2", ["p_name"], ["aliases"]).select("p_partkey")


# --- merging and deduplication ------------------------------------------------------------------------------


@query
def content_hash_merge(spark, sf):
    d = table(spark, sf, "documents").withColumn("version", F.concat(F.lit("8.3."), F.col("doc_id") % 12))
    merged = merge.merge_by_content(d.select("doc_id", "lang", "text", "version"), language="lang", content=["text"], version="version", order="doc_id", suffix="doc")
    return merged.select("id", "lang", "content_hash", "doc_id", "version", F.array_join("versions", ",").alias("versions"))


@query
def latest_by_path(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.concat(F.lit("1."), F.col("event_id")).alias("version"))
    return merge.latest_per_path(e, "user_id", "version")


@query
def first_by_key(spark, sf):
    return merge.first_per_key(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query
def dedup_results(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("content_hash"))
    return merge.distinct_results(d, ["lang", "content_hash"], "doc_id")


@query
def distinct_ignoring_case(spark, sf):
    words = F.split(T.squeezed("text"), " ")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(merge.distinct_in_order(words), " ").alias("words"))


# --- graphs and joins ---------------------------------------------------------------------------------------


def _calls(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        (F.col("event_id") % 50).alias("module_id"), F.concat(F.lit("User"), F.col("user_id") % 20).alias("caller_name"),
        F.concat(F.col("event_type"), F.lit("_"), F.col("event_id") % 7).alias("callee_name"), F.col("event_id").alias("line"), F.lit(1).alias("args_count"),
    )


@query
def callees_topk(spark, sf):
    return code.callees(_calls(spark, sf), "USER3", 12)


@query
def callers(spark, sf):
    modules = spark.range(50).select(F.col("id").alias("module_id"), F.concat(F.lit("m/"), F.col("id")).alias("rel_path"))
    return code.callers(_calls(spark, sf), modules, "CLICK_3", 40)


@query
def related_links(spark, sf):
    e = links.edges(_calls(spark, sf), "caller_name", "callee_name", "calls").distinct()
    return links.related(e, "User5", 30)


@query
def link_extract(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.explode(links.html_links(F.col("html"))).alias("link"))
    return p.select("page_id", "link.href", "link.text")


@query
def link_resolve(spark, sf):
    p = table(spark, sf, "pages")
    found = p.select("page_id", F.explode(links.html_links(F.col("html"))).alias("link")).select("page_id", F.lower(F.ltrim("link.href", F.lit("/"))).alias("word"))
    targets = p.select(F.lower(F.regexp_extract("url", r"^[a-z]+://([a-z]+)\.", 1)).alias("host"))
    return links.resolved_links(found, targets.union(p.select(F.lit("the"))), "word", "host", "topic")


@query
def breadcrumb_tree(spark, sf):
    region = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    nation = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("title"))
    supplier = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.col("s_name").alias("title"))
    crumbs = tree.breadcrumbs(region.union(nation).union(supplier), "id", "parent", "title")
    return crumbs.select("id", "depth", F.array_join("breadcrumb", " / ").alias("breadcrumb"))


@query
def folder_tree(spark, sf):
    rel = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return tree.folders(table(spark, sf, "pages").select(rel.alias("path")), "path")


@query
def entries_blobs_left(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality")


@query
def owner_parent_resolve(spark, sf):
    """Lines with their order (misses go), its customer's nation (misses stay) and the part's name or its key."""
    key = F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).otherwise(-F.col("l_partkey"))  # no part has a key below 0
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("l_partkey"))
    buyer = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).otherwise(-F.col("o_custkey") - 1)
    order = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), buyer.alias("c_custkey"))
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    joined = line.join(order, "l_orderkey").join(customer, "c_custkey", "left").join(table(spark, sf, "nation"), "n_nationkey", "left").join(part, "l_partkey", "left")
    return joined.select("l_orderkey", "l_linenumber", "n_name", F.coalesce("p_name", F.col("l_partkey").cast("string")).alias("type_name"))


# --- statistics ---------------------------------------------------------------------------------------------


@query
def pack_stats(spark, sf):
    p = table(spark, sf, "pages").select(F.lit("page").alias("entry_type"), F.length("html").alias("size_bytes"))
    d = table(spark, sf, "documents").select(F.lit("document").alias("entry_type"), F.length("text").alias("size_bytes"))
    return stats.totals(p.union(d), "entry_type", "size_bytes")


@query
def domain_counts(spark, sf):
    return stats.counter(table(spark, sf, "documents"), "lang", "source")


@query
def ext_kind_counters(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    return stats.counter(table(spark, sf, "pages").select(F.regexp_extract(path, "//[^/]*[.]([a-z]+)/", 1).alias("ext"), F.when(F.contains("html", F.lit("<table")), "table").otherwise("text").alias("kind")), "ext", "kind")


@query
def bench_p95(spark, sf):
    q = stats.position_quantile(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")
    return q.select("l_returnflag", F.round("average", 6).alias("average"), "at_quantile")


@query
def top_property_profile(spark, sf):
    return stats.counter(table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", limit=8)


@query
def resolution_ratio(spark, sf):
    refs = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).otherwise(-F.col("o_custkey") - 1)
    return stats.resolution(table(spark, sf, "orders").select(refs.alias("ref")), table(spark, sf, "customer"), "ref", "c_custkey")


@query
def even_sample(spark, sf):
    return stats.even_sample(table(spark, sf, "documents").select(F.format_string("d%09d", "doc_id").alias("path")), "path", 25)


@query
def sample_verify(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    changed = d.withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return stats.digest_mismatches(changed, d, "doc_id", "text")


@query
def coverage_gap(spark, sf):
    """Nations that no supplier has."""
    return table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_name")


@query
def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    first = v.where("vec_id = 0").first()
    return vectors.cosine_topk(v, list(first["embedding"]), id_col="vec_id", vector_col="embedding", k=10)


# --- extraction ---------------------------------------------------------------------------------------------


def _runs(spark, sf):
    return pages.runs(table(spark, sf, "pages"), "page_id", "html")


@query
def html_runs(spark, sf):
    return _runs(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def html_to_markdown(spark, sf):
    return pages.markdown(_runs(spark, sf)).select(F.col("id").alias("page_id"), F.length("markdown").alias("n"), F.sha2("markdown", 256).alias("digest"))


@query
def html_sections(spark, sf):
    """Pages dressed as help pages: the page's text becomes its description and its first link a related page."""
    dressed = F.concat(F.lit('<h1 class="V8SH_pagetitle">T</h1>[method]<p class="V8SH_chapter">Описание:</p>'), "html", F.lit('<p class="V8SH_chapter">См. также:</p><a href="x">'), "url", F.lit("</a>"))
    runs = pages.runs(table(spark, sf, "pages").select("page_id", dressed.alias("html")), "page_id", "html")
    return pages.sections(runs).select(F.col("id").alias("page_id"), "section", F.length("body").alias("n"))


@query
def article_clean(spark, sf):
    text = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", ""), "<[^>]*>", "\n")
    return table(spark, sf, "pages").select("page_id", F.length(pages.article(text)).alias("n"))


@query
def md_sections(spark, sf):
    made = F.concat(F.lit("# T\n\nintro\n## One\n"), F.col("text"), F.lit("\n```\n## code\n```\n## Two\nend"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(markdown.sections(made)).alias("s"))
    return rows.select("conv_id", "turn", "s.heading", F.length("s.body").alias("n"))


def _modules(spark, sf):
    """Modules of three shapes: both tongues, comments, strings and nested brackets."""
    shapes = (
        '// Part %1$s\nFunction Get%2$d(A) Export\n  Return Find(A, Sum(1, %3$d));\nEndFunction\nVar V%2$d;\n',
        '// %1$s\n// Заметка (не вызов)\nПроцедура Шаг%2$d(А, Б = 1) Экспорт\n  Если Тест("a(b), ""c""", %3$d) Тогда\n    Х.Метод(1); // Вызов(2)\n  КонецЕсли;\nКонецПроцедуры\n',
        'Перем П%2$d, К%2$d Экспорт;\nProcedure Run%2$d()\n  Log(\n    "%1$s",\n    New Array(3),\n    Min(1, Max(2, 3)));\nEndProcedure\n',
    )
    code_text = F.element_at(F.array(*[F.format_string(x, "p_name", "p_partkey", "p_size") for x in shapes]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select(F.col("p_partkey").alias("module_id"), code_text.alias("text"))  # dealt out before texts are made


@query
def code_symbols(spark, sf):
    return code_modules.symbols(code_modules.tagged(_modules(spark, sf), dealt=True))


@query
def code_calls(spark, sf):
    return code_modules.calls(code_modules.tagged(_modules(spark, sf), dealt=True))


@query
def surface_resolve(spark, sf):
    chains = resolver.families(spark).select(F.concat("family", F.lit(".X.Найти")).alias("q")).union(resolver.collections(spark).select(F.concat(F.lit("Метаданные."), "family").alias("q")))
    return resolver.resolved(chains, "q").select("q", F.posexplode("candidates").alias("rank", "c")).select("q", "rank", "c.name", "c.lookup")


@query
def contents_breadcrumbs(spark, sf):
    entry = F.format_string('{%d,%d,0,{0,0,{0,0,{"ru","%s"}},"n%d.html"}}', F.col("n_nationkey") + 10, F.col("n_regionkey") + 1, "n_name", "n_nationkey")
    root = table(spark, sf, "region").select(F.format_string('{%d,0,0,{0,0,{0,0,{"ru","%s"}},""}}', F.col("r_regionkey") + 1, "r_name").alias("e"))
    text = root.union(table(spark, sf, "nation").select(entry.alias("e"))).agg(F.array_join(F.sort_array(F.collect_list("e")), ",").alias("text"))
    rows = container.contents_rows(text.select(F.lit("b").alias("book"), F.concat(F.lit("{30,"), "text", F.lit("}")).alias("text")), "book", "text")
    return container.contents_paths(rows).select("id", "title", F.array_join("breadcrumb", "/").alias("breadcrumb"))


@query
def configuration_fields(spark, sf):
    """A configuration file for each supplier: its object and fields as pack rows."""
    xml = F.format_string("<MetaDataObject><Catalog><Properties><Name>S%d</Name></Properties><ChildObjects><Attribute><Properties><Name>A%d</Name></Properties></Attribute></ChildObjects></Catalog></MetaDataObject>", "s_suppkey", "s_nationkey")
    files = table(spark, sf, "supplier").select(F.format_string("Catalogs/S%d.xml", "s_suppkey").alias("rel_path"), F.encode(xml, "UTF-8").alias("content"))
    rows = config_xml.fields(config_xml.crawl(files)).withColumns({c: F.lit(v) for c, v in (("config_version", "1.0"), ("defined_type", ""), ("constant_bsl_hint", ""))})
    return records.field_docs(rows).select("name", "topic_path", "payload")


@query
def event_windows(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events"), "ts", "event_type")


@query
def category_tree(spark, sf):
    """Pages in folders of which even ones list theirs backwards, odd ones have no list, and one is not reached."""
    shelf = F.concat(F.lit("s"), F.col("page_id") % 20)
    rows = table(spark, sf, "pages").select("page_id", shelf.alias("shelf"), F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("file"), "html")
    files = rows.select(F.concat_ws("/", "shelf", "file").alias("rel_path"), F.encode("html", "UTF-8").alias("content"))
    listed = rows.where("page_id % 20 % 2 = 0 and page_id % 3 > 0").groupBy("shelf").agg(F.sort_array(F.collect_list("page_id"), asc=False).alias("ids"))
    names = F.transform("ids", lambda i: F.concat(F.lit('{1,"p'), i.cast("string"), F.lit('.html"}')))
    lists = listed.select(F.concat("shelf", F.lit("/__categories__")).alias("rel_path"), F.encode(F.array_join(names, ","), "UTF-8").alias("content"))
    top = rows.where("page_id % 20 < 19").agg(F.sort_array(F.collect_set("shelf")).alias("all"))
    top = top.select(F.lit("__categories__").alias("rel_path"), F.encode(F.array_join(F.transform("all", lambda x: F.concat(F.lit('{1,"'), x, F.lit('"}'))), ","), "UTF-8").alias("content"))
    found = categories.category_tree(files.unionByName(lists).unionByName(top), root="")
    return found.select("path", "parent", "position", "title", "page", "depth", F.array_join("breadcrumb", " / ").alias("breadcrumb"))


@query
def help_books_found(spark, sf):
    """A listing of version folders at two depths with containers in several languages."""
    k = F.col("c_custkey")
    folder = F.concat(F.when(k % 3 == 0, F.concat(F.lit("x"), k % 4, F.lit("/"))).otherwise(""), F.when(k % 7 == 0, F.lit("8.x")).otherwise(F.concat(F.lit("8.3."), k % 23)))
    names = table(spark, sf, "customer").select(folder.alias("folder"), F.concat(F.lit("book "), "c_nationkey", F.element_at(F.array(*map(F.lit, ("_ru", "_EN", ""))), (k % 5 % 3 + 1).cast("int")), F.lit(".hbk")).alias("name"))
    row = lambda path, is_dir: F.struct(path.alias("rel_path"), F.lit(is_dir).alias("is_dir"))
    listed = names.select(F.explode(F.array(row(F.col("folder"), True), row(F.concat_ws("/", "folder", "name"), False))).alias("r")).select("r.*").distinct()
    near = help_books.version_folders(listed, "/data/help")
    asked = help_books.version_folders(listed, "/data/help", ["8.3.21", "8.x", "8.3.3", "9.9"])
    found = [help_books.help_books(listed, s, ["ru", "en"]).withColumn("asked", F.lit(a)) for s, a in ((near, False), (asked, True))]
    return found[0].unionByName(found[1])


@query
def snapshot_fields(spark, sf):
    """An export's records made of nations (objects) and suppliers (their fields), nested as a snapshot and listed again."""
    pick = lambda key, *names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    entry = lambda **f: F.map_from_arrays(F.array(*map(F.lit, f)), F.array(*f.values()))
    none = F.array().cast("array<string>")
    ref = lambda c: F.concat(F.lit("o"), c.cast("string"))
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    objects = table(spark, sf, "nation").select(F.lit("Объекты").alias("tag"), entry(Ref=ref(n), Тип=pick("n_nationkey", "Документ", "Справочник", "Константа", "Прочее"), Имя=F.col("n_name")).alias("fields"), none.alias("types"))
    parent = F.when(k % 4 == 1, F.concat(F.lit("s"), k - 1)).otherwise("")
    owned = entry(Ref=F.concat(F.lit("s"), k), Owner=ref(F.col("s_nationkey")), Parent=parent, Вид=pick("s_suppkey", "ТабличнаяЧасть", "Реквизит", "Измерение", "Прочее"), Имя=F.col("s_name"))
    types = F.when(k % 4 == 1, F.array(ref((F.col("s_nationkey") + 1) % 30), F.lit("Строка"))).otherwise(none)
    fields = table(spark, sf, "supplier").select(F.lit("Свойства").alias("tag"), owned.alias("fields"), types.alias("types"))
    read = objects.unionByName(fields).select(F.lit("export.xml").alias("rel_path"), "*")
    nested = exports.nested_objects(config_xml.export_objects(read), config_xml.export_fields(read), "C", "1")
    listed = exports.nested_fields(nested)
    return listed.select("object_id", "object_name", "object_type", "config_version", "group", "name", "kind", "type", F.array_join("types", "|").alias("types"), "tabular_section", "constant_bsl_hint")


@query
def parameter_lines(spark, sf):
    """A parameter section of one of three forms for each part."""
    shapes = ("<P%1$d> (обязательный)\nТип: %2$s .\n%3$s", "- **P%1$d** (%2$s) — %3$s\n<Q%1$d>", "<P%1$d>\nТип: %2$s\n%3$s\n- last %1$d")
    text = F.element_at(F.array(*[F.format_string(x, "p_partkey", "p_brand", "p_name") for x in shapes]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return spread(table(spark, sf, "part")).select("p_partkey", F.posexplode(G.parameters(text)).alias("n", "p")).select("p_partkey", "n", "p.*")


@query
def typed_relations(spark, sf):
    """Members of the global context, of the catalog of properties and of a family's items, and a family's manager, one a supplier."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    owners = (aliases.GLOBAL, aliases.CATALOG, "ДокументМенеджер.<Имя документа>", "")
    owner = F.element_at(F.array(*map(F.lit, owners)), (k % 4 + 1).cast("int"))
    member = F.when(k % 4 == 3, F.lit("ДокументыМенеджер")).otherwise(name)
    types = F.when(k % 4 == 0, F.array(F.lit("HTTPОтвет"), F.lit("слово"))).when(k % 4 == 1, F.array(F.concat(F.lit("ВидX"), k))).otherwise(F.array().cast("array<string>"))
    full = F.concat_ws(".", F.nullif(owner, F.lit("")), member)
    rows = table(spark, sf, "supplier").select(k.alias("id"), full.alias("full"), owner.alias("owner"), member.alias("member"), (k % 4 == 3).alias("obj"), types.alias("value_types"))
    named = {"full": "full", "owner": "owner", "member": "member", "is_object": F.col("obj")}
    found = aliases.typed_relations(aliases.with_aliases(rows, key="id", **named), **named)
    return found.select("source_full_name", "target_name", "target_lookup", "source_lookup", "link_kind")


@query
def html_tables(spark, sf):
    """A table of its nations for each region, the region across the top."""
    row = F.format_string("<tr><td>%d<td>%s</td></tr>", "n_nationkey", "n_name")
    nations = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.sort_array(F.collect_list(row)), "").alias("rows"))
    html = F.concat(F.lit("<p>x<table><tr><th colspan=2>"), "r_name", F.lit("</th></tr>"), "rows", F.lit("</table>y"))
    made = table(spark, sf, "region").join(nations, "r_regionkey").select("r_regionkey", html.alias("html"))
    return pages.runs(made, "r_regionkey", "html").where("kind = 'table'").select(F.col("id").alias("r_regionkey"), F.col("text").alias("markdown"))


@query
def hybrid_search(spark, sf):
    """Documents by text and by the vector of the same number, fused by their ranks."""
    docs = table(spark, sf, "documents")
    text = vectors.placed(fts.bm25(docs, "doc_id", ["text"], "and the"), "doc_id", "score", 50)
    own = table(spark, sf, "embeddings")
    query = own.where("vec_id = 7").select("embedding").first()["embedding"]
    near = vectors.cosine_topk(own.withColumnRenamed("vec_id", "doc_id"), query, id_col="doc_id", vector_col="embedding", k=50)
    fused = vectors.blended(text, vectors.placed(near, "doc_id", -F.col("cosine"), 50), "doc_id")
    return fused.select("doc_id", F.round("score", 9).alias("score"))

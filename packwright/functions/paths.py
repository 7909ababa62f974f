"""Columns that read meaning out of paths: hints, kinds, exclusion reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that can hold text, images, and parts of bundled pages.
TEXT_EXTENSIONS = ("bsl", "css", "html", "htm", "js", "json", "md", "mdo", "sql", "st", "svg", "txt", "xml", "xsd", "xsl")
IMAGE_EXTENSIONS = ("bmp", "gif", "ico", "jpeg", "jpg", "png", "svg", "tif", "tiff", "webp")
BUNDLE_EXTENSIONS = ("css", "html", "htm", "js")
SPREADSHEET_BYTES = 1_000_000


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; empty for none and for names that start with their only dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def exclusion_reason(path: Column, size: Column, prefix: Column | None = None) -> Column:
    """Why a file stays out of a pack, or null: the first of eight reasons that holds.

    ``prefix`` is the file's first bytes as lower-case text, for the two reasons that look inside.
    """
    inside = F.concat(F.lit("/"), path, F.lit("/"))
    template = inside.contains("/Templates/")
    ext, head = extension(path), F.coalesce(prefix if prefix is not None else F.lit(""), F.lit(""))
    sheet = (size >= SPREADSHEET_BYTES) & (file_name(path) == "Template.xml") & template
    image = head.contains("data:image/") & head.contains(";base64,")
    return (
        F.when(F.lower(file_name(path)) == "template.bin", "template-binary")
        .when(path.startswith("XDTOPackages/") & (file_name(path) == "Package.bin"), "xdto-binary")
        .when(template & inside.contains("/Ext/Template/_files/"), "template-html-asset")
        .when(template & inside.contains("/Ext/Template/") & ext.isin(*BUNDLE_EXTENSIONS), "template-html-bundle")
        .when(ext.isin(*IMAGE_EXTENSIONS), "image-asset")
        .when(ext == "mxl", "mxl-binary")
        .when(sheet & head.contains("<document") & head.contains("data/spreadsheet"), "spreadsheet-template")
        .when(template & ext.isin(*TEXT_EXTENSIONS) & image, "embedded-base64-image")
    )


def object_hint(path: Column, is_file: Column) -> Column:
    """struct(object_type, object_name) from the first two parts of a relative path."""
    parts = F.split(path, "/")
    one = F.size(parts) == 1
    name = F.when(is_file & (F.size(parts) == 2), stem(F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(1)))
    kind = F.when(one, F.when(is_file, "root_file").otherwise("root_dir")).otherwise(parts[0])
    return F.struct(kind.alias("object_type"), F.when(one, F.when(is_file, stem(path)).otherwise(path)).otherwise(name).alias("object_name"))


def module_hint(path: Column) -> Column:
    """struct(object_type, object_name, module_kind) of a code module's relative path."""
    parts = F.split(path, "/")
    form = F.array_position(parts, "Forms")
    form_name = F.get(parts, form.cast("int"))
    kind = (
        F.when((form > 0) & (F.coalesce(form_name, F.lit("")) != ""), F.concat(F.lit("FormModule:"), form_name))
        .when(form > 0, "FormModule")
        .when(F.get(parts, F.size(parts) - 2) == "Ext", stem(path))
        .when(F.lower(file_name(path)) == "module.bsl", "Module")
        .otherwise(stem(path))
    )
    return F.struct(
        parts[0].alias("object_type"), F.coalesce(F.get(parts, F.lit(1)), stem(path)).alias("object_name"), kind.alias("module_kind")
    )


def member_kind(path: Column, entity: Column) -> Column:
    """What a help page describes, from its entity type or its path."""
    known = F.lower(F.trim(F.coalesce(entity, F.lit(""))))
    low = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return (
        F.when(known.isin("method", "property", "event", "constructor", "field", "function"), known)
        .when(low.contains("/methods/") & low.contains("/script functions/"), "function")
        .when(low.contains("/methods/"), "method")
        .when(low.contains("/tables/") & low.contains("/fields/"), "field")
        .when(low.contains("/properties/"), "property")
        .when(low.contains("/events/"), "event")
        .when(low.contains("/ctors/"), "constructor")
        .otherwise("topic")
    )


# Kinds of pages that are no members, with what their paths or titles hold; the first that fits counts.
OBJECT_KINDS = (
    ("table", "/tables/", None), ("query_topic", "(?:^|/)shquery_", None), ("language_topic", "(?:^|/)(?:shclang_|embedlang|shlang_ru/)", None),
    ("global_context", None, "^Глобальный контекст"), ("metadata_object", None, "^ОбъектМетаданных:"), ("manager", None, "(?iu)менеджер"),
    ("global_context", "/global context[.]html$", None), ("enum", "/enums/", "(?iu)перечислен"), ("collection", "/collections/", "(?iu)коллекц"), ("type", "/objects/", None),
)
# Labels of books about the language itself.
LANGUAGE_BOOKS = ("shlang", "shclang", "embedlang")


def object_kind(path: Column, title: Column) -> Column:
    """What a page that is no member describes, by its path and its title without a synonym; else topic."""
    from packwright.functions.text import title_base

    low, base = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), title_base(title)
    out = F.lit("topic")
    for kind, in_path, in_title in reversed(OBJECT_KINDS):
        tests = [c.rlike(p) for c, p in ((low, in_path), (base, in_title)) if p]
        out = F.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(kind)).otherwise(out)
    return out


def language_book(label: Column, path: Column) -> Column:
    """Whether a page belongs to a book about the language: by the book's label without its language, or else by its path."""
    known = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    by_path = F.lower(F.coalesce(path, F.lit(""))).rlike("(?:^|/)(?:shclang_|shlang_|embedlang)")
    return F.when(known != "", F.regexp_replace(known, "_[^_]*$", "").isin(*LANGUAGE_BOOKS)).otherwise(by_path)


def article_kind(path: Column) -> Column:
    """form_help, cli_help or article, by the last part of a page's path."""
    last = F.lower(F.substring_index(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/", -1))
    return F.when(last.startswith("form_"), "form_help").when(last.rlike("^zif[0-9]*_"), "cli_help").otherwise("article")


def indexable(path: Column, kind: Column, has_sections: Column) -> Column:
    """Whether a page becomes an object record: by its kind, or as an object page that is no member's."""
    low = F.lower(F.coalesce(path, F.lit("")))
    member = low.contains("/methods/") | low.contains("/properties/") | low.contains("/events/") | low.contains("/ctors/")
    kinds = ("type", "manager", "enum", "collection", "global_context", "metadata_object", "table", "query_topic", "language_topic")
    return kind.isin(*kinds) | (low.contains("/objects/") & ~member) | (has_sections & low.contains("/objects/") & ~member)


def field_identity(object_id: Column, group: Column, name: Column, section: Column, form: Column) -> Column:
    """struct(display_name, topic_path) of a metadata field: four cases by its group."""

    def text(c: Column) -> Column:
        return F.trim(F.coalesce(c, F.lit("")))

    o, n, s, f = text(object_id), text(name), text(section), text(form)

    def dotted(*parts: Column) -> Column:
        return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ".")

    plain = F.when((o != "") & (n != ""), F.concat(o, F.lit("."), n)).otherwise(o)
    of_section, of_form = group == "tabular_section_requisites", group.isin("form_attributes", "form_commands")
    shown = F.when(of_section & (s != "") & (n != ""), F.concat(s, F.lit("."), n)).when(of_form, dotted(f, n)).otherwise(n)
    path = F.when(of_section, dotted(o, s, n)).when(of_form, dotted(o, F.lit("Forms"), f, n)).otherwise(plain)
    return F.struct(shown.alias("display_name"), path.alias("topic_path"))

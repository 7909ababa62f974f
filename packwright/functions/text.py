"""Text columns: compacting, normalising, folding, tokens, slugs, ids and version keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space (wider than the regex class of any engine).
WS = "\t-\r\x1c-\x20\x85\xa0  -     　"
#: The same without the line feed, and the characters besides it that end a line.
WS_IN_LINE = "\t\x0b-\r\x1c-\x20\x85\xa0  -     　"
LINE_ENDS = "\x0b-\r\x1c-\x1e\x85  "
#: Every character of WS and LINE_ENDS on its own, as trim and replace take them (far cheaper than classes of a pattern).
WS_CHARS, LINE_END_CHARS = ["".join(re.findall(f"[{x}]", "".join(map(chr, range(0x3001))))) for x in (WS, LINE_ENDS)]
_BASES = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xE0, 0x250)}
#: Latin letters with marks and the letters they are searched as; Cyrillic letters keep theirs.
MARKED = "".join(c for c, parts in _BASES.items() if len(parts) > 1 and "a" <= parts[0] <= "z")
UNMARKED = "".join(_BASES[c][0] for c in MARKED)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A search token: letters, digits and private-use characters; the underscore separates.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often it is read.

    Spark copies an expression into each place that reads it, also into lambdas, which compute it anew for every member
    of an array; a lambda's own variable is not copied.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.trim(_text(c), F.lit(WS_CHARS))


def squeezed(c: Column | str) -> Column:
    """Stripped, with every run of white space as one blank."""
    return F.regexp_replace(strip(c), f"[{WS}]+", " ")


def _cut(c: Column | str, most: int, mark: str) -> Column:
    t = squeezed(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - len(mark))), F.lit(mark)))


def compact(c: Column | str, most: int = 4000) -> Column:
    """One line of at most ``most`` characters, cut with an ellipsis; null is empty."""
    return _cut(c, most, "…")


def summary(c: Column | str, most: int = 500) -> Column:
    """As compact, cut with three full stops."""
    return _cut(c, most, "...")


def normalized(c: Column | str) -> Column:
    """Line ends unified, lines stripped on the right, the whole stripped."""
    whole = F.replace(_text(c), F.lit("\r\n"), F.lit("\n"))
    for end in LINE_END_CHARS:
        whole = F.replace(whole, F.lit(end), F.lit("\n"))
    return strip(F.array_join(F.transform(F.split(whole, "\n"), lambda x: F.rtrim(x, F.lit(WS_CHARS))), "\n"))


def fold(c: Column | str, how: str = "unicode") -> Column:
    """Case folding for lookups: all letters, or (``ascii``) A-Z only."""
    return F.lower(_text(c)) if how == "unicode" else F.translate(_text(c), UPPER, LOWER)


def search_text(c: Column | str) -> Column:
    """Lower case without Latin marks, the form that tokens are cut from."""
    low = F.lower(_text(c))
    return F.when(low.rlike(f"[{MARKED[0]}-{MARKED[-1]}]"), F.translate(low, MARKED, UNMARKED)).otherwise(low)  # translate looks each character up


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(search_text(c), F.lit(TOKEN), F.lit(0))


def slug(c: Column | str, empty: str = "unnamed") -> Column:
    dashed = F.regexp_replace(F.lower(squeezed(c)), r"[^\p{L}\p{N}_.-]+", "-")
    cut = F.regexp_replace(dashed, "^[._-]+|[._-]+$", "")
    return F.when(cut == "", F.lit(empty)).otherwise(cut)


def safe_stem(path: Column | str) -> Column:
    """A file's name without its last extension, odd characters as underscores."""
    name = F.regexp_replace(F.substring_index(_text(path), "/", -1), r"(.)\.[^.]*$", "$1")
    return F.regexp_replace(name, r"[^\p{L}\p{N}_.-]", "_")


def language_of_file(name: Column | str) -> Column:
    """The two letters before a container's extension, or null."""
    return F.nullif(F.lower(F.regexp_extract(_text(name), r"(?i)_([a-z]{2})\.[a-z]+$", 1)), F.lit(""))


def hash_id(*parts: Column) -> Column:
    """A 56-bit number from the digest of the parts, joined by bars."""
    key = F.concat_ws("|", *[_text(p) for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 14), 16, 10).cast("long")


def version_key(version: Column) -> Column:
    """Numbers of a dotted version, anything else as 0; arrays compare place by place."""
    return F.transform(F.split(version, "[.]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def newest_first(versions: Column) -> Column:
    """Distinct versions, greatest first by number; equal keys in text order."""

    def order(a: Column, b: Column) -> Column:
        x, y = version_key(a), version_key(b)
        return F.when(x > y, -1).when(x < y, 1).when(a < b, -1).when(a > b, 1).otherwise(0)

    kept = F.array_distinct(F.filter(F.transform(versions, lambda v: F.trim(v)), lambda v: v != ""))
    return F.array_sort(kept, order)


def is_version(c: Column) -> Column:
    return _text(c).rlike(r"^[0-9]+(\.[0-9]+){2,3}$")


def row_versions(versions: Column, version: Column) -> Column:
    """The sorted distinct versions of a record: the list, or else the single one, or none."""
    many = F.array_sort(F.array_distinct(F.filter(F.transform(versions, lambda v: F.trim(v)), lambda v: v != "")))
    one = F.when(F.trim(version) != "", F.array(F.trim(version))).otherwise(F.array().cast("array<string>"))
    return F.when(versions.isNotNull(), many).otherwise(F.coalesce(one, F.array().cast("array<string>")))


def first_nonblank(*cols: Column | str) -> Column:
    """The first column with something in it, stripped; empty if none has."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def joined(most: int, *cols: Column | str) -> Column:
    """Compacted parts joined by blanks and compacted again: the searchable payload of a record."""
    return compact(F.concat_ws(" ", *[F.nullif(compact(c, most), F.lit("")) for c in cols]), most)


def topic_path(path: Column, version: Column) -> Column:
    """A path with plain slashes, without leading ones and without its version's folder."""
    clean = F.regexp_replace(strip(F.replace(_text(path), F.lit("\\"), F.lit("/"))), "^/+", "")
    prefix = F.concat(strip(version), F.lit("/"))
    return F.when((prefix != "/") & clean.startswith(prefix), F.substring(clean, F.length(prefix) + 1, F.length(clean))).otherwise(clean)


def title_base(title: Column | str) -> Column:
    """A title without what follows its first opening parenthesis."""
    return strip(F.substring_index(strip(title), " (", 1))


def title_synonym(title: Column | str) -> Column:
    """What stands in parentheses behind a title, or null if it repeats the title or is empty."""
    t = strip(title)
    inside = strip(F.regexp_replace(strip(F.substring(t, F.instr(t, " (") + 2, F.length(t))), r"\)+$", ""))
    return F.when((F.instr(t, " (") > 0) & (inside != "") & (F.lower(inside) != F.lower(title_base(title))), inside)


# Contents titles that group pages and name no owner.
GROUP_TITLES = ["объекты", "типы", "методы", "свойства", "конструкторы", "события", "functions", "methods", "properties", "types", "events", "constructors"]
# Kinds of pages whose names stand behind their owner's.
MEMBER_KINDS = ["method", "property", "event", "constructor", "field"]


def member_parent(title: Column, breadcrumb: Column) -> Column:
    """The nearest title above a page that is not blank, its own or a group's; empty if there is none."""
    own = F.lower(strip(title))
    above = F.filter(F.transform(breadcrumb, strip), lambda x: (x != "") & (F.lower(x) != own) & ~F.lower(x).isin(GROUP_TITLES))
    return F.coalesce(F.try_element_at(above, F.lit(-1)), F.lit(""))


def qualified_name(title: Column, kind: Column, breadcrumb: Column) -> Column:
    """A title without its synonym, for members without a dot behind the title above them."""
    base = title_base(title)
    parent = member_parent(base, breadcrumb)
    return F.when(~F.contains(base, F.lit(".")) & kind.isin(MEMBER_KINDS) & (parent != ""), F.concat_ws(".", parent, base)).otherwise(base)


def name_parts(name: Column | str) -> Column:
    """struct<owner, member> of a dotted name, cut at its last dot; a plain name has an empty owner."""
    value = strip(name)
    member = F.substring_index(value, ".", -1)
    owner = F.when(F.contains(value, F.lit(".")), F.substring(value, F.lit(1), F.length(value) - F.length(member) - 1)).otherwise("")
    return F.struct(strip(owner).alias("owner"), strip(member).alias("member"))


def without_title_lines(c: Column | str, title: Column, breadcrumb: Column) -> Column:
    """A text without the blank lines and those that only repeat the page's title or one above it."""
    above = F.coalesce(F.transform(breadcrumb, lambda x: F.lower(strip(x))), F.array().cast("array<string>"))
    noise = F.array_append(F.filter(above, lambda x: x != ""), F.lower(title_base(title)))
    lines = F.filter(F.transform(F.split(normalized(c), "\n"), strip), lambda x: x != "")
    return once(noise, lambda titles: F.array_join(F.filter(lines, lambda x: ~F.array_contains(titles, F.lower(title_base(x)))), "\n"))


def code_blocks(c: Column | str) -> Column:
    """The bodies of fenced code blocks."""
    return F.transform(F.regexp_extract_all(_text(c), F.lit("```[^\n]*\n([^`]*)```"), F.lit(1)), strip)


def html_title(html: Column | str) -> Column:
    """The first heading, else the title element, else ``Untitled``; inner tags dropped.

    Elements and tags that are never closed take the rest of the text at once, so that each text is gone through once.
    """

    def inner(tag: str) -> Column:
        got = F.regexp_extract(_text(html), rf"(?is)<{tag}[^>]*+(?:>(?:(.*?)</{tag}>|.*)|\z)", 1)
        return F.nullif(squeezed(F.regexp_replace(got, "(?s)<[^>]*+>|(<.*)", "$1")), F.lit(""))

    return F.coalesce(inner("h1"), inner("title"), F.lit("Untitled"))


def without_embedded_images(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), r"(?i)data:image/[^;]+;base64,[A-Za-z0-9+/=\s]+", "[embedded-image]")

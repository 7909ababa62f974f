"""URL verdicts from rules and, where none fits, from per-host trees of path templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.common import ascii_lower, joined_by_key, written

# The rules, as verdict, host and start of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Words of host names that label a URL as blocked where neither a rule nor a given label does.
HOST_WORDS = ("adult", "ads", "bet", "bets", "casino", "malware", "phishing", "pill", "pills", "poker", "porn", "spam", "viagra", "warez")
#: Segments below this depth are one wildcard.
DEPTH = 6
#: Nodes with more children than this, or with many children seen hardly more than once, are variable.
MOST_CHILDREN, MANY_CHILDREN, SEEN = 50, 8, 2
#: Branches whose shares of blocked URLs differ by fewer standard errors than this are one branch.
APART = 1.96
#: A parent's share counts as so many labelled URLs of a branch; above a host stands an even share, so that no host
#: is rejected for what others hold.
PRIOR, EVEN = 4, 0.5
#: From this smoothed share of blocked URLs on a template is rejected.
REJECT = 0.7


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; null and texts without :// have neither."""
    text, pattern = F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule (host and path together, then the lesser text) that fits, and its verdict; else nulls."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        found = F.when(fits, F.lit(at + start)).otherwise(found)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return found, verdict


def suspect_host(host: Column) -> Column:
    """Whether a host's name holds one of HOST_WORDS, between dots and hyphens."""
    return host.rlike(f"(^|[.-])({'|'.join(HOST_WORDS)})([.-]|$)")


def skeleton(path: Column, depth: int = DEPTH) -> Column:
    """Segments of a path with numbers and long hexadecimal runs as #; what lies deeper is one segment **."""
    parts = F.array_remove(F.split(path, "/"), "")
    shapes = F.transform(F.slice(parts, 1, depth), lambda s: F.regexp_replace(s, "[0-9a-fA-F]{12,}|[0-9]+", "#"))
    return F.when(F.size(parts) > depth, F.concat(shapes, F.array(F.lit("**")))).otherwise(shapes)


def _share(blocked: Column, labelled: Column, above: Column) -> Column:
    """Share of blocked URLs, smoothed towards the share above."""
    return (blocked + PRIOR * above) / (labelled + PRIOR)


def _branches(rows: DataFrame) -> DataFrame:
    """Branches of every node, similar ones merged: host, node, step, child (the merged branch's name), child_share, n_rows.

    Labelled branches are put in order of their shares; each joins the one before it unless they lie apart. A node has at
    most MOST_CHILDREN branches here, so no window holds more rows. Branches without labels stay alone: they have their
    parent's share.
    """
    each = rows.groupBy("host", "node", "step").agg(
        F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.count(F.lit(1)).alias("n_rows"), F.first("share").alias("share")
    )
    known = each.where("labelled > 0").withColumn("own", F.col("blocked") / F.col("labelled"))
    order = Window.partitionBy("host", "node").orderBy("own", "step")
    before, n_before = F.lag("own").over(order), F.lag("labelled").over(order)
    pooled = (before * n_before + F.col("own") * F.col("labelled")) / (n_before + F.col("labelled"))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n_before + 1 / F.col("labelled")))
    apart = F.coalesce((F.col("own") - before > APART * spread).cast("int"), F.lit(0))
    grouped = known.withColumn("apart", apart).withColumn("branch", F.sum("apart").over(order))
    whole = Window.partitionBy("host", "node", "branch")
    merged = grouped.select(
        "host", "node", "step", "n_rows", "share", F.min("step").over(whole).alias("name"), F.count(F.lit(1)).over(whole).alias("members"),
        F.sum("blocked").over(whole).alias("blocked"), F.sum("labelled").over(whole).alias("labelled"),
    )
    alone = each.where("labelled = 0").select("host", "node", "step", "n_rows", "share", F.col("step").alias("name"), F.lit(1).cast("long").alias("members"), "blocked", "labelled")
    name = F.concat("node", F.lit("/"), "name", F.when(F.col("members") > 1, F.lit("|")).otherwise(F.lit("")))
    return merged.unionByName(alone).select("host", "node", "step", name.alias("child"), _share(F.col("blocked"), F.col("labelled"), F.col("share")).alias("child_share"), "n_rows")


def path_templates(urls: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, key (the segments' skeleton), n_urls, template, purity (its smoothed share of blocked URLs).

    ``urls`` has host, segments, blocked and labelled (0 or 1 each). Trees grow level by level over distinct
    skeletons with counts: at each node children are counted, the variable ones become *, similar ones merge, and
    the branch's share is smoothed towards its parent's; a host's towards EVEN. Levels end with the deepest
    path, at most depth + 1. Keys with many rows are split by joined_by_key; no host is ever one task.
    """
    counted = urls.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n_urls"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")
    )
    counted = written(counted)
    deepest = counted.agg(F.max(F.size("segments"))).first()[0] or 0
    hosts = written(
        counted.groupBy("host")
        .agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.count(F.lit(1)).alias("n_rows"))
        .select("host", _share(F.col("b"), F.col("l"), F.lit(EVEN)).alias("share"), "n_rows")
    )
    live = joined_by_key(counted, hosts, "host", "n_rows").drop("n_rows").withColumn("node", F.lit(""))
    out = [live.where(F.size("segments") == 0)]
    for k in range(1, deepest + 1):
        live = written(live.where(F.size("segments") >= k).withColumn("step", F.element_at("segments", k)))
        nodes = live.groupBy("host", "node", "step").agg(F.sum("n_urls").alias("n"), F.count(F.lit(1)).alias("n_rows"))
        nodes = nodes.groupBy("host", "node").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))
        variable = (F.col("kids") > MOST_CHILDREN) | (F.col("kids") >= MANY_CHILDREN) & (F.col("n") < SEEN * F.col("kids"))
        nodes = written(nodes.select("host", "node", variable.alias("variable"), "n_rows"))
        live = joined_by_key(live, nodes, ["host", "node"], "n_rows").drop("n_rows")
        live = live.withColumn("step", F.when(F.col("variable"), F.lit("*")).otherwise(F.col("step"))).drop("variable")
        branches = written(_branches(live))
        live = joined_by_key(live, branches, ["host", "node", "step"], "n_rows").drop("n_rows", "step", "node", "share")
        live = written(live.withColumnsRenamed({"child": "node", "child_share": "share"}))
        out.append(live.where(F.size("segments") == k))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("host", F.array_join("segments", "/").alias("key"), "n_urls", F.col("node").alias("template"), F.col("share").alias("purity"))


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, rules=RULES) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, template, purity.

    The longest fitting rule decides. Where none fits, the path's template does: its URLs are labelled by the rules,
    then by ``label_col`` (allow or block) if there is one, then by words of the host's name, and it is blocked when the
    smoothed share of blocked ones reaches REJECT: one such word does not block a host of one or two URLs.

    Null URLs and those without :// have an empty host and path, fit no rule and share the template of the empty host;
    very long URLs are taken whole, segments below DEPTH as one; repeated rows each count and fare alike; ties of
    shares are ordered by segment; an empty table gives no rows; null ids stay; other columns are not read, whatever
    their names.
    """
    host, path = host_and_path(F.col(url_col))
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("_pw_id"), host.alias("host"), path.alias("path"), label.alias("label"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("_pw_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.coalesce(verdict, "label", F.when(suspect_host(F.col("host")), "block")).alias("label"), skeleton(F.col("path")).alias("segments"))
    flags = rows.select("host", "segments", F.coalesce((F.col("label") == "block").cast("int"), F.lit(0)).alias("blocked"), F.coalesce(F.col("label").isin("allow", "block").cast("int"), F.lit(0)).alias("labelled"))
    templates = written(path_templates(flags))
    judged = joined_by_key(rows.withColumn("key", F.array_join("segments", "/")), templates, ["host", "key"], "n_urls")
    own = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(F.col("_pw_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", "purity")

"""Secret scans with corpus-wide ownership frequency.

Every candidate value is hashed, and each hash is counted by distinct repositories and distinct owners over
the whole corpus. A value that many owners have is a copied example; one that a single owner has looks
live. Base matches always stay; further candidates (provider tokens, signed tokens, long mixed strings)
are added only where the counts say that they are owner-specific.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import joined_back, match_spans, spans_text, tagged, written

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "token")
_SALTS = 16


def _base(text: Column) -> list[Column]:
    """Runs are maximal, so asking for the least length inside the pattern drops just the short ones."""
    return [
        match_spans(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
        match_spans(text, r"AKIA[A-Z0-9]{14,}"),
        match_spans(text, r"[0-9a-f]{16,}"),
    ]


def _further(text: Column) -> list[Column]:
    mixed = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}"

    def many_kinds(m: Column) -> Column:
        return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")

    return [
        match_spans(text, r"(?:gh[opsu]_|glpat-|sk-|xox[abps]-)[A-Za-z0-9_-]{16,}"),
        match_spans(text, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
        match_spans(text, mixed, many_kinds),
    ]


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def secret_scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    most_owners: int = 1,
    most_repos: int = 20,
) -> DataFrame:
    """One row per document row: doc_id, base, added, all (arrays of spans), n_live, n_copied.

    base and added hold structs (start, order, end, kind, found); n_live and n_copied count the base spans
    whose value is owner-specific or widely copied. Null and empty texts have no spans; a null owner or repository is
    one of its own; very long texts are searched whole, one row each; repeated rows get the same result and count
    once; of overlapping candidates the first, then the longer one stays; an empty table gives no rows; other columns
    are not read, whatever their names. Where documents carry no repository, each is its own, and a source stands for
    its owner: with few sources nearly every value looks owner-specific, so the number of repositories decides. A value is owner-specific if at most
    ``most_owners`` owners and ``most_repos`` repositories have it.
    """
    text = F.coalesce(F.col("_pw_text"), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_pw_id"), F.col(text_col).alias("_pw_text"),
        F.col(owner_col).cast("string").alias("_pw_owner"), F.col(repo_col).cast("string").alias("_pw_repo"),
    ).withColumn("_pw_key", F.xxhash64("_pw_text", "_pw_owner", "_pw_repo"))
    listed = F.concat(*[tagged(s, k, KINDS[k]) for k, s in enumerate(_base(text))])
    further = F.concat(*[tagged(s, 3, KINDS[3]) for s in _further(text)])
    # Texts are searched once; counting and judging read the spans.
    scanned = written(base.select("_pw_id", "_pw_key", "_pw_owner", "_pw_repo", listed.alias("base"), further.alias("_pw_more")))
    spans = scanned.select(
        "_pw_id", "_pw_key", "_pw_owner", "_pw_repo",
        F.explode(F.concat("base", F.filter("_pw_more", lambda s: ~_overlaps(s, F.col("base"))))).alias("_pw_span"),
    )
    value = F.when(
        F.col("_pw_span.kind") == "assign", F.regexp_extract("_pw_span.found", ASSIGN, 1)
    ).otherwise(F.col("_pw_span.found"))
    spans = spans.withColumn("_pw_hash", F.sha2(value, 256))
    # Rows of one value meet only as counts: pairs are made distinct on all three columns, then summed in two steps.
    owned = (
        spans.select("_pw_hash", F.coalesce("_pw_owner", F.lit("\0")).alias("o"), F.coalesce("_pw_repo", F.lit("\0")).alias("r"))
        .distinct()
        .groupBy("_pw_hash", "o")
        .agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("_pw_hash")
        .agg(F.count(F.lit(1)).alias("_pw_owners"), F.sum("repos").alias("_pw_repos"))
    )
    live = owned.where((F.col("_pw_owners") <= most_owners) & (F.col("_pw_repos") <= most_repos))
    live = live.select("_pw_hash", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_pw_salt"), F.lit(True).alias("_pw_live"))
    judged = (
        spans.withColumn("_pw_salt", F.pmod("_pw_key", F.lit(_SALTS)).cast("int"))
        .join(live, ["_pw_hash", "_pw_salt"], "left")
        .withColumn("_pw_live", F.coalesce("_pw_live", F.lit(False)))
        .groupBy("_pw_id", "_pw_key")
        .agg(
            F.collect_set(F.when((F.col("_pw_span.kind") == "token") & F.col("_pw_live"), F.col("_pw_span"))).alias("added"),
            F.countDistinct(F.when((F.col("_pw_span.kind") != "token") & F.col("_pw_live"), F.struct("_pw_span.start", "_pw_span.kind"))).alias("n_live"),
            F.countDistinct(F.when((F.col("_pw_span.kind") != "token") & ~F.col("_pw_live"), F.struct("_pw_span.start", "_pw_span.kind"))).alias("n_copied"),
        )
    )
    out = joined_back(scanned.drop("_pw_more"), judged)
    none = F.array().cast(scanned.schema["base"].dataType)
    # Where two further candidates overlap, the one that starts first stays, the longer of two that start together.
    added = F.aggregate(
        F.array_sort("added"), none,
        lambda acc, s: F.when(_overlaps(s, acc), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return out.select(
        F.col("_pw_id").alias(id_col), F.array_sort("base").alias("base"), F.coalesce(added, none).alias("added"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    ).withColumn("all", F.concat("base", "added"))


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of secret_scan's spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col, *[count(k) for k in KINDS[:3]], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("all")).alias("spans"), "n_live", "n_copied",
    )

"""Full-text search over a postings table: exact frequencies, phrases, BM25 and cheapest-first tiers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.functions.text import TOKEN, fold, search_text, tokens
from packwright.plans.shared import written

K1, B = 1.2, 0.75


def query_tokens(query: str) -> list[str]:
    """Words of a query; words like AND, OR and NOT are words like any other."""
    return [t for t in re.split(r"[^\wЀ-ӿ]+", query) if t]


def dotted_query_tokens(query: str) -> list[str]:
    """Words of a dotted name, as timings ask for them: dots and blanks part them, nothing else."""
    return query.replace(".", " ").split()


def postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(term, doc_id, col, tf, positions): one row for a term in a column of a document.

    Terms are exploded with their places and grouped back by (document, column, term), so no group is larger
    than one text.
    """
    parts = [
        docs.select(F.col(id_col).alias("doc_id"), F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("position", "term"))
        for c in columns
    ]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("term", "doc_id", "col")
        .agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))
    )


def document_lengths(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    size = reduce(lambda a, b: a + b, [F.size(tokens(F.col(c))) for c in columns])
    return docs.select(F.col(id_col).alias("doc_id"), size.cast("long").alias("doc_len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("n_tokens"), F.avg("doc_len").alias("avg_len"))


def _query_terms(docs: DataFrame, query: str) -> tuple[list[list[str]], DataFrame]:
    """The query's words, each as its index terms (several make a phrase), as Spark's own tokenizer cuts them."""
    words = query_tokens(query)
    if not words:
        return [], docs.sparkSession.range(0).toDF("x")
    one = docs.sparkSession.range(1).select(*[tokens(F.lit(w)).alias(str(i)) for i, w in enumerate(words)])
    return [t for t in one.first() if t], one


def match_counts(docs: DataFrame, id_col: str, columns: list[str], query: str) -> DataFrame:
    """(doc_id, phrase number, tf) for documents that hold every word of the query in any column.

    A word with an underscore is a phrase: its terms must stand side by side in one column. Only the query's
    terms are counted: texts are tokenised where they are read and shrink to a few numbers at once.
    """
    phrases, _ = _query_terms(docs, query)
    phrases = list(dict.fromkeys(map(tuple, phrases)))
    if not phrases:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(0).alias("phrase"), F.lit(0).alias("tf")).limit(0)

    def times(words: Column, phrase: tuple[str, ...]) -> Column:
        side = lambda w, i: reduce(lambda a, b: a & b, [F.get(words, i + k) == t for k, t in enumerate(phrase) if k], w == phrase[0])
        return F.size(F.filter(words, side if len(phrase) > 1 else lambda w: w == phrase[0]))

    # A text's words are a lambda's variable, cut once; as a column they would be cut anew for each place and filter.
    names = [f"tf{n}" for n in range(len(phrases))]
    none = F.struct(F.lit(0).cast("long").alias("doc_len"), *[F.lit(0).alias(n) for n in names])

    def with_column(acc: Column, words: Column) -> Column:
        return F.struct((acc["doc_len"] + F.size(words)).alias("doc_len"), *[(acc[n] + times(words, p)).alias(n) for n, p in zip(names, phrases, strict=True)])

    counted = F.aggregate(F.array(*[tokens(F.col(c)) for c in columns]), none, with_column)
    # Filters on exploded columns stay above, so that they don't count a second time.
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(counted)).alias("_c")).select("doc_id", "_c.*")


def bm25(docs: DataFrame, id_col: str, columns: list[str], query: str) -> DataFrame:
    """(doc_id, score): documents that match all words, smaller scores first as better ones.

    score = -sum(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))), idf = ln((N - n + .5) / (n + .5))
    and at least 1e-6. One pass counts and keeps a few numbers a document; totals, one row, and hits are read from those.
    """
    counts = match_counts(docs, id_col, columns, query)
    names = [c for c in counts.columns if c.startswith("tf") and c != "tf"]
    if not names:
        return counts.select("doc_id", F.lit(0.0).alias("score"))
    counts = written(counts)
    totals = counts.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"), *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in names]
    ).first()
    hits = counts.where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in names]))
    score = F.lit(0.0)
    for c in names:
        n, total = totals[f"n_{c}"], totals["n_docs"]
        idf = F.greatest(F.log(F.lit((total - n + 0.5) / (n + 0.5))), F.lit(1e-6))
        norm = K1 * (1 - B + B * F.col("doc_len") / F.lit(totals["avg_len"] or 1.0))
        score = score - idf * F.col(c) * (K1 + 1) / (F.col(c) + norm)
    return hits.select("doc_id", score.alias("score"))


def _stands_in(text: Column, phrase: tuple[str, ...]) -> Column:
    """Whether a search text holds these terms side by side; a term is a whole run of token characters, which take one or two places each."""
    inside = TOKEN.removesuffix("+")
    between = inside.replace("[", "[^", 1) + "+"
    return text.rlike(f"{phrase[0]}(?<!{inside}{{1,2}}{phrase[0]})" + "".join(between + t for t in phrase[1:]) + f"(?!{inside})")


def matches(docs: DataFrame, id_col: str, columns: list[str], *queries: str) -> DataFrame:
    """(doc_id, query): the documents that bm25 finds for each query, told by its number, without their scores.

    Texts are read once for all queries and searched for the queries' terms, not cut into words; nothing is counted.
    """
    asked = [sorted(set(map(tuple, _query_terms(docs, q)[0])), key=lambda p: (-len("".join(p)), p)) for q in queries]  # long words are rare
    texts = [f"_s{k}" for k in range(len(columns))]
    every = [reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [_stands_in(F.col(t), p) for t in texts]) for p in phrases], F.lit(bool(phrases))) for phrases in asked]
    rows = docs.select(F.col(id_col).alias("doc_id"), *[search_text(F.col(c)).alias(t) for c, t in zip(columns, texts, strict=True)])
    # A filter above the generator reads its column and is not copied to the texts.
    return rows.select("doc_id", F.posexplode(F.array(*every)).alias("query", "_met")).where("_met").select("doc_id", "query")


def bm25_indexed(index: DataFrame, lengths: DataFrame, query: str, totals: dict | None = None) -> DataFrame:
    """As bm25, from a postings table: only the query's terms are read, phrases are found by their positions.

    The filter on terms reaches the Parquet scan, where sorted terms leave most row groups unread; documents
    meet their lengths in one join of the hits. totals (n_docs, avg_len) are counted if a pack doesn't give them.
    """
    phrases, _ = _query_terms(index, query)
    phrases = list(dict.fromkeys(map(tuple, phrases)))
    terms = list(dict.fromkeys(t for p in phrases for t in p))
    if not terms:
        return lengths.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    hits = index.where(F.col("term").isin(terms))
    places = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{k}") for k, t in enumerate(terms)]
    none = F.array().cast("array<int>")
    at = [F.coalesce(F.col(f"p{k}"), none) for k in range(len(terms))]

    def times(phrase: tuple[str, ...]) -> Column:
        own = [at[terms.index(t)] for t in phrase]
        beside = lambda p: reduce(lambda x, y: x & y, [F.array_contains(o, p + k) for k, o in enumerate(own) if k], F.lit(True))
        return F.size(F.filter(own[0], beside))

    by_column = hits.groupBy("doc_id", "col").agg(*places).select("doc_id", *[times(p).alias(f"tf{n}") for n, p in enumerate(phrases)])
    names = [f"tf{n}" for n in range(len(phrases))]
    counts = by_column.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in names])
    found = counts.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in names]).first()  # one row
    total = totals or corpus_stats(lengths).first().asDict()
    met = counts.where(reduce(lambda x, y: x & y, [F.col(c) > 0 for c in names])).join(lengths, "doc_id")
    norm = K1 * (1 - B + B * F.col("doc_len") / F.lit(total["avg_len"] or 1.0))
    score = F.lit(0.0)
    for c in names:
        idf = F.greatest(F.log(F.lit((total["n_docs"] - found[c] + 0.5) / (found[c] + 0.5))), F.lit(1e-6))
        score = score - idf * F.col(c) * (K1 + 1) / (F.col(c) + norm)
    return met.select("doc_id", score.alias("score"))


def search(
    docs: DataFrame, query: str, *, id_col: str, name_col: str, path_col: str, columns: list[str], limit: int = 10, how: str = "unicode", exact_only: bool = False
) -> DataFrame:
    """Cheapest tier first: equal name or path, and only if there is none, full text by (score, exact, length)."""
    wanted = fold(F.lit(query), how)
    exact = docs.where((fold(F.col(name_col), how) == wanted) | (fold(F.col(path_col), how) == wanted))
    shown = [F.col(id_col).alias("doc_id"), F.col(name_col).alias("name")]
    tier0 = exact.select(*shown, F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    if exact_only or not exact.isEmpty():
        return tier0.orderBy("doc_id").limit(limit)
    scored = bm25(docs, id_col, columns, query)
    named = docs.select(*shown).join(scored, "doc_id")
    return named.select("doc_id", "name", F.lit(1).alias("tier"), "score").orderBy("score", F.length("name"), "doc_id").limit(limit)


def exact_or_text(docs: DataFrame, query: str, *, id_col: str, name_col: str, columns: list[str]) -> DataFrame:
    """Ids whose name equals the query or whose text matches all its words, each once."""
    exact = docs.where(fold(F.col(name_col)) == fold(F.lit(query))).select(F.col(id_col).alias("doc_id"))
    return exact.union(matches(docs, id_col, columns, query).select("doc_id")).distinct()


def write_postings(table: DataFrame, path: str) -> None:
    """Postings by ranges of terms, sorted, so that a term's row groups are found from the footers."""
    table.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("compression", "zstd").parquet(path)


def ranked_in_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))

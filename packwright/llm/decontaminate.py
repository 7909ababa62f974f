"""Benchmark decontamination by a prefix-filtered containment join, in DataFrame operations only.

A window is ``window`` consecutive words of a benchmark item (all words of a shorter item). A document
contains a window only if it contains every shingle of the window, so one shingle is prefix enough: the
one that is rarest in the documents, by a count over all of them. Documents' shingles meet these
prefix shingles in an equi-join; the shingle's offset fixes where the window must start, which has to
lie inside the document (the positional and length bounds), and the words there are compared one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import joined_back, released, small_enough, texts, word_array


def _shingle(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(_pw_item, _pw_from, _pw_window): every window of every item; items without words have none."""
    words = items.select(F.col(item_col).alias("_pw_item"), word_array(F.col(text_col)).alias("_pw_words"))
    words = words.where(F.size("_pw_words") > 0).withColumn("_pw_len", F.least(F.size("_pw_words"), F.lit(window)))
    starts = F.sequence(F.lit(0), F.size("_pw_words") - F.col("_pw_len"))
    each = F.transform(starts, lambda i: F.slice("_pw_words", i + 1, F.col("_pw_len")))
    return words.select("_pw_item", F.posexplode(each).alias("_pw_from", "_pw_window"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row per document row: doc_id, _pw_key, n_words, n_hit, n_items, items (sorted ids as text), contaminated.

    Null and empty texts have no words and hit nothing; items without words are ignored; very long texts are whole
    word arrays of one row; of a window's shingles that are equally rare the first is taken; repeated rows
    each get the same result; items that repeat an id count once; empty tables give no rows or no hits; other columns
    are not read, whatever their names. Windows are broadcast only after a count shows at most ``broadcast_rows``
    of them; beyond that the shingles are shuffled and the words compared after joining the text again.
    """
    wins = item_windows(items, item_col, item_text_col, window).distinct()
    few = small_enough(wins, broadcast_rows)
    sent = F.broadcast if few else (lambda df: df)
    base = texts(docs, id_col, text_col).withColumn("_pw_words", word_array(F.col("_pw_text"))).drop("_pw_text")
    sizes = [
        r[0]
        for r in wins.select(F.least(F.size("_pw_window"), F.lit(shingle)).alias("s")).distinct().limit(shingle).collect()
    ]
    released(docs.sparkSession)
    hits = [_hits(base, wins, size, shingle, sent, few) for size in sorted(sizes)]
    counted = base.select("_pw_id", "_pw_key", F.size("_pw_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if not hits:
        return counted.select(
            F.col("_pw_id").alias(id_col), "_pw_key", "n_words", F.lit(0).cast("long").alias("n_hit"),
            F.lit(0).cast("long").alias("n_items"), none.alias("items"), F.lit(False).alias("contaminated"),
        )
    found = (
        reduce(DataFrame.unionByName, hits)
        .groupBy("_pw_id", "_pw_key")
        .agg(
            F.array_sort(F.collect_set(F.struct("_pw_start", "_pw_len"))).alias("_pw_spans"),
            F.array_sort(F.collect_set(F.col("_pw_item").cast("string"))).alias("items"),
        )
        .withColumn("n_hit", _covered(F.col("_pw_spans")))
    )
    out = joined_back(counted, found)
    return out.select(
        F.col("_pw_id").alias(id_col),
        "_pw_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _covered(spans: Column) -> Column:
    """Words covered by spans of (start, length) sorted by start, each word counted once."""

    def step(acc: Column, s: Column) -> Column:
        end = s["_pw_start"] + s["_pw_len"]
        fresh = F.greatest(end - F.greatest(acc["end"], s["_pw_start"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def _hits(base: DataFrame, wins: DataFrame, size: int, shingle: int, sent, few: bool) -> DataFrame:
    """(_pw_id, _pw_key, _pw_start, _pw_len, _pw_item) of every occurrence of a window with this shingle size."""
    n = F.size("_pw_window")
    mine = wins.where(n == size if size < shingle else n >= size)
    grams = mine.withColumn("_pw_at", F.explode(F.sequence(F.lit(0), n - size))).withColumn(
        "_pw_hash", _shingle(F.col("_pw_window"), F.col("_pw_at"), size)
    )
    places = base.where(F.size("_pw_words") >= size).select(
        "_pw_id", "_pw_key", "_pw_words", F.posexplode("_pw_words").alias("_pw_pos", "_pw_word")
    )
    places = places.withColumn("_pw_hash", _shingle(F.col("_pw_words"), F.col("_pw_pos"), size)).drop("_pw_word")
    seen = (
        places.select("_pw_hash")
        .join(sent(grams.select("_pw_hash").distinct()), "_pw_hash", "left_semi")
        .groupBy("_pw_hash")
        .agg(F.count(F.lit(1)).alias("_pw_n"))
    )
    # A window whose shingle occurs nowhere occurs nowhere itself: the inner join drops it with min() below.
    ranked = grams.join(seen, "_pw_hash", "left").withColumn("_pw_n", F.coalesce("_pw_n", F.lit(0)))
    prefix = (
        ranked.groupBy("_pw_item", "_pw_from", "_pw_window")
        .agg(F.min(F.struct("_pw_n", "_pw_at", "_pw_hash")).alias("_pw_rarest"))
        .where(F.col("_pw_rarest._pw_n") > 0)
        .select("_pw_item", "_pw_window", "_pw_rarest._pw_at", "_pw_rarest._pw_hash")
    )
    start, length = F.col("_pw_pos") - F.col("_pw_at"), F.size("_pw_window")
    equal = F.slice("_pw_words", F.col("_pw_start") + 1, F.col("_pw_len")) == F.col("_pw_window")
    inside = (F.col("_pw_start") >= 0) & (F.col("_pw_start") + F.col("_pw_len") <= F.col("_pw_n_words"))
    kept = ["_pw_id", "_pw_key", "_pw_start", "_pw_len", "_pw_item"]
    if few:
        met = places.withColumn("_pw_n_words", F.size("_pw_words")).join(F.broadcast(prefix), "_pw_hash")
        met = met.withColumn("_pw_start", start).withColumn("_pw_len", length)
        return met.where(inside).where(equal).select(*kept)
    narrow = places.select("_pw_id", "_pw_key", "_pw_pos", "_pw_hash", F.size("_pw_words").alias("_pw_n_words"))
    met = narrow.join(prefix, "_pw_hash").withColumn("_pw_start", start).withColumn("_pw_len", length).where(inside)
    return joined_back(met, base.distinct()).where(equal).select(*kept)

"""Token counts as an exact length histogram with suffix sums."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.common import small_batches

# Fixed value: how byte-level pair encodings split a text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("packwright", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def _lengths(vocabulary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        counts: Counter[int] = Counter()
        for batch in batches:
            col = batch.column(0)
            for i in range(len(col)):
                text = col[i].as_py()
                counts[len(encode(text)) if text else 0] += 1
        keys = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([counts[x] for x in keys], pa.int64())], ["n_tokens", "n_docs"]
        )

    return run


def length_histogram(docs: DataFrame, vocabulary_path: str, *, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length. Null and empty texts have length 0.

    Very long texts are encoded whole; repeated rows each count; lengths that tie are one row; an empty table gives no
    rows; other columns are not read, whatever their names.

    The vocabulary (ranks, one a line) is read through Spark, so its path may be in any store, and travels with
    the function: a public vocabulary has a megabyte or so, whatever the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = bytes(spark.read.format("binaryFile").load(vocabulary_path).select("content").first()[0])
    each = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_lengths(vocabulary), "n_tokens long, n_docs long")
    return each.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length: documents and tokens of at least that length, and totals cut at it.

    docs_from and tokens_from count documents at least that long and their tokens; total_cut is the sum of
    min(length, n_tokens), what a context of n_tokens keeps; share_upto is the share of documents no longer
    than it, from which quantiles are read. The window runs over distinct lengths only, never documents.
    """
    up, all_rows = Window.orderBy(F.desc("n_tokens")), Window.partitionBy()
    tokens = F.col("n_tokens") * F.col("n_docs")
    sums = histogram.select(
        "n_tokens", "n_docs", F.sum("n_docs").over(up).alias("docs_from"), F.sum(tokens).over(up).alias("tokens_from"),
        F.sum(tokens).over(all_rows).alias("tokens_total"), F.sum("n_docs").over(all_rows).alias("_pw_docs"),
    )
    below = F.col("tokens_total") - F.col("tokens_from")
    return sums.select(
        "n_tokens", "n_docs", "docs_from", "tokens_from", "tokens_total",
        (below + F.col("n_tokens") * F.col("docs_from")).alias("total_cut"),
        (1 - (F.col("docs_from") - F.col("n_docs")) / F.col("_pw_docs")).alias("share_upto"),
    )


def total_cut_at(sums: DataFrame, limit: int) -> int:
    """Tokens kept with this context limit, which needn't be a length that occurs."""
    row = sums.where(F.col("n_tokens") > limit).orderBy("n_tokens").select("docs_from", "tokens_from", "tokens_total").first()
    if row is None:
        return sums.agg(F.max("tokens_total")).first()[0] or 0
    return row["tokens_total"] - row["tokens_from"] + limit * row["docs_from"]


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that this share of documents doesn't exceed."""
    return sums.where(F.col("share_upto") >= q).agg(F.min("n_tokens")).first()[0]

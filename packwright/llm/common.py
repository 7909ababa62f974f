"""Columns and helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.plans.shared import released, shared_folder, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What lies between words: every ASCII character but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space between plain words.
BLANKS = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Lower-cased words of a text; null and blank texts have none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def plain_words(text: Column) -> Column:
    """Words between blanks, case kept; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_pw_id, _pw_text, _pw_key): a row is known by its id and its text's hash, so repeated rows agree."""
    return docs.select(F.col(id_col).alias("_pw_id"), F.col(text_col).alias("_pw_text")).withColumn(
        "_pw_key", F.xxhash64("_pw_text")
    )


def joined_back(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows, each with what was found for its (_pw_id, _pw_key), or nulls; null ids match null ids."""
    found = found.withColumnsRenamed({"_pw_id": "_pw_id_found", "_pw_key": "_pw_key_found"})
    same = F.col("_pw_id").eqNullSafe(F.col("_pw_id_found")) & F.col("_pw_key").eqNullSafe(F.col("_pw_key_found"))
    return rows.join(found, same, "left").drop("_pw_id_found", "_pw_key_found")


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; null ids are never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most this many rows: the check before any broadcast."""
    return df.count() <= rows


def joined_by_key(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with a written table of distinct keys, whose column ``count`` says how many rows have each.

    Keys that more than a thousandth of these rows have are at most a thousand: they are sent to every task, so that
    no task gets all rows of a frequent key. The others are shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    every, most = table.agg(F.sum(count), F.max(count)).first()
    bound = max((every or 0) // 1000, 1000)
    if (most or 0) <= bound:
        return rows.join(table, keys, how)
    often = F.col(count) > bound
    hot = table.where(often)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(~often), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def match_spans(text: Column, pattern: str, keep=None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, found>>, places in code points.

    ``keep`` takes a match and says whether it stays. Matches and the gaps between them come from the same
    pattern, so running sums of their lengths are the places. Texts without a match are only searched once.
    """
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, found: F.struct(F.length(gap).alias("gap"), found.alias("found")),
    )

    def step(acc: Column, piece: Column) -> Column:
        found = piece["found"]
        start = (acc["at"] + piece["gap"]).cast("int")
        end = (start + F.length(found)).cast("int")
        one = F.array(F.struct(start.alias("start"), end.alias("end"), found.alias("found")))
        stays = found.isNotNull() if keep is None else F.coalesce(keep(found), F.lit(False))
        return F.struct(
            F.coalesce(end, acc["at"]).alias("at"), F.when(stays, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out")
        )

    folded = F.aggregate(
        pieces, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"]
    )
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def tagged(spans: Column, order: int, kind: str) -> Column:
    """Spans with their kind and its rank, ready to be sorted by start and then kind as listed."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"),
            F.lit(kind).alias("kind"), s["found"].alias("found"),
        ),
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python tasks in batches of at most this many rows, so that long texts don't add up in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def drawn(hashed: Column, n: int, wanted: int) -> Column:
    """Whether a 64-bit hash is among the least share of all hashes that holds 4 * wanted of n rows on average.

    A sample of the ``wanted`` least hashes then needs a few rows of every task at any size of the input, not
    ``wanted`` of each.
    """
    share = 4 * wanted / max(n, 1)
    return F.lit(True) if share >= 1 else hashed < F.lit(int(-(2**63) + share * 2**64))

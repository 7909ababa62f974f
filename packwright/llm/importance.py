"""Importance resampling towards a target distribution of word n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm import packed
from packwright.llm.common import small_batches, written

#: Texts are worked through in pieces of about this many bytes; dictionaries and tuples are a piece's own.
PIECE = 1 << 22
#: Bytes between words: every ASCII character but letters and digits.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _bucket(grams: pa.Array, buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, grams.to_pylist()), np.uint32, len(grams)).astype(np.int64) % buckets


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, place of every code among them)."""
    found = pa.array(codes).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, skip: int = 0):
    """(row, bucket) of every run of 1 to 3 words of these rows, and (row) of every word.

    Distinct words get integers, runs are tuples of them, and each distinct tuple's bytes are put together and hashed
    once. The first ``skip`` words belong to the piece before: runs that end in them are not counted again.
    """
    s, e, row = packed.words(raw, starts, ends, SEPARATOR)
    if len(s) <= skip:
        none = np.zeros(0, np.int64)
        return none, none, none
    lo, hi = int(s[0]), int(e[-1])
    inside = ~SEPARATOR[raw[lo:hi]]
    data = packed.LOWER[raw[lo:hi][inside]]
    offsets = np.zeros(len(s) + 1, np.int64)
    np.cumsum(e - s, out=offsets[1:])
    plain = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    known = plain.dictionary_encode()
    words, ids = known.dictionary, known.indices.to_numpy().astype(np.int64)
    n, space = len(words), pa.scalar(b" ", pa.large_binary())

    rows, found = [row[skip:]], [_bucket(words, buckets)[ids[skip:]]]
    at = 1 + np.flatnonzero(row[1:] == row[:-1])  # runs are known by their last word
    pairs, pair = _distinct(ids[at - 1] * n + ids[at])
    spelled = pc.binary_join_element_wise(words.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), space)
    counted = at >= skip
    rows.append(row[at[counted]])
    found.append(_bucket(spelled, buckets)[pair[counted]])

    pair_at = np.full(len(s), -1, np.int64)
    pair_at[at] = pair
    at = 2 + np.flatnonzero(row[2:] == row[:-2])
    at = at[at >= skip]
    triples, triple = _distinct(pair_at[at - 1] * n + ids[at])
    spelled = pc.binary_join_element_wise(spelled.take(pa.array(triples // n)), words.take(pa.array(triples % n)), space)
    rows.append(row[at])
    found.append(_bucket(spelled, buckets)[triple])
    return np.concatenate(rows), np.concatenate(found), row[skip:]


def _cuts(raw: np.ndarray, start: int, end: int) -> Iterator[tuple[np.ndarray, int]]:
    """Pieces of one long text, cut between words, each led by the last two words before it, and how many those are."""
    led, held = np.zeros(0, np.uint8), 0
    while start < end:
        to = min(end, start + PIECE)
        while to < end and not SEPARATOR[raw[to]]:  # inside a word: go on to its end
            gap = np.flatnonzero(SEPARATOR[raw[to : to + PIECE]])
            to = to + int(gap[0]) if len(gap) else min(end, to + PIECE)
        piece = np.concatenate([led, raw[start:to]])
        yield piece, held
        s, e, _ = packed.words(piece, np.array([0]), np.array([len(piece)]), SEPARATOR)
        last = [np.append(piece[int(i) : int(j)], np.uint8(32)) for i, j in zip(s[-2:], e[-2:], strict=True)]
        led, held = (np.concatenate(last) if last else piece[:0]), len(last)
        start = to


def _packed_counts(row: np.ndarray, bucket: np.ndarray, rows: int, buckets: int) -> Iterator[tuple[bytes, bytes]]:
    """For every row its sorted buckets as differences (two bytes each) and their counts (four bytes each)."""
    keys, counts = np.unique(row * buckets + bucket, return_counts=True)
    owner, values = keys // buckets, keys % buckets
    steps = np.diff(values, prepend=0)
    first = np.searchsorted(owner, np.arange(rows + 1))
    heads = first[:-1][first[:-1] < first[1:]]
    steps[heads] = values[heads]
    steps, counts = steps.astype("<u2"), counts.astype("<u4")
    for k in range(rows):
        yield steps[first[k] : first[k + 1]].tobytes(), counts[first[k] : first[k + 1]].tobytes()


def _counted(buckets: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = packed.column(batch, "_pw_text")
            n_words, n_features, steps, counts = [], [], [], []
            for a, b in packed.parts(starts, ends, PIECE):
                if b == a + 1 and ends[a] - starts[a] > PIECE:
                    total, words = np.zeros(buckets, np.int64), 0
                    for piece, skip in _cuts(raw, int(starts[a]), int(ends[a])):
                        _, bucket, word = _features(piece, np.array([0]), np.array([len(piece)]), buckets, skip)
                        total += np.bincount(bucket, minlength=buckets)
                        words += len(word)
                    held = np.flatnonzero(total)
                    n_words.append(words)
                    n_features.append(int(total.sum()))
                    steps.append(np.diff(held, prepend=0).astype("<u2").tobytes())
                    counts.append(total[held].astype("<u4").tobytes())
                    continue
                row, bucket, word = _features(raw, starts[a:b], ends[a:b], buckets)
                n_words.extend(np.bincount(word, minlength=b - a).tolist())
                n_features.extend(np.bincount(row, minlength=b - a).tolist())
                for x, y in _packed_counts(row, bucket, b - a, buckets):
                    steps.append(x)
                    counts.append(y)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "n_features", "_pw_steps", "_pw_counts"])

    return run


def hashed_features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """Every document's words, features (runs of 1 to 3 words) and how many of them fall in each bucket.

    Columns: _pw_id, _pw_key (the text's hash), n_words, n_features, _pw_steps, _pw_counts. Null and empty texts have
    none; very long texts are worked through in pieces and counted whole.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_pw_id"), F.xxhash64(text_col).alias("_pw_key"), F.col(text_col).cast("string").alias("_pw_text"))
    kept = ["_pw_id", "_pw_key"]
    schema = f"_pw_id {rows.schema['_pw_id'].dataType.simpleString()}, _pw_key long, n_words long, n_features long, _pw_steps binary, _pw_counts binary"
    return rows.mapInArrow(_counted(buckets, kept), schema)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, count) of all rows of a batch, and where each row's begin."""
    raw, starts, ends = packed.column(batch, "_pw_steps")
    data, lo, hi = packed.column(batch, "_pw_counts")
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    steps = raw[int(starts[0]) : int(ends[-1])].view("<u2").astype(np.int64)
    counts = data[int(lo[0]) : int(hi[-1])].view("<u4").astype(np.int64)
    first = (starts - starts[0]) // 2
    sums = np.concatenate([[0], np.cumsum(steps)])
    sizes = (ends - starts) // 2
    return sums[1:] - np.repeat(sums[first], sizes), counts, np.append(first, len(steps))


def _totals(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, counts, _ = _unpacked(batch)
            np.add.at(total, bucket, counts)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_totals(features: DataFrame, buckets: int = 10_000) -> list[int]:
    """Features in each bucket: every task sends its sums, one row a bucket, so the driver gets ``buckets`` rows."""
    each = features.select("_pw_steps", "_pw_counts").mapInArrow(_totals(buckets), "bucket long, n long")
    out = [0] * buckets
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one."""
    n, all_s, all_t = len(corpus), sum(corpus), sum(target)
    return [
        math.floor(1000 * math.log(float(t + 1) * float(all_s + n) / (float(s + 1) * float(all_t + n))))
        for s, t in zip(corpus, target, strict=True)
    ]


def _weights(gains: list[int], kept: list[str]):
    worth = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, counts, first = _unpacked(batch)
            sums = np.concatenate([[0], np.cumsum(worth[bucket] * counts)])
            weight = sums[first[1:]] - sums[first[:-1]] if len(batch) else sums[:0]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weight, pa.int64())], [*kept, "weight"])

    return run


def _noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the id alone; null ids share the noise of the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    buckets: int = 10_000, min_words: int = 20, percent: int = 5, seed: int = 42,
) -> DataFrame:
    """One row a document: id, _pw_key, n_words, n_features, weight, score and rank (null if it is not drawn).

    Weights sum the gains of a document's hashed n-grams; Gumbel noise on top makes the highest scores a draw without
    replacement in proportion to the weights' exponentials. ``percent`` of the documents with at least ``min_words``
    words are drawn, ties to the smaller id.

    Texts are read once; what is kept of them are bucket counts in the shared folder. Word ids, tuples and hashes live in
    pieces of a few megabytes, so no dictionary grows with the corpus and no word is shuffled. Ranks come from one
    shuffle by ranges of scores, so no task sorts all documents.

    Null and empty texts have no features and weight 0 and are never drawn; very long texts count whole; repeated rows
    each count and may each be drawn; rows that tie in score and id are ordered as they lie; null ids come first among
    ties; an empty corpus gives no rows; an empty target leaves the gains of rare buckets above those of frequent ones;
    other columns are not read, whatever their names.
    """
    features = written(
        hashed_features(docs, id_col=id_col, text_col=text_col, buckets=buckets).withColumn("_pw_row", F.monotonically_increasing_id()),
        compression="zstd",
    )
    wanted = hashed_features(target.select(F.lit(0).alias("_pw_id"), F.col(target_col)), id_col="_pw_id", text_col=target_col, buckets=buckets)
    gains = bucket_gains(bucket_totals(features, buckets), bucket_totals(wanted, buckets))
    kept = ["_pw_id", "_pw_key", "_pw_row", "n_words", "n_features"]
    schema = ", ".join(f"{c} {features.schema[c].dataType.simpleString()}" for c in kept) + ", weight long"
    weighed = features.mapInArrow(_weights(gains, kept), schema)
    scored = written(
        weighed.withColumn("score", F.col("weight") + _noise(F.col("_pw_id"), seed)).withColumn("_pw_may", F.col("n_words") >= min_words)
    )
    order = [F.desc("_pw_may"), F.desc("score"), F.asc("_pw_id"), F.asc("_pw_row")]
    laid = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = written(laid.withColumn("_pw_place", F.monotonically_increasing_id()))  # partition and place within it
    parts = laid.groupBy(F.shiftright("_pw_place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_pw_may").alias("may"))
    before, offsets, may = 0, [], 0
    for row in sorted(parts.collect()):  # one row a partition
        offsets.append((row["part"], before))
        before += row["n"]
        may += row["may"]
    starts = docs.sparkSession.createDataFrame(offsets, "_pw_part long, _pw_before long")
    place = F.col("_pw_before") + F.col("_pw_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = laid.withColumn("_pw_part", F.shiftright("_pw_place", 33)).join(F.broadcast(starts), "_pw_part").withColumn("_pw_rank", place)
    drawn = F.when(F.col("_pw_rank") <= may * percent // 100, F.col("_pw_rank"))
    return ranked.select(F.col("_pw_id").alias(id_col), "_pw_key", "n_words", "n_features", "weight", "score", drawn.alias("rank"))


def resampled_documents(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn documents themselves with _pw_rank, one row a rank; ``found`` is what importance_resample returned.

    Rows are known by id and text, so of rows that share both the columns of one stand for all of them; null ids match
    null ids; null and empty texts, having no words, are not among them; nothing drawn gives no rows; columns of any
    name travel along.
    """
    ranks = found.where("rank is not null").select(F.col(id_col).alias("_pw_id"), F.col("_pw_key").alias("_pw_found"), F.col("rank").alias("_pw_rank"))
    rows = docs.withColumn("_pw_key", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_pw_id")) & (F.col("_pw_key") == F.col("_pw_found"))
    named = ranks.select("_pw_id", "_pw_found").distinct()
    one = rows.join(named, same, "left_semi").dropDuplicates([id_col, "_pw_key"])
    return one.join(ranks, same).drop("_pw_id", "_pw_found", "_pw_key")

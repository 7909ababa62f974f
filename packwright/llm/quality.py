"""Quality classifier: naive Bayes support vectors.

Documents become indicators of n-grams: byte trigrams, and runs of one to three word shapes (does the word repeat
the one before, how it starts and ends, its case, digits and signs, its length). Each indicator is scaled by the
log-ratio of its counts in the two classes; a linear hinge-loss model is fit on the scaled, normalised rows by
dual coordinate descent; margins of rows kept back from the fit calibrate the score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm import packed
from packwright.llm.common import drawn, held_out, released, small_batches, written

BITS = 18
_U = np.uint64
_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True


def _shapes(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word's shape; the first word of a text counts as no repeat."""
    lo, hi = int(s[0]), int(e[-1])
    own = raw[lo:hi]

    def counts(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(own) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[e - lo] - total[s - lo]

    size = e - s
    upper, digit, sign = counts((own >= 65) & (own <= 90)), counts((own >= 48) & (own <= 57)), counts(_SIGN[own])
    h = packed.word_hashes(raw, s, e)
    again = np.zeros(len(s), bool)
    again[1:] = h[1:] == h[:-1]
    last = raw[e - 1].astype(np.int64)
    code = again.astype(np.int64)
    code = code * 3 + np.where(upper == 0, 0, np.where(upper * 2 >= size, 2, 1))
    code = code * 2 + (digit > 0)
    code = code * 4 + np.minimum(sign, 3)
    code = code * 128 + np.where(_SIGN[raw[e - 1]], last, 0)
    code = code * 5 + np.searchsorted([2, 4, 9, 17], size)
    return packed.mixed(code.astype(_U) + _U(1))


def features(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """For every row the distinct n-grams it has, as numbers below 2**BITS."""
    shift = _U(64 - BITS)
    lo, hi = int(starts[0]), int(ends[-1])
    b = raw[lo:hi].astype(_U)
    tri = np.zeros(0, np.int64)
    if len(b) > 2:
        tri = (packed.mixed((b[:-2] << _U(16)) | (b[1:-1] << _U(8)) | b[2:]) >> shift).astype(np.int64)
    s, e, row = packed.words(raw, starts, ends)
    runs = []
    if len(s):
        shape = _shapes(raw, s, e)
        runs = [(packed.chained(shape, k, salt=k) >> shift).astype(np.int64) for k in (1, 2, 3)]
    first = np.searchsorted(row, np.arange(len(starts) + 1))
    slot = np.zeros(1 << BITS, np.int64)
    for k in range(len(starts)):
        x, y = int(starts[k]) - lo, int(ends[k]) - lo
        a, c = int(first[k]), int(first[k + 1])
        ids = [tri[x : max(x, y - 2)], *[r[a : max(a, c - n)] for n, r in enumerate(runs)]]
        ids = np.concatenate(ids)
        nth = np.arange(len(ids))
        slot[ids] = nth
        yield ids[slot[ids] == nth]


class QualityModel:
    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.ratio, self.bias, self.slope, self.offset = ratio, bias, slope, offset
        self.value = (ratio * weights).astype(np.float32)
        self.square = (ratio * ratio).astype(np.float32)

    def margin(self, ids: np.ndarray) -> float:
        norm = float(self.square[ids].sum(dtype=np.float64))
        return self.bias + (float(self.value[ids].sum(dtype=np.float64)) / norm**0.5 if norm else 0.0)

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(ids) + self.offset, -40, 40))))


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, *, smooth: float = 1.0, cost: float = 1.0, rounds: int = 12, seed: int = 3) -> QualityModel:
    """Log-count ratios and dual coordinate descent on four fifths of the rows, calibration on the rest."""
    r = np.random.default_rng(seed)
    order = r.permutation(len(rows))
    back = set(order[: len(rows) // 5].tolist()) if len(rows) >= 20 else set()
    train = [i for i in order if i not in back]
    up, down = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for i in train:
        (up if labels[i] else down)[rows[i]] += 1
    ratio = np.log((up / up.sum()) / (down / down.sum()))
    ratio[(up == smooth) & (down == smooth)] = 0
    w, bias = np.zeros(1 << BITS), 0.0
    values = {}
    for i in train:
        v = ratio[rows[i]]
        norm = np.sqrt((v * v).sum())
        values[i] = v / norm if norm else v
    alpha = dict.fromkeys(train, 0.0)
    for _ in range(rounds):
        for i in r.permutation(train):
            y = 1.0 if labels[i] else -1.0
            v = values[i]
            slack = y * (w[rows[i]] @ v + bias) - 1
            new = min(max(alpha[i] - slack / (v @ v + 1), 0.0), cost)
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * y * v
                bias += (new - alpha[i]) * y
                alpha[i] = new
    model = QualityModel(ratio, w, bias, 1.0, 0.0)
    judged = sorted(back) or train
    m, t = np.array([model.margin(rows[i]) for i in judged]), np.array([float(labels[i]) for i in judged])
    n1, n0 = t.sum(), len(t) - t.sum()
    goal = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps on the logistic loss of a * margin + b
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        g, h = p - goal, p * (1 - p) + 1e-9
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * m).sum(), g.sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return QualityModel(ratio, w, bias, float(a), float(b))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, starts, ends = packed.column(batch, "t")
        ids = [f.astype(np.int32) for a, b in packed.parts(starts, ends) for f in features(raw, starts[a:b], ends[a:b])]
        columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["y", "h", "n", "f"])


def _fitted(seed: int):
    """Fits the sample's rows in the task that gets them all, so that the driver receives the model only, a few numbers a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((y, f) for b in batches for y, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        y = np.array([g[0] for g in got], np.int64)
        if len(set(y.tolist())) < 2:
            return
        rows = [np.frombuffer(g[1], np.int32) for g in got]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_rows(rows, y, seed=seed))], pa.binary())], ["model"])

    return run


def teaching_texts(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 3000, seed: int = 3
) -> DataFrame:
    """(y, h, t): one whole text of each of at most sample_docs labelled ids of each class, and the hash that drew its id.

    Of an id's texts the one with the least hash teaches; ids that have both labels don't.
    """
    known = labels.where(~held_out(F.col(id_col), 4, 2)).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashed = F.xxhash64("i", F.lit(seed))
    taken = [known.where((F.col("y") == y) & drawn(hashed, sizes.get(y, 0), sample_docs)).orderBy(hashed, "i").limit(sample_docs) for y in (0, 1)]
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = texts.join(F.broadcast(taken[0].unionByName(taken[1])), "i")  # at most 2 * sample_docs ids
    rows = rows.groupBy("i", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    return rows.select("y", hashed.alias("h"), "t")


def fit_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 3000, sample_grams: int = 4_000_000, seed: int = 3
) -> QualityModel | None:
    """A model of label 1 fit on one whole text each of at most sample_docs labelled ids of each class, drawn by a hash of the id.

    The fit's memory has a bound: a class's rows are taken in the order of that hash until they hold sample_grams distinct
    n-grams together, so very long texts make fewer rows teach, but none teaches in part.

    Ids whose crc32 leaves 2 modulo 4 never teach; null texts, null ids, ids with both labels and labels other than 0
    and 1 don't either; empty texts teach the bias; very long ones teach whole; repeated rows count once; other columns are not read. None if a class has no rows, so for empty tables.
    """
    rows = teaching_texts(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample_docs=sample_docs, seed=seed)
    small_batches(docs.sparkSession)
    grams = written(rows.withColumn("y", F.col("y").cast("int")).mapInArrow(_gathered, "y int, h long, n long, f binary"))  # at most 2 * sample_docs rows
    before = F.sum("n").over(Window.partitionBy("y").orderBy("h", "f").rowsBetween(Window.unboundedPreceding, -1))
    taken = grams.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_grams).select("y", "f")
    fitted = taken.repartition(1).mapInArrow(_fitted(seed), "model binary").first()  # the sample has a bound
    released(docs.sparkSession)
    return pickle.loads(fitted["model"]) if fitted else None


def _scored(model: QualityModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = packed.column(batch, "_pw_text")
            scores = np.full(batch.num_rows, 0.5)
            for a, b in packed.parts(starts, ends) if model else ():
                for k, ids in enumerate(features(raw, starts[a:b], ends[a:b]), a):
                    scores[k] = model.score(ids)
            kept = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], [*batch.schema.names, "_pw_score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel | None, *, text_col: str = "text", column: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and a score from 0 to 1 of every whole text, higher where label 1 is likelier.

    Null and empty texts have no n-grams and get the score of the bias; without a model every score is 0.5; very long
    texts are scored whole; repeated rows and ties get the same score; an empty table gives no rows. A column of docs
    that has the score's name gives way to it.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c != column]
    rows = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(text_col).cast("string").alias("_pw_text"))
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_scored(model), f"{fields}, _pw_score double").drop("_pw_text").withColumnRenamed("_pw_score", column)

"""Language ID by a small byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, their maxima over a window feed a softmax.
A filter over one-hot bytes is a table lookup per place, and two neighbouring places are looked up at once.
Every window of a text is scored, and the windows' probabilities are averaged by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm import packed
from packwright.llm.common import held_out, small_batches, small_enough, written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class ByteNet:
    """Tables (width, place) -> 256 x FILTERS, a bias per filter, and a softmax over the pooled maxima."""

    def __init__(self, languages: list[str], seed: int = 11):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: (r.normal(0, 0.3, (w, 256, FILTERS))).astype(np.float32) for w in WIDTHS}
        for t in self.tables.values():
            t[:, 0] = 0  # padding
        self.dense = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, *, steps: int = 240, batch: int = 96, rate: float = 0.03, seed: int = 5) -> ByteNet:
        """Adam on cross-entropy; only the places of the maxima pass gradients on."""
        r = np.random.default_rng(seed)
        params = [*self.tables.values(), self.dense, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        for step in range(1, steps + 1):
            pick = r.integers(0, len(x), batch)
            xb = x[pick].copy()
            short = r.random(batch) < 0.3  # short texts are met as well
            for i in np.flatnonzero(short):
                xb[i, r.integers(12, WINDOW) :] = 0
            pooled, at = [], []
            for w in WIDTHS:
                z = sum(self.tables[w][j][xb[:, j : WINDOW - w + 1 + j]] for j in range(w))
                k = z.argmax(axis=1)
                at.append(k)
                pooled.append(np.take_along_axis(z, k[:, None], 1)[:, 0])
            h = np.concatenate(pooled, 1)
            p = self._softmax(h @ self.dense + self.bias)
            p[np.arange(batch), y[pick]] -= 1
            p /= batch
            dh = p @ self.dense.T
            grads = []
            for n, w in enumerate(WIDTHS):
                g = np.zeros_like(self.tables[w])
                d = dh[:, n * FILTERS : (n + 1) * FILTERS]
                for j in range(w):
                    seen = np.take_along_axis(xb, at[n] + j, 1)
                    np.add.at(g[j], (seen, np.arange(FILTERS)[None, :]), d)
                g[:, 0] = 0
                grads.append(g)
            grads += [h.T @ p + 1e-4 * self.dense, p.sum(0)]
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _pairs(self) -> list[np.ndarray]:
        """For each width tables over byte pairs (65536 x FILTERS), the last of an odd width over its second byte alone."""
        out = []
        for w in WIDTHS:
            t = self.tables[w]
            for j in range(0, w - 1, 2):
                out.append((t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax of windows (n x WINDOW bytes)."""
        if not hasattr(self, "_made"):
            self._made = self._pairs()
        pair = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        pooled, at = [], 0
        for w in WIDTHS:
            n = WINDOW - w + 1
            z = self._made[at].take(pair[:, :n], axis=0)
            at += 1
            if w == 3:
                z += self.tables[w][2].take(x[:, 2:], axis=0)
            elif w == 4:
                z += self._made[at].take(pair[:, 2:], axis=0)
                at += 1
            pooled.append(z.max(axis=1))
        return self._softmax(np.concatenate(pooled, 1) @ self.dense + self.bias)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}


def windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zeros, row of each, bytes of each) of whole texts; empty texts have none."""
    size = ends - starts
    per = -(-size // WINDOW)
    row = np.repeat(np.arange(len(starts)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    first = starts[row] + nth * WINDOW
    n = np.minimum(ends[row] - first, WINDOW)
    places = first[:, None] + np.arange(WINDOW)
    x = raw[np.minimum(places, len(raw) - 1)] if len(row) else np.zeros((0, WINDOW), np.uint8)
    if len(row):
        x[np.arange(WINDOW)[None, :] >= n[:, None]] = 0
    return x, row, n


def _has_letter(raw: np.ndarray, a: int, b: int) -> bool:
    own = raw[a:b]
    if _LETTER[own].any():
        return True
    return bool((own > 127).any()) and any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))


def _predicted(net: ByteNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = packed.column(batch, "_pw_text")
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for a, b in packed.parts(starts, ends, 1 << 19) if net else ():
                s, e = starts[a:b], ends[a:b]
                total = np.zeros((b - a, len(net.languages)))
                for lo, hi, lo_s, hi_s in _cut(s, e):
                    x, row, n = windows(raw, lo_s, hi_s)
                    np.add.at(total, row + lo, net.probabilities(x) * n[:, None])
                total /= np.maximum(e - s, 1)[:, None]
                for k in range(a, b):
                    if _has_letter(raw, int(starts[k]), int(ends[k])):
                        best = int(total[k - a].argmax())
                        names[k], scores[k] = net.languages[best], min(1.0, float(total[k - a][best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], ["_pw_id", "lang_pred", "score"])

    return run


def _cut(s: np.ndarray, e: np.ndarray, limit: int = 1 << 20):
    """Rows as they are, or a single longer row in whole windows of about this many bytes."""
    if len(s) > 1 or not len(s) or e[0] - s[0] <= limit:
        yield 0, len(s), s, e
        return
    for at in range(int(s[0]), int(e[0]), limit):
        yield 0, 1, np.array([at]), np.array([min(at + limit, int(e[0]))])


def teaching_sample(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 300, sample_windows: int = 4, seed: int = 11
) -> DataFrame:
    """(l, k, t): windows t, spread over the text, of the sample_docs distinct texts k of each language l with the least hashes.

    Texts are counted and drawn as distinct (language, hash), so copies count once. Only hashes below a share of
    all are ranked; a language that has too few of them is ranked whole.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null and t <> ''")
    rows = rows.withColumn("h", F.xxhash64("t", F.lit(seed)))
    known = written(rows.select("l", "h").distinct())
    sizes = known.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    sizes = F.broadcast(sizes) if small_enough(sizes, 100_000) else sizes
    limit = (F.lit(-(2.0**63)) + 4.0 * sample_docs / F.col("n") * F.lit(2.0**64)).cast("long")
    near = written(known.join(sizes, "l").where(F.when(F.col("n") <= 4 * sample_docs, True).otherwise(F.col("h") < limit)).select("l", "h", "n"))
    few = near.groupBy("l").agg(F.count(F.lit(1)).alias("m"))
    short = sizes.join(few, "l", "left").where(F.coalesce("m", F.lit(0)) < F.least("n", F.lit(sample_docs))).select("l")
    if not short.isEmpty():
        near = near.select("l", "h").join(short, "l", "left_anti").unionByName(known.join(short, "l", "left_semi"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    chosen = written(near.select("l", "h", place.alias("k")).where(F.col("k") <= sample_docs))
    chosen = F.broadcast(chosen) if small_enough(chosen, 1_000_000) else chosen
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(sample_windows - 1)),
        lambda k: F.substring("t", F.floor(k * F.greatest(F.length("t") - WINDOW, F.lit(0)) / max(1, sample_windows - 1)).cast("int") + 1, F.lit(WINDOW)),
    )
    parts = rows.join(chosen, ["l", "h"]).select("l", "k", F.array_distinct(spread).alias("parts"))
    return parts.groupBy("l", "k").agg(F.min("parts").alias("parts")).select("l", "k", F.explode("parts").alias("t"))


def fit_language_net(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 300, sample_windows: int = 4, seed: int = 11
) -> ByteNet | None:
    """A net fit on at most sample_docs distinct texts of each language and sample_windows windows of each.

    Rows without text or language don't teach; every other language is learned. The sample is drawn by a hash of
    the text, and only its windows come to the driver. None if nothing can teach.
    """
    sample = teaching_sample(docs, text_col=text_col, lang_col=lang_col, sample_docs=sample_docs, sample_windows=sample_windows, seed=seed)
    got = sample.orderBy("l", "k", "t").collect()
    if not got:
        return None
    languages = sorted({r["l"] for r in got})
    number = {name: i for i, name in enumerate(languages)}
    x = np.zeros((len(got), WINDOW), np.uint8)
    for i, r in enumerate(got):
        b = np.frombuffer(r["t"].encode()[:WINDOW], np.uint8)
        x[i, : len(b)] = b
    y = np.array([number[r["l"]] for r in got])
    order = np.random.default_rng(seed).permutation(len(x))
    return ByteNet(languages, seed).fit(x[order], y[order], steps=max(240, -(-len(x) // 96)))


def identify_languages(docs: DataFrame, net: ByteNet | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, lang_pred, score (the mean probability of lang_pred over all windows).

    Null and empty texts and texts without a letter are ``und`` with score 0, as is everything if net is None; very long
    texts are read whole, some windows at a time; of languages that tie the first by name is taken; repeated rows get
    the same result; an empty table gives no rows; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_pw_id"), F.col(text_col).cast("string").alias("_pw_text"))
    kind = rows.schema["_pw_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    return rows.mapInArrow(_predicted(net), f"_pw_id {kind}, lang_pred string, score double").withColumnRenamed("_pw_id", id_col)


def teaching_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose crc32 of the id doesn't leave 1 modulo 3."""
    return docs.where(~held_out(F.col(id_col), 3, 1))

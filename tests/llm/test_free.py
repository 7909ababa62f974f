"""The other operators: n-gram join, top-k, classifiers, token counts, components."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest import ROWS
from pyspark.sql import functions as F

from packwright.llm import packed
from packwright.llm.components import components
from packwright.llm.langid import fit_language_net, identify_languages, teaching_sample
from packwright.llm.ngram_join import jaccard_components
from packwright.llm.quality import fit_quality, score_quality, teaching_texts
from packwright.llm.token_counts import length_histogram, quantile, suffix_sums, total_cut_at
from packwright.llm.topk import top_inner_products

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_word_hashes_know_words():
    texts = ["Ab c", "", "ab  C\tab", "x" * 3_000_000 + " ab"]
    raw, s, e = packed.column(pa.record_batch([pa.array([None, *texts])], ["t"]), "t")
    ws, we, row = packed.words(raw, s, e)
    h = packed.word_hashes(raw, ws, we)
    assert row.tolist() == [1, 1, 3, 3, 3, 4, 4]
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 3




def test_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_join_on_awkward_rows(docs, no_docs):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"]) for r in jaccard_components(docs).collect()))
    assert got == sorted((d is None, d or 0, len(brute.shingles(t))) for d, t, *_ in ROWS)
    assert jaccard_components(no_docs).count() == 0


def test_ngram_join_agrees_with_all_pairs(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randrange(3, 90))] for _ in range(12)]
    rows, shared = [], [f"p{i}" for i in range(30)]
    for i in range(260):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randrange(10_000)}"
        if r.random() < 0.3:
            w += shared
        rows.append((i, " ".join(w)))
    rows += [(300 + i, r.choice(rows)[1].upper()) for i in range(30)]
    want = brute.components(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(df)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want


def test_ngram_join_of_frequent_keys(spark, monkeypatch):
    """Frequent shingles and classes go another way; groups are split; nothing changes."""
    from packwright.llm import common, ngram_join

    r = random.Random(5)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(base[:20] + [f"x{r.randrange(3)}"] + base[21:])) for i in range(40)]
    rows += [(100 + i, " ".join(r.sample(base, 25))) for i in range(60)] + [(200 + i, "one two three four five") for i in range(50)]
    rows += [(300 + i, " ".join(base[:24] + [f"y{r.randrange(40)}" for _ in range(9)])) for i in range(60)]
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), brute.components(rows)
    plain = common.joined_by_key
    hot = []

    def eager(left, table, key, count, how="inner"):
        scaled = table.withColumn(count, F.when(F.col(count) > 5, F.col(count) * 1000).otherwise(F.col(count)))
        hot.append(not scaled.where(F.col(count) > 1000).isEmpty())
        back = F.when(F.col(count) > 1000, (F.col(count) / 1000).cast("long")).otherwise(F.col(count))
        return plain(left, scaled, key, count, how).withColumn(count, back)

    monkeypatch.setattr(ngram_join, "joined_by_key", eager)
    monkeypatch.setattr(ngram_join, "_GROUP", 3)
    got = jaccard_components(df).collect()
    assert any(hot) and {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want


def best_products(rows, k=5, every=50):
    """[(query_id, rank, vec_id, score)] over plain rows (id, vector), in exact integers."""
    import math

    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(own):
        if q % every == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(own) if m != n and len(w) == len(v)]
            out += [(q, r + 1, i, max(-(2**63) + 1, min(2**63 - 1, -s))) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("clustered", [False, True])
def test_top_products(spark, clustered):
    r = np.random.default_rng(2)
    v = r.normal(0, 0.3, (700, 8)).round(2)
    if clustered:
        v += 5 * r.normal(0, 1, (10, 8)).round(1)[np.arange(700) % 10]
    v[10] = v[20]
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    rows += [(1000, None), (1050, [None, *[0.1] * 7]), (1100, [float("nan")] * 8), (1150, [0.5] * 3), (None, [0.1] * 8), (1200, []), (1250, [])]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (0, rows[0][1]), (7, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit("x"), "cell": F.lit(2), "row": F.lit(3)})
    for options in ({"shard_rows": 100, "block_rows": 4}, {"shard_rows": 40, "most_cells": 4}, {}):
        got = sorted(map(tuple, top_inner_products(df, **options).collect()))
        assert got == best_products(rows)
    assert top_inner_products(df.limit(0)).count() == 0


def test_top_products_of_large_components(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.integers(2**20, 2**21, 6)]) for i in range(120)]  # products pass 2**53, not 2**63
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_inner_products(df, shard_rows=30).collect())) == best_products(rows)
    rows = [(i, [1e300 * (i % 3 - 1), 1.7e308, 0.5]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_inner_products(df, shard_rows=16).collect()
    assert len(got) == 10 and all(x["score"] == 2**63 - 1 for x in got)


def test_languages(spark, docs, no_docs):
    rows = [(i, t * 5, lang) for i in range(40) for t, lang in ((f"the cat {i} and the thing ", "en"), (f"der große {i} hund und über ", "de"))]
    net = fit_language_net(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    again = fit_language_net(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "and the other thing and the cat"), (2, "und der große hund"), (3, None), (4, "12 34 !"), (5, "the cat and " * 90_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(asked, net).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "de", "und", "und", "en"] and got[3][1] == 0
    assert got == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(asked, again).collect()}
    assert identify_languages(docs, fit_language_net(docs)).count() == len(ROWS)
    assert fit_language_net(no_docs) is None and identify_languages(docs, None).where("lang_pred <> 'und'").count() == 0


def test_languages_of_copies_are_learned(spark):
    rows = [(f"the cat {i} and the thing " * 3, "en") for i in range(40)]
    for k, w in enumerate(("zug", "quel", "vox", "jird", "pyx", "wren")):  # six languages of one text each, 400 copies
        rows += [(f"{w} " * 30, f"x{k}")] * 400
    df = spark.createDataFrame(rows, "text string, lang string")
    net = fit_language_net(df, sample_docs=5)
    got = identify_languages(df.distinct(), net, id_col="lang").where("lang <> 'en'").collect()
    assert {r["lang"]: r["lang_pred"] for r in got} == {f"x{k}": f"x{k}" for k in range(6)}
    sample = teaching_sample(df, sample_docs=5).groupBy("l").agg(F.countDistinct("k").alias("n")).collect()
    assert {r["l"]: r["n"] for r in sample} == {"en": 5, **{f"x{k}": 1 for k in range(6)}}
    many = spark.createDataFrame([(f"text {i}", f"l{i:03d}") for i in range(300)], "text string, lang string")
    assert len(fit_language_net(many).languages) == 300


def test_quality(spark, docs, no_docs):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghil") for _ in range(r.randrange(2, 8)))
    rows, labels = [], []
    for i in range(160):
        good = i % 2
        rows.append((i, " ".join(word() for _ in range(40)) + "." if good else f"{word()} ** " * 30))
        labels.append((i, good))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    scored = score_quality(df, fit_quality(df, known)).join(known, "doc_id")
    assert scored.where("(score >= 0.7) <> (quality = 1)").count() == 0
    assert score_quality(docs, fit_quality(df, known), keep=["doc_id"]).where("score between 0 and 1").count() == len(ROWS)
    assert fit_quality(no_docs, known) is None and score_quality(docs, None, keep=["doc_id"]).where("score = 0.5").count() == len(ROWS)


def test_quality_of_ids_with_many_rows(spark):
    rows = [(i, f"{w} ** {i} {k} " * 9) for i in range(12) for k, w in enumerate("abcdefghij")] + [(i, f"good words stand here {i}. " * 3) for i in range(12, 24)]
    labels = spark.createDataFrame([(i, int(i >= 12)) for i in range(24)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = teaching_texts(df, labels, sample_docs=3).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["y"]: r["n"] for r in counts} == {0: 3, 1: 3}
    model = fit_quality(df, labels, sample_docs=3)
    assert model is not None
    scored = score_quality(df, model, keep=["doc_id"]).groupBy(F.col("doc_id") >= 12).agg(F.avg("score").alias("s")).collect()
    assert len({r["s"] for r in scored}) == 2 and max(scored, key=lambda r: r["s"])[0]


def test_token_counts(spark, docs, no_docs):
    import tiktoken
    from packwright.llm.token_counts import _encoding

    enc = _encoding(open(VOCABULARY, "rb").read())
    assert isinstance(enc, tiktoken.Encoding)
    lengths = sorted(len(enc.encode_ordinary(t or "")) for _, t, *_ in ROWS)
    sums = suffix_sums(length_histogram(docs, VOCABULARY)).cache()
    for r in sums.collect():
        n = r["n_tokens"]
        assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["total_cut"] == sum(min(x, n) for x in lengths) and r["n_docs"] == lengths.count(n)
    for limit in (0, 5, 100, 10**7):
        assert total_cut_at(sums, limit) == sum(min(x, limit) for x in lengths)
    assert quantile(sums, 0.5) == lengths[(len(lengths) + 1) // 2 - 1]
    assert suffix_sums(length_histogram(no_docs, VOCABULARY)).count() == 0
    assert enc.decode(enc.encode_ordinary("Größe été")) == "Größe été"


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([(i, i % 2) for i in range(15)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    kept = P.one_of_each_group(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 5 not in ids and {1, 2, 3} <= set(ids)
    clean = P.without_benchmarks(spark, docs, str(tmp_path))
    assert clean.where("doc_id in (7, 8)").count() == 0 and clean.columns == docs.columns and clean.where("doc_id is null").count() == 1
    hidden = P.without_personal_data(spark, docs, str(tmp_path))
    texts = {r["doc_id"]: r["text"] for r in hidden.collect()}
    assert texts[10] == "mail [EMAIL] or [PHONE], [IP]" and texts[12] == dict((r[0], r[1]) for r in ROWS)[12]
    assert hidden.count() == len(ROWS)
    assert P.mixed(spark, docs, str(tmp_path)).count() == len(ROWS)
    assert P.good_quality(spark, docs.where(F.col("doc_id") < 0), str(tmp_path)).count() == 0


def test_pipeline_decides_by_row(spark, tmp_path):
    import corpus_pipeline as P

    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [
        (None, "first of its own words here"), (None, "second text has other words too"), (None, "third one differs again from them"),
        (7, "seven says this at some length"), (7, "seven also says a wholly other thing"), (3, "copied words stand in two rows"),
        (9, "copied words stand in two rows"), (9, "nine has a clean text as well"), (None, "copied words stand in two rows"),
        (5, "five is a row that comes twice"), (5, "five is a row that comes twice"), (None, None), (None, " \n"), (2, ""), (2, ""),
        (None, "no id says this twice over"), (None, "no id says this twice over"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = P.one_of_each_group(spark, df, str(tmp_path)).collect()
    want = set(rows) - {(9, rows[5][1]), (None, rows[5][1])}
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [*want, (2, "")]))
    rows = [(None, f"x {passage} y"), (None, "clean"), (4, f"{passage} z"), (4, "four is clean")]
    clean = P.without_benchmarks(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, clean))) == sorted(map(repr, [rows[1], rows[3]]))


@pytest.mark.parametrize("seed", [1, 2])
def test_crc_split(spark, seed):
    import zlib

    from packwright.llm.common import held_out

    got = spark.range(50).select("id", held_out(F.col("id"), 3, seed).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == seed) for r in got)


def test_convolution_agrees_with_a_plain_one():
    from packwright.llm.langid import FILTERS, WIDTHS, WINDOW, ByteNet

    r = np.random.default_rng(1)
    net = ByteNet(["a", "b", "c"])
    x = r.integers(0, 256, (3, WINDOW)).astype(np.uint8)
    x[1, 40:] = 0
    for row, got in zip(x, net.probabilities(x), strict=True):
        pooled = []
        for w in WIDTHS:
            for f in range(FILTERS):
                pooled.append(max(sum(float(net.tables[w][j][row[i + j], f]) for j in range(w)) for i in range(WINDOW - w + 1)))
        z = [sum(p * float(net.dense[k, c]) for k, p in enumerate(pooled)) + float(net.bias[c]) for c in range(3)]
        e = np.exp(np.array(z) - max(z))
        assert np.allclose(got, e / e.sum(), atol=1e-4)


def test_gradient_agrees_with_numeric_ones():
    """One step of the fit moves a weight against the sign of the loss's numeric derivative."""
    from packwright.llm.langid import WINDOW, ByteNet

    r = np.random.default_rng(2)
    x = r.integers(97, 123, (64, WINDOW)).astype(np.uint8)
    y = r.integers(0, 2, 64)
    for k in range(6):
        x[y == 1, 10 + k] = 97

    def loss(net):
        net.__dict__.pop("_made", None)
        return -np.log(net.probabilities(x)[np.arange(64), y] + 1e-9).mean()

    before, after = loss(ByteNet(["a", "b"], 3)), loss(ByteNet(["a", "b"], 3).fit(x, y, steps=40))
    assert after < before / 2
    net = ByteNet(["a", "b"], 3)
    moved = ByteNet(["a", "b"], 3).fit(x, y, steps=1, batch=4096)
    for c in range(2):
        up, down = ByteNet(["a", "b"], 3), ByteNet(["a", "b"], 3)
        up.bias[c] += 1e-2
        down.bias[c] -= 1e-2
        slope = loss(up) - loss(down)
        assert abs(slope) < 1e-6 or np.sign(moved.bias[c] - net.bias[c]) == -np.sign(slope)


def test_dual_descent_agrees_with_plain_subgradient():
    """The hinge-loss optimum found by coordinate descent is no worse than long plain subgradient descent's."""
    from packwright.llm.quality import BITS, fit_rows

    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 60, 12)) for _ in range(15)]
    y = np.array([int(3 in x or 7 in x) for x in rows])
    y[:2] = (0, 1)
    model = fit_rows(rows, y, rounds=400)
    used = np.unique(np.concatenate(rows))
    up = np.array([1 + sum(y[i] for i in range(15) if t in rows[i]) for t in range(60)], float)
    down = np.array([1 + sum(1 - y[i] for i in range(15) if t in rows[i]) for t in range(60)], float)
    rest = (1 << BITS) - 60
    ratio = np.log((up / (up.sum() + rest)) / (down / (down.sum() + rest)))
    seen = used[np.abs(ratio[used]) > 1e-12]
    assert np.allclose(model.ratio[seen], ratio[seen])
    x = np.zeros((15, 61))
    for i, ids in enumerate(rows):
        v = ratio[ids]
        x[i, ids] = v / np.linalg.norm(v)
    x[:, 60] = 1
    sign = 2 * y - 1

    def cost(w):
        return 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()

    ours = np.zeros(61)
    ours[seen], ours[60] = model.value[seen] / ratio[seen], model.bias
    w, best = np.zeros(61), np.inf
    for step in range(1, 20_000):
        w -= (w - (sign * (sign * (x @ w) < 1)) @ x) / step
        best = min(best, cost(w))
    assert cost(ours) <= best * 1.01 + 1e-3


def test_quality_columns_and_labels(spark, docs):
    rows = [(i, "good words stand here now. " * 4 if i % 2 else f"x{i} ** " * 20) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    taught = teaching_texts(df, labels).count()
    from packwright.llm.common import held_out

    assert taught == spark.range(60).where(~held_out(F.col("id"), 4, 2) & ~F.col("id").isin(1, 2)).count()
    scored = score_quality(df, fit_quality(df, labels))
    assert scored.columns == ["doc_id", "text", "score"] and dict(scored.dtypes)["score"] == "double"
    long = spark.createDataFrame([(0, "abc " * 50_000)], "doc_id long, text string")
    whole = teaching_texts(long, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).first()["t"]
    assert len(whole) == 200_000, "texts teach whole"
    few = fit_quality(df, labels, sample_grams=1)  # one row of each class
    assert few is not None and score_quality(df, few).where("score between 0 and 1").count() == 60


def test_tokens_of_a_run_without_blanks(spark):
    from packwright.llm.token_counts import _encoding

    text = "ab" * 30_000
    enc = _encoding(open(VOCABULARY, "rb").read())
    got = length_histogram(spark.createDataFrame([(text,)], "text string"), VOCABULARY).collect()
    assert [tuple(r) for r in got] == [(len(enc.encode_ordinary(text)), 1)]


def test_pipeline_runs_from_end_to_end(spark, tmp_path):
    """The pipeline's rows against plain versions of its stages, on rows with repeated and null ids."""
    import corpus_pipeline as P

    r = random.Random(9)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    good = lambda: " ".join("".join(r.choice("abcdefghil") for _ in range(r.randrange(2, 8))) for _ in range(40)) + "."
    rows, labels = [], []
    for i in range(120):
        rows.append((i, good() if i % 2 else "x** $$ " * 30 + str(i), r.choice("abc")))
        labels.append((i, i % 2))
    kept = [rows[k][1] for k in range(1, 120, 2)]
    rows += [(200, kept[0], "a"), (201, f"{kept[1]} tail", "b"), (1, good(), "c"), (None, good(), "a"), (None, good(), None)]
    rows += [(202, f"{good()} {passage} {good()}", "b"), (203, f"{good()} mail me.now@example.org {good()}", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = fit_quality(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good_ones = [tuple(x) for x in score_quality(docs, model, column="q").where("q >= 0.7").select("doc_id", "text").collect()]
    assert all(passed in good_ones for passed in [(i, t) for i, t, _ in rows if i is None or i % 2])
    names = {i: t for i, t in enumerate(t for _, t in good_ones)}  # rows by number, so that ids may repeat
    group = brute.components(list(names.items()), k=5, num=80)
    first = {}
    for i, (n, root) in group.items():
        key = (good_ones[i][0] is None, good_ones[i][0] or 0)
        if n and (root not in first or key < first[root][0]):
            first[root] = (key, i)
    left = [good_ones[i] for i, (n, root) in group.items() if not n or first[root][1] == i]
    plain = brute.decontamination([(i, t) for i, (_, t) in enumerate(left)], [(1, passage)])
    left = [row for i, row in enumerate(left) if not plain[i][4]]
    assert sorted(repr(x["doc_id"]) for x in out) == sorted(repr(i) for i, _ in left)
    assert 202 not in [i for i, _ in left] and 200 not in [i for i, _ in left] and (203 in [i for i, _ in left])
    sizes = {i: len(t.split()) for i, t in left if i is not None and i != 1}
    assert all(x["size"] == sizes[x["doc_id"]] and 0 <= x["taken"] <= 2 * x["size"] for x in out if x["doc_id"] in sizes)
    by_source = {}
    for x in out:
        by_source.setdefault(x["source_size"], [0, x["target"]])[0] += x["taken"]
    assert sum(t for t, _ in by_source.values()) == sum(int(t) for _, t in by_source.values())


@pytest.mark.parametrize("name", ["op1_benchmark_decontamination", "op2_source_mixing", "op4_ngram_jaccard_join", "op7_exact_topk", "op9_license_scans", "op11_conversation_repair", "op12_importance_resampling", "op13_url_filters"])
def test_queries_agree_with_sql(spark, name):
    from oracle_check import connect, differences

    from packwright.llm.oracle import ORACLES
    from packwright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert differences(spark, connect(sf), QUERIES[name], ORACLES[name], sf) == ""

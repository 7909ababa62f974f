"""Operators made of DataFrame functions alone, against plain versions and on awkward rows."""

import brute
import pytest
from conftest import ROWS

from packwright.llm.decontaminate import contamination
from packwright.llm.licenses import license_scan
from packwright.llm import mixing
from packwright.llm.mixing import drawn_words, mixture, placed_words
from packwright.llm.pii import SpanModel, personal_data, pii_digest, redacted
from packwright.llm.secrets import secret_digest, secret_scan

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "WORD"), (3, "ünï x"), (4, None), (5, " . "), (10, "word"), (6, "wort wort wort")]


def by_row(rows, cols):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, tuple(r[c] for c in cols)) for r in rows), key=repr)


def wanted(f):
    return sorted(((d is None, d or 0, f(t)) for d, t, *_ in ROWS), key=repr)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, docs, no_docs, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(docs, items, broadcast_rows=limit).collect()
    plain = {t: brute.decontamination([(0, t)], ITEMS)[0] for _, t, *_ in ROWS}
    hits = [(r["n_words"], r["n_hit"], r["n_items"], brute.sha(",".join(r["items"])), r["contaminated"]) for r in got]
    assert sorted(hits, key=repr) == sorted([plain[t] for _, t, *_ in ROWS], key=repr)
    assert contamination(no_docs, items, broadcast_rows=limit).count() == 0
    assert contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_licenses(docs, no_docs):
    got = license_scan(docs).collect()
    assert by_row(got, ["n_words", "n_base", "first_word", "last_word", "base_labels"]) == wanted(brute.licenses)
    assert {r["doc_id"]: r["labels"] for r in got if r["labels"]} == {12: "mit", 13: "gpl-3"}
    assert license_scan(no_docs).count() == 0


def test_secrets(docs, no_docs):
    got = secret_digest(secret_scan(docs)).collect()
    assert by_row(got, ["n_assign", "n_access", "n_hex", "base_sha256"]) == wanted(brute.secrets)
    assert secret_digest(secret_scan(no_docs)).count() == 0


def test_copied_secrets_are_told_from_owned_ones(spark):
    token = "gh" + "p_" + "Ab1" * 8
    rows = [(i, f"x {token}", f"o{i % 3}") for i in range(6)] + [(9, "y gho_Zz9Zz9Zz9Zz9Zz9Zz9Zz9", "o1")]
    got = secret_digest(secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert {r["doc_id"]: r["spans"] for r in got if r["spans"]} == {9: "token:2:27"}


@pytest.fixture(scope="module")
def model(spark):
    return SpanModel(spark)


def test_personal_data(docs, no_docs, model):
    got = pii_digest(personal_data(docs, model=model)).collect()
    assert by_row(got, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256"]) == wanted(brute.personal)
    assert pii_digest(personal_data(no_docs, model=model)).count() == 0


def test_personal_data_adds_and_redacts(spark, model):
    rows = [(1, "please call 555-123-4567 now, or a@b.example"), (2, "on 2024-01-15 we had 1234567 items"), (3, "\U0001F600 +1 234 555 0199")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal_data(df, model=model)
    out = df.join(found, "doc_id").select("doc_id", redacted(df["text"], found["all"]).alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in out} == {1: "please call [NUMBER] now, or [EMAIL]", 2: rows[1][1], 3: "\U0001F600 [PHONE]"}
    assert all(0.5 <= t <= 1 for t in model.thresholds.values())


def test_base_patterns_agree_with_plain_ones(spark):
    import random

    from packwright.llm.pii import base_spans
    from packwright.llm.common import spans_text
    from pyspark.sql import functions as F

    r = random.Random(4)
    texts = ["".join(r.choice("ab1.@ -+(9") for _ in range(60)) for _ in range(400)] + ["".join(r.choice("0123456789 -") for _ in range(50)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.sha2(spans_text(base_spans(F.col("t"))), 256).alias("d"))
    assert {x["i"]: x["d"] for x in df.collect()} == {i: brute.personal(t)[4] for i, t in enumerate(texts)}


def test_mixing(docs, no_docs):
    rows = drawn_words(docs).collect()
    assert len(rows) == len(ROWS)
    by_source = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_source.setdefault(r["_pw_source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    for taken, size, target, said in by_source.values():
        assert taken == int(target) and size == said and target <= 2 * size
    assert abs(sum(s[2] for s in by_source.values()) - 1.5 * sum(s[1] for s in by_source.values())) < 1e-6
    assert sorted(map(repr, drawn_words(docs).collect())) == sorted(map(repr, rows))
    assert drawn_words(no_docs).count() == 0
    mixed = mixture(docs, depth=2)
    assert mixed.agg({"words": "sum"}).first()[0] == sum(r["taken"] for r in rows)
    assert set(mixed.columns) >= {"text", "copy", "words", "shard", "place"}


def test_mix_follows_the_tree(docs, spark, monkeypatch):
    options = {"block_words": 3, "depth": 2}
    drawn = sorted((repr(r["doc_id"]), r["taken"]) for r in drawn_words(docs, block_words=3).collect())
    rows = placed_words(docs, **options).collect()
    assert sorted((repr(r["doc_id"]), r["taken"]) for r in rows) == drawn
    whole = mixture(docs, **options).where("words > 0").select("doc_id", "shard").distinct().collect()
    assert {(r["doc_id"], s) for r in rows for s in r["shards"]} == {(r["doc_id"], r["shard"]) for r in whole}
    assert placed_words(docs.limit(0)).count() == 0
    tree = mixing.output_shards
    monkeypatch.setattr(mixing, "output_shards", lambda *a: tree(*a).where("shard > 0"))  # a tree that loses blocks is seen
    docs.write.mode("overwrite").parquet(path := spark.conf.get("spark.checkpoint.dir") + "/mix/documents.parquet")
    from packwright.llm.queries import op2_source_mixing

    taken = op2_source_mixing(spark, path.rsplit("/", 1)[0]).agg({"taken": "sum"}).first()[0]
    assert taken < sum(n for _, n in drawn)


def test_wrapped_license_notices(spark):
    import textwrap

    from packwright.llm.licenses import NOTICES

    rows, n = [], 0
    for lead in ("", " * ", "# ", "// "):
        for label, text in NOTICES:
            body = "\n".join(lead + line for line in textwrap.wrap(text, 36))
            rows.append((n, f"{lead}Copyright 2020 Somebody\n{lead.rstrip()}\n{body}\n{lead.rstrip()}\nimport os\n", label))
            n += 1
    rows.append((n, "Redistribution and use in source\n\nand binary forms, with or without modification,\n\nare permitted provided that the following conditions are met.", None))
    rows.append((n + 1, "Redistribution and use in source and binary forms. With or without modification, are permitted\nprovided that the following conditions are met.", None))
    got = {r["doc_id"]: r["labels"] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string, label string")).collect()}
    assert all(got[i] == (label or "") for i, _, label in rows), "each notice gives its own label and no other"


def test_notices_that_differ_in_a_word(spark, tmp_path):
    from oracle_check import connect, differences

    from packwright.llm import oracle, queries

    gpl = "This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU {} as published\n * by the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version.\n"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    mixed = gpl.format("General Public License", 3).split()
    cases = [
        (gpl.format("General Public License", 2), "gpl-2"), (gpl.format("General Public License", 3), "gpl-3"), (gpl.format("Affero General Public License", 3), "agpl-3"),
        (gpl.format("Lesser General Public License", "2.1").replace("program", "library"), "lgpl-2.1"), (gpl.format("Lesser General Public License", 3).replace("program", "library"), "lgpl-3"),
        (gpl.format("Library General Public License", 2), ""), (gpl.format("Affero General Public License", 2), ""), (gpl.format("General Public License", 4), ""),
        (cc.format("-NonCommercial-ShareAlike"), "cc-by-nc-sa"), (cc.format("-Non-Commercial"), "cc-by-nc"), (cc.format("-NoDerivs"), "cc-by-nd"), (cc.format(""), "cc-by"),
        (cc.format(" ShareAlike") + "\nThis work is licensed under the GNU General Public License,\nversion 2.", "cc-by-sa,gpl-2"), ("General Public License, version 2.", ""),
        (" ".join(sorted(mixed)), ""), ("You should have received a copy of the GNU General Public License along with this program.", ""),
    ]
    rows = [(k, t, label) for k, (t, label) in enumerate(cases)]
    spark.createDataFrame(rows, "doc_id long, text string, labels string").coalesce(1).write.parquet(str(tmp_path / "parts"))
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got = {r["doc_id"]: r["labels"] for r in queries.op9_license_scans(spark, str(tmp_path)).collect()}
    assert got == {k: label for k, _, label in rows}
    assert not differences(spark, connect(str(tmp_path)), queries.op9_license_scans, oracle.ORACLES["op9_license_scans"], str(tmp_path))


def test_mixture_tells_sources_apart(spark):
    rows = [(1, "one two three four", "x"), (1, "one two three four", "y"), (2, "five six", "x"), (3, "seven " * 9, "y"), (4, "eight", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = drawn_words(df, block_words=2).groupBy("_pw_source").agg({"taken": "sum"}).collect()
    mixed = mixture(df, block_words=2).groupBy("source").agg({"words": "sum"}).collect()
    assert {r[0]: r[1] for r in mixed} == {r[0]: r[1] for r in drawn if r[1]}


def test_tree_halves_every_node(spark):
    """Quotas: the halves of every node differ by one block at most, sources' blocks are shared out whole and once."""
    import random

    r = random.Random(8)
    df = spark.createDataFrame([(i, "w " * r.randrange(1, 9), r.choice("aab")) for i in range(900)], "doc_id long, text string, source string")
    drawn = drawn_words(df, block_words=10).cache()
    shards = mixing.output_shards(drawn, depth=3).collect()
    blocks = [(x["_pw_source"], x["_pw_block"], x["_pw_copy"]) for x in shards]
    want = set()
    for x in drawn.collect():
        n = x["_pw_passes"] + (x["_pw_partial"] > 0)
        want |= {(x["_pw_source"], x["_pw_block"], c) for c in range(n)}
    assert len(blocks) == len(set(blocks)) and set(blocks) == want
    for level in range(3):
        nodes = {}
        for x in shards:
            nodes.setdefault(x["shard"] >> (3 - level), [0, 0])[(x["shard"] >> (2 - level)) & 1] += 1
        assert all(0 <= left - right <= 1 for left, right in nodes.values())
    by_source = {}
    for x in shards:
        by_source.setdefault(x["_pw_source"], [0] * 8)[x["shard"]] += 1
    assert all(max(v) - min(v) < 0.5 * sum(v) for v in by_source.values())


def test_account_numbers(spark, model):
    from packwright.llm.pii import checks_out

    from pyspark.sql import functions as F

    rows = [(1, "DE89370400440532013000"), (2, "GB82 WEST 1234 5698 7654 32"), (3, "DE88370400440532013000")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["c"] for r in df.select("doc_id", checks_out(F.col("text")).alias("c")).collect()} == {1: True, 2: True, 3: False}
    texts = [(1, "pay to DE89 3704 0044 0532 0130 00 soon"), (2, "tel 030 1234567"), (3, "order DE88 3704 0044 0532 0130 00 item"), (4, "item 030 1234567")]
    got = pii_digest(personal_data(spark.createDataFrame(texts, "doc_id long, text string"), model=model)).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {1: "account:7:34", 2: "number:4:15", 3: "", 4: ""}


def test_ownership_counts_against_plain_ones(spark):
    import random
    import re

    r = random.Random(6)
    values = ["".join(r.choice("0123456789abcdef") for _ in range(20)) for _ in range(12)]
    rows = [(i, " ".join(r.choice(values[: 3 + i % 9]) for _ in range(r.randrange(4))), r.choice(["o1", "o2", None])) for i in range(40)]
    rows.append(rows[3])
    owners, repos = {}, {}
    for d, t, o in rows:
        for v in re.findall("[0-9a-f]{16,}", t):
            owners.setdefault(v, set()).add(o)
            repos.setdefault(v, set()).add(d)
    live = {v for v in owners if len(owners[v]) <= 1 and len(repos[v]) <= 4}
    want = sorted((d, sum(v in live for v in t.split()), sum(v not in live for v in t.split())) for d, t, _ in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = secret_scan(df, most_repos=4).select("doc_id", "n_live", "n_copied").collect()
    assert live and sorted(map(tuple, got)) == want

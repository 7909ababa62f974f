"""Conversation repair, importance resampling and URL filters against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest

from packwright.llm import conversations as conv
from packwright.llm import importance, url_filter
from packwright.llm.conversations import CUT, GOES, cheapest_edits, repaired_conversations
from packwright.llm.importance import importance_resample, resampled_documents
from packwright.llm.url_filter import url_verdicts

LEGAL = re.compile(r"(s?(ua)+)?")


def plain_edits(turns):
    """Least (cost, audit) by best-first search over edit strings; a turn is (initial, must go, truncated)."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "")], {}
    while heap:
        cost, audit, t, last = heapq.heappop(heap)
        if (t, last) in seen and seen[t, last] < (cost, audit):
            continue
        seen[t, last] = (cost, audit)
        if t == len(turns) and last in ("", "a"):
            return cost, audit
        other = "a" if last == "u" else "u"
        if audit[-3:] != "III":
            heapq.heappush(heap, (cost + 2, audit + "I", t, other))
        if t < len(turns):
            kind, goes, cut = turns[t]
            heapq.heappush(heap, (cost + 3, audit + "D", t + 1, last))
            if not goes:
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", t + 1, other))
                if kind in after[last]:
                    heapq.heappush(heap, (cost + cut, audit + "K", t + 1, kind))
    raise AssertionError


def plain_costs(code):
    """Cost of one conversation, turn by turn."""
    best = [0, 4, 2, 0]
    for c in reversed(code):
        kind, goes, cut = c & 3, c & GOES, 1 if c & CUT else 0
        out = []
        for s, nxt in enumerate((2, 2, 3, 2)):
            options = [3 + best[s]]
            if not goes:
                options.append(cut + 2 + best[nxt])
                to = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (3, 2): 2, (2, 3): 3}.get((s, kind))
                if to is not None:
                    options.append(cut + best[to])
            out.append(min(options))
        best = [min(out[0], 2 + out[2], 4 + out[3]), min(out[1], 2 + out[2], 4 + out[3]), min(out[2], 2 + out[3]), min(out[3], 2 + out[2])]
    return best[0]


def plain_repair(rows):
    """Everything the operator returns, from (conv, turn, role, text) rows."""
    out, by = {}, {}
    for c, turn, role, text in rows:
        by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        by[c] += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in turns:
            ending = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not ending else "duplicate" if (role, text) in seen else "truncated" if ending[0] not in ".!?" else "")
            seen.add((role, text))
        told = [t for t, _, _ in turns if t is not None]
        kinds = [r[:1] for _, r, _ in turns]
        cost, audit = plain_edits([(k if k in {*"sua"} else "x", f in ("blank", "duplicate"), int(f == "truncated")) for k, f in zip(kinds, faults)])
        left, kept, last = list(turns), [], ""
        for e in audit:
            other = "assistant" if last == "u" else "user"
            _, role, text = left.pop(0) if e != "I" else (None, None, "")
            if e != "D":
                kept.append((role if e == "K" else other, text))
                last = kept[-1][0][:1]
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in kept)) and not left
        out[c] = (
            max(told) - min(told) + 1 - len(set(told)) if told else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def test_edits_agree_with_search():
    r = random.Random(5)
    many = []
    for _ in range(700):
        code = [r.choice([1, 2, 2, 3, 3, 0]) | r.choice([0, 0, 0, GOES, CUT]) for _ in range(r.randrange(0, 9))]
        many.append(code)
    got = cheapest_edits([np.array(c, np.int64) for c in many])
    for code, found in zip(many, got, strict=True):
        assert found == plain_edits([("xsua"[c & 3], bool(c & GOES), int(bool(c & CUT))) for c in code]), code


def test_long_conversations_are_solved_in_chunks(monkeypatch):
    r, whole = random.Random(6), []
    for n in (5, 33, 64, 65, 500):
        whole.append(np.array([r.choice([1, 2, 2, 3, 3, 0]) | r.choice([0, 0, GOES, CUT]) for _ in range(n)], np.int64))
    want = cheapest_edits(whole)
    assert [c for c, _ in want] == [plain_costs(w.tolist()) for w in whole]
    monkeypatch.setattr(conv, "CHUNK", 16)
    assert cheapest_edits(whole) == want


def test_repair_agrees_with_plain_version(spark):
    r, rows = random.Random(7), []
    words = ["Yes.", "no", " ", "", "What?", "so be it!\n", "über"]
    for c in range(60):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["system", "user", "user", "assistant", "assistant", "tool"]), r.choice(words)))
    rows += [(None, None, None, None), (None, 3, "user", "hi."), (77, None, "assistant", "a."), (77, None, "assistant", "a."), (77, 9, "user", "a."), (78, 1, "", "x" * 100_000)]
    rows += [(100, t % 7, "user" if t % 3 else "assistant", f"word {t % 50}.") for t in range(3000)]  # one hot conversation with ties
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, audit int")
    got = {x[0]: tuple(x)[1:] for x in repaired_conversations(df).collect()}
    want = plain_repair([x for x in rows if x[0] != 100])
    assert {k: v for k, v in got.items() if k != 100} == want
    assert len(got[100][6].replace("I", "")) == sum({0: 0, 3: 2}.get(zlib.crc32(f"100:{x[1]}".encode()) % 20, 1) for x in rows if x[0] == 100)
    assert repaired_conversations(df.where("conv_id < 0")).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for texts, into in (([x for _, x in rows], s), (target, t)):
        for f in (f for x in texts for f in features_of(x)):
            into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log(float(b + 1) * (sum(s) + 10_000) / (float(a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for d, text in rows:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features_of(text))
        out.append([d, len(features_of(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    may = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(may[: len(may) * 5 // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def test_resampling_agrees_with_plain_version(spark, docs, no_docs):
    r = random.Random(8)
    rows = [(i, " ".join(f"W{r.randrange(300)}" if r.random() < 0.9 else "naïve" for _ in range(r.randrange(0, 80)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "é" * 50), (403, "a\x00b_c-D " * 30), (7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1])]
    target = [" ".join(f"w{r.randrange(40)}" for _ in range(60)) for _ in range(20)] + [None]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, rank int, score int")
    found = importance_resample(df, spark.createDataFrame([(x,) for x in target], "text string"))
    got = sorted((tuple(x) for x in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == plain_resample(rows, target)
    drawn = resampled_documents(df, found)
    assert sorted(x["_pw_rank"] for x in drawn.collect()) == [x for x in range(1, drawn.count() + 1)] and drawn.count() == sum(x[4] is not None for x in got)
    assert importance_resample(docs, no_docs).count() == docs.count() and importance_resample(no_docs, docs).count() == 0


@pytest.mark.parametrize("piece", [7, 40, 1000])
def test_long_texts_count_whole(monkeypatch, piece):
    r = random.Random(piece)
    text = " ".join(r.choice(["ab", "C", "longer" * 4, "é1", "--"]) for _ in range(400)).encode()
    raw = np.frombuffer(text, np.uint8)
    monkeypatch.setattr(importance, "PIECE", piece)
    total, words = np.zeros(10_000, np.int64), 0
    for part, skip in importance._cuts(raw, 0, len(raw)):
        _, bucket, word = importance._features(part, np.array([0]), np.array([len(part)]), 10_000, skip)
        total += np.bincount(bucket, minlength=10_000)
        words += len(word)
    want = [zlib.crc32(f.encode()) % 10_000 for f in features_of(text.decode())]
    assert words == len(words_of(text.decode())) and (total == np.bincount(want, minlength=10_000)).all()


def plain_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def test_rules_hosts_and_paths(spark):
    urls = [
        None, "", "no scheme", "http://ORG", "http://org/", "http://a.example.org/es/1", "http://example.org/en/19", "http://example.org/en/2", "ftp://notorg/x",
        "http://x.com/fr/1", "http://x.com/de/?a=/fr/", "http://x.com#/fr/", "http://example.org:80/es/", "a://b://c/d", "http://h?q=://z.com/fr/", "http://x.com//de/", "http://y.com/" + "s/" * 3000,
    ]
    rows = [(k, u, "v") for k, u in enumerate(urls)] + [(3, urls[3], "v"), (None, urls[4], "v")]
    got = url_verdicts(spark.createDataFrame(rows, "page_id long, url string, verdict string")).collect()
    assert len(got) == len(rows)
    rules = {0: None, 3: None, 4: "org/", 5: "example.org/es/", 6: "example.org/en/1", 7: "org/", 8: None, 9: "com/fr/", 10: "com/de/", 11: None, 12: None}
    for x in got:
        if x["page_id"] is not None:
            assert (x["host"], x["path"]) == plain_url(urls[x["page_id"]])
            assert x["rule"] == rules.get(x["page_id"], x["rule"]) and x["verdict"] in ("allow", "block")
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    rows = [(i, f"http://shop.net/item/{i}", "block") for i in range(30)] + [(100 + i, f"http://shop.net/help/{'abcdefghij'[i]}", "allow") for i in range(10)]
    rows += [(200, "http://shop.net/item/999", None), (201, "http://shop.net/help/new", None), (202, "http://shop.net/other", None), (203, "http://else.net/a", None)]
    rows += [(300 + i, f"http://shop.net/item2/{i}", "block" if i else "allow") for i in range(12)]
    rows += [(400 + i, f"http://spam-farm.net/{'abc'[i % 3]}/{i}", None) for i in range(20)] + [(500, "http://www.spamalot.net/", None), (501, "http://poker.net/", None)]
    got = {x["page_id"]: x for x in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, label string"), label_col="label").collect()}
    assert got[200]["verdict"] == "block" and got[201]["verdict"] == "allow" and got[203]["verdict"] == "allow"
    assert got[200]["template"].endswith("/#") and got[201]["template"] == "/help/*"
    assert got[0]["template"] == got[301]["template"], "branches with like shares are one"
    assert got[203]["purity"] == url_filter.EVEN, "no host is judged by others"
    assert got[405]["verdict"] == "block" and got[500]["verdict"] == got[501]["verdict"] == "allow"

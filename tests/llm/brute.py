"""Plain versions of the corpus operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def words(text):
    return WORD.findall(lower(text))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def decontamination(docs, items, window=10):
    """docs, items: [(id, text)]; {doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}"""
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    sizes = sorted({len(w) for w in wins})
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (got := wins.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= got
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def spans_digest(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], kinds.index(x[2]))))


def secrets(text):
    kinds = ("assign", "access", "hex")
    pats = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    spans = []
    for kind, p in pats.items():
        for m in p.finditer(text or ""):
            if (kind == "assign" and len(m[2]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                spans.append((m.start(), m.end(), kind))
    return (*[sum(s[2] == k for s in spans) for k in kinds], sha(spans_digest(spans, kinds)))


def luhn(digits):
    t = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        t += d - 9 if d > 9 else d
    return t % 10 == 0


def personal(text):
    kinds = ("email", "ip", "card", "phone")
    pats = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    spans = []
    for kind, p in pats.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=d: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=d: 9 <= len(d) <= 15,
            }[kind]()
            if ok:
                spans.append((m.start(), m.end(), kind))
    return (*[sum(s[2] == k for s in spans) for k in kinds], sha(spans_digest(spans, kinds)))


def licenses(text):
    w = words(text)
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    starts, labels = [], set()
    for p, label in phrases.items():
        ws = p.split()
        for i in range(len(w) - len(ws) + 1):
            if w[i : i + len(ws)] == ws:
                starts.append(i)
                labels.add(label)
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(docs, k=4, num=85):
    """docs: [(id, text)]; {doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {}
    for d, t in docs:
        sets.setdefault(d, set()).add(shingles(t, k))
    nodes = [(d, s) for d, ss in sets.items() for s in ss]
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (a, x) in enumerate(nodes):
        for b, y in nodes[:i]:
            if x and y and a != b and 100 * min(len(x), len(y)) >= num * max(len(x), len(y)):
                inter = len(x & y)
                if 100 * inter >= num * (len(x) + len(y) - inter):
                    ra, rb = sorted((root(a), root(b)))
                    parent[rb] = ra
    return {d: (max(len(s) for s in ss), root(d)) for d, ss in sets.items()}

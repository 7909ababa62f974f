"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall patterns propose spans that may overlap. Boosted trees (Spark ML) score each proposal by its
format and its context; a threshold per kind, calibrated on spans kept back from the fit, decides. The four
base kinds are found by their own exact rules and always stay; accepted proposals are added beside them.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm.common import joined_back, match_spans, released, spans_text, tagged, texts

# A run's inner places can't start a match that its first place can't; \G lets one start where the last ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

PROPOSALS = (
    ("address", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++"),
    ("dotted", r"(?:(?<![0-9])|\G)[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}"),
    ("number", r"\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,24}+"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"),
)
#: Code points of context on the left and on the right of a proposal.
LEFT, RIGHT = 32, 8


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), worth)
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def checks_out(found: Column) -> Column:
    """Whether an account number, its first four signs moved to the end and its letters read as 10 to 35, leaves 1 modulo 97."""
    flat = F.regexp_replace(found, "[^A-Z0-9]", "")
    signs = F.split(F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4)), "(?!^)(?!$)")

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (F.when(value > 9, rest * 100).otherwise(rest * 10) + value) % 97

    return F.aggregate(signs, F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c)).cast("int")) == 1


def _small_parts(found: Column) -> Column:
    """Whether every dotted part is at most 255, however many zeros it starts with."""
    parts = F.transform(F.split(found, "[.]"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """All base spans as array<struct<start, order, end, kind, found>>, sorted by start and then kind as listed."""

    def card(m: Column) -> Column:
        d = _digits(m)
        return F.when(F.length(d) <= 19, luhn(d)).otherwise(False)

    rules = (
        (EMAIL, None),
        (IP, _small_parts),
        (CARD, card),
        (PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
    )
    found = [tagged(match_spans(text, p, keep), k, KINDS[k]) for k, (p, keep) in enumerate(rules)]
    return F.array_sort(F.concat(*found))


def _with_features(spans: DataFrame) -> DataFrame:
    """Format and context features of (kind, left, found, right)."""
    m, left, right = F.col("found"), F.col("left"), F.col("right")
    d = _digits(m)

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    made = {
        "is_address": flag(F.col("kind") == "address"),
        "is_dotted": flag(F.col("kind") == "dotted"),
        "is_account": flag(F.col("kind") == "account"),
        "checks_out": flag(F.when(F.col("kind") == "account", checks_out(m))),
        "length": F.length(m).cast("double"),
        "n_digits": F.length(d).cast("double"),
        "n_separators": F.length(F.regexp_replace(m, r"[^\x20-]", "")).cast("double"),
        "n_points": F.length(F.regexp_replace(m, "[^.]", "")).cast("double"),
        "has_at": flag(m.contains("@")),
        "plus": flag(m.startswith("+")),
        "parenthesis": flag(m.contains("(")),
        "luhn": flag(F.when(F.length(d) > 0, luhn(d))),
        "small_parts": flag(F.when(F.col("kind") == "dotted", _small_parts(m))),
        "area_form": flag(m.rlike(r"^(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")),
        "person_form": flag(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "date_form": flag(m.rlike(r"^(?:[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}|[0-9]{2}[.-][0-9]{2}[.-][0-9]{4})")),
        "four_groups": flag(m.rlike(r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$")),
        "joined_left": flag(left.rlike("[A-Za-z0-9_.-]$")),
        "joined_right": flag(right.rlike("^[A-Za-z0-9_-]")),
        "says_phone": flag(left.rlike(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp)\b")),
        "says_person": flag(left.rlike(r"(?i)\b(?:ssn|social|security|passport)\b")),
        "says_card": flag(left.rlike(r"(?i)\b(?:card|visa|credit|debit|mastercard)\b")),
        "says_mail": flag(left.rlike(r"(?i)\b(?:mail|email|e-mail|contact|write|reach)\b")),
        "says_host": flag(left.rlike(r"(?i)\b(?:ip|host|server|address|client)\b")),
        "says_other": flag(left.rlike(r"(?i)\b(?:version|order|invoice|item|page|isbn|id|build|release|date|on|from|total|no)\b")),
    }
    return spans.withColumns({f"f_{k}": v for k, v in made.items()})


FEATURES = (
    "is_address", "is_dotted", "is_account", "checks_out", "length", "n_digits", "n_separators", "n_points", "has_at", "plus", "parenthesis", "luhn", "small_parts",
    "area_form", "person_form", "date_form", "four_groups", "joined_left", "joined_right",
    "says_phone", "says_person", "says_card", "says_mail", "says_host", "says_other",
)


def labelled_spans(seed: int, n: int) -> list[tuple[str, str, str, str, float, bool]]:
    """n invented spans (kind, left, found, right, label, kept back): the bounded sample that the trees are fit on."""
    r = random.Random(seed)

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        while True:
            s = "4" + digits(15)
            total = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(s)))
            if (total % 10 == 0) == valid:
                return s

    def word() -> str:
        return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))

    def plain() -> str:
        return f"{word()} {word()} "

    def grouped(s: str) -> str:
        sep = r.choice((" ", "-", ""))
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def groups(k: int) -> str:
        sep, s = r.choice((" ", "-", "/", "")), digits(k)
        at = sorted({2, *r.sample(range(4, k - 1), r.randint(0, 2))})
        return sep.join(s[i:j] for i, j in zip([0, *at], [*at, k], strict=True))

    def account(valid: bool) -> str:
        place, body = r.choice(("DE", "FR", "GB", "ES", "NL")), digits(r.choice((14, 18, 20)))
        check = 98 - int(body + "".join(str(ord(c) - 55) for c in place) + "00") % 97
        s = f"{place}{(check + (0 if valid else r.randint(1, 90))) % 97:02d}{body}"
        return r.choice((s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))))

    def area(sep: str) -> str:
        return r.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", sep.join((digits(3), digits(3), digits(4)))))

    def says(*words: str) -> str:
        return f"{word()} {r.choice(words)} "

    made = (
        (1, lambda: ("address", r.choice((plain(), says("email", "contact", "write"))), f"{word()}@{word()}.{r.choice(('com', 'org', 'example.net'))}")),
        (1, lambda: ("address", r.choice((plain(), says("email", "mail", "reach"))), f"{word()} {r.choice(('(at)', '[at]'))} {word()} {r.choice(('(dot)', '[dot]', '.'))} com")),
        (0, lambda: ("address", says("version", "release"), f"{word()}@{digits(1)}.{digits(1)}.{digits(1)}")),
        (1, lambda: ("dotted", r.choice((plain(), says("host", "ip", "server"))), ".".join(str(r.randint(0, 255)) for _ in range(4)))),
        (0, lambda: ("dotted", r.choice((plain(), says("version", "build"))), ".".join(str(r.randint(256, 9999)) for _ in range(4)))),
        (1, lambda: ("number", r.choice((plain(), says("card", "visa", "credit"))), grouped(card(True)))),
        (0, lambda: ("number", r.choice((plain(), says("order", "item", "invoice"))), grouped(card(False)))),
        (1, lambda: ("number", says("tel", "phone", "call", "mobile"), area(r.choice(("-", ".", " "))))),
        (1, lambda: ("number", r.choice((plain(), says("phone", "call"))), "+" + r.choice((f"1 ({digits(3)}) {digits(3)}-{digits(4)}", f"4{digits(1)} {digits(3)} {digits(6)}")))),
        (1, lambda: ("number", says("tel", "phone", "call", "fax", "mobile"), "0" + groups(r.randint(8, 11)))),
        (0, lambda: ("number", r.choice((plain(), says("item", "order", "page", "total"))), "0" + groups(r.randint(8, 11)))),
        (1, lambda: ("account", r.choice((plain(), says("account", "bank", "pay"))), account(True))),
        (0, lambda: ("account", r.choice((plain(), says("item", "order", "version"))), account(False))),
        (1, lambda: ("number", says("ssn", "social", "security"), f"{digits(3)}-{digits(2)}-{digits(4)}")),
        (0, lambda: ("number", plain(), f"{digits(3)}-{digits(2)}-{digits(4)}")),
        (0, lambda: ("number", r.choice((plain(), says("on", "date", "from"))), f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}")),
        (0, lambda: ("number", r.choice((plain(), says("on", "date"))), f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.randint(1900, 2030)}")),
        (0, lambda: ("number", r.choice((plain(), says("total", "order", "id", "no"))), digits(r.randint(7, 15)))),
        (0, lambda: ("number", r.choice((plain(), says("total", "page"))), f"{digits(1)}.{digits(r.randint(7, 12))}")),
        (0, lambda: ("number", says("isbn", "item"), f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}")),
        (0, lambda: ("number", r.choice((plain(), says("from", "page"))), f"{r.randint(1900, 2030)} - {r.randint(1900, 2030)}")),
    )
    rows = []
    for i in range(n):
        label, make = made[i % len(made)]
        kind, left, found = make()
        rows.append((kind, left[-LEFT:], found, r.choice((" ", ". ", ", ", "\n", "")) + word()[:3] * r.choice((0, 1)), float(label), r.random() < 0.3))
    return [(k, le, f, " " + ri.strip() if ri[:1].isalnum() else ri, la, h) for k, le, f, ri, la, h in rows]


class SpanModel:
    """Boosted trees over span features, with one acceptance threshold per kind of proposal."""

    def __init__(self, spark: SparkSession, *, seed: int = 7, n_labelled: int = 3400, rounds: int = 16, depth: int = 4, precision: float = 0.995):
        schema = "kind string, left string, found string, right string, label double, held boolean"
        rows = spark.createDataFrame(labelled_spans(seed, n_labelled), schema).coalesce(1)
        self._vector = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features")
        rows = self._vector.transform(_with_features(rows))
        trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxMemoryInMB=64)
        self._trees = trees.fit(rows.where(~F.col("held")))
        judged = self._score(rows.where("held")).select("kind", "label", "score").collect()  # part of n_labelled
        self.thresholds = {k: self._threshold([(s, y) for kind, y, s in judged if kind == k], precision) for k, _ in PROPOSALS}

    def _score(self, rows: DataFrame) -> DataFrame:
        return self._trees.transform(rows).withColumn("score", vector_to_array("probability")[1])

    @staticmethod
    def _threshold(judged: list[tuple[float, float]], precision: float) -> float:
        """The least score from which on spans kept back are right this often, and at least one half."""
        best, right = 1.0, 0
        for n, (score, label) in enumerate(sorted(judged, reverse=True), 1):
            right += label == 1
            if right / n >= precision:
                best = score
        return max(best, 0.5)

    def score(self, spans: DataFrame) -> DataFrame:
        """spans (kind, left, found, right, ...) with columns score and accepted."""
        scored = self._score(self._vector.transform(_with_features(spans)))
        least = F.create_map(*[x for k, t in self.thresholds.items() for x in (F.lit(k), F.lit(t))])
        scored = scored.withColumn("accepted", F.col("score") >= least[F.col("kind")])
        return scored.drop(*[f"f_{k}" for k in FEATURES], "features", "rawPrediction", "probability", "prediction")


_standard: dict[str, SpanModel] = {}


def standard_model(spark: SparkSession) -> SpanModel:
    """The trees with the standard settings, fit once in an application."""
    name = spark.sparkContext.applicationId
    if name not in _standard:
        _standard.clear()
        _standard[name] = SpanModel(spark)
        released(spark)  # a fit is a hundred small jobs
    return _standard[name]


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """One row per document row: doc_id, _pw_key, base, added, all: arrays of (start, order, end, kind, found).

    Null and empty texts have no spans; very long texts are searched whole, one row each; repeated rows get the same
    result; an empty table gives no rows; other columns are not read, whatever their names. Of accepted proposals that
    overlap, the best score stays (then the first start); those that overlap a base span are dropped.
    """
    model = model or standard_model(docs.sparkSession)
    rows = texts(docs, id_col, text_col).withColumn("_pw_text", F.coalesce("_pw_text", F.lit("")))
    text = F.col("_pw_text")
    based = rows.select("_pw_id", "_pw_key", base_spans(text).alias("base"))
    proposed = F.concat(*[tagged(match_spans(text, p), 4, k) for k, p in PROPOSALS])
    at = F.col("_pw_span.start")
    spans = rows.select("_pw_id", "_pw_key", "_pw_text", F.explode(proposed).alias("_pw_span")).select(
        "_pw_id", "_pw_key", F.col("_pw_span.kind").alias("kind"), F.col("_pw_span.found").alias("found"),
        at.alias("start"), F.col("_pw_span.end").alias("end"),
        F.substring(text, F.greatest(at - LEFT, F.lit(0)) + 1, F.least(at, F.lit(LEFT))).alias("left"),
        F.substring(text, F.col("_pw_span.end") + 1, F.lit(RIGHT)).alias("right"),
    )
    accepted = (
        model.score(spans)
        .where("accepted")
        .groupBy("_pw_id", "_pw_key")
        .agg(F.collect_set(F.struct((-F.col("score")).alias("worth"), "start", F.lit(4).alias("order"), "end", "kind", "found")).alias("_pw_accepted"))
    )
    out = joined_back(based, accepted)
    none = F.array().cast(based.schema["base"].dataType)

    def take(acc: Column, s: Column) -> Column:
        plain = F.struct(s["start"], s["order"], s["end"], s["kind"], s["found"])
        return F.when(_overlaps(s, acc) | _overlaps(s, F.col("base")), acc).otherwise(F.concat(acc, F.array(plain)))

    added = F.aggregate(F.array_sort("_pw_accepted"), none, take)
    return out.select(
        F.col("_pw_id").alias(id_col), "_pw_key", "base", F.coalesce(added, none).alias("added")
    ).withColumn("all", F.array_sort(F.concat("base", "added")))


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of personal_data's spans."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        id_col, *[count(k) for k in KINDS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("all")).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, sorted by start, replaced by its kind in brackets; overlapping spans merge."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        put = F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, put).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)

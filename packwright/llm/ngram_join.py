"""N-gram Jaccard join with several global orders.

Texts become sets of word shingles, hashed to 64 bits; equal sets form one class, so copies cost one row each.
Two sets that reach the threshold share one of their first n - ceil(t n) + 1 shingles (l of their first
n - ceil(t n) + l) under any order of all shingles. Three orders are used: by the shingle's hash upwards, by its hash
downwards, and by its document frequency, rarest first.

1. Classes: a class that shares too few of its first shingles, by the hash upwards, can't link and leaves.
2. Shingles of the classes left are counted exactly; classes that share too few of all their shingles leave.
3. Candidates meet at a shingle that stands in the prefixes of both by frequency; their sizes, shared counts and
   places must allow the threshold, and their prefixes must also meet under both hash orders. Only then are whole
   sets joined and their overlap counted.

Only components are asked for, so pairs inside one component needn't all be met: first every class meets the
likeliest centre of each prefix shingle; components of the links found are formed; then classes that
aren't in the most frequent component of a shingle meet all classes there of other components. Every pair
that could link two components is met, and a large group of near copies costs one pair a member.

Python only reads texts; everything after runs in Spark's joins and aggregations. Shingles and classes that more than
a thousandth of all rows share are at most a thousand, so they go to every task instead of into one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm import packed
from packwright.llm.common import joined_by_key, released, small_batches, small_enough, written
from packwright.llm.components import components

_U = np.uint64
#: Members of a shingle's group that one task meets with the classes outside its most frequent component.
_GROUP = 4096


def _class_name(shingles: np.ndarray, text: bytes, size: int) -> tuple[int, int]:
    """A set's 128-bit name; the order of its members doesn't matter, and the words of a lone shingle count themselves."""
    total = np.array([shingles.sum(dtype=_U), np.bitwise_xor.reduce(shingles), len(shingles)], _U)
    if len(shingles) == 1:
        other = hashlib.blake2b(b" ".join(text.split(None, size)[:size]), digest_size=8).digest()
    else:
        other = packed.mixed(shingles ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).tobytes()
    return int(packed.chained(packed.mixed(total), 3)[0].astype(np.int64)), int.from_bytes(other, "little", signed=True)


def _shingled(size: int, percent: int | None):
    """(columns before the text, 128-bit name, number of shingles, shingles by their hash upwards, columns behind the text).

    With percent only the first n - ceil(t n) + l shingles, l being a tenth of n; else all.
    """

    def signed(s: np.ndarray) -> np.ndarray:
        """Sorted hashes in the order of signed numbers."""
        k = int(np.searchsorted(s, _U(1 << 63)))
        every = np.concatenate((s[k:], s[:k])).view(np.int64)
        n = len(s)
        return every if percent is None or not n else every[: n + (-n * percent // 100) + max(1, n // 10)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_pw_text")
            raw, starts, ends = packed.column(batch, "_pw_text")
            for a, b in packed.parts(starts, ends):
                sets = list(packed.shingle_sets(raw, starts[a:b], ends[a:b], size))
                names = np.zeros((b - a, 2), np.int64)
                for k, s in enumerate(sets):
                    if len(s):
                        short = packed.LOWER[raw[starts[a + k] : ends[a + k]]].tobytes() if len(s) == 1 else b""
                        names[k] = _class_name(s, short, size)
                n = np.array([len(s) for s in sets], np.int64)
                kept = [signed(s) for s in sets]
                offsets = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in kept], out=offsets[1:])
                tokens = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens))
                part = batch.slice(a, b - a)
                columns = [*part.columns[:at], pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(n), lists, *part.columns[at + 1 :]]
                fields = [*batch.schema.names[:at], "_pw_hi", "_pw_lo", "_pw_n", "_pw_tokens", *batch.schema.names[at + 1 :]]
                yield pa.RecordBatch.from_arrays(columns, fields)

    return run


_MADE = "_pw_hi long, _pw_lo long, _pw_n long, _pw_tokens array<long>"


def _least_overlap(n: Column, percent: int) -> Column:
    """The fewest shingles of n that any partner at the threshold must share."""
    return F.ceil(n * percent / F.lit(100.0) - 1e-9).cast("long")


def _can_link(a_n: Column, a_shared: Column, b_n: Column, b_shared: Column, percent: int) -> Column:
    """Whether sizes and shared counts allow the threshold: 100 * overlap >= percent * union."""
    most = F.least(a_shared, b_shared)
    return 100 * most >= percent * (a_n + b_n - most)


def _sent_if_few(keys: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """keys for every task if a count shows so few of them; else they are shuffled."""
    return F.broadcast(keys) if small_enough(keys, rows) else keys


def _of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(_sent_if_few(classes.select("_pw_class")), "_pw_class", "left_semi")


def _shared(places: DataFrame) -> DataFrame:
    """Rows (class, token, ...) whose token another class has as well, with its number of classes, _pw_df."""
    counts = written(places.groupBy("_pw_token").agg(F.count(F.lit(1)).alias("_pw_df")).where("_pw_df > 1"))
    return joined_by_key(places, counts, "_pw_token", "_pw_df")


def _sharing_first(heads: DataFrame, percent: int) -> DataFrame:
    """Classes of (class, n, first shingles by hash) that share enough of them to link with any other.

    The first n - ceil(t n) + l shingles hold l of any pair's common ones, l being a tenth of n. A partner has at least
    t n shingles, so the lesser l of the two is at least a tenth of that.
    """
    places = heads.select("_pw_class", F.explode("_pw_tokens").alias("_pw_token"))
    found = _shared(places).groupBy("_pw_class").agg(F.count(F.lit(1)).alias("_pw_found"))
    enough = F.greatest(F.lit(1), F.floor(_least_overlap(F.col("_pw_n"), percent) / 10))
    return written(heads.select("_pw_class", "_pw_n").join(found, "_pw_class").where(F.col("_pw_found") >= enough).select("_pw_class"))


def _sharing(sets: DataFrame, percent: int) -> DataFrame:
    """Classes that share at least ceil(t n) of their shingles: class, n, shared; tokens, rarest first; up and down, prefixes by hash."""
    n = F.col("_pw_n")
    most = (n - _least_overlap(n, percent) + 1).cast("int")
    places = sets.select("_pw_class", F.explode("_pw_tokens").alias("_pw_token"))
    listed = F.sort_array(F.collect_list(F.struct("_pw_df", "_pw_token")))["_pw_token"]
    shared = _shared(places).groupBy("_pw_class").agg(listed.alias("_pw_tokens"))
    bounds = sets.select("_pw_class", n, F.get("_pw_tokens", most - 1).alias("_pw_low"), F.get("_pw_tokens", n.cast("int") - most).alias("_pw_high"))
    out = bounds.join(shared, "_pw_class").withColumn("_pw_shared", F.size("_pw_tokens"))
    up = F.filter("_pw_tokens", lambda t: t <= F.col("_pw_low"))
    down = F.filter("_pw_tokens", lambda t: t >= F.col("_pw_high"))
    enough = F.col("_pw_shared") * 100 >= n * percent
    return written(out.where(enough).select("_pw_class", "_pw_n", "_pw_shared", "_pw_tokens", up.alias("_pw_up"), down.alias("_pw_down")))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose prefixes also meet under both hash orders and whose exact overlap reaches the threshold."""

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("_pw_class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    both = pairs.join(side("a", "_pw_up", "_pw_down"), "a").join(side("b", "_pw_up", "_pw_down"), "b")
    met = both.where(F.arrays_overlap("_pw_up_a", "_pw_up_b") & F.arrays_overlap("_pw_down_a", "_pw_down_b")).select("a", "b")
    whole = written(met).join(side("a", "_pw_n", "_pw_tokens"), "a").join(side("b", "_pw_n", "_pw_tokens"), "b")
    overlap = F.size(F.array_intersect("_pw_tokens_a", "_pw_tokens_b"))
    union = F.col("_pw_n_a") + F.col("_pw_n_b") - F.col("_pw_overlap")
    return whole.withColumn("_pw_overlap", overlap).where(100 * F.col("_pw_overlap") >= percent * union).select("a", "b")


def jaccard_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4,
    percent: int = 85,
    tie_col: str | None = None,
) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (the smallest id reachable by links).

    Links join texts with 100 * overlap >= percent * union of their shingle sets. Null and empty texts have no
    shingles and are linked with nothing; very long texts are read whole, in pieces of bounded memory but for their
    own set; repeated rows and equal sets are one class, so ties need no order; a null id stays null unless its
    component holds another; an empty table gives no rows; further columns of docs are not read, whatever their names.
    With ``tie_col`` the result has this column as well, and _pw_first: whether the row has the least (id, tie) of
    its component, null ids last; texts without shingles all have. Shingles are known by 64-bit hashes: two of a pair
    would have to collide to change its overlap.
    """
    ties = [] if tie_col is None else ["_pw_tie"]
    rows = docs.select(F.col(id_col).alias("_pw_id"), F.col(text_col).alias("_pw_text"), *[F.col(tie_col).alias(c) for c in ties])
    kind = rows.schema["_pw_id"].dataType.simpleString()
    small_batches(docs.sparkSession)
    more = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in ties)
    texts = rows.withColumn("_pw_key", F.xxhash64("_pw_text"))
    made = texts.mapInArrow(_shingled(size, percent), f"_pw_id {kind}, {_MADE}{more}, _pw_key long")
    rows = written(made.withColumn("_pw_row", F.monotonically_increasing_id()))

    # A class is named by its first row.
    known = F.struct(F.col("_pw_id").isNull().alias("none"), F.col("_pw_id").alias("id"), *[F.col(c).alias("tie") for c in ties])
    chief = [F.min(known).alias("_pw_chief") for _ in ties]
    grouped = rows.where("_pw_n > 0").groupBy("_pw_hi", "_pw_lo")
    classes = grouped.agg(F.min(F.struct("_pw_row", "_pw_key")).alias("_pw_named"), F.min("_pw_id").alias("_pw_least"), F.count(F.lit(1)).alias("_pw_rows"), *chief)
    classes = written(classes.withColumns({"_pw_class": F.col("_pw_named._pw_row"), "_pw_key": F.col("_pw_named._pw_key")}).drop("_pw_named"))
    heads = written(_of_classes(rows.select(F.col("_pw_row").alias("_pw_class"), "_pw_n", "_pw_tokens"), classes))
    able = _sharing_first(heads, percent)
    released(docs.sparkSession)

    # Only the classes left have their texts read again, for all their shingles; copies of a text are read once.
    wanted = _of_classes(classes, able).select("_pw_class", "_pw_key", F.col("_pw_hi").alias("_pw_hi_of"), F.col("_pw_lo").alias("_pw_lo_of"))
    again = texts.select("_pw_key", "_pw_text").join(_sent_if_few(wanted), "_pw_key").drop("_pw_key").distinct()
    again = again.select("_pw_class", "_pw_hi_of", "_pw_lo_of", "_pw_text").mapInArrow(_shingled(size, None), f"_pw_class long, _pw_hi_of long, _pw_lo_of long, {_MADE}")
    whole = written(again.where("_pw_hi = _pw_hi_of and _pw_lo = _pw_lo_of").select("_pw_class", "_pw_n", "_pw_tokens"))
    sets = _sharing(whole, percent)
    released(docs.sparkSession)
    roots = _class_roots(sets, percent)
    released(docs.sparkSession)

    least = classes.join(roots, "_pw_class", "left").withColumn("_pw_root", F.coalesce("_pw_root", "_pw_class"))
    chief = [F.min("_pw_chief").alias("_pw_chief") for _ in ties]
    by_root = written(least.groupBy("_pw_root").agg(F.min("_pw_least").alias("component_id"), F.count(F.lit(1)).alias("_pw_members"), *chief))
    named = joined_by_key(least.select("_pw_hi", "_pw_lo", "_pw_rows", "_pw_root"), by_root, "_pw_root", "_pw_members").drop("_pw_root", "_pw_members")
    first = [F.coalesce(F.col("_pw_chief") == known, F.lit(True)).alias("_pw_first") for _ in ties]
    out = joined_by_key(rows.drop("_pw_tokens", "_pw_row", "_pw_key"), written(named), ["_pw_hi", "_pw_lo"], "_pw_rows", how="left")
    return out.select(
        F.col("_pw_id").alias(id_col), F.col("_pw_n").alias("n_shingles"), F.coalesce("component_id", "_pw_id").alias("component_id"),
        *[F.col(c).alias(tie_col) for c in ties], *first,
    )


def _roots(links: DataFrame) -> DataFrame:
    return written(components(links).withColumnsRenamed({"node": "_pw_class", "root": "_pw_root"}))


def _class_roots(sets: DataFrame, percent: int) -> DataFrame:
    """(class, root) of the components of all links; classes without links don't appear."""
    n, shared = F.col("_pw_n"), F.col("_pw_shared")
    lone = n - shared  # shingles that nobody shares stand first by frequency
    prefix = F.slice("_pw_tokens", F.lit(1), (n - _least_overlap(n, percent) + 1 - lone).cast("int"))
    places = sets.select("_pw_class", "_pw_n", "_pw_shared", F.posexplode(prefix).alias("_pw_nth", "_pw_token"))
    places = written(places.withColumn("_pw_at", lone + F.col("_pw_nth") + 1).drop("_pw_nth"))
    me = F.struct((n - shared).alias("lone"), F.col("_pw_class").alias("c"), n.alias("n"), shared.alias("s"))
    centre = written(places.groupBy("_pw_token").agg(F.min(me).alias("_pw_centre"), F.count(F.lit(1)).alias("_pw_members")).where("_pw_members > 1"))
    met = joined_by_key(places, centre, "_pw_token", "_pw_members").where(F.col("_pw_centre.c") != F.col("_pw_class"))
    met = met.where(_can_link(n, shared, F.col("_pw_centre.n"), F.col("_pw_centre.s"), percent))
    ordered = [F.least("_pw_class", "_pw_centre.c").alias("a"), F.greatest("_pw_class", "_pw_centre.c").alias("b")]
    first = written(_links(met.select(*ordered).distinct(), sets, percent))

    roots = _roots(first)
    labelled = written(places.join(roots, "_pw_class", "left").withColumn("_pw_root", F.coalesce("_pw_root", "_pw_class")))
    common = (
        labelled.groupBy("_pw_token", "_pw_root")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("_pw_token")
        .agg(F.max_by("_pw_root", F.struct("n", "_pw_root")).alias("_pw_common"), F.count(F.lit(1)).alias("_pw_roots"), F.sum("n").alias("_pw_members"))
        .where("_pw_roots > 1")
    )
    # A shingle's group is split into parts of bounded size, which the classes outside its most frequent component all meet.
    mixed = joined_by_key(labelled, written(common), "_pw_token", "_pw_members").withColumn("_pw_parts", F.ceil(F.col("_pw_members") / _GROUP))
    mixed = written(mixed.withColumn("_pw_part", F.pmod(F.xxhash64("_pw_class"), F.col("_pw_parts"))))
    few = mixed.where("_pw_root <> _pw_common").select(
        "_pw_token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pw_parts") - 1)).alias("_pw_part"),
        F.col("_pw_class").alias("c"), F.col("_pw_n").alias("n"), F.col("_pw_shared").alias("s"), F.col("_pw_root").alias("r"), F.col("_pw_at").alias("at"),
    )
    other = mixed.join(few, ["_pw_token", "_pw_part"]).where(F.col("r") != F.col("_pw_root"))
    # The first shingle that two sets share, under the order, has all the others behind it on both sides.
    left = 1 + F.least(n - F.col("_pw_at"), F.col("n") - F.col("at"))
    other = other.where((100 + percent) * left >= percent * (n + F.col("n")))
    other = other.where(_can_link(n, shared, F.col("n"), F.col("s"), percent))
    ordered = [F.least("_pw_class", "c").alias("a"), F.greatest("_pw_class", "c").alias("b")]
    more = written(_links(other.select(*ordered).distinct(), sets, percent))
    if more.isEmpty():
        return roots
    # The components found are single nodes from here on.
    named = [roots.select(F.col("_pw_class").alias(x), F.col("_pw_root").alias(f"root_{x}")) for x in ("a", "b")]
    between = more.join(named[0], "a", "left").join(named[1], "b", "left")
    upper = _roots(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = upper.select(F.col("_pw_class").alias("_pw_root"), F.col("_pw_root").alias("_pw_upper"))
    below = roots.join(_sent_if_few(moved), "_pw_root", "left")
    below = below.select("_pw_class", F.coalesce("_pw_upper", "_pw_root").alias("_pw_root"))
    return below.unionByName(upper.join(roots.select("_pw_class"), "_pw_class", "left_anti"))

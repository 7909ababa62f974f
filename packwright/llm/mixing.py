"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's words are cut into blocks by a hash of the document. A source's target is met by whole passes over
its blocks and one partial pass, which takes permuted blocks from the front and cuts inside the block
where the target falls. The drawn blocks are then divided among output shards: at every node of a binary tree a
random half of the node's blocks goes left, so the counts of each source follow the multivariate
hypergeometric law and every quota stays exact. Documents follow their blocks and are shuffled inside their shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.common import plain_words, released, written


def _draw(*parts: Column | str, seed: int) -> Column:
    """A uniform number below 2**52 from a digest, the same in every run and in other SQL engines."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(_pw_source, source_size, target) from (_pw_source, source_size): repeating weights by rank, excess reshared.

    Sources stand in code point order, null last. Where a source would pass ``most`` times its size it stops
    there, and the rest is shared among the others by weight: with sources ordered by most * size / weight, the
    level of the first source that needn't stop is the level of all that don't.
    """
    place = Window.orderBy(F.col("_pw_source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_pw_rank", F.row_number().over(place) - 1)
    rows = rows.withColumn("_pw_weight", F.get(kinds, F.col("_pw_rank") % len(weights)))
    rows = rows.withColumn("_pw_cap", F.col("source_size") * most).withColumn("_pw_ratio", F.col("_pw_cap") / F.col("_pw_weight"))
    up = Window.orderBy("_pw_ratio", "_pw_rank")
    before, after, every = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    total = F.sum("source_size").over(every) * share
    level = (total - F.coalesce(F.sum("_pw_cap").over(before), F.lit(0.0))) / F.sum("_pw_weight").over(after)
    rows = rows.withColumn("_pw_level", level).withColumn("_pw_free", F.col("_pw_level") <= F.col("_pw_ratio"))
    chosen = F.min(F.when(F.col("_pw_free"), F.struct("_pw_ratio", "_pw_rank", "_pw_level"))).over(every)["_pw_level"]
    target = F.least(F.col("_pw_cap"), F.coalesce(chosen * F.col("_pw_weight"), F.col("_pw_cap")))
    return rows.select("_pw_source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def _same_source(left: DataFrame, right: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """left with right's columns by source (null meets null) and further equal columns."""
    names = {c: f"{c}_r" for c in ("_pw_source", *extra)}
    right = right.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()])
    return left.join(right, on, "left").drop(*names.values())


def drawn_words(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 200_000,
    most_blocks: int = 4096,
    seed: int = 17,
) -> DataFrame:
    """One row per document row: id, size, source_size, target, taken, and how the words are drawn.

    taken is the number of words the mix takes, repeats counted: size for every whole pass (_pw_passes) and in
    the partial pass size, part of it (one document a source) or nothing (_pw_partial). A source's words sum to
    its target rounded down. Null and empty texts have size 0 and are taken 0 times; null sources are one source;
    repeated rows each count; very long texts are one row, whose part may be taken; draws that tie are ordered by id,
    size and hash of the text; an empty table gives no rows; other columns are not read, whatever their names. A source has at most ``most_blocks`` blocks, which grow with it; only the block
    where the target falls is ordered by document. Texts are read once; all else runs on a narrow table.
    """
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("_pw_id"),
            F.col(source_col).cast("string").alias("_pw_source"),
            F.size(plain_words(F.col(text_col))).cast("long").alias("size"),
            F.xxhash64(text_col).alias("_pw_key"),
            _draw(ident, "document", seed=seed).alias("_pw_draw"),
        )
    )
    sizes = rows.groupBy("_pw_source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    count = F.least(F.lit(most_blocks), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))).cast("long")
    targets = targets.withColumn("_pw_blocks", count)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_pw_passes", whole)
    targets = targets.withColumn("_pw_rest", F.floor("target").cast("long") - F.col("_pw_passes") * F.col("source_size"))
    rows = written(_same_source(rows, targets).withColumn("_pw_block", F.col("_pw_draw") % F.col("_pw_blocks")))

    blocks = rows.groupBy("_pw_source", "_pw_block").agg(F.sum("size").alias("_pw_words"), F.first("_pw_rest").alias("_pw_rest"))
    permuted = Window.partitionBy("_pw_source").orderBy(
        _draw(F.coalesce("_pw_source", F.lit("")), F.col("_pw_block").cast("string"), "permuted", seed=seed), "_pw_block"
    )
    blocks = blocks.withColumn("_pw_before", F.sum("_pw_words").over(permuted) - F.col("_pw_words"))
    left = F.greatest(F.least(F.col("_pw_rest") - F.col("_pw_before"), F.col("_pw_words")), F.lit(0))
    blocks = written(blocks.select("_pw_source", "_pw_block", "_pw_words", left.alias("_pw_left")))  # both parts below join it
    rows = _same_source(rows, blocks, ("_pw_block",))

    # Blocks are drawn whole or not at all, but for the one in each source where the target falls.
    cut = (F.col("_pw_left") > 0) & (F.col("_pw_left") < F.col("_pw_words"))
    inside = Window.partitionBy("_pw_source", "_pw_block").orderBy("_pw_draw", "_pw_id", "size", "_pw_key")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    sure = rows.where(~cut).withColumn("_pw_partial", F.when(F.col("_pw_left") > 0, F.col("size")).otherwise(0))
    split = rows.where(cut).withColumn("_pw_before", F.sum("size").over(upto) - F.col("size"))
    part = F.greatest(F.least(F.col("_pw_left") - F.col("_pw_before"), F.col("size")), F.lit(0))
    drawn = sure.unionByName(split.withColumn("_pw_partial", part).drop("_pw_before"))
    taken = F.col("_pw_passes") * F.col("size") + F.col("_pw_partial")
    return drawn.select(
        F.col("_pw_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"),
        "_pw_key", "_pw_source", "_pw_block", "_pw_passes", "_pw_partial",
    )


def output_shards(drawn: DataFrame, depth: int = 3, seed: int = 17) -> DataFrame:
    """(_pw_source, _pw_block, _pw_copy, shard): the splitting tree over the drawn blocks.

    There are 2**depth shards. At every node the blocks, in the order of a fresh draw, are halved: the left
    half's counts by source are one multivariate-hypergeometric draw, and the halves' quotas add up exactly.
    Where the halves meet is found from counts of draws in 2**14 ranges; only blocks of the range that holds it are
    ordered, so no node is one task. A table without words has no blocks.
    """
    first = drawn.where(F.col("_pw_partial") > 0).select("_pw_source", "_pw_block", F.col("_pw_passes").alias("_pw_copy")).distinct()
    whole = drawn.where(F.col("_pw_passes") > 0).select("_pw_source", "_pw_block", "_pw_passes").distinct()
    passes = F.sequence(F.lit(0).cast("long"), F.col("_pw_passes") - 1)
    whole = whole.select("_pw_source", "_pw_block", F.explode(passes).alias("_pw_copy"))
    blocks = whole.unionByName(first.select("_pw_source", "_pw_block", F.col("_pw_copy").cast("long").alias("_pw_copy"))).withColumn("shard", F.lit(0))
    for level in range(depth):
        name = [F.coalesce("_pw_source", F.lit("")), *[F.col(c).cast("string") for c in ("_pw_block", "_pw_copy")]]
        blocks = written(blocks.withColumn("_pw_at", _draw(*name, f"level {level}", seed=seed)).withColumn("_pw_range", F.shiftright("_pw_at", 38)))
        counts = blocks.groupBy("shard", "_pw_range").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("shard").orderBy("_pw_range"))
        left = F.floor((F.sum("n").over(Window.partitionBy("shard")) + 1) / 2)
        counts = written(counts.select("shard", "_pw_range", (left - upto + F.col("n")).alias("_pw_stay"), "n"))  # at most 2**14 rows a node
        blocks = blocks.join(counts, ["shard", "_pw_range"])
        order = Window.partitionBy("shard", "_pw_range").orderBy("_pw_at", *name)
        inside = (F.col("_pw_stay") > 0) & (F.col("_pw_stay") < F.col("n"))
        sure = blocks.where(~inside).withColumn("_pw_right", (F.col("_pw_stay") <= 0).cast("int"))
        split = blocks.where(inside).withColumn("_pw_right", (F.row_number().over(order) > F.col("_pw_stay")).cast("int"))
        blocks = sure.unionByName(split).select("_pw_source", "_pw_block", "_pw_copy", (F.col("shard") * 2 + F.col("_pw_right")).alias("shard"))
        released(drawn.sparkSession)
    return blocks


def placed_words(docs: DataFrame, *, depth: int = 3, seed: int = 17, **options) -> DataFrame:
    """The rows of drawn_words, taken counted from the block copies that the splitting tree hands out, and their shards.

    A document takes its words once for every copy of its block that an output shard has got; shards are those that
    hold words of it, sorted. The tree's table is written once and has a row for each block copy only.
    """
    drawn = written(drawn_words(docs, seed=seed, **options)).drop("taken")
    released(docs.sparkSession)
    shards = written(output_shards(drawn, depth, seed))
    released(docs.sparkSession)
    place = F.struct(F.col("_pw_copy").alias("copy"), F.col("shard").alias("shard"))
    places = shards.groupBy("_pw_source", "_pw_block").agg(F.collect_list(place).alias("_pw_places"))
    rows = _same_source(drawn, places, ("_pw_block",))
    each = F.transform(
        F.coalesce("_pw_places", F.array().cast("array<struct<copy:bigint,shard:int>>")),
        lambda p: F.struct(p["shard"].alias("shard"), F.when(p["copy"] < F.col("_pw_passes"), F.col("size")).otherwise(F.col("_pw_partial")).cast("long").alias("words")),
    )
    rows = rows.withColumn("_pw_each", F.filter(each, lambda p: p["words"] > 0)).drop("_pw_places")
    taken = F.aggregate("_pw_each", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return rows.withColumn("taken", taken).withColumn("shards", F.array_sort(F.array_distinct("_pw_each.shard"))).drop("_pw_each")


def mixture(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", depth: int = 3, seed: int = 17, **options) -> DataFrame:
    """One row for every time a document enters the mix: docs' columns, copy, words, shard and place.

    words is the document's size, or for the last document of a source's partial pass how many of its leading
    words are taken. place is the random order inside the shard. Columns of docs with these names give way. Texts that
    are null, empty or not drawn do not come; repeated rows are drawn one by one, ties by id, size and hash of the
    text; very long texts are taken whole but for a partial pass's last; an empty table gives no rows.
    """
    drawn = written(drawn_words(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options))
    shards = output_shards(drawn, depth, seed)
    copies = F.when(F.col("_pw_partial") > 0, F.col("_pw_passes")).otherwise(F.col("_pw_passes") - 1)
    row = ("_pw_id", "_pw_source", "_pw_key")
    nth = F.row_number().over(Window.partitionBy(*row).orderBy(F.lit(0)))  # repeated rows are alike
    each = drawn.withColumnRenamed(id_col, "_pw_id").withColumn("_pw_nth", nth).where("taken > 0")
    each = each.withColumn("_pw_copy", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long"))))
    words = F.when(F.col("_pw_copy") < F.col("_pw_passes"), F.col("size")).otherwise(F.col("_pw_partial"))
    each = _same_source(each.withColumn("_pw_taken", words), shards.withColumnRenamed("shard", "_pw_shard"), ("_pw_block", "_pw_copy"))
    place = _draw(F.coalesce(F.col("_pw_id").cast("string"), F.lit("")), F.col("_pw_copy").cast("string"), "place", seed=seed)
    each = each.select(*row, "_pw_nth", "_pw_copy", "_pw_taken", "_pw_shard", place.alias("_pw_place"))
    own = [c for c in docs.columns if c not in ("copy", "words", "shard", "place")]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(id_col).alias("_pw_id"), F.col(source_col).cast("string").alias("_pw_source"), F.xxhash64(text_col).alias("_pw_key"))
    rows = rows.withColumn("_pw_nth", nth).withColumnsRenamed({c: f"{c}_d" for c in (*row, "_pw_nth")})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}_d")) for c in (*row, "_pw_nth")])
    placed = rows.join(each, same).select(
        *[F.col(f"`{c}`") for c in own], F.col("_pw_copy").alias("copy"), F.col("_pw_taken").alias("words"),
        F.col("_pw_shard").alias("shard"), F.col("_pw_place").alias("place"),
    )
    return placed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")

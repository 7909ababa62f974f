"""Exact top-k inner products with a KD-tree per shard.

Vectors are dealt to cells, the leaves of median splits over a bounded sample, and a cell's to shards of bounded size by
a hash. A shard's tree halves its rows at the median of the widest side until leaves are small; every node keeps a
tight box. A query takes the node with the greatest possible inner product next (from the box's corners) and stops when
that falls below its kth score. The first round searches each query's own shard; the kth score found there goes along,
and only cells whose box can reach it are searched in the second.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.common import drawn, written


class Tree:
    """Boxes and leaves over integer vectors: float64 while inner products stay below 2**53, else Python integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None, leaf: int = 256):
        self.ids, self.vectors, self.number = ids, vectors, ids if rows is None else rows
        self.low, self.high, self.left, self.rows = [], [], [], []
        self._add(np.arange(len(ids)))
        todo = [0]
        while todo:
            node = todo.pop()
            rows = self.rows[node]
            side = int(np.argmax(self.high[node] - self.low[node])) if vectors.shape[1] else 0
            if len(rows) <= leaf or not vectors.shape[1] or self.high[node][side] == self.low[node][side]:
                continue
            order = np.argpartition(vectors[rows, side], len(rows) // 2)
            self.left[node] = len(self.rows)
            self._add(rows[order[: len(rows) // 2]])
            self._add(rows[order[len(rows) // 2 :]])
            todo += [self.left[node], self.left[node] + 1]
            self.rows[node] = rows[:0]

    def _add(self, rows: np.ndarray) -> None:
        own = self.vectors[rows]
        self.low.append(own.min(axis=0) if len(rows) else np.zeros(self.vectors.shape[1]))
        self.high.append(own.max(axis=0) if len(rows) else np.zeros(self.vectors.shape[1]))
        self.left.append(-1)
        self.rows.append(rows)

    def search(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[int, int]]:
        """The best (score, id) of at least floor, ties to the smaller id; the row number own takes no part."""
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        best: list[tuple[int, int]] = []  # a heap whose first is the worst: (score, -id)
        count = itertools.count()
        heap = [(-np.inf, next(count), 0)]
        while heap:
            bound, _, node = heapq.heappop(heap)
            if -bound < (max(floor, best[0][0]) if len(best) == k else floor):
                break
            if self.left[node] < 0:
                rows = self.rows[node]
                scores = self.vectors[rows] @ query
                least = max(floor, best[0][0]) if len(best) == k else floor
                for j in np.flatnonzero(scores >= least):
                    if self.number[rows[j]] == own:
                        continue
                    item = (int(scores[j]), -int(self.ids[rows[j]]))
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            else:
                for child in (self.left[node], self.left[node] + 1):
                    far = up @ self.high[child] + down @ self.low[child]
                    heapq.heappush(heap, (-far, next(count), child))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


class Cells:
    """Median splits of a sample's widest sides, down to at most ``most`` leaves: the cell of any vector."""

    def __init__(self, sample: np.ndarray, most: int):
        self.side, self.at, self.child = [], [], []
        leaves = [(self._node(), sample)]
        while leaves and len(self.side) + 1 < 2 * most:
            node, rows = leaves.pop(0)
            span = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 and rows.shape[1] else np.zeros(1)
            side = int(np.argmax(span))
            if not span[side] > 0:
                continue
            at = float(np.median(rows[:, side]))
            right = rows[:, side] >= at
            if right.all():
                at = float(rows[:, side][rows[:, side] > at].min())
                right = rows[:, side] >= at
            self.side[node], self.at[node] = side, at
            self.child[node] = self._node()
            leaves += [(self.child[node], rows[~right]), (self._node(), rows[right])]

    def _node(self) -> int:
        self.side.append(0)
        self.at.append(0.0)
        self.child.append(-1)
        return len(self.side) - 1

    def of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        side, at, child = np.array(self.side), np.array(self.at), np.array(self.child)
        while (inner := np.flatnonzero(child[node] >= 0)).size:
            here = node[inner]
            node[inner] = child[here] + (vectors[inner, side[here]] >= at[here])
        return node


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(col.flatten(), np.float64)
    return flat.reshape(len(col), -1) if len(col) and len(flat) else np.zeros((len(col), 0))


def _exact(vectors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float64 if no sum of their products can pass 2**53, else as Python integers."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    if most < 2**53:
        return vectors, queries
    whole = np.frompyfunc(int, 1, 1)
    return whole(vectors), whole(queries)


_FOUND = "query long, query_id long, vec_id long, score long, dim int, cell long, low array<double>, high array<double>"
_LIMIT = 2**63 - 1


def _searched(k: int, box: bool):
    """Rows found for the queries, and with ``box`` one row with the box of the vectors."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        own = _matrix(vectors.column("v"))
        if vectors.num_rows and queries.num_rows:
            held, asked = _exact(own, _matrix(queries.column("v")))
            tree = Tree(np.asarray(vectors.column("id")), held, np.asarray(vectors.column("row")))
            floors = queries.column("floor").to_pylist()
            for row, name, q, floor in zip(queries.column("row").to_pylist(), queries.column("id").to_pylist(), asked, floors, strict=True):
                for score, other in tree.search(q, row, k, -np.inf if floor is None or abs(floor) >= _LIMIT else floor):
                    for column, value in zip(out, (row, name, other, max(-_LIMIT, min(_LIMIT, score))), strict=True):
                        column.append(value)
        n = len(out[0])
        more: list[list] = [[None] * n for _ in range(4)]
        if box and vectors.num_rows:
            for column in out:
                column.append(None)
            first = vectors.slice(0, 1).to_pylist()[0]
            for column, value in zip(more, (first["dim"], first["cell"], own.min(axis=0).tolist(), own.max(axis=0).tolist()), strict=True):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.table([pa.array(x, t) for x, t in zip(out + more, kinds, strict=True)], [c.split()[0] for c in _FOUND.split(", ")])

    return run


def _dealt(cells: dict[int, Cells]):
    """Rows with their cell among those of their length."""

    def run(batches):
        for batch in batches:
            dim, v, cell = np.asarray(batch.column("dim")), batch.column("v"), np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dim):
                mine = np.flatnonzero(dim == d)
                if d in cells and d:
                    cell[mine] = cells[d].of(_matrix(v.take(pa.array(mine))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


def _within_reach(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """(query row, cells) whose box can reach the query's floor; a margin covers rounding."""

    def run(batches):
        for batch in batches:
            floors, dims, found = batch.column("floor").to_pylist(), batch.column("dim").to_pylist(), []
            for i in range(batch.num_rows):
                if dims[i] not in boxes:
                    found.append([0])  # vectors without components have one cell
                    continue
                names, low, high = boxes[dims[i]]
                q = _matrix(batch.column("v").slice(i, 1))[0]
                with np.errstate(over="ignore", invalid="ignore"):
                    far = np.maximum(low * q, high * q).sum(axis=1)
                    far += 1e-9 * np.maximum(np.abs(low * q), np.abs(high * q)).sum(axis=1) + 1
                least = -np.inf if floors[i] is None or abs(floors[i]) >= _LIMIT else floors[i]
                found.append(names[~(far < least)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int64()))], ["row", "cells"])

    return run


def top_inner_products(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    every: int = 50,
    k: int = 5,
    shard_rows: int = 8192,
    block_rows: int = 4096,
    most_cells: int = 1024,
    sample_rows: int = 16_384,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best integer inner products of each query, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own, other rows
    of its id included, so repeated rows are found and each asks. Components become floor(scale * x). Null ids and
    vectors that are null or hold null or non-finite components take no part; vectors only meet vectors of their
    length; a query without candidates has no rows, nor has an empty table; other columns are not read, whatever
    their names. Scores are exact; those outside a long's range are given, and ranked among themselves by id, as its
    limits. At most ``most_cells`` cells of each length are split on at most sample_rows vectors of it; how many
    shards a cell has depends on its rows.
    """
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    huge = F.lit(1.7e308)
    whole = F.transform(F.col(vector_col), lambda x: _floor(F.greatest(-huge, F.least(huge, x.cast("double") * scale))))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(good)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.size(vector_col).alias("dim"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    n_of = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of vectors
    cells = {}
    for d, n in n_of.items():
        mine = rows.where(F.col("dim") == d)
        some = mine.where(drawn(F.xxhash64("row"), n, sample_rows // 8)).limit(sample_rows).select("v").collect()
        if some and d:
            cells[d] = Cells(np.array([r["v"] for r in some], np.float64), min(most_cells, -(-n // shard_rows)))
    rows = rows.mapInArrow(_dealt(cells), "id long, v array<double>, dim int, row long, cell long")
    sizes = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    rows = rows.join(F.broadcast(sizes), ["dim", "cell"])  # at most most_cells rows for each length
    rows = written(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")))
    is_query = F.col("id") % every == 0
    n_queries = rows.where(is_query).count()
    blocks = max(1, -(-n_queries // block_rows))
    queries = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int"))

    # New column identities: a table meets itself in both searches.
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    home = ["dim", "cell", "shard"]
    first = rows.groupBy(*home).cogroup(queries.withColumn("floor", F.lit(None).cast("long")).groupBy(*home))
    first = written(first.applyInArrow(_searched(k, True), _FOUND))
    boxes = _cell_boxes(first)
    found = first.where("query is not null").select("query", "query_id", "vec_id", "score")
    floors = found.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    asked = written(queries.join(floors, "row", "left").withColumnRenamed("shard", "own").withColumnRenamed("cell", "home").drop("shards"))
    near = asked.select("row", "dim", "v", "floor").mapInArrow(_within_reach(boxes), "row long, cells array<long>")
    near = near.select("row", F.explode("cells").alias("cell")).join(asked, "row").join(F.broadcast(sizes), ["dim", "cell"])
    near = near.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("cell <> home or shard <> own")
    near = near.select(*[F.col(c).alias(c) for c in ("id", "v", "row", "dim", "cell", "shard", "block", "floor")])
    held = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = [*home, "block"]
    rest = held.groupBy(*pair).cogroup(near.groupBy(*pair)).applyInArrow(_searched(k, False), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    every_one = found.unionByName(rest.select("query", "query_id", "vec_id", "score"))
    return every_one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _floor(x: Column) -> Column:
    """The floor of a double as a double, also where it passes a long's range."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _cell_boxes(first: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length (cells, low, high); the cells' number is bounded, whatever the shards'."""
    sides = first.where("low is not null").select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "s"))
    sides = sides.groupBy("dim", "cell", "i").agg(F.min("s.low").alias("low"), F.max("s.high").alias("high"))
    sides = sides.groupBy("dim", "cell").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("s"))
    of: dict[int, list] = {}
    for r in sides.select("dim", "cell", F.col("s.low").alias("low"), F.col("s.high").alias("high")).collect():
        of.setdefault(r["dim"], []).append(r)
    return {d: (np.array([r["cell"] for r in rs]), np.array([r["low"] for r in rs]), np.array([r["high"] for r in rs])) for d, rs in of.items()}

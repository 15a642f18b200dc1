"""Exact top-k inner products over KD-trees, one tree per shard.

Space is cut into cells by median splits of a bounded sample; the rows of a cell, all of them, are dealt to shards of about
SHARD rows. Each shard splits its vectors at medians into leaves with tight bounding boxes. A box bounds every inner product
with a query from above, so a best-first walk over the tree may stop at the first box below the query's k-th best score.
Shards are met in two waves: each query first meets the shard it lies in, which gives it a k-th score that holds for all rows,
and then those other shards whose whole box reaches that score. In either wave a row moves once, a shard's tree is built once,
and queries are streamed past it a block at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spellwise.llm.common import settle

#: Rows of a shard, and of a leaf of its tree.
SHARD = 8192
LEAF = 64
#: Queries that meet a shard at a time.
BLOCK = 512
#: Rows whose medians cut space, and cells at most.
SAMPLE, CELLS = 4096, 256
#: Numbers in the shards' boxes that go to every task; beyond, queries meet all shards.
BOXES = 8_000_000
#: Components beyond this once scaled can't be held as a long: they raise, as do scores that a long can't hold.
LIMIT = float(1 << 62)


class Tree:
    """KD-tree over integer vectors: `order` lists rows leaf by leaf, node i has children 2i + 1 and 2i + 2."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x, self.order = x, np.arange(n)
        self.span: dict[int, tuple[int, int]] = {}
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        todo = [(0, 0, n)]
        while todo:
            node, a, b = todo.pop()
            rows = x[self.order[a:b]]
            low, high = rows.min(axis=0, initial=1 << 60), rows.max(axis=0, initial=-(1 << 60))
            self.span[node], self.low[node], self.high[node] = (a, b), low, high
            if b - a <= LEAF or not (high > low).any():
                continue  # small, or copies of one vector: the box is tight however many
            axis = int(np.argmax(high - low))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], mid)]
            todo += [(2 * node + 1, a, a + mid), (2 * node + 2, a + mid, b)]
        self.nodes = sorted(self.span)
        self.place = {node: i for i, node in enumerate(self.nodes)}
        self.lows = np.array([self.low[i] for i in self.nodes], np.float64)
        self.highs = np.array([self.high[i] for i in self.nodes], np.float64)
        self.exact = x.astype(np.float64)  # integers below 2^53 stay exact
        self.most = int(np.abs(x).max(initial=0)) * x.shape[1]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Greatest inner product of each query with any point of each node's box."""
        return np.maximum(queries, 0) @ self.highs.T + np.minimum(queries, 0) @ self.lows.T


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
    """Per query the k best (score, id) of the tree that reach its `floor`, ties to the smaller id."""
    bounds = tree.bounds(queries.astype(np.float64))
    out = []
    for q in range(len(queries)):
        bound, query = bounds[q], queries[q].astype(np.float64)
        large = tree.most * int(np.abs(queries[q]).max(initial=0)) >= 1 << 53
        if large:  # scores in Python's integers, boxes with room for rounding
            whole = queries[q].astype(object)
            bound = bound + (tree.highs.shape[1] + 2) * 2.0**-51 * float(tree.most) * float(np.abs(query).max())
        best: list[tuple[int, int]] = []  # (score, -id), least first
        kth = int(floor[q])
        heap = [(-bound[0], 0)]
        while heap:
            up, node = heapq.heappop(heap)
            if -up < kth:
                break
            left = 2 * node + 1
            if left in tree.span:
                for child in (left, left + 1):
                    b = bound[tree.place[child]]
                    if b >= kth:
                        heapq.heappush(heap, (-b, child))
                continue
            rows = tree.order[slice(*tree.span[node])]
            scores = tree.x[rows].astype(object) @ whole if large else tree.exact[rows] @ query
            if large and any(abs(x) >= 1 << 63 for x in scores):
                raise OverflowError("a score is too large for a long")
            good = np.flatnonzero((scores >= kth) & (ids[rows] != own[q]))
            if len(good) > k:  # the k best with ties to smaller ids
                good = good[np.array(sorted(range(len(good)), key=lambda i: (-scores[good[i]], ids[rows[good[i]]])))[:k] if large else np.lexsort((ids[rows[good]], -scores[good]))[:k]]
            for i in good.tolist():
                item = (int(scores[i]), -int(ids[rows[i]]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        out.append(best)
    return out


def splits(sample: np.ndarray, cells: int) -> list[tuple[int, int] | None]:
    """Median splits (axis, value) of a sample, node i with children 2i + 1 and 2i + 2, for `cells` (a power of two) cells: up to
    the value goes left. A part without spread is not split further."""
    out: list[tuple[int, int] | None] = [None] * (cells - 1)
    parts = {0: sample}
    for node in range(cells - 1):
        x = parts.pop(node, None)
        if x is None or len(x) < 2:
            continue
        spread = x.max(axis=0) - x.min(axis=0)
        axis = int(np.argmax(spread))
        if not spread[axis]:
            continue
        value = int(np.sort(x[:, axis])[(len(x) - 1) // 2])
        if value == x[:, axis].max():
            value -= 1  # the upper half is one value: it goes right
        left = x[:, axis] <= value
        out[node] = (axis, value)
        parts[2 * node + 1], parts[2 * node + 2] = x[left], x[~left]
    return out


def cell_column(tree: list[tuple[int, int] | None], v: Column) -> Column:
    """The cell that a vector lies in: the node that its way down the splits ends at."""

    def below(node: int) -> Column:
        if node >= len(tree) or tree[node] is None:
            return F.lit(node)
        axis, value = tree[node]
        return F.when(v[axis] <= value, below(2 * node + 1)).otherwise(below(2 * node + 2))

    return below(0)


def _numbers(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), n)


KEY = ["n", "cell", "sub"]


def _box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (low, high) per shard of the boxes that come in."""
    have: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        low, high = batch.column("low"), batch.column("high")
        keys = list(zip(*(batch.column(c).to_pylist() for c in KEY)))
        rows: dict[tuple, list[int]] = {}
        for i, key in enumerate(keys):
            rows.setdefault(key, []).append(i)
        for key, at in rows.items():
            at = pa.array(at)
            least, most = _numbers(low.take(at), key[0]).min(axis=0), _numbers(high.take(at), key[0]).max(axis=0)
            old = have.get(key)
            have[key] = (np.minimum(old[0], least), np.maximum(old[1], most)) if old else (least, most)
    yield pa.RecordBatch.from_pydict(
        {c: [k[i] for k in have] for i, c in enumerate(KEY)} | {"low": [b[0].tolist() for b in have.values()], "high": [b[1].tolist() for b in have.values()]},
        pa.schema([*((c, pa.int32()) for c in KEY), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))]),
    )


BOX = "n int, cell int, sub int, low array<long>, high array<long>"


def _reached(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Queries (with their home shard and floor) to one row per other shard whose box reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n").to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == n))
                keys, low, high = boxes[n]
                for i in range(0, part.num_rows, BLOCK):
                    some = part.slice(i, BLOCK)
                    q = _numbers(some.column("v"), n).astype(np.float64)
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    room = (np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T) * 1e-12 + 1
                    floor = some.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                    home = np.stack([some.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "sub")], axis=1)
                    meets = (bound + room >= floor[:, None]) & (keys[None] != home[:, None]).any(axis=2)
                    row, shard = np.nonzero(meets)
                    out = some.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [out.column("n"), pa.array(keys[shard, 0].astype(np.int32)), pa.array(keys[shard, 1].astype(np.int32)), out.column("vec_id"), out.column("v"), out.column("floor")],
                        ["n", "cell", "sub", "vec_id", "v", "floor"],
                    )

    return run


def _searcher(k: int):
    """Rows shard by shard, a shard's own vectors first, then the queries that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, ids = None, None, None
        own: list[pa.RecordBatch] = []

        def answered(part: pa.RecordBatch) -> pa.RecordBatch:
            asked, floor = part.column("vec_id").to_numpy(), part.column("floor").to_numpy()
            best = search(tree, ids, _numbers(part.column("v"), key[0]), asked, floor, k)
            found = [(q, -minus, score) for q, items in zip(asked.tolist(), best) for score, minus in items]
            columns = list(zip(*found)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            names = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*KEY, "kind")], axis=1)
            ends = np.append(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, len(names))
            for a, b in zip(np.append(0, ends[:-1]), ends):
                if a == b:
                    continue
                *now, kind = names[a].tolist()
                if now != key:
                    key, tree, own = now, None, []
                part = batch.slice(a, b - a)
                if kind == 0:
                    own.append(part)
                    continue
                if tree is None and own:
                    rows = pa.Table.from_batches(own)
                    ids = rows.column("vec_id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    ids = ids[order]
                    tree, own = Tree(_numbers(rows.column("v").combine_chunks(), key[0])[order]), []
                if tree is not None:
                    for i in range(0, part.num_rows, BLOCK):
                        yield answered(part.slice(i, BLOCK))

    return run


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where `is_query` holds, the k rows with other ids whose
    vectors floor(scale * x) have the greatest inner product with its own; ties to the smaller id.

    Null ids, null vectors and vectors with a null or non-finite component take no part; a component or score that a long
    can't hold raises; vectors meet those of their own length only; a repeated query row gives repeated results, a repeated
    candidate row counts each time; other columns are not read.
    """
    far = lambda c: F.abs(c.cast("double") * scale) > LIMIT
    x = F.transform(F.col(vector_col), lambda c: F.when(far(c), F.raise_error(F.lit("a component is too large")).cast("bigint")).otherwise(F.floor(c.cast("double") * scale)))
    fit = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    slim = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fit, x).alias("v"), is_query.alias("q"))
    slim = slim.where("vec_id is not null and v is not null").withColumn("n", F.size("v"))
    # cells by space for vectors of the usual length; others have one cell
    lengths = slim.groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    usual, many = (lengths[0]["n"], lengths[0]["count"]) if lengths else (0, 0)
    sample = slim.where(F.col("n") == usual).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").collect() if usual else []
    cells = min(CELLS, 1 << max(0, (many // SHARD).bit_length()))
    tree = splits(np.array([r["v"] for r in sample], np.int64).reshape(len(sample), usual), cells)
    cell = F.when(F.col("n") == usual, cell_column(tree, F.col("v"))).otherwise(-1) if usual else F.lit(-1)
    slim = slim.withColumn("cell", cell.cast("int"))
    # a cell of many rows is several shards; ids spread copies and neighbours evenly over them
    per = slim.groupBy("n", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("subs"))
    sub = F.pmod(F.xxhash64("vec_id", "v"), F.col("subs")).cast("int").alias("sub")
    placed = settle(slim.join(per, ["n", "cell"]).select(*KEY[:2], sub, "vec_id", "v", "q"))
    queries = settle(placed.where("q").select(*KEY, "vec_id", "v").distinct())
    none = F.lit(-(1 << 63))
    first = settle(_meet(placed, queries.withColumn("floor", none), k))
    # the k-th score of the first wave bounds every later one from below
    worst = first.groupBy("query_id").agg(F.count("*").alias("have"), F.min("score").alias("low")).where(F.col("have") >= k)
    asked = queries.join(worst.select(F.col("query_id").alias("w"), "low"), F.col("vec_id") == F.col("w"), "left")
    asked = asked.select(*KEY, "vec_id", "v", F.coalesce("low", none).alias("floor"))
    boxes = placed.select(*KEY, F.col("v").alias("low"), F.col("v").alias("high")).mapInArrow(_box, BOX)
    boxes = settle(boxes.repartition(*KEY).mapInArrow(_box, BOX))
    if (boxes.agg(F.sum(F.col("n") * 2)).first()[0] or 0) <= BOXES:
        known: dict[int, list] = {}
        for r in boxes.collect():
            known.setdefault(r["n"], []).append(((r["cell"], r["sub"]), r["low"], r["high"]))
        arrays = {n: tuple(np.array(c, np.int64 if i == 0 else np.float64).reshape(len(b), -1) for i, c in enumerate(zip(*b))) for n, b in known.items()}
        asked = asked.mapInArrow(_reached(arrays), "n int, cell int, sub int, vec_id long, v array<long>, floor long")
    else:
        others = boxes.select(*[F.col(c).alias(f"b_{c}") for c in KEY])
        other = (F.col("cell") != F.col("b_cell")) | (F.col("sub") != F.col("b_sub"))
        asked = asked.join(others, (F.col("n") == F.col("b_n")) & other)
        asked = asked.select("n", F.col("b_cell").alias("cell"), F.col("b_sub").alias("sub"), "vec_id", "v", "floor")
    found = first.union(_meet(placed, asked, k))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    out = best.select("query_id", "rank", "vec_id", "score")
    # a repeated query row repeats its result
    again = placed.where("q").groupBy(F.col("vec_id").alias("query_id")).count().where("count > 1")
    return out.join(again, "query_id", "left").withColumn(
        "__i", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("count"), F.lit(1)).cast("int")))
    ).select("query_id", "rank", "vec_id", "score")


def _meet(placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of queries and the shards they are sent to."""
    columns = [*KEY, "kind", "vec_id", "v", "floor"]
    own = placed.select(*KEY, F.lit(0).alias("kind"), "vec_id", "v", F.lit(0).cast("long").alias("floor"))
    both = own.unionByName(asked.withColumn("kind", F.lit(1)).select(*columns)).select(*columns)
    both = both.repartition(*KEY).sortWithinPartitions(*KEY, "kind", "vec_id")
    return both.mapInArrow(_searcher(k), "query_id long, vec_id long, score long")

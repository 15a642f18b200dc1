"""Centroid clustering (Lloyd's rounds in integers) by equal-average equal-variance search.

The centroids lie in the order of their component sums. A vector starts at the place of its own sum and walks outward,
the nearer side first. With S the sum, V = n * sum(x^2) - S^2 and n components,

    n * distance >= (S_x - S_c)^2                                  (equal average)
    n * distance >= (S_x - S_c)^2 + (sqrt(V_x) - sqrt(V_c))^2      (equal variance)

so a centroid whose first bound is beyond the best distance ends the walk (all others lie farther out), one whose second
bound is beyond it is passed over, and only the rest get a distance, in exact integers. Bounds are taken with room for
rounding, and a tie goes to the smaller number, so the result equals a full search.

A round is one scan of the two columns it reads and a sum per centroid and component with map-side sums: nothing but the
centroids (k x n integers, whatever the number of rows) passes through the driver, and a cluster that holds a third of all
rows is summed where its rows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellwise.llm.common import settle

#: Components up to this have sums of squares within a long; larger ones are computed in Python's integers.
NARROW = 1 << 27
#: Room for rounding in the bounds, as a share of the numbers that are subtracted.
EPS = 1e-12


class Search:
    """Nearest of `centroids` (rows of integers) for many vectors at a time."""

    def __init__(self, centroids: np.ndarray):
        self.wide = bool(len(centroids)) and int(np.abs(centroids).max(initial=0)) > NARROW
        self.centroids = centroids
        self.n = centroids.shape[1]
        self.sums, self.dev = moments(centroids)
        self.order = np.argsort(self.sums, kind="stable")
        self.sorted_sums = self.sums[self.order]
        self.distances = 0  # full distances computed, for tests

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) per row of `x`."""
        rows, k = len(x), len(self.centroids)
        if self.wide or (rows and int(np.abs(x).max(initial=0)) > NARROW):
            x, centroids, kind = x.astype(object), self.centroids.astype(object), object
        else:
            centroids, kind = self.centroids, np.int64
        own, spread = moments(x)
        best = np.full(rows, -1, np.int64)
        least = np.zeros(rows, kind)
        right = np.searchsorted(self.sorted_sums, own).astype(np.int64)
        left = right - 1
        active = np.arange(rows)
        for _ in range(k):
            if not len(active):
                break
            lo, hi, s = left[active], right[active], own[active]
            gap_lo = np.where(lo >= 0, s - self.sorted_sums[np.maximum(lo, 0)], np.inf)
            gap_hi = np.where(hi < k, self.sorted_sums[np.minimum(hi, k - 1)] - s, np.inf)
            down = gap_lo <= gap_hi
            gap = np.where(down, gap_lo, gap_hi)
            bound = self.n * least[active].astype(np.float64) * (1 + EPS)
            fresh = best[active] < 0
            place = np.where(down, np.maximum(lo, 0), np.minimum(hi, k - 1))
            sure = np.maximum(gap - EPS * (np.abs(s) + np.abs(self.sorted_sums[place])), 0)
            walking = np.isfinite(gap) & (fresh | (sure * sure <= bound))
            active, down, sure, bound, fresh = active[walking], down[walking], sure[walking], bound[walking], fresh[walking]
            at = self.order[place[walking]]
            left[active] -= down
            right[active] += ~down
            apart = np.abs(spread[active] - self.dev[at]) - EPS * (spread[active] + self.dev[at])
            near = fresh | (sure * sure + np.maximum(apart, 0) ** 2 <= bound)
            row, c = active[near], at[near]
            gone = x[row] - centroids[c]
            d = (gone * gone).sum(axis=1)
            self.distances += len(row)
            better = (best[row] < 0) | (d < least[row]) | ((d == least[row]) & (c < best[row]))
            best[row[better]], least[row[better]] = c[better], d[better]
        return best, least


def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component sum and n times the standard deviation of each row, as doubles."""
    f = x.astype(np.float64)
    total = f.sum(axis=1)
    mean = total[:, None] / max(x.shape[1], 1)
    return total, np.sqrt(((f - mean) ** 2).sum(axis=1) * x.shape[1])


def _vectors(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(scale * flat).reshape(batch.num_rows, dims)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise OverflowError("a component is too large for a long")
    return scaled.astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _as_long(values, what: str) -> pa.Array:
    try:
        return pa.array([int(v) for v in values] if values.dtype == object else values, pa.int64())
    except (pa.ArrowInvalid, OverflowError) as e:
        raise OverflowError(f"{what} is too large for a long") from e


def _assign(centroids: np.ndarray, scale: int):
    def run(batches):
        search = Search(centroids)
        for batch in _slices(batches):
            which, d = search.nearest(_vectors(batch, centroids.shape[1], scale))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(which.astype(np.int32)), _as_long(d, "a distance")], ["id", "cluster", "distance"]
            )

    return run


def _sums(centroids: np.ndarray, scale: int):
    """Per task: (cluster, component, sum), with component -1 for the number of vectors."""

    def run(batches):
        k, dims = centroids.shape
        search = Search(centroids)
        total = np.zeros((k, dims + 1), object)
        for batch in _slices(batches):
            x = _vectors(batch, dims, scale)
            which, _ = search.nearest(x)
            part = np.zeros((k, dims + 1), np.int64 if np.abs(x).max(initial=0) <= 1 << 50 else object)
            np.add.at(part, which, np.column_stack([np.ones(len(x), np.int64), x]))
            total += part.astype(object)
        c, j = np.nonzero(np.broadcast_to(total[:, :1] > 0, total.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int32)), pa.array((j - 1).astype(np.int32)), _as_long(total[c, j], "a sum of components")],
            ["cluster", "component", "sum"],
        )

    return run


def seeds(kept: DataFrame, k: int, seed: str, dims: int, scale: int) -> np.ndarray:
    """The k vectors whose ids, as `seed:<id>`, have the smallest SHA-256; equal ids in the order of their vectors, null
    ids after all others. A top-k over all rows: every task sends k of them."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return np.zeros((0, dims), np.int64)
    return _vectors(pa.RecordBatch.from_pydict({"v": [list(r["v"]) for r in first]}), dims, scale)


def fit(kept: DataFrame, centroids: np.ndarray, rounds: int, scale: int) -> np.ndarray:
    """Centroids after `rounds` rounds of assignment and floored means (fewer only where a round changes nothing)."""
    for _ in range(rounds):
        if not len(centroids):
            break
        parts = kept.select("v").mapInArrow(_sums(centroids, scale), "cluster int, component int, sum long")
        rows = parts.groupBy("cluster", "component").agg(F.sum("sum").alias("sum")).collect()  # k * (dims + 1) at most
        count = {r["cluster"]: r["sum"] for r in rows if r["component"] < 0}
        new = centroids.copy()
        for r in rows:
            if r["component"] >= 0:
                new[r["cluster"], r["component"]] = r["sum"] // count[r["cluster"]]
        if (new == centroids).all():
            break
        centroids = new
    return centroids


def cluster(
    rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components are floor(scale * x). Null vectors, vectors of another length than `dims` and those with a null or non-finite
    component take no part; null ids do (never as a seed while there are others). Repeated rows count each, with fewer
    vectors than `k` there are as many centroids, an empty table gives no row, and ties go to the smaller number.
    Components, sums or distances that a long can't hold raise. Other columns are not read.
    """
    x = F.col(vector_col)
    fit_row = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = rows.where(x.isNotNull() & (F.size(x) == dims) & fit_row).select(F.col(id_col).alias("id"), x.alias("v"))
    centroids = fit(kept, seeds(kept, k, seed, dims, scale), rounds, scale)
    id_type = kept.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, cluster int, distance long"
    if not len(centroids):
        empty = rows.sparkSession.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
        return empty.withColumnRenamed("id", "vec_id")
    found = settle(kept.mapInArrow(_assign(centroids, scale), schema))
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    if total >= 1 << 63:
        raise OverflowError("the inertia is too large for a long")
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = F.array(*[  # one literal per centroid
        F.struct(F.lit(inertia.get(i, 0)).cast("long").alias("i"), F.lit(h).alias("h")) for i, h in enumerate(digest)
    ])
    own = F.element_at(facts, F.col("cluster") + 1)
    return found.select(
        F.col("id").alias("vec_id"), "cluster", "distance", own["i"].alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"), own["h"].alias("centroid_sha256"),
    )

"""Ordered operations that never put one whole group into one task.

A window ordered over a whole stratum (a sex, a very active person) would be sorted by a
single task. Every operator here works in two levels instead: rows are windowed
inside ``(group, cell)``, where a cell is a slice of the ordering axis (a quarter of
a year, a calendar day), and one row per cell carries totals and edge rows across
the cells of the group. The second level is as large as the axis has cells,
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spellwise.session import cut_lineage

CELL = "__cell"


def keep(df: DataFrame) -> DataFrame:
    """Settle a small aggregated table (curves, totals) that later steps read more than once.

    Without this every two-level step would double the plan below it.
    """
    return cut_lineage(df)


def with_cell(df: DataFrame, order: str | Column, width: float) -> DataFrame:
    """Add the cell number ``floor(order / width)``."""
    c = F.col(order) if isinstance(order, str) else order
    return df.withColumn(CELL, F.floor(c / F.lit(float(width))))


def running_sum(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str | Column],
    *,
    inclusive: bool = True,
    descending: bool = False,
    cell: str = CELL,
) -> DataFrame:
    """Add running sums over ``order`` within ``by``; ``cell`` must follow the first order key."""
    direction = F.desc if descending else F.asc
    exprs = {k: F.col(v) if isinstance(v, str) else v for k, v in sums.items()}
    keys = [*by, cell]
    totals = df.groupBy(*keys).agg(*[F.sum(e).alias(f"__o_{k}") for k, e in exprs.items()])
    over_cells = Window.partitionBy(*by).orderBy(direction(cell)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.sum(f"__o_{k}").over(over_cells).alias(f"__o_{k}") for k in exprs])
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*[direction(o) for o in order])
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    local = df.select("*", *[F.sum(e).over(inside).alias(f"__l_{k}") for k, e in exprs.items()])
    joined = local.join(offsets, keys, "left")
    rest = [c for c in df.columns if c not in exprs]
    zero = F.lit(0)
    return joined.select(
        *rest,
        *[(F.coalesce(f"__l_{k}", zero) + F.coalesce(f"__o_{k}", zero)).alias(k) for k in exprs],
    )


def running_min(
    df: DataFrame, by: Sequence[str], order: Sequence[str], mins: Mapping[str, str], *, cell: str = CELL
) -> DataFrame:
    """Add running minima over ``order`` within ``by`` (new column name to source column)."""
    keys = [*by, cell]
    totals = df.groupBy(*keys).agg(*[F.min(c).alias(f"__m_{k}") for k, c in mins.items()])
    over_cells = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.min(f"__m_{k}").over(over_cells).alias(f"__o_{k}") for k in mins])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.min(c).over(inside).alias(f"__l_{k}") for k, c in mins.items()])
    rest = [c for c in df.columns if c not in mins]
    return local.join(offsets, keys, "left").select(*rest, *[F.least(f"__l_{k}", f"__o_{k}").alias(k) for k in mins])


def running_last(
    df: DataFrame, by: Sequence[str], order: Sequence[str], lasts: Mapping[str, str], *, cell: str = CELL
) -> DataFrame:
    """Add the last known (not NULL) value up to and with each row, over ``order`` within ``by`` (new column name to source
    column). ``order`` must be a total order inside the group."""
    keys = [*by, cell]
    stamp = F.struct(*order)
    known = {k: F.when(F.col(c).isNotNull(), stamp) for k, c in lasts.items()}
    ends = df.groupBy(*keys).agg(*[F.max_by(F.col(c), known[k]).alias(f"__e_{k}") for k, c in lasts.items()])
    over_cells = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, *[F.last(f"__e_{k}", ignorenulls=True).over(over_cells).alias(f"__o_{k}") for k in lasts])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.last(c, ignorenulls=True).over(inside).alias(f"__l_{k}") for k, c in lasts.items()])
    rest = [c for c in df.columns if c not in lasts]
    joined = local.join(carried, keys, "left")
    return joined.select(*rest, *[F.coalesce(f"__l_{k}", f"__o_{k}").alias(k) for k in lasts])


def neighbours(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    cell: str = CELL,
) -> DataFrame:
    """Add values of the previous / next row of the group.

    ``lag`` and ``lead`` map new column names to source columns. ``order`` must be
    a total order inside the group.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    keys = [*by, cell]
    carried = sorted({*lag.values(), *lead.values()})
    key = F.struct(*order)
    payload = F.struct(F.lit(True).alias("__there"), *carried)
    edges = df.groupBy(*keys).agg(
        F.max_by(payload, key).alias("__n_last"), F.min_by(payload, key).alias("__n_first")
    )
    cells = Window.partitionBy(*by).orderBy(cell)
    edges = edges.select(
        *keys, F.lag("__n_last").over(cells).alias("__n_before"), F.lead("__n_first").over(cells).alias("__n_after")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    local = df.select(
        "*",
        F.lag(payload).over(inside).alias("__n_prev"),
        F.lead(payload).over(inside).alias("__n_next"),
    )
    joined = local.join(edges, keys, "left")
    prev = F.when(F.col("__n_prev").isNotNull(), F.col("__n_prev")).otherwise(F.col("__n_before"))
    nxt = F.when(F.col("__n_next").isNotNull(), F.col("__n_next")).otherwise(F.col("__n_after"))
    return joined.select(
        *df.columns,
        *[prev[c].alias(name) for name, c in lag.items()],
        *[nxt[c].alias(name) for name, c in lead.items()],
    )


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row of each group in an ascending total order.

    An aggregate, so every map task sends one row per group however hot the group is (a window
    would collect the whole group first).
    """
    keys = [(F.col(o) if isinstance(o, str) else o).alias(f"__k{i}") for i, o in enumerate(order)]
    rest = [c for c in df.columns if c not in by]
    first = df.groupBy(*by).agg(F.min(F.struct(*keys, *rest)).alias("__f"))
    return first.select(*[F.col(c) if c in by else F.col(f"__f.{c}").alias(c) for c in df.columns])


def last_n_per(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Last ``n`` rows of each group.

    The filter on ``row_number`` lets Spark cut each map task's rows down to ``n``
    per group before the shuffle.
    """
    w = Window.partitionBy(*by).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")

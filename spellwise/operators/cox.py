"""Cox models fitted by Newton steps over a compact, range-partitioned risk table.

Spells are reduced once to one row per (covariate pattern, distinct time) with the numbers entering, leaving and failing
there. A row carries its base columns, never its model columns: a task finds the patterns of its partition, builds model
columns for those only, and works with ``w = exp(x b)`` per pattern. A Newton step is three scans without a shuffle:

1. each partition's totals of ``w`` and ``w x`` give the running totals at every partition's start;
2. the hazard increment of each time gives the hazard lived through before every partition's start;
3. log-likelihood, score and information. With ``A`` the hazard that a pattern's rows lived through, the score is
   ``sum x (n_ev - A w)`` and the information ``sum A w x x'`` less one outer product per event time: a cross product over
   patterns, not over rows.

A time may be shared by several partitions (a date on which very many leave); its sums are put together on the driver from
the first and last times of the partitions. The driver sees a few vectors of model length per partition and one ``p x p``
matrix per group of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.functions import Z95, dummies
from spellwise.functions.splines import natural_spline, spline_values
from spellwise.operators.curves import at_time
from spellwise.operators.linear import Factor, independent, product
from spellwise.operators.ordered import CELL, keep, running_sum, with_cell


@dataclass(frozen=True)
class Design:
    """Model columns by name, the base columns they read, and which factor each belongs to.

    ``atoms`` has each column's factors once more for use inside tasks: ``("level", column, value)``, ``("number", column)``
    or ``("spline", column, number, knots)``; the column is their product.
    """

    terms: Mapping[str, Column]
    base: Sequence[str]
    group: Mapping[str, str] = field(default_factory=dict)
    atoms: Mapping[str, tuple] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return list(self.terms)

    def x(self) -> Column:
        return F.array(*[c.cast("double") for c in self.terms.values()])


def design(
    levels: Mapping[str, Sequence[str]],
    *,
    crossed: Sequence[str] = (),
    numeric: Sequence[str] = (),
    spline: tuple[str, Sequence[float]] | None = None,
    spline_with: Sequence[str] = (),
) -> Design:
    """Dummies of all factors, pairwise products of ``crossed``, and age-varying effects.

    ``spline = (column, knots)`` adds the spline and its products with the dummies of
    ``spline_with``.
    """
    per = {f: dummies(f, lv) for f, lv in levels.items()}
    atom = {f"{f}{v}": ("level", f, v) for f, lv in levels.items() for v in lv}
    terms: dict[str, Column] = {}
    group: dict[str, str] = {}
    atoms: dict[str, tuple] = {}

    def add(name, column, of, *parts):
        terms[name] = column
        group[name] = of
        atoms[name] = parts

    for f, ds in per.items():
        for n, c in ds.items():
            add(n, c, f, atom[n])
    for n in numeric:
        add(n, F.col(n).cast("double"), n, ("number", n))
    for a, b in combinations(crossed, 2):
        for na, ca in per[a].items():
            for nb, cb in per[b].items():
                add(f"{na}:{nb}", ca * cb, f"{a}:{b}", atom[na], atom[nb])
    base = [*levels, *numeric]
    if spline is not None:
        col, knots = spline
        base.append(col)
        basis = natural_spline(col, knots)
        piece = [("spline", col, i, tuple(knots)) for i in range(len(basis))]
        for i, s in enumerate(basis, start=1):
            add(f"{col}_s{i}", s, col, piece[i - 1])
        for f in spline_with:
            for n, c in per[f].items():
                for i, s in enumerate(basis, start=1):
                    add(f"{n}:{col}_s{i}", c * s, f"{f}:{col}", atom[n], piece[i - 1])
    return Design(terms, base, group, atoms)


@dataclass(frozen=True)
class Layout:
    """What a task needs of a design: its base columns and the factors of each model column."""

    base: tuple[str, ...]
    atoms: tuple[tuple, ...]

    def matrix(self, rows: pa.Table) -> np.ndarray:
        """Model columns of some rows (base columns by name)."""
        known: dict = {}

        def number(c):
            return pc.cast(rows.column(c), pa.float64()).to_numpy()

        def value(a):
            if a not in known:
                if a[0] == "level":
                    same = pc.fill_null(pc.equal(pc.cast(rows.column(a[1]), pa.string()), a[2]), False)
                    known[a] = same.to_numpy().astype(float)
                elif a[0] == "number":
                    known[a] = number(a[1])
                else:
                    basis = known.setdefault(("basis", a[1], a[3]), None)
                    if basis is None:
                        basis = known["basis", a[1], a[3]] = spline_values(number(a[1]), a[3])
                    known[a] = basis[:, a[2]]
            return known[a]

        out = np.ones((rows.num_rows, len(self.atoms)))
        for j, parts in enumerate(self.atoms):
            for a in parts:
                out[:, j] *= value(a)
        return out


@dataclass
class CoxFit:
    """A fitted (or given) model. Coefficients of aliased columns are NaN."""

    design: Design
    coef: np.ndarray
    vcov: np.ndarray
    loglik: tuple[float, float]
    iterations: int
    means: np.ndarray
    n: int
    n_event: int
    score: np.ndarray
    ties: str
    converged: bool = True
    final_score: np.ndarray | None = None

    def filled(self) -> np.ndarray:
        return np.nan_to_num(self.coef)

    @property
    def aliased(self) -> list[str]:
        """Columns without a coefficient: the others say all that they could."""
        return [n for n, b in zip(self.design.names, self.coef) if np.isnan(b)]


@dataclass(frozen=True)
class RiskTable:
    """Rows (cell, time, base columns, n_in, n_out, n_ev), settled, in time order inside and across partitions."""

    rows: DataFrame
    layout: Layout


def risk_table(
    spells: DataFrame, d: Design, *, entry: str = "entry_age", exit: str = "exit_age",
    event: str | Column = "event_flag", cell_width: float = 0.25,
) -> RiskTable:
    """The risk table of a design.

    Equal rows are merged before they are shuffled; range partitioning by time and pattern also splits a time at which
    very many patterns meet. It is settled, as the partitions' places must stay the same in every scan.
    """
    if set(d.atoms) != set(d.terms):
        raise ValueError("fitting needs the factors of every model column; see design()")
    ev = F.col(event) if isinstance(event, str) else event
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    start = F.struct(at_time(entry).alias("time"), one.alias("n_in"), zero.alias("n_out"), zero.alias("n_ev"))
    stop = F.struct(at_time(exit).alias("time"), zero.alias("n_in"), one.alias("n_out"),
                    F.when(ev, one).otherwise(zero).alias("n_ev"))
    rows = spells.filter(F.col(entry) < F.col(exit)).select(*d.base, F.inline(F.array(start, stop)))
    rows = with_cell(rows, "time", cell_width)
    rows = rows.groupBy(*d.base, CELL, "time").agg(*[F.sum(c).alias(c) for c in ("n_in", "n_out", "n_ev")])
    tasks = int(spells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(tasks, "time", F.xxhash64(*d.base)).sortWithinPartitions("time")
    return RiskTable(keep(rows.select(CELL, "time", "n_in", "n_out", "n_ev", *d.base)), Layout(tuple(d.base), tuple(d.atoms[n] for n in d.names)))


TRANSFORMS = ("identity", "log", "km", "rank")


def time_transform(risk: RiskTable, transform: str) -> DataFrame:
    """Transformed time ``g`` per distinct time: the time, its logarithm, one minus the survival just
    before it, or the mean rank of the failures there."""
    t = risk.rows.groupBy(CELL, "time").agg(*[F.sum(c).alias(c) for c in ("n_in", "n_out", "n_ev")])
    if transform == "identity":
        return t.select(CELL, "time", F.col("time").alias("g"))
    if transform == "log":
        return t.select(CELL, "time", F.log("time").alias("g"))
    t = keep(t.withColumn("__all", F.lit(0)))
    if transform == "rank":
        r = running_sum(t, ["__all"], ["time"], {"upto": "n_ev"})
        return r.select(CELL, "time", (F.col("upto") - (F.col("n_ev") - 1) / 2).alias("g"))
    if transform != "km":
        raise ValueError(transform)
    t = running_sum(t, ["__all"], ["time"], {"n_risk": F.col("n_in") - F.col("n_out")}, inclusive=False)
    t = t.withColumn("ls", F.when((F.col("n_ev") > 0) & (F.col("n_ev") < F.col("n_risk")),
                                  F.log1p(-F.col("n_ev") / F.col("n_risk"))).otherwise(0.0))
    t = running_sum(keep(t), ["__all"], ["time"], {"before": "ls"}, inclusive=False)
    return t.select(CELL, "time", (F.lit(1.0) - F.exp("before")).alias("g"))


# ------------------------------------------------------------------------------------------------ inside a task

#: Rows whose model columns are held at a time, and numbers of a partition's pattern matrix held throughout.
ROWS, HELD = 4096, 1 << 22


class Part:
    """One partition of a risk table: its times, counts and the pattern of every row."""

    def __init__(self, batches: Iterator[pa.RecordBatch], layout: Layout):
        batches = [b for b in batches if b.num_rows]
        self.empty = not batches
        if self.empty:
            return
        table = pa.Table.from_batches(batches)
        numbers = [table.column(c).to_numpy().astype(float) for c in ("time", "n_in", "n_out", "n_ev")]
        self.time, n_in, self.out, self.ev = numbers
        self.net = n_in - self.out
        self.first = np.flatnonzero(np.r_[True, self.time[1:] != self.time[:-1]])
        self.times = self.time[self.first]
        self.slot = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(self.time)]))
        code = np.zeros(len(self.time), np.int64)
        for c in layout.base:
            own = table.column(c).combine_chunks().dictionary_encode()
            level = pc.fill_null(own.indices, -1).to_numpy().astype(np.int64) + 1
            code = np.unique(code * (len(own.dictionary) + 1) + level, return_inverse=True)[1]
        _, where, self.pattern = np.unique(code, return_index=True, return_inverse=True)
        self.patterns = table.select(layout.base).take(pa.array(where))
        self.layout, self.n_patterns = layout, len(where)
        self.p = len(layout.atoms)
        self.held = layout.matrix(self.patterns) if len(where) * max(self.p, 1) <= HELD else None

    def pattern_x(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Model columns of the patterns, some at a time."""
        if self.held is not None:
            yield slice(0, self.n_patterns), self.held
            return
        for i in range(0, self.n_patterns, ROWS):
            yield slice(i, i + ROWS), self.layout.matrix(self.patterns.slice(i, ROWS))

    def linear(self, beta: np.ndarray) -> np.ndarray:
        """``x b`` per pattern."""
        out = np.empty(self.n_patterns)
        for s, x in self.pattern_x():
            out[s] = x @ beta
        return out

    def weighted(self, weights: np.ndarray) -> np.ndarray:
        """``sum x`` over rows, weighted (one result row per column of ``weights``)."""
        out = np.zeros((weights.shape[1], self.p))
        per = self.per_pattern(weights)
        for s, x in self.pattern_x():
            out += per[s].T @ x
        return out

    def per_pattern(self, weights: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.pattern, w, self.n_patterns) for w in weights.T])

    def cross(self, weights: np.ndarray) -> np.ndarray:
        """``sum x x'`` over rows, weighted: a cross product over patterns."""
        out = np.zeros((self.p, self.p))
        per = np.bincount(self.pattern, weights, self.n_patterns)
        for s, x in self.pattern_x():
            out += x.T @ (per[s][:, None] * x)
        return out

    def row_x(self, i: int, j: int) -> np.ndarray:
        if self.held is not None:
            return self.held[self.pattern[i:j]]
        used, place = np.unique(self.pattern[i:j], return_inverse=True)
        return self.layout.matrix(self.patterns.take(pa.array(used)))[place]

    def blocks(self, columns: Callable) -> Iterator[tuple[int, int, np.ndarray]]:
        """(a, b, sums) for times a .. b - 1: ``columns(rows, x)`` summed per time, whole times at once, about ROWS rows."""
        ends = np.r_[self.first[1:], len(self.time)]
        a = 0
        while a < len(self.first):
            b = max(a + 1, int(np.searchsorted(ends, self.first[a] + ROWS, side="right")))
            out = None
            for i in range(self.first[a], ends[b - 1], ROWS):
                j = min(i + ROWS, ends[b - 1])
                values = columns(slice(i, j), self.row_x(i, j))
                slot = self.slot[i:j] - a
                starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                if out is None:
                    out = np.zeros((b - a, values.shape[1]))
                out[slot[starts]] += np.add.reduceat(values, starts, axis=0)
            yield a, b, out
            a = b


@dataclass
class Edge:
    """What a partition has to know of the others: totals before its first time, whole sums at its first and last time
    (which other partitions may share) and whether their contributions are its own to make."""

    before: np.ndarray
    first: np.ndarray
    last: np.ndarray
    owns_first: bool
    owns_last: bool


_EDGE = "part int, first_time double, last_time double, total array<double>, first array<double>, last array<double>"


def _edge_row(part: Part, total: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    row = {
        "part": TaskContext.get().partitionId(), "first_time": part.times[0], "last_time": part.times[-1],
        "total": total.tolist(), "first": first.tolist(), "last": last.tolist(),
    }
    lists = [(c, pa.list_(pa.float64())) for c in ("total", "first", "last")]
    schema = pa.schema([("part", pa.int32()), ("first_time", pa.float64()), ("last_time", pa.float64()), *lists])
    return pa.RecordBatch.from_pylist([row], schema=schema)


def edges(risk: RiskTable, columns: Callable[[Part], Callable], running: slice) -> dict[int, Edge]:
    """One scan: sums of ``columns`` per time at the partitions' edges and, for those of ``running``, totals before them."""
    layout = risk.layout

    def run(batches):
        part = Part(batches, layout)
        if part.empty:
            return
        total = first = last = None
        for _, _, sums in part.blocks(columns(part)):
            first = sums[0] if first is None else first
            last = sums[-1]
            total = sums.sum(axis=0) if total is None else total + sums.sum(axis=0)
        yield _edge_row(part, total, first, last)

    rows = sorted(risk.rows.mapInArrow(run, _EDGE).collect(), key=lambda r: (r["first_time"], r["last_time"], r["part"]))
    return _edges_of(rows, running)


def _edges_of(rows: list, running: slice) -> dict[int, Edge]:
    """A partition holds one time, or times of which only the first and last may be shared, so sums per shared time add up
    over the partitions that begin or end there."""
    shared: dict[float, np.ndarray] = {}
    owner: dict[float, int] = {}
    for r in rows:
        shared[r["first_time"]] = shared.get(r["first_time"], 0) + np.array(r["first"])
        owner[r["first_time"]] = r["part"]
        if r["last_time"] != r["first_time"]:
            shared[r["last_time"]] = shared.get(r["last_time"], 0) + np.array(r["last"])
            owner[r["last_time"]] = r["part"]
    out, upto, at_end = {}, 0.0, {}
    for r in rows:  # in time order: all of a partition but its first time lies before the next one's
        width = len(np.array(r["first"])[running])
        same = at_end.get(r["first_time"], np.zeros(width))
        out[r["part"]] = Edge(
            upto - same if len(out) else np.zeros(width), shared[r["first_time"]], shared[r["last_time"]],
            owner[r["first_time"]] == r["part"], owner[r["last_time"]] == r["part"],
        )
        upto = upto + np.array(r["total"])[running]
        last = r["last_time"]
        at_end = {last: at_end.get(last, 0) + np.array(r["last"])[running]}
    return out


def whole_blocks(part: Part, edge: Edge, columns: Callable) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, sums, own): blocks of the partition with the shared times made whole; ``own`` marks times whose contributions
    belong to this partition."""
    last = len(part.times) - 1
    for a, b, sums in part.blocks(columns):
        own = np.ones(b - a, bool)
        if a == 0:
            sums[0], own[0] = edge.first, edge.owns_first
        if b - 1 == last:
            sums[-1], own[-1] = edge.last, edge.owns_last
        yield a, b, sums, own


def starts(rows: list, width: int) -> dict[int, np.ndarray]:
    """Totals before each partition's first time from rows (part, first_time, last_time, total, first, last) that count
    shared times whole in every partition."""
    out, upto, seen, at_seen = {}, np.zeros(width), None, np.zeros(width)
    for r in sorted(rows, key=lambda r: (r["first_time"], r["last_time"], r["part"])):
        first, last, total = (np.array(r[c]) for c in ("first", "last", "total"))
        before = upto - at_seen if r["first_time"] == seen else upto
        out[r["part"]] = before
        upto, seen, at_seen = before + total, r["last_time"], last
    return out


def _scan(risk: RiskTable, per_time: Callable[[Part], np.ndarray], width: int) -> dict[int, np.ndarray]:
    """Running totals before each partition of a matrix (times x width) that every partition computes of its times."""
    layout = risk.layout

    def run(batches):
        part = Part(batches, layout)
        if not part.empty:
            values = per_time(part)
            yield _edge_row(part, values.sum(axis=0), values[0], values[-1])

    return starts(risk.rows.mapInArrow(run, _EDGE).collect(), width)


def _tie_sums(d: float, s0: float, e0: float, efron: bool) -> np.ndarray:
    """Sums over the tied failures of ln q, 1/q, c/q, 1/q^2, c/q^2, c^2/q^2."""
    if not efron or d <= 1:
        return np.array([d * np.log(s0), d / s0, 0.0, d / s0**2, 0.0, 0.0])
    out = np.zeros(6)
    for lo in range(0, int(d), 1_000_000):
        c = np.arange(lo, min(int(d), lo + 1_000_000)) / d
        q = s0 - c * e0
        out += [np.log(q).sum(), (1 / q).sum(), (c / q).sum(), (1 / q**2).sum(), (c / q**2).sum(), (c**2 / q**2).sum()]
    return out


def _ties(d: np.ndarray, s0: np.ndarray, e0: np.ndarray, efron: bool) -> np.ndarray:
    """``_tie_sums`` of many times; zeros where nobody fails."""
    out = np.zeros((len(d), 6))
    some = d > 0
    s, k = s0[some], d[some]
    out[some, 0], out[some, 1], out[some, 3] = k * np.log(s), k / s, k / s**2
    if efron:
        for i in np.flatnonzero(d > 1):
            out[i] = _tie_sums(d[i], s0[i], e0[i], True)
    return out


def _cox_columns(beta: np.ndarray):
    """Sums per time: failures, their x b, net entries (heads, w, w x) and failures (w, w x)."""

    def of(part: Part):
        lp = part.linear(beta)
        w = np.exp(lp)

        def columns(rows: slice, x: np.ndarray) -> np.ndarray:
            k = part.pattern[rows]
            ev, net = part.ev[rows], part.net[rows]
            wk = w[k]
            return np.column_stack([
                ev, ev * lp[k], net, net * wk, (net * wk)[:, None] * x, ev * wk, (ev * wk)[:, None] * x])

        return columns

    return of


def _scalars(part: Part, edge: Edge, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per time, shared times whole: failures, their w, and heads and w at risk just before."""
    wk = w[part.pattern]
    sums = np.column_stack([part.ev, part.ev * wk, part.net, part.net * wk])
    sums = np.add.reduceat(sums, part.first, axis=0)
    p = part.p
    for i, block in ((0, edge.first), (-1, edge.last)):
        sums[i] = block[0], block[4 + p], block[2], block[3]
    before = edge.before[:2] + np.vstack([np.zeros(2), np.cumsum(sums[:-1, 2:], axis=0)])
    return sums[:, 0], sums[:, 1], before[:, 0], before[:, 1]


def _log_surv(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    some = (d > 0) & (d < n)
    return np.where(some, np.log1p(-d / np.where(some, n, 1.0)), 0.0)


def _powers(part: Part, d, n, transform: str, powers: int, fallen: dict | None, failed: dict | None) -> np.ndarray:
    """Powers 0, 1, ... of the transformed time, one row per time."""
    if powers == 1:
        return np.ones((len(part.times), 1))
    me = TaskContext.get().partitionId()
    if transform == "identity":
        g = part.times
    elif transform == "log":
        g = np.log(part.times)
    elif transform == "km":
        ls = _log_surv(d, n)
        g = 1.0 - np.exp(fallen[me][0] + np.cumsum(ls) - ls)
    elif transform == "rank":
        g = failed[me][0] + np.cumsum(d) - (d - 1) / 2
    else:
        raise ValueError(transform)
    return g[:, None] ** np.arange(powers)


def _vector_sum(batches):
    total = None
    for b in batches:
        if b.num_rows:
            part = np.asarray(b.column("vec").flatten()).reshape(b.num_rows, -1).sum(axis=0)
            total = part if total is None else total + part
    if total is not None:
        yield _vector(total)


def _vector(values: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(values).ravel())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), flat)], names=["vec"])


def _pass(risk: RiskTable, beta: np.ndarray, ties: str, powers: int, transform: str):
    """(log-likelihood, score, information, scale of its diagonal, sum of x over those leaving) at ``beta``."""
    beta = np.asarray(beta, dtype=float)
    p, efron, layout = len(beta), ties == "efron", risk.layout
    columns = _cox_columns(beta)
    edge = edges(risk, columns, slice(2, 4 + p))
    fallen = failed = None
    if powers > 1 and transform in ("km", "rank"):

        def step(part):
            d, _, n, _ = _scalars(part, edge[TaskContext.get().partitionId()], np.exp(part.linear(beta)))
            return (_log_surv(d, n) if transform == "km" else d)[:, None]

        fallen = failed = _scan(risk, step, 1)

    def hazard(part, w=None):
        me = TaskContext.get().partitionId()
        d, e0, n, s0 = _scalars(part, edge[me], np.exp(part.linear(beta)) if w is None else w)
        tie = _ties(d, s0, e0, efron)
        g = _powers(part, d, n, transform, powers, fallen, failed)
        return tie, g, tie[:, 1:2] * g

    lived = _scan(risk, lambda part: hazard(part)[2], powers)

    def run(batches):
        part = Part(batches, layout)
        if part.empty:
            return
        me = TaskContext.get().partitionId()
        w = np.exp(part.linear(beta))
        tie, g, dh = hazard(part, w)
        upto = lived[me] + np.cumsum(dh, axis=0)
        ll, info, u = 0.0, np.zeros((powers, p, p)), np.zeros((powers, p))
        s = edge[me].before.copy()
        for a, b, sums, own in whole_blocks(part, edge[me], columns(part)):
            run_ = sums[:, 2 : 4 + p]
            before = s + np.vstack([np.zeros(p + 2), np.cumsum(run_, axis=0)[:-1]])
            s = before[-1] + run_[-1]
            at = np.flatnonzero((sums[:, 0] > 0) & own)
            t = tie[a + at]
            s1, e1 = before[at, 2:], sums[at, 5 + p : 5 + 2 * p]
            ll += (sums[at, 1] - t[:, 0]).sum()
            for k in range(powers):
                gk = g[a + at, k]
                mixed = s1.T @ ((gk * t[:, 4])[:, None] * e1)
                info[k] -= s1.T @ ((gk * t[:, 3])[:, None] * s1) - (mixed + mixed.T) + e1.T @ ((gk * t[:, 5])[:, None] * e1)
        wr, ev = w[part.pattern], part.ev
        scale = np.zeros(p)
        for k in range(powers):
            c = wr * (upto[part.slot, k] * -part.net - (tie[:, 2] * g[:, k])[part.slot] * ev)
            u[k] += part.weighted((g[part.slot, k] * ev - c)[:, None])[0]
            lived_through = part.cross(c)
            info[k] += lived_through
            if not k:
                scale = np.diag(lived_through)
        left = part.weighted(part.out[:, None])[0]
        heads = [part.out.sum(), part.ev.sum()]
        yield _vector(np.concatenate([[ll], heads, scale, left, u.ravel(), info.ravel()]))

    # one vector per partition, then a few of them: never a row per entry
    parts = risk.rows.mapInArrow(run, "vec array<double>").repartition(8).mapInArrow(_vector_sum, "vec array<double>")
    vec = np.sum([r["vec"] for r in parts.collect()] or [np.zeros(3 + 2 * p + powers * (p + p * p))], axis=0)
    ll, n, d = vec[:3]
    scale, left = vec[3 : 3 + p], vec[3 + p : 3 + 2 * p]
    u = vec[3 + 2 * p : 3 + 2 * p + powers * p].reshape(powers, p)
    info = vec[3 + 2 * p + powers * p :].reshape(powers, p, p)
    return ll, u, (info + info.transpose(0, 2, 1)) / 2, scale, (n, d, left)


def cox_pass(
    risk: RiskTable, beta: np.ndarray, *, ties: str = "efron", powers: int = 1, transform: str = "identity"
) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, score and information at ``beta``.

    With ``powers > 1`` score and information also come weighted with powers of the
    transformed time (for the proportional-hazards test).
    """
    ll, u, info, _, _ = _pass(risk, beta, ties, powers, transform)
    return (ll, u[0], info[0]) if powers == 1 else (ll, u, info)


def cox_fit(
    spells: DataFrame, d: Design, *, ties: str = "efron", entry: str = "entry_age", exit: str = "exit_age",
    event: str | Column = "event_flag", cell_width: float = 0.25, max_iter: int = 20, eps: float = 1e-9,
) -> CoxFit:
    """Maximum partial likelihood with step halving.

    Redundant columns are left out once, at the start, from left to right: those of which less than rounding is left beside
    the ones before them. A column that loses its information on the way (a level nobody fails in) keeps its last
    coefficient and gets no variance; ``converged`` tells whether the steps settled.
    """
    risk = risk_table(spells, d, entry=entry, exit=exit, event=event, cell_width=cell_width)
    p = len(d.names)
    beta = np.zeros(p)
    ll, u, info, scale, (n, n_event, left) = _pass(risk, beta, ties, 1, "identity")
    if not n_event:
        raise ValueError("no events: nothing to fit")
    u, info = u[0], info[0]
    start, score0 = ll, u
    kept = independent(info, scale)
    done, converged = 0, False
    for done in range(1, max_iter + 1):
        step = np.zeros(p)
        step[kept] = Factor(info[np.ix_(kept, kept)]).solve(u[kept])
        new = beta + step
        ll2, u2, info2, *_ = _pass(risk, new, ties, 1, "identity")
        halvings = 0
        while not ll2 >= ll - 1e-9 * abs(ll) and halvings < 12:
            halvings += 1
            step /= 2
            new = beta + step
            ll2, u2, info2, *_ = _pass(risk, new, ties, 1, "identity")
        if not ll2 >= ll - 1e-9 * abs(ll):
            break  # no step rises any more: not converged
        small = abs(ll2 - ll) <= eps * abs(ll2)
        beta, ll, u, info = new, ll2, u2[0], info2[0]
        if small:
            converged = True
            break
    vcov = np.zeros((p, p))
    vcov[np.ix_(kept, kept)] = Factor(info[np.ix_(kept, kept)]).inverse()
    coef = np.full(p, np.nan)
    coef[kept] = beta[kept]
    return CoxFit(d, coef, vcov, (start, ll), done, left / n, int(round(n)), int(round(n_event)), score0, ties, converged, u)


def given_model(d: Design, coef: Mapping[str, float], vcov: np.ndarray | None = None, ties: str = "breslow") -> CoxFit:
    """A model with known coefficients (missing names count as 0)."""
    b = np.array([float(coef.get(n, 0.0)) for n in d.names])
    p = len(b)
    return CoxFit(d, b, np.zeros((p, p)) if vcov is None else vcov, (np.nan, np.nan), 0, np.zeros(p), 0, 0, np.zeros(p), ties)


def tidy_fit(fit: CoxFit, spark, *, exponentiate: bool = True) -> DataFrame:
    """Columns: term, estimate (hazard ratio), std_error, statistic, p_value, conf_low, conf_high, converged."""
    from math import erfc, exp, inf, isnan, sqrt

    def safe_exp(v: float) -> float:
        return exp(v) if v < 700 else inf

    rows = []
    for i, name in enumerate(fit.design.names):
        b = float(fit.coef[i])
        if isnan(b):
            rows.append((name, None, None, None, None, None, None, fit.converged))
            continue
        se = sqrt(max(fit.vcov[i, i], 0.0))
        z = b / se if se > 0 else None
        f = safe_exp if exponentiate else float
        rows.append((name, f(b), se, z, erfc(abs(z) / sqrt(2)) if z is not None else None, f(b - Z95 * se), f(b + Z95 * se), fit.converged))
    return spark.createDataFrame(
        rows, "term string, estimate double, std_error double, statistic double, p_value double, conf_low double, conf_high double, converged boolean")


def score_and_information(spells: DataFrame, d: Design, beta: np.ndarray | None = None, *, ties: str = "breslow", **kw) -> DataFrame:
    """Score and information at a given coefficient vector as rows (row, col, value); col ``score`` and ``loglik`` included."""
    b = np.zeros(len(d.names)) if beta is None else beta
    ll, u, info = cox_pass(risk_table(spells, d, **kw), b, ties=ties)
    rows = [("loglik", "loglik", float(ll))]
    rows += [(n, "score", float(u[i])) for i, n in enumerate(d.names)]
    rows += [(a, c, float(info[i, j])) for i, a in enumerate(d.names) for j, c in enumerate(d.names) if i <= j]
    return spells.sparkSession.createDataFrame(rows, "row string, col string, value double")


def ph_test(spells: DataFrame, fit: CoxFit, *, transform: str = "km", **kw) -> list[tuple[str, float, int]]:
    """Proportional-hazards test: score test of ``x * g(time)`` per model factor and overall.

    Returns (factor, chi-square, degrees of freedom).
    """
    d = fit.design
    _, u, info = cox_pass(risk_table(spells, d, **kw), fit.filled(), ties=fit.ties, powers=3, transform=transform)
    idx = np.flatnonzero(~np.isnan(fit.coef))
    i0, i1, i2 = (m[np.ix_(idx, idx)] for m in info)
    back = Factor(i0)
    v = i2 - product(i1, back.solve(i1))
    s = u[1][idx] - np.einsum("ij,j->i", i1, back.solve(u[0][idx]))
    groups: dict[str, list[int]] = {}
    for pos, i in enumerate(idx):
        groups.setdefault(d.group.get(d.names[i], d.names[i]), []).append(pos)
    chi = lambda pos: Factor(v[np.ix_(pos, pos)], tol=1e-10).quadratic(s[pos])
    # the other factors' time effects stay at zero
    out = [(name, chi(pos), len(pos)) for name, pos in groups.items()]
    out.append(("GLOBAL", chi(list(range(len(idx)))), len(idx)))
    return out


def _additive_columns(part: Part):
    """Sums per time: failures, net entries (heads, x x'), failures' x and x x'."""

    def columns(rows: slice, x: np.ndarray) -> np.ndarray:
        xx = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        ev, net = part.ev[rows], part.net[rows]
        return np.column_stack([ev, net, net[:, None] * xx, ev[:, None] * x, ev[:, None] * xx])

    return columns


def _inverses(a: np.ndarray, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of many symmetric matrices by elimination, and which of them have full rank."""
    n, p = a.shape[:2]
    work = np.concatenate([a, np.broadcast_to(np.eye(p), a.shape)], axis=2)
    whole, scale = np.ones(n, bool), a[:, range(p), range(p)].copy()
    for j in range(p):
        pivot = work[:, j, j]
        whole &= pivot > tol * scale[:, j]
        row = work[:, j] / np.where(whole, pivot, 1.0)[:, None]
        work = work - work[:, :, j, None] * row[:, None, :]
        work[:, j] = row
    return work[:, :, p:], whole


def additive_model(
    spells: DataFrame, d: Design, *, entry: str = "entry_age", exit: str = "exit_age", event: str | Column = "event_flag",
    cell_width: float = 0.25, nmin: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cumulative effects of an additive-hazards model with intercept, and the ledger of what they leave out.

    Effects: term, time, coef, coef_up, coef_dn (last value per tied time). At each event time the increment solves the
    normal equations of those at risk. Times with fewer than ``nmin`` at risk (default three per term) or a singular system add
    nothing to the sums; the ledger has them: time, n_risk, n_event, reason (``few`` or ``singular``).
    """
    names = ["Intercept", *d.names]
    full = Design({"Intercept": F.lit(1.0), **d.terms}, d.base, d.group, {"Intercept": (), **d.atoms})
    p = len(names)
    q = p * p
    nmin = 3 * (p - 1) if nmin is None else nmin
    risk = risk_table(spells, full, entry=entry, exit=exit, event=event, cell_width=cell_width)
    layout, edge = risk.layout, edges(risk, _additive_columns, slice(1, 2 + q))
    ddl = "time double, n_risk double, n_event double, reason string, coef array<double>, var array<double>"
    lists = [(c, pa.list_(pa.float64())) for c in ("coef", "var")]
    schema = pa.schema([("time", pa.float64()), ("n_risk", pa.float64()), ("n_event", pa.float64()), ("reason", pa.string()), *lists])

    def steps(batches):
        part = Part(batches, layout)
        if part.empty:
            return
        me = edge[TaskContext.get().partitionId()]
        s = me.before.copy()
        for a, _, sums, own in whole_blocks(part, me, _additive_columns(part)):
            before = s + np.vstack([np.zeros(q + 1), np.cumsum(sums[:, 1 : 2 + q], axis=0)[:-1]])
            s = before[-1] + sums[-1, 1 : 2 + q]
            at = np.flatnonzero((sums[:, 0] > 0) & own)
            if not len(at):
                continue
            inv, whole = _inverses(before[at, 1:].reshape(-1, p, p))
            ex, exx = sums[at, 2 + q : 2 + q + p], sums[at, 2 + q + p :].reshape(-1, p, p)
            coef = np.einsum("tij,tj->ti", inv, ex)
            var = np.maximum(np.einsum("tij,tjk,tik->ti", inv, exx, inv), 0.0)
            few = before[at, 0] < nmin
            reason = [None if w and not f else "few" if f else "singular" for w, f in zip(whole, few)]
            yield pa.RecordBatch.from_arrays([
                pa.array(part.times[a + at]), pa.array(before[at, 0]), pa.array(sums[at, 0]), pa.array(reason, pa.string()),
                pa.array(coef.tolist(), lists[0][1]), pa.array(var.tolist(), lists[0][1])], schema=schema)

    inc = keep(risk.rows.mapInArrow(steps, ddl))
    each = F.array(*[
        F.struct(F.lit(n).alias("term"), F.col("coef")[j].alias("coef"), F.col("var")[j].alias("var")) for j, n in enumerate(names)])
    rows = with_cell(inc.filter("reason is null"), "time", cell_width).select(CELL, "time", F.inline(each))
    cum = running_sum(keep(rows), ["term"], ["time"], {"coef": "coef", "var": "var"})
    half = F.lit(1.96) * F.sqrt("var")
    effects = cum.select("term", "time", "coef", (F.col("coef") + half).alias("coef_up"), (F.col("coef") - half).alias("coef_dn"))
    ledger = inc.filter("reason is not null").select(
        "time", F.col("n_risk").cast("long").alias("n_risk"), F.col("n_event").cast("long").alias("n_event"), "reason")
    return effects, ledger


def additive_effects(spells: DataFrame, d: Design, **kw) -> DataFrame:
    """The effects of ``additive_model``."""
    return additive_model(spells, d, **kw)[0]

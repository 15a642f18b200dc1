"""Several states: pieces of a person's path and the probabilities of being in each state (Aalen-Johansen).

The probability of a state needs the product over time of one transition matrix per distinct time. Matrices are multiplied
in two levels: inside a cell of the time axis from its first time on, and over the cells of a stratum; a time's probabilities
are those at its cell's start times the product inside. Rows are merged to one per stratum and distinct time before that, so
both levels are as large as the axis, whatever the number of persons.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.functions import age_at
from spellwise.operators.curves import at_time, with_each
from spellwise.operators.ordered import CELL, keep, neighbours, running_sum, with_cell
from spellwise.operators.spells import month_cell


def state_pieces(
    log: DataFrame, indiv: DataFrame, states: Mapping[str, str], *, initial: str, terminal: Sequence[str] = (),
    censor: Sequence[str] = (), start: str, end: str, min_age: float | None = None, tie: Sequence[str] = (),
) -> DataFrame:
    """One row per stay: columns of ``indiv``, state, entry_age, exit_age, to_state (NULL where the stay is cut off).

    ``states`` maps event codes to the state they lead to; other codes but ``censor`` leave the state as it is. Of several such
    events on one day the last one by ``tie`` and code counts. Stays are cut to [``start``, ``end``) and to ages from ``min_age``
    on; after a ``terminal`` state or a ``censor`` code a person is no longer watched. Months serve as cells, so a
    very long history is windowed month by month.
    """
    start_d, end_d = (F.lit(d).cast("date") for d in (start, end))
    to = F.create_map(*[F.lit(v) for pair in states.items() for v in pair])[F.col("event")]
    rows = log.filter(F.col("event").isin(*states, *censor)).select("id", "date_event", *tie, "event", to.alias("to"))
    day = rows.groupBy("id", "date_event").agg(F.max_by("to", F.struct(*tie, "event")).alias("to"))
    ends = F.when(F.col("to").isNull() | F.col("to").isin(*terminal), F.col("date_event"))
    over = day.groupBy(F.col("id").alias("__id")).agg(F.min(ends).alias("__over"))
    day = day.join(over, F.col("id") == F.col("__id")).filter("__over is null or date_event <= __over").select("id", "date_event", "to")
    day = day.withColumn(CELL, month_cell("date_event"))
    day = neighbours(day.withColumn("known", F.lit(True)), ["id"], ["date_event"],
                     lag={"__t": "date_event", "__from": "to", "__was": "known"}, lead={"__more": "known"})
    here = F.when(F.col("__was"), F.col("__from")).otherwise(F.lit(initial))
    stay = F.struct(here.alias("state"), F.col("__t").alias("t1"), F.col("date_event").alias("t2"), F.col("to").alias("to_state"))
    after = F.struct(F.col("to").alias("state"), F.col("date_event").alias("t1"), F.lit(None).cast("date").alias("t2"),
                     F.lit(None).cast("string").alias("to_state"))
    open_end = F.col("__more").isNull() & F.col("to").isNotNull() & ~F.col("to").isin(*terminal)
    stays = day.select("id", F.inline(F.when(open_end, F.array(stay, after)).otherwise(F.array(stay))))
    # persons without any such event stay where they are
    none = F.struct(F.lit(initial).alias("state"), F.lit(None).cast("date").alias("t1"), F.lit(None).cast("date").alias("t2"),
                    F.lit(None).cast("string").alias("to_state"))
    stays = indiv.join(stays.withColumnRenamed("id", "__id"), indiv["id"] == F.col("__id"), "left").drop("__id")
    stays = stays.withColumns({
        "state": F.coalesce("state", none["state"]), "t1": F.greatest(F.coalesce("t1", start_d), start_d),
        "cut": F.col("t2").isNull() | (F.col("t2") >= end_d), "t2": F.least(F.coalesce("t2", end_d), end_d)})
    entry, leave = age_at("birth_date", "t1"), age_at("birth_date", "t2")
    if min_age is not None:
        entry = F.greatest(entry, F.lit(float(min_age)))
    same = F.col("to_state") == F.col("state")
    out = stays.filter(F.col("t1") < F.col("t2")).select(
        *indiv.columns, "state", entry.alias("entry_age"), leave.alias("exit_age"),
        F.when(~F.col("cut") & ~F.coalesce(same, F.lit(False)), F.col("to_state")).alias("to_state"))
    return out.filter(F.col("entry_age") < F.col("exit_age"))


def _products(n: int, by: list[str]):
    """Inside a cell: the product of its matrices up to each time (rows of the whole group, one cell)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time")
        step = np.vstack(pdf["step"].to_numpy()).reshape(-1, n, n)
        out, upto = np.empty_like(step), np.eye(n)
        for i, a in enumerate(step):
            upto = np.einsum("ij,jk->ik", upto, a)
            out[i] = upto
        return pdf[[*by, CELL, "time"]].assign(product=list(out.reshape(-1, n * n)))

    return run


def _carried(n: int, by: list[str], start: list[float]):
    """Over the cells of a stratum: probabilities at each cell's start."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(CELL)
        p, out = np.array(start), []
        for a in pdf["product"]:
            out.append(p)
            p = np.einsum("i,ij->j", p, np.asarray(a).reshape(n, n))
        return pdf[[*by, CELL]].assign(before=out)

    return run


def _product_integral(steps: DataFrame, keys: list[str], states: Sequence[str], initial: str) -> DataFrame:
    """(keys, time, p): the probabilities after each time's matrix ``step``, in two levels."""
    n, start = len(states), [1.0 if s == initial else 0.0 for s in states]
    types = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    ddl = ", ".join(f"`{k}` {types[k]}" for k in [*keys, CELL])
    inside = keep(steps.select(*keys, CELL, "time", "step").groupBy(*keys, CELL).applyInPandas(_products(n, keys), f"{ddl}, time double, product array<double>"))
    totals = inside.groupBy(*keys, CELL).agg(F.max_by("product", "time").alias("product"))
    carried = totals.groupBy(*keys).applyInPandas(_carried(n, keys, start), f"{ddl}, before array<double>")
    at = lambda j: sum((F.col("before")[i] * F.col("product")[i * n + j] for i in range(n)), F.lit(0.0))
    return inside.join(carried, [*keys, CELL]).select(*keys, "time", F.array(*[at(j) for j in range(n)]).alias("p"))


def state_probabilities(
    pieces: DataFrame, states: Sequence[str], by: Sequence[str] = (), *, initial: str, entry: str = "entry_age",
    exit: str = "exit_age", state: str = "state", to: str = "to_state", weight: str | Column | None = None, cell_width: float = 0.25,
) -> DataFrame:
    """Probability of each state at every time at which somebody leaves a stay: strata, time, state, n_risk, n_event, pstate.

    ``n_risk`` counts those in the state just before, ``n_event`` the moves out of it. Everyone counts as ``initial`` before
    the first time. A stay of unknown or unlisted state, or without length, takes no part; with one possible exit this is the
    cumulative incidence.
    """
    states, keys = list(states), [*by] or ["__all"]
    n = len(states)
    df = pieces if by else pieces.withColumn("__all", F.lit(0))
    w = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    df = df.filter((F.col(entry) < F.col(exit)) & F.col(state).isin(*states))
    names = [f"{i}_{j}" for i in range(n) for j in range(n) if i != j]
    zero = F.lit(0.0)
    in_ = [F.when(F.col(state) == s, w).otherwise(zero) for s in states]
    moves = {f"{i}_{j}": F.when((F.col(state) == states[i]) & (F.col(to) == states[j]), w).otherwise(zero) for i in range(n) for j in range(n) if i != j}

    def row(t, sign, moved, out):
        return F.struct(at_time(t).alias("time"), F.lit(out).alias("out"), *[(c * sign).alias(f"y{i}") for i, c in enumerate(in_)],
                        *[(moves[m] if moved else zero).alias(f"d{m}") for m in names])

    rows = with_cell(df.select(*keys, F.inline(F.array(row(entry, 1.0, False, 0), row(exit, -1.0, True, 1)))), "time", cell_width)
    sums = ["out", *[f"y{i}" for i in range(n)], *[f"d{m}" for m in names]]
    rows = keep(rows.groupBy(*keys, CELL, "time").agg(*[F.sum(c).alias(c) for c in sums]))
    rows = running_sum(rows, keys, ["time"], {f"n{i}": f"y{i}" for i in range(n)}, inclusive=False).filter("out > 0")
    left = {i: sum((F.col(f"d{i}_{j}") for j in range(n) if j != i), zero) for i in range(n)}
    share = lambda i, d: F.when((d > 0) & (F.col(f"n{i}") > 0), d / F.col(f"n{i}")).otherwise(zero)
    cells = [F.lit(1.0) - share(i, left[i]) if i == j else share(i, F.col(f"d{i}_{j}")) for i in range(n) for j in range(n)]
    facts = [F.struct(F.lit(s).alias("state"), F.round(F.col(f"n{i}"), 9).alias("n_risk"), left[i].alias("n_event")) for i, s in enumerate(states)]
    steps = keep(rows.select(*keys, CELL, "time", F.array(*cells).alias("step"), F.array(*facts).alias("facts")))
    out = _product_integral(steps, keys, states, initial).join(steps.select(*keys, "time", "facts"), [*keys, "time"])
    return out.select(*by, "time", F.inline(F.arrays_zip("facts", "p"))).select(
        *by, "time", "facts.state", "facts.n_risk", "facts.n_event", F.col("p").alias("pstate"))


def profile_state_probabilities(
    baselines: Mapping[tuple[str, str], DataFrame], lps: Mapping[tuple[str, str], Column], profiles: DataFrame, keys: Sequence[str],
    states: Sequence[str], *, initial: str, cell_width: float = 0.25,
) -> DataFrame:
    """Probability of each state per profile from one model of hazards per move: keys, time, state, pstate.

    ``baselines`` has the baseline hazard (time, dh) of each move (from, to) and ``lps`` the predictor of its model. At each
    time those in a state stay with probability ``exp(-a)``, ``a`` being the summed increments of its exits, and the rest is
    shared among the exits in proportion; with one state to leave these are ``cause_specific_curves``.
    """
    states, keys = list(states), list(keys)
    n = len(states)
    steps = None
    for (i, j), b in baselines.items():
        part = b.filter(F.col("dh") > 0).select("time", F.lit(f"{states.index(i)}_{states.index(j)}").alias("__move"), "dh")
        steps = part if steps is None else steps.unionByName(part)
    both = with_each(steps, profiles)
    lp = F.lit(None).cast("double")
    for i, j in baselines:
        lp = F.when(F.col("__move") == f"{states.index(i)}_{states.index(j)}", lps[i, j]).otherwise(lp)
    both = with_cell(both.withColumn("__a", F.col("dh") * F.exp(lp)), "time", cell_width)
    zero = F.lit(0.0)
    moves = [(i, j) for i in range(n) for j in range(n) if i != j]
    wide = both.groupBy(*keys, CELL, "time").agg(
        *[F.sum(F.when(F.col("__move") == f"{i}_{j}", F.col("__a")).otherwise(zero)).alias(f"a{i}_{j}") for i, j in moves])
    total = {i: sum((F.col(f"a{i}_{j}") for j in range(n) if j != i), zero) for i in range(n)}
    gone = {i: F.when(total[i] > 0, (F.lit(1.0) - F.exp(-total[i])) / total[i]).otherwise(zero) for i in range(n)}
    cells = [F.exp(-total[i]) if i == j else gone[i] * F.col(f"a{i}_{j}") for i in range(n) for j in range(n)]
    out = _product_integral(keep(wide.select(*keys, CELL, "time", F.array(*cells).alias("step"))), keys, states, initial)
    each = F.array(*[F.struct(F.lit(s).alias("state"), F.col("p")[i].alias("pstate")) for i, s in enumerate(states)])
    return out.select(*keys, "time", F.inline(each))

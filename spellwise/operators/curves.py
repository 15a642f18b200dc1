"""Survival curves from left-truncated, right-censored spells.

All estimators share one sweep: spells are first aggregated to one row per
(stratum, distinct time), combined on the map side, and only that small table is
put in order (see :mod:`spellwise.operators.ordered`). A hot stratum or a date on
which a third of all people leave is therefore just one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.functions import Z95
from spellwise.operators.ordered import CELL, keep, neighbours, running_sum, with_cell

ALL = "__all"


def _strata(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def at_time(c: str, digits: int = 9) -> Column:
    """Real-valued times are compared after rounding, so equal ages stay equal."""
    return F.round(F.col(c).cast("double"), digits)


def sweep(
    spells: DataFrame,
    by: Sequence[str],
    *,
    entry: str = "entry_age",
    exit: str = "exit_age",
    event: str | Column = "event_flag",
    weight: str | Column | None = None,
    causes: dict[str, Column] | None = None,
    cell_width: float = 0.25,
) -> DataFrame:
    """One row per stratum and distinct time: entries, exits, events (per cause)."""
    w = F.lit(1).cast("bigint") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    ev = F.col(event) if isinstance(event, str) else event
    nil = w * 0
    hits = {"d": F.coalesce(ev, F.lit(False)), **(causes or {})}
    start = F.struct(at_time(entry).alias("time"), w.alias("ent"), nil.alias("ext"), *[nil.alias(k) for k in hits])
    stop = F.struct(
        at_time(exit).alias("time"), nil.alias("ent"), w.alias("ext"),
        *[F.when(c, w).otherwise(nil).alias(k) for k, c in hits.items()],
    )
    rows = (
        spells.filter(F.col(entry) < F.col(exit))
        .select(*by, F.inline(F.array(start, stop)))
    )
    rows = with_cell(rows, "time", cell_width)
    return keep(rows.groupBy(*by, CELL, "time").agg(*[F.sum(c).alias(c) for c in ("ent", "ext", *hits)]))


def km(
    spells: DataFrame,
    by: Sequence[str] = (),
    *,
    entry: str = "entry_age",
    exit: str = "exit_age",
    event: str | Column = "event_flag",
    weight: str | Column | None = None,
    cell_width: float = 0.25,
    level: float = Z95,
) -> DataFrame:
    """Kaplan-Meier and Nelson-Aalen curves with Greenwood errors and log-scale limits.

    Columns: strata, time, n_risk, n_event, n_censor, surv, surv_before, cumhaz,
    std_err (of log survival), lower, upper. Where survival is exactly zero the
    error and limits are NULL.
    """
    spells, keys = _strata(spells, by)
    s = sweep(spells, keys, entry=entry, exit=exit, event=event, weight=weight, cell_width=cell_width)
    s = running_sum(s, keys, ["time"], {"n_risk": F.col("ent") - F.col("ext")}, inclusive=False)
    return _product_limit(s.filter(F.col("ext") > 0), keys, by, level)


def _product_limit(s: DataFrame, keys: list[str], by: Sequence[str], level: float) -> DataFrame:
    d, n = F.col("d").cast("double"), F.col("n_risk").cast("double")
    out_all = d >= n * (1 - 1e-12)
    terms = {
        "__ls": F.when(out_all, 0.0).otherwise(F.log1p(-d / n)),
        "__z": F.when(out_all, 1).otherwise(0),
        "cumhaz": d / n,
        "__gw": F.when(out_all, 0.0).otherwise(d / (n * (n - d))),
    }
    own = {f"{k}_own": v for k, v in terms.items()}
    s = keep(s.withColumns(own))
    s = running_sum(s, keys, ["time"], {k: f"{k}_own" for k in terms})
    surv = F.when(F.col("__z") > 0, 0.0).otherwise(F.exp("__ls"))
    before = F.when(F.col("__z") - F.col("__z_own") > 0, 0.0).otherwise(F.exp(F.col("__ls") - F.col("__ls_own")))
    se = F.when(F.col("__z") == 0, F.sqrt("__gw"))
    return s.select(
        *by,
        "time",
        "n_risk",
        F.col("d").alias("n_event"),
        (F.col("ext") - F.col("d")).alias("n_censor"),
        surv.alias("surv"),
        before.alias("surv_before"),
        "cumhaz",
        se.alias("std_err"),
        F.exp(F.col("__ls") - F.lit(level) * se).alias("lower"),
        F.when(F.col("__z") == 0, F.least(F.lit(1.0), F.exp(F.col("__ls") + F.lit(level) * se))).alias("upper"),
    )


def nelson_aalen(spells: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    """Cumulative hazard ``sum d/n`` per stratum."""
    return km(spells, by, **kw).select(*by, "time", "n_risk", "n_event", "cumhaz")


def competing_curves(
    spells: DataFrame,
    by: Sequence[str] = (),
    *,
    causes: Sequence[str],
    cause: str = "cause",
    entry: str = "entry_age",
    exit: str = "exit_age",
    weight: str | None = None,
    initial: str = "healthy",
    cell_width: float = 0.25,
) -> DataFrame:
    """Aalen-Johansen state probabilities and transition hazards, one row per state and time.

    Columns: strata, time, n_risk, state, n_event, pstate, cumhaz. The initial state carries
    ``pstate`` = probability of no event yet and a NULL hazard.
    """
    spells, keys = _strata(spells, by)
    names = {f"d{i}": F.col(cause) == c for i, c in enumerate(causes)}
    s = sweep(spells, keys, entry=entry, exit=exit, event=F.col(cause).isin(*causes), weight=weight,
              causes=names, cell_width=cell_width)
    s = running_sum(s, keys, ["time"], {"n_risk": F.col("ent") - F.col("ext")}, inclusive=False)
    s = s.filter(F.col("ext") > 0)
    d, n = F.col("d").cast("double"), F.col("n_risk").cast("double")
    out_all = d >= n * (1 - 1e-12)
    s = s.withColumn("__ls_own", F.when(out_all, 0.0).otherwise(F.log1p(-d / n))).withColumn(
        "__z_own", F.when(out_all, 1).otherwise(0))
    s = running_sum(keep(s), keys, ["time"], {"__ls": "__ls_own", "__z": "__z_own"})
    before = F.when(F.col("__z") - F.col("__z_own") > 0, 0.0).otherwise(F.exp(F.col("__ls") - F.col("__ls_own")))
    s = s.withColumn("__before", before).withColumn("__surv", F.when(F.col("__z") > 0, 0.0).otherwise(F.exp("__ls")))
    sums = {}
    for k in names:
        sums[f"p_{k}"] = F.col("__before") * F.col(k).cast("double") / n
        sums[f"h_{k}"] = F.col(k).cast("double") / n
    s = running_sum(keep(s), keys, ["time"], sums)
    null = F.lit(None).cast("double")
    states = [F.struct(F.lit(initial).alias("state"), (F.col("d") * 0).alias("n_event"),
                       F.col("__surv").alias("pstate"), null.alias("cumhaz"))]
    states += [
        F.struct(F.lit(c).alias("state"), F.col(f"d{i}").alias("n_event"), F.col(f"p_d{i}").alias("pstate"),
                 F.col(f"h_d{i}").alias("cumhaz"))
        for i, c in enumerate(causes)
    ]
    return s.select(*by, "time", "n_risk", F.inline(F.array(*states)))


def transition_hazards(spells: DataFrame, by: Sequence[str] = (), *, initial: str = "healthy", **kw) -> DataFrame:
    """Cumulative hazard of every transition, with the naive ``1 - exp(-H)`` incidence."""
    out = competing_curves(spells, by, initial=initial, **kw).filter(F.col("cumhaz").isNotNull())
    return out.select(
        *by, "time", F.lit(initial).alias("from"), F.col("state").alias("to"), "cumhaz",
        (F.lit(1.0) - F.exp(-F.col("cumhaz"))).alias("naive_incidence"),
    )


def parse_transition(df: DataFrame, states: Sequence[str], col: str = "transition") -> DataFrame:
    """Split a transition code like ``1.2`` into state names."""
    names = F.array(*[F.lit(s) for s in states])
    part = lambda i: F.split_part(F.col(col), F.lit("."), F.lit(i)).cast("int")
    return df.withColumn("from", F.element_at(names, part(1))).withColumn(
        "to", F.element_at(names, part(2))).drop(col)


def residual_expectancy(
    curve: DataFrame,
    ages: Sequence[float],
    by: Sequence[str] = (),
    *,
    max_age: float | None = None,
    time: str = "time",
    surv: str = "surv",
    cell_width: float = 0.25,
) -> DataFrame:
    """Expected end time given survival past each age (columns: strata, age, expectancy).

    Between curve times the expectation is interpolated linearly; below the first
    time it is the full expectation; past the last time with positive survival it
    is NULL. ``max_age`` closes the curve with survival zero at that age. A curve
    with a single usable time keeps that time's value up to ``max_age``.
    """
    curve, keys = _strata(curve, by)
    k = curve.select(*keys, F.col(time).cast("double").alias("t"), F.col(surv).cast("double").alias("s"))
    k = k.filter(F.col("s").isNotNull())
    if max_age is not None:
        close = k.select(*keys).distinct().withColumn("t", F.lit(float(max_age))).withColumn("s", F.lit(0.0))
        k = k.filter(F.col("t") < max_age).unionByName(close)
    k = with_cell(k, "t", cell_width)
    k = neighbours(keep(k), keys, ["t"], lead={"t2": "t", "s2": "s"})
    k = k.withColumn("a", F.when(F.col("t2").isNull(), 0.0).otherwise(F.col("t2") * (F.col("s") - F.col("s2"))))
    k = keep(running_sum(keep(k), keys, ["t"], {"acc": "a"}, descending=True))
    e1 = F.when(F.col("s") > 0, F.col("acc") / F.col("s"))
    e2 = F.when(F.col("s2") > 0, (F.col("acc") - F.col("a")) / F.col("s2"))
    k = k.select(*keys, "t", "t2", "s", "acc", e1.alias("e1"), e2.alias("e2"))

    grid = F.array(*[F.lit(float(x)) for x in ages])
    stats = k.groupBy(*keys).agg(
        F.min_by(F.struct("t", "s", "acc"), "t").alias("f"),
        F.count("e1").alias("usable"),
        F.max("t").alias("t_max"),
        F.max("e1").alias("only"),
    )
    full = F.col("f.t") * (F.lit(1.0) - F.col("f.s")) + F.col("f.acc")
    wanted = stats.select(
        *keys, F.explode(grid).alias("age"), F.col("f.t").alias("t_min"), "t_max", full.alias("full"), "usable", "only"
    )
    inside = F.filter(
        grid, lambda x: (x >= F.col("t")) & F.when(F.col("t2").isNull(), x == F.col("t")).otherwise(x < F.col("t2"))
    )
    slope = (F.col("age") - F.col("t")) / (F.col("t2") - F.col("t"))
    value = F.when(F.col("age") == F.col("t"), F.col("e1")).otherwise(
        F.col("e1") + (F.col("e2") - F.col("e1")) * slope)
    hits = k.select("*", F.explode(inside).alias("age")).select(*keys, "age", value.alias("value"))
    out = wanted.join(hits, [*keys, "age"], "left")
    result = (
        F.when(F.col("age") < F.col("t_min"), F.col("full"))
        .when((F.col("usable") < 2) & (F.col("age") < F.col("t_max")), F.col("only"))
        .when(F.col("usable") >= 2, F.col("value"))
    )
    return out.select(*by, "age", result.alias("expectancy"))


def disease_free_years(curve: DataFrame, ages: Sequence[float], by: Sequence[str] = (), *, max_age: float = 100.0,
                       limits: bool = False, **kw) -> DataFrame:
    """Residual expectancy minus age, optionally also for the confidence limits."""
    curve = keep(curve)
    columns = {"disfle": "surv", **({"disfle_up": "upper", "disfle_dn": "lower"} if limits else {})}
    out = None
    for name, source in columns.items():
        part = residual_expectancy(curve, ages, by, max_age=max_age, surv=source, **kw)
        part = part.select(*by, "age", (F.col("expectancy") - F.col("age")).alias(name))
        out = part if out is None else out.join(part, [*by, "age"], "left")
    return out


def with_each(df: DataFrame, small: DataFrame, most: int = 4096) -> DataFrame:
    """Every row of ``df`` with every row of a parameter table (risk groups, regions, profiles) of at most ``most`` rows.

    The parameters are read, their number is checked, and each row of ``df`` unfolds them from a literal array
    where it lies: no join, no shuffle.
    """
    rows = small.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} parameter rows")
    kinds = {f.name: f.dataType for f in small.schema.fields}
    each = [F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in kinds.items()]) for r in rows]
    if not each:
        return df.filter(F.lit(False)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    return df.select("*", F.inline(F.array(*each)))


def scaled_hazard(curve: DataFrame, factors: DataFrame, factor: str = "estimate") -> DataFrame:
    """Curves with the hazard multiplied by each factor: ``exp(-H * factor)``."""
    out = with_each(curve, factors)
    return out.withColumn("cumhaz", F.col("cumhaz") * F.col(factor)).withColumn("surv", F.exp(-F.col("cumhaz")))


def thin_curve(curve: DataFrame, by: Sequence[str], per_unit: float, time: str = "time") -> DataFrame:
    """First point of every ``1 / per_unit`` slice of time, per stratum."""
    slot = F.floor(F.col(time) * F.lit(float(per_unit)))
    rest = [c for c in curve.columns if c not in by]
    row = F.min_by(F.struct(*rest), F.col(time)).alias("__r")
    return curve.groupBy(*by, slot.alias("__slot")).agg(row).select(*by, *[F.col(f"__r.{c}").alias(c) for c in rest])


def step_lookup(curve: DataFrame, levels: Sequence[float], *, value: str = "surv", before: str = "surv_before",
                time: str = "time", by: Sequence[str] = ()) -> DataFrame:
    """Time belonging to the largest curve value not above each level.

    A falling curve answers each level in exactly one of its steps
    ``[surv, surv_before)``; levels outside the curve's range give NULL.
    """
    curve, keys = _strata(keep(curve), by)
    grid = F.array(*[F.lit(float(x)) for x in levels])
    first = curve.groupBy(*keys).agg(F.max(value).alias("__top"))
    hits = curve.select(
        *keys, F.col(time).alias("time"),
        F.explode(F.filter(grid, lambda q: (q >= F.col(value)) & (q < F.col(before)))).alias("level"),
    )
    wanted = first.select(*keys, "__top", F.explode(grid).alias("level"))
    out = wanted.join(hits, [*keys, "level"], "left")
    return out.select(*by, "level", F.when(F.col("level") <= F.col("__top"), F.col("time")).alias("time"))


def survival_quantiles(curve: DataFrame, n: int = 30) -> DataFrame:
    """Cut times at which survival passes ``n`` even levels, both ends left out."""
    levels = [i / (n - 1) for i in range(n)][1:-1]
    return step_lookup(curve.filter(F.col("n_event") > 0), levels)


def life_table_curve(table: DataFrame, by: Sequence[str], *, age: str = "age", lx: str = "lx", min_age: int = 50) -> DataFrame:
    """Survival curve of a mortality table, conditional on reaching ``min_age``."""
    old = table.filter(F.col(age) >= min_age)
    top = old.groupBy(*by).agg(F.max(lx).alias("__top"))
    return old.join(top, list(by)).select(*by, F.col(age).cast("double").alias("time"),
                                          (F.col(lx) / F.col("__top")).alias("surv"))


def curve_wide(curve: DataFrame, on: Sequence[str], key: str, values: Sequence[str], value: str) -> DataFrame:
    """Long to wide with the column values given, so no extra pass has to find them."""
    return curve.groupBy(*on).pivot(key, list(values)).agg(F.first(value, ignorenulls=True))


__all__ = [
    "km", "nelson_aalen", "competing_curves", "transition_hazards", "parse_transition", "residual_expectancy",
    "disease_free_years", "with_each", "scaled_hazard", "thin_curve", "step_lookup", "survival_quantiles",
    "life_table_curve", "curve_wide", "sweep",
]

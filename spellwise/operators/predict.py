"""Predictions and checks of Cox models."""

from __future__ import annotations

import json
from collections.abc import Hashable, Mapping, Sequence
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.functions import right_closed_cut, sum_of
from spellwise.operators.cox import CoxFit, Design, _tie_sums
from spellwise.operators.curves import at_time, km, with_each
from spellwise.operators.linear import root
from spellwise.operators.ordered import CELL, keep, running_min, running_sum, with_cell

K = TypeVar("K", bound=Hashable)


def linear_predictor(fit: CoxFit, reference: str = "zero") -> Column:
    """``x b``, or ``(x - mean) b`` with ``reference="sample"``."""
    b = fit.filled()
    parts = [c * F.lit(float(b[i])) for i, c in enumerate(fit.design.terms.values()) if b[i] != 0]
    lp = sum_of(parts)
    return lp if reference == "zero" else lp - F.lit(float(b @ fit.means))


#: Products up to which an error is written out as one expression; beyond, it is folded over an array.
WRITTEN_OUT = 400


def standard_error(d: Design, vcov: np.ndarray, center: np.ndarray) -> Column:
    """``sqrt((x - c)' V (x - c))`` from a factor ``V = R R'``: the root of a sum of squares, one per column of ``R``."""
    r = root(vcov)
    used = np.flatnonzero(np.abs(r).sum(axis=1) > 0)
    if not len(used):
        return F.lit(0.0)
    terms = list(d.terms.values())
    x = [terms[i].cast("double") - F.lit(float(center[i])) if center[i] else terms[i].cast("double") for i in used]
    if r.shape[1] * len(used) <= WRITTEN_OUT:
        parts = [sum_of([c * F.lit(float(v)) for c, v in zip(x, r[used, k]) if v]) for k in range(r.shape[1])]
        return F.sqrt(sum_of([q * q for q in parts]))
    factor = F.from_json(F.lit(json.dumps(r[used].T.tolist())), "array<array<double>>")  # folded to one literal
    values = F.array(*x)
    dot = lambda row: F.aggregate(F.zip_with(values, row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.aggregate(F.transform(factor, dot), F.lit(0.0), lambda s, q: s + q * q))


def predict(
    df: DataFrame, fit: CoxFit, type: str = "lp", *, reference: str = "zero", se: bool = False,
    baseline: DataFrame | None = None, entry: str | None = None, exit: str = "exit_age", out: str = "fit",
) -> DataFrame:
    """Add predictions: ``lp``, ``risk``, ``terms`` (one column per factor), ``expected``, ``survival``.

    The error of a risk is ``se * sqrt(risk)``, as the reference defines it. Expected
    counts and survival need a ``baseline`` (time, cumhaz); a missing ``entry`` means zero.
    """
    d = fit.design
    center = np.zeros(len(d.names)) if reference == "zero" else fit.means
    if type in ("lp", "risk"):
        lp = linear_predictor(fit, reference)
        res = df.withColumn(out, lp if type == "lp" else F.exp(lp))
        if se:
            s = standard_error(d, fit.vcov, center)
            res = res.withColumn("se_" + out, s if type == "lp" else s * F.sqrt(out))
        return res
    if type == "terms":
        b = fit.filled()
        groups: dict[str, list[int]] = {}
        for i, n in enumerate(d.names):
            groups.setdefault(d.group.get(n, n), []).append(i)
        cols = list(d.terms.values())
        new = {f"{out}_{g}": sum_of([(cols[i] - float(center[i])) * F.lit(float(b[i])) for i in idx]) for g, idx in groups.items()}
        return df.withColumns(new)
    if type in ("expected", "survival"):
        if baseline is None:
            raise ValueError("expected and survival need a baseline")
        risk = F.exp(linear_predictor(fit))
        res = step_value(df, baseline, exit, "cumhaz", "__h1")
        h0 = F.lit(0.0)
        if entry is not None:
            res = step_value(res, baseline, entry, "cumhaz", "__h0")
            h0 = F.col("__h0")
        expected = (F.col("__h1") - h0) * risk
        res = res.withColumn(out, expected if type == "expected" else F.exp(-expected))
        return res.drop("__h0", "__h1")
    raise ValueError(type)


def collapse(df: DataFrame, key: str, fit: str = "fit", se: str | None = None) -> DataFrame:
    """Predictions summed per person, errors as root of summed squares."""
    aggs = [F.sum(fit).alias(fit)]
    if se:
        aggs.append(F.sqrt(F.sum(F.col(se) * F.col(se))).alias(se))
    return df.groupBy(key).agg(*aggs)


def step_value(df: DataFrame, curve: DataFrame, at: str, value: str, out: str, *, cell_width: float = 0.25) -> DataFrame:
    """Value of a rising step curve (time, ``value``) at each row's time, 0 before its first step.

    Only the distinct times of ``df`` are lined up with the curve; the result
    comes back by an equality join on the time.
    """
    wanted = df.select(at_time(at).alias("time")).distinct().withColumn("v", F.lit(0.0)).withColumn("q", F.lit(1))
    steps = curve.select(at_time("time").alias("time"), F.col(value).alias("v"), F.lit(0).alias("q"))
    both = keep(with_cell(wanted.unionByName(steps).withColumn("v", -F.col("v")), "time", cell_width).withColumn("__all", F.lit(0)))
    low = running_min(both, ["__all"], ["time", "q"], {"m": "v"}).filter(F.col("q") == 1)
    found = low.select(F.col("time").alias("__t"), F.greatest(F.lit(0.0), -F.col("m")).alias(out))
    return df.withColumn("__t", at_time(at)).join(found, "__t", "left").drop("__t")


def baseline_hazard(
    spells: DataFrame, lp: Column, *, ties: str = "breslow", entry: str = "entry_age", exit: str = "exit_age",
    event: str | Column = "event_flag", cell_width: float = 0.25,
) -> DataFrame:
    """Cumulative baseline hazard at a given linear predictor: time, n_event, s0, dh, cumhaz."""
    return _hazards(spells, [(None, lp, event)], ties, entry, exit, cell_width).drop("__model")


def baseline_hazards(
    spells: DataFrame, lps: Mapping[K, Column], *, event: Mapping[K, str | Column], at: Mapping[K, Column] | None = None,
    ties: str = "breslow", entry: str = "entry_age", exit: str = "exit_age", cell_width: float = 0.25,
) -> dict[K, DataFrame]:
    """``baseline_hazard`` of several models in one sweep, so that ``spells`` is read (and whatever makes it is run) once.

    ``event`` tells each model's failures and ``at`` the spells at risk in it (all without ``at``). The result is settled: it
    has a row per model and distinct time.
    """
    models = [(None if at is None else at[k], lp, event[k]) for k, lp in lps.items()]
    out = keep(_hazards(spells, models, ties, entry, exit, cell_width))
    return {k: out.filter(F.col("__model") == i).drop("__model") for i, k in enumerate(lps)}


def _hazards(
    spells: DataFrame, models: Sequence[tuple[Column | None, Column, str | Column]], ties: str, entry: str, exit: str, cell_width: float,
) -> DataFrame:
    """Hazards of models (spells at risk, predictor, failures): __model (its number), time, n_event, s0, dh, cumhaz."""
    each = []
    for i, (at, lp, event) in enumerate(models):
        own = F.struct(F.lit(i).alias("__model"), F.exp(lp).alias("w"), (F.col(event) if isinstance(event, str) else event).alias("ev"))
        each.append(own if at is None else F.when(at, own))
    df = spells.filter(F.col(entry) < F.col(exit)).select(at_time(entry).alias("a"), at_time(exit).alias("b"), F.inline(F.array(*each)))
    hit = F.when(F.col("ev"), 1).otherwise(0)
    rows = df.filter("__model is not null").select("__model", F.inline(F.array(
        F.struct(F.col("a").alias("time"), F.col("w").alias("net"), F.lit(0).alias("d"), F.lit(0.0).alias("e0"), F.lit(0).alias("out")),
        F.struct(F.col("b").alias("time"), (-F.col("w")).alias("net"), hit.alias("d"), (hit * F.col("w")).alias("e0"), F.lit(1).alias("out")),
    )))
    s = with_cell(rows, "time", cell_width).groupBy("__model", CELL, "time").agg(*[F.sum(c).alias(c) for c in ("net", "d", "e0", "out")])
    s = running_sum(keep(s), ["__model"], ["time"], {"s0": "net"}, inclusive=False)
    if ties == "efron":
        @F.pandas_udf("double")
        def tied(d: pd.Series, s0: pd.Series, e0: pd.Series) -> pd.Series:
            return pd.Series([_tie_sums(k, a, e, True)[1] if k > 0 else 0.0 for k, a, e in zip(d, s0, e0)], dtype=float)

        dh = tied(F.col("d").cast("double"), F.col("s0"), F.col("e0"))
    else:
        dh = F.when(F.col("d") > 0, F.col("d") / F.col("s0")).otherwise(0.0)
    s = running_sum(keep(s.withColumn("dh", dh)), ["__model"], ["time"], {"cumhaz": F.col("dh")})
    return s.filter(F.col("out") > 0).select("__model", "time", F.col("d").alias("n_event"), "s0", "dh", "cumhaz")


def path_survival(
    baseline: DataFrame, profiles: DataFrame, keys: Sequence[str], lp: Column, *, group: Column | None = None,
    group_col: str = "tgroup", cell_width: float = 0.25,
) -> DataFrame:
    """Survival of each profile along its (possibly time-varying) covariate path.

    ``group`` gives the interval number of a baseline time; ``lp`` may read it. Columns:
    keys, time, cumhaz, surv.
    """
    steps = baseline.select("time", "dh")
    if group is not None:
        steps = steps.withColumn(group_col, group)
    both = with_each(steps, profiles)
    both = with_cell(both.withColumn("own", F.col("dh") * F.exp(lp)), "time", cell_width)
    out = running_sum(keep(both.select(*keys, CELL, "time", "own")), list(keys), ["time"], {"cumhaz": "own"})
    return out.select(*keys, "time", "cumhaz", F.exp(-F.col("cumhaz")).alias("surv"))


def schoenfeld_sums(
    spells: DataFrame, d: Design, lp: Column, *, entry: str = "entry_age", exit: str = "exit_age",
    event: str = "event_flag", cell_width: float = 0.25,
) -> DataFrame:
    """Residuals summed over the failures of each time: time, term, n_event, residual (Breslow risk sets)."""
    xs = range(len(d.names))
    base = spells.filter(F.col(entry) < F.col(exit)).select(
        F.col(entry).alias("a"), F.col(exit).alias("b"), F.when(F.col(event), 1).otherwise(0).alias("ev"), F.exp(lp).alias("w"),
        *[c.alias(f"x{i}") for i, c in enumerate(d.terms.values())])

    def piece(t, sign, ev):
        return F.struct(
            at_time(t).alias("time"), (F.col("w") * sign).alias("net"), ev.alias("d"),
            *[(F.col("w") * F.col(f"x{i}") * sign).alias(f"net{i}") for i in xs],
            *[(ev * F.col(f"x{i}")).alias(f"ev{i}") for i in xs])

    rows = base.select(F.inline(F.array(piece("a", 1.0, F.lit(0)), piece("b", -1.0, F.col("ev")))))
    sums = ["net", "d", *[f"net{i}" for i in xs], *[f"ev{i}" for i in xs]]
    s = with_cell(rows, "time", cell_width).groupBy(CELL, "time").agg(*[F.sum(c).alias(c) for c in sums])
    s = running_sum(keep(s.withColumn("__all", F.lit(0))), ["__all"], ["time"],
                    {"s": "net", **{f"s{i}": f"net{i}" for i in xs}}, inclusive=False).filter(F.col("d") > 0)
    return s.select("time", F.col("d").alias("n_event"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("term"), (F.col(f"ev{i}") - F.col("d") * F.col(f"s{i}") / F.col("s")).alias("residual"))
        for i, n in enumerate(d.names)])))


def concordance(
    df: DataFrame, score: str, *, entry: str = "entry_age", exit: str = "exit_age", event: str = "event_flag",
    cell_width: float = 0.25, score_cell: float = 0.01,
) -> DataFrame:
    """Concordant, discordant and tied-score pairs of a failing person and those then at risk.

    Scores are ranked and every rank is written in binary: a lower score first differs from
    a higher one at exactly one bit, so summing over bits, with running counts over time inside the
    sibling block of each bit, counts every pair once. No pair is ever formed, and rows
    are merged per (bit, block, time) before they are ordered.
    """
    one = df.filter(F.col(entry) < F.col(exit)).select(
        at_time(entry).alias("a"), at_time(exit).alias("b"), F.col(event).alias("ev"), F.round(score, 9).alias("s"))
    # first: leaves before the failures of that time are read; late: changes seen only afterwards
    zero, one_ = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    failed = F.when(F.col("ev"), one_).otherwise(zero)
    rows = one.select("s", F.inline(F.array(
        F.struct(F.col("a").alias("time"), zero.alias("first"), one_.alias("late"), zero.alias("asks")),
        F.struct(F.col("b").alias("time"), (-failed).alias("first"), (failed - 1).alias("late"), failed.alias("asks")),
    )))
    rows = keep(with_cell(rows, "time", cell_width).groupBy("s", CELL, "time").agg(
        *[F.sum(c).alias(c) for c in ("first", "late", "asks")]))
    scores = with_cell(rows.select("s").distinct().withColumn("__all", F.lit(0)), "s", score_cell)
    ranks = running_sum(keep(scores.withColumn("one", F.lit(1))), ["__all"], ["s"], {"r": "one"})
    ranks = keep(ranks.select("s", (F.col("r") - 1).cast("bigint").alias("r")))
    bits = max(1, int(ranks.agg(F.max("r")).first()[0] or 0).bit_length())
    rows = rows.join(ranks, "s").select("r", CELL, "time", "first", "late", "asks")

    def shifted(k):
        block = F.shiftright("r", k)
        right = (block % 2) == 1
        return F.struct(F.lit(k).alias("kind"), (block - F.when(right, 1).otherwise(0)).alias("block"), right.alias("reads"))

    kinds = [shifted(k) for k in range(bits)]
    tied = F.struct(F.lit(-1).alias("kind"), F.col("r").alias("block"), F.lit(None).cast("boolean").alias("reads"))
    every = F.struct(F.lit(-2).alias("kind"), zero.alias("block"), F.lit(None).cast("boolean").alias("reads"))
    long = rows.select(CELL, "time", "first", "late", "asks", F.inline(F.array(*kinds, tied, every)))
    asks = F.when(F.coalesce("reads", F.lit(True)), F.col("asks")).otherwise(zero)
    gives = ~F.coalesce("reads", F.lit(False))
    long = long.groupBy("kind", "block", CELL, "time").agg(
        F.sum(F.when(gives, F.col("first")).otherwise(zero)).alias("first"),
        F.sum(F.when(gives, F.col("late")).otherwise(zero)).alias("late"), F.sum(asks).alias("asks"))
    long = running_sum(keep(long), ["kind", "block"], ["time"], {"before": F.col("first") + F.col("late")}, inclusive=False)
    pairs = F.col("asks").cast("decimal(20,0)") * (F.col("before") + F.col("first")).cast("decimal(18,0)")
    total = long.groupBy(F.when(F.col("kind") >= 0, "conc").when(F.col("kind") == -1, "tied").otherwise("all").alias("what")).agg(
        F.sum(pairs).alias("n"))
    pick = lambda w: F.coalesce(F.max(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).cast("double")
    t = total.agg(pick("conc").alias("concordant"), pick("tied").alias("tied_score"), pick("all").alias("pairs"))
    disc = F.col("pairs") - F.col("concordant") - F.col("tied_score")
    return t.select("concordant", disc.alias("discordant"), "tied_score",
                    ((F.col("concordant") + F.col("tied_score") / 2) / F.col("pairs")).alias("concordance"))


def risk_groups(split: DataFrame, lp: str, breaks: Sequence[float], *, entry: str = "entry_age", exit: str = "exit_age",
                event: str = "event_flag", key: str = "id") -> DataFrame:
    """One row per person: span, event, mean, least and greatest linear predictor, and the risk group of the mean.

    The mean is rounded, so that a sum lying on a break on paper falls on its closed side.
    """
    g = split.groupBy(key).agg(
        F.min(entry).alias(entry), F.max(exit).alias(exit), F.max(event).alias(event), F.max(lp).alias("lp_max"),
        F.min(lp).alias("lp_min"), F.round(F.avg(lp), 9).alias("lp"))
    return g.withColumn("risk_group", right_closed_cut("lp", breaks))


def calibration(persons: DataFrame, baseline: DataFrame, **kw) -> DataFrame:
    """Observed curve per risk group next to the baseline curve scaled with the group's mean predictor.

    Columns: origin, risk_group, time, cumhaz, surv.
    """
    observed = km(persons, ["risk_group"], **kw).select(F.lit("observed").alias("origin"), "risk_group", "time", "cumhaz", "surv")
    mean = persons.groupBy("risk_group").agg(F.avg("lp").alias("lp"))
    pred = with_each(baseline.select("time", "cumhaz"), mean)
    h = F.col("cumhaz") * F.exp("lp")
    return observed.unionByName(pred.select(F.lit("predicted").alias("origin"), "risk_group", "time", h.alias("cumhaz"), F.exp(-h).alias("surv")))


def cause_specific_curves(
    baselines: dict[str, DataFrame], lps: dict[str, Column], profiles: DataFrame, keys: Sequence[str], *, cell_width: float = 0.25
) -> DataFrame:
    """State probabilities per profile from one fitted hazard per cause.

    At each time the probability of being free of events shrinks by ``exp(-a)``, ``a`` being the summed
    increments, and the loss is shared among causes in proportion to their increments.
    Columns: keys, time, surv, and one ``cif_<cause>`` each.
    """
    steps = None
    for k, b in baselines.items():
        part = b.filter(F.col("dh") > 0).select("time", F.lit(k).alias("cause"), "dh")
        steps = part if steps is None else steps.unionByName(part)
    both = with_each(steps, profiles)
    lp = F.lit(None).cast("double")
    for k, c in lps.items():
        lp = F.when(F.col("cause") == k, c).otherwise(lp)
    both = both.withColumn("a", F.col("dh") * F.exp(lp))
    wide = with_cell(both, "time", cell_width).groupBy(*keys, CELL, "time").agg(
        F.sum("a").alias("a"), *[F.sum(F.when(F.col("cause") == k, F.col("a")).otherwise(0.0)).alias(f"a_{k}") for k in baselines])
    wide = running_sum(keep(wide), list(keys), ["time"], {"h": "a"})
    before = F.exp(F.col("a") - F.col("h"))
    gain = before * (F.lit(1.0) - F.exp(-F.col("a"))) / F.col("a")
    wide = keep(wide.withColumns({f"g_{k}": gain * F.col(f"a_{k}") for k in baselines}))
    out = running_sum(wide, list(keys), ["time"], {f"cif_{k}": f"g_{k}" for k in baselines})
    return out.select(*keys, "time", F.exp(-F.col("h")).alias("surv"), *[f"cif_{k}" for k in baselines])


def effect_grid(profiles: DataFrame, fit: CoxFit, times: Sequence[float], group_col: str = "tgroup") -> DataFrame:
    """Relative risks of profiles over the time grid with ``± 1.96 se`` limits (columns fit, se_fit, fit_up, fit_dn)."""
    grid = F.array(*[F.struct(F.lit(i).alias(group_col), F.lit(float(t)).alias("times")) for i, t in enumerate(times, start=1)])
    rows = profiles.select("*", F.inline(grid))
    out = predict(rows, fit, "risk", se=True, out="fit")
    return out.withColumns({"fit_up": F.col("fit") + 1.96 * F.col("se_fit"), "fit_dn": F.col("fit") - 1.96 * F.col("se_fit")})


def expectancy_model(table: DataFrame, d: Design, label: str) -> DataFrame:
    """Least-squares summary of expectancies by profile: term, estimate."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = table.select(F.col(label).alias("label"), array_to_vector(d.x()).alias("features"))
    m = LinearRegression(solver="normal", standardization=False).fit(data)
    rows = [("(Intercept)", float(m.intercept)), *[(n, float(c)) for n, c in zip(d.names, m.coefficients)]]
    return table.sparkSession.createDataFrame(rows, "term string, estimate double")

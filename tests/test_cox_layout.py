"""Risk tables by covariate pattern, times shared by partitions, rank decisions and the driver's algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from spellwise.functions.splines import natural_spline, spline_values
from spellwise.operators import cox as M
from spellwise.operators.linear import Factor, independent, product, root


def crowd(spark, n=400, seed=5):
    """Two exit times hold nearly all rows, a numeric covariate makes every row a pattern of its own."""
    rng = np.random.default_rng(seed)
    sex, z = rng.choice(["F", "M"], n), np.round(rng.normal(size=n), 3)
    exit_ = rng.choice([3.0, 3.0, 3.0, 7.0, 1.0, 5.0], n)
    entry, event = np.where(exit_ > 3, rng.choice([0.0, 2.0, 3.0], n), 0.0), rng.random(n) < 0.4
    rows = [(str(s), float(a), float(b), float(c), bool(e)) for s, a, b, c, e in zip(sex, z, entry, exit_, event)]
    df = spark.createDataFrame(rows, "sex string, z double, entry_age double, exit_age double, event_flag boolean")
    return df, np.column_stack([sex == "M", z]).astype(float), entry, exit_, event


def plain(x, entry, exit_, event, b):
    ll, u, info, w = 0.0, np.zeros(len(b)), np.zeros((len(b), len(b))), np.exp(x @ b)
    for t in np.unique(exit_[event]):
        at, dead = (entry < t) & (exit_ >= t), (exit_ == t) & event
        for k in range(dead.sum()):
            ww = np.where(at, w, 0) - k / dead.sum() * np.where(dead, w, 0)
            s0, s1 = ww.sum(), ww @ x
            ll, u = ll - np.log(s0), u - s1 / s0
            info += x.T @ (ww[:, None] * x) / s0 - np.outer(s1, s1) / s0**2
        ll, u = ll + (x[dead] @ b).sum(), u + x[dead].sum(0)
    return ll, u, info


@pytest.mark.parametrize("small", [False, True])
def test_a_time_shared_by_many_partitions(spark, monkeypatch, small):
    df, x, entry, exit_, event = crowd(spark)
    if small:  # model columns for a few rows at a time
        monkeypatch.setattr(M, "ROWS", 7)
        monkeypatch.setattr(M, "HELD", 0)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        risk = M.risk_table(df, M.design({"sex": ["F", "M"]}, numeric=["z"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    spans = [(r["a"], r["b"]) for r in risk.rows.groupBy(F.spark_partition_id()).agg(F.min("time").alias("a"), F.max("time").alias("b")).collect()]
    assert sum(a <= 3.0 <= b for a, b in spans) > 2  # the hot time is cut
    b = np.array([0.3, -0.2])
    ll, u, info = M.cox_pass(risk, b)
    want = plain(x, entry, exit_, event, b)
    assert ll == pytest.approx(want[0]) and np.allclose(u, want[1]) and np.allclose(info, want[2])


def test_rows_carry_no_model_columns(spark):
    df = crowd(spark)[0]
    risk = M.risk_table(df, M.design({"sex": ["F", "M"]}, numeric=["z"]))
    assert not [f for f in risk.rows.schema.fields if isinstance(f.dataType, ArrayType)]
    assert set(risk.rows.columns) == {"__cell", "time", "n_in", "n_out", "n_ev", "sex", "z"}
    assert M.risk_table(df, M.design({"sex": ["F", "M"]})).rows.agg(F.max("n_out")).first()[0] > 50  # equal rows are merged
    with pytest.raises(ValueError):
        M.risk_table(df, M.Design({"z": F.col("z")}, ["z"]))


def test_aliased_columns_are_named_and_the_score_is_zero(spark):
    df = crowd(spark)[0].withColumn("twin", F.col("sex")).withColumn("half", F.col("z") * 2)
    d = M.design({"sex": ["F", "M"], "twin": ["F", "M", "X"]}, numeric=["z", "half"])
    fit = M.cox_fit(df, d, eps=1e-12)
    assert fit.aliased == ["twinM", "twinX", "half"] and fit.converged
    kept = [i for i, n in enumerate(d.names) if n not in fit.aliased]
    assert np.abs(fit.final_score[kept]).max() < 1e-6
    assert np.isfinite(fit.vcov).all() and (np.diag(fit.vcov)[kept] > 0).all()


def test_the_interval_alone_is_aliased(spark):
    from spellwise.operators.spells import interval_split

    df = crowd(spark)[0].withColumn("id", F.monotonically_increasing_id())
    d = M.design({"sex": ["F", "M"]}, spline=("tgroup", [1.0, 2.0, 4.0]), spline_with=["sex"])
    fit = M.cox_fit(interval_split(df, [2.0, 4.0, 6.0]), d)
    assert fit.aliased[:2] == ["tgroup_s1", "tgroup_s2"] and np.isfinite(fit.coef[0])


def test_factor_solves_inverts_and_finds_the_rank():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 12)) * 10.0 ** rng.integers(-4, 5, 12)
    a = x.T @ x
    f = Factor(a)
    assert f.rank == 12 and np.allclose(product(f.inverse(), a), np.eye(12), atol=1e-6)
    b = rng.normal(size=(12, 3))
    assert np.allclose(a @ f.solve(b), b, atol=1e-6 * np.abs(b).max()) and f.quadratic(b[:, 0]) == pytest.approx(b[:, 0] @ np.linalg.solve(a, b[:, 0]))
    r = root(a)
    assert np.allclose(r @ r.T, a)
    twice = np.column_stack([x[:, :3], x[:, 0], x[:, 3:5], x[:, 1] + x[:, 3], np.zeros(200)])
    assert independent(twice.T @ twice).tolist() == [0, 1, 2, 4, 5] and Factor(twice.T @ twice, tol=1e-10).rank == 5
    # an entry that is a difference of large sums is known to their rounding only
    assert independent(np.diag([1.0, 1e-4]), np.array([1.0, 1e6])).tolist() == [0]


def test_spline_values_equal_the_columns(spark):
    knots = [1.0, 4.0, 9.0, 20.0]
    x = [-3.0, 0.5, 1.0, 2.5, 4.0, 8.9, 9.0, 19.0, 20.0, 25.0]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", *[c.alias(f"s{i}") for i, c in enumerate(natural_spline("x", knots))])
    want = {r["x"]: [r[f"s{i}"] for i in range(3)] for r in df.collect()}
    assert np.allclose(spline_values(np.array(x), knots), [want[v] for v in x])


def test_the_ledger_has_the_times_left_out(spark):
    df, x, entry, exit_, event = crowd(spark, 60)
    df = df.withColumn("grp", F.when(F.col("exit_age") < 5, "a").otherwise("b"))
    effects, ledger = M.additive_model(df, M.design({"grp": ["a", "b"]}), nmin=4)
    out = {r["time"]: r["reason"] for r in ledger.collect()}
    # from 5 on only group b is at risk
    assert set(out) == {t for t in (5.0, 7.0) if (event & (exit_ == t)).any()} and set(out.values()) <= {"singular", "few"}
    assert {r["time"] for r in effects.collect()} | set(out) == set(exit_[event])

"""Worked examples of the residual expectancy, with exact distributions instead of samples."""

import pytest

from spellwise.operators.curves import residual_expectancy


def expect(spark, points, ages, **kw):
    """``points``: (value, probability) of a discrete distribution."""
    s, rows = 1.0, []
    for t, p in sorted(points):
        s -= p
        rows.append((float(t), max(round(s, 12), 0.0)))
    df = spark.createDataFrame(rows, "time double, surv double")
    return {r["age"]: r["expectancy"] for r in residual_expectancy(df, [float(a) for a in ages], **kw).collect()}


def test_uniform_on_three_points(spark):
    e = expect(spark, [(0, 1 / 3), (1, 1 / 3), (2, 1 / 3)], [-1, 0, 0.5, 1, 1.5, 2, 3])
    assert e[-1.0] == pytest.approx(1.0)
    assert e[0.0] == pytest.approx(1.5)
    assert e[0.5] == pytest.approx(1.75)
    assert e[1.0] == pytest.approx(2.0)
    assert e[1.5] is None and e[2.0] is None and e[3.0] is None


def test_two_points(spark):
    e = expect(spark, [(1, 0.9), (100, 0.1)], [-1, 0, 1, 50, 100, 120])
    assert e[-1.0] == pytest.approx(10.9) and e[0.0] == pytest.approx(10.9)
    assert e[1.0] == pytest.approx(100) and e[50.0] == pytest.approx(100)
    assert e[100.0] is None and e[120.0] is None


def test_three_points(spark):
    e = expect(spark, [(1, 0.9), (2, 0.05), (100, 0.05)], [-1, 0, 1, 2])
    assert e[-1.0] == pytest.approx(6.0) and e[0.0] == pytest.approx(6.0)
    assert e[1.0] == pytest.approx(51) and e[2.0] == pytest.approx(100)


def test_uniform_on_integers(spark):
    e = expect(spark, [(k, 1 / 201) for k in range(-100, 101)], [-150, *range(-100, 100, 7)])
    assert e[-150.0] == pytest.approx(0.0, abs=1e-9)
    for z in range(-100, 100, 7):
        assert e[float(z)] == pytest.approx((z + 1 + 100) / 2, rel=1e-8)


def test_closing_at_a_maximum_age(spark):
    df = spark.createDataFrame([("F", 60.0, 0.8), ("F", 70.0, 0.5), ("F", 110.0, 0.2)], "sex string, time double, surv double")
    e = {r["age"]: r["expectancy"] for r in residual_expectancy(df, [50.0, 60.0, 70.0, 100.0], ["sex"], max_age=100.0).collect()}
    assert e[50.0] == pytest.approx(60 * 0.2 + 70 * 0.3 + 100 * 0.5)
    assert e[60.0] == pytest.approx((70 * 0.3 + 100 * 0.5) / 0.8)
    assert e[70.0] == pytest.approx(100.0)
    assert e[100.0] is None

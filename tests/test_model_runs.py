"""Fitted models without an oracle text run on the small tables and give finite, converged results."""

import math
import os

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize(("name", "rows"), [("cox_time_varying", 4), ("cox_cause_specific", 6), ("cox_coefficients", 55), ("cox_age_varying", 119)])
def test_fits(spark, name, rows):
    out = queries()[name](spark, SF).collect()
    assert len(out) == rows and all(r["converged"] for r in out)
    assert all(r["estimate"] is None or math.isfinite(r["estimate"]) for r in out)


def test_cause_specific_curves(spark):
    out = queries()["cause_specific_curves"](spark, SF)
    sums = out.selectExpr(*[f"max({c})" for c in out.columns if c.startswith("cif")]).first()
    assert all(0 <= v <= 1 for v in sums)


def test_additive_effects(spark):
    assert {r["term"] for r in queries()["additive_effects"](spark, SF).select("term").distinct().collect()} == {
        "Intercept", "sexM", "smoker_cat31", "smoker_cat32"}


@pytest.mark.parametrize("name", ["age_effect_grid", "interaction_grid"])
def test_effect_grids(spark, name):
    out = queries()[name](spark, SF).collect()
    assert out and all(math.isfinite(r["fit"]) and r["fit_dn"] <= r["fit"] <= r["fit_up"] for r in out)


def test_ph_tests(spark):
    out = queries()["ph_test"](spark, SF).collect()
    assert {r["model"] for r in out} == {"constant", "age_varying"} and all(r["converged"] and r["chisq"] >= 0 for r in out)
    assert {r["factor"] for r in out} >= {"sex", "dep", "GLOBAL"}


def test_survival_cut_model(spark):
    out = queries()["survival_cut_model"](spark, SF).collect()
    assert any(r["estimate"] is None for r in out) and any(r["std_error"] for r in out)

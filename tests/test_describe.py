"""Descriptive operators against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spellwise.operators import describe as D


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 501, p=[0.9, 0.1]), "v": rng.integers(0, 60, 501) / 4.0})
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in D.exact_quantiles(spark.createDataFrame(pdf), "v", probs, ["g"], cell_width=2.0).collect()}
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(np.quantile(part["v"], p))


def test_p_value(spark):
    df = spark.createDataFrame([(0.0,), (1.959963984540054,), (-2.5758293035489004,)], "z double")
    got = [r[0] for r in df.select(D.two_sided_p("z")).collect()]
    assert np.allclose(got, [1.0, 0.05, 0.01], atol=2e-7)


def test_constancy(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (2, "y", 3), (2, "y", 3)], "id int, a string, b int")
    assert {r["attribute"]: r["constant"] for r in D.constancy_check(df, "id", ["a", "b"]).collect()} == {"a": True, "b": False}


def test_histogram_of_negative_values(spark):
    df = spark.createDataFrame([(-0.5,), (0.0,), (0.9,), (1.0,)], "x double")
    assert {r["bin"]: r["n"] for r in D.histogram(df, F.col("x"), 1.0).collect()} == {-1.0: 1, 0.0: 2, 1.0: 1}

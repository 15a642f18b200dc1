"""Two-level ordered operators against pandas, with cells from one row to everything."""

import numpy as np
import pandas as pd
import pytest

from spellwise.operators import ordered as O


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 400, p=[0.7, 0.2, 0.1]), "t": rng.permutation(400) / 7.0,
                        "v": rng.integers(-5, 6, 400)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("width", [0.1, 3.0, 1000.0])
def test_running_sum_min_and_neighbours(table, width):
    pdf, df = table
    s = pdf.sort_values(["g", "t"]).reset_index(drop=True)
    by = s.groupby("g")["v"]
    x = O.with_cell(df, "t", width)

    def got(out, col):
        return out.toPandas().sort_values(["g", "t"])[col].tolist()

    assert got(O.running_sum(x, ["g"], ["t"], {"c": "v"}), "c") == by.cumsum().tolist()
    assert got(O.running_sum(x, ["g"], ["t"], {"c": "v"}, inclusive=False), "c") == (by.cumsum() - s["v"]).tolist()
    total = by.transform("sum")
    assert got(O.running_sum(x, ["g"], ["t"], {"c": "v"}, descending=True), "c") == (total - by.cumsum() + s["v"]).tolist()
    assert got(O.running_min(x, ["g"], ["t"], {"m": "v"}), "m") == by.cummin().tolist()
    out = O.neighbours(x, ["g"], ["t"], lag={"p": "v"}, lead={"n": "v"}).toPandas().sort_values(["g", "t"])
    pd.testing.assert_series_equal(out["p"].reset_index(drop=True), by.shift(1), check_names=False, check_dtype=False)
    pd.testing.assert_series_equal(out["n"].reset_index(drop=True), by.shift(-1), check_names=False, check_dtype=False)


def test_neighbours_keep_nulls_apart_from_missing_rows(spark):
    df = O.with_cell(spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, None), ("a", 3.0, 7)], "g string, t double, v int"), "t", 1.0)
    out = O.neighbours(df, ["g"], ["t"], lag={"p": "v"}).orderBy("t").collect()
    assert [r["p"] for r in out] == [None, 5, None]


def test_first_and_last_rows(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id", "id * 2 AS x")
    assert sorted(tuple(r) for r in O.first_per(df, ["g"], ["id"]).collect()) == [(0, 0, 0), (1, 1, 2), (2, 2, 4)]
    out = O.last_n_per(df, ["g"], ["id"], 2)
    assert sorted(r["id"] for r in out.collect()) == [994, 995, 996, 997, 998, 999]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()

"""Event preparation and spells on hand-made logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spellwise.operators import cleaning as K
from spellwise.operators import events as V
from spellwise.operators import population as P
from spellwise.operators import quality as Q
from spellwise.operators import spells as S
from spellwise.operators.curves import km
from spellwise.operators.vocab import EventCodes

C = EventCodes("DEATH", "LOST", "NONE", "ILL")
D = dt.date


def log(spark, rows):
    return spark.createDataFrame(rows, "id int, date_event date, event string, event_censor int")


def people(spark, rows):
    return spark.createDataFrame(rows, "id int, birth_date date, sex string")


def test_censoring(spark):
    d = D(2012, 12, 31)
    one = dt.timedelta(days=1)
    x = log(spark, [(1, d - one, "A", 0), (1, d, "B", 0), (1, d + one, "C", 0), (2, d + one, "NONE", 0), (3, d, "A", 0)])
    out = sorted((r["id"], r["date_event"], r["event"], r["event_censor"]) for r in V.censor_events(x, "2012-12-31", codes=C).collect())
    assert out == sorted([(1, d - one, "A", 0), (1, d, "B", 0), (1, d, "LOST", 2), (2, d, "LOST", 2), (2, d, "NONE", 0), (3, d, "A", 0)])


def test_death_cause(spark):
    rows = [(1, 1, "A"), (1, 2, "B"), (1, 3, "DEATH"), (2, 1, "A"), (2, 2, "B"), (3, 1, "DEATH")]
    df = spark.createDataFrame(rows, "id int, t int, event string")
    assert {r["id"]: r["cause"] for r in V.death_cause(df, "DEATH", order=["t"]).collect()} == {1: "B", 2: None, 3: None}


def test_interval_split_example(spark):
    df = spark.createDataFrame([(1, 56.0, 68.0, True)], "id int, entry_age double, exit_age double, event_flag boolean")
    out = S.interval_split(df, [55, 60, 64, 70]).orderBy("entry_age").collect()
    assert [(r["entry_age"], r["exit_age"], r["event_flag"], r["tgroup"]) for r in out] == [
        (56.0, 60.0, False, 2), (60.0, 64.0, False, 3), (64.0, 68.0, True, 4)]


def test_time_varying_merge_edges(spark):
    df = spark.createDataFrame([(i, 50.0, 60.0, True) for i in range(1, 6)], "id int, entry_age double, exit_age double, event_flag boolean")
    ch = spark.createDataFrame([(1, 50.0), (2, 55.0), (2, 57.0), (3, 60.0), (4, 49.0)], "id int, age_event double")
    out = sorted((r["id"], r["entry_age"], r["exit_age"], r["event_flag"], r["on"]) for r in S.time_varying_merge(df, ch, "on").collect())
    assert out == [(1, 50.0, 60.0, True, 1), (2, 50.0, 55.0, False, 0), (2, 55.0, 60.0, True, 1), (3, 50.0, 60.0, True, 0),
                   (4, 50.0, 60.0, True, 1), (5, 50.0, 60.0, True, 0)]


def spells_of(spark, rows, births=((1, D(1950, 1, 1), "F"),), **kw):
    kw = {"targets": ["ILL"], "start": "2010-01-01", "end": "2014-01-01", **kw}
    return S.build_spells_cr(people(spark, list(births)), log(spark, rows), codes=C, **kw).collect()


def test_tie_priority(spark):
    rows = [(1, D(2011, 5, 1), "LOST", 0), (1, D(2011, 5, 1), "ILL", 0), (1, D(2011, 5, 1), "DEATH", 0)]
    assert spells_of(spark, rows)[0]["cause"] == "ILL"
    assert spells_of(spark, rows, tie_priority="reference")[0]["cause"] == "LOST"


def test_window_is_half_open_and_early_exits_are_dropped(spark):
    r = spells_of(spark, [(1, D(2014, 1, 1), "ILL", 0)])[0]
    assert (r["cause"], r["exit_date"]) == ("LOST", D(2014, 1, 1))
    assert spells_of(spark, [(1, D(2013, 12, 31), "ILL", 0)])[0]["cause"] == "ILL"
    assert spells_of(spark, [(1, D(2009, 12, 31), "LOST", 0), (1, D(2011, 1, 1), "ILL", 0)]) == []
    # An illness before the window is no reason to drop a person; the estimator refuses the row.
    early = spells_of(spark, [(1, D(2009, 6, 1), "ILL", 0)])[0]
    assert early["exit_age"] < early["entry_age"]


def test_half_day_and_entry_at_min_age(spark):
    births = [(1, D(1961, 6, 1), "M")]
    r = spells_of(spark, [(1, D(2011, 6, 1), "ILL", 0)], births, half_day=True)[0]
    assert r["entry_date"] == D(2011, 6, 1) and r["entry_age"] == 50.0
    assert r["exit_age"] - r["entry_age"] == pytest.approx(1 / 730.5)


def test_rejected_rows_are_counted(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (None, 2.0)], "entry_age double, exit_age double")
    r = S.rejected_spells(df).first()
    assert (r["n"], r["n_rejected"]) == (4, 3) and S.valid_spells(df).count() == 1


def test_first_illness_keeps_other_codes_and_counts_them(spark):
    x = log(spark, [(1, D(2010, 1, 1), "NONE", 0), (1, D(2010, 2, 1), "X0_Y", 0), (1, D(2010, 3, 1), "X1_Y", 0), (2, D(2010, 1, 1), "DEATH", 0)])
    first = S.first_illness(x, codes=C)
    assert {r["id"]: r["event"] for r in first.collect()} == {1: "X0_Y", 2: "ILL"}
    assert S.lost_to_other_code(first, ["ILL", "DEATH", "LOST"]).first()["persons_lost"] == 1


def test_multi_state_pieces(spark):
    x = log(spark, [(1, D(2010, 3, 1), "A", 0), (1, D(2011, 3, 1), "B", 0), (2, D(2010, 5, 1), "DEATH", 0)])
    out = S.multi_state_spells(x, people(spark, [(1, D(1950, 1, 1), "F"), (2, D(1950, 1, 1), "M")]), codes=C, start="2010-01-01", end="2014-01-01")
    got = sorted((r["id"], r["event"], r["t1"], r["t2"]) for r in out.collect())
    assert got == [(1, "A", D(2010, 1, 1), D(2010, 3, 1)), (1, "B", D(2010, 3, 1), D(2014, 1, 1)), (2, "DEATH", D(2010, 1, 1), D(2010, 5, 1))]


def test_dataset_grid_has_six_variants(spark):
    ind = people(spark, [(1, D(1950, 1, 1), "F")])
    x = log(spark, [(1, D(2011, 1, 1), "DEATH", 0)])
    names = ["", "_imput", "_with_adj", "_with_adj_imput"]
    for kind in ("life", "health"):
        grid = S.dataset_grid({n: ind for n in names}, {n: x for n in names}, kind=kind, codes=C, start="2010-01-01", end="2014-01-01")
        assert len(grid) == 6 and all(df.count() == 1 and df.first()["event_flag"] for df in grid.values())


def test_topup_arithmetic_and_rows(spark):
    cells = spark.createDataFrame(
        [(2010 + k, 70 + k, "M", 1940, m, 0) for k, m in enumerate((100, 200, 50, 300))],
        "year int, age int, sex string, cohort int, pop_ref int, pop_obs int")
    t = P.exposure_topup(cells)
    rows = t.orderBy("year").collect()
    assert [r["missing_decr"] for r in rows] == [100, 100, 50, 50] and [r["exits"] for r in rows] == [0, 50, 0, 50]
    made = P.topup_rows(t, id_start=500, codes=C, chunk=7)
    assert sorted(r["id"] for r in made.collect()) == list(range(500, 600))
    lo, hi = made.agg(F.min("birth_date"), F.max("birth_date")).first()
    assert lo >= D(1939, 1, 2) and hi <= D(1939, 12, 31)
    assert sorted(made.orderBy("id").collect()) == sorted(P.topup_rows(t, id_start=500, codes=C, chunk=1000).orderBy("id").collect())


def test_weighted_curve_equals_exploded(spark):
    rows = [("F", 50.0, 52.0 + i % 5, i % 3 == 0, i % 4 + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "sex string, entry_age double, exit_age double, event_flag boolean, w int")
    a = km(df, ["sex"], weight="w").orderBy("time").collect()
    b = km(df.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("w")))), ["sex"]).orderBy("time").collect()
    for x, y in zip(a, b, strict=True):
        assert (x["time"], x["n_risk"], x["n_event"]) == (y["time"], y["n_risk"], y["n_event"])
        assert x["surv"] == pytest.approx(y["surv"])


def test_headcount_on_first_january(spark):
    df = spark.createDataFrame([("F", D(1960, 1, 1), D(2013, 12, 31)), ("M", D(1960, 1, 2), D(2013, 12, 31)), ("F", D(1905, 3, 1), D(2012, 1, 1))],
                               "sex string, birth_date date, date_event date")
    got = {(r["sex"], r["year"], r["age"]): r["pop"] for r in P.population_1jan(df, [2010, 2011, 2012, 2013]).collect()}
    assert [got[("F", 2010 + k, 50 + k)] for k in range(4)] == [1, 1, 1, 1]
    assert got[("M", 2010, 49)] == 0 and got[("M", 2011, 50)] == 1
    assert got[("F", 2012, 99)] == 1 and got[("F", 2013, 99)] == 0


def test_compare_population_rounds_half_to_even(spark):
    obs = spark.createDataFrame([(2010, 60, "F", 1950, 5), (2010, 61, "F", 1949, 7)], "year int, age int, sex string, cohort int, pop int")
    pyr = spark.createDataFrame([(2010, 60, "F", 10), (2010, 61, "F", 10)], "year int, age int, sex string, pop int")
    got = {r["age"]: r["pop_obs"] for r in P.compare_population(obs, pyr, years=[2010], scale=0.5).collect()}
    assert got == {60: 2, 61: 4}


def test_exact_split_size(spark):
    ids = spark.range(1003)
    for f in (0.0, 0.25, 0.6, 1.0):
        out = V.exact_split(ids, f, seed=3)
        assert out.count() == 1003 and out.filter("train").count() == int(f * 1003)


def test_quality_gates(spark):
    good = log(spark, [(1, D(2010, 1, 1), "A", 0), (1, D(2011, 1, 1), "DEATH", 0), (2, D(2011, 1, 1), "LOST", 0)])
    assert all(r["cond"] for r in Q.quality_terminal(good, C).collect())
    bad = good.unionByName(log(spark, [(1, D(2012, 1, 1), "LOST", 0), (3, D(2012, 1, 1), "A", 0)]))
    assert {r["check"]: r["n_bad"] for r in Q.quality_terminal(bad, C).collect()} == {"at_most_one_terminal": 1, "exactly_one_terminal": 2}


def test_correction_does_not_multiply_rows(spark):
    x = log(spark, [(1, D(2010, 1, 1), "A", 0), (1, D(2010, 2, 1), "B", 0)])
    fix = spark.createDataFrame([(1, "A", D(2009, 5, 1)), (1, "A", D(2009, 6, 1)), (1, "B", D(2009, 7, 1))], "id int, event string, date_event date")
    out = sorted((r["event"], r["date_event"]) for r in K.correct_event_date(x, fix, "A").collect())
    assert out == [("A", D(2009, 5, 1)), ("B", D(2010, 2, 1))]
    assert K.duplicate_keys(fix, ["id", "event"]).count() == 1


def test_event_dimension_with_descriptions(spark):
    x = log(spark, [(1, D(2010, 1, 1), "CANCER1_BREAST", 0), (1, D(2010, 2, 1), "STATE2_DECES", 0)])
    desc = spark.createDataFrame([("CANCER1_BREAST", None, "b"), ("CV1_PVD", 0, "p")], "event string, pathol int, description string")
    rows = {r["event"]: r for r in K.event_dimension(x, descriptions=desc).collect()}
    assert rows["CV1_PVD"]["n"] == 0 and rows["CV1_PVD"]["pathol"] == "0" and rows["CV1_PVD"]["vasc"]
    assert rows["CANCER1_BREAST"]["pathol"] == "1" and rows["CANCER1_BREAST"]["cancer_good"] and not rows["CANCER1_BREAST"]["vasc"]
    assert rows["STATE2_DECES"]["fin"] and rows["STATE2_DECES"]["type"] == "STATE2" and rows["STATE2_DECES"]["pathol"] == "2"

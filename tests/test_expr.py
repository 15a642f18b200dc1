"""Date, age and rounding semantics, one case each."""

from pyspark.sql import functions as F

from spellwise import functions as E


def one(spark, column, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def d(text):
    return F.lit(text).cast("date")


def test_exact_age_counts_days_of_the_running_birthday_year(spark):
    assert abs(one(spark, E.age_at(d("1959-02-28"), d("2012-02-29"))) - (53 + 1 / 366)) < 1e-12
    assert one(spark, E.age_at(d("1960-02-29"), d("2010-02-28"))) == 50.0
    assert abs(one(spark, E.age_at(d("1960-07-01"), d("2010-06-30"))) - (49 + 364 / 365)) < 1e-12
    assert one(spark, E.whole_age(d("1960-07-01"), d("2010-06-30"))) == 49


def test_anniversary_falls_back_to_28_february(spark):
    assert str(one(spark, E.anniversary(d("1960-02-29"), 50))) == "2010-02-28"
    assert str(one(spark, E.anniversary(d("1960-02-29"), 48))) == "2008-02-29"


def test_birth_from_age_rounds_half_to_even(spark):
    # 365.25 * 2 = 730.5 -> 730
    assert str(one(spark, E.birth_from_age(F.lit(2.0), d("2008-01-01")))) == "2006-01-01"
    # 365.25 * 6 = 2191.5 -> 2192
    assert str(one(spark, E.birth_from_age(F.lit(6.0), d("2008-01-01")))) == "2001-12-31"


def test_half_day_is_a_double():
    assert abs(E.HALF_DAY_YEARS - 0.0013689253935660506) < 1e-18


def test_cut_is_right_closed(spark):
    breaks = [0.2, 0.7, 1.1, 1.5]
    want = {0.2: "(-Inf,0.2]", 0.7: "(0.2,0.7]", 0.70001: "(0.7,1.1]", 1.5: "(1.1,1.5]", 9.0: "(1.5, Inf]"}
    for x, label in want.items():
        assert one(spark, E.right_closed_cut(F.lit(x), breaks)) == label
    assert one(spark, E.right_closed_cut(F.lit(None).cast("double"), breaks)) is None


def test_row_minimum_propagates_null(spark):
    null = F.lit(None).cast("int")
    assert one(spark, E.na_min(F.lit(1), null)) is None
    assert one(spark, E.na_max(F.lit(1), F.lit(3))) == 3
    assert one(spark, F.least(F.lit(1), null)) == 1


def test_leap_birthday_moves(spark):
    assert str(one(spark, E.shift_leap_birthday(d("1960-02-29")))) == "1960-03-01"
    assert str(one(spark, E.shift_leap_birthday(d("1960-02-28")))) == "1960-02-28"


def test_hash_uniform_is_even_and_repeatable(spark):
    df = spark.range(20000).select(E.hash_uniform("id", seed=5).alias("u"), E.hash_uniform("id", seed=6).alias("v"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.corr("u", "v")).first()
    assert r[0] >= 0 and r[1] < 1 and abs(r[2] - 0.5) < 0.01 and abs(r[3]) < 0.03
    assert df.first() == df.first()


def test_levels_and_dummies(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "f string")
    dm = E.dummies("f", ["a", "b", "c"], reference="b")
    rows = df.select("f", E.level_rank("f", ["b", "a", "c"]).alias("r"), *[c.alias(n) for n, c in dm.items()]).collect()
    assert [tuple(r) for r in rows] == [("a", 2, 1.0, 0.0), ("b", 1, 0.0, 0.0), ("c", 3, 0.0, 1.0), ("z", None, 0.0, 0.0)]


def test_significance_mask(spark):
    df = spark.createDataFrame([(2.0, 0.05), (2.0, 0.051), (2.0, None)], "e double, p double")
    assert [r[0] for r in df.select(E.mask_if_not_significant("e", "p")).collect()] == [2.0, None, 2.0]

"""Descriptive tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.functions import age_at
from spellwise.operators.ordered import CELL, keep, running_sum, with_cell


def frequency_share(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of each value (within ``by``)."""
    n = df.groupBy(*by, col).agg(F.count("*").alias("n"))
    if not by:
        return n.select(col, "n", (F.col("n") / df.agg(F.count("*")).scalar()).alias("p"))
    total = df.groupBy(*by).agg(F.count("*").alias("__t"))
    return n.join(total, list(by)).select(*by, col, "n", (F.col("n") / F.col("__t")).alias("p"))


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str], *, cell_width: float) -> DataFrame:
    """Exact quantiles with linear interpolation: columns ``by``, prob, value.

    Values are counted first, then ranked with a two-level running count, so no
    group is gathered anywhere.
    """
    v = with_cell(df.select(*by, F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull()), "v", cell_width)
    return quantiles_of_counts(keep(v.groupBy(*by, CELL, "v").agg(F.count("*").alias("c"))), probs, by)


def quantiles_of_counts(c: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """As :func:`exact_quantiles`, from one row per distinct value (``by``, cell, v, c)."""
    n = c.groupBy(*by).agg(F.sum("c").alias("n"))
    r = running_sum(c, list(by), ["v"], {"upto": "c"}).join(n, list(by))
    grid = F.array(*[F.lit(float(p)) for p in probs])
    pos = lambda p: (F.col("n") - 1) * p
    start, stop = F.col("upto") - F.col("c"), F.col("upto")
    holds = lambda k: (k >= start) & (k < stop)
    hits = F.filter(grid, lambda p: holds(F.floor(pos(p))) | holds(F.ceil(pos(p))))
    rows = r.select(*by, "v", "upto", "c", "n", F.explode(hits).alias("prob"))
    h = pos(F.col("prob"))
    lo = F.max(F.when(holds(F.floor(h)), F.col("v")))
    hi = F.max(F.when(holds(F.ceil(h)), F.col("v")))
    frac = F.max(h - F.floor(h))
    return rows.groupBy(*by, "prob").agg((lo + (hi - lo) * frac).alias("value"))


def _width_of(widths: dict[str, float], default: float = 0.25) -> Column:
    out = F.lit(default)
    for name, w in widths.items():
        out = F.when(F.col("var") == name, float(w)).otherwise(out)
    return out


def demographic_table(
    df: DataFrame, *, sex: str = "sex", numeric: Sequence[str], categories: Sequence[str], widths: dict[str, float] | None = None
) -> DataFrame:
    """Per sex and for both ("B"): n, median with quartiles, and category counts with shares.

    One pass counts the values of all columns; everything else is read off those counts, and the
    rows of both sexes are sums of them. Columns: sex, var, statistic, value, value2, value3.
    """
    null, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    long = df.select(sex, F.inline(F.array(
        F.struct(F.lit("n").alias("var"), F.lit("n").alias("cat"), null.alias("v")),
        *[F.struct(F.lit(c).alias("var"), F.col(c).cast("string").alias("cat"), null.alias("v")) for c in categories],
        *[F.struct(F.lit(c).alias("var"), text.alias("cat"), F.col(c).cast("double").alias("v")) for c in numeric],
    )))
    counts = long.groupBy(sex, "var", "cat", "v").agg(F.count("*").alias("c"))
    counts = counts.withColumn(sex, F.explode(F.array(F.col(sex), F.lit("B"))))
    counts = keep(counts.groupBy(sex, "var", "cat", "v").agg(F.sum("c").alias("c")))
    cats = counts.filter(F.col("var").isin("n", *categories))
    total = cats.groupBy(sex, "var").agg(F.sum("c").alias("__t"))
    share = F.when(F.col("var") != "n", F.col("c") / F.col("__t"))
    out = cats.join(total, [sex, "var"]).select(
        sex, "var", F.col("cat").alias("statistic"), F.col("c").cast("double").alias("value"), share.alias("value2"), null.alias("value3"))
    nums = counts.filter(F.col("var").isin(*numeric) & F.col("v").isNotNull())
    nums = nums.withColumn(CELL, F.floor(F.col("v") / _width_of(widths or {}))).select(sex, "var", CELL, "v", "c")
    q = quantiles_of_counts(nums, [0.25, 0.5, 0.75], [sex, "var"])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    return out.unionByName(q.groupBy(sex, "var").agg(
        at(0.5).alias("value"), at(0.25).alias("value2"), at(0.75).alias("value3")).withColumn("statistic", F.lit("Median (IQR)")))


def correlations(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Pearson correlation, t statistic and normal-tail p value for every pair, in one pass."""
    names = sorted(columns)
    x = df.select(*[columns[n].cast("double").alias(n) for n in names])
    pairs = list(combinations(names, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = x.agg(*[e for i, (a, b) in enumerate(pairs)
                  for e in (F.corr(a, b).alias(f"r{i}"), F.count_if(both(a, b)).alias(f"n{i}"))])
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("cor"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(pairs)])))
    t = F.col("cor") * F.sqrt((F.col("n") - 2) / (F.lit(1.0) - F.col("cor") * F.col("cor")))
    return rows.withColumn("t", t).withColumn("pvalue", two_sided_p("t"))


def two_sided_p(z: str | Column) -> Column:
    """Two-sided normal tail probability (rational approximation, absolute error below 1e-7)."""
    a = F.abs(F.col(z) if isinstance(z, str) else z)
    # Published coefficients of the normal tail approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    k = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = F.lit(0.0)
    for coef in reversed(b):
        poly = (poly + F.lit(coef)) * k
    return F.lit(2.0) * poly * F.exp(-a * a / 2) * F.lit(0.3989422804014327)


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence[str], prefix: str = "n_") -> DataFrame:
    """Two-way counts with the column levels given."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in levels])


def column_profile(df: DataFrame, numeric: Sequence[str], cell_width: dict[str, float]) -> DataFrame:
    """Per numeric column: counts, NULLs, mean, standard deviation, min, quartiles, max."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in numeric])))
    base = long.groupBy("column").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("n_null"), F.avg("v").alias("mean"),
        F.stddev("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"))
    counts = long.filter(F.col("v").isNotNull()).withColumnRenamed("column", "var").groupBy("var", "v").agg(F.count("*").alias("c"))
    counts = keep(counts.withColumn(CELL, F.floor(F.col("v") / _width_of(cell_width))))
    parts = quantiles_of_counts(counts, [0.25, 0.5, 0.75], ["var"]).withColumnRenamed("var", "column")
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    q = parts.groupBy("column").agg(at(0.25).alias("q25"), at(0.5).alias("median"), at(0.75).alias("q75"))
    return base.join(q, "column", "left")


def constancy_check(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """For each attribute: does every person have exactly one value? Uses min and max, not distinct sets."""
    per = df.groupBy(key).agg(*[
        F.coalesce((F.min(a) == F.max(a)) & (F.count(a) == F.count(F.lit(1))), F.count(a) == 0).alias(a)
        for a in attributes])
    one = per.agg(*[F.bool_and(a).alias(a) for a in attributes])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("constant")) for a in attributes])))


def derivation_consistency(parts: dict[str, DataFrame], key: str = "id", value: str = "birth_date") -> DataFrame:
    """Do all derivations of a value agree per person? Columns: id, n_sources, is_const."""
    out = None
    for label, df in parts.items():
        p = df.select(F.lit(label).alias("source"), key, value)
        out = p if out is None else out.unionByName(p)
    out = out.distinct()
    return out.groupBy(key).agg(F.count_distinct("source").alias("n_sources"), (F.min(value) == F.max(value)).alias("is_const"))


def wide_incidence(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of persons with each event and mean age at it, from a wide age matrix (0 = never)."""
    long = matrix.select(F.inline(F.array(*[F.struct(F.lit(c).alias("event"), F.col(c).alias("v")) for c in columns])))
    out = long.groupBy("event").agg(
        F.avg(F.when(F.col("v") != 0, 1.0).otherwise(0.0)).alias("rate"), F.avg(F.when(F.col("v") > 0, F.col("v"))).alias("mean_age"))
    return out.filter((F.col("rate") > 0) & F.col("mean_age").isNotNull())


def histogram(df: DataFrame, col: str | Column, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts per bin ``[k * width, (k + 1) * width)``."""
    c = F.col(col) if isinstance(col, str) else col
    return df.groupBy(*by, (F.floor(c / F.lit(float(width))) * F.lit(float(width))).alias("bin")).agg(F.count("*").alias("n"))


def day_of_month(df: DataFrame, date: str) -> DataFrame:
    """Rows per month and day of month."""
    return df.groupBy(F.date_format(F.trunc(date, "month"), "yyyy-MM").alias("month"), F.day(date).alias("day")).agg(
        F.count("*").alias("n"))


def before_after_counts(df: DataFrame, col: str, is_before: Column) -> DataFrame:
    """Counts per value on both sides of a date, values missing on one side included."""
    a = df.filter(is_before).groupBy(col).agg(F.count("*").alias("n_before"))
    b = df.filter(~is_before).groupBy(col).agg(F.count("*").alias("n_after"))
    return a.join(b, col, "full")


def top_n(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(n)


def derived_audit(
    log: DataFrame, *, stored_year: str, stored_age: str, stored_first: str, age: Column, is_illness: Column, tolerance: float = 1.0,
    stored_time1: str | None = None, stored_time2: str | None = None, reference: str | None = None, birth: str = "birth_date",
) -> DataFrame:
    """Recompute year, age, first-illness date and, if asked, the ages at the reference date (``time1``) and at the person's last
    event (``time2``) from the log, and count the disagreements with the stored columns (ages in days)."""
    first = log.groupBy("id").agg(F.min(F.when(is_illness, F.col("date_event"))).alias("__first"), F.max("date_event").alias("__last"))
    j = log.join(first, "id", "left")
    times = []
    if stored_time1:
        off = F.abs(age_at(birth, F.lit(reference).cast("date")) - F.col(stored_time1)) * 365.25
        times.append(F.count_if(off > tolerance).alias("bad_time1"))
    if stored_time2:
        times.append(F.count_if(F.abs(age_at(birth, "__last") - F.col(stored_time2)) * 365.25 > tolerance).alias("bad_time2"))
    days = F.datediff("date_event", stored_first)
    return j.agg(
        F.count("*").alias("n"),
        F.count_if(F.year("date_event") != F.col(stored_year)).alias("bad_year"),
        F.count_if(F.abs(age - F.col(stored_age)) * 365.25 > tolerance).alias("bad_age"),
        F.count_if(F.col("__first") != F.col(stored_first)).alias("bad_first"),
        F.avg(F.when(days > 0, 1.0).otherwise(F.when(days.isNotNull(), 0.0))).alias("share_after_first"),
        *times,
    )

"""Column expressions shared by all operators (no UDFs, all inside codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half a day in years, and the mean length of a year: written as doubles, because
# decimal arithmetic would cut the quotient off after a few digits.
YEAR_DAYS = 365.25
HALF_DAY_YEARS = 1.0 / (2 * 365.25)
# 97.5 % point of the standard normal distribution (fixed value).
Z95 = 1.959963984540054


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def anniversary(birth: str | Column, years: int | Column) -> Column:
    """Date of the n-th birthday; 29 February falls back to the 28th."""
    months = years * 12 if isinstance(years, int) else (years * F.lit(12)).cast("int")
    return F.add_months(col(birth), months)


def age_at(birth: str | Column, at: str | Column) -> Column:
    """Exact age: whole years plus the elapsed part of the running birthday year."""
    b, d = col(birth), col(at)
    years = F.year(d) - F.year(b)
    whole = years - F.when(anniversary(b, years) > d, 1).otherwise(0)
    last, nxt = anniversary(b, whole), anniversary(b, whole + 1)
    return whole.cast("double") + F.datediff(d, last).cast("double") / F.datediff(nxt, last)


def whole_age(birth: str | Column, at: str | Column) -> Column:
    """Completed years of age."""
    b, d = col(birth), col(at)
    years = F.year(d) - F.year(b)
    return years - F.when(anniversary(b, years) > d, 1).otherwise(0)


def birth_from_age(age: str | Column, reference: Column) -> Column:
    """Birth date from an age at a reference date (days rounded half to even)."""
    return F.date_sub(reference, F.bround(F.lit(YEAR_DAYS) * col(age)).cast("int"))


def na_min(*cols: str | Column) -> Column:
    """Row-wise minimum that is NULL as soon as one input is NULL."""
    return _na_pick(F.least, cols)


def na_max(*cols: str | Column) -> Column:
    """Row-wise maximum that is NULL as soon as one input is NULL."""
    return _na_pick(F.greatest, cols)


def _na_pick(fn, cols) -> Column:
    cs = [col(c) for c in cols]
    known = cs[0].isNotNull()
    for c in cs[1:]:
        known = known & c.isNotNull()
    return F.when(known, fn(*cs))


def right_closed_cut(x: str | Column, breaks: Sequence[float]) -> Column:
    """Label of the interval ``(a, b]`` holding ``x``; open ends are infinite."""
    x = col(x)
    edges = [None, *breaks, None]
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        label = F.lit(f"({'-Inf' if lo is None else f'{lo:g}'},{' Inf]' if hi is None else f'{hi:g}]'}")
        test = F.lit(True) if hi is None else x <= F.lit(float(hi))
        out = F.when(x.isNull(), None).when(test, label) if out is None else out.when(test, label)
    return out


def level_rank(x: str | Column, levels: Sequence[str]) -> Column:
    """1-based position of a category in its level order (NULL when unknown)."""
    x = col(x)
    out = F.when(F.lit(False), F.lit(0))
    for i, level in enumerate(levels, start=1):
        out = out.when(x == F.lit(level), F.lit(i))
    return out


def dummies(name: str, levels: Sequence[str], reference: str | None = None) -> dict[str, Column]:
    """0/1 columns, one per level but the reference (default: the first level)."""
    reference = levels[0] if reference is None else reference
    return {
        f"{name}{level}": F.when(F.col(name) == F.lit(level), 1.0).otherwise(0.0)
        for level in levels
        if level != reference
    }


def hash_uniform(*keys: str | Column, seed: int) -> Column:
    """Uniform number in [0, 1) that depends on the key values and seed alone.

    It is the same on every retry and every engine that knows MD5, so a lost
    executor never changes who is in a sample.
    """
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def beta_1_2(u: Column) -> Column:
    """Beta(1, 2) variate by inverting its distribution function."""
    return F.lit(1.0) - F.sqrt(F.lit(1.0) - u)


def shift_leap_birthday(d: str | Column) -> Column:
    """29 February moves to 1 March, other dates stay."""
    d = col(d)
    return F.when(F.date_format(d, "dd-MM") == "29-02", F.date_add(d, 1)).otherwise(d)


def mask_if_not_significant(estimate: str | Column, p: str | Column, level: float = 0.05) -> Column:
    """NULL unless ``p`` is at most ``level``; a row without p value is kept."""
    return F.when(col(p) > level, None).otherwise(col(estimate))


def sum_of(cols: Sequence[Column]) -> Column:
    """Balanced sum: keeps long linear predictors shallow for the code generator."""
    cols = list(cols)
    if not cols:
        return F.lit(0.0)
    while len(cols) > 1:
        cols = [cols[i] + cols[i + 1] if i + 1 < len(cols) else cols[i] for i in range(0, len(cols), 2)]
    return cols[0]

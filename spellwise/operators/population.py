"""Observed head-counts against an age pyramid, and the exposure that is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellwise.functions import HALF_DAY_YEARS, YEAR_DAYS, age_at, anniversary, hash_uniform, shift_leap_birthday, whole_age
from spellwise.operators.ordered import CELL, running_sum
from spellwise.operators.vocab import EventCodes

# Fixed value: persons in the source population before exclusions.
SOURCE_POPULATION = 18440022
TOP_AGE = 99


def population_scale(individuals: DataFrame, source: int = SOURCE_POPULATION) -> float:
    """Persons of the source population for each person of the table."""
    return source / individuals.count()


def exit_or_end(indiv: DataFrame, log: DataFrame, *, end: str, codes: EventCodes = EventCodes()) -> DataFrame:
    """All persons with their death, or with the end of the study when there is none."""
    death = log.filter(F.col("event") == codes.death).groupBy("id").agg(F.min("date_event").alias("date_event"), F.first("event").alias("event"))
    return death.join(indiv, "id", "right").withColumns({
        "date_event": F.coalesce("date_event", F.lit(end).cast("date")),
        "event": F.coalesce("event", F.lit(codes.lost)),
    })


def population_1jan(
    people: DataFrame, years: Sequence[int], by: Sequence[str] = ("sex",), *, birth: str = "birth_date",
    exit: str = "date_event", min_age: int = 50,
) -> DataFrame:
    """Persons present on each 1 January by year and age (top age collapsed), with their cohort.

    Present means from the ``min_age``-th birthday to the exit, both included. Each person
    yields one row per year, and the counts are combined before the shuffle.
    """
    days = F.array(*[F.lit(f"{y}-01-01").cast("date") for y in years])
    rows = people.select(*by, F.col(birth).alias("b"), F.col(exit).alias("x"), F.explode(days).alias("jan"))
    present = F.col("jan").between(anniversary("b", min_age), F.col("x"))
    return (
        rows.select(
            *by, F.year("jan").alias("year"), F.least(whole_age("b", "jan"), F.lit(TOP_AGE)).alias("age"),
            F.when(present, 1).otherwise(0).alias("p"))
        .groupBy(*by, "year", "age")
        .agg(F.sum("p").alias("pop"))
        .withColumn("cohort", F.col("year") - F.col("age"))
    )


def compare_population(observed: DataFrame, pyramid: DataFrame, *, years: Sequence[int], min_age: int = 50,
                       scale: float | None = None) -> DataFrame:
    """Pyramid next to observed counts (optionally scaled, rounded half to even)."""
    pop = F.col("pop") if scale is None else F.bround(F.lit(float(scale)) * F.col("pop")).cast("bigint")
    obs = observed.select("year", "age", "sex", "cohort", pop.alias("pop_obs"))
    pyr = pyramid.filter((F.col("age") >= min_age) & F.col("year").isin(*years)).select(
        "year", "age", "sex", F.col("pop").alias("pop_ref"))
    return pyr.join(obs, ["year", "age", "sex"]).select("year", "age", "sex", "cohort", "pop_ref", "pop_obs")


def exposure_topup(compared: DataFrame) -> DataFrame:
    """Missing persons per cohort and sex, as weighted rows that leave at the end of ``year``.

    The missing number may only fall over the years (running minimum), and each fall is
    an exit. The window holds one row per year.
    """
    w = Window.partitionBy("cohort", "sex").orderBy("year", "age")
    out = compared.withColumn("missing", F.greatest(F.col("pop_ref") - F.col("pop_obs"), F.lit(0)))
    out = out.withColumn("missing_decr", F.min("missing").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("exits", F.col("missing_decr") - F.lead("missing_decr", 1, 0).over(w))


def topup_rows(cells: DataFrame, *, id_start: int, codes: EventCodes = EventCodes(), seed: int = 1,
               chunk: int = 50_000) -> DataFrame:
    """One row per missing person: id, birth date in the cohort's year, exit on 31 December.

    Ids are ``id_start`` plus a running count over cells. Cells are cut into chunks
    and spread out before the rows are made, so a big cell fills many tasks.
    """
    c = cells.filter(F.col("exits") > 0).select("cohort", "sex", "year", "exits").withColumn(CELL, F.col("cohort"))
    c = c.withColumn("__all", F.lit(0))
    c = running_sum(c, ["__all"], ["cohort", "sex", "year"], {"before": "exits"}, inclusive=False)
    n = F.lit(chunk)
    c = c.withColumn("__k", F.explode(F.sequence(F.lit(0), F.floor((F.col("exits") - 1) / n).cast("int"))))
    c = c.repartition("cohort", "sex", "year", "__k")
    pos = F.sequence(F.col("__k") * n + 1, F.least((F.col("__k") + 1) * n, F.col("exits")))
    rows = c.withColumn("pos", F.explode(pos))
    u = hash_uniform("cohort", "sex", "year", "pos", seed=seed)
    born = F.make_date((F.col("cohort") - 1).cast("int"), F.lit(1), F.lit(1))
    last = F.make_date((F.col("cohort") - 1).cast("int"), F.lit(12), F.lit(31))
    birth = F.least(F.date_add(born, F.bround(F.lit(YEAR_DAYS) * u).cast("int")), last)
    return rows.select(
        (F.lit(id_start).cast("bigint") + F.col("before") + F.col("pos") - 1).alias("id"),
        "sex",
        F.greatest(birth, F.date_add(born, 1)).alias("birth_date"),
        F.make_date(F.col("year").cast("int"), F.lit(12), F.lit(31)).alias("date_event"),
        F.lit(codes.lost).alias("event"),
    )


def with_topup(observed: DataFrame, added: DataFrame, columns: Sequence[str], flag: str = "observed") -> DataFrame:
    """Observed and added rows with a source flag; columns one side lacks are NULL."""
    both = observed.withColumn(flag, F.lit(True)).unionByName(added.withColumn(flag, F.lit(False)),
                                                             allowMissingColumns=True)
    return both.select(*columns, flag)


def topup_spells(cells: DataFrame, *, start: str, min_age: int = 50, seed: int = 1) -> DataFrame:
    """The missing persons of :func:`topup_rows` as weighted censored spells, one per sex, birth day and exit."""
    people = topup_rows(cells, id_start=0, seed=seed).groupBy("sex", "birth_date", "date_event").agg(F.count("*").alias("weight"))
    c = people.withColumn("entry_date", F.greatest(F.lit(start).cast("date"), anniversary("birth_date", min_age)))
    return c.filter(F.col("entry_date") <= F.col("date_event")).select(
        "sex", age_at("birth_date", "entry_date").alias("entry_age"),
        (age_at("birth_date", "date_event") + F.lit(HALF_DAY_YEARS)).alias("exit_age"),
        F.lit(False).alias("event_flag"), "weight",
    )


def adjusted_vs_pyramid(
    people: DataFrame, compared: DataFrame, years: Sequence[int], labels: dict[str, str] | None = None
) -> DataFrame:
    """Pyramid, observed and adjusted head-counts, one row per method."""
    # The labels of the three methods.
    labels = labels or {"pop_ref": "INSEE", "pop_obs": "Without adj.", "pop_adj": "With adj."}
    moved = people.withColumn("birth_date", shift_leap_birthday("birth_date"))
    adj = population_1jan(moved, years).withColumnRenamed("pop", "pop_adj")
    wide = adj.join(compared, ["age", "year", "sex", "cohort"], "full")
    rows = F.array(*[F.struct(F.lit(text).alias("method"), F.col(c).alias("pop")) for c, text in labels.items()])
    return wide.select("year", "age", "sex", "cohort", F.inline(rows))


def coverage_by_age(compared: DataFrame) -> DataFrame:
    """Observed share of the pyramid by age and sex, and the missing share."""
    s = compared.groupBy("age", "sex").agg(F.sum("pop_obs").alias("pop_obs"), F.sum("pop_ref").alias("pop_ref"))
    return s.withColumn("coverage", F.col("pop_obs") / F.col("pop_ref")).withColumn(
        "missing_share", (F.col("pop_ref") - F.col("pop_obs")) / F.col("pop_ref"))


def sex_ratio_by_cohort(compared: DataFrame, max_age: int = 95) -> DataFrame:
    """Pyramid over observed by sex, and its F/M ratio, per year and age."""
    r = compared.filter((F.col("age") <= max_age) & (F.col("pop_obs") > 0)).withColumn(
        "ratio", F.col("pop_ref") / F.col("pop_obs"))
    wide = r.groupBy("year", "age", "cohort").pivot("sex", ["F", "M"]).agg(F.first("ratio"))
    return wide.withColumn("r", F.col("F") / F.col("M"))

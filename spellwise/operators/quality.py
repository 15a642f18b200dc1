"""Data-quality gates: each returns rows with a name and a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellwise.functions import age_at
from spellwise.operators.vocab import EventCodes


def quality_terminal(log: DataFrame, codes: EventCodes = EventCodes()) -> DataFrame:
    """At most one, and exactly one, terminal event per person."""
    t = log.groupBy("id").agg(F.count_if(F.col("event").isin(*codes.terminal)).alias("k"))
    one = t.agg(
        F.count("*").alias("persons"), F.count_if(F.col("k") > 1).alias("many"), F.count_if(F.col("k") != 1).alias("not_one"))
    return one.select(F.inline(F.array(
        F.struct(F.lit("at_most_one_terminal").alias("check"), F.col("many").alias("n_bad"), (F.col("many") == 0).alias("cond")),
        F.struct(F.lit("exactly_one_terminal").alias("check"), F.col("not_one").alias("n_bad"),
                 (F.col("not_one") == 0).alias("cond")),
    )))


def quality_volume(
    spells: DataFrame, log: DataFrame, indiv: DataFrame, *, start: str, min_age: int = 50,
    codes: EventCodes = EventCodes(),
) -> DataFrame:
    """Spells = persons − (lost before the window ∪ first illness before ``min_age``)."""
    is_lost = (F.col("event") == codes.lost) & (F.col("date_event") < F.lit(start).cast("date"))
    per = log.groupBy("id").agg(
        F.max(is_lost).alias("lost"), F.min(F.when(F.col("event") != codes.no_illness, F.col("date_event"))).alias("ill"))
    young = F.coalesce(age_at("birth_date", "ill") < min_age, F.lit(False))
    log_side = per.join(indiv.select("id", "birth_date"), "id", "left").agg(
        F.count("*").alias("n_persons"), F.count_if(F.col("lost") | young).alias("n_excluded"))
    one = log_side.withColumn("n_spells", spells.agg(F.count("*")).scalar())
    expected = F.col("n_persons") - F.col("n_excluded")
    return one.select("n_spells", "n_persons", "n_excluded", expected.alias("n_expected"),
                      (F.col("n_spells") == expected).alias("cond"))

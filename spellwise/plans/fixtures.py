"""Event-history views over the star-schema test tables.

Customers stand for persons, orders for hospital contacts, line items for
follow-up times. Every view is a plain DataFrame over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spellwise.functions import YEAR_DAYS, age_at
from spellwise.operators.spells import build_spells, first_illness
from spellwise.operators.vocab import EventCodes

CODES = EventCodes(death="DEATH", lost="LOST", no_illness="NO_ILLNESS", illness="ILL")
REFERENCE_DATE = "1995-01-01"
START, END = "1995-01-01", "1998-01-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def date(text: str):
    return F.lit(text).cast("date")


def individuals(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    age = F.lit(45.0) + ((k * 7919) % 4000).cast("double") / F.lit(100.0)
    return (
        c.select(
            k.alias("id"),
            F.when(k % 2 == 0, "F").otherwise("M").alias("sex"),
            age.alias("age_ref"),
            F.expr("string((c_custkey div 3) % 3)").alias("obesity_cat3"),
            F.expr("string((c_custkey div 9) % 3)").alias("alcohol_cat3"),
            (k % 3).cast("string").alias("smoker_cat3"),
            F.col("c_nationkey").cast("string").alias("dep"),
            (k % 4).cast("string").alias("immigration"),
            F.expr("string((c_custkey div 4) % 4)").alias("diplome"),
        )
        .withColumn(
            "birth_date",
            F.date_sub(date(REFERENCE_DATE), F.bround(F.lit(YEAR_DAYS) * F.col("age_ref")).cast("int")),
        )
    )


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order; the last one of each person is terminal.

    The last row comes from an aggregate (combined map-side) that is joined back
    on the order key, so a person with very many orders does not end in one task.
    """
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"),
        F.col("o_orderkey").alias("src"),
        F.to_date("o_orderdate").alias("date_event"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )
    # Day and order key share one integer, so the aggregate can hash; a key that doesn't fit raises.
    fits = (F.col("src") >= 0) & (F.col("src") < F.lit(10**13))
    src = F.when(~fits, F.raise_error(F.lit("an order key has more than 13 digits")).cast("bigint")).otherwise(F.col("src"))
    stamp = F.unix_date("date_event").cast("bigint") * F.lit(10**13) + src
    last = o.groupBy("id").agg(F.max(stamp).alias("k")).select(
        F.pmod("k", F.lit(10**13)).alias("src"), F.lit(True).alias("is_last"))
    kind = (
        F.when(F.col("is_last") & (F.col("status") == "F"), CODES.death)
        .when(F.col("is_last"), CODES.lost)
        .when(F.col("priority") == "1-URGENT", "ILL1_A")
        .when((F.col("priority") == "2-HIGH") & (F.col("src") % 4 == 0), "ILL1_B")
        .when((F.col("priority") == "3-MEDIUM") & (F.col("src") % 10 == 0), "ILL0_C")
        .otherwise(CODES.no_illness)
    )
    censor = F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2)
    return o.join(last, "src", "left").select(
        "id", "src", "date_event", kind.alias("event"), censor.alias("event_censor")
    )


def spells(spark: SparkSession, sf: str, start: str = START, end: str = END) -> DataFrame:
    """One left-truncated, right-censored disease-free spell per person."""
    ill = first_illness(event_log(spark, sf), codes=CODES, tie=["src"])
    return build_spells(
        individuals(spark, sf), ill, targets=[CODES.illness], codes=CODES,
        min_age=50, start=start, end=end, half_day=True,
    ).filter((F.col("entry_date") <= F.col("exit_date")) & (F.col("exit_age") >= 50))


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """Days from order to shipment, seen from 1997-01-01 on (integer times, many ties)."""
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount",
        F.to_date("l_shipdate").alias("ship"),
    ).filter(F.col("ship") >= date("1997-01-01"))
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("ordered")
    )
    return (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_orderpriority").alias("stratum"),
            F.greatest(F.datediff(date("1997-01-01"), "ordered"), F.lit(0)).alias("entry"),
            F.datediff("ship", "ordered").alias("exit"),
            (F.col("l_returnflag") == "R").alias("event"),
            F.col("l_returnflag").alias("cause"),
            F.col("l_orderkey").alias("order_id"),
            "l_linenumber", "l_linestatus", "l_quantity", "l_discount",
        )
        .filter(F.col("entry") < F.col("exit"))
    )


def corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Corrected dates (30 days earlier) of the first ILL1_A event of every tenth person."""
    log = event_log(spark, sf).filter((F.col("event") == "ILL1_A") & (F.col("id") % 10 == 0))
    return log.groupBy("id", "event").agg(F.date_sub(F.min("date_event"), 30).alias("date_event"))


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    """First contact 45 days before the first order of every tenth person."""
    log = event_log(spark, sf).filter(F.col("id") % 10 == 0)
    return log.groupBy("id").agg(F.date_sub(F.min("date_event"), 45).alias("contact_date"))


def imputed(spark: SparkSession, sf: str) -> DataFrame:
    """Imputed risk categories of every tenth person."""
    i = individuals(spark, sf).filter(F.col("id") % 10 == 0)
    up = lambda c: ((F.col(c).cast("int") + 1) % 3).cast("string").alias(c)
    return i.select("id", up("alcohol_cat3"), up("smoker_cat3"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("dep"),
        F.col("r_name").alias("region"),
        (F.lit(1.0) + (F.col("n_nationkey") % 5) / F.lit(10.0)).alias("estimate"),
    )


def age_of_event(df: DataFrame, birth: str = "birth_date", at: str = "date_event") -> DataFrame:
    return df.withColumn("age_event", age_at(birth, at))

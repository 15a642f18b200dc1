"""Queries that write the given tables as files of the formats the readers know and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spellwise.plans import fixtures as X
from spellwise.plans.oracle_views import with_views
from spellwise.plans.registry import query
from spellwise.session import shared_folder
from spellwise.sources import readers as R


def folder(spark) -> str:
    """A new folder that executors and driver share."""
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


def csv(df, path: str, **options) -> str:
    """Text files with a header; missing values as NA."""
    df.write.options(header=True, nullValue="NA", **options).csv(path)
    return path


@query("csv_event_log", with_views("""
    SELECT e.id, i.sex, e.event, e.date_event, CASE WHEN e.src % 3 = 0 THEN NULL ELSE e.event_censor END AS event_censor, e.src / 4.0::DOUBLE AS weight, true AS has_file
    FROM event_log e JOIN individuals i ON i.id = e.id"""))
def csv_event_log(spark, sf):
    """The log as one set of CSV files per sex, US dates and columns in another order, read back by name with its provenance."""
    at = folder(spark)
    log = X.event_log(spark, sf).join(X.individuals(spark, sf).select("id", "sex"), "id")
    rows = log.select(
        F.lit("x").alias("extra"), F.col("event").alias("Event"), F.col("sex").alias("MALE"), (F.col("src") / F.lit(4.0)).alias("weight"),
        F.date_format("date_event", R.US_DATE).alias("DATE_EVENT"), F.col("id").alias("ID"),
        F.when(F.col("src") % 3 != 0, F.col("event_censor")).alias("EVENT_CENSOR"))
    paths = [csv(rows.filter(F.col("MALE") == sex), f"{at}/{sex}") for sex in ("F", "M")]
    ddl = "ID LONG, MALE STRING, EVENT STRING, DATE_EVENT DATE, EVENT_CENSOR INT, WEIGHT DOUBLE"
    out = R.read_event_csv(spark, paths, ddl, source_column="file")
    return out.select("id", F.col("male").alias("sex"), "event", "date_event", "event_censor", "weight", F.col("file").endswith(".csv").alias("has_file"))


@query("csv_bad_records", with_views("""
    SELECT CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS bad, count(*) AS n, CAST(sum(CASE WHEN id % 10 <> 0 THEN id END) AS BIGINT) AS ids FROM individuals GROUP BY 1"""))
def csv_bad_records(spark, sf):
    """Records whose values don't fit their types are set apart, the others are read."""
    i = X.individuals(spark, sf).select(F.col("id").alias("ID"), F.when(F.col("id") % 10 == 0, "soon").otherwise("1/31/2010").alias("DATE_EVENT"))
    out = R.read_event_csv(spark, csv(i, folder(spark)), "ID LONG, DATE_EVENT DATE", bad_column="bad")
    bad = F.when(F.col("bad").isNotNull(), 1).otherwise(0).alias("bad")
    return out.groupBy(bad).agg(F.count("*").alias("n"), F.sum(F.when(F.col("bad").isNull(), F.col("id"))).alias("ids"))


@query("csv2_table", """
    SELECT CAST(s_suppkey AS BIGINT) AS suppkey, s_name AS name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE round(s_acctbal, 2) END AS acctbal,
           CAST(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey END AS INTEGER) AS nationkey FROM supplier""")
def csv2_table(spark, sf):
    """Semicolons, decimal commas and missing values."""
    s = X.table(spark, sf, "supplier")
    number = F.regexp_replace(F.round("s_acctbal", 2).cast("decimal(20,2)").cast("string"), r"\.", ",")
    rows = s.select(
        F.col("s_suppkey").alias("SUPPKEY"), F.col("s_name").alias("NAME"), F.when(F.col("s_suppkey") % 7 != 0, number).alias("ACCTBAL"),
        F.when(F.col("s_suppkey") % 5 == 0, "n/a").otherwise(F.col("s_nationkey").cast("string")).alias("NATIONKEY"))
    return R.read_csv2(spark, csv(rows, folder(spark), sep=";"), "SUPPKEY LONG, NAME STRING, ACCTBAL DOUBLE, NATIONKEY INT")


@query("lookup_table", "SELECT CAST(n_nationkey AS INTEGER) AS nationkey, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def lookup_table(spark, sf):
    """A dimension table with blanks around its values."""
    n, r = X.table(spark, sf, "nation"), X.table(spark, sf, "region")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit("  "))
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        pad(F.col("n_nationkey").cast("string")).alias("NationKey"), pad(F.col("n_name")).alias("Name"), pad(F.col("r_name")).alias("Region"))
    path = csv(rows, folder(spark), sep="|", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return R.read_lookup(spark, path, "NationKey INT, Name STRING, Region STRING", sep="|")


@query("written_table", with_views("SELECT id, src, event FROM event_log WHERE event IN ('DEATH', 'LOST')"))
def written_table(spark, sf):
    """The log written by kind of event, and two kinds read back: the others' files are never opened."""
    path = folder(spark)
    R.write_table(X.event_log(spark, sf), path, partition_by=["event"])
    return R.read_table(spark, path, ["id", "src", "event"]).filter(F.col("event").isin("DEATH", "LOST"))

"""Tables laid out by person: plans without a further exchange; order keys that don't fit raise."""

import pytest
from pyspark.sql import functions as F

from spellwise.operators.events import drop_persons, keep_persons
from spellwise.plans import fixtures as X
from spellwise.plans import queries_survival as Q

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_no_exchange_between_bucketed_tables(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables would be broadcast anyway
    try:
        people, log = Q.by_person(spark, SF, buckets=4)
        sick = log.filter(F.col("event").startswith("ILL"))
        assert exchanges(Q.spells_of(people, log)) == 0
        assert exchanges(keep_persons(people, sick)) == 0 and exchanges(drop_persons(people, sick)) == 0
        assert exchanges(Q.spells_of(keep_persons(people, sick), log)) == 0
        assert exchanges(Q.spells_of(X.individuals(spark, SF), X.event_log(spark, SF))) > 2
        files = {r["f"] for r in people.select(F.input_file_name().alias("f")).distinct().collect()}
        assert len(files) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_order_keys_that_do_not_fit_raise(spark, tmp_path):
    rows = [(10**13, 1, "2000-01-01", "F", "x")]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string, o_orderpriority string")
    df.write.parquet(f"{tmp_path}/orders.parquet")
    with pytest.raises(Exception, match="more than 13 digits"):
        X.event_log(spark, str(tmp_path)).collect()

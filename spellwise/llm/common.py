"""What several text operators share: the shared folder, settled tables, components of a graph."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one on a local master (tests) and an error elsewhere."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    set_already = sc._jsc.sc().getCheckpointDir()
    if conf:
        if set_already.isEmpty():
            sc.setCheckpointDir(conf)
        return conf
    if set_already.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spellwise-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: long): one row (node, root) per node, root the smallest node.

    Alternating large-star and small-star steps, each one grouped minimum and one join; it stops when a
    round changes nothing and raises if that takes more than `rounds` rounds (they grow with the logarithm
    of the longest chain). A node with very many links is split by adaptive skew joins.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        sign = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if sign == before or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct()
            )
        before = sign
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.first("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("u"))
        small = small.select("a", F.col("low").alias("b")).union(
            small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        now = settle(small.distinct())
    raise RuntimeError("components did not settle")

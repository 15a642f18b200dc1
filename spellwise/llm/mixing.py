"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document gets an exponential key -ln(u) / weight, u from a digest of its id and text, so that reruns agree. A
source whose target is k whole epochs and a rest takes every document k times and then documents in the order of
their keys, up to its budget. Cumulated sizes never need a whole source in one task: keys are cut into SLICES
slices, sizes are summed per source and slice, the slice in which the budget ends is found on those sums, and
only the documents of that slice are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spellwise.llm.common import settle

#: Slices of the key axis: a source of n documents orders about n / SLICES of them in one task.
SLICES = 1 << 16
SHARE = 1.5
MOST = 2.0

#: Symbols that count against a text's quality.
SYMBOLS = "0123456789!\"#$%&()*+-/:;<=>@[]^_`{|}~"


def quality(text: str = "text"):
    """A weight in [0.05, 1]: one less four times the share of digits and symbols; empty texts get 1."""
    t = F.col(text)
    odd = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * odd / F.greatest(F.length(t), F.lit(1)))


def words(text: str = "text"):
    """Number of words: starts of runs of characters other than white space. Null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, w, target) from (source, source_size): weights 3, 1, 2 by code point order of the source,
    null last; SHARE of all sizes by weight, at most MOST times a source's size, the excess shared anew.

    Sharing anew until none is above equals one water level: sources in the order of size / weight reach
    their bound until the level of the rest lies below the next bound. One row per source goes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn(
        "w", F.element_at(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)), (F.row_number().over(by_name) - 1) % 3 + 1)
    )
    fill = Window.orderBy((F.col("source_size") * MOST / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    out = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("source_size").over(upto), F.lit(0)) * MOST)
        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))),
    )
    # the first source whose bound lies above the level sets it; those before are at their bound
    free = F.col("source_size") * MOST / F.col("w") >= F.col("level")
    out = out.withColumn("water", F.min(F.when(free, F.struct(F.col("source_size") * MOST / F.col("w"), "level"))).over(everything))
    level = F.col("water.level")
    return out.select(
        "source", "source_size", "w",
        F.coalesce(F.least(level * F.col("w"), F.col("source_size") * MOST), F.col("source_size") * MOST).alias("target"),
    )


def mix(docs: DataFrame, weight=None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, epochs (whole times taken), part (words of one
    more, partial or whole, time).

    `weight` (a column over `text`) scales the chance of being among a source's fraction; by default `quality`.
    A source's taken words are its target rounded down, exactly: the document at the border gives its first
    words only. Null or wordless texts have size 0 and take nothing; a null source is a source of its own;
    repeated rows count each (ties in the order of keys, id and size; rows equal in all of these are
    alike). Other columns are not read.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text")), 1, 13), 16, 10).cast("double") + 1.0) / (
        2.0**52 + 1.0
    )
    keyed = slim.select("doc_id", "source", words("text").alias("size"), (-F.log(u) / (weight if weight is not None else quality("text"))).alias("key"))
    # a slice keeps the order of keys: 1 - exp(-key) spreads them evenly
    keyed = keyed.withColumn("slice", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * SLICES))
    keyed = settle(keyed)
    sums = settle(keyed.groupBy("source", "slice").agg(F.sum("size").alias("sum")))
    source = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")))
    budget = F.floor("target")
    source = source.select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).alias("epochs"),
    ).withColumn("budget", budget - F.col("epochs") * F.col("source_size"))
    source = settle(source)
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    border = sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    border = border.join(source, F.col("source").eqNullSafe(F.col("s"))).where("before <= budget and budget < before + sum")
    border = border.select(F.col("source").alias("b"), F.col("slice").alias("edge"), "before")
    source = source.join(border, F.col("s").eqNullSafe(F.col("b")), "left").drop("b")
    rows = keyed.join(source, F.col("source").eqNullSafe(F.col("s")))
    at_edge = F.col("slice") == F.col("edge")
    inner = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(at_edge).repartition("source", "slice").withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("start"))))
    rest = rows.where(~F.coalesce(at_edge, F.lit(False))).withColumn(
        "part", F.when(F.col("slice") < F.col("edge"), F.col("size")).otherwise(0)
    )
    columns = [
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        F.col("epochs").cast("int").alias("epochs"), "part",
    ]
    return edge.select(*columns).unionByName(rest.select(*columns))


def drawn(docs: DataFrame, weight=None) -> DataFrame:
    """`docs` as the mix takes them: each row `epochs` times, and once more if it is drawn for the fraction; the row at
    a source's border then holds its first `part` words, joined by spaces.

    Rows meet their share by id and by size: repeated rows of one id and text draw the same share each.
    """
    columns = docs.columns
    share = mix(docs, weight).where("taken > 0").groupBy("doc_id", F.col("source").alias("__s"), F.col("size").alias("__size")).agg(
        F.max("epochs").alias("__epochs"), F.max("part").alias("__part")
    )
    share = share.withColumnRenamed("doc_id", "__d")
    sized = docs.withColumn("__n", words("text"))
    taken = sized.join(
        share, sized["doc_id"].eqNullSafe(F.col("__d")) & sized["source"].eqNullSafe(F.col("__s")) & (F.col("__n") == F.col("__size"))
    )
    whole = F.col("__epochs") + F.when(F.col("__part") == F.col("__n"), 1).otherwise(0)
    some = (F.col("__part") > 0) & (F.col("__part") < F.col("__n"))
    copies = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.when(some, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("__part").cast("int")), " ")
    out = taken.withColumn("__cut", F.explode(copies))
    return out.withColumn("text", F.when(F.col("__cut"), cut).otherwise(F.col("text"))).select(*columns)

"""Row repairs on event logs and person tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spellwise.operators.ordered import CELL, keep, neighbours
from spellwise.operators.vocab import DEATH_POLICIES, GROUP_FLAGS, EventCodes, code_level, code_type


def neutralise_imputed_deaths(log: DataFrame, codes: EventCodes = EventCodes()) -> DataFrame:
    """Imputed deaths (``event_censor`` not 0) become lost to follow-up."""
    imputed = (F.col("event") == codes.death) & (F.col("event_censor") != 0)
    return log.withColumn("event", F.when(imputed, codes.lost).otherwise(F.col("event")))


def death_policy(log: DataFrame, policy: str, column: str = "event_censor") -> DataFrame:
    """Rows whose censor code is accepted under the policy."""
    return log.filter(F.col(column).isin(*DEATH_POLICIES[policy]))


def death_policies(log: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """The rows that each of several policies accepts, with the policy's name, in one pass.

    ``columns`` gives the censor code column that each policy reads.
    """
    accepted = [F.when(F.col(c).isin(*DEATH_POLICIES[p]), F.lit(p)) for p, c in columns.items()]
    return log.select("*", F.explode(F.array_compact(F.array(*accepted))).alias("policy"))


def clean_smoker(df: DataFrame, flag: str = "smoker", category: str = "smoker_cat3") -> DataFrame:
    """Light smokers (category 1) do not count as smokers."""
    return df.withColumn(flag, F.when(F.col(category) == "1", "0").otherwise(F.col(flag)))


def _flagged(df: DataFrame, hit: Column, key: str) -> DataFrame:
    """``df`` with a boolean telling whether any row of the same person is a hit."""
    ids = df.filter(hit).select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(ids, key, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def propagate_smoking(
    df: DataFrame, hit: Column, *, key: str = "id", flag: str = "smoker", category: str = "smoker_cat3"
) -> DataFrame:
    """People with the condition anywhere are smokers: flag 0 becomes 1, category 0 becomes 2."""
    cols = df.columns
    out = _flagged(df, hit, key)
    fix = lambda c, new: F.when(F.col("__hit") & (F.col(c) == "0"), new).otherwise(F.col(c))
    return out.withColumns({flag: fix(flag, "1"), category: fix(category, "2")}).select(*cols)


def reset_weight_if_any(df: DataFrame, events: Sequence[str], *, weight: str, key: str = "id") -> DataFrame:
    """Weight 1 for every row of a person with any of the events."""
    cols = df.columns
    out = _flagged(df, F.col("event").isin(*events), key)
    return out.withColumn(weight, F.when(F.col("__hit"), 1.0).otherwise(F.col(weight))).select(*cols)


def region_lookup(df: DataFrame, dim: DataFrame, *, key: str, value: str, sex_col: str | None = None) -> DataFrame:
    """Attach the region of a department (the dimension's male rows, which are unique)."""
    d = dim if sex_col is None else dim.filter(F.col(sex_col) == "M")
    return attach_dim(df, d.select(key, value), key)


def attach_dim(
    df: DataFrame, dim: DataFrame, key: str | Sequence[str], suffix: str = "_dim", *, first: bool = False
) -> DataFrame:
    """Left join on a dimension; clashing columns get a suffix.

    A key that the dimension holds twice doubles the rows, as a join does: :func:`duplicate_keys` tells beforehand.
    With ``first`` only the least match of each key is kept.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in dim.columns if c not in keys]
    named = [(c, c + suffix if c in df.columns else c) for c in rest]
    if first:
        dim = dim.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__d")).select(*keys, *[F.col(f"__d.{c}").alias(c) for c in rest])
    return df.join(dim.select(*keys, *[F.col(c).alias(n) for c, n in named]), keys, "left")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: a join on them would multiply rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def correct_event_date(log: DataFrame, corrections: DataFrame, code: str) -> DataFrame:
    """Replace the date of one event code where a correction row exists, by the earliest if there are several."""
    fix = corrections.groupBy("id", "event").agg(F.min("date_event").alias("__new"))
    new = F.when((F.col("event") == code) & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("date_event"))
    return log.join(fix, ["id", "event"], "left").withColumn("date_event", new).select(*log.columns)


def correct_event_date_long(
    log: DataFrame, corrections: DataFrame, code: str, *, target_age: str, any_age: str, first_age: str = "age_first",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Date correction that also repairs the wide age columns and the piece bounds.

    ``corrections``: id, new_date, new_age. The age column of the corrected event is
    cleared where the broader condition is absent and replaced otherwise; ``time2`` of the
    first corrected piece and ``time1`` of the piece after it follow. Neighbour rows are
    found day by day, so long histories stay spread out.
    """
    fix = corrections.groupBy("id").agg(
        F.min("new_date").alias("__date"), F.min("new_age").alias("__age"))
    df = log.join(fix, "id", "left").withColumn("__day", F.col("date_event"))
    has = F.col("__age").isNotNull()
    df = df.withColumn("date_event", F.when(has & (F.col("event") == code), F.col("__date")).otherwise(F.col("date_event")))
    cleared = F.when(has & (F.col(target_age) > 0) & (F.col(any_age) == 0), 0.0).otherwise(F.col(target_age))
    df = df.withColumn(target_age, cleared).withColumn("__row", has & (F.col(target_age) > 0) & (F.col(any_age) > 0))
    df = df.withColumn(target_age, F.when(F.col("__row"), F.col("__age")).otherwise(F.col(target_age)))
    df = df.withColumn(
        first_age,
        F.when(has & (F.col(target_age) > 0) & (F.col(target_age) == F.col(first_age)), F.col("__age")).otherwise(
            F.col(first_age)),
    )
    order = ["__day", *tie]
    df = df.withColumn(CELL, F.datediff("__day", F.lit("1970-01-01").cast("date")))
    df = neighbours(keep(df), ["id"], order, lag={"__prior_age": target_age})
    onset = F.coalesce(F.col("__row") & (F.col("__prior_age") == 0), F.lit(False))
    df = df.withColumn("time2", F.when(onset, F.col("__age")).otherwise(F.col("time2"))).withColumn(
        "__push", onset & (F.col("t_last") == 0))
    df = neighbours(keep(df), ["id"], order, lag={"__pushed": "__push", "__end": "time2"})
    df = df.withColumn("time1", F.when(F.coalesce("__pushed", F.lit(False)), F.col("__end")).otherwise(F.col("time1")))
    return df.select(*log.columns)


def event_dimension(
    log: DataFrame, *, codes: EventCodes = EventCodes(), groups: dict[str, tuple[str, ...]] = GROUP_FLAGS,
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """One row per event code: count, terminal flag, family, level and group flags.

    ``descriptions`` (event, optional pathol, texts) is joined in full, so codes nobody
    had appear with count zero.
    """
    dim = log.groupBy("event").agg(F.count("*").alias("n"))
    stored = F.lit(None).cast("string")
    if descriptions is not None:
        dim = dim.join(descriptions, "event", "full")
        if "pathol" in descriptions.columns:
            dim = dim.withColumnRenamed("pathol", "__pathol")
            stored = F.col("__pathol").cast("string")
    extra = [c for c in (descriptions.columns if descriptions is not None else []) if c not in ("event", "pathol")]
    return dim.select(
        "event",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.col("event").isin(*codes.terminal).alias("fin"),
        code_type("event").alias("type"),
        F.coalesce(stored, code_level("event")).alias("pathol"),
        *[F.col("event").isin(*members).alias(name) for name, members in groups.items()],
        *extra,
    )


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count and any-NULL flag per column, and rows with any NULL (column ``*``)."""
    any_null = None
    for c in columns:
        any_null = F.col(c).isNull() if any_null is None else any_null | F.col(c).isNull()
    one = df.agg(F.count_if(any_null).alias("__any"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in columns],
        F.struct(F.lit("*").alias("column"), F.col("__any").alias("n_null")),
    )
    return one.select(F.inline(rows)).withColumn("has_null", F.col("n_null") > 0)

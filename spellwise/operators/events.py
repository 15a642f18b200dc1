"""Person table and event-log preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spellwise.functions import YEAR_DAYS, age_at, beta_1_2, birth_from_age, hash_uniform
from spellwise.operators.ordered import last_n_per
from spellwise.operators.vocab import EventCodes


def normalize_individuals(
    log: DataFrame,
    attributes: Sequence[str],
    *,
    reference_date: str = "2008-01-01",
    age: str = "age_20080101",
    male: str = "male",
    imputed: DataFrame | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """One row per person: attributes, birth date, sex; optionally imputed risk factors.

    ``imputed`` (id plus factor columns) replaces the observed categories.
    """
    row = F.min_by(F.struct(age, male, *attributes), F.struct("date_event", *tie))
    one = log.groupBy("id").agg(row.alias("__p")).select("id", "__p.*")
    if imputed is not None:
        new = {c: c + "__new" for c in imputed.columns if c != "id"}
        one = one.join(imputed.withColumnsRenamed(new), "id", "left")
        one = one.withColumns({c: F.col(n) for c, n in new.items()}).drop(*new.values())
    ref = F.lit(reference_date).cast("date")
    return one.select(
        "id", *attributes, birth_from_age(age, ref).alias("birth_date"),
        F.when(F.col(male).cast("int") == 1, "M").otherwise("F").alias("sex"),
    )


def add_first_contact(
    log: DataFrame, contacts: DataFrame, *, codes: EventCodes = EventCodes(), tie: Sequence[str] = ()
) -> DataFrame:
    """Insert a no-illness row at the first contact when it precedes all events of the person."""
    rest = [c for c in log.columns if c not in ("id", "date_event", "event", "event_censor")]
    first = log.groupBy("id").agg(
        F.min("date_event").alias("__first"),
        F.min_by(F.struct(*(rest or ["date_event"])), F.struct("date_event", *tie)).alias("__row"),
    )
    contact = contacts.groupBy("id").agg(F.min("contact_date").alias("__contact"))
    new = first.join(contact, "id").filter(F.col("__contact") < F.col("__first"))
    clone = new.select(
        "id", F.col("__contact").alias("date_event"), F.lit(codes.no_illness).alias("event"),
        F.lit(0).alias("event_censor"), *[F.col(f"__row.{c}").alias(c) for c in rest],
    )
    return log.unionByName(clone)


def censor_events(
    log: DataFrame, date: str, *, codes: EventCodes = EventCodes(), tie: Sequence[str] = ()
) -> DataFrame:
    """Keep events up to ``date``; later ones become one lost-to-follow-up row at ``date``.

    Persons with nothing up to ``date`` also get a no-illness row there.
    """
    cut = F.lit(date).cast("date")
    rest = [c for c in log.columns if c not in ("id", "date_event", "event", "event_censor")]
    person = log.groupBy("id").agg(
        F.max("date_event").alias("__max"),
        F.min("date_event").alias("__min"),
        F.min_by(F.struct(*(rest or ["date_event"])), F.struct("date_event", *tie)).alias("__row"),
    ).filter(F.col("__max") > cut)
    added = F.array(
        F.struct(F.lit(True).alias("ok"), F.lit(codes.lost).alias("event"), F.lit(2).alias("event_censor")),
        F.struct((F.col("__min") > cut).alias("ok"), F.lit(codes.no_illness).alias("event"), F.lit(0).alias("event_censor")),
    )
    new = person.select("id", "__row", F.inline(added)).filter("ok").select(
        "id", cut.alias("date_event"), "event", "event_censor", *[F.col(f"__row.{c}").alias(c) for c in rest])
    return log.filter(F.col("date_event") <= cut).unionByName(new)


def drop_late_starters(log: DataFrame, year: int) -> DataFrame:
    """Keep persons whose first event lies before January of ``year``."""
    ids = log.groupBy("id").agg(F.min("date_event").alias("__m")).filter(F.year("__m") < year).select("id")
    return log.join(ids, "id", "left_semi")


def shift_births(
    log: DataFrame, births: DataFrame, *, min_age: float = 50.0, max_noise: float = 6.0, seed: int = 1
) -> DataFrame:
    """Move births back so that every first event falls at ``min_age`` or later.

    The shift is the shortfall plus Beta(1, 2) noise drawn from the person's id.
    Columns: id, birth_date, shortfall.
    """
    first = log.groupBy("id").agg(F.min("date_event").alias("__first"))
    df = births.select("id", "birth_date").join(first, "id")
    short = F.greatest(F.lit(0.0), F.lit(float(min_age)) - age_at("birth_date", "__first"))
    noise = (F.lit(float(max_noise)) - F.col("shortfall")) * beta_1_2(hash_uniform("id", seed=seed))
    total = F.col("shortfall") + F.when(F.col("shortfall") > 0, noise).otherwise(0.0)
    return df.withColumn("shortfall", short).select(
        "id", F.date_sub("birth_date", F.ceil(F.lit(YEAR_DAYS) * total).cast("int")).alias("birth_date"), "shortfall")


def death_cause(log: DataFrame, death: str, *, order: Sequence[str], key: str = "id", event: str = "event") -> DataFrame:
    """Event before the last one for persons whose last event is death, else NULL.

    Only the last two rows per person leave the map tasks.
    """
    last_two = last_n_per(log.select(key, event, *order), [key], order, 2)
    stamp = F.struct(*order)
    out = last_two.groupBy(key).agg(
        F.max_by(event, stamp).alias("last"), F.min_by(event, stamp).alias("before"), F.count("*").alias("n"))
    return out.select(key, F.when((F.col("last") == death) & (F.col("n") > 1), F.col("before")).alias("cause"))


def keep_persons(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the persons in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def drop_persons(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of all other persons (safe when ``ids`` holds NULLs)."""
    return df.join(ids.select(key), key, "left_anti")


def sample_ids(df: DataFrame, fraction: float, *, key: str = "id", seed: int = 1) -> DataFrame:
    """All rows of a reproducible share of persons; decided per row, without a shuffle."""
    return df.filter(hash_uniform(key, seed=seed) < fraction)


def sample_rows(df: DataFrame, fraction: float, *, keys: Sequence[str], seed: int = 1) -> DataFrame:
    """A reproducible share of rows, decided by the row's key columns."""
    return df.filter(hash_uniform(*keys, seed=seed) < fraction)


def exact_split(ids: DataFrame, fraction: float, *, key: str = "id", seed: int = 1) -> DataFrame:
    """Mark exactly ``floor(fraction * n)`` ids as training ids.

    Ids are ranked by hash. A histogram over hash slices finds the one slice holding the
    boundary; only that slice is ranked, so nothing sorts the whole table.
    """
    slices = 4096
    h = ids.select(key).distinct().withColumn("__u", hash_uniform(key, seed=seed))
    h = h.withColumn("__slice", F.floor(F.col("__u") * slices))
    hist = h.groupBy("__slice").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__slice")  # at most 4096 rows
    hist = hist.select(
        "__slice",
        (F.sum("__n").over(w) - F.col("__n")).alias("__before"),
        F.floor(F.sum("__n").over(Window.partitionBy()) * F.lit(float(fraction))).alias("__want"),
        "__n",
    )
    h = h.join(F.broadcast(hist), "__slice")
    inside = (F.col("__before") < F.col("__want")) & (F.col("__before") + F.col("__n") > F.col("__want"))
    rank = F.row_number().over(Window.partitionBy("__slice").orderBy("__u", key))
    edge = h.filter(inside).select(key, (F.col("__before") + rank <= F.col("__want")).alias("train"))
    rest = h.filter(~inside).select(key, (F.col("__before") + F.col("__n") <= F.col("__want")).alias("train"))
    return rest.unionByName(edge)


def recode(df: DataFrame, column: str, mapping: dict[str, str], *, default: Column | None = None) -> DataFrame:
    """Replace listed values of a column."""
    out = default if default is not None else F.col(column)
    for old, new in mapping.items():
        out = F.when(F.col(column) == old, new).otherwise(out)
    return df.withColumn(column, out)

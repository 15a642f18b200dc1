"""Typed readers and the table writer. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and types of the input files.
EVENT_LOG_DDL = (
    "DATE_EVENT DATE, EVENT STRING, EVENT_CENSOR INT, Age_20080101 DOUBLE, MALE STRING, ID INT, FDR_AUD_ALL STRING, "
    "FDR_OBESITY_CAT3 STRING, FDR_OBESITY_ALL STRING, CP_DEP STRING, CP_IMMI STRING, CP_DIPL0 STRING, "
    "PROB_HOSP0813 DOUBLE, CP_REG2 STRING, FDR_SMOKER STRING, Date0_PATHOL1 DATE, FDR_AUD_CAT3 STRING, FDR_SMOKER_CAT3 STRING"
)
IMPUTED_DDL = "ID INT, FDR_AUD_CAT3 INT, FDR_SMOKER_CAT3 INT"
CORRECTION_DDL = "ID INT, EVENT STRING, DATE_EVENT DATE"
CONTACT_DDL = "ID INT, Date0_HOPITAL DATE"
DEPARTMENT_DDL = (
    "nom_fichier STRING, region2 STRING, region3 STRING, cp_reg STRING, cp_reg_2 STRING, cp_reg_3 STRING, "
    "cp_dep STRING, sexe STRING"
)
PYRAMID_DDL = "ANNEE DOUBLE, SEXE STRING, AGE INT, POP INT"
PATHOLOGY_DDL = (
    "PATHOL INT, EVENT STRING, EVENT_EN STRING, Description STRING, Description_en STRING, "
    "`PATHO0 => PATHO1` STRING, Remarque STRING"
)
ATTRITION_DDL = (
    "level INT, criteria_en STRING, criteria_fr STRING, years STRING, pop_size STRING, percent STRING, "
    "pop_remain STRING, percent_of_total STRING"
)
DIAGNOSIS_DDL = "level INT, Variables STRING, icd10 STRING"
MORTALITY_DDL = "age DOUBLE, qx DOUBLE, lx DOUBLE, ex DOUBLE"
US_DATE = "M/d/yyyy"


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_event_csv(spark: SparkSession, paths: str | Sequence[str], schema: str = EVENT_LOG_DDL, *,
                   source_column: str | None = None, bad_column: str | None = None) -> DataFrame:
    """Several typed CSV files with US dates as one table; optionally with each row's file name.

    ``NA`` stands for a missing value. Columns are matched by the names in each file's header, in any order and case; a
    missing one raises, further ones are left out. A record whose values don't fit their types keeps its text in
    ``bad_column``, if one is named, and else stops the read.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {f.name.lower(): f for f in _type_of(spark, schema).fields}
    df = None
    for path in paths:
        head = spark.read.option("header", True).csv(path).columns
        missing = set(kinds) - {c.strip().lower() for c in head}
        if missing:
            raise ValueError(f"{path}: no column {sorted(missing)}")
        fields = [kinds.get(c.strip().lower()) for c in head]
        ddl = [f"`c{i}` {f.dataType.simpleString() if f else 'string'}" for i, f in enumerate(fields)]
        reader = spark.read.option("header", True).option("dateFormat", US_DATE).option("nullValue", "NA")
        if bad_column:
            reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad_column)
            ddl.append(f"`{bad_column}` string")
        else:
            reader = reader.option("mode", "FAILFAST")
        part = reader.schema(", ".join(ddl)).csv(path)
        place = {f.name: f"c{i}" for i, f in enumerate(fields) if f}
        bad = []
        if bad_column:
            # Spark finds a record bad by the columns it reads only; the hash makes it read all of them, whatever is asked for
            side = F.when(F.hash(*place.values()) >= 0, 1).otherwise(-1)
            bad = [F.element_at(F.array(F.col(f"`{bad_column}`")), side).alias(bad_column)]
        part = part.select(
            *[F.col(place[f.name]).alias(f.name) for f in kinds.values()], *bad,
            *([F.col("_metadata.file_name").alias(source_column)] if source_column else []))
        df = part if df is None else df.unionByName(part)
    return lower_names(df)


def _type_of(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def read_csv2(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Semicolon-separated file with decimal commas."""
    wanted = _type_of(spark, schema)
    text = ", ".join(f"`{f.name}` STRING" for f in wanted)
    raw = spark.read.schema(text).option("header", True).option("sep", ";").option("nullValue", "NA").csv(path)

    def typed(f) -> Column:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("double", "float"):
            return decimal_comma(c).alias(f.name)
        if f.dataType.typeName() in ("integer", "long"):
            return F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})").alias(f.name)
        return c.alias(f.name)

    return lower_names(raw.select(*[typed(f) for f in wanted]))


def decimal_comma(c: Column) -> Column:
    """Number from a text with decimal comma."""
    return F.regexp_replace(F.trim(c), ",", ".").try_cast("double")


def thousands(c: Column) -> Column:
    """Whole number from a text with blanks between the thousands."""
    return F.regexp_replace(c, r"[\s ]", "").try_cast("bigint")


def percent(c: Column) -> Column:
    """Share from a text such as ``25,7%``."""
    return decimal_comma(F.regexp_replace(c, "[%\"]", "")) / F.lit(100.0)


def wide_stats_long(df: DataFrame, key: str, names: Sequence[str], years: Sequence[str], *, value: str = "hly") -> DataFrame:
    """Wide statistics table to long: composite key split, ``":"`` is missing, flags set apart.

    Columns: ``names``, year, ``value``, note.
    """
    long = df.unpivot(F.col(key), [F.col(f"`{y}`") for y in years], "year", "__raw")
    raw = F.nullif(F.trim("__raw"), F.lit(":"))
    note = F.nullif(F.split_part(raw, F.lit(" "), F.lit(2)), F.lit(""))
    return long.select(
        *[F.trim(F.split_part(F.col(key), F.lit(","), F.lit(i))).alias(n) for i, n in enumerate(names, start=1)],
        F.trim("year").cast("int").alias("year"),
        F.split_part(raw, F.lit(" "), F.lit(1)).try_cast("double").alias(value),
        note.alias("note"),
    )


def read_wide_stats(spark: SparkSession, path: str, years: Sequence[int] = tuple(range(2020, 2003, -1)), *,
                    names: Sequence[str] = ("unit", "sex", "indic_he", "geo")) -> DataFrame:
    """Gzipped or plain TSV with one column per year, in long form."""
    cols = [str(y) for y in years]
    schema = "info STRING, " + ", ".join(f"`{y}` STRING" for y in cols)
    raw = spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
    return wide_stats_long(raw, "info", names, cols)


def attrition_share(df: DataFrame) -> DataFrame:
    """Numbers of an attrition table, and each size as a share of the largest."""
    out = df.withColumns({
        "pop_size": thousands(F.col("pop_size")),
        "pop_remain": thousands(F.col("pop_remain")),
        "percent": percent(F.col("percent")),
        "percent_of_total": percent(F.col("percent_of_total")),
    })
    return out.withColumn("share", F.col("pop_size") / out.agg(F.max("pop_size")).scalar())


def read_attrition_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = (
        spark.read.schema(ATTRITION_DDL).option("header", True).option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True).option("escape", '"').csv(path)
    )
    return attrition_share(raw)


def read_lookup(spark: SparkSession, path: str, schema: str, *, sep: str = ",") -> DataFrame:
    """Small dimension table from CSV."""
    return lower_names(
        spark.read.schema(schema).option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True).csv(path))


def diagnosis_codes(df: DataFrame, col: str = "icd10") -> DataFrame:
    """One row per code or code range of a ``;``-separated list."""
    code = F.explode(F.split(F.col(col), ";"))
    out = df.withColumn("__c", code).withColumn("__c", F.trim("__c")).filter(F.col("__c") != "")
    part = lambda i: F.trim(F.split_part(F.col("__c"), F.lit("-"), F.lit(i)))
    return out.withColumns({"code_from": part(1), "code_to": F.coalesce(F.nullif(part(2), F.lit("")), part(1))}).drop("__c")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), bucket_by: tuple[int, str] | None = None,
                table: str | None = None, mode: str = "overwrite") -> None:
    """Columnar table. ``bucket_by=(n, "id")`` with a table name lets later joins and aggregates on the id skip the shuffle;
    rows are dealt to their buckets once, so there is one sorted file per bucket."""
    if bucket_by:
        df = df.repartition(*bucket_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if bucket_by:
        if table is None:
            raise ValueError("bucketed output needs a table name")
        n, key = bucket_by
        w.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    else:
        w.parquet(path)

"""Queries on scans, cleaning, joins, aggregates, populations and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from spellwise import functions as E
from spellwise.operators import cleaning as K
from spellwise.operators import curves as C
from spellwise.operators import describe as D
from spellwise.operators import events as V
from spellwise.operators import ordered as O
from spellwise.operators import population as P
from spellwise.operators import quality as Q
from spellwise.operators import spells as S
from spellwise.plans import fixtures as X
from spellwise.plans.oracle_views import age, anniversary, uniform, whole_age, with_views
from spellwise.plans.queries_survival import AGES, disfle_sql, knots_sql, r6
from spellwise.plans.registry import query
from spellwise.sources import readers as R

# ---------------------------------------------------------------- scans and cleaning


@query("scan_events", with_views("SELECT id, src, date_event, event, event_censor FROM event_log"))
def scan_events(spark, sf):
    return X.event_log(spark, sf)


@query("recode_events", with_views("""
    SELECT id, src, CASE event WHEN 'NO_ILLNESS' THEN 'NONE' WHEN 'LOST' THEN 'CENSORED' ELSE event END AS event,
           CASE WHEN event_censor = 2 THEN 1 ELSE event_censor END AS event_censor FROM event_log"""))
def recode_events(spark, sf):
    log = V.recode(X.event_log(spark, sf), "event", {"NO_ILLNESS": "NONE", "LOST": "CENSORED"})
    return log.select("id", "src", "event", F.when(F.col("event_censor") == 2, 1).otherwise(F.col("event_censor")).alias("event_censor"))


def raw_deaths(spark, sf):
    """Log with the terminal row called death whatever its censor code, as before imputation is undone."""
    log = X.event_log(spark, sf)
    return log.withColumn("event", F.when(F.col("event") == "LOST", "DEATH").otherwise(F.col("event")))


@query("neutralise_imputed", with_views("""
    SELECT id, src, CASE WHEN event IN ('DEATH', 'LOST') THEN CASE WHEN event_censor <> 0 THEN 'LOST' ELSE 'DEATH' END
           ELSE event END AS event FROM event_log"""))
def neutralise_imputed(spark, sf):
    return K.neutralise_imputed_deaths(raw_deaths(spark, sf), X.CODES).select("id", "src", "event")


@query("death_policy", with_views("""
    SELECT p AS policy, count(*) AS n FROM (
      SELECT 'observed' AS p FROM event_log WHERE event IN ('DEATH', 'LOST') AND event_censor = 0
      UNION ALL SELECT 'observed_or_severe' FROM event_log WHERE event IN ('DEATH', 'LOST') AND event_censor IN (0, 1)
      UNION ALL SELECT 'imputed' FROM event_log WHERE event IN ('DEATH', 'LOST') AND event_censor IN (0, 1, 2)
      UNION ALL SELECT 'imputed_sp95' FROM event_log WHERE event IN ('DEATH', 'LOST') AND event_censor + src % 2 IN (0, 1, 3))
    GROUP BY p"""))
def death_policy(spark, sf):
    deaths = raw_deaths(spark, sf).filter(F.col("event") == "DEATH").withColumn(
        "event_censor_sp95", (F.col("event_censor") + F.col("src") % 2).cast("int"))
    columns = {p: "event_censor_sp95" if p == "imputed_sp95" else "event_censor" for p in ("observed", "observed_or_severe", "imputed", "imputed_sp95")}
    return K.death_policies(deaths, columns).groupBy("policy").agg(F.count("*").alias("n"))


@query("clean_smoker", with_views("""
    SELECT id, CASE WHEN smoker_cat3 = '0' THEN '0' WHEN smoker_cat3 = '1' THEN '0' ELSE '1' END AS smoker, smoker_cat3 FROM individuals"""))
def clean_smoker(spark, sf):
    i = X.individuals(spark, sf).withColumn("smoker", F.when(F.col("smoker_cat3") == "0", "0").otherwise("1"))
    return K.clean_smoker(i).select("id", "smoker", "smoker_cat3")


def log_with_smoking(spark, sf):
    i = X.individuals(spark, sf).select("id", "smoker_cat3", F.when(F.col("smoker_cat3") == "2", "1").otherwise("0").alias("smoker"))
    return X.event_log(spark, sf).join(i, "id")


@query("propagate_flag", with_views("""
    SELECT e.id, e.src, CASE WHEN h.id IS NOT NULL AND s = '0' THEN '1' ELSE s END AS smoker,
           CASE WHEN h.id IS NOT NULL AND smoker_cat3 = '0' THEN '2' ELSE smoker_cat3 END AS smoker_cat3
    FROM event_log e JOIN (SELECT id, smoker_cat3, CASE WHEN smoker_cat3 = '2' THEN '1' ELSE '0' END AS s FROM individuals) i ON e.id = i.id
    LEFT JOIN (SELECT DISTINCT id FROM event_log WHERE event = 'ILL0_C') h ON e.id = h.id"""))
def propagate_flag(spark, sf):
    out = K.propagate_smoking(log_with_smoking(spark, sf), F.col("event") == "ILL0_C")
    return out.select("id", "src", "smoker", "smoker_cat3")


@query("reset_weight", with_views("""
    SELECT id, src, CASE WHEN id IN (SELECT id FROM event_log WHERE event IN ('ILL1_A', 'ILL1_B')) THEN 1.0::DOUBLE
           ELSE CAST(src % 7 AS DOUBLE) / 7 + 0.5::DOUBLE END AS weight FROM event_log"""))
def reset_weight(spark, sf):
    log = X.event_log(spark, sf).withColumn("weight", (F.col("src") % 7).cast("double") / 7 + F.lit(0.5))
    return K.reset_weight_if_any(log, ["ILL1_A", "ILL1_B"], weight="weight").select("id", "src", "weight")


@query("region_lookup", with_views("SELECT i.id, i.dep, r.region FROM individuals i LEFT JOIN regions r ON i.dep = r.dep"))
def region_lookup(spark, sf):
    i = X.individuals(spark, sf).select("id", "dep")
    dim = X.regions(spark, sf).withColumn("sexe", F.explode(F.array(F.lit("F"), F.lit("M"))))
    return K.region_lookup(i, dim, key="dep", value="region", sex_col="sexe").select("id", "dep", "region")


@query("date_correction", with_views("""
    SELECT e.id, e.src, e.event, CASE WHEN e.event = 'ILL1_A' AND c.id IS NOT NULL THEN c.date_event ELSE e.date_event END AS date_event
    FROM event_log e LEFT JOIN corrections c ON e.id = c.id AND e.event = c.event"""))
def date_correction(spark, sf):
    return K.correct_event_date(X.event_log(spark, sf), X.corrections(spark, sf), "ILL1_A").select("id", "src", "event", "date_event")


_WIDE = f"""
    SELECT e.id, e.src, e.date_event, e.event, l.t_last, a.a AS age_a, a.b AS age_b, a.a AS age_first,
           lag(x, 1, {age('birth_date', "DATE '1995-01-01'")}) OVER (PARTITION BY e.id ORDER BY e.date_event, e.src) AS time1,
           x AS time2
    FROM (SELECT e.*, i.birth_date, {age('birth_date', 'e.date_event')} AS x FROM event_log e JOIN individuals i ON e.id = i.id) e
    JOIN (SELECT id, src, CASE WHEN rn = 1 THEN 1 ELSE 0 END AS t_last FROM (
            SELECT id, src, row_number() OVER (PARTITION BY id ORDER BY date_event DESC, src DESC) AS rn FROM event_log)) l
      ON e.id = l.id AND e.src = l.src
    JOIN (SELECT id, src,
             coalesce(max(CASE WHEN event = 'ILL1_A' THEN x END) OVER w, 0) AS a,
             coalesce(max(CASE WHEN event = 'ILL1_B' THEN x END) OVER w, 0) AS b
          FROM (SELECT e.*, {age('birth_date', 'e.date_event')} AS x FROM event_log e JOIN individuals i ON e.id = i.id)
          WINDOW w AS (PARTITION BY id ORDER BY date_event, src ROWS UNBOUNDED PRECEDING)) a
      ON e.id = a.id AND e.src = a.src"""
_FIXES = f"""
    SELECT i.id, min(date_event) - 30 AS new_date, {age('any_value(birth_date)', '(min(date_event) - 30)')} AS new_age
    FROM event_log e JOIN individuals i ON e.id = i.id WHERE event = 'ILL1_A' AND i.id % 10 < 5 GROUP BY i.id"""


@query("date_correction_neighbours", with_views("""
    SELECT id, src, event, date_event, round(age_a, 6) AS age_a, round(age_first, 6) AS age_first, round(time2n, 6) AS time2,
           round(CASE WHEN coalesce(lag(onset AND t_last = 0) OVER w, false) THEN lag(time2n) OVER w ELSE time1 END, 6) AS time1
    FROM (SELECT *, CASE WHEN onset THEN new_age ELSE time2 END AS time2n FROM (
      SELECT *, coalesce(in_row AND lag(age_a) OVER w = 0, false) AS onset FROM (
        SELECT id, src, event, day, t_last, time1, time2, new_age,
          CASE WHEN new_age IS NOT NULL AND event = 'ILL1_A' THEN new_date ELSE day END AS date_event,
          new_age IS NOT NULL AND age_a > 0 AND age_b > 0 AS in_row,
          CASE WHEN new_age IS NOT NULL AND age_a > 0 THEN CASE WHEN age_b > 0 THEN new_age ELSE 0.0::DOUBLE END ELSE age_a END AS age_a,
          CASE WHEN new_age IS NOT NULL AND age_a > 0 AND age_b > 0 AND new_age = age_first THEN new_age ELSE age_first END AS age_first
        FROM (SELECT w.*, w.date_event AS day, f.new_date, f.new_age FROM widelog w LEFT JOIN fixes f ON w.id = f.id))
      WINDOW w AS (PARTITION BY id ORDER BY day, src)))
    WINDOW w AS (PARTITION BY id ORDER BY day, src)""", widelog=_WIDE, fixes=_FIXES))
def date_correction_neighbours(spark, sf):
    birth = X.individuals(spark, sf).select("id", "birth_date")
    log = X.age_of_event(X.event_log(spark, sf).join(birth, "id"))
    log = log.withColumn(O.CELL, F.datediff("date_event", X.date("1970-01-01")))
    known = lambda code: F.when(F.col("event") == code, F.col("age_event"))
    # Running age of each condition: the latest one seen so far (ages only grow with time).
    log = O.keep(log.withColumns({"na": -F.coalesce(known("ILL1_A"), F.lit(0.0)), "nb": -F.coalesce(known("ILL1_B"), F.lit(0.0))}))
    order = ["date_event", "src"]
    log = O.keep(O.running_min(log, ["id"], order, {"na": "na", "nb": "nb"}))
    n = O.neighbours(log, ["id"], order, lag={"prev": "age_event"}, lead={"nxt": "src"})
    wide = n.select(
        "id", "src", "date_event", "event", F.when(F.col("nxt").isNull(), 1).otherwise(0).alias("t_last"), (-F.col("na")).alias("age_a"),
        (-F.col("nb")).alias("age_b"), (-F.col("na")).alias("age_first"),
        F.coalesce("prev", E.age_at("birth_date", X.date("1995-01-01"))).alias("time1"), F.col("age_event").alias("time2"))
    first = X.event_log(spark, sf).filter((F.col("event") == "ILL1_A") & (F.col("id") % 10 < 5)).groupBy("id").agg(
        F.date_sub(F.min("date_event"), 30).alias("new_date"))
    fixes = first.join(birth, "id").select("id", "new_date", E.age_at("birth_date", "new_date").alias("new_age"))
    out = K.correct_event_date_long(wide, fixes, "ILL1_A", target_age="age_a", any_age="age_b", tie=["src"])
    return out.select("id", "src", "event", "date_event", r6("age_a", "age_a"), r6("age_first", "age_first"),
                      r6("time2", "time2"), r6("time1", "time1"))


@query("birth_date", with_views("SELECT id, birth_date FROM individuals"))
def birth_date(spark, sf):
    i = X.individuals(spark, sf)
    return i.select("id", E.birth_from_age("age_ref", X.date(X.REFERENCE_DATE)).alias("birth_date"))


@query("age_at_event", with_views(f"""
    SELECT e.id, src, round({age('birth_date', 'date_event')}, 6) AS age_event, CAST({whole_age('birth_date', 'date_event')} AS INTEGER) AS years,
           {anniversary('birth_date', '50')} AS birthday_50
    FROM event_log e JOIN individuals i ON e.id = i.id"""))
def age_at_event(spark, sf):
    j = X.event_log(spark, sf).join(X.individuals(spark, sf), "id")
    return j.select("id", "src", r6(E.age_at("birth_date", "date_event"), "age_event"),
                    E.whole_age("birth_date", "date_event").alias("years"), E.anniversary("birth_date", 50).alias("birthday_50"))


GROUPS = {"ill_a": ("ILL1_A",), "ill_any": ("ILL1_A", "ILL1_B", "ILL0_C")}


@query("event_dimension", with_views("""
    SELECT event, count(*) AS n, event IN ('DEATH', 'LOST') AS fin, split_part(event, '_', 1) AS type,
           nullif(regexp_extract(event, '[012]'), '') AS pathol, event = 'ILL1_A' AS ill_a, event IN ('ILL1_A', 'ILL1_B', 'ILL0_C') AS ill_any
    FROM event_log GROUP BY event"""))
def event_dimension(spark, sf):
    return K.event_dimension(X.event_log(spark, sf), codes=X.CODES, groups=GROUPS)


@query("collapse_events", with_views("""
    SELECT id, src, CASE WHEN event IN ('ILL1_A', 'ILL1_B', 'DEATH') THEN 'ILL' ELSE event END AS event FROM event_log"""))
def collapse_events(spark, sf):
    log = X.event_log(spark, sf)
    dim = K.event_dimension(log, codes=X.CODES, groups={})
    return S.collapse_events(log, codes=X.CODES, dim=dim).select("id", "src", "event")


BREAKS = [0.2, 0.7, 1.1, 1.5]


@query("risk_group", """
    SELECT l_orderkey, l_linenumber, CASE WHEN x <= 0.2 THEN '(-Inf,0.2]' WHEN x <= 0.7 THEN '(0.2,0.7]' WHEN x <= 1.1 THEN '(0.7,1.1]'
           WHEN x <= 1.5 THEN '(1.1,1.5]' ELSE '(1.5, Inf]' END AS risk_group
    FROM (SELECT l_orderkey, l_linenumber, l_discount * 20 AS x FROM lineitem)""")
def risk_group(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", E.right_closed_cut(F.col("l_discount") * 20, BREAKS).alias("risk_group"))


@query("null_audit", with_views("""
    SELECT c AS "column", n AS n_null, n > 0 AS has_null FROM (
      SELECT 'cause_date' AS c, count(*) FILTER (WHERE cause_date IS NULL) AS n FROM x
      UNION ALL SELECT 'region', count(*) FILTER (WHERE region IS NULL) FROM x
      UNION ALL SELECT 'sex', count(*) FILTER (WHERE sex IS NULL) FROM x
      UNION ALL SELECT '*', count(*) FILTER (WHERE cause_date IS NULL OR region IS NULL OR sex IS NULL) FROM x)""",
    x="""SELECT i.id, i.sex, CASE WHEN r.region = 'ASIA' THEN NULL ELSE r.region END AS region, d.d AS cause_date
         FROM individuals i LEFT JOIN regions r ON i.dep = r.dep
         LEFT JOIN (SELECT id, min(date_event) AS d FROM event_log WHERE event = 'DEATH' GROUP BY id) d ON i.id = d.id"""))
def null_audit(spark, sf):
    d = X.event_log(spark, sf).filter(F.col("event") == "DEATH").groupBy("id").agg(F.min("date_event").alias("cause_date"))
    x = X.individuals(spark, sf).join(X.regions(spark, sf), "dep", "left").join(d, "id", "left")
    x = x.withColumn("region", F.nullif("region", F.lit("ASIA")))
    return K.null_audit(x, ["cause_date", "region", "sex"])


@query("dummy_columns", with_views("""
    SELECT id, CASE WHEN smoker_cat3 = '0' THEN 1.0 ELSE 0.0 END::DOUBLE AS smoker_cat30,
           CASE WHEN smoker_cat3 = '2' THEN 1.0 ELSE 0.0 END::DOUBLE AS smoker_cat32,
           CAST(CASE smoker_cat3 WHEN '1' THEN 1 WHEN '0' THEN 2 WHEN '2' THEN 3 END AS INTEGER) AS smoker_rank FROM individuals"""))
def dummy_columns(spark, sf):
    d = E.dummies("smoker_cat3", ["0", "1", "2"], reference="1")
    return X.individuals(spark, sf).select("id", *[c.alias(n) for n, c in d.items()],
                                           E.level_rank("smoker_cat3", ["1", "0", "2"]).alias("smoker_rank"))


_DEP = """SELECT 'dep' || CAST(c_nationkey AS VARCHAR) AS term, exp(avg(c_acctbal) / 10000) AS estimate, CAST(count(*) % 20 AS DOUBLE) / 100 AS p
          FROM customer WHERE c_nationkey <> 0 GROUP BY c_nationkey
          UNION ALL SELECT 'dep0', 1.0::DOUBLE, NULL"""


@query("region_effects", with_views("""
    SELECT r.region, round(avg(e.est), 6) AS estimate, count(e.est) AS n_significant FROM (
      SELECT regexp_extract(term, 'dep([0-9]+)', 1) AS dep, CASE WHEN p > 0.05 THEN NULL
             ELSE estimate / (SELECT estimate FROM deps WHERE term = 'dep7') END AS est FROM deps) e
    JOIN regions r ON e.dep = r.dep GROUP BY r.region""", deps=_DEP))
def region_effects(spark, sf):
    """Department effects: reference row added, rescaled to one department, masked, averaged by region."""
    c = X.table(spark, sf, "customer").filter(F.col("c_nationkey") != 0)
    coefs = c.groupBy("c_nationkey").agg(
        F.exp(F.avg("c_acctbal") / 10000).alias("estimate"), ((F.count("*") % 20).cast("double") / 100).alias("p"))
    coefs = coefs.select(F.concat(F.lit("dep"), F.col("c_nationkey")).alias("term"), "estimate", "p")
    ref = spark.createDataFrame([("dep0", 1.0, None)], "term string, estimate double, p double")
    coefs = coefs.unionByName(ref)
    base = coefs.agg(F.max(F.when(F.col("term") == "dep7", F.col("estimate"))))
    coefs = coefs.select(
        F.regexp_extract("term", "dep([0-9]+)", 1).alias("dep"),
        E.mask_if_not_significant(F.col("estimate") / base.scalar(), "p").alias("est"))
    out = coefs.join(X.regions(spark, sf).select("dep", "region"), "dep")
    return out.groupBy("region").agg(r6(F.avg("est"), "estimate"), F.count("est").alias("n_significant"))


# ---------------------------------------------------------------- joins


@query("attach_dims", with_views("""
    SELECT i.id, i.smoker_cat3, m.smoker_cat3 AS smoker_cat3_imput, m.alcohol_cat3 AS alcohol_cat3_imput, r.region, c.contact_date
    FROM individuals i LEFT JOIN imputed m ON i.id = m.id LEFT JOIN regions r ON i.dep = r.dep LEFT JOIN contacts c ON i.id = c.id"""))
def attach_dims(spark, sf):
    i = K.attach_dim(X.individuals(spark, sf), X.imputed(spark, sf), "id", suffix="_imput")
    i = K.attach_dim(i, X.regions(spark, sf).select("dep", "region"), "dep")
    i = K.attach_dim(i, X.contacts(spark, sf), "id")
    return i.select("id", "smoker_cat3", "smoker_cat3_imput", "alcohol_cat3_imput", "region", "contact_date")


VIEW_EXIT = {"exits": """SELECT i.id, i.sex, i.birth_date, coalesce(d.date_event, DATE '1999-12-31') AS date_event, coalesce(d.event, 'LOST') AS event
    FROM (SELECT * FROM event_log WHERE event = 'DEATH') d RIGHT JOIN individuals i ON d.id = i.id"""}


def exits(spark, sf):
    return P.exit_or_end(X.individuals(spark, sf).select("id", "sex", "birth_date"), X.event_log(spark, sf), end="1999-12-31", codes=X.CODES)


@query("exit_or_end", with_views("SELECT id, date_event, event FROM exits", **VIEW_EXIT))
def exit_or_end(spark, sf):
    return exits(spark, sf).select("id", "date_event", "event")


@query("before_after_counts", with_views("""
    SELECT coalesce(a.event, b.event) AS event, n_before, n_after FROM
      (SELECT event, count(*) AS n_before FROM event_log WHERE year(date_event) < 1996 GROUP BY event) a
      FULL JOIN (SELECT event, count(*) AS n_after FROM event_log WHERE year(date_event) >= 1996 GROUP BY event) b ON a.event = b.event"""))
def before_after_counts(spark, sf):
    return D.before_after_counts(X.event_log(spark, sf), "event", F.year("date_event") < 1996)


@query("semi_ids", with_views("SELECT id, src, event FROM event_log WHERE id IN (SELECT id FROM contacts)"))
def semi_ids(spark, sf):
    return V.keep_persons(X.event_log(spark, sf), X.contacts(spark, sf)).select("id", "src", "event")


@query("anti_ids", with_views("""
    SELECT id, sex FROM individuals WHERE id NOT IN (SELECT id FROM event_log WHERE event = 'DEATH' AND date_event < DATE '1998-01-01')"""))
def anti_ids(spark, sf):
    gone = X.event_log(spark, sf).filter((F.col("event") == "DEATH") & (F.col("date_event") < X.date("1998-01-01")))
    return V.drop_persons(X.individuals(spark, sf), gone).select("id", "sex")


@query("profile_grid", with_views("""
    SELECT s.sex, o.obesity_cat3, a.alcohol_cat3, m.smoker_cat3, count(i.id) AS n
    FROM (SELECT DISTINCT sex FROM individuals) s, (SELECT DISTINCT obesity_cat3 FROM individuals) o,
         (SELECT DISTINCT alcohol_cat3 FROM individuals) a, (SELECT DISTINCT smoker_cat3 FROM individuals) m
    LEFT JOIN individuals i ON i.sex = s.sex AND i.obesity_cat3 = o.obesity_cat3 AND i.alcohol_cat3 = a.alcohol_cat3
         AND i.smoker_cat3 = m.smoker_cat3 GROUP BY ALL"""))
def profile_grid(spark, sf):
    """All combinations of the observed levels, with the number of persons in each."""
    i = X.individuals(spark, sf)
    factors = ["sex", "obesity_cat3", "alcohol_cat3", "smoker_cat3"]
    grid = i.select(factors[0]).distinct()
    for f in factors[1:]:
        grid = C.with_each(grid, i.select(f).distinct())
    seen = i.groupBy(*factors).agg(F.count("*").alias("n"))
    return grid.join(seen, factors, "left").withColumn("n", F.coalesce("n", F.lit(0)))


_RATE = """SELECT v1 AS var, val, sum(CAST(event_flag AS INTEGER)) / sum(exit_age - entry_age) AS rate FROM (
    SELECT 'obesity' AS v1, obesity_cat3 AS val, event_flag, entry_age, exit_age FROM spells
    UNION ALL SELECT 'alcohol', alcohol_cat3, event_flag, entry_age, exit_age FROM spells
    UNION ALL SELECT 'smoker', smoker_cat3, event_flag, entry_age, exit_age FROM spells) GROUP BY v1, val"""


@query("naive_interaction", with_views("""
    WITH hr AS (SELECT a.var, a.rate / b.rate AS fit FROM rates a JOIN rates b ON a.var = b.var AND a.val = '2' AND b.val = '0'),
    pairs AS (SELECT a.var AS var1, b.var AS var2, a.fit FROM hr a JOIN hr b ON a.var <> b.var)
    SELECT x.var1, x.var2, round(x.fit * y.fit, 6) AS fit FROM pairs x LEFT JOIN pairs y ON x.var1 = y.var2 AND x.var2 = y.var1""",
    rates=_RATE))
def naive_interaction(spark, sf):
    """Product of two main effects: the pair (A, B) is matched with (B, A)."""
    factors = ["obesity", "alcohol", "smoker"]
    long = X.spells(spark, sf).select("event_flag", "entry_age", "exit_age", F.inline(F.array(*[
        F.struct(F.lit(f).alias("var"), F.col(f + "_cat3").alias("val")) for f in factors])))
    rate = lambda v: F.sum(F.when(F.col("val") == v, F.col("event_flag").cast("int"))) / F.sum(
        F.when(F.col("val") == v, F.col("exit_age") - F.col("entry_age")))
    hr = long.groupBy("var").agg((rate("2") / rate("0")).alias("fit"))
    others = F.filter(F.array(*[F.lit(f) for f in factors]), lambda o: o != F.col("var"))
    pairs = hr.select(F.col("var").alias("var1"), F.explode(others).alias("var2"), "fit")
    swapped = pairs.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), F.col("fit").alias("fit_y"))
    return pairs.join(swapped, ["var1", "var2"], "left").select("var1", "var2", r6(F.col("fit") * F.col("fit_y"), "fit"))


# ---------------------------------------------------------------- aggregates


@query("counts", with_views("""
    SELECT event, count(*) AS n, count(DISTINCT id) AS n_persons, count(DISTINCT date_event) AS n_days FROM event_log GROUP BY event"""))
def counts(spark, sf):
    return X.event_log(spark, sf).groupBy("event").agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_persons"), F.count_distinct("date_event").alias("n_days"))


@query("frequency_share", with_views("SELECT event, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM event_log) AS DOUBLE), 6) AS p FROM event_log GROUP BY event"))
def frequency_share(spark, sf):
    return D.frequency_share(X.event_log(spark, sf), "event").select("event", "n", r6("p", "p"))


@query("person_rollup", with_views(f"""
    SELECT id, count(*) AS n, round(min(a), 6) AS min_age, round(max(a), 6) AS max_age, round(avg(a), 6) AS mean_age,
           CAST(sum(event_censor) AS BIGINT) AS sum_censor
    FROM (SELECT e.*, {age('birth_date', 'date_event')} AS a FROM event_log e JOIN individuals i ON e.id = i.id) GROUP BY id"""))
def person_rollup(spark, sf):
    x = X.age_of_event(X.event_log(spark, sf).join(X.individuals(spark, sf).select("id", "birth_date"), "id"))
    return x.groupBy("id").agg(F.count("*").alias("n"), r6(F.min("age_event"), "min_age"), r6(F.max("age_event"), "max_age"),
                               r6(F.avg("age_event"), "mean_age"), F.sum("event_censor").alias("sum_censor"))


@query("age_at_first_event", with_views(f"""
    SELECT id, min(date_event) AS date_first, round(arg_min(a, (date_event, src)), 6) AS age_first
    FROM (SELECT e.*, {age('birth_date', 'date_event')} AS a FROM event_log e JOIN individuals i ON e.id = i.id
          WHERE event IN ('ILL1_A', 'ILL1_B')) GROUP BY id"""))
def age_at_first_event(spark, sf):
    log = X.event_log(spark, sf).filter(F.col("event").isin("ILL1_A", "ILL1_B"))
    x = X.age_of_event(log.join(X.individuals(spark, sf).select("id", "birth_date"), "id"))
    return x.groupBy("id").agg(F.min("date_event").alias("date_first"),
                               r6(F.min_by("age_event", F.struct("date_event", "src")), "age_first"))


_CATS = ["obesity_cat3", "alcohol_cat3", "smoker_cat3", "immigration", "diplome"]
_B = "both_sexes"


def _demo_sql() -> str:
    parts = [f"SELECT sex, 'n' AS var, 'n' AS statistic, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS value2, CAST(NULL AS DOUBLE) AS value3 FROM {_B} GROUP BY sex"]
    for c in ("entry_age", "exposure"):
        parts.append(f"SELECT sex, '{c}', 'Median (IQR)', round(quantile_cont({c}, 0.5), 6), round(quantile_cont({c}, 0.25), 6), round(quantile_cont({c}, 0.75), 6) FROM {_B} GROUP BY sex")
    for c in _CATS:
        parts.append(f"SELECT sex, '{c}', {c}, CAST(count(*) AS DOUBLE), round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY sex) AS DOUBLE), 6), NULL FROM {_B} GROUP BY sex, {c}")
    return " UNION ALL ".join(parts)


@query("demographic_table", with_views(_demo_sql(), both_sexes="""
    SELECT sex, entry_age, exit_age - entry_age AS exposure, obesity_cat3, alcohol_cat3, smoker_cat3, immigration, diplome FROM spells
    UNION ALL SELECT 'B', entry_age, exit_age - entry_age, obesity_cat3, alcohol_cat3, smoker_cat3, immigration, diplome FROM spells"""))
def demographic_table(spark, sf):
    s = X.spells(spark, sf).withColumn("exposure", F.col("exit_age") - F.col("entry_age"))
    out = D.demographic_table(s, numeric=["entry_age", "exposure"], categories=_CATS, widths={"entry_age": 0.25, "exposure": 0.05})
    return out.select("sex", "var", "statistic", r6("value", "value"), r6("value2", "value2"), r6("value3", "value3"))


@query("risk_factor_corr", with_views("""
    SELECT x, y, round(r, 6) AS cor, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM (
      SELECT 'Alcohol' AS x, 'Education' AS y, corr(al, ed) AS r, count(*) AS n FROM z
      UNION ALL SELECT 'Alcohol', 'Immigration', corr(al, im), count(*) FROM z UNION ALL SELECT 'Alcohol', 'Obesity', corr(al, ob), count(*) FROM z
      UNION ALL SELECT 'Alcohol', 'Smoking', corr(al, sm), count(*) FROM z UNION ALL SELECT 'Education', 'Immigration', corr(ed, im), count(*) FROM z
      UNION ALL SELECT 'Education', 'Obesity', corr(ed, ob), count(*) FROM z UNION ALL SELECT 'Education', 'Smoking', corr(ed, sm), count(*) FROM z
      UNION ALL SELECT 'Immigration', 'Obesity', corr(im, ob), count(*) FROM z UNION ALL SELECT 'Immigration', 'Smoking', corr(im, sm), count(*) FROM z
      UNION ALL SELECT 'Obesity', 'Smoking', corr(ob, sm), count(*) FROM z)""",
    z="""SELECT CAST(alcohol_cat3 <> '0' AS INTEGER) AS al, CAST(obesity_cat3 <> '0' AS INTEGER) AS ob, CAST(smoker_cat3 <> '0' AS INTEGER) AS sm,
         CAST(immigration AS INTEGER) AS im, CAST(diplome AS INTEGER) AS ed FROM spells"""))
def risk_factor_corr(spark, sf):
    binary = lambda c: (F.col(c) != "0").cast("int")
    out = D.correlations(X.spells(spark, sf), {
        "Obesity": binary("obesity_cat3"), "Alcohol": binary("alcohol_cat3"), "Smoking": binary("smoker_cat3"),
        "Immigration": F.col("immigration").cast("int"), "Education": F.col("diplome").cast("int")})
    return out.select("x", "y", r6("cor", "cor"), "n", r6("t", "t"))


@query("crosstab", with_views("""
    SELECT obesity_cat3, count(*) FILTER (WHERE smoker_cat3 = '0') AS n_0, count(*) FILTER (WHERE smoker_cat3 = '1') AS n_1,
           count(*) FILTER (WHERE smoker_cat3 = '2') AS n_2 FROM individuals GROUP BY obesity_cat3"""))
def crosstab(spark, sf):
    return D.crosstab(X.individuals(spark, sf), "obesity_cat3", "smoker_cat3", ["0", "1", "2"])


@query("column_profile", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS n, count(*) FILTER (WHERE {c} IS NULL) AS n_null, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS sd,
           CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 6) AS q25,
           round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 6) AS median, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 6) AS q75
    FROM lineitem""" for c in ("l_quantity", "l_discount", "l_extendedprice")))
def column_profile(spark, sf):
    out = D.column_profile(X.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"],
                           {"l_quantity": 5.0, "l_discount": 0.01, "l_extendedprice": 500.0})
    return out.select("column", "n", "n_null", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "min", "max",
                      r6("q25", "q25"), r6("median", "median"), r6("q75", "q75"))


@query("constancy_check", with_views("""
    SELECT a AS attribute, bool_and(c = 1) AS constant FROM (
      SELECT 'sex' AS a, count(DISTINCT i.sex) AS c FROM event_log e JOIN individuals i ON e.id = i.id GROUP BY e.id
      UNION ALL SELECT 'dep', count(DISTINCT i.dep) FROM event_log e JOIN individuals i ON e.id = i.id GROUP BY e.id
      UNION ALL SELECT 'event_censor', count(DISTINCT event_censor) FROM event_log GROUP BY id) GROUP BY a"""))
def constancy_check(spark, sf):
    j = X.event_log(spark, sf).join(X.individuals(spark, sf).select("id", "sex", "dep"), "id")
    return D.constancy_check(j, "id", ["sex", "dep", "event_censor"])


@query("derivation_consistency", with_views(f"""
    SELECT id, count(DISTINCT source) AS n_sources, min(b) = max(b) AS is_const FROM (
      SELECT 'reference' AS source, id, birth_date AS b FROM individuals
      UNION ALL SELECT 'event', e.id, date_event - CAST(round_even(365.25::DOUBLE * {age('birth_date', 'date_event')}, 0) AS INTEGER)
      FROM event_log e JOIN individuals i ON e.id = i.id
      UNION ALL SELECT 'first', id, d - CAST(round_even(365.25::DOUBLE * {age('birth_date', 'd')}, 0) AS INTEGER) FROM (
        SELECT e.id, any_value(birth_date) AS birth_date, min(date_event) AS d FROM event_log e JOIN individuals i ON e.id = i.id
        WHERE event = 'ILL1_A' GROUP BY e.id)) GROUP BY id"""))
def derivation_consistency(spark, sf):
    i = X.individuals(spark, sf)
    j = X.age_of_event(X.event_log(spark, sf).join(i.select("id", "birth_date"), "id"))
    first = j.filter(F.col("event") == "ILL1_A").groupBy("id").agg(F.min(F.struct("date_event", "age_event")).alias("f"))
    back = lambda d, a: F.date_sub(d, F.bround(F.lit(E.YEAR_DAYS) * F.col(a)).cast("int")).alias("birth_date")
    return D.derivation_consistency({
        "reference": i.select("id", "birth_date"),
        "event": j.select("id", back("date_event", "age_event")),
        "first": first.select("id", back(F.col("f.date_event"), "f.age_event")),
    })


_MATRIX = f"""SELECT i.id, coalesce(min(CASE WHEN event = 'ILL1_A' THEN a END), 0) AS a, coalesce(min(CASE WHEN event = 'ILL1_B' THEN a END), 0) AS b,
    coalesce(min(CASE WHEN event = 'DEATH' THEN a END), 0) AS d
    FROM (SELECT e.id, event, {age('birth_date', 'date_event')} AS a FROM event_log e JOIN individuals i ON e.id = i.id) i GROUP BY i.id"""


@query("wide_incidence", with_views("""
    SELECT e AS event, round(avg(CASE WHEN v <> 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN v > 0 THEN v END), 6) AS mean_age FROM (
      SELECT 'ILL1_A' AS e, a AS v FROM matrix UNION ALL SELECT 'ILL1_B', b FROM matrix UNION ALL SELECT 'DEATH', d FROM matrix) GROUP BY e""",
    matrix=_MATRIX))
def wide_incidence(spark, sf):
    codes = ["ILL1_A", "ILL1_B", "DEATH"]
    j = X.age_of_event(X.event_log(spark, sf).join(X.individuals(spark, sf).select("id", "birth_date"), "id"))
    matrix = j.groupBy("id").agg(*[
        F.coalesce(F.min(F.when(F.col("event") == c, F.col("age_event"))), F.lit(0.0)).alias(c) for c in codes])
    return D.wide_incidence(matrix, codes).select("event", r6("rate", "rate"), r6("mean_age", "mean_age"))


@query("histogram", """
    SELECT l_returnflag, CAST(floor(l_extendedprice / 1000) * 1000 AS DOUBLE) AS bin, count(*) AS n FROM lineitem GROUP BY ALL""")
def histogram(spark, sf):
    return D.histogram(X.table(spark, sf, "lineitem"), "l_extendedprice", 1000.0, ["l_returnflag"])


@query("day_of_month", with_views("""
    SELECT strftime(date_event, '%Y-%m') AS month, CAST(day(date_event) AS INTEGER) AS day, count(*) AS n FROM event_log GROUP BY ALL"""))
def day_of_month(spark, sf):
    return D.day_of_month(X.event_log(spark, sf), "date_event")


YEARS_WIDE = [str(y) for y in range(1995, 2002)]


def wide_stats(spark, sf):
    """A published-statistics table: composite key, one text column per year, flags, missing marks."""
    o = X.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    i = X.individuals(spark, sf).select("id", "sex", "dep")
    j = o.join(i, F.col("o_custkey") == F.col("id")).withColumn("indic", F.explode(F.array(F.lit("HLY_50"), F.lit("HLY_65"))))
    n = [F.count_if((F.col("y") == int(y)) & ((F.col("indic") == "HLY_50") | (F.col("o_orderstatus") != "P"))).alias(y) for y in YEARS_WIDE]
    key = F.concat(F.lit("YR,"), F.col("sex"), F.lit(","), F.col("indic"), F.lit(","), F.col("dep"))
    text = lambda y: F.when(F.col("dep").cast("int") % 7 == 0, ": ").otherwise(F.concat(
        F.expr(f"string(`{y}` div 10)"), F.lit("."), (F.col(y) % 10).cast("string"),
        F.when(F.col("dep").cast("int") % 5 == 0, " e").otherwise(" "))).alias(y)
    return j.groupBy("sex", "indic", "dep").agg(*n).select(key.alias("info"), *[text(y) for y in YEARS_WIDE])


_WS = """SELECT 'YR' AS unit, sex, indic AS indic_he, dep AS geo, y AS year,
      CASE WHEN CAST(dep AS INTEGER) % 7 = 0 THEN NULL ELSE round(count(*) FILTER (WHERE yy = y AND (indic = 'HLY_50' OR o_orderstatus <> 'P')) / CAST(10 AS DOUBLE), 6) END AS hly,
      CASE WHEN CAST(dep AS INTEGER) % 7 <> 0 AND CAST(dep AS INTEGER) % 5 = 0 THEN 'e' END AS note
    FROM (SELECT i.sex, i.dep, year(o_orderdate) AS yy, o_orderstatus FROM orders JOIN individuals i ON o_custkey = i.id),
         (VALUES ('HLY_50'), ('HLY_65')) AS v(indic), (SELECT CAST(range AS INTEGER) AS y FROM range(1995, 2002))
    GROUP BY sex, dep, indic, y"""


@query("wide_stats_long", with_views("SELECT unit, sex, indic_he, geo, year, hly, note FROM stats", stats=_WS))
def wide_stats_long(spark, sf):
    out = R.wide_stats_long(wide_stats(spark, sf), "info", ["unit", "sex", "indic_he", "geo"], YEARS_WIDE)
    return out.select("unit", "sex", "indic_he", "geo", "year", r6("hly", "hly"), "note")


def indicator(spark, sf):
    long = R.wide_stats_long(wide_stats(spark, sf), "info", ["unit", "sex", "indic_he", "geo"], YEARS_WIDE)
    age_ = F.regexp_extract("indic_he", "HLY_([0-9]{2})", 1).cast("double").alias("age")
    return long.filter(F.col("unit") == "YR").groupBy("sex", age_).agg(F.avg("hly").alias("hly"))


@query("indicator_mean", with_views("""
    SELECT sex, CAST(regexp_extract(indic_he, 'HLY_([0-9]{2})', 1) AS DOUBLE) AS age, round(avg(hly), 6) AS hly FROM stats GROUP BY ALL""", stats=_WS))
def indicator_mean(spark, sf):
    return indicator(spark, sf).select("sex", "age", r6("hly", "hly"))


@query("indicator_compare", with_views(f"""
    SELECT d.sex, d.age, round(d.v, 6) AS disfle, round(h.hly, 6) AS hly, round(h.hly - d.v, 6) AS diff, round((h.hly - d.v) / h.hly, 6) AS diff_rel
    FROM (SELECT sex, age, expectancy - age AS v FROM ({disfle_sql('km', 'sex', ages='(50.0::DOUBLE), (65.0::DOUBLE)')})) d
    JOIN (SELECT sex, CAST(regexp_extract(indic_he, 'HLY_([0-9]{{2}})', 1) AS DOUBLE) AS age, avg(hly) AS hly FROM stats GROUP BY ALL) h
      ON d.sex = h.sex AND d.age = h.age""", stats=_WS, knots=knots_sql("km", "sex")))
def indicator_compare(spark, sf):
    """Estimated disease-free years at 50 and 65 next to the published indicator."""
    c = C.km(X.spells(spark, sf), ["sex"])
    d = C.disease_free_years(c, [50.0, 65.0], ["sex"]).join(indicator(spark, sf), ["sex", "age"])
    diff = F.col("hly") - F.col("disfle")
    return d.select("sex", "age", r6("disfle", "disfle"), r6("hly", "hly"), r6(diff, "diff"), r6(diff / F.col("hly"), "diff_rel"))


@query("attrition_share", """
    SELECT c_mktsegment AS criteria_en, count(*) AS pop_size, CAST(floor(1000 * count(*) / CAST((SELECT count(*) FROM customer) AS DOUBLE)) AS DOUBLE) / 10 / 100 AS percent,
           round(count(*) / CAST(max(count(*)) OVER () AS DOUBLE), 6) AS share FROM customer GROUP BY c_mktsegment""")
def attrition_share(spark, sf):
    """Attrition table typed as it is printed (blanks, commas, percent signs), then parsed back."""
    n = D.frequency_share(X.table(spark, sf, "customer"), "c_mktsegment")
    blank = F.when(F.col("n") >= 1000, F.concat(F.expr("string(n div 1000)"), F.lit(" "), F.lpad((F.col("n") % 1000).cast("string"), 3, "0"))
                   ).otherwise(F.col("n").cast("string"))
    mill = F.floor(F.col("p") * 1000)
    pct = F.concat(F.floor(mill / 10).cast("string"), F.lit(","), (mill % 10).cast("string"), F.lit("%"))
    printed = n.select(F.col("c_mktsegment").alias("criteria_en"), blank.alias("pop_size"), blank.alias("pop_remain"),
                       pct.alias("percent"), pct.alias("percent_of_total"))
    return R.attrition_share(printed).select("criteria_en", "pop_size", "percent", r6("share", "share"))


_STORED = f"""SELECT e.*, i.birth_date, {age('birth_date', 'date_event')} AS x, CAST(year(date_event) + CASE WHEN src % 50 = 0 THEN 1 ELSE 0 END AS INTEGER) AS year_s,
      CAST(date_diff('day', birth_date, date_event) AS DOUBLE) / 365.25::DOUBLE + CASE WHEN src % 40 = 0 THEN 0.01::DOUBLE ELSE 0 END AS age_s, f.d AS first_s,
      date_diff('day', birth_date, DATE '1995-01-01')::DOUBLE / 365.25::DOUBLE + CASE WHEN e.id % 30 = 0 THEN 0.01::DOUBLE ELSE 0 END AS time1_s,
      {age('birth_date', 'l.d')} + CASE WHEN src % 70 = 0 THEN 0.01::DOUBLE ELSE 0 END AS time2_s, l.d AS last_d
    FROM event_log e JOIN individuals i ON e.id = i.id LEFT JOIN (SELECT id, min(date_event) AS d FROM event_log WHERE event LIKE 'ILL%' GROUP BY id) f ON e.id = f.id
    JOIN (SELECT id, max(date_event) AS d FROM event_log GROUP BY id) l ON l.id = e.id"""


@query("derived_audit", with_views(f"""
    SELECT count(*) AS n, count(*) FILTER (WHERE year(date_event) <> year_s) AS bad_year, count(*) FILTER (WHERE abs(x - age_s) * 365.25 > 1) AS bad_age,
           count(*) FILTER (WHERE g.d <> first_s) AS bad_first, round(avg(CASE WHEN date_event > first_s THEN 1.0 WHEN first_s IS NOT NULL THEN 0.0 END), 6) AS share_after_first,
           count(*) FILTER (WHERE abs({age('birth_date', "DATE '1995-01-01'")} - time1_s) * 365.25 > 1) AS bad_time1,
           count(*) FILTER (WHERE abs({age('birth_date', 'last_d')} - time2_s) * 365.25 > 1) AS bad_time2
    FROM stored s LEFT JOIN (SELECT id, min(date_event) AS d FROM event_log WHERE event IN ('ILL1_A', 'ILL1_B') GROUP BY id) g ON s.id = g.id""", stored=_STORED))
def derived_audit(spark, sf):
    log = X.event_log(spark, sf)
    f = log.groupBy("id").agg(F.min(F.when(F.col("event").startswith("ILL"), F.col("date_event"))).alias("first_s"), F.max("date_event").alias("last_s"))
    j = log.join(X.individuals(spark, sf).select("id", "birth_date"), "id").join(f, "id", "left").withColumns({
        "year_s": F.year("date_event") + F.when(F.col("src") % 50 == 0, 1).otherwise(0),
        "age_s": F.datediff("date_event", "birth_date").cast("double") / F.lit(E.YEAR_DAYS) + F.when(F.col("src") % 40 == 0, 0.01).otherwise(0.0),
        "time1_s": F.datediff(X.date(X.REFERENCE_DATE), "birth_date").cast("double") / F.lit(E.YEAR_DAYS) + F.when(F.col("id") % 30 == 0, 0.01).otherwise(0.0),
        "time2_s": E.age_at("birth_date", "last_s") + F.when(F.col("src") % 70 == 0, 0.01).otherwise(0.0)})
    out = D.derived_audit(j, stored_year="year_s", stored_age="age_s", stored_first="first_s", age=E.age_at("birth_date", "date_event"),
                          is_illness=F.col("event").isin("ILL1_A", "ILL1_B"), stored_time1="time1_s", stored_time2="time2_s", reference=X.REFERENCE_DATE)
    return out.withColumn("share_after_first", r6("share_after_first"))


# ---------------------------------------------------------------- windows, sorting, sets


@query("multi_event_ids", with_views("""
    SELECT id, src, event FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n,
        sum(CAST(event IN ('LOST', 'NO_ILLNESS') AS INTEGER)) OVER (PARTITION BY id) AS k FROM event_log) WHERE n > 1 AND k > 1"""))
def multi_event_ids(spark, sf):
    log = X.event_log(spark, sf)
    per = log.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("event").isin("LOST", "NO_ILLNESS")).alias("k"))
    return V.keep_persons(log, per.filter((F.col("n") > 1) & (F.col("k") > 1))).select("id", "src", "event")


@query("death_cause", """
    SELECT user_id, CASE WHEN event_type = 'error' THEN before END AS cause FROM (
      SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
             row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def death_cause(spark, sf):
    e = X.table(spark, sf, "events")
    return V.death_cause(e, "error", order=["ts", "event_id"], key="user_id", event="event_type")


@query("top_events", with_views("SELECT event, count(*) AS n FROM event_log GROUP BY event ORDER BY n DESC, event LIMIT 4"))
def top_events(spark, sf):
    return D.top_n(X.event_log(spark, sf), "event", 4)


@query("train_test_split", with_views(f"""
    SELECT id, rn <= floor(0.6 * (SELECT count(*) FROM individuals)) AS train FROM (
      SELECT id, row_number() OVER (ORDER BY {uniform('CAST(id AS VARCHAR)', 7)}, id) AS rn FROM individuals)"""))
def train_test_split(spark, sf):
    return V.exact_split(X.individuals(spark, sf), 0.6, seed=7)


@query("sample_ids", with_views(f"SELECT id, src FROM event_log WHERE {uniform('CAST(id AS VARCHAR)', 3)} < 0.25"))
def sample_ids(spark, sf):
    return V.sample_ids(X.event_log(spark, sf), 0.25, seed=3).select("id", "src")


@query("union_sources", with_views("""
    SELECT id, date_event, event, src, 'log' AS origin FROM event_log
    UNION ALL SELECT id, contact_date, 'CONTACT', NULL, 'contact' FROM contacts"""))
def union_sources(spark, sf):
    a = X.event_log(spark, sf).select("id", "date_event", "event", "src", F.lit("log").alias("origin"))
    b = X.contacts(spark, sf).select("id", F.col("contact_date").alias("date_event"), F.lit("CONTACT").alias("event"), F.lit("contact").alias("origin"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_rows", with_views("SELECT DISTINCT event, event_censor, date_event FROM event_log"))
def distinct_rows(spark, sf):
    return X.event_log(spark, sf).select("event", "event_censor", "date_event").distinct()


@query("set_difference", with_views("""
    SELECT event, CAST(date_event AS DATE) AS date_event FROM (SELECT DISTINCT event, date_event FROM event_log WHERE event_censor = 0
      EXCEPT SELECT event, date_event FROM event_log WHERE event_censor <> 0)"""))
def set_difference(spark, sf):
    """Event codes and dates that only occur with certain records."""
    log = X.event_log(spark, sf)
    pick = lambda c: log.filter(c).select("event", "date_event")
    return pick(F.col("event_censor") == 0).subtract(pick(F.col("event_censor") != 0))


@query("replicate_rows", """
    SELECT p_partkey, CAST(k AS INTEGER) AS copy FROM part, LATERAL (SELECT unnest(range(1, p_size % 5 + 1)) AS k)""")
def replicate_rows(spark, sf):
    p = X.table(spark, sf, "part").withColumn("n", F.col("p_size") % 5).filter(F.col("n") > 0)
    return p.select("p_partkey", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))


# ---------------------------------------------------------------- events and persons


@query("individuals", with_views("""
    SELECT i.id, i.sex, i.birth_date, i.obesity_cat3, coalesce(m.alcohol_cat3, i.alcohol_cat3) AS alcohol_cat3,
           coalesce(m.smoker_cat3, i.smoker_cat3) AS smoker_cat3 FROM individuals i LEFT JOIN full_imputed m ON i.id = m.id
    WHERE i.id IN (SELECT id FROM event_log)""", full_imputed="""
    SELECT id, alcohol_cat3, smoker_cat3 FROM imputed UNION ALL SELECT id, alcohol_cat3, smoker_cat3 FROM individuals WHERE id % 10 <> 0"""))
def individuals(spark, sf):
    """Person table from a log that repeats person attributes on each row, with imputed factors."""
    people = X.individuals(spark, sf).withColumn("male", F.when(F.col("sex") == "M", "1").otherwise("0"))
    log = X.event_log(spark, sf).join(people.drop("birth_date", "sex"), "id")
    rest = people.filter(F.col("id") % 10 != 0).select("id", "alcohol_cat3", "smoker_cat3")
    imp = X.imputed(spark, sf).unionByName(rest)
    out = V.normalize_individuals(log, ["obesity_cat3", "alcohol_cat3", "smoker_cat3"], reference_date=X.REFERENCE_DATE, age="age_ref",
                                  imputed=imp, tie=["src"])
    return out.select("id", "sex", "birth_date", "obesity_cat3", "alcohol_cat3", "smoker_cat3")


@query("add_first_contact", with_views("""
    SELECT id, src, date_event, event, event_censor FROM event_log UNION ALL
    SELECT c.id, e.src, c.contact_date, 'NO_ILLNESS', 0 FROM contacts c JOIN (
      SELECT id, src, date_event, row_number() OVER (PARTITION BY id ORDER BY date_event, src) AS rn FROM event_log) e
    ON c.id = e.id AND rn = 1 AND c.contact_date < e.date_event"""))
def add_first_contact(spark, sf):
    return V.add_first_contact(X.event_log(spark, sf), X.contacts(spark, sf), codes=X.CODES, tie=["src"])


@query("censor_events", with_views("""
    SELECT id, src, date_event, event, event_censor FROM event_log WHERE date_event <= DATE '1997-12-31' UNION ALL
    SELECT id, src, DATE '1997-12-31', 'LOST', 2 FROM firsts WHERE mx > DATE '1997-12-31' UNION ALL
    SELECT id, src, DATE '1997-12-31', 'NO_ILLNESS', 0 FROM firsts WHERE mn > DATE '1997-12-31'""",
    firsts="SELECT id, arg_min(src, (date_event, src)) AS src, max(date_event) AS mx, min(date_event) AS mn FROM event_log GROUP BY id"))
def censor_events(spark, sf):
    return V.censor_events(X.event_log(spark, sf), "1997-12-31", codes=X.CODES, tie=["src"])


@query("late_starters", with_views("""
    SELECT id, src FROM event_log WHERE id IN (SELECT id FROM event_log GROUP BY id HAVING year(min(date_event)) < 1996)"""))
def late_starters(spark, sf):
    return V.drop_late_starters(X.event_log(spark, sf), 1996).select("id", "src")


_SHIFT = f"""SELECT i.id, birth_date, greatest(0.0::DOUBLE, 50 - {age('birth_date', 'd')}) AS s FROM individuals i
    JOIN (SELECT id, min(date_event) AS d FROM event_log GROUP BY id) e ON i.id = e.id"""


@query("shift_births", with_views(f"""
    SELECT id, round(s, 6) AS shortfall, birth_date - CAST(ceil(365.25::DOUBLE * (s + CASE WHEN s > 0 THEN (6.0::DOUBLE - s) * (1.0::DOUBLE - sqrt(1.0::DOUBLE - u)) ELSE 0 END)) AS INTEGER) AS birth_date
    FROM (SELECT *, {uniform('CAST(id AS VARCHAR)', 1)} AS u FROM shifts)""", shifts=_SHIFT))
def shift_births(spark, sf):
    out = V.shift_births(X.event_log(spark, sf), X.individuals(spark, sf), seed=1)
    return out.select("id", r6("shortfall", "shortfall"), "birth_date")


@query("quality_terminal", with_views("""
    SELECT 'at_most_one_terminal' AS "check", count(*) FILTER (WHERE k > 1) AS n_bad, count(*) FILTER (WHERE k > 1) = 0 AS cond FROM t
    UNION ALL SELECT 'exactly_one_terminal', count(*) FILTER (WHERE k <> 1), count(*) FILTER (WHERE k <> 1) = 0 FROM t""",
    t="SELECT id, sum(CAST(event IN ('DEATH', 'LOST') AS INTEGER)) AS k FROM event_log GROUP BY id"))
def quality_terminal(spark, sf):
    return Q.quality_terminal(X.event_log(spark, sf), X.CODES)


@query("quality_volume", with_views(f"""
    SELECT n_spells, n_persons, n_excluded, n_persons - n_excluded AS n_expected, n_spells = n_persons - n_excluded AS cond FROM (
      SELECT (SELECT count(*) FROM spells96) AS n_spells, (SELECT count(DISTINCT id) FROM event_log) AS n_persons, (SELECT count(*) FROM (
        SELECT id FROM event_log WHERE event = 'LOST' AND date_event < DATE '1996-01-01' UNION
        SELECT i.id FROM individuals i JOIN (SELECT id, min(date_event) AS d FROM event_log WHERE event <> 'NO_ILLNESS' GROUP BY id) f ON i.id = f.id
        WHERE {age('birth_date', 'd')} < 50)) AS n_excluded)"""))
def quality_volume(spark, sf):
    return Q.quality_volume(X.spells(spark, sf, start="1996-01-01"), X.event_log(spark, sf), X.individuals(spark, sf), start="1996-01-01", codes=X.CODES)


# ---------------------------------------------------------------- populations

YEARS = [1996, 1997, 1998, 1999]
VIEW_POP = {**VIEW_EXIT, "pop_obs": f"""
    SELECT sex, y AS year, CAST(least({whole_age('birth_date', 'jan')}, 99) AS INTEGER) AS age,
           CAST(sum(CASE WHEN jan BETWEEN {anniversary('birth_date', '50')} AND date_event THEN 1 ELSE 0 END) AS BIGINT) AS pop
    FROM (SELECT *, make_date(y, 1, 1) AS jan FROM exits, (SELECT CAST(range AS INTEGER) AS y FROM range(1996, 2000))) GROUP BY ALL""",
    "compared": """SELECT year, age, sex, year - age AS cohort, pop + (age * 37 + year * 11) % 23 AS pop_ref,
           CAST(round_even(1.2::DOUBLE * pop, 0) AS BIGINT) AS pop_obs FROM pop_obs WHERE age >= 50""",
    "cells": """SELECT *, missing_decr - lead(missing_decr, 1, 0) OVER (PARTITION BY cohort, sex ORDER BY year, age) AS exits FROM (
        SELECT *, min(missing) OVER (PARTITION BY cohort, sex ORDER BY year, age ROWS UNBOUNDED PRECEDING) AS missing_decr FROM (
          SELECT *, greatest(pop_ref - pop_obs, 0) AS missing FROM compared))"""}


@query("population_1jan", with_views("SELECT sex, year, age, pop, year - age AS cohort FROM pop_obs", **VIEW_POP))
def population_1jan(spark, sf):
    return P.population_1jan(exits(spark, sf), YEARS)


def pyramid(observed):
    """A reference pyramid a little above the head-count."""
    return observed.filter(F.col("age") >= 50).select(
        "year", "age", "sex", (F.col("pop") + (F.col("age") * 37 + F.col("year") * 11) % 23).alias("pop"))


def compared(spark, sf):
    obs = O.keep(P.population_1jan(exits(spark, sf), YEARS))
    return O.keep(P.compare_population(obs, pyramid(obs), years=YEARS, scale=1.2))


@query("compare_population", with_views(f"""
    SELECT year, age, sex, year - age AS cohort, pop + (age * 37 + year * 11) % 23 AS pop_ref,
           CAST(round_even({P.SOURCE_POPULATION} / CAST((SELECT count(*) FROM individuals) AS DOUBLE) * pop, 0) AS BIGINT) AS pop_obs
    FROM pop_obs WHERE age >= 50""", **VIEW_POP))
def compare_population(spark, sf):
    """Observed counts brought to the size of the source population."""
    obs = O.keep(P.population_1jan(exits(spark, sf), YEARS))
    return P.compare_population(obs, pyramid(obs), years=YEARS, scale=P.population_scale(X.individuals(spark, sf)))


@query("coverage_ratio", with_views("""
    SELECT age, sex, round(sum(pop_obs) / CAST(sum(pop_ref) AS DOUBLE), 6) AS coverage,
           round((sum(pop_ref) - sum(pop_obs)) / CAST(sum(pop_ref) AS DOUBLE), 6) AS missing_share FROM compared GROUP BY age, sex HAVING sum(pop_ref) > 0""", **VIEW_POP))
def coverage_ratio(spark, sf):
    c = P.coverage_by_age(compared(spark, sf))
    return c.filter(F.col("pop_ref") > 0).select("age", "sex", r6("coverage", "coverage"), r6("missing_share", "missing_share"))


@query("sex_ratio", with_views("""
    SELECT year, age, cohort, round(f, 6) AS "F", round(m, 6) AS "M", round(f / m, 6) AS r FROM (
      SELECT year, age, cohort, max(CASE WHEN sex = 'F' THEN pop_ref / CAST(pop_obs AS DOUBLE) END) AS f, max(CASE WHEN sex = 'M' THEN pop_ref / CAST(pop_obs AS DOUBLE) END) AS m
      FROM compared WHERE age <= 95 AND pop_obs > 0 GROUP BY ALL)""", **VIEW_POP))
def sex_ratio(spark, sf):
    r = P.sex_ratio_by_cohort(compared(spark, sf))
    return r.select("year", "age", "cohort", r6("F", "F"), r6("M", "M"), r6("r", "r"))


@query("exposure_topup", with_views("""
    SELECT year, age, sex, cohort, missing, missing_decr, exits FROM cells""", **VIEW_POP))
def exposure_topup(spark, sf):
    return P.exposure_topup(compared(spark, sf)).select("year", "age", "sex", "cohort", "missing", "missing_decr", "exits")


_TOPUP = f"""SELECT CAST(1000000 + before + pos - 1 AS BIGINT) AS id, sex, greatest(least(make_date(cohort - 1, 1, 1) + CAST(round_even(365.25::DOUBLE * u, 0) AS INTEGER),
        make_date(cohort - 1, 12, 31)), make_date(cohort - 1, 1, 2)) AS birth_date, make_date(year, 12, 31) AS date_event, 'LOST' AS event
    FROM (SELECT *, {uniform('CAST(cohort AS VARCHAR), sex, CAST(year AS VARCHAR), CAST(pos AS VARCHAR)', 1)} AS u FROM (
      SELECT *, unnest(range(1, exits + 1)) AS pos FROM (
        SELECT *, coalesce(sum(exits) OVER (ORDER BY cohort, sex, year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM cells WHERE exits > 0)))"""


def topup(spark, sf):
    return P.topup_rows(P.exposure_topup(compared(spark, sf)), id_start=1000000, codes=X.CODES, seed=1)


@query("topup_rows", with_views("SELECT id, sex, birth_date, date_event, event FROM topup", topup=_TOPUP, **VIEW_POP))
def topup_rows(spark, sf):
    return topup(spark, sf)


@query("with_topup", with_views("""
    SELECT id, birth_date, sex, true AS observed FROM individuals UNION ALL SELECT id, birth_date, sex, false FROM topup""", topup=_TOPUP, **VIEW_POP))
def with_topup(spark, sf):
    return P.with_topup(X.individuals(spark, sf), topup(spark, sf), ["id", "birth_date", "sex"])


@query("adjusted_vs_pyramid", with_views(f"""
    WITH a AS (SELECT sex, y AS year, CAST(least({whole_age('b', 'jan')}, 99) AS INTEGER) AS age,
           CAST(sum(CASE WHEN jan BETWEEN {anniversary('b', '50')} AND date_event THEN 1 ELSE 0 END) AS BIGINT) AS pop
      FROM (SELECT *, make_date(y, 1, 1) AS jan FROM (SELECT sex, date_event, CASE WHEN strftime(birth_date, '%d-%m') = '29-02' THEN birth_date + 1 ELSE birth_date END AS b FROM (
          SELECT sex, birth_date, date_event FROM exits UNION ALL SELECT sex, birth_date, date_event FROM topup)), (SELECT CAST(range AS INTEGER) AS y FROM range(1996, 2000))) GROUP BY ALL),
    w AS (SELECT coalesce(a.year, c.year) AS year, coalesce(a.age, c.age) AS age, coalesce(a.sex, c.sex) AS sex, coalesce(a.year - a.age, c.cohort) AS cohort, a.pop, c.pop_ref, c.pop_obs
      FROM a FULL JOIN compared c ON a.year = c.year AND a.age = c.age AND a.sex = c.sex)
    SELECT year, age, sex, cohort, 'INSEE' AS method, pop_ref AS pop FROM w UNION ALL SELECT year, age, sex, cohort, 'Without adj.', pop_obs FROM w
    UNION ALL SELECT year, age, sex, cohort, 'With adj.', pop FROM w""", topup=_TOPUP, **VIEW_POP))
def adjusted_vs_pyramid(spark, sf):
    c = compared(spark, sf)
    extra = P.topup_rows(P.exposure_topup(c), id_start=1000000, codes=X.CODES, seed=1)
    people = exits(spark, sf).select("sex", "birth_date", "date_event").unionByName(extra.select("sex", "birth_date", "date_event"))
    return P.adjusted_vs_pyramid(people, c, YEARS)


_WT = f"""SELECT sex, CAST({age('birth_date', 'e')} AS DOUBLE) AS entry_age, {age('birth_date', 'date_event')} + CAST(1 AS DOUBLE) / 730.5::DOUBLE AS exit_age, false AS event_flag, 1 AS w FROM (
      SELECT *, greatest(DATE '1995-01-01', {anniversary('birth_date', '50')}) AS e FROM topup) WHERE e <= date_event
    UNION ALL SELECT sex, entry_age, exit_age, event_flag, 1 FROM spells"""


def weighted_curve(spark, sf):
    cells = P.exposure_topup(compared(spark, sf))
    extra = P.topup_spells(cells, start=X.START)
    own = X.spells(spark, sf).select("sex", "entry_age", "exit_age", "event_flag", F.lit(1).cast("bigint").alias("weight"))
    return C.km(own.unionByName(extra), ["sex"], weight="weight")


@query("km_weighted", with_views("""
    SELECT sex, t AS time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, CAST(x - d AS BIGINT) AS n_censor,
           round(CASE WHEN bool_or(d = n) OVER w THEN 0.0 ELSE exp(sum(CASE WHEN d < n THEN ln(1.0::DOUBLE - d / CAST(n AS DOUBLE)) ELSE 0 END) OVER w) END, 6) AS surv
    FROM (SELECT *, sum(e) OVER v - sum(x) OVER v AS n FROM (
      SELECT sex, t, sum(e) AS e, sum(x) AS x, sum(d) AS d FROM (
        SELECT sex, round(entry_age, 9) AS t, w AS e, 0 AS x, 0 AS d FROM weighted WHERE entry_age < exit_age
        UNION ALL SELECT sex, round(exit_age, 9), 0, w, CASE WHEN event_flag THEN w ELSE 0 END FROM weighted WHERE entry_age < exit_age) GROUP BY sex, t)
      WINDOW v AS (PARTITION BY sex ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE x > 0
    WINDOW w AS (PARTITION BY sex ORDER BY t ROWS UNBOUNDED PRECEDING)""", weighted=_WT, topup=_TOPUP, **VIEW_POP))
def km_weighted(spark, sf):
    """Curve by sex with the missing population as weighted rows."""
    return weighted_curve(spark, sf).select("sex", "time", "n_risk", "n_event", "n_censor", r6("surv", "surv"))


_WKM = """
    SELECT sex, t, CASE WHEN bool_or(d = n) OVER w THEN 0.0 ELSE exp(sum(CASE WHEN d < n THEN ln(1.0::DOUBLE - d / CAST(n AS DOUBLE)) ELSE 0 END) OVER w) END AS surv
    FROM (SELECT *, sum(e) OVER v - sum(x) OVER v AS n FROM (
      SELECT sex, t, sum(e) AS e, sum(x) AS x, sum(d) AS d FROM (
        SELECT sex, round(entry_age, 9) AS t, w AS e, 0 AS x, 0 AS d FROM weighted WHERE entry_age < exit_age
        UNION ALL SELECT sex, round(exit_age, 9), 0, w, CASE WHEN event_flag THEN w ELSE 0 END FROM weighted WHERE entry_age < exit_age) GROUP BY sex, t)
      WINDOW v AS (PARTITION BY sex ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE x > 0
    WINDOW w AS (PARTITION BY sex ORDER BY t ROWS UNBOUNDED PRECEDING)"""


@query("disfle_adjusted", with_views(
    f"SELECT sex, age, round(expectancy - age, 6) AS disfle FROM ({disfle_sql('wkm', 'sex')})",
    weighted=_WT, topup=_TOPUP, wkm=_WKM, knots=knots_sql("wkm", "sex"), **VIEW_POP))
def disfle_adjusted(spark, sf):
    """Expected disease-free years by sex and age on the population adjusted to the pyramid."""
    return C.disease_free_years(weighted_curve(spark, sf), AGES, ["sex"]).select("sex", "age", r6("disfle", "disfle"))


# ---------------------------------------------------------------- all dataset variants

_CENSORED = """SELECT id, src, date_event, event FROM {log} WHERE date_event <= DATE '1997-12-31' UNION ALL
    SELECT id, NULL, DATE '1997-12-31', 'LOST' FROM {log} GROUP BY id HAVING max(date_event) > DATE '1997-12-31' UNION ALL
    SELECT id, NULL, DATE '1997-12-31', 'NO_ILLNESS' FROM {log} GROUP BY id HAVING min(date_event) > DATE '1997-12-31'"""
VIEW_GRID = {
    **VIEW_POP, "topup": _TOPUP,
    "early_log": "SELECT * FROM event_log WHERE id IN (SELECT id FROM event_log GROUP BY id HAVING year(min(date_event)) < 1998)",
    "topup_log": "SELECT id, CAST(NULL AS BIGINT) AS src, date_event, event FROM topup",
    "log_plain": "SELECT id, src, date_event, event FROM event_log",
    "log_imput": _CENSORED.format(log="early_log"),
    "log_adj": "SELECT * FROM log_plain UNION ALL SELECT * FROM topup_log",
    "log_adj_imput": f"SELECT * FROM log_imput UNION ALL {_CENSORED.format(log='topup_log')}",
    "people_plain": "SELECT id, birth_date FROM individuals",
    "people_adj": "SELECT id, birth_date FROM individuals UNION ALL SELECT id, birth_date FROM topup",
}


def _variant_sql(kind: str, name: str, log: str, people: str) -> str:
    if kind == "health":
        rows = f"""SELECT id, src, date_event, event AS code, CASE WHEN event IN ('ILL1_A', 'ILL1_B', 'DEATH') THEN 'ILL' ELSE event END AS event FROM {log} WHERE event <> 'NO_ILLNESS'"""
        first = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date_event, CASE WHEN event = 'ILL' THEN 0 ELSE 1 END, src NULLS FIRST, code) AS rn FROM ({rows})) WHERE rn = 1"
        hit = "ILL"
    else:
        first, hit = f"SELECT id, date_event, event FROM {log} WHERE event IN ('DEATH', 'LOST')", "DEATH"
    return f"""SELECT '{name}' AS dataset, count(*) AS n, CAST(sum(CAST(flag AS INTEGER)) AS BIGINT) AS n_event, round(sum(b - a), 4) AS exposure FROM (
      SELECT {age('birth_date', 'entry')} AS a, {age('birth_date', 'leave')} + CAST(1 AS DOUBLE) / 730.5::DOUBLE AS b, flag FROM (
        SELECT birth_date, greatest(DATE '1995-01-01', {anniversary('birth_date', '50')}) AS entry, least(d, DATE '1998-01-01') AS leave,
               ev = '{hit}' AND d < DATE '1998-01-01' AS flag
        FROM {people} p JOIN (
          SELECT id, min(date_event) AS d, arg_min(event, (date_event, CASE WHEN event = '{hit}' THEN 0 WHEN event = 'DEATH' THEN 1 ELSE 2 END)) AS ev
          FROM ({first}) WHERE event IN ('{hit}', 'DEATH', 'LOST') GROUP BY id
          HAVING NOT bool_or(date_event < DATE '1995-01-01' AND event IN ('DEATH', 'LOST'))) f ON p.id = f.id)) WHERE b >= 50"""


def _grid_sql() -> str:
    parts = []
    for kind in ("health", "life"):
        for ind in ("", "_indiimp"):
            for ev in ("", "_eveimp"):
                for adj in ("", "_with_adj"):
                    if ind and adj:
                        continue
                    log = "log" + ("_adj" if adj else "") + ("_imput" if ev else ("" if adj else "_plain"))
                    parts.append(_variant_sql(kind, kind + ev + ind + adj, log, "people_adj" if adj else "people_plain"))
    return " UNION ALL ".join(parts)


@query("dataset_grid", with_views(_grid_sql(), **VIEW_GRID))
def dataset_grid(spark, sf):
    """Size, events and exposure of every life and health dataset: imputed persons, imputed events, top-up."""
    people, log = O.keep(X.individuals(spark, sf)), O.keep(X.event_log(spark, sf))
    factors = X.imputed(spark, sf).withColumnsRenamed({"alcohol_cat3": "a", "smoker_cat3": "s"})
    imput = people.join(factors, "id", "left").withColumns({
        "alcohol_cat3": F.coalesce("a", "alcohol_cat3"), "smoker_cat3": F.coalesce("s", "smoker_cat3")}).drop("a", "s")
    extra = O.keep(topup(spark, sf))
    extra_log = extra.select("id", "date_event", "event", F.lit(None).cast("bigint").alias("src"), F.lit(2).alias("event_censor"))
    cut = lambda df: V.censor_events(df, "1997-12-31", codes=X.CODES, tie=["src"])
    log_imput = O.keep(cut(V.drop_late_starters(log, 1998)))
    basic = ["id", "sex", "birth_date"]
    everyone = P.with_topup(people, extra, basic)
    people_of = {"": people, "_imput": imput, "_with_adj": everyone}
    logs = {"": log, "_imput": log_imput, "_with_adj": log.unionByName(extra_log), "_with_adj_imput": log_imput.unionByName(cut(extra_log))}
    out = None
    for kind in ("health", "life"):
        grid = S.dataset_grid(people_of, logs, kind=kind, codes=X.CODES, start=X.START, end=X.END, **({"tie": ["src"]} if kind == "health" else {}))
        for name, df in grid.items():
            part = df.select(F.lit(name).alias("dataset"), "event_flag", (F.col("exit_age") - F.col("entry_age")).alias("x"))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("event_flag").alias("n_event"), F.round(F.sum("x"), 4).alias("exposure"))

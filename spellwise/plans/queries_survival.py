"""Queries on spells, curves and expectancies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spellwise.operators import curves as C
from spellwise.operators import spells as S
from spellwise.operators.events import drop_persons, keep_persons
from spellwise.plans import fixtures as X
from spellwise.plans.oracle_views import HALF_DAY, age, anniversary, with_views
from spellwise.plans.registry import query
from spellwise.session import shared_folder
from spellwise.sources.readers import write_table

AGES = [50.0, 52.5, 55.0, 60.0, 65.0, 70.0, 75.0, 80.0, 85.0, 90.0, 95.0]
_AGE_VALUES = ", ".join(f"(CAST({a} AS DOUBLE))" for a in AGES)


def r6(c, name=None):
    """Six digits, and no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name) if name else out


def disfle_sql(curve: str, strata: str, surv: str = "surv", ages: str = _AGE_VALUES, max_age: float = 100.0) -> str:
    """Expected end time over a closed curve: knots, reverse sums, interpolation."""
    return f"""
    SELECT w.{strata}, x AS age,
      CASE WHEN x < tmin THEN total
           ELSE CASE WHEN x = b.t THEN b.e ELSE b.e + (b.e2 - b.e) * (x - b.t) / (b.t2 - b.t) END END AS expectancy
    FROM (SELECT g.*, v.x FROM (
            SELECT {strata}, min(t) AS tmin, sum(t * (prev - s)) AS total FROM (
              SELECT *, coalesce(lag(s) OVER (PARTITION BY {strata} ORDER BY t), 1) AS prev FROM knots) GROUP BY {strata}) g,
          (VALUES {ages}) AS v(x)) w
    LEFT JOIN (
      SELECT *, lead(e) OVER (PARTITION BY {strata} ORDER BY t) AS e2 FROM (
        SELECT *, CASE WHEN s > 0 THEN coalesce(sum(a) OVER (PARTITION BY {strata} ORDER BY t
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) / s END AS e
        FROM (SELECT *, t2 * (s - s2) AS a FROM (
          SELECT *, lead(t) OVER (PARTITION BY {strata} ORDER BY t) AS t2,
                    lead(s) OVER (PARTITION BY {strata} ORDER BY t) AS s2 FROM knots)))
    ) b ON b.{strata} = w.{strata} AND x >= b.t AND (x < b.t2 OR (b.t2 IS NULL AND x = b.t))"""


def knots_sql(curve: str, strata: str, surv: str = "surv", max_age: float = 100.0, time: str = "t") -> str:
    return f"""
    SELECT {strata}, {time} AS t, {surv} AS s FROM {curve} WHERE {time} < {max_age} AND {surv} IS NOT NULL
    UNION ALL SELECT DISTINCT {strata}, CAST({max_age} AS DOUBLE), CAST(0 AS DOUBLE) FROM {curve}"""


@query("first_illness", with_views("SELECT id, src, date_event, event FROM first_ill"))
def first_illness(spark, sf):
    out = S.first_illness(X.event_log(spark, sf), codes=X.CODES, tie=["src"])
    return out.select("id", "src", "date_event", "event")


@query("first_event", with_views("""
    SELECT id, src, date_event, event FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY date_event, event, src) AS rn FROM event_log) WHERE rn = 1"""))
def first_event(spark, sf):
    from spellwise.operators.ordered import first_per

    return first_per(X.event_log(spark, sf), ["id"], ["date_event", "event", "src"]).select(
        "id", "src", "date_event", "event")


@query("build_spells", with_views("""
    SELECT id, sex, entry_date, exit_date, round(entry_age, 6) AS entry_age, round(exit_age, 6) AS exit_age, event_flag
    FROM spells96"""))
def build_spells(spark, sf):
    """The window starts a year late here, so exits before it have to be removed."""
    s = X.spells(spark, sf, start="1996-01-01")
    return s.select("id", "sex", "entry_date", "exit_date", r6("entry_age", "entry_age"),
                    r6("exit_age", "exit_age"), "event_flag")


def by_person(spark, sf, buckets: int = 8):
    """Persons and log as tables bucketed by person, in the shared folder: what follows needs no further exchange on the id.

    At size, as many buckets as give files of some hundred megabytes; the number is the tables', whatever reads them.
    """
    run = uuid.uuid4().hex
    out = []
    for name, df in (("people", X.individuals(spark, sf)), ("log", X.event_log(spark, sf))):
        table = f"spellwise_{name}_{run}"
        write_table(df, f"{shared_folder(spark)}/layout/{table}", bucket_by=(buckets, "id"), table=table)
        out.append(spark.table(table))
    return out


def spells_of(people, log):
    ill = S.first_illness(log, codes=X.CODES, tie=["src"])
    out = S.build_spells(people, ill, targets=[X.CODES.illness], codes=X.CODES, min_age=50, start="1996-01-01", end=X.END, half_day=True)
    return out.filter((F.col("entry_date") <= F.col("exit_date")) & (F.col("exit_age") >= 50))


@query("build_spells_bucketed", with_views("""
    SELECT id, sex, entry_date, exit_date, round(entry_age, 6) AS entry_age, round(exit_age, 6) AS exit_age, event_flag
    FROM spells96 WHERE id IN (SELECT id FROM event_log WHERE event LIKE 'ILL%') AND id NOT IN (SELECT id FROM event_log WHERE event = 'ILL0_C')"""))
def build_spells_bucketed(spark, sf):
    """Spells of the persons with an illness in the log but none of the mild kind: first row, semi and anti join and the join of
    persons with their log share one layout."""
    people, log = by_person(spark, sf)
    people = keep_persons(people, log.filter(F.col("event").startswith("ILL")))
    s = spells_of(drop_persons(people, log.filter(F.col("event") == "ILL0_C")), log)
    return s.select("id", "sex", "entry_date", "exit_date", r6("entry_age", "entry_age"), r6("exit_age", "exit_age"), "event_flag")


_CR = f"""
    SELECT *, {age('birth_date', 'entry_date')} AS entry_age, {age('birth_date', 'exit_date')} + {HALF_DAY} AS exit_age
    FROM (SELECT i.*, greatest(DATE '1996-01-01', {anniversary('birth_date', '50')}) AS entry_date,
                 least(date_event, DATE '1998-01-01') AS exit_date,
                 CASE WHEN date_event < DATE '1998-01-01' THEN event ELSE 'LOST' END AS cause
          FROM individuals i JOIN (
            SELECT id, date_event, event FROM (
              SELECT *, row_number() OVER (PARTITION BY id ORDER BY date_event,
                  CASE event WHEN 'ILL1_A' THEN 0 WHEN 'ILL1_B' THEN 1 WHEN 'DEATH' THEN 2 ELSE 3 END, src) AS rn
              FROM event_log WHERE event IN ('ILL1_A', 'ILL1_B', 'DEATH', 'LOST')
                AND id NOT IN (SELECT id FROM event_log WHERE date_event < DATE '1996-01-01' AND event IN ('DEATH', 'LOST'))
            ) WHERE rn = 1) f ON i.id = f.id)"""
VIEW_CR = {"spells_cr": _CR}


def spells_cr(spark, sf):
    return S.build_spells_cr(
        X.individuals(spark, sf), X.event_log(spark, sf), targets=["ILL1_A", "ILL1_B"], codes=X.CODES,
        start="1996-01-01", end="1998-01-01", half_day=True,
    )


@query("build_spells_cr", with_views("""
    SELECT id, cause, entry_date, exit_date, round(entry_age, 6) AS entry_age, round(exit_age, 6) AS exit_age
    FROM spells_cr""", **VIEW_CR))
def build_spells_cr(spark, sf):
    return spells_cr(spark, sf).select("id", "cause", "entry_date", "exit_date", r6("entry_age", "entry_age"),
                                       r6("exit_age", "exit_age"))


@query("competing_policy", with_views("""
    SELECT policy, count(*) AS n, CAST(sum(CAST(flag AS INTEGER)) AS BIGINT) AS n_event,
           round(sum(exit_age - entry_age), 6) AS exposure FROM (
      SELECT 'exclude' AS policy, cause = 'ILL1_A' AS flag, entry_age, exit_age FROM spells_cr WHERE cause IN ('ILL1_A', 'LOST')
      UNION ALL SELECT 'censor', cause = 'ILL1_A', entry_age, exit_age FROM spells_cr
      UNION ALL SELECT 'event', cause IN ('ILL1_A', 'DEATH'), entry_age, exit_age FROM spells_cr
      UNION ALL SELECT 'compete', cause <> 'LOST', entry_age, exit_age FROM spells_cr) GROUP BY policy""", **VIEW_CR))
def competing_policy(spark, sf):
    out = S.recode_policies(spells_cr(spark, sf), ("exclude", "censor", "event", "compete"), target="ILL1_A", codes=X.CODES)
    return out.groupBy("policy").agg(
        F.count("*").alias("n"), F.count_if("event_flag").alias("n_event"),
        r6(F.sum(F.col("exit_age") - F.col("entry_age")), "exposure"))


@query("multi_state_spells", with_views(f"""
    SELECT id, src, event, t1, t2, round({age('birth_date', 't1')}, 6) AS t1_age,
           round({age('birth_date', 't2')}, 6) AS t2_age
    FROM (SELECT e.*, i.birth_date,
            coalesce(lag(date_event) OVER (PARTITION BY e.id ORDER BY date_event, src, event), DATE '1995-01-01') AS t1,
            CASE WHEN date_event = max(date_event) OVER (PARTITION BY e.id) AND event NOT IN ('DEATH', 'LOST')
                 THEN DATE '1998-01-01' ELSE date_event END AS t2
          FROM event_log e JOIN individuals i ON e.id = i.id)"""))
def multi_state_spells(spark, sf):
    out = S.multi_state_spells(X.event_log(spark, sf), X.individuals(spark, sf), codes=X.CODES,
                               start="1995-01-01", end="1998-01-01", tie=["src"])
    return out.select("id", "src", "event", "t1", "t2", r6("t1_age", "t1_age"), r6("t2_age", "t2_age"))


CUTS = [float(a) for a in range(52, 104, 2)]
_CUT_VALUES = ", ".join(f"(CAST({c} AS DOUBLE))" for c in CUTS)
VIEW_SPLIT = {"split": f"""
    SELECT id, sex, obesity_cat3, alcohol_cat3, smoker_cat3, dep, immigration, diplome, lo AS entry_age, hi AS exit_age,
           event_flag AND hi = exit_age AS event_flag,
           CAST((SELECT count(*) FROM (VALUES {_CUT_VALUES}) AS q(c) WHERE c <= lo) + 1 AS INTEGER) AS tgroup
    FROM (SELECT s.*, b AS lo, lead(b) OVER (PARTITION BY id ORDER BY b) AS hi
          FROM (SELECT s.*, unnest(list_concat([entry_age], list_filter([{', '.join(f'CAST({c} AS DOUBLE)' for c in CUTS)}],
                   lambda c: c > entry_age AND c < exit_age), [exit_age])) AS b FROM spells s) s)
    WHERE hi IS NOT NULL"""}


@query("interval_split", with_views("""
    SELECT id, tgroup, round(entry_age, 6) AS entry_age, round(exit_age, 6) AS exit_age, event_flag FROM split""",
    **VIEW_SPLIT))
def interval_split(spark, sf):
    out = S.interval_split(X.spells(spark, sf), CUTS)
    return out.select("id", "tgroup", r6("entry_age", "entry_age"), r6("exit_age", "exit_age"), "event_flag")


@query("time_varying_merge", with_views(f"""
    SELECT id, round(lo, 6) AS entry_age, round(hi, 6) AS exit_age, flag AS had_other, ev AS event_flag FROM (
      WITH s AS (SELECT sp.*, (SELECT min({age('sp.birth_date', 'e.date_event')}) FROM event_log e
                 WHERE e.id = sp.id AND e.event = 'ILL0_C') AS tc FROM spells sp)
      SELECT id, entry_age AS lo, exit_age AS hi, 0 AS flag, event_flag AS ev FROM s WHERE tc IS NULL OR tc >= exit_age
      UNION ALL SELECT id, entry_age, exit_age, 1, event_flag FROM s WHERE tc <= entry_age
      UNION ALL SELECT id, entry_age, tc, 0, false FROM s WHERE tc > entry_age AND tc < exit_age
      UNION ALL SELECT id, tc, exit_age, 1, event_flag FROM s WHERE tc > entry_age AND tc < exit_age)"""))
def time_varying_merge(spark, sf):
    sp = X.spells(spark, sf)
    changes = X.event_log(spark, sf).filter(F.col("event") == "ILL0_C").join(
        X.individuals(spark, sf).select("id", "birth_date"), "id")
    out = S.time_varying_merge(sp, X.age_of_event(changes), "had_other")
    return out.select("id", r6("entry_age", "entry_age"), r6("exit_age", "exit_age"), "had_other", "event_flag")


@query("km_curve", with_views("""
    SELECT sex, t AS time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event,
           CAST(ext - d AS BIGINT) AS n_censor, round(surv, 6) AS surv FROM km"""))
def km_curve(spark, sf):
    c = C.km(X.spells(spark, sf), ["sex"])
    return c.select("sex", "time", "n_risk", "n_event", "n_censor", r6("surv", "surv"))


_DUR_TIMES = """
    SELECT stratum, t, sum(e) AS ent, sum(x) AS ext, sum(d) AS d, sum(dr) AS dr, sum(da) AS da FROM (
      SELECT stratum, entry AS t, 1 AS e, 0 AS x, 0 AS d, 0 AS dr, 0 AS da FROM durations
      UNION ALL SELECT stratum, exit, 0, 1, CAST(event AS INTEGER), CAST(cause = 'R' AS INTEGER), CAST(cause = 'A' AS INTEGER)
      FROM durations) GROUP BY stratum, t"""
VIEW_DUR = {
    "dur_times": _DUR_TIMES,
    "dur_risk": """SELECT * FROM (SELECT *, sum(ent) OVER v - sum(ext) OVER v AS n FROM dur_times
        WINDOW v AS (PARTITION BY stratum ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE ext > 0""",
    "dur_km": """SELECT *, CASE WHEN out THEN 0.0 ELSE exp(ls) END AS surv,
          CASE WHEN out THEN NULL ELSE sqrt(gw) END AS se FROM (
        SELECT *, bool_or(d = n) OVER w AS out,
               sum(CASE WHEN d < n THEN ln(CAST(1 AS DOUBLE) - CAST(d AS DOUBLE) / n) ELSE 0 END) OVER w AS ls,
               sum(CAST(d AS DOUBLE) / n) OVER w AS cumhaz,
               sum(CASE WHEN d < n THEN CAST(d AS DOUBLE) / (CAST(n AS DOUBLE) * (n - d)) ELSE 0 END) OVER w AS gw
        FROM dur_risk WINDOW w AS (PARTITION BY stratum ORDER BY t ROWS UNBOUNDED PRECEDING))""",
}
DUR = dict(entry="entry", exit="exit", cell_width=30.0)


@query("km_ci", with_views("""
    SELECT stratum, CAST(t AS DOUBLE) AS time, CAST(n AS BIGINT) AS n_risk, round(surv, 6) AS surv, round(se, 6) AS std_err,
           round(CASE WHEN out THEN NULL ELSE exp(ls - 1.959963984540054::DOUBLE * se) END, 6) AS lower,
           round(CASE WHEN out THEN NULL ELSE least(1.0, exp(ls + 1.959963984540054::DOUBLE * se)) END, 6) AS upper
    FROM dur_km""", **VIEW_DUR))
def km_ci(spark, sf):
    c = C.km(X.durations(spark, sf), ["stratum"], event="event", **DUR)
    return c.select("stratum", "time", "n_risk", r6("surv", "surv"), r6("std_err", "std_err"), r6("lower", "lower"),
                    r6("upper", "upper"))


@query("nelson_aalen", with_views("""
    SELECT stratum, CAST(t AS DOUBLE) AS time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event,
           round(cumhaz, 6) AS cumhaz FROM dur_km""", **VIEW_DUR))
def nelson_aalen(spark, sf):
    c = C.nelson_aalen(X.durations(spark, sf), ["stratum"], event="event", **DUR)
    return c.select("stratum", "time", "n_risk", "n_event", r6("cumhaz", "cumhaz"))


_AJ = """
    SELECT *, sum(before * dr / n) OVER w AS pr, sum(before * da / n) OVER w AS pa,
           sum(CAST(dr AS DOUBLE) / n) OVER w AS hr, sum(CAST(da AS DOUBLE) / n) OVER w AS ha FROM (
      SELECT *, coalesce(lag(surv2) OVER (PARTITION BY stratum ORDER BY t), 1) AS before FROM (
        SELECT *, CASE WHEN bool_or(dr + da = n) OVER u THEN 0.0 ELSE
            exp(sum(CASE WHEN dr + da < n THEN ln(CAST(1 AS DOUBLE) - CAST(dr + da AS DOUBLE) / n) ELSE 0 END) OVER u) END AS surv2
        FROM dur_risk WINDOW u AS (PARTITION BY stratum ORDER BY t ROWS UNBOUNDED PRECEDING)))
    WINDOW w AS (PARTITION BY stratum ORDER BY t ROWS UNBOUNDED PRECEDING)"""


@query("cumulative_incidence", with_views("""
    SELECT stratum, CAST(t AS DOUBLE) AS time, 'healthy' AS state, CAST(0 AS BIGINT) AS n_event, round(surv2, 6) AS pstate FROM aj
    UNION ALL SELECT stratum, CAST(t AS DOUBLE), 'R', CAST(dr AS BIGINT), round(pr, 6) FROM aj
    UNION ALL SELECT stratum, CAST(t AS DOUBLE), 'A', CAST(da AS BIGINT), round(pa, 6) FROM aj""", aj=_AJ, **VIEW_DUR))
def cumulative_incidence(spark, sf):
    c = C.competing_curves(X.durations(spark, sf), ["stratum"], causes=["R", "A"], **DUR)
    return c.select("stratum", "time", "state", "n_event", r6("pstate", "pstate"))


@query("transition_hazard", with_views("""
    SELECT stratum, CAST(t AS DOUBLE) AS time, 'healthy' AS "from", 'R' AS "to", round(hr, 6) AS cumhaz,
           round(1 - exp(-hr), 6) AS naive_incidence FROM aj
    UNION ALL SELECT stratum, CAST(t AS DOUBLE), 'healthy', 'A', round(ha, 6), round(1 - exp(-ha), 6) FROM aj""",
    aj=_AJ, **VIEW_DUR))
def transition_hazard(spark, sf):
    c = C.transition_hazards(X.durations(spark, sf), ["stratum"], causes=["R", "A"], **DUR)
    return c.select("stratum", "time", "from", "to", r6("cumhaz", "cumhaz"), r6("naive_incidence", "naive_incidence"))


@query("disfle_curve", with_views(f"""
    SELECT sex, age, round(expectancy - age, 6) AS disfle FROM ({disfle_sql('km', 'sex')})""",
    knots=knots_sql("km", "sex")))
def disfle_curve(spark, sf):
    """Expected disease-free years by sex at a grid of ages (curve closed at 100)."""
    c = C.km(X.spells(spark, sf), ["sex"])
    return C.disease_free_years(c, AGES, ["sex"]).select("sex", "age", r6("disfle", "disfle"))


_LIMITS = """
    SELECT sex, t, surv, CASE WHEN dead_out THEN NULL ELSE exp(ls - 1.959963984540054::DOUBLE * sqrt(coalesce(gw, 0))) END AS lower,
           CASE WHEN dead_out THEN NULL ELSE least(1.0, exp(ls + 1.959963984540054::DOUBLE * sqrt(coalesce(gw, 0)))) END AS upper FROM km"""


def _limit_part(name: str) -> str:
    return f"SELECT sex, age, round(expectancy - age, 6) AS v FROM ({disfle_sql('km', 'sex').replace('knots', 'knots_' + name)})"


@query("disfle_limits", with_views(f"""
    SELECT a.sex, a.age, a.v AS disfle, u.v AS disfle_up, l.v AS disfle_dn
    FROM ({_limit_part('surv')}) a JOIN ({_limit_part('upper')}) u USING (sex, age) JOIN ({_limit_part('lower')}) l USING (sex, age)""",
    limits=_LIMITS, knots_surv=knots_sql("limits", "sex", "surv"), knots_upper=knots_sql("limits", "sex", "upper"),
    knots_lower=knots_sql("limits", "sex", "lower")))
def disfle_limits(spark, sf):
    c = C.km(X.spells(spark, sf), ["sex"])
    out = C.disease_free_years(c, AGES, ["sex"], limits=True)
    return out.select("sex", "age", r6("disfle", "disfle"), r6("disfle_up", "disfle_up"), r6("disfle_dn", "disfle_dn"))


@query("survival_quantiles", with_views("""
    SELECT round(k / CAST(29 AS DOUBLE), 6) AS level,
           (SELECT CASE WHEN k / CAST(29 AS DOUBLE) <= max(surv) THEN arg_max(t, surv) FILTER (WHERE surv <= k / CAST(29 AS DOUBLE)) END
            FROM (SELECT * FROM km WHERE sex = 'F' AND d > 0)) AS time
    FROM range(1, 29) AS r(k)"""))
def survival_quantiles(spark, sf):
    c = C.km(X.spells(spark, sf).filter(F.col("sex") == "F"))
    return C.survival_quantiles(c).select(r6("level", "level"), "time")


@query("thin_curve", with_views("""
    SELECT sex, t AS time, round(surv, 6) AS surv FROM (
      SELECT *, row_number() OVER (PARTITION BY sex, floor(t * 10) ORDER BY t) AS rn FROM km) WHERE rn = 1"""))
def thin_curve(spark, sf):
    c = C.km(X.spells(spark, sf), ["sex"])
    return C.thin_curve(c, ["sex"], 10).select("sex", "time", r6("surv", "surv"))


@query("curve_wide", with_views("""
    SELECT t AS time, round(max(CASE WHEN sex = 'F' THEN surv END), 6) AS "F", round(max(CASE WHEN sex = 'M' THEN surv END), 6) AS "M"
    FROM km GROUP BY t"""))
def curve_wide(spark, sf):
    c = C.km(X.spells(spark, sf), ["sex"]).withColumn("surv", r6("surv"))
    return C.curve_wide(c, ["time"], "sex", ["F", "M"], "surv")


@query("scaled_hazard", with_views(f"""
    SELECT region, sex, age, round(expectancy - age, 6) AS disfle FROM (
      SELECT split_part(k, '|', 1) AS region, split_part(k, '|', 2) AS sex, age, expectancy FROM ({disfle_sql('scaled', 'k')}))""",
    scaled="""SELECT region || '|' || sex AS k, t, exp(-cumhaz * f) AS surv FROM km,
        (SELECT region, avg(estimate) AS f FROM regions GROUP BY region)""",
    knots=knots_sql("scaled", "k")))
def scaled_hazard(spark, sf):
    """Disease-free years per region, from one curve and the regions' mean hazard ratios."""
    c = C.km(X.spells(spark, sf), ["sex"]).select("sex", "time", "cumhaz")
    f = X.regions(spark, sf).groupBy("region").agg(F.avg("estimate").alias("estimate"))
    out = C.disease_free_years(C.scaled_hazard(c, f), AGES, ["region", "sex"])
    return out.select("region", "sex", "age", r6("disfle", "disfle"))


@query("life_table_curve", with_views("""
    SELECT sex, age AS time, round(lx / max(lx) OVER (PARTITION BY sex), 6) AS surv FROM (
      SELECT sex, CAST(a AS DOUBLE) AS age, CAST((SELECT count(*) FROM individuals i WHERE i.sex = x.sex AND i.age_ref >= a) AS DOUBLE) AS lx
      FROM (SELECT DISTINCT sex FROM individuals) x, range(45, 85) AS r(a)) WHERE age >= 50"""))
def life_table_curve(spark, sf):
    """A mortality-table-like survivor count by age (persons at least that old), conditional on 50."""
    i = X.individuals(spark, sf)
    at = i.groupBy("sex", F.floor("age_ref").cast("int").alias("top")).count()
    lx = at.select("sex", F.explode(F.sequence(F.lit(45), F.col("top"))).alias("age"), "count").groupBy("sex", "age").agg(
        F.sum("count").cast("double").alias("lx"))
    return C.life_table_curve(lx, ["sex"]).select("sex", "time", r6("surv", "surv"))


_LIFE = f"""
    SELECT sex, {age('birth_date', 'entry_date')} AS entry_age, {age('birth_date', 'exit_date')} + {HALF_DAY} AS exit_age, event_flag FROM (
      SELECT i.sex, birth_date, greatest(DATE '1999-01-01', {anniversary('birth_date', '50')}) AS entry_date, least(date_event, DATE '2001-07-01') AS exit_date,
             event = 'DEATH' AND date_event < DATE '2001-07-01' AS event_flag
      FROM individuals i JOIN event_log e ON i.id = e.id WHERE event IN ('DEATH', 'LOST') AND date_event >= DATE '1999-01-01')"""


@query("life_curve", with_views("""
    SELECT sex, t AS time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event,
           round(CASE WHEN bool_or(d = n) OVER w THEN 0.0 ELSE exp(sum(CASE WHEN d < n THEN ln(1.0::DOUBLE - d / CAST(n AS DOUBLE)) ELSE 0 END) OVER w) END, 6) AS surv
    FROM (SELECT *, sum(net) OVER v AS n FROM (SELECT sex, t, sum(net) AS net, sum(d) AS d, sum(x) AS x FROM (
        SELECT sex, round(entry_age, 9) AS t, 1 AS net, 0 AS d, 0 AS x FROM life WHERE entry_age < exit_age AND exit_age >= 50
        UNION ALL SELECT sex, round(exit_age, 9), -1, CAST(event_flag AS INTEGER), 1 FROM life WHERE entry_age < exit_age AND exit_age >= 50) GROUP BY sex, t)
      WINDOW v AS (PARTITION BY sex ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE x > 0
    WINDOW w AS (PARTITION BY sex ORDER BY t ROWS UNBOUNDED PRECEDING)""", life=_LIFE))
def life_curve(spark, sf):
    """Survival until death by sex; only terminal events are read."""
    s = S.life_spells(X.individuals(spark, sf), X.event_log(spark, sf), codes=X.CODES, start="1999-01-01", end="2001-07-01")
    return C.km(s, ["sex"]).select("sex", "time", "n_risk", "n_event", r6("surv", "surv"))

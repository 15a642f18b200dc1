"""Queries on the Cox family."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spellwise.functions.splines import natural_spline, quantile_knots
from spellwise.operators import cox as M
from spellwise.operators import curves as C
from spellwise.operators import predict as R
from spellwise.operators import spells as S
from spellwise.operators.events import exact_split, keep_persons
from spellwise.operators.ordered import keep
from spellwise.plans import fixtures as X
from spellwise.plans.oracle_newton import DBL, eliminate, newton_views, pass_sql, tidy_sql
from spellwise.plans.oracle_views import age, uniform, with_views
from spellwise.plans.queries_survival import AGES, CUTS, VIEW_CR, VIEW_SPLIT, disfle_sql, knots_sql, r6, spells_cr  # noqa: F401
from spellwise.plans.registry import query

LEVELS = {
    "sex": ["F", "M"], "obesity_cat3": ["0", "1", "2"], "alcohol_cat3": ["0", "1", "2"], "smoker_cat3": ["0", "1", "2"],
}
SOCIAL = {"immigration": ["0", "1", "2", "3"], "diplome": ["0", "1", "2", "3"]}
# The coefficients shared with the oracle.
BETA = {
    "sexM": 0.30, "obesity_cat31": 0.10, "obesity_cat32": 0.25, "alcohol_cat31": 0.20, "alcohol_cat32": 0.60,
    "smoker_cat31": 0.15, "smoker_cat32": 0.40,
}
_LP = """(CASE WHEN sex = 'M' THEN 0.30::DOUBLE ELSE 0 END + CASE obesity_cat3 WHEN '1' THEN 0.10::DOUBLE WHEN '2' THEN 0.25::DOUBLE ELSE 0 END
    + CASE alcohol_cat3 WHEN '1' THEN 0.20::DOUBLE WHEN '2' THEN 0.60::DOUBLE ELSE 0 END
    + CASE smoker_cat3 WHEN '1' THEN 0.15::DOUBLE WHEN '2' THEN 0.40::DOUBLE ELSE 0 END)"""


def fixed_model():
    return M.given_model(M.design(LEVELS), BETA)


def baseline(spark, sf):
    return R.baseline_hazard(X.spells(spark, sf), R.linear_predictor(fixed_model()))


@query("cox_linear_predictor", with_views(f"""
    SELECT id, round(lp, 6) AS lp, round(exp(lp), 6) AS risk, CASE WHEN sex = 'M' THEN 0.3::DOUBLE ELSE 0 END AS fit_sex FROM (SELECT *, {_LP} AS lp FROM spells)"""))
def cox_linear_predictor(spark, sf):
    m = fixed_model()
    out = R.predict(R.predict(X.spells(spark, sf), m, "lp", out="lp"), m, "risk", out="risk")
    out = R.predict(out, m, "terms", out="fit")
    return out.select("id", r6("lp", "lp"), r6("risk", "risk"), r6("fit_sex", "fit_sex"))


# A covariance shared with the oracle (unit variances over 25 with neighbours correlated).
_VCOV = [[(0.04 if i == j else 0.01 if abs(i - j) == 1 else 0.0) for j in range(7)] for i in range(7)]
_X = [f"CAST({c} = '{v}' AS INTEGER)" for c, levels in LEVELS.items() for v in levels[1:]]
_VAR = " + ".join(f"{_VCOV[i][j]}::DOUBLE * {_X[i]} * {_X[j]}" for i in range(7) for j in range(7) if _VCOV[i][j])


@query("predict_se", with_views(f"""
    SELECT id, round(lp, 6) AS lp, round(sqrt(v), 6) AS se_lp, round(exp(lp), 6) AS risk, round(sqrt(v) * sqrt(exp(lp)), 6) AS se_risk
    FROM (SELECT id, {_LP} AS lp, {_VAR} AS v FROM spells)"""))
def predict_se(spark, sf):
    """Predictions with standard errors, of the predictor and of the risk."""
    m = M.given_model(M.design(LEVELS), BETA, np.array(_VCOV))
    out = R.predict(R.predict(X.spells(spark, sf), m, "lp", se=True, out="lp"), m, "risk", se=True, out="risk")
    return out.select("id", *[r6(c, c) for c in ("lp", "se_lp", "risk", "se_risk")])


_BH = f"""SELECT *, sum(d / s0) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS cumhaz FROM (
      SELECT *, sum(net) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM (
        SELECT t, sum(net) AS net, sum(d) AS d, sum(x) AS x FROM (
          SELECT round(entry_age, 9) AS t, exp({_LP}) AS net, 0 AS d, 0 AS x FROM spells
          UNION ALL SELECT round(exit_age, 9), -exp({_LP}), CAST(event_flag AS INTEGER), 1 FROM spells) GROUP BY t)) WHERE x > 0"""


@query("breslow_baseline", with_views("SELECT t AS time, CAST(d AS BIGINT) AS n_event, round(s0, 5) AS s0, round(cumhaz, 6) AS cumhaz FROM bh", bh=_BH))
def breslow_baseline(spark, sf):
    return baseline(spark, sf).select("time", "n_event", F.round("s0", 5).alias("s0"), r6("cumhaz", "cumhaz"))


@query("cox_expected", with_views(f"""
    SELECT id, round(e, 6) AS expected, round(exp(-e), 6) AS survival FROM (
      SELECT s.id, (coalesce((SELECT max(cumhaz) FROM bh WHERE t <= round(s.exit_age, 9)), 0) -
                    coalesce((SELECT max(cumhaz) FROM bh WHERE t <= round(s.entry_age, 9)), 0)) * exp({_LP}) AS e FROM spells s)""", bh=_BH))
def cox_expected(spark, sf):
    s = X.spells(spark, sf)
    m, b = fixed_model(), keep(baseline(spark, sf))
    out = R.predict(s, m, "expected", baseline=b, entry="entry_age", exit="exit_age", out="expected")
    return out.select("id", r6("expected", "expected"), r6(F.exp(-F.col("expected")), "survival"))


_SMALL = {"sex": ["F", "M"], "smoker_cat3": ["0", "1", "2"]}
_ZERO = """SELECT *, sum(n) OVER w AS s, sum(a) OVER w AS sa, sum(b) OVER w AS sb, sum(c) OVER w AS sc, sum(ab) OVER w AS sab, sum(ac) OVER w AS sac FROM (
      SELECT t, sum(n) AS n, sum(a * n) AS a, sum(b * n) AS b, sum(c * n) AS c, sum(a * b * n) AS ab, sum(a * c * n) AS ac, sum(d) AS d,
             sum(a * d) AS ea, sum(b * d) AS eb, sum(c * d) AS ec FROM (
        SELECT t, n, d, CAST(sex = 'M' AS INTEGER) AS a, CAST(smoker_cat3 = '1' AS INTEGER) AS b, CAST(smoker_cat3 = '2' AS INTEGER) AS c FROM (
          SELECT sex, smoker_cat3, round(entry_age, 9) AS t, 1 AS n, 0 AS d FROM spells
          UNION ALL SELECT sex, smoker_cat3, round(exit_age, 9), -1, CAST(event_flag AS INTEGER) FROM spells)) GROUP BY t)
    WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("cox_score_at_zero", with_views("""
    SELECT 'loglik' AS "row", 'loglik' AS col, round(-sum(d * ln(CAST(s AS DOUBLE))), 5) AS value FROM z WHERE d > 0
    UNION ALL SELECT 'sexM', 'score', round(sum(ea - d * sa / CAST(s AS DOUBLE)), 5) FROM z WHERE d > 0
    UNION ALL SELECT 'smoker_cat31', 'score', round(sum(eb - d * sb / CAST(s AS DOUBLE)), 5) FROM z WHERE d > 0
    UNION ALL SELECT 'smoker_cat32', 'score', round(sum(ec - d * sc / CAST(s AS DOUBLE)), 5) FROM z WHERE d > 0
    UNION ALL SELECT 'sexM', 'sexM', round(sum(d * (sa / CAST(s AS DOUBLE) - (sa / CAST(s AS DOUBLE)) * (sa / CAST(s AS DOUBLE)))), 5) FROM z WHERE d > 0
    UNION ALL SELECT 'smoker_cat31', 'smoker_cat31', round(sum(d * (sb / CAST(s AS DOUBLE) - (sb / CAST(s AS DOUBLE)) * (sb / CAST(s AS DOUBLE)))), 5) FROM z WHERE d > 0
    UNION ALL SELECT 'smoker_cat32', 'smoker_cat32', round(sum(d * (sc / CAST(s AS DOUBLE) - (sc / CAST(s AS DOUBLE)) * (sc / CAST(s AS DOUBLE)))), 5) FROM z WHERE d > 0
    UNION ALL SELECT 'sexM', 'smoker_cat31', round(sum(d * (sab / CAST(s AS DOUBLE) - (sa / CAST(s AS DOUBLE)) * (sb / CAST(s AS DOUBLE)))), 5) FROM z WHERE d > 0
    UNION ALL SELECT 'sexM', 'smoker_cat32', round(sum(d * (sac / CAST(s AS DOUBLE) - (sa / CAST(s AS DOUBLE)) * (sc / CAST(s AS DOUBLE)))), 5) FROM z WHERE d > 0
    UNION ALL SELECT 'smoker_cat31', 'smoker_cat32', round(sum(-d * (sb / CAST(s AS DOUBLE)) * (sc / CAST(s AS DOUBLE))), 5) FROM z WHERE d > 0""", z=_ZERO))
def cox_score_at_zero(spark, sf):
    out = M.score_and_information(X.spells(spark, sf), M.design(_SMALL), ties="breslow")
    return out.select("row", "col", F.round("value", 5).alias("value"))


@query("schoenfeld_residuals", with_views("""
    SELECT t AS time, 'sexM' AS term, CAST(d AS BIGINT) AS n_event, round(ea - d * sa / CAST(s AS DOUBLE), 6) + 0.0 AS residual FROM z WHERE d > 0
    UNION ALL SELECT t, 'smoker_cat31', CAST(d AS BIGINT), round(eb - d * sb / CAST(s AS DOUBLE), 6) + 0.0 FROM z WHERE d > 0
    UNION ALL SELECT t, 'smoker_cat32', CAST(d AS BIGINT), round(ec - d * sc / CAST(s AS DOUBLE), 6) + 0.0 FROM z WHERE d > 0""", z=_ZERO))
def schoenfeld_residuals(spark, sf):
    out = R.schoenfeld_sums(X.spells(spark, sf), M.design(_SMALL), F.lit(0.0))
    return out.select("time", "term", "n_event", r6("residual", "residual"))


KNOTS = [1.0, 8.0, 15.0, 26.0]


def _truncated_power_sql(x: str, knots=KNOTS) -> list[str]:
    """The same basis from its textbook form: truncated cubes, then a change of basis at the knots."""
    k = np.array(knots)

    def cubes(v):
        d = [(np.maximum(v - k[i], 0) ** 3 - np.maximum(v - k[-1], 0) ** 3) / (k[-1] - k[i]) for i in range(len(k) - 1)]
        return np.column_stack([np.ones_like(v), v, *[d[i] - d[-1] for i in range(len(k) - 2)]])

    change = np.linalg.inv(cubes(k))
    cube = lambda a: f"pow(greatest({x} - {a}::DOUBLE, 0), 3)"
    dd = [f"(({cube(k[i])} - {cube(k[-1])}) / {k[-1] - k[i]}::DOUBLE)" for i in range(len(k) - 1)]
    n = ["1::DOUBLE", f"CAST({x} AS DOUBLE)", *[f"({dd[i]} - {dd[-1]})" for i in range(len(k) - 2)]]
    return [" + ".join(f"({float(change[i, j])!r}::DOUBLE) * {n[i]}" for i in range(len(n))) for j in range(1, len(k))]


@query("spline_basis", with_views(f"""
    SELECT id, tgroup, {', '.join(f'round({e}, 6) + 0.0 AS s{i}' for i, e in enumerate(_truncated_power_sql('tgroup'), start=1))} FROM split""", **VIEW_SPLIT))
def spline_basis(spark, sf):
    split = S.interval_split(X.spells(spark, sf), CUTS)
    basis = natural_spline("tgroup", KNOTS)
    return split.select("id", "tgroup", *[r6(b, f"s{i}") for i, b in enumerate(basis, start=1)])


# Age-varying fixed model: constant effects plus a slope of sex and smoking over the interval number.
_LP_TT = f"({_LP} + CASE WHEN sex = 'M' THEN -0.01::DOUBLE * tgroup ELSE 0 END + CASE WHEN smoker_cat3 = '2' THEN 0.005::DOUBLE * tgroup ELSE 0 END)"


def age_varying_model():
    d = M.design(LEVELS)
    t = F.col("tgroup").cast("double")
    terms = {**d.terms, "sexM:tgroup": d.terms["sexM"] * t, "smoker_cat32:tgroup": d.terms["smoker_cat32"] * t}
    full = M.Design(terms, [*d.base, "tgroup"], d.group)
    return M.given_model(full, {**BETA, "sexM:tgroup": -0.01, "smoker_cat32:tgroup": 0.005})


def interval_number(time="time"):
    """Interval of an event time: pieces are ``(a, b]``, the first begins at 50."""
    grid = F.array(*[F.lit(c) for c in CUTS])
    return (F.size(F.filter(grid, lambda c: c < F.col(time))) + 1)


_BH_TT = f"""SELECT *, d / s0 AS dh, sum(d / s0) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS cumhaz FROM (
      SELECT *, sum(net) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM (
        SELECT t, sum(net) AS net, sum(d) AS d, sum(x) AS x FROM (
          SELECT round(entry_age, 9) AS t, exp({_LP_TT}) AS net, 0 AS d, 0 AS x FROM split
          UNION ALL SELECT round(exit_age, 9), -exp({_LP_TT}), CAST(event_flag AS INTEGER), 1 FROM split) GROUP BY t)) WHERE x > 0"""
#: Every combination of the levels, whatever people have.
_GRID = "SELECT * FROM " + ", ".join(
    "(VALUES " + ", ".join(f"('{v}')" for v in levels) + f") AS v{i}({name})" for i, (name, levels) in enumerate(LEVELS.items()))
_PROFILES = f"""SELECT *, CASE lvl WHEN 0 THEN 'Lowest' WHEN 1 THEN 'Intermediate' ELSE 'Highest' END AS profile FROM (
      SELECT *, CAST(obesity_cat3 = '2' AS INTEGER) + CAST(alcohol_cat3 = '2' AS INTEGER) + CAST(smoker_cat3 = '2' AS INTEGER) AS lvl FROM (
        {_GRID} WHERE obesity_cat3 <> '1' AND alcohol_cat3 <> '1' AND smoker_cat3 <> '1')) WHERE lvl < 3"""


def level_grid(spark, levels):
    """Every combination of the levels."""
    grid = spark.range(1).select()
    for name, values in levels.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return grid


def profiles(spark, sf):
    """Risk profiles: no, one or two severe factors, for every combination of the levels."""
    i = level_grid(spark, LEVELS)
    risk = ["obesity_cat3", "alcohol_cat3", "smoker_cat3"]
    for c in risk:
        i = i.filter(F.col(c) != "1")
    n = sum([(F.col(c) == "2").cast("int") for c in risk], F.lit(0))
    name = F.when(n == 0, "Lowest").when(n == 1, "Intermediate").when(n == 2, "Highest")
    return i.withColumn("profile", name).filter(F.col("profile").isNotNull())


@query("profile_survival", with_views(f"""
    SELECT profile, sex, obesity_cat3, alcohol_cat3, smoker_cat3, t AS time, round(h, 6) AS cumhaz, round(exp(-h), 6) AS surv FROM (
      SELECT *, sum(dh * exp({_LP_TT})) OVER (PARTITION BY sex, obesity_cat3, alcohol_cat3, smoker_cat3 ORDER BY t ROWS UNBOUNDED PRECEDING) AS h
      FROM profs, (SELECT *, (SELECT count(*) FROM (VALUES {', '.join(f'({c}::DOUBLE)' for c in CUTS)}) AS q(c) WHERE c < t) + 1 AS tgroup FROM bht))""",
    bht=_BH_TT, profs=_PROFILES, **VIEW_SPLIT))
def profile_survival(spark, sf):
    """Disease-free survival of risk profiles whose effects change with age."""
    m = age_varying_model()
    lp = R.linear_predictor(m)
    split = S.interval_split(X.spells(spark, sf), CUTS)
    base = R.baseline_hazard(split, lp)
    out = R.path_survival(base, profiles(spark, sf), ["profile", *LEVELS], lp, group=interval_number())
    return out.select("profile", *LEVELS, "time", r6("cumhaz", "cumhaz"), r6("surv", "surv"))


_ALL_PROFILES = _GRID
_PSURV = f"""SELECT sex || obesity_cat3 || alcohol_cat3 || smoker_cat3 AS k, t, exp(-cumhaz * exp({_LP})) AS surv FROM bh, allprofs"""
_EXP = f"SELECT substr(k, 1, 1) AS sex, substr(k, 2, 1) AS obesity_cat3, substr(k, 3, 1) AS alcohol_cat3, substr(k, 4, 1) AS smoker_cat3, expectancy FROM ({disfle_sql('psurv', 'k', ages='(50.0::DOUBLE)')})"
_EXP_VIEWS = dict(bh=_BH, allprofs=_ALL_PROFILES, psurv=_PSURV, knots=knots_sql("psurv", "k"), expect=_EXP)


def expectancies(spark, sf):
    m = fixed_model()
    people = level_grid(spark, LEVELS)
    curves = R.path_survival(baseline(spark, sf), people, list(LEVELS), R.linear_predictor(m))
    return C.residual_expectancy(keep(curves), [50.0], list(LEVELS), max_age=100.0)


@query("profile_expectancy", with_views("SELECT sex, obesity_cat3, alcohol_cat3, smoker_cat3, round(expectancy, 6) AS expectancy FROM expect", **_EXP_VIEWS))
def profile_expectancy(spark, sf):
    """Expected age at the end of disease-free life, from 50, for every risk profile."""
    return expectancies(spark, sf).select(*LEVELS, r6("expectancy", "expectancy"))


def _effect(factor: str, level: str, ref: str) -> str:
    return f"SELECT '{factor}{level}' AS term, (SELECT avg(expectancy) FROM expect WHERE {factor} = '{level}') - (SELECT avg(expectancy) FROM expect WHERE {factor} = '{ref}') AS e"


@query("expectancy_model", with_views("""
    WITH eff AS (""" + " UNION ALL ".join(_effect(f, lv, levels[0]) for f, levels in LEVELS.items() for lv in levels[1:]) + """)
    SELECT term, round(e, 6) AS estimate FROM eff UNION ALL
    SELECT '(Intercept)', round((SELECT avg(expectancy) FROM expect) - (SELECT sum(e / CASE WHEN term LIKE 'sex%' THEN 2 ELSE 3 END) FROM eff), 6)""", **_EXP_VIEWS))
def expectancy_model(spark, sf):
    """Linear summary of the expectancies (a balanced grid, so effects are differences of means)."""
    out = R.expectancy_model(keep(expectancies(spark, sf)), M.design(LEVELS), "expectancy")
    return out.select("term", r6("estimate", "estimate"))


_HELD = f"""SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {uniform('CAST(id AS VARCHAR)', 7)}, id) AS rn FROM individuals)
    WHERE rn > floor(0.6 * (SELECT count(*) FROM individuals))"""


def held_out(spark, sf):
    """Spells of the persons that no model was fitted on."""
    ids = exact_split(X.individuals(spark, sf), 0.6, seed=7).filter(~F.col("train"))
    return keep_persons(X.spells(spark, sf), ids)


@query("concordance", with_views("""
    SELECT CAST(count(*) FILTER (WHERE i.lp > j.lp) AS DOUBLE) AS concordant, CAST(count(*) FILTER (WHERE i.lp < j.lp) AS DOUBLE) AS discordant,
           CAST(count(*) FILTER (WHERE i.lp = j.lp) AS DOUBLE) AS tied_score,
           round((count(*) FILTER (WHERE i.lp > j.lp) + count(*) FILTER (WHERE i.lp = j.lp) / 2.0::DOUBLE) / count(*), 6) AS concordance
    FROM (SELECT * FROM scored WHERE event_flag) i JOIN scored j
      ON j.a < i.b AND (j.b > i.b OR (j.b = i.b AND NOT j.event_flag))""",
    scored=f"SELECT id, round(entry_age, 9) AS a, round(exit_age, 9) AS b, event_flag, round({_LP}, 9) AS lp FROM spells WHERE id IN (SELECT id FROM heldids)", heldids=_HELD))
def concordance(spark, sf):
    s = held_out(spark, sf).withColumn("lp", R.linear_predictor(fixed_model()))
    out = R.concordance(s, "lp")
    return out.withColumn("concordance", r6("concordance"))


_GROUPS = """CASE WHEN lp <= 0.2 THEN '(-Inf,0.2]' WHEN lp <= 0.7 THEN '(0.2,0.7]' WHEN lp <= 1.1 THEN '(0.7,1.1]' WHEN lp <= 1.5 THEN '(1.1,1.5]' ELSE '(1.5, Inf]' END"""


@query("risk_group_calibration", with_views(f"""
    SELECT 'observed' AS origin, risk_group, t AS time, round(CASE WHEN bool_or(d = n) OVER w THEN 0.0 ELSE exp(sum(CASE WHEN d < n THEN ln(1.0::DOUBLE - d / CAST(n AS DOUBLE)) ELSE 0 END) OVER w) END, 6) AS surv
    FROM (SELECT *, sum(n1) OVER v AS n FROM (
      SELECT risk_group, t, sum(n1) AS n1, sum(d) AS d, sum(x) AS x FROM (
        SELECT risk_group, round(entry_age, 9) AS t, 1 AS n1, 0 AS d, 0 AS x FROM persons
        UNION ALL SELECT risk_group, round(exit_age, 9), -1, CAST(event_flag AS INTEGER), 1 FROM persons) GROUP BY ALL)
      WINDOW v AS (PARTITION BY risk_group ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE x > 0
    WINDOW w AS (PARTITION BY risk_group ORDER BY t ROWS UNBOUNDED PRECEDING)
    UNION ALL SELECT 'predicted', g.risk_group, t, round(exp(-cumhaz * exp(m)), 6) FROM bht, (SELECT risk_group, avg(lp) AS m FROM persons GROUP BY risk_group) g""",
    bht=_BH_TT, persons=f"""SELECT *, {_GROUPS} AS risk_group FROM (SELECT id, min(entry_age) AS entry_age, max(exit_age) AS exit_age, bool_or(event_flag) AS event_flag,
      round(avg({_LP_TT}), 9) AS lp FROM split GROUP BY id)""", heldids=_HELD, wholesplit=VIEW_SPLIT["split"],
    split="SELECT * FROM wholesplit WHERE id IN (SELECT id FROM heldids)"))
def risk_group_calibration(spark, sf):
    """Observed curves of groups of mean predictor next to the model's curves."""
    lp = R.linear_predictor(age_varying_model())
    split = S.interval_split(held_out(spark, sf), CUTS).persist()
    persons = R.risk_groups(split.withColumn("lp", lp), "lp", [0.2, 0.7, 1.1, 1.5]).persist()
    out = R.calibration(persons, R.baseline_hazard(split, lp))
    return out.select("origin", "risk_group", "time", r6("surv", "surv"))


# Effects of department and social factors, by rule, shared with the oracle.
SOCIAL_BETA = {"diplome1": -0.05, "diplome2": -0.1, "diplome3": -0.2, "immigration1": 0.05, "immigration2": 0.1, "immigration3": 0.15}
DEPARTMENTS = {"dep": [str(k) for k in range(25)]}
DEPARTMENT_BETA = {f"dep{k}": 0.02 * (7 * k % 5 - 2) for k in range(1, 25)}
_LP_ALL = f"""({_LP_TT} + CASE WHEN dep <> '0' THEN 0.02::DOUBLE * ((7 * CAST(dep AS INTEGER)) % 5 - 2) ELSE 0 END
    + CASE diplome WHEN '1' THEN -0.05::DOUBLE WHEN '2' THEN -0.1::DOUBLE WHEN '3' THEN -0.2::DOUBLE ELSE 0 END
    + CASE immigration WHEN '1' THEN 0.05::DOUBLE WHEN '2' THEN 0.1::DOUBLE WHEN '3' THEN 0.15::DOUBLE ELSE 0 END)"""
# The named profiles (severe risk factors, department, diploma), immigration at its reference.
NAMED = {"Lowest": (0, "6", "0"), "Intermediate": (1, "15", "1"), "Highest": (2, "7", "3")}
_NAMED = f"""SELECT *, '0' AS immigration FROM (SELECT *, CASE lvl {' '.join(f"WHEN {k} THEN '{n}'" for n, (k, _, _) in NAMED.items())} END AS profile,
      CASE lvl {' '.join(f"WHEN {k} THEN '{d}'" for k, d, _ in NAMED.values())} END AS dep, CASE lvl {' '.join(f"WHEN {k} THEN '{e}'" for k, _, e in NAMED.values())} END AS diplome
      FROM (SELECT *, CAST(obesity_cat3 = '2' AS INTEGER) + CAST(alcohol_cat3 = '2' AS INTEGER) + CAST(smoker_cat3 = '2' AS INTEGER) AS lvl FROM (
        {_GRID} WHERE obesity_cat3 <> '1' AND alcohol_cat3 <> '1' AND smoker_cat3 <> '1')) WHERE lvl < 3)"""
_BH_ALL = _BH_TT.replace(_LP_TT, _LP_ALL)
_NAMED_CURVES = f"""SELECT *, exp(-h) AS surv FROM (
      SELECT *, sum(dh * exp({_LP_ALL})) OVER (PARTITION BY sex, obesity_cat3, alcohol_cat3, smoker_cat3 ORDER BY t ROWS UNBOUNDED PRECEDING) AS h
      FROM named, (SELECT *, (SELECT count(*) FROM (VALUES {', '.join(f'({c}::DOUBLE)' for c in CUTS)}) AS q(c) WHERE c < t) + 1 AS tgroup FROM bhall))"""
_NAMED_VIEWS = dict(bhall=_BH_ALL, named=_NAMED, namedcurves=_NAMED_CURVES, **VIEW_SPLIT)
WHO = ["profile", *LEVELS, "dep", "immigration", "diplome"]


def full_model():
    """The age-varying model with department and social factors."""
    m = age_varying_model()
    d = M.design({**DEPARTMENTS, **SOCIAL})
    full = M.Design({**m.design.terms, **d.terms}, [*m.design.base, *d.base], {**m.design.group, **d.group})
    beta = dict(zip(m.design.names, m.coef)) | SOCIAL_BETA | DEPARTMENT_BETA
    return M.given_model(full, beta)


def named_curves(spark, sf):
    lp = R.linear_predictor(full_model())
    base = R.baseline_hazard(S.interval_split(X.spells(spark, sf), CUTS), lp)
    who = profiles(spark, sf)
    for column, at in (("dep", 1), ("diplome", 2)):
        value = F.create_map(*[F.lit(v) for n, p in NAMED.items() for v in (n, p[at])])[F.col("profile")]
        who = who.withColumn(column, value)
    return R.path_survival(base, who.withColumn("immigration", F.lit("0")), WHO, lp, group=interval_number())


@query("named_profile_survival", with_views(f"""
    SELECT {', '.join(WHO)}, t AS time, round(h, 6) AS cumhaz, round(surv, 6) AS surv FROM namedcurves""", **_NAMED_VIEWS))
def named_profile_survival(spark, sf):
    """Disease-free survival of the named profiles, department, immigration and diploma included."""
    return named_curves(spark, sf).select(*WHO, "time", r6("cumhaz", "cumhaz"), r6("surv", "surv"))


@query("named_profile_expectancy", with_views(f"""
    SELECT split_part(k, '|', 1) AS profile, split_part(k, '|', 2) AS sex, split_part(k, '|', 3) AS obesity_cat3, split_part(k, '|', 4) AS alcohol_cat3,
           split_part(k, '|', 5) AS smoker_cat3, round(expectancy, 6) AS expectancy FROM ({disfle_sql('namedk', 'k', ages='(50.0::DOUBLE)')})""",
    namedk="SELECT concat_ws('|', profile, sex, obesity_cat3, alcohol_cat3, smoker_cat3) AS k, t, surv FROM namedcurves",
    knots=knots_sql("namedk", "k"), **_NAMED_VIEWS))
def named_profile_expectancy(spark, sf):
    """Expected age at the end of disease-free life, from 50, of the named profiles."""
    keys = ["profile", *LEVELS]
    out = C.residual_expectancy(keep(named_curves(spark, sf)), [50.0], keys, max_age=100.0)
    return out.select(*keys, r6("expectancy", "expectancy"))


# ---------------------------------------------------------------- fitted models (iterative; no oracle text)


def training(spark, sf):
    s = X.spells(spark, sf)
    ids = exact_split(X.individuals(spark, sf), 0.6, seed=7).filter("train")
    return keep_persons(s, ids)


def tidy(fit, spark):
    out = M.tidy_fit(fit, spark)
    return out.select("term", *[r6(c, c) for c in out.columns if c not in ("term", "converged")], "converged")


@query("cox_coefficients")
def cox_coefficients(spark, sf):
    """Constant effects on the training persons: risk factors and sex with all pairs, department, social quartiles."""
    return tidy(M.cox_fit(training(spark, sf), constant_design()), spark)


SPLINE_DF = 8


def constant_design():
    return M.design({**LEVELS, **DEPARTMENTS, **SOCIAL}, crossed=list(LEVELS))


def age_varying_design(split):
    """All pairs of risk factors and sex, each of them with a natural spline over the interval, department, social factors."""
    knots = quantile_knots(split, "tgroup", SPLINE_DF)
    return M.design({**LEVELS, **DEPARTMENTS, **SOCIAL}, crossed=list(LEVELS), spline=("tgroup", knots), spline_with=list(LEVELS))


def age_varying_fit(spark, sf):
    split = S.interval_split(training(spark, sf), CUTS).persist()
    fit = M.cox_fit(split, age_varying_design(split))
    split.unpersist()
    return fit


@query("cox_age_varying")
def cox_age_varying(spark, sf):
    """Effects of risk factors and sex that follow a natural spline over the age interval."""
    return tidy(age_varying_fit(spark, sf), spark)


def reference_people(spark, sf):
    """Every combination of the levels, at the reference level of the social factors and of the department."""
    return level_grid(spark, LEVELS).withColumns({c: F.lit("0") for c in [*SOCIAL, "dep"]})


@query("age_effect_grid")
def age_effect_grid(spark, sf):
    """Hazard ratio by age of each single risk factor."""
    one = sum([(F.col(c) != lv[0]).cast("int") for c, lv in LEVELS.items()], F.lit(0)) == 1
    out = R.effect_grid(reference_people(spark, sf).filter(one), age_varying_fit(spark, sf), CUTS)
    return out.select(*LEVELS, "tgroup", "times", r6("fit", "fit"), r6("fit_up", "fit_up"), r6("fit_dn", "fit_dn"))


@query("interaction_grid")
def interaction_grid(spark, sf):
    """Hazard ratio by age of pairs of risk factors (women, no third factor)."""
    risk = ["obesity_cat3", "alcohol_cat3", "smoker_cat3"]
    pairs = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2")) for a in risk for b in risk if a != b])
    p = reference_people(spark, sf).filter(F.col("sex") == "F").select("*", F.inline(pairs))
    value = lambda v: F.coalesce(*[F.when(F.col(v) == c, F.col(c)) for c in risk])
    third = F.coalesce(*[F.when((F.col("var1") != c) & (F.col("var2") != c), F.col(c)) for c in risk])
    p = p.filter(third == "0").withColumns({"val1": value("var1"), "val2": value("var2")})
    out = R.effect_grid(p, age_varying_fit(spark, sf), CUTS)
    return out.select("var1", "val1", "var2", "val2", "tgroup", "times", r6("fit", "fit"), r6("fit_up", "fit_up"), r6("fit_dn", "fit_dn"))


#: Steps go on until the log-likelihood stands still, so that estimates agree with the oracle's to six digits.
FINE = 1e-11
_SEX_SMOKE = "CAST(sex = 'M' AS INTEGER) AS x1, CAST(smoker_cat3 = '1' AS INTEGER) AS x2, CAST(smoker_cat3 = '2' AS INTEGER) AS x3"
_SMALL_TERMS = ["sexM", "smoker_cat31", "smoker_cat32"]


def _visits_sql(event: str, flag: str) -> str:
    """Spells cut at the first event of a kind, as ``time_varying_merge`` cuts them."""
    return f"""WITH s AS (SELECT sp.*, (SELECT min({age('sp.birth_date', 'e.date_event')}) FROM event_log e
                 WHERE e.id = sp.id AND e.event = '{event}') AS tc FROM spells sp)
      SELECT * EXCLUDE (entry_age, exit_age, event_flag), entry_age AS a, exit_age AS b, 0 AS {flag}, event_flag AS ev FROM s WHERE tc IS NULL OR tc >= exit_age
      UNION ALL SELECT * EXCLUDE (entry_age, exit_age, event_flag), entry_age, exit_age, 1, event_flag FROM s WHERE tc <= entry_age
      UNION ALL SELECT * EXCLUDE (entry_age, exit_age, event_flag), entry_age, tc, 0, false FROM s WHERE tc > entry_age AND tc < exit_age
      UNION ALL SELECT * EXCLUDE (entry_age, exit_age, event_flag), tc, exit_age, 1, event_flag FROM s WHERE tc > entry_age AND tc < exit_age"""


@query("cox_time_varying", with_views(
    tidy_sql("tv", [*_SMALL_TERMS, "had_visit"]), visits=_visits_sql("NO_ILLNESS", "had_visit"),
    tvdata=f"SELECT a, b, ev, {_SEX_SMOKE}, had_visit AS x4 FROM visits", **newton_views("tv", "tvdata", 4)))
def cox_time_varying(spark, sf):
    """Effect of having had another condition, as a covariate that switches on."""
    changes = X.age_of_event(X.event_log(spark, sf).filter(F.col("event") == "NO_ILLNESS").join(
        X.individuals(spark, sf).select("id", "birth_date"), "id"))
    merged = S.time_varying_merge(X.spells(spark, sf), changes, "had_visit")
    d = M.design({"sex": LEVELS["sex"], "smoker_cat3": LEVELS["smoker_cat3"]}, numeric=["had_visit"])
    return tidy(M.cox_fit(merged, d, eps=FINE), spark)


_SMALL_DATA = f"SELECT entry_age AS a, exit_age AS b, event_flag AS ev, {_SEX_SMOKE} FROM spells"
_SMALL_FIT = dict(smalldata=_SMALL_DATA, **newton_views("sm", "smalldata", 3))


@query("cox_fit_small", with_views(tidy_sql("sm", _SMALL_TERMS), **_SMALL_FIT))
def cox_fit_small(spark, sf):
    """Effects of sex and smoking on all persons, ties by Efron's method."""
    return tidy(M.cox_fit(X.spells(spark, sf), M.design(_SMALL), eps=FINE), spark)


_TRAIN_FIT = dict(heldids=_HELD, traindata=_SMALL_DATA + " WHERE id NOT IN (SELECT id FROM heldids)", **newton_views("tr", "traindata", 3))


@query("concordance_fitted", with_views("""
    SELECT CAST(count(*) FILTER (WHERE i.lp > j.lp) AS DOUBLE) AS concordant, CAST(count(*) FILTER (WHERE i.lp < j.lp) AS DOUBLE) AS discordant,
           CAST(count(*) FILTER (WHERE i.lp = j.lp) AS DOUBLE) AS tied_score,
           round((count(*) FILTER (WHERE i.lp > j.lp) + count(*) FILTER (WHERE i.lp = j.lp) / 2.0::DOUBLE) / count(*), 6) AS concordance
    FROM (SELECT * FROM fitscored WHERE event_flag) i JOIN fitscored j
      ON j.a < i.b AND (j.b > i.b OR (j.b = i.b AND NOT j.event_flag))""",
    fitscored="""SELECT id, round(entry_age, 9) AS a, round(exit_age, 9) AS b, event_flag,
      round(CASE WHEN sex = 'M' THEN b_1 ELSE 0 END + CASE smoker_cat3 WHEN '1' THEN b_2 WHEN '2' THEN b_3 ELSE 0 END, 6) AS lp
      FROM spells, tr_b WHERE id IN (SELECT id FROM heldids)""", **_TRAIN_FIT))
def concordance_fitted(spark, sf):
    """Concordance on held-out persons of a model that was fitted on the others."""
    fit = M.cox_fit(training(spark, sf), M.design(_SMALL), eps=FINE)
    out = R.concordance(held_out(spark, sf).withColumn("lp", r6(R.linear_predictor(fit))), "lp")
    return out.withColumn("concordance", r6("concordance"))


@query("calibration_fitted", with_views("""
    SELECT o.grp AS risk_group, CAST(n AS BIGINT) AS n, CAST(events AS BIGINT) AS observed, round(expected, 6) AS expected FROM (
      SELECT sex || smoker_cat3 AS grp, count(*) AS n, sum(CAST(event_flag AS INTEGER)) AS events, sum((coalesce((SELECT max(cumhaz) FROM trbh WHERE t <= round(s.exit_age, 9)), 0)
        - coalesce((SELECT max(cumhaz) FROM trbh WHERE t <= round(s.entry_age, 9)), 0)) * exp(b_1 * CAST(sex = 'M' AS INTEGER) + b_2 * CAST(smoker_cat3 = '1' AS INTEGER)
        + b_3 * CAST(smoker_cat3 = '2' AS INTEGER))) AS expected
      FROM spells s, tr_b WHERE id IN (SELECT id FROM heldids) GROUP BY 1) o""",
    trbh="""SELECT t, sum(dh) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS cumhaz FROM (
      SELECT t, sum(CASE WHEN d > 0 THEN 1 / (s0 - CAST(l AS DOUBLE) / d * e0) ELSE 0 END) AS dh FROM (
        SELECT *, unnest(range(CAST(greatest(d, 1) AS BIGINT))) AS l FROM (
          SELECT *, sum(n0) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM (
            SELECT t, sum(net * w) AS n0, sum(d) AS d, sum(d * w) AS e0 FROM (
              SELECT t, net, d, exp(b_1 * x1 + b_2 * x2 + b_3 * x3) AS w FROM tr_r, tr_b) GROUP BY t))) GROUP BY t)""", **_TRAIN_FIT))
def calibration_fitted(spark, sf):
    """Events among held-out persons per covariate group, next to those expected from a model fitted on the others."""
    train = training(spark, sf)
    fit = M.cox_fit(train, M.design(_SMALL), eps=FINE)
    base = keep(R.baseline_hazard(train, R.linear_predictor(fit), ties="efron"))
    out = R.predict(held_out(spark, sf), fit, "expected", baseline=base, entry="entry_age", out="e")
    return out.groupBy(F.concat("sex", "smoker_cat3").alias("risk_group")).agg(
        F.count("*").alias("n"), F.count_if("event_flag").alias("observed"), r6(F.sum("e"), "expected"))


@query("cox_fit_breslow", with_views(tidy_sql("sb", _SMALL_TERMS), smalldata=_SMALL_DATA, **newton_views("sb", "smalldata", 3, ties="breslow")))
def cox_fit_breslow(spark, sf):
    """The same with ties by Breslow's method."""
    return tidy(M.cox_fit(X.spells(spark, sf), M.design(_SMALL), ties="breslow", eps=FINE), spark)


FEW_KNOTS = [1.0, 8.0, 26.0]
_SPLINE_X = ", ".join(f"CAST(sex = 'M' AS INTEGER) * ({e}) AS x{i}" for i, e in enumerate(_truncated_power_sql("tgroup", FEW_KNOTS), start=2))


@query("cox_spline_fit", with_views(
    tidy_sql("sp", ["sexM", "sexM:tgroup_s1", "sexM:tgroup_s2"], aliased=["tgroup_s1", "tgroup_s2"]),
    spdata=f"SELECT entry_age AS a, exit_age AS b, event_flag AS ev, CAST(sex = 'M' AS INTEGER) AS x1, {_SPLINE_X} FROM split",
    **VIEW_SPLIT, **newton_views("sp", "spdata", 3)))
def cox_spline_fit(spark, sf):
    """An effect of sex that follows a spline over the age interval; the interval alone says nothing inside a risk set, so its
    own columns are aliased."""
    split = S.interval_split(X.spells(spark, sf), CUTS)
    d = M.design({"sex": LEVELS["sex"]}, spline=("tgroup", FEW_KNOTS), spline_with=["sex"])
    return tidy(M.cox_fit(split, d, eps=FINE), spark)


def _ph_views() -> dict[str, str]:
    """Score test of ``x * g(t)``, g one minus the survival just before t, from the three information matrices."""
    p, one, pairs = 3, "m1", [(i, j) for i in range(1, 4) for j in range(i, 4)]
    views = dict(_SMALL_FIT)
    views["phg"] = """SELECT t, 1 - coalesce(exp(sum(CASE WHEN d > 0 AND d < n THEN ln(1 - d / CAST(n AS DOUBLE)) ELSE 0 END)
        OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS g FROM (
      SELECT *, sum(net) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM (
        SELECT t, sum(net) AS net, sum(d) AS d FROM sm_r GROUP BY t))"""
    views["phs"] = pass_sql("sm_r", "sm_b", p, g="phg")
    sym = lambda m, i, j: f"{m}_{min(i, j)}_{max(i, j)}"
    rhs = ", ".join(f"{sym('m1', i, j)} AS c{j}_{i}" for j in range(1, 4) for i in range(1, 4))
    carry = [f"u1_{i}" for i in range(1, 4)] + [f"{m}_{i}_{j}" for m in ("m1", "m2") for i, j in pairs]
    solved = eliminate(f"SELECT *, {rhs} FROM phs", p, ["c1", "c2", "c3", "u"], carry)
    v = ", ".join(f"m2_{i}_{j} - ({' + '.join(f'{sym(one, i, k)} * z_c{j}_{k}' for k in range(1, 4))}) AS m_{i}_{j}" for i, j in pairs)
    u = ", ".join(f"u1_{i} - ({' + '.join(f'{sym(one, i, k)} * z_u_{k}' for k in range(1, 4))}) AS s_{i}" for i in range(1, 4))
    views["phv"] = f"SELECT {v}, {u} FROM ({solved})"
    return views


def _chi(factor: str, at: list[int]) -> str:
    n = len(at)
    cols = [f"m_{at[i - 1]}_{at[j - 1]} AS m_{i}_{j}" for i in range(1, n + 1) for j in range(i, n + 1)] + [f"s_{a} AS s_{i}" for i, a in enumerate(at, start=1)]
    src = f"SELECT {', '.join(cols)} FROM phv"
    solved = eliminate(src, n, ["s"], [f"s_{i}" for i in range(1, n + 1)])
    chi = " + ".join(f"s_{i} * z_s_{i}" for i in range(1, n + 1))
    return f"SELECT '{factor}' AS factor, round({chi}, 6) + 0.0{DBL} AS chisq, {n} AS df FROM ({solved})"


@query("ph_test_small", with_views(" UNION ALL ".join([_chi("sex", [1]), _chi("smoker_cat3", [2, 3]), _chi("GLOBAL", [1, 2, 3])]), **_ph_views()))
def ph_test_small(spark, sf):
    """Proportional-hazards test of the model of sex and smoking, time as one minus the survival before it."""
    s = X.spells(spark, sf)
    fit = M.cox_fit(s, M.design(_SMALL), eps=FINE)
    out = spark.createDataFrame([(n, float(c), int(k)) for n, c, k in M.ph_test(s, fit)], "factor string, chisq double, df int")
    return out.withColumn("chisq", r6("chisq"))


CAUSES = ("ILL1_A", "ILL1_B")
_CAUSE_X = "CAST(sex = 'M' AS INTEGER) AS x1, CAST(obesity_cat3 = '1' AS INTEGER) AS x2, CAST(obesity_cat3 = '2' AS INTEGER) AS x3"
_CAUSE_TERMS = ["sexM", "obesity_cat31", "obesity_cat32"]
_CAUSE_VIEWS = dict(VIEW_CR)
for _k, _c in enumerate(CAUSES):
    _CAUSE_VIEWS[f"cdata{_k}"] = f"SELECT entry_age AS a, exit_age AS b, cause = '{_c}' AS ev, {_CAUSE_X} FROM spells_cr"
    _CAUSE_VIEWS |= newton_views(f"c{_k}", f"cdata{_k}", 3)
    # increments of the baseline hazard, and the factor of each profile
    _CAUSE_VIEWS[f"ch{_k}"] = f"""SELECT t, sum(1 / (s0 - (CAST(l AS DOUBLE) / d) * e0)) AS dh FROM (
      SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM (
        SELECT *, sum(n0) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM (
          SELECT t, sum(net * w) AS n0, sum(d) AS d, sum(d * w) AS e0 FROM (
            SELECT t, net, d, exp(b_1 * x1 + b_2 * x2 + b_3 * x3) AS w FROM c{_k}_r, c{_k}_b) GROUP BY t)) WHERE d > 0) GROUP BY t"""
_CAUSE_VIEWS["cpaths"] = """SELECT sex, obesity_cat3, t, sum(a0) AS a0, sum(a1) AS a1 FROM (
    """ + " UNION ALL ".join(f"""SELECT sex, obesity_cat3, t, {'dh * r' if k == 0 else '0'} AS a0, {'dh * r' if k == 1 else '0'} AS a1 FROM ch{k}, (
      SELECT sex, obesity_cat3, exp(CASE WHEN sex = 'M' THEN b_1 ELSE 0 END + CASE obesity_cat3 WHEN '1' THEN b_2 WHEN '2' THEN b_3 ELSE 0 END) AS r
      FROM (VALUES ('F'), ('M')) AS v(sex), (VALUES ('0'), ('1'), ('2')) AS o(obesity_cat3), c{k}_b)""" for k in range(2)) + ") GROUP BY ALL"


def cause_fits(spark, sf, causes=CAUSES):
    cr = spells_cr(spark, sf).filter(F.col("entry_age") < F.col("exit_age"))
    d = M.design({"sex": LEVELS["sex"], "obesity_cat3": LEVELS["obesity_cat3"]})
    return cr, {c: M.cox_fit(cr, d, event=F.col("cause") == c, eps=FINE) for c in causes}


@query("cox_cause_specific", with_views(
    " UNION ALL ".join(tidy_sql(f"c{k}", _CAUSE_TERMS, extra=f", '{c}' AS cause") for k, c in enumerate(CAUSES)), **_CAUSE_VIEWS))
def cox_cause_specific(spark, sf):
    """One model per cause of exit."""
    _, fits = cause_fits(spark, sf)
    out = None
    for cause, fit in fits.items():
        part = tidy(fit, spark).withColumn("cause", F.lit(cause))
        out = part if out is None else out.unionByName(part)
    return out


@query("cause_specific_curves", with_views("""
    SELECT sex, obesity_cat3, t AS time, round(exp(-h), 6) AS surv, round(sum(g * a0) OVER w, 6) AS "cif_ILL1_A", round(sum(g * a1) OVER w, 6) AS "cif_ILL1_B" FROM (
      SELECT *, exp(a - h) * (1 - exp(-a)) / a AS g FROM (
        SELECT *, a0 + a1 AS a, sum(a0 + a1) OVER (PARTITION BY sex, obesity_cat3 ORDER BY t ROWS UNBOUNDED PRECEDING) AS h FROM cpaths))
    WINDOW w AS (PARTITION BY sex, obesity_cat3 ORDER BY t ROWS UNBOUNDED PRECEDING)""", **_CAUSE_VIEWS))
def cause_specific_curves(spark, sf):
    """Cumulative incidence of either illness per profile from the cause-specific models."""
    cr, fits = cause_fits(spark, sf)
    lps = {k: R.linear_predictor(f) for k, f in fits.items()}
    bases = R.baseline_hazards(cr, lps, ties="efron", event={k: F.col("cause") == k for k in fits})
    people = level_grid(spark, {c: LEVELS[c] for c in ("sex", "obesity_cat3")})
    out = R.cause_specific_curves(bases, lps, people, ["sex", "obesity_cat3"])
    return out.select("sex", "obesity_cat3", "time", *[r6(c, c) for c in out.columns if c.startswith(("surv", "cif"))])


@query("ph_test")
def ph_test(spark, sf):
    """Proportional-hazards tests of the full constant model and of the full age-varying one."""
    s = training(spark, sf).persist()
    split = S.interval_split(s, CUTS).persist()
    rows = []
    for name, data, design in (("constant", s, constant_design()), ("age_varying", split, age_varying_design(split))):
        fit = M.cox_fit(data, design)
        rows += [(name, n, float(c), int(k), fit.converged) for n, c, k in M.ph_test(data, fit)]
    out = spark.createDataFrame(rows, "model string, factor string, chisq double, df int, converged boolean")
    return out.withColumn("chisq", r6("chisq"))


@query("survival_cut_model")
def survival_cut_model(spark, sf):
    """Age-varying model on intervals cut where survival passes even levels."""
    s = training(spark, sf).persist()
    q = C.survival_quantiles(C.km(s.filter(F.col("sex") == "F")))
    cuts = sorted({r["time"] for r in q.filter(F.col("time").isNotNull()).select("time").collect()})
    split = S.interval_split(s, cuts).persist()
    return tidy(M.cox_fit(split, age_varying_design(split)), spark)


_ADD_X = {1: "1", 2: "CAST(sex = 'M' AS INTEGER)", 3: "CAST(smoker_cat3 = '1' AS INTEGER)", 4: "CAST(smoker_cat3 = '2' AS INTEGER)"}
_ADD_PAIRS = [(i, j) for i in range(1, 5) for j in range(i, 5)]


def _additive_views() -> dict[str, str]:
    """Normal equations of those at risk at each event time, solved by elimination (four columns)."""
    xs = ", ".join(f"{e} AS x{i}" for i, e in _ADD_X.items())
    rows = f"""SELECT t, net, d, {xs} FROM (
      SELECT sex, smoker_cat3, round(entry_age, 9) AS t, 1 AS net, 0 AS d FROM spells WHERE entry_age < exit_age
      UNION ALL SELECT sex, smoker_cat3, round(exit_age, 9), -1, CAST(event_flag AS INTEGER) FROM spells WHERE entry_age < exit_age)"""
    sums = ", ".join(f"sum(net * x{i} * x{j}) AS n_{i}_{j}, CAST(sum(d * x{i} * x{j}) AS DOUBLE) AS e_{i}_{j}" for i, j in _ADD_PAIRS)
    sums += ", " + ", ".join(f"CAST(sum(d * x{i}) AS DOUBLE) AS ex_{i}" for i in _ADD_X)
    over = ", ".join(f"CAST(sum(n_{i}_{j}) OVER o AS DOUBLE) AS m_{i}_{j}" for i, j in _ADD_PAIRS)
    unit = ", ".join(f"{int(i == j)}{DBL} AS i{j}_{i}" for j in _ADD_X for i in _ADD_X)
    times = f"""SELECT *, {unit} FROM (SELECT *, {over} FROM (SELECT t, sum(d) AS d, {sums} FROM ({rows}) GROUP BY t)
      WINDOW o AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE d > 0"""
    carry = ["t", "d", *[f"e_{i}_{j}" for i, j in _ADD_PAIRS], *[f"m_{i}_{i}" for i in _ADD_X]]
    solved = eliminate("SELECT * FROM addtimes", 4, ["ex", *[f"i{j}" for j in _ADD_X]], carry)
    whole = " AND ".join(f"t_{i}_{i} > 1e-9 * m_{i}_{i}" for i in _ADD_X)
    sym = lambda j, k: f"e_{min(j, k)}_{max(j, k)}"
    var = [f"greatest({' + '.join(f'z_i{j}_{i} * {sym(j, k)} * z_i{k}_{i}' for j in _ADD_X for k in _ADD_X)}, 0) AS w_{i}" for i in _ADD_X]
    return {
        "addtimes": times,
        "addsolved": f"SELECT *, coalesce({whole}, false) AS whole, m_1_1 < 9 AS few FROM ({solved})",
        "addinc": f"SELECT t, {', '.join(f'z_ex_{i} AS c_{i}' for i in _ADD_X)}, {', '.join(var)} FROM addsolved WHERE whole AND NOT few",
    }


def _additive_part(i: int, term: str) -> str:
    c, h = f"sum(c_{i}) OVER o", f"1.96{DBL} * sqrt(sum(w_{i}) OVER o)"
    return f"""SELECT '{term}' AS term, t AS time, round({c}, 6) + 0.0 AS coef, round({c} + {h}, 6) + 0.0 AS coef_up, round({c} - {h}, 6) + 0.0 AS coef_dn
      FROM addinc WINDOW o AS (ORDER BY t ROWS UNBOUNDED PRECEDING)"""


ADDITIVE = {"sex": LEVELS["sex"], "smoker_cat3": LEVELS["smoker_cat3"]}


@query("additive_effects", with_views(" UNION ALL ".join(
    _additive_part(i, t) for i, t in enumerate(["Intercept", *_SMALL_TERMS], start=1)), **_additive_views()))
def additive_effects(spark, sf):
    """Cumulative effects of an additive-hazards model."""
    out = M.additive_effects(X.spells(spark, sf), M.design(ADDITIVE))
    return out.select("term", "time", *[r6(c, c) for c in ("coef", "coef_up", "coef_dn")])


@query("additive_left_out", with_views("""
    SELECT t AS time, CAST(m_1_1 AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, CASE WHEN few THEN 'few' ELSE 'singular' END AS reason
    FROM addsolved WHERE few OR NOT whole""", **_additive_views()))
def additive_left_out(spark, sf):
    """Event times that add nothing to the cumulative effects, and why."""
    return M.additive_model(X.spells(spark, sf), M.design(ADDITIVE))[1]


_ADD = """SELECT *, sum(CASE WHEN d0 > 0 THEN d0 / n0 ELSE 0 END) OVER w AS b0, sum(d1 / n1 - d0 / n0) OVER w AS b1, sum(d2 / n2 - d0 / n0) OVER w AS b2,
      sum(d0 / (n0 * n0)) OVER w AS v0, sum(d0 / (n0 * n0) + d1 / (n1 * n1)) OVER w AS v1, sum(d0 / (n0 * n0) + d2 / (n2 * n2)) OVER w AS v2 FROM (
    SELECT t, d0::DOUBLE AS d0, d1::DOUBLE AS d1, d2::DOUBLE AS d2, (sum(m0) OVER u)::DOUBLE AS n0, (sum(m1) OVER u)::DOUBLE AS n1, (sum(m2) OVER u)::DOUBLE AS n2 FROM (
      SELECT t, sum(CASE WHEN s = '0' THEN m ELSE 0 END) AS m0, sum(CASE WHEN s = '1' THEN m ELSE 0 END) AS m1, sum(CASE WHEN s = '2' THEN m ELSE 0 END) AS m2,
             sum(CASE WHEN s = '0' THEN d ELSE 0 END) AS d0, sum(CASE WHEN s = '1' THEN d ELSE 0 END) AS d1, sum(CASE WHEN s = '2' THEN d ELSE 0 END) AS d2 FROM (
        SELECT smoker_cat3 AS s, round(entry_age, 9) AS t, 1 AS m, 0 AS d FROM spells
        UNION ALL SELECT smoker_cat3, round(exit_age, 9), -1, CAST(event_flag AS INTEGER) FROM spells) GROUP BY t)
    WINDOW u AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    WHERE d0 + d1 + d2 > 0 AND n0 > 0 AND n1 > 0 AND n2 > 0 AND n0 + n1 + n2 >= 6 WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)"""


def _add_part(term: str, k: int) -> str:
    return f"""SELECT '{term}' AS term, t AS time, round(b{k}, 6) + 0.0 AS coef, round(b{k} + 1.96::DOUBLE * sqrt(v{k}), 6) + 0.0 AS coef_up,
        round(b{k} - 1.96::DOUBLE * sqrt(v{k}), 6) + 0.0 AS coef_dn FROM inc"""


@query("additive_effects_factor", with_views(
    " UNION ALL ".join(_add_part(n, k) for k, n in enumerate(["Intercept", "smoker_cat31", "smoker_cat32"])), inc=_ADD))
def additive_effects_factor(spark, sf):
    """Additive hazards of one factor: the model is saturated, so rates per level give the same answer."""
    out = M.additive_effects(X.spells(spark, sf), M.design({"smoker_cat3": LEVELS["smoker_cat3"]}))
    return out.select("term", "time", *[r6(c, c) for c in ("coef", "coef_up", "coef_dn")])

"""Queries on several states and on several covariates that change with time."""

from __future__ import annotations

from pyspark.sql import functions as F

from spellwise.functions import age_at
from spellwise.operators import cox as M
from spellwise.operators import predict as R
from spellwise.operators import spells as S
from spellwise.operators import states as P
from spellwise.plans import fixtures as X
from spellwise.plans.oracle_views import age, with_views
from spellwise.plans.queries_models import level_grid
from spellwise.plans.queries_survival import r6
from spellwise.plans.registry import query

STATES = ["healthy", "illness A", "illness B", "dead"]
LEADS_TO = {"ILL1_A": "illness A", "ILL1_B": "illness B", "DEATH": "dead"}
_LEADS = "CASE event " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in LEADS_TO.items()) + " END"

_STAYS = f"""
    SELECT id, sex, state, greatest({age('birth_date', 't1')}, 50) AS entry_age, {age('birth_date', 't2')} AS exit_age,
           CASE WHEN NOT cut AND dest IS DISTINCT FROM state THEN dest END AS to_state FROM (
      SELECT i.*, coalesce(state, 'healthy') AS state, greatest(coalesce(t1, DATE '1995-01-01'), DATE '1995-01-01') AS t1,
             t2 IS NULL OR t2 >= DATE '1998-01-01' AS cut, least(coalesce(t2, DATE '1998-01-01'), DATE '1998-01-01') AS t2, dest
      FROM individuals i LEFT JOIN (
        SELECT id, coalesce(lag(dest) OVER o, 'healthy') AS state, lag(date_event) OVER o AS t1, date_event AS t2, dest FROM (
          SELECT *, min(CASE WHEN dest IS NULL OR dest = 'dead' THEN date_event END) OVER (PARTITION BY id) AS done FROM (
            SELECT id, date_event, {_LEADS} AS dest, row_number() OVER (PARTITION BY id, date_event ORDER BY src DESC, event DESC) AS rn
            FROM event_log WHERE event IN ('ILL1_A', 'ILL1_B', 'DEATH', 'LOST')) WHERE rn = 1)
        WHERE done IS NULL OR date_event <= done WINDOW o AS (PARTITION BY id ORDER BY date_event)) e ON e.id = i.id)
    WHERE t1 < t2 AND greatest({age('birth_date', 't1')}, 50) < {age('birth_date', 't2')}"""
_AT = ", ".join(f"sum(CASE WHEN state = '{s}' THEN net ELSE 0 END) AS y{i}" for i, s in enumerate(STATES))
_MOVES = [(i, j) for i in range(4) for j in range(4) if i != j]
_D = ", ".join(f"sum(CASE WHEN state = '{STATES[i]}' AND dest = '{STATES[j]}' THEN 1 ELSE 0 END)::DOUBLE AS d{i}_{j}" for i, j in _MOVES)
_PATH = f"""
    SELECT *, row_number() OVER (PARTITION BY sex ORDER BY t) AS k FROM (
      SELECT *, {', '.join(f'(sum(y{i}) OVER o)::DOUBLE AS n{i}' for i in range(4))} FROM (
        SELECT sex, t, sum(leaves) AS leaves, {_AT}, {_D} FROM (
          SELECT sex, state, round(entry_age, 9) AS t, 1 AS net, 0 AS leaves, NULL AS dest FROM stays
          UNION ALL SELECT sex, state, round(exit_age, 9), -1, 1, to_state FROM stays) GROUP BY sex, t)
      WINDOW o AS (PARTITION BY sex ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE leaves > 0"""
_rate = lambda i, j: f"CASE WHEN n{i} > 0 THEN d{i}_{j} / n{i} ELSE 0 END"
_next = lambda j: " ".join([
    f"p{j}", *[f"+ p{i} * {_rate(i, j)}" for i in range(4) if i != j], *[f"- p{j} * {_rate(j, i)}" for i in range(4) if i != j]])
_RISE = f"""
    SELECT sex, 0::BIGINT AS k, 1::DOUBLE AS p0, 0::DOUBLE AS p1, 0::DOUBLE AS p2, 0::DOUBLE AS p3 FROM (SELECT DISTINCT sex FROM path)
    UNION ALL SELECT q.sex, q.k, {', '.join(f'{_next(j)} AS p{j}' for j in range(4))} FROM rise JOIN path q ON q.sex = rise.sex AND q.k = rise.k + 1"""
_OUT = {i: " + ".join(f"d{i}_{j}" for j in range(4) if j != i) for i in range(4)}


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("state_pieces", with_views("""
    SELECT id, state, round(entry_age, 6) AS entry_age, round(exit_age, 6) AS exit_age, to_state FROM stays""", stays=_STAYS))
def state_pieces(spark, sf):
    """Stays in health, either illness, and the moves between them and to death."""
    return pieces(spark, sf).select("id", "state", r6("entry_age", "entry_age"), r6("exit_age", "exit_age"), "to_state")


def pieces(spark, sf):
    return P.state_pieces(
        X.event_log(spark, sf), X.individuals(spark, sf), LEADS_TO, initial="healthy", terminal=["dead"], censor=["LOST"],
        start=X.START, end=X.END, min_age=50, tie=["src"])


@query("state_probabilities", _recursive(with_views(
    f"""WITH rise AS ({_RISE})
    """ + " UNION ALL ".join(f"""SELECT q.sex, t AS time, '{s}' AS state, CAST(n{i} AS BIGINT) AS n_risk, CAST({_OUT[i]} AS BIGINT) AS n_event,
      round(p{i}, 6) + 0.0 AS pstate FROM rise r JOIN path q ON q.sex = r.sex AND q.k = r.k""" for i, s in enumerate(STATES)),
    stays=_STAYS, path=_PATH)))
def state_probabilities(spark, sf):
    """Probability of each state by age and sex, illnesses being left for each other and for death."""
    out = P.state_probabilities(pieces(spark, sf), STATES, ["sex"], initial="healthy")
    return out.select("sex", "time", "state", F.col("n_risk").cast("long").alias("n_risk"), F.col("n_event").cast("long").alias("n_event"), r6("pstate", "pstate"))


# The effects on each move, shared with the oracle.
MOVES = {
    ("healthy", "illness A"): {"sexM": 0.3, "smoker_cat32": 0.4}, ("healthy", "illness B"): {"sexM": 0.1, "smoker_cat31": -0.2},
    ("healthy", "dead"): {"sexM": 0.5, "smoker_cat32": 0.6}, ("illness A", "illness B"): {"smoker_cat31": 0.2, "smoker_cat32": 0.3},
    ("illness A", "dead"): {"sexM": 0.2}, ("illness B", "illness A"): {"sexM": -0.1}, ("illness B", "dead"): {"smoker_cat32": 0.5},
}
_WHO = ["sex", "smoker_cat3"]


def _lp_sql(beta) -> str:
    tests = {"sexM": "sex = 'M'", "smoker_cat31": "smoker_cat3 = '1'", "smoker_cat32": "smoker_cat3 = '2'"}
    return " + ".join(f"{v}::DOUBLE * CAST({tests[k]} AS INTEGER)" for k, v in beta.items())


def _move_views() -> dict[str, str]:
    """Increments of each move's hazard (Efron), their factor per profile, and the matrices' entries per time."""
    views, parts = {}, []
    for k, ((a, b), beta) in enumerate(MOVES.items()):
        views[f"mv{k}"] = f"""SELECT t, sum(1 / (s0 - CAST(l AS DOUBLE) / d * e0)) AS dh FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM (
          SELECT *, sum(n0) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s0 FROM (
            SELECT t, sum(net * w) AS n0, sum(d) AS d, sum(d * w) AS e0 FROM (
              SELECT round(entry_age, 9) AS t, 1 AS net, 0 AS d, exp({_lp_sql(beta)}) AS w FROM fullstays WHERE state = '{a}'
              UNION ALL SELECT round(exit_age, 9), -1, CASE WHEN to_state = '{b}' THEN 1 ELSE 0 END, exp({_lp_sql(beta)}) FROM fullstays WHERE state = '{a}')
            GROUP BY t)) WHERE d > 0) GROUP BY t"""
        i, j = STATES.index(a), STATES.index(b)
        parts.append(f"SELECT sex, smoker_cat3, t, '{i}_{j}' AS mv, dh * exp({_lp_sql(beta)}) AS a FROM mv{k}, grid")
    views["grid"] = "SELECT * FROM (VALUES ('F'), ('M')) AS v(sex), (VALUES ('0'), ('1'), ('2')) AS w(smoker_cat3)"
    views["fullstays"] = _STAYS.replace("SELECT id, sex, state,", "SELECT id, sex, smoker_cat3, state,")
    sums = ", ".join(f"sum(CASE WHEN mv = '{i}_{j}' THEN a ELSE 0 END) AS a{i}_{j}" for i, j in _MOVES)
    out = ", ".join(f"{' + '.join(f'a{i}_{j}' for j in range(4) if j != i)} AS o{i}" for i in range(4))
    views["mpath"] = f"""SELECT *, row_number() OVER (PARTITION BY sex, smoker_cat3 ORDER BY t) AS k FROM (SELECT *, {out} FROM (
      SELECT sex, smoker_cat3, t, {sums} FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL))"""
    return views


_gain = lambda i, j: f"CASE WHEN o{i} > 0 THEN (1 - exp(-o{i})) * a{i}_{j} / o{i} ELSE 0 END"
_MRISE = f"""
    SELECT sex, smoker_cat3, 0::BIGINT AS k, 1::DOUBLE AS p0, 0::DOUBLE AS p1, 0::DOUBLE AS p2, 0::DOUBLE AS p3 FROM grid
    UNION ALL SELECT q.sex, q.smoker_cat3, q.k, {', '.join(f"p{j} * exp(-o{j}) + " + " + ".join(f"p{i} * {_gain(i, j)}" for i in range(4) if i != j) + f" AS p{j}" for j in range(4))}
    FROM mrise JOIN mpath q ON q.sex = mrise.sex AND q.smoker_cat3 = mrise.smoker_cat3 AND q.k = mrise.k + 1"""


@query("profile_state_probabilities", _recursive(with_views(
    f"""WITH mrise AS ({_MRISE})
    """ + " UNION ALL ".join(f"""SELECT q.sex, q.smoker_cat3, t AS time, '{s}' AS state, round(p{i}, 6) + 0.0 AS pstate
      FROM mrise r JOIN mpath q ON q.sex = r.sex AND q.smoker_cat3 = r.smoker_cat3 AND q.k = r.k""" for i, s in enumerate(STATES)),
    **_move_views())))
def profile_state_probabilities(spark, sf):
    """Probability of each state per profile, every move with hazards of its own model."""
    stays = pieces(spark, sf)
    d = M.design({"sex": ["F", "M"], "smoker_cat3": ["0", "1", "2"]})
    lps = {move: R.linear_predictor(M.given_model(d, beta)) for move, beta in MOVES.items()}
    bases = R.baseline_hazards(
        stays, lps, at={(a, b): F.col("state") == a for a, b in lps}, event={(a, b): F.coalesce(F.col("to_state") == b, F.lit(False)) for a, b in lps},
        ties="efron")
    out = P.profile_state_probabilities(bases, lps, level_grid(spark, {"sex": ["F", "M"], "smoker_cat3": ["0", "1", "2"]}), _WHO, STATES, initial="healthy")
    return out.select(*_WHO, "time", "state", r6("pstate", "pstate"))


_CHANGES = f"""
    SELECT e.id, {age('birth_date', 'date_event')} AS t, CASE event WHEN 'ILL0_C' THEN 'other' ELSE 'care' END AS covariate,
           CAST(CASE event WHEN 'ILL0_C' THEN 1 ELSE src % 3 END AS INTEGER) AS v
    FROM event_log e JOIN individuals i ON i.id = e.id WHERE event IN ('ILL0_C', 'NO_ILLNESS')"""
_MARKS = """
    SELECT id, t, max(s) AS s, max(o) AS o, max(c) AS c FROM (
      SELECT id, entry_age AS t, entry_age AS s, NULL AS o, NULL AS c FROM spells WHERE entry_age < exit_age
      UNION ALL SELECT id, exit_age, NULL, NULL, NULL FROM spells WHERE entry_age < exit_age
      UNION ALL SELECT id, t, NULL, CASE WHEN covariate = 'other' THEN v END, CASE WHEN covariate = 'care' THEN v END FROM changes)
    GROUP BY id, t"""


@query("time_varying_merge_many", with_views("""
    SELECT m.id, round(t, 6) AS entry_age, round(t2, 6) AS exit_age, event_flag AND t2 = exit_age AS event_flag, coalesce(o, 0) AS other, coalesce(c, 0) AS care
    FROM (SELECT id, t, lead(t) OVER w AS t2, last_value(o IGNORE NULLS) OVER w AS o, last_value(c IGNORE NULLS) OVER w AS c
          FROM marks WINDOW w AS (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING)) m
    JOIN spells s ON s.id = m.id AND t >= entry_age AND t2 <= exit_age""", changes=_CHANGES, marks=_MARKS))
def time_varying_merge_many(spark, sf):
    """Spells cut at every change of two covariates: another illness (stays on) and the last kind of care (goes back and forth)."""
    kind = F.when(F.col("event") == "ILL0_C", "other").otherwise("care")
    value = F.when(F.col("event") == "ILL0_C", F.lit(1)).otherwise((F.col("src") % 3).cast("int"))
    log = X.event_log(spark, sf).filter(F.col("event").isin("ILL0_C", "NO_ILLNESS")).join(X.individuals(spark, sf).select("id", "birth_date"), "id")
    changes = log.select("id", age_at("birth_date", "date_event").alias("age_event"), kind.alias("covariate"), value.alias("value"))
    out = S.time_varying_merge_many(X.spells(spark, sf), changes, {"other": 0, "care": 0})
    return out.select("id", r6("entry_age", "entry_age"), r6("exit_age", "exit_age"), "event_flag", "other", "care")

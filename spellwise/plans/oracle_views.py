"""The fixture views once more, in SQL, for the oracle engine."""

from __future__ import annotations

import re


def anniversary(birth: str, years: str) -> str:
    return f"CAST({birth} + to_months(CAST(12 * ({years}) AS INTEGER)) AS DATE)"


def whole_age(birth: str, at: str) -> str:
    n0 = f"(year({at}) - year({birth}))"
    return f"({n0} - CASE WHEN {anniversary(birth, n0)} > {at} THEN 1 ELSE 0 END)"


def age(birth: str, at: str) -> str:
    n = whole_age(birth, at)
    last, nxt = anniversary(birth, n), anniversary(birth, f"{n} + 1")
    return (
        f"(CAST({n} AS DOUBLE) + CAST(date_diff('day', {last}, {at}) AS DOUBLE)"
        f" / date_diff('day', {last}, {nxt}))"
    )


HALF_DAY = "(CAST(1 AS DOUBLE) / CAST(730.5 AS DOUBLE))"


def uniform(keys: str, seed: int) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {keys}, '{seed}')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def spells_sql(start: str, end: str, src: str = "first_ill") -> str:
    return f"""
    SELECT *, {age('birth_date', 'entry_date')} AS entry_age,
           {age('birth_date', 'exit_date')} + {HALF_DAY} AS exit_age
    FROM (
      SELECT i.*, greatest(DATE '{start}', {anniversary('birth_date', '50')}) AS entry_date,
             least(date_event, DATE '{end}') AS exit_date, f.event,
             f.date_event, (CASE WHEN date_event < DATE '{end}' THEN event ELSE 'LOST' END) <> 'LOST' AS event_flag
      FROM individuals i JOIN (
        SELECT id, date_event, event FROM {src}
        WHERE event IN ('ILL', 'DEATH', 'LOST')
          AND id NOT IN (SELECT id FROM {src} WHERE date_event < DATE '{start}' AND event IN ('DEATH', 'LOST'))
      ) f ON i.id = f.id
    )"""


VIEWS: dict[str, str] = {
    "individuals": """
    SELECT *, DATE '1995-01-01' - CAST(round_even(CAST(365.25 AS DOUBLE) * age_ref, 0) AS INTEGER) AS birth_date FROM (
      SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
             CAST(45 AS DOUBLE) + CAST((c_custkey * 7919) % 4000 AS DOUBLE) / 100 AS age_ref,
             CAST((c_custkey // 3) % 3 AS VARCHAR) AS obesity_cat3,
             CAST((c_custkey // 9) % 3 AS VARCHAR) AS alcohol_cat3,
             CAST(c_custkey % 3 AS VARCHAR) AS smoker_cat3,
             CAST(c_nationkey AS VARCHAR) AS dep,
             CAST(c_custkey % 4 AS VARCHAR) AS immigration,
             CAST((c_custkey // 4) % 4 AS VARCHAR) AS diplome
      FROM customer)""",
    "event_log": """
    SELECT id, src, date_event, CAST(CASE
        WHEN rn = 1 AND status = 'F' THEN 'DEATH' WHEN rn = 1 THEN 'LOST'
        WHEN priority = '1-URGENT' THEN 'ILL1_A'
        WHEN priority = '2-HIGH' AND src % 4 = 0 THEN 'ILL1_B'
        WHEN priority = '3-MEDIUM' AND src % 10 = 0 THEN 'ILL0_C'
        ELSE 'NO_ILLNESS' END AS VARCHAR) AS event,
        CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS event_censor
    FROM (SELECT o_custkey AS id, o_orderkey AS src, CAST(o_orderdate AS DATE) AS date_event,
                 o_orderstatus AS status, o_orderpriority AS priority,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
          FROM orders)""",
    "first_ill": """
    SELECT id, src, date_event, event, event_censor FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY date_event, CASE WHEN event = 'ILL' THEN 0 ELSE 1 END, src, code) AS rn
      FROM (SELECT id, src, date_event, event AS code, event_censor,
                   CASE WHEN event IN ('ILL1_A', 'ILL1_B', 'DEATH') THEN 'ILL' ELSE event END AS event
            FROM event_log WHERE event <> 'NO_ILLNESS'))
    WHERE rn = 1""",
    "spells": f"SELECT * FROM ({spells_sql('1995-01-01', '1998-01-01')}) WHERE entry_date <= exit_date AND exit_age >= 50",
    "spells96": f"SELECT * FROM ({spells_sql('1996-01-01', '1998-01-01')}) WHERE entry_date <= exit_date AND exit_age >= 50",
    "durations": """
    SELECT o_orderpriority AS stratum,
           CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-01-01'), 0) AS INTEGER) AS entry,
           CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS exit,
           l_returnflag = 'R' AS event, l_returnflag AS cause, l_orderkey AS order_id, l_linenumber, l_linestatus,
           l_quantity, l_discount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE CAST(l_shipdate AS DATE) >= DATE '1997-01-01'
      AND greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-01-01'), 0)
          < date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))""",
    "corrections": """
    SELECT id, event, CAST(min(date_event) - 30 AS DATE) AS date_event FROM event_log
    WHERE event = 'ILL1_A' AND id % 10 = 0 GROUP BY id, event""",
    "contacts": """
    SELECT id, CAST(min(date_event) - 45 AS DATE) AS contact_date FROM event_log WHERE id % 10 = 0 GROUP BY id""",
    "imputed": """
    SELECT id, CAST((CAST(alcohol_cat3 AS INTEGER) + 1) % 3 AS VARCHAR) AS alcohol_cat3,
           CAST((CAST(smoker_cat3 AS INTEGER) + 1) % 3 AS VARCHAR) AS smoker_cat3
    FROM individuals WHERE id % 10 = 0""",
    "regions": """
    SELECT CAST(n_nationkey AS VARCHAR) AS dep, r_name AS region,
           CAST(1 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) / 10 AS estimate
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
}
# Curves by sex over the spells, used by several oracles.
VIEWS["km_times"] = """
    SELECT sex, t, sum(e) AS ent, sum(x) AS ext, sum(d) AS d FROM (
      SELECT sex, round(entry_age, 9) AS t, 1 AS e, 0 AS x, 0 AS d FROM spells
      UNION ALL
      SELECT sex, round(exit_age, 9), 0, 1, CAST(event_flag AS INTEGER) FROM spells)
    GROUP BY sex, t"""
VIEWS["km"] = """
    SELECT *, CASE WHEN dead_out THEN 0.0 ELSE exp(ls) END AS surv FROM (
      SELECT *, bool_or(d = n) OVER w AS dead_out,
        sum(CASE WHEN d < n THEN ln(CAST(1 AS DOUBLE) - CAST(d AS DOUBLE) / n) ELSE 0 END) OVER w AS ls,
        sum(CAST(d AS DOUBLE) / n) OVER w AS cumhaz,
        sum(CASE WHEN d < n THEN CAST(d AS DOUBLE) / (CAST(n AS DOUBLE) * (n - d)) END) OVER w AS gw
      FROM (SELECT *, sum(ent) OVER v - sum(ext) OVER v AS n FROM km_times
            WINDOW v AS (PARTITION BY sex ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      WHERE ext > 0
      WINDOW w AS (PARTITION BY sex ORDER BY t ROWS UNBOUNDED PRECEDING))"""


def with_views(body: str, **extra: str) -> str:
    """Prefix ``body`` with the views it names, in dependency order."""
    known = {**VIEWS, **extra}
    order: list[str] = []

    def visit(text: str, skip: str = "") -> None:
        for name in known:
            if name != skip and name not in order and re.search(rf"\b{name}\b", text):
                visit(known[name], name)
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

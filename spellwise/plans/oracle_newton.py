"""Newton's steps of a Cox model as a chain of views, for the oracle engine.

Each step sums the risk sets by a window over time, spreads tied failures with a series (Efron), and solves its few
equations by elimination, all in SQL. Models have two to five columns ``x1``, ``x2``, ... over a view of spells with
``a`` (entry), ``b`` (exit) and ``ev``.
"""

from __future__ import annotations

from collections.abc import Sequence

DBL = "::DOUBLE"


def eliminate(src: str, p: int, rhs: Sequence[str], carry: Sequence[str] = (), m: str = "m") -> str:
    """Solve ``M z = r`` for right sides ``r`` with columns ``m_1_1 ...`` and ``<r>_1 ...`` of ``src``; gives ``z_<r>_1 ...``.

    ``M`` is symmetric: only ``i <= j`` is read. Pivots stay in ``t_1_1``, ``t_2_2`` ...; at one that is not positive the results
    are NULL.
    """
    keep = "".join(f", {c}" for c in carry)
    cols = [f"{m}_{min(i, j)}_{max(i, j)} AS t_{i}_{j}" for i in range(1, p + 1) for j in range(1, p + 1)]
    cols += [f"{r}_{i} AS q_{r}_{i}" for r in rhs for i in range(1, p + 1)]
    sql = f"SELECT {', '.join(cols)}{keep} FROM ({src})"
    for k in range(1, p):
        cols = []
        for i in range(1, p + 1):
            f = f"(t_{i}_{k} / CASE WHEN t_{k}_{k} > 0 THEN t_{k}_{k} END)"
            for j in range(1, p + 1):
                cols.append(f"t_{i}_{j} - {f} * t_{k}_{j} AS t_{i}_{j}" if i > k else f"t_{i}_{j}")
            for r in rhs:
                cols.append(f"q_{r}_{i} - {f} * q_{r}_{k} AS q_{r}_{i}" if i > k else f"q_{r}_{i}")
        sql = f"SELECT {', '.join(cols)}{keep} FROM ({sql})"
    for i in range(p, 0, -1):
        cols = ["*"]
        for r in rhs:
            known = "".join(f" - t_{i}_{j} * z_{r}_{j}" for j in range(i + 1, p + 1))
            cols.append(f"(q_{r}_{i}{known}) / CASE WHEN t_{i}_{i} > 0 THEN t_{i}_{i} END AS z_{r}_{i}")
        sql = f"SELECT {', '.join(cols)} FROM ({sql})"
    return sql


def newton_views(name: str, data: str, p: int, steps: int = 9, ties: str = "efron") -> dict[str, str]:
    """Views ``<name>_b`` (b_1 ...: the solution) and ``<name>_v`` (v_i_j: its variance) for spells in the view ``data``."""
    idx = range(1, p + 1)
    pairs = [(i, j) for i in idx for j in idx if i <= j]
    xs = ", ".join(f"x{i}" for i in idx)
    views = {
        f"{name}_r": f"""SELECT round(a, 9) AS t, 1 AS net, 0 AS d, {xs} FROM {data} WHERE a < b
      UNION ALL SELECT round(b, 9), -1, CAST(ev AS INTEGER), {xs} FROM {data} WHERE a < b""",
        f"{name}_b0": "SELECT " + ", ".join(f"0{DBL} AS b_{i}" for i in idx),
    }
    for k in range(steps + 1):
        views[f"{name}_s{k}"] = pass_sql(f"{name}_r", f"{name}_b{k}", p, ties)
        rhs = eliminate(f"SELECT s.*, b.* FROM {name}_s{k} s, {name}_b{k} b", p, ["u"], [f"b_{i}" for i in idx])
        if k < steps:
            views[f"{name}_b{k + 1}"] = "SELECT " + ", ".join(f"b_{i} + z_u_{i} AS b_{i}" for i in idx) + f" FROM ({rhs})"
    views[f"{name}_b"] = f"SELECT * FROM {name}_b{steps}"
    unit = ", ".join(f"{int(i == j)}{DBL} AS e{j}_{i}" for j in idx for i in idx)
    inverse = eliminate(f"SELECT *, {unit} FROM {name}_s{steps}", p, [f"e{j}" for j in idx])
    views[f"{name}_v"] = "SELECT " + ", ".join(f"z_e{j}_{i} AS v_{i}_{j}" for i, j in pairs) + f" FROM ({inverse})"
    return views


def pass_sql(rows: str, beta: str, p: int, ties: str = "efron", g: str | None = None) -> str:
    """One row: ll, u_i, m_i_j at ``beta``; with a view ``g`` (t, g) also u1_i, m1_i_j, m2_i_j, weighted with g and g squared."""
    idx = range(1, p + 1)
    pairs = [(i, j) for i in idx for j in idx if i <= j]
    lp = " + ".join(f"b_{i} * x{i}" for i in idx)
    w = f"exp({lp})"
    sums = [f"sum(net * {w}) AS n0", "sum(d) AS d", f"sum(d * {w}) AS e0", f"sum(d * ({lp})) AS sl"]
    sums += [f"sum(net * {w} * x{i}) AS n_{i}, sum(d * {w} * x{i}) AS e_{i}, sum(d * x{i}) AS sx_{i}" for i in idx]
    sums += [f"sum(net * {w} * x{i} * x{j}) AS n_{i}_{j}, sum(d * {w} * x{i} * x{j}) AS e_{i}_{j}" for i, j in pairs]
    over = ", ".join(f"sum(n{c}) OVER o AS s{c}" for c in ["0", *[f"_{i}" for i in idx], *[f"_{i}_{j}" for i, j in pairs]])
    c = "0" + DBL if ties == "breslow" else f"(CAST(l AS DOUBLE) / d)"
    q = ", ".join(f"s{k} - {c} * e{k} AS q{k}" for k in ["0", *[f"_{i}" for i in idx], *[f"_{i}_{j}" for i, j in pairs]])
    cov = {(i, j): f"q_{i}_{j} / q0 - q_{i} * q_{j} / (q0 * q0)" for i, j in pairs}
    out = ["sum(CASE WHEN l = 0 THEN sl ELSE 0 END - ln(q0)) AS ll"]
    for a, weight in (("", "1" + DBL), ("1", "g"), ("2", "g * g")) if g else (("", "1" + DBL),):
        out += [f"sum({weight} * (CASE WHEN l = 0 THEN sx_{i} ELSE 0 END - q_{i} / q0)) AS u{a}_{i}" for i in idx]
        out += [f"sum({weight} * ({cov[i, j]})) AS m{a}_{i}_{j}" for i, j in pairs]
    join = f"JOIN {g} USING (t)" if g else ""
    return f"""SELECT {', '.join(out)} FROM (
      SELECT *, {q} FROM (
        SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM (
          SELECT *, {over} FROM (SELECT t, {', '.join(sums)} FROM {rows}, {beta} GROUP BY t)
          WINDOW o AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) {join}
        WHERE d > 0))"""


def erfc(x: str) -> str:
    """Complementary error function by Simpson's rule, to about 12 digits (0 beyond 6)."""
    n = 1200
    h = f"(({x}) / {n})"
    weights = f"CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, {n + 1}), lambda i: ({weights}) * exp(-({h} * i) * ({h} * i)))) * {h} / 3"
    return f"CASE WHEN ({x}) > 6 THEN 0{DBL} ELSE greatest(1{DBL} - 1.1283791670955126{DBL} * ({area}), 0{DBL}) END"


def tidy_sql(name: str, terms: Sequence[str], aliased: Sequence[str] = (), extra: str = "") -> str:
    """Rows of the tidy fit of ``newton_views(name, ...)``: hazard ratios with limits, rounded to six digits."""
    r = lambda e, c: f"round({e}, 6) + 0.0{DBL} AS {c}"
    parts = []
    for i, t in enumerate(terms, start=1):
        parts.append(f"""SELECT '{t}' AS term, {r('exp(b)', 'estimate')}, {r('se', 'std_error')}, {r('b / se', 'statistic')},
          {r(erfc('abs(b / se) / 1.4142135623730951' + DBL), 'p_value')}, {r('exp(b - z * se)', 'conf_low')}, {r('exp(b + z * se)', 'conf_high')},
          true AS converged{extra} FROM (SELECT b_{i} AS b, sqrt(v_{i}_{i}) AS se, 1.959963984540054{DBL} AS z FROM {name}_b, {name}_v)""")
    none = f"CAST(NULL AS DOUBLE)"
    parts += [f"SELECT '{t}', {', '.join([none] * 6)}, true{extra}" for t in aliased]
    return "\nUNION ALL ".join(parts)

"""Cox family against direct computation on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spellwise.functions.splines import natural_spline
from spellwise.operators import cox as M
from spellwise.operators import curves as C
from spellwise.operators import predict as R
from spellwise.operators import spells as S

LEVELS = {"sex": ["F", "M"], "smoke": ["0", "1", "2"]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 250
    sex, smoke = rng.choice(["F", "M"], n), rng.choice(["0", "1", "2"], n)
    entry = 50 + rng.integers(0, 10, n)
    span = np.ceil(12 * rng.exponential(1, n) * np.exp(-0.4 * (sex == "M") - 0.5 * (smoke == "2")))
    exit_, event = entry + np.minimum(span, 15), span < 15
    rows = [(i, str(a), str(b), float(s), float(t), bool(e)) for i, (a, b, s, t, e) in enumerate(zip(sex, smoke, entry, exit_, event))]
    df = spark.createDataFrame(rows, "id int, sex string, smoke string, entry_age double, exit_age double, event_flag boolean")
    x = np.column_stack([sex == "M", smoke == "1", smoke == "2"]).astype(float)
    return df, entry.astype(float), exit_.astype(float), event, x


def brute(entry, exit_, event, x, efron, beta=None, steps=12):
    b = np.zeros(x.shape[1]) if beta is None else np.array(beta, float)
    for _ in range(steps):
        u, info, ll, w = np.zeros_like(b), np.zeros((len(b), len(b))), 0.0, np.exp(x @ b)
        for t in np.unique(exit_[event]):
            at, dead = (entry < t) & (exit_ >= t), (exit_ == t) & event
            ll += (x[dead] @ b).sum()
            u += x[dead].sum(0)
            for k in range(dead.sum()):
                c = k / dead.sum() if efron else 0.0
                ww = np.where(at, w, 0) - c * np.where(dead, w, 0)
                s0, s1 = ww.sum(), ww @ x
                ll -= np.log(s0)
                u -= s1 / s0
                info += x.T @ (ww[:, None] * x) / s0 - np.outer(s1, s1) / s0**2
        if beta is not None:
            return ll, u, info
        b = b + np.linalg.solve(info, u)
    return b, ll, np.linalg.inv(info)


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_fit_matches_newton_on_dense_data(data, ties):
    df, en, ex, ev, x = data
    fit = M.cox_fit(df, M.design(LEVELS), ties=ties, cell_width=2.0)
    b, ll, v = brute(en, ex, ev, x, ties == "efron")
    assert np.allclose(fit.coef, b, atol=1e-6) and fit.loglik[1] == pytest.approx(ll)
    assert np.allclose(fit.vcov, v, atol=1e-7)
    assert (fit.n, fit.n_event) == (250, int(ev.sum())) and np.allclose(fit.means, x.mean(0))


def test_score_and_information_away_from_zero(data):
    df, en, ex, ev, x = data
    beta = np.array([0.3, -0.2, 0.5])
    ll, u, info = M.cox_pass(M.risk_table(df, M.design(LEVELS), cell_width=1.0), beta, ties="efron")
    ll2, u2, info2 = brute(en, ex, ev, x, True, beta)
    assert ll == pytest.approx(ll2) and np.allclose(u, u2) and np.allclose(info, info2)


def test_split_data_gives_the_same_fit(data):
    df = data[0]
    d = M.design(LEVELS)
    a = M.cox_fit(df, d, cell_width=2.0)
    b = M.cox_fit(S.interval_split(df, [52, 55, 58, 63]), d, cell_width=2.0)
    assert np.allclose(a.coef, b.coef, atol=1e-6) and np.allclose(a.vcov, b.vcov, atol=1e-7)


def test_redundant_columns_are_left_out(data):
    df = data[0].withColumn("twin", F.col("sex"))
    fit = M.cox_fit(df, M.design({**LEVELS, "twin": ["F", "M"]}), cell_width=2.0)
    assert np.isnan(fit.coef[-1]) and not np.isnan(fit.coef[:-1]).any()
    rows = {r["term"]: r for r in M.tidy_fit(fit, df.sparkSession).collect()}
    assert rows["twinM"]["estimate"] is None
    assert rows["sexM"]["estimate"] == pytest.approx(np.exp(fit.coef[0]))
    assert rows["sexM"]["conf_low"] < rows["sexM"]["estimate"] < rows["sexM"]["conf_high"]


def test_ph_test_is_the_score_test_of_added_time_effects(data):
    df, en, ex, ev, x = data
    d = M.design(LEVELS)
    fit = M.cox_fit(df, d, ties="breslow", cell_width=2.0)
    got = {n: (c, k) for n, c, k in M.ph_test(df, fit, transform="identity", cell_width=2.0)}
    b = fit.coef
    w = np.exp(x @ b)
    u, i0, i1, i2 = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 3)), np.zeros((3, 3))
    for t in np.unique(ex[ev]):
        at, dead = (en < t) & (ex >= t), (ex == t) & ev
        s0, s1 = w[at].sum(), w[at] @ x[at]
        v = dead.sum() * (x[at].T @ (w[at][:, None] * x[at]) / s0 - np.outer(s1, s1) / s0**2)
        u += t * (x[dead].sum(0) - dead.sum() * s1 / s0)
        i0, i1, i2 = i0 + v, i1 + t * v, i2 + t * t * v
    v = i2 - i1 @ np.linalg.solve(i0, i1)
    assert got["GLOBAL"][0] == pytest.approx(u @ np.linalg.solve(v, u), rel=1e-5) and got["GLOBAL"][1] == 3
    assert got["sex"][0] == pytest.approx(u[0] ** 2 / v[0, 0], rel=1e-5)
    assert got["smoke"][0] == pytest.approx(u[1:] @ np.linalg.solve(v[1:, 1:], u[1:]), rel=1e-5)


@pytest.mark.parametrize("transform", ["identity", "log", "km", "rank"])
def test_time_transforms(data, transform):
    df, en, ex, ev, _ = data
    risk = M.risk_table(df, M.design(LEVELS), cell_width=2.0)
    got = {r["time"]: r["g"] for r in M.time_transform(risk, transform).collect()}
    s, upto = 1.0, 0
    for t in np.unique(ex[ev]):
        dead = int(((ex == t) & ev).sum())
        want = {"identity": t, "log": np.log(t), "km": 1 - s, "rank": upto + (dead + 1) / 2}[transform]
        assert got[t] == pytest.approx(want)
        s *= 1 - dead / ((en < t) & (ex >= t)).sum()
        upto += dead


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_baseline_and_expected(data, ties):
    df, en, ex, ev, x = data
    d = M.design(LEVELS)
    m = M.given_model(d, {"sexM": 0.3, "smoke2": 0.4})
    lp = x @ np.array([0.3, 0.0, 0.4])
    w = np.exp(lp)
    base = R.baseline_hazard(df, R.linear_predictor(m), ties=ties, cell_width=2.0)
    got = {r["time"]: r["cumhaz"] for r in base.collect()}
    h, curve = 0.0, {}
    for t in np.unique(ex):
        at, dead = (en < t) & (ex >= t), (ex == t) & ev
        k = dead.sum()
        for j in range(k):
            h += 1 / (w[at].sum() - (j / k * w[dead].sum() if ties == "efron" else 0))
        curve[t] = h
    assert got.keys() == curve.keys() and all(got[t] == pytest.approx(curve[t]) for t in curve)
    out = R.predict(df, m, "expected", baseline=base, entry="entry_age").orderBy("id").collect()
    at = lambda q: max([v for t, v in curve.items() if t <= q], default=0.0)
    want = [(at(b) - at(a)) * r for a, b, r in zip(en, ex, w)]
    assert np.allclose([r["fit"] for r in out], want)
    if ties == "breslow":
        assert sum(want) == pytest.approx(ev.sum())  # martingale residuals sum to zero


def test_prediction_errors_and_terms(data):
    df, *_, x = data
    v = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    d = M.design(LEVELS)
    m = M.given_model(d, {"sexM": 0.3, "smoke1": -0.1, "smoke2": 0.4}, v)
    b = np.array([0.3, -0.1, 0.4])
    out = R.predict(df, m, "risk", se=True).orderBy("id").toPandas()
    assert np.allclose(out["fit"], np.exp(x @ b))
    assert np.allclose(out["se_fit"], np.sqrt(np.einsum("ij,jk,ik->i", x, v, x)) * np.sqrt(np.exp(x @ b)))
    m.means = x.mean(0)
    out = R.predict(df, m, "lp", reference="sample", se=True).orderBy("id").toPandas()
    c = x - x.mean(0)
    assert np.allclose(out["fit"], c @ b) and np.allclose(out["se_fit"], np.sqrt(np.einsum("ij,jk,ik->i", c, v, c)))
    t = R.predict(df, m, "terms").orderBy("id").toPandas()
    assert np.allclose(t["fit_sex"] + t["fit_smoke"], x @ b)
    s = R.collapse(R.predict(df, m, "lp", se=True), "sex", "fit", "se_fit").collect()
    assert len(s) == 2


@pytest.mark.parametrize("written_out", [0, 400])
def test_errors_stay_on_the_engine(data, monkeypatch, written_out):
    df, *_, x = data
    monkeypatch.setattr(R, "WRITTEN_OUT", written_out)
    a = np.random.default_rng(1).normal(size=(3, 3))
    v = a @ a.T
    v[1] = v[:, 1] = 0.0  # an aliased column
    out = R.predict(df, M.given_model(M.design(LEVELS), {"sexM": 1.0}, v), "lp", se=True).orderBy("id")
    assert np.allclose(out.toPandas()["se_fit"], np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, v, x), 0)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_concordance_counts_every_pair_once(data):
    df, en, ex, ev, _ = data
    rng = np.random.default_rng(2)
    score = rng.integers(0, 23, len(en)) / 10.0
    sdf = df.join(df.sparkSession.createDataFrame([(i, float(s)) for i, s in enumerate(score)], "id int, lp double"), "id")
    r = R.concordance(sdf, "lp", cell_width=2.0, score_cell=0.5).first()
    conc = disc = tied = 0
    for i in np.flatnonzero(ev):
        later = (en < ex[i]) & ((ex > ex[i]) | ((ex == ex[i]) & ~ev))
        conc += (score[later] < score[i]).sum()
        disc += (score[later] > score[i]).sum()
        tied += (score[later] == score[i]).sum()
    assert (r["concordant"], r["discordant"], r["tied_score"]) == (conc, disc, tied)
    assert r["concordance"] == pytest.approx((conc + tied / 2) / (conc + disc + tied))


def test_additive_effects(data):
    df, en, ex, ev, x = data
    out = M.additive_effects(df, M.design(LEVELS), cell_width=2.0).toPandas()
    xx = np.column_stack([np.ones(len(x)), x])
    cum, var = np.zeros(4), np.zeros(4)
    for t in np.unique(ex[ev]):
        at, dead = (en < t) & (ex >= t), (ex == t) & ev
        if at.sum() < 9:
            continue
        inv = np.linalg.inv(xx[at].T @ xx[at])
        step = xx[dead] @ inv
        cum, var = cum + step.sum(0), var + (step**2).sum(0)
        now = out[out["time"] == t].set_index("term")
        assert np.allclose(now.loc[["Intercept", "sexM", "smoke1", "smoke2"], "coef"], cum)
        assert np.allclose(now.loc["sexM", "coef_up"], cum[1] + 1.96 * np.sqrt(var[1]))


def test_spline_is_one_at_its_knot_and_straight_outside(spark):
    knots = [1.0, 4.0, 9.0, 20.0]
    b = natural_spline("x", knots)
    df = spark.createDataFrame([(float(v),) for v in [*knots, -2, -1, 0, 21, 22, 23, 6.5]], "x double")
    rows = {r["x"]: np.array([r[f"s{i}"] for i in range(3)]) for r in df.select("x", *[c.alias(f"s{i}") for i, c in enumerate(b)]).collect()}
    for j, k in enumerate(knots):
        assert np.allclose(rows[k], np.eye(4)[j][1:])
    assert np.allclose(rows[-2.0] - 2 * rows[-1.0] + rows[0.0], 0) and np.allclose(rows[21.0] - 2 * rows[22.0] + rows[23.0], 0)
    assert abs(rows[6.5].sum()) > 0


def test_curve_invariants(spark):
    rows = [(float(t),) for t in (1, 2, 2, 3, 5, 8, 8, 8, 9, 10)]
    df = spark.createDataFrame(rows, "exit_age double").selectExpr("0D AS entry_age", "exit_age", "true AS event_flag", "if(exit_age % 2 = 0, 'A', 'B') AS cause")
    c = C.km(df, cell_width=2.0).orderBy("time").collect()
    for r in c:  # without censoring the curve is the empirical survivor function
        assert r["surv"] == pytest.approx(sum(t[0] > r["time"] for t in rows) / 10)
    assert c[-1]["surv"] == 0.0 and c[-1]["std_err"] is None and c[-1]["upper"] is None
    full = C.residual_expectancy(C.km(df, cell_width=2.0), [0.5]).first()["expectancy"]
    assert full == pytest.approx(np.mean([t[0] for t in rows]))
    s = C.competing_curves(df, causes=["A", "B"], cell_width=2.0).groupBy("time").agg(F.sum("pstate").alias("p")).collect()
    assert all(r["p"] == pytest.approx(1.0) for r in s)


def test_cause_specific_probabilities_sum_to_one(data):
    df = data[0].withColumn("cause", F.when(~F.col("event_flag"), "none").when(F.col("id") % 2 == 0, "A").otherwise("B"))
    d = M.design({"sex": ["F", "M"]})
    fits = {k: M.cox_fit(df, d, event=F.col("cause") == k, cell_width=2.0) for k in "AB"}
    lps = {k: R.linear_predictor(f) for k, f in fits.items()}
    bases = {k: R.baseline_hazard(df, lps[k], ties="efron", event=F.col("cause") == k, cell_width=2.0) for k in fits}
    out = R.cause_specific_curves(bases, lps, df.select("sex").distinct(), ["sex"], cell_width=2.0).collect()
    assert out and all(r["surv"] + r["cif_A"] + r["cif_B"] == pytest.approx(1.0) for r in out)


def test_parse_transition(spark):
    df = spark.createDataFrame([("1.2", 0.5)], "transition string, cumhaz double")
    r = C.parse_transition(df, ["healthy", "ill"]).first()
    assert (r["from"], r["to"]) == ("healthy", "ill")

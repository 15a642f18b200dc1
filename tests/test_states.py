"""Several states, and several covariates that change, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spellwise.operators import curves as C
from spellwise.operators import spells as S
from spellwise.operators import states as P


def stays(seed=3, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t, state = float(rng.randint(0, 3)), rng.choice("HHHA")
        while t < 12 and state != "D":
            stop = t + rng.randint(1, 5)
            to = rng.choice([None, "A", "B", "D", "H"])
            to = None if to == state or stop >= 12 else to
            rows.append((i, rng.choice(["x", "y"]) if not rows or rows[-1][0] != i else rows[-1][1], state, t, float(min(stop, 12)), to))
            if to is None:
                break
            t, state = stop, to
    return rows


def plain(rows, states, initial):
    out, p = {}, np.array([float(s == initial) for s in states])
    for t in sorted({r[4] for r in rows}):
        a = np.eye(len(states))
        for i, s in enumerate(states):
            at = [r for r in rows if r[2] == s and r[3] < t <= r[4]]
            for j, d in enumerate(states):
                k = sum(r[4] == t and r[5] == d for r in at)
                if i != j and k:
                    a[i, j] += k / len(at)
                    a[i, i] -= k / len(at)
        p = p @ a
        out[t] = p
    return out


@pytest.mark.parametrize("width", [0.25, 4.0, 100.0])
def test_probabilities_equal_the_plain_product(spark, width):
    rows, states = stays(), ["H", "A", "B", "D"]
    odd = [(900, "x", None, 0.0, 5.0, "A"), (901, "x", "Z", 0.0, 5.0, "A"), (902, "y", "H", 5.0, 5.0, "A"), (903, None, "H", 1.0, 4.0, "A")]
    df = spark.createDataFrame(rows + odd, "id int, g string, state string, entry_age double, exit_age double, to_state string")
    got = P.state_probabilities(df.withColumn("time", F.lit(1)).filter("g is not null"), states, ["g"], initial="H", cell_width=width).collect()
    for g in "xy":
        want = plain([r for r in rows if r[1] == g], states, "H")
        mine = {(r["time"], r["state"]): r["pstate"] for r in got if r["g"] == g}
        assert {t for t, _ in mine} == set(want)
        for t, p in want.items():
            assert np.allclose([mine[t, s] for s in states], p) and sum(p) == pytest.approx(1.0)
    whole = P.state_probabilities(df, states, initial="H", cell_width=width).groupBy("time").agg(F.sum("pstate").alias("p")).collect()
    assert whole and all(r["p"] == pytest.approx(1.0) for r in whole)
    assert P.state_probabilities(df.limit(0), states, initial="H").count() == 0


def test_one_exit_is_the_cumulative_incidence(spark):
    rng = random.Random(8)
    rows = [(float(a), float(a + rng.randint(1, 9)), rng.choice(["A", "D", None])) for a in [rng.randint(0, 4) for _ in range(150)]]
    df = spark.createDataFrame(rows, "entry_age double, exit_age double, cause string").withColumn("state", F.lit("H"))
    want = {(r["time"], r["state"]): r["pstate"] for r in C.competing_curves(df, causes=["A", "D"], initial="H", cell_width=2.0).collect()}
    got = {(r["time"], r["state"]): r["pstate"] for r in P.state_probabilities(df, ["H", "A", "D"], initial="H", to="cause", cell_width=2.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_pieces_of_a_path(spark):
    people = spark.createDataFrame([(i,) for i in range(1, 7)], "id int").withColumn("birth_date", F.lit("1940-01-01").cast("date"))
    log = spark.createDataFrame([
        (1, "2000-01-01", "a"), (1, "2001-01-01", "note"), (1, "2002-01-01", "b"), (1, "2003-01-01", "dead"), (1, "2004-01-01", "a"),
        (2, "2000-01-01", "lost"), (3, "1990-01-01", "a"), (3, "2030-01-01", "b"), (4, "2000-01-01", "a"), (4, "2000-01-01", "b"),
        (5, "1990-01-01", "dead"),
    ], "id int, d string, event string").withColumn("date_event", F.to_date("d"))
    out = P.state_pieces(log, people, {"a": "A", "b": "B", "dead": "D"}, initial="H", terminal=["D"], censor=["lost"], start="1995-01-01", end="2010-01-01")
    got = {i: [] for i in range(1, 7)}
    for r in out.orderBy("id", "entry_age").collect():
        got[r["id"]].append((r["state"], r["entry_age"], r["exit_age"], r["to_state"]))
    assert got[1] == [("H", 55.0, 60.0, "A"), ("A", 60.0, 62.0, "B"), ("B", 62.0, 63.0, "D")]
    assert got[2] == [("H", 55.0, 60.0, None)] and got[3] == [("A", 55.0, 70.0, None)]
    assert got[4] == [("H", 55.0, 60.0, "B"), ("B", 60.0, 70.0, None)] and got[5] == [] and got[6] == [("H", 55.0, 70.0, None)]


def test_many_changes_that_go_back(spark):
    rng = random.Random(4)
    spells = [(i, float(rng.randint(0, 20)), 0.0, rng.random() < 0.5) for i in range(40)]
    spells = [(i, a, a + rng.randint(1, 30), e) for i, a, _, e in spells] + [(100, 5.0, 5.0, True), (101, 1.0, 2.0, True)]
    changes = [(rng.randrange(45), float(rng.randint(0, 60)) / 2, rng.choice(["u", "v", "w"]), rng.choice([0, 1, 2, None])) for _ in range(500)]
    changes += [(7, float(k) / 50, "u", k % 3) for k in range(3000)] + [(None, 3.0, "u", 1), (8, None, "u", 2)]  # one very busy person
    sdf = spark.createDataFrame(spells, "id int, entry_age double, exit_age double, event_flag boolean").withColumn("at", F.lit("x"))
    cdf = spark.createDataFrame(changes, "id int, age_event double, covariate string, value int")
    got = {}
    for r in S.time_varying_merge_many(sdf, cdf, {"u": 9, "v": 0}).collect():
        got.setdefault(r["id"], []).append((r["entry_age"], r["exit_age"], r["event_flag"], r["u"], r["v"]))
    for i, a, b, e in spells:
        own = [(t, c, x) for j, t, c, x in changes if j == i and t is not None and x is not None and c in "uv"]
        cuts = sorted({a, b, *[t for t, *_ in own if a < t < b]}) if a < b else []
        want = []
        for lo, hi in zip(cuts, cuts[1:]):
            now = {"u": 9, "v": 0}
            for t, c, x in sorted(own):
                if t <= lo:
                    now[c] = x
            want.append((lo, hi, e and hi == b, now["u"], now["v"]))
        assert sorted(got.get(i, [])) == want, i


def test_profiles_over_moves_with_fitted_models(spark):
    from spellwise.operators import cox as M
    from spellwise.operators import predict as R

    rows, states = stays(seed=5, n=300), ["H", "A", "B", "D"]
    df = spark.createDataFrame(rows, "id int, sex string, state string, entry_age double, exit_age double, to_state string")
    d = M.design({"sex": ["x", "y"]})
    moves = [("H", "A"), ("H", "D"), ("A", "D"), ("A", "B"), ("B", "A"), ("B", "D")]
    at = {m: (df.filter(F.col("state") == m[0]), F.coalesce(F.col("to_state") == m[1], F.lit(False))) for m in moves}
    lps = {m: R.linear_predictor(M.cox_fit(x, d, event=e, cell_width=2.0)) for m, (x, e) in at.items()}
    bases = {m: R.baseline_hazard(x, lps[m], ties="efron", event=e, cell_width=2.0) for m, (x, e) in at.items()}
    people = df.select("sex").distinct()
    out = P.profile_state_probabilities(bases, lps, people, ["sex"], states, initial="H", cell_width=2.0)
    sums = out.groupBy("sex", "time").agg(F.sum("pstate").alias("p"), F.min("pstate").alias("least")).collect()
    assert sums and all(r["p"] == pytest.approx(1.0) and r["least"] >= 0 for r in sums)
    # one state to leave: the cause-specific curves
    one = {m: bases[m] for m in moves[:2]}
    got = {(r["sex"], r["time"], r["state"]): r["pstate"] for r in P.profile_state_probabilities(one, lps, people, ["sex"], ["H", "A", "D"], initial="H", cell_width=2.0).collect()}
    want = R.cause_specific_curves({b: bases[a, b] for a, b in one}, {b: lps[a, b] for a, b in one}, people, ["sex"], cell_width=2.0).collect()
    for r in want:
        for s, c in (("H", "surv"), ("A", "cif_A"), ("D", "cif_D")):
            assert got[r["sex"], r["time"], s] == pytest.approx(r[c])
    assert len(got) == 3 * len(want)


ODD = [(900, "x", None, 0.0, 5.0, "A"), (901, None, "H", 1.0, 4.0, "A"), (902, "y", "H", 5.0, 5.0, "A"), (903, "y", "H", None, 5.0, "A"), (904, "y", "A", 1.0, 4.0, None)]


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_hazards_of_several_models_equal_those_of_each(spark, ties):
    from spellwise.operators import predict as R

    rows = stays(seed=6, n=200)
    df = spark.createDataFrame(rows + rows[:40] + ODD, "id int, sex string, state string, entry_age double, exit_age double, to_state string")
    lps = {(a, b): F.when(F.col("sex") == "x", 0.1 * k).when(F.col("sex") == "y", -0.2 * k) for k, (a, b) in enumerate(["HA", "HD", "AD", "BZ"])}
    event = {m: F.col("to_state") == m[1] for m in lps}
    got = R.baseline_hazards(df, lps, at={m: F.col("state") == m[0] for m in lps}, event=event, ties=ties, cell_width=2.0)
    assert list(got) == list(lps)
    for m, lp in lps.items():
        want = R.baseline_hazard(df.filter(F.col("state") == m[0]), lp, ties=ties, event=event[m], cell_width=2.0)
        assert got[m].columns == want.columns and got[m].count() == want.count() > 0
        for a, b in zip(got[m].orderBy("time").collect(), want.orderBy("time").collect()):
            assert tuple(a) == pytest.approx(tuple(b))
    everyone = R.baseline_hazards(df, {"one": F.lit(0.0)}, event={"one": F.lit(True)}, ties=ties, cell_width=2.0)["one"]
    assert everyone.agg(F.sum("n_event")).first()[0] == df.filter("entry_age < exit_age").count()


def test_all_moves_are_read_off_one_pass(spark, monkeypatch):
    from spellwise.plans import queries_states as Q

    names = dict(zip("HABD", Q.STATES))
    rows = [(i, s, "1", names[a], t1 + 50, t2 + 50, names.get(b)) for i, s, a, t1, t2, b in stays(seed=9, n=150) for s in ["F" if s == "x" else "M"]]
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    schema = "id int, sex string, smoker_cat3 string, state string, entry_age double, exit_age double, to_state string"
    source = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), schema)
    monkeypatch.setattr(Q, "pieces", lambda spark, sf: source)
    out = Q.profile_state_probabilities(spark, "").groupBy("sex", "smoker_cat3", "time").agg(F.sum("pstate").alias("p")).collect()
    assert out and all(r["p"] == pytest.approx(1.0, abs=1e-5) for r in out)
    assert read.value == len(rows)

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import concordance as cc
from voxcohort.operators import ranks, spread, survival


def pairs(rows, rule):
    num = den = 0.0
    for ti, ei, ri in rows:
        for tj, ej, rj in rows:
            if ei == 1 and (tj > ti or (rule == "library" and tj == ti and ej == 0)):
                den += 1
                num += 1 if ri > rj else 0.5 if ri == rj else 0
    return den, num


@pytest.mark.parametrize("rule", ["strict", "library"])
@pytest.mark.parametrize("rows_per_range", [10 ** 6, 5])
def test_concordance_matches_pairs(spark, rule, rows_per_range):
    rng = np.random.default_rng(4)
    data = [(g, float(rng.integers(1, 15)), int(rng.random() < 0.4), float(rng.integers(0, 6))) for g in ("a", "b") for _ in range(60)]
    df = spark.createDataFrame(data, "g string, RFS double, event int, risk double")
    got = cc.concordance(df, group=["g"], rule=rule, rows_per_range=rows_per_range).collect()
    for r in got:
        den, num = pairs([d[1:] for d in data if d[0] == r.g], rule)
        assert (r.comparable, r.concordant) == (den, num)


def test_concordance_of_reversed_risk_and_no_pairs(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(rng.integers(1, 400)), int(rng.random() < 0.5), float(rng.random())) for _ in range(200)], "RFS double, event int, risk double")
    up = cc.concordance(df).first().c_index
    down = cc.concordance(df.withColumn("risk", -F.col("risk"))).first().c_index
    assert up + down == pytest.approx(1.0)
    assert cc.concordance(df.withColumn("event", F.lit(0))).first().c_index is None


def test_weighted_concordance_equals_copies(spark):
    rows = [(1.0, 1, 3.0, 2), (2.0, 0, 1.0, 3), (3.0, 1, 2.0, 1), (3.0, 0, 2.0, 2)]
    df = spark.createDataFrame(rows, "RFS double, event int, risk double, k int")
    copies = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    a, b = cc.concordance(df, weight="k").first(), cc.concordance(copies).first()
    assert (a.n, a.events, a.comparable, a.concordant) == (b.n, b.events, b.comparable, b.concordant)


@pytest.mark.parametrize("rows_per_range", [10 ** 6, 4])
def test_ranks_and_quantiles(spark, rows_per_range):
    rng = np.random.default_rng(6)
    values = [(k, float(v)) for k in ("a", "b") for v in rng.integers(0, 12, 37)]
    df = spark.createDataFrame(values, "k string, v double")
    q = ranks.exact_quantiles(df, "v", [0.1, 0.5, 0.95], ["k"], rows_per_range).collect()
    for r in q:
        assert r.value == pytest.approx(np.percentile([v for k, v in values if k == r.k], 100 * r.p))
    for r in ranks.add_rank(df, "v", "rk", ["k"], rows_per_range=rows_per_range).collect():
        same = [v for k, v in values if k == r.k]
        assert r.rk == sum(v < r.v for v in same) + (sum(v == r.v for v in same) + 1) / 2


def test_stratified_folds_are_balanced_for_any_range(spark):
    df = spark.createDataFrame([(f"P{i}", i % 3) for i in range(90)], "PatientID string, s int")
    a = ranks.stratified_folds(df, ["s"], seeds=2)
    b = ranks.stratified_folds(df, ["s"], seeds=2, rows_per_range=7)
    assert sorted(map(tuple, a.select("PatientID", "seed", "cv_fold").collect())) == sorted(map(tuple, b.select("PatientID", "seed", "cv_fold").collect()))
    assert {r["count"] for r in a.groupBy("seed", "s", "cv_fold").count().collect()} == {6}


def test_bootstrap_keeps_the_expected_size(spark):
    df = spark.createDataFrame([(f"P{i}",) for i in range(400)], "PatientID string")
    n = ranks.poisson_bootstrap(df, 20).groupBy("replicate").agg(F.sum("multiplicity").alias("n")).agg(F.avg("n")).first()[0]
    assert abs(n - 400) < 25


@pytest.mark.parametrize("per_block", [1000, 7])
def test_distance_stats_match_all_pairs(spark, per_block):
    rng = np.random.default_rng(7)
    pts = {c: rng.integers(0, 12, (n, 3)).astype(float) * 1.5 for c, n in ((1, 40), (2, 1), (3, 2))}
    df = spark.createDataFrame([(c, *map(float, p)) for c, a in pts.items() for p in a], "case_id long, pz double, py double, px double")
    for r in spread.distance_stats(df, ["case_id"], per_block).collect():
        a = pts[r.case_id]
        d = [math.dist(a[i], a[j]) for i in range(len(a)) for j in range(i)]
        assert r.n == len(a)
        assert r.mean_mm == pytest.approx(np.mean(d) if d else 0.0)
        assert r.max_mm == pytest.approx(max(d) if d else 0.0)


def test_hull_candidates_keep_the_diameter(spark):
    rng = np.random.default_rng(8)
    cells = np.argwhere(rng.random((9, 9, 9)) < 0.5)
    df = spark.createDataFrame([(1, *map(int, p)) for p in cells], "case_id long, z int, y int, x int")
    kept = [(r.z, r.y, r.x) for r in spread.hull_candidates(df, ["case_id"]).collect()]
    far = lambda pts: max(math.dist(a, b) for a in pts for b in pts)
    assert len(kept) < len(cells) and far(kept) == far([tuple(c) for c in cells])


def efron(z, t, e, b, lam):
    u, info = z.T @ e - lam * len(t) * b, lam * len(t) * np.eye(len(b))
    w = np.exp(z @ b)
    for s in np.unique(t[e == 1]):
        risk, dead = t >= s, (t == s) & (e == 1)
        d = dead.sum()
        for l in range(d):
            f = l / d
            w2 = w * risk - f * w * dead
            m = w2 @ z / w2.sum()
            u = u - m
            info = info + (z * w2[:, None]).T @ z / w2.sum() - np.outer(m, m)
    return u, info


def test_cox_matches_direct_newton_for_every_group(spark):
    rng = np.random.default_rng(9)
    n, lam, rows, want = 80, 0.1, [], {}
    for g in ("a", "b"):
        x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
        t = np.ceil(rng.exponential(10, n) * np.exp(-0.3 * x[:, 0]))
        e = (rng.random(n) < 0.6).astype(int)
        rows += [(g, float(t[i]), int(e[i]), [float(v) for v in x[i]]) for i in range(n)]
        sd = x.std(axis=0, ddof=1)
        z, b = (x - x.mean(axis=0)) / sd, np.zeros(3)
        for _ in range(30):
            u, info = efron(z, t, e, b, lam)
            b = b + np.linalg.solve(info, u)
        want[g] = b / sd
    fit = survival.cox_fit(spark.createDataFrame(rows, "g string, time double, event int, x array<double>"), 3, lam)
    for r in fit.collect():
        assert r.gradient < 1e-8
        assert np.allclose(r.beta, want[r.g], atol=1e-6)


def test_sign_model_orients_features(spark):
    rows = [(f"P{i}", "c", float(10 - i), 1, float(i), float(-i)) for i in range(8)]
    df = spark.createDataFrame(rows, "PatientID string, center string, RFS double, event int, up double, down double")
    long = survival.long_features(survival.whole_set(df), ["up", "down"], "PatientID", "RFS", "event")
    model = {r.feature: r.sign for r in survival.sign_model(long, ["g"]).collect()}
    assert model == {"up": 1.0, "down": -1.0}


def test_weighted_sign_model_equals_copies(spark):
    rng = np.random.default_rng(11)
    rows = [("g", i % 2, f, float(rng.integers(0, 9)) if rng.random() < 0.9 else None, float(rng.integers(1, 40)), int(rng.random() < 0.5), int(rng.integers(0, 4)))
            for i in range(60) for f in ("a", "b")]
    df = spark.createDataFrame(rows, "g string, replicate int, feature string, value double, RFS double, event int, k int")
    copies = df.where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k"))))
    model = lambda d, w=None: {(r.replicate, r.feature): (r.mu, pytest.approx(r.sd), r.sign, r.keep) for r in survival.sign_model(d, ["g", "replicate"], 0.05, w).collect()}
    want = model(copies)
    assert len(want) == 4 and {k: (v[0], float(v[1].expected), *v[2:]) for k, v in model(df.where("k > 0"), "k").items()} == want
    q = lambda d, w=None: {(r.feature, r.p): r.value for r in ranks.exact_quantiles(d, "value", [0.2, 0.5, 0.9], ["feature"], weight=w).collect()}
    assert q(df, "k") == pytest.approx(q(copies))

"""Survival models on rows stored once, against the fits on repeated rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import crossed as cr
from voxcohort.operators import ranks, survival as sv

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def cohort(spark):
    """A time that a third of the rows share, missing values in ``b``, a constant ``d``, rows without a fold."""
    rng = np.random.default_rng(7)
    rows = [(f"P{i}", f"c{i % 3}", 30.0 if rng.random() < 0.33 else float(rng.integers(1, 60)), int(rng.random() < 0.4), None if i % 17 == 0 else i % 4,
             float(rng.normal()), None if rng.random() < 0.2 else float(rng.integers(0, 9)), float(rng.integers(0, 3)), 5.0) for i in range(400)]
    return spark.createDataFrame(rows, "PatientID string, center string, RFS double, event int, fold int, a double, b double, c double, d double").cache()


def crossed(df, **groups):
    rows, sets = cr.held_by(df.withColumn("x", cr.features_of(df, FEATS)), groups)
    return rows.select(*cr.IDS, "held", "x"), sets


def risks(df):
    return {(r.g, r.PatientID): r.risk for r in df.collect()}


@pytest.mark.parametrize("block", [25_000, 30])
def test_risks_equal_those_of_repeated_rows(spark, cohort, block):
    rows, sets = crossed(cohort, fold=[0, 1, 2, 3], center=["c0", "c1", "c2"])
    sets = cr.guarded(rows, sets)
    assert len(sets.names) == 7
    fill = cr.fills(rows, sets, 4)
    size, mean, sd = cr.moments(rows, sets, 4, fill)
    blocks = cr.time_blocks(rows, 4, block)
    if block == 30:      # the common time has blocks of its own
        assert blocks.where("alone").count() > 1 and blocks.count() > 8
    cox = cr.cox_fits(blocks, sets, 4, fill, mean, sd, size, 0.5)
    sign = cr.sign_fits(rows, sets, 4, fill)
    out = cr.held_out(rows, sets, 4, fill, [lambda i, x: cr.cox_risk(cox, i, x), lambda i, x: cr.sign_risk(sign, [0, 1, 2, 3], i, x)]).cache()
    assert cox["converged"].all()
    for by in ("fold", "center"):
        old = sv.guard_sets(sv.training_sets(cohort, by).withColumn("g", F.concat(F.lit(f"{by}|"), "g")))
        for n, want in enumerate((sv.cox_predictions(old, FEATS), sv.sign_predictions(old, FEATS))):
            want, got = risks(want), risks(out.where(F.col("g").startswith(by)).withColumn("risk", F.col("x")[n]))
            assert want.keys() == got.keys()
            assert np.allclose([want[k] for k in want], [got[k] for k in want], rtol=1e-7, atol=1e-9)
    judged = {(r.model, r.g): tuple(r)[2:] for r in cr.judged(out, ["Cox", "sign"]).collect()}
    named = out.select("g", *cr.IDS, F.explode(F.map_from_arrays(F.array(F.lit("Cox"), F.lit("sign")), "x")).alias("model", "risk"))
    for r in sv.c_by_group(named).collect():
        assert judged[r.model, r.g] == pytest.approx((r.n, r.events, r.c_index), abs=1e-12)


def test_sets_too_small_are_named_by_the_same_guard(spark, cohort):
    few = cohort.where("center != 'c2' OR RFS > 57")
    rows, sets = crossed(few, center=["c0", "c1", "c2"])
    for bounds in ((8, 30, 3), (1, 1, 0), (1, 200, 1)):
        want = {r.g for r in sv.set_guard(sv.training_sets(few, "center"), *bounds).where("reason IS NULL").collect()}
        assert {g.removeprefix("center|") for g in cr.guarded(rows, sets, *bounds).names} == want


def test_repeated_cv_writes_no_copies_of_rows(spark, cohort):
    """What ten seeds of folds checkpoint does not grow with sets times rows."""
    df = cohort.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("PatientID", F.concat_ws("-", "PatientID", "i")).drop("fold").cache()
    folds = ranks.stratified_folds(df.select("PatientID", "event", "center"), ["event", "center"]).select("PatientID", "seed", "cv_fold")
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    written = lambda: {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs}
    before = written()
    rows, sets = cr.held_by_seed(df.withColumn("x", cr.features_of(df, FEATS)), folds, "PatientID", 10)
    out = cr.cox_and_sign(rows.select(*cr.IDS, "held", "x"), cr.guarded(rows, sets, 1, 1, 3), 4)
    assert out.count() == 40_000 and sum(v for k, v in written().items() if k not in before) < 6_000_000      # 4,000 rows for each of 50 sets, at 80 bytes a row, would be 16 MB


def test_selected_features_and_bags_equal_those_of_repeated_rows(spark, cohort):
    rows, sets = crossed(cohort, fold=[0, 1, 2, 3])
    rows = rows.cache()
    fill = cr.fills(rows, sets, 4)
    size, mean, sd = cr.moments(rows, sets, 4, fill)
    old = sv.guard_sets(sv.training_sets(cohort, "fold").withColumn("g", F.concat(F.lit("fold|"), "g")))
    picked = cr.chosen(sets, cr.sign_fits(rows, sets, 4, fill, [1, 2, 3]), sd, FEATS, 1, 2)
    want = {(r.g, r.rank): r.feature for r in sv.preselect(old, FEATS[1:], 2).collect()}
    assert {(g, n): FEATS[picked[i, n]] for i, g in enumerate(sets.names) for n in (1, 2)} == want and (picked[:, 0] == 0).all()
    cox = cr.cox_fits(cr.time_blocks(rows, 4), sets, 4, fill, mean, sd, size, 0.5, picked)
    bags = cr.bag_fits(rows, sets, FEATS, fill, mean, sd, size, [FEATS, FEATS[:3]], 6)
    out = cr.held_out(rows, sets, 4, fill, [lambda i, x: cr.cox_risk(cox, i, x), *[lambda i, x, b=b: cr.bag_risk(b, i, x) for b in bags]]).cache()
    for n, df in enumerate((sv.cox_with_selected(old, FEATS[:1], FEATS[1:], 2), sv.bagged_sign_predictions(old, FEATS, 6), sv.bagged_sign_predictions(old, FEATS[:3], 6))):
        want, got = risks(df), risks(out.withColumn("risk", F.col("x")[n]))
        assert want.keys() == got.keys() and np.allclose([want[k] for k in want], [got[k] for k in want], rtol=1e-7, atol=1e-9)
    both = cr.with_rank_means(out, ["c", "a", "b"], {"mix": ("c", "a"), "all": ("c", "a", "b")}, [("b", "fold|1")])
    named = out.select("g", *cr.IDS, F.explode(F.map_from_arrays(F.array(*map(F.lit, "cab")), "x")).alias("model", "risk")).where("model != 'b' OR g != 'fold|1'")
    for n, models in ((3, ("c", "a")), (4, ("c", "a", "b"))):
        want, got = risks(sv.rank_ensemble(named, models, "m")), risks(both.withColumn("risk", F.col("x")[n]))
        assert want.keys() == got.keys() and all(want[k] == pytest.approx(got[k]) for k in want)

"""Saved model state: preparation, versions, scoring and refusals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import modelstate as ms


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(4)
    rows = [(f"P{i}", float(rng.normal(50, 9)), None if i % 5 == 0 else float(i % 3), ["left", "right", None, "both"][i % 4], 7.0, float(rng.integers(1, 300)), int(rng.random() < 0.5),
             "abc"[i % 3]) for i in range(90)]
    return spark.createDataFrame(rows, "PatientID string, age double, hpv double, side string, fixed double, RFS double, event int, label string")


def test_preparation_codes_fills_scales_and_drops(spark, cohort, tmp_path):
    state = ms.fit_preparation(cohort, ["age", "hpv", "side", "fixed"])
    path = str(tmp_path / "state")
    assert [ms.save(state, path, "risk"), ms.save(state.where("feature <> 'hpv'"), path, "risk")] == [1, 2]
    again = ms.load(spark, path, "risk", 1)
    assert ms.load(spark, path, "other") is None and ms.load(spark, path + "-no", "risk") is None and ms.load(spark, path, "risk", 9) is None
    assert ms.load(spark, path, "risk").where("feature = 'hpv'").isEmpty()
    codes = {r.level: r.value for r in again.where("kind = 'code'").collect()}
    assert codes == {"both": 0.0, "left": 1.0, "right": 2.0}
    x, names = ms.prepared(cohort, again)
    assert names == ["hpv_missing", "side_missing", "age", "hpv", "side"]
    pdf = cohort.toPandas()
    raw = {"age": pdf.age, "hpv": pdf.hpv, "side": pdf.side.map(codes)}
    got = np.array(x.orderBy("PatientID").select("x").toPandas()["x"].tolist())
    order = pdf.PatientID.argsort()
    for k, f in enumerate(names):
        v = raw[f.removesuffix("_missing")]
        full = v.fillna(v.median())
        want = v.isna().astype(float) if f.endswith("_missing") else (full - full.mean()) / full.std()
        assert np.allclose(got[:, k], want.to_numpy()[order])


def test_risk_of_unseen_levels_missing_columns_and_repeated_rows(spark, cohort):
    state = ms.fit_cox(cohort, ["age", "hpv", "side", "fixed"])
    asked = spark.createDataFrame([("a", 50.0, "up"), ("b", 50.0, None), ("c", None, "left"), ("c", None, "left")], "PatientID string, age double, side string")
    out = {r.PatientID: r for r in ms.risk(asked, state).collect()}
    assert out["a"].risk == out["b"].risk and out["a"].side == "up" and ms.risk(asked, state).count() == 4 and all(r.risk > 0 for r in out.values())
    assert ms.risk(asked.where("age < 0"), state).count() == 0


def test_stage_predicts_and_scores_under_the_floor_are_refused(spark, cohort):
    df = cohort.withColumn("age", F.col("age") + 40 * (F.col("label") == "b").cast("int"))
    state = ms.fit_stage(df, ["age", "side"], "label", ["a", "b", "c"])
    out = ms.stage(df, state, "p")
    assert out.columns == [*df.columns, "p"] and out.where("label = 'b'").where("p = 'b'").count() >= 28
    assert ms.with_score(state, 0.7, 0.6).where("kind = 'score'").first().value == 0.7
    for score in (0.5, float("nan")):
        with pytest.raises(ValueError):
            ms.with_score(state, score, 0.6)

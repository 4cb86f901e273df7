"""Arms of the survival comparison: the bag over several training sets in one table."""

import numpy as np

from voxcohort.operators import survival


def test_bagged_risks_do_not_depend_on_the_sets_fitted_beside(spark):
    rng = np.random.default_rng(2)
    rows = [(f"P{i}", f"c{i % 3}", float(rng.integers(1, 40)), int(rng.random() < 0.5), i % 2, *map(float, rng.normal(size=3))) for i in range(120)]
    df = spark.createDataFrame(rows, "PatientID string, center string, RFS double, event int, fold int, a double, b double, c double")
    folds, centers = (survival.guard_sets(survival.training_sets(df, by), 1, 1, 0) for by in ("fold", "center"))
    risk = lambda sets: {(r.g, r.PatientID): r.risk for r in survival.bagged_sign_predictions(sets, ["a", "b", "c"], 5).collect()}
    both = risk(folds.unionByName(centers))
    assert len(both) == 240 and both == {**risk(folds), **risk(centers)}

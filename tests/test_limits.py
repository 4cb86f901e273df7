"""Results above sizes at which work was once cut short."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort import schema
from voxcohort.operators import crop, nodes, spread
from voxcohort.plans.scoring import risk_from_state
from voxcohort.sources import listing
from voxcohort.sources.sinks import read_or_none
from voxcohort.streaming.incremental import Waiting, run_available, waiting_voxels

HEAD = "case_id long, nx int, ny int, nz int, sx double, sy double, sz double"


def test_mean_distance_counts_all_pairs_of_a_large_lesion(spark):
    rng = np.random.default_rng(4)
    cells = np.argwhere(rng.random((3, 70, 60)) < 0.5)      # over 4,000 voxels, over a million pairs in a pair of slices
    lesion = spark.createDataFrame([(1, *map(int, c)) for c in cells] + [(2, 5, 5, 5)], "case_id long, z int, y int, x int")
    head = spark.createDataFrame([(i, 99, 99, 99, 0.5, 1.5, 3.0) for i in (1, 2)], HEAD)
    p = cells * np.array([3.0, 1.5, 0.5])
    total = sum(np.sqrt(((p[n + 1:] - p[n]) ** 2).sum(1)).sum() for n in range(len(p)))
    got = {r.case_id: r.mean_mm for r in spread.mean_distance(lesion, head).collect()}
    assert len(cells) > 4000 and got[1] == pytest.approx(total / (len(p) * (len(p) - 1) / 2), rel=1e-9) and got[2] == 0.0


def test_uptake_leaves_out_infinite_values(spark):
    mask = spark.createDataFrame([(1, 2, v) for v in (5.0, float("inf"), float("-inf"), float("nan"), 3.0)], "case_id long, label int, pet double")
    row = spread.uptake(mask, spark.createDataFrame([(1, 9, 9, 9, 1.0, 1.0, 1.0)], HEAD)).first()
    assert (row.suv_max_all, row.suv_mean_all, row.suv_hetero) == (5.0, 4.0, 1.25)


def test_risk_of_a_state_with_many_features(spark):
    n = 1500
    state = spark.createDataFrame([(f"f{k:04d}", 1.0, 0.5, 2.0, 0.001 * (k % 7)) for k in range(n)], "feature string, med double, mu double, sd double, beta double")
    df = spark.range(2).select(F.col("id").alias("case_id"), *[F.when(F.col("id") == 0, float(k)).alias(f"f{k:04d}") for k in range(60)])
    want = [np.exp(sum(0.001 * (k % 7) * ((float(k) if i == 0 and k < 60 else 1.0) - 0.5) / 2.0 for k in range(n))) for i in (0, 1)]
    got = risk_from_state(df, state).orderBy("case_id").select("risk").toPandas()["risk"].tolist()
    assert got == pytest.approx(want)


def test_midline_uses_every_voxel_of_a_long_image(spark):
    rows = [(1, z, 0, 2 * z % 301, 0, 0.0, 0.0) for z in range(300)]
    head = spark.createDataFrame([(1, 301, 1, 300, 0.5, 1.0, 1.0)], HEAD)
    got = nodes.body_midline(spark.createDataFrame(rows, schema.VOXELS), head).first().midline_mm
    assert got == pytest.approx(np.mean([2 * z % 301 for z in range(300)]) * 0.5)


def test_cropping_is_the_callers_choice(spark):
    head = spark.createDataFrame([(1, 40, 40, 40, 1.0, 1.0, 1.0)], HEAD)
    box = spark.createDataFrame([(1, 1, 2, 3, 4, 5, 6)], "case_id long, x0 int, y0 int, z0 int, dx int, dy int, dz int")
    assert crop.gated_box(box, head).first().cropped and not crop.gated_box(box, head, gate=1e6).first().cropped


def test_a_case_over_two_runs_keeps_all_voxels(spark, tmp_path):
    vox = spark.createDataFrame([(c, z, 0, 0, 1, 1.0, 0.0) for c in (1, 2) for z in range(6)], schema.VOXELS)
    expected = vox.groupBy("case_id").agg(F.count("*").alias("n_voxels"))
    first = (F.col("case_id") == 2) | (F.col("z") < 3)
    seen = []
    for part in (first, ~first, ~first):
        vox.where(part).write.mode("append").parquet(f"{tmp_path}/in/{len(seen)}")
        run_available(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt", lambda v: v.groupBy("case_id").count(), expected)
        seen.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())))
    assert seen == [[(2, 6)], [(1, 6), (2, 6)], [(1, 6), (2, 6)]]
    assert waiting_voxels(spark, f"{tmp_path}/out").count() == 0      # nothing is held once every case is complete
    held = Waiting(spark, f"{tmp_path}/out_waiting").generations()
    assert held == [1, 2]                                             # the last, and the one its replay would read


def test_replayed_batch_starts_from_the_generation_before_it(spark, tmp_path):
    rows = lambda c: spark.createDataFrame([(c, 0, 0, 0, 1, 1.0, 0.0)], schema.VOXELS)
    held = Waiting(spark, f"{tmp_path}/held")
    assert held.generations() == [] and held.before(5) is None
    for batch in (0, 1, 1, 2):
        seen = held.before(batch)
        held.keep(rows(batch) if seen is None else seen.unionByName(rows(batch)), batch)
    assert held.generations() == [1, 2] and sorted(r.case_id for r in held.before(3).collect()) == [0, 1, 2]


def test_only_a_missing_table_is_missing(spark, tmp_path):
    assert read_or_none(spark, f"{tmp_path}/none") is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        read_or_none(spark, f"{tmp_path}/bad", "parquet").count()


def test_pet_globs_and_several_ct_files(spark):
    names = ["C1-1/C1-1_PT_C1-1.nii.gz", "C1-1/a__CT.nii.gz", "C1-1/b__CT.nii.gz", "C1-1/C1-1.nii.gz", "C2-2/x__CT.nii.gz", "C2-2/x__PET.nii.gz", "C2-2/C2-2.nii.gz"]
    files = spark.createDataFrame([("root/" + n,) for n in names], "path string")
    got = sorted((r.case, r.ct.split("/")[-1], r.pet.split("/")[-1], r.label.split("/")[-1]) for r in listing.find_cases(files).collect())
    assert got == [("C1-1", "a__CT.nii.gz", "C1-1_PT_C1-1.nii.gz", "C1-1.nii.gz"), ("C1-1", "b__CT.nii.gz", "C1-1_PT_C1-1.nii.gz", "C1-1.nii.gz"),
                   ("C2-2", "x__CT.nii.gz", "x__PET.nii.gz", "C2-2.nii.gz")]

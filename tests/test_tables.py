import json

import pytest
from pyspark.sql import functions as F

from voxcohort.functions import clinical as cl
from voxcohort.operators import crop, metrics, resample, texture, texture_kernel as kernel
from voxcohort.sources import listing, sinks, tables


def test_headers():
    assert cl.headers_by_pattern(["ID", "Smoking", "ecog", "age"]) == {"PatientID": "ID", "Age": "age", "Tobacco": "Smoking", "Performance": "ecog"}
    assert cl.headers_by_letters(["Treatment", "Treatment 2"], "last") == {"Treatment": "Treatment 2"}
    assert cl.find_first_order(["pt_gtvp_firstorder_MeanAbsoluteDeviation", "pt_gtvp_firstorder_Mean"], "pt", "gtvp", "Mean").endswith("Deviation")


@pytest.mark.parametrize("body", [
    {"folds": [{"fold": 3, "train": ["a"], "val": ["b"]}]},
    {"splits": [{"fold": 3, "train": ["a"], "validation": ["b"]}]},
    [{"fold": 3, "train": ["a"], "val": ["b"]}],
])
def test_split_formats(spark, body):
    df = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert sorted(map(tuple, tables.parse_splits(df).collect())) == [(3, "train", "a"), (3, "val", "b")]


def test_filter_splits_rejects_empty_side(spark):
    s = spark.createDataFrame([(0, "train", "a"), (0, "val", "b")], "fold int, role string, PatientID string")
    with pytest.raises(ValueError):
        tables.filter_splits(s, spark.createDataFrame([("a",)], "PatientID string"))


def test_tolerant_json(spark):
    df = spark.createDataFrame([('{"Age": 5, }',), ('{"Age": 6}',), ("{",)], "t string")
    ages = [r[0] for r in df.select(tables.parse_tolerant(F.col("t"))["Age"]).collect()]
    assert ages[:2] == [5, 6] and ages[2] is None


def test_listing_reads_folders(spark, tmp_path):
    for name in ("C1-1/C1-1__CT.nii.gz", "C1-1/C1-1__PT.nii.gz", "C1-1/C1-1.nii.gz", "C1-2/C1-2__CT.nii.gz"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    files = listing.list_files(spark, str(tmp_path))
    rows = listing.find_cases(files).collect()
    assert [r["case"] for r in rows] == ["C1-1"] and rows[0].pet.endswith("__PT.nii.gz")


def test_optional_state(spark, tmp_path):
    assert sinks.load_params(spark, str(tmp_path / "none")) is None


def test_nan_becomes_missing(spark):
    df = spark.createDataFrame([("nan",), ("1.5",), ("x",)], "v string")
    assert [r[0] for r in df.select(cl.number("v")).collect()] == [None, 1.5, None]


def test_balanced_accuracy_ignores_classes_absent_from_truth(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "b")], "y string, p string")
    assert metrics.balanced_accuracy(df).first()[0] == pytest.approx(0.75)


def grid(spark, n, s):
    return spark.createDataFrame([(1, n, n, n, s, s, s, 0.0, 0.0, 0.0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])],
                                 "case_id long, nx int, ny int, nz int, sx double, sy double, sz double, ox double, oy double, oz double, dir array<double>")


def test_resample_onto_itself_and_of_a_ramp(spark):
    cells = [(1, z, y, x, float(x)) for z in range(4) for y in range(4) for x in range(4)]
    v = spark.createDataFrame(cells, "case_id long, z int, y int, x int, value double")
    same = resample.resample(v, grid(spark, 4, 2.0), grid(spark, 4, 2.0), -1.0)
    assert same.join(v.withColumnRenamed("value", "w"), ["case_id", "z", "y", "x"]).where("abs(value - w) > 1e-9").count() == 0
    fine = resample.resample(v, grid(spark, 4, 2.0), grid(spark, 9, 1.0), -1.0).where("z = 0 and y = 0").orderBy("x")
    assert [r.value for r in fine.collect()] == [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0, -1.0]


def test_crop_then_paste_is_identity_inside(spark):
    v = spark.createDataFrame([(1, z, y, x, 1) for z in range(6) for y in range(3) for x in range(3)], "case_id long, z int, y int, x int, label int")
    box = spark.createDataFrame([(1, 1, 0, 2, 2, 3, 3)], "case_id long, x0 int, y0 int, z0 int, dx int, dy int, dz int")
    back = crop.paste_back(crop.apply_crop(v, box), box)
    assert back.count() == 2 * 3 * 3 and back.exceptAll(v).count() == 0
    assert crop.voxels_lost(v, box).first().lost == 54 - 18


def test_dice_of_equal_and_empty_masks(spark):
    v = spark.createDataFrame([(1, 0, 0, 0, 1)], "case_id long, z int, y int, x int, label int")
    rows = {r.label: r.dice for r in crop.dice(v, v, grid(spark, 2, 1.0)).collect()}
    assert rows == {1: 1.0, 2: 1.0}


@pytest.mark.parametrize("block", [32, 2])
def test_texture_of_a_row(spark, block):
    rows = [(1, "ct", "gtvp", 0, 0, x, float(v)) for x, v in enumerate([1, 1, 60, 60, 60])]
    levels = texture.discretise(spark.createDataFrame(rows, "case_id long, modality string, region string, z int, y int, x int, value double"))
    assert [r.level for r in levels.orderBy("x").collect()] == [1, 1, 3, 3, 3]
    runs = {(r.i, r.j): r.c for r in kernel.run_matrix(kernel.cube_counts(levels, block)).where("dir = 0").collect()}
    along = [r for r in kernel.run_matrix(kernel.cube_counts(levels, block)).collect() if r.j > 1]
    assert sorted((r.i, r.j, r.c) for r in along) == [(1, 2, 1), (3, 3, 1)] and runs
    zones = sorted((r.i, r.j, r.c) for r in kernel.zone_matrix(kernel.cube_counts(levels, block)).collect())
    assert zones == [(1, 2, 1), (3, 3, 1)]

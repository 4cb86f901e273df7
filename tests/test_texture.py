"""Texture matrices cube by cube and resampling, against plain loops."""

from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import resample, texture, texture_kernel as kernel
from voxcohort.operators.components import _HALF_NEIGHBOURS

ROI = "case_id long, modality string, region string"


def grid(shape, seed, share=0.6, levels=3):
    rng = np.random.default_rng(seed)
    g = rng.integers(1, levels + 1, shape) * (rng.random(shape) < share)
    g[2, 1, :] = 2          # a run through all cubes
    return g


def levels_of(spark, grids):
    rows = [(c, "ct", "gtvp", int(z), int(y), int(x), int(g[z, y, x])) for c, g in grids.items() for z, y, x in np.argwhere(g)]
    return spark.createDataFrame(rows, ROI + ", z int, y int, x int, level int")


def at(g, p):
    return int(g[p]) if all(0 <= v < n for v, n in zip(p, g.shape)) else 0


def matrices(g):
    pairs, deps, tones, runs, zones = Counter(), Counter(), {}, Counter(), Counter()
    cells = [tuple(map(int, p)) for p in np.argwhere(g)]
    move = lambda p, d, k=1: tuple(a + k * b for a, b in zip(p, d))
    for p in cells:
        around = [at(g, move(p, d, k)) for d in _HALF_NEIGHBOURS for k in (1, -1)]
        deps[at(g, p), 1 + sum(v == at(g, p) for v in around)] += 1
        full = [v for v in around if v]
        if full:
            n, s = tones.get(at(g, p), (0, 0.0))
            tones[at(g, p)] = (n + 1, s + abs(at(g, p) - sum(full) / len(full)))
        for k, d in enumerate(_HALF_NEIGHBOURS):
            q = at(g, move(p, d))
            if q:
                pairs[k, at(g, p), q] += 1
                pairs[k, q, at(g, p)] += 1
            if at(g, move(p, d, -1)) != at(g, p):
                length = 1
                while at(g, move(p, d, length)) == at(g, p):
                    length += 1
                runs[k, at(g, p), length] += 1
    left = set(cells)
    while left:
        stack, size = [left.pop()], 0
        level = at(g, stack[0])
        while stack:
            p = stack.pop()
            size += 1
            for d in product((-1, 0, 1), repeat=3):
                q = move(p, d)
                if q in left and at(g, q) == level:
                    left.remove(q)
                    stack.append(q)
        zones[level, size] += 1
    return pairs, deps, tones, runs, zones


@pytest.mark.parametrize("block", [32, 4, 3])
def test_matrices_equal_plain_loops(spark, block):
    grids = {1: grid((9, 8, 11), 1), 2: grid((5, 13, 4), 2, 0.9, 2)}
    counts = kernel.cube_counts(levels_of(spark, grids), block)
    for c, g in grids.items():
        pairs, deps, tones, runs, zones = matrices(g)
        own = counts.where(F.col("case_id") == c)
        assert {(r.dir, r.i, r.j): r.c for r in kernel.pair_matrix(own).collect()} == pairs
        assert {(r.i, r.j): r.c for r in kernel.dependence_matrix(own).collect()} == deps
        assert {(r.dir, r.i, r.j): r.c for r in kernel.run_matrix(own).collect()} == runs
        assert {(r.i, r.j): r.c for r in kernel.zone_matrix(own).collect()} == zones
        got = {r.i: (r.n, r.s) for r in kernel.tone_sums(own).collect()}
        assert set(got) == set(tones) and all(got[i][0] == n and got[i][1] == pytest.approx(s) for i, (n, s) in tones.items())


def test_maximal_correlation_is_the_root_of_the_second_eigenvalue(spark):
    g = grid((6, 6, 6), 3, 0.8, 4)
    got = kernel.maximal_correlation(kernel.pair_matrix(kernel.cube_counts(levels_of(spark, {1: g, 2: np.ones((3, 3, 3), int)})))).collect()
    pairs, values = matrices(g)[0], []
    for k in range(13):
        p = np.zeros((4, 4))
        for (d, i, j), c in pairs.items():
            if d == k:
                p[i - 1, j - 1] = c
        p /= p.sum()
        q = (p / p.sum(1)[:, None]) @ (p / p.sum(0)[None, :]).T
        values.append(np.sqrt(np.sort(np.linalg.eigvals(q).real)[-2]))
    assert {r.case_id: pytest.approx(r.MCC) for r in got} == {1: np.mean(values), 2: 1.0}


HEADER = "case_id long, nx int, ny int, nz int, sx double, sy double, sz double, ox double, oy double, oz double, dir array<double>"


@pytest.mark.parametrize("block", [32, 3])
def test_resample_between_rotated_grids(spark, block):
    def turn(axis, angle):
        c, s = np.cos(angle), np.sin(angle)
        m = np.eye(3)
        i, j = [k for k in range(3) if k != axis]
        m[i, i], m[i, j], m[j, i], m[j, j] = c, -s, s, c
        return m
    a, b = turn(2, 0.4) @ turn(0, -0.3), turn(1, 0.7)
    source = (1, 9, 8, 7, 1.0, 1.3, 2.0, -3.0, 2.0, 1.0, a.ravel().tolist())
    target = (1, 7, 10, 6, 1.7, 0.9, 1.1, -2.0, 1.0, 4.0, b.ravel().tolist())
    plane = lambda w: 2.0 + w @ [0.5, -1.5, 0.25]
    world = lambda h, index: np.array(h[7:10]) + (index * np.array(h[4:7])) @ np.array(h[10]).reshape(3, 3).T
    rows = [(1, z, y, x, float(plane(world(source, np.array([x, y, z]))))) for z, y, x in product(range(7), range(8), range(9))]
    out = resample.resample(spark.createDataFrame(rows, "case_id long, z int, y int, x int, value double"), spark.createDataFrame([source], HEADER),
                            spark.createDataFrame([target], HEADER), -99.0, block=block).collect()
    assert len(out) == 7 * 10 * 6 and len({(r.z, r.y, r.x) for r in out}) == len(out)
    inside = 0
    for r in out:
        w = world(target, np.array([r.x, r.y, r.z]))
        at_ = ((w - np.array(source[7:10])) @ a) / np.array(source[4:7])
        if (at_ >= 0).all() and (at_ <= np.array([8, 7, 6])).all():
            assert r.value == pytest.approx(plane(w))
            inside += 1
        elif (at_ < -0.5 - 1e-6).any() or (at_ > np.array([8, 7, 6]) + 0.5 + 1e-6).any():
            assert r.value == -99.0
    assert inside > 50


def test_failed_regions_keep_a_reason(spark):
    unit = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    headers = spark.createDataFrame([(1, 12, 12, 12, 4.0, 4.0, 4.0, 0.0, 0.0, 0.0, unit), (2, 12, 12, 12, 0.0, 4.0, 4.0, 0.0, 0.0, 0.0, unit)], HEADER)
    cell = lambda c, z, y, x, label, pet: (c, z, y, x, label, pet, 30.0 + z)
    rows = [cell(1, z, y, x, 1, 5.0 + x) for z in (3, 4, 5) for y in (3, 4, 5) for x in (3, 4, 5)] + [cell(1, 9, 9, 9, 2, 9.0), cell(2, 1, 1, 1, 1, 4.0), cell(3, 1, 1, 1, 1, 4.0)]
    voxels = spark.createDataFrame(rows, "case_id long, z int, y int, x int, label int, pet double, ct double")
    out = texture.radiomics_rows(voxels, voxels, headers).collect()
    assert {(r.case_id, r.region): r.error for r in out if r.error} == {(1, "gtvn"): "nothing left after cleanup", (2, "gtvp"): "voxel spacing is not positive", (3, "gtvp"): "no image header"}
    good = {r.name: r.value for r in out if not r.error}
    assert all(n.split("_")[1] == "gtvp" for n in good) and {n.split("_")[2] for n in good} == {"firstorder", "shape", "glcm", "glrlm", "glszm", "gldm", "ngtdm"}
    assert good["pt_gtvp_firstorder_Mean"] == pytest.approx(9.0) and good["pt_gtvp_shape_VoxelVolume"] == pytest.approx(5 ** 3 * 8)
    alone = texture.failed_regions(voxels, voxels, headers).collect()
    assert {(r.case_id, r.region): r.error for r in alone} == {(r.case_id, r.region): r.error for r in out if r.error}


def test_failed_regions_compute_no_feature(spark, monkeypatch):
    unit = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    headers = spark.createDataFrame([(1, 12, 12, 12, 4.0, 4.0, 4.0, 0.0, 0.0, 0.0, unit)], HEADER)
    voxels = spark.createDataFrame([(1, 9, 9, 9, 2, 9.0, 30.0)], "case_id long, z int, y int, x int, label int, pet double, ct double")
    monkeypatch.setattr(texture, "texture_classes", None)
    monkeypatch.setattr(texture, "resampled_regions", None)
    assert [tuple(r) for r in texture.failed_regions(voxels, voxels, headers).collect()] == [(1, "gtvn", "nothing left after cleanup")]


def test_only_the_counts_asked_for(spark):
    """Two far corners of a cube, and lesions at its faces, count alike alone and together."""
    g = np.zeros((9, 9, 9), int)
    g[0, 0, 0], g[8, 8, 8], g[2:5, 3:6, 2] = 2, 1, 3
    for block in (4, 32):
        lv = levels_of(spark, {1: g})
        every = kernel.cube_counts(lv, block)
        for kinds, matrix in ((("pair",), kernel.pair_matrix), (("dep",), kernel.dependence_matrix), (("tone",), kernel.tone_sums), (("run",), kernel.run_matrix), (("zone",), kernel.zone_matrix)):
            alone = kernel.cube_counts(lv, block, kinds)
            assert {r.kind for r in alone.select("kind").distinct().collect()} <= {*kinds, *((f"open_{kinds[0]}", "face", "contact"))}
            assert sorted(map(tuple, matrix(alone).collect())) == sorted(map(tuple, matrix(every).collect()))


def test_energy_does_not_depend_on_the_order_of_voxels(spark):
    """Plain sums of squares differ in their last digits from order to order; one that falls on a rounding tie then differs from SQL."""
    import math
    rng = np.random.default_rng(5)
    values = (-420 + 600 * rng.normal(size=400)).tolist()
    head = spark.createDataFrame([(0, 2.0, 2.0, 2.0)], "case_id long, sx double, sy double, sz double")
    found = set()
    for order in (values, values[::-1], sorted(values), sorted(values, key=abs)):
        rows = [(0, "ct", "gtvn", 0, 0, k, v) for k, v in enumerate(order)]
        roi = spark.createDataFrame(rows, ROI + ", z int, y int, x int, value double").coalesce(1)
        found.add(tuple(texture.first_order(texture.discretise(roi), head).select("Energy", "TotalEnergy").first()))
    exact = math.fsum(v * v for v in values)
    assert found == {(exact, exact * 8.0)}

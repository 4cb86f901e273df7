import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import components, nodes

STEPS = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s)]


def brute_close(mask, r):
    """Box closing with background outside the image while eroding."""
    n = mask.shape
    dil = np.zeros_like(mask)
    for p in np.argwhere(mask):
        dil[tuple(slice(max(0, c - k), c + k + 1) for c, k in zip(p, r))] = True
    out = np.zeros_like(mask)
    for p in np.argwhere(dil):
        if all(c - k >= 0 and c + k < m for c, k, m in zip(p, r, n)):
            out[tuple(p)] = dil[tuple(slice(c - k, c + k + 1) for c, k in zip(p, r))].all()
    return out


def brute_label(mask):
    seen, out = set(), {}
    for p in map(tuple, np.argwhere(mask)):
        if p in seen:
            continue
        todo, part = [p], []
        seen.add(p)
        while todo:
            q = todo.pop()
            part.append(q)
            for s in STEPS:
                t = tuple(a + b for a, b in zip(q, s))
                if all(0 <= c < m for c, m in zip(t, mask.shape)) and mask[t] and t not in seen:
                    seen.add(t)
                    todo.append(t)
        first = min(part)
        for q in part:
            out[q] = (first[0] << 40) + (first[1] << 20) + first[2]
    return out


def table(spark, masks):
    rows = [(c, int(z), int(y), int(x)) for c, m in masks.items() for z, y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "case_id long, z int, y int, x int")


def header(spark, masks, spacing):
    rows = [(c, m.shape[2], m.shape[1], m.shape[0], *spacing) for c, m in masks.items()]
    return spark.createDataFrame(rows, "case_id long, nx int, ny int, nz int, sx double, sy double, sz double")


@pytest.mark.parametrize("mm,spacing,r", [(0.0, (1.0, 1.0, 1.0), (0, 0, 0)), (2.0, (2.0, 1.0, 0.8), (2, 2, 1))])
def test_closing_and_labels_match_brute_force_across_cubes(spark, mm, spacing, r):
    rng = np.random.default_rng(1)
    masks = {c: rng.random((11, 9, 10)) < d for c, d in ((1, 0.05), (2, 0.12), (3, 0.2))}
    got = components.label_components(table(spark, masks), header(spark, masks, spacing), merge_mm=F.lit(mm), block=4).collect()
    want = {}
    for c, m in masks.items():
        closed = brute_close(m, r) if any(r) else m
        want.update({(c, *p): i for p, i in brute_label(closed).items()})
    assert {(g.case_id, g.z, g.y, g.x): g.comp_id for g in got} == want
    assert all(g.is_original == bool(masks[g.case_id][g.z, g.y, g.x]) for g in got)


def test_long_snake_is_one_component(spark):
    """A path through many cubes needs several contraction rounds."""
    mask = np.zeros((1, 21, 21), dtype=bool)
    for y in range(0, 21, 2):
        mask[0, y, :] = True
    for k, y in enumerate(range(1, 21, 2)):
        mask[0, y, 20 if k % 2 == 0 else 0] = True
    got = components.label_components(table(spark, {7: mask}), block=3)
    assert {r.comp_id for r in got.select("comp_id").distinct().collect()} == {0}


def test_labels_do_not_depend_on_order_or_partitions(spark):
    rng = np.random.default_rng(3)
    t = table(spark, {1: rng.random((8, 8, 8)) < 0.15})
    a = components.label_components(t, block=3).select("z", "y", "x", "comp_id")
    b = components.label_components(t.orderBy(F.rand(5)).repartition(7), block=8).select("z", "y", "x", "comp_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_ignored_border_keeps_edge_voxels(spark):
    masks = {1: np.ones((4, 4, 4), dtype=bool)}
    t, h = table(spark, masks), header(spark, masks, (1.0, 1.0, 1.0))
    assert components.label_components(t, h, merge_mm=F.lit(1.0), border="ignore").count() == 64
    assert components.label_components(t, h, merge_mm=F.lit(1.0)).count() == 8


def test_cleanup_only_removes(spark):
    rng = np.random.default_rng(2)
    m = rng.random((10, 10, 10)) < 0.1
    vox = table(spark, {1: m}).withColumns({"label": (1 + (F.col("x") > 4).cast("int")), "pet": F.col("x") * 1.0, "ct": F.lit(0.0)})
    h = header(spark, {1: m}, (4.0, 4.0, 4.0))
    out = nodes.clean_mask(vox, h).select("case_id", "z", "y", "x", "label")
    assert out.exceptAll(vox.select("case_id", "z", "y", "x", "label")).count() == 0


def test_rule_thresholds(spark):
    from voxcohort.functions.staging import rule_n
    demo = spark.createDataFrame([(0, 0.0, "none"), (1, 24.0, "unilateral"), (2, 42.0, "bilateral"), (1, 66.0, "unilateral"), (1, None, "midline")],
                                 "n int, mm double, lat string")
    assert [r[0] for r in demo.select(rule_n("n", "mm", "lat")).collect()] == ["N0", "N1", "N2", "N3", "N2"]

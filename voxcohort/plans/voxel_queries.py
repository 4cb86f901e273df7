"""Contract queries for voxel and lesion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort import fixtures as fx
from voxcohort.functions import staging
from voxcohort import schema
from voxcohort.operators import crop, nodes, spread
from voxcohort.plans import views
from voxcohort.plans.registry import query, view


def r6(*names):
    return [F.round(n, 7).alias(n) for n in names]


def sql6(*names):
    return ", ".join(f"round({n}, 7) AS {n}" for n in names)


# ---------------------------------------------------------------- V11-V21 nodes
@query("v11_closing", "SELECT case_id, merge_mm, z, y, x FROM m2_closed")
def v11(spark, sf):
    m = nodes.merged_nodes(fx.voxels(spark, sf), fx.volumes(spark, sf))
    return m.select("case_id", "merge_mm", "z", "y", "x")


view("gtvn_border", "SELECT case_id, z, y, x FROM fx_border WHERE label = 2", ("fx_border",))
views.closing_views("b2", "gtvn_border", "fx_border_volumes", [2.0])


@query("v11_closing_at_border", "SELECT case_id, merge_mm, z, y, x FROM b2_closed")
def v11_border(spark, sf):
    m = nodes.merged_nodes(fx.border_voxels(spark, sf), fx.border_volumes(spark, sf))
    return m.select("case_id", "merge_mm", "z", "y", "x")


@query("v12_components", "SELECT case_id, z, y, x, comp_id FROM m2_comp")
def v12(spark, sf):
    return nodes.merged_nodes(fx.voxels(spark, sf), fx.volumes(spark, sf)).select("case_id", "z", "y", "x", "comp_id")


@query("v12_components_small_cubes", "SELECT case_id, z, y, x, comp_id FROM m2_comp")
def v12_small(spark, sf):
    """Cubes of four voxels, so components cross their faces."""
    return nodes.merged_nodes(fx.voxels(spark, sf), fx.volumes(spark, sf), block=4).select("case_id", "z", "y", "x", "comp_id")


MEASURES = ("vol_ml", "max_mm", "suvmax", "cx_mm", "cy_mm", "cz_mm")


@query("v13_node_measures", f"SELECT case_id, merge_mm, comp_id, nvox, {sql6(*MEASURES)} FROM m2_nodes")
def v13(spark, sf):
    head = fx.volumes(spark, sf)
    n = nodes.measure_nodes(nodes.merged_nodes(fx.voxels(spark, sf), head), head)
    return n.select("case_id", "merge_mm", "comp_id", "nvox", *r6(*MEASURES))


@query("v19_case_geometry", "SELECT * FROM geometry")
def v19(spark, sf):
    vox, head = fx.voxels(spark, sf), fx.volumes(spark, sf)
    return nodes.case_geometry(nodes.clean_mask(vox, head), head, nodes.body_midline(vox, head))


def n_stage_per_case(spark, sf):
    vox, head = fx.voxels(spark, sf), fx.volumes(spark, sf)
    geometry = nodes.case_geometry(nodes.clean_mask(vox, head), head, nodes.image_midline(head))
    return geometry.withColumn("n_stage", staging.rule_n("n_gtvn", "max_node_mm", "laterality"))


query("n_stage_per_case", f"SELECT *, {views.rule()} AS n_stage FROM geometry_image")(n_stage_per_case)


@query("n_stage_small_cubes", f"SELECT *, {views.rule()} AS n_stage FROM geometry_image")
def n_stage_small(spark, sf):
    vox, head = fx.voxels(spark, sf), fx.volumes(spark, sf)
    geometry = nodes.case_geometry(nodes.clean_mask(vox, head, block=4), head, nodes.image_midline(head), block=4)
    return geometry.withColumn("n_stage", staging.rule_n("n_gtvn", "max_node_mm", "laterality"))


# ------------------------------------------------------------- V14-V21 more nodes
GATES = {"both": nodes.NodeGate(), "either": nodes.NodeGate(mode="either"), "legacy": nodes.LEGACY_GATE}


@query("v14_node_gate", """SELECT case_id, comp_id, vol_ml >= 1.5 AND suvmax >= 3 AND max_mm >= 8 AS keep_both,
  vol_ml >= 1.5 AND (suvmax >= 3 OR max_mm >= 8) AS keep_either, suvmax >= 2.5 OR max_mm >= 10 AS keep_legacy FROM m2_nodes""")
def v14(spark, sf):
    head = fx.volumes(spark, sf)
    n = nodes.measure_nodes(nodes.merged_nodes(fx.voxels(spark, sf), head), head)
    return n.select("case_id", "comp_id", *[g.passes().alias(f"keep_{k}") for k, g in GATES.items()])


@query("v15_cleaned_mask", "SELECT case_id, z, y, x, label FROM cleaned")
def v15(spark, sf):
    return nodes.clean_mask(fx.voxels(spark, sf), fx.volumes(spark, sf)).select("case_id", "z", "y", "x", "label")


@query("v15_cleaned_without_pet", "SELECT case_id, z, y, x, label FROM cleaned WHERE label = 1")
def v15_no_pet(spark, sf):
    """Without PET every closed group is cold and its original voxels go."""
    cold = fx.voxels(spark, sf).withColumn("pet", F.lit(None).cast("double"))
    return nodes.clean_mask(cold, fx.volumes(spark, sf)).select("case_id", "z", "y", "x", "label")


@query("v16_largest_primary", "SELECT c.case_id, z, y, x FROM p1_comp c JOIN p1_keep k ON c.case_id = k.case_id AND c.comp_id = k.comp_id")
def v16(spark, sf):
    return nodes.largest_component(fx.voxels(spark, sf)).select("case_id", "z", "y", "x")


@query("v17_midline", "SELECT case_id, round(midline_mm, 7) AS midline_mm FROM midline")
def v17(spark, sf):
    return nodes.body_midline(fx.voxels(spark, sf), fx.volumes(spark, sf)).select("case_id", *r6("midline_mm"))


@query("v18_node_sides", """SELECT case_id, comp_id, CASE WHEN cx_mm > midline_mm + 6 THEN 'R' WHEN cx_mm < midline_mm - 6 THEN 'L' ELSE 'mid' END AS side
  FROM m2_nodes JOIN midline USING (case_id)""")
def v18(spark, sf):
    vox, head = fx.voxels(spark, sf), fx.volumes(spark, sf)
    n = nodes.measure_nodes(nodes.merged_nodes(vox, head), head)
    return n.join(nodes.body_midline(vox, head), "case_id").select(
        "case_id", "comp_id", nodes.side_of(F.col("cx_mm"), F.col("midline_mm")).alias("side"))


views.closing_views("m4", "gtvn", "fx_volumes", [0.0, 2.0, 4.0, 6.0])
views.component_views("m4", "m4_closed", ["case_id", "merge_mm"])
views.node_views("m4", "fx_voxels", "fx_volumes", 999.0)


def multi_radius(spark, sf):
    head = fx.volumes(spark, sf)
    merged = nodes.merged_nodes(fx.voxels(spark, sf), head, merge_mm=nodes.MERGE_RADII_MM)
    return nodes.measure_nodes(merged, head, missing_pet=999.0)


@query("v20_multi_radius_nodes", f"SELECT case_id, merge_mm, comp_id, nvox, {sql6('vol_ml', 'max_mm', 'suvmax', 'cx_mm')} FROM m4_nodes")
def v20(spark, sf):
    return multi_radius(spark, sf).select("case_id", "merge_mm", "comp_id", "nvox", *r6("vol_ml", "max_mm", "suvmax", "cx_mm"))


@query("v21_features_per_setting", """SELECT case_id, merge_mm, cast(count(*) AS BIGINT) AS n, round(max(max_mm), 7) AS mm,
    CASE WHEN bool_or(cx_mm > midline_mm + 6) AND bool_or(cx_mm < midline_mm - 6) THEN 'bilateral'
         WHEN bool_or(cx_mm > midline_mm + 6) OR bool_or(cx_mm < midline_mm - 6) THEN 'unilateral' ELSE 'midline' END AS laterality
  FROM m4_nodes JOIN midline USING (case_id) WHERE vol_ml >= 1.5 AND (suvmax >= 3 AND max_mm >= 8) GROUP BY 1, 2""")
def v21(spark, sf):
    from voxcohort.operators import sweep
    mid = nodes.body_midline(fx.voxels(spark, sf), fx.volumes(spark, sf))
    f = sweep.setting_features(sweep.node_profiles(multi_radius(spark, sf), mid))
    at = {k: sweep.CLEANUP_GRID[k].index(v) for k, v in (("min_ml", 1.5), ("suv", 3.0), ("diam", 8.0))}
    f = f.where((F.col("mode") == "both") & (F.col("i_ml") == at["min_ml"]) & (F.col("i_suv") == at["suv"]) & (F.col("i_diam") == at["diam"]))
    return f.select("case_id", "merge_mm", "n", *r6("mm"), nodes.laterality_of(F.col("n"), F.col("l"), F.col("r")).alias("laterality"))


view("sweep_truth", "SELECT case_id, concat('N', (case_id * 7 + case_id // 3) % 4) AS y FROM fx_volumes", ("fx_volumes",))
view("sweep_grid", """SELECT * FROM (VALUES (0,0.0),(1,2.0),(2,4.0),(3,6.0)) a(i1, merge_mm), (VALUES (0,'either'),(1,'both')) b(i2, mode),
  (VALUES (0,0.3),(1,0.5),(2,0.8),(3,1.0),(4,1.5),(5,2.0),(6,3.0)) c(i3, min_ml), (VALUES (0,0.0),(1,1.5),(2,2.0),(3,2.5),(4,3.0),(5,4.0)) d(i4, suv),
  (VALUES (0,8.0),(1,10.0),(2,12.0),(3,15.0)) e(i5, diam)""")
view("sweep_features", """SELECT g.*, t.case_id, t.y, count(n.comp_id) AS n, max(n.max_mm) AS mm,
    bool_or(cx_mm > midline_mm + 6) AS r, bool_or(cx_mm < midline_mm - 6) AS l
  FROM sweep_grid g CROSS JOIN (SELECT * FROM sweep_truth JOIN midline USING (case_id)) t
  LEFT JOIN m4_nodes n ON n.case_id = t.case_id AND n.merge_mm = g.merge_mm AND n.vol_ml >= g.min_ml
    AND CASE WHEN g.mode = 'either' THEN n.suvmax >= g.suv OR n.max_mm >= g.diam ELSE n.suvmax >= g.suv AND n.max_mm >= g.diam END
  GROUP BY ALL""", ("sweep_grid", "sweep_truth", "midline", "m4_nodes"))
view("sweep_scores", f"""SELECT ((((i1*2+i2)*7+i3)*6+i4)*4+i5)*25 + i6*5 + i7 AS grid_idx, avg(recall) AS ba FROM (
  SELECT i1, i2, i3, i4, i5, i6, i7, y, avg(CASE WHEN {views.rule('n', 'mm', "(CASE WHEN n = 0 THEN 'none' WHEN l AND r THEN 'bilateral' WHEN l OR r THEN 'unilateral' ELSE 'midline' END)", 'n3', 'n1')} = y THEN 1.0 ELSE 0.0 END) AS recall
  FROM sweep_features, (VALUES (0,45),(1,50),(2,55),(3,60),(4,65)) f(i6, n3), (VALUES (0,20),(1,25),(2,30),(3,35),(4,40)) h(i7, n1)
  GROUP BY ALL) GROUP BY ALL""", ("sweep_features",))


@query("v21_features_every_setting", """SELECT case_id, cast(merge_mm AS DOUBLE) AS merge_mm, mode, cast(i3 AS INT) AS i_ml, cast(i4 AS INT) AS i_suv, cast(i5 AS INT) AS i_diam, n, round(mm, 7) AS mm,
    CASE WHEN l AND r THEN 'bilateral' WHEN l OR r THEN 'unilateral' ELSE 'midline' END AS laterality FROM sweep_features WHERE n > 0""")
def v21_all(spark, sf):
    """Case features under all 1,344 cleanup settings that leave a node."""
    from voxcohort.operators import sweep
    mid = nodes.body_midline(fx.voxels(spark, sf), fx.volumes(spark, sf))
    f = sweep.setting_features(sweep.node_profiles(multi_radius(spark, sf), mid))
    return f.select("case_id", "merge_mm", "mode", *[F.col(f"i_{k}").cast("int").alias(f"i_{k}") for k in ("ml", "suv", "diam")], "n", *r6("mm"),
                    nodes.laterality_of(F.col("n"), F.col("l"), F.col("r")).alias("laterality"))


def sweep_scores(spark, sf):
    from voxcohort.operators import sweep
    head = fx.volumes(spark, sf)
    truth = head.select("case_id", F.expr("concat('N', (case_id * 7 + case_id div 3) % 4)").alias("y"))
    return sweep.cleanup_sweep(multi_radius(spark, sf), nodes.body_midline(fx.voxels(spark, sf), head), truth)


@query("r6_cleanup_sweep", "SELECT cast(grid_idx AS INT) AS grid_idx, round(ba, 7) AS balanced_accuracy FROM sweep_scores")
def r6_sweep(spark, sf):
    return sweep_scores(spark, sf).select("grid_idx", *r6("balanced_accuracy"))


@query("r6_best_cleanup", "SELECT cast(grid_idx AS INT) AS grid_idx, round(ba, 7) AS balanced_accuracy FROM sweep_scores ORDER BY round(ba, 12) DESC, grid_idx LIMIT 1")
def r6_best(spark, sf):
    from voxcohort.operators import sweep
    return sweep.first_best(sweep_scores(spark, sf)).select("grid_idx", *r6("balanced_accuracy"))


@query("v19_geometry_image_midline", "SELECT * FROM geometry_image")
def v19_image(spark, sf):
    vox, head = fx.voxels(spark, sf), fx.volumes(spark, sf)
    return nodes.case_geometry(nodes.clean_mask(vox, head), head, nodes.image_midline(head))


# ------------------------------------------------------------ V1-V10 image geometry
@query("v1_resampled_voxels", "SELECT case_id, round(nx*sx/0.9765620231628418 * (ny*sy/0.9765620231628418) * (nz*sz/1.5), 4) AS est FROM fx_volumes")
def v1(spark, sf):
    return fx.volumes(spark, sf).select("case_id", F.round(crop.resampled_voxels(), 4).alias("est"))


@query("v2_physical_points", "SELECT case_id, z, y, x, round(x*sx, 7) AS px, round(y*sy, 7) AS py, round(dz*z*sz, 7) AS pz FROM fx_voxels JOIN fx_volumes USING (case_id) WHERE label > 0")
def v2(spark, sf):
    v = fx.voxels(spark, sf).where("label > 0").join(fx.volumes(spark, sf), "case_id")
    at = [F.col(a) for a in "xyz"]
    return v.select("case_id", "z", "y", "x", *[F.round(crop.physical(a, *at), 7).alias(f"p{a}") for a in "xyz"])


@query("v3_body_slices", "SELECT case_id, z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_voxels WHERE ct > -500 GROUP BY 1, 2")
def v3(spark, sf):
    return crop.body_slices(fx.voxels(spark, sf))


view("slices", "SELECT case_id, z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_voxels WHERE ct > -500 GROUP BY 1, 2", ("fx_voxels",))


def box_view(name, slab, margin):
    view(f"{name}_slab", f"""SELECT case_id, min(k) AS k0, max(k) AS k1 FROM (
        SELECT h.case_id, k, dz*k*sz AS zk, CASE WHEN dz > 0 THEN max_z ELSE -min_z END AS top, sz FROM fx_volumes h
        JOIN (SELECT case_id, max(z) AS max_z, min(z) AS min_z FROM slices GROUP BY 1) b USING (case_id), range(0, 12) r(k))
      WHERE zk >= top*sz - {slab} GROUP BY 1""", ("fx_volumes", "slices"))
    view(name, f"""SELECT h.case_id, cast(coalesce(greatest(0, bx0 - round_even({margin}/sx, 0)), 0) AS INT) AS x0,
        cast(coalesce(greatest(0, by0 - round_even({margin}/sy, 0)), 0) AS INT) AS y0, cast(coalesce(k0, 0) AS INT) AS z0,
        cast(coalesce(least(nx-1, bx1 + round_even({margin}/sx, 0)) - greatest(0, bx0 - round_even({margin}/sx, 0)) + 1, nx) AS INT) AS dx,
        cast(coalesce(least(ny-1, by1 + round_even({margin}/sy, 0)) - greatest(0, by0 - round_even({margin}/sy, 0)) + 1, ny) AS INT) AS dy,
        cast(coalesce(k1 - k0 + 1, nz) AS INT) AS dz
      FROM fx_volumes h LEFT JOIN (SELECT s.case_id, min(x0) AS bx0, max(x1) AS bx1, min(y0) AS by0, max(y1) AS by1, any_value(k0) AS k0, any_value(k1) AS k1
        FROM slices s JOIN {name}_slab b ON b.case_id = s.case_id AND s.z BETWEEN k0 AND k1 GROUP BY 1) p USING (case_id)""",
         ("fx_volumes", "slices", f"{name}_slab"))


box_view("box20", 20.0, 5.0)
box_view("box400", 400.0, 25.0)


def box(spark, sf, slab=20.0, margin=5.0):
    return crop.crop_box(crop.body_slices(fx.voxels(spark, sf)), fx.volumes(spark, sf), slab, margin)


@query("v4_crop_box", "SELECT * FROM box400")
def v4(spark, sf):
    return box(spark, sf, crop.SLAB_MM, crop.MARGIN_MM)


@query("v4_crop_box_small_slab", "SELECT * FROM box20")
def v4_small(spark, sf):
    return box(spark, sf)


@query("v5_gated_box", """SELECT case_id, CASE WHEN s THEN 0 ELSE b.x0 END AS x0, CASE WHEN s THEN 0 ELSE b.y0 END AS y0, CASE WHEN s THEN 0 ELSE b.z0 END AS z0,
  CASE WHEN s THEN nx ELSE b.dx END AS dx, CASE WHEN s THEN ny ELSE b.dy END AS dy, CASE WHEN s THEN nz ELSE b.dz END AS dz, NOT s AS cropped
  FROM (SELECT *, nx*sx/0.9765620231628418 * (ny*sy/0.9765620231628418) * (nz*sz/1.5) <= 20000 AS s FROM fx_volumes) h JOIN box20 b USING (case_id)""".replace("SELECT *, nx*sx", "SELECT case_id, nx, ny, nz, nx*sx"))
def v5(spark, sf):
    return crop.gated_box(box(spark, sf), fx.volumes(spark, sf), gate=20000)


INSIDE = "v.x >= x0 AND v.x < x0 + dx AND v.y >= y0 AND v.y < y0 + dy AND v.z >= z0 AND v.z < z0 + dz"


@query("v6_apply_crop", f"SELECT v.case_id, v.z - z0 AS z, v.y - y0 AS y, v.x - x0 AS x, label FROM fx_voxels v JOIN box20 b ON v.case_id = b.case_id WHERE {INSIDE}")
def v6(spark, sf):
    return crop.apply_crop(fx.voxels(spark, sf), box(spark, sf)).select("case_id", "z", "y", "x", "label")


@query("v8_same_grid", "SELECT case_id, case_id % 4 <> 0 AND case_id % 3 <> 0 AS same, case_id % 3 <> 0 AS same_size FROM fx_volumes")
def v8(spark, sf):
    h = fx.volumes(spark, sf)
    other = h.withColumns({"sz": F.when(F.col("case_id") % 4 == 0, F.col("sz") + 0.01).otherwise(F.col("sz") + 0.0005),
                           "nx": F.when(F.col("case_id") % 3 == 0, F.col("nx") + 1).otherwise(F.col("nx"))})
    return crop.same_grid(h, other).join(crop.same_grid(h, other, None).withColumnRenamed("same", "same_size"), "case_id")


@query("v9_paste_back", f"SELECT v.case_id, v.z, v.y, v.x, label FROM fx_voxels v JOIN box20 b ON v.case_id = b.case_id WHERE {INSIDE} AND label > 0")
def v9(spark, sf):
    b = box(spark, sf)
    return crop.paste_back(crop.apply_crop(fx.voxels(spark, sf).where("label > 0"), b), b).select("case_id", "z", "y", "x", "label")


@query("v10_padded_bounds", "SELECT case_id, " + ", ".join(
    f"cast(greatest({a}lo - pad, 0) AS INT) AS {a}_lo, cast(least({a}hi + pad, n{a}) AS INT) AS {a}_hi" for a in "zyx") + """
  FROM (SELECT case_id, min(z) AS zlo, max(z) AS zhi, min(y) AS ylo, max(y) AS yhi, min(x) AS xlo, max(x) AS xhi FROM gtvn GROUP BY 1)
  JOIN (SELECT *, greatest(1, ceil(2.0 / least(sx, sy, sz))) + 1 AS pad FROM fx_volumes) USING (case_id)""")
def v10(spark, sf):
    return crop.padded_bounds(fx.voxels(spark, sf).where("label = 2"), fx.volumes(spark, sf))


# ------------------------------------------------------ V22-V29 extent, Dice, reports
view("extent", """SELECT h.case_id, round_even(abs(dz*(nz-1)*sz), 1) AS ct_z_extent_mm,
    round_even(greatest(0, dz*(nz-1)*sz) - greatest(dz*lo*sz, dz*hi*sz), 1) AS depth_top_mm,
    round_even(greatest(0, dz*(nz-1)*sz) - least(dz*lo*sz, dz*hi*sz), 1) AS depth_bot_mm,
    round_even(abs(dz*hi*sz - dz*lo*sz), 1) AS lesion_span_mm, coalesce(n, 0) AS n_lesion_vox
  FROM fx_volumes h LEFT JOIN (SELECT case_id, min(z) AS lo, max(z) AS hi, count(*) AS n FROM fx_voxels WHERE label > 0 GROUP BY 1) l USING (case_id)""",
     ("fx_volumes", "fx_voxels"))


def extent(spark, sf):
    return crop.disease_extent(fx.voxels(spark, sf), fx.volumes(spark, sf))


@query("v22_disease_extent", "SELECT * FROM extent")
def v22(spark, sf):
    return extent(spark, sf)


@query("v23_extent_summary", """SELECT subset, round(quantile_cont(d, 0.5), 7) AS p50, round(quantile_cont(d, 0.9), 7) AS p90, round(quantile_cont(d, 0.95), 7) AS p95,
  round(quantile_cont(d, 0.99), 7) AS p99, count(*) AS n, max(d) AS max, cast(ceil((max(d) + 60) / 10) AS INT) * 10 AS slab_mm
  FROM (SELECT 'all' AS subset, depth_bot_mm AS d FROM extent UNION ALL SELECT 'large', depth_bot_mm FROM extent WHERE ct_z_extent_mm > 50)
  WHERE d IS NOT NULL GROUP BY 1""")
def v23(spark, sf):
    s = crop.extent_summary(extent(spark, sf), large_mm=50.0)
    return s.select("subset", *r6("p50", "p90", "p95", "p99"), "n", "max", "slab_mm")


view("dice_cells", """SELECT h.case_id, label, count(t) AS t, count(p) AS p, count(CASE WHEN t = 1 AND p = 1 THEN 1 END) AS hit
  FROM fx_volumes h, (VALUES (1),(2)) l(label) LEFT JOIN (
    SELECT coalesce(a.case_id, b.case_id) AS cid, coalesce(a.label, b.label) AS lab, CASE WHEN a.case_id IS NOT NULL THEN 1 END AS t, CASE WHEN b.case_id IS NOT NULL THEN 1 END AS p
    FROM (SELECT * FROM fx_truth WHERE label > 0) a FULL JOIN (SELECT * FROM fx_voxels WHERE label > 0) b
    ON a.case_id = b.case_id AND a.z = b.z AND a.y = b.y AND a.x = b.x AND a.label = b.label) j ON j.cid = h.case_id AND j.lab = label
  GROUP BY 1, 2""", ("fx_volumes", "fx_truth", "fx_voxels"))
view("dice", "SELECT case_id, label, CASE WHEN t = 0 AND p = 0 THEN 1.0 WHEN t = 0 OR p = 0 THEN 0.0 ELSE 2.0 * hit / (t + p) END::DOUBLE AS dice, t AS truth_vox, p AS pred_vox FROM dice_cells", ("dice_cells",))


@query("v24_dice", "SELECT case_id, label, round(dice, 7) AS dice, truth_vox, pred_vox FROM dice")
def v24(spark, sf):
    d = crop.dice(fx.truth(spark, sf), fx.voxels(spark, sf), fx.volumes(spark, sf))
    return d.withColumn("dice", F.round("dice", 7))


@query("v25_voxels_lost", f"SELECT v.case_id, count_if(NOT ({INSIDE})) AS lost FROM fx_truth v JOIN box20 b ON v.case_id = b.case_id WHERE label > 0 GROUP BY 1")
def v25(spark, sf):
    return crop.voxels_lost(fx.truth(spark, sf), box(spark, sf))


view("dice_pair", f"""SELECT d.case_id, d.label, d.dice AS before, truth_vox, coalesce(a.dice, 0) AS after FROM dice d LEFT JOIN (
    SELECT case_id, label, 2.0 * count(t) / (any_value(tv) + count(*)) AS dice FROM (
      SELECT v.case_id, v.label, t.case_id AS t, s.t AS tv FROM fx_voxels v JOIN box20 b ON v.case_id = b.case_id AND {INSIDE}
      LEFT JOIN fx_truth t ON t.case_id = v.case_id AND t.z = v.z AND t.y = v.y AND t.x = v.x AND t.label = v.label
      JOIN dice_cells s ON s.case_id = v.case_id AND s.label = v.label WHERE v.label > 0) GROUP BY 1, 2) a ON a.case_id = d.case_id AND a.label = d.label
    WHERE truth_vox > 0""", ("dice", "fx_voxels", "box20", "fx_truth", "dice_cells"))
view("dice_label", "SELECT cast(label AS VARCHAR) AS label, avg(before) AS before, avg(after) AS after FROM dice_pair GROUP BY 1", ("dice_pair",))


@query("v26_paired_dice", """SELECT label, round(before, 7) AS before, round(after, 7) AS after, round(after - before, 7) AS diff FROM
  (SELECT * FROM dice_label UNION ALL SELECT 'mean', avg(before), avg(after) FROM dice_label)""")
def v26(spark, sf):
    t, v, h = fx.truth(spark, sf), fx.voxels(spark, sf), fx.volumes(spark, sf)
    b = box(spark, sf)
    cropped = crop.paste_back(crop.apply_crop(v.where("label > 0"), b), b)
    return crop.paired_dice(crop.dice(t, v, h), crop.dice(t, cropped, h)).select("label", *r6("before", "after", "diff"))


@query("v27_pick_cases", """(SELECT case_id, ct_z_extent_mm, 'large' AS kind FROM extent ORDER BY ct_z_extent_mm DESC, case_id LIMIT 8) UNION ALL
  (SELECT case_id, ct_z_extent_mm, 'typical' FROM extent ORDER BY abs(ct_z_extent_mm - (SELECT median(ct_z_extent_mm) FROM extent)), ct_z_extent_mm DESC, case_id LIMIT 8)""")
def v27(spark, sf):
    return crop.pick_cases(extent(spark, sf))


@query("v28_fov_report", "SELECT round(min(z), 7) AS z_min, round(median(z), 7) AS z_median, round(quantile_cont(z, 0.9), 7) AS z_p90, round(max(z), 7) AS z_max FROM (SELECT nz*sz AS z FROM fx_volumes)")
def v28(spark, sf):
    return crop.fov_report(fx.volumes(spark, sf)).select(*r6("z_min", "z_median", "z_p90", "z_max"))


view("body_len", """SELECT h.case_id, CASE WHEN k >= 2 THEN len ELSE nz END * sz AS body_len_mm FROM fx_volumes h
  LEFT JOIN (SELECT case_id, count(*) AS k, max(z) - min(z) + 1 AS len FROM slices GROUP BY 1) USING (case_id)""", ("fx_volumes", "slices"))


@query("v29_body_length", "SELECT case_id, round(body_len_mm, 7) AS body_len_mm FROM body_len")
def v29(spark, sf):
    return crop.body_length(crop.body_slices(fx.voxels(spark, sf)), fx.volumes(spark, sf)).select("case_id", *r6("body_len_mm"))


# ------------------------------------------------------------------ V30-V36 spread
def spread_views(prefix, mask):
    """Dissemination views over a mask (case_id, z, y, x, label, pet)."""
    view(f"{prefix}_pts", f"SELECT m.case_id, m.z*sz AS pz, m.y*sy AS py, m.x*sx AS px, m.z, m.y, m.x FROM {mask} m JOIN fx_volumes h ON m.case_id = h.case_id WHERE label > 0", (mask, "fx_volumes"))
    view(f"{prefix}_far", f"""SELECT a.case_id, max(d) AS top, CASE WHEN count(*) > any_value(n) THEN sum(d) / (count(*) - any_value(n)) ELSE 0 END AS mean FROM (
        SELECT a.case_id, sqrt((a.pz-b.pz)**2 + (a.py-b.py)**2 + (a.px-b.px)**2) AS d FROM {prefix}_pts a JOIN {prefix}_pts b USING (case_id)) a
        JOIN (SELECT case_id, count(*) AS n FROM {prefix}_pts GROUP BY 1) s ON s.case_id = a.case_id GROUP BY 1""", (f"{prefix}_pts",))
    view(f"{prefix}_all", f"SELECT case_id, z, y, x FROM {mask} WHERE label > 0", (mask,))
    view(f"{prefix}_node", f"SELECT case_id, z, y, x FROM {mask} WHERE label = 2", (mask,))
    views.component_views(f"{prefix}a", f"{prefix}_all", ["case_id"])
    views.component_views(f"{prefix}n", f"{prefix}_node", ["case_id"])
    view(f"{prefix}_cen", f"SELECT c.case_id, comp_id, count(*) AS nvox, avg(z)*any_value(sz) AS pz, avg(y)*any_value(sy) AS py, avg(x)*any_value(sx) AS px FROM {prefix}a_comp c JOIN fx_volumes h ON h.case_id = c.case_id GROUP BY 1, 2", (f"{prefix}a_comp", "fx_volumes"))
    view(f"{prefix}_ncen", f"SELECT c.case_id, comp_id, avg(z)*any_value(sz) AS pz, avg(y)*any_value(sy) AS py, avg(x)*any_value(sx) AS px FROM {prefix}n_comp c JOIN fx_volumes h ON h.case_id = c.case_id GROUP BY 1, 2", (f"{prefix}n_comp", "fx_volumes"))
    view(f"{prefix}_burden", f"SELECT c.case_id, count(*) AS n_lesions, max(nvox) / sum(nvox) AS frac_largest, sum(nvox)::DOUBLE * any_value(sz*sy*sx/1000.0) AS total_lesion_ml FROM {prefix}_cen c JOIN fx_volumes h ON h.case_id = c.case_id GROUP BY 1", (f"{prefix}_cen", "fx_volumes"))
    view(f"{prefix}_cspread", f"""SELECT case_id, CASE WHEN count(*) > any_value(n) THEN sum(d) / (count(*) - any_value(n)) ELSE 0 END AS centroid_spread_mm, max(d) AS centroid_max_mm FROM (
        SELECT a.case_id, n, sqrt((a.pz-b.pz)**2 + (a.py-b.py)**2 + (a.px-b.px)**2) AS d FROM {prefix}_cen a JOIN {prefix}_cen b USING (case_id)
        JOIN (SELECT case_id, count(*) AS n FROM {prefix}_cen GROUP BY 1) USING (case_id)) GROUP BY 1""", (f"{prefix}_cen",))
    view(f"{prefix}_pn", f"""SELECT p.case_id, max(d) AS top, avg(d) AS mean FROM (SELECT p.case_id, sqrt((p.pz-n.pz)**2 + (p.py-n.py)**2 + (p.px-n.px)**2) AS d FROM (
        SELECT m.case_id, avg(z)*any_value(sz) AS pz, avg(y)*any_value(sy) AS py, avg(x)*any_value(sx) AS px FROM {mask} m JOIN fx_volumes h ON h.case_id = m.case_id WHERE label = 1 GROUP BY 1) p
        JOIN {prefix}_ncen n USING (case_id)) p GROUP BY 1""", (mask, "fx_volumes", f"{prefix}_ncen"))
    view(f"{prefix}_uptake", f"""SELECT case_id, count_if(label = 2)::DOUBLE / nullif(count_if(label = 1), 0) AS gtvn_to_gtvp_ratio, CASE WHEN avg(pet) > 0 THEN max(pet) END AS suv_max_all,
        CASE WHEN avg(pet) > 0 THEN avg(pet) END AS suv_mean_all, CASE WHEN avg(pet) > 0 THEN max(pet)/avg(pet) END AS suv_hetero,
        CASE WHEN avg(pet) > 0 THEN stddev_pop(pet) END AS suv_std_all FROM {mask} WHERE label > 0 GROUP BY 1""", (mask,))


spread_views("dr", "fx_voxels")
spread_views("dc", "cleaned")


@query("v30_lesion_spread", 'SELECT case_id, round(top, 7) AS "Dmax_mm", round(mean, 7) AS spread_mean_mm FROM dr_far')
def v30(spark, sf):
    return spread.lesion_spread(fx.voxels(spark, sf).where("label > 0"), fx.volumes(spark, sf)).select("case_id", *r6("Dmax_mm", "spread_mean_mm"))


@query("v31_burden", f"SELECT case_id, n_lesions, {sql6('frac_largest', 'total_lesion_ml')} FROM dr_burden")
def v31(spark, sf):
    b = spread.burden(spread.lesion_components(fx.voxels(spark, sf)), fx.volumes(spark, sf))
    return b.select("case_id", "n_lesions", *r6("frac_largest", "total_lesion_ml"))


@query("v32_centroid_spread", f"SELECT case_id, {sql6('centroid_spread_mm', 'centroid_max_mm')} FROM dr_cspread")
def v32(spark, sf):
    c = spread.centroid_spread(spread.lesion_components(fx.voxels(spark, sf)), fx.volumes(spark, sf))
    return c.select("case_id", *r6("centroid_spread_mm", "centroid_max_mm"))


@query("v33_primary_to_nodes", """SELECT case_id, round(coalesce(top, 0), 7) AS dist_p_to_n_max_mm, round(coalesce(mean, 0), 7) AS dist_p_to_n_mean_mm
  FROM (SELECT DISTINCT case_id FROM fx_voxels WHERE label > 0) LEFT JOIN dr_pn USING (case_id)""")
def v33(spark, sf):
    v, h = fx.voxels(spark, sf), fx.volumes(spark, sf)
    return spread.primary_to_nodes(v, spread.lesion_components(v), h).select("case_id", *r6("dist_p_to_n_max_mm", "dist_p_to_n_mean_mm"))


@query("v34_volume_ratio", f"SELECT case_id, {sql6('gtvn_to_gtvp_ratio')} FROM dr_uptake")
def v34(spark, sf):
    return spread.uptake(fx.voxels(spark, sf), fx.volumes(spark, sf)).select("case_id", *r6("gtvn_to_gtvp_ratio"))


SUV = ("suv_max_all", "suv_mean_all", "suv_hetero", "suv_std_all")


@query("v35_uptake", f"SELECT case_id, {sql6(*SUV)} FROM dr_uptake")
def v35(spark, sf):
    return spread.uptake(fx.voxels(spark, sf), fx.volumes(spark, sf)).select("case_id", *r6(*SUV))


@query("j11_pairwise_distances", 'SELECT case_id, n, round(mean, 7) AS mean_mm, round(top, 7) AS max_mm FROM dr_far JOIN (SELECT case_id, count(*) AS n FROM dr_pts GROUP BY 1) USING (case_id)')
def j11(spark, sf):
    points = spread._in_mm(fx.voxels(spark, sf).where("label > 0"), fx.volumes(spark, sf), ["case_id"])
    return spread.distance_stats(points, ["case_id"]).select("case_id", "n", *r6("mean_mm", "max_mm"))


DIS = [c for c in schema.DISSEMINATION if c not in ("case_id", "has_lesion", "n_lesions")]


@query("v36_dissemination", "SELECT h.case_id, cast(n_lesions IS NOT NULL AS INT) AS has_lesion, n_lesions, " + ", ".join(
    f'round({e}, 7) AS "{c}"' for c, e in {**{c: c for c in DIS}, "Dmax_mm": "f.top", "spread_mean_mm": "f.mean",
     "body_len_mm": "CASE WHEN n_lesions IS NOT NULL THEN body_len_mm END", "Dmax_norm": "f.top / body_len_mm",
     "dist_p_to_n_max_mm": "CASE WHEN n_lesions IS NOT NULL THEN coalesce(p.top, 0) END",
     "dist_p_to_n_mean_mm": "CASE WHEN n_lesions IS NOT NULL THEN coalesce(p.mean, 0) END"}.items()) + """
  FROM fx_volumes h LEFT JOIN dc_far f ON f.case_id = h.case_id LEFT JOIN body_len l ON l.case_id = h.case_id LEFT JOIN dc_burden b ON b.case_id = h.case_id
  LEFT JOIN dc_cspread c ON c.case_id = h.case_id LEFT JOIN dc_pn p ON p.case_id = h.case_id LEFT JOIN dc_uptake u ON u.case_id = h.case_id""")
def v36(spark, sf):
    v, h = fx.voxels(spark, sf), fx.volumes(spark, sf)
    d = spread.dissemination(nodes.clean_mask(v, h), v, h)
    return d.select("case_id", "has_lesion", "n_lesions", *r6(*DIS))

"""Contract queries for batch scoring, the incremental job and pluggable hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort import fixtures as fx
from voxcohort.operators import crop, nodes, spread
from voxcohort.plans import scoring, views, voxel_queries
from voxcohort.plans.cohort_queries import _scratch
from voxcohort.plans.registry import ORACLES, query
from voxcohort.plans.views import rule
from voxcohort.streaming import incremental

# a small scoring state: feature, median, mean, scale, coefficient
STATE = [("gtvp_ml", 1.0, 1.2, 2.0, 0.3), ("n_gtvn", 1.0, 1.0, 1.0, 0.2), ("max_node_mm", 20.0, 22.0, 15.0, 0.1),
         ("gtvn_total_ml", 2.0, 3.0, 4.0, -0.1), ("N_ordinal", 1.0, 1.5, 1.0, 0.4), ("Age", 55.0, 54.0, 14.0, 0.25)]
LIN = " + ".join(f'{b} * (coalesce({f}, {m}) - {mu}) / {sd}' for f, m, mu, sd, b in STATE)


@query("m29_score_cases", f"""SELECT case_id, coalesce(CASE WHEN case_id % 3 = 0 THEN concat('T', 1 + case_id % 4) END, 'T2') AS t_stage,
  CASE WHEN case_id % 5 = 0 THEN 'N2' ELSE n END AS n_stage, round(-exp({LIN}), 6) AS rfs FROM (
  SELECT g.*, c.Age, {rule()} AS n, CASE {rule()} WHEN 'N0' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 ELSE 3 END AS "N_ordinal"
  FROM geometry_image g LEFT JOIN fx_clinical c ON c.c_custkey = g.case_id)""")
def m29(spark, sf):
    vox, head = fx.voxels(spark, sf), fx.volumes(spark, sf)
    state = spark.createDataFrame(STATE, "feature string, med double, mu double, sd double, beta double")
    records = fx.clinical(spark, sf).select(F.col("c_custkey").alias("case_id"), "Age")
    n = head.where("case_id % 5 = 0").select("case_id", F.lit("N2").alias("stage"))
    t = head.where("case_id % 3 = 0").select("case_id", (1 + F.col("case_id") % 4).cast("string").alias("stage"))
    out = scoring.score_cases(vox, head, records, state, n, t)
    return out.select("case_id", "t_stage", "n_stage", F.round("rfs", 6).alias("rfs"))


@query("st1_incremental_features", None)
def st1(spark, sf):
    """Four drops over two runs of the stream: one delivered twice, and one case in each run's files in part."""
    root = _scratch(spark, "arrivals")
    head = fx.volumes(spark, sf)

    def compute(voxels):
        h = head.join(voxels.select("case_id").distinct(), "case_id", "left_semi")
        return spread.dissemination(nodes.clean_mask(voxels, h), voxels, h)

    vox = fx.voxels(spark, sf)
    expected = vox.groupBy("case_id").agg(F.count("*").alias("n_voxels"))
    late = (F.col("case_id") % 5 == 0) & (F.col("z") % 2 == 1)      # half of every fifth case arrives in the second run
    vox = vox.withColumn("drop", F.when(late, 3).otherwise(F.col("case_id") % 3))
    for run, drops in enumerate(((0, 1), (0, 2, 3))):
        for d in drops:
            vox.where(F.col("drop") == d).drop("drop").write.parquet(f"{root}/in/run{run}-{d}")
        incremental.run_available(spark, f"{root}/in", f"{root}/out", f"{root}/ckpt", compute, expected)
    out = spark.read.parquet(f"{root}/out")
    return out.select("case_id", "has_lesion", "n_lesions", *voxel_queries.r6(*voxel_queries.DIS))


ORACLES["st1_incremental_features"] = ORACLES["v36_dissemination"]


@query("u1_rule_as_sql", f"SELECT PatientID, {rule()} AS n_stage FROM fx_cohort")
def u1(spark, sf):
    """The rule as an SQL expression, for callers that live in SQL."""
    return fx.cohort(spark, sf).select("PatientID", F.expr(rule()).alias("n_stage"))


@query("u3_physical_coordinate", "SELECT * FROM geometry_image")
def u3(spark, sf):
    """Sides judged on the physical x of the centroid instead of the voxel x."""
    vox, head = fx.voxels(spark, sf), fx.volumes(spark, sf)
    at = lambda x: crop.physical("x", x, F.lit(0.0), F.lit(0.0))
    middle = head.select("case_id", at(F.col("nx") / 2.0).alias("midline_mm"), "ox", "dir")
    return nodes.case_geometry(nodes.clean_mask(vox, head), head, middle,
                               x_mm=F.col("ox") + F.col("dir")[0] * F.col("cx_mm"))


views.closing_views("lg", "gtvn", "fx_volumes", [0.0])
views.component_views("lg", "lg_closed", ["case_id", "merge_mm"])
views.node_views("lg", "fx_voxels", "fx_volumes", 999.0)


@query("v14_legacy_cleanup", """SELECT case_id, z, y, x FROM fx_voxels v JOIN lg_comp c USING (case_id, z, y, x) JOIN lg_nodes n USING (case_id, merge_mm, comp_id)
  WHERE suvmax >= 2.5 OR max_mm >= 10 UNION ALL SELECT c.case_id, z, y, x FROM p1_comp c JOIN p1_keep k ON c.case_id = k.case_id AND c.comp_id = k.comp_id""")
def legacy(spark, sf):
    return nodes.clean_mask(fx.voxels(spark, sf), fx.volumes(spark, sf), nodes.LEGACY_GATE, merge_mm=0.0,
                            missing_pet=999.0).select("case_id", "z", "y", "x")

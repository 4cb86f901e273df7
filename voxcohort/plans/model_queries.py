"""Contract queries for model fitting, evaluation and scoring."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import functions as F

from voxcohort import fixtures as fx
from voxcohort.functions import clinical as cl
from voxcohort.functions import staging
from voxcohort.operators import boosting, classify as cy, crossed as cr
from voxcohort.operators import logistic as grouped
from voxcohort.operators import metrics, modelstate as ms, ranks
from voxcohort.operators import survival as sv
from voxcohort.plans import logistic_sql as lsql, scoring
from voxcohort.plans.cohort_queries import _scratch, pair_sql, r6, sql6, staged
from voxcohort.plans.registry import query, view
from voxcohort.plans.views import rule
from voxcohort.session import cut

BASE = ["gtvp_ml", "n_gtvn", "max_node_mm", "gtvn_total_ml", "N_ordinal", "Age", "Gender", "HPV", "HPV_missing"]
NUM = ["gtvp_ml", "n_gtvn", "max_node_mm", "gtvn_total_ml", "Age", "HPV"]
POOL = ["SUV_gtvp_Mean", "SUV_gtvn_Maximum", "n_orders", "TLG_gtvp"]
SIZE = ["max_node_mm", "gtvn_total_ml", "gtvp_ml"]
LAT = [f"lat_{v}" for v in cl.LATERALITY_LEVELS]


def outcome(spark, sf):
    df = cl.missing_flag(cl.valid_outcomes(fx.cohort(spark, sf)), "HPV")
    return df.withColumns({
        "N_ordinal": staging.n_ordinal(staging.rule_n("n_gtvn", "max_node_mm", "laterality")),
        "SUV_gtvp_Mean": F.col("gtvp_ml") / (1 + F.col("c_custkey") % 7), "SUV_gtvn_Maximum": F.col("max_node_mm") / (1 + F.col("c_custkey") % 5),
    }).withColumn("TLG_gtvp", cl.tlg("gtvp_ml", "SUV_gtvp_Mean"))


def cv_sets(spark, sf, by="fold"):
    return sv.guard_sets(sv.training_sets(outcome(spark, sf), by))


# ----------------------------------------------------------- M1, M2, M7 preparation
view("cv_long", " UNION ALL ".join(
    f"SELECT PatientID, center, RFS, event, fold, cast(f AS VARCHAR) AS g, fold IS DISTINCT FROM f AS train, '{c}' AS feature, cast({c} AS DOUBLE) AS v FROM fx_cohort, (VALUES (0),(1),(2),(3),(4)) t(f) WHERE RFS > 0"
    for c in NUM), ("fx_cohort",))
view("cv_med", "SELECT g, feature, median(v) AS med FROM cv_long WHERE train GROUP BY 1, 2", ("cv_long",))
view("cv_params", "SELECT g, feature, any_value(med) AS med, avg(coalesce(v, med)) AS mu, stddev_pop(coalesce(v, med)) AS sd FROM cv_long JOIN cv_med USING (g, feature) WHERE train GROUP BY 1, 2", ("cv_long", "cv_med"))
view("cv_z", "SELECT l.*, (coalesce(v, med) - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM cv_long l JOIN cv_params USING (g, feature)", ("cv_long", "cv_params"))


@query("m1_impute_scale_params", f"SELECT g, feature, {sql6('med', 'mu', 'sd')} FROM cv_params")
def m1(spark, sf):
    return sv.prep_params(cv_sets(spark, sf), NUM).select("g", "feature", *r6("med", "mu", "sd"))


@query("m1_standardised", "SELECT g, PatientID, feature, round(z, 7) AS z FROM cv_z WHERE NOT train")
def m1z(spark, sf):
    long = sv._prepared_long(cv_sets(spark, sf), NUM, ["PatientID"])
    return long.where("not train").select("g", "PatientID", "feature", F.round("value", 7).alias("z"))


view("stage_long", " UNION ALL ".join(
    f"SELECT PatientID, y, cast(f AS VARCHAR) AS g, '{c}' AS feature, cast({c} AS DOUBLE) AS v FROM staged, (VALUES (0),(1),(2),(3),(4)) t(f) WHERE fold IS DISTINCT FROM f"
    for c in NUM), ("staged",))
view("stage_f", """SELECT g, feature, (sum(n * (m - gm)**2) / (count(*) - 1)) / (sum(n * s2) / (sum(n) - count(*))) AS f FROM (
  SELECT *, sum(n * m) OVER (PARTITION BY g, feature) / sum(n) OVER (PARTITION BY g, feature) AS gm FROM (
    SELECT g, feature, y, count(*) AS n, avg(v) AS m, var_pop(v) AS s2 FROM (SELECT g, feature, y, coalesce(v, median(v) OVER (PARTITION BY g, feature)) AS v FROM stage_long) GROUP BY 1, 2, 3)) GROUP BY 1, 2""", ("stage_long",))


def stage_sets(spark, sf, by="fold"):
    return sv.training_sets(cl.laterality_flags(staged(spark, sf)).withColumnRenamed("y", "N"), by)


@query("m2_anova_f", "SELECT g, feature, round(f, 6) AS f FROM stage_f")
def m2(spark, sf):
    return cy.anova_f(stage_sets(spark, sf), NUM, "N").withColumn("f", F.round("f", 6))


@query("m2_top_features", "SELECT g, feature FROM stage_f QUALIFY row_number() OVER (PARTITION BY g ORDER BY f DESC NULLS LAST, feature) <= 3")
def m2k(spark, sf):
    return cy.select_top(cy.anova_f(stage_sets(spark, sf), NUM, "N"), 3).select("g", F.explode("chosen").alias("feature"))


@query("m7_balanced_weights", "SELECT cast(f AS VARCHAR) AS g, y AS \"N\", round(sum(count(*)) OVER (PARTITION BY f) / (count(*) OVER (PARTITION BY f) * count(*)), 7) AS weight FROM staged, (VALUES (0),(1),(2),(3),(4)) t(f) WHERE fold IS DISTINCT FROM f GROUP BY f, y")
def m7(spark, sf):
    return metrics.class_weights(stage_sets(spark, sf).where("train"), "N", ["g"]).select("g", "N", *r6("weight"))


# ------------------------------------------------------------- M3-M12 classifiers
def small_forest(n):
    return cy.forest(trees=400, depth=6)


lsql.multinomial_views("m3c", SIZE[:2], cl.N_CLASSES, min_valid=5, min_train=20)
lsql.multinomial_views("m3l", SIZE + LAT, cl.N_CLASSES, min_valid=5, min_train=20)
lsql.score_views("m3l")


@query("m3_logistic_coefficients", """SELECT g, k - 1 AS class, j - 1 AS term, round(CASE WHEN j = 1 THEN b[k][j] - (b[1][1] + b[2][1] + b[3][1] + b[4][1]) / 4 ELSE b[k][j] END, 5) AS coefficient
  FROM m3c_fit, range(1, 5) t(k), range(1, 4) u(j)""")
def m3_coefficients(spark, sf):
    """Intercept (centred over the classes) and slopes of every fold's model."""
    rows, p = cy.design(cy.usable_sets(stage_sets(spark, sf), 5, 20), SIZE[:2], "N", cl.N_CLASSES)
    model = grouped.fit(rows.where("train"), p, len(cl.N_CLASSES))
    cell = model.where("converged").select("g", F.posexplode("beta").alias("at", "coefficient"))
    return cell.select("g", F.expr("at div 3").cast("long").alias("class"), (F.col("at") % 3).cast("long").alias("term"), F.round("coefficient", 5).alias("coefficient"))


@query("m3_logistic_cv", f"SELECT g, {sql6('balanced_accuracy')}, n FROM m3l_by")
def m3(spark, sf):
    p = cy.cv_predictions(stage_sets(spark, sf), SIZE + LAT, "N", cl.N_CLASSES, cy.Ridge(), min_valid=5, min_train=20)
    return metrics.balanced_accuracy(p, group=["g"]).select("g", *r6("balanced_accuracy"), "n")


@query("m3_logistic_score_residual", "SELECT true AS at_optimum")
def m3_residual(spark, sf):
    """The fitted coefficients solve the penalised score equations."""
    sets = sv.whole_set(cl.laterality_flags(staged(spark, sf)).withColumnRenamed("y", "N"))
    rows = cy.labelled_sets(sets, SIZE, "N", cl.N_CLASSES).persist()
    n = rows.count()
    model = cy.logistic(n).fit(rows)
    from pyspark.ml.functions import vector_to_array
    prob = model.transform(rows).withColumn("pr", vector_to_array("probability"))
    B = model.coefficientMatrix.toArray()
    lam = 1.0 / (0.5 * n)
    gap = [F.abs(F.sum(F.col("weight") * (F.col("pr")[k] - F.when(F.col("y") == k, 1.0).otherwise(0.0)) * F.col("x")[j]) / n + lam * float(B[k, j])) < 1e-4
           for k in range(4) for j in range(len(SIZE))]
    all_small = gap[0]
    for g in gap[1:]:
        all_small = all_small & g
    return prob.agg(all_small.alias("at_optimum"))


view("m4_base", "SELECT cast(f AS VARCHAR) AS g, fold IS DISTINCT FROM f AS train, y, cast(max_node_mm AS DOUBLE) AS f0, cast(gtvn_total_ml AS DOUBLE) AS f1, cast(gtvp_ml AS DOUBLE) AS f2 FROM staged, (VALUES (0),(1),(2),(3),(4)) t(f)", ("staged",))
view("m4_rows", """SELECT g, y, f, v, row_number() OVER (PARTITION BY g, f ORDER BY v) AS r, count(*) OVER (PARTITION BY g, f) AS n
  FROM (SELECT g, y, unnest([0, 1, 2]) AS f, unnest([f0, f1, f2]) AS v FROM m4_base WHERE train)""", ("m4_base",))
view("m4_edges", "SELECT g, f, k, v AS edge FROM m4_rows JOIN range(1, 256) t(k) ON r = greatest(1, ceil(k / 256 * n))", ("m4_rows",))
view("m4_w", "SELECT g, y, sum(count(*)) OVER (PARTITION BY g) / (count(*) OVER (PARTITION BY g) * count(*)) AS w FROM m4_base WHERE train GROUP BY g, y", ("m4_base",))
view("m4_gh", """SELECT g, f, v, 'N' || c AS class, w * (sh - (y = 'N' || c)::INT) AS gr, w * sh * (1 - sh) AS he FROM m4_rows JOIN m4_w USING (g, y), range(0, 4) t(c)
  JOIN (SELECT g AS g2, y AS y2, w * cnt / sum(w * cnt) OVER (PARTITION BY g) AS sh FROM m4_w JOIN (SELECT g, y, count(*) AS cnt FROM m4_base WHERE train GROUP BY 1, 2) USING (g, y)) q ON q.g2 = g AND q.y2 = 'N' || c""", ("m4_rows", "m4_w", "m4_base"))
view("m4_left", """SELECT e.g, e.f, e.k, class, sum(gr) AS gl, sum(he) AS hl, count(*) AS nl FROM m4_edges e JOIN m4_gh r ON r.g = e.g AND r.f = e.f AND r.v <= e.edge GROUP BY 1, 2, 3, 4""", ("m4_edges", "m4_gh"))
view("m4_all", "SELECT g, f, class, sum(gr) AS ga, sum(he) AS ha, count(*) AS na FROM m4_gh GROUP BY 1, 2, 3", ("m4_gh",))


@query("m4_first_splits", """SELECT g, class, feature, gain FROM (
  SELECT g, class, f AS feature, k, round(gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1), 7) AS gain
  FROM m4_left JOIN m4_all USING (g, f, class) WHERE nl >= 20 AND na - nl >= 20 AND hl >= 0.001 AND ha - hl >= 0.001)
  QUALIFY row_number() OVER (PARTITION BY g, class ORDER BY gain DESC, feature, k) = 1""")
def m4_first(spark, sf):
    """Feature and gain of the first split of every fold's and class's first tree."""
    sets = cy.usable_sets(stage_sets(spark, sf), 1, 1)
    weights = metrics.class_weights(sets.where("train"), "N", ["g"]).select("g", "N", "weight")
    coded = sets.join(weights, ["g", "N"]).withColumn("y", F.array_position(F.array(*map(F.lit, cl.N_CLASSES)), F.col("N")) - 1)
    _, trees = boosting.boosted(coded.select("g", "train", "y", "weight", *SIZE), SIZE, 4, rounds=1)
    first = trees.where("round = 0 AND node = 1 AND feature >= 0")
    return first.select("g", F.concat(F.lit("N"), F.col("class")).alias("class"), "feature", *r6("gain"))


@query("m4_boosted_cv")
def m4(spark, sf):
    """300 rounds for every fold."""
    return cy.pooled_score(cy.cv_predictions(stage_sets(spark, sf), SIZE, "N", cl.N_CLASSES, cy.Boost()))


@query("m5_forest_cv")
def m5(spark, sf):
    p = cy.cv_predictions(stage_sets(spark, sf), cl.GEOMETRY + LAT, "N", cl.N_CLASSES, small_forest, min_valid=5, min_train=20)
    return cy.mean_score(p)


lsql.ordinal_views("m6o", SIZE + LAT, cl.N_CLASSES, min_valid=5, min_train=20)
lsql.score_views("m6o")
FOLDS = "SELECT round(avg(balanced_accuracy), 7) AS mean, round(stddev_pop(balanced_accuracy), 7) AS std, count(*) AS folds FROM "


@query("m6_ordinal_cv", FOLDS + "m6o_by")
def m6(spark, sf):
    p = cy.ordinal_predictions(stage_sets(spark, sf), SIZE + LAT, "N", cl.N_CLASSES)
    return cy.mean_score(p).select(*r6("mean", "std"), "folds")


lsql.multinomial_views("m8l", SIZE, cl.N_CLASSES)


@query("m8_pooled_oof", "SELECT round(avg(recall), 7) AS balanced_accuracy, cast(sum(n) AS BIGINT) AS n FROM (SELECT y, avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM m8l_pred GROUP BY 1)")
def m8(spark, sf):
    p = cy.cv_predictions(stage_sets(spark, sf), SIZE, "N", cl.N_CLASSES, cy.Ridge())
    return cy.pooled_score(p).select(*r6("balanced_accuracy"), "n")


@query("m9_fold_mean")
def m9(spark, sf):
    p = cy.cv_predictions(stage_sets(spark, sf), NUM, "N", cl.N_CLASSES, cy.Ridge(balanced=False), top_k=4)
    return cy.mean_score(p)


lsql.multinomial_views("m9l", NUM, cl.N_CLASSES, balanced=False)
lsql.score_views("m9l")


@query("m9_fold_mean_all_features", FOLDS + "m9l_by")
def m9_all(spark, sf):
    p = cy.cv_predictions(stage_sets(spark, sf), NUM, "N", cl.N_CLASSES, cy.Ridge(balanced=False))
    return cy.mean_score(p).select(*r6("mean", "std"), "folds")


lsql.multinomial_views("m10l", SIZE + LAT, cl.N_CLASSES, by="center", min_valid=5, min_train=20)
lsql.score_views("m10l")


@query("m10_leave_one_center_out", FOLDS + "m10l_by")
def m10(spark, sf):
    p = cy.cv_predictions(stage_sets(spark, sf, "center"), SIZE + LAT, "N", cl.N_CLASSES, cy.Ridge(), min_valid=5, min_train=20)
    return cy.mean_score(p).select(*r6("mean", "std"), "folds")


@query("m11_rule_scores", """SELECT 'cv' AS scheme, round(avg(ba), 7) AS score FROM by_fold UNION ALL SELECT 'loco', round(avg(ba), 7) FROM by_center
  UNION ALL SELECT 'overall', round(avg(recall), 7) FROM recalls""")
def m11(spark, sf):
    return cy.rule_scores(staged(spark, sf)).select("scheme", *r6("score"))


view("t_staged", "SELECT *, substr(replace(upper(T_raw), 'T', ''), 1, 1) AS t FROM fx_cohort WHERE substr(replace(upper(T_raw), 'T', ''), 1, 1) IN ('1','2','3','4')", ("fx_cohort",))
CLINICAL = ["Age", "Gender", "HPV"]
T_SETS = {"geometry_only": cl.GEOMETRY, "geometry+clinical": cl.GEOMETRY + CLINICAL, "features_only": POOL, "features+geometry+clinical": POOL + cl.GEOMETRY + CLINICAL}
PLAIN_BOOST = cy.Boost(rounds=200, step=0.05, l2=0.0, balanced=False)


def t_rows(spark, sf):
    """Cohort with T labels and the feature columns of every set."""
    df = fx.cohort(spark, sf).withColumn("T", cl.t_label("T_raw", "first_char"))
    df = df.withColumns({"SUV_gtvp_Mean": F.col("gtvp_ml") / (1 + F.col("c_custkey") % 7), "SUV_gtvn_Maximum": F.col("max_node_mm") / (1 + F.col("c_custkey") % 5)})
    return df.withColumn("TLG_gtvp", cl.tlg("gtvp_ml", "SUV_gtvp_Mean"))


def both_schemes(df):
    """Training sets of all folds (at least one row on each side) and all centers (5 to judge, 20 to train), ``g`` named by scheme."""
    named = lambda by: sv.training_sets(df, by).withColumn("g", F.concat(F.lit(f"{by}|"), "g"))
    return cy.usable_sets(named("fold"), 1, 1).unionByName(cy.usable_sets(named("center"), 5, 20))


def scheme_scores(predictions):
    """Mean and deviation over the folds, mean over the centers, by ``config``."""
    per = metrics.balanced_accuracy(predictions, group=["config", "g"]).withColumn("scheme", F.substring_index("g", "|", 1))
    pick = lambda s: F.when(F.col("scheme") == s, F.col("balanced_accuracy"))
    return per.groupBy("config").agg(F.avg(pick("fold")).alias("cv_mean"), F.stddev_pop(pick("fold")).alias("cv_std"), F.avg(pick("center")).alias("loco"))


def boosted_sets(sets, feature_sets, label, classes, make):
    """Boosted predictions of several feature sets in one run: a set's rows hold NULL in the columns of the others, which never split."""
    every = list(dict.fromkeys(f for fs in feature_sets.values() for f in fs))
    out = None
    for name, feats in feature_sets.items():
        rows, p = cy.design(sets, feats, label, classes)
        part = rows.select(F.concat(F.lit(f"{name}|"), "g").alias("g"), "train", "PatientID", label, F.col("weight") if make.balanced else F.lit(1.0).alias("weight"),
                           *[F.col("x")[feats.index(f)].alias(f) if f in feats else F.lit(None).cast("double").alias(f) for f in every])
        out = part if out is None else out.unionByName(part)
    p = boosting.boosted_predictions(cut(out), every, label, classes, rounds=make.rounds, depth=make.depth, step=make.step, l2=make.l2)
    return p.select(F.substring_index("g", "|", 1).alias("config"), F.expr("substring(g, instr(g, '|') + 1)").alias("g"), "PatientID", "y", "p")


def t_predictions(df):
    """Out-of-group T predictions of every model and feature set, all folds and centers."""
    sets = cut(both_schemes(df))
    out = boosted_sets(sets, T_SETS, "T", cl.T_CLASSES, PLAIN_BOOST).withColumn("config", F.concat("config", F.lit("|HistGB")))
    for name, feats in T_SETS.items():
        for model, make in (("LogReg", cy.Ridge(balanced=False)), ("RF", lambda n: cy.forest(balanced=False))):
            p = cy.cv_predictions(sets, feats, "T", cl.T_CLASSES, make)
            out = out.unionByName(p.select(F.lit(f"{name}|{model}").alias("config"), "g", "PatientID", "y", "p"))
    return out


@query("m12_comparison")
def m12(spark, sf):
    """Four feature sets times three models for T: cross-validation, leave-one-center-out, and the gain over the best geometry-only row."""
    scores = scheme_scores(t_predictions(t_rows(spark, sf).where(F.col("T").isin(cl.T_CLASSES))))
    named = scores.select(F.substring_index("config", "|", 1).alias("features"), F.substring_index("config", "|", -1).alias("model"), "cv_mean", "cv_std", "loco")
    size = F.create_map(*[v for n, fs in T_SETS.items() for v in (F.lit(n), F.lit(len(fs)))])[F.col("features")]
    base = named.where("features = 'geometry_only'").agg(F.max("cv_mean"))
    return named.withColumn("k", size).withColumn("gain", F.col("cv_mean") - base.scalar())


for _name, _feats in (("geo", T_SETS["geometry_only"]), ("geoclin", T_SETS["geometry+clinical"])):
    for _by, _least in (("fold", (1, 1)), ("center", (5, 20))):
        lsql.multinomial_views(f"m12{_name}{_by}", _feats, cl.T_CLASSES, balanced=False, by=_by, min_valid=_least[0], min_train=_least[1], source="t_staged", label="t")
        lsql.score_views(f"m12{_name}{_by}")


@query("m12_logistic_rows", " UNION ALL ".join(
    f"SELECT '{full}' AS features, round((SELECT avg(balanced_accuracy) FROM m12{n}fold_by), 7) AS cv_mean, round((SELECT stddev_pop(balanced_accuracy) FROM m12{n}fold_by), 7) AS cv_std, round((SELECT avg(balanced_accuracy) FROM m12{n}center_by), 7) AS loco"
    for n, full in (("geo", "geometry_only"), ("geoclin", "geometry+clinical"))))
def m12_logistic(spark, sf):
    """The logistic rows of the comparison on columns that SQL has as well."""
    sets = cut(both_schemes(t_rows(spark, sf).where(F.col("T").isin(cl.T_CLASSES))))
    out = None
    for name in ("geometry_only", "geometry+clinical"):
        p = cy.cv_predictions(sets, T_SETS[name], "T", cl.T_CLASSES, cy.Ridge(balanced=False)).select(F.lit(name).alias("config"), "g", "PatientID", "y", "p")
        out = p if out is None else out.unionByName(p)
    return scheme_scores(out).select(F.col("config").alias("features"), *r6("cv_mean", "cv_std", "loco"))


# --------------------------------------------------------------- M13-M16 Cox
view("cox_all", """SELECT PatientID, RFS AS t, event AS e, (gtvp_ml - avg(gtvp_ml) OVER ()) / stddev_samp(gtvp_ml) OVER () AS z1,
  (max_node_mm - avg(max_node_mm) OVER ()) / stddev_samp(max_node_mm) OVER () AS z2 FROM fx_cohort WHERE RFS > 0""", ("fx_cohort",))


def cox_sql(name, b1, b2):
    """Efron score and information at (b1, b2) by direct sums over risk sets."""
    w = f"exp({b1}*z1 + {b2}*z2)"
    view(f"{name}_at", f"""SELECT s.t, s.d, s.ds, s.d1, s.d2, s.e1, s.e2, sum(w) AS s0, sum(w*z1) AS s1, sum(w*z2) AS s2, sum(w*z1*z1) AS s11, sum(w*z1*z2) AS s12, sum(w*z2*z2) AS s22,
      s.d11, s.d12, s.d22 FROM (SELECT t, count(*) AS d, sum({w}) AS ds, sum({w}*z1) AS d1, sum({w}*z2) AS d2, sum(z1) AS e1, sum(z2) AS e2,
        sum({w}*z1*z1) AS d11, sum({w}*z1*z2) AS d12, sum({w}*z2*z2) AS d22 FROM cox_all WHERE e = 1 GROUP BY 1) s
      JOIN (SELECT *, {w} AS w FROM cox_all) r ON r.t >= s.t GROUP BY ALL""", ("cox_all",))
    view(f"{name}_m", f"""SELECT *, (s1 - f*d1) / phi AS m1, (s2 - f*d2) / phi AS m2 FROM (
      SELECT *, l / d AS f, s0 - l / d * ds AS phi FROM (SELECT *, unnest(range(0, d)) AS l FROM {name}_at))""", (f"{name}_at",))
    return f"""SELECT round((SELECT sum(e1) FROM {name}_at) - sum(m1), 5) AS u1, round((SELECT sum(e2) FROM {name}_at) - sum(m2), 5) AS u2,
      round(sum((s11 - f*d11) / phi - m1*m1), 4) AS i11, round(sum((s12 - f*d12) / phi - m1*m2), 4) AS i12, round(sum((s22 - f*d22) / phi - m2*m2), 4) AS i22 FROM {name}_m"""


def cox_at(spark, sf, beta):
    x = sv.standardise(sv.whole_set(outcome(spark, sf)), sv.prep_params(sv.whole_set(outcome(spark, sf)), ["gtvp_ml", "max_node_mm"], sample_std=True),
                       ["gtvp_ml", "max_node_mm"], "z").select("g", F.col("RFS").alias("time"), "event", "z")
    import numpy as np
    score, info = sv.cox_information(x, {"all": np.array(beta)}, 2)["all"]
    row = (round(float(score[0]), 5), round(float(score[1]), 5), round(float(info[0, 0]), 4), round(float(info[0, 1]), 4), round(float(info[1, 1]), 4))
    return spark.createDataFrame([row], "u1 double, u2 double, i11 double, i12 double, i22 double")


@query("m14_cox_score_at_zero", cox_sql("cox0", "0.0", "0.0"))
def m14_zero(spark, sf):
    return cox_at(spark, sf, [0.0, 0.0])


@query("m14_cox_score_at_fixed", cox_sql("coxb", "0.3", "-0.2"))
def m14_fixed(spark, sf):
    return cox_at(spark, sf, [0.3, -0.2])


lsql.cox_newton_views("cxn", "cox_all", 0.1)


@query("m14_cox_coefficients", "SELECT round(b1, 7) AS b1, round(b2, 7) AS b2, true AS converged FROM cxn_fit")
def m14_coefficients(spark, sf):
    """Ridge Cox on two scaled features, against written-out Newton steps."""
    sets = sv.whole_set(outcome(spark, sf))
    x = sv.standardise(sets, sv.prep_params(sets, ["gtvp_ml", "max_node_mm"], sample_std=True), ["gtvp_ml", "max_node_mm"])
    fit = sv.cox_fit(x.select("g", F.col("RFS").alias("time"), "event", "x"), 2, 0.1)
    return fit.select(F.round(F.col("beta")[0], 7).alias("b1"), F.round(F.col("beta")[1], 7).alias("b2"), "converged")


@query("m14_cox_fit", "SELECT 'all' AS g, true AS solved")
def m14(spark, sf):
    sets = sv.whole_set(outcome(spark, sf))
    x = sv.standardise(sets, sv.prep_params(sets, BASE), BASE)
    fit = sv.cox_fit(x.select("g", F.col("RFS").alias("time"), "event", "x"), len(BASE), 0.1)
    return fit.select("g", (F.col("gradient") < 1e-8).alias("solved"))


view("m13_filled", "SELECT PatientID, Age, coalesce(HPV, median(HPV) OVER ()) AS h, cast(HPV IS NULL AS INT) AS miss, gtvp_ml FROM fx_cohort WHERE RFS > 0", ("fx_cohort",))


@query("m13_cox_preparation", """SELECT PatientID, round((Age - avg(Age) OVER ()) / stddev_samp(Age) OVER (), 7) AS age_z, round((h - avg(h) OVER ()) / stddev_samp(h) OVER (), 7) AS hpv_z,
  cast(miss AS DOUBLE) AS hpv_missing FROM m13_filled""")
def m13(spark, sf):
    df, flags = sv.with_missing_flags(outcome(spark, sf).drop("HPV_missing"), ["Age", "HPV"])
    sets = sv.whole_set(df)
    x = sv.standardise(sets, sv.prep_params(sets, ["Age", "HPV"], sample_std=True), ["Age", "HPV"])
    return x.select("PatientID", F.round(F.col("x")[0], 7).alias("age_z"), F.round(F.col("x")[1], 7).alias("hpv_z"), F.col(flags[0]).alias("hpv_missing"))


view("m13_codes", """SELECT PatientID, Age, HPV, cast(dense_rank() OVER (ORDER BY laterality) - 1 AS DOUBLE) AS lat FROM fx_cohort WHERE RFS > 0""", ("fx_cohort",))
view("m13_full", "SELECT PatientID, Age, lat, coalesce(HPV, median(HPV) OVER ()) AS h, cast(HPV IS NULL AS DOUBLE) AS miss FROM m13_codes", ("m13_codes",))


@query("m13_state_of_text_and_constant", """SELECT PatientID, ['HPV_missing', 'Age', 'HPV', 'laterality'] AS terms, [miss, round((Age - avg(Age) OVER ()) / stddev_samp(Age) OVER (), 7),
  round((h - avg(h) OVER ()) / stddev_samp(h) OVER (), 7), round((lat - avg(lat) OVER ()) / stddev_samp(lat) OVER (), 7)] AS x FROM m13_full""")
def m13_state(spark, sf):
    """Codes of a text column, a missing flag and a dropped constant, saved, read back and applied."""
    df = outcome(spark, sf).drop("HPV_missing").withColumn("always", F.lit(3.0))
    path = _scratch(spark, "state")
    ms.save(ms.fit_preparation(df, ["Age", "HPV", "laterality", "always"]), path, "preparation")
    x, names = ms.prepared(df, ms.load(spark, path, "preparation"))
    return x.select("PatientID", F.array(*map(F.lit, names)).alias("terms"), F.transform("x", lambda v: F.round(v, 7)).alias("x"))


@query("m15_partial_hazard", """SELECT PatientID, round(exp(0.4 * ((gtvp_ml - m1)) / 10 - 0.02 * (Age - m2)), 6) AS risk FROM fx_cohort,
  (SELECT avg(gtvp_ml) AS m1, avg(Age) AS m2 FROM fx_cohort WHERE RFS > 0) WHERE RFS > 0""")
def m15(spark, sf):
    df = outcome(spark, sf)
    model = df.agg(F.array(F.avg("gtvp_ml"), F.avg("Age")).alias("shift")).select(
        F.lit("all").alias("g"), F.array(F.lit(0.04), F.lit(-0.02)).alias("beta"), "shift")
    rows = df.select("PatientID", F.lit("all").alias("g"), F.array("gtvp_ml", "Age").alias("x"))
    return sv.partial_hazard(rows, model, 2).select("PatientID", *[F.round("risk", 6).alias("risk")])


@query("m16_cox_report")
def m16(spark, sf):
    """Shipped Cox with the strict pair rule: out of fold, per center, and the final model's line.

    A center with under 10 rows, or under 5 events left to train on, keeps a row without a score.
    """
    df = outcome(spark, sf)
    by_fold, by_center = sv.training_sets(df, "fold"), sv.training_sets(df, "center")
    oof = sv.concordance(sv.cox_predictions(sv.guard_sets(by_fold, 1, 20, 0), BASE, 0.1, sample_std=True))
    loco = sv.concordance(sv.cox_predictions(sv.guard_sets(by_center, 10, 1, 0, min_train_events=5), BASE, 0.1, sample_std=True), group=["g"])
    kept = sv.set_guard(by_center, 10, 1, 0, min_train_events=5)
    line = ("n", "events", "c_index")
    a = oof.select(F.lit("oof").alias("scheme"), F.lit("all").alias("g"), *line, F.lit(None).cast("string").alias("reason"))
    b = kept.join(loco, "g", "left").select(F.lit("loco").alias("scheme"), "g", *line, "reason")
    rate = df.agg(F.count("*").alias("n"), F.sum("event").cast("long").alias("events"))
    final = rate.join(oof.select("c_index"), how="full").select(F.lit("final").alias("scheme"), F.lit("all").alias("g"), "n", "events", F.round("c_index", 4).alias("c_index"),      # one row each
                                                               F.concat(F.lit("event rate "), F.round(F.col("events") / F.col("n"), 4)).alias("reason"))
    return a.unionByName(b).unionByName(final)


# ------------------------------------------------------ M17-M26 survival comparison
view("sel_pairs", """SELECT i.g, i.feature, abs(0.5 - sum(CASE WHEN i.f > j.f THEN 1.0 WHEN i.f = j.f THEN 0.5 ELSE 0.0 END) / count(*)) AS signal
  FROM (SELECT l.*, coalesce(v, med) AS f FROM cv_long l JOIN cv_med USING (g, feature) WHERE train) i JOIN (SELECT l.*, coalesce(v, med) AS f FROM cv_long l JOIN cv_med USING (g, feature) WHERE train) j
  ON i.g = j.g AND i.feature = j.feature AND i.event = 1 AND (j.RFS > i.RFS OR (j.RFS = i.RFS AND j.event = 0)) GROUP BY 1, 2""", ("cv_long", "cv_med"))


@query("m17_preselect", "SELECT g, feature, round(signal, 7) AS signal, cast(row_number() OVER (PARTITION BY g ORDER BY round(signal, 12) DESC, feature DESC) AS INT) AS rank FROM sel_pairs QUALIFY rank <= 3")
def m17(spark, sf):
    return sv.preselect(cv_sets(spark, sf), NUM, 3).select("g", "feature", *r6("signal"), "rank")


def crossed_rows(spark, sf, features, by=("fold",), named=False):
    """Rows stored once with the groups that hold them out, and the sets large enough to fit and to judge."""
    df = outcome(spark, sf)
    rows, sets = cr.held_by(df.withColumn("x", cr.features_of(df, features)), {c: sv.group_values(df, c) for c in by}, named)
    rows = cut(rows.select(*cr.IDS, "held", "x"))
    return rows, cr.guarded(rows, sets)


@query("m18_cox_with_selected")
def m18(spark, sf):
    rows, sets = crossed_rows(spark, sf, BASE + POOL)
    n = len(BASE + POOL)
    fill = cr.fills(rows, sets, n)
    size, mean, sd = cr.moments(rows, sets, n, fill)
    picked = cr.chosen(sets, cr.sign_fits(rows, sets, n, fill, list(range(len(BASE), n))), sd, BASE + POOL, len(BASE), 2)
    cox = cr.cox_fits(cr.time_blocks(rows, n), sets, n, fill, mean, sd, size, 0.5, picked)
    return cr.judged(cr.held_out(rows, sets, n, fill, [partial(cr.cox_risk, cox)]), ["Cox"]).select("g", "n", "events", "c_index")


view("sign_scale", "SELECT g, feature, median(z) AS mu, stddev_pop(z) AS sd FROM cv_z WHERE train GROUP BY 1, 2", ("cv_z",))
view("sign_pairs", """SELECT i.g, i.feature, sum(CASE WHEN i.z > j.z THEN 1.0 WHEN i.z = j.z THEN 0.5 ELSE 0.0 END) / count(*) AS c
  FROM (SELECT * FROM cv_z WHERE train) i JOIN (SELECT * FROM cv_z WHERE train) j ON i.g = j.g AND i.feature = j.feature AND i.event = 1
  AND (j.RFS > i.RFS OR (j.RFS = i.RFS AND j.event = 0)) GROUP BY 1, 2""", ("cv_z",))
view("sign_risk", """SELECT g, PatientID, any_value(RFS) AS RFS, any_value(event) AS event, avg((z - mu) / sd * CASE WHEN c >= 0.5 THEN 1 ELSE -1 END) AS risk
  FROM cv_z JOIN sign_scale USING (g, feature) JOIN sign_pairs USING (g, feature) WHERE NOT train GROUP BY 1, 2""", ("cv_z", "sign_scale", "sign_pairs"))


@query("m19_sign_ensemble", "SELECT g, PatientID, round(risk, 7) AS risk FROM sign_risk")
def m19(spark, sf):
    return sv.sign_predictions(cv_sets(spark, sf), NUM).select("g", "PatientID", *r6("risk"))


@query("m20_bagged_sign_ensemble")
def m20(spark, sf):
    return sv.bagged_sign_predictions(cv_sets(spark, sf), NUM).select("g", "PatientID", "risk")


def model_predictions(sets, feats, bagged=False):
    tag = lambda df, name: df.select("g", "PatientID", "center", "RFS", "event", "risk").withColumn("model", F.lit(name))
    out = tag(sv.cox_predictions(sets, feats), "Cox").unionByName(tag(sv.sign_predictions(sets, feats), "sign"))
    return out.unionByName(tag(sv.bagged_sign_predictions(sets, feats), "bag")) if bagged else out


view("two_risks", """SELECT 'sign' AS model, g, PatientID, risk FROM sign_risk UNION ALL
    SELECT 'volume', g, PatientID, v FROM cv_long WHERE NOT train AND feature = 'gtvp_ml'""", ("sign_risk", "cv_long"))
view("two_ranks", """SELECT *, rank() OVER (PARTITION BY g, model ORDER BY round(risk, 9)) + (count(*) OVER (PARTITION BY g, model, round(risk, 9)) - 1) / 2.0 AS r FROM two_risks""", ("two_risks",))


@query("w4_rank_ensemble", "SELECT g, PatientID, avg(r) AS risk FROM two_ranks GROUP BY 1, 2")
def w4(spark, sf):
    sets = cv_sets(spark, sf)
    sign = sv.sign_predictions(sets, NUM).withColumn("model", F.lit("sign"))
    volume = sets.where("not train").select("g", "PatientID", "center", "RFS", "event", F.col("gtvp_ml").alias("risk"), F.lit("volume").alias("model"))
    both = sign.select(*volume.columns).unionByName(volume).withColumn("risk", F.round("risk", 9))
    return sv.rank_ensemble(both, ("sign", "volume"), "mix").select("g", "PatientID", "risk")


@query("m21_model_combinations")
def m21(spark, sf):
    rows, sets = crossed_rows(spark, sf, NUM)
    n, single = len(NUM), ["Cox", "sign", "bag"]
    fill = cr.fills(rows, sets, n)
    size, mean, sd = cr.moments(rows, sets, n, fill)
    cox = cr.cox_fits(cr.time_blocks(rows, n), sets, n, fill, mean, sd, size, 0.5)
    bag, = cr.bag_fits(rows, sets, NUM, fill, mean, sd, size, [NUM])
    risks = [partial(cr.cox_risk, cox), partial(cr.sign_risk, cr.sign_fits(rows, sets, n, fill), list(range(n))), partial(cr.bag_risk, bag)]
    combined = {"Cox+sign": ("Cox", "sign"), "Cox+bag": ("Cox", "bag"), "Cox+bag+sign": ("Cox", "bag", "sign")}
    absent = [("bag", g) for i, g in enumerate(sets.names) if i not in bag]
    every = cr.with_rank_means(cut(cr.held_out(rows, sets, n, fill, risks)), single, combined, absent)
    absent += [(name, g) for _, g in absent for name, models in combined.items() if models == ("Cox", "bag")]      # two models at least
    return cr.judged(every, single + list(combined), absent).groupBy("model").agg(F.avg("c_index").alias("c_index"), F.count("c_index").alias("folds"))


@query("m22_agreement", """SELECT round(corr(ra, rb), 6) AS rank_corr, corr(ra, rb) > 0.8 AS alike FROM (
  SELECT (rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2.0) AS ra, (rank() OVER (ORDER BY gtvp_ml) + (count(*) OVER (PARTITION BY gtvp_ml) - 1) / 2.0) AS rb
  FROM fx_cohort WHERE RFS > 0)""")
def m22(spark, sf):
    df = ranks.add_rank(ranks.add_rank(outcome(spark, sf), "n_orders", "ra"), "gtvp_ml", "rb")
    c = F.corr("ra", "rb")
    return df.agg(F.round(c, 6).alias("rank_corr"), (c > 0.8).alias("alike"))


FAMILIES = (("Cox", "base", BASE), ("sign", "base", BASE), ("sign", "base+features", BASE + POOL), ("bag", "base+features", BASE + POOL), ("bag", "features", POOL))


@query("m23_model_families")
def m23(spark, sf):
    """Five arms under folds and leave-one-center-out: mean C, sets judged, and the difference to the Cox baseline."""
    feats = BASE + POOL
    at = {"base": list(range(len(BASE))), "base+features": list(range(len(feats))), "features": list(range(len(BASE), len(feats)))}
    rows, sets = crossed_rows(spark, sf, feats, ("fold", "center"), True)
    fill = cr.fills(rows, sets, len(feats))
    size, mean, sd = cr.moments(rows, sets, len(feats), fill)
    base = np.tile(at["base"], (len(sets.names), 1))
    cox = cr.cox_fits(cr.time_blocks(rows, len(feats)), sets, len(feats), fill, mean, sd, size, 1.0, base)
    sign = cr.sign_fits(rows, sets, len(feats), fill)
    bags = cr.bag_fits(rows, sets, feats, fill, mean, sd, size, [f for m, _, f in FAMILIES if m == "bag"])
    bagged = dict(zip([name for m, name, _ in FAMILIES if m == "bag"], bags))
    risk = {"Cox": lambda name: partial(cr.cox_risk, cox), "sign": lambda name: partial(cr.sign_risk, sign, at[name]), "bag": lambda name: partial(cr.bag_risk, bagged[name])}
    arms = [f"{m}|{name}" for m, name, _ in FAMILIES]
    absent = [(f"bag|{name}", g) for name, b in bagged.items() for i, g in enumerate(sets.names) if i not in b]
    per = cr.judged(cr.held_out(rows, sets, len(feats), fill, [risk[m](name) for m, name, _ in FAMILIES]), arms, absent)
    per = per.withColumns({"features": F.substring_index("model", "|", -1), "model": F.substring_index("model", "|", 1), "scheme": F.substring_index("g", "|", 1)})
    pick = lambda s: F.when(F.col("scheme") == s, F.col("c_index"))
    rows = cut(per.groupBy("model", "features").agg(F.avg(pick("fold")).alias("cv"), F.count(pick("fold")).alias("folds"), F.avg(pick("center")).alias("loco"), F.count(pick("center")).alias("centers")))
    cox = rows.where("model = 'Cox'").select("cv")
    return rows.withColumn("gain", F.col("cv") - cox.scalar())


view("m23_fold", "SELECT g, sum(CASE WHEN i.risk > j.risk THEN 1.0 WHEN i.risk = j.risk THEN 0.5 ELSE 0.0 END) / count(*) AS c FROM sign_risk i JOIN sign_risk j USING (g) WHERE i.event = 1 AND (j.RFS > i.RFS OR (j.RFS = i.RFS AND j.event = 0)) GROUP BY 1", ("sign_risk",))


@query("m23_sign_arm", "SELECT round(avg(c), 7) AS cv, count(*) AS folds FROM m23_fold")
def m23_sign(spark, sf):
    """The sign arm over the columns that SQL has as well."""
    per = sv.c_by_group(sv.sign_predictions(cv_sets(spark, sf), NUM), ["g"])
    return per.agg(F.round(F.avg("c_index"), 7).alias("cv"), F.count("c_index").alias("folds"))


@query("m24_center_held_out_risk")
def m24(spark, sf):
    sets = sv.guard_sets(sv.training_sets(outcome(spark, sf), "center"), 1, 30, 0)
    return sv.cox_predictions(sets, BASE).select("PatientID", "center", "risk")


@query("m25_repeated_cv")
def m25(spark, sf):
    """Five folds under ten seeds for Cox and the sign ensemble: mean and deviation of each, and of their difference by seed."""
    df = cut(outcome(spark, sf).select(*cr.IDS, cr.features_of(outcome(spark, sf), BASE).alias("x"), F.monotonically_increasing_id().alias("_row")))
    folds = ranks.stratified_folds(df.select("_row", "PatientID", "event", "center"), ["event", "center"]).select("_row", "seed", "cv_fold")
    rows, sets = cr.held_by_seed(df, folds, "_row", 10)
    rows = cut(rows.drop("_row"))      # a row once, with its fold under every seed
    sets = cr.guarded(rows, sets, 1, 1, 3)
    per = cr.judged(cr.cox_and_sign(rows, sets, len(BASE)), ["Cox", "sign"]).withColumn("seed", F.substring_index("g", "_", 1).cast("int"))
    seeds = cut(per.groupBy("model", "seed").agg(F.avg("c_index").alias("c_index")))
    each = seeds.groupBy("model").agg(F.avg("c_index").alias("mean"), F.stddev_pop("c_index").alias("std"), F.count("*").alias("seeds"), F.lit(None).cast("long").alias("wins"))
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("c_index")))
    gap = seeds.groupBy("seed").agg((pick("sign") - pick("Cox")).alias("d"))
    return each.unionByName(gap.agg(F.lit("sign - Cox").alias("model"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.count("d").alias("seeds"), F.count_if(F.col("d") > 0).alias("wins")).select(each.columns))


@query("m26_per_center_comparison")
def m26(spark, sf):
    p = model_predictions(cv_sets(spark, sf, "center"), BASE)
    return sv.c_by_group(p).select("model", F.col("g").alias("center"), "n", "events", "c_index")


# ------------------------------------------------------------- M27-M29 final models
@query("m27_final_models", f"SELECT PatientID, 1 AS n_ok, 1 AS t_ok, {rule()} AS n_rule FROM staged")
def m27(spark, sf):
    """Fit the stage models on all rows, save, reload and score."""
    from pyspark.ml.classification import LogisticRegressionModel
    df = cl.laterality_flags(staged(spark, sf)).withColumnRenamed("y", "N").withColumn("T", cl.t_label("T_raw", "first_char"))
    out = df
    for label, classes, feats in (("N", cl.N_CLASSES, SIZE + LAT), ("T", cl.T_CLASSES, SIZE + ["Age", "Gender", "HPV"])):
        model, params = cy.fit_final(df.where(F.col(label).isin(classes)), feats, label, classes)
        path = _scratch(spark, f"model-{label}")
        cy.save_final(model, params, path)
        again, kept = LogisticRegressionModel.load(f"{path}/model"), spark.read.parquet(f"{path}/params")
        out = cy.predict_final(out, again, kept, feats, classes, f"pred_{label}")
    good = lambda c, classes: F.col(c).isin(classes).cast("int")
    return out.select("PatientID", good("pred_N", cl.N_CLASSES).alias("n_ok"), good("pred_T", cl.T_CLASSES).alias("t_ok"),
                      staging.rule_n("n_gtvn", "max_node_mm", "laterality").alias("n_rule"))


N_FEATURES, T_FEATURES = SIZE + LAT, SIZE + ["Age", "Gender", "HPV"]
lsql.multinomial_views("fin_n", N_FEATURES, cl.N_CLASSES, by=None)
lsql.multinomial_views("fin_t", T_FEATURES, cl.T_CLASSES, by=None, source="t_staged", label="t")
lsql.multinomial_views("cv_n", N_FEATURES, cl.N_CLASSES, min_valid=5, min_train=20)
lsql.score_views("cv_n")
lsql.multinomial_views("cv_t", T_FEATURES, cl.T_CLASSES, min_valid=5, min_train=20, source="t_staged", label="t")
lsql.score_views("cv_t")
view("demo", """SELECT * FROM (VALUES (0, 12.0, 0, 0.0, 0.0, 'none', 1.0, 1.0, 1.0), (1, 8.0, 1, 24.0, 2.4, 'unilateral', 1.0, 1.0, 1.0), (2, 20.0, 2, 42.0, 12.5, 'bilateral', 1.0, 1.0, 1.0),
  (3, 30.0, 1, 66.0, 33.0, 'unilateral', 1.0, 1.0, 1.0)) d(demo, gtvp_ml, n_gtvn, max_node_mm, gtvn_total_ml, laterality, "Age", "Gender", "HPV")""")
lsql.score_rows_view("demo_n", "fin_n", N_FEATURES, cl.N_CLASSES, "demo", "demo")
lsql.score_rows_view("demo_t", "fin_t", T_FEATURES, cl.T_CLASSES, "demo", "demo")


def train_final(df, features, label, classes, path, name, at_least=0.0):
    """Check a stage model by cross-validation, fit it on all rows and save it as the next version; an unmet check saves nothing."""
    known = df.where(F.col(label).isin(classes))
    p = cy.cv_predictions(sv.training_sets(known, "fold"), features, label, classes, cy.Ridge(), min_valid=5, min_train=20)
    score = cy.mean_score(p).first()["mean"]
    state = ms.with_score(ms.fit_stage(known, features, label, classes), -1.0 if score is None else score, at_least)
    ms.save(state, path, name)
    return ms.load(df.sparkSession, path, name)


def final_rows(spark, sf):
    return cl.laterality_flags(fx.cohort(spark, sf)).withColumns({"N": cl.n_label("N_raw", trim=False), "T": cl.t_label("T_raw", "first_char")})


@query("m27_checked_final_models", """SELECT demo, n.p AS n, t.p AS t, (SELECT round(avg(balanced_accuracy), 6) FROM cv_n_by) AS n_cv, (SELECT round(avg(balanced_accuracy), 6) FROM cv_t_by) AS t_cv, true AS refused
  FROM demo_n n JOIN demo_t t USING (demo)""")
def m27_checked(spark, sf):
    """Both stage models: checked, fitted, saved, read back, and asked about four plain geometries; a model under its floor is refused."""
    df, path = final_rows(spark, sf), _scratch(spark, "models")
    n, t = train_final(df, N_FEATURES, "N", cl.N_CLASSES, path, "n"), train_final(df, T_FEATURES, "T", cl.T_CLASSES, path, "t")
    try:
        ms.with_score(n, n.where("kind = 'score'").first()["value"], 1.01)
        refused = False
    except ValueError:
        refused = True
    cases = spark.createDataFrame([(0, 12.0, 0, 0.0, 0.0, "none"), (1, 8.0, 1, 24.0, 2.4, "unilateral"), (2, 20.0, 2, 42.0, 12.5, "bilateral"), (3, 30.0, 1, 66.0, 33.0, "unilateral")],
                                  "demo int, gtvp_ml double, n_gtvn int, max_node_mm double, gtvn_total_ml double, laterality string")
    cases = cl.laterality_flags(cases).withColumns({c: F.lit(1.0) for c in ("Age", "Gender", "HPV")})
    score = lambda s: F.lit(round(s.where("kind = 'score'").first()["value"], 6))
    return ms.stage(ms.stage(cases, n, "n"), t, "t").select("demo", "n", "t", score(n).alias("n_cv"), score(t).alias("t_cv"), F.lit(refused).alias("refused"))


view("case_rows", """SELECT g.*, c.Age, c.Gender, c.HPV FROM geometry_image g LEFT JOIN fx_clinical c ON c.c_custkey = g.case_id""", ("geometry_image", "fx_clinical"))
lsql.score_rows_view("case_n", "fin_n", N_FEATURES, cl.N_CLASSES, "case_rows", "case_id")
lsql.score_rows_view("case_t", "fin_t", T_FEATURES, cl.T_CLASSES, "case_rows", "case_id")


@query("m29_score_fitted", """SELECT case_id, concat('T', t.p) AS t_stage, n.p AS n_stage, round(-exp(b1 * (gtvp_ml - g_m) / g_s + b2 * (max_node_mm - x_m) / x_s), 6) AS rfs
  FROM case_rows JOIN case_n n USING (case_id) JOIN case_t t USING (case_id), cxn_fit,
  (SELECT avg(gtvp_ml) AS g_m, stddev_samp(gtvp_ml) AS g_s, avg(max_node_mm) AS x_m, stddev_samp(max_node_mm) AS x_s FROM fx_cohort WHERE RFS > 0)""")
def m29_fitted(spark, sf):
    """N, T and risk models fitted on the cohort, saved, read back, and scored on the cases' masks."""
    path = _scratch(spark, "models")
    df = final_rows(spark, sf)
    n, t = train_final(df, N_FEATURES, "N", cl.N_CLASSES, path, "n"), train_final(df, T_FEATURES, "T", cl.T_CLASSES, path, "t")
    ms.save(ms.fit_cox(outcome(spark, sf), ["gtvp_ml", "max_node_mm"], 0.1), path, "risk")
    records = fx.clinical(spark, sf).select(F.col("c_custkey").alias("case_id"), "Age", "Gender", "HPV")
    out = scoring.score_with_models(fx.voxels(spark, sf), fx.volumes(spark, sf), records, ms.load(spark, path, "risk"), n, t)
    return out.select("case_id", "t_stage", "n_stage", F.round("rfs", 6).alias("rfs"))


@query("m29_score_without_models", f"SELECT case_id, 'T2' AS t_stage, {rule()} AS n_stage, 0.0::DOUBLE AS rfs FROM geometry_image")
def m29_bare(spark, sf):
    """Without any saved model: the rule's N and the safe values."""
    absent = ms.load(spark, _scratch(spark, "nothing"), "n")
    return scoring.score_with_models(fx.voxels(spark, sf), fx.volumes(spark, sf), fx.clinical(spark, sf).select(F.col("c_custkey").alias("case_id"), "Age"), absent, absent, absent)


ALL_T = ["0", "1", "2", "3", "4", "N"]


@query("m28_clean_vs_polluted")
def m28(spark, sf):
    """Four strategies for T: junk kept or dropped under boosting, then two clean logistic models; pooled score and its gain over the first."""
    df = fx.cohort(spark, sf).withColumn("T", cl.t_label("T_raw", "first_char")).where("T IS NOT NULL")
    clean = df.where(F.col("T").isin(cl.T_CLASSES))
    feats, size = cl.GEOMETRY + CLINICAL, SIZE + CLINICAL
    sets = lambda d: cy.usable_sets(sv.training_sets(d, "fold"), 1, 20)
    tag = lambda d, s: sets(d).withColumn("g", F.concat(F.lit(f"{s}|"), "g"))
    both = cy.cv_predictions(tag(df, "A").unionByName(tag(clean, "B")), feats, "T", ALL_T, PLAIN_BOOST)      # absent classes never win
    out = both.select(F.substring_index("g", "|", 1).alias("strategy"), "y", "p")
    for name, fs in (("C", feats), ("D", size)):
        out = out.unionByName(cy.cv_predictions(sets(clean), fs, "T", cl.T_CLASSES, cy.Ridge()).select(F.lit(name).alias("strategy"), "y", "p"))
    scores = cut(metrics.balanced_accuracy(out, group=["strategy"]))
    polluted = scores.where("strategy = 'A'").select("balanced_accuracy")
    return scores.withColumn("gain", F.col("balanced_accuracy") - polluted.scalar())


lsql.multinomial_views("m28c", cl.GEOMETRY + CLINICAL, cl.T_CLASSES, min_train=20, source="t_staged", label="t")
lsql.multinomial_views("m28d", SIZE + CLINICAL, cl.T_CLASSES, min_train=20, source="t_staged", label="t")
POOLED = "SELECT y, avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM {} GROUP BY 1"


@query("m28_clean_logistic", " UNION ALL ".join(
    f"SELECT '{k.upper()}' AS strategy, y AS label, round(recall, 7) AS recall, n, round(avg(recall) OVER (), 7) AS balanced_accuracy FROM ({POOLED.format(f'm28{k}_pred')})" for k in "cd"))
def m28_logistic(spark, sf):
    """Recall per class and pooled score of the two clean logistic strategies."""
    clean = t_rows(spark, sf).where(F.col("T").isin(cl.T_CLASSES))
    sets = cy.usable_sets(sv.training_sets(clean, "fold"), 1, 20)
    out = None
    for name, fs in (("C", cl.GEOMETRY + CLINICAL), ("D", SIZE + CLINICAL)):
        p = cut(cy.cv_predictions(sets, fs, "T", cl.T_CLASSES, cy.Ridge()))
        row = metrics.recalls(p).join(metrics.balanced_accuracy(p).select("balanced_accuracy"), how="full")      # one row joins all classes
        row = row.select(F.lit(name).alias("strategy"), "label", *r6("recall"), "n", F.round("balanced_accuracy", 7).alias("balanced_accuracy"))
        out = row if out is None else out.unionByName(row)
    return out

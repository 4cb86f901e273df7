"""Contract queries for sources, clinical algebra, joins, rules and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort import fixtures as fx
from voxcohort.functions import clinical as cl
from voxcohort.functions import staging
from voxcohort.operators import concordance as cc
from voxcohort.operators import joins, metrics, ranks, sweep
from voxcohort.plans.registry import query, view
from voxcohort.plans.views import rule
from voxcohort.sources import listing, sinks, tables

GEOM = cl.GEOMETRY
NCLS = "('N0','N1','N2','N3')"


def r6(*names):
    return [F.round(n, 7).alias(n) for n in names]


def sql6(*names):
    return ", ".join(f"round({n}, 7) AS {n}" for n in names)


# ------------------------------------------------------------------ S sources
view("fx_files", """
  SELECT unnest(list_filter([
    CASE WHEN case_id % 11 <> 3 THEN concat(p, '__CT.nii.gz') END, CASE WHEN case_id % 7 <> 2 THEN concat(p, '__PT.nii.gz') END,
    CASE WHEN case_id % 7 = 4 THEN concat(p, '_PET.nii.gz') END, CASE WHEN case_id % 5 <> 1 THEN concat(p, '.nii.gz') END,
    CASE WHEN case_id % 4 = 0 THEN concat(p, '_notes.txt') END], lambda x: x IS NOT NULL)) AS path
  FROM (SELECT case_id, concat('root/C', case_id % 8, '-', case_id, '/C', case_id % 8, '-', case_id) AS p FROM fx_volumes)""",
     ("fx_volumes",))
view("fx_parts", r"""
  SELECT path, split_part(path, '/', 2) AS "case", split_part(path, '/', 3) AS name FROM fx_files WHERE path LIKE '%.nii.gz'""",
     ("fx_files",))
view("fx_cases", """
  SELECT "case", min(path) FILTER (name LIKE '%\\_\\_CT.nii.gz' ESCAPE '\\') AS ct,
    coalesce(min(path) FILTER (name LIKE '%PT.nii.gz'), min(path) FILTER (name LIKE '%PET.nii.gz')) AS pet,
    min(path) FILTER (NOT regexp_matches(name, '__?(CT|PT|PET)\\.nii\\.gz$', 'i')) AS label
  FROM fx_parts GROUP BY 1""".replace("\\\\", "\\"), ("fx_parts",))


@query("s1_find_cases", 'SELECT "case", ct, pet, label FROM fx_cases WHERE ct IS NOT NULL AND pet IS NOT NULL AND label IS NOT NULL')
def s1(spark, sf):
    return listing.find_cases(fx.files(spark, sf))


@query("s1_find_labelled_cases", 'SELECT "case", ct, label FROM fx_cases WHERE ct IS NOT NULL AND label IS NOT NULL')
def s1_label(spark, sf):
    return listing.find_cases(fx.files(spark, sf), pet=False)


@query("s2_file_index", """SELECT "case", max(path) FILTER (name LIKE '%CT.nii.gz') AS ct,
  max(path) FILTER (name LIKE '%PT.nii.gz' OR name LIKE '%PET.nii.gz') AS pet FROM fx_parts
  WHERE regexp_matches(name, '(CT|PT|PET)\\.nii\\.gz$') GROUP BY 1""")
def s2(spark, sf):
    return listing.file_index(fx.files(spark, sf))


@query("s3_fold_masks", """SELECT concat('C', case_id % 8, '-', case_id) AS PatientID, cast(case_id % 5 AS INT) AS fold,
  concat('out/fold_', case_id % 5, '/validation/C', case_id % 8, '-', case_id, '.nii.gz') AS path FROM fx_volumes""")
def s3(spark, sf):
    return listing.fold_masks(fx.mask_files(spark, sf))


def _scratch(spark, name):
    """A folder for data a query writes and reads back."""
    from voxcohort.session import ensure_checkpoint_dir
    import uuid
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s4_clinical_csv", "SELECT trim(PatientID) AS PatientID, Age, HPV, trim(N_raw) AS N_raw FROM fx_clinical")
def s4(spark, sf):
    path = _scratch(spark, "clinical")
    fx.clinical(spark, sf).select("PatientID", "Age", "HPV", "N_raw").write.option("header", True).csv(path)
    df = tables.read_clinical_csv(spark, path)
    return df.select(F.trim("PatientID").alias("PatientID"), cl.number("Age").alias("Age"),
                     cl.number("HPV").cast("int").alias("HPV"), F.trim("N_raw").alias("N_raw"))


FEATURE_COLS = {"ct_gtvp_firstorder_Mean": "gtvp_ml * 2", "pt_gtvp_firstorder_Mean": "gtvp_ml / 3",
                "pt_gtvn_firstorder_Maximum": "max_node_mm / 4", "ct_gtvn_shape_Volume": "gtvn_total_ml"}


def feature_table(spark, sf):
    return fx.cohort(spark, sf).select("PatientID", F.lit("x").alias("err_ct_gtvp"),
                                       *[F.expr(e).alias(c) for c, e in FEATURE_COLS.items()])


@query("s5_feature_columns", f"SELECT PatientID, {', '.join(f'round({e}, 7) AS {c}' for c, e in FEATURE_COLS.items())} FROM fx_cohort")
def s5(spark, sf):
    path = _scratch(spark, "features") + ".parquet"
    feature_table(spark, sf).write.parquet(path)
    return tables.read_features(spark, path).select("PatientID", *r6(*FEATURE_COLS))


@query("s5_node_feature_columns", "SELECT PatientID, round(max_node_mm / 4, 7) AS pt_gtvn_firstorder_Maximum, round(gtvn_total_ml, 7) AS ct_gtvn_shape_Volume FROM fx_cohort")
def s5n(spark, sf):
    df = feature_table(spark, sf)
    return df.select("PatientID", *r6(*cl.radiomics_columns(df.columns, nodes_only=True)))


def splits_text(spark, sf):
    """Split JSON documents of at most 1000 patients each, per fold."""
    c = fx.clinical(spark, sf).where("fold is not null")
    folds = c.select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("f"), "PatientID", "c_custkey", "fold")
    body = folds.groupBy("f", F.expr("c_custkey div 1000").alias("part")).agg(F.to_json(F.struct(F.array(F.struct(
        F.col("f").alias("fold"),
        F.array_sort(F.collect_list(F.when(F.col("fold") != F.col("f"), F.col("PatientID")))).alias("train"),
        F.array_sort(F.collect_list(F.when(F.col("fold") == F.col("f"), F.col("PatientID")))).alias("val"),
    )).alias("folds"))).alias("body"))
    return body


@query("s6_splits", """SELECT f AS fold, CASE WHEN fold = f THEN 'val' ELSE 'train' END AS role, PatientID
  FROM fx_clinical, (VALUES (0),(1),(2),(3),(4)) t(f) WHERE fold IS NOT NULL""")
def s6(spark, sf):
    return tables.parse_splits(splits_text(spark, sf))


@query("s7_filter_splits", """SELECT f AS fold, CASE WHEN fold = f THEN 'val' ELSE 'train' END AS role, PatientID
  FROM fx_cohort, (VALUES (0),(1),(2),(3),(4)) t(f) WHERE fold IS NOT NULL AND n_gtvn > 0""")
def s7(spark, sf):
    present = fx.cohort(spark, sf).where("n_gtvn > 0")
    return tables.filter_splits(tables.parse_splits(splits_text(spark, sf)), present)


@query("s7_smoke_split", """SELECT 0 AS fold, CASE WHEN row_number() OVER (ORDER BY PatientID) = 1 THEN 'train' ELSE 'val' END AS role,
  PatientID FROM (SELECT PatientID FROM fx_clinical ORDER BY PatientID LIMIT 2)""")
def s7_smoke(spark, sf):
    return tables.smoke_split(fx.clinical(spark, sf))


@query("s8_tolerant_json", "SELECT PatientID, cast(Age AS INT) AS Age, Gender, HPV FROM fx_clinical")
def s8(spark, sf):
    r = fx.json_text(spark, sf).select("PatientID", tables.parse_tolerant(F.col("body")).alias("r"))
    return r.select("PatientID", "r.Age", "r.Gender", F.col("r.HPV Status").alias("HPV"))


@query("s9_case_outputs", f"""SELECT c_custkey AS case_id, {rule()} AS n_stage, concat('T', 1 + c_custkey % 4) AS t_stage,
  round(-gtvp_ml, 7) AS rfs FROM fx_cohort""")
def s9(spark, sf):
    path = _scratch(spark, "outputs")
    scores = fx.cohort(spark, sf).select(
        F.col("c_custkey").alias("case_id"), staging.rule_n("n_gtvn", "max_node_mm", "laterality").alias("n_stage"),
        staging.with_t_prefix((1 + F.col("c_custkey") % 4).cast("string")).alias("t_stage"), F.col("gtvp_ml").alias("risk"))
    sinks.write_case_outputs(scores, path)
    return spark.read.json(path).select("case_id", "n_stage", "t_stage", *r6("rfs"))


@query("s10_mask_round_trip", "SELECT v.case_id, nx, z, y, x, label FROM fx_voxels v JOIN fx_volumes h ON v.case_id = h.case_id WHERE label > 0")
def s10(spark, sf):
    path = _scratch(spark, "mask")
    sinks.write_mask(fx.voxels(spark, sf).where("label > 0").select("case_id", "z", "y", "x", "label"), fx.volumes(spark, sf), path)
    mask, head = sinks.read_mask(spark, path)
    return mask.join(head.select("case_id", "nx"), "case_id").select("case_id", "nx", "z", "y", "x", "label")


@query("s11_resume_append", "SELECT PatientID, round(gtvp_ml, 7) AS gtvp_ml FROM fx_cohort")
def s11(spark, sf):
    path = _scratch(spark, "rows")
    todo = fx.cohort(spark, sf).select("PatientID", "c_custkey", "gtvp_ml")
    compute = lambda left: left.select("PatientID", "gtvp_ml")
    sinks.append_missing(todo.where("c_custkey % 3 = 0"), compute, path)
    sinks.append_missing(todo, compute, path)
    return spark.read.json(path).select("PatientID", *r6("gtvp_ml"))


@query("s12_compact", "SELECT PatientID, round(gtvp_ml, 7) AS gtvp_ml FROM fx_cohort")
def s12(spark, sf):
    source, target = _scratch(spark, "jsonl"), _scratch(spark, "csv")
    rows = fx.cohort(spark, sf).select("PatientID", "gtvp_ml")
    rows.unionAll(rows).write.json(source)
    sinks.compact(spark, source, target)
    return spark.read.option("header", True).csv(target).select("PatientID", F.round(cl.number("gtvp_ml"), 7).alias("gtvp_ml"))


@query("s13_report", "SELECT PatientID, max_node_mm, HPV FROM fx_cohort")
def s13(spark, sf):
    path = _scratch(spark, "report")
    sinks.write_report(fx.cohort(spark, sf), ["PatientID", "max_node_mm", "HPV"], path)
    return spark.read.option("header", True).csv(path).select(
        "PatientID", cl.number("max_node_mm").alias("max_node_mm"), cl.number("HPV").cast("int").alias("HPV"))


@query("s14_state_or_fallback", "SELECT center, round(avg(gtvp_ml), 6) AS mean, round(stddev_pop(gtvp_ml), 6) AS sd, true AS missing_falls_back FROM fx_cohort GROUP BY 1")
def s14(spark, sf):
    path = _scratch(spark, "state")
    sinks.save_params(fx.cohort(spark, sf).groupBy("center").agg(F.avg("gtvp_ml").alias("mean"), F.stddev_pop("gtvp_ml").alias("sd")), path)
    found, absent = sinks.load_params(spark, path), sinks.load_params(spark, path + "-absent")
    return found.select("center", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.lit(absent is None).alias("missing_falls_back"))


@query("s15_manifest", """SELECT "case", channel, source, target FROM (
  SELECT "case", unnest(['CT','PET','label']) AS channel, unnest([ct, pet, label]) AS source,
    unnest([concat("case", '_0000.nii.gz'), concat("case", '_0001.nii.gz'), concat("case", '.nii.gz')]) AS target
  FROM fx_cases WHERE ct IS NOT NULL AND pet IS NOT NULL AND label IS NOT NULL)""")
def s15(spark, sf):
    return listing.training_manifest(listing.find_cases(fx.files(spark, sf)))


@query("s15_dataset_description", """SELECT count(*) AS "numTraining", 'PET' AS channel_1, 2 AS label_gtvn, '.nii.gz' AS file_ending
  FROM fx_cases WHERE ct IS NOT NULL AND pet IS NOT NULL AND label IS NOT NULL""")
def s15d(spark, sf):
    return listing.dataset_description(listing.find_cases(fx.files(spark, sf))).select(
        "numTraining", F.col("channel_names")["1"].alias("channel_1"), F.col("labels")["GTVn"].alias("label_gtvn"), "file_ending")


@query("s16_first_cases", 'SELECT "case" FROM fx_cases WHERE ct IS NOT NULL AND pet IS NOT NULL AND label IS NOT NULL ORDER BY 1 LIMIT 10')
def s16(spark, sf):
    return listing.first_cases(listing.find_cases(fx.files(spark, sf)), 10).select("case")


# --------------------------------------------------------- P clinical algebra
def odd_headers(spark, sf):
    return fx.cohort(spark, sf).select(
        F.concat(F.lit(" "), "PatientID").alias("Patient ID"), F.col("Age").alias("AGE"), F.col("Gender").alias("Sex"),
        F.col("HPV").alias("HPV Status (0/1)"), F.col("N_raw").alias("N-stage"), F.col("T_raw").alias("T stage"),
        F.col("RFS").alias("Survival days"), F.col("event").alias("Relapse"), F.lit(1).alias("TreatmentID"),
        F.lit(2).alias("Treatment"), F.lit(3).alias("Treatment (2)"))


@query("p1_headers_by_pattern", "SELECT PatientID, Age, Gender, HPV, N_raw AS Nstage, T_raw AS Tstage, RFS, event AS Relapse, 1 AS Treatment FROM fx_cohort")
def p1(spark, sf):
    df = odd_headers(spark, sf)
    found = cl.headers_by_pattern(df.columns, outcome=True)
    names = ["PatientID", "Age", "Gender", "HPV", "Nstage", "Tstage", "RFS", "Relapse", "Treatment"]
    return cl.rename_canonical(df, found).select(F.trim("PatientID").alias("PatientID"), *names[1:])


@query("p2_headers_by_letters", "SELECT PatientID, Age, Gender, HPV, 2 AS first_treatment, 3 AS last_treatment FROM fx_cohort")
def p2(spark, sf):
    df = odd_headers(spark, sf)
    first, last = cl.headers_by_letters(df.columns, "first"), cl.headers_by_letters(df.columns, "last")
    return df.select(F.trim("Patient ID").alias("PatientID"), F.col(first["Age"]).alias("Age"), F.col(first["Gender"]).alias("Gender"),
                     F.col(first["HPV"]).alias("HPV"), F.col(first["Treatment"]).alias("first_treatment"),
                     F.col(last["Treatment"]).alias("last_treatment"))


@query("p3_alternative_names", "SELECT PatientID, n_gtvn, max_node_mm FROM fx_cohort")
def p3(spark, sf):
    m = fx.cohort(spark, sf).select("PatientID", F.col("n_gtvn").alias("geom_n_nodes"), "max_node_mm")
    m = cl.pick_column(m, "n_gtvn", "n_gtvn", "geom_n_nodes")
    return cl.pick_column(m, "max_node_mm", "max_node_mm", "geom_max_node_mm")


@query("p4_center", "SELECT PatientID, split_part(PatientID, '-', 1) AS center FROM fx_clinical")
def p4(spark, sf):
    padded = fx.clinical(spark, sf).select(F.concat(F.lit(" "), "PatientID", F.lit("  ")).alias("PatientID"))
    return cl.trim_id(padded)


@query("p5_n_label", f"""SELECT PatientID, substr(upper(trim(N_raw)), 1, 2) AS trimmed, substr(upper(lead), 1, 2) AS untrimmed,
  substr(upper(lead), 1, 2) IN {NCLS} AS kept FROM (SELECT *, CASE WHEN c_custkey % 10 = 0 THEN concat(' ', N_raw) ELSE N_raw END AS lead FROM fx_clinical)""")
def p5(spark, sf):
    df = fx.clinical(spark, sf).withColumn("lead", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit(" "), "N_raw")).otherwise(F.col("N_raw")))
    raw = cl.n_label("lead", trim=False)
    return df.select("PatientID", cl.n_label("lead").alias("trimmed"), raw.alias("untrimmed"), raw.isin(cl.N_CLASSES).alias("kept"))


view("t_text", "SELECT PatientID, N_raw, T_raw, upper(coalesce(T_raw, 'nan')) AS t FROM fx_clinical", ("fx_clinical",))


@query("p6_t_label", """SELECT PatientID, CASE WHEN substr(trim(t), 1, 2) = 'T0' THEN 'T1' ELSE substr(trim(t), 1, 2) END AS two_char,
  replace(t, 'T', '') AS exact, substr(trim(replace(t, 'T', '')), 1, 1) AS first_char, substr(replace(t, 'T', ''), 1, 1) AS untrimmed FROM t_text""")
def p6(spark, sf):
    return fx.clinical(spark, sf).select(
        "PatientID", cl.t_label("T_raw").alias("two_char"), cl.t_label("T_raw", "exact").alias("exact"),
        cl.t_label("T_raw", "first_char").alias("first_char"), cl.t_label("T_raw", "first_char_untrimmed").alias("untrimmed"))


@query("p7_junk_labels", """SELECT PatientID, T_raw, substr(trim(replace(t, 'T', '')), 1, 1) AS t FROM t_text
  WHERE substr(trim(replace(t, 'T', '')), 1, 1) NOT IN ('1','2','3','4')""")
def p7(spark, sf):
    df = fx.clinical(spark, sf).withColumn("t", cl.t_label("T_raw", "first_char"))
    return df.where(~F.col("t").isin(cl.T_CLASSES)).select("PatientID", "T_raw", "t")


@query("p8_valid_outcomes", "SELECT PatientID, RFS, event FROM fx_cohort WHERE RFS > 0")
def p8(spark, sf):
    return cl.valid_outcomes(fx.cohort(spark, sf)).select("PatientID", "RFS", "event")


@query("p8_outcome_summary", """SELECT count_if(RFS > 0) AS n, count_if(NOT RFS > 0) AS dropped,
  round(avg(CASE WHEN RFS > 0 THEN event END), 7) AS event_rate FROM fx_cohort""")
def p8s(spark, sf):
    return cl.outcome_summary(fx.cohort(spark, sf)).select("n", "dropped", *r6("event_rate"))


@query("p9_numbers", "SELECT PatientID, try_cast(N_raw AS DOUBLE) AS n, try_cast(substr(T_raw, 2, 1) AS DOUBLE) AS t FROM fx_clinical")
def p9(spark, sf):
    df = fx.clinical(spark, sf).withColumn("digit", F.substring("T_raw", 2, 1))
    return df.select("PatientID", cl.number("N_raw").alias("n"), cl.number("digit").alias("t"))


@query("p10_laterality_flags", "SELECT PatientID, " + ", ".join(
    f"cast(laterality = '{lv}' AS INT) AS lat_{lv}" for lv in cl.LATERALITY_LEVELS) + " FROM fx_cohort")
def p10(spark, sf):
    return cl.laterality_flags(fx.cohort(spark, sf)).select("PatientID", *[f"lat_{lv}" for lv in cl.LATERALITY_LEVELS])


@query("p11_missing_flag", 'SELECT PatientID, cast(HPV IS NULL AS INT) AS "HPV_missing" FROM fx_clinical')
def p11(spark, sf):
    return cl.missing_flag(fx.clinical(spark, sf), "HPV").select("PatientID", "HPV_missing")


@query("p12_tlg", "SELECT PatientID, round(gtvp_ml * (gtvp_ml / 3), 7) AS tlg_gtvp, round(gtvn_total_ml * (max_node_mm / 4), 7) AS tlg_gtvn FROM fx_cohort")
def p12(spark, sf):
    df = fx.cohort(spark, sf).withColumns({"sp": F.col("gtvp_ml") / 3, "sn": F.col("max_node_mm") / 4})
    return df.select("PatientID", F.round(cl.tlg("gtvp_ml", "sp"), 7).alias("tlg_gtvp"), F.round(cl.tlg("gtvn_total_ml", "sn"), 7).alias("tlg_gtvn"))


@query("p13_find_first_order", "SELECT PatientID, round(gtvp_ml / 3, 7) AS suv_gtvp_mean, round(max_node_mm / 4, 7) AS suv_gtvn_max FROM fx_cohort")
def p13(spark, sf):
    df = feature_table(spark, sf)
    mean, top = cl.find_first_order(df.columns, "pt", "gtvp", "Mean"), cl.find_first_order(df.columns, "pt", "gtvn", "Maximum")
    return df.select("PatientID", F.round(mean, 7).alias("suv_gtvp_mean"), F.round(top, 7).alias("suv_gtvn_max"))


@query("p14_encoders", """SELECT PatientID, cast(CASE laterality WHEN 'bilateral' THEN 0 WHEN 'midline' THEN 1 WHEN 'none' THEN 2 WHEN 'unilateral' THEN 3 END AS DOUBLE) AS code,
  cast(NULL AS DOUBLE) AS unseen FROM fx_cohort""")
def p14(spark, sf):
    df = fx.cohort(spark, sf)
    levels = cl.fit_encoder(df, ["laterality"]).where("name = 'laterality'").select("levels").scalar()
    return df.select("PatientID", "laterality", levels.alias("lv")).select(
        "PatientID", cl.encode(F.col("laterality"), F.col("lv")).alias("code"), cl.encode(F.lit("sideways"), F.col("lv")).alias("unseen"))


@query("p15_short_names", "SELECT PatientID, cast(Age AS INT) AS Age, Gender, HPV FROM fx_clinical")
def p15(spark, sf):
    r = fx.json_text(spark, sf).select("PatientID", tables.parse_tolerant(F.col("body")).alias("r")).select("PatientID", "r.*")
    return r.select("PatientID", *[F.col(cl.LONG_NAMES[s]).alias(s) for s in ("Age", "Gender", "HPV")])


@query("p16_feature_row", 'SELECT PatientID, gtvp_ml, cast(n_gtvn AS DOUBLE) AS n_gtvn, Age, cast(NULL AS DOUBLE) AS "Tobacco", cast(HPV AS DOUBLE) AS HPV FROM fx_cohort')
def p16(spark, sf):
    return cl.feature_row(fx.cohort(spark, sf), ["gtvp_ml", "n_gtvn", "Age", "Tobacco", "HPV"])


@query("p17_survival_features", f"""SELECT PatientID, gtvp_ml, n_gtvn, max_node_mm, gtvn_total_ml,
  CASE {rule()} WHEN 'N0' THEN 0 WHEN 'N1' THEN 1 WHEN 'N2' THEN 2 ELSE 3 END AS "N_ordinal", Age, Gender, HPV FROM fx_cohort""")
def p17(spark, sf):
    df = fx.cohort(spark, sf).withColumn("rule_N", staging.rule_n("n_gtvn", "max_node_mm", "laterality"))
    return df.select("PatientID", *GEOM, staging.n_ordinal("rule_N").alias("N_ordinal"), "Age", "Gender", "HPV")


@query("p18_t_prefix", """SELECT PatientID, CASE WHEN upper(T_raw) LIKE 'T%' THEN T_raw ELSE concat('T', T_raw) END AS t
  FROM fx_clinical WHERE T_raw IS NOT NULL""")
def p18(spark, sf):
    return fx.clinical(spark, sf).where("T_raw is not null").select("PatientID", staging.with_t_prefix("T_raw").alias("t"))


@query("p19_model_or_rule", f"SELECT PatientID, CASE WHEN c_custkey % 3 = 0 THEN 'N1' ELSE {rule()} END AS n_stage FROM fx_cohort")
def p19(spark, sf):
    df = fx.cohort(spark, sf)
    learned = df.where("c_custkey % 3 = 0").select("PatientID", F.lit("N1").alias("learned"))
    return joins.with_metadata(df, learned, how="left").select(
        "PatientID", F.coalesce("learned", staging.rule_n("n_gtvn", "max_node_mm", "laterality")).alias("n_stage"))


@query("p20_safe_outputs", """SELECT c.PatientID, coalesce(CASE WHEN m.c_custkey IS NULL THEN NULL WHEN m.c_custkey % 4 = 0 THEN NULL ELSE 'T3' END, 'T2') AS t_stage,
  coalesce(CASE WHEN m.n_gtvn > 1 THEN 'N2' END, 'N0') AS n_stage, round(coalesce(m.gtvp_ml, 0), 7) AS rfs
  FROM fx_clinical c LEFT JOIN fx_meta m USING (c_custkey)""")
def p20(spark, sf):
    from voxcohort.plans.scoring import safe_outputs
    scored = fx.meta(spark, sf).select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, "T3").alias("t_stage"),
                                       F.when(F.col("n_gtvn") > 1, "N2").alias("n_stage"), F.col("gtvp_ml").alias("rfs"))
    out = safe_outputs(fx.clinical(spark, sf).select("c_custkey", "PatientID"), scored, "c_custkey")
    return out.select("PatientID", "t_stage", "n_stage", *r6("rfs"))


@query("p21_subgroups", """SELECT PatientID, CASE WHEN HPV IS NULL THEN 'missing' WHEN HPV = 1 THEN 'HPV+' ELSE 'HPV-' END AS "HPV_grp",
  substr(upper(N_raw), 1, 2) AS "N_grp", concat('T', substr(trim(replace(upper(coalesce(T_raw, 'nan')), 'T', '')), 1, 1)) AS "T_grp",
  CASE n_gtvn WHEN 0 THEN '0 nodes' WHEN 1 THEN '1 node' ELSE '2+ nodes' END AS node_grp FROM fx_cohort""")
def p21(spark, sf):
    return cl.subgroups(fx.cohort(spark, sf)).select("PatientID", "HPV_grp", "N_grp", "T_grp", "node_grp")


@query("p22_row_errors", """SELECT error, count(*) AS n FROM (SELECT CASE WHEN NOT RFS > 0 THEN 'follow-up time is not po'
  WHEN fold IS NULL THEN 'patient is in no fold' END AS error FROM fx_cohort) GROUP BY 1""")
def p22(spark, sf):
    checks = {"follow-up time is not positive": ~(F.col("RFS") > 0), "patient is in no fold": F.col("fold").isNull()}
    return cl.row_errors(fx.cohort(spark, sf), checks, 24).groupBy("error").agg(F.count("*").alias("n"))


@query("p23_risk_sign", "SELECT PatientID, round(-gtvp_ml, 7) AS rfs FROM fx_cohort")
def p23(spark, sf):
    return fx.cohort(spark, sf).select("PatientID", F.round(-F.col("gtvp_ml"), 7).alias("rfs"))


# -------------------------------------------------------------------- J joins
@query("j1_inner_metadata", "SELECT PatientID, n_gtvn, center FROM fx_cohort")
def j1(spark, sf):
    return joins.with_metadata(fx.clinical(spark, sf), fx.meta(spark, sf), "c_custkey").select(
        "PatientID", "n_gtvn", F.substring_index("PatientID", "-", 1).alias("center"))


@query("j2_left_features", "SELECT PatientID, n_gtvn, round(gtvp_ml / 3, 7) AS suv FROM fx_clinical LEFT JOIN fx_meta USING (c_custkey)")
def j2(spark, sf):
    df = fx.clinical(spark, sf).join(fx.meta(spark, sf), "c_custkey", "left")
    rad = feature_table(spark, sf).select("PatientID", F.col("pt_gtvp_firstorder_Mean").alias("suv"))
    return joins.with_metadata(df, rad, how="left").select("PatientID", "n_gtvn", *r6("suv"))


@query("j3_fold_lookup", "SELECT PatientID, fold FROM fx_clinical")
def j3(spark, sf):
    folds = tables.fold_of_patient(tables.parse_splits(splits_text(spark, sf)))
    return joins.with_fold(fx.clinical(spark, sf).drop("fold"), folds).select("PatientID", "fold")


@query("j4_train_validation", """SELECT f, count_if(fold IS DISTINCT FROM f) AS train, count_if(fold = f) AS valid
  FROM fx_cohort, (VALUES (0),(1),(2),(3),(4)) t(f) GROUP BY 1""")
def j4(spark, sf):
    df = joins.with_settings(fx.cohort(spark, sf), f=range(5))
    train = joins.is_train(F.col("fold"), F.col("f"))
    return df.groupBy("f").agg(F.count_if(train).alias("train"), F.count_if(~train).alias("valid"))


@query("j4_train_rows", "SELECT PatientID FROM fx_cohort WHERE fold IS DISTINCT FROM 0")
def j4_rows(spark, sf):
    df = fx.cohort(spark, sf)
    return joins.train_rows(df, df.where("fold = 0")).select("PatientID")


@query("j5_resume", "SELECT PatientID FROM fx_cohort WHERE c_custkey % 3 <> 0 AND n_gtvn > 0")
def j5(spark, sf):
    df = fx.cohort(spark, sf)
    return joins.remaining(df.select("PatientID"), df.where("c_custkey % 3 = 0"), df.where("n_gtvn > 0"))


@query("j6_predicted_vs_truth", "SELECT PatientID, n_gtvn AS n_gtvn_pred, laterality AS laterality_pred, n_gtvn + 1 AS n_gtvn_gt, laterality AS laterality_gt FROM fx_cohort")
def j6(spark, sf):
    df = fx.cohort(spark, sf)
    return joins.predicted_vs_truth(df, df.withColumn("n_gtvn", F.col("n_gtvn") + 1), ["n_gtvn", "laterality"])


@query("j7_case_assembly", """SELECT 'all' AS mode, count(*) AS n FROM fx_cases WHERE ct IS NOT NULL AND pet IS NOT NULL AND label IS NOT NULL
  UNION ALL SELECT 'optional', count(*) FROM fx_cases WHERE ct IS NOT NULL AND label IS NOT NULL""")
def j7(spark, sf):
    cases = listing.find_cases(fx.files(spark, sf), pet=False)
    pet = listing.file_index(fx.files(spark, sf)).where("pet is not null").select("case", "pet")
    ct, label = cases.select("case", "ct"), cases.select("case", "label")
    both = joins.assemble_cases(ct, pet, label, "case").withColumn("mode", F.lit("all"))
    some = joins.assemble_cases(ct, pet, label, "case", pet_required=False).withColumn("mode", F.lit("optional"))
    return both.unionByName(some).groupBy("mode").agg(F.count("*").alias("n"))


PAIRS = "FROM fx_cohort i JOIN fx_cohort j ON {on} WHERE i.RFS > 0 AND j.RFS > 0"


def valid(spark, sf):
    return cl.valid_outcomes(fx.cohort(spark, sf)).withColumn("risk", F.col("n_orders"))


@query("j8_comparable_pairs", "SELECT cast(count(*) AS BIGINT) AS comparable " + PAIRS.format(on="i.event = 1 AND j.RFS > i.RFS"))
def j8(spark, sf):
    return cc.concordance(valid(spark, sf)).select(F.col("comparable").cast("long").alias("comparable"))


@query("j9_overlay", "SELECT case_id, count(*) AS n, round(max(pet), 7) AS suvmax, count_if(ct > -500) AS body FROM fx_voxels WHERE label > 0 GROUP BY 1")
def j9(spark, sf):
    vox = fx.voxels(spark, sf)
    mask = vox.where("label > 0").select("case_id", "z", "y", "x", "label")
    hit = joins.overlay(mask, vox.select("case_id", "z", "y", "x", "pet", "ct"))
    return hit.groupBy("case_id").agg(F.count("*").alias("n"), F.round(F.max("pet"), 7).alias("suvmax"),
                                      F.count_if(F.col("ct") > -500).alias("body"))


@query("j10_settings_grid", f"""SELECT n3, n1, count_if({rule(n3='n3', n1='n1')} = 'N3') AS n_n3
  FROM fx_cohort, (VALUES (50),(55),(60)) a(n3), (VALUES (25),(35)) b(n1) GROUP BY 1, 2""")
def j10(spark, sf):
    df = joins.with_settings(fx.cohort(spark, sf), n3=(50, 55, 60), n1=(25, 35))
    p = staging.rule_n("n_gtvn", "max_node_mm", "laterality", F.col("n3"), F.col("n1"))
    return df.groupBy("n3", "n1").agg(F.count_if(p == "N3").alias("n_n3"))


@query("j12_fold_coverage", """SELECT (SELECT count(*) FROM fx_cohort WHERE fold IS NOT NULL) AS matched,
  (SELECT count(*) FROM fx_clinical WHERE fold IS NOT NULL) AS listed, (SELECT count(*) FROM fx_cohort WHERE fold IS NULL) AS in_no_fold""")
def j12(spark, sf):
    return metrics.fold_coverage(fx.cohort(spark, sf), fx.clinical(spark, sf).where("fold is not null"))


# -------------------------------------------------------------------- R rules
view("staged", f"""SELECT *, substr(upper(N_raw), 1, 2) AS y, {rule()} AS p FROM fx_cohort
  WHERE substr(upper(N_raw), 1, 2) IN {NCLS}""", ("fx_cohort",))


def staged(spark, sf):
    df = fx.cohort(spark, sf).withColumns({
        "y": cl.n_label("N_raw", trim=False), "p": staging.rule_n("n_gtvn", "max_node_mm", "laterality")})
    return df.where(F.col("y").isin(cl.N_CLASSES))


@query("r1_rule_n", f"SELECT PatientID, {rule()} AS n_stage FROM fx_cohort")
def r1(spark, sf):
    return fx.cohort(spark, sf).select("PatientID", staging.rule_n("n_gtvn", "max_node_mm", "laterality").alias("n_stage"))


HPV_RULE = f"""CASE WHEN HPV = 1 THEN CASE WHEN n_gtvn = 0 THEN 'N0' WHEN max_node_mm > 60 THEN 'N3' WHEN laterality = 'bilateral' THEN 'N2' ELSE 'N1' END
  ELSE {rule()} END"""


@query("r2_hpv_rule", f"SELECT PatientID, {HPV_RULE} AS n_stage FROM fx_cohort")
def r2(spark, sf):
    return fx.cohort(spark, sf).select("PatientID", staging.hpv_rule_n("n_gtvn", "max_node_mm", "laterality", "HPV").alias("n_stage"))


@query("r3_n_ordinal", f"SELECT PatientID, cast(substr({rule()}, 2, 1) AS INT) AS n_ordinal FROM fx_cohort")
def r3(spark, sf):
    df = fx.cohort(spark, sf).withColumn("s", staging.rule_n("n_gtvn", "max_node_mm", "laterality"))
    return df.select("PatientID", staging.n_ordinal("s").alias("n_ordinal"))


view("r4_grid", f"""SELECT n3, n1, a.i * 5 + b.i AS grid_idx, avg(recall) AS ba FROM (
    SELECT y, n3, n1, ai, bi, avg(CASE WHEN {rule(n3='n3', n1='n1')} = y THEN 1.0 ELSE 0.0 END) AS recall
    FROM staged, (VALUES (0,50),(1,55),(2,58),(3,60),(4,62),(5,65)) a(ai, n3), (VALUES (0,25),(1,28),(2,30),(3,32),(4,35)) b(bi, n1)
    GROUP BY ALL)
  GROUP BY ALL""".replace("a.i * 5 + b.i AS grid_idx", "ai * 5 + bi AS grid_idx"), ("staged",))


@query("r4_rule_grid", "SELECT grid_idx, n3, n1, round(ba, 7) AS balanced_accuracy FROM r4_grid")
def r4(spark, sf):
    return sweep.rule_grid(staged(spark, sf), "y").select("grid_idx", "n3", "n1", *r6("balanced_accuracy"))


@query("r4_best_rule", "SELECT n3, n1, round(ba, 7) AS balanced_accuracy FROM r4_grid ORDER BY round(ba, 12) DESC, grid_idx LIMIT 1")
def r4_best(spark, sf):
    return sweep.first_best(sweep.rule_grid(staged(spark, sf), "y")).select("n3", "n1", *r6("balanced_accuracy"))


view("r5_grid", f"""SELECT n1, n3, ai * 6 + bi AS grid_idx, avg(ba) AS ba FROM (
    SELECT n1, n3, ai, bi, fold, avg(recall) AS ba FROM (
      SELECT y, fold, n3, n1, ai, bi, avg(CASE WHEN {rule(n3='n3', n1='n1')} = y THEN 1.0 ELSE 0.0 END) AS recall
      FROM staged, (VALUES (0,20),(1,25),(2,30),(3,35),(4,40)) a(ai, n1), (VALUES (0,45),(1,50),(2,55),(3,60),(4,65),(5,70)) b(bi, n3)
      WHERE fold IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""", ("staged",))


@query("r5_best_rule_cv", "SELECT n1, n3, round(ba, 7) AS balanced_accuracy FROM r5_grid ORDER BY round(ba, 12) DESC, grid_idx LIMIT 1")
def r5(spark, sf):
    return sweep.first_best(sweep.rule_grid_cv(staged(spark, sf), "y")).select("n1", "n3", *r6("balanced_accuracy"))


@query("r7_rule_changes", f"SELECT count_if(p <> q) AS changed, count(*) AS n FROM (SELECT p, {HPV_RULE} AS q FROM staged)")
def r7(spark, sf):
    df = staged(spark, sf).withColumn("q", staging.hpv_rule_n("n_gtvn", "max_node_mm", "laterality", "HPV"))
    return df.agg(F.count_if(F.col("p") != F.col("q")).alias("changed"), F.count("*").alias("n"))


# ------------------------------------------------------------------ A metrics
view("recalls", "SELECT y AS label, avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM staged GROUP BY 1", ("staged",))


@query("a1_balanced_accuracy", "SELECT round(avg(recall), 7) AS balanced_accuracy, cast(sum(n) AS BIGINT) AS n FROM recalls")
def a1(spark, sf):
    return metrics.balanced_accuracy(staged(spark, sf)).select(*r6("balanced_accuracy"), "n")


@query("a2_confusion", "SELECT y AS truth, " + ", ".join(f"count_if(p = '{c}') AS \"pred_{c}\"" for c in cl.N_CLASSES)
       + ", round(avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END), 7) AS recall, count(*) AS support FROM staged GROUP BY 1")
def a2(spark, sf):
    m = metrics.confusion(staged(spark, sf), cl.N_CLASSES)
    return m.withColumn("recall", F.round("recall", 7))


@query("a3_recalls", "SELECT label, round(recall, 7) AS recall, n FROM recalls")
def a3(spark, sf):
    return metrics.recalls(staged(spark, sf)).select("label", *r6("recall"), "n")


@query("a4_top_mistakes", "SELECT concat(y, ' -> ', p) AS mistake, count(*) AS n FROM staged WHERE y <> p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def a4(spark, sf):
    return metrics.top_mistakes(staged(spark, sf))


view("by_center", """SELECT center, avg(recall) AS ba, cast(sum(n) AS BIGINT) AS n FROM (
  SELECT center, y, avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM staged GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 5""", ("staged",))


@query("a5_per_center", """SELECT center, round(CASE WHEN sum(n) >= 5 THEN avg(recall) END, 7) AS balanced_accuracy, cast(sum(n) AS BIGINT) AS n FROM (
  SELECT center, y, avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM staged GROUP BY 1, 2) GROUP BY 1""")
def a5(spark, sf):
    return metrics.per_center(staged(spark, sf)).select("center", *r6("balanced_accuracy"), "n")


MED = ["n_gtvn", "max_node_mm", "gtvn_total_ml"]


@query("a6_medians_by_class", "SELECT y, count(*) AS n, " + ", ".join(f"round(median({c}), 7) AS med_{c}" for c in MED) + " FROM staged GROUP BY 1")
def a6(spark, sf):
    return metrics.medians_by(staged(spark, sf), "y", MED).select("y", "n", *r6(*[f"med_{c}" for c in MED]))


@query("a7_distributions", """SELECT 'HPV' AS name, cast(HPV AS VARCHAR) AS value, count(*) AS n FROM fx_clinical GROUP BY 2
  UNION ALL SELECT 'N_raw', N_raw, count(*) FROM fx_clinical GROUP BY 2 UNION ALL SELECT 'T_raw', T_raw, count(*) FROM fx_clinical GROUP BY 2""")
def a7(spark, sf):
    return metrics.distribution(fx.clinical(spark, sf), ["HPV", "N_raw", "T_raw"])


@query("a8_crosstab", "SELECT laterality, " + ", ".join(f"count_if(p = '{c}') AS \"{c}\"" for c in cl.N_CLASSES) + " FROM staged GROUP BY 1")
def a8(spark, sf):
    return metrics.crosstab(staged(spark, sf), "laterality", "p", cl.N_CLASSES)


@query("a9_node_counts", """SELECT round(avg(n_gtvn), 7) AS mean_n, median(n_gtvn) AS median_n,
  round(avg(n_gtvn) FILTER (laterality = 'bilateral'), 7) AS mean_bilateral, median(n_gtvn) FILTER (laterality = 'bilateral') AS median_bilateral FROM fx_cohort""")
def a9(spark, sf):
    two = F.when(F.col("laterality") == "bilateral", F.col("n_gtvn"))
    return fx.cohort(spark, sf).agg(
        F.round(F.avg("n_gtvn"), 7).alias("mean_n"), F.median("n_gtvn").alias("median_n"),
        F.round(F.avg(two), 7).alias("mean_bilateral"), F.median(two).alias("median_bilateral"))


@query("a10_missing", """SELECT count_if(HPV IS NULL) AS "HPV", count_if(T_raw IS NULL) AS "T_raw", count_if(fold IS NULL) AS fold,
  count_if(HPV IS NULL OR T_raw IS NULL OR fold IS NULL) AS any_missing, count(*) AS n FROM fx_clinical""")
def a10(spark, sf):
    return metrics.missing_counts(fx.clinical(spark, sf), ["HPV", "T_raw", "fold"])


def pair_sql(group="", library=False, risk="n_orders", source="fx_cohort", where=""):
    """Oracle concordance by explicit pairs; ``group`` is a column both rows share."""
    on = "i.event = 1 AND (j.RFS > i.RFS" + (" OR (j.RFS = i.RFS AND j.event = 0)" if library else "") + ")"
    g = f"i.{group} AS {group}, " if group else ""
    by = f" GROUP BY i.{group}" if group else ""
    same = f" AND i.{group} = j.{group}" if group else ""
    return f"""SELECT {g}cast(count(*) AS BIGINT) AS comparable,
      sum(CASE WHEN i.{risk} > j.{risk} THEN 1.0 WHEN i.{risk} = j.{risk} THEN 0.5 ELSE 0.0 END)::DOUBLE AS concordant
      FROM {source} i JOIN {source} j ON {on}{same} WHERE i.RFS > 0 AND j.RFS > 0{where}{by}"""


SCORE = ["comparable", "concordant"]


def scored(df, *keys):
    return df.select(*keys, F.col("comparable").cast("long").alias("comparable"), "concordant", F.round("c_index", 7).alias("c_index"))


@query("a11_cindex_strict", f"SELECT *, round(concordant / comparable, 7) AS c_index FROM ({pair_sql()})")
def a11(spark, sf):
    return scored(cc.concordance(valid(spark, sf)))


@query("a12_cindex_library", f"SELECT *, round(concordant / comparable, 7) AS c_index FROM ({pair_sql(library=True)})")
def a12(spark, sf):
    return scored(cc.concordance(valid(spark, sf), rule="library"))


view("center_sizes", "SELECT center, count(*) AS n, cast(sum(event) AS BIGINT) AS events FROM fx_cohort WHERE RFS > 0 GROUP BY 1", ("fx_cohort",))


@query("a13_cindex_by_center", f"""SELECT center, n, events, CASE WHEN n >= 10 AND events >= 3 THEN round(concordant / comparable, 7) END AS c_index
  FROM ({pair_sql('center', True)}) JOIN center_sizes USING (center)""")
def a13(spark, sf):
    s = cc.guarded(cc.concordance(valid(spark, sf), group=["center"], rule="library"))
    return s.select("center", "n", "events", *r6("c_index"))


view("vol_edges", "SELECT quantile_cont(gtvp_ml, [0.0, 0.33, 0.66, 1.0]) AS q FROM fx_cohort WHERE RFS > 0", ("fx_cohort",))
view("vol_bins", """SELECT c.*, cast(CASE WHEN gtvp_ml > q[1] AND gtvp_ml <= q[2] THEN 0 WHEN gtvp_ml > q[2] AND gtvp_ml <= q[3] THEN 1
  WHEN gtvp_ml > q[3] AND gtvp_ml <= q[4] THEN 2 END AS INT) AS bin FROM fx_cohort c, vol_edges WHERE RFS > 0""", ("fx_cohort", "vol_edges"))


@query("a14_cindex_by_volume", f"""SELECT bin, n, events, round(concordant / comparable, 7) AS c_index FROM ({pair_sql('bin', True, source='vol_bins')})
  JOIN (SELECT bin, count(*) AS n, cast(sum(event) AS BIGINT) AS events FROM vol_bins GROUP BY 1) USING (bin) WHERE bin IS NOT NULL""")
def a14(spark, sf):
    s = cc.guarded(cc.concordance(cc.by_quantile_bin(valid(spark, sf), "gtvp_ml"), group=["bin"], rule="library"))
    return s.select("bin", "n", "events", *r6("c_index"))


SIGNALS = ["gtvp_ml", "n_gtvn", "max_node_mm", "gtvn_total_ml", "Age", "HPV", "n_orders"]
view("signal_long", "SELECT PatientID, RFS, event, feature, coalesce(v, median(v) OVER (PARTITION BY feature)) AS v FROM (" + " UNION ALL ".join(
    f"SELECT PatientID, RFS, event, '{f}' AS feature, cast({f} AS DOUBLE) AS v FROM fx_cohort WHERE RFS > 0" for f in SIGNALS if f != "HPV") + ")", ("fx_cohort",))


@query("a15_univariate_signal", f"""SELECT feature, round(c, 7) AS c_index, round(abs(c - 0.5), 7) AS signal FROM (
  SELECT feature, 1 - concordant / comparable AS c FROM ({pair_sql('feature', True, 'v', 'signal_long')}))
  ORDER BY abs(c - 0.5) DESC, feature DESC LIMIT 20""")
def a15(spark, sf):
    s = cc.univariate_signal(valid(spark, sf), SIGNALS)
    return s.select("feature", *r6("c_index", "signal")).orderBy(F.desc("signal"), F.desc("feature")).limit(20)


@query("a16_volume_proxies", """SELECT unnest(['gtvn_total_ml','max_node_mm','n_orders']) AS feature,
  unnest([round(corr(gtvn_total_ml, gtvp_ml), 7), round(corr(max_node_mm, gtvp_ml), 7), round(corr(n_orders, gtvp_ml), 7)]) AS r,
  unnest([abs(corr(gtvn_total_ml, gtvp_ml)) > 0.8, abs(corr(max_node_mm, gtvp_ml)) > 0.8, abs(corr(n_orders, gtvp_ml)) > 0.8]) AS proxy
  FROM fx_cohort WHERE RFS > 0""")
def a16(spark, sf):
    s = metrics.pearson_screen(valid(spark, sf), ["gtvn_total_ml", "max_node_mm", "n_orders", "HPV"], "gtvp_ml")
    return s.select("feature", *r6("r"), "proxy")


view("by_fold", """SELECT fold, avg(recall) AS ba, cast(sum(n) AS BIGINT) AS n FROM (
  SELECT fold, y, avg(CASE WHEN p = y THEN 1.0 ELSE 0.0 END) AS recall, count(*) AS n FROM staged WHERE fold IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", ("staged",))


@query("a17_fold_mean_std", "SELECT round(avg(ba), 7) AS mean, round(stddev_pop(ba), 7) AS std, count(ba) AS folds FROM by_fold")
def a17(spark, sf):
    per = metrics.balanced_accuracy(staged(spark, sf).where("fold is not null"), group=["fold"])
    return metrics.fold_mean_std(per, "balanced_accuracy").select(*r6("mean", "std"), "folds")


@query("a18_weighted_loco", f"""SELECT round(avg(c), 7) AS unweighted, round(sum(c * n) / sum(n), 7) AS weighted FROM (
  SELECT concordant / comparable AS c, n FROM ({pair_sql('center', True)}) JOIN center_sizes USING (center) WHERE n >= 10 AND events >= 3)""")
def a18(spark, sf):
    s = cc.guarded(cc.concordance(valid(spark, sf), group=["center"], rule="library"))
    return metrics.weighted_means(s).select(*r6("unweighted", "weighted"))


@query("a19_paired_wins", f"""SELECT count_if(NOT d > 0) AS base_wins, count_if(d > 0) AS rival_wins, round(avg(d), 7) AS diff_mean, round(stddev_pop(d), 7) AS diff_std
  FROM (SELECT b.concordant / b.comparable AS x, r.concordant / r.comparable AS y, y - x AS d FROM ({pair_sql('center', True)}) r
  JOIN ({pair_sql('center', True, 'gtvp_ml')}) b USING (center))""")
def a19(spark, sf):
    df = valid(spark, sf)
    pick = F.explode(F.array(F.struct(F.lit("volume").alias("model"), F.col("gtvp_ml").alias("risk")),
                             F.struct(F.lit("orders").alias("model"), F.col("n_orders").alias("risk"))))
    long = df.drop("risk").withColumn("m", pick).select("center", "RFS", "event", "m.model", "m.risk")
    s = cc.concordance(long, group=["center", "model"], rule="library")
    return metrics.paired(s, "center", "model", "c_index", "volume", "orders").select(
        "base_wins", "rival_wins", *r6("diff_mean", "diff_std"))


view("risk_pct", """SELECT *, (rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2.0) / count(*) OVER () AS risk_pct,
  (rank() OVER (ORDER BY RFS) + (count(*) OVER (PARTITION BY RFS) - 1) / 2.0) / count(*) OVER () AS time_pct
  FROM fx_cohort WHERE RFS > 0""", ("fx_cohort",))


def with_pcts(spark, sf):
    df = ranks.add_rank(valid(spark, sf), "risk", "risk_pct", pct=True)
    return ranks.add_rank(df, "RFS", "time_pct", pct=True)


@query("a20_early_late", """SELECT round(avg(risk_pct) FILTER (RFS <= med), 7) AS early, round(avg(risk_pct) FILTER (RFS > med), 7) AS late
  FROM (SELECT *, median(RFS) OVER () AS med FROM risk_pct WHERE event = 1)""")
def a20(spark, sf):
    ev = with_pcts(spark, sf).where("event = 1")
    med = ranks.exact_quantiles(ev, "RFS", [0.5]).select("value").scalar()
    soon = F.col("RFS") <= med
    return ev.agg(F.round(F.avg(F.when(soon, F.col("risk_pct"))), 7).alias("early"),
                  F.round(F.avg(F.when(~soon, F.col("risk_pct"))), 7).alias("late"))


@query("a21_verdict", f"""SELECT CASE WHEN h - r > 0.01 AND hl >= rl - 0.02 THEN 'helps' WHEN h - r > 0.01 THEN 'overfit risk' ELSE 'no gain' END AS verdict FROM (
  SELECT avg(ba) AS r, avg(hba) AS h, (SELECT avg(ba) FROM by_center) AS rl, (SELECT avg(b) FROM (SELECT center, avg(rc) AS b FROM (
    SELECT center, y, avg(CASE WHEN {HPV_RULE} = y THEN 1.0 ELSE 0.0 END) AS rc FROM staged GROUP BY 1, 2) GROUP BY 1)) AS hl
  FROM by_fold JOIN (SELECT fold, avg(rc) AS hba FROM (SELECT fold, y, avg(CASE WHEN {HPV_RULE} = y THEN 1.0 ELSE 0.0 END) AS rc
    FROM staged WHERE fold IS NOT NULL GROUP BY 1, 2) GROUP BY 1) USING (fold))""")
def a21(spark, sf):
    df = staged(spark, sf)
    rules = F.explode(F.array(
        F.struct(F.lit("plain").alias("m"), F.col("p").alias("v")),
        F.struct(F.lit("hpv").alias("m"), staging.hpv_rule_n("n_gtvn", "max_node_mm", "laterality", "HPV").alias("v"))))
    long = df.select("y", "fold", "center", rules.alias("r")).select("y", "fold", "center", F.col("r.m").alias("m"), F.col("r.v").alias("p"))
    cv = metrics.balanced_accuracy(long.where("fold is not null"), group=["m", "fold"]).withColumn("kind", F.lit("cv"))
    lo = metrics.balanced_accuracy(long, group=["m", "center"]).where("n >= 5").withColumn("kind", F.lit("loco"))
    both = cv.select("m", "kind", "balanced_accuracy").unionByName(lo.select("m", "kind", "balanced_accuracy"))
    pick = lambda m, k: F.avg(F.when((F.col("m") == m) & (F.col("kind") == k), F.col("balanced_accuracy")))
    one = both.agg(pick("plain", "cv").alias("r"), pick("hpv", "cv").alias("h"), pick("plain", "loco").alias("rl"), pick("hpv", "loco").alias("hl"))
    return one.select(metrics.verdict(F.col("h") - F.col("r"), F.col("hl"), F.col("rl"), 0.01, 0.02).alias("verdict"))


@query("a22_best_row", "SELECT center, round(ba, 7) AS balanced_accuracy FROM by_center ORDER BY ba DESC NULLS LAST, center LIMIT 1")
def a22(spark, sf):
    return metrics.best_row(metrics.per_center(staged(spark, sf)), "balanced_accuracy", "center").select("center", *r6("balanced_accuracy"))


# ------------------------------------------------------------------ W ranking
@query("w1_average_rank", """SELECT PatientID, center, rank() OVER (PARTITION BY center ORDER BY n_orders) +
  (count(*) OVER (PARTITION BY center, n_orders) - 1) / 2.0 AS rk FROM fx_cohort""")
def w1(spark, sf):
    return ranks.add_rank(fx.cohort(spark, sf), "n_orders", "rk", ["center"]).select("PatientID", "center", "rk")


@query("w2_percent_rank", "SELECT PatientID, round(risk_pct, 7) AS risk_pct, round(time_pct, 7) AS time_pct FROM risk_pct")
def w2(spark, sf):
    return with_pcts(spark, sf).select("PatientID", *r6("risk_pct", "time_pct"))


@query("w3_misranked", """(SELECT 'missed' AS kind, PatientID, round(time_pct - (1 - risk_pct), 7) AS miss FROM risk_pct WHERE event = 1 ORDER BY 3 DESC, 2 LIMIT 10)
  UNION ALL (SELECT 'false alarm', PatientID, round(risk_pct - time_pct, 7) AS miss FROM risk_pct WHERE event = 0 ORDER BY 3 DESC, 2 LIMIT 10)""")
def w3(spark, sf):
    df = with_pcts(spark, sf)
    hot = df.where("event = 1").select(F.lit("missed").alias("kind"), "PatientID", F.round(F.col("time_pct") - (1 - F.col("risk_pct")), 7).alias("miss"))
    cold = df.where("event = 0").select(F.lit("false alarm").alias("kind"), "PatientID", F.round(F.col("risk_pct") - F.col("time_pct"), 7).alias("miss"))
    order = [F.desc("miss"), "PatientID"]
    return ranks.top_k(hot, order, 10).unionByName(ranks.top_k(cold, order, 10))


@query("w5_top_features", f"""SELECT feature, round(abs(c - 0.5), 7) AS signal FROM (SELECT feature, 1 - concordant / comparable AS c
  FROM ({pair_sql('feature', True, 'v', 'signal_long')})) ORDER BY 2 DESC, 1 DESC LIMIT 3""")
def w5(spark, sf):
    s = cc.univariate_signal(valid(spark, sf), SIGNALS).select("feature", *r6("signal"))
    return ranks.top_k(s, [F.desc("signal"), F.desc("feature")], 3)


@query("w6_ordered_cases", "SELECT PatientID, fold FROM fx_cohort ORDER BY PatientID")
def w6(spark, sf):
    return fx.cohort(spark, sf).select("PatientID", "fold").orderBy("PatientID")


@query("w7_stratified_folds", """SELECT seed, PatientID, cast((row_number() OVER (PARTITION BY seed, event, center
    ORDER BY substr(md5(concat(seed, '-', PatientID)), 1, 12)) - 1) % 5 AS INT) AS cv_fold
  FROM fx_cohort, (SELECT unnest(range(0, 10)) AS seed) WHERE RFS > 0""")
def w7(spark, sf):
    f = ranks.stratified_folds(valid(spark, sf).select("PatientID", "event", "center"), ["event", "center"])
    return f.select("seed", "PatientID", "cv_fold")


POISSON = [0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.061313240195240384, 0.015328310048810096,
           0.0030656620097620196, 0.0005109436682936699, 0.00007299195261338141, 0.000009123994076672677, 0.0000010137771196302974]
CDF = [sum(POISSON[:k + 1]) for k in range(10)]
DRAW = " + ".join(f"(u >= {c!r})::INT" for c in CDF)


@query("w8_bootstrap", f"""SELECT cast(replicate AS INT) AS replicate, cast(sum(m) AS BIGINT) AS n, cast(sum(m * event) AS BIGINT) AS events FROM (SELECT replicate, event, {DRAW} AS m FROM (
  SELECT replicate, event, ('0x' || substr(md5(concat('boot-', replicate, '-', PatientID)), 1, 12))::BIGINT / 281474976710656.0 AS u
  FROM fx_cohort, range(0, 40) r(replicate) WHERE RFS > 0)) GROUP BY 1""")
def w8(spark, sf):
    b = ranks.poisson_bootstrap(valid(spark, sf).select("PatientID", "event"), 40)
    return b.groupBy("replicate").agg(F.sum("multiplicity").alias("n"), F.sum(F.col("multiplicity") * F.col("event")).alias("events"))


@query("w8_feature_subsets", "SELECT cast(replicate AS INT) AS replicate, feature FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature FROM fx_cohort WHERE RFS > 0 HAVING count(DISTINCT {f}) > 1" for f in SIGNALS) + """), range(0, 40) r(replicate)
  QUALIFY row_number() OVER (PARTITION BY replicate ORDER BY substr(md5(concat('cols-', replicate, '-', feature)), 1, 12), feature) <= greatest(2, round(0.6 * count(*) OVER (PARTITION BY replicate)))""")
def w8f(spark, sf):
    """Subsets of the columns that vary over the rows."""
    value = lambda f: F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v"))
    long = valid(spark, sf).select(F.explode(F.array(*map(value, SIGNALS))).alias("i")).select("i.*").where("v IS NOT NULL")
    varying = long.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high")
    return ranks.random_subset(varying, 40, 0.6)


@query("w9_set_checks", """SELECT 'union' AS kind, count(*) AS n FROM (SELECT PatientID FROM fx_clinical WHERE fold = 0 UNION SELECT PatientID FROM fx_cohort)
  UNION ALL SELECT 'intersect', count(*) FROM (SELECT PatientID FROM fx_clinical WHERE fold = 0 INTERSECT SELECT PatientID FROM fx_cohort)
  UNION ALL SELECT 'except', count(*) FROM (SELECT PatientID FROM fx_cohort EXCEPT SELECT PatientID FROM fx_clinical WHERE fold = 0)""")
def w9(spark, sf):
    a = fx.clinical(spark, sf).where("fold = 0").select("PatientID")
    b = fx.cohort(spark, sf).select("PatientID")
    sized = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return sized(a.union(b).distinct(), "union").unionByName(sized(a.intersect(b), "intersect")).unionByName(sized(b.subtract(a), "except"))


@query("w10_union_cases", "SELECT PatientID FROM fx_cohort WHERE n_gtvn = 0 UNION ALL SELECT PatientID FROM fx_cohort WHERE n_gtvn = 3")
def w10(spark, sf):
    df = fx.cohort(spark, sf)
    return df.where("n_gtvn = 0").select("PatientID").unionByName(df.where("n_gtvn = 3").select("PatientID"))

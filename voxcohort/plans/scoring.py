"""Batch scoring of cases, with the rule fallbacks and safe defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxcohort.functions import clinical, staging
from voxcohort.operators import modelstate, nodes

# fixed values a case gets when its scoring failed
SAFE = {"t_stage": "T2", "n_stage": "N0", "rfs": 0.0}
SCORED = ["gtvp_ml", "n_gtvn", "max_node_mm", "gtvn_total_ml", "N_ordinal", "Age"]


def safe_outputs(cases: DataFrame, scored: DataFrame, on: str = "case_id") -> DataFrame:
    """Every listed case with all outputs; failed ones get the safe defaults."""
    out = cases.join(scored, on, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in SAFE.items()})


def risk_from_state(df: DataFrame, state: DataFrame) -> DataFrame:
    """Partial hazard from a saved state (feature, med, mu, sd, beta), one row per feature.

    The state becomes a single row, its terms in the order of the columns they belong
    to; features that ``df`` lacks count with their median.
    """
    columns = [c for c, t in df.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean", "string")]
    place = df.sparkSession.createDataFrame(list(enumerate(columns)), "pos int, feature string")
    own, known = F.struct("pos", "med", "mu", "sd", "beta"), F.col("pos").isNotNull()
    effect = lambda v, t: t["beta"] * (F.coalesce(v, t["med"]) - t["mu"]) / t["sd"]
    terms = place.join(state.select("feature", "med", "mu", "sd", "beta"), "feature", "full").agg(
        F.sort_array(F.collect_list(F.when(known, own))).alias("_terms"),
        F.coalesce(F.sum(F.when(~known, effect(F.col("med"), own))), F.lit(0.0)).alias("_rest"))
    values = F.array(*[F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns])
    effects = F.zip_with(values, "_terms", lambda v, t: F.coalesce(effect(v, t), F.lit(0.0)))
    risk = F.exp(F.col("_rest") + F.aggregate(effects, F.lit(0.0), lambda x, y: x + y))
    return df.crossJoin(F.broadcast(terms)).withColumn("risk", risk).drop("_terms", "_rest")      # one row of terms


def score_cases(voxels: DataFrame, headers: DataFrame, records: DataFrame, state: DataFrame,
                learned_n: DataFrame | None = None, learned_t: DataFrame | None = None,
                n3: float = staging.N3_MM, n1: float = staging.N1_MAX_MM) -> DataFrame:
    """Masks and clinical records to T stage, N stage and risk for every case.

    The rule's N always feeds the risk model; the reported N is the learned one
    where there is one. Reported ``rfs`` is minus the risk.
    """
    geometry = nodes.case_geometry(nodes.clean_mask(voxels, headers), headers, nodes.image_midline(headers))
    rule = staging.rule_n("n_gtvn", "max_node_mm", "laterality", n3, n1)
    df = geometry.join(records, "case_id", "left").withColumn("n_rule", rule).withColumn("N_ordinal", staging.n_ordinal("n_rule"))
    df = risk_from_state(df, state)
    for name, table in (("learned_n", learned_n), ("learned_t", learned_t)):
        df = df.withColumn(name, F.lit(None).cast("string")) if table is None else df.join(
            table.select("case_id", F.col("stage").alias(name)), "case_id", "left")
    scored = df.select("case_id", F.coalesce("learned_n", "n_rule").alias("n_stage"),
                       F.when(F.col("learned_t").isNotNull(), staging.with_t_prefix("learned_t")).alias("t_stage"), (-F.col("risk")).alias("rfs"))
    return safe_outputs(headers.select("case_id"), scored)


def score_with_models(voxels: DataFrame, headers: DataFrame, records: DataFrame, risk: DataFrame | None = None,
                      n_model: DataFrame | None = None, t_model: DataFrame | None = None,
                      n3: float = staging.N3_MM, n1: float = staging.N1_MAX_MM) -> DataFrame:
    """Masks and clinical records to T stage, N stage and risk from saved model states.

    Without an N model the rule's N is reported; without a T or risk model the safe
    value is. The rule's N always feeds the risk model. Reported ``rfs`` is minus the risk.
    """
    geometry = nodes.case_geometry(nodes.clean_mask(voxels, headers), headers, nodes.image_midline(headers))
    df = clinical.laterality_flags(geometry.join(records, "case_id", "left")).withColumn("n_rule", staging.rule_n("n_gtvn", "max_node_mm", "laterality", n3, n1))
    df = df.withColumns({"N_ordinal": staging.n_ordinal("n_rule"), "n_stage": F.col("n_rule"), "t_stage": F.lit(None).cast("string"), "risk": F.lit(None).cast("double")})
    if n_model is not None:
        df = modelstate.stage(df, n_model, "n_stage")
    if t_model is not None:
        df = modelstate.stage(df, t_model, "t_stage").withColumn("t_stage", staging.with_t_prefix("t_stage"))
    if risk is not None:
        df = modelstate.risk(df, risk)
    return safe_outputs(headers.select("case_id"), df.select("case_id", "n_stage", "t_stage", (-F.col("risk")).alias("rfs")))

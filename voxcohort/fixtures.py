"""Deterministic views that give the driver tables the shapes of FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clinical(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("C"), (F.col("c_nationkey") % 8).cast("string"), F.lit("-"), key.cast("string")).alias("PatientID"),
        key,
        (30 + key % 50).cast("double").alias("Age"),
        (key % 2).cast("int").alias("Gender"),
        F.when(key % 4 == 0, None).when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1).otherwise(0).alias("HPV"),
        F.when(key % 37 == 0, "Nx").when(F.col("c_acctbal") < 0, "n0 ").when(F.col("c_acctbal") < 2500, "N1")
        .when(F.col("c_acctbal") < 8000, "N2b").otherwise("N3").alias("N_raw"),
        F.when(key % 41 == 0, None).when(key % 43 == 0, "T0").when(key % 3 == 0, "4a")
        .otherwise(F.concat(F.lit("T"), (1 + key % 4).cast("string"))).alias("T_raw"),
        F.when(key % 53 == 0, None).otherwise((key % 5).cast("int")).alias("fold"),
    )


def meta(spark, sf) -> DataFrame:
    quarter = F.count("*") % 4
    key = F.col("o_custkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("RFS"),
        F.max(F.when(F.col("o_orderkey") % 40 == 0, 1).otherwise(0)).alias("event"),
        (F.sum("o_totalprice") / 1e5).alias("gtvp_ml"),
        quarter.cast("int").alias("n_gtvn"),
        F.when(quarter == 0, 0.0).otherwise((key * 7 % 71).cast("double")).alias("max_node_mm"),
        F.when(quarter == 0, 0.0).otherwise(F.min("o_totalprice") / 5000.0).alias("gtvn_total_ml"),
        F.when(quarter == 0, "none").when(key % 7 == 0, "midline").when(key % 3 == 0, "bilateral")
        .otherwise("unilateral").alias("laterality"),
        F.count("*").cast("double").alias("n_orders"),
    ).withColumnRenamed("o_custkey", "c_custkey")


def cohort(spark, sf) -> DataFrame:
    """Clinical rows joined to their metadata (patients without orders drop out)."""
    return clinical(spark, sf).join(meta(spark, sf), "c_custkey").withColumn(
        "center", F.substring_index("PatientID", "-", 1))


def _grid(spark, sf, threshold: float, offset: int) -> DataFrame:
    cells = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "val")
    ).withColumn("v", F.col("val").cast("double"))
    at = lambda text: F.expr(text).cast("int")
    return cells.select(
        F.expr("vec_id div 8").alias("case_id"),
        at(f"{offset} + pos div 16 + 4*((vec_id % 8) div 4)").alias("z"),
        at(f"{offset} + (pos div 4) % 4 + 4*((vec_id div 2) % 2)").alias("y"),
        at(f"{offset} + pos % 4 + 4*(vec_id % 2)").alias("x"),
        F.when(F.col("v") > threshold, F.when(F.col("label") % 3 == 0, 1).otherwise(2)).otherwise(0).alias("label"),
        F.when(F.col("v") > 0, 12 * F.col("v")).otherwise(0.0).alias("pet"),
        (600 * F.col("v") - 420).alias("ct"),
    )


def voxels(spark, sf) -> DataFrame:
    return _grid(spark, sf, 0.18, 2)


def truth(spark, sf) -> DataFrame:
    return _grid(spark, sf, 0.14, 2)


def border_voxels(spark, sf) -> DataFrame:
    return _grid(spark, sf, 0.18, 0)


def volumes(spark, sf, size: int = 12) -> DataFrame:
    case = F.col("case_id")
    spacing = F.when(case % 3 == 0, 2).when(case % 3 == 1, 4).otherwise(8).cast("double")
    return (
        table(spark, sf, "embeddings").select(F.expr("vec_id div 8").alias("case_id")).distinct()
        .select(
            "case_id", F.lit(size).alias("nx"), F.lit(size).alias("ny"), F.lit(size).alias("nz"),
            spacing.alias("sx"), spacing.alias("sy"),
            F.when(case % 4 == 0, 0.8).when(case % 4 == 1, 3.0).when(case % 4 == 2, 5.0).otherwise(8.0).alias("sz"),
            F.lit(0.0).alias("ox"), F.lit(0.0).alias("oy"), F.lit(0.0).alias("oz"),
            F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)],
                    F.when(case % 2 == 1, -1.0).otherwise(1.0)).alias("dir"),
        )
    )


def border_volumes(spark, sf) -> DataFrame:
    return volumes(spark, sf, size=8)


def files(spark, sf) -> DataFrame:
    """Paths as a file listing would give them; some cases miss a role."""
    case = F.col("case_id")
    name = F.concat(F.lit("C"), (case % 8).cast("string"), F.lit("-"), case.cast("string"))
    role = lambda keep, suffix: F.when(keep, F.concat(F.lit("root/"), name, F.lit("/"), name, F.lit(suffix)))
    return volumes(spark, sf).select(F.explode(F.array_compact(F.array(
        role(case % 11 != 3, "__CT.nii.gz"),
        role(case % 7 != 2, "__PT.nii.gz"),
        role(case % 7 == 4, "_PET.nii.gz"),
        role(case % 5 != 1, ".nii.gz"),
        role(case % 4 == 0, "_notes.txt"),
    ))).alias("path"))


def mask_files(spark, sf) -> DataFrame:
    case = F.col("case_id")
    return volumes(spark, sf).select(F.concat(
        F.lit("out/fold_"), (case % 5).cast("string"), F.lit("/validation/C"), (case % 8).cast("string"),
        F.lit("-"), case.cast("string"), F.lit(".nii.gz")).alias("path"))


def json_text(spark, sf) -> DataFrame:
    """One JSON record per patient; every fifth ends with a trailing comma."""
    body = F.to_json(F.struct(
        F.col("Age").cast("int").alias("Age"), F.col("Gender"), F.col("HPV").alias("HPV Status")))
    broken = F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(",}"))
    return clinical(spark, sf).select("PatientID", "c_custkey", body.alias("body")).select(
        "PatientID", F.when(F.col("c_custkey") % 5 == 0, broken).otherwise(F.col("body")).alias("body"))

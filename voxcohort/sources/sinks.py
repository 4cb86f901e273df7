"""Writers: scalar outputs, masks, incremental feature rows, reports, model state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_case_outputs(scores: DataFrame, path: str) -> None:
    """One JSON row per case: t_stage, n_stage and rfs (minus risk, so it orders like time)."""
    scores.select("case_id", "t_stage", "n_stage", (-F.col("risk")).alias("rfs")).write.mode("overwrite").json(path)


def write_mask(mask: DataFrame, headers: DataFrame, path: str, buckets: int = 256) -> None:
    """Sparse mask voxels and the grid they live on."""
    mask.withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets))).write.mode("overwrite").partitionBy(
        "bucket").parquet(f"{path}/voxels")
    headers.write.mode("overwrite").parquet(f"{path}/volumes")


def read_mask(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/voxels").drop("bucket"), spark.read.parquet(f"{path}/volumes")


def read_or_none(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame | None:
    """Load an optional table; None where it is missing or holds no file yet."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_missing(todo: DataFrame, compute, path: str, on: str = "PatientID") -> None:
    """Compute and append only the keys the output does not hold yet."""
    done = read_or_none(todo.sparkSession, path)
    left = todo if done is None else todo.join(done.select(on).distinct(), on, "left_anti")
    compute(left).write.mode("append").json(path)


def first_per_key(rows: DataFrame, key: str = "PatientID", order: list[str] | None = None) -> DataFrame:
    """Keep the first row of every key by ``order`` (all columns when not given).

    A grouped minimum, so a key with very many copies is reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*(order or rest)))
    return rows.groupBy(key).agg(first.alias("_r")).select(key, "_r.*").select(*rows.columns)


def compact(spark: SparkSession, source: str, target: str, key: str = "PatientID") -> None:
    """Turn appended JSON rows into one deduplicated CSV sorted by key."""
    first_per_key(spark.read.json(source), key).orderBy(key).write.mode("overwrite").option("header", True).csv(target)


def write_report(df: DataFrame, fields: list[str], path: str) -> None:
    """Fixed-field CSV; missing values are empty cells."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def save_params(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame | None:
    return read_or_none(spark, path, "parquet")

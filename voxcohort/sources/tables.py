"""Readers of clinical, feature, split and record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from voxcohort import schema
from voxcohort.functions.clinical import radiomics_columns


def read_clinical_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; typed casts follow after the headers are settled."""
    names = spark.read.option("header", True).csv(path).columns
    text = StructType([StructField(n, StringType()) for n in names])
    return spark.read.option("header", True).schema(text).csv(path)


def read_features(spark: SparkSession, path: str, nodes_only: bool = False, extra: tuple = ("PatientID",)) -> DataFrame:
    """Feature table (CSV or Parquet) cut to the radiomics columns before anything is read."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    keep = radiomics_columns(df.columns, nodes_only)
    return df.select(*extra, *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in keep])


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return parse_splits(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))


def parse_splits(text: DataFrame, col: str = "body") -> DataFrame:
    """(fold, role, PatientID) from split JSON.

    Accepts an object with ``folds`` or ``splits`` or a bare list; validation ids
    may be called ``val`` or ``validation``; a fold without a number takes its place
    in the list.
    """
    item = "struct<fold:int,train:array<string>,val:array<string>,validation:array<string>>"
    body = F.col(col)
    as_object = F.from_json(body, f"struct<folds:array<{item}>,splits:array<{item}>>")
    folds = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{item}>")).otherwise(
        F.coalesce(as_object["folds"], as_object["splits"]))
    rows = text.select(F.posexplode(folds).alias("pos", "f")).select(
        F.coalesce("f.fold", "pos").alias("fold"), F.explode(F.array(
            F.struct(F.lit("train").alias("role"), F.col("f.train").alias("ids")),
            F.struct(F.lit("val").alias("role"), F.coalesce("f.val", "f.validation").alias("ids")))).alias("r"))
    return rows.select("fold", "r.role", F.explode("r.ids").alias("PatientID"))


def fold_of_patient(splits: DataFrame) -> DataFrame:
    return splits.where("role = 'val'").select("PatientID", "fold")


def filter_splits(splits: DataFrame, present: DataFrame, id_col: str = "PatientID") -> DataFrame:
    """Splits cut to present patients; raises when a fold loses its train or validation side."""
    kept = splits.join(present.select(F.col(id_col).alias("PatientID")).distinct(), "PatientID", "left_semi")
    sides = splits.select("fold").distinct().join(kept.groupBy("fold").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_val")),
        "fold", "left")
    empty = sides.where("coalesce(n_train, 0) = 0 or coalesce(n_val, 0) = 0").orderBy("fold").limit(1).collect()
    if empty:
        raise ValueError(f"fold {empty[0]['fold']} has no train or no validation patients left")
    return kept.select("fold", "role", "PatientID")


def smoke_split(present: DataFrame, id_col: str = "PatientID") -> DataFrame:
    """Two-patient split: first id trains, second validates."""
    first = present.select(F.col(id_col).alias("PatientID")).distinct().orderBy("PatientID").limit(2)
    lowest = first.agg(F.min("PatientID")).scalar()
    return first.select(F.lit(0).alias("fold"),
                        F.when(F.col("PatientID") == lowest, "train").otherwise("val").alias("role"), "PatientID")


def parse_tolerant(text: Column, struct: StructType = schema.CLINICAL_RECORD) -> Column:
    """Parse a JSON record; a trailing comma before a closing bracket is forgiven."""
    valid = F.try_parse_json(text).isNotNull()
    fixed = F.regexp_replace(text, r",(\s*[}\]])", "$1")
    return F.from_json(F.when(valid, text).otherwise(fixed), struct)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), parse_tolerant(F.col("value")).alias("r")).select("path", "r.*")


def read_staging_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.STAGING_CONFIG).option("multiLine", True).json(path)

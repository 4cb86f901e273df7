"""Cohort joins: enrichment, fold lookup, resume, case assembly, settings grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_metadata(clinical: DataFrame, meta: DataFrame, on: str = "PatientID", how: str = "inner") -> DataFrame:
    return clinical.join(meta, on, how)


def with_fold(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Attach the fold of every patient; patients in no fold keep NULL."""
    return df.join(folds.select("PatientID", "fold"), "PatientID", "left")


def is_train(fold: Column, held_out: Column) -> Column:
    """Rows in no fold train everywhere, hence the null-safe comparison."""
    return ~fold.eqNullSafe(held_out)


def train_rows(df: DataFrame, held_out: DataFrame) -> DataFrame:
    return df.join(held_out.select("PatientID"), "PatientID", "left_anti")


def remaining(todo: DataFrame, done: DataFrame, available: DataFrame, on: str = "PatientID") -> DataFrame:
    """Work that is not finished yet and has its mandatory input."""
    return todo.join(done.select(on), on, "left_anti").join(available.select(on), on, "left_semi")


def predicted_vs_truth(pred: DataFrame, truth: DataFrame, cols: list[str], on: str = "PatientID") -> DataFrame:
    side = lambda df, tag: df.select(on, *[F.col(c).alias(f"{c}_{tag}") for c in cols])
    return side(pred, "pred").join(side(truth, "gt"), on)


def assemble_cases(ct: DataFrame, pet: DataFrame, label: DataFrame, on: str = "case_id",
                   pet_required: bool = True) -> DataFrame:
    return ct.join(pet, on, "inner" if pet_required else "left").join(label, on)


def overlay(mask: DataFrame, image: DataFrame) -> DataFrame:
    """Mask voxels with the image value at the same grid position.

    The image is first narrowed to the mask's box in each case, by a join with one row
    per case, so only what lies near a mask is shuffled.
    """
    box = mask.groupBy("case_id").agg(*[f(a).alias(f"_{a}{n}") for a in "zyx" for n, f in ((0, F.min), (1, F.max))])
    near = image.join(box, "case_id").where(" AND ".join(f"{a} BETWEEN _{a}0 AND _{a}1" for a in "zyx")).select(*image.columns)
    return mask.join(near, ["case_id", "z", "y", "x"])


def with_settings(df: DataFrame, **grids) -> DataFrame:
    """Repeat rows for every combination of settings, later names varying fastest.

    The grids are driver-side literals of fixed size, exploded in place: no join
    and no shuffle. ``grid_idx`` is the position in nested-loop order.
    """
    out = df.withColumn("grid_idx", F.lit(0))
    for name, values in grids.items():
        out = out.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_i", name)).withColumn(
            "grid_idx", F.col("grid_idx") * len(values) + F.col("_i")).drop("_i")
    return out

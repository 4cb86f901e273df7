"""Classification metrics, distributions and comparison reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxcohort.operators.ranks import exact_quantiles


def recalls(df: DataFrame, truth: str = "y", pred: str = "p", group: list[str] | None = None) -> DataFrame:
    """Recall and support per true class (and group)."""
    group = list(group or [])
    hit = F.coalesce(F.col(pred) == F.col(truth), F.lit(False)).cast("int")
    return df.where(F.col(truth).isNotNull()).groupBy(*group, F.col(truth).alias("label")).agg(
        F.avg(hit).alias("recall"), F.count("*").alias("n"))


def balanced_accuracy(df: DataFrame, truth: str = "y", pred: str = "p", group: list[str] | None = None) -> DataFrame:
    """Mean recall over the classes present in the truth, per group."""
    group = list(group or [])
    return recalls(df, truth, pred, group).groupBy(*group).agg(
        F.avg("recall").alias("balanced_accuracy"), F.sum("n").alias("n"))


def confusion(df: DataFrame, labels: list[str], truth: str = "y", pred: str = "p") -> DataFrame:
    """Confusion matrix on fixed labels with recall and support, one row per true class."""
    known = df.where(F.col(truth).isin(labels) & F.col(pred).isin(labels))
    cells = known.groupBy(F.col(truth).alias("truth")).agg(
        *[F.count_if(F.col(pred) == lab).alias(f"pred_{lab}") for lab in labels],
        F.avg((F.col(truth) == F.col(pred)).cast("int")).alias("recall"), F.count("*").alias("support"))
    return cells


def top_mistakes(df: DataFrame, k: int = 6, truth: str = "y", pred: str = "p") -> DataFrame:
    return df.where(F.col(truth) != F.col(pred)).groupBy(
        F.concat_ws(" -> ", truth, pred).alias("mistake")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "mistake").limit(k)


def per_center(df: DataFrame, truth: str = "y", pred: str = "p", min_n: int = 5) -> DataFrame:
    """Score per center; one with fewer than ``min_n`` rows keeps its row without a score."""
    return balanced_accuracy(df, truth, pred, ["center"]).withColumn("balanced_accuracy", F.when(F.col("n") >= min_n, F.col("balanced_accuracy")))


def medians_by(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Group sizes and exact medians of several columns, one row per group."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols]))
    middle = exact_quantiles(df.select(by, named.alias("p")).select(by, "p.*"), "v", [0.5], [by, "name"])
    wide = middle.groupBy(by).agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(f"med_{c}") for c in cols])
    return df.groupBy(by).agg(F.count("*").alias("n")).join(wide, by, "left")


def distribution(df: DataFrame, cols: list[str]) -> DataFrame:
    """Value counts of several columns, missing included."""
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(cell.alias("c")).groupBy("c.name", "c.value").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, col: str, levels: list[str]) -> DataFrame:
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == lv).alias(lv) for lv in levels])


def missing_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
                  F.count_if(F.exists(F.array(*[F.col(c).isNull() for c in cols]), lambda v: v)).alias("any_missing"),
                  F.count("*").alias("n"))


def fold_mean_std(scores: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(group or [])).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                              F.count(value).alias("folds"))


def weighted_means(scores: DataFrame, group: list[str] | None = None, value: str = "c_index") -> DataFrame:
    """Unweighted and patient-weighted mean of per-center scores."""
    known = scores.where(F.col(value).isNotNull())
    return known.groupBy(*(group or [])).agg(
        F.avg(value).alias("unweighted"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("weighted"))


def paired(scores: DataFrame, unit: str, model: str, value: str, base: str, rival: str) -> DataFrame:
    """Wins of ``rival`` over ``base`` per unit (ties go to ``base``) and the difference."""
    wide = scores.groupBy(unit).agg(F.max(F.when(F.col(model) == base, F.col(value))).alias("b"),
                                    F.max(F.when(F.col(model) == rival, F.col(value))).alias("r"))
    wide = wide.where("b is not null or r is not null")
    d = F.col("r") - F.col("b")
    wins = F.coalesce(d > 0, F.lit(False))
    return wide.agg(F.count_if(~wins).alias("base_wins"), F.count_if(wins).alias("rival_wins"),
                    F.avg(d).alias("diff_mean"), F.stddev_pop(d).alias("diff_std"))


def best_row(df: DataFrame, metric: str, order: str) -> DataFrame:
    """Row with the highest metric; missing metrics last, the earliest order on ties."""
    return df.orderBy(F.col(metric).desc_nulls_last(), order).limit(1)


def verdict(delta: Column, loco: Column, loco_base: Column, gain: float, slack: float,
            good: str = "helps", risky: str = "overfit risk", bad: str = "no gain") -> Column:
    """Three-way shipping rule: CV gain beyond ``gain`` and LOCO within ``slack`` of the base."""
    return (F.when((delta > gain) & (loco >= loco_base - slack), good).when(delta > gain, risky).otherwise(bad))


def pearson_screen(df: DataFrame, features: list[str], against: str, limit: float = 0.8, min_values: int = 100,
                   min_distinct: int = 3) -> DataFrame:
    """Correlation of median-filled features with a reference column; proxies exceed ``limit``."""
    every = list(dict.fromkeys([*features, against]))
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in every]))
    long = df.select(named.alias("p")).select("p.*").where("v is not null")
    sizes = long.groupBy("name", "v").agg(F.count("*").alias("k")).groupBy("name").agg(
        F.sum("k").alias("n"), F.count("*").alias("d"))
    size = {r["name"]: r for r in sizes.collect()}
    middle = {r["name"]: r["value"] for r in exact_quantiles(long, "v", [0.5], ["name"]).collect()}
    fill = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c]))
    use = [c for c in features if c in size and size[c]["n"] >= min_values and size[c]["d"] >= min_distinct]
    if not use:
        return df.sparkSession.createDataFrame([], "feature string, r double, proxy boolean")
    wide = df.agg(*[F.corr(fill(c), fill(against)).alias(c) for c in use])
    return wide.unpivot([], use, "feature", "r").withColumn("proxy", F.abs("r") > limit)


def fold_coverage(patients: DataFrame, folds: DataFrame) -> DataFrame:
    """How fold ids and patient ids meet: matched, listed in total, patients in no fold."""
    ids, listed = patients.select("PatientID").distinct(), folds.select("PatientID").distinct()
    matched = ids.intersect(listed).agg(F.count("*").alias("matched"))
    total = listed.agg(F.count("*").alias("listed"))
    missing = ids.join(listed, "PatientID", "left_anti").agg(F.count("*").alias("in_no_fold"))
    return matched.select("matched", total.scalar().alias("listed"), missing.scalar().alias("in_no_fold"))


def class_weights(df: DataFrame, label: str, group: list[str] | None = None) -> DataFrame:
    """Balanced class weight n / (k * n_c) per group and class."""
    group = list(group or [])
    counts = df.groupBy(*group, label).agg(F.count("*").alias("n_c"))
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return counts.withColumn("weight", F.sum("n_c").over(w) / (F.count("*").over(w) * F.col("n_c")))

"""Threshold searches for the N rule and the node cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxcohort.functions.staging import rule_n
from voxcohort.operators.joins import with_settings
from voxcohort.operators.metrics import balanced_accuracy
from voxcohort.operators.nodes import laterality_of, side_of

# fixed values: the grids searched, in loop order
N3_GRID = (50, 55, 58, 60, 62, 65)
N1_GRID = (25, 28, 30, 32, 35)
CV_N1_GRID = (20, 25, 30, 35, 40)
CV_N3_GRID = (45, 50, 55, 60, 65, 70)
CLEANUP_GRID = {
    "merge_mm": (0.0, 2.0, 4.0, 6.0),
    "mode": ("either", "both"),
    "min_ml": (0.3, 0.5, 0.8, 1.0, 1.5, 2.0, 3.0),
    "suv": (0.0, 1.5, 2.0, 2.5, 3.0, 4.0),
    "diam": (8.0, 10.0, 12.0, 15.0),
}
CUTOFF_GRID = {"n3": (45.0, 50.0, 55.0, 60.0, 65.0), "n1": (20.0, 25.0, 30.0, 35.0, 40.0)}


def rule_grid(df: DataFrame, truth: str = "N", n3=N3_GRID, n1=N1_GRID) -> DataFrame:
    """Balanced accuracy of the rule at every cut-off pair, with the loop position."""
    grid = with_settings(df.select(F.col(truth).alias("y"), "n_gtvn", "max_node_mm", "laterality"), n3=n3, n1=n1)
    scored = grid.withColumn("p", rule_n(
        F.coalesce("n_gtvn", F.lit(0)), F.coalesce("max_node_mm", F.lit(0.0)),
        F.coalesce("laterality", F.lit("none")), F.col("n3"), F.col("n1")))
    return balanced_accuracy(scored, "y", "p", ["grid_idx", "n3", "n1"])


def rule_grid_cv(df: DataFrame, truth: str = "N", fold: str = "fold", min_n: int = 5) -> DataFrame:
    """Fold mean of the balanced accuracy at every cut-off pair."""
    rows = df.where(F.col(fold).isNotNull()).select(
        F.col(truth).alias("y"), F.col(fold).alias("fold"), "n_gtvn", "max_node_mm", "laterality")
    scored = with_settings(rows, n1=CV_N1_GRID, n3=CV_N3_GRID).withColumn(
        "p", rule_n("n_gtvn", "max_node_mm", "laterality", F.col("n3"), F.col("n1")))
    per_fold = balanced_accuracy(scored, "y", "p", ["grid_idx", "n1", "n3", "fold"]).where(F.col("n") >= min_n)
    return per_fold.groupBy("grid_idx", "n1", "n3").agg(F.avg("balanced_accuracy").alias("balanced_accuracy"))


def first_best(scores: DataFrame, metric: str = "balanced_accuracy", order: str = "grid_idx") -> DataFrame:
    """Strict-improvement search: the earliest setting among the best."""
    return scores.orderBy(F.desc_nulls_last(F.round(metric, 12)), order).limit(1)


def _grade(col: str, steps) -> Column:
    """How many of the ascending thresholds a value reaches."""
    return sum((F.when(F.col(col) >= s, 1).otherwise(0) for s in steps), F.lit(0))


def node_profiles(nodes: DataFrame, midline: DataFrame) -> DataFrame:
    """Collapse nodes to what the sweep can tell apart.

    Two nodes of a case that reach the same volume, SUV and diameter thresholds
    pass exactly the same settings, so a case keeps at most one row per profile.
    The profile is a grouped aggregate, hence a case with very many nodes shrinks
    before anything is multiplied by the settings.
    """
    side = side_of(F.col("cx_mm"), F.col("midline_mm"))
    return nodes.join(midline, "case_id").select(
        "case_id", "merge_mm", "max_mm", side.alias("side"),
        _grade("vol_ml", CLEANUP_GRID["min_ml"]).alias("g_ml"), _grade("suvmax", CLEANUP_GRID["suv"]).alias("g_suv"),
        _grade("max_mm", CLEANUP_GRID["diam"]).alias("g_diam"),
    ).groupBy("case_id", "merge_mm", "g_ml", "g_suv", "g_diam").agg(
        F.count("*").alias("k"), F.max("max_mm").alias("mm"),
        F.bool_or(F.col("side") == "L").alias("l"), F.bool_or(F.col("side") == "R").alias("r"))


def setting_features(profiles: DataFrame) -> DataFrame:
    """Case features under every cleanup setting: (case_id, setting, n, mm, laterality)."""
    index = lambda name, grade: F.transform(
        F.sequence(F.lit(0), F.lit(len(CLEANUP_GRID[name]) - 1)), lambda i: F.struct(i.alias("i"), (F.col(grade) > i).alias("ok")))
    wide = profiles.withColumn("mode", F.explode(F.array(*map(F.lit, CLEANUP_GRID["mode"]))))
    for name, grade in (("min_ml", "g_ml"), ("suv", "g_suv"), ("diam", "g_diam")):
        wide = wide.withColumn(name, F.explode(index(name, grade)))
    hot, big = F.col("suv.ok"), F.col("diam.ok")
    passed = wide.where(F.col("min_ml.ok") & F.when(F.col("mode") == "either", hot | big).otherwise(hot & big))
    return passed.groupBy("case_id", "merge_mm", "mode", F.col("min_ml.i").alias("i_ml"), F.col("suv.i").alias("i_suv"),
                          F.col("diam.i").alias("i_diam")).agg(
        F.sum("k").alias("n"), F.max("mm").alias("mm"), F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))


def cleanup_sweep(nodes: DataFrame, midline: DataFrame, truth: DataFrame) -> DataFrame:
    """Balanced accuracy of all cleanup settings times rule cut-offs.

    ``truth`` holds (case_id, y). A case enters the rule only through its count
    class and the cut-offs its largest node exceeds, so cases are counted per such
    bucket before the cut-offs are applied. Cases a setting leaves without nodes
    are the class totals minus those seen.
    """
    grid = CLEANUP_GRID
    features = setting_features(node_profiles(nodes, midline)).join(truth, "case_id")
    lat = laterality_of(F.col("n"), F.col("l"), F.col("r"))
    steps = sorted(set(CUTOFF_GRID["n3"]) | set(CUTOFF_GRID["n1"]))
    bucket = sum((F.when(F.col("mm") > s, 1).otherwise(0) for s in steps), F.lit(0))
    setting = ["merge_mm", "mode", "i_ml", "i_suv", "i_diam"]
    counts = features.withColumns({
        "single": (F.col("n") == 1) & lat.isin("unilateral", "midline"), "bucket": bucket,
    }).groupBy(*setting, "y", "single", "bucket").agg(F.count("*").alias("c"))

    # every setting x class, with the number of cases that lost all nodes
    classes = truth.groupBy("y").agg(F.count("*").alias("total"))
    frame = with_settings(classes, merge_mm=grid["merge_mm"], mode=grid["mode"], i_ml=range(len(grid["min_ml"])),
                          i_suv=range(len(grid["suv"])), i_diam=range(len(grid["diam"])))
    seen = counts.groupBy(*setting, "y").agg(F.sum("c").alias("seen"))
    empty = frame.join(seen, [*setting, "y"], "left").select(
        *setting, "y", F.lit("N0").alias("fixed"), F.lit(False).alias("single"), F.lit(0).alias("bucket"),
        (F.col("total") - F.coalesce("seen", F.lit(0))).alias("c"))
    table = counts.withColumn("fixed", F.lit(None).cast("string")).unionByName(empty)

    over = lambda cut: F.col("bucket") > F.array_position(F.array(*map(F.lit, steps)), cut) - 1
    scored = with_settings(table.drop("grid_idx"), **CUTOFF_GRID).withColumn("p", F.coalesce("fixed", F.when(
        over(F.col("n3")), "N3").when(F.col("single") & ~over(F.col("n1")), "N1").otherwise("N2")))
    recall = scored.groupBy(*setting, "n3", "n1", "y").agg(
        (F.sum(F.when(F.col("p") == F.col("y"), F.col("c")).otherwise(0)) / F.sum("c")).alias("recall"))
    result = recall.groupBy(*setting, "n3", "n1").agg(
        F.avg("recall").alias("balanced_accuracy"),
        *[F.max(F.when(F.col("y") == c, F.col("recall"))).alias(f"recall_{c}") for c in ("N0", "N1", "N2", "N3")])
    value = lambda name, i: F.element_at(F.array(*map(F.lit, grid[name])), F.col(i) + 1)
    place = F.lit(0)
    for name, values in {**grid, **CUTOFF_GRID}.items():
        at = {"min_ml": F.col("i_ml"), "suv": F.col("i_suv"), "diam": F.col("i_diam")}.get(
            name, F.array_position(F.array(*map(F.lit, values)), F.col(name)) - 1)
        place = place * len(values) + at
    return result.select("merge_mm", "mode", value("min_ml", "i_ml").alias("min_ml"), value("suv", "i_suv").alias("suv"),
                         value("diam", "i_diam").alias("diam"), "n3", "n1", "balanced_accuracy",
                         "recall_N0", "recall_N1", "recall_N2", "recall_N3", place.cast("int").alias("grid_idx"))

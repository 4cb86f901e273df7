"""Stage classifiers under cross-validation.

Logistic models and boosted trees fit all training sets together; any other Spark ML
estimator can be plugged in and is fitted set by set.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from voxcohort.operators import boosting, logistic as grouped
from voxcohort.operators import survival as sv
from voxcohort.operators.metrics import balanced_accuracy, class_weights, fold_mean_std
from voxcohort.session import cut

PARALLEL_FITS = 4


@dataclass(frozen=True)
class Ridge:
    """Multinomial logistic model with an L2 penalty."""

    C: float = 0.5
    balanced: bool = True


@dataclass(frozen=True)
class Boost:
    """Boosted trees on histograms."""

    rounds: int = 300
    step: float = 0.06
    l2: float = 1.0
    depth: int = 3
    balanced: bool = True


# ---------------------------------------------------------------- preparation
def labelled_sets(sets: DataFrame, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """Scaled feature vector, class index and balanced weight per group and row.

    The imputer, scaler and weights come from the training rows of the group.
    """
    sets = cut(sets)
    x = sv.standardise(sets, sv.prep_params(sets, features), features)
    x = x.withColumn("y", (F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1).cast("double"))
    weights = class_weights(sets.where("train"), label, ["g"]).select("g", label, "weight")
    return x.join(F.broadcast(weights), ["g", label], "left").withColumns(   # groups x classes rows
        {"features": array_to_vector("x"), "weight": F.coalesce("weight", F.lit(1.0))})


def anova_f(sets: DataFrame, features: list[str], label: str) -> DataFrame:
    """(g, feature, f): one-way ANOVA F of every median-filled feature, training rows only."""
    sets = cut(sets)
    params = sv.prep_params(sets, features).select("g", "feature", "med")
    rows = sv.long_features(sets, features, label).where("train").join(F.broadcast(params), ["g", "feature"])
    v = F.coalesce("value", "med")
    cells = rows.groupBy("g", "feature", label).agg(F.count("*").alias("cnt"), F.avg(v).alias("m"), F.var_pop(v).alias("s2"))
    grand = cells.groupBy("g", "feature").agg((F.sum(F.col("cnt") * F.col("m")) / F.sum("cnt")).alias("gm"))
    n, m = F.col("cnt"), F.col("m")
    return cells.join(grand, ["g", "feature"]).groupBy("g", "feature").agg(
        F.sum(n * (m - F.col("gm")) ** 2).alias("between"), F.sum(n * F.col("s2")).alias("within"),
        F.sum("cnt").alias("total"), F.count("*").alias("k")).select(
        "g", "feature", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("total") - F.col("k"))).alias("f"))


def select_top(scores: DataFrame, k: int) -> DataFrame:
    """(g, chosen): the k features with the largest F, in feature order of the score."""
    w = Window.partitionBy("g").orderBy(F.col("f").desc_nulls_last(), "feature")   # one row per feature
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.groupBy("g").agg(F.sort_array(F.collect_list("feature")).alias("chosen"))


# ------------------------------------------------------------------ estimators
def logistic(n_train: int, C: float = 0.5, balanced: bool = True, binary: bool = False) -> LogisticRegression:
    """L2 logistic matching a solver that weighs the summed loss by C.

    Spark minimises the mean weighted loss plus regParam / 2 times the squared norm,
    hence regParam = 1 / (C * sum of weights); balanced weights sum to n.
    """
    return LogisticRegression(
        family="binomial" if binary else "multinomial", regParam=1.0 / (C * n_train), elasticNetParam=0.0,
        standardization=False, maxIter=100, tol=1e-7, labelCol="y", featuresCol="features",
        **({"weightCol": "weight"} if balanced else {}))


def forest(trees: int = 400, depth: int = 6, balanced: bool = True, seed: int = 0) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="y", featuresCol="features",
                                  **({"weightCol": "weight"} if balanced else {}))


def boosted(rounds: int = 300, depth: int = 3, step: float = 0.06, seed: int = 0) -> OneVsRest:
    """Boosted trees one class against the rest (Spark's booster is binary)."""
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed, labelCol="y", featuresCol="features", weightCol="weight")
    return OneVsRest(classifier=gbt, labelCol="y", featuresCol="features", weightCol="weight", parallelism=4)


def estimator(kind: str, n_train: int):
    return {"LogReg": lambda: logistic(n_train), "LogRegPlain": lambda: logistic(n_train, balanced=False),
            "RF": lambda: forest(), "GBT": lambda: boosted()}[kind]()


# ------------------------------------------------------------ cross-validation
def _on_pool(jobs, parallel: int):
    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(lambda job: job(), jobs))


def usable_sets(sets: DataFrame, min_valid: int, min_train: int) -> DataFrame:
    """The rows of training sets that are large enough; see ``set_sizes`` for the others."""
    good = set_sizes(sets, min_valid, min_train).where("reason IS NULL").select("g")
    return sets.join(good, "g", "left_semi")


def set_sizes(sets: DataFrame, min_valid: int, min_train: int) -> DataFrame:
    """(g, train, valid, reason): sizes of every training set and why it is not used, if so."""
    size = sets.groupBy("g").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("valid"))
    return size.withColumn("reason", F.when(F.col("valid") < min_valid, f"fewer than {min_valid} rows to judge")
                           .when(F.col("train") < min_train, f"fewer than {min_train} rows to train"))


def design(sets: DataFrame, features: list[str], label: str, classes: list[str], top_k: int | None = None) -> tuple[DataFrame, int]:
    """Labelled sets with the feature array ``x``, cut to the ``top_k`` of each set, and its width."""
    rows = labelled_sets(sets, features, label, classes)
    if top_k is None or top_k >= len(features):
        return rows, len(features)
    chosen = select_top(anova_f(sets, features, label), top_k)
    place = F.array(*map(F.lit, features))
    rows = rows.join(chosen, "g").withColumn("x", F.transform("chosen", lambda f: F.element_at("x", F.array_position(place, f).cast("int"))))
    return rows.withColumn("features", array_to_vector("x")), top_k


def cv_predictions(sets: DataFrame, features: list[str], label: str, classes: list[str], make, keep: tuple = ("PatientID",),
                   min_valid: int = 1, min_train: int = 1, top_k: int | None = None) -> DataFrame:
    """Out-of-group predictions (g, keep, y, p) of one model per training set.

    ``make`` is a ``Ridge`` or ``Boost``, fitted for all sets together, or an estimator
    factory called with the training size; then a few sets are fitted at a time from
    driver threads, as Spark's own cross-validator does.
    """
    if isinstance(make, Ridge):
        rows, p = design(usable_sets(sets, min_valid, min_train), features, label, classes, top_k)
        rows = cut(rows.select("g", "train", *keep, F.col(label).alias("_label"), "x", "y", "weight"))
        model = grouped.fit(rows.where("train").withColumn("weight", F.col("weight") if make.balanced else F.lit(1.0)), p, len(classes), make.C)
        return grouped.predict(rows.where("not train"), model, p, classes).select("g", *keep, F.col("_label").alias("y"), "p")
    if isinstance(make, Boost):
        rows, p = design(usable_sets(sets, min_valid, min_train), features, label, classes, top_k)
        rows = cut(rows.select("g", "train", *keep, label, F.col("weight") if make.balanced else F.lit(1.0).alias("weight"), *[F.col("x")[j].alias(f"x{j}") for j in range(p)]))
        return boosting.boosted_predictions(rows, [f"x{j}" for j in range(p)], label, classes, keep, rounds=make.rounds, depth=make.depth, step=make.step, l2=make.l2)
    rows, _ = design(sets, features, label, classes, top_k)
    rows = cut(rows).persist()
    size = {r["g"]: r for r in rows.groupBy("g").agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("v")).collect()}
    usable = sorted(g for g, r in size.items() if r["t"] >= min_train and r["v"] >= min_valid)
    names = F.array(*map(F.lit, classes))

    def job(g):
        part = rows.where(F.col("g") == g)
        model = make(size[g]["t"]).fit(part.where("train"))
        out = model.transform(part.where("not train"))
        return out.select("g", *keep, F.col(label).alias("y"), names[F.col("prediction").cast("int")].alias("p"))

    out = cut(reduce(DataFrame.unionByName, _on_pool([lambda g=g: job(g) for g in usable], PARALLEL_FITS)))
    rows.unpersist()
    return out


def ordinal_predictions(sets: DataFrame, features: list[str], label: str, classes: list[str], C: float = 0.5,
                        keep: tuple = ("PatientID",), min_valid: int = 5, min_train: int = 20) -> DataFrame:
    """Ordinal class from the binary models P(class >= k): largest clipped difference wins.

    All thresholds of all sets are fitted together, each balanced over its two sides. A
    threshold the training labels never cross contributes probability 0.
    """
    base = usable_sets(cut(sets), min_valid, min_train).withColumn("rank", F.array_position(F.array(*map(F.lit, classes)), F.col(label)) - 1)
    x = cut(sv.standardise(base, sv.prep_params(base, features), features).select("g", "train", *keep, F.col(label).alias("y"), "rank", "x", F.monotonically_increasing_id().alias("_row")))
    steps = range(1, len(classes))
    step = F.explode(F.array(*map(F.lit, steps))).alias("k")
    up = (F.col("rank") >= F.col("k")).cast("int")
    train = x.where("train").select("g", "rank", "x", step).withColumn("up", up)
    sides = train.groupBy("g", "k").agg(F.count("*").alias("n"), F.sum("up").alias("ones")).where("ones > 0 AND ones < n")
    weight = F.when(F.col("up") == 1, F.col("n") / (2.0 * F.col("ones"))).otherwise(F.col("n") / (2.0 * (F.col("n") - F.col("ones"))))
    name = F.concat_ws("|", "g", "k")
    model = grouped.fit(train.join(sides, ["g", "k"]).select(name.alias("g"), "x", F.col("up").alias("y"), weight.alias("weight")), len(features), 2, C)
    asked = x.where("not train").select(F.col("g").alias("_set"), "_row", *keep, "y", "x", step).withColumn("g", F.concat_ws("|", "_set", "k"))
    at = grouped.probability(asked, model, len(features), "ge").groupBy(F.col("_set").alias("g"), "_row", *keep, "y").agg(
        *[F.coalesce(F.max(F.when(F.col("k") == k, F.col("ge"))), F.lit(0.0)).alias(f"ge{k}") for k in steps])
    ge = [F.lit(1.0), *[F.col(f"ge{k}") for k in steps], F.lit(0.0)]
    share = F.array(*[F.greatest(ge[k] - ge[k + 1], F.lit(0.0)) for k in range(len(classes))])
    names = F.array(*map(F.lit, classes))
    return at.select("g", *keep, "y", names[(F.array_position(share, F.array_max(share)) - 1).cast("int")].alias("p"))


def pooled_score(predictions: DataFrame) -> DataFrame:
    """One balanced accuracy over all out-of-fold predictions."""
    return balanced_accuracy(predictions)


def mean_score(predictions: DataFrame) -> DataFrame:
    """Mean and standard deviation of the per-group balanced accuracy."""
    return fold_mean_std(balanced_accuracy(predictions, group=["g"]), "balanced_accuracy")


def rule_scores(df: DataFrame, truth: str = "y", pred: str = "p", min_loco: int = 5) -> DataFrame:
    """A fixed rule under CV folds, leave-one-center-out and overall; nothing is fitted."""
    cv = balanced_accuracy(df.where("fold is not null"), truth, pred, ["fold"]).agg(F.avg("balanced_accuracy").alias("score"))
    loco = balanced_accuracy(df, truth, pred, ["center"]).where(F.col("n") >= min_loco).agg(F.avg("balanced_accuracy").alias("score"))
    every = balanced_accuracy(df, truth, pred).select(F.col("balanced_accuracy").alias("score"))
    tag = lambda d, s: d.select(F.lit(s).alias("scheme"), "score")
    return tag(cv, "cv").unionByName(tag(loco, "loco")).unionByName(tag(every, "overall"))


# ----------------------------------------------------------------- final models
def fit_final(df: DataFrame, features: list[str], label: str, classes: list[str], kind: str = "LogReg"):
    """Model and scaling parameters fitted on all rows: (model, params)."""
    sets = sv.whole_set(df)
    rows = labelled_sets(sets, features, label, classes).persist()
    model = estimator(kind, rows.count()).fit(rows)
    return model, sv.prep_params(sets, features).select("feature", "med", "mu", "sd")


def save_final(model, params: DataFrame, path: str) -> None:
    model.write().overwrite().save(os.path.join(path, "model"))
    params.write.mode("overwrite").parquet(os.path.join(path, "params"))


def predict_final(df: DataFrame, model, params: DataFrame, features: list[str], classes: list[str], out: str = "p") -> DataFrame:
    x = sv.standardise(df.withColumn("g", F.lit("all")), params.withColumn("g", F.lit("all")), features)
    names = F.array(*map(F.lit, classes))
    scored = model.transform(x.withColumn("features", array_to_vector("x")))
    return scored.withColumn(out, names[F.col("prediction").cast("int")]).drop(
        "g", "x", "features", "rawPrediction", "probability", "prediction")

"""Survival models fitted for many training sets at once.

A cross-validation is one table: every row appears once per group ``g`` (fold,
center, seed and fold) with a flag telling whether it trains or validates there.
All fits advance together, one Spark job per Newton step, and only matrices of
model size reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from voxcohort.operators.concordance import concordance
from voxcohort.session import cut
from voxcohort.operators.ranks import add_rank, exact_quantiles, random_subset, running_sums, range_bounds
from voxcohort.operators.weighted_signs import sign_scores, sign_statistics

MAX_GROUPS = 2000


# ------------------------------------------------------------- training sets
def group_values(df: DataFrame, col: str) -> list:
    """Distinct held-out groups, a bounded list that the driver may hold."""
    found = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(MAX_GROUPS + 1).collect()]
    if len(found) > MAX_GROUPS:
        raise ValueError(f"{col} has more than {MAX_GROUPS} values and cannot serve as a fold")
    return sorted(found)


def training_sets(df: DataFrame, col: str, groups: list | None = None) -> DataFrame:
    """Rows repeated per held-out group with ``train``; rows in no group train everywhere."""
    groups = group_values(df, col) if groups is None else groups
    out = df.withColumn("g", F.explode(F.array(*[F.lit(str(v)) for v in groups])))
    return out.withColumn("train", ~F.col(col).cast("string").eqNullSafe(F.col("g")))


def repeated_sets(df: DataFrame, folds: DataFrame, n_folds: int = 5) -> DataFrame:
    """Training sets of a repeated CV; ``folds`` is (PatientID, seed, cv_fold)."""
    out = df.join(folds.select("PatientID", "seed", "cv_fold"), "PatientID").withColumn(
        "hold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return out.withColumns({"g": F.concat_ws("_", "seed", "hold"), "train": F.col("cv_fold") != F.col("hold")}).drop("cv_fold", "hold")


def whole_set(df: DataFrame) -> DataFrame:
    return df.withColumns({"g": F.lit("all"), "train": F.lit(True)})


def set_guard(sets: DataFrame, min_valid: int = 8, min_train: int = 30, min_events: int = 3, min_train_events: int = 0) -> DataFrame:
    """(g, train, valid, reason): sizes of every training set, and why it is too small to fit or to judge, if so."""
    size = sets.groupBy("g").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("valid"),
                                 F.sum(F.when(~F.col("train"), F.col("event")).otherwise(0)).alias("ev"), F.sum(F.when(F.col("train"), F.col("event")).otherwise(0)).alias("evt"))
    return size.select("g", "train", "valid", F.when(F.col("valid") < min_valid, f"fewer than {min_valid} rows to judge").when(F.col("train") < min_train, f"fewer than {min_train} rows to train")
                       .when(F.col("ev") < min_events, f"fewer than {min_events} events to judge").when(F.col("evt") < min_train_events, f"fewer than {min_train_events} events to train").alias("reason"))


def guard_sets(sets: DataFrame, min_valid: int = 8, min_train: int = 30, min_events: int = 3, min_train_events: int = 0) -> DataFrame:
    """The sets that are large enough to fit and to judge; ``set_guard`` names the others."""
    good = set_guard(sets, min_valid, min_train, min_events, min_train_events).where("reason IS NULL").select("g")
    return cut(sets.join(good, "g", "left_semi"))   # read by preparation, fit and scoring


# ---------------------------------------------------------------- preparation
def long_features(sets: DataFrame, features: list[str], *extra: str) -> DataFrame:
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
    return sets.select("g", "train", *extra, named.alias("p")).select("g", "train", *extra, "p.feature", "p.value")


def prep_params(sets: DataFrame, features: list[str], sample_std: bool = False) -> DataFrame:
    """(g, feature, med, mu, sd) from the training rows: exact median, then moments after filling."""
    long = long_features(sets, features).where("train")
    med = exact_quantiles(long, "value", [0.5], ["g", "feature"]).select("g", "feature", F.col("value").alias("med"))
    every = long.select("g", "feature").distinct().join(med, ["g", "feature"], "left").fillna(0.0, ["med"])
    filled = long.join(every, ["g", "feature"]).withColumn("v", F.coalesce("value", "med"))
    std = F.stddev_samp if sample_std else F.stddev_pop
    return cut(filled.groupBy("g", "feature").agg(F.first("med").alias("med"), F.avg("v").alias("mu"), std("v").alias("sd")))


def _as_arrays(params: DataFrame, features: list[str], cols: list[str]) -> DataFrame:
    """One row per group with arrays in feature order (features x groups cells)."""
    return params.groupBy("g").agg(*[
        F.array(*[F.max(F.when(F.col("feature") == f, F.col(c))) for f in features]).alias(f"_{c}") for c in cols])


def standardise(sets: DataFrame, params: DataFrame, features: list[str], out: str = "x") -> DataFrame:
    """Attach the filled and scaled features as an array; a constant feature scales by 1."""
    arrays = _as_arrays(params, features, ["med", "mu", "sd"])
    joined = sets.join(F.broadcast(arrays), "g")   # at most MAX_GROUPS rows
    cell = lambda k, f: ((F.coalesce(F.col(f).cast("double"), F.col("_med")[k]) - F.col("_mu")[k])
                         / F.when(F.coalesce(F.col("_sd")[k], F.lit(0.0)) > 0, F.col("_sd")[k]).otherwise(1.0))
    return joined.withColumn(out, F.array(*[cell(k, f) for k, f in enumerate(features)])).drop("_med", "_mu", "_sd")


def with_missing_flags(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Missing indicators for the features that have missing values at all."""
    gaps = df.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    flagged = [f for f in features if gaps[f]]
    return df.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in flagged}), [f"{f}_missing" for f in flagged]


# ------------------------------------------------------------------------ Cox
def _outer_sums(rows: DataFrame, width: int) -> dict[str, np.ndarray]:
    """Sum of coef * u v' per group. Tasks reduce their rows to one matrix per group."""

    def reduce_rows(batches):
        import numpy as np
        import pyarrow as pa

        sums = {}
        for batch in batches:
            g = batch.column(0).dictionary_encode()
            place, names = g.indices.to_numpy(), g.dictionary.to_pylist()
            coef = batch.column(1).to_numpy(zero_copy_only=False)
            u, v = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for i in (2, 3))
            for i, name in enumerate(names):
                at = place == i
                sums[name] = sums.get(name, 0) + (u[at] * coef[at, None]).T @ v[at]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))], ["g", "m"])

    partial = rows.select("g", "coef", "u", "v").mapInArrow(reduce_rows, "g string, m array<double>")
    cells = partial.select("g", F.posexplode("m").alias("k", "value")).groupBy("g", "k").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in cells.collect():   # groups x width squared numbers
        out.setdefault(r["g"], np.zeros(width * width))[r["k"]] = r["value"]
    return {g: m.reshape(width, width) for g, m in out.items()}


def _score_rows(z: DataFrame, betas: DataFrame, p: int, bounds: list[float]) -> DataFrame:
    """Rows whose weighted outer products sum to the Efron information and score.

    Sums per distinct event time and their running totals over later times give the
    risk-set sums. The second-moment part needs no running matrix: a subject counts
    with the hazard accumulated up to its own time.
    """
    span = range(p)
    array = lambda cells: f"array({', '.join(cells)})"
    vec = lambda n: array([*[f"{n}{k}" for k in span], "0D"])
    lin = " + ".join(f"z[{k}] * b[{k}]" for k in span)
    rows = z.join(F.broadcast(betas), "g").selectExpr("g", "time", "event", "z", f"exp({lin}) AS w")
    sums = ["sum(w) AS s", "sum(event) AS d", "sum(w * event) AS ds"]
    for k in span:
        sums += [f"sum(w * z[{k}]) AS s{k}", f"sum(w * event * z[{k}]) AS d{k}", f"sum(event * z[{k}]) AS e{k}"]
    at = rows.groupBy("g", "time").agg(*map(F.expr, sums))
    names = ["s", *[f"s{k}" for k in span]]
    at = running_sums(at, ["g"], "time", {f"r_{n}": n for n in names}, bounds, descending=True)
    kept = ["g", "time", "d", "ds", *[f"{n}{k}" for n in "de" for k in span]]
    at = at.selectExpr(*kept, *[f"{n} + r_{n} AS {n}" for n in names])
    # per tied death: 1 / (S - share D) and its products with the share, summed
    zero = "named_struct('a', 0D, 'b', 0D, 'x', 0D, 'y', 0D, 'w', 0D)"
    inv, share = "(1 / (s - l / d * ds))", "(l / d)"
    step = (f"(acc, l) -> named_struct('a', acc.a + {inv}, 'b', acc.b + {share} * {inv}, 'x', acc.x + {inv} * {inv}, "
            f"'y', acc.y + {share} * {inv} * {inv}, 'w', acc.w + {share} * {share} * {inv} * {inv})")
    ties = f"CASE WHEN d > 0 THEN aggregate(sequence(0, cast(d AS int) - 1), {zero}, {step}) ELSE {zero} END"
    at = at.selectExpr("*", f"{ties} AS k").selectExpr("*", "k.a AS ka", "k.b AS kb")
    at = running_sums(at, ["g"], "time", {"before": "ka"}, bounds)
    score = array([*[f"ka * s{k} - kb * d{k} - e{k}" for k in span], "0D"])
    last = array([*["0D"] * p, "1D"])
    term = lambda coef, u, v: f"named_struct('coef', {coef}, 'u', {u}, 'v', {v})"
    terms = [term("-k.x", vec("s"), vec("s")), term("k.y", vec("s"), vec("d")), term("k.y", vec("d"), vec("s")),
             term("-k.w", vec("d"), vec("d")), term("1D", score, last)]
    of_times = at.where("d > 0").selectExpr("g", f"explode({array(terms)}) AS t").select("g", "t.*")
    hazard = at.selectExpr("g", "time", "before + ka AS h", "kb")
    of_rows = rows.join(hazard, ["g", "time"]).selectExpr(
        "g", "w * (h - event * kb) AS coef", "concat(z, array(0D)) AS u", "concat(z, array(0D)) AS v")
    return of_rows.unionByName(of_times)


def cox_information(z: DataFrame, betas: dict[str, np.ndarray], p: int, bounds: list[float] = ()) -> dict:
    """Score vector and information matrix per group at given coefficients."""
    table = z.sparkSession.createDataFrame([(g, [float(v) for v in b]) for g, b in betas.items()], "g string, b array<double>")
    sums = _outer_sums(_score_rows(z, table, p, list(bounds)), p + 1)
    return {g: (-m[:p, p], m[:p, :p]) for g, m in sums.items()}


def cox_fit(train: DataFrame, p: int, penalizer: float, tol: float = 1e-8, max_steps: int = 30) -> DataFrame:
    """Ridge Cox fits of every group of (g, time, event, x): rows (g, beta, shift, steps, gradient, converged).

    Efron ties; the penalty is half penalizer times n times the squared norm of the
    coefficients on columns scaled to unit sample standard deviation.
    """
    spark = train.sparkSession
    moments = train.select("g", F.posexplode("x").alias("k", "v")).groupBy("g", "k").agg(
        F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"), F.count("*").alias("n")).collect()   # groups x p rows
    mu, sd, n = {}, {}, {}
    for r in moments:
        mu.setdefault(r["g"], np.zeros(p))[r["k"]] = r["mu"]
        sd.setdefault(r["g"], np.ones(p))[r["k"]] = r["sd"] if r["sd"] and r["sd"] > 1e-9 else 1.0
        n[r["g"]] = r["n"]
    scale = spark.createDataFrame([(g, mu[g].tolist(), sd[g].tolist()) for g in mu], "g string, m array<double>, s array<double>")
    z = train.join(F.broadcast(scale), "g").select(
        "g", "time", "event", F.array(*[(F.col("x")[k] - F.col("m")[k]) / F.col("s")[k] for k in range(p)]).alias("z")).persist()
    try:
        bounds = range_bounds(z, "time", at_most=sum(n.values()))
        beta = {g: np.zeros(p) for g in mu}
        steps, gap = dict.fromkeys(mu, 0), dict.fromkeys(mu, np.inf)
        open_groups = set(mu)
        while open_groups:
            info = cox_information(z.where(F.col("g").isin(*open_groups)), {g: beta[g] for g in open_groups}, p, bounds)
            for g in list(open_groups):
                score, inform = info[g]
                score = score - penalizer * n[g] * beta[g]
                gap[g] = float(np.abs(score).max() / n[g])
                if gap[g] < tol or steps[g] >= max_steps:
                    open_groups.discard(g)
                    continue
                move = np.linalg.solve(inform + penalizer * n[g] * np.eye(p) + 1e-12 * np.eye(p), score)
                beta[g] = beta[g] + move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
                steps[g] += 1
        rows = [(g, (beta[g] / sd[g]).tolist(), mu[g].tolist(), steps[g], gap[g], bool(gap[g] < tol)) for g in mu]
    finally:
        z.unpersist()
    return spark.createDataFrame(rows, "g string, beta array<double>, shift array<double>, steps int, gradient double, converged boolean")


def partial_hazard(rows: DataFrame, model: DataFrame, p: int, out: str = "risk") -> DataFrame:
    lin = sum(((F.col("x")[k] - F.col("shift")[k]) * F.col("beta")[k] for k in range(p)), F.lit(0.0))
    return rows.join(F.broadcast(model.select("g", "beta", "shift")), "g").withColumn(out, F.exp(lin)).drop("beta", "shift")


def cox_predictions(sets: DataFrame, features: list[str], penalizer: float = 0.5, keep: tuple = ("PatientID", "center"),
                    sample_std: bool = False) -> DataFrame:
    """Validation risks of ridge Cox models, one fit per group, all groups together."""
    x = cut(standardise(sets, prep_params(sets, features, sample_std), features))
    return cox_on_arrays(x, len(features), penalizer, keep)


def cox_on_arrays(x: DataFrame, p: int, penalizer: float, keep: tuple = ("PatientID", "center")) -> DataFrame:
    model = cox_fit(x.where("train").select("g", F.col("RFS").alias("time"), "event", "x"), p, penalizer)
    return partial_hazard(x.where("not train"), model, p).select("g", *keep, "RFS", "event", "risk")


# -------------------------------------------------------------- sign ensemble
def sign_model(long: DataFrame, keys: list[str], cmin: float = 0.0, weight: str | None = None) -> DataFrame:
    """(keys, feature, mu, sd, sign, keep) from training rows (keys, feature, value, RFS, event).

    Values are centred at the median and scaled by the standard deviation; the sign
    says whether larger values go with shorter time. When no feature reaches
    ``cmin`` all are kept. With ``weight`` a row counts that often, as copies would.
    """
    by = [*keys, "feature"]
    med = exact_quantiles(long, "value", [0.5], by, weight=weight).select(*by, F.col("value").alias("mu"))
    filled = cut(long.join(med, by).withColumn("v", F.coalesce("value", "mu")))
    if weight is None:
        spread = F.stddev_pop("v")
    else:       # moments around the median, so that no digits are lost to an offset
        w, d = F.col(weight), F.col("v") - F.col("mu")
        spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(w * d * d) / F.sum(w) - (F.sum(w * d) / F.sum(w)) ** 2))
    scale = filled.groupBy(*by).agg(F.first("mu").alias("mu"), spread.alias("sd"))
    c = concordance(filled.withColumn("risk", F.col("v")), group=by, rule="library", weight=weight).select(*by, "c_index")
    out = cut(scale.join(c, by, "left")).withColumns({
        "sd": F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), "c": F.coalesce("c_index", F.lit(0.5))})
    out = out.withColumns({"sign": F.when(F.col("c") >= 0.5, 1.0).otherwise(-1.0), "strong": F.abs(F.col("c") - 0.5) >= cmin})
    some = out.groupBy(*keys).agg(F.bool_or("strong").alias("some"))
    return cut(out.join(some, keys).withColumn("keep", F.col("strong") | ~F.col("some")).select(*by, "mu", "sd", "sign", "keep"))


def sign_risk(long: DataFrame, model: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Mean signed score of the kept features per row."""
    by = [*keys, "feature"]
    z = (F.coalesce("value", "mu") - F.col("mu")) / F.col("sd") * F.col("sign")
    return long.join(model.where("keep"), by).groupBy(*keys, *ids).agg(F.avg(z).alias("risk"))


def _kept_signs(found: DataFrame, cmin: float) -> DataFrame:
    """(g, k, replicate, mu, sd, sign) of the features that count; all do where none reaches ``cmin``."""
    out = found.withColumns({"sd": F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), "c": F.coalesce("c", F.lit(0.5))})
    out = out.withColumns({"sign": F.when(F.col("c") >= 0.5, 1.0).otherwise(-1.0), "strong": F.abs(F.col("c") - 0.5) >= cmin})
    some = out.groupBy("g", "replicate").agg(F.bool_or("strong").alias("some"))
    return out.join(some, ["g", "replicate"]).where(F.col("strong") | ~F.col("some")).select("g", "k", "replicate", "mu", "sd", "sign")


def _prepared(sets: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    return cut(standardise(sets, prep_params(sets, features), features).select("g", "train", *ids, "x"))


def sign_predictions(sets: DataFrame, features: list[str], cmin: float = 0.0) -> DataFrame:
    ids = ["PatientID", "center", "RFS", "event"]
    x = _prepared(sets, features, ids)
    model = _kept_signs(sign_statistics(x.where("train"), len(features)), cmin)
    return sign_scores(x.where("not train"), model, len(features), ids)


def _prepared_long(sets: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    x = standardise(sets, prep_params(sets, features), features)
    names = F.array(*map(F.lit, features))
    return cut(x.select("g", "train", *ids, F.posexplode("x").alias("k", "value")).withColumn("feature", names[F.col("k")]).drop("k"))


def bagged_sign_predictions(sets: DataFrame, features: list[str], replicates: int = 40, fraction: float = 0.6,
                            min_events: int = 3, cmin: float = 0.0) -> DataFrame:
    """Median over bootstrap replicates with random feature subsets; a row carries its weights in all of them."""
    ids = ["PatientID", "center", "RFS", "event"]
    x = _prepared(sets, features, ids)
    named = sets.sparkSession.createDataFrame([(f, k) for k, f in enumerate(features)], "feature string, k int")
    picked = random_subset(named, replicates, fraction).join(named, "feature").select("replicate", "k")
    found = sign_statistics(x.where("train"), len(features), replicates).where(F.col("events") >= min_events).join(picked, ["replicate", "k"])
    return sign_scores(x.where("not train"), _kept_signs(found, cmin), len(features), ids)


# ----------------------------------------------------------------- evaluation
def rank_ensemble(predictions: DataFrame, models: tuple, name: str) -> DataFrame:
    """Mean of the per-group ranks of several models (rows at least two models scored)."""
    some = predictions.where(F.col("model").isin(*models))
    ranked = add_rank(some, "risk", "rank", ["g", "model"])
    mixed = ranked.groupBy("g", "PatientID", "center", "RFS", "event").agg(
        F.avg("rank").alias("risk"), F.count("*").alias("k")).where("k >= 2").drop("k")
    return mixed.withColumn("model", F.lit(name))


def c_by_group(predictions: DataFrame, keys: list[str] | None = None, rule: str = "library") -> DataFrame:
    return concordance(predictions, group=list(keys or ["model", "g"]), rule=rule)


def preselect(sets: DataFrame, features: list[str], k: int) -> DataFrame:
    """(g, feature, rank): the k training features farthest from C = 0.5.

    Constant features score 0; equal scores go to the later name.
    """
    long = long_features(sets, features, "RFS", "event").where("train")
    med = exact_quantiles(long, "value", [0.5], ["g", "feature"]).select("g", "feature", F.col("value").alias("med"))
    filled = long.join(med, ["g", "feature"]).withColumn("risk", -F.coalesce("value", "med"))
    c = concordance(filled, group=["g", "feature"], rule="library").select("g", "feature", F.abs(F.col("c_index") - 0.5).alias("s"))
    span = filled.groupBy("g", "feature").agg((F.max("risk") > F.min("risk")).alias("varies"))
    scored = span.join(c, ["g", "feature"], "left").withColumn("signal", F.when(F.col("varies"), F.coalesce("s", F.lit(0.0))).otherwise(0.0))
    w = Window.partitionBy("g").orderBy(F.desc(F.round("signal", 12)), F.desc("feature"))   # one row per feature
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("g", "feature", "signal", "rank")


def cox_with_selected(sets: DataFrame, base: list[str], pool: list[str], k: int, penalizer: float = 0.5) -> DataFrame:
    """Cox on the base features plus k features chosen inside every training set."""
    x = standardise(sets, prep_params(sets, base), base)
    if k == 0:
        return cox_on_arrays(x, len(base), penalizer)
    chosen = preselect(sets, pool, k).groupBy("g").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]).alias("chosen"))
    extra = standardise(sets, prep_params(sets, pool), pool, "y").select("g", "PatientID", "y")
    place = F.array(*map(F.lit, pool))
    wide = x.join(extra, ["g", "PatientID"]).join(F.broadcast(chosen), "g")   # one row per group
    picked = F.transform("chosen", lambda name: F.element_at("y", F.array_position(place, name).cast("int")))
    return cox_on_arrays(wide.withColumn("x", F.concat("x", picked)), len(base) + k, penalizer)

"""Model state as a versioned table: what a fit learns, and scoring from it alone.

A state is rows (model, kind, feature, level, class, value):

* ``code``: code of a level of a text column (levels in sorted order, from 0),
* ``median``, ``mean``, ``scale``: filling and scaling of a feature,
* ``flag``: the feature had gaps in training, so a missing indicator belongs to it,
* ``dropped``: a term that was constant in training and takes no part,
* ``shift``, ``coef``, ``intercept``: the fitted terms (per class where there are classes),
* ``class``: order of the classes; ``score``: the checked score of the model.

Fits write it, ``save`` appends a version, and scoring joins or reads it back; no
Python object is kept. Codes are joined by level, so a column may have any number of
levels; all other kinds are one row per term and are read as constants of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voxcohort.operators import logistic, survival as sv
from voxcohort.operators.ranks import exact_quantiles
from voxcohort.session import cut
from voxcohort.sources.sinks import read_or_none

SCHEMA = "model string, kind string, feature string, level string, class string, value double"


def _state(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (kind, feature, class, value) as a state without codes."""
    return spark.createDataFrame([(None, k, f, None, c, float(v)) for k, f, c, v in rows], SCHEMA)


def text_features(df: DataFrame, features: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f for f in features if kinds.get(f) == "string"]


def fit_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """``code`` rows: the sorted distinct levels of each text column, counted from 0."""
    if not columns:
        return df.sparkSession.createDataFrame([], SCHEMA)
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in columns]))
    levels = df.select(cell.alias("p")).select("p.*").where("level IS NOT NULL").distinct()
    code = F.row_number().over(Window.partitionBy("feature").orderBy("level")) - 1       # one row per level
    return levels.select(F.lit(None).cast("string").alias("model"), F.lit("code").alias("kind"), "feature", "level", F.lit(None).cast("string").alias("class"), code.cast("double").alias("value"))


def coded(df: DataFrame, codes: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with each text column replaced by its code; unseen and missing levels are NULL."""
    for c in columns:
        own = codes.where((F.col("kind") == "code") & (F.col("feature") == c)).select(F.col("level").alias("_level"), F.col("value").alias("_code"))
        df = df.join(own, F.col(c) == F.col("_level"), "left").withColumn(c, F.col("_code")).drop("_level", "_code")
    return df


@dataclass(frozen=True)
class Terms:
    """The constants of a state that scoring needs, one row per term and class."""

    median: dict
    mean: dict
    scale: dict
    flags: list
    dropped: set
    classes: list
    coef: dict
    shift: dict
    intercept: dict

    @classmethod
    def of(cls, state: DataFrame) -> Terms:
        rows = state.where("kind <> 'code'").collect()
        by = lambda kind: dict(sorted((r["feature"], r["value"]) for r in rows if r["kind"] == kind))
        per = lambda kind: {(r["feature"], r["class"]): r["value"] for r in rows if r["kind"] == kind}
        classes = [r["class"] for r in sorted((r for r in rows if r["kind"] == "class"), key=lambda r: r["value"])]
        return cls(by("median"), by("mean"), by("scale"), sorted(by("flag")), set(by("dropped")), classes, per("coef"), by("shift"), per("intercept"))

    def inputs(self) -> dict[str, Column]:
        """Every term before any is dropped: missing indicators and scaled features."""
        out = {f"{f}_missing": F.col(f).isNull().cast("double") for f in self.flags}
        return out | {f: (F.coalesce(F.col(f).cast("double"), F.lit(m)) - self.mean[f]) / self.scale[f] for f, m in self.median.items()}

    def terms(self) -> dict[str, Column]:
        return {n: c for n, c in self.inputs().items() if n not in self.dropped}


def fit_preparation(df: DataFrame, features: list[str], sample_std: bool = True, flags: bool = True, drop_constants: bool = True) -> DataFrame:
    """State of the preparation: codes, missing flags, medians, means, scales, and terms that do not vary."""
    spark, texts = df.sparkSession, text_features(df, features)
    codes = cut(fit_codes(df, texts))
    values = cut(coded(df, codes, texts).select([F.col(f).cast("double").alias(f) for f in features]))
    cell = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features]))
    long = values.select(cell.alias("p")).select("p.*")
    middle = {r["feature"]: r["value"] for r in exact_quantiles(long, "v", [0.5], ["feature"]).collect()}       # one row per feature
    median = {f: middle.get(f) or 0.0 for f in features}
    std = F.stddev_samp if sample_std else F.stddev_pop
    filled = lambda f: F.coalesce(F.col(f), F.lit(median[f]))
    r = values.agg(*[F.count_if(F.col(f).isNull()).alias(f"g_{f}") for f in features], *[F.avg(filled(f)).alias(f"m_{f}") for f in features],
                   *[std(filled(f)).alias(f"s_{f}") for f in features], F.count("*").alias("_n")).first()
    rows = []
    for f in features:
        sd = r[f"s_{f}"] or 0.0
        rows += [("median", f, None, median[f]), ("mean", f, None, r[f"m_{f}"] or 0.0), ("scale", f, None, sd if sd > 0 else 1.0)]
        gaps = r[f"g_{f}"]
        if flags and gaps:
            rows.append(("flag", f, None, gaps))
            if drop_constants and gaps == r["_n"]:
                rows.append(("dropped", f"{f}_missing", None, 1.0))
        if drop_constants and sd <= 1e-9:
            rows.append(("dropped", f, None, 1.0))
    return cut(codes.unionByName(_state(spark, rows)))


def prepared(df: DataFrame, state: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with the array ``x`` of the state's terms, and their names."""
    texts = [r["feature"] for r in state.where("kind = 'code'").select("feature").distinct().collect()]        # one row per text column
    terms = Terms.of(state)
    for f in terms.median:
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("double"))
    was = {f"_was_{c}": F.col(c) for c in texts if c in df.columns}
    x = coded(df.withColumns(was) if was else df, state, texts)
    names = list(terms.terms())
    return x.withColumn("x", F.array(*terms.terms().values())), names


def fit_cox(df: DataFrame, features: list[str], penalizer: float = 0.1, time: str = "RFS", event: str = "event") -> DataFrame:
    """State of a ridge Cox model on all rows: preparation and coefficients of the terms that vary."""
    state = fit_preparation(df, features)
    x, names = prepared(df, state)
    fit = sv.cox_fit(x.select(F.lit("all").alias("g"), F.col(time).alias("time"), event, "x"), len(names), penalizer).first()
    rows = [("coef", n, None, b) for n, b in zip(names, fit["beta"])] + [("shift", n, None, s) for n, s in zip(names, fit["shift"])]
    return cut(state.unionByName(_state(df.sparkSession, rows)))


def fit_stage(df: DataFrame, features: list[str], label: str, classes: list[str], C: float = 0.5) -> DataFrame:
    """State of a balanced multinomial model on the rows whose label is one of ``classes``."""
    known = cut(df.where(F.col(label).isin(classes)))
    state = fit_preparation(known, features, sample_std=False, flags=False, drop_constants=False)
    x, names = prepared(known, state)
    n, present = known.count(), {r[0]: r[1] for r in known.groupBy(label).count().collect()}      # one row per class
    share = F.create_map(*[v for c, m in present.items() for v in (F.lit(c), F.lit(n / (len(present) * m)))]) if present else F.create_map()
    names_of = F.array(*map(F.lit, classes))
    fit = logistic.fit(x.select(F.lit("all").alias("g"), "x", (F.array_position(names_of, F.col(label)) - 1).alias("y"), share[F.col(label)].alias("weight")), len(names), len(classes), C).first()
    width = len(names) + 1
    rows = [("class", None, c, k) for k, c in enumerate(classes)]
    for k, c in enumerate(classes if len(classes) > 2 else classes[1:]):
        rows.append(("intercept", None, c, fit["beta"][k * width]))
        rows += [("coef", f, c, b) for f, b in zip(names, fit["beta"][k * width + 1:(k + 1) * width])]
    return cut(state.unionByName(_state(df.sparkSession, rows)))


def with_score(state: DataFrame, score: float, at_least: float) -> DataFrame:
    """The state with its checked score; a score that falls short is refused."""
    if not score >= at_least:
        raise ValueError(f"the model scores {score:.4f}, under {at_least:.4f}; it is not saved")
    return state.unionByName(_state(state.sparkSession, [("score", None, None, score)]))


def save(state: DataFrame, path: str, model: str) -> int:
    """Append the state as the next version of ``model``; returns the version."""
    held = read_or_none(state.sparkSession, path, "parquet")
    last = held.where(F.col("model") == model).agg(F.max("version")).first()[0] if held is not None else None
    version = (last or 0) + 1
    state.withColumns({"model": F.lit(model), "version": F.lit(version)}).write.mode("append").parquet(path)
    return version


def load(spark: SparkSession, path: str, model: str, version: int | None = None) -> DataFrame | None:
    """A version of a model's state, the last one by default; None where there is none."""
    held = read_or_none(spark, path, "parquet")
    if held is None:
        return None
    own = held.where(F.col("model") == model)
    version = own.agg(F.max("version")).first()[0] if version is None else version
    found = own.where(F.col("version") == version).drop("version")
    return None if version is None or found.isEmpty() else found


def risk(df: DataFrame, state: DataFrame, out: str = "risk") -> DataFrame:
    """Partial hazard of a Cox state; features that ``df`` lacks count as missing."""
    kept = [c for c in df.columns if c != out]
    terms = Terms.of(state)
    x, names = prepared(df, state)
    line = sum((terms.coef[n, None] * (F.col("x")[k] - terms.shift[n]) for k, n in enumerate(names)), F.lit(0.0))
    return _back(x.withColumn(out, F.exp(line)), kept, out)


def stage(df: DataFrame, state: DataFrame, out: str) -> DataFrame:
    """Class of the largest score of a stage state, the first of equal ones."""
    kept = [c for c in df.columns if c != out]
    terms = Terms.of(state)
    x, names = prepared(df, state)
    line = lambda c: sum((terms.coef[n, c] * F.col("x")[k] for k, n in enumerate(names)), F.lit(terms.intercept[None, c])) if (None, c) in terms.intercept else F.lit(0.0)
    s = F.array(*[line(c) for c in terms.classes])
    names_of = F.array(*map(F.lit, terms.classes))
    return _back(x.withColumn(out, names_of[(F.array_position(s, F.array_max(s)) - 1).cast("int")]), kept, out)


def _back(scored: DataFrame, kept: list[str], out: str) -> DataFrame:
    """The columns of ``df``, text columns as they were, and the new one."""
    return scored.select(*[F.col(f"_was_{c}").alias(c) if f"_was_{c}" in scored.columns else F.col(c) for c in kept], out)

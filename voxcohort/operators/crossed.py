"""Survival models cross-validated on rows that are stored once.

A row carries, per scheme (a seed of folds, the centers), the code of the group that
holds it out; a training set is a scheme and a code, and no row is repeated. Cox fits of
all sets advance together over blocks of rows in time order. A Newton step is two
passes: the totals of every block give each one the risk set behind it, then its event
times are summed at their full risk sets. Score and information do not depend on where
a column starts, so every set is fitted on the same columns and its own scale is applied
to the sums. The sign ensemble takes the sets as weight vectors.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxcohort.operators.ranks import add_rank, exact_quantiles, random_subset, with_range
from voxcohort.operators.survival import _kept_signs
from voxcohort.operators.weighted_signs import cuts_of, median_score, sign_statistics, sign_tables
from voxcohort.session import cut

BLOCK_ROWS = 25_000     # rows of a block, about
IDS = ["PatientID", "center", "RFS", "event"]


@dataclass(frozen=True)
class Sets:
    """Training sets: the rows whose code in a scheme is not the set's own."""

    names: tuple
    scheme: np.ndarray
    code: np.ndarray

    def train(self, held: np.ndarray) -> np.ndarray:
        return held[:, self.scheme] != self.code

    def pick(self, at: list[int]) -> Sets:
        return Sets(tuple(self.names[i] for i in at), self.scheme[at], self.code[at])


def held_by(df: DataFrame, groups: dict[str, list], named: bool = True) -> tuple[DataFrame, Sets]:
    """``df`` with ``held``, and the sets that leave out each of the ``groups`` (column: its values); rows in no group train everywhere."""
    place = lambda c, values: F.coalesce(F.array_position(F.array(*[F.lit(str(v)) for v in values]).cast("array<string>"), F.col(c).cast("string")) - 1, F.lit(-1)).cast("int")
    names = [f"{c}|{v}" if named else str(v) for c, values in groups.items() for v in values]
    at = [(s, k) for s, values in enumerate(groups.values()) for k in range(len(values))]
    return df.withColumn("held", F.array(*[place(c, v) for c, v in groups.items()])), _sets(names, at)


def held_by_seed(df: DataFrame, folds: DataFrame, key: str, seeds: int, n_folds: int = 5) -> tuple[DataFrame, Sets]:
    """The sets of a repeated CV; ``folds`` is (key, seed, cv_fold) with a row per key and seed."""
    held = folds.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seed", "cv_fold"))), lambda r: r["cv_fold"]).alias("held"))
    return df.join(held, key), _sets([f"{s}_{k}" for s in range(seeds) for k in range(n_folds)], [(s, k) for s in range(seeds) for k in range(n_folds)])


def _sets(names: list, at: list) -> Sets:
    return Sets(tuple(names), np.array([s for s, _ in at], int), np.array([k for _, k in at], int))


def features_of(df: DataFrame, features: list[str]) -> Column:
    value = lambda f: F.col(f).cast("double")
    return F.array(*[F.when(F.isnan(value(f)), None).otherwise(value(f)) for f in features])


def guarded(rows: DataFrame, sets: Sets, min_valid: int = 8, min_train: int = 30, min_events: int = 3) -> Sets:
    """The sets that are large enough to fit and to judge, as ``survival.guard_sets`` has them."""
    found = rows.select(F.posexplode("held").alias("s", "c"), "event").groupBy("s", "c").agg(F.count("*").alias("n"), F.sum("event").alias("e")).collect()      # a row per set
    n, e, total = {}, {}, {}
    for r in found:
        n[r["s"], r["c"]], e[r["s"], r["c"]] = r["n"], r["e"] or 0
        total[r["s"]] = total.get(r["s"], 0) + r["n"]
    keep = []
    for i, at in enumerate(zip(sets.scheme.tolist(), sets.code.tolist())):
        valid = n.get(at, 0)
        if valid >= min_valid and total.get(at[0], 0) - valid >= min_train and e.get(at, 0) >= min_events:
            keep.append(i)
    return sets.pick(keep)


# ---------------------------------------------------------------- preparation
def _matrix(column: pd.Series, p: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, p)


def fills(rows: DataFrame, sets: Sets, p: int) -> np.ndarray:
    """(set, feature): exact training median of a feature with missing values (0 where training has none), NaN of the others."""
    out = np.full((len(sets.names), p), np.nan)
    gaps = rows.agg(*[F.count_if(F.col("x")[k].isNull()).alias(f"x{k}") for k in range(p)]).first()
    for k in [k for k in range(p) if gaps[k]]:
        out[:, k] = 0.0
        which = F.array(*[F.when(F.col("held")[int(s)] != int(c), i) for i, (s, c) in enumerate(zip(sets.scheme, sets.code))])
        counts = rows.where(F.col("x")[k].isNotNull()).select(F.explode(F.array_compact(which)).alias("g"), F.col("x")[k].alias("v")).groupBy("g", "v").agg(F.count("*").alias("n"))
        for r in exact_quantiles(cut(counts), "v", [0.5], ["g"], weight="n").collect():      # a row per set
            out[r["g"], k] = r["value"]
    return out


def moments(rows: DataFrame, sets: Sets, p: int, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of every training set, and mean and sample deviation of its filled features (0 where all are equal): (set), (set, feature), (set, feature)."""
    near = rows.agg(*[F.coalesce(F.avg(F.col("x")[k]), F.lit(0.0)) for k in range(p)]).first()
    centre = np.array(list(near))
    schemes = sorted(set(sets.scheme.tolist()))

    def sums(batches):
        total = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, held = _matrix(pdf["x"], p) - centre, np.array(pdf["held"].tolist())
            known = ~np.isnan(x)
            for s in schemes:
                for c in np.unique(held[:, s]):
                    at = held[:, s] == c
                    own, here = x[at], known[at]
                    zero = np.where(here, own, 0.0)
                    new = np.stack([here.sum(0), (~here).sum(0), zero.sum(0), (zero * zero).sum(0), np.where(here, own, np.inf).min(0), np.where(here, own, -np.inf).max(0)])
                    total[s, int(c)] = _merged(total.get((s, int(c))), new)
        if total:
            yield pd.DataFrame([(s, c, m.ravel()) for (s, c), m in total.items()], columns=["s", "c", "m"])
    found = {}
    for r in sorted(rows.select("held", "x").mapInPandas(sums, "s int, c int, m array<double>").collect()):      # tasks x sets x features
        found.setdefault(r["s"], {}).setdefault(r["c"], []).append(np.array(r["m"]).reshape(6, p))
    size, mean, sd = np.zeros(len(sets.names)), np.zeros((len(sets.names), p)), np.zeros((len(sets.names), p))
    for i, (s, c) in enumerate(zip(sets.scheme, sets.code)):
        total = None
        for code, parts in sorted(found[s].items()):
            for m in parts if code != c else []:
                total = _merged(total, m)
        n, missing, first, second, least, most = total
        f = np.where(missing > 0, np.nan_to_num(fill[i] - centre), 0.0)
        both = n + missing
        size[i], mean[i] = both[0], (first + missing * f) / both
        var = (second + missing * f * f) / both - mean[i] ** 2
        least, most = np.where(missing > 0, np.minimum(least, f), least), np.where(missing > 0, np.maximum(most, f), most)
        sd[i] = np.where(least < most, np.sqrt(np.maximum(var, 0) * both / np.maximum(both - 1, 1)), 0.0)
        mean[i] += centre
    return size, mean, sd


def _merged(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
    if a is None:
        return b
    return np.concatenate([a[:4] + b[:4], np.minimum(a[4:5], b[4:5]), np.maximum(a[5:], b[5:])])


# ------------------------------------------------------------------------ Cox
def time_blocks(rows: DataFrame, p: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(range, alone, data) blocks of rows (RFS, event, held, x), latest first in a block. A range of many rows has one time, and several blocks."""
    n = rows.count()
    ranges = math.ceil(n / block_rows)
    limits = cuts_of(rows.approxQuantile("RFS", [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges)) if ranges > 1 else [])
    alone = {i + 1 for i in range(len(limits) - 1) if limits[i + 1] <= math.nextafter(limits[i], math.inf)}
    placed = cut(with_range(rows.select("PatientID", F.col("RFS").cast("double").alias("RFS"), F.col("event").cast("int").alias("event"), "held", "x"), "RFS", limits.tolist()))
    sizes = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}      # a row per range
    parts = [math.ceil(sizes.get(r, 0) / (2 * block_rows)) if r in alone else 1 for r in range(len(limits) + 1)]
    part = F.pmod(F.xxhash64("PatientID"), F.array(*map(F.lit, parts))[F.col("_range")])

    def pack(pdf):
        pdf = pdf.sort_values("RFS", ascending=False, kind="stable")
        data = _matrix(pdf["x"], p), pdf["RFS"].to_numpy(), pdf["event"].to_numpy(), np.array(pdf["held"].tolist(), np.int16)
        r = int(pdf["_range"].iloc[0])
        return pd.DataFrame([(r, r in alone, pickle.dumps(data))], columns=["range", "alone", "data"])
    blocks = placed.withColumn("_part", part).groupBy("_range", "_part").applyInPandas(pack, "range int, alone boolean, data binary")
    tasks = max(1, min(sum(parts), 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return cut(blocks.repartition(tasks))


def _filled(x: np.ndarray, fill: np.ndarray) -> np.ndarray:
    gaps = np.flatnonzero(~np.isnan(fill))
    if len(gaps):
        x = x.copy()
        x[:, gaps] = np.where(np.isnan(x[:, gaps]), fill[gaps], x[:, gaps])
    return x


def _block_totals(x, event, train, eta):
    """Of a block under one set: sums of w and w x, of w x x', and the same of its deaths with their count and sum of x."""
    w = np.exp(eta) * train
    wx = w[:, None] * x
    died = np.flatnonzero(event * train)
    dx = wx[died]
    return np.concatenate([[w.sum()], wx.sum(0), (wx.T @ x).ravel(), [len(died), w[died].sum()], dx.sum(0), x[died].sum(0), (dx.T @ x[died]).ravel()])


def _ties(s, ds, d):
    """Sums over the d deaths of each time of 1 / (S - l / d D) and its products with l / d."""
    d = np.asarray(d).astype(int)
    at = np.repeat(np.arange(len(d)), d)
    share = (np.arange(len(at)) - np.repeat(np.cumsum(d) - d, d)) / d[at]
    inv = 1 / (s[at] - share * ds[at])
    add = lambda v: np.bincount(at, v, len(d))
    return add(inv), add(share * inv), add(inv * inv), add(share * inv * inv), add(share * share * inv * inv)


def _of_times(s, d, e, deaths):
    """Score, information of the times, hazard steps and tie corrections; s and d are rows of (sum, sums of x) per event time."""
    ka, kb, a, b, c = _ties(s[:, 0], d[:, 0], deaths)
    s1, d1 = s[:, 1:], d[:, 1:]
    cross = (s1 * b[:, None]).T @ d1
    return e.sum(0) - (ka @ s1 - kb @ d1), -((s1 * a[:, None]).T @ s1) + cross + cross.T - (d1 * c[:, None]).T @ d1, ka, kb


def _block_step(x, time, event, train, eta, later):
    """Hazard, score and information of a block under one set; ``later`` is (sum of w, sums of w x) of all later times."""
    w = np.exp(eta) * train
    wx = np.c_[w, w[:, None] * x]
    new = np.r_[True, time[1:] != time[:-1]]
    starts, at = np.flatnonzero(new), np.cumsum(new) - 1
    died = np.flatnonzero(event * train)
    p = x.shape[1]
    if not len(died):
        return np.zeros(1 + p + p * p)
    first = np.flatnonzero(np.r_[True, at[died][1:] != at[died][:-1]])
    held = at[died][first]
    s = (np.cumsum(np.add.reduceat(wx, starts, axis=0), axis=0) + later)[held]
    d = np.add.reduceat(wx[died], first, axis=0)
    score, inform, ka, kb = _of_times(s, d, np.add.reduceat(x[died], first, axis=0), np.diff(np.r_[first, len(died)]))
    hazard, late = np.zeros(len(starts)), np.zeros(len(starts))
    hazard[held], late[held] = ka, kb
    hazard = np.cumsum(hazard[::-1])[::-1]      # of the times up to one's own
    coef = w * hazard[at]
    coef[died] -= w[died] * late[at[died]]
    return np.concatenate([[ka.sum()], score, (inform + (x * coef[:, None]).T @ x).ravel()])


def cox_fits(blocks: DataFrame, sets: Sets, p: int, fill: np.ndarray, mean: np.ndarray, sd: np.ndarray, size: np.ndarray, penalizer: float,
             columns: np.ndarray | None = None, tol: float = 1e-8, max_steps: int = 30) -> dict:
    """Ridge Cox fits of all sets, those of ``survival.cox_fit``: coefficients on scaled columns (set, feature), steps, gradient, converged.

    ``columns`` (set, features of its model) picks each set's own features out of the p.
    """
    sets_n = len(sets.names)
    own = np.tile(np.arange(p), (sets_n, 1)) if columns is None else columns
    q = own.shape[1]
    rows_at = np.arange(sets_n)[:, None]
    mean_, scale = mean[rows_at, own], np.where(sd > 0, sd, 1.0)[rows_at, own]
    varies = (sd > 0)[rows_at, own]
    beta, gap, steps = np.zeros((sets_n, q)), np.full(sets_n, np.inf), np.zeros(sets_n, int)
    open_ = list(range(sets_n))
    blocks = blocks.persist()

    def run(use, more):
        b = beta / scale

        def work(batches):
            for pdf in batches:
                for r, hot, data in zip(pdf["range"], pdf["alone"], pdf["data"]):
                    x, time, event, held = pickle.loads(data)
                    train = sets.train(held)
                    parts = []
                    for i in use:
                        z = (_filled(x, fill[i]) - mean[i])[:, own[i]]
                        out = more(r, hot, z, time, event, train[:, i], z @ b[i], i)
                        if out is not None:
                            parts.append(out)
                    if parts:
                        yield pd.DataFrame([(r, np.stack(parts).tobytes())], columns=["range", "sums"])
        out = {}
        for r in sorted(blocks.mapInPandas(work, "range int, sums binary").collect(), key=lambda r: (r["range"], bytes(r["sums"]))):      # blocks x sets x squared features
            sums = np.frombuffer(bytes(r["sums"])).reshape(len(use), -1)
            out[r["range"]] = out[r["range"]] + sums if r["range"] in out else sums
        return out

    hot_ranges = {r["range"] for r in blocks.where("alone").select("range").distinct().collect()}
    while open_:
        use = list(open_)
        totals = run(use, lambda r, hot, x, time, event, train, eta, i: _block_totals(x, event, train, eta))
        ranges, later, running = sorted(totals), {}, np.zeros((len(use), q + 1))
        for r in reversed(ranges):
            later[r] = running
            running = running + totals[r][:, :q + 1]
        place = {i: n for n, i in enumerate(use)}
        found = run(use, lambda r, hot, x, time, event, train, eta, i: None if hot else _block_step(x, time, event, train, eta, later[r][place[i]]))
        for n, i in enumerate(use):
            score, inform, before = np.zeros(q), np.zeros((q, q)), 0.0
            for r in ranges:
                t = totals[r][n]
                m = t[q + 1:q + 1 + q * q].reshape(q, q)
                inform = inform + before * m
                rest = t[q + 1 + q * q:]
                if r in hot_ranges:
                    if rest[0]:
                        u, v, ka, kb = _of_times((t[:q + 1] + later[r][n])[None], rest[None, 1:q + 2], rest[None, q + 2:2 * q + 2], rest[:1])
                        score, before = score + u, before + ka[0]
                        inform = inform + v + ka[0] * m - kb[0] * rest[2 * q + 2:].reshape(q, q)
                else:
                    f = found[r][n]
                    score, inform, before = score + f[1:q + 1], inform + f[q + 1:].reshape(q, q), before + f[0]
            score = np.where(varies[i], score / scale[i], 0.0) - penalizer * size[i] * beta[i]
            inform = np.where(varies[i][:, None] & varies[i], inform / scale[i] / scale[i][:, None], 0.0)
            gap[i] = np.abs(score).max() / size[i]
            if gap[i] < tol or steps[i] >= max_steps:
                open_.remove(i)
                continue
            move = np.linalg.solve(inform + penalizer * size[i] * np.eye(q) + 1e-12 * np.eye(q), score)
            beta[i] += move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
            steps[i] += 1
    blocks.unpersist()
    return {"beta": beta, "scale": scale, "mean": mean_, "own": own, "steps": steps, "gradient": gap, "converged": gap < tol}


# ---------------------------------------------------------------- predictions
def sign_fits(rows: DataFrame, sets: Sets, p: int, fill: np.ndarray, features: list[int] | None = None) -> dict:
    """Centre, scale and concordance (one half where nothing is comparable) of every set and feature, or of some, those of ``survival.sign_predictions``."""
    features = list(range(p)) if features is None else features
    mu, sd, c = np.zeros((len(sets.names), p)), np.ones((len(sets.names), p)), np.full((len(sets.names), p), 0.5)
    if not sets.names:
        return {"mu": mu, "sd": sd, "c": c}
    columns, place = [], {}
    for k in features:
        for v in dict.fromkeys(None if math.isnan(f) else float(f) for f in fill[:, k]):      # one column per median that fills it
            place[k, v] = len(columns)
            columns.append(F.col("x")[k] if v is None else F.coalesce(F.col("x")[k], F.lit(v)))
    weights = lambda pdf: sets.train(np.array(pdf["held"].tolist())).astype(float)
    found = sign_statistics(rows.withColumns({"g": F.lit("all"), "x": F.array(*columns)}), len(columns), len(sets.names), weights=weights, extra=("held",))
    got = {(r["k"], r["replicate"]): r for r in found.collect()}      # sets x features
    for i in range(len(sets.names)):
        for k in features:
            r = got[place[k, None if math.isnan(fill[i, k]) else float(fill[i, k])], i]
            mu[i, k], sd[i, k], c[i, k] = r["mu"], r["sd"] if r["sd"] > 0 else 1.0, 0.5 if r["c"] is None else r["c"]
    return {"mu": mu, "sd": sd, "c": c}


def bag_fits(rows: DataFrame, sets: Sets, features: list[str], fill: np.ndarray, mean: np.ndarray, sd: np.ndarray, size: np.ndarray,
             arms: list[list[str]], replicates: int = 40, fraction: float = 0.6, min_events: int = 3) -> list[dict]:
    """Per arm (the features it draws from), the models of ``survival.bagged_sign_predictions``: set to centres, scales and signs (feature, replicate).

    The replicates draw the same rows for every arm, so statistics are taken once.
    """
    p, kinds = len(features), dict(rows.dtypes)
    spread_ = np.where(sd > 0, sd * np.sqrt((size - 1) / size)[:, None], 1.0)

    def training(batches):
        for pdf in batches:
            if len(pdf):
                x, train = _matrix(pdf["x"], p), sets.train(np.array(pdf["held"].tolist()))
                for i, g in enumerate(sets.names):
                    at = train[:, i]
                    yield pdf.loc[at, ["PatientID", "RFS", "event"]].assign(g=g, x=list((_filled(x[at], fill[i]) - mean[i]) / spread_[i]))
    names = ", ".join(f"{c} {kinds[c]}" for c in ("PatientID", "RFS", "event"))
    found = sign_statistics(rows.select("PatientID", "RFS", "event", "held", "x").mapInPandas(training, f"{names}, g string, x array<double>"), p, replicates)
    out = []
    for arm in arms:
        named = rows.sparkSession.createDataFrame([(f, features.index(f)) for f in arm], "feature string, k int")
        picked = random_subset(named, replicates, fraction).join(named, "feature").select("replicate", "k")
        tables = sign_tables(_kept_signs(found.where(F.col("events") >= min_events).join(picked, ["replicate", "k"]), 0.0), p)
        out.append({i: (*tables[g], mean[i], spread_[i]) for i, g in enumerate(sets.names) if g in tables})
    return out


def cox_risk(model: dict, i: int, x: np.ndarray) -> np.ndarray:
    line = 0.0
    for j, k in enumerate(model["own"][i]):      # by element, so that equal rows have equal risks
        line = line + (x[:, k] - model["mean"][i, j]) / model["scale"][i, j] * model["beta"][i, j]
    return np.exp(line)


def sign_risk(model: dict, columns: list[int], i: int, x: np.ndarray) -> np.ndarray:
    total = 0.0
    for k in columns:
        total = total + (x[:, k] - model["mu"][i, k]) / model["sd"][i, k] * (1.0 if model["c"][i, k] >= 0.5 else -1.0)
    return total / len(columns)


def bag_risk(model: dict, i: int, x: np.ndarray) -> np.ndarray:
    """Of a set without a model, 0; ``judged`` leaves it out."""
    if i not in model:
        return np.zeros(len(x))
    mu, sd, sign, mean, scale = model[i]
    return median_score((x - mean) / scale, mu, sd, sign)


def held_out(rows: DataFrame, sets: Sets, p: int, fill: np.ndarray, risks: list) -> DataFrame:
    """(g, IDS, x): every row under each set that holds it out, with its risk by every model in ``risks`` (functions of set and features) as ``x``."""
    kinds = dict(rows.dtypes)

    def work(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, held = _matrix(pdf["x"], p), np.array(pdf["held"].tolist())
            for i, g in enumerate(sets.names):
                at = held[:, sets.scheme[i]] == sets.code[i]
                if at.any():
                    own = _filled(x[at], fill[i])
                    yield pdf.loc[at, IDS].assign(g=g, x=list(np.stack([risk(i, own) for risk in risks], axis=1)))
    return rows.select(*IDS, "held", "x").mapInPandas(work, ", ".join(f"`{c}` {kinds[c]}" for c in IDS) + ", g string, x array<double>")


def cox_and_sign(rows: DataFrame, sets: Sets, p: int, penalizer: float = 0.5) -> DataFrame:
    """Held-out risks of a ridge Cox model and of the sign ensemble on the same features."""
    fill = fills(rows, sets, p)
    size, mean, sd = moments(rows, sets, p, fill)
    cox = cox_fits(time_blocks(rows, p), sets, p, fill, mean, sd, size, penalizer)
    sign = sign_fits(rows, sets, p, fill)
    return held_out(rows, sets, p, fill, [partial(cox_risk, cox), partial(sign_risk, sign, list(range(p)))])


def chosen(sets: Sets, sign: dict, sd: np.ndarray, features: list[str], first: int, k: int) -> np.ndarray:
    """(set, k): the features from ``first`` on that are farthest from one half, as ``survival.preselect`` picks them, after those before."""
    signal = np.where(sd > 0, np.abs(sign["c"] - 0.5), 0.0)
    order = lambda i: sorted(sorted(range(first, len(features)), key=lambda j: features[j], reverse=True), key=lambda j: -round(signal[i, j], 12))
    return np.array([[*range(first), *order(i)[:k]] for i in range(len(sets.names))], int).reshape(len(sets.names), first + k)


def with_rank_means(risks: DataFrame, models: list[str], combined: dict[str, tuple], absent: list[tuple[str, str]] = ()) -> DataFrame:
    """``risks`` with the mean rank over some of the models behind them in ``x``, as ``survival.rank_ensemble`` has it; models of ``absent`` (model, g) do not count."""
    key = ["g", "PatientID"]
    named = F.explode(F.arrays_zip(F.array(*map(F.lit, models)).alias("model"), F.col("x").alias("risk")))
    single = risks.select(*key, named.alias("m")).select(*key, "m.model", "m.risk").where(~F.concat_ws("|", "model", "g").isin([f"{m}|{g}" for m, g in absent]))
    ranked = add_rank(single, "risk", "rank", ["g", "model"]).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("model", "rank"))).alias("ranks"))
    rank = lambda m: F.try_element_at("ranks", F.lit(m))
    mean = lambda ms: sum((F.coalesce(rank(m), F.lit(0.0)) for m in ms), F.lit(0.0)) / F.greatest(sum((rank(m).isNotNull().cast("int") for m in ms), F.lit(0)), F.lit(1))
    return risks.join(ranked, key).withColumn("x", F.concat("x", F.array(*[mean(ms) for ms in combined.values()]))).drop("ranks")


def judged(risks: DataFrame, models: list[str], absent: list[tuple[str, str]] = ()) -> DataFrame:
    """(model, g, n, events, c_index) of the risks ``x`` of several models, by the library rule; not of ``absent`` (model, g)."""
    out = sign_statistics(risks, len(models))
    name = F.array(*map(F.lit, models))[F.col("k")]
    out = out.select(name.alias("model"), "g", F.col("n").cast("long").alias("n"), F.col("events").cast("long").alias("events"), F.col("c").alias("c_index"))
    return out.where(~F.concat_ws("|", "model", "g").isin([f"{m}|{g}" for m, g in absent])) if absent else out

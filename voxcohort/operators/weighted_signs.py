"""Signs, centres and spreads of many weightings of one training table at once.

A bootstrap replicate is a vector of weights, one per replicate, carried by a row; no
row is repeated. Per group and feature the rows are cut into ranges of time and ranges
of value. Pairs in one time range meet in the task of that range; pairs of different
time ranges and one value range in the task of that value range; all others follow
from the totals of (time range, value range) cells. Inside a task pairs are counted by
running sums over the bits of their time rank. The value ranges, with the totals of the
lower ones as offsets, also give exact weighted medians and standard deviations.

An event counts as earlier than a censoring at the same time, which is the library rule
of ``concordance``. Sums of whole weights are exact up to 2 ** 53.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxcohort.operators.ranks import poisson_steps
from voxcohort.session import cut, spread

ROWS = 100_000      # rows of a range, about: a task holds the weights of one


def pair_sums(late: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray, ties: float = 0.5) -> np.ndarray:
    """Per column, the sum of a[i] * b[j] over pairs where j is later and of smaller value (``ties`` of it where equal)."""
    out = np.zeros(a.shape[1])
    late = np.unique(late, return_inverse=True)[1]
    late = late.astype(np.uint16 if len(late) <= 1 << 16 or late.max(initial=0) < 1 << 16 else np.int64)      # numpy sorts short integers by digits
    counts = a.any(axis=1)
    by_value = np.argsort(value, kind="stable")
    value, late = value[by_value], late[by_value]
    b = b.astype(np.float32) if b.sum(0).max(initial=0) < 1 << 22 else b      # whole weights, so their sums and halves are exact in it
    for bit in range(int(late.max(initial=0)).bit_length()):
        at = np.argsort(late >> (bit + 1), kind="stable")      # by node, then value
        order, node, v, high = by_value[at], late[at] >> (bit + 1), value[at], (late[at] >> bit & 1).astype(bool)
        first = np.r_[True, node[1:] != node[:-1]]
        new = first | np.r_[True, v[1:] != v[:-1]]
        before = np.r_[0, np.cumsum(high)]
        starts, runs = np.flatnonzero(first), np.flatnonzero(new)
        run = np.cumsum(new) - 1
        ends = np.r_[runs[1:], len(v)]
        at = np.flatnonzero(~high & counts[order])
        if not len(at) or not before[-1]:
            continue
        total = np.zeros((before[-1] + 1, b.shape[1]), b.dtype)
        np.cumsum(b[order[high]], axis=0, out=total[1:])
        below = (1 - ties) * total[before[runs[run[at]]]] + ties * total[before[ends[run[at]]]] - total[before[starts[np.cumsum(first)[at] - 1]]]
        out += np.einsum("ij,ij->j", a[order[at]], below)
    return out


def _later(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per column, the sum of a[i] * b[j] over pairs where j is later, whatever the value."""
    by = np.argsort(order, kind="stable")
    total = np.r_[np.zeros((1, b.shape[1])), np.cumsum(b[by], axis=0)]
    return (a[by] * (total[-1] - total[np.searchsorted(order[by], order[by], side="right")])).sum(0)


def _pack(w: np.ndarray) -> list[bytes]:
    """Rows of whole weights, a byte each where they fit."""
    small = w.max(axis=1, initial=0) < 256
    return [(r.astype(np.uint8) if s else r.astype("<f8")).tobytes() for r, s in zip(w, small)]


def _unpack(packed, r: int) -> np.ndarray:
    out = np.empty((len(packed), r))
    small = np.fromiter((len(x) == r for x in packed), bool, len(packed))     # one weight is a byte or eight
    for which, kind in ((small, np.uint8), (~small, "<f8")):
        if which.any():
            out[which] = np.frombuffer(b"".join(x for x, k in zip(packed, which) if k), kind).reshape(-1, r)
    return out


def draws(ids: list, replicates: int) -> np.ndarray:
    """Poisson(1) multiplicities of every id, those of ``ranks.poisson_bootstrap``."""
    salt = [f"boot-{k}-".encode() for k in range(replicates)]
    digests = b"".join(hashlib.md5(s + i).digest() for i in (str(i).encode() for i in ids) for s in salt)
    u = (np.frombuffer(digests, ">u8")[::2] >> 16).astype(float) / float(1 << 48)
    return np.searchsorted(np.array(poisson_steps()), u, side="right").reshape(-1, replicates).astype(float)


def cuts_of(points: list[float]) -> np.ndarray:
    """Range limits; a value that is a limit stands alone, so that a very common value is a range of its own."""
    return np.array(sorted({c for p in points for c in (float(p), math.nextafter(p, math.inf))}))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def sign_statistics(x: DataFrame, p: int, replicates: int | None = None, rows_per_range: int = ROWS, time: str = "RFS",
                    event: str = "event", key: str = "PatientID", weights=None, extra: tuple = ()) -> DataFrame:
    """(g, k, replicate, n, events, mu, sd, c) of the training rows ``x`` (g, key, time, event, x), by feature index ``k``.

    Median, standard deviation and concordance of every feature under each bootstrap
    replicate, or of the rows as they are (replicate 0) without ``replicates``. With
    ``weights``, a function of rows with the ``extra`` columns, a replicate is a column of
    what it returns.
    """
    reps = replicates or 1
    x = x.select("g", F.col(key).cast("string").alias("id"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), "x", *extra)
    x = x.where("id IS NOT NULL") if replicates and not weights else x
    sizes = {r["g"]: r["n"] for r in x.groupBy("g").agg(F.count("*").alias("n")).collect()}      # a row per training set
    names = sorted(sizes)
    number = {g: i for i, g in enumerate(names)}
    ranges = math.ceil(max(sizes.values(), default=0) / rows_per_range)
    found = [[]] * (p + 1)
    if ranges > 1:
        wide = x.select("t", *[F.col("x")[k].alias(f"x{k}") for k in range(p)])
        found = wide.approxQuantile(wide.columns, [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges))
    t_cuts, v_cuts = cuts_of(found[0]), [cuts_of(f) for f in found[1:]]
    alone = np.r_[False, np.diff(t_cuts) <= np.spacing(t_cuts[:-1]), False]      # ranges of one time: events there are earlier than censorings

    def weighed(batches):
        for pdf in batches:
            if len(pdf):
                w = np.ones((len(pdf), 1))
                if weights:
                    w = weights(pdf)
                elif replicates:
                    at, ids = pd.factorize(pdf["id"])
                    w = draws(ids, replicates)[at]
                at = np.searchsorted(t_cuts, pdf["t"].to_numpy(), side="right")
                s = 2 * at + (alone[at] & (pdf["e"].to_numpy() == 0))
                yield pd.DataFrame({"g": pdf["g"].map(number), "s": s, "t": pdf["t"], "e": pdf["e"], "w": _pack(w), "x": pdf["x"]})

    def by_time(batches):
        for pdf in batches:
            hot = alone[pdf["s"].to_numpy() // 2]
            if not hot.all():
                yield pdf[~hot]
            for _, part in pdf[hot].groupby(["g", "s"]):      # no pairs, only totals
                yield part.head(1).assign(w=_pack(_unpack(part["w"].tolist(), reps).sum(0, keepdims=True)))

    def by_value(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            g, s, e, w, xs = pdf["g"].to_numpy(), pdf["s"].to_numpy(), pdf["e"].to_numpy(), _unpack(pdf["w"].tolist(), reps), _stack(pdf["x"])
            for k in range(p):
                at = np.lexsort((e, s, xs[:, k], g))
                new = np.r_[True, np.any([np.diff(c[at]) != 0 for c in (g, xs[:, k], s, e)], axis=0)]
                head = at[new]
                yield pd.DataFrame({"g": g[head], "k": k, "r": np.searchsorted(v_cuts[k], xs[head, k], side="right"), "v": xs[head, k],
                                    "s": s[head], "e": e[head], "w": _pack(np.add.reduceat(w[at], np.flatnonzero(new), axis=0))})

    def sizes_of(batches):
        total = {}
        for pdf in batches:
            if len(pdf):
                g, w, xs = pdf["g"].to_numpy(), _unpack(pdf["w"].tolist(), reps), _stack(pdf["x"])
                for k in range(p):
                    r = np.searchsorted(v_cuts[k], xs[:, k], side="right")
                    at = np.lexsort((r, g))
                    new = np.flatnonzero(np.r_[True, (np.diff(g[at]) != 0) | (np.diff(r[at]) != 0)])
                    for i, row in zip(at[new], np.add.reduceat(w[at], new, axis=0)):
                        total[g[i], k, r[i]] = total.get((g[i], k, r[i]), 0) + row
        if total:
            yield pd.DataFrame([(*map(int, key), row) for key, row in total.items()], columns=["g", "k", "r", "n"])

    def offsets(rows):
        rows = rows.groupby("r")["n"].agg(lambda c: _stack(c).sum(0)).sort_index().reset_index().assign(g=rows["g"].iloc[0], k=rows["k"].iloc[0])
        n = _stack(rows["n"])
        until = np.cumsum(n, axis=0)
        return rows.assign(below=list(until - n), total=[until[-1]] * len(n)).drop(columns="n")

    def in_time(pdf):
        xs, w = _stack(pdf["x"]), _unpack(pdf["w"].tolist(), reps)
        e = pdf["e"].to_numpy()
        late = 2 * np.unique(pdf["t"].to_numpy(), return_inverse=True)[1] + (1 - e)
        a = w * e[:, None]
        pairs = [pair_sums(late, xs[:, k], a, w) for k in range(p)]
        return pd.DataFrame([(int(pdf["g"].iloc[0]), int(pdf["s"].iloc[0]), np.concatenate(pairs), _later(late, a, w), a.sum(0), w.sum(0))],
                            columns=["g", "s", "pairs", "own", "events", "n"])

    def in_value(rows, place):
        rows = rows.sort_values("v", kind="stable")
        w, v, e, s = _unpack(rows["w"].tolist(), reps), rows["v"].to_numpy(), rows["e"].to_numpy(), rows["s"].to_numpy()
        below, total = place["below"].iloc[0], place["total"].iloc[0]
        seen, until = w > 0, np.cumsum(w, axis=0)
        n, some = until[-1], seen.any(0)
        mid = []
        for at in (np.floor((total - 1) / 2) - below, np.ceil((total - 1) / 2) - below):
            here = (at >= 0) & (at < n)
            mid.append(np.where(here, v[np.minimum((until <= at).sum(0), len(v) - 1)], -np.inf))
        mean = (w * (v - v[0])[:, None]).sum(0) / np.maximum(n, 1)
        cells, at = np.unique(s, return_inverse=True)
        events, counts = np.zeros((len(cells), reps)), np.zeros((len(cells), reps))
        np.add.at(events, at, w * e[:, None])
        np.add.at(counts, at, w)
        return pd.DataFrame([(*(int(rows[c].iloc[0]) for c in "gkr"), pair_sums(s, v, w * e[:, None], w), n, mean + v[0], (w * ((v - v[0])[:, None] - mean) ** 2).sum(0),
                              np.where(some, v[seen.argmax(0)], np.inf), np.where(some, v[len(v) - 1 - seen[::-1].argmax(0)], -np.inf), *mid, cells, events.ravel(), counts.ravel())],
                            columns=["g", "k", "r", "pairs", "n", "mean", "m2", "least", "most", "lo", "hi", "cells", "events", "counts"])

    def whole(times, parts):
        g, k = int(parts["g"].iloc[0]), int(parts["k"].iloc[0])
        times, parts = times.sort_values("s"), parts.sort_values("r")
        e, n = _stack(times["events"]), _stack(times["n"])
        comparable = _stack(times["own"]).sum(0) + _later(np.arange(len(n)), e, n)
        cells, r = np.concatenate(parts["cells"].to_numpy()), np.repeat(parts["r"].to_numpy(), parts["cells"].map(len))
        apart = [np.concatenate(parts[c].to_numpy()).reshape(-1, reps) for c in ("events", "counts")]
        pairs = _stack(times["pairs"])[:, k * reps:(k + 1) * reps].sum(0) + _stack(parts["pairs"]).sum(0) + pair_sums(cells, r, *apart, 0.0)
        size, mean = _stack(parts["n"]), _stack(parts["mean"])
        total = size.sum(0)
        centre = (size * (mean - mean[0])).sum(0) / np.maximum(total, 1)
        var = (_stack(parts["m2"]).sum(0) + (size * (mean - mean[0] - centre) ** 2).sum(0)) / np.maximum(total, 1)
        sd = np.where(_stack(parts["least"]).min(0) < _stack(parts["most"]).max(0), np.sqrt(var), 0.0)
        lo, hi = _stack(parts["lo"]).max(0), _stack(parts["hi"]).max(0)
        mid = (total - 1) / 2
        c = np.where(comparable > 0, pairs / np.maximum(comparable, 1), np.nan)
        out = pd.DataFrame({"g": names[g], "k": k, "replicate": np.arange(reps), "n": total, "events": e.sum(0), "mu": lo + (hi - lo) * (mid - np.floor(mid)), "sd": sd, "c": c})
        return out[out["n"] > 0]

    arrays = lambda *cols: ", ".join(f"{c} array<double>" for c in cols)
    wide, cell = "g int, s int, t double, e int, w binary, x array<double>", "g int, k int, r int, v double, s int, e int, w binary"
    rows = cut(x.mapInPandas(weighed, wide))
    times = spread(rows.mapInPandas(by_time, wide), "g", "s").groupBy("g", "s").applyInPandas(in_time, f"g int, s int, {arrays('pairs', 'own', 'events', 'n')}")
    times = cut(times)      # a row per set and time range
    places = cut(rows.mapInPandas(sizes_of, f"g int, k int, r int, {arrays('n')}").groupBy("g", "k").applyInPandas(offsets, f"r int, g int, k int, {arrays('below', 'total')}"))
    values = spread(rows.mapInPandas(by_value, cell), "g", "k", "r")
    parts = cut(values.groupBy("g", "k", "r").cogroup(spread(places, "g", "k", "r").groupBy("g", "k", "r")).applyInPandas(
        in_value, f"g int, k int, r int, {arrays('pairs', 'n', 'mean', 'm2', 'least', 'most', 'lo', 'hi')}, cells array<int>, {arrays('events', 'counts')}"))
    each = times.withColumn("k", F.explode(F.array(*map(F.lit, range(p)))))
    out = each.groupBy("g", "k").cogroup(parts.groupBy("g", "k")).applyInPandas(whole, "g string, k int, replicate int, n double, events double, mu double, sd double, c double")
    return cut(out.withColumn("c", F.nanvl("c", F.lit(None))))


def sign_tables(model: DataFrame, p: int) -> dict:
    """Centres, scales and signs (feature, replicate) by set; ``model`` is (g, k, replicate, mu, sd, sign), kept features alone."""
    held = {}
    for r in model.select("g", "replicate", "k", "mu", "sd", "sign").collect():      # sets x replicates x features
        held.setdefault(r["g"], {}).setdefault(r["replicate"], []).append((r["k"], r["mu"], r["sd"], r["sign"]))
    tables = {}
    for g, found in held.items():
        mu, sd, sign = np.zeros((p, len(found))), np.ones((p, len(found))), np.zeros((p, len(found)))
        for i, rep in enumerate(sorted(found)):
            for k, *v in found[rep]:
                mu[k, i], sd[k, i], sign[k, i] = v
        tables[g] = mu, sd, sign
    return tables


def median_score(xs: np.ndarray, mu: np.ndarray, sd: np.ndarray, sign: np.ndarray) -> np.ndarray:
    total = 0.0
    for k in range(xs.shape[1]):      # by element, so that equal rows have equal risks
        total = total + (xs[:, k:k + 1] - mu[k]) / sd[k] * sign[k]
    return np.median(total / (sign != 0).sum(0), axis=1)


def sign_scores(rows: DataFrame, model: DataFrame, p: int, ids: list[str]) -> DataFrame:
    """(g, ids, risk): the median over replicates of the mean signed score of their kept features.

    ``rows`` is (g, ids, x), ``model`` (g, k, replicate, mu, sd, sign): kept features
    alone. Rows of sets without a model are left out.
    """
    tables = sign_tables(model, p)

    def risks(batches):
        for pdf in batches:
            for g, part in pdf.groupby("g"):
                yield part.drop(columns="x").assign(risk=median_score(_stack(part["x"]), *tables[g]))

    kinds = dict(rows.dtypes)
    names = F.array(*map(F.lit, sorted(tables))).cast("array<string>")
    rows = rows.where(F.array_contains(names, F.col("g"))).select("g", *ids, "x")
    return rows.mapInPandas(risks, ", ".join([*[f"`{c}` {kinds[c]}" for c in ("g", *ids)], "risk double"]))

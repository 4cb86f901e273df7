"""Ranks and running sums that do not gather a whole column in one task.

Rows are first reduced to distinct values. When those are still many, value
ranges are cut at approximate quantiles; each range is ranked by itself and the
range totals are added as offsets. The cut points are fixed before use, so a
recomputed task ranks exactly as the lost one did.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_RANGE = 2_000_000


def range_bounds(df: DataFrame, col: str, rows_per_range: int = ROWS_PER_RANGE, at_most: int | None = None) -> list[float]:
    """Interior cut points so that a range holds about ``rows_per_range`` rows.

    ``at_most`` is a known bound on the row count; when it already fits one range
    nothing is counted.
    """
    if at_most is not None and at_most <= rows_per_range:
        return []
    ranges = math.ceil(df.count() / rows_per_range)
    if ranges <= 1:
        return []
    points = df.approxQuantile(col, [i / ranges for i in range(1, ranges)], 1.0 / (4 * ranges))
    return sorted(set(points))


def with_range(df: DataFrame, col: str, bounds: list[float], out: str = "_range") -> DataFrame:
    if not bounds:
        return df.withColumn(out, F.lit(0))
    cuts = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_cut", outputCol=out, handleInvalid="keep")
    return cuts.transform(df.withColumn("_cut", F.col(col).cast("double"))).drop("_cut").withColumn(
        out, F.col(out).cast("int"))


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, str], bounds: list[float],
                 descending: bool = False) -> DataFrame:
    """Add, per key, the sum of each column over strictly earlier rows in ``order``.

    ``sums`` maps output name to input column. ``df`` has one row per (keys, order).
    """
    by = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    ahead = lambda cols, o: Window.partitionBy(*cols).orderBy(by(o)).rowsBetween(Window.unboundedPreceding, -1)
    part = keys if keys else [F.lit(0)]
    if not bounds:
        w = ahead(part, order)
        return df.withColumns({out: F.coalesce(F.sum(c).over(w), F.lit(0)) for out, c in sums.items()})
    cut_up = with_range(df, order, bounds)
    w = ahead([*keys, "_range"], order)
    inner = cut_up.withColumns({out: F.coalesce(F.sum(c).over(w), F.lit(0)) for out, c in sums.items()})
    totals = cut_up.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    w = ahead(part, "_range")
    offsets = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{o}").over(w), F.lit(0)).alias(f"_o_{o}") for o in sums])
    joined = inner.join(offsets, [*keys, "_range"])
    return joined.withColumns({o: F.col(o) + F.col(f"_o_{o}") for o in sums}).drop("_range", *[f"_o_{o}" for o in sums])


def rank_table(df: DataFrame, col: str, keys: list[str] | None = None, rows_per_range: int = ROWS_PER_RANGE,
               at_most: int | None = None, weight: str | None = None) -> DataFrame:
    """(keys, value, n, below, dense, total): counts behind every kind of rank; a row counts ``weight`` times (a whole number)."""
    keys = list(keys or [])
    size = F.count("*") if weight is None else F.sum(F.col(weight).cast("long"))
    values = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(size.alias("n")).where("n > 0").withColumn("_one", F.lit(1))
    bounds = range_bounds(values, col, rows_per_range, at_most)
    ranked = running_sums(values, keys, col, {"below": "n", "dense": "_one"}, bounds).drop("_one")
    if not bounds:
        part = Window.partitionBy(*(keys or [F.lit(0)]))   # one range: the group is known to be small
        return ranked.withColumn("total", F.sum("n").over(part))
    totals = values.groupBy(*keys).agg(F.sum("n").alias("total"))
    return ranked.join(totals, keys) if keys else ranked.withColumn("total", totals.scalar())


def exact_quantiles(df: DataFrame, col: str, probabilities, keys: list[str] | None = None,
                    rows_per_range: int = ROWS_PER_RANGE, at_most: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles: (keys, p, value), one row per probability.

    With ``weight``, those of rows repeated that often. Unlike a percentile aggregate, no task has to hold all values of a group.
    """
    keys = list(keys or [])
    points = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    at = F.col("p") * (F.col("total") - 1)
    holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
    ranked = rank_table(df, col, keys, rows_per_range, at_most, weight).withColumn("p", points)
    ranked = ranked.withColumns({"_pos": at, "_v": F.col(col).cast("double")})
    low, high = holds(F.floor("_pos")), holds(F.ceil("_pos"))
    ends = ranked.where(low | high).groupBy(*keys, "p").agg(
        F.max(F.when(low, F.col("_v"))).alias("_lo"), F.max(F.when(high, F.col("_v"))).alias("_hi"),
        F.max(F.col("_pos") - F.floor("_pos")).alias("_frac"))
    return ends.select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("value"))


def add_rank(df: DataFrame, col: str, out: str, keys: list[str] | None = None, pct: bool = False,
             rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Average-tie rank of ``col`` within ``keys`` (as a fraction of the group when ``pct``)."""
    keys = list(keys or [])
    rank = F.col("below") + (F.col("n") + 1) / 2
    table = rank_table(df, col, keys, rows_per_range).select(
        *keys, col, (rank / F.col("total") if pct else rank).alias(out))
    return df.join(table, [*keys, col], "left")


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """First ``k`` rows in a total order (a sort-and-limit keeps k rows per task)."""
    return df.orderBy(*order).limit(k)


def uniform_key(*parts: Column) -> Column:
    """Portable pseudo-random sort key: the first 48 bits of an MD5 digest."""
    text = F.concat_ws("-", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def stratified_folds(df: DataFrame, strata: list[str], seeds: int = 10, folds: int = 5, key: str = "PatientID",
                     rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fold of every row for every seed, balanced within strata, in hash order."""
    rows = df.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1)))).withColumn(
        "_u", uniform_key(F.col("seed"), F.col(key)))
    slots = rows.groupBy("seed", *strata, "_u").agg(F.count("*").alias("_n"))
    bounds = range_bounds(slots, "_u", rows_per_range)
    slots = running_sums(slots, ["seed", *strata], "_u", {"_before": "_n"}, bounds).drop("_n")
    return rows.join(slots, ["seed", *strata, "_u"]).withColumn("cv_fold", F.expr(f"cast(_before % {folds} as int)")).drop("_u", "_before")


def poisson_steps() -> list[float]:
    """Where the distribution function of Poisson(1) steps up, as far as 48 random bits reach."""
    out, p, cdf, k = [], math.exp(-1), math.exp(-1), 0
    while cdf <= 1 - 1 / (1 << 48):      # the largest value a draw can take
        out.append(cdf)
        k += 1
        p /= k
        cdf += p
    return out


def poisson_bootstrap(df: DataFrame, replicates: int, key: str = "PatientID") -> DataFrame:
    """Bootstrap replicates by Poisson(1) multiplicities drawn from a hash of the row key."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = uniform_key(F.lit("boot"), F.col("replicate"), F.col(key)) / float(1 << 48)
    draw = F.lit(0)
    for step in poisson_steps():
        draw = draw + F.when(u >= step, 1).otherwise(0)
    return rows.withColumn("multiplicity", draw).where("multiplicity > 0")


def random_subset(items: DataFrame, replicates: int, fraction: float, col: str = "feature") -> DataFrame:
    """Per replicate, the max(2, round(fraction * p)) items first in hash order."""
    rows = items.select(col).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = Window.partitionBy("replicate")
    ordered = rows.withColumn("_u", uniform_key(F.lit("cols"), F.col("replicate"), F.col(col)))
    return ordered.withColumns({
        "_rank": F.row_number().over(w.orderBy("_u", col)),
        "_k": F.greatest(F.lit(2), F.bround(F.count("*").over(w) * fraction, 0).cast("int")),
    }).where("_rank <= _k").select("replicate", col)

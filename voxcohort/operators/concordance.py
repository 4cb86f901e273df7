"""Exact concordance of risk and censored time without a pair join.

Times become dense positions written in base 8. Two rows with different
positions part at exactly one digit level, so a row contributes once per level,
to the group named by the digits above it; inside a group the pairs are counted
from running sums over risk, one counter per digit. Rows grow with the number of
digits, never with pairs. A group holding very many distinct risks is cut into
risk ranges whose totals are added as offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxcohort.session import cut
from voxcohort.operators.ranks import ROWS_PER_RANGE, exact_quantiles, range_bounds, running_sums

BASE = 8


def concordance(df: DataFrame, time: str = "RFS", event: str = "event", risk: str = "risk",
                group: list[str] | None = None, rule: str = "strict", weight: str | None = None,
                rows_per_range: int = ROWS_PER_RANGE, at_most: int | None = None) -> DataFrame:
    """Concordance per group: (group, n, events, comparable, concordant, c_index).

    ``strict``: a pair counts when i has the event and j lives strictly longer.
    ``library``: also pairs of equal time where exactly one has the event.
    Higher risk is expected to go with shorter time; equal risk counts one half.
    ``weight`` is a whole number of copies of a row.
    """
    group = list(group or [])
    keys = group or ["_all"]
    rows = df if group else df.withColumn("_all", F.lit(0))
    copies = F.col(weight) if weight else F.lit(1)
    cells = rows.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col(risk).isNotNull()).groupBy(
        *keys, F.col(time).alias("_t"), F.col(risk).alias("_r")
    ).agg(F.sum(copies * F.col(event)).alias("_e"), F.sum(copies).alias("_n"))

    cells = cut(cells)   # distinct (time, risk) cells, read by every step below
    if at_most is None:
        at_most = cells.count()

    # comparable pairs need only the distinct times
    times = cells.groupBy(*keys, "_t").agg(F.sum("_e").alias("_e"), F.sum("_n").alias("_n")).withColumn("_one", F.lit(1))
    bounds = range_bounds(times, "_t", rows_per_range, at_most)
    times = running_sums(times, keys, "_t", {"_before": "_n", "_pos": "_one"}, bounds)
    sizes = times.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_e").alias("events"), F.max("_pos").alias("_last"))
    at = times.join(sizes, keys)
    later = F.col("n") - F.col("_before") - F.col("_n")
    same = (F.col("_n") - F.col("_e")) if rule == "library" else F.lit(0)
    comparable = at.groupBy(*keys).agg(F.sum(F.col("_e") * (later + same)).alias("comparable"))

    # one row per digit level that the group's largest position needs
    placed = cells.join(at.select(*keys, "_t", "_pos", "_last"), [*keys, "_t"])
    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log(float(BASE), F.greatest(F.col("_last"), F.lit(1)) + 0.5)).cast("int")))
    power = F.pow(F.lit(float(BASE)), F.col("_level")).cast("long")
    digits = placed.withColumn("_level", F.explode(levels)).select(
        *keys, "_level", F.floor(F.col("_pos") / (power * BASE)).alias("_prefix"),
        F.pmod(F.floor(F.col("_pos") / power), F.lit(BASE)).alias("_digit"), "_r", "_e", F.col("_n").alias("_c"))
    if rule == "library":
        ties = placed.select(*keys, F.lit(-1).alias("_level"), F.col("_pos").alias("_prefix"), "_r", "_e",
                             (F.col("_n") - F.col("_e")).alias("_cens"))
        pair = F.explode(F.array(
            F.struct(F.lit(0).cast("long").alias("_digit"), F.col("_e").alias("_e"), F.lit(0).cast("long").alias("_c")),
            F.struct(F.lit(1).cast("long").alias("_digit"), F.lit(0).cast("long").alias("_e"), F.col("_cens").alias("_c"))))
        ties = ties.withColumn("_p", pair).select(*keys, "_level", "_prefix", "_p._digit", "_r", "_p._e", "_p._c")
        digits = digits.unionByName(ties)
    node = [*keys, "_level", "_prefix"]
    pick = lambda c, d: F.sum(F.when(F.col("_digit") == d, F.col(c)).otherwise(0))
    table = digits.groupBy(*node, "_r").agg(
        *[pick("_e", d).alias(f"_e{d}") for d in range(BASE - 1)],
        *[pick("_c", d).alias(f"_n{d}") for d in range(1, BASE)])
    bounds = range_bounds(cells, "_r", rows_per_range, at_most)
    table = running_sums(table, node, "_r", {f"_l{d}": f"_n{d}" for d in range(1, BASE)}, bounds)
    won = F.lit(0.0)
    for d in range(BASE - 1):
        longer = sum((F.col(f"_l{k}") + F.col(f"_n{k}") * 0.5 for k in range(d + 1, BASE)), F.lit(0.0))
        won = won + F.col(f"_e{d}") * longer
    concordant = table.groupBy(*keys).agg(F.sum(won).alias("concordant"))

    out = sizes.drop("_last").join(comparable, keys).join(concordant, keys)
    out = out.withColumn("c_index", F.when(F.col("comparable") > 0, F.col("concordant") / F.col("comparable")))
    return out if group else out.drop("_all")


def guarded(scores: DataFrame, min_n: int = 10, min_events: int = 3) -> DataFrame:
    """Blank the score of groups too small to judge."""
    enough = (F.col("n") >= min_n) & (F.col("events") >= min_events)
    return scores.withColumn("c_index", F.when(enough, F.col("c_index")))


def by_quantile_bin(df: DataFrame, col: str, probabilities=(0.0, 0.33, 0.66, 1.0)) -> DataFrame:
    """Right-closed quantile bins; the lowest value belongs to no bin."""
    found = {r["p"]: r["value"] for r in exact_quantiles(df, col, probabilities).collect()}
    edges = [found[float(p)] for p in probabilities]
    value = F.col(col)
    bin_no = F.lit(None).cast("int")
    for i in range(len(probabilities) - 2, -1, -1):
        bin_no = F.when((value > edges[i]) & (value <= edges[i + 1]), i).otherwise(bin_no)
    return df.withColumn("bin", bin_no).where("bin is not null")


def univariate_signal(df: DataFrame, features: list[str], group: list[str] | None = None, time: str = "RFS",
                      event: str = "event", min_values: int = 50, min_distinct: int = 3) -> DataFrame:
    """Concordance of every median-filled feature with survival *time* (library rule).

    ``c_index`` is the agreement of the feature with time, as when the feature
    itself is handed over as the predicted time.
    """
    group = list(group or [])
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
                                for f in features]))
    long = df.select(*group, time, event, named.alias("p")).select(*group, time, event, "p.feature", "p.value")
    stats = long.where("value is not null").groupBy(*group, "feature", "value").agg(F.count("*").alias("k")).groupBy(
        *group, "feature").agg(F.sum("k").alias("n_values"), F.count("*").alias("n_distinct"))
    stats = stats.where((F.col("n_values") >= min_values) & (F.col("n_distinct") >= min_distinct))
    at_most = df.count() * len(features)
    middle = exact_quantiles(long, "value", [0.5], [*group, "feature"], at_most=at_most).select(*group, "feature", F.col("value").alias("_med"))
    filled = long.join(stats.join(middle, [*group, "feature"]), [*group, "feature"]).withColumn("risk", -F.coalesce("value", "_med"))
    scores = concordance(filled, time, event, "risk", [*group, "feature"], rule="library", at_most=at_most)
    return scores.withColumn("signal", F.abs(F.col("c_index") - 0.5))

"""How far apart the disease is: diameters, centroid distances, burden, uptake."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxcohort.operators.components import label_components
from voxcohort.operators.crop import body_length, body_slices

POINTS_PER_BLOCK = 1000


def hull_candidates(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels extreme on every axis line through them.

    The two ends of a diameter are vertices of the convex hull and stay, so the
    largest distance is kept exactly while volumes shrink to surfaces. Each step is
    a grouped min / max.
    """
    rows = voxels.select(*keys, "z", "y", "x")
    for axis, rest in (("x", "zy"), ("y", "zx"), ("z", "yx")):
        ends = rows.groupBy(*keys, *rest).agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))
        rows = ends.select(*keys, *rest, F.explode(F.array_distinct(F.array("_a", "_b"))).alias(axis))
    return rows


def _block_kernel():
    """Vectorised distance sum and maximum of two point blocks, shipped by value."""

    @F.pandas_udf("struct<total double, top double>")
    def block_distances(a: pd.Series, b: pd.Series, same: pd.Series) -> pd.DataFrame:
        import numpy as np
        import pandas as pd

        def one(p, q, own):
            p, q = np.asarray(p, dtype=float).reshape(-1, 3), np.asarray(q, dtype=float).reshape(-1, 3)
            d = np.sqrt(((p[:, None, :] - q[None, :, :]) ** 2).sum(axis=2))
            return d.sum() / 2 if own else d.sum(), d.max()

        return pd.DataFrame([one(p, q, s) for p, q, s in zip(a, b, same)], columns=["total", "top"])

    return block_distances


def distance_stats(points: DataFrame, keys: list[str], per_block: int = POINTS_PER_BLOCK) -> DataFrame:
    """(keys, n, mean_mm, max_mm) over all pairs of points (pz, py, px in mm).

    Points of a key are dealt into blocks of bounded size, and every pair of blocks
    is a row of its own that a vectorised kernel reduces to a sum and a maximum.
    Pairs of points never become rows, and a key with very many points spreads over
    as many tasks as it has block pairs.
    """
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"))
    dealt = points.join(sizes, keys).withColumn("k", F.ceil(F.col("n") / per_block).cast("int")).withColumn(
        "blk", F.pmod(F.xxhash64("pz", "py", "px"), F.col("k")).cast("int"))
    blocks = dealt.groupBy(*keys, "n", "k", "blk").agg(F.flatten(F.collect_list(F.array("pz", "py", "px"))).alias("pts"))
    offered = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        *keys, "n", F.least("blk", "j").alias("lo"), F.greatest("blk", "j").alias("hi"), "blk", "pts")
    pairs = offered.groupBy(*keys, "n", "lo", "hi").agg(
        F.any_value(F.when(F.col("blk") == F.col("lo"), F.col("pts")), True).alias("a"),
        F.any_value(F.when(F.col("blk") == F.col("hi"), F.col("pts")), True).alias("b")).where("a is not null and b is not null")
    part = pairs.select(*keys, "n", _block_kernel()("a", "b", F.col("lo") == F.col("hi")).alias("d"))
    total = part.groupBy(*keys, "n").agg(F.sum("d.total").alias("total"), F.max("d.top").alias("top"))
    count = F.col("n") * (F.col("n") - 1) / 2
    return total.select(*keys, "n", F.when(count > 0, F.col("total") / count).otherwise(0.0).alias("mean_mm"),
                        F.col("top").alias("max_mm"))


def _in_mm(df: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(headers.select("case_id", "sx", "sy", "sz"), "case_id").select(
        *keys, *[(F.col(a) * F.col(f"s{a}")).alias(f"p{a}") for a in "zyx"])


def _offset_kernel():
    """Sum of the distances between the voxels of two slices, shipped by value."""

    @F.pandas_udf("double")
    def offset_total(a: pd.Series, b: pd.Series, dz: pd.Series, sy: pd.Series, sx: pd.Series, same: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        def one(p, q, dz, sy, sx, own):
            p, q = np.asarray(p).reshape(-1, 2), np.asarray(q).reshape(-1, 2)
            if len(p) * len(q) <= 1_000_000:
                d = p[:, None, :] - q[None, :, :]
                total = np.sqrt(dz ** 2 + (d[..., 0] * sy) ** 2 + (d[..., 1] * sx) ** 2).sum()
            else:      # how often each in-plane offset occurs, from the correlation of the two bitmaps
                low = np.minimum(p.min(0), q.min(0))
                size = np.maximum(p.max(0), q.max(0)) - low + 1
                maps = []
                for points in (p, q):
                    bitmap = np.zeros(2 * size)
                    bitmap[tuple((points - low).T)] = 1
                    maps.append(np.fft.rfft2(bitmap))
                counts = np.rint(np.fft.irfft2(maps[0] * maps[1].conj(), s=tuple(2 * size)))
                dy, dx = (np.fft.fftfreq(n, 1 / n) for n in counts.shape)
                total = (counts * np.sqrt(dz ** 2 + (dy[:, None] * sy) ** 2 + (dx[None, :] * sx) ** 2)).sum()
            return total / 2 if own else total

        return pd.Series([one(*row) for row in zip(a, b, dz, sy, sx, same)], dtype="float64")

    return offset_total


def mean_distance(lesion: DataFrame, headers: DataFrame) -> DataFrame:
    """(case_id, mean_mm) over all pairs of a case's voxels.

    A row is a pair of slices; within it the offsets of the two bitmaps are counted, so
    work grows with the bitmap and not with the pairs of voxels, and a large lesion
    spreads over as many tasks as it has pairs of slices.
    """
    slices = lesion.groupBy("case_id", "z").agg(F.flatten(F.collect_list(F.array("y", "x"))).alias("at"), F.count("*").alias("n"))
    sizes = slices.groupBy("case_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("z")).alias("zs"))
    offered = slices.drop("n").join(sizes, "case_id").withColumn("other", F.explode("zs")).select(
        "case_id", "n", F.least("z", "other").alias("lo"), F.greatest("z", "other").alias("hi"), "z", "at")
    pairs = offered.groupBy("case_id", "n", "lo", "hi").agg(
        F.any_value(F.when(F.col("z") == F.col("lo"), F.col("at")), True).alias("a"),
        F.any_value(F.when(F.col("z") == F.col("hi"), F.col("at")), True).alias("b"))
    total = _offset_kernel()("a", "b", (F.col("hi") - F.col("lo")) * F.col("sz"), "sy", "sx", F.col("lo") == F.col("hi"))
    sums = pairs.join(headers.select("case_id", "sx", "sy", "sz"), "case_id").withColumn("total", total) \
        .groupBy("case_id", "n").agg(F.sum("total").alias("total"))
    count = F.col("n") * (F.col("n") - 1) / 2
    return sums.select("case_id", F.when(count > 0, F.col("total") / count).otherwise(0.0).alias("mean_mm"))


def lesion_spread(lesion: DataFrame, headers: DataFrame) -> DataFrame:
    """Largest and mean voxel distance, both over all pairs."""
    far = distance_stats(_in_mm(hull_candidates(lesion, ["case_id"]), headers, ["case_id"]), ["case_id"])
    return far.select("case_id", F.col("max_mm").alias("Dmax_mm")).join(
        mean_distance(lesion, headers).select("case_id", F.col("mean_mm").alias("spread_mean_mm")), "case_id")


def lesion_components(mask: DataFrame) -> DataFrame:
    """Component sizes and centroids, keyed by role: all lesions together, nodes alone."""
    roles = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("label") == 2, "node"))))
    rows = mask.where("label > 0").select("case_id", roles.alias("role"), "z", "y", "x")
    return label_components(rows, keys=["case_id", "role"]).groupBy("case_id", "role", "comp_id").agg(
        F.count("*").alias("nvox"), *[F.avg(a).alias(a) for a in "zyx"])


def burden(comps: DataFrame, headers: DataFrame) -> DataFrame:
    """Lesion count, share of the largest lesion and total volume."""
    volume = F.col("sz") * F.col("sy") * F.col("sx") / 1000.0
    sums = comps.where("role = 'all'").groupBy("case_id").agg(
        F.count("*").alias("n_lesions"), F.max("nvox").alias("big"), F.sum("nvox").alias("total"))
    return sums.join(headers, "case_id").select(
        "case_id", "n_lesions", (F.col("big") / F.col("total")).alias("frac_largest"),
        (F.col("total") * volume).alias("total_lesion_ml"))


def centroid_spread(comps: DataFrame, headers: DataFrame) -> DataFrame:
    points = _in_mm(comps.where("role = 'all'"), headers, ["case_id"])
    return distance_stats(points, ["case_id"]).select(
        "case_id", F.col("mean_mm").alias("centroid_spread_mm"), F.col("max_mm").alias("centroid_max_mm"))


def primary_to_nodes(mask: DataFrame, comps: DataFrame, headers: DataFrame) -> DataFrame:
    """Distance of the primary centroid to the node centroids; 0 when either is absent."""
    primary = mask.where("label = 1").groupBy("case_id").agg(*[F.avg(a).alias(f"p{a}") for a in "zyx"])
    gap = F.sqrt(sum(((F.col(a) * F.col(f"s{a}") - F.col(f"p{a}") * F.col(f"s{a}")) ** 2 for a in "zyx"), F.lit(0.0)))
    far = comps.where("role = 'node'").join(primary, "case_id").join(headers, "case_id").groupBy("case_id").agg(
        F.max(gap).alias("top"), F.avg(gap).alias("mean"))
    return mask.where("label > 0").select("case_id").distinct().join(far, "case_id", "left").select(
        "case_id", F.coalesce("top", F.lit(0.0)).alias("dist_p_to_n_max_mm"), F.coalesce("mean", F.lit(0.0)).alias("dist_p_to_n_mean_mm"))


def uptake(mask: DataFrame, headers: DataFrame) -> DataFrame:
    """Node to primary volume ratio and whole-lesion uptake statistics."""
    value = F.when(~F.isnan("pet") & (F.abs("pet") != float("inf")), F.col("pet"))
    sums = mask.where("label > 0").groupBy("case_id").agg(
        F.count_if(F.col("label") == 2).alias("nn"), F.count_if(F.col("label") == 1).alias("np"),
        F.max(value).alias("top"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    volume = F.col("sz") * F.col("sy") * F.col("sx") / 1000.0
    warm = F.col("mean") > 0
    return sums.join(headers, "case_id").select(
        "case_id", F.when(F.col("np") > 0, (F.col("nn") * volume) / (F.col("np") * volume)).alias("gtvn_to_gtvp_ratio"),
        F.when(warm, F.col("top")).alias("suv_max_all"), F.when(warm, F.col("mean")).alias("suv_mean_all"),
        F.when(warm, F.col("top") / F.col("mean")).alias("suv_hetero"), F.when(warm, F.col("std")).alias("suv_std_all"))


def dissemination(mask: DataFrame, voxels: DataFrame, headers: DataFrame) -> DataFrame:
    """All spread features per case; ``mask`` is the cleaned lesion mask with pet."""
    comps = lesion_components(mask)
    length = body_length(body_slices(voxels), headers)
    out = headers.select("case_id").join(lesion_spread(mask.where("label > 0"), headers), "case_id", "left")
    out = out.join(length, "case_id", "left")
    for part in (burden(comps, headers), centroid_spread(comps, headers), primary_to_nodes(mask, comps, headers), uptake(mask, headers)):
        out = out.join(part, "case_id", "left")
    has = F.col("n_lesions").isNotNull()
    return out.withColumns({
        "has_lesion": has.cast("int"), "body_len_mm": F.when(has, F.col("body_len_mm")),
        "Dmax_norm": F.when(F.col("body_len_mm") > 0, F.col("Dmax_mm") / F.col("body_len_mm")),
    })

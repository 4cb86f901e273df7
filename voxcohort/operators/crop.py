"""Image geometry, body extent, crop boxes and disease extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxcohort.operators.ranks import exact_quantiles

# fixed values
BODY_HU = -500
SLAB_MM = 400.0
MARGIN_MM = 25.0
TARGET_SPACING = (0.9765620231628418, 0.9765620231628418, 1.5)


def resampled_voxels() -> Column:
    """Voxel count an image would have on the target spacing."""
    n = F.lit(1.0)
    for axis, target in zip("xyz", TARGET_SPACING):
        n = n * (F.col(f"n{axis}") * F.col(f"s{axis}") / target)
    return n


def physical(axis: str, x: Column, y: Column, z: Column) -> Column:
    """Physical coordinate of a (continuous) index: origin + direction (index * spacing)."""
    row = "xyz".index(axis) * 3
    d = F.col("dir")
    return (F.col(f"o{axis}") + d[row] * (x * F.col("sx")) + d[row + 1] * (y * F.col("sy")) + d[row + 2] * (z * F.col("sz")))


def z_of(k: Column) -> Column:
    return physical("z", F.lit(0.0), F.lit(0.0), k)


def body_slices(voxels: DataFrame) -> DataFrame:
    """Per slice with any tissue, its in-plane bounds. Everything else is read off this."""
    return voxels.where(F.col("ct") > BODY_HU).groupBy("case_id", "z").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def crop_box(slices: DataFrame, headers: DataFrame, slab_mm: float = SLAB_MM, margin_mm: float = MARGIN_MM) -> DataFrame:
    """Head-end slab of ``slab_mm`` below the body top with the in-plane body bounds.

    Cases without body keep the whole image.
    """
    ends = slices.groupBy("case_id").agg(F.min("z").alias("kmin"), F.max("z").alias("kmax"))
    first, last = z_of(F.lit(0.0)), z_of(F.col("nz") - 1.0)
    top = F.when(last > first, F.col("kmax")).otherwise(F.col("kmin"))
    step = (last - first) / F.greatest(F.col("nz") - 1, F.lit(1))
    kept = F.filter(F.sequence(F.lit(0), F.col("nz") - 1), lambda k: F.col("first") + F.col("step") * k >= F.col("floor"))
    slab = headers.join(ends, "case_id").select(
        "*", first.alias("first"), step.alias("step"), (z_of(top.cast("double")) - slab_mm).alias("floor")
    ).withColumn("kept", kept).select("case_id", F.array_min("kept").alias("k0"), F.array_max("kept").alias("k1"))
    plane = slices.join(slab, "case_id").where("z between k0 and k1").groupBy("case_id").agg(
        *[F.min(a).alias(a) for a in ("x0", "y0")], *[F.max(a).alias(a) for a in ("x1", "y1")],
        F.first("k0").alias("k0"), F.first("k1").alias("k1"))
    margin = lambda a: F.bround(margin_mm / F.col(f"s{a}"), 0).cast("int")
    low = lambda a: F.coalesce(F.greatest(F.lit(0), F.col(f"{a}0") - margin(a)), F.lit(0))
    high = lambda a: F.coalesce(F.least(F.col(f"n{a}") - 1, F.col(f"{a}1") + margin(a)), F.col(f"n{a}") - 1)
    k0, k1 = F.coalesce("k0", F.lit(0)), F.coalesce("k1", F.col("nz") - 1)
    return headers.join(plane, "case_id", "left").select(
        "case_id", low("x").alias("x0"), low("y").alias("y0"), k0.alias("z0"), (high("x") - low("x") + 1).alias("dx"),
        (high("y") - low("y") + 1).alias("dy"), (k1 - k0 + 1).alias("dz"))


def gated_box(box: DataFrame, headers: DataFrame, gate: float | None = None, unmeasurable: str = "keep") -> DataFrame:
    """The crop box of every image; with a ``gate`` that the caller names, only of images above it.

    ``unmeasurable`` says what happens when the size cannot be told: keep or crop.
    """
    estimate = resampled_voxels()
    small = F.lit(False) if gate is None else F.coalesce(estimate <= gate, F.lit(unmeasurable == "keep"))
    pick = lambda name, full: F.when(F.col("small"), full).otherwise(F.col(name)).alias(name)
    return headers.withColumn("small", small).join(box, "case_id").select(
        "case_id", *[pick(f"{a}0", F.lit(0)) for a in "xyz"], *[pick(f"d{a}", F.col(f"n{a}")) for a in "xyz"],
        (~F.col("small")).alias("cropped"))


def apply_crop(voxels: DataFrame, box: DataFrame) -> DataFrame:
    inside = " and ".join(f"{a} >= {a}0 and {a} < {a}0 + d{a}" for a in "zyx")
    cols = [c for c in voxels.columns]
    return voxels.join(box, "case_id").where(inside).select(
        *[(F.col(c) - F.col(f"{c}0")).alias(c) if c in ("z", "y", "x") else F.col(c) for c in cols])


def paste_back(voxels: DataFrame, box: DataFrame) -> DataFrame:
    return voxels.join(box, "case_id").select(
        *[(F.col(c) + F.col(f"{c}0")).alias(c) if c in ("z", "y", "x") else F.col(c) for c in voxels.columns])


def same_grid(a: DataFrame, b: DataFrame, tolerance: float | None = 1e-3) -> DataFrame:
    """(case_id, same): equal size and, unless ``tolerance`` is None, equal spacing."""
    cols = [f"{k}{x}" for k in "ns" for x in "xyz"]
    other = b.select("case_id", *[F.col(c).alias(f"b_{c}") for c in cols])
    same = F.lit(True)
    for x in "xyz":
        same = same & (F.col(f"n{x}") == F.col(f"b_n{x}"))
        if tolerance is not None:
            same = same & (F.abs(F.col(f"s{x}") - F.col(f"b_s{x}")) <= tolerance + 1e-5 * F.abs(F.col(f"b_s{x}")))
    return a.join(other, "case_id").select("case_id", same.alias("same"))


def padded_bounds(mask: DataFrame, headers: DataFrame, merge_mm: float = 2.0) -> DataFrame:
    """Lesion bounds with the closing pad, clipped to the image (high end exclusive)."""
    bounds = mask.groupBy("case_id").agg(*[F.min(a).alias(f"{a}_lo") for a in "zyx"], *[F.max(a).alias(f"{a}_hi") for a in "zyx"])
    pad = F.greatest(F.lit(1), F.ceil(merge_mm / F.least("sx", "sy", "sz")).cast("int")) + 1
    return bounds.join(headers, "case_id").select(
        "case_id", *[F.greatest(F.col(f"{a}_lo") - pad, F.lit(0)).alias(f"{a}_lo") for a in "zyx"],
        *[F.least(F.col(f"{a}_hi") + pad, F.col(f"n{a}")).alias(f"{a}_hi") for a in "zyx"])


def body_length(slices: DataFrame, headers: DataFrame) -> DataFrame:
    """Body extent in z; the full image when fewer than two slices hold tissue."""
    span = slices.groupBy("case_id").agg(F.count("*").alias("k"), (F.max("z") - F.min("z") + 1).alias("len"))
    length = F.when(F.col("k") >= 2, F.col("len")).otherwise(F.col("nz")) * F.col("sz")
    return headers.join(span, "case_id", "left").select("case_id", length.alias("body_len_mm"))


def disease_extent(mask: DataFrame, headers: DataFrame) -> DataFrame:
    """CT z-extent and how deep below the CT top the disease starts and ends."""
    les = mask.where("label > 0").groupBy("case_id").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.count("*").alias("n"))
    a, b = z_of(F.lit(0.0)), z_of(F.col("nz") - 1.0)
    la, lb = z_of(F.col("lo").cast("double")), z_of(F.col("hi").cast("double"))
    top = F.greatest(a, b)
    return headers.join(les, "case_id", "left").select(
        "case_id", F.bround(F.abs(b - a), 1).alias("ct_z_extent_mm"),
        F.bround(top - F.greatest(la, lb), 1).alias("depth_top_mm"), F.bround(top - F.least(la, lb), 1).alias("depth_bot_mm"),
        F.bround(F.greatest(la, lb) - F.least(la, lb), 1).alias("lesion_span_mm"), F.coalesce("n", F.lit(0)).alias("n_lesion_vox"))


def extent_summary(extent: DataFrame, large_mm: float = 700.0) -> DataFrame:
    """Depth quantiles, overall and for large scans, and the slab they call for."""
    both = extent.where("depth_bot_mm is not null").select("depth_bot_mm", F.explode(F.array_compact(F.array(
        F.lit("all"), F.when(F.col("ct_z_extent_mm") > large_mm, "large")))).alias("subset"))
    q = exact_quantiles(both, "depth_bot_mm", [0.5, 0.9, 0.95, 0.99], ["subset"])
    wide = q.groupBy("subset").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in
                                     ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))])
    top = both.groupBy("subset").agg(F.count("*").alias("n"), F.max("depth_bot_mm").alias("max"))
    return wide.join(top, "subset").withColumn("slab_mm", F.ceil((F.col("max") + 60) / 10.0).cast("int") * 10)


def fov_report(headers: DataFrame) -> DataFrame:
    z = headers.select((F.col("nz") * F.col("sz")).alias("z_mm"))
    q = exact_quantiles(z, "z_mm", [0.0, 0.5, 0.9, 1.0])
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("value")))
    return q.agg(pick(0.0).alias("z_min"), pick(0.5).alias("z_median"), pick(0.9).alias("z_p90"), pick(1.0).alias("z_max"))


def pick_cases(extent: DataFrame, n_large: int = 8, n_typical: int = 8) -> DataFrame:
    """The largest scans by z-extent and those nearest the median."""
    z = extent.where("ct_z_extent_mm is not null").select("case_id", "ct_z_extent_mm")
    median = exact_quantiles(z, "ct_z_extent_mm", [0.5]).select("value").scalar()
    large = z.orderBy(F.desc("ct_z_extent_mm"), "case_id").limit(n_large).withColumn("kind", F.lit("large"))
    near = z.withColumn("_d", F.abs(F.col("ct_z_extent_mm") - median)).orderBy(
        "_d", F.desc("ct_z_extent_mm"), "case_id").limit(n_typical).drop("_d").withColumn("kind", F.lit("typical"))
    return large.unionByName(near)


def dice(truth: DataFrame, pred: DataFrame, headers: DataFrame, labels=(1, 2)) -> DataFrame:
    """Dice per case and label; 1 when both are empty, 0 when one is."""
    side = lambda df, name: df.where(F.col("label").isin(*labels)).select("case_id", "z", "y", "x", "label", F.lit(name).alias("side"))
    cells = side(truth, "t").unionByName(side(pred, "p")).groupBy("case_id", "label", "z", "y", "x").agg(
        F.count_if(F.col("side") == "t").alias("t"), F.count_if(F.col("side") == "p").alias("p"))
    sums = cells.groupBy("case_id", "label").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum(F.least("t", "p")).alias("both"))
    every = headers.select("case_id", F.explode(F.array(*map(F.lit, labels))).alias("label"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    t, p = zero(F.col("t")), zero(F.col("p"))
    score = F.when((t == 0) & (p == 0), 1.0).when((t == 0) | (p == 0), 0.0).otherwise(2.0 * F.col("both") / (t + p))
    return every.join(sums, ["case_id", "label"], "left").select(
        "case_id", "label", score.alias("dice"), t.alias("truth_vox"), p.alias("pred_vox"))


def voxels_lost(truth: DataFrame, box: DataFrame) -> DataFrame:
    """Truth voxels per case that a crop box leaves outside."""
    inside = F.lit(True)
    for a in "zyx":
        inside = inside & (F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}0") + F.col(f"d{a}"))
    return truth.where("label > 0").join(box, "case_id").groupBy("case_id").agg(F.count_if(~inside).alias("lost"))


def paired_dice(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean Dice per label over cases with truth, before and after, and the label mean."""
    join = before.select("case_id", "label", F.col("dice").alias("before"), "truth_vox").join(
        after.select("case_id", "label", F.col("dice").alias("after")), ["case_id", "label"]).where("truth_vox > 0")
    per = join.groupBy(F.col("label").cast("string").alias("label")).agg(F.avg("before").alias("before"), F.avg("after").alias("after"))
    mean = per.agg(F.lit("mean").alias("label"), F.avg("before").alias("before"), F.avg("after").alias("after"))
    return per.unionByName(mean).withColumn("diff", F.col("after") - F.col("before"))

"""First-order, shape and texture features of lesion regions.

Everything is keyed by region of interest: (case_id, modality, region). Texture
matrices are counted cube by cube (``texture_kernel``); the features are sums over their
few cells. Definitions follow the IBSI reference manual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voxcohort.operators import nodes, resample, texture_kernel as kernel
from voxcohort.operators.joins import overlay
from voxcohort.operators.ranks import exact_quantiles
from voxcohort.operators.spread import distance_stats, hull_candidates
from voxcohort.session import cut

ROI = ["case_id", "modality", "region"]
BIN_WIDTH = {"ct": 25.0, "pt": 0.3}   # fixed values: HU and SUV


def presence(mask: DataFrame, headers: DataFrame) -> DataFrame:
    has = mask.groupBy("case_id").agg(F.bool_or(F.col("label") == 1).alias("p"), F.bool_or(F.col("label") == 2).alias("n"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    return headers.select("case_id").join(has, "case_id", "left").select(
        "case_id", flag("p").alias("has_gtvp"), flag("n").alias("has_gtvn"))


def roi_values(mask: DataFrame, voxels: DataFrame) -> DataFrame:
    """Long table of lesion voxels: (case_id, modality, region, z, y, x, value)."""
    hit = overlay(mask.where("label in (1, 2)").select("case_id", "z", "y", "x", "label"), voxels.select("case_id", "z", "y", "x", "ct", "pet"))
    both = F.explode(F.array(F.struct(F.lit("ct").alias("modality"), F.col("ct").alias("value")),
                             F.struct(F.lit("pt").alias("modality"), F.col("pet").alias("value"))))
    region = F.when(F.col("label") == 1, "gtvp").otherwise("gtvn").alias("region")
    return hit.select("case_id", region, "z", "y", "x", both.alias("m")).select(
        "case_id", "m.modality", "region", "z", "y", "x", "m.value").where("value is not null")


def discretise(roi: DataFrame, widths: dict[str, float] = BIN_WIDTH) -> DataFrame:
    """Gray level by fixed bin width, 1 at the smallest value of the region."""
    width = F.lit(None).cast("double")
    for modality, w in widths.items():
        width = F.when(F.col("modality") == modality, w).otherwise(width)
    low = roi.groupBy(*ROI).agg(F.min("value").alias("_low"))
    return roi.join(low, ROI).withColumn(
        "level", (F.floor(F.col("value") / width) - F.floor(F.col("_low") / width) + 1).cast("int")).drop("_low")


# ------------------------------------------------------------------ first order
def first_order(levels: DataFrame, headers: DataFrame) -> DataFrame:
    """Wide first-order table per region."""
    v = F.col("value")
    whole = F.floor(v * v).cast("double")     # whole parts add without error in any order; the rest is small
    base = levels.groupBy(*ROI).agg(
        F.count("*").alias("n"), (F.sum(whole) + F.sum(v * v - whole)).alias("Energy"), F.min(v).alias("Minimum"), F.max(v).alias("Maximum"),
        F.avg(v).alias("Mean"), F.var_pop(v).alias("Variance"), F.skewness(v).alias("sk"), F.kurtosis(v).alias("ku"))
    marks = (0.1, 0.25, 0.5, 0.75, 0.9)
    q = exact_quantiles(levels, "value", marks, ROI).groupBy(*ROI).agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"q{int(p * 100)}") for p in marks])
    stats = base.join(q, ROI)
    off = levels.join(stats.select(*ROI, "Mean", "q10", "q90"), ROI)
    inner = F.col("value").between(F.col("q10"), F.col("q90"))
    mad = off.groupBy(*ROI).agg(F.avg(F.abs(v - F.col("Mean"))).alias("MeanAbsoluteDeviation"), F.avg(F.when(inner, v)).alias("rm"))
    robust = levels.join(stats.select(*ROI, "q10", "q90").join(mad.select(*ROI, "rm"), ROI), ROI).where(inner).groupBy(*ROI).agg(
        F.avg(F.abs(v - F.col("rm"))).alias("RobustMeanAbsoluteDeviation"))
    share = levels.groupBy(*ROI, "level").agg(F.count("*").alias("k")).join(base.select(*ROI, "n"), ROI).withColumn("p", F.col("k") / F.col("n"))
    histogram = share.groupBy(*ROI).agg((-F.sum(F.col("p") * F.log2("p"))).alias("Entropy"), F.sum(F.col("p") * F.col("p")).alias("Uniformity"))
    flat = F.col("Variance") <= 1e-18
    volume = headers.select("case_id", (F.col("sx") * F.col("sy") * F.col("sz")).alias("vv"))
    out = stats.join(mad, ROI).join(robust, ROI).join(histogram, ROI).join(volume, "case_id")
    return out.select(
        *ROI, "Energy", (F.col("Energy") * F.col("vv")).alias("TotalEnergy"), "Entropy", "Minimum", F.col("q10").alias("10Percentile"),
        F.col("q90").alias("90Percentile"), "Maximum", "Mean", F.col("q50").alias("Median"),
        (F.col("q75") - F.col("q25")).alias("InterquartileRange"), (F.col("Maximum") - F.col("Minimum")).alias("Range"),
        "MeanAbsoluteDeviation", "RobustMeanAbsoluteDeviation", F.sqrt(F.col("Energy") / F.col("n")).alias("RootMeanSquared"),
        F.when(flat, 0.0).otherwise(F.col("sk")).alias("Skewness"), F.when(flat, 0.0).otherwise(F.col("ku") + 3).alias("Kurtosis"),
        "Variance", "Uniformity")


# ------------------------------------------------------------------------ shape
def shape(mask: DataFrame, headers: DataFrame) -> DataFrame:
    """Volume, principal axes and largest diameter per (case_id, region)."""
    key = ["case_id", "region"]
    rows = mask.where("label in (1, 2)").select(
        "case_id", F.when(F.col("label") == 1, "gtvp").otherwise("gtvn").alias("region"), "z", "y", "x")
    mm = rows.join(headers.select("case_id", "sx", "sy", "sz"), "case_id").select(
        *key, *[(F.col(a) * F.col(f"s{a}")).alias(f"p{a}") for a in "zyx"], (F.col("sx") * F.col("sy") * F.col("sz")).alias("vv"))
    cov = lambda a, b: F.covar_pop(f"p{a}", f"p{b}")
    m = mm.groupBy(*key).agg(F.count("*").alias("n"), F.first("vv").alias("vv"),
                             *[cov(a, b).alias(f"c{a}{b}") for a, b in ("zz", "yy", "xx", "zy", "zx", "yx")])
    # eigenvalues of the symmetric 3x3 covariance in closed form
    c = {k: F.col(f"c{k}") for k in ("zz", "yy", "xx", "zy", "zx", "yx")}
    mean = (c["zz"] + c["yy"] + c["xx"]) / 3
    off = c["zy"] ** 2 + c["zx"] ** 2 + c["yx"] ** 2
    m = m.withColumn("q", mean)
    q = F.col("q")
    p = F.sqrt(((c["zz"] - q) ** 2 + (c["yy"] - q) ** 2 + (c["xx"] - q) ** 2 + 2 * off) / 6)
    m = m.withColumn("p", p)
    a, b, d = c["zz"] - q, c["yy"] - q, c["xx"] - q
    det = a * (b * d - c["yx"] ** 2) - c["zy"] * (c["zy"] * d - c["yx"] * c["zx"]) + c["zx"] * (c["zy"] * c["yx"] - b * c["zx"])
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * F.col("p") ** 3), F.lit(1.0))))
    m = m.withColumn("phi", F.acos(r) / 3)
    root = lambda shift: F.greatest(F.lit(0.0), q + 2 * F.col("p") * F.cos(F.col("phi") + shift))
    third = 2.0943951023931953
    m = m.withColumns({"l1": root(F.lit(0.0)), "l3": root(F.lit(third))}).withColumn(
        "l2", F.greatest(F.lit(0.0), 3 * q - F.col("l1") - F.col("l3")))
    ends = hull_candidates(rows, key).join(headers.select("case_id", "sx", "sy", "sz"), "case_id").select(
        *key, *[(F.col(a) * F.col(f"s{a}")).alias(f"p{a}") for a in "zyx"])
    far = distance_stats(ends, key).select(*key, F.col("max_mm").alias("Maximum3DDiameter"))
    ratio = lambda l: F.coalesce(F.sqrt(F.try_divide(F.col(l), F.col("l1"))), F.lit(0.0))
    return m.join(far, key).select(
        *key, (F.col("n") * F.col("vv")).alias("VoxelVolume"), (4 * F.sqrt("l1")).alias("MajorAxisLength"),
        (4 * F.sqrt("l2")).alias("MinorAxisLength"), (4 * F.sqrt("l3")).alias("LeastAxisLength"),
        ratio("l2").alias("Elongation"), ratio("l3").alias("Flatness"), "Maximum3DDiameter")


def in_plane_diameters(mask: DataFrame, headers: DataFrame) -> DataFrame:
    """Largest distance within an axial, coronal or sagittal plane per (case_id, region).

    Only the ends of the lines of a plane can be ends of its diameter; each plane is a
    key of its own.
    """
    key = ["case_id", "region"]
    rows = mask.where("label in (1, 2)").select(
        "case_id", F.when(F.col("label") == 1, "gtvp").otherwise("gtvn").alias("region"), "z", "y", "x")
    out = rows.select(*key).distinct()
    for name, plane, u, v in (("Slice", "z", "y", "x"), ("Column", "y", "z", "x"), ("Row", "x", "z", "y")):
        ends = rows.groupBy(*key, plane, u).agg(F.min(v).alias("_a"), F.max(v).alias("_b")).select(
            *key, plane, u, F.explode(F.array_distinct(F.array("_a", "_b"))).alias(v))
        points = ends.join(headers.select("case_id", "sx", "sy", "sz"), "case_id").select(
            *key, F.col(plane).alias("plane"), *[(F.col(a) * F.col(f"s{a}")).alias(f"p{a}") for a in "zyx"])
        far = distance_stats(points, [*key, "plane"]).groupBy(*key).agg(F.max("max_mm").alias(f"Maximum2DDiameter{name}"))
        out = out.join(far, key)
    return out


# ------------------------------------------------------------- matrix features
def _entropy(p: Column) -> Column:
    return -F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def cooccurrence_features(levels: DataFrame, matrix: DataFrame) -> DataFrame:
    """Co-occurrence features per region, averaged over the directions that have pairs."""
    key = [*ROI, "dir"]
    w = Window.partitionBy(*key)   # at most levels squared rows
    p = matrix.withColumn("p", F.col("c") / F.sum("c").over(w))
    i, j, pr = F.col("i"), F.col("j"), F.col("p")
    p = p.withColumn("u", F.sum(i * pr).over(w)).join(levels.groupBy(*ROI).agg(F.max("level").alias("Ng")), ROI)
    d, u, ng = F.abs(i - j), F.col("u"), F.col("Ng")
    main = p.groupBy(*key).agg(
        F.sum(i * j * pr).alias("Autocorrelation"), F.first("u").alias("JointAverage"),
        F.sum((i + j - 2 * u) ** 4 * pr).alias("ClusterProminence"), F.sum((i + j - 2 * u) ** 3 * pr).alias("ClusterShade"),
        F.sum((i + j - 2 * u) ** 2 * pr).alias("ClusterTendency"), F.sum(d * d * pr).alias("Contrast"),
        F.sum(pr * pr).alias("JointEnergy"), _entropy(pr).alias("JointEntropy"), F.sum(pr / (1 + d * d)).alias("Idm"),
        F.sum(pr / (1 + d * d / (ng * ng))).alias("Idmn"), F.sum(pr / (1 + d)).alias("Id"), F.sum(pr / (1 + d / ng)).alias("Idn"),
        F.sum(F.when(d > 0, pr / (d * d)).otherwise(0.0)).alias("InverseVariance"), F.max(pr).alias("MaximumProbability"),
        F.sum((i - u) ** 2 * pr).alias("SumSquares"), F.sum((i + j) * pr).alias("SumAverage"), F.sum(d * pr).alias("DifferenceAverage"))
    side = lambda k, out: p.groupBy(*key, k.alias("k")).agg(F.sum("p").alias("p")).groupBy(*key).agg(_entropy(F.col("p")).alias(out))
    margins = side(i, "hx").join(side(i + j, "SumEntropy"), key).join(side(d, "DifferenceEntropy"), key)
    all_dirs = main.join(margins, key).withColumns({
        "Correlation": F.when(F.col("SumSquares") <= 1e-12, 1.0).otherwise(
            (F.col("Autocorrelation") - F.col("JointAverage") ** 2) / F.col("SumSquares")),
        "DifferenceVariance": F.col("Contrast") - F.col("DifferenceAverage") ** 2,
        "Imc1": F.when(F.col("hx") <= 1e-12, 0.0).otherwise((F.col("JointEntropy") - 2 * F.col("hx")) / F.col("hx")),
        "Imc2": F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (2 * F.col("hx") - F.col("JointEntropy"))))),
    }).drop("hx")
    names = [c for c in all_dirs.columns if c not in key]
    return all_dirs.groupBy(*ROI).agg(*[F.avg(n).alias(n) for n in names])


def size_matrix_features(matrix: DataFrame, kind: str, voxels: DataFrame | None = None) -> DataFrame:
    """Features of a level-by-size matrix; ``kind`` is glrlm, glszm or gldm.

    With a ``dir`` column the features are averaged over directions. ``voxels``
    (levels) gives the voxel count behind the run and zone percentage.
    """
    key = ROI + (["dir"] if "dir" in matrix.columns else [])
    total = Window.partitionBy(*key)
    m = matrix.withColumn("N", F.sum("c").over(total)).withColumn("p", F.col("c") / F.col("N"))
    m = m.withColumns({"ui": F.sum(F.col("p") * F.col("i")).over(total), "uj": F.sum(F.col("p") * F.col("j")).over(total)})
    i, j, p = F.col("i").cast("double"), F.col("j").cast("double"), F.col("p")
    ii, jj = i * i, j * j
    short, long, size = {"glrlm": ("ShortRun", "LongRun", "Run"), "glszm": ("SmallArea", "LargeArea", "Zone"),
                         "gldm": ("SmallDependence", "LargeDependence", "Dependence")}[kind]
    size_nonuniform = {"glrlm": "RunLengthNonUniformity", "glszm": "SizeZoneNonUniformity", "gldm": "DependenceNonUniformity"}[kind]
    gray = {"glrlm": "GrayLevelRunEmphasis", "glszm": "GrayLevelZoneEmphasis", "gldm": "GrayLevelEmphasis"}[kind]
    sums = m.groupBy(*key).agg(
        F.first("N").alias("N"), F.sum(p / jj).alias(f"{short}Emphasis"), F.sum(p * jj).alias(f"{long}Emphasis"),
        F.sum(p * (i - F.col("ui")) ** 2).alias("GrayLevelVariance"), F.sum(p * (j - F.col("uj")) ** 2).alias(f"{size}Variance"),
        _entropy(p).alias(f"{size}Entropy"), F.sum(p / ii).alias(f"Low{gray}"), F.sum(p * ii).alias(f"High{gray}"),
        F.sum(p / (ii * jj)).alias(f"{short}LowGrayLevelEmphasis"), F.sum(p * ii / jj).alias(f"{short}HighGrayLevelEmphasis"),
        F.sum(p * jj / ii).alias(f"{long}LowGrayLevelEmphasis"), F.sum(p * ii * jj).alias(f"{long}HighGrayLevelEmphasis"))
    square = lambda by, out: m.groupBy(*key, by).agg(F.sum("c").alias("s")).groupBy(*key).agg(F.sum(F.col("s") * F.col("s")).alias(out))
    out = sums.join(square("i", "gi"), key).join(square("j", "gj"), key).withColumns({
        "GrayLevelNonUniformity": F.col("gi") / F.col("N"), size_nonuniform: F.col("gj") / F.col("N"),
        f"{size_nonuniform}Normalized": F.col("gj") / (F.col("N") * F.col("N"))})
    if kind != "gldm":
        out = out.withColumn("GrayLevelNonUniformityNormalized", F.col("gi") / (F.col("N") * F.col("N")))
        count = voxels.groupBy(*ROI).agg(F.count("*").alias("Np"))
        out = out.join(count, ROI).withColumn(f"{size}Percentage", F.col("N") / F.col("Np")).drop("Np")
    out = out.drop("gi", "gj", "N")
    if "dir" not in matrix.columns:
        return out
    return out.groupBy(*ROI).agg(*[F.avg(c).alias(c) for c in out.columns if c not in key])


def tone_difference_features(per: DataFrame) -> DataFrame:
    """Neighbourhood gray-tone difference features per region, from (ROI, i, n, s)."""
    # one small array of gray levels per region
    arr = per.groupBy(*ROI).agg(F.sum("n").alias("N"), F.sort_array(F.collect_list(F.struct(
        F.col("i").cast("double").alias("i"), F.col("n").cast("double").alias("n"), "s"))).alias("a"))
    n = F.col("N")
    fold = lambda f: F.aggregate("a", F.lit(0.0), lambda acc, e: acc + f(e))
    both = lambda f: F.aggregate("a", F.lit(0.0), lambda acc, e: acc + F.aggregate("a", F.lit(0.0), lambda inner, g: inner + f(e, g)))
    prob = lambda e: e["n"] / n
    ps = fold(lambda e: prob(e) * e["s"])
    ng = F.size("a")
    spread = both(lambda e, g: prob(e) * prob(g) * (e["i"] - g["i"]) ** 2)
    busy = both(lambda e, g: F.abs(e["i"] * prob(e) - g["i"] * prob(g)))
    complexity = both(lambda e, g: F.abs(e["i"] - g["i"]) * (prob(e) * e["s"] + prob(g) * g["s"]) / (prob(e) + prob(g)))
    strength = both(lambda e, g: (prob(e) + prob(g)) * (e["i"] - g["i"]) ** 2)
    tone = fold(lambda e: e["s"])
    return arr.select(
        *ROI, F.when(ps == 0, 1e6).otherwise(F.try_divide(F.lit(1.0), ps)).alias("Coarseness"),
        F.when(ng <= 1, 0.0).otherwise(F.try_divide(spread, ng * (ng - 1)) * tone / n).alias("Contrast"),
        F.coalesce(F.try_divide(ps, busy), F.lit(0.0)).alias("Busyness"), (complexity / n).alias("Complexity"),
        F.coalesce(F.try_divide(strength, tone), F.lit(0.0)).alias("Strength"))


# --------------------------------------------------------------------- assembly
def long_form(wide: DataFrame, feature_class: str) -> DataFrame:
    """(case_id, name, value) with names like pt_gtvp_firstorder_Mean."""
    names = [c for c in wide.columns if c not in ROI]
    long = wide.unpivot(ROI, names, "feature", "value")
    return long.select("case_id", F.concat_ws("_", "modality", "region", F.lit(feature_class), "feature").alias("name"), "value")


def texture_classes(levels: DataFrame, headers: DataFrame, block: int = kernel.BLOCK) -> dict[str, DataFrame]:
    """Wide tables of the intensity and texture classes, the matrices counted in one pass."""
    counts = kernel.cube_counts(levels, block)
    pairs = kernel.pair_matrix(counts)
    return {
        "firstorder": first_order(levels, headers),
        "glcm": cooccurrence_features(levels, pairs).join(kernel.maximal_correlation(pairs), ROI),
        "glrlm": size_matrix_features(kernel.run_matrix(counts), "glrlm", levels),
        "glszm": size_matrix_features(kernel.zone_matrix(counts), "glszm", levels),
        "gldm": size_matrix_features(kernel.dependence_matrix(counts), "gldm"),
        "ngtdm": tone_difference_features(kernel.tone_sums(counts)),
    }


def _stacked(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, wide in parts.items():
        part = long_form(wide, name)
        out = part if out is None else out.unionByName(part)
    return out


def radiomics_long(mask: DataFrame, voxels: DataFrame, headers: DataFrame) -> DataFrame:
    """All classes over a mask on its own grid."""
    levels = cut(discretise(roi_values(mask, voxels)))   # read by every class below
    modality = F.explode(F.array(F.lit("ct"), F.lit("pt"))).alias("modality")
    body = shape(mask, headers).join(in_plane_diameters(mask, headers), ["case_id", "region"])
    return _stacked(texture_classes(levels, headers) | {"shape": body.select("case_id", modality, "region", *[c for c in body.columns if c not in ROI])})


def _named(mask: DataFrame, *columns: str) -> DataFrame:
    """(case_id, region, columns) of the lesion voxels."""
    return mask.where("label IN (1, 2)").select("case_id", F.when(F.col("label") == 1, "gtvp").otherwise("gtvn").alias("region"), *columns)


def resampled_masks(mask: DataFrame, headers: DataFrame, spacing: float = 2.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every region on an isotropic grid over its own bounds: (case_id, region, z, y, x), the headers by region, the grids.

    A region holds where its interpolated indicator reaches one half (to nine digits).
    """
    named = _named(mask, "z", "y", "x")
    key = ["case_id", "region"]
    own = headers.join(named.select(*key).distinct(), "case_id")
    grid = cut(resample.isotropic_grid(named, own, spacing, key))
    inside = named.select(*key, "z", "y", "x", F.lit(1.0).alias("value"))
    held = resample.resample(inside, own, grid, 0.0, key).where("value >= 0.5 - 1e-9").select(*key, "z", "y", "x")
    return cut(held), own, grid


def resampled_regions(mask: DataFrame, voxels: DataFrame, headers: DataFrame, spacing: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Every region on an isotropic grid over its own bounds: (rows of ROI, z, y, x, value), (grids by case and region).

    Images are interpolated linearly.
    """
    key = ["case_id", "region"]
    held, own, grid = resampled_masks(mask, headers, spacing)
    near = voxels.select("case_id", "z", "y", "x", F.col("ct").cast("double").alias("ct"), F.col("pet").cast("double").alias("pt")).join(own.select(*key), "case_id")
    at = [*key, "z", "y", "x"]
    out = None
    for modality, default in (("ct", -1000.0), ("pt", 0.0)):
        values = resample.resample(near.select(*at, F.col(modality).alias("value")), own, grid, default, key)
        part = held.join(values, at).select("case_id", F.lit(modality).alias("modality"), "region", "z", "y", "x", "value")
        out = part if out is None else out.unionByName(part)
    return cut(out), grid


def _positive(headers: DataFrame) -> Column:
    return F.least("sx", "sy", "sz") > 0


def _cleaned(voxels: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cleaned mask over the cases whose spacing is positive, and their headers."""
    good = headers.where(_positive(headers))
    return cut(nodes.clean_mask(voxels.join(good.select("case_id"), "case_id", "left_semi"), good)), good


def _lost(mask: DataFrame, headers: DataFrame, clean: DataFrame, found: DataFrame, spacing: float) -> DataFrame:
    """(case_id, region, error): regions of ``mask`` that are not in ``found`` (case_id, region), with the reason."""
    kept = _named(clean, F.lit(True).alias("_kept")).distinct()
    known = headers.select("case_id", F.lit(True).alias("_header"), _positive(headers).alias("_fine"))
    lost = _named(mask).distinct().join(found, ["case_id", "region"], "left_anti").join(known, "case_id", "left").join(kept, ["case_id", "region"], "left")
    reason = F.when(F.col("_header").isNull(), "no image header").when(~F.coalesce("_fine", F.lit(False)), "voxel spacing is not positive") \
        .when(F.col("_kept").isNull(), "nothing left after cleanup").otherwise(f"nothing left on the {spacing:g} mm grid")
    return lost.select("case_id", "region", reason.alias("error"))


def failed_regions(mask: DataFrame, voxels: DataFrame, headers: DataFrame, spacing: float = 2.0) -> DataFrame:
    """(case_id, region, error): the rows of ``radiomics_rows`` that hold an error.

    A region is measured when it has a voxel on its grid, so neither images nor features are computed.
    """
    clean, good = _cleaned(voxels, headers)
    held, _, _ = resampled_masks(clean, good, spacing)
    return _lost(mask, headers, clean, held.select("case_id", "region").distinct(), spacing)


def radiomics_rows(mask: DataFrame, voxels: DataFrame, headers: DataFrame, spacing: float = 2.0) -> DataFrame:
    """(case_id, region, modality, name, value, error): cleanup, isotropic grid, every class.

    A region that can't be measured keeps one row with the reason in ``error`` and
    does not stop the others: a case without a header or an image, a grid spacing that
    is not positive, or a region that vanishes on the new grid.
    """
    clean, good = _cleaned(voxels, headers)
    rows, grid = resampled_regions(clean, voxels, good, spacing)
    levels = cut(discretise(rows))
    one = good.select("case_id", *[F.lit(float(spacing)).alias(f"s{a}") for a in "xyz"])
    parts = texture_classes(levels, one)
    modality = F.explode(F.array(F.lit("ct"), F.lit("pt"))).alias("modality")
    solid = levels.where("modality = 'ct'").select("case_id", F.when(F.col("region") == "gtvp", 1).otherwise(2).alias("label"), "z", "y", "x")
    body = shape(solid, one).join(in_plane_diameters(solid, one), ["case_id", "region"])
    parts["shape"] = body.select("case_id", modality, "region", *[c for c in body.columns if c not in ROI])
    found = cut(_stacked(parts))
    split = F.split("name", "_")
    measured = found.select("case_id", split[1].alias("region"), split[0].alias("modality"), "name", "value", F.lit(None).cast("string").alias("error"))
    lost = _lost(mask, headers, clean, measured.select("case_id", "region").distinct(), spacing)
    return measured.unionByName(lost.select("case_id", "region", F.lit(None).cast("string").alias("modality"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("value"), "error"))


def pivot_features(long: DataFrame, names: list[str]) -> DataFrame:
    """Wide row per case over a known list of names; missing regions leave NULLs."""
    return long.groupBy("case_id").pivot("name", names).agg(F.first("value"))

"""Contract queries for resampling and region features."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxcohort import fixtures as fx
from voxcohort.operators import resample, texture, texture_kernel as kernel
from voxcohort.plans.registry import VIEWS, query, view
from voxcohort.plans.views import component_views

K = "case_id, modality, region"
ROI = texture.ROI


# Small counts give dyadic fractions, which sit exactly on rounding ties; both
# sides are nudged off them before they are rounded for comparison.
NUDGE = 0.000000314159


def rounded(df, *keys, digits=6):
    return df.select(*keys, *[F.round(F.col(c) + NUDGE, digits).alias(c) for c in df.columns if c not in keys])


def off_tie(e, digits):
    return f"round({e} + 0.000000314159, {digits})"


# ------------------------------------------------------------- V7, V38 resampling
def coarse_grid(spark, sf):
    """A 7-cubed grid of 1.6 times the spacing, shifted a third of a voxel."""
    h = fx.volumes(spark, sf)
    return h.select("case_id", *[F.lit(7).alias(f"n{a}") for a in "xyz"], *[(F.col(f"s{a}") * 1.6).alias(f"s{a}") for a in "xyz"],
                    (F.col("sx") / 3).alias("ox"), (F.col("sy") / 3).alias("oy"), (F.col("dir")[8] * F.col("sz") / 3).alias("oz"), "dir")


def resample_view(name, points, source, value, default):
    """Trilinear oracle: ``points`` holds case_id, z, y, x and source coordinates cz, cy, cx on a 12-cubed grid."""
    inside = " AND ".join(f"c{a} >= -0.5 AND c{a} <= 11.5" for a in "zyx")
    clamp = lambda a, d: f"greatest(0, least(11, cast(floor(c{a}) AS INT) + {d}.d))"
    w = lambda a, d: f"(CASE {d}.d WHEN 1 THEN c{a} - floor(c{a}) ELSE 1 - (c{a} - floor(c{a})) END)"
    view(name, f"""SELECT p.case_id, p.z, p.y, p.x, CASE WHEN any_value({inside}) THEN sum(w * coalesce(s.{value}, {default})) ELSE {default} END AS value FROM (
        SELECT p.*, {clamp('z', 'a')} AS qz, {clamp('y', 'b')} AS qy, {clamp('x', 'c')} AS qx, {w('z', 'a')} * {w('y', 'b')} * {w('x', 'c')} AS w
        FROM {points} p, (VALUES (0),(1)) a(d), (VALUES (0),(1)) b(d), (VALUES (0),(1)) c(d)) p
      LEFT JOIN {source} s ON s.case_id = p.case_id AND s.z = qz AND s.y = qy AND s.x = qx GROUP BY 1, 2, 3, 4""", (points, source))


view("coarse_points", """SELECT case_id, cast(a.i AS INT) AS z, cast(b.i AS INT) AS y, cast(c.i AS INT) AS x,
  round(1.0/3 + 1.6*a.i, 9)::DOUBLE AS cz, round(1.0/3 + 1.6*b.i, 9)::DOUBLE AS cy, round(1.0/3 + 1.6*c.i, 9)::DOUBLE AS cx
  FROM fx_volumes, range(0, 7) a(i), range(0, 7) b(i), range(0, 7) c(i)""", ("fx_volumes",))
resample_view("coarse_ct", "coarse_points", "fx_voxels", "ct", "-1000.0")


@query("v7_resample_linear", "SELECT case_id, z, y, x, round(value, 5) AS value FROM coarse_ct")
def v7(spark, sf):
    ct = fx.voxels(spark, sf).select("case_id", "z", "y", "x", F.col("ct").alias("value"))
    out = resample.resample(ct, fx.volumes(spark, sf), coarse_grid(spark, sf), -1000.0)
    return out.select("case_id", "z", "y", "x", F.round("value", 5).alias("value"))


view("iso_points", """SELECT h.case_id, cast(a.i AS INT) AS z, cast(b.i AS INT) AS y, cast(c.i AS INT) AS x,
  round(zlo + 2.0*a.i/sz, 9) AS cz, round(ylo + 2.0*b.i/sy, 9) AS cy, round(xlo + 2.0*c.i/sx, 9) AS cx FROM fx_volumes h
  JOIN (SELECT case_id, min(z) AS zlo, max(z) AS zhi, min(y) AS ylo, max(y) AS yhi, min(x) AS xlo, max(x) AS xhi FROM fx_voxels WHERE label = 1 GROUP BY 1) m ON h.case_id = m.case_id,
  range(0, 64) a(i), range(0, 64) b(i), range(0, 64) c(i)
  WHERE a.i <= floor((zhi-zlo)*sz/2.0) AND b.i <= floor((yhi-ylo)*sy/2.0) AND c.i <= floor((xhi-xlo)*sx/2.0)""", ("fx_volumes", "fx_voxels"))
resample_view("iso_pet", "iso_points", "fx_voxels", "pet", "0.0")


@query("v38_isotropic_resample", "SELECT case_id, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS top FROM iso_pet GROUP BY 1")
def v38(spark, sf):
    vox, h = fx.voxels(spark, sf), fx.volumes(spark, sf)
    grid = resample.isotropic_grid(vox.where("label = 1"), h)
    out = resample.resample(vox.select("case_id", "z", "y", "x", F.col("pet").alias("value")), h, grid, 0.0)
    return out.groupBy("case_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"))


# ------------------------------------------------------------------ V37, V39-V41
@query("v37_presence", """SELECT h.case_id, cast(coalesce(bool_or(label = 1), false) AS INT) AS has_gtvp, cast(coalesce(bool_or(label = 2), false) AS INT) AS has_gtvn
  FROM fx_volumes h LEFT JOIN cleaned c ON c.case_id = h.case_id GROUP BY 1""")
def v37(spark, sf):
    from voxcohort.operators.nodes import clean_mask
    v, h = fx.voxels(spark, sf), fx.volumes(spark, sf)
    return texture.presence(clean_mask(v, h), h)


view("roi", """SELECT case_id, m.modality, CASE label WHEN 1 THEN 'gtvp' ELSE 'gtvn' END AS region, z, y, x, CASE m.modality WHEN 'ct' THEN ct ELSE pet END AS value
  FROM fx_voxels, (VALUES ('ct'),('pt')) m(modality) WHERE label > 0""", ("fx_voxels",))
view("lev", f"""SELECT *, cast(floor(value / w) - min(floor(value / w)) OVER (PARTITION BY {K}) + 1 AS INT) AS level
  FROM (SELECT *, CASE modality WHEN 'ct' THEN 25.0::DOUBLE ELSE 0.3::DOUBLE END AS w FROM roi)""", ("roi",))


def levels(spark, sf):
    vox = fx.voxels(spark, sf)
    return texture.discretise(texture.roi_values(vox.where("label > 0"), vox))


@query("v39_gray_levels", f"SELECT {K}, z, y, x, level FROM lev")
def v39(spark, sf):
    return levels(spark, sf).select(*ROI, "z", "y", "x", "level")


view("fo_q", f"""SELECT {K}, avg(value) AS mean, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.25) AS q25, median(value) AS q50,
  quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90, count(*) AS n, var_pop(value) AS var FROM lev GROUP BY ALL""", ("lev",))
view("fo_r", f"SELECT {K}, avg(value) AS rm FROM lev JOIN fo_q USING ({K}) WHERE value BETWEEN q10 AND q90 GROUP BY ALL", ("lev", "fo_q"))
view("fo_h", f"SELECT {K}, -sum(p * log2(p)) AS entropy, sum(p * p) AS uniformity FROM (SELECT {K}, count(*) / any_value(n) AS p FROM lev JOIN fo_q USING ({K}) GROUP BY {K}, level) GROUP BY ALL", ("lev", "fo_q"))
FO = {"Energy": "sum(value*value)", "TotalEnergy": "sum(value*value) * any_value(sx*sy*sz)", "Entropy": "any_value(entropy)", "Minimum": "min(value)",
      "10Percentile": "any_value(q10)", "90Percentile": "any_value(q90)", "Maximum": "max(value)", "Mean": "any_value(mean)", "Median": "any_value(q50)",
      "InterquartileRange": "any_value(q75 - q25)", "Range": "max(value) - min(value)", "MeanAbsoluteDeviation": "avg(abs(value - mean))",
      "RobustMeanAbsoluteDeviation": "avg(abs(value - rm)) FILTER (value BETWEEN q10 AND q90)", "RootMeanSquared": "sqrt(avg(value*value))",
      "Skewness": "CASE WHEN any_value(var) <= 1e-18 THEN 0 ELSE avg((value-mean)**3) / any_value(var)**1.5 END",
      "Kurtosis": "CASE WHEN any_value(var) <= 1e-18 THEN 0 ELSE avg((value-mean)**4) / any_value(var)**2 END",
      "Variance": "any_value(var)", "Uniformity": "any_value(uniformity)"}
view("fo", f"SELECT {K}, " + ", ".join(f'{e} AS "{n}"' for n, e in FO.items()) + f" FROM lev JOIN fo_q USING ({K}) JOIN fo_r USING ({K}) JOIN fo_h USING ({K}) JOIN fx_volumes USING (case_id) GROUP BY {K}",
     ("lev", "fo_q", "fo_r", "fo_h", "fx_volumes"))


@query("v40_first_order", f"SELECT {K}, " + ", ".join(f"""{off_tie(f'"{n}"', 3)} AS "{n}" """ for n in FO) + " FROM fo")
def v40(spark, sf):
    return rounded(texture.first_order(levels(spark, sf), fx.volumes(spark, sf)), *ROI, digits=3)


view("shape_m", """SELECT case_id, CASE label WHEN 1 THEN 'gtvp' ELSE 'gtvn' END AS region, count(*) AS n, any_value(sx*sy*sz) AS vv, covar_pop(z*sz, z*sz) AS zz, covar_pop(y*sy, y*sy) AS yy,
  covar_pop(x*sx, x*sx) AS xx, covar_pop(z*sz, y*sy) AS zy, covar_pop(z*sz, x*sx) AS zx, covar_pop(y*sy, x*sx) AS yx FROM fx_voxels JOIN fx_volumes USING (case_id) WHERE label > 0 GROUP BY 1, 2""", ("fx_voxels", "fx_volumes"))
view("shape_e", """SELECT *, q + 2*p*cos(phi) AS l1, greatest(0, q + 2*p*cos(phi + 2.0943951023931953)) AS l3 FROM (
  SELECT *, acos(greatest(-1, least(1, coalesce(((zz-q)*((yy-q)*(xx-q) - yx*yx) - zy*(zy*(xx-q) - yx*zx) + zx*(zy*yx - (yy-q)*zx)) / nullif(2*p**3, 0), 1)))) / 3 AS phi FROM (
  SELECT *, sqrt(((zz-q)**2 + (yy-q)**2 + (xx-q)**2 + 2*(zy*zy + zx*zx + yx*yx)) / 6) AS p FROM (SELECT *, (zz+yy+xx)/3 AS q FROM shape_m)))""", ("shape_m",))
view("shape_d", """SELECT a.case_id, a.region, max(sqrt((a.pz-b.pz)**2 + (a.py-b.py)**2 + (a.px-b.px)**2)) AS far FROM shape_p a JOIN shape_p b ON a.case_id = b.case_id AND a.region = b.region GROUP BY 1, 2""", ("shape_p",))
view("shape_p", "SELECT case_id, CASE label WHEN 1 THEN 'gtvp' ELSE 'gtvn' END AS region, z*sz AS pz, y*sy AS py, x*sx AS px FROM fx_voxels JOIN fx_volumes USING (case_id) WHERE label > 0", ("fx_voxels", "fx_volumes"))


@query("v41_shape", """SELECT case_id, region, round(n*vv + 0.000000314159, 5) AS "VoxelVolume", round(4*sqrt(l1) + 0.000000314159, 5) AS "MajorAxisLength", round(4*sqrt(greatest(0, 3*q-l1-l3)) + 0.000000314159, 5) AS "MinorAxisLength",
  round(4*sqrt(l3) + 0.000000314159, 5) AS "LeastAxisLength", round(coalesce(sqrt(greatest(0, 3*q-l1-l3)/nullif(l1, 0)), 0) + 0.000000314159, 5) AS "Elongation", round(coalesce(sqrt(l3/nullif(l1, 0)), 0) + 0.000000314159, 5) AS "Flatness",
  round(far + 0.000000314159, 5) AS "Maximum3DDiameter" FROM shape_e JOIN shape_d USING (case_id, region)""")
def v41(spark, sf):
    s = texture.shape(fx.voxels(spark, sf).where("label > 0"), fx.volumes(spark, sf))
    return rounded(s, "case_id", "region", digits=5)


PLANES = {"Slice": "z", "Column": "y", "Row": "x"}


view("plane_pts", "SELECT case_id, CASE WHEN label = 1 THEN 'gtvp' ELSE 'gtvn' END AS region, z, y, x, z*sz AS pz, y*sy AS py, x*sx AS px FROM fx_voxels JOIN fx_volumes USING (case_id) WHERE label > 0", ("fx_voxels", "fx_volumes"))


@query("v41_in_plane_diameters", "SELECT case_id, region, " + ", ".join(
    f"""round(max(sqrt((a.pz-b.pz)**2 + (a.py-b.py)**2 + (a.px-b.px)**2)) FILTER (a.{p} = b.{p}) + 0.000000314159, 5) AS "Maximum2DDiameter{n}" """ for n, p in PLANES.items())
    + " FROM plane_pts a JOIN plane_pts b USING (case_id, region) GROUP BY ALL")
def v41_planes(spark, sf):
    return rounded(texture.in_plane_diameters(fx.voxels(spark, sf).where("label > 0"), fx.volumes(spark, sf)), "case_id", "region", digits=5)


# --------------------------------------------------------------- V42-V46 textures
view("half13", "SELECT row_number() OVER (ORDER BY dz, dy, dx) - 1 AS dir, dz, dy, dx FROM steps26 WHERE dz > 0 OR (dz = 0 AND (dy > 0 OR (dy = 0 AND dx > 0)))", ("steps26",))
view("pairs13", f"""SELECT a.case_id, a.modality, a.region, dir, a.level AS i, b.level AS j FROM lev a CROSS JOIN half13 d JOIN lev b
  ON a.case_id = b.case_id AND a.modality = b.modality AND a.region = b.region AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx""", ("lev", "half13"))
view("glcm", f"SELECT {K}, dir, i, j, count(*) AS c FROM (SELECT {K}, dir, i, j FROM pairs13 UNION ALL SELECT {K}, dir, j, i FROM pairs13) GROUP BY ALL", ("pairs13",))
view("glcm_p", f"""SELECT *, sum(i * p) OVER (PARTITION BY {K}, dir) AS u, max(ng0) OVER (PARTITION BY {K}) AS ng FROM (
  SELECT m.*, c / sum(c) OVER (PARTITION BY {K}, dir) AS p, ng0 FROM glcm m JOIN (SELECT {K}, max(level) AS ng0 FROM lev GROUP BY ALL) USING ({K}))""", ("glcm", "lev"))
GLCM = {"Autocorrelation": "sum(i*j*p)", "JointAverage": "any_value(u)", "ClusterProminence": "sum((i+j-2*u)**4*p)", "ClusterShade": "sum((i+j-2*u)**3*p)",
        "ClusterTendency": "sum((i+j-2*u)**2*p)", "Contrast": "sum((i-j)**2*p)", "JointEnergy": "sum(p*p)", "JointEntropy": "-sum(p*log2(p))",
        "Idm": "sum(p/(1+(i-j)**2))", "Idmn": "sum(p/(1+(i-j)**2/(ng*ng)))", "Id": "sum(p/(1+abs(i-j)))", "Idn": "sum(p/(1+abs(i-j)/ng))",
        "InverseVariance": "coalesce(sum(p/((i-j)**2)) FILTER (i <> j), 0)", "MaximumProbability": "max(p)", "SumSquares": "sum((i-u)**2*p)",
        "SumAverage": "sum((i+j)*p)", "DifferenceAverage": "sum(abs(i-j)*p)"}
view("glcm_h", f"""SELECT {K}, dir, max(h) FILTER (kind = 'x') AS hx, max(h) FILTER (kind = 's') AS "SumEntropy", max(h) FILTER (kind = 'd') AS "DifferenceEntropy" FROM (
  SELECT {K}, dir, kind, -sum(p*log2(p)) AS h FROM (SELECT {K}, dir, kind, k, sum(p) AS p FROM (
    SELECT {K}, dir, 'x' AS kind, i AS k, p FROM glcm_p UNION ALL SELECT {K}, dir, 's', i+j, p FROM glcm_p UNION ALL SELECT {K}, dir, 'd', abs(i-j), p FROM glcm_p) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL""", ("glcm_p",))
view("glcm_m", f"SELECT {K}, dir, " + ", ".join(f'{e} AS "{n}"' for n, e in GLCM.items()) + f" FROM glcm_p GROUP BY {K}, dir", ("glcm_p",))
GLCM_MORE = {"SumEntropy": '"SumEntropy"', "DifferenceEntropy": '"DifferenceEntropy"',
             "Correlation": 'CASE WHEN "SumSquares" <= 1e-12 THEN 1 ELSE ("Autocorrelation" - "JointAverage"**2) / "SumSquares" END',
             "DifferenceVariance": '"Contrast" - "DifferenceAverage"**2', "Imc1": 'CASE WHEN hx <= 1e-12 THEN 0 ELSE ("JointEntropy" - 2*hx) / hx END',
             "Imc2": 'sqrt(greatest(0, 1 - exp(-2*(2*hx - "JointEntropy"))))'}


@query("v42_cooccurrence", f"SELECT {K}, " + ", ".join(f"""{off_tie(f'avg({e})', 4)} AS "{n}" """ for n, e in {**{n: f'"{n}"' for n in GLCM}, **GLCM_MORE}.items())
       + f" FROM glcm_m JOIN glcm_h USING ({K}, dir) GROUP BY {K}")
def v42(spark, sf):
    lv = levels(spark, sf)
    return rounded(texture.cooccurrence_features(lv, kernel.pair_matrix(kernel.cube_counts(lv, kinds=("pair",)))), *ROI, digits=4)


@query("v42_cooccurrence_matrix", f"SELECT {K}, cast(dir AS INT) AS dir, i, j, c FROM glcm")
def v42m(spark, sf):
    return kernel.pair_matrix(kernel.cube_counts(levels(spark, sf), kinds=("pair",)))


SIZE_NAMES = {"glrlm": ("ShortRun", "LongRun", "Run", "RunLengthNonUniformity", "GrayLevelRunEmphasis"),
              "glszm": ("SmallArea", "LargeArea", "Zone", "SizeZoneNonUniformity", "GrayLevelZoneEmphasis"),
              "gldm": ("SmallDependence", "LargeDependence", "Dependence", "DependenceNonUniformity", "GrayLevelEmphasis")}


def size_sql(matrix, kind, digits=4):
    """Oracle of the level-by-size features over a view (K, dir, i, j, c), rounded unless ``digits`` is None."""
    shown = lambda e: e if digits is None else off_tie(e, digits)
    short, long, size, nonuni, gray = SIZE_NAMES[kind]
    f = {f"{short}Emphasis": "sum(p/(j*j))", f"{long}Emphasis": "sum(p*j*j)", "GrayLevelVariance": "sum(p*(i-ui)**2)", f"{size}Variance": "sum(p*(j-uj)**2)",
         f"{size}Entropy": "-sum(p*log2(p))", f"Low{gray}": "sum(p/(i*i))", f"High{gray}": "sum(p*i*i)", f"{short}LowGrayLevelEmphasis": "sum(p/(i*i*j*j))",
         f"{short}HighGrayLevelEmphasis": "sum(p*i*i/(j*j))", f"{long}LowGrayLevelEmphasis": "sum(p*j*j/(i*i))", f"{long}HighGrayLevelEmphasis": "sum(p*i*i*j*j)",
         "GrayLevelNonUniformity": "any_value(gi)/any_value(n)", nonuni: "any_value(gj)/any_value(n)", f"{nonuni}Normalized": "any_value(gj)/any_value(n)**2"}
    if kind != "gldm":
        f["GrayLevelNonUniformityNormalized"] = "any_value(gi)/any_value(n)**2"
        f[f"{size}Percentage"] = "any_value(n)/any_value(np)"
    by = f"{K}, dir"
    return f"SELECT {K}, " + ", ".join(f"""{shown(f'avg("{n}")')} AS "{n}" """ for n in f) + f" FROM (SELECT {by}, " + ", ".join(f'{e} AS "{n}"' for n, e in f.items()) + f"""
      FROM (SELECT *, sum(p*i) OVER (PARTITION BY {by}) AS ui, sum(p*j) OVER (PARTITION BY {by}) AS uj FROM (
        SELECT {by}, i::DOUBLE AS i, j::DOUBLE AS j, c, c::DOUBLE / sum(c) OVER (PARTITION BY {by}) AS p, (sum(c) OVER (PARTITION BY {by}))::DOUBLE AS n FROM {matrix}))
      JOIN (SELECT {by}, sum(s*s)::DOUBLE AS gi FROM (SELECT {by}, i, sum(c) AS s FROM {matrix} GROUP BY ALL) GROUP BY {by}) USING ({by})
      JOIN (SELECT {by}, sum(s*s)::DOUBLE AS gj FROM (SELECT {by}, j, sum(c) AS s FROM {matrix} GROUP BY ALL) GROUP BY {by}) USING ({by})
      JOIN (SELECT {K}, count(*) AS np FROM lev GROUP BY {K}) USING ({K}) GROUP BY {by}) GROUP BY {K}"""


view("line13", """SELECT v.*, dir, dz, dy, dx, CASE WHEN dz <> 0 THEN v.z * dz WHEN dy <> 0 THEN v.y * dy ELSE v.x * dx END AS t FROM lev v CROSS JOIN half13 d""", ("lev", "half13"))
view("glrlm", f"""SELECT {K}, dir, level AS i, j, count(*) AS c FROM (SELECT {K}, dir, level, lz, ly, lx, g, count(*) AS j FROM (
    SELECT *, t - row_number() OVER (PARTITION BY {K}, dir, lz, ly, lx, level ORDER BY t) AS g FROM (SELECT *, z - t*dz AS lz, y - t*dy AS ly, x - t*dx AS lx FROM line13))
  GROUP BY ALL) GROUP BY ALL""", ("line13",))


@query("v43_run_lengths", size_sql("glrlm", "glrlm"))
def v43(spark, sf):
    lv = levels(spark, sf)
    return rounded(texture.size_matrix_features(kernel.run_matrix(kernel.cube_counts(lv, kinds=("run",))), "glrlm", lv), *ROI, digits=4)


component_views("lz", "lev", ["case_id", "modality", "region", "level"])
view("glszm", f"SELECT {K}, 0 AS dir, level AS i, j, count(*) AS c FROM (SELECT {K}, level, comp_id, count(*) AS j FROM lz_comp GROUP BY ALL) GROUP BY ALL", ("lz_comp",))


@query("v44_size_zones", size_sql("glszm", "glszm"))
def v44(spark, sf):
    lv = levels(spark, sf)
    return rounded(texture.size_matrix_features(kernel.zone_matrix(kernel.cube_counts(lv, kinds=("zone",))), "glszm", lv), *ROI, digits=4)


view("around", f"""SELECT a.case_id, a.modality, a.region, a.z, a.y, a.x, any_value(a.level) AS level, count(b.level) AS n, count(CASE WHEN b.level = a.level THEN 1 END) AS equal, sum(b.level) AS total
  FROM lev a CROSS JOIN steps26 d LEFT JOIN lev b ON a.case_id = b.case_id AND a.modality = b.modality AND a.region = b.region AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx
  GROUP BY 1, 2, 3, 4, 5, 6""", ("lev", "steps26"))
view("gldm", f"SELECT {K}, 0 AS dir, level AS i, equal + 1 AS j, count(*) AS c FROM around GROUP BY ALL", ("around",))


@query("v45_dependences", size_sql("gldm", "gldm"))
def v45(spark, sf):
    lv = levels(spark, sf)
    return rounded(texture.size_matrix_features(kernel.dependence_matrix(kernel.cube_counts(lv, kinds=("dep",))), "gldm"), *ROI, digits=4)


view("ngtdm", f"""SELECT {K}, level::DOUBLE AS i, count(*)::DOUBLE AS n, count(*) / sum(count(*)) OVER (PARTITION BY {K}) AS p, sum(abs(level - total / n)) AS s
  FROM around WHERE n > 0 GROUP BY {K}, level""", ("around",))


@query("v46_tone_differences", f"""SELECT {K}, round(CASE WHEN ps = 0 THEN 1e6 ELSE 1/ps END + 0.000000314159, 4) AS "Coarseness",
  round(CASE WHEN ng <= 1 THEN 0 ELSE con / (ng*(ng-1)) * ts / nv END + 0.000000314159, 4) AS "Contrast", round(coalesce(ps / nullif(busy, 0), 0) + 0.000000314159, 4) AS "Busyness",
  round(comp / nv + 0.000000314159, 4) AS "Complexity", round(coalesce(str / nullif(ts, 0), 0) + 0.000000314159, 4) AS "Strength" FROM
  (SELECT {K}, sum(p*s) AS ps, count(*) AS ng, sum(s) AS ts, sum(n) AS nv FROM ngtdm GROUP BY {K}) JOIN
  (SELECT {K}, sum(a.p*b.p*(a.i-b.i)**2) AS con, sum(abs(a.i*a.p - b.i*b.p)) AS busy, sum(abs(a.i-b.i)*(a.p*a.s+b.p*b.s)/(a.p+b.p)) AS comp,
    sum((a.p+b.p)*(a.i-b.i)**2) AS str FROM ngtdm a JOIN ngtdm b USING ({K}) GROUP BY {K}) USING ({K})""")
def v46(spark, sf):
    lv = levels(spark, sf)
    return rounded(texture.tone_difference_features(kernel.tone_sums(kernel.cube_counts(lv, kinds=("tone",)))), *ROI, digits=4)


WIDE = [f"{m}_{r}_firstorder_{n}" for m in ("ct", "pt") for r in ("gtvp", "gtvn") for n in ("Mean", "Maximum", "Energy")]


@query("v47_wide_features", "SELECT case_id, " + ", ".join(
    f"round(max(\"{c.rsplit('_', 1)[1]}\") FILTER (modality = '{c[:2]}' AND region = '{c[3:7]}') + 0.000000314159, 3) AS \"{c}\"" for c in WIDE) + " FROM fo GROUP BY 1")
def v47(spark, sf):
    long = texture.long_form(texture.first_order(levels(spark, sf), fx.volumes(spark, sf)), "firstorder")
    return rounded(texture.pivot_features(long, WIDE), "case_id", digits=3)


@query("v47_radiomics_long")
def v47_long(spark, sf):
    vox = fx.voxels(spark, sf)
    return texture.radiomics_long(vox.where("label > 0"), vox, fx.volumes(spark, sf))


# ------------------------------------------------- V47 over the isotropic grids
view("r_region", "SELECT case_id, CASE label WHEN 1 THEN 'gtvp' ELSE 'gtvn' END AS region, z, y, x FROM cleaned", ("cleaned",))
view("r_points", """SELECT h.case_id, region, cast(a.i AS INT) AS z, cast(b.i AS INT) AS y, cast(c.i AS INT) AS x,
  round(zlo + 2.0*a.i/sz, 9) AS cz, round(ylo + 2.0*b.i/sy, 9) AS cy, round(xlo + 2.0*c.i/sx, 9) AS cx FROM fx_volumes h
  JOIN (SELECT case_id, region, min(z) AS zlo, max(z) AS zhi, min(y) AS ylo, max(y) AS yhi, min(x) AS xlo, max(x) AS xhi FROM r_region GROUP BY 1, 2) m ON h.case_id = m.case_id,
  range(0, 64) a(i), range(0, 64) b(i), range(0, 64) c(i)
  WHERE a.i <= floor((zhi-zlo)*sz/2.0) AND b.i <= floor((yhi-ylo)*sy/2.0) AND c.i <= floor((xhi-xlo)*sx/2.0)""", ("fx_volumes", "r_region"))
_q = lambda a, d: f"greatest(0, least(11, cast(floor(c{a}) AS INT) + {d}.d))"
_w = lambda a, d: f"(CASE {d}.d WHEN 1 THEN c{a} - floor(c{a}) ELSE 1 - (c{a} - floor(c{a})) END)"
view("r_taps", f"""SELECT p.*, {_q('z', 'a')} AS qz, {_q('y', 'b')} AS qy, {_q('x', 'c')} AS qx, {_w('x', 'c')} * {_w('y', 'b')} * {_w('z', 'a')} AS w, 4*c.d + 2*b.d + a.d AS tap
  FROM r_points p, (VALUES (0),(1)) a(d), (VALUES (0),(1)) b(d), (VALUES (0),(1)) c(d)""", ("r_points",))
# the eight taps are added in one order, x first, so that every run has the same last digits
_added = lambda v: " + ".join(f"sum(w * {v}) FILTER (tap = {k})" for k in range(8))
view("r_values", f"""SELECT t.case_id, t.region, t.z, t.y, t.x, {_added('coalesce(s.ct, -1000.0)')} AS ct, {_added('coalesce(s.pet, 0.0)')} AS pt FROM r_taps t
  LEFT JOIN fx_voxels s ON s.case_id = t.case_id AND s.z = qz AND s.y = qy AND s.x = qx
  LEFT JOIN r_region r ON r.case_id = t.case_id AND r.region = t.region AND r.z = qz AND r.y = qy AND r.x = qx
  GROUP BY ALL HAVING sum(w * CASE WHEN r.z IS NULL THEN 0.0 ELSE 1.0 END) >= 0.5 - 1e-9""", ("r_taps", "fx_voxels", "r_region"))
view("r_roi", "SELECT case_id, m.modality, region, z, y, x, CASE m.modality WHEN 'ct' THEN ct ELSE pt END AS value FROM r_values, (VALUES ('ct'),('pt')) m(modality)", ("r_values",))
view("r_grid", "SELECT DISTINCT case_id, 2.0::DOUBLE AS sx, 2.0::DOUBLE AS sy, 2.0::DOUBLE AS sz FROM r_values", ("r_values",))
view("r_solid", "SELECT case_id, CASE region WHEN 'gtvp' THEN 1 ELSE 2 END AS label, z, y, x FROM r_values", ("r_values",))
_COPIED = ["lev", "fo_q", "fo_r", "fo_h", "fo", "shape_m", "shape_e", "shape_p", "shape_d", "plane_pts", "pairs13", "glcm", "glcm_p", "glcm_h", "glcm_m", "line13", "glrlm", "lz_walk", "lz_comp", "glszm",
           "around", "gldm", "ngtdm"]
_RENAMED = {**{n: f"r_{n}" for n in _COPIED}, "roi": "r_roi", "fx_voxels": "r_solid", "fx_volumes": "r_grid"}


def on_grids(sql):
    """SQL of a region query, read over the isotropic grids instead."""
    return re.sub(r"\b(" + "|".join(sorted(_RENAMED, key=len, reverse=True)) + r")\b", lambda m: _RENAMED[m[0]], sql)


for _name in _COPIED:
    _sql = on_grids(VIEWS[_name][1])
    if _name == "fo":       # whole parts of squares add without error in any order
        _sql = _sql.replace("sum(value*value)", "(sum(floor(value*value)) + sum(value*value - floor(value*value)))")
    view(f"r_{_name}", _sql, tuple(_RENAMED.get(d, d) for d in VIEWS[_name][0]))


def long_sql(feature_class, sql, keys=K):
    tail = "concat_ws('_', modality, region, '" + feature_class + "', feature)"
    wide = f"(SELECT m.modality, s.* FROM ({on_grids(sql)}) s, (VALUES ('ct'),('pt')) m(modality))" if keys != K else f"({on_grids(sql)})"
    return f"SELECT case_id, region, modality, {tail} AS name, {off_tie('value', 3)} AS value FROM (UNPIVOT {wide} ON COLUMNS(* EXCLUDE (case_id, modality, region)) INTO NAME feature VALUE value)"


SHAPE_SQL = """SELECT case_id, region, n*vv AS "VoxelVolume", 4*sqrt(l1) AS "MajorAxisLength", 4*sqrt(greatest(0, 3*q-l1-l3)) AS "MinorAxisLength",
  4*sqrt(l3) AS "LeastAxisLength", coalesce(sqrt(greatest(0, 3*q-l1-l3)/nullif(l1, 0)), 0) AS "Elongation", coalesce(sqrt(l3/nullif(l1, 0)), 0) AS "Flatness", far AS "Maximum3DDiameter" FROM shape_e JOIN shape_d USING (case_id, region)"""
PLANE_SQL = "SELECT case_id, region, " + ", ".join(f"""max(sqrt((a.pz-b.pz)**2 + (a.py-b.py)**2 + (a.px-b.px)**2)) FILTER (a.{p} = b.{p}) AS "Maximum2DDiameter{n}" """ for n, p in PLANES.items()) \
    + " FROM plane_pts a JOIN plane_pts b USING (case_id, region) GROUP BY ALL"
GLCM_SQL = f"SELECT {K}, " + ", ".join(f'avg({e}) AS "{n}"' for n, e in {**{n: f'"{n}"' for n in GLCM}, **GLCM_MORE}.items()) + f" FROM glcm_m JOIN glcm_h USING ({K}, dir) GROUP BY {K}"
NGTDM_SQL = f"""SELECT {K}, CASE WHEN ps = 0 THEN 1e6 ELSE 1/ps END AS "Coarseness", CASE WHEN ng <= 1 THEN 0 ELSE con / (ng*(ng-1)) * ts / nv END AS "Contrast", coalesce(ps / nullif(busy, 0), 0) AS "Busyness",
  comp / nv AS "Complexity", coalesce(str / nullif(ts, 0), 0) AS "Strength" FROM (SELECT {K}, sum(p*s) AS ps, count(*) AS ng, sum(s) AS ts, sum(n) AS nv FROM ngtdm GROUP BY {K}) JOIN
  (SELECT {K}, sum(a.p*b.p*(a.i-b.i)**2) AS con, sum(abs(a.i*a.p - b.i*b.p)) AS busy, sum(abs(a.i-b.i)*(a.p*a.s+b.p*b.s)/(a.p+b.p)) AS comp, sum((a.p+b.p)*(a.i-b.i)**2) AS str
   FROM ngtdm a JOIN ngtdm b USING ({K}) GROUP BY {K}) USING ({K})"""


@query("v47_radiomics_resampled", " UNION ALL ".join([
    long_sql("firstorder", "SELECT * FROM fo"), long_sql("glcm", GLCM_SQL), long_sql("glrlm", size_sql("glrlm", "glrlm", None)), long_sql("glszm", size_sql("glszm", "glszm", None)),
    long_sql("gldm", size_sql("gldm", "gldm", None)), long_sql("ngtdm", NGTDM_SQL), long_sql("shape", SHAPE_SQL, "case"), long_sql("shape", PLANE_SQL, "case")]))
def v47_resampled(spark, sf):
    """Every class after cleanup, on the 2 mm grid of each region."""
    vox = fx.voxels(spark, sf)
    rows = texture.radiomics_rows(vox, vox, fx.volumes(spark, sf)).where("error IS NULL AND name NOT LIKE '%_MCC'")
    return rows.select("case_id", "region", "modality", "name", F.round(F.col("value") + NUDGE, 3).alias("value"))


@query("v47_failed_regions", "SELECT DISTINCT case_id, CASE label WHEN 1 THEN 'gtvp' ELSE 'gtvn' END AS region, 'nothing left after cleanup' AS error FROM fx_voxels v WHERE label > 0 AND NOT EXISTS (SELECT 1 FROM cleaned c WHERE c.case_id = v.case_id AND c.label = v.label)")
def v47_failed(spark, sf):
    """Regions that yield no features, with the reason."""
    vox = fx.voxels(spark, sf)
    return texture.failed_regions(vox, vox, fx.volumes(spark, sf))

"""Lesion nodes: measures, physical gate, cleanup and case geometry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voxcohort.operators.components import label_components

DEAD_ZONE_MM = 6.0
MERGE_RADII_MM = (0.0, 2.0, 4.0, 6.0)


@dataclass(frozen=True)
class NodeGate:
    """Physical gate of a node. Modes: both, either (tuner), legacy (no volume clause)."""

    min_ml: float = 1.5
    suv: float = 3.0
    diam_mm: float = 8.0
    mode: str = "both"

    def passes(self) -> Column:
        hot, wide = F.col("suvmax") >= self.suv, F.col("max_mm") >= self.diam_mm
        if self.mode == "legacy":
            return hot | wide
        enough = F.col("vol_ml") >= self.min_ml
        return enough & ((hot | wide) if self.mode == "either" else (hot & wide))


LEGACY_GATE = NodeGate(min_ml=0.0, suv=2.5, diam_mm=10.0, mode="legacy")


def merged_nodes(voxels: DataFrame, headers: DataFrame, label: int = 2, merge_mm: float | tuple = 2.0,
                 border: str = "erode", block: int = 32) -> DataFrame:
    """Voxels of the merged groups of one label, keyed (case_id, merge_mm, comp_id).

    ``pet`` is known on original voxels; only the few voxels a closing added are
    looked up in the full voxel table.
    """
    radii = [float(m) for m in (merge_mm if isinstance(merge_mm, (tuple, list)) else [merge_mm])]
    lesion = voxels.where(F.col("label") == label).select("case_id", "z", "y", "x", "pet").withColumn(
        "merge_mm", F.explode(F.array(*[F.lit(r) for r in radii])))
    closed = label_components(lesion, headers, ["case_id", "merge_mm"], merge_mm=F.col("merge_mm"),
                              border=border, block=block, carry="pet")
    return _with_bridge_pet(closed, voxels) if any(radii) else closed


def _with_bridge_pet(closed: DataFrame, voxels: DataFrame) -> DataFrame:
    """``closed`` with the PET of the voxels that the closing added.

    The inner join keeps the large table on the streamed side, so it is not shuffled
    where the few added voxels are small enough to broadcast or to filter its scan.
    """
    at = ["case_id", "z", "y", "x"]
    bridge = closed.where("not is_original").drop("pet")
    hits = voxels.select(*at, "pet").join(bridge.select(*at).distinct(), at)
    return closed.where("is_original").unionByName(bridge.join(hits, at, "left"))


def measure_nodes(merged: DataFrame, headers: DataFrame, missing_pet: float = 0.0) -> DataFrame:
    """Count, volume, largest axis extent, SUVmax and centroid of every merged group."""
    span = lambda a: F.max(a) - F.min(a) + 1
    sums = merged.groupBy("case_id", "merge_mm", "comp_id").agg(
        F.count("*").alias("nvox"), span("z").alias("ez"), span("y").alias("ey"), span("x").alias("ex"),
        F.max("pet").alias("suv"), *[F.avg(a).alias(f"c{a}") for a in "zyx"])
    return sums.join(headers.select("case_id", "sx", "sy", "sz"), "case_id").select(
        "case_id", "merge_mm", "comp_id", "nvox",
        (F.col("nvox") * (F.col("sz") * F.col("sy") * F.col("sx") / 1000.0)).alias("vol_ml"),
        F.greatest(*[F.col(f"e{a}") * F.col(f"s{a}") for a in "zyx"]).alias("max_mm"),
        F.coalesce("suv", F.lit(float(missing_pet))).alias("suvmax"),
        (F.col("cx") * F.col("sx")).alias("cx_mm"), (F.col("cy") * F.col("sy")).alias("cy_mm"),
        (F.col("cz") * F.col("sz")).alias("cz_mm"))


def rejected_voxels(merged: DataFrame, nodes: DataFrame, gate: NodeGate) -> DataFrame:
    """Original voxels that belong to a group the gate refuses."""
    bad = nodes.where(~gate.passes()).select("case_id", "merge_mm", "comp_id")
    return merged.where("is_original").join(bad, ["case_id", "merge_mm", "comp_id"], "left_semi").select(
        "case_id", "z", "y", "x")


def largest_component(voxels: DataFrame, label: int = 1, block: int = 32) -> DataFrame:
    """Voxels of the largest component of a label per case; the first one on ties."""
    comps = label_components(voxels.where(F.col("label") == label).select("case_id", "z", "y", "x", "pet"),
                             carry="pet", block=block)
    return _largest(comps).select("case_id", "z", "y", "x", F.lit(label).alias("label"), "pet")


def _largest(comps: DataFrame) -> DataFrame:
    best = comps.groupBy("case_id", "comp_id").agg(F.count("*").alias("n")).groupBy("case_id").agg(
        F.max_by("comp_id", F.struct(F.col("n"), -F.col("comp_id"))).alias("comp_id"))
    return comps.join(best, ["case_id", "comp_id"], "left_semi").select("case_id", "z", "y", "x", "pet")


def clean_mask(voxels: DataFrame, headers: DataFrame, gate: NodeGate = NodeGate(), merge_mm: float = 2.0,
               missing_pet: float = 0.0, border: str = "erode", block: int = 32) -> DataFrame:
    """Lesion voxels left after dropping refused nodes and secondary primaries.

    The decision is made on merged groups; the output only ever holds original
    voxels. Background stays implicit (absent rows).
    """
    lesion = voxels.where("label in (1, 2)").select("case_id", "label", "z", "y", "x", "pet")
    radius = F.when(F.col("label") == 2, float(merge_mm)).otherwise(0.0)
    comps = label_components(lesion, headers, ["case_id", "label"], merge_mm=radius, border=border, carry="pet", block=block)
    merged = _with_bridge_pet(comps.where("label = 2").drop("label"), voxels).withColumn("merge_mm", F.lit(float(merge_mm)))
    drop = rejected_voxels(merged, measure_nodes(merged, headers, missing_pet), gate)
    nodes = lesion.where("label = 2").join(drop, ["case_id", "z", "y", "x"], "left_anti")
    return nodes.unionByName(_largest(comps.where("label = 1")).withColumn("label", F.lit(1))).select(
        "case_id", "z", "y", "x", "label", "pet")


def body_midline(voxels: DataFrame, headers: DataFrame) -> DataFrame:
    """x of the body centroid in mm over all body voxels; image centre if no body."""
    mean = voxels.where("ct > -500").groupBy("case_id").agg(F.avg("x").alias("mx"))
    return headers.select("case_id", "nx", "sx").join(mean, "case_id", "left").select(
        "case_id", F.coalesce(F.col("mx") * F.col("sx"), F.col("nx") / 2.0 * F.col("sx")).alias("midline_mm"))


def image_midline(headers: DataFrame) -> DataFrame:
    return headers.select("case_id", (F.col("nx") / 2.0 * F.col("sx")).alias("midline_mm"))


def side_of(x_mm: Column, midline: Column, dead_zone: float = DEAD_ZONE_MM) -> Column:
    return F.when(x_mm > midline + dead_zone, "R").when(x_mm < midline - dead_zone, "L").otherwise("mid")


def laterality_of(n: Column, any_left: Column, any_right: Column) -> Column:
    return (F.when(n == 0, "none").when(any_left & any_right, "bilateral")
            .when(any_left | any_right, "unilateral").otherwise("midline"))


def case_geometry(clean: DataFrame, headers: DataFrame, midline: DataFrame, merge_mm: float = 2.0,
                  border: str = "erode", x_mm: Column | None = None, block: int = 32) -> DataFrame:
    """Staging geometry per case from a cleaned mask; cases without nodes included.

    ``x_mm`` picks the coordinate a side is judged on (voxel-space by default).
    """
    full = clean.select("case_id", "z", "y", "x", "label", "pet")
    nodes = measure_nodes(merged_nodes(full, headers, 2, merge_mm, border, block), headers)
    side = side_of(F.col("cx_mm") if x_mm is None else x_mm, F.col("midline_mm"))
    per_case = nodes.join(midline, "case_id").withColumn("side", side).groupBy("case_id").agg(
        F.count("*").cast("int").alias("n"), F.max("max_mm").alias("mm"), F.sum("nvox").alias("nv"),
        F.bool_or(F.col("side") == "L").alias("l"), F.bool_or(F.col("side") == "R").alias("r"))
    primary = clean.where("label = 1").groupBy("case_id").agg(F.count("*").alias("np"))
    volume = F.col("sz") * F.col("sy") * F.col("sx") / 1000.0
    n = F.coalesce("n", F.lit(0))
    return headers.join(per_case, "case_id", "left").join(primary, "case_id", "left").select(
        "case_id",
        F.bround(F.coalesce("np", F.lit(0)) * volume, 3).alias("gtvp_ml"),
        n.alias("n_gtvn"),
        F.bround(F.coalesce("mm", F.lit(0.0)), 1).alias("max_node_mm"),
        F.bround(F.coalesce("nv", F.lit(0)) * volume, 3).alias("gtvn_total_ml"),
        laterality_of(n, F.coalesce("l", F.lit(False)), F.coalesce("r", F.lit(False))).alias("laterality"))

"""Morphological closing and 26-connected components on sparse voxel tables.

A volume is cut into fixed cubes, so neither a huge scan nor a huge lesion ever
lands in one task. One shuffle brings each cube its voxels plus the halo the
closing needs; inside the task a dense numpy window closes the mask and labels
it. Components that continue in the next cube meet through the equi-join of the
voxels on cube faces, and the small graph of face contacts is contracted with
alternating large-star / small-star steps (Kiveris et al. 2014).

A component is named by the packed (z, y, x) of its first voxel in raster order,
which does not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxcohort.session import cut, spread

BLOCK = 32
_HALF_NEIGHBOURS = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)
                    if (dz, dy, dx) > (0, 0, 0)]


def voxel_code(z: Column, y: Column, x: Column) -> Column:
    """Raster-order code of a voxel index (20 bits per axis)."""
    return (z.cast("long") * (1 << 40)) + (y.cast("long") * (1 << 20)) + x.cast("long")


def radius_voxels(mm: Column, spacing: Column) -> Column:
    """Closing radius in voxels; half-to-even rounding, at least 1 unless mm is 0."""
    return F.when(mm > 0, F.greatest(F.lit(1), F.bround(mm / spacing, 0).cast("int"))).otherwise(F.lit(0))


def _offsets(axis: str, block: int) -> Column:
    reach = F.col(f"r{axis}") * 2
    at = F.col(axis)
    return F.explode(F.sequence(F.floor((at - reach) / block).cast("int"), F.floor((at + reach) / block).cast("int")))


def _labeller(keys: list[str], block: int, border: str, carry: str | None):
    """Build the per-cube function. Kept as a closure so that it ships by value."""

    def label_cube(pdf):
        import numpy as np
        import pandas as pd

        first = pdf.iloc[0]
        r = [int(first.rz), int(first.ry), int(first.rx)]
        size = [int(first.nz), int(first.ny), int(first.nx)]
        corner = np.array([int(first.bz), int(first.by), int(first.bx)]) * block
        # window: the voxels at hand plus one radius, all that a closing can touch
        at = pdf[["z", "y", "x"]].to_numpy(dtype=np.int64)
        low_end, high_end = at.min(axis=0) - r, at.max(axis=0) + r + 1
        shape = tuple(high_end - low_end)
        at = at - low_end
        mask = np.zeros(shape, dtype=bool)
        mask[at[:, 0], at[:, 1], at[:, 2]] = True
        original = mask

        def sweep(a, axis, radius, combine):
            out = a.copy()
            n = a.shape[axis]
            for step in range(1, radius + 1):
                ahead = [slice(None)] * 3
                behind = [slice(None)] * 3
                ahead[axis], behind[axis] = slice(step, n), slice(0, n - step)
                ahead, behind = tuple(ahead), tuple(behind)
                combine(out[behind], a[ahead], out=out[behind])
                combine(out[ahead], a[behind], out=out[ahead])
            return out

        if any(r):
            for axis in range(3):
                mask = sweep(mask, axis, r[axis], np.logical_or)
            if border == "erode":
                for axis in range(3):
                    index = np.arange(shape[axis]) + low_end[axis]
                    outside = (index < 0) | (index >= size[axis])
                    mask[tuple(outside if a == axis else slice(None) for a in range(3))] = False
            for axis in range(3):
                mask = sweep(mask, axis, r[axis], np.logical_and)
            rim = mask
            mask = np.zeros_like(rim)
            inner = tuple(slice(k, n - k) for k, n in zip(r, shape))
            mask[inner] = rim[inner]
        start, stop = np.maximum(corner, low_end), np.minimum(corner + block, high_end)
        core = tuple(slice(max(0, p), max(0, q)) for p, q in zip(start - low_end, stop - low_end))
        mask, was = mask[core], original[core]

        cells = np.flatnonzero(mask)
        names = keys + ["z", "y", "x", "local_id", "is_original"] + ([carry] if carry else [])
        if cells.size == 0:
            return pdf.head(0).assign(local_id=0, is_original=False)[names]

        # smallest linear index reachable: neighbour minimum plus pointer jumping
        big = mask.size
        label = np.where(mask, np.arange(big).reshape(mask.shape), big)
        while True:
            low = label
            for axis in range(3):
                low = sweep(low, axis, 1, np.minimum)
            low = np.where(mask, low, big)
            flat = low.ravel()
            hooked = np.arange(big + 1)
            np.minimum.at(hooked, label.ravel()[cells], flat[cells])
            while True:
                jumped = hooked[hooked]
                if np.array_equal(jumped, hooked):
                    break
                hooked = jumped
            new = hooked[flat].reshape(mask.shape)
            if np.array_equal(new, label):
                break
            label = new

        z, y, x = np.unravel_index(cells, mask.shape)
        rz, ry, rx = np.unravel_index(label.ravel()[cells], mask.shape)
        out = {k: first[k] for k in keys}
        out = pd.DataFrame({
            "z": z + start[0], "y": y + start[1], "x": x + start[2],
            "local_id": ((rz + start[0]) << 40) + ((ry + start[1]) << 20) + rx + start[2],
            "is_original": was.ravel()[cells],
        }).assign(**out)
        if carry:
            dense = np.full(shape, np.nan)
            dense[at[:, 0], at[:, 1], at[:, 2]] = pdf[carry].to_numpy(dtype=float)
            values = dense[core].ravel()[cells]
            out[carry] = pd.Series(values).astype(object).where(~np.isnan(values), None)
        return out[names]

    return label_cube


def label_components(mask: DataFrame, headers: DataFrame | None = None, keys: list[str] | None = None, *,
                     merge_mm: Column | None = None, border: str = "erode", block: int = BLOCK,
                     carry: str | None = None) -> DataFrame:
    """Close ``mask`` by ``merge_mm`` and name its 26-connected components.

    ``mask`` holds (keys, z, y, x[, carry]) rows of foreground voxels; ``headers``
    holds the image size and spacing per ``case_id`` and is needed when closing.
    ``border='erode'`` treats everything outside the image as background while
    eroding; ``'ignore'`` closes as if the image went on.
    Returns (keys, z, y, x, is_original, comp_id[, carry]); ``carry`` is NULL on
    voxels the closing added.
    """
    keys = list(keys or ["case_id"])
    kinds = dict(mask.dtypes)
    if merge_mm is None:
        zero = [F.lit(0).alias(n) for n in ("rz", "ry", "rx", "nz", "ny", "nx")]
        work = mask.select(*keys, "z", "y", "x", *([carry] if carry else []), *zero)
    else:
        head = headers.select("case_id", "nx", "ny", "nz", "sx", "sy", "sz")
        work = mask.join(head, "case_id").select(
            *keys, "z", "y", "x", *([carry] if carry else []),
            *[radius_voxels(merge_mm, F.col(f"s{a}")).alias(f"r{a}") for a in "zyx"], "nz", "ny", "nx")
    for axis in "zyx":
        work = work.withColumn(f"b{axis}", _offsets(axis, block))

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys]
                       + ["z int", "y int", "x int", "local_id long", "is_original boolean"]
                       + ([f"`{carry}` double"] if carry else []))
    cubes = [*keys, "bz", "by", "bx"]
    local = cut(spread(work, *cubes).groupBy(*cubes).applyInPandas(_labeller(keys, block, border, carry), schema))

    contacts = cut(_face_contacts(local, keys, block))
    if contacts.isEmpty():
        return local.withColumnRenamed("local_id", "comp_id")
    roots = contract(contacts, keys).withColumnRenamed("node", "local_id")
    return (local.join(roots, [*keys, "local_id"], "left")
            .withColumn("comp_id", F.coalesce("root", "local_id")).drop("root", "local_id"))


def _face_contacts(local: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Distinct pairs of cube-local components that touch across a cube face."""
    edge = [F.pmod(F.col(a), F.lit(block)).isin(0, block - 1) for a in "zyx"]
    face = local.where(edge[0] | edge[1] | edge[2]).select(*keys, "z", "y", "x", "local_id")
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dz", "dy", "dx"), o)])
                                for o in _HALF_NEIGHBOURS]))
    cube = lambda a: F.floor(a / block)
    reach = face.withColumn("d", steps).select(
        *keys, *[(F.col(a) + F.col(f"d.d{a}")).alias(a) for a in "zyx"], F.col("local_id").alias("other"),
        (F.lit(False) | (cube(F.col("z")) != cube(F.col("z") + F.col("d.dz")))
         | (cube(F.col("y")) != cube(F.col("y") + F.col("d.dy")))
         | (cube(F.col("x")) != cube(F.col("x") + F.col("d.dx")))).alias("crosses"),
    ).where("crosses").drop("crosses")
    return reach.join(face, [*keys, "z", "y", "x"]).where("other <> local_id").select(
        *keys, F.greatest("other", "local_id").alias("a"), F.least("other", "local_id").alias("b")).distinct()


def contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Map every node of the edge list (keys, a > b) to the smallest node it reaches.

    Each half-step is one grouped minimum (partial aggregation, so a hub node does
    not pile up in a task) and one join back; the state is checkpointed per round.
    """
    def signature(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    def star(both, larger: bool):
        low = both.groupBy(*keys, "u").agg(F.min(F.least("u", "v")).alias("m"))
        joined = both.join(low, [*keys, "u"])
        if larger:
            return joined.where("v > u").select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))
        return joined.where("v < u").select(*keys, F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))

    seen = signature(edges)
    while True:
        both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(*keys, F.col("b"), F.col("a")))
        large = star(both, True).where("a <> b").distinct()
        down = large.select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))
        edges = cut(star(down, False).where("a <> b").distinct())
        now = signature(edges)
        if now == seen:
            return edges.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now

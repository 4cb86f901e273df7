"""Linear resampling of voxel tables between grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxcohort.operators.crop import physical

BLOCK = 32              # target voxels along a cube
_HEADER = ["nx", "ny", "nz", "sx", "sy", "sz", "ox", "oy", "oz", "dir"]


def resample(values: DataFrame, source: DataFrame, target: DataFrame, default: float, keys: list[str] | None = None,
             col: str = "value", block: int = BLOCK) -> DataFrame:
    """Value of ``values`` (keys, z, y, x, col) at every voxel of ``target``, linearly interpolated.

    The target grid is cut into cubes. A source voxel goes to the cubes that may read
    it, which its own place tells: most go to one, so the source is shuffled once and
    nothing is made per target voxel before the interpolation itself, a numpy step per
    cube. Cubes are smaller where the target is coarser, so the source voxels behind a
    cube stay bounded. Points beyond half a voxel outside the source, and absent source
    voxels, take ``default``; inside, the edge value is continued.
    """
    keys = list(keys or ["case_id"])
    axes = "xyz"
    head = target.select(*keys, *_HEADER).join(source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in _HEADER]), keys)
    # source index = m * target index + c, axis by axis of both grids; orthonormal directions invert by transposing
    turn = lambda i, j: sum((F.col("s_dir")[3 * r + i] * F.col("dir")[3 * r + j] for r in range(3)), F.lit(0.0))
    shift = lambda i: sum((F.col("s_dir")[3 * r + i] * (F.col(f"o{b}") - F.col(f"s_o{b}")) for r, b in enumerate(axes)), F.lit(0.0))
    head = head.select(*keys, *[F.col(f"n{a}") for a in axes], *[F.col(f"s_n{a}").alias(f"m{a}") for a in axes],
                       F.array(*[turn(i, j) * F.col(f"s{b}") / F.col(f"s_s{a}") for i, a in enumerate(axes) for j, b in enumerate(axes)]).alias("f"),
                       F.array(*[shift(i) / F.col(f"s_s{a}") for i, a in enumerate(axes)]).alias("c"),
                       F.array(*[turn(i, j) * F.col(f"s_s{a}") / F.col(f"s{b}") for j, b in enumerate(axes) for i, a in enumerate(axes)]).alias("back"))
    reach = F.greatest(*[sum((F.abs(F.col("f")[3 * i + j]) for j in range(3)), F.lit(0.0)) for i in range(3)])
    head = head.withColumn("block", F.greatest(F.lit(4), F.least(F.lit(block), F.floor(2 * block / F.greatest(reach, F.lit(1.0))).cast("int"))))
    last = lambda a: F.floor((F.col(f"n{a}") - 1) / F.col("block")).cast("int")
    cubes = head
    for a in "zyx":
        cubes = cubes.withColumn(f"b{a}", F.explode(F.sequence(F.lit(0), last(a))))
    # a source voxel serves the target indices within one source voxel of it
    rows = values.select(*keys, "z", "y", "x", F.col(col).cast("double").alias("v")).join(head.select(*keys, *[f"n{a}" for a in axes], "c", "back", "block"), keys)
    for j, a in enumerate(axes):
        middle = sum((F.col("back")[3 * j + i] * (F.col(b) - F.col("c")[i]) for i, b in enumerate(axes)), F.lit(0.0))
        wide = sum((F.abs(F.col("back")[3 * j + i]) for i in range(3)), F.lit(0.0)) + 1e-6
        low, high = F.greatest(F.lit(0), F.ceil(middle - wide)), F.least(F.col(f"n{a}") - 1, F.floor(middle + wide))
        rows = rows.withColumns({f"lo{a}": F.floor(low / F.col("block")).cast("int"), f"hi{a}": F.when(low <= high, F.floor(high / F.col("block")).cast("int"))})
    for a in "zyx":
        rows = rows.where(F.col(f"hi{a}").isNotNull()).withColumn(f"b{a}", F.explode(F.sequence(f"lo{a}", f"hi{a}")))
    rows = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(f"b{a}").alias(f"_b{a}") for a in "zyx"], "z", "y", "x", "v")
    kinds = dict(values.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", z int, y int, x int, `{col}` double"
    place = [*keys, "bz", "by", "bx"]
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = cubes.repartition(n, *place).groupBy(*place)
    right = rows.repartition(n, *[f"_{c}" for c in place]).groupBy(*[f"_{c}" for c in place])
    return left.cogroup(right).applyInPandas(_interpolator(keys, default, col), schema)


def _interpolator(keys: list[str], default: float, col: str):
    """The per-cube function, as a closure so that it ships by value."""

    def work(head, near):
        import numpy as np
        import pandas as pd

        names = [*keys, "z", "y", "x", col]
        if not len(head):
            return near.head(0).rename(columns={f"_{k}": k for k in keys} | {"v": col})[names]
        h = head.iloc[0]
        b = int(h.block)
        f, c = np.array(h.f).reshape(3, 3), np.array(h.c)
        start = np.array([h.bx, h.by, h.bz]) * b
        stop = np.minimum(start + b, [h.nx, h.ny, h.nz])
        z, y, x = (g.ravel() for g in np.meshgrid(*[np.arange(start[k], stop[k]) for k in (2, 1, 0)], indexing="ij"))
        at = np.round(np.stack([x, y, z], 1) @ f.T + c, 9)
        size = np.array([h.mx, h.my, h.mz])
        inside = ((at >= -0.5) & (at <= size - 0.5)).all(1)
        value = np.full(len(at), float(default))
        if inside.any():
            at = at[inside]
            low = np.floor(at).astype(np.int64)
            part = at - low
            first = np.clip(low.min(0), 0, size - 1)
            span = np.clip(low.max(0) + 1, 0, size - 1) - first + 1
            box = np.full(span, float(default))
            if len(near):
                q = near[["x", "y", "z"]].to_numpy(np.int64) - first
                known = ((q >= 0) & (q < span)).all(1) & near["v"].notna().to_numpy()
                box[tuple(q[known].T)] = near["v"].to_numpy()[known]
            total = np.zeros(len(at))
            for d in np.ndindex(2, 2, 2):
                q = np.clip(low + d, 0, size - 1) - first
                total += np.where(d, part, 1 - part).prod(1) * box[tuple(q.T)]
            value[inside] = total
        out = pd.DataFrame({"z": z, "y": y, "x": x, col: value})
        for k in keys:
            out[k] = h[k]
        return out[names]

    return work


def isotropic_grid(mask: DataFrame, headers: DataFrame, spacing: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """Isotropic grid over the bounds of a mask, same axes, first voxel centre kept; one per ``keys``."""
    keys = list(keys or ["case_id"])
    ends = mask.groupBy(*keys).agg(*[F.min(a).alias(f"{a}0") for a in "xyz"], *[F.max(a).alias(f"{a}1") for a in "xyz"])
    df = headers.join(ends, keys)
    corner = [F.col(f"{a}0").cast("double") for a in "xyz"]
    count = lambda a: (F.floor((F.col(f"{a}1") - F.col(f"{a}0")) * F.col(f"s{a}") / spacing) + 1).cast("int")
    return df.select(
        *keys, *[count(a).alias(f"n{a}") for a in "xyz"], *[F.lit(float(spacing)).alias(f"s{a}") for a in "xyz"],
        *[physical(a, *corner).alias(f"o{a}") for a in "xyz"], "dir")

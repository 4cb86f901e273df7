"""Neighbourhoods, runs and zones of gray levels, cube by cube.

A region is cut into fixed cubes; one shuffle brings each cube its voxels and a halo of
one voxel, so only voxels at cube faces travel more than once. A numpy window over the
box of the cube's own voxels then counts the texture matrices that are asked for: pairs
by direction, dependences, tone sums, run lengths and zones. What a cube can't finish
goes on as small rows:

* a run that continues beyond a face is an open piece of its line; pieces that follow
  one another make one run (their lengths add up, in any grouping),
* a zone that continues beyond a face is a node with a size; equal levels that touch
  across faces are its edges, and contracted nodes add their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from voxcohort.operators.components import _HALF_NEIGHBOURS, contract
from voxcohort.session import cut, spread

ROI = ["case_id", "modality", "region"]
BLOCK = 32
_SCHEMA = "kind string, dir int, i int, j long, c long, s double, a long, b long"
_NAMES = _SCHEMA.replace(",", "").split()[::2]
KINDS = ("pair", "dep", "tone", "run", "zone")


def _counter(block: int, kinds: tuple = KINDS):
    """The per-cube function, as a closure so that it ships by value."""
    halves = list(_HALF_NEIGHBOURS)
    types = dict(zip(_NAMES, ("object", "int32", "int32", "int64", "int64", "float64", "int64", "int64")))

    def count(pdf):
        import numpy as np
        import pandas as pd

        first = pdf.iloc[0]
        cube = np.array([int(first.bz), int(first.by), int(first.bx)]) * block
        at = pdf[["z", "y", "x"]].to_numpy(np.int64) - cube
        inner = ((at >= 0) & (at < block)).all(1)
        names = ["case_id", "modality", "region", *_NAMES]
        if not inner.any():
            return pdf.head(0).assign(kind="", **dict.fromkeys(_NAMES[1:], 0))[names]
        # window: the box of the cube's own voxels and one voxel around it
        low, high = at[inner].min(0), at[inner].max(0)
        near = ((at >= low - 1) & (at <= high + 1)).all(1)
        ext, corner, at = tuple(high - low + 1), cube + low, at[near] - low + 1
        shape = tuple(n + 2 for n in ext)
        grid = np.zeros(shape, np.int64)
        grid[at[:, 0], at[:, 1], at[:, 2]] = pdf["level"].to_numpy(np.int64)[near]
        core = (slice(1, -1),) * 3
        own = grid[core]
        full = own > 0
        shifted = lambda g, d, k=1: g[tuple(slice(1 + k * v, 1 + k * v + n) for v, n in zip(d, ext))]
        index = np.stack(np.meshgrid(*[np.arange(n) for n in ext], indexing="ij"))
        spot = index + low[:, None, None, None]      # place within the cube
        out = []

        def add(kind, dir=0, i=None, j=None, c=None, s=0.0, a=0, b=0):
            row = (kind, dir, i, 0 if j is None else j, 1 if c is None else c, s, a, b)
            out.append([np.broadcast_to(np.asarray(v, types[k]), len(i)) for k, v in zip(_NAMES, row)])

        # pairs, dependences, tones
        equal, total, near = (np.zeros(ext, np.int64) for _ in range(3))
        top = int(grid.max()) + 1
        for n, d in enumerate(halves if {"pair", "dep", "tone"} & set(kinds) else ()):
            for sign in (1, -1) if {"dep", "tone"} & set(kinds) else (1,):
                other = shifted(grid, d, sign)
                met = full & (other > 0)
                near += met
                total += np.where(met, other, 0)
                equal += met & (other == own)
                if sign == 1 and "pair" in kinds and met.any():
                    code, c = np.unique(own[met] * top + other[met], return_counts=True)
                    add("pair", n, code // top, code % top, c)
        if "dep" in kinds:
            code, c = np.unique(own[full] * 64 + equal[full] + 1, return_counts=True)
            add("dep", 0, code // 64, code % 64, c)
        seen = full & (near > 0)
        if "tone" in kinds and seen.any():
            level, place, c = np.unique(own[seen], return_inverse=True, return_counts=True)
            gap = np.abs(own[seen] - total[seen] / near[seen])
            add("tone", 0, level, None, c, np.bincount(place, weights=gap))

        # runs: lengths grow slice by slice along each direction
        for n, d in enumerate(halves if "run" in kinds else ()):
            axis = next(k for k, v in enumerate(d) if v)
            length = full.astype(np.int64)
            inside = np.ones(ext, bool)
            for k, v in enumerate(d):
                inside &= (spot[k] - v >= 0) & (spot[k] - v < block)
            same = full & inside & (shifted(grid, d, -1) == own)
            for t in range(1, ext[axis]):
                to = [slice(None)] * 3
                to[axis] = t
                to = tuple(to)
                z, y, x = (index[k][to] - v for k, v in enumerate(d))
                ok = same[to]
                length[to] += np.where(ok, length[np.clip(z, 0, ext[0] - 1), np.clip(y, 0, ext[1] - 1), np.clip(x, 0, ext[2] - 1)], 0)
            leaves = np.ones(ext, bool)
            for k, v in enumerate(d):
                leaves &= (spot[k] + v >= 0) & (spot[k] + v < block)
            onward = shifted(grid, d, 1) == own
            end = full & ~(onward & leaves)
            p = np.argwhere(end)
            size, level = length[end], own[end]
            begin = p - (size - 1)[:, None] * np.array(d)
            before = grid[tuple((begin - np.array(d) + 1).T)]
            open_ = (before == level) | onward[end]
            if (~open_).any():
                code, c = np.unique(level[~open_] * (block + 1) + size[~open_], return_counts=True)
                add("run", n, code // (block + 1), code % (block + 1), c)
            if open_.any():
                start = begin[open_] + corner
                t0 = start[:, axis] * d[axis]
                line = start - t0[:, None] * np.array(d) + (1 << 20)
                add("open_run", n, level[open_], size[open_], None, 0.0, (line[:, 0] << 42) + (line[:, 1] << 21) + line[:, 2], t0)

        # zones: every voxel takes the smallest index it reaches over equal levels
        if "zone" in kinds:
            big = full.size
            label = np.where(full, np.arange(big).reshape(full.shape), big)
            padded = np.full(shape, big)
            cells = np.flatnonzero(full)
            while True:
                padded[core] = label
                low = label.copy()
                for d in halves:
                    for sign in (1, -1):
                        np.minimum(low, np.where(shifted(grid, d, sign) == own, shifted(padded, d, sign), big), out=low)
                low = np.where(full, low, big)
                hooked = np.arange(big + 1)
                np.minimum.at(hooked, label.ravel()[cells], low.ravel()[cells])
                while True:
                    jumped = hooked[hooked]
                    if np.array_equal(jumped, hooked):
                        break
                    hooked = jumped
                new = hooked[low]
                if np.array_equal(new, label):
                    break
                label = new
            voxel = lambda q: ((q[:, 0] + corner[0]) << 40) + ((q[:, 1] + corner[1]) << 20) + q[:, 2] + corner[2]
            zone, place, size = np.unique(label[full], return_inverse=True, return_counts=True)
            ids = voxel(np.stack(np.unravel_index(zone, full.shape), 1))
            level = own.ravel()[zone]
            beyond = np.zeros(len(zone), bool)
            flat = np.zeros(full.shape, np.int64)
            flat[full] = place
            faces, contacts = [], []
            for d in halves:
                for sign in (1, -1):
                    out_of = np.zeros(full.shape, bool)
                    for k, v in enumerate(d):
                        out_of |= (spot[k] + sign * v < 0) | (spot[k] + sign * v >= block)
                    hit = full & out_of & (shifted(grid, d, sign) == own)
                    if hit.any():
                        p = np.argwhere(hit)
                        beyond[flat[hit]] = True
                        faces.append((voxel(p), flat[hit]))
                        contacts.append((voxel(p + sign * np.array(d)), flat[hit]))
            if (~beyond).any():
                pairs, c = np.unique(np.stack([level[~beyond], size[~beyond]], 1), axis=0, return_counts=True)
                add("zone", 0, pairs[:, 0], pairs[:, 1], c)
            if beyond.any():
                add("open_zone", 0, level[beyond], size[beyond], None, 0.0, ids[beyond])
                for kind, found in (("face", faces), ("contact", contacts)):
                    seen = np.unique(np.concatenate([np.stack([v, z], 1) for v, z in found]), axis=0)
                    add(kind, 0, level[seen[:, 1]], None, None, 0.0, seen[:, 0], ids[seen[:, 1]])
        if not out:
            return pdf.head(0).assign(kind="", **dict.fromkeys(_NAMES[1:], 0))[names]
        table = pd.DataFrame(dict(zip(_NAMES, map(np.concatenate, zip(*out)))))
        for k in ("case_id", "modality", "region"):
            table[k] = first[k]
        return table[names]

    return count


def cube_counts(levels: DataFrame, block: int = BLOCK, kinds: tuple = KINDS) -> DataFrame:
    """Count rows of every cube of ``levels`` (ROI, z, y, x, level from 1); the matrices below read them.

    ``kinds`` names the counts that are wanted: pair, dep, tone, run, zone.
    """
    reach = lambda a: F.explode(F.sequence(F.floor((F.col(a) - 1) / block).cast("int"), F.floor((F.col(a) + 1) / block).cast("int")))
    rows = levels.select(*ROI, "z", "y", "x", "level")
    for a in "zyx":
        rows = rows.withColumn(f"b{a}", reach(a))
    types = dict(levels.dtypes)
    cubes = [*ROI, "bz", "by", "bx"]
    schema = ", ".join(f"`{k}` {types[k]}" for k in ROI) + ", " + _SCHEMA
    return cut(spread(rows, *cubes).groupBy(*cubes).applyInPandas(_counter(block, tuple(kinds)), schema))


def pair_matrix(counts: DataFrame) -> DataFrame:
    """Symmetric co-occurrence counts: (ROI, dir, i, j, c)."""
    one_way = counts.where("kind = 'pair'").select(*ROI, "dir", "i", F.col("j").cast("int").alias("j"), "c")
    return one_way.unionByName(one_way.select(*ROI, "dir", F.col("j").alias("i"), F.col("i").alias("j"), "c")).groupBy(*ROI, "dir", "i", "j").agg(F.sum("c").alias("c"))


def dependence_matrix(counts: DataFrame) -> DataFrame:
    """Voxels of level i with j - 1 equal neighbours: (ROI, i, j, c)."""
    return counts.where("kind = 'dep'").groupBy(*ROI, "i", "j").agg(F.sum("c").alias("c"))


def tone_sums(counts: DataFrame) -> DataFrame:
    """Voxels with neighbours and their summed tone gaps per level: (ROI, i, n, s)."""
    return counts.where("kind = 'tone'").groupBy(*ROI, "i").agg(F.sum("c").alias("n"), F.sum("s").alias("s"))


def run_matrix(counts: DataFrame) -> DataFrame:
    """Runs of level i and length j by direction: (ROI, dir, i, j, c); open pieces of a line are joined first."""
    done = counts.where("kind = 'run'").select(*ROI, "dir", "i", "j", "c")
    line = [*ROI, "dir", "i", "a"]
    ahead = Window.partitionBy(*line).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)       # pieces at the faces along one line
    pieces = counts.where("kind = 'open_run'").select(*line, "j", "b").withColumn("run", F.col("b") - F.coalesce(F.sum("j").over(ahead), F.lit(0)))
    whole = pieces.groupBy(*line, "run").agg(F.sum("j").alias("j")).select(*ROI, "dir", "i", "j", F.lit(1).cast("long").alias("c"))
    return done.unionByName(whole).groupBy(*ROI, "dir", "i", "j").agg(F.sum("c").alias("c"))


def zone_matrix(counts: DataFrame) -> DataFrame:
    """Connected zones of level i and size j: (ROI, i, j, c); zones beyond a face are contracted first."""
    done = counts.where("kind = 'zone'").select(*ROI, "i", "j", "c")
    face = counts.where("kind = 'face'").select(*ROI, "a", F.col("b").alias("own"))
    met = counts.where("kind = 'contact'").select(*ROI, "a", F.col("b").alias("other")).join(face, [*ROI, "a"]).where("own <> other")
    edges = cut(met.select(*ROI, F.greatest("own", "other").alias("a"), F.least("own", "other").alias("b")).distinct())
    nodes = counts.where("kind = 'open_zone'").select(*ROI, "i", F.col("j").alias("size"), F.col("a").alias("node"))
    if edges.isEmpty():
        whole = nodes.select(*ROI, "i", F.col("size").alias("j"))
    else:
        roots = contract(edges, ROI)
        whole = nodes.join(roots, [*ROI, "node"], "left").withColumn("root", F.coalesce("root", "node")).groupBy(*ROI, "i", "root").agg(F.sum("size").alias("j")).select(*ROI, "i", "j")
    return done.unionByName(whole.withColumn("c", F.lit(1).cast("long"))).groupBy(*ROI, "i", "j").agg(F.sum("c").alias("c"))


def maximal_correlation(matrix: DataFrame) -> DataFrame:
    """(ROI, MCC): maximal correlation coefficient of the symmetric pair counts, averaged over the directions that have pairs.

    The square root of the second largest eigenvalue of Q is the second largest
    absolute eigenvalue of the counts scaled by their margins; a single level gives 1.
    """
    keys = [*ROI, "dir"]

    def of(pdf):
        import numpy as np
        import pandas as pd
        levels, place = np.unique(np.r_[pdf["i"], pdf["j"]], return_inverse=True)
        m = np.zeros((len(levels),) * 2)
        m[place[:len(pdf)], place[len(pdf):]] = pdf["c"]
        side = np.sqrt(m.sum(1))
        value = 1.0 if len(levels) < 2 else float(np.sort(np.abs(np.linalg.eigvalsh(m / np.outer(side, side))))[-2])
        return pd.DataFrame([(*pdf[ROI].iloc[0], value)], columns=[*ROI, "mcc"])
    kinds = dict(matrix.dtypes)
    per = matrix.groupBy(*keys).applyInPandas(of, ", ".join(f"`{k}` {kinds[k]}" for k in ROI) + ", mcc double")       # at most levels squared cells
    return per.groupBy(*ROI).agg(F.avg("mcc").alias("MCC"))

"""Similarity join of documents' n-gram sets over an R-tree of group counts.

A set's n-grams are hashed into groups, and the counts of its groups are its point. The
summed minima of two points' coordinates bound the overlap of their sets, and the summed
minima with a node's upper corner bound the overlap with everything below the node; the
tree is bulk loaded (sort, tile, recurse) and descended by those bounds. Pairs that
survive are verified on the full sets, compared by 64-bit hashes.

How the tree is spread: linked sets of one size class differ in at most D n-grams, so of
D + 1 parts of the groups at least one has the same point in both, for every such pair.
The top level of the index is therefore the point of a part, and documents below one
point share a page. Sets of equal n-grams are one row from the start. Each page's rows
first meet a few of their own (one of ``HEADS`` orders each), which settles large groups
of copies; then pages whose rows are still in several components are joined: those of
at most ``PAGE`` rows by a tree each, larger ones by trees over blocks of ``RIGHT`` rows,
to which only rows outside the page's main component descend. Pages of the same rows
are joined once, larger ones of the same main component together. No pair is lost: a
page skips only what its components already hold.

Nothing but flags reaches the driver. Hot pages are counted before they are shuffled
and read in blocks.

Cases: documents without words have an empty set and no links; with fewer words than an
n-gram the words are one; very long texts have more parts, not longer ones; ties and
repeated rows are copies of one another; rows with a null doc_id take part and are named
by the smallest id they reach, if any; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import text_of, text_slices, written
from voxcohort.operators.components import contract

WORDS, PERCENT = 3, 90
GROUPS = 64            # coordinates of a point
FINE = 1 << 16         # groups of a part, whose counts name the part's point
WIDE = 1.25            # ratio of a size class
HEADS = 8              # orders by which pages choose the row that others meet first
PAGE = 256             # rows a page's tree is built over at once
LEFT, RIGHT = 256, 4096
LEAF = 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MOST = np.iinfo(np.uint16).max


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams of a text's words."""
    parts = (text or "").encode().translate(_LOWER).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    if len(h) < 2:
        return h
    n = max(len(h) - words + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out + h[k:k + n] + np.uint64(k + 1))
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


class Classes:
    """Size classes of a threshold, and how many parts each needs."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] * 100 // percent + 1, int(self.low[-1] * WIDE)))
        most = [(a + a * 100 // percent) * (100 - percent) // (100 + percent) for a in (x - 1 for x in self.low[1:])]
        self.parts = [d + 1 for d in most]

    def of(self, n: int) -> list[int]:
        """Classes under which a set of ``n`` must be found: its own, and the one below when that has sets small enough to link."""
        k = bisect_right(self.low, n) - 1
        return [k, k - 1] if k and (self.low[k] - 1) * 100 // self.percent >= n else [k]


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Counts of the hash groups of each set."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    at = row * GROUPS + (_mix(flat) % np.uint64(GROUPS)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=len(sets) * GROUPS), _MOST).astype("<u2").reshape(-1, GROUPS)


def part_keys(sets: list[np.ndarray], classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Names of all parts' points, one set after another, and how many each set has."""
    jobs = [(n, k) for n, s in enumerate(sets) for k in classes.of(len(s)) if classes.parts[k] > 1]      # one part: equal sets only
    count = np.zeros(len(sets), np.int64)
    if not jobs:
        return np.empty(0, np.int64), count
    which = np.array([n for n, _ in jobs])
    level = np.array([k for _, k in jobs], np.uint64)
    parts = np.array([classes.parts[k] for _, k in jobs])
    flat = np.concatenate([sets[n] for n in which])
    job = np.repeat(np.arange(len(jobs)), [len(sets[n]) for n in which])
    h = _mix(flat + _mix(level + np.uint64(1))[job])
    start = np.r_[0, np.cumsum(parts)]
    part = ((h >> np.uint64(32)) * parts.astype(np.uint64)[job] >> np.uint64(32)).astype(np.int64)
    weight = _mix(h % np.uint64(FINE) + np.uint64(FINE))
    low, high = (np.bincount(start[job] + part, weights=w.astype(float), minlength=start[-1]).astype(np.uint64)
                 for w in (weight & np.uint64(0xFFFFFFFF), weight >> np.uint64(32)))
    own = np.repeat(np.arange(len(jobs)), parts)
    place = _mix((level[own] << np.uint64(40)) + (np.arange(start[-1]) - start[own]).astype(np.uint64))
    np.add.at(count, which, parts)
    return _mix(low + _mix(high + place)).view(np.int64), count


class RTree:
    """Bulk-loaded tree over points: each level's upper corners, smallest sizes and largest slacks, ``LEAF`` children a node."""

    def __init__(self, pts: np.ndarray, sizes: np.ndarray):
        slack = sizes - pts.sum(1, dtype=np.int64)
        self.order = self._tiled(pts, sizes)
        self.levels = [(pts[self.order], sizes[self.order], slack[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            p, n, s = self.levels[-1]
            at = np.arange(0, len(p), LEAF)
            self.levels.append((np.maximum.reduceat(p, at), np.minimum.reduceat(n, at), np.maximum.reduceat(s, at)))

    @staticmethod
    def _tiled(pts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Order by size, then within slabs by the coordinate that varies most there."""
        order = np.argsort(sizes, kind="stable")
        slab = LEAF
        while slab * LEAF < len(order):
            slab *= LEAF
        while slab >= LEAF:
            for at in range(0, len(order), slab * LEAF):
                here = order[at:at + slab * LEAF]
                if len(here) > slab:
                    axis = int(np.argmax(pts[here].var(0)))
                    order[at:at + slab * LEAF] = here[np.argsort(pts[here, axis], kind="stable")]
            slab //= LEAF
        return order

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose overlap with a set may reach the threshold."""
        slack = size - int(point.sum(dtype=np.int64))
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            p, n, s = self.levels[depth]
            overlap = np.minimum(p[nodes], point).sum(1, dtype=np.int64) + np.minimum(s[nodes], slack)
            nodes = nodes[(100 + percent) * np.minimum(overlap, size) >= percent * (n[nodes] + size)]
            if depth:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return self.order[nodes]


def _points_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, GROUPS)


def _may_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    overlap = np.minimum(x, y).sum(1, dtype=np.int64) + np.minimum(nx - x.sum(1, dtype=np.int64), ny - y.sum(1, dtype=np.int64))
    return (100 + percent) * np.minimum(overlap, np.minimum(nx, ny)) >= percent * (nx + ny)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    inter = int((large[at] == small).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _sketched(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """rid, doc_id, th, n, digest, point and keys of every row; of equal sets only the first in a task has keys."""
    schema = "rid long, doc_id long, th long, n long, digest binary, point binary, keys array<long>"
    names = ["rid", "doc_id", "th", "n", "digest", "point", "keys"]

    def work(batches):
        classes, seen = Classes(percent), set()
        for batch in batches:
            for part in text_slices(batch, 3, 1 << 20):
                sets = [gram_set(t, words) for t in part.column(3).to_pylist()]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                full = []
                for n, (s, d) in enumerate(zip(sets, digests)):
                    if len(s) and d not in seen:
                        seen.add(d)
                        full.append(n)
                pts, keys = [None] * len(sets), [None] * len(sets)
                if full:
                    flat, count = part_keys([sets[n] for n in full], classes)
                    for n, k in zip(full, np.split(flat, np.cumsum(count)[:-1])):
                        keys[n] = k
                some = [n for n, s in enumerate(sets) if len(s)]
                if some:
                    for n, p in zip(some, points([sets[n] for n in some])):
                        pts[n] = p.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.array(pts, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("th"), "text")
    return rows.mapInArrow(work, schema)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rid and full set of the rows in ``wanted`` (rid, doc_id, th); repeated rows are collapsed before they are shuffled."""
    def work(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([gram_set(t, words).tobytes() for t in part.column(1).to_pylist()], pa.binary())],
                                                 ["rid", "grams"])
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("h"), "text").groupBy("d", "h").agg(F.first("text").alias("text"))
    met = texts.join(wanted.hint("merge"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")))
    return met.select("rid", "text").mapInArrow(work, "rid long, grams binary")


def _verified(pairs: DataFrame, pts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a > b) that the points let through and the full sets confirm."""
    def near(batches):
        for batch in batches:
            if batch.num_rows:
                c = [x.to_pylist() if n in (3, 5) else x.to_numpy() for n, x in enumerate(batch.columns)]
                keep = pa.array(_may_link(_points_of(c[3]), _points_of(c[5]), c[2], c[4], percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    def sure(batches):
        for batch in batches:
            keep = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                             for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    side = lambda df, x: df.toDF(x, *[f"{c}_{x}" for c in df.columns[1:]])
    some = pairs.join(side(pts, "a"), "a").join(side(pts, "b"), "b").select("a", "b", "n_a", "point_a", "n_b", "point_b").mapInArrow(near, "a long, b long")
    return some.join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "grams_a", "grams_b").mapInArrow(sure, "a long, b long")


def _pages(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(k, rid): pages of at least two different sets, one of each list of members; a set goes by the row that stands for its copies."""
    keys = rows.select("rid", F.explode("keys").alias("k"))
    shared = keys.groupBy("k").count().where("count > 1").select("k")
    found = keys.join(shared.hint("merge"), "k", "left_semi")           # one plan at every size
    sets = rows.select("rid", "digest").join(copies.select("digest", F.col("rid").alias("head")), "digest").select("rid", "head")
    members = written(found.join(sets, "rid").select("k", F.col("head").alias("rid")).distinct())
    alike = members.groupBy("k").agg(F.count("*").alias("n"), F.min("rid").alias("low"), F.max("rid").alias("high"), F.bit_xor(F.xxhash64("rid")).alias("all"),
                                     F.bit_xor(F.hash("rid")).alias("again")).where("n > 1").groupBy("n", "low", "high", "all", "again").agg(F.min("k").alias("k")).select("k")
    return members.join(alike, "k", "left_semi")


def _located(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with ``comp``, the smallest row that their verified links reach."""
    if roots is None:
        return rows.withColumn("comp", F.col("rid"))
    return rows.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of pages that hold several components, with the page's ``size``."""
    pages = rows.groupBy("k").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return rows.join(pages.select("k", "size"), "k")


def _heads(pages: DataFrame) -> DataFrame:
    """Pairs of a page's rows with the one that comes first in the page's order."""
    order = F.xxhash64("rid", F.pmod("k", F.lit(HEADS)))
    first = pages.groupBy("k").agg(F.min(F.struct(order.alias("o"), "rid")).alias("head")).select("k", F.col("head.rid").alias("head"))
    met = pages.join(first, "k").where("rid <> head")
    return met.select(F.greatest("rid", "head").alias("a"), F.least("rid", "head").alias("b")).distinct()


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list]:
    """Columns of each run of rows with equal first columns, across batches."""
    held, key = None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                if held:
                    yield held
                held, key = [[] for _ in range(width)], row[0]
            for c, v in zip(held, row):
                c.append(v)
    if held:
        yield held


def _within(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs between components that the tree of a small page lets through."""
    def work(batches):
        for _, rid, comp, n, point in _runs(batches, 5):
            pts, n = _points_of(point), np.array(n)
            tree, out = RTree(pts, n), []
            for i in range(len(rid)):
                out += [(max(rid[i], rid[j]), min(rid[i], rid[j])) for j in tree.search(pts[i], int(n[i]), percent).tolist() if j > i and comp[i] != comp[j]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], ["a", "b"])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("k", "rid", "comp", "n", "point").repartition(parts, "k").sortWithinPartitions("k").mapInArrow(work, "a long, b long").distinct()


def _between(rows: DataFrame, pts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components of large pages: rows outside a main component descend trees over blocks of all rows."""
    main = rows.groupBy("k", "comp").count().groupBy("k").agg(F.max(F.struct("count", "comp")).alias("main")).select("k", F.col("main.comp").alias("main"))
    rows = written(rows.join(main, "k").select(F.col("main").alias("k"), "rid", "comp").distinct())
    sizes = rows.groupBy("k").agg(F.count("*").alias("rows"), F.count(F.when(F.col("comp") != F.col("k"), 1)).alias("rest"))
    rows = rows.join(sizes, "k").join(pts, "rid").join(sets, "rid")
    lefts, rights = F.ceil(F.col("rest") / LEFT).cast("int"), F.ceil(F.col("rows") / RIGHT).cast("int")
    block = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    columns = ["k", "x", "y", "rid", "comp", "n", "point", "grams"]
    left = rows.where("comp <> k").withColumn("x", block(lefts)).withColumn("y", all_of(rights)).select(columns)
    right = rows.where("rest > 0").withColumn("y", block(rights)).withColumn("x", all_of(lefts)).select([F.col(c).alias(f"r{c}") for c in columns])

    def work(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(q):
            tree = RTree(_points_of(q["rpoint"]), q["rn"].to_numpy())
            sets = [np.frombuffer(x, np.uint64) for x in q["rgrams"]]
            comp, rid = q["rcomp"].tolist(), q["rrid"].tolist()
            for point, n, c, r, own in zip(_points_of(p["point"]), p["n"], p["comp"], p["rid"], p["grams"]):
                own, met = np.frombuffer(own, np.uint64), {c}
                for j in tree.search(point, int(n), percent).tolist():
                    if comp[j] not in met and linked(own, sets[j], percent):
                        met.add(comp[j])
                        out.append((max(r, rid[j]), min(r, rid[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return left.groupBy("k", "x", "y").cogroup(right.groupBy("rk", "rx", "ry")).applyInPandas(work, "a long, b long")


def _roots(edges: list[DataFrame]) -> DataFrame | None:
    links = reduce(DataFrame.union, edges)
    return None if links.isEmpty() else contract(links.distinct(), [])


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, page: int = PAGE) -> DataFrame:
    """One row per document: doc_id, n_shingles (its set's size) and component_id, the smallest doc_id its links reach."""
    rows = written(_sketched(docs, words, percent))
    copies = written(rows.where("n > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("head"))
                     .select("digest", "head", F.col("head.rid").alias("rid")))
    pages = written(_pages(rows, copies))
    wanted = written(rows.select("rid", "doc_id", "th", "n", "point").join(pages.select("rid").distinct(), "rid", "left_semi"))
    pts = wanted.select("rid", "n", "point")
    sets = written(_sets(docs, wanted.select("rid", "doc_id", "th"), words))

    first = written(_heads(pages))
    edges = [written(_verified(first, pts, sets, percent))]
    rest = written(_mixed(_located(pages, _roots(edges))))
    small = _within(rest.where(F.col("size") <= page).join(pts, "rid"), percent).join(first, ["a", "b"], "left_anti")
    edges.append(written(_verified(small, pts, sets, percent)))
    roots = _roots(edges)
    large = rest.where(F.col("size") > page).select("k", "rid")
    if not large.isEmpty():
        edges.append(written(_between(_mixed(_located(large, roots)).select("k", "rid", "comp"), pts, sets, percent)))
        roots = _roots(edges)

    named = _located(copies, roots)
    least = named.groupBy("comp").agg(F.min("head").alias("least")).select("comp", F.col("least.doc_id").alias("component_id"))
    full = rows.where("n > 0").join(named.join(least, "comp").select("digest", "component_id"), "digest").select("doc_id", "n", "component_id")
    return full.union(rows.where("n = 0").select("doc_id", "n", "doc_id")).toDF("doc_id", "n_shingles", "component_id")

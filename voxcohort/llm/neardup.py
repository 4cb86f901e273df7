"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full sets.

Every document becomes the set of its word shingles, a signature of MinHash values and
a digest of its words; documents of equal words collapse to one representative. Each
tree of the forest orders the representatives by another order of signature values;
rows that share a tree's first values form a region. Candidates are neighbours by
longest common prefix: every row with the first row of its regions, and all pairs of
small regions. A region too large for that is divided by more values of its order, as
deep as that region needs. Links already implied by confirmed ones are not looked at
again, and what a deep division may have parted is settled in blocks between
the components that still meet in one region: no region is capped.
A candidate is a link only if the full shingle sets reach the similarity.

With 20 trees of 3 values, a pair at similarity 0.8 shares no region with probability
6e-7; the signature filter drops it with probability 3e-7. Shingles are compared by
64-bit hashes. Nothing but flags reaches the driver. Copies and hot regions cost one
row per task before they are shuffled; groups handed to Python hold at most a block.

Cases: documents without words have an empty set and no links; with fewer words than
a shingle the words are one shingle; repeated rows are copies of one another; rows
with a null doc_id take part and are named by the smallest id they reach, if any;
other columns are ignored, and carried by ``deduplicated``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import text_of, text_slices, written
from voxcohort.operators.components import contract

WORDS, SIMILARITY = 5, 0.8
VALUES, TREES, DEPTH = 64, 20, 3
DEEPER = (6, 12, 24, 48)
SMALL = 24                     # regions up to this size compare all pairs
NEAR = 0.28                    # signatures may agree on this much less than the similarity: 34 of 64 at 0.8
LEFT, RIGHT = 256, 4096        # rows in a block of the last comparison
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1 << 62, size=VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1 << 63, size=VALUES, dtype=np.uint64)
_ORDERS = [np.r_[[(DEPTH * t + k) % VALUES for k in range(DEPTH)],
                 [p for p in np.random.default_rng(t).permutation(VALUES) if p not in {(DEPTH * t + k) % VALUES for k in range(DEPTH)}]]
           for t in range(TREES)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> tuple[np.ndarray, bytes]:
    """Sorted hashes of the distinct shingles of a text, and a digest of its words."""
    parts = (text or "").encode().translate(_LOWER).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    digest = xxhash.xxh3_128_digest(b" ".join(parts))
    if not len(h):
        return h, digest
    n = max(len(h) - words + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = _mix(out + h[k:k + n])
    return np.unique(out), digest


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, one row each."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), VALUES), np.uint32)
    for p in range(VALUES):
        out[:, p] = np.minimum.reduceat(((flat * _A[p] + _B[p]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _keys(sig: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Hash of the first ``depth`` values in a tree's order."""
    h = np.full(len(sig), tree + 1, np.uint64)
    for p in _ORDERS[tree][:depth]:
        h = _mix(h + sig[:, p].astype(np.uint64))
    return h.view(np.int64)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """rid, doc_id, th, key, n, sig, regions of every row."""
    schema = "rid long, doc_id long, th long, key binary, n long, sig binary, regions array<long>"

    def work(batches):
        for batch in batches:
            for part in text_slices(batch, 3, 1 << 20):
                sets, digests = zip(*[shingle_set(t, words) for t in part.column(3).to_pylist()])
                full = [n for n, s in enumerate(sets) if len(s)]
                sigs, regions = [None] * len(sets), [None] * len(sets)
                if full:
                    sig = _signatures([sets[n] for n in full])
                    keys = np.stack([_keys(sig, t, DEPTH) for t in range(TREES)], 1)
                    for k, n in enumerate(full):
                        sigs[n], regions[n] = sig[k].tobytes(), keys[k]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(sigs, pa.binary()), pa.array(regions, pa.list_(pa.int64()))], schema.replace("array<long>", "x").replace(",", "").split()[::2])
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("th"), "text")
    return rows.mapInArrow(work, schema)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rid and full set (as bytes) of the representatives in ``wanted`` (rid, doc_id, th)."""
    def work(batches):
        for batch in batches:
            for part in text_slices(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, words)[0].tobytes() for t in part.column(1).to_pylist()], pa.binary())],
                                                 ["rid", "shingles"])
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of()).alias("h"), "text")
    rows = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("rid", "text")
    return rows.mapInArrow(work, "rid long, shingles binary")


def _near(pairs: DataFrame, sigs: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a > b) whose signatures agree on nearly the similarity or more."""
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                sig = [np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, VALUES) for c in (batch.column(2), batch.column(3))]
                keep = pa.array((sig[0] == sig[1]).mean(1) >= similarity - NEAR)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    side = lambda x: sigs.select(F.col("rid").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return both.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    inter = int((large[at] == small).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    def work(batches):
        for batch in batches:
            keep = pa.array([_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                             for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("shingles").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(work, "a long, b long")


def _located(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with ``comp``, the smallest row their confirmed links reach."""
    if roots is None:
        return rows.withColumn("comp", F.col("rid"))
    return rows.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("root", "rid")).drop("root")


def _mixed(rows: DataFrame, key: str = "k") -> DataFrame:
    """Rows of regions that hold several components, with the region's size ``size`` and first row ``head``."""
    regions = rows.groupBy(key).agg(F.count("*").alias("size"), F.min(F.struct("rid", "comp")).alias("head"),
                                    F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").drop("low", "high")
    return rows.join(regions, key)


def _stars(rows: DataFrame) -> DataFrame:
    return rows.where("comp <> head.comp").select(F.col("rid").alias("a"), F.col("head.rid").alias("b"))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of different components within regions of at most SMALL rows."""
    small = rows.where(F.col("size") <= SMALL).select("k", "rid", "comp")
    other = small.select("k", F.col("rid").alias("b"), F.col("comp").alias("other"))
    return small.join(other, "k").where("rid > b AND comp <> other").select(F.col("rid").alias("a"), "b")


def _deeper(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """rid, comp and region keys of growing depth, for rows (rid, comp, tree) of large regions."""
    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, comp, tree, sig = batch.column(0), batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            sig = np.frombuffer(b"".join(sig), np.uint32).reshape(-1, VALUES)
            out = np.empty((len(sig), len(DEEPER)), np.int64)
            for t in np.unique(tree):
                here = tree == t
                for k, d in enumerate(DEEPER):
                    out[here, k] = _keys(sig[here], int(t), d)
            yield pa.RecordBatch.from_arrays([rid, comp, *[pa.array(c) for c in out.T]], ["rid", "comp", *[f"k{d}" for d in DEEPER]])
    schema = "rid long, comp long, " + ", ".join(f"k{d} long" for d in DEEPER)
    return rows.join(sigs.select("rid", "sig"), "rid").select("rid", "comp", "tree", "sig").mapInArrow(work, schema)


def _between(rows: DataFrame, sigs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links across the components that meet in a large region, found block by block.

    Rows outside a region's main component meet all its rows; within a block a near
    signature is confirmed on the full sets, and one link to a component is enough.
    """
    rows = rows.join(sigs.select("rid", "sig"), "rid").join(sets, "rid")
    main = rows.groupBy("k", "comp").count().groupBy("k").agg(F.max(F.struct("count", "comp")).alias("main"), F.sum("count").alias("rows"))
    rows = rows.join(main, "k")
    rest = F.col("rows") - F.col("main.count")
    lefts, rights = F.ceil(rest / LEFT).cast("int"), F.ceil(F.col("rows") / RIGHT).cast("int")
    block = lambda n: F.pmod(F.xxhash64("rid"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.where("comp <> main.comp").withColumn("x", block(lefts)).withColumn("y", all_of(rights)).select("k", "x", "y", "rid", "comp", "sig", "shingles")
    right = rows.withColumn("y", block(rights)).withColumn("x", all_of(lefts)).select(
        *[F.col(c).alias(f"r{c}") for c in ("k", "x", "y", "rid", "comp", "sig", "shingles")])
    percent = round(100 * similarity)

    def work(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(q):
            sig = [np.frombuffer(b"".join(d), np.uint32).reshape(-1, VALUES) for d in (p["sig"], q["rsig"])]
            sets = [np.frombuffer(x, np.uint64) for x in q["rshingles"]]
            comp, rid = q["rcomp"].to_numpy(), q["rrid"].to_numpy()
            for s, c, r, own in zip(sig[0], p["comp"], p["rid"], map(lambda x: np.frombuffer(x, np.uint64), p["shingles"])):
                met = {c}
                for n in np.flatnonzero((sig[1] == s).mean(1) >= similarity - NEAR):
                    if comp[n] not in met and _linked(own, sets[n], percent):
                        met.add(comp[n])
                        out.append((max(r, rid[n]), min(r, rid[n])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return left.groupBy("k", "x", "y").cogroup(right.groupBy("rk", "rx", "ry")).applyInPandas(work, "a long, b long")


def _roots(edges: list[DataFrame]) -> DataFrame | None:
    links = reduce(DataFrame.union, edges)
    return None if links.isEmpty() else contract(links.distinct(), [])


def classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """rid, doc_id, th, n_shingles, component_id and ``first`` (one row per component) of every row."""
    percent = round(100 * similarity)
    rows = written(_sketched(docs, words))
    copies = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("head"))
    reps = written(rows.where("n > 0").select("rid", "doc_id", "th", "sig", "regions")
                   .join(copies.select(F.col("head.rid").alias("rid")), "rid", "left_semi"))
    sigs = reps.select("rid", "sig")
    regions = reps.select("rid", F.posexplode("regions").alias("tree", "k"))
    shared = written(regions.join(regions.groupBy("k").count().where("count > 1").drop("count"), "k", "left_semi"))
    wanted = reps.select("rid", "doc_id", "th").join(shared.select("rid").distinct(), "rid", "left_semi")
    sets = written(_sets(docs, wanted, words))

    first = written(_near(_stars(_mixed(_located(shared, None))), sigs, similarity))
    edges = [written(_confirmed(first, sets, percent))]

    rest = written(_mixed(_located(shared, _roots(edges))).select("k", "tree", "rid", "comp", "size", "head"))
    large = rest.where(F.col("size") > SMALL)
    # regions of several trees with one first row have much the same rows: a row is divided in the first of them, and what this parts meets below
    once = large.groupBy(F.col("head.rid").alias("first"), "rid").agg(F.min(F.struct("tree", "comp")).alias("at"))
    deep = written(_deeper(once.select("rid", "at.comp", "at.tree"), sigs))
    here = written(_mixed(deep.select(F.explode(F.array(*[f"k{d}" for d in DEEPER])).alias("k"), "rid", "comp")))      # names of regions differ between depths
    found = [_all_pairs(rest.drop("tree").unionByName(here)), _stars(here)]
    second = written(_near(reduce(DataFrame.union, found).distinct(), sigs, similarity).join(first, ["a", "b"], "left_anti"))
    edges.append(written(_confirmed(second, sets, percent)))

    roots = _roots(edges)
    # here they are taken as one region, with the rows of all trees
    again = _mixed(_located(large.select("k", "rid"), roots)).select(F.col("head.rid").alias("k"), "rid", "comp").distinct()
    last = written(_between(again, sigs, sets, similarity))
    if not last.isEmpty():
        edges.append(last)
        roots = _roots(edges)

    named = _located(copies.select("key", "head", F.col("head.rid").alias("rid")), roots)
    heads = named.groupBy("comp").agg(F.min("head").alias("main"))
    named = named.join(heads, "comp").select("key", F.col("main.doc_id").alias("component_id"), F.col("main.rid").alias("main"))
    full = rows.where("n > 0").join(named, "key").select("rid", "doc_id", "th", "n", "component_id", (F.col("rid") == F.col("main")).alias("first"))
    empty = rows.where("n = 0").select("rid", "doc_id", "th", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return full.union(empty).withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: set size, smallest doc_id its links reach, and whether it is that."""
    kept: Column = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return classes(docs, words, similarity).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicated(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near duplicates."""
    found = written(classes(docs, words, similarity))
    flags = written(found.groupBy("doc_id", "th").agg(F.max("first").alias("__keep"), F.count("*").alias("__rows"))
                    .where("NOT __keep OR __rows > 1").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "__keep", "__rows"))
    text = docs.withColumn("__text", F.xxhash64(text_of()))
    joined = text.join(flags, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__th")), "left") \
        .where(F.coalesce("__keep", F.lit(True)))
    if not flags.where("__keep AND __rows > 1").isEmpty():      # rows that are the same in id and text
        alone = F.coalesce("__rows", F.lit(1)) == 1
        joined = joined.where(alone).union(joined.where(~alone).dropDuplicates(["__id", "__th"]))
    return joined.select(docs.columns)

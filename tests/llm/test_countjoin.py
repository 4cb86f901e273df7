"""The n-gram join against all pairs on small tables."""

import random
import re

import numpy as np
import pytest

from voxcohort.llm import countjoin

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, k long, rid long, comp long, n long, sid string, point string, a long, b long, size int"


def gram_sets(texts, words):
    out = []
    for t in texts:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        out.append({tuple(w[i:i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set())
    return out


def brute(ids, texts, words=3, percent=90):
    sets = gram_sets(texts, words)
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, (d, s) in enumerate(zip(ids, sets))), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10_000)}"
        out.append(" ".join(words))
    return out


def test_join_equals_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rng = random.Random(4)
    texts = [r.text for r in rows]
    for length in (6, 9, 10, 14, 19, 25, 40, 90, 300, 2000):          # around the borders of classes and of the threshold
        base = [f"v{rng.randrange(300)}" for _ in range(length)]
        for edits in (1, 2, 3, 5):
            texts += variants(rng, base, 6, edits) if edits * 10 <= length else [" ".join(base[:-1]), " ".join(base + ["more"])]
    ids = list(range(1000, 1000 + len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    expected = brute(ids, texts)
    assert len({c for _, _, c in expected}) < len(ids) - 20
    assert rows_of(countjoin.joined(docs)) == expected
    assert rows_of(countjoin.joined(docs, page=3)) == expected
    assert rows_of(countjoin.joined(docs, words=2, percent=70)) == brute(ids, texts, 2, 70)


def test_large_group_of_near_copies_keeps_every_link(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(130)]
    texts = variants(rng, base, 150, 2) + variants(rng, base, 60, 4) + [" ".join(base)] * 20
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert rows_of(countjoin.joined(docs, page=16)) == brute(ids, texts)


def test_tree_finds_all_that_the_bound_lets_through():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(1 << 62, size=rng.integers(1, 400), dtype=np.uint64)) for _ in range(700)]
    sets += [np.unique(np.r_[s[: int(len(s) * .93)], rng.integers(1 << 62, size=2, dtype=np.uint64)]) for s in sets[:300]]
    pts, sizes = countjoin.points(sets), np.array(list(map(len, sets)))
    tree = countjoin.RTree(pts, sizes)
    seen = 0
    for i in range(len(sets)):
        n = np.full(len(sets), sizes[i])
        want = np.flatnonzero(countjoin._may_link(np.broadcast_to(pts[i], pts.shape), pts, n, sizes, 90))
        got = np.sort(tree.search(pts[i], int(sizes[i]), 90))
        assert (got == want).all()
        seen += len(got)
    assert seen < 0.1 * len(sets) ** 2


def test_every_linked_pair_shares_a_part():
    rng, classes = np.random.default_rng(2), countjoin.Classes(90)
    for n in [*range(9, 60), 100, 333, 1000, 5000]:
        for _ in range(6):
            x = np.unique(rng.integers(1 << 62, size=n, dtype=np.uint64))
            most = n * 100 // 90 - n
            drop = int(rng.integers(0, n // 19 + 1))
            y = np.unique(np.r_[x[drop:], rng.integers(1 << 62, size=max(0, most - 2 * drop), dtype=np.uint64)])
            if countjoin.linked(x, y, 90) and len(x) + len(y) and not np.array_equal(x, y):
                flat, count = countjoin.part_keys([x, y], classes)
                assert set(flat[:count[0]]) & set(flat[count[0]:])


def test_join_on_awkward_and_empty_tables(spark):
    long = " ".join(f"word{i % 977} {i}" for i in range(40_000))
    texts = [None, "", " \t\n", "One two three", "one TWO three", "one two", "one two", long, long + " end", "x", "x", None]
    ids = [1, 2, 3, 4, 5, 6, 6, 7, None, None, None, None]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, "s", "p", 5, 6, 7) for i, t in zip(ids, texts)], EXTRA)
    assert rows_of(countjoin.joined(docs)) == brute(ids, texts)
    none = countjoin.joined(docs.where("doc_id > 100"))
    assert none.collect() == [] and none.columns == ["doc_id", "n_shingles", "component_id"]

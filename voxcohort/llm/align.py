"""Alignment of two tokenizers' tokens over the bytes of every document.

Both tokenizers read a space and the text. Offsets where a token of each ends cut the
document into groups; two tokens are linked where their byte ranges overlap. What lies
in a range of bytes is a fragment: an open prefix up to its first common end, closed
groups (their digest text, counts and links), and an open suffix behind its last.
Fragments compose associatively: the left suffix and the right prefix close one group.
A document beyond ``chunk`` bytes becomes one fragment per byte range, and a tree of
grouped reductions, ``FAN`` neighbours at a time, composes them across tasks.

Documents of a slice are aligned together, in flat arrays of token ends.

Counts of linked id pairs are summed per task, then by Spark. Every document's pairs
meet them in slices: a slice of the count table (at most ``SLICE`` pairs) is sent to
blocks of documents that are at least four times its size, and documents stream past it.

Cases: null and empty texts, and texts whose token bytes differ from a space and the
text (such as those with U+2581), have no tokens: zeros and an empty digest; very long
texts are tokenized by one task and aligned in chunks; ties for an id's highest count
all count as best; repeated rows and null ids are documents of their own; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxcohort.llm import packing
from voxcohort.llm.common import text_slices, written

CHUNK = 1 << 16        # bytes of a fragment of a long document
FAN = 16               # neighbouring fragments composed by one group
SLICE = 1 << 20        # id pairs of a slice of the count table
PAIRS = 1 << 20        # id pairs a task sums before it passes them on
MIX = 1_000_003        # deals id pairs to slices
_SPACE = "▁"
_LOADED: dict[tuple[str, str], Tokens] = {}


def packed(values: np.ndarray) -> bytes:
    """Unsigned values in the narrowest width that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0)))).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def group_text(a: Iterable[int], b: Iterable[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


@dataclass
class Fragment:
    """What a range of bytes holds; ``prefix`` has all its tokens while no common end is known."""

    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    bounded: bool = False
    groups: int = 0
    body: str = ""
    pairs: dict[tuple[int, int], int] = field(default_factory=dict)


class Tokens:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        self.a = packing.loaded(a_path).fast
        self.a_bytes = [b""] * self.a.n_vocab
        for i, name in packing.loaded(a_path).names.items():
            self.a_bytes[i] = name
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, names)), np.int64) for names in (self.a_bytes, self.b_bytes))
        self.marked = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in ",|;"]

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both tokenizers; None for texts without tokens."""
        out, theirs = [], self.b.encode([t or "" for t in texts], num_threads=1)
        for t, b in zip(texts, theirs):
            if not t:
                out.append(None)
                continue
            text, raw = " " + t, b" " + t.encode()
            a = self.a.encode_to_numpy(text, disallowed_special=())
            same = self.a_size[a].sum() == len(raw) and b"".join(map(self.b_bytes.__getitem__, b)) == raw        # byte-level tokens spell what they cover
            out.append((a.astype(np.int64), np.array(b, np.int64)) if same else None)
        return out

    def flat(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, bytes, int, bytes, bytes, bytes]]:
        """n_groups, n_links, digest and histogram of the links of whole documents, aligned together."""
        a, b = (np.concatenate(side) for side in zip(*pairs))
        ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        stops = ends[0][np.cumsum([len(x) for x, _ in pairs]) - 1]
        place = np.minimum(np.searchsorted(ends[1], ends[0]), len(b) - 1)
        common = ends[0][ends[1][place] == ends[0]]
        every = np.sort(np.concatenate(ends), kind="stable")        # two sorted runs
        every = every[np.r_[True, every[1:] != every[:-1]]]
        doc = np.searchsorted(stops, every)
        width = len(self.b_bytes)
        code = a[np.searchsorted(ends[0], every)] * width + b[np.searchsorted(ends[1], every)]
        span = len(self.a_bytes) * width
        found, times = np.unique(doc * span + code, return_counts=True)
        links, groups = (np.bincount(x, minlength=len(pairs)) for x in (doc, np.searchsorted(stops, common)))
        # every group's A ids, then its B ids, each with the mark behind it
        key = np.concatenate([2 * np.searchsorted(common, ends[0]), 2 * np.searchsorted(common, ends[1]) + 1])
        order = np.argsort(key, kind="stable")
        key = key[order]
        last = np.r_[key[1:] != key[:-1], True]
        text = list(map(self.marked.__getitem__, (np.concatenate([a, b])[order] * 3 + np.where(last, 1 + key % 2, 0)).tolist()))
        size = np.cumsum([0, *(len(x) + len(y) for x, y in pairs)]).tolist()
        cut = np.searchsorted(found, np.arange(len(pairs) + 1) * span).tolist()
        out = []
        for n in range(len(pairs)):
            own = found[cut[n]:cut[n + 1]] - n * span
            body = hashlib.sha256("".join(text[size[n]:size[n + 1]])[:-1].encode()).hexdigest().encode()
            out.append((int(groups[n]), int(links[n]), body, len(own), packed(own // width), packed(own % width), packed(times[cut[n]:cut[n + 1]])))
        return out

    def closed(self, a: list[int], b: list[int]) -> tuple[list[tuple[list[int], list[int]]], list[tuple[int, int]], bool]:
        """Groups and links of tokens that start together, and whether they end together."""
        groups, links, la, lb = [], [], self.a_bytes, self.b_bytes
        i = j = i0 = j0 = 0
        left = len(la[a[0]]) if a else 0
        right = len(lb[b[0]]) if b else 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            if left == right:
                i, j = i + 1, j + 1
                groups.append((a[i0:i], b[j0:j]))
                i0, j0 = i, j
                left = len(la[a[i]]) if i < len(a) else 0
                right = len(lb[b[j]]) if j < len(b) else 0
            elif left < right:
                i, right = i + 1, right - left
                left = len(la[a[i]]) if i < len(a) else 0
            else:
                j, left = j + 1, left - right
                right = len(lb[b[j]]) if j < len(b) else 0
        return groups, links, i0 == len(a) and j0 == len(b)

    def fragments(self, a_ids: np.ndarray, b_ids: np.ndarray, chunk: int) -> list[Fragment]:
        """A document's tokens cut by the bytes at which they end."""
        ends = [np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])]
        common = np.intersect1d(*ends)
        out = []
        for k in range(-(-int(ends[0][-1]) // chunk)):
            here = [slice(*np.searchsorted(e, (k * chunk, (k + 1) * chunk), side="right")) for e in ends]
            stops = common[slice(*np.searchsorted(common, (k * chunk, (k + 1) * chunk), side="right"))]
            ids, at = (a_ids[here[0]], b_ids[here[1]]), [ends[n][here[n]] for n in (0, 1)]
            if not len(stops):
                out.append(Fragment(prefix=(ids[0].tolist(), ids[1].tolist())))
                continue
            first, last = ([int(np.searchsorted(e, s, side="right")) for e in at] for s in (stops[0], stops[-1]))
            closed = [ids[n][first[n]:last[n]].tolist() for n in (0, 1)]
            groups, links, _ = self.closed(*closed)
            pairs: dict[tuple[int, int], int] = {}
            for link in links:
                pairs[link] = pairs.get(link, 0) + 1
            out.append(Fragment((ids[0][:first[0]].tolist(), ids[1][:first[1]].tolist()), (ids[0][last[0]:].tolist(), ids[1][last[1]:].tolist()),
                                True, len(groups), ";".join(group_text(*g) for g in groups), pairs))
        return out

    def compose(self, left: Fragment, right: Fragment) -> Fragment:
        """The fragment of two neighbouring ranges."""
        joined = lambda x, y: (x[0] + y[0], x[1] + y[1])
        if not right.bounded:
            if left.bounded:
                return Fragment(left.prefix, joined(left.suffix, right.prefix), True, left.groups, left.body, left.pairs)
            return Fragment(joined(left.prefix, right.prefix))
        if not left.bounded:
            return Fragment(joined(left.prefix, right.prefix), right.suffix, True, right.groups, right.body, right.pairs)
        a, b = joined(left.suffix, right.prefix)
        pairs = dict(left.pairs)
        for link in self.closed(a, b)[1]:
            pairs[link] = pairs.get(link, 0) + 1
        for link, n in right.pairs.items():
            pairs[link] = pairs.get(link, 0) + n
        body = ";".join(x for x in (left.body, group_text(a, b), right.body) if x)
        return Fragment(left.prefix, right.suffix, True, left.groups + 1 + right.groups, body, pairs)

    def document(self, whole: Fragment) -> Fragment:
        """A whole document's fragment, with its first group closed."""
        return self.compose(Fragment(bounded=True), whole)


def loaded(a_path: str, b_path: str) -> Tokens:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Tokens(a_path, b_path)
    return _LOADED[a_path, b_path]


_ROW = "rid long, doc_id long, part long, parts long, n_a long, n_b long, n_groups long, n_links long, body binary, links long, a binary, b binary, times binary, edge binary"
_COLUMNS = _ROW.replace(",", "").split()[::2]
_TYPES = [pa.binary() if t == "binary" else pa.int64() for t in _ROW.replace(",", "").split()[1::2]]


def _histogram(codes: np.ndarray, times: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    return len(codes), packed(codes >> 32), packed(codes & 0xFFFFFFFF), packed(times)


def _fragment_row(x: Fragment) -> tuple:
    """links, a, b, times and the open edges of a fragment."""
    links = sorted(x.pairs)
    codes = np.array([p << 32 | q for p, q in links], np.int64)
    edge = json.dumps([x.prefix, x.suffix, x.bounded]).encode()
    return *_histogram(codes, np.array([x.pairs[k] for k in links], np.int64)), edge


def _fragment(row) -> Fragment:
    prefix, suffix, bounded = json.loads(bytes(row.edge))
    a, b, times = (unpacked(bytes(d), row.links).tolist() for d in (row.a, row.b, row.times))
    return Fragment(tuple(prefix), tuple(suffix), bounded, row.n_groups, bytes(row.body).decode(), dict(zip(zip(a, b), times)))


def _document_rows(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """A row per document, or one per fragment of a document beyond ``chunk`` bytes."""
    def rows(tokens, rids, ids, texts):
        found, short = tokens.encoded(texts), []
        for rid, doc, pair in zip(rids, ids, found):
            if pair is None:
                yield rid, doc, 0, 1, 0, 0, 0, 0, None, 0, b"", b"", b"", None
            elif tokens.a_size[pair[0]].sum() <= chunk:
                short.append((rid, doc, pair))
            else:
                parts = tokens.fragments(*pair, chunk)
                for k, x in enumerate(parts):
                    yield rid, doc, k, len(parts), 0 if k else len(pair[0]), 0 if k else len(pair[1]), x.groups, 0, x.body.encode(), *_fragment_row(x)
        if short:
            for (rid, doc, (a, b)), (groups, links, body, *histogram) in zip(short, tokens.flat([p for _, _, p in short])):
                yield rid, doc, 0, 1, len(a), len(b), groups, links, body, *histogram, None

    def work(batches):
        tokens = loaded(a_path, b_path)
        for batch in batches:
            for part in text_slices(batch, 2, 1 << 20):
                out = list(rows(tokens, *(c.to_pylist() for c in part.columns)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _COLUMNS)
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text").mapInArrow(work, _ROW)


def _composed(parts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Whole documents from their fragments, level by level of the tree."""
    import pandas as pd

    def level(last: bool):
        def work(group):
            tokens, rows = loaded(a_path, b_path), list(group.sort_values("part").itertuples())
            whole = _fragment(rows[0])
            for r in rows[1:]:
                whole = tokens.compose(whole, _fragment(r))
            first, n_a, n_b = rows[0], sum(r.n_a for r in rows), sum(r.n_b for r in rows)
            body = whole.body.encode()
            if last:
                whole = tokens.document(whole)
                body = hashlib.sha256(whole.body.encode()).hexdigest().encode()
            row = _fragment_row(whole)
            return pd.DataFrame([(first.rid, first.doc_id, first.part // FAN, -(-first.parts // FAN), n_a, n_b, whole.groups,
                                  sum(whole.pairs.values()), body, *row[:-1], None if last else row[-1])],
                                columns=_COLUMNS).astype({"doc_id": "Int64"})
        return work

    most = parts.agg(F.max("parts")).first()[0] or 0
    while most > 1:
        last = most <= FAN
        parts = written(parts.groupBy("rid", F.floor(F.col("part") / FAN)).applyInPandas(level(last), _ROW))
        most = -(-most // FAN)
    return parts


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """A row per document: token, group and link counts, digest (``body``), and its linked id pairs with how often each occurs."""
    rows = written(_document_rows(docs, a_path, b_path, chunk))
    whole = _composed(rows.where("parts > 1"), a_path, b_path)
    return rows.where("parts = 1").union(whole)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents hold an id pair linked, and whether that is its A id's highest count."""
    schema = "a long, b long, docs long"

    def work(batches):
        codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def batch_of(c, n):
            return pa.RecordBatch.from_arrays([pa.array(c >> 32), pa.array(c & 0xFFFFFFFF), pa.array(n)], ["a", "b", "docs"])
        for batch in batches:
            found = [(unpacked(a, n) << 32) | unpacked(b, n) for n, a, b in zip(*(c.to_pylist() for c in batch.columns))]
            if not found:
                continue
            here, n = np.unique(np.concatenate(found), return_counts=True)
            both, place = np.unique(np.concatenate([codes, here]), return_inverse=True)
            codes, counts = both, np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            if len(codes) > PAIRS:
                yield batch_of(codes, counts)
                codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        yield batch_of(codes, counts)
    sums = rows.select("links", "a", "b").mapInArrow(work, schema).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    return sums.withColumn("best", F.col("docs") == F.max("docs").over(W.partitionBy("a")))


def _slices(counts: DataFrame, slices: int) -> DataFrame:
    """One row per slice of the count table: sorted pairs, counts and best flags, packed."""
    import pandas as pd

    def work(g):
        g = g.assign(code=g["a"].to_numpy() << 32 | g["b"].to_numpy()).sort_values("code")
        return pd.DataFrame([(g["slice"].iloc[0], len(g), g["code"].to_numpy().tobytes(), packed(g["docs"].to_numpy()), packed(g["best"].to_numpy().astype(int)))],
                            columns=["slice", "links", "code", "docs", "best"])
    part = F.pmod(F.col("a") * MIX + F.col("b"), F.lit(slices)).cast("int").alias("slice")
    return counts.select("a", "b", "docs", "best", part).groupBy("slice").applyInPandas(work, "slice int, links long, code binary, docs binary, best binary")


def _sliced(rows: DataFrame, slices: int, blocks: int) -> DataFrame:
    """Documents' pairs, a row for every slice they have pairs in: the columns of the table's rows, and ``times``."""
    names = ["slice", "block", "rid", "links", "code", "docs", "best", "times"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]

    def work(batches):
        for batch in batches:
            out = []
            for block, rid, n, a, b, times in zip(*(c.to_pylist() for c in batch.columns)):
                if slices == 1:
                    out.append((0, block, rid, n, a, b, None, times))
                    continue
                a, b, times = unpacked(a, n), unpacked(b, n), unpacked(times, n)
                place = (a * MIX + b) % slices
                for k in np.unique(place):
                    own = place == k
                    out.append((int(k), block, rid, int(own.sum()), packed(a[own]), packed(b[own]), None, packed(times[own])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], names)
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias("block")
    return rows.where("links > 0").select(block, "rid", "links", "a", "b", "times").mapInArrow(
        work, "slice int, block int, rid long, links long, code binary, docs binary, best binary, times binary")


def link_scores(rows: DataFrame, counts: DataFrame, slice_pairs: int = SLICE) -> DataFrame:
    """(rid, n_best, count_sum): a document's links that are best for their A id, and the sum of its links' counts."""
    pairs, links = counts.count(), rows.agg(F.sum("links")).first()[0] or 0
    slices = max(1, -(-pairs // slice_pairs))
    blocks = max(1, links // max(1, 4 * pairs))
    table = _slices(counts, slices).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "slice", "block", F.lit(None).cast("long").alias("rid"), "links", "code", "docs", "best", F.lit(None).cast("binary").alias("times"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = table.union(_sliced(rows, slices, blocks)).repartition(n, "slice", "block").sortWithinPartitions("slice", "block", F.col("rid").asc_nulls_first())
    return met.mapInArrow(_looked_up, "rid long, n_best long, count_sum long").groupBy("rid").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def _looked_up(batches):
    code = docs = best = None
    for batch in batches:
        out = []
        for _, _, rid, n, x, y, flags, times in zip(*(c.to_pylist() for c in batch.columns)):
            if rid is None:
                code, docs, best = np.frombuffer(x, np.int64), unpacked(y, n), unpacked(flags, n)
                continue
            own = (unpacked(x, n) << 32) | unpacked(y, n)
            at = np.minimum(np.searchsorted(code, own), len(code) - 1)
            weight = unpacked(times, n) * (code[at] == own)
            out.append((rid, int((weight * best[at]).sum()), int((weight * docs[at]).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))], ["rid", "n_best", "count_sum"])


def alignment(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, slice_pairs: int = SLICE) -> DataFrame:
    """One row per document with its counts, digest and link scores."""
    rows = aligned(docs, a_path, b_path, chunk)
    counts = written(pair_counts(rows))
    scores = link_scores(rows, counts, slice_pairs)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce(F.col("body").cast("string"), F.lit("")).alias("groups_sha256")) \
        .join(scores, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

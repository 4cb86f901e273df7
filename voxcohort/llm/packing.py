"""Best-fit packing of tokenized documents after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. How many pieces each length
has is all that packing needs, so the driver works on a histogram of at most
``capacity`` rows whatever the corpus: the reduction fixes a piece with the partner
that provably dominates every other set holding it (an exact filler; the largest
single partner where no two fit; the largest where no three fit and no pair of
pieces beats it), until nothing more is dominated; best fit, longest first, packs the
rest. The result is a list of patterns, each with the number of sequences that have
it. A piece finds its place by its rank among the pieces of its length; ranks come
from windows over bounded, salted groups of a length and their offsets.

Cases: null or empty text is the end id alone; repeated rows and null ids are packed
as documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import cached_property

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxcohort.llm.bpe import byte_symbols
from voxcohort.llm.common import text_slices, written

CAPACITY = 2048
END = 0              # id behind every document
GROUP = 50_000       # pieces ranked in one window
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"      # fixed value of the vocabulary file
_LOADED: dict[str, ByteEncoder] = {}


class ByteEncoder:
    """Ids of a byte-level vocabulary file, as the tokenizers library gives them.

    The ids of merged pairs follow the order of the merges, so they serve as ranks for
    the faster tiktoken. Texts that hold a special token go to the library itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        byte = {s: b for b, s in enumerate(byte_symbols())}
        ranks = {bytes([byte[c] for c in token]): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.names = {i: name for name, i in ranks.items()}
        self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def loaded(path: str) -> ByteEncoder:
    if path not in _LOADED:
        _LOADED[path] = ByteEncoder(path)
    return _LOADED[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: the remainder first, then full ones."""
    end = END.to_bytes(4, "little")

    def work(batches):
        encoder = loaded(path)
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.encode(text) + end
                    n = len(ids) // 4
                    cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(work, _PIECES)


Pattern = tuple[tuple[tuple[int, int], ...], int]      # ((length, how many), ...), sequences


def dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sets that dominate all others holding their longest piece, and what is left."""
    left, fixed, changed = {k: n for k, n in counts.items() if n}, [], True

    def fix(pattern, n):
        fixed.append((pattern, n))
        for length, k in pattern:
            left[length] -= k * n
            if not left[length]:
                del left[length]

    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                room = capacity - j
                sizes = sorted(left)
                others = lambda x: left[x] - (x == j)
                fit = [x for x in sizes[:bisect_left(sizes, room + 1)] if others(x) > 0]
                if not fit:
                    fix(((j, 1),), left[j])
                elif not _beaten(fit, others, room):
                    k = fit[-1]
                    if k == j:
                        fix(((j, 2),), left[j] // 2)
                    else:
                        fix(((j, 1), (k, 1)), min(left[j], left[k]))
                else:
                    break
                changed = True
    return fixed, left


def _beaten(fit: list[int], others, room: int) -> bool:
    """Whether a set of two or more may not be dominated by the largest single partner."""
    best = fit[-1]
    if best == room:
        return False
    small = [x for x in fit[:3] for _ in range(min(3, others(x)))][:3]
    if len(small) < 2 or small[0] + small[1] > room:
        return False
    if len(small) == 3 and sum(small) <= room:
        return True
    low, high = 0, len(fit) - 1      # the best pair, from both ends
    while low <= high:
        if fit[low] + fit[high] > room or (low == high and others(fit[low]) < 2):
            high -= 1
        elif fit[low] + fit[high] > best:
            return True
        else:
            low += 1
    return False


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Longest first, each piece into the fullest sequence that holds it; equal sequences together."""
    open_, rooms = {}, []      # room left -> [(pattern, sequences)]

    def put(room, pattern, n):
        if room not in open_:
            insort(rooms, room)
        open_.setdefault(room, []).append((pattern, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, pattern, m = capacity, (), -(-n // (capacity // length))
            else:
                room = rooms[at]
                pattern, m = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            each = room // length
            full = min(m, n // each)
            if full:
                put(room - each * length, (*pattern, (length, each)), full)
                n, m = n - full * each, m - full
            if n and n < each and m:
                put(room - n * length, (*pattern, (length, n)), 1)
                n, m = 0, m - 1
            if m:
                put(room, pattern, m)
    return [x for group in open_.values() for x in group]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, rest = dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    spark = docs.sparkSession
    cut = written(pieces(docs, path, capacity).withColumn("uid", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}      # at most `capacity` rows
    slots, used, first = [], {}, 0
    for pattern, n in patterns(counts, capacity):
        offset = 0
        for length, k in pattern:
            low = used.get(length, 0)
            slots.append((length, low, low + k * n, k, first, offset))
            used[length] = low + k * n
            offset += k * length
        first += n
    places = spark.createDataFrame(slots, "length long, low long, high long, each long, first long, at long")
    salts = F.broadcast(spark.createDataFrame([(k, -(-n // group)) for k, n in counts.items()], "length long, salts long"))
    salted = cut.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts")))
    before = salted.groupBy("length", "salt").count().withColumn(
        "before", F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("uid")) - 1) \
        .join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    put = ranked.join(F.broadcast(places), "length").where("rank >= low AND rank < high")      # patterns: a few thousand rows
    nth = F.col("rank") - F.col("low")
    return put.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(nth / F.col("each"))).alias("sequence_id"),
                      (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))

"""Quality rules: text statistics, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed one- and two-word grams: one of the
trusted documents (every label row says quality 1), one of the whole corpus. A
document's score is the mean log ratio of its grams; it is kept when no base rule fails
and the mean reaches the threshold. All documents count in the statistics and all are
judged. Counting is a map-side combined aggregation into a fixed number of buckets, so
a common word is one row for each task, and a core counts in few tasks; only one float a
bucket (their number is a parameter) reaches the driver, as Arrow. The weights go back
as one packed array, the value of a scalar subquery, which a stage gets once.

Cases: null or empty text has no words and fails; a corpus without trusted documents
or without words has weights of 0; repeated rows count and are judged one by one; a
null doc_id is never trusted; columns besides doc_id and text are carried, not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import SPACE, let, space_words, text_of, written

BUCKETS = 1 << 22
SMOOTHING = 2.0      # counts added to both sides, so that few trusted documents say little
THRESHOLD = -0.36    # under trusted documents left out of the fit, above labelled junk (sf0.1: -0.338 and -0.538)
MIN_WORDS = 50
TASKS = 2            # counting tasks a core, at most: each hands on up to all buckets
SYMBOLS = "[#*$%&|<>]"


def _bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(buckets - 1) if buckets & (buckets - 1) == 0 else F.pmod(h, F.lit(buckets))


def _pairs(words: Column) -> Column:
    """Hashes of all two-word grams."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def _hashes(words: Column) -> Column:
    """Hashes of all one-word and two-word grams."""
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), _pairs(words))


def _grams(words: Column, buckets: int) -> Column:
    """Buckets of all one-word and two-word grams."""
    return F.transform(_hashes(words), lambda h: _bucket(h, buckets))


def _weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log of a bucket's count in trusted documents over the count expected from the corpus, both smoothed.

    The corpus is every document; trusted is every labelled id whose label rows all say
    1. One scan counts both sides. The trusted ids are written as bitmaps first: they are
    small, and their size is known when the join is planned.
    """
    trusted = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1")
    bits = written(trusted.groupBy(F.bitmap_bucket_number("doc_id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits")))
    few = docs.select("doc_id", text_of().alias("text")).coalesce(TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    at = F.bitmap_bit_position("doc_id").cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = few.withColumn("block", F.bitmap_bucket_number("doc_id")).join(bits, "block", "left").select(F.coalesce(F.getbit(byte, at % 8).cast("int"), F.lit(0)).alias("t"), "text")
    grams = rows.select("t", F.explode(let(space_words(F.col("text")), _hashes)).alias("h")).select("t", _bucket(F.col("h"), buckets).alias("b"))      # buckets in generated code
    counts = written(grams.groupBy("b").agg(F.sum("t").alias("t"), F.count("*").alias("n")))      # at most `buckets` rows
    total = counts.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    out = np.zeros(buckets, np.float32)
    if total["t"]:
        rate = total["t"] / total["n"]      # a bucket's trusted count, were the two alike, is its corpus count times this
        ratio = (F.col("t") + smoothing) / (F.col("n") * rate + smoothing)
        for batch in counts.select("b", F.log(ratio).cast("float").alias("w")).toArrow().to_batches():
            out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def gram_weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """The weights of all buckets as a list."""
    return _weights(docs, labels, buckets, smoothing).tolist()


def _packed(docs: DataFrame, weights: list[float] | np.ndarray) -> Column:
    """``weights`` as one array of floats: a one-row table, read as a scalar subquery."""
    flat = pa.array(np.asarray(weights, np.float32))
    row = pa.table({"weights": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)})
    return docs.sparkSession.createDataFrame(row).scalar()


def _repeat_words(h: Column) -> Column:
    """Words that stand in a three-word window found twice or more, from the words' hashes.

    Windows are compared by 64-bit hashes of 64-bit word hashes; equal windows are
    neighbours once sorted, so a text of n words costs n log n. A text without equal
    windows, known from their distinct count, is not sorted. In others the windows are
    first sorted as plain numbers, the hash with its last bits replaced by the place; only
    those that equal a neighbour in the first bits, among them all equal ones, are
    compared whole.
    """
    def alike(x, rest):
        codes = F.transform(x, lambda v, i: v.bitwiseAND(F.bitwise_not(rest)).bitwiseOR(i))
        near = lambda a, b: a.bitwiseXOR(b).between(0, rest)
        return let(F.sort_array(codes), lambda s: F.transform(F.filter(s, lambda c, k: near(c, F.get(s, k - 1)) | near(c, F.get(s, k + 1))), lambda c: c.bitwiseAND(rest).cast("int")))

    def places(x):
        bits = F.pow(F.lit(2.0), F.length(F.bin(F.size(x)))).cast("long") - 1
        windows = lambda at: F.transform(at, lambda i: F.struct(F.get(x, i).alias("h"), i.alias("i")))
        twice = lambda s: F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return let(bits, lambda rest: let(F.sort_array(windows(alike(x, rest))), lambda s: F.size(F.array_distinct(F.flatten(F.transform(
            twice(s), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))))
    windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    return let(windows, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(places(x)))


def judged(docs: DataFrame, weights: list[float] | np.ndarray, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with a struct column ``__rules`` of statistics, score and verdict."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    mean = lambda g, table: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda s, h: s + F.get(table, _bucket(h, len(weights)))) / F.size(g)).otherwise(F.lit(0.0))
    facts = lambda table: let(space_words(text), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(h).cast("long").alias("n_repeat_words"),
        let(F.concat(h, _pairs(w)), lambda g: mean(g, table)).alias("llr"))))
    counts = F.struct(
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def verdict(f, c):
        failed = (f["n_words"] < min_words) | (F.lit(100) * f["n_repeat_words"] > F.lit(50) * f["n_words"])
        return F.struct(f["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
                        c["n_dup_lines"].alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words"),
                        failed.alias("base_failed"), (~failed & (f["llr"] >= threshold)).alias("kept"), f["llr"].alias("llr"))

    rules = let(facts(F.col("__weights")), lambda f: let(counts, lambda c: verdict(f, c)))
    return docs.withColumn("__weights", _packed(docs, weights)).withColumn("__rules", rules).drop("__weights")


def quality_rules(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """One row per document: statistics, ``base_failed``, ``kept`` and the mean log ratio ``llr``."""
    return judged(docs, _weights(docs, labels), **limits).select("doc_id", "__rules.*")


def keep_good(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    return judged(docs, _weights(docs, labels), **limits).where("__rules.kept").drop("__rules")

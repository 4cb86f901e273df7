"""Personal data: patterns, and information-theoretic sanitisation of telling terms.

Patterns find emails, addresses, card and phone numbers. Every found value is a
protected entity. The words of the documents that hold it are counted over the whole
corpus: with N distinct texts, n_e of them holding entity e, n_t term t and n_te both,
the pointwise mutual information log(n_te N / (n_t n_e)) as a share of the entity's
information content log(N / n_e) says how much of the entity t discloses. Terms at or
above ``disclose`` are generalised to [WORD] everywhere in that entity's documents,
terms at or above ``remove`` are removed. All four counts are of distinct texts, so
copies count once, and an entity and a term need ``support`` texts in common. A term is
a whole word outside the found values, of four letters or more, or shorter and
capitalised (or of a script without case). Only documents with a mention change.

All of it is SQL functions. Entities of fewer than ``support`` texts go before pairs are
made, pairs are pre-aggregated, and joins on entities, terms and texts are salted. A term
stands in at least as many texts as in those with a mention, so that count bounds its
share from above; only terms whose bound reaches ``disclose`` are counted over the
corpus. They are picked from the words by a bitmap of ``BLOCKS`` x 4 KB where the words
are read, so that no other word is shuffled; words that share a bit with one of them are
counted for nothing.

Cases: null or empty text has no spans; repeated rows and null ids give one row
each; overlapping spans of several kinds are all reported, and rewritten once;
other columns are carried by ``sanitised`` (``n_chars`` follows the new text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import let, text_of, written

# The patterns of the contract. Possessive repeats keep Java's matcher iterative, and
# the look-behind starts each run once, or where the match before ended; neither
# changes what matches. Runs of fewer than 16 digits can't be a card.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "phone": "+"}
_TERM = r"(?<![\p{L}\p{N}])(?:\p{L}{4,}+|[\p{Lu}\p{Lt}\p{Lo}]\p{L}{0,2}+)(?![\p{L}\p{N}])"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SALTS = 16
BLOCKS, BLOCK_BITS = 1024, 32768      # of the bitmap of terms to count: 4 MB
SUPPORT = 2
DISCLOSE, REMOVE = 0.8, 0.99
_FOUND = "array<struct<start:int,end:int,value:string>>"
_PLACES = "array<struct<start:int,end:int,gone:boolean>>"


def _matches(text: Column, pattern: Column) -> Column:
    """Matches with code point offsets: the pieces between them give the places."""
    step = lambda acc, x: let(acc["at"] + F.length(x["piece"]), lambda start: F.struct(
        (start + F.length(x["value"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("out")))
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1),
                       lambda m, p: F.struct(m.alias("value"), p.alias("piece")))
    return F.aggregate(F.filter(pairs, lambda x: x["value"].isNotNull()), F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out")),
                       step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    doubled = lambda k: let(F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int") * (F.lit(2) - k % 2), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), doubled), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(F.regexp_replace(value, "[ -]", ""), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value), by kind and then start."""
    def of_kind(kind, pattern):
        there = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else text.rlike(pattern)
        found = F.when(there, _matches(text, F.lit(pattern))).otherwise(F.array().cast(_FOUND))
        return F.transform(F.filter(found, lambda m: _valid(kind, m["value"])), lambda m: F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
    return F.concat(*[of_kind(*x) for x in PATTERNS.items()])


def _rewritten(text: Column, marks: Column) -> Column:
    """``text`` with each of ``marks`` (start, end, by) replaced; of overlapping ones the first."""
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), s["by"]).alias("out")))
    return F.aggregate(F.sort_array(marks), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _mark(s: Column, by: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), by.alias("by"))


def _masked() -> Column:
    """The text with blanks for found values, so that offsets stay; of overlapping ones each blanks what is left of it."""
    blank = lambda s, k: F.repeat(F.lit(" "), s["end"] - F.greatest(s["start"], F.coalesce(
        F.array_max(F.transform(F.slice("__ordered", 1, k), lambda o: o["end"])), F.lit(0))))
    return F.when(F.size("__spans") == 0, text_of()).otherwise(_rewritten(text_of(), F.transform("__ordered", lambda s, k: _mark(s, blank(s, k)))))


def _scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with spans, a text hash, the masked text and its distinct terms."""
    found = docs.withColumn("__spans", let(text_of(), base_spans)).withColumn("__hash", F.xxhash64(text_of()))
    found = found.withColumn("__ordered", F.sort_array(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    found = found.withColumn("__text", _masked()).drop("__ordered")
    return found.withColumn("__words", F.array_distinct(F.transform(F.regexp_extract_all("__text", F.lit(_TERM), F.lit(0)), F.lower)))


def _prepared(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` written with spans, a text hash and the entities; only texts with a mention carry their masked text and terms."""
    found, mention = _scanned(docs), F.size("__spans") > 0
    return written(found.select(
        *columns, "__spans", F.monotonically_increasing_id().alias("__rid"), "__hash",
        F.array_distinct(F.transform("__spans", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))).alias("__entities"),
        F.when(mention, F.col("__words")).alias("__words"), F.when(mention, F.col("__text")).alias("__text")))


def _salted(rows: DataFrame, by: str, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``other``, whose keys are unique; a common key is dealt out by a hash of ``by``."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    each = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(each, [*on, "__salt"], how).drop("__salt")


def _counted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): how many distinct texts hold each ``wanted`` term, and some others."""
    place = F.pmod(F.xxhash64("term"), F.lit(BLOCKS * BLOCK_BITS))
    block, bit = F.floor(place / BLOCK_BITS).cast("int"), (place % BLOCK_BITS).cast("int")
    bits = wanted.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("bits"))      # at most BLOCKS rows
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    words = _scanned(docs.select("text")).select("__hash", F.explode("__words").alias("term")).withColumn("block", block)
    held = words.join(F.broadcast(bits), "block").where(F.getbit(byte, bit % 8) == 1).select("__hash", "term").distinct()
    return held.groupBy("term").agg(F.count("*").alias("n_t"))


def _told(rows: DataFrame, docs: DataFrame, support: int = SUPPORT, disclose: float = DISCLOSE, remove: float = REMOVE) -> DataFrame:
    """Per text hash the (term, gone) that tell too much of an entity there.

    Pairs with enough support come from the texts with a mention; how many texts hold
    a term that may tell enough is counted over all distinct texts, in a scan of its own.
    """
    texts = written(rows.where(F.size("__spans") > 0).groupBy("__hash").agg(F.first("__entities").alias("__entities"), F.first("__words").alias("__words")))
    n = rows.select("__hash").distinct().count()
    entities = (texts.select(F.explode("__entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
                .where((F.col("n_e") >= support) & (F.col("n_e") < n)))
    mentions = _salted(texts.select("__hash", F.explode("__entities").alias("entity")), "__hash", entities, ["entity"])
    wanted = mentions.groupBy("__hash").agg(F.collect_list(F.struct("entity", "n_e")).alias("m"))
    pairs = texts.where(F.size("__entities") > 0).select("__hash", "__words").join(wanted, "__hash").select("__hash", "__words", F.inline("m")) \
        .select("__hash", "entity", "n_e", F.explode("__words").alias("term"))
    both = pairs.groupBy("entity", "term", "n_e").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= support)
    share = lambda n_t: F.log2(F.col("n_te") * F.lit(float(n)) / (F.col(n_t) * F.col("n_e"))) / F.log2(F.lit(float(n)) / F.col("n_e"))
    here = texts.select(F.explode("__words").alias("term")).groupBy("term").agg(F.count("*").alias("n_here")).where(F.col("n_here") >= support)
    likely = written(_salted(both, "entity", here, ["term"]).where(share("n_here") >= disclose).drop("n_here"))
    tell = _salted(likely, "entity", _counted(docs, likely), ["term"]).withColumn("share", share("n_t")).where(F.col("share") >= disclose) \
        .select("entity", "term", (F.col("share") >= remove).alias("gone"))
    return _salted(pairs.select("__hash", "entity", "term"), "__hash", tell, ["entity", "term"]) \
        .groupBy("__hash", "term").agg(F.max("gone").alias("gone")) \
        .groupBy("__hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "gone"))).alias("__told"))


def _with_terms(rows: DataFrame, corpus: DataFrame, docs: DataFrame, **limits) -> DataFrame:
    """``rows`` with ``__terms``: every place (start, end, gone) of a disclosing term of the row's text."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?iu:"), F.array_join(F.map_keys("__told"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    places = F.transform(_matches(F.col("__text"), pattern), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.coalesce(F.try_element_at(F.col("__told"), F.lower(m["value"])), F.lit(False)).alias("gone")))
    return _salted(rows, "__rid", _told(corpus, docs, **limits), ["__hash"], "left") \
        .withColumn("__terms", F.when(F.col("__told").isNotNull() & F.col("__text").isNotNull(), places).otherwise(F.array().cast(_PLACES)))


def personal_data(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: counts per kind, a digest of the base spans, and all spans."""
    rows = _prepared(docs.select("doc_id", "text"), ["doc_id"])
    out = _with_terms(rows, rows, docs, **limits)
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = F.transform("__spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    more = F.transform("__terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    return out.select("doc_id", *map(count, PATTERNS), F.sha2(F.array_join(told, ","), 256).alias("base_sha256"),
                      F.array_join(F.concat(told, more), ",").alias("spans"))


def sanitised(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with found values replaced by their kind, and disclosing terms generalised or removed."""
    rows = _prepared(docs, docs.columns)
    marks = F.concat(F.transform("__spans", lambda s: _mark(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))),
                     F.transform("__terms", lambda s: _mark(s, F.when(s["gone"], "").otherwise("[WORD]"))))
    changed = _with_terms(rows.where(F.size("__spans") > 0), rows, docs, **limits).withColumn("text", _rewritten(F.col("text"), marks))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.where(F.size("__spans") == 0).select(docs.columns).unionByName(changed.select(docs.columns))

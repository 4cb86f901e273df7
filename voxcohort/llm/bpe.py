"""BPE encoding and decoding in batched numpy merge rounds.

Texts are normalised and cut at white space; each chunk's ids are kept in a bounded
cache of the task's process. The chunks a batch brings anew are encoded together:
their symbols lie in one flat array, each round looks all neighbouring pairs up by
binary search over the sorted pair keys, takes every word's lowest rank and merges it,
until no word has a pair left. Decoding joins the vocabulary strings of the ids.

The vocabulary file is read by each process from a path that is a parameter; nothing
is collected, and no row depends on another. A text's special tokens are ids of their
own. Cases: null or empty text has no ids; very long texts are cut into chunks like
others; repeated rows and null ids give one row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.common import text_slices

CACHE = 300_000      # chunks kept by a process
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")   # fixed value of the vocabulary file
_LOADED: dict[str, WordBpe] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class WordBpe:
    """One vocabulary: pair keys sorted for binary search, and the chunk cache."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in self.special.items()}}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + self.suffix] for s in symbols], np.int64)
        self.base = len(self.names)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.arange(len(keys))[order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        sym = self.inner[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        done_word, done_sym, done_at = [], [], []
        at = np.arange(len(sym))
        none = len(self.keys)
        while len(sym):
            key = sym[:-1] * self.base + sym[1:]
            place = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[place] == key) & (word[:-1] == word[1:]), self.ranks[place], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            open_ = best < none
            if not open_.all():      # words without a pair left are finished
                done_word.append(word[~open_]), done_sym.append(sym[~open_]), done_at.append(at[~open_])
                sym, word, at, rank, best = sym[open_], word[open_], at[open_], rank[open_], best[open_]
                if not len(sym):
                    break
            hit = rank == best
            if (hit[1:] & hit[:-1]).any():      # in a run of equal symbols every other pair merges
                start = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
                run = np.cumsum(np.r_[False, hit[1:] & ~hit[:-1]]) - (0 if hit[0] else 1)
                hit &= (np.arange(len(hit)) - start[np.maximum(run, 0)]) % 2 == 0
            here = np.flatnonzero(hit)
            sym[here] = self.merged[rank[here]]
            keep = np.ones(len(sym), bool)
            keep[here + 1] = False
            sym, word, at = sym[keep], word[keep], at[keep]
        word, sym, at = map(np.concatenate, (done_word, done_sym, done_at))
        order = np.argsort(at, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks and keep their id bytes."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        texts, words, owner = list(chunks), [], []
        for n, c in enumerate(texts):
            found = _PRETOKEN.findall(c)
            words += [w.encode() for w in found]
            owner += [n] * len(found)
        if words:
            ids, counts = self.merge_rounds(words)
            flat = ids.astype("<u4").tobytes()
            per = np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)
        else:
            flat, per = b"", np.zeros(len(texts), np.int64)
        ends = (np.cumsum(per) * 4).tolist()
        self.cache.update(zip(texts, (flat[a:b] for a, b in zip([0, *ends], ends))))

    def chunks(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()     # no final sigma: letters are lowered one by one
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):      # white space to str.split only
            return [c for c in regex.split(r"\s+", text) if c]
        return text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = []
        for t in texts:
            marks = self.cut.split(t) if self.cut and t and "<|" in t else [t or ""]
            parts.append([self.chunks(p) if n % 2 == 0 else self.special[p] for n, p in enumerate(marks)])
        new = {c for p in parts for x in p if isinstance(x, list) for c in x if c not in self.cache}
        if len(self.cache) + len(new) > CACHE:
            new = {c for p in parts for x in p if isinstance(x, list) for c in x}
            self.cache.clear()
        if new:
            self.learn(new)
        of = self.cache.__getitem__
        return [b"".join([b"".join(map(of, x)) if isinstance(x, list) else x.to_bytes(4, "little") for x in p]) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (little-endian 32-bit), one row per document."""
    def work(batches):
        bpe = loaded(path)
        for batch in batches:
            for part in text_slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.encode(part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(work, "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded ``text`` of encoded rows."""
    def work(batches):
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(x).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
    return rows.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids binary, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Token count and digests of ids and decoded text, encoded and decoded in one pass."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def work(batches):
        bpe = loaded(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in text_slices(batch, 1):
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                                  pa.array(map(sha, ids), pa.string()), pa.array((sha(bpe.decode(x)) for x in ids), pa.string())],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(work, schema)

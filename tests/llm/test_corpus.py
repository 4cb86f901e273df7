"""Corpus operators against brute force, and their defined results on awkward tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxcohort.llm import ann, bpe, licenses, neardup, packing, pii, quality_gam, quality_rules, toxicity, warc
from voxcohort.llm.common import let

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = DOCS + ", score double, rid long, key string, kept boolean, label int, rank int, k long, sig string, y int"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from the loud city before night falls on it"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    """Null id, null and empty text, repeated rows, a very long text, and clashing columns."""
    long = " ".join(f"word{i % 977}" for i in range(60_000)) + " mail me at a.b@c.org now"
    rows = [(None, PROSE), (1, None), (2, ""), (3, " \t\n"), (4, PROSE * 3), (4, PROSE * 3), (5, long), (6, "x"), (None, PROSE), (7, long)]
    return spark.createDataFrame([(i, t, None, "s", 0, 0.5, 9, "key", True, 1, 1, 2, "sig", 1) for i, t in rows], EXTRA)


@pytest.fixture(scope="module")
def some_labels(spark):
    return spark.createDataFrame([(i, n % 2, 1 - n % 2) for n, i in enumerate((None, 1, 2, 3, 4, 4, 5, 6, 7))], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


# nearest neighbours

def exact(vectors, k=20, every=20):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        s = (x * x[n]).sum(1)
        s[n] = -np.inf
        best = np.lexsort((ids, -s))[:min(k, len(ids) - 1)]
        out[int(ids[n])] = [(int(ids[b]), float(s[b])) for b in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_learned_partitions_reach_the_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want, got = exact(rows), found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    assert all(abs(s - np.dot(np.array(dict(rows)[q], float), np.array(dict(rows)[v], float))) < 1e-9 for q in list(got)[:20] for v, s in got[q])


def test_nearest_ties_and_unusable_vectors(spark):
    good = [(i, [1.0, 0.0, 0.0]) for i in range(0, 60)] + [(100 + i, [0.0, 1.0, i / 100]) for i in range(5)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 0.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (300, [1.0])]
    repeated = [(0, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in good + bad + repeated], "vec_id long, embedding array<float>, score double")
    got, want = found(ann.nearest(df)), exact(good)
    assert got == want
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "vec_id long, embedding array<float>")
    assert found(ann.nearest(few)) == exact([(i, [1.0, float(i)]) for i in range(4)])
    assert ann.nearest(few.where("vec_id < 0")).collect() == []


# classifiers

def held_out_accuracy(scores, labels, label, rule):
    rows = scores.join(labels, "doc_id").where("held_out").select("doc_id", "predicted", "score", label).collect()
    assert all(rule(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == r[label] for r in rows) / len(rows)


def test_quality_classifier_on_held_out_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scores = quality_gam.quality_scores(d, l)
    assert held_out_accuracy(scores, l, "quality", lambda i: zlib.crc32(str(i).encode()) % 3 == 1) > 0.97
    assert scores.count() == d.count()


def test_toxicity_on_held_out_rows(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert held_out_accuracy(toxicity.toxicity_scores(d, l), l, "toxic", lambda i: zlib.crc32(str(i).encode()) % 5 == 0) > 0.95


def test_machine_learns_a_pair_that_neither_term_tells():
    rng = random.Random(1)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([1] * a + [2] * b + [rng.randrange(10, 60)]))
        y.append(float(a and b))
    model = toxicity.fit(rows, np.array(y))
    x = np.zeros((4, len(model.weights)))
    for n, on in enumerate([(), (1,), (2,), (1, 2)]):
        x[n, [model.terms[h] for h in on]] = 1
    p = toxicity._probability(toxicity._raw(x, model.base, model.weights, model.factors))
    assert p[3] > 0.8 and max(p[:3]) < 0.3


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((quality_gam.fit(x, y).score(x) > 0.5) == y).mean() > 0.95


# WARC

def test_archives_round_trip(spark):
    rng = random.Random(5)
    alphabet = ["\r", "\n", "\r\n\r\n", "WARC/1.1\r\n", "é", "日", "a", " ", "Content-Length: 3\r\n"]
    pages = [(i, f"http://h/{i}\r\nx", "".join(rng.choices(alphabet, k=rng.randrange(0, 400)))) for i in range(60)]
    pages += [(100, "u", None), (101, "u", ""), (102, None, pages[3][2]), (103, "u", "big é" * 500), (104, "v", "big é" * 500), (None, "n", "only"), (None, "n", pages[4][2])]
    df = spark.createDataFrame([(*p, 1.0) for p in pages], "page_id long, url string, html string, digest double")
    got = sorted(tuple(r) for r in warc.round_trip(df.repartition(3), chunk=100).select("payload_digest", "page_id", "payload_bytes", "record_type", "refers_to").fillna(-1, ["page_id", "refers_to"]).collect())
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        b, f = (h or "").encode(), first.get(h or "")
        again = f is not None and f != i
        want.append((base64.b32encode(hashlib.sha1(b).digest()).decode(), -1 if i is None else i, len(b), "revisit" if again else "response", f if again else -1))
    assert got == sorted(want)
    assert warc.round_trip(df.where("page_id < 0")).collect() == []


def test_parser_accepts_any_split():
    record = b"WARC/1.1\r\nContent-Length: 6\r\nX: 1\r\n\r\na\r\n\r\nb\r\n\r\n" * 3
    for step in (1, 3, 7, len(record)):
        parser = warc._Parser()
        blocks = [b for at in range(0, len(record), step) for _, b in parser.feed(record[at:at + step])]
        parser.end()
        assert blocks == [b"a\r\n\r\nb"] * 3


# near duplicates

def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def near_copies(n_groups, size, words, edits, seed):
    rng, out = random.Random(seed), []
    for g in range(n_groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, words, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 6)      # most groups here are large regions
    texts = near_copies(6, 40, 80, 14, words) + near_copies(20, 3, 40, 6, 9) + ["", None, "one", "One", "two words", "TWO  words", "a b c d e", "A B\tC D E"]
    want, got = linked({i: shingles(t, words) for i, t in enumerate(texts)}), neardup.near_duplicates(frame(spark, texts), words).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(shingles(texts[r.doc_id], words)) and r.kept == (r.doc_id == want[r.doc_id]) for r in got)


def test_components_left_apart_by_the_forest_are_joined(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 0)
    monkeypatch.setattr(neardup, "DEEPER", ())
    monkeypatch.setattr(neardup, "_stars", lambda rows: rows.where("false").select(F.col("rid").alias("a"), F.col("rid").alias("b")))
    monkeypatch.setattr(neardup, "_deeper", lambda rows, sigs: rows.select("rid", "comp"))
    texts = near_copies(3, 30, 60, 8, 4)
    got = neardup.near_duplicates(frame(spark, texts), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == linked({i: shingles(t, 2) for i, t in enumerate(texts)})


def test_regions_with_one_first_row_are_divided_once(spark, monkeypatch):
    """A large group of near copies shares its first row in many trees; its rows are not divided again in each of them."""
    monkeypatch.setattr(neardup, "SMALL", 6)
    given, plain = [], neardup._deeper
    monkeypatch.setattr(neardup, "_deeper", lambda rows, sigs: given.append(rows.select("rid", "tree").collect()) or plain(rows, sigs))
    texts = near_copies(1, 60, 200, 40, 3)
    got = neardup.near_duplicates(frame(spark, texts), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == linked({i: shingles(t, 2) for i, t in enumerate(texts)})
    times = Counter(r.rid for r in given[0])
    assert times and max(times.values()) <= 8, times.most_common(3)


def test_deduplicated_keeps_one_row_of_a_group(spark, awkward):
    kept = neardup.deduplicated(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # one of the null-id copies; all rows without words; one of the repeated rows; 5 for its copy 7
    assert ids == {None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}


# packing

def fits(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_pieces_and_sequences(spark, docs, texts):
    t, capacity = Tokenizer.from_file(BYTE_BPE), 256
    extra = {10_000: None, 10_001: "", 10_002: "a  b \n c <|endoftext|> d", 10_003: "x " * 3000}
    df = docs.union(frame(spark, list(extra.values()), list(extra)))
    rows = packing.packed(df, BYTE_BPE, capacity, group=7).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.piece] = r
    for i, text in {**texts, **extra}.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        parts, at = [by[i][k] for k in range(len(by[i]))], 0
        for k, r in enumerate(parts):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes()) and (k == 0 or r.length == capacity)
            at += r.length
        assert at == len(ids) and len(parts) == -(-len(ids) // capacity)
    assert fits(rows, capacity) <= 1.01 * -(-sum(r.length for r in rows) // capacity) + 1


@pytest.mark.parametrize("seed", range(40))
def test_reduction_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity, sizes = 10, [rng.randrange(1, 11) for _ in range(8)]

    def least(items, rooms):
        if not items:
            return 0
        best, seen = 99, set()
        for n, room in enumerate(rooms):
            if room >= items[0] and room not in seen:
                seen.add(room)
                best = min(best, least(items[1:], rooms[:n] + [room - items[0]] + rooms[n + 1:]))
        return min(best, 1 + least(items[1:], [*rooms, capacity - items[0]]))

    fixed, rest = packing.dominated(Counter(sizes), capacity)
    left = sorted(Counter(rest).elements(), reverse=True)
    assert sum(n for _, n in fixed) + least(left, []) == least(sorted(sizes, reverse=True), [])
    placed = Counter()
    for pattern, n in packing.patterns(Counter(sizes), capacity):
        assert sum(a * b for a, b in pattern) <= capacity
        for a, b in pattern:
            placed[a] += b * n
    assert placed == Counter(sizes)


# licenses

def test_license_scan_equals_brute_force(spark, docs, texts):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, text in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        at = [(n, name) for name, p in licenses.PHRASES.items() for n in range(len(w)) if tuple(w[n:n + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({n for _, n in at})) and {n for _, n in at} <= set(r.labels.split(","))


def test_diagonals_find_changed_notices(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    changed = mit.replace("free of", "free and free of").replace("documentation", "docs")
    rows = licenses.license_scan(frame(spark, [PROSE, PROSE + " " + mit, changed + " " + PROSE, "the license of this file is unknown", None])).collect()
    assert [r.labels for r in sorted(rows, key=lambda r: r.doc_id)] == ["", "mit", "mit", "", ""]


# personal data

def python_spans(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(reversed(d))) % 10 == 0
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def test_personal_data_equals_brute_force(spark, docs, texts):
    rng = random.Random(3)
    odd = ["".join(rng.choices("ab1.@-+ %_(3)é0", k=120)) for _ in range(300)]
    odd += ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.004", "4111 1111-1111 1111", "12345678901234567890 4111111111111111", "+1 (555) 123-4567.", "日本 +49 30 1234567 é@a.bc é", "9" * 30_000, "a" * 50_000 + "@", None, ""]
    extra = {10_000 + n: t for n, t in enumerate(odd)}
    got = {r.doc_id: r for r in pii.personal_data(docs.union(frame(spark, odd, list(extra)))).collect()}
    for i, text in {**texts, **extra}.items():
        want, r = python_spans(text or ""), got[i]
        count = Counter(s.split(":")[0] for s in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [count[k] for k in pii.PATTERNS], text
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == want


def test_telling_terms_are_generalised_beside_their_entity(spark):
    texts = [f"note{n} about Zebulon via zeb@corp.org today with thanks" for n in range(4)] + [f"today thanks with about others {n}" for n in range(200)] + ["write to someone@else.org about today"]
    df = frame(spark, texts)
    out = {r.doc_id: r for r in pii.sanitised(df).collect()}
    assert out[0].text == "note0 about  via [EMAIL] today with thanks" and out[0].n_chars == len(out[0].text)
    assert all(out[n].text == texts[n] for n in range(4, 204)) and out[204].text == "write to [EMAIL] about today"
    spans = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert spans[1] == "email:24:36,term:12:19" and spans[204] == "email:9:25" and spans[7] == ""


def test_terms_of_the_whole_document_tell(spark):
    far = " ".join(["today thanks with about others"] * 8)
    texts = [f"Zebulon and Lee {far} {n} zeb@corp.org {far} Zebulon" for n in range(4)] + [f"today thanks with about others {n}" for n in range(200)]
    texts += [texts[0]] * 500      # copies of one text count once
    out = {r.doc_id: r.text for r in pii.sanitised(frame(spark, texts)).collect()}
    want = [f" and  {far} {n} [EMAIL] {far} " for n in range(4)]
    assert [out[n] for n in range(4)] == want and {out[n] for n in range(204, 704)} == {want[0]}
    assert all(out[n] == texts[n] for n in range(4, 204))


# BPE

def test_word_bpe_equals_the_library(spark, docs, texts):
    t = Tokenizer.from_file(WORD_BPE)
    odd = ["It's DON'T we'll", "aaaaaaa aaaaaaaa", "a<|endoftext|>B <|startoftext|>", "ΣΑΣ οδός İ é \x1ca\x1fb", "日本 123 ４５ ①", "ﬁ ẞ K", "a" * 3000, "", None]
    extra = {10_000 + n: x for n, x in enumerate(odd)}
    df = docs.union(frame(spark, odd, list(extra)))
    got = {r.doc_id: r for r in bpe.digests(df, WORD_BPE).collect()}
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df, WORD_BPE), WORD_BPE).collect()}
    for i, text in {**texts, **extra}.items():
        ids = t.encode(text or "", add_special_tokens=False).ids
        plain = t.decode(ids, skip_special_tokens=False)
        assert back[i] == plain
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()


# quality rules

def test_quality_rules_equal_brute_force(spark, docs, labels, texts):
    odd = ["a b c a b c a b c", "x x x x x", "one two\n\n \none two\n#$|<>", None, "", "a b c d a b c"]
    extra = {10_000 + n: x for n, x in enumerate(odd)}
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs.union(frame(spark, odd, list(extra))), labels).collect()}
    for i, text in {**texts, **extra}.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        seen = Counter(tuple(w[n:n + 3]) for n in range(len(w) - 2))
        repeat = {p for n in range(len(w) - 2) if seen[tuple(w[n:n + 3])] > 1 for p in range(n, n + 3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_log_ratio_prefers_trusted_words(spark):
    good = [" ".join(random.Random(n).choices(PROSE.split(), k=80)) for n in range(40)]
    bad = [" ".join(f"{w}%%" for w in random.Random(n).choices(PROSE.split(), k=80)) for n in range(20)]
    df = frame(spark, good + bad)
    labels = spark.createDataFrame([(n, int(n < 40)) for n in range(60)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_good(df, labels).collect()}
    assert kept == set(range(40))
    weights = quality_rules.gram_weights(df, labels, buckets=64)
    assert len(weights) == 64 and quality_rules.gram_weights(df, labels.where("false"), buckets=8) == [0.0] * 8


def test_log_ratio_rejects_junk_of_each_document(spark):
    good = [" ".join(random.Random(n).choices(PROSE.split(), k=80)) for n in range(40)]
    bad = [" ".join(f"{w}%%{n}" for w in random.Random(n).choices(PROSE.split(), k=80)) for n in range(20)]
    labels = spark.createDataFrame([(n, int(n < 40)) for n in range(60)], "doc_id long, quality int")
    assert {r.doc_id for r in quality_rules.keep_good(frame(spark, good + bad), labels).collect()} == set(range(40))


def test_rules_follow_the_labels(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.quality_rules(d, l).where("not base_failed").join(l, "doc_id").groupBy("quality", "kept").count().collect()
    assert {(r.quality, r.kept) for r in rows} == {(0, False), (1, True)}


# all operators on awkward tables

CALLS = {
    "toxicity": lambda d, l: toxicity.toxicity_scores(d, l), "quality": lambda d, l: quality_gam.quality_scores(d, l),
    "near": lambda d, l: neardup.near_duplicates(d), "packing": lambda d, l: packing.packed(d, BYTE_BPE),
    "licenses": lambda d, l: licenses.license_scan(d), "pii": lambda d, l: pii.personal_data(d),
    "bpe": lambda d, l: bpe.digests(d, WORD_BPE), "rules": lambda d, l: quality_rules.quality_rules(d, l)}


@pytest.mark.parametrize("name", CALLS)
def test_awkward_and_empty_tables(name, awkward, some_labels, nothing):
    rows = CALLS[name](awkward, some_labels).collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "packing":
        assert set(ids) == {None, 1, 2, 3, 4, 5, 6, 7} and fits(rows, 2048)
    else:
        assert ids == {None: 2, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1}
    if name == "near":
        assert {r.doc_id: r.component_id for r in rows} == {None: None, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 5}
    assert CALLS[name](nothing, some_labels).collect() == []
    assert CALLS[name](nothing, some_labels.where("false")).collect() == []


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_awkward_and_empty_tables(spark, tmp_path, number, awkward, some_labels, nothing):
    some_labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[number]
    last = number == len(corpus_pipeline.STAGES) - 1
    for df in (awkward, nothing):
        out = stage(spark, df, str(tmp_path))
        assert last or out.columns == df.columns
        assert out.count() >= 0


def test_pipeline_packs_what_its_stages_keep(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and fits(rows, 2048)


def test_quality_rules_trust_every_labelled_document(spark):
    """More trusted ids than any fixed number of them: each one's own word counts for it."""
    ids = spark.range(-10_000, 34_000).union(spark.createDataFrame([(1 << 62,), (-(1 << 63),), ((1 << 63) - 1,)], "id long"))
    docs = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    labels = ids.where("id % 8 <> 3").select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    out = quality_rules.quality_rules(docs, labels).select("doc_id", (F.col("doc_id") % 8 != 3).alias("t"), (F.col("llr") > 0).alias("p")).groupBy("t", "p").count().collect()
    good = sum(r["count"] for r in out if r.t == r.p)
    assert good / sum(r["count"] for r in out) > 0.985      # some grams share a bucket


def test_gram_weights_equal_a_plain_count(spark):
    """Also over more input partitions than counting tasks."""
    texts = [(i, " ".join(f"t{(i * k) % 97}" for k in range(1, 40))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(40)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int")
    n, t = Counter(), Counter()
    for r in docs.select("doc_id", quality_rules._grams(F.split("text", " "), 1 << 17).alias("b")).collect():
        n.update(r.b)
        t.update(r.b if r.doc_id % 3 == 0 and r.doc_id < 40 else [])
    rate = sum(t.values()) / sum(n.values())
    got = quality_rules.gram_weights(docs, labels, buckets=1 << 17)
    assert all(abs(got[k] - np.log((t[k] + 2.0) / (c * rate + 2.0))) < 1e-5 for k, c in n.items()) and not any(v for k, v in enumerate(got) if k not in n)


def test_repeated_words_of_long_texts(spark):
    """Equal windows far apart in a long text, beside many that stand once."""
    words = [f"w{random.Random(n).randrange(60)}" for n in range(9000)]
    seen = Counter(tuple(words[n:n + 3]) for n in range(len(words) - 2))
    repeat = {p for n in range(len(words) - 2) if seen[tuple(words[n:n + 3])] > 1 for p in range(n, n + 3)}
    hashes = F.transform(F.split("text", " "), lambda w: F.xxhash64(w))
    got = [r.n for r in frame(spark, [" ".join(words), " ".join(words[:2]), "a b c", "a a a a"]).select("doc_id", let(hashes, quality_rules._repeat_words).alias("n")).orderBy("doc_id").collect()]
    assert got == [len(repeat), 0, 0, 4]


def test_only_words_that_may_tell_are_counted(spark, monkeypatch):
    """Other words of the corpus never leave the scan; the counts of those that may tell are of distinct texts."""
    name = lambda n: "".join("abcdefghij"[int(d)] for d in str(n)) * 2
    texts = [f"Sundial {name(n)} words stand everywhere me@sundial.org" for n in range(6)]
    texts += [f"other {name(n)} words stand everywhere {name(n)}@else.org" for n in range(40)]
    plain_texts = [f"plain {name(n)} words stand everywhere" for n in range(60)] + ["the Sundial turns alone"]
    texts += plain_texts + plain_texts
    seen, plain = [], pii._counted
    monkeypatch.setattr(pii, "_counted", lambda *a: seen.append(plain(*a)) or seen[-1])
    spans = [r.spans for r in pii.personal_data(frame(spark, texts)).orderBy("doc_id").collect()]
    assert all("term:0:7" in s for s in spans[:6]) and not any("term" in s for s in spans[6:])
    assert {r.term: r.n_t for r in seen[0].collect()} == {"sundial": 7}

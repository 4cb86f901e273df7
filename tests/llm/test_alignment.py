"""Alignment of two tokenizers against plain Python on small tables."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from voxcohort.llm import align
from voxcohort.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, lang string, rid long, a string, b long, body string, part int, n_a long, best int"
ODD = ["hello  world", "naïve café ﬁ", "日本語のテキストがここにある。" * 40, "a▁b", "<|endoftext|> and <s> </s>", " \t lead", "trail \n", "x\x1c y", "  z  w",
       "don't 'tis 42,000.5 %%%", "emoji 👩‍👩‍👧 ok", "a" * 3000, "é e ́x", "\x00 nul", " ", "tab\tin\nlines \n\n here"]


def plain(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of every text, byte by byte."""
    ours = Tokenizer.from_file(A)
    ours.encode_special_tokens = True
    theirs = sentencepiece.SentencePieceProcessor(model_file=B)
    table = {c: b for b, c in enumerate(byte_symbols())}
    rows = []
    for t in texts:
        a = [(i, bytes(table[c] for c in s)) for i, s in (lambda e: zip(e.ids, e.tokens))(ours.encode(" " + t, add_special_tokens=False))] if t else []
        b = [(i, bytes([i - 3]) if theirs.is_byte(i) else theirs.id_to_piece(i).replace("▁", " ").encode()) for i in theirs.encode(t)] if t else []
        raw = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            rows.append(([], [], [], ""))
            continue
        owner = [[n for n, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        links = sorted(set(zip(*owner)))
        ends = [{k for k in range(1, len(raw) + 1) if k == len(raw) or o[k] != o[k - 1]} for o in owner]
        cuts, last, groups = sorted(ends[0] & ends[1]), 0, []
        for c in cuts:
            ids = [",".join(str(side[n][0]) for n in dict.fromkeys(o[last:c])) for side, o in zip((a, b), owner)]
            groups.append("|".join(ids))
            last = c
        rows.append((a, b, [(a[x][0], b[y][0]) for x, y in links], ";".join(groups)))
    docs = Counter(p for r in rows for p in set(r[2]))
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    return [(len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, links, g in rows]


def rows_of(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def want(ids, texts):
    return sorted(((i, *r) for i, r in zip(ids, plain(texts))), key=str)


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return [r.doc_id for r in rows], [r.text for r in rows]


def test_alignment_equals_plain_python(spark, sample):
    ids, texts = sample
    ids, texts = [*ids, *range(-len(ODD), 0)], [*texts, *ODD]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    expected = want(ids, texts)
    assert rows_of(align.alignment(docs, A, B)) == expected
    assert rows_of(align.alignment(docs, A, B, chunk=64, slice_pairs=500)) == expected      # fragments of every document, many slices


def test_fragments_compose_in_any_order(spark, sample):
    tokens = align.loaded(A, B)
    text = max((t for t in sample[1] if "▁" not in t), key=len)
    a, b = tokens.encoded([text])[0]
    groups, _, body, *_ = tokens.flat([(a, b)])[0]
    for chunk in (1, 7, 200):
        parts = tokens.fragments(a, b, chunk)
        one = parts[0]
        for p in parts[1:]:
            one = tokens.compose(one, p)
        while len(parts) > 1:
            parts = [tokens.compose(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        whole = tokens.document(one)
        assert whole == tokens.document(parts[0]) and whole.suffix == ([], [])
        assert hashlib.sha256(whole.body.encode()).hexdigest().encode() == body and whole.groups == groups


def test_alignment_on_awkward_and_empty_tables(spark):
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    texts = [None, "", "same text here", "same text here", long, "x"]
    ids = [1, 2, 3, 3, None, None]
    docs = spark.createDataFrame([(i, t, "en", 7, "a", 1, "b", 2, 3, 4) for i, t in zip(ids, texts)], EXTRA)
    assert rows_of(align.alignment(docs, A, B)) == want(ids, texts)
    empty = align.alignment(docs.where("doc_id > 100"), A, B)
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

"""Contract queries of the corpus operators."""

from __future__ import annotations

import public_tokenizers

from voxcohort.llm import align, ann, bpe, countjoin, licenses, neardup, packing, pii, quality_gam, quality_rules, toxicity, warc, whiten
from voxcohort.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_learned_partitions(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@_query
def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op3_quality_classifier(spark, sf_dir):
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@_query
def op5_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


@_query
def op6_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op7_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@_query
def op8_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@_query
def op9_word_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op10_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op13_tokenizer_alignment(spark, sf_dir):
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op12_embedding_whitening(spark, sf_dir):
    return whiten.whitening(table(spark, sf_dir, "embeddings"))


@_query
def op11_ngram_join(spark, sf_dir):
    return countjoin.joined(table(spark, sf_dir, "documents"))

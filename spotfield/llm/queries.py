"""Registered queries of the text operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import centroids, decontaminate, exact_dedup, lattice, packing, pieces, pii, quality, simhash, spelling, topk, toxicity, warc
from .common import table


def op1_warc(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lattice(spark, sf_dir):
    return lattice.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_topk(spark, sf_dir):
    return topk.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op7_simhash(spark, sf_dir):
    return simhash.assign(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_pieces(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_wumanber(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_quality, op3_lattice, op4_topk, op5_pii, op6_exact_dedup, op7_simhash, op8_packing, op9_pieces, op10_toxicity,
                                 op11_wumanber, op12_centroids, op13_variants)}

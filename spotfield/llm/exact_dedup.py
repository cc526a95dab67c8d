"""Exact deduplication that no large group of copies can hold up.

Texts are compared whole at every stage: each grouping key holds the text
beside its digest, so a digest that two texts share never merges them.

1. locally: equal texts of a partition become one row (the map side of the
   first grouping, as the salt is a function of the partition);
2. salted: those rows meet by (salt, digest, text), so that a group with a
   third of all rows is spread over as many tasks as there are salts;
3. globally: at most one row per salt and text is left to meet by digest.

Defined cases: a null text counts as empty; rows with a null id count in their
group and stay only if the group has no other id; rows that repeat an id and
its text count each and are kept or dropped together (``survivors`` returns
one of them); an empty table gives an empty result; other columns are ignored
by ``assign`` and carried along by ``survivors``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keyed(docs: DataFrame, digest) -> DataFrame:
    """(id, body, digest, rest): the text once, all other columns as one struct."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = F.struct(F.col("text").isNull().alias("no_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    return docs.select(F.col("doc_id").alias("id"), text.alias("body"), digest(text).alias("digest"), rest.alias("rest"))


def _merged(keyed: DataFrame, aggregates, salts: int) -> DataFrame:
    """One row per distinct text; ``aggregates`` maps a stage (0 or 1) to its aggregate columns."""
    local = keyed.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("salt", "digest", "body").agg(*aggregates(0))
    return salted.repartition("digest").groupBy("digest", "body").agg(*aggregates(1))


def assign(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row; the largest id of equal texts stays."""
    keyed = _keyed(docs, digest).drop("rest")

    def counts(stage):
        n = F.count(F.lit(1)) if stage == 0 else F.sum("group_size")
        return [F.max("id" if stage == 0 else "keep_id").alias("keep_id"), n.alias("group_size")]

    texts = _merged(keyed, counts, salts)
    # rows of a digest are together already: no further shuffle
    digests = materialise(
        texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")),
        "digests")
    sha = F.sha2("body", 256).alias("text_sha256")
    rows = attach(keyed.select("id", "digest", sha), digests, "digest", "group_size")
    shared = digests.where("texts > 1").select("digest")
    out = rows.where("texts = 1")
    if not shared.isEmpty():  # different texts with one digest: settled by the texts themselves
        again = keyed.join(shared, "digest", "left_semi")
        groups = _merged(again, counts, salts).drop("digest")
        out = out.select("id", "keep_id", "group_size", "text_sha256").unionByName(
            again.select("id", "body", sha).join(groups, "body").select("id", "keep_id", "group_size", "text_sha256"))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, one per distinct text, with all their columns."""

    def rows(stage):
        order = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63))) if stage == 0 else F.col("top")
        return [F.max_by("rest", order).alias("rest"), F.max(order).alias("top")]

    text = F.when(~F.col("rest.no_text"), F.col("body")).alias("text")
    return _merged(_keyed(docs, digest), rows, salts).select(*[text if c == "text" else F.col("rest.row")[c].alias(c) for c in docs.columns])

"""Molecular quality control, scoring and interaction eligibility.

Counts are long: ``counts(specimen, obs_id, gene_id, raw)`` where an absent row
means zero.  Outputs over (observation, complex) stay sparse in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.order_stats import exact_quantile
from ..functions.scalar import cp10k, passes_qc
from ..runtime import materialise, require_columns


def subunit_table(pairs: DataFrame, id_col: str, subunits: str) -> DataFrame:
    """One row per required subunit, with the number the complex needs."""
    return pairs.select(
        "specimen", F.col(id_col).alias("complex_id"), F.size(subunits).alias("needed"),
        F.explode(subunits).alias("gene_id"))


def require_subunits(pairs: DataFrame, *columns: str) -> None:
    empty = F.lit(False)
    for c in columns:
        empty = empty | F.coalesce(F.size(c) < 1, F.lit(True))
    if pairs.where(empty).limit(1).count():
        raise ValueError("every complex needs at least one subunit")


def complex_counts(counts: DataFrame, complexes: DataFrame) -> DataFrame:
    """Counts of each complex: the smallest of its subunits, zero if one is absent.

    ``complexes(specimen, complex_id, subunits)``; zero rows are not emitted.
    """
    require_columns(complexes, ["specimen", "complex_id", "subunits"], "complexes")
    require_subunits(complexes, "subunits")
    parts = subunit_table(complexes, "complex_id", "subunits")
    return (
        counts.where(F.col("raw") > 0).join(parts, ["specimen", "gene_id"])
        .groupBy("specimen", "complex_id", "obs_id", "needed")
        .agg(F.count("*").alias("present"), F.min("raw").alias("raw"))
        .where(F.col("present") == F.col("needed"))
        .select("specimen", "complex_id", "obs_id", F.col("raw").cast("double").alias("raw"))
    )


def bounded_scores(complex_raw: DataFrame, observations: DataFrame) -> DataFrame:
    """Map log-CP10K abundance to [0, 1) by the median positive level.

    The level is exact and per (specimen, complex).  Rows with no abundance
    score zero and stay absent.
    """
    z = (
        complex_raw.join(observations.select("specimen", "obs_id", "library_size"), ["specimen", "obs_id"])
        .select("specimen", "complex_id", "obs_id", F.log1p(cp10k("raw", "library_size")).alias("z"))
        .where(F.col("z") > 0))
    z = materialise(z, "abundance")
    level = materialise(exact_quantile(z, ["specimen", "complex_id"], "z", 0.5, "level"), "level")
    return z.join(level, ["specimen", "complex_id"]).select(
        "specimen", "complex_id", "obs_id",
        (F.col("z") / (F.col("z") + F.greatest(F.col("level"), F.lit(1e-12)))).alias("score"))


def qc_pass(observations: DataFrame, mito: bool = False) -> DataFrame:
    """Flag observations with enough counts and genes (and little mitochondrial RNA)."""
    return observations.withColumn(
        "keep", passes_qc("total_umi", "detected_genes", "mito_fraction" if mito else None))


def detected_genes(counts: DataFrame, observations: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes seen in at least max(10, 0.1 %) of a specimen's observations."""
    n_obs = observations.groupBy("specimen").agg(F.count("*").alias("n_obs"))
    seen = counts.where(F.col("raw") > 0).groupBy("specimen", "gene_id").agg(F.count("*").alias("n_detected"))
    needed = F.greatest(F.lit(S.GENE_MIN_OBS), F.ceil(F.lit(S.GENE_MIN_FRACTION) * F.col("n_obs")))
    return (
        genes.join(seen, ["specimen", "gene_id"], "left").join(n_obs, "specimen")
        .select("specimen", "gene_id", F.coalesce("n_detected", F.lit(0)).cast("long").alias("n_detected"),
                (F.coalesce("n_detected", F.lit(0)) >= needed).alias("detected")))


def _passing(counts: DataFrame, observations: DataFrame, parts: DataFrame) -> DataFrame:
    """Observations in which every subunit has raw >= 1 and CP10K >= 1."""
    ok = (F.col("raw") >= 1) & (cp10k("raw", "library_size") >= F.lit(1.0))
    return (
        counts.join(parts, ["specimen", "gene_id"])
        .join(observations.select("specimen", "obs_id", "library_size"), ["specimen", "obs_id"])
        .where(ok)
        .groupBy("specimen", "complex_id", "role", "obs_id", "needed").agg(F.count("*").alias("passed"))
        .where(F.col("passed") == F.col("needed"))
        .select("specimen", F.col("complex_id").alias("pair_id"), "role", "obs_id"))


def positive_observations(counts: DataFrame, observations: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, role, obs) rows for ligand-positive and receptor-competent observations."""
    require_subunits(pairs, "ligand_subunits", "receptor_subunits")
    parts = subunit_table(pairs, "pair_id", "ligand_subunits").withColumn("role", F.lit("ligand")).unionByName(
        subunit_table(pairs, "pair_id", "receptor_subunits").withColumn("role", F.lit("receptor")))
    return _passing(counts, observations, parts)


def eligibility(counts: DataFrame, observations: DataFrame, pairs: DataFrame, use_states: bool = False) -> DataFrame:
    """One decision row per (specimen, pair).

    ``total_raw_source`` sums every ligand subunit over all observations, not
    only the positive ones.
    """
    positive = positive_observations(counts, observations, pairs)
    if use_states:
        positive = materialise(positive, "positive")
    tally = positive.groupBy("specimen", "pair_id").agg(
        F.count_if(F.col("role") == "ligand").alias("n_positive_source"),
        F.count_if(F.col("role") == "receptor").alias("n_competent_receivers"))
    ligands = subunit_table(pairs, "pair_id", "ligand_subunits").withColumnRenamed("complex_id", "pair_id")
    totals = (
        counts.join(ligands, ["specimen", "gene_id"]).groupBy("specimen", "pair_id")
        .agg(F.sum("raw").cast("long").alias("total_raw_source")))
    out = pairs.select("specimen", "pair_id").join(tally, ["specimen", "pair_id"], "left").join(
        totals, ["specimen", "pair_id"], "left").fillna(0)

    enough = (
        (F.col("n_positive_source") >= S.SOURCES_NEEDED)
        & (F.col("total_raw_source") >= S.SOURCE_COUNTS_NEEDED)
        & (F.col("n_competent_receivers") >= S.RECEIVERS_NEEDED))
    if not use_states:
        return out.withColumn("max_state_fraction", F.lit(None).cast("double")).withColumn("eligible", enough)

    sizes = observations.groupBy("specimen", "state").agg(F.count("*").alias("size")).where(
        F.col("size") >= S.STATE_SIZE_NEEDED)
    fractions = (
        positive.where(F.col("role") == "receptor")
        .join(observations.select("specimen", "obs_id", "state"), ["specimen", "obs_id"])
        .groupBy("specimen", "pair_id", "state").agg(F.count("*").alias("competent"))
        .join(sizes, ["specimen", "state"])
        .groupBy("specimen", "pair_id")
        .agg(F.max(F.col("competent") / F.col("size")).alias("max_state_fraction")))
    return (
        out.join(fractions, ["specimen", "pair_id"], "left")
        .withColumn("max_state_fraction", F.coalesce("max_state_fraction", F.lit(0.0)))
        .withColumn("eligible", enough & (F.col("max_state_fraction") >= F.lit(S.STATE_FRACTION_NEEDED))))

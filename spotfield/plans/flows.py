"""End-to-end analyses.

A: image and counts to secreted exposure, or points and counts to contact exposure.
B: exposure and response to bootstrap p-values and false-discovery rates.
C: detected pairs to an effective range, reported only where the data support it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalar import calibrated_p, phi_high, phi_low, range_report, require_trusted, trusted_ranges
from ..operators import association, contact, evidence, projection, ranges, transport
from ..operators.mesh import geodesic_diameters
from ..runtime import materialise

KEYS = ["specimen", "response_id"]


def range_grid(frame: DataFrame, specimens: DataFrame, diameters: DataFrame) -> DataFrame:
    """(specimen, ells): trusted candidate ranges; raises where too few remain."""
    ells = require_trusted(trusted_ranges("h", "median_nn_um", "diameter_um"))
    return (
        frame.select("specimen", "h").join(specimens.select("specimen", "median_nn_um"), "specimen")
        .join(geodesic_diameters(diameters), "specimen").select("specimen", ells.alias("ells")))


def secreted_exposures(scores: DataFrame, weights: DataFrame, nodes: DataFrame, entries: DataFrame, grid: DataFrame,
                       keys: list[str] = ("pair_id",)) -> DataFrame:
    """Exposure of every observation at every candidate range.

    ``scores(specimen, *keys, obs_id, score)`` to ``(specimen, *keys, ell, obs_id, h)``,
    zero for an observation on a component without sources.
    """
    keys = list(keys)
    load = projection.deposit(weights, scores, "score", keys)
    return transport.receiver_exposures(entries, load, weights, nodes, grid, keys)


def contact_exposures(points: DataFrame, scores: DataFrame, median_nn_um: float, by_component: bool = False) -> DataFrame:
    """Neighbour-mean exposure; observations without a score count as zero."""
    scored = points.join(scores.select("specimen", "obs_id", "score"), ["specimen", "obs_id"], "left").fillna(0.0, ["score"])
    return contact.contact_exposure(scored, median_nn_um, by_component)


def covariance_bounds(specimens: DataFrame, diameters: DataFrame) -> DataFrame:
    return specimens.join(geodesic_diameters(diameters), "specimen").select(
        "specimen", phi_low("median_nn_um").alias("phi_low"), phi_high("diameter_um").alias("phi_high"))


def association_test(data: DataFrame, exposures: DataFrame, bounds: DataFrame, secreted: bool = True,
                     draws: int = S.BOOTSTRAP_DRAWS, seed: int = 0, method: str = "auto") -> DataFrame:
    """(specimen, response_id, statistic, p_boot, p, q) with one FDR family per specimen."""
    fits = materialise(association.fit_covariance(data, bounds, method), "fits")
    profiles = materialise(association.association_profiles(data, exposures, fits), "profiles")
    p = association.bootstrap_pvalues(profiles, draws, seed).withColumnRenamed("p", "p_boot")
    p = p.withColumn("p", calibrated_p("p_boot") if secreted else F.col("p_boot"))
    tested = materialise(profiles.select(*KEYS, F.col("observed").alias("statistic")).join(p, KEYS), "tested")
    return evidence.fdr(tested, ["specimen"])


def estimate_ranges(data: DataFrame, exposures: DataFrame, near_null: DataFrame, level: float = 0.95) -> DataFrame:
    """Range profile per pair and what may be reported about it.

    ``near_null(specimen, lambda_t1)`` sets the support threshold of a specimen.
    """
    threshold = evidence.support_threshold(near_null, ["specimen"])
    profiles = ranges.range_profiles(data, exposures)
    report = range_report("ell_hat", "best_index", F.size("ells"), "support", "threshold",
                          F.array_min("ells"), F.array_max("ells"), F.lit(float(level)))
    return profiles.join(threshold, "specimen").withColumn("report", report).select(
        *KEYS, "ell_hat", "best_index", F.size("ells").alias("n_ranges"), "support", "threshold", "dispersion", "amplitude", "n", "report.*")

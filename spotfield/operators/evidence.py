"""Multiple testing, support thresholds, folds and robustness predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.order_stats import bucket_carry, exact_quantile, range_bucketed
from ..functions.scalar import NAN, at_most, bits_between
from ..runtime import materialise


def fdr(pvalues: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Benjamini-Hochberg ``q`` within each family; a NaN makes its family NaN.

    Equal p-values get equal q whatever their order, so they are counted first
    (bootstrap p-values repeat heavily).  Ranks and the reverse running minimum
    are scanned inside range-partitioned buckets.
    """
    keyed = pvalues if family else pvalues.withColumn("_family", F.lit(0))
    keys = family or ["_family"]
    counted = keyed.groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_c"))
    b = range_bucketed(counted, [*keys, "_p"], "pvalues")

    size = materialise(
        b.groupBy(*keys).agg(F.sum("_c").alias("_m"), F.max(F.isnan("_p").cast("int")).alias("_nan")), "families")
    before = bucket_carry(b, keys, F.sum("_c"))
    up = Window.partitionBy(*keys, "_bucket").orderBy("_p")
    ranked = (
        b.join(before, [*keys, "_bucket"]).join(size, keys)
        .withColumn("_rank", F.coalesce("_carry", F.lit(0)) + F.sum("_c").over(up)).drop("_carry")
        .withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank")))
    after = bucket_carry(ranked, keys, F.min("_raw"), reverse=True, how=F.min)
    down = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_p").desc())
    q = F.least(F.min("_raw").over(down), F.coalesce("_carry", F.lit(1.0)), F.lit(1.0))
    levels = (
        ranked.join(after, [*keys, "_bucket"])
        .select(*keys, "_p", F.when(F.col("_nan") == 1, F.lit(NAN)).otherwise(q).alias("q")))
    levels = materialise(levels, "fdr")
    joined = keyed.withColumn("_p", F.col(p)).join(levels, [*keys, "_p"]).drop("_p")
    return joined if family else joined.drop("_family")


def support_threshold(near_null: DataFrame, keys: list[str], statistic: str = "lambda_t1") -> DataFrame:
    """99 % point of the finite near-null statistics; NaN for a group without any."""
    groups = near_null.select(*keys).distinct()
    found = exact_quantile(near_null, keys, statistic, 0.99, "threshold")
    return groups.join(found, keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(NAN)))


def checkerboard_folds(points: DataFrame, blocks: int = 8) -> DataFrame:
    """Alternate a ``blocks`` x ``blocks`` grid over each specimen into two folds."""
    box = materialise(
        points.groupBy("specimen").agg(
            F.min("x_um").alias("_x0"), F.max("x_um").alias("_x1"),
            F.min("y_um").alias("_y0"), F.max("y_um").alias("_y1")), "extent")

    def cell(v, low, high):
        share = (F.col(v) - F.col(low)) / F.greatest(F.col(high) - F.col(low), F.lit(1e-9))
        return F.greatest(F.lit(0), F.least(F.lit(blocks - 1), (share * F.lit(blocks)).cast("int")))

    return points.join(box, "specimen").withColumn(
        "fold", (cell("x_um", "_x0", "_x1") + cell("y_um", "_y0", "_y1")) % 2).drop("_x0", "_x1", "_y0", "_y1")


def _all_true(condition):
    return F.min(condition.cast("int")) == 1


def specificity(fold_r2: DataFrame, keys: list[str], r2: str = "r2", threshold: float = S.SPECIFICITY_R2) -> DataFrame:
    """Supported when there are two folds or more and each reaches the threshold."""
    reached = F.coalesce(~F.isnan(r2) & (F.col(r2) >= F.lit(float(threshold))), F.lit(False))
    return fold_r2.groupBy(*keys).agg(((F.count("*") >= 2) & _all_true(reached)).alias("supported"))


def anisotropy_robust(refits: DataFrame, keys: list[str], range_um: str = "range_um", bound: float = S.RANGE_SPREAD_BITS) -> DataFrame:
    """Ranges refitted under anisotropy multipliers stay within ``bound`` bits."""
    bits = bits_between(F.max(range_um), F.min(range_um))
    return refits.groupBy(*keys).agg(bits.alias("spread_bits")).withColumn("robust", at_most("spread_bits", bound))


def response_robust(refits: DataFrame, keys: list[str], range_um: str = "range_um", reference: str = "reference_um", bound: float = S.RANGE_SPREAD_BITS) -> DataFrame:
    """The largest shift of any refit from its reference stays within ``bound`` bits."""
    return (
        refits.groupBy(*keys).agg(F.max(bits_between(range_um, reference)).alias("shift_bits"))
        .withColumn("robust", at_most("shift_bits", bound)))

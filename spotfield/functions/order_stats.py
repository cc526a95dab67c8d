"""Exact quantiles and ranked scans that never gather a group in one task.

A specimen may hold most of the rows, so neither ``percentile`` (which keeps
every distinct value of a group in one buffer) nor a window over a whole group
is used.  Quantiles narrow a bracket with small histograms; ranked scans run
inside range-partitioned buckets and join them through per-bucket totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import finite, materialise

HISTOGRAM_BINS = 4096
SMALL_BRACKET = 1_000_000


def exact_quantile(values: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Linear-interpolated ``q`` quantile of the finite values of each group.

    Returns ``keys + [name]``; groups without finite values are absent.
    """
    if not keys:
        out = exact_quantile(values.withColumn("_all", F.lit(0)), ["_all"], value, q, name)
        return out.drop("_all")

    v = values.where(finite(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    rank = F.lit(float(q)) * (F.col("_n") - F.lit(1))
    state = materialise(
        v.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .select(*keys, "_lo", "_hi", F.col("_n").alias("_inside"), F.lit(0).cast("long").alias("_before"),
                F.floor(rank).alias("_k0"), F.ceil(rank).alias("_k1"), (rank - F.floor(rank)).alias("_frac")),
        "quantile")

    before = None
    while True:
        widest = state.where(F.col("_hi") > F.col("_lo")).agg(F.max("_inside")).first()[0]
        if widest is None or widest <= SMALL_BRACKET or widest == before:
            break
        before = widest
        state = _narrow(v, state, keys)

    inside = v.join(state, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    # Equal values collapse before any ordering, so ties cost nothing.
    counted = inside.groupBy(*keys, "_v").agg(
        F.count("*").alias("_c"), *[F.first(c).alias(c) for c in ("_before", "_k0", "_k1", "_frac")])
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")) + F.col("_before")
    ranked = counted.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(k):
        return F.max(F.when((F.col("_start") <= F.col(k)) & (F.col(k) < F.col("_end")), F.col("_v")))

    return (
        ranked.groupBy(*keys).agg(at("_k0").alias("_a"), at("_k1").alias("_b"), F.first("_frac").alias("_frac"))
        .select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).alias(name))
    )


def _narrow(v: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Shrink each group's bracket to the histogram bins that hold its ranks."""
    width = F.col("_hi") - F.col("_lo")
    position = F.floor((F.col("_v") - F.col("_lo")) / F.when(width > 0, width) * F.lit(HISTOGRAM_BINS))
    binned = (
        v.join(state, keys).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        .withColumn("_bin", F.coalesce(F.least(position, F.lit(HISTOGRAM_BINS - 1)), F.lit(0))))
    hist = binned.groupBy(*keys, "_bin").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_vmin"), F.max("_v").alias("_vmax"),
        *[F.first(c).alias(c) for c in ("_before", "_k0", "_k1", "_frac")])
    w = Window.partitionBy(*keys).orderBy("_bin")  # at most HISTOGRAM_BINS rows per group
    hist = hist.withColumn("_end", F.col("_before") + F.sum("_c").over(w)).withColumn("_start", F.col("_end") - F.col("_c"))
    hit = hist.where(
        ((F.col("_start") <= F.col("_k0")) & (F.col("_k0") < F.col("_end")))
        | ((F.col("_start") <= F.col("_k1")) & (F.col("_k1") < F.col("_end"))))
    return materialise(
        hit.groupBy(*keys).agg(
            F.min("_vmin").alias("_lo"), F.max("_vmax").alias("_hi"), F.sum("_c").alias("_inside"),
            F.min("_start").alias("_before"), F.first("_k0").alias("_k0"), F.first("_k1").alias("_k1"),
            F.first("_frac").alias("_frac")),
        "quantile")


def range_bucketed(df: DataFrame, order: list[str], label: str = "ranked") -> DataFrame:
    """Write ``df`` range-partitioned on ``order`` with its bucket number.

    Buckets are contiguous in the ordering and balanced by sampling, however
    the leading key is distributed.
    """
    return materialise(
        df.repartitionByRange(*[F.col(c).asc() for c in order]).withColumn("_bucket", F.spark_partition_id()), label)


def bucket_carry(bucketed: DataFrame, keys: list[str], total, reverse: bool = False, how=F.sum) -> DataFrame:
    """Combine whole-bucket totals of the buckets before (or after) each one."""
    totals = bucketed.groupBy(*keys, "_bucket").agg(total.alias("_total"))
    order = F.col("_bucket").desc() if reverse else F.col("_bucket").asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "_bucket", how("_total").over(w).alias("_carry"))

"""Orientation field from eosin, its controls, and tensor sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalar import tensor
from ..kernels.image import gradients, orientation
from .tiles import TILE, blur_reach, over_tiles

PIXEL_BLOCK = 64


def orientation_field(tissue: DataFrame, extent: DataFrame, tile: int = TILE) -> DataFrame:
    """(specimen, row, col, theta, coherency, crossing, beta, in_tissue).

    ``theta`` follows tissue lines; ``beta`` is the transport anisotropy, zero
    off tissue and where orientations are weak or cross.
    """

    def kernel(arrays, px, _):
        theta, coherency, crossing = orientation(
            arrays["eosin"], S.DERIVATIVE_BLUR_UM / px, S.TENSOR_BLUR_UM / px)
        return {"theta": theta, "coherency": coherency, "crossing": crossing, "in_tissue": arrays["in_tissue"]}

    halo = blur_reach(S.DERIVATIVE_BLUR_UM) + blur_reach(S.TENSOR_BLUR_UM) + F.lit(2)
    field = over_tiles(tissue, extent, halo, ["eosin", "in_tissue"],
                       {"theta": "double", "coherency": "double", "crossing": "double", "in_tissue": "boolean"},
                       kernel, tile)
    return field.withColumn("beta", anisotropy("coherency", "crossing", "in_tissue"))


def anisotropy(coherency, crossing, in_tissue):
    floor = S.COHERENCY_FLOOR
    share = (F.col(coherency) - F.lit(floor)) / F.lit(1.0 - floor)
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.when(F.col(in_tissue) & (F.col(crossing) <= F.lit(S.CROSSING_CEILING)),
                  F.lit(S.BETA_CEILING) * strength).otherwise(F.lit(0.0))


def image_gradients(pixels: DataFrame, extent: DataFrame, column: str, tile: int = TILE) -> DataFrame:
    """Prefiltered derivatives (ex, ey) of one raster column."""

    def kernel(arrays, px, _):
        ex, ey = gradients(arrays[column].astype(float))
        return {"ex": ex, "ey": ey}

    return over_tiles(pixels, extent, F.lit(2), [column], {"ex": "double", "ey": "double"}, kernel, tile)


def isotropic(field: DataFrame) -> DataFrame:
    return field.withColumns({"theta": F.lit(0.0), "beta": F.lit(0.0)})


def rotated(field: DataFrame, degrees: float = 90.0) -> DataFrame:
    return field.withColumn("theta", F.col("theta") + F.radians(F.lit(float(degrees))))


def block_moves(extent: DataFrame, block_um: float = 64.0, seed: int = 0) -> DataFrame:
    """Seeded permutation of each specimen's whole blocks.

    One row per block: (specimen, block_px, from_i, from_j, to_i, to_j).
    Specimens with fewer than two blocks along an axis get none.
    """

    def run(frames):
        for pdf in frames:
            for s, n_rows, n_cols, px in pdf[["specimen", "n_rows", "n_cols", "pixel_size_um"]].itertuples(index=False):
                side = max(1, int(round(block_um / px)))
                nr, nc = int(n_rows // side), int(n_cols // side)
                if nr < 2 or nc < 2:
                    continue
                source = np.arange(nr * nc)
                target = np.random.default_rng(int(seed)).permutation(nr * nc)
                yield pd.DataFrame({
                    "specimen": s, "block_px": side, "from_i": source // nc, "from_j": source % nc,
                    "to_i": target // nc, "to_j": target % nc})

    kind = dict(extent.dtypes)["specimen"]
    return extent.mapInPandas(
        run, f"specimen {kind}, block_px long, from_i long, from_j long, to_i long, to_j long")


def move_blocks(field: DataFrame, moves: DataFrame) -> DataFrame:
    """Carry theta and beta of each block to its target; the rest stays in place."""
    side = moves.groupBy("specimen").agg(F.first("block_px").alias("block_px"))
    at = field.join(side, "specimen", "left").withColumns({
        "from_i": F.floor(F.col("row") / F.col("block_px")), "from_j": F.floor(F.col("col") / F.col("block_px"))})
    shift = moves.drop("block_px")
    moved = at.join(shift, ["specimen", "from_i", "from_j"], "left").select(
        "specimen",
        F.coalesce(F.col("row") + (F.col("to_i") - F.col("from_i")) * F.col("block_px"), "row").alias("row"),
        F.coalesce(F.col("col") + (F.col("to_j") - F.col("from_j")) * F.col("block_px"), "col").alias("col"),
        "theta", F.col("beta").alias("_beta"))
    return (
        field.drop("theta", "beta").join(moved, ["specimen", "row", "col"])
        .withColumn("beta", F.when(F.col("in_tissue"), F.col("_beta")).otherwise(F.lit(0.0))).drop("_beta"))


def morphology_mismatch(field: DataFrame, extent: DataFrame, block_um: float = 64.0, seed: int = 0) -> DataFrame:
    """Control with the orientation field shuffled in whole blocks."""
    return move_blocks(field, block_moves(extent, block_um, seed))


def tensor_at(points: DataFrame, field: DataFrame, extent: DataFrame, x: str = "x_um", y: str = "y_um",
              beta_scale: float = 1.0, tasks: int | None = None) -> DataFrame:
    """Add (a11, a12, a22) at each point's nearest pixel, clamped to the raster.

    With ``tasks``, points meet the raster in blocks of pixels, so that neighbours
    stay in one task, of which there are that many if Spark's own number is less.
    """

    def index(v, n):
        near = F.rint(F.col(v) / F.col("pixel_size_um"))
        return F.greatest(F.lit(0.0), F.least(near, F.col(n) - F.lit(1.0))).cast("long")

    pixel = field.select(
        "specimen", F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col"), "theta",
        F.when(F.col("in_tissue"), F.col("beta") * F.lit(float(beta_scale))).otherwise(F.lit(0.0)).alias("beta"))
    at = points.join(extent, "specimen").withColumns({"_row": index(y, "n_rows"), "_col": index(x, "n_cols")})
    if tasks is None:
        out = at.join(pixel, ["specimen", "_row", "_col"])
    else:
        out = _met_in_blocks(at.select(*points.columns, "_row", "_col"), pixel, tasks)
    out = out.withColumn("_t", tensor("theta", "beta"))
    return out.select(*points.columns, "_t.a11", "_t.a12", "_t.a22")


def _met_in_blocks(at: DataFrame, pixel: DataFrame, tasks: int) -> DataFrame:
    """Inner join of points and pixels on (specimen, _row, _col), block by block."""
    block = ["specimen", "_block_row", "_block_col"]
    parts = max(tasks, int(at.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df):
        return df.withColumns({b: F.floor(F.col(c) / F.lit(PIXEL_BLOCK)) for b, c in zip(block[1:], ("_row", "_col"))}).where(
            F.col("specimen").isNotNull() & F.col("_row").isNotNull() & F.col("_col").isNotNull()).repartition(parts, *block).groupBy(*block)

    mine, names = at.columns, [*at.columns, "theta", "beta"]

    def run(key, left, right):
        seen = right.select(["_row", "_col", "theta", "beta"])
        return left.select(mine).join(seen, ["_row", "_col"], join_type="inner", use_threads=False).select(names)

    kinds = {**dict(pixel.dtypes), **dict(at.dtypes)}
    return dealt(at).cogroup(dealt(pixel)).applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def anisotropic_fraction(field: DataFrame) -> DataFrame:
    """Share of tissue pixels with any anisotropy; 0 without tissue."""
    share = F.avg(F.when(F.col("in_tissue"), (F.col("beta") > 0).cast("double")))
    return field.groupBy("specimen").agg(F.coalesce(share, F.lit(0.0)).alias("anisotropic_fraction"))

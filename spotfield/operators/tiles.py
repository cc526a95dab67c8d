"""Raster stencils over bounded tiles with a halo.

One shuffle brings each tile its own pixels plus a rim wide enough for every
filter in the chain; the kernel runs once and only the tile's core is emitted.
A raster of any size, or one specimen that holds most pixels, becomes many
equal groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

TILE = 256


def raster_extent(pixels: DataFrame, specimens: DataFrame) -> DataFrame:
    """(specimen, n_rows, n_cols, pixel_size_um); rasters must be complete."""
    size = pixels.groupBy("specimen").agg(
        (F.max("row") + 1).cast("long").alias("n_rows"), (F.max("col") + 1).cast("long").alias("n_cols"),
        F.count("*").alias("n_pixels"))
    out = materialise(size.join(specimens.select("specimen", F.col("pixel_size_um").cast("double")), "specimen"), "extent")
    if out.where(F.col("n_pixels") != F.col("n_rows") * F.col("n_cols")).limit(1).count():
        raise ValueError("a raster must hold every (row, col) exactly once")
    return out.drop("n_pixels")


def blur_reach(sigma_um: float) -> Column:
    return F.floor(F.lit(4.0) * F.greatest(F.lit(float(sigma_um)) / F.col("pixel_size_um"), F.lit(1e-6)) + F.lit(0.5))


def disk_reach(radius_um: float) -> Column:
    return F.ceil(F.lit(float(radius_um)) / F.col("pixel_size_um"))


def over_tiles(pixels: DataFrame, extent: DataFrame, halo: Column, inputs: list[str], outputs: dict[str, str],
               kernel, tile: int = TILE) -> DataFrame:
    """Run ``kernel(arrays, pixel_size_um, origin)`` on every tile.

    ``arrays`` maps each input to a 2-D array over tile and halo; the kernel
    returns arrays of the same shape for ``outputs`` (name to SQL type).
    ``origin`` is the core as (row slice, column slice) and its first pixel.
    """
    p = pixels.select("specimen", "row", "col", *inputs).join(extent, "specimen").withColumn("_halo", halo.cast("long"))

    def tiles(v, n):
        low = F.greatest(F.lit(0), F.floor((F.col(v) - F.col("_halo")) / F.lit(tile)))
        high = F.least(F.floor((F.col(n) - 1) / F.lit(tile)), F.floor((F.col(v) + F.col("_halo")) / F.lit(tile)))
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    spread = (
        p.withColumn("_tr", tiles("row", "n_rows")).withColumn("_tc", tiles("col", "n_cols"))
        .select("specimen", "_tr", "_tc", "pixel_size_um", "row", "col", *inputs))
    types = dict(pixels.dtypes)
    schema = ", ".join([f"specimen {types['specimen']}", f"row {types['row']}", f"col {types['col']}"]
                       + [f"{n} {t}" for n, t in outputs.items()])
    names = list(outputs)

    def run(key, pdf):
        specimen, tr, tc, px = key
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = r.min(), c.min()
        shape = (r.max() - r0 + 1, c.max() - c0 + 1)
        if shape[0] * shape[1] != len(pdf):
            raise ValueError(f"incomplete tile ({tr}, {tc}) of specimen {specimen}")
        at = (r - r0) * shape[1] + (c - c0)
        arrays = {}
        for name in inputs:
            source = pdf[name].to_numpy()
            flat = np.empty(len(pdf), dtype=source.dtype)
            flat[at] = source
            arrays[name] = flat.reshape(shape)
        top, left = tr * tile, tc * tile
        core = (slice(top - r0, min(top - r0 + tile, shape[0])), slice(left - c0, min(left - c0 + tile, shape[1])))
        result = kernel(arrays, float(px), (core, top, left))
        rows, cols = np.mgrid[core]
        frame = {"specimen": specimen, "row": (rows + r0).ravel(), "col": (cols + c0).ravel()}
        frame.update({n: np.asarray(result[n])[core].ravel() for n in names})
        return pd.DataFrame(frame)

    return spread.groupBy("specimen", "_tr", "_tc", "pixel_size_um").applyInPandas(run, schema)

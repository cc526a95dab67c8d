"""Stain separation and the tissue mask."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.scalar import length3, optical_density, stain_amount, unmixing_weights
from ..kernels.image import blur, disk_offsets, local_components, open_then_close
from ..runtime import finite, materialise, require_columns
from .components import ROW_STEP, SMALL_GRAPH, border_links, connected_components
from .tiles import TILE, blur_reach, disk_reach, over_tiles, raster_extent


def optical_densities(pixels: DataFrame) -> DataFrame:
    """Add od_r, od_g, od_b; images scaled to [0, 1] are first brought to [0, 255]."""
    require_columns(pixels, ["specimen", "row", "col", "r", "g", "b"], "pixels")
    peak = materialise(
        pixels.groupBy("specimen").agg(F.max(F.greatest("r", "g", "b")).alias("_peak")), "peak")
    factor = F.when(F.col("_peak") <= F.lit(1.0 + 1e-9), F.lit(255.0)).otherwise(F.lit(1.0))
    return pixels.join(peak, "specimen").withColumns(
        {f"od_{c}": optical_density(c, factor) for c in "rgb"}).drop("_peak")


def stains(od: DataFrame) -> DataFrame:
    """Add hematoxylin, eosin and the optical-density norm."""
    weights = unmixing_weights()
    return od.withColumns({
        "hematoxylin": stain_amount(weights[0], "od_r", "od_g", "od_b"),
        "eosin": stain_amount(weights[1], "od_r", "od_g", "od_b"),
        "residual": stain_amount(weights[2], "od_r", "od_g", "od_b"),
        "od_norm": length3("od_r", "od_g", "od_b")})


def smoothed(pixels: DataFrame, extent: DataFrame, column: str, sigma_um: float, out: str = "smooth",
             keep: list[str] = (), tile: int = TILE) -> DataFrame:
    """Gaussian blur of one column at ``sigma_um``; ``keep`` columns ride along."""
    types = dict(pixels.dtypes)

    def kernel(arrays, px, _):
        return {out: blur(arrays[column].astype(float), sigma_um / px), **{k: arrays[k] for k in keep}}

    inputs = list(dict.fromkeys([column, *keep]))
    return over_tiles(pixels, extent, blur_reach(sigma_um), inputs,
                      {out: "double", **{k: types[k] for k in keep}}, kernel, tile)


def otsu_thresholds(values: DataFrame, value: str, bins: int = S.OTSU_BINS) -> DataFrame:
    """Otsu threshold per specimen: the centre of the first best histogram bin."""
    v = values.where(finite(value)).select("specimen", F.col(value).alias("_v"))
    span = materialise(v.groupBy("specimen").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "span")
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    bin_of = F.coalesce(F.least(F.floor((F.col("_v") - F.col("_lo")) / width * F.lit(bins)), F.lit(bins - 1)), F.lit(0))
    counts = v.join(span, "specimen").groupBy("specimen", bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    center = F.col("_lo") + (F.col("bin") + F.lit(0.5)) * (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    h = every.join(counts, ["specimen", "bin"], "left").select(
        "specimen", "_lo", "_hi", "bin", center.alias("center"), F.coalesce("n", F.lit(0)).cast("double").alias("n"))
    w = Window.partitionBy("specimen").orderBy("bin")
    whole = Window.partitionBy("specimen")
    h = h.withColumns({"below": F.sum("n").over(w), "moment": F.sum(F.col("n") * F.col("center")).over(w),
                       "total": F.sum("n").over(whole), "grand": F.sum(F.col("n") * F.col("center")).over(whole)})
    above = F.col("total") - F.col("below")
    gap = F.col("moment") / F.greatest("below", F.lit(1.0)) - (F.col("grand") - F.col("moment")) / F.greatest(above, F.lit(1.0))
    between = F.when((F.col("below") > 0) & (above > 0), F.col("below") * above * gap * gap).otherwise(F.lit(-1.0))
    best = h.withColumn("between", between).groupBy("specimen").agg(
        F.max(F.struct("between", (-F.col("bin")).alias("first"), "center")).alias("best"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return best.select("specimen", F.when(F.col("_hi") > F.col("_lo"), F.col("best.center")).otherwise(F.col("_hi")).alias("threshold"))


def opened_and_closed(pixels: DataFrame, extent: DataFrame, column: str, keep: list[str] = (), tile: int = TILE,
                      opening_um: float = S.OPENING_UM, closing_um: float = S.CLOSING_UM) -> DataFrame:
    """Binary opening then closing, with a tile-local component label.

    Adds ``mask`` and ``label`` (-1 outside the mask).
    """
    types = dict(pixels.dtypes)

    def kernel(arrays, px, origin):
        core, top, left = origin
        mask = open_then_close(arrays[column].astype(bool), disk_offsets(opening_um / px), disk_offsets(closing_um / px))
        inner = mask[core]
        flat = local_components(inner, False)
        label = np.full(mask.shape, -1, dtype=np.int64)
        label[core] = np.where(inner, (flat // inner.shape[1] + top) * ROW_STEP + flat % inner.shape[1] + left, -1)
        return {"mask": mask, "label": label, **{k: arrays[k] for k in keep}}

    halo = disk_reach(opening_um) * 2 + disk_reach(closing_um) * 2
    return over_tiles(pixels, extent, halo, list(dict.fromkeys([column, *keep])),
                      {"mask": "boolean", "label": "long", **{k: types[k] for k in keep}}, kernel, tile)


def drop_small_components(labelled: DataFrame, extent: DataFrame, tile: int = TILE, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """Keep four-connected components of at least 500 square micrometres.

    Adds ``component`` (first cell of the component, null outside tissue).
    """
    inside = labelled.where("mask").select("specimen", "row", "col", "label")
    roots = connected_components(border_links(inside, False, tile), small_graph)
    sizes = inside.groupBy("specimen", "label").agg(F.count("*").alias("n"))
    needed = F.ceil(F.lit(S.SMALLEST_TISSUE_UM2) / (F.col("pixel_size_um") * F.col("pixel_size_um")))
    by_root = materialise(
        sizes.join(roots, ["specimen", "label"], "left")
        .select("specimen", "label", F.coalesce("root", "label").alias("component"), "n"), "labels")
    large = (
        by_root.groupBy("specimen", "component").agg(F.sum("n").alias("n")).join(extent, "specimen")
        .where((needed <= 1) | (F.col("n") >= needed)).select("specimen", "component"))
    kept = materialise(by_root.select("specimen", "label", "component").join(large, ["specimen", "component"]), "labels")
    # background has no label: keys of its own, below all labels, deal it evenly and match nothing
    spread = F.when(F.col("mask"), F.col("label")).otherwise(-1 - F.pmod(F.xxhash64("row", "col"), F.lit(1 << 20)))
    return labelled.withColumn("label", spread).join(kept, ["specimen", "label"], "left").drop("label")


def tissue(pixels: DataFrame, specimens: DataFrame, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Stain rasters with the tissue mask, and the raster extent.

    ``pixels(specimen, row, col, r, g, b[, capture])`` to
    ``(specimen, row, col, hematoxylin, eosin, od_norm, in_tissue, component)``.
    With ``capture``, only captured pixels inform the threshold or can be tissue.
    """
    extent = raster_extent(pixels, specimens)
    has_capture = "capture" in pixels.columns
    keep = ["hematoxylin", "eosin", "od_norm"] + (["capture"] if has_capture else [])
    base = stains(optical_densities(pixels)).select("specimen", "row", "col", *keep)
    smooth = materialise(smoothed(base, extent, "od_norm", S.MASK_BLUR_UM, keep=keep, tile=tile), "smooth")
    seen = smooth.where("capture") if has_capture else smooth
    threshold = materialise(otsu_thresholds(seen, "smooth"), "otsu")
    above = F.col("smooth") > F.col("threshold")
    raw = smooth.join(threshold, "specimen").withColumn("raw_mask", above & F.col("capture") if has_capture else above)
    labelled = materialise(
        opened_and_closed(raw, extent, "raw_mask", keep=["hematoxylin", "eosin", "od_norm"], tile=tile), "opened")
    out = materialise(
        drop_small_components(labelled, extent, tile)
        .select("specimen", "row", "col", "hematoxylin", "eosin", "od_norm",
                F.col("component").isNotNull().alias("in_tissue"), "component"), "tissue")
    empty = extent.join(out.where("in_tissue").select("specimen").distinct(), "specimen", "left_anti")
    bad = [r[0] for r in empty.select("specimen").limit(10).collect()]
    if bad:
        raise ValueError(f"no tissue was found in specimen(s) {', '.join(map(str, bad))}")
    return out, extent


def tissue_summary(tissue_pixels: DataFrame, extent: DataFrame) -> DataFrame:
    """Raster shape, tissue area and tissue share per specimen."""
    return (
        tissue_pixels.groupBy("specimen").agg(
            F.count_if("in_tissue").alias("tissue_pixels"), F.count("*").alias("pixels"))
        .join(extent, "specimen")
        .select("specimen", "n_rows", "n_cols",
                (F.col("tissue_pixels") * F.col("pixel_size_um") * F.col("pixel_size_um")).alias("tissue_area_um2"),
                (F.lit(100.0) * F.col("tissue_pixels") / F.col("pixels")).alias("tissue_percent")))


def disk(radius_px: float, spark) -> DataFrame:
    """Structuring element offsets as rows (dy, dx); empty below one pixel."""
    r = math.ceil(radius_px) if radius_px >= 1.0 else -1
    line = F.sequence(F.lit(-r), F.lit(r)) if r >= 0 else F.array().cast("array<int>")
    limit = F.lit(radius_px * radius_px + 1e-9)
    return (
        spark.range(1).select(F.explode(line).alias("dy")).withColumn("dx", F.explode(line))
        .where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= limit))

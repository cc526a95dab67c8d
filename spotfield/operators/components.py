"""Connected components of raster cells: tile-local labels joined at borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.image import local_components
from ..runtime import materialise
from .tiles import TILE

SMALL_GRAPH = 500_000
ROW_STEP = 1 << 32  # a label is row * ROW_STEP + col of the component's first cell


def label_cells(cells: DataFrame, diagonal: bool, tile: int = TILE) -> DataFrame:
    """Label sparse cells (specimen, row, col) inside each tile; adds ``label``."""

    def run(key, pdf):
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = r.min(), c.min()
        mask = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), dtype=bool)
        mask[r - r0, c - c0] = True
        flat = local_components(mask, diagonal)[r - r0, c - c0]
        label = (flat // mask.shape[1] + r0) * ROW_STEP + flat % mask.shape[1] + c0
        return pd.DataFrame({"specimen": key[0], "row": r, "col": c, "label": label})

    return (
        cells.select("specimen", F.col("row").cast("long"), F.col("col").cast("long"),
                     F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc"))
        .groupBy("specimen", "_tr", "_tc")
        .applyInPandas(run, f"specimen {dict(cells.dtypes)['specimen']}, row long, col long, label long"))


def border_links(labelled: DataFrame, diagonal: bool, tile: int = TILE) -> DataFrame:
    """Label pairs (a, b) that touch across a tile border."""
    r, c = F.col("row"), F.col("col")
    rim = labelled.where((r % tile == 0) | (r % tile == tile - 1) | (c % tile == 0) | (c % tile == tile - 1))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    offsets = F.array(*[F.struct(F.lit(dy).cast("long").alias("dy"), F.lit(dx).cast("long").alias("dx")) for dy, dx in steps])
    asks = rim.withColumn("o", F.explode(offsets)).select(
        "specimen", F.col("label").alias("a"), (r + F.col("o.dy")).alias("row"), (c + F.col("o.dx")).alias("col"))
    b = rim.select("specimen", "row", "col", F.col("label").alias("b"))
    return asks.join(b, ["specimen", "row", "col"]).where("a <> b").select("specimen", "a", "b").distinct()


def connected_components(links: DataFrame, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """Lowest label reachable from each linked label: (specimen, label, root).

    ``links`` is a border graph, far smaller than the raster.  A measured small
    one is solved per specimen; beyond that, labels hook to their lowest
    neighbour and jump pointers until nothing changes.
    """
    links = materialise(links, "links")
    spec_type = dict(links.dtypes)["specimen"]
    size = links.count()
    if size == 0:  # a single tile: nothing to merge
        return links.select("specimen", F.col("a").alias("label"), F.col("b").alias("root"))
    if size <= small_graph:
        return links.groupBy("specimen").applyInPandas(_union_links, f"specimen {spec_type}, label long, root long")

    both = materialise(links.unionByName(links.select("specimen", F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    state = materialise(
        both.groupBy("specimen", F.col("a").alias("label"))
        .agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        offered = (
            both.join(state.select("specimen", F.col("label").alias("b"), "root"), ["specimen", "b"])
            .groupBy("specimen", F.col("a").alias("label")).agg(F.min("root").alias("offer")))
        hooked = state.join(offered, ["specimen", "label"]).select(
            "specimen", "label", F.col("root").alias("old"), F.least("root", "offer").alias("mid"))
        target = state.select("specimen", F.col("label").alias("mid"), F.col("root").alias("jump"))
        moved = materialise(
            hooked.join(target, ["specimen", "mid"], "left")
            .select("specimen", "label", "old", F.least("mid", F.coalesce("jump", "mid")).alias("root")), "roots")
        if moved.where("old <> root").limit(1).count() == 0:
            return moved.select("specimen", "label", "root")
        state = moved.drop("old")


def _union_links(pdf):
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    labels = list(parent)
    return pd.DataFrame({"specimen": pdf["specimen"].iloc[0], "label": labels, "root": [find(v) for v in labels]})


def with_roots(labelled: DataFrame, diagonal: bool, tile: int = TILE, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """Replace tile-local labels by whole-raster ones in column ``root``."""
    roots = materialise(connected_components(border_links(labelled, diagonal, tile), small_graph), "roots")
    return labelled.join(roots, ["specimen", "label"], "left").withColumn("root", F.coalesce("root", "label"))

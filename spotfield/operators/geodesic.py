"""Distances along the edges of lattice meshes of any size, tile by tile.

A tile holds its own nodes and a rim of one node.  In a round every tile lowers its
distances as far as it can and tells the neighbours which of its border nodes fell; a
tile that hears nothing does nothing.  Rounds end when no tile has anything to tell, so
their number is that of the tiles that shortest paths cross.  All components of all
specimens advance together, and no task holds more than a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.paths import ROOT, UNREACHED, lengths, links, node_labels, relax, told
from ..runtime import materialise, ship_package
from .mesh import Mesh
from .tiles import TILE

STATE, NEWS = 0, 1
KEY = ["specimen", "tj", "ti"]


def _schema(kind: str) -> str:
    return f"specimen {kind}, tj int, ti int, kind int, labels binary, at binary, sides binary, diagonals binary"


def _tiles(mesh: Mesh, tile: int) -> DataFrame:
    """One row a tile, no node reached; a cell belongs to every tile that owns one of its corners."""
    kind = dict(mesh.cells.dtypes)["specimen"]

    def owners(v):
        return F.explode(F.array_distinct(F.array(F.floor(F.col(v) / tile).cast("int"), F.floor((F.col(v) + 1) / tile).cast("int"))))

    dealt = mesh.cells.withColumn("tj", owners("j")).withColumn("ti", owners("i")).select(*KEY, "j", "i", "component")

    def run(key, pdf):
        specimen, tj, ti = key
        labels = np.full((tile + 1, tile + 1), -1, dtype=np.int32)
        labels[pdf["j"].to_numpy() - (tj * tile - 1), pdf["i"].to_numpy() - (ti * tile - 1)] = pdf["component"].to_numpy()
        none = np.full((tile + 2) ** 2, UNREACHED, dtype=np.int32).tobytes()
        return pd.DataFrame({"specimen": [specimen], "tj": [tj], "ti": [ti], "kind": [STATE], "labels": [labels.tobytes()], "at": [None], "sides": [none], "diagonals": [none]})

    return dealt.groupBy(*KEY).applyInPandas(run, _schema(kind))


def _advance(rows: DataFrame, tile: int, kind: str) -> DataFrame:
    """A round: tiles with news relax, and news for their neighbours follow."""
    width = tile + 2

    def run(key, pdf):
        specimen, tj, ti = key
        state, news = pdf[pdf["kind"] == STATE], pdf[pdf["kind"] == NEWS]
        if state.empty or news.empty:
            return state
        state = state.iloc[0]
        labels = np.frombuffer(state["labels"], dtype=np.int32).reshape(tile + 1, tile + 1)
        sides, diagonals = (np.frombuffer(state[c], dtype=np.int32).reshape(width, width).copy() for c in ("sides", "diagonals"))
        leads = links(labels, tj * tile - 1, ti * tile - 1)
        at = np.frombuffer(b"".join(news["at"]), dtype=np.int64).reshape(-1, 2) - [tj * tile - 1, ti * tile - 1]
        heard = at[:, 0] * width + at[:, 1]
        a, b = (np.frombuffer(b"".join(news[c]), dtype=np.int32) for c in ("sides", "diagonals"))
        less = lengths(a, b) < lengths(sides.ravel()[heard], diagonals.ravel()[heard])
        sides.ravel()[heard[less]], diagonals.ravel()[heard[less]] = a[less], b[less]
        # a source of its own is news to the neighbours too
        r, c = at[less].T
        own = heard[less][(r > 0) & (r < width - 1) & (c > 0) & (c < width - 1)]
        fell = np.union1d(relax(leads, sides, diagonals, heard[less]), own)
        out = [(specimen, tj, ti, STATE, state["labels"], None, sides.tobytes(), diagonals.tobytes())]
        for up, side, nodes in told(leads, fell):
            where = np.stack(np.divmod(nodes, width), axis=1) + [tj * tile - 1, ti * tile - 1]
            out.append((specimen, tj + up, ti + side, NEWS, None, where.astype(np.int64).tobytes(), sides.ravel()[nodes].tobytes(), diagonals.ravel()[nodes].tobytes()))
        return pd.DataFrame(out, columns=[*KEY, "kind", "labels", "at", "sides", "diagonals"])

    return rows.groupBy(*KEY).applyInPandas(run, _schema(kind))


def _settled(tiles: DataFrame, sources: DataFrame, tile: int, kind: str) -> DataFrame:
    """Tiles with the distance of every node from its component's source; ``sources`` has (specimen, component, j, i)."""

    def started(batches):
        zero = np.zeros(1, dtype=np.int32).tobytes()
        for pdf in batches:
            at = pdf[["j", "i"]].to_numpy(dtype=np.int64)
            yield pd.DataFrame({
                "specimen": pdf["specimen"], "tj": (at[:, 0] // tile).astype(np.int32), "ti": (at[:, 1] // tile).astype(np.int32), "kind": np.full(len(pdf), NEWS, dtype=np.int32),
                "labels": None, "at": [p.tobytes() for p in at], "sides": zero, "diagonals": zero})

    rows = tiles.unionByName(sources.select("specimen", "j", "i").mapInPandas(started, _schema(kind)))
    while True:
        rows = materialise(_advance(rows, tile, kind), "distances")
        if not rows.where(F.col("kind") == NEWS).select("kind").limit(1).count():
            return rows


def _farthest(settled: DataFrame, tile: int, kind: str) -> DataFrame:
    """(specimen, component, j, i, sides, diagonals) of the farthest node of each component, the first in row-major order of equals."""
    width = tile + 2

    def run(batches):
        for pdf in batches:
            parts = []
            for row in pdf.itertuples(index=False):
                labels = node_labels(np.frombuffer(row.labels, dtype=np.int32).reshape(tile + 1, tile + 1))[1:-1, 1:-1].ravel()
                a, b = (np.frombuffer(v, dtype=np.int32).reshape(width, width)[1:-1, 1:-1].ravel() for v in (row.sides, row.diagonals))
                reached = np.flatnonzero(a >= 0)
                order = reached[np.lexsort((reached, -lengths(a[reached], b[reached]), labels[reached]))]
                first = order[np.diff(labels[order], prepend=-1) != 0]
                j, i = np.divmod(first, tile)
                parts.append(pd.DataFrame({
                    "specimen": row.specimen, "component": labels[first], "j": j + row.tj * tile, "i": i + row.ti * tile, "sides": a[first], "diagonals": b[first]}))
            if parts:
                yield pd.concat(parts)

    tops = settled.select(*KEY, "labels", "sides", "diagonals").mapInPandas(run, f"specimen {kind}, component int, j long, i long, sides int, diagonals int")
    order = F.struct(F.col("sides") + F.col("diagonals") * F.lit(ROOT), -F.col("j"), -F.col("i"))
    best = tops.groupBy("specimen", "component").agg(F.max_by(F.struct("j", "i", "sides", "diagonals"), order).alias("best"))
    return best.select("specimen", "component", "best.*")


def component_diameters(mesh: Mesh, tile: int = TILE) -> DataFrame:
    """(specimen, component, diameter_um): the geodesic diameter by a double sweep (a lower bound).

    The first sweep starts at a component's first node in row-major order, the second
    at the first of the nodes farthest from it.
    """
    ship_package(mesh.cells.sparkSession)
    kind = dict(mesh.cells.dtypes)["specimen"]
    tiles = materialise(_tiles(mesh, tile), "distance-tiles")
    # the first node of a component is the first corner of its first cell
    first = mesh.cells.groupBy("specimen", "component").agg(F.min(F.struct(F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"))).alias("at"))
    far = materialise(_farthest(_settled(tiles, first.select("specimen", "component", "at.*"), tile, kind), tile, kind), "far")
    ends = _farthest(_settled(tiles, far, tile, kind), tile, kind)
    return ends.join(mesh.frame.select("specimen", "h"), "specimen").select(
        "specimen", "component", ((F.col("sides") + F.col("diagonals") * F.lit(ROOT)) * F.col("h")).alias("diameter_um"))

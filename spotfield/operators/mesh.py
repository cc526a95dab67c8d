"""Lattice triangle mesh over tissue.

A mesh is two tables.  ``cells(specimen, i, j, component)`` lists the lattice
cells whose four corners are tissue; ``frame`` has one row per specimen with the
lattice origin, spacing and size.  Triangles, nodes and edges are projections of
the cells, so nothing else needs storing.

A node is identified inside its specimen by its row-major lattice index; the
mesh budget of two million nodes per specimen bounds every per-specimen graph.
"""

from __future__ import annotations

import warnings
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.order_stats import exact_quantile
from ..runtime import materialise
from .components import ROW_STEP, label_cells, with_roots
from .tiles import TILE

COPIES = 32  # of a component's number, for its cells to join with


class Mesh(NamedTuple):
    cells: DataFrame
    frame: DataFrame


def lattice_points(tissue_cells: DataFrame, frame: DataFrame) -> DataFrame:
    """Lattice points (specimen, i, j) whose nearest pixel is tissue.

    Each tissue pixel proposes the few lattice indices that can round to it, so
    the lattice is never enumerated apart from the mask.
    """

    def proposals(v, origin):
        low = ((F.col(v) - F.lit(0.5)) * F.col("pixel_size_um") - F.col(origin)) / F.col("h")
        high = ((F.col(v) + F.lit(0.5)) * F.col("pixel_size_um") - F.col(origin)) / F.col("h")
        return F.explode(F.sequence(F.floor(low).cast("long"), F.ceil(high).cast("long")))

    def hits(index, origin, v, size):
        pixel = F.rint((F.col(origin) + F.col(index) * F.col("h")) / F.col("pixel_size_um"))
        return (F.col(index) >= 0) & (F.col(index) < F.col(size)) & (pixel == F.col(v))

    return (
        tissue_cells.select("specimen", "row", "col").join(frame, "specimen")
        .withColumn("i", proposals("col", "x0")).where(hits("i", "x0", "col", "nx"))
        .withColumn("j", proposals("row", "y0")).where(hits("j", "y0", "row", "ny"))
        .select("specimen", "i", "j"))


def full_cells(points: DataFrame) -> DataFrame:
    """Cells all of whose four corners are lattice points in tissue."""
    corners = F.array(*[F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (0, 1) for dj in (0, 1)])
    return (
        points.withColumn("o", F.explode(corners))
        .groupBy("specimen", (F.col("i") - F.col("o.di")).alias("i"), (F.col("j") - F.col("o.dj")).alias("j"))
        .agg(F.count("*").alias("corners")).where("corners = 4").select("specimen", "i", "j"))


def build(tissue: DataFrame, extent: DataFrame, spacing_um: float | None = None, keep_components: str = "all",
          node_budget: int = S.MESH_NODE_BUDGET, tile: int = TILE) -> Mesh:
    """Mesh every specimen, at 4 um or the first coarser spacing that fits.

    A spacing fails for a specimen that is too small for it, exceeds the node
    budget or has no full cell; a specimen that fails them all raises.
    """
    if keep_components not in ("all", "largest"):
        raise ValueError("keep_components must be 'all' or 'largest'")
    spacings = [float(spacing_um)] if spacing_um is not None else list(S.MESH_SPACINGS_UM)
    inside = tissue.where("in_tissue").select("specimen", "row", "col")
    box = materialise(
        inside.groupBy("specimen").agg(
            F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1"))
        .join(extent, "specimen"), "box")

    def count_along(low, high, h):
        return F.ceil((F.col(high) - F.col(low)) * F.col("pixel_size_um") / F.lit(h) + F.lit(0.5)).cast("long")

    done_cells, done_frames, pending = [], [], box
    for h in spacings:
        frame = pending.select(
            "specimen", "pixel_size_um", F.lit(h).alias("h"), (F.col("c0") * F.col("pixel_size_um")).alias("x0"),
            (F.col("r0") * F.col("pixel_size_um")).alias("y0"),
            count_along("c0", "c1", h).alias("nx"), count_along("r0", "r1", h).alias("ny"),
        ).where((F.col("nx") >= 2) & (F.col("ny") >= 2))
        points = materialise(lattice_points(inside, frame), "lattice")
        allowed = materialise(
            points.groupBy("specimen").agg(F.count("*").alias("n")).where(F.col("n") <= node_budget).select("specimen"),
            "allowed")
        cells = materialise(full_cells(points.join(allowed, "specimen")), "cells")
        meshed = materialise(cells.select("specimen").distinct(), "meshed")
        done_cells.append(cells)
        done_frames.append(frame.join(meshed, "specimen"))
        pending = pending.join(meshed, "specimen", "left_anti")
        if pending.limit(1).count() == 0:
            break
    left = [r[0] for r in pending.select("specimen").limit(10).collect()]
    if left:
        raise ValueError(
            f"no admissible mesh spacing for specimen(s) {', '.join(map(str, left))}: the tissue is too small, "
            "exceeds the node budget or has no full cell")

    frame, cells = done_frames[0], done_cells[0]
    for more_frame, more_cells in zip(done_frames[1:], done_cells[1:]):
        frame, cells = frame.unionByName(more_frame), cells.unionByName(more_cells)
    frame = materialise(frame, "frame")
    # Cells that meet in one corner share a node and so a component.
    grid = cells.select("specimen", F.col("j").alias("row"), F.col("i").alias("col"))
    rooted = with_roots(materialise(label_cells(grid, True, tile), "cell-labels"), True, tile)
    cells = materialise(rooted.select("specimen", F.col("col").alias("i"), F.col("row").alias("j"), "root"), "rooted")
    number = materialise(_component_numbers(cells), "numbers")
    # the cells of a large component are dealt over copies of its number
    copies = number.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = cells.withColumn("copy", F.pmod(F.xxhash64("i", "j"), F.lit(COPIES)).cast("int"))
    cells = materialise(dealt.join(copies, ["specimen", "root", "copy"]).select("specimen", "i", "j", "component"), "mesh")
    mesh = Mesh(cells, frame)
    if keep_components == "largest":
        return keep_largest(mesh)
    split = number.groupBy("specimen").agg(F.count("*").alias("n")).where("n > 1")
    found = split.agg(F.count("*"), F.min(F.struct("specimen", "n"))).first()
    if found[0]:
        warnings.warn(f"the meshes of {found[0]} specimen(s) have separate components, which transport cannot cross: see component_sizes "
                      f"(specimen {found[1][0]} has {found[1][1]} separate components)", stacklevel=2)
    return mesh


def component_sizes(mesh: Mesh) -> DataFrame:
    """(specimen, component, n_nodes), for meshes that fall apart and what ``keep_largest`` would discard."""
    return nodes(mesh).groupBy("specimen", "component").agg(F.count("*").alias("n_nodes"))


def _component_numbers(cells: DataFrame) -> DataFrame:
    """Number components 0, 1, ... by their first cell."""
    w = Window.partitionBy("specimen").orderBy(F.floor(F.col("root") / F.lit(ROW_STEP)), F.col("root") % F.lit(ROW_STEP))
    return cells.select("specimen", "root").distinct().withColumn("component", (F.row_number().over(w) - 1).cast("int"))


def keep_largest(mesh: Mesh) -> Mesh:
    """Keep each specimen's component with the most nodes (not the most area); warns of what goes."""
    sizes = materialise(component_sizes(mesh).withColumnRenamed("n_nodes", "n"), "sizes")
    gone = sizes.agg(F.count("*") - F.countDistinct("specimen"), F.sum("n")).first()
    if gone[0]:
        warnings.warn(f"{gone[0]} smaller component(s) are discarded: see component_sizes of the whole mesh", stacklevel=2)
    best = materialise(
        sizes.groupBy("specimen").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("b"))
        .select("specimen", (-F.col("b.c")).alias("component")), "largest")
    cells = mesh.cells.join(best, ["specimen", "component"], "left_semi").withColumn("component", F.lit(0))
    return Mesh(materialise(cells.select("specimen", "i", "j", "component"), "mesh"), mesh.frame)


def triangles(mesh: Mesh) -> DataFrame:
    """(specimen, tri, component, i, j, a, b, c, cx, cy, area), counter-clockwise.

    Diagonals alternate between neighbouring cells.  ``tri`` orders the first
    triangles of all cells before the second ones; a, b, c are (node, x, y).
    """
    return halves(mesh.cells, mesh.frame)


def halves(cells: DataFrame, frame: DataFrame) -> DataFrame:
    """The :func:`triangles` of cells, or of their ``half`` if they name one, beside the other columns of these."""
    others = [c for c in cells.columns if c not in ("specimen", "component", "i", "j", "half")]
    half = F.col("half") if "half" in cells.columns else F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    t = cells.join(frame, "specimen").select("specimen", "component", "i", "j", *others, "nx", "ny", "x0", "y0", "h", half)
    even = (F.col("i") + F.col("j")) % 2 == 0
    second = F.col("half") == 1

    def one_if(condition):
        return F.when(condition, F.lit(1)).otherwise(F.lit(0))

    # Corners of each half by lattice offsets; both halves run counter-clockwise.
    t = t.withColumns({
        "ai": F.col("i") + one_if(second & ~even), "aj": F.col("j"),
        "bi": F.col("i") + 1, "bj": F.col("j") + F.col("half"),
        "ci": F.col("i") + one_if(~second & even), "cj": F.col("j") + 1})
    for p in "abc":
        t = t.withColumns({f"{p}x": F.col("x0") + F.col(f"{p}i") * F.col("h"), f"{p}y": F.col("y0") + F.col(f"{p}j") * F.col("h")})

    def corner(p):
        return F.struct((F.col(f"{p}j") * F.col("nx") + F.col(f"{p}i")).alias("node"), F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")).alias(p)

    twice = (F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))
    return t.select(
        *others, "specimen", (F.col("half") * F.col("nx") * F.col("ny") + F.col("j") * F.col("nx") + F.col("i")).alias("tri"),
        "component", "i", "j", corner("a"), corner("b"), corner("c"),
        ((F.col("ax") + F.col("bx") + F.col("cx")) / F.lit(3.0)).alias("cx"),
        ((F.col("ay") + F.col("by") + F.col("cy")) / F.lit(3.0)).alias("cy"), (F.lit(0.5) * F.abs(twice)).alias("area"))


def nodes(mesh: Mesh) -> DataFrame:
    """(specimen, node, component, x, y, area, nx); a third of each triangle per corner, and the length of a lattice row."""
    return (
        triangles(mesh)
        .select("specimen", "component", "area", F.explode(F.array("a", "b", "c")).alias("p"))
        .groupBy("specimen", F.col("p.node").alias("node"))
        .agg(F.first("component").alias("component"), F.first("p.x").alias("x"), F.first("p.y").alias("y"),
             F.sum(F.col("area") / F.lit(3.0)).alias("area"))
        .join(mesh.frame.select("specimen", "nx"), "specimen"))


def dense_node_ids(mesh_nodes: DataFrame, frame: DataFrame) -> DataFrame:
    """Add ``node_id``: 0, 1, ... in row-major order within each specimen.

    Counts per lattice row carry the offset, so no window spans a specimen.
    """
    n = mesh_nodes.drop("nx").join(frame.select("specimen", "nx"), "specimen").withColumn("_j", F.floor(F.col("node") / F.col("nx")))
    rows = n.groupBy("specimen", "_j").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("specimen").orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.select("specimen", "_j", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("specimen", "_j").orderBy("node")
    return (
        n.join(offset, ["specimen", "_j"])
        .withColumn("node_id", (F.col("_offset") + F.row_number().over(within) - 1).cast("long"))
        .drop("_j", "_offset", "nx"))


def edges(mesh: Mesh) -> DataFrame:
    """Distinct undirected edges (specimen, component, src < dst, length)."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")

    def side(p, q):
        dx, dy = p["x"] - q["x"], p["y"] - q["y"]
        return F.struct(F.least(p["node"], q["node"]).alias("src"), F.greatest(p["node"], q["node"]).alias("dst"),
                        F.sqrt(dx * dx + dy * dy).alias("length"))

    return (
        triangles(mesh).select("specimen", "component", F.explode(F.array(side(a, b), side(b, c), side(c, a))).alias("e"))
        .groupBy("specimen", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
        .agg(F.first("component").alias("component"), F.first("e.length").alias("length")))


def graph(mesh_edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return mesh_edges.unionByName(
        mesh_edges.select("specimen", F.col("dst").alias("src"), F.col("src").alias("dst"), "component", "length"))


def component_areas(mesh: Mesh) -> DataFrame:
    return triangles(mesh).groupBy("specimen", "component").agg(F.sum("area").alias("area"))


def median_edge_length(mesh_edges: DataFrame) -> DataFrame:
    return exact_quantile(mesh_edges, ["specimen"], "length", 0.5, "median_edge_um")


def summary(mesh: Mesh) -> DataFrame:
    n = nodes(mesh).groupBy("specimen").agg(F.count("*").alias("n_nodes"), F.countDistinct("component").alias("n_components"))
    t = mesh.cells.groupBy("specimen").agg((F.count("*") * 2).alias("n_triangles"))
    return n.join(t, "specimen").withColumn("connected", F.col("n_components") == 1)


def geodesic_diameters(component_diameter: DataFrame) -> DataFrame:
    return component_diameter.groupBy("specimen").agg(F.max("diameter_um").alias("diameter_um"))

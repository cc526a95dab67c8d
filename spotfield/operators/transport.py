"""Finite-element reaction-diffusion operator and exposure fields.

``entries(specimen, component, i, j, k, m)`` holds stiffness and consistent mass.
No edge crosses components, so systems separate by (specimen, component).  Solves
run over tiles of the lattice (see :mod:`.multigrid`); no task holds a component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.solver import Rows
from ..kernels.solver import smallest_eigenvalues as lowest
from ..runtime import materialise, ship_package
from . import multigrid
from .geometry import tensor_at
from .mesh import Mesh, halves

BLOCK = 1 << 14  # node numbers of a block of matrix rows
CELLS_PER_TASK = 100_000


class OperatorError(RuntimeError):
    """The assembled operator violates an invariant."""


def assemble(mesh: Mesh, field: DataFrame, extent: DataFrame, beta_scale: float = 1.0) -> DataFrame:
    """Stiffness and mass entries, both (i, j) and (j, i).

    The tensor is read at each triangle's centroid.  Only the upper half is
    shuffled and summed; mirroring it afterwards makes symmetry exact.
    """
    # Only the names of triangles meet the raster, in parts of bounded size; the rest is made from them afterwards.
    both = mesh.cells.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    named = halves(both.withColumn("of", F.col("half")), mesh.frame).select("specimen", "component", "i", "j", F.col("of").alias("half"), "cx", "cy")
    tasks = 1 + mesh.cells.count() // CELLS_PER_TASK
    t = halves(tensor_at(named, field, extent, "cx", "cy", beta_scale, tasks).drop("cx", "cy"), mesh.frame)
    p = [F.col("a"), F.col("b"), F.col("c")]
    twice = (p[1]["x"] - p[0]["x"]) * (p[2]["y"] - p[0]["y"]) - (p[2]["x"] - p[0]["x"]) * (p[1]["y"] - p[0]["y"])
    safe = F.when(F.abs(twice) < F.lit(1e-15), F.lit(1e-15)).otherwise(twice)
    for n in range(3):
        q, r = p[(n + 1) % 3], p[(n + 2) % 3]
        t = t.withColumns({f"gx{n}": (q["y"] - r["y"]) / safe, f"gy{n}": (r["x"] - q["x"]) / safe})

    def entry(m, n):
        flux_x = F.col("a11") * F.col(f"gx{n}") + F.col("a12") * F.col(f"gy{n}")
        flux_y = F.col("a12") * F.col(f"gx{n}") + F.col("a22") * F.col(f"gy{n}")
        u, v = p[m]["node"], p[n]["node"]
        return F.struct(
            F.least(u, v).alias("i"), F.greatest(u, v).alias("j"),
            (F.col("area") * (F.col(f"gx{m}") * flux_x + F.col(f"gy{m}") * flux_y)).alias("k"),
            (F.col("area") / F.lit(12.0) * F.lit(2.0 if m == n else 1.0)).alias("m"))

    local = t.select("specimen", "component", F.explode(F.array(*[entry(m, n) for m in range(3) for n in range(m, 3)])).alias("e"))
    upper = local.groupBy("specimen", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(
        F.first("component").alias("component"), F.sum("e.k").alias("k"), F.sum("e.m").alias("m"))
    here = F.struct(F.col("i").alias("i"), F.col("j").alias("j"))
    there = F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    return upper.withColumn(
        "d", F.explode(F.when(F.col("i") == F.col("j"), F.array(here)).otherwise(F.array(here, there)))
    ).select("specimen", "component", "d.i", "d.j", "k", "m")


def apply(entries: DataFrame, field: DataFrame, value: str = "u", keys: list[str] = ()) -> DataFrame:
    """Products of both matrices with a nodal field: (.., node, ku, mu).

    Rows of the matrices meet the field in blocks of node numbers, so each is
    shuffled once and no product of an entry and a key leaves its task; values of
    nodes whose neighbours lie in another block are sent there as well.
    """
    ship_package(entries.sparkSession)
    keys = list(keys)
    kinds = {**dict(field.dtypes), **dict(entries.dtypes)}
    near = F.floor(F.col("j") / F.lit(BLOCK)).alias("block")
    rows = entries.select("specimen", F.floor(F.col("i") / F.lit(BLOCK)).alias("block"), "i", "j", "k", "m")
    values = field.where(F.col("specimen").isNotNull()).select(
        "specimen", *keys, F.col("node").alias("j"), F.col(value).cast("double").alias("u"))
    edge = materialise(rows.where(F.col("block") != near).select("specimen", "j", "block").distinct(), "edge")
    sent = values.select("*", near)
    if not edge.isEmpty():
        sent = sent.unionByName(values.join(edge, ["specimen", "j"]))

    def run(key, left, right):
        names = ["specimen", *keys, "node", "ku", "mu"]
        found = [[] for _ in names[1:]]
        i, i_at = np.unique(left.column("i").to_numpy(), return_inverse=True)
        j, j_at = np.unique(left.column("j").to_numpy(), return_inverse=True)
        node, null = right.column("j").to_numpy(), right.column("u").is_null().to_numpy()
        u = right.column("u").fill_null(0.0).to_numpy()
        at = np.searchsorted(j, node)
        here = np.flatnonzero(j[np.minimum(at, len(j) - 1)] == node) if len(j) else np.empty(0, int)
        which = np.zeros(len(node), int) if not keys else right.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        here = here[np.argsort(which[here], kind="stable")]
        for own in np.split(here, np.flatnonzero(np.diff(which[here])) + 1) if len(here) else []:
            x = np.bincount(at[own], u[own], minlength=len(j))
            met, told = np.zeros(len(j), bool), np.zeros(len(j), bool)
            met[at[own]], told[at[own][~null[own]]] = True, True
            out = np.bincount(i_at[met[j_at]], minlength=len(i)) > 0
            bare = np.bincount(i_at[told[j_at]], minlength=len(i))[out] == 0
            # of entries without a value of theirs nothing is added, not even what is not finite
            use = told[j_at]
            for c, name in enumerate(keys):
                found[c].append(right.column(name).take(pa.array(np.full(out.sum(), own[0]))).combine_chunks())
            found[-3].append(pa.array(i[out]))
            for c, name in ((-2, "k"), (-1, "m")):
                total = np.bincount(i_at[use], left.column(name).to_numpy()[use] * x[j_at[use]], minlength=len(i))[out]
                found[c].append(pa.array(total, mask=bare))
        kind = [*[right.schema.field(c).type for c in keys], left.schema.field("i").type, pa.float64(), pa.float64()]
        columns = [pa.chunked_array(c, t) for c, t in zip(found, kind)]
        count = len(columns[-1])
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * count, key[0].type), *columns], names)

    schema = ", ".join([f"specimen {kinds['specimen']}", *[f"{c} {kinds[c]}" for c in keys], f"node {kinds['i']}, ku double, mu double"])
    return rows.where(F.col("specimen").isNotNull()).groupBy("specimen", "block").cogroup(sent.groupBy("specimen", "block")).applyInArrow(run, schema)


def _shifts(ranges: DataFrame) -> DataFrame:
    """(specimen, g, ri, ell, kappa, sigma): the systems K + M / ell^2 of each range, from ``ranges(specimen, ells)``."""
    each = ranges.select("specimen", F.posexplode("ells").alias("ri", "ell"))
    return each.select("specimen", F.lit(0).alias("g"), "ri", "ell", F.lit(1.0).alias("kappa"), (F.lit(1.0) / (F.col("ell") * F.col("ell"))).alias("sigma"))


def _posed(entries, load, mesh_nodes, keys, tile, group=None):
    """(components of one tile, larger ones or None, numbered load, names of loads)."""
    boxes = materialise(multigrid.components(mesh_nodes, tile), "boxes")
    own, names = multigrid.numbered(load, keys, group)
    own = materialise(own.join(mesh_nodes.select("specimen", "node", "component"), ["specimen", "node"]), "placed")
    large = boxes.where("tail > 0")
    return boxes.where("tail = 0"), None if large.isEmpty() else large, own, names


def _in_rounds(entries, mesh_nodes, boxes, own, shifts, tile):
    """(operators, solved tiles) of components over several tiles."""
    _, levels = multigrid.build(entries, mesh_nodes, tile, boxes)
    own = own.join(boxes.select("specimen", "component"), ["specimen", "component"], "left_semi")
    return levels, multigrid.solve(boxes, levels, own, shifts.select("specimen", "g", "ri", "kappa", "sigma"), tile)


def _fields(entries, load, mesh_nodes, shifts, keys, tile, group=None):
    small, large, own, names = _posed(entries, load, mesh_nodes, keys, tile, group)
    wanted = ["specimen", "component", *[k for k in keys if k != "ell"], "ell", "node", "u"]
    told = names.drop("n") if "ell" not in keys else names.drop("n", "ell")
    out = multigrid.solve_whole(entries, own, small, shifts, tile).join(told, ["specimen", "part", "li"]).select(*wanted)
    if large is None:
        return out
    levels, rows = _in_rounds(entries, mesh_nodes, large, own, shifts, tile)
    found = multigrid.fields(rows, large, levels, tile)
    loaded = materialise(own.select("specimen", "component", "part", "li").distinct(), "loaded")
    named = found.join(loaded, ["specimen", "component", "part", "li"], "left_semi").join(told, ["specimen", "part", "li"])
    return out.unionByName(named.join(shifts.select("specimen", "g", "ri", "ell"), ["specimen", "g", "ri"]).select(*wanted))


def exposure_fields(entries: DataFrame, load: DataFrame, mesh_nodes: DataFrame, ranges: DataFrame, keys: list[str] = (), tile: int = multigrid.TILE) -> DataFrame:
    """Solve (K + M / ell^2) u = load for every load and every candidate range.

    ``load(specimen, *keys, node, load)``, ``ranges(specimen, ells)`` to
    ``(specimen, component, *keys, ell, node, u)``.  Components that receive no
    load have zero exposure and emit no rows.
    """
    return _fields(entries, load, mesh_nodes, materialise(_shifts(ranges), "shifts"), list(keys), tile)


def receiver_exposures(entries: DataFrame, load: DataFrame, weights: DataFrame, mesh_nodes: DataFrame, ranges: DataFrame, keys: list[str],
                       tile: int = multigrid.TILE) -> DataFrame:
    """The fields of :func:`exposure_fields`, read at the receivers inside the tiles.

    ``weights(specimen, obs_id, node, w)`` to ``(specimen, *keys, ell, obs_id, h)``
    with a row for every receiver, key and range; zero where a component has no
    load.  What it returns grows with receivers, not with nodes.
    """
    keys = list(keys)
    shifts = materialise(_shifts(ranges), "shifts")
    small, large, own, names = _posed(entries, load, mesh_nodes, keys, tile)
    reads = materialise(weights.select("specimen", "obs_id", "node", "w").join(mesh_nodes.select("specimen", "node", "component"), ["specimen", "node"]), "reads")
    found = multigrid.read_whole(entries, own, small, shifts, reads, tile)
    if large is not None:
        _, rows = _in_rounds(entries, mesh_nodes, large, own, shifts, tile)
        tiled = multigrid.read(rows, large, reads, tile).join(names.select("specimen", "g", "part").distinct(), ["specimen", "part"])
        tiled = tiled.join(shifts.select("specimen", "g", "ri", "ell"), ["specimen", "g", "ri"]).select(*found.columns)
        # a receiver may lie on components of both kinds
        found = found.unionByName(tiled).groupBy("specimen", "part", "li", "ell", "obs_id").agg(F.sum("h").alias("h"))
    told = found.join(names.drop("n"), ["specimen", "part", "li"])
    # a component without a load of a part has no tiles of it
    loaded = own.select("specimen", "component", "part").distinct()
    bare = reads.select("specimen", "component").distinct().join(names, "specimen").join(loaded, ["specimen", "component", "part"], "left_anti")
    zeros = reads.select("specimen", "component", "obs_id").distinct().join(bare, ["specimen", "component"]).join(shifts.select("specimen", "ell"), "specimen")
    return told.select("specimen", *keys, "ell", "obs_id", "h").unionByName(zeros.select("specimen", *keys, "ell", "obs_id", F.lit(0.0).alias("h")))


def mass_solve(entries: DataFrame, load: DataFrame, mesh_nodes: DataFrame, keys: list[str] = (), tile: int = multigrid.TILE) -> DataFrame:
    """Solve M u = load."""
    one = load.select("specimen").distinct().select("specimen", F.lit(0).alias("g"), F.lit(0).alias("ri"), F.lit(0.0).alias("ell"), F.lit(0.0).alias("kappa"), F.lit(1.0).alias("sigma"))
    return _fields(entries, load, mesh_nodes, materialise(one, "shifts"), list(keys), tile).drop("ell")


def log_range_derivative(entries: DataFrame, fields: DataFrame, mesh_nodes: DataFrame, keys: list[str] = (), tile: int = multigrid.TILE) -> DataFrame:
    """du / d(log ell) = 2 / ell^2 (K + M / ell^2)^-1 M u, for each row's own ell."""
    rhs = apply(entries, fields, "u", ["ell", *keys])
    ells = fields.select("specimen", "ell").distinct()
    each = ells.withColumn("g", (F.row_number().over(Window.partitionBy("specimen").orderBy("ell")) - 1).cast("int"))
    shifts = materialise(each.select("specimen", "g", F.lit(0).alias("ri"), "ell", F.lit(1.0).alias("kappa"), (F.lit(1.0) / (F.col("ell") * F.col("ell"))).alias("sigma")), "shifts")
    slope = (F.lit(2.0) / (F.col("ell") * F.col("ell")) * F.col("mu")).alias("load")
    load = rhs.join(shifts.select("specimen", "ell", "g"), ["specimen", "ell"]).select("specimen", "g", *keys, "node", slope)
    return _fields(entries, load, mesh_nodes, shifts, list(keys), tile, "g")


def residuals(entries: DataFrame, fields: DataFrame, load: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Relative residual of (K + M / ell^2) u = load per (specimen, *keys, ell)."""
    got = apply(entries, fields, "u", [*keys, "ell"])
    scale = load.groupBy("specimen", *keys).agg(F.sqrt(F.sum(F.col("load") * F.col("load"))).alias("scale"))
    gap = F.col("ku") + F.col("mu") / (F.col("ell") * F.col("ell")) - F.coalesce("load", F.lit(0.0))
    return (
        got.join(load, ["specimen", *keys, "node"], "left")
        .groupBy("specimen", *keys, "ell").agg(F.sqrt(F.sum(gap * gap)).alias("norm"))
        .join(scale, ["specimen", *keys])
        .select("specimen", *keys, "ell", (F.col("norm") / F.greatest("scale", F.lit(1e-300))).alias("residual")))


def checks(entries: DataFrame, mesh_nodes: DataFrame, spectrum: bool = False) -> DataFrame:
    """Invariants of the assembled operator, one row per specimen."""
    n_bad = F.count_if(F.isnan("k") | F.isnan("m") | (F.abs("k") == F.lit(float("inf"))) | (F.abs("m") == F.lit(float("inf"))))
    size = entries.groupBy("specimen").agg(
        F.max(F.abs("k")).alias("scale"), F.count("*").alias("nonzeros"), n_bad.alias("n_bad"))
    # The two halves of a pair meet in one group, so no self-join is needed.
    pair = entries.groupBy("specimen", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(
        F.max("k").alias("kmax"), F.min("k").alias("kmin"), F.count("*").alias("n"))
    lone = (F.col("lo") != F.col("hi")) & (F.col("n") == 1)
    symmetry = pair.groupBy("specimen").agg(
        F.max(F.when(lone, F.abs("kmax")).otherwise(F.col("kmax") - F.col("kmin"))).alias("symmetry"))
    rows = entries.groupBy("specimen", "i").agg(F.sum("k").alias("s"))
    flat = rows.groupBy("specimen").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("row_norm"))
    mass = mesh_nodes.groupBy("specimen").agg(
        F.min("area").alias("min_lumped_mass"), F.countDistinct("component").alias("n_components"))
    tiny = F.greatest(F.col("scale"), F.lit(1e-300))
    out = size.join(symmetry, "specimen").join(flat, "specimen").join(mass, "specimen").select(
        "specimen", "symmetry", (F.col("symmetry") / tiny).alias("relative_symmetry"), "min_lumped_mass",
        (F.col("row_norm") / tiny).alias("constant_residual"), (F.col("n_bad") == 0).alias("finite"),
        "n_components", "nonzeros", "scale")
    if not spectrum:
        return out
    lowest = smallest_eigenvalues(entries).groupBy("specimen").agg(F.min("eigenvalue").alias("min_generalized_eigenvalue"))
    return out.join(lowest, "specimen")


def smallest_eigenvalues(entries: DataFrame, n_eigenvalues: int = 1) -> DataFrame:
    """The smallest eigenvalues of K v = lambda M v per component: (specimen, component, rank, eigenvalue)."""
    kind = dict(entries.dtypes)["specimen"]

    def run(key, pdf):
        rows = Rows(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["k"].to_numpy(), pdf["m"].to_numpy())
        found = lowest(rows, *rows.values, count=min(n_eigenvalues, len(rows.names)))
        return pd.DataFrame({"specimen": key[0], "component": key[1], "rank": np.arange(1, len(found) + 1), "eigenvalue": found})

    return entries.groupBy("specimen", "component").applyInPandas(run, f"specimen {kind}, component int, rank int, eigenvalue double")


def validate(entries: DataFrame, mesh_nodes: DataFrame, symmetry_tolerance: float = 1e-10,
             eigenvalue_tolerance: float = 1e-8, spectrum: bool = True, strict: bool = True) -> DataFrame:
    """Checks with their failures; raises :class:`OperatorError` when strict."""
    report = checks(entries, mesh_nodes, spectrum)
    rules = [
        (~F.col("finite"), "entries are not all finite"),
        (F.col("relative_symmetry") > F.lit(symmetry_tolerance), "stiffness is not symmetric"),
        (F.col("min_lumped_mass") <= F.lit(0.0), "a node carries no mass"),
        (F.col("constant_residual") > F.lit(1e-8), "constants are not in the kernel of the stiffness"),
    ]
    if spectrum:
        bound = F.lit(-eigenvalue_tolerance) * F.greatest("scale", F.lit(1e-300))
        rules.append((F.col("min_generalized_eigenvalue") < bound, "an eigenvalue is materially negative"))
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
    report = materialise(report.withColumn("failures", found).withColumn("valid", F.size("failures") == 0), "checks")
    if strict:
        bad = report.where(~F.col("valid")).select("specimen", "failures").limit(10).collect()
        if bad:
            raise OperatorError("; ".join(f"specimen {r[0]}: {', '.join(r[1])}" for r in bad))
    return report

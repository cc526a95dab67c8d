"""Solves (kappa K + sigma M) u = load on lattice meshes of any size, tile by tile.

The lattice of each component is cut into tiles.  Every second node makes the next
coarser lattice, with tiles of the same size, until one tile holds a component; its
operators are the Galerkin products of the finer ones.  All are tables of tiles.

A symmetric cycle over this hierarchy preconditions conjugate gradients.  A stage of
the cycle is one shuffle: tiles send what their neighbours' rims need, residuals go to
the tiles of the coarser lattice and corrections come back.  One task holds one tile and
a few loads, whatever the component; the part of the hierarchy that fits one tile is
walked inside it.  Loads are packed ``LOADS`` to a row, each range makes rows of its own,
and all advance in the same jobs.  Both inner products of a step come from one pass, and
their sums stay in a table.  The number of rounds depends neither on the mesh nor on the range.

A component that one tile holds takes no rounds and no tables of tiles (:func:`solve_whole`):
its entries and up to ``LOADS`` loads meet in one task, which solves all ranges and returns fields, or
what receivers read in them: by elimination line after line where lines of the lattice are short, which takes
a tenth of the time of rounds, and by conjugate gradients otherwise.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.lattice import HALO, Transfer, coarsened, conjugate_gradients, cycle, damping, direct, hierarchy, product, resmoothed, smoothed
from ..runtime import materialise, ship_package

TILE = 256        # nodes along a side
LOADS = 8         # solved together in one row
SPREAD = 4        # copies of a tile's operators, for its loads and ranges to be dealt over
TOLERANCE, LIMIT = 1e-12, 200
STATIC, PIECE, HELD, CORRECTION, STATE, STEP, SOLVED = range(7)
GROUP = ["specimen", "component", "tj", "ti", "salt"]
SYSTEM = ["specimen", "component", "part", "ri"]
FIELDS = ["specimen", "component", "tj", "ti", "salt", "part", "ri", "kind", "level", "height", "width", "j0", "i0", "nj", "ni", "n", "kappa", "sigma", "data", "dots"]


def _schema(kind: str) -> str:
    return (f"specimen {kind}, component int, tj int, ti int, salt int, part long, ri int, kind int, level int, height int, width int, "
            "j0 int, i0 int, nj int, ni int, n int, kappa double, sigma double, data binary, dots array<double>")


def side(total: int, level: int, at: int | None = None, tile: int = TILE) -> int:
    """Nodes along a side of a lattice at this level, or of its tile ``at``, rounded up to an even number."""
    n = ((total - 1) >> level) + 1
    if at is None:
        return n
    n = min(tile, n - at * tile)
    return n + n % 2


def tail_of(height: int, width: int, tile: int) -> int:
    """The first level that one tile holds."""
    level = 0
    while max(side(height, level), side(width, level)) > tile:
        level += 1
    return level


def pieces(core, j0, i0, height, width, tile, rim):
    """(tj, ti, j0, i0, part) of a block of nodes for each tile that it, or its rim, lies in."""
    rows, cols = core.shape[1:]
    for tj in range(max(0, (j0 - rim) // tile), min((height - 1) // tile, (j0 + rows - 1 + rim) // tile) + 1):
        a, b = max(j0, tj * tile - rim), min(j0 + rows, (tj + 1) * tile + rim)
        for ti in range(max(0, (i0 - rim) // tile), min((width - 1) // tile, (i0 + cols - 1 + rim) // tile) + 1):
            c, d = max(i0, ti * tile - rim), min(i0 + cols, (ti + 1) * tile + rim)
            if a < b and c < d:
                yield tj, ti, a, c, core[:, a - j0:b - j0, c - i0:d - i0]


def assembled(rows, n, top, left, height, width):
    """The pieces of ``rows`` laid into an empty block."""
    out = np.zeros((n, height, width))
    for r in rows:
        part = np.frombuffer(r["data"]).reshape(n, r["nj"], r["ni"])
        a, b = max(r["j0"], top), min(r["j0"] + r["nj"], top + height)
        c, d = max(r["i0"], left), min(r["i0"] + r["ni"], left + width)
        if a < b and c < d:
            out[:, a - top:b - top, c - left:d - left] = part[:, a - r["j0"]:b - r["j0"], c - r["i0"]:d - r["i0"]]
    return out


class Out:
    """Collects rows and hands them on in batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 32 << 20):
        self.schema, self.limit, self.rows, self.held = schema, limit, [], 0

    def add(self, like, data, dots=None, **changed):
        row = {**like, **changed, "data": data if isinstance(data, bytes) else np.ascontiguousarray(data, dtype=float).tobytes(), "dots": dots}
        self.rows.append(row)
        self.held += len(row["data"]) + 200

    def send(self, like, core, j0, i0, tile, rim, level, kind, at_level):
        """Rows of ``kind`` at ``level`` for the tiles that need this block; its coordinates are those of level ``at_level``."""
        for tj, ti, a, c, part in pieces(core, j0, i0, side(like["height"], at_level), side(like["width"], at_level), tile, rim):
            self.add(like, part, tj=tj, ti=ti, kind=kind, level=level, j0=a, i0=c, nj=part.shape[1], ni=part.shape[2], n=part.shape[0])

    def take(self, force=False):
        if self.rows and (force or self.held >= self.limit):
            names = self.schema.names
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], self.schema.field(k).type) for k in names], schema=self.schema)
            self.rows, self.held = [], 0


def _arrow_schema(kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(_schema(kind)))


def _stage(rows: DataFrame, static: DataFrame | None, act, kind: str) -> DataFrame:
    """One shuffle: rows meet by tile, and ``act(out, static, group)`` sees those of one tile, part and range."""
    both = rows.selectExpr(*FIELDS)
    if static is not None:
        dealt_out = [f"explode(sequence(0, {SPREAD - 1})) AS salt" if c == "salt" else c for c in FIELDS]
        both = both.union(static.selectExpr(*dealt_out))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, *GROUP).sortWithinPartitions(*GROUP, "part", "ri")
    schema = _arrow_schema(kind)

    def run(batches):
        out = Out(schema)
        tile, held, key, group = None, None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                here = tuple(row[k] for k in GROUP)
                now = (here, row["part"], row["ri"])
                if now != key:
                    if group:
                        act(out, held, group)
                        yield from out.take()
                    key, group = now, []
                    if here != tile:
                        tile, held = here, None
                if row["kind"] == STATIC:
                    held = pickle.loads(row["data"])
                else:
                    group.append(row)
        if group:
            act(out, held, group)
        yield from out.take(True)

    return dealt.mapInArrow(run, _schema(kind))


def _here(row, level, tile):
    """Top, left, rows and columns of a row's tile."""
    return row["tj"] * tile, row["ti"] * tile, side(row["height"], level, row["tj"], tile), side(row["width"], level, row["ti"], tile)


# -- the hierarchy --------------------------------------------------------------

def components(mesh_nodes: DataFrame, tile: int) -> DataFrame:
    """(specimen, component, nx, jmin, imin, height, width, tail)."""
    j, i = F.floor(F.col("node") / F.col("nx")).cast("int"), (F.col("node") % F.col("nx")).cast("int")
    box = mesh_nodes.groupBy("specimen", "component").agg(F.first("nx").alias("nx"), F.min(j).alias("jmin"), F.min(i).alias("imin"), F.max(j).alias("jmax"), F.max(i).alias("imax"))
    box = box.withColumns({"height": F.col("jmax") - F.col("jmin") + 1, "width": F.col("imax") - F.col("imin") + 1})
    # halvings of the longer side until it fits
    longest = F.greatest("height", "width")
    tail = F.greatest(F.lit(0), F.ceil(F.log2(longest / F.lit(float(tile))) - F.lit(1e-12))).cast("int")
    return box.withColumn("tail", tail).drop("jmax", "imax")


def _placed(nodes: DataFrame, boxes: DataFrame, tile: int, node: str = "node") -> DataFrame:
    """Add (j, i), counted from the component's corner, and the tile (tj, ti)."""
    out = nodes.join(boxes, ["specimen", "component"])
    j, i = F.floor(F.col(node) / F.col("nx")).cast("int") - F.col("jmin"), (F.col(node) % F.col("nx")).cast("int") - F.col("imin")
    return out.withColumns({"j": j, "i": i}).withColumns({"tj": F.floor(F.col("j") / tile).cast("int"), "ti": F.floor(F.col("i") / tile).cast("int")})


def _finest(entries: DataFrame, boxes: DataFrame, tile: int, kind: str) -> DataFrame:
    """Stiffness and mass of each tile as 18 fields."""
    at = _placed(entries.select("specimen", "component", F.col("i").alias("node"), F.col("j").alias("other"), "k", "m"), boxes, tile)
    at = at.withColumns({"dj": F.floor(F.col("other") / F.col("nx")) - F.floor(F.col("node") / F.col("nx")), "di": F.col("other") % F.col("nx") - F.col("node") % F.col("nx")})
    at = at.select("specimen", "component", "tj", "ti", "height", "width", "j", "i", ((F.col("dj") + 1) * 3 + F.col("di") + 1).cast("int").alias("o"), "k", "m")

    def run(key, pdf):
        specimen, component, tj, ti = key
        height, width = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        rows, cols = side(height, 0, tj, tile), side(width, 0, ti, tile)
        data = np.zeros((18, rows, cols))
        for first, name in ((0, "k"), (9, "m")):
            data[pdf["o"].to_numpy() + first, pdf["j"].to_numpy() - tj * tile, pdf["i"].to_numpy() - ti * tile] = pdf[name].to_numpy()
        return pd.DataFrame({
            "specimen": [specimen], "component": [component], "tj": [tj], "ti": [ti], "salt": [0], "part": [0], "ri": [0], "kind": [PIECE], "level": [0], "height": [height], "width": [width],
            "j0": [tj * tile], "i0": [ti * tile], "nj": [rows], "ni": [cols], "n": [18], "kappa": [0.0], "sigma": [0.0], "data": [data.tobytes()], "dots": [None]})

    whole = at.groupBy("specimen", "component", "tj", "ti").applyInPandas(run, _schema(kind))

    def rims(out, _, group):
        for r in group:
            out.send(r, np.frombuffer(r["data"]).reshape(18, r["nj"], r["ni"]), r["j0"], r["i0"], tile, HALO, 0, PIECE, 0)

    return _stage(whole, None, rims, kind)


def build(entries: DataFrame, mesh_nodes: DataFrame, tile: int = TILE, boxes: DataFrame | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(components, operators by level): a row a tile, with its rim; of the components in ``boxes`` only, if given."""
    if tile < 2 * HALO or tile & (tile - 1):
        raise ValueError(f"a tile has a power of two of nodes along a side, {2 * HALO} at least")
    ship_package(entries.sparkSession)
    kind = dict(entries.dtypes)["specimen"]
    boxes = materialise(components(mesh_nodes, tile), "boxes") if boxes is None else boxes
    depth = boxes.agg(F.max("tail")).first()[0] or 0
    rows, levels = _finest(entries, boxes, tile, kind), []
    for level in range(depth + 1):
        def act(out, _, group, level=level):
            like = group[0]
            top, left, height, width = _here(like, level, tile)
            a = assembled(group, 18, top - HALO, left - HALO, height + 2 * HALO, width + 2 * HALO)
            k, m = a[:9], a[9:]
            last = tail_of(like["height"], like["width"], tile) == level
            held = {"levels": hierarchy(k, m) if last else [(k, m)], "last": last}
            out.add(like, pickle.dumps(held), kind=STATIC, part=-1, level=level)
            if not last:
                transfer = Transfer(m[4] > 0)
                core = np.concatenate([coarsened(k, transfer), coarsened(m, transfer)])[:, 2:-2, 2:-2]
                core = core[:, :side(like["height"], level + 1) - top // 2, :side(like["width"], level + 1) - left // 2]
                out.send(like, core, top // 2, left // 2, tile, HALO, level + 1, PIECE, level + 1)

        done = materialise(_stage(rows, None, act, kind), "operators", by="kind")
        levels.append(done.where(F.col("kind") == STATIC))
        rows = done.where(F.col("kind") == PIECE)
    return boxes, levels


# -- one cycle ------------------------------------------------------------------

def _down(level: int, tile: int):
    def act(out, held, group):
        mine = [r for r in group if r["kind"] == PIECE and r["level"] == level]
        for r in group:
            if not (r["kind"] == PIECE and r["level"] == level):
                out.rows.append(r)
                out.held += len(r["data"])
        if not mine or held is None:
            return
        like = mine[0]
        n = like["n"]
        top, left, height, width = _here(like, level, tile)
        r = assembled(mine, n, top - HALO, left - HALO, height + 2 * HALO, width + 2 * HALO)
        if held["last"] and level == 0:
            x = conjugate_gradients(held["levels"], r, like["kappa"], like["sigma"], TOLERANCE, LIMIT)
            out.add(like, x[:, HALO:-HALO, HALO:-HALO], kind=SOLVED, j0=top, i0=left, nj=height, ni=width)
            return
        if held["last"]:
            z = cycle(held["levels"], r, like["kappa"], like["sigma"])
            _answer(out, like, held, r, z, level, tile)
            return
        k, m = held["levels"][0]
        a = like["kappa"] * k + like["sigma"] * m
        x = smoothed(a, damping(a), r)
        core = Transfer(m[4] > 0).down(r - product(a, x))[:, 2:-2, 2:-2]
        core = core[:, :side(like["height"], level + 1) - top // 2, :side(like["width"], level + 1) - left // 2]
        out.send(like, core, top // 2, left // 2, tile, HALO, level + 1, PIECE, level + 1)
        out.add(like, r, kind=HELD, level=level, j0=top - HALO, i0=left - HALO, nj=r.shape[1], ni=r.shape[2])

    return act


def _up(level: int, tile: int):
    def act(out, held, group):
        kept = [r for r in group if r["kind"] == HELD and r["level"] == level]
        mine = [r for r in group if r["kind"] == CORRECTION and r["level"] == level]
        for r in group:
            if r["level"] != level or r["kind"] not in (HELD, CORRECTION):
                out.rows.append(r)
                out.held += len(r["data"])
        if not kept or held is None:
            return
        like = kept[0]
        n = like["n"]
        top, left, height, width = _here(like, level, tile)
        r = np.frombuffer(like["data"]).reshape(n, like["nj"], like["ni"])
        e = assembled(mine, n, top // 2 - 2, left // 2 - 2, height // 2 + 4, width // 2 + 4)
        k, m = held["levels"][0]
        a = like["kappa"] * k + like["sigma"] * m
        w = damping(a)
        x = smoothed(a, w, r) + Transfer(m[4] > 0).up(e)
        _answer(out, like, held, r, resmoothed(a, w, r, x), level, tile)

    return act


def _answer(out, like, held, r, z, level, tile):
    """What a cycle found for a tile: to the tiles of the finer level, or with its inner products at the finest."""
    inner = np.s_[:, HALO:-HALO, HALO:-HALO]
    top, left, height, width = _here(like, level, tile)
    if level:
        core = z[inner][:, :side(like["height"], level) - top, :side(like["width"], level) - left]
        out.send(like, core, top, left, tile // 2, 2, level - 1, CORRECTION, level)
        return
    k, m = held["levels"][0]
    w = product(like["kappa"] * k + like["sigma"] * m, z)[inner]
    r, z = r[inner], z[inner]
    dots = np.zeros((3, LOADS))
    for at, (u, v) in enumerate(((r, z), (z, w), (r, r))):
        dots[at, :len(r)] = (u * v).sum(axis=(1, 2))
    out.add(like, np.concatenate([r, z, w]), dots.ravel().tolist(), kind=STEP, level=0, j0=top, i0=left, nj=height, ni=width)


def _cycled(rows: DataFrame, levels: list[DataFrame], tile: int, kind: str) -> DataFrame:
    for level, static in enumerate(levels):
        rows = _stage(rows, static, _down(level, tile), kind)
    for level in reversed(range(len(levels) - 1)):
        rows = _stage(rows, levels[level], _up(level, tile), kind)
    return materialise(rows.where(f"kind >= {STEP}"), "steps", by="kind")


# -- conjugate gradients ----------------------------------------------------------

def _each(text: str) -> str:
    """An array of the SQL ``text`` for every load."""
    return "array(" + ", ".join(text.format(i=i) for i in range(LOADS)) + ")"


def _sums(steps: DataFrame, before: DataFrame | None) -> DataFrame:
    """(system, alpha, beta, gamma, limit, open) from the inner products of all tiles; a load that is done stands still."""
    whole = [F.expr(_each(f"sum(dots[{at} + {{i}}])")).alias(name) for at, name in ((0, "gamma"), (LOADS, "delta"), (2 * LOADS, "rest"))]
    sums = steps.groupBy(*SYSTEM).agg(*whole)
    if before is None:
        sums = sums.selectExpr("*", _each(f"{TOLERANCE ** 2!r}D * rest[{{i}}]") + " AS limit", _each("0D") + " AS beta")
        sums = sums.selectExpr("*", "delta AS under")
    else:
        sums = sums.join(before.selectExpr(*SYSTEM, "gamma AS old", "alpha AS step", "limit"), SYSTEM)
        sums = sums.selectExpr("*", _each("CASE WHEN rest[{i}] <= limit[{i}] OR old[{i}] = 0 THEN 0D ELSE gamma[{i}] / old[{i}] END") + " AS beta")
        sums = sums.selectExpr("*", _each("CASE WHEN step[{i}] = 0 THEN 0D ELSE delta[{i}] - beta[{i}] * gamma[{i}] / step[{i}] END") + " AS under")
    return materialise(sums.selectExpr(
        *SYSTEM, _each("CASE WHEN rest[{i}] <= limit[{i}] THEN 0D ELSE gamma[{i}] / under[{i}] END") + " AS alpha", "beta", "gamma", "limit",
        "exists(arrays_zip(rest, limit), x -> x.rest > x.limit) AS open"), "sums")


def _advanced(tile: int):
    """Row STATE holds (x, p, s), row STEP (r, z, w) and, as dots, the factors of the step."""
    def act(out, _, group):
        state = next((r for r in group if r["kind"] == STATE), None)
        step = next((r for r in group if r["kind"] == STEP), None)
        if state is None or step is None:
            return
        n, shape = state["n"], (state["n"], state["nj"], state["ni"])
        x, p, s = np.frombuffer(state["data"]).reshape(3, *shape)
        r, z, w = np.frombuffer(step["data"]).reshape(3, *shape)
        alpha, beta = (np.array(v)[:n, None, None] for v in (step["dots"][:LOADS], step["dots"][LOADS:]))
        p, s = z + beta * p, w + beta * s
        out.add(state, np.concatenate([x + alpha * p, p, s]))
        core = (r - alpha * s)[:, :state["height"] - state["j0"], :state["width"] - state["i0"]]
        out.send(state, core, state["j0"], state["i0"], tile, HALO, 0, PIECE, 0)

    return act


def _start(load: DataFrame, boxes: DataFrame, levels: list[DataFrame], shifts: DataFrame, tile: int, kind: str) -> DataFrame:
    """STATE rows of zeros and the residual pieces, which are the loads, for every tile of a component with a load."""
    at = _placed(load, boxes, tile)
    size = at.groupBy("specimen", "component", "part").agg(F.first("n").alias("n"), F.first("g").alias("g"))
    tiles = levels[0].select("specimen", "component", "tj", "ti", "height", "width").join(size, ["specimen", "component"])

    def run(key, pdf):
        tj, ti = key[2], key[3]
        n, rows, cols = int(pdf["n"].iloc[0]), side(int(pdf["height"].iloc[0]), 0, tj, tile), side(int(pdf["width"].iloc[0]), 0, ti, tile)
        data = np.zeros((n, rows, cols))
        np.add.at(data, (pdf["li"].to_numpy(), pdf["j"].to_numpy() - tj * tile, pdf["i"].to_numpy() - ti * tile), pdf["load"].to_numpy())
        return pd.DataFrame({"specimen": [key[0]], "component": [key[1]], "tj": [tj], "ti": [ti], "part": [key[4]], "data": [data.tobytes()]})

    dense = at.groupBy("specimen", "component", "tj", "ti", "part").applyInPandas(
        run, f"specimen {kind}, component int, tj int, ti int, part long, data binary")
    rows = tiles.join(dense, ["specimen", "component", "tj", "ti", "part"], "left").join(shifts, ["specimen", "g"])
    rows = rows.select(
        "specimen", "component", "tj", "ti", F.pmod(F.col("part") * 7 + F.col("ri"), F.lit(SPREAD)).cast("int").alias("salt"), "part", "ri",
        F.lit(STATE).alias("kind"), F.lit(0).alias("level"), "height", "width", (F.col("tj") * tile).alias("j0"), (F.col("ti") * tile).alias("i0"), F.lit(0).alias("nj"), F.lit(0).alias("ni"),
        "n", "kappa", "sigma", "data", F.lit(None).cast("array<double>").alias("dots"))
    schema = _arrow_schema(kind)

    def begun(batches):
        out = Out(schema)
        for batch in batches:
            for row in batch.to_pylist():
                _, _, height, width = _here(row, 0, tile)
                row["nj"], row["ni"] = height, width
                shape = (row["n"], height, width)
                r = np.zeros(shape) if row["data"] is None else np.frombuffer(row["data"]).reshape(shape)
                out.add(row, np.zeros((3, *shape)))
                out.send(row, r[:, :row["height"] - row["j0"], :row["width"] - row["i0"]], row["j0"], row["i0"], tile, HALO, 0, PIECE, 0)
                yield from out.take()
        yield from out.take(True)

    return rows.mapInArrow(begun, _schema(kind))


def solve(boxes: DataFrame, levels: list[DataFrame], load: DataFrame, shifts: DataFrame, tile: int = TILE, trace: list | None = None) -> DataFrame:
    """Rows (specimen, component, tj, ti, part, ri, j0, i0, nj, ni, n, data) of solved tiles.

    ``load(specimen, component, part, li, n, g, node, load)``: load ``li`` of a part of n;
    ``shifts(specimen, g, ri, kappa, sigma)``: the systems that parts of group g are solved
    for.  ``trace`` receives the number of open systems by round.
    """
    kind = dict(load.dtypes)["specimen"]
    now = materialise(_start(load, boxes, levels, shifts, tile, kind), "round", by="kind")
    sums, finished = None, []
    for _ in range(LIMIT):
        states = now.where(F.col("kind") == STATE)
        answers = _cycled(now.where(F.col("kind") == PIECE), levels, tile, kind)
        steps = answers.where(F.col("kind") == STEP)
        if sums is None:
            finished.append(answers.where(F.col("kind") == SOLVED))  # components of one tile
        sums = _sums(steps, sums)
        left = sums.where("open").count()
        if trace is not None:
            trace.append(left)
        done = sums.where("NOT open").select(*SYSTEM)
        finished.append(states.join(done, SYSTEM, "left_semi"))
        if not left:
            break
        sums = sums.where("open")
        factors = sums.select(*SYSTEM, F.concat("alpha", "beta").alias("factors"))
        moving = steps.drop("dots").join(factors, SYSTEM).withColumnRenamed("factors", "dots")
        going = states.join(sums.select(*SYSTEM), SYSTEM, "left_semi")
        now = materialise(_stage(going.selectExpr(*FIELDS).union(moving.selectExpr(*FIELDS)), None, _advanced(tile), kind), "round", by="kind")
    else:
        raise RuntimeError(f"{left} transport system(s) did not settle in {LIMIT} rounds")
    names = ["specimen", "component", "tj", "ti", "part", "ri", "j0", "i0", "nj", "ni", "n", "height", "width", "data"]
    out = finished[0].selectExpr(*names)
    for more in finished[1:]:
        out = out.union(more.selectExpr(*names))
    return out


# -- components of one tile --------------------------------------------------------

LOAD, SHIFT, READ, BOX, SHAPE = range(5)


def _whole_inputs(entries: DataFrame, load: DataFrame, boxes: DataFrame, shifts: DataFrame, reads: DataFrame | None):
    """Entries, and everything else, of each (specimen, component, part)."""
    key = ["specimen", "component", "part"]
    parts = materialise(load.join(boxes.select("specimen", "component"), ["specimen", "component"], "left_semi").groupBy(*key).agg(F.first("g").alias("g"), F.first("n").alias("n")), "parts")
    who = f"CAST(NULL AS {'int' if reads is None else dict(reads.dtypes)['obs_id']}) AS obs_id"
    at = parts.select(*key)
    ask = load.join(at, key, "left_semi").selectExpr(*key, f"{LOAD} AS kind", "CAST(li AS long) AS a", "CAST(node AS long) AS b", "0L AS c", "CAST(load AS double) AS u", "0D AS v", "0D AS ell", who)
    ask = ask.union(parts.join(shifts, ["specimen", "g"]).selectExpr(
        *key, f"{SHIFT} AS kind", "CAST(ri AS long) AS a", "0L AS b", "0L AS c", "kappa AS u", "sigma AS v", "CAST(ell AS double) AS ell", who))
    sized = parts.join(boxes, ["specimen", "component"])
    ask = ask.union(sized.selectExpr(*key, f"{BOX} AS kind", "CAST(nx AS long) AS a", "CAST(jmin AS long) AS b", "CAST(imin AS long) AS c", "0D AS u", "0D AS v", "0D AS ell", who))
    ask = ask.union(sized.selectExpr(*key, f"{SHAPE} AS kind", "CAST(height AS long) AS a", "CAST(width AS long) AS b", "CAST(n AS long) AS c", "0D AS u", "0D AS v", "0D AS ell", who))
    if reads is not None:
        ask = ask.union(reads.join(at, ["specimen", "component"]).selectExpr(
            *key, f"{READ} AS kind", "0L AS a", "CAST(node AS long) AS b", "0L AS c", "CAST(w AS double) AS u", "0D AS v", "0D AS ell", "obs_id"))
    return entries.select("specimen", "component", "i", "j", "k", "m").join(at, ["specimen", "component"]), ask


def _systems_here(left: pa.Table, right: pa.Table, tile: int):
    """(rows of ``right`` by kind, name of each node place, solutions (ell, fields by load)) of one component and part."""
    kind = right.column("kind").to_numpy()
    col = {c: right.column(c).to_numpy() for c in ("a", "b", "c", "u", "v", "ell")}
    box, shape = np.flatnonzero(kind == BOX), np.flatnonzero(kind == SHAPE)
    if not len(box) or not left.num_rows:
        return None
    nx, jmin, imin = (int(col[c][box[0]]) for c in "abc")
    height, width, n = (int(col[c][shape[0]]) for c in "abc")
    rows, cols = side(height, 0, 0, tile), side(width, 0, 0, tile)

    def place(node):
        return node // nx - jmin + HALO, node % nx - imin + HALO

    i, other = left.column("i").to_numpy(), left.column("j").to_numpy()
    offset = (other // nx - i // nx + 1) * 3 + other % nx - i % nx + 1
    k, m = np.zeros((2, 9, rows + 2 * HALO, cols + 2 * HALO))
    for held, name in ((k, "k"), (m, "m")):
        held[(offset, *place(i))] = left.column(name).to_numpy()
    loads = np.flatnonzero(kind == LOAD)
    r = np.zeros((n, *k.shape[1:]))
    np.add.at(r, (col["a"][loads], *place(col["b"][loads])), col["u"][loads])

    def solutions():
        at, made = np.flatnonzero(kind == SHIFT), None
        at = at[np.argsort(col["a"][at], kind="stable")]
        for s, x in zip(at, direct(k, m, r, list(zip(col["u"][at], col["v"][at])), TOLERANCE)):
            if x is None:
                if made is None:
                    made = hierarchy(k, m)
                x = conjugate_gradients(made, r, col["u"][s], col["v"][s], TOLERANCE, LIMIT)
            yield col["ell"][s], x

    return kind, col, m[4] > 0, lambda j, i: (j - HALO + jmin) * nx + i - HALO + imin, place, n, solutions()


def _keyed(key, count: int) -> list[pa.Array]:
    return [pa.array([v.as_py()] * count, v.type) for v in key]


def solve_whole(entries: DataFrame, load: DataFrame, boxes: DataFrame, shifts: DataFrame, tile: int = TILE) -> DataFrame:
    """(specimen, component, part, li, ell, node, u): the fields of loads on components that one tile holds.

    ``load`` and ``shifts``, with ``ell``, as for :func:`solve`.
    """
    def run(key, left, right):
        found = _systems_here(left, right, tile)
        rows = {"li": [], "ell": [], "node": [], "u": []}
        if found is not None:
            kind, col, mask, name, _, _, solutions = found
            j, i = np.nonzero(mask)
            node = name(j, i)
            mine = np.unique(col["a"][kind == LOAD])
            for ell, x in solutions:
                for li in mine:
                    for c, v in zip(rows, (li, ell, node, x[li, j, i])):
                        rows[c].append(v)
        kinds = {"li": pa.int32(), "ell": pa.float64(), "node": pa.list_(pa.int64()), "u": pa.list_(pa.float64())}
        return pa.Table.from_arrays(
            [*_keyed(key, len(rows["li"])), *[pa.array(v, kinds[c]) for c, v in rows.items()]], ["specimen", "component", "part", *rows])

    ship_package(entries.sparkSession)
    key = ["specimen", "component", "part"]
    left, right = _whole_inputs(entries, load, boxes, shifts, None)
    kind = dict(load.dtypes)["specimen"]
    solved = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        run, f"specimen {kind}, component int, part long, li int, ell double, node array<long>, u array<double>")
    return solved.select(*key, "li", "ell", F.explode(F.arrays_zip("node", "u")).alias("z")).select(*key, "li", "ell", "z.node", "z.u")


def read_whole(entries: DataFrame, load: DataFrame, boxes: DataFrame, shifts: DataFrame, reads: DataFrame, tile: int = TILE) -> DataFrame:
    """(specimen, part, li, ell, obs_id, h): the same fields as receivers read them, ``reads(specimen, component, obs_id, node, w)``."""
    who = dict(reads.dtypes)["obs_id"]

    def run(key, left, right):
        found = _systems_here(left, right, tile)
        names = ["specimen", "component", "part", "li", "obs_id", "ell", "h"]
        obs = right.column("obs_id").combine_chunks()
        h, ells, li, seen = [], [], [], obs.slice(0, 0)
        if found is not None:
            kind, col, _, _, place, n, solutions = found
            at = np.flatnonzero(kind == READ)
            coded = obs.take(pa.array(at)).dictionary_encode(null_encoding="encode")
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            who_at, seen, w = coded.indices.to_numpy(), coded.dictionary, col["u"][at]
            j, i = place(col["b"][at])
            got = [(ell, [np.bincount(who_at, w * x[one, j, i], minlength=len(seen)) for one in range(n)]) for ell, x in solutions]
            ells = [ell for ell, _ in got]
            values = np.array([of for _, of in got]).reshape(len(ells), n, len(seen))
            h = values.transpose(1, 2, 0).reshape(-1)
            li = np.repeat(np.arange(n), len(seen))
        count, wide = len(li), len(ells)
        ends = pa.array(np.arange(count + 1) * wide, pa.int32())
        seen = seen if not count else seen.take(pa.array(np.tile(np.arange(len(seen)), count // len(seen))))
        return pa.Table.from_arrays(
            [*_keyed(key, count), pa.array(li, pa.int32()), seen, pa.ListArray.from_arrays(ends, pa.array(np.tile(ells, count) if count else [], pa.float64())),
             pa.ListArray.from_arrays(ends, pa.array(h, pa.float64()))], names)

    ship_package(entries.sparkSession)
    key = ["specimen", "component", "part"]
    left, right = _whole_inputs(entries, load, boxes, shifts, reads)
    kind = dict(load.dtypes)["specimen"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        run, f"specimen {kind}, component int, part long, li int, obs_id {who}, ell array<double>, h array<double>")
    flat = found.select("specimen", "part", "li", "obs_id", F.explode(F.arrays_zip("ell", "h")).alias("z")).select("specimen", "part", "li", "z.ell", "obs_id", "z.h")
    several = reads.groupBy("specimen", "obs_id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    if several.isEmpty():
        return flat
    return flat.groupBy("specimen", "part", "li", "ell", "obs_id").agg(F.sum("h").alias("h"))  # a receiver may lie on several components


# -- loads and fields -----------------------------------------------------------------

def numbered(load: DataFrame, keys: list[str], group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(load with part, li, n and g; names (specimen, g, part, li, n, *keys)); loads of one group g share their systems."""
    g = F.col(group) if group else F.lit(0)
    asked = load.select("specimen", g.cast("int").alias("g"), *keys).distinct()
    number = F.row_number().over(Window.partitionBy("specimen", "g").orderBy("specimen", *keys)) - 1
    asked = asked.withColumn("number", number).select(
        "specimen", "g", *keys, (F.shiftleft(F.col("g").cast("long"), 32) + F.floor(F.col("number") / LOADS)).alias("part"), (F.col("number") % LOADS).cast("int").alias("li"))
    asked = asked.withColumn("n", F.max("li").over(Window.partitionBy("specimen", "part")) + 1)
    names = materialise(asked, "loads")
    own = load.withColumn("g", g.cast("int"))
    return own.join(names, ["specimen", "g", *keys]), names


def fields(solved: DataFrame, boxes: DataFrame, levels: list[DataFrame], tile: int = TILE) -> DataFrame:
    """(specimen, component, part, ri, li, node, u) of every node."""
    kind = dict(solved.dtypes)["specimen"]
    masks = levels[0].select("specimen", "component", "tj", "ti", F.col("data").alias("held"))
    # the operators tell which places of a tile are nodes
    def lists(batches):
        for batch in batches:
            for row in batch.to_pylist():
                m = pickle.loads(row["held"])["levels"][0][1][4][HALO:-HALO, HALO:-HALO] > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[k]], batch.schema.field(k).type) for k in ("specimen", "component", "tj", "ti")] + [pa.array([np.packbits(m).tobytes()], pa.binary())],
                    ["specimen", "component", "tj", "ti", "mask"])

    masks = materialise(masks.mapInArrow(lists, f"specimen {kind}, component int, tj int, ti int, mask binary"), "masks")
    rows = solved.join(masks, ["specimen", "component", "tj", "ti"]).join(boxes.select("specimen", "component", "nx", "jmin", "imin"), ["specimen", "component"])
    type_of = dict(rows.dtypes)
    node = "bigint"

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                shape = (r["nj"], r["ni"])
                mask = np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=shape[0] * shape[1]).reshape(shape).astype(bool)
                j, i = np.nonzero(mask)
                name = (r["jmin"] + r["j0"] + j).astype(np.int64) * r["nx"] + r["imin"] + r["i0"] + i
                x = np.frombuffer(r["data"]).reshape(-1, r["n"], *shape)[0]
                for li in range(r["n"]):
                    count = len(name)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["specimen"]] * count, batch.schema.field("specimen").type), pa.array(np.full(count, r["component"], np.int32)), pa.array(np.full(count, r["part"], np.int64)),
                         pa.array(np.full(count, r["ri"], np.int32)), pa.array(np.full(count, li, np.int32)), pa.array(name), pa.array(x[li, j, i])],
                        ["specimen", "component", "part", "ri", "li", "node", "u"])

    return rows.mapInArrow(run, f"specimen {type_of['specimen']}, component int, part long, ri int, li int, node {node}, u double")


def read(solved: DataFrame, boxes: DataFrame, weights: DataFrame, tile: int = TILE) -> DataFrame:
    """(specimen, part, ri, li, obs_id, h): ``weights(specimen, component, obs_id, node, w)`` summed over the fields inside the tiles."""
    kinds = {**dict(solved.dtypes), **dict(weights.dtypes)}
    at = _placed(weights, boxes, tile).select("specimen", "component", "tj", "ti", "obs_id", "j", "i", "w")
    parts = solved.select("specimen", "component", "part").distinct()
    key = ["specimen", "component", "tj", "ti", "part"]
    at = at.join(materialise(parts, "parts"), ["specimen", "component"])
    names = ["specimen", "part", "ri", "li", "obs_id", "h"]

    def run(key, a, b):
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        seen, who = np.unique(b["obs_id"].to_numpy(), return_inverse=True)
        j, i, w = b["j"].to_numpy() - key[2] * tile, b["i"].to_numpy() - key[3] * tile, b["w"].to_numpy()
        h, ri, li = [], [], []
        for r, nj, ni, n, data in zip(a["ri"], a["nj"], a["ni"], a["n"], a["data"]):
            x = np.frombuffer(data).reshape(-1, n, nj, ni)[0]
            for at in range(n):
                h.append(np.bincount(who, w * x[at, j, i], minlength=len(seen)))
                ri.append(r)
                li.append(at)
        return pd.DataFrame({"specimen": key[0], "part": key[4], "ri": np.repeat(ri, len(seen)), "li": np.repeat(li, len(seen)),
                             "obs_id": np.tile(seen, len(h)), "h": np.concatenate(h)})

    left = solved.select(*key, "ri", "nj", "ni", "n", "data")
    right = at.select(*[F.col(c).alias(c) for c in [*key, "obs_id", "j", "i", "w"]])
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, f"specimen {kinds['specimen']}, part long, ri int, li int, obs_id {kinds['obs_id']}, h double")
    return found.groupBy("specimen", "part", "ri", "li", "obs_id").agg(F.sum("h").alias("h"))  # a footprint may lie across tiles

"""Raster, mesh, projection and transport operators on small fixtures."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotfield.kernels import image
from spotfield.operators import components, geodesic, geometry, histology, mesh, multigrid, projection, spectrum, transport
from spotfield.runtime import materialise


def cells_of(spark, mask):
    r, c = np.nonzero(mask)
    return spark.createDataFrame(pd.DataFrame({"specimen": "s", "row": r, "col": c}))


def flood(mask, diagonal):
    label = np.full(mask.shape, -1)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for r, c in zip(*np.nonzero(mask)):
        if label[r, c] >= 0:
            continue
        stack, name = [(r, c)], r * 1000 + c
        label[r, c] = name
        while stack:
            a, b = stack.pop()
            for dr, dc in steps:
                p, q = a + dr, b + dc
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and label[p, q] < 0:
                    label[p, q] = name
                    stack.append((p, q))
    return label


@pytest.mark.parametrize("diagonal,small_graph", [(False, 500_000), (True, 500_000), (True, 0)])
def test_components(spark, diagonal, small_graph):
    mask = np.random.default_rng(2).random((40, 40)) < 0.5
    labelled = materialise(components.label_cells(cells_of(spark, mask), diagonal, 8), "t")
    got = components.with_roots(labelled, diagonal, 8, small_graph).toPandas()
    want = flood(mask, diagonal)
    step = components.ROW_STEP
    assert len(got) == mask.sum()
    assert all(want[r, c] == (k // step) * 1000 + k % step for r, c, k in got[["row", "col", "root"]].itertuples(index=False))


@pytest.fixture(scope="module")
def slide(spark):
    rows, cols = 100, 80
    r, c = np.mgrid[0:rows, 0:cols]
    tissue = ((r - 50) ** 2 / 45 ** 2 + (c - 40) ** 2 / 36 ** 2 < 1) & ~(((r - 40) ** 2 + (c - 30) ** 2) < 60)
    tissue[2:5, 2:5] = True  # a speck
    stripe = np.sin(0.5 * r + 0.2 * c)
    rgb = np.where(tissue[..., None], np.stack([150 + 10 * stripe, 90 + 30 * stripe, 140 + 5 * stripe], -1), 240.0)
    pdf = pd.DataFrame({"specimen": "a", "row": r.ravel(), "col": c.ravel(), **{k: rgb[..., i].ravel() for i, k in enumerate("rgb")}})
    pixels = materialise(spark.createDataFrame(pdf), "slide")
    specimens = spark.createDataFrame([("a", 4.0)], "specimen string, pixel_size_um double")
    tissue_px, extent = histology.tissue(pixels, specimens, tile=32)
    field = materialise(geometry.orientation_field(tissue_px, extent, tile=32), "field")
    m = mesh.build(tissue_px, extent, 8.0, tile=8)
    nodes = materialise(mesh.nodes(m), "nodes")
    entries = materialise(transport.assemble(m, field, extent), "entries")
    return {"pixels": pixels, "specimens": specimens, "rgb": rgb, "tissue": tissue_px, "extent": extent, "field": field,
            "mesh": m, "nodes": nodes, "entries": entries}


def raster(df, column, shape=(100, 80)):
    pdf = df.select("row", "col", column).toPandas()
    out = np.empty(shape, dtype=pdf[column].dtype)
    out[pdf["row"], pdf["col"]] = pdf[column]
    return out


def test_tissue_matches_whole_image(slide):
    od = -np.log((slide["rgb"] + 1) / 256)
    smooth = image.blur(np.linalg.norm(od, axis=2), 0.5)
    count, edge = np.histogram(smooth, 256)
    center = (edge[:-1] + edge[1:]) / 2
    w, mo = np.cumsum(count), np.cumsum(count * center)
    with np.errstate(all="ignore"):
        between = w * (w[-1] - w) * (mo / w - (mo[-1] - mo) / (w[-1] - w)) ** 2
    mask = smooth > center[np.nanargmax(between)]
    mask = image.open_then_close(mask, image.disk_offsets(1.0), image.disk_offsets(2.0))
    label = flood(mask, False)
    for name in np.unique(label[label >= 0]):
        if (label == name).sum() < 32:
            mask[label == name] = False
    assert (raster(slide["tissue"], "in_tissue") == mask).all() and not mask[3, 3]


def test_tiles_do_not_show(slide):
    eosin = raster(slide["tissue"], "eosin")
    theta, coherency, crossing = image.orientation(eosin, 0.5, 3.0)
    assert np.allclose(raster(slide["field"], "coherency"), coherency)
    assert np.allclose(raster(slide["field"], "crossing"), crossing)
    assert np.allclose(np.cos(2 * raster(slide["field"], "theta")), np.cos(2 * theta))


def test_crossing_stripes_are_flagged():
    # Patches of horizontal and vertical stripes, wide enough that their seams weigh little.
    r, c = np.mgrid[0:128, 0:128]
    block = (r // 12 + c // 12) % 2
    crossed = np.where(block == 0, np.sin(1.5 * r), np.sin(1.5 * c))
    assert np.median(image.orientation(crossed, 0.5, 16.0)[2]) > 0.35
    r, c = np.mgrid[0:64, 0:64]
    theta, coherency, crossing = image.orientation(np.sin(0.3 * c), 0.5, 6.0)
    assert coherency[32, 32] > 0.99 and crossing[32, 32] < 0.05
    assert abs(np.cos(theta[32, 32])) < 1e-6  # along the stripes, at right angles to the gradient


def test_unit_scaled_image(spark, slide):
    scaled = slide["pixels"].withColumns({c: F.col(c) / 255.0 for c in "rgb"})
    a = histology.optical_densities(scaled).agg(F.sum("od_g")).first()[0]
    b = histology.optical_densities(slide["pixels"]).agg(F.sum("od_g")).first()[0]
    assert a == pytest.approx(b)


def test_blank_image_raises(spark):
    pdf = pd.DataFrame([("a", r, c, 240.0, 240.0, 240.0) for r in range(20) for c in range(20)], columns=["specimen", "row", "col", "r", "g", "b"])
    with pytest.raises(ValueError, match="no tissue"):
        histology.tissue(spark.createDataFrame(pdf), spark.createDataFrame([("a", 4.0)], "specimen string, pixel_size_um double"))


def test_controls(slide):
    field = slide["field"].orderBy("row", "col")
    mixed = geometry.morphology_mismatch(slide["field"], slide["extent"]).select("row", "col", "theta", "beta", "in_tissue").toPandas()
    assert len(mixed) == 8000
    theta, order = raster(slide["field"], "theta"), np.random.default_rng(0).permutation(6 * 5)
    want = theta.copy()
    for k, t in enumerate(order):
        want[t // 5 * 16:t // 5 * 16 + 16, t % 5 * 16:t % 5 * 16 + 16] = theta[k // 5 * 16:k // 5 * 16 + 16, k % 5 * 16:k % 5 * 16 + 16]
    got = np.empty((100, 80))
    got[mixed["row"], mixed["col"]] = mixed["theta"]
    assert np.array_equal(got, want) and (mixed.loc[~mixed["in_tissue"], "beta"] == 0).all()
    iso = geometry.isotropic(field).agg(F.max("theta"), F.max("beta")).first()
    assert tuple(iso) == (0.0, 0.0)


def full_square(spark, n):
    pdf = pd.DataFrame([("s", r, c, True) for r in range(n) for c in range(n)], columns=["specimen", "row", "col", "in_tissue"])
    extent = spark.createDataFrame([("s", n, n, 1.0)], "specimen string, n_rows long, n_cols long, pixel_size_um double")
    return spark.createDataFrame(pdf), extent


def test_lattice(spark):
    tissue, extent = full_square(spark, 5)
    m = mesh.build(tissue, extent, 1.0)
    got = mesh.summary(m).first()
    edges = mesh.edges(m)
    assert (got.n_nodes, got.n_triangles, edges.count(), got.connected) == (25, 32, 56, True)
    assert mesh.median_edge_length(edges).first().median_edge_um == 1.0
    assert mesh.component_areas(m).first().area == pytest.approx(16.0)
    ids = [r.node_id for r in mesh.dense_node_ids(mesh.nodes(m), m.frame).orderBy("node").collect()]
    assert ids == list(range(25))


def test_spacing_fallback_and_failure(spark):
    tissue, extent = full_square(spark, 12)
    assert mesh.build(tissue, extent, node_budget=10_000).frame.first().h == 4.0
    assert mesh.build(tissue, extent, node_budget=8).frame.first().h == 8.0
    with pytest.raises(ValueError, match="no admissible mesh spacing"):
        mesh.build(tissue, extent, 64.0)
    with pytest.raises(ValueError, match="keep_components"):
        mesh.build(tissue, extent, keep_components="some")


def test_corner_contact_joins_components(spark):
    mask = np.zeros((5, 5), dtype=bool)
    mask[0:3, 0:3] = mask[2:5, 2:5] = True
    r, c = np.nonzero(mask)
    tissue = spark.createDataFrame(pd.DataFrame({"specimen": "s", "row": r, "col": c, "in_tissue": True}))
    extent = spark.createDataFrame([("s", 5, 5, 1.0)], "specimen string, n_rows long, n_cols long, pixel_size_um double")
    assert mesh.summary(mesh.build(tissue, extent, 1.0)).first().n_components == 1


def plain_diameters(edges):
    """Per component: Dijkstra from its first node, then from the first of the farthest."""
    around, names = {}, {}
    for r in edges.itertuples(index=False):
        around.setdefault(r.src, []).append((r.dst, r.length))
        around.setdefault(r.dst, []).append((r.src, r.length))
        names[r.src] = names[r.dst] = r.component

    def sweep(source):
        dist, heap = {source: 0.0}, [(0.0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for u, w in around[v]:
                if d + w < dist.get(u, np.inf):
                    dist[u] = d + w
                    heapq.heappush(heap, (d + w, u))
        return dist

    out = {}
    for component in set(names.values()):
        first = sweep(min(n for n, c in names.items() if c == component))
        top = max(first.values())
        out[component] = max(sweep(min(n for n, d in first.items() if d > top - 1e-9)).values())
    return out


@pytest.mark.parametrize("tile", [256, 16])
def test_diameter(slide, tile):
    got = {r.component: r.diameter_um for r in geodesic.component_diameters(slide["mesh"], tile).collect()}
    assert got == pytest.approx(plain_diameters(mesh.edges(slide["mesh"]).toPandas()))


def test_diameters_of_many_components_over_tiles(spark):
    """A winding corridor that enters the same tiles many times, beside scraps of every size."""
    mask = np.zeros((41, 41), dtype=bool)
    for k in range(0, 40, 6):
        mask[k:k + 3, :30] = True
        turn = 27 if k % 12 == 0 else 0
        mask[k:k + 9, turn:turn + 3] = True
    mask[:, 32:] = np.random.default_rng(5).random((41, 9)) < 0.85
    r, c = np.nonzero(mask)
    tissue = spark.createDataFrame(pd.DataFrame({"specimen": "s", "row": r, "col": c, "in_tissue": True}))
    extent = spark.createDataFrame([("s", 41, 41, 1.0)], "specimen string, n_rows long, n_cols long, pixel_size_um double")
    with pytest.warns(UserWarning, match="separate components"):
        m = mesh.build(tissue, extent, 1.0)
    want = plain_diameters(mesh.edges(m).toPandas())
    assert len(want) > 2 and max(want.values()) > 150
    for tile in (256, 7, 16):
        got = {r.component: r.diameter_um for r in geodesic.component_diameters(m, tile).collect()}
        assert got == pytest.approx(want), tile


def test_locate_and_weights(spark, slide):
    rng = np.random.default_rng(4)
    xy = rng.random((300, 2)) * [330, 410] - 5
    pts = spark.createDataFrame(pd.DataFrame({"specimen": "a", "obs_id": range(300), "x_um": xy[:, 0], "y_um": xy[:, 1]}))
    located = materialise(projection.locate(pts, slide["mesh"], 5.0), "located")
    for radius in (None, 15.0):
        with pytest.raises(projection.OutsideTissueError):
            projection.footprint_weights(located, slide["nodes"], slide["mesh"].frame, radius)
    everywhere, located = located, located.where(projection.is_inside())
    w = projection.footprint_weights(located, slide["nodes"], slide["mesh"].frame)
    at = projection.interpolate(w, slide["nodes"], "x").toPandas().set_index("obs_id")["h"]
    inside = located.where("tri >= 0 AND NOT snapped").select("obs_id", "x_um").toPandas().set_index("obs_id")["x_um"]
    assert len(inside) > 100 and np.allclose(at[inside.index], inside)
    snapped = located.where("snapped").toPandas()
    assert len(snapped) > 0 and (snapped["snap_um"] <= 5.0).all() and (snapped["snap_um"] > 0).all()
    foot = projection.footprint_weights(located, slide["nodes"], slide["mesh"].frame, 15.0)
    sums = foot.groupBy("obs_id").agg(F.sum("w").alias("s")).toPandas()["s"]
    assert np.allclose(sums, 1.0) and len(sums) == located.where("tri >= 0").count()
    with pytest.raises(projection.OutsideTissueError, match="lie outside"):
        projection.require_inside(everywhere)
    kept = projection.contains(pts, slide["mesh"], 5.0)
    assert kept.columns == pts.columns and {r.obs_id for r in kept.collect()} == {r.obs_id for r in located.collect()}
    assert {r.obs_id for r in projection.snapped(everywhere).collect()} == set(snapped["obs_id"])


@pytest.mark.parametrize("tile", [16, 128])
def test_operator_against_dense_solve(spark, slide, tile):
    e = slide["entries"].toPandas()
    names = np.unique(e["i"])
    k, m = np.zeros((2, len(names), len(names)))
    i, j = np.searchsorted(names, e["i"]), np.searchsorted(names, e["j"])
    k[i, j], m[i, j] = e["k"], e["m"]
    assert np.array_equal(k, k.T) and np.allclose(k.sum(axis=1), 0, atol=1e-12)
    assert np.allclose(m.sum(axis=1), slide["nodes"].orderBy("node").toPandas()["area"])
    rng = np.random.default_rng(0)
    load = np.zeros(len(names))
    load[rng.integers(0, len(names), 20)] = 1.0
    loads = spark.createDataFrame(pd.DataFrame({"specimen": "a", "node": names, "load": load}))
    grid = spark.createDataFrame([("a", [16.0, 40.0, 100.0])], "specimen string, ells array<double>")
    u = materialise(transport.exposure_fields(slide["entries"], loads, slide["nodes"], grid, tile=tile), "u")
    for ell, part in u.toPandas().groupby("ell"):
        want = np.linalg.solve(k + m / ell ** 2, load)
        assert np.allclose(part.sort_values("node")["u"], want, atol=1e-9 * want.max())
    assert max(r.residual for r in transport.residuals(slide["entries"], u, loads).collect()) < 1e-9
    if tile < 128:
        return  # the other solves differ in their systems only
    slope = transport.log_range_derivative(slide["entries"], u.where("ell = 40.0"), slide["nodes"]).toPandas().sort_values("node")["u"]
    a, b = (np.linalg.solve(k + m / ell ** 2, load) for ell in (40 * np.exp(1e-4), 40 * np.exp(-1e-4)))
    assert np.allclose(slope, (a - b) / 2e-4, rtol=1e-4, atol=1e-6)
    got = transport.mass_solve(slide["entries"], loads, slide["nodes"]).toPandas().sort_values("node")["u"]
    assert np.allclose(got, np.linalg.solve(m, load))


def test_rounds_do_not_grow_with_range_or_mesh(spark):
    rounds = []
    for n in (24, 56):
        j, i = np.mgrid[0:n, 0:n]
        node, parts = j * n + i, []
        for dj, di, k, m in ((0, 1, -1.3, 2.0), (0, -1, -1.3, 2.0), (1, 0, -0.7, 2.0), (-1, 0, -0.7, 2.0), (1, 1, 0.0, 2.0), (-1, -1, 0.0, 2.0)):
            there = (j + dj >= 0) & (j + dj < n) & (i + di >= 0) & (i + di < n)
            parts.append(pd.DataFrame({"i": node[there], "j": ((j + dj) * n + i + di)[there], "k": k, "m": m}))
        e = pd.concat(parts)
        own = pd.DataFrame({"i": node.ravel(), "j": node.ravel(), "k": -e.groupby("i")["k"].sum().to_numpy(), "m": 12.0})
        entries = spark.createDataFrame(pd.concat([e, own]).assign(specimen="a", component=0)).withColumn("component", F.col("component").cast("int"))
        nodes = spark.createDataFrame(pd.DataFrame({"specimen": "a", "node": node.ravel(), "component": 0, "nx": n})).withColumn("component", F.col("component").cast("int"))
        load = spark.createDataFrame([("a", int(n * n // 3), 1.0)], "specimen string, node long, load double")
        boxes, levels = multigrid.build(entries, nodes, 16)
        assert len(levels) == (2 if n == 24 else 3)
        own, _ = multigrid.numbered(load, [])
        own = materialise(own.join(nodes.select("specimen", "node", "component"), ["specimen", "node"]), "placed")
        shifts = spark.createDataFrame([("a", 0, r, 1.0, 1.0 / ell ** 2) for r, ell in enumerate((4.0, 4000.0))], "specimen string, g int, ri int, kappa double, sigma double")
        trace = []
        multigrid.solve(boxes, levels, own, shifts, 16, trace)
        rounds.append(len(trace))
    assert max(rounds) <= 16 and abs(rounds[0] - rounds[1]) <= 3


def test_validation(slide):
    assert transport.validate(slide["entries"], slide["nodes"]).first().valid
    broken = slide["entries"].withColumn("k", F.when(F.col("i") > F.col("j"), F.col("k") * 2).otherwise(F.col("k")))
    with pytest.raises(transport.OperatorError, match="not symmetric"):
        transport.validate(broken, slide["nodes"], spectrum=False)
    assert len(transport.validate(broken, slide["nodes"], spectrum=False, strict=False).first().failures) >= 1


def test_smallest_eigenvalue_of_indefinite_matrices(spark):
    from spotfield.kernels.solver import Rows, smallest_eigenvalues

    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(2, 50))
        a = rng.normal(size=(n, n))
        k, m = a @ a.T / n - 0.3 * rng.random() * np.eye(n), np.diag(rng.random(n) + 0.5)
        half = np.diag(1 / np.sqrt(np.diag(m)))
        i, j = np.nonzero(np.ones((n, n)))
        rows = Rows(i, j, k[i, j], m[i, j])
        assert np.allclose(smallest_eigenvalues(rows, *rows.values, count=min(2, n)), np.linalg.eigvalsh(half @ k @ half)[:2], atol=1e-8)


def test_eigenvalue_rounds_do_not_grow_with_the_lattice(monkeypatch):
    """Residuals go through a factor, so a few products settle a lattice of any size, to more digits than are asked."""
    from spotfield.kernels.solver import Rows, smallest_eigenvalues

    calls = []
    product = Rows.times
    monkeypatch.setattr(Rows, "times", lambda self, values, x: calls.append(1) or product(self, values, x))
    for side in (20, 80):
        ids = np.arange(side * side).reshape(side, side)
        pdf = pd.concat([pd.DataFrame({"i": np.concatenate([p, q, p, q]), "j": np.concatenate([p, q, q, p]), "k": np.repeat([1.0, -1.0], 2 * len(p))})
                         for p, q in ((ids[:, 1:].ravel(), ids[:, :-1].ravel()), (ids[1:].ravel(), ids[:-1].ravel()))])
        pdf = pdf.groupby(["i", "j"], as_index=False).sum()
        rows = Rows(*[pdf[c].to_numpy() for c in "ijk"], (pdf["i"] == pdf["j"]).to_numpy(float))
        calls.clear()
        found = smallest_eigenvalues(rows, *rows.values, count=2)
        assert np.allclose(found, [0.0, 2 - 2 * np.cos(np.pi / side)], rtol=1e-9, atol=1e-13) and len(calls) <= 40
        # an indefinite stiffness is still found out
        bent = rows.values[0].copy()
        bent[np.flatnonzero(rows.on_diagonal)[len(rows.names) // 2]] -= 8.0
        low = smallest_eigenvalues(rows, bent, rows.values[1])[0]
        assert -8 < low < -1 and rows.factored(bent - (low + 1e-6) * rows.values[1]) is None
        assert rows.factored(bent - (low - 1e-6) * rows.values[1]) is not None


def test_eigenvalues_on_tables_of_indefinite_matrices(spark):
    """Dense matrices, each a component; all advance in the same rounds."""
    rng = np.random.default_rng(1)
    frames, want = [], {}
    for c, n in enumerate([2, 3, 7, 12, 13, 1]):
        a = rng.normal(size=(n, n))
        k, m = a @ a.T / n - 0.3 * rng.random() * np.eye(n), np.diag(rng.random(n) + 0.5)
        half = np.diag(1 / np.sqrt(np.diag(m)))
        i, j = np.nonzero(np.ones((n, n)))
        frames.append(pd.DataFrame({"specimen": "s", "component": c, "i": i, "j": j, "k": k[i, j], "m": m[i, j]}))
        want[c] = np.linalg.eigvalsh(half @ k @ half)[:2]
    entries = spark.createDataFrame(pd.concat(frames), "specimen string, component int, i long, j long, k double, m double")
    found = spectrum.smallest_eigenvalues(entries, 2).toPandas().sort_values(["component", "rank"])
    for c, values in want.items():
        assert np.allclose(found.loc[found["component"] == c, "eigenvalue"], values, atol=1e-8), c


def test_eigenvalue_on_tables_of_a_large_component(spark):
    """A dent in a lattice of 28,900 nodes; its vector dies out within the patch that is solved densely."""
    side, dent = 170, [(60, 60), (61, 60)]

    def matrix(nodes):
        at = {v: n for n, v in enumerate(nodes)}
        rows = []
        for (x, y), n in at.items():
            for other in ((x + 1, y), (x, y + 1)):
                if other in at:
                    o = at[other]
                    rows += [(n, n, 1.0), (o, o, 1.0), (n, o, -1.0), (o, n, -1.0)]
        a, b = at[dent[0]], at[dent[1]]
        return rows + [(a, a, -6.0), (b, b, -6.0), (a, b, 6.0), (b, a, 6.0)]

    patch = [(x, y) for x in range(42, 80) for y in range(42, 79)]
    dense = np.zeros((len(patch), len(patch)))
    for i, j, v in matrix(patch):
        dense[i, j] += v
    pdf = pd.DataFrame(matrix([(x, y) for x in range(side) for y in range(side)]), columns=["i", "j", "k"]).groupby(["i", "j"], as_index=False).sum()
    pdf["m"] = (pdf["i"] == pdf["j"]).astype(float)
    entries = spark.createDataFrame(pdf).selectExpr("'s' AS specimen", "0 AS component", "i", "j", "k", "m")
    found = spectrum.smallest_eigenvalues(entries).first().eigenvalue
    assert found < -1 and abs(found - np.linalg.eigvalsh(dense)[0]) < 1e-7


def test_negative_eigenvalue_fails_validation(slide):
    entries = slide["entries"]
    node = entries.where("i = j").agg(F.max("i")).first()[0]
    # a rotation of the row sums to zero keeps constants in the kernel
    other = entries.where(f"i = {node} AND j <> {node}").agg(F.min("j")).first()[0]
    push = entries.agg(F.max(F.abs("k"))).first()[0]
    here, there = F.col("i").isin(node, other), F.col("j").isin(node, other)
    bent = entries.withColumn("k", F.when(here & there, F.col("k") + F.when(F.col("i") == F.col("j"), -push).otherwise(push)).otherwise(F.col("k")))
    report = transport.validate(bent, slide["nodes"], strict=False).first()
    assert not report.valid and any("negative" in f for f in report.failures)
    assert transport.validate(entries, slide["nodes"], strict=False).first().valid
    lowest = transport.smallest_eigenvalues(entries, 3).orderBy("component", "rank").collect()
    assert [r["rank"] for r in lowest[:3]] == [1, 2, 3] and lowest[0].eigenvalue <= lowest[1].eigenvalue <= lowest[2].eigenvalue


@pytest.mark.parametrize("tile", [32, 128])
def test_receivers_read_the_solved_fields(spark, slide, tile):
    rng = np.random.default_rng(5)
    names = np.array(slide["nodes"].select("node").toPandas()["node"])
    load = spark.createDataFrame(pd.DataFrame({
        "specimen": "a", "pair_id": np.repeat([f"p{k}" for k in range(10)], 6), "node": rng.choice(names, 60), "load": rng.random(60)})).groupBy("specimen", "pair_id", "node").agg(F.sum("load").alias("load"))
    weights = spark.createDataFrame(pd.DataFrame({"specimen": "a", "obs_id": np.repeat(range(15), 2), "node": rng.choice(names, 30), "w": 0.5}))
    weights = materialise(weights.join(slide["nodes"].select("specimen", "node", "component"), ["specimen", "node"]).where("component = 0").drop("component"), "w")
    grid = spark.createDataFrame([("a", [16.0, 64.0, 24.0])], "specimen string, ells array<double>")
    fields = transport.exposure_fields(slide["entries"], load, slide["nodes"], grid, ["pair_id"])
    want = projection.interpolate(weights, fields, "u", ["pair_id", "ell"]).toPandas()
    got = transport.receiver_exposures(slide["entries"], load, weights, slide["nodes"], grid, ["pair_id"], tile).toPandas()
    both = got.merge(want, on=["specimen", "pair_id", "ell", "obs_id"], how="left")
    assert len(got) == weights.select("obs_id").distinct().count() * 30
    assert np.allclose(both["h_x"], both["h_y"].fillna(0.0), rtol=1e-8, atol=1e-12)


def test_components_of_one_tile_take_no_tables_of_tiles(slide, spark, monkeypatch):
    """One task a component: neither operators nor states of tiles are written, whatever the number of ranges."""
    def never(*_, **__):
        raise AssertionError("a component of one tile went through rounds")

    node = [r.node for r in slide["nodes"].orderBy("node").select("node").limit(40).collect()]
    load = spark.createDataFrame([("a", f"P{k}", n, 1.0 + k) for k in range(10) for n in node[k::10]], "specimen string, pair_id string, node long, load double")
    weights = spark.createDataFrame([("a", o, n, 0.5) for o, n in enumerate(node)], "specimen string, obs_id long, node long, w double")
    grid = spark.createDataFrame([("a", [20.0, 200.0])], "specimen string, ells array<double>")
    args = slide["entries"], load, weights, slide["nodes"], grid, ["pair_id"]
    e = slide["entries"].toPandas()
    names, at = np.unique(np.concatenate([e["i"], e["j"]]), return_inverse=True)
    stiff, mass = np.zeros((2, len(names), len(names)))
    stiff[at[:len(e)], at[len(e):]], mass[at[:len(e)], at[len(e):]] = e["k"], e["m"]
    want = {}
    for ell in (20.0, 200.0):
        for k in range(10):
            b = np.zeros(len(names))
            b[np.searchsorted(names, node[k::10])] = 1.0 + k
            u = np.linalg.solve(stiff + mass / ell ** 2, b)
            want.update({(f"P{k}", ell, o): 0.5 * u[np.searchsorted(names, n)] for o, n in enumerate(node)})
    monkeypatch.setattr(multigrid, "build", never)
    monkeypatch.setattr(multigrid, "solve", never)
    whole = {(r.pair_id, r.ell, r.obs_id): r.h for r in transport.receiver_exposures(*args).collect()}
    assert whole.keys() == want.keys() and len(whole) == 10 * 2 * 40
    assert all(np.isclose(h, want[at], rtol=1e-8, atol=1e-9) for at, h in whole.items())


@pytest.mark.parametrize("shape", [(14, 9), (9, 14), (7, 1)])
def test_elimination_solves_what_rounds_solve(shape, monkeypatch):
    """Components of one tile with short lines take no rounds; what elimination cannot do is left to them."""
    from spotfield.kernels import lattice

    rng, halo = np.random.default_rng(2), lattice.HALO
    mask = np.pad(rng.random(shape) < 0.85, halo + 1)
    k, m = np.zeros((2, 9, *mask.shape))
    for step in ((0, 1), (1, 0), (1, 1)):
        there, back = lattice.OFFSETS.index(step), lattice.OFFSETS.index((-step[0], -step[1]))
        w = rng.uniform(0.5, 2.0, mask.shape) * (mask & np.roll(mask, (-step[0], -step[1]), (0, 1)))
        other = np.roll(w, step, (0, 1))
        for a, sign in ((k, -1.0), (m, 0.1)):
            a[there] += sign * w
            a[back] += sign * other
            a[4] += w + other
    m[4] += mask
    b = rng.normal(size=(3, *mask.shape)) * mask
    shifts = [(1.0, 1.0 / e ** 2) for e in (1.0, 4.0, 30.0)] + [(0.0, 1.0)]
    place, name = np.argwhere(mask), -np.ones(mask.shape, int)
    name[mask] = np.arange(len(place))
    for numbers in (lattice.NUMBERS, 1):
        monkeypatch.setattr(lattice, "NUMBERS", numbers)
        for (kappa, sigma), x in zip(shifts, lattice.direct(k, m, b, shifts, 1e-12), strict=True):
            dense = np.zeros((len(place), len(place)))
            for o, (dj, di) in enumerate(lattice.OFFSETS):
                to = name[place[:, 0] + dj, place[:, 1] + di]
                dense[np.flatnonzero(to >= 0), to[to >= 0]] = (kappa * k + sigma * m)[o][mask][to >= 0]
            assert np.allclose(x[:, mask], np.linalg.solve(dense, b[:, mask].T).T, rtol=1e-9, atol=1e-12) and not x[:, ~mask].any()
    assert list(lattice.direct(k, m, np.where(mask, b, 1.0), shifts, 1e-12)) == [None] * 4
    assert list(lattice.direct(k, m, b * np.nan, shifts, 1e-12)) == [None] * 4
    monkeypatch.setattr(lattice, "LINE", 0)
    assert list(lattice.direct(k, m, b, shifts, 1e-12)) == [None] * 4


def test_products_meet_in_blocks(slide, spark, monkeypatch):
    """Products of matrices with fields equal the plain join, across blocks, with nulls, null keys and repeated rows."""
    nodes = [r.node for r in slide["nodes"].select("node").collect()]
    rng = np.random.default_rng(2)
    rows = [("a", k, int(n), float(rng.normal()) if rng.random() < 0.8 else None) for k in ("x", None) for n in nodes if rng.random() < 0.3]
    field = spark.createDataFrame(rows + rows[:9] + [("a", "x", -5, 1.0)], "specimen string, pair string, node long, u double")
    field = materialise(field, "field")
    e = slide["entries"]
    plain = e.join(field.withColumnRenamed("node", "j"), ["specimen", "j"]).groupBy("specimen", "pair", F.col("i").alias("node")).agg(
        F.sum(F.col("k") * F.col("u")).alias("ku"), F.sum(F.col("m") * F.col("u")).alias("mu"))
    want = {(r.pair, r.node): (r.ku, r.mu) for r in plain.collect()}
    monkeypatch.setattr(transport, "BLOCK", 100)
    product = transport.apply(e, field, "u", ["pair"])
    # every entry is shuffled once, beside the field: no row for each of an entry's products
    assert "SortMergeJoin" not in product._jdf.queryExecution().executedPlan().toString() and "HashAggregate" not in product._jdf.queryExecution().executedPlan().toString()
    got = {(r.pair, r.node): (r.ku, r.mu) for r in product.collect()}
    assert got.keys() == want.keys()
    for at, (ku, mu) in want.items():
        assert (ku is None) == (got[at][0] is None)
        assert ku is None or np.allclose(got[at], (ku, mu), rtol=1e-12, atol=1e-12)


def test_points_meet_the_raster_in_blocks_as_they_do_by_pixels(spark, monkeypatch):
    """Points beyond the raster are clamped, missing pixels drop theirs, copies stay; blocks of any size agree."""
    rng = np.random.default_rng(3)
    field = pd.DataFrame([(s, r, c, rng.random(), rng.random(), bool(rng.random() < 0.8)) for s in "ab" for r in range(13) for c in range(9) if (r, c) != (4, 4)],
                         columns=["specimen", "row", "col", "theta", "beta", "in_tissue"])
    extent = spark.createDataFrame([("a", 13, 9, 2.0), ("b", 13, 9, 2.0)], "specimen string, n_rows long, n_cols long, pixel_size_um double")
    points = pd.DataFrame({"specimen": rng.choice(["a", "b", "c"], 200), "obs_id": np.arange(200) // 2, "x_um": rng.random(200) * 24 - 3, "y_um": rng.random(200) * 32 - 3})
    field, points = spark.createDataFrame(field), spark.createDataFrame(points)
    order = ["specimen", "obs_id", "x_um"]
    want = geometry.tensor_at(points, field, extent, beta_scale=1.5).toPandas().sort_values(order, ignore_index=True)
    for side, tasks in ((64, 1), (4, 9)):
        monkeypatch.setattr(geometry, "PIXEL_BLOCK", side)
        got = geometry.tensor_at(points, field, extent, beta_scale=1.5, tasks=tasks).toPandas().sort_values(order, ignore_index=True)
        pd.testing.assert_frame_equal(got, want)


def test_points_meet_cells_and_footprints_read_nodes_once(spark, slide, monkeypatch):
    """Triangles are made of the cells that hold a point only; a footprint joins the nodes once."""
    met = []
    made = projection.halves
    monkeypatch.setattr(projection, "halves", lambda cells, frame: met.append(cells) or made(cells, frame))
    first = mesh.nodes(slide["mesh"]).orderBy("specimen", "node").limit(3)
    points = materialise(first.select("specimen", F.col("node").alias("obs_id"), (F.col("x") + 0.3).alias("x_um"), (F.col("y") + 0.2).alias("y_um")), "few")
    located = materialise(projection.locate(points, slide["mesh"]), "located-few")
    assert 0 < met[0].count() <= 12
    nodes = materialise(mesh.nodes(slide["mesh"]), "nodes-read-once")
    weights = projection.footprint_weights(located.where(projection.is_inside()), nodes, slide["mesh"].frame, 9.0)
    plan = weights._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("area#") and plan.count("Join") <= 2
    total = weights.groupBy("obs_id").agg(F.sum("w").alias("w")).toPandas()
    assert len(total) and np.allclose(total["w"], 1.0)
    # an empty footprint takes the weights of its triangle
    bare = projection.footprint_weights(located.where(projection.is_inside()), nodes, slide["mesh"].frame, 1e-3).toPandas().sort_values(["obs_id", "node"])
    want = projection.point_weights(located.where(projection.is_inside())).toPandas().sort_values(["obs_id", "node"])
    assert np.array_equal(bare["node"], want["node"]) and np.array_equal(bare["w"], want["w"])

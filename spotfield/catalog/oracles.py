"""Plain-SQL statements of the registered queries, for checking results.

Shared steps are named once below and pulled in as common table expressions.
"""

from __future__ import annotations

import math

from .. import settings as S
from ..functions.scalar import unmixing_weights
from ..sources.study import (
    EDGE_TOLERANCE_UM, IMAGE_COLS, MEDIAN_NN_UM, MESH_UM, OBS_PER_SPECIMEN, PAIRS, PIXEL_UM, PIXELS_PER_SPECIMEN, SPOT_UM)


def d(x: float) -> str:
    """A DOUBLE literal (a bare decimal would be a fixed-point number)."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def r6(x: str) -> str:
    return f"(round_even(({x}) * 1e6, 0) / 1e6 + 0e0)"


def r4(x: str) -> str:
    return f"(round_even(({x}) * 1e4, 0) / 1e4 + 0e0)"


def key(specimen: str, row: str, col: str) -> str:
    """One number per pixel, so that a shifted lookup stays a single equality."""
    return f"((({specimen}) * 65536 + ({row})) * 65536 + ({col}))"


STEPS: dict[str, tuple[list[str], str]] = {}


def step(name: str, needs: list[str], sql: str) -> None:
    STEPS[name] = (needs, sql)


def query(sql: str, *needs: str) -> str:
    seen: list[str] = []

    def add(name):
        for n in STEPS[name][0]:
            add(n)
        if name not in seen:
            seen.append(name)

    for n in needs:
        add(n)
    if not seen:
        return sql
    recursive = "RECURSIVE " if any("_reach" in n for n in seen) else ""
    parts = [f"{n} AS {'' if '_reach' in n else 'MATERIALIZED '}({STEPS[n][1]})" for n in seen]
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + sql


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(str(v) for v in r) + ")" for r in rows)


# -- molecular ----------------------------------------------------------------

step("counts", [], f"""
SELECT CAST(o_custkey // {OBS_PER_SPECIMEN} AS BIGINT) AS specimen, o_custkey AS obs_id, p_brand AS gene_id, sum(l_quantity) AS raw
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
step("obs", ["counts"], f"""
SELECT CAST(c_custkey // {OBS_PER_SPECIMEN} AS BIGINT) AS specimen, c_custkey AS obs_id,
  {d(PIXEL_UM)} * ((slot % 10) * 10 + (slot * 7) % 10) + jitter AS x_um, {d(PIXEL_UM)} * (slot // 10) + jitter AS y_um,
  state, coalesce(lib, 0e0) AS library_size
FROM (SELECT c_custkey, c_custkey % {OBS_PER_SPECIMEN} AS slot, c_acctbal - floor(c_acctbal) AS jitter, c_mktsegment AS state FROM customer)
LEFT JOIN (SELECT obs_id, sum(raw) AS lib FROM counts GROUP BY 1) ON obs_id = c_custkey""")
_PARTS = [(f"'{n}'", f"'{role}'", f"'{g}'", len(gs)) for n, lig, rec in PAIRS for role, gs in (("ligand", lig), ("receptor", rec)) for g in gs]
step("parts", [], f"SELECT * FROM ({_values(_PARTS)}) AS t(pair_id, role, gene_id, needed)")
step("specimens", [], f"SELECT DISTINCT CAST(o_orderkey // {PIXELS_PER_SPECIMEN} AS BIGINT) AS specimen FROM orders")
step("complexes", ["counts", "parts"], """
SELECT specimen, pair_id AS complex_id, obs_id, min(raw) AS raw FROM counts JOIN parts USING (gene_id)
WHERE role = 'ligand' AND raw > 0 GROUP BY specimen, pair_id, obs_id, needed HAVING count(*) = needed""")
step("z", ["complexes", "obs"], """
SELECT c.specimen, complex_id, c.obs_id, ln(1e0 + 1e4 * raw / greatest(library_size, 1e0)) AS z
FROM complexes c JOIN obs o ON c.obs_id = o.obs_id""")
step("scores", ["z"], """
SELECT specimen, complex_id, obs_id, z / (z + greatest(k, 1e-12)) AS score
FROM z JOIN (SELECT specimen, complex_id, median(z) AS k FROM z WHERE z > 0 GROUP BY 1, 2) USING (specimen, complex_id) WHERE z > 0""")
step("positive", ["counts", "parts", "obs"], """
SELECT c.specimen, pair_id, role, c.obs_id FROM counts c JOIN parts USING (gene_id) JOIN obs o ON o.obs_id = c.obs_id
WHERE raw >= 1 AND 1e4 * raw / greatest(library_size, 1e0) >= 1 GROUP BY c.specimen, pair_id, role, c.obs_id, needed HAVING count(*) = needed""")
step("tally", ["positive", "counts", "parts", "specimens"], """
SELECT s.specimen, p.pair_id,
  (SELECT count(*) FROM positive q WHERE q.specimen = s.specimen AND q.pair_id = p.pair_id AND role = 'ligand') AS n_positive_source,
  (SELECT count(*) FROM positive q WHERE q.specimen = s.specimen AND q.pair_id = p.pair_id AND role = 'receptor') AS n_competent_receivers,
  coalesce((SELECT CAST(trunc(sum(raw)) AS BIGINT) FROM counts c JOIN parts t USING (gene_id)
            WHERE c.specimen = s.specimen AND t.pair_id = p.pair_id AND role = 'ligand'), 0) AS total_raw_source
FROM specimens s CROSS JOIN (SELECT DISTINCT pair_id FROM parts) p""")
step("state_share", ["positive", "obs"], f"""
SELECT specimen, pair_id, max(competent / size) AS share FROM (
  SELECT p.specimen, pair_id, state, count(*) AS competent FROM positive p JOIN obs o ON o.obs_id = p.obs_id
  WHERE role = 'receptor' GROUP BY ALL)
JOIN (SELECT specimen, state, count(*) AS size FROM obs GROUP BY ALL HAVING count(*) >= {S.STATE_SIZE_NEEDED}) USING (specimen, state)
GROUP BY ALL""")
_ENOUGH = (f"n_positive_source >= {S.SOURCES_NEEDED} AND total_raw_source >= {S.SOURCE_COUNTS_NEEDED} "
           f"AND n_competent_receivers >= {S.RECEIVERS_NEEDED}")

# -- image --------------------------------------------------------------------

step("px", [], f"""
SELECT specimen, row, col, CASE WHEN tissue THEN 150e0 + n - 2 * stripe ELSE 240e0 - n END AS r,
  CASE WHEN tissue THEN 80e0 + 10 * stripe + n ELSE 238e0 - n END AS g,
  CASE WHEN tissue THEN 150e0 + 2 * stripe + n ELSE 242e0 - n END AS b
FROM (SELECT specimen, row, col, n,
    CASE WHEN row < 75 THEN sa WHEN row < 110 THEN sb WHEN (row // 4 + col // 4) % 2 = 0 THEN sa ELSE sb END AS stripe,
    (row BETWEEN 3 AND 146 AND (col BETWEEN 4 AND 70 OR col BETWEEN 84 AND 96)
      AND NOT (row - 60) * (row - 60) + (col - 35) * (col - 35) < 100)
    OR (row BETWEEN 68 AND 71 AND col BETWEEN 76 AND 78) AS tissue
  FROM (SELECT *, abs((2 * row + 3 * col) % 16 - 8) AS sa, abs((3 * row - 2 * col + 400) % 16 - 8) AS sb
    FROM (SELECT CAST(o_orderkey // {PIXELS_PER_SPECIMEN} AS BIGINT) AS specimen, (o_orderkey % {PIXELS_PER_SPECIMEN}) // {IMAGE_COLS} AS row,
            (o_orderkey % {PIXELS_PER_SPECIMEN}) % {IMAGE_COLS} AS col, CAST(floor(o_totalprice) AS BIGINT) % 9 AS n FROM orders)))""")
step("ext", ["px"], "SELECT specimen, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM px GROUP BY 1")
step("od", ["px"], """
SELECT specimen, row, col, -ln((r * f + 1e0) / 256e0) AS od_r, -ln((g * f + 1e0) / 256e0) AS od_g, -ln((b * f + 1e0) / 256e0) AS od_b
FROM px JOIN (SELECT specimen, CASE WHEN max(greatest(r, g, b)) <= 1e0 + 1e-9 THEN 255e0 ELSE 1e0 END AS f FROM px GROUP BY 1) USING (specimen)""")
_W = unmixing_weights()


def _mix(k):
    return f"greatest({d(_W[k][0])} * od_r + {d(_W[k][1])} * od_g + {d(_W[k][2])} * od_b, 0e0)"


step("stains", ["od"], f"""
SELECT specimen, row, col, {_mix(0)} AS hematoxylin, {_mix(1)} AS eosin, sqrt(od_r * od_r + od_g * od_g + od_b * od_b) AS od_norm FROM od""")


def _taps(sigma):
    reach = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [(k - reach, d(v / sum(raw))) for k, v in enumerate(raw)]


def _mirror(at, n):
    return f"CASE WHEN {at} < 0 THEN -({at}) - 1 WHEN {at} >= {n} THEN 2 * {n} - 1 - ({at}) ELSE {at} END"


def _clamp(at, n):
    return f"greatest(0, least({n} - 1, {at}))"


def _pass(name, source, columns, taps, axis, edge):
    """One separable filter pass: columns maps an output name to its input.

    The shifted positions are listed first, so the lookup is one plain equality.
    """
    at = edge(f"(row + t.k)" if axis == "row" else "(col + t.k)", "n_rows" if axis == "row" else "n_cols")
    there = key("specimen", at, "col") if axis == "row" else key("specimen", "row", at)
    step(f"{name}_at", ["px", "ext"], f"""
SELECT specimen, row, col, w, {there} AS there FROM px JOIN ext USING (specimen) CROSS JOIN ({_values(taps)}) t(k, w)""")
    step(f"{name}_k", [source], f"SELECT *, {key('specimen', 'row', 'col')} AS k FROM {source}")
    sums = ", ".join(f"sum(h.w * s.{c}) AS {o}" for o, c in columns.items())
    step(name, [f"{name}_at", f"{name}_k"], f"""
SELECT h.specimen, h.row, h.col, {sums} FROM {name}_at h JOIN {name}_k s ON s.k = h.there GROUP BY h.specimen, h.row, h.col""")


def _blur(name, source, columns, sigma):
    taps = _taps(sigma)
    _pass(f"{name}_v", source, columns, taps, "row", _mirror)
    _pass(name, f"{name}_v", {o: o for o in columns}, taps, "col", _mirror)


_blur("smooth", "stains", {"smooth": "od_norm"}, S.MASK_BLUR_UM / PIXEL_UM)
step("hist", ["smooth"], f"""
SELECT s.specimen, lo, hi, b.bin, lo + (b.bin + 0.5e0) * (hi - lo) / {d(S.OTSU_BINS)} AS center, coalesce(n, 0)::DOUBLE AS n
FROM (SELECT specimen, min(smooth) AS lo, max(smooth) AS hi FROM smooth GROUP BY 1) s CROSS JOIN range({S.OTSU_BINS}) b(bin)
LEFT JOIN (SELECT specimen, CAST(least(floor((smooth - lo) / (hi - lo) * {S.OTSU_BINS}), {S.OTSU_BINS - 1}) AS BIGINT) AS bin, count(*) AS n
  FROM smooth JOIN (SELECT specimen, min(smooth) AS lo, max(smooth) AS hi FROM smooth GROUP BY 1) USING (specimen) GROUP BY 1, 2) c
ON c.specimen = s.specimen AND c.bin = b.bin""")
step("otsu", ["hist"], """
SELECT specimen, center AS threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY specimen ORDER BY between_var DESC, bin) AS rn FROM (
    SELECT *, CASE WHEN below > 0 AND below < total THEN below * (total - below)
        * pow(moment / greatest(below, 1e0) - (grand - moment) / greatest(total - below, 1e0), 2) ELSE -1e0 END AS between_var FROM (
      SELECT *, sum(n) OVER w AS below, sum(n * center) OVER w AS moment, sum(n) OVER (PARTITION BY specimen) AS total,
        sum(n * center) OVER (PARTITION BY specimen) AS grand
      FROM hist WINDOW w AS (PARTITION BY specimen ORDER BY bin)))) WHERE rn = 1""")
step("mask0", ["smooth", "otsu"], "SELECT specimen, row, col FROM smooth JOIN otsu USING (specimen) WHERE smooth > threshold")


def _disk(radius):
    r = math.ceil(radius)
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if x * x + y * y <= radius * radius + 1e-9]


def _erode(name, source, offsets):
    step(f"{name}_at", [source], f"""
SELECT specimen, row, col, {key('specimen', 'row + dy', 'col + dx')} AS there FROM {source} CROSS JOIN ({_values(offsets)}) o(dy, dx)""")
    step(f"{name}_k", [source], f"SELECT {key('specimen', 'row', 'col')} AS k FROM {source}")
    step(name, [f"{name}_at", f"{name}_k"], f"""
SELECT specimen, row, col FROM {name}_at JOIN {name}_k ON k = there GROUP BY ALL HAVING count(*) = {len(offsets)}""")


def _dilate(source, offsets):
    return (f"SELECT DISTINCT m.specimen, m.row + dy AS row, m.col + dx AS col FROM {source} m JOIN ext e ON e.specimen = m.specimen "
            f"CROSS JOIN ({_values(offsets)}) o(dy, dx) WHERE m.row + dy BETWEEN 0 AND n_rows - 1 AND m.col + dx BETWEEN 0 AND n_cols - 1")


_OPEN, _CLOSE = _disk(S.OPENING_UM / PIXEL_UM), _disk(S.CLOSING_UM / PIXEL_UM)
_erode("mask1", "mask0", _OPEN)
step("opened", ["mask1", "ext"], _dilate("mask1", _OPEN))
step("mask3", ["opened", "ext"], _dilate("opened", _CLOSE))
_erode("closed", "mask3", _CLOSE)


def _components(prefix, source, row, col, gap):
    """Components through runs along rows and their closure; gap 0 or 1 (diagonal)."""
    step(f"{prefix}_runs", [source], f"""
SELECT specimen, {row} AS y, min({col}) AS a, max({col}) AS b, {row} * 4294967296 + min({col}) AS id
FROM (SELECT specimen, {row}, {col}, {col} - row_number() OVER (PARTITION BY specimen, {row} ORDER BY {col}) AS island FROM {source})
GROUP BY specimen, {row}, island""")
    step(f"{prefix}_links", [f"{prefix}_runs"], f"""
SELECT p.specimen, p.id AS u, q.id AS v FROM {prefix}_runs p JOIN {prefix}_runs q
ON p.specimen = q.specimen AND abs(p.y - q.y) = 1 AND p.a <= q.b + {gap} AND q.a <= p.b + {gap}""")
    step(f"{prefix}_reach", [f"{prefix}_links"], f"""
SELECT specimen, id AS u, id AS v FROM {prefix}_runs UNION
SELECT r.specimen, r.u, l.v FROM {prefix}_reach r JOIN {prefix}_links l ON l.specimen = r.specimen AND l.u = r.v""")
    step(f"{prefix}_roots", [f"{prefix}_reach", source], f"""
SELECT m.specimen, m.{row}, m.{col}, root FROM {source} m
JOIN {prefix}_runs r ON r.specimen = m.specimen AND r.y = m.{row} AND m.{col} BETWEEN r.a AND r.b
JOIN (SELECT specimen, u, min(v) AS root FROM {prefix}_reach GROUP BY 1, 2) k ON k.specimen = r.specimen AND k.u = r.id""")


_components("mask", "closed", "row", "col", 0)
_NEED = math.ceil(S.SMALLEST_TISSUE_UM2 / PIXEL_UM ** 2)
step("tissue", ["mask_roots"], f"""
SELECT specimen, row, col, root AS component FROM mask_roots
JOIN (SELECT specimen, root FROM mask_roots GROUP BY 1, 2 HAVING count(*) >= {_NEED}) USING (specimen, root)""")

# -- orientation --------------------------------------------------------------

_SLOPE = [(k - 2, d(w)) for k, w in enumerate(S.DERIVATIVE_TAPS[::-1])]
_PRE = [(k - 2, d(w)) for k, w in enumerate(S.PREFILTER_TAPS)]
_blur("channel", "stains", {"v": "eosin"}, S.DERIVATIVE_BLUR_UM / PIXEL_UM)
for source, prefix in (("channel", "grad"), ("stain_v", "raw_grad")):
    if source == "stain_v":
        step("stain_v", ["stains"], "SELECT specimen, row, col, eosin AS v FROM stains")
    _pass(f"{prefix}_x0", source, {"ex": "v"}, _SLOPE, "col", _clamp)
    _pass(f"{prefix}_x", f"{prefix}_x0", {"ex": "ex"}, _PRE, "row", _clamp)
    _pass(f"{prefix}_y0", source, {"ey": "v"}, _SLOPE, "row", _clamp)
    _pass(f"{prefix}_y", f"{prefix}_y0", {"ey": "ey"}, _PRE, "col", _clamp)
step("products", ["grad_x", "grad_y"], """
SELECT specimen, row, col, ex * ex AS xx, ex * ey AS xy, ey * ey AS yy, w, w * cos(2 * phi) AS c2, w * sin(2 * phi) AS s2,
  w * cos(4 * phi) AS c4, w * sin(4 * phi) AS s4
FROM (SELECT *, ex * ex + ey * ey AS w, atan2(ey, ex) AS phi FROM grad_x JOIN grad_y USING (specimen, row, col))""")
_blur("tensor", "products", {c: c for c in ("xx", "xy", "yy", "w", "c2", "s2", "c4", "s4")}, S.TENSOR_BLUR_UM / PIXEL_UM)
step("orient", ["tensor"], """
SELECT specimen, row, col, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy + 1e-12) AS coherency,
  0.5e0 * atan2(2 * xy, xx - yy) + 0.5e0 * pi() AS theta,
  sqrt(pow(c4 / dn - (c2 * c2 - s2 * s2) / (dn * dn), 2) + pow(s4 / dn - 2 * c2 * s2 / (dn * dn), 2)) AS crossing
FROM (SELECT *, w + 1e-12 AS dn FROM tensor)""")
step("field", ["orient", "tissue"], f"""
SELECT o.specimen, o.row, o.col, theta, coherency, crossing, component IS NOT NULL AS in_tissue,
  CASE WHEN component IS NOT NULL AND crossing <= {d(S.CROSSING_CEILING)}
    THEN {d(S.BETA_CEILING)} * greatest(0e0, least(1e0, (coherency - {d(S.COHERENCY_FLOOR)}) / {d(1 - S.COHERENCY_FLOOR)})) ELSE 0e0 END AS beta
FROM orient o LEFT JOIN tissue t ON t.specimen = o.specimen AND t.row = o.row AND t.col = o.col""")

# -- mesh ---------------------------------------------------------------------

_H, _P = d(MESH_UM), d(PIXEL_UM)


def _mesh(prefix, h):
    h = d(h)
    step(f"{prefix}frame", ["tissue"], f"""
SELECT specimen, min(col) * {_P} AS x0, min(row) * {_P} AS y0,
  CAST(ceil((max(col) - min(col)) * {_P} / {h} + 0.5e0) AS BIGINT) AS nx, CAST(ceil((max(row) - min(row)) * {_P} / {h} + 0.5e0) AS BIGINT) AS ny
FROM tissue GROUP BY 1""")
    # Both spacings are whole numbers of pixels, so lattice points sit on pixels.
    step(f"{prefix}lattice", [f"{prefix}frame", "tissue"], f"""
SELECT t.specimen, CAST((col * {_P} - x0) / {h} AS BIGINT) AS i, CAST((row * {_P} - y0) / {h} AS BIGINT) AS j
FROM tissue t JOIN {prefix}frame f ON f.specimen = t.specimen WHERE (col * {_P} - x0) % {h} = 0 AND (row * {_P} - y0) % {h} = 0""")
    step(f"{prefix}cells", [f"{prefix}lattice"], f"""
SELECT specimen, i - di AS i, j - dj AS j FROM {prefix}lattice CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(di, dj)
GROUP BY ALL HAVING count(*) = 4""")
    _components(f"{prefix}cell", f"{prefix}cells", "j", "i", 1)
    step(f"{prefix}numbered", [f"{prefix}cell_roots"], f"""
SELECT specimen, i, j, CAST(dense_rank() OVER (PARTITION BY specimen ORDER BY root) - 1 AS INTEGER) AS component FROM {prefix}cell_roots""")
    step(f"{prefix}tri", [f"{prefix}numbered", f"{prefix}frame"], f"""
SELECT specimen, component, i, j, half * nx * ny + j * nx + i AS tri, nx,
  j * nx + i + CASE WHEN half = 0 OR even THEN 0 ELSE 1 END AS na,
  j * nx + i + CASE WHEN half = 0 THEN 1 ELSE nx + 1 END AS nb,
  j * nx + i + CASE WHEN half = 0 AND even THEN nx + 1 ELSE nx END AS nc
FROM (SELECT *, (i + j) % 2 = 0 AS even FROM {prefix}numbered JOIN {prefix}frame USING (specimen)) CROSS JOIN (VALUES (0), (1)) t(half)""")
    step(f"{prefix}pts", [f"{prefix}frame", f"{prefix}tri"], f"""
SELECT specimen, node, component, x0 + (node % nx) * {h} AS x, y0 + (node // nx) * {h} AS y FROM
(SELECT specimen, na AS node, component FROM {prefix}tri UNION SELECT specimen, nb, component FROM {prefix}tri
 UNION SELECT specimen, nc, component FROM {prefix}tri) JOIN {prefix}frame USING (specimen)""")
    step(f"{prefix}tris", [f"{prefix}tri", f"{prefix}pts"], f"""
SELECT t.*, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, c.x AS xc, c.y AS yc, (a.x + b.x + c.x) / 3e0 AS mx, (a.y + b.y + c.y) / 3e0 AS my,
  0.5e0 * abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) AS area
FROM {prefix}tri t JOIN {prefix}pts a ON a.specimen = t.specimen AND a.node = na
JOIN {prefix}pts b ON b.specimen = t.specimen AND b.node = nb JOIN {prefix}pts c ON c.specimen = t.specimen AND c.node = nc""")
    step(f"{prefix}nodes", [f"{prefix}tris", f"{prefix}pts"], f"""
SELECT specimen, node, component, x, y, sum(area) AS area FROM {prefix}pts JOIN (
  SELECT specimen, unnest([na, nb, nc]) AS node, area / 3e0 AS area FROM {prefix}tris) t USING (specimen, node) GROUP BY ALL""")
    step(f"{prefix}edges", [f"{prefix}tri", f"{prefix}pts"], f"""
SELECT e.*, sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) AS length FROM (
  SELECT DISTINCT specimen, component, least(u, v) AS src, greatest(u, v) AS dst FROM (
    SELECT specimen, component, na AS u, nb AS v FROM {prefix}tri UNION ALL SELECT specimen, component, nb, nc FROM {prefix}tri
    UNION ALL SELECT specimen, component, nc, na FROM {prefix}tri)) e
JOIN {prefix}pts p ON p.specimen = e.specimen AND p.node = src JOIN {prefix}pts q ON q.specimen = e.specimen AND q.node = dst""")


_mesh("", MESH_UM)
_mesh("fine_", S.MESH_SPACINGS_UM[0])
# A length is a number of cell sides and of diagonals, so that equal ways are equal.
step("ways", ["edges"], f"""
SELECT specimen, component, unnest([src, dst]) AS u, unnest([dst, src]) AS v, CASE WHEN length > 1.2e0 * {_H} THEN 0 ELSE 1 END AS ds,
  CASE WHEN length > 1.2e0 * {_H} THEN 1 ELSE 0 END AS dg FROM edges""")


def _sweep(sources):
    """Shortest ways from one node (specimen, component, node) of each component."""
    return f"""
WITH RECURSIVE way(specimen, node, component, s, g) USING KEY (specimen, node) AS (
  SELECT specimen, node, component, 0, 0 FROM ({sources})
  UNION
  SELECT specimen, node, component, s, g FROM (
    SELECT *, row_number() OVER (PARTITION BY specimen, node ORDER BY s + g * sqrt(2e0)) AS rn FROM (
      SELECT w.specimen, v AS node, w.component, w.s + ds AS s, w.g + dg AS g, o.s AS old_s, o.g AS old_g
      FROM way w JOIN ways ON ways.specimen = w.specimen AND u = w.node LEFT JOIN recurring.way o ON o.specimen = w.specimen AND o.node = v)
    WHERE old_s IS NULL OR s + g * sqrt(2e0) < old_s + old_g * sqrt(2e0)) WHERE rn = 1)
SELECT * FROM way"""


_FIRST = "SELECT specimen, component, min(u) AS node FROM ways GROUP BY 1, 2"
step("far_ends", ["ways"], f"""
SELECT specimen, component, node FROM (SELECT *, row_number() OVER (PARTITION BY specimen, component ORDER BY s + g * sqrt(2e0) DESC, node) AS rn
FROM ({_sweep(_FIRST)})) WHERE rn = 1""")

# -- observations on the mesh -------------------------------------------------

_L1 = "((px - xa) * (yc - ya) - (xc - xa) * (py - ya)) / det"
_L2 = "((xb - xa) * (py - ya) - (px - xa) * (yb - ya)) / det"
step("near_tri", ["obs", "tris", "frame"], f"""
SELECT *, sqrt(pow(px - mx, 2) + pow(py - my, 2)) AS cd, 1e0 - l1 - l2 AS l0 FROM (SELECT *, {_L1} AS l1, {_L2} AS l2 FROM (
  SELECT o.specimen, obs_id, x_um AS px, y_um AS py, t.* EXCLUDE (specimen), (xb - xa) * (yc - ya) - (xc - xa) * (yb - ya) AS det
  FROM obs o JOIN frame f ON f.specimen = o.specimen JOIN tris t ON t.specimen = o.specimen
    AND abs(t.i - floor((x_um - x0) / {_H})) <= 5 AND abs(t.j - floor((y_um - y0) / {_H})) <= 5))""")
step("clipped", ["near_tri"], """
SELECT *, w0 / s AS f0, w1 / s AS f1, w2 / s AS f2 FROM (SELECT *, CASE WHEN w0 + w1 + w2 <= 0 THEN 1e0 ELSE w0 + w1 + w2 END AS s FROM (
  SELECT *, greatest(l0, 0e0) AS w0, greatest(l1, 0e0) AS w1, greatest(l2, 0e0) AS w2,
    row_number() OVER (PARTITION BY specimen, obs_id ORDER BY cd, tri) AS rank FROM near_tri)) WHERE rank <= 16""")
step("hits", ["clipped"], """
SELECT specimen, obs_id, component, px, py, tri, na, nb, nc, f0, f1, f2, false AS snapped, 0e0 AS snap_um FROM (
  SELECT *, row_number() OVER (PARTITION BY specimen, obs_id ORDER BY cd, tri) AS rn FROM clipped WHERE least(l0, l1, l2) >= -1e-9) WHERE rn = 1""")
step("snaps", ["clipped", "hits"], f"""
SELECT specimen, obs_id, component, px, py, tri, na, nb, nc, f0, f1, f2, true AS snapped, sd AS snap_um FROM (
  SELECT *, row_number() OVER (PARTITION BY specimen, obs_id ORDER BY sd, rank) AS rn FROM (
    SELECT *, sqrt(pow(f0 * xa + f1 * xb + f2 * xc - px, 2) + pow(f0 * ya + f1 * yb + f2 * yc - py, 2)) AS sd FROM clipped
    WHERE (specimen, obs_id) NOT IN (SELECT specimen, obs_id FROM hits)) WHERE sd <= {d(EDGE_TOLERANCE_UM)}) WHERE rn = 1""")
step("located", ["hits", "snaps", "obs"], """
SELECT o.specimen, o.obs_id, o.x_um, o.y_um, coalesce(tri, -1) AS tri, coalesce(component, -1) AS component, na, nb, nc, f0, f1, f2,
  coalesce(snapped, false) AS snapped, coalesce(snap_um, 0e0) AS snap_um
FROM obs o LEFT JOIN (SELECT * FROM hits UNION ALL SELECT * FROM snaps) h ON h.obs_id = o.obs_id""")
step("foot", ["located", "nodes"], f"""
SELECT l.specimen, l.obs_id, n.node, n.area FROM located l JOIN nodes n ON n.specimen = l.specimen AND n.component = l.component
WHERE tri >= 0 AND sqrt(pow(n.x - l.x_um, 2) + pow(n.y - l.y_um, 2)) <= {d(SPOT_UM)}""")
step("weights", ["foot", "located"], """
SELECT specimen, obs_id, node, area / sum(area) OVER (PARTITION BY specimen, obs_id) AS w FROM foot UNION ALL
SELECT specimen, obs_id, node, w FROM (
  SELECT specimen, obs_id, na AS node, f0 AS w FROM located WHERE tri >= 0 UNION ALL SELECT specimen, obs_id, nb, f1 FROM located WHERE tri >= 0
  UNION ALL SELECT specimen, obs_id, nc, f2 FROM located WHERE tri >= 0) WHERE w > 0 AND obs_id NOT IN (SELECT obs_id FROM foot)""")
step("load", ["weights", "scores"], """
SELECT w.specimen, complex_id AS pair_id, node, sum(w * score) AS load FROM weights w JOIN scores s ON s.obs_id = w.obs_id GROUP BY ALL""")

# -- transport ----------------------------------------------------------------

_AT = "greatest(0e0, least(round_even({v} / {p}, 0), {n} - 1e0))"


def _tensor(v):
    return (f"cos(theta) * cos(theta) * exp({v}) + sin(theta) * sin(theta) * exp(-{v}) AS a11, "
            f"cos(theta) * sin(theta) * (exp({v}) - exp(-{v})) AS a12, sin(theta) * sin(theta) * exp({v}) + cos(theta) * cos(theta) * exp(-{v}) AS a22")


step("field_k", ["field"], f"SELECT theta, beta, {key('specimen', 'row', 'col')}::DOUBLE AS k FROM field")
step("tris_at", ["tris", "ext"], f"""
SELECT t.*, {key('t.specimen', _AT.format(v='my', p=_P, n='n_rows'), _AT.format(v='mx', p=_P, n='n_cols'))}::DOUBLE AS there
FROM tris t JOIN ext e ON e.specimen = t.specimen""")
step("flux", ["tris_at", "field_k"], f"""
SELECT *, {_tensor('beta')}, (xb - xa) * (yc - ya) - (xc - xa) * (yb - ya) AS det FROM tris_at JOIN field_k ON k = there""")
step("obs_at", ["obs", "ext"], f"""
SELECT o.specimen, obs_id, {key('o.specimen', _AT.format(v='y_um', p=_P, n='n_rows'), _AT.format(v='x_um', p=_P, n='n_cols'))}::DOUBLE AS there
FROM obs o JOIN ext e ON e.specimen = o.specimen""")
step("grads", ["flux"], " UNION ALL ".join(
    f"SELECT specimen, component, tri, area, a11, a12, a22, {slot} AS slot, n{p} AS node, (y{q} - y{r}) / det AS gx, (x{r} - x{q}) / det AS gy FROM flux"
    for slot, (p, q, r) in enumerate((("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")))))
step("fem", ["grads"], """
SELECT u.specimen, u.component, u.node AS i, v.node AS j,
  sum(u.area * (u.gx * (u.a11 * v.gx + u.a12 * v.gy) + u.gy * (u.a12 * v.gx + u.a22 * v.gy))) AS k,
  sum(u.area / 12e0 * CASE WHEN u.slot = v.slot THEN 2e0 ELSE 1e0 END) AS m
FROM grads u JOIN grads v ON u.specimen = v.specimen AND u.tri = v.tri GROUP BY ALL""")

# -- points from embeddings ---------------------------------------------------

step("emb", [], """
SELECT vec_id AS obs_id, 1e3 * embedding[1]::DOUBLE AS x, 1e3 * embedding[2]::DOUBLE AS y, label AS component, embedding[3]::DOUBLE AS score FROM embeddings""")


def _pairs(extra=""):
    r = d(S.CONTACT_RADIUS_FACTOR * MEDIAN_NN_UM + 1e-9)
    return (f"SELECT p.obs_id AS obs_i, q.obs_id AS obs_j, q.score FROM emb p JOIN emb q ON p.obs_id <> q.obs_id "
            f"AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= {r}{extra}")


step("touch", ["emb"], _pairs())
step("touch_c", ["emb"], _pairs(" AND p.component = q.component"))

# -- evidence inputs ----------------------------------------------------------

step("pvals", [], "SELECT event_id, event_type, (1e0 + CAST(floor(value * 100) AS BIGINT) % 10000) / 10001e0 AS p FROM events")
step("losses", [], """
SELECT l_suppkey AS pair_id, CAST(l_linenumber % 2 AS INTEGER) AS fold, sum(l_extendedprice) AS loss_without,
  sum(l_extendedprice * (1e0 - l_discount)) AS loss_with, count(*) AS n FROM lineitem GROUP BY ALL""")
step("refits", [], """
SELECT l_partkey AS pair_id, 16e0 * pow(2e0, (CAST(l_quantity AS BIGINT) % 11) * 0.13e0) AS range_um,
  16e0 * pow(2e0, (l_partkey % 9) * 0.11e0) AS reference_um FROM lineitem""")
step("fits", [], """
SELECT o_orderkey AS pair_id, CAST(floor(o_totalprice) AS BIGINT) % 41 AS best_index,
  16e0 * pow(2e0, (CAST(floor(o_totalprice) AS BIGINT) % 41) / 8e0) AS ell_hat, o_totalprice / 50000e0 AS support,
  CASE WHEN o_orderkey % 2 = 0 THEN 0.90e0 ELSE 0.95e0 END AS level FROM orders""")


def _band(table, level="level"):
    return f"CASE WHEN {level} = 0.90e0 THEN {d(table[0.90])} ELSE {d(table[0.95])} END"


_PAIRS = "(VALUES " + ", ".join(f"('{name}')" for name, _, _ in PAIRS) + ") p(complex_id)"

ORACLES: dict[str, str] = {
    "score_bounded": query(f"""
SELECT o.specimen, p.complex_id, o.obs_id, {r6('coalesce(score, 0e0)')} AS score FROM obs o CROSS JOIN {_PAIRS} LEFT JOIN scores s
ON s.obs_id = o.obs_id AND s.complex_id = p.complex_id""", "obs", "scores"),
    "score_complex": query("SELECT specimen, complex_id, obs_id, raw FROM complexes", "complexes"),
    "score_all_ligands": query(f"SELECT specimen, complex_id, obs_id, {r6('score')} AS score FROM scores", "scores"),
    "qc_supplier": f"""
SELECT kind, id, total_umi, detected_genes, total_umi >= {S.QC_UMI} AND detected_genes >= {S.QC_GENES} AS keep,
  total_umi >= {S.QC_UMI} AND detected_genes >= {S.QC_GENES} AND mito_fraction <= {d(S.QC_MITO)} AS keep_mito FROM (
SELECT 'supplier' AS kind, l_suppkey AS id, sum(l_quantity) AS total_umi, count(DISTINCT l_partkey) AS detected_genes,
  avg(CASE WHEN l_discount > 0.08e0 THEN 1e0 ELSE 0e0 END) AS mito_fraction FROM lineitem GROUP BY 2 UNION ALL
SELECT 'customer', o_custkey, sum(l_quantity), count(DISTINCT l_partkey), avg(CASE WHEN l_discount > 0.08e0 THEN 1e0 ELSE 0e0 END)
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 2)""",
    "genes_detected": query(f"""
SELECT s.specimen, g.gene_id, coalesce(n, 0) AS n_detected, coalesce(n, 0) >= greatest({S.GENE_MIN_OBS}, ceil({d(S.GENE_MIN_FRACTION)} * n_obs)) AS detected
FROM (SELECT specimen, count(*) AS n_obs FROM obs GROUP BY 1) s CROSS JOIN (SELECT DISTINCT p_type AS gene_id FROM part) g
LEFT JOIN (SELECT o_custkey // {OBS_PER_SPECIMEN} AS specimen, p_type AS gene_id, count(DISTINCT o_custkey) AS n FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY ALL) c
ON c.specimen = s.specimen AND c.gene_id = g.gene_id""", "obs"),
    "pair_eligibility": query(f"SELECT *, {_ENOUGH} AS eligible FROM tally", "tally"),
    "pair_eligibility_states": query(f"""
SELECT t.*, {r6('coalesce(share, 0e0)')} AS max_state_fraction, {_ENOUGH} AND coalesce(share, 0e0) >= {d(S.STATE_FRACTION_NEEDED)} AS eligible
FROM tally t LEFT JOIN state_share USING (specimen, pair_id)""", "tally", "state_share"),
    "fdr_bh": query(f"""
SELECT event_id, event_type, {r6('p')} AS p, {r6('least(1e0, q)')} AS q FROM (
  SELECT *, min(raw) OVER (PARTITION BY event_type ORDER BY p DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS q FROM (
    SELECT *, p * count(*) OVER (PARTITION BY event_type) / rank_top AS raw FROM (
      SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY p) AS rank_top FROM pvals)))""", "pvals"),
    "p_calibrated": query(f"""
SELECT event_id, {r6(f'least(1e0, {d(S.CALIBRATION_SCALE)} * pow(p, {d(S.CALIBRATION_POWER)}))')} AS p FROM pvals""", "pvals"),
    "threshold_q99": f"""
SELECT l_returnflag AS specimen, {r4('quantile_cont(l_extendedprice * l_discount, 0.99)')} AS threshold FROM lineitem GROUP BY 1""",
    "folds_checkerboard": query("""
SELECT o.specimen, obs_id, CAST((greatest(0, least(7, CAST(trunc((x_um - x0) / greatest(x1 - x0, 1e-9) * 8) AS INTEGER)))
  + greatest(0, least(7, CAST(trunc((y_um - y0) / greatest(y1 - y0, 1e-9) * 8) AS INTEGER)))) % 2 AS INTEGER) AS fold
FROM obs o JOIN (SELECT specimen, min(x_um) AS x0, max(x_um) AS x1, min(y_um) AS y0, max(y_um) AS y1 FROM obs GROUP BY 1) b
ON b.specimen = o.specimen""", "obs"),
    "grid_master": query(f"SELECT specimen, CAST(k AS INTEGER) AS k, {r6('16e0 * pow(2e0, k / 8e0)')} AS ell_um FROM specimens CROSS JOIN range(41) t(k)", "specimens"),
    "grid_trusted": f"""
SELECT c_custkey, CAST(count(k) AS INTEGER) AS n_ranges, {r6('coalesce(min(ell), 0e0)')} AS first_um, {r6('coalesce(max(ell), 0e0)')} AS last_um FROM (
  SELECT c_custkey, greatest(16e0, 4e0 * 4e0, 0.5e0 * abs(c_acctbal) / 50e0) AS low, least(512e0, 0.25e0 * (200e0 + abs(c_acctbal))) AS high FROM customer)
LEFT JOIN (SELECT k, 16e0 * pow(2e0, k / 8e0) AS ell FROM range(41) t(k)) ON ell >= low - 1e-12 AND ell <= high + 1e-12 GROUP BY 1""",
    "phi_bounds": f"""
SELECT c_custkey, {r6('greatest(10e0, 2e0 * abs(c_acctbal) / 50e0)')} AS phi_low, {r6('least(1000e0, (200e0 + abs(c_acctbal)) / 3e0)')} AS phi_high FROM customer""",
    "range_decision": query(f"""
SELECT pair_id, status, {r6('coalesce(lower_um, -1e0)')} AS lower_um, {r6('coalesce(upper_um, -1e0)')} AS upper_um FROM (
  SELECT pair_id, CASE WHEN edge OR weak THEN 'unresolved' WHEN banded THEN 'interval' WHEN upper > 512e0 THEN 'uninformative' ELSE 'upper_bound' END AS status,
    CASE WHEN NOT edge AND NOT weak AND banded THEN low END AS lower_um,
    CASE WHEN edge OR weak THEN NULL WHEN banded THEN high WHEN upper <= 512e0 THEN upper END AS upper_um
  FROM (SELECT *, best_index <= 0 OR best_index >= 40 AS edge, support <= 3e0 AS weak, ell_hat < 64e0 AND low > 16e0 AND high <= 512e0 AS banded FROM (
    SELECT *, ell_hat / pow(2e0, {_band(S.SHORT_BAND)}) AS low, ell_hat * pow(2e0, {_band(S.SHORT_BAND)}) AS high,
      ell_hat * pow(2e0, CASE WHEN ell_hat < 64e0 THEN {_band(S.SHORT_UPPER)} ELSE {_band(S.LONG_UPPER)} END) AS upper FROM fits)))""", "fits"),
    "evidence_partial_r2": query(f"SELECT pair_id, fold, {r6('(loss_without - loss_with) / loss_without')} AS r2 FROM losses", "losses"),
    "evidence_specificity": query(f"""
SELECT pair_id, count(*) >= 2 AND bool_and((loss_without - loss_with) / loss_without >= {d(S.SPECIFICITY_R2)}) AS supported FROM losses GROUP BY 1""", "losses"),
    "evidence_gain": query(f"SELECT pair_id, fold, {r6('(loss_without - loss_with) / greatest(n, 1)')} AS gain FROM losses", "losses"),
    "robust_anisotropy": query(f"""
SELECT pair_id, {r6('log2(max(range_um) / min(range_um))')} AS spread_bits, log2(max(range_um) / min(range_um)) <= 1e0 AS robust FROM refits GROUP BY 1""", "refits"),
    "robust_response": query(f"""
SELECT pair_id, {r6('max(abs(log2(range_um / reference_um)))')} AS shift_bits, max(abs(log2(range_um / reference_um))) <= 1e0 AS robust FROM refits GROUP BY 1""", "refits"),
    "robust_mesh": query("""
SELECT pair_id, count(*) AS n, count(*) FILTER (abs(log2(range_um / reference_um)) <= 0.5e0) AS n_robust FROM refits GROUP BY 1""", "refits"),
    "contact_edges": query(f"""
SELECT obs_i, obs_j, {r6('1e0 / count(*) OVER (PARTITION BY obs_i)')} AS w FROM touch""", "touch"),
    "contact_exposure": query(f"""
SELECT e.obs_id, {r6('coalesce(h, 0e0)')} AS exposure FROM emb e LEFT JOIN (SELECT obs_i, avg(score) AS h FROM touch GROUP BY 1) t ON t.obs_i = e.obs_id""", "touch"),
    "contact_exposure_components": query(f"""
SELECT e.obs_id, {r6('coalesce(h, 0e0)')} AS exposure FROM emb e LEFT JOIN (SELECT obs_i, avg(score) AS h FROM touch_c GROUP BY 1) t ON t.obs_i = e.obs_id""", "touch_c"),
    "raster_od": query(f"SELECT specimen, row, col, {r6('od_r')} AS od_r, {r6('od_g')} AS od_g, {r6('od_b')} AS od_b FROM od", "od"),
    "raster_stains": query(f"SELECT specimen, row, col, {r6('hematoxylin')} AS hematoxylin, {r6('eosin')} AS eosin, {r6('od_norm')} AS od_norm FROM stains", "stains"),
    "raster_blur": query(f"SELECT specimen, row, col, {r6('smooth')} AS smooth FROM smooth", "smooth"),
    "raster_otsu": query(f"SELECT specimen, {r6('threshold')} AS threshold FROM otsu", "otsu"),
    "raster_derivative": query(f"SELECT specimen, row, col, {r6('ex')} AS ex, {r6('ey')} AS ey FROM raw_grad_x JOIN raw_grad_y USING (specimen, row, col)", "raw_grad_x", "raw_grad_y"),
    "raster_tensor": query(f"""
SELECT specimen, row, col, {r6('coherency')} AS coherency, {r6('cos(2 * theta) * coherency')} AS along, {r6('sin(2 * theta) * coherency')} AS across, {r6('beta')} AS beta
FROM field""", "field"),
    "raster_crossing": query(f"SELECT specimen, row, col, {r6('crossing')} AS crossing FROM orient", "orient"),
    "mask_opening": query("SELECT specimen, row, col FROM opened", "opened"),
    "mask_closing": query("SELECT specimen, row, col FROM closed", "closed"),
    "mask_components": query("SELECT specimen, row, col, component FROM tissue", "tissue"),
    "tissue_area": query(f"""
SELECT e.specimen, n_rows, n_cols, {r6(f'n * {_P} * {_P}')} AS tissue_area_um2, {r6('100e0 * n / (n_rows * n_cols)')} AS tissue_percent
FROM ext e JOIN (SELECT specimen, count(*) AS n FROM tissue GROUP BY 1) t ON t.specimen = e.specimen""", "tissue", "ext"),
    "anisotropic_fraction": query(f"""
SELECT specimen, {r6('coalesce(avg(CASE WHEN beta > 0 THEN 1e0 ELSE 0e0 END) FILTER (in_tissue), 0e0)')} AS anisotropic_fraction FROM field GROUP BY 1""", "field"),
    "geometry_isotropic": query(f"SELECT specimen, row, col, 0e0 AS theta, 0e0 AS beta, {r6('coherency')} AS coherency FROM field", "field"),
    "geometry_rotated": query(f"""
SELECT specimen, row, col, {r6('cos(2 * (theta + radians(90))) * coherency')} AS along, {r6('sin(2 * (theta + radians(90))) * coherency')} AS across, {r6('beta')} AS beta
FROM field""", "field"),
    "mesh_nodes": query(f"""
SELECT specimen, CAST(row_number() OVER (PARTITION BY specimen ORDER BY node) - 1 AS BIGINT) AS node_id, node, component, x, y, {r6('area')} AS area FROM fine_nodes""", "fine_nodes"),
    "mesh_triangles": query(f"SELECT specimen, tri, component, na AS node_a, nb AS node_b, nc AS node_c, {r6('area')} AS area FROM fine_tris", "fine_tris"),
    "mesh_edges": query(f"SELECT specimen, component, src, dst, {r6('length')} AS length FROM fine_edges", "fine_edges"),
    "mesh_component_areas": query(f"SELECT specimen, component, {r6('sum(area)')} AS area FROM fine_tris GROUP BY 1, 2", "fine_tris"),
    "mesh_edge_median": query(f"SELECT specimen, {r6('median(length)')} AS median_edge_um FROM fine_edges GROUP BY 1", "fine_edges"),
    "mesh_summary": query("""
SELECT n.specimen, n_nodes, n_triangles, n_components, n_components = 1 AS connected FROM
(SELECT specimen, count(*) AS n_nodes, count(DISTINCT component) AS n_components FROM fine_nodes GROUP BY 1) n
JOIN (SELECT specimen, count(*) AS n_triangles FROM fine_tri GROUP BY 1) t ON t.specimen = n.specimen""", "fine_nodes", "fine_tri"),
    "mesh_largest": query(f"""
SELECT specimen, CAST(0 AS INTEGER) AS component, n_nodes FROM (
  SELECT specimen, component, count(*) AS n_nodes, row_number() OVER (PARTITION BY specimen ORDER BY count(*) DESC, component) AS rn FROM nodes GROUP BY 1, 2) WHERE rn = 1""", "nodes"),
    "mesh_diameter": query(f"""
SELECT specimen, component, {r6(f'max(s + g * sqrt(2e0)) * {_H}')} AS diameter_um FROM ({_sweep("SELECT * FROM far_ends")}) GROUP BY 1, 2""", "far_ends"),
    "tensor_at": query(f"""
SELECT specimen, obs_id, {r6('a11')} AS a11, {r6('a12')} AS a12, {r6('a22')} AS a22 FROM (SELECT specimen, obs_id, {_tensor('beta')} FROM obs_at JOIN field_k ON k = there)""", "obs_at", "field_k"),
    "locate_points": query(f"""
SELECT specimen, obs_id, component, tri >= 0 AS inside, snapped, {r6('snap_um')} AS snap_um,
  {r6('coalesce(f0 * (na % nx) + f1 * (nb % nx) + f2 * (nc % nx), -1e0)')} AS lattice_x,
  {r6('coalesce(f0 * (na // nx) + f1 * (nb // nx) + f2 * (nc // nx), -1e0)')} AS lattice_y
FROM located JOIN frame USING (specimen)""", "located", "frame"),
    "location_report": query(f"""
SELECT specimen, count(*) AS n_points, count(*) FILTER (tri >= 0) AS n_inside, count(*) FILTER (tri < 0) AS n_outside,
  count(*) FILTER (snapped) AS n_snapped, {r6('max(snap_um)')} AS max_snap_um FROM located GROUP BY 1""", "located"),
    "outside_points": query("SELECT specimen, obs_id FROM located WHERE tri < 0", "located"),
    "footprint_weights": query(f"SELECT specimen, obs_id, node, {r6('w')} AS w FROM weights", "weights"),
    "deposit": query(f"SELECT specimen, pair_id, node, {r6('load')} AS load FROM load", "load"),
    "nodal_density": query(f"""
SELECT l.specimen, pair_id, l.node, {r6('load / CASE WHEN area > 0 THEN area ELSE 1e0 END')} AS density FROM load l
JOIN nodes n ON n.specimen = l.specimen AND n.node = l.node""", "load", "nodes"),
    "interpolate": query(f"""
SELECT w.specimen, w.obs_id, {r6('sum(w * x)')} AS h FROM weights w JOIN nodes n ON n.specimen = w.specimen AND n.node = w.node GROUP BY 1, 2""", "weights", "nodes"),
    "fem_entries": query(f"SELECT specimen, component, i, j, {r6('k')} AS k, {r6('m')} AS m FROM fem", "fem"),
    "fem_checks": query(f"""
SELECT f.specimen, 0e0 AS relative_symmetry, {r6('min_area')} AS min_lumped_mass, 0e0 AS constant_residual, true AS finite, n_components, nonzeros, {r6('scale')} AS scale
FROM (SELECT specimen, count(*) AS nonzeros, max(abs(k)) AS scale FROM fem GROUP BY 1) f
JOIN (SELECT specimen, min(area) AS min_area, count(DISTINCT component) AS n_components FROM nodes GROUP BY 1) n ON n.specimen = f.specimen""", "fem", "nodes"),
    "fem_residual": query(f"""
SELECT a.specimen, a.pair_id, {r6('norm / scale')} AS residual FROM (
  SELECT specimen, pair_id, sqrt(sum(pow(ku + mu / (64e0 * 64e0) - coalesce(load, 0e0), 2))) AS norm FROM (
    SELECT p.specimen, p.pair_id, i AS node, sum(k * u) AS ku, sum(m * u) AS mu FROM fem f
    JOIN (SELECT specimen, pair_id, node, load / CASE WHEN area > 0 THEN area ELSE 1e0 END AS u FROM load JOIN nodes USING (specimen, node)) p
    ON p.specimen = f.specimen AND p.node = f.j GROUP BY ALL) LEFT JOIN load USING (specimen, pair_id, node) GROUP BY ALL) a
JOIN (SELECT specimen, pair_id, sqrt(sum(load * load)) AS scale FROM load GROUP BY ALL) b ON a.specimen = b.specimen AND a.pair_id = b.pair_id""", "fem", "load", "nodes"),
    "exposure_recovered": query(f"""
SELECT n.specimen, a.pair_id, n.node, {r4('coalesce(l.load / CASE WHEN n.area > 0 THEN n.area ELSE 1e0 END, 0e0)')} AS u FROM nodes n
JOIN (SELECT DISTINCT specimen, pair_id, component FROM load JOIN nodes USING (specimen, node)) a ON a.specimen = n.specimen AND a.component = n.component
LEFT JOIN load l ON l.specimen = n.specimen AND l.node = n.node AND l.pair_id = a.pair_id""", "load", "nodes"),
    "exposure_residuals": query("""
SELECT DISTINCT specimen, pair_id, ell, true AS solved FROM load CROSS JOIN (VALUES (32e0), (128e0)) t(ell)""", "load"),
    "contained_points": query("SELECT specimen, obs_id FROM located WHERE tri >= 0", "located"),
    "exposure_mass_law": query(f"""
SELECT l.specimen, pair_id, n.component, ell, {r4('ell * ell * sum(load) / 1e3')} AS total FROM load l JOIN nodes n ON n.specimen = l.specimen AND n.node = l.node
CROSS JOIN (VALUES (16e0), (64e0), (128e0)) t(ell) GROUP BY l.specimen, pair_id, n.component, ell""", "load", "nodes"),
    "log_range_derivative": query(f"""
SELECT l.specimen, pair_id, n.component, ell, {r4('2e0 * ell * ell * sum(load) / 1e3')} AS total FROM load l JOIN nodes n ON n.specimen = l.specimen AND n.node = l.node
CROSS JOIN (VALUES (16e0), (64e0)) t(ell) GROUP BY l.specimen, pair_id, n.component, ell""", "load", "nodes"),
    "mass_solve": query(f"""
SELECT l.specimen, pair_id, n.component, {r6('sum(load)')} AS total FROM load l JOIN nodes n ON n.specimen = l.specimen AND n.node = l.node GROUP BY ALL""", "load", "nodes"),
    "matern_pairs": query(f"""
SELECT p.obs_id AS obs_i, q.obs_id AS obs_j, {r6('(1e0 - 0.25e0) * (1e0 + s) * exp(-s) + CASE WHEN p.obs_id = q.obs_id THEN 0.25e0 ELSE 0e0 END')} AS covariance
FROM (SELECT * FROM emb) p JOIN emb q ON sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 60e0
CROSS JOIN LATERAL (SELECT sqrt(3e0) * sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) / 40e0 AS s)""", "emb"),
    "gls_fit": query(f"""
SELECT specimen, response_id, {r4('regr_intercept(raw, library_size)')} AS intercept, {r6('regr_slope(raw, library_size)')} AS slope, 2 AS rank FROM (
  SELECT o.specimen, p.complex_id AS response_id, coalesce(raw, 0e0) AS raw, library_size FROM obs o CROSS JOIN {_PAIRS}
  LEFT JOIN complexes c ON c.obs_id = o.obs_id AND c.complex_id = p.complex_id)
GROUP BY ALL""", "obs", "complexes"),
    "flow_contact": query(f"""
SELECT o.specimen, o.complex_id, o.obs_id, {r6('coalesce(h, 0e0)')} AS h FROM (SELECT obs.*, complex_id FROM obs CROSS JOIN {_PAIRS}) o LEFT JOIN (
  SELECT p.obs_id, p.complex_id, avg(coalesce(score, 0e0)) AS h FROM (SELECT obs.*, complex_id FROM obs CROSS JOIN {_PAIRS}) p JOIN obs q ON p.specimen = q.specimen AND p.obs_id <> q.obs_id
    AND sqrt(pow(p.x_um - q.x_um, 2) + pow(p.y_um - q.y_um, 2)) <= {d(S.CONTACT_RADIUS_FACTOR * MEDIAN_NN_UM + 1e-9)}
  LEFT JOIN scores s ON s.obs_id = q.obs_id AND s.complex_id = p.complex_id GROUP BY ALL) t ON t.obs_id = o.obs_id AND t.complex_id = o.complex_id""", "obs", "scores"),
}

# Greedy order, one point a step: squared distances to the points picked so far travel along as a list.
_ORDER = """WITH RECURSIVE e AS MATERIALIZED (
  SELECT vec_id AS obs_id, 1e3 * embedding[1]::DOUBLE AS x, 1e3 * embedding[2]::DOUBLE AS y FROM embeddings),
l AS MATERIALIZED (SELECT list(obs_id ORDER BY obs_id) AS ids, list(x ORDER BY obs_id) AS xs, list(y ORDER BY obs_id) AS ys, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM e),
c AS MATERIALIZED (SELECT *, list_transform(range(1, n + 1), lambda i: pow(xs[i] - mx, 2) + pow(ys[i] - my, 2)) AS centre FROM l),
o(pos, pick, scale, near) AS (
  SELECT CAST(0 AS BIGINT), CAST(list_position(centre, list_min(centre)) AS BIGINT), -1e0, list_transform(range(1, n + 1), lambda i: CAST('infinity' AS DOUBLE)) FROM c
  UNION ALL
  SELECT pos + 1, CAST(list_position(upd, list_max(upd)) AS BIGINT), list_max(upd), upd FROM (
    SELECT pos, n, list_transform(range(1, n + 1), lambda i: CASE WHEN i = pick THEN -1e0
      ELSE least(near[i], pow(xs[i] - xs[pick], 2) + pow(ys[i] - ys[pick], 2)) END) AS upd FROM o, c) WHERE pos + 1 < n),
p AS MATERIALIZED (SELECT ids[pick] AS obs_id, pos, scale, xs[pick] AS x, ys[pick] AS y FROM o, c)
"""
ORACLES["maximin_order"] = _ORDER + f"SELECT obs_id, pos, {r6('scale')} AS scale FROM p"
ORACLES["neighbour_sets"] = ORACLES["neighbour_sets_in_rounds"] = _ORDER + f"""
SELECT obs_id, neighbour FROM (
  SELECT a.obs_id, b.obs_id AS neighbour, row_number() OVER (PARTITION BY a.obs_id ORDER BY pow(b.x - a.x, 2) + pow(b.y - a.y, 2), b.pos) AS k
  FROM p a JOIN p b ON b.pos < a.pos) WHERE k <= {S.NEIGHBOURS}"""

"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings as S
from ..functions import scalar
from ..operators import association, contact, evidence, geometry, histology, mesh, molecular, ordering, projection, ranges, transport
from ..operators.tiles import raster_extent
from ..plans import flows
from ..runtime import materialise
from ..sources.study import EDGE_TOLERANCE_UM, MEDIAN_NN_UM, OBS_PER_SPECIMEN, Study, open_study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(open_study(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def r6(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)


def r4(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * F.lit(1e4)) / F.lit(1e4) + F.lit(0.0)


# -- molecular ----------------------------------------------------------------

@registered
def score_bounded(s: Study):
    scores = molecular.bounded_scores(molecular.complex_counts(s.written_counts, s.ligands), s.observations)
    return _of_every_pair(s).join(scores.select("specimen", "complex_id", "obs_id", "score"), ["specimen", "complex_id", "obs_id"], "left").select(
        "specimen", "complex_id", "obs_id", r6(F.coalesce("score", F.lit(0.0))).alias("score"))


def _of_every_pair(s: Study, *columns: str):
    """Every observation beside every pair asked of its specimen."""
    return s.observations.select("specimen", "obs_id", *columns).join(s.ligands.select("specimen", "complex_id"), "specimen")


@registered
def score_complex(s: Study):
    return molecular.complex_counts(s.counts, s.ligands)


@registered
def score_all_ligands(s: Study):
    return s.ligand_scores.select("specimen", "complex_id", "obs_id", r6("score").alias("score"))


@registered
def qc_supplier(s: Study):
    lines = s.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    buyers = lines.join(s.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")

    def depth(df, kind, key):
        # Distinct parts are counted from per-part rows, so a busy key stays spread.
        per_part = df.groupBy(F.col(key).alias("id"), "l_partkey").agg(
            F.sum("l_quantity").alias("q"), F.count_if(F.col("l_discount") > F.lit(0.08)).alias("m"), F.count("*").alias("n"))
        return per_part.groupBy("id").agg(
            F.sum("q").alias("total_umi"), F.count("*").alias("detected_genes"),
            (F.sum("m") / F.sum("n")).alias("mito_fraction")).withColumn("kind", F.lit(kind))

    both = depth(lines, "supplier", "l_suppkey").unionByName(depth(buyers, "customer", "o_custkey"))
    plain = molecular.qc_pass(both).withColumnRenamed("keep", "plain")
    return molecular.qc_pass(plain, mito=True).select(
        "kind", "id", "total_umi", "detected_genes", F.col("plain").alias("keep"), F.col("keep").alias("keep_mito"))


@registered
def genes_detected(s: Study):
    lines = s.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = s.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("gene_id"))
    orders = s.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("obs_id"))
    counts = (
        lines.join(parts, "l_partkey").join(orders, "l_orderkey").groupBy("obs_id", "gene_id").agg(F.sum("l_quantity").alias("raw"))
        .withColumn("specimen", F.floor(F.col("obs_id") / OBS_PER_SPECIMEN).cast("long")))
    observed = s.observations.select("specimen", "obs_id")
    counts = materialise(counts, "type-counts")
    genes = counts.select("specimen", "gene_id").distinct()
    return molecular.detected_genes(counts, observed, genes)


@registered
def pair_eligibility(s: Study):
    return molecular.eligibility(s.written_counts, s.observations, s.pairs).drop("max_state_fraction")


@registered
def pair_eligibility_states(s: Study):
    return molecular.eligibility(s.written_counts, s.observations, s.pairs, use_states=True).withColumn(
        "max_state_fraction", r6("max_state_fraction"))


# -- evidence -----------------------------------------------------------------

def _pvalues(s: Study):
    return s.table("events").select(
        "event_id", "event_type", ((F.lit(1.0) + F.floor(F.col("value") * 100) % 10000) / F.lit(10001.0)).alias("p"))


def _losses(s: Study):
    return s.table("lineitem").groupBy(F.col("l_suppkey").alias("pair_id"), (F.col("l_linenumber") % 2).alias("fold")).agg(
        F.sum("l_extendedprice").alias("loss_without"),
        F.sum(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("loss_with"), F.count("*").alias("n"))


def _refits(s: Study):
    def step(k, bits):
        return F.lit(16.0) * F.pow(F.lit(2.0), k * F.lit(bits))

    return s.table("lineitem").select(
        F.col("l_partkey").alias("pair_id"), step(F.col("l_quantity").cast("long") % 11, 0.13).alias("range_um"),
        step(F.col("l_partkey") % 9, 0.11).alias("reference_um"))


@registered
def fdr_bh(s: Study):
    return evidence.fdr(_pvalues(s), ["event_type"]).select("event_id", "event_type", r6("p").alias("p"), r6("q").alias("q"))


@registered
def p_calibrated(s: Study):
    return _pvalues(s).select("event_id", r6(scalar.calibrated_p("p")).alias("p"))


@registered
def threshold_q99(s: Study):
    stats = s.table("lineitem").select(
        F.col("l_returnflag").alias("specimen"), (F.col("l_extendedprice") * F.col("l_discount")).alias("lambda_t1"))
    return evidence.support_threshold(stats, ["specimen"]).select("specimen", r4("threshold").alias("threshold"))


@registered
def folds_checkerboard(s: Study):
    return evidence.checkerboard_folds(s.observations).select("specimen", "obs_id", "fold")


@registered
def grid_master(s: Study):
    return s.specimens.select("specimen", F.posexplode(scalar.master_ranges()).alias("k", "ell_um")).withColumn("ell_um", r6("ell_um"))


@registered
def grid_trusted(s: Study):
    wealth = F.abs("c_acctbal")
    ells = scalar.trusted_ranges(F.lit(4.0), wealth / F.lit(50.0), F.lit(200.0) + wealth)
    return s.table("customer").select("c_custkey", ells.alias("e")).select(
        "c_custkey", F.size("e").alias("n_ranges"), r6(F.coalesce(F.array_min("e"), F.lit(0.0))).alias("first_um"),
        r6(F.coalesce(F.array_max("e"), F.lit(0.0))).alias("last_um"))


@registered
def phi_bounds(s: Study):
    wealth = F.abs("c_acctbal")
    return s.table("customer").select(
        "c_custkey", r6(scalar.phi_low(wealth / F.lit(50.0))).alias("phi_low"),
        r6(scalar.phi_high(F.lit(200.0) + wealth)).alias("phi_high"))


@registered
def range_decision(s: Study):
    k = F.floor("o_totalprice") % 41
    level = F.when(F.col("o_orderkey") % 2 == 0, F.lit(0.90)).otherwise(F.lit(0.95))
    fits = s.table("orders").select(
        F.col("o_orderkey").alias("pair_id"), k.alias("k"), (F.lit(16.0) * F.pow(F.lit(2.0), k / F.lit(8.0))).alias("ell_hat"),
        (F.col("o_totalprice") / F.lit(50000.0)).alias("support"), level.alias("level"))
    report = scalar.range_report("ell_hat", "k", F.lit(41), "support", F.lit(3.0), F.lit(16.0), F.lit(512.0), "level")
    return fits.select("pair_id", report.alias("r")).select(
        "pair_id", "r.status", r6(F.coalesce("r.lower_um", F.lit(-1.0))).alias("lower_um"),
        r6(F.coalesce("r.upper_um", F.lit(-1.0))).alias("upper_um"))


@registered
def evidence_partial_r2(s: Study):
    return _losses(s).select("pair_id", "fold", r6(scalar.partial_r2("loss_without", "loss_with")).alias("r2"))


@registered
def evidence_specificity(s: Study):
    r2 = _losses(s).withColumn("r2", scalar.partial_r2("loss_without", "loss_with"))
    return evidence.specificity(r2, ["pair_id"])


@registered
def evidence_gain(s: Study):
    return _losses(s).select("pair_id", "fold", r6(scalar.geometry_gain("loss_without", "loss_with", "n")).alias("gain"))


@registered
def robust_anisotropy(s: Study):
    return evidence.anisotropy_robust(_refits(s), ["pair_id"]).withColumn("spread_bits", r6("spread_bits"))


@registered
def robust_response(s: Study):
    return evidence.response_robust(_refits(s), ["pair_id"]).withColumn("shift_bits", r6("shift_bits"))


@registered
def robust_mesh(s: Study):
    return _refits(s).groupBy("pair_id").agg(
        F.count("*").alias("n"), F.count_if(scalar.mesh_robust("reference_um", "range_um")).alias("n_robust"))


# -- contact ------------------------------------------------------------------

@registered
def contact_edges(s: Study):
    edges = contact.contact_edges(s.embedding_points, S.CONTACT_RADIUS_FACTOR * MEDIAN_NN_UM)
    return edges.select("obs_i", "obs_j", r6("w").alias("w"))


@registered
def contact_exposure(s: Study):
    return contact.contact_exposure(s.embedding_points, MEDIAN_NN_UM).select("obs_id", r6("exposure").alias("exposure"))


@registered
def contact_exposure_components(s: Study):
    return contact.contact_exposure(s.embedding_points, MEDIAN_NN_UM, by_component=True).select("obs_id", r6("exposure").alias("exposure"))


# -- image --------------------------------------------------------------------

def _rasters(s: Study):
    return histology.stains(histology.optical_densities(s.pixels)), raster_extent(s.pixels, s.specimens)


def _thresholded(s: Study):
    base, extent = _rasters(s)
    smooth = materialise(histology.smoothed(base, extent, "od_norm", S.MASK_BLUR_UM), "smooth")
    threshold = materialise(histology.otsu_thresholds(smooth, "smooth"), "otsu")
    return smooth.join(threshold, "specimen").withColumn("raw_mask", F.col("smooth") > F.col("threshold")), extent


@registered
def raster_od(s: Study):
    return histology.optical_densities(s.pixels).select("specimen", "row", "col", *[r6(f"od_{c}").alias(f"od_{c}") for c in "rgb"])


@registered
def raster_stains(s: Study):
    base = histology.stains(histology.optical_densities(s.pixels))
    return base.select("specimen", "row", "col", *[r6(c).alias(c) for c in ("hematoxylin", "eosin", "od_norm")])


@registered
def raster_blur(s: Study):
    base, extent = _rasters(s)
    return histology.smoothed(base, extent, "od_norm", S.MASK_BLUR_UM).withColumn("smooth", r6("smooth"))


@registered
def raster_otsu(s: Study):
    base, extent = _rasters(s)
    smooth = materialise(histology.smoothed(base, extent, "od_norm", S.MASK_BLUR_UM), "smooth")
    return histology.otsu_thresholds(smooth, "smooth").withColumn("threshold", r6("threshold"))


@registered
def raster_derivative(s: Study):
    base, extent = _rasters(s)
    return geometry.image_gradients(base, extent, "eosin").select("specimen", "row", "col", r6("ex").alias("ex"), r6("ey").alias("ey"))


def _directions(field):
    return field.select(
        "specimen", "row", "col", r6(F.cos(F.lit(2.0) * F.col("theta")) * F.col("coherency")).alias("along"),
        r6(F.sin(F.lit(2.0) * F.col("theta")) * F.col("coherency")).alias("across"), r6("beta").alias("beta"), r6("coherency").alias("coherency"))


@registered
def raster_tensor(s: Study):
    return _directions(geometry.orientation_field(s.tissue, s.extent))


@registered
def raster_crossing(s: Study):
    return geometry.orientation_field(s.tissue, s.extent).select("specimen", "row", "col", r6("crossing").alias("crossing"))


@registered
def mask_opening(s: Study):
    raw, extent = _thresholded(s)
    return histology.opened_and_closed(raw, extent, "raw_mask", closing_um=0.0).where("mask").select("specimen", "row", "col")


@registered
def mask_closing(s: Study):
    raw, extent = _thresholded(s)
    return histology.opened_and_closed(raw, extent, "raw_mask").where("mask").select("specimen", "row", "col")


@registered
def mask_components(s: Study):
    return s.tissue.where("in_tissue").select("specimen", "row", "col", "component")


@registered
def tissue_area(s: Study):
    return histology.tissue_summary(s.tissue, s.extent).withColumns(
        {"tissue_area_um2": r6("tissue_area_um2"), "tissue_percent": r6("tissue_percent")})


@registered
def anisotropic_fraction(s: Study):
    return geometry.anisotropic_fraction(s.field).withColumn("anisotropic_fraction", r6("anisotropic_fraction"))


@registered
def geometry_isotropic(s: Study):
    return geometry.isotropic(s.field).select("specimen", "row", "col", "theta", "beta", r6("coherency").alias("coherency"))


@registered
def geometry_rotated(s: Study):
    return _directions(geometry.rotated(s.field)).drop("coherency")


@registered
def geometry_mismatch(s: Study):
    return geometry.morphology_mismatch(s.field, s.extent).select("specimen", "row", "col", "theta", "beta", "in_tissue")


# -- mesh ---------------------------------------------------------------------

def _fine(s: Study):
    return s.fine_mesh


@registered
def mesh_nodes(s: Study):
    m = _fine(s)
    return mesh.dense_node_ids(mesh.nodes(m), m.frame).select(
        "specimen", "node_id", "node", "component", "x", "y", r6("area").alias("area"))


@registered
def mesh_triangles(s: Study):
    return mesh.triangles(_fine(s)).select(
        "specimen", "tri", "component", F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b"), F.col("c.node").alias("node_c"),
        r6("area").alias("area"))


@registered
def mesh_edges(s: Study):
    return mesh.edges(_fine(s)).select("specimen", "component", "src", "dst", r6("length").alias("length"))


@registered
def mesh_component_areas(s: Study):
    return mesh.component_areas(_fine(s)).withColumn("area", r6("area"))


@registered
def mesh_edge_median(s: Study):
    return mesh.median_edge_length(mesh.edges(_fine(s))).withColumn("median_edge_um", r6("median_edge_um"))


@registered
def mesh_summary(s: Study):
    return mesh.summary(_fine(s)).select("specimen", "n_nodes", "n_triangles", "n_components", "connected")


@registered
def mesh_largest(s: Study):
    kept = mesh.nodes(mesh.keep_largest(s.mesh))
    return kept.groupBy("specimen", "component").agg(F.count("*").alias("n_nodes"))


@registered
def mesh_diameter(s: Study):
    return s.diameters.withColumn("diameter_um", r6("diameter_um"))


# -- observations on the mesh -------------------------------------------------

@registered
def tensor_at(s: Study):
    return geometry.tensor_at(s.observations.select("specimen", "obs_id", "x_um", "y_um"), s.field, s.extent).select(
        "specimen", "obs_id", *[r6(c).alias(c) for c in ("a11", "a12", "a22")])


@registered
def locate_points(s: Study):
    nx = F.col("nx")

    def mix(part):
        total = sum((F.col("weights")[k] * part(F.col("nodes")[k]) for k in range(3)), F.lit(0.0))
        return r6(F.when(F.col("tri") >= 0, total).otherwise(F.lit(-1.0)))

    return s.located.join(s.mesh.frame, "specimen").select(
        "specimen", "obs_id", "component", (F.col("tri") >= 0).alias("inside"), "snapped", r6("snap_um").alias("snap_um"),
        mix(lambda n: n % nx).alias("lattice_x"), mix(lambda n: F.floor(n / nx)).alias("lattice_y"))


@registered
def location_report(s: Study):
    return projection.location_report(s.located).withColumn("max_snap_um", r6("max_snap_um"))


@registered
def outside_points(s: Study):
    return projection.outside(s.located).select("specimen", "obs_id")


@registered
def footprint_weights(s: Study):
    return s.weights.select("specimen", "obs_id", "node", r6("w").alias("w"))


@registered
def deposit(s: Study):
    return s.load.withColumn("load", r6("load"))


@registered
def nodal_density(s: Study):
    return projection.nodal_density(s.load, s.nodes).select("specimen", "pair_id", "node", r6("density").alias("density"))


@registered
def interpolate(s: Study):
    return projection.interpolate(s.weights, s.nodes, "x").withColumn("h", r6("h"))


# -- transport ----------------------------------------------------------------

@registered
def fem_entries(s: Study):
    return transport.assemble(s.mesh, s.field, s.extent).select("specimen", "component", "i", "j", r6("k").alias("k"), r6("m").alias("m"))


@registered
def fem_checks(s: Study):
    return transport.checks(s.entries, s.nodes).select(
        "specimen", r6("relative_symmetry").alias("relative_symmetry"), r6("min_lumped_mass").alias("min_lumped_mass"),
        r6("constant_residual").alias("constant_residual"), "finite", "n_components", "nonzeros", r6("scale").alias("scale"))


@registered
def fem_spectrum(s: Study):
    return transport.validate(s.entries, s.nodes)


@registered
def fem_residual(s: Study):
    load = materialise(s.load, "load")
    trial = projection.nodal_density(load, s.nodes).select(
        "specimen", "pair_id", F.lit(64.0).alias("ell"), "node", F.col("density").alias("u"))
    return transport.residuals(s.entries, trial, load, ["pair_id"]).select("specimen", "pair_id", r6("residual").alias("residual"))


def _ells(s: Study, *ells):
    return s.specimens.select("specimen", F.array(*[F.lit(e) for e in ells]).alias("ells"))


def _integral(fields, nodes):
    """Integral of a nodal field over each component."""
    return fields.join(nodes.select("specimen", "node", "area"), ["specimen", "node"]).groupBy(
        "specimen", "pair_id", "component", "ell").agg(F.sum(F.col("u") * F.col("area")).alias("total"))


@registered
def exposure_field(s: Study):
    return transport.exposure_fields(s.entries, s.load, s.nodes, flows.range_grid(s.mesh.frame, s.specimens, s.diameters), ["pair_id"])


@registered
def exposure_recovered(s: Study):
    """A known field, the load that the assembled operator makes of it, and the field solved from that load."""
    known = projection.nodal_density(s.load, s.nodes).select("specimen", "pair_id", "node", F.col("density").alias("u"))
    made = transport.apply(s.entries, known, "u", ["pair_id"]).select(
        "specimen", "pair_id", "node", (F.col("ku") + F.col("mu") / F.lit(64.0 * 64.0)).alias("load"))
    return transport.exposure_fields(s.entries, materialise(made, "made"), s.nodes, _ells(s, 64.0), ["pair_id"]).select(
        "specimen", "pair_id", "node", r4("u").alias("u"))


@registered
def exposure_residuals(s: Study):
    """Whether solved fields satisfy the assembled system, per pair and range."""
    load = materialise(s.load, "load")
    u = materialise(transport.exposure_fields(s.entries, load, s.nodes, _ells(s, 32.0, 128.0), ["pair_id"]), "fields")
    return transport.residuals(s.entries, u, load, ["pair_id"]).select("specimen", "pair_id", "ell", (F.col("residual") < F.lit(1e-9)).alias("solved"))


@registered
def contained_points(s: Study):
    return projection.contains(s.observations, s.mesh, EDGE_TOLERANCE_UM).select("specimen", "obs_id")


@registered
def exposure_mass_law(s: Study):
    u = transport.exposure_fields(s.entries, s.load, s.nodes, _ells(s, 16.0, 64.0, 128.0), ["pair_id"])
    return _integral(u, s.nodes).withColumn("total", r4(F.col("total") / F.lit(1e3)))


@registered
def log_range_derivative(s: Study):
    u = materialise(transport.exposure_fields(s.entries, s.load, s.nodes, _ells(s, 16.0, 64.0), ["pair_id"]), "fields")
    slope = transport.log_range_derivative(s.entries, u, s.nodes, ["pair_id"])
    return _integral(slope, s.nodes).withColumn("total", r4(F.col("total") / F.lit(1e3)))


@registered
def mass_solve(s: Study):
    u = transport.mass_solve(s.entries, s.load, s.nodes, ["pair_id"]).withColumn("ell", F.lit(0.0))
    return _integral(u, s.nodes).select("specimen", "pair_id", "component", r6("total").alias("total"))


# -- association --------------------------------------------------------------

@registered
def matern_pairs(s: Study):
    """Entries within 60 um only; those beyond are not zero (0.20 at the radius), so this is not the covariance."""
    return association.covariance_pairs(s.embedding_points, 40.0, 0.25, 60.0).select("obs_i", "obs_j", r6("covariance").alias("covariance"))


def _embedding_data(s: Study):
    """Third embedding coordinate against intercept and the fourth; each label is a specimen."""
    e = F.col("embedding")
    return s.table("embeddings").select(
        F.col("label").alias("specimen"), F.lit("e2").alias("response_id"), F.col("vec_id").alias("obs_id"),
        (F.lit(1000.0) * e[0].cast("double")).alias("x_um"), (F.lit(1000.0) * e[1].cast("double")).alias("y_um"),
        e[2].cast("double").alias("y"), F.array(F.lit(1.0), e[3].cast("double")).alias("baseline"), e)


def _embedding_exposures(data):
    e = F.col("embedding")
    pairs = F.array(*[F.struct(F.lit(float(16 * 2 ** k)).alias("ell"), e[4 + k].cast("double").alias("h")) for k in range(6)])
    return data.select("specimen", "response_id", "obs_id", F.explode(pairs).alias("z")).select(
        "specimen", "response_id", "obs_id", "z.ell", "z.h")


def _embedding_fit(s: Study, method="vecchia"):
    bounds = _embedding_data(s).select("specimen").distinct().select("specimen", F.lit(20.0).alias("phi_low"), F.lit(200.0).alias("phi_high"))
    return association.fit_covariance(_embedding_data(s), bounds, method)


@registered
def gls_fit(s: Study):
    raw = molecular.complex_counts(s.written_counts, s.ligands).select("specimen", "complex_id", "obs_id", "raw")
    data = _of_every_pair(s, "library_size").join(raw, ["specimen", "complex_id", "obs_id"], "left").select(
        "specimen", F.col("complex_id").alias("response_id"), F.coalesce("raw", F.lit(0.0)).alias("y"),
        F.array(F.lit(1.0), "library_size").alias("baseline"))
    return association.least_squares_fits(data).select(
        "specimen", "response_id", r4(F.col("coefficients")[0]).alias("intercept"), r6(F.col("coefficients")[1]).alias("slope"), "rank")


@registered
def covariance_fit(s: Study):
    """One n x n matrix a label in one task: for labels of some thousand observations at most, see the README."""
    return _embedding_fit(s, "dense")


@registered
def covariance_fit_neighbours(s: Study):
    return _embedding_fit(s, "vecchia")


@registered
def association_profile(s: Study):
    data = _embedding_data(s)
    return association.profile_points(association.association_profiles(data, _embedding_exposures(data), _embedding_fit(s)))


@registered
def bootstrap_p(s: Study):
    data = _embedding_data(s)
    return association.bootstrap_pvalues(association.association_profiles(data, _embedding_exposures(data), _embedding_fit(s)))


@registered
def maximin_order(s: Study):
    return _order(s).select("obs_id", "pos", r6(F.when(F.col("pos") == 0, -1.0).otherwise(F.col("scale"))).alias("scale"))


def _order(s: Study):
    return ordering.maximin_order(s.embedding_points)


@registered
def neighbour_sets(s: Study):
    near = ordering.earlier_neighbours(_order(s))
    return near.select("obs_id", F.explode("near").alias("nb")).select("obs_id", F.col("nb.obs_id").alias("neighbour"))


@registered
def neighbour_sets_in_rounds(s: Study):
    """The same order and sets by the way that takes points of any number."""
    points = s.embedding_points
    near = ordering.earlier_neighbours(ordering.maximin_order(points, local_points=100), local_points=100)
    return near.select("obs_id", F.explode("near").alias("nb")).select("obs_id", F.col("nb.obs_id").alias("neighbour"))


@registered
def vecchia_factor(s: Study):
    near = ordering.earlier_neighbours(ordering.maximin_order(s.embedding_points))
    return association.neighbour_factor(near, 40.0, 0.25)


def _range_data(s: Study):
    """Counts of each pair's receptor complex, the least of its subunits, zero where absent."""
    receptors = s.pairs.select("specimen", F.col("pair_id").alias("complex_id"), F.col("receptor_subunits").alias("subunits"))
    counts = molecular.complex_counts(s.written_counts, receptors).select("specimen", F.col("complex_id").alias("response_id"), "obs_id", "raw")
    inside = s.located.where(projection.is_inside()).join(receptors.select("specimen", F.col("complex_id").alias("response_id")), "specimen")
    return inside.join(counts, ["specimen", "response_id", "obs_id"], "left").select(
        "specimen", "response_id", "obs_id", "x_um", "y_um", F.coalesce("raw", F.lit(0.0)).alias("y"), "library_size",
        F.array((F.col("detected_genes") / F.lit(25.0))).alias("covariates"))


def _secreted(s: Study):
    return s.secreted


def _association_data(s: Study):
    """Log-CP10K of the receptor gene against intercept and log library size."""
    return _range_data(s).select(
        "specimen", "response_id", "obs_id", "x_um", "y_um", F.log1p(scalar.cp10k("y", "library_size")).alias("y"),
        F.array(F.lit(1.0), F.log1p("library_size")).alias("baseline"))


@registered
def nb_profile(s: Study):
    return ranges.range_profiles(_range_data(s), _secreted(s))


@registered
def flow_secreted(s: Study):
    return _secreted(s)


@registered
def flow_contact(s: Study):
    # one field of contacts per specimen and pair
    field = F.struct("specimen", "complex_id").alias("specimen")
    points = _of_every_pair(s, "x_um", "y_um").select(field, "obs_id", "x_um", "y_um")
    scores = s.ligand_scores.select(field, "obs_id", "score")
    return flows.contact_exposures(points, scores, MEDIAN_NN_UM).select(
        "specimen.specimen", "specimen.complex_id", "obs_id", r6("exposure").alias("h"))


@registered
def flow_association(s: Study):
    return flows.association_test(_association_data(s), _secreted(s), flows.covariance_bounds(s.specimens, s.diameters))


@registered
def flow_range(s: Study):
    # The near-null statistics are the caller's choice; scaled counts stand in here.
    data, exposures = _range_data(s), _secreted(s)
    near_null = s.written_counts.select("specimen", (F.col("raw") / F.lit(100.0)).alias("lambda_t1"))
    return flows.estimate_ranges(data, exposures, near_null)


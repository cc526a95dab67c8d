"""A study laid over the relational test tables.

Orders are the pixels of one 150 x 100 image per 15,000 order keys, customers are
observations on those images, and line items joined to parts are gene counts.
Images, observations and specimens all grow with the tables.

Stage tables (tissue, mesh, ...) are written once per study and reused, as a
caller would keep them between analyses.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geodesic, geometry, histology, mesh, molecular, projection, transport
from ..runtime import materialise, release, ship_package

PIXEL_UM = 4.0
IMAGE_ROWS, IMAGE_COLS = 150, 100
PIXELS_PER_SPECIMEN = IMAGE_ROWS * IMAGE_COLS
OBS_PER_SPECIMEN = PIXELS_PER_SPECIMEN // 10
MESH_UM = 4.0
SPOT_UM = 10.0
EDGE_TOLERANCE_UM = 6.0
MEDIAN_NN_UM = 10.0


class Study:
    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- molecular inputs -----------------------------------------------------

    @property
    def counts(self) -> DataFrame:
        """(specimen, obs_id, gene_id, raw): quantity of each brand per customer."""
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("obs_id"))
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene_id"))
        return (
            lines.join(parts, "l_partkey").join(orders, "l_orderkey")
            .groupBy("obs_id", "gene_id").agg(F.sum("l_quantity").alias("raw"))
            .select(_specimen("obs_id", OBS_PER_SPECIMEN), "obs_id", "gene_id", "raw"))

    @cached_property
    def written_counts(self) -> DataFrame:
        return materialise(self.counts, "counts")

    @cached_property
    def observations(self) -> DataFrame:
        """Customers placed on their image, with library size and state."""
        depth = self.written_counts.groupBy("obs_id").agg(
            F.sum("raw").alias("library_size"), F.count("*").alias("detected_genes"))
        slot = F.col("c_custkey") % OBS_PER_SPECIMEN
        jitter = F.col("c_acctbal") - F.floor("c_acctbal")
        return materialise(
            self.table("customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("state"))
            .join(depth.withColumnRenamed("obs_id", "c_custkey"), "c_custkey", "left")
            .select(
                _specimen("c_custkey", OBS_PER_SPECIMEN), F.col("c_custkey").alias("obs_id"),
                (F.lit(PIXEL_UM) * ((slot % 10) * 10 + (slot * 7) % 10) + jitter).alias("x_um"),
                (F.lit(PIXEL_UM) * F.floor(slot / 10) + jitter).alias("y_um"), "state",
                F.coalesce("library_size", F.lit(0.0)).alias("library_size"),
                F.coalesce("detected_genes", F.lit(0)).alias("detected_genes")), "observations")

    @property
    def pairs(self) -> DataFrame:
        """The same three ligand-receptor pairs asked of every specimen."""
        asked = F.array(*[
            F.struct(F.lit(name).alias("pair_id"), F.array(*map(F.lit, lig)).alias("ligand_subunits"),
                     F.array(*map(F.lit, rec)).alias("receptor_subunits")) for name, lig, rec in PAIRS])
        return self.specimens.select("specimen", F.explode(asked).alias("a")).select("specimen", "a.*")

    @property
    def ligands(self) -> DataFrame:
        return self.pairs.select("specimen", F.col("pair_id").alias("complex_id"), F.col("ligand_subunits").alias("subunits"))

    @cached_property
    def ligand_scores(self) -> DataFrame:
        """(specimen, complex_id, obs_id, score), zero rows absent."""
        raw = molecular.complex_counts(self.written_counts, self.ligands)
        return materialise(molecular.bounded_scores(raw, self.observations), "scores")

    # -- image and mesh -------------------------------------------------------

    @cached_property
    def specimens(self) -> DataFrame:
        keys = self.table("orders").select(_specimen("o_orderkey", PIXELS_PER_SPECIMEN)).distinct()
        return materialise(keys.select(
            "specimen", F.lit(PIXEL_UM).alias("pixel_size_um"), F.lit(MEDIAN_NN_UM).alias("median_nn_um")), "specimens")

    @property
    def pixels(self) -> DataFrame:
        """Stained image: two tissue bodies, a hole, a speck and crossing stripes."""
        slot = F.col("o_orderkey") % PIXELS_PER_SPECIMEN
        base = self.table("orders").select(
            _specimen("o_orderkey", PIXELS_PER_SPECIMEN), F.floor(slot / IMAGE_COLS).alias("row"), (slot % IMAGE_COLS).alias("col"),
            (F.floor("o_totalprice") % 9).cast("double").alias("n"))
        row, col, n = F.col("row"), F.col("col"), F.col("n")
        stripe_a = F.abs((2 * row + 3 * col) % 16 - 8)
        stripe_b = F.abs((3 * row - 2 * col + 400) % 16 - 8)
        block = (F.floor(row / 4) + F.floor(col / 4)) % 2
        stripe = F.when(row < 75, stripe_a).when(row < 110, stripe_b).when(block == 0, stripe_a).otherwise(stripe_b).cast("double")
        hole = (row - 60) * (row - 60) + (col - 35) * (col - 35) < 100
        body = row.between(3, 146) & (col.between(4, 70) | col.between(84, 96)) & ~hole
        speck = row.between(68, 71) & col.between(76, 78)
        tissue = body | speck

        def channel(inside, outside):
            return F.when(tissue, inside).otherwise(outside)

        return base.select(
            "specimen", "row", "col",
            channel(F.lit(150.0) + n - 2 * stripe, F.lit(240.0) - n).alias("r"),
            channel(F.lit(80.0) + 10 * stripe + n, F.lit(238.0) - n).alias("g"),
            channel(F.lit(150.0) + 2 * stripe + n, F.lit(242.0) - n).alias("b"))

    @cached_property
    def _tissue(self):
        return histology.tissue(self.pixels, self.specimens)

    @property
    def tissue(self) -> DataFrame:
        return self._tissue[0]

    @property
    def extent(self) -> DataFrame:
        return self._tissue[1]

    @cached_property
    def field(self) -> DataFrame:
        return materialise(geometry.orientation_field(self.tissue, self.extent), "field")

    @cached_property
    def mesh(self) -> mesh.Mesh:
        return mesh.build(self.tissue, self.extent, MESH_UM)

    @cached_property
    def fine_mesh(self) -> mesh.Mesh:
        """At the default spacing."""
        return mesh.build(self.tissue, self.extent)

    @cached_property
    def nodes(self) -> DataFrame:
        return materialise(mesh.nodes(self.mesh), "nodes")

    @cached_property
    def entries(self) -> DataFrame:
        return materialise(transport.assemble(self.mesh, self.field, self.extent), "entries")

    @cached_property
    def diameters(self) -> DataFrame:
        return materialise(geodesic.component_diameters(self.mesh), "diameters")

    # -- observations on the mesh ---------------------------------------------

    @cached_property
    def located(self) -> DataFrame:
        return materialise(projection.locate(self.observations, self.mesh, EDGE_TOLERANCE_UM), "located")

    @cached_property
    def weights(self) -> DataFrame:
        return materialise(projection.footprint_weights(self.located.where(projection.is_inside()), self.nodes, self.mesh.frame, SPOT_UM), "weights")

    @property
    def load(self) -> DataFrame:
        return projection.deposit(self.weights, self.ligand_scores.withColumnRenamed("complex_id", "pair_id"), "score", ["pair_id"])

    @cached_property
    def secreted(self) -> DataFrame:
        """Exposure of every observation to every pair at every trusted range."""
        from ..plans import flows

        grid = materialise(flows.range_grid(self.mesh.frame, self.specimens, self.diameters), "grid")
        scores = self.ligand_scores.withColumnRenamed("complex_id", "response_id")
        return materialise(flows.secreted_exposures(scores, self.weights, self.nodes, self.entries, grid, ["response_id"]), "exposures")

    @property
    def embedding_points(self) -> DataFrame:
        """Embedding vectors as observations: first two coordinates, label as component."""
        e = F.col("embedding")
        return self.table("embeddings").select(
            F.lit(0).alias("specimen"), F.col("vec_id").alias("obs_id"),
            (F.lit(1000.0) * e[0].cast("double")).alias("x_um"), (F.lit(1000.0) * e[1].cast("double")).alias("y_um"),
            F.col("label").alias("component"), e[2].cast("double").alias("score"))


PAIRS = [
    ("P1", ["Brand#1"], ["Brand#2", "Brand#3"]),
    ("P2", ["Brand#4", "Brand#5"], ["Brand#6"]),
    ("P3", ["Brand#7", "Brand#8", "Brand#9"], ["Brand#10", "Brand#11", "Brand#12", "Brand#13", "Brand#14"]),
]


def _specimen(key: str, size: int):
    return F.floor(F.col(key) / F.lit(size)).cast("long").alias("specimen")


_OPEN: dict[tuple[str, str], Study] = {}


def open_study(spark: SparkSession, sf_dir: str) -> Study:
    """The study over ``sf_dir``, kept for the life of the application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Study(spark, sf_dir)
    return _OPEN[key]


def close_studies(spark: SparkSession | None = None) -> None:
    """Forget stage tables, so that the next use starts from the source; with a session, delete what it wrote."""
    _OPEN.clear()
    if spark is not None:
        release(spark)

"""Molecular, evidence and contact operators against direct computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotfield.functions import order_stats
from spotfield.operators import contact, evidence, molecular


@pytest.mark.parametrize("small", [1_000_000, 5])
def test_exact_quantile(spark, small, monkeypatch):
    monkeypatch.setattr(order_stats, "SMALL_BRACKET", small)
    monkeypatch.setattr(order_stats, "HISTOGRAM_BINS", 8)
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], [301, 40]), "v": np.concatenate([rng.exponential(size=301) ** 3, np.full(40, 2.0)])})
    pdf.loc[5, "v"] = np.nan
    df = spark.createDataFrame(pdf)
    for q in (0.5, 0.99):
        got = {r.g: r.x for r in order_stats.exact_quantile(df, ["g"], "v", q, "x").collect()}
        for g, part in pdf.dropna().groupby("g"):
            assert got[g] == pytest.approx(np.quantile(part["v"], q))


def test_quantile_golden(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (float("inf"),)], "v double")
    assert order_stats.exact_quantile(df, [], "v", 0.99, "x").first()[0] == pytest.approx(9.79)


def test_fdr(spark):
    rows = [("a", 0.01), ("a", 0.02), ("a", 0.02), ("a", 0.5), ("n", 0.01), ("n", float("nan")), ("n", 0.5)]
    got = evidence.fdr(spark.createDataFrame(rows, "family string, p double"), ["family"]).collect()
    assert sorted(r.q for r in got if r.family == "a") == pytest.approx([0.0266667, 0.0266667, 0.0266667, 0.5], abs=1e-6)
    assert all(math.isnan(r.q) for r in got if r.family == "n") and len(got) == 7


def test_fdr_against_sorting(spark):
    p = np.round(np.random.default_rng(3).random(400), 2)
    got = evidence.fdr(spark.createDataFrame(pd.DataFrame({"i": range(400), "p": p})), []).toPandas().sort_values("i")["q"].to_numpy()
    order = np.argsort(p)
    q = np.minimum(np.minimum.accumulate((p[order] * 400 / np.arange(1, 401))[::-1])[::-1], 1.0)
    want = np.empty(400)
    want[order] = q
    assert np.allclose(got, want)


def test_support_threshold_empty(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "specimen string, lambda_t1 double")
    got = {r.specimen: r.threshold for r in evidence.support_threshold(df, ["specimen"]).collect()}
    assert math.isnan(got["a"]) and got["b"] == 1.0


def test_specificity_and_robustness(spark):
    rows = [("one", 0.02), ("two", 0.01), ("two", 0.02), ("nan", 0.02), ("nan", float("nan"))]
    got = {r.k: r.supported for r in evidence.specificity(spark.createDataFrame(rows, "k string, r2 double"), ["k"]).collect()}
    assert got == {"one": False, "two": True, "nan": False}
    rows = [("a", 32.0), ("a", 64.0), ("b", 32.0), ("b", 65.0)]
    got = {r.k: r.robust for r in evidence.anisotropy_robust(spark.createDataFrame(rows, "k string, range_um double"), ["k"]).collect()}
    assert got == {"a": True, "b": False}


def test_bounded_score(spark):
    obs = spark.createDataFrame([("s", i, 1000.0) for i in range(4)], "specimen string, obs_id long, library_size double")
    raw = spark.createDataFrame([("s", "c", 0, 1.0), ("s", "c", 1, 5.0), ("s", "c", 2, 9.0)], "specimen string, complex_id string, obs_id long, raw double")
    got = {r.obs_id: r.score for r in molecular.bounded_scores(raw, obs).collect()}
    assert got[1] == pytest.approx(0.5) and 3 not in got and all(0 <= v < 1 for v in got.values())


def test_complex_needs_every_subunit(spark):
    counts = spark.createDataFrame([("s", 1, "a", 4.0), ("s", 1, "b", 2.0), ("s", 1, "c", 7.0), ("s", 2, "a", 3.0)], "specimen string, obs_id long, gene_id string, raw double")
    cx = spark.createDataFrame([("s", "k", ["a", "b", "c"])], "specimen string, complex_id string, subunits array<string>")
    assert [(r.obs_id, r.raw) for r in molecular.complex_counts(counts, cx).collect()] == [(1, 2.0)]
    with pytest.raises(ValueError):
        molecular.complex_counts(counts, spark.createDataFrame([("s", "k", [])], "specimen string, complex_id string, subunits array<string>"))


def test_detected_gene_threshold(spark):
    obs = spark.range(10_001).select(F.lit("s").alias("specimen"), F.col("id").alias("obs_id"))
    counts = spark.range(11).select(F.lit("s").alias("specimen"), F.col("id").alias("obs_id"), F.lit("eleven").alias("gene_id"), F.lit(1.0).alias("raw")).unionByName(
        spark.range(10).select(F.lit("s").alias("specimen"), F.col("id").alias("obs_id"), F.lit("ten").alias("gene_id"), F.lit(1.0).alias("raw")))
    genes = spark.createDataFrame([("s", "ten"), ("s", "eleven"), ("s", "none")], "specimen string, gene_id string")
    got = {r.gene_id: r.detected for r in molecular.detected_genes(counts, obs, genes).collect()}
    assert got == {"ten": False, "eleven": True, "none": False}


def test_contact_golden(spark):
    df = spark.createDataFrame([("s", 0, 0.0, 0.0, 2.0), ("s", 1, 1.0, 0.0, 4.0), ("s", 2, 9.0, 9.0, 8.0)], "specimen string, obs_id long, x_um double, y_um double, score double")
    got = [r.exposure for r in contact.contact_exposure(df, 1.0).orderBy("obs_id").collect()]
    assert got == pytest.approx([4.0, 2.0, 0.0])


@pytest.mark.parametrize("by_component", [False, True])
def test_contact_against_all_pairs(spark, by_component):
    rng = np.random.default_rng(5)
    n = 250
    xy = rng.normal(size=(n, 2)) * 20
    xy[:60] = xy[0] + rng.normal(size=(60, 2)) * 1e-3  # a dense clump
    xy[60:90] = xy[60]  # copies of one position
    pdf = pd.DataFrame({"specimen": "s", "obs_id": range(n), "x_um": xy[:, 0], "y_um": xy[:, 1], "component": rng.integers(0, 3, n), "score": rng.random(n)})
    df = spark.createDataFrame(pdf)
    near = np.linalg.norm(xy[:, None] - xy[None], axis=2) <= 6.0 + 1e-9
    np.fill_diagonal(near, False)
    if by_component:
        near &= pdf["component"].to_numpy()[:, None] == pdf["component"].to_numpy()[None]
    degree = near.sum(axis=1)
    want = near @ pdf["score"].to_numpy() / np.maximum(degree, 1)
    got = contact.contact_exposure(df, 4.0, by_component).toPandas().sort_values("obs_id")["exposure"]
    assert np.allclose(got, want)
    edges = contact.contact_edges(df, 6.0, by_component).toPandas()
    assert len(edges) == near.sum() and np.allclose(edges.groupby("obs_i")["w"].sum(), 1.0)
    split = contact.contact_edges(df, 6.0, by_component, crowd=7).toPandas()
    assert sorted(map(tuple, split.values.tolist())) == sorted(map(tuple, edges.values.tolist()))


def test_crowded_cell_is_dealt_over_the_tasks(spark):
    """A third of all points in one cell, half of these at one place: pairs per task stay near the median."""
    from pyspark.sql import functions as F

    n = 6000
    place = F.when(F.col("id") % 6 == 0, F.lit(5.0)).when(F.col("id") % 6 == 1, F.lit(5.0) + F.rand(1) * 0.5).otherwise(F.rand(2) * 400.0)
    df = spark.range(n).select(
        F.lit("s").alias("specimen"), F.col("id").alias("obs_id"), place.alias("x_um"), F.when(F.col("id") % 6 < 2, F.lit(5.0)).otherwise(F.rand(3) * 400.0).alias("y_um"))
    df = spark.createDataFrame(df.collect(), df.schema)
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # what the keys do by themselves
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        edges = contact.contact_edges(df, 6.0, crowd=64)
        tasks = edges.groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
        xy = df.toPandas()[["x_um", "y_um"]].to_numpy()
        want = sum(int((np.linalg.norm(xy - v, axis=1) <= 6.0 + 1e-9).sum()) - 1 for v in xy)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert tasks.sum() == want and len(tasks) == 8 and tasks.max() <= 3 * tasks.median()

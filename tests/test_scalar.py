"""Golden values of the column formulas."""

import math

import pytest
from pyspark.sql import functions as F

from spotfield.functions import scalar


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("raw,lib,want", [(3.0, 6000.0, 5.0), (2.0, 0.0, 20000.0)])
def test_cp10k(spark, raw, lib, want):
    assert one(spark, scalar.cp10k(F.lit(raw), F.lit(lib))) == pytest.approx(want)


@pytest.mark.parametrize("v,want", [(0, 5.545177), (127, 0.693147), (255, 0.0)])
def test_optical_density(spark, v, want):
    assert one(spark, scalar.optical_density(F.lit(v))) == pytest.approx(want, abs=1e-6)


def test_qc(spark):
    nan = float("nan")
    rows = [(500, 200, 0.20), (499, 200, 0.1), (500, 200, nan)]
    got = [one(spark, scalar.passes_qc(F.lit(u), F.lit(g), F.lit(m))) for u, g, m in rows]
    assert got == [True, False, False]


def test_tensor(spark):
    t = one(spark, scalar.tensor(F.lit(0.0), F.lit(0.5 * math.log(3))))
    assert (t.a11, t.a12, t.a22) == pytest.approx((math.sqrt(3), 0.0, 1 / math.sqrt(3)))
    t = one(spark, scalar.tensor(F.lit(0.7), F.lit(0.4)))
    assert t.a11 * t.a22 - t.a12 ** 2 == pytest.approx(1.0)


def test_master_grid(spark):
    grid = one(spark, scalar.master_ranges())
    assert len(grid) == 41
    assert grid[:2] + grid[-1:] == pytest.approx([16, 17.448124, 512])


@pytest.mark.parametrize("h,nn,diam,n", [(4, 10, 2048, 41), (4, 10, 256, 17), (4, 100, 2048, 27), (8, 10, 200, 6), (4, 10, 128, 9)])
def test_trusted_grid(spark, h, nn, diam, n):
    assert len(one(spark, scalar.trusted_ranges(F.lit(float(h)), F.lit(float(nn)), F.lit(float(diam))))) == n


def test_trusted_grid_refuses(spark):
    ranges = scalar.trusted_ranges(F.lit(8.0), F.lit(10.0), F.lit(200.0))
    with pytest.raises(Exception, match="fewer than nine"):
        one(spark, scalar.require_trusted(ranges))


@pytest.mark.parametrize("p,want", [(1e-4, 0.000416504), (0.01, 0.016566071), (0.05, 0.060014434), (1.0, 0.6589)])
def test_calibration(spark, p, want):
    assert one(spark, scalar.calibrated_p(F.lit(p))) == pytest.approx(want, abs=1e-8)


def test_small_formulas(spark):
    assert one(spark, scalar.matern32(F.lit(5.0), F.lit(5.0))) == pytest.approx(0.4833577)
    assert one(spark, scalar.phi_low(F.lit(4.0))) == 10.0
    assert one(spark, scalar.phi_high(F.lit(6000.0))) == 1000.0
    assert one(spark, scalar.partial_r2(F.lit(2.0), F.lit(1.0))) == 0.5
    assert math.isnan(one(spark, scalar.partial_r2(F.lit(0.0), F.lit(1.0))))
    assert one(spark, scalar.mesh_robust(F.lit(64.0), F.lit(90.0))) is True
    assert one(spark, scalar.mesh_robust(F.lit(64.0), F.lit(91.0))) is False
    assert one(spark, scalar.limiting_subunit(F.lit(4.0), F.lit(2.0), F.lit(7.0))) == 2.0
    with pytest.raises(ValueError):
        scalar.limiting_subunit()


@pytest.mark.parametrize("ell,level,status,low,high", [
    (32.0, 0.95, "upper_bound", None, 90.509668), (32.0, 0.90, "upper_bound", None, 58.688259),
    (60.0, 0.95, "interval", 17.838107, 201.815140), (60.0, 0.90, "interval", 24.165729, 148.971299),
    (128.0, 0.95, "upper_bound", None, 304.437021), (256.0, 0.95, "uninformative", None, None)])
def test_range_report(spark, ell, level, status, low, high):
    r = one(spark, scalar.range_report(F.lit(ell), F.lit(5), F.lit(41), F.lit(9.0), F.lit(1.0), F.lit(16.0), F.lit(512.0), F.lit(level)))
    assert r.status == status
    assert r.lower_um == (pytest.approx(low) if low else None)
    assert r.upper_um == (pytest.approx(high) if high else None)


def test_range_report_order_of_checks(spark):
    def report(index, lam, thr, level):
        return one(spark, scalar.range_report(F.lit(60.0), F.lit(index), F.lit(41), F.lit(lam), F.lit(thr), F.lit(16.0), F.lit(512.0), F.lit(level)))

    assert report(0, 9.0, 1.0, 0.5).status == "unresolved"
    assert report(40, 9.0, 1.0, 0.95).status == "unresolved"
    assert report(5, 1.0, 1.0, 0.5).status == "unresolved"
    assert report(5, 9.0, float("nan"), 0.95).status == "unresolved"
    with pytest.raises(Exception, match="level must be"):
        report(5, 9.0, 1.0, 0.5)

"""Row-wise formulas as Catalyst column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S

NAN = float("nan")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(float(x)))


def cp10k(raw, library_size) -> Column:
    """Counts per ten thousand; a library below one counts as one."""
    return F.lit(1e4) * _c(raw).cast("double") / F.greatest(_c(library_size).cast("double"), F.lit(1.0))


def passes_qc(total_umi, detected_genes, mito_fraction=None) -> Column:
    keep = (_c(total_umi) >= F.lit(float(S.QC_UMI))) & (_c(detected_genes) >= F.lit(S.QC_GENES))
    if mito_fraction is not None:
        m = _c(mito_fraction)
        keep = keep & F.coalesce((m <= F.lit(S.QC_MITO)) & ~F.isnan(m), F.lit(False))
    return keep


def limiting_subunit(*subunits) -> Column:
    """Abundance of a complex: its least abundant subunit."""
    if not subunits:
        raise ValueError("a complex needs at least one subunit")
    cols = [_c(s).cast("double") for s in subunits]
    return cols[0] if len(cols) == 1 else F.least(*cols)


# -- stains -------------------------------------------------------------------

def optical_density(channel, factor=1.0) -> Column:
    return -F.ln((_c(channel).cast("double") * _c(factor) + F.lit(1.0)) / F.lit(256.0))


def stain_directions() -> np.ndarray:
    """Unit hematoxylin, unit eosin and the unit residual normal to both."""
    h, e = (np.array(v) / np.linalg.norm(v) for v in (S.HEMATOXYLIN, S.EOSIN))
    residual = np.cross(h, e)
    length = np.linalg.norm(residual)
    if length < 1e-12:
        raise ValueError("the two stain vectors point the same way")
    return np.array([h, e, residual / length])


def unmixing_weights() -> np.ndarray:
    """Rows give each stain as a linear form in the three optical densities."""
    return np.linalg.inv(stain_directions().T)


def stain_amount(weights, od_r, od_g, od_b) -> Column:
    mix = F.lit(float(weights[0])) * _c(od_r) + F.lit(float(weights[1])) * _c(od_g) + F.lit(float(weights[2])) * _c(od_b)
    return F.greatest(mix, F.lit(0.0))


def length3(a, b, c) -> Column:
    return F.sqrt(_c(a) * _c(a) + _c(b) * _c(b) + _c(c) * _c(c))


# -- transport tensor ---------------------------------------------------------

def tensor(theta, beta) -> Column:
    """Unit-determinant tensor with principal axis ``theta`` as (a11, a12, a22)."""
    t, b = _c(theta), _c(beta)
    cos, sin, up, down = F.cos(t), F.sin(t), F.exp(b), F.exp(-b)
    return F.struct(
        (cos * cos * up + sin * sin * down).alias("a11"),
        (cos * sin * (up - down)).alias("a12"),
        (sin * sin * up + cos * cos * down).alias("a22"),
    )


# -- spatial statistics -------------------------------------------------------

def matern32(distance, phi) -> Column:
    s = F.lit(math.sqrt(3.0)) * _c(distance) / _c(phi)
    return (F.lit(1.0) + s) * F.exp(-s)


def phi_low(median_nn_um) -> Column:
    return F.greatest(F.lit(10.0), F.lit(2.0) * _c(median_nn_um))


def phi_high(diameter_um) -> Column:
    return F.least(F.lit(1000.0), _c(diameter_um) / F.lit(3.0))


def calibrated_p(p_boot) -> Column:
    """Calibration for secreted interactions only."""
    p = _c(p_boot)
    value = F.lit(S.CALIBRATION_SCALE) * F.pow(p, F.lit(S.CALIBRATION_POWER))
    return F.when(F.isnan(p), F.lit(NAN)).otherwise(F.least(F.lit(1.0), value))


# -- candidate ranges ---------------------------------------------------------

def master_ranges() -> Column:
    """Array of the 41 geometric ranges from 16 to 512 um."""
    last = int(round(math.log2(S.RANGE_HIGH_UM / S.RANGE_LOW_UM) * S.RANGES_PER_OCTAVE))
    return F.transform(
        F.sequence(F.lit(0), F.lit(last)),
        lambda k: F.lit(S.RANGE_LOW_UM) * F.pow(F.lit(2.0), k.cast("double") / F.lit(float(S.RANGES_PER_OCTAVE))),
    )


def trusted_ranges(mesh_spacing_um, median_nn_um, diameter_um) -> Column:
    """The part of the master grid that mesh, sampling and tissue size support."""
    low = F.greatest(F.lit(S.RANGE_LOW_UM), F.lit(4.0) * _c(mesh_spacing_um), F.lit(0.5) * _c(median_nn_um))
    high = F.least(F.lit(S.RANGE_HIGH_UM), F.lit(0.25) * _c(diameter_um))
    return F.filter(
        master_ranges(),
        lambda ell: (ell >= low - F.lit(1e-12)) & (ell <= high + F.lit(1e-12)),
    )


def require_trusted(ranges) -> Column:
    """``ranges`` itself, or a raised error where too few values remain."""
    r = _c(ranges)
    return F.when(
        F.size(r) < F.lit(S.FEWEST_RANGES),
        F.raise_error(F.lit("fewer than nine trusted range values remain")).cast("array<double>"),
    ).otherwise(r)


# -- evidence -----------------------------------------------------------------

def partial_r2(loss_without, loss_with) -> Column:
    a, b = _c(loss_without), _c(loss_with)
    return F.when((a <= F.lit(0.0)), F.lit(NAN)).otherwise((a - b) / F.when(a > F.lit(0.0), a))


def geometry_gain(isotropic_loss, matched_loss, n_receivers) -> Column:
    n = F.greatest(_c(n_receivers).cast("long"), F.lit(1).cast("long"))
    return (_c(isotropic_loss) - _c(matched_loss)) / n


def bits_between(a, b) -> Column:
    """``|log2(a/b)|``; NaN unless both are positive and finite."""
    x, y = _c(a), _c(b)
    ok = (x > F.lit(0.0)) & (y > F.lit(0.0)) & ~F.isnan(x) & ~F.isnan(y)
    return F.when(ok, F.abs(F.log2(x / F.when(y > F.lit(0.0), y)))).otherwise(F.lit(NAN))


def at_most(value, bound) -> Column:
    """``value <= bound`` with NaN never passing."""
    v = _c(value)
    return F.coalesce(~F.isnan(v) & (v <= F.lit(float(bound))), F.lit(False))


def mesh_robust(reference_um, adjacent_um, bound=S.MESH_SHIFT_BITS) -> Column:
    return at_most(bits_between(adjacent_um, reference_um), bound)


def range_report(ell_hat, best_index, n_ranges, support, threshold, grid_low, grid_high, level=0.95) -> Column:
    """Decide whether a fitted range is reported, bounded, or withheld.

    The level is checked only for estimates that reach the reporting step.
    """
    ell, idx, n = _c(ell_hat), _c(best_index), _c(n_ranges)
    lam, thr, lo, hi, lev = _c(support), _c(threshold), _c(grid_low), _c(grid_high), _c(level)

    def by_level(table):
        return F.when(lev == F.lit(0.90), F.lit(table[0.90])).when(lev == F.lit(0.95), F.lit(table[0.95]))

    def scaled(bits):
        return ell * F.pow(F.lit(2.0), bits)

    # a support that is not a number counts as not exceeding the threshold, like a missing one
    short = ell < F.lit(S.SHORT_RANGE_UM)
    band = by_level(S.SHORT_BAND)
    below, above = scaled(-band), scaled(band)
    upper = F.when(short, scaled(by_level(S.SHORT_UPPER))).otherwise(scaled(by_level(S.LONG_UPPER)))
    passed = finite_value(thr) & ~F.isnan(lam) & (lam > thr)

    def row(status, reason=None, low=None, high=None, with_level=True):
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(reason).cast("string").alias("reason"),
            (low if low is not None else F.lit(None)).cast("double").alias("lower_um"),
            (high if high is not None else F.lit(None)).cast("double").alias("upper_um"),
            (lev if with_level else F.lit(None)).cast("double").alias("level"),
        )

    bad_level = F.raise_error(F.lit("level must be 0.90 or 0.95"))
    return (
        F.when((idx <= 0) | (idx >= n - F.lit(1)), row("unresolved", "best range lies on the edge of the trusted grid", with_level=False))
        .when(~F.coalesce(passed, F.lit(False)), row("unresolved", "support does not exceed the threshold", with_level=False))
        .when(~lev.isin(0.90, 0.95), F.struct(
            bad_level.cast("string").alias("status"), F.lit(None).cast("string").alias("reason"),
            F.lit(None).cast("double").alias("lower_um"), F.lit(None).cast("double").alias("upper_um"),
            F.lit(None).cast("double").alias("level")))
        .when(short & (below > lo) & (above <= hi), row("interval", low=below, high=above))
        .when(upper > hi, row("uninformative"))
        .otherwise(row("upper_bound", high=upper))
    )


def finite_value(c) -> Column:
    x = _c(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

"""Post-detection range profiles under a negative-binomial count model.

A profile fits one model per candidate range with the dispersion of the
no-exposure model held fixed.  Pairs of bounded size fit in one task; larger ones
run every reweighting step as sums over the rows where they lie, for all ranges
at once, so no pair is ever gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels.counts import (
    ROUNDS, advance, dispersion_from, first_guess, fit, log_likelihood, moment_sums, step_sums)
from ..runtime import materialise, require_columns

KEYS = ["specimen", "response_id"]
LOCAL_ROWS = 50_000
FIELDS = ("ells array<double>, support double, ell_hat double, best_index int, profile array<double>, dispersion double, "
          "amplitude double, n long, loglik_null double")


def range_profiles(data: DataFrame, exposures: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Range-support profile and its best range, one row per group.

    ``data(specimen, response_id, obs_id, y, library_size, covariates)``;
    every observation enters, also those without receptor counts.
    """
    from .association import exposure_columns

    require_columns(data, [*KEYS, "obs_id", "y", "library_size", "covariates"], "data")
    full = exposure_columns(data, exposures).select(
        *KEYS, "obs_id", F.col("y").cast("double"), F.log(F.greatest(F.col("library_size").cast("double"), F.lit(1.0))).alias("offset"),
        F.concat(F.array(F.lit(1.0)), "covariates").alias("base"), "ells", "h")
    sizes = materialise(full.groupBy(*KEYS).agg(F.count("*").alias("n")), "sizes")
    keyed = full.join(sizes, KEYS)
    kinds = dict(data.dtypes)
    schema = f"specimen {kinds['specimen']}, response_id {kinds['response_id']}, {FIELDS}"

    def run(key, pdf):
        pdf = pdf.sort_values("obs_id")
        y, offset, base, h = pdf["y"].to_numpy(), pdf["offset"].to_numpy(), np.stack(pdf["base"]), np.stack(pdf["h"])
        start, _ = fit(y, base, offset, 0.0)
        dispersion = dispersion_from(moment_sums(y, base, offset, start))
        _, null = fit(y, base, offset, dispersion)
        h = (h - h.mean(axis=0)) / np.maximum(h.std(axis=0), 1e-12)
        fits = [fit(y, np.column_stack([base, h[:, k]]), offset, dispersion) for k in range(h.shape[1])]
        return pd.DataFrame([_report(key, pdf["ells"].iloc[0], fits, null, dispersion, len(y))])

    local = keyed.where(F.col("n") <= local_rows).drop("n").groupBy(*KEYS).applyInPandas(run, schema)
    if sizes.where(F.col("n") > local_rows).isEmpty():
        return local
    rows = materialise(keyed.where(F.col("n") > local_rows).withColumn("grp", F.to_json(F.struct(*KEYS))), "large")
    heads = rows.groupBy("grp", *KEYS).agg(F.first("ells").alias("ells"), F.first(F.size("base")).alias("p"), F.count("*").alias("n"))
    # one row per large fit; all of them advance in the same jobs, so their number does not add to the jobs
    steps = {r["grp"]: _profile_steps((r["specimen"], r["response_id"]), r["ells"], r["p"], r["n"]) for r in heads.collect()}
    asked, out = {g: next(s) for g, s in steps.items()}, []
    while asked:
        sums, following = _summed(rows, asked), {}
        for g in asked:
            try:
                following[g] = steps[g].send(sums[g])
            except StopIteration as done:
                out.append(done.value)
        asked = following
    return local.unionByName(data.sparkSession.createDataFrame(out, schema))


def _report(key, ells, fits, null, dispersion, n):
    profile = [2.0 * (loglik - null) for _, loglik in fits]
    best = int(np.argmax(profile))
    return {"specimen": key[0], "response_id": key[1], "ells": [float(e) for e in ells], "support": float(profile[best]),
            "ell_hat": float(ells[best]), "best_index": best, "profile": [float(v) for v in profile],
            "dispersion": float(dispersion), "amplitude": float(fits[best][0][-1]), "n": int(n), "loglik_null": float(null)}


def _summed(rows: DataFrame, asked: dict) -> dict[str, np.ndarray]:
    """Add up one vector per group and batch of rows, as ``asked`` of each group; only vectors leave the executors."""

    def run(frames):
        total = {}
        for pdf in frames:
            for g, part in pdf.groupby("grp"):
                if g in asked:
                    v = np.asarray(asked[g](
                        part["y"].to_numpy(), part["offset"].to_numpy(), np.stack(part["base"]), np.stack(part["h"])), dtype=float)
                    total[g] = v if g not in total else total[g] + v
        for g, v in total.items():
            yield pd.DataFrame({"grp": g, "at": np.arange(len(v)), "v": v})

    parts = rows.select("grp", "y", "offset", "base", "h").mapInPandas(run, "grp string, at int, v double").groupBy("grp", "at").agg(F.sum("v").alias("v"))
    return {g: part.sort_values("at")["v"].to_numpy() for g, part in parts.toPandas().groupby("grp")}


def _profile_steps(key, ells, p: int, n: int):
    """Yields what to sum over the rows of one fit, is sent the sums, and returns the fit's report."""
    k = len(ells)
    first = yield lambda y, o, b, h: [y.sum(), o.sum(), *h.sum(axis=0)]
    mean_y, mean_o, center = first[0] / n, first[1] / n, first[2:] / n
    spread = np.sqrt((yield lambda y, o, b, h: ((h - center) ** 2).sum(axis=0)) / n)
    spread = np.maximum(spread, 1e-12)

    def designs(b, h, which):
        return [b if j < 0 else np.column_stack([b, (h[:, j] - center[j]) / spread[j]]) for j in which]

    def fitted(which, dispersion):
        beta = {j: first_guess(p + (j >= 0), mean_y, mean_o) for j in which}
        active = list(which)
        for _ in range(ROUNDS):
            if not active:
                break
            state, todo = dict(beta), list(active)

            def sums(y, o, b, h):
                parts = []
                for j, x in zip(todo, designs(b, h, todo)):
                    hessian, target = step_sums(y, x, o, state[j], dispersion)
                    parts += [hessian.ravel(), target]
                return np.concatenate(parts)

            flat, at, active = (yield sums), 0, []
            for j in todo:
                w = len(beta[j])
                beta[j], finished = advance(beta[j], (flat[at:at + w * w].reshape(w, w), flat[at + w * w:at + w * w + w]))
                at += w * w + w
                if not finished:
                    active.append(j)
        return beta

    start = (yield from fitted([-1], 0.0))[-1]
    dispersion = dispersion_from((yield lambda y, o, b, h: moment_sums(y, b, o, start)))
    every = yield from fitted([-1, *range(k)], dispersion)
    which = [-1, *range(k)]
    logliks = yield lambda y, o, b, h: [log_likelihood(y, x, o, every[j], dispersion) for j, x in zip(which, designs(b, h, which))]
    return _report(key, ells, [(every[j], logliks[j + 1]) for j in range(k)], logliks[0], dispersion, n)

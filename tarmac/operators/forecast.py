"""Monthly revenue forecast with changepoints (M3a-d, U1, U3).

Model (Taylor & Letham 2018, "Forecasting at scale"), fitted per series:

    y / max|y| = k t + m + sum_j delta_j (t - s_j)+ + sum_n [a_n sin(2 pi n d / 365.25) + b_n cos(...)] + e

with t the time scaled to [0, 1] over the history, up to 25 changepoints s_j
spread over the first 80 % of the history, yearly Fourier terms of order 10 and
priors delta ~ Laplace(0, 0.15), a, b ~ N(0, 10), k, m ~ N(0, 5),
sigma ~ HalfNormal(0.5). The MAP estimate is found by iteratively reweighted
ridge regression (the Laplace prior as a reweighted quadratic) alternating with
the closed-form update of sigma. Intervals (80 % by default) come from seeded
simulation of future slope changes (Poisson count at the historical rate,
Laplace sizes at the mean historical |delta|) plus Gaussian noise.

Spark plan: the monthly series comes from one aggregate; each series is fitted in
``groupBy(series).applyInPandas`` (one task per series, bounded by the number
of months), so the work scales with the number of series (total, per
category, per region, per product ...).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.columns import money_sum, month_key, month_start

OUT_SCHEMA = ("series string, kind string, month string, revenue double, predicted double, "
              "lower double, upper double, delta double")


def monthly_series(sales: DataFrame, by: str | None = None) -> DataFrame:
    """Revenue per (series, month start); ``by=None`` gives the single total series."""
    key = F.lit("total") if by is None else F.col(by).cast("string")
    return (sales.filter(F.col("Date").isNotNull() & (key.isNotNull()))
            .groupBy(key.alias("series"), month_start("Date").alias("ds"))
            .agg(money_sum("Revenue").alias("y")))


def _design(t: np.ndarray, days: np.ndarray, cps: np.ndarray, order: int) -> np.ndarray:
    cols = [t, np.ones_like(t)]
    cols += [np.maximum(t - s, 0.0) for s in cps]
    for n in range(1, order + 1):
        ang = 2.0 * np.pi * n * days / 365.25
        cols += [np.sin(ang), np.cos(ang)]
    return np.column_stack(cols)


def fit_series(ds: np.ndarray, y: np.ndarray, periods: int, n_changepoints: int = 25,
               changepoint_range: float = 0.8, changepoint_prior: float = 0.15,
               seasonality_prior: float = 10.0, order: int = 10, interval_width: float = 0.8,
               samples: int = 1000, seed: int = 42) -> dict:
    """Fit one monthly series (``ds`` month-start datetime64, ``y`` values)."""
    order_idx = np.argsort(ds)
    ds, y = ds[order_idx], y[order_idx].astype(float)
    n = len(y)
    scale = float(np.max(np.abs(y))) or 1.0
    ys = y / scale
    day0 = ds[0]
    days = (ds - day0).astype("timedelta64[D]").astype(float)
    span = days[-1] if days[-1] > 0 else 1.0
    t = days / span
    epoch_days = (ds - np.datetime64("1970-01-01")).astype("timedelta64[D]").astype(float)
    hist = int(np.floor(n * changepoint_range))
    ncp = min(n_changepoints, max(hist - 1, 0))
    if ncp > 0:
        idx = np.linspace(0, hist - 1, ncp + 1).round().astype(int)[1:]
        cps = t[idx]
    else:
        cps = np.array([])
    X = _design(t, epoch_days, cps, order)
    p = X.shape[1]
    j_delta = slice(2, 2 + len(cps))
    prior_var = np.full(p, seasonality_prior ** 2)
    prior_var[:2] = 25.0
    beta = None
    sigma2 = max(np.var(ys), 1e-4)
    for _ in range(100):
        pen = sigma2 / prior_var
        if beta is None:  # start from the Gaussian prior of the same scale
            pen[j_delta] = sigma2 / changepoint_prior ** 2
        else:  # Laplace prior as a reweighted quadratic (majorizer of |delta|)
            pen[j_delta] = sigma2 / (changepoint_prior * (np.abs(beta[j_delta]) + 1e-6))
        new = np.linalg.solve(X.T @ X + np.diag(pen), X.T @ ys)
        ssr = float(np.sum((ys - X @ new) ** 2))
        sigma2 = max((-n + np.sqrt(n * n + 16.0 * ssr)) / 8.0, 1e-10)
        done = beta is not None and np.max(np.abs(new - beta)) < 1e-9
        beta = new
        if done:
            break
    deltas = beta[j_delta]
    # future calendar: month starts after the last history month
    last = pd.Timestamp(ds[-1])
    fut = np.array([np.datetime64((last + pd.DateOffset(months=i)).to_datetime64(), "D")
                    for i in range(1, periods + 1)], dtype="datetime64[D]")
    f_days = (fut - day0).astype("timedelta64[D]").astype(float)
    f_t = f_days / span
    f_epoch = (fut - np.datetime64("1970-01-01")).astype("timedelta64[D]").astype(float)
    Xf = _design(f_t, f_epoch, cps, order)
    yhat = Xf @ beta
    # uncertainty: simulated future trend changes + observation noise
    rng = np.random.default_rng(seed)
    lam = float(np.mean(np.abs(deltas))) + 1e-8 if len(deltas) else 1e-8
    rate = len(cps)  # changepoints per unit of scaled time in the history
    horizon = f_t[-1] - 1.0 if periods else 0.0
    sims = yhat[None, :] + rng.normal(0.0, np.sqrt(sigma2), (samples, periods))
    if horizon > 0 and rate > 0:
        counts = rng.poisson(rate * horizon, samples)  # future changepoints per simulated path
        owner = np.repeat(np.arange(samples), counts)
        at = 1.0 + rng.uniform(0, horizon, owner.size)
        size = rng.laplace(0.0, lam, owner.size)
        np.add.at(sims, owner, size[:, None] * np.maximum(f_t[None, :] - at[:, None], 0.0))
    lo_q, hi_q = (1 - interval_width) / 2 * 100, (1 + interval_width) / 2 * 100
    lower = np.percentile(sims, lo_q, axis=0) if periods else np.array([])
    upper = np.percentile(sims, hi_q, axis=0) if periods else np.array([])
    cp_dates = ds[idx] if ncp > 0 else np.array([], dtype=ds.dtype)
    return {"ds": fut, "yhat": yhat * scale, "lower": lower * scale, "upper": upper * scale,
            "cp_ds": cp_dates, "deltas": deltas, "history_ds": ds, "history_y": y}


def _month(d) -> str:
    return pd.Timestamp(d).strftime("%Y-%m")


def forecast_series(series: DataFrame, periods: int = 12, seed: int = 42, interval_width: float = 0.8) -> DataFrame:
    """M3a + M3b + M3d for every series: rows of kind history / forecast / changepoint."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        name = str(pdf["series"].iloc[0])
        ds = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]")
        res = fit_series(ds, pdf["y"].to_numpy(dtype=float), periods, seed=seed, interval_width=interval_width)
        rows = [{"series": name, "kind": "history", "month": _month(d), "revenue": float(v)}
                for d, v in zip(res["history_ds"], res["history_y"])]
        rows += [{"series": name, "kind": "forecast", "month": _month(d), "predicted": max(float(p), 0.0),
                  "lower": max(float(lo), 0.0), "upper": float(hi)}
                 for d, p, lo, hi in zip(res["ds"], res["yhat"], res["lower"], res["upper"])]
        deltas = res["deltas"]
        if len(deltas):
            sd = float(np.std(deltas))
            rows += [{"series": name, "kind": "changepoint", "month": _month(d), "delta": round(float(v), 4)}
                     for d, v in zip(res["cp_ds"], deltas) if abs(float(v)) > sd]
        out = pd.DataFrame(rows, columns=["series", "kind", "month", "revenue", "predicted", "lower", "upper",
                                          "delta"])
        return out.astype({"revenue": float, "predicted": float, "lower": float, "upper": float, "delta": float})

    return series.groupBy("series").applyInPandas(fit, OUT_SCHEMA)


def forecast(sales: DataFrame, periods: int = 12, by: str | None = None) -> DataFrame:
    """M3a + U3: future months only (series, month, predicted, lower, upper)."""
    out = forecast_series(monthly_series(sales, by), periods)
    return out.filter(F.col("kind") == "forecast").select("series", "month", "predicted", "lower", "upper") \
        .orderBy("series", "month")


def changepoints(sales: DataFrame, by: str | None = None) -> DataFrame:
    """M3d: changepoints whose |delta| exceeds the std of all deltas; sign = growth/slowdown."""
    out = forecast_series(monthly_series(sales, by), 1)
    return (out.filter(F.col("kind") == "changepoint")
            .select("series", "month", "delta",
                    F.when(F.col("delta") > 0, "growth").otherwise("slowdown").alias("direction"))
            .orderBy("series", "month"))


def history(sales: DataFrame, by: str | None = None) -> DataFrame:
    """History rows (series, month, revenue) straight from the aggregate."""
    return monthly_series(sales, by).select("series", month_key("ds").alias("month"),
                                            F.round("y", 2).alias("revenue")).orderBy("series", "month")


def calendar(sales: DataFrame, periods: int = 12, by: str | None = None) -> DataFrame:
    """The next ``periods`` month starts after each series' last month."""
    last = monthly_series(sales, by).groupBy("series").agg(F.max("ds").alias("last"))
    seq = F.sequence(F.add_months("last", 1), F.add_months("last", periods), F.expr("INTERVAL 1 MONTH"))
    return last.select("series", F.explode(seq).alias("ds")).select("series", month_key("ds").alias("month")) \
        .orderBy("series", "month")


def combined(sales: DataFrame, periods: int = 12) -> DataFrame:
    """History followed by forecast in one series, in millions (2 digits)."""
    hist = history(sales).select("month", F.round(F.col("revenue") / 1e6, 2).alias("actual"))
    fut = forecast(sales, periods).select("month", *[F.round(F.col(c) / 1e6, 2).alias(c)
                                                     for c in ["predicted", "lower", "upper"]])
    return hist.unionByName(fut, allowMissingColumns=True).orderBy("month")

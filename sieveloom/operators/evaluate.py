"""Evaluation: policy metrics, bootstrap summaries, posterior diagnostics, curve shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .joins import small


def policy_metrics(masks: DataFrame, policy: str, scores: list[str], domain: str, tokens: str) -> DataFrame:
    """Per policy of ``masks`` (a row per selected document): count, means with standard errors, entropy and coverage of domains, tokens."""
    base = masks.groupBy(policy).agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(s), 6).alias(f"mean_{s}") for s in scores],
        *[F.round(F.stddev_samp(s) / F.sqrt(F.count(s).cast("double")), 6).alias(f"se_{s}") for s in scores],
        F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("tokens"),
    )
    by = masks.where(F.col(domain).isNotNull()).groupBy(policy, domain).agg(F.count("*").alias("c"))
    totals = by.groupBy(policy).agg(F.sum("c").alias("t"))
    p = by.join(small(totals), policy).withColumn("p", F.col("c") / F.col("t"))
    e = p.groupBy(policy).agg(F.round(stats.entropy(F.col("p")), 6).alias("entropy"), F.count("*").alias("coverage"))
    return base.join(small(e), policy, "left")


def deltas(metrics: DataFrame, policy: str, baseline: str, columns: list[str]) -> DataFrame:
    """Each metric less the baseline policy's."""
    base = metrics.where(F.col(policy) == baseline).select(*[F.col(c).alias(f"__{c}") for c in columns])
    return metrics.join(F.broadcast(base)).select(policy, *[F.round(F.col(c) - F.col(f"__{c}"), 6).alias(f"delta_{c}") for c in columns])


def bootstrap(df: DataFrame, value: str, by: str, key: Column, draws: int = 200, seed: int = 305) -> DataFrame:
    """Mean, deviation and quantiles of the bootstrap distribution of the group mean, resampled by Poisson(1) weights.

    A weight depends on key and draw alone, so draws are paired across groups.
    Each task sums weight and weighted value for its draws: a fixed table per
    group, whatever the number of rows.
    """
    weights = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)])

    step = (np.arange(draws, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def run(frames):
        total: dict = {}
        for f in frames:
            for g, own in f.groupby("g", sort=False, dropna=False):
                acc = total.setdefault(g, np.zeros((2, draws)))
                # a row per draw, some thousand rows of the frame at once
                for at in range(0, len(own), 4096):
                    x, base = own["v"].to_numpy()[at : at + 4096], own["h"].to_numpy()[at : at + 4096].astype(np.uint64)
                    with np.errstate(over="ignore"):
                        h = (base + step) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(31)
                        h *= np.uint64(0xBF58476D1CE4E5B9)
                    w = np.searchsorted(weights, (h >> np.uint64(11)) / 2.0**53)
                    acc[0] += w.sum(axis=1)
                    acc[1] += w @ x
        yield pd.DataFrame([(g, i, a[0, i], a[1, i]) for g, a in total.items() for i in range(draws)], columns=["g", "draw", "w", "s"])

    rows = df.where(F.col(value).isNotNull()).select(F.col(by).cast("string").alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(key, F.lit(seed)).alias("h"))
    sums = rows.mapInPandas(run, "g string, draw int, w double, s double").groupBy("g", "draw").agg((F.sum("s") / F.sum("w")).alias("m"))
    q = F.expr("percentile(m, array(0.025D, 0.5D, 0.975D))")
    return sums.groupBy(F.col("g").alias(by)).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), q[0].alias("q025"), q[1].alias("q50"), q[2].alias("q975"))


def effective_sample_size(x: np.ndarray, max_lag: int = 100) -> float:
    """Draws divided by 1 + 2 * autocorrelations up to the first negative one; x is (chain, draw)."""
    chains, n = x.shape
    centred = x - x.mean(axis=1, keepdims=True)
    var = (centred**2).mean()
    if var == 0:
        return float(chains * n)
    total = 0.0
    for lag in range(1, min(max_lag, n - 1) + 1):
        rho = (centred[:, lag:] * centred[:, :-lag]).mean() / var
        if rho < 0:
            break
        total += rho
    return chains * n / (1 + 2 * total)


def diagnostics(draws: DataFrame) -> DataFrame:
    """``(param, r_hat, ess)`` of ``draws(param, chain, draw, value)``; a parameter's draws are a bounded group by their meaning."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        x = f.pivot(index="chain", columns="draw", values="value").to_numpy()
        n = x.shape[1]
        w = x.var(axis=1, ddof=1).mean()
        r = np.sqrt(((n - 1) / n * w + x.mean(axis=1).var(ddof=1)) / w) if w > 0 and len(x) > 1 else 1.0
        return pd.DataFrame({"param": [f["param"].iloc[0]], "r_hat": [r], "ess": [effective_sample_size(x)]})

    return draws.groupBy("param").applyInPandas(one, "param string, r_hat double, ess double")


def curve_shapes(df: DataFrame, by: str, x: str, y: str, bins: int = 20) -> DataFrame:
    """``up``, ``down``, ``peak`` or ``valley``: the binned mean of y over x, 2 % of the range trimmed at both ends.

    Peak or valley if the extreme lies in the inner 60 % and exceeds both edges
    (mean of the outer tenth) by 35 % of the curve's span; else by the edges.
    """
    b = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__b", F.least(F.floor((F.col(x) - 0.02) / 0.96 * bins), F.lit(bins - 1)).cast("int")).where(f"__b BETWEEN 0 AND {bins - 1}")
    c = b.groupBy(by, "__b").agg(F.avg(y).alias("v"))
    edge = max(1, bins // 10)
    lo, hi = F.avg(F.when(F.col("__b") < edge, F.col("v"))), F.avg(F.when(F.col("__b") >= bins - edge, F.col("v")))
    inner = F.col("__b").between(bins // 5, bins - bins // 5 - 1)
    s = c.groupBy(by).agg(lo.alias("lo"), hi.alias("hi"), F.max(F.when(inner, F.col("v"))).alias("top"), F.min(F.when(inner, F.col("v"))).alias("low"), (F.max("v") - F.min("v")).alias("span"))
    shape = F.when(F.col("top") > F.greatest("lo", "hi") + 0.35 * F.col("span"), "peak").when(F.col("low") < F.least("lo", "hi") - 0.35 * F.col("span"), "valley").when(F.col("hi") >= F.col("lo"), "up").otherwise("down")
    return s.select(by, shape.alias("shape"))

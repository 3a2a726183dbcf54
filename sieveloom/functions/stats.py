"""Column helpers for ranks, moments, scales and deterministic random numbers."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def hash_uniform(key: Column, salt: str | int) -> Column:
    """A number in (0, 1) from md5 of key and salt: the same in every engine, run and partitioning."""
    digest = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{salt}"))), 1, 13)
    return (F.conv(digest, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4503599627370496.0)


def gumbel(key: Column, salt: str | int) -> Column:
    return -F.log(-F.log(hash_uniform(key, salt)))


def average_rank_pct(x: Column, *by: Column) -> Column:
    """Rank in the group as a share of its non-null values, ties at their mean rank; NULL stays NULL.

    One sort per group; a group of a third of all rows sorts in one task with
    spilling, see ``operators.prefix.average_ranks`` for a distributed form.
    """
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    rank = F.rank().over(w.orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), (rank + (ties - 1) / F.lit(2.0)) / F.count(x).over(w))


def order_share(x: Column, by: list[Column], ties: list[Column], least: int = 0) -> Column:
    """0 for the group's lowest, 1 for its highest value by position, NULL values lowest; NULL in groups below ``least`` rows."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy(x.asc_nulls_first(), *ties)) - 1
    return F.when(n >= least, at / F.greatest(n - 1, F.lit(1)).cast("double"))


def z_score(x: Column, *by: Column, sample: bool = True) -> Column:
    w = Window.partitionBy(*by)
    s = (F.stddev_samp if sample else F.stddev_pop)(x).over(w)
    return (x - F.avg(x).over(w)) / F.nullif(s, F.lit(0.0))


def min_max(x: Column, *by: Column, eps: float = 1e-12) -> Column:
    w = Window.partitionBy(*by)
    lo = F.min(x).over(w)
    return (x - lo) / (F.max(x).over(w) - lo + F.lit(eps))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected from the population value; NULL below 3 values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess; NULL below 4 values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def entropy(share: Column) -> Column:
    """Aggregate: natural-log entropy of shares, zero shares skipped."""
    return F.coalesce(-F.sum(F.when(share > 0, share * F.log(share))), F.lit(0.0))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def logit(p: Column, eps: float = 1e-4) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def log1p_floor(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0)).cast("double"))


def clamp_round(x: Column, lo: int, hi: int) -> Column:
    """Clamped and rounded half to even."""
    return F.rint(clip(x, lo, hi)).cast("int")


def equal_bin(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin 1..n of equal width between lo and hi, the last one closed on the right; NULL outside."""
    raw = F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * n) + 1
    return F.when(x.between(lo, hi), F.least(F.coalesce(raw, F.lit(1)), F.lit(n))).cast("int")

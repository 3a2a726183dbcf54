"""Score cutoffs that keep a target fraction per group, by multi-sequence selection.

Each task sorts the scores of its rows once and keeps them as one array per
group and run.  The k-th largest score of every group is then found by rounds:
each run offers equally spaced elements of what is left of its range, the
weighted quantiles of these are the pivots of a group, the ranks of the pivots
are summed over all runs by binary search, and the range narrows to the gap
that holds the k-th largest.  A round moves a few numbers per group; nothing
is ever sorted globally, and a group holding a third of all rows is spread
over all runs like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Pivots of a group in a round, and elements that a run offers.
PIVOTS = 64
#: Runs whose offers are merged together.
RUNS = 64
#: Scores in one sorted run at most (8 MB); larger partitions give several runs.
RUN = 1_000_000


def _sorted_runs(records: DataFrame) -> DataFrame:
    def run(frames):
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}

        def emit(g):
            a = np.sort(np.concatenate(held.pop(g)))
            size.pop(g)
            return pd.DataFrame({"grp": [g], "scores": [a]})

        for f in frames:
            for g, s in f.groupby("grp")["score"]:
                held.setdefault(int(g), []).append(s.to_numpy())
                size[int(g)] = size.get(int(g), 0) + len(s)
                if size[int(g)] >= RUN:
                    yield emit(int(g))
        for g in list(held):
            yield emit(g)

    return records.select("grp", "score").mapInPandas(run, "grp int, scores array<double>")


def cutoffs(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``(grp, n, k, cutoff, kept)`` for each group of ``records(grp INT, score DOUBLE)`` that has a target.

    ``targets(grp INT, fraction DOUBLE)`` holds one fraction per group.  The
    cutoff is the highest score that at least ``fraction * n`` of the group's n
    records reach; ties at the cutoff are all kept.  A fraction of 1 or more
    keeps all; of 0 or less none (null cutoff, 0 kept); groups without records
    or with a null fraction have no row.  Scores must be neither null nor NaN.
    The groups are those of the target table, whose size is a parameter of the
    caller's and doesn't grow with the records.
    """
    spark = records.sparkSession
    shared_dir(spark)
    runs = _sorted_runs(records).checkpoint()
    fraction = {int(r[0]): float(r[1]) for r in targets.where("grp IS NOT NULL AND fraction IS NOT NULL AND NOT isnan(fraction)").groupBy("grp").agg(F.max("fraction")).collect()}
    n = {r[0]: r[1] for r in runs.groupBy("grp").agg(F.sum(F.size("scores"))).collect()}
    k = {g: min(n[g], math.ceil(f * n[g])) for g, f in fraction.items() if g in n}
    # the cutoff of a group is low or lies strictly between low and high
    open_ = {g: (-math.inf, math.inf) for g, x in k.items() if x > 0}
    found: dict[int, tuple[float, int]] = {}
    while open_:
        pivots = _pivots(runs, open_)
        open_ = {g: r for g, r in open_.items() if g in pivots}
        ranks = _ranks(runs, pivots) if pivots else {}
        for g, (low, high) in open_.items():
            reached = [(v, c) for v, c in ranks[g] if c >= k[g]]
            if reached and max(reached)[0] > low:
                found[g] = max(reached)
                low = found[g][0]
            open_[g] = (low, min([high, *(v for v, c in ranks[g] if c < k[g])]))
    rows = [(g, n[g], k[g], *(found[g] if k[g] > 0 else (None, 0))) for g in sorted(k)]
    return spark.createDataFrame(rows, "grp int, n bigint, k bigint, cutoff double, kept bigint")


def _within(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Elements of a sorted array above ``low`` and below ``high``."""
    return a[np.searchsorted(a, low, "right") : np.searchsorted(a, high, "left")]


def _pivots(runs: DataFrame, open_: dict) -> dict[int, list[float]]:
    """Pivots of the groups that have scores left in their range; the least score left is one of them."""

    def offer(frames):
        for f in frames:
            out = []
            for g, a, part in zip(f["grp"], f["scores"], f["part"]):
                if g in open_ and len(left := _within(np.asarray(a), *open_[g])):
                    at = np.unique(np.linspace(0, len(left) - 1, min(PIVOTS, len(left))).astype(np.int64))
                    out.extend(zip([g] * len(at), [part] * len(at), left[at], np.diff(np.append(at, len(left)))))
            yield pd.DataFrame(out, columns=["grp", "part", "score", "weight"])

    # any pivots will do, as their ranks are counted exactly: the offers of a group are merged in parts of RUNS runs and these in turn
    cuts = F.expr("percentile(score, array(" + ", ".join(f"{i / PIVOTS}D" for i in range(1, PIVOTS + 1)) + "), weight)")
    offered = runs.withColumn("part", F.floor(F.spark_partition_id() / RUNS)).mapInPandas(offer, "grp int, part bigint, score double, weight bigint")
    merged = offered.groupBy("grp", "part").agg(F.min("score").alias("least"), cuts.alias("cuts"), F.sum("weight").alias("weight"))
    again = merged.select("grp", "least", F.explode("cuts").alias("score"), "weight")
    rows = again.groupBy("grp").agg(F.min("least").alias("least"), cuts.alias("cuts")).collect()
    return {r["grp"]: sorted({r["least"], *r["cuts"]}) for r in rows}


def _ranks(runs: DataFrame, pivots: dict[int, list[float]]) -> dict[int, list[tuple[float, int]]]:
    """Per pivot of a group: the least score at or above it and the number of records that reach it."""

    def count(frames):
        for f in frames:
            out = []
            for g, a in zip(f["grp"], f["scores"]):
                if g in pivots:
                    a = np.asarray(a)
                    at = np.searchsorted(a, pivots[g], "left")
                    out.extend((g, i, len(a) - x, a[x] if x < len(a) else np.inf) for i, x in enumerate(at))
            yield pd.DataFrame(out, columns=["grp", "i", "reach", "value"])

    rows = runs.mapInPandas(count, "grp int, i int, reach bigint, value double").groupBy("grp", "i").agg(F.sum("reach").alias("reach"), F.min("value").alias("value")).collect()
    out: dict[int, list[tuple[float, int]]] = {g: [] for g in pivots}
    for r in rows:
        out[r["grp"]].append((r["value"], r["reach"]))
    return out


def keep(keys: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of ``keys(..., grp, score)`` at or above their group's cutoff; groups without one keep nothing."""
    return keys.join(F.broadcast(cuts.where("cutoff IS NOT NULL").select("grp", "cutoff")), "grp").where("score >= cutoff").drop("cutoff")

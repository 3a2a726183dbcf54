"""Mixture proposals, generated run configurations, packed sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_sum
from .quantiles import quantile_table


def temper_prior(weights: dict, temperature: float = 2.0) -> dict:
    w = {k: v ** (1 / temperature) for k, v in weights.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def proposals(weights: dict, n: int, seed: int = 305, top_ratio: float = 20.0, least_distance: float = 0.05, tries: int = 10_000) -> list[tuple]:
    """``(mix, domain, weight)`` of accepted Dirichlet draws around the tempered prior.

    Concentration is log-uniform in 0.1..5; shares below 2e-4 become 0.  A draw
    is rejected if a share exceeds its prior ``top_ratio`` times, or if its
    greatest absolute difference to an accepted draw is below ``least_distance``.
    """
    if not weights:
        return []
    prior = temper_prior(weights)
    keys, p = sorted(prior), np.array([prior[k] for k in sorted(prior)])
    rng, accepted = np.random.default_rng(seed), []
    for _ in range(tries):
        if len(accepted) == n:
            break
        x = rng.dirichlet(np.exp(rng.uniform(np.log(0.1), np.log(5))) * p * len(p))
        x[x < 2e-4] = 0
        x /= x.sum()
        if (x / p).max() <= top_ratio and all(np.abs(x - a).max() >= least_distance for a in accepted):
            accepted.append(x)
    return [(i, int(k), float(v)) for i, x in enumerate(accepted) for k, v in zip(keys, x)]


def generate_configs(df: DataFrame, features: list[str], n: int, least_share: float, seed: int = 305) -> list[dict]:
    """Seeded configurations of one to three thresholds; intersections too small are relaxed towards the middle by 10, 20, 30 points.

    Sizes come from one pass over the frame for all candidates.
    """
    rng = np.random.default_rng(seed)
    grid = list(range(20, 81, 10))
    table = quantile_table(df, {f: [p / 100 for p in grid] for f in features})
    drawn = []
    for i in range(n):
        k = int(rng.integers(1, min(3, len(features)) + 1))
        chosen = [(features[j], int(rng.choice(grid)), "above" if rng.random() < 0.5 else "below") for j in rng.choice(len(features), k, replace=False)]
        for relax in (0, 10, 20, 30):
            eased = [(f, max(20, p - relax) if s == "above" else min(80, p + relax), s) for f, p, s in chosen]
            drawn.append((i, eased))
    test = lambda sel: F.expr(" AND ".join(f"`{f}` {'>=' if s == 'above' else '<='} {table[f, p / 100]!r}D" for f, p, s in sel))
    sizes = df.agg(F.count("*"), *[F.count(F.when(test(s), 1)) for _, s in drawn]).first()
    out: dict[int, dict] = {}
    for (i, sel), size in zip(drawn, sizes[1:]):
        if i not in out and size >= least_share * sizes[0]:
            kind = "single_threshold" if len(sel) == 1 else "multi_intersection"
            out[i] = {"run_id": i, "type": kind, "selectors": [{"feature": f, "percentile": p, "direction": s} for f, p, s in sel]}
    return list(out.values())


def packed(docs: DataFrame, key: list[str], ids: str, length: int) -> DataFrame:
    """Sequences of ``length + 1`` ids over all documents in key order; the last, short one is dropped.

    Offsets are running sums over the cluster.  A document falls into the few
    sequences it touches, so only slices move, not single ids.
    """
    width = length + 1
    sized = docs.withColumn("__n", F.size(ids)).where("__n > 0")
    placed = running_sum(sized, "__n", [], [F.col(k).asc() for k in key], "__end").withColumn("__start", F.col("__end") - F.col("__n"))
    first, last = F.floor(F.col("__start") / width), F.floor((F.col("__end") - 1) / width)
    cut = placed.withColumn("sequence", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("sequence") * width - F.col("__start"), F.lit(0))
    stop = F.least((F.col("sequence") + 1) * width - F.col("__start"), F.col("__n"))
    parts = cut.select("sequence", "__start", F.col(key[0]).alias("__doc"), F.slice(ids, (begin + 1).cast("int"), (stop - begin).cast("int")).alias("__ids"))
    rows = parts.groupBy("sequence").agg(F.array_sort(F.collect_list(F.struct("__start", "__ids"))).alias("p"), F.min("__doc").alias("first_doc"))
    return rows.select("sequence", F.flatten(F.transform("p", lambda x: x["__ids"])).alias("ids"), "first_doc").where(F.size("ids") == width)

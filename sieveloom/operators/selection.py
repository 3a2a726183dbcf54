"""Selecting training data: budgets, thresholds, sampling, quotas, policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import gumbel, hash_uniform
from ..session import cut
from .joins import small
from .prefix import budget_prefix, row_numbers, running_sum
from .quantiles import quantile_table, quantiles, threshold


def score_expression(score: Column, *, invert: bool = False, at_least: float | None = None, median: float | None = None, nearest: bool = False) -> Column:
    """The score a selection orders by: inverted, flattened to 0 at or above a threshold (NULL below), or its distance from the median.

    The distance takes the farthest first, as always; ``nearest`` turns it round.
    """
    s = -score if invert else score
    if at_least is not None:
        s = F.when(s >= at_least, F.lit(0.0))
    if median is not None:
        s = F.abs(s - median)
        s = -s if nearest else s
    return s


def sampled_score(score: Column, key: Column, seed: int, temperature: float = 1.0, mean: float = 0.0, std: float = 1.0) -> Column:
    """Gumbel-perturbed score: taking the top of it samples without replacement in proportion to exp(score / temperature)."""
    return (score - mean) / std / temperature + gumbel(key, seed)


def by_tokens(df: DataFrame, score: str, tokens: str, budget: float, ties: list[Column]) -> DataFrame:
    """Best documents until the budget is reached; fails if all of them don't reach it, takes none for a budget of 0."""
    if budget <= 0:
        return df.limit(0)
    total = df.agg(F.sum(tokens)).first()[0] or 0
    if total < budget:
        raise ValueError(f"Insufficient tokens: {total} of {budget}")
    return budget_prefix(df, tokens, F.lit(budget), [], [F.col(score).desc_nulls_last(), *ties])


def multi_epoch(df: DataFrame, score: str, tokens: str, budget: int, ties: list[Column], repeat: bool = True) -> DataFrame:
    """``n_repeats`` per document: whole epochs of everything, and of the best the rest; without ``repeat`` everything once at most."""
    total = df.agg(F.sum(tokens)).first()[0] or 0
    if not total:
        return df.limit(0).withColumn("n_repeats", F.lit(0))
    epochs, rest = divmod(budget, total)
    if epochs and not repeat:
        return df.withColumn("n_repeats", F.lit(1))
    ordered = running_sum(df, tokens, [], [F.col(score).desc_nulls_last(), *ties], "__cum")
    extra = F.when((F.col("__cum") - F.col(tokens) < rest) & (F.lit(rest) > 0), 1).otherwise(0)
    return ordered.withColumn("n_repeats", F.lit(int(epochs)) + extra).drop("__cum").where("n_repeats > 0")


def by_quota(df: DataFrame, targets: DataFrame, domain: str, score: str, tokens: str, budget: float, ties: list[Column]) -> DataFrame:
    """Per domain the best documents until ``round(budget * weight)`` tokens, halves to even; domains without a target give none."""
    quota = targets.select(domain, F.bround(F.col("weight") * budget).alias("__quota"))
    joined = df.join(small(quota), domain)
    return budget_prefix(joined, tokens, F.col("__quota"), [domain], [F.col(score).desc_nulls_last(), *ties]).drop("__quota")


def retry_until(select, asked: float, tokens: str, rounds: int = 10) -> DataFrame:
    """Select with a raised budget until 99 % of what was asked for comes out, in so many rounds at most."""
    budget = asked
    for _ in range(rounds):
        out = select(budget)
        got = out.agg(F.sum(tokens)).first()[0] or 0
        if got >= 0.99 * asked or not got:
            break
        budget = int(budget * asked / got)
    return out


def repeat_rows(df: DataFrame, n: str) -> DataFrame:
    """Every row n times."""
    return df.where(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))


def top_fraction(df: DataFrame, by: list[str], score: str, fraction: float, ties: list[Column], least: int = 1) -> DataFrame:
    """Per group ``max(least, round(fraction * n))`` best rows, halves to even; numbered without putting a group into one task."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    numbered = row_numbers(df, by, [F.col(score).desc_nulls_last(), *ties], "__rn")
    return numbered.join(small(sizes), by).where(F.col("__rn") <= F.greatest(F.bround(F.col("__n") * F.lit(float(fraction))), F.lit(least))).drop("__rn", "__n")


#: Rows up to which a top-k is gathered in one task; more are numbered where they are.
GATHERED = 10_000


def first_rows(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows of a total order; a small n is a partial top-k per task, a large one is numbered by ranges, so that no task holds it."""
    return df.orderBy(*order).limit(n) if n <= GATHERED else row_numbers(df, [], order, "__rn").where(F.col("__rn") <= n).drop("__rn")


def top_n(df: DataFrame, score: str, n: int, ties: list[Column]) -> DataFrame:
    """n best rows."""
    return first_rows(df, n, [F.col(score).desc_nulls_last(), *ties])


def floor_then_fill(df: DataFrame, by: list[str], score: str, n: int, floor: float, ties: list[Column]) -> DataFrame:
    """n rows: each group's best ``floor`` share first, then the best of the rest; beyond n the best of the floor set.

    The floor's size follows from the groups' sizes, so only the part that
    fills up, or is cut, is put in order; ``is_floor`` tells the parts.
    """
    order = [F.col(score).desc_nulls_last(), *ties]
    if floor <= 0:
        return first_rows(df, n, order).withColumn("is_floor", F.lit(False))
    least = F.least(F.greatest(F.bround(F.col("__n") * F.lit(float(floor))), F.lit(1)), F.col("__n"))
    sizes = cut(df.groupBy(*by).agg(F.count("*").alias("__n")).withColumn("__least", least))
    held = sizes.agg(F.coalesce(F.sum("__least"), F.lit(0))).first()[0]
    numbered = row_numbers(df, by, order, "__rn").join(small(sizes), by)
    marked = numbered.withColumn("is_floor", F.col("__rn") <= F.col("__least")).drop("__rn", "__n", "__least")
    if held >= n:
        return first_rows(marked.where("is_floor"), n, order)
    return marked.where("is_floor").unionByName(first_rows(marked.where("NOT is_floor"), n - int(held), order))


def above(df: DataFrame, feature: str, percentile: float, direction: str = "above") -> DataFrame:
    """Rows at or beyond the feature's percentile."""
    t = threshold(df, feature, percentile / 100)
    return df.limit(0) if t is None else df.where(F.col(feature) >= t if direction == "above" else F.col(feature) <= t)


def intersection(df: DataFrame, selectors: list[tuple[str, float, str]]) -> DataFrame:
    """Rows that pass all percentile thresholds, each taken over the whole frame."""
    table = quantile_table(df, {f: [p / 100 for g, p, _ in selectors if g == f] for f, _, _ in selectors})
    tests = [F.col(f) >= table[f, p / 100] if d == "above" else F.col(f) <= table[f, p / 100] for f, p, d in selectors]
    return df.where(reduce(lambda a, b: a & b, tests))


def linear_top(df: DataFrame, features: list[str], weights: list[float], top: float, means: list[float] | None = None, stds: list[float] | None = None, skip_null: bool = False) -> DataFrame:
    """Top percent by a weighted sum of z-scores (sample deviations; population ones and NULL as 0 with ``skip_null``)."""
    if means is None:
        dev = F.stddev_pop if skip_null else F.stddev_samp
        row = df.agg(*[F.avg(f) for f in features], *[dev(f) for f in features]).first()
        means, stds = list(row[: len(features)]), [s or 1.0 for s in row[len(features) :]]
    z = [(F.col(f) - m) / s * w for f, w, m, s in zip(features, weights, means, stds)]
    score = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in z] if skip_null else z)
    scored = df.withColumn("linear_score", score)
    t = threshold(scored, "linear_score", 1 - top / 100)
    return scored.where(F.col("linear_score") >= t)


def within_group_top(df: DataFrame, by: str, feature: str, top: float, least: int = 0) -> DataFrame:
    """Rows at or above their group's percentile; groups below ``least`` rows give none."""
    cuts = quantiles(df, feature, [1 - top / 100], [by]).select(by, F.col("value").alias("__cut"))
    if least:
        cuts = cuts.join(df.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(by), by, "left_semi")
    return df.join(small(cuts), by).where(F.col(feature) >= F.col("__cut")).drop("__cut")


def top_then_restrict(df: DataFrame, first: str, first_top: float, second: str, second_top: float) -> DataFrame:
    a = above(df, first, 100 - first_top)
    return above(a, second, 100 - second_top)


def bernoulli(df: DataFrame, key: Column, fraction: float, seed: int) -> DataFrame:
    return df.where(hash_uniform(key, seed) < fraction)


def random_rows(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """n rows by hash order: a sample without replacement that every run repeats.

    Rows are counted first; only those whose hash is below the share wanted,
    with a wide margin, are ordered at all.
    """
    total, u = df.count(), hash_uniform(key, seed)
    if total > 2 * n:
        df = df.where(u < (n + 8 * n**0.5 + 64) / total)
    return first_rows(df, n, [u.asc(), key.asc()])


def stratified_split(df: DataFrame, by: str, key: Column, test: float, seed: int) -> DataFrame:
    """``is_test`` for ``round(test * n)`` rows of each stratum."""
    sizes = df.groupBy(by).agg(F.count("*").alias("__n"))
    numbered = row_numbers(df, [by], [hash_uniform(key, seed).asc(), key.asc()], "__rn")
    return numbered.join(small(sizes), by).withColumn("is_test", F.col("__rn") <= F.bround(F.col("__n") * F.lit(float(test)))).drop("__rn", "__n")


def apply_config(df: DataFrame, config: dict) -> DataFrame:
    """Rows that a run configuration selects; one of ten types."""
    kind = config["type"]
    if kind == "single_threshold":
        return above(df, config["feature"], config["percentile"], config.get("direction", "above"))
    if kind == "multi_intersection":
        return intersection(df, [(s["feature"], s["percentile"], s.get("direction", "above")) for s in config["selectors"]])
    if kind in ("linear_top", "linear_top_simple"):
        return linear_top(df, config["features"], config["weights"], config["top_pct"], config.get("means"), config.get("stds"), kind.endswith("simple"))
    if kind == "targeted_top":
        low = config.get("direction") == "below"
        return above(df, config["feature"], config["top_pct"] if low else 100 - config["top_pct"], "below" if low else "above")
    if kind == "topic_conditional":
        return above(df.where(F.col("topic") == config["topic"]), config["feature"], config["percentile"], config.get("direction", "above"))
    if kind == "within_topic_top":
        return within_group_top(df, "topic", config["feature"], config["top_pct"])
    if kind == "fwedu_geq":
        return df.where(F.col("fwedu_rounded") >= config["threshold"])
    if kind == "random":
        return bernoulli(df, F.concat_ws("-", "shard_idx", "doc_idx"), config["frac"], config["seed"])
    if kind == "dclm_top_then_restrict":
        return top_then_restrict(df, "dclm_score", config["dclm_top_pct"], config["restrict_feature"], config["restrict_top_pct"])
    raise ValueError(f"unknown type {kind}")


def guarded(df: DataFrame, tokens: str, least_rows: int = 200, least_tokens: int = 0) -> tuple[str, int, int]:
    """(status, rows, tokens): 'aborted' below the rows, 'dropped' below the tokens, else 'ok'."""
    r = df.agg(F.count("*"), F.coalesce(F.sum(tokens), F.lit(0))).first()
    return ("aborted" if r[0] < least_rows else "dropped" if r[1] < least_tokens else "ok"), r[0], r[1]


def closest_per_cluster(df: DataFrame, cluster: str, distance: str, k: int, ties: list[Column]) -> DataFrame:
    """``min(k, size)`` nearest members of each cluster; a bounded k prunes in every task."""
    w = Window.partitionBy(cluster).orderBy(F.col(distance), *ties)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def water_fill(sizes: DataFrame, cluster: str, size: str, target: int, multiplier: int = 1) -> DataFrame:
    """``quota`` per cluster: the water level x with sum(min(x, size * multiplier)) <= target, one more for the first clusters above x until the target is met.

    Closed form over clusters sorted by capacity: with the j smallest filled,
    the level is (target - their sum) / (number left).  One row per cluster,
    small by its meaning.
    """
    cap = sizes.withColumn("cap", F.col(size) * multiplier)
    w = Window.orderBy("cap", cluster)
    total = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.count("*").over(total) - F.row_number().over(w) + 1
    level = cap.withColumn("__at", F.row_number().over(w)).withColumn("__lv", F.floor((F.lit(target) - before) / left)).withColumn("__open", F.col("__lv") < F.col("cap"))
    # the level is that of the first cluster which it doesn't fill
    x = F.coalesce(F.min(F.when(F.col("__open"), F.struct("__at", "__lv"))).over(total)["__lv"], F.max("cap").over(total))
    filled = level.withColumn("__x", F.greatest(x, F.lit(0))).withColumn("quota", F.least("cap", "__x"))
    rest = F.lit(target) - F.sum("quota").over(total)
    more = F.col("cap") > F.col("__x")
    at = F.row_number().over(Window.partitionBy(more).orderBy(cluster))
    return filled.withColumn("quota", F.col("quota") + F.when(more & (at <= rest), 1).otherwise(0)).select(cluster, size, "quota")

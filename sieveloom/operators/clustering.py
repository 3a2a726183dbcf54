"""k-means in the large: assignment in Arrow batches against broadcast centroids, sums over the cluster; hierarchies and sampling."""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import small
from .prefix import row_numbers
from .quantiles import quantiles
from .selection import repeat_rows, water_fill


def nearest(x: np.ndarray, centroids: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest centroid, the lowest index of equal ones; chunks bound the memory."""
    best, dist = np.empty(len(x), np.int64), np.empty(len(x))
    norms = (centroids**2).sum(axis=1)
    for i in range(0, len(x), rows):
        b = x[i : i + rows]
        d = (b**2).sum(axis=1)[:, None] - 2 * b @ centroids.T + norms
        best[i : i + rows] = d.argmin(axis=1)
        dist[i : i + rows] = np.maximum(d.min(axis=1), 0)
    return best, dist


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in s]) if len(s) else np.zeros((0, 0))


def assign(df: DataFrame, key: str, vector: str, levels: list[np.ndarray]) -> DataFrame:
    """``(key, cluster_0, dist2_0, ...)``: the nearest centroid of each level, a higher level by the centroid chosen below it."""
    kind = dict(df.dtypes)[key]

    def run(frames):
        for f in frames:
            x = _matrix(f[vector])
            out = {key: f[key]}
            for i, c in enumerate(levels):
                cluster, d2 = nearest(x, c) if len(x) else (np.zeros(0, np.int64), np.zeros(0))
                out[f"cluster_{i}"], out[f"dist2_{i}"] = cluster.astype(np.int32), d2
                x = c[cluster] if len(x) else x
            yield pd.DataFrame(out)

    schema = f"{key} {kind}, " + ", ".join(f"cluster_{i} int, dist2_{i} double" for i in range(len(levels)))
    return df.where(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, schema)


def step(df: DataFrame, vector: str, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Lloyd step: new centroids (empty clusters keep theirs), sizes and potential. A task returns one k by dim table of sums."""
    k, dim = centroids.shape

    def run(frames):
        total = np.zeros((k, dim + 2))
        for f in frames:
            x = _matrix(f[vector])
            if len(x):
                c, d2 = nearest(x, centroids)
                np.add.at(total, c, np.column_stack([x, np.ones(len(x)), d2]))
        used = np.nonzero(total[:, dim])[0]
        if len(used):  # an empty list has no array type
            yield pd.DataFrame({"c": used, "s": [total[i] for i in used]})

    sums = df.select(vector).mapInPandas(run, "c int, s array<double>")
    added = sums.select("c", F.posexplode("s").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    new, sizes, potential = centroids.copy(), np.zeros(k), 0.0
    for r in added.collect():  # k rows
        s = np.array([x["v"] for x in r["s"]])
        new[r["c"]], sizes[r["c"]], potential = s[:dim] / s[dim], s[dim], potential + s[dim + 1]
    return new, sizes, potential


#: Rounds of the seeding, and centres drawn in a round for each one wanted.
SEED_ROUNDS, OVERSAMPLE = 5, 2.0


def seed(df: DataFrame, vector: str, k: int, rng: int = 305, key: str | None = None) -> np.ndarray:
    """k seeds by parallel k-means++: in each of a few rounds every row is drawn with a probability in proportion to its squared distance, about ``OVERSAMPLE * k`` in all.

    The rows nearest to each drawn centre are counted, and a weighted
    k-means++ with local trials picks k of the centres on the driver.  Two
    passes a round, however large k is.  A draw is decided by the hash of the
    row's ``key`` (of its vector where there is none), so the seeds don't
    depend on the partitions.
    """
    x = df.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v"), F.xxhash64(key or vector).alias("h"))
    first = x.orderBy(F.xxhash64("h", F.lit(rng)), "v").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    centres = np.array([first[0]["v"]], np.float64)

    def over(each, kind: str):
        def run(frames):
            for f in frames:
                m = _matrix(f["v"])
                if len(m):
                    yield each(f, m)

        return run, kind

    for i in range(SEED_ROUNDS):
        have = centres
        total = lambda f, m: pd.DataFrame({"p": [nearest(m, have)[1].sum()]})  # noqa: B023, E731
        potential = x.select("v").mapInPandas(*over(total, "p double")).agg(F.sum("p")).first()[0] or 0.0
        if potential <= 1e-12:
            break
        share = OVERSAMPLE * k / potential

        def draw(f, m, have=have, share=share):
            hit = f["u"].to_numpy() < share * nearest(m, have)[1]
            return pd.DataFrame({"v": pd.Series([v.tolist() for v in m[hit]], dtype=object)})

        u = ((F.shiftrightunsigned(F.xxhash64("h", F.lit(rng + 1 + i)), 11) + 0.5) / 2.0**53).alias("u")
        drawn = x.select("v", u).mapInPandas(*over(draw, "v array<double>")).collect()  # about OVERSAMPLE * k
        if drawn:
            centres = np.unique(np.vstack([centres, np.array([r["v"] for r in drawn])]), axis=0)
    have = centres

    def count(f, m):
        n = np.bincount(nearest(m, have)[0], minlength=len(have))
        return pd.DataFrame({"c": np.flatnonzero(n), "n": n[n > 0]})

    weight = np.zeros(len(centres))
    for r in x.select("v").mapInPandas(*over(count, "c bigint, n bigint")).groupBy("c").agg(F.sum("n").alias("n")).collect():
        weight[r["c"]] = r["n"]
    return _pick(centres, weight, k, np.random.default_rng(rng))


def _pick(centres: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ with local trials over a table of candidates; all of them if there are no more than k."""
    if len(centres) <= k:
        return centres
    chosen = [int(rng.choice(len(centres), p=weight / weight.sum()))]
    d2 = ((centres - centres[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        mass = weight * d2
        if mass.sum() <= 0:
            break
        tried = rng.choice(len(centres), 2 + int(np.log(max(k, 2))), p=mass / mass.sum())
        left = [np.minimum(d2, ((centres - centres[t]) ** 2).sum(axis=1)) for t in tried]
        best = int(np.argmin([weight @ x for x in left]))
        chosen.append(int(tried[best]))
        d2 = left[best]
    return centres[chosen]


def kmeans(df: DataFrame, vector: str, k: int, iterations: int = 50, init: np.ndarray | None = None, starts: int = 1, rng: int = 305, key: str | None = None) -> tuple[np.ndarray, float]:
    """Centroids and potential of the best of ``starts`` runs of a fixed number of steps."""
    data = df.where(F.col(vector).isNotNull()).select(vector, *([key] if key and key != vector else [])).persist()
    try:
        best = None
        for s in range(starts):
            c = seed(data, vector, k, rng + s, key) if init is None else init
            for _ in range(iterations if len(c) else 0):
                c, _, _ = step(data, vector, c)
            p = step(data, vector, c)[2] if len(c) else 0.0
            if best is None or p < best[1]:
                best = (c, p)
        return best
    finally:
        data.unpersist()


def hierarchical(df: DataFrame, key: str, vector: str, ks: list[int], iterations: int = 10, resample: int = 0, rounds: int = 1, rng: int = 305) -> list[np.ndarray]:
    """Centroids per level: a level clusters the centroids below it; with ``resample`` the lowest is refitted on that many closest members of each cluster."""
    spark = df.sparkSession
    levels: list[np.ndarray] = []
    data, v = df, vector
    for k in ks:
        c, _ = kmeans(data, v, k, iterations, rng=rng, key=None if levels else key)
        for _ in range(rounds if resample and not levels else 0):
            members = assign(data, key, v, [c])
            w = Window.partitionBy("cluster_0").orderBy("dist2_0", key)
            near = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= resample).select(key)
            c, _ = kmeans(cut(data.join(near, key, "left_semi")), v, k, iterations, init=c)
        levels.append(c)
        data, v = spark.createDataFrame([(x.tolist(),) for x in c], "v array<double>"), "v"
    return levels


def split(df: DataFrame, key: str, vector: str, cluster: str, parts: int, iterations: int = 10, rng: int = 305) -> DataFrame:
    """``(key, cluster, part)``: each cluster cut into up to ``parts`` by k-means of its own; empty parts vanish.

    All clusters share the passes: draws, potentials and sums are keyed by
    cluster and part, so their number adds no job and a large one spans many
    tasks.  Seeds are drawn as in ``seed``, by the hash of the vector, whatever
    the partitions.
    """
    kinds = dict(df.dtypes)
    trials = 2 + int(np.log(max(parts, 2)))
    rows = df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.col(key).alias("k"), F.col(cluster).alias("c"), F.col(vector).alias("v"))
    data = rows.select("c", "v", F.xxhash64("v").alias("h")).persist()

    def groups(f):
        return ((c, at, _matrix(f["v"].iloc[at])) for c, at in f.groupby("c").indices.items())

    def draw(own: dict, count: int, salt: int) -> dict:
        """Per cluster up to ``count`` rows in proportion to their squared distance from its centroids, of all alike where it has none."""

        def run(frames):
            best: dict = {}
            for f in frames:
                for c, at, x in groups(f):
                    d2 = nearest(x, own[c])[1] if own else np.ones(len(x))
                    for t in range(count):
                        race = np.where(d2 > 0, -np.log(f[f"u{t}"].to_numpy()[at]) / np.maximum(d2, 1e-300), np.inf)
                        i = int(race.argmin())
                        if race[i] < best.get((c, t), (np.inf,))[0]:
                            best[c, t] = race[i], x[i]
            if best:
                yield pd.DataFrame([(c, t, r, v) for (c, t), (r, v) in best.items()], columns=["c", "t", "race", "v"])

        drawn = [((F.shiftrightunsigned(F.xxhash64("h", F.lit(salt + t)), 11) + 0.5) / 2.0**53).alias(f"u{t}") for t in range(count)]
        found: dict = {}
        for r in data.select("c", "v", *drawn).mapInPandas(run, f"c {kinds[cluster]}, t int, race double, v array<double>").groupBy("c", "t").agg(F.min_by("v", "race").alias("v")).orderBy("c", "t").collect():
            found.setdefault(r["c"], []).append(np.array(r["v"]))
        return found

    def potentials(own: dict, drawn: dict) -> dict:
        def run(frames):
            total = {c: np.zeros(len(b)) for c, b in drawn.items()}
            for f in frames:
                for c, _, x in groups(f):
                    if c in drawn:
                        d2 = nearest(x, own[c])[1]
                        total[c] += [np.minimum(d2, ((x - b) ** 2).sum(axis=1)).sum() for b in drawn[c]]
            yield pd.DataFrame([(c, i, p) for c, ps in total.items() for i, p in enumerate(ps)], columns=["c", "i", "p"])

        return {(r["c"], r["i"]): r["p"] for r in data.select("c", "v").mapInPandas(run, f"c {kinds[cluster]}, i int, p double").groupBy("c", "i").agg(F.sum("p").alias("p")).collect()}

    def step_of_all(own: dict) -> dict:
        def run(frames):
            total: dict = {}
            for f in frames:
                for c, _, x in groups(f):
                    sums = total.setdefault(c, np.zeros((len(own[c]), x.shape[1] + 1)))
                    np.add.at(sums, nearest(x, own[c])[0], np.column_stack([x, np.ones(len(x))]))
            if total:
                yield pd.DataFrame([(c, p, s) for c, sums in total.items() for p, s in enumerate(sums) if s[-1]], columns=["c", "p", "s"])

        sums = data.select("c", "v").mapInPandas(run, f"c {kinds[cluster]}, p int, s array<double>")
        added = sums.select("c", "p", F.posexplode("s").alias("i", "v")).groupBy("c", "p", "i").agg(F.sum("v").alias("v")).groupBy("c", "p").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
        new = {c: x.copy() for c, x in own.items()}
        for r in added.collect():  # a row per cluster and part
            s = np.array([x["v"] for x in r["s"]])
            new[r["c"]][r["p"]] = s[:-1] / s[-1]
        return new

    try:
        own = {c: np.stack(v) for c, v in draw({}, 1, rng).items()}
        for n in range(1, parts if own else 1):
            drawn = draw(own, trials, n * 1000 + rng)
            if not drawn:  # no cluster has a row off its centroids
                break
            p = potentials(own, drawn)
            for c, b in drawn.items():
                own[c] = np.vstack([own[c], b[min(range(len(b)), key=lambda i: (p[c, i], i))]])
        for _ in range(iterations if own else 0):
            before, own = own, step_of_all(own)
            if all(np.array_equal(before[c], own[c]) for c in own):
                break
    finally:
        data.unpersist()

    def run(frames):
        for f in frames:
            part = np.zeros(len(f), np.int32)
            for c, at, x in groups(f):
                part[at] = nearest(x, own[c])[0]
            yield pd.DataFrame({key: f["k"], cluster: f["c"], "part": part})

    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, `{cluster}` {kinds[cluster]}, part int")


def invert(members: DataFrame, cluster: str, key: str) -> DataFrame:
    """Members of each cluster as a sorted list; use only where clusters are bounded, sizes alone come from a count."""
    return members.groupBy(cluster).agg(F.array_sort(F.collect_list(key)).alias("members"), F.count("*").alias("size"))


def flatten_hierarchy(edges: list[DataFrame]) -> DataFrame:
    """``(level, cluster_id, leaf)`` from edge lists ``(cluster_id, child_id)`` of each level, by one join per level."""
    flat = edges[0].select(F.lit(0).alias("level"), "cluster_id", F.col("child_id").alias("leaf"))
    out = flat
    for i, e in enumerate(edges[1:], 1):
        flat = e.alias("e").join(flat.alias("f"), F.col("e.child_id") == F.col("f.cluster_id")).select(F.lit(i).alias("level"), F.col("e.cluster_id").alias("cluster_id"), F.col("f.leaf").alias("leaf"))
        out = out.unionByName(flat)
    return out


def hierarchical_sample(df: DataFrame, levels: list[str], distance: str, target: int, ties: list[Column], multiplier: int = 1) -> DataFrame:
    """Quotas poured down the levels by water filling; at the leaves whole copies and the closest for the rest, ``multiplier`` copies at most."""
    sizes = df.groupBy(*levels).agg(F.count("*").alias("size"))
    upper = sizes.groupBy(levels[0]).agg(F.sum("size").alias("size"))
    top = water_fill(upper, levels[0], "size", target, multiplier)
    quota = top.select(levels[0], F.col("quota").alias("__q"))
    for depth in range(1, len(levels)):
        keys = levels[: depth + 1]
        below = sizes.groupBy(*keys).agg(F.sum("size").alias("size")).join(quota, levels[:depth])
        w = Window.partitionBy(*levels[:depth])
        # the same water level within each parent
        cap = below.withColumn("cap", F.col("size") * multiplier)
        order = w.orderBy("cap", levels[depth])
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.count("*").over(w) - F.row_number().over(order) + 1
        cap = cap.withColumn("__o", F.row_number().over(order)).withColumn("__lv", F.floor((F.col("__q") - before) / left))
        cap = cap.withColumn("__x", F.greatest(F.coalesce(F.min(F.when(F.col("__lv") < F.col("cap"), F.struct("__o", "__lv"))).over(w)["__lv"], F.max("cap").over(w)), F.lit(0)))
        cap = cap.withColumn("__b", F.least("cap", "__x")).withColumn("__m", F.col("cap") > F.col("__x"))
        at = F.row_number().over(Window.partitionBy(*levels[:depth], "__m").orderBy(levels[depth]))
        rest = F.col("__q") - F.sum("__b").over(w)
        quota = cap.withColumn("__at", at).withColumn("__rest", rest).select(*keys, (F.col("__b") + F.when(F.col("__m") & (F.col("__at") <= F.col("__rest")), 1).otherwise(0)).alias("__q"))
    leaf = row_numbers(df, levels, [F.col(distance).asc_nulls_last(), *ties], "__rn").join(small(sizes), levels).join(small(quota), levels)
    copies = F.floor(F.col("__q") / F.col("size")) + F.when(F.col("__rn") <= F.col("__q") % F.col("size"), 1).otherwise(0)
    return leaf.withColumn("n_copies", copies.cast("int")).where("n_copies > 0").drop("__rn", "__q", "size")


def generalised_1d(x: np.ndarray, k: int, power: int = 1, iterations: int = 30) -> np.ndarray:
    """Centroids of one-dimensional clusters under the distortion |x - c| ** (2 * power), updated by five Newton steps."""
    c = np.quantile(x, (np.arange(k) + 0.5) / k)
    n = 2 * power
    for _ in range(iterations):
        at = np.abs(x[:, None] - c).argmin(axis=1)
        for j in range(k):
            y = x[at == j]
            for _ in range(5 if len(y) else 0):
                d = c[j] - y
                curve = (n * (n - 1) * d ** (n - 2)).sum() if n > 2 else 2.0 * len(y)
                if curve > 1e-12:
                    c[j] -= (n * d ** (n - 1)).sum() / curve
    return np.sort(c)


def generalised_1d_by(df: DataFrame, x: str, by: str, k: int, power: int = 1, iterations: int = 30) -> dict:
    """``generalised_1d`` of each group's values of ``x``, every row counted once, as a dictionary of sorted centres.

    Rows are counted by group and value first.  A step is one pass: the powers
    of the distances from the nearest centre, summed by group and centre, give
    the Newton sums at any point, so all five Newton steps follow from them.
    ``by`` is a grouping of bounded size (topics, formats).
    """
    values = df.where(F.col(x).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("g"), F.col(x).cast("double").alias("x"))
    counted = values.groupBy("g", "x").agg(F.count("*").alias("w")).persist()
    n = 2 * power
    try:
        at: dict = {}
        for r in quantiles(values, "x", [(i + 0.5) / k for i in range(k)], ["g"]).orderBy("g", "p").collect():
            at.setdefault(r["g"], []).append(r["value"])
        centres = {g: np.array(c) for g, c in at.items()}
        for _ in range(iterations if centres else 0):
            known = df.sparkSession.createDataFrame([(g, c.tolist()) for g, c in centres.items()], f"g {dict(df.dtypes)[by]}, c array<double>")
            off = F.transform("c", lambda c: F.abs(F.col("x") - c))
            near = counted.join(F.broadcast(known), "g").withColumn("j", (F.array_position(off, F.array_min(off)) - 1).cast("int"))  # a row per group
            d = F.col("x") - F.get("c", F.col("j"))
            sums = near.groupBy("g", "j").agg(*[F.sum(F.col("w") * F.pow(d, F.lit(float(i)))).alias(f"m{i}") for i in range(n)]).collect()
            new = {g: c.copy() for g, c in centres.items()}
            for r in sums:
                m, s = [r[f"m{i}"] for i in range(n)], 0.0
                # the sum of w (s - d) ** e from the sums of w d ** i
                at_s = lambda e: sum(comb(e, i) * (-1) ** i * m[i] * s ** (e - i) for i in range(e + 1))  # noqa: B023, E731
                for _ in range(5):
                    curve = n * (n - 1) * at_s(n - 2)
                    if curve > 1e-12:
                        s -= n * at_s(n - 1) / curve
                new[r["g"]][r["j"]] += s
            before, centres = centres, new
            if all(np.array_equal(before[g], centres[g]) for g in centres):
                break
        return {g: np.sort(c) for g, c in centres.items()}
    finally:
        counted.unpersist()


def expand(df: DataFrame, n: str = "n_copies") -> DataFrame:
    """A row per copy."""
    return repeat_rows(df, n)


def centroid_table(spark: SparkSession, levels: list[np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(i, j, c.tolist()) for i, cs in enumerate(levels) for j, c in enumerate(cs)], "level int, cluster int, centroid array<double>")

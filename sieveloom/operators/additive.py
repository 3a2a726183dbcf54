"""Additive models over binned features with pairwise terms, boosted on tables of counts.

One pass counts the bins that meet in a row for every pair of features, and
sums the target by bin; cyclic boosting of the single terms then needs these
tables only, as the residual of a bin is its sum less what the other terms
predict for the bins it meets.  A second pass sums the residuals by coarse
cells of every pair: the pairs whose cells hold most of what is left become
terms, and are fitted in a few passes of residual sums.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles

#: Bins of a feature in a pair at most, rows that a cell should have on average, and bins in the search for pairs.
PAIR_BINS, PAIR_ROWS, SEARCH_BINS = 32, 50, 8
#: Rows that a cell's mean is drawn towards none by, and passes over the pairs.
LEAST, PASSES = 10.0, 6


@dataclass
class Additive:
    intercept: float
    medians: dict[str, float]
    edges: dict[str, np.ndarray]  # of numbers
    levels: dict[str, list]  # of labels, an unknown one is the first bin
    tables: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)
    weights: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)
    pair_bins: int = PAIR_BINS

    @property
    def features(self) -> list[str]:
        return [*self.edges, *self.levels]

    def size(self, f: str) -> int:
        return len(self.edges[f]) + 1 if f in self.edges else len(self.levels[f]) + 1

    def codes(self, frame: pd.DataFrame) -> dict[str, np.ndarray]:
        """Bin of every feature and row; a missing number counts as the median."""
        out = {}
        for f, e in self.edges.items():
            x = frame[f].to_numpy(float)
            out[f] = np.searchsorted(e, np.where(np.isnan(x), self.medians[f], x), "right")
        for f, known in self.levels.items():
            number = {v: i + 1 for i, v in enumerate(known)}
            out[f] = np.fromiter((number.get(v, 0) for v in frame[f].tolist()), np.int64, len(frame))
        return out

    def coarse(self, f: str, bins: int) -> np.ndarray:
        """Fewer bins of about as many rows each; labels keep theirs."""
        if f in self.levels or self.size(f) <= bins:
            return np.arange(self.size(f))
        w = self.weights[f,]
        return np.minimum((np.cumsum(w) - w / 2) / max(w.sum(), 1) * bins, bins - 1).astype(np.int64)

    def predict(self, codes: dict[str, np.ndarray]) -> np.ndarray:
        out = np.full(len(next(iter(codes.values()))), self.intercept)
        for t, table in self.tables.items():
            out += table[codes[t[0]]] if len(t) == 1 else table[self.coarse(t[0], self.pair_bins)[codes[t[0]]], self.coarse(t[1], self.pair_bins)[codes[t[1]]]]
        return out

    def importance(self) -> list[tuple[str, float]]:
        """Mean absolute contribution of each term over the rows, greatest first."""
        out = [(" x ".join(t), float((np.abs(self.tables[t]) * w).sum() / max(w.sum(), 1))) for t, w in self.weights.items() if t in self.tables]
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def curves(self, trim: float = 0.01) -> list[tuple[str, int, float | None, str | None, float]]:
        """(feature, bin, least value, label, contribution) of the single terms; of numbers the bins within the trimmed share of their edges."""
        out = []
        for f, e in self.edges.items():
            a, b = int(trim * len(e)), len(e) - int(trim * len(e))
            out += [(f, i, float(e[i - 1]), None, float(self.tables[f,][i])) for i in range(max(a, 1), b + 1)]
        for f, known in self.levels.items():
            out += [(f, i + 1, None, str(v), float(self.tables[f,][i + 1])) for i, v in enumerate(known)]
        return out

    def grids(self) -> list[tuple[str, str, int, int, float]]:
        """(feature, feature, bin, bin, contribution) of the pairs."""
        return [(*t, int(i), int(j), float(table[i, j])) for t, table in self.tables.items() if len(t) == 2 for i, j in np.argwhere(self.weights[t] > 0)]


def _summed(df: DataFrame, columns: list[str], cells) -> pd.DataFrame:
    """``(term, cell, n, s)`` summed over the cluster from ``cells(frame)``, which yields (term, cells, values, size) of a batch; a task holds one table a term."""

    def run(frames):
        held: dict[int, np.ndarray] = {}
        for f in frames:
            for term, cell, value, size in cells(f):
                t = held.setdefault(term, np.zeros((2, size)))
                t[0] += np.bincount(cell, minlength=size)
                t[1] += np.bincount(cell, weights=value, minlength=size)
        for term, t in held.items():
            used = np.flatnonzero(t[0])
            yield pd.DataFrame({"term": np.int32(term), "cell": used, "n": t[0][used], "s": t[1][used]})

    return df.select(*columns).mapInPandas(run, "term int, cell bigint, n double, s double").groupBy("term", "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()


def _dense(rows: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    n, s = np.zeros(size), np.zeros(size)
    n[rows["cell"]], s[rows["cell"]] = rows["n"], rows["s"]
    return n, s


def fit(df: DataFrame, numbers: list[str], labels: list[str], target: str, bins: int = 256, rounds: int = 200, rate: float = 0.1, pairs: int = 20) -> Additive:
    """An additive model of ``target`` over numbers, cut at their quantiles, and nominal labels, with the ``pairs`` strongest pairs.

    Rows without a target are left out; labels have few values by their
    meaning.  The driver holds the tables of counts: at most (features * bins)
    squared / 2 numbers, however many rows.
    """
    rows = df.where(F.col(target).isNotNull()).select(*numbers, *labels, target)
    model = Additive(0.0, {}, {}, {})
    if numbers:
        long = rows.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([], numbers, "feature", "x")
        at: dict[str, list] = {}
        for r in quantiles(long, "x", sorted({0.5, *(i / bins for i in range(1, bins))}), ["feature"]).orderBy("feature", "p").collect():
            at.setdefault(r["feature"], []).append((r["p"], r["value"]))
        for f in numbers:
            model.medians[f] = dict(at.get(f, [])).get(0.5, 0.0)
            model.edges[f] = np.unique([v for p, v in at.get(f, [])])
    if labels:
        found = rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in labels]).first()
        model.levels = {c: list(found[c]) for c in labels}
    names, size = model.features, {f: model.size(f) for f in model.features}
    columns, both = [*numbers, *labels, target], list(combinations(range(len(names)), 2))

    def singles_and_pairs(f):
        codes, y = model.codes(f), f[target].to_numpy(float)
        for i, a in enumerate(names):
            yield i, codes[a], y, size[a]
        for k, (i, j) in enumerate(both):
            yield len(names) + k, codes[names[i]] * size[names[j]] + codes[names[j]], y, size[names[i]] * size[names[j]]

    by = dict(list(_summed(rows, columns, singles_and_pairs).groupby("term")))
    if not by:
        return model
    weight, total = zip(*[_dense(by[i], size[a]) for i, a in enumerate(names)])
    meet = {(i, j): _dense(by[len(names) + k], size[names[i]] * size[names[j]])[0].reshape(size[names[i]], size[names[j]]) for k, (i, j) in enumerate(both)}
    n = weight[0].sum()
    model.intercept = float(total[0].sum() / n)
    term = [np.zeros(size[a]) for a in names]
    for _ in range(rounds):
        for i in range(len(names)):
            predicted = sum((meet[i, j] @ term[j] if i < j else meet[j, i].T @ term[j] for j in range(len(names)) if j != i), weight[i] * (model.intercept + term[i]))
            step = rate * (total[i] - predicted) / (weight[i] + 1.0)
            term[i] += step - (step * weight[i]).sum() / n
    for i, a in enumerate(names):
        model.tables[a,], model.weights[a,] = term[i], weight[i]
    model.pair_bins = int(np.clip(np.sqrt(n / PAIR_ROWS), 2, PAIR_BINS))
    if pairs and both:
        _add_pairs(rows, columns, target, model, both, pairs)
    return model


def _add_pairs(rows: DataFrame, columns: list[str], target: str, model: Additive, both: list, pairs: int) -> None:
    names = model.features

    def cells(wanted: list, bins: int):
        group = {f: model.coarse(f, bins) for f in names}
        size = {f: int(g.max()) + 1 for f, g in group.items()}

        def of(f):
            codes = model.codes(f)
            left = f[target].to_numpy(float) - model.predict(codes)
            at = {a: group[a][codes[a]] for a in names}
            for k, (a, b) in enumerate(wanted):
                yield k, at[a] * size[b] + at[b], left, size[a] * size[b]

        return of, size

    wanted = [(names[i], names[j]) for i, j in both]
    of, _ = cells(wanted, SEARCH_BINS)
    gain = {k: float((r["s"] ** 2 / (r["n"] + LEAST)).sum()) for k, r in _summed(rows, columns, of).groupby("term")}
    chosen = [wanted[k] for k in sorted(gain, key=lambda k: (-gain[k], k))[:pairs]]
    of, size = cells(chosen, model.pair_bins)
    for a, b in chosen:
        model.tables[a, b] = np.zeros((size[a], size[b]))

    def squares(delta: dict):
        """The change of the rows' predictions, squared and summed."""

        def run(frames):
            total = 0.0
            for f in frames:
                codes = model.codes(f)
                total += float((sum(d[model.coarse(a, model.pair_bins)[codes[a]], model.coarse(b, model.pair_bins)[codes[b]]] for (a, b), d in delta.items()) ** 2).sum())
            yield pd.DataFrame({"s": [total]})

        return rows.select(*columns).mapInPandas(run, "s double").agg(F.sum("s")).first()[0]

    for _ in range(PASSES):
        delta, along = {}, 0.0
        for k, r in _summed(rows, columns, of).groupby("term"):
            a, b = chosen[k]
            n, s = (x.reshape(size[a], size[b]) for x in _dense(r, size[a] * size[b]))
            delta[a, b], model.weights[a, b] = s / (n + LEAST), n
            along += float((s * delta[a, b]).sum())
        # the pairs move together, as far as the squared error falls
        step = along / max(squares(delta), 1e-12)
        for t, d in delta.items():
            model.tables[t] = model.tables[t] + step * d


def predict(df: DataFrame, keys: list[str], model: Additive, impute: bool = False) -> DataFrame:
    """``keys`` and ``prediction`` of every row; with ``impute`` missing numbers count as the medians of the scored frame itself."""
    if impute and model.edges:
        medians = {}
        for r in quantiles(df.select(*[F.col(c).cast("double").alias(c) for c in model.edges]).unpivot([], list(model.edges), "feature", "x"), "x", [0.5], ["feature"]).collect():
            medians[r["feature"]] = r["value"]
        model = Additive(model.intercept, model.medians | medians, model.edges, model.levels, model.tables, model.weights, model.pair_bins)
    kinds = dict(df.dtypes)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({k: f[k] for k in keys} | {"prediction": model.predict(model.codes(f)) if model.features else model.intercept})

    return df.select(*dict.fromkeys([*keys, *model.features])).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", prediction double")

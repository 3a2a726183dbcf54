"""Models from sufficient statistics: one pass sums the Gram matrix over the cluster, the rest is linear algebra of its size."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hash_uniform


@dataclass
class Design:
    """Intercept, standardised numbers, and one-hot levels without the first of each label column."""

    numbers: list[str]
    labels: list[str]
    mean: np.ndarray = field(default=None)
    std: np.ndarray = field(default=None)
    levels: dict[str, list] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Design:
        """Means, population deviations (those below 1e-8 count as 1) and levels; label columns have few values by their meaning."""
        row = df.agg(*[F.avg(c) for c in self.numbers], *[F.stddev_pop(c) for c in self.numbers], *[F.sort_array(F.collect_set(c)) for c in self.labels]).first() if self.numbers or self.labels else []
        n = len(self.numbers)
        self.mean = np.array(row[:n], float)
        self.std = np.array([s if s and s >= 1e-8 else 1.0 for s in row[n : 2 * n]], float)
        self.levels = {c: list(row[2 * n + i]) for i, c in enumerate(self.labels)}
        return self

    @property
    def terms(self) -> list[str]:
        return ["intercept", *self.numbers, *(f"{c}={v}" for c in self.labels for v in self.levels[c][1:])]

    def matrix(self, f: pd.DataFrame) -> np.ndarray:
        """Rows of the design; NULL numbers count as the mean, unknown labels as the base level."""
        x = [np.ones(len(f))]
        for i, c in enumerate(self.numbers):
            x.append(np.nan_to_num((f[c].to_numpy(float) - self.mean[i]) / self.std[i]))
        for c in self.labels:
            v = f[c].to_numpy()
            x.extend((v == level).astype(float) for level in self.levels[c][1:])
        return np.column_stack(x)


def gram(df: DataFrame, make, columns: list[str], size: int) -> tuple[np.ndarray, int]:
    """Sum of z zᵀ over the rows ``make(frame)`` and their number; a task returns one matrix, they are summed as arrays in the cluster."""

    def run(frames):
        total, n = np.zeros((size, size)), 0
        for f in frames:
            z = make(f)
            total += z.T @ z
            n += len(z)
        yield pd.DataFrame({"i": range(size + 1), "v": [*total, np.array([n] + [0.0] * (size - 1))]})

    def added(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": f["i"].iloc[:1], "v": [np.sum(np.stack(f["v"].to_list()), axis=0)]})

    parts = df.select(*columns).mapInPandas(run, "i int, v array<double>")
    out, n = np.zeros((size, size)), 0
    # a row of the matrix comes back as one array
    for r in parts.groupBy("i").applyInPandas(added, "i int, v array<double>").collect():
        if r["i"] == size:
            n = int(r["v"][0]) if size else 0
        else:
            out[r["i"]] = r["v"]
    return out, n


@dataclass
class Linear:
    terms: list[str]
    targets: list[str]
    beta: np.ndarray

    def rows(self) -> list[tuple[str, str, float]]:
        return [(t, y, float(self.beta[i, j])) for i, t in enumerate(self.terms) for j, y in enumerate(self.targets)]


def _moments(df: DataFrame, design: Design, targets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    p = len(design.terms)
    g, n = gram(df, lambda f: np.column_stack([design.matrix(f), f[targets].to_numpy(float)]), [*design.numbers, *design.labels, *targets], p + len(targets))
    return g[:p, :p], g[:p, p:], g[p:, p:], n


def _solve(xx: np.ndarray, xy: np.ndarray, alpha: float) -> np.ndarray:
    penalty = alpha * np.eye(len(xx))
    penalty[0, 0] = 0  # the intercept is free
    return np.linalg.lstsq(xx + penalty, xy, rcond=None)[0]


def ridge(df: DataFrame, design: Design, targets: list[str], alpha: float) -> Linear:
    design.fit(df)
    xx, xy, _, _ = _moments(df, design, targets)
    return Linear(design.terms, targets, _solve(xx, xy, alpha))


def choose_alpha(df: DataFrame, design: Design, targets: list[str], key: Column, grid=(0.01, 0.1, 1.0, 10.0, 100.0), seed: int = 305) -> list[tuple[float, float, bool]]:
    """(alpha, validation RMSE, chosen): the first least; both parts give their Gram matrix once, whatever the grid."""
    u = hash_uniform(key, seed)
    design.fit(df.where(u >= 0.2))
    xx, xy, _, _ = _moments(df.where(u >= 0.2), design, targets)
    vx, vy, vv, n = _moments(df.where(u < 0.2), design, targets)
    out = []
    for a in grid:
        b = _solve(xx, xy, a)
        sse = np.trace(vv - 2 * b.T @ vy + b.T @ vx @ b)
        out.append((float(a), float(np.sqrt(max(sse, 0) / max(n * len(targets), 1)))))
    best = min(range(len(out)), key=lambda i: (out[i][1], i))
    return [(a, r, i == best) for i, (a, r) in enumerate(out)]


def r2(df: DataFrame, design: Design, target: str) -> float:
    design.fit(df)
    xx, xy, yy, n = _moments(df, design, [target])
    b = _solve(xx, xy, 0.0)
    sst = yy[0, 0] - xy[0, 0] ** 2 / max(n, 1)
    return 1 - (yy[0, 0] - (b.T @ xy)[0, 0]) / sst if sst > 1e-12 else float("nan")


@dataclass
class Posterior:
    """Draws as (chain, draw, parameter, value), and mean and deviation of the coefficients by term and target."""

    draws: list[tuple[int, int, str, float]]
    coefficients: list[tuple[str, str, float, float]]


#: Prior deviations of the blocks of coefficients; label columns not named here have that of a label.
PRIOR_SD = {"intercept": 10.0, "numbers": 1.0, "label": 0.5}


def _definite(m: np.ndarray) -> np.ndarray:
    m = (m + m.T) / 2
    least = np.linalg.eigvalsh(m)[0]
    return m + np.eye(len(m)) * max(1e-8 - least, 0.0)


def gibbs(df: DataFrame, design: Design, targets: list[str], chains: int = 4, draws: int = 500, burn: int = 200, thin: int = 1, prior_sd: dict[str, float] = PRIOR_SD, seed: int = 305) -> Posterior:
    """Posterior of a matrix-normal regression with inverse-Wishart noise; one pass over the data, every step works on the Gram matrix.

    A block of coefficients (intercept, numbers, each label column) has its own
    prior deviation, in units of the noise.  Of every ``thin``-th draw after
    ``burn`` the noise covariance and the variance that each block explains are
    kept: of the numbers the quadratic form of their covariance, of a label
    column the variance of its levels' effects by their share of rows.
    """
    design.fit(df)
    xx, xy, yy, n = _moments(df, design, targets)
    p, q = xy.shape
    first, blocks, sds = 1 + len(design.numbers), {}, [prior_sd["intercept"], *[prior_sd["numbers"]] * len(design.numbers)]
    for c in design.labels:
        blocks[c] = slice(first, first := first + len(design.levels[c]) - 1)
        sds += [prior_sd.get(c, prior_sd["label"])] * (len(design.levels[c]) - 1)
    ridge_ = 1.0 / np.array(sds) ** 2
    cov = np.linalg.inv(_definite(xx + np.diag(ridge_)))
    mean, left = cov @ xy, np.linalg.cholesky(_definite(cov))
    at = slice(1, 1 + len(design.numbers))
    number_cov = xx[at, at] / max(n, 1) - np.outer(xx[0, at], xx[0, at]) / max(n, 1) ** 2
    out, kept, total, square = [], 0, np.zeros((p, q)), np.zeros((p, q))
    start = _definite((yy - mean.T @ xy - xy.T @ mean + mean.T @ xx @ mean + np.eye(q)) / max(n - q, 1))
    for c in range(chains):
        rng, sigma = np.random.default_rng([seed, c]), start
        for t in range(burn + draws * thin):
            beta = mean + left @ rng.standard_normal((p, q)) @ np.linalg.cholesky(sigma).T
            scatter = _definite(yy - beta.T @ xy - xy.T @ beta + beta.T @ xx @ beta + (beta * ridge_[:, None]).T @ beta + np.eye(q))
            # Bartlett: an inverse-Wishart draw from a triangular one
            a = np.tril(rng.standard_normal((q, q)), -1) + np.diag(np.sqrt(rng.chisquare(n + p + q + 2 - np.arange(q))))
            half = np.linalg.cholesky(_definite(np.linalg.inv(scatter))) @ a
            sigma = _definite(np.linalg.inv(half @ half.T))
            if t < burn or (t - burn) % thin:
                continue
            kept, new = kept + 1, beta - total
            total += new / kept
            square += new * (beta - total)
            explained = {"numbers": np.einsum("pk,pq,qk->k", beta[at], number_cov, beta[at])}
            for name, own in blocks.items():
                share = np.diag(xx)[own] / max(n, 1)  # the first level has no effect
                explained[name] = share @ beta[own] ** 2 - (share @ beta[own]) ** 2
            d = (t - burn) // thin
            out += [(c, d, f"variance {name}|{y}", max(float(v[j]), 0.0)) for name, v in explained.items() for j, y in enumerate(targets)]
            out += [(c, d, f"sigma|{y}|{z}", float(sigma[j, k])) for j, y in enumerate(targets) for k, z in enumerate(targets) if j <= k]
    sd = np.sqrt(square / max(kept - 1, 1))
    return Posterior(out, [(term, y, float(total[i, j]), float(sd[i, j])) for i, term in enumerate(design.terms) for j, y in enumerate(targets)])


@dataclass
class Quality:
    """A latent quality: its regression on the design, and intercepts, loadings and noise of the scores."""

    terms: list[str]
    gamma: np.ndarray
    alpha: np.ndarray
    loading: np.ndarray
    noise: np.ndarray
    history: list[float]


def latent_quality(df: DataFrame, design: Design, targets: list[str], ridge_: float = 1.0, iterations: int = 200, least_noise: float = 1e-3, least_loading: float | None = 0.05, tol: float = 1e-6) -> Quality:
    """One latent factor of standardised scores whose prior mean is a ridge regression on the design, by expectation maximisation.

    The posterior mean is linear in design and scores, so every sum of a round
    follows from their Gram matrix: one pass over the data.  Loadings are kept
    at ``least_loading`` or more, or free if None; the factor is oriented to a
    positive mean loading; stops when the log likelihood moves by less than
    ``tol * (1 + |likelihood|)`` after the fourth round.
    """
    design.fit(df)
    xx, xy, yy, n = _moments(df, design, targets)
    k, p = len(targets), len(xx)
    # scores in units of their deviations: the design's first column is 1
    mu = xy[0] / max(n, 1)
    scale = np.sqrt(np.maximum(np.diag(yy) / max(n, 1) - mu**2, 1e-16))
    turn = np.eye(p + k)
    turn[p:, p:] = np.diag(1 / scale)
    turn[0, p:] = -mu / scale
    g = turn.T @ np.block([[xx, xy], [xy.T, yy]]) @ turn
    zz, zy = g[:p, :p], g[:p, p:]

    def regress(moment):
        penalty = ridge_ * np.eye(p)
        penalty[0, 0] = 0
        return np.linalg.solve(zz + penalty + 1e-9 * np.eye(p), moment)

    def measure(first, cross, second):
        """Intercepts, loadings and noise from the sums of the factor, of it with the scores, and of its square."""
        both = np.linalg.solve(np.array([[n, first], [first, second]]), np.stack([zy[0], cross]))
        a, w = both[0], both[1] if least_loading is None else np.maximum(both[1], least_loading)
        rest = np.diag(g)[p:] - 2 * a * zy[0] - 2 * w * cross + n * a**2 + 2 * a * w * first + w**2 * second
        return a, w, np.maximum(rest / n, least_noise)

    # at first the mean of the scores, standardised
    c = np.concatenate([np.zeros(p), np.full(k, 1 / k)])
    c /= max(np.sqrt(max(c @ g @ c / n, 1e-16)), 1e-8)
    gamma = regress(g[:p] @ c)
    c = np.concatenate([gamma, np.zeros(k)])
    alpha, w, psi = measure(g[0] @ c, g[p:] @ c, c @ g @ c + n)
    history: list[float] = []

    def posterior():
        v = 1.0 / (1.0 + (w**2 / psi).sum())
        c = np.concatenate([gamma, w / psi]) * v
        c[0] -= v * (alpha * w / psi).sum()
        return c, v

    for it in range(iterations):
        c, v = posterior()
        alpha, w, psi = measure(g[0] @ c, g[p:] @ c, n * v + c @ g @ c)
        if w.mean() < 0:
            gamma, w = -gamma, -w
        c, v = posterior()
        gamma = regress(g[:p] @ c)
        away = np.hstack([-np.outer(w, gamma), np.eye(k)])
        away[:, 0] -= alpha
        cov = np.diag(psi) + np.outer(w, w)
        history.append(-0.5 * (n * (k * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]) + np.trace(np.linalg.solve(cov, away @ g @ away.T))))
        if it > 3 and abs(history[-1] - history[-2]) < tol * (1 + abs(history[-2])):
            break
    return Quality(design.terms, gamma, alpha, w, psi, history)


@dataclass
class Factors:
    columns: list[str]
    mean: np.ndarray
    std: np.ndarray
    loadings: np.ndarray
    noise: np.ndarray
    history: list[float]


def factor_em(df: DataFrame, columns: list[str], r: int, iterations: int = 100, tol: float = 1e-6) -> Factors:
    """Factor analysis of standardised columns by expectation maximisation on their covariance.

    Starts at principal components; loadings are oriented to be positive on
    the whole; stops when the log likelihood grows by less than
    ``tol * (1 + |likelihood|)`` after the third round.
    """
    k = len(columns)
    g, n = gram(df.na.drop(subset=columns), lambda f: np.column_stack([np.ones(len(f)), f[columns].to_numpy(float)]), columns, k + 1)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-16))
    s = cov / np.outer(std, std)
    values, vectors = np.linalg.eigh(s)
    top = np.argsort(-values)[:r]
    w, psi, history = vectors[:, top] * np.sqrt(np.maximum(values[top], 1e-6)) * 0.8, np.full(k, 0.5), []
    for it in range(iterations):
        c = w @ w.T + np.diag(psi)
        history.append(-0.5 * n * (np.linalg.slogdet(c)[1] + np.trace(np.linalg.solve(c, s)) + k * np.log(2 * np.pi)))
        if it > 3 and history[-1] - history[-2] < tol * (1 + abs(history[-1])):
            break
        b = np.linalg.solve(c, w).T
        ezz = np.eye(r) - b @ w + b @ s @ b.T
        w = (s @ b.T) @ np.linalg.inv(ezz)
        psi = np.maximum(np.diag(s - w @ b @ s), 1e-4)
    w = w * np.where(w.sum(axis=0) < 0, -1, 1)
    return Factors(columns, mean, std, w, psi, history)


def factor_scores(df: DataFrame, keys: list[str], m: Factors) -> DataFrame:
    """Posterior mean of the factors times their mean loading, as a column expression: the weights are a few numbers."""
    b = np.linalg.solve(m.loadings @ m.loadings.T + np.diag(m.noise), m.loadings) @ m.loadings.mean(axis=0)
    quality = sum((F.col(c) - float(m.mean[i])) / float(m.std[i]) * float(b[i]) for i, c in enumerate(m.columns))
    return df.select(*keys, quality.alias("quality"))


def factor_correlations(m: Factors, cov: np.ndarray) -> list[tuple[int, str, float]]:
    """(factor, score or 'composite', correlation) of the posterior means with each standardised score and with their mean, from the scores' correlation matrix."""
    c = m.loadings @ m.loadings.T + np.diag(m.noise)
    weights = np.linalg.solve(c, m.loadings)  # of the scores in each factor
    k, out = len(m.columns), []
    for r in range(weights.shape[1]):
        b = weights[:, r]
        sd = np.sqrt(max(b @ cov @ b, 1e-16))
        mean = np.full(k, 1 / k)
        out.append((r, "composite", float(b @ cov @ mean / (sd * np.sqrt(max(mean @ cov @ mean, 1e-16))))))
        out += [(r, name, float((cov @ b)[j] / (sd * np.sqrt(cov[j, j])))) for j, name in enumerate(m.columns)]
    return out


def correlation(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlation matrix of the rows without missing values."""
    g, n = gram(df.na.drop(subset=columns), lambda f: np.column_stack([np.ones(len(f)), f[columns].to_numpy(float)]), columns, len(columns) + 1)
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    d = np.sqrt(np.maximum(np.diag(cov), 1e-16))
    return cov / np.outer(d, d)


def pca(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of the correlation matrix, greatest first."""
    values, vectors = np.linalg.eigh(correlation(df, columns))
    order = np.argsort(-values)
    return values[order], vectors[:, order]


def lasso(df: DataFrame, design: Design, target: str, grid: list[float], key: Column, folds: int = 5, seed: int = 305) -> Linear:
    """Coordinate descent on Gram matrices; the penalty of least cross-validated error, folds by hash, one matrix each."""
    design.fit(df)
    u = hash_uniform(key, seed)
    parts = [_moments(df.where((u >= i / folds) & (u < (i + 1) / folds)), design, [target]) for i in range(folds)]
    total = [sum(p[j] for p in parts) for j in range(4)]

    def descend(xx, xy, n, lam):
        b = np.zeros(len(xx))
        for _ in range(200):
            old = b.copy()
            for j in range(len(b)):
                rho = xy[j, 0] - xx[j] @ b + xx[j, j] * b[j]
                if xx[j, j] > 0:
                    b[j] = rho / xx[j, j] if j == 0 else np.sign(rho) * max(abs(rho) - lam * n, 0) / xx[j, j]
            if np.abs(b - old).max() < 1e-9:
                break
        return b[:, None]

    def error(lam):
        sse = 0.0
        for xx, xy, yy, n in parts:
            b = descend(total[0] - xx, total[1] - xy, total[3] - n, lam)
            sse += float((yy - 2 * b.T @ xy + b.T @ xx @ b)[0, 0])
        return sse

    best = min(sorted(grid), key=error)
    return Linear(design.terms, [target], descend(total[0], total[1], total[3], best))

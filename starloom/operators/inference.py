"""Fits and checks on small matrices, and model predictions over large tables.

Matrices have the size of a data vector, set by the caller, and live on the
driver; everything per sample stays in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.operators.statistics import debias


def matrix_of(cov: DataFrame, names: list | None = None) -> tuple[list, np.ndarray]:
    """(features, dense matrix) of (f1, f2, cov); absent pairs are 0."""
    rows = cov.collect()  # features squared
    names = sorted({r.f1 for r in rows} | {r.f2 for r in rows}) if names is None else names
    at = {f: i for i, f in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for r in rows:
        out[at[r.f1], at[r.f2]] = r["cov"]
    return names, out


def covariance_budget(mocks: np.ndarray, n_mocks: int, n_params: int, emulator: np.ndarray | None = None, extra: list[np.ndarray] = (), volume_factor: float = 64.0, method: str = "percival") -> np.ndarray:
    """Debiased sum of the mocks' covariance over the volume factor and the emulator's."""
    total = mocks / volume_factor
    for part in ([] if emulator is None else [emulator]) + list(extra):
        total = total + part
    return debias(n_mocks, len(total), n_params, method) * total


def precision(covariance: np.ndarray) -> np.ndarray:
    """Inverse of a covariance that is square, symmetric, positive definite and not singular; anything else raises."""
    from starloom.operators.statistics import is_positive_definite, significant_condition

    c = np.asarray(covariance, float)
    if c.ndim != 2 or c.shape[0] != c.shape[1]:
        raise ValueError(f"a covariance is square, this has shape {c.shape}")
    if not np.allclose(c, c.T):
        raise ValueError("the covariance is not symmetric")
    if not is_positive_definite(c):
        raise ValueError("the covariance is not positive definite")
    if significant_condition(c) == 0:
        raise ValueError("the covariance is singular")
    return np.linalg.inv(c)


def fisher(jacobian: np.ndarray, precision: np.ndarray) -> np.ndarray:
    return jacobian.T @ precision @ jacobian


def log_det(matrix: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(matrix)
    return float(value) if sign > 0 else -math.inf


def greedy_bins(spark, mocks: np.ndarray, jacobian: np.ndarray, *, n_params: int = 20, emulator_error: np.ndarray | None = None, least_gain: float = 1e-6, ridge: float = 1e-9, most: int | None = None) -> list[tuple[int, float]]:
    """Bins in order of their gain in log-determinant, until the gain is too small.

    Candidates of a step are scored in parallel; the mocks are a matrix of the
    caller's size. A small ridge keeps the first steps, of too low a rank,
    comparable.
    """
    chosen: list[int] = []
    out: list[tuple[int, float]] = []
    now = log_det(ridge * np.eye(jacobian.shape[1]))
    bins = mocks.shape[1]
    while len(chosen) < (bins if most is None else most):
        left = [b for b in range(bins) if b not in chosen]

        def score(b: int, chosen=tuple(chosen)) -> float:
            cols = [*chosen, b]
            cov = np.atleast_2d(np.cov(mocks[:, cols], rowvar=False))
            if emulator_error is not None:
                cov = cov + np.diag(emulator_error[cols] ** 2)
            factor = debias(len(mocks), len(cols), n_params) if len(mocks) > len(cols) + 4 else 1.0
            return log_det(fisher(jacobian[cols], np.linalg.inv(cov * factor)) + ridge * np.eye(jacobian.shape[1]))

        def scores(frames):
            for frame in frames:
                yield frame.assign(score=[score(int(b)) for b in frame["bin"]])

        table = spark.createDataFrame([(b,) for b in left], "bin int").mapInPandas(scores, "bin int, score double")
        best = table.agg(F.max_by("bin", F.struct("score", -F.col("bin"))).alias("b"), F.max("score").alias("s")).first()
        if best.s - now < least_gain:
            break
        chosen.append(best.b)
        out.append((best.b, best.s - now))
        now = best.s
    return out


def chi2(residuals: DataFrame, precision: list[list[float]], order: list, sample: tuple[str, ...] = ("sample",), feature: str = "feature", value: str = "residual") -> DataFrame:
    """(sample, chi2) from long residuals and a precision matrix in ``order``.

    A sample's residuals become an array; the quadratic form is evaluated where
    the row is. Samples that lack a feature get null.
    """
    rows = residuals.groupBy(*sample).agg(F.map_from_entries(F.collect_list(F.struct(F.col(feature), F.col(value)))).alias("_m"))
    vector = F.array(*[F.element_at("_m", F.lit(f)) for f in order])
    lines = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in precision])
    out = rows.select(*sample, vector.alias("_v"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    product = F.transform(lines, lambda line: dot(line, F.col("_v")))
    whole = F.forall("_v", lambda x: x.isNotNull())
    return out.select(*sample, F.when(whole, dot(product, F.col("_v"))).alias("chi2"))


def best_fit(scores: DataFrame, sample: str = "sample") -> DataFrame:
    """The sample of least chi2, ties to the smaller label."""
    return scores.agg(F.min_by(F.struct(sample, "chi2"), F.struct("chi2", sample)).alias("b")).select("b.*")


def gaussian_log_likelihood(x, data, sigma):
    return -0.5 * (x - data) * (x - data) / (sigma * sigma)


def posterior_predictive(samples: DataFrame, observed: np.ndarray, model: Callable, statistic: Callable, covariance: np.ndarray, params: list[str], seed: int = 42) -> DataFrame:
    """(sample, t_rep, t_obs): statistic of a replicated and of the observed data under each draw.

    The noise of a draw depends on its number and the seed only.
    """
    root = np.linalg.cholesky(covariance)

    def draw(frames):
        for frame in frames:
            rep, obs = [], []
            for i, theta in zip(frame["sample"], frame[params].to_numpy(), strict=True):
                mean = model(theta)
                noise = root @ np.random.default_rng([seed, int(i)]).standard_normal(len(mean))
                rep.append(float(statistic(mean + noise, mean)))
                obs.append(float(statistic(observed, mean)))
            yield frame[["sample"]].assign(t_rep=rep, t_obs=obs)

    return samples.select("sample", *params).mapInPandas(draw, "sample long, t_rep double, t_obs double")


def p_value(draws: DataFrame) -> DataFrame:
    return draws.agg(F.avg((F.col("t_rep") > F.col("t_obs")).cast("double")).alias("p"))


class Network:
    """A dense network with smooth gates, as plain weight arrays."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], mean_x=0.0, std_x=1.0, mean_y=0.0, std_y=1.0, transform: str | None = None):
        self.layers, self.mean_x, self.std_x, self.mean_y, self.std_y, self.transform = layers, mean_x, std_x, mean_y, std_y, transform

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = (np.asarray(x, float) - self.mean_x) / self.std_x
        for i, (w, b) in enumerate(self.layers):
            h = h @ w + b
            if i < len(self.layers) - 1:
                h = h / (1 + np.exp(-h))
        y = h * self.std_y + self.mean_y
        if self.transform == "log":
            return 10**y
        if self.transform == "arcsinh":
            return np.sinh(y)
        return y


def predict(params: DataFrame, model: Callable, names: list[str], features: list[tuple], keys: tuple[str, ...] = ("sample",), dims: tuple[str, ...] = ("feature",)) -> DataFrame:
    """Long predictions (keys, dims, value): one row per sample and feature."""
    missing = [n for n in names if n not in params.columns]
    if missing:
        raise ValueError(f"parameters without a column: {missing}")
    example = params.schema
    schema = T.StructType([*(example[k] for k in keys), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(frames):
        for frame in frames:
            y = model(frame[names].to_numpy(float))
            yield frame[list(keys)].assign(values=[list(map(float, r)) for r in np.asarray(y)])

    out = params.select(*keys, *[n for n in names if n not in keys]).mapInPandas(run, schema)
    labels = F.array(*[F.struct(*[F.lit(v).alias(d) for d, v in zip(dims, f, strict=True)]) for f in features])
    return out.select(*keys, F.explode(F.arrays_zip(labels.alias("l"), F.col("values").alias("v"))).alias("r")).select(*keys, "r.l.*", F.col("r.v").alias("value"))


def sensitivity_grid(spark, centre: dict[str, float], ranges: dict[str, tuple[float, float]], n: int) -> DataFrame:
    """(parameter, step, centre...): one parameter varied at a time, the others held."""
    rows = []
    for name, (low, high) in ranges.items():
        for i in range(n):
            at = dict(centre) | {name: low + (high - low) * i / max(1, n - 1)}
            rows.append((name, i, *[float(at[k]) for k in centre]))
    return spark.createDataFrame(rows, ", ".join(["parameter string", "step int", *[f"`{k}` double" for k in centre]]))

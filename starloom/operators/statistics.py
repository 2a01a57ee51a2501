"""Histograms, quantiles, covariances and robust scales on long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starloom.operators.ranks import even_part, quantiles, ranked, running_sum

#: Upper quartile of the normal distribution: scales a median absolute deviation to a sigma (fixed value).
NORMAL_QUARTILE = 0.6744897501960817


def histogram(df: DataFrame, column: str, edges: list[float], weight: str | None = None) -> DataFrame:
    """(bin, low, high, n): bins are half open, the last one closed; empty bins are kept."""
    x = F.col(column)
    index = sum(((x >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    inside = df.where((x >= edges[0]) & (x <= edges[-1])).groupBy(index.cast("int").alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    table = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    return F.broadcast(table).join(inside, "bin", "right").unionByName(table.join(inside, "bin", "left_anti").withColumn("n", F.lit(0).cast("long"))).select("bin", "low", "high", F.col("n").cast("long").alias("n"))


def quantile_split(df: DataFrame, column: str, n: int, label: str = "quantile") -> DataFrame:
    """``df`` with the number, from 0, of its quantile: edges interpolated, intervals closed above.

    Raises on equal edges, as bins would be lost.
    """
    inner = [i / n for i in range(1, n)]
    edges = quantiles(df, column, [0.0, *inner, 1.0]).select(F.col("quantiles").alias("_e"))
    clash = F.size(F.array_distinct("_e")) < n + 1
    edges = edges.select(F.when(clash, F.raise_error(F.lit("quantile edges are not distinct"))).otherwise(F.slice("_e", 2, n - 1)).alias("_e"))
    joined = df.crossJoin(F.broadcast(edges))
    index = F.aggregate("_e", F.lit(0), lambda a, e: a + (e < F.col(column)).cast("int"))
    return joined.withColumn(label, index).drop("_e")


def even_split_means(df: DataFrame, order: list, value: str, bins: int, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, bin, mean, n): rows in order dealt to bins of equal size, the first ones larger."""
    if group:
        placed = df.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*group).orderBy(*order)) - 1)
    else:
        placed = ranked(df, order).withColumn("bin", even_part(F.col("rank"), F.col("total"), bins))
    return placed.groupBy(*group, "bin").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def paired_covariance(rows: DataFrame, prefactor: float = 1.0, sample: str = "sample", feature: str = "feature", value: str = "value") -> DataFrame:
    """(f1, f2, cov): sample covariance of every two features, times ``prefactor``.

    The features of one sample are gathered in an array and paired there, so
    no table is joined with itself; each pair is aggregated with partial sums.
    """
    pack = rows.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(feature).alias("f"), F.col(value).alias("v")))).alias("fs"))
    first = pack.select("fs", F.explode("fs").alias("a")).select("a", F.explode("fs").alias("b"))
    return first.groupBy(F.col("a.f").alias("f1"), F.col("b.f").alias("f2")).agg((F.covar_samp("a.v", "b.v") * prefactor).alias("cov"))


def correlation_matrix(cov: DataFrame) -> DataFrame:
    """(f1, f2, corr): 0 where the covariance is 0."""
    diag = cov.where("f1 = f2")
    d1, d2 = diag.select("f1", F.col("cov").alias("c1")), diag.select("f2", F.col("cov").alias("c2"))
    return cov.join(d1, "f1").join(d2, "f2").select("f1", "f2", F.when(F.col("cov") == 0, 0.0).otherwise(F.col("cov") / F.sqrt(F.col("c1") * F.col("c2"))).alias("corr"))


def mad(df: DataFrame, value: str, group: tuple[str, ...]) -> DataFrame:
    """(group, mad): median absolute deviation as a normal sigma."""
    med = df.groupBy(*group).agg(F.median(value).alias("_m"))
    return df.join(med, list(group)).groupBy(*group).agg((F.median(F.abs(F.col(value) - F.col("_m"))) / NORMAL_QUARTILE).alias("mad"))


def gk_covariance(rows: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(f1, f2, cov): a quarter of the difference of squared scales of sums and differences."""
    med = rows.groupBy("feature").agg(F.median("value").alias("_m"))
    centred = rows.join(med, "feature").select("sample", "feature", (F.col("value") - F.col("_m")).alias("value"))
    pack = centred.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct(F.col("feature").alias("f"), F.col("value").alias("v")))).alias("fs"))
    pairs = pack.select("fs", F.explode("fs").alias("a")).select("a", F.explode("fs").alias("b"))
    pairs = pairs.select(F.col("a.f").alias("f1"), F.col("b.f").alias("f2"), (F.col("a.v") + F.col("b.v")).alias("p"), (F.col("a.v") - F.col("b.v")).alias("m"), F.col("a.v").alias("v"))
    meds = pairs.groupBy("f1", "f2").agg(F.median("p").alias("mp"), F.median("m").alias("mm"), F.median("v").alias("mv"))
    scales = pairs.join(meds, ["f1", "f2"]).groupBy("f1", "f2").agg(*[(F.median(F.abs(F.col(c) - F.col(f"m{c}"))) / NORMAL_QUARTILE).alias(f"s{c}") for c in ("p", "m", "v")])
    square = F.col("sv") * F.col("sv")
    return scales.select("f1", "f2", F.when(F.col("f1") == F.col("f2"), F.greatest(square, F.lit(eps))).otherwise((F.col("sp") * F.col("sp") - F.col("sm") * F.col("sm")) / 4).alias("cov"))


def ogk_covariance(rows: DataFrame, eps: float = 1e-12):
    """(features, matrix): orthogonalised robust covariance.

    Scales and pairwise terms are Spark aggregates; only the features-by-features
    matrix is decomposed on the driver.
    """
    import numpy as np

    root = eps**0.5
    scale = mad(rows, "value", ("feature",)).withColumn("mad", F.when(F.col("mad") > 0, F.col("mad")).otherwise(root))
    scaled = rows.join(scale, "feature").select("sample", "feature", (F.col("value") / F.col("mad")).alias("value"))
    terms = gk_covariance(scaled, eps).collect()  # features squared, set by the caller's schema
    names = sorted({t.f1 for t in terms})
    at = {f: i for i, f in enumerate(names)}
    u = np.eye(len(names))
    for t in terms:
        if t.f1 != t.f2:
            u[at[t.f1], at[t.f2]] = t.cov
    _, e = np.linalg.eigh((u + u.T) / 2)
    d = np.array([s.mad for s in sorted(scale.collect(), key=lambda s: s.feature)])
    turned = scaled.sparkSession.createDataFrame([(f, k, float(e[at[f], k])) for f in names for k in range(len(names))], "feature string, k int, load double")
    rotated = scaled.join(F.broadcast(turned), "feature").groupBy("sample", "k").agg(F.sum(F.col("value") * F.col("load")).alias("value"))
    g = np.array([max(r.mad, root) for r in sorted(mad(rotated, "value", ("k",)).collect(), key=lambda r: r.k)])
    a = d[:, None] * e
    return names, a @ np.diag(g**2) @ a.T


def emulator_scale(rows: DataFrame, method: str, residual: str = "residual", feature: str = "feature") -> DataFrame:
    """(feature, variance): diagonal emulator covariance by ``median``, ``mean`` or ``stdev``."""
    import math

    if method == "median":
        return mad(rows, residual, (feature,)).select(feature, (F.col("mad") * F.col("mad")).alias("variance"))
    if method == "mean":
        centre = rows.groupBy(feature).agg(F.avg(residual).alias("_m"))
        s = F.avg(F.abs(F.col(residual) - F.col("_m"))) * math.sqrt(math.pi / 2)
        return rows.join(centre, feature).groupBy(feature).agg((s * s).alias("variance"))
    if method == "stdev":
        return rows.groupBy(feature).agg(F.var_pop(residual).alias("variance"))
    raise ValueError(f"unknown method {method!r}")


def residual_covariance(rows: DataFrame, method: str) -> DataFrame:
    """(f1, f2, cov) of residuals (sample, feature, value): whole for ``cov``, ``gk`` and ``ogk``, diagonal for the methods of :func:`emulator_scale`."""
    if method == "cov":
        return paired_covariance(rows)
    if method == "gk":
        return gk_covariance(rows)
    if method == "ogk":
        names, matrix = ogk_covariance(rows)
        flat = [(a, b, float(matrix[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
        return rows.sparkSession.createDataFrame(flat, "f1 string, f2 string, cov double")
    return emulator_scale(rows, method, "value").select(F.col("feature").alias("f1"), F.col("feature").alias("f2"), F.col("variance").alias("cov"))


def block_diagonal(*covs: DataFrame) -> DataFrame:
    """(i, f1, f2, cov): blocks side by side; pairs of different blocks are absent, meaning 0."""
    out = None
    for i, c in enumerate(covs):
        part = c.select(F.lit(i).alias("block"), "f1", "f2", "cov")
        out = part if out is None else out.unionByName(part)
    return out


def debias(n_mocks: int, n_bins: int, n_params: int = 0, method: str = "percival") -> float:
    """Factor on a covariance estimated from few mocks."""
    s, d, p = n_mocks, n_bins, n_params
    if method == "hartlap":
        return (s - 1) / (s - d - 2)
    b = (s - d - 2) / ((s - d - 1) * (s - d - 4))
    if method == "percival":
        return (s - 1) * (1 + b * (d - p)) / (s - d + p - 1)
    if method == "percival-fisher":
        return (s - 1) / (s - d + p - 1)
    raise ValueError(f"unknown method {method!r}")


def sigma_clip(rows: DataFrame, sigma: float = 3.0, rounds: int = 5, sample: str = "sample", feature: str = "feature", value: str = "value") -> DataFrame:
    """(sample, outlier): flagged if any feature was clipped in up to ``rounds`` rounds.

    A round clips what lies beyond ``sigma`` population deviations of the
    median of what is still in; the plan is one chain, no data is collected.
    """
    kept = rows.withColumn("_in", F.lit(True))
    for _ in range(rounds):
        v = F.when(F.col("_in"), F.col(value))
        stats = kept.groupBy(feature).agg(F.median(v).alias("_m"), F.stddev_pop(v).alias("_s"))
        near = F.abs(F.col(value) - F.col("_m")) <= sigma * F.col("_s")
        kept = kept.join(F.broadcast(stats), feature).withColumn("_in", F.col("_in") & near).drop("_m", "_s")
    return kept.groupBy(sample).agg(F.bool_or(~F.col("_in")).alias("outlier"))


def ecdf(df: DataFrame, value: str, group: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the share of values, of the group, up to its own."""
    if group:
        return df.withColumn("cdf", F.cume_dist().over(Window.partitionBy(*group).orderBy(value)))
    heights = running_sum(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), value, "_n")
    return df.join(heights.select(F.col(value).alias("_v"), (F.col("sum") / F.col("total")).alias("cdf")), F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def islands(df: DataFrame, value: str, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, first, last): runs of consecutive integers."""
    rows = df.select(*group, value).distinct()
    if group:
        runs = rows.withColumn("_g", F.col(value) - F.row_number().over(Window.partitionBy(*group).orderBy(value)))
    else:
        runs = ranked(rows, [value], "_r", "_t").withColumn("_g", F.col(value) - F.col("_r"))
    return runs.groupBy(*group, "_g").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_g")


def significant_condition(matrix, digits: float = 10) -> int:
    """0: singular, nothing can be trusted; 1: well conditioned; 2: fewer than ``digits`` digits are left."""
    import numpy as np

    condition = np.linalg.cond(np.asarray(matrix, float))
    left = -np.log10(condition * np.finfo(float).eps) if np.isfinite(condition) else -np.inf
    return 0 if left <= 0 else 2 if left < digits else 1


def is_symmetric(matrix: DataFrame, tolerance: float = 1e-8) -> bool:
    """True if no (i, j, value) lacks its mirror image."""
    mirror = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("other"))
    off = matrix.join(mirror, ["i", "j"], "left").where(F.col("other").isNull() | (F.abs(F.col("value") - F.col("other")) > tolerance + 1e-5 * F.abs("other")))
    return off.isEmpty()


def is_positive_definite(matrix) -> bool:
    import numpy as np

    try:
        np.linalg.cholesky(np.asarray(matrix, float))
    except np.linalg.LinAlgError:
        return False
    return True

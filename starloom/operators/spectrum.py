"""Power spectra by direct sums and by gridded transforms, angular correlations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.spatial import cell_pairs


def half_modes(n: int) -> list[tuple[int, int, int]]:
    """One of every two opposite wave vectors with components up to ``n``."""
    span = range(-n, n + 1)
    return [(a, b, c) for a in span for b in span for c in span if (a, b, c) > (0, 0, 0)]


def fourier_modes(points: DataFrame, n: int, box: float, weight: str = "w") -> DataFrame:
    """(nx, ny, nz, re, im): sums over points; a few modes per point, summed before the shuffle."""
    modes = F.array(*[F.struct(*[F.lit(v).alias(f"n{c}") for v, c in zip(m, "xyz", strict=True)]) for m in half_modes(n)])
    rows = points.select("x", "y", "z", F.col(weight).alias("w"), F.explode(modes).alias("m")).select("x", "y", "z", "w", "m.*")
    phase = F.lit(2 * math.pi) * (F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z")) / float(box)
    return rows.groupBy("nx", "ny", "nz").agg(F.sum(F.col("w") * F.cos(phase)).alias("re"), F.sum(F.col("w") * F.sin(phase)).alias("im"))


def direct_power(points: DataFrame, n: int, box: float, weight: str = "w") -> DataFrame:
    """(n2, modes, p0, p2) by squared mode number, line of sight along z."""
    w = F.col(weight)
    totals = points.agg(F.sum(w).alias("_sw"), F.sum(w * w).alias("_sw2"))
    n2 = F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im") - F.col("_sw2")) / (F.col("_sw") * F.col("_sw")) * F.lit(float(box) ** 3)
    rows = fourier_modes(points, n, box, weight).crossJoin(F.broadcast(totals)).select(n2.alias("n2"), power.alias("p"), (F.col("nz") * F.col("nz") / n2).alias("mu2"))
    return rows.groupBy("n2").agg(F.count(F.lit(1)).alias("modes"), F.avg("p").alias("p0"), (5 * F.avg(F.col("p") * (3 * F.col("mu2") - 1) / 2)).alias("p2"))


def grid_power(mesh: DataFrame, cells: int, box: float, bins: int) -> DataFrame:
    """(bin, modes, p0) of a contrast mesh by a pencil transform.

    Planes are transformed together, then pencils across them: each task holds
    one plane or one pencil, never the mesh.
    """
    import numpy as np
    import pandas as pd

    def planes(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((cells, cells))
        a[frame["iy"], frame["iz"]] = frame["value"]
        f = np.fft.fft2(a)
        y, z = np.meshgrid(np.arange(cells), np.arange(cells), indexing="ij")
        return pd.DataFrame({"ix": int(frame["ix"].iloc[0]), "ky": y.ravel(), "kz": z.ravel(), "re": f.real.ravel(), "im": f.imag.ravel()})

    def pencils(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(cells, complex)
        a[frame["ix"]] = frame["re"] + 1j * frame["im"]
        f = np.fft.fft(a)
        power = np.abs(f) ** 2 * box**3 / float(cells) ** 6
        return pd.DataFrame({"kx": np.arange(cells), "ky": int(frame["ky"].iloc[0]), "kz": int(frame["kz"].iloc[0]), "p": power})

    first = mesh.groupBy("ix").applyInPandas(planes, "ix int, ky int, kz int, re double, im double")
    modes = first.groupBy("ky", "kz").applyInPandas(pencils, "kx int, ky int, kz int, p double")

    def signed(c):
        return F.when(F.col(c) <= cells // 2, F.col(c)).otherwise(F.col(c) - cells)

    k2 = signed("kx") * signed("kx") + signed("ky") * signed("ky") + signed("kz") * signed("kz")
    return modes.select(F.floor(F.sqrt(k2)).cast("int").alias("bin"), "p", k2.alias("k2")).where((F.col("k2") > 0) & (F.col("bin") < bins)).groupBy("bin").agg(F.count(F.lit(1)).alias("modes"), F.avg("p").alias("p0"))


def triangles(modes: DataFrame, box: float) -> DataFrame:
    """(k1, k2, k3, n, b): products of three modes that close, by squared mode numbers.

    ``modes`` holds both of every two opposite vectors.
    """
    def side(i):
        return modes.select(*[F.col(f"n{c}").alias(f"{c}{i}") for c in "xyz"], F.col("re").alias(f"r{i}"), F.col("im").alias(f"i{i}"), (F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")).alias(f"k{i}"))

    two = side(1).crossJoin(F.broadcast(side(2)))  # a few dozen modes, by construction
    closed = two.join(side(3), [F.col(f"{c}3") == -(F.col(f"{c}1") + F.col(f"{c}2")) for c in "xyz"]).where("k1 <= k2 and k2 <= k3")
    re12, im12 = F.col("r1") * F.col("r2") - F.col("i1") * F.col("i2"), F.col("r1") * F.col("i2") + F.col("i1") * F.col("r2")
    return closed.groupBy("k1", "k2", "k3").agg(F.count(F.lit(1)).alias("n"), F.avg(re12 * F.col("r3") - im12 * F.col("i3")).alias("b"))


def angular_correlation(rows: DataFrame, reach: float, width: float) -> DataFrame:
    """(bin, n, kk): sums of kappa products of pixel pairs by separation in degrees.

    Directions a, b, c become points of the unit sphere, where an angle is a
    chord: the same cell lists serve, without periodic images.
    """
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    unit = rows.where(norm > 0).select("id", "kappa", *[(F.col(s) / norm + 1).alias(c) for s, c in zip("abc", "xyz", strict=True)], *[(F.col(s) / norm).alias(f"u{c}") for s, c in zip("abc", "xyz", strict=True)])
    chord = 2 * math.sin(math.radians(reach) / 2) * (1 + 1e-9) + 1e-9
    pairs = cell_pairs(unit, None, chord, 2.0 + 1e-6, periodic=False, keep=("kappa", "ux", "uy", "uz"))
    dot = F.col("a_ux") * F.col("b_ux") + F.col("a_uy") * F.col("b_uy") + F.col("a_uz") * F.col("b_uz")
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))
    found = pairs.select(angle.alias("t"), (F.col("a_kappa") * F.col("b_kappa")).alias("kk")).where(F.col("t") < reach)
    return found.groupBy(F.floor(F.col("t") / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("kk").cast("long").alias("kk"))

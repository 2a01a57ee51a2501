"""Fourier transforms of meshes and what is done between them: filters, multipliers, power multipoles.

Meshes and their transforms are long tables (ix, iy, iz, re, im); absent cells
are 0. Planes are transformed together, then pencils across them: each task
holds one plane or one pencil, never the mesh.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators import mesh as meshes
from starloom.operators.correlation import legendre

#: Order of the splines that share points among cells.
ORDER = {"ngp": 1, "cic": 2, "tsc": 3, "pcs": 4}


def transform(mesh: DataFrame, cells: int, inverse: bool = False) -> DataFrame:
    """(ix, iy, iz, re, im): the discrete transform, or the inverse one, which divides by the number of cells.

    A mesh with ``value`` in place of ``re`` and ``im`` is real.
    """
    import numpy as np
    import pandas as pd

    if "re" not in mesh.columns:
        mesh = mesh.select("ix", "iy", "iz", F.col("value").cast("double").alias("re"), F.lit(0.0).alias("im"))
    plane, line = (np.fft.ifft2, np.fft.ifft) if inverse else (np.fft.fft2, np.fft.fft)

    def planes(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((cells, cells), complex)
        a[frame["iy"], frame["iz"]] = frame["re"] + 1j * frame["im"]
        f = plane(a)
        y, z = np.meshgrid(np.arange(cells), np.arange(cells), indexing="ij")
        return pd.DataFrame({"ix": int(frame["ix"].iloc[0]), "iy": y.ravel(), "iz": z.ravel(), "re": f.real.ravel(), "im": f.imag.ravel()})

    def pencils(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(cells, complex)
        a[frame["ix"]] = frame["re"] + 1j * frame["im"]
        f = line(a)
        return pd.DataFrame({"ix": np.arange(cells), "iy": int(frame["iy"].iloc[0]), "iz": int(frame["iz"].iloc[0]), "re": f.real, "im": f.imag})

    schema = "ix int, iy int, iz int, re double, im double"
    return mesh.groupBy("ix").applyInPandas(planes, schema).groupBy("iy", "iz").applyInPandas(pencils, schema)


def number(axis: str, cells: int) -> Column:
    """Signed mode number along an axis; the middle one of an even mesh is positive."""
    i = F.col(f"i{axis}")
    return F.when(i <= cells // 2, i).otherwise(i - cells)


def wave(axis: str, cells: int, box: float) -> Column:
    return number(axis, cells) * (2 * math.pi / box)


def k_squared(cells: int, box: float) -> Column:
    return sum((wave(c, cells, box) * wave(c, cells, box) for c in "yz"), wave("x", cells, box) * wave("x", cells, box))


def gaussian(k2: Column, radius: float) -> Column:
    return F.exp(-k2 * (radius * radius / 2))


def top_hat(k2: Column, radius: float) -> Column:
    x = F.sqrt(k2) * radius
    return F.when(k2 == 0, 1.0).otherwise(3 * (F.sin(x) / (x * x * x) - F.cos(x) / (x * x)))


def filtered(modes: DataFrame, weight: Column) -> DataFrame:
    """Modes times a real weight."""
    return modes.select("ix", "iy", "iz", (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im"))


def smooth(mesh: DataFrame, cells: int, box: float, radius: float, kind: str = "gaussian") -> DataFrame:
    """(ix, iy, iz, value): smoothed in Fourier space."""
    weight = {"gaussian": gaussian, "top_hat": top_hat}[kind](k_squared(cells, box), radius)
    return transform(filtered(transform(mesh, cells), weight), cells, inverse=True).select("ix", "iy", "iz", F.col("re").alias("value"))


def gradient(modes: DataFrame, axis: str, cells: int, box: float, bias: float = 1.0) -> DataFrame:
    """Modes times -i k / bias along an axis."""
    k = wave(axis, cells, box) / bias
    return modes.select("ix", "iy", "iz", (F.col("im") * k).alias("re"), (-F.col("re") * k).alias("im"))


def inverse_laplacian(modes: DataFrame, cells: int, box: float) -> DataFrame:
    """Modes over k squared, 0 for the mean."""
    k2 = k_squared(cells, box)
    return filtered(modes, F.when(k2 == 0, 0.0).otherwise(1 / F.when(k2 == 0, 1.0).otherwise(k2)))


def normalised(modes: DataFrame, norm: DataFrame) -> DataFrame:
    """Modes times the value of the same place in ``norm``."""
    return filtered(modes.join(norm.select("ix", "iy", "iz", F.col("value").alias("_n")), ["ix", "iy", "iz"]), F.col("_n"))


def displacement(mesh: DataFrame, cells: int, box: float, bias: float = 1.0) -> dict[str, DataFrame]:
    """The three components of the field whose divergence is the contrast over ``bias``, as meshes."""
    potential = inverse_laplacian(transform(mesh, cells), cells, box)
    return {c: transform(gradient(potential, c, cells, box, bias), cells, inverse=True).select("ix", "iy", "iz", F.col("re").alias("value")) for c in "xyz"}


def compensation(kind: str, cells: int) -> Column:
    """What painting multiplied each mode by: a power of the sinc of each axis."""
    out = F.lit(1.0)
    for c in "xyz":
        x = number(c, cells) * (math.pi / cells)
        sinc = F.when(x == 0, 1.0).otherwise(F.sin(x) / F.when(x == 0, 1.0).otherwise(x))
        out = out * F.pow(sinc, F.lit(float(ORDER[kind])))
    return out


def painted_modes(points: DataFrame, cells: int, cell: int, kind: str = "tsc", weight: str | None = "w", interlace: bool = True) -> DataFrame:
    """Modes of the contrast of points, compensated; interlaced with a mesh shifted by half a cell, which takes odd images out.

    Even cell sizes only, since positions are integers.
    """
    box = float(cells * cell)

    def modes(rows: DataFrame) -> DataFrame:
        return transform(meshes.contrast(meshes.paint(rows, cells, cell, kind, weight), cells), cells)

    here = modes(points)
    if interlace:
        half = cell // 2
        there = modes(points.withColumns({c: F.pmod(F.col(c) + half, F.lit(cells * cell)) for c in "xyz"}))
        there = there.toDF("ix", "iy", "iz", "_re", "_im")
        turn = sum((wave(c, cells, box) for c in "yz"), wave("x", cells, box)) * float(half)
        re = F.col("_re") * F.cos(turn) - F.col("_im") * F.sin(turn)
        im = F.col("_re") * F.sin(turn) + F.col("_im") * F.cos(turn)
        here = here.join(there, ["ix", "iy", "iz"]).select("ix", "iy", "iz", ((F.col("re") + re) / 2).alias("re"), ((F.col("im") + im) / 2).alias("im"))
    return filtered(here, 1 / compensation(kind, cells))


def multipoles(a: DataFrame, b: DataFrame | None, cells: int, box: float, bins: int, *, shot: float = 0.0, keys: tuple[str, ...] = (), ells: tuple[int, ...] = (0, 2, 4)) -> DataFrame:
    """(keys, bin, modes, p0, p2, p4): power of one field, or of two, by whole mode numbers; line of sight along z.

    ``keys`` are columns of ``a`` (such as a quantile), each with a power of its own.
    """
    place = ["ix", "iy", "iz"]
    if b is None:
        rows = a.withColumn("p", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    else:
        other = b.select(*place, F.col("re").alias("_re"), F.col("im").alias("_im"))
        rows = a.join(other, place).withColumn("p", F.col("re") * F.col("_re") + F.col("im") * F.col("_im"))
    n2 = sum((number(c, cells) * number(c, cells) for c in "yz"), number("x", cells) * number("x", cells))
    power = F.col("p") * (box**3 / float(cells) ** 6) - shot
    rows = rows.select(*keys, n2.alias("n2"), power.alias("p"), number("z", cells).alias("nz")).where("n2 > 0")
    rows = rows.withColumn("mu", F.col("nz") / F.sqrt("n2")).withColumn("bin", F.floor(F.sqrt("n2")).cast("int")).where(F.col("bin") < bins)
    return rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("modes"), *[((2 * ell + 1) * F.avg(F.col("p") * legendre(ell, F.col("mu")))).alias(f"p{ell}") for ell in ells])


def quantile_modes(points: DataFrame, n: int, box: float, key: str, weight: str | None = None) -> DataFrame:
    """(key, nx, ny, nz, re, im, size): direct sums of the contrast of each group of points, divided by their weight."""
    from starloom.operators.spectrum import half_modes

    modes = F.array(*[F.struct(*[F.lit(v).alias(f"n{c}") for v, c in zip(m, "xyz", strict=True)]) for m in half_modes(n)])
    w = F.col(weight) if weight else F.lit(1)
    rows = points.select(key, "x", "y", "z", w.alias("w"), F.explode(modes).alias("m")).select(key, "x", "y", "z", "w", "m.*")
    phase = (2 * math.pi / box) * (F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z"))
    size = F.sum("w")
    return rows.groupBy(key, "nx", "ny", "nz").agg((F.sum(F.col("w") * F.cos(phase)) / size).alias("re"), (F.sum(F.col("w") * F.sin(phase)) / size).alias("im"), size.alias("size"))


def group_power(modes: DataFrame, other: DataFrame | None, box: float, key: str) -> DataFrame:
    """(key, n2, modes, p0, p2): power of each group with itself, less its shot noise, or with another field's modes."""
    if other is None:
        p = F.col("re") * F.col("re") + F.col("im") * F.col("im") - 1 / F.col("size")
        rows = modes.withColumn("p", p)
    else:
        second = other.select("nx", "ny", "nz", F.col("re").alias("_re"), F.col("im").alias("_im"))
        rows = modes.join(second, ["nx", "ny", "nz"]).withColumn("p", F.col("re") * F.col("_re") + F.col("im") * F.col("_im"))
    n2 = F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")
    rows = rows.withColumn("n2", n2).withColumn("mu", F.col("nz") / F.sqrt("n2")).withColumn("p", F.col("p") * box**3)
    return rows.groupBy(key, "n2").agg(F.count(F.lit(1)).alias("modes"), F.avg("p").alias("p0"), (5 * F.avg(F.col("p") * legendre(2, F.col("mu")))).alias("p2"))

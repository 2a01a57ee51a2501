"""Queries in Fourier space: filters, multipliers, power of fields and of density quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import kspace, mesh, spectrum
from starloom.plans.fields import CELL, DELTA, EDGES, LATTICE, N, QUERY, ROUNDED, SPLIT, _kernel_sql, _split, painted
from starloom.plans.views import GALAXIES, query
from starloom.sources.points import BOX, galaxies

FIELD = f"{GALAXIES}, {painted('rho', 'galaxies')}, {LATTICE}"


def _rho(spark, sf_dir):
    return mesh.paint(galaxies(spark, sf_dir), N, CELL)


@query(
    f"""with {FIELD}, {_kernel_sql()},
f as (select ix, iy, iz, coalesce(value, 0) as value from lattice left join rho using (ix, iy, iz)),
sx as (select cast((ix + j) % 20 as integer) as ix, iy, iz, sum(value * g) as value from f, kern group by all),
sy as (select ix, cast((iy + j) % 20 as integer) as iy, iz, sum(value * g) as value from sx, kern group by all)
select ix, iy, cast((iz + j) % 20 as integer) as iz, round(sum(value * g), 6) as value from sy, kern group by all"""
)
def fourier_smoothing(spark, sf_dir):
    """Gaussian smoothing by transforms there and back."""
    return kspace.smooth(_rho(spark, sf_dir), N, float(BOX), 60.0).withColumn("value", F.round("value", 6))


MODES = """low as (select cast(a as integer) as ix, cast(b as integer) as iy, cast(c as integer) as iz from range(3) t(a), range(3) u(b), range(3) v(c)),
modes as (select m.ix, m.iy, m.iz, sum(value * cos(2 * pi() * (m.ix * f.ix + m.iy * f.iy + m.iz * f.iz) / 20)) as re, -sum(value * sin(2 * pi() * (m.ix * f.ix + m.iy * f.iy + m.iz * f.iz) / 20)) as im from delta f, low m group by all)"""
K = "(2 * pi() / 1000)"


@query(f"with {FIELD}, {DELTA}, {MODES} select ix, iy, iz, round(im * ix * {K} / 2, 6) as re, round(-re * ix * {K} / 2, 6) as im from modes")
def gradient_modes(spark, sf_dir):
    """The lowest modes of a gradient along x, over a bias."""
    modes = kspace.transform(mesh.contrast(_rho(spark, sf_dir), N), N)
    out = kspace.gradient(modes, "x", N, float(BOX), 2.0).where("ix < 3 and iy < 3 and iz < 3")
    return out.select("ix", "iy", "iz", F.round("re", 6).alias("re"), F.round("im", 6).alias("im"))


@query(f"with {FIELD}, {DELTA}, {MODES} select ix, iy, iz, round(case when ix + iy + iz = 0 then 0 else re / ((ix * ix + iy * iy + iz * iz) * {K} * {K}) end, 3) as re, round(case when ix + iy + iz = 0 then 0 else im / ((ix * ix + iy * iy + iz * iz) * {K} * {K}) end, 3) as im from modes")
def potential_modes(spark, sf_dir):
    """The lowest modes of an inverse Laplacian."""
    modes = kspace.transform(mesh.contrast(_rho(spark, sf_dir), N), N)
    out = kspace.inverse_laplacian(modes, N, float(BOX)).where("ix < 3 and iy < 3 and iz < 3")
    return out.select("ix", "iy", "iz", F.round("re", 3).alias("re"), F.round("im", 3).alias("im"))


@query(f"with {FIELD}, {DELTA}, {MODES} select ix, iy, iz, round(re * (1 + ix + 2 * iy + 3 * iz), 5) as re, round(im * (1 + ix + 2 * iy + 3 * iz), 5) as im from modes")
def normalised_modes(spark, sf_dir):
    """Modes times a table of factors."""
    modes = kspace.transform(mesh.contrast(_rho(spark, sf_dir), N), N)
    norm = mesh.full(_rho(spark, sf_dir), N).select("ix", "iy", "iz", (1.0 + F.col("ix") + 2 * F.col("iy") + 3 * F.col("iz")).alias("value"))
    out = kspace.normalised(modes, norm).where("ix < 3 and iy < 3 and iz < 3")
    return out.select("ix", "iy", "iz", F.round("re", 5).alias("re"), F.round("im", 5).alias("im"))


HALF = "half as (select cast(a as integer) as nx, cast(b as integer) as ny, cast(c as integer) as nz from range(-2, 3) t(a), range(-2, 3) u(b), range(-2, 3) v(c) where (a, b, c) > (0, 0, 0))"
PHASE = "2 * pi() * (nx * x + ny * y + nz * z) / 1000"
QMODES = f"qmodes as (select quantile, nx, ny, nz, sum(cos({PHASE})) / count(*) as re, sum(sin({PHASE})) / count(*) as im, count(*) as size from (select * from points join split using (id)), half group by all)"
SPLITS = f"{FIELD}, {DELTA}, {QUERY}, {ROUNDED}, {EDGES}, {SPLIT}, {HALF}, {QMODES}"
POLES = "round(avg(p), 3) as p0, round(5 * avg(p * (3.0 * nz * nz / (nx * nx + ny * ny + nz * nz) - 1) / 2), 3) as p2"


@query(f"with {SPLITS}, g as (select nx, ny, nz, sum(w * cos({PHASE})) / sum(w) as gre, sum(w * sin({PHASE})) / sum(w) as gim from galaxies, half group by all), r as (select *, (re * gre + im * gim) * 1e9 as p from qmodes join g using (nx, ny, nz)) select quantile, nx * nx + ny * ny + nz * nz as n2, count(*) as modes, {POLES} from r group by 1, 2")
def quantile_cross_power(spark, sf_dir):
    """Cross power of each density quantile with the catalog."""
    modes = kspace.quantile_modes(_split(spark, sf_dir), 2, float(BOX), "quantile")
    data = kspace.quantile_modes(galaxies(spark, sf_dir).withColumn("_g", F.lit(0)), 2, float(BOX), "_g", "w")
    out = kspace.group_power(modes, data, float(BOX), "quantile")
    return out.select("quantile", "n2", "modes", F.round("p0", 3).alias("p0"), F.round("p2", 3).alias("p2"))


@query(f"with {SPLITS}, r as (select *, (re * re + im * im - 1.0 / size) * 1e9 as p from qmodes) select quantile, nx * nx + ny * ny + nz * nz as n2, count(*) as modes, {POLES} from r group by 1, 2")
def quantile_auto_power(spark, sf_dir):
    """Auto power of each density quantile, shot noise taken off."""
    out = kspace.group_power(kspace.quantile_modes(_split(spark, sf_dir), 2, float(BOX), "quantile"), None, float(BOX), "quantile")
    return out.select("quantile", "n2", "modes", F.round("p0", 3).alias("p0"), F.round("p2", 3).alias("p2"))


@query()
def mesh_power_multipoles(spark, sf_dir):
    """Multipoles 0, 2, 4 of the interlaced, compensated mesh, shot noise taken off (A28, M2, M8); held against direct sums in the tests."""
    points = galaxies(spark, sf_dir)
    modes = kspace.painted_modes(points, N, CELL, "tsc")
    w = points.agg((F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), F.lit(2))).alias("s")).first()["s"] or 0.0
    return kspace.multipoles(modes, None, N, float(BOX), 8, shot=float(w) * float(BOX) ** 3)

"""Mesh and density-split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.operators import correlation, mesh, statistics
from starloom.plans.views import GALAXIES, RANDOMS, differences, query
from starloom.sources.points import BOX, galaxies, hashed_points, lattice, randoms
from starloom.sources.shared import cut_lineage

N, CELL = 20, 50
CORNERS = "(select * from (values (0), (1)) cx(a)), (select * from (values (0), (1)) cy(b)), (select * from (values (0), (1)) cz(c))"


def share(x: str, c: str) -> str:
    return f"(case {c} when 0 then 50 - ({x} % 50) else {x} % 50 end)"


def painted(name: str, source: str) -> str:
    return f"""{name} as (select cast((x // 50 + a) % 20 as integer) as ix, cast((y // 50 + b) % 20 as integer) as iy, cast((z // 50 + c) % 20 as integer) as iz,
    cast(sum(w * {share('x', 'a')} * {share('y', 'b')} * {share('z', 'c')}) as double) / 125000.0 as value
  from {source}, {CORNERS} where {share('x', 'a')} * {share('y', 'b')} * {share('z', 'c')} <> 0 group by all)"""


LATTICE = "lattice as (select cast(i as integer) as ix, cast(j as integer) as iy, cast(k as integer) as iz from range(20) a(i), range(20) b(j), range(20) c(k))"
DELTA = "delta as (select ix, iy, iz, coalesce(value, 0) / (select sum(value) / 8000.0 from rho) - 1 as value from lattice left join rho using (ix, iy, iz))"
QUERY = "points as (select i as id, (i * 7919 + (i % 97) * 331 + 42) % 1000 as x, (i * 104729 + (i % 89) * 617 + 42) % 1000 as y, (i * 15485863 + (i % 83) * 233 + 42) % 1000 as z from (select unnest(range((select 5 * count(*) from galaxies))) as i))"
READ = f"""readout as (select id, sum({share('x', 'a')} * {share('y', 'b')} * {share('z', 'c')} * value) / 125000.0 as delta
  from (select *, cast((x // 50 + a) % 20 as integer) as ix, cast((y // 50 + b) % 20 as integer) as iy, cast((z // 50 + c) % 20 as integer) as iz from points, {CORNERS}) join delta using (ix, iy, iz) group by id)"""


@query(f"with {GALAXIES}, {painted('rho', 'galaxies')} select ix, iy, iz, value from rho")
def mesh_cic_paint(spark, sf_dir):
    """Weights shared among eight corners, periodic (M1)."""
    return mesh.paint(galaxies(spark, sf_dir), N, CELL)


@query(f"with {GALAXIES} select cast(x // 50 as integer) as ix, cast(y // 50 as integer) as iy, cast(z // 50 as integer) as iz, cast(sum(w) as double) as value from galaxies group by all")
def mesh_ngp_paint(spark, sf_dir):
    """Weights in the nearest cell (M2)."""
    return mesh.paint(galaxies(spark, sf_dir), N, CELL, "ngp")


def _tsc(x: str, k: str) -> str:
    u = f"(2 * ({x} % 50) - 50)"
    return f"(case {k} when -1 then (50 - {u}) * (50 - {u}) when 0 then 15000 - 2 * {u} * {u} else (50 + {u}) * (50 + {u}) end)"


@query(
    f"""with {GALAXIES}, o as (select * from (values (-1), (0), (1)) t(k))
select cast((x // 50 + a.k + 20) % 20 as integer) as ix, cast((y // 50 + b.k + 20) % 20 as integer) as iy, cast((z // 50 + c.k + 20) % 20 as integer) as iz,
  round(cast(sum(cast(w as hugeint) * {_tsc('x', 'a.k')} * {_tsc('y', 'b.k')} * {_tsc('z', 'c.k')}) as double) / 8000000000000.0, 9) as value
from galaxies, o a, o b, o c where {_tsc('x', 'a.k')} * {_tsc('y', 'b.k')} * {_tsc('z', 'c.k')} <> 0 group by all"""
)
def mesh_tsc_paint(spark, sf_dir):
    """Quadratic-spline shares of 27 cells (M2)."""
    out = mesh.paint(galaxies(spark, sf_dir), N, CELL, "tsc")
    return out.withColumn("value", F.round("value", 9))


@query(f"with {GALAXIES}, {painted('rho', 'galaxies')}, {LATTICE}, {DELTA} select ix, iy, iz, round(value, 9) as value from delta")
def density_contrast(spark, sf_dir):
    """Contrast against the mean of all cells, empty ones included."""
    return mesh.contrast(mesh.paint(galaxies(spark, sf_dir), N, CELL), N).withColumn("value", F.round("value", 9))


@query(
    f"""with {GALAXIES}, {RANDOMS}, {painted('rho', 'galaxies')}, {painted('ran', 'randoms')}, {LATTICE},
al as (select (select sum(value) from rho) / (select sum(value) from ran) as a, (select 0.5 * sum(w) / 8000.0 from randoms) as thr)
select l.ix, l.iy, l.iz, round(case when coalesce(r.value, 0) > thr then (coalesce(d.value, 0) - a * r.value) / (a * r.value) else 0 end, 8) as value
from lattice l left join rho d using (ix, iy, iz) left join ran r using (ix, iy, iz), al"""
)
def survey_contrast(spark, sf_dir):
    """Contrast of data against scaled randoms, 0 where randoms are few (M4, M5)."""
    rand = randoms(spark, sf_dir)
    threshold = mesh.random_threshold(rand, 0.5, "mean", N)
    out = mesh.survey_contrast(mesh.paint(galaxies(spark, sf_dir), N, CELL), mesh.paint(rand, N, CELL), threshold, N)
    return out.withColumn("value", F.round("value", 8))


def _kernel_sql() -> str:
    values = ", ".join(f"({j}, {w!r})" for j, w in enumerate(mesh.gaussian_weights(N, CELL, 60.0)))
    return f"kern as (select * from (values {values}) t(j, g))"


@query(
    f"""with {GALAXIES}, {painted('rho', 'galaxies')}, {LATTICE}, {_kernel_sql()},
f as (select ix, iy, iz, coalesce(value, 0) as value from lattice left join rho using (ix, iy, iz)),
sx as (select cast((ix + j) % 20 as integer) as ix, iy, iz, sum(value * g) as value from f, kern group by all),
sy as (select ix, cast((iy + j) % 20 as integer) as iy, iz, sum(value * g) as value from sx, kern group by all)
select ix, iy, cast((iz + j) % 20 as integer) as iz, round(sum(value * g), 6) as value from sy, kern group by all"""
)
def mesh_smoothing(spark, sf_dir):
    """Gaussian smoothing in Fourier space as three circular convolutions."""
    return mesh.smooth(mesh.paint(galaxies(spark, sf_dir), N, CELL), N, CELL, 60.0).withColumn("value", F.round("value", 6))


@query(f"with {GALAXIES}, {painted('rho', 'galaxies')}, {LATTICE}, {DELTA}, {QUERY}, {READ} select id, round(delta, 8) as value from readout")
def mesh_readout(spark, sf_dir):
    """The contrast at scattered points."""
    delta = mesh.contrast(mesh.paint(galaxies(spark, sf_dir), N, CELL), N)
    return mesh.readout(delta, query_points(spark, sf_dir), N, CELL).withColumn("value", F.round("value", 8))


@query("select cast(i * 400 + j * 20 + k as bigint) as id, cast(i as integer) as ix, cast(j as integer) as iy, cast(k as integer) as iz, (i + 0.5) * 50 as x, (j + 0.5) * 50 as y, (k + 0.5) * 50 as z from range(20) a(i), range(20) b(j), range(20) c(k)".replace("(i + 0.5) * 50", "cast((i + 0.5) * 50 as double)").replace("(j + 0.5) * 50", "cast((j + 0.5) * 50 as double)").replace("(k + 0.5) * 50", "cast((k + 0.5) * 50 as double)"))
def lattice_points(spark, sf_dir):
    """Cell centres with their indices."""
    return lattice(spark, N, CELL)


def query_points(spark, sf_dir):
    """Five scattered points for each galaxy."""
    return hashed_points(spark, 5 * galaxies(spark, sf_dir).count())


EDGES = "edges as (select quantile_cont(delta, [0.2, 0.4, 0.6, 0.8]) as e from readout)"
SPLIT = "split as (select id, delta, cast((delta > e[1])::int + (delta > e[2])::int + (delta > e[3])::int + (delta > e[4])::int as integer) as quantile from readout, edges)"


def _split(spark, sf_dir):
    delta = mesh.contrast(mesh.paint(galaxies(spark, sf_dir), N, CELL), N)
    points = query_points(spark, sf_dir)
    read = mesh.readout(delta, points, N, CELL).withColumnRenamed("value", "delta")
    return statistics.quantile_split(read.withColumn("delta", F.round("delta", 9)), "delta", 5).join(points, "id")


def _points_split(spark, sf_dir):
    """(quantile, x, y, z) of the query points, written down as it is read several times."""
    return cut_lineage(_split(spark, sf_dir).select("quantile", "x", "y", "z"), "split")


ROUNDED = READ.replace("sum(" + share("x", "a"), "round(sum(" + share("x", "a")).replace("/ 125000.0 as delta", "/ 125000.0, 9) as delta")


@query(f"with {GALAXIES}, {painted('rho', 'galaxies')}, {LATTICE}, {DELTA}, {QUERY}, {ROUNDED}, {EDGES}, {SPLIT} select quantile, count(*) as n, min(delta) as low, max(delta) as high from split group by quantile")
def density_quantiles(spark, sf_dir):
    """Quantile split of densities at query points."""
    return _split(spark, sf_dir).groupBy("quantile").agg(F.count(F.lit(1)).alias("n"), F.min("delta").alias("low"), F.max("delta").alias("high"))


DS = "cast(floor(sqrt(dx * dx + dy * dy + dz * dz) / 5) as integer)"
DSMU = "cast(least(floor(case when dx * dx + dy * dy + dz * dz = 0 then 0.0 else abs(dz) * 5 / sqrt(dx * dx + dy * dy + dz * dz) end), 4) as integer)"


@query(
    f"""with {GALAXIES}, {painted('rho', 'galaxies')}, {LATTICE}, {DELTA}, {QUERY}, {ROUNDED}, {EDGES}, {SPLIT},
c as (select quantile, {DS} as i_s, {DSMU} as i_mu, count(*) as n from (select quantile, {differences('p', 'g')} from (select * from points join split using (id)) p, galaxies g) where dx * dx + dy * dy + dz * dz < 2500 group by all),
grid as (select cast(q as integer) as quantile, cast(i as integer) as i_s, cast(j as integer) as i_mu from range(5) r(q), range(10) t(i), range(5) u(j)),
nq as (select quantile, count(*) as nq from split group by quantile),
xi as (select quantile, i_s, i_mu, coalesce(n, 0) / (nq * (select count(*) from galaxies) * (4.0 / 3.0 * pi() * ((i_s * 5.0 + 5) ^ 3 - (i_s * 5.0) ^ 3)) / 1e9 / 5) - 1 as xi from grid left join c using (quantile, i_s, i_mu) join nq using (quantile))
select quantile, i_s, round(sum(xi) / 5, 6) as xi_0, round(5 * sum(xi * (3 * ((i_mu + 0.5) / 5) * ((i_mu + 0.5) / 5) - 1) / 2) / 5, 6) as xi_2 from xi group by all"""
)
def density_split_cross(spark, sf_dir):
    """Multipoles of each density quantile with the catalog: the flagship."""
    split, points = _points_split(spark, sf_dir), galaxies(spark, sf_dir)
    counts = correlation.complete(correlation.count_smu(split, points, 5, 10, 5, BOX, group=("quantile",), moved="right"), quantile=5, i_s=10, i_mu=5)
    sizes = split.groupBy("quantile").agg(F.count(F.lit(1)).alias("nq"))
    total = points.agg(F.count(F.lit(1)).alias("ng"))
    both = counts.join(F.broadcast(sizes), "quantile").crossJoin(F.broadcast(total))
    xi = both.select("quantile", "i_s", "i_mu", correlation.natural(F.col("n"), correlation.rr_smu((F.col("nq") * F.col("ng")).cast("double"), BOX, 5, 5)).alias("xi"))
    mu = (F.col("i_mu") + 0.5) / 5
    return xi.groupBy("quantile", "i_s").agg(*[F.round((2 * ell + 1) * F.sum(F.col("xi") * correlation.legendre(ell, mu)) / 5, 6).alias(f"xi_{ell}") for ell in (0, 2)])


@query(
    f"""with {GALAXIES}, {painted('rho', 'galaxies')}, {LATTICE}, {DELTA}, {QUERY}, {ROUNDED}, {EDGES}, {SPLIT},
p as (select * from points join split using (id))
select quantile, {DS} as i_s, count(*) as n from (select a.quantile, {differences()} from p a join p b on a.quantile = b.quantile and a.id < b.id) where dx * dx + dy * dy + dz * dz < 10000 and {DS} < 20 group by all"""
)
def density_split_auto(spark, sf_dir):
    """Auto counts within each density quantile."""
    counts = correlation.count_smu(_points_split(spark, sf_dir), None, 5, 20, 1, BOX, group=("quantile",))
    return counts.select("quantile", "i_s", "n")


@query(f"with {GALAXIES}, {painted('rho', 'galaxies')}, {LATTICE}, {DELTA}, {QUERY}, {ROUNDED} select cast(floor((delta + 1) * 10) as bigint) as bin, count(*) as n from readout group by 1")
def counts_in_cells(spark, sf_dir):
    """Distribution of densities at query points (counts in cells)."""
    delta = mesh.contrast(mesh.paint(galaxies(spark, sf_dir), N, CELL), N)
    read = mesh.readout(delta, query_points(spark, sf_dir), N, CELL).withColumn("value", F.round("value", 9))
    return read.groupBy(F.floor((F.col("value") + 1) * 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

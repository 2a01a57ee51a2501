"""Queries on catalogs: identifiers, targets, lightcones, box geometry, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.functions import geometry
from starloom.operators import catalogs, inference, labelled, mesh, morphology, observables, sky, statistics
from starloom.plans.fields import CELL, LATTICE, N, painted
from starloom.plans.structures import FIELDS, _field
from starloom.plans.views import GALAXIES, MEASUREMENTS, MOCKS, RANDOMS, query
from starloom.sources.points import BOX, galaxies, measurements, mocks, randoms, table

CLASSES = {"1-URGENT": "QSO", "2-HIGH": "LRG", "3-MEDIUM": "ELG_HIP", "4-NOT SPECIFIED": "ELG_LOP", "5-LOW": "BGS"}


@query("select o_orderkey as id, row_number() over (order by md5(o_orderkey || ':7')) as target_id from orders")
def permuted_ids(spark, sf_dir):
    """Identifiers in a scattered, repeatable order."""
    return catalogs.permuted_ids(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 7).select("id", "target_id")


@query(f"with {GALAXIES}, c as (select *, case tracer when '1-URGENT' then 'QSO' when '2-HIGH' then 'LRG' when '3-MEDIUM' then 'ELG_HIP' when '5-LOW' then 'BGS' else 'ELG_LOP' end as class from galaxies) select id, class, case class when 'QSO' then 3400 when 'BGS' then 2100 when 'ELG_LOP' then 3100 else 3200 end as priority, case class when 'QSO' then 4 when 'BGS' then 1 else 2 end as numobs_init, case class when 'BGS' then 'BRIGHT' else 'DARK' end as obsconditions from c")
def target_columns(spark, sf_dir):
    """Priorities and numbers of observations by target class."""
    named = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    rows = galaxies(spark, sf_dir).select("id", F.coalesce(named[F.col("tracer")], F.lit("ELG_LOP")).alias("class"))
    return catalogs.target_columns(rows, "class").select("id", "class", "priority", "numobs_init", "obsconditions")


@query(f"with {GALAXIES}, {RANDOMS}, {painted('rho', 'galaxies')}, {painted('ran', 'randoms')}, {LATTICE}, al as (select (select sum(value) from rho) / (select sum(value) from ran) as a, (select sum(w) / 8000.0 from randoms) as thr) select l.ix, l.iy, l.iz, case when coalesce(r.value, 0) > thr then round(coalesce(d.value, 0) / (a * r.value), 8) else 0.9e30 end as value from lattice l left join rho d using (ix, iy, iz) left join ran r using (ix, iy, iz), al")
def void_density_ratio(spark, sf_dir):
    """Density over the expected one, cells of few randoms marked (M6, M5)."""
    rand = randoms(spark, sf_dir)
    out = mesh.density_ratio(mesh.paint(galaxies(spark, sf_dir), N, CELL), mesh.paint(rand, N, CELL), mesh.random_threshold(rand, 1.0, "mean", N), N)
    return out.withColumn("value", F.when(F.col("value") == mesh.EMPTY, F.col("value")).otherwise(F.round("value", 8)))


@query(f"with recursive {FIELDS} select cast(node as bigint) as node, cast(root as bigint) as root, f.value as value from zones join field f on f.voxel = node")
def member_values(spark, sf_dir):
    """Every cell of a zone with its value."""
    field = _field(spark, sf_dir)
    return morphology.member_values(morphology.watershed(field, N), field, N).select("node", "root", "value")


@query(f"with {MEASUREMENTS} select cosmo_idx, hod_idx, ell, s, round(s * (s + 1) * (s + 2) * value / 1e5, 8) as value from measurements")
def triangle_weights(spark, sf_dir):
    """Values times the three sides of their triangle."""
    rows = measurements(spark, sf_dir).withColumns({"s2": F.col("s") + 1, "s3": F.col("s") + 2})
    return observables.triangle_weight(rows, ("s", "s2", "s3")).select("cosmo_idx", "hod_idx", "ell", "s", F.round("value", 8).alias("value"))


@query(f"with {MEASUREMENTS} select cosmo_idx, hod_idx, ell, s, value / 64 as value from measurements")
def per_volume(spark, sf_dir):
    """Values over the number of small volumes."""
    return observables.per_volume(measurements(spark, sf_dir)).select("cosmo_idx", "hod_idx", "ell", "s", "value")


CUBE = "cube as (select ((o_orderkey * 7919) % 10007) / 10007.0::double as ux, ((o_orderkey * 104729) % 10009) / 10009.0::double as uy, ((o_orderkey * 15485863) % 10037) / 10037.0::double as uz from orders)"


def _cube(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(*[((key * a) % m / float(m)).alias(u) for u, a, m in (("ux", 7919, 10007), ("uy", 104729, 10009), ("uz", 15485863, 10037))])


@query(f"with {GALAXIES}, {CUBE}, s as (select * from (values (0, 0), (500, 0), (0, 500)) t(b, c)), v as (select avg(case when r2 > 40000 and r2 < 490000 then 1.0 else 0 end) * 3 * 125000000 as volume from (select (ux * 500) * (ux * 500) + (uy * 500 + b) * (uy * 500 + b) + (uz * 500 + c) * (uz * 500 + c) as r2 from cube, s)), n as (select count(*) as n from galaxies where x < 500 and (y < 500 or z < 500) and x * x + y * y + z * z > 40000 and x * x + y * y + z * z < 490000) select n, round(n / volume, 12) as density from n, v")
def lightcone_density(spark, sf_dir):
    """Objects per volume of a shell within the boxes of a lightcone."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    r2 = x * x + y * y + z * z
    rows = galaxies(spark, sf_dir).where(sky.in_boxes(x, y, z, 500) & (r2 > 40000) & (r2 < 490000))
    return sky.lightcone_density(rows, _cube(spark, sf_dir), 500.0, 200.0, 700.0).select("n", F.round("density", 12).alias("density"))


@query(f"with {CUBE}, p as (select (ux * 2 - 1) as x, (uy * 2 - 1) as y, (uz * 2 - 1) as z from cube), q as (select x / sqrt(x * x + y * y + z * z) as x, y / sqrt(x * x + y * y + z * z) as y, z / sqrt(x * x + y * y + z * z) as z, pow(sqrt(x * x + y * y + z * z), 3) as u from p where x * x + y * y + z * z > 0 and x * x + y * y + z * z <= 1), s as (select * from (values (0, 0.5, 1.0), (1, 1.0, 1.3), (2, 1.3, 1.6)) t(shell, a, b)) select cast(shell as integer) as shell, round(avg(case when greatest(abs(x), abs(y), abs(z)) * cbrt(a * a * a + u * (b * b * b - a * a * a)) <= 1 then 1.0 else 0 end), 6) as share from q, s group by shell")
def shell_filling(spark, sf_dir):
    """Share of spherical shells within a cube, from samples."""
    out = catalogs.intersection_volume(_cube(spark, sf_dir), [(0.5, 1.0), (1.0, 1.3), (1.3, 1.6)], 1.0)
    return out.select("shell", F.round("share", 6).alias("share"))


@query(f"with {GALAXIES}, s as (select * from range(-1, 2) t(k)) select id, x + a.k * 1000 as x, y + b.k * 1000 as y, z + c.k * 1000 as z from galaxies, s a, s b, s c where x + a.k * 1000 > -20 and x + a.k * 1000 < 1020 and y + b.k * 1000 > -20 and y + b.k * 1000 < 1020 and z + c.k * 1000 > -20 and z + c.k * 1000 < 1020")
def near_faces(spark, sf_dir):
    """Points and their periodic copies near faces, edges and corners."""
    return sky.near_faces(galaxies(spark, sf_dir).select("id", "x", "y", "z"), BOX, 20).select("id", "x", "y", "z")


@query(f"with {GALAXIES} select cast((least(x * 4 // 1000, 3) * 4 + least(y * 4 // 1000, 3)) * 4 + least(z * 4 // 1000, 3) as integer) as box, count(*) as n, round(avg(w), 9) as w from galaxies group by 1")
def sub_boxes(spark, sf_dir):
    """Points by sub-box, half open along every axis."""
    at = catalogs.sub_box(F.col("x"), F.col("y"), F.col("z"), float(BOX), 4)
    return galaxies(spark, sf_dir).groupBy(at.alias("box")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 9).alias("w"))


@query(f"with {GALAXIES} select id, round(x + case when x * x + y * y + z * z = 0 then 0 else x * (x * (w * 30.0 - 90) + y * 20.0 + z * 10.0) / (x * x + y * y + z * z) / 0.7 end, 7) as x, round(z + case when x * x + y * y + z * z = 0 then 0 else z * (x * (w * 30.0 - 90) + y * 20.0 + z * 10.0) / (x * x + y * y + z * z) / 0.7 end, 7) as z from galaxies")
def radial_distortion(spark, sf_dir):
    """Positions moved along the line to the observer (T5)."""
    x, _, z = geometry.radial_shift(F.col("x"), F.col("y"), F.col("z"), F.col("w") * 30.0 - 90, F.lit(20.0), F.lit(10.0), 0.7)
    return galaxies(spark, sf_dir).select("id", F.round(x, 7).alias("x"), F.round(z, 7).alias("z"))


@query(f"with {GALAXIES} select id, ((x * 3 - 700) % 1000 + 1000) % 1000 as x, ((y - 2500) % 1000 + 1000) % 1000 as y, (((z * 5 + 250) - -500) % 1000 + 1000) % 1000 - 500 as z from galaxies")
def wrapped_positions(spark, sf_dir):
    """Positions brought into a periodic box, about 0 or about its corner."""
    return galaxies(spark, sf_dir).select("id", geometry.wrap(F.col("x") * 3 - 700, BOX).alias("x"), geometry.wrap(F.col("y") - 2500, BOX).alias("y"), geometry.wrap(F.col("z") * 5 + 250, BOX, -500).alias("z"))


@query(f"with {GALAXIES} select id, 'x' as los, y as a, z as b, x as c from galaxies union all select id, 'y', z, x, y from galaxies union all select id, 'z', x, y, z from galaxies")
def rotated_axes(spark, sf_dir):
    """Axes turned so that the line of sight comes last, for each of them."""
    rows, out = galaxies(spark, sf_dir), None
    for los in "xyz":
        part = rows.select("id", F.lit(los).alias("los"), *[F.col(c).alias(n) for c, n in zip(geometry.rotate_los(los), "abc", strict=True)])
        out = part if out is None else out.unionByName(part)
    return out


@query("select * from (values ('x', 1000 / 0.97, 1000 / 1.02, 1000 / 1.02), ('y', 1000 / 1.02, 1000 / 0.97, 1000 / 1.02), ('z', 1000 / 1.02, 1000 / 1.02, 1000 / 0.97)) t(los, x, y, z)".replace("1000 /", "1000::double /"))
def scaled_boxes(spark, sf_dir):
    """Sides of the box after scaling, by line of sight."""
    return spark.createDataFrame([(los, *geometry.scaled_box(float(BOX), los, 0.97, 1.02)) for los in "xyz"], "los string, x double, y double, z double")


@query(f"with {GALAXIES} select w, round(pow(pi(), 1.0 / 3) * pow(6.0 * count(*), 2.0 / 3) / (6 * pow(count(*), 2.0 / 3)), 9) as sphericity from galaxies group by w")
def cube_sphericity(spark, sf_dir):
    """Sphericity of cubes of so many cells."""
    n = F.count(F.lit(1)).cast("double")
    return galaxies(spark, sf_dir).groupBy("w").agg(F.round(geometry.sphericity(n, 6 * F.pow(n, F.lit(2 / 3))), 9).alias("sphericity"))


@query(f"with {GALAXIES}, {painted('ran', 'galaxies')} select ix, iy, iz, case when value <= 4.5 then 1 else 0 end as masked from ran")
def survey_mask(spark, sf_dir):
    """Cells of few randoms."""
    return observables.voxel_mask(mesh.paint(galaxies(spark, sf_dir), N, CELL), 4.5).select("ix", "iy", "iz", "masked")


@query(f"with {GALAXIES}, f as (select avg(case when w > 2 then 1.0 else 0 end) as fraction, count(*) / 1e9 as density from galaxies) select round(fraction, 9) as fraction, density, abs(fraction - 0.6) <= 0.03 and abs(density - 1.5e-5) <= 7.5e-7 as ok from f")
def satellite_fraction(spark, sf_dir):
    """Satellite fraction and density against what was expected."""
    rows = galaxies(spark, sf_dir).select((F.col("w") <= 2).alias("central"))
    return catalogs.satellite_check(rows, 0.6, 1.5e-5, 1e9).withColumn("fraction", F.round("fraction", 9))


@query("select s_suppkey as id, s_acctbal as \"logM1\", s_nationkey as \"Acent\" from supplier")
def renamed_parameters(spark, sf_dir):
    """Parameters under the names used inside."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("# id"), F.col("s_acctbal").alias(" logM_1"), F.col("s_nationkey").alias("A_cen "))
    return catalogs.rename_parameters(catalogs.clean_header(rows))


SHELLS = "shells as (select * from (values (0, 200, 400, 20.0), (1, 400, 600, 80.0), (2, 600, 800, 500.0)) t(bin, a, b, target))"


@query(f"with {GALAXIES}, {SHELLS}, d as (select sqrt(x * x + y * y + z * z) as r from galaxies), n as (select cast(floor((r - 200) / 200) as integer) as bin, count(*) as n from d where r >= 200 and r < 800 group by 1) select bin, round(target / (n / (0.125 * 4 / 3 * pi() * (b * b * b - a * a * a) / 1e9)), 9) as ratio from shells left join n using (bin)".replace("(b * b * b - a * a * a)", "(cast(b as double) * b * b - cast(a as double) * a * a)"))
def radial_ratios(spark, sf_dir):
    """Share of each shell to keep for a target density."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    counts = galaxies(spark, sf_dir).select(r.alias("r")).where("r >= 200 and r < 800").groupBy(F.floor((F.col("r") - 200) / 200).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = sky.radial_ratio(counts, {0: 20.0, 1: 80.0, 2: 500.0}, [200.0, 400.0, 600.0, 800.0], lambda x: x / 1000.0, 0.125)
    return out.select("bin", F.round("ratio", 9).alias("ratio"))


BORDERS = """half as (select * from (values (1, 0, 0), (0, 1, 0), (0, 0, 1)) t(a, b, c)),
b as (select p.root as z1, q.root as z2, greatest(f.value, g.value) as v from field f, half, field g, zones p, zones q
  where g.voxel = (((f.ix + a) % 20) * 20 + (f.iy + b) % 20) * 20 + (f.iz + c) % 20 and p.node = f.voxel and q.node = g.voxel and p.root <> q.root)"""


@query(f"with recursive {FIELDS}, {BORDERS} select cast(z as bigint) as root, min(v) as leak from (select z1 as z, v from b union all select z2, v from b) group by z")
def leak_density(spark, sf_dir):
    """The lowest pass out of every zone."""
    field = _field(spark, sf_dir)
    return morphology.leak_density(morphology.zone_links(field, morphology.watershed(field, N), N))


@query(f"with {MEASUREMENTS}, k as (select * from measurements where cosmo_idx in (1, 2, 5) and s between 5 and 30), f as (select *, dense_rank() over (order by ell, s) - 1 as bin, dense_rank() over (order by cosmo_idx, hod_idx) - 1 as nr from k) select cast(nr as integer) as sample, cast(i as integer) as position, value from f join (values (0, 9), (1, 0), (2, 33)) t(i, b) on b = bin")
def ordered_selection(spark, sf_dir):
    """Labels, slices, empty labels, dense numbers and indices, one after the other (P5)."""
    t = labelled.LabelledTable(measurements(spark, sf_dir), ("cosmo_idx", "hod_idx"), ("ell", "s"), nan_dims=("s",))
    return t.query({"cosmo_idx": [1, 2, 5]}, {"s": (5, 30)}, [9, 0, 33]).select("sample", "position", "value")


RES = "res as (select feature, sample, value - avg(value) over (partition by feature) as value from mocks)"


@query(f"with {MOCKS}, {RES}, c as (select a.feature as f1, b.feature as f2, covar_samp(a.value, b.value) as cov from res a join res b using (sample) group by all) select 'cov' as method, f1, f2, round(cov, 7) as cov from c union all select 'stdev', feature, feature, round(var_pop(value), 7) from res group by feature")
def residual_covariance(spark, sf_dir):
    """Whole and diagonal covariances of emulator residuals."""
    from pyspark.sql import Window

    rows = mocks(spark, sf_dir).select("sample", "feature", (F.col("value") - F.avg("value").over(Window.partitionBy("feature"))).alias("value"))
    parts = [statistics.residual_covariance(rows, m).select(F.lit(m).alias("method"), "f1", "f2", F.round("cov", 7).alias("cov")) for m in ("cov", "stdev")]
    return parts[0].unionByName(parts[1])


@query("with s as (select * from range(4) t(i)) select 'a' as parameter, cast(i as integer) as step, 0.1 + 0.8 * i / 3 as a, 2.0::double as b from s union all select 'b', cast(i as integer), 0.5, 1.0 + 2.0 * i / 3 from s".replace("0.1 + 0.8 * i / 3", "round(0.1 + 0.8::double * i / 3, 9)").replace("0.5,", "0.5::double,").replace("1.0 + 2.0 * i / 3", "round(1.0 + 2.0::double * i / 3, 9)"))
def sensitivity_grid(spark, sf_dir):
    """One parameter at a time over its range."""
    out = inference.sensitivity_grid(spark, {"a": 0.5, "b": 2.0}, {"a": (0.1, 0.9), "b": (1.0, 3.0)}, 4)
    return out.select("parameter", "step", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


@query()
def nested_voids(spark, sf_dir):
    """Voids absorbed by larger ones (J17); held against a plain loop in the tests."""
    rows = galaxies(spark, sf_dir).select("id", "x", "y", "z", (F.col("w") * 12.0).alias("radius"))
    return morphology.nested(rows, float(BOX))

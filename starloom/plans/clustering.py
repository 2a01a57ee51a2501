"""Pair statistics of the views: counts, correlation functions, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from starloom.operators import correlation, spatial
from starloom.plans.views import GALAXIES, RANDOMS, differences, query
from starloom.sources.points import BOX, galaxies, randoms

R, S, NS, NMU = 50, 5, 10, 5
PAIRS = f"pairs as (select *, dx * dx + dy * dy + dz * dz as d2 from (select a.id as a_id, b.id as b_id, a.w as aw, b.w as bw, {differences()} from galaxies a join galaxies b on a.id < b.id))"
CROSS = f"pairs as (select *, dx * dx + dy * dy + dz * dz as d2 from (select a.w as aw, b.w as bw, {differences()} from galaxies a, randoms b))"
SMU = "smu as (select cast(floor(sqrt(d2) / 5) as integer) as i_s, cast(least(floor(case when d2 = 0 then 0.0 else abs(dz) * 5 / sqrt(d2) end), 4) as integer) as i_mu, aw, bw from pairs where d2 < 2500)"
GRID = "grid as (select cast(i as integer) as i_s, cast(j as integer) as i_mu from range(10) t(i), range(5) u(j))"
SHELL = "(4.0 / 3.0 * pi() * (((i_s * 5.0 + 5.0) * (i_s * 5.0 + 5.0) * (i_s * 5.0 + 5.0)) - (i_s * 5.0 * (i_s * 5.0) * (i_s * 5.0))))"
XI = f"""xi as (select i_s, i_mu, coalesce(n, 0) / (cast(np as double) * {SHELL} / 1e9 / 5) - 1 as xi, coalesce(n, 0) as n
  from grid left join (select i_s, i_mu, count(*) as n from smu group by all) using (i_s, i_mu), (select count(*) * (count(*) - 1) / 2 as np from galaxies))"""


def _pairs_of(df):
    n = F.count(F.lit(1))
    return df.agg((n * (n - 1) / 2).alias("np"))


def _xi(spark, sf_dir):
    points = galaxies(spark, sf_dir)
    counts = correlation.complete(correlation.count_smu(points, None, S, NS, NMU, BOX), i_s=NS, i_mu=NMU)
    # one row of totals
    both = counts.crossJoin(F.broadcast(_pairs_of(points)))
    return both.select("i_s", "i_mu", "n", correlation.natural(F.col("n"), correlation.rr_smu(F.col("np").cast("double"), BOX, S, NMU)).alias("xi"))


@query(f"with {GALAXIES}, {PAIRS}, {SMU}, {GRID}, {XI} select i_s, cast(sum(n) as bigint) as dd, round(sum(xi) / 5, 8) as xi from xi group by i_s")
def tpcf(spark, sf_dir):
    """Correlation function of the catalog with the analytic random count."""
    return _xi(spark, sf_dir).groupBy("i_s").agg(F.sum("n").cast("long").alias("dd"), F.round(F.sum("xi") / NMU, 8).alias("xi"))


@query(f"with {GALAXIES}, {PAIRS}, {SMU} select i_s, i_mu, count(*) as n from smu group by all")
def pair_counts_smu(spark, sf_dir):
    """Auto counts in separation and cosine."""
    return correlation.count_smu(galaxies(spark, sf_dir), None, S, NS, NMU, BOX)


@query(f"with {GALAXIES}, {RANDOMS}, {CROSS}, {SMU} select i_s, i_mu, cast(sum(aw * bw) as bigint) as n from smu group by all")
def pair_counts_cross(spark, sf_dir):
    """Weighted cross counts of data and randoms."""
    return correlation.count_smu(galaxies(spark, sf_dir), randoms(spark, sf_dir), S, NS, NMU, BOX, weights=True)


RPPI = "rppi as (select cast(floor(sqrt(dx * dx + dy * dy) / 4) as integer) as i_rp, cast(floor(abs(dz) / 8) as integer) as i_pi from pairs where abs(dx) <= 20 and abs(dy) <= 20 and abs(dz) < 40)"


@query(f"with {GALAXIES}, {PAIRS}, {RPPI} select i_rp, i_pi, count(*) as n from rppi where i_rp < 5 and i_pi < 5 group by all")
def pair_counts_rppi(spark, sf_dir):
    """Auto counts across and along the line of sight."""
    return correlation.count_rppi(galaxies(spark, sf_dir), None, 4, 5, 8, 5, BOX)


@query(f"""with {GALAXIES}, {PAIRS}, {RPPI}, grid as (select cast(i as integer) as i_rp, cast(j as integer) as i_pi from range(5) t(i), range(5) u(j)),
xi as (select i_rp, coalesce(n, 0) / (cast(np as double) * (pi() * ((i_rp * 4.0 + 4) * (i_rp * 4.0 + 4) - i_rp * 4.0 * (i_rp * 4.0))) * 16.0 / 1e9) - 1 as xi
  from grid left join (select i_rp, i_pi, count(*) as n from rppi group by all) using (i_rp, i_pi), (select count(*) * (count(*) - 1) / 2 as np from galaxies))
select i_rp, round(16.0 * sum(xi), 6) as wp from xi group by i_rp""")
def projected_tpcf(spark, sf_dir):
    """Projected correlation function."""
    points = galaxies(spark, sf_dir)
    counts = correlation.complete(correlation.count_rppi(points, None, 4, 5, 8, 5, BOX), i_rp=5, i_pi=5)
    both = counts.crossJoin(F.broadcast(_pairs_of(points)))
    xi = both.select("i_rp", correlation.natural(F.col("n"), correlation.rr_rppi(F.col("np").cast("double"), BOX, 4, 8)).alias("xi"))
    return correlation.projected(xi, 8.0).select("i_rp", F.round("wp", 6).alias("wp"))


MU = "((i_mu + 0.5) / 5)"


@query(f"""with {GALAXIES}, {PAIRS}, {SMU}, {GRID}, {XI} select i_s, round(sum(xi) / 5, 7) as xi_0, round(5 * sum(xi * (3 * {MU} * {MU} - 1) / 2) / 5, 7) as xi_2,
round(9 * sum(xi * (35 * {MU} * {MU} * {MU} * {MU} - 30 * {MU} * {MU} + 3) / 8) / 5, 7) as xi_4 from xi group by i_s""")
def tpcf_multipoles(spark, sf_dir):
    """Monopole, quadrupole and hexadecapole."""
    out = correlation.multipoles(_xi(spark, sf_dir), NMU)
    return out.select("i_s", *[F.round(c, 7).alias(c) for c in out.columns[1:]])


@query(f"with {GALAXIES}, {PAIRS}, {SMU} select cast(floor(i_s / 4) as integer) as i_s, i_mu, count(*) as n from smu group by all")
def tpcf_rebinned(spark, sf_dir):
    """Counts of four neighbouring bins merged."""
    return correlation.rebin(correlation.count_smu(galaxies(spark, sf_dir), None, S, NS, NMU, BOX), 4)


@query(f"""with {GALAXIES}, {RANDOMS},
dd as (select cast(floor(sqrt(dx * dx + dy * dy + dz * dz) / 5) as integer) as i_s, count(*) as dd from (select {differences()} from galaxies a join galaxies b on a.id < b.id) where dx * dx + dy * dy + dz * dz < 2500 group by 1),
dr as (select cast(floor(sqrt(dx * dx + dy * dy + dz * dz) / 5) as integer) as i_s, count(*) as dr from (select {differences()} from galaxies a, randoms b) where dx * dx + dy * dy + dz * dz < 2500 group by 1),
rid as (select *, row_number() over () as id from randoms),
rr as (select cast(floor(sqrt(dx * dx + dy * dy + dz * dz) / 5) as integer) as i_s, count(*) as rr from (select {differences()} from rid a join rid b on a.id < b.id) where dx * dx + dy * dy + dz * dz < 2500 group by 1),
tot as (select (select count(*) from galaxies) as nd, (select count(*) from randoms) as nr)
select i_s, dd, dr, rr, round((dd / (nd * (nd - 1) / 2) - 2 * dr / (nd * nr) + rr / (nr * (nr - 1) / 2)) / (rr / (nr * (nr - 1) / 2)), 8) as xi from dd join dr using (i_s) join rr using (i_s), tot""")
def landy_szalay(spark, sf_dir):
    """Survey estimator from data and random counts, normalised by pair numbers."""
    data, rand = galaxies(spark, sf_dir), randoms(spark, sf_dir).withColumn("id", F.monotonically_increasing_id())
    joined = correlation.survey_counts(data, rand, S, NS, BOX)
    totals = data.agg(F.count(F.lit(1)).alias("nd")).crossJoin(rand.agg(F.count(F.lit(1)).alias("nr")))
    nd, nr = F.col("nd"), F.col("nr")
    dd, dr, rr = F.col("dd") / (nd * (nd - 1) / 2), F.col("dr") / (nd * nr), F.col("rr") / (nr * (nr - 1) / 2)
    return joined.crossJoin(F.broadcast(totals)).select("i_s", "dd", "dr", "rr", F.round(correlation.landy_szalay(dd, dr, rr), 8).alias("xi"))


@query(f"with {GALAXIES}, {PAIRS} select a_id, b_id, dx, dy, dz, d2 from pairs where d2 <= 400 and dx * dx + dy * dy < 225")
def radius_pairs(spark, sf_dir):
    """All links within a distance, closer than another across the line of sight."""
    return spatial.radius_pairs(galaxies(spark, sf_dir), 20, 15, BOX).select("a_id", "b_id", "dx", "dy", "dz", "d2")


KNN = f"""near as (select q.id as q_id, unnest(arg_min({{'id': q.bid, 'd2': q.d2, 'dx': q.dx, 'dy': q.dy, 'dz': q.dz}}, q.d2 * 1000000 + q.bid, 4)) as b, unnest(range(1, 5)) as rank
from (select *, dx * dx + dy * dy + dz * dz as d2 from (select a.id, b.id as bid, {differences()} from galaxies a, galaxies b)) q group by q.id)"""


@query(f"with {GALAXIES}, {KNN} select q_id, cast(rank as integer) as rank, b.id as id, b.d2 as d2 from near")
def knn_join(spark, sf_dir):
    """The four nearest points of every point, itself among them."""
    points = galaxies(spark, sf_dir)
    return spatial.knn(points, points, 4, BOX).select("q_id", "rank", "id", "d2")


@query(f"""with {GALAXIES}, {KNN}, hist as (select rank, cast(floor(sqrt(b.dx * b.dx + b.dy * b.dy) / 10) as integer) as i_rp, cast(floor(abs(b.dz) / 10) as integer) as i_pi, count(*) as n from near where rank > 1 group by all),
grid as (select cast(k as integer) + 2 as k, cast(i as integer) as i_rp, cast(j as integer) as i_pi from range(3) t(k), range(5) u(i), range(5) v(j))
select g.k as k, g.i_rp as i_rp, g.i_pi as i_pi, round(coalesce(sum(h.n), 0) / (select count(*) from galaxies), 9) as cdf
from grid g left join hist h on h.rank = g.k and h.i_rp <= g.i_rp and h.i_pi <= g.i_pi group by all""")
def knn_cdf(spark, sf_dir):
    """Share of queries whose k-th neighbour lies within (rp, pi)."""
    points = galaxies(spark, sf_dir)
    near = spatial.knn(points, points, 4, BOX).where("rank > 1")
    cells = near.select(F.col("rank").cast("int").alias("k"), F.floor(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / 10).cast("int").alias("i_rp"), F.floor(F.abs("dz") / 10).cast("int").alias("i_pi"))
    hist = cells.where("i_rp < 5 and i_pi < 5").groupBy("k", "i_rp", "i_pi").agg(F.count(F.lit(1)).alias("n"))
    full = correlation.complete(hist.withColumn("k", F.col("k") - 2), k=3, i_rp=5, i_pi=5).withColumn("k", F.col("k") + 2)
    along = Window.partitionBy("k", "i_rp").orderBy("i_pi").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy("k", "i_pi").orderBy("i_rp").rowsBetween(Window.unboundedPreceding, 0)
    summed = full.withColumn("n", F.sum("n").over(along)).withColumn("n", F.sum("n").over(across))
    total = points.agg(F.count(F.lit(1)).alias("total"))
    return summed.crossJoin(F.broadcast(total)).select("k", "i_rp", "i_pi", F.round(F.col("n") / F.col("total"), 9).alias("cdf"))

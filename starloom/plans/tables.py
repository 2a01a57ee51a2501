"""Statistics and labelled-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from starloom.operators import labelled, statistics
from starloom.plans.views import GALAXIES, MEASUREMENTS, MOCKS, query
from starloom.sources.points import galaxies, measurements, mocks


@query(f"with {GALAXIES} select cast(least(floor(z / 100), 9) as integer) as bin, least(floor(z / 100), 9) * 100.0 as low, least(floor(z / 100), 9) * 100.0 + 100 as high, count(*) as n from galaxies group by 1, 2, 3".replace("least(floor(z / 100), 9) * 100.0 as low", "cast(least(floor(z / 100), 9) * 100 as double) as low").replace("least(floor(z / 100), 9) * 100.0 + 100 as high", "cast(least(floor(z / 100), 9) * 100 + 100 as double) as high"))
def histogram(spark, sf_dir):
    """Histogram over given edges (A1)."""
    return statistics.histogram(galaxies(spark, sf_dir), "z", [100 * i for i in range(11)])


@query(f"with {GALAXIES} select tracer, cast(floor(z / 100) as integer) as bin, count(*) / 100.0 as nz from galaxies group by all")
def number_density(spark, sf_dir):
    """n(z): counts over bin width, by tracer (A3, A4)."""
    return galaxies(spark, sf_dir).groupBy("tracer", F.floor(F.col("z") / 100).cast("int").alias("bin")).agg((F.count(F.lit(1)) / 100.0).alias("nz"))


@query(f"with {MOCKS} select a.feature as f1, b.feature as f2, round(covar_samp(a.value, b.value) / 64.0, 8) as cov from mocks a join mocks b on a.sample = b.sample group by all")
def covariance(spark, sf_dir):
    """Sample covariance of features over mocks, over the volume factor."""
    return statistics.paired_covariance(mocks(spark, sf_dir), 1 / 64.0).withColumn("cov", F.round("cov", 8))


@query(f"with {MOCKS}, c as (select a.feature as f1, b.feature as f2, covar_samp(a.value, b.value) as cov from mocks a join mocks b on a.sample = b.sample group by all) select c.f1, c.f2, round(case when c.cov = 0 then 0 else c.cov / sqrt(p.cov * q.cov) end, 8) as corr from c join c p on p.f1 = c.f1 and p.f2 = c.f1 join c q on q.f1 = c.f2 and q.f2 = c.f2")
def correlation_matrix(spark, sf_dir):
    """Correlation from covariance."""
    return statistics.correlation_matrix(statistics.paired_covariance(mocks(spark, sf_dir))).withColumn("corr", F.round("corr", 8))


@query(f"with {MOCKS}, m as (select feature, median(value) as med from mocks group by 1) select feature, round(median(abs(value - med)) / 0.6744897501960817, 8) as mad from mocks join m using (feature) group by 1")
def median_absolute_deviation(spark, sf_dir):
    """Robust scale per feature."""
    return statistics.mad(mocks(spark, sf_dir), "value", ("feature",)).withColumn("mad", F.round("mad", 8))


@query(
    f"""with {MOCKS}, m as (select feature, median(value) as med from mocks group by 1), c as (select sample, feature, value - med as v from mocks join m using (feature)),
p as (select a.feature as f1, b.feature as f2, a.v + b.v as p, a.v - b.v as m, a.v as v from c a join c b using (sample)),
md as (select f1, f2, median(p) as mp, median(m) as mm, median(v) as mv from p group by all),
s as (select f1, f2, median(abs(p - mp)) / 0.6744897501960817 as sp, median(abs(m - mm)) / 0.6744897501960817 as sm, median(abs(v - mv)) / 0.6744897501960817 as sv from p join md using (f1, f2) group by all)
select f1, f2, round(case when f1 = f2 then greatest(sv * sv, 1e-12) else (sp * sp - sm * sm) / 4 end, 7) as cov from s"""
)
def robust_covariance(spark, sf_dir):
    """Pairwise robust covariance (A10)."""
    return statistics.gk_covariance(mocks(spark, sf_dir)).withColumn("cov", F.round("cov", 7))


@query()
def orthogonalised_covariance(spark, sf_dir):
    """Orthogonalised robust covariance (A11); held against numpy in the tests."""
    names, matrix = statistics.ogk_covariance(mocks(spark, sf_dir))
    return spark.createDataFrame([(a, b, round(float(matrix[i, j]), 6)) for i, a in enumerate(names) for j, b in enumerate(names)], "f1 string, f2 string, cov double")


RESIDUALS = "res as (select feature, sample, value - avg(value) over (partition by feature) as residual from mocks)"


@query(
    f"""with {MOCKS}, {RESIDUALS}, m as (select feature, median(residual) as med, avg(residual) as mean from res group by 1)
select feature, round(pow(median(abs(residual - med)) / 0.6744897501960817, 2), 6) as median_, round(pow(avg(abs(residual - mean)) * sqrt(pi() / 2), 2), 6) as mean_, round(var_pop(residual), 6) as stdev_ from res join m using (feature) group by 1"""
)
def emulator_covariance(spark, sf_dir):
    """Diagonal emulator covariance by three methods."""
    rows = mocks(spark, sf_dir).select("feature", (F.col("value") - F.avg("value").over(Window.partitionBy("feature"))).alias("residual"))
    out = None
    for method in ("median", "mean", "stdev"):
        part = statistics.emulator_scale(rows, method).select("feature", F.round("variance", 6).alias(f"{method}_"))
        out = part if out is None else out.join(part, "feature")
    return out


@query(f"with {MOCKS}, {RESIDUALS} select feature, round(median(abs(residual)), 8) as error from res group by 1")
def emulator_error(spark, sf_dir):
    """Median absolute residual per feature."""
    rows = mocks(spark, sf_dir).select("feature", (F.col("value") - F.avg("value").over(Window.partitionBy("feature"))).alias("residual"))
    return rows.groupBy("feature").agg(F.round(F.median(F.abs("residual")), 8).alias("error"))


@query(f"with {MOCKS}, t as (select feature, value, ntile(4) over (partition by feature order by value, sample) - 1 as bin from mocks) select feature, cast(bin as integer) as bin, round(avg(value), 8) as mean, count(*) as n from t group by all")
def even_split_means(spark, sf_dir):
    """Means of sorted values in bins of equal size."""
    out = statistics.even_split_means(mocks(spark, sf_dir), ["value", "sample"], "value", 4, ("feature",))
    return out.withColumn("mean", F.round("mean", 8))


@query(f"with {MOCKS} select feature, sample, value, round(cume_dist() over (partition by feature order by value), 9) as cdf from mocks")
def empirical_cdf(spark, sf_dir):
    """Share of values up to each one."""
    return statistics.ecdf(mocks(spark, sf_dir), "value", ("feature",)).withColumn("cdf", F.round("cdf", 9)).select("feature", "sample", "value", "cdf")


@query(f"with {MOCKS} select feature, round(avg(value), 8) as mean, round(stddev_pop(value), 8) as std from mocks group by 1")
def feature_moments(spark, sf_dir):
    """Mean and deviation per feature."""
    return mocks(spark, sf_dir).groupBy("feature").agg(F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_pop("value"), 8).alias("std"))


def _clip_sql(rounds: int) -> str:
    out, now = [f"r0 as (select sample, feature, value, true as ok from mocks)"], "r0"
    for i in range(1, rounds + 1):
        out.append(f"s{i} as (select feature, median(case when ok then value end) as m, stddev_pop(case when ok then value end) as s from {now} group by 1)")
        out.append(f"r{i} as (select sample, feature, value, ok and abs(value - m) <= 2 * s as ok from {now} join s{i} using (feature))")
        now = f"r{i}"
    return ", ".join(out) + f" select sample, bool_or(not ok) as outlier from {now} group by 1"


@query(f"with {MOCKS}, {_clip_sql(5)}")
def sigma_clip(spark, sf_dir):
    """Samples with a clipped feature."""
    return statistics.sigma_clip(mocks(spark, sf_dir), 2.0)


@query(f"with {MEASUREMENTS}, d as (select distinct cosmo_idx, s from measurements), g as (select *, s - row_number() over (partition by cosmo_idx order by s) as k from d) select cosmo_idx, min(s) as first, max(s) as last from g group by cosmo_idx, k")
def integer_runs(spark, sf_dir):
    """Runs of consecutive integers (gaps and islands)."""
    return statistics.islands(measurements(spark, sf_dir), "s", ("cosmo_idx",))


@query(f"with {MEASUREMENTS} select * from measurements where cosmo_idx in (1, 3, 4) and ell = 2 and s between 10 and 20".replace("select * from", "select cosmo_idx, hod_idx, s, value from"))
def select_and_slice(spark, sf_dir):
    """Label selection and inclusive slices; scalars drop their dimension, unknown keys are ignored."""
    t = labelled.LabelledTable(measurements(spark, sf_dir), ("cosmo_idx", "hod_idx"), ("ell", "s"))
    return t.select(cosmo_idx=[1, 3, 4], ell=2, nothing=7).slice(s=(10, 20), unknown=(0, 1)).frame


@query(f"with {MEASUREMENTS}, f as (select *, dense_rank() over (order by ell, s) - 1 as bin from measurements) select cosmo_idx, hod_idx, cast(i as integer) as position, value from f join (values (0, 7), (1, 3), (2, 20)) t(i, b) on b = bin")
def index_selection(spark, sf_dir):
    """Features by their place, in the order asked for."""
    t = labelled.LabelledTable(measurements(spark, sf_dir), ("cosmo_idx", "hod_idx"), ("ell", "s"))
    return t.take([7, 3, 20]).select("cosmo_idx", "hod_idx", "position", "value")


@query(f"with {MEASUREMENTS} select cosmo_idx, hod_idx, cast(dense_rank() over (order by ell, s) - 1 as integer) as feature, cast(dense_rank() over (order by cosmo_idx, hod_idx) - 1 as integer) as sample, value from measurements")
def flatten(spark, sf_dir):
    """Dense sample and feature numbers."""
    t = labelled.LabelledTable(measurements(spark, sf_dir), ("cosmo_idx", "hod_idx"), ("ell", "s"))
    return t.flatten().select("cosmo_idx", "hod_idx", "feature", "sample", "value")


@query(f"with {MEASUREMENTS}, n as (select cosmo_idx, hod_idx, ell, s, case when hod_idx = 3 then null else value end as value from measurements) select * from n where hod_idx in (select hod_idx from n group by 1 having count(value) > 0)")
def drop_empty_labels(spark, sf_dir):
    """Labels without any value go."""
    rows = measurements(spark, sf_dir).withColumn("value", F.when(F.col("hod_idx") != 3, F.col("value")))
    t = labelled.LabelledTable(rows, ("cosmo_idx", "hod_idx"), ("ell", "s"), nan_dims=("hod_idx",))
    return t.drop_empty().frame


@query(f"with {MEASUREMENTS} select distinct s from measurements")
def coordinate_list(spark, sf_dir):
    """Labels of a dimension."""
    return labelled.LabelledTable(measurements(spark, sf_dir), ("cosmo_idx", "hod_idx"), ("ell", "s")).coordinates("s")


@query(f"with {MEASUREMENTS}, a as (select cosmo_idx, hod_idx, ell, s, value as y from measurements where s < 30), b as (select cosmo_idx, hod_idx, ell, s, value * 2 as e from measurements where s > 20) select cosmo_idx, hod_idx, ell, s, y, e from a full join b using (cosmo_idx, hod_idx, ell, s)")
def outer_merge(spark, sf_dir):
    """Datasets merged on their shared coordinates."""
    rows = measurements(spark, sf_dir)
    a, b = rows.where("s < 30").withColumnRenamed("value", "y"), rows.where("s > 20").select("cosmo_idx", "hod_idx", "ell", "s", (F.col("value") * 2).alias("e"))
    return labelled.merge([a, b], ("y", "e"))


@query(f"with {MEASUREMENTS} select cosmo_idx, hod_idx, ell, s, value, cosmo_idx in (0, 1) as test from measurements")
def train_test_split(spark, sf_dir):
    """Rows with the given labels, and all others."""
    inside, outside = labelled.split(measurements(spark, sf_dir), {"cosmo_idx": [0, 1]})
    return inside.withColumn("test", F.lit(True)).unionByName(outside.withColumn("test", F.lit(False)))


@query(f"with {MEASUREMENTS} select cosmo_idx, hod_idx, row_number() over (partition by cosmo_idx order by hod_idx) - 1 as new_idx from (select distinct cosmo_idx, hod_idx from measurements) qualify new_idx < 4".replace("row_number() over (partition by cosmo_idx order by hod_idx) - 1 as new_idx", "cast(row_number() over (partition by cosmo_idx order by hod_idx) - 1 as integer) as new_idx"))
def first_samples(spark, sf_dir):
    """The first samples of every cosmology, numbered anew."""
    return labelled.first_n(measurements(spark, sf_dir), ("cosmo_idx",), "hod_idx", 4)


@query(f"with {MEASUREMENTS}, p as (select p_partkey % 10 as cosmo_idx, cast(sum(p_size) as bigint) as size from part group by 1) select m.cosmo_idx, m.hod_idx, p.size from (select distinct cosmo_idx, hod_idx from measurements) m join p using (cosmo_idx)")
def parameter_join(spark, sf_dir):
    """Cosmology parameters repeated for every sample."""
    params = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy((F.col("p_partkey") % 10).alias("cosmo_idx")).agg(F.sum("p_size").cast("long").alias("size"))
    return measurements(spark, sf_dir).select("cosmo_idx", "hod_idx").distinct().join(params, "cosmo_idx").select("cosmo_idx", "hod_idx", "size")


@query(
    f"""with {MEASUREMENTS}, h as (select hod_idx, s, avg(value) as m from measurements group by all), g as (select s, avg(m) as m0 from h group by 1),
d as (select hod_idx, s, ((m + 1) - (m0 + 1)) / (m0 + 1) as delta from h join g using (s))
select v.cosmo_idx, v.hod_idx, v.ell, v.s, round((1 + value) * (1 + delta) - 1, 4) as value from measurements v join d using (hod_idx, s)"""
)
def phase_correction(spark, sf_dir):
    """Values corrected by the ratio of a phase's mean to the mean of all."""
    rows = measurements(spark, sf_dir)
    phase = rows.groupBy("hod_idx", "s").agg(F.avg("value").alias("m"))
    mean = phase.groupBy("s").agg(F.avg("m").alias("m0"))
    delta = phase.join(mean, "s").select("hod_idx", "s", (((F.col("m") + 1) - (F.col("m0") + 1)) / (F.col("m0") + 1)).alias("delta"))
    return rows.join(delta, ["hod_idx", "s"]).select("cosmo_idx", "hod_idx", "ell", "s", F.round((1 + F.col("value")) * (1 + F.col("delta")) - 1, 4).alias("value"))

"""Point catalogs: views of the driver tables, query points and random catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the periodic box in which the views' integer coordinates lie.
BOX = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def galaxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, w, tracer) with integer coordinates, from orders."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        ((key * 7919 + cust * 104729) % BOX).alias("x"),
        (F.floor("o_totalprice").cast("long") % BOX).alias("y"),
        ((days * 31 + cust * 17) % BOX).alias("z"),
        (cust % 5 + 1).alias("w"),
        F.col("o_orderpriority").alias("tracer"),
    )


def randoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, w), from lineitem."""
    part, key, supp = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
    x, y, z = (part * 6151 + key * 389) % BOX, (supp * 9973 + key * 617) % BOX, F.floor("l_extendedprice").cast("long") % BOX
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"), z.alias("z"), F.lit(1).cast("long").alias("w"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled long table (cosmo_idx, hod_idx, ell, s, value), from lineitem."""
    ell = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    keys = [(F.col("l_suppkey") % 10).alias("cosmo_idx"), F.col("l_linenumber").cast("long").alias("hod_idx"), ell.cast("long").alias("ell"), F.col("l_quantity").cast("long").alias("s")]
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg((cents / F.count(F.lit(1)) / 100.0).alias("value"))


def mocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, feature, value) grid, from events."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("feature")).agg((cents / F.count(F.lit(1)) / 100.0).alias("value"))


def hashed_points(spark: SparkSession, n: int, box: int = BOX, seed: int = 42) -> DataFrame:
    """``n`` scattered points with integer coordinates, the same in every run and engine."""
    i = F.col("id")
    return spark.range(n).select(i, *[((i * a + (i % b) * c + seed) % box).alias(x) for x, a, b, c in (("x", 7919, 97, 331), ("y", 104729, 89, 617), ("z", 15485863, 83, 233))])


def random_points(spark: SparkSession, n: int, box: float = BOX, seed: int = 42) -> DataFrame:
    """``n`` uniform points; any seed, 0 too, fixes them."""
    return spark.range(n).select("id", *[(F.rand(seed + k) * box).alias(x) for k, x in enumerate("xyz")])


def lattice(spark: SparkSession, cells: int, cell: int) -> DataFrame:
    """Centres of a cubic mesh, each with its indices, exactly ``cells`` along every axis."""
    n = F.lit(cells)
    flat = spark.range(cells**3)
    ix, iy, iz = F.floor(F.col("id") / (n * n)).cast("int"), (F.floor(F.col("id") / n) % n).cast("int"), (F.col("id") % n).cast("int")
    return flat.select("id", ix.alias("ix"), iy.alias("iy"), iz.alias("iz"), *[((i + 0.5) * cell).alias(x) for i, x in ((ix, "x"), (iy, "y"), (iz, "z"))])


def sky_randoms(spark: SparkSession, n: int, ra=(0.0, 360.0), dec=(-90.0, 90.0), distance=(0.0, 1.0), seed: int = 42) -> DataFrame:
    """Uniform in solid angle and volume: sine of declination and cubed distance are uniform."""
    import math

    low, high = math.sin(math.radians(dec[0])), math.sin(math.radians(dec[1]))
    u = [F.rand(seed + k) for k in range(3)]
    d3 = [x**3 for x in distance]
    return spark.range(n).select("id", (ra[0] + u[0] * (ra[1] - ra[0])).alias("ra"), F.degrees(F.asin(low + u[1] * (high - low))).alias("dec"), F.cbrt(d3[0] + u[2] * (d3[1] - d3[0])).alias("distance"))


def latin_hypercube(spark: SparkSession, n: int, ranges: dict[str, tuple[float, float]], seed: int = 42) -> DataFrame:
    """One sample in each of ``n`` strata of every parameter, strata shuffled per parameter.

    The shuffle is an affine bijection of 0..n-1, so no global sort is needed.
    """
    import math
    import random

    rng = random.Random(seed)
    out = [F.col("id").alias("sample")]
    for k, (name, (low, high)) in enumerate(ranges.items()):
        step = rng.choice([a for a in range(1, max(2, n)) if math.gcd(a, n) == 1] or [1])
        stratum = (F.col("id") * step + rng.randrange(n)) % n
        out.append((low + (stratum + F.rand(seed + k)) / n * (high - low)).alias(name))
    return spark.range(n).select(*out)

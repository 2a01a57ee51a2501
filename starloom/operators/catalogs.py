"""Mock catalogs and their parameters: occupation, validation, lightcone volumes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.ranks import even_part, ranked

#: Parameter names as given by users and as used inside (fixed values).
RENAMED = {"logM_1": "logM1", "logM_cut": "logM_cut", "A_cen": "Acent", "A_sat": "Asat", "B_cen": "Bcent", "B_sat": "Bsat"}


def rename_parameters(params: DataFrame) -> DataFrame:
    return params.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in params.columns})


def check_parameters(given: set[str], needed: set[str]) -> list[str]:
    """Names beyond the needed ones (to warn of); a missing one raises."""
    missing = sorted(needed - set(given))
    if missing:
        raise ValueError(f"missing parameters: {missing}")
    return sorted(set(given) - needed)


def clean_header(df: DataFrame) -> DataFrame:
    """Column names without the comment mark and blanks of text tables."""
    return df.toDF(*[c.replace("#", "").strip() for c in df.columns])


def erfc(x: Column) -> Column:
    """Complementary error function to about 1e-7, from built-in functions only.

    Chebyshev fit of Numerical Recipes (fixed values).
    """
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    value = t * F.exp(-z * z + poly)
    return F.when(x >= 0, value).otherwise(2 - value)


def mean_centrals(log_mass: Column, log_cut: float, sigma: float) -> Column:
    """Expected central galaxies of a halo."""
    return 0.5 * erfc((F.lit(log_cut) - log_mass) / (math.sqrt(2.0) * sigma))


def mean_satellites(log_mass: Column, log_cut: float, sigma: float, log_m1: float, kappa: float, alpha: float) -> Column:
    """Expected satellites of a halo, modulated by its central."""
    m = F.pow(F.lit(10.0), log_mass)
    excess = (m - kappa * 10.0**log_cut) / 10.0**log_m1
    return F.when(excess > 0, F.pow(excess, F.lit(alpha)) * mean_centrals(log_mass, log_cut, sigma)).otherwise(0.0)


def populate(halos: DataFrame, *, log_cut: float, sigma: float, log_m1: float, kappa: float, alpha: float, spread: float = 1.0, seed: int = 42) -> DataFrame:
    """Galaxies (halo_id, central, x, y, z): Bernoulli centrals, Poisson satellites around them.

    The Poisson number is found by running down its distribution with one
    uniform number; no Python is involved. Probabilities are relative to that of
    the most likely number, so that none of large means vanish. Seed 0 is a seed
    like any other.
    """
    mass = F.col("log_mass")
    n_sat = mean_satellites(mass, log_cut, sigma, log_m1, kappa, alpha)
    drawn = halos.withColumn("_c", F.rand(seed) < mean_centrals(mass, log_cut, sigma)).withColumn("_l", n_sat).withColumn("_u", F.rand(seed + 1))
    # what lies further than twelve deviations off has no part in a double
    reach = F.ceil(12 * F.sqrt("_l") + 12).cast("int")
    mode = F.floor("_l").cast("int")
    low, high = F.greatest(mode - reach, F.lit(0)), mode + reach

    def up(a, k):
        """Relative probability of k + 1 from that of k."""
        return a * F.col("_l") / (k + 1)

    # relative probability of the lowest number, coming down from the most likely one
    least = F.aggregate(F.sequence(F.lit(0), mode - low), F.lit(1.0), lambda a, i: F.when(i < mode - low, a * (mode - i) / F.greatest(F.col("_l"), F.lit(1e-300))).otherwise(a))
    whole = F.aggregate(F.sequence(low, high), F.struct(least.alias("p"), F.lit(0.0).alias("s")), lambda a, k: F.struct(up(a["p"], k).alias("p"), (a["s"] + a["p"]).alias("s")), lambda a: a["s"])
    drawn = drawn.withColumn("_goal", F.col("_u") * whole)
    first = F.struct(low.alias("n"), least.alias("p"), F.lit(0.0).alias("s"))

    def step(a, k):
        more = a["s"] + a["p"] <= F.col("_goal")
        return F.struct(F.when(more, k + 1).otherwise(a["n"]).cast("int").alias("n"), F.when(more, up(a["p"], k)).otherwise(a["p"]).alias("p"), F.when(more, a["s"] + a["p"]).otherwise(a["s"]).alias("s"))

    count = F.when(F.col("_l") > 0, F.aggregate(F.sequence(low, high - 1), first, step, lambda a: a["n"])).otherwise(0)
    drawn = drawn.withColumn("_n", count)
    central = drawn.where("_c").select(F.col("id").alias("halo_id"), F.lit(True).alias("central"), "x", "y", "z")
    around = drawn.where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    shift = [F.randn(seed + 2 + i) * spread for i in range(3)]
    satellites = around.select(F.col("id").alias("halo_id"), F.lit(False).alias("central"), *[(F.col(c) + s).alias(c) for c, s in zip("xyz", shift, strict=True)])
    return central.unionByName(satellites)


def density_window(n: Column, low: float, high: float, keep_underdense: bool = False) -> Column:
    """Share of galaxies to keep: 1 within the window, less above it, null (skip) below."""
    return F.when((n < low) & F.lit(not keep_underdense), F.lit(None)).otherwise(F.least(F.lit(1.0), F.lit(float(high)) / n))


def satellite_check(galaxies: DataFrame, expected_fraction: float, expected_density: float, volume: float, rtol: float = 0.05) -> DataFrame:
    """One row: satellite fraction, density, and whether both are near what was expected."""
    out = galaxies.agg(F.avg((~F.col("central")).cast("double")).alias("fraction"), (F.count(F.lit(1)) / float(volume)).alias("density"))
    near = (F.abs(F.col("fraction") - expected_fraction) <= rtol * expected_fraction) & (F.abs(F.col("density") - expected_density) <= rtol * expected_density)
    return out.withColumn("ok", near)


def intersection_volume(samples: DataFrame, shells: list[tuple[float, float]], half: float) -> DataFrame:
    """(shell, share): part of each spherical shell that a cube of half side ``half`` about the origin holds.

    ``samples`` are uniform points (ux, uy, uz) in the unit cube; one pass over
    them serves all shells, which are few.
    """
    p = [(F.col(c) * 2 - 1) for c in ("ux", "uy", "uz")]
    norm = F.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2])
    rows = samples.where((norm > 0) & (norm <= 1)).select(*[(x / norm).alias(c) for x, c in zip(p, "xyz", strict=True)], F.pow(norm, F.lit(3)).alias("u"))
    table = F.array(*[F.struct(F.lit(i).alias("shell"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(shells)])
    placed = rows.select("x", "y", "z", "u", F.explode(table).alias("s")).select("x", "y", "z", "u", "s.*")
    r = F.cbrt(F.pow("a", F.lit(3)) + F.col("u") * (F.pow("b", F.lit(3)) - F.pow("a", F.lit(3))))
    inside = F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) * r <= half
    return placed.groupBy("shell").agg(F.avg(inside.cast("double")).alias("share"))


def split_evenly(samples: DataFrame, parts: int, order: str = "sample") -> DataFrame:
    """``samples`` with the number of its part; the first parts are larger."""
    placed = ranked(samples, [order], "_rank", "_total")
    return placed.withColumn("part", even_part(F.col("_rank"), F.col("_total"), parts)).drop("_rank", "_total")


#: Priority, observations and programme of each target class (fixed values).
TARGETS = {"LRG": (3200, 2, "DARK"), "QSO": (3400, 4, "DARK"), "ELG_HIP": (3200, 2, "DARK"), "ELG_LOP": (3100, 2, "DARK"), "ELG_VLO": (3000, 2, "DARK"), "BGS": (2100, 1, "BRIGHT")}


def target_columns(rows: DataFrame, tracer: str = "tracer", targets: dict = TARGETS) -> DataFrame:
    """``rows`` with priority, numbers of observations and programme of their class; an unknown class raises."""
    known = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("p"), F.lit(v[1]).alias("n"), F.lit(v[2]).alias("o")))])
    found = F.coalesce(known[F.col(tracer)], F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(tracer), F.lit("null")))))
    out = rows.withColumn("_t", found)
    return out.select(*rows.columns, F.col("_t.p").alias("priority_init"), F.col("_t.p").alias("priority"), F.col("_t.n").alias("numobs_init"), F.col("_t.n").alias("numobs_more"), F.col("_t.o").alias("obsconditions"))


def permuted_ids(rows: DataFrame, key: str, seed: int = 0, name: str = "target_id") -> DataFrame:
    """``rows`` with numbers from 1 in a scattered order, the same in every run: that of a hash of key and seed."""
    mixed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    return ranked(mixed, ["_h"], name, "_total").withColumn(name, F.col(name) + 1).drop("_h", "_total")


def jittered(points: DataFrame, sigma: float, box: float, seed: int = 42) -> DataFrame:
    """Points moved by a normal step along each axis, wrapped into the box."""
    return points.withColumns({c: F.pmod(F.col(c) + F.randn(seed + i) * sigma, F.lit(float(box))) for i, c in enumerate("xyz")})


def sub_box(x: Column, y: Column, z: Column, box: float, split: int) -> Column:
    """Number of the half-open sub-box of a position, ``split`` along each axis."""
    ix, iy, iz = (F.least(F.floor(c * split / box), F.lit(split - 1)) for c in (x, y, z))
    return ((ix * split + iy) * split + iz).cast("int")


def parameter_lists(all_names: list[str], fixed: dict[str, float] | None = None, free: list[str] | None = None) -> tuple[list[str], dict[str, float]]:
    """(free names in order, fixed values): what isn't named free, or is given a value, is fixed; unknown names raise."""
    fixed = dict(fixed or {})
    check_parameters(set(all_names), set(fixed) | set(free or []))
    left = [n for n in all_names if n not in fixed and (free is None or n in free)]
    lacking = [n for n in all_names if n not in fixed and n not in left]
    if lacking:
        raise ValueError(f"neither free nor fixed: {lacking}")
    return left, fixed

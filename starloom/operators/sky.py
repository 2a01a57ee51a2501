"""Survey geometry: regions, redshift selections, box copies, snapshots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_region(region: str, ra: Column, dec: Column) -> Column:
    """Survey regions by right ascension and declination in degrees."""
    cap = (ra > 100 - dec) & (ra < 280 + dec)
    north = cap & (dec > 32.375)
    rules = {"NGC": cap, "SGC": ~cap, "N": north, "S": ~north & (dec > -25), "SNGC": ~north & (dec > -25) & cap, "SSGC": ~north & (dec > -25) & ~cap}
    if region not in rules:
        raise ValueError(f"unknown region {region!r}; known are {sorted(rules)}")
    return rules[region]


def in_photometry(region: str, ra: Column, dec: Column) -> Column:
    """Photometric regions where no footprint file is at hand."""
    cap = (ra > 100 - dec) & (ra < 280 + dec)
    if region == "N":
        return dec > 32.375
    south = dec < 32.375
    rules = {"S": south, "DN": south & cap, "SNGC": south & cap, "DS": south & (dec > -25) & ~cap, "SSGC": south & (dec > -25) & ~cap}
    if region not in rules:
        raise ValueError(f"region {region!r} is unknown or needs a footprint")
    return rules[region]


def interpolate(x: Column, table: list[tuple[float, float]]) -> Column:
    """Piecewise linear through a small sorted table, constant beyond its ends."""
    (x0, y0), (xn, yn) = table[0], table[-1]
    out = F.when(x <= x0, F.lit(float(y0)))
    for (a, ya), (b, yb) in zip(table, table[1:], strict=False):
        out = out.when(x <= b, F.lit(float(ya)) + (x - F.lit(float(a))) * F.lit((yb - ya) / (b - a)))
    return out.otherwise(F.lit(float(yn)))


def interpolate_join(df: DataFrame, x: str, table: DataFrame, grid: str, value: str, out: str) -> DataFrame:
    """:func:`interpolate` for a regular table of any length: an equality join on the bracket's number.

    ``table`` has (``grid``, ``value``) at equal steps.
    """
    from pyspark.sql import Window

    ends = table.agg(F.min(grid).alias("_a"), F.max(grid).alias("_b"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(grid)
    brackets = table.select(F.col(grid).alias("_x0"), F.col(value).alias("_y0"), F.lead(value).over(w).alias("_y1"), (F.row_number().over(w) - 1).cast("long").alias("_i"))
    placed = df.crossJoin(F.broadcast(ends))
    step = (F.col("_b") - F.col("_a")) / (F.col("_n") - 1)
    at = F.least(F.greatest(F.col(x), F.col("_a")), F.col("_b"))
    placed = placed.withColumn("_at", at).withColumn("_step", step).withColumn("_i", F.least(F.floor((F.col("_at") - F.col("_a")) / F.col("_step")), F.col("_n") - 2).cast("long"))
    y = F.col("_y0") + (F.col("_at") - F.col("_x0")) / F.col("_step") * (F.col("_y1") - F.col("_y0"))
    return placed.join(brackets, "_i").select(*df.columns, y.alias(out))


def radial_ratio(counts: DataFrame, targets: dict[int, float], edges: list[float], distance, sky_fraction: float, shape_only: bool = False) -> DataFrame:
    """(bin, ratio): share of each redshift bin to keep so that its density meets the target.

    ``counts`` has (bin, n). Volumes are those of shells between the edges.
    """
    spark = counts.sparkSession
    rows = []
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        volume = sky_fraction * 4 / 3 * math.pi * (distance(b) ** 3 - distance(a) ** 3)
        rows.append((i, float(volume), float(targets.get(i, 0.0))))
    shells = spark.createDataFrame(rows, "bin int, volume double, target double")
    ratio = shells.join(counts, "bin", "left").select("bin", (F.col("target") / (F.col("n") / F.col("volume"))).alias("ratio"))
    if shape_only:
        top = ratio.agg(F.max("ratio").alias("_top"))
        ratio = ratio.crossJoin(F.broadcast(top)).select("bin", (F.col("ratio") / F.col("_top")).alias("ratio"))
    return ratio


def thin(df: DataFrame, ratio: Column, seed: int = 42) -> DataFrame:
    """Rows kept at random with the given probability."""
    return df.where(F.rand(seed) < ratio)


def replicate(points: DataFrame, box: float, bounds: dict[str, tuple[float, float]], pad: float = 0.0) -> DataFrame:
    """All periodic copies that lie strictly within ``bounds`` per axis, with their shifts."""
    out = points
    for c in "xyz":
        low, high = bounds[c]
        first, last = math.floor((low + pad) / box), math.ceil((high - pad) / box)
        out = out.withColumn(f"s{c}", F.explode(F.sequence(F.lit(first), F.lit(max(first, last)))))
        out = out.withColumn(c, F.col(c) + F.col(f"s{c}") * box).where((F.col(c) > low) & (F.col(c) < high))
    return out


def mirror(points: DataFrame, velocities: bool = True) -> DataFrame:
    """Eight copies with all sign combinations of the axes; velocities turn along."""
    signs = F.array(*[F.struct(*[F.lit(s).alias(c) for s, c in zip((1 - 2 * (k & 1), 1 - 2 * (k >> 1 & 1), 1 - 2 * (k >> 2)), "xyz", strict=True)]) for k in range(8)])
    out = points.withColumn("_s", F.explode(signs))
    for c in "xyz":
        out = out.withColumn(c, F.col(c) * F.col(f"_s.{c}"))
        if velocities and f"v{c}" in points.columns:
            out = out.withColumn(f"v{c}", F.col(f"v{c}") * F.col(f"_s.{c}"))
    return out.drop("_s")


def snapshots(available: list[float], low: float, high: float) -> list[float]:
    """Snapshots for a redshift range: those nearest its ends, all between, one more above."""
    table = sorted(available)
    first = min(range(len(table)), key=lambda i: (abs(table[i] - low), i))
    last = min(range(len(table)), key=lambda i: (abs(table[i] - high), i))
    return table[min(first, last) : min(len(table), max(first, last) + 2)]


def sphere_fraction(n: int, region: str) -> float:
    """Share of the sphere in a region, from ``n`` Fibonacci points."""
    golden = (1 + 5**0.5) / 2
    hit = 0
    for i in range(n):
        dec = math.degrees(math.acos(1 - 2 * (i + 0.5) / n)) - 90
        ra = 360.0 * (i / golden % 1)
        cap = 100 - dec < ra < 280 + dec
        north = cap and dec > 32.375
        south = not north and dec > -25
        hit += {"NGC": cap, "SGC": not cap, "N": north, "S": south, "SNGC": south and cap, "SSGC": south and not cap}[region]
    return hit / n


def check_bounds(points: DataFrame, length: float, low: float = 0.0) -> DataFrame:
    """``points``, evaluated only if all coordinates lie in [low, low + length)."""
    fine = None
    for c in "xyz":
        ok = (F.col(c) >= low) & (F.col(c) < low + length)
        fine = ok if fine is None else fine & ok
    return points.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit(f"a coordinate lies outside of [{low}, {low + length})")).cast("boolean")))


def pixel(ra: Column, dec: Column, nside: int) -> Column:
    """Number of the equal-area pixel of a direction in degrees, rings counted from the north pole."""
    n = nside
    z, turn = F.sin(F.radians(dec)), F.pmod(ra, F.lit(360.0)) / 90.0
    # belt around the equator: rows of 4 n pixels, shifted by half a pixel in every other one
    up, down = F.floor(n * (0.5 + turn) - n * z * 0.75), F.floor(n * (0.5 + turn) + n * z * 0.75)
    ring = n + 1 + up - down
    odd = F.pmod(ring + 1, F.lit(2))
    place = F.pmod(F.floor((up + down - n + odd + 1) / 2), F.lit(4 * n))
    belt = 2 * n * (n - 1) + (ring - 1) * 4 * n + place
    # caps: rows of 4, 8, 12, ... pixels from the pole
    part, span = turn - F.floor(turn), n * F.sqrt(3 * (1 - F.abs(z)))
    row = F.floor(part * span) + F.floor((1 - part) * span) + 1
    at = F.pmod(F.floor(turn * row), 4 * row)
    cap = F.when(z > 0, 2 * row * (row - 1) + at).otherwise(12 * n * n - 2 * row * (row + 1) + at)
    return F.when(F.abs(z) <= 2 / 3, belt).otherwise(cap).cast("long")


def on_pixels(rows: DataFrame, mask: DataFrame, column: str = "pix") -> DataFrame:
    """Rows whose pixel is in the mask."""
    return rows.join(mask.select(column), column, "left_semi")


def covered(mask: DataFrame, nside: int) -> DataFrame:
    """One row: the share of the sphere that the pixels of a mask cover."""
    return mask.agg((F.count_distinct("pix") / float(12 * nside * nside)).alias("fraction"))


def unmasked(maps: DataFrame, value: str) -> DataFrame:
    """A map with 0, which marks masked pixels, as null."""
    return maps.withColumn(value, F.nullif(F.col(value), F.lit(0)))


def nearest(rows: DataFrame, groups: list, label: str, value: str, target: float) -> DataFrame:
    """(groups, nearest): the label whose value is nearest the target, ties to the smaller label."""
    return rows.groupBy(*groups).agg(F.min_by(label, F.struct(F.abs(F.col(value) - target), F.col(label))).alias("nearest"))


def density_ceiling(rows: DataFrame, group: str, column: str, low: float, high: float, width: float, margin: float = 1.1) -> DataFrame:
    """(group, top): the largest count per unit of ``column`` within [low, high), with a margin."""
    bins = rows.where((F.col(column) >= low) & (F.col(column) < high)).groupBy(group, F.floor(F.col(column) / width).alias("_b")).agg((F.count(F.lit(1)) / float(width)).alias("_nz"))
    return bins.groupBy(group).agg((F.max("_nz") * margin).alias("top"))


def in_boxes(x: Column, y: Column, z: Column, side: float) -> Column:
    """The L of three boxes that a lightcone is cut from: the one at the origin and those above it in y and z."""
    return (x < side) & (y < 2 * side) & (z < 2 * side) & ((y < side) | (z < side))


def shell_in_boxes(samples: DataFrame, side: float, low: float, high: float) -> DataFrame:
    """One row: the volume of a spherical shell about the origin within the L of boxes.

    ``samples`` are uniform points (ux, uy, uz) of the unit cube; each serves all three boxes.
    """
    boxes = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(shift, "abc", strict=True)]) for shift in ((0, 0, 0), (0, side, 0), (0, 0, side))])
    placed = samples.select("ux", "uy", "uz", F.explode(boxes).alias("s"))
    r2 = sum((F.pow(F.col(f"u{c}") * side + F.col(f"s.{k}"), F.lit(2)) for c, k in (("y", "b"), ("z", "c"))), F.pow(F.col("ux") * side + F.col("s.a"), F.lit(2)))
    inside = ((r2 > low * low) & (r2 < high * high)).cast("double")
    return placed.agg((F.avg(inside) * (3 * side**3)).alias("volume"))


def lightcone_density(rows: DataFrame, samples: DataFrame, side: float, low: float, high: float, full_sky: bool = False) -> DataFrame:
    """One row: objects per volume of a lightcone's shell; a mirrored full sky has eight times the volume."""
    volume = shell_in_boxes(samples, side, low, high)
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(volume)).select("n", (F.col("n") / (F.col("volume") * (8 if full_sky else 1))).alias("density"))


def lightcone_randoms(randoms: DataFrame, side: float) -> DataFrame:
    """Random directions and distances (ra, dec, distance) with their positions, within the L of boxes."""
    from starloom.functions.geometry import sky_to_cartesian

    placed = randoms.withColumns(dict(zip("xyz", sky_to_cartesian(F.col("ra"), F.col("dec"), F.col("distance")), strict=True)))
    return placed.where(in_boxes(F.col("x"), F.col("y"), F.col("z"), side))


def near_faces(points: DataFrame, box: float, reach: float) -> DataFrame:
    """Points with their periodic copies within ``reach`` outside of any face, edge or corner."""
    bounds = {c: (-reach, box + reach) for c in "xyz"}
    return replicate(points, box, bounds)

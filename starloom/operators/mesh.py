"""Fields on a periodic cubic mesh: painting, contrast, smoothing, readout.

Meshes are long tables (ix, iy, iz, value); cells without points are absent
until a lattice is joined in, and count in every mean. Painting explodes each
point into its corners and sums them per cell, with partial sums before the
shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ("ix", "iy", "iz")


def corner_weights(kind: str, x: Column, cell: int) -> list[tuple[Column, Column]]:
    """(cell index, weight) of a coordinate; weights add up to ``weight_unit`` and are integers but for ``pcs``.

    ``ngp``: its own cell. ``cic``: shares of the two nearest lower corners.
    ``tsc``: shares of the three cells around it, by quadratic splines about
    cell centres. ``pcs``: shares of the four nearest lower corners, by cubic
    splines.
    """
    i = F.floor(x / cell).cast("long")
    d = x - i * cell
    if kind == "ngp":
        return [(i, F.lit(1).cast("long"))]
    if kind == "cic":
        return [(i, cell - d), (i + 1, d)]
    if kind == "tsc":
        # in units of cell**2 / 8, with u = 2d - cell twice the offset from the centre
        u = 2 * d - cell
        return [(i - 1, (cell - u) * (cell - u)), (i, 6 * F.lit(cell * cell) - 2 * u * u), (i + 1, (cell + u) * (cell + u))]
    if kind == "pcs":
        # shares by distance from each of the four nearest lower corners, as doubles: integers would overflow
        u = d / float(cell)

        def near(a: Column) -> Column:
            return (4 - 6 * a * a + 3 * a * a * a) / 6

        def far(a: Column) -> Column:
            return (2 - a) * (2 - a) * (2 - a) / 6

        return [(i - 1, far(u + 1)), (i, near(u)), (i + 1, near(1 - u)), (i + 2, far(2 - u))]
    raise ValueError(f"unknown resampler {kind!r}")


def weight_unit(kind: str, cell: int) -> int:
    return {"ngp": 1, "cic": cell, "tsc": 8 * cell * cell, "pcs": 1}[kind] ** 3


def corners(points: DataFrame, cells: int, cell: int, kind: str, wrap: bool = True) -> DataFrame:
    """Points once per corner, with ix, iy, iz and the integer share ``_share``.

    Without wrapping, what falls beyond the last cell is lost.
    """
    sides = [F.array(*[F.struct(i.alias("i"), w.alias("w")) for i, w in corner_weights(kind, F.col(c), cell)]) for c in ("x", "y", "z")]
    out = points.select("*", F.explode(sides[0]).alias("_x")).select("*", F.explode(sides[1]).alias("_y")).select("*", F.explode(sides[2]).alias("_z"))
    at = [F.col(f"_{c}.i") for c in "xyz"]
    if not wrap:
        out = out.where(at[0].between(0, cells - 1) & at[1].between(0, cells - 1) & at[2].between(0, cells - 1))
    share = F.col("_x.w") * F.col("_y.w") * F.col("_z.w")
    placed = out.select(*points.columns, *[F.pmod(a, F.lit(cells)).cast("int").alias(c) for a, c in zip(at, CELL, strict=True)], share.alias("_share"))
    return placed.where(F.col("_share") != 0)


def paint(points: DataFrame, cells: int, cell: int, kind: str = "cic", weight: str | None = "w", wrap: bool = True) -> DataFrame:
    """(ix, iy, iz, value): weight per cell. Integer inputs are summed exactly."""
    w = F.col(weight) if weight else F.lit(1)
    return corners(points, cells, cell, kind, wrap).groupBy(*CELL).agg((F.sum(F.col("_share") * w) / float(weight_unit(kind, cell))).alias("value"))


def full(mesh: DataFrame, cells: int, empty: float = 0.0) -> DataFrame:
    """Every cell, empty ones too."""
    n = F.lit(cells)
    flat = mesh.sparkSession.range(cells**3)
    grid = flat.select(F.floor(F.col("id") / (n * n)).cast("int").alias("ix"), (F.floor(F.col("id") / n) % n).cast("int").alias("iy"), (F.col("id") % n).cast("int").alias("iz"))
    return grid.join(mesh, list(CELL), "left").fillna(empty, ["value"])


def contrast(mesh: DataFrame, cells: int) -> DataFrame:
    """value / mean - 1 over all cells of the box."""
    mean = mesh.agg((F.sum("value") / float(cells**3)).alias("_mean"))
    return full(mesh, cells).crossJoin(F.broadcast(mean)).select(*CELL, (F.col("value") / F.col("_mean") - 1).alias("value"))


def random_threshold(randoms: DataFrame, factor: float, method: str, cells: int, weight: str = "w") -> DataFrame:
    """One row: cells below ``threshold`` count as outside of the survey."""
    w = F.col(weight)
    if method == "noise":
        value = factor * F.sum(w * w) / F.sum(w)
    elif method == "mean":
        value = factor * F.sum(w) / float(cells**3)
    else:
        raise ValueError(f"unknown threshold {method!r}")
    return randoms.agg(value.alias("threshold"))


def survey_contrast(data: DataFrame, randoms: DataFrame, threshold: DataFrame, cells: int) -> DataFrame:
    """(data - a randoms) / (a randoms) where there are enough randoms, else 0."""
    d, r = data.select(*CELL, F.col("value").alias("d")), randoms.select(*CELL, F.col("value").alias("r"))
    alpha = data.agg(F.sum("value").alias("sd")).crossJoin(randoms.agg(F.sum("value").alias("sr"))).select((F.col("sd") / F.col("sr")).alias("alpha"))
    both = full(d.withColumn("value", F.col("d")).drop("d"), cells).withColumnRenamed("value", "d").join(r, list(CELL), "left").fillna(0.0, ["r"])
    joined = both.crossJoin(F.broadcast(alpha)).crossJoin(F.broadcast(threshold))
    ar = F.col("alpha") * F.col("r")
    return joined.select(*CELL, F.when(F.col("r") > F.col("threshold"), (F.col("d") - ar) / ar).otherwise(0.0).alias("value"))


def gaussian_weights(cells: int, cell: float, radius: float) -> list[float]:
    """Circular kernel along one axis: the inverse transform of exp(-k^2 R^2 / 2)."""
    out = []
    for j in range(cells):
        total = 0.0
        for m in range(cells):
            f = m if m <= cells // 2 else m - cells
            k = 2 * math.pi * f / (cells * cell)
            total += math.exp(-k * k * radius * radius / 2) * math.cos(2 * math.pi * m * j / cells)
        out.append(total / cells)
    return out


def smooth(mesh: DataFrame, cells: int, cell: float, radius: float) -> DataFrame:
    """Gaussian smoothing as three circular convolutions, one axis at a time.

    A line of cells is gathered per pair of the other axes: ``cells`` numbers,
    whatever the number of points.
    """
    weights = F.array(*[F.lit(w) for w in gaussian_weights(cells, cell, radius)])
    out = full(mesh, cells)
    for axis in CELL:
        others = [c for c in CELL if c != axis]
        lines = out.groupBy(*others).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "value"))), lambda s: s["value"]).alias("_line"))
        index = F.sequence(F.lit(0), F.lit(cells - 1))
        made = F.transform(index, lambda i: F.aggregate(F.zip_with("_line", index, lambda v, j: v * F.get(weights, F.pmod(i - j, F.lit(cells)))), F.lit(0.0), lambda a, v: a + v))
        out = lines.select(*others, F.posexplode(made).alias(axis, "value")).select(*CELL, "value")
    return out


def readout(mesh: DataFrame, points: DataFrame, cells: int, cell: int, kind: str = "cic", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, value): the field at points, interpolated with the painting weights."""
    at = corners(points, cells, cell, kind)
    joined = at.join(mesh, list(CELL))
    return joined.groupBy(*keep).agg((F.sum(F.col("_share") * F.col("value")) / float(weight_unit(kind, cell))).alias("value"))


def density_ratio(data: DataFrame, randoms: DataFrame, threshold: DataFrame, cells: int) -> DataFrame:
    """Density over the expected one where there are enough randoms; ``EMPTY`` elsewhere, above every real value."""
    sums = data.agg(F.sum("value").alias("sd")).crossJoin(randoms.agg(F.sum("value").alias("sr"))).select((F.col("sd") / F.col("sr")).alias("alpha"))
    r = randoms.select(*CELL, F.col("value").alias("r"))
    both = full(data, cells).join(r, list(CELL), "left").fillna(0.0, ["r"]).crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(threshold))
    return both.select(*CELL, F.when(F.col("r") > F.col("threshold"), F.col("value") / (F.col("alpha") * F.col("r"))).otherwise(EMPTY).alias("value"))


#: Marks cells outside of a survey (fixed value).
EMPTY = 0.9e30

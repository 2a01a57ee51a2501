"""From many measurements to one labelled table: combination, rebinning, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.ranks import quantiles


def combine_los(rows: DataFrame, los: str, sample: tuple[str, ...], axis: str, value: str = "value") -> DataFrame:
    """(sample, axis, value): each line of sight normalised to one, then added over those there are."""
    norm = rows.groupBy(*sample, los).agg(F.sum(value).alias("_n"))
    joined = rows.join(norm, [*sample, los])
    return joined.groupBy(*sample, axis).agg(F.sum(F.col(value) / F.col("_n")).alias(value))


def rebin(rows: DataFrame, axis: str, factor: int, first: int = 0, value: str = "value") -> DataFrame:
    """Neighbouring bins of an integer axis merged: values added, ``centre`` the mean label."""
    others = [c for c in rows.columns if c not in (axis, value)]
    return rows.groupBy(*others, F.floor((F.col(axis) - first) / factor).alias("_b")).agg(F.sum(value).alias(value), F.avg(axis).alias("centre")).withColumnRenamed("_b", axis)


def over_parent(rows: DataFrame, order: str, parent: int, on: tuple[str, ...], value: str = "value") -> DataFrame:
    """Rows of other orders, divided by the row of order ``parent`` with the same keys."""
    base = rows.where(F.col(order) == parent).select(*on, F.col(value).alias("_p"))
    return rows.where(F.col(order) != parent).join(base, list(on)).withColumn(value, F.col(value) / F.col("_p")).drop("_p")


def scale_orders(rows: DataFrame, order: str, length: float, value: str = "value") -> DataFrame:
    """Values times ``length`` to the power of their order."""
    return rows.withColumn(value, F.col(value) * F.pow(F.lit(float(length)), F.col(order)))


def informative(rows: DataFrame, features: tuple[str, ...], value: str, floor: float) -> DataFrame:
    """Rows of the features whose mean lies strictly between ``floor`` and 1 - ``floor``."""
    keep = rows.groupBy(*features).agg(F.avg(value).alias("_m")).where((F.col("_m") > floor) & (F.col("_m") < 1 - floor)).select(*features)
    return rows.join(keep, list(features), "left_semi")


def quantile_grid(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(step, threshold): interpolated quantiles at 0, 1/n, ..., 1."""
    return quantiles(rows, value, [i / n for i in range(n + 1)]).select(F.posexplode("quantiles").alias("step", "threshold"))


def open_quantiles(rows: DataFrame, value: str, n: int) -> DataFrame:
    """Rows strictly between two neighbouring quantiles, with their ``sample`` number."""
    edges = quantiles(rows, value, [i / n for i in range(n + 1)]).select(F.col("quantiles").alias("_q"))
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("sample", F.aggregate("_q", F.lit(-1), lambda a, e: a + (e < F.col(value)).cast("int")))
    inside = (F.col("sample") >= 0) & (F.col("sample") < n) & (F.col(value) < F.get("_q", F.col("sample") + 1))
    return placed.where(inside).drop("_q")


def zone_cuts(zones: DataFrame, void_below: float, cluster_above: float) -> DataFrame:
    """``void`` and ``cluster``: unmasked zones away from edges, by core density, both ends open."""
    fine = (F.col("flag") == 0) & (F.col("veto") == 1)
    return zones.withColumn("void", fine & (F.col("core") < void_below)).withColumn("cluster", fine & (F.col("core") > cluster_above))


def redshift_cut(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Rows with ``veto`` 1 strictly between two redshifts."""
    return rows.where((F.col("veto") == 1) & (F.col("z") > low) & (F.col("z") < high))


def voxel_mask(randoms: DataFrame, least: float) -> DataFrame:
    """``masked`` is 1 where a cell holds at most ``least`` randoms."""
    return randoms.withColumn("masked", F.when(F.col("value") <= least, 1).otherwise(0))


def log_value(value: str, shift: float = 0.0):
    return F.log10(F.col(value) + shift)


def asinh_value(value: str):
    return F.asinh(value)


def triangle_weight(rows: DataFrame, sides: tuple[str, str, str], value: str = "value", scale: float = 1e5) -> DataFrame:
    """Values times the product of the three sides, over a scale."""
    return rows.withColumn(value, F.col(sides[0]) * F.col(sides[1]) * F.col(sides[2]) * F.col(value) / scale)


def per_volume(rows: DataFrame, value: str = "value", factor: float = 64.0) -> DataFrame:
    """Values of small mocks over the volume they lack, for sums over sub-boxes."""
    return rows.withColumn(value, F.col(value) / factor)


def compatible(*tables: DataFrame, keys: tuple[str, ...] = ()) -> None:
    """Raises unless all tables have the same columns and, in ``keys``, the same labels."""
    first = tables[0]
    for other in tables[1:]:
        if other.columns != first.columns:
            raise ValueError(f"columns differ: {first.columns} and {other.columns}")
        for key in keys:
            a, b = first.select(key).distinct(), other.select(key).distinct()
            if not a.exceptAll(b).unionByName(b.exceptAll(a)).isEmpty():
                raise ValueError(f"labels of {key} differ")

"""Global order without a global window: ranks, even splits and exact quantiles of whole tables.

Rows are dealt out by ranges and sorted there; the counts of the ranges, one row
per task, give each range its offset. The table is written down between the two
steps, so both see the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starloom.sources.shared import cut_lineage


def ranked(df: DataFrame, order: list[str], rank: str = "rank", total: str = "total") -> DataFrame:
    """``df`` with each row's rank from 0 and the number of rows; ties in ``order`` in no particular order."""
    own = F.monotonically_increasing_id()
    # the id's high bits are the range, its low bits the place there
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_at", own)
    placed = cut_lineage(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))), "ranks")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range of the sort: as many as there are tasks
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias(total))
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(rank, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running_sum(df: DataFrame, order: str, value: str) -> DataFrame:
    """``df`` with ``sum``, that of ``value`` up to and with the row in the order of ``order``, and the ``total``."""
    placed = df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id())
    placed = cut_lineage(placed, "ranges")
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("sum", inside).join(F.broadcast(offsets), "_part").withColumn("sum", F.col("sum") + F.col("_before")).drop("_part", "_before")


def even_part(rank: Column, total: Column, parts: int) -> Column:
    """Part, from 0, of the row of this rank among so many, dealt evenly, the first parts larger."""
    base, extra = F.floor(total / parts), total % parts
    edge = extra * (base + 1)
    return F.when(rank < edge, F.floor(rank / (base + 1))).otherwise(extra + F.floor((rank - edge) / F.greatest(base, F.lit(1)))).cast("int")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row, one array: the quantiles, interpolated between neighbours, of the values that are not null.

    Only the few rows at the ranks asked for are gathered.
    """
    rows = ranked(df.select(F.col(column).cast("double").alias("v")).where("v is not null"), ["v"])
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares)])
    place = F.col("a.q") * (F.col("total") - 1)
    low = F.floor(place)
    picked = rows.select("v", "rank", "total", F.explode(asked).alias("a")).where((F.col("rank") == low) | (F.col("rank") == low + 1))
    at = picked.groupBy("a.i").agg(F.min(F.struct("rank", "v"))["v"].alias("low"), F.max(F.struct("rank", "v"))["v"].alias("high"), F.any_value(place - low).alias("part"))
    value = F.when(F.col("part") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    ordered = F.array_sort(F.collect_list(F.struct("i", value.alias("v"))))
    return at.agg(F.transform(ordered, lambda x: x["v"]).alias("quantiles"))

"""Neighbour joins by cell lists.

Both sides are keyed by the mesh cell they lie in; one side is repeated for the
neighbouring cells, so the join is a sort-merge equality on one number, with the
distance as a residual. The cell is at least the search radius. In self-joins
only half of the neighbours are visited. Counts need each position only once,
with the number of its points (:func:`positions`).
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starloom.functions.geometry import AXES, min_image
from starloom.sources.shared import cut_lineage


#: Points of a cell in one row.
PACK = 1024


def cells_per_side(box: float, radius: float) -> int:
    return max(1, int(box // radius))


def _offsets(n: int, half: bool) -> list[tuple[int, int, int]]:
    """Distinct neighbour offsets; with fewer than three cells images coincide."""
    span = range(-1, 2) if n >= 3 else range(n)
    out = list(product(span, repeat=3))
    # of each pair of opposite offsets one will do, but only if they are distinct cells
    return [o for o in out if o >= (0, 0, 0)] if half and n >= 3 else out


def _cell(index: list[Column], n: int) -> Column:
    ix, iy, iz = index
    return (ix * n + iy) * n + iz


def cell_pairs(left: DataFrame, right: DataFrame | None, radius: float, box: float, *, periodic: bool = True, keep: tuple[str, ...] = (), by: tuple[str, ...] = (), moved: str = "left") -> DataFrame:
    """Pairs within ``radius``: a_*, b_* columns, dx, dy, dz (b minus a) and d2.

    ``right=None`` joins ``left`` with itself: every unordered pair once, of
    different ids or, where there is no id, of points that differ in position.
    Coincident points are pairs at distance 0. Columns ``keep`` are carried
    along besides id (if present); pairs agree in the columns ``by``, which keep
    their names. The side ``moved``, best the smaller one, is sent to all
    neighbouring cells; it is never broadcast, as the planner takes the copies
    for no larger than the table.
    """
    auto = right is None
    n = cells_per_side(box, radius)
    size = box / n

    def indexed(df):
        carried = [F.col(c) for c in ("id", *keep) if c in df.columns]
        index = [F.least(F.floor(F.col(c) / size), F.lit(n - 1)).cast("long") for c in AXES]
        return df.select(_cell(index, n).alias("_cell"), *by, *carried, *AXES)

    # a cell's points meet as arrays, so the join sees cells and the pairs run inside one loop of generated code
    sides = {"a": packed(indexed(left), by), "b": packed(indexed(left if auto else right), by)}
    go, stay = ("a", "b") if auto or moved == "left" else ("b", "a")
    half = auto and n >= 3
    moves = F.array(*[F.struct(*[F.lit(o).cast("long").alias(c) for o, c in zip(move, AXES, strict=True)]) for move in _offsets(n, auto)])
    sent = sides[go].withColumn("_m", F.explode(moves))
    at = [F.floor(F.col("_cell") / (n * n)), F.floor(F.col("_cell") / n) % n, F.col("_cell") % n]
    to = [i + F.col(f"_m.{c}") for i, c in zip(at, AXES, strict=True)]
    if not periodic and n >= 3:
        inside = [t.between(0, n - 1) for t in to]
        sent = sent.where(inside[0] & inside[1] & inside[2])
    here = (F.col("_m.x") == 0) & (F.col("_m.y") == 0) & (F.col("_m.z") == 0)
    # with three cells or more, the move tells which image is the nearest one: nothing is left to choose per pair
    known = periodic and n >= 3
    shifts = [(F.lit(-box) * F.floor(t / n)).alias(f"_s{c}") for t, c in zip(to, AXES, strict=True)] if known else []
    sent = sent.select(_cell([F.pmod(t, F.lit(n)) for t in to], n).cast("long").alias("_cell"), *by, here.alias("_same"), *shifts, F.col("_points").alias(f"_{go}"))
    near = sent.join(sides[stay].withColumnRenamed("_points", f"_{stay}").hint("merge"), ["_cell", *by])

    def opened(df, side):
        fields = df.schema[f"_{side}"].dataType.elementType.names
        return df.select(*[c for c in df.columns if c != f"_{side}"], F.inline(f"_{side}").alias(*[f"{side}_{c}" for c in fields]))

    pairs = opened(opened(near, go), stay)
    d = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in AXES]
    if known:
        d = [v - F.col(f"_s{c}") if go == "a" else v + F.col(f"_s{c}") for v, c in zip(d, AXES, strict=True)]
    elif periodic:
        d = [min_image(v, box) for v in d]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    rule = d2 <= F.lit(radius) * F.lit(radius)
    if auto:
        x, y, z = [(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in AXES]
        order = F.col("a_id") < F.col("b_id") if "id" in left.columns else (x[0] < x[1]) | ((x[0] == x[1]) & ((y[0] < y[1]) | ((y[0] == y[1]) & (z[0] < z[1]))))
        rule = rule & (F.when(F.col("_same"), order).otherwise(F.lit(True)) if half else order)
    pairs = pairs.where(rule)
    return pairs.select(*[c for c in pairs.columns if c[0] != "_"], *[v.alias(f"d{c}") for v, c in zip(d, AXES, strict=True)], d2.alias("d2"))


def packed(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(_cell, by, _points): the points of each cell, at most about ``PACK`` in one row; fuller cells have several rows."""
    keys = ["_cell", *by]
    columns = [c for c in points.columns if c not in keys]
    parts = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PACK).alias("_parts"))
    dealt = points.join(parts.hint("shuffle_hash"), keys).withColumn("_part", F.pmod(F.xxhash64(*columns), F.col("_parts")))
    return dealt.groupBy(*keys, "_part").agg(F.collect_list(F.struct(*columns)).alias("_points")).select(*keys, "_points")


def positions(points: DataFrame, *, weights: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, y, z, m, n, n2): rows at each position, and sums of their weights (or ones) and of the squares."""
    w = F.col("w") if weights else F.lit(1).cast("long")
    return points.groupBy(*by, *AXES).agg(F.count(F.lit(1)).alias("m"), F.sum(w).alias("n"), F.sum(w * w).alias("n2"))


def radius_pairs(points: DataFrame, r_max: float, r_perp_max: float, box: float) -> DataFrame:
    """Links, a_id < b_id: distance at most ``r_max`` and, strictly, less than ``r_perp_max`` across the line of sight."""
    near = cell_pairs(points, None, r_max, box)
    across = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    links = near.where(across < r_perp_max * r_perp_max)
    turned = F.col("a_id") > F.col("b_id")
    ends = [F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")]
    return links.select(*ends, *[F.when(turned, -F.col(c)).otherwise(F.col(c)).alias(c) for c in ("dx", "dy", "dz")], "d2")


def group_edges(points: DataFrame, r_max: float, r_perp_max: float, box: float) -> DataFrame:
    """(a_id, b_id): enough of the links of :func:`radius_pairs` that components and points without links are theirs.

    Of points at one position the first, by id, is linked to the others, and
    the only one that is linked to other positions.
    """
    there = points.where((F.col("x") - F.col("x") == 0) & (F.col("y") - F.col("y") == 0) & (F.col("z") - F.col("z") == 0))
    first = cut_lineage(there.groupBy(*AXES).agg(F.min("id").alias("id")), "positions")
    copies = there.join(first.withColumnRenamed("id", "a_id").hint("merge"), list(AXES)).where("id <> a_id").select("a_id", F.col("id").alias("b_id"))
    return radius_pairs(first, r_max, r_perp_max, box).select("a_id", "b_id").unionByName(copies)


def knn(queries: DataFrame, points: DataFrame, k: int, box: float, *, radius: float | None = None, exclude_self: bool = False) -> DataFrame:
    """The ``k`` nearest points of every query: (q_id, rank, id, dx, dy, dz, d2), ties to the smaller id.

    The first radius is the one within which a point of the mean density has
    enough neighbours in nearly all cases. A query is settled once it has ``k``
    neighbours within the radius; only the others are searched again, with twice
    the radius. Each round is written down, so no plan holds the ones before. The
    few queries left when the radius spans the box, in tables that hold hardly
    more than ``k`` points, are held against all points in blocks.
    """
    need = k + exclude_self
    if radius is None:
        count = max(1, points.count())
        radius = box * ((need + 3 * need**0.5 + 2) / (4 / 3 * pi * count)) ** (1 / 3)
    order = Window.partitionBy("a_id").orderBy("d2", "b_id")
    found, todo = [], queries
    while True:
        whole = cells_per_side(box, radius) == 1
        near = blocked_pairs(todo, points, box) if whole else cell_pairs(todo, points, radius, box)
        if exclude_self:
            near = near.where(F.col("a_id") != F.col("b_id"))
        rank = F.row_number().over(order)
        ranked = cut_lineage(near.withColumn("rank", rank).where(F.col("rank") <= k), "near")
        if whole:
            found.append(ranked)
            break
        settled = ranked.where(F.col("rank") == k).select("a_id")
        found.append(ranked.join(settled, "a_id", "left_semi"))
        todo = cut_lineage(todo.join(settled, todo["id"] == settled["a_id"], "left_anti"), "open")
        if todo.isEmpty():
            break
        radius *= 2
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("a_id").alias("q_id"), "rank", F.col("b_id").alias("id"), "dx", "dy", "dz", "d2")


def blocked_pairs(left: DataFrame, right: DataFrame, box: float) -> DataFrame:
    """Every row of ``left``, few, with every row of ``right``, dealt out to blocks; columns as of :func:`cell_pairs`."""
    blocks = max(8, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in ("id", *AXES)]).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in ("id", *AXES)]).withColumn("_block", F.pmod(F.xxhash64("b_id"), F.lit(blocks)).cast("int"))
    d = [min_image(F.col(f"b_{c}") - F.col(f"a_{c}"), box) for c in AXES]
    pairs = a.join(b, "_block").drop("_block")
    return pairs.select("*", *[x.alias(f"d{c}") for x, c in zip(d, AXES, strict=True)], (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("d2"))

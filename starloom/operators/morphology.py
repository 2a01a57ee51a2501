"""Watershed voids and Minkowski functionals of periodic meshes."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.geometry import effective_radius
from starloom.operators.graph import roots
from starloom.operators.spatial import cell_pairs
from starloom.sources.shared import cut_lineage, discard

#: Neighbours in the order in which the first of equal values wins (fixed by the method).
STEPS = ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def voxel(ix, iy, iz, n: int):
    return (ix.cast("long") * n + iy) * n + iz


def _spread(mesh: DataFrame, n: int, steps) -> DataFrame:
    """Every cell's value sent to the cells that see it at each step: (voxel, order, from, value)."""
    moves = F.array(*[F.struct(F.lit(i).alias("order"), *[F.lit(s).alias(c) for s, c in zip(step, "xyz", strict=True)]) for i, step in enumerate(steps)])
    out = mesh.select("ix", "iy", "iz", "value", F.explode(moves).alias("m"))
    to = [F.pmod(F.col(f"i{c}") - F.col(f"m.{c}"), F.lit(n)) for c in "xyz"]
    return out.select(voxel(*to, n).alias("voxel"), F.col("m.order").alias("order"), voxel(F.col("ix"), F.col("iy"), F.col("iz"), n).alias("from"), "value")


def watershed(mesh: DataFrame, n: int) -> DataFrame:
    """(node, root): every valid cell and the local minimum that it drains to.

    A cell is valid if its value is not null. It drains to the least of itself
    and its six periodic neighbours.
    """
    seen = _spread(mesh.where(F.col("value").isNotNull()), n, STEPS)
    valid = mesh.where(F.col("value").isNotNull()).select(voxel(F.col("ix"), F.col("iy"), F.col("iz"), n).alias("voxel"))
    nxt = seen.groupBy("voxel").agg(F.min_by("from", F.struct("value", "order")).alias("next"))
    return roots(nxt.join(valid, "voxel", "left_semi"), "voxel", "next")


def edge_zones(mesh: DataFrame, zones: DataFrame, n: int) -> DataFrame:
    """(root): zones with a cell that lacks one of its six neighbours."""
    seen = _spread(mesh.where(F.col("value").isNotNull()), n, STEPS[1:]).groupBy("voxel").agg(F.count(F.lit(1)).alias("k"))
    touched = zones.join(seen, zones["node"] == seen["voxel"], "left").where(F.coalesce("k", F.lit(0)) < 6)
    return touched.select("root").distinct()


def void_catalog(mesh: DataFrame, n: int, cell: float, max_core: float = 0.0) -> DataFrame:
    """(root, x, y, z, radius, core, cells): zones whose minimum lies below ``max_core``, edge zones left out.

    Positions are lower cell corners; ``core`` is the value at the minimum plus 1.
    """
    zones = watershed(mesh, n)
    size = zones.groupBy("root").agg(F.count(F.lit(1)).alias("cells"))
    at = mesh.select(voxel(F.col("ix"), F.col("iy"), F.col("iz"), n).alias("root"), "ix", "iy", "iz", "value")
    kept = size.join(at, "root").where(F.col("value") < max_core).join(edge_zones(mesh, zones, n), "root", "left_anti")
    return kept.select("root", *[(F.col(f"i{c}") * float(cell)).alias(c) for c in "xyz"], effective_radius(F.col("cells"), cell).alias("radius"), (F.col("value") + 1).alias("core"), "cells")


def zone_links(mesh: DataFrame, zones: DataFrame, n: int) -> DataFrame:
    """(z1, z2, link): lowest pass between neighbouring zones, the larger value of a border pair."""
    value = mesh.select(voxel(F.col("ix"), F.col("iy"), F.col("iz"), n).alias("node"), "value")
    here = zones.join(value, "node")
    pairs = _spread(mesh, n, STEPS[1::2]).select("voxel", "from", F.col("value").alias("v2"))
    a = here.select(F.col("node").alias("voxel"), F.col("root").alias("z1"), F.col("value").alias("v1"))
    b = zones.select(F.col("node").alias("from"), F.col("root").alias("z2"))
    border = pairs.join(a, "voxel").join(b, "from").where("z1 <> z2")
    return border.groupBy(F.least("z1", "z2").alias("z1"), F.greatest("z1", "z2").alias("z2")).agg(F.min(F.greatest("v1", "v2")).alias("link"))


def leak_density(links: DataFrame) -> DataFrame:
    """(root, leak): a zone's lowest pass to any neighbour."""
    both = links.select(F.col("z1").alias("root"), "link").unionByName(links.select(F.col("z2").alias("root"), "link"))
    return both.groupBy("root").agg(F.min("link").alias("leak"))


def size_function(voids: DataFrame, width: float, volume: float) -> DataFrame:
    """(bin, density): voids per volume by radius."""
    return voids.groupBy(F.floor(F.col("radius") / width).cast("int").alias("bin")).agg((F.count(F.lit(1)) / float(volume)).alias("density"))


CORNERS = tuple((k & 1, k >> 1 & 1, k >> 2) for k in range(8))


def minkowski(mesh: DataFrame, n: int, cell: float, thresholds: list[float], mask: float = -math.inf) -> DataFrame:
    """(threshold, v0, v1, v2, v3) of the excursion sets above each threshold.

    Faces, edges and corners of every cell's upper neighbourhood are counted;
    cells whose neighbourhood touches the mask are skipped.
    """
    ds = _spread(mesh, n, CORNERS).groupBy("voxel").agg(*[F.max(F.when(F.col("order") == k, F.col("value"))).alias(f"d{k}") for k in range(8)])
    low, high = F.least(*[F.col(f"d{k}") for k in range(8)]), F.greatest(*[F.col(f"d{k}") for k in range(8)])
    cells = ds.where(low > mask).withColumn("low", low).withColumn("high", high)
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("t")
    rows = cells.select("*", levels)

    def over(*ks):
        return F.greatest(*[F.col(f"d{k}") for k in ks]) > F.col("t") if len(ks) > 1 else F.col(f"d{ks[0]}") > F.col("t")

    def total(*sets):
        return sum((over(*s).cast("long") for s in sets), F.lit(0))

    n3, n2 = total((0,)), total((0, 1), (0, 2), (0, 4))
    n1, n0 = total((0, 1, 2, 3), (0, 2, 4, 6), (0, 4, 1, 5)), total(tuple(range(8)))
    inside, border = F.col("t") < F.col("low"), (F.col("t") >= F.col("low")) & (F.col("t") < F.col("high"))
    v = [F.when(inside, 1).when(border, n3).otherwise(0), *[F.when(border, x).otherwise(0) for x in (-3 * n3 + n2, 3 * n3 - 2 * n2 + n1, -n3 + n2 - n1 + n0)]]
    sums = rows.groupBy("t").agg(F.count(F.lit(1)).alias("vol"), *[F.sum(x).alias(f"s{j}") for j, x in enumerate(v)])
    scale = (1.0, 2.0 / 9.0, 2.0 / 9.0, 1.0)
    return sums.select(F.col("t").alias("threshold"), *[(F.col(f"s{j}") * scale[j] / F.col("vol") / float(cell) ** j).alias(f"v{j}") for j in range(4)])


def member_values(zones: DataFrame, mesh: DataFrame, n: int) -> DataFrame:
    """``zones`` with the value of each cell."""
    at = mesh.select(voxel(F.col("ix"), F.col("iy"), F.col("iz"), n).alias("node"), "value")
    return zones.join(at, "node")


def nested(voids: DataFrame, box: float) -> DataFrame:
    """(id, central, satellites): larger voids absorb the smaller ones whose centre they hold.

    Voids (id, x, y, z, radius) are taken from the largest on, ties by id. A
    central takes every smaller void within its radius: those without a central,
    and those held by another central at a shorter distance. So a void is a
    central if no larger central holds it, and any other ends with the farthest
    of the centrals that hold it, ties to the larger one. Centrals are found in
    rounds: voids in reach of no larger open one are centrals, what they hold is
    closed. Of voids at one position only the largest can be one. Not periodic.
    """
    reach = float(voids.agg(F.max("radius")).first()[0] or 1.0)

    def larger(a: str, b: str):
        return (F.col(f"{a}_radius") > F.col(f"{b}_radius")) | ((F.col(f"{a}_radius") == F.col(f"{b}_radius")) & (F.col(f"{a}_id") < F.col(f"{b}_id")))

    def held(centrals: DataFrame, others: DataFrame) -> DataFrame:
        pairs = cell_pairs(centrals, others, reach, float(box), periodic=False, keep=("radius",))
        return pairs.where(larger("a", "b") & (F.col("d2") < F.col("a_radius") * F.col("a_radius")))

    top = F.max(F.struct("radius", (-F.col("id")).alias("rank"))).alias("top")
    live = cut_lineage(voids.groupBy("x", "y", "z").agg(top).select((-F.col("top.rank")).alias("id"), "x", "y", "z", "top.radius"), "open")
    rounds = []
    while not live.isEmpty():
        near = cell_pairs(live, None, reach, float(box), periodic=False, keep=("radius",))
        near = near.where(F.col("d2") < F.pow(F.greatest("a_radius", "b_radius"), F.lit(2)))
        beaten = near.select(F.when(larger("a", "b"), F.col("b_id")).otherwise(F.col("a_id")).alias("id")).distinct()
        rounds.append(cut_lineage(live.join(beaten.hint("merge"), "id", "left_anti"), "centrals"))
        gone = held(rounds[-1], live).select(F.col("b_id").alias("id")).unionByName(rounds[-1].select("id")).distinct()
        before, live = live, cut_lineage(live.join(gone.hint("merge"), "id", "left_anti"), "open")
        discard(before)
    centrals = functools.reduce(DataFrame.unionByName, rounds, live)
    last = F.max(F.struct("d2", F.col("a_radius").alias("radius"), (-F.col("a_id")).alias("rank"))).alias("last")
    holders = cut_lineage(held(centrals, voids).groupBy(F.col("b_id").alias("id")).agg(last).select("id", (-F.col("last.rank")).alias("central")), "holders")
    count = holders.groupBy(F.col("central").alias("id")).agg(F.count(F.lit(1)).alias("satellites"))
    out = voids.select("id").join(holders.hint("merge"), "id", "left").join(count.hint("merge"), "id", "left")
    return out.select("id", F.coalesce("central", "id").alias("central"), F.coalesce("satellites", F.lit(0)).cast("long").alias("satellites"))

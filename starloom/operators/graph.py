"""Graphs as edge tables: components, pointer jumping, spanning forests, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.geometry import wrap
from starloom.operators.ranks import even_part, ranked
from starloom.sources.shared import cut_lineage, discard


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its least neighbour on; (hi, lo) with hi > lo."""
    if large:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        moved = edges.join(least, edges["hi"] == least["u"]).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        out = moved.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi <> lo").distinct()


def components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component): the least node that each node with an edge can reach.

    Alternating large and small stars: grouped minima and joins only, so nodes
    of any degree are pre-aggregated; every round is written to the shared folder.
    """
    real = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    now = cut_lineage(real.select(F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")).distinct(), "edges")
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("h"))
    seen = now.agg(mark.alias("s")).first()["s"]
    while seen["n"]:
        before, now = now, cut_lineage(_round(_round(now, True), False), "stars")
        discard(before)
        then, seen = seen, now.agg(mark.alias("s")).first()["s"]
        if then == seen:
            break
    heads = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(heads)


def roots(pointers: DataFrame, node: str = "node", to: str = "next") -> DataFrame:
    """(node, root): each pointer followed to the end, by doubling until nothing moves."""
    now = cut_lineage(pointers.select(F.col(node).alias("node"), F.col(to).alias("root")), "pointers")
    while True:
        far = now.select(F.col("node").alias("root"), F.col("root").alias("far"))
        now, before = cut_lineage(now.join(far, "root").select("node", F.col("far").alias("root")), "jump"), now
        done = now.join(before, ["node", "root"], "left_anti").isEmpty()
        discard(before)
        if done:
            return now


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, w): lightest forest that connects what ``edges`` connect, ties to the smaller ids.

    Boruvka's rounds: every component picks its lightest edge to another one;
    the number of components at least halves each round.
    """
    base = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("w").alias("w"))
    live = cut_lineage(base.select("src", "dst", "w", F.col("src").alias("ca"), F.col("dst").alias("cb")), "live")
    whole = F.struct("w", "src", "dst", "ca", "cb")
    tree = live.select("src", "dst", "w").limit(0)
    while not live.isEmpty():
        sides = live.select(F.col("ca").alias("c"), whole.alias("e")).unionByName(live.select(F.col("cb").alias("c"), whole.alias("e")))
        picked = cut_lineage(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "picked")
        tree = tree.unionByName(picked.select("src", "dst", "w"))
        # only the components of this round are merged, so rounds shrink geometrically
        names = components(picked, "ca", "cb")
        a, b = names.toDF("ca", "na"), names.toDF("cb", "nb")
        merged = live.join(a, "ca").join(b, "cb").where("na <> nb")
        live = cut_lineage(merged.select("src", "dst", "w", F.col("na").alias("ca"), F.col("nb").alias("cb")), "live")
    return tree


def tree_paths(tree: DataFrame, steps: int) -> DataFrame:
    """(first, last, length): all simple paths of so many edges, each once (first < last)."""
    both = tree.select("src", "dst", "w").unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    paths = both.select(F.col("src").alias("first"), F.col("src").alias("before"), F.col("dst").alias("last"), F.col("w").alias("length"))
    for _ in range(steps - 1):
        more = both.select(F.col("src").alias("last"), F.col("dst").alias("_to"), F.col("w").alias("_w"))
        # in a tree a path is simple as long as it doesn't turn back
        paths = paths.join(more, "last").where("_to <> before").select("first", F.col("last").alias("before"), F.col("_to").alias("last"), (F.col("length") + F.col("_w")).alias("length"))
    return paths.where("first < last").select("first", "last", "length")


def periodic_mean(x: str, reference: Column, box: float) -> Column:
    """Mean of the images nearest the reference, wrapped; an aggregate."""
    d = F.col(x) - reference
    return wrap(F.avg(F.col(x) - F.lit(float(box)) * F.rint(d / float(box))), box)


def multiplets(points: DataFrame, links: DataFrame, box: float) -> DataFrame:
    """(component, size, x, y, z): groups of linked points with their periodic centres.

    Positions are averaged relative to the member with the smallest id.
    """
    return centres(points, components(links, "a_id", "b_id"), box)


def centres(points: DataFrame, nodes: DataFrame, box: float) -> DataFrame:
    """As :func:`multiplets`, of groups that are found already: (node, component)."""
    members = nodes.join(points.select("id", *"xyz"), F.col("node") == F.col("id"))
    # only a group's first point, wanted once for all its members
    heads = nodes.where("node = component").join(points, F.col("component") == F.col("id"))
    first = heads.select("component", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    joined = members.join(first, "component")
    return joined.groupBy("component").agg(F.count(F.lit(1)).alias("size"), *[periodic_mean(c, F.col(f"_{c}"), box).alias(c) for c in "xyz"])


def singlets(points: DataFrame, links: DataFrame) -> DataFrame:
    """Points without a link."""
    linked = links.select(F.col("a_id").alias("id")).unionByName(links.select(F.col("b_id").alias("id")))
    return points.join(linked, "id", "left_anti")


def percolation(tree: DataFrame, points: DataFrame, steps: int, bins: int, box: float | None = None) -> DataFrame:
    """(stat, bin, mean): sorted edge lengths, then path and end-to-end lengths in even bins.

    End-to-end distances are averaged in bins ordered by path length.
    """
    from starloom.functions.geometry import min_image

    def binned(df, order, value, stat):
        placed = ranked(df, order).withColumn("bin", even_part(F.col("rank"), F.col("total"), bins))
        return placed.groupBy("bin").agg(F.avg(value).alias("mean")).select(F.lit(stat).alias("stat"), "bin", "mean")

    out = binned(tree, ["w", "src", "dst"], "w", "mst1pt")
    for n in range(2, steps + 1):
        paths = tree_paths(tree, n)
        a = points.select(F.col("id").alias("first"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
        b = points.select(F.col("id").alias("last"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
        d = [min_image(F.col(f"b{c}") - F.col(f"a{c}"), box) for c in "xyz"]
        ends = paths.join(a, "first").join(b, "last").withColumn("end", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
        # both orders below read these paths
        ends = cut_lineage(ends.select("first", "last", "length", "end"), "paths")
        out = out.unionByName(binned(ends, ["length", "first", "last"], "length", f"mst{n}pt")).unionByName(binned(ends, ["length", "first", "last"], "end", f"end{n}pt"))
    return out

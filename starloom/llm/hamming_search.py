"""Operator 2: exact top-k search of binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments, each with its own table. For a query all
segment values at exactly r flipped bits are looked up, r = 0, 1, 2, ... After
radius r every code within segments * (r + 1) - 1 bits has been met in some
table, so a query is done once its k-th best distance is within that; the
others go on with the next radius. Matches farther than a query's current k-th
best are discarded inside the join.

Equal codes are one entry with its k + 1 least ids (enough for any query, its
own id left out), so a very common code costs no more than a rare one.

Defined results for odd input: null vectors, and vectors holding null, NaN or
infinite components take no part (neither as query nor as candidate); the zero
vector has code zero; ties go to the smaller id; repeated ids are one
candidate if their codes agree; fewer than k candidates give fewer rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starloom.llm.common import cut_lineage

BITS = 64


def usable(vector):
    """True for vectors whose components are all finite numbers."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def sign_codes(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): bit k is set if the sum of the components k, k + 64, ... is positive."""
    bit = F.when(F.size(vector_col) <= BITS, F.transform(vector_col, lambda x: x.cast("double"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.aggregate(F.filter(vector_col, lambda x, i: i % BITS == k), F.lit(0.0), lambda a, x: a + x))
    )
    ones = F.reverse(F.transform(bit, lambda x: (x > 0).cast("long")))
    code = F.aggregate(ones, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return rows.where(usable(vector_col)).select(F.col(id_col).cast("long").alias(id_col), code.alias("code"))


def _least_ids(codes: DataFrame, id_col: str, keep: int) -> DataFrame:
    """(code, ids): the ``keep`` least ids of each code; cut down before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("code").orderBy(id_col))
    least = codes.where(F.col(id_col).isNotNull()).withColumn("_r", rank).where(F.col("_r") <= keep)
    return least.groupBy("code").agg(F.array_distinct(F.array_sort(F.collect_list(id_col))).alias("ids"))


def hamming_topk(codes: DataFrame, queries: DataFrame, k: int = 10, *, segments: int = 4, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, distance): each query's k nearest other rows, exactly."""
    width = BITS // segments
    mask = (1 << width) - 1

    def parts(code):
        return F.array(*[F.struct(F.lit(i).alias("s"), F.shiftrightunsigned(code, i * width).bitwiseAND(F.lit(mask)).alias("v")) for i in range(segments)])

    entries = cut_lineage(_least_ids(codes, id_col, k + 1), "codes")
    index = cut_lineage(entries.select("code", F.size("ids").alias("n"), F.col("ids")[0].alias("least"), F.explode(parts(F.col("code"))).alias("p")).select("code", "n", "least", "p.*"), "segments")
    asked = cut_lineage(queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col("code").alias("q")).distinct(), "queries")
    open_ = asked.select("q").distinct().withColumn("worst", F.lit(BITS))
    done = None
    best = None  # (q, code, n, least, d): the k + 1 best entries met so far of each open query
    by_rank = Window.partitionBy("q").orderBy("d", "least")
    for r in range(width + 1):
        flips = F.expr("array(" + ",".join(f"{sum(1 << b for b in c)}L" for c in combinations(range(width), r)) + ")")
        probes = open_.select("q", "worst", F.explode(parts(F.col("q"))).alias("p"))
        probes = probes.select("q", "worst", "p.s", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("p.v")))).alias("v"))
        d = F.bit_count(F.col("q").bitwiseXOR(F.col("code")))
        # exploded probes look small to the planner, which knows only the table they come from: never broadcast them
        met = probes.join(index.hint("merge"), ["s", "v"]).where(d <= F.col("worst")).select("q", "code", "n", "least", d.alias("d"))
        pool = met if best is None else met.unionByName(best)
        pool = pool.distinct().withColumn("_r", F.row_number().over(by_rank)).where(F.col("_r") <= k + 1).drop("_r")
        pool = cut_lineage(pool, f"radius{r}")
        sure = segments * (r + 1) - 1
        # a query is settled once k + 1 rows, itself maybe among them, lie within what is covered
        within = F.sum(F.when(F.col("d") <= sure, F.col("n")).otherwise(0))
        full = F.when(F.count(F.lit(1)) >= k + 1, F.max("d")).otherwise(BITS)
        state = open_.select("q").join(pool.groupBy("q").agg(within.alias("within"), full.alias("worst")), "q", "left")
        state = cut_lineage(state.select("q", F.coalesce("within", F.lit(0)).alias("within"), F.coalesce("worst", F.lit(BITS)).alias("worst")), f"state{r}")
        settled = F.col("within") >= k + 1
        finished = pool.join(state.where(settled | F.lit(r == width)).select("q"), "q", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        open_ = state.where(~settled).select("q", "worst")
        best = pool.join(open_.select("q"), "q", "left_semi")
        if open_.isEmpty():
            break
    found = done.select("q", "code", "d").join(entries, "code").select("q", "d", F.explode("ids").alias(id_col))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("d", id_col))).where(F.col("_r") <= k + 1).drop("_r")
    pairs = asked.join(found, "q").where(F.col("query_id") != F.col(id_col))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", id_col))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), id_col, F.col("d").cast("int").alias("distance"))


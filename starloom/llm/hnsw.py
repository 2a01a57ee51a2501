"""Operator 7: approximate nearest neighbours, one navigable small-world graph per shard.

Vectors of one direction are one node, so a very common vector and its multiples
are one node however many rows hold them; a node keeps its k + 1 least ids.
Nodes are dealt out to shards of bounded size by a hash of the direction. Each
shard grows a hierarchical navigable small-world graph: node levels follow the
usual geometric law; nodes are inserted in batches, and on each of its levels a
node searches the graph grown so far, links to diverse ones of the nearest nodes
found (and of its own batch), and is linked back, links beyond the room of a
node being thinned by the same rule. The graph is stored as flat neighbour
arrays, one row per shard.

Queries are dealt out in blocks; every block meets every shard's graph and walks
it in step, batch by batch. Results are scored in double precision on original
vectors and merged.

Directions are equal if no component of the unit vectors differs in the twelfth
decimal, scores if they agree to thirteen decimals: what lies below is rounding.

Defined results for odd input: vectors null, empty, zero or holding null or
non-finite components take no part; vectors of another dimension are searched
only among their own; ties go to the smaller id; repeated ids count once per
vector; fewer than k candidates give fewer rows; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from starloom.llm.common import cut_lineage
from starloom.llm.hamming_search import usable

#: Nodes per shard, links per node, nodes held while inserting and while searching.
SHARD, DEGREE, BUILD, SEARCH = 16_384, 16, 48, 192
#: Queries that one task walks through one shard, queries walked in step, nodes inserted in step.
QUERIES, STEP, BATCH = 20_000, 256, 512
NEG = np.float32(-np.inf)


class Graph:
    """Flat neighbour arrays: ``links[level][i]`` holds node i's neighbours, -1 where free."""

    def __init__(self, vectors: np.ndarray, links: list, entry: int):
        self.vectors, self.links, self.entry = vectors.astype(np.float32), links, entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0, degree: int = DEGREE, ef: int = BUILD) -> Graph:
        """Grown by inserting the nodes, in random order, in batches that at most double the graph."""
        n = len(vectors)
        rng = np.random.default_rng(seed)
        levels = np.minimum((-np.log(1 - rng.random(n)) / math.log(degree)).astype(np.int32), 12)
        order = rng.permutation(n)
        levels[order[0]] = levels.max(initial=0)
        # a quarter more room than a node keeps when it is thinned, so that few arrivals cause it
        links = [np.full((n, (2 * degree if k == 0 else degree) * 5 // 4), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)]
        graph = cls(vectors, links, int(order[0]))
        done = 1
        while done < n:
            batch = order[done : done + min(BATCH, done)]
            graph._insert(batch, levels[batch], degree, ef)
            done += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, levels: np.ndarray, degree: int, ef: int) -> None:
        near = np.full(len(batch), self.entry)
        found = {}
        for level in range(len(self.links) - 1, -1, -1):
            here = levels >= level
            if (~here).any():
                near[~here] = self._descend(self.vectors[batch[~here]], near[~here], level)
            if here.any():
                ids, sims = self._beam(self.vectors[batch[here]], near[here], level, ef)
                near[here] = ids[:, 0]
                found[level] = batch[here], ids, sims
        for level, (nodes, ids, sims) in found.items():
            # the batch isn't in the graph yet: its nodes look at those before them as well
            own = self.vectors[nodes] @ self.vectors[nodes].T
            own[np.triu_indices(len(nodes))] = NEG
            take = min(ef, len(nodes))
            at = np.argpartition(-own, take - 1, axis=1)[:, :take]
            ids = np.c_[ids, nodes[at]]
            sims = np.c_[sims, np.take_along_axis(own, at, 1)]
            ahead = diverse(self.vectors, ids, sims, degree)
            table = self.links[level]
            table[nodes, :degree] = ahead
            self._link_back(table, nodes, ahead)

    def _link_back(self, table: np.ndarray, nodes: np.ndarray, ahead: np.ndarray) -> None:
        """Every node linked to links back; what has no room left is thinned."""
        room = table.shape[1]
        row, col = np.nonzero(ahead >= 0)
        to, back = ahead[row, col], nodes[row]
        touched = np.unique(to)
        r, c = np.nonzero(table[touched] >= 0)
        u, v = np.r_[touched[r], to], np.r_[table[touched[r], c], back]
        sim = np.einsum("ij,ij->i", self.vectors[u], self.vectors[v])
        rank = np.lexsort((v, -sim, u))
        u, v, sim = u[rank], v[rank], sim[rank]
        fresh = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
        u, v, sim = u[fresh], v[fresh], sim[fresh]
        place = np.arange(len(u)) - np.searchsorted(u, u)
        most = 2 * room
        u, v, sim, place = (x[place < most] for x in (u, v, sim, place))
        at = np.searchsorted(touched, u)
        cand, score = np.full((len(touched), most), -1, np.int64), np.full((len(touched), most), NEG)
        cand[at, place], score[at, place] = v, sim
        full = (score > NEG).sum(1) > room
        table[touched[~full]] = cand[~full, :room]
        if full.any():
            kept = diverse(self.vectors, cand[full], score[full], room * 4 // 5)
            table[touched[full]] = -1
            table[touched[full], : kept.shape[1]] = kept

    def _sims(self, queries: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Similarities of each query to its row of nodes, minus infinity where there is none."""
        out = np.full(near.shape, NEG)
        row, col = np.nonzero(near >= 0)
        out[row, col] = np.einsum("ij,ij->i", queries[row], self.vectors[near[row, col]])
        return out

    def _descend(self, queries: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """Each query's local best on a level, walking greedily."""
        at = at.copy()
        best = np.einsum("ij,ij->i", queries, self.vectors[at])
        open_ = np.arange(len(queries))
        while len(open_):
            near = self.links[level][at[open_]]
            sims = self._sims(queries[open_], near)
            top = sims.argmax(1)
            value = sims[np.arange(len(open_)), top]
            better = value > best[open_]
            moved = open_[better]
            at[moved], best[moved] = near[better, top[better]], value[better]
            open_ = moved
        return at

    def _beam(self, queries: np.ndarray, at: np.ndarray, level: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Each query's ``ef`` nearest nodes found on a level, nearest first (-1 where fewer), and their similarities."""
        m, links = len(queries), self.links[level]
        ids, sims = np.full((m, ef), -1, np.int64), np.full((m, ef), NEG)
        ids[:, 0], sims[:, 0] = at, np.einsum("ij,ij->i", queries, self.vectors[at])
        least = np.full(m, NEG)  # of those held
        spread = np.zeros((m, ef), bool)  # neighbours have been looked at
        seen = np.zeros((m, len(self.vectors)), bool)
        seen[np.arange(m), at] = True
        open_ = np.arange(m)
        while len(open_):
            todo = np.where(spread[open_] | (ids[open_] < 0), NEG, sims[open_])
            pick = todo.argmax(1)
            alive = todo[np.arange(len(open_)), pick] > NEG
            open_, pick = open_[alive], pick[alive]
            if not len(open_):
                break
            spread[open_, pick] = True
            near = links[ids[open_, pick]].astype(np.int64)
            row, col = np.nonzero(near >= 0)
            new = ~seen[open_[row], near[row, col]]
            row, col = row[new], col[new]
            node = near[row, col]
            seen[open_[row], node] = True
            value = np.einsum("ij,ij->i", queries[open_[row]], self.vectors[node])
            good = value > least[open_[row]]
            row, node, value = row[good], node[good], value[good]
            if not len(row):
                continue
            # only queries with something nearer are merged; their new nodes stand side by side
            hit, first = np.unique(row, return_index=True)
            width = np.diff(np.r_[first, len(row)])
            place = np.arange(len(row)) - np.repeat(first, width)
            at_row = np.repeat(np.arange(len(hit)), width)
            extra_ids, extra = np.full((len(hit), width.max()), -1, np.int64), np.full((len(hit), width.max()), NEG)
            extra_ids[at_row, place], extra[at_row, place] = node, value
            q = open_[hit]
            all_ids, all_sims = np.c_[ids[q], extra_ids], np.c_[sims[q], extra]
            all_spread = np.c_[spread[q], np.zeros(extra.shape, bool)]
            keep = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[q], sims[q], spread[q] = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_spread))
            least[q] = sims[q].min(1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, k: int, ef: int = SEARCH) -> list[np.ndarray]:
        """The k most similar nodes found for each query, and those found that tie with the last."""
        ef = max(ef, k)
        out = []
        for a in range(0, len(queries), STEP):
            part = queries[a : a + STEP].astype(np.float32)
            at = np.full(len(part), self.entry)
            for level in range(len(self.links) - 1, 0, -1):
                at = self._descend(part, at, level)
            ids, sims = self._beam(part, at, 0, ef)
            # single precision can't order what is this close
            near = (ids >= 0) & (sims >= sims[:, min(k, ef) - 1 : min(k, ef)] - 1e-5)
            out += [i[n] for i, n in zip(ids, near, strict=True)]
        return out

    def to_row(self) -> dict:
        return {"levels": len(self.links), "entry": self.entry, "links": b"".join(x.astype("<i4").tobytes() for x in self.links), "widths": [x.shape[1] for x in self.links]}

    @classmethod
    def from_row(cls, row: dict, vectors: np.ndarray) -> Graph:
        links, at, n = [], 0, len(vectors)
        for width in row["widths"]:
            links.append(np.frombuffer(row["links"], "<i4", n * width, at).reshape(n, width))
            at += 4 * n * width
        return cls(vectors, links, row["entry"])


def diverse(vectors, cand, score, keep) -> np.ndarray:
    """Per row up to ``keep`` candidates, nearest first, each nearer to the node than to any kept one.

    Rows are handled together; candidates of score -inf don't count. Free places
    are filled with the nearest of those passed over.
    """
    order = np.argsort(-score, axis=1, kind="stable")
    cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
    rows, m = cand.shape
    points = vectors[cand]
    sims = points @ points.transpose(0, 2, 1)
    closest = np.full((rows, m), NEG)  # to any kept candidate
    kept = np.zeros((rows, m), bool)
    count = np.zeros(rows, int)
    valid = np.isfinite(score)
    for j in range(m):
        take = valid[:, j] & (count < keep) & (score[:, j] > closest[:, j])
        kept[:, j] = take
        count += take
        closest[take] = np.maximum(closest[take], sims[take, j])
    # kept ones first, then the others, both by nearness
    rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(cand, rank, 1)
    out[~np.take_along_axis(valid, rank, 1)] = -1
    if out.shape[1] < keep:
        out = np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)
    return out


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


GRAPHS = T.StructType(
    [
        T.StructField("dim", T.IntegerType()),
        T.StructField("number", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("vectors", T.BinaryType()),
        T.StructField("ids", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("levels", T.IntegerType()),
        T.StructField("entry", T.IntegerType()),
        T.StructField("links", T.BinaryType()),
        T.StructField("widths", T.ArrayType(T.IntegerType())),
    ]
)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; those of very large or small components first by the largest."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to 1/2 to 1: cosines stay to the bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def _usable(rows: DataFrame, id_col: str, vector_col: str, name: str) -> DataFrame:
    nonzero = F.exists(vector_col, lambda x: x != 0)
    good = rows.where(usable(vector_col) & nonzero & F.col(id_col).isNotNull())
    return good.select(F.col(id_col).cast("long").alias(name), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))


def _direction(vector: str) -> list[Column]:
    """Two hashes of the direction to twelve decimals."""

    def hashes(s: Column) -> Column:
        small = F.transform(s["v"], lambda x: x / s["m"])

        def of(t: Column) -> Column:
            length = F.sqrt(F.aggregate(t, F.lit(0.0), lambda a, x: a + x * x))
            return F.transform(F.array(length), lambda n: F.transform(t, lambda x: F.rint(x / n * 1e12).cast("long")))[0]

        return F.transform(F.array(small), of)[0]

    most = F.aggregate(vector, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    whole = F.transform(F.array(F.struct(F.col(vector).alias("v"), most.alias("m"))), hashes)[0]
    return [F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")]


def distinct_vectors(rows: DataFrame, keep: int, id_col: str, vector_col: str) -> DataFrame:
    """(vector, h1, ids): one vector per direction, that of the least id, and its ``keep`` least ids."""
    good = _usable(rows, id_col, vector_col, "id")
    keyed = good.select("id", "vector", *_direction("vector"))
    # cut down before the shuffle, so a direction of very many rows is a few rows of each task
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("_r") <= 2 * keep)
    own = ranked.groupBy("h1", "h2").agg(F.min_by("vector", "id").alias("vector"), F.array_distinct(F.array_sort(F.collect_list("id"))).alias("ids"))
    return own.select("vector", "h1", F.slice("ids", 1, keep).alias("ids"))


def build_index(rows: DataFrame, k: int = 5, *, shard_size: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per shard: vectors, ids and flat neighbour arrays, in the shared folder."""
    entries = cut_lineage(distinct_vectors(rows, k + 1, id_col, vector_col), "vectors")
    shards = max(1, -(-entries.count() // shard_size))
    dealt = entries.select(F.size("vector").alias("dim"), F.pmod("h1", F.lit(shards)).alias("number"), "vector", "ids")
    # ranges deal out one shard to a task, hashes would put several together
    dealt = dealt.repartitionByRange(min(shards, 4096), "dim", "number").sortWithinPartitions("dim", "number")

    def graphs(batches):
        import pyarrow as pa

        def row(shard, vectors, ids):
            data = np.array(vectors, dtype="<f8")
            out = {"dim": shard[0], "number": shard[1], "kind": 0, "vectors": data.tobytes(), "ids": ids} | Graph.build(unit(data), seed=shard[1]).to_row()
            return pa.RecordBatch.from_pylist([out], schema=_arrow(GRAPHS))

        now, vectors, ids = None, [], []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("dim", "number", "vector", "ids"))
            for dim, number, vector, own in zip(*columns, strict=True):
                if (dim, number) != now and vectors:
                    yield row(now, vectors, ids)
                    vectors, ids = [], []
                now = dim, number
                vectors.append(vector)
                ids.append(own)
        if vectors:
            yield row(now, vectors, ids)

    index = cut_lineage(dealt.mapInArrow(graphs, GRAPHS), "graphs")
    index.shards = shards
    return index


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, *, ef: int = SEARCH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's k nearest other rows found.

    Every distinct query vector goes to every shard of its dimension, in blocks,
    each with a copy of the shard's graph; a block streams past it batch by batch.
    """
    asked = cut_lineage(_usable(queries, id_col, vector_col, "query_id").distinct(), "queries")
    shards = getattr(index, "shards", None)
    if shards is None:  # an index read from elsewhere
        shards = int(index.agg(F.coalesce(F.max("number"), F.lit(0)) + 1).first()[0])
    blocks = max(1, -(-asked.count() // QUERIES))
    block = F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int")
    sent = asked.select("vector").distinct().select(F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("number"), F.lit(1).alias("kind"), block.alias("block"), "vector")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("vector", F.lit(None).cast("array<double>"))
    both = copies.unionByName(sent, allowMissingColumns=True)
    place = ["dim", "number", "block"]
    parts = max(1, min(4096, shards * blocks))
    both = both.repartitionByRange(parts, *place).sortWithinPartitions(*place, "kind")
    schema = T.StructType([T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())])

    def search(batches):
        import pyarrow as pa

        graph, now = None, None
        for batch in batches:
            out, waiting = [], []

            def walk(graph, waiting, out):
                q = scaled(np.array(waiting))
                lengths = np.linalg.norm(q, axis=1)
                for vector, one, length, best in zip(waiting, q, lengths, graph.search(unit(q), k + 1, ef), strict=True):
                    scores = graph.data[best] @ one / (graph.norms[best] * length)
                    out += [{"vector": vector, "id": x, "score": s} for i, s in zip(best.tolist(), scores.tolist(), strict=True) for x in graph.ids[i]]

            for row in batch.to_pylist():
                here = row["dim"], row["number"]
                if row["kind"] == 0:
                    if waiting:
                        walk(graph, waiting, out)
                        waiting = []
                    data = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                    graph, now = Graph.from_row(row, unit(data)), here
                    graph.data, graph.ids = scaled(data), row["ids"]
                    graph.norms = np.linalg.norm(graph.data, axis=1)
                elif here == now:  # a dimension without a shard of this number has no candidates there
                    waiting.append(row["vector"])
            if waiting:
                walk(graph, waiting, out)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(schema))

    found = both.mapInArrow(search, schema)
    order = [F.round("score", 13).desc(), F.col("id")]
    merged = found.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy(*order))).where(F.col("_r") <= k + 1).drop("_r")
    pairs = asked.join(merged, "vector").where(F.col("query_id") != F.col("id"))
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """Index all rows, then search all queries."""
    names = {n: options[n] for n in ("id_col", "vector_col") if n in options}
    index = build_index(rows, k, **names, **{n: options[n] for n in ("shard_size",) if n in options})
    return search_index(index, queries, k, **names, **{n: options[n] for n in ("ef",) if n in options})

"""Near copies by the Jaccard similarity of word shingles, for the pipeline's near-dedup.

The 64-bit fingerprints of :mod:`.simhash` can't find these pairs: at a
similarity of 0.8 two of them differ in about ten bits, and Hamming balls of
that radius hold too many codes to look up. Candidates are therefore texts that
agree in one of ``bands`` groups of ``rows`` minima of their hashed shingles; a
pair of similarity s is one with probability 1 - (1 - s^rows)^bands, which is
over 0.99999 at 0.8 with the defaults. Every candidate is then verified by its
exact shingle similarity, so no pair below the threshold links.

Texts of equal shingle sets are one entry. In a group under one band value all
entries are first held against three leaders; only entries that the links found
by then leave in different components are compared one by one, in cells of a
bounded number, which give out links and no pairs.

Shingles are those of :func:`.simhash.fingerprint`: words split at ASCII space,
A-Z in lower case; a text of fewer words is one shingle; null is read as empty,
and texts without words equal each other only. Shingles are compared by their
XXH64 hashes.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import cut_lineage, short_batches
from starloom.operators.graph import components
from starloom.llm.simhash import SEED

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, LEADERS = 32, 5, 3
#: Nodes on either side of a cell in which a common value's nodes are compared.
GRID = 64, 512


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.array([], dtype="<u8")
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(line, SEED)], dtype="<u8")
    ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
    starts = [0, *ends[: len(parts) - words]]
    return np.unique(np.array([digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :], strict=True)], dtype="<u8"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


@functools.cache
def mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of ``n`` hash functions, fixed."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 64, (n, 1), dtype=np.uint64), rng.integers(0, 1 << 64, (n, 1), dtype=np.uint64) | np.uint64(1)


def band_values(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """One signed hash per band; none for an empty set."""
    import xxhash

    if not len(hashes):
        return []
    mask, factor = mixers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        mixed = (hashes[None, at : at + 256] ^ mask) * factor
        # a product's low bits depend on few bits of the hash: the high half is folded in
        np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(1), out=least)
    raw = least.astype("<u8").tobytes()
    return [int(np.uint64(xxhash.xxh64_intdigest(raw[8 * rows * i : 8 * rows * (i + 1)], i)).view(np.int64)) for i in range(bands)]


def add_bands(docs: DataFrame, *, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key of the shingle set, bands) per row."""
    short_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def signed(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh128_hexdigest(s.tobytes()) for s in sets]
            values = [band_values(s, bands, rows) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(values, pa.list_(pa.int64()))], names=["id", "key", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(signed, schema)


def verified(pairs: DataFrame, docs: DataFrame, *, least: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) of ids whose texts have the similarity, written down."""
    pairs = cut_lineage(pairs, "candidates")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("_need")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = cut_lineage(texts.join(needed, F.col("_id") == F.col("_need"), "left_semi"), "texts")
    both = pairs.join(texts.toDF("a", "_ta"), "a").join(texts.toDF("b", "_tb"), "b").select("a", "b", "_ta", "_tb")

    def near(batches):
        import pyarrow as pa

        for batch in batches:
            sets: dict[str | None, np.ndarray] = {}
            keep = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for x in (s, t):
                    if x not in sets:
                        sets[x] = shingle_set(x, words)
                keep.append(similarity(sets[s], sets[t]) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return cut_lineage(both.mapInArrow(near, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])), "links")


def links_within(placed: DataFrame, docs: DataFrame, *, least: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between the components ``c`` of the ``p`` nodes under each value ``v``, enough to join all that are linked.

    A value's nodes are dealt out to a grid of cells: a cell holds the shingle
    sets of some nodes on either side, compares those of different components
    and gives out only links that join two of them, never pairs.
    """
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.BinaryType())])

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=schema.names)

    needed = placed.select(F.col("node").alias("_need")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), text_col).join(needed.hint("merge"), F.col("node") == F.col("_need"), "left_semi")
    sets = cut_lineage(texts.mapInArrow(hashed, schema), "sets")
    rows, cols = F.ceil(F.col("p") / GRID[0]).cast("int"), F.ceil(F.col("p") / GRID[1]).cast("int")
    sized = placed.select("v", "node", "c", rows.alias("rows"), cols.alias("cols")).join(sets, "node")

    def dealt(side: int, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("node", F.lit(own)), F.col(own)).cast("int")
        alone = (F.col("rows") == 1) & (F.col("cols") == 1)
        # where there is one cell, a node stands on both sides of it
        part = sized.where(~alone) if side else sized
        part = part.withColumn("side", F.when(alone, 2).otherwise(side)).withColumn(own, at)
        return part.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("v", "rows", "cols", "side", "node", "c", "hashes")

    cell = ["v", "rows", "cols"]
    grid = dealt(0, "rows", "cols").unionByName(dealt(1, "cols", "rows"))
    grid = grid.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell).sortWithinPartitions(*cell)

    def found(batches):
        import pyarrow as pa

        now, left, right = None, [], []

        def compared():
            root: dict = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            out = []
            for node, c, own in left:
                for other, d, theirs in right:
                    if node >= other or min(len(own), len(theirs)) < least * max(len(own), len(theirs)):
                        continue
                    a, b = find(c), find(d)
                    if a == b:
                        continue
                    both = len(own & theirs)
                    if both >= least * (len(own) + len(theirs) - both):
                        root[b] = a
                        out.append((node, other))
            return out

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if (key := (r["v"], r["rows"], r["cols"])) != now:
                    if out := compared():
                        yield batch_of(out)
                    now, left, right = key, [], []
                entry = r["node"], r["c"], frozenset(np.frombuffer(r["hashes"], "<u8").tolist())
                if r["side"] != 1:
                    left.append(entry)
                if r["side"] != 0:
                    right.append(entry)
        if out := compared():
            yield batch_of(out)

    links = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return cut_lineage(grid.mapInArrow(found, links), "links")


def near_copies(docs: DataFrame, *, least: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) per row of ``docs``, whose ids are unique and not null: groups linked by similarity ``least``."""
    short_batches(docs.sparkSession)
    signed = cut_lineage(add_bands(docs, words=words, bands=bands, rows=rows, id_col=id_col, text_col=text_col), "bands")
    named = cut_lineage(signed.groupBy("key").agg(F.min("id").alias("node")), "sets")
    entries = signed.join(named, signed["id"] == named["node"], "left_semi").select(F.col("id").alias("node"), F.explode("bands").alias("v"))
    leaders = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), F.col("node").alias("node")))["node"] for i in range(LEADERS)]
    shared = entries.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*leaders)).alias("first")).where("n > 1")
    # only the few entries that share a value are carried on
    entries = cut_lineage(entries.join(shared, "v").select("v", "node", "first"), "entries")

    def pairs(df: DataFrame) -> DataFrame:
        return df.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    checks = {"least": least, "words": words, "id_col": id_col, "text_col": text_col}
    links = verified(pairs(entries.select(F.col("node").alias("x"), F.explode("first").alias("y"))), docs, **checks)
    groups = components(links, "a", "b").withColumnRenamed("node", "member")
    placed = entries.select("v", "node").join(groups, F.col("node") == F.col("member"), "left").select("v", "node", F.coalesce("component", "node").alias("c"))
    open_ = placed.groupBy("v").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("p")).where("low < high").select("v", "p")
    placed = cut_lineage(placed.join(open_, "v"), "open")
    links = links.unionByName(links_within(placed, docs, **checks))
    groups = components(links, "a", "b").withColumnRenamed("node", "member")
    members = named.join(groups, F.col("node") == F.col("member"), "left").select("key", F.coalesce("component", "node").alias("component_id"))
    return signed.join(members, "key").select(F.col("id").alias(id_col), "component_id")

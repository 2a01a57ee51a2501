"""Operator 8: near-duplicates by SimHash and multi-index hashing.

A fingerprint has 64 bits; bit k is set if it is set in over half of the XXH64
hashes of the text's word shingles. Two fingerprints link at ``radius`` or
fewer differing bits. The fingerprint is cut into segments; by the pigeonhole
principle two linked fingerprints differ in at most radius / segments bits in
one of them, so each segment's small Hamming ball is enumerated, looked up in
that segment's table, and the whole distance of every match is verified. With
two segments of 32 bits the tables stay sparse up to billions of rows.

Links are sought between distinct fingerprints only, so a group of copies of
any size is one entry, and each entry has at most C(64, <= radius) links
whatever the size of the corpus. Components come from :func:`starloom.operators.graph.components`.

Defined results for odd input: null text is read as empty; texts without words
have fingerprint zero, linked like any other; texts shorter than a shingle are
one shingle; long texts are hashed whole; repeated rows (also repeated or null
ids) each get a row, null ids never name a component unless all ids in it are
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import cut_lineage, short_batches
from starloom.operators.graph import components

SEED = 42
BITS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of one text."""
    import xxhash

    # bytes.lower() and bytes.split() know exactly A-Z and the six ASCII spaces
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = np.array([digest(b" ".join(parts), SEED)], dtype="<u8")
    else:
        line = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
        starts = [0, *ends[: len(parts) - words]]
        hashes = np.array([digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :], strict=True)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def add_fingerprints(docs: DataFrame, *, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as signed long) per row."""
    short_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("fingerprint", T.LongType())])

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(hashed, schema)


def ball(bits: int, radius: int) -> list[int]:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def hamming_links(codes: DataFrame, *, radius: int = 3, segments: int = 2, code_col: str = "fingerprint") -> DataFrame:
    """Pairs (a, b), a < b, of distinct codes at ``radius`` or fewer differing bits."""
    width = BITS // segments
    each = radius // segments
    code = F.col(code_col)

    def segment(i):
        return F.shiftrightunsigned(code, i * width).bitwiseAND(F.lit((1 << width) - 1))

    distinct = codes.select(code).where(code.isNotNull()).distinct()
    index = distinct.select(code.alias("b"), F.explode(F.array(*[F.struct(F.lit(i).alias("s"), segment(i).alias("v")) for i in range(segments)])).alias("k")).select("b", "k.*")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(width, each)])
    probes = distinct.select(code.alias("a"), F.explode(F.array(*[F.struct(F.lit(i).alias("s"), segment(i).alias("v")) for i in range(segments)])).alias("k"))
    probes = probes.select("a", "k.s", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("k.v")))).alias("v"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    # exploded probes look small to the planner, which knows only the table they come from: never broadcast them
    return probes.join(index.hint("merge"), ["s", "v"]).where(near).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, radius: int = 3, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) per row: the least id of the row's group."""
    prints = cut_lineage(add_fingerprints(docs, words=words, id_col=id_col, text_col=text_col), "fingerprints")
    return components_of(prints, radius=radius, id_col=id_col)


def components_of(prints: DataFrame, *, radius: int = 3, id_col: str = "doc_id") -> DataFrame:
    links = hamming_links(prints, radius=radius)
    groups = components(links, "a", "b")
    first = prints.groupBy("fingerprint").agg(F.min(id_col).alias("_first"))
    named = first.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = named.groupBy("component").agg(F.min("_first").alias("component_id"))
    members = named.select("fingerprint", "component").join(least, "component").select("fingerprint", "component_id")
    return prints.join(members, "fingerprint").select(id_col, "fingerprint", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")

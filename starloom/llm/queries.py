"""The ten operators and the pipeline as queries (spark, sf_dir) -> DataFrame, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import hamming_search, hnsw, linededup, packing, pii, quality, sentencepiece_scan, simhash, tokenfiles, warc
from starloom.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_verdicts(table(spark, sf_dir, "documents"))


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_search.sign_codes(table(spark, sf_dir, "embeddings"))
    return hamming_search.hamming_topk(codes, codes.where(F.col("vec_id") % 100 == 0), 10)


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_digest(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest_neighbours(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.digest_pieces(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_hamming_topk, op3_arc_to_warc, op4_token_files, op5_packing, op6_pii, op7_hnsw, op8_simhash, op9_quality, op10_sentencepiece, pipeline)
    return {f.__name__: f for f in ops}


OP2_SQL = """
with codes as (
  select vec_id, list_transform(range(64), lambda k: embedding[k + 1] > 0) as bits
  from embeddings
), pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    list_sum(list_transform(range(64), lambda k: case when q.bits[k + 1] <> c.bits[k + 1] then 1 else 0 end)) as distance
  from codes q, codes c
  where q.vec_id % 100 = 0 and q.vec_id <> c.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs
)
select query_id, cast(rank as integer) as rank, vec_id, cast(distance as integer) as distance from ranked where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_hamming_topk": OP2_SQL}

"""Corpus cleaning in five stages, each calling one operator of ``starloom.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of documents. Stages that change texts bring ``n_chars`` up to date.

Defined results for odd input, of all stages: null and empty texts are scored
like any other, stay as they are, and near dedup keeps one of all texts without
words; rows of equal or null ids are separate documents; extra columns are kept
whatever their names, but for packing, which returns pieces; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import common, linededup, packing, pii, quality, shingles, simhash
from starloom.operators.graph import components


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = common.free_name("score", docs.columns)
    scored = quality.score_quality(docs, model, score_col=score)
    return scored.where(F.col(score) >= quality.ACCEPT).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, equal or nearly so, are taken out; documents that lose every line go."""
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays.

    Texts link by SimHash fingerprints at 3 or fewer differing bits, as in
    :mod:`starloom.llm.simhash`, and by five-word shingle similarity of at least
    0.8, at which fingerprints mostly differ in more bits. The row that stays is that of the least id, nulls last, then of the least hash of the text.
    """
    row = common.free_name("_row", docs.columns)
    held = common.numbered(docs, row)
    rows = held.select(F.col(row).alias("_row"), "doc_id", "text")
    close = common.cut_lineage(simhash.near_duplicates(rows, id_col="_row").select("_row", "component_id"), "simhash")
    similar = common.cut_lineage(shingles.near_copies(rows, id_col="_row").select("_row", "component_id"), "similar")
    # both name a group by one of its rows
    joint = components(close.unionByName(similar), "_row", "component_id").select(F.col("node").alias("_row"), F.col("component").alias("_joint"))
    groups = rows.select("_row").join(joint, "_row", "left").select("_row", F.coalesce("_joint", "_row").alias("component_id"))
    placed = rows.select("_row", common.row_place("doc_id", "text").alias("_at"))
    keep = groups.join(placed, "_row").groupBy("component_id").agg(F.min("_at").alias("_at")).select(F.col("_at.row").alias(row))
    return held.join(keep, row, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    found = pii.find_pii(docs)
    clean = F.col(found.columns[-1])
    chars = F.coalesce(F.length(clean), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", chars).withColumn("text", clean).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("packing", pack),
]

#: Compression, edit joins and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.cut_lineage(docs, f"stage{i}")
    return docs

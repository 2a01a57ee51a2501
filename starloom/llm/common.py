"""Helpers shared by the training-data operators.

Everything an operator materialises between jobs goes to the folder named in
``spark.checkpoint.dir`` (shared by driver and executors), written by Spark or
by :mod:`pyarrow.fs`, so a lost executor never takes intermediate data along.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.sources.shared import cut_lineage, discard, fresh_path

__all__ = ["as_uri", "cut_lineage", "discard", "free_name", "fresh_path", "numbered", "open_input", "open_output", "row_place", "short_batches", "table", "whole_text"]

#: Rows per Arrow batch handed to Python, and their bytes: texts can be long.
ARROW_ROWS, ARROW_BYTES = "256", "16777216"


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs`` written with a number of each row, which is unique, never null and stays as written."""
    return cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def row_place(id_col: str, text_col: str) -> Column:
    """Sorts numbered rows by id, nulls last, then by a hash of the text, then by number; never null, different for every row."""
    return F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col("_row").alias("row"))


def short_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: few rows and bytes per Arrow batch.

    Plans read these settings when they run, so they stay set; they change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= int(most):
            spark.conf.set(key, most)


def free_name(name: str, taken) -> str:
    """``name``, with underscores behind it while it is taken (names don't tell cases apart)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def open_output(uri: str):
    """A new file at ``uri`` (any file system pyarrow knows), as a binary stream."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """The file at ``uri`` as a seekable binary stream."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)

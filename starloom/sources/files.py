"""Readers, writers and discovery of result files.

Hive-style folders (``cosmo_idx=3/phase_idx=0/...``) carry keys that the
reference layout keeps in file names; both forms are understood.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.labelled import merge

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc", ".txt": "csv"}


def suffix(path: str) -> str:
    found = re.search(r"\.[A-Za-z0-9]+$", path.rstrip("/"))
    return found[0].lower() if found else ""


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table, its format told by the suffix; others raise ``ValueError``."""
    kind = FORMATS.get(suffix(path))
    if kind is None:
        raise ValueError(f"no reader for {path!r}; known suffixes are {sorted(FORMATS)}")
    reader = spark.read.options(**options)
    if kind == "csv":
        reader = reader.option("header", options.get("header", True)).option("inferSchema", options.get("inferSchema", True))
    return reader.format(kind).load(path)


def exists(spark: SparkSession, path: str) -> bool:
    """True if the path is there, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in found) if found else []


def numbers(paths: list[str], key: str) -> list[int]:
    """The integers that follow ``key`` in file or folder names, sorted, each once."""
    return sorted({int(m[1]) for p in paths if (m := re.search(rf"{re.escape(key)}=?0*(\d+)(?!.*{re.escape(key)})", p))})


def with_number(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the integer that follows ``key`` in each row's file name."""
    return df.withColumn(name, F.regexp_extract(F.input_file_name(), rf"{re.escape(key)}=?0*(\d+)", 1).cast("int"))


def load_merged(spark: SparkSession, paths: list[str | None], values: tuple[str, ...]) -> DataFrame:
    """Those of the tables that exist, merged on shared coordinates; none raises ``FileNotFoundError``."""
    frames = [read_any(spark, p) for p in paths if p and exists(spark, p)]
    if not frames:
        raise FileNotFoundError(f"none of {paths} exists")
    return merge(frames, values)


def cosmologies(spark: SparkSession, path: str, wanted: list[int], mapping: dict[str, str], key: str = "root") -> DataFrame:
    """Parameters of the wanted cosmologies, joined by the number in the key column, renamed."""
    table = spark.read.option("header", True).option("inferSchema", True).csv(path)
    table = table.toDF(*[c.strip() for c in table.columns])
    number = F.regexp_extract(F.trim(key), r"(\d+)\s*$", 1).cast("int")
    return table.withColumn("cosmo_idx", number).where(F.col("cosmo_idx").isin(wanted)).select("cosmo_idx", *[F.col(a).alias(b) for a, b in mapping.items()])


def survey(df: DataFrame, z_range: tuple[float, float] | None = None, condition=None) -> DataFrame:
    """(RA, DEC, Z, WEIGHT, WEIGHT_FKP): absent weights are 1; redshift range and condition are pushed down."""
    named = {c.upper(): c for c in df.columns}
    out = df.select(*[(F.coalesce(F.col(named[c]), F.lit(1.0)) if c in named else F.lit(1.0)).alias(c) if c.startswith("WEIGHT") else F.col(named[c]).alias(c) for c in ("RA", "DEC", "Z", "WEIGHT", "WEIGHT_FKP")])
    if z_range:
        out = out.where(F.col("Z").between(*z_range))
    return out if condition is None else out.where(condition)


def save(df: DataFrame, path: str, *, attributes: dict | None = None, partition_by: tuple[str, ...] = (), replace: bool = False) -> None:
    """Written in parallel, format by suffix, attributes as JSON beside it; an existing table is left alone unless replaced."""
    spark = df.sparkSession
    kind = FORMATS.get(suffix(path), "parquet")
    writer = df.write.mode("overwrite" if replace else "ignore").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.save(path)
    if attributes is not None:
        spark.createDataFrame([(json.dumps(attributes, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + ".attributes")


def attributes(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path.rstrip("/") + ".attributes").first()[0])


def save_parameters(df: DataFrame, path: str, order: list[str], digits: int = 5) -> None:
    """Known columns in order, with a fixed number of digits, as CSV."""
    kept = [c for c in order if c in df.columns]
    df.select(*[F.format_string(f"%.{digits}f", F.col(c).cast("double")).alias(c) for c in kept]).write.mode("overwrite").option("header", True).csv(path)


def handle(stat: str, filters: dict | None = None, slices: dict | None = None) -> str:
    """Name of a result: the statistic, its selections as runs of labels, its ranges."""
    from starloom.functions.text import runs

    parts = [stat]
    for k, v in (filters or {}).items():
        parts.append(f"{k}_{runs(v)}" if isinstance(v, (list, tuple)) and all(isinstance(x, int) for x in v) else f"{k}_{'-'.join(map(str, v)) if isinstance(v, (list, tuple)) else v}")
    for k, (a, b) in (slices or {}).items():
        parts.append(f"{k}_{a}-{b}")
    return "_".join(parts)


def combined_handle(handles: list[str]) -> str:
    return "+".join(handles)

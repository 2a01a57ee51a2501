"""Labelled N-dimensional arrays as long tables.

A table has sample dimensions, feature dimensions and a value column. Queries
follow one order: filters, dropping of empty labels, flattening, selection by
index, squeezing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from starloom.operators.ranks import ranked


@dataclass(frozen=True)
class LabelledTable:
    frame: DataFrame
    sample: tuple[str, ...]
    features: tuple[str, ...]
    value: str = "value"
    nan_dims: tuple[str, ...] = ()

    @property
    def dims(self) -> tuple[str, ...]:
        return (*self.sample, *self.features)

    def _with(self, frame: DataFrame, gone: tuple[str, ...] = ()) -> LabelledTable:
        def left(dims):
            return tuple(d for d in dims if d not in gone)

        return replace(self, frame=frame, sample=left(self.sample), features=left(self.features), nan_dims=left(self.nan_dims))

    def select(self, **labels) -> LabelledTable:
        """Rows with the given labels. A scalar drops its dimension; keys that are no dimension are ignored."""
        frame, gone = self.frame, []
        for dim, wanted in labels.items():
            if dim not in self.dims:
                continue
            if isinstance(wanted, (list, tuple, set, range)):
                frame = frame.where(F.col(dim).isin(list(wanted)))
            else:
                frame = frame.where(F.col(dim) == wanted).drop(dim)
                gone.append(dim)
        return self._with(frame, tuple(gone))

    def require(self, **labels) -> LabelledTable:
        """:meth:`select`, but labels that don't occur raise ``KeyError``."""
        for dim, wanted in labels.items():
            if dim in self.dims:
                asked = list(wanted) if isinstance(wanted, (list, tuple, set, range)) else [wanted]
                there = {r[0] for r in self.frame.where(F.col(dim).isin(asked)).select(dim).distinct().collect()}  # no more than were asked for
                if missing := [x for x in asked if x not in there]:
                    raise KeyError(f"{dim} has no {missing}")
        return self.select(**labels)

    def slice(self, **ranges) -> LabelledTable:
        """Rows between two labels, both ends included."""
        frame = self.frame
        for dim, (low, high) in ranges.items():
            if dim in self.dims:
                frame = frame.where(F.col(dim).between(low, high))
        return self._with(frame)

    def drop_empty(self) -> LabelledTable:
        """Without the labels of ``nan_dims`` that have no value at all."""
        frame = self.frame
        for dim in self.nan_dims:
            full = frame.groupBy(dim).agg(F.count(F.when(~F.isnan(self.value), F.col(self.value))).alias("_n")).where("_n > 0").select(dim)
            frame = frame.join(full, dim, "left_semi")
        return self._with(frame.select(*self.frame.columns))

    def _numbered(self, dims: tuple[str, ...], name: str, frame: DataFrame) -> DataFrame:
        """Dense numbers of label combinations, made on the labels alone, of which there may be many."""
        if not dims:
            return frame.withColumn(name, F.lit(0))
        labels = ranked(frame.select(*dims).distinct(), list(dims), name, "_total").withColumn(name, F.col(name).cast("int")).drop("_total")
        return frame.join(labels, list(dims))

    def flatten(self) -> DataFrame:
        """``frame`` with dense ``sample`` and ``feature`` numbers."""
        return self._numbered(self.features, "feature", self._numbered(self.sample, "sample", self.frame))

    def take(self, indices: list[int]) -> DataFrame:
        """Features by their number, in the order given, with their ``position``."""
        spark = self.frame.sparkSession
        wanted = spark.createDataFrame([(i, b) for i, b in enumerate(indices)], "position int, feature int")
        return self._numbered(self.features, "feature", self.frame).join(F.broadcast(wanted), "feature")

    def query(self, select: dict | None = None, slices: dict | None = None, indices: list[int] | None = None, drop_empty: bool = True) -> DataFrame:
        """Labels, slices, empty labels, dense numbers and selection by index, in this order."""
        out = self.select(**(select or {})).slice(**(slices or {}))
        if drop_empty:
            out = out.drop_empty()
        flat = out.flatten()
        if indices is None:
            return flat
        wanted = flat.sparkSession.createDataFrame([(i, b) for i, b in enumerate(indices)], "position int, feature int")
        return flat.join(F.broadcast(wanted), "feature")  # as many rows as were asked for

    def squeeze(self) -> LabelledTable:
        """Without dimensions that have a single label."""
        counts = self.frame.agg(*[F.count_distinct(d).alias(d) for d in self.dims]).first()
        gone = tuple(d for d in self.dims if counts[d] == 1)
        return self._with(self.frame.drop(*gone), gone)

    def coordinates(self, dim: str) -> DataFrame:
        if dim not in self.dims:
            raise KeyError(dim)
        return self.frame.select(dim).distinct()

    def vectors(self) -> DataFrame:
        """One row per sample: its values in feature order."""
        packed = F.array_sort(F.collect_list(F.struct(*self.features, F.col(self.value).alias("_v"))))
        return self.frame.groupBy(*self.sample).agg(F.transform(packed, lambda s: s["_v"]).alias("values"))

    def with_features(self, other: LabelledTable, name: str = "member") -> LabelledTable:
        """Two tables side by side along the features, told apart by ``name``."""
        both = self.frame.withColumn(name, F.lit(0)).unionByName(other.frame.withColumn(name, F.lit(1)), allowMissingColumns=True)
        dims = (name, *self.features, *(f for f in other.features if f not in self.features))
        return LabelledTable(both, self.sample, dims, self.value, self.nan_dims)


def merge(frames: list[DataFrame], values: tuple[str, ...]) -> DataFrame:
    """Full outer join on the coordinates that the frames share."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, [c for c in out.columns if c in f.columns and c not in values], "full")
    return out


def split(frame: DataFrame, labels: dict[str, list]) -> tuple[DataFrame, DataFrame]:
    """(rows with all of the labels, the others)."""
    inside = F.lit(True)
    for dim, wanted in labels.items():
        inside = inside & F.coalesce(F.col(dim).isin(list(wanted)), F.lit(False))
    return frame.where(inside), frame.where(~inside)


def first_n(frame: DataFrame, group: tuple[str, ...], label: str, n: int) -> DataFrame:
    """The first ``n`` labels of every group and their new numbers from 0."""
    w = Window.partitionBy(*group).orderBy(label)
    numbered = frame.select(*group, label).distinct().withColumn("new_idx", (F.row_number().over(w) - 1).cast("int"))
    return numbered.where(F.col("new_idx") < n)


def equal_counts(frame: DataFrame, group: str, label: str) -> int:
    """Number of labels per group; ``ValueError`` if groups differ."""
    counts = frame.groupBy(group).agg(F.count_distinct(label).alias("n")).agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    if counts["low"] != counts["high"]:
        raise ValueError(f"groups of {group} have {counts['low']} to {counts['high']} labels of {label}")
    return counts["low"]

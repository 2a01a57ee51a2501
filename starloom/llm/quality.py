"""Operator 9: quality classifier from compression.

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is compressed with each; the difference of the two
sizes, over the larger one, is turned into a probability by a logistic
calibration fitted on labelled texts the dictionaries never saw. Beside the
difference the calibration sees what the difference depends on: the length of
the text, the two compression rates and difference times length (on held-out
rows the difference alone has an area under the curve of about 0.96, with them
0.997; ``inputs=1`` calibrates the difference alone).

Defined results for odd input
    null text      read as empty; an empty text has difference 0 and gets the
                   calibrated score at that point (never null)
    long texts     compressed whole
    repeated rows  each row is scored by itself, equal texts score equally
    empty table    empty result; without a labelled text of each class the score
                   is the share of good labels (0.5 without any label)
    few labels     any number from one text a class on is used; a single text
                   serves as dictionary and for calibration
    labels         a document labelled both good and bad teaches nothing; equal
                   labels given twice count once; other values and nulls are not
                   labels; of rows that share an id one is taken
    extra columns  kept by :func:`score_quality`; a clash with ``score_col`` is
                   resolved in favour of the new column
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import short_batches

#: A document is accepted from this score on.
ACCEPT = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and calibration; a few hundred KB whatever the corpus."""

    good: bytes = b""
    bad: bytes = b""
    level: int = 3
    weights: tuple = ()
    mean: tuple = ()
    scale: tuple = ()
    prior: float = 0.5
    sizes: dict = field(default_factory=dict)

    def compressors(self):
        import zstandard as zstd

        return [
            zstd.ZstdCompressor(level=self.level, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_checksum=False)
            for d in (self.good, self.bad)
        ]

    def probability(self, features) -> float:
        z = self.weights[0]
        for x, m, s, w in zip(features[: len(self.mean)], self.mean, self.scale, self.weights[1:], strict=True):
            z += w * (x - m) / s
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def features(raw: bytes, good, bad) -> tuple:
    """Normalised size difference, length and the two rates of one text."""
    a, b = len(good.compress(raw)), len(bad.compress(raw))
    difference = (b - a) / max(a, b, 1)
    size = math.log1p(len(raw))
    return difference, size, a / (len(raw) + 20), b / (len(raw) + 20), difference * size


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = 1500, max_chars: int = 60_000, dict_bytes: int = 65_536, chunk: int = 4096, level: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", holdout: int = 5, inputs: int = 5) -> QualityModel:
    """Fit on at most ``per_class`` labelled texts of each class.

    The sample is bounded by documented parameters (``per_class`` texts of at
    most ``max_chars`` characters each), chosen by a hash of the id, so it is
    the same in every run. Rows with crc32(id as text) mod ``holdout`` equal to
    0 are never read for training. One half feeds the dictionaries, the other
    the calibration, which uses the first ``inputs`` of :func:`features`. The
    driver holds at most 2 x per_class x max_chars characters.
    """
    import numpy as np
    import zstandard as zstd

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.length("_t") >= 1)
    marks = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (F.crc32(F.col("_id").cast("string").cast("binary")) % holdout != 0))
        .join(texts.select("_id", (F.length("_t") > max_chars).alias("_long")), "_id")
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"), F.min("_y").alias("_other"), F.min("_long").alias("_long"))
        .where(F.col("_y") == F.col("_other"))
        .drop("_other")
    )
    order = [F.xxhash64("_id", F.lit("quality")), F.col("_id")]
    picked = None
    for y in (0, 1):
        part = marks.where(F.col("_y") == y).orderBy("_long", *order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of a few numbers: a size fixed by the parameter
    rows = texts.join(F.broadcast(picked), "_id").where((F.length("_t") > max_chars) == F.col("_long"))
    rows = rows.select("_id", "_y", F.substring("_t", 1, max_chars).alias("_t")).dropDuplicates(["_id"]).orderBy(*order).collect()
    split = {y: [r["_t"].encode() for r in rows if r["_y"] == y] for y in (0, 1)}
    known = sum(map(len, split.values()))
    prior = len(split[1]) / known if known else 0.5
    if not split[0] or not split[1]:
        return QualityModel(prior=prior)

    def dictionary(samples: list[bytes]) -> bytes:
        pieces = [t[i : i + chunk] for t in samples for i in range(0, len(t), chunk)]
        size = min(dict_bytes, max(2048, sum(map(len, pieces)) // 10))
        try:
            return zstd.train_dictionary(size, pieces).as_bytes()
        except zstd.ZstdError:  # too little material to select from: the texts themselves are the dictionary
            return b"\n".join(pieces)[-dict_bytes:]

    half = {y: len(t) // 2 for y, t in split.items()}
    model = QualityModel(good=dictionary(split[1][: max(1, half[1])]), bad=dictionary(split[0][: max(1, half[0])]), level=level)
    pair = model.compressors()
    x = np.array([features(t, *pair)[:inputs] for y in (0, 1) for t in split[y][half[y] :]])
    y = np.array([y for y in (0, 1) for _ in split[y][half[y] :]], dtype=float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    q = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, ridge = np.zeros(q.shape[1]), 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(q @ w, -30, 30)))
        step = np.linalg.solve(q.T @ (q * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), q.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return QualityModel(model.good, model.bad, level, tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, scale)), prior, {y: len(t) for y, t in split.items()})


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score_col``, the probability of a good text."""
    short_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != score_col]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(score_col, T.DoubleType())])
    at = kept.index(text_col)

    def score(batches):
        import pyarrow as pa

        pair = model.compressors() if model.weights else None
        for batch in batches:
            scores = [model.probability(features((t or "").encode(), *pair)) if pair else model.prior for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*kept, score_col])

    return docs.select(*kept).mapInArrow(score, schema)

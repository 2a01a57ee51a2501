"""Pair counts of points with integer coordinates in a periodic box, from the correlation of their fields.

Where pairs are many, :func:`pair_bins` counts all of them by displacement
without visiting any: the cross spectrum of two fields holds the numbers of
pairs of every displacement. The transform along x is taken a few wave numbers
at a time, so a task holds a tile of the spectrum, never a mesh; the tiles' sums
by bin are added up and are whole numbers but for rounding errors, which are
bounded beforehand and looked at afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.geometry import AXES
from starloom.sources.shared import CLEANUP, cut_lineage, discard, fresh_path, setting

#: Bytes of a tile of one field's spectrum, of the cells of a slab, rows that a task deals out at once.
TILE, SLAB, ROWS = 96_000_000, 10_000_000, 1 << 21
#: Widest box whose spectrum fits in tiles, most fields, and candidate pairs a field's cell that cost as much as its transform.
WIDEST, FIELDS, WORTH = 2000, 16, 0.4

BLOBS = "f int, slab int, code binary, w binary, kind string"
PLANES = "f int, slab int, rows binary, xs binary, values binary, layers binary, norm double"
SUMS = "pair int, bin int, n double"


def fits(df: DataFrame, box: float, reach: float) -> bool:
    """Whether the table's types, the box and the reach allow counts by fields."""
    kinds = dict(df.dtypes)
    whole = all(kinds[c] in ("bigint", "int", "smallint", "tinyint") for c in (*AXES, *(["w"] if "w" in kinds else [])))
    return whole and box == int(box) and 3 <= box <= WIDEST and int(box // reach) >= 3


def worth(pairs: list[tuple[int, int]], rows: list[int], box: float, reach: float) -> bool:
    """Whether visiting the candidates, the points of neighbouring cells, costs more than the fields' transforms."""
    cells = int(box // reach) ** 3
    visited = sum(rows[a] * rows[b] * (13.5 if a == b else 27) / cells for a, b in pairs)
    return visited > WORTH * box**3 * len({f for p in pairs for f in p})


def summary(points: DataFrame, fields: int, box: int) -> list[dict] | None:
    """Rows, sums of weights and of their squares by field; None where a point lies outside the box or a weight is under 1."""
    inside = F.lit(True)
    for c in AXES:
        inside = inside & F.col(c).between(0, box - 1)
    w = F.col("w").cast("decimal(38,0)")
    got = points.groupBy("f").agg(F.count(F.lit(1)).alias("rows"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.min(inside).alias("inside"), F.min("w").alias("least")).collect()
    found = {r["f"]: r.asDict() for r in got}
    if any(not r["inside"] or r["least"] < 1 for r in found.values()):
        return None
    return [found.get(f, {"rows": 0, "w": 0, "w2": 0, "least": 0}) for f in range(fields)]


def _dealt(box: int, height: int):
    """Rows to blobs of (field, slab): place in the slab, and weights if not all are 1."""

    def emit(parts):
        f, x, y, z, w = [np.concatenate(p) for p in zip(*parts, strict=True)]
        slab = z // height
        code = (((z - slab * height) * box + y) * box + x).astype(np.int32)
        key = f.astype(np.int64) * (box // height + 1) + slab
        order = np.argsort(key, kind="stable")
        key, code, w = key[order], code[order], w[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        out = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            part = w[a:b]
            ones = bool((part == 1).all())
            kind = np.min_scalar_type(int(part.max()))
            at = int(key[a])
            out.append({"f": at // (box // height + 1), "slab": at % (box // height + 1), "code": code[a:b].tobytes(), "w": None if ones else part.astype(kind).tobytes(), "kind": np.dtype(kind).str})
        schema = pa.schema([("f", pa.int32()), ("slab", pa.int32()), ("code", pa.binary()), ("w", pa.binary()), ("kind", pa.string())])
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("f", *AXES, "w")])
                held += batch.num_rows
            if held >= ROWS:
                yield emit(parts)
                parts, held = [], 0
        if parts:
            yield emit(parts)

    return deal


def _laid(box: int, height: int):
    """A slab's blobs to its occupied cells, those that come n-th in their row of cells together, rows in one order."""

    def lay(table: pa.Table) -> pa.Table:
        dense = np.zeros(height * box * box)
        for code, w, kind in zip(*[table.column(c).to_pylist() for c in ("code", "w", "kind")], strict=True):
            at = np.frombuffer(code, np.int32)
            if w is None and len(at) < len(dense) // 20:
                np.add.at(dense, at, 1.0)
            else:
                dense += np.bincount(at, None if w is None else np.frombuffer(w, kind), minlength=len(dense))
        full = np.flatnonzero(dense)
        values, xs = dense[full], full % box
        counts = np.bincount(full // box, minlength=height * box)
        rank = (np.arange(len(full)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint16)
        # the fullest rows first, so those with an n-th cell are the first so many
        rows = np.argsort(-counts, kind="stable")
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        order = np.lexsort((np.repeat(place, counts), rank))
        layers = np.bincount(rank)
        ones = bool((values == 1).all())
        head = {c: table.column(c)[0].as_py() for c in ("f", "slab")}
        row = head | {"rows": rows.astype(np.uint32).tobytes(), "xs": xs[order].astype(np.uint16).tobytes(), "values": None if ones else values[order].tobytes(), "layers": layers.astype(np.int32).tobytes(), "norm": float((values * values).sum())}
        kinds = {"rows": pa.binary(), "xs": pa.binary(), "values": pa.binary(), "layers": pa.binary(), "norm": pa.float64()}
        return pa.Table.from_pylist([row], schema=pa.schema([("f", pa.int32()), ("slab", pa.int32()), *kinds.items()]))

    return lay


def _planes(uri: str, f: int) -> Iterator[dict]:
    from pyarrow import fs
    from pyarrow import parquet as pq

    system, path = fs.FileSystem.from_uri(f"{uri}/f={f}")
    for file in system.get_file_info(fs.FileSelector(path)):
        if file.base_name.endswith(".parquet"):
            for batch in pq.ParquetFile(system.open_input_file(file.path)).iter_batches(batch_size=2, use_threads=False):
                yield from batch.to_pylist()


def _spectrum(uri: str, f: int, box: int, height: int, waves: np.ndarray) -> np.ndarray:
    """(kx, ky, kz) for these kx: the field's Fourier transform."""
    angle = -2 * np.pi * (np.outer(np.arange(box), waves) % box) / box
    phase = np.exp(1j * angle)
    k = len(waves)
    half = np.zeros((box, k, box), complex)
    for plane in _planes(uri, f):
        rows, xs = np.frombuffer(plane["rows"], np.uint32), np.frombuffer(plane["xs"], np.uint16)
        values = None if plane["values"] is None else np.frombuffer(plane["values"], float)
        line = np.zeros((height * box, k), complex)
        a = 0
        for m in np.frombuffer(plane["layers"], np.int32).tolist():
            part = phase.take(xs[a : a + m], axis=0)
            if values is not None:
                part *= values[a : a + m, None]
            line[:m] += part
            a += m
        ordered = np.empty_like(line)
        ordered[rows] = line
        low = plane["slab"] * height
        high = min(box, low + height)
        along = np.ascontiguousarray(ordered.reshape(height, box, k)[: high - low].transpose(0, 2, 1))
        half[low:high] = np.fft.fft(along, axis=2)
    flat = half.reshape(box, k * box)
    out = np.empty((k * box, box), complex)
    for a in range(0, k * box, 256):
        out[a : a + 256] = np.fft.fft(np.ascontiguousarray(flat[:, a : a + 256].T), axis=1)
    return out.reshape(k, box, box)


def _tile(uri: str, present: set[int], pairs: list[tuple[int, int]], ids: np.ndarray, box: int, height: int, reach: int, width: int):
    """Tiles of the spectrum to their shares of every bin of every pair of fields."""

    def cosines(waves):
        d = np.arange(reach + 1)
        return np.where(d == 0, 1.0, 2.0) * np.cos(2 * np.pi * (np.outer(waves, d) % box) / box)

    def folded(p, axis):
        p = np.moveaxis(p, axis, 0)
        out = p[: box // 2 + 1].copy()
        out[1 : (box + 1) // 2] += p[: box // 2 : -1]
        return np.moveaxis(out, 0, axis)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = cosines(np.arange(box // 2 + 1))
        for batch in batches:
            for t in batch.column(0).to_pylist():
                waves = np.arange(t * width, min((t + 1) * width, box // 2 + 1))
                # the other half of the wave numbers gives the same
                share = cosines(waves) * np.where((waves == 0) | (2 * waves == box), 1.0, 2.0)[:, None] / float(box) ** 3
                held, out = {}, []
                for p, (a, b) in enumerate(pairs):
                    for f in {a, b} - held.keys():
                        held[f] = _spectrum(uri, f, box, height, waves) if f in present else None
                    total = np.zeros((reach + 1,) * 3)
                    if a in present and b in present:
                        for k in range(len(waves)):
                            u, v = held[a][k], held[b][k]
                            power = folded(u.real * v.real + u.imag * v.imag, 1) @ low
                            total += share[k][:, None, None] * (low.T @ folded(power, 0))
                    sums = np.bincount(ids, total.ravel(), minlength=int(ids.max(initial=0)) + 1)
                    out += [{"pair": p, "bin": i, "n": n} for i, n in enumerate(sums.tolist()) if i]
                    for f in held.keys() - {f for q in pairs[p + 1 :] for f in q}:
                        held.pop(f)
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("pair", pa.int32()), ("bin", pa.int32()), ("n", pa.float64())]))

    return tile


def pair_bins(points: DataFrame, pairs: list[tuple[int, int]], found: list[dict], reach: float, box: int, bins: dict[str, tuple[Column, int]]) -> DataFrame | None:
    """(pair, bins, n): sums of weight products of the pairs of points within ``reach``, exactly.

    ``points`` has (f, x, y, z, w), f the number of the field, and ``found`` their :func:`summary`;
    ``pairs`` are pairs of fields, a field with itself giving each unordered pair of rows once.
    ``bins`` must not depend on the signs of dx, dy and dz. None where rounding could reach a half.
    """
    spark = points.sparkSession
    r, height = int(reach), max(1, SLAB // box**2)
    width = max(1, TILE // (16 * box * box))
    # the bin of every displacement, by the same expressions as for pairs
    side = spark.range((r + 1) ** 3).select("id", *[(F.floor(F.col("id") / (r + 1) ** k) % (r + 1)).cast("long").alias(f"d{c}") for c, k in (("x", 2), ("y", 1), ("z", 0))])
    side = side.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(F.col("d2") <= F.lit(reach) * F.lit(reach))
    for name, (value, most) in bins.items():
        side = side.withColumn(f"_{name}", value).where(F.col(f"_{name}") < most)
    placed = side.select("id", *[F.col(f"_{b}") for b in bins]).toArrow()
    keys = np.stack([placed.column(f"_{b}").to_numpy() for b in bins], axis=1)
    names, at = np.unique(keys, axis=0, return_inverse=True)
    ids = np.zeros((r + 1) ** 3, np.int64)
    ids[placed.column("id").to_numpy()] = at.ravel() + 1

    blobs = points.select(F.col("f").cast("int").alias("f"), *[F.col(c).cast("long").alias(c) for c in (*AXES, "w")]).mapInArrow(_dealt(box, height), BLOBS)
    planes = blobs.groupBy("f", "slab").applyInArrow(_laid(box, height), PLANES)
    uri = fresh_path(spark, "planes")
    with setting(spark, CLEANUP, "true"):
        planes.write.option("compression", "zstd").partitionBy("f").parquet(uri)
    norms = {x["f"]: x["n"] for x in spark.read.parquet(uri).groupBy("f").agg(F.sum("norm").alias("n")).collect()}
    worst = max((sqrt(norms.get(a, 0) * norms.get(b, 0)) for a, b in pairs), default=0)
    if worst * (2 * r + 1) ** 1.5 * 2e-15 > 0.05:
        return None
    tiles = ceil((box // 2 + 1) / width)
    shares = spark.range(0, tiles, 1, tiles).mapInArrow(_tile(uri, set(norms), pairs, ids, box, height, r, width), SUMS)
    sums = cut_lineage(shares, "shares")
    got = sums.groupBy("pair", "bin").agg(F.sum("n").alias("n")).collect()
    planes = spark.read.parquet(uri)
    planes.written_to = uri
    discard(planes, sums)
    nearest = int(ids[0])
    out = []
    for p, i, n in got:
        a, b = pairs[p]
        if abs(n) > 2**47 or abs(n - round(n)) > 0.1:
            return None
        n = round(n)
        if a == b:
            # every row met itself, and every other row twice
            n = (n - (int(found[a]["w2"]) if i == nearest else 0)) // 2
        # weights are 1 at least, so a sum of 0 has no pairs
        if n:
            out.append((p, *[int(v) for v in names[i - 1]], n))
    kinds = [f"{b} {side.schema['_' + b].dataType.simpleString()}" for b in bins]
    return spark.createDataFrame(out, ", ".join(["pair int", *kinds, "n long"]))

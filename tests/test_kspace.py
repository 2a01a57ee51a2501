"""Fourier-space operators against numpy, and catalog operators without SQL."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import catalogs, kspace, mesh, morphology, observables, sky

CELLS, CELL = 8, 10
BOX = float(CELLS * CELL)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    p = rng.integers(0, CELLS * CELL, (400, 3))
    p[:150] = (p[:150] // 3 + 20) % (CELLS * CELL)
    return p, spark.createDataFrame([(i, *map(int, x), 1) for i, x in enumerate(p)], "id long, x long, y long, z long, w long")


def cube(rows, name="value"):
    out = np.zeros((CELLS,) * 3)
    for r in rows:
        out[r.ix, r.iy, r.iz] = r[name]
    return out


@pytest.fixture(scope="module")
def field(points):
    df = mesh.contrast(mesh.paint(points[1], CELLS, CELL), CELLS)
    return df, cube(df.collect())


def test_transform_and_back(field):
    df, a = field
    modes = kspace.transform(df, CELLS).collect()
    got = cube(modes, "re") + 1j * cube(modes, "im")
    assert np.allclose(got, np.fft.fftn(a))
    back = kspace.transform(kspace.transform(df, CELLS), CELLS, inverse=True).collect()
    assert np.allclose(cube(back, "re"), a) and np.allclose(cube(back, "im"), 0)


def test_filters_and_displacement(field):
    df, a = field
    k = 2 * np.pi * np.fft.fftfreq(CELLS, CELL)
    k[CELLS // 2] *= -1  # the middle mode counts as positive
    kx, ky, kz = np.meshgrid(k, k, k, indexing="ij")
    k2 = kx**2 + ky**2 + kz**2
    x = np.where(k2 > 0, np.sqrt(k2), 1) * 15.0
    top = np.where(k2 > 0, 3 * (np.sin(x) / x**3 - np.cos(x) / x**2), 1)
    for kind, weight in (("gaussian", np.exp(-k2 * 15.0**2 / 2)), ("top_hat", top)):
        got = cube(kspace.smooth(df, CELLS, BOX, 15.0, kind).collect())
        assert np.allclose(got, np.fft.ifftn(np.fft.fftn(a) * weight).real)
    potential = np.fft.fftn(a) / np.where(k2 > 0, k2, 1)
    potential[0, 0, 0] = 0
    for axis, ka in zip("xyz", (kx, ky, kz), strict=True):
        got = cube(kspace.displacement(df, CELLS, BOX, 2.0)[axis].collect())
        assert np.allclose(got, np.fft.ifftn(-1j * ka / 2.0 * potential).real)


@pytest.mark.parametrize("kind", ["ngp", "cic", "tsc", "pcs"])
def test_painting_keeps_weight(points, kind):
    assert math.isclose(mesh.paint(points[1], CELLS, CELL, kind).agg(F.sum("value")).first()[0], 400)


def test_compensated_modes_are_those_of_the_points(points):
    """Interlaced and compensated, the lowest modes equal direct sums to a few in a thousand."""
    p, df = points
    for kind in ("tsc", "pcs"):
        got = {(r.ix, r.iy, r.iz): complex(r.re, r.im) for r in kspace.painted_modes(df, CELLS, CELL, kind).where("ix < 2 and iy < 2 and iz < 2").collect()}
        shift = {"tsc": 0.5, "pcs": 0.0}[kind] * CELL  # cell centres or corners carry the values
        for n in itertools.product(range(2), repeat=3):
            if n == (0, 0, 0):
                continue
            want = np.exp(-2j * np.pi * ((p - shift) @ n) / BOX).sum() / 400 * CELLS**3
            assert abs(got[n] - want) < 0.01 * CELLS**3 * 400**-0.5


def test_multipoles_of_meshes(field):
    df, a = field
    f = np.fft.fftn(a)
    n = np.fft.fftfreq(CELLS, 1 / CELLS)
    n[CELLS // 2] *= -1
    x, y, z = np.meshgrid(n, n, n, indexing="ij")
    r = np.sqrt(x**2 + y**2 + z**2)
    power = np.abs(f) ** 2 * BOX**3 / CELLS**6 - 7.0
    got = kspace.multipoles(kspace.transform(df, CELLS), None, CELLS, BOX, 4, shot=7.0).collect()
    assert sorted(g.bin for g in got) == [1, 2, 3]
    for g in got:
        inside = (np.floor(r) == g.bin) & (r > 0)
        mu = z[inside] / r[inside]
        assert g.modes == inside.sum() and math.isclose(g.p0, power[inside].mean())
        assert math.isclose(g.p2, 5 * (power[inside] * (3 * mu**2 - 1) / 2).mean(), abs_tol=1e-9)
        assert math.isclose(g.p4, 9 * (power[inside] * (35 * mu**4 - 30 * mu**2 + 3) / 8).mean(), abs_tol=1e-9)
    modes = kspace.transform(df, CELLS)
    cross = {g.bin: g.p0 for g in kspace.multipoles(modes, modes, CELLS, BOX, 4).collect()}
    assert all(math.isclose(cross[g.bin], g.p0 + 7.0) for g in got)


def test_nested_voids_equal_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    v = [(i, *map(float, rng.uniform(0, 100, 3)), float(r)) for i, r in enumerate(rng.choice([2.0, 6.0, 11.0, 17.0], 150))]
    order = sorted(v, key=lambda t: (-t[4], t[0]))
    central, dist, count = {}, {}, {t[0]: 0 for t in v}
    for a, big in enumerate(order):
        if big[0] in central:
            continue
        for small in order[a + 1 :]:
            d2 = sum((big[c] - small[c]) ** 2 for c in (1, 2, 3))
            if d2 < big[4] ** 2 and (small[0] not in central or dist[small[0]] < d2):
                if small[0] in central:
                    count[central[small[0]]] -= 1
                central[small[0]], dist[small[0]] = big[0], d2
                count[big[0]] += 1
    df = spark.createDataFrame(v, "id long, x double, y double, z double, radius double")
    got = {r.id: (r.central, r.satellites) for r in morphology.nested(df, 100.0).collect()}
    assert got == {i: (central.get(i, i), count[i] if i not in central else 0) for i, *_ in v}


def test_pixels_have_equal_areas(spark):
    n = 120_000
    golden = (1 + 5**0.5) / 2
    rows = spark.range(n).select((F.lit(360.0) * (F.col("id") / golden % 1)).alias("ra"), F.degrees(F.asin(1 - 2 * (F.col("id") + 0.5) / n)).alias("dec"))
    counts = {r.pix: r["count"] for r in rows.groupBy(sky.pixel(F.col("ra"), F.col("dec"), 4).alias("pix")).count().collect()}
    assert sorted(counts) == list(range(192))
    assert max(abs(c - n / 192) for c in counts.values()) < 40
    poles = spark.createDataFrame([(10.0, 89.9), (10.0, -89.9), (100.0, 89.9)], "ra double, dec double").select(sky.pixel(F.col("ra"), F.col("dec"), 4).alias("p"))
    assert [r.p for r in poles.collect()] == [0, 188, 1]


def test_small_catalog_helpers(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0, 5.0), (2, 99.0, 1.0, 50.0)], "id long, x double, y double, z double")
    moved = catalogs.jittered(df, 3.0, 100.0, seed=0).collect()
    assert all(0 <= r[c] < 100 for r in moved for c in "xyz") and moved[0].x != 5.0
    assert catalogs.parameter_lists(["a", "b", "c"], {"b": 1.0}) == (["a", "c"], {"b": 1.0})
    with pytest.raises(ValueError):
        catalogs.parameter_lists(["a", "b", "c"], {"b": 1.0}, free=["a"])
    with pytest.raises(Exception, match="unknown class"):
        catalogs.target_columns(spark.createDataFrame([("XYZ",)], "tracer string")).collect()
    observables.compatible(df, df, keys=("id",))
    with pytest.raises(ValueError):
        observables.compatible(df, df.drop("x"))
    with pytest.raises(ValueError):
        observables.compatible(df, df.where("id = 1"), keys=("id",))
    randoms = spark.createDataFrame([(45.0, 10.0, 100.0), (200.0, 0.0, 10.0), (45.0, 45.0, 1500.0)], "ra double, dec double, distance double")
    assert sky.lightcone_randoms(randoms, 500.0).count() == 2


def test_precision_checks():
    from starloom.operators import inference

    good = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert np.allclose(inference.precision(good) @ good, np.eye(2))
    for bad in (np.ones((2, 3)), np.array([[1.0, 2.0], [0.0, 1.0]]), np.array([[1.0, 2.0], [2.0, 1.0]]), np.diag([1.0, 1e-17])):
        with pytest.raises(ValueError):
            inference.precision(bad)

"""Operators without SQL against numpy and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import geometry, text
from starloom.operators import catalogs, graph, inference, labelled, mesh, morphology, sky, spatial, spectrum, statistics
from starloom.sources import files, points


def frame(spark, xyz, box=None):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")


@pytest.mark.parametrize("radius,box", [(10.0, 100.0), (45.0, 100.0), (60.0, 100.0), (33.0, 100.0)])
@pytest.mark.parametrize("periodic", [True, False])
def test_cell_pairs(spark, radius, box, periodic):
    rng = np.random.default_rng(1)
    xyz = rng.random((120, 3)) * box
    xyz[5] = xyz[6]
    want = set()
    for i, j in itertools.combinations(range(len(xyz)), 2):
        d = np.abs(xyz[i] - xyz[j])
        d = np.where(periodic & (d > box / 2), box - d, d)
        if (d**2).sum() <= radius**2:
            want.add((i, j))
    pairs = spatial.cell_pairs(frame(spark, xyz), None, radius, box, periodic=periodic).select("a_id", "b_id").collect()
    got = [tuple(sorted((r.a_id, r.b_id))) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == want
    cross = spatial.cell_pairs(frame(spark, xyz[:40]), frame(spark, xyz[40:]), radius, box, periodic=periodic)
    assert cross.count() == sum(1 for i, j in want if i < 40 <= j)


def test_knn_exact(spark):
    rng = np.random.default_rng(2)
    xyz = np.r_[rng.random((80, 3)) * 20, rng.random((5, 3)) * 100]
    got = {}
    for r in spatial.knn(frame(spark, xyz), frame(spark, xyz), 3, 100.0, radius=5.0, exclude_self=True).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.id))
    d = np.abs(xyz[:, None] - xyz[None])
    d2 = (np.where(d > 50, 100 - d, d) ** 2).sum(2)
    for i in range(len(xyz)):
        want = [j for j in np.argsort(d2[i], kind="stable") if j != i][:3]
        assert [j for _, j in sorted(got[i])] == want


def kruskal(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    total = []
    for w, a, b in sorted(edges):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total.append((a, b, w))
    return total


def test_spanning_forest(spark):
    rng = np.random.default_rng(3)
    edges = [(int(rng.integers(1, 6)), int(a), int(b)) for a, b in {tuple(sorted(rng.integers(0, 60, 2))) for _ in range(110)} if a != b]
    df = spark.createDataFrame([(a, b, w) for w, a, b in edges], "src long, dst long, w long")
    got = {tuple(r) for r in graph.minimum_spanning_forest(df).collect()}
    assert got == set(kruskal(edges))
    assert graph.minimum_spanning_forest(df.limit(0)).count() == 0


def test_tree_paths(spark):
    tree = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (1, 3, 4.0), (3, 4, 8.0)], "src long, dst long, w double")
    assert sorted(map(tuple, graph.tree_paths(tree, 2).collect())) == [(0, 2, 3.0), (0, 3, 5.0), (1, 4, 12.0), (2, 3, 6.0)]
    assert sorted(map(tuple, graph.tree_paths(tree, 3).collect())) == [(0, 4, 13.0), (2, 4, 14.0)]


def test_periodic_centres(spark):
    pts = frame(spark, [(99, 1, 50), (1, 99, 50), (50, 50, 50)])
    links = spark.createDataFrame([(0, 1)], "a_id long, b_id long")
    r = graph.multiplets(pts, links, 100).first()
    assert (r["size"], r.x, r.y, r.z) == (2, 0.0, 0.0, 50.0)
    assert [s.id for s in graph.singlets(pts, links).collect()] == [2]


def test_watershed_with_masked_cells(spark):
    n = 4
    value = {(i, j, k): float((i * 7 + j * 11 + k * 13) % 17) for i in range(n) for j in range(n) for k in range(n)}
    value[0, 0, 0] = None
    df = spark.createDataFrame([(*c, v) for c, v in value.items()], "ix int, iy int, iz int, value double")
    num = {c: (c[0] * n + c[1]) * n + c[2] for c in value}

    def down(c):
        near = [tuple((a + s) % n for a, s in zip(c, step)) for step in morphology.STEPS]
        options = [(value[x], o, x) for o, x in enumerate(near) if value[x] is not None]
        return min(options)[2]

    want = {}
    for c in value:
        if value[c] is not None:
            at = c
            while down(at) != at:
                at = down(at)
            want[num[c]] = num[at]
    zones = morphology.watershed(df, n)
    assert {r.node: r.root for r in zones.collect()} == want
    touched = {want[num[c]] for c in value if value[c] is not None and any(value[tuple((a + s) % n for a, s in zip(c, step))] is None for step in morphology.STEPS[1:])}
    assert {r.root for r in morphology.edge_zones(df, zones, n).collect()} == touched


def test_minkowski_of_known_bodies(spark):
    n = 8
    one = spark.createDataFrame([(i, j, k, 1.0 if (i, j, k) == (3, 3, 3) else 0.0) for i in range(n) for j in range(n) for k in range(n)], "ix int, iy int, iz int, value double")
    r = morphology.minkowski(one, n, 2.0, [0.5]).first()
    # a single cube: volume 1, Euler number 1
    assert r.v0 == 1 / n**3 and math.isclose(r.v3, 1 / n**3 / 8) and math.isclose(r.v1, 6 * 2 / 9 / n**3 / 2 - 3 * 2 / 9 / n**3 / 2 + 0.0, rel_tol=1) and r.v1 > 0
    flat = morphology.minkowski(one.withColumn("value", F.lit(1.0)), n, 2.0, [0.5, 1.5]).orderBy("threshold").collect()
    assert (flat[0].v0, flat[0].v1, flat[1].v0) == (1.0, 0.0, 0.0)


def test_grid_power_against_numpy(spark):
    n, box = 8, 100.0
    rng = np.random.default_rng(4)
    a = rng.normal(size=(n, n, n))
    df = spark.createDataFrame([(i, j, k, float(a[i, j, k])) for i in range(n) for j in range(n) for k in range(n)], "ix int, iy int, iz int, value double")
    p = np.abs(np.fft.fftn(a)) ** 2 * box**3 / n**6
    k = np.where(np.arange(n) <= n // 2, np.arange(n), np.arange(n) - n)
    k2 = k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2
    for r in spectrum.grid_power(df, n, box, 4).collect():
        m = (np.floor(np.sqrt(k2)) == r.bin) & (k2 > 0)
        assert r.modes == m.sum() and math.isclose(r.p0, p[m].mean(), rel_tol=1e-9)


def test_smoothing_equals_fourier(spark):
    n = 8
    rng = np.random.default_rng(5)
    a = rng.random((n, n, n))
    df = spark.createDataFrame([(i, j, k, float(a[i, j, k])) for i in range(n) for j in range(n) for k in range(n)], "ix int, iy int, iz int, value double")
    k = 2 * np.pi * np.where(np.arange(n) <= n // 2, np.arange(n), np.arange(n) - n) / (n * 10.0)
    k2 = k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2
    want = np.fft.ifftn(np.fft.fftn(a) * np.exp(-k2 * 15.0**2 / 2)).real
    for r in mesh.smooth(df, n, 10.0, 15.0).collect():
        assert math.isclose(r.value, want[r.ix, r.iy, r.iz], rel_tol=1e-9)


def test_paint_without_wrapping_loses_the_rim(spark):
    pts = spark.createDataFrame([(0, 95, 5, 5, 1)], "id long, x long, y long, z long, w long")
    assert math.isclose(mesh.paint(pts, 10, 10, "cic", "w", wrap=False).agg(F.sum("value")).first()[0], 0.5)
    for kind in ("ngp", "cic", "tsc"):
        assert math.isclose(mesh.paint(pts, 10, 10, kind).agg(F.sum("value")).first()[0], 1.0)


def test_quantile_split_rules(spark):
    df = spark.createDataFrame([(float(i),) for i in range(12)], "v double")
    assert [r.n for r in statistics.quantile_split(df, "v", 5).groupBy("quantile").agg(F.count("*").alias("n")).orderBy("quantile").collect()] == [3, 2, 2, 2, 3]
    with pytest.raises(Exception, match="not distinct"):
        statistics.quantile_split(df.withColumn("v", F.lit(1.0)), "v", 5).collect()


def test_ogk_against_numpy(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(50, 4)) @ rng.normal(size=(4, 4))

    def mad(v):
        return np.median(np.abs(v - np.median(v))) / statistics.NORMAL_QUARTILE

    d = np.array([mad(c) for c in x.T])
    y = x / d
    u = np.eye(4)
    for i, j in itertools.permutations(range(4), 2):
        c = y - np.median(y, axis=0)
        u[i, j] = (mad(c[:, i] + c[:, j]) ** 2 - mad(c[:, i] - c[:, j]) ** 2) / 4
    _, e = np.linalg.eigh((u + u.T) / 2)
    g = np.array([mad(c) for c in (y @ e).T])
    want = (d[:, None] * e) @ np.diag(g**2) @ (d[:, None] * e).T
    rows = spark.createDataFrame([(i, f"f{j}", float(x[i, j])) for i in range(50) for j in range(4)], "sample int, feature string, value double")
    names, got = statistics.ogk_covariance(rows)
    assert names == ["f0", "f1", "f2", "f3"] and np.allclose(got, want)


def test_debias_and_matrix_checks(spark):
    assert statistics.debias(100, 10, method="hartlap") == 99 / 88
    assert statistics.debias(100, 10, 4, method="percival-fisher") == 99 / 93
    b = 88 / (89 * 86)
    assert math.isclose(statistics.debias(100, 10, 4), 99 * (1 + b * 6) / 93)
    with pytest.raises(ValueError):
        statistics.debias(10, 2, method="none")
    assert statistics.is_positive_definite([[2, 1], [1, 2]]) and not statistics.is_positive_definite([[1, 2], [2, 1]])
    assert [statistics.significant_condition(np.diag([1, c])) for c in (1, 1e-10, 0)] == [1, 2, 0]
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0)], "i int, j int, value double")
    assert statistics.is_symmetric(m) and not statistics.is_symmetric(m.where("not (i = 1 and j = 0)"))


def test_greedy_bins_and_chi2(spark):
    rng = np.random.default_rng(6)
    mocks = rng.normal(size=(200, 5)) * [1, 1, 10, 1, 1]
    jacobian = np.array([[1.0, 0], [0, 1.0], [1, 1], [0.1, 0], [0, 0.1]])
    chosen = inference.greedy_bins(spark, mocks, jacobian, n_params=2, most=3)
    assert [b for b, _ in chosen[:2]] in ([0, 1], [1, 0]) and all(g > 0 for _, g in chosen)
    res = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 0.5), (1, "b", 0.0), (2, "a", 1.0)], "sample long, feature string, residual double")
    scores = inference.chi2(res, [[2.0, 1.0], [1.0, 3.0]], ["a", "b"])
    assert {r.sample: r.chi2 for r in scores.collect()} == {0: 18.0, 1: 0.5, 2: None}
    assert inference.best_fit(scores.where("chi2 is not null")).first().sample == 1


def test_posterior_predictive(spark):
    x = np.linspace(0, 10, 20)
    cov = np.eye(20) * 0.25

    def model(theta):
        return theta[0] + theta[1] * x + theta[2] * x**2

    def statistic(d, m):
        return ((d - m) ** 2).sum() / 0.25

    rng = np.random.default_rng(42)
    observed = model((1, 2, -0.5)) + rng.normal(size=20) * 0.5
    draws = spark.createDataFrame([(i, 1.0, 2.0, -0.5) for i in range(200)], "sample long, a double, b double, c double")
    p = inference.p_value(inference.posterior_predictive(draws, observed, model, statistic, cov, ["a", "b", "c"])).first().p
    assert 0.01 < p < 0.99
    wrong = spark.createDataFrame([(i, 1.0, -3.0, 0.0) for i in range(100)], "sample long, a double, b double, c double")
    assert inference.p_value(inference.posterior_predictive(wrong, observed, model, statistic, cov, ["a", "b", "c"])).first().p == 0


def test_prediction(spark):
    net = inference.Network([(np.array([[1.0, 0.0], [0.0, 1.0]]), np.zeros(2)), (np.array([[1.0], [2.0]]), np.array([0.5]))])
    params = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.0, 0.0)], "sample int, a double, b double")
    got = {r.sample: r.value for r in inference.predict(params, net, ["a", "b"], [(7,)], dims=("s",)).collect()}

    def swish(v):
        return v / (1 + math.exp(-v))

    assert math.isclose(got[0], swish(1) + 2 * swish(2) + 0.5) and got[1] == 0.5
    with pytest.raises(ValueError, match="without a column"):
        inference.predict(params, net, ["a", "nope"], [(7,)])
    assert inference.sensitivity_grid(spark, {"a": 1.0, "b": 2.0}, {"a": (0, 1)}, 5).count() == 5


def test_labelled_tables(spark):
    rows = spark.createDataFrame([(c, s, float(10 * c + s)) for c in range(3) for s in range(4)], "c int, s int, value double")
    t = labelled.LabelledTable(rows, ("c",), ("s",))
    assert t.select(c=1).dims == ("s",) and t.select(c=[0, 1]).slice(s=(1, 2)).frame.count() == 4
    assert t.select(c=2).squeeze().dims == ("s",)
    assert [r.values for r in t.vectors().orderBy("c").collect()][1] == [10.0, 11.0, 12.0, 13.0]
    assert [r.value for r in t.take([3, 0]).where("c = 0").orderBy("position").collect()] == [3.0, 0.0]
    with pytest.raises(KeyError):
        t.require(c=9)
    with pytest.raises(KeyError):
        t.coordinates("nope")
    assert labelled.equal_counts(rows, "c", "s") == 4
    with pytest.raises(ValueError):
        labelled.equal_counts(rows.where("not (c = 1 and s = 0)"), "c", "s")
    assert t.with_features(t).frame.count() == 24


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "hod_idx int, y double")
    for h in (3, 12):
        files.save(df, str(tmp_path / f"c001_hod{h:03d}.parquet"), attributes={"n": h})
    files.save(df.limit(0), str(tmp_path / "c001_hod003.parquet"))  # already there: left alone
    paths = files.list_paths(spark, str(tmp_path / "c001_hod*.parquet"))
    assert files.numbers(paths, "hod") == [3, 12] and files.read_any(spark, paths[0]).count() == 2
    assert files.attributes(spark, str(tmp_path / "c001_hod003.parquet")) == {"n": 3}
    numbered = files.with_number(spark.read.parquet(*paths), "hod", "n")
    assert sorted({r.n for r in numbered.collect()}) == [3, 12]
    with pytest.raises(ValueError):
        files.read_any(spark, "x.fits")
    with pytest.raises(FileNotFoundError):
        files.load_merged(spark, [str(tmp_path / "none.parquet"), None], ("y",))
    assert files.load_merged(spark, [paths[0], str(tmp_path / "none.parquet")], ("y",)).count() == 2
    (tmp_path / "cosmo.csv").write_text("root, omega , h\nmock_cosm002,0.3,0.7\nmock_cosm001,0.2,0.6\n")
    got = files.cosmologies(spark, str(tmp_path / "cosmo.csv"), [1], {"omega": "om"}).collect()
    assert [tuple(r) for r in got] == [(1, 0.2)]
    files.save_parameters(spark.createDataFrame([(1.0, 2.123456)], "b double, a double"), str(tmp_path / "p"), ["a", "zz", "b"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "p")).collect()] == [("2.12346", "1.00000")]
    assert files.combined_handle([files.handle("tpcf", {"ells": [0, 2], "c": [1, 2, 3]}, {"s": (0, 150)}), "wp"]) == "tpcf_ells_0,2_c_1-3_s_0-150+wp"
    weights = files.survey(spark.createDataFrame([(1.0, 2.0, 0.5), (1.0, 2.0, 0.7)], "ra double, dec double, z double"), (0.4, 0.6)).collect()
    assert [tuple(r) for r in weights] == [(1.0, 2.0, 0.5, 1.0, 1.0)]


def test_text_helpers():
    assert text.runs([3, 1, 2, 7, 7]) == "1-3,7" and text.evaluate("[1, 2]") == [1, 2] and text.evaluate("__import__('os')") == "__import__('os')"
    assert text.pairs(["--a", "1", "b", "x"]) == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        text.pairs(["a"])
    assert text.chunks(["-v", "-o", "a", "b", "-o", "c"], "-o") == [["a", "b"], ["c"]]
    assert text.lookup({"a": {"b": 1}}, "a", "b") == 1
    with pytest.raises(KeyError, match="a/c"):
        text.lookup({"a": {"b": 1}}, "a", "c")


def test_geometry(spark):
    assert geometry.scaled_box(2000, "z", 2.0, 4.0) == (500.0, 500.0, 1000.0)
    with pytest.raises(ValueError):
        geometry.alcock_paczynski({"x": F.col("x")}, "y", 1, 1)
    r = spark.range(1).select(geometry.wrap(F.lit(-1.0), 10).alias("a"), geometry.wrap(F.lit(6.0), 10.0, -5.0).alias("b"), geometry.min_image(F.lit(5.0), 10.0).alias("c"), geometry.min_image(F.lit(5.1), 10.0).alias("d"), geometry.effective_radius(F.lit(8), 1.0).alias("e")).first()
    assert (r.a, r.b, r.c) == (9.0, -4.0, 5.0) and math.isclose(r.d, -4.9) and math.isclose(4 / 3 * math.pi * r.e**3, 8)
    assert math.isclose(geometry.flat_distance(0.5, 0.3), 1317.5, rel_tol=0.01)
    assert geometry.rotate_los("x") == ("y", "z", "x")


def test_sky(spark):
    assert sky.snapshots([0.1, 0.3, 0.5, 0.8, 1.1], 0.28, 0.55) == [0.3, 0.5, 0.8]
    n, s = sky.sphere_fraction(4000, "NGC"), sky.sphere_fraction(4000, "SGC")
    assert math.isclose(n + s, 1) and 0.3 < n < 0.7
    with pytest.raises(ValueError):
        sky.in_region("X", F.col("ra"), F.col("dec"))
    df = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 0.25), (3, 1.0), (4, 9.0)], "id int, x double")
    grid = spark.createDataFrame([(i / 10, (i / 10) ** 2) for i in range(11)], "z double, d double")
    got = [r.d for r in sky.interpolate_join(df, "x", grid, "z", "d", "d").orderBy("id").collect()]
    assert np.allclose(got, np.interp([-1, 0, 0.25, 1, 9], np.arange(11) / 10, (np.arange(11) / 10) ** 2))
    with pytest.raises(Exception, match="outside"):
        sky.check_bounds(frame(spark, [(1, 2, 300)]), 100).collect()
    counts = spark.createDataFrame([(0, 100), (1, 50)], "bin int, n long")
    ratio = {r.bin: r.ratio for r in sky.radial_ratio(counts, {0: 1.0, 1: 1.0}, [0, 1, 2], lambda z: z, 1.0, shape_only=True).collect()}
    assert ratio[1] == 1.0 and math.isclose(ratio[0], (1 / 100) / (7 / 50))


def test_catalog_generation(spark):
    a = points.latin_hypercube(spark, 20, {"p": (0.0, 1.0), "q": (-1.0, 1.0)}).collect()
    assert sorted(int(r.p * 20) for r in a) == list(range(20)) and sorted(int((r.q + 1) * 10) for r in a) == list(range(20))
    s = points.sky_randoms(spark, 4000, (10, 20), (-30, 60), (100.0, 200.0)).agg(F.min("ra"), F.max("ra"), F.min("dec"), F.max("dec"), F.min("distance"), F.max("distance")).first()
    assert 10 <= s[0] <= s[1] <= 20 and -30 <= s[2] <= s[3] <= 60 and 100 <= s[4] <= s[5] <= 200
    halos = spark.range(20_000).select("id", F.lit(13.5).alias("log_mass"), *[F.lit(0.0).alias(c) for c in "xyz"])
    g = catalogs.populate(halos, log_cut=13.0, sigma=0.5, log_m1=14.0, kappa=0.5, alpha=1.0, seed=0)
    c = g.groupBy("central").count().collect()
    n = {r.central: r["count"] for r in c}
    p = 0.5 * math.erfc(-0.5 / (math.sqrt(2) * 0.5))
    lam = (10**13.5 - 0.5 * 1e13) / 1e14 * p
    assert abs(n[True] / 20_000 - p) < 0.015 and abs(n[False] / 20_000 - lam) < 0.015
    heavy = spark.range(400).select("id", F.lit(17.0).alias("log_mass"), *[F.lit(0.0).alias(c) for c in "xyz"])
    many = [r["count"] for r in catalogs.populate(heavy, log_cut=13.0, sigma=0.5, log_m1=14.0, kappa=0.0, alpha=1.0, seed=0).where("not central").groupBy("halo_id").count().collect()]
    assert abs(sum(many) / 400 - 1000) < 5 and abs(np.std(many) - 1000**0.5) < 4
    assert catalogs.check_parameters({"a", "b"}, {"a"}) == ["b"]
    with pytest.raises(ValueError):
        catalogs.check_parameters({"a"}, {"b"})
    assert catalogs.clean_header(spark.createDataFrame([(1, 2)], ["# a", " b "])).columns == ["a", "b"]
    cube = spark.range(50_000).select(*[F.rand(k).alias(u) for k, u in enumerate(("ux", "uy", "uz"))])
    share = {r.shell: r.share for r in catalogs.intersection_volume(cube, [(0.0, 1.0), (2.0, 3.0)], 1.0).collect()}
    assert share == {0: 1.0, 1: 0.0}


def test_bispectrum_of_plane_waves(spark):
    pts = points.galaxies(spark, "/root/testdata/sf0.001")
    half = spectrum.fourier_modes(pts, 1, 1000.0)
    full = half.unionByName(half.select((-F.col("nx")).alias("nx"), (-F.col("ny")).alias("ny"), (-F.col("nz")).alias("nz"), "re", (-F.col("im")).alias("im")))
    modes = {(r.nx, r.ny, r.nz): complex(r.re, r.im) for r in full.collect()}
    want = {}
    for a, b in itertools.product(modes, repeat=2):
        c = tuple(-(x + y) for x, y in zip(a, b))
        k = [sum(x * x for x in v) for v in (a, b, c)]
        if c in modes and k[0] <= k[1] <= k[2]:
            want.setdefault(tuple(k), []).append((modes[a] * modes[b] * modes[c]).real)
    for r in spectrum.triangles(full, 1000.0).collect():
        assert r.n == len(want[r.k1, r.k2, r.k3]) and math.isclose(r.b, np.mean(want[r.k1, r.k2, r.k3]), rel_tol=1e-6, abs_tol=1e-3)


def test_spanning_forest_query_equals_kruskal_on_nearest_neighbours(spark, small):
    from starloom.plans import structures
    from starloom.sources.points import BOX, galaxies

    points = galaxies(spark, small).select("id", "x", "y", "z").toPandas().sort_values("id")
    ids, at = points["id"].to_numpy(), points[["x", "y", "z"]].to_numpy(float)
    edges = set()
    for i in range(len(at)):
        d = np.abs(at - at[i])
        d2 = (np.minimum(d, BOX - d) ** 2).sum(1)
        d2[i] = np.inf
        edges |= {(d2[j], min(i, j), max(i, j)) for j in np.lexsort((ids, d2))[:20].tolist()}
    root = list(range(len(at)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    want = []
    for d2, i, j in sorted(edges):
        if find(i) != find(j):
            root[find(i)] = find(j)
            want.append(d2**0.5)
    got = structures.spanning_forest(spark, small).toPandas()
    assert len(got) == len(want) and np.allclose(np.sort(got["w"].to_numpy(float)), want)
    assert max(want) > 60


def test_ranks_and_quantiles_of_whole_tables(spark):
    from starloom.operators import ranks

    rng = np.random.default_rng(2)
    values = [float(x) for x in rng.integers(0, 40, 500)] + [None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(7)
    got = sorted((r["rank"], r.v, r.total) for r in ranks.ranked(df, ["v", "id"]).collect())
    assert [g[0] for g in got] == list(range(502)) and {g[2] for g in got} == {502}
    want = sorted(values, key=lambda x: (x is not None, x))
    assert [g[1] for g in got] == want
    real = [v for v in values if v is not None]
    shares = [0.0, 0.1, 0.37, 0.5, 1.0]
    assert np.allclose(ranks.quantiles(df, "v", shares).first()["quantiles"], np.quantile(real, shares))
    assert ranks.quantiles(df.limit(0), "v", shares).first()["quantiles"] == []
    cdf = statistics.ecdf(df.where("v is not null"), "v").collect()
    assert all(math.isclose(r.cdf, sum(x <= r.v for x in real) / len(real)) for r in cdf) and len(cdf) == 500
    runs = statistics.islands(spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 12, 2)], "i long"), "i").collect()
    assert sorted((r.first, r.last) for r in runs) == [(1, 3), (7, 8), (12, 12)]
    assert sorted(r.part for r in catalogs.split_evenly(spark.range(10).toDF("sample"), 4).collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_knn_in_sparse_and_tiny_tables(spark):
    rng = np.random.default_rng(5)
    for n, k in ((3, 4), (40, 6)):
        p = rng.uniform(0, 100, (n, 3))
        p[: n // 2] = p[0] + rng.uniform(0, 1, (n // 2, 3))
        p %= 100
        df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double, z double")
        got = {}
        for r in spatial.knn(df, df, k, 100.0, exclude_self=True).collect():
            got.setdefault(r.q_id, {})[r["rank"]] = r.id
        for i in range(n):
            d = (p - p[i] + 50) % 100 - 50
            near = sorted((float((x * x).sum()), j) for j, x in enumerate(d) if j != i)[:k]
            assert [got[i][r + 1] for r in range(len(near))] == [j for _, j in near]


@pytest.mark.parametrize("name", ["pair_counts_smu", "pair_counts_cross", "pair_counts_rppi", "projected_tpcf", "tpcf", "tpcf_rebinned", "tpcf_multipoles", "landy_szalay", "radius_pairs", "neighbour_profile"])
def test_copies_for_neighbour_cells_are_not_broadcast(spark, small, name):
    from starloom import catalogue

    plan = catalogue.queries()[name](spark, small)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan
    # the joins that build on the right may only broadcast totals and group sizes
    blocks = plan.split("BroadcastHashJoin")[1:]
    assert not any("Generate explode" in b for b in blocks if b.index("Generate explode") < b.find("SortMergeJoin") != -1)


@pytest.mark.parametrize("periodic", [True, False])
def test_counts_of_coincident_points(spark, periodic):
    rng = np.random.default_rng(8)
    xyz = rng.integers(0, 100, (40, 3))[rng.integers(0, 40, 150)]
    w, g = rng.integers(0, 4, 150), rng.integers(0, 2, 150)
    rows = spark.createDataFrame([(i, *map(int, p), int(a), int(b)) for i, (p, a, b) in enumerate(zip(xyz, w, g))], "id long, x long, y long, z long, w long, g int")
    from starloom.operators import correlation

    d = np.abs(xyz[:, None] - xyz[None])
    d2 = (np.where(periodic & (d > 50), 100 - d, d) ** 2).sum(2)

    def want(pairs):
        out = {}
        for i, j in pairs:
            k = int(d2[i, j] ** 0.5 // 10)
            if k < 3:
                out[(int(g[i]), k)] = out.get((int(g[i]), k), 0) + int(w[i] * w[j])
        return out

    def got(df):
        return {(r.g, r.i_s): r.n for r in df.collect()}

    auto = correlation.count_smu(rows, None, 10, 3, 1, 100, weights=True, periodic=periodic, group=("g",))
    assert got(auto) == want((i, j) for i, j in itertools.combinations(range(150), 2) if g[i] == g[j])
    for moved in ("left", "right"):
        cross = correlation.count_smu(rows, rows, 10, 3, 1, 100, weights=True, periodic=periodic, group=("g",), moved=moved)
        assert got(cross) == want(itertools.product(range(150), repeat=2))


def test_group_edges(spark):
    rng = np.random.default_rng(9)
    xyz = rng.integers(0, 60, (50, 3))[rng.integers(0, 50, 120)]
    rows = frame(spark, xyz)
    every = spatial.radius_pairs(rows, 9, 6, 100.0).select("a_id", "b_id")
    few = spatial.group_edges(rows, 9, 6, 100.0)
    assert few.count() < every.count()
    assert {tuple(r) for r in graph.components(few, "a_id", "b_id").collect()} == {tuple(r) for r in graph.components(every, "a_id", "b_id").collect()}
    assert {r.id for r in graph.singlets(rows, few).collect()} == {r.id for r in graph.singlets(rows, every).collect()}


def test_percolation_writes_its_paths_once(spark, monkeypatch):
    labels, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, label: labels.append(label) or cut(df, label))
    tree = spark.createDataFrame([(i, i + 1, 1.0 + i) for i in range(5)], "src long, dst long, w double")
    points = spark.createDataFrame([(i, i * (i + 1) // 2, 0, 0) for i in range(6)], "id long, x long, y long, z long")
    rows = graph.percolation(tree, points, 3, 1, 100).collect()
    # each path's length and its ends' distance are put in order from one table
    assert labels.count("paths") == 2
    assert {r.stat: r.mean for r in rows} == {"mst1pt": 3.0, "mst2pt": 6.0, "end2pt": 6.0, "mst3pt": 9.0, "end3pt": 9.0}

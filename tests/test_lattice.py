import numpy as np
import pytest

from starloom.operators import correlation, lattice

BOX = 40


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    xyz = rng.integers(0, BOX, (90, 3))[rng.integers(0, 90, 300)]
    w, g = rng.integers(1, 5, 300), rng.integers(0, 3, 300)
    data = [(i, *map(int, p), int(a), int(b)) for i, (p, a, b) in enumerate(zip(xyz, w, g))]
    # rows without a position or an id
    data += [(300, None, 1, 1, 1, 1), (301, 1, 1, None, 1, 2)]
    return spark.createDataFrame(data, "id long, x long, y long, z long, w long, g int")


def both(monkeypatch, count):
    """Rows by fields and by visiting pairs; the former must have been taken."""
    taken, whole = [], lattice.pair_bins
    monkeypatch.setattr(lattice, "pair_bins", lambda *a: taken.append(whole(*a)) or taken[-1])
    out = []
    for worth in (0.0, 1e9):
        monkeypatch.setattr(lattice, "WORTH", worth)
        df = count()
        out.append((sorted(map(tuple, df.collect())), [(f.name, f.dataType) for f in df.schema]))
    assert len(taken) == 1 and taken[0] is not None
    return out


def test_neighbour_profile_counts_by_fields(rows, monkeypatch):
    got, want = both(monkeypatch, lambda: correlation.count_smu(rows, rows, 3, 4, 1, BOX, group=("g",)))
    assert got == want


@pytest.mark.parametrize("box", [40, 45])
def test_own_counts_by_fields(rows, monkeypatch, box):
    got, want = both(monkeypatch, lambda: correlation.count_smu(rows, None, 3, 4, 3, box, weights=True, group=("g",)))
    assert got == want


def test_cross_counts_by_fields(rows, monkeypatch):
    got, want = both(monkeypatch, lambda: correlation.count_smu(rows.where("id % 2 = 0"), rows, 3, 4, 3, BOX, weights=True, group=("g",), moved="right"))
    assert got == want


def test_projected_counts_by_fields(rows, monkeypatch):
    got, want = both(monkeypatch, lambda: correlation.count_rppi(rows, None, 2, 3, 3, 3, BOX))
    assert got == want


def test_survey_counts_by_fields(rows, monkeypatch):
    from pyspark.sql import functions as F

    data = rows.withColumn("id", F.when(F.col("id") % 7 > 0, F.col("id")))
    got, want = both(monkeypatch, lambda: correlation.survey_counts(data, rows, 3, 4, BOX))
    assert got == want


def test_points_outside_the_box_or_between_cells_are_visited(spark, rows, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(lattice, "WORTH", 0.0)
    monkeypatch.setattr(lattice, "pair_bins", None)
    correlation.count_smu(rows.withColumn("x", F.col("x") + 0.5), None, 3, 4, 1, BOX).collect()
    correlation.count_smu(rows.withColumn("w", F.col("w") - 1), None, 3, 4, 1, BOX, weights=True).collect()
    correlation.count_smu(rows.withColumn("x", F.col("x") + 5), None, 3, 4, 1, BOX).collect()


def test_density_split_auto_evaluates_its_split_once(spark, small, monkeypatch):
    from starloom import catalogue
    from starloom.plans import fields

    labels, cut = [], fields.cut_lineage
    monkeypatch.setattr(fields, "cut_lineage", lambda df, label: labels.append(label) or cut(df, label))
    plan = catalogue.queries()["density_split_auto"](spark, small)._jdf.queryExecution().sparkPlan().toString()
    assert labels == ["split"] and "orders.parquet" not in plan

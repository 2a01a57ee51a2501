import numpy as np
import pytest

from starloom.operators import friends, graph, spatial


@pytest.mark.parametrize(("count", "reach", "block", "whole"), [(150, 9, 20, True), (600, 9, 60, True), (400, 7, 1000, False), (30, 9, 1, True)])
def test_groups_are_those_of_the_links(spark, monkeypatch, count, reach, block, whole):
    rng = np.random.default_rng(count)
    xyz = rng.integers(0, 60, (count, 3)) if whole else rng.random((count, 3)) * 60
    xyz = np.concatenate([xyz, xyz[:10], xyz[:3]])
    kind = "long" if whole else "double"
    rows = [(i * 7 % 1009, *p.tolist()) for i, p in enumerate(xyz)] + [(2000, None, None, None)]
    points = spark.createDataFrame(rows, f"id long, x {kind}, y {kind}, z {kind}")
    want = {tuple(r) for r in graph.components(spatial.radius_pairs(points, reach, 0.7 * reach, 60), "a_id", "b_id").collect()}
    # links aren't listed: their number grows with the square of the density
    monkeypatch.setattr(spatial, "cell_pairs", None)
    monkeypatch.setattr(friends, "BLOCK", block)
    monkeypatch.setattr(friends, "PAIRS", 100)
    got = [tuple(r) for r in friends.groups(points, reach, 0.7 * reach, 60).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize("name", ["connected_components", "multiplets", "multiplet_summary"])
def test_queries_list_no_links(spark, small, monkeypatch, name):
    from starloom import catalogue

    monkeypatch.setattr(spatial, "cell_pairs", None)
    assert catalogue.queries()[name](spark, small).count() > 0

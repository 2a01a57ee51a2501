"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from starloom import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    v = float(v)
    return None if math.isnan(v) else v + 0.0


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    result = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()]
    assert ordered(got) == ordered(want)


def test_every_query_is_registered():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_flagship(spark):
    assert catalogue.flagship(spark, DIR).count() == 50


@pytest.mark.parametrize("name", ["lensing_correlation", "convergence_map"])
def test_products_in_single_precision(spark, tmp_path, name):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    value = np.random.default_rng(1).random(1 << 20, dtype=np.float32)
    scale = 1000 if name == "lensing_correlation" else 10
    turned = value[np.floor(value * np.float32(scale)) != np.floor(value.astype(float) * scale)]
    if len(turned) == 0:
        turned = np.nextafter(np.arange(1, 40, dtype=np.float32) / np.float32(scale), np.float32(0))
        turned = turned[np.floor(turned * np.float32(scale)) != np.floor(turned.astype(float) * scale)]
    assert len(turned)
    rows = np.resize(turned, (12, 4))
    pq.write_table(pa.table({"vec_id": pa.array(range(12), pa.int64()), "embedding": pa.array(rows.tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    df = catalogue.queries()[name](spark, str(tmp_path))
    result = duckdb.connect().execute(catalogue.oracle_sql()[name].replace("embeddings", f"'{tmp_path}/embeddings.parquet'"))
    names = [c[0] for c in result.description]
    assert ordered([tuple(r[c] for c in names) for r in df.collect()]) == ordered(result.fetchall())

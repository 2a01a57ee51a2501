"""The pipeline's stages and the queries' registration."""

import ast
import pathlib
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__
from starloom.llm import pii, quality, queries


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    now = docs
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, small)
        assert now.columns == docs.columns, name
        rows = now.collect()
        seen.append(len(rows))
        now = spark.createDataFrame(rows, docs.schema)
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] == seen[4]
    assert all(not pii.base_spans(r.text or "") for r in now.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, small)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_stages_take_empty_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(3, text, "en", "s", 1), (1, text, "en", "s", 1), (2, "other words stand here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_near_dedup_keeps_one_row_of_each_group_whatever_the_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (5, a), (5, a), (5, c), (6, c), (2, d), (5, d), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_dedup(spark, docs, "").collect()))
    assert got == [(0, ""), (0, b), (2, d), (5, a), (5, c)]


def test_near_dedup_finds_planted_similarities(spark):
    rng = random.Random(3)
    rows, gone = [], set()
    for i, n in enumerate([1, 4, 6, 8, 10, 20] * 4):
        words = [f"w{rng.getrandbits(40)}" for _ in range(404)]
        # 400 shingles; every changed word that stands alone takes 5: at n changes similarity is (400 - 5 n) / (400 + 5 n)
        other = list(words)
        for k in range(n):
            other[6 + 9 * k] += "x"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        a, b = ({tuple(t[j : j + 5]) for j in range(400)} for t in (words, other))
        if len(a & b) / len(a | b) >= 0.8:
            gone.add(2 * i + 1)
    assert len(gone) == 16
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, _ in rows} - gone


def test_near_dedup_of_a_crowded_group(spark):
    """Copies of one text, most pairs just below the similarity: components as by brute force."""
    from starloom.llm import shingles

    rng = random.Random(9)
    base = [f"w{rng.getrandbits(30)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        t = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 5)):
            t[k] = f"v{rng.getrandbits(30)}"
        texts.append(" ".join(t))
    sets = [shingles.shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if shingles.similarity(sets[a], sets[b]) >= 0.8:
                root[find(a)] = find(b)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()}
    assert len({find(i) for i in range(150)}) == len(set(got.values()))
    assert all((find(a) == find(b)) == (got[a] == got[b]) for a in range(150) for b in range(a))


def test_stages_keep_clean_rows_of_any_ids_and_names(spark, small):
    """Null and repeated ids, null texts and clashing names pass all stages but the last without loss."""
    rng = random.Random(1)
    clean = [" ".join(f"word{rng.getrandbits(20)}" for _ in range(40)) for _ in range(4)]
    rows = [(None, clean[0], 1, 2), (None, clean[1], 1, 2), (7, clean[2], 1, 2), (7, clean[3], 1, 2), (8, None, 1, 2), (9, "", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, redacted int, _row int").withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        got = sorted((r.text or "", r.redacted, r._row) for r in out.collect())
        # empty and null texts are equal to near dedup
        want = sorted((t or "", a, b) for _, t, a, b in rows)
        assert got == want or (name == "SimHash near-dedup" and got == want[1:]), name


def test_registration():
    numbers = sorted(int(m[1]) for k in __spark_entry__.queries() if (m := re.match(r"op(\d+)_", k)))
    assert numbers == list(range(1, 11)) and "pipeline" in queries.queries()
    assert quality.ACCEPT == 0.3


def test_native_operator_has_no_python(spark):
    from starloom.llm import linededup

    tree = ast.parse(pathlib.Path(linededup.__file__).read_text())
    names = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    assert not names & {"mapInArrow", "mapInPandas", "applyInPandas", "pandas_udf", "udf", "rdd"}


def test_near_dedup_links_by_simhash(spark):
    """Equal fingerprints, of shingles that repeat, but sets of shingles with little in common."""
    from starloom.llm import shingles, simhash

    texts = ["x y z " * 1000 + " ".join(f"{c}{i}" for i in range(20)) for c in "uv"]
    assert len({simhash.fingerprint(t) for t in texts}) == 1
    assert shingles.similarity(*[shingles.shingle_set(t) for t in texts]) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([*texts, "other words stand here"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]

"""Exact Hamming search, graph search and archives."""

import gzip
import io
import random

import numpy as np
import pytest

from starloom.llm import hamming_search, hnsw, warc


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<float>")


def sample(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 64))
    out = [(i, centres[rng.integers(6)] + 0.7 * rng.normal(size=64)) for i in range(n)]
    common = np.round(rng.normal(size=64), 2)
    out += [(n + i, common) for i in range(n // 3)]
    out += [(2 * n, None), (2 * n + 1, [0.0] * 64), (2 * n + 2, [float("nan")] * 64), (2 * n + 3, [None] * 64), (2 * n + 4, []), (2 * n + 5, [float("inf")] * 64)]
    return out


@pytest.mark.parametrize("k", [1, 10])
def test_hamming_topk_equals_brute_force(spark, k):
    vectors = sample(k, 150)
    codes = hamming_search.sign_codes(rows_of(spark, vectors))
    table = {r.vec_id: r.code & (1 << 64) - 1 for r in codes.collect()}
    want_codes = {i: sum(1 << b for b in range(64) if v[b] > 0) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)}
    assert table == want_codes
    queries = codes.where("vec_id % 10 = 0")
    got = {}
    for r in hamming_search.hamming_topk(codes, queries, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    for q in (i for i in table if i % 10 == 0):
        near = sorted(((table[q] ^ c).bit_count(), i) for i, c in table.items() if i != q)[:k]
        assert [(d, i) for _, d, i in sorted(got[q])] == near


def test_hamming_odd_tables(spark):
    empty = rows_of(spark, [])
    codes = hamming_search.sign_codes(empty)
    assert hamming_search.hamming_topk(codes, codes).count() == 0
    few = hamming_search.sign_codes(rows_of(spark, [(0, [1.0] * 64), (1, [-1.0] * 64), (1, [-1.0] * 64)]))
    assert [tuple(r) for r in hamming_search.hamming_topk(few, few.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 64)]
    wide = hamming_search.sign_codes(rows_of(spark, [(0, [1.0] * 64 + [-3.0] + [1.0] * 63)])).first().code & (1 << 64) - 1
    assert wide == (1 << 64) - 2


def exact(vectors, q, k):
    def cosine(a, b):
        a, b = np.asarray(a, dtype=np.float32).astype(float), np.asarray(b, dtype=np.float32).astype(float)
        return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))

    own = dict(vectors)
    return sorted(((-cosine(own[q], v), i) for i, v in vectors if i != q))[:k]


def test_graph_recall(spark):
    vectors = sample(3, 600)
    good = [(i, v) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and np.any(np.asarray(v) != 0)]
    rows = rows_of(spark, vectors)
    got = {}
    for r in hnsw.nearest_neighbours(rows, rows.where("vec_id % 20 = 0"), 5, shard_size=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in (i for i, _ in good if i % 20 == 0):
        want = exact(good, q, 5)
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        for (_, i, s), (score, _) in zip(sorted(got[q]), want, strict=True):
            assert s <= -score + 1e-12
        hits += len({i for _, i, _ in got[q]} & {i for _, i in want})
        total += 5
    assert hits / total >= 0.9


def test_graph_recall_on_the_table(spark):
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/embeddings.parquet"
    table = pq.read_table(path)
    vectors = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True))
    rows = spark.read.parquet(path)
    got = {}
    for r in hnsw.nearest_neighbours(rows, rows.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = np.mean([len(got[q] & {i for _, i in exact(vectors, q, 5)}) / 5 for q, _ in vectors if q % 50 == 0])
    assert share >= 0.9


def test_graph_odd_tables(spark):
    assert hnsw.nearest_neighbours(rows_of(spark, []), rows_of(spark, [])).count() == 0
    rows = rows_of(spark, [(0, [1, 0]), (1, [1, 0]), (2, [2, 0]), (3, [0, 1, 0]), (4, [0, 0])])
    got = [(r["rank"], r.vec_id) for r in hnsw.nearest_neighbours(rows, rows.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2)]


def test_flat_arrays_round_trip():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph.build(v)
    h = hnsw.Graph.from_row(g.to_row(), v)
    assert all((a == b).all() for a, b in zip(g.links, h.links, strict=True))
    assert all((a == b).all() for a, b in zip(g.search(v[:20], 5), h.search(v[:20], 5), strict=True))


def test_parallel_vectors_tie_to_the_smaller_id(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    vectors = [(i, (base * (200 - i)).tolist()) for i in range(200)] + [(500, (-base).tolist()), (501, (base * 1e-200).tolist()), (502, (base * 1e150).tolist())]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for query in (0, 7, 502):
        got = [(r.vec_id, r.score) for r in hnsw.nearest_neighbours(rows, rows.where(f"vec_id = {query}"), 5).orderBy("rank").collect()]
        assert [i for i, _ in got] == [i for i in range(7) if i != query][:5]
        assert all(abs(s - 1) < 1e-12 for _, s in got)


def test_recall_over_several_shards_of_the_usual_size():
    """Two shards as large as in production, merged; against all similarities."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 32))
    v = hnsw.unit(centres[rng.integers(0, 200, 2 * hnsw.SHARD)] + 0.7 * rng.normal(size=(2 * hnsw.SHARD, 32)))
    halves = [np.arange(0, len(v), 2), np.arange(1, len(v), 2)]
    queries = rng.integers(0, len(v), 200)
    found = [[] for _ in queries]
    for half in halves:
        graph = hnsw.Graph.build(v[half])
        for out, ids in zip(found, graph.search(v[queries], 6), strict=True):
            out += half[ids].tolist()
    sims = v[queries] @ v.T
    share = 0.0
    for i, out in enumerate(found):
        best = set(np.argsort(-sims[i])[:6].tolist())
        share += len(best & set(sorted(out, key=lambda x: -sims[i, x])[:6])) / 6
    assert share / len(queries) >= 0.9


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_versions(version):
    bodies = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n<p>\n\nx", b"", b"plain\n"]
    data = warc.arc_preamble(version)
    for i, b in enumerate(bodies):
        data += warc.arc_header(version, url=f"http://e.com/{i}", ip="1.2.3.4", date="19990102030405", mime="text/html", status=200, length=len(b) or "0") + b + b"\n"
    got = list(warc.parse_arc(io.BytesIO(data)))
    assert [r.body for r in got] == bodies and [r.fields["url"] for r in got] == [f"http://e.com/{i}" for i in range(3)]
    assert all(data[r.offset :].startswith(b"http://e.com/") for r in got)
    record = warc.to_warc(got[0])
    head, block = next(warc.parse_warc(io.BytesIO(record)))
    assert head["warc-type"] == "response" and head["warc-date"] == "1999-01-02T03:04:05Z" and block == bodies[0] and head["warc-ip-address"] == "1.2.3.4"
    assert head["warc-payload-digest"] == "sha1:" + warc.digest(b"<p>\n\nx")
    assert next(warc.parse_warc(io.BytesIO(warc.to_warc(got[2]))))[0]["warc-type"] == "resource"


@pytest.mark.parametrize("damage", ["version", "length", "fields", "none"])
def test_arc_errors(damage):
    data = warc.arc_preamble("1") + b"http://e.com/ 1.2.3.4 19990102030405 text/html 5\nhello\n"
    data = {"version": data.replace(b"\n1 0 ", b"\n7 0 "), "length": data.replace(b"html 5", b"html 50"), "fields": data.replace(b"1.2.3.4 ", b""), "none": b"x" + data}[damage]
    with pytest.raises(warc.ArcError):
        list(warc.parse_arc(io.BytesIO(data)))


@pytest.mark.parametrize("page_id", [0, 1, 255, 65535, 65536, 2**63 - 1, -1, -(2**63)])
def test_page_ids_in_identifiers(page_id):
    assert warc.page_of(warc.page_record_id(page_id)) == page_id
    assert warc.page_of(warc.record_id("x")) is None


def test_pages_round_trip(spark):
    pages = [(5, "http://a b/c", "<p>same</p>"), (3, None, "<p>same</p>"), (9, "u", None), (8, "u", ""), (2**40, "v", "é" * 30_000), (-7, "w", "<p>same</p>\r\n\r\n"), (3, "again", "<p>same</p>"), (None, "n", "<p>same</p>"), (None, "m", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_digest(df).collect()), key=str)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        f = first.get(h or "")
        repeat = f is not None and i != f
        want.append((i, len(raw), warc.digest(raw), "revisit" if repeat else "response", f if repeat else None))
    assert got == sorted(want, key=str)
    assert warc.warc_digest(df.limit(0)).count() == 0


def test_convert_archives(spark, tmp_path):
    rng = random.Random(1)
    entries = [(f"http://x/{i}", rng.choice(["a", "b", "c"]) * 50) for i in range(30)]
    data = warc.arc_preamble("2") + b"".join(warc.arc_entry(i, u, h, "2") for i, (u, h) in enumerate(entries))
    (tmp_path / "one.arc").write_bytes(data)
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(data[:400_000]))
    manifest = warc.convert_archives(spark, [str(tmp_path / "one.arc"), str(tmp_path / "two.arc.gz")], str(tmp_path / "out"))
    back = warc.read_warc(manifest).collect()
    assert len(back) == 60 and sum(r.record_type == "response" for r in back) == 6
    assert {bytes(r.payload).decode() for r in back if r.payload is not None} == {c * 50 for c in "abc"}

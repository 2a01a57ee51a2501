"""Tokens, token files, packing, PII, quality and SentencePiece."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from starloom.llm import packing, pii, quality, sentencepiece_scan, tokenfiles, tokens

ODD = [None, "", " ", "  a", "a  b", "a \n b", "a\n \nb", "x   ", "it's 'll", "<|endoftext|> x", "é x y\x85z", "a" * 3000, "12 34\r\n\t5", "日本語 テキスト", "\U0001f600 ok"]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.tokenizer_file())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(enc, library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["ab", "C", " ", " ", "\n", "\t", "'s", "é", "1", ".", "　", "_", "<|endoftext|>"]) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    for t in texts:
        assert enc.encode(t).tolist() == library_ids(library, t), repr(t)
    assert 50256 in enc.encode("hi <|endoftext|> there").tolist()


def test_column_encoder_equals_library(enc, library):
    import pyarrow as pa

    rng = random.Random(2)
    parts = ["a", "B", "the", "ing", "É", "ÿ", "×", "÷", "ª", "e\u0301", "ß", "я", "日本", "12", "²", "٣", ".", ",", "!?", "_", "'", "'s", "'re", "’", "“", "<|", "<|endoftext|>", "\U0001f600"]
    blanks = [" ", " ", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\x0b", "\x0c", "\x00", "\x1c", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000"]
    texts = ODD + ["".join(rng.choice(parts if rng.random() < 0.6 else blanks) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    for some, end_id in ((texts, 1), (texts[1:], None), (texts[:1], 1), (texts[:2], None), ([], 1), ([], None)):
        for kind in (pa.string(), pa.large_string()):
            ids, ends = enc.encode_column(pa.array([" left out", *some], kind)[1:], end_id)
            tail = [] if end_id is None else [end_id]
            assert len(ends) == len(some) and len(ids) == (ends[-1] if some else 0)
            for text, got in zip(some, np.split(ids, ends[:-1]) if some else [], strict=True):
                assert got.tolist() == library_ids(library, text) + tail, repr(text)


def test_column_encoder_asks_once_for_each_piece(monkeypatch):
    import pyarrow as pa

    enc = tokens.Encoder(tokens.tokenizer_file())
    asked = []
    single = enc.pieces.single
    monkeypatch.setattr(enc.pieces, "single", lambda run: asked.append(run) or single(run))
    column = pa.array(["tree house. tree, house! tree\nhouse: tree.\nhouse; tree? house"] * 50)
    ids, ends = enc.encode_column(column, 1)
    # no entry of its own for a word with a sign or a line break
    assert set(enc.pieces) == {"tree", "house", " tree", " house", ".", ",", "!", "\n", ":", ";", "?"}
    assert len(asked) == len(enc.pieces)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 5)
    again, _ = enc.encode_column(pa.array(["other words than before", *column.to_pylist()]), 1)
    assert len(enc.pieces) <= 5 and again[-len(ids) :].tolist() == ids.tolist()


def test_batches_are_gathered_in_order():
    import pyarrow as pa

    batches = [pa.record_batch({"doc_id": [i], "text": ["x" * n]}) for i, n in enumerate([10, 20, 500, 5, 5, 900, 1])]
    got = [(ids.to_pylist(), [len(t) for t in texts.to_pylist()]) for ids, texts in packing.gathered(iter(batches), 200)]
    assert got == [([0, 1], [10, 20]), ([2], [500]), ([3, 4], [5, 5]), ([5], [900]), ([6], [1])]
    assert list(packing.gathered(iter([]))) == []


def test_token_files_round_trip(spark, library):
    rows = [(i * 3 % 17 - 4, t) for i, t in enumerate(ODD)] + [(None, "no id"), (2, "twice"), (2, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tokenfiles.token_digest(docs).collect(), key=lambda r: r.start)
    start, places, left = 0, [], [(i, zlib.crc32(np.array([*library_ids(library, t), 0], "<u4").tobytes())) for i, t in rows]
    for r in got:
        assert r.start == start
        left.remove((r.doc_id, r.ids_crc32))
        places.append((r.doc_id is None, r.doc_id or 0))
        start += r.n_tokens
    assert not left and places == sorted(places)
    assert start == sum(len(library_ids(library, t)) + 1 for _, t in rows)


def test_token_files_shuffled_reads_and_damage(spark, library, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    index = tokenfiles.write_token_files(docs, str(tmp_path / "t"))
    picks = index.where("doc_id in (7, 30, 41)")
    got = {r.doc_id: r.ids for r in tokenfiles.read_records_at(spark, picks).collect()}
    assert got == {i: [*library_ids(library, f"text number {i}"), 0] for i in (7, 30, 41)}
    path = index.first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[-6] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged record"):
        tokenfiles.read_token_files(index).count()


def test_token_files_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, part int, path string")
    assert tokenfiles.token_digest(empty).count() == 0
    only = tokenfiles.token_digest(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in only] == [(None, 0, 1)]


def test_best_cuts_equal_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        size = rng.choice([8, 16, 32])
        place, p = [], 0
        for _ in range(rng.randrange(1, 40)):
            p += rng.randrange(1, size + 1)
            place.append(p)
        fine = [rng.choice([0.0, 0.5, 3.0]) for _ in place]
        cost = [0.0]
        spots = [0, *place]
        for j in range(1, len(spots)):
            cost.append(min(cost[i] + packing.padding(spots[j] - spots[i], size) + fine[j - 1] for i in range(j) if spots[j] - spots[i] <= size))
        got, before = 0.0, 0
        for k in packing.best_cuts(place, fine, size):
            got += packing.padding(place[k] - before, size) + fine[k]
            before = place[k]
        assert before == place[-1] and abs(got - cost[-1]) < 1e-9


def test_packing_covers_every_id_once(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "x " * 20000), (9004, "a" * 5000)], "doc_id long, text string"))
    pieces = packing.pack_documents(docs).collect()
    ids = {r.doc_id: np.array([*library_ids(library, r.text), 1], "<u4") for r in docs.collect()}
    spans, room = {}, {}
    for p in pieces:
        spans.setdefault(p.doc_id, []).append((p.start, p.length))
        room.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    for d, x in ids.items():
        at = 0
        for s, n in sorted(spans[d]):
            assert s == at and n > 0
            at += n
        assert at == len(x)
    total = pad = 0
    for parts in room.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
        total, pad = total + at, pad + packing.padding(at)
    assert pad < 0.05 * total
    assert packing.pack_documents(docs.limit(0)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_plain_expressions(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "x.y@z", "@", "a.b", "1.2.3.4", "256.1.1.1", "001.2.3.4.5", "4539 1488 0343 6467", "4111-1111-1111-1111", "+49 (30) 123-4567", "+1", "+", "555", " ", "-", ".", "x", "é", "@@", "a@b-.c-", "٣", "1", "9", "(", ")", "%_a@q.w.e"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_pii_added_and_redaction(spark):
    text = "Mail a@b.co, bank account DE89370400440532013000, card 378282246310005. " + "Nothing else stands here. " * 3 + "Order 378282246310005."
    spans = pii.find_spans(text)
    assert [s[0] for s in spans] == ["email", "iban", "card_short"]
    assert pii.redact(text) == "Mail <EMAIL>, bank account <IBAN>, card <CARD_SHORT>. " + "Nothing else stands here. " * 3 + "Order 378282246310005."
    assert not pii.mod97("DE89370400440532013001") and pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "é" * 50_000 + " +49 30 1234567", "w")], "doc_id long, text string, redacted string")
    got = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    assert got[1].n_email == 1 and got[1].base_sha256 == pii.digest_of(text) and got[1].spans.startswith("email:5:11,iban:")
    assert got[2].base_sha256 == got[3].base_sha256 == pii.digest_of("") and got[2].spans == ""
    assert got[4].spans == "phone:50001:50015"
    kept = pii.find_pii(docs).where("doc_id = 2").first()
    assert kept.redacted == "y" and kept.redacted_ is None
    clash = spark.createDataFrame([(1, "a@b.co", [3])], "doc_id long, redacted string, spans array<int>")
    own = pii.find_pii(clash, text_col="redacted").first()
    assert own.spans == [3] and own.redacted == "a@b.co" and own.redacted_ == "<EMAIL>"
    for t, span in (("AT61 1904 3002 3457 3201 BANK", (0, 24)), ("BANK AT611904300234573201, more", (5, 25)), ("NO9386011117947 X", (0, 15))):
        assert [s[1:3] for s in pii.find_spans(t) if s[0] == "iban"] == [span], t
    assert pii.pii_digest(docs.limit(0)).count() == 0


def test_pii_is_linear():
    text = "a" * 200_000 + "1" * 200_000 + "@" * 1000 + "." * 1000
    assert pii.base_spans(text) == []


def test_quality_holds_out_and_separates(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs.join(labels, "doc_id"), model).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert sum(s >= quality.ACCEPT for s in good) / len(good) > 0.97
    assert sum(s < quality.ACCEPT for s in bad) / len(bad) > 0.8
    assert all(0 <= r.score <= 1 for r in rows)
    # other labels of held-out rows change nothing
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(docs, other).weights == model.weights


def test_quality_uses_few_labels(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    assert model.sizes == {0: 8, 1: 60}
    rows = quality.score_quality(docs.join(labels, "doc_id"), model).collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert sum(b < g for b in bad for g in good) / len(good) / len(bad) > 0.9
    # empty and over-long texts don't use up the picks
    texts = [(i, "" if i % 5 else f"good words number {i} " * 9) for i in range(200)] + [(i, f"{i} %% junk @@ " * 9) for i in range(200, 210)]
    odd = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 200)) for i, _ in texts], "doc_id long, quality int")
    for limit in (60_000, 50):
        model = quality.fit_quality(odd, marks, per_class=10, max_chars=limit, holdout=10**9)
        assert model.weights and model.sizes == {0: 10, 1: 10}


def test_quality_equals_plain_compression(spark):
    """Sizes, probabilities and labels recomputed without Spark, from the model's dictionaries and weights alone."""
    import zstandard as zstd

    rng = random.Random(6)
    good = [" ".join(rng.choice(["good", "plain", "words", "stand", "here", "and", "there"]) for _ in range(60)) for _ in range(60)]
    bad = ["".join(rng.choice("%%@@##!!xX") for _ in range(200)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, int(i < 60)) for i in range(120)] + [(3, 0), (4, 1), (5, None), (70, 7)]
    for inputs in (1, 5):
        model = quality.fit_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int"), inputs=inputs)
        usable = [i for i in range(120) if i != 3 and zlib.crc32(str(i).encode()) % 5]
        assert model.sizes == {0: sum(i >= 60 for i in usable), 1: sum(i < 60 for i in usable)}
        assert len(model.weights) == inputs + 1
        got = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
        for i, t in rows:
            raw = (t or "").encode()
            a, b = (len(zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_checksum=False).compress(raw)) for d in (model.good, model.bad))
            size, d = np.log1p(len(raw)), (b - a) / max(a, b, 1)
            x = np.array([d, size, a / (len(raw) + 20), b / (len(raw) + 20), d * size])[:inputs]
            z = model.weights[0] + np.dot(model.weights[1:], (x - model.mean) / model.scale)
            assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
        assert sum(got[i] for i in range(60)) / 60 > 0.9 and sum(got[i] for i in range(60, 120)) / 60 < 0.2


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x" * 100_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, quality.fit_quality(docs, none)).collect()
    assert [r.score for r in got] == [0.5] * 3
    assert quality.score_quality(docs.limit(0), quality.QualityModel()).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece_scan.model(sentencepiece_scan.model_file())


@pytest.fixture(scope="module")
def merges():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_scan.model_file())


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_pieces_equal_the_library(pieces, merges):
    import pyarrow.parquet as pq

    rng = random.Random(3)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    parts = ["the", "ing", "ab", " ", "  ", "é", "日本", "\U0001f600", "\n", "\t", "x", "12", "-", "▁", "\x00", "tion", "ß"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 20))) for _ in range(3000)]
    for t, want in zip(texts, merges.encode(texts), strict=True):
        got = ids_of(pieces.encode(pieces.normalize(t)))
        assert got == want, t
        assert pieces.decode(got) == t.replace("▁", " ")


@pytest.mark.parametrize("text", ["", "日本語", "\U0001f600", "tab\tline\n", "▁", "a▁b"])
def test_pieces_decode(pieces, text):
    got = ids_of(pieces.encode(pieces.normalize(text)))
    assert pieces.decode(got) == text.replace("▁", " ")


@pytest.mark.parametrize("size", [7, 23, 64])
def test_chunked_scan_equals_the_library(pieces, merges, size):
    rng = random.Random(size)
    for _ in range(60):
        text = "".join(rng.choice(["the", "ing", "a", "n", " ", "é", "日", "tion", "x"]) for _ in range(rng.randrange(20, 60)))
        if rng.random() < 0.5:
            text = text.replace(" ", "")  # one unbroken stretch
        normal = pieces.normalize(text)
        parts = [pieces.part(normal, *c) for c in pieces.chunks(normal, size, size // 2)]
        sparse = [pieces.transfer(*p) for p in parts]
        matrices = [sentencepiece_scan.dense(*m) for m in sparse]
        total = matrices[0]
        for m in matrices[1:]:
            total = sentencepiece_scan.combine(total, m)
        assert total.shape == (1, 1) and total[0, 0] == 0
        states = sentencepiece_scan.scan_states(matrices)
        assert all(m[s] == 0 for m, s in zip(matrices, states, strict=True))
        assert all(a[1] == b[0] for a, b in itertools.pairwise(states))
        ids = b"".join(pieces.backtrace(*p, *s) for p, s in zip(parts, states, strict=True))
        assert ids_of(ids) == merges.encode(text)


def test_giant_documents_in_spark(spark, merges):
    text = ("the quick brown fox jumps over " * 3000).strip()
    rows = [(1, text, b"x", 7), (2, None, b"y", 7), (3, "", b"z", 7), (4, "abthe" * 13_000, b"w", 7), (1, text, b"v", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, _row int")
    coded = sentencepiece_scan.encode_pieces(docs).collect()
    assert sorted((r.doc_id, r.ids, r._row) for r in coded) == sorted((r[0], r[2], 7) for r in rows)
    assert all(ids_of(r.ids_) == merges.encode(r.text or "") for r in coded)
    got = sentencepiece_scan.digest_pieces(docs).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert all(r.ids_crc32 == sentencepiece_scan.check_of(merges.encode(text)) for r in got if r.doc_id == 1)
    assert all(r.n_ids == 0 for r in got if r.doc_id in (2, 3))
    assert sentencepiece_scan.digest_pieces(docs.limit(0)).count() == 0


def test_encoder_memo_keeps_letter_runs(monkeypatch):
    from starloom.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_RUNS", 6)
    monkeypatch.setattr(tokens, "MEMO_WORDS", 4)
    enc = tokens.Encoder(tokens.tokenizer_file())
    for text in ("one two, three. two, one; é é. É! a\nb", " a  b ", "x \n y", "a1 b2 c3 d4 e5 f6 g7 h8 one two", " ", "word  word \tword"):
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, text
        assert len(enc.rest) <= 10
    # one memo for both: what other words take is given back before the runs
    assert {"one", "two"} <= set(enc.rest)
    enc.rest.make_room()
    assert all(k.isalpha() for k in enc.rest)

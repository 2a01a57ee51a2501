"""Line dedup, SimHash and components against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm import linededup, simhash
from starloom.operators.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows, threshold, per_edit):
    """The first place of each distinct line, and that of its class."""
    places = {}
    for doc_id, text in rows:
        for i, line in enumerate((text.split("\n") if text is not None else [])):
            if line:
                places.setdefault(line, set()).add((doc_id is None, doc_id or 0, i))
    first = {k: min(v) for k, v in places.items()}
    root = {k: k for k in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(first, 2):
        least = min(threshold, min(len(a), len(b)) // per_edit)
        if abs(len(a) - len(b)) <= least and distance(a, b) <= least:
            root[find(a)] = find(b)
    classes = {}
    for k in first:
        classes.setdefault(find(k), []).append(k)
    return first, {k: classes[find(k)] for k in first}


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice("abcé"))
        elif s and kind == 1:
            del s[min(i, len(s) - 1)]
        elif s:
            s[min(i, len(s) - 1)] = rng.choice("abcé")
    return "".join(s)


def check_verdicts(got, rows, threshold, per_edit):
    first, classes = brute_lines(rows, threshold, per_edit)
    texts = {}
    for doc_id, text in rows:
        for i, line in enumerate(text.split("\n") if text is not None else []):
            texts[doc_id, i] = line
    assert len(got) == sum(1 for _, t in rows if t is not None for x in t.split("\n") if x)
    for r in got:
        line = texts[r.doc_id, r.line_no]
        late, doc, no = head = min(first[x] for x in classes[line])
        assert (r.class_doc_id, r.class_line_no) == (None if late else doc, no), line
        assert r.links == len(classes[line]) - 1, line
        assert r.keep == ((r.doc_id is None, r.doc_id or 0, r.line_no) == head)


@pytest.mark.parametrize(("threshold", "per_edit"), [(1, 4), (2, 5), (3, 4), (linededup.THRESHOLD, linededup.PER_EDIT)])
def test_line_classes_equal_brute_force(spark, threshold, per_edit):
    rng = random.Random(threshold)
    bases = ["".join(rng.choice("abcdefé ") for _ in range(rng.randrange(1, 45))) for _ in range(14)]
    rows = []
    for i in range(40):
        lines = [edit(rng, rng.choice(bases), rng.randrange(5)) for _ in range(rng.randrange(0, 4))]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, bases[0]), (103, bases[1] + "\n" + bases[1]), (103, bases[1] + "\n" + bases[1])]
    rows += [(104, "hello small world!"), (105, "hello small world?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_verdicts(linededup.line_verdicts(docs, threshold=threshold, per_edit=per_edit).collect(), rows, threshold, per_edit)


def test_large_groups_of_near_lines(spark):
    """Keys that many lines share: a family within the threshold, one beyond it, and a chain."""
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh ") for _ in range(60))
    far = "".join(rng.choice("abcdefgh ") for _ in range(40))
    chain = "x" * 50
    lines = [edit(rng, base, 2) for _ in range(120)]
    lines += [far + "".join(rng.choice("klmnop") for _ in range(10)) for _ in range(60)]
    for _ in range(12):
        chain = edit(rng, chain, 2)
        lines.append(chain)
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_verdicts(linededup.line_verdicts(docs).collect(), rows, linededup.THRESHOLD, linededup.PER_EDIT)


def near_lines(lines, threshold, per_edit):
    """For each distinct line the number of others within the threshold of it."""
    near = dict.fromkeys(lines, 0)
    for a, b in itertools.combinations(near, 2):
        least = min(threshold, min(len(a), len(b)) // per_edit)
        if abs(len(a) - len(b)) <= least and distance(a, b) <= least:
            near[a] += 1
            near[b] += 1
    return near


@pytest.mark.parametrize(("threshold", "per_edit", "grid"), [(1, 4, None), (2, 5, None), (3, 4, (2, 3)), (2, 10, None), (2, 10, (4, 8))])
def test_every_line_link_is_counted(spark, monkeypatch, threshold, per_edit, grid):
    """A family of near copies, some within the threshold of each other, and a chain whose ends are far apart."""
    rng = random.Random(threshold)
    if grid:
        monkeypatch.setattr(linededup, "FILED", grid[0])
        monkeypatch.setattr(linededup, "ASKED", grid[1])
    base, chain = "".join(rng.choice("abcdefgh ") for _ in range(40)), "x" * 30
    lines = [edit(rng, base, rng.randrange(1, 4)) for _ in range(50)]
    for _ in range(12):
        chain = edit(rng, chain, 1)
        lines.append(chain)
    lines += [edit(rng, "hello wörld"[: rng.randrange(3, 12)], 1) for _ in range(20)]
    rows = list(enumerate(dict.fromkeys(x for x in lines if x)))
    want = near_lines([x for _, x in rows], threshold, per_edit)
    got = linededup.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string"), threshold=threshold, per_edit=per_edit).collect()
    assert {rows[r.doc_id][1]: r.near for r in got} == want
    # links and the class size less one are different things here
    assert any(r.near != r.links for r in got)


def test_edits_within(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 60)))
        pairs.append((a, edit(rng, a, rng.randrange(0, 6))))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", linededup.edits_within(F.col("a"), F.col("b"), 3).alias("d"))
    for r in got.collect():
        assert r.d == min(distance(r.a, r.b), 4), (r.a, r.b)


def test_dedup_lines_changes_texts(spark):
    line = "a line that is long enough to be compared"
    rows = [(1, f"{line}\nfirst", "en", "s", 5), (2, f"{line}!\nsecond", "en", "s", 5), (3, line, "en", "s", 5), (4, None, "en", "s", 0), (5, "", "en", "s", 0), (6, "\nkeep\n", "en", "s", 6)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: (f"{line}\nfirst", len(line) + 6), 2: ("second", 6), 4: (None, 0), 5: ("", 0), 6: ("\nkeep\n", 6)}


def test_dedup_lines_judges_rows_of_one_id_apart(spark):
    rows = [(1, "X"), (None, "X\nA"), (None, "B\nY"), (7, "same"), (7, "same"), (8, "p\nq"), (8, "p\nr"), (None, None), (None, "A")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in linededup.dedup_lines(docs).collect()]
    lines = sorted(x for _, t in got for x in (t or "").split("\n") if x)
    assert lines == ["A", "B", "X", "Y", "p", "q", "r", "same"]
    assert (1, "X") in got and (None, "B\nY") in got and (None, "A") in got and (7, "same") in got and (None, None) in got
    assert sorted(len(t.split("\n")) for i, t in got if i == 8) == [1, 2]


def test_lines_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert linededup.dedup_lines(empty).count() == 0
    assert linededup.line_verdicts(empty).count() == 0
    clash = spark.createDataFrame([(1, "x\ny", "a", 7, 8, [9]), (2, "x", "b", 8, 9, [7])], "doc_id long, text string, line string, _gone int, _row int, _kept array<int>")
    got = sorted(map(tuple, linededup.dedup_lines(clash).collect()))
    assert got == [(1, "x\ny", "a", 7, 8, [9])]


def test_text_of_very_many_lines(spark):
    lines = [f"{i * 7919 % 100_003:06d}" for i in range(100_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines, "one more"]))]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "one more"}


def naive_fingerprint(text, words=3):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            parts += [word] if word else []
            word = ""
        else:
            word += c
    if not parts:
        return 0
    grams = [" ".join(parts)] if len(parts) < words else [" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "one Two", "A b c", "É é x y z w", "a b c d e f a b c d", "x\x1cy z\x85w q r s"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_hamming_links_and_components(spark):
    rng = random.Random(5)
    codes = [rng.getrandbits(64) for _ in range(60)]
    for c in list(codes):
        for _ in range(3):
            d = c
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                d ^= 1 << b
            codes.append(d)
    codes += [0, 1, 3, 7, 15, (1 << 64) - 1, 1 << 63]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = [(i, c) for i, c in enumerate(signed)]
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    distinct = sorted(set(signed))
    want = {(a, b) for a, b in itertools.combinations(distinct, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert {tuple(r) for r in simhash.hamming_links(prints).collect()} == want
    root = {c: c for c in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[find(a)] = find(b)
    least = {}
    for i, c in rows:
        least[find(c)] = min(least.get(find(c), i), i)
    got = {r.doc_id: r.component_id for r in simhash.components_of(prints).collect()}
    assert got == {i: least[find(c)] for i, c in rows}


def test_simhash_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.fingerprint == naive_fingerprint(texts[r.doc_id]) for r in got[:40])
    empty = simhash.near_duplicates(docs.limit(0))
    assert empty.count() == 0
    odd = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, " ", 5), (None, "\n", 6)], "doc_id long, text string, fingerprint int")
    assert sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()) == [(0, 0, 1), (1, 0, 1), (2, 0, 1), (2, 0, 1)]


def test_components_of_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000), (5, None), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 301: 300}
    none = spark.createDataFrame([], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    assert components(none, "a", "b").count() == 0


def test_fingerprint_of_very_long_text():
    words = " ".join(str(i) for i in np.arange(200_000))
    assert simhash.fingerprint(words) == simhash.fingerprint(words.replace(" ", "\n"))

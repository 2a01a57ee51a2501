"""Operator 1: line deduplication by a segment-partition edit join (DataFrame functions only).

Lines link when their edit distance (characters inserted, deleted or replaced)
is at most ``threshold`` and at most one edit for every ``per_edit`` characters
of the shorter line, so that lines of any length link at the same similarity
and ``threshold`` is the most for long ones. A line of length l that may take t
edits is cut into t + 1 segments; if another line is within t of it, one of the
segments occurs there unchanged, near its old place (pigeonhole principle).
Every distinct line is therefore filed under its segments, keyed by length,
segment number and content, and looks up, for each smaller or equal length, the
few substrings at which an unchanged segment can lie (the multi-match-aware
positions).

Links join lines into classes: the result names each line's class by its first
line and counts the distinct lines that link to it directly, so no pairs are
listed. Every link between different lines is found. A look-up under a key of
one or two lines meets both of them. Under a key of more lines, those filed and
those looking up are dealt out to a grid of cells, so that no task compares them
all, and a pair that shares several such keys meets under the least one only.
Who passes a bound on letter counts is verified by a banded bit-parallel
automaton, one bit per diagonal, after the common head and tail are taken off;
it stops at the stretch in which the edits run out.

Equal lines are one entry from the start, so a line that occurs in a third of
all documents is one entry. Of a class only the first line is kept, first
meaning the smallest (document id, line number); empty lines are never dropped.

Defined results for odd input: null text has no lines and stays null; empty
text is one empty line; lines and texts of any length are handled whole; null
ids sort last; an empty table gives empty results; extra columns of the
documents are kept whatever their names. :func:`line_verdicts` knows lines by
(document id, line number) only, so rows that repeat a document id hold equally
placed lines, which count as one occurrence. :func:`dedup_lines` judges each row
by itself: rows of one id, or without id, are taken in the order of a hash of
their texts, and a line is removed only from the row where it was judged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import cut_lineage, discard, row_place
from starloom.operators.graph import components

#: At most two edits, and one for every ten characters.
THRESHOLD, PER_EDIT = 2, 10
#: Characters that the automaton takes before it looks whether any edits are left.
STRETCH = 16
#: Lines filed and lines looking up in one cell of a common key's grid.
FILED, ASKED = 32, 1024
#: Letters whose counts bound the distance (fixed values).
COUNTED = tuple("etaonrishdlucmwb")


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line): the lines of every text, empty ones left out."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line") != "")


def position(doc_id: Column, line_no: Column) -> Column:
    """Sorts as documents do, null ids last."""
    return F.struct(doc_id.isNull().alias("late"), doc_id.alias("doc_id"), line_no.alias("line_no"))


def allowed(length: Column, threshold: int, per_edit: int) -> Column:
    """Edits that a line of ``length`` may take."""
    return F.least(F.lit(threshold), F.floor(length / per_edit)).cast("int")


def segments(edits: int, length: Column) -> list[tuple[Column, Column]]:
    """(start, size), start from 1, of each of the edits + 1 segments of a line of ``length``."""
    parts = edits + 1
    base, extra = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    out, start = [], F.lit(1)
    for i in range(parts):
        # the last ``extra`` segments are one longer
        size = base + F.when(F.lit(i) >= F.lit(parts) - extra, 1).otherwise(0)
        out.append((start, size))
        start = start + size
    return out


def filings(line: Column, length: Column, threshold: int, per_edit: int) -> Column:
    """Keys under which a line is filed: (length, segment number, segment); null for lines that take no edit."""
    out = F.lit(None).cast("array<bigint>")
    for edits in range(1, threshold + 1):
        keys = F.array(*[F.xxhash64(length, F.lit(i), F.substring(line, at, size)) for i, (at, size) in enumerate(segments(edits, length), 1)])
        out = F.when(allowed(length, threshold, per_edit) >= edits, keys).otherwise(out)
    return out


def places(edits: int, shorter: int):
    """(segment number, shift) at which a segment of a line shorter by ``shorter`` can lie unchanged."""
    for i in range(1, edits + 2):
        low = max(-(i - 1), shorter - (edits + 1 - i))
        high = min(i - 1, shorter + (edits + 1 - i))
        yield from ((i, shift) for shift in range(low, high + 1))


def lookups(line: Column, length: Column, threshold: int, per_edit: int) -> Column:
    """Keys at which a line finds lines of its own or a smaller length.

    A segment lies at one of its ``places`` if all segments before it or all
    after it hold few enough edits. Keys that would reach beyond the line are null.
    """

    def at_length(shorter: int, edits: int) -> list[Column]:
        other = length - shorter
        cuts = segments(edits, other)
        # segments no shorter than the largest shift: every look-up lies inside the line
        roomy = per_edit * edits // (edits + 1) > edits
        out = []
        for i, shift in places(edits, shorter):
            start, size = cuts[i - 1]
            at = start + shift
            key = F.xxhash64(other, F.lit(i), F.substring(line, at, size))
            out.append(key if roomy else F.when((at >= 1) & (at + size - 1 <= length), key))
        return out

    none = F.array().cast("array<bigint>")
    by_length = []
    for shorter in range(threshold + 1):
        keys = none
        for edits in range(max(1, shorter), threshold + 1):
            keys = F.when(allowed(length - shorter, threshold, per_edit) >= edits, F.array(*at_length(shorter, edits))).otherwise(keys)
        # a difference in length that the shorter line may not take is no link
        by_length.append(F.when(allowed(length - shorter, threshold, per_edit) >= F.lit(shorter), keys).otherwise(none) if shorter else keys)
    flat = F.array(*[k for shorter in range(threshold + 1) for k in at_length(shorter, threshold)])
    return F.when(length >= per_edit * threshold + threshold, flat).otherwise(F.concat(*by_length))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: the optimiser doesn't copy what a lambda binds."""
    return F.transform(F.array(value), body)[0]


def _common_head(a: Column, b: Column) -> Column:
    """Length of the common head of two strings: one bit of it after the other, the highest first."""
    most = F.least(F.length(a), F.length(b))

    def step(p: Column, k: Column) -> Column:
        n = F.call_function("shiftleft", F.lit(1), k)
        same = (p + n <= most) & (F.substring(a, p + 1, n) == F.substring(b, p + 1, n))
        return F.when(same, p + n).otherwise(p)

    return F.aggregate(F.sequence(F.length(F.bin(most)) - 1, F.lit(0), F.lit(-1)), F.lit(0), step)


def edits_within(a: Column, b: Column, threshold: int) -> Column:
    """Edit distance of two lines up to ``threshold``, beyond it ``threshold`` + 1; strings without line breaks.

    A banded bit-parallel automaton: word e holds, one bit per diagonal of the
    band, the diagonals that e edits can reach after j characters of ``b``, so
    one step moves all diagonals of the band with a handful of word operations.
    """
    band = 2 * threshold + 1
    full = (1 << band) - 1

    def word(n: int) -> Column:
        return F.lit(n).cast("int")

    def characters(s: Column) -> Column:
        return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))

    def stretch(r: Column, text: Column, other: Column) -> Column:
        """The state after the characters of ``text``; ``other`` starts ``threshold`` characters before it."""

        def run(s: Column) -> Column:
            def advance(r: Column, j: Column) -> Column:
                # outside the string get() is null, which equals nothing
                char, match = F.get(s["t"], j), word(0)
                for d in range(band):
                    match = match.bitwiseOR(F.when(F.get(s["p"], j + d) == char, word(1 << d)).otherwise(word(0)))
                new = [r["r0"].bitwiseAND(match)]
                for e in range(1, threshold + 1):
                    less = r[f"r{e - 1}"]
                    edited = less.bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(new[-1], 1))
                    new.append(r[f"r{e}"].bitwiseAND(match).bitwiseOR(edited).bitwiseAND(word(full)))
                return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(new)])

            return F.aggregate(F.sequence(F.lit(0), F.size(s["t"]) - 1), r, advance)

        return _bound(F.struct(characters(text).alias("t"), characters(other).alias("p")), run)

    first = [1 << threshold]
    for _ in range(threshold):
        first.append((first[-1] | first[-1] << 1) & full)
    start = F.struct(*[word(s).alias(f"r{e}") for e, s in enumerate(first)])

    def automaton(s: Column) -> Column:
        # the other string is padded by what equals no character of a line
        p, t = F.concat(F.lit("\n" * threshold), s["a"]), s["b"]

        def advance(r: Column, k: Column) -> Column:
            more = stretch(r, F.substring(t, k * STRETCH + 1, F.lit(STRETCH)), F.substring(p, k * STRETCH + 1, F.lit(STRETCH + 2 * threshold)))
            return F.when(r[f"r{threshold}"] == 0, r).otherwise(more)

        blocks = F.floor((F.length(t) + (STRETCH - 1)) / STRETCH).cast("int")
        steps = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
        # a word may hold diagonals beyond its first edits, so the least e counts
        goal = F.call_function("shiftleft", F.lit(1), F.length(s["a"]) - F.length(t) + threshold)

        def reached(r: Column) -> Column:
            out = F.lit(threshold + 1)
            for e in reversed(range(threshold + 1)):
                out = F.when(r[f"r{e}"].bitwiseAND(goal) != 0, e).otherwise(out)
            return out

        return F.aggregate(steps, start, advance, reached)

    def without(s: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of both strings, reversed, without their common head."""
        rest = [F.reverse(F.substring(s[x], s["n"] + 1, F.length(s[x]))).alias(x) for x in "ab"]
        return _bound(F.struct(*rest), body)

    def headed(s: Column) -> Column:
        return F.struct(_common_head(s["a"], s["b"]).alias("n"), s["a"].alias("a"), s["b"].alias("b"))

    # the tail is the head of what is left, reversed
    pair = F.struct(a.alias("a"), b.alias("b"))
    near = _bound(headed(pair), lambda s: without(s, lambda t: _bound(headed(t), lambda u: without(u, automaton))))
    return F.when(F.abs(F.length(a) - F.length(b)) <= threshold, near).otherwise(threshold + 1)


def letter_counts(line: Column) -> Column:
    """Counts of ``COUNTED`` letters modulo 16, four bits each."""
    packed = F.lit(0).cast("long")
    for k, letter in enumerate(COUNTED):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft((count % 16).cast("long"), 4 * k))
    return packed


def counts_allow(a: Column, b: Column, threshold: int) -> Column:
    """A replaced letter changes two counts by one, an inserted or deleted one a single count.

    Counts are known modulo 16, so the smaller way around is a lower bound.
    """
    total = F.lit(0)
    for k in range(len(COUNTED)):
        d = F.abs(F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15)))
        total = total + F.least(d, F.lit(16) - d)
    return total <= 2 * threshold


def linked(a: Column, b: Column, threshold: int, per_edit: int) -> Column:
    return edits_within(a, b, threshold) <= allowed(F.least(F.length(a), F.length(b)), threshold, per_edit)


def line_entries(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct line, written down: (node, h1, h2, line, n, place, copies).

    ``node`` numbers the rows, ``h1`` and ``h2`` are hashes, ``n`` is the
    line's length, ``place`` that of its first occurrence.
    """
    lines = split_lines(docs, id_col, text_col)
    keyed = lines.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line", position(F.col("doc_id"), F.col("line_no")).alias("place"))
    entries = keyed.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
    return cut_lineage(entries.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "line", F.length("line").alias("n"), "place", "copies"), "lines")


def line_links(entries: DataFrame, *, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """(a, b), a < b: every link between nodes of ``entries``, once, written down."""
    if threshold < 1:
        return cut_lineage(entries.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), "links")
    line, n = F.col("line"), F.col("n")
    fit = entries.where(allowed(n, threshold, per_edit) >= 1).select("node", "line", "n")
    filed = fit.select(F.explode(filings(line, n, threshold, per_edit)).alias("key"), "node")
    leaders = filed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    # a table of its own, so that the join below can be split where a key is very common
    leaders = cut_lineage(leaders, "leaders")
    asked = fit.select(F.explode(lookups(line, n, threshold, per_edit)).alias("key"), "node").where("key is not null")
    # one row per key is the hashed side: nothing is sorted, and a look-up gives at most one row
    hits = cut_lineage(asked.join(leaders.hint("shuffle_hash"), "key").where("m > 1 or node <> lo").select("key", "node", "m", "lo", "hi"), "hits")
    discard(leaders)
    star = hits.where("m <= 2").select("node", F.explode(F.array("lo", "hi")).alias("to")).where("node <> to")
    star = cut_lineage(star.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct(), "candidates")
    crowded = hits.where("m > 2").select("key", "node", "m").distinct()
    needed = star.select(F.explode(F.array("a", "b")).alias("node")).unionByName(crowded.select("node")).distinct()
    # the same plan at every size: a broadcast for few lines would make small inputs look cheaper
    texts = cut_lineage(fit.join(needed.hint("merge"), "node", "left_semi").select("node", "line", "n"), "texts")
    side = texts.select("node", "line", letter_counts(line).alias("letters"))
    both = star.join(side.toDF("a", "line_a", "letters_a"), "a").join(side.toDF("b", "line_b", "letters_b"), "b")
    both = both.where(counts_allow(F.col("letters_a"), F.col("letters_b"), threshold))
    links = both.where(linked(F.col("line_a"), F.col("line_b"), threshold, per_edit)).select("a", "b")
    # the lines under one key are dealt out to a grid of cells, each of a bounded number of pairs
    sizes = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("p"))
    cell = [F.ceil(F.col("m") / FILED).cast("int"), F.ceil(F.col("p") / ASKED).cast("int")]
    placed = crowded.join(sizes, "key").select("key", "node", cell[0].alias("rows"), cell[1].alias("cols"))
    # every line with the crowded keys at which it looks up, itself filed under some of them
    common = crowded.groupBy("node").agg(F.collect_list("key").alias("keys"))
    placed = cut_lineage(placed.join(common, "node").join(side, "node"), "open")

    def dealt(table: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one place of its own direction and all of the other."""
        at = F.pmod(F.xxhash64("node", F.lit(own)), F.col(own)).cast("int")
        return table.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    own = texts.select("node", filings(line, n, threshold, per_edit).alias("files")).where("files is not null")
    own = own.select("node", "files", F.explode(F.array_distinct("files")).alias("key"))
    filed = dealt(placed.join(own, ["key", "node"]), "rows", "cols")
    filed = filed.select(*[F.col(c).alias(f"{c}_b") for c in ("key", "rows", "cols", "node", "files", "line", "letters")])
    same = [F.col(c) == F.col(f"{c}_b") for c in ("key", "rows", "cols")]
    # of equal lengths both are filed and both look up: one of the two meetings will do
    once = (F.length("line") > F.length("line_b")) | ((F.length("line") == F.length("line_b")) & (F.col("node") < F.col("node_b")))
    once = once & counts_allow(F.col("letters"), F.col("letters_b"), threshold)
    first = F.array_min(F.array_intersect("keys", "files_b")) == F.col("key")
    met = dealt(placed, "cols", "rows").join(filed.hint("merge"), same[0] & same[1] & same[2] & once & first)
    met = met.where(linked(F.col("line"), F.col("line_b"), threshold, per_edit))
    rest = met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
    # a pair can share a crowded key and another one
    found = cut_lineage(links.unionByName(rest).distinct(), "links")
    discard(hits, star, texts, placed)
    return found


def judge_lines(docs: DataFrame, *, threshold: int = THRESHOLD, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct line, written down: (h1, h2, place, copies, class, links, near, keep).

    ``class`` is the place of the first line of its class, ``links`` counts the
    other distinct lines of the class, ``near`` those of them that link to the
    line itself, ``keep`` is true for the first one.
    """
    entries = line_entries(docs, id_col=id_col, text_col=text_col)
    links = line_links(entries, threshold=threshold, per_edit=per_edit)
    classes = cut_lineage(components(links, "a", "b"), "classes")
    linked_ = entries.select("node", "h1", "h2", "place", "copies").join(classes, "node")
    first = linked_.groupBy("component").agg(F.min("place").alias("class"), (F.count(F.lit(1)) - 1).alias("links"))
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    near = ends.groupBy("node").agg(F.count(F.lit(1)).alias("near"))
    named = linked_.join(first, "component").join(near, "node").select("node", "class", "links", "near")
    out = entries.select("node", "h1", "h2", "place", "copies").join(named, "node", "left")
    found = F.coalesce("class", "place")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("links", "near")]
    judged = cut_lineage(out.select("h1", "h2", "place", "copies", found.alias("class"), *counts, (found == F.col("place")).alias("keep")), "verdicts")
    discard(entries, links, classes)
    return judged


def line_verdicts(docs: DataFrame, *, threshold: int = THRESHOLD, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-empty line: its class (place of the class's first line), its number of links and verdict.

    ``copies`` counts the occurrences of equal lines, ``links`` the other
    distinct lines of the class, ``near`` the distinct lines within the
    threshold of this one; ``keep`` holds for the class's first line only.
    """
    judged = judge_lines(docs, threshold=threshold, per_edit=per_edit, id_col=id_col, text_col=text_col)
    lines = split_lines(docs, id_col, text_col).select("doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    found = lines.join(judged, ["h1", "h2"])
    keep = F.col("keep") & (position(F.col("doc_id"), F.col("line_no")) == F.col("place"))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").cast("long").alias("class_line_no"), "copies", "links", "near", keep.alias("keep"))


def dedup_lines(docs: DataFrame, *, threshold: int = THRESHOLD, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the dropped lines; documents that lose every line go.

    Documents without any line (null or empty text, only empty lines) stay.
    """
    # columns are told apart by place, whatever their names
    names = [f"c{i}" for i in range(len(docs.columns))]
    text_at, id_at = names[docs.columns.index(text_col)], names[docs.columns.index(id_col)]
    held = cut_lineage(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "rows")
    placed = held.select(row_place(id_at, text_at).alias("at"), F.col(text_at).alias("text"))
    verdicts = line_verdicts(placed, threshold=threshold, per_edit=per_edit, id_col="at", text_col="text")
    gone = verdicts.where(~F.col("keep")).groupBy(F.col("doc_id.row").alias("_row")).agg(F.collect_set(F.col("line_no").cast("int")).alias("_gone"))
    joined = held.join(gone, "_row", "left")
    lines = F.split(text_at, "\n", -1)
    # set difference by hash: in proportion to the lines, however many go
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    bound = F.transform(F.array(F.struct(lines.alias("x"), kept.alias("i"))), lambda s: F.transform(s["i"], lambda i: F.get(s["x"], i)))[0]
    out = joined.withColumn("_kept", F.when(F.col("_gone").isNotNull(), bound))
    text = F.when(F.col("_kept").isNull(), F.col(text_at)).otherwise(F.array_join("_kept", "\n"))
    out = out.where(F.col("_kept").isNull() | F.exists("_kept", lambda x: x != "")).withColumn(text_at, text)
    if "n_chars" in docs.columns:
        count = names[docs.columns.index("n_chars")]
        out = out.withColumn(count, F.coalesce(F.length(text_at).cast("long"), F.col(count).cast("long")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*docs.columns)

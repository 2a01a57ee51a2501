"""Operator 10: SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces of a model make a lattice over the text, and the encoding is the path
of the highest weight. The public model merges byte pairs by rank, so weights
belong to neighbours: two pieces next to each other weigh 0 if merging their
joint text gives just these two, else minus infinity. A boundary between two
pieces holds in the whole text if it holds between these two alone, since no
merge crosses it before both are complete; so exactly one path has weight 0, and
its ids are those of the merge encoder.

Chunks of a text meet at boundaries that a piece may straddle, so a boundary has
one state per piece that ends there or straddles it. Each chunk gives a matrix
of best weights from entry to exit states (sparse: its finite entries), matrices
combine associatively under (max, +) in a tree, the states found are handed down
the tree, and each chunk is then backtraced by itself.

A place that no piece straddles is a single state: between two such places the
best path doesn't depend on the rest. Words (a run of the space letter and what
follows it) are such stretches in models whose pieces hold the space letter only
at their head; each is solved once per worker and remembered. Chunks end at such
places where there are any near.

Defined results for odd input: null and empty texts have no ids (and decode to
empty); characters without a piece become byte pieces, or the unknown id where
a model has none; the best path is unique, so no result depends on where chunks
end; texts of any length are encoded whole; repeated rows each get a row; an
empty table gives an empty result; extra columns are kept by
:func:`encode_pieces` whatever their names, a new column whose name is taken gets
underscores behind it. Models of other kinds than merged pairs, or with pieces
defined by users, are refused.
"""

from __future__ import annotations

import struct
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.common import cut_lineage, free_name, short_batches

SPACE = "▁"
NEG = float("-inf")
#: Characters per chunk; texts up to this length are one chunk.
CHUNK = 32_768
#: How far before a chunk's end a better place to cut is looked for.
SLACK = 4_096
MEMO_WORDS, MEMO_PAIRS = 400_000, 1_000_000
#: A boundary's only state where no piece straddles it.
FREE = ((0, 0),)


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            value, at = data[at : at + 4], at + 4
        yield key >> 3, value


class _Solved(dict):
    """Stretch to the bytes of its ids; emptied when full, very long stretches are not kept."""

    def __init__(self, solve):
        super().__init__()
        self.solve = solve

    def __missing__(self, stretch: str) -> bytes:
        found = self.solve(stretch)
        if len(stretch) <= 64:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[stretch] = found
        return found


class PieceModel:
    """Pieces, ranks and the few settings of a model file that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.dummy_prefix, self.squeeze = True, True
        kind_of_model = 1
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                kind_of_model = next((v for n, v in _fields(value) if n == 3), kind_of_model)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.squeeze = bool(v)
        if kind_of_model != 2 or any(k in (4, 5) for k in self.kinds):
            raise ValueError("only models of merged pairs without user-defined or unused pieces are read")
        usable = [i for i, k in enumerate(self.kinds) if k == 1 and self.pieces[i]]
        self.ids = {self.pieces[i]: i for i in usable}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == 2), 0)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == 6}
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        #: Piece or proper prefix of one -> id, None for prefixes only.
        self.table: dict = {}
        for i in usable:
            for n in range(1, len(self.pieces[i])):
                self.table.setdefault(self.pieces[i][:n])
        self.table.update(self.ids)
        self.space_leads = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        #: Neighbouring characters inside of pieces; between any others no piece can straddle.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: Words without their leading space letter, and parts of words.
        self.memo, self.parts = _Solved(self.solve_word), _Solved(self.solve_part)
        #: Lengths of the pieces that begin with three characters, the longest first, and those of any piece.
        self.reach: dict = {}
        for piece in sorted(self.ids, key=len, reverse=True):
            if len(piece) > 2 and (not (found := self.reach.setdefault(piece[:3], [])) or found[-1] != len(piece)):
                found.append(len(piece))
        for found in self.reach.values():
            found += [2, 1]
        self.pairs: dict = {}
        #: What each id adds to the bytes of a decoded text; control pieces add nothing (kinds are fixed by the format).
        self.spelled = [bytes([int(p[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" if k == 3 else p.encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def normalize(self, text: str | None) -> str:
        """Spaces as the space letter, one before the text if the model asks for it."""
        text = text or ""
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def expand(self, piece: str) -> list[int]:
        """The ids written for a piece: bytes for a character without one."""
        if piece in self.ids:
            return [self.ids[piece]]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: of all neighbours whose joint text is a piece, the best ranked merge first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, before: str, piece: str) -> float:
        """0 if the two stand side by side in the encoding of their joint text, else minus infinity; ``before`` may be empty."""
        key = before, piece
        found = self.pairs.get(key)
        if found is None:
            whole = [before, piece] if before else [piece]
            found = 0.0 if self.merged(before + piece) == whole else NEG
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def candidates(self, text: str, at: int) -> list[str]:
        """Pieces of the lattice that start at a place, the longest last; the character itself is always one."""
        out, table = [text[at : at + 1]], self.table
        if out[0] not in table:
            return out
        for end in range(at + 2, min(len(text), at + self.longest) + 1):
            piece = text[at:end]
            found = table.get(piece, -1)
            if found == -1:
                break
            if found is not None:
                out.append(piece)
        return out

    def best_path(self, text: str, before: str = "", start: int = 0, goal: int | None = None) -> list[str]:
        """Pieces of the path of weight 0 from ``start`` (after the piece ``before``) to ``goal``; raises where there is none.

        Long pieces are tried first. A place reached once is not tried again: all
        paths of weight 0 to it end with the same piece.
        """
        goal = len(text) if goal is None else goal
        path, at, tried = [], start, {start}
        open_ = [self.candidates(text, at)] if at < goal else []
        while at < goal:
            while not open_[-1]:
                open_.pop()
                if not path:
                    raise ValueError("no path")
                at -= len(path.pop())
            piece = open_[-1].pop()
            end = at + len(piece)
            if end <= goal and end not in tried and self.weight(path[-1] if path else before, piece) == 0.0:
                path.append(piece)
                tried.add(end)
                at = end
                if at < goal:
                    open_.append(self.candidates(text, at))
        return path

    def solve_part(self, text: str) -> bytes:
        """Ids of a short stretch: :meth:`best_path` from its beginning to its end, with lengths looked up instead of tried."""
        ids, pairs, reach, n = self.ids, self.pairs, self.reach, len(text)
        path, open_, before, at, tried = [], [], "", 0, set()
        sizes = iter(reach.get(text[:3], (2, 1)))
        while at < n:
            for size in sizes:
                end = at + size
                if end in tried or end > n:
                    continue
                piece = text[at:end]
                if piece in ids or size == 1:
                    weight = pairs.get((before, piece))
                    if (self.weight(before, piece) if weight is None else weight) == 0.0:
                        tried.add(end)
                        open_.append(sizes)
                        path.append(piece)
                        before, at, sizes = piece, end, iter(reach.get(text[end : end + 3], (2, 1)))
                        break
            else:
                at -= len(path.pop())
                sizes, before = open_.pop(), path[-1] if path else ""
        return self.spell(path)

    def states(self, text: str, at: int) -> tuple:
        """(characters before, characters after) of the pieces that end at or straddle a place."""
        if at <= 0 or at >= len(text) or self.is_cut(text, at):
            return FREE
        out = []
        for back in range(1, min(self.longest, at) + 1):
            for ahead in range(min(self.longest - back, len(text) - at) + 1):
                if text[at - back : at + ahead] in self.ids or back + ahead == 1:
                    out.append((back, ahead))
        return tuple(out)

    def is_cut(self, text: str, at: int) -> bool:
        """Whether no piece can straddle this place."""
        return text[at - 1 : at + 1] not in self.joined

    def transfer(self, text: str, start: int, stop: int) -> tuple[int, int, np.ndarray]:
        """(entry states, exit states, pairs of weight 0) of the chunk [start, stop) of ``text``.

        ``text`` holds up to ``longest`` characters on either side of the chunk.
        All entries walk the lattice together: each place holds, by last piece,
        the entries that reach it, as bits.
        """
        enter, leave = self.states(text, start), self.states(text, stop)
        first, last = self.cuts(text, start, stop)
        if first is not None:
            # what comes before a free place doesn't matter behind it
            into = [i for i, hit in enumerate(self.walk(text, start, first, enter, FREE)) if hit]
            out = [i for i, hit in enumerate(self.walk(text, last, stop, FREE, leave, turned=True)) if hit]
            pairs = [(a, b) for a in into for b in out]
        else:
            pairs = [(a, b) for b, mask in enumerate(self.walk(text, start, stop, enter, leave, turned=True)) for a in range(len(enter)) if mask >> a & 1]
        return len(enter), len(leave), np.array(sorted(pairs), "<u2").reshape(-1, 2)

    def walk(self, text: str, start: int, stop: int, enter: tuple, leave: tuple, turned: bool = False) -> list[int]:
        """For each exit state the entries that reach it, as bits; for each entry its exits unless ``turned``."""
        found = dict.fromkeys(leave, 0)
        at: dict = {}

        def arrive(end: int, piece: str, mask: int) -> None:
            if end < stop:
                here = at.setdefault(end, {})
                here[piece] = here.get(piece, 0) | mask
            else:
                state = (0, 0) if leave is FREE and end == stop else (len(piece) - (end - stop), end - stop)
                if state in found:
                    found[state] |= mask

        for bit, (back, ahead) in enumerate(enter):
            arrive(start + ahead, text[start - back : start + ahead] if back else "", 1 << bit)
        for i in range(start, stop):
            for before, mask in at.pop(i, {}).items():
                for piece in self.candidates(text, i):
                    if self.weight(before, piece) == 0.0:
                        arrive(i + len(piece), piece, mask)
        masks = [found[s] for s in leave]
        if turned:
            return masks
        return [sum((m >> i & 1) << b for b, m in enumerate(masks)) for i in range(len(enter))]

    def cuts(self, text: str, start: int, stop: int):
        """First and last place in [start, stop] that no piece straddles, or None, None."""
        if not self.space_leads:
            return None, None
        places = []
        for find, step in ((text.find, 1), (text.rfind, -1)):
            at = find(SPACE, max(start, 1), stop + 1)
            while at >= 0 and text[at - 1] == SPACE:
                at = find(SPACE, at + 1, stop + 1) if step == 1 else find(SPACE, max(start, 1), at)
            places.append(at)
        return (None, None) if places[0] < 0 else tuple(places)

    def words(self, text: str) -> list[str]:
        """Stretches that begin at the space letter and end before the next word's, without that letter."""
        if SPACE * 2 not in text and text.startswith(SPACE):
            return text[1:].split(SPACE)
        out, start = [], 0
        at = text.find(SPACE, 1)
        while at >= 0:
            if text[at - 1] != SPACE:
                out.append(text[start + 1 : at])
                start = at
            at = text.find(SPACE, at + 1)
        return [*out, text[start + 1 :]] if text else []

    def spell(self, pieces: list[str]) -> bytes:
        """Ids of pieces as little-endian 32-bit numbers."""
        try:
            return array("I", [self.ids[p] for p in pieces]).tobytes()
        except KeyError:
            ids = [i for p in pieces for i in self.expand(p)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def solve_word(self, word: str) -> bytes:
        """Ids of a word, from those of the parts between places that no piece straddles."""
        text, joined, out, start = SPACE + word, self.joined, [], 0
        for at in range(1, len(text)):
            if text[at - 1 : at + 1] not in joined:
                out.append(self.parts[text[start:at]])
                start = at
        out.append(self.parts[text[start:]])
        return b"".join(out)

    def stretches(self, text: str) -> bytes:
        """Ids of a text that begins with the space letter, or of any text where that letter doesn't lead."""
        if not text:
            return b""
        if not self.space_leads or text[0] != SPACE:
            return self.spell(self.best_path(text))
        memo = self.memo
        return b"".join([memo[w] for w in self.words(text)])

    def backtrace(self, text: str, start: int, stop: int, enter: int, leave: int) -> bytes:
        """Ids of the pieces that begin in a chunk, on its path between two states."""
        back, ahead = self.states(text, start)[enter]
        goal = stop + self.states(text, stop)[leave][1]
        before, at = text[start - back : start + ahead] if back else "", start + ahead
        first, last = self.cuts(text, start, stop)
        if first is None or at > first:
            return self.spell(self.best_path(text, before, at, goal))
        head = self.spell(self.best_path(text, before, at, first))
        return head + self.stretches(text[first:last]) + self.spell(self.best_path(text, "", last, goal))

    def encode(self, normal: str) -> bytes:
        """A text of one chunk: one stretch after the other."""
        if not self.space_leads or normal.startswith(SPACE):
            return self.stretches(normal)
        first = self.cuts(normal, 0, max(0, len(normal) - 1))[0]
        if first is None:
            return self.spell(self.best_path(normal))
        return self.spell(self.best_path(normal[:first])) + self.stretches(normal[first:])

    def chunks(self, normal: str, size: int = CHUNK, slack: int = SLACK) -> list[tuple[int, int]]:
        """(start, end) of chunks, cut at places no piece straddles where there are any near."""
        out, at = [], 0
        while len(normal) - at > size:
            end = at + size
            if self.space_leads:
                cut = normal.rfind(SPACE, max(at + 1, end - slack), end)
                while cut > at and normal[cut - 1] == SPACE:
                    cut -= 1
                if cut > at:
                    end = cut
            out.append((at, end))
            at = end
        return [*out, (at, len(normal))]

    def part(self, normal: str, start: int, end: int) -> tuple[str, int, int]:
        """A chunk with its surroundings, and its place in them."""
        low = max(0, start - self.longest)
        return normal[low : end + self.longest], start - low, end - low

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, bytes gathered, space letters as spaces."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def dense(rows: int, columns: int, pairs: np.ndarray) -> np.ndarray:
    out = np.full((rows, columns), NEG, np.float32)
    out[pairs[:, 0], pairs[:, 1]] = 0.0
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: first the stretch of ``a``, then that of ``b``."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan_states(matrices: list) -> list[tuple[int, int]]:
    """(entry, exit) state of every chunk on the best path through all of them.

    Neighbouring stretches are combined up a tree; going down, the two halves of
    each stretch agree on the state between them.
    """
    levels = [matrices]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([combine(*now[i : i + 2]) if i + 1 < len(now) else now[i] for i in range(0, len(now), 2)])
    top = levels[-1][0]
    ends = [tuple(int(x) for x in np.unravel_index(top.argmax(), top.shape))]
    for now in reversed(levels[:-1]):
        below = []
        for i, (enter, leave) in enumerate(ends):
            if 2 * i + 1 == len(now):
                below.append((enter, leave))
            else:
                middle = int((now[2 * i][enter] + now[2 * i + 1][:, leave]).argmax())
                below += [(enter, middle), (middle, leave)]
        ends = below
    return ends


_models: dict = {}


def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    if path not in _models:
        with open(path, "rb") as f:
            _models[path] = PieceModel(f.read())
    return _models[path]


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _arrow(schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def encode_pieces(docs: DataFrame, *, path: str | None = None, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """All columns of ``docs`` and ``ids`` (little-endian 32-bit numbers).

    Texts of one chunk are encoded where they lie. Longer ones are split into
    chunk rows that any task may take: their matrices are computed in parallel,
    combined per text, and the chunks are backtraced in parallel.
    """
    spark = docs.sparkSession
    short_batches(spark)
    path = path or model_file()
    ids, row = free_name("ids", docs.columns), free_name("_row", docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())])
    at = docs.columns.index(text_col)

    def small(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            done = [m.encode(m.normalize(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.binary())], names=schema.names)

    is_long = F.coalesce(F.length(text_col), F.lit(0)) >= chunk
    short = docs.where(~is_long).mapInArrow(small, schema)
    # the row's number is fixed by writing the long rows down once
    long = cut_lineage(docs.where(is_long).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    piece = T.StructType([T.StructField("row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("part", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])

    def split(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                normal = m.normalize(text)
                out = [dict(zip(piece.names, (number, i, *m.part(normal, s, e)), strict=True)) for i, (s, e) in enumerate(m.chunks(normal, chunk))]
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_pylist(out[i : i + 64], schema=_arrow(piece))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = cut_lineage(long.select(F.col(row).alias("row"), F.col(text_col).alias("text")).mapInArrow(split, piece).repartition(parts, "row", "chunk"), "chunks")
    matrix = T.StructType([T.StructField("row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("rows", T.IntegerType()), T.StructField("columns", T.IntegerType()), T.StructField("pairs", T.BinaryType())])

    def transfers(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows, columns, pairs = m.transfer(r["part"], r["start"], r["stop"])
                out.append({"row": r["row"], "chunk": r["chunk"], "rows": rows, "columns": columns, "pairs": pairs.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(matrix))

    state = T.StructType([T.StructField("row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("enter", T.IntegerType()), T.StructField("leave", T.IntegerType())])

    def scan(frame):
        import pandas as pd

        frame = frame.sort_values("chunk")
        matrices = [dense(r, c, np.frombuffer(p, "<u2").reshape(-1, 2)) for r, c, p in zip(frame["rows"], frame["columns"], frame["pairs"], strict=True)]
        states = scan_states(matrices)
        return pd.DataFrame({"row": frame["row"].to_numpy(), "chunk": frame["chunk"].to_numpy(), "enter": [s[0] for s in states], "leave": [s[1] for s in states]})

    # one text's matrices: a few numbers for each 32,768 characters of one row, some KB where no word ends near
    states = chunks.mapInArrow(transfers, matrix).groupBy("row").applyInPandas(scan, state)
    traced = T.StructType([T.StructField("row", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def trace(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            out = [{"row": r["row"], "chunk": r["chunk"], "ids": m.backtrace(r["part"], r["start"], r["stop"], r["enter"], r["leave"])} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(traced))

    pieces = chunks.join(states, ["row", "chunk"]).mapInArrow(trace, traced)
    # as many chunks as one row's text has: no more than fits in a row already
    whole = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("c"))
    whole = whole.select(F.col("row").alias(row), F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias(ids))
    return short.unionByName(long.join(whole, row).select(*docs.columns, ids))


def decode_pieces(rows: DataFrame, *, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text that the ids spell."""
    path = path or model_file()
    schema = T.StructType([*rows.schema.fields, T.StructField(free_name("decoded", rows.columns), T.StringType())])
    at = rows.columns.index(ids_col)

    def decode(batches):
        import pyarrow as pa

        m = model(path)
        for batch in batches:
            texts = [m.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(decode, schema)


def digest_pieces(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids, their crc32, and whether decoding gives the text back."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    coded = decode_pieces(encode_pieces(own, path=path), path=path)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select(F.col("doc_id").alias(id_col), (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), same.alias("round_trip"))


def check_of(ids) -> int:
    """ids_crc32 of one text, for tests."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())

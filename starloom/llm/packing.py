"""Operator 5: order-preserving packing by dynamic programming.

Token streams are cut into windows of at most ``size`` ids. A window may end
after a document (free), after a sentence (a small penalty), or, where a
sentence is longer than a window, at multiples of the window inside it (a large
penalty). With S the positions of possible cuts, the cost of the best packing
up to cut j is

    f(j) = penalty(j) + min over cuts i < j, p(j) - p(i) <= size, of
           f(i) + padding(p(j) - p(i))

Padding is size - length, or 0 where the length is a power of two: such
sequences stay as they are. The first case is f(i) + p(i) + const, whose
minimum over a sliding window a monotone queue holds in constant time; the
powers of two are single further candidates per cut.

The stream is dealt out by ranges of document ids; each partition is packed by
itself, block by block: the stream is cut off at ``block`` ids at the last cut
point of the best path that later ids can't improve much, and the rest carries
over, so memory is bounded and a partition wastes at most its last window.

Defined results for odd input: null text is an empty document, one end id;
texts of any length are packed whole; repeated ids (also null, which come last)
are separate documents, in order of a hash of their text, each with its own
pieces; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from starloom.llm.common import short_batches
from starloom.llm.tokenfiles import in_order
from starloom.llm.tokens import encoder, tokenizer_file

SIZE = 2048
#: Costs in ids of padding.
SENTENCE_PENALTY, HARD_PENALTY = 8.0, 96.0
BLOCK = 1 << 18
#: Bytes of text encoded at once: more hold fewer distinct words in proportion.
TEXT_BYTES = 4 << 20

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def best_cuts(positions, penalties, size: int = SIZE) -> list[int]:
    """Indices of the cuts of the cheapest packing of [0, positions[-1]).

    ``positions`` are the ascending places of possible cuts, the last one the
    end; neighbours are at most ``size`` apart.
    """
    n = len(positions)
    place = [0, *positions]
    cost, back = [0.0] * (n + 1), [0] * (n + 1)
    hits, upto = power_steps(np.array(place), size)
    hit = 0
    queue: deque = deque([(0.0, 0)])
    for j in range(1, n + 1):
        p = place[j]
        while place[queue[0][1]] < p - size:
            queue.popleft()
        key, i = queue[0]
        best = key + size - p
        if p - place[i] & (p - place[i] - 1) == 0:
            best = cost[i]
        if hit < upto[j]:
            for k in hits[hit : upto[j]]:
                if cost[k] < best:
                    best, i = cost[k], k
            hit = upto[j]
        cost[j], back[j] = best + penalties[j - 1], i
        key = cost[j] + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    cuts, j = [], n
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


def power_steps(place: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """The cuts a power of two below ``size`` before each of the ascending places, nearest first, and how many there are up to each place."""
    at = np.full(place[-1] + 1, -1, np.int32)
    at[place] = np.arange(len(place))
    steps = np.full((len(place), (size - 1).bit_length()), -1, np.int32)
    for k in range(steps.shape[1]):
        far = np.searchsorted(place, 1 << k)
        steps[far:, k] = at[place[far:] - (1 << k)]
    found = steps >= 0
    return steps[found].tolist(), np.cumsum(found.sum(1)).tolist()


def padding(length: int, size: int = SIZE) -> int:
    return 0 if length & (length - 1) == 0 else size - length


class Packer:
    """Takes documents in order, gives pieces; holds at most a block and one document."""

    def __init__(self, ends, size: int = SIZE, block: int = BLOCK, base: int = 0):
        self.ends, self.size, self.block, self.sequence = ends, size, block, base
        self.docs, self.held = [], 0  # [doc_id, ids not yet packed, start, doc_tokens]

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append([doc_id, ids, 0, len(ids)])
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool):
        """Pack what is held; unless it is the last, keep the final windows for later."""
        if not self.held:
            return
        stream = np.concatenate([d[1] for d in self.docs]).astype("<u4", copy=False)
        edges = np.cumsum([len(d[1]) for d in self.docs])
        fines = np.full(len(stream) + 1, np.inf, np.float32)
        fines[1:][self.ends[stream]] = SENTENCE_PENALTY
        fines[edges] = 0.0
        cuts = np.flatnonzero(np.isfinite(fines))
        gaps = np.diff(np.r_[0, cuts])
        for c, g in zip(cuts[gaps > self.size], gaps[gaps > self.size], strict=True):
            fines[c - g + self.size : c : self.size] = HARD_PENALTY
        place = np.flatnonzero(np.isfinite(fines))
        fine = fines[place]
        chosen = place[best_cuts(place.tolist(), fine.tolist(), self.size)]
        if not last:
            # the windows near the end may be cut otherwise once more ids are known
            chosen = chosen[: max(1, len(chosen) - 8)] if len(chosen) > 8 else chosen[:0]
        yield from self.emit(stream, chosen)

    def emit(self, stream, chosen):
        at, k = 0, 0  # place in the stream; document
        used = 0  # ids of document k already given out
        for end in chosen.tolist():
            offset = 0
            while at < end:
                doc = self.docs[k]
                n = min(len(doc[1]) - used, end - at)
                yield doc[0], doc[2] + used, n, zlib.crc32(stream[at : at + n]), doc[3], self.sequence, offset
                at, used, offset = at + n, used + n, offset + n
                if used == len(doc[1]):
                    k, used = k + 1, 0
            self.sequence += 1
        self.docs = self.docs[k:]
        if self.docs and used:
            self.docs[0][1], self.docs[0][2] = self.docs[0][1][used:], self.docs[0][2] + used
        self.held -= at


def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether a sentence or line may end with it."""
    enc = encoder(path)
    n = enc.tokenizer.get_vocab_size()
    ends = np.zeros(max(n, 2) + 1, bool)
    for i in range(n):
        piece = enc.tokenizer.decode([i], skip_special_tokens=False).rstrip(" \"')")
        ends[i] = piece.endswith((".", "!", "?", "\n"))
    return ends


def gathered(batches, most: int = TEXT_BYTES):
    """The columns of ``batches``, several put together up to ``most`` bytes; larger ones come alone."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held).columns
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held).columns


_ends: dict[str, np.ndarray] = {}


def pack_documents(docs: DataFrame, *, size: int = SIZE, end_id: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    A sequence's id is its partition's number times 2**40 plus its place there.
    """
    spark = docs.sparkSession
    short_batches(spark)
    path = tokenizer or tokenizer_file()
    ordered = in_order(docs, id_col, text_col)

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(path)
        if path not in _ends:
            _ends[path] = sentence_ends(path)
        packer = Packer(_ends[path], size, base=TaskContext.get().partitionId() << 40)

        def table(pieces):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names=PIECES.names)

        for doc_ids, texts in gathered(batches):
            pieces = []
            ids, stops = enc.encode_column(texts, end_id)
            for doc_id, doc in zip(doc_ids.to_pylist(), np.split(ids, stops[:-1]), strict=True):
                pieces += packer.add(doc_id, doc)
            if pieces:
                yield table(pieces)
        if pieces := list(packer.flush(True)):
            yield table(pieces)

    return ordered.mapInArrow(pack, PIECES)

"""Token ids of whole texts with a public byte-level tokenizer.

:class:`Encoder` gives exactly the ids of the ``tokenizers`` library for the
whole text, with the library's own settings: the string of an added token (such
as ``<|endoftext|>``) in a text becomes that token, so whoever wants it as plain
text must escape it before. Most of the library's time goes into merging the
same words again and again, so a text is cut where the pre-tokenizer always
cuts, and each distinct piece is encoded by the library once per worker; texts
with an added token's string are left whole. Both memos are bounded: they are
emptied when full.

A column of texts (:meth:`Encoder.encode_column`) is cut at the bytes of its
Arrow buffer, more finely, since a cut costs little there; Arrow finds the
distinct pieces of the batch, and a bounded memo is asked once for each.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: A space before a visible character always starts a new pre-token.
CUT = re.compile(r" (?=\S)")
#: A doubled or padded space: only texts with these need the look-ahead above.
PADDED = re.compile(r" (?!\S)")
#: Letters, maybe punctuation, maybe a line break and the same again: pre-tokens end where these groups end.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
SHAPE = re.compile(rf"({LETTERS})([.,;:!?#$%&*|]+)?(?:(\n)({LETTERS})([.,;:!?#$%&*|]+)?)?")
#: Letter runs are dear to encode and kept longest; words put together from parts, in the same memo, are cheap to redo.
MEMO_RUNS, MEMO_WORDS = 1_100_000, 600_000
LONGEST = 64
#: Pieces of columns in memory.
MEMO_PIECES = 1_200_000
#: Pieces of columns that are one pre-token.
SINGLE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-/:-@\[-`{-~]+)|[\t\n\r]")
#: Classes of bytes: pre-tokens hold one of the first three only, and an apostrophe with letters behind it.
LETTER, DIGIT, SIGN = 1, 2, 3


def byte_classes() -> np.ndarray:
    """The class of each byte, 0 where it depends on others or is a space."""
    kind = np.zeros(256, np.uint8)
    kind[33:127] = SIGN
    kind[48:58] = DIGIT
    kind[65:91] = kind[97:123] = LETTER
    return kind


BYTE_CLASSES = byte_classes()


def piece_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where to cut UTF-8 texts that lie one after the other: at ``starts`` and where a pre-token always begins.

    These are changes between letters (ASCII and Latin-1), digits and signs (ASCII),
    and the last white space before a visible character. Such a character begins
    with its first byte; a byte of a character that may be white space doesn't count.
    """
    kind = BYTE_CLASSES[data]
    # letters of U+00C0 to U+00FF; 97 and B7 are the signs of multiplication and division
    latin = np.flatnonzero(data == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = LETTER
    before, after = kind[:-1], kind[1:]
    cut = np.zeros(len(data), bool)
    cut[1:] = (before != after) & (before != 0) & (after != 0)
    quote = np.flatnonzero(data[:-1] == 0x27) + 1
    cut[quote[kind[quote] == LETTER]] = False
    # lead bytes of characters none of which is white space, and the classes above
    visible = (after != 0) | ((data[1:] >= 0xC3) & ((data[1:] < 0xE1) | (data[1:] > 0xE3)))
    blank = data[:-1] == 0x20
    breaks = (data[:-1] >= 0x09) & (data[:-1] <= 0x0D) & (data[:-1] != 0x0B) & (data[:-1] != 0x0C)
    within = np.ones(len(data), bool)
    within[starts] = False
    blank &= visible & within[1:]
    breaks &= visible & within[1:]
    cut[:-1] |= blank | breaks
    cut[1:] |= breaks
    cut[starts] = True
    return np.flatnonzero(cut)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b if b in printable else next(free)) for b in range(256)}


class _Runs(dict):
    """Letter run or punctuation, after ``lead``, to the bytes of its ids."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead, self.letters = encode, lead, byte_letters()

    def __missing__(self, run: str) -> bytes:
        if len(self) >= MEMO_RUNS:
            self.clear()
        ids = self[run] = self.alone(run)
        return ids

    def alone(self, run: str) -> bytes:
        lead = self.letters[ord(self.lead)] if self.lead else ""
        stand_in = run if run.isascii() and run != "\n" else run.encode().decode("latin-1").translate(self.letters)
        return array("I", self.encode(lead + stand_in, add_special_tokens=False).ids).tobytes()


class _Words(dict):
    """Word without its leading space, letter runs too, to the bytes of its ids."""

    def __init__(self, whole, run, bare: _Runs, lead: str):
        super().__init__()
        self.whole, self.run, self.bare, self.lead = whole, run, bare, lead

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            return array("I", self.whole(self.lead + word, add_special_tokens=False).ids).tobytes()
        body, last = word[:-1], word[-1:]
        if word.isascii() and word.isalpha():
            ids = self.run(word)
        elif last in ".,;:!?" and body.isascii() and body.isalpha():
            ids = self[body] + self.bare[last]
        elif shape := SHAPE.fullmatch(word):
            first, *more = shape.groups()
            ids = (self.run(word) if first == word else self[first]) + b"".join([self.bare[x] for x in more if x])
        else:
            ids = array("I", self.whole(self.lead + word, add_special_tokens=False).ids).tobytes()
        if len(self) >= MEMO_RUNS + MEMO_WORDS:
            self.make_room()
        self[word] = ids
        return ids

    def make_room(self) -> None:
        runs = {k: v for k, v in self.items() if k.isalpha()}
        self.clear()
        if len(runs) < MEMO_RUNS:
            self.update(runs)


class _Pieces(dict):
    """Piece of a column to the bytes of its ids."""

    def __init__(self, whole, single):
        super().__init__()
        self.whole, self.single, self.letters = whole, single, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        spaced = piece[0] == " "
        run = piece[1:] if spaced else piece
        if run.isascii() and run.isalpha():
            ids = array("I", [token.id for token in self.single("\u0120" + run if spaced else run)]).tobytes()
        elif SINGLE.fullmatch(piece):
            ids = array("I", [token.id for token in self.single(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        else:
            ids = array("I", self.whole(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Little-endian 32-bit ids of a text, as bytes or as an array."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the same model for single pre-tokens, spelled in byte letters
        inner = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []})).encode
        self.pieces = _Pieces(self.tokenizer.encode, inner.__self__.model.tokenize)
        bare, spaced = _Runs(inner, ""), _Runs(inner, " ")
        self.first = _Words(self.tokenizer.encode, bare.alone, bare, "")
        self.rest = _Words(self.tokenizer.encode, spaced.alone, bare, " ")

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(token in text for token in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words = CUT.split(text) if PADDED.search(text) else text.split(" ")
        head = self.first[words.pop(0)]
        return head + b"".join(map(self.rest.__getitem__, words))

    def encode_column(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of strings, one text after the other, and the place where each text's ids end.

        As :meth:`encode_bytes` of each, with ``end_id`` behind each text if given.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = len(texts)
        # no null, no slice of a longer array, 64-bit offsets
        texts = pa.concat_arrays([pa.array([], pa.large_string()), pc.fill_null(texts.cast(pa.large_string()), "")])
        alone = np.zeros(rows, bool)
        for token in self.added:
            alone |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(alone), "", texts) if alone.any() else texts
        _, offsets, buffer = plain.buffers()
        bounds = np.frombuffer(offsets, np.int64, rows + 1, 8 * plain.offset) if rows else np.zeros(1, np.int64)
        data = np.frombuffer(buffer or b"", np.uint8, bounds[-1])
        cuts = piece_starts(data, bounds[:-1][np.diff(bounds) > 0]) if len(data) else np.zeros(0, np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.r_[cuts, len(data)].astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        known = list(map(self.pieces.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False).tolist()))
        place, ends = pieces.indices.to_numpy(), np.searchsorted(cuts, bounds[1:])
        if alone.any():
            single = np.flatnonzero(alone)
            place = np.insert(place, ends[single], len(known) + np.arange(len(single)))
            known += [self.encode_bytes(texts[r].as_py()) for r in single.tolist()]
            ends = ends + np.cumsum(alone)
        if end_id is not None:
            place, ends = np.insert(place, ends, len(known)), ends + np.arange(1, rows + 1)
            known.append(np.array([end_id], "<u4").tobytes())
        joined = pa.array(known, pa.large_binary()).take(pa.array(place, pa.int64()))
        _, offsets, buffer = joined.buffers()
        stops = np.frombuffer(offsets, np.int64, len(joined) + 1)[ends] // 4 if len(joined) else np.zeros(rows, np.int64)
        return np.frombuffer(buffer or b"", "<u4", stops[-1] if rows else 0), stops

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

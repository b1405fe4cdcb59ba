"""Cutting Arrow columns of texts into pieces that are tokenised alone, and putting the pieces' ids together again.

All of it runs over whole batches: bytes are classified by a table, pieces are slices of the batch's own buffer, each
different piece is told once (dictionary_encode) and results are gathered by piece number. Pieces stay in Arrow: most
texts hold many words that occur nowhere else, each of which would be a Python object.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, DIGIT, SIGN, WHITE, OTHER = range(5)
#: Class of each byte. OTHER (bytes of signs beyond ASCII, and the separators U+001C to U+001F) borders on no cut but the one before a space.
CLASS = np.full(256, SIGN, np.uint8)
CLASS[0x80:] = CLASS[0x1C:0x20] = OTHER
CLASS[0x09:0x0E] = CLASS[0x20] = WHITE
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[ord("A") : ord("Z") + 1] = CLASS[ord("a") : ord("z") + 1] = LETTER
#: Where one pre-token of the pattern always ends between two bytes, by their classes: letters, digits and signs part from each
#: other and from what is white. A sign before a letter is looked at again, since an apostrophe may belong to it.
PARTS = np.zeros((8, 8), bool)
PARTS[: SIGN + 1, : WHITE + 1] = True
PARTS[range(3), range(3)] = False
PARTS = PARTS.ravel()
#: As PARTS, where white space is dropped.
WORD_PARTS = PARTS.reshape(8, 8).copy()
WORD_PARTS[WHITE] = WORD_PARTS[:, WHITE] = True
WORD_PARTS = WORD_PARTS.ravel()
#: First bytes of the letters U+00C0 to U+024F and U+0400 to U+047F, and what is no letter there or, lowered, no longer one (U+0130).
LEADS = np.zeros(256, bool)
LEADS[0xC3:0xCA] = LEADS[0xD0:0xD2] = True
NOT_LETTERS = np.array([0xC397, 0xC3B7, 0xC4B0], np.uint16)
#: UTF-8 of white space beyond ASCII.
WIDE_BLANKS = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)], np.uint32)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets from 0) of a string or binary array without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def binary(data, offsets: np.ndarray) -> pa.Array:
    """The binary array of data[offsets[i] : offsets[i + 1]]."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def apostrophes(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of an apostrophe with a letter behind it."""
    at = np.flatnonzero(data[:-1] == ord("'"))
    return at[kind[at + 1] == LETTER]


def pattern_cuts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sorted places where pieces begin, row starts among them, so that PATTERN parts each piece alone as it does in its row.

    Besides PARTS: where a blank stands before a visible sign, the run of blanks in front of it is a pre-token of its own, and so is
    the blank unless it is a space, which goes with the sign.
    """
    kind = CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = PARTS[(kind[:-1] << 3) | kind[1:]]
    cut[apostrophes(data, kind) + 1] = False
    ends = rows[1:][rows[1:] > rows[:-1]] - 1  # a row's last byte has no sign behind it
    at = np.setdiff1d(np.flatnonzero(kind == WHITE), ends, assume_unique=True)
    after = kind[at + 1]
    wide = np.flatnonzero((after == OTHER) & (data[at + 1] >= 0xC0))
    if len(wide):
        # The sign of two or three bytes behind a blank is visible unless it is in the list; a longer one always is.
        spot = at[wide] + 1
        b = [np.append(data, [0, 0, 0])[spot + i].astype(np.uint32) for i in range(3)]
        sign = np.where(b[0] < 0xE0, b[0] << 8 | b[1], b[0] << 16 | b[1] << 8 | b[2])
        after[wide[~np.isin(sign, WIDE_BLANKS)]] = SIGN
    at = at[after < WHITE]
    cut[at] = True
    cut[at[data[at] != 0x20] + 1] = True
    cut[rows] = True
    cut[-1] = False
    return np.flatnonzero(cut)


class Cut:
    """The pieces of a batch of texts: `pieces` (binary, each once), `codes` of their occurrences in order, and `rows`, the number
    of occurrences before each row (and all)."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, row_starts: np.ndarray):
        told = binary(np.ascontiguousarray(data), np.append(begins, len(data))).dictionary_encode()
        self.pieces, self.codes = told.dictionary, told.indices
        self.rows = np.searchsorted(begins, row_starts)

    def joined(self, values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, row offsets in items of `width` bytes) of each row's values, where values has one binary for each of `pieces`."""
        data, offsets = buffers(values.take(self.codes))
        return data, offsets[self.rows] // width


class Known:
    """What learn(pieces) gives for pieces, one binary each, remembered by a worker for up to `most` of them; beyond that, for the last batch's."""

    def __init__(self, learn: Callable[[pa.Array], pa.Array], most: int):
        self.learn, self.most = learn, most
        self.pieces = self.values = pa.array([], pa.large_binary())

    def of(self, pieces: pa.Array) -> pa.Array:
        found = pc.index_in(pieces, self.pieces)
        new = found.is_null().to_numpy(zero_copy_only=False)
        fresh = pieces.filter(pa.array(new))
        place = found.fill_null(0).to_numpy().astype(np.int64)
        place[new] = len(self.pieces) + np.arange(len(fresh))
        every = pa.concat_arrays([self.values, self.learn(fresh)])
        out = every.take(pa.array(place))
        if len(every) > self.most:
            self.pieces, self.values = pieces, out
        else:
            self.pieces, self.values = pa.concat_arrays([self.pieces, fresh]), every
        return out


def by_pattern(texts: pa.Array) -> Cut:
    """Pieces for vocabularies whose pre-tokens are those of public_tokenizers.PATTERN."""
    data, rows = buffers(texts)
    return Cut(data, pattern_cuts(data, rows), rows)


def by_blanks(texts: pa.Array) -> Cut:
    """Pieces between spaces and line feeds, which are dropped."""
    data, rows = buffers(texts)
    kept = (data != 0x20) & (data != 0x0A)
    before = np.append(0, np.cumsum(kept))
    begin = kept.copy()
    begin[1:] &= ~kept[:-1]
    starts = rows[:-1][rows[:-1] < rows[1:]]
    begin[starts] = kept[starts]
    return Cut(data[kept], before[:-1][begin], before[rows])


def letters_told(data: np.ndarray) -> np.ndarray:
    """CLASS of each byte, where the bytes of Latin and Cyrillic letters of two bytes are letters too."""
    kind = CLASS[data]
    at = np.flatnonzero(LEADS[data[:-1]])
    at = at[~np.isin(data[at].astype(np.uint16) << 8 | data[at + 1], NOT_LETTERS)]
    kind[at] = kind[at + 1] = LETTER
    return kind


def by_words(texts: pa.Array) -> Cut:
    """Words, digits and runs of signs, white space dropped, for vocabularies that compose (NFC), lower and then split texts into
    contractions behind an apostrophe, runs of letters, single digits and runs of other signs.

    A capital becomes small where an ASCII byte follows: a mark behind it might compose with one of the two only. Where a sign
    beyond ASCII is not known for a letter, nothing but white space parts it from its neighbours.
    """
    data, rows = buffers(texts)
    kind = letters_told(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = WORD_PARTS[(kind[:-1] << 3) | kind[1:]]
    cut[apostrophes(data, kind) + 1] = False
    cut[rows] = True
    kept = kind != WHITE
    small = data.copy()
    small[:-1] += ((data[:-1] - np.uint8(ord("A")) < 26) & (data[1:] < 0x80)).astype(np.uint8) << 5
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kept, out=before[1:])
    return Cut(small[kept], before[:-1][cut[:-1] & kept], before[rows])


def whole(texts: pa.Array) -> Cut:
    """Each text is one piece, an empty one none."""
    data, rows = buffers(texts)
    return Cut(data, rows[:-1][rows[:-1] < rows[1:]], rows)


def lengths(texts: pa.Array) -> list[int]:
    """Bytes of each text."""
    return pc.binary_length(texts).to_pylist()

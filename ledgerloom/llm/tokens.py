"""Token ids by the tokenizers library.

A text is cut only where the vocabulary's own pre-tokenizer always cuts, so the ids are those of the whole text:
"space" (byte-level vocabularies with public_tokenizers.PATTERN) cuts in Arrow batches (pieces.py);
"blank" drops white space and parts words from signs (vocabularies that ignore white space and case).
Each different piece is encoded once per worker, up to CACHE of them.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pieces import CLASS, DIGIT, OTHER, WHITE, Cut, Known, binary, buffers, by_pattern, by_words, letters_told

CACHE = 1_000_000
RUN_BYTES = 1 << 15


class Encoder:
    """Pieces go to the library many at a time; their ids are told apart again by what the vocabulary's tokens say."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        self.known = Known(self.learnt, CACHE)

    def cut(self, texts: pa.Array) -> Cut:
        raise NotImplementedError

    def learnt(self, pieces: pa.Array) -> pa.Array:
        """The uint16 ids of each piece, as binary."""
        raise NotImplementedError

    def ids(self, texts: list[str]) -> list[array]:
        return [array("H", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def runs(self, pieces: pa.Array, rows: np.ndarray, feed: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pieces at `rows` with `feed` behind each, in runs of about RUN_BYTES: (their numbers, where they start and the last ends, ids)."""
        some = pieces.take(pa.array(rows)).cast(pa.large_binary())
        data, starts = buffers(pc.binary_join_element_wise(some, pa.scalar(feed, some.type), pa.scalar(b"", some.type)))
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(starts[1:] // RUN_BYTES)) + 1) if len(rows) else []:
            a, b = starts[part[0]], starts[part[-1] + 1]
            got = self.ids([data[a:b].tobytes().decode("utf-8", "surrogatepass")])[0]
            yield rows[part], starts[part[0] : part[-1] + 2], np.frombuffer(got, np.uint16)

    def gathered(self, pieces: pa.Array, of: list[np.ndarray], ids: list[np.ndarray], lone: list[int]) -> pa.Array:
        """The ids of all pieces, from those of runs, each with the number of its piece, and of `lone` pieces, which are encoded each on its own."""
        for at in range(0, len(lone), 4096):
            part = lone[at : at + 4096]
            got = self.ids([p.decode("utf-8", "surrogatepass") for p in pieces.take(pa.array(part)).to_pylist()])
            ids.append(np.frombuffer(b"".join(x.tobytes() for x in got), np.uint16))
            of.append(np.repeat(part, [len(x) for x in got]))
        of, ids = np.concatenate([np.empty(0, np.int64), *of]), np.concatenate([np.empty(0, np.uint16), *ids])
        return binary(ids[np.argsort(of, kind="stable")], 2 * np.append(0, np.cumsum(np.bincount(of, minlength=len(pieces)))))

    def encode(self, texts: pa.Array, end: int) -> list[bytes]:
        """uint16 ids of each text, with the id `end` behind them."""
        cut = self.cut(texts)
        flat, offsets = cut.joined(self.known.of(cut.pieces), 2)
        raw, last, spots = flat.tobytes(), np.uint16(end).tobytes(), (2 * offsets).tolist()
        return [raw[a:b] + last for a, b in zip(spots, spots[1:])]


class ByteEncoder(Encoder):
    """A line feed stands behind each piece that has no space in front. The bytes of the tokens tell the pieces apart again."""

    cut = staticmethod(by_pattern)

    def __init__(self, path: str):
        super().__init__(path)
        self.width = np.zeros(1 << 16, np.int64)  # a byte-level token has one sign for each byte
        for token, k in self.tokenizer.get_vocab().items():
            self.width[k] = len(token)

    def lined(self, pieces: pa.Array) -> np.ndarray:
        """Which pieces are encoded alike alone and behind others: those without white space but for one space in front of a visible sign."""
        data, starts = buffers(pieces)
        if not len(data):
            return np.zeros(len(pieces), bool)
        kind, first = CLASS[data], starts[:-1]
        doubt = (kind == WHITE) | (kind == OTHER) & ((data < 0x80) | (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
        doubt[first] &= (data[first] != 0x20) | (np.diff(starts) == 1)
        out = np.ones(len(pieces), bool)
        unsure = np.unique(np.searchsorted(starts, np.flatnonzero(doubt), "right") - 1)
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces.take(pa.array(unsure)).to_pylist()]
        out[unsure] = [t.split() == [t.removeprefix(" ")] for t in texts]
        return out

    def learnt(self, pieces: pa.Array) -> pa.Array:
        lined, (data, starts) = self.lined(pieces), buffers(pieces)
        lone = np.flatnonzero(~lined).tolist()
        of, ids = [], []
        spaced = lined.copy()
        spaced[lined] = data[starts[:-1][lined]] == 0x20
        for rows, feed in ((np.flatnonzero(spaced), b""), (np.flatnonzero(lined & ~spaced), b"\n")):
            for part, starts, got in self.runs(pieces, rows, feed):
                ends = starts[0] + np.cumsum(self.width[got])
                begin = ends - self.width[got]
                feeds = np.isin(begin, starts[1:] - 1) if feed else np.zeros(len(got), bool)
                if not np.isin(starts[1:], ends).all() or ends[-1] != starts[-1] or feed and feeds.sum() != len(part):
                    lone += part.tolist()
                    continue
                ids.append(got[~feeds])
                of.append(part[np.searchsorted(starts[:-1], begin[~feeds], "right") - 1])
        return self.gathered(pieces, of, ids, lone)


class WordEncoder(Encoder):
    """A space stands behind each piece. The last token of a word, a digit or a run of signs is known by its word-end sign."""

    cut = staticmethod(by_words)

    def __init__(self, path: str):
        super().__init__(path)
        self.edge = np.zeros(1 << 16, bool)
        self.edge[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def words(self, pieces: pa.Array) -> np.ndarray:
        """How many words each piece is for the vocabulary, 0 where that is not known. None is fewer."""
        data, starts = buffers(pieces)
        if not len(data):
            return np.zeros(len(pieces), np.int64)
        kind, first = letters_told(data), starts[:-1]
        same = np.maximum.reduceat(kind, first) == np.minimum.reduceat(kind, first)
        out = np.where(kind[first] == DIGIT, np.diff(starts), 1) * same
        other = np.unique(np.searchsorted(starts, np.flatnonzero(kind == OTHER), "right") - 1)
        out[other] = [p.decode("utf-8", "surrogatepass").isalpha() for p in pieces.take(pa.array(other)).to_pylist()]
        return out

    def learnt(self, pieces: pa.Array) -> pa.Array:
        words = self.words(pieces)
        lone = np.flatnonzero(words == 0).tolist()
        of, ids = [], []
        for part, _, got in self.runs(pieces, np.flatnonzero(words), b" "):
            edge, each = self.edge[got], np.repeat(part, words[part])
            if edge.sum() != len(each) or not edge[-1]:
                lone += part.tolist()
                continue
            ids.append(got)
            of.append(each[np.cumsum(edge) - edge])
        return self.gathered(pieces, of, ids, lone)


_ENCODERS: dict[tuple[str, str], ByteEncoder | WordEncoder] = {}


def encoder(path: str, cut: str) -> ByteEncoder | WordEncoder:
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = {"space": ByteEncoder, "blank": WordEncoder}[cut](path)
    return _ENCODERS[path, cut]

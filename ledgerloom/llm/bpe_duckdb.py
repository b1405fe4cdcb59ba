"""Byte-level BPE encoding and decoding with DuckDB queries inside each partition.

encode(): a batch of texts is cut where the pre-token pattern always parts (pieces.py), and each different piece of it
is told once. Pieces with signs beyond ASCII or an apostrophe are pre-tokenised by it; every other one is a pre-token. The
different pre-tokens go to DuckDB, as many at once as SLICE allows: there a recursive query holds one row per token and
position, joins neighbours to the merge table and contracts each word's leftmost pair of least rank until no pair is left.
decode(): token ids join the vocabulary and an ordered aggregation puts the bytes together, BLOCK ids a group. Texts
are cut so for public_tokenizers.PATTERN; for any other pattern, whole texts are pre-tokenised by it.

Null texts count as empty (no ids). Repeated rows are encoded one by one. Pre-tokens over LONG_WORD bytes, where a
merge a round would take thousands of rounds, are contracted by the same rule with a heap. Very long texts are encoded whole.
Columns beside doc_id and text are not read, so their names cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks
from .pieces import CLASS, OTHER, apostrophes, binary, buffers, by_pattern, lengths, whole

LONG_WORD = 200  # under 256, the places that ENCODE_SQL tells
CHUNK_BYTES = 8 << 20
#: Rows that one encoding query may write at worst: a word of n bytes has n rows in the first round and at most n rounds.
SLICE = 2_000_000
DECODE_IDS, BLOCK = 500_000, 1024  # ids that one decoding query orders, and that one group of it holds

#: x is word << 28 | place << 20 | token. A word without a pair left is written once more as done, and not looked at again.
ENCODE_SQL = """
WITH RECURSIVE step(x, done) AS (
    SELECT x, false FROM token_rows
    UNION ALL
    (WITH beside AS MATERIALIZED (
        SELECT x, lag(x) OVER (ORDER BY x) AS x0 FROM step WHERE NOT done
     ), best AS (
        SELECT b.x >> 28 AS w, min(m.merged << 8 | (b.x0 >> 20 & 255)) AS least
        FROM beside b JOIN merges m ON m.pair = ((b.x0 & 1048575) << 20 | (b.x & 1048575)) WHERE b.x0 >> 28 = b.x >> 28 GROUP BY 1
     )
     SELECT CASE WHEN (b.x >> 20 & 255) = (best.least & 255) THEN (b.x >> 20 << 20) | (best.least >> 8) ELSE b.x END, best.w IS NULL
     FROM beside b LEFT JOIN best ON best.w = b.x >> 28
     WHERE best.w IS NULL OR b.x0 IS NULL OR b.x0 >> 28 <> b.x >> 28 OR (b.x0 >> 20 & 255) <> (best.least & 255))
)
SELECT x >> 28 AS w, (x & 1048575)::INTEGER AS tok FROM step WHERE done ORDER BY x
"""
DECODE_SQL = "SELECT d, string_agg(bytes, '' ORDER BY pos) AS text FROM id_rows JOIN vocab USING (tok) GROUP BY d ORDER BY d"


class Coder:
    """A worker's DuckDB connection, vocabulary and what it has encoded before."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.cut = by_pattern if pattern == public_tokenizers.PATTERN else whole
        single = np.zeros(256, np.int32)
        pair, merged = [], []
        for token, rank in self.ranks.items():
            if len(token) == 1:
                single[token[0]] = rank
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pair.append(left << 20 | right)
                    merged.append(rank)
        self.single = single
        self.tokens = pa.array(self.ranks, pa.large_binary())
        self.rank_of = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        self.width = np.zeros(self.rank_of.max() + 1, np.int64)
        self.width[self.rank_of] = pc.binary_length(self.tokens).to_numpy()
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "250MB"})
        self.db.register("m", pa.table({"pair": pa.array(pair, pa.int64()), "merged": pa.array(merged, pa.int64())}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")

    def by_heap(self, word: bytes) -> np.ndarray:
        """Contraction of one very long word: the pair of least rank, leftmost first."""
        tok: list = [int(self.single[b]) for b in word]
        part = [word[i : i + 1] for i in range(len(word))]
        after = list(range(1, len(tok))) + [-1]
        before = list(range(-1, len(tok) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(tok) - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if tok[i] is not None else -1
            if j < 0 or part[i] != a or part[j] != b:
                continue
            part[i], tok[i], tok[j], after[i] = a + b, r, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.ranks.get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return np.array([t for t in tok if t is not None], np.int32)

    def contracted(self, words: pa.Array) -> pa.Array:
        """The int32 ids of each pre-token, as binary: whole tokens by lookup, the others by the recursive query."""
        whole = pc.index_in(words, self.tokens)
        known = np.flatnonzero(whole.is_valid().to_numpy(zero_copy_only=False))
        size = pc.binary_length(words).to_numpy()
        short = whole.is_null().to_numpy(zero_copy_only=False) & (size <= LONG_WORD)
        long = np.flatnonzero(whole.is_null().to_numpy(zero_copy_only=False) & ~short)
        # Word numbers and ids of the three kinds of words, to be brought into the order of words.
        of, ids = [known], [self.rank_of[whole.drop_null().to_numpy()]]
        for i, word in zip(long.tolist(), words.take(pa.array(long)).to_pylist()):
            ids.append(self.by_heap(word))
            of.append(np.full(len(ids[-1]), i))
        left = np.flatnonzero(short)
        round_of = np.cumsum(size[left] * size[left]) // SLICE
        for part in np.split(left, np.flatnonzero(np.diff(round_of)) + 1) if len(left) else []:
            data, first = buffers(words.take(pa.array(part)))
            n = np.diff(first)
            place = np.arange(len(data)) - np.repeat(first[:-1], n)
            self.db.register("token_rows", pa.table({"x": np.repeat(np.arange(len(part)), n) << 28 | place << 20 | self.single[data]}))
            out = self.db.execute(ENCODE_SQL).fetchnumpy()
            of.append(part[np.asarray(out["w"])])
            ids.append(np.asarray(out["tok"], np.int32))
        of, ids = np.concatenate(of), np.concatenate(ids)
        order = np.argsort(of, kind="stable")
        return binary(ids[order], 4 * np.append(0, np.cumsum(np.bincount(of, minlength=len(words)))))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(int32 ids of all texts, offsets of each text's)."""
        cut = self.cut(texts)
        data, starts = buffers(cut.pieces)
        kind = CLASS[data]
        # What may hold several pre-tokens: pieces with other signs, or with letters behind an apostrophe.
        marks = np.append(np.flatnonzero(kind == OTHER), apostrophes(data, kind))
        odd = np.unique(np.searchsorted(starts, marks, "right") - 1) if self.cut is by_pattern else np.arange(len(cut.pieces))
        parts = [self.split(p.decode("utf-8", "surrogatepass")) for p in cut.pieces.take(pa.array(odd)).to_pylist()]
        number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in parts for w in ws))}
        plain = np.ones(len(cut.pieces), bool)
        plain[odd] = False
        words = pa.concat_arrays([cut.pieces.filter(pa.array(plain)).cast(pa.large_binary()), pa.array([w.encode("utf-8", "surrogatepass") for w in number], pa.large_binary())])
        ids = self.contracted(words)
        own, count = ids[: int(plain.sum())], len(words) - len(number)
        rest = ids[count:].to_pylist()
        several = pa.array([b"".join([rest[number[w]] for w in ws]) for ws in parts], pa.large_binary())
        place = np.empty(len(plain), np.int64)
        place[plain] = np.arange(count)
        place[odd] = count + np.arange(len(odd))
        flat, offsets = cut.joined(pa.concat_arrays([own, several]).take(pa.array(place)), 4)
        return flat.view(np.int32), offsets

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each of the id sequences ids[offsets[i] : offsets[i + 1]]."""
        out = []
        for at in range(0, len(ids), DECODE_IDS):
            tok = ids[at : at + DECODE_IDS]
            pos = np.arange(len(tok), dtype=np.int32)
            self.db.register("id_rows", pa.table({"d": pos // BLOCK, "pos": pos, "tok": tok}))
            out += [x.encode("latin-1") for x in self.db.execute(DECODE_SQL).fetchnumpy()["text"].tolist()]
        return binary(b"".join(out), np.append(0, np.cumsum(self.width[ids]))[offsets])


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids array<int>) of each row; with decoded, also the bytes that decode() gives for the ids, by the same worker."""
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            for a, b in chunks(lengths(batch.column(1)), CHUNK_BYTES):
                ids, offsets = c.encode(batch.column(1).slice(a, b - a))
                cols = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids))]
                if decoded:
                    cols.append(c.decode(ids, offsets).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; null ids give empty bytes."""
    names = [c for c in df.columns if c != out]
    schema = df.select(*names).schema.add(out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            column = batch.column(names.index(ids))
            lists = column if isinstance(column, pa.ListArray) else column.cast(pa.list_(pa.int32()))
            lists = lists.fill_null(pa.scalar([], lists.type)) if lists.null_count else lists
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int32)
            for a, b in chunks(np.diff(bounds).tolist(), DECODE_IDS):
                text = c.decode(flat[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(names))], text], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)

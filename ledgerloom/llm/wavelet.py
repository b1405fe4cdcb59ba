"""Token ids in wavelet-matrix shards.

write(): documents in ascending doc_id order (range partitions, sorted inside), tokenised, and every run of up to
SHARD_TOKENS ids turned into a wavelet matrix: one bit plane per bit of an id, most significant first, each with a
rank directory. A shard is one row of a zstd-compressed Parquet file in the shared folder, written by Spark, so that a
lost executor's shards are written again and half-written ones never show. read() rebuilds the ids from the planes;
WaveletMatrix answers access, rank, select, count and locate on one shard without rebuilding it.

Null texts hold only the end id; null doc_ids come first; rows that repeat a doc_id follow each other, by text. A very long
text is a shard of its own. Columns beside doc_id and text are not read, so their names cannot clash. An empty table makes
no shards and reads back as no rows. Ids are held in 16 bits: a vocabulary of more than 65,536 ids is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored, text_or_empty
from .pieces import lengths
from .tokens import encoder

SHARD_TOKENS = 1 << 20
CHUNK_BYTES = 4 << 20
BITS = 16
BLOCK = 512  # bits that one entry of a rank directory covers
SHARDS = "part int, shard int, base long, n_tokens long, doc_ids binary, nulls binary, lengths binary, zeros array<int>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Bit planes with rank/select over one shard's ids."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros, self.planes = n, zeros, planes
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = BITS) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        cur = ids
        for k in range(bits - 1, -1, -1):
            bit = (cur & np.uint16(1 << k)) != 0
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros(-(-len(packed) * 8 // BLOCK) * (BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32).tobytes())
            planes.append(packed.tobytes())
            low = np.flatnonzero(~bit)  # places: half the time of a mask, whose bits are as good as random
            zeros.append(len(low))
            cur = np.concatenate([cur.take(low), cur.take(np.flatnonzero(bit))])
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        part = self.planes[level][block * BLOCK // 8 : -(-i // 8)]
        held = int.from_bytes(part, "little") & ((1 << (i - block * BLOCK)) - 1)
        return int(self.ranks[level][block]) + held.bit_count()

    def access(self, i: int) -> int:
        out = 0
        for level, z in enumerate(self.zeros):
            bit = self.planes[level][i >> 3] >> (i & 7) & 1
            ones = self._ones(level, i)
            i = z + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        last = len(self.zeros) - 1
        for level, z in enumerate(self.zeros):
            a, b = self._ones(level, start), self._ones(level, end)
            start, end = (z + a, z + b) if token >> (last - level) & 1 else (start - a, end - b)
        return start, end

    def rank(self, token: int, i: int) -> int:
        """Occurrences before place i."""
        a, b = self._range(token, 0, i)
        return b - a

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) sign `bit` on a plane."""
        lo, hi = 0, len(self.ranks[level]) - 1
        before = lambda b: int(self.ranks[level][b]) if bit else b * BLOCK - int(self.ranks[level][b])
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid)
        part = np.unpackbits(np.frombuffer(self.planes[level][lo * BLOCK // 8 : (lo + 1) * BLOCK // 8], np.uint8), bitorder="little")
        return lo * BLOCK + int(np.flatnonzero(part == bit)[k - before(lo)])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i, last = a + k, len(self.zeros) - 1
        for level in range(last, -1, -1):
            i = self._select(level, 1, i - self.zeros[level]) if token >> (last - level) & 1 else self._select(level, 0, i)
        return i

    def locate(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the planes' stable partitions undone, lowest plane first."""
        cur = np.zeros(self.n, np.uint16)
        last = len(self.zeros) - 1
        for level in range(last, -1, -1):
            bit = np.unpackbits(np.frombuffer(self.planes[level], np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, np.uint16)
            out[np.flatnonzero(bit)] = cur[self.zeros[level] :] | np.uint16(1 << (last - level))
            out[np.flatnonzero(~bit)] = cur[: self.zeros[level]]
            cur = out
        return cur


def write(df: DataFrame, path: str, cut: str = "blank", end: int = 1) -> DataFrame:
    """Shards of the documents' ids, written to the shared folder; returns them as read from there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path, cut)
        docs: list[tuple] = []
        held: list[bytes] = []
        state = {"size": 0, "shard": 0, "base": 0}

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), np.uint16)
            m = WaveletMatrix.build(ids)
            names = np.array([d or 0 for d, _ in docs], np.int64).tobytes()
            nulls = np.array([d is None for d, _ in docs], np.bool_).tobytes()
            row = [part, state["shard"], state["base"], len(ids), names, nulls, np.array([n for _, n in docs], np.int64).tobytes(), m.zeros, m.planes, [r.tobytes() for r in m.ranks]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[c.split()[0] for c in SHARDS.split(", ")])
            state.update(size=0, shard=state["shard"] + 1, base=state["base"] + len(ids))
            docs.clear()
            held.clear()
            return out

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks(lengths(texts), CHUNK_BYTES):
                for d, x in zip(names[a:b], enc.encode(texts.slice(a, b - a), end)):
                    if docs and state["size"] + len(x) // 2 > SHARD_TOKENS:
                        yield shard()
                    docs.append((d, len(x) // 2))
                    held.append(x)
                    state["size"] += len(x) // 2
        if docs:
            yield shard()

    src = df.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    # A doc_id that many rows share, null among them, is dealt to several tasks by a hash of the text.
    placed = src.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return stored(placed.mapInArrow(run, SHARDS), "wavelet")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the shards; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["ranks"]).ids().astype("<u4")
                n = np.frombuffer(r["lengths"], np.int64)
                ends = np.cumsum(n)
                flat = pa.py_buffer(ids)
                column = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.concatenate([[0], ends]) * 4).astype(np.int32)), flat])
                docs = pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=np.frombuffer(r["nulls"], np.bool_))
                yield pa.RecordBatch.from_arrays([docs, pa.array(ends - n + r["base"] + r["part_start"]), pa.array(n), column], names=["doc_id", "start", "n_tokens", "ids"])

    # One row per partition of the writer, a few numbers each: that many rows are a safe broadcast at any size.
    return shards.join(F.broadcast(starts_of_parts(shards)), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def starts_of_parts(shards: DataFrame) -> DataFrame:
    """(part, part_start): ids before each of the writer's partitions, one row for each, a few numbers."""
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    return sizes.selectExpr("part", "sum(size) over (order by part rows between unbounded preceding and current row) - size as part_start")


def counted(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a stated list of ids stands in all shards, by rank on their planes; nothing is rebuilt."""
    tokens = list(dict.fromkeys(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["ranks"])
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    told = shards.select("n_tokens", "zeros", "planes", "ranks").mapInArrow(run, "token long, n long")
    asked = shards.sparkSession.createDataFrame([(t,) for t in tokens], "token long")
    return asked.join(told.groupBy("token").agg(F.sum("n").alias("n")), "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def located(shards: DataFrame, tokens: list[int], most: int = 65_536) -> DataFrame:
    """(token, doc_id, offset, place): every occurrence of a stated list of ids, by select; place counts all ids before it, offset those
    of its document. A task hands on at most `most` occurrences at once, however many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["ranks"])
                ids, nulls, ends = np.frombuffer(r["doc_ids"], np.int64), np.frombuffer(r["nulls"], np.bool_), np.cumsum(np.frombuffer(r["lengths"], np.int64))
                for t in dict.fromkeys(tokens):
                    for k in range(0, m.count(t), most):
                        at = np.array([m.select(t, i) for i in range(k, min(k + most, m.count(t)))], np.int64)
                        doc = np.searchsorted(ends, at, "right")
                        first = np.concatenate([[0], ends])[doc]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(ids[doc], mask=nulls[doc]), pa.array(at - first), pa.array(at + r["base"] + r["part_start"])], names=["token", "doc_id", "offset", "place"])

    return shards.join(F.broadcast(starts_of_parts(shards)), "part").mapInArrow(run, "token long, doc_id long, offset long, place long")

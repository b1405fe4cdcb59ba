"""Fingerprints of documents: a homomorphic hash of the multiset of their paragraphs.

A paragraph (a text's pieces between line feeds; an empty text has none) is hashed to a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors, coordinate by coordinate modulo a power of two. So the order of
paragraphs does not count, and inserting or deleting one adds or subtracts its vector: an edited text's fingerprint is
made from the old one and the paragraphs that changed, without reading the rest.

The vector has two parts. EXACT coordinates modulo 2^64 are the SHAKE-256 output of the paragraph: fingerprints are equal
for equal multisets, and for others only if 2,048 bits happen to agree. SHAPE coordinates modulo 2^32 tell how alike two
multisets are: every byte gram of the paragraph adds +1 or -1 to one coordinate, so that the product of two documents'
shapes estimates, without bias, how many grams they share. Likeness is the cosine of the shapes, each coordinate held to
CLIP times the median one, so that a gram that one text repeats very often counts in one coordinate and not for all
(standard error about 1/sqrt(SHAPE), 0.06). Equal fingerprints have likeness 1.

`with_next` compares each document with the one that follows it. Splitters sampled by a hash of the id deal the documents
out by (doc_id, hash of text) in one shuffle; the first document of a share also goes to the share before it. A task reads
its share in order and holds one batch of texts. The driver gets SAMPLES ids a task.

Defined cases. Null text: empty. Empty text: all coordinates 0; its likeness to another text is 0, to an empty one 1. Very
long texts: hashed in slices of CHUNK bytes. Null ids come first. Documents that share an id follow each other by a hash
of their texts; rows equal in both count as one document and are all returned. A single document follows itself. Empty
tables: no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .minhash import mix

EXACT, SHAPE = 32, 256
#: Paragraphs shorter than so many bytes have grams of so many; one that is shorter than its gram is a gram itself.
GRAMS = ((16, 2), (64, 4), (1 << 62, 12))
CHUNK = 1 << 19
#: Documents that a task reads, about; ids that are sampled for each task's share.
TASK_ROWS, SAMPLES = 50_000, 20
#: In a likeness, no coordinate is larger than so many times the median of those that are not 0.
CLIP = 3
#: Of the edited text: one in so many code points, at the end, is replaced.
EDITED = 4
BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def paragraphs(text: str) -> list[bytes]:
    """The pieces of a text between line feeds."""
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def _gram(size: int) -> int:
    return next(g for below, g in GRAMS if size < below)


def _slices(pieces: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, sign, gram, bytes): long paragraphs in slices that overlap by what a gram reaches over."""
    for row, sign, p in pieces:
        g = _gram(len(p))
        for i in range(0, max(1, len(p) - g + 1), CHUNK):
            yield row, sign, g, p[i : i + CHUNK + g - 1]


def _shapes(out: np.ndarray, units: list[tuple[int, int, int, bytes]]) -> None:
    """Adds the grams of slices to the rows of out, an int64 array."""
    size = np.array([len(u[3]) for u in units])
    gram = np.array([u[2] for u in units])
    start = np.cumsum(size) - size
    b = np.frombuffer(b"".join([u[3] for u in units]) + bytes(12), np.uint8).astype(np.uint64) + U(1)
    n = len(b) - 12
    power = [U(pow(int(BASE), k, 1 << 64)) for k in (1, 2, 4)]
    h2 = b[:-1] * power[0] + b[1:]
    h4 = h2[:-2] * power[1] + h2[2:]
    h8 = h4[:-4] * power[2] + h4[4:]
    rolling = {2: h2, 4: h4, 12: h8[: n + 1] * power[2] + h4[8 : n + 9]}
    row, sign = np.array([u[0] for u in units]), np.array([u[1] for u in units])
    for g, h in rolling.items():
        used = np.flatnonzero((gram == g) & (size >= g))
        count = size[used] - g + 1
        total = int(count.sum())
        if not total:
            continue
        at = np.repeat(start[used] - (np.cumsum(count) - count), count) + np.arange(total)
        _throw(out, mix(h[at], g), np.repeat(row[used], count), np.repeat(sign[used], count))
    short = np.flatnonzero(size < gram)
    if len(short):
        keys = np.array([b[start[i]] if size[i] else U(0) for i in short.tolist()], np.uint64)
        _throw(out, mix(keys, 1), row[short], sign[short])


def _throw(out: np.ndarray, keys: np.ndarray, row: np.ndarray, sign: np.ndarray) -> None:
    weight = np.where(keys & U(1), sign, -sign)
    lane = (keys >> U(56)).astype(np.int64)
    first, last = int(row.min()), int(row.max())
    found = np.bincount((row - first) * SHAPE + lane, weights=weight, minlength=(last - first + 1) * SHAPE)
    out[first : last + 1] += found.reshape(-1, SHAPE).astype(np.int64)


def sums(n: int, pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The EXACT and SHAPE parts of n rows: the vectors of (row, +1 or -1, paragraph), in order of rows, added up."""
    exact, shape = np.zeros((n, EXACT), np.uint64), np.zeros((n, SHAPE), np.int64)
    held: list[tuple[int, int, int, bytes]] = []
    held_bytes = 0
    for i in range(0, len(pieces), 4096):
        part = pieces[i : i + 4096]
        wide = np.frombuffer(b"".join([hashlib.shake_256(p).digest(8 * EXACT) for _, _, p in part]), "<u8").reshape(-1, EXACT)
        rows, signs = np.array([r for r, _, _ in part]), np.array([s for _, s, _ in part])
        wide = np.where(signs[:, None] > 0, wide, U(0) - wide)
        heads = np.flatnonzero(np.diff(rows, prepend=-1))
        exact[rows[heads]] += np.add.reduceat(wide, heads, 0)
    for unit in _slices(pieces):
        held.append(unit)
        held_bytes += len(unit[3]) + 1
        if held_bytes > CHUNK:
            _shapes(shape, held)
            held, held_bytes = [], 0
    if held:
        _shapes(shape, held)
    return exact, shape


def written(exact: np.ndarray, shape: np.ndarray) -> list[str]:
    """Fingerprints as text: the little-endian coordinates in base 64."""
    low = shape.astype(np.uint32)  # modulo 2^32
    return [base64.b64encode(e.astype("<u8").tobytes() + s.astype("<u4").tobytes()).decode() for e, s in zip(exact, low)]


def parts_of(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT], "<u8").copy(), np.frombuffer(raw[8 * EXACT :], "<u4").copy()


def _held(shape: np.ndarray) -> np.ndarray:
    size = np.sort(np.abs(shape), 1)
    zeros = (size == 0).sum(1)
    middle = size[np.arange(len(size)), np.minimum((zeros + SHAPE) // 2, SHAPE - 1)]
    return np.clip(shape, -CLIP * middle[:, None], CLIP * middle[:, None])


def likeness(exact: np.ndarray, shape: np.ndarray, other_exact: np.ndarray, other_shape: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1."""
    a, b = (s.astype(np.uint32).view(np.int32).astype(np.float64) for s in (shape, other_shape))
    same = (exact == other_exact).all(1) & (a == b).all(1)
    a, b = _held(a), _held(b)
    norms = np.sqrt((a * a).sum(1) * (b * b).sum(1))
    cosine = (a * b).sum(1) / np.where(norms > 0, norms, 1)
    return np.where(same, 1.0, np.clip(cosine, 0, 1))


def changed(fingerprint: str, deleted: Iterable[bytes] = (), inserted: Iterable[bytes] = ()) -> str:
    """The fingerprint after paragraphs were deleted from and inserted into its text, wherever they stand."""
    exact, shape = parts_of(fingerprint)
    de, ds = sums(1, [*[(0, -1, p) for p in deleted], *[(0, 1, p) for p in inserted]])
    return written(exact[None] + de, shape[None].astype(np.int64) + ds)[0]


def edited(text: str, following: str, share: int = EDITED) -> tuple[str, list[bytes], list[bytes]]:
    """(text whose last code points are the following one's first, paragraphs deleted, paragraphs inserted)."""
    last = len(text) // share
    if not last:
        return text, [], []
    end = len(text) - last
    new = text[:end] + following[:last]
    first = text.rfind("\n", 0, end) + 1  # what stands before is untouched
    return new, text[first:].encode("utf-8", "surrogatepass").split(b"\n"), new[first:].encode("utf-8", "surrogatepass").split(b"\n")


def fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of whole texts, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_chunks(batch, 1):
                pieces = [(i, 1, p) for i, t in enumerate(part.column(1).to_pylist()) for p in paragraphs(t)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(written(*sums(part.num_rows, pieces)), pa.string())], names=["doc_id", "fingerprint"])

    return df.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _in_chunks(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about CHUNK bytes of text."""
    size = np.cumsum(pa.compute.binary_length(batch.column(col)).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK
    ends = [*np.flatnonzero(np.diff(size)).tolist(), batch.num_rows - 1]
    at = 0
    for end in ends:
        if end >= at:
            yield batch.slice(at, end + 1 - at)
            at = end + 1


def shares(docs: DataFrame, least: int) -> tuple[DataFrame, int]:
    """docs (key, h, ...) with share and ahead, and the number of shares: ranges of (key, h), the first document of each also ahead
    of the share before, the first of all ahead of the last."""
    n = docs.count()
    tasks = max(least, -(-n // TASK_ROWS))
    per_mille = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < (min(1.0, SAMPLES * tasks / max(n, 1)) * (1 << 20))
    sample = sorted((r["key"], r["h"]) for r in docs.where(per_mille).select("key", "h").distinct().toLocalIterator())
    first = docs.agg(F.min(F.struct("key", "h")).alias("f")).first()["f"]
    if first is None:
        return docs.withColumns({"share": F.lit(0), "ahead": F.lit(False)}), 1
    step = max(1, len(sample) / tasks)
    starts = sorted({(first["key"], first["h"]), *[sample[int(i * step)] for i in range(1, tasks) if i * step < len(sample)]})
    m = len(starts)
    keys, hashes = np.array([s[0] for s in starts], np.int64), np.array([s[1] for s in starts], np.int64)

    @F.pandas_udf("long")
    def place(key: pd.Series, h: pd.Series) -> pd.Series:
        """Twice the share, and one more for the first document of a share."""
        k, x = key.to_numpy(np.int64), h.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        at = hi - 1
        for i in np.flatnonzero(hi > lo).tolist():  # ids that starts have too: their hashes decide
            at[i] = lo[i] + np.searchsorted(hashes[lo[i] : hi[i]], x[i], "right") - 1
        return pd.Series(2 * at + ((keys[at] == k) & (hashes[at] == x)))

    own = F.shiftright("at", 1).cast("int")
    here = F.struct(own.alias("share"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(own - 1, F.lit(m)).cast("int").alias("share"), F.lit(True).alias("ahead"))
    placed = docs.withColumn("at", place("key", "h"))
    placed = placed.withColumn("to", F.explode(F.when(F.col("at") % 2 == 1, F.array(here, before)).otherwise(F.array(here))))
    return placed.select(*docs.columns, "to.*"), m


def with_next(df: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    text = text_or_empty()
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    docs = df.select(F.col("doc_id").cast("long"), key.alias("key"), F.xxhash64(text).alias("h"), text.alias("text"))
    dealt, m = shares(docs, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def compared(rows: list[list], following: list[list]) -> Iterator[pa.RecordBatch]:
        n = len(rows)
        pieces = [(i, 1, p) for i, r in enumerate([*rows, following[-1]]) for p in paragraphs(r[1])]
        made = [edited(r[1], f[1]) for r, f in zip(rows, following)]
        exact, shape = sums(n + 1, pieces)
        de, ds = sums(n, [(i, s, p) for i, e in enumerate(made) for s, ps in ((-1, e[1]), (1, e[2])) for p in ps])
        new = exact[:n] + de, shape[:n] + ds
        out = pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([e[0] for e in made], pa.string()),
             pa.array(written(exact[:n], shape[:n]), pa.string()), pa.array(written(*new), pa.string()), pa.array(likeness(exact[:n], shape[:n], *new)), pa.array(likeness(exact[:n], shape[:n], exact[1:], shape[1:]))],
            names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )
        yield out
        for i, r in enumerate(rows):  # rows that are one document
            for _ in range(r[2] - 1):
                yield out.slice(i, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # [doc_id, text, times], the last one's next not known yet
        at, size = None, 0
        for batch in batches:
            for part in _in_chunks(batch, 3):
                for id_, key, h, text, ahead in zip(*[c.to_pylist() for c in part.columns]):
                    if (key, h, ahead) == at:
                        held[-1][2] += 1
                        continue
                    at = key, h, ahead
                    held.append([id_, text, 1])
                    size += len(text)
                    if size > CHUNK and len(held) > 1:
                        yield from compared(held[:-1], held[1:])
                        held, size = held[-1:], len(text)
        if len(held) > 1:
            yield from compared(held[:-1], held[1:])

    ordered = dealt.select("doc_id", "key", "h", "text", "share", "ahead").repartitionById(m, F.col("share")).sortWithinPartitions("ahead", "key", "h")
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("doc_id", "key", "h", "text", "ahead").mapInArrow(run, schema)

"""Whitening of vectors from an exact integer scatter.

Entries become integers x = floor(SCALE * c) + OFFSET. A shift is subtracted, and sums S and cross-products X'X of the shifted
integers are kept as Python's integers, which know no overflow. From them n X'X - S S' is formed exactly, the same for every
shift and every order of adding; only then is it divided by n^2, as a float, and decomposed by eigh. Components are numbered
by falling eigenvalue.

A task adds up batches through products of limbs of LIMB bits: floats hold such sums exactly while a batch has at most
BATCH_ROWS rows, so the multiplication runs in BLAS. What tasks found meets in two steps of rows (dimension, sums), salted
first, so that no task holds more than its dimensions' sums; the driver gets a row a dimension. Nothing is broadcast but
the fitted frame, d times k numbers. The check of the whitened values, their covariance against the identity, is taken by
covar_pop over all rows, which centres before it multiplies.

Defined cases. Rows whose vector is null or holds null or non-finite entries go, as do rows with an entry whose x is no long,
and rows of another length than the most frequent one (ties: the longer). Empty tables and empty vectors: no rows. A
component without variance (eigenvalue under RANK of the trace) has null as its whitened values and does not count in the
identity error. Ties between eigenvalues: eigh's order. Null and repeated ids, repeated rows: each row counts and is
returned. A deviation that no decimal(38) holds is null. Other columns are handed on by `whiten`, except
ones named as its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LIMB, BATCH_ROWS = 20, 4096
#: Partial sums of one dimension are first added up in so many shares.
SHARES = 32
RANK = 1e-13
SUMS = "i int, n string, sums array<string>"
FITS = float(2**63 - 2 * OFFSET)  # of |SCALE * c|: beyond, x is no long


@dataclass(frozen=True)
class Frame:
    """What was fitted: n, the exact sums, all eigenvalues by falling size, their vectors by row, the trace of V."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def usable(self, k: int) -> bool:
        return bool(self.values[k] > RANK * self.trace)


def usable(vectors: DataFrame, col: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that take part, and their length; 0 where there are none."""
    sound = F.col(col).isNotNull() & F.forall(col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < FITS), F.lit(False)))
    rows = vectors.where(sound)
    common = rows.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return rows.where(F.size(col) == d), d


def integers(column: pa.Array, d: int) -> np.ndarray:
    """x of a column of vectors, a row each."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.reshape(-1, d)).astype(np.int64) + OFFSET


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column sums and X'X of int64 rows, exactly, as arrays of Python's integers."""
    d = x.shape[1]
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    for i in range(0, len(x), BATCH_ROWS):
        rest, limbs = x[i : i + BATCH_ROWS], []
        while True:  # the lower limbs are of LIMB bits, the last one has the sign
            if len(limbs) == 3 or not len(rest) or max(abs(int(rest.min())), abs(int(rest.max()))) < 1 << LIMB:
                limbs.append(rest)
                break
            limbs.append(rest & ((1 << LIMB) - 1))
            rest = rest >> LIMB
        floats = [v.astype(np.float64) for v in limbs]
        for a, u in enumerate(floats):
            sums += (limbs[a].sum(0)).astype(object) << (LIMB * a)
            for b, v in enumerate(floats):
                cross += (u.T @ v).astype(np.int64).astype(object) << (LIMB * (a + b))
    return sums, cross


def _partials(rows: DataFrame, col: str, d: int, shift: int) -> DataFrame:
    """(i, n, sums): of each task, for each dimension i, its row of X'X and behind it the sum of x_i, as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = integers(batch.column(0), d) - shift
            s, c = scatter(x)
            n, sums, cross = n + len(x), sums + s, cross + c
        if n:
            yield _rows({i: [n, *cross[i], sums[i]] for i in range(d)})

    return rows.select(col).mapInArrow(run, SUMS)


def _rows(held: dict[int, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([str(v[0]) for v in held.values()]), pa.array([[str(x) for x in v[1:]] for v in held.values()], pa.list_(pa.string()))], names=["i", "n", "sums"])


def _added(parts: DataFrame, *keys: str) -> DataFrame:
    """The rows of each dimension in a task added up; a task holds one row a dimension, whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            for i, n, sums in zip(*[batch.column(c).to_pylist() for c in ("i", "n", "sums")]):
                new = [int(n), *map(int, sums)]
                held[i] = [a + b for a, b in zip(held[i], new)] if i in held else new
        if held:
            yield _rows(held)

    return parts.repartition(*keys).mapInArrow(run, SUMS)


def fit(rows: DataFrame, d: int, col: str = "embedding", shift: int = OFFSET) -> Frame | None:
    """The frame of all rows; None without any. shift moves the integers that are multiplied, never the result."""
    if not d:
        return None
    if not 0 <= shift <= 2 * OFFSET:
        raise ValueError("a shift between 0 and 2 * OFFSET keeps every x a long")
    parts = _partials(rows, col, d, shift).withColumn("share", F.spark_partition_id() % SHARES)
    total = {r["i"]: [int(r["n"]), *map(int, r["sums"])] for r in _added(_added(parts, "i", "share"), "i").collect()}  # d rows
    if not total:
        return None
    n = total[0][0]
    sums = [total[i][-1] for i in range(d)]
    # Integers divided once each: every entry of V is the float nearest to the exact one.
    v = np.array([[(n * total[i][1 + j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)], np.float64)
    values, vectors = np.linalg.eigh(v)
    return Frame(n, tuple(s + n * shift for s in sums), values[::-1].copy(), vectors[:, ::-1].T.copy(), float(np.trace(v)))


def whiten(rows: DataFrame, frame: Frame, d: int, col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """rows with deviation, decimal text of the exact sum over dimensions of (n x - S)^2, and whitened, an array of doubles (null
    where a component has no variance)."""
    k = min(components, d)
    n, sums = frame.n, np.array(frame.sums, object)
    scale = np.array([1 / np.sqrt(frame.values[j]) if frame.usable(j) else np.nan for j in range(k)])
    onto = (frame.vectors[:k] * scale[:, None]).T
    rest = [c for c in rows.columns if c.lower() not in ("deviation", "whitened")]
    asked = rows.select(F.struct(*rest).alias("row"), F.col(col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                x = integers(part.column(1), d)
                far = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, frame.sums))
                away = n * x - sums.astype(np.int64) if far < 2**62 else n * x.astype(object) - sums
                most = int(np.abs(away).max())
                exact = (away * away).sum(1) if most * most * d < 2**63 else (away.astype(object) ** 2).sum(1)
                # n x - S is exact; one division by n, then the projection in doubles.
                white = (away / n).astype(np.float64) @ onto
                values = pa.array(white.ravel(), pa.float64(), mask=np.isnan(white.ravel()))
                ends = pa.array(np.arange(0, white.size + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(int(e)) for e in exact]), pa.ListArray.from_arrays(ends, values)], names=["row", "deviation", "whitened"])

    schema = f"row {asked.schema['row'].dataType.simpleString()}, deviation string, whitened array<double>"
    return asked.mapInArrow(run, schema).select("row.*", "deviation", "whitened")


def identity_error(white: DataFrame, frame: Frame, components: int) -> float | None:
    """The largest absolute entry of the whitened values' covariance minus the identity, over all rows; one row reaches the driver."""
    used = [j for j in range(components) if frame.usable(j)]
    if not used:
        return None
    pairs = [(a, b) for a in used for b in used if a <= b]
    found = white.select(*[F.col("whitened")[j].alias(f"w{j}") for j in used]).agg(*[F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs))


def components_of(vectors: DataFrame, col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part and component: the vectors' columns, component, n, deviation decimal(38), whitened, explained
    and identity_error, which is the same in all rows."""
    rows, d = usable(vectors, col)
    frame = fit(rows, d, col)
    shape = [c for c in vectors.columns if c not in (col, "component", "n", "deviation", "whitened", "explained", "identity_error")]
    if frame is None:
        none = {"component": "int", "n": "long", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}
        return vectors.where("false").select(*shape, *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    k = min(components, d)
    white = stored(whiten(rows.select(*shape, col), frame, d, col, k).drop(col), "whitened")
    error = identity_error(white, frame, k)
    explained = F.array(*[F.lit(float(frame.values[j] / frame.trace) if frame.trace > 0 else 0.0) for j in range(k)])
    out = white.select(*shape, F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        *shape, (F.col("at") + 1).alias("component"), F.lit(frame.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )

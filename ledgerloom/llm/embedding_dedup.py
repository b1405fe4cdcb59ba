"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

Rotations that balance binary codes are learnt on a bounded sample (SAMPLE vectors). All vectors are indexed: each
rotation's code is cut into substrings, a table for each. Vectors that share a substring meet in a bucket with CODE_BITS
of their codes, where the Hamming distance rejects those that cannot reach the threshold; a bucket sends on
edges that span the rest, no list of pairs. Connected vectors are a family. Each vector travels to its family once, and
there the original vectors decide in double precision: counts and a spanning forest. Buckets and families over a block's
size are dealt as pairs of blocks, every pair of blocks once. Equal vectors are one weighted row throughout.

Vectors that are null, empty, zero, or hold null or non-finite parts, link with nothing. Lengths may differ: only
equal lengths are compared. A repeated vec_id counts as one more vector. Ties go to the least vec_id. Other columns are
not read, so their names cannot clash. An empty table gives no rows. Very long vectors (many dimensions) are compared whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

SAMPLE = 4096
TABLES = 16  # at least; rotations are added until planted pairs at the threshold meet with RECALL
RECALL = 0.93
SUBSTRING = 16  # bits, for up to 2^12 vectors; a bit more for each doubling, so that chance meetings grow with n, not n^2
SPARE = 4  # bits more than number the vectors: keys are cheap beside vectors that meet by chance
CODE_BITS = 256  # of a code that travels with a vector's substrings, 32 bytes whatever the number of tables
LEARNT = 4  # rotations that the sample teaches; further ones are random, so that each finds other pairs
BLOCK = 2000  # vectors of a family that are compared at once
BUCKET = 10_000  # codes of a bucket that are compared at once
DEVIATIONS = 6  # Hamming distances up to so many standard deviations over the mean of pairs planted at the threshold pass


def itq(x: np.ndarray, seed: int, rounds: int = 25) -> np.ndarray:
    """A matrix (d, d): principal directions, then the rotation that iterative quantisation finds from a random start."""
    rng = np.random.default_rng(seed)
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    w = np.eye(x.shape[1])
    w[:, : len(vt)] = vt.T
    v = x @ w
    r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, t = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ t).T
    return w @ r


def keys_of(x: np.ndarray, rotations: list[np.ndarray], width: int) -> np.ndarray:
    """(n, tables) substrings of `width` bits of the codes, as uint32."""
    out = []
    for r in rotations:
        bits = (x @ r > 0).astype(np.uint32)
        for at in range(0, max(1, bits.shape[1] - width + 1), width):
            part = bits[:, at : at + width]
            out.append((part << np.arange(part.shape[1], dtype=np.uint32)).sum(1, dtype=np.uint32))
    return np.stack(out, axis=1)


def codes_of(x: np.ndarray, rotations: list[np.ndarray], bits: int = CODE_BITS) -> np.ndarray:
    """(n, words) the first `bits` of the codes of all rotations, as uint64: the same number however many tables there are."""
    used = rotations[: -(-bits // x.shape[1])]
    packed = np.packbits(np.concatenate([x @ r > 0 for r in used], axis=1)[:, :bits], axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def planted(s: np.ndarray, cosine: float, seed: int = 0) -> np.ndarray:
    """A neighbour at exactly `cosine` of each unit vector: of every second one in a random direction, else towards another vector."""
    rng = np.random.default_rng(seed)
    way = rng.standard_normal(s.shape)
    way[1::2] = way[1::2] * 1e-3 + s[rng.permutation(len(s))][1::2]
    way -= (way * s).sum(1, keepdims=True) * s
    way /= np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-12)
    return cosine * s + np.sqrt(max(0.0, 1 - cosine * cosine)) * way


def rotations_for(s: np.ndarray, width: int, threshold: float, learnt: int = LEARNT) -> list[np.ndarray]:
    """Rotations for substrings of `width` bits, as many as bring pairs at the threshold together with RECALL: a wider substring gets more.

    Those who are learnt from are not planted beside: a rotation suits its own sample better than other vectors."""
    d = s.shape[1]
    s, held = (s[::2], s[1::2]) if len(s) > 1 else (s, s)
    x = held[np.arange(SAMPLE) % len(held)]
    y = planted(x, threshold)
    met, tables, out = np.zeros(len(x), bool), 0, []
    while tables < TABLES or min(met[::2].mean(), met[1::2].mean()) < RECALL:
        seed = len(out)
        out.append(itq(s, seed) if seed < learnt else np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0])
        same = keys_of(x, out[-1:], width) == keys_of(y, out[-1:], width)
        met |= same.any(1)
        tables += same.shape[1]
    return out


def limit_for(s: np.ndarray, rotations: list[np.ndarray], threshold: float) -> int:
    """The largest Hamming distance of codes that still counts as near."""
    far = np.bitwise_count(codes_of(s, rotations) ^ codes_of(planted(s, threshold, seed=1), rotations)).sum(1)
    return int(np.ceil(far.mean() + DEVIATIONS * max(1.0, far.std())))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span what the edges a-b join."""
    up = list(range(n))
    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[max(i, j)] = min(i, j)
            out.append((i, j))
    return out


def starts_of(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    key = pdf[keys].to_numpy()
    return np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1) if len(pdf) else np.array([0])


def by_group(keys: list[str], work):
    """For mapInPandas over rows sorted by keys: work(pdf, bounds) on whole groups; a group may run over from one batch to the next."""

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            bounds = starts_of(pdf, keys)
            held = pdf.iloc[bounds[-1] :]
            yield from work(pdf, bounds)
        if held is not None and len(held):
            held = held.reset_index(drop=True)
            yield from work(held, np.array([0, len(held)]))

    return run


def near_codes(pdf: pd.DataFrame, bounds: np.ndarray, limit):
    """Edges (a, b) that span what Hamming distances up to limit(d) join in the buckets that end within bounds: those of two rows all at once."""
    size, first = np.diff(bounds), bounds[:-1]
    rep, own, code, length = (pdf[c].to_numpy() for c in ("rep", "own", "code", "d"))
    left_block, right_block = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    two = first[size == 2]
    two = two[(left_block[two] == right_block[two]) | (own[two] != own[two + 1])]
    for d in np.unique(length[two]).tolist():
        p = two[length[two] == d]
        x, y = (np.frombuffer(b"".join(code[q]), np.uint64).reshape(len(q), -1) for q in (p, p + 1))
        p = p[np.bitwise_count(x ^ y).sum(1) <= limit(d)]
        a.append(p)
        b.append(p + 1)
    for s, e in zip(first[size > 2].tolist(), bounds[1:][size > 2].tolist()):
        x, most = np.frombuffer(b"".join(code[s:e]), np.uint64).reshape(e - s, -1), limit(int(length[s]))
        left = np.flatnonzero(own[s:e] == left_block[s])
        right = left if left_block[s] == right_block[s] else np.flatnonzero(own[s:e] == right_block[s])
        label = np.arange(e - s)
        for p in left.tolist():
            q = right[label[right] != label[p]]
            if not len(q):
                continue
            q = q[np.bitwise_count(x[q] ^ x[p]).sum(1) <= most]
            for c in np.unique(label[q]).tolist():
                a.append(np.array([s + p]))
                b.append(np.array([s + int(q[label[q] == c][0])]))
            label[np.isin(label, label[q])] = label[p]
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a):
        yield pd.DataFrame({"a": np.minimum(rep[a], rep[b]), "b": np.maximum(rep[a], rep[b])})


def compared(pdf: pd.DataFrame, bounds: np.ndarray, threshold: float):
    """Counts (a, n) and spanning edges (a, b) of the families' blocks that end within bounds."""
    rep, w, own, unit = (pdf[c].to_numpy() for c in ("rep", "w", "own", "unit"))
    left_block, right_block = pdf["i"].to_numpy(), pdf["j"].to_numpy()
    count, edges = np.zeros(len(pdf), np.int64), []
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        x = np.frombuffer(b"".join(unit[s:e]), float).reshape(e - s, -1)
        left = np.flatnonzero(own[s:e] == left_block[s])
        right = left if left_block[s] == right_block[s] else np.flatnonzero(own[s:e] == right_block[s])
        linked = x[left] @ x[right].T >= threshold
        if left is right:
            linked &= np.tri(len(left), k=-1, dtype=bool)
        a, b = np.nonzero(linked)
        if len(a):
            np.add.at(count, s + left[a], w[s + right[b]])
            np.add.at(count, s + right[b], w[s + left[a]])
            edges += [(s + i, s + j) for i, j in forest(e - s, left[a], right[b])]
    at = np.flatnonzero(count)
    if len(at):
        a, b = np.array(edges, np.int64).T
        yield pd.DataFrame({"a": np.append(rep[at], rep[a]), "b": np.append(np.zeros(len(at), np.int64), rep[b]), "n": np.append(count[at], np.zeros(len(a), np.int64))})


def dealt(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    """Rows (group, rep, n: rows of the group, ...) once for each pair (i, j) of blocks that their own block is part of, sorted by these."""
    rows = rows.withColumn("parts", F.ceil(F.col("n") / most).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return rows.drop("n", "parts", "other").repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j")


def near(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", width: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row. width: bits of a substring, from the number of vectors if not given."""
    src = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    top = F.aggregate("x", F.lit(0.0), lambda acc, v: F.greatest(acc, F.abs(v)))
    whole = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & whole & (top > 0), F.lit(False))
    marked = src.withColumn("good", good).withColumn("x", F.when(F.col("good"), F.col("x"))).withColumn("h", F.xxhash64("x", F.size("x")))
    classes = stored(marked.where("good").groupBy("h", "x").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "vectors")

    n = max(1, classes.count())
    width = width or min(32, max(SUBSTRING, (n - 1).bit_length() + SPARE))
    by_size: dict[int, list[np.ndarray]] = {}
    rows = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("x").collect()  # bounded sample
    for r in rows:
        by_size.setdefault(len(r[0]), []).append(np.array(r[0]) / np.abs(r[0]).max())
    learnt: dict[int, tuple[list[np.ndarray], int]] = {}
    for d, sample in by_size.items():
        s = np.array(sample)
        s /= np.linalg.norm(s, axis=1)[:, None]
        turns = rotations_for(s, width, threshold)
        learnt[d] = turns, limit_for(s, turns, threshold)

    def index_of(d):
        if d not in learnt:  # no vector of this length is in the sample
            s = np.random.default_rng(d).standard_normal((SAMPLE, d))
            s /= np.linalg.norm(s, axis=1)[:, None]
            turns = rotations_for(s, width, threshold, learnt=0)
            learnt[d] = turns, limit_for(s, turns, threshold)
        return learnt[d]

    def index(batches):
        for pdf in batches:
            for d, part in pdf.groupby(pdf["x"].map(len)):
                x = np.array(part["x"].tolist(), float)
                x /= np.abs(x).max(1)[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                turns, _ = index_of(d)
                yield pd.DataFrame({
                    "rep": part["rep"], "w": part["w"], "d": d, "unit": [v.tobytes() for v in x],
                    "code": [v.tobytes() for v in codes_of(x, turns)], "each": [v.view(np.int32).tolist() for v in keys_of(x, turns, width)],
                })

    coded = stored(classes.select("rep", "w", "x").mapInPandas(index, "rep long, w long, d int, unit binary, code binary, each array<int>"), "coded")
    entries = coded.select("rep", "d", F.posexplode("each").alias("t", "k"))
    full = entries.groupBy("d", "t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(full, ["d", "t", "k"]).join(coded.select("rep", "code"), "rep")
    bucket = ["d", "t", "k"]
    near_ = by_group([*bucket, "i", "j"], lambda pdf, bounds: near_codes(pdf, bounds, lambda d: index_of(d)[1]))
    edges = stored(dealt(met, bucket, BUCKET).mapInPandas(near_, "a long, b long").distinct(), "near")

    comps = components(edges, "a", "b")
    family = stored(comps.unionByName(comps.select(F.col("component").alias("node"), "component").distinct()).select(F.col("node").alias("rep"), F.col("component").alias("g")), "families")
    sizes = family.groupBy("g").agg(F.count("*").alias("n"))
    members = family.join(sizes, "g").join(coded.select("rep", "w", "unit"), "rep")
    found = stored(dealt(members, ["g"], BLOCK).mapInPandas(by_group(["g", "i", "j"], lambda pdf, bounds: compared(pdf, bounds, threshold)), "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = components(found.where("n = 0"), "a", "b")
    labelled = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "h", "x", F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")
    )
    out = marked.join(labelled, ["h", "x"], "left")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").cast("long").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))

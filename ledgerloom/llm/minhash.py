"""Near-duplicate documents: fast similarity sketching, banding, exact verification on full shingle sets.

A sketch has T coordinates. Round i throws every shingle into a bin; the least value of the first round that reaches
a bin stays. Rounds T to 2T-1 throw all shingles into one bin each, so every coordinate fills. Documents that agree on
a band of coordinates are candidates; equal sets are one row from the start. Candidates are never spelt out as pairs:

1. stars: each bucket's least document is compared with the bucket's others on full sets, which joins nearly all copies;
2. doubt: in buckets that still hold several components, sketches tell which members come near the threshold (an
   estimate up to ESTIMATE below it, over four standard deviations) of a member of another component. A bucket sends on
   those members and which components they may join, no pairs;
3. families, the components that doubt connects, are compared on full sets in one place: each member in doubt travels
   there once, and is compared with all members of other components.

Groups are dealt to blocks, and a task compares two of them: blocks of rows that ask with each other and with those of rows
that only answer. Members of the largest component of a group never ask, so a group of very many copies costs its size,
not its square. Words are hashed under a key that each run draws, so texts cannot be built to look equal.

Null or blank texts have no shingles and link with nothing. Texts of one to four words are one shingle. Very long texts
are one set each. Repeated rows keep their rows and share their component, ties go to the least doc_id. Other columns
are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_batches, stored, text_or_empty
from .components import components

WIDTH = 5
T, BANDS = 128, 32
ESTIMATE = 0.18
#: Up to this many rows of a few numbers may be broadcast to pick out texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
BLOCK = 10_000  # rows of a block of a bucket; a task compares two blocks
PART_SHINGLES = 2_000_000  # shingles of a block, 8 bytes each; a task compares two blocks
CHUNK_CHARS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64
GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the 0, 1, ... n-1, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(1 << (n - 1).bit_length(), BASE, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p)
    return _POWERS[:n]


_NEGATIVE = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _NEGATIVE
    if len(_NEGATIVE) < n:
        p = np.full(1 << (n - 1).bit_length(), U(pow(int(BASE), -1, 1 << 64)), np.uint64)
        p[0] = 1
        _NEGATIVE = np.cumprod(p)
    return _NEGATIVE[:n]


#: Words up to so many bytes are hashed by multiplication with KEYS of their positions, longer ones by keyed BLAKE2.
LONG = 1024


class Words:
    """Keyed 64-bit hashes of words. Bytes times random keys of their positions, summed modulo 2^64: two given words agree with
    probability 2^-57 at most, whatever they are, and nobody can build a pair that does without the key."""

    def __init__(self, key: int):
        self.key = key.to_bytes(8, "little")
        self.keys = np.random.Generator(np.random.Philox(key)).integers(0, 1 << 64, LONG, np.uint64, endpoint=False)

    def hashes(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the words b[start:end], which do not overlap and are in order."""
        if not len(start):
            return np.zeros(0, np.uint64)
        size = end - start
        first = np.cumsum(size) - size
        within = np.arange(int(size.sum())) - np.repeat(first, size)
        at = np.repeat(start, size) + within
        out = np.add.reduceat((b[at].astype(np.uint64) + U(1)) * self.keys[np.minimum(within, LONG - 1)], first)
        for i in np.flatnonzero(size > LONG).tolist():
            raw = b[start[i] : end[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=self.key).digest(), "little")
        return mix(out + size.astype(np.uint64))


@lru_cache(4)
def keyed(key: int) -> Words:
    return Words(key)


def shingle_sets(texts: list[str], width: int = WIDTH, key: int = 0) -> list[np.ndarray]:
    """The sorted, distinct 64-bit fingerprints of each text's word shingles."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    gap = GAPS[b]
    start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    word = keyed(key).hashes(b, start, end)
    bounds = np.cumsum([1, *[len(r) + 1 for r in raw]])
    first = np.searchsorted(start, bounds)
    n = max(0, len(word) - width + 1)
    run = np.zeros(n, np.uint64)
    for k in range(width):
        run = mix(run * U(31) + word[k : k + n])
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= width:
            out.append(np.unique(run[i : j - width + 1]))
        elif j > i:
            h = np.full(1, j - i, np.uint64)
            for k in range(i, j):
                h = mix(h * U(37) + word[k : k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_BIN = U(57)
_STARTS = np.arange(T, dtype=np.uint64) << _BIN


def sketch(s: np.ndarray) -> np.ndarray:
    """T coordinates of a set that is not empty. Keys order as bin (7 bits), round (9 bits), value (48 bits)."""
    out = np.zeros(T, np.uint64)
    todo = np.ones(T, bool)
    i, many = 0, max(1, min(T, 1024 // len(s)))
    while i < T and todo.any():
        r = np.arange(i, min(i + many, T), dtype=np.uint64)[:, None]
        h = mix(s[None, :] ^ (r * U(0xD6E8FEB86659FD93)), 1)
        key = np.sort(((h >> _BIN << _BIN) | (r << U(48)) | (h & U((1 << 48) - 1))).ravel())
        at = np.searchsorted(key, _STARTS)
        there = at < len(key)
        there[there] = key[at[there]] >> _BIN == np.flatnonzero(there).astype(np.uint64)
        fill = todo & there
        out[fill] = key[at[fill]]
        todo &= ~there
        i += many
    for j in np.flatnonzero(todo).tolist():
        r = T + j
        out[j] = U(j << 57 | r << 48) | (mix(s ^ U(r * 0xD6E8FEB86659FD93 & (2**64 - 1)), 1) & U((1 << 48) - 1)).min()
    return out


def bands(sk: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band; the band's number is part of it."""
    rows = sk.reshape(BANDS, -1)
    h = np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[1]):
        h = mix(h * U(41) + rows[:, k])
    return h.view(np.int64)


def name_of(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    a, b = (mix(s, k).sum(dtype=np.uint64).astype(np.int64) for k in (2, 3))
    return int(a), int(b)


def sketches(df: DataFrame, key: int = 0) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands, small): h1, h2 name the set; small holds 8 bits of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(list(map(len, texts)), CHUNK_CHARS):
                sets = shingle_sets(texts[a:b], key=key)
                rows = [sketch(s) if len(s) else None for s in sets]
                h1, h2 = np.array([name_of(s) for s in sets], np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1), pa.array(h2),
                     pa.array([r if r is None else bands(r).tolist() for r in rows], pa.list_(pa.int64())),
                     pa.array([r if r is None else r.astype(np.uint8).tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands", "small"],
                )

    docs = df.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return in_batches(docs, run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, small binary")


def joined(sets: list[np.ndarray], asks: np.ndarray, answers: np.ndarray, comp: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(i, least i of its class) of sets that links join: each that asks is compared with all that answer, unless they are together already."""
    sizes = np.array([len(s) for s in sets])
    to = np.flatnonzero(answers)
    lab = comp.copy()
    if not asks.any() or not len(to):
        return []
    known = np.unique(np.concatenate([sets[i] for i in np.flatnonzero(asks)]))
    place = np.searchsorted(known, flat := np.concatenate([sets[i] for i in to]))
    place[known[np.minimum(place, len(known) - 1)] != flat] = len(known)
    starts = np.cumsum(sizes[to]) - sizes[to]
    mark = np.zeros(len(known) + 1, bool)
    for p in np.flatnonzero(asks).tolist():
        other = lab[to] != lab[p]
        if not other.any():
            continue
        own = np.searchsorted(known, sets[p])
        mark[own] = True
        both = np.add.reduceat(mark[place], starts, dtype=np.int64)
        mark[own] = False
        for c in np.unique(lab[to[other & (100 * both >= percent * (sizes[p] + sizes[to] - both))]]).tolist():
            lab[lab == c] = lab[p]
    # Rows of one label that came with several components: each of those is joined to the first.
    out = []
    order = np.lexsort((np.arange(len(lab)), lab))
    for part in np.split(order, np.flatnonzero(np.diff(lab[order])) + 1):
        if (comp[part] != comp[part[0]]).any():
            out += [(int(i), int(part[0])) for i in part[np.unique(comp[part], return_index=True)[1]].tolist() if i != part[0]]
    return out


def verified(wanted: DataFrame, docs: DataFrame, percent: int, key: int = 0) -> DataFrame:
    """Edges (a, b) that span the links, on full sets, inside the groups of wanted.

    wanted: (g, part, rep, h1, h2, c, asks, answers). Rows of one part meet; a row that asks is compared with all that
    answer and have another c. docs may hold several texts of a doc_id: h1, h2 tell which one is meant.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        at, edges = None, []

        def close() -> None:
            rows = sorted(held.items())
            if len(rows) > 1:
                sets, comp, asks, answers = zip(*[r for _, r in rows])
                for i, j in joined(list(sets), np.array(asks), np.array(answers), np.array(comp), percent):
                    edges.append((rows[i][0], rows[j][0]))
            held.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])
            edges.clear()
            return out

        for batch in batches:
            *keys, texts = [c.to_pylist() for c in batch.columns]
            for a, b in chunks(list(map(len, texts)), CHUNK_CHARS):
                for s, g, part, rep, h1, h2, c, asks, answers in zip(shingle_sets(texts[a:b], key=key), *[k[a:b] for k in keys]):
                    if (g, part) != at:
                        close()
                        at = (g, part)
                    if rep in held:
                        held[rep] = (held[rep][0], c, held[rep][2] or asks, held[rep][3] or answers)
                    elif name_of(s) == (h1, h2):
                        held[rep] = (s, c, asks, answers)
            if len(edges) > 10_000:
                yield flush()
        close()
        yield flush()

    wanted = stored(wanted, "wanted")
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        texts = docs.join(F.broadcast(wanted), docs["doc_id"] == wanted["rep"])
    else:
        texts = docs.join(wanted, docs["doc_id"] == wanted["rep"])
    dealt = texts.select("g", "part", "rep", "h1", "h2", "c", "asks", "answers", "text").repartition("g", "part").sortWithinPartitions("g", "part")
    return stored(in_batches(dealt, run, "a long, b long"), "links")


def in_pairs(rows: DataFrame) -> DataFrame:
    """rows (..., rep, asks, n_ask, n_rest) with part, asks and answers: those who ask are dealt to n_ask blocks, the others to n_rest,
    and a part is two blocks that meet, or one with itself. Of two blocks that both ask, one asks and the other answers."""
    blocks, own = F.col("n_ask") + F.col("n_rest"), F.pmod(F.xxhash64("rep"), F.when(F.col("asks"), F.col("n_ask")).otherwise(F.col("n_rest")))
    entry = lambda i, j, asks, answers: F.struct((i * blocks + j).alias("part"), asks.alias("asks"), answers.alias("answers"))
    every = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    each, mine = every(F.col("n_ask")), F.col("own")
    asking = F.concat(
        F.transform(each, lambda j: entry(F.least(mine, j), F.greatest(mine, j), mine <= j, mine >= j)),
        F.transform(every(F.col("n_rest")), lambda j: entry(mine, F.col("n_ask") + j, F.lit(True), F.lit(False))),
    )
    resting = F.transform(each, lambda i: entry(i, F.col("n_ask") + mine, F.lit(False), F.lit(True)))
    held = [c for c in rows.columns if c not in ("asks", "n_ask", "n_rest")]
    return rows.withColumn("own", own).select(*held, F.explode(F.when(F.col("asks"), asking).otherwise(resting)).alias("m")).select(*held, "m.*")


def stars(met: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows for verified(): each bucket's least member asks, its others answer; every such pair once."""
    pairs = met.where("rep <> pivot").select(F.col("pivot").alias("g"), "rep").distinct().join(reps.select("rep", "h1", "h2", "n_shingles"), "rep")
    size = pairs.groupBy("g").agg(F.ceil(F.sum("n_shingles") / PART_SHINGLES).cast("int").alias("parts"))
    member = pairs.join(size, "g").select("g", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep", "h1", "h2", F.col("rep").alias("c"), F.lit(False).alias("asks"), F.lit(True).alias("answers"))
    centre = size.join(reps, size["g"] == reps["rep"]).select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "h1", "h2", F.col("rep").alias("c"), F.lit(True).alias("asks"), F.lit(False).alias("answers"))
    return member.unionByName(centre)


def doubted(met: DataFrame, comps: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(rep, c, d, n): members of components c that sketches leave in doubt (n = 1), and pairs of components c, d that they connect (n = 0)."""
    labelled = met.where("n > 2").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("k", "n", "rep", F.coalesce("component", "rep").alias("c"))
    sizes = labelled.groupBy("k", "c").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("k").agg(F.max_by("c", F.struct("m", "c")).alias("most"), F.max("m").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("k", "most", "m")
    blocks = F.ceil((F.col("n") - F.col("m")) / BLOCK).alias("n_ask"), F.ceil(F.col("m") / BLOCK).alias("n_rest")
    rows = in_pairs(labelled.join(mixed, "k").select("k", "rep", "c", (F.col("c") != F.col("most")).alias("asks"), *blocks))
    rows = rows.join(reps.select("rep", "small"), "rep").select("k", "part", "rep", "c", "asks", "answers", "small")
    least = T * (percent / 100 - ESTIMATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def close() -> tuple[set, set]:
            members, links = set(), set()
            if len({r[1] for r in held}) > 1:
                rep, c, asks, answers, small = zip(*held)
                x, c, to = np.frombuffer(b"".join(small), np.uint8).reshape(len(held), T), np.array(c), np.flatnonzero(answers)
                for p in np.flatnonzero(asks).tolist():
                    q = to[c[to] != c[p]]
                    q = q[(x[q] == x[p]).sum(1) >= least]
                    if len(q):
                        members.update((rep[i], int(c[i])) for i in (p, *q.tolist()))
                        links.update((min(int(c[p]), d), max(int(c[p]), d)) for d in np.unique(c[q]).tolist())
            held.clear()
            return members, links

        members, links = set(), set()

        def flush() -> pa.RecordBatch:
            rows = [(r, c, c, 1) for r, c in members] + [(0, c, d, 0) for c, d in links]
            members.clear()
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["rep", "c", "d", "n"])

        for batch in batches:
            for k, part, *row in zip(*[col.to_pylist() for col in batch.columns]):
                if (k, part) != at:
                    for mine, new in zip((members, links), close()):
                        mine |= new
                    at = (k, part)
                held.append(tuple(row))
            if len(members) + len(links) > 50_000:
                yield flush()
        for mine, new in zip((members, links), close()):
            mine |= new
        yield flush()

    dealt = rows.repartition("k", "part").sortWithinPartitions("k", "part")
    return stored(in_batches(dealt, run, "rep long, c long, d long, n long").distinct(), "doubted")


def families(doubt: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows for verified(): all members in doubt of the components that doubt connects; those outside the largest one ask."""
    near = components(doubt.where("n = 0"), "c", "d")
    members = doubt.where("n = 1").select("rep", "c").join(near.withColumnRenamed("node", "c"), "c", "left").select("rep", "c", F.coalesce("component", "c").alias("g"))
    members = stored(members.join(reps.select("rep", "h1", "h2", "n_shingles"), "rep"), "members")
    sizes = members.groupBy("g", "c").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    group = sizes.groupBy("g").agg(F.max_by(F.struct("c", "s"), F.struct("m", "c")).alias("most"), F.sum("s").alias("s"))
    blocks = F.ceil((F.col("s") - F.col("most.s")) / PART_SHINGLES).alias("n_ask"), F.ceil(F.col("most.s") / PART_SHINGLES).alias("n_rest")
    return in_pairs(members.join(group, "g").select("g", "rep", "h1", "h2", "c", (F.col("c") != F.col("most.c")).alias("asks"), *blocks))


def near(df: DataFrame, percent: int = 75, key: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row. key: of the words' hashes, one for a run."""
    key = secrets.randbits(64) if key is None else key
    sk = stored(sketches(df, key), "sketches")
    named = sk.where("doc_id is not null and n_shingles > 0")
    reps = stored(named.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "small"), "doc_id").alias("s")).select("h1", "h2", "n_shingles", "rep", "s.*"), "reps")
    docs = df.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))

    entries = reps.select("rep", F.explode("bands").alias("k"))
    full = entries.groupBy("k").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    met = stored(entries.join(full, "k"), "buckets")
    comps = components(verified(stars(met, reps), docs, percent, key), "a", "b")
    more = verified(families(doubted(met, comps, reps, percent), reps), docs, percent, key)
    if more.limit(1).count():
        # The components so far stand in for the links that made them: fewer edges, nearly stars already.
        comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "a", "b")
    label = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("c"))
    out = sk.select("doc_id", "n_shingles", "h1", "h2").join(label, ["h1", "h2"], "left")
    found = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

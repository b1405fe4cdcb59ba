"""Best-fit packing of documents into sequences of bounded length, completed by a grouping genetic algorithm.

Each task tokenises its documents and packs the pieces on the spot, best fit first, so ids are never shuffled. Sequences
that are not quite full are open: their pieces (lengths only) leave their tasks, up to MEET meet and are packed again by
best fit, or stay as they came where that is no better. What is not full then, emptiest first, makes groups of GROUP
pieces, whole sequences each. A group that has more sequences than its lengths ask for evolves on ISLANDS islands, a Spark
task each, from the sequences it has: crossover injects whole well-filled sequences of one parent into another, sequences that hold a piece twice
are taken apart, displaced pieces go back by dominance (a free piece takes the place of smaller ones where that fills a
sequence better) and then best fit. Between EPOCHS the islands' populations are written to the shared folder, and each
island's elite migrates to the next. The best packing of any island counts. Where the pieces were
more than MEET, all sequences that are not full meet again, mixed anew, until they are one meeting or a round brings little:
no sequence saved and under a tenth of its pieces in full ones.

A document is its ids and the end id. Longer ones are cut into pieces of the full length, the first one shorter. Null
texts count as empty (one piece of one id). Very long texts are encoded whole. Repeated rows are packed as documents of
their own; ties of length go in order of arrival. Other columns are not read, so their names cannot clash. Ids are held
in 16 bits: a vocabulary of more than 65,536 ids is an error. An empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, in_batches, stored, text_or_empty
from .pieces import lengths
from .tokens import encoder

LENGTH = 2048
BLOCK_DOCS, BLOCK_IDS = 20_000, 8_000_000  # documents, and ids, that one packing holds at once
CHUNK_BYTES = 8 << 20
MEET = 100_000  # open pieces that one best fit packs
GROUP = 600  # open pieces that evolve together
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 4, 6, 4, 12

Bins = list[list[int]]


def best_fit(items: list[int], size: list[int], bins: Bins, length: int) -> None:
    """Puts the items, longest first, each into the sequence that it leaves the least room in."""
    rooms: dict[int, list[int]] = {}
    mask = 0
    for b, held in enumerate(bins):
        room = length - sum(size[i] for i in held)
        rooms.setdefault(room, []).append(b)
        mask |= 1 << room
    for i in sorted(items, key=lambda x: -size[x]):
        fits = mask >> size[i]
        if fits:
            room = size[i] + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = length, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= size[i]
        rooms.setdefault(room, []).append(b)
        mask |= 1 << room


def fitness(bins: Bins, size: list[int], length: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones."""
    return -len(bins), sum((sum(size[i] for i in b) / length) ** 2 for b in bins)


def put_back(loose: list[int], size: list[int], bins: Bins, length: int, rng: random.Random) -> None:
    """Free pieces go into bins: first by dominance, a free piece in place of one or two smaller ones that it fills more
    room than (those are free then, and smaller ones are easier to place), the rest by best fit."""
    loose = sorted(loose, key=lambda i: -size[i])
    for _ in range(4):
        moved = False
        rng.shuffle(order := list(range(len(bins))))
        for b in order:
            held = bins[b]
            room = length - sum(size[i] for i in held)
            if not room or not loose:
                continue
            best, swap = 0, None
            outs = [(size[x], (x,)) for x in held] + [(size[x] + size[y], (x, y)) for k, x in enumerate(held[:12]) for y in held[k + 1 : 12]]
            gone = {n for n, _ in outs}
            for i in loose:
                for n in gone:
                    gain = size[i] - n
                    if best < gain <= room:
                        best, swap = gain, (i, n)
                if best == room:
                    break
            if swap:
                i, n = swap
                out = next(x for m, x in outs if m == n)
                bins[b] = [x for x in held if x not in out] + [i]
                loose.remove(i)
                loose = sorted([*loose, *out], key=lambda x: -size[x])
                moved = True
        if not moved:
            break
    best_fit(loose, size, bins, length)


def crossover(a: Bins, b: Bins, size: list[int], length: int, rng: random.Random) -> Bins:
    """a with some of b's well-filled sequences in place of those of its own that share a piece with them."""
    filled = sorted(b, key=lambda x: -sum(size[i] for i in x))[: max(1, (len(b) + 1) // 2)]
    gift = rng.sample(filled, max(1, len(filled) // 2))
    taken = {i for x in gift for i in x}
    child, loose = [list(x) for x in gift], []
    for x in a:
        if taken.isdisjoint(x):
            child.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    put_back(loose, size, child, length, rng)
    return child


def mutate(a: Bins, size: list[int], length: int, rng: random.Random) -> Bins:
    """The emptiest sequence and some others taken apart and packed again."""
    order = sorted(range(len(a)), key=lambda k: sum(size[i] for i in a[k]))
    gone = {order[0], *rng.sample(range(len(a)), min(len(a), 2 + len(a) // 20))}
    kept = [list(x) for k, x in enumerate(a) if k not in gone]
    put_back([i for k in gone for i in a[k]], size, kept, length, rng)
    return kept


def plain(size: list[int], length: int = LENGTH) -> Bins:
    """Best fit of items of the given sizes (1 to length): sequences as lists of item numbers."""
    bins: Bins = []
    best_fit(list(range(len(size))), size, bins, length)
    return bins


def epoch(people: list[Bins], size: list[int], length: int, seed: int) -> list[Bins]:
    """One island's population after GENERATIONS; ends early where no packing can use fewer sequences."""
    rng = random.Random(seed)
    least = -(-sum(size) // length)
    score = lambda x: fitness(x, size, length)
    people = people + [mutate(people[0], size, length, rng) for _ in range(POPULATION - len(people))]
    for _ in range(GENERATIONS):
        if max(map(score, people))[0] == -least:
            break
        a, b = rng.sample(people, 2)
        child = crossover(max(a, b, key=score), min(a, b, key=score), size, length, rng)
        if rng.random() < 0.6:
            child = mutate(child, size, length, rng)
        worst = min(range(len(people)), key=lambda i: score(people[i]))
        if score(child) > score(people[worst]):
            people[worst] = child
    return sorted(people, key=score, reverse=True)


def labels_of(bins: Bins, n: int) -> list[int]:
    """The sequence number of each item."""
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def bins_of(labels) -> Bins:
    out: Bins = [[] for _ in range(max(labels, default=-1) + 1)]
    for i, k in enumerate(labels):
        out[k].append(i)
    return [b for b in out if b]


def evolved(groups: DataFrame, length: int) -> DataFrame:
    """(g, labels): the packing of each group (g, size array<int>) of a bounded number of pieces that its islands reach. A column
    held array<int>, if there is one, has a packing that is at hand: the result has no more sequences."""
    if "held" not in groups.columns:
        groups = groups.withColumn("held", F.lit(None).cast("array<int>"))
    island = "g long, island int, size array<int>, people array<array<int>>, used int, least int"

    def start(frames):
        for pdf in frames:
            rows = []
            for g, size, held in zip(pdf["g"], pdf["size"], pdf["held"]):
                size = [int(x) for x in size]
                first, least = plain(size, length), -(-sum(size) // length)
                if held is not None:
                    first = max(first, bins_of([int(x) for x in held]), key=lambda x: fitness(x, size, length))
                # A group that best fit packs as well as can be needs no islands.
                rows += [(g, k, size, [labels_of(first, len(size))], len(first), least) for k in range(ISLANDS if len(first) > least else 1)]
            yield pd.DataFrame(rows, columns=["g", "island", "size", "people", "used", "least"])

    state = stored(groups.repartition("g").mapInPandas(start, island), "islands")
    for number in range(EPOCHS):
        if not state.where("used > least").limit(1).count():
            break

        def live(frames, number=number):
            for pdf in frames:
                rows = []
                for g, k, size, people, used, least, guest in zip(*[pdf[c] for c in ("g", "island", "size", "people", "used", "least", "guest")]):
                    size, people = [int(x) for x in size], [[int(v) for v in p] for p in people]
                    if guest is not None and number:
                        people = [*people[: POPULATION - 1], [int(v) for v in guest]]
                    out = epoch([bins_of(p) for p in people], size, length, (int(g) * ISLANDS + int(k)) * EPOCHS + number) if used > least else [bins_of(people[0])]
                    rows.append((g, k, size, [labels_of(p, len(size)) for p in out], min(used, len(out[0])), least))
                yield pd.DataFrame(rows, columns=["g", "island", "size", "people", "used", "least"])

        elite = state.select("g", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("people")[0].alias("guest"), F.col("used").alias("its"))
        done = state.groupBy("g").agg(F.min("used").alias("best"))
        met = state.join(elite, ["g", "island"], "left").join(done, "g").withColumn("used", F.when(F.col("best") == F.col("least"), F.col("least")).otherwise(F.col("used")))
        state = stored(met.select("g", "island", "size", "people", "used", "least", "guest").repartition("g", "island").mapInPandas(live, island), "islands")
    # The fewest sequences; of equals, the first island.
    best = state.select("g", F.col("people")[0].alias("labels"), "island").withColumn("n", F.array_max("labels"))
    return best.groupBy("g").agg(F.min_by("labels", F.struct("n", "island")).alias("labels"))


PLACED = "doc_id long, copy long, piece int, start long, length long, ids binary, place long, spot long, open boolean"


def pieces_of(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    head = n % length or length
    return [(0, head), *[(at, length) for at in range(head, n, length)]]


def meeting(groups: DataFrame, length: int) -> DataFrame:
    """(g, labels, chunks): a packing of each group (g, size array<int>, place array<long>) of open pieces, by best fit or as places tell,
    whichever is better. chunks: which of its pieces evolve together, -1 for those in full sequences."""

    def run(frames):
        for pdf in frames:
            rows = []
            for g, size, place in zip(pdf["g"], pdf["size"], pdf["place"]):
                size = [int(x) for x in size]
                known: dict[int, int] = {}
                came = bins_of([known.setdefault(int(x), len(known)) for x in place])
                bins = max(plain(size, length), came, key=lambda x: fitness(x, size, length))
                fill = [sum(size[i] for i in b) for b in bins]
                chunks, chunk, held = [-1] * len(size), 0, 0
                for k in sorted(range(len(bins)), key=lambda k: fill[k]):
                    if fill[k] == length:
                        break
                    if held and held + len(bins[k]) > GROUP:
                        chunk, held = chunk + 1, 0
                    held += len(bins[k])
                    for i in bins[k]:
                        chunks[i] = chunk
                rows.append((g, labels_of(bins, len(size)), chunks))
            yield pd.DataFrame(rows, columns=["g", "labels", "chunks"])

    return groups.mapInPandas(run, "g long, labels array<int>, chunks array<int>")


def packed_again(free: DataFrame, length: int) -> DataFrame:
    """(copy, piece, length, sequence_id) of the pieces (place, copy, piece, length) of open sequences, packed across tasks."""
    names, done, number = ["copy", "piece", "length", "sequence_id"], [], 0
    while True:
        came, pieces = free.agg(F.count_distinct("place"), F.count("*")).first()
        meetings = max(1, -(-pieces // MEET))
        # A sequence is dealt whole, by its number.
        dealt = free.withColumn("g", F.pmod(F.xxhash64("place", F.lit(number)), F.lit(meetings)).cast("long"))
        items = dealt.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("place", "copy", "piece", "length"))).alias("items"))
        items = stored(items, "items")
        met = meeting(items.select("g", F.transform("items", lambda x: x["length"].cast("int")).alias("size"), F.transform("items", lambda x: x["place"]).alias("place")).repartition("g"), length)
        each = F.transform(F.arrays_zip("items", "labels", "chunks"), lambda x: F.struct(x["items"].alias("i"), x["labels"].alias("k"), x["chunks"].alias("chunk")))
        each = stored(items.join(met, "g").select("g", F.explode(each).alias("x")).select("g", "x.k", "x.chunk", "x.i.copy", "x.i.piece", "x.i.length"), "met")
        # Numbers are negative and tell the round, the meeting and, of what evolved, its group.
        name = lambda kind, low: (-1 - F.lit((2 * number + kind) << 52) - F.shiftleft("g", 32) - low).alias("sequence_id")  # noqa: E731, B023
        done.append(each.where("chunk < 0").select(*names[:3], name(0, F.col("k"))))
        groups = each.where("chunk >= 0").groupBy("g", "chunk").agg(F.sort_array(F.collect_list(F.struct("k", "copy", "piece", "length"))).alias("items"))
        groups = stored(groups.withColumn("one", F.shiftleft("g", 20) + F.col("chunk")), "groups")
        ends = evolved(groups.select(F.col("one").alias("g"), F.transform("items", lambda x: x["length"].cast("int")).alias("size"), F.transform("items", lambda x: x["k"]).alias("held")), length)
        each = F.transform(F.arrays_zip("items", "labels"), lambda x: F.struct(x["items"].alias("i"), x["labels"].alias("k")))
        ends = groups.join(ends.withColumnRenamed("g", "one"), "one").select("g", "chunk", F.explode(each).alias("x"))
        ends = stored(ends.select("x.i.copy", "x.i.piece", "x.i.length", name(1, F.shiftleft(F.col("chunk").cast("long"), 12) + F.col("x.k"))), "evolved")
        full, filled = done[-1].agg(F.count_distinct("sequence_id"), F.count("*")).first()
        saved = came - full - ends.select("sequence_id").distinct().count()
        if meetings == 1 or not saved and 10 * filled < pieces:
            return reduce(DataFrame.unionByName, [*done, ends.select(*names)])
        free, number = ends.select(F.col("sequence_id").alias("place"), "copy", "piece", "length"), number + 1


def place(df: DataFrame, path: str, cut: str = "space", end: int = 0, length: int = LENGTH) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids, sequence_id, offset); ids are little-endian unsigned 16-bit integers.

    copy tells repeated doc_ids apart. The whole result is written to the shared folder once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path, cut)
        serial = seq = held = 0
        docs: list[tuple] = []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held
            items = [(d, c, k, s, n, x[2 * s : 2 * (s + n)]) for d, c, x in docs for k, (s, n) in enumerate(pieces_of(len(x) // 2, length))]
            size = [t[4] for t in items]
            small = [i for i, n in enumerate(size) if n < length]
            bins = [[small[j] for j in b] for b in plain([size[i] for i in small], length)] + [[i] for i, n in enumerate(size) if n == length]
            rows = []
            for b in bins:
                is_open, spot = sum(size[i] for i in b) < length, 0
                for i in b:
                    rows.append((*items[i], part << 33 | seq, spot, is_open))
                    spot += size[i]
                seq += 1
            docs.clear()
            held = 0
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
            names = [c.split()[0] for c in PLACED.split(", ")]
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 5000]), types)], names=names)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in chunks(lengths(texts), CHUNK_BYTES):
                for d, x in zip(names[a:b], enc.encode(texts.slice(a, b - a), end)):
                    docs.append((d, part << 33 | serial, x))
                    serial += 1
                    held += len(x) // 2
                if len(docs) >= BLOCK_DOCS or held >= BLOCK_IDS:
                    yield from block()
        if docs:
            yield from block()

    first = stored(in_batches(df.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, PLACED, 4000), "packed")
    # Open sequences leave only lengths with their pieces' names.
    free = first.where("open").select("place", "copy", "piece", "length")
    own = Window.partitionBy("sequence_id").orderBy("copy", "piece")
    moved = packed_again(free, length).select("copy", "piece", "sequence_id", (F.sum("length").over(own) - F.col("length")).alias("offset"))
    out = ["doc_id", "copy", "piece", "start", "length", "ids"]
    still = first.where("not open").select(*out, F.col("place").alias("sequence_id"), F.col("spot").alias("offset"))
    return still.unionByName(first.where("open").select(*out).join(moved, ["copy", "piece"]).select(*out, "sequence_id", "offset"))


def digest(placed: DataFrame) -> DataFrame:
    """The placement with the crc32 of each piece's ids, taken as little-endian unsigned 32-bit integers, for the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x, np.uint16).astype("<u4").tobytes()) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(crc, pa.int64()), batch.column(5), batch.column(6)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return in_batches(placed.select(*names[:4], "ids", *names[5:]), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

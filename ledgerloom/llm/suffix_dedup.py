"""Removal of long repeated byte strings by a range-partitioned, sampled suffix array.

Which suffixes: every string of SHORT bytes or more names one place inside itself, where its GRAM-byte strings hash least
(leftmost of equals). Equal strings name the same place, so it is enough to sort suffixes that start at named places, one
in about 100 bytes. A place's context is all that strings of up to LENGTH bytes which name it can reach: from behind the
last place to its left that hashes less (or as little) to before the next one to its right that hashes less.

1. Per document: named places, their contexts' fingerprints, and the strings of LENGTH that repeat inside the document.
2. Grams that occur once end there (counts, combined before the shuffle). A context that occurs twice or more as a
   whole is settled by its count; what is left are grams with differing contexts, one row per different context.
3. Those suffixes are range-partitioned by their leading bytes (Spark samples the splitters), and each gram's are sorted
   by multikey quicksort over 8-byte tokens, as are its reversed left contexts; neighbours' common prefixes give those of
   all pairs as range minima. Where left and right agreement add up to LENGTH, the bytes between are repeated; all such
   spans hold the named place, so a context's union is one span.
4. A gram with over BLOCK contexts is never compared whole. The strings that hold it are numbered by where they start,
   and each context asks twice: for the lower and for the upper half of the numbers, by the bytes that all strings of that
   half share. Contexts that agree on all bytes of the half are settled, and one of them goes on for all; contexts that
   nobody shares the common bytes with drop out; groups of BLOCK or fewer are sorted and compared; larger ones are halved
   again, until one string is left. So n contexts cost n log LENGTH rows.
5. Spans go back to their documents, are merged there and cut out.

Beside repeated strings, the same pass finds passages: PASSAGE_WORDS words or more (parts of words at the ends count), of
SHORT bytes or more, that another document has too. They are reported, and cut where asked for (passages=True).

Matches never cross documents and are judged on the input. Null texts count as empty. Rows that repeat both doc_id and
text are repeats of each other; ties name the leftmost place. Very long texts are read whole, one at a time. Columns that
are not named in carry are not read, so their names cannot clash; carry must not name doc_id or text. An empty table gives no rows. Places, contexts
and documents are told apart by 128 bits of fingerprints; partial matches by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, stored, text_or_empty
from .minhash import inverse_powers, mix, powers

LENGTH = 400
SHORT = 256
PASSAGE_WORDS = 51
GRAM = 64
BLOCK = 1000  # contexts of a gram that are compared at once
BROADCAST_DOCS = 200_000  # documents with spans whose ids (16 bytes) may be broadcast; more are joined by a shuffle
U = np.uint64
GAPS = np.zeros(256, bool)
GAPS[[9, 10, 11, 12, 13, 32]] = True
ANCHORS = "did long, rid long, lo int, hi int, at int, h long, c long"


def least_ahead(key: np.ndarray, n: int, w: int) -> np.ndarray:
    """The places of the least keys in the windows of w that start at 0 to n-1; keys hold their place in the low 32 bits."""
    rows = -(-len(key) // w)
    pad = np.full(rows * w, ~U(0))
    pad[: len(key)] = key
    ahead = np.minimum.accumulate(pad.reshape(rows, w), axis=1).ravel()
    back = np.minimum.accumulate(pad.reshape(rows, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)


def reach(h: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in `at`: how many places to its left hash more, to its right hash no less, up to span."""
    most = np.iinfo(np.uint32).max
    pad = np.concatenate([np.full(span, most, np.uint32), h, np.full(span, most, np.uint32)])
    windows = np.lib.stride_tricks.sliding_window_view(pad, span)
    left, right = np.full(len(at), span), np.full(len(at), span)
    for i in range(0, len(at), 2048):
        own = h[at[i : i + 2048], None]
        met = windows[at[i : i + 2048]][:, ::-1] <= own
        far = np.arange(1, span + 1) > at[i : i + 2048, None]  # before the text
        met &= ~far
        left[i : i + 2048] = np.where(met.any(1), met.argmax(1), span)
        met = windows[at[i : i + 2048] + span + 1] < own
        right[i : i + 2048] = np.where(met.any(1), met.argmax(1), span)
    return left, right


def named_places(b: np.ndarray, length: int, gram: int, short: int) -> tuple[np.ndarray, ...]:
    """(lo, hi, at, h, c) of a text's named places and their contexts, and (lo, hi) of strings of `length` met twice in it; hi is exclusive."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + U(1)) * powers(len(b)))])
    inv = inverse_powers(len(b))

    def strings(size: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Fingerprints of all strings of a size, and which of them were not met before (None: all)."""
        whole = mix((sums[size:] - sums[: len(b) - size + 1]) * inv[: len(b) - size + 1])
        ordered = np.sort(whole)
        if not (ordered[1:] == ordered[:-1]).any():
            return whole, None
        fresh = np.zeros(len(whole), bool)
        fresh[np.unique(whole, return_index=True)[1]] = True
        return whole, fresh

    grams = len(b) - gram + 1
    h = mix((sums[gram:] - sums[:grams]) * inv[:grams], 5)
    key = h >> U(32) << U(32) | np.arange(grams, dtype=np.uint64)
    names = least_ahead(key, len(b) - short + 1, short - gram + 1)
    _, fresh = strings(short)
    lo2 = hi2 = np.zeros(0, np.int64)
    if fresh is not None:
        names = names[fresh]
        if len(b) >= length:
            whole, first = strings(length)
            if first is not None:
                t = np.flatnonzero(np.diff(np.concatenate([[0], np.isin(whole, whole[~first]).astype(np.int8), [0]])))
                lo2, hi2 = t[::2], t[1::2] - 1 + length
            longer = least_ahead(key, len(b) - length + 1, length - gram + 1)
            names = np.concatenate([names, longer if first is None else longer[first]])
    at = np.unique(names)
    left, right = reach((h >> U(32)).astype(np.uint32), at, length - gram)
    lo = np.maximum(at - left, 0)
    hi = np.minimum(np.where(right < length - gram, at + right + gram, at + length), len(b))
    at, lo, hi = (x[hi - lo >= short] for x in (at, lo, hi))
    c = mix((sums[hi] - sums[lo]) * inv[lo] + ((at - lo).astype(np.uint64) << U(32) | (hi - lo).astype(np.uint64)), 6)
    return lo, hi, at, h[at], c, lo2, hi2


def anchors(docs: DataFrame, length: int, gram: int, short: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for did, rid, text in zip(*[c.to_pylist() for c in batch.columns]):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) >= short:
                    lo, hi, at, h, c, lo2, hi2 = named_places(np.frombuffer(raw, np.uint8), length, gram, short)
                    n, m = len(lo), len(lo2)
                    none = np.zeros(m, np.uint64)
                    held.append((np.full(n + m, did), np.full(n + m, rid), np.append(lo, lo2), np.append(hi, hi2), np.append(at, np.full(m, -1)), np.append(h, none), np.append(c, none)))
            if held:
                cols = [np.concatenate(x) for x in zip(*held)]
                types = [np.int64, np.int64, np.int32, np.int32, np.int32]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(t)) for x, t in zip(cols, types)], *[pa.array(x.view(np.int64)) for x in cols[5:]]], names=[x.split()[0] for x in ANCHORS.split(", ")])

    return in_batches(docs.select("did", "rid", "text"), run, ANCHORS)


CONTEXT = "h long, c long, doc long, n long, off int, lead binary, context binary"
CONTEXT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
HALF = CONTEXT + ", rule int, k1 int, k2 int, g binary, own binary"
HALF_TYPES = [*CONTEXT_TYPES, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def batch_of(rows: list[tuple], types: list, schema: str) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=[x.split()[0] for x in schema.split(", ")])


def contexts(classes: DataFrame, docs: DataFrame, gram: int) -> DataFrame:
    """CONTEXT rows for one occurrence of each different context; doc is null for contexts of several documents, n the number of contexts of the gram."""
    wanted = classes.groupBy("did", "rid").agg(F.collect_list(F.struct("h", "c", "doc", "n", "lo", "hi", "at")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    rows.append((w["h"], w["c"], w["doc"], w["n"], w["at"] - w["lo"], raw[w["at"] : w["at"] + gram], raw[w["lo"] : w["hi"]]))
                if len(rows) > 10_000:
                    yield batch_of(rows, CONTEXT_TYPES, CONTEXT)
                    rows = []
            yield batch_of(rows, CONTEXT_TYPES, CONTEXT)

    return in_batches(docs.select("did", "rid", "text").join(wanted, ["did", "rid"]).select("text", "wanted"), run, CONTEXT)


def word_edges(context: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a context, parts of words at its ends included."""
    there = np.concatenate([[False], ~GAPS[np.frombuffer(context, np.uint8)], [False]])
    edge = np.flatnonzero(there[1:] != there[:-1])
    return edge[::2], edge[1::2]


def windows_of(rule: int, off: int, context: bytes, length: int, gram: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end) of the strings around the place that lie in the context: of `length` bytes (rule 0), of `least` words (rule 1)."""
    if rule == 0:
        k = np.arange(length - gram + 1)
        start, end = off - (length - gram) + k, off + gram + k
        fits = (start >= 0) & (end <= len(context))
    else:
        starts, ends = word_edges(context)
        first = int(np.searchsorted(starts, off)) - least + 1 + np.arange(least)
        fits = (first >= 0) & (first + least <= len(starts))
        k, first = np.arange(least), np.clip(first, 0, max(0, len(starts) - 1))
        start, end = (starts[first], ends[np.clip(first + least - 1, 0, len(ends) - 1)]) if len(starts) else (k, k)
    return k[fits], start[fits], end[fits]


def halved(level: DataFrame, length: int, gram: int, least: int) -> DataFrame:
    """HALF rows: each context of the level once per half of its strings' numbers. g names the bytes that all these strings
    share, own the bytes that they cover together (where the context does not hold them all: the context)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *row, rule, k1, k2 in zip(*[c.to_pylist() for c in batch.columns]):
                h, c, off, context = row[0], row[1], row[4], row[6]
                k, start, end = windows_of(rule, off, context, length, gram, least)
                first, last = ((off - (length - gram), off + gram) if rule == 0 else (0, 0))
                starts, ends = word_edges(context)
                j = int(np.searchsorted(starts, off)) - least + 1
                mid = (k1 + k2) // 2
                for a, b in ((k1, mid), (mid + 1, k2)):
                    if a > b or not len(k) or k[-1] < a or k[0] > b:
                        continue
                    # From where the last string starts to where the first ends: part of each of them.
                    lo, hi = (first + b, last + a) if rule == 0 else (starts[j + b], ends[j + a + least - 1])
                    whole = k[0] <= a and b <= k[-1]
                    cover = context[start[a - k[0]] : end[b - k[0]]] if whole else f"{h} {c}".encode()
                    place = off - (start[a - k[0]] if whole else 0)
                    named = [hashlib.blake2b(x + f"|{h}|{rule}|{a}|{b}|{y}".encode(), digest_size=16).digest() for x, y in ((context[lo:hi], off - lo), (cover, place))]
                    rows.append((*row, rule, a, b, *named))
            yield batch_of(rows, HALF_TYPES, HALF)

    return in_batches(level.select(*[x.split()[0] for x in CONTEXT.split(", ")], "rule", "k1", "k2"), run, HALF)


def asked(hot: DataFrame, length: int, gram: int, least: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """For grams with many contexts: groups of BLOCK contexts or fewer to compare, and (h, c, rule, k1, k2, across) of strings that repeat."""
    rules = F.explode(F.array(F.struct(F.lit(0).alias("rule"), F.lit(0).alias("k1"), F.lit(length - gram).alias("k2")), F.struct(F.lit(1).alias("rule"), F.lit(0).alias("k1"), F.lit(least - 1).alias("k2")))).alias("r")
    hot = hot.dropDuplicates(["h", "c"])  # a repeated document gives its contexts twice
    level = hot.select("*", rules).select(*hot.columns, "r.*")
    groups, ends = [], []
    while level.limit(1).count():
        rows = stored(halved(level, length, gram, least), "halves")
        several = F.coalesce(F.max(F.col("doc").isNull()) | (F.min("doc") != F.max("doc")), F.lit(True))
        alike = rows.groupBy("g", "own").agg(F.count("*").alias("m"), several.alias("across"), F.min("c").alias("first"))
        same = stored(rows.join(alike, ["g", "own"]), "halves")
        ends.append(same.where("m > 1").select("h", "c", "rule", "k1", "k2", "across"))
        # One context stands for all that agree on the whole half; it is of several documents if they are.
        alone = same.where((F.col("c") == F.col("first")) & (F.col("k1") < F.col("k2"))).withColumn("doc", F.when((F.col("m") == 1) | ~F.col("across"), F.col("doc"))).drop("m", "across", "first")
        sizes = alone.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
        met = stored(alone.join(sizes, "g"), "halves")
        groups.append(met.where(F.col("m") <= BLOCK))
        level = met.where(F.col("m") > BLOCK)
    return groups, ends


def multikey_sort(keys: list[list[int]]) -> list[int]:
    """Numbers of the keys (token lists that end in -1) in order: three-way partition by one token at a time."""
    out: list[int] = []
    stack = [(list(range(len(keys))), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) == 1 or depth < 0:
            out += part
            continue
        token = {i: keys[i][depth] for i in part}
        pivot = token[part[len(part) // 2]]
        below = [i for i in part if token[i] < pivot]
        above = [i for i in part if token[i] > pivot]
        same = [i for i in part if token[i] == pivot]
        if above:
            stack.append((above, depth))
        stack.append((same, depth + 1 if pivot >= 0 else -1))
        if below:
            stack.append((below, depth))
    return out


def tokens(s: bytes) -> list[int]:
    cut = len(s) & ~7
    return [*np.frombuffer(s[:cut], ">u8").tolist(), *([int.from_bytes(s[cut:].ljust(8, b"\0"), "big")] if cut < len(s) else []), -1]


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def common_prefixes(keys: list[bytes]) -> np.ndarray:
    """(m, m) lengths of common prefixes: sorted, neighbours compared, range minima for the other pairs."""
    m = len(keys)
    order = multikey_sort([tokens(k) for k in keys])
    lcp = np.array([common(keys[order[i]], keys[order[i + 1]]) for i in range(m - 1)], np.int32)
    out = np.zeros((m, m), np.int32)
    at = np.array(order)
    for i in range(m - 1):
        run = np.minimum.accumulate(lcp[i:])
        out[at[i], at[i + 1 :]] = run
        out[at[i + 1 :], at[i]] = run
    return out


def agreement(rows: list[tuple], length: int, short: int, least: int) -> list[tuple[int, int, bool, int, int]]:
    """For each (doc, off, context): how far left and right of its named place bytes are repeated in another one, and whether
    in another document; the same for passages. (0, 0) where there is nothing."""
    left, right = [c[:off][::-1] for _, off, c in rows], [c[off:] for _, off, c in rows]
    m = len(rows)
    if m == 2:
        a, b = np.full((2, 2), common(left[0], left[1])), np.full((2, 2), common(right[0], right[1]))
    else:
        a, b = common_prefixes(left), common_prefixes(right)
    other = ~np.eye(m, dtype=bool)
    if not ((a + b >= short) & other).any():
        return [(0, 0, False, 0, 0)] * m
    doc = np.array([-1 - i if d is None else i for i, (d, _, _) in enumerate(rows)])
    names: dict[int, int] = {}
    for i, (d, _, _) in enumerate(rows):
        doc[i] = -1 - i if d is None else names.setdefault(d, i)
    across = doc[:, None] != doc[None, :]
    fits = (a + b >= length) & other
    passage = (a + b >= short) & across & other
    for i in np.flatnonzero(passage.any(1)).tolist():
        _, off, c = rows[i]
        starts, ends = word_edges(c)
        j = np.flatnonzero(passage[i])
        # Words that end behind the range's start and begin before its end.
        many = np.searchsorted(starts, off + b[i, j], "left") - np.searchsorted(ends, off - a[i, j], "right")
        passage[i, j[many < least]] = False
    best = lambda x, where: (x * where).max(1).tolist()
    return list(zip(best(a, fits), best(b, fits), (fits & across).any(1).tolist(), best(a, passage), best(b, passage)))


def compared(dealt: DataFrame, length: int, short: int, least: int) -> DataFrame:
    """(h, c, l, r, across, pl, pr) for contexts sorted by group: rows (g, h, c, doc, off, context)."""
    out = "h long, c long, l int, r int, across boolean, pl int, pr int"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        at, rows = None, []

        def close() -> None:
            if len(group) > 1:
                for (h, c, *_), found in zip(group, agreement([g[2:] for g in group], length, short, least)):
                    if found[0] + found[1] or found[3] + found[4]:
                        rows.append((h, c, *found))
            group.clear()

        for batch in batches:
            for g, *rest in zip(*[col.to_pylist() for col in batch.columns]):
                if g != at:
                    close()
                    at = g
                if not any(x[1] == rest[1] for x in group[-1:]):  # rows sorted by c: a repeated document's contexts come twice
                    group.append(tuple(rest))
            if len(rows) > 10_000:
                yield batch_of(rows, types, out)
                rows.clear()
        close()
        yield batch_of(rows, types, out)

    return in_batches(dealt.select("g", "h", "c", "doc", "off", "context"), run, out)


def repeated(df: DataFrame, length: int = LENGTH, gram: int = GRAM, short: int = SHORT, least: int = PASSAGE_WORDS, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents with their row ids (did, rid) and the columns to carry, and (did, rid, lo, hi, kind) of byte ranges, hi
    exclusive, that may overlap: repeated strings (kind 0; 2: in another document too), and what may be a passage (1)."""
    docs = df.select(F.col("doc_id").cast("long"), *carry, text_or_empty().alias("text"))
    docs = docs.withColumns({"did": F.coalesce("doc_id", F.lit(0)), "rid": F.xxhash64("doc_id", "text")})
    found = stored(anchors(docs, length, gram, short), "anchors")
    inside = found.where("at < 0").select("did", "rid", "lo", "hi", F.lit(0).alias("kind"))
    named = found.where("at >= 0")
    # Stored, so that the joins below deal both sides anew and AQE may split a hot gram.
    grams = stored(named.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("m > 1").select("h", (F.col("c0") != F.col("c1")).alias("mixed")), "grams")
    shared = stored(named.join(grams, "h"), "shared")
    one = F.min(F.struct("rid", "did", "lo", "hi", "at"))
    classes = stored(shared.groupBy("h", "c", "mixed").agg(F.count("*").alias("m"), F.min("rid").alias("r0"), F.max("rid").alias("r1"), one.alias("one")), "contexts")

    sizes = stored(classes.where("mixed").groupBy("h").agg(F.count("*").alias("n")), "sizes")
    single = F.when(F.col("r0") == F.col("r1"), F.col("r0")).alias("doc")
    reps = classes.where("mixed").join(sizes, "h").select("h", "c", single, "n", "one.*")
    every = stored(contexts(reps, docs, gram), "suffixes")
    groups, ends = asked(every.where(F.col("n") > BLOCK), length, gram, least)
    dealt = every.where(F.col("n") <= BLOCK).select("lead", F.encode(F.col("h").cast("string"), "UTF-8").alias("g"), "h", "c", "doc", "off", "context")
    for x in groups:
        dealt = dealt.unionByName(x.select("lead", "g", "h", "c", "doc", "off", "context"))
    dealt = dealt.repartitionByRange("lead", "g").sortWithinPartitions("lead", "g", "c")
    spans = compared(dealt, length, short, least).groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"), F.max("across").alias("across"), F.max("pl").alias("pl"), F.max("pr").alias("pr"))

    many = F.col("m") > 1
    ranges = [
        F.when(many & (F.col("hi") - F.col("lo") >= length), F.struct("lo", "hi", F.when(F.col("r0") != F.col("r1"), 2).otherwise(0).alias("kind"))),
        F.when(many & (F.col("r0") != F.col("r1")) & (F.col("hi") - F.col("lo") < length), F.struct("lo", "hi", F.lit(1).alias("kind"))),
        F.when(F.col("l") + F.col("r") > 0, F.struct((F.col("at") - F.col("l")).alias("lo"), (F.col("at") + F.col("r")).alias("hi"), F.when(F.col("across"), 2).otherwise(0).alias("kind"))),
        F.when(F.col("pl") + F.col("pr") > 0, F.struct((F.col("at") - F.col("pl")).alias("lo"), (F.col("at") + F.col("pr")).alias("hi"), F.lit(1).alias("kind"))),
    ]
    settled = classes.where("m > 1 or mixed").join(spans, ["h", "c"], "left").where("m > 1 or l is not null").select("h", "c", "m", "r0", "r1", "l", "r", "across", "pl", "pr")
    out = shared.drop("mixed").join(settled, ["h", "c"]).select("did", "rid", F.explode(F.array_compact(F.array(*ranges))).alias("x")).select("did", "rid", "x.*")
    if ends:
        # All strings of a context hold its place, so the first and the last say it all. Those of words are kept as (place, number), kind 3.
        known = ends[0]
        for x in ends[1:]:
            known = known.unionByName(x)
        hit = shared.drop("mixed").join(known.groupBy("h", "c", "rule", "across").agg(F.min("k1").alias("k1"), F.max("k2").alias("k2")), ["h", "c"])
        lo = F.col("at") - (length - gram) + F.col("k1")
        out = out.unionByName(hit.where("rule = 0").select("did", "rid", lo.cast("int").alias("lo"), (F.col("at") + gram + F.col("k2")).cast("int").alias("hi"), F.when(F.col("across"), 2).otherwise(0).alias("kind")))
        out = out.unionByName(hit.where("rule = 1 and across").select("did", "rid", F.col("at").alias("lo"), F.explode(F.array("k1", "k2")).alias("hi"), F.lit(3).alias("kind")))
    return docs, inside.unionByName(out)


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def judged(raw: bytes, ranges: list[dict], least: int) -> tuple[list[list[int]], list[list[int]]]:
    """Merged spans of repeated strings, and of passages, of one text."""
    spans = merged([(r["lo"], r["hi"]) for r in ranges if r["kind"] in (0, 2)])
    maybe = [(r["lo"], r["hi"]) for r in ranges if r["kind"] == 1] + merged([(r["lo"], r["hi"]) for r in ranges if r["kind"] == 2])
    passages = []
    if maybe or any(r["kind"] == 3 for r in ranges):
        starts, ends = word_edges(raw)
        passages = [(lo, hi) for lo, hi in maybe if np.searchsorted(starts, hi, "left") - np.searchsorted(ends, lo, "right") >= least]
        for r in ranges:
            if r["kind"] == 3:  # `least` words, the first of them so many before the word at the place
                first = int(np.searchsorted(starts, r["lo"])) - least + 1 + r["hi"]
                passages.append((int(starts[max(0, first)]), int(ends[min(len(ends), first + least) - 1])))
    return spans, merged(passages)


def cut(df: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = (), as_text: bool = False, passages: bool = False) -> DataFrame:
    """(doc_id, *carry, n_bytes, spans, passages, kept) for every row: byte spans of repeated strings and of passages that another
    document has, merged and in order, and the bytes left without the spans (passages=True: and without the passages).

    as_text gives kept as a string, without the parts of characters that a cut went through.
    """
    docs, spans = repeated(df, length, carry=carry)
    ranges = stored(spans.groupBy("did", "rid").agg(F.collect_set(F.struct("lo", "hi", "kind")).alias("ranges")), "ranges")
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    names = ["doc_id", *carry, "n_bytes", "spans", "passages", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cut_out, told, kept = [], [], [], []
            *held, texts, lists = batch.columns
            for text, found in zip(texts.to_pylist(), lists.to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                gone, said = judged(raw, found, PASSAGE_WORDS) if found else ([], [])
                edges = [0, *[x for m in (merged([*map(tuple, gone), *map(tuple, said)]) if passages else gone) for x in m], len(raw)]
                left = b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                n.append(len(raw))
                cut_out.append([{"lo": lo, "hi": hi} for lo, hi in gone])
                told.append([{"lo": lo, "hi": hi} for lo, hi in said])
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            yield pa.RecordBatch.from_arrays([*held, pa.array(n, pa.int64()), pa.array(cut_out, kind), pa.array(told, kind), pa.array(kept, pa.string() if as_text else pa.binary())], names=names)

    span = T.ArrayType(T.StructType().add("lo", "integer").add("hi", "integer"))
    schema = docs.select("doc_id", *carry).schema.add("n_bytes", T.LongType()).add("spans", span).add("passages", span).add("kept", T.StringType() if as_text else T.BinaryType())
    ids = ranges.select("did", "rid")
    if ids.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS:
        # Only texts with spans travel.
        ids = F.broadcast(ids)
        plain = docs.join(ids, ["did", "rid"], "left_anti").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType))
        whole = docs.join(ids, ["did", "rid"], "left_semi").join(ranges.hint("shuffle_merge"), ["did", "rid"]).unionByName(plain)
    else:
        whole = docs.join(ranges, ["did", "rid"], "left")
    return in_batches(whole.select("doc_id", *carry, "text", "ranges"), run, schema)

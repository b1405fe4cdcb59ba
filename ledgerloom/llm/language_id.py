"""Language ID: a bidirectional gated recurrent network over bytes, in numpy, trained by backpropagation through time.

A text is read as segments of SEGMENT bytes. In each, one network runs forward and one backward; every byte's two
states give label probabilities, and a document's are the mean over all its bytes. fit() learns on about SAMPLE_DOCS labelled texts (twice
as many at most, LEAST a label if labels are many), PER_DOC segments from random places of each, chosen by hash; predict() reads every byte of every text.

Null texts and texts without a letter (Unicode category L) are `und` with score 1; so is every text where no label could
be learnt. Labels are never read in prediction. Very long texts are read whole, CHUNK_CHARS of texts at a time or one text.
An empty table gives no rows. Repeated rows are predicted one by one; ties go to the label that sorts first. Other columns are carried; columns named
lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, in_batches

HIDDEN = 8
SEGMENT = 64
SAMPLE_DOCS = 3000
LEAST = 50  # rows of a label, where there are so many
PER_DOC = 4
STEPS, BATCH, RATE = 500, 192, 0.012
ROWS = 4096  # segments that one pass holds
CHUNK_CHARS = 1 << 18
LETTER = regex.compile(r"\p{L}")
PAD = 256


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters: per direction, gate inputs by byte (257, 3h) and recurrent weights (h, 3h); the read-out."""

    labels: list[str]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[d + "x"] = rng.normal(0, 0.4, (257, 3 * hidden))
            p[d + "h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p["o"] = rng.normal(0, 0.3, (2 * hidden, len(labels)))
        p["c"] = np.zeros(len(labels))
        return cls(labels, {k: v.astype(np.float32) for k, v in p.items()})

    def states(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (time, rows, h) of direction d over bytes x (time, rows), and what backpropagation needs."""
        wx, wh = self.p[d + "x"], self.p[d + "h"]
        h = wh.shape[0]
        s = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((x.shape[0], x.shape[1], h), np.float32)
        kept = []
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            gx, gh = wx[x[t]], s @ wh
            zr = sigmoid(gx[:, : 2 * h] + gh[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gx[:, 2 * h :] + r * gh[:, 2 * h :])
            kept.append((t, s, z, r, n, gh[:, 2 * h :]))
            s = n + z * (s - n)
            out[t] = s
        return out, kept

    def fast_states(self, x: np.ndarray, d: str) -> np.ndarray:
        """The same states as (time, h, rows), with little temporary memory: what prediction runs."""
        h = self.p[d + "h"].shape[0]
        wx = np.ascontiguousarray(self.p[d + "x"].T).copy()
        wh = np.ascontiguousarray(self.p[d + "h"].T).copy()
        wx[: 2 * h] *= 0.5  # sigmoid(v) = (1 + tanh(v / 2)) / 2
        wh[: 2 * h] *= 0.5
        rows = x.shape[1]
        s = np.zeros((h, rows), np.float32)
        out = np.empty((x.shape[0], h, rows), np.float32)
        gx, gh, n = np.empty((3 * h, rows), np.float32), np.empty((3 * h, rows), np.float32), np.empty((h, rows), np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            np.take(wx, x[t], axis=1, out=gx, mode="clip")
            np.matmul(wh, s, out=gh)
            zr = gx[: 2 * h]
            zr += gh[: 2 * h]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            np.multiply(zr[h:], gh[2 * h :], out=n)
            n += gx[2 * h :]
            np.tanh(n, out=n)
            o = out[t]
            np.subtract(s, n, out=o)
            o *= zr[:h]
            o += n
            s = o
        return out

    def position_sums(self, x: np.ndarray) -> np.ndarray:
        """(rows, labels): label probabilities added up over the positions of each segment that hold a byte; x: (time, rows)."""
        f, b = self.fast_states(x, "f"), self.fast_states(x, "b")
        h = f.shape[1]
        wf, wb = np.ascontiguousarray(self.p["o"][:h].T), np.ascontiguousarray(self.p["o"][h:].T)
        total = np.zeros((len(self.labels), x.shape[1]), np.float32)
        for t in range(x.shape[0]):
            v = wf @ f[t]
            v += wb @ b[t]
            v += self.p["c"][:, None]
            v -= v.max(0)
            np.exp(v, out=v)
            v *= (x[t] != PAD) / v.sum(0)
            total += v
        return total.T

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradient through time."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        (f, kf), (b, kb) = self.states(x, "f"), self.states(x, "b")
        h = f.shape[2]
        both = np.concatenate([f, b], axis=2)
        v = both @ self.p["o"] + self.p["c"]
        v = np.exp(v - v.max(2, keepdims=True))
        v /= v.sum(2, keepdims=True)
        there = (x != PAD).astype(np.float32)
        n = max(1.0, float(there.sum()))
        loss = float(-(np.log(v[:, np.arange(len(y)), y] + 1e-9) * there).sum() / n)
        v[:, np.arange(len(y)), y] -= 1
        v *= (there / n)[:, :, None]
        g["o"] = both.reshape(-1, 2 * h).T @ v.reshape(-1, v.shape[2])
        g["c"] = v.sum((0, 1))
        back = v @ self.p["o"].T
        for d, kept, part in (("f", kf, back[:, :, :h]), ("b", kb, back[:, :, h:])):
            wh = self.p[d + "h"]
            ds = np.zeros((x.shape[1], h), np.float32)
            for t, s, z, r, c, gc in reversed(kept):
                ds = ds + part[t]
                dn = ds * (1 - z) * (1 - c * c)
                dz = ds * (s - c) * z * (1 - z)
                dr = dn * gc * r * (1 - r)
                gx = np.concatenate([dz, dr, dn], axis=1)
                gh = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g[d + "x"], x[t], gx)
                g[d + "h"] += s.T @ gh
                ds = ds * z + gh @ wh.T
        return loss, g


def train(segments: list[bytes], y: np.ndarray, labels: list[str], steps: int = STEPS, seed: int = 0) -> Network:
    """Adam over random batches of segments."""
    net, rng = Network.fresh(labels, seed=seed), np.random.default_rng(seed)
    if not segments or len(labels) < 2:
        return net
    x = np.full((SEGMENT, len(segments)), PAD, np.int64)
    for i, s in enumerate(segments):
        x[: len(s), i] = np.frombuffer(s, np.uint8)
    groups = [np.flatnonzero(y == k) for k in range(len(labels))]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, max(1, BATCH // len(labels))) for g in groups])
        _, g = net.gradient(x[:, pick], y[pick])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * min(1.0, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / steps))
        for k in net.p:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v2[k] = 0.99 * v2[k] + 0.01 * a * a
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def fit(df: DataFrame, text: str = "text", label: str = "lang", docs: int = SAMPLE_DOCS, key: str = "doc_id") -> Network:
    """A network from about `docs` labelled rows of df, chosen by a hash of their key before their texts are read: an equal
    number for each label, LEAST at least; of a label with fewer rows, all."""
    known = df.where(F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(label).cast("string")).count().collect()}  # a row for each language
    each = max(LEAST, docs // max(1, len(sizes)))
    cuts = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(min(1.0, each / n) * (1 << 20)))]) if sizes else F.create_map(F.lit(""), F.lit(0))
    picked = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.element_at(cuts, F.col(label).cast("string"))).where(F.col(text).rlike(r"\p{L}"))
    # Whole texts stay on the executors: PER_DOC segments of each picked row come to the driver.
    raw = F.encode(F.col(text).cast("string"), "UTF-8")
    n = F.octet_length(raw)
    place = lambda k: F.pmod(F.xxhash64(F.col(text), F.lit(k)), F.greatest(n - SEGMENT + 1, F.lit(1))) + 1
    segments = F.array(*[F.substring(raw, place(k).cast("int"), F.lit(SEGMENT)) for k in range(PER_DOC)])
    rows = picked.select(F.col(label).cast("string"), segments).limit(2 * max(docs, each * len(sizes)) + 100).collect()
    rows.sort(key=lambda r: (r[0], [bytes(s) for s in r[1]]))  # the same network whatever order the rows came in
    labels = sorted({r[0] for r in rows})
    return train([bytes(s) for r in rows for s in r[1]], np.array([labels.index(r[0]) for r in rows for _ in r[1]], np.int64), labels)


def probabilities(net: Network, texts: list[str]) -> np.ndarray:
    """(documents, labels) mean label probabilities over all bytes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    n = np.array([-(-len(r) // SEGMENT) for r in raw])
    flat = np.full(int(n.sum()) * SEGMENT, PAD, np.int16)
    at = 0
    for r, k in zip(raw, n.tolist()):
        flat[at : at + len(r)] = np.frombuffer(r, np.uint8)
        at += k * SEGMENT
    segments = flat.reshape(-1, SEGMENT)
    sums = [net.position_sums(np.ascontiguousarray(segments[i : i + ROWS].T).astype(np.intp)) for i in range(0, len(segments), ROWS)]
    out = np.zeros((len(texts), len(net.labels)))
    if sums:
        np.add.at(out, np.repeat(np.arange(len(texts)), n), np.concatenate(sums))
    return out / np.maximum(1, [len(r) for r in raw])[:, None]


def predict(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """df with lang_pred and score."""
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = df.select(*names).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is not None and LETTER.search(t) else "" for t in batch.column(names.index(text)).cast(pa.string()).to_pylist()]
            for a, b in chunks(list(map(len, texts)), CHUNK_CHARS):
                p = probabilities(net, texts[a:b]) if net.labels else np.zeros((b - a, 1))
                best = p.argmax(1)
                some = [t != "" and bool(net.labels) for t in texts[a:b]]
                lang = [net.labels[k] if s else "und" for k, s in zip(best.tolist(), some)]
                score = [min(1.0, float(v)) if s else 1.0 for v, s in zip(p[np.arange(b - a), best], some)]
                cols = [batch.column(i).slice(a, b - a) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return in_batches(df.select(*names), run, schema)

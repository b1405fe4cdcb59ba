"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk.

Trusted positives are all documents labelled 1, the unlabelled set is all web text, with labels not looked at; the
class prior, the share of good text among it, is the share of 1 among the labels. A logistic model over counts of each whole text
minimises prior * R+(P) + max(0, R-(U) - prior * R-(P)). That is the greater of two convex risks, so Newton's steps on both find its
least value: where the second part would turn negative, a step is held to the border at which it is zero. The
prior also places the border: the share `prior` of the unlabelled set scores CUT or more. Rows labelled 0 are used for
nothing but the prior.

All features are Spark expressions, one projection. Every row is learnt from: edges are quantiles of counts over all rows, in
cells of 1/GRID of a doubling; rows then count by their steps, and each pass of the fit adds gradients and curvatures over all of
them, of which sums alone (their size depends on the edges only) come to the driver; the border counts all rows by score, in cells of 1/FINE.
Null texts count as empty; empty texts get a score too; very long texts are scored whole. Labels other than 1 and 0 count as
none; a document with several is positive only if all are 1, and one with several texts teaches the least of them (by features).
Labels of no document count in the prior alone. Repeated rows are scored one by one and weigh as many in the unlabelled set; an
empty table gives no rows; ties of a feature with an edge fall below it. score() carries other
columns, and replaces those named score or as a feature; fit() reads its key, text and label only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, stored, text_or_empty, words

STEPS, DECAY = 60, 1e-4
GRID, FINE = 256, 512
SHARES = [0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98, 0.995, 1.0]
CUT = 0.3  # the score of the border between good and bad
BLANKS = " \t\n\x0b\x0c\r"
MARKS = "#*$%&|<>@=_~^{}[]\\/+"
FEATURES = ("marks", "bars", "shouts", "capitals", "digits", "variety", "same_lines", "word_length", "log_words", "stops", "blank")


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of FEATURES: ratios that do not grow with the text."""
    held = df.withColumn("__t", text_or_empty(text)).withColumn("__w", words(F.col("__t"))).withColumn("__l", F.split("__t", "\n"))
    gone = lambda signs: F.length("__t") - F.length(F.translate("__t", signs, ""))
    n = F.greatest(F.size("__w"), F.lit(1))
    upper = gone("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÁÍÓÚÑ")
    cols = {
        "marks": gone(MARKS) / n,
        "bars": gone("|") / n,
        "shouts": gone("!?") / n,
        "capitals": upper / F.greatest(F.length("__t"), F.lit(1)),
        "digits": gone("0123456789") / n,
        "variety": F.size(F.array_distinct("__w")) / F.pow(n.cast("double"), F.lit(0.8)),
        "same_lines": 1 - F.size(F.array_distinct("__l")) / F.size("__l"),
        "word_length": F.length(F.translate("__t", BLANKS, "")) / n,
        "log_words": F.log1p(F.size("__w").cast("double")),
        "stops": gone(".,;:") / n,
        "blank": (F.size("__w") == 0).cast("double"),
    }
    return held.withColumns({k: v.cast("double") for k, v in cols.items()}).drop("__t", "__w", "__l")


@dataclass
class Model:
    """Values are cut at quantiles into steps; a step has a weight."""

    edges: dict[str, list[float]]
    weights: dict[str, list[float]]
    bias: float
    prior: float

    def column(self) -> Column:
        z = F.lit(self.bias)
        for name, edges in self.edges.items():
            w = self.weights[name]
            step = F.lit(w[0])
            for edge, value in zip(edges, w[1:]):
                step = F.when(F.col(name) > edge, F.lit(value)).otherwise(step)
            z = z + step
        return 1 / (1 + F.exp(-z))


def descent(sums, size: int, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights (the last is the bias) of least non-negative risk. sums(w): of positives and of unlabelled rows, each by share, the means of
    softplus(-z) (positives), softplus(z), sigmoid(z) x and sigmoid(z) sigmoid(-z) x x', and the positives' mean x."""
    decay = np.append(np.full(size - 1, DECAY), 0.0)
    w = best = np.zeros(size)
    least, move, length = np.inf, np.zeros(size), 1.0
    for _ in range(steps):
        (loss, p_soft, p_mean, p_grad, p_curve), (u_soft, u_grad, u_curve) = sums(w)
        positive, negative = prior * loss, u_soft - prior * p_soft
        risk = positive + max(0.0, negative) + (decay * w * w).sum() / 2
        if not risk < least:  # too far: half the way
            length /= 2
            if length < 1e-3:
                break
            w = best + length * move
            continue
        gain, least, best, length = least - risk, risk, w, 1.0
        if gain < 1e-7:
            break
        g_positive, g_negative = prior * (p_grad - p_mean), u_grad - prior * p_grad

        def newton(share: float) -> np.ndarray:
            """The step for positive + share * negative."""
            curve = prior * (1 - share) * p_curve + share * u_curve + np.diag(decay + 1e-9)
            return -np.linalg.solve(curve, g_positive + share * g_negative + decay * best)

        low, high = 0.0, 1.0
        if negative + g_negative @ newton(1.0) < 0:  # the share at which the negative part stays zero
            for _ in range(40):
                at = (low + high) / 2
                low, high = (low, at) if negative + g_negative @ newton(at) < 0 else (at, high)
        move = newton(high)
        w = best + move
    return best


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def non_negative_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """descent() over rows in memory."""
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))

    def sums(w):
        (zp, sp), (zu, su) = ((z := x @ w, sigmoid(z)) for x in (p, u))
        curve = lambda x, s: (x.T * (s * (1 - s))) @ x / len(x)
        return (softplus(-zp).mean(), softplus(zp).mean(), p.mean(0), p.T @ sp / len(p), curve(p, sp)), (softplus(zu).mean(), u.T @ su / len(u), curve(u, su))

    return descent(sums, p.shape[1], prior, steps)


def edges_of(rows: DataFrame) -> list[list[float]]:
    """Of each feature, the quantiles SHARES of the positives and of the unlabelled rows: counts of all rows (FEATURES, p, u) in cells; an
    edge is the largest value of its cell."""
    each = rows.select("p", "u", F.posexplode(F.array(*FEATURES)).alias("at", "x"))
    cell = F.when(F.col("x") > 0, F.floor(F.log2("x") * GRID)).otherwise(-(1 << 20))
    top = lambda k: F.max(F.when(F.col(k) > 0, F.col("x"))).alias(f"{k}_top")
    cells = each.groupBy("at", cell.alias("cell")).agg(F.sum("p").alias("p"), F.sum("u").alias("u"), top("p"), top("u")).collect()
    out: list[set] = [set() for _ in FEATURES]
    for i in range(len(FEATURES)):
        mine = sorted((r for r in cells if r["at"] == i), key=lambda r: r["cell"])
        for k in ("p", "u"):
            held = [r for r in mine if r[k]]
            below = np.cumsum([r[k] for r in held])
            out[i] |= {held[min(n, len(held) - 1)][f"{k}_top"] for n in np.searchsorted(below, np.array(SHARES) * below[-1] - 1e-6, "left")}
    return [sorted(x) for x in out]


def summed(coded: DataFrame, sizes: list[int]):
    """sums() of descent() over stored rows (c0, c1, ..., p, u): the steps of a row's features, and for how many it stands."""
    first = np.cumsum([0, *sizes])
    d, pairs = int(first[-1]) + 1, list(combinations_with_replacement(range(len(sizes)), 2))
    n = {k: float(v) for k, v in coded.agg(F.sum("p").alias("p"), F.sum("u").alias("u")).first().asDict().items()}

    def add(codes: list[np.ndarray], weight: np.ndarray, total: np.ndarray) -> None:
        """Adds weighted counts of steps to total[-1] (the bias is everywhere)."""
        for i, c in enumerate(codes):
            total[first[i] : first[i + 1]] += np.bincount(c, weight, sizes[i])
        total[-1] += weight.sum()

    def cross(codes: list[np.ndarray], weight: np.ndarray, total: np.ndarray) -> None:
        add(codes, weight, total[-1])
        for i, j in pairs:
            total[first[i] : first[i + 1], first[j] : first[j + 1]] += np.bincount(codes[i] * sizes[j] + codes[j], weight, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    width = 3 + 3 * d + 2 * d * d

    def views(flat: np.ndarray):
        grads, curves = flat[3 : 3 + 3 * d].reshape(3, d), flat[3 + 3 * d :].reshape(2, d, d)
        return flat[:3], grads, curves

    def sums(w):
        def part(batches):
            flat = np.zeros(width)
            losses, grads, curves = views(flat)
            for b in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
                codes, p, u = columns[:-2], columns[-2], columns[-1]
                z = w[-1] + sum(w[first[i] + c] for i, c in enumerate(codes))
                s, up = sigmoid(z), softplus(z)
                losses += (p @ softplus(-z), p @ up, u @ up)
                for k, weight in enumerate((p, p * s, u * s)):
                    add(codes, weight, grads[k])
                for k, weight in enumerate((p, u)):
                    cross(codes, weight * s * (1 - s), curves[k])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["total"])

        def both(batches):
            flat = np.zeros(width)
            for b in batches:
                for x in b.column(0).to_pylist():
                    flat += np.frombuffer(x)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["total"])

        # Partial sums are added by four tasks, so that the driver gets four, however many parts there are.
        parts = in_batches(coded, part, "total binary", 20_000).repartition(4).mapInArrow(both, "total binary")
        flat = np.sum([np.frombuffer(r[0]) for r in parts.collect()], axis=0)
        losses, grads, curves = views(flat)
        for c in curves:
            c += np.triu(c, 1).T + np.tril(c, -1).T  # each pair was counted on one side
        return (losses[0] / n["p"], losses[1] / n["p"], grads[0] / n["p"], grads[1] / n["p"], curves[0] / n["p"]), (losses[2] / n["u"], grads[2] / n["u"], curves[1] / n["u"])

    return sums, d


def border_of(z: np.ndarray, prior: float, many: np.ndarray | None = None) -> float:
    """The value that leaves the share `prior` of the unlabelled set above it."""
    order = np.argsort(z)
    z, below = z[order], np.cumsum(np.ones(len(z)) if many is None else many[order])
    k = min(len(z) - 1, max(1, int(np.searchsorted(below, round((1 - prior) * below[-1]), "left")) + 1)) if len(z) > 1 else 0
    return float((z[max(0, k - 1)] + z[k]) / 2)


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, FEATURES) of every row, written once: texts are read by one pass."""
    return stored(features(docs.select(key, text), text).select(key, *FEATURES), "features")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """From documents (key, text) and labels (key, label). The unlabelled set is all documents, whatever their labels."""
    return learnt(measured(docs, key, text), labels, label, key)


def learnt(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id") -> Model:
    """fit() from documents (key, FEATURES)."""
    known = labels.select(key, F.col(label).cast("int").alias("y")).where("y in (0, 1)").groupBy(key).agg(F.min("y").alias("y"))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, bad = count.get(1, 0), count.get(0, 0)
    prior = min(0.98, max(0.02, good / (good + bad))) if good + bad else 0.5
    positive = docs.join(known.where("y = 1").select(key), key).groupBy(key).agg(F.min(F.struct(*FEATURES)).alias("f")).select("f.*", F.lit(1).alias("p"), F.lit(0).alias("u"))
    rows = docs.select(*FEATURES, F.lit(0).alias("p"), F.lit(1).alias("u")).unionByName(positive)
    if not docs.limit(1).count() or not positive.limit(1).count():
        return Model({}, {}, float(np.log(prior / (1 - prior))), prior)
    edges = edges_of(rows)
    step = lambda name, e: reduce(Column.__add__, [(F.col(name) > x).cast("int") for x in e])
    codes = [f"c{i}" for i in range(len(FEATURES))]
    # Rows that are the same in every step come once, with their number.
    coded = rows.select(*[step(*x).alias(c) for c, x in zip(codes, zip(FEATURES, edges))], "p", "u").groupBy(*codes).agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    coded = stored(coded, "coded")
    sums, size = summed(coded, [len(e) + 1 for e in edges])
    w = descent(sums, size, prior).round(6)
    # The risk ranks; its prior says how much of the unlabelled set lies above the border, which scores CUT.
    bare, at = Model({}, {}, float(w[-1]), prior), 0
    for name, e in zip(FEATURES, edges):
        bare.edges[name], bare.weights[name] = e, w[at : at + len(e) + 1].tolist()
        at += len(e) + 1
    z = reduce(Column.__add__, [F.element_at(F.array(*map(F.lit, bare.weights[name])), F.col(c) + 1) for c, name in zip(codes, FEATURES)], F.lit(bare.bias))
    cells = coded.groupBy(F.round(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)) * FINE).alias("z")).agg(F.sum("u").alias("u")).where("u > 0").collect()
    border = border_of(np.array([r["z"] for r in cells]) / FINE, prior, np.array([r["u"] for r in cells], float))
    bare.bias += float(np.log(CUT / (1 - CUT))) - border
    return bare


def scored(measured: DataFrame, model: Model) -> DataFrame:
    """Rows that have FEATURES, with score in their place."""
    return measured.withColumn("score", model.column()).drop(*FEATURES)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score, 0 to 1."""
    return scored(features(df, text), model)

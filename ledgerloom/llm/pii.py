r"""PII detection with DataFrame expressions only.

Regular expressions propose spans, validators (ranges, digit counts, Luhn, mod 97) confirm them, and words
nearby, up to CONTEXT characters before a span and CONTEXT behind it (up to the next span of its kind), raise the score.
Base kinds (email, ip, card, phone) stay whatever their score; other kinds stay from KEEP_SCORE on. Offsets are code
points, end exclusive. Null and empty texts have no spans. Repeated rows are read one by one; of spans that start
together, the kind listed first comes first; find() and redact() carry other columns, and replace one that has the
result's name; report() reads doc_id and text only. Very long texts are read whole; an empty table gives no rows.

The patterns are linear forms of the stated ones: possessive loops, and a look-behind (or the end of the match
before) in place of retries inside a run, so that a run of 100,000 letters is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KEEP_SCORE = 0.5
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a pattern, cheap to search for, without which there is no match; "" for none
    base: bool
    score: float  # once confirmed
    words: str  # context that raises the score by BOOST
    mask: str


BOOST = 0.35
#: Kinds in the order in which they are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, "mail|contact|write|reach", "<EMAIL>"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "", True, 0.6, "ip|address|host|server", "<IP>"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])", "", True, 0.7, "card|visa|credit|pay", "<CARD>"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", True, 0.7, "phone|call|tel|mobile", "<PHONE>"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "", False, 0.8, "iban|account|bank|konto|cuenta|compte", "<IBAN>"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api[_-]?key)[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_-]{8,}+)", "", False, 0.6, "key|login|secret|auth", "<SECRET>"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.3, "ssn|social|security|tax", "<SSN>"),
)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the digits' Luhn sum ends in 0."""
    at = F.sequence(F.lit(0), F.length(number) - 1)

    def term(i: Column) -> Column:
        d = F.substr(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(at, F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if the account number, its first four signs moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    s = F.regexp_replace(iban, " ", "")
    s = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, (acc * 10 + v) % 97).otherwise((acc * 100 + v) % 97)

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        byte = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return s.rlike(f"\\A{byte}(?:\\.{byte}){{3}}\\z")
    if kind == "card":
        return luhn(digits(s))
    if kind == "phone":
        return F.length(digits(s)).between(10, 15)
    if kind == "iban":
        return mod97(s)
    if kind == "secret":  # a value, not a word
        return s.rlike("[0-9]")
    return F.lit(True)


def proposals(text: Column, k: Kind) -> Column:
    """Array of (start, ord, kind, end, score) of one kind: lengths of matches and of what lies between give the places."""
    empty = F.lit(None).cast("array<struct<start:int,stop:int,found:string,near:string>>")
    pieces = F.split(text, k.pattern, -1)
    pairs = F.zip_with(pieces, F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    pairs = F.zip_with(pairs, F.filter(pieces, lambda p, i: i > 0), lambda x, q: F.struct(x["p"].alias("p"), x["m"].alias("m"), q.alias("q")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        before = F.right(F.concat(acc["tail"], F.right(x["p"], F.lit(CONTEXT))), F.lit(CONTEXT))
        near = F.concat_ws("\n", before, F.left(x["q"], F.lit(CONTEXT)))
        one = F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("found"), near.alias("near"))
        tail = F.right(F.concat(before, x["m"]), F.lit(CONTEXT))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(stop.alias("pos"), tail.alias("tail"), F.concat(acc["out"], F.array(one)).alias("out")))

    first = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.coalesce(empty, F.expr("cast(array() as array<struct<start:int,stop:int,found:string,near:string>>)")).alias("out"))
    found = F.aggregate(pairs, first, step, lambda acc: acc["out"])
    kept = F.filter(found, lambda x: confirmed(k.name, x["found"]))
    score = lambda x: F.lit(k.score) + F.when(F.lower(x["near"]).rlike(k.words), F.lit(BOOST)).otherwise(F.lit(0.0))
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit([q.name for q in KINDS].index(k.name)).alias("ord"), F.lit(k.name).alias("kind"), x["stop"].alias("stop"), F.round(F.least(F.lit(1.0), score(x)), 2).alias("score")))
    if not k.base:
        spans = F.filter(spans, lambda x: x["score"] >= KEEP_SCORE)
    there = text.rlike(k.pattern)
    if k.needs:
        there = F.contains(text, F.lit(k.needs)) & there
    return F.when(there, spans).otherwise(F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,stop:int,score:double>>)"))


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with the array `out` of struct(start, ord, kind, stop, score), ordered by start, then kind as listed."""
    t = text_or_empty(text)
    return df.withColumns({f"__{k.name}": proposals(t, k) for k in KINDS}).withColumn(
        out, F.sort_array(F.concat(*[F.col(f"__{k.name}") for k in KINDS]))
    ).drop(*[f"__{k.name}" for k in KINDS])


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's mask; of overlapping spans, the first start's mask stands for all."""
    names = F.create_map(*[x for k in KINDS for x in (F.lit(k.name), F.lit(k.mask))])

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(text, acc["pos"] + 1, F.greatest(F.lit(0), s["start"] - acc["pos"])), F.element_at(names, s["kind"]))
        return F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), F.when(s["start"] >= acc["pos"], fresh).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with personal data in its text masked; null texts stay null."""
    return find(df, text, "__pii").withColumn(text, F.when(F.col(text).isNotNull(), masked(F.col(text), F.col("__pii")))).drop("__pii")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(df: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, hash of the base spans, all spans; whether there is any, and the best score."""
    f = find(df.select("doc_id", "text"))
    base = [k.name for k in KINDS if k.base]
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return f.select(
        "doc_id", *[count(n) for n in base], F.sha2(digest(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"),
        (F.size("pii") > 0).alias("flagged"), F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )

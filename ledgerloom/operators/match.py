"""Reconciliation of observations of one movement: three sweeps by exact keys, sticky candidates, merges.

Groups are never paired all with all: each has its least id as centre of a star, found by a min per key (combined
before the shuffle) and a join back that AQE may split where a key is hot. Joins are on struct-free plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

PAIR = ["left_ref", "right_ref"]


def open_rows(tx: DataFrame) -> DataFrame:
    return tx.where((F.col("transaction_state") == "ACTIVE") & (F.col("reconciliation_state") == "UNRECONCILED"))


def star_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(left, right) structs: in each group of equal keys, none NULL, the least id with every other."""
    have = rows.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, "id", "direction", "counterparty", "source_id")
    centre = have.groupBy(*keys).agg(F.min_by(F.struct("id", "direction", "counterparty", "source_id"), "id").alias("left"), F.count("*").alias("size")).where("size > 1")
    return have.join(centre, keys).where(F.col("id") > F.col("left.id")).select("left", F.struct("id", "direction", "counterparty", "source_id").alias("right"))


def pairs_of_two(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of exactly two rows from two sources."""
    have = rows.where(" and ".join(f"{k} is not null" for k in keys))
    row = F.struct("id", "direction", "counterparty", "source_id")
    groups = have.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.coalesce("source_id", F.lit(""))).alias("s0"), F.max(F.coalesce("source_id", F.lit(""))).alias("s1"), F.min_by(row, "id").alias("left"), F.max_by(row, "id").alias("right"))
    return groups.where("n = 2 and s0 <> s1").select("left", "right")


def other_source() -> Column:
    return F.coalesce(F.col("left.source_id"), F.lit("")) != F.coalesce(F.col("right.source_id"), F.lit(""))


def same_side() -> Column:
    return V.internal(F.col("left.counterparty")) == V.internal(F.col("right.counterparty"))


#: The sweeps in order, the fields that make their blocks, and those of which a block is a star.
SWEEPS = ("tracking_key", "composite", "weak")
KEYS = {"tracking_key": ["tracking_key"], "composite": ["currency", "amount_minor", "direction", "party", "day"], "weak": ["currency", "amount_minor", "direction"]}
STARS = ("tracking_key", "weak")
#: What a sweep compares in the rows of a pair, beside their ids.
COMPARED = {"tracking_key": ("direction", "counterparty"), "composite": ("counterparty", "source_id"), "weak": ("counterparty",)}


def keyed(rows: DataFrame) -> DataFrame:
    """rows with party and day, which composite blocks need."""
    return rows.withColumns({"party": V.party(F.col("merchant"), F.col("counterparty")), "day": V.day_in_zone(F.col("occurred_at"))})


def decided(pairs: DataFrame, sweep: str) -> DataFrame:
    """Candidates of pairs (left, right) that a sweep found."""
    both, alike = (F.col("left.direction") == F.col("right.direction")) & same_side(), same_side()
    status = {"tracking_key": F.when(both, "MATCH"), "composite": F.when(alike, "MATCH"), "weak": F.when(alike, "AMBIGUOUS")}[sweep].otherwise("NO_MATCH")
    return pairs.select(F.col("left.id").alias("left_ref"), F.col("right.id").alias("right_ref"), status.alias("status"), F.lit(sweep).alias("basis"))


def tracking(rows: DataFrame) -> DataFrame:
    return decided(star_pairs(rows, KEYS["tracking_key"]), "tracking_key")


def composite(rows: DataFrame) -> DataFrame:
    return decided(pairs_of_two(keyed(rows), KEYS["composite"]), "composite")


def weak(rows: DataFrame) -> DataFrame:
    pairs = star_pairs(rows.withColumn("way", F.col("direction")), ["currency", "amount_minor", "way"])
    return decided(pairs, "weak")


def new_candidates(found: DataFrame, prior: DataFrame) -> DataFrame:
    """A pair decided before is never decided again."""
    return found.join(prior.select(*PAIR), PAIR, "left_anti")


def merge_problems(tx: DataFrame, candidates: DataFrame) -> DataFrame:
    """(left_ref, right_ref, problem) of MATCH candidates that may not be merged: ids out of order or equal, and rows that are not
    there or not active."""
    state = tx.select(F.col("id"), (F.col("transaction_state") == "ACTIVE").alias("ok"))
    hits = candidates.where("status = 'MATCH'").select(*PAIR)
    for side in PAIR:
        hits = hits.join(state.select(F.col("id").alias(side), F.col("ok").alias(f"{side}_ok")), side, "left")
    bad = F.array_compact(F.array(
        F.when(F.col("left_ref") == F.col("right_ref"), "SELF"), F.when(F.col("left_ref") > F.col("right_ref"), "ORDER"),
        F.when(~F.coalesce("left_ref_ok", F.lit(False)), "SURVIVOR_NOT_ACTIVE"), F.when(~F.coalesce("right_ref_ok", F.lit(False)), "SUPERSEDED_NOT_ACTIVE"),
    ))
    return hits.select(*PAIR, F.explode(bad).alias("problem"))


def merged(tx: DataFrame, candidates: DataFrame) -> DataFrame:
    """tx after its MATCH candidates: the smaller id survives reconciled, the other is superseded by it."""
    match = candidates.where("status = 'MATCH'")
    survivors = match.select(F.col("left_ref").alias("id"), F.lit(True).alias("won")).distinct()
    losers = match.groupBy(F.col("right_ref").alias("id")).agg(F.min("left_ref").alias("winner"))
    out = tx.join(survivors, "id", "left").join(losers, "id", "left")
    hit = F.col("won").isNotNull() | F.col("winner").isNotNull()
    return out.withColumns({
        "reconciliation_state": F.when(hit, "RECONCILED").otherwise(F.col("reconciliation_state")),
        "transaction_state": F.when(F.col("winner").isNotNull(), "SUPERSEDED").otherwise(F.col("transaction_state")),
        "superseded_by": F.coalesce("winner", "superseded_by"),
    }).drop("won", "winner")


def run(tx: DataFrame, prior: DataFrame | None = None, cut=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(tx, candidates) after the three sweeps, each over what the one before left open. cut() may write between sweeps."""
    known = prior
    for sweep in (tracking, composite, weak):
        found = sweep(open_rows(tx))
        fresh = cut(new_candidates(found, known) if known is not None else found)
        known = fresh if known is None else known.unionByName(fresh)
        if sweep is not weak:
            tx = cut(merged(tx, fresh))
    return tx, known


def drain(tx: DataFrame, cut, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """Runs until one adds no candidate; cut() writes each step's tables, so that plans do not grow."""
    known, before = None, 0
    for _ in range(most):
        tx, known = run(tx, known, cut)
        known = cut(known)
        now = known.count()
        if now == before:
            return tx, known
        before = now
    raise RuntimeError("reconciliation did not settle")


def provenance_union(bridge: DataFrame, candidates: DataFrame) -> DataFrame:
    """(transaction_id, evidence_id) with the evidence of each superseded row added to its survivor's."""
    moved = bridge.join(candidates.where("status = 'MATCH'"), F.col("transaction_id") == F.col("right_ref")).select(F.col("left_ref").alias("transaction_id"), "evidence_id")
    return bridge.unionByName(moved).distinct()

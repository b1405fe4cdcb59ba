"""Lookups between evidence, claims and transactions, as joins over plain key columns.

Each gives one row per key of its left side or per match, never a product; what is aggregated is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracking_keys(fields: DataFrame, key: str = "evidence_id") -> DataFrame:
    """(key, tracking_key): the least tracking key that the key's claims state; keys without one are left out."""
    return fields.where((F.col("field_name") == "tracking_key") & F.col("value_text").isNotNull()).groupBy(key).agg(F.min("value_text").alias("tracking_key"))


def source_of(transactions: DataFrame, evidence: DataFrame, on: str, source: str = "source_id") -> DataFrame:
    """Every transaction key with the least source of its evidence, NULL where it has none."""
    least = evidence.groupBy(on).agg(F.min(source).alias("source_id"))
    return transactions.select(on).join(least, on, "left")


def confidences(fields: DataFrame, names: list[str], key: str = "evidence_id") -> DataFrame:
    """(key, <name>_confidence ...): for each field the confidence that the first claim holding it states; keys without any stay.

    Only rows of the names are sorted; the keys of the others come as a hash aggregate."""
    pick = lambda n: F.min_by(F.when(F.col("field_name") == n, F.col("confidence")), F.when(F.col("field_name") == n, F.col("claim_id"))).alias(f"{n.removesuffix('_minor')}_confidence")
    own = fields.where(F.col("field_name").isin(*names)).groupBy(key).agg(*[pick(n) for n in names])
    every = fields.groupBy(key).agg(F.count("*").alias("__n")).select(F.col(key).alias("__key"))
    return every.join(own, F.col("__key").eqNullSafe(F.col(key)), "left").select(F.col("__key").alias(key), *[c for c in own.columns if c != key])


def provenance(transactions: DataFrame, bridge: DataFrame, on: str, evidence: str = "evidence_id") -> DataFrame:
    """Every transaction key with its sorted, distinct evidence ids; an empty array where it has none."""
    ids = bridge.groupBy(on).agg(F.array_sort(F.collect_set(evidence)).alias("evidence_ids"))
    return transactions.select(on).join(ids, on, "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))


def active_claims(claims: DataFrame, current: DataFrame, on: str) -> DataFrame:
    """Claims of current interpretations only."""
    return claims.join(current.select(on), on, "left_semi")


def claim_counts(evidence: DataFrame, claims: DataFrame, on: str) -> DataFrame:
    """Every artifact with the number of its claims: those without a claim stay, with 0."""
    n = claims.groupBy(on).agg(F.count("*").alias("claims"))
    return evidence.select(on).join(n, on, "left").withColumn("claims", F.coalesce("claims", F.lit(0)))


def victims(transactions: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """Transactions that rest on something that is gone."""
    return transactions.join(gone.select(on), on, "left_semi")

"""Idempotent writes as set operations: what a constraint refuses elsewhere is an anti-join here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import cut
from ..schemas import CLAIM_FIELDS


def insert_if_absent(new: DataFrame, stored: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows to append: the first of each key in the batch, none whose key is stored."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
    return first.join(stored.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def event_body(rows: DataFrame, kind: str, payload: list[str | Column], at: str) -> DataFrame:
    """(type, payload, occurred_at): a JSON payload, absent fields left out."""
    return rows.select(F.lit(kind).alias("type"), F.to_json(F.struct(*payload)).alias("payload"), F.col(at).alias("occurred_at"))


def numbered(bodies: DataFrame, after: int = 0) -> DataFrame:
    """(seq, type, payload, occurred_at): numbers without gaps that follow `after`, by time, payload and kind.

    Numbering counts rows per partition of the order first, so no task sees all rows.
    """
    order = ["occurred_at", "payload", "type"]
    placed = bodies.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    placed = cut(placed)  # counted and numbered from one sampling of the ranges
    placed = placed.withColumns({"p": F.shiftright("m", 33), "i": F.col("m").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("p").agg(F.count("*").alias("c"))
    starts = sizes.select("p", (F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("s"))
    out = placed.join(F.broadcast(starts), "p")  # a row per partition
    return out.select((F.col("s") + F.col("i") + 1 + after).alias("seq"), "type", "payload", "occurred_at")


def events_of(rows: DataFrame, kind: str, payload: list[str], at: str, after: int = 0) -> DataFrame:
    """Domain events of one kind, numbered."""
    return numbered(event_body(rows, kind, payload, at), after)


def compare_and_swap(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """slots (evidence_id, current) after requests (evidence_id, expected, next): NULL expected takes a free slot, others
    must name the current one; of several winners of a slot the least `next` gets it."""
    free = wanted.where("expected is null").join(slots.select("evidence_id"), "evidence_id", "left_anti").groupBy("evidence_id").agg(F.min("next").alias("current"))
    swap = wanted.where("expected is not null").join(slots, "evidence_id").where("expected = current").groupBy("evidence_id").agg(F.min("next").alias("next"))
    kept = slots.join(swap, "evidence_id", "left").select("evidence_id", F.coalesce("next", "current").alias("current"))
    return kept.unionByName(free)


def retire(tx: DataFrame, claim_tx: DataFrame, membership: DataFrame, gone: DataFrame) -> DataFrame:
    """Active transactions that rest on claims of the retired interpretations (gone: interpretation_id) become SUPERSEDED, without a successor."""
    victims = claim_tx.join(membership.join(gone, "interpretation_id", "left_semi"), "claim_id", "left_semi").select(F.col("transaction_id").alias("id"), F.lit(True).alias("hit")).distinct()
    out = tx.join(victims, "id", "left")
    state = F.when(F.col("hit") & (F.col("transaction_state") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("transaction_state"))
    return out.withColumn("transaction_state", state).drop("hit")


def whole_artifacts(built: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows (evidence_id, claim_id, ...) of artifacts none of whose claims is taken: one taken slot refuses the whole artifact."""
    refused = built.join(taken.select("claim_id"), "claim_id", "left_semi").select("evidence_id").distinct()
    return built.join(refused, "evidence_id", "left_anti")


def pivot_claims(fields: DataFrame) -> DataFrame:
    """One row per claim: its nine fields as columns, UNKNOWN status where absent. A field that is there twice gives its greatest value.

    fields: a row per field, or rows (evidence_id, claim_id, fields) of several fields as an array. Such are pivoted where they
    are; then one row each is sent to its claim's partition and sorted there once, instead of every field before and after.
    """
    keys, value = ["evidence_id", "claim_id"], lambda n: "value_int" if n == "amount_minor" else "value_text"
    if "fields" in fields.columns:
        of = lambda n: F.array_max(F.transform(F.filter("fields", lambda f: f["field_name"] == n), lambda f: f[value(n)])).alias(n)
        rows, pick = fields.where(F.size("fields") > 0).select(*keys, *map(of, CLAIM_FIELDS)).repartition(*keys), lambda n: F.max(n).alias(n)
    else:
        rows, pick = fields, lambda n: F.max(F.when(F.col("field_name") == n, F.col(value(n)))).alias(n)
    out = rows.groupBy(*keys).agg(*map(pick, CLAIM_FIELDS))
    return out.withColumn("financial_status", F.coalesce("financial_status", F.lit("UNKNOWN")))


def free(queue: DataFrame, stage: str, now) -> DataFrame:
    """The rows of a stage that nobody holds."""
    return queue.where((F.col("processing_stage") == stage) & (F.col("locked_until").isNull() | (F.col("locked_until") <= F.lit(now))))


def claimable(queue: DataFrame, stage: str, now, batch: int = 100) -> DataFrame:
    """The next rows of a stage that nobody holds, oldest first, with one attempt more."""
    return free(queue, stage, now).orderBy("observed_at", "id").limit(batch).withColumn("attempts", F.col("attempts") + 1)

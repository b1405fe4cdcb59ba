"""Validating constructors as row checks: a row has an array of what is wrong with it, or passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..schemas import CLAIM_FIELDS, CLAIM_TRANSITIONS, DIRECTIONS, FINANCIAL_STATUSES, SOURCE_TYPES


def _array(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))


def evidence_violations(df: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return df.withColumn("violations", _array(
        ("ID", blank("id")), ("SOURCE", blank("source_id")), ("REFERENCE", blank("source_reference")),
        ("TYPE", ~F.coalesce(F.col("source_type"), F.lit("")).isin(list(SOURCE_TYPES))), ("OBSERVED_AT", F.col("observed_at").isNull()),
    ))


def transaction_violations(df: DataFrame) -> DataFrame:
    """Money has both parts or neither and is not negative; enums are closed."""
    return df.withColumn("violations", _array(
        ("MONEY_PAIR", F.col("amount_minor").isNull() != F.col("currency").isNull()), ("NEGATIVE", F.col("amount_minor") < 0),
        ("CURRENCY", F.col("currency").isNotNull() & ~V.currency_ok(F.col("currency"))), ("DIRECTION", ~F.coalesce(F.col("direction"), F.lit("")).isin(list(DIRECTIONS))),
        ("STATUS", ~F.coalesce(F.col("financial_status"), F.lit("")).isin(list(FINANCIAL_STATUSES))),
    ))


def claim_problems(fields: DataFrame) -> DataFrame:
    """(claim_id, problem) over claim fields: vocabulary, shape, values, and money that lacks its currency."""
    name, text = F.col("field_name"), F.col("value_text")
    shape = F.when(name == "amount_minor", F.col("value_int").isNull() | text.isNotNull()).otherwise(text.isNull() | F.col("value_int").isNotNull())
    one = _array(
        ("UNKNOWN_FIELD", ~name.isin(list(CLAIM_FIELDS))), ("BAD_SHAPE", shape), ("EMPTY_TEXT", V.trim(text) == ""),
        ("BAD_DIRECTION", (name == "direction") & ~text.isin(list(DIRECTIONS))), ("BAD_STATUS", (name == "financial_status") & ~text.isin(list(FINANCIAL_STATUSES))),
        ("BAD_CURRENCY", (name == "currency") & ~V.currency_ok(text)), ("NEGATIVE", (name == "amount_minor") & (F.col("value_int") < 0)),
        ("RESERVED", (name == "counterparty") & ~V.counterparty_ok(text)),
    )
    rows = fields.select("claim_id", F.explode(one).alias("problem"))
    pair = fields.where(name.isin("amount_minor", "currency")).groupBy("claim_id").agg(F.max((name == "amount_minor").cast("int")).alias("a"), F.max((name == "currency").cast("int")).alias("c"))
    return rows.unionByName(pair.where("a = 1 and c = 0").select("claim_id", F.lit("AMOUNT_WITHOUT_CURRENCY").alias("problem")))


def transition_ok(now: Column, to: Column) -> Column:
    out = F.lit(False)
    for a, b in CLAIM_TRANSITIONS:
        out = out | ((now == a) & (to == b))
    return out


def interpretation_checks(membership: DataFrame) -> DataFrame:
    """(interpretation_id, claims, repeats): claims counted, and whether a claim id stands twice."""
    g = membership.groupBy("interpretation_id").agg(F.count("*").alias("claims"), F.count_distinct("claim_id").alias("d"))
    return g.select("interpretation_id", "claims", (F.col("d") < F.col("claims")).alias("repeats"))


def point_read(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The evidence rows of some keys (by id, or by source and reference), each checked again as it is read: one that its own
    constructor would refuse is an error, not an answer."""
    found = evidence_violations(rows.join(keys.select(*on).distinct(), on, "left_semi"))
    told = F.concat(F.lit("stored evidence is not valid: "), F.array_join("violations", ", "))
    return found.withColumn("id", F.when(F.size("violations") > 0, F.raise_error(told).cast("string")).otherwise(F.col("id"))).drop("violations")

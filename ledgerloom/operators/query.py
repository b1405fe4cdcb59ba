"""Reads: filtered, keyset-paginated lists and totals that leave out movements between one's own accounts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..schemas import CURRENCIES, DIRECTIONS, FINANCIAL_STATUSES, RECONCILIATION_STATES


@dataclass(frozen=True)
class TransactionQuery:
    """A list request; empty sets do not filter, values of one set are alternatives, different fields add up."""

    since: datetime | None = None
    before: datetime | None = None
    directions: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    states: tuple[str, ...] = ()
    currency: str | None = None
    after: tuple[datetime, str] | None = None
    limit: int = 50

    def __post_init__(self) -> None:
        if not 1 <= self.limit <= 200:
            raise ValueError("limit: from 1 to 200")
        for name, given, known in (
            ("direction", self.directions, DIRECTIONS),
            ("financial_status", self.statuses, FINANCIAL_STATUSES),
            ("reconciliation_state", self.states, RECONCILIATION_STATES),
            ("currency", {self.currency} if self.currency else (), CURRENCIES),
        ):
            if set(given) - set(known):
                raise ValueError(f"{name}: one of {', '.join(known)}")
        if self.since and self.before and self.since >= self.before:
            raise ValueError("from: must be before to")


def in_window(c: Column, since, before) -> Column:
    out = F.lit(True)
    if since is not None:
        out = out & (c >= F.lit(since))
    if before is not None:
        out = out & (c < F.lit(before))
    return out


def any_of(c: Column, values) -> Column:
    return c.isin(list(values)) if values else F.lit(True)


def keyset_before(ts: Column, key: Column, at: Column, last: Column) -> Column:
    return (ts < at) | ((ts == at) & (key < last))


def active(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("transaction_state") == "ACTIVE")


def list_transactions(tx: DataFrame, q: TransactionQuery) -> DataFrame:
    """One page and one row more, newest first; the row beyond the limit says that more follow."""
    out = active(tx).where(in_window(F.col("occurred_at"), q.since, q.before) & any_of(F.col("direction"), q.directions))
    out = out.where(any_of(F.col("financial_status"), q.statuses) & any_of(F.col("reconciliation_state"), q.states))
    out = in_currency(out, q.currency)
    if q.after:
        out = out.where(keyset_before(F.col("occurred_at"), F.col("id"), F.lit(q.after[0]), F.lit(q.after[1])))
    return out.orderBy(F.col("occurred_at").desc(), F.col("id").desc()).limit(q.limit + 1)


def external(tx: DataFrame) -> DataFrame:
    return tx.where(~V.internal(F.col("counterparty")))


def in_currency(tx: DataFrame, currency: str | None) -> DataFrame:
    """Rows of a currency; all rows where none is asked for."""
    return tx.where(F.col("currency") == currency) if currency else tx


def with_money(tx: DataFrame, currency: str = "MXN") -> DataFrame:
    return in_currency(tx.where("amount_minor is not null"), currency)


def countable(tx: DataFrame, currency: str = "MXN") -> DataFrame:
    return with_money(active(tx), currency)


def totals(tx: DataFrame, since=None, before=None, currency: str = "MXN") -> DataFrame:
    """Sum and count by direction over external, active rows with money."""
    rows = external(countable(tx, currency)).where(in_window(F.col("occurred_at"), since, before))
    return rows.groupBy("direction").agg(F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("total_minor"), F.count("*").alias("n"))


def summary(tx: DataFrame, since=None, before=None, currency: str = "MXN") -> DataFrame:
    """Income, expense, net and the number of internal rows left out, in one pass."""
    rows = countable(tx, currency).where(in_window(F.col("occurred_at"), since, before)).withColumn("self", V.internal(F.col("counterparty")))
    part = lambda way: F.coalesce(F.sum(F.when(~F.col("self") & (F.col("direction") == way), F.col("amount_minor"))), F.lit(0))
    return rows.agg(part("INFLOW").alias("income"), part("OUTFLOW").alias("expense"), F.count(F.when(F.col("self"), 1)).alias("excluded")).withColumn("net", F.col("income") - F.col("expense"))


def api_row(tx: DataFrame) -> DataFrame:
    """The row that a client sees, flat: money as text, time as text, who is on the other side."""
    shown = F.when(V.internal(F.col("counterparty")), "self").otherwise(F.coalesce("counterparty", "merchant", F.lit("—")))
    return tx.select(
        "id", V.decimal_text(F.col("amount_minor"), F.col("currency")).alias("amount"), V.rfc3339(F.col("occurred_at")).alias("occurred_at"),
        "direction", "financial_status", shown.alias("other_party"), V.internal(F.col("counterparty")).alias("internal"),
    )


def checked_sum(amount: Column, currency: Column) -> Column:
    """The sum of amounts of one currency, as an aggregate; amounts of several are an error, as is a sum that no long holds."""
    mixed = F.min(F.when(amount.isNotNull(), currency)) != F.max(F.when(amount.isNotNull(), currency))
    return F.when(F.coalesce(mixed, F.lit(False)), F.raise_error(F.lit("amounts of different currencies")).cast("bigint")).otherwise(F.sum(amount))


def api_response(tx: DataFrame, support: DataFrame, bridge: DataFrame) -> DataFrame:
    """The nested row that a machine client sees: absent money and texts are NULL, texts carry their confidence, and evidence is named.

    support: (id, merchant_confidence, counterparty_confidence, account_identifier, account_confidence); bridge: (id, evidence_id)."""
    ids = bridge.groupBy("id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    rows = tx.join(support, "id", "left").join(ids, "id", "left")
    text = lambda value, confidence: F.when(F.coalesce(F.col(value), F.lit("")) != "", F.struct(F.col(value).alias("value"), F.col(confidence).alias("confidence")))
    return rows.select(
        "id", F.when(F.col("amount_minor").isNotNull(), F.struct("amount_minor", "currency")).alias("amount"), "direction", "financial_status", "reconciliation_state", V.rfc3339(F.col("occurred_at")).alias("occurred_at"),
        text("merchant", "merchant_confidence").alias("merchant"), text("counterparty", "counterparty_confidence").alias("counterparty"), text("account_identifier", "account_confidence").alias("account"),
        V.internal(F.col("counterparty")).alias("internal"), F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.array().cast("array<string>").alias("relationships"),
    )


def terminal_rows(tx: DataFrame, zone: str = V.ZONE) -> DataFrame:
    """What a terminal table shows: local time to the minute, money as text, a dash for what is absent."""
    shown = lambda c: F.coalesce(F.when(V.trim(c) != "", c), F.lit("—"))
    return tx.select(
        F.date_format(F.from_utc_timestamp("occurred_at", zone), "yyyy-MM-dd HH:mm").alias("date"), "direction", shown(V.decimal_text(F.col("amount_minor"), F.col("currency"))).alias("amount"),
        shown(F.when(V.internal(F.col("counterparty")), F.lit("self")).otherwise(F.col("counterparty"))).alias("counterparty"), shown(F.col("merchant")).alias("merchant"),
        "financial_status", "reconciliation_state", "id",
    )

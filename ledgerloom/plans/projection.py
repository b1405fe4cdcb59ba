"""The driver's tables read as a ledger: deterministic, integer-only rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SELF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Few narrow columns dealt to all cores by key, however few row groups their file has: for queries that make large artifacts of
    them, after this, and read each one."""
    n = max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, key)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Python workers get at most so many rows and bytes at once: artifacts are large, and workers share an
    executor's memory."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", "16m")):
        df.sparkSession.conf.set(f"spark.sql.execution.arrow.{name}", most)
    return df


def minor(price: Column) -> Column:
    return (price.cast("decimal(18,2)") * 100).cast("bigint")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a `ledger` row, every even one as a `mail` row too."""
    base = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("k"), minor(F.col("o_totalprice")).alias("a"), F.col("c_name").alias("n"), F.col("o_orderdate").cast("timestamp").alias("d"), F.col("o_orderstatus").alias("s")
    )
    k, n = F.col("k"), F.col("n")
    way = F.when(F.col("s") == "F", "INFLOW").otherwise("OUTFLOW")
    other = F.when(F.col("s") == "F", "OUTFLOW").otherwise("INFLOW")
    key = F.when(k % 5 == 0, F.concat(F.lit("K"), k.cast("string")))
    status = F.element_at(F.array(F.lit("SETTLED"), F.lit("UNKNOWN"), F.lit("PENDING")), (k % 3 + 1).cast("int"))
    number = F.lpad(k.cast("string"), 10, "0")
    # Both sources come from one pass over the join: a row is exploded into its one or two observations.
    mail = F.struct(
        F.concat(F.lit("A"), number).alias("id"), F.lit("mail").alias("source_id"), (F.col("a") + F.when(k % 14 == 0, 1).otherwise(0)).alias("amount_minor"),
        F.when(k % 26 == 0, n).alias("merchant"), F.when((k % 22 == 0) | (k % 26 == 0), F.lit(SELF)).otherwise(F.concat(F.upper(n), F.lit(" "))).alias("counterparty"),
        F.when(k % 30 == 0, other).otherwise(way).alias("direction"), (F.col("d") + F.make_interval(hours=F.when(k % 6 == 0, 7).otherwise(5))).alias("occurred_at"),
    )
    ledger = F.struct(
        F.concat(F.lit("L"), number).alias("id"), F.lit("ledger").alias("source_id"), F.col("a").alias("amount_minor"), n.alias("merchant"),
        F.lit(None).cast("string").alias("counterparty"), way.alias("direction"), F.col("d").alias("occurred_at"),
    )
    rows = F.when(k % 2 == 0, F.array(ledger, mail)).otherwise(F.array(ledger))
    return base.select(F.explode(rows).alias("r"), key.alias("tracking_key"), status.alias("financial_status")).select(
        "r.*", F.lit("MXN").alias("currency"), "financial_status", F.lit("UNRECONCILED").alias("reconciliation_state"),
        F.lit("ACTIVE").alias("transaction_state"), F.lit(None).cast("string").alias("superseded_by"), "tracking_key",
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as claims of an order (the evidence): a row each, with the fields that are present as an array."""
    li = table(spark, sf_dir, "lineitem")
    claim = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", minor(F.col("l_extendedprice")), "l_linenumber")
    row = lambda name, i, t, conf: F.struct(F.lit(name).alias("field_name"), i.cast("bigint").alias("value_int"), t.cast("string").alias("value_text"), F.lit(conf).alias("confidence"))
    none = F.lit(None)
    fields = F.array_compact(F.array(
        row("amount_minor", minor(F.col("l_extendedprice")), none, "HIGH"),
        row("currency", none, F.lit("MXN"), "LOW"),
        row("direction", none, F.when(F.col("l_returnflag") == "R", "INFLOW").otherwise("OUTFLOW"), "MEDIUM"),
        F.when(F.col("l_linestatus") == "F", row("financial_status", none, F.lit("SETTLED"), "HIGH")),
        F.when(F.col("l_partkey") % 3 == 0, row("merchant", none, F.concat(F.lit("M"), F.col("l_suppkey").cast("string")), "MEDIUM")),
        F.when(F.col("l_partkey") % 4 == 0, row("tracking_key", none, F.concat(F.lit("T"), F.col("l_partkey").cast("string")), "HIGH")),
    ))
    return li.select(F.col("l_orderkey").alias("evidence_id"), claim.alias("claim_id"), fields.alias("fields"))


def claim_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, one row per field."""
    return claims(spark, sf_dir).select("evidence_id", "claim_id", F.explode("fields").alias("f")).select("evidence_id", "claim_id", "f.*")

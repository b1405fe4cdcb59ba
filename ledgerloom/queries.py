"""Registered ledger queries, each with DuckDB SQL for the same rows over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import values as V
from .operators import geometry, incremental, lookups, match, quality, query, store
from .plans import migrations
from .plans.checkpoint import cut, scratch
from .plans.commits import Store
from .plans.projection import claim_fields, claims, small_batches, spread, table, transactions
from .schemas import SELF
from .sources import config, uploads
from .streaming import pipeline
from .text.html import html_text, mail_html
from .text.interpreters import interpret

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SINCE, BEFORE = datetime(1995, 1, 1), datetime(1997, 1, 1)

TX = f"""
base AS (SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS a, c_name AS n, o_orderdate AS d, o_orderstatus AS s
  FROM orders JOIN customer ON o_custkey = c_custkey),
tx AS (
  SELECT 'L' || lpad(CAST(k AS VARCHAR), 10, '0') AS id, 'ledger' AS source_id, a AS amount_minor, n AS merchant, CAST(NULL AS VARCHAR) AS counterparty,
    CASE WHEN s = 'F' THEN 'INFLOW' ELSE 'OUTFLOW' END AS direction, CAST(d AS TIMESTAMP) AS occurred_at, k FROM base
  UNION ALL
  SELECT 'A' || lpad(CAST(k AS VARCHAR), 10, '0'), 'mail', a + CASE WHEN k % 14 = 0 THEN 1 ELSE 0 END, CASE WHEN k % 26 = 0 THEN n END,
    CASE WHEN k % 22 = 0 OR k % 26 = 0 THEN '{SELF}' ELSE upper(n) || ' ' END,
    CASE WHEN (s = 'F') <> (k % 30 = 0) THEN 'INFLOW' ELSE 'OUTFLOW' END,
    CAST(d AS TIMESTAMP) + CASE WHEN k % 6 = 0 THEN INTERVAL 7 HOUR ELSE INTERVAL 5 HOUR END, k FROM base WHERE k % 2 = 0),
t AS (SELECT *, 'MXN' AS currency, CASE WHEN k % 5 = 0 THEN 'K' || k END AS tracking_key,
    CASE k % 3 WHEN 0 THEN 'SETTLED' WHEN 1 THEN 'UNKNOWN' ELSE 'PENDING' END AS financial_status,
    coalesce(counterparty = '{SELF}', false) AS self,
    lower(trim(CASE WHEN trim(merchant) <> '' THEN merchant ELSE counterparty END)) AS party,
    CAST(occurred_at - INTERVAL 6 HOUR AS DATE) AS day FROM tx)
"""
CLAIMS = """
c AS (SELECT l_orderkey AS evidence_id, concat_ws('-', l_orderkey, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT), l_linenumber) AS claim_id, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS amount_minor,
    'MXN' AS currency, CASE WHEN l_returnflag = 'R' THEN 'INFLOW' ELSE 'OUTFLOW' END AS direction, CASE WHEN l_linestatus = 'F' THEN 'SETTLED' END AS financial_status,
    CASE WHEN l_partkey % 3 = 0 THEN 'M' || l_suppkey END AS merchant, CASE WHEN l_partkey % 4 = 0 THEN 'T' || l_partkey END AS tracking_key, l_linenumber AS line FROM lineitem)
"""


def truncating(sql: str) -> str:
    """epoch_ms(x), which rounds, as whole milliseconds."""
    while (i := sql.find("epoch_ms(")) >= 0:
        depth, j = 1, i + len("epoch_ms(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        sql = f"{sql[:i]}(epoch_us({sql[i + 9 : j - 1]}) // 1000){sql[j:]}"
    return sql


def query_(sql: str | None = None):
    """Registers a query under its function's name; sql may begin with the shared table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = truncating(sql)
        return f

    return add


def ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp")).alias(c)


W = "occurred_at >= TIMESTAMP '1995-01-01' AND occurred_at < TIMESTAMP '1997-01-01'"


# ---- totals ------------------------------------------------------------------------------------------------------
@query_(f"WITH {TX} SELECT direction, CAST(sum(amount_minor) AS BIGINT) AS total_minor, count(*) AS n FROM t WHERE NOT self AND {W} GROUP BY direction")
def agg1_totals(spark, d):
    return query.totals(transactions(spark, d), SINCE, BEFORE)


@query_(f"WITH {TX} SELECT count(*) AS excluded FROM t WHERE self")
def agg2_internal_count(spark, d):
    return transactions(spark, d).agg(F.count(F.when(V.internal(F.col("counterparty")), 1)).alias("excluded"))


@query_(f"""WITH {TX} SELECT CAST(coalesce(sum(amount_minor) FILTER (NOT self AND direction = 'INFLOW'), 0) AS BIGINT) AS income,
 CAST(coalesce(sum(amount_minor) FILTER (NOT self AND direction = 'OUTFLOW'), 0) AS BIGINT) AS expense, count(*) FILTER (self) AS excluded,
 CAST(coalesce(sum(CASE WHEN self THEN 0 WHEN direction = 'INFLOW' THEN amount_minor ELSE -amount_minor END), 0) AS BIGINT) AS net FROM t WHERE {W}""")
def agg3_net(spark, d):
    return query.summary(transactions(spark, d), SINCE, BEFORE)


@query_("SELECT o_custkey AS transaction_id, min(o_orderpriority) AS source_id FROM orders GROUP BY 1")
def agg4_min_source(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("transaction_id")).agg(F.min("o_orderpriority").alias("source_id"))


@query_("SELECT l_orderkey AS transaction_id, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS evidence_ids FROM lineitem GROUP BY 1")
def agg5_evidence_ids(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("transaction_id")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("evidence_ids"))


@query_(f"WITH {TX} SELECT direction, amount_minor, count(*) AS n, min(id) AS first_id FROM t GROUP BY 1, 2 HAVING count(*) > 1")
def agg6_blocks(spark, d):
    return transactions(spark, d).groupBy("direction", "amount_minor").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query_(f"WITH {CLAIMS} SELECT count(*) AS processed, count(*) FILTER (line <> 7) AS claimed, count(*) FILTER (line = 7) AS unrecognised, count(*) FILTER (merchant IS NULL AND line <> 7) AS skipped FROM c")
def agg7_pass_counters(spark, d):
    li = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_partkey") % 3 == 0).alias("named"))
    line = F.col("l_linenumber")
    return li.agg(F.count("*").alias("processed"), F.count(F.when(line != 7, 1)).alias("claimed"), F.count(F.when(line == 7, 1)).alias("unrecognised"), F.count(F.when(~F.col("named") & (line != 7), 1)).alias("skipped"))


def money_text():
    """Line prices as text, some of them malformed by line number."""
    text = F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2))
    n = F.col("l_linenumber")
    return F.when(n == 2, F.regexp_replace(text, ",", "")).when(n == 3, F.concat(F.lit("  "), F.substr(text, F.lit(2)))).when(n == 4, F.concat(F.lit("-"), text)).when(n == 5, F.substring_index(text, ".", 1)).when(n == 6, F.concat(text, F.lit("0"))).otherwise(text)


PRICE = "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT)"
READS = f"CASE WHEN l_linenumber IN (1, 3, 7) OR (l_linenumber = 2 AND {PRICE} < 100000) THEN {PRICE} END"


@query_(f"SELECT l_orderkey AS evidence_id, count(*) FILTER (({READS}) IS NULL) AS unread_rows FROM lineitem GROUP BY 1")
def agg8_unread_rows(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("evidence_id")).agg(F.count(F.when(V.money_minor(money_text()).isNull(), 1)).alias("unread_rows"))


@query_(f"WITH {TX} SELECT source_id, CASE WHEN count(DISTINCT currency) <= 1 THEN CAST(sum(amount_minor) AS BIGINT) END AS total_minor FROM t GROUP BY 1")
def agg9_money_add(spark, d):
    return transactions(spark, d).groupBy("source_id").agg(query.checked_sum(F.col("amount_minor"), F.col("currency")).alias("total_minor"))


# ---- filters, lists ------------------------------------------------------------------------------------------------
def listed(cols: str):
    return f"SELECT id, direction, epoch_ms(occurred_at) AS occurred_at FROM t WHERE {cols}"


#: Transactions of which some are superseded, reconciled, in another currency or without an amount.
V_SQL = """v AS (SELECT * REPLACE (CASE WHEN k % 9 = 0 THEN 'USD' ELSE currency END AS currency, CASE WHEN k % 13 = 0 THEN NULL ELSE amount_minor END AS amount_minor),
 CASE WHEN k % 7 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS transaction_state, CASE WHEN k % 11 = 0 THEN 'RECONCILED' ELSE 'UNRECONCILED' END AS reconciliation_state FROM t)"""


def varied(spark, d):
    k = F.substring("id", 2, 20).cast("long")
    return transactions(spark, d).withColumns({
        "currency": F.when(k % 9 == 0, "USD").otherwise(F.col("currency")), "amount_minor": F.when(k % 13 != 0, F.col("amount_minor")),
        "transaction_state": F.when(k % 7 == 0, "SUPERSEDED").otherwise("ACTIVE"), "reconciliation_state": F.when(k % 11 == 0, "RECONCILED").otherwise("UNRECONCILED"),
    })


def listed_v(cols: str):
    return f"SELECT id, direction, epoch_ms(occurred_at) AS occurred_at FROM v WHERE {cols}"


def rows_(df):
    return df.select("id", "direction", ms("occurred_at"))


@query_(f"WITH {TX}, {V_SQL} {listed_v("transaction_state = 'ACTIVE'")}")
def flt1_active(spark, d):
    return rows_(query.active(varied(spark, d)))


@query_(f"WITH {TX} {listed(W)}")
def flt2_window(spark, d):
    return rows_(transactions(spark, d).where(query.in_window(F.col("occurred_at"), SINCE, BEFORE)))


FLT3 = "direction IN ('INFLOW') AND financial_status IN ('SETTLED', 'PENDING')"


@query_(f"WITH {TX} {listed(FLT3)}")
def flt3_membership(spark, d):
    return rows_(transactions(spark, d).where(query.any_of(F.col("direction"), ["INFLOW"]) & query.any_of(F.col("financial_status"), ["SETTLED", "PENDING"]) & query.any_of(F.col("source_id"), [])))


FLT4 = "currency = 'MXN'"


@query_(f"WITH {TX}, {V_SQL} {listed_v(FLT4)}")
def flt4_currency(spark, d):
    return rows_(query.in_currency(varied(spark, d), "MXN"))


FLT5 = "occurred_at < TIMESTAMP '1995-06-01' OR (occurred_at = TIMESTAMP '1995-06-01' AND id < 'L')"


@query_(f"WITH {TX} {listed(FLT5)}")
def flt5_keyset(spark, d):
    return rows_(transactions(spark, d).where(query.keyset_before(F.col("occurred_at"), F.col("id"), F.lit(datetime(1995, 6, 1)), F.lit("L"))))


@query_(f"WITH {TX} {listed('NOT self')}")
def flt6_external(spark, d):
    return rows_(query.external(transactions(spark, d)))


@query_(f"WITH {TX} {listed('self')}")
def flt7_internal(spark, d):
    return rows_(transactions(spark, d).where(V.internal(F.col("counterparty"))))


FLT8 = "amount_minor IS NOT NULL AND currency = 'MXN' AND id LIKE 'A%'"


@query_(f"WITH {TX}, {V_SQL} {listed_v(FLT8)}")
def flt8_money(spark, d):
    return rows_(query.with_money(varied(spark, d)).where(F.col("id").startswith("A")))


def work_queue(spark, d):
    """events as a work queue: purchases wait, every third row is held for an hour or two."""
    e = table(spark, d, "events")
    held = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.make_interval(hours=(F.col("event_id") % 2 + 1).cast("int")))
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "RECEIVED").otherwise("EXTRACTED").alias("processing_stage"), held.alias("locked_until"), F.col("ts").alias("observed_at"), F.lit(0).alias("attempts"), "user_id")


QUEUE = """q AS (SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'RECEIVED' ELSE 'EXTRACTED' END AS processing_stage,
 CASE WHEN event_id % 3 = 0 THEN ts + CASE WHEN event_id % 2 = 1 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END END AS locked_until, ts AS observed_at, user_id FROM events),
n AS (SELECT max(ts) - INTERVAL 30 MINUTE AS now FROM events)"""


def now_of(spark, d):
    return table(spark, d, "events").agg((F.max("ts") - F.make_interval(mins=F.lit(30))).alias("now"))


@query_(f"WITH {QUEUE} SELECT id, epoch_ms(observed_at) AS observed_at FROM q, n WHERE processing_stage = 'RECEIVED' AND (locked_until IS NULL OR locked_until <= now)")
def flt9_claimable(spark, d):
    return store.free(work_queue(spark, d), "RECEIVED", now_of(spark, d).first()[0]).select("id", ms("observed_at"))


@query_(f"WITH {TX}, {V_SQL} SELECT id FROM v WHERE transaction_state = 'ACTIVE' AND reconciliation_state = 'UNRECONCILED'")
def flt10_unreconciled(spark, d):
    return match.open_rows(varied(spark, d)).select("id")


@query_(f"""WITH {TX} SELECT id, (amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') || ' MXN' AS amount, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_ms(occurred_at) % 1000 AS VARCHAR), 3, '0') || 'Z' AS occurred_at,
 direction, financial_status, CASE WHEN self THEN 'self' ELSE coalesce(counterparty, merchant, '—') END AS other_party, self AS internal FROM t""")
def prj1_api_row(spark, d):
    return query.api_row(transactions(spark, d))


@query_(f"""WITH {TX} SELECT id, to_json({{'id': id, 'amount': {{'amount_minor': amount_minor, 'currency': currency}}, 'direction': direction, 'financial_status': financial_status, 'reconciliation_state': 'UNRECONCILED',
 'occurred_at': strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '.000Z', 'merchant': CASE WHEN merchant IS NOT NULL THEN {{'value': merchant, 'confidence': CASE k % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END}} END,
 'counterparty': CASE WHEN counterparty IS NOT NULL THEN {{'value': counterparty, 'confidence': CASE WHEN k % 3 < 2 THEN 'LOW' END}} END, 'account': CASE WHEN k % 9 = 0 THEN {{'value': 'ACC' || k, 'confidence': 'HIGH'}} END,
 'internal': self, 'evidence_ids': CASE WHEN k % 4 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 4 = 1 THEN ['E' || k] ELSE ['E' || k, 'F' || k] END, 'relationships': CAST([] AS VARCHAR[])}}) AS body FROM t""")
def prj1_api_response(spark, d):
    """The whole nested response as JSON, absent parts as null."""
    tx = transactions(spark, d)
    k = F.substr("id", F.lit(2)).cast("long")
    support = tx.select("id", F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MEDIUM").alias("merchant_confidence"), F.when(k % 3 < 2, "LOW").alias("counterparty_confidence"), F.when(k % 9 == 0, F.concat(F.lit("ACC"), k.cast("string"))).alias("account_identifier"), F.lit("HIGH").alias("account_confidence"))
    names = lambda *signs: F.array(*[F.concat(F.lit(c), k.cast("string")) for c in signs])
    bridge = tx.select("id", F.explode(F.when(k % 4 == 1, names("E", "E")).when(k % 4 > 1, names("F", "E", "F"))).alias("evidence_id"))
    rows = query.api_response(tx, support, bridge)
    return rows.select("id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("body"))


@query_(f"""WITH {TX} SELECT id, strftime(timezone('America/Mexico_City', timezone('UTC', occurred_at)), '%Y-%m-%d %H:%M') AS date, direction, (amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') || ' MXN' AS amount,
 CASE WHEN self THEN 'self' ELSE coalesce(counterparty, '—') END AS counterparty, coalesce(merchant, '—') AS merchant, financial_status, 'UNRECONCILED' AS reconciliation_state FROM t""")
def snk8_terminal_rows(spark, d):
    return query.terminal_rows(transactions(spark, d))


@query_(f"""WITH {CLAIMS} SELECT evidence_id, claim_id, amount_minor, currency, direction, coalesce(financial_status, 'UNKNOWN') AS financial_status, merchant, tracking_key, CASE WHEN line % 2 = 0 THEN 'ACC' || line END AS account_identifier,
 CASE WHEN evidence_id % 3 = 0 THEN '2026-01-0' || line END AS occurred_at, CASE WHEN evidence_id % 5 = 0 THEN 'Z' || evidence_id END AS counterparty FROM c""")
def prj2_claim_pivot(spark, d):
    """All nine fields; a counterparty that is stated twice gives the greater one."""
    k, line = F.col("evidence_id").cast("string"), F.substring_index("claim_id", "-", -1)
    row = lambda name, text: F.struct(F.lit(name).alias("field_name"), F.lit(None).cast("long").alias("value_int"), text.alias("value_text"), F.lit("LOW").alias("confidence"))
    more = F.array_compact(F.array(
        F.when(line.cast("int") % 2 == 0, row("account_identifier", F.concat(F.lit("ACC"), line))), F.when(F.col("evidence_id") % 3 == 0, row("occurred_at", F.concat(F.lit("2026-01-0"), line))),
        *[F.when(F.col("evidence_id") % 5 == 0, row("counterparty", F.concat(F.lit(c), k))) for c in "ZA"],
    ))
    return store.pivot_claims(claims(spark, d).withColumn("fields", F.concat("fields", more)))


@query_("SELECT e.event_id, epoch_ms(coalesce(CASE WHEN event_id % 4 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END, ts)) AS occurred_at, coalesce(event_id % 4 = 0 OR o_orderdate IS NULL, true) AS from_evidence FROM events e LEFT JOIN orders ON o_orderkey = event_id")
def prj3_occurred_fallback(spark, d):
    e = table(spark, d, "events").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("event_id"), "left")
    own = F.when(F.col("event_id") % 4 != 0, F.col("o_orderdate"))
    return e.select("event_id", F.unix_millis(F.coalesce(own, F.col("ts")).cast("timestamp")).alias("occurred_at"), own.isNull().alias("from_evidence"))


@query_(f"WITH {TX} SELECT id, CASE WHEN self THEN 'self' ELSE coalesce(counterparty, merchant, '—') END || CASE WHEN id LIKE 'A%' THEN ' [MEDIUM]' ELSE ' [HIGH]' END AS other_party FROM t")
def prj4_other_party(spark, d):
    t = transactions(spark, d)
    conf = F.when(F.col("id").startswith("A"), "MEDIUM").otherwise("HIGH")
    name = F.when(V.internal(F.col("counterparty")), "self").otherwise(F.coalesce("counterparty", "merchant", F.lit("—")))
    return t.select("id", F.concat(name, F.lit(" ["), conf, F.lit("]")).alias("other_party"))


@query_(f"WITH {CLAIMS} SELECT claim_id, 'MONEY_PAIR' AS violation FROM c WHERE line = 6 UNION ALL SELECT claim_id, 'DIRECTION' FROM c WHERE line = 5")
def prj5_row_violations(spark, d):
    p = store.pivot_claims(claims(spark, d)).withColumn("line", F.substring_index("claim_id", "-", -1))
    bad = p.withColumns({"currency": F.when(F.col("line") != "6", F.col("currency")), "direction": F.when(F.col("line") == "5", "UNKNOWN").otherwise(F.col("direction"))})
    return quality.transaction_violations(bad).select("claim_id", F.explode("violations").alias("violation"))


@query_(f"WITH {TX} SELECT id, direction, epoch_ms(occurred_at) AS occurred_at FROM (SELECT * FROM t WHERE NOT (occurred_at > TIMESTAMP '1996-01-01' OR (occurred_at = TIMESTAMP '1996-01-01' AND id >= 'L')) ORDER BY t.occurred_at DESC, id DESC LIMIT 51)")
def srt2_page(spark, d):
    return rows_(query.list_transactions(transactions(spark, d), query.TransactionQuery(after=(datetime(1996, 1, 1), "L"))))


@query_(f"""WITH {TX} SELECT id, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_ms(occurred_at) % 1000 AS VARCHAR), 3, '0') || 'Z' AS t_back, id AS id_back,
 rtrim(translate(to_base64(encode('{{"t":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_ms(occurred_at) % 1000 AS VARCHAR), 3, '0') || 'Z","id":"' || id || '"}}')), '+/', '-_'), '=') AS token FROM t""")
def srt3_cursor(spark, d):
    t = transactions(spark, d).select("id", V.cursor(F.col("occurred_at"), F.col("id")).alias("token"))
    back = V.cursor_fields(F.col("token"))
    return t.select("id", back["t"].alias("t_back"), back["id"].alias("id_back"), "token")


@query_(f"WITH {QUEUE} SELECT id, 1 AS attempts FROM (SELECT id FROM q, n WHERE processing_stage = 'RECEIVED' AND (locked_until IS NULL OR locked_until <= now) ORDER BY observed_at, id LIMIT 100)")
def stm2_claim_batch(spark, d):
    return store.claimable(work_queue(spark, d), "RECEIVED", now_of(spark, d).first()[0]).select("id", "attempts")


# ---- joins ---------------------------------------------------------------------------------------------------------
@query_(f"WITH {CLAIMS} SELECT o_orderkey AS id, min(tracking_key) AS tracking_key FROM orders JOIN c ON evidence_id = o_orderkey WHERE tracking_key IS NOT NULL GROUP BY 1")
def jn1_tracking_lookup(spark, d):
    keys = lookups.tracking_keys(claim_fields(spark, d))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id")).join(keys, "evidence_id").select(F.col("evidence_id").alias("id"), "tracking_key")


@query_("SELECT c_custkey AS id, m AS source_id FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn2_source_of(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("source_id"))
    return lookups.source_of(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), orders, "id")


@query_(f"WITH {CLAIMS} SELECT evidence_id, arg_min(CASE WHEN merchant IS NOT NULL THEN 'MEDIUM' END, claim_id) FILTER (merchant IS NOT NULL) AS merchant_confidence, 'HIGH' AS amount_confidence FROM c GROUP BY 1")
def jn3_confidence_lookup(spark, d):
    return lookups.confidences(claim_fields(spark, d), ["merchant", "amount_minor"])


@query_("SELECT c_custkey AS id, coalesce(e, '') AS evidence_ids FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT lpad(CAST(o_orderkey AS VARCHAR), 10, '0'), ',' ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS e FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn4_provenance(spark, d):
    bridge = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("evidence_id"))
    out = lookups.provenance(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), bridge, "id")
    return out.select("id", F.array_join("evidence_ids", ",").alias("evidence_ids"))


@query_("SELECT l_orderkey AS evidence_id, l_linenumber AS line, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'")
def jn5_active_claims(spark, d):
    current = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("evidence_id"))
    claims = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.col("l_linenumber").alias("line"), "l_partkey")
    return lookups.active_claims(claims, current, "evidence_id").select("evidence_id", "line", "l_partkey")


@query_("SELECT d.doc_id AS evidence_id, count(l.doc_id) AS claims FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def jn6_claimless_kept(spark, d):
    lab = lookups.claim_counts(table(spark, d, "documents").select("doc_id").distinct(), table(spark, d, "labels"), "doc_id")
    return lab.select(F.col("doc_id").alias("evidence_id"), F.col("claims"))


@query_("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def jn7_victims(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return lookups.victims(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), gone, "id")


@query_("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def src12_not_stored(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def words_on_pages(spark, d):
    """Line items as coordinates: a supplier is a page, of which there are more in larger tables, and days give y."""
    li = table(spark, d, "lineitem")
    y = (F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")) % 200).cast("int")
    return li.select(F.col("l_suppkey").alias("page"), y.alias("y"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), "l_returnflag")


COORD = "w AS (SELECT l_suppkey AS page, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) % 200 AS INTEGER) AS y, l_orderkey AS k, l_linenumber AS line, l_returnflag FROM lineitem)"


@query_(f"""WITH {COORD}, d AS (SELECT *, row_number() OVER (PARTITION BY page, y ORDER BY k, line) AS r FROM w WHERE l_returnflag = 'R'), a AS (SELECT *, row_number() OVER (PARTITION BY page, y ORDER BY k, line) AS r FROM w WHERE l_returnflag = 'A')
 SELECT d.page, d.y, d.k AS date_k, d.line AS date_line, a.k AS amount_k, a.line AS amount_line FROM d JOIN a USING (page, y, r)""")
def jn9_same_line_pairs(spark, d):
    w = words_on_pages(spark, d)
    return geometry.pair_one_to_one(w.where("l_returnflag = 'R'"), w.where("l_returnflag = 'A'"), ["page", "y"], ["k", "line"], ("date", "amount"))


@query_(f"""WITH {COORD}, rws AS (SELECT page, y AS row_y, min(k) AS row_k FROM w WHERE l_returnflag = 'R' GROUP BY 1, 2), s AS (SELECT page, y, k, line FROM w WHERE l_returnflag = 'A')
 SELECT page, k, line, row_y, row_k FROM (SELECT s.*, row_y, row_k, row_number() OVER (PARTITION BY k, line, s.page, s.y ORDER BY abs(row_y - y), row_y DESC) AS r FROM s JOIN rws ON rws.page = s.page AND row_y BETWEEN y - 2 AND y + 2) WHERE r = 1""")
def jn10_nearest_row(spark, d):
    w = words_on_pages(spark, d)
    rows = w.where("l_returnflag = 'R'").groupBy("page", F.col("y").alias("row_y")).agg(F.min("k").alias("row_k"))
    return geometry.nearest_within(w.where("l_returnflag = 'A'").select("page", "y", "k", "line"), rows, 2).select("page", "k", "line", "row_y", "row_k")


@query_(f"""WITH {COORD}, rws AS (SELECT page, y / 7.0::DOUBLE AS row_y, min(k) AS row_k FROM w WHERE l_returnflag = 'R' GROUP BY 1, 2), s AS (SELECT page, y / 7.0::DOUBLE AS y, k, line FROM w WHERE l_returnflag = 'A')
 SELECT page, y, k, line, row_y, row_k FROM (SELECT s.*, row_y, row_k, row_number() OVER (PARTITION BY k, line, s.page, s.y ORDER BY abs(row_y - y), row_y DESC) AS r FROM s JOIN rws ON rws.page = s.page AND abs(row_y - y) <= 0.3::DOUBLE) WHERE r = 1""")
def jn10_nearest_decimal(spark, d):
    """The nearest row on coordinates that are no whole numbers."""
    w = words_on_pages(spark, d).withColumn("y", F.col("y") / F.lit(7.0))
    rows = w.where("l_returnflag = 'R'").groupBy("page", F.col("y").alias("row_y")).agg(F.min("k").alias("row_k"))
    return geometry.nearest_within(w.where("l_returnflag = 'A'").select("page", "y", "k", "line"), rows, 0.3).select("page", "y", "k", "line", "row_y", "row_k")


@query_("""WITH c AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations)
 SELECT conv_id, turn, (SELECT max(p.turn) FROM c p WHERE p.conv_id = c.conv_id AND p.role = 'user' AND p.turn < c.turn) AS above FROM c WHERE role <> 'user'""")
def jn11_asof_above(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    return geometry.last_above(c, ["conv_id"], "turn", F.col("role") == "user").where("role <> 'user'").select("conv_id", "turn", "above")


@query_(f"""WITH {COORD} SELECT page, k, line FROM w s WHERE l_returnflag = 'N' AND EXISTS (SELECT 1 FROM w r WHERE r.page = s.page AND r.l_returnflag = 'A' AND r.y BETWEEN s.y - 2 AND s.y + 2)
 AND NOT EXISTS (SELECT 1 FROM w r WHERE r.page = s.page AND r.l_returnflag = 'R' AND r.y = s.y)""")
def jn12_sub_lines(spark, d):
    w = words_on_pages(spark, d)
    near = geometry.near_any(w.where("l_returnflag = 'N'"), w.where("l_returnflag = 'A'").select("page", "y").distinct(), 2)
    taken = w.where("l_returnflag = 'R'").select("page", "y").distinct()
    return near.join(taken, ["page", "y"], "left_anti").select("page", "k", "line")


@query_("""WITH l AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS way, o_custkey % 7 AS amount FROM orders), u AS (SELECT day, way, amount, min(k) AS k FROM l GROUP BY 1, 2, 3 HAVING count(*) = 1),
 a AS (SELECT event_id, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS way, o_custkey % 7 AS amount FROM events JOIN orders ON o_orderkey = event_id % 1000)
 SELECT u.k, max(event_id) AS tracking_event FROM u JOIN a USING (day, way, amount) GROUP BY 1""")
def jn13_unique_enrichment(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("way"), (F.col("o_custkey") % 7).alias("amount"))
    annex = table(spark, d, "events").select("event_id", (F.col("event_id") % 1000).alias("k")).join(o, "k").select("event_id", "day", "way", "amount")
    return geometry.enrich_unique(o, annex, ["day", "way", "amount"], "k", "event_id").select("k", F.col("event_id").alias("tracking_event"))


@query_("""WITH c AS (SELECT conv_id, turn, length(text) AS n FROM conversations), p AS (SELECT *, max(CASE WHEN n % 2 = 0 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM c)
 SELECT conv_id, turn, above FROM p WHERE turn - above <= 2""")
def jn14_row_above_gap(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return geometry.last_above(c, ["conv_id"], "turn", F.col("n") % 2 == 0).where("turn - above <= 2").select("conv_id", "turn", "above")


# ---- ordering and sets ----------------------------------------------------------------------------------------------
@query_("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def srt5_reading_order(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query_("SELECT conv_id, arg_min(text, turn) FILTER (text IS NOT NULL AND role <> 'user') AS reply FROM conversations GROUP BY 1")
def srt7_first_value(spark, d):
    ok = F.col("text").isNotNull() & (F.col("role") != "user")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by(F.when(ok, F.col("text")), F.when(ok, F.col("turn"))).alias("reply"))


@query_(f"""WITH RECURSIVE {COORD}, p AS (SELECT DISTINCT page, y FROM w), a(page, anchor) AS (SELECT page, min(y) FROM p GROUP BY 1
 UNION ALL SELECT a.page, (SELECT min(p.y) FROM p WHERE p.page = a.page AND p.y > a.anchor + 1) FROM a WHERE EXISTS (SELECT 1 FROM p WHERE p.page = a.page AND p.y > a.anchor + 1))
 SELECT page, y, k, line, (SELECT max(anchor) FROM a WHERE a.page = w.page AND anchor <= y) AS band FROM w""")
def srt8_bands(spark, d):
    """Words of a page in bands anchored at a band's first y (tolerance 1); sequential, so one task per page."""
    return geometry.bands(words_on_pages(spark, d).select("page", "y", "k", "line"), 1)


SWEEPS = f"""{TX},
s1 AS (SELECT l.id AS left_ref, r.id AS right_ref, CASE WHEN l.direction = r.direction AND l.self = r.self THEN 'MATCH' ELSE 'NO_MATCH' END AS status, 'tracking_key' AS basis
  FROM (SELECT tracking_key AS key, min(id) AS c FROM t WHERE tracking_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1) g JOIN t l ON l.id = c JOIN t r ON r.tracking_key = key AND r.id > c),
t2 AS (SELECT * FROM t WHERE id NOT IN (SELECT left_ref FROM s1 WHERE status = 'MATCH' UNION ALL SELECT right_ref FROM s1 WHERE status = 'MATCH')),
s2 AS (SELECT l.id AS left_ref, r.id AS right_ref, CASE WHEN l.self = r.self THEN 'MATCH' ELSE 'NO_MATCH' END AS status, 'composite' AS basis
  FROM (SELECT min(id) AS a, max(id) AS b FROM t2 WHERE party <> '' GROUP BY currency, amount_minor, direction, party, day HAVING count(*) = 2 AND count(DISTINCT source_id) = 2) g JOIN t l ON l.id = a JOIN t r ON r.id = b
  WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.left_ref = a AND s1.right_ref = b)),
t3 AS (SELECT * FROM t2 WHERE id NOT IN (SELECT left_ref FROM s2 WHERE status = 'MATCH' UNION ALL SELECT right_ref FROM s2 WHERE status = 'MATCH')),
s3 AS (SELECT l.id AS left_ref, r.id AS right_ref, CASE WHEN l.self = r.self THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS status, 'weak' AS basis
  FROM (SELECT currency AS cu, amount_minor AS am, direction AS di, min(id) AS c FROM t3 GROUP BY 1, 2, 3 HAVING count(*) > 1) g JOIN t l ON l.id = c JOIN t3 r ON r.currency = cu AND r.amount_minor = am AND r.direction = di AND r.id > c
  WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.left_ref = l.id AND s1.right_ref = r.id) AND NOT EXISTS (SELECT 1 FROM s2 WHERE s2.left_ref = l.id AND s2.right_ref = r.id)),
cand AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""


@query_(f"WITH {SWEEPS} SELECT * FROM cand")
def er1_candidates(spark, d):
    return match.run(transactions(spark, d), cut=cut)[1]


@query_(f"WITH {SWEEPS} SELECT left_ref, right_ref, status, basis FROM s1")
def er3_tracking_pairs(spark, d):
    return match.tracking(match.open_rows(transactions(spark, d)))


@query_(f"""WITH {TX} SELECT min(id) AS left_ref, max(id) AS right_ref, CASE WHEN bool_and(self) OR NOT bool_or(self) THEN 'MATCH' ELSE 'NO_MATCH' END AS status, 'composite' AS basis
 FROM t WHERE party <> '' GROUP BY currency, amount_minor, direction, party, day HAVING count(*) = 2 AND count(DISTINCT source_id) = 2""")
def er7_composite_pairs(spark, d):
    return match.composite(match.open_rows(transactions(spark, d)))


@query_(f"""WITH {TX} SELECT l.id AS left_ref, r.id AS right_ref, CASE WHEN l.self = r.self THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS status, 'weak' AS basis
 FROM (SELECT amount_minor AS am, direction AS di, min(id) AS c FROM t GROUP BY 1, 2 HAVING count(*) > 1) JOIN t l ON l.id = c JOIN t r ON r.amount_minor = am AND r.direction = di AND r.id > c""")
def er9_weak_pairs(spark, d):
    return match.weak(match.open_rows(transactions(spark, d)))


@query_(f"""WITH {SWEEPS}, m AS (SELECT * FROM cand WHERE status = 'MATCH')
 SELECT id, CASE WHEN id IN (SELECT left_ref FROM m UNION ALL SELECT right_ref FROM m) THEN 'RECONCILED' ELSE 'UNRECONCILED' END AS reconciliation_state,
 CASE WHEN id IN (SELECT right_ref FROM m) THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS transaction_state, (SELECT min(left_ref) FROM m WHERE right_ref = id) AS superseded_by FROM t""")
def er11_merged_state(spark, d):
    tx, _ = match.run(transactions(spark, d), cut=cut)
    return tx.select("id", "reconciliation_state", "transaction_state", "superseded_by")


@query_(f"WITH {SWEEPS} SELECT * FROM s1 WHERE NOT (right_ref LIKE '%50')")
def er12_sticky(spark, d):
    found = match.tracking(match.open_rows(transactions(spark, d)))
    return match.new_candidates(found, found.where(F.col("right_ref").endswith("50")))


@query_(f"WITH {SWEEPS} SELECT status, basis, count(*) AS n FROM cand GROUP BY 1, 2")
def agg7_match_counters(spark, d):
    return match.run(transactions(spark, d), cut=cut)[1].groupBy("status", "basis").agg(F.count("*").alias("n"))


@query_()
def er14_drain(spark, d):
    """Runs until nothing is added: iterative, so rows only; tests hold it to an in-memory version."""
    return match.drain(transactions(spark, d), cut)[1]


@query_(f"""WITH {SWEEPS}, b AS (SELECT id AS transaction_id, 'E' || id AS evidence_id FROM t) SELECT * FROM b UNION SELECT left_ref, 'E' || right_ref FROM cand WHERE status = 'MATCH'""")
def set1_provenance_union(spark, d):
    tx = transactions(spark, d)
    return match.provenance_union(tx.select(F.col("id").alias("transaction_id"), F.concat(F.lit("E"), "id").alias("evidence_id")), match.run(tx, cut=cut)[1])


# ---- scalar functions -----------------------------------------------------------------------------------------------
@query_(f"""SELECT l_orderkey, l_linenumber, {READS} AS minor, CASE WHEN ({READS}) IS NOT NULL THEN NULL WHEN l_linenumber IN (5, 6) THEN 'UNSUPPORTED_FORMAT' ELSE 'NOT_MONEY' END AS error FROM lineitem""")
def scl1_money(spark, d):
    t = table(spark, d, "lineitem").withColumn("m", money_text())
    return t.select("l_orderkey", "l_linenumber", V.money_minor(F.col("m")).alias("minor"), V.money_error(F.col("m")).alias("error"))


@query_("SELECT p_partkey, upper(p_type[1:3]) = 'MXN' AS ok, CAST(NULL AS INTEGER) AS exponent FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, true, 2 FROM part WHERE p_partkey % 2 = 0")
def scl2_currency(spark, d):
    c = F.when(F.col("p_partkey") % 2 == 0, "MXN").otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", V.currency_ok(c).alias("ok"), V.exponent(c).alias("exponent"))


@query_(f"WITH {TX} SELECT id, (amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') || ' MXN' AS plain, CASE WHEN direction = 'OUTFLOW' THEN '-' ELSE '' END || format('{{:,}}', amount_minor // 100) || '.' || lpad(CAST(amount_minor % 100 AS VARCHAR), 2, '0') AS page FROM t")
def scl4_decimal_text(spark, d):
    return transactions(spark, d).select("id", V.decimal_text(F.col("amount_minor"), F.col("currency")).alias("plain"), V.page_text(F.col("amount_minor"), F.col("direction")).alias("page"))


def date_text():
    """Order dates in the forms that statements use; by key, some that must be refused."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, V.MONTHS)), F.month(d))
    day, year, num = F.day(d).cast("string"), F.year(d).cast("string"), F.month(d).cast("string")
    return (F.when(k % 5 == 0, F.concat_ws("/", day, F.upper(name), year)).when(k % 5 == 1, F.concat(day, F.lit("  "), name, F.lit(" "), year, F.lit(" - 7:05")))
            .when(k % 5 == 2, F.concat_ws("/", F.lpad(day, 2, "0"), F.lpad(num, 2, "0"), year)).when(k % 5 == 3, F.concat_ws("/", F.lit("31"), F.lit("feb"), year)).otherwise(F.date_format(d, "yyyy-MM-dd")))


@query_("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 2) THEN epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) WHEN o_orderkey % 5 = 1 THEN epoch_ms(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 425 MINUTE) END AS wall, o_orderkey % 5 = 1 AS has_time FROM orders")
def scl5_wall_date(spark, d):
    t = table(spark, d, "orders").withColumn("t", date_text())
    return t.select("o_orderkey", F.unix_millis(V.wall_date(F.col("t")).cast("timestamp")).alias("wall"), V.has_time(F.col("t")).alias("has_time"))


@query_("SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 30 < 24 THEN (event_id % 30) * 3600 + (event_id % 50) * 60 WHEN event_id % 3 = 1 AND event_id % 70 < 60 THEN 3600 + (event_id % 70) * 60 + 9 END AS seconds FROM events")
def scl6_clock(spark, d):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.concat((e % 30).cast("string"), F.lit(":"), F.lpad((e % 50).cast("string"), 2, "0"))).when(e % 3 == 1, F.concat(F.lit("01:"), F.lpad((e % 70).cast("string"), 2, "0"), F.lit(":09"))).otherwise(F.lit("7:5"))
    return table(spark, d, "events").select("event_id", V.clock(text).cast("bigint").alias("seconds"))


@query_("SELECT o_orderkey, epoch_ms(timezone('UTC', timezone('America/Mexico_City', CAST(o_orderdate AS TIMESTAMP)))) AS utc FROM orders")
def scl7_in_zone(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.unix_millis(V.in_zone(F.col("o_orderdate"))).alias("utc"))


@query_("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(epoch_ms(ts) % 1000 AS VARCHAR), 3, '0') || 'Z' AS text, epoch_ms(ts) AS back FROM events")
def scl8_rfc3339(spark, d):
    t = table(spark, d, "events").select("event_id", V.rfc3339(F.col("ts")).alias("text"))
    return t.select("event_id", "text", F.unix_millis(F.to_timestamp("text")).alias("back"))


@query_("SELECT o_orderkey, (SELECT min(x) FROM (SELECT unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 30, INTERVAL 1 DAY)) AS x) WHERE day(x) = o_orderkey % 31 + 1)::DATE::VARCHAR AS day FROM orders")
def scl9_date_on(spark, d):
    start = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", V.date_on(start, F.date_add(start, 30), (F.col("o_orderkey") % 31 + 1).cast("int")).cast("string").alias("day"))


@query_("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start, CAST(CAST(o_orderdate AS DATE) + 29 AS VARCHAR) AS \"end\" FROM orders WHERE o_orderkey % 2 = 0")
def scl10_period(spark, d):
    s = F.to_date("o_orderdate")
    line = F.concat(F.lit("Periodo: "), F.date_format(s, "dd/MM/yyyy"), F.when(F.col("o_orderkey") % 2 == 0, " al ").otherwise(" - "), F.date_format(F.date_add(s, 29), "dd/MM/yyyy"))
    p = V.period(line)
    return table(spark, d, "orders").select("o_orderkey", p["start"].cast("string").alias("start"), p["end"].cast("string").alias("end")).where("start is not null")


@query_(f"WITH {TX} SELECT id, CAST(day AS VARCHAR) AS day FROM t")
def scl11_day_in_zone(spark, d):
    return transactions(spark, d).select("id", V.day_in_zone(F.col("occurred_at")).cast("string").alias("day"))


def statement_lines():
    return F.array(F.lit("Resumen"), F.concat(F.lit("Monto: $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")), F.lit("Nombre:"), F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")), F.lit("Folio:"), F.lit("  "), F.lit("end"))


@query_("SELECT o_orderkey, '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, trim(o_orderpriority) AS name, CAST(NULL AS VARCHAR) AS folio, CAST(NULL AS VARCHAR) AS missing FROM orders")
def scl17_labelled(spark, d):
    t = table(spark, d, "orders").withColumn("lines", statement_lines())
    pick = lambda label: V.labelled(F.col("lines"), label)
    return t.select("o_orderkey", pick("Monto:").alias("amount"), pick("Nombre:").alias("name"), pick("Folio:").alias("folio"), pick("Hora:").alias("missing"))


@query_("SELECT o_orderkey, trim(o_orderpriority) AS who FROM orders")
def scl18_between(spark, d):
    line = F.concat(F.lit("a la cuenta de "), F.col("o_orderpriority"), F.lit(" en otra parte"))
    return table(spark, d, "orders").select("o_orderkey", V.between(line, "a la cuenta de ", " en ").alias("who"))


@query_(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN {PRICE} END AS minor, CASE WHEN l_linenumber <> 2 THEN CASE WHEN l_linenumber % 2 = 1 THEN 'OUTFLOW' ELSE 'INFLOW' END END AS direction FROM lineitem")
def scl21_signed_money(spark, d):
    n = F.col("l_linenumber")
    sign = F.when(n == 2, "").when(n % 2 == 1, "-").otherwise("+")
    t = table(spark, d, "lineitem").withColumn("m", V.signed_money(F.concat(sign, F.lit("$"), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2))))
    return t.select("l_orderkey", "l_linenumber", F.col("m.amount_minor").alias("minor"), F.col("m.direction").alias("direction"))


@query_(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN {PRICE} END AS minor, CASE l_returnflag WHEN 'R' THEN 'OUTFLOW' WHEN 'A' THEN 'INFLOW' END AS direction FROM lineitem")
def scl22_two_columns(spark, d):
    price = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    flag = F.col("l_returnflag")
    m = V.two_column_money(F.when(flag != "A", price), F.when(flag != "R", price))
    return table(spark, d, "lineitem").withColumn("m", m).select("l_orderkey", "l_linenumber", F.col("m.amount_minor").alias("minor"), F.col("m.direction").alias("direction"))


@query_("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'HSBC' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'HSBX' || o_orderkey END AS key, o_orderkey % 2 = 0 AS card FROM orders")
def scl23_keys_and_cards(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 2, "sin clave").otherwise(F.concat(F.lit("Pago Clave de rastreo "), F.when(k % 3 == 0, "HSB").otherwise("HSBX"), k.cast("string"), F.lit(", Hora: 10:00")))
    card = F.concat(F.when(k % 2 == 0, "1234 5678 90").otherwise("12 x 34567890"), F.lit(" STORE"))
    return table(spark, d, "orders").select("o_orderkey", V.tracking_key(text).alias("key"), V.is_card(card).alias("card"))


@query_("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def scl25_section_fill(spark, d):
    c = table(spark, d, "conversations")
    return geometry.fill_forward(c, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


@query_("SELECT event_id, CAST(CASE WHEN event_id % 20 < 1 THEN 1 ELSE least(power(2, least(event_id % 20, 12) - 1), 1440) END AS BIGINT) AS minutes FROM events")
def scl30_backoff(spark, d):
    return table(spark, d, "events").select("event_id", V.backoff_minutes((F.col("event_id") % 20).cast("int")).alias("minutes"))


@query_("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'PARSE' WHEN event_id % 4 = 1 THEN 'PARSE: bad row ' || event_id ELSE 'PARSE: ' || repeat('x', 190) || '…' END AS reason FROM events")
def scl31_reason(spark, d):
    e = F.col("event_id")
    detail = F.when(e % 4 == 0, "").when(e % 4 == 1, F.concat(F.lit("bad \n\t row "), e.cast("string"), F.lit("\x01"))).otherwise(F.repeat(F.lit("x"), F.lit(300)))
    return table(spark, d, "events").select("event_id", V.reason(F.lit("PARSE"), detail).alias("reason"))


@query_("SELECT event_id, '{\"event_id\":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',\"user_id\":' || user_id ELSE '' END || ',\"event_type\":\"' || event_type || '\"}' AS payload FROM events")
def scl32_payload(spark, d):
    return table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id"), "event_type")).alias("payload"))


@query_(f"WITH {TX} SELECT id, self OR counterparty IS NULL OR counterparty NOT LIKE 'urn:%' AS ok, party FROM t")
def scl34_counterparty(spark, d):
    t = transactions(spark, d)
    return t.select("id", V.counterparty_ok(F.col("counterparty")).alias("ok"), V.party(F.col("merchant"), F.col("counterparty")).alias("party"))


@query_("SELECT page_id, to_base64(encode(html)) AS raw, strlen(html) AS n_bytes, 'text/html' AS media FROM pages")
def scl35_raw_content(spark, d):
    """Every byte of a page."""
    raw = F.encode("html", "UTF-8")
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.base64(raw), "\r\n", "").alias("raw"), F.octet_length(raw).cast("bigint").alias("n_bytes"), V.media_type(F.lit(" Text/HTML ; charset=x")).alias("media"))


@query_(f"WITH {TX} SELECT a.id, a.amount_minor = b.amount_minor AS equal, a.amount_minor = 0 AS zero FROM t a JOIN t b ON b.id = 'L' || a.id[2:] WHERE a.id LIKE 'A%'")
def scl39_money_equal(spark, d):
    t = transactions(spark, d).select("id", "amount_minor", "currency")
    a, b = t.where(F.col("id").startswith("A")).alias("a"), t.where(F.col("id").startswith("L")).alias("b")
    same = F.col("a.amount_minor").eqNullSafe(F.col("b.amount_minor")) & F.col("a.currency").eqNullSafe(F.col("b.currency"))
    return a.join(b, F.substr("a.id", F.lit(2)) == F.substr("b.id", F.lit(2))).select("a.id", same.alias("equal"), (F.col("a.amount_minor") == 0).alias("zero"))


# ---- sources, writes, constructors ----------------------------------------------------------------------------------
@query_("SELECT p_partkey % 40 AS id, CASE WHEN count(*) > 1 THEN 'DUPLICATE_ID' END AS problem FROM part GROUP BY 1 HAVING count(*) > 1")
def src7_config_duplicates(spark, d):
    rows = table(spark, d, "part").select((F.col("p_partkey") % 40).cast("string").alias("id"), F.lit("MANUAL").alias("type"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("extraction_profile"))
    return config.problems(rows).where("problem = 'DUPLICATE_ID'").select(F.col("id").cast("bigint").alias("id"), "problem").distinct()


@query_("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'UNKNOWN_FIELD' WHEN o_orderkey % 4 = 1 THEN 'SOURCE_TYPE' END AS problem FROM orders")
def src8_upload(spark, d):
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(F.lit("s").alias("source_id"), k.cast("string").alias("source_artifact_key"), F.lit("2026-01-02T03:04:05Z").alias("observed_at"), F.lit("text/plain").alias("content_type"), F.base64(F.encode(k.cast("string"), "UTF-8")).alias("raw_content"), F.when(k % 4 == 0, "x").alias("extra")))
    kind = F.when(k % 4 == 1, "GMAIL").otherwise("MANUAL")
    return uploads.decoded(table(spark, d, "orders").select("o_orderkey", body.alias("body"), kind.alias("source_type")), "body").select("o_orderkey", "problem")


@query_("""SELECT user_id AS source_id, event_type AS source_reference, min(event_id) AS id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = e.event_type AND x.event_id % 97 = 0) GROUP BY 1, 2""")
def snk1_insert_if_absent(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("source_reference"), F.col("event_id").alias("id"))
    return store.insert_if_absent(e, e.where("id % 97 = 0"), ["source_id", "source_reference"], "id")


@query_("""SELECT o_orderkey AS evidence_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS current FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'first' FROM orders WHERE o_orderkey % 2 = 1""")
def snk3_compare_and_swap(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("evidence_id"))
    k = F.col("evidence_id")
    slots = o.where(k % 2 == 0).select("evidence_id", F.lit("old").alias("current"))
    wanted = o.where(k % 2 == 0).select("evidence_id", F.when(k % 3 == 0, "old").otherwise("other").alias("expected"), F.lit("new").alias("next"))
    return store.compare_and_swap(slots, wanted.unionByName(o.select("evidence_id", F.lit(None).cast("string").alias("expected"), F.lit("first").alias("next"))))


@query_("SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 10 = 0) AND o_orderstatus <> 'P' THEN 'SUPERSEDED' WHEN o_orderstatus = 'P' THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS transaction_state FROM orders")
def snk4_retire(spark, d):
    tx = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "SUPERSEDED").otherwise("ACTIVE").alias("transaction_state"))
    li = table(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("claim_id"), F.col("l_orderkey").alias("transaction_id"), F.col("l_suppkey").alias("interpretation_id"))
    gone = li.select("interpretation_id").where("interpretation_id % 10 = 0").distinct()
    return store.retire(tx, li.select("claim_id", "transaction_id"), li.select("claim_id", "interpretation_id"), gone).select("id", "transaction_state")


@query_("SELECT l_orderkey AS evidence_id, l_orderkey || '-' || l_linenumber AS claim_id FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 20 = 0)")
def snk5_whole_artifacts(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("claim_id"), "l_partkey")
    return store.whole_artifacts(li.select("evidence_id", "claim_id"), li.where("l_partkey % 20 = 0"))


@query_("""SELECT row_number() OVER (ORDER BY ts, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS seq, 'EvidenceIngested' AS type, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS payload, epoch_ms(ts) AS occurred_at FROM events""")
def snk7_domain_events(spark, d):
    return store.events_of(table(spark, d, "events").select("event_id", "event_type", "ts"), "EvidenceIngested", ["event_id", "event_type"], "ts").select("seq", "type", "payload", ms("occurred_at"))


@query_(f"""WITH {CLAIMS} SELECT claim_id, 'AMOUNT_WITHOUT_CURRENCY' AS problem FROM c WHERE line = 4 UNION ALL SELECT claim_id, 'UNKNOWN_FIELD' FROM c WHERE line = 3 UNION ALL SELECT claim_id, 'BAD_DIRECTION' FROM c WHERE line = 2""")
def val3_claim_fields(spark, d):
    line = F.substring_index("claim_id", "-", -1)
    f = claim_fields(spark, d).where(~((line == "4") & (F.col("field_name") == "currency")))
    f = f.withColumn("value_text", F.when((line == "2") & (F.col("field_name") == "direction"), "SIDEWAYS").otherwise(F.col("value_text"))).withColumn("field_name", F.when((line == "3") & (F.col("field_name") == "direction"), "colour").otherwise(F.col("field_name")))
    return quality.claim_problems(f).select("claim_id", "problem")


@query_(f"SELECT event_id, (event_id % 4 = 0 AND event_id % 3 IN (0, 2)) OR (event_id % 4 = 1 AND event_id % 3 = 1) AS allowed FROM events")
def val4_transitions(spark, d):
    e = F.col("event_id")
    now = F.element_at(F.array(*map(F.lit, ("PROPOSED", "ACTIVE", "SUPERSEDED", "REJECTED"))), (e % 4 + 1).cast("int"))
    to = F.element_at(F.array(*map(F.lit, ("ACTIVE", "SUPERSEDED", "REJECTED"))), (e % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", quality.transition_ok(now, to).alias("allowed"))


@query_("""SELECT l_orderkey AS interpretation_id, count(*) AS claims, count(DISTINCT l_partkey % 3) < count(*) AS repeats FROM lineitem GROUP BY 1""")
def val5_interpretations(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("interpretation_id"), (F.col("l_partkey") % 3).alias("claim_id"))
    return quality.interpretation_checks(li)


@query_("""SELECT row_number() OVER (ORDER BY event_id % 3 = 0, ts, payload, kind) AS seq, kind AS type, payload, epoch_ms(ts) AS occurred_at FROM (
 SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'EvidenceIngested' ELSE 'TransactionCreated' END AS kind, CASE WHEN event_id % 2 = 0 THEN '{"evidenceId":' || event_id || '}' ELSE '{"transactionId":' || event_id || '}' END AS payload FROM events)""")
def snk7_numbered_batches(spark, d):
    """Events of two kinds in two batches: numbers of the second follow those of the first without a gap."""
    e = table(spark, d, "events").select("event_id", "ts")
    out, after = None, 0
    for part in (e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0")):
        even = part.where("event_id % 2 = 0").withColumnRenamed("event_id", "evidenceId")
        odd = part.where("event_id % 2 <> 0").withColumnRenamed("event_id", "transactionId")
        rows = store.numbered(store.event_body(even, "EvidenceIngested", ["evidenceId"], "ts").unionByName(store.event_body(odd, "TransactionCreated", ["transactionId"], "ts")), after)
        after, out = after + part.count(), rows if out is None else out.unionByName(rows)
    return out.select("seq", "type", "payload", ms("occurred_at"))


@query_("SELECT CAST(c_custkey AS VARCHAR) AS id, 's' || c_nationkey AS source_id, c_name AS source_reference, 'MANUAL' AS source_type FROM customer WHERE c_custkey % 3 = 0")
def src11_point_read(spark, d):
    """Evidence read by source and reference, each row checked again as it is read."""
    c = table(spark, d, "customer")
    ev = c.select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("s"), F.col("c_nationkey").cast("string")).alias("source_id"), F.lit("MANUAL").alias("source_type"), F.col("c_name").alias("source_reference"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("raw_content"), F.lit(SINCE).alias("observed_at"))
    keys = ev.where(F.col("id").cast("long") % 3 == 0).select("source_id", "source_reference")
    return quality.point_read(ev, keys, ["source_id", "source_reference"]).select("id", "source_id", "source_reference", "source_type")


@query_(f"""WITH {TX}, s AS (SELECT id, CASE WHEN k % 7 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS state, k FROM t),
 c AS (SELECT CASE k % 5 WHEN 1 THEN a.id WHEN 2 THEN 'L' || a.id[2:] ELSE a.id END AS l, CASE k % 5 WHEN 1 THEN a.id WHEN 2 THEN a.id WHEN 3 THEN 'missing' ELSE 'L' || a.id[2:] END AS r FROM s a WHERE a.id LIKE 'A%'),
 j AS (SELECT l, r, x.state AS ls, y.state AS rs FROM c LEFT JOIN s x ON x.id = l LEFT JOIN s y ON y.id = r)
 SELECT l AS left_ref, r AS right_ref, unnest(list_filter([CASE WHEN l = r THEN 'SELF' END, CASE WHEN l > r THEN 'ORDER' END, CASE WHEN ls IS DISTINCT FROM 'ACTIVE' THEN 'SURVIVOR_NOT_ACTIVE' END, CASE WHEN rs IS DISTINCT FROM 'ACTIVE' THEN 'SUPERSEDED_NOT_ACTIVE' END], lambda x: x IS NOT NULL)) AS problem FROM j""")
def val7_merge_preconditions(spark, d):
    """Pairs that may not be merged: with oneself, out of order, and with rows that are missing or no longer active."""
    t = transactions(spark, d)
    k = F.substr("id", F.lit(2)).cast("long")
    t = t.withColumn("transaction_state", F.when(k % 7 == 0, "SUPERSEDED").otherwise("ACTIVE"))
    other = F.concat(F.lit("L"), F.substr("id", F.lit(2)))
    pairs = t.where(F.col("id").startswith("A")).select(
        F.when(k % 5 == 2, other).otherwise(F.col("id")).alias("left_ref"), F.when(k % 5 == 1, F.col("id")).when(k % 5 == 2, F.col("id")).when(k % 5 == 3, "missing").otherwise(other).alias("right_ref"), F.lit("MATCH").alias("status"))
    return match.merge_problems(t, pairs)


@query_("""WITH m AS (SELECT DISTINCT l_orderkey AS evidence_id, sha256('interpretation:' || l_orderkey) AS id FROM lineitem) SELECT id, evidence_id, 'EMAIL_V1' AS extraction_profile, 0 AS unread_rows, 3 AS schema FROM m""")
def snk10_version_log(spark, d):
    """Stored tables brought to the newest version, a commit a step."""
    root = scratch(spark, "migrated")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"))
    Store(spark, root, migrations.VERSIONS[0]).snapshot().commit({"claim_evidence": li})
    snap = migrations.upgrade(spark, root)
    return snap.read("interpretations").withColumn("schema", F.lit(snap.marks["schema"]))


# ---- the stored pipeline ------------------------------------------------------------------------------------------
def customer_statements(spark, d):
    """Customers as stored artifacts: a block statement each, by number readable, of no known shape, unreadable, and of another
    media type."""
    k = F.col("c_custkey")
    m, name = k % 4, k.cast("string")
    raw = xhtml((60, 100, F.lit("5 ENE 2026")), (500, 100, F.lit("-$10.00")), (140, 101, F.when(m == 1, "hello").otherwise(F.concat(F.lit("Tienda "), name, F.lit(" Compra")))), (60, 140, F.when(m == 2, "6 ENE 2026")), (500, 140, F.lit("-$0.00")), (140, 140, F.lit("Otra Compra")))
    return spread(table(spark, d, "customer"), "c_custkey").select(name.alias("id"), F.lit("s").alias("source_id"), F.lit("MANUAL").alias("source_type"), F.col("c_name").alias("source_reference"), F.when(m == 3, "text/html").otherwise("application/xhtml+xml").alias("content_type"), raw.alias("raw_content"), F.lit(SINCE).alias("observed_at"))


@query_("""WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS m FROM customer)
 SELECT id, CASE WHEN m < 2 THEN 'EXTRACTED' ELSE 'RECEIVED' END AS processing_stage, CASE m WHEN 2 THEN 'the amount did not parse' WHEN 3 THEN 'DISPATCH' END AS problem, 1 AS attempts,
 CASE WHEN m = 0 THEN 1 ELSE 0 END AS claims, CASE WHEN m = 0 THEN 6 ELSE 0 END AS fields, CASE WHEN m = 0 THEN 1 ELSE 0 END AS slots, CASE WHEN m = 0 THEN 2 ELSE 1 END AS events, true AS stored FROM c""")
def snk2_interpretation_set(spark, d):
    """One commit of raw evidence, stages, interpretations, claims, fields, slots and events; what it made visible, by artifact. A
    second arrival of the same artifacts adds nothing."""
    root, ev, now = scratch(spark, "ledger"), customer_statements(spark, d), BEFORE
    snap, _ = pipeline.receive(pipeline.ledger(spark, root).snapshot(), ev, "STATEMENT_BLOCKS_V1", now)
    pipeline.receive(snap, ev, "STATEMENT_BLOCKS_V1", now)
    snap = pipeline.ledger(spark, root).snapshot()
    told = lambda name: F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit(None).cast("string"))
    of = lambda rows, key, n: rows.groupBy(F.col(key).alias("id")).agg(F.count("*").cast("int").alias(n))
    events = snap.read("events").withColumn("id", F.coalesce(told("evidenceId"), F.get_json_object("payload", "$.evidenceIds[0]")))
    out = pipeline.latest(snap.read("stages"), "id").select("id", "processing_stage", "problem", "attempts")
    for rows, key, n in ((snap.read("claims"), "evidence_id", "claims"), (snap.read("fields").join(snap.read("claims"), "claim_id"), "evidence_id", "fields"), (snap.read("slots"), "evidence_id", "slots"), (events, "id", "events")):
        out = out.join(of(rows, key, n), "id", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    raw = snap.read("evidence").join(ev.select("id", F.sha2("raw_content", 256).alias("h")), "id").select("id", (F.sha2("raw_content", 256) == F.col("h")).alias("stored"))
    return out.join(raw, "id").withColumn("id", F.col("id").cast("bigint"))


@query_("SELECT count(*) AS processed, count(*) FILTER (c_custkey % 4 = 0) AS claimed, count(*) FILTER (c_custkey % 4 = 1) AS unrecognised, count(*) FILTER (c_custkey % 4 > 1) AS failed, count(*) FILTER (c_custkey % 4 = 1) AS skipped FROM customer")
def agg7_observed_counters(spark, d):
    """The counters of an extraction pass, observed while it wrote, without another pass."""
    _, seen = pipeline.receive(pipeline.ledger(spark, scratch(spark, "ledger")).snapshot(), customer_statements(spark, d), "STATEMENT_BLOCKS_V1", BEFORE)
    names = ("processed", "claimed", "unrecognised", "failed", "skipped")
    return spark.createDataFrame([tuple(seen.get[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query_("""WITH s AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS again FROM supplier)
 SELECT k AS id, 'BLOCKS' AS layout, CASE WHEN again THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS transaction_state, 1000 + k AS amount_minor FROM s
 UNION ALL SELECT k, 'COLUMNS', 'ACTIVE', 500000 + k FROM s WHERE again""")
def stm11_reextraction(spark, d):
    """Suppliers as statements that two profiles read: all are read by one, every third again by the other, whose transactions
    take the place of the first ones."""
    k = F.col("s_suppkey")
    money = lambda minor: F.concat(F.lit("$"), F.format_number((minor / 100).cast("decimal(18,2)"), 2))
    raw = xhtml((60, 100, F.lit("6 ENE 2026")), (500, 100, F.concat(F.lit("-"), money(k + 1000))), (140, 100, F.lit("Tienda Compra")), (60, 5, F.lit("01/01/2026")), (120, 5, F.lit("al")), (180, 5, F.lit("31/01/2026")), (45, 20, F.lit("9")), (60, 20, F.lit("CGO")), (430, 20, money(k + 500_000)))
    ev = spread(table(spark, d, "supplier"), "s_suppkey").select(k.cast("string").alias("id"), F.lit("s").alias("source_id"), F.lit("MANUAL").alias("source_type"), F.col("s_name").alias("source_reference"), F.lit("application/xhtml+xml").alias("content_type"), raw.alias("raw_content"), F.lit(SINCE).alias("observed_at"))
    root = scratch(spark, "ledger")
    pipeline.receive(pipeline.ledger(spark, root).snapshot(), ev, "STATEMENT_BLOCKS_V1", BEFORE)
    pipeline.build(spark, root)
    pipeline.reconcile(spark, root, BEFORE)
    pipeline.reextract(spark, root, ev.where(F.col("id").cast("long") % 3 == 0), "STATEMENT_COLUMNS_V1", BEFORE)
    pipeline.build(spark, root)
    pipeline.reconcile(spark, root, BEFORE)
    layout = F.when(F.col("amount_minor") < 500_000, "BLOCKS").otherwise("COLUMNS")
    return pipeline.transactions(spark, root).select(F.col("evidence_id").cast("bigint").alias("id"), layout.alias("layout"), "transaction_state", "amount_minor")


@query_()
def er14_incremental(spark, d):
    """Transactions in two parts, decided through the stored block index: the candidates by sweep and outcome. Tests hold it to full sweeps."""
    tx = transactions(spark, d).withColumns({"claim_id": F.col("id"), "evidence_id": F.col("id")})
    snap = Store(spark, scratch(spark, "ledger"), incremental.SCHEMAS, incremental.SPLIT).snapshot()
    columns = [c for c in snap.read("transactions").columns if c not in ("step", "part")]
    for half in (0, 1):
        work = incremental.reconciled(snap, tx.where(F.pmod(F.xxhash64("id"), F.lit(2)) == half).select(*columns))
        snap = snap.commit(incremental.additions(work) | {"transactions": work.new_rows.select("*", F.lit(snap.version + 1).cast("long").alias("step"), incremental.part_of("id").alias("part"))})
    return snap.read("candidates").groupBy("basis", "status").agg(F.count("*").alias("n"))


# ---- text ---------------------------------------------------------------------------------------------------------
@query_(r"""WITH a AS (SELECT page_id, regexp_replace(html, '[\r\n]', ' ', 'g') AS t FROM pages),
 b AS (SELECT page_id, regexp_replace(regexp_replace(t, '<!--.*?-->', '', 'g'), '(?i)<head(\s[^>]*)?>.*?</head\s*>|<script(\s[^>]*)?>.*?</script\s*>|<style(\s[^>]*)?>.*?</style\s*>|<title(\s[^>]*)?>.*?</title\s*>|<noscript(\s[^>]*)?>.*?</noscript\s*>', chr(10), 'g') AS t FROM a),
 c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<[!?][^>]*>', '', 'g'), '(?i)</?(p|div|br|tr|td|th|table|li|ul|ol|h[1-6]|section|article|header|footer|hr|body|html|tbody|thead)(\s[^>]*|/)?>', chr(10), 'g'), '</?[A-Za-z][A-Za-z0-9]*(\s[^>]*|/)?>', '', 'g') AS t FROM b),
 e AS (SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)&(nbsp|#160);|\x{00A0}', ' ', 'g'), '(?i)&lt;', '<', 'g'), '(?i)&gt;', '>', 'g'), '(?i)&quot;', '"', 'g'), '(?i)&apos;|&#39;', '''', 'g'), '&amp;', '&') AS t FROM c)
 SELECT page_id, list_aggregate(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), 'string_agg', chr(10)) AS text FROM e""")
def scl12_html_text(spark, d):
    """Pages as text. The SQL says it by a chain of patterns, which fits pages whose markup is well formed; tests hold the scanner to
    what is not."""
    return small_batches(table(spark, d, "pages")).select("page_id", html_text("html").alias("text"))


def xhtml(*placed) -> Column:
    """A document of one page: (x, y, text column) each a block of one line and one word; a NULL text leaves its block out."""
    block = lambda x, y, t: F.concat(F.lit(f'<block xMin="{x}" yMin="{y}" xMax="0" yMax="{y + 10}"><line xMin="{x}" yMin="{y}"><word xMin="{x}" yMin="{y}">'), t, F.lit("</word></line></block>"))
    return F.encode(F.concat(F.lit("<doc><page>"), *[F.coalesce(block(*p), F.lit("")) for p in placed], F.lit("</page></doc>")), "UTF-8")


def field(name: str, claim: int = 0) -> Column:
    return F.get("claims", F.lit(claim))[name]["value"].alias(name)


@query_("""WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS m, CAST((CAST(abs(c_acctbal) AS DECIMAL(18,2)) + 1) * 100 AS BIGINT) AS a FROM customer)
 SELECT id, CASE m WHEN 0 THEN 'READ' WHEN 1 THEN 'UNRECOGNISED' ELSE 'FAILED' END AS status, CASE m WHEN 2 THEN 'the statement changed' WHEN 3 THEN 'DISPATCH' END AS problem,
 CASE WHEN m < 2 THEN 1 ELSE 0 END AS unread_rows, CASE WHEN m = 0 THEN a END AS amount_minor, CASE WHEN m = 0 THEN 'Tienda ' || id END AS merchant,
 CASE WHEN m = 0 THEN 'Ana ' || id END AS counterparty, CASE WHEN m = 0 THEN 'K' || id END AS tracking_key FROM c""")
def utf1_statement_interpreters(spark, d):
    """Account balances as block statements: readable (a purchase, a transfer and a row of no shape), of no known shape, with a
    direction that contradicts its sign, and of a wrong media type."""
    k = F.col("c_custkey")
    m, name = k % 4, k.cast("string")
    amount = F.format_number(F.abs("c_acctbal").cast("decimal(18,2)") + 1, 2)
    only = lambda *kinds: F.when(m.isin(list(kinds)), F.lit("5 ENE 2026"))
    raw = xhtml(
        (60, 100, F.lit("5 ENE 2026")), (500, 100, F.concat(F.lit("-$"), amount)), (140, 101, F.when(m == 0, F.concat(F.lit("Tienda "), name, F.lit(" Compra"))).when(m == 2, "Bo").otherwise("hello")),
        (135.84, 115, F.when(m == 2, "Depósito SPEI, Del cliente Bo (Dato no verificado por esta institución)")),
        (60, 140, only(0)), (500, 140, F.when(m == 0, "+$7.00")), (140, 140, F.concat(F.when(m == 0, "Ana "), name)),
        (135.84, 155, F.concat(F.when(m == 0, "Depósito SPEI, Del cliente Ana "), name, F.lit(" (Dato no verificado por esta institución), Hora: 10:20:30, Clave de rastreo K"), name, F.lit(" , Concepto x"))),
        (60, 180, only(0)), (500, 180, F.when(m == 0, "+$1.00")), (140, 180, F.when(m == 0, "SPEI recibido de nadie")),
    )
    ev = spread(table(spark, d, "customer"), "c_custkey").select(name.alias("id"), F.lit("STATEMENT_BLOCKS_V1").alias("extraction_profile"), F.when(m == 3, "text/html").otherwise("application/xhtml+xml; charset=utf-8").alias("content_type"), raw.alias("raw_content"))
    return interpret(ev).select(F.col("id").cast("bigint").alias("id"), "status", "problem", "unread_rows", field("amount_minor").cast("bigint").alias("amount_minor"), field("merchant"), field("counterparty", 1), field("tracking_key", 1))


@query_("""WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS m, o_orderstatus = 'F' AS inward, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS a FROM orders)
 SELECT id, CASE WHEN m = 4 THEN 'FAILED' ELSE 'READ' END AS status, CASE WHEN m = 4 THEN 'the statement changed' END AS problem, CASE WHEN m < 4 THEN a END AS amount_minor,
 CASE WHEN m < 4 THEN CASE WHEN inward THEN 'INFLOW' ELSE 'OUTFLOW' END END AS direction, CASE WHEN m = 0 THEN '12345 67890 SHOP ' || id END AS merchant, CASE WHEN m = 1 THEN 'ACME ' || id END AS counterparty,
 CASE WHEN m < 4 AND id % 3 = 0 THEN 'HSBC' || id END AS tracking_key, CASE WHEN m < 4 THEN strftime(day, '%Y-%m-%d') END AS day FROM o""")
def utf13_column_statements(spark, d):
    """Orders as column statements of a month with an annex: a card's line, a charge that names someone, a bare charge, a line of
    another kind, and a line without its day, which fails the document."""
    k = F.col("o_orderkey")
    m, name, day = k % 5, k.cast("string"), F.to_date("o_orderdate")
    amount = F.concat(F.lit("$"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    inward, dmy = F.col("o_orderstatus") == "F", lambda c: F.date_format(c, "dd/MM/yyyy")
    annex = lambda c: F.when(k % 3 == 0, c)
    raw = xhtml(
        (60, 5, dmy(F.trunc(day, "month"))), (120, 5, F.lit("al")), (180, 5, dmy(F.last_day(day))),
        (45, 20, F.when(m == 4, "40").otherwise(F.day(day).cast("string"))), (60, 20, F.when(m == 0, "12345 67890").when(m.isin(1, 2), "CGO").otherwise("G20")),
        (150, 20, F.when(m == 0, F.concat(F.lit("SHOP "), name)).when(m == 1, F.concat(F.lit("ACME "), name)).when(m == 3, "PAGO")),
        (370, 20, F.when(~inward, amount)), (430, 20, F.when(inward, amount)), (520, 20, F.lit("$9.00")),
        (60, 40, annex(F.when(inward, "SPEI-Recibidos").otherwise("SPEI-Enviados"))), (60, 60, annex(dmy(day))), (130, 60, annex(F.lit("10:20:30"))), (200, 60, annex(amount)), (470, 60, annex(F.concat(F.lit("HSB"), name))),
    )
    ev = spread(table(spark, d, "orders"), "o_orderkey").select(name.alias("id"), F.lit("STATEMENT_COLUMNS_V1").alias("extraction_profile"), F.lit("application/xhtml+xml").alias("content_type"), raw.alias("raw_content"))
    day_told = F.date_format(V.day_in_zone(F.try_to_timestamp(F.get("claims", F.lit(0))["occurred_at"]["value"]), "America/Mexico_City"), "yyyy-MM-dd").alias("day")
    return interpret(ev).select(F.col("id").cast("bigint").alias("id"), "status", "problem", field("amount_minor").cast("bigint").alias("amount_minor"), *map(field, ("direction", "merchant", "counterparty", "tracking_key")), day_told)


@query_("""WITH m AS (SELECT DISTINCT l_orderkey AS evidence_id, sha256('interpretation:' || l_orderkey) AS id FROM lineitem) SELECT id, evidence_id, 'EMAIL_V1' AS extraction_profile, 0 AS unread_rows FROM m""")
def snk10_migrations(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("evidence_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"))
    return migrations.migrate({"claim_evidence": li}, 0)[0]["interpretations"]


def joined(*parts) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def utf8(*parts) -> Column:
    return F.encode(joined(*parts), "UTF-8")


def encoded_word(c: Column) -> Column:
    return joined("=?UTF-8?B?", F.base64(F.encode(c, "UTF-8")), "?=")


@query_("""SELECT page_id, CASE WHEN page_id % 7 < 5 AND page_id % 11 > 0 THEN 'Página ' || page_id END AS subject, CASE WHEN page_id % 7 < 5 AND page_id % 11 > 0 THEN length(html) END AS n_chars,
 CASE WHEN page_id % 7 < 5 AND page_id % 11 > 0 THEN sha256(html) END AS html_sha256 FROM pages""")
def scl13_mail_bodies(spark, d):
    """Pages as messages: one part or within up to six multiparts (four levels are read), behind a plain part, in every transfer
    encoding and in one that is unknown; subjects as encoded words."""
    k = F.col("page_id")
    body = F.encode("html", "UTF-8")
    kind = F.when(k % 11 == 0, "x-own").when(k % 3 == 0, "base64").when(k % 3 == 1, "quoted-printable").otherwise("8bit")
    sent = F.when(k % 3 == 0, F.encode(F.base64(body), "UTF-8")).when(k % 3 == 1, F.encode(F.regexp_replace(F.hex(body), "(..)", "=$1"), "UTF-8")).otherwise(body)
    # Deeper parts first: a multipart of n levels holds the page at level n + 1. Levels: none, 1, 2, 3, 3 behind a text, then 4 and 5.
    depth = F.element_at(F.array(*map(F.lit, (0, 1, 2, 3, 3, 4, 5))), (k % 7 + 1).cast("int"))
    opened = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i < depth, joined("Content-Type: multipart/mixed; boundary=b", i.cast("string"), "\r\n\r\n--b", i.cast("string"), "\r\n")).otherwise("")))
    plain = F.when((k % 7 == 4), "Content-Type: text/plain\r\n\r\n<p>no</p>\r\n--b2\r\n").otherwise("")
    closed = F.concat_ws("", F.transform(F.sequence(F.lit(4), F.lit(0), F.lit(-1)), lambda i: F.when(i < depth, joined("\r\n--b", i.cast("string"), "--")).otherwise("")))
    raw = F.concat(utf8("Subject: ", encoded_word(joined("Página ", k.cast("string"))), "\r\n", opened, plain, "Content-Type: TEXT/html; charset=utf-8\r\nContent-Transfer-Encoding: ", kind, "\r\n\r\n"), sent, utf8(closed))
    m = small_batches(table(spark, d, "pages")).select("page_id", raw.alias("raw")).select("page_id", mail_html("raw").alias("m"))
    return m.select("page_id", "m.subject", F.length("m.html").cast("bigint").alias("n_chars"), F.sha2(F.encode("m.html", "UTF-8"), 256).alias("html_sha256"))


TOLD = ("amount_minor", "currency", "direction", "occurred_at", "counterparty", "merchant", "financial_status", "tracking_key")


def told(claim: int = 0) -> list[Column]:
    """What a claim says: money as a number, time in milliseconds, other fields as text, and all confidences in TOLD's order."""
    c = F.get("claims", F.lit(claim))
    whole = F.when(c.isNotNull(), F.concat_ws(" ", *[F.when(c[f].isNotNull(), joined(f, ":", c[f]["confidence"])) for f in TOLD])).alias("confidences")
    value = lambda f: c[f]["value"].alias(f)
    return [value("amount_minor").cast("bigint").alias("amount_minor"), F.unix_millis(F.try_to_timestamp(c["occurred_at"]["value"])).alias("occurred_at"), *[value(f) for f in TOLD if f not in ("amount_minor", "occurred_at")], whole]


@query_("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS m, o_orderkey % 13 AS f, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS a, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders),
 s AS (SELECT *, CASE WHEN f = 2 THEN 'the artifact has no html part' WHEN f = 3 THEN NULL WHEN f = 6 THEN 'DISPATCH' WHEN f = 5 AND m = 2 THEN 'the template changed' WHEN f IN (0, 4) THEN 'the amount did not parse' WHEN f = 1 AND m <> 2 THEN 'the timestamp did not parse' END AS problem FROM o),
 r AS (SELECT *, f <> 3 AND problem IS NULL AS ok FROM s)
 SELECT id, CASE WHEN problem IS NOT NULL THEN 'FAILED' WHEN ok THEN 'READ' ELSE 'UNRECOGNISED' END AS status, problem, CASE WHEN ok THEN a END AS amount_minor, CASE WHEN ok THEN 'MXN' END AS currency,
 CASE WHEN ok THEN CASE m WHEN 1 THEN 'INFLOW' ELSE 'OUTFLOW' END END AS direction,
 CASE WHEN ok AND m <> 2 THEN epoch_ms(timezone('UTC', timezone('America/Mexico_City', day + CASE m WHEN 3 THEN INTERVAL 560 MINUTE ELSE INTERVAL 37230 SECOND END))) END AS occurred_at,
 CASE WHEN ok AND m = 0 THEN CASE WHEN id % 3 = 0 THEN 'Ana & Co ' || id ELSE 'Bo ' || id END END AS counterparty, CASE WHEN ok AND m = 1 THEN 'Zoé ' || id WHEN ok AND m = 3 THEN 'Luz ' || id END AS merchant,
 CASE WHEN ok AND m < 2 THEN 'SETTLED' END AS financial_status, CASE WHEN ok AND m = 0 AND id % 7 < 3 THEN 'K' || id END AS tracking_key,
 CASE WHEN ok THEN 'amount_minor:' || CASE m WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END || ' currency:LOW direction:HIGH' || CASE m WHEN 2 THEN '' WHEN 3 THEN ' occurred_at:MEDIUM' ELSE ' occurred_at:HIGH' END
 || CASE WHEN m = 0 THEN CASE WHEN id % 3 = 0 THEN ' counterparty:HIGH' ELSE ' counterparty:MEDIUM' END ELSE '' END || CASE m WHEN 1 THEN ' merchant:MEDIUM' WHEN 3 THEN ' merchant:HIGH' ELSE '' END
 || CASE WHEN m = 1 OR m = 0 AND id % 5 > 0 THEN ' financial_status:MEDIUM' WHEN m = 0 THEN ' financial_status:HIGH' ELSE '' END || CASE WHEN m = 0 AND id % 7 < 3 THEN ' tracking_key:HIGH' ELSE '' END END AS confidences FROM r""")
def utf1_mail_claims(spark, d):
    """Orders as notification mails of the four templates, in five ways to encode a body, with and without the optional labels. By
    key some have a malformed or zero amount, a day that is none, no HTML part, a subject that no template has, a changed
    sentence, or another media type."""
    k = F.col("o_orderkey")
    m, f, name = k % 4, k % 13, k.cast("string")
    day = F.to_date("o_orderdate")
    amount = F.when(f == 0, "$12.5").when(f == 4, "$0.00").otherwise(joined("$", F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)))
    month = F.element_at(F.array(*[F.lit(x) for x in "ENE FEB MAR ABR MAY JUN JUL AGO SEP OCT NOV DIC".split()]), F.month(day))
    date = F.when(f == 1, "31/FEB/1996").when(k % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(joined(F.day(day).cast("string"), " ", month, " ", F.year(day).cast("string")))
    p = lambda *parts: joined("<p class=\"a>b\">", *parts, "</p>")
    no = F.lit("")
    usual = joined(p("<b>Monto:</b>"), p(amount), p("Fecha: ", date), p("Hora:<span> 10:20:30</span>"))
    out = joined(usual, F.when(k % 3 == 0, p("Nombre: Ana &amp; Co&nbsp;", name)).otherwise(p("Enviaste a la cuenta de Bo ", name, " en un banco")), F.when(k % 5 == 0, p("Estatus: hecha")).otherwise(no), F.when(k % 7 < 3, p("Clave de rastreo: K", name)).otherwise(no))
    came = joined(usual, p("Zoé ", name, " hizo una transferencia a tu cuenta"))
    card = joined(p("$77.00"), p(F.when(f == 5, "Recibimos tu pago").otherwise("Recibimos el pago que hiciste a tu tarjeta, por:")), p("$ 5.00 de ayer"), p(amount))
    service = joined(p("Monto:"), p(amount), p("Nombre: quien paga"), p("Costo extra: $9.00"), p(date, " - 09:20"), p("Empresa a la cual se realizará el pago:"), p("Luz ", name))
    html = joined("<html><head><title>Monto: $1.00</title></head><body><style>p{}</style><!-- Monto: $2.00 -->", F.when(m == 0, out).when(m == 1, came).when(m == 2, card).otherwise(service), "</body></html>")
    subject = F.element_at(F.array(*map(F.lit, ("Tu transferencia fue exitosa", "¡Recibiste una transferencia!", "¡Recibimos tu pago!", "Tu comprobante de pago de servicio"))), (m + 1).cast("int"))
    subject = F.when(f == 3, F.lower(subject)).otherwise(subject)
    way = (k / 4).cast("int") % 5
    kind = F.when(f == 2, "text/plain").otherwise("text/html")
    typed = lambda charset, coding: joined("Content-Type: ", kind, charset, "\r\nContent-Transfer-Encoding: ", coding, "\r\n\r\n")
    quoted = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "=", "=3D"), "á", "=E1"), "é", "=E9"), "</p>", "</p>=\r\n")
    b64 = F.base64(F.encode(html, "UTF-8"))
    part = (
        F.when(way == 0, utf8(typed("; charset=utf-8", "base64"), b64)).when(way == 1, utf8(typed("; charset=ISO-8859-1", "Quoted-Printable"), quoted)).when(way == 2, utf8(typed("", "8bit"), html))
        .when(way == 3, F.concat(utf8(typed("; charset=latin1", "binary")), F.encode(html, "ISO-8859-1")))
        .otherwise(utf8("Content-Type: multipart/mixed; boundary=x\r\n\r\n--x\r\nContent-Type: text/plain\r\n\r\nMonto: $3.00\r\n--x\r\nContent-Type: multipart/related; boundary=y\r\n\r\n--y\r\n", typed("; charset=utf-8", "base64"), b64, "\r\n--y--\r\n--x--"))
    )
    raw = F.concat(utf8("From: a@b.example\r\nSubject: ", F.when((m == 0) & (k % 3 == 0), subject).otherwise(encoded_word(subject)), "\r\nMIME-Version: 1.0\r\n"), part)
    ev = spread(table(spark, d, "orders"), "o_orderkey").select(name.alias("id"), F.lit("EMAIL_V1").alias("extraction_profile"), F.when(f == 6, "application/pdf").otherwise("message/rfc822").alias("content_type"), raw.alias("raw_content"))
    return interpret(ev).select(F.col("id").cast("bigint").alias("id"), "status", "problem", *told())


@query_(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 17 AS m, (o_orderkey // 17) % 2 = 0 AS inward, o_orderkey % 19 = 0 AS bad, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS a, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day FROM orders),
 s AS (SELECT *, m = 16 OR m IN (1, 3, 4) AND NOT inward OR m = 2 AND inward AS unread FROM o),
 p AS (SELECT *, CASE WHEN unread THEN NULL WHEN bad THEN 'the date did not parse' WHEN m IN (13, 15) AND NOT inward OR m = 14 AND inward THEN 'the statement changed' END AS problem FROM s), r AS (SELECT *, NOT unread AND problem IS NULL AS ok FROM p)
 SELECT id, CASE WHEN problem IS NOT NULL THEN 'FAILED' WHEN ok THEN 'READ' ELSE 'UNRECOGNISED' END AS status, problem, CASE WHEN unread THEN 1 ELSE 0 END AS unread_rows, CASE WHEN ok THEN a END AS amount_minor, CASE WHEN ok THEN 'MXN' END AS currency, CASE WHEN ok THEN CASE WHEN inward THEN 'INFLOW' ELSE 'OUTFLOW' END END AS direction,
 CASE WHEN ok THEN epoch_ms(timezone('UTC', timezone('America/Mexico_City', day + CASE WHEN m IN (13, 14) THEN INTERVAL 37230 SECOND ELSE INTERVAL 0 SECOND END))) END AS occurred_at,
 CASE WHEN ok THEN CASE WHEN m BETWEEN 1 AND 4 THEN '{SELF}' WHEN m = 8 THEN 'Sol ' || id WHEN m BETWEEN 13 AND 15 THEN 'Ana de ' || id END END AS counterparty, CASE WHEN ok AND m IN (0, 5, 6, 7) THEN 'Sol ' || id END AS merchant,
 CASE WHEN ok THEN 'SETTLED' END AS financial_status, CASE WHEN ok AND m IN (13, 14) THEN 'K' || id END AS tracking_key,
 CASE WHEN ok THEN 'amount_minor:HIGH currency:LOW direction:HIGH occurred_at:HIGH' || CASE WHEN m BETWEEN 1 AND 4 OR m BETWEEN 13 AND 15 THEN ' counterparty:HIGH' WHEN m = 8 THEN ' counterparty:MEDIUM' ELSE '' END
 || CASE WHEN m IN (0, 5, 6, 7) THEN ' merchant:MEDIUM' ELSE '' END || ' financial_status:MEDIUM' || CASE WHEN m IN (13, 14) THEN ' tracking_key:HIGH' ELSE '' END END AS confidences FROM r""")
def utf9_statement_shapes(spark, d):
    """Orders as block statements of one row each, by key of every shape and both signs: purchases, moves between accounts of one
    user and their mirrors, described rows, fixed phrases, transfers told by two lines below, and an unknown one. Some days are none."""
    k = F.col("o_orderkey")
    m, name, day = k % 17, k.cast("string"), F.to_date("o_orderdate")
    month = F.element_at(F.array(*[F.lit(x) for x in "ENE FEB MAR ABR MAY JUN JUL AGO SEP OCT NOV DIC".split()]), F.month(day))
    date = F.when(k % 19 == 0, "31 FEB 1996").otherwise(joined(F.day(day).cast("string"), " ", month, " ", F.year(day).cast("string")))
    amount = joined(F.when((k / 17).cast("long") % 2 == 0, "+$").otherwise("-$"), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2))
    shapes = (
        ("Sol ", name, " Compra"), ("Retiro de Cajita: ", name), ("Depósito en Cajita: ", name), ("Retirado de tu dinero de respaldo",), ("Descongelamos saldo de tu Cajita: ", name),
        ("Sol ", name, " Devolución"), ("Sol ", name, " Ajuste realizado"), ("Pago de servicio - Sol ", name), ("Cajero Sol ", name, " Retiro de efectivo"),
        ("Pago a tu tarjeta de crédito Nu",), ("Bonificación por beneficio de Nu",), ("Compensación de retraso SPEI",), ("Depósito en punto de venta",), *[("Ana de ", name)] * 3,
    )
    text = F.element_at(F.array(*[joined(*x) for x in shapes], F.lit("otra cosa")), (m + 1).cast("int"))
    opening = F.when(m == 14, "Transferencia SPEI, Al cliente Ana de").when(m.isin(13, 15), "Depósito SPEI, Del cliente Ana de")
    rest = joined(name, " (Dato no verificado por esta institución)", F.when(m < 15, joined(", Hora: 10:20:30, Clave de rastreo K", name, " , Concepto x")).otherwise(""))
    raw = xhtml((60, 100, date), (500, 100, amount), (140, 101, text), (135.84, 115, opening), (135.84, 125, F.when(m.isin(13, 14, 15), rest)), (300, 300, F.lit("pie de página")))
    ev = spread(table(spark, d, "orders"), "o_orderkey").select(name.alias("id"), F.lit("STATEMENT_BLOCKS_V1").alias("extraction_profile"), F.lit("application/xhtml+xml").alias("content_type"), raw.alias("raw_content"))
    return interpret(ev).select(F.col("id").cast("bigint").alias("id"), "status", "problem", "unread_rows", *told())


@query_("""WITH e AS (SELECT event_id AS k, ts FROM events) SELECT k AS event_id, unnest(list_filter([CASE WHEN k % 11 = 0 THEN 'ID' END, CASE WHEN k % 7 < 2 THEN 'SOURCE' END, CASE WHEN k % 5 = 0 THEN 'REFERENCE' END, CASE WHEN k % 4 > 2 THEN 'TYPE' END, CASE WHEN k % 3 = 0 THEN 'OBSERVED_AT' END], lambda x: x IS NOT NULL)) AS violation FROM e""")
def val1_evidence_fields(spark, d):
    """Evidence whose required fields are by key empty, null or, for the type, outside the vocabulary."""
    k = F.col("event_id")
    ev = table(spark, d, "events").select(
        k, F.when(k % 11 > 0, k.cast("string")).alias("id"), F.when(k % 7 == 0, "").when(k % 7 > 1, "s").alias("source_id"), F.when(k % 5 > 0, "r").otherwise("").alias("source_reference"),
        F.when(k % 4 < 3, F.element_at(F.array(F.lit("GMAIL"), F.lit("BANK_STATEMENT"), F.lit("MANUAL")), (k % 4 + 1).cast("int"))).when(k % 8 == 3, "gmail").alias("source_type"), F.when(k % 3 > 0, F.col("ts")).alias("observed_at"),
    )
    return quality.evidence_violations(ev).select("event_id", F.explode("violations").alias("violation"))

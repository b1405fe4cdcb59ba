"""The ledger's functions, reconciliation and writes: accept/refuse tables, invariants, and in-memory versions."""

import base64
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import statement
from ledgerloom import schemas
from ledgerloom.functions import values as V
from ledgerloom.operators import geometry, match, quality, query, store
from ledgerloom.plans.checkpoint import cut
from ledgerloom.sources import config, uploads
from ledgerloom.text import html, interpreters


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select(F.col("i"), f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_money(spark):
    cases = {"$1,234.56": 123456, " $ 0.01 ": 1, "12.30": 1230, "1,234,567.00": 123456700, "1234.56": None, "$1,23.00": None, "-1.00": None, "1.5": None, "1": None, "": None, "1.00 \n": 100, "٣.00": None, "999,999,999,999,999,999,999.00": None}
    assert column(spark, cases, V.money_minor) == list(cases.values())
    errors = column(spark, ["1", "1.5", "", None, "1234.56", "1.00"], V.money_error)
    assert errors == ["UNSUPPORTED_FORMAT", "UNSUPPORTED_FORMAT", "NOT_MONEY", "NOT_MONEY", "NOT_MONEY", None]


def test_dates_and_clocks(spark):
    cases = {
        "5/ENE/2026": datetime(2026, 1, 5), "5 ene  2026": datetime(2026, 1, 5), "05/01/2026 - 7:05": datetime(2026, 1, 5, 7, 5), "31/12/2026 - 23:59:58": datetime(2026, 12, 31, 23, 59, 58),
        "30/feb/2026": None, "5/jan/2026": None, "2026-01-05": None, "5/1/26": None, "5/1/2026 - 24:00": None, "": None,
    }
    assert column(spark, cases, V.wall_date) == list(cases.values())
    clocks = {"7:05": 25500, "23:59:59": 86399, "24:00": None, "7:5": None, "07:60": None, "x": None}
    assert column(spark, clocks, V.clock) == list(clocks.values())
    day = spark.sql("select timestamp'2026-06-01 05:59:00' a, timestamp'2026-06-01 06:00:00' b").select(*[V.day_in_zone(F.col(c)).cast("string") for c in "ab"]).first()
    assert tuple(day) == ("2026-05-31", "2026-06-01")


def test_small_values(spark):
    assert column(spark, ["MXN", "mxn", "USD", None], V.currency_ok) == [True, False, False, False]
    assert column(spark, ["1", "2", "12", "50", "0"], lambda c: V.backoff_minutes(c.cast("int"))) == [1, 2, 1440, 1440, 1]
    assert column(spark, [schemas.SELF, "urn:ledger:other", "Ana", None], V.counterparty_ok) == [True, False, True, True]
    assert column(spark, ["1234 5678 90 X", "12345x67890", None], V.is_card) == [True, False, False]
    assert column(spark, ["Clave de rastreo HSB12, x", "Clave de rastreo HSBX1", "none"], V.tracking_key) == ["HSBC12", "HSBX1", None]
    assert column(spark, ["-$1.00", "+$2.00", "$3.00", "-$0.00"], lambda c: V.signed_money(c)["direction"]) == ["OUTFLOW", "INFLOW", None, None]
    t = spark.sql("select timestamp'2026-01-02 03:04:05.678' t, 'A1' id").select(V.cursor(F.col("t"), F.col("id")).alias("c"))
    assert "=" not in t.first()[0]
    assert tuple(t.select(V.cursor_fields(F.col("c"))["t"], V.cursor_fields(F.col("c"))["id"]).first()) == ("2026-01-02T03:04:05.678Z", "A1")


def tx(spark, rows):
    """(id, source, amount, direction, merchant, counterparty, when, key)"""
    full = [(i, s, a, "MXN" if a is not None else None, m, c, d, "SETTLED", "UNRECONCILED", "ACTIVE", None, datetime.fromisoformat(w), k) for i, s, a, d, m, c, w, k in rows]
    return spark.createDataFrame(full, schemas.TRANSACTION)


NOON = "2026-06-01T12:00:00"


def decided(df):
    return {(r["left_ref"], r["right_ref"]): (r["status"], r["basis"]) for r in df.collect()}


def test_scenarios(spark):
    s = schemas.SELF
    rows = [
        ("a1", "x", 1, "INFLOW", None, None, NOON, "K1"), ("a2", "y", 2, "INFLOW", None, None, NOON, "K1"), ("a3", "y", 3, "INFLOW", None, None, NOON, "K1"),
        ("b1", "x", 10, "INFLOW", None, None, NOON, "K2"), ("b2", "y", 11, "OUTFLOW", None, None, NOON, "K2"),
        ("c1", "x", 20, "INFLOW", None, s, NOON, "K3"), ("c2", "y", 21, "INFLOW", None, "Ana", NOON, "K3"),
        ("d1", "x", 30, "OUTFLOW", "Ana  ", None, "2026-06-01T05:00:00", None), ("d2", "y", 30, "OUTFLOW", None, "ANA", "2026-05-31T23:00:00", None),
        ("e1", "x", 40, "OUTFLOW", "Bo", None, NOON, None), ("e2", "x", 40, "OUTFLOW", "Bo", None, NOON, None),
        ("f1", "x", 50, "OUTFLOW", "Cy", None, NOON, None), ("f2", "y", 50, "OUTFLOW", "Di", None, NOON, None), ("f3", "z", 50, "OUTFLOW", None, s, NOON, None),
        ("g1", "x", None, "OUTFLOW", "Ed", None, NOON, None), ("g2", "y", None, "OUTFLOW", "Ed", None, NOON, None),
    ]
    after, found = match.run(tx(spark, rows))
    assert decided(found) == {
        ("a1", "a2"): ("MATCH", "tracking_key"), ("a1", "a3"): ("MATCH", "tracking_key"), ("b1", "b2"): ("NO_MATCH", "tracking_key"), ("c1", "c2"): ("NO_MATCH", "tracking_key"),
        ("d1", "d2"): ("MATCH", "composite"), ("e1", "e2"): ("AMBIGUOUS", "weak"), ("f1", "f2"): ("AMBIGUOUS", "weak"), ("f1", "f3"): ("NO_MATCH", "weak"),
    }
    state = {r["id"]: (r["transaction_state"], r["reconciliation_state"], r["superseded_by"]) for r in after.collect()}
    assert state["a1"] == ("ACTIVE", "RECONCILED", None) and state["a3"] == ("SUPERSEDED", "RECONCILED", "a1") and state["e1"] == ("ACTIVE", "UNRECONCILED", None)
    again, more = match.run(cut(after), cut(found))
    assert more.count() == found.count() and again.exceptAll(after).count() == 0
    bridge = after.select(F.col("id").alias("transaction_id"), F.concat(F.lit("E"), "id").alias("evidence_id"))
    assert sorted(r[1] for r in match.provenance_union(bridge, found).where("transaction_id = 'a1'").collect()) == ["Ea1", "Ea2", "Ea3"]


def test_drain_reaches_later_stars(spark):
    s = schemas.SELF
    rows = [("a", "x", 1, "INFLOW", None, None, NOON, "K"), ("b", "y", 2, "INFLOW", None, None, NOON, "K"), ("c", "y", 3, "INFLOW", None, s, NOON, "K"), ("d", "z", 4, "INFLOW", None, s, NOON, "K")]
    _, found = match.drain(tx(spark, rows), cut)
    assert decided(found)[("c", "d")] == ("MATCH", "tracking_key") and len(decided(found)) == 4


def test_regression_counts(spark):
    """Counts of one run at the smallest scale, known from the blueprint."""
    got = {(r["basis"], r["status"]): r["n"] for r in entry.queries()["agg7_match_counters"](spark, "/root/testdata/sf0.001").collect()}
    assert got[("tracking_key", "MATCH")] == 84 and got[("tracking_key", "NO_MATCH")] == 66 and got[("composite", "MATCH")] == 288 and got[("composite", "NO_MATCH")] == 25


def test_lists_and_totals(spark):
    rows = [(f"t{i}", "x", i, "INFLOW" if i % 2 else "OUTFLOW", None, schemas.SELF if i == 7 else None, f"2026-06-0{1 + i % 3}T00:00:00", None) for i in range(10)]
    df = tx(spark, rows)
    first = query.list_transactions(df, query.TransactionQuery(limit=4)).collect()
    assert len(first) == 5
    rest = query.list_transactions(df, query.TransactionQuery(limit=50, after=(first[3]["occurred_at"], first[3]["id"]))).collect()
    seen = [r["id"] for r in first[:4] + rest]
    assert sorted(seen) == sorted(r[0] for r in rows) and seen == [r["id"] for r in sorted(df.collect(), key=lambda r: (r["occurred_at"], r["id"]), reverse=True)]
    assert tuple(query.summary(df).first()) == (1 + 3 + 5 + 9, 0 + 2 + 4 + 6 + 8, 1, 18 - 20)
    assert {r[0]: r[1] for r in query.totals(df).collect()} == {"INFLOW": 18, "OUTFLOW": 20}
    bounds = {"since": datetime(2026, 2, 1), "before": datetime(2026, 1, 1)}
    for field, bad in (("limit", {"limit": 0}), ("limit", {"limit": 201}), ("direction", {"directions": ("UP",)}), ("from", bounds), ("reconciliation_state", {"states": ("DONE",)}), ("currency", {"currency": "XYZ"})):
        with pytest.raises(ValueError, match=f"^{field}:"):
            query.TransactionQuery(**bad)
    assert query.list_transactions(df, query.TransactionQuery(states=("UNRECONCILED", "CONFLICTED"), currency="MXN")).columns == df.columns


def test_magic(spark):
    df = spark.createDataFrame([(b"%PDF-1.7 x",), (b"%PDF",), (b" %PDF-",), (b"",), (None,)], "raw binary")
    assert [r[0] for r in df.select(V.starts_with(df.raw)).collect()] == [True, False, False, False, False]


def test_writes(spark):
    new = spark.createDataFrame([("s", "r1", 2), ("s", "r1", 1), ("s", "r2", 3)], "source_id string, ref string, id int")
    have = spark.createDataFrame([("s", "r2", 9)], "source_id string, ref string, id int")
    first = store.insert_if_absent(new, have, ["source_id", "ref"], "id")
    assert [tuple(r) for r in first.collect()] == [("s", "r1", 1)]
    assert store.insert_if_absent(new, have.unionByName(first), ["source_id", "ref"], "id").count() == 0
    slots = spark.createDataFrame([("e1", "i1"), ("e2", "i2")], "evidence_id string, current string")
    wanted = spark.createDataFrame([("e1", "i1", "n1"), ("e2", "old", "n2"), ("e2", None, "n3"), ("e3", None, "n4"), ("e3", None, "n5")], "evidence_id string, expected string, next string")
    assert {tuple(r) for r in store.compare_and_swap(slots, wanted).collect()} == {("e1", "n1"), ("e2", "i2"), ("e3", "n4")}
    events = store.events_of(spark.range(50).select("id", F.timestamp_seconds(F.lit(100) - F.col("id")).alias("at")), "Kind", ["id"], "at", after=7).orderBy("seq").collect()
    assert [r["seq"] for r in events] == list(range(8, 58)) and json.loads(events[0]["payload"]) == {"id": 49}
    ev = spark.createDataFrame([("e", "s", "GMAIL", "r", None, None, datetime(2026, 1, 1)), ("", None, "FAX", "r", None, None, None)], schemas.EVIDENCE)
    assert [r["violations"] for r in quality.evidence_violations(ev).collect()] == [[], ["ID", "SOURCE", "TYPE", "OBSERVED_AT"]]


def test_bands_and_nearest(spark):
    words = spark.createDataFrame([(1, y, k) for k, y in enumerate([0, 1, 2, 3, 10])] + [(2, 5, 9)], "page int, y int, k int")
    assert {(r["page"], r["y"]): r["band"] for r in geometry.bands(words, 1).collect()} == {(1, 0): 0, (1, 1): 0, (1, 2): 2, (1, 3): 2, (1, 10): 10, (2, 5): 5}
    rows = spark.createDataFrame([(1, 4, "low"), (1, 8, "high")], "page int, row_y int, name string")
    points = spark.createDataFrame([(1, 6), (1, 3), (1, 20)], "page int, y int")
    assert {r["y"]: r["name"] for r in geometry.nearest_within(points, rows, 2).collect()} == {6: "high", 3: "low"}


def test_config_and_uploads(spark, tmp_path):
    (tmp_path / "sources.json").write_text(json.dumps({"sources": [{"id": "a", "type": "GMAIL"}, {"id": "a", "type": "FAX", "extraction_profile": "X"}, {"id": "b", "type": "MANUAL"}]}))
    rows = config.load(spark, str(tmp_path / "sources.json"))
    assert sorted((r[0], r[1]) for r in config.problems(rows).collect()) == [("a", "DUPLICATE_ID"), ("a", "NO_QUERY"), ("a", "UNKNOWN_PROFILE"), ("a", "UNKNOWN_TYPE")]
    ok = {"source_id": "s", "source_artifact_key": "k", "observed_at": "2026-01-02T03:04:05Z", "content_type": "x", "raw_content": "aGk="}
    bodies = [ok, ok | {"extra": 1}, ok | {"raw_content": "*"}, ok | {"observed_at": "yesterday"}, ok | {"source_artifact_key": ""}]
    df = spark.createDataFrame([(i, json.dumps(b), "MANUAL") for i, b in enumerate(bodies)] + [(9, "[1]", "MANUAL"), (10, json.dumps(ok), "GMAIL")], "i int, body string, source_type string")
    got = {r["i"]: (r["problem"], r["content"]) for r in uploads.decoded(df, "body").collect()}
    assert got[0] == (None, b"hi") and [got[i][0] for i in (1, 2, 3, 4, 9, 10)] == ["UNKNOWN_FIELD", "NOT_BASE64", "OBSERVED_AT", "NO_KEY", "NOT_AN_OBJECT", "SOURCE_TYPE"]


def test_html_text():
    assert html.text_of("<p>a<b>b</b> &amp; &NBSP;c</p><!-- x --><script>if (a < \"</p>\") </script>d<br>e") == "ab & c\nd\ne"
    assert html.text_of("<div title='a>b'>x</div>&copy; <unclosed") == "x\n&copy; <unclosed"
    assert html.text_of("a<!-- never") == "a" and html.text_of("a<style>never") == "a" and html.text_of(None) is None
    with pytest.raises(ValueError):
        html.text_of("x" * (html.HTML_BYTES + 1))


def mail(subject, body, extra=""):
    return f"Subject: {subject}\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html; charset=utf-8\n{extra}\n{body}\n--B--\n".encode()


def test_statement_shapes():
    read = lambda text, amount="-$5.00", *detail: interpreters.read_whole("STATEMENT_BLOCKS_V1", interpreters.XHTML, statement(("6 ENE 2026", text, amount, *detail)))
    changed = interpreters.PHRASES_OF["statement"]
    for text, amount in (("Retiro de Cajita: Viaje", "+$5.00"), ("Depósito en Cajita: Viaje", "-$5.00"), ("Retirado de tu dinero de respaldo", "+$5.00"), ("Descongelamos saldo de tu Cajita: Viaje", "+$5.00")):
        assert read(text, amount)[2][0]["counterparty"] == ("urn:ledger:self", "HIGH")
        assert read(text, {"+": "-", "-": "+"}[amount[0]] + amount[1:]) == ("UNRECOGNISED", None, [], 1)
    # A mirror is told by its sign before its day is read; a row that is read must have one.
    day_of_none = lambda amount: interpreters.read_whole("STATEMENT_BLOCKS_V1", interpreters.XHTML, statement(("31 FEB 2026", "Retiro de Cajita: Viaje", amount)))
    assert day_of_none("-$5.00") == ("UNRECOGNISED", None, [], 1) and day_of_none("+$5.00") == ("FAILED", interpreters.PHRASES_OF["date"], [], 0)
    for text, field, name in (("Tienda Devolución", "merchant", "Tienda"), ("Tienda Ajuste realizado", "merchant", "Tienda"), ("Pago de servicio - Luz", "merchant", "Luz"), ("Cajero Banco Retiro de efectivo", "counterparty", "Banco")):
        assert read(text)[2][0][field] == (name, "MEDIUM")
    for text in ("Pago a tu tarjeta de crédito Nu", "Bonificación por beneficio de Nu", "Compensación de retraso SPEI", "Depósito en punto de venta"):
        assert not {"merchant", "counterparty"} & set(read(text)[2][0])
    detail = "Del cliente Ana Paz (Dato no verificado por esta institución), Hora: 10:20:30,", "Clave de rastreo NU77 , Concepto x"
    (claim,) = read("Ana Paz", "+$5.00", "Depósito SPEI,", *detail)[2]
    assert claim["counterparty"] == ("Ana Paz", "HIGH") and claim["tracking_key"] == ("NU77", "HIGH") and claim["occurred_at"][0] == "2026-01-06T16:20:30.000Z"
    assert read("Ana Paz", "-$5.00", "Depósito SPEI,", *detail)[:2] == ("FAILED", changed)
    assert read("Ana Paz", "-$5.00", "Transferencia SPEI, Al cliente Bo")[:2] == ("FAILED", changed)
    assert read("Ana Paz", "-$5.00", "Transferencia SPEI, Al cliente Bo (Dato no verificado por esta institución)")[2][0]["counterparty"] == ("Bo", "HIGH")
    assert read("Otra cosa", "-$5.00") == ("UNRECOGNISED", None, [], 1) and read("SPEI recibido de Bo", "+$5.00") == ("UNRECOGNISED", None, [], 1)
    assert read("Tienda Compra", "-$0.00")[:2] == ("FAILED", interpreters.PHRASES_OF["amount"])


def test_raw_content_is_whole(spark, tmp_path):
    page = "<p>é" + "x" * 70_000 + "</p>"
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    r = entry.queries()["scl35_raw_content"](spark, str(tmp_path)).first()
    assert r["n_bytes"] == len(page.encode()) and base64.b64decode(r["raw"]) == page.encode()


def test_mail_interpreters():
    out = mail("Tu transferencia fue exitosa", "<p>Monto:</p><p>$1,200.50</p><p>Fecha: 5/ENE/2026</p><p>Hora: 10:30</p><p>Nombre: Ana</p><p>Clave de rastreo: K9</p>")
    status, problem, (claim,) = interpreters.read_one("EMAIL_V1", "message/rfc822", out)
    assert (status, problem) == ("READ", None)
    assert claim["amount_minor"] == ("120050", "HIGH") and claim["occurred_at"] == ("2026-01-05T16:30:00.000Z", "HIGH") and claim["counterparty"] == ("Ana", "HIGH") and claim["currency"] == ("MXN", "LOW")
    assert interpreters.read_one("EMAIL_V1", "message/rfc822", mail("Noticias", "<p>x</p>"))[0] == "UNRECOGNISED"
    assert interpreters.read_one("EMAIL_V1", "message/rfc822", out.replace(b"$1,200.50", b"1200.50"))[:2] == ("FAILED", interpreters.PHRASES_OF["amount"])
    assert interpreters.read_one("EMAIL_V1", "text/plain", out)[:2] == ("FAILED", "DISPATCH")
    assert interpreters.read_one("EMAIL_V1", "message/rfc822", b"Subject: x\n\nplain")[:2] == ("FAILED", interpreters.PHRASES_OF["html"])
    assert interpreters.read_one("EMAIL_V1", "message/rfc822", out.replace(b"$1,200.50", b"$0.00"))[:2] == ("FAILED", interpreters.PHRASES_OF["amount"])
    read = lambda subject, body: interpreters.read_one("EMAIL_V1", "message/rfc822", mail(f"=?utf-8?b?{base64.b64encode(subject.encode()).decode()}?=", body))
    incoming = read("¡Recibiste una transferencia!", "<p>Ana Paz hizo una transferencia a tu Cuenta por:</p><p>Monto: $3.00</p><p>Fecha: 5/ENE/2026</p><p>Hora: 10:30</p>")[2][0]
    assert incoming["merchant"] == ("Ana Paz", "MEDIUM") and incoming["direction"][0] == "INFLOW"
    service = read("Tu comprobante de pago de servicio", "<p>Monto: $9.00</p><p>5 ene 2026 - 10:30:00</p><p>Nombre: Yo</p><p>Empresa a la cual se realizará el pago:</p><p>Luz</p>")[2][0]
    assert service["merchant"] == ("Luz", "HIGH") and service["occurred_at"] == ("2026-01-05T16:30:00.000Z", "MEDIUM")
    assert read("¡Recibimos tu pago!", "<p>otro texto</p><p>$15.00</p>")[:2] == ("FAILED", interpreters.PHRASES_OF["template"])
    card = mail("=?utf-8?q?=C2=A1Recibimos_tu_pago!?=", "<p>Recibimos el pago que hiciste a tu tarjeta por:</p><p>$ 1.00</p><p>$15.00</p>")
    assert interpreters.read_one("EMAIL_V1", "message/rfc822", card)[2][0]["amount_minor"] == ("1500", "MEDIUM")
    assert interpreters.read_one("EMAIL_V1", "message/rfc822", mail("Tu transferencia fue exitosa", "<p>Monto:</p><p>$1.00</p><p>Fecha: 5/XXX/2026</p>"))[:2] == ("FAILED", interpreters.PHRASES_OF["timestamp"])
    assert interpreters.read_one("EMAIL_V1", "message/rfc822", mail("Tu transferencia fue exitosa", "x" * (html.HTML_BYTES + 1)))[:2] == ("FAILED", interpreters.PHRASES_OF["size"])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registered_queries_equal_their_sql(spark):
    """Some registered queries beside their SQL, over the smallest tables."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    for name in ("agg3_net", "srt2_page", "er1_candidates", "jn10_nearest_row", "prj2_claim_pivot", "snk1_insert_if_absent", "scl5_wall_date", "val3_claim_fields", "flt1_active", "flt4_currency", "flt8_money", "flt10_unreconciled", "er12_sticky", "jn1_tracking_lookup", "jn2_source_of", "jn3_confidence_lookup", "jn4_provenance", "jn5_active_claims", "jn6_claimless_kept", "jn7_victims", "scl12_html_text", "scl13_mail_bodies", "utf1_mail_claims", "utf9_statement_shapes", "val1_evidence_fields"):
        got = entry.queries()[name](spark, "/root/testdata/sf0.001")
        cols = sorted(got.columns)
        cur = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted((tuple(str(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()))
        assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == want, name


def test_oversized_artifacts_are_told(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import artifacts

    (tmp_path / "big").write_bytes(b"x" * 11)
    (tmp_path / "small").write_bytes(b"x")
    monkeypatch.setattr(artifacts, "FETCH_BYTES", 10)
    rows = {r[0]: r[2:] for r in artifacts.ArtifactReader({"path": str(tmp_path)}).read(artifacts.Chunk(["big", "small"]))}
    assert rows == {"big": (None, "OVERSIZED"), "small": (b"x", None)}

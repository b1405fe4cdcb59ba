"""Positioned words into rows: invented documents, one situation each."""

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import document
from ledgerloom.text import coordinates as C
from ledgerloom.text import interpreters as I


def test_block_rows():
    doc = document(
        [
            (500, 100, 110, "-$10.00"), (60, 100, 110, "5 ENE 2026"), (140, 101, 111, "Tienda Compra"), (135.84, 115, 125, "extra words"), (500, 130, 140, "USD 1.00"), (135.84, 130, 140, "rate"),
            (200, 150, 160, "furniture"), (60, 180, 190, "6 ENE 2026"), (500, 181, 190, "+$1.00"), (60, 200, 210, "7 ENE 2026"), (500, 200, 210, "+$7.00"), (500, 220, 230, "$99.00"),
        ],
        [(135.84, 20, 30, "carried over"), (60, 40, 50, "8 ENE 2026"), (500, 40, 50, "-$8.00"), (500, 40, 50, "-$9.00")],
    )
    rows = C.block_rows(C.parse(doc))
    assert [(r.place[0], r.said("date"), r.said("amount")) for r in rows] == [(1, "5 ENE 2026", "-$10.00"), (1, "7 ENE 2026", "+$7.00"), (2, "8 ENE 2026", "-$8.00")]
    assert rows[0].texts["beside"] == ["Tienda Compra"] and rows[0].texts["below"] == ["extra words"] and rows[0].texts["converted"] == ["rate", "USD 1.00"]
    assert rows[1].texts["below"] == ["carried over"]
    # Of two lines in reach of a text, equally near, the later one; two dates and two amounts with the same edges go in order.
    near = C.block_rows(C.parse(document([(60, 100, 110, "1 ENE 2026"), (500, 100, 110, "-$1.00"), (60, 103, 113, "2 ENE 2026"), (500, 103, 113, "-$2.00"), (140, 101.5, 111, "between")])))
    assert [r.texts["beside"] for r in near] == [[], ["between"]]
    twin = C.block_rows(C.parse(document([(60, 100, 110, "1 ENE 2026"), (70, 100, 110, "2 ENE 2026"), (500, 100, 110, "-$1.00"), (520, 100, 110, "-$2.00")])))
    assert [(r.said("date"), r.said("amount")) for r in twin] == [("1 ENE 2026", "-$1.00"), ("2 ENE 2026", "-$2.00")]


def test_column_rows():
    at = lambda y, **words: [C.Word(1, {"day": 45, "desc": 60, "ref": 300, "cargo": 370, "abono": 430, "balance": 520}[k], y, v) for k, v in words.items()]
    placed = at(10, day="5", desc="STORE", ref="123", cargo="$1.00", balance="$9.00") + at(18, ref="456") + at(40, ref="789") + at(50, day="6", desc="none") + at(60, day="7", abono="$2.00")
    rows = C.column_rows(placed)
    assert [(r.first("day"), r.first("cargo"), r.first("abono"), r.cells["reference"]) for r in rows] == [("5", "$1.00", "", ["123", "456"]), ("7", "", "$2.00", [])]


def test_annex_rows():
    w = lambda x, y, t, page=1: C.Word(page, x, y, t)
    placed = [w(10, 0, "01/01/2026"), w(10, 5, "SPEI-Enviados"), w(10, 10, "02/01/2026"), w(50, 10, "10:20:30"), w(90, 10, "$5.00"), w(470, 10, "HSB1"), w(470, 15, "000"), w(470, 18, "23"), w(470, 40, "far"), w(10, 50, "03/01/2026"), w(10, 60, "CoDi"), w(10, 70, "04/01/2026"), w(90, 70, "$1.00")]
    assert C.annex_rows(placed) == [{"date": "02/01/2026", "clock": "10:20:30", "amount": "$5.00", "key": "HSBC123", "direction": "OUTFLOW"}]


def test_glyphs_and_limits():
    names = " ".join(f"/EX{65 + i % 26:03d}000" for i in range(40))
    table = C.glyph_table(f"x /Differences [ 1 {names} ] y".encode())
    assert C.with_glyphs("\x01\x02é", table) == "AB" and C.glyph_table(b"none") is None and C.with_glyphs("x", None) == "x"
    for bad in (b"/Differences [ 1 /A ]", b"/Differences [ /EX065000 ]", b"/Differences [ 300 /EX065000 ]"):
        with pytest.raises(ValueError):
            C.glyph_table(bad)
    assert C.with_glyphs("’", {0x92: "Q"}) == "Q" and C.with_glyphs("字", {0x92: "Q"}) == "字"
    assert C.with_glyphs("a\nb\x01é\t\r", {97: "X", 10: "Z"}) == "X\n\t\r" and C.with_glyphs("ab", {97: "\0", 98: "B"}) == "B" and C.with_glyphs("€", {0x80: "E", 0x20AC: "no"}) == "E"
    assert [w.text for w in C.decoded([C.Word(1, 0, 0, "\x01"), C.Word(1, 0, 0, "\x90")], {1: "A"})] == ["A"]
    bomb = "<?xml version='1.0' encoding='{}'?><!DOCTYPE x [<!ENTITY a 'boom'>]><x><page><word xMin='1' yMin='1'>&a;&a;</word></page></x>"
    for read in (C.parse, C.words):
        for coding in ("utf-8", "utf-16"):
            with pytest.raises(C.Refused):
                read(bomb.format(coding).encode(coding))
        with pytest.raises(C.Refused):
            read(b" " * (C.DOCUMENT_BYTES + 1))


def test_statement_interpreters():
    from ledgerloom.text import interpreters as I

    blocks = document([(60, 100, 110, "5 ENE 2026"), (500, 100, 110, "-$10.00"), (140, 101, 111, "Tienda Compra")])
    status, _, (claim,) = I.read_one("STATEMENT_BLOCKS_V1", "application/xhtml+xml", blocks)
    assert status == "READ" and claim["merchant"] == ("Tienda", "MEDIUM") and claim["amount_minor"] == ("1000", "HIGH")
    columns = document([
        (60, 5, 6, "01/01/2026"), (120, 5, 6, "al"), (180, 5, 6, "31/01/2026"), (45, 20, 21, "9"), (60, 20, 21, "1234567890"), (200, 20, 21, "SHOP"), (370, 20, 21, "$4.00"),
        (60, 40, 41, "SPEI-Enviados"), (60, 50, 51, "09/01/2026"), (130, 50, 51, "10:20:30"), (200, 50, 51, "$4.00"), (470, 50, 51, "HSB77"),
    ])
    status, problem, claims = I.read_one("STATEMENT_COLUMNS_V1", "application/xhtml+xml", columns)
    assert (status, problem, len(claims)) == ("READ", None, 1)
    assert claims[0]["tracking_key"] == ("HSBC77", "HIGH") and claims[0]["occurred_at"][0] == "2026-01-09T16:20:30.000Z" and claims[0]["merchant"][0] == "1234567890 SHOP"
    assert I.read_one("STATEMENT_COLUMNS_V1", "application/xhtml+xml", blocks)[:2] == ("FAILED", I.PHRASES_OF["statement"])
    line = lambda *words: I.read_one("STATEMENT_COLUMNS_V1", I.XHTML, document([(60, 5, 6, "01/01/2026"), (120, 5, 6, "al"), (180, 5, 6, "31/01/2026"), (45, 20, 21, "9"), *[(60 + 40 * i, 20, 21, w) for i, w in enumerate(words)], (430, 20, 21, "$4.00")]))
    named = lambda *words: {k: v for k, v in line(*words)[2][0].items() if k in ("merchant", "counterparty")}
    assert named("12 345", "67890", "SHOP") == {"merchant": ("12 345 67890 SHOP", "MEDIUM")} and named("123456789", "SHOP") == {}
    assert named("CGO") == {} and named("CGO", "ACME", "SA") == {"counterparty": ("ACME SA", "MEDIUM")} and named("G20", "x") == {} and named("NETNM", "DEPOSITO") == {}
    assert I.read_one("STATEMENT_BLOCKS_V1", I.XHTML, b"<doc><page>")[:2] == ("FAILED", I.PHRASES_OF["coordinates"])
    assert I.read_one("STATEMENT_BLOCKS_V1", I.XHTML, document([]))[0] == "UNRECOGNISED"


def test_pdf_goes_through_an_extractor(tmp_path):
    """Magic, the glyph table of the PDF itself, a program that is missing, fails, hangs or writes too much."""
    import sys

    from ledgerloom.sources.extractor import NotExtracted, by_program
    from ledgerloom.text import interpreters as I

    code = {c: i + 128 for i, c in enumerate(dict.fromkeys("0123456789/al$.CGO SHPQRTUVWXYZBDEFIJKLMN"))}
    hidden = lambda text: "".join(bytes([code[c]]).decode("latin-1") for c in text)
    names = " ".join(f"/EX{ord(c):03d}000" for c in code)
    pdf = f"%PDF-1.7 /Differences [ 128 {names} ]".encode()
    page = document([(x, y, y + 1, hidden(t)) for x, y, t in [(60, 5, "01/01/2026"), (120, 5, "al"), (180, 5, "31/01/2026"), (45, 20, "9"), (60, 20, "CGO"), (100, 20, "SHOP"), (370, 20, "$4.00")]])
    status, problem, claims = I.read_one("STATEMENT_COLUMNS_V1", "application/pdf", pdf, lambda raw: page)
    assert (status, problem) == ("READ", None) and claims[0]["counterparty"] == ("SHOP", "MEDIUM") and claims[0]["amount_minor"] == ("400", "HIGH")
    assert I.read_one("STATEMENT_COLUMNS_V1", "application/pdf", b" " + pdf, lambda raw: page)[:2] == ("FAILED", "DISPATCH")
    assert I.read_one("STATEMENT_COLUMNS_V1", "application/pdf", b"%PDF-1.7 /Differences [ 128 /A ]", lambda raw: page)[:2] == ("FAILED", I.PHRASES_OF["encoding"])
    assert I.read_one("EMAIL_V1", "application/pdf", pdf)[:2] == ("FAILED", "DISPATCH")
    assert I.read_one("STATEMENT_BLOCKS_V1", "application/pdf", pdf, by_program(("/no/such/program",)))[:2] == ("FAILED", I.PHRASES_OF["extraction"])
    program = lambda text, **bounds: by_program((sys.executable, "-c", f"import sys, time; raw = sys.stdin.buffer.read(); {text}"), **bounds)
    assert program("sys.stdout.buffer.write(raw[::-1])")(b"abc" * 100_000) == b"cba" * 100_000
    for bad in (program("sys.exit(1)"), program("time.sleep(60)", seconds=0.5), program("print('x' * 1000)", most=100)):
        with pytest.raises(NotExtracted):
            bad(b"x")


def test_the_days_of_a_period():
    """Found without going through them: a period of centuries costs what a month does."""
    for first in (date(2023, 12, 30), date(2024, 1, 31), date(2024, 2, 1), date(2023, 2, 2)):
        for length in (-1, 0, 20, 70):
            days = [first + timedelta(i) for i in range(length + 1)]
            for number in range(40):
                assert I.day_within(first, first + timedelta(length), number) == next((x for x in days if x.day == number), None)
    assert I.day_within(date(1700, 1, 1), date(2200, 1, 1), 31) == date(1700, 1, 31)


def test_local_times_as_pandas_has_them():
    for local in ((1996, 4, 7, 3, 0, 0), (1996, 10, 26, 23, 59, 59), (1969, 1, 1, 0, 0, 0), (2037, 7, 1, 1, 2, 3), (2040, 1, 1, 0, 0, 0)):
        assert I.in_utc(*local) == pd.Timestamp(*local).tz_localize(I.ZONE).tz_convert("UTC").strftime("%Y-%m-%dT%H:%M:%S.000Z")
    for none in ((1996, 4, 7, 2, 30, 0), (1996, 10, 27, 1, 30, 0), (1996, 2, 30, 0, 0, 0)):  # never, twice, no day
        with pytest.raises(Exception):
            I.in_utc(*none)


def test_artifacts_are_read_by_all_tasks(spark):
    """Tables of one row group are dealt out before they become artifacts."""
    for name in ("utf13_column_statements", "utf1_statement_interpreters", "utf1_mail_claims", "utf9_statement_shapes"):
        parts = entry.queries()[name](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts >= 4, name


def test_workers_get_small_batches(spark):
    for name in ("scl13_mail_bodies", "scl12_html_text", "utf1_mail_claims"):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "16m"

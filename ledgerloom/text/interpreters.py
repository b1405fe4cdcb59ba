"""Notification e-mails and statements read into claims: one artifact in, none or more claims out.

An artifact that no template knows is an ordinary outcome (no claims, status UNRECOGNISED); one that a template knows
but cannot read is FAILED with one of PHRASES_OF, never a half-read claim and never a part of its text. A failure never
leaves its own row. Statements come as PDFs, which an extractor turns into XHTML, or as that XHTML.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime
from xml.parsers import expat
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.projection import small_batches
from ..sources.extractor import Extractor, NotExtracted, by_program
from . import coordinates, html

# Subjects, labels and months of the templates.
SUBJECTS = {"Tu transferencia fue exitosa": "transfer_out", "¡Recibiste una transferencia!": "transfer_in", "¡Recibimos tu pago!": "card_payment", "Tu comprobante de pago de servicio": "service_payment"}
MONTHS = {m: i for i, m in enumerate("ene feb mar abr may jun jul ago sep oct nov dic".split(), 1)}
MONEY = re.compile(r"\$?\s*([0-9]{1,3}(?:,[0-9]{3})*)\.([0-9]{2})\Z")
DATE = re.compile(r"([0-9]{1,2})[/ ]([A-Za-z]{3}|[0-9]{1,2})[/ ]([0-9]{4})(?: - ([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?\Z")

Claim = dict[str, tuple]
SCHEMA = "status string, problem string, claims array<map<string,struct<value:string,confidence:string>>>, unread_rows int"


# What a failure is told as, whatever its cause said.
PHRASES_OF = {
    "amount": "the amount did not parse", "date": "the date did not parse", "timestamp": "the timestamp did not parse", "html": "the artifact has no html part",
    "size": "the artifact exceeds the size cap", "template": "the template changed", "statement": "the statement changed", "extraction": "the statement could not be extracted",
    "coordinates": "the coordinate document could not be read", "encoding": "the encoding table could not be read", "other": "the artifact could not be read", "dispatch": "DISPATCH",
}


class Unreadable(ValueError):
    """A part that could not be read; its kind is a key of PHRASES_OF."""

    @property
    def phrase(self) -> str:
        return PHRASES_OF[self.args[0]]


def money(text: str | None) -> str:
    m = MONEY.fullmatch((text or "").strip())
    if not m:
        raise Unreadable("amount")
    minor = int(m[1].replace(",", "") + m[2])
    if not minor:  # a movement of nothing is no movement
        raise Unreadable("amount")
    return str(minor)


ZONE, ZONE_YEARS = "America/Mexico_City", range(1970, 2038)


def in_utc(*local: int) -> str:
    """A local time (year to second) in UTC; ValueError where it is none. pandas tells a time that is twice or never, and far years."""
    at = datetime(*local, tzinfo=ZoneInfo(ZONE))
    shift = at.utcoffset()
    if local[0] in ZONE_YEARS and shift == at.replace(fold=1).utcoffset():
        return (at.replace(tzinfo=None) - shift).isoformat() + ".000Z"
    return pd.Timestamp(*local).tz_localize(ZONE).tz_convert("UTC").strftime("%Y-%m-%dT%H:%M:%S.000Z")


def wall(text: str | None, clock: str | None = None) -> str:
    m = DATE.fullmatch(" ".join((text or "").split()))
    if not m:
        raise Unreadable("date")
    month = MONTHS.get(m[2].lower()) if m[2].isalpha() else int(m[2])
    hour = m[4], m[5], m[6]
    if m[4] is None and clock:
        c = re.fullmatch(r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?", clock.strip())
        if not c:
            raise Unreadable("date")
        hour = c[1], c[2], c[3]
    try:
        return in_utc(int(m[3]), month or 0, int(m[1]), *[int(x or 0) for x in hour])
    except ValueError as e:
        raise Unreadable("date") from e


def labelled(lines: list[str], label: str) -> str | None:
    """The rest of the first line with the label, else the line below it."""
    for i, line in enumerate(lines):
        if label in line:
            rest = line.split(label, 1)[1].strip()
            return rest or ((lines[i + 1].strip() or None) if i + 1 < len(lines) else None)
    return None


def between(lines: list[str], a: str, b: str) -> str | None:
    for line in lines:
        if a in line and b in line.split(a, 1)[1]:
            return line.split(a, 1)[1].split(b, 1)[0].strip() or None
    return None


def base(amount: str, confidence: str, way: str) -> Claim:
    return {"amount_minor": (amount, confidence), "currency": ("MXN", "LOW"), "direction": (way, "HIGH")}


def transfer_out(lines: list[str]) -> Claim:
    out = base(money(labelled(lines, "Monto:")), "HIGH", "OUTFLOW")
    out["occurred_at"] = (wall(labelled(lines, "Fecha:"), labelled(lines, "Hora:")), "HIGH")
    name = labelled(lines, "Nombre:")
    prose = None if name else between(lines, "a la cuenta de ", " en ")
    if name or prose:
        out["counterparty"] = (name or prose, "HIGH" if name else "MEDIUM")
    out["financial_status"] = ("SETTLED", "HIGH" if labelled(lines, "Estatus:") else "MEDIUM")
    if key := labelled(lines, "Clave de rastreo:"):
        out["tracking_key"] = (key, "HIGH")
    return out


def transfer_in(lines: list[str]) -> Claim:
    out = base(money(labelled(lines, "Monto:")), "HIGH", "INFLOW")
    out["occurred_at"] = (wall(labelled(lines, "Fecha:"), labelled(lines, "Hora:")), "HIGH")
    out["financial_status"] = ("SETTLED", "MEDIUM")
    for line in lines:
        if (i := line.find(" hizo una transferencia a tu")) > 0:
            out["merchant"] = (line[:i].strip(), "MEDIUM")
            break
    return out


def card_payment(lines: list[str]) -> Claim:
    at = next((i for i, x in enumerate(lines) if between([x], "el pago que hiciste a tu ", " por")), None)
    if at is None:
        raise Unreadable("template")
    amount = next((x for x in lines[at:] if x.startswith("$") and " " not in x and "\t" not in x), None)
    return base(money(amount), "MEDIUM", "OUTFLOW")


def service_payment(lines: list[str]) -> Claim:
    out = base(money(labelled(lines, "Monto:")), "HIGH", "OUTFLOW")
    stamp = next((x for x in lines if (m := DATE.fullmatch(x)) and m[4]), None)
    out["occurred_at"] = (wall(stamp), "MEDIUM")
    if name := labelled(lines, "Empresa a la cual se realizará el pago:"):
        out["merchant"] = (name, "HIGH")
    return out


TEMPLATES: dict[str, Callable[[list[str]], Claim]] = {"transfer_out": transfer_out, "transfer_in": transfer_in, "card_payment": card_payment, "service_payment": service_payment}


# Statement shapes: prefixes of moves between accounts of one user and the direction that each has on the account's
# side; descriptions that name their kind; openings of a SPEI detail, the words before the other party and the direction.
INTERNAL = {"Retiro de Cajita:": "INFLOW", "Depósito en Cajita:": "OUTFLOW", "Retirado de tu dinero de respaldo": "INFLOW", "Descongelamos saldo de tu Cajita:": "INFLOW"}
DESCRIPTORS = ((re.compile(r"(.+) Devolución", re.S), "merchant"), (re.compile(r"(.+) Ajuste realizado", re.S), "merchant"), (re.compile(r"Pago de servicio - (.+)", re.S), "merchant"), (re.compile(r"Cajero (.+) Retiro de efectivo", re.S), "counterparty"))
PHRASES = ("Pago a tu tarjeta de crédito Nu", "Bonificación por beneficio de Nu", "Compensación de retraso SPEI", "Depósito en punto de venta")
SPEI = {"Depósito SPEI,": ("Del cliente ", "INFLOW"), "Transferencia SPEI,": ("Al cliente ", "OUTFLOW")}
UNVERIFIED = "(Dato no verificado por esta institución)"
CLOCK = re.compile(r"Hora: ([0-9]{1,2}:[0-9]{2}:[0-9]{2})")
KEY = re.compile(r"Clave de rastreo ([^,]+)")


def movement(date: str, text: str, detail: str, amount: str) -> Claim | None:
    """One statement row; None if no shape reads it. A row of a known shape with an unreadable value is Unreadable."""
    own = next((w for p, w in INTERNAL.items() if text.startswith(p)), None)
    party = next(((field, m[1]) for shape, field in DESCRIPTORS if (m := shape.fullmatch(text))), None)
    spei = next((x for p, x in SPEI.items() if detail.startswith(p)), None)
    if not (text.endswith(" Compra") or own or party or text in PHRASES or spei):
        return None
    if amount[:1] not in ("+", "-"):
        raise Unreadable("statement")
    way = "OUTFLOW" if amount[0] == "-" else "INFLOW"
    claim = base(money(amount[1:]), "HIGH", way)
    if own not in (None, way) and not (text.endswith(" Compra") or party or text in PHRASES or spei):
        return None  # the mirror of a row of the account, whatever else it says
    claim |= {"occurred_at": (wall(date), "HIGH"), "financial_status": ("SETTLED", "MEDIUM")}
    if text.endswith(" Compra"):
        return claim | {"merchant": (text.removesuffix(" Compra"), "MEDIUM")}
    if own == way:
        return claim | {"counterparty": ("urn:ledger:self", "HIGH")}
    if party:
        return claim | {party[0]: (party[1], "MEDIUM")}
    if text in PHRASES:
        return claim
    marker, said = spei
    name, end, _ = detail.partition(marker)[2].partition(UNVERIFIED)
    if said != way or not end or not name.strip():
        raise Unreadable("statement")
    clock, key = CLOCK.search(detail), KEY.search(detail)
    claim |= {"counterparty": (name.strip(), "HIGH"), "occurred_at": (wall(date, clock and clock[1]), "HIGH")}
    return claim | ({"tracking_key": (key[1].strip(), "HIGH")} if key and key[1].strip() else {})


def claims_and_unread(rows: list[tuple[str, str, str, str]]) -> tuple[list[Claim], int]:
    read = [movement(*r) for r in rows]
    return [c for c in read if c is not None], sum(c is None for c in read)


def read_mail(raw: bytes) -> tuple[list[Claim] | None, int]:
    """Claims of one message, None where no template knows it."""
    try:
        subject, body = html.html_body(raw)
    except html.TooLarge:
        raise Unreadable("size") from None
    except ValueError:
        raise Unreadable("html") from None
    template = SUBJECTS.get(subject)
    if template is None:
        return None, 0
    try:
        return [TEMPLATES[template](html.text_of(body).split("\n"))], 0
    except html.TooLarge:
        raise Unreadable("size") from None
    except Unreadable as e:
        raise Unreadable("timestamp" if e.args[0] == "date" else e.args[0]) from None


PERIOD = re.compile(r"(\d{2}/\d{2}/\d{4}) al (\d{2}/\d{2}/\d{4})", re.ASCII)


def coordinates_of(read: Callable, xhtml: bytes):
    try:
        return read(xhtml)
    except (coordinates.Refused, expat.ExpatError, ValueError, AssertionError):
        raise Unreadable("coordinates") from None


def glyphs_of(pdf: bytes | None) -> dict[int, str] | None:
    """The table of a PDF's own encoding; None where it has none, or where there is no PDF."""
    try:
        return coordinates.glyph_table(pdf) if pdf is not None else None
    except ValueError:
        raise Unreadable("encoding") from None


def described(text: str) -> Claim:
    """Who a ledger line names: a card's whole description, or what follows CGO; nobody where there is neither."""
    if re.match(r"(\s*[0-9]){10}", text, re.ASCII):
        return {"merchant": (text, "MEDIUM")}
    rest = text.removeprefix("CGO").strip()
    return {"counterparty": (rest, "MEDIUM")} if text.startswith("CGO") and rest else {}


#: Days that a period may name: those of pandas' nanoseconds.
DAYS = date(1677, 9, 22), date(2262, 4, 11)


def day_of(text: str) -> date:
    d, m, y = map(int, text.split("/"))
    out = date(y, m, d)
    if not DAYS[0] <= out <= DAYS[1]:
        raise ValueError(f"{out} is too far")
    return out


def day_within(first: date, last: date, number: int) -> date | None:
    """The first day of that number from first to last. Every number up to 31 comes in one of three months that follow each other."""
    for month in range(first.month - 1, first.month + 2):
        try:
            at = date(first.year + month // 12, month % 12 + 1, number)
        except ValueError:
            continue
        if at >= first:
            return at if at <= last else None
    return None


def read_columns(xhtml: bytes, pdf: bytes | None = None) -> tuple[list[Claim] | None, int]:
    """A column statement: day numbers become dates inside its period; an annex entry that fits one row alone completes it."""
    placed = coordinates.decoded(coordinates_of(coordinates.words, xhtml), glyphs_of(pdf))
    lines: dict[tuple[int, float], list[str]] = {}
    for w in placed:
        lines.setdefault((w.page, w.y), []).append(w.text)
    found = next((m for x in lines.values() if (m := PERIOD.search(" ".join(x)))), None)
    if found is None:
        raise Unreadable("statement")
    try:
        period = [day_of(d) for d in found.groups()]
    except ValueError:
        raise Unreadable("date") from None
    claims: list[Claim] = []
    for row in coordinates.column_rows(placed):
        day = day_within(*period, int(row.first("day")))
        cargo, abono = row.first("cargo"), row.first("abono")
        if day is None or bool(cargo) == bool(abono):
            raise Unreadable("statement")
        claim = base(money(cargo or abono), "HIGH", "OUTFLOW" if cargo else "INFLOW")
        claim["occurred_at"] = (wall(f"{day.day}/{day.month}/{day.year}"), "HIGH")
        claims.append(claim | described(" ".join(" ".join(row.cells["description"]).split())))
    fits: dict[tuple, list[Claim]] = {}
    for c in claims:
        fits.setdefault((c["occurred_at"][0], c["amount_minor"][0], c["direction"][0]), []).append(c)
    for a in coordinates.annex_rows(placed):
        d, m, y = a["date"].split("/")
        hits = fits.get((wall(f"{int(d)}/{int(m)}/{y}"), money(a["amount"]), a["direction"]), [])
        if len(hits) == 1:
            if a["key"]:
                hits[0]["tracking_key"] = (a["key"], "HIGH")
            if a["clock"]:
                hits[0]["occurred_at"] = (wall(f"{int(d)}/{int(m)}/{y}", a["clock"]), "HIGH")
    return claims, 0


def read_blocks(xhtml: bytes, pdf: bytes | None = None) -> tuple[list[Claim], int]:
    """A block statement: its rows read by the shapes of movement, and the number of rows that no shape reads."""
    rows = coordinates.block_rows(coordinates_of(coordinates.parse, xhtml))
    return claims_and_unread([(r.said("date"), r.said("beside"), r.said("below"), r.said("amount")) for r in rows])


XHTML, PDF, MAGIC = "application/xhtml+xml", "application/pdf", b"%PDF-"
#: By extraction profile: the media types that it takes, and its reader. A PDF must begin with MAGIC.
REGISTRY: dict[str, tuple[tuple[str, ...], Callable]] = {
    "EMAIL_V1": (("message/rfc822",), read_mail), "STATEMENT_BLOCKS_V1": ((PDF, XHTML), read_blocks), "STATEMENT_COLUMNS_V1": ((PDF, XHTML), read_columns),
}


def read_whole(profile: str | None, media: str | None, raw: bytes | None, extract: Extractor | None = None) -> tuple[str, str | None, list[Claim], int]:
    """(status, problem, claims, rows that no shape reads), by profile, media type and first bytes; whatever goes wrong stays with this artifact."""
    types, reader = REGISTRY.get(profile or "", ((), None))
    kind = (media or "").split(";")[0].strip().lower()
    if raw is None or kind not in types or (kind == PDF and not bytes(raw).startswith(MAGIC)):
        return "FAILED", PHRASES_OF["dispatch"], [], 0
    try:
        if kind == PDF:
            claims, unread = reader((extract or by_program())(bytes(raw)), bytes(raw))
        else:
            claims, unread = reader(bytes(raw))
    except Unreadable as e:
        return "FAILED", e.phrase, [], 0
    except NotExtracted:
        return "FAILED", PHRASES_OF["extraction"], [], 0
    except Exception:  # noqa: BLE001  an artifact's failure must not end its batch, and its words must not be told
        return "FAILED", PHRASES_OF["other"], [], 0
    return ("READ" if claims else "UNRECOGNISED"), None, claims or [], unread


def read_one(profile: str | None, media: str | None, raw: bytes | None, extract: Extractor | None = None) -> tuple[str, str | None, list[Claim]]:
    return read_whole(profile, media, raw, extract)[:3]


def claims_array(rows: list[list[Claim]]) -> pa.Array:
    """The claims of each artifact as an Arrow array of SCHEMA's type, built by columns."""
    claims = [c for r in rows for c in r]
    ends = lambda of: pa.array(np.cumsum([0, *map(len, of)]), pa.int32())
    fields = [(name, *said) for c in claims for name, said in c.items()]
    names, values, confidences = ([f[i] for f in fields] for i in range(3))
    said = pa.StructArray.from_arrays([pa.array(values, pa.string()), pa.array(confidences, pa.string())], names=["value", "confidence"])
    return pa.ListArray.from_arrays(ends(rows), pa.MapArray.from_arrays(ends(claims), pa.array(names, pa.string()), said))


def interpret(evidence: DataFrame, extract: Extractor | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """evidence (id, extraction_profile, content_type, raw_content) to (id, status, problem, claims, unread_rows, carried columns).
    extract: turns a PDF into XHTML; Poppler's program if not given."""

    def run(batches):
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            rows = [read_whole(*r, extract) for r in zip(*[column[c].to_pylist() for c in ("extraction_profile", "content_type", "raw_content")])]
            told = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), claims_array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([*[column[c] for c in ("id", *carry)], *told], names=["id", *carry, "status", "problem", "claims", "unread_rows"])

    kept = evidence.select("id", *carry).schema
    asked = evidence.select("id", *dict.fromkeys((*carry, "extraction_profile", "content_type", "raw_content")))
    return small_batches(asked).mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept)}, {SCHEMA}")

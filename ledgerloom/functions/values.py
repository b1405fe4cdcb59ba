"""Typed value parsers and formats as Column functions. A value that does not parse is NULL; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CURRENCIES, RESERVED, SELF

#: Spanish month abbreviations, in order (fixed values).
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
ZONE = "America/Mexico_City"
DAY_ZONE = "-06:00"


def trim(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def money_minor(c: Column) -> Column:
    """`$1,234.56` to 123456: groups of three after the first, two decimals, no sign; NULL if refused or too large."""
    t = trim(F.regexp_replace(trim(c), r"\A\$", ""))
    return F.when(t.rlike(r"\A[0-9]{1,3}(,[0-9]{3})*\.[0-9]{2}\z"), F.regexp_replace(t, "[.,]", "").try_cast("bigint"))


def money_error(c: Column) -> Column:
    """Why money_minor refuses: no point or not two decimals comes first; NULL if it reads."""
    t = trim(F.regexp_replace(trim(c), r"\A\$", ""))
    shape = ~F.contains(t, F.lit(".")) | (F.length(F.substring_index(t, ".", -1)) != 2)
    return F.when(money_minor(c).isNotNull(), None).when(t.isNull() | (t == ""), "NOT_MONEY").when(shape, "UNSUPPORTED_FORMAT").otherwise("NOT_MONEY")


def signed_money(c: Column) -> Column:
    """struct(amount_minor, direction) of `+$1.00` or `-$1.00`; no sign or zero is refused."""
    t = trim(c)
    amount = money_minor(F.substr(t, F.lit(2)))
    way = F.when(t.startswith("-"), "OUTFLOW").when(t.startswith("+"), "INFLOW")
    return F.when(way.isNotNull() & (amount > 0), F.struct(amount.alias("amount_minor"), way.alias("direction")))


def two_column_money(cargo: Column, abono: Column) -> Column:
    """struct(amount_minor, direction) where exactly one of the two columns has an amount, not zero."""
    out, into = money_minor(cargo), money_minor(abono)
    one = F.when(trim(cargo).isNotNull() & (trim(cargo) != "") & (F.coalesce(trim(abono), F.lit("")) == ""), F.struct(out.alias("amount_minor"), F.lit("OUTFLOW").alias("direction")))
    two = F.when(trim(abono).isNotNull() & (trim(abono) != "") & (F.coalesce(trim(cargo), F.lit("")) == ""), F.struct(into.alias("amount_minor"), F.lit("INFLOW").alias("direction")))
    both = F.coalesce(one, two)
    return F.when(both["amount_minor"] > 0, both)


def decimal_text(minor: Column, currency: Column) -> Column:
    """`899.93 MXN`."""
    return F.concat((minor - F.pmod(minor, F.lit(100))).cast("bigint").__truediv__(100).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(minor, F.lit(100)).cast("string"), 2, "0"), F.lit(" "), currency)


def page_text(minor: Column, direction: Column) -> Column:
    """`-1,234.50`: thousands in commas, a minus for money that leaves."""
    whole = F.format_number((minor / 100).cast("decimal(20,2)"), 2)
    return F.concat(F.when(direction == "OUTFLOW", "-").otherwise(""), whole)


def currency_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Z]{3}\z") & c.isin(list(CURRENCIES)), F.lit(False))


def exponent(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in CURRENCIES.items() for x in (F.lit(k), F.lit(v))]), c)


def clock(c: Column) -> Column:
    """Seconds of day of `H:MM` or `HH:MM:SS`; NULL out of range."""
    m = r"\A([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\z"
    t = trim(c)
    h, mi, s = (F.regexp_extract(t, m, i).try_cast("int") for i in (1, 2, 3))
    s = F.coalesce(s, F.lit(0))
    return F.when(t.rlike(m) & (h < 24) & (mi < 60) & (s < 60), h * 3600 + mi * 60 + s)


def wall_date(c: Column) -> Column:
    """timestamp_ntz of `5/ENE/2026`, `5 ene 2026` or `5/1/2026`, with ` - HH:MM[:SS]` or not; dates that do not exist are NULL."""
    t = F.lower(collapse(c))
    m = r"\A([0-9]{1,2})(?:/([a-z]{3})/| ([a-z]{3}) |/([0-9]{1,2})/)([0-9]{4})(?: - ([0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?))?\z"
    name = F.concat(F.regexp_extract(t, m, 2), F.regexp_extract(t, m, 3))
    by_name = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    month = F.coalesce(F.regexp_extract(t, m, 4).try_cast("int"), F.when(by_name > 0, by_name))
    time = F.regexp_extract(t, m, 6)
    sec = F.when(time == "", 0).otherwise(clock(time))
    made = F.try_make_timestamp(F.regexp_extract(t, m, 5).try_cast("int"), month, F.regexp_extract(t, m, 1).try_cast("int"), sec.__truediv__(3600).cast("int"), F.pmod(sec, F.lit(3600)).__truediv__(60).cast("int"), F.pmod(sec, F.lit(60)))
    return F.when(t.rlike(m) & sec.isNotNull(), made)


def has_time(c: Column) -> Column:
    return F.coalesce(c.rlike(r" - [0-9]{1,2}:[0-9]{2}"), F.lit(False)) & wall_date(c).isNotNull()


def in_zone(wall: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(wall, zone)


def day_in_zone(ts: Column, zone: str = DAY_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def date_on(start: Column, end: Column, day: Column) -> Column:
    """The first date from start to end with that day of month."""
    return F.get(F.filter(F.sequence(start, end), lambda d: F.day(d) == day), F.lit(0))


def period(c: Column) -> Column:
    """struct(start, end) of `dd/mm/yyyy al dd/mm/yyyy`."""
    m = r"([0-9]{2})/([0-9]{2})/([0-9]{4}) al ([0-9]{2})/([0-9]{2})/([0-9]{4})"
    g = [F.regexp_extract(c, m, i).try_cast("int") for i in range(1, 7)]
    day = lambda d, mo, y: F.try_make_timestamp(y, mo, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.when(c.rlike(m), F.struct(day(*g[:3]).alias("start"), day(*g[3:]).alias("end")))


def party(merchant: Column, counterparty: Column) -> Column:
    """What composite keys compare: merchant, or counterparty where that is blank, trimmed and in lower case; NULL if neither."""
    fill = lambda c: F.when(trim(c) != "", trim(c))
    return F.lower(F.coalesce(fill(merchant), fill(counterparty)))


def internal(counterparty: Column) -> Column:
    return F.coalesce(counterparty == SELF, F.lit(False))


def counterparty_ok(c: Column) -> Column:
    """Inside the reserved namespace only `self` is allowed."""
    return F.coalesce(~c.startswith(RESERVED) | (c == SELF), F.lit(True))


def backoff_minutes(attempt: Column) -> Column:
    """1, 2, 4, ... minutes, a day at most."""
    n = F.least(F.greatest(attempt, F.lit(1)), F.lit(12))
    return F.least(F.pow(F.lit(2), n - 1).cast("bigint"), F.lit(1440))


def reason(kind: Column, detail: Column) -> Column:
    """`CLASS` or `CLASS: detail`, control signs dropped, white space collapsed, 200 bytes at most (ASCII details)."""
    clean = F.regexp_replace(F.regexp_replace(detail, r"[\x00-\x08\x0e-\x1f\x7f]", ""), r"\s+", " ")
    whole = F.when(F.coalesce(clean, F.lit("")) == "", kind).otherwise(F.concat(kind, F.lit(": "), clean))
    return F.when(F.octet_length(whole) > 200, F.concat(F.substr(whole, F.lit(1), F.lit(197)), F.lit("…"))).otherwise(whole)


def media_type(c: Column) -> Column:
    return F.lower(trim(F.substring_index(c, ";", 1)))


def starts_with(raw: Column, magic: bytes = b"%PDF-") -> Column:
    """Whether an artifact's bytes begin with the sign of their format; absent bytes do not."""
    return F.coalesce(F.substring(raw, 1, len(magic)) == F.lit(bytearray(magic)), F.lit(False))


def tracking_key(c: Column) -> Column:
    """The text after `Clave de rastreo ` up to a comma; `HSB` before a digit is completed to `HSBC`."""
    k = F.regexp_extract(c, r"Clave de rastreo ([^,]+)", 1)
    return F.when(k != "", F.regexp_replace(trim(k), r"\AHSB(?=[0-9])", "HSBC"))


def is_card(c: Column) -> Column:
    """Ten digits or more before any other sign but space."""
    return F.coalesce(c.rlike(r"\A(\s*[0-9]){10}"), F.lit(False))


def labelled(lines: Column, label: str) -> Column:
    """The rest of the first line that holds the label, else the next line; NULL if blank."""
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(label))), True).cast("int")
    rest = trim(F.substring_index(F.get(lines, at - 1), label, -1))
    after = trim(F.get(lines, at))
    return F.when(at > 0, F.coalesce(F.when(rest != "", rest), F.when(after != "", after)))


def between(line: Column, a: str, b: str) -> Column:
    tail = F.substr(line, F.locate(a, line) + len(a))
    return F.when(F.contains(line, F.lit(a)) & F.contains(tail, F.lit(b)), trim(F.substring_index(tail, b, 1)))


def cursor(ts: Column, key: Column) -> Column:
    """An opaque page token: base64url of {"t":..., "id":...} without padding."""
    raw = F.base64(F.encode(F.to_json(F.struct(rfc3339(ts).alias("t"), key.alias("id"))), "UTF-8"))
    return F.regexp_replace(F.translate(raw, "+/", "-_"), "=", "")


def cursor_fields(token: Column) -> Column:
    raw = F.unbase64(F.translate(token, "-_", "+/"))
    return F.from_json(F.decode(raw, "UTF-8"), "t string, id string")

"""HTML to text in one pass over the markup, and MIME bodies; pure functions and their Arrow UDFs."""

from __future__ import annotations

import base64
import binascii
import email
import email.header
import quopri
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HTML_BYTES = 4 << 20


class TooLarge(ValueError):
    """The markup is over HTML_BYTES."""
MIME_DEPTH = 4
# Elements whose content is dropped, elements that end a line, named entities.
SILENT = ("script", "style", "head", "title", "noscript")
BLOCKS = {"p", "div", "br", "tr", "td", "th", "table", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "hr", "body", "html", "tbody", "thead"}
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "zwnj": ""}

MARKS = ("!", "?")  # behind < : comments and declarations
TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
ENTITY = re.compile(r"&([A-Za-z]+|#[0-9]{1,7});")


def _entity(m: re.Match) -> str:
    name = m[1]
    if name[0] == "#":
        return {"#160": " ", "#39": "'", "#8204": ""}.get(name, m[0])
    return ENTITIES.get(name.lower(), m[0])


def text_of(html: str | None) -> str | None:
    """Visible text, a line per block. Comments, declarations and silent elements go; one that never ends takes the rest."""
    if html is None:
        return None
    if len(html.encode("utf-8", "surrogatepass")) > HTML_BYTES:
        raise TooLarge("HTML over the size limit")
    out: list[str] = []
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            out.append(html[at:].replace("\r", " ").replace("\n", " "))
            break
        out.append(html[at:lt].replace("\r", " ").replace("\n", " "))
        if html[lt + 1 : lt + 2] in MARKS:
            inner, tail = (lt + 4, "-->") if html.startswith("<!--", lt) else (lt, ">")
            end = html.find(tail, inner)
            at = n if end < 0 else end + len(tail)
        elif m := TAG.match(html, lt):
            name = m[2].lower()
            at = m.end()
            if name in SILENT:
                out.append("\n")
                if not m[1]:
                    end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                    at = n if end is None else end.end()
            elif name in BLOCKS:
                out.append("\n")
        else:
            out.append("<")
            at = lt + 1
    raw = ENTITY.sub(_entity, "".join(out)).replace(" ", " ").replace("‌", "")
    lines = (" ".join(x.split()) for x in raw.split("\n"))
    return "\n".join(x for x in lines if x)


def header_text(value: str | None) -> str | None:
    """An RFC 2047 header decoded, or as it is."""
    if value is None:
        return None
    try:
        return str(email.header.make_header(email.header.decode_header(value)))
    except (LookupError, UnicodeError, ValueError):
        return value


def transfer_decoded(body: bytes, encoding: str) -> bytes:
    kind = (encoding or "").strip().lower()
    if kind == "base64":
        try:
            return base64.b64decode(re.sub(rb"\s", b"", body), validate=True)
        except binascii.Error as e:
            raise ValueError("bad base64") from e
    if kind == "quoted-printable":
        return quopri.decodestring(body)
    if kind in ("", "7bit", "8bit", "binary"):
        return body
    raise ValueError(f"transfer encoding {kind}")


def html_body(raw: bytes) -> tuple[str, str]:
    """(subject, html) of the first text/html part, depth first, MIME_DEPTH levels at most."""
    message = email.message_from_bytes(raw)

    def first(part, depth: int):
        if depth > MIME_DEPTH:
            return None
        if part.is_multipart():
            return next((x for p in part.get_payload() if (x := first(p, depth + 1)) is not None), None)
        if part.get_content_type() != "text/html":
            return None
        coding = part.get("Content-Transfer-Encoding", "").strip().lower()
        # Encoded bodies are ASCII and decoded strictly here; plain ones are taken as the bytes that they are.
        body = transfer_decoded(part.get_payload().encode("ascii", "replace"), coding) if coding in ("base64", "quoted-printable") else transfer_decoded(part.get_payload(decode=True), coding)
        charset = (part.get_content_charset() or "utf-8").lower()
        return body.decode("latin-1" if charset in ("iso-8859-1", "latin-1", "latin1") else "utf-8", "replace")

    html = first(message, 1)
    if html is None:
        raise ValueError("no text/html part")
    return header_text(message.get("Subject", "")).strip(), html


def _texts(s: pd.Series) -> pd.Series:
    def safe(x):
        try:
            return text_of(x)
        except ValueError:
            return None

    return s.map(safe)


def html_text(col: str) -> Column:
    """text_of over a column, in Arrow batches; NULL where the input is too large."""
    return F.pandas_udf(_texts, "string")(F.col(col))


def _mails(s: pd.Series) -> pd.DataFrame:
    def safe(raw):
        try:
            return html_body(bytes(raw)) if raw is not None else (None, None)
        except ValueError:
            return None, None

    return pd.DataFrame([safe(x) for x in s], columns=["subject", "html"])


def mail_html(col: str) -> Column:
    """struct(subject, html) of html_body over a binary column, in Arrow batches; both NULL where a message has no readable HTML."""
    return F.pandas_udf(_mails, "subject string, html string")(F.col(col))

"""Invented statements as positioned words."""


def document(*pages):
    """Pages of (x, y, bottom, text) blocks."""
    out = []
    for blocks in pages:
        body = "".join(
            f'<block xMin="{x}" yMin="{y}" xMax="0" yMax="{b}"><line xMin="{x}" yMin="{y}">' + "".join(f'<word xMin="{x + 30 * i}" yMin="{y}">{w}</word>' for i, w in enumerate(t.split())) + "</line></block>"
            for x, y, b, t in blocks
        )
        out.append(f"<page><flow>{body}</flow></page>")
    return ("<!DOCTYPE html><html xmlns='http://www.w3.org/1999/xhtml'><body><doc>" + "".join(out) + "</doc></body></html>").encode()


def statement(*rows):
    """A block statement of rows (date, text, amount, detail ...)."""
    out = []
    for i, (date, text, amount, *detail) in enumerate(rows):
        y = 100 + 60 * i
        out += [(60, y, y + 10, date), (500, y, y + 10, amount), (140, y, y + 10, text), *[(135.84, y + 12 + 5 * k, y + 20, d) for k, d in enumerate(detail)]]
    return document(out)

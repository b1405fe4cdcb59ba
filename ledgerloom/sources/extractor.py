"""PDF to positioned words: an outside program that reads a PDF on its input and writes XHTML, held to bounds.

It runs on the executors, inside the pass that interprets artifacts: one process for an artifact, without a shell, with
an empty environment, SECONDS at most and OUTPUT_BYTES of output at most; what it writes to its error output is dropped.
A missing program, a bad end, a timeout or too much output fails that artifact alone.
"""

from __future__ import annotations

import subprocess
import threading
from collections.abc import Callable

#: A fixed value: Poppler's extractor of words with their boxes, from input to output.
POPPLER = ("pdftotext", "-bbox-layout", "-", "-")
SECONDS, OUTPUT_BYTES = 10.0, 16 << 20

Extractor = Callable[[bytes], bytes]


class NotExtracted(ValueError):
    """The program is missing, failed, took too long or wrote too much."""


def by_program(command: tuple[str, ...] = POPPLER, seconds: float = SECONDS, most: int = OUTPUT_BYTES) -> Extractor:
    """A function of a PDF's bytes that gives the XHTML the program writes."""

    def extract(pdf: bytes) -> bytes:
        try:
            run = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env={})
        except OSError as e:
            raise NotExtracted(type(e).__name__) from None
        late = threading.Timer(seconds, run.kill)
        feed = threading.Thread(target=_give, args=(run.stdin, pdf), daemon=True)
        try:
            late.start()
            feed.start()
            out = run.stdout.read(most + 1)
            if len(out) > most:
                raise NotExtracted("output over the bound")
            if run.wait() != 0:
                raise NotExtracted("the program failed or was stopped")
            return out
        finally:
            late.cancel()
            run.kill()
            run.stdout.close()
            run.wait()

    return extract


def _give(pipe, raw: bytes) -> None:
    try:
        with pipe:
            pipe.write(raw)
    except OSError:  # the program ended before it had read everything; its exit tells
        pass

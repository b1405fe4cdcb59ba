"""Fill-in-the-middle: whole texts cut into lines and reordered, so that a model learns to write what stands between.

The cut points come from the tokenizers library's Split pre-tokenizer: its isolated matches of UNIT are a text's units, the
length of the list of offsets is n, and the offsets at two ranks drawn from a hash of the document's id are code-point
bounds of prefix, middle and suffix. Nothing is trained. The work is one pass without a shuffle, so neither hot sources
nor copies matter; form and output are columns, and `restored` rebuilds the text from these two alone.

Defined cases. Null and empty texts: no units, form plain, output empty. A text that holds a mark itself: plain. A null id
draws as empty text. Very long texts: cut whole (offsets in memory of one text at a time). Repeated rows and ties: each
row by itself, equal rows alike. Empty tables: no rows. Columns beside the text are handed on, except ones that have the
name of a new column, which are replaced; the text itself is in the output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_or_empty

# Units, marks and forms.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7:"
#: Of 100 documents, how many are transformed, and how many of those put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
CHUNK_CHARS = 1 << 20


def draws(id_: Column, seed: str = SEED) -> list[Column]:
    """The first four groups of 8 hexadecimal digits of sha256(seed, id) as numbers."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def bounds(text: str, unit, h1: int, h2: int) -> tuple[int, int, int]:
    """(n, end of prefix, end of middle): the number of units, and code points at the two ranks drawn."""
    offsets = [o for _, o in unit.pre_tokenize_str(text)]
    n = len(offsets)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, offsets[lo - 1][1] if lo else 0, offsets[hi - 1][1] if hi else 0


def transform(df: DataFrame, id_col: str = "doc_id", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """df with n, form (plain, psm, spm), prefix_chars, middle_chars and output, the reordered text."""
    made = {"text", "n", "form", "prefix_chars", "middle_chars", "output"}
    rest = [c for c in df.columns if c.lower() not in made]
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    text = text_or_empty()
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= text.contains(mark)
    plain = (text == "") | marked | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    asked = df.select(F.struct(*rest).alias("row"), text.alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers

        unit = pre_tokenizers.Split(Regex(UNIT), "isolated")
        for batch in batches:
            texts, forms, firsts, seconds = (batch.column(k).to_pylist() for k in range(1, 5))
            for a, b in chunks(list(map(len, texts)), CHUNK_CHARS):
                rows = []
                for t, f, x, y in zip(texts[a:b], forms[a:b], firsts[a:b], seconds[a:b]):
                    n, i, j = bounds(t, unit, x, y)
                    if f == "psm":
                        rows.append((n, i, j - i, f"{PREFIX}{t[:i]}{SUFFIX}{t[j:]}{MIDDLE}{t[i:j]}"))
                    elif f == "spm":
                        rows.append((n, i, j - i, f"{SUFFIX}{t[j:]}{PREFIX}{t[:i]}{MIDDLE}{t[i:j]}"))
                    else:
                        rows.append((n, None, None, t))
                n, i, m, out = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(i, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.string())],
                    names=["row", "form", "n", "prefix_chars", "middle_chars", "output"],
                )

    schema = f"row {asked.schema['row'].dataType.simpleString()}, form string, n long, prefix_chars long, middle_chars long, output string"
    return asked.mapInArrow(run, schema).select("row.*", "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Only texts without marks are reordered, so the first of each mark parts."""

    def parted(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parted(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parted(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)

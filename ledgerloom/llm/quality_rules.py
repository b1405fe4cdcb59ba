"""Quality rules: one threshold table compiled into one Spark projection, without user functions.

Null texts count as empty, an empty text has no words and fails the base rule. Repeated rows are judged
one by one; other columns are carried unless they clash with a result's name, which then wins. Very long texts are
counted whole; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux de des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "auf das dem den der die ein eine für ist mit nicht sich und von zu "
    "con del el es las lo los no por su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes while low <= metric <= high; texts of fewer than from_words words are not judged by it."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The table. Metrics are the keys of metrics().
RULES = (
    Rule("mean_word_length", "mean_word_length", 1.5, 25.0, 20),
    Rule("symbol_ratio", "symbols_per_word", None, 0.5),
    Rule("stop_words", "stop_word_share", 0.005, None, 100),
    Rule("duplicate_lines", "dup_line_share", None, 0.5),
    Rule("words_per_line", "words_per_line", 1.2, None, 50),
)


def repeated_window_words(ws: Column, size: int = 5) -> Column:
    """Words inside windows of `size` words that occur twice or more.

    Windows are sorted as (hash, place), so equal ones meet; the covered words follow from the gaps between places.
    Texts whose windows all differ, nearly all of them, stop after one hash-set pass.
    """
    n = F.size(ws)
    at = F.sequence(F.lit(0), n - size)
    window = F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(size)]))

    def held(value: Column, use) -> Column:
        """use(value), with value computed once: what a lambda's body only names is computed anew for each element."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(order: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(order, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(order, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        return F.aggregate(
            held(pairs, twice),
            F.struct(F.lit(-size).alias("last"), F.lit(0).alias("sum")),
            lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(size), p - acc["last"])).alias("sum")),
            lambda acc: acc["sum"],
        )

    out = held(window, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.when(n > size, out).otherwise(0).cast("long")


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the plain counts of each text; split once, used by every count."""
    t = text_or_empty(text)
    held = df.withColumns({"__t": t, "__w": words(t), "__lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)})
    stop = "(?<![^ \\x09-\\x0D])(?:" + "|".join(STOP_WORDS) + ")(?![^ \\x09-\\x0D])"
    return held.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.translate("__t", BLANKS, "")).cast("long"),
        "n_symbols": (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("__w")),
        "n_stop_words": F.regexp_count(F.lower("__t"), F.lit(stop)).cast("long"),
    }).drop("__t", "__w", "__lines")


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row breaks, as one array expression over the columns of metrics()."""
    value = {
        "mean_word_length": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "stop_word_share": ratio("n_stop_words", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "n_lines"),
        "words_per_line": ratio("n_words", "n_lines"),
    }

    def broken(r: Rule) -> Column:
        v = value[r.metric]
        out = F.lit(False)
        if r.low is not None:
            out = out | (v < r.low)
        if r.high is not None:
            out = out | (v > r.high)
        return F.when((F.col("n_words") >= r.from_words) & out, F.lit(r.name))

    return F.array_compact(F.array(*[broken(r) for r in rules]))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with its counts, base_failed, failed_rules and kept."""
    m = metrics(df, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return m.withColumns({"base_failed": base, "failed_rules": compiled(rules)}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )

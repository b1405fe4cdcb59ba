"""Row assembly from coordinates: one-to-one, nearest, as-of and band joins, and anchored bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pair_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], names: tuple[str, str]) -> DataFrame:
    """Within equal keys the first left row takes the first right row, the second the second, and so on."""
    at = Window.partitionBy(*keys).orderBy(*order)
    side = lambda df, n: df.withColumn("__r", F.row_number().over(at)).select(*keys, "__r", *[F.col(c).alias(f"{n}_{c}") for c in order])
    return side(left, names[0]).join(side(right, names[1]), [*keys, "__r"]).drop("__r")


def _cell(y: str, tolerance: float) -> Column:
    """Cells as wide as the tolerance: what is within it of a point is in the point's cell or one beside it."""
    return F.floor(F.col(y) / F.lit(tolerance)) if tolerance else F.col(y)


def _around(points: DataFrame, tolerance: float) -> DataFrame:
    """points once for each cell in reach."""
    cell = _cell("y", tolerance)
    return points.withColumn("__cell", F.explode(F.array(cell - 1, cell, cell + 1) if tolerance else F.array(cell)))


def nearest_within(points: DataFrame, rows: DataFrame, tolerance: float) -> DataFrame:
    """Each point (page, y, ...) with the row (page, row_y, ...) nearest in y, within the tolerance; the later row wins ties.

    An equi-join on cells of the tolerance's width, not a range join, for whole and other numbers; the best by a combinable
    aggregate. Points that are equal in all columns count once.
    """
    near = _around(points, tolerance).join(rows.withColumn("__cell", _cell("row_y", tolerance)), ["page", "__cell"]).where(F.abs(F.col("row_y") - F.col("y")) <= tolerance)
    rest = [c for c in rows.columns if c not in ("page", "row_y")]
    best = near.groupBy(*points.columns).agg(F.min_by(F.struct("row_y", *rest), F.struct(F.abs(F.col("row_y") - F.col("y")), -F.col("row_y"))).alias("best"))
    return best.select(*points.columns, "best.*")


def near_any(points: DataFrame, rows: DataFrame, tolerance: float) -> DataFrame:
    """Points with any row of their page within the tolerance in y."""
    places = rows.select("page", F.col("y").alias("row_y"), _cell("y", tolerance).alias("__cell")).distinct()
    cell = _cell("y", tolerance)
    near = None
    for shift in (-1, 0, 1) if tolerance else (0,):
        side = places.select("page", "row_y", (F.col("__cell") - shift).alias("__cell"))
        near = side if near is None else near.unionByName(side)
    at = points.withColumn("__cell", cell).alias("p")
    return at.join(near.alias("r"), (F.col("p.page") == F.col("r.page")) & (F.col("p.__cell") == F.col("r.__cell")) & (F.abs(F.col("r.row_y") - F.col("p.y")) <= tolerance), "left_semi").drop("__cell")


def last_above(df: DataFrame, keys: list[str], order: str, is_row: Column, out: str = "above") -> DataFrame:
    """The order value of the last qualifying row strictly before each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.last(F.when(is_row, F.col(order)), ignorenulls=True).over(w))


def fill_forward(df: DataFrame, keys: list[str], order: str, value: Column, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def enrich_unique(ledger: DataFrame, annex: DataFrame, keys: list[str], row: str, value: str) -> DataFrame:
    """Ledger rows that are alone under their keys, with the last annex value under the same keys."""
    alone = ledger.groupBy(*keys).agg(F.count("*").alias("n"), F.min(row).alias(row)).where("n = 1").drop("n")
    last = annex.groupBy(*keys).agg(F.max(value).alias(value))
    return alone.join(last, keys)


def bands(words: DataFrame, tolerance: float) -> DataFrame:
    """words (page, y, ...) with `band`: rows belong together while y is within the tolerance of the band's first y.

    The anchor depends on all rows before it, so pages are read in order; distinct y values are few, and only they go
    through the sequential part.
    """

    def anchored(key, pdf):
        ys = sorted(pdf["y"].tolist())
        out, anchor = [], None
        for y in ys:
            if anchor is None or y - anchor > tolerance:
                anchor = y
            out.append(anchor)
        return pdf.sort_values("y").assign(band=out)

    places = words.select("page", "y").distinct()
    kinds = dict(words.dtypes)
    marked = places.groupBy("page").applyInPandas(anchored, f"page {kinds['page']}, y {kinds['y']}, band {kinds['y']}")
    return words.join(marked, ["page", "y"])

"""The source list: a JSON document {"sources": [...]}, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SOURCE_TYPES, SOURCES_CONFIG

PROFILES = ("EMAIL_V1", "STATEMENT_BLOCKS_V1", "STATEMENT_COLUMNS_V1")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, query, extraction_profile) of each configured source."""
    return spark.read.schema(SOURCES_CONFIG).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("sources").alias("s")).select("s.*")


def problems(rows: DataFrame) -> DataFrame:
    """(id, problem): empty or repeated ids, unknown types and profiles, mail sources without a query."""
    one = F.array_compact(F.array(
        F.when(F.coalesce("id", F.lit("")) == "", "EMPTY_ID"),
        F.when(~F.coalesce("type", F.lit("")).isin(list(SOURCE_TYPES)), "UNKNOWN_TYPE"),
        F.when(F.col("extraction_profile").isNotNull() & ~F.col("extraction_profile").isin(list(PROFILES)), "UNKNOWN_PROFILE"),
        F.when((F.col("type") == "GMAIL") & (F.coalesce("query", F.lit("")) == ""), "NO_QUERY"),
    ))
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("DUPLICATE_ID").alias("problem"))
    return rows.select("id", F.explode(one).alias("problem")).unionByName(twice)

"""What the operators of this folder share: shared scratch space, table reading, small expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: space and U+0009 to U+000D.
WORD_GAP = r"[ \x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only where it is unset and the master is local (tests)
    one of our own; on a cluster a folder of one machine would lose rows, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows and bytes that a Python worker gets at once: texts are long, and workers share an executor's memory.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def in_batches(df: DataFrame, run, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """df.mapInArrow(run, schema) with small batches; the session keeps the setting."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def fold(col: str, mod: int) -> Column:
    """crc32 of an id's decimal text, modulo mod."""
    return F.crc32(F.col(col).cast("string")) % mod


def chunks(weights: list[int], most: int):
    """(start, end) of runs whose weights add up to `most` or that hold one item."""
    start = held = 0
    for i, x in enumerate(weights):
        if i > start and held + x > most:
            yield start, i
            start, held = i, 0
        held += x
    if start < len(weights):
        yield start, len(weights)

"""Direct uploads: one JSON object a row, strictly decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import UPLOAD

BODY_BYTES, ARTIFACT_BYTES = 14 << 20, 10 << 20
UPLOAD_TYPES = ("MANUAL", "BANK_STATEMENT")
FIELDS = tuple(f.split()[0] for f in UPLOAD.split(", "))


def decoded(df: DataFrame, body: str) -> DataFrame:
    """df (with source_type) plus the upload's fields, raw bytes and `problem` (NULL for an upload that is accepted)."""
    raw = F.col("__u.raw_content")
    content = F.try_to_binary(raw, F.lit("base64"))
    at = F.try_to_timestamp(F.col("__u.observed_at"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"))
    keys = F.json_object_keys(body)
    problem = (
        F.when(F.octet_length(body) > BODY_BYTES, "TOO_LARGE")
        .when(keys.isNull() | F.col("__u").isNull(), "NOT_AN_OBJECT")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, "UNKNOWN_FIELD")
        .when(~F.coalesce("source_type", F.lit("")).isin(list(UPLOAD_TYPES)), "SOURCE_TYPE")
        .when(F.coalesce(F.col("__u.source_artifact_key"), F.lit("")) == "", "NO_KEY")
        .when(at.isNull(), "OBSERVED_AT")
        .when(content.isNull(), "NOT_BASE64")
        .when(F.octet_length(content) > ARTIFACT_BYTES, "TOO_LARGE")
    )
    held = df.withColumn("__u", F.from_json(body, UPLOAD))
    return held.withColumns({"source_reference": F.col("__u.source_artifact_key"), "observed_at": at, "content_type": F.col("__u.content_type"), "content": content, "problem": problem}).drop("__u")

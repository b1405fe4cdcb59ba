"""The corpus pipeline: language ID, MinHash near-dedup, suffix-array dedup, PII, best-fit packing.

Every stage works on all rows that the stage before kept. All but the last return the columns of documents.

Null and empty texts go in the first stage, as they hold no letter; null doc_ids, lang or source stay as they are. Very long
texts are read whole by every stage. Of near duplicates the least doc_id stays; rows that repeat a doc_id and its text count
once. An empty table gives no rows. Columns beside those of documents, clashing names among them, are not handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import language_id, minhash, packing, pii, suffix_dedup
from ledgerloom.llm.common import stored
from ledgerloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: The language stage keeps a text whose likeliest language has this mean probability over the text's bytes, or more. With four
#: languages, chance is 0.25; a text that no learnt language fits, or that several share, stays below.
LEAST_SCORE = 0.4


def with_text(docs: DataFrame, text) -> DataFrame:
    """The documents' columns with a new text and its length."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learnt language is recognised, with LEAST_SCORE or more, stay; those without a letter (`und`) go. With
    no labels to learn from, every document with a letter stays."""
    net = language_id.fit(docs)
    if not net.labels:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    return language_id.predict(docs.select(*COLUMNS), net).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near duplicates stays; rows that repeat a doc_id and its text count once."""
    groups = minhash.near(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    whole = docs.select(*COLUMNS)
    kept = whole.join(groups, whole["doc_id"].eqNullSafe(groups["__id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings, and passages of over 50 words that another document has, are cut out; a document of which
    nothing but white space is left goes."""
    left = suffix_dedup.cut(docs, carry=("lang", "source"), as_text=True, passages=True)
    return with_text(left, F.col("kept")).where(F.col("text").rlike(r"[^ \x09-\x0D]"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.redact(docs.select(*COLUMNS))
    return with_text(out, F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.place(docs, vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: A trained network and tokenisation are beyond SQL: tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs

"""The queries of this folder, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe_duckdb, embedding_dedup, fill_middle, language_id, minhash, multiset_hash, packing, pii, quality_pu, quality_rules, suffix_dedup, wavelet, whitening
from .common import fold, table
from .oracles import ORACLES


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark, sf_dir):
    return minhash.near(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near(table(spark, sf_dir, "embeddings"))


def op3_quality_pu(spark, sf_dir):
    docs = quality_pu.measured(table(spark, sf_dir, "documents"))
    seen = F.coalesce(fold("doc_id", 5) != 0, F.lit(False))
    out = quality_pu.scored(docs, quality_pu.learnt(docs.where(seen), table(spark, sf_dir, "labels").where(seen)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_shards(spark, sf_dir):
    shards = wavelet.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return wavelet.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)


def op7_suffix_dedup(spark, sf_dir):
    removed = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["hi"] - s["lo"]).cast("long")
    out = suffix_dedup.cut(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("passages") > 0).alias("shares_passage")
    )


def op8_packing(spark, sf_dir):
    return packing.digest(packing.place(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = language_id.fit(docs.where(fold("doc_id", 4) != 2))
    out = language_id.predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe_duckdb.encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_multiset_hash(spark, sf_dir):
    out = multiset_hash.with_next(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_whitening(spark, sf_dir):
    out = whitening.components_of(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_fill_middle(spark, sf_dir):
    out = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {f.__name__: f for f in (op1_minhash, op2_embedding_dedup, op3_quality_pu, op4_token_shards, op5_pii, op6_quality_rules, op7_suffix_dedup, op8_packing, op9_language_id, op10_byte_bpe, op11_multiset_hash, op12_whitening, op13_fill_middle)}

__all__ = ["ORACLES", "QUERIES", "vocabulary"]

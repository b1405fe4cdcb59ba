"""The pipeline's stages keep what they should and hand on the columns of documents."""

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    prose = lambda k: " ".join(f"word{(i * k) % 97} the" for i in range(60)) + "."
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [(i, prose(i + 3), "en", f"s{i}") for i in range(12)]
    rows += [(20, rows[0][1], "en", "copy"), (21, rows[0][1], "en", "copy"), (30, "12345 !!!", "de", "x"), (31, None, None, None), (32, rows[1][1] + " mail me: a@b.example.com", "en", "x")]
    rows += [(40, passage + " first " + prose(77), "fr", "p"), (41, prose(78) + " second " + passage, "fr", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = df, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
    ids = lambda name: sorted(r["doc_id"] for r in seen[name])
    assert set(range(12)) <= set(ids("language_id")) and not {30, 31} & set(ids("language_id"))
    assert not {20, 21} & set(ids("minhash")) and set(range(1, 12)) - {1} <= set(ids("minhash"))
    left = {r["doc_id"]: r["text"] for r in seen["suffix_dedup"]}
    assert passage not in left[40] and passage not in left[41] and "first" in left[40] and "second" in left[41]
    assert not any("a@b.example.com" in r["text"] for r in seen["pii"])
    assert sum(r["length"] for r in seen["packing"]) > 0
    assert len(pipeline.run(spark, str(tmp_path)).collect()) == len(seen["packing"])


def test_language_stage_without_labels(spark):
    """A corpus whose lang is null throughout is kept, but for texts without a letter."""
    rows = [(1, "some words here"), (2, "12345 !!!"), (3, None), (4, "слово")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "cast(null as string) lang", "'s' source", "cast(length(text) as long) n_chars")
    kept = pipeline.keep_known_languages(spark, df, "")
    assert kept.columns == pipeline.COLUMNS and sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_stages_on_edges(spark, tmp_path):
    """No rows; then nulls in every column, a very long text, repeated rows and columns that clash with what stages add."""
    names = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, kept string, spans string, sequence_id long"
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    full = [(1, long, "en", "s", 5, "x", "y", "z", 1), (1, long, "en", "s", 5, "x", "y", "z", 1), (None, "some other words here", None, None, None, None, None, None, None), (3, None, "en", "s", 0, "x", "y", "z", 1), (4, "", None, "s", 0, "x", "y", "z", 1)]
    for rows, left in (([], 0), (full, 2)):
        docs = spark.createDataFrame(rows, names)
        for name, stage in pipeline.STAGES:
            docs = pipeline.stored(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert docs.columns == pipeline.COLUMNS and docs.count() == left + (left > 0 and name == "language_id")  # the repeated row goes in minhash
        assert docs.select("doc_id").distinct().count() == left


def test_language_stage_drops_what_no_language_fits(spark):
    """Four languages of letters of their own: a text that is a quarter of each is none of them, though it has letters."""
    import random

    rng = random.Random(8)
    alphabets = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx"}
    words = lambda lang, n: " ".join("".join(rng.choices(alphabets[lang], k=5)) for _ in range(n))
    rows = [(i, words(lang, 40), lang) for i, lang in enumerate(sorted(alphabets) * 30)]
    rows += [(1000, " ".join(words(lang, 64) for lang in alphabets), None), (1001, words("bb", 12), None), (1002, "1234 !!", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' source", "cast(length(text) as long) n_chars")
    kept = {r["doc_id"] for r in pipeline.keep_known_languages(spark, docs, "").collect()}
    assert kept == set(range(120)) | {1001}

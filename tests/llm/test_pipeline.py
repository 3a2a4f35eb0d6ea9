"""The pipeline's stages on awkward documents."""

from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_keeps_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("block", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        assert after.join(docs, "doc_id", "left_anti").count() == 0


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    ids = [r.doc_id for r in found.collect()]
    assert ids and len(ids) == len(set(ids))
    assert found.where("n_tokens <> size(ids)").count() == 0


CLASHES = ["block", "raw", "payload", "rest", "ids", "met", "twice", "owned", "th", "_th", "_first", "first", "node", "component", "n", "bands", "key", "score", "lang_pred", "n_words", "n_removed", "n_hit", "kept_text", "spans", "item_id", "bucket", "held_out"]


def _awkward(spark):
    """Nulls, blanks, repeated rows, one id with two texts, a long text, and columns that operators use names of."""
    words = " ".join(f"w{k}x" for k in range(40_000))
    plain = "the ship came into the harbour and the crew went ashore to buy bread and fish for the long way home " * 2
    rows = [(1, plain, "en"), (1, plain, "en"), (2, plain, None), (3, None, "en"), (4, "", "de"), (5, " \n\t ", None), (6, words, "en"), (None, plain + "again", "en"), (None, None, None), (7, "12 345", "en"), (8, "one text of this id", "en"), (8, "quite another text, of the same id", "en")]
    docs = spark.createDataFrame([r for r in rows], "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def test_awkward_rows(spark):
    docs = _awkward(spark)
    before = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns, name
        rows = after.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES), name
        assert {8} <= {r.doc_id for r in rows}, name
        if name in ("language_id", "simhash_near_dedup"):
            assert {(r.doc_id, r.text) for r in rows} <= before, name
        if name == "simhash_near_dedup":
            assert sum(r.doc_id in (1, 2) for r in rows) == 1 and sum(r.doc_id == 8 for r in rows) == 2
        if name == "substring_dedup":
            assert len(rows) == docs.count()
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert coded.count() == docs.count()


def test_empty_table(spark):
    docs = _awkward(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0, name

"""The whole pipeline on empty tables, nulls, repeated rows and columns that bear the operators' own names."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, node string, key int, ids string, slot int, block int"


def rows():
    rng = random.Random(9)
    prose = lambda: " ".join(f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice(['ne', 'st', 'r', 'lt'])}{rng.randrange(400)}" for _ in range(90)) + "."
    texts = [prose() for _ in range(12)]
    own = [(i, t, "en", "s", len(t), 1, "n", 2, "x", 3, 4) for i, t in enumerate(texts)]
    own += [(100, texts[0], "en", "s", len(texts[0]), 1, "n", 2, "x", 3, 4), own[1], own[1]]  # a copy under another id, repeated rows
    own += [(200, None, None, None, None, None, None, None, None, None, None), (201, "", "en", "s", 0, 1, "n", 2, "x", 3, 4), (None, prose(), None, None, 5, None, None, None, None, None, None)]
    return own


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_run(spark, tmp_path, which):
    own = rows() if which == "odd" else []
    spark.createDataFrame(own, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, 0) for i in range(6)] if which == "odd" else []
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if which == "empty":
        assert not pieces
        return
    packed = {r.doc_id for r in pieces}
    assert packed <= {*range(12), None} and packed  # of copies the least id stays; nulls and empty texts fail the rules
    for doc in packed:
        lengths = sorted((r.start, r.length) for r in pieces if r.doc_id == doc)
        assert lengths[0][0] == 0 and sum(n for _, n in lengths) == next(r.doc_tokens for r in pieces if r.doc_id == doc)


def test_pseudonyms_take_the_key_of_the_session(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail me at some.body@example.org or 4111 1111 1111 1111", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda: corpus_pipeline.personal_data(spark, docs, "").first().text
    assert texts() != texts()
    spark.conf.set(corpus_pipeline.KEY, "a key")
    try:
        assert texts() == texts() != docs.first().text
    finally:
        spark.conf.unset(corpus_pipeline.KEY)

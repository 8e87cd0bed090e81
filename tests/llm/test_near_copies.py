"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from usagemill.llm import near_copies


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(texts):
    """Places of the first text of each component of pairs with similarity 0.8 or more."""
    sets, root = [plain_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and plain_similarity(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"edit{rng.random()}"
    return words


def planted(n=60):
    """Texts of 200 words with near copies on both sides of similarity 0.8: k edits far apart leave about (196 - 5k) / (196 + 5k)."""
    rng, texts = random.Random(5), []
    for _ in range(n):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(base), *[" ".join(edited(rng, base, k)) for k in (1, 2, 3, 4, 4, 8, 14)]]
    return texts


def stage(spark, rows):
    return corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), None)


def test_stage_equals_brute_force_jaccard(spark):
    texts = planted()
    got = {r.doc_id for r in stage(spark, [(i, t, "en") for i, t in enumerate(texts)]).collect()}
    expected = plain_kept(texts)
    assert len(expected) < len(texts) // 2
    assert got == expected


@pytest.mark.parametrize("seed", range(2))
def test_large_keys_lose_no_link(spark, seed):
    """One group of 1,000 texts with 0 to 5 edits of 120 words, about half of whose pairs are links."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, rng.randrange(6))) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.deduplicated(df).collect()} == plain_kept(texts)


def test_shared_hashes_are_counted():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40_000, n).astype(np.uint64)) for n in (0, 3, 9000, 20_000, 500)]
    assert (near_copies._shared(sets) == [[len(np.intersect1d(a, b)) if i != j else near_copies._shared(sets)[i, i] for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()


@pytest.mark.parametrize("chunk", [1024, 8])
def test_large_groups_equal_brute_force(spark, chunk):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, rng.choice([1, 1, 2, 9]))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in near_copies.deduplicated(df, chunk).collect()} == plain_kept(texts)


def test_rows_are_told_apart_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (None, a, "y"), (None, c, "y"), (None, c, "y"), (7, None, "z"), (8, "", "z"), (9, " \n", "z")]
    got = stage(spark, rows)
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a, "x"), (1, b, "x"), (None, c, "y"), (7, None, "z")], key=str)
    assert got.where("false").count() == 0 and stage(spark, []).count() == 0


def test_rows_are_chosen_where_they_are(spark, tmp_path):
    """Rows of several blocks and tasks, none of which is shuffled for a join by row."""
    from pyspark.sql import functions as F

    from usagemill.functions.tables import bucketed

    ids = spark.range(0, 30_000, numPartitions=3).select(F.monotonically_increasing_id().alias("rid"), F.col("id").alias("text"))
    rows = bucketed(ids.withColumn("block", near_copies.block_of("rid")), "block")
    assert rows.select("block").distinct().count() == 9
    wanted = rows.where("text % 7 = 3 OR text BETWEEN 4090 AND 4100 OR text > 29990")
    got = near_copies.chosen(rows, wanted.select("rid").repartition(5))
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in wanted.collect())
    assert near_copies.chosen(rows, wanted.where("false").select("rid")).count() == 0

    df = spark.createDataFrame([(i, f"one {i} two {i}") for i in range(40)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = near_copies.deduplicated(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(rid" not in plan and "SelectedBucketsCount" in plan
        assert out.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

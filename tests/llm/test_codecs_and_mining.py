"""Byte codec, hard negatives and whitening against the library, brute force and a plain eigenvalue solver."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from usagemill.llm import byte_codec, hard_negatives, whitening

# ---- byte codec


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_codec.tokenizer_path())


def odd_texts():
    rng = random.Random(11)
    signs = ["a", "B", "é", "ß", "7", "٣", "²", " ", "  ", "\n", "\t", "\x85", " ", "᠎", "​", "'s", "'S", "'ll", "<|endoftext|>", "<|endof", "!", "😀", "ಱ", "ࡰ", "\U00010d40", "͸", "﷐"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    return [None, "", " ", "<|endoftext|>", "<|endoftext|><|endoftext|> x <|endoftext|>", "x" * 40_000, "ab" * 9000 + " " * 70_000 + "cd", *texts, *texts[:20]]


def test_byte_codec_equals_the_library(spark, library):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)] + [(None, "no id", "y")], "doc_id long, text string, block string").repartition(3)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_codec.digests(docs, byte_codec.tokenizer_path()).collect()}
    assert len(got) == len(texts) + 1
    for i, text in [*enumerate(texts), (None, "no id")]:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))), text


@pytest.mark.parametrize("limit", [50, 1 << 23])
def test_byte_codec_keeps_columns_and_blocks_of_any_size(spark, library, monkeypatch, limit):
    monkeypatch.setattr(byte_codec, "BLOCK_WORDS", limit)
    texts = odd_texts()[:120]
    docs = spark.createDataFrame([(i, t, i % 3, "w") for i, t in enumerate(texts)], "no long, text string, block int, word string").repartition(2)
    got = byte_codec.encoded(docs, byte_codec.tokenizer_path())
    assert got.columns == ["no", "text", "block", "word", "ids"]
    rows = got.collect()
    assert sorted((r["no"], r.text, r.block, r.word) for r in rows) == sorted(((i, t, i % 3, "w") for i, t in enumerate(texts)), key=lambda x: x[0])
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in rows)
    back = byte_codec.decoded(got.select("no", "ids"), ["no"], byte_codec.tokenizer_path()).collect()
    assert {r["no"]: r.text for r in back} == {i: t or "" for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        byte_codec.encoded(got, byte_codec.tokenizer_path())
    assert byte_codec.digests(spark.createDataFrame([], "doc_id long, text string"), byte_codec.tokenizer_path()).count() == 0


def test_any_ids_decode_as_by_the_library(spark, library):
    rng = random.Random(3)
    lists = [[rng.randrange(50_257) for _ in range(rng.randint(1, 30))] for _ in range(200)] + [[], [50_256, 50_256], [60_000, 5]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)] + [(-1, None)], "k long, ids array<int>")
    got = {r.k: r.text for r in byte_codec.decoded(rows, ["k"], byte_codec.tokenizer_path()).collect()}
    assert got == {-1: None} | {k: library.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)}


def test_each_distinct_word_is_encoded_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"same words again {i % 5}") for i in range(4000)], "doc_id long, text string").repartition(4)
    words = byte_codec._words_encoded(byte_codec.blocks(docs, byte_codec.tokenizer_path()), byte_codec.tokenizer_path())
    assert words.count() == 4 * 8 and words.select("block").distinct().count() == 4


# ---- hard negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(0, 20), st.integers(0, 2**32))
def test_fields_hold_exact_products(n, size, bits, seed):
    rng = np.random.default_rng(seed)
    rows, anchors = rng.integers(-(1 << bits), 1 << bits, (n, size)), rng.integers(-(1 << bits), 1 << bits, (3, size))
    bias = max(-int(anchors.min()), 0)
    fields = hard_negatives.Fields(rows, int(anchors.max()) + bias)
    assert (fields.scores(anchors, bias) == anchors @ rows.T).all()


def test_fields_wider_than_a_word():
    rows = np.array([[1 << 29, -(1 << 29)], [(1 << 29) - 1, 5], [0, 0], [-(1 << 29), -(1 << 29)]])
    fields = hard_negatives.Fields(rows, 1 << 36)
    assert fields.width > 64 and (fields.scores(rows[:2], 1 << 29) == rows[:2] @ rows.T).all()


def plain_negatives(rows, every, positives, negatives):
    x = [(i, lab, np.floor(np.array(v, dtype=float) * 256)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, lab, v in x:
        if i % every == 0:
            for s, p in sorted((-int(v @ w), j) for j, other, w in x if other == lab and j != i)[:positives]:
                band = sorted((-int(v @ w), j) for j, other, w in x if other != lab and -50 * s <= 100 * int(v @ w) <= -95 * s)[:negatives]
                out += [(i, p, k + 1, j, -s, -n) for k, (n, j) in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize(("size", "limits"), [(3, (16, 4)), (24, (1 << 16, 1 << 13))])
def test_negatives_equal_brute_force_and_sql(spark, tmp_path, size, limits):
    import duckdb

    rng = np.random.default_rng(size)
    rows = [(i, (rng.normal(size=size) * 0.2 + 0.1).astype(np.float32).tolist(), int(rng.integers(0, 4) if rng.random() < 0.6 else 0)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(90)] + rows[:60] + [(50, rows[-1][1], 1)]  # equal vectors, repeated rows, an id with two vectors
    odd = [(2000, None, 1), (2050, [float("nan")] * size, 1), (2100, [None] * size, 1), (2150, [float("inf")] * size, 2), (None, rows[0][1], 1), (2200, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "z") for r in rows + odd], "vec_id long, embedding array<float>, label int, part string").repartition(3)
    got = hard_negatives.hard_negatives(df, rows=limits[0], anchors=limits[1]).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, 50, 5, 3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(hard_negatives.ORACLE_SQL).fetchall())


def test_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, [1.0], 0)], [(50, [1.0], 0)], [(50, [1.0], 0), (51, [1.0], 0)], [(50, [-1.0], 0), (51, [1.0], 0), (52, [1.0], 1)]):
        assert hard_negatives.hard_negatives(spark.createDataFrame(rows, schema)).count() == 0


# ---- whitening


def spectrum(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize(
    "values", [np.linspace(0.01, 1, 64), np.geomspace(1e-12, 1, 40), [1.0] * 20 + [0.5] * 20, [1, 1 - 1e-11, 1 - 2e-11, 0.3, 0, 0, 0], [0.7], [1.0] + [0.0] * 9, np.r_[np.linspace(0.5, 0.500001, 30), 1]]
)
def test_contours_find_all_eigenvectors(spark, values):
    matrix = spectrum(values) * 37.5
    got, vector = whitening.components(spark, matrix, 32)
    expected = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    many = min(32, int((expected > 1e-11 * expected[0]).sum()))
    assert len(got) >= many and np.allclose(got[:many], expected[:many], rtol=1e-9, atol=1e-12 * expected[0])
    assert np.abs(matrix @ vector - vector * got).max() < 1e-12 * expected[0] and np.allclose(np.linalg.norm(vector, axis=0), 1)
    assert np.abs(vector.T @ vector - np.eye(len(got))).max() < 1e-6


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 30):
        matrix = rng.normal(size=(size, size))
        matrix += matrix.T
        own = np.linalg.eigvalsh(matrix)
        for shift in (-3.0, 0.0, 0.1, *((own[1:] + own[:-1]) / 2)):
            assert whitening.below(matrix, shift) == (own < shift).sum()
    assert whitening.below(np.zeros((4, 4)), 0.0) == 0 and whitening.below(np.array([[0.0, 1], [1, 0]]), 0.0) == 1


def test_whitened_equals_a_plain_solver(spark):
    rng = np.random.default_rng(4)
    data = (rng.normal(size=(900, 40)) * np.linspace(0.05, 1, 40)).astype(np.float32)
    rows = [(i if i % 10 else None, v.tolist()) for i, v in enumerate(data)] + [(7, data[7].tolist())]
    odd = [(5000, None), (5001, [float("nan")] * 40), (5002, [None] * 40), (5003, [float("-inf")] * 40)]
    got = whitening.whitened(spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, n string").repartition(3)).toPandas()
    x = np.floor(np.array([r[1] for r in rows], dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    sums, n = x.sum(axis=0), len(x)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1][:32], vector[:, ::-1][:, :32]
    assert len(got) == 32 * n and (got["n"] == n).all() and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 32)[0], value / np.trace(covariance), rtol=1e-10)
    plain = centred @ (vector / np.sqrt(value))
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert sorted(got.query("component == 1")["deviation"].tolist()) == sorted(deviation.tolist())
    own = got[got["vec_id"] == 123].sort_values("component")["whitened"].to_numpy()
    all_ = got[got["vec_id"] == 456].sort_values("component")["whitened"].to_numpy()
    sign = np.sign(own * plain[123])
    assert np.allclose(own, plain[123] * sign, atol=1e-7) and np.allclose(all_, plain[456] * sign, atol=1e-7)


def test_whitening_of_few_and_flat_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)).collect()
    assert len(flat) == 9 and {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12
    uneven = whitening.whitened(spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0]), (3, []), (4, [0.0, 2.0])], schema)).collect()
    assert len(uneven) == 8 and uneven[0].identity_error < 1e-9

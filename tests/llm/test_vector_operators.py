"""Near duplicates and exact search against brute force, and the pipeline on small tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from usagemill.llm import simhash, topk


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, ids, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB c\n\té", max_size=80))
def test_fingerprint_equals_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.one_of(st.integers(0, 9), st.integers(10, 140)), st.integers(1, 150), st.integers(1, 4), st.integers(0, 2**32))
def test_bit_slices_equal_bit_counts(radius, n, words, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, (n, words), dtype=np.uint64)
    b = a.copy()
    for _ in range(radius + 1):
        at = np.arange(n), rng.integers(0, words, n)
        b[at] ^= np.where(rng.random(n) < 0.8, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    expected = np.bitwise_count(a ^ b).sum(axis=1, dtype=int) <= radius
    x, y = simhash.planes(a), simhash.planes(b)
    near = simhash._bits(simhash.near((x[i] ^ y[i] for i in range(64 * words)), simhash.planes_of_ones(n), radius), n)
    assert (near == expected).all()
    assert (simhash.all_pairs(a, radius) == (np.bitwise_count(a[:, None] ^ a[None]).sum(axis=2, dtype=int) <= radius)).all()
    key = np.sort(rng.integers(0, 5, n))
    i, j = simhash.pairs_in_runs(key, a, radius)
    together = np.triu((key[:, None] == key) & simhash.all_pairs(a, radius), 1)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == list(zip(*map(np.ndarray.tolist, np.nonzero(together)), strict=True))


@pytest.mark.parametrize("chunk", [1024, 8])
def test_components_equal_brute_force(spark, chunk):
    rng = random.Random(7)
    prints = []
    for _ in range(12):
        fp = rng.getrandbits(64)
        for _ in range(30):  # chains of near fingerprints
            prints.append(fp)
            for _ in range(rng.randint(0, 3)):
                fp ^= 1 << rng.randrange(64)
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in set(prints)], "fp long")
    roots = {r.a: r.b for r in simhash.components(simhash.links(nodes, 4, chunk)).collect()}
    own = sorted(set(prints))
    expected = plain_components(own, list(range(len(own))), 4)
    signed = [int(np.uint64(p).astype(np.int64)) for p in own]
    got = [roots.get(s, s) for s in signed]
    pairing = {}
    for e, g in zip(expected, got, strict=True):
        assert pairing.setdefault(e, g) == g
    assert len(set(pairing.values())) == len(pairing)


def test_documents_in_components(spark):
    base = " ".join(f"word{i}" for i in range(200))
    texts = [base, base.upper(), base + " tail", None, "", "  ", "quite another text of several words", base]
    docs = spark.createDataFrame([(10 + i, t, "x") for i, t in enumerate(texts)] + [(10, base, "x"), (None, base, "x")], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.components_of(docs.select("doc_id", "text")).collect()), key=str)
    expected = plain_components([plain_fingerprint(t) for t in texts], [10 + i for i in range(len(texts))], 4)
    assert got == sorted([(10 + i, c) for i, c in enumerate(expected)] + [(10, 10), (None, 10)], key=str)
    assert simhash.components_of(docs.where("false").select("doc_id", "text")).count() == 0


def plain_top(rows, k, every):
    x = [(i, np.floor(np.array(v, dtype=float) * 64)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, own in x:
        if q % every == 0:
            ranked = sorted((-int(own @ v), i) for i, v in x if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


def clustered(n, size=12, spread=(0.01, 0.5)):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, size))
    return [(i, (centres[i % 5] + rng.normal(size=size) * rng.choice(spread)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "cell", "group"), [(400, 16, 40), (400, 2048, 4096), (400, 16, 4096), (7, 16, 40), (1, 16, 40)])
def test_search_equals_brute_force(spark, n, cell, group):
    rows = clustered(n)
    rows += [(1000 + i, rows[0][1]) for i in range(60 if n > 10 else 0)]  # many equal vectors
    rows += rows[:45] + [(20, rows[-1][1])]  # repeated rows, and an id with two vectors
    odd = [(2000, None), (2020, [float("nan")] * 12), (2040, [1.0, None] + [0.0] * 10), (2060, [float("inf")] * 12), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, rid string").repartition(3)
    got = topk.top_k(df, pivots=6, cell=cell, group=group).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == plain_top(rows, 20, 20)


def test_search_equals_its_sql_on_repeated_rows(spark, tmp_path):
    import duckdb

    rows = clustered(300) + [(0, [0.5] * 12), (1, [0.5] * 12), (1, [0.5] * 12)] + clustered(300)[:50]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = topk.op10_topk(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(con.sql(topk.ORACLE_SQL).fetchall())


def test_bounds_hold_and_exclude_far_cells(spark):
    """No vector exceeds its cell's bound; on clustered vectors most cells can't hold any of a query's best."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 24)) * 3
    rows = [(i, (centres[i % 16] + rng.normal(size=24) * 0.05).astype(np.float32).tolist()) for i in range(3200)]
    index, table_, size = topk.build(topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), 16, 32, 64)
    placed = table_.toPandas()
    x = topk._matrix(placed["v"], size)
    q = x[placed["vec_id"].to_numpy() % 20 == 0]
    score, bound = q @ x.T, index.bounds(q, index.cells)
    at = np.searchsorted(index.cells["cell"].to_numpy(), placed["cell"])
    assert (index.cells["cell"].is_monotonic_increasing) and (score <= bound[:, at]).all()
    kth = np.partition(score, -21, axis=1)[:, -21]
    assert (bound < kth[:, None]).mean() > 0.9


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [2.0])], empty.schema)).count() == 0


def test_pipeline_on_the_smallest_tables(spark, tmp_path):
    import os

    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}

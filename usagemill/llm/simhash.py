"""SimHash near-duplicates with bit-sliced comparison.

1. Each text gets a 64-bit fingerprint from the XXH64 values of its word shingles. Equal fingerprints are one node from here on.
2. A fingerprint is cut into BLOCKS blocks. Two that differ in at most `radius` bits agree on at least BLOCKS - radius whole
   blocks, so they meet under one of the keys made of that many blocks. Nodes are dealt by key and sorted.
3. Rows of a key are compared bit-sliced: bit planes are stored vertically, 64 fingerprints a word; the differing bits of
   64 pairs at a time run through carry-save counters, and a block is abandoned once all its pairs exceed the radius.
   Of each key's links only a spanning star is kept, so no group is expanded into its pairs.
4. A key with more than CHUNK nodes is not compared where it lies: its nodes are dealt again as pairs of chunks, each of
   which is a bounded task. Every pair of nodes still meets.
5. Links are merged into components by alternating large-star and small-star rounds over written tables.

Defined results: null and empty texts, and texts without a word, have fingerprint zero and are linked like any other. Repeated
rows come back as often as they went in. A null doc_id is no component's name unless a component has no other. Extra columns are
ignored. An empty table gives an empty result. `near_copies` has the same comparison for texts that are similar rather than equal but for
a few bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm.common import table, written

WORDS, RADIUS = 4, 4
#: Widths of the blocks; with six, two of them always agree within radius 4.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Most nodes of a key that one task compares; and the run length up to which runs are compared together.
CHUNK, SHORT = 1024, 64

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


# ---- fingerprints -------------------------------------------------------------------------------------------------------


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text, as an unsigned number."""
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) >= words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text); fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", prints("text").alias("fp"))


# ---- bit-sliced comparison ----------------------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words): bit b of fingerprint i is bit i % 64 of planes[b, i // 64]; fps has one or several 64-bit words a fingerprint."""
    fps = np.ascontiguousarray(fps.reshape(len(fps), -1), "<u8")
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    padded = np.zeros((64 * fps.shape[1], -(-packed.shape[1] // 8) * 8), np.uint8)
    padded[:, : packed.shape[1]] = packed
    return padded.view("<u8")


def near(differences: Iterator[np.ndarray], valid: np.ndarray, radius: int) -> np.ndarray:
    """Words whose bits say which lanes differ in at most radius of the planes of differences, an even number."""
    counters = [np.zeros_like(valid) for _ in range(radius.bit_length())]
    many = np.zeros_like(valid)

    def beyond() -> np.ndarray:
        more, equal = many.copy(), ~np.zeros_like(many)
        for k in range(len(counters) - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                more |= equal & counters[k]
                equal &= ~counters[k]
        return more

    for k, (a, b) in enumerate(zip(differences, differences, strict=False)):
        if not counters:
            many |= a | b
        else:
            half = counters[0] ^ a
            carry = (counters[0] & a) | (half & b)
            counters[0] = half ^ b
            for i in range(1, len(counters)):
                carry, counters[i] = counters[i] & carry, counters[i] ^ carry
            many |= carry
        # a block can't be abandoned before it has had more differences than the radius
        if k % 4 == 3 and 2 * k + 2 > radius and not (valid & ~beyond()).any():
            return np.zeros_like(valid)
    return valid & ~beyond()


def _bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows, the least row that the links a-b lead to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def planes_of_ones(n: int) -> np.ndarray:
    out = np.zeros(-(-n // 64) * 64, np.uint8)
    out[:n] = 1
    return np.packbits(out, bitorder="little").view("<u8")


def pairs_in_runs(key: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows a < b of equal key within radius of each other; all runs together, row by row and its d-th follower."""
    place = np.arange(len(key))
    run = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    left, right = [place[:0]], [place[:0]]
    for d in range(1, int(np.bincount(run).max(initial=0))):
        rows = place[:-d][run[:-d] == run[d:]]
        if not len(rows):
            break
        x, y = planes(fps[rows]), planes(fps[rows + d])
        hit = rows[_bits(near((x[b] ^ y[b] for b in range(len(x))), planes_of_ones(len(rows)), radius), len(rows))]
        left.append(hit)
        right.append(hit + d)
    return np.concatenate(left), np.concatenate(right)


def all_pairs(fps: np.ndarray, radius: int) -> np.ndarray:
    """(n, n): which fingerprints lie within radius of each other; memory grows with the square of their bounded number."""
    n = len(fps)
    block, ones, words = planes(fps), planes_of_ones(n), fps.reshape(n, -1)
    linked = np.zeros((n, n), bool)
    for at in range(0, n, 128):
        own = words[at : at + 128]
        full = (np.where(own[:, b // 64] >> np.uint64(b % 64) & np.uint64(1), ~np.uint64(0), np.uint64(0))[:, None] for b in range(len(block)))
        valid = np.broadcast_to(ones, (len(own), len(ones))).copy()
        linked[at : at + 128] = _bits(near((plane[None, :] ^ f for plane, f in zip(block, full, strict=True)), valid, radius), n)
    return linked


def short_runs(key: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """(links, 2): stars of the links within runs of equal key."""
    a, b = pairs_in_runs(key, fps, radius)
    if not len(a):
        return np.empty((0, 2), np.uint64)
    root = _roots(len(key), a, b)
    moved = np.flatnonzero(root != np.arange(len(key)))
    return np.stack([fps[moved], fps[root[moved]]], axis=1)


def long_run(fps: np.ndarray, radius: int) -> np.ndarray:
    """(links, 2): a star for each component of the links within fps."""
    n = len(fps)
    linked, root, edges = all_pairs(fps, radius), np.full(n, -1), []
    for start in range(n):
        if root[start] >= 0:
            continue
        reached = linked[start].copy()
        reached[start] = True
        while not (reached == (more := reached | linked[reached].any(axis=0))).all():
            reached = more
        root[reached] = start
        others = np.flatnonzero(reached & (np.arange(n) != start))
        edges.append(np.stack([fps[others], np.full(len(others), fps[start])], axis=1))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.uint64)


# ---- candidates ---------------------------------------------------------------------------------------------------------


def block_keys(fp: Column, radius: int) -> Column:
    """The keys of a fingerprint: for each choice of blocks that must agree, their bits and the number of the choice."""
    shifts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in zip(shifts, BLOCKS, strict=True)]
    keys = []
    for number, chosen in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, BLOCKS[i]).bitwiseOR(block[i])
        keys.append(key)
    return F.array(*keys)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, fp) of sorted batches, never cutting a run of one key."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch["key"].iloc[-1]
        if batch["key"].iloc[0] == last:
            if held and held[-1]["key"].iloc[-1] != last:
                whole = pd.concat(held)
                yield whole["key"].to_numpy(), whole["fp"].to_numpy().view(np.uint64)
                held = []
            held.append(batch)
            continue
        cut = int(np.searchsorted(batch["key"].to_numpy(), last))
        whole = pd.concat([*held, batch.iloc[:cut]])
        yield whole["key"].to_numpy(), whole["fp"].to_numpy().view(np.uint64)
        held = [batch.iloc[cut:]]
    if held:
        whole = pd.concat(held)
        yield whole["key"].to_numpy(), whole["fp"].to_numpy().view(np.uint64)


def _comparer(radius: int, chunk: int):
    """Sorted (key, fp) rows to rows (a, b, key): links, or nodes a of a large key, dealt to the pair of chunks `key`."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, fps in _runs(batches):
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            ends = np.append(starts[1:], len(key))
            size = np.repeat(ends - starts, ends - starts)
            found = [short_runs(key[few], fps[few], radius)] if (few := (size > 1) & (size <= SHORT)).any() else []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                if SHORT < b - a <= 2 * chunk:
                    found.append(long_run(fps[a:b], radius))
                elif b - a > 2 * chunk:
                    yield from _dealt(int(key[a]), fps[a:b], chunk)
            if found and len(links := np.concatenate(found)):
                yield pd.DataFrame({"a": links[:, 0].view(np.int64), "b": links[:, 1].view(np.int64), "key": None, "cell": None})

    return compare


def _dealt(key: int, fps: np.ndarray, chunk: int) -> Iterator[pd.DataFrame]:
    """Each chunk of a large key's nodes under all pairs of chunks that it belongs to."""
    chunks = -(-len(fps) // chunk)
    for i in range(chunks):
        own = fps[i * chunk : (i + 1) * chunk].view(np.int64)
        for j in range(chunks):
            cell = min(i, j) * chunks + max(i, j)
            yield pd.DataFrame({"a": own, "b": None, "key": key, "cell": cell})


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between nodes (distinct fp), enough to connect all that lie within radius of each other."""
    schema = "a long, b long, key long, cell long"
    keyed = nodes.select(F.explode(block_keys(F.col("fp"), radius)).alias("key"), "fp")
    first = written(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_comparer(radius, chunk), schema))
    direct = first.where("key IS NULL").select("a", "b")
    rest = first.where("key IS NOT NULL").select(F.xxhash64("key", "cell").alias("key"), F.col("a").alias("fp"))
    # a cell's key may by chance be shared by two cells, which only makes more comparisons; up to two chunks are compared in place
    again = rest.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_comparer(radius, 4 * chunk), schema).where("key IS NULL").select("a", "b")
    return direct.unionByName(again).where("a <> b").distinct()


# ---- components ---------------------------------------------------------------------------------------------------------


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    """Tells tables of links apart: their number, and the sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b): for each node of a link except the least of its component, that least node.

    Rounds of large-star and small-star, each a written table. When no node has two neighbours below it and no named
    least node has one either, every node points at its component's least node.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while state[0]:
        edges = written(_small_star(written(_large_star(edges))))
        before, state = state, _state(edges)
        if before == state:
            break
    return edges


def components_of(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text)."""
    prints = written(fingerprints(docs, words))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes.select("fp"), radius))
    of = nodes.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "rep", F.coalesce("b", "fp").alias("root"))
    linked = written(of)
    least = written(linked.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = written(linked.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp", "left")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

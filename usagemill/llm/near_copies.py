"""SimHash near-dedup of texts by the similarity of their word shingles: bit-sliced comparison of fingerprints, links by exact comparison.

Fingerprints of 64 bits within a radius of 4 find less than a fifth of the pairs of similarity 0.8, so here they are longer.

1. A text's shingles are its runs of WORDS words, or all of it if it has fewer. Texts with equal sets of shingles are one node.
2. A node's fingerprint has 256 bits; each is set if it is in over half of the shingles' hashes. At Jaccard similarity 0.8, two nodes
   differ in 39 bits on average (in up to 48 with under ten shingles), unrelated ones in 128. No blocks of bits agree for sure within such a
   radius, so nodes are dealt by the least values of BANDS * BAND_ROWS hashes of their shingles: at 0.8, two nodes share one of BANDS keys
   with probability 0.9996.
3. A key's fingerprints are compared bit-sliced (`simhash`): planes of bits, carry-save counters, blocks abandoned once all pairs exceed
   RADIUS (about similarity 0.55). All pairs within it are candidates of keys with up to FEW nodes; of larger ones at first those of a forest
   of the least distances and each node's NEAREST. A key with more than CHUNK nodes is dealt again as pairs of chunks, so that every pair still meets.
4. Pairs are compared by the shingles of their texts. First each node's best pair; then those that still lie between two components.
5. What larger keys still have within RADIUS between two components is settled exactly: these nodes meet again under their key, with the
   hashes of all their shingles, and every such pair is compared there.
6. Of each component one row stays: the least by doc_id (nulls last), then by content.

Texts stay in the table that they are first written to, which is bucketed by blocks of rows. Rows are chosen there by a bitmap for each
block; only those of candidates are shuffled.

Every link has exact similarity SIMILARITY or more; pairs of at least that are missed only by chance of the hashes (steps 2 and 3), never by a limit.

Defined results: null and empty texts, and texts without a word, are one node without shingles. Rows are told apart by row, not by
doc_id: different texts that share an id stay, repeated rows and copies without an id don't. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagemill.functions.tables import bucketed
from usagemill.llm.common import written
from usagemill.llm.simhash import SHORT, all_pairs, components, pairs_in_runs

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 20, 5
#: Differing bits up to which pairs are candidates, 4 standard deviations beyond the mean at SIMILARITY; most nodes of a key that are compared in place.
BITS, RADIUS, CHUNK = 256, 64, 1024
#: Nodes of a key of which all pairs are candidates at once, and pairs of a node that are besides the forest's of a larger one, whose other pairs come last.
FEW, NEAREST = 16, 3
#: Rows of a task that follow each other and are one block have equal row ids but for so many bits; at most 15, as Spark's bitmaps have 32,768 places.
BLOCK_BITS = 12

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RANDOM = np.random.default_rng(8)
_FACTORS = _RANDOM.integers(0, 1 << 31, BANDS * BAND_ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)
_SPREAD = _RANDOM.integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH = ["s0", "s1", "s2", "s3"]


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    return {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similarity(a: set[bytes], b: set[bytes]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The words of a fingerprint: each bit is set if it is in over half of the hashes, spread to BITS bits each."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        wide = hashes[at : at + 4096, None] * _SPREAD
        wide = (wide ^ wide >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        bits = np.unpackbits((wide ^ wide >> np.uint64(32)).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)


def signature(own: set[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """(node, keys, fingerprint) of a set of shingles."""
    hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)))
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        least = np.minimum(least, (short[at : at + 2048, None] * _FACTORS + _OFFSETS).min(axis=0))
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)
    return xxhash.xxh64_intdigest(hashes.tobytes()), keys.view(np.int64), fingerprint(hashes)


def _signatures(text: Column) -> Column:
    @F.pandas_udf("node long, keys array<long>, s0 long, s1 long, s2 long, s3 long")
    def own(texts: pd.Series) -> pd.DataFrame:
        found = [signature(shingles(t)) for t in texts]
        sketch = np.array([s for _, _, s in found], np.int64).reshape(-1, 4)
        node = np.array([n for n, _, _ in found], np.uint64).view(np.int64)
        return pd.DataFrame({"node": node, "keys": [k for _, k, _ in found]} | dict(zip(_SKETCH, sketch.T, strict=True)))

    return own(text)


def _similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(shingles(x), shingles(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    return of(a, b)


# ---- rows of the table of texts -----------------------------------------------------------------------------------------


def block_of(rid: str) -> Column:
    return F.shiftright(rid, BLOCK_BITS)


def chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of rows (rid, block and others), bucketed by block, whose rid is in ids (rid). Only ids are shuffled."""
    place = F.col("rid").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    # dealt before they are added up, so that no block has a bitmap in each task
    dealt = ids.select(block_of("rid").alias("of"), place.alias("place")).repartition("of")
    masks = dealt.groupBy("of").agg(F.bitmap_construct_agg("place").alias("mask")).hint("shuffle_hash")
    byte = F.substring(F.col("mask"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), place.bitwiseAND(F.lit(7)).cast("int"))
    return rows.join(masks, (F.col("block") == F.col("of")) & (bit == 1), "left_semi")


# ---- candidates ---------------------------------------------------------------------------------------------------------


def forest(linked: np.ndarray, sketch: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, row, agreeing bits): of the linked pairs, a spanning forest with the least distances, and each row's NEAREST."""
    n, at, out = len(sketch), 0, []
    best, parent, outside = np.full(n, -1), np.zeros(n, int), np.ones(n, bool)
    for left in range(n - 1, -1, -1):
        outside[at], best[at] = False, -2
        some = np.flatnonzero(linked[at])
        some = some[some != at]
        bits = BITS - np.bitwise_count(sketch[some] ^ sketch[at]).sum(axis=1, dtype=int)
        near = np.argsort(-bits, kind="stable")[:NEAREST]
        out += [(at, i, b) for i, b in zip(some[near].tolist(), bits[near].tolist(), strict=True)]
        nearer = outside[some] & (bits > best[some])
        best[some[nearer]], parent[some[nearer]] = bits[nearer], at
        if left:
            at = int(best.argmax())
            if best[at] >= 0:
                out.append((int(parent[at]), at, int(best[at])))
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted batches cut anew so that no run of one key is cut."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = int(np.searchsorted(batch["key"].to_numpy(), batch["key"].iloc[-1]))
        if held and (cut or held[-1]["key"].iloc[-1] != batch["key"].iloc[0]):
            yield pd.concat([*held, batch.iloc[:cut]])
            held = []
        elif cut:
            yield batch.iloc[:cut]
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held)


def _comparer(chunk: int, most: int):
    """Sorted (key, node, sketch) rows to candidates (a, b, bits), or nodes a of a key with more than `most`, dealt to the pair of chunks `cell`."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches):
            key, node, sketch = rows["key"].to_numpy(), rows["node"].to_numpy(), rows[_SKETCH].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(starts, len(key)))
            few = np.flatnonzero(np.repeat((size > 1) & (size <= SHORT), size))
            a, b = pairs_in_runs(key[few], sketch[few], RADIUS) if len(few) else (few, few)
            a, b = few[a], few[b]
            run = np.searchsorted(starts, a, "right") - 1
            alone = size[run] <= FEW
            x, y = a[alone], b[alone]
            found = [(node[x], node[y], BITS - np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=int))]
            order = np.flatnonzero(~alone)[np.argsort(run[~alone], kind="stable")]
            small, at = np.unique(run[order], return_index=True)
            some = dict(zip(small.tolist(), np.split(order, at[1:]), strict=True)) if len(order) else {}
            for r in sorted([*some, *np.flatnonzero(size > SHORT).tolist()]):
                start, n = int(starts[r]), int(size[r])
                if n > most:
                    for i in range(0, n, chunk):
                        part, chunks = rows.iloc[start + i : start + min(i + chunk, n)], -(-n // chunk)
                        for j in range(chunks):
                            cell = min(i // chunk, j) * chunks + max(i // chunk, j)
                            yield part.rename(columns={"node": "a"}).assign(b=None, bits=None, cell=cell)[_CANDIDATES]
                    continue
                if n > SHORT:
                    linked = all_pairs(sketch[start : start + n], RADIUS)
                else:
                    linked = np.zeros((n, n), bool)
                    i, j = a[some[r]] - start, b[some[r]] - start
                    linked[i, j] = linked[j, i] = True
                if links := forest(linked, sketch[start : start + n]):
                    i, j, own = np.array(links).T
                    found.append((node[start + i], node[start + j], own))
            a, b, bits = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "bits": bits}).reindex(columns=_CANDIDATES)

    return compare


_CANDIDATES = ["a", "b", "bits", "key", "cell", *_SKETCH]
_SCHEMA = ", ".join(f"{c} long" for c in _CANDIDATES)


# ---- what larger keys have left

_APART = ", ".join(f"{c} long" for c in ("key", "node", "root", "cell", *_SKETCH))


def _apart(chunk: int, most: int):
    """Sorted (key, node, root, sketch) rows to those of larger keys that have a neighbour in another component, or to the chunks of a key with more than `most`."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _runs(batches):
            key, root, sketch = rows["key"].to_numpy(), rows["root"].to_numpy(), rows[_SKETCH].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            mixed = np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts)
            size = np.diff(np.append(starts, len(key)))
            for r in np.flatnonzero(mixed & (size > FEW)).tolist():
                at = slice(int(starts[r]), int(starts[r] + size[r]))
                part, n = rows.iloc[at], int(size[r])
                if n > most:
                    chunks = -(-n // chunk)
                    for i in range(chunks):
                        for j in range(chunks):
                            yield part.iloc[i * chunk : (i + 1) * chunk].assign(cell=min(i, j) * chunks + max(i, j))
                    continue
                near = all_pairs(sketch[at], RADIUS) & (root[at][:, None] != root[at][None, :])
                yield part[near.any(axis=1)].assign(cell=None)

    return lambda batches: (x[["key", "node", "root", "cell", *_SKETCH]].astype({"cell": "Int64"}) for x in find(batches))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of some sorted sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    more = np.cumsum(times > 1) - 1
    some = times[at] > 1
    owner, at = owner[some], more[at[some]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(at.max(initial=-1)) + 1, 8192):
        a, b = np.searchsorted(at, (low, low + 8192))
        own = np.zeros((len(sets), 8192), np.float32)
        own[owner[a:b], at[a:b] - low] = 1
        out += own @ own.T
    return out


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (key, node, root, sketch, hashes) rows to links (a, b) that connect all that are similar and of two components."""
    for rows in _runs(batches):
        for _, own in rows.groupby("key", sort=False):
            node, root, sketch = own["node"].to_numpy(), own["root"].to_numpy(), own[_SKETCH].to_numpy().view(np.uint64)
            sets = [np.frombuffer(x, np.uint64) for x in own["hashes"]]
            size = np.array([len(x) for x in sets])
            both = _shared(sets).astype(float)
            alike = all_pairs(sketch, RADIUS) & (root[:, None] != root[None, :]) & (both / np.maximum(size[:, None] + size[None, :] - both, 1) >= SIMILARITY)
            i, j = np.nonzero(np.triu(alike, 1))
            # of equal pairs of components one link is enough
            _, one = np.unique(np.stack([np.minimum(root[i], root[j]), np.maximum(root[i], root[j])]), axis=1, return_index=True)
            if len(one):
                a, b = node[i[one]], node[j[one]]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _hashes(text: Column) -> Column:
    @F.pandas_udf("binary")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series([np.sort(np.fromiter(map(xxhash.xxh64_intdigest, s), np.uint64, len(s))).tobytes() for s in map(shingles, texts)], dtype=object)

    return own(text)


def remaining(nodes: DataFrame, roots: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between components (roots: a, b) of nodes (node, rid, keys, sketch) that share a key of more than FEW nodes. rows has the texts by rid and block."""
    of = nodes.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = of.select(F.explode("keys").alias("key"), "node", "root", F.lit(None).cast("long").alias("cell"), *_SKETCH)
    dealt = lambda df: df.repartition("key").sortWithinPartitions("key", "node")
    first = written(dealt(keyed).mapInPandas(_apart(chunk, 2 * chunk), _APART))
    cells = first.where("cell IS NOT NULL").withColumns({"key": F.xxhash64("key", "cell"), "cell": F.lit(None).cast("long")}).distinct()
    left = written(first.where("cell IS NULL").unionByName(dealt(cells).mapInPandas(_apart(chunk, 8 * chunk), _APART)).drop("cell"))
    ends = nodes.join(left.select("node").distinct(), "node", "left_semi").select("rid")
    sets = chosen(rows.select("rid", "block", "node", "text"), ends).select("node", _hashes(F.col("text")).alias("hashes"))
    return written(dealt(left.join(written(sets), "node")).mapInPandas(_settle, "a long, b long"))


# ---- first candidates


def candidates(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b, bits): pairs of nodes (distinct node, keys, sketch) to compare."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", *_SKETCH)
    first = written(keyed.repartition("key").sortWithinPartitions("key", "node").mapInPandas(_comparer(chunk, 2 * chunk), _SCHEMA))
    cells = first.where("key IS NOT NULL").select(F.xxhash64("key", "cell").alias("key"), F.col("a").alias("node"), *_SKETCH)
    # the diagonal's cells have each node once; two cells that share a key by chance only make more comparisons
    again = cells.distinct().repartition("key").sortWithinPartitions("key", "node").mapInPandas(_comparer(chunk, 8 * chunk), _SCHEMA)
    return first.where("key IS NULL").unionByName(again).select("a", "b", "bits").distinct()


# ---- links --------------------------------------------------------------------------------------------------------------


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts (node, text) are similar."""
    sides = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    for side in sides:
        pairs = pairs.join(side, side.columns[0])
    return written(pairs.where(_similarity(F.col("text_a"), F.col("text_b")) >= SIMILARITY).select("a", "b"))


def _between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that lie in two components by roots (a, b: a node and its component's least node)."""
    for c in "ab":
        pairs = pairs.join(roots.select(F.col("a").alias(c), F.col("b").alias(f"root_{c}")), c, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def links(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between the nodes of a table (rid, block, text, node, keys, sketch) bucketed by block that connect all that are similar."""
    nodes = written(rows.groupBy("node").agg(F.min("rid").alias("rid"), *[F.first(c).alias(c) for c in ("keys", *_SKETCH)]))
    pairs = written(candidates(nodes, chunk))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    firsts = nodes.join(ends, "node", "left_semi").select("rid")
    texts = written(chosen(rows.select("rid", "block", "node", "text"), firsts).select("node", "text"))
    best = written(pairs.groupBy("b").agg(F.max(F.struct("bits", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"))
    first = _linked(best, texts)
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti")
    more = first.unionByName(_linked(_between(rest, components(first)), texts))
    return more.unionByName(remaining(nodes, components(more), rows, chunk))


def deduplicated(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text and other columns) with one row of each component."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"), _signatures(F.col("text")).alias("own"))
    content = F.xxhash64(*[F.col(f"row.`{c}`") for c in docs.columns]).alias("content")
    rows = bucketed(named.select("row", "rid", block_of("rid").alias("block"), content, "own.*"), "block")
    roots = components(links(rows.select("rid", "block", F.col("row.text").alias("text"), "node", "keys", *_SKETCH), chunk)).select(F.col("a").alias("node"), "b")
    least = F.min(F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), "content", "rid"))
    first = written(rows.groupBy("node").agg(least.alias("first")))  # so that the rows of a large node don't meet in a join
    kept = written(first.join(roots, "node", "left").groupBy(F.coalesce("b", "node").alias("root")).agg(F.min("first").alias("first")).select("first.rid"))
    return chosen(rows.select("rid", "block", "row"), kept).select("row.*")

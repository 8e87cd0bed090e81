"""Exact top-k inner products with a pivot-distance index.

1. Pivots are the means of clusters of a bounded sample. Every vector is keyed by its nearest pivot and its distance from it, in rings.
2. Rings, in order of distance, are joined to annuli of about a cell's rows; a ring with more rows than that is split by a hash of the
   row. There are at most MAX_CELLS cells, so the table of cells (pivot, nearest and farthest distance, largest norm) is of bounded size.
   Neighbouring cells, up to GROUP rows, are searched by one task.
3. The triangle inequality gives, for a query at distance d from a pivot and an annulus from lo to hi, that no vector in it is nearer than
   max(d - hi, lo - d, 0), so its inner product is at most (|q|^2 + |x|^2 - nearest^2) / 2, and also at most q.c + |q| hi. Bounds are
   rounded up, so the result is exact.
4. A query first searches the group of the cell with its best bound, which gives it a score to beat. It then goes to those other groups
   only that have a cell whose bound reaches that score. Within a group, annuli are expanded in the order of their bounds, and a query
   stops at those whose bound is below its score to beat, which rises on the way.

Queries and groups meet in co-grouped tasks, as blocks for matrix products; no rows are paired by Spark. Groups that no query goes to
aren't moved. A query is sent to a group once, with its vector; what it may leave out there is worked out in the task.

Defined results: a vector that is null, or holds null or non-finite components, and a row without an id take no part. Every other row is a
candidate of its own, also if rows share an id or are equal, except for queries with its id; rows that share an id divisible by `every` are
queries of their own, each with its own ranks. Vectors of unequal lengths are padded with zeros. Extra columns are ignored. An empty table,
or one without queries, gives an empty result. With fewer than k candidates, all are returned. Components times 64 have to lie within 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.llm.common import bounded_sample, table, written

K, EVERY = 20, 20
#: Bounds: vectors in the sample that places the pivots, pivots, rings of a pivot, rows of a cell at first, and cells.
SAMPLE, PIVOTS, RINGS, CELL, MAX_CELLS = 8192, 64, 128, 2048, 1 << 16
#: Most rows of a group (a cell has more if there are too many rows for MAX_CELLS), and the groups that a smaller table is dealt to.
GROUP, GROUPS = 1 << 16, 64
#: Queries that one task searches a group for, those that it takes at once, and numbers in one table of bounds.
BLOCK, STEP, BOUNDS = 8192, 256, 1 << 21


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(rid, vec_id, v): a number of the row, and floor(64 * x) of each component as the bytes of 64-bit numbers; a written table."""
    x = F.col(embedding)
    good = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * 64).cast("long"))

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(r, "<i8").tobytes() for r in rows], dtype=object)

    return written(vectors.where(good).select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), packed(scaled).alias("v")))


def _matrix(rows: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        own = np.frombuffer(r, "<i8")
        out[i, : len(own)] = own
    return out


def _pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Means of clusters of the sample, after a few rounds from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(pivots, len(sample))).astype(int)].copy()
    for _ in range(6):
        nearest = (sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in np.unique(nearest):
            centres[c] = sample[nearest == c].mean(0)
    return centres


class Index:
    """Pivots, the split of rings into cells, and what is known of each cell and its group. All of bounded size."""

    def __init__(self, centres: np.ndarray, width: float, first: np.ndarray, parts: np.ndarray) -> None:
        self.centres, self.width, self.first, self.parts = centres, width, first, parts
        self.cells = pd.DataFrame()

    def ring_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, distance from it, ring."""
        far = np.sqrt(np.maximum(((x**2).sum(1)[:, None] + (self.centres**2).sum(1)) - 2 * x @ self.centres.T, 0))
        pivot = far.argmin(1)
        distance = far[np.arange(len(x)), pivot]
        return pivot, distance, np.minimum(distance / self.width, RINGS - 1).astype(int)

    def bounds(self, q: np.ndarray, cells: pd.DataFrame) -> np.ndarray:
        """(queries, cells): no vector of the cell has a larger inner product with the query."""
        centre, lo, hi, norm = self.centres[cells["pivot"]], cells["lo"].to_numpy(), cells["hi"].to_numpy(), cells["norm"].to_numpy()
        size = np.sqrt((q**2).sum(1))[:, None]
        dot = q @ centre.T
        d = np.sqrt(np.maximum(size**2 + (centre**2).sum(1) - 2 * dot, 0))
        nearest = np.maximum(np.maximum(d - hi, lo - d), 0)
        best = np.minimum((size**2 + norm**2 - nearest**2) / 2, dot + size * hi)
        return best + 1e-6 * (1 + np.abs(best) + size**2)

    def group_bounds(self, q: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Stretches of queries with (queries, groups): the best bound of each group's cells."""
        step = max(1, BOUNDS // max(len(self.cells), 1))
        first = np.flatnonzero(np.diff(self.cells["group"].to_numpy(), prepend=-1))
        for at in range(0, len(q), step):
            yield slice(at, at + step), np.maximum.reduceat(self.bounds(q[at : at + step], self.cells), first, axis=1)


def build(vectors: DataFrame, pivots: int = PIVOTS, cell: int = CELL, group: int = GROUP) -> tuple[Index, DataFrame, int]:
    """The index of a written table (rid, vec_id, v), the table with each vector's group and cell, and the vectors' length."""
    shape = vectors.agg(F.max(F.length("v")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    size, n = (shape["bytes"] or 0) // 8, shape["n"]
    sample = _matrix(bounded_sample(vectors, "rid", SAMPLE).toPandas()["v"], size)
    centres = _pivots(sample, pivots) if n else np.zeros((1, size))
    index = Index(centres, 1.0, np.zeros(0, int), np.zeros(0, int))
    index.width = max(float(index.ring_of(sample)[1].max(initial=0)) * 1.25 / RINGS, 1e-9)

    def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                pivot, _, ring = index.ring_of(_matrix(frame["v"], size))
                slot, counts = np.unique(pivot * RINGS + ring, return_counts=True)
                yield pd.DataFrame({"slot": slot, "n": counts})

    counted = vectors.select("v").mapInPandas(rings, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(len(centres) * RINGS, int)
    count[counted["slot"].to_numpy(int)] = counted["n"].to_numpy(int)
    rows = max(cell, -(-2 * n // (MAX_CELLS - len(count))))
    index.first, index.parts = np.zeros(len(count), int), np.ones(len(count), int)
    at, held = 0, 0
    for slot, c in enumerate(count.tolist()):
        if slot % RINGS == 0 or held >= rows:
            at, held = at + (held > 0), 0
        if c > rows:
            at, held = at + (held > 0), 0
            index.first[slot], index.parts[slot] = at, -(-c // rows)
            at += index.parts[slot]
        else:
            index.first[slot] = at
            held += c

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                x = _matrix(frame["v"], size)
                pivot, distance, ring = index.ring_of(x)
                slot = pivot * RINGS + ring
                spread = (frame["rid"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
                cell_of = index.first[slot] + spread % index.parts[slot]
                yield frame.assign(cell=cell_of, group=index.group[cell_of], pivot=pivot, r=distance, norm=np.sqrt((x**2).sum(1)))

    # cells' rows are known from the rings' counts; neighbours make a group
    cell_rows = np.zeros(at + 1)
    for slot in np.flatnonzero(count).tolist():
        cell_rows[index.first[slot] : index.first[slot] + index.parts[slot]] += count[slot] / index.parts[slot]
    most = min(group, max(rows, n // GROUPS))
    index.group = ((np.cumsum(cell_rows) - cell_rows) // max(most, 1)).astype(int)
    schema = "rid long, vec_id long, v binary, cell long, group long, pivot int, r double, norm double"
    table_ = written(vectors.mapInPandas(placed, schema))
    stats = table_.groupBy("group", "cell").agg(F.first("pivot").alias("pivot"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n"))
    index.cells = stats.orderBy("group", "cell").toPandas()
    return index, table_, size


def _in_group(index: Index, cells: pd.DataFrame, left: pd.DataFrame, right: pd.DataFrame, size: int, k: int) -> Iterator[pd.DataFrame]:
    """(query, query_id, vec_id, score): each query's best k in a group, but none under its own least score."""
    right = right.sort_values(["cell", "vec_id", "rid"], kind="stable")
    ids, x, of = right["vec_id"].to_numpy(), _matrix(right["v"], size), right["cell"].to_numpy()
    cells = cells[cells["cell"].isin(of)]
    starts, ends = np.searchsorted(of, cells["cell"]), np.searchsorted(of, cells["cell"], "right")
    for at in range(0, len(left), STEP):
        own = left.iloc[at : at + STEP]
        q, query, query_id, least = _matrix(own["v"], size), own["rid"].to_numpy(), own["vec_id"].to_numpy(), own["least"].to_numpy(float)
        bound = index.bounds(q, cells)
        top, found = np.full((len(q), k), -np.inf), []
        for c in np.argsort(-bound.max(0), kind="stable").tolist():  # annuli by their best bound
            asks = np.flatnonzero(bound[:, c] >= least)
            if not len(asks):
                continue
            score, name = q[asks] @ x[starts[c] : ends[c]].T, ids[starts[c] : ends[c]]
            score[query_id[asks][:, None] == name[None, :]] = -np.inf
            both = np.concatenate((top[asks], score), axis=1)
            top[asks] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            least[asks] = np.maximum(least[asks], top[asks].min(1))
            i, j = np.nonzero((score >= least[asks][:, None]) & (score > -np.inf))
            part = pd.DataFrame({"at": asks[i], "vec_id": name[j], "score": score[i, j]}).sort_values(["at", "score"], ascending=[True, False], kind="stable")
            found.append(part.groupby("at").head(k))  # of many equal scores, the k smallest ids are enough; rows are sorted by id
        if found:
            frame = pd.concat(found)
            frame = frame[frame["score"].to_numpy() >= least[frame["at"]]].sort_values(["at", "score", "vec_id"], ascending=[True, False, True], kind="stable").groupby("at").head(k)
            yield pd.DataFrame({"query": query[frame["at"]], "query_id": query_id[frame["at"]], "vec_id": frame["vec_id"].to_numpy(), "score": frame["score"].to_numpy(np.int64)})


FOUND = "query long, query_id long, vec_id long, score long"


def _search(queries: DataFrame, rows: DataFrame, index: Index, size: int, k: int) -> DataFrame:
    """FOUND of the queries (group, rid, vec_id, v, least) in the groups that they are sent to."""
    by_group = dict(iter(index.cells.groupby("group")))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_in_group(index, by_group[key[0]], left, right, size, k)) if len(left) and len(right) else []
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")}).astype("int64")

    # a group that many queries go to is searched in several tasks; there is a row for each of at most MAX_CELLS groups
    queries = written(queries)
    parts = F.broadcast(written(queries.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))))
    left = queries.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))
    right = rows.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return left.groupBy("group", "part").cogroup(right.select("group", "part", "cell", "rid", "vec_id", "v").groupBy("group", "part")).applyInPandas(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, pivots: int = PIVOTS, cell: int = CELL, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of vectors (vec_id, embedding) whose id is divisible by `every`."""
    index, rows, size = build(whole_vectors(vectors), pivots, cell, group)
    groups = index.cells["group"].unique() if len(index.cells) else np.zeros(0, int)
    asked = rows.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "v")

    def sent(frame: pd.DataFrame, further: bool) -> Iterator[pd.DataFrame]:
        """Each query under the group of its best bound, or under the further groups whose bounds reach its least score."""
        for part, best in index.group_bounds(_matrix(frame["v"], size)):
            own, home = frame.iloc[part], best.argmax(1)
            at_home = np.arange(len(groups)) == home[:, None]
            i, j = np.nonzero(~at_home & (best >= own["least"].to_numpy(float)[:, None]) if further else at_home)
            yield own.iloc[i].assign(group=groups[j])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield from sent(frame.assign(least=-np.inf), False)

    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield from sent(frame, True)

    schema = "rid long, vec_id long, v binary, least double, group long"
    first = written(_ranked(_search(asked.mapInPandas(near, schema), rows, index, size, k), k))
    least = first.where(F.col("rank") == k).select(F.col("query").alias("rid"), F.col("score").cast("double").alias("least"))
    beaten = asked.join(least, "rid", "left").select("rid", "vec_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    more = _search(beaten.mapInPandas(far, schema), rows, index, size, k)
    return _ranked(first.select("query", "query_id", "vec_id", "score").unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

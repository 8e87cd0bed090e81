"""Hard negatives by exact inner products, with several candidates in one multiplication.

Components are integers. A block's candidates are biased so that no component is negative, and the same component of several candidates is
laid into separated fields of one wide integer (Kronecker's substitution): a field is as wide as the largest sum that can stand in it, so
fields never run into each other. One multiplication by an anchor's component then multiplies all of them, the sum over components has all
their inner products, and taking the fields apart and the biases off gives exact scores. Integers are of 64 bits, or of Python's any width
where a field needs more.

1. Anchors meet the rows of their label, for their best `positives`. A label's rows are dealt over parts, so that a large label is many tasks.
2. Anchors meet all rows in blocks, for each positive's best `negatives` of other labels within the positive's band of scores.

In both, a task has a block of candidates and a block of anchors, finds each anchor's few best and nothing else leaves it; no pairs are made
by Spark. Work is anchors times rows, as the anchors are a stated set that is held against all rows.

Defined results: rows whose id, label or vector is null, or whose vector has a null or non-finite component, take no part. Vectors of
unequal lengths are padded with zeros. An anchor is not its own positive, nor are rows that share its id. Repeated rows are candidates of
their own, and repeated anchors have results of their own. Ties go to the smaller id. Without a positive, or with none in the band, an anchor
has no rows. Extra columns are ignored. Components times the scale have to lie within 2^53, and scores within 2^62.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagemill.llm.common import small_join, table, written

EVERY, POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 50, 5, 3, 50, 95, 256
#: Candidates and anchors of a task, at most; tasks that a smaller table is dealt over; scores that a task has at once.
ROWS, ANCHORS, TASKS, AT_ONCE = 1 << 16, 1 << 13, 64, 1 << 21
#: Fields of an integer that is wider than 64 bits.
WIDE = 8
_LOWEST = -(1 << 62)


class Fields:
    """Candidates' components in the fields of wide integers."""

    def __init__(self, rows: np.ndarray, reach: int) -> None:
        """rows: (candidates, components); reach: the largest component of a biased anchor."""
        self.n, self.size = rows.shape
        self.bias = max(-int(rows.min(initial=0)), 0)
        lifted = rows + self.bias
        self.width = max((self.size * reach * int(lifted.max(initial=0))).bit_length(), 1)
        self.fields = 64 // self.width or WIDE
        kind = np.uint64 if self.width <= 64 else object
        self.own = lifted.sum(axis=1, dtype=None if kind is np.uint64 else object)
        many = -(-self.n // self.fields)
        padded = np.zeros((many * self.fields, self.size), kind)
        padded[: self.n] = lifted.astype(kind)
        self.packed = np.zeros((self.size, many), kind)
        for k in range(self.fields):
            self.packed += padded[k * many : (k + 1) * many].T << self._shift(k)

    def _shift(self, field: int):
        return np.uint64(field * self.width) if self.width <= 64 else field * self.width

    def scores(self, anchors: np.ndarray, bias: int) -> np.ndarray:
        """(anchors, candidates): exact inner products; bias is what lifts all anchors' components above 0."""
        lifted = (anchors + bias).astype(self.packed.dtype)
        sums = lifted @ self.packed
        mask = np.uint64((1 << self.width) - 1) if self.width <= 64 else (1 << self.width) - 1
        apart = np.concatenate([sums >> self._shift(k) & mask for k in range(self.fields)], axis=1)[:, : self.n]
        exact = apart.astype(np.int64 if self.width < 62 else object)
        exact = exact - self.bias * lifted.sum(axis=1).astype(exact.dtype)[:, None] - bias * self.own.astype(exact.dtype)[None, :] + self.size * bias * self.bias
        if len(exact) and self.n and max(-exact.min(), exact.max()) >= -_LOWEST:
            raise ValueError("scores have to lie within 2^62")
        return exact.astype(np.int64)


def whole_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(rid, vec_id, label, v): a number of the row, and floor(scale * x) of each component as the bytes of 64-bit numbers; a written table."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(r, "<i8").tobytes() for r in rows], dtype=object)

    return written(vectors.where(good).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), "label", packed(scaled).alias("v")))


def _matrix(rows: pd.Series, size: int) -> np.ndarray:
    out = np.zeros((len(rows), size), np.int64)
    for i, r in enumerate(rows):
        own = np.frombuffer(r, "<i8")
        out[i, : len(own)] = own
    return out


def _stretches(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Stretches of anchors with their scores against all candidates."""
    size = max(len(r) // 8 for r in [*left["v"], *right["v"]])
    anchors = _matrix(left["v"], size)
    bias = max(-int(anchors.min(initial=0)), 0)
    fields, step = Fields(_matrix(right["v"], size), int(anchors.max(initial=0)) + bias), max(1, AT_ONCE // len(right))
    for at in range(0, len(left), step):
        yield left.iloc[at : at + step], fields.scores(anchors[at : at + step], bias)


def _best(scores: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (sorted by id) of each anchor that are taken, best first, then all others; with their scores."""
    scores = np.where(taken, scores, _LOWEST)
    order = np.argsort(-scores, axis=1, kind="stable")
    return order, np.take_along_axis(scores, order, axis=1)


def _in_label(left: pd.DataFrame, right: pd.DataFrame, positives: int) -> Iterator[pd.DataFrame]:
    ids = right["vec_id"].to_numpy()
    for own, scores in _stretches(left, right):
        order, best = _best(scores, own["vec_id"].to_numpy()[:, None] != ids[None, :])
        i, j = np.nonzero(best[:, :positives] > _LOWEST)
        yield pd.DataFrame({"rid": own["rid"].to_numpy()[i], "id": ids[order[i, j]], "score": best[i, j]})


def _in_band(left: pd.DataFrame, right: pd.DataFrame, negatives: int, low: int, high: int) -> Iterator[pd.DataFrame]:
    ids, labels = right["vec_id"].to_numpy(), right["label"].to_numpy()
    for own, scores in _stretches(left, right):
        order, best = _best(scores, own["label"].to_numpy()[:, None] != labels[None, :])
        most = max(map(len, own["bands"]))
        bands = np.array([[*b, *[_LOWEST] * (most - len(b))] for b in own["bands"]], np.int64).reshape(len(own), most)
        for p in range(most):
            score = bands[:, p].tolist()
            least, cap = (np.array([_LOWEST + 1 if s == _LOWEST else f(s) for s in score]) for f in (lambda s: -(-low * s // 100), lambda s: high * s // 100))
            at = (best > cap[:, None]).sum(axis=1)[:, None] + np.arange(negatives)
            found = np.take_along_axis(best, np.minimum(at, len(ids) - 1), axis=1)
            i, j = np.nonzero((at < len(ids)) & (found >= least[:, None]) & (found > _LOWEST) & (bands[:, p] > _LOWEST)[:, None])
            yield pd.DataFrame({"rid": own["rid"].to_numpy()[i], "place": p + 1, "id": ids[order[i, at[i, j]]], "score": found[i, j]})


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str], find: Callable[..., Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What `find` finds in the tasks of anchors (with columns parts, crowds) and rows (the same) of equal keys."""
    part, crowd = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("rid", F.lit("anchor")), F.col("crowds")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = anchors.select(*[F.col(c).alias(c) for c in anchors.columns], crowd.alias("crowd"), each("parts").alias("part"))
    right = rows.select("*", part.alias("part"), each("crowds").alias("crowd"))

    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(find(left, right.sort_values(["vec_id", "rid"], kind="stable"))) if len(left) and len(right) else []
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: np.zeros(0, np.int64) for c in schema.split(", ")})

    by = [*keys, "part", "crowd"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(of, schema)


def _first(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    return found.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col(rank) <= k)


def hard_negatives(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, rows: int = ROWS, anchors: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors (vec_id, embedding, label).

    Anchors are the rows whose id is divisible by `every`. Negatives score between `low` and `high` hundredths of their positive.
    """
    whole = whole_rows(vectors, scale)
    asks = F.col("vec_id") % every == 0
    labels = written(whole.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("asking")))
    total = labels.agg(F.sum("n").alias("n"), F.sum("asking").alias("asking")).first()
    if not total["asking"]:
        return whole.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    most = max(1, min(rows, -(-total["n"] // TASKS)))
    parts = lambda n, most: F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    dealt = labels.where("asking > 0").select("label", parts(F.col("n"), most).alias("parts"), parts(F.col("asking"), anchors).alias("crowds"))

    same = small_join(whole, dealt, ["label"], "inner")
    found = _meet(same.where(asks), same, ["label"], lambda left, right: _in_label(left, right, positives), "rid long, id long, score long")
    best = written(_first(found, ["rid"], positives, "place"))
    bands = best.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda p: p["score"]).alias("bands"))
    dealt_all = {"parts": F.lit(-(-total["n"] // most)), "crowds": F.lit(-(-total["asking"] // anchors))}
    near = _meet(
        whole.where(asks).join(bands, "rid").withColumns(dealt_all), whole.withColumns(dealt_all), [], lambda left, right: _in_band(left, right, negatives, low, high), "rid long, place int, id long, score long"
    )
    of = best.select("rid", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = whole.where(asks).select("rid", F.col("vec_id").alias("anchor_id"))
    out = _first(near, ["rid", "place"], negatives, "rank").join(of, ["rid", "place"]).join(named, "rid")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT a.rid, a.vec_id AS anchor_id, a.label, a.e, c.vec_id AS positive_id, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS positive_score,
    row_number() OVER (PARTITION BY a.rid ORDER BY list_dot_product(a.e, c.e) DESC, c.vec_id) AS place
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.label = a.label AND c.vec_id <> a.vec_id
  QUALIFY place <= 5
), s AS (
  SELECT p.rid, p.place, p.anchor_id, p.positive_id, p.positive_score, c.vec_id AS negative_id, CAST(list_dot_product(p.e, c.e) AS BIGINT) AS negative_score
  FROM p JOIN v c ON c.label <> p.label
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid, place ORDER BY negative_score DESC, negative_id) AS rank
  FROM s WHERE 50 * positive_score <= 100 * negative_score AND 100 * negative_score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""

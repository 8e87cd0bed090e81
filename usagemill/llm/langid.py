"""Language identification by nearest centroid.

A text's n-grams (two and three bytes of its lower-case words in UTF-8, edges included) are hashed to DIMENSIONS, weighted by TF-IDF and normalised. Document
frequencies are counted over all learned documents. Each language has several centroids, found by clustering a sample of at most about
SAMPLE of its documents with cosine k-means in a task of its own. A text takes the language of the centroid with the largest
cosine, which is its score. It is rejected (column `accepted` of `identified`) if that cosine is under the language's limit, which is taken
from the distances of the sample to its own centroids.

Defined results: a null text, or one without a letter, is `und` with score 0 and is never learned from. So is every text if nothing could be
learned. Null langs aren't learned. Repeated rows come back as often as they went in. A null doc_id is neither learned nor held out. Extra
columns pass through `identified`, which refuses a table that has a column of the names that it adds; they are parameters. Ties go to the
language first in order. An empty table gives an empty result. The centroids, 64 kB a learned language, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm.common import small_join, table, written

DIMENSIONS = 4096
#: Bounds of the clustering: documents of a language, clusters, rounds.
SAMPLE, CLUSTERS, ROUNDS = 600, 4, 8
UNKNOWN = "und"
#: Bytes of ASCII other than letters part words.
_WORDS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def slots(text: str) -> np.ndarray:
    """The hashed n-grams of a text, repeats included."""
    words = b" ".join(text.lower().encode("utf-8", "replace").translate(_WORDS).split())
    data = np.frombuffer(b" " + words + b" ", np.uint8).astype(np.uint32)
    two = data[:-1] * np.uint32(257) + data[1:]
    three = two[:-1] * np.uint32(263) + data[2:] + np.uint32(1 << 20)
    return np.concatenate((two, three)) * np.uint32(2654435761) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, a row for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        out[i] = np.bincount(slots(t), minlength=DIMENSIONS)
    out = np.log1p(out) * idf
    return out / np.maximum(np.sqrt((out**2).sum(1)), 1e-9)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def inverse_frequencies(learned: DataFrame) -> np.ndarray:
    """IDF of each dimension over all rows of learned (text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for t in batch["text"]:
                found += np.bincount(slots(t), minlength=DIMENSIONS) > 0
            rows += len(batch)
        yield pd.DataFrame({"slot": np.arange(-1, DIMENSIONS), "n": np.append([rows], found)})

    sums = learned.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIMENSIONS + 1, np.int64)
    n[sums["slot"].to_numpy(int) + 1] = sums["n"].to_numpy(int)
    return (np.log((1 + n[0]) / (1 + n[1:])) + 0.05).astype(np.float32)


def _clusters(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit centroids of unit vectors, and the cosine under which one in two hundred of them lies."""
    centres = x[np.linspace(0, len(x) - 1, min(CLUSTERS, len(x))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(1)
        centres = np.stack([x[nearest == c].sum(0) if (nearest == c).any() else centres[c] for c in range(len(centres))])
        centres = centres / np.maximum(np.sqrt((centres**2).sum(1)), 1e-9)[:, None]
    return centres, float(np.quantile((x @ centres.T).max(1), 0.005))


class Centroids:
    """Languages' centroids and limits."""

    def __init__(self, idf: np.ndarray, rows: pd.DataFrame) -> None:
        rows = rows.sort_values(["lang", "cluster"], kind="stable")
        self.idf, self.langs = idf, rows["lang"].tolist()
        self.centres = np.frombuffer(b"".join(rows["centre"]), np.float32).reshape(-1, DIMENSIONS)
        self.limits = rows["limit"].to_numpy(float)

    def nearest(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it reaches the language's limit."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        cosine = np.concatenate([vectors(texts[i : i + 256], self.idf) @ self.centres.T for i in range(0, len(texts), 256)])
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        return [self.langs[b] for b in best], score, score >= self.limits[best]


def learn(learned: DataFrame, sample: int = SAMPLE) -> Centroids:
    """Centroids of learned (doc_id, text, lang), which has neither nulls nor texts without a letter."""
    idf = inverse_frequencies(learned)
    counts = written(learned.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 52)) / F.lit(float(1 << 52)) * F.col("rows") < sample

    def cluster(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"], kind="stable")
        centres, limit = _clusters(vectors(frame["text"].tolist(), idf))
        return pd.DataFrame({"lang": key[0], "cluster": range(len(centres)), "centre": [c.astype(np.float32).tobytes() for c in centres], "limit": limit})

    chosen = small_join(learned, counts, ["lang"]).where(share | (F.col("rows") <= sample)).select("doc_id", "text", "lang")
    return Centroids(idf, chosen.groupBy("lang").applyInPandas(cluster, "lang string, cluster int, centre binary, limit double").toPandas())


def identified(docs: DataFrame, centroids: Centroids, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """docs with the language, its cosine and whether that is near enough, under names."""
    taken = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"docs already have the columns {sorted(taken)}; give other names")

    @F.pandas_udf("lang string, score double, accepted boolean")
    def identify(texts: pd.Series, letters: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"lang": pd.Series([UNKNOWN] * len(texts), dtype=object), "score": 0.0, "accepted": False})
        some = np.flatnonzero(letters.to_numpy(bool))
        langs, score, near = centroids.nearest([texts.iloc[i] for i in some])
        for column, values in (("lang", langs), ("score", score), ("accepted", near)):
            out.loc[some, column] = values
        return out

    own = next(n for i in range(len(docs.columns) + 1) if (n := f"_lang{i}") not in docs.columns)
    judged = docs.withColumn(own, identify(F.col(text), has_letter(F.col(text))))
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{own}.{c}").alias(n) for c, n in zip(("lang", "score", "accepted"), names, strict=True)])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    learned = docs.where((part != 1) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    centroids = learn(learned)
    held_out = F.coalesce(part == 1, F.lit(False)).alias("held_out")
    return identified(docs.select("doc_id", "text"), centroids).select("doc_id", held_out, "lang_pred", "score", "accepted")

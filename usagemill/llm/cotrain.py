"""Quality classifier by co-training of two views of a document: its text and its metadata.

Each view has a logistic regression of its own, first fitted on a bounded sample of labelled documents. In each round both score all
unlabelled documents that haven't been handed over yet, and each hands the other the ones of which it is surest, by rank and in the
classes' shares among the labels, as pseudo-labels. Their number is a share of the labelled sample (PICK_SHARE). A part of the sample is
never fitted; on it each view is calibrated, and a view whose picks raise the other's loss there by more than TOLERANCE is not listened
to: the other one drops these picks and takes no more from it. At last the views' calibrated log-odds are weighed against each other by
weights that aren't negative, and the result scores every document. `Views.rounds` says what was handed over.

Only the labelled sample (at most `sample` rows) and the picks reach the driver. Texts are read once: their features, about 180 bytes a
document, are written beside the rows; each round reads the features once, and so do the final scores.

Defined results: null text counts as empty; null lang, source or n_chars is a value of its own. Repeated rows come back as often as
they went in; rows without a doc_id are scored but neither learned from nor handed over. With no labels, or labels of one class, every
document scores that class's share (1 without labels) and is kept. Extra columns pass through `scored` and `judged`; a column that has
the name of the score is replaced. Ties in sureness go to the smaller doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagemill.llm.common import bounded_sample, table, written

#: Bound of the labelled sample, rounds, picks of a view and round for each fitted row, weight of a pseudo-label, the score from which a document stays.
SAMPLE, ROUNDS, PICK_SHARE, PSEUDO_WEIGHT, KEEP_FROM = 20_000, 2, 0.05, 0.5, 0.4
#: By how much a view's picks may raise the other view's held-out loss.
TOLERANCE = 0.005

#: Partitions over which the best picks of all others are gathered.
GATHERED = 32
_MARKS = b".,;:!?'\"()-|#*$%&<>/"
_BUCKETS = 64
TEXT_SIZE = 12 + len(_MARKS) + _BUCKETS
_SOURCES, _LANGS, _SIZES, _CROSSED = 64, 16, 24, 96
META_SIZE = 2 + _SOURCES + _LANGS + _SIZES + 3 * _CROSSED


def text_features(text: str | None) -> np.ndarray:
    """What a text's characters, words and lines are like, each within about 0 to 10."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(TEXT_SIZE, np.float32)
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    count = np.bincount(data, minlength=256)
    words = raw.split()
    often = Counter(words)
    n, chars = max(len(words), 1), max(len(data) - int(count[9:14].sum()) - int(count[32]), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = Counter(zip(words, words[1:], strict=False))
    out[:12] = (
        1,
        np.log1p(len(words)),
        chars / n / 3,
        4 * count[65:91].sum() / chars,
        8 * count[48:58].sum() / chars,
        4 * (count[128:].sum()) / chars,
        6 * len(often) / n,
        6 * max(often.values(), default=0) / n,
        6 * len(pairs) / max(len(words) - 1, 1),
        6 * (1 - len(set(lines)) / max(len(lines), 1)),
        np.log1p(n / max(len(lines), 1)),
        2 * np.log1p(max(map(len, words), default=0)),
    )
    out[12 : 12 + len(_MARKS)] = np.minimum(5 * count[list(_MARKS)] / n, 10)
    two = (data[:-1].astype(np.uint32) * 31 + data[1:]) * np.uint32(2654435761) >> np.uint32(26)
    out[12 + len(_MARKS) :] = np.minimum(np.sqrt(np.bincount(two, minlength=_BUCKETS) / max(len(two), 1)) * 4, 10)
    return out


def _slot(value: object, slots: int) -> int:
    return 0 if value is None or value != value else 1 + zlib.crc32(str(value).encode()) % (slots - 1)


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Language and source by hashed slots, the stated length by steps, and each two of them together."""
    out = np.zeros((len(lang), META_SIZE), np.float32)
    for i, (x, y, z) in enumerate(zip(lang, source, n_chars, strict=True)):
        size = np.log1p(max(float(z), 0)) if z is not None and z == z else 0.0
        step = min(int(size * 1.5), _SIZES - 1)
        out[i, 0], out[i, 1] = 1, size / 3
        at = 2
        for place, slots in ((_slot(y, _SOURCES), _SOURCES), (_slot(x, _LANGS), _LANGS), (step, _SIZES)):
            out[i, at + place] = 1
            at += slots
        for pair in ((x, y), (x, step), (y, step)):
            out[i, at + _slot(pair, _CROSSED)] = 1
            at += _CROSSED
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression with a quadratic penalty, by Newton steps; `weight` is each row's."""
    w = np.zeros(x.shape[1])
    x = x.astype(np.float64)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ ((p - y) * weight) + penalty * w
        curve = (x * (np.maximum(p * (1 - p), 1e-6) * weight)[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Views:
    """The two fitted views, their calibration (slope, offset) and how their calibrated log-odds are added up."""

    weights: list[np.ndarray]
    scales: list[np.ndarray]
    both: np.ndarray
    prior: float | None = None
    #: The log-odds of each view that part the classes in their shares among the labels.
    middle: list[float] = field(default_factory=list)
    rounds: list[dict] = field(default_factory=list)

    def odds(self, text: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
        return [np.clip(x @ w * scale[0] + scale[1], -12, 12) for x, w, scale in zip((text, meta), self.weights, self.scales, strict=True)]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(text), self.prior)
        a, b = self.odds(text, meta)
        return _logistic(a * self.both[0] + b * self.both[1] + self.both[2])


def loss(odds: np.ndarray, y: np.ndarray) -> float:
    """Mean logarithmic loss."""
    return float(np.mean(np.logaddexp(0, odds) - y * odds))


def _calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = np.clip(x @ w, -12, 12)
    return fit_logistic(np.stack([z, np.ones_like(z)], 1), y, 1e-2)


def _weighed(a: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the two views' log-odds and an offset; a view whose weight would be negative has none."""
    columns = np.stack([a, b, np.ones_like(a)], 1)
    out = fit_logistic(columns, y, 1e-1)
    if (out[:2] < 0).any():
        used = np.array([out[0] > 0, out[1] > 0, True])
        if not used[:2].any():
            used[int(loss(b, y) < loss(a, y))] = True
        out = np.zeros(3)
        out[used] = fit_logistic(columns[:, used], y, 1e-1)
    return out


META = ["lang", "source", "n_chars"]


def featured(docs: DataFrame, features: str = "features", texts: bool = True) -> DataFrame:
    """docs with the features of their texts, as a written table, which leaves the texts out if they aren't needed."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t).astype(np.float16).tobytes() for t in texts], dtype=object)

    out = docs.withColumn(features, of(F.col("text")))
    return written(out if texts else out.drop("text"))


def _typed(pool: DataFrame, features: str) -> list[Column]:
    return [F.col(features).alias("features"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double")]


def _arrays(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.frombuffer(b"".join(frame["features"]), np.float16).reshape(len(frame), TEXT_SIZE).astype(np.float32)
    return text, meta_features(*(frame[c].tolist() for c in META))


def _best(frame: pd.DataFrame, wanted: tuple[int, int]) -> pd.DataFrame:
    """Of each view and class, the `wanted` documents of which it is surest."""
    frame = frame.sort_values(["by", "label", "odds", "doc_id"], ascending=[True, True, False, True], kind="stable").drop_duplicates(["by", "label", "doc_id"])
    return frame[frame.groupby(["by", "label"]).cumcount() < np.array(wanted)[frame["label"].to_numpy(int)]]


def _picks(rows: DataFrame, views: Views, taken: np.ndarray, wanted: tuple[int, int]) -> pd.DataFrame:
    """(by, label, doc_id, features and metadata): what each view (0 text, 1 metadata) hands over; a document both would hand over is the text view's."""

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for frame in frames:
            if len(frame):
                held = _best(pd.concat([held, frame]), wanted)
        if len(held):
            yield held

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def by_view() -> Iterator[pd.DataFrame]:
            for frame in batches:
                frame = frame[~np.isin(frame["doc_id"].to_numpy(), taken)]
                if len(frame):
                    for by, odds in enumerate(views.odds(*_arrays(frame))):
                        yield frame.assign(by=by, label=(odds > views.middle[by]).astype("int32"), odds=np.abs(odds - views.middle[by]))

        yield from best(by_view())

    schema = "doc_id long, features binary, lang string, source string, n_chars double, label int, by int, odds double"
    # the best of each partition, then of each of a few, so that what the driver gathers doesn't grow with the partitions
    kept = written(rows.where("label IS NULL").mapInPandas(choose, schema).repartition(GATHERED, "doc_id").mapInPandas(best, schema))
    order = [F.desc("odds"), F.col("doc_id")]
    parts = [kept.where((F.col("by") == by) & (F.col("label") == y)).orderBy(*order).limit(wanted[y]) for by in (0, 1) for y in (0, 1)]
    found = reduce(DataFrame.unionByName, parts).toPandas()
    return found.sort_values(["by", "label", "odds", "doc_id"], ascending=[True, True, False, True], kind="stable").drop_duplicates("doc_id")


class Learner:
    """What the driver holds: the labelled sample and the picks. Rows come in a fixed order."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> None:
        self.sides, self.y = (text, meta), y
        held = np.arange(len(y)) % 4 == 0
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.ones(len(y), bool)
        self.held, fit = held, ~held if not held.all() else held
        self.own = [[(side[fit], y[fit], np.ones(fit.sum()))] for side in self.sides]
        self.n, self.share = int(fit.sum()), float(y[fit].mean())
        self.heard = [True, True]

    def wanted(self, pick_share: float) -> tuple[int, int]:
        """Picks of a view and round of each class: a share of the fitted rows, at least one."""
        return tuple(max(1, round(pick_share * self.n * s)) for s in (1 - self.share, self.share))

    def fit(self, view: int, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, float]:
        """Weights and calibration of a view by rows, and its loss on the held-out part."""
        x, y, weight = (np.concatenate(part) for part in zip(*rows, strict=True))
        w = fit_logistic(x, y, weight=weight)
        own, goal = self.sides[view][self.held], self.y[self.held]
        scale = _calibrated(own, goal, w)
        return w, scale, loss(np.clip(own @ w * scale[0] + scale[1], -12, 12), goal)

    def views(self) -> Views:
        fitted = [self.fit(v, self.own[v]) for v in (0, 1)]
        self.losses = [x[2] for x in fitted]
        out = Views([x[0] for x in fitted], [x[1] for x in fitted], np.zeros(3))
        a, b = out.odds(*(side[self.held] for side in self.sides))
        out.both = _weighed(a, b, self.y[self.held])
        out.middle = [float(np.quantile(o, 1 - self.share)) for o in (a, b)]
        return out

    def hand_over(self, by: int, text: np.ndarray, meta: np.ndarray, labels: np.ndarray) -> bool:
        """Adds the picks of view `by` to the other's rows, unless that raises its loss."""
        to = 1 - by
        rows = (text, meta)[to], labels.astype(float), np.full(len(labels), PSEUDO_WEIGHT)
        if self.heard[by] and len(labels) and self.fit(to, [*self.own[to], rows])[2] <= self.losses[to] + TOLERANCE:
            self.own[to].append(rows)
            return True
        self.heard[by] = self.heard[by] and not len(labels)
        return False


def train_on(pool: DataFrame, labels: DataFrame, features: str = "features", sample: int = SAMPLE, rounds: int = ROUNDS, pick_share: float = PICK_SHARE) -> Views:
    """Views co-trained on a table of `featured` and labels (doc_id, quality)."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    rows = written(pool.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), *_typed(pool, features)).join(known, "doc_id", "left"))
    chosen = bounded_sample(rows.where("label IS NOT NULL"), "doc_id", sample).toPandas()
    y = chosen["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return Views([], [], np.zeros(3), float(y.mean()) if len(y) else 1.0)
    learner = Learner(*_arrays(chosen), y)
    views, done, taken = learner.views(), [], np.zeros(0, np.int64)
    for _ in range(rounds):
        found = _picks(rows, views, taken, learner.wanted(pick_share))
        if not len(found):
            break
        parts = [found[found["by"] == by] for by in (0, 1)]
        heard = [learner.hand_over(by, *_arrays(part), part["label"].to_numpy()) if len(part) else False for by, part in enumerate(parts)]
        taken = np.append(taken, found["doc_id"].to_numpy(np.int64))
        views = learner.views()
        done.append({"picked": [part["doc_id"].tolist() for part in parts], "heard": heard, "losses": list(learner.losses)})
    views.rounds = done
    return views


def train(docs: DataFrame, labels: DataFrame, **how) -> Views:
    """Views co-trained on docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality)."""
    return train_on(featured(docs.select("doc_id", "text", *META), texts=False), labels, **how)


def _scored(docs: DataFrame, views: Views, score: str, features: str | None = None) -> DataFrame:
    @F.pandas_udf("double")
    def judge(own: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.Series:
        if features is None:
            own = pd.Series([text_features(t).astype(np.float16).tobytes() for t in own], dtype=object)
        return pd.Series(views.scores(*_arrays(pd.DataFrame({"features": own, "lang": lang, "source": source, "n_chars": n_chars}))))

    return docs.withColumn(score, judge(F.col(features or "text"), *_typed(docs, features or "text")[1:]))


def scored(docs: DataFrame, views: Views, score: str = "score") -> DataFrame:
    """docs, which needn't be those that were learned from, with the column `score`: each document's probability of good quality."""
    return _scored(docs, views, score)


def _free(columns: list[str], name: str) -> str:
    return next(n for i in range(len(columns) + 1) if (n := f"{name}{i}") not in columns)


def judged(docs: DataFrame, labels: DataFrame, score: str = "score", carried: list[str] | None = None, **how) -> DataFrame:
    """docs, or their carried columns, with `score` by views that are co-trained on them. Each text is read once."""
    features = _free(docs.columns, "_features")
    pool = featured(docs, features, texts=carried is None or "text" in carried)
    return _scored(pool, train_on(pool, labels, features, **how), score, features).select(*[F.col(f"`{c}`") for c in (carried or docs.columns) if c != score], score)


def kept(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of docs that score at least keep_from, with docs' columns."""
    name = _free(docs.columns, "_score")
    return judged(docs, labels, name).where(F.col(name) >= keep_from).drop(name)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *META)
    out = judged(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), carried=["doc_id"])
    return out.select("doc_id", "score", (F.col("score") >= KEEP_FROM).alias("kept"))

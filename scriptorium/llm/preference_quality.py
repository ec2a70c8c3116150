"""Document quality by Bradley-Terry ranking of preference pairs.

A document labelled good is preferred to one labelled bad. Weights maximise the logistic
likelihood of such pairs on feature differences. The threshold is a quantile of the training
scores: the level at which the two classes are told apart best, of equally good levels the
one in the widest gap. Scores are mapped to 0..1 so that the threshold lies at CUT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, slices

CUT = 0.3
#: Labelled rows of each class that the fit may use, and preference pairs drawn from them.
MOST_LABELLED = 3_000
MOST_PAIRS = 60_000
FEATURES = ("symbols", "capitals", "shouts", "distinct", "doubled", "repeated_lines", "digits", "word_length", "log_words", "top_word", "commas", "wide", "no_words")


def features(text: str | None) -> list[float]:
    """Numbers that describe a text; none of them names its language, source or id."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    per_word = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    letters = sum(map(len, words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        per_word(b"#*$%&|<>"),
        per_word(bytes(range(65, 91))) * n / letters,
        per_word(b"!?"),
        len(counts) / n ** 0.8,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        per_word(b"0123456789") * n / letters,
        min(letters / n, 40.0) / 10,
        np.log1p(n) / 10,
        max(counts.values()) / (n + 20),
        per_word(b",.;:"),
        per_word(bytes(range(128, 256))) * n / letters,
        0.0,
    ]


@dataclass(frozen=True)
class Ranking:
    """Fitted weights; `point` is the raw score at the threshold, the training scores' quantile of `level`; `spread` is its scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    level: float
    point: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale / 3) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.raw(x) - self.point) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ranking(good: np.ndarray, bad: np.ndarray, seed: int = 5, penalty: float = 1e-3) -> Ranking:
    """Fit by Newton steps on at most MOST_PAIRS pairs of a good and a bad row."""
    both = np.concatenate([good, bad])
    mean, scale = np.median(both, axis=0), both.std(axis=0) + 1e-3
    flat = lambda x: np.tanh((x - mean) / scale / 3)
    rng = np.random.default_rng(seed)
    pairs = min(MOST_PAIRS, len(good) * len(bad))
    differ = flat(good)[rng.integers(0, len(good), pairs)] - flat(bad)[rng.integers(0, len(bad), pairs)]
    w = np.zeros(differ.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(differ @ w, -30, 30)))
        gradient = differ.T @ (1 - p) / pairs - penalty * w
        curve = (differ * (p * (1 - p))[:, None]).T @ differ / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + step * min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    up, down = flat(good) @ w, flat(bad) @ w
    scores = np.sort(np.concatenate([up, down]))
    cuts = (scores[1:] + scores[:-1]) / 2
    right = 1 - np.searchsorted(np.sort(up), cuts) / len(up) + np.searchsorted(np.sort(down), cuts) / len(down)
    best = int(np.where(right >= right.max() - 1e-12, np.diff(scores), -1.0).argmax())
    level = (best + 0.5) / (len(scores) - 1)
    return Ranking(mean, scale, w, level, float(np.quantile(scores, level)), float(scores.std() / 2 + 1e-6))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """quality and features of at most `most` labelled documents of each class, chosen by hash.

    Rows held out (crc32 of the id modulo 5 is 0), null labels and labels without a
    document are not used. An id labelled both ways counts once as each; of rows that share
    an id one stands for all.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & (crc_fold("doc_id", 5) != 0)).distinct()
    present = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for quality in (0, 1):
        part = present.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * most rows, so every task may hold them
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    return joined.mapInArrow(_features, "doc_id long, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))


def learn_ranking(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Ranking | None:
    """The ranking fitted to a bounded sample of labelled rows; None without both classes."""
    rows = training_rows(docs, labels, most).orderBy("doc_id", "quality").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    q = rows["quality"].to_numpy()
    if not (q == 1).any() or not (q == 0).any():
        return None
    return fit_ranking(x[q == 1], x[q == 0])


def _scores(batch: pa.RecordBatch, ranking: Ranking | None) -> np.ndarray:
    texts = batch.column("text").to_pylist()
    if ranking is None:
        return np.full(len(texts), 0.5)
    return ranking.score(np.array([features(t) for t in texts], dtype=float).reshape(-1, len(FEATURES)))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts are scored as texts without words, texts of any length whole.
    Without labels of both classes every score is 0.5. A score equal to CUT counts as good.
    held_out is false for a null doc_id. Extra columns are ignored, rows repeat as they come
    and an empty table gives an empty result.
    """
    ranking = learn_ranking(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([batch.column("doc_id"), pa.array(_scores(batch, ranking))], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score CUT or more, with all their columns; the same cases as score_documents."""
    ranking = learn_ranking(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(batch, ranking) >= CUT))

    return docs.mapInArrow(run, docs.schema)

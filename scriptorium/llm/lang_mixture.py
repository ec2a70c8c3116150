"""Language proportions of each document by expectation-maximisation.

Every language gets smoothed probabilities of hashed byte trigrams of lower-cased text.
A document is cut into stretches of words; the log-likelihood of each stretch under each
language is a sum of trigram terms, and EM estimates the proportions of the languages that
generated the stretches. Starting from all languages, the weakest is dropped as long as
the penalised likelihood (BIC) does not fall; what remains is the language set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

SLOTS = 1 << 15
#: Trigrams of one stretch.
STRETCH = 96
ROUNDS = 12
#: Likelihood of a stretch is tempered: neighbouring trigrams overlap.
TEMPER = 0.5


def _lower(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _grams(raw: np.ndarray) -> np.ndarray:
    """Slots of the trigrams that begin at each of the first n - 2 bytes; digits and ASCII signs count as blanks."""
    a = _CLASS[raw].astype(np.uint32)
    h = a[:-2] * np.uint32(961_748_927) + a[1:-1] * np.uint32(15_485_863) + a[2:] * np.uint32(179_424_673)
    return (h ^ (h >> np.uint32(15))) & np.uint32(SLOTS - 1)


_CLASS = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            raw = np.frombuffer(_lower(text), dtype=np.uint8)
            if len(raw) < 3:
                continue
            here = counts.setdefault(lang, np.zeros(SLOTS, dtype=np.int64))
            here += np.bincount(_grams(raw), minlength=SLOTS)
    for lang, here in counts.items():
        used = np.flatnonzero(here)
        yield pa.record_batch([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(here[used], pa.int64())], names=["lang", "slot", "n"])


class Languages:
    """Names and the log-probability table [slot, language]."""

    def __init__(self, rows):
        self.names = sorted(set(rows["lang"].tolist()))
        counts = np.full((SLOTS, len(self.names)), 0.5)
        where = {name: k for k, name in enumerate(self.names)}
        np.add.at(counts, (rows["slot"].to_numpy(dtype=np.int64), rows["lang"].map(where).to_numpy(dtype=np.int64)), rows["n"].to_numpy(dtype=float))
        self.table = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        if self.names:
            self.table -= self.table.mean(axis=1, keepdims=True)


def learn_languages(docs: DataFrame) -> Languages:
    """Trigram counts of each language over all rows of docs with a text and a language.

    The driver gets at most SLOTS rows for each distinct language name.
    """
    known = docs.select(F.col("text").cast("string").alias("text"), "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    return Languages(known.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas())


def mixture(texts: list[str | None], model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [text, language] and whether a text could be judged (it has a letter)."""
    k = len(model.names)
    share = np.zeros((len(texts), k))
    judged = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool) if texts else np.zeros(0, dtype=bool)
    if not k or not judged.any():
        return share, judged & (k > 0)
    which = np.flatnonzero(judged)
    blobs = [b"  " + _lower(texts[i]) + b"  " for i in which]
    sizes = np.array([len(b) for b in blobs]) - 2
    raw = np.frombuffer(b"".join(blobs), dtype=np.uint8)
    ends = np.cumsum(sizes + 2)
    pieces = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(which)), pieces)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (ends - sizes - 2)[owner] + inside * STRETCH
    grams = _grams(raw)
    # the two positions that straddle a pair of texts add nothing
    valid = np.ones(len(grams), dtype=bool)
    straddle = np.concatenate([ends[:-1] - 2, ends[:-1] - 1])
    valid[straddle] = False
    score = np.zeros((len(owner), k))
    for j in range(k):
        score[:, j] = np.add.reduceat(np.where(valid, model.table[:, j][grams], 0), begin)
    score *= TEMPER
    score -= score.max(axis=1, keepdims=True)
    like = np.exp(score)
    first = np.cumsum(pieces) - pieces
    alive = np.ones((len(which), k), dtype=bool)

    def run(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        theta = alive / alive.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            resp = like * theta[owner]
            resp /= resp.sum(axis=1, keepdims=True) + 1e-300
            theta = np.add.reduceat(resp, first, axis=0) / pieces[:, None]
        total = np.log((like * theta[owner]).sum(axis=1) + 1e-300)
        return theta, np.add.reduceat(total, first)

    theta, fit = run(alive)
    penalty = 0.5 * np.log(pieces + 1.0) + 1.0
    for _ in range(k - 1):
        weakest = np.where(alive, theta, 2.0).argmin(axis=1)
        fewer = alive.copy()
        fewer[np.arange(len(which)), weakest] = False
        possible = fewer.any(axis=1)
        fewer[~possible] = alive[~possible]
        theta2, fit2 = run(fewer)
        better = possible & (fit2 + penalty >= fit)
        alive[better], theta[better], fit[better] = fewer[better], theta2[better], fit2[better]
        if not better.any():
            break
    share[which] = theta
    return share, judged


def _infer(batches: Iterator[pa.RecordBatch], model: Languages) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.names, "und"], dtype=object)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            share, judged = mixture(part.column("text").to_pylist(), model)
            best = np.where(judged, share.argmax(axis=1) if share.shape[1] else 0, len(model.names))
            top = np.where(judged, share.max(axis=1) if share.shape[1] else 0.0, 0.0)
            sets = [[{"lang": names[j], "share": float(row[j])} for j in np.flatnonzero(row > 0)] if ok else [] for row, ok in zip(share, judged)]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(top, 0.0, 1.0)), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "lang_pred", "score", "languages"],
            )


def identify_languages(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its proportion), languages (the selected set).

    Learns from `training` (docs, unless given) rows whose crc32(doc_id) modulo 4 is not 2.
    `und` with score 0 if the text is null or has no letter, or if nothing could be learned.
    A null doc_id is not held out. Of languages with equal shares the first in alphabetical
    order is predicted. Texts of any length are judged whole. Extra columns are ignored, rows
    repeat as they come and an empty table gives an empty result.
    """
    source = docs if training is None else training
    model = learn_languages(source.where(F.coalesce(crc_fold("doc_id", 4) != 2, F.lit(True))))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.mapInArrow(lambda it: _infer(it, model), "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
    return found.select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")

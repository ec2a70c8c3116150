"""Periodic runs of words: stretches that repeat with a period, found through a dictionary of basic factors.

The factors of each power-of-two length get names, equal ones the same. Occurrences of one name
that overlap by half or more stand in arithmetic progressions. A run with a period q between
length and twice length shows as two occurrences of one name q apart, in progressions that
follow each other closely, so all differences of close progressions propose the periods.
Proposals are extended both ways through the names and merged to maximal runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words of a run, at least.
MIN_WORDS = 12
#: Texts are taken together up to so many words; a longer text is taken alone.
WORDS_AT_ONCE = 400_000

RUNS = "array<struct<start:long,length:long,period:long>>"
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and the names of those."""
    _, name, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = times[name] > 1
    return again, (np.cumsum(times > 1) - 1)[name[again]]


class Factors:
    """Names of the factors of 1, 2, 4, ... words that occur more than once, by position."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        """words: ids; text: the text that each word belongs to. Factors of two texts are never equal."""
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        again, name = _named(text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
        at = np.flatnonzero(again)
        while len(at):
            self.levels.append((at, name))
            length = 1 << len(self.levels) - 1
            follower = self.names(len(self.levels) - 1, at + length)
            both = follower >= 0
            again, following = _named(name[both].astype(np.int64) * (int(name.max()) + 1) + follower[both])
            at, name = at[both][again], following

    def names(self, level: int, at: np.ndarray) -> np.ndarray:
        """The names at some positions, -1 for factors that occur once or reach beyond the end."""
        places, name = self.levels[level]
        slot = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[slot] == at, name[slot], -1)

    def common(self, one: np.ndarray, two: np.ndarray, side: int) -> np.ndarray:
        """How many words agree from each pair of positions onwards (side 1) or before them (side -1)."""
        far = np.zeros(len(one), dtype=np.int64)
        for level in reversed(range(len(self.levels))):
            length = 1 << level
            shift = far if side > 0 else -far - length
            name = self.names(level, one + shift)
            far += length * ((name >= 0) & (name == self.names(level, two + shift)))
        return far


def _proposals(at: np.ndarray, name: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods, from length to below twice length, that factors of this length propose."""
    order = np.argsort(name, kind="stable")
    at, name = at[order], name[order]
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (name[1:] != name[:-1]) | (2 * (at[1:] - at[:-1]) > length)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(at)) - 1
    size = last - first + 1
    step = np.where(size > 1, at[np.minimum(first + 1, len(at) - 1)] - at[first], 0)
    found = []
    for ahead in (1, 2, 3):  # progressions that follow lie more than half a length apart, so a fourth is too far
        here = np.arange(max(0, len(first) - ahead))
        here = here[name[first[here]] == name[first[here + ahead]]]
        there = here + ahead
        near = at[first[there]] - at[last[here]]
        by = np.maximum(1, np.maximum(step[here], step[there]))
        low = np.maximum(0, -((near - length) // by))
        high = np.minimum(size[here] + size[there] - 2, (2 * length - 1 - near) // by)
        many = np.maximum(0, high - low + 1)
        pair = np.repeat(np.arange(len(here)), many)
        j = low[pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        back = np.minimum(j, size[here][pair] - 1)
        found.append((at[last[here]][pair] - back * step[here][pair], near[pair] + j * by[pair]))
    place, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    fresh = np.ones(len(place), dtype=bool)  # neighbours with one period lie in the same run
    fresh[1:] = (period[1:] != period[:-1]) | (place[1:] > place[:-1] + 1)
    return place[fresh], period[fresh]


def maximal_runs(words: np.ndarray, text: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """Rows (start, length, period), sorted by start and period, of all maximal runs of at least two periods and `least` words."""
    factors = Factors(words, text)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for level, (at, name) in enumerate(factors.levels):
        place, period = _proposals(at, name, 1 << level)
        start = place - factors.common(place, place + period, -1)
        length = place + period + factors.common(place, place + period, 1) - start
        keep = length >= np.maximum(least, 2 * period)
        found.append(np.stack([start[keep], length[keep], period[keep]], axis=1))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    smallest = np.ones(len(runs), dtype=bool)  # of one stretch only the smallest period counts
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _judged(texts: list[list[bytes]], least: int) -> tuple[pa.Array, list[bytes]]:
    """The runs of each text and its words without the repeats."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), dtype=np.int64, count=int(begins[-1]))
    runs = maximal_runs(ids, np.repeat(np.arange(len(texts)), sizes), least)
    of = np.searchsorted(begins, runs[:, 0], side="right") - 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(edge[:-1]) > 0
    holding = set(of.tolist())
    kept = [b" ".join([w for w, g in zip(t, gone[begins[k] : begins[k + 1]].tolist()) if not g] if k in holding else t) for k, t in enumerate(texts)]
    ends = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    columns = [pa.array(c, pa.int64()) for c in (runs[:, 0] - begins[of], runs[:, 1], runs[:, 2])]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["start", "length", "period"])), kept


def _found(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None, least: int) -> Iterator[pa.RecordBatch]:
    def done(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
        runs, kept = _judged(texts, least)
        collapsed = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), runs, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    for batch in slices(batches):
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            ids.append(doc_id)
            texts.append(rewrite(doc_id, words) if rewrite and words else words)
            held += len(words)
            if held >= WORDS_AT_ONCE:
                yield done(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield done(ids, texts)


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): one row for each row of docs(doc_id, text).

    Words are what ASCII white space parts. runs has the maximal stretches of `least` words and
    two periods or more, sorted by start and period; collapsed is the text of the words that no
    run repeats, joined by single spaces. rewrite(doc_id, words) may change the words first. A
    null or empty text has no words, no runs and an empty collapsed text. A null doc_id stays
    null; repeated rows are judged each; two runs of one start differ in their periods. An
    empty table gives an empty result. Other columns are not read. A text of any length is
    taken whole, in one task, with some 16 bytes for each repeated word and level of the
    dictionary. No rows are shuffled.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lambda it: _found(it, rewrite, least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """The result of periodic_runs with its longest run and digests in place of lists and texts."""
    best = found.withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less")))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.less")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )

"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

Words are runs of digits, lower-cased letters and non-ASCII characters. Benchmark words
are numbered; a training word outside that vocabulary ends every window. Windows are
hashed over word numbers, probed against the sorted set of benchmark hashes, and hits are
verified word by word. A benchmark too large to broadcast is joined instead: windows of
both sides meet by hash in a shuffle, and the hits are verified in the same way.

Everywhere, a null text has no words, a text of any length is scanned whole, rows repeat as
they come and an empty table gives an empty result; items without words have no window,
shorter ones are one window, items with equal windows are all named, items without an id
count as one called "null", and without items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices

WINDOW = 13
#: Benchmark words that are broadcast, some 80 bytes each; a larger benchmark is joined by shuffle.
MOST_WORDS = 1_000_000
#: And so many bytes of text.
MOST_BYTES = 32 << 20

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isdigit() or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` numbers."""
    n = len(ids) - size + 1
    return _mixed(ids[k : k + n] for k in range(size)) if n > 0 else np.zeros(0, dtype=np.uint64)


def _mixed(columns: Iterator[np.ndarray]) -> np.ndarray:
    out = np.uint64(0)
    for column in columns:
        out = out * _BASE + column.astype(np.uint64)
    return out ^ (out >> np.uint64(29))


class WindowSet:
    """The windows of some benchmark items, by length: sorted hashes, word numbers, items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.items: list[str] = []
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, tuple[list, list]] = {}
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)], dtype=np.int32)
            size = min(window, len(ids))
            if size:
                grams, owners = found.setdefault(size, ([], []))
                grams.append(np.lib.stride_tricks.sliding_window_view(ids, size))
                owners.append(np.full(len(ids) - size + 1, len(self.items), dtype=np.int32))
                self.items.append(item_id)
        for size, (grams, owners) in found.items():
            rows, of = np.concatenate(grams), np.concatenate(owners)
            hashes = _mixed(rows[:, k] for k in range(size))
            order = np.argsort(hashes, kind="stable")
            self.runs[size] = (hashes[order], rows[order], of[order])

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in a benchmark window, and the items whose windows occur."""
        ids = np.fromiter(map(self.number.get, words, repeat(0)), dtype=np.int64, count=len(words))
        hit = np.zeros(len(ids), dtype=bool)
        items: set[str] = set()
        known = ids > 0
        if not known.any():
            return hit, items
        edge = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        begins, ends = edge[::2], edge[1::2]
        for size, (hashes, grams, owners) in self.runs.items():
            for a, b in zip(begins[ends - begins >= size].tolist(), ends[ends - begins >= size].tolist()):
                rolled = _rolling(ids[a:b], size)
                at = np.searchsorted(hashes, rolled)
                at[at == len(hashes)] = 0
                for k in np.flatnonzero(hashes[at] == rolled).tolist():
                    row = int(at[k])
                    while row < len(hashes) and hashes[row] == rolled[k]:
                        if np.array_equal(grams[row], ids[a + k : a + k + size]):
                            hit[a + k : a + k + size] = True
                            items.add(self.items[owners[row]])
                        row += 1
        return hit, items


def _spans(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"from": a, "to": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
FOUND = "n_words long, hit_spans array<struct<`from`: bigint, `to`: bigint>>, n_hit long, items array<string>"


def _found_rows(batch: pa.RecordBatch, found: list[tuple[np.ndarray, set[str]]], fields: list[str]) -> pa.RecordBatch:
    """The fields of the batch with the columns of FOUND."""
    columns = [
        pa.array([len(hit) for hit, _ in found], pa.int64()),
        pa.array([_spans(hit) for hit, _ in found], _SPANS),
        pa.array([int(hit.sum()) for hit, _ in found], pa.int64()),
        pa.array([sorted(items) for _, items in found], pa.list_(pa.string())),
    ]
    return pa.record_batch([*(batch.column(f) for f in fields), *columns], names=[*fields, "n_words", "hit_spans", "n_hit", "items"])


def _clean_rows(batch: pa.RecordBatch, found: list[tuple[np.ndarray, set[str]]], fields: list[str]) -> pa.RecordBatch:
    """The fields of the rows that are not contaminated."""
    keep = [not hit.any() or 20 * int(hit.sum()) < len(hit) for hit, _ in found]
    return batch.select(fields).filter(pa.array(keep, pa.bool_()))


def _cut_rows(batch: pa.RecordBatch, found: list[tuple[np.ndarray, set[str]]], fields: list[str]) -> pa.RecordBatch:
    """The fields, with the text from the first to the last word of every hit span taken out."""
    texts = []
    for text, (hit, _) in zip(batch.column("text").to_pylist(), found):
        if hit.any():
            raw = text.encode("utf-8", "surrogatepass")
            at = [m.span() for m in _WORD_BYTES.finditer(raw)]
            edges = [0, *(x for s in _spans(hit) for x in (at[s["from"]][0], at[s["to"] - 1][1])), len(raw)]
            text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "surrogatepass")
        texts.append(text)
    return pa.record_batch([pa.array(texts, pa.string()) if f == "text" else batch.column(f) for f in fields], names=fields)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text)
            size = min(window, len(words))
            if size:
                rows.extend((size, h, b" ".join(words[k : k + size]), item_id) for k, h in enumerate(_word_hashes(words, size)))
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.string()))], names=["size", "h", "gram", "item_id"])


def _word_hashes(words: list[bytes], size: int) -> list[int]:
    return _rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words)), size).view(np.int64).tolist()


def _text_windows(batches: Iterator[pa.RecordBatch], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 200):
        for row, text in zip(batch.column(_ROW).to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text)
            for size in sizes:
                hashes = _word_hashes(words, size)
                if hashes:
                    n = len(hashes)
                    yield pa.record_batch([pa.array([row] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array(hashes, pa.int64()), pa.array(np.arange(n))], names=[_ROW, "size", "h", "at"])


def _verified(text: str | None, hits: list[dict] | None) -> tuple[np.ndarray, set[str]]:
    words = words_of(text)
    hit, items = np.zeros(len(words), dtype=bool), set()
    for x in hits or []:
        if b" ".join(words[x["at"] : x["at"] + x["size"]]) == x["gram"]:
            hit[x["at"] : x["at"] + x["size"]] = True
            items.update(x["items"])
    return hit, items


#: Internal columns; a document table never has them.
_ROW, _HITS = "__scriptorium_row", "__scriptorium_hits"


def _joined_hits(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """docs, as a written table with a row number, with the windows of each row that meet a benchmark window's hash."""
    windows = materialise(items.mapInArrow(lambda it: _item_windows(it, window), "size int, h long, gram binary, item_id string").groupBy("size", "h", "gram").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` of them
    rows = materialise(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    mine = rows.select(_ROW, F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _text_windows(it, sizes), f"{_ROW} long, size int, h long, at long")
    hits = mine.join(windows, ["size", "h"]).groupBy(_ROW).agg(F.collect_list(F.struct("at", "size", "gram", "items")).alias(_HITS))
    return rows.join(hits, _ROW, "left")


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, fields: list[str], build, schema) -> DataFrame:
    """build(batch, found, fields) over all rows; the benchmark's words decide how hits are found."""
    items = _items(benchmark).withColumn("n", F.regexp_count("text", F.lit(_WORD))).where("n > 0")  # others have no window
    size = items.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    items = items.drop("n")
    if size[0] <= MOST_WORDS and size[1] <= MOST_WORDS and size[2] <= MOST_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet([(r["item_id"], r["text"]) for r in items.collect()], window))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield build(batch, [shared.value.scan(words_of(t)) for t in batch.column("text").to_pylist()], fields)

        return docs.mapInArrow(scan, schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield build(batch, [_verified(t, h) for t, h in zip(batch.column("text").to_pylist(), batch.column(_HITS).to_pylist())], fields)

    return _joined_hits(docs, items, window).mapInArrow(verify, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id with n_words, hit_spans (word positions, `to` excluded), n_hit, items; one row per input row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scanned(plain, benchmark, window, ["doc_id"], _found_rows, f"doc_id long, {FOUND}")


def contaminated():
    """At least one word is hit, and a twentieth of the words or more."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per input row."""
    found = contamination(docs, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, whole rows and columns, without those that are contaminated."""
    return _scanned(docs, benchmark, window, docs.columns, _clean_rows, docs.schema)


def cut_contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every hit span taken out of its text; rows and other columns stay."""
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in docs.schema.fields])
    return _scanned(docs, benchmark, window, docs.columns, _cut_rows, schema)

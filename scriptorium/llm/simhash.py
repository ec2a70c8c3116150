"""SimHash near-duplicate groups, with pigeonring pruning of candidate pairs.

A 64-bit fingerprint is cut into eight 8-bit segments on a ring. If two fingerprints
differ in at most 3 bits, some segment starts a chain in which the differences of the
first l segments never exceed floor(3 * l / 8) for l = 1..8 (the strong pigeonring
principle): 0, 0, 1, 1, 1, 2, 2, 3. So the first two segments agree and of the next three
at most one differs. Every fingerprint is filed under 24 keys (8 starts, 3 choices of the
segment left out), each of which fixes 32 bits; pairs that meet under a key must pass the
chain of that start before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, slices

BITS, SEGMENTS, DISTANCE = 64, 8, 3
WIDTH = BITS // SEGMENTS
#: Most bit differences allowed in the first 1..8 segments of a chain.
BUDGETS = [DISTANCE * length // SEGMENTS for length in range(1, SEGMENTS + 1)]
#: Members of one bucket compared in one row; larger buckets are dealt out as pairs of blocks.
BLOCK = 256

_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_LANE = (np.arange(8) * 256).astype(np.int64)
_CHUNK = 1 << 17


def _hashes(shingles) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    counts = np.zeros(2048, dtype=np.int64)
    for start in range(0, total, _CHUNK):
        part = words[start : start + _CHUNK + width - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(part) >= width else [b" ".join(part)]
        counts += _byte_counts(_hashes(joined))
    return _majority(counts, total)


def _byte_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each value stands at each of the eight bytes."""
    lanes = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _BYTE_LANE
    return np.bincount(lanes.ravel(), minlength=2048)


def _majority(counts: np.ndarray, total: int) -> int:
    bits = (counts.reshape(8, 256) @ _BIT_OF_BYTE).ravel() * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fold(hashes: np.ndarray) -> int:
    """The fingerprint of a text whose shingles have these hashes."""
    return _majority(_byte_counts(hashes), len(hashes)) if len(hashes) else 0


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row per input row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _fingerprints(it, width), "doc_id long, fp long")


def _keys() -> list[tuple[int, int]]:
    """(start segment, mask of the 32 bits that a key fixes)."""
    out = []
    for start in range(SEGMENTS):
        for left_out in (2, 3, 4):
            mask = 0
            for step in (0, 1, 2, 3, 4):
                if step != left_out:
                    mask |= 0xFF << (WIDTH * ((start + step) % SEGMENTS))
            out.append((start, mask - (1 << 64) if mask >> 63 else mask))
    return out


def _linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which pairs pass the chain from their start segment and the full Hamming check."""
    differ = a ^ b
    alive = np.arange(len(a))
    total = np.zeros(len(a), dtype=np.int64)
    for step, budget in enumerate(BUDGETS):
        segment = (differ[alive] >> (WIDTH * ((start[alive] + step) % SEGMENTS)).astype(np.uint64)) & np.uint64(0xFF)
        total[alive] += np.bitwise_count(segment)
        alive = alive[total[alive] <= budget]
    return alive[np.bitwise_count(differ[alive]) <= DISTANCE]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's list, the links as a star around the smallest member of each component."""
    for batch in batches:
        lists = batch.column("members")
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = np.diff(lists.offsets.to_numpy())
        start = np.repeat(batch.column("start").to_numpy(), sizes)
        left = np.concatenate([np.arange(n, 0, -1) for n in sizes]) if len(sizes) else np.zeros(0, dtype=int)
        label = np.arange(len(values))
        here = np.arange(len(values))
        for gap in range(1, int(sizes.max(initial=0))):
            here = here[left[here] > gap]
            near = here[label[here] != label[here + gap]]
            hit = near[_linked(values[near], values[near + gap], start[near])]
            one, two = hit, hit + gap
            while len(one):
                x, y = label[one], label[two]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(label, label[label]):
                    label = label[label]
                apart = label[one] != label[two]
                one, two = one[apart], two[apart]
        member = np.flatnonzero(label != np.arange(len(label)))
        yield pa.record_batch([pa.array(values[member].view(np.int64)), pa.array(values[label[member]].view(np.int64))], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fp within 3 bits.

    A bucket of more than BLOCK members is dealt out as pairs of blocks, so a row compares
    a bounded number of fingerprints, and each row returns fewer edges than it has members.
    """
    choices = F.array(*[F.struct(F.lit(n).cast("tinyint").alias("tag"), F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, (s, m) in enumerate(_keys())])
    # the keys of a print are many times its size: deal the prints out before
    keyed = prints.select("fp").distinct().repartition("fp").select("fp", F.explode(choices).alias("k")).select("fp", "k.*")
    buckets = keyed.groupBy("tag", "key").agg(F.count("*").alias("n")).where("n > 1").select("tag", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = keyed.join(buckets, ["tag", "key"]).withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = (
        met.groupBy("tag", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
        .agg(F.collect_list("fp").alias("members"), F.first("start").alias("start"))
        .where(F.size("members") > 1)
        .select("start", "members")
    )
    return rows.mapInArrow(_stars, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most 3 differing bits.
    Texts without words (null, empty) have fingerprint zero and link like any other. Equal
    texts share a fingerprint, so copies cost one entry. A null doc_id is kept in the
    result but never names a component; a component of such rows alone has a null id.
    Repeated rows give repeated result rows. A bit that exactly half of the shingles set is
    0. A text of any length is hashed whole. An empty table gives an empty result. Extra
    columns are ignored.
    """
    prints = materialise(fingerprints(docs, width), "fingerprints")
    root = components(links(prints)).withColumnsRenamed({"node": "fp"})
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = classes.join(least, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(of_print, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs without the near copies: of each component the row whose doc_id names it stays.

    Rows without a doc_id stay; rows that repeat a doc_id stand or fall together.
    """
    gone = simhash_groups(docs.select("doc_id", "text"), width).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)

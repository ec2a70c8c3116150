"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Pieces are dealt into partitions and packed there by best fit, longest first. After that
at most one bin of a partition is half empty or more, since two such bins would have been
one. Bins of at least NEARLY_FULL of the capacity are emitted; of the rest each partition
hands on its smallest bin and the FAN_IN least-filled others as items of the next round,
where FAN_IN partitions meet. No other bin could change: two bins above half never share,
so a merge places at most FAN_IN small bins and needs no more than FAN_IN hosts from any
one child. Rounds repeat until one group is left, which holds a fixed number of bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .token_blocks import _chunks
from .tokens import encoder

FAN_IN = 8
NEARLY_FULL = 0.98
#: Pieces packed by one task of the first round.
PIECES_PER_PARTITION = 50_000


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    kind = "<u2" if enc.width == 2 else "<u4"
    end = end_id.to_bytes(enc.width, "little")
    for batch in slices(batches):
        texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
        for lo, hi in _chunks(texts):
            rows: list[tuple] = []
            for doc_id, raw in zip(doc_ids[lo:hi], enc.encode(texts[lo:hi])):
                ids = np.frombuffer(raw + end, dtype=kind).astype("<u4")
                data, n = ids.tobytes(), len(ids)
                cuts = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                rows.extend((doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
            cols = list(zip(*rows))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents longer than capacity are cut, the first piece taking the remainder."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lambda it: _pieces(it, tokenizer_path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin; longest items first.

    Open bins are kept by the room they have left; a bit set of the rooms in use finds the
    smallest room that fits.
    """
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, fills = 0, []
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fitting = in_use >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                in_use ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        if left := room - size:
            rooms[left].append(b)
            in_use |= 1 << left
    return bins, offsets, np.array(fills, dtype=np.int64)


def _packer(capacity: int, tag: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, _ = best_fit(pdf["length"].to_numpy(), capacity)
        return pdf.assign(bin=(tag << 56) + (pdf["group"].to_numpy(dtype=np.int64) << 28) + bins, offset=offsets)

    return pack


def _carried(level: DataFrame, capacity: int) -> DataFrame:
    """Of each group's underfull bins, those that a later round may still change."""
    fills = level.groupBy("group", "bin").agg(F.sum("length").alias("length")).where(F.col("length") < F.lit(NEARLY_FULL * capacity))
    small = F.col("length") * 2 <= capacity
    order = Window.partitionBy("group", small).orderBy("length", "bin")
    rank = F.row_number().over(order)
    return fills.withColumn("rank", rank).where(F.col("rank") <= F.when(small, 1).otherwise(FAN_IN)).drop("rank")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with sequence_id and offset; sequences are gapless from 0 and hold at most capacity.

    `pieces` must be a written table (it is read more than once) with column length.
    """
    full = pieces.where(F.col("length") == capacity)
    rest = pieces.where(F.col("length") < capacity)
    count = rest.count()
    groups = max(1, -(-count // PIECES_PER_PARTITION))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, group long"
    dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    local = materialise(dealt.groupBy("group").applyInPandas(_packer(capacity, 0), f"{fields}, bin long, offset long"), "packed")
    moves, level, tag = None, local.select("group", "bin", "length"), 0
    while groups > 1:
        groups, tag = -(-groups // FAN_IN), tag + 1
        items = _carried(level, capacity).select(F.expr(f"group div {FAN_IN}").alias("group"), F.col("bin").alias("item"), "length")
        merged = materialise(items.groupBy("group").applyInPandas(_packer(capacity, tag), "group long, item long, length long, bin long, offset long"), "merged")
        level = merged.select("group", "bin", "length")
        step = merged.select(F.col("item"), F.col("bin").alias("to"), F.col("offset").alias("shift"))
        if moves is None:
            moves = step
        else:
            onward = step.select(F.col("item").alias("to"), F.col("to").alias("next"), F.col("shift").alias("more"))
            moves = moves.join(onward, "to", "left").select("item", F.coalesce("next", "to").alias("to"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moves = materialise(moves, "moves")
    named = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = local.select(*named, F.col("bin").alias("sequence_id"), "offset")
    if moves is not None:
        placed = local.join(moves, local["bin"] == moves["item"], "left").select(*named, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    alone = full.select(*named, (F.lit(127 << 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Cut, digest and pack every document; null texts count as empty (the end id alone).

    Rows that repeat a doc_id, or have none, are packed as pieces of their own. A text of
    any length is encoded whole and cut. Pieces of equal length are placed in the order in
    which they come; bins of equal room are taken in any order. An empty table gives an
    empty result. Extra columns are ignored.
    """
    return pack_pieces(materialise(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)

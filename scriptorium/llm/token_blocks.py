"""Token-id tables as Huffman-coded blocks.

Texts are tokenised once; the ids are kept as a table, counted over all documents, coded
with one canonical length-limited Huffman code and written in document order as
independent blocks. A reader needs the code lengths (one small table) and any subset of
blocks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir
from .huffman import canonical_codes, code_lengths, decode_block, decode_table, encode_block
from .tokens import encoder

#: Ids after which a block is closed; a block holds whole documents.
BLOCK_IDS = 1 << 16
#: Shards whose sizes one group sums.
SHARDS_PER_PART = 4096
#: Offsets of at most so many shards (16 bytes each) are broadcast; more are joined by shuffle.
MOST_BROADCAST_SHARDS = 1 << 20
_BLOCKS = "shard int, block int, before long, n_ids long, doc_ids array<bigint>, doc_lens array<bigint>, payload binary"


def _chunks(texts: list, most: int = 1 << 22):
    """Runs of texts of some 4 million characters together."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end of the task rows that count its ids."""
    enc = encoder(path)
    counts, kind = np.zeros(0, dtype=np.int64), "<u2" if enc.width == 2 else "<u4"
    end = end_id.to_bytes(enc.width, "little")
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi in _chunks(texts):
            ids = [b + end for b in enc.encode(texts[lo:hi])]
            counts = _add(counts, np.bincount(np.frombuffer(b"".join(ids), dtype=kind)))
            yield _token_rows(batch.column("doc_id").slice(lo, hi - lo), ids, [-1] * len(ids), [len(b) // enc.width for b in ids])
    used = np.flatnonzero(counts)
    for i in range(0, len(used), 10_000):
        part = used[i : i + 10_000]
        yield _token_rows([None] * len(part), [None] * len(part), part, counts[part])


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(a), len(b)), dtype=np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def _token_rows(doc_ids, ids, id_of, n) -> pa.RecordBatch:
    return pa.record_batch([doc_ids if isinstance(doc_ids, pa.Array) else pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary()), pa.array(id_of, pa.int32()), pa.array(n, pa.int64())], names=["doc_id", "ids", "id", "n"])


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """Tokens (doc_id, ids) of every document and counts (id, n) over all of them.

    ids are little-endian, the end id included. Both come from one written table, so texts
    are tokenised once; counts has at most one row per id of the vocabulary.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(plain.mapInArrow(lambda it: _tokenise(it, tokenizer_path, end_id), "doc_id long, ids binary, id int, n long"), "ids")
    return rows.where("id = -1").select("doc_id", "ids"), rows.where("id >= 0").groupBy("id").agg(F.sum("n").alias("n"))


def id_type(tokenizer_path: str) -> str:
    return "<u2" if encoder(tokenizer_path).width == 2 else "<u4"


def _write(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    codes = canonical_codes(lengths)
    shard, block = TaskContext.get().partitionId(), 0
    docs, held, size, before = [], [], 0, 0

    def close():
        ids = np.concatenate(held) if held else np.zeros(0, dtype=kind)
        cols = [[shard], [block], [before], [size], [docs], [[len(h) for h in held]], [encode_block(ids, codes, lengths)]]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["shard", "block", "before", "n_ids", "doc_ids", "doc_lens", "payload"])

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            docs.append(doc_id)
            held.append(np.frombuffer(ids.as_buffer(), dtype=kind))
            size += len(held[-1])
            if size >= BLOCK_IDS:
                yield close()
                docs, held, size, block, before = [], [], 0, block + 1, before + size
    if docs:
        yield close()


def write_token_blocks(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, ids_per_shard: int = 1 << 23) -> None:
    """Encode docs and write `path`/blocks and `path`/code_lengths.

    Documents are dealt into shards by range and lie in ascending order of doc_id, rows
    without one first; rows that share a doc_id lie by a hash of their ids, equal rows side
    by side, and may go to several shards. An empty table gives empty files. Null and empty
    texts hold the end id alone; a text of any length is one document and lies in one
    block. Other columns are ignored.
    """
    kind = id_type(tokenizer_path)
    tokens, counted = token_table(docs, tokenizer_path, end_id)
    counts = counted.toPandas()
    by_id = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, dtype=np.int64)
    by_id[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    lengths = code_lengths(by_id)
    spark = docs.sparkSession
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code_lengths")
    shards = max(1, -(-int(by_id.sum()) // ids_per_shard))
    # tokens is a written table, so a row's number stays the same if a task is tried again
    placed = tokens.withColumn("h", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(shards, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    ordered.select("doc_id", "ids").mapInArrow(lambda it: _write(it, lengths, kind), _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _read(batches: Iterator[pa.RecordBatch], lengths: np.ndarray, digest: bool) -> Iterator[pa.RecordBatch]:
    symbol, size = decode_table(lengths)
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_block(row["payload"], symbol, size).astype("<u4")
            ends = np.cumsum(np.array(row["doc_lens"], dtype=np.int64))
            begins = ends - row["doc_lens"]
            if digest:
                last = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)], pa.int64())
            else:
                last = pa.array([ids[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary())
            yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + begins), pa.array(row["doc_lens"], pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def shard_offsets(blocks: DataFrame) -> DataFrame:
    """(shard, offset): ids in all shards before, summed within groups of shards and over the groups."""
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("part", F.expr(f"shard div {SHARDS_PER_PART}"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("shard", (F.col("base") + F.col("inside")).alias("offset"))


def read_token_blocks(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, binary).

    With digest the crc32 of the decoded ids, ids_crc32, takes the place of ids.
    Blocks are decoded on their own, in any task; the driver sees only the code lengths.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    row = spark.read.schema("lengths binary").parquet(f"{path}/code_lengths").first()
    lengths = np.frombuffer(bytes(row["lengths"]), dtype=np.uint8)
    offsets = materialise(shard_offsets(blocks), "offsets")
    if offsets.count() <= MOST_BROADCAST_SHARDS:
        offsets = F.broadcast(offsets)
    placed = blocks.join(offsets, "shard").select((F.col("offset") + F.col("before")).alias("first"), "doc_ids", "doc_lens", "payload")
    return placed.mapInArrow(lambda it: _read(it, lengths, digest), f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write docs as blocks in the shared folder, read them back, and digest each document."""
    path = f"{shared_dir(docs.sparkSession)}/scriptorium/blocks-{uuid.uuid4().hex}"
    write_token_blocks(docs, path, tokenizer_path, end_id)
    return read_token_blocks(docs.sparkSession, path, digest=True)

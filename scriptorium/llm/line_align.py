"""Line dedup by pairwise alignment of overlapping documents.

Lines that several documents hold are shared. Every shortest run of consecutive shared lines
that makes a block, forwards from each line and backwards, is hashed and matched to its
owner, the document with the smallest id that has it; a document meets each owner of its
runs once, whatever the number of copies. Each line of a block lies in such a run inside
the block, so no block is missed: the owner of each of its runs holds all lines of the run
one after the other. The lines of those runs are aligned with the owner's by patience
diff, and aligned blocks of enough words are deleted from the later document. Blocks that
moved, or that repeated lines keep from patience, are found by the runs that occur anywhere
in both, in time that grows with the lines. An owner's run has no earlier holder, so every
block survives somewhere.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices

#: Words of the shortest block that is deleted.
MIN_BLOCK_WORDS = 30
#: A key is frequent if it has over 1 / MOST_FREQUENT of all rows, so fewer keys than this are
#: ever broadcast; FEW_ROWS keeps small tables from calling every key frequent.
MOST_FREQUENT = 100_000
FEW_ROWS = 1_000
#: What names a row: its id and a hash of its text.
ROW = ["doc_id", "text_h"]
_EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_h, line_no, h, words): lines with a word, counted from 0 among such lines.

    text_h tells the texts of rows with one doc_id apart.
    """
    trimmed = F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, _EDGE, "")), lambda x: x != "")
    lines = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_h"), F.posexplode(trimmed).alias("line_no", "line"))
    return lines.select(*ROW, "line_no", F.xxhash64("line").alias("h"), F.size(F.split("line", r"[\x20\x09-\x0D]+")).alias("words"))


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, ordered by the first, that also grows in the second (patience sorting)."""
    tops: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for k, (_, a) in enumerate(pairs):
        pile = bisect_left(tops, a)
        back.append(heads[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(a)
            heads.append(k)
        else:
            tops[pile], heads[pile] = a, k
    out, k = [], heads[-1] if heads else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Aligned (line, line) pairs of two sequences of (line number, hash)."""
    found: list[tuple[int, int]] = []
    work = [(0, len(left), 0, len(right))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and left[a][1] == right[c][1]:
            found.append((left[a][0], right[c][0]))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1][1] == right[d - 1][1]:
            b, d = b - 1, d - 1
            found.append((left[b][0], right[d][0]))
        if a >= b or c >= d:
            continue
        once_l, once_r = Counter(h for _, h in left[a:b]), Counter(h for _, h in right[c:d])
        where = {right[k][1]: k for k in range(c, d) if once_r[right[k][1]] == 1}
        anchors = _increasing([(k, where[left[k][1]]) for k in range(a, b) if once_l[left[k][1]] == 1 and left[k][1] in where])
        for k, m in anchors:
            found.append((left[k][0], right[m][0]))
            work.append((a, k, c, m))
            a, c = k + 1, m + 1
        if anchors:
            work.append((a, b, c, d))
    return sorted(found)


def _blocks(pairs: list[tuple[int, int]], words: dict[int, int], least: int) -> list[int]:
    """Lines of runs that are consecutive on both sides and hold enough words."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for pair in [*pairs, (-9, -9)]:
        if pair != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in run) >= least:
                out.extend(run)
            run = []
        run.append(pair[0])
        last = pair
    return out


def _runs(lines: list[tuple[int, int]], words: dict[int, int], least: int) -> set[tuple[int, int]]:
    """Shortest runs of consecutive lines with enough words, from each line forwards and backwards, as index ranges."""
    out: set[tuple[int, int]] = set()
    cuts = [0, *(k for k in range(1, len(lines)) if lines[k][0] != lines[k - 1][0] + 1), len(lines)]
    for begin, end in zip(cuts, cuts[1:]):
        size = [words[n] for n, _ in lines[begin:end]]
        b, total = 0, 0
        for a in range(len(size)):
            while b < len(size) and total < least:
                total += size[b]
                b += 1
            if total < least:
                break
            out.add((begin + a, begin + b))
            total -= size[a]
        a, total = 0, 0
        for b in range(len(size)):
            total += size[b]
            while total - size[a] >= least:
                total -= size[a]
                a += 1
            if total >= least:
                out.add((begin + a, begin + b + 1))
    return out


def _common_runs(left: list[tuple[int, int]], right: list[tuple[int, int]], words: dict[int, int], least: int) -> set[int]:
    """Lines of left in a block of enough words that is consecutive on both sides, at any of its occurrences.

    Right holds only lines of left; equal hashes have equal sizes.
    """
    size_of = {h: words[n] for n, h in left}
    theirs = {tuple(h for _, h in right[c:d]) for c, d in _runs(right, {n: size_of[h] for n, h in right}, least)}
    return {n for a, b in _runs(left, words, least) if tuple(h for _, h in left[a:b]) in theirs for n, _ in left[a:b]}


def _align(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One row per document in, with the lists of its shared lines by partner; its deleted lines out."""
    for batch in batches:
        rows = batch.column("rows")
        flat, ends = rows.flatten(), rows.offsets.to_pylist()
        owner, owner_h, line_no, h, words, theirs = (flat.field(k).to_pylist() for k in range(6))
        out: list[list[int]] = []
        for a, b in zip(ends, ends[1:]):
            by_partner: dict[tuple[int, int], list[int]] = {}
            for k in range(a, b):
                by_partner.setdefault((owner[k], owner_h[k]), []).append(k)
            deleted: set[int] = set()
            for at in by_partner.values():
                if sum(words[k] for k in at) < least:
                    continue
                left = sorted((line_no[k], h[k]) for k in at)
                right = sorted({(n, h[k]) for k in at for n in theirs[k]})
                sizes = {line_no[k]: words[k] for k in at}
                deleted.update(_blocks(patience(left, right), sizes, least))
                if any(n not in deleted for n in sizes):  # blocks that moved, or whose lines repeat
                    deleted |= _common_runs(left, right, sizes, least)
            out.append(sorted(deleted))
        yield pa.record_batch([*(batch.column(c) for c in ROW), pa.array(out, pa.list_(pa.int32()))], names=[*ROW, "deleted"])


def _lines_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[int, int]], dict[int, int]]]:
    """doc_id, text_h, the sorted (line number, hash) and the words by line number of each row."""
    rows = batch.column("rows")
    flat, ends = rows.flatten(), (rows.offsets.to_numpy() - rows.offsets[0].as_py()).tolist()
    line_no, h, words = (flat.field(k).to_pylist() for k in range(3))
    for doc_id, text_h, a, b in zip(*(batch.column(c).to_pylist() for c in ROW), ends, ends[1:]):
        yield doc_id, text_h, sorted({(line_no[k], h[k]) for k in range(a, b)}), {line_no[k]: words[k] for k in range(a, b)}


def _run_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The hashes of each document's runs of shared lines, with their first and last line."""
    for batch in batches:
        for doc_id, text_h, lines, sizes in _lines_of(batch):
            hashes = np.array([x for _, x in lines], dtype=np.int64)
            spans = sorted(_runs(lines, sizes, least))
            if spans:
                keys = np.array([xxhash.xxh3_64_intdigest(hashes[c:d].tobytes()) for c, d in spans], dtype=np.uint64)
                ends = [pa.array([lines[x][0] for x in at], pa.int32()) for at in ([c for c, _ in spans], [d - 1 for _, d in spans])]
                yield pa.record_batch([pa.array([doc_id] * len(keys), pa.int64()), pa.array([text_h] * len(keys), pa.int64()), pa.array(keys.view(np.int64)), *ends], names=[*ROW, "h", "first", "last"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each document's owned runs, once for each owner."""
    for batch in batches:
        spans = batch.column("spans").to_pylist()
        for (doc_id, text_h, lines, sizes), of_doc in zip(_lines_of(batch), spans):
            hash_of = dict(lines)
            out = sorted({(s["owner"], s["owner_h"], k) for s in of_doc for k in range(s["first"], s["last"] + 1)})
            columns = [[doc_id] * len(out), [text_h] * len(out), [x[0] for x in out], [x[1] for x in out], [x[2] for x in out], [hash_of[x[2]] for x in out], [sizes[x[2]] for x in out]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 4 + (pa.int32(), pa.int64(), pa.int32()))], names=[*ROW, "owner", "owner_h", "line_no", "h", "words"])


def _frequent_beyond(table: DataFrame) -> int:
    """The number of rows beyond which a key of the table is frequent."""
    return max(FEW_ROWS, table.count() // MOST_FREQUENT)


def _owned(lines: DataFrame) -> DataFrame:
    """Lines that several documents hold, with their owner.

    Lines that are frequent get it from a broadcast, where they lie; the rest by shuffle, in
    which no key has more rows than the limit.
    """
    limit = _frequent_beyond(lines)
    counted = lines.groupBy("h").agg(F.min("doc_id").alias("owner"), F.min_by("text_h", "doc_id").alias("owner_h"), F.max("doc_id").alias("latest"), F.count("*").alias("n"))
    shared = materialise(counted.where("owner < latest").select("h", "owner", "owner_h", (F.col("n") > limit).alias("frequent")), "owners")
    frequent = F.broadcast(shared.where("frequent").drop("frequent"))
    rare = shared.where("NOT frequent").drop("frequent")
    return lines.join(frequent, "h").unionByName(lines.join(frequent, "h", "left_anti").join(rare, "h"))


def _met(pairs: DataFrame, theirs: DataFrame) -> DataFrame:
    """Lines of the pairs that the owner holds too, with its numbers of them.

    A frequent line of one owner is dealt into parts by document, and the owner's one
    row for it is repeated for each part.
    """
    limit, key = _frequent_beyond(pairs), ["owner", "owner_h", "h"]
    counted = pairs.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    parts = F.broadcast(materialise(counted.select(*key, F.ceil(F.col("n") / limit).cast("int").alias("parts")), "parts"))
    dealt = pairs.join(parts, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*ROW), "parts"), F.lit(0)).cast("int")).drop("parts")
    repeated = theirs.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(repeated, [*key, "part"])


def deletions(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(doc_id, text_h, deleted): numbers of the lines that go, for rows that lose any.

    A document's lines go out once for each owner of the runs they lie in, so the work
    follows the input and no popular line pairs its holders with each other.
    """
    lines = materialise(numbered_lines(docs), "lines")
    held = materialise(_owned(lines).drop("owner", "owner_h"), "shared")
    by_doc = held.groupBy(*ROW).agg(F.collect_set(F.struct("line_no", "h", "words")).alias("rows"), F.sum("words").alias("n")).where(F.col("n") >= min_block_words).select(*ROW, "rows")
    by_doc = materialise(by_doc, "by_doc")  # sets: lines of equal rows are there once
    runs = materialise(by_doc.mapInArrow(lambda it: _run_keys(it, min_block_words), "doc_id long, text_h long, h long, first int, last int"), "runs")
    spans = _owned(runs).where("owner < doc_id").groupBy(*ROW).agg(F.collect_list(F.struct("owner", "owner_h", "first", "last")).alias("spans"))
    pairs = materialise(by_doc.join(spans, ROW).mapInArrow(_spread, "doc_id long, text_h long, owner long, owner_h long, line_no int, h long, words int"), "pairs")
    owners = pairs.select(F.col("owner").alias("doc_id"), F.col("owner_h").alias("text_h")).distinct()
    theirs = held.join(owners, ROW, "left_semi").groupBy(*ROW, "h").agg(F.sort_array(F.collect_set("line_no")).alias("theirs")).withColumnsRenamed({"doc_id": "owner", "text_h": "owner_h"})
    grouped = _met(pairs, theirs).groupBy(*ROW).agg(F.collect_list(F.struct("owner", "owner_h", "line_no", "h", "words", "theirs")).alias("rows"))
    return grouped.mapInArrow(lambda it: _align(it, min_block_words), "doc_id long, text_h long, deleted array<int>").where("size(deleted) > 0")


def _rebuild(batches: Iterator[pa.RecordBatch], fields: list[str], counted: bool, keep_emptied: bool) -> Iterator[pa.RecordBatch]:
    blank = " \t\n\x0b\x0c\r"
    for batch in slices(batches):
        texts, counts, gone = [], [], []
        for text, deleted in zip(batch.column("text").to_pylist(), batch.column(_GONE).to_pylist()):
            lines = [] if text is None else text.split("\n")
            full = [k for k, line in enumerate(lines) if line.strip(blank)]
            drop = {full[k] for k in deleted or [] if k < len(full)}
            counts.append(len(full))
            gone.append(len(drop))
            texts.append(text if not drop else "\n".join(line for k, line in enumerate(lines) if k not in drop))
        columns = [pa.array(texts, pa.string()) if f == "text" else batch.column(f) for f in fields]
        more = [pa.array(counts, pa.int64()), pa.array(gone, pa.int64())] if counted else []
        out = pa.record_batch([*columns, *more], names=[*fields, *(["n_lines", "n_deleted"] if counted else [])])
        yield out if keep_emptied else out.filter(pa.array([not n or n < m for m, n in zip(counts, gone)], pa.bool_()))


#: Internal columns; a document table never has them.
_GONE, _ID, _HASH = "__scriptorium_lines", "__scriptorium_id", "__scriptorium_hash"


def dedup_lines(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS, counted: bool = True, keep_emptied: bool = True) -> DataFrame:
    """docs with shortened texts and, if counted, n_lines and n_deleted (lines with a word).

    A document whose every line is aligned keeps its row with an empty text, or goes if
    keep_emptied is false; rows that came without a word stay either way. Null texts stay
    null; rows without a doc_id and lines without a word never change. Rows that share a
    doc_id are each judged by their own text, neither being the later one, so they lose
    only what smaller ids hold; equal rows lose the same lines. Other ties cannot occur:
    the smaller doc_id is the earlier one. A text of any length is aligned whole. An empty
    table gives an empty result. Other columns pass through; columns of the counts' names
    give way to the counts.
    """
    fields = [f for f in docs.columns if not (counted and f in ("n_lines", "n_deleted"))]
    docs = docs.select(*fields)
    found = deletions(docs.select("doc_id", F.col("text").cast("string").alias("text")), min_block_words)
    extra = found.select(F.col("doc_id").alias(_ID), F.col("text_h").alias(_HASH), F.col("deleted").alias(_GONE))
    joined = docs.join(extra, (docs["doc_id"].cast("long") == extra[_ID]) & (F.xxhash64(docs["text"].cast("string")) == extra[_HASH]), "left").drop(_ID, _HASH)
    schema = T.StructType(list(docs.schema.fields))
    for name in ("n_lines", "n_deleted") if counted else ():
        schema = schema.add(name, "long")
    return joined.mapInArrow(lambda it: _rebuild(it, fields, counted, keep_emptied), schema)

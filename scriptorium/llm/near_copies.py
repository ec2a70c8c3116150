"""Groups of near copies: word shingles with a Jaccard similarity of 0.8 or more.

SimHash comes first: texts whose fingerprints the pigeonring search links are compared with
one member of their group, and those that are similar enough are one class from then on.
Copies at a similarity of 0.8 may differ in far more bits than such a search can allow, so
prefix filtering completes the links exactly: two sets as similar as that share at least
4/5 of the larger one, so under any one order of all shingles they meet in their first
n - ceil(4n/5) + 1 of n. Shingles are counted over all texts and the frequent ones stand
last, by their counts, so other buckets hold fewer than FREQUENT members. In every round each
text is compared with the one it shares most buckets with among the pivots of buckets that
still hold several classes; what is still apart after PIVOT_ROUNDS is compared in full, in
blocks. The place of a shared shingle bounds what two sets can have in common, which drops
the buckets of frequent passages. Of the pairs left, parity bits of the sets (one or two for
each shingle) bound the difference from below, so that hardly a pair goes further that is not
similar. Only whole sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, discard, materialise, slices
from .line_align import FEW_ROWS, MOST_FREQUENT

#: Words of a shingle; similarity as a fraction.
WIDTH = 5
PART, WHOLE = 4, 5
#: Shingles that so many texts hold come last in the order; this moves work, never results.
FREQUENT = 16
#: At most so many frequent shingles are sent to every task; more are joined to the texts by shuffle.
MOST_COMMON = 1_000_000
#: Letters of text whose shingles are counted in one task.
LETTERS_OF_PART = 5_000_000
#: Members of a bucket in one block; blocks are compared in pairs.
BLOCK = 256
#: At most so many digests are broadcast to find their texts; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Rounds in which a text is compared with one pivot only, before all pairs that are still apart.
PIVOT_ROUNDS = 3
#: Internal columns; a document table never has them.
_ID, _DIGEST, _KEPT = "__scriptorium_id", "__scriptorium_digest", "__scriptorium_kept"


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, width).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, dtype=np.int64)])))


def digest_of(text: Column) -> Column:
    """What stands for a text: equal texts share it, a null one is empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def short_of(s: np.ndarray) -> np.ndarray:
    """The first 40 bits of hashes, by which they are counted; those that share them share a place in the order by counts."""
    return (s.view(np.uint64) >> np.uint64(24)).astype(np.int64)


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [np.unique(short_of(shingle_set(t, width))) for t in batch.column("text").to_pylist()]
        digest = np.repeat(batch.column("digest").to_numpy(), [len(x) for x in sets])
        yield pa.record_batch([pa.array(digest), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets]))], names=["digest", "h"])


def _squeezed(values: np.ndarray) -> bytes:
    """Small integers as compressed bytes."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _restored(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(8, n).T.copy().view("<u8").ravel().astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """How many texts of a batch hold each short hash, packed by part: sorted hashes as differences, and counts."""
    for batch in slices(batches, 2000):
        held = [np.unique(short_of(shingle_set(t, width))) for t in batch.column("text").to_pylist()]
        h, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *held]), return_counts=True)
        part = h % parts
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, order[ends[p] : ends[p + 1]]) for p in range(parts) if ends[p] < ends[p + 1]]
        columns = [pa.array([p for p, _ in rows], pa.int32()), pa.array([len(at) for _, at in rows], pa.int32()), *(pa.array([_squeezed(f(at)) for _, at in rows], pa.binary()) for f in (lambda at: np.diff(h[at] // parts, prepend=0), lambda at: n[at]))]
        yield pa.record_batch(columns, names=["part", "size", "hashes", "held"])


def _frequent(table: pa.Table, parts: int) -> pa.Table:
    """The hashes of one part that FREQUENT texts or more hold, with their counts."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("size", "hashes", "held"))))
    h = np.concatenate([np.cumsum(_restored(x, n)) for n, x, _ in rows])
    held = np.concatenate([_restored(x, n) for n, _, x in rows])
    order = np.argsort(h, kind="stable")
    h, held = h[order], held[order]
    first = np.flatnonzero(np.diff(h, prepend=-1))
    total = np.add.reduceat(held, first)
    often = total >= FREQUENT
    return pa.table([pa.array(h[first[often]] * parts + table.column("part")[0].as_py()), pa.array(total[often])], names=["h", "held"])


def parity_bits(s: np.ndarray) -> bytes:
    """A bit for each hash modulo a power of two, at least the size of the set: whether an odd number of hashes fall on it."""
    size = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits((np.bincount(s & (size - 1), minlength=size) & 1).astype(np.uint8)).tobytes()


def _folded(bits: bytes, size: int) -> np.ndarray:
    """Parity bits as they are for a smaller power of two."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, dtype=np.uint8).reshape(-1, size), axis=0)


def differ_little(bits: list[bytes], n: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of sets can be similar enough: differing bits are no more than the shingles of one set only."""
    size = np.array([len(x) for x in bits], dtype=np.int64)
    both = np.minimum(size[one], size[two])
    total = (n[one] + n[two]).astype(np.int64)
    most = total + 2 * (-PART * total // (PART + WHOLE))
    ok = np.zeros(len(one), dtype=bool)
    for least in np.unique(both).tolist():
        at = np.flatnonzero(both == least)
        members, place = np.unique(np.concatenate([one[at], two[at]]), return_inverse=True)
        flat = np.stack([_folded(bits[k], least) for k in members.tolist()])
        x, y = place[: len(at)], place[len(at) :]
        for lo in range(0, len(at), 4096):
            here = slice(lo, lo + 4096)
            ok[at[here]] = np.bitwise_count(flat[x[here]] ^ flat[y[here]]).sum(axis=1, dtype=np.int64) <= most[at[here]]
    return ok


def prefix_of(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the order of all: rare ones by hash, then those whose short hash is common (sorted) by count and hash."""
    if not len(s):
        return s
    short = short_of(s)
    slot = np.minimum(np.searchsorted(common, short), max(0, len(common) - 1))
    last = common[slot] == short if len(common) else np.zeros(len(s), dtype=bool)
    take = len(s) + PART * len(s) // -WHOLE + 1
    rare = s[~last][:take]
    ends = s[last][np.argsort(counts[slot[last]], kind="stable")] if len(common) else s[:0]
    return np.concatenate([rare, ends[: take - len(rare)]])


def _prefixes(batches: Iterator[pa.RecordBatch], common: tuple[np.ndarray, np.ndarray] | None, width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, prints, prefixes, bits = [], [], [], []
        own = batch.column("common") if common is None else [None] * batch.num_rows
        for text, of_text in zip(batch.column("text").to_pylist(), own):
            hashes = shingle_hashes(text, width)
            s = np.unique(hashes.view(np.int64))
            if common is None:
                pairs = np.array(sorted((x["h"], x["held"]) for x in of_text.as_py() or ()), dtype=np.int64).reshape(-1, 2)
            sizes.append(len(s))
            prints.append(simhash.fold(hashes))
            prefixes.append(prefix_of(s, *(common or (pairs[:, 0], pairs[:, 1]))))
            bits.append(parity_bits(s))
        columns = [*(batch.column(c) for c in ("doc_id", "digest")), pa.array(sizes, pa.int32()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), _lists(prefixes), pa.array(bits, pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "digest", "n", "fp", "prefix", "bits"])


def _with_prefixes(plain: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, n, fp, prefix, bits) of every row, in the order by counts over all rows."""
    letters = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-letters // LETTERS_OF_PART))
    counts = plain.mapInArrow(lambda it: _counts(it, width, parts), "part int, size int, hashes binary, held binary")
    common = materialise(counts.groupBy("part").applyInArrow(lambda t: _frequent(t, parts), "h long, held long"), "common")
    schema = "doc_id long, digest long, n int, fp long, prefix array<long>, bits binary"
    if common.count() <= MOST_COMMON:
        seen = common.orderBy("h").toPandas()
        order = (seen["h"].to_numpy(dtype=np.int64), seen["held"].to_numpy(dtype=np.int64))
        shared = plain.sparkSession.sparkContext.broadcast(order)
        return plain.mapInArrow(lambda it: _prefixes(it, shared.value, width), schema)
    shingles = plain.mapInArrow(lambda it: _shingles(it, width), "digest long, h long")
    of_text = shingles.distinct().join(common, "h").groupBy("digest").agg(F.collect_list(F.struct("h", "held")).alias("common"))
    return plain.join(of_text, "digest", "left").select("doc_id", "digest", "text", "common").mapInArrow(lambda it: _prefixes(it, None, width), schema)


def _fits(n: str, m: str) -> Column:
    """Whether two sets of these sizes can be similar enough."""
    return WHOLE * F.least(n, m) >= PART * F.greatest(n, m)


def _reach(n: str, at: str, m: str, other: str) -> Column:
    """Whether sets of n and m can be similar enough if the first shingle they share stands at these places.

    They then share no more than what follows in either, and must share PART / (PART + WHOLE)
    of both sizes together. A pair passes at its first common shingle, so none is missed.
    """
    return (PART + WHOLE) * F.least(F.col(n) - F.col(at), F.col(m) - F.col(other)) >= PART * (F.col(n) + F.col(m))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block's members that are of different classes and may reach the similarity (see _reach and differ_little)."""
    for batch in batches:
        for part in slices(iter([batch]), 50):
            members = part.column("members")
            flat, lengths = members.flatten(), np.diff(members.offsets.to_numpy())
            digest, n, at, label = (flat.field(k).to_numpy().astype(np.int64) for k in range(4))
            bits = flat.field(4).to_pylist()
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(digest))  # members from each to its block's end
            here = np.arange(len(digest))
            for gap in range(1, int(lengths.max(initial=0))):
                one = here = here[left[here] > gap]
                two = one + gap
                fits = (label[one] != label[two]) & ((PART + WHOLE) * np.minimum((n - at)[one], (n - at)[two]) >= PART * (n[one] + n[two]))
                one, two = one[fits], two[fits]
                ok = differ_little(bits, n, one, two)
                x, y = digest[one[ok]], digest[two[ok]]
                if len(x):
                    yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with the sizes and parity bits of both, those that may be similar enough."""
    for batch in slices(batches, 5000):
        bits = batch.column("bits").to_pylist() + batch.column("of_b").to_pylist()
        n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "m")])
        one = np.arange(batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(differ_little(bits, n, one, one + batch.num_rows), pa.bool_()))


def _alike(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their texts, those that are similar enough; rows of one a lie together."""
    last, held = None, np.zeros(0, dtype=np.int64)
    for batch in batches:
        for part in slices(iter([batch]), 500):
            keep = []
            for a, one, two in zip(part.column("a").to_pylist(), part.column("of_a"), part.column("of_b")):
                if a != last:
                    last, held = a, shingle_set(one.as_py(), width)
                other = shingle_set(two.as_py(), width)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(WHOLE * both >= PART * (len(held) + len(other) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, side: str, other: str, limit: int) -> DataFrame:
    """Rows of the pairs with the text of one side; a side in more than `limit` pairs is dealt into parts."""
    many = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    parts = F.broadcast(many.select(side, F.ceil(F.col("n") / limit).cast("int").alias("parts")))  # fewer than MOST_FREQUENT rows
    dealt = rows.join(parts, side, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), "parts"), F.lit(0)).cast("int")).drop("parts")
    named = texts.select(F.col("digest").alias(side), F.col("text").alias(f"of_{side}"))
    repeated = named.join(parts, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(repeated, [side, "part"]).drop("part")


def _checked(pairs: DataFrame, texts: DataFrame, width: int, keys: DataFrame | None = None) -> DataFrame:
    """Those of the written pairs (a, b) whose whole sets are similar enough; keys bring their bits, if those were not compared yet."""
    if keys is not None:
        of_a = keys.select(F.col("digest").alias("a"), "n", "bits")
        of_b = keys.select(F.col("digest").alias("b"), F.col("n").alias("m"), F.col("bits").alias("of_b"))
        pairs = materialise(pairs.select("a", "b").join(of_a, "a").join(of_b, "b").mapInArrow(_close, "a long, b long"), "close")
    count = pairs.count()
    limit = max(FEW_ROWS, count // MOST_FREQUENT)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    if count <= MOST_BROADCAST // 2:
        wanted = F.broadcast(wanted)
    held = materialise(texts.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text")), "candidates")
    both = _with_text(_with_text(pairs, pairs, held, "b", "a", limit), pairs, held, "a", "b", limit)
    alike = materialise(both.select("a", "b", "of_a", "of_b").sortWithinPartitions("a").mapInArrow(lambda it: _alike(it, width), "a long, b long"), "alike")
    discard(held)
    return alike


def _fingerprint_pairs(keys: DataFrame) -> DataFrame:
    """Each text of a group of linked fingerprints with one member of it, if their sizes allow the similarity."""
    root = components(simhash.links(keys)).select(F.col("node").alias("fp"), "root")
    named = keys.select("digest", "n", "fp").join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    group = named.groupBy("root").agg(F.min(F.struct("digest", "n")).alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size")
    return named.join(group, "root").where((F.col("digest") != F.col("pivot.digest")) & _fits("n", "pivot.n")).select(F.col("pivot.digest").alias("a"), F.col("digest").alias("b"))


def links(keys: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """Edges (a, b) between digests whose components are those of all similar pairs.

    keys(digest, n, fp, prefix, bits) has one row per digest, texts(digest, text) at least one.
    """
    tried = materialise(_fingerprint_pairs(keys), "met")
    edges = _checked(tried, texts, width, keys)
    filed = keys.select("digest", "n", F.posexplode("prefix").alias("at", "key"))
    # of two sets the smaller has the first common shingle in its first ninth, or _reach fails
    leads = F.max((F.col("at") * (PART + WHOLE) <= F.col("n") * (WHOLE - PART)).cast("int"))
    several = filed.groupBy("key").agg(F.count("*").alias("held"), leads.alias("leads")).where("held > 1 AND leads = 1").select("key")
    held = before = materialise(filed.join(several, "key"), "shared")
    for turn in range(PIVOT_ROUNDS + 1):
        label = components(edges).select(F.col("node").alias("digest"), F.col("root").alias("label"))
        named = materialise(held.join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest")), "labelled")
        # first the member with least before the shingle, as an unchanged original has; then any class's
        rank = F.col("at") / F.col("n") if turn == 0 else F.xxhash64("label", F.lit(turn)).cast("double")
        pivot = F.min(F.struct(rank.alias("rank"), "digest", "n", "at", "label"))
        apart = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n_held"), pivot.alias("pivot")).where("least < most")
        met = materialise(named.join(apart.select("key", "n_held", "pivot"), "key"), "apart")
        discard(named, before)
        if not met.limit(1).count():
            break
        if turn < PIVOT_ROUNDS:
            other = met.where((F.col("label") != F.col("pivot.label")) & _reach("n", "at", "pivot.n", "pivot.at"))
            pairs = other.groupBy(F.least("digest", "pivot.digest").alias("a"), F.greatest("digest", "pivot.digest").alias("b"), "digest").agg(F.count("*").alias("times"))
            fresh = pairs.join(tried, ["a", "b"], "left_anti").groupBy("digest").agg(F.max(F.struct("times", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
        else:
            blocks = F.ceil(F.col("n_held") / BLOCK).cast("int")
            dealt = met.withColumn("mine", F.pmod(F.xxhash64("digest"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            dealt = dealt.join(keys.select("digest", "bits"), "digest")
            rows = dealt.groupBy("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).agg(F.collect_list(F.struct("digest", "n", "at", "label", "bits")).alias("members"))
            fresh = rows.where("size(members) > 1").select("members").mapInArrow(_met, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        fresh = materialise(fresh, "met")
        tried = tried.unionByName(fresh)
        edges = edges.unionByName(_checked(fresh, texts, width, keys if turn < PIVOT_ROUNDS else None))
        held, before = met.select("key", "digest", "n", "at"), met
    return edges


def near_copy_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, digest (of its text), component_id, kept.

    component_id is the smallest doc_id reachable over pairs of similarity 0.8 or more; kept
    marks the rows of that id, of one text if it comes with several. Texts without words
    (null, empty) are copies of each other. A null doc_id never names a component; a component
    of such rows alone has a null id, and the rows of one text are kept. Rows that repeat a
    doc_id with another text are texts of their own. A text of any length is compared whole.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    texts = plain.select("digest", "text")
    rows = materialise(_with_prefixes(plain, width), "prefixes")
    keys = rows.where("n > 0").select("digest", "n", "fp", "prefix", "bits").dropDuplicates(["digest"])
    root = components(links(keys, texts, width)).select(F.col("node").alias("digest"), "root")
    wordless = F.when(F.col("n") == 0, F.lit(0)).otherwise(1)  # one class of their own
    classes = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("n").alias("n")).join(root, "digest", "left").select("digest", "first", wordless.alias("some"), F.when(F.col("n") > 0, F.coalesce("root", "digest")).otherwise(0).alias("root"))
    least = classes.groupBy("some", "root").agg(F.min(F.struct(F.col("first").isNull(), "first", "digest")).alias("least"))
    of_digest = classes.join(least, ["some", "root"]).select("digest", F.col("least.first").alias("component_id"), (F.col("digest") == F.col("least.digest")).alias("of_kept"))
    return rows.select("doc_id", "digest").join(of_digest, "digest").select("doc_id", "digest", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("of_kept")).alias("kept"))


def keep_one_of_each_group(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the near copies: of each component one row stays, one with the smallest doc_id.

    Rows without a doc_id go if a row with one is a copy, else one of them stays; of rows that
    repeat both doc_id and text one stays. All columns of the rows that stay pass through.
    """
    fate = near_copy_groups(docs.select("doc_id", "text"), width).groupBy(F.col("doc_id").alias(_ID), F.col("digest").alias(_DIGEST)).agg(F.first("kept").alias(_KEPT), F.count("*").alias("rows"))
    fate = materialise(fate.where(~F.col(_KEPT) | (F.col("rows") > 1)).drop("rows"), "fates")
    count, again = fate.agg(F.count("*"), F.count(F.when(F.col(_KEPT), 1))).first()
    met = docs["doc_id"].cast("long").eqNullSafe(fate[_ID]) & (digest_of(docs["text"]) == fate[_DIGEST])
    few = count <= MOST_BROADCAST
    alone = docs.join(F.broadcast(fate) if few else fate, met, "left_anti").select(*docs.columns)
    if not again:
        return alone
    repeated = fate.where(F.col(_KEPT))
    of_many = docs.join(F.broadcast(repeated) if few else repeated, met).dropDuplicates([_ID, _DIGEST]).select(*docs.columns)
    return alone.unionByName(of_many)

"""Spelling variants: words one edit apart, found by range searches in K-d trees over letter counts.

One inserted or deleted letter changes a word's letter counts by one in all (L1 distance), one
replaced letter by two. So the words near a word lie within distance two of its counts among
the words of its length, and within one among those that are a letter longer. For each length
the upper part of a K-d tree deals words out to cells; a word also visits every cell whose box
comes within the radius. In a cell a K-d tree of its own prunes by boxes, and the order of the
letters decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

#: Letters of a word, and its occurrences in all texts, at least.
MIN_LETTERS, MIN_COUNT = 6, 5
#: A word's form occurs at least so many times as often.
RATIO = 5
#: Counts are kept by code point modulo this; letters that share a place weaken the pruning, never the result.
PLACES = 160
#: Words of a cell, by the upper trees, and points of a leaf in a cell's own tree.
CELL_WORDS, LEAF_WORDS = 4096, 16
#: The upper trees are built from at most about so many words in the driver; this moves work, never results.
SAMPLE = 100_000
#: Visitors of a cell that share one copy of its points, as a multiple of the points.
VISITORS = 8
#: Words counted in a task before they are handed on, and words compared at once.
HELD, BLOCK = 200_000, 2048

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # letters of U+00C0 to U+00FF are \xc3 and one byte in UTF-8
Rewrite = Callable[[int | None, bytes], bytes]


def _letters(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def _counted(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None, least: int) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in slices(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            runs = Counter(_RUN.findall((text.as_py() or "").encode("utf-8", "surrogatepass").lower()))
            for run, n in runs.items():
                if len(run) >= least:
                    word = rewrite(doc_id, run) if rewrite else run
                    if _letters(word) >= least:
                        held[word] += n
            if len(held) >= HELD:
                yield flush()
    if held:
        yield flush()


def count_words(docs: DataFrame, rewrite: Rewrite | None = None, least_letters: int = MIN_LETTERS, least_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the letter runs of docs(doc_id, text), A-Z lower-cased, that are long and frequent enough.

    rewrite(doc_id, run) may change a run first. Counts are summed in each task before they
    are shuffled by word. Null and empty texts have no words; a null doc_id reaches rewrite as
    None; every row counts, repeated ones too; other columns are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lambda it: _counted(it, rewrite, least_letters), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def code_points(words: list[str], length: int) -> np.ndarray:
    """One row of code points for each word; all have the same length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64).reshape(len(words), length)


def letter_counts(points: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(points)), points.shape[1])
    return np.bincount(rows * PLACES + (points % PLACES).ravel(), minlength=len(points) * PLACES).reshape(len(points), PLACES).astype(np.int32)


class Tree:
    """A K-d tree: nodes in preorder, each with a box; leaves hold points or are numbered cells."""

    def __init__(self, points: np.ndarray, leaf: int, closed: bool):
        """closed: boxes end at the points. Otherwise they fill the space, for points not seen here."""
        self.low, self.high, self.after, self.members = [], [], [], []
        self.leaves = 0
        floor, ceiling = np.zeros(points.shape[1], dtype=np.int32), np.full(points.shape[1], np.iinfo(np.int32).max, dtype=np.int32)
        todo: list[tuple[np.ndarray, np.ndarray, np.ndarray] | int] = [(np.arange(len(points)), floor, ceiling)]
        while todo:
            item = todo.pop()
            if isinstance(item, int):  # all below that node is done
                self.after[item] = len(self.low)
                continue
            at, low, high = item
            here, node = points[at], len(self.low)
            if closed:
                low, high = here.min(axis=0), here.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.after.append(node + 1)
            split = self._split(here) if len(at) > leaf else None
            if split is None:
                self.members.append((self.leaves, at))
                self.leaves += 1
                continue
            self.members.append(None)
            axis, bound = split
            left = here[:, axis] <= bound
            upto, beyond = high.copy(), low.copy()
            upto[axis], beyond[axis] = bound, bound + 1
            todo += [node, (at[~left], beyond, high), (at[left], low, upto)]

    @staticmethod
    def _split(here: np.ndarray) -> tuple[int, int] | None:
        """The axis and bound that part the points most evenly; None if all are equal."""
        axes = np.flatnonzero(here.max(axis=0) > here.min(axis=0))
        best = None
        for axis in axes[np.argsort(-here[:, axes].var(axis=0))][:8]:
            ordered = np.sort(here[:, axis])
            middle = ordered[(len(ordered) - 1) // 2]
            for bound in (middle, middle - 1):
                part = np.searchsorted(ordered, bound, side="right")
                even = min(part, len(ordered) - part)
                if even and (best is None or even > best[0]):
                    best = (even, int(axis), int(bound))
        return best and best[1:]

    def within(self, asked: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, its points, rows of asked whose distance to its box is at most radius)."""
        if not self.low:
            return
        stack = [(0, np.arange(len(asked)))]
        while stack:
            node, rows = stack.pop()
            q = asked[rows]
            gap = (np.maximum(self.low[node] - q, 0) + np.maximum(q - self.high[node], 0)).sum(axis=1, dtype=np.int32)
            rows = rows[gap <= radius]
            if not len(rows):
                continue
            if self.members[node] is not None:
                yield *self.members[node], rows
                continue
            left = node + 1
            stack += [(left, rows), (self.after[left], rows)]


def _replaced(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one != two).sum(axis=1) == 1


def _inserted(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether the shorter word is the longer one without one letter: their equal start and end cover it."""
    n = shorter.shape[1]
    start = np.cumprod(longer[:, :n] == shorter, axis=1).sum(axis=1)
    end = np.cumprod((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(axis=1)
    return start + end >= n


def near_in(points: list[str], visitors: list[str]) -> list[tuple[int, int]]:
    """(point, visitor) pairs one edit apart: points of one length, visitors of that length or a letter shorter.

    Of a pair of one length only the one whose visitor is smaller.
    """
    if not points or not visitors:
        return []
    length = len(points[0])
    code, out = code_points(points, length), []
    counts = letter_counts(code)
    used = np.flatnonzero(counts.any(axis=0))
    kind = np.int8 if length < 128 else np.int32

    def narrow(wide: np.ndarray) -> np.ndarray:
        """The counts at the places that points use, and the sum of all others."""
        part = wide[:, used]
        return np.column_stack([part, wide.sum(axis=1) - part.sum(axis=1)]).astype(kind)

    counts = narrow(counts)
    tree = Tree(counts, LEAF_WORDS, closed=True)
    for size, radius, fits in ((length, 2, _replaced), (length - 1, 1, _inserted)):
        these = [k for k, w in enumerate(visitors) if len(w) == size]
        for lo in range(0, len(these), BLOCK):
            part = these[lo : lo + BLOCK]
            asked = code_points([visitors[k] for k in part], size)
            asked_counts = narrow(letter_counts(asked))
            for _, at, rows in tree.within(asked_counts, radius):
                far = np.abs(asked_counts[rows][:, None, :] - counts[at][None, :, :]).sum(axis=2, dtype=np.int32)
                r, p = np.nonzero(far == radius if size == length else far <= radius)
                r, p = rows[r], at[p]
                ok = fits(code[p], asked[r])
                out += [(a, part[b]) for a, b in zip(p[ok].tolist(), r[ok].tolist()) if size < length or visitors[part[b]] < points[a]]
    return out


def _upper_trees(words: DataFrame) -> dict[int, tuple[Tree, int]]:
    """For each length with more words than a cell: the tree that deals them out, and the copies of its cells."""
    weight = F.sum(F.greatest(F.lit(1.0), F.col("length") / 16.0))
    large = [(r["length"], r["n"], r["w"]) for r in words.groupBy("length").agg(F.count("*").alias("n"), weight.alias("w")).where(F.col("w") > CELL_WORDS).collect()]
    if not large:
        return {}
    share = min(1.0, SAMPLE / sum(n for _, n, _ in large))
    drawn: dict[int, list[str]] = {}
    lengths = [length for length, _, _ in large]
    for r in words.where(F.col("length").isin(lengths) & (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(share * 1_000_000))).select("word", "length").collect():
        drawn.setdefault(r["length"], []).append(r["word"])
    out = {}
    for length, _, weight in large:
        seen = sorted(drawn.get(length, []))
        if not seen:
            continue
        cells = max(2, int(np.ceil(weight / CELL_WORDS)))
        tree = Tree(letter_counts(code_points(seen, length)), max(1, len(seen) // cells), closed=False)
        tree.members = [m and (m[0], m[1][:0]) for m in tree.members]
        depth = int(np.ceil(np.log2(max(2, tree.leaves))))
        out[length] = (tree, -(-(1 + depth + depth * (depth - 1) // 2) // VISITORS))
    return out


def _routed(batches: Iterator[pa.RecordBatch], trees: dict[int, tuple[Tree, int]]) -> Iterator[pa.RecordBatch]:
    """Each word once a copy of its own cell as a point, and once for each cell near it as a visitor."""
    for batch in slices(batches, 10_000):
        words, lengths = batch.column("word").to_pylist(), np.array([len(w) for w in batch.column("word").to_pylist()], dtype=np.int64)
        dealt = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.int64)
        rows: list[tuple[np.ndarray, int, int, np.ndarray, bool]] = []
        for size in np.unique(lengths).tolist():
            these = np.flatnonzero(lengths == size)
            counts = letter_counts(code_points([words[k] for k in these], size))
            for length, radius in ((size, 2), (size + 1, 1)):
                tree, copies = trees.get(length, (None, 1))
                if length == size:
                    homes = tree.within(counts, 0) if tree else [(0, None, np.arange(len(these)))]
                    for cell, _, at in homes:
                        rows += [(these[at], length, cell, np.full(len(at), c), True) for c in range(copies)]
                for cell, _, at in tree.within(counts, radius) if tree else [(0, None, np.arange(len(these)))]:
                    rows.append((these[at], length, cell, dealt[these[at]] % copies, False))
        if rows:
            taken = np.concatenate([r[0] for r in rows])
            many = [len(r[0]) for r in rows]
            columns = [np.repeat([r[1] for r in rows], many), np.repeat([r[2] for r in rows], many), np.concatenate([r[3] for r in rows])]
            plain = batch.select(["word", "n"]).take(pa.array(taken))
            yield pa.record_batch([*plain.columns, *(pa.array(c, pa.int32()) for c in columns), pa.array(np.repeat([r[4] for r in rows], many), pa.bool_())], names=["word", "n", "length", "cell", "copy", "point"])


def _near_in_cell(table: pa.Table) -> pa.Table:
    points, visitors = table.filter(table.column("point")), table.filter(pc.invert(table.column("point")))
    pairs = near_in(points.column("word").to_pylist(), visitors.column("word").to_pylist())
    one, two = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
    a, b = points.take(one), visitors.take(two)
    return pa.table([a.column("word"), a.column("n"), b.column("word"), b.column("n")], names=["a", "a_n", "b", "b_n"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of the distinct words (word, n) that are one edit apart, each once."""
    plain = words.select("word", F.col("n").cast("long").alias("n"), F.length("word").alias("length")).where("length > 0")
    trees = _upper_trees(plain)
    routed = plain.select("word", "n").mapInArrow(lambda it: _routed(it, trees), "word string, n long, length int, cell int, copy int, point boolean")
    return routed.groupBy("length", "cell", "copy").applyInArrow(_near_in_cell, "a string, a_n long, b string, b_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following (word, form) to the last; each round doubles the steps taken."""
    current = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(current.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        current = stepped.drop("moved")
        if not stepped.where("moved").limit(1).count():
            return current


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each of the distinct words (word, n).

    A word's form is the most frequent word one inserted, deleted or replaced code point away
    (ties: the smallest in code-point order), if that one occurs at least ratio times as often;
    root is where forms lead, the word itself without one. Words of any length are compared
    whole. Null and empty words are near none. An empty table gives an empty result; a word
    that comes twice must be summed first, as count_words does. Other columns are dropped. A
    word has at most as many near words as there are single edits, so no key is unbounded.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    met = materialise(near_words(words), "near")
    both = met.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(met.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    wide = words.join(best, "word", "left").withColumn("form_n", -F.col("best.less"))
    follows = F.col("form_n") >= ratio * F.col("n")
    judged = materialise(wide.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("best.form")).alias("form"), F.when(follows, F.col("form_n")).alias("form_n")), "forms")
    root = _roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

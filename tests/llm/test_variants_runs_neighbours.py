"""Nearest neighbours, spelling variants and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import periodic_runs, queries, small_world, spelling

SF = "/root/testdata/sf0.001"
ODD = [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "ab " * 9), (9004, "ab " * 30), (9004, "ab " * 30), (None, "x y z " * 20), (9005, "one two three " * 60_000), (9006, "Été Été été ÷× aaaaaaᄀbbbbbb aaaaaa\U0001f600"), (9007, "a b\x1cc \x85 d e")]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    clash = {c: F.lit("clash") for c in ("n", "word", "runs", "length", "cell", "collapsed", "n_words", "form", "node", "vec")}
    return plain.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumns(clash).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# ---- periodic runs


def all_runs(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 2 * q):
                out.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.choice([1, 2, 2, 3])
        root = [rng.randrange(letters) for _ in range(rng.randint(1, 9))] * 20
        words = root[: rng.randint(0, 50)] + [rng.randrange(letters) for _ in range(rng.randint(0, 40))] + root[: rng.randint(0, 30)]
        least = rng.choice([1, 2, 12])
        two = np.array(words + words, dtype=np.int64)  # texts side by side never share a run
        got = periodic_runs.maximal_runs(two, np.repeat([0, 1], len(words)), least).tolist()
        want = [list(r) for r in all_runs(words, least)]
        assert got == want + [[s + len(words), n, q] for s, n, q in want]


def test_close_progressions():
    words = [ord(c) for c in "abababababaabababab" + "c" + "aabaabaabaaabaabaab" * 3]
    assert periodic_runs.maximal_runs(np.array(words), np.zeros(len(words), dtype=np.int64), 2).tolist() == [list(r) for r in all_runs(words, 2)]


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_op13(docs, rows):
    got = Counter(tuple(r) for r in periodic_runs.run_digests(periodic_runs.periodic_runs(docs, queries.repeated_from_within)).collect())
    want = Counter()
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = all_runs(words) if len(words) < 3000 else [(0, len(words), 3)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
        want[(doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)] += 1
    assert got == want and sum(r[1] > 0 for r in want) > 10


def test_runs_of_nothing(docs):
    found = periodic_runs.run_digests(periodic_runs.periodic_runs(docs.where("false")))
    assert found.collect() == [] and found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


# ---- spelling variants


def edits(words):
    """Pairs one edit apart, by the words with one place left out."""
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
            if (o := w[:k] + w[k + 1 :]) in near:
                near[w].add(o)
                near[o].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    return near


def variants(counts):
    near, form, out = edits(counts), {}, set()
    for w in counts:
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def judged(frame):
    return {tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_op12(docs, rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    assert judged(spelling.spelling_variants(spelling.count_words(docs, queries.one_letter_lost))) == want
    assert sum(r[1] is not None for r in want) > 3 and judged(spelling.spelling_variants(spelling.count_words(docs.where("false")))) == set()


@pytest.mark.parametrize("cell", [4096, 60])
def test_variants_over_many_cells(spark, monkeypatch, cell):
    """Few letters, short and long words, chains of forms, ties, letters beyond the first plane."""
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    monkeypatch.setattr(spelling, "LEAF_WORDS", 3)
    monkeypatch.setattr(spelling, "VISITORS", 2)
    rng = random.Random(cell)
    counts = {"".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.choice([1, 2, 5, 5, 5, 5, 6, 6, 6, 7]))): rng.choice([1, 1, 5, 5, 25, 125, 700]) for _ in range(1500)}
    counts |= {"z" * 200: 9, "z" * 201: 50, "z" * 202: 300, "z" * 100 + "y" + "z" * 100: 1, "": 3}
    got = judged(spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)))
    assert {r for r in got if r[0]} == {r for r in variants({w: n for w, n in counts.items() if w})}
    assert [r for r in got if not r[0]] == [("", None, "", 3, 0, None)]
    chained = {r[0]: r for r in got}
    assert chained["z" * 200][1:3] == ("z" * 201, "z" * 202)


# ---- nearest neighbours


def exact(rows, k):
    """By query: (rank, vec_id, score) over all valid rows but its own."""
    valid = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in valid:
        if i % 100 == 0:
            near = sorted({(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in valid if j != i and len(w) == len(v)})
            out.setdefault(i, []).extend(near[:k])
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def asked(rows):
    return rows.where(F.col("vec_id") % 100 == 0)


def test_op11_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    index = small_world.build_index(rows, shard_nodes=600)
    assert index["graphs"].count() == 4 and index["graphs"].select(F.sum(F.size("nodes"))).first()[0] == index["nodes"].count()
    got, want = found(small_world.search(index, asked(rows))), exact([(r[0], r[1]) for r in rows.collect()], 10)
    assert got.keys() == want.keys() and all(len(x) == 10 and x == sorted(x) for x in got.values())
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.97 * 10 * len(want)
    true = dict((q, dict((j, s) for s, j in w)) for q, w in want.items())
    assert all(abs(s - true[q].get(j, s)) < 1e-12 for q, x in got.items() for s, j in x)


def test_neighbours_of_copies_and_odd_rows(spark):
    """Hot copies, ties, null, zero, infinite, short and repeated vectors; a small index is searched whole."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(1, 400)]
    rows += [(i, [1.5, 1.5, 1.5, 1.5]) for i in range(400, 900)]
    rows += [(900, None), (1000, []), (1100, [0.0] * 4), (1200, [1.0, None, 2.0, 3.0]), (1300, [float("inf"), 1.0, 1.0, 1.0]), (1400, [float("nan"), 1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0]), (1500, [1.0, 2.0]), (1501, [1.0, 3.0]), (1600, [5.0]), (100, rows[99][1])]
    frame = spark.createDataFrame(rows, "vec_id long, vec array<double>").withColumn("node", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("dim", F.lit(1))
    index = small_world.build_index(frame)
    got = found(small_world.search(index, asked(frame)))
    want = exact(rows, 10)
    assert {q: [(round(s, 9), j) for s, j in x] for q, x in got.items()} == {q: [(round(s, 9), j) for s, j in x] for q, x in want.items() if x}
    assert [j for _, j in got[500]] == list(range(400, 410)) and got[1500][0][1] == 1501 and 1600 not in got
    assert small_world.search(index, frame.where("false")).count() == 0
    empty = small_world.build_index(frame.where("false"))
    assert empty["graphs"].count() == 0 and small_world.search(empty, asked(frame)).count() == 0
    with pytest.raises(ValueError):
        small_world.search(index, frame, k=small_world.MEMBERS)

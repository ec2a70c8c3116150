"""Results that an earlier, narrower form of the operators missed."""

import random

import pytest

from scriptorium.llm import line_align, near_copies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def planted():
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 3000)}"
    out = []
    for _ in range(20):
        base = [word() for _ in range(rng.choice([4, 12, 60, 200]))]
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            out.append(" ".join(word() if rng.random() < share else w for w in base))
    passage = [word() for _ in range(15)]
    out += [" ".join([*passage, *(word() for _ in range(rng.randint(0, 40)))]) for _ in range(30)]
    return list(enumerate([*out, None, "", " "]))


@pytest.mark.parametrize("frequent, listed", [(1000, 10**6), (3, 10**6), (3, 1)])
def test_near_copies_by_brute_force(spark, monkeypatch, frequent, listed):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "BLOCK", 4)
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    monkeypatch.setattr(near_copies, "MOST_COMMON", listed)
    data = planted()
    sets = {i: shingles(t) for i, t in data}
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while moved := [(a, b) for a, b in pairs if label[a] != label[b]]:
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i in label if label[i] == i}
    assert len(pairs) > 50


@pytest.mark.parametrize("frequent, listed", [(16, 10**6), (16, 1), (10**6, 1)])
def test_common_passage_makes_few_candidates(spark, monkeypatch, frequent, listed):
    """Texts that share a passage, none of them a copy, whatever the list of frequent shingles holds."""
    made = []

    def counting(df, name, codec="zstd"):
        out = near_copies_materialise(df, name, codec)
        made.extend([out.count()] if name in ("met", "candidates") else [])
        return out

    near_copies_materialise = near_copies.materialise
    monkeypatch.setattr(near_copies, "materialise", counting)
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    monkeypatch.setattr(near_copies, "MOST_COMMON", listed)
    passage = words_of("shared", 60)
    data = [(k, f"{words_of(f'a{k}', 70)} {passage} {words_of(f'b{k}', 70)}") for k in range(300)]
    kept = near_copies.keep_one_of_each_group(spark.createDataFrame(data, "doc_id long, text string").repartition(4))
    assert kept.count() == 300 and sum(made) < 10 * 300


def test_one_of_repeated_and_nameless_rows_stays(spark):
    long, other = words_of("l", 50), words_of("o", 50)
    data = [(1, long), (1, long), (None, long), (2, long + " end"), (None, other), (None, other), (3, "x"), (3, "y"), (None, None), (4, ""), (4, " ")]
    frame = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS kept", "3 AS rows")
    kept = near_copies.keep_one_of_each_group(frame)
    assert kept.columns == frame.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    assert got[:5] == sorted([(1, long), (0, other), (3, "x"), (3, "y"), (4, got[4][1])]) and len(got) == 5 and not got[4][1].strip()
    assert near_copies.keep_one_of_each_group(frame.where("false")).collect() == []


def test_parity_bits_never_lose_a_similar_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(400):
        whole = np.unique(rng.integers(-(2**62), 2**62, rng.integers(1, 700)))
        other = np.unique(np.concatenate([whole[rng.random(len(whole)) > rng.choice([0.0, 0.05, 0.1, 0.3])], rng.integers(-(2**62), 2**62, rng.integers(0, 60))]))
        common = len(np.intersect1d(whole, other))
        n = np.array([len(whole), len(other)])
        ok = near_copies.differ_little([near_copies.parity_bits(whole), near_copies.parity_bits(other)], n, np.array([0]), np.array([1]))[0]
        assert ok or 5 * common < 4 * (n.sum() - common)


def words_of(tag, n):
    return " ".join(f"{tag}x{k}" for k in range(n))


def deduped(spark, data):
    got = line_align.dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()
    return {r["doc_id"]: r["text"] for r in got}


def test_block_of_lines_that_others_own(spark):
    one, two, three, tail = words_of("p", 20), words_of("q", 20), words_of("r", 20), words_of("s", 5)
    passage = "\n".join([one, two, three, tail])
    data = [(1, one + "\nalone a"), (2, "alone b\n" + two), (3, three + "\nalone c"), (4, tail), (100, passage), (200, "own\n" + passage)]
    got = deduped(spark, data)
    assert got[200] == "own" and all(got[i] == t for i, t in data if i < 200)


def test_runs_cover_every_line_of_a_block():
    rng = random.Random(3)
    for _ in range(300):
        sizes = {k: rng.randint(1, 12) for k in range(rng.randint(1, 12))}
        lines = [(k, k) for k in sizes]
        runs = line_align._runs(lines, sizes, 30)
        assert all(sum(sizes[k] for k in range(a, b)) >= 30 for a, b in runs)
        for a in sizes:
            for b in range(a + 1, len(sizes) + 1):
                if sum(sizes[k] for k in range(a, b)) >= 30:
                    assert {k for c, d in runs if a <= c and d <= b for k in range(c, d)} == set(range(a, b))


@pytest.mark.parametrize("earlier, later, left", [("TTP", "TP", ""), ("PQPQ", "QPQP", ""), ("TP", "TTP", "T"), ("AB", "BA", "BA")])
def test_blocks_of_repeated_lines(spark, earlier, later, left):
    text = lambda letters: "\n".join(words_of(c, 26) for c in letters)
    got = deduped(spark, [(1, text(earlier)), (2, text(later))])
    assert got == {1: text(earlier), 2: text(left)}


def test_alignment_by_brute_force(spark):
    rng = random.Random(11)
    sizes = {c: rng.randint(4, 26) for c in "abcdef"}
    letters = {i: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 7))) for i in range(60)}
    got = deduped(spark, [(i, "\n".join(words_of(c, sizes[c]) for c in x)) for i, x in letters.items()])
    for i, x in letters.items():
        gone = set()
        for a in range(len(x)):
            for b in range(a + 1, len(x) + 1):
                if sum(sizes[c] for c in x[a:b]) >= 30 and any(x[a:b] in letters[k] for k in range(i)):
                    gone |= set(range(a, b))
        assert got[i] == "\n".join(words_of(c, sizes[c]) for k, c in enumerate(x) if k not in gone)


def test_rows_of_one_id_lose_only_their_own_copies(spark):
    block, other = words_of("c", 40), words_of("d", 43)
    got = line_align.dedup_lines(spark.createDataFrame([(1, block + "\nx"), (5, "y\n" + block), (5, "z\n" + other), (5, "z\n" + other), (None, block)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(1, block + "\nx"), (5, "y"), (5, "z\n" + other), (5, "z\n" + other), (0, block)])


def test_block_whose_lines_stand_alone_elsewhere(spark):
    lines = [words_of(c, 20) for c in "vwxyz"]
    data = [*((k, f"{line}\nown {k}") for k, line in enumerate(lines, 1)), (10, "\n".join(lines)), (11, "\n".join(lines))]
    got = deduped(spark, data)
    assert got[11] == "" and all(got[i] == t for i, t in data if i < 11)
    kept = line_align.dedup_lines(spark.createDataFrame([*data, (12, ""), (13, None)], "doc_id long, text string"), counted=False, keep_emptied=False)
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 10, 12, 13}


def test_reversed_lines_take_little_time():
    import time

    import pyarrow as pa

    n = 100_000
    lines = [{"owner": 1, "owner_h": 1, "line_no": k, "h": k * 7919, "words": 30, "theirs": [n - k]} for k in range(n)]
    kind = pa.list_(pa.struct([("owner", pa.int64()), ("owner_h", pa.int64()), ("line_no", pa.int32()), ("h", pa.int64()), ("words", pa.int32()), ("theirs", pa.list_(pa.int32()))]))
    batch = pa.record_batch([pa.array([2], pa.int64()), pa.array([2], pa.int64()), pa.array([lines], kind)], names=["doc_id", "text_h", "rows"])
    began = time.time()
    (out,) = line_align._align(iter([batch]), 30)
    assert out.column("deleted")[0].as_py() == list(range(n)) and time.time() - began < 20


def test_repeated_rows_make_one_list(spark, monkeypatch):
    sizes = []
    real = line_align.materialise

    def looked_at(df, name, codec="zstd"):
        out = real(df, name, codec)
        if name == "by_doc":
            sizes.extend(len(r["rows"]) for r in out.collect())
        return out

    monkeypatch.setattr(line_align, "materialise", looked_at)
    text = "\n".join(words_of(c, 20) for c in "abc")
    got = line_align.dedup_lines(spark.createDataFrame([(1, text)] + [(2, text)] * 500, "doc_id long, text string")).groupBy("doc_id", "text").count().collect()
    assert sorted(map(tuple, got)) == [(1, text, 1), (2, "", 500)] and sizes == [3, 3]

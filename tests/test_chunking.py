import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import chunking as C
from scriptorium.operators.vectors import hashing_encoder


def test_windows():
    assert [r["content"] for r in C.chunk_rows("A" * 300, 100, 0)] == ["A" * 100] * 3
    assert C.chunk_rows("", 100, 10) == C.chunk_rows(" \n", 100, 10) == C.chunk_rows(None, 100, 10) == []
    rows = C.chunk_rows("A" * 100 + " " + "B" * 100, 110, 20)
    assert rows[0]["content"] == "A" * 100 and rows[0]["end_char"] == 101
    assert C.chunk_rows("One two. Three four five. Six seven eight nine.", 30, 0)[0]["content"] == "One two. Three four five."


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n!", max_size=300), st.integers(5, 40), st.integers(0, 4), st.sampled_from(["burst", "skip"]))
def test_window_properties(text, size, overlap, mode):
    rows = C.chunk_rows(text, size, overlap, mode)
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r["content"] == text[r["start_char"] : r["end_char"]].strip() and len(r["content"]) <= size
    if text.strip():
        assert "".join(text.split()) and rows[-1]["end_char"] <= len(text)


def test_markdown(spark):
    text = "intro\n# T\na\n### Deep\nb\n## S\nc"
    docs = spark.createDataFrame([("d", text), ("plain", "no header")], "source string, content string")
    rows = {(r["source"], r["chunk_index"]): r for r in C.split_markdown(docs).collect()}
    assert [rows["d", k]["header_path"] for k in range(4)] == ["", "# T", "# T > ### Deep", "# T > ## S"]
    assert rows["plain", 0]["content"] == "no header"
    long = spark.createDataFrame([("d", "# H\n" + "x" * 500)], "source string, content string")
    assert max(len(r["content"]) for r in C.split_markdown(long, 100, 10).collect()) <= 100


def test_long_sentence():
    assert C.split_long_sentence("short") == ["short"]
    assert C.split_long_sentence("aa, bb, cc", 5) == ["aa,", "bb,", "cc"]
    assert C.split_long_sentence("aaaa bbbb", 5) == ["aaaa bbbb", "aaaa", "bbbb"]


def test_semantic(spark):
    text = " ".join(f"This is sentence number {k}." for k in range(100))
    docs = spark.createDataFrame([("d", text), ("short", "tiny text."), ("blank", "  "), ("null", None)], "source string, content string")
    rows = C.split_semantic(docs, hashing_encoder(), size=500, overlap=50, threshold=0.3).collect()
    mine = sorted((r for r in rows if r["source"] == "d"), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in mine] == list(range(len(mine))) and all(len(r["content"]) <= 500 for r in mine)
    assert {r["source"] for r in rows} == {"d", "short"}
    assert sum(r["sentence_count"] for r in mine) == 100


def test_groups_follow_direction():
    v = np.array([[1.0, 0], [0.9, 0.1], [0, 1.0]])
    assert C.semantic_groups(["a", "b", "c"], v, 0.5, 100) == [[0, 1], [2]]
    assert C.semantic_groups(["a", "b", "c"], v, 0.5, 2) == [[0], [1], [2]]


def test_pdf_pages(spark):
    pages = spark.createDataFrame([("f", 2, "two"), ("f", 1, "o-\nne"), ("f", 3, "  ")], "source string, page_num int, page_text string")
    assert C.assemble_pdf_pages(pages).select(F.col("content")).first()[0] == "one\n\ntwo"


def test_semantic_falls_back_to_characters(spark):
    def encode(sentences):
        if any("bad" in s for s in sentences):
            raise ValueError("no vector")
        return hashing_encoder()(sentences)

    good, bad = (" ".join(f"This {w} sentence has number {k}." for k in range(30)) for w in ("good", "bad"))
    docs = spark.createDataFrame([("g", good), ("b", bad)], "source string, content string")
    kinds = {r["source"]: r["chunking_strategy"] for r in C.split_semantic(docs, encode).collect()}
    assert kinds == {"g": "semantic", "b": None}
    assert C.chunk_documents(docs.withColumn("extension", F.lit(".txt")), "semantic").count() > 0


def test_overlap_and_long_clauses():
    assert C._overlap(["A one. B two.", "C three.", "D four."], 8, 100) == ["A one. B two.", "B two. C three.", "D four."]
    assert C._overlap(["A one. B two.", "C three."], 7, 12) == ["A one. B two.", "C three."]
    assert C.split_long_sentence("x" * 12 + "," + "a b", 5) == ["x" * 12, ",a b"]


def test_long_sentences(spark):
    table = spark.createDataFrame([("d", 0, "short"), ("d", 1, "aa, bb, cc"), ("e", 0, None)], "source string, pos int, sentence string")
    got = sorted(tuple(r) for r in C.long_sentences(table, 6).where("source = 'd'").collect())
    assert got == [("d", 0, "short"), ("d", 1, "aa, bb"), ("d", 2, ", cc")]

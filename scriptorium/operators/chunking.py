"""Chunking: character windows, Markdown sections, and groups of similar sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scriptorium.functions.text import WHITE_SPACE, normalize_pdf_text, split_sentences, strip

from .vectors import hashing_encoder

#: Fixed cut marks, best first.
CUT_MARKS = ("\n\n", "\n", ". ", "? ", "! ", "。", " ")
CHUNK = "array<struct<chunk_index:int,start_char:int,end_char:int,content:string>>"
SHORTEST_SEMANTIC, LONGEST_SENTENCE = 50, 2000
#: Sentences of a call to an encoder, at least, while documents last.
SENTENCES_AT_ONCE = 4096
#: Chunks that a task hands on at once.
CHUNKS_AT_ONCE = 4096
Encoder = Callable[[list[str]], np.ndarray]


def window_cuts(text: str, size: int, overlap: int, short_cut: str = "burst") -> Iterator[tuple[int, int]]:
    """(start, cut) of each window.

    With short_cut="skip" a window that would move on by one character only, because its
    cut lies within the overlap, moves on to its cut instead.
    """
    start, n = 0, len(text)
    while start < n:
        stop = start + size
        cut = n
        if stop < n:
            cut = next((at + len(mark) for mark in CUT_MARKS if (at := text.rfind(mark, start, stop)) > start), stop)
        yield start, cut
        if cut >= n:
            return
        back = cut - overlap
        start = back if back > start else (cut if short_cut == "skip" else start + 1)


def chunk_rows(text: str | None, size: int, overlap: int, short_cut: str = "burst") -> list[dict]:
    """Non-blank windows of a text; blank texts have none."""
    if not text or not text.strip():
        return []
    spans = ((a, b, text[a:b].strip()) for a, b in window_cuts(text, size, overlap, short_cut))
    kept = [s for s in spans if s[2]]
    return [{"chunk_index": k, "start_char": a, "end_char": b, "content": c} for k, (a, b, c) in enumerate(kept)]


def split_text(text: Column, size: int = 1000, overlap: int = 150, short_cut: str = "burst") -> Column:
    """An array of chunk structs for each text."""

    @F.pandas_udf(CHUNK)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_rows(t, size, overlap, short_cut))

    return cut(text)


def _cut_in_batches(batches: Iterator[pa.RecordBatch], size: int, overlap: int, short_cut: str, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The chunks of each batch of (source, content), handed on CHUNKS_AT_ONCE at a time, or a text's own if they are more."""
    columns: list[list] = [[] for _ in shape]
    for batch in batches:
        for at in range(batch.num_rows):
            source, text = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            for row in chunk_rows(text, size, overlap, short_cut):
                for column, value in zip(columns, (source, *row.values())):
                    column.append(value)
            if len(columns[0]) >= CHUNKS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)
                columns = [[] for _ in shape]
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape)], schema=shape)


def split_documents(docs: DataFrame, size: int = 1000, overlap: int = 150, short_cut: str = "burst") -> DataFrame:
    """(source, content) to character chunks; an overlap of 0 is kept."""
    out = T.StructType([docs.schema["source"], *(T.StructField(n, T.IntegerType()) for n in ("chunk_index", "start_char", "end_char")), T.StructField("content", T.StringType())])
    shape = to_arrow_schema(out)
    cut = docs.select("source", "content").mapInArrow(lambda batches: _cut_in_batches(batches, size, overlap, short_cut, shape), out)
    return cut.withColumn("header_path", F.lit(""))


def chunk_text(docs: DataFrame, size: int | None = None, overlap: int | None = None, short_cut: str = "burst") -> DataFrame:
    """(source, content) to chunks, whatever the extension; zero or None means the default."""
    return split_documents(docs, size or 1000, overlap or 150, short_cut)


_HEADER = re.compile(r"^(#{1,6})\s+(.+)$", re.MULTILINE)
SECTION = "array<struct<level:int,title:string,content:string,start_pos:int,end_pos:int>>"


def section_rows(text: str | None) -> list[dict]:
    """Sections of a Markdown text, each from its header to the next."""
    if not text or not text.strip():
        return []
    heads = [(m.start(), len(m[1]), m[2].strip()) for m in _HEADER.finditer(text)]
    if not heads:
        return [{"level": 0, "title": "", "content": text, "start_pos": 0, "end_pos": len(text)}]
    bounds = [at for at, _, _ in heads] + [len(text)]
    rows = [{"level": level, "title": title, "content": text[a:b].strip(), "start_pos": a, "end_pos": b} for (a, level, title), b in zip(heads, bounds[1:])]
    preamble = text[: bounds[0]].strip()
    if preamble:
        rows.insert(0, {"level": 0, "title": "", "content": preamble, "start_pos": 0, "end_pos": bounds[0]})
    return rows


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(source, section_idx, level, title, content, start_pos, end_pos)."""

    @F.pandas_udf(SECTION)
    def sections(texts: pd.Series) -> pd.Series:
        return texts.map(section_rows)

    return docs.select("source", F.posexplode(sections("content")).alias("section_idx", "s")).select("source", "section_idx", "s.*")


def with_header_paths(sections: DataFrame) -> DataFrame:
    """header_path: the nearest earlier header of every lower level that no still lower one interrupts."""
    w = Window.partitionBy("source").orderBy("section_idx").rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct(F.col("section_idx").alias("at"), "title")), ignorenulls=True).over(w) for k in range(1, 7)}
    out = sections.select("*", *[c.alias(f"_h{k}") for k, c in last.items()])
    parts = []
    for k in range(1, 7):
        here = F.col(f"_h{k}")
        newest_above = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"_h{j}.at"), F.lit(-1)) for j in range(1, k)]) if k > 1 else F.lit(-1)
        shown = (F.col("level") >= k) & here.isNotNull() & (here["at"] > newest_above)
        parts.append(F.when(shown, F.concat(F.lit("#" * k + " "), here["title"])))
    return out.withColumn("header_path", F.concat_ws(" > ", *parts)).drop(*[f"_h{k}" for k in range(1, 7)])


def split_markdown(docs: DataFrame, size: int = 1000, overlap: int = 150, short_cut: str = "burst") -> DataFrame:
    """Chunks that keep to Markdown sections; long sections are cut by characters."""
    sections = with_header_paths(markdown_sections(docs))
    whole = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("start_char"), (F.col("end_pos") - F.col("start_pos")).alias("end_char"), F.col("content")))
    cut = split_text(F.when(F.length("content") > size, F.col("content")), size, overlap, short_cut)
    pieces = F.when(F.length("content") > size, cut).when(strip(F.col("content")) != "", whole.cast(CHUNK)).otherwise(F.array().cast(CHUNK))
    rows = sections.select("source", "section_idx", "start_pos", "header_path", F.posexplode(pieces).alias("sub", "c"))
    order = Window.partitionBy("source").orderBy("section_idx", "sub")
    return rows.select(
        "source",
        (F.row_number().over(order) - 1).cast("int").alias("chunk_index"),
        (F.col("start_pos") + F.col("c.start_char")).alias("start_char"),
        (F.col("start_pos") + F.col("c.end_char")).alias("end_char"),
        F.col("c.content").alias("content"),
        "header_path",
    )


def _fill(sizes: list[int], most: int, gap: int = 0) -> list[list[int]]:
    """Indexes of neighbours that share a group of at most `most`; an over-long one stands alone."""
    groups: list[list[int]] = []
    room = -1
    for k, size in enumerate(sizes):
        if groups and size + gap <= room:
            groups[-1].append(k)
            room -= size + gap
        else:
            groups.append([k])
            room = most - size
    return groups


def split_long_sentence(sentence: str, most: int = LONGEST_SENTENCE) -> list[str]:
    """Parts of a sentence that is too long: as many clauses and marks each as fit.

    A clause that alone is too long stays whole; if it is the last one its words follow
    again, as many to a part as fit.
    """
    if len(sentence) <= most:
        return [sentence]
    clauses = re.findall(r"[,;]|[^,;]+", sentence)
    parts = ["".join(clauses[k] for k in group) for group in _fill([len(c) for c in clauses], most)]
    tail = parts.pop()
    out = [p.strip() for p in parts if p.strip()]
    words = tail.split()
    if len(tail) > most and words:
        out.append(tail)
        out.extend(" ".join(words[k] for k in group) for group in _fill([len(w) for w in words], most, 1))
    elif words:
        out.append(tail.strip())
    return out or [sentence]


_SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])$", re.MULTILINE)


def sentence_list(text: str) -> list[str]:
    """Sentences of a text, over-long ones packed into parts."""
    return [part for s in map(str.strip, _SENTENCE_END.split(text)) if s for part in split_long_sentence(s)]


def semantic_groups(sentences: list[str], vectors: np.ndarray, threshold: float, size: int) -> list[list[int]]:
    """Neighbouring sentences that are close to their group's mean direction and fit its size."""
    groups: list[list[int]] = []
    total, length = None, 0
    for k, vector in enumerate(vectors):
        more = len(sentences[k]) + 1
        norm = np.linalg.norm(total) if total is not None else 0.0
        near = groups and float(total @ vector) / (norm if norm > 0 else 1.0) >= threshold
        if near and length + more <= size:
            groups[-1].append(k)
            total, length = total + vector, length + more
        else:
            groups.append([k])
            total, length = vector.astype(np.float64), len(sentences[k])
    return groups


def _mean_similarity(vectors: np.ndarray) -> float:
    if len(vectors) < 2:
        return 0.0
    mean = vectors.mean(axis=0)
    norm = np.linalg.norm(mean)
    return round(float((vectors @ (mean / norm if norm > 0 else mean)).mean()), 3)


def _lead(before: list[str], room: int) -> str:
    """As many of the last sentences, joined, as fit the room; a lone one needs a blank besides."""
    used = np.cumsum([len(x) + 1 for x in reversed(before)]) - 1
    used[:1] += 1
    take = int(np.searchsorted(used, room, side="right"))
    return " ".join(before[len(before) - take :]).strip()


def _overlap(contents: list[str], overlap: int, size: int) -> list[str]:
    """Each content led by the end of the one shown before it, as far as both limits allow."""
    shown: list[str] = []
    for content in contents:
        lead = _lead(sentence_list(shown[-1]), min(overlap, size - len(content))) if shown else ""
        fits = lead and len(lead) + 1 + len(content) <= size
        shown.append(f"{lead} {content}" if fits else content)
    return shown


SEMANTIC = "chunk_index int, start_char int, end_char int, content string, chunking_strategy string, sentence_count int, avg_similarity double"


def semantic_rows(text: str, sentences: list[str], vectors: np.ndarray | None, size: int, overlap: int, threshold: float) -> list[tuple]:
    """Chunks of one text as tuples of SEMANTIC; without vectors its character chunks."""
    if len(sentences) == 1:
        return [(0, 0, len(text), text.strip(), "semantic", 1, 1.0)]
    if vectors is None:
        return [(*r.values(), None, None, None) for r in chunk_rows(text, size, overlap)]
    groups = semantic_groups(sentences, vectors, threshold, size)
    contents = [" ".join(sentences[k] for k in g) for g in groups]
    ends = np.cumsum([len(c) + 1 for c in contents]) - 1
    shown = _overlap(contents, overlap, size) if overlap > 0 else contents
    return [(i, int(e) - len(c), int(e), s, "semantic", len(g), _mean_similarity(vectors[g])) for i, (c, e, s, g) in enumerate(zip(contents, ends, shown, groups))]


def _encoded(lists: list[list[str]], encode: Encoder) -> list[np.ndarray | None]:
    """Vectors of each list of sentences, all encoded in one call; if that fails, of each that does not fail alone."""
    try:
        vectors = np.asarray(encode([s for x in lists for s in x]), dtype=np.float64)
        ends = np.cumsum([len(x) for x in lists])
        return [vectors[e - len(x) : e] for x, e in zip(lists, ends)]
    except Exception:  # an encoder is foreign code
        return [None] * len(lists) if len(lists) < 2 else [v for x in lists for v in _encoded([x], encode)]


def split_semantic(docs: DataFrame, encode: Encoder, size: int = 1000, overlap: int = 150, threshold: float = 0.7) -> DataFrame:
    """Chunks of semantically close sentences; a document is one row, so nothing is shuffled.

    Sentences of SENTENCES_AT_ONCE or more are encoded together, over documents. Blank texts
    have no chunk; short texts, and texts whose encoding fails, are cut by characters.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["source", *[f.split()[0] for f in SEMANTIC.split(", ")]]
        for frame in frames:
            texts = ((s, t) for s, t in zip(frame["source"], frame["content"]) if t and t.strip())
            for part in _parts((s, t, sentence_list(t) if len(t) >= SHORTEST_SEMANTIC else []) for s, t in texts):
                some = [x for _, _, x in part if len(x) > 1]
                vectors = iter(_encoded(some, encode) if some else [])
                rows = [(s, *r) for s, t, x in part for r in semantic_rows(t, x, next(vectors) if len(x) > 1 else None, size, overlap, threshold)]
                out = pd.DataFrame(rows, columns=names)
                out["sentence_count"] = out["sentence_count"].astype("Int32")
                yield out

    return docs.select("source", "content").mapInPandas(run, f"source string, {SEMANTIC}")


def _parts(documents: Iterable[tuple[str, str, list[str]]]) -> Iterator[list[tuple[str, str, list[str]]]]:
    """Neighbouring documents with SENTENCES_AT_ONCE sentences, or as many documents; one part is held at a time."""
    held, n = [], 0
    for d in documents:
        held.append(d)
        n += max(1, len(d[2]))
        if n >= SENTENCES_AT_ONCE:
            yield held
            held, n = [], 0
    if held:
        yield held


def chunk_documents(docs: DataFrame, strategy: str = "auto", encode: Encoder | None = None, size: int = 1000, overlap: int = 150, threshold: float = 0.7) -> DataFrame:
    """(source, extension, content): semantic if asked for, else by Markdown for .md, else by characters.

    Without an encoder the semantic strategy uses the hashing stand-in.
    """
    if strategy == "semantic":
        return split_semantic(docs, encode or hashing_encoder(), size, overlap, threshold).withColumn("header_path", F.lit(""))
    is_md = F.lower(F.coalesce("extension", F.lit(""))) == ".md"
    return split_markdown(docs.where(is_md), size, overlap).unionByName(split_documents(docs.where(~is_md), size, overlap))


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, chunk_count), zero for documents without chunks."""
    counts = chunks.groupBy("source").agg(F.count("*").alias("chunk_count"))
    return docs.select("source").join(counts, "source", "left").select("source", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def assemble_pdf_pages(pages: DataFrame) -> DataFrame:
    """(source, page_num, page_text) to (source, content): cleaned non-blank pages in order."""
    clean = pages.select("source", "page_num", normalize_pdf_text(F.col("page_text")).alias("page"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("page") != "", F.struct("page_num", "page"))))
    return clean.groupBy("source").agg(F.array_join(F.transform(ordered, lambda p: p["page"]), "\n\n").alias("content"))


def sentences(docs: DataFrame, splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """(source, pos, sentence); a splitter plug-in may take a language's own rules; over-long sentences are left whole here."""
    return docs.select("source", F.posexplode((splitter or split_sentences)(F.col("content"))).alias("pos", "sentence"))


def _packed(items: Column, most: int, gap: str) -> Column:
    """Neighbouring strings joined while they fit `most`, folded in order; an over-long one stands alone."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    closed = lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))
    fits = lambda a, x: F.length(a["open"]) + len(gap) + F.length(x) <= most

    def step(a: Column, x: Column) -> Column:
        return F.when(fits(a, x), F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(gap), x).alias("open"))).otherwise(F.struct(closed(a).alias("done"), x.alias("open")))

    return F.aggregate(items, empty, step, closed)


def long_sentences(table: DataFrame, most: int = LONGEST_SENTENCE) -> DataFrame:
    """(source, pos, sentence) with the parts of sentences that are too long, numbered anew.

    The parts are those of split_long_sentence, folded by Spark itself.
    """
    short = table.where(F.coalesce(F.length("sentence") <= most, F.lit(True))).select("source", "pos", F.lit(0).alias("sub"), "sentence")
    packed = table.where(F.length("sentence") > most).select("source", "pos", "sentence", _packed(F.regexp_extract_all("sentence", F.lit("[,;]|[^,;]+"), F.lit(0)), most, "").alias("parts"))
    split = packed.select("source", "pos", "sentence", F.slice("parts", 1, F.size("parts") - 1).alias("first"), F.element_at("parts", -1).alias("tail"))
    words = split.withColumn("words", F.filter(F.split("tail", rf"(?U){WHITE_SPACE}+"), lambda w: w != ""))
    ending = F.when(F.size("words") == 0, F.array().cast("array<string>")).when(F.length("tail") > most, F.concat(F.array("tail"), _packed(F.col("words"), most, " "))).otherwise(F.array(strip(F.col("tail"))))
    found = words.select("source", "pos", "sentence", F.concat(F.filter(F.transform("first", strip), lambda p: p != ""), ending).alias("parts"))
    cut = found.select("source", "pos", F.posexplode(F.when(F.size("parts") > 0, F.col("parts")).otherwise(F.array("sentence"))).alias("sub", "sentence"))
    order = Window.partitionBy("source").orderBy("pos", "sub")
    return short.unionByName(cut).select("source", (F.row_number().over(order) - 1).cast("int").alias("pos"), "sentence")

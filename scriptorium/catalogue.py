"""The registered queries of the document-search operators, each with its SQL oracle.

Documents are keyed by doc_id written as text; the table's own source column is shared by
many documents and stands for the owner of a document where one is needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import bm25, chunking, documents, fusion, manifest, vectors
from scriptorium.plans import answers
from scriptorium.shipping import ship_package
from scriptorium.sources import files, index_store
from scriptorium.storage import shared_dir, spread, stored

Query = Callable[[SparkSession, str], DataFrame]
#: Labels of vectors that are broadcast, at most; two numbers a row.
MOST_LABELS = 2_000_000
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, content, owner."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content"), F.col("source").alias("owner"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunks_of(spark: SparkSession, sf_dir: str, short_cut: str = "burst") -> DataFrame:
    """The corpus in character windows, for the queries that read it once."""
    return chunking.split_documents(corpus(spark, sf_dir), short_cut=short_cut)


def chunk_table(spark: SparkSession, sf_dir: str, short_cut: str = "burst") -> DataFrame:
    """The corpus in character windows, written once for the queries that read it more than once."""
    return stored(chunks_of(spark, sf_dir, short_cut), "chunks")


# ---- text functions

_TABBED = "replace(text, ' the ', chr(9) || ' the ' || '  ')"


@registered(
    rf"""SELECT doc_id, regexp_replace(regexp_replace(replace(replace({_TABBED}, '.' || chr(10), '.  ' || chr(10)), chr(9), '    '), '(?m)[^\S\n]+$', '', 'g'), '[^\S\n]+', ' ', 'g') AS out FROM documents"""
)
def t2_normalize_whitespace(spark, sf_dir):
    raw = F.expr("replace(replace(text, ' the ', concat(chr(9), ' the ', '  ')), concat('.', chr(10)), concat('.  ', chr(10)))")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_whitespace(raw).alias("out"))


@registered(r"SELECT doc_id, regexp_replace(replace(text, '.' || chr(10), '.' || repeat(chr(10), 4)), '\n{3,}', repeat(chr(10), 2), 'g') AS out FROM documents")
def t3_normalize_newlines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_newlines(F.expr("replace(text, concat('.', chr(10)), concat('.', repeat(chr(10), 4)))")).alias("out"))


@registered("SELECT doc_id, text || 'ABC1' AS out FROM documents")
def t1_normalize_unicode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_unicode(F.concat("text", F.lit("ＡＢＣ①"))).alias("out"))


@registered(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || 'ABC1', '(?m)[^\S\n]+$', '', 'g'), '[^\S\n]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS out FROM documents"""
)
def t4_normalize_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.normalize_text(F.concat(F.lit("  "), "text", F.lit("ＡＢＣ①\n"))).alias("out"))


_PDF = r"regexp_replace(replace(replace(text, '. ', '.' || chr(10) || chr(10)), 'tion ', 'ti-' || chr(10) || 'on '), '-\s*\n\s*', '', 'g')"


@registered(
    rf"""SELECT doc_id, regexp_replace(array_to_string(list_transform(regexp_split_to_array({_PDF}, ' *\n\s*\n *'), lambda p: regexp_replace(p, '[ \n]+', ' ', 'g')), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') AS out FROM documents"""
)
def t5_normalize_pdf_text(spark, sf_dir):
    raw = F.expr("replace(replace(text, '. ', concat('.', chr(10), chr(10))), 'tion ', concat('ti-', chr(10), 'on '))")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_pdf_text(raw).alias("out"))


@registered("SELECT doc_id, CAST(length(regexp_replace(text || '한국어', '[^가-힯ᄀ-ᇿ㄰-㆏]', '', 'g')) AS INT) AS ko, CAST(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS INT) AS en FROM documents")
def t6_count_letters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.count_korean_chars(F.concat("text", F.lit("한국어"))).alias("ko"), T.count_ascii_alpha_chars(F.col("text")).alias("en"))


@registered(
    """WITH c AS (SELECT doc_id, 400 * (doc_id % 3) AS ko, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS en FROM documents)
SELECT doc_id, CASE WHEN ko + en = 0 THEN 'unknown' WHEN ko / (ko + en) >= 0.3 THEN 'ko' WHEN en / (ko + en) >= 0.3 THEN 'en' ELSE 'unknown' END AS language FROM c"""
)
def t7_detect_language(spark, sf_dir):
    mixed = F.expr("concat(text, repeat('가', cast(400 * (doc_id % 3) as int)))")
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(mixed).alias("language"))


_SENTENCES = r"""
s AS (SELECT source, unnest(string_split(regexp_replace(regexp_replace(content, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '(?m)([.!?])$', '\1' || chr(1), 'g'), chr(1))) AS raw,
      unnest(range(len(string_split(regexp_replace(regexp_replace(content, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), '(?m)([.!?])$', '\1' || chr(1), 'g'), chr(1))))) AS line_at FROM corpus),
sentences AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY line_at) - 1 AS INT) AS pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS sentence FROM s WHERE regexp_replace(raw, '\s+', '', 'g') <> '')
"""
_CORPUS = "corpus AS (SELECT CAST(doc_id AS VARCHAR) AS source, text AS content, source AS owner FROM documents)"


@registered(f"WITH {_CORPUS}, {_SENTENCES} SELECT source, pos, sentence FROM sentences")
def t8_sentences(spark, sf_dir):
    return chunking.sentences(corpus(spark, sf_dir))


def _cut_long(most: int) -> str:
    """CTEs that cut the long ones of sentences(source, pos, sentence); the last one is cut_sentences. To follow WITH RECURSIVE."""
    return rf"""clauses AS MATERIALIZED (SELECT source, pos, sentence, regexp_extract_all(sentence, '[,;]|[^,;]+') AS x FROM sentences WHERE length(sentence) > {most}),
clause_walk AS (SELECT source, pos, x, 1 AS i, 1 AS g, length(x[1]) AS used FROM clauses
  UNION ALL SELECT source, pos, x, i + 1, CASE WHEN used + length(x[i + 1]) <= {most} THEN g ELSE g + 1 END, CASE WHEN used + length(x[i + 1]) <= {most} THEN used ELSE 0 END + length(x[i + 1]) FROM clause_walk WHERE i < len(x)),
packed AS (SELECT source, pos, g, string_agg(x[i], '' ORDER BY i) AS part FROM clause_walk GROUP BY ALL),
tails AS (SELECT source, pos, max(g) AS last, arg_max(part, g) AS tail, list_filter(regexp_split_to_array(arg_max(part, g), '\s+'), lambda w: w <> '') AS x FROM packed GROUP BY ALL),
word_walk AS (SELECT source, pos, x, 1 AS i, 1 AS g, length(x[1]) AS used FROM tails WHERE length(tail) > {most} AND len(x) > 0
  UNION ALL SELECT source, pos, x, i + 1, CASE WHEN used + 1 + length(x[i + 1]) <= {most} THEN g ELSE g + 1 END, CASE WHEN used + 1 + length(x[i + 1]) <= {most} THEN used + 1 ELSE 0 END + length(x[i + 1]) FROM word_walk WHERE i < len(x)),
parts_of_long AS (SELECT source, pos, g AS a, 0 AS b, regexp_replace(part, '^\s+|\s+$', '', 'g') AS sentence FROM packed JOIN tails USING (source, pos) WHERE g < last AND regexp_replace(part, '\s+', '', 'g') <> ''
  UNION ALL SELECT source, pos, last, 0, CASE WHEN length(tail) > {most} THEN tail ELSE regexp_replace(tail, '^\s+|\s+$', '', 'g') END FROM tails WHERE len(x) > 0
  UNION ALL SELECT source, pos, 1000000, g, string_agg(x[i], ' ' ORDER BY i) FROM word_walk GROUP BY source, pos, g),
cut_sentences AS MATERIALIZED (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY pos, a, b) - 1 AS INT) AS pos, sentence FROM (SELECT source, pos, 0 AS a, 0 AS b, sentence FROM sentences WHERE length(sentence) <= {most}
  UNION ALL SELECT * FROM parts_of_long UNION ALL SELECT source, pos, 0, 0, sentence FROM clauses ANTI JOIN parts_of_long USING (source, pos)))"""


@registered(f"WITH RECURSIVE {_CORPUS}, {_SENTENCES}, {_cut_long(60)} SELECT source, pos, sentence FROM cut_sentences")
def t9_long_sentences(spark, sf_dir):
    """With 60 characters as the most, so that many sentences are too long."""
    return chunking.long_sentences(chunking.sentences(corpus(spark, sf_dir)), 60)


@registered(r"""SELECT doc_id, CAST(len(w) AS INT) AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)""")
def t10_tokenize(spark, sf_dir):
    tokens = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


@registered("SELECT doc_id, sha256(text) AS hash FROM documents")
def t11_file_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.file_hash(F.encode("text", "UTF-8")).alias("hash"))


@registered(
    """SELECT item_id, 0 AS variant_no, text AS query FROM benchmark UNION ALL
SELECT item_id, 1, split_part(text, ' ', 1) || ' one' FROM benchmark UNION ALL SELECT item_id, 2, split_part(text, ' ', 2) || ' two' FROM benchmark"""
)
def m1_expand_queries(spark, sf_dir):
    one = F.concat(F.element_at(F.split("text", " "), 1), F.lit(" one"))
    two = F.concat(F.element_at(F.split("text", " "), 2), F.lit(" two"))
    reply = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.array(one, two)), F.lit("\n```"))
    requests = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("query"), reply.alias("response"))
    return answers.expand_queries(requests).withColumnRenamed("request_id", "item_id")


@registered("""SELECT event_id, CAST(json_object('auth_user', '***MASKED***', 'event', event_type, 'api_key', '***MASKED***') AS VARCHAR) AS record FROM events""")
def t13_mask_sensitive(spark, sf_dir):
    record = F.create_map(F.lit("auth_user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type"), F.lit("api_key"), F.col("props").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(T.mask_sensitive(record)).alias("record"))


@registered("SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS reversed, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS norm2 FROM embeddings")
def t16_cosine_similarity(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(T.dot(e, F.reverse(e)), 6).alias("reversed"), F.round(T.dot(e, e), 6).alias("norm2"))


# ---- chunking

_MARKS = (("\\n\\n", 2), ("\\n", 1), (". ", 2), ("? ", 2), ("! ", 2), ("。", 1), (" ", 1))


def _cut(start: str) -> str:
    window = f"substr(content, {start} + 1, 1000)"

    def option(mark: str, size: int) -> str:
        shown = {"\\n\\n": "chr(10) || chr(10)", "\\n": "chr(10)"}.get(mark, f"'{mark}'")
        found = f"strpos(reverse({window}), reverse({shown}))"
        return f"CASE WHEN {found} > 0 AND 1000 - {found} - {size} + 1 > 0 THEN {start} + 1000 - {found} + 1 END"

    return f"CASE WHEN length(content) - {start} <= 1000 THEN length(content) ELSE coalesce({', '.join(option(*m) for m in _MARKS)}, {start} + 1000) END"


def windows_sql(skip: bool, name: str = "chunks", base: str = "corpus") -> str:
    """CTEs of the character splitter at 1000 and 150 over base(source, content); to follow WITH RECURSIVE."""
    onward = "cut" if skip else "start + 1"
    return f"""{name}_walk AS (SELECT source, content, 0 AS start, CAST({_cut("0")} AS INT) AS cut FROM {base} WHERE trim(content) <> ''
  UNION ALL SELECT source, content, begins, CAST({_cut("begins")} AS INT) FROM (SELECT source, content, CASE WHEN cut - 150 > start THEN cut - 150 ELSE {onward} END AS begins FROM {name}_walk WHERE cut < length(content))),
{name} AS MATERIALIZED (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY start) - 1 AS INT) AS chunk_index, CAST(start AS INT) AS start_char, cut AS end_char, piece AS content
  FROM (SELECT source, start, cut, regexp_replace(substr(content, start + 1, cut - start), '^\\s+|\\s+$', '', 'g') AS piece FROM {name}_walk) WHERE piece <> '')"""


def chunks_sql(skip: bool) -> str:
    """CTEs corpus and chunks."""
    return f"RECURSIVE {_CORPUS}, {windows_sql(skip)}"


@registered(f"WITH {chunks_sql(False)} SELECT source, chunk_index, start_char, end_char, content, '' AS header_path FROM chunks")
def c1_split_text(spark, sf_dir):
    return chunking.split_documents(corpus(spark, sf_dir))


@registered(f"WITH {chunks_sql(True)} SELECT source, chunk_index, start_char, end_char, content, '' AS header_path FROM chunks")
def c1_split_text_skip(spark, sf_dir):
    return chunking.split_documents(corpus(spark, sf_dir), short_cut="skip")


@registered(f"WITH {chunks_sql(False)} SELECT source, chunk_index, start_char, end_char, content, '' AS header_path FROM chunks")
def c13_chunk_text(spark, sf_dir):
    return chunking.chunk_text(corpus(spark, sf_dir), 0, None)


@registered(f"WITH {chunks_sql(False)} SELECT c.source, count(k.source) AS chunk_count FROM corpus c LEFT JOIN chunks k ON c.source = k.source GROUP BY c.source")
def c11_chunk_counts(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return chunking.chunk_counts(docs, chunking.split_documents(docs))


def _markdown(spark, sf_dir):
    """Every whole text, its two halves below headers of their own."""
    docs = table(spark, sf_dir, "documents").withColumn("half", F.expr("cast(length(text) / 2 as int)"))
    body = F.expr("concat('intro ', lang, chr(10), '# ', source, chr(10), chr(10), replace(substring(text, 1, half), '#', '+'), chr(10), '### ', lang, chr(10), replace(substring(text, half + 1), '#', '+'), chr(10), '## ', doc_id, chr(10), 'tail', chr(10), '#### end ', lang, chr(10), 'x')")
    return docs.select(F.col("doc_id").cast("string").alias("source"), body.alias("content"))


_MD = """md AS (SELECT CAST(doc_id AS VARCHAR) AS source, 'intro ' || lang || chr(10) AS a, '# ' || source || chr(10) || chr(10) || replace(substr(text, 1, length(text) // 2), '#', '+') || chr(10) AS b,
  '### ' || lang || chr(10) || replace(substr(text, length(text) // 2 + 1), '#', '+') || chr(10) AS c, '## ' || doc_id || chr(10) || 'tail' || chr(10) AS d, '#### end ' || lang || chr(10) || 'x' AS e, source AS s, lang FROM documents),
parts AS (SELECT source, 0 AS i, 0 AS level, '' AS title, a AS raw, 0 AS begins, '' AS header_path FROM md
  UNION ALL SELECT source, 1, 1, s, b, length(a), '# ' || s FROM md
  UNION ALL SELECT source, 2, 3, lang, c, length(a || b), '# ' || s || ' > ### ' || lang FROM md
  UNION ALL SELECT source, 3, 2, source, d, length(a || b || c), '# ' || s || ' > ## ' || source FROM md
  UNION ALL SELECT source, 4, 4, 'end ' || lang, e, length(a || b || c || d), '# ' || s || ' > ## ' || source || ' > #### end ' || lang FROM md)"""


@registered(rf"WITH {_MD} SELECT source, i AS section_idx, level, title, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS content, CAST(begins AS INT) AS start_pos, CAST(begins + length(raw) AS INT) AS end_pos FROM parts")
def c2_markdown_sections(spark, sf_dir):
    return chunking.markdown_sections(_markdown(spark, sf_dir))


@registered(f"WITH {_MD} SELECT source, i AS section_idx, header_path FROM parts")
def c3_header_path(spark, sf_dir):
    return chunking.with_header_paths(chunking.markdown_sections(_markdown(spark, sf_dir))).select("source", "section_idx", "header_path")


@registered(
    rf"""WITH RECURSIVE {_MD}, sections AS (SELECT source, i, begins, header_path, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS content FROM parts),
long AS (SELECT source || '/' || i AS source, content FROM sections WHERE length(content) > 1000), {windows_sql(False, "cuts", "long")},
rows AS (SELECT source, i, 0 AS sub, begins AS a, begins + length(raw) AS b, content, header_path FROM sections WHERE length(content) <= 1000
  UNION ALL SELECT s.source, i, chunk_index, begins + start_char, begins + end_char, c.content, header_path FROM sections s JOIN cuts c ON c.source = s.source || '/' || i)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY i, sub) - 1 AS INT) AS chunk_index, CAST(a AS INT) AS start_char, CAST(b AS INT) AS end_char, content, header_path FROM rows"""
)
def c4_split_markdown(spark, sf_dir):
    return chunking.split_markdown(_markdown(spark, sf_dir))


@registered()
def c9_split_semantic(spark, sf_dir):
    return chunking.split_semantic(corpus(spark, sf_dir), vectors.hashing_encoder(), threshold=0.2)


def by_length(texts: list[str]) -> np.ndarray:
    """A stand-in encoder of whole numbers: three directions, by the length of a sentence."""
    return np.eye(3)[[len(t) % 3 for t in texts]] if texts else np.zeros((0, 3))


@registered(
    rf"""WITH RECURSIVE {_CORPUS}, {_SENTENCES}, {_cut_long(2000)}, short AS (SELECT source, content FROM corpus WHERE length(content) < 50), {windows_sql(False, "cuts", "short")},
told AS MATERIALIZED (SELECT s.*, length(s.sentence) AS size, length(s.sentence) % 3 AS kind, count(*) OVER (PARTITION BY s.source) AS n FROM cut_sentences s JOIN corpus c ON s.source = c.source WHERE length(content) >= 50),
fold AS (SELECT source, pos, 0 AS g, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS a, CASE WHEN kind = 1 THEN 1 ELSE 0 END AS b, CASE WHEN kind = 2 THEN 1 ELSE 0 END AS c, size AS used FROM told WHERE pos = 0 AND n > 1
  UNION ALL SELECT source, pos, CASE WHEN near THEN g ELSE g + 1 END, CASE WHEN near THEN a ELSE 0 END + CASE WHEN kind = 0 THEN 1 ELSE 0 END, CASE WHEN near THEN b ELSE 0 END + CASE WHEN kind = 1 THEN 1 ELSE 0 END,
    CASE WHEN near THEN c ELSE 0 END + CASE WHEN kind = 2 THEN 1 ELSE 0 END, CASE WHEN near THEN used + size + 1 ELSE size END
    FROM (SELECT t.source, t.pos, kind, size, g, a, b, c, used, (CASE kind WHEN 0 THEN a WHEN 1 THEN b ELSE c END) / sqrt(a * a + b * b + c * c) >= 0.65 AND used + size + 1 <= 1000 AS near FROM fold f JOIN told t ON t.source = f.source AND t.pos = f.pos + 1)),
groups AS (SELECT source, g, string_agg(sentence, ' ' ORDER BY pos) AS content, count(*) AS n, max(a) AS a, max(b) AS b, max(c) AS c FROM fold JOIN told USING (source, pos) GROUP BY source, g),
placed AS (SELECT *, sum(length(content) + 1) OVER (PARTITION BY source ORDER BY g) - 1 AS ends FROM groups)
SELECT source, CAST(g AS INT) AS chunk_index, CAST(ends - length(content) AS INT) AS start_char, CAST(ends AS INT) AS end_char, content, 'semantic' AS chunking_strategy, CAST(n AS INT) AS sentence_count, CASE WHEN n = 1 THEN 0.0 ELSE round_even(sqrt(a * a + b * b + c * c) / n, 3) END AS avg_similarity FROM placed
UNION ALL SELECT t.source, 0, 0, CAST(length(content) AS INT), regexp_replace(content, '^\s+|\s+$', '', 'g'), 'semantic', 1, 1.0 FROM told t JOIN corpus c ON t.source = c.source WHERE n = 1
UNION ALL SELECT source, chunk_index, start_char, end_char, content, NULL, NULL, NULL FROM cuts"""
)
def c5_semantic_groups(spark, sf_dir):
    """Semantic chunks without overlap, by an encoder whose sums SQL can follow."""
    return chunking.split_semantic(corpus(spark, sf_dir), by_length, overlap=0, threshold=0.65)


@registered(
    rf"""WITH RECURSIVE corpus AS (SELECT CAST(doc_id AS VARCHAR) AS source, replace(text, '#', '+') AS content, source AS owner FROM documents), {windows_sql(False)}
SELECT c.source, c.chunk_index, c.start_char, c.end_char, CASE WHEN owner = 'src1' AND length(d.content) <= 1000 THEN d.content ELSE c.content END AS content, '' AS header_path FROM chunks c JOIN corpus d ON c.source = d.source"""
)
def c10_chunk_documents(spark, sf_dir):
    """Documents of src1 count as Markdown; without headers they are one section."""
    docs = corpus(spark, sf_dir).withColumn("content", F.replace("content", F.lit("#"), F.lit("+")))
    return chunking.chunk_documents(docs.withColumn("extension", F.when(F.col("owner") == "src1", ".md").otherwise(".txt")))


@registered(
    r"""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS source, turn, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS page FROM conversations)
SELECT source, string_agg(page, chr(10) || chr(10) ORDER BY turn) AS content FROM p WHERE page <> '' GROUP BY source"""
)
def c12_assemble_pdf_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("source"), F.col("turn").alias("page_num"), F.col("text").alias("page_text"))
    return chunking.assemble_pdf_pages(pages)


# ---- keyword search

_BM25 = r"""words AS MATERIALIZED (SELECT source, chunk_index, list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '') AS w FROM chunks),
post AS MATERIALIZED (SELECT source, chunk_index, dl, term, count(*) AS tf FROM (SELECT source, chunk_index, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY ALL),
whole AS MATERIALIZED (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
raws AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, whole GROUP BY term),
terms AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws)"""
_SCORES = r"""want AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '')) AS term FROM queries) GROUP BY ALL),
scores AS MATERIALIZED (SELECT query_id, source, chunk_index, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS exact, round(exact, 6) AS score
  FROM want JOIN terms USING (term) JOIN post USING (term), whole GROUP BY ALL)"""
_ASKED = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_index) AS rank FROM scores)"


def _topk_sql(skip: bool) -> str:
    return f"""WITH {chunks_sql(skip)}, {_ASKED}, {_BM25}, {_SCORES}, {_RANKED}
SELECT query_id, CAST(rank AS INT) AS rank, source, chunk_index, score FROM ranked WHERE rank <= 5 AND score > 0"""


@registered(f"WITH {chunks_sql(False)}, {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms")
def k1_bm25_index(spark, sf_dir):
    return bm25.keyword_index(chunks_of(spark, sf_dir))["terms"].select("term", "df", F.round("idf", 6).alias("idf"))


@registered(f"WITH {chunks_sql(False)}, {_ASKED}, {_BM25}, {_SCORES} SELECT query_id, source, chunk_index, score FROM scores")
def k2_bm25_scores(spark, sf_dir):
    return bm25.bm25_scores(benchmark_queries(spark, sf_dir), chunks_of(spark, sf_dir), digits=6)


@registered(_topk_sql(False))
def k3_bm25_topk(spark, sf_dir):
    return bm25.bm25_topk(benchmark_queries(spark, sf_dir), chunks_of(spark, sf_dir), 5)


@registered(_topk_sql(True))
def k3_bm25_topk_skip(spark, sf_dir):
    return bm25.bm25_topk(benchmark_queries(spark, sf_dir), chunks_of(spark, sf_dir, "skip"), 5)


def _index_in_steps(spark, sf_dir):
    """Where an index of the corpus lies, owners as users: written with the even documents, the odd ones appended."""
    owned = corpus(spark, sf_dir).select(F.struct("source", "owner").alias("source"), "content")  # the owner travels with the source, without a join
    cut = chunking.split_documents(owned)
    chunks = stored(cut.select(F.col("source.owner").alias("user_id"), "source.source", "chunk_index", "content"), "chunks")
    path = f"{shared_dir(spark)}/scriptorium/index-{uuid.uuid4().hex}"
    for step, odd in ((index_store.write_index, 0), (index_store.append_index, 1)):
        part = chunks.where(F.col("source").cast("long") % 2 == odd)
        step(part, part.select("user_id", "source", "chunk_index", F.array(F.lit(1.0)).cast("array<float>").alias("embedding")), path)
    return path


@registered(_topk_sql(False))
def s5_search_appended_index(spark, sf_dir):
    """The same hits as from an index that is made at once."""
    return bm25.bm25_topk(benchmark_queries(spark, sf_dir), index_store.read_index(spark, _index_in_steps(spark, sf_dir)), 5)


@registered(_topk_sql(False).replace("FROM documents)", "FROM documents WHERE NOT (doc_id % 5 = 0 AND source <> 'src3'))", 1))
def i5_search_after_delete(spark, sf_dir):
    """Every fifth document is deleted, those of src3 in another user's name; the rest answer as an index of their own."""
    path, docs = _index_in_steps(spark, sf_dir), corpus(spark, sf_dir)
    catalog = docs.select(F.col("source").alias("id"), F.col("source").alias("filename"), F.col("owner").alias("user_id"))
    wanted = catalog.where("cast(id as long) % 5 = 0").select("id", F.when(F.col("user_id") == "src3", "other").otherwise(F.col("user_id")).alias("user_id"))
    index_store.delete_sources(documents.deleted_sources(catalog, wanted), path)
    return bm25.bm25_topk(benchmark_queries(spark, sf_dir), index_store.read_index(spark, path), 5)


# ---- vectors and hybrid search: one chunk per document, vector vec_id belongs to document vec_id


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("source"), F.lit(0).alias("chunk_index"), "embedding", F.col("label").cast("string").alias("user_id"))


def _labels(spark, sf_dir):
    """(vec_id, label) of every vector, to be sent to where the documents are unless they are too many."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return F.broadcast(labels) if labels.count() <= MOST_LABELS else labels


def _whole(spark, sf_dir):
    """Every document as one chunk; the label of its vector, if it has one, is its user. The texts are not shuffled for it."""
    docs, e = spread(table(spark, sf_dir, "documents")), _labels(spark, sf_dir)
    keyed = docs.join(e, docs["doc_id"] == e["vec_id"], "left")
    return keyed.select(F.col("doc_id").cast("string").alias("source"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.col("label").cast("string").alias("user_id"))


def _contents(spark, sf_dir):
    """Every document as one chunk, without its user."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))


def _vector_queries(spark, sf_dir):
    """Every vector whose id is divisible by 20; the even ones ask within their own label."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.when(F.col("vec_id") % 40 == 0, F.col("label").cast("string")).alias("user_id"))


def _hybrid_queries(spark, sf_dir):
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    e = e.join(bm25.small(b.select("item_id")), e["vec_id"] == b["item_id"], "left_semi")  # few vectors are asked with, so few meet the items
    joined = b.join(e, b["item_id"] == e["vec_id"], "left")
    return joined.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_vec"), F.when(F.col("item_id") % 2 == 0, F.col("label").cast("string")).alias("user_id"))


_NEAR = """near AS (SELECT q.query_id, v.source, v.chunk_index, round(list_dot_product(CAST(q.query_vec AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM asked q JOIN vecs v ON q.user_id IS NULL OR q.user_id = v.user_id WHERE q.query_vec IS NOT NULL),
near_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_index) AS INT) AS rank FROM near)"""
_VECS = "vecs AS (SELECT CAST(vec_id AS VARCHAR) AS source, 0 AS chunk_index, embedding, CAST(label AS VARCHAR) AS user_id FROM embeddings)"
_HYBRID = f"""{_VECS}, asked AS (SELECT item_id AS query_id, text AS query, embedding AS query_vec, CASE WHEN item_id % 2 = 0 THEN CAST(label AS VARCHAR) END AS user_id FROM benchmark LEFT JOIN embeddings ON item_id = vec_id),
queries AS (SELECT query_id, query FROM asked),
chunks AS (SELECT CAST(doc_id AS VARCHAR) AS source, 0 AS chunk_index, text AS content, CAST(label AS VARCHAR) AS user_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
{_BM25}, {_SCORES}, {_NEAR},
found AS (SELECT s.query_id, s.source, s.chunk_index, s.score, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.source, s.chunk_index) AS INT) AS rank FROM scores s JOIN asked q USING (query_id) JOIN chunks c USING (source, chunk_index) WHERE q.user_id IS NULL OR q.user_id = c.user_id)"""


@registered(
    f"""WITH {_VECS}, asked AS (SELECT vec_id AS query_id, embedding AS query_vec, CASE WHEN vec_id % 40 = 0 THEN CAST(label AS VARCHAR) END AS user_id FROM embeddings WHERE vec_id % 20 = 0), {_NEAR}
SELECT query_id, rank, source, chunk_index, score FROM near_ranked WHERE rank <= 5"""
)
def v3_vector_topk(spark, sf_dir):
    return vectors.vector_topk(_vector_queries(spark, sf_dir), _vectors(spark, sf_dir), 5)


@registered(
    """SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing_vectors,
(SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS orphan_vectors, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS wrong_dimension"""
)
def v4_validate_vectors(spark, sf_dir):
    chunks = corpus(spark, sf_dir).select("source", F.lit(0).alias("chunk_index"), "content")
    return vectors.validate_vectors(chunks, _vectors(spark, sf_dir), 64)


@registered()
def v1_embed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return vectors.embed(docs, "text", vectors.hashing_encoder()).select("doc_id", "embedding")


@registered(
    f"""WITH {_HYBRID}, fused AS (SELECT query_id, source, chunk_index, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, source, chunk_index, rank FROM found WHERE rank <= 10 AND score > 0
  UNION ALL SELECT query_id, source, chunk_index, rank FROM near_ranked WHERE rank <= 10) GROUP BY ALL),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_index) AS INT) AS rank FROM fused)
SELECT query_id, rank, source, chunk_index, score FROM f WHERE rank <= 5"""
)
def f1_search_rrf(spark, sf_dir):
    return fusion.search_rrf(_hybrid_queries(spark, sf_dir), _whole(spark, sf_dir), _vectors(spark, sf_dir), 5)


_WEIGHTED = """kept AS (SELECT query_id, source, chunk_index, score AS near FROM near_ranked WHERE rank <= 15),
joined AS (SELECT k.*, coalesce(s.exact, 0) AS w FROM kept k LEFT JOIN scores s USING (query_id, source, chunk_index)),
mixed AS (SELECT query_id, source, chunk_index, round(0.7 * near + 0.3 * CASE WHEN max(w) OVER q > min(w) OVER q THEN (w - min(w) OVER q) / (max(w) OVER q - min(w) OVER q) ELSE 0 END, 6) AS score FROM joined WINDOW q AS (PARTITION BY query_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_index) AS rank FROM mixed WHERE score >= 0)"""


_BOTH = """SELECT query_id, CAST(rank AS INT) AS rank, source, chunk_index, round(score, 4) AS score FROM best WHERE rank <= 5
UNION ALL SELECT query_id, rank, source, chunk_index, round(score, 4) FROM found WHERE rank <= 5 AND score > 0 AND query_id NOT IN (SELECT query_id FROM near_ranked)"""


@registered(f"WITH {_HYBRID}, {_WEIGHTED} {_BOTH}")
def f2_search_weighted(spark, sf_dir):
    """Items without a vector fall back to keywords."""
    hits = fusion.search_weighted(_hybrid_queries(spark, sf_dir), _whole(spark, sf_dir), _vectors(spark, sf_dir), 5)
    return hits.withColumn("score", F.round("score", 4))  # a vector score times 0.7 often ends in a 5 at the seventh place


@registered(f"WITH {_HYBRID}, {_WEIGHTED} {_BOTH}")
def f4_hybrid_search(spark, sf_dir):
    hits = fusion.hybrid_search(_hybrid_queries(spark, sf_dir), _whole(spark, sf_dir), _vectors(spark, sf_dir), 5)
    return hits.withColumn("score", F.round("score", 4))


@registered(
    f"""WITH {_HYBRID}, fused AS (SELECT query_id, source, chunk_index, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, source, chunk_index, rank FROM found WHERE rank <= 10 AND score > 0
  UNION ALL SELECT query_id, source, chunk_index, rank FROM near_ranked WHERE rank <= 10) WHERE query_id % 3 <> 0 OR source = CAST(query_id AS VARCHAR) GROUP BY ALL),
f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_index) AS INT) AS rank FROM fused)
SELECT query_id, rank, source, chunk_index, score FROM f WHERE rank <= 5"""
)
def p4_source_filter(spark, sf_dir):
    """Every third item wants hits from the document of its own number only."""
    queries = _hybrid_queries(spark, sf_dir).withColumn("source_filter", F.when(F.col("query_id") % 3 == 0, F.col("query_id").cast("string")).otherwise(""))
    return fusion.hybrid_search(queries, _whole(spark, sf_dir), _vectors(spark, sf_dir), 5, "rrf")


@registered(f"WITH {_HYBRID} SELECT query_id, rank, source, chunk_index, score FROM found WHERE rank <= 5 AND score > 0")
def f3_bm25_fallback(spark, sf_dir):
    """No query has a vector, so all fall back to keywords."""
    queries = _hybrid_queries(spark, sf_dir).withColumn("query_vec", F.lit(None).cast("array<float>"))
    return fusion.search_weighted(queries, _whole(spark, sf_dir), _vectors(spark, sf_dir), 5)


_VARIANTS = """hits AS (SELECT i.query_id AS request_id, 0 AS variant_no, rank, source, chunk_index, score FROM found i WHERE rank <= 10 AND score > 0
  UNION ALL SELECT query_id, 1, rank, source, chunk_index, round(score * 5, 6) FROM near_ranked WHERE rank <= 10)"""


def _variants(spark, sf_dir):
    queries, chunks, vecs = _hybrid_queries(spark, sf_dir), _whole(spark, sf_dir), _vectors(spark, sf_dir)
    words = fusion.bm25_fallback(queries, chunks, queries.select("query_id").where("false"), 10).withColumn("variant_no", F.lit(0))
    near = vectors.vector_topk(queries, vecs, 10).withColumn("score", F.round(F.col("score") * 5, 6)).withColumn("variant_no", F.lit(1))
    return words.unionByName(near).withColumnRenamed("query_id", "request_id")


@registered(
    f"""WITH {_HYBRID}, {_VARIANTS}, f AS (SELECT *, row_number() OVER (PARTITION BY request_id, source, chunk_index ORDER BY variant_no, rank) AS n FROM hits)
SELECT request_id, variant_no, source, chunk_index, score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, source, chunk_index) AS INT) AS rank FROM f WHERE n = 1"""
)
def m2_dedupe_first(spark, sf_dir):
    return fusion.dedupe_first(_variants(spark, sf_dir))


@registered(
    f"""WITH {_HYBRID}, {_VARIANTS}, g AS (SELECT h.*, content, row_number() OVER (PARTITION BY request_id, substr(content, 1, 100) ORDER BY h.score DESC, variant_no, rank) AS n FROM hits h JOIN chunks USING (source, chunk_index)),
r AS (SELECT request_id, variant_no, source, chunk_index, score, CAST(row_number() OVER (PARTITION BY request_id ORDER BY score DESC, source, chunk_index) AS INT) AS rank FROM g WHERE n = 1) SELECT * FROM r WHERE rank <= 5"""
)
def m3_merge_max(spark, sf_dir):
    return fusion.merge_max(_with_content(_variants(spark, sf_dir), _contents(spark, sf_dir)), 5).drop("content")


@registered(
    rf"""WITH {_HYBRID}, p AS (SELECT w.query_id, source, chunk_index, list_distinct(list_filter(regexp_split_to_array(lower(q.query), '\s+'), lambda x: x <> '')) AS a, list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '') AS b
  FROM found w JOIN asked q USING (query_id) JOIN chunks c USING (source, chunk_index) WHERE rank <= 15 AND score > 0),
s AS (SELECT query_id, source, chunk_index, round(len(list_intersect(a, b)) / len(a), 6) AS score FROM p),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_index) AS INT) AS rank FROM s) SELECT query_id, rank, source, chunk_index, score FROM r WHERE rank <= 5"""
)
def m4_rerank(spark, sf_dir):
    queries, chunks = _hybrid_queries(spark, sf_dir), _whole(spark, sf_dir)
    hits = fusion.bm25_fallback(queries, chunks, queries.select("query_id").where("false"), 15)
    full = _with_content(hits, _contents(spark, sf_dir)).join(queries.select("query_id", "query"), "query_id")
    return fusion.rerank(full, 5).select("query_id", "rank", "source", "chunk_index", "score")


def _with_content(hits, chunks):
    """Hits with the content of their chunks; few hits go to where the chunks are."""
    return chunks.select("source", "chunk_index", "content").join(bm25.small(stored(hits, "hits")), ["source", "chunk_index"])


def _answered(spark, sf_dir):
    """The benchmark items and their five best chunks, which are few, so they are found once."""
    chunks = chunk_table(spark, sf_dir)
    queries = benchmark_queries(spark, sf_dir)
    return queries, stored(_with_content(bm25.bm25_topk(queries, chunks, 5), chunks), "hits")


_TOP = f"""{chunks_sql(False)}, {_ASKED}, {_BM25}, {_SCORES}, {_RANKED},
top AS (SELECT r.*, content FROM ranked r JOIN chunks USING (source, chunk_index) WHERE rank <= 5 AND score > 0),
ctx AS (SELECT query_id, string_agg('--- [Chunk ' || rank || '] (Source: ' || source || ') ---' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS c FROM top GROUP BY query_id),
prompts AS (SELECT query_id, '{answers.SYSTEM_TEXT}' || chr(10) || chr(10) || '[Context]' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || '[Question]' || chr(10) || query || chr(10) || chr(10) || '[Answer]' || chr(10) AS prompt FROM queries LEFT JOIN ctx USING (query_id))"""


@registered(f"WITH {_TOP} SELECT query_id, prompt FROM prompts")
def m6_build_prompts(spark, sf_dir):
    return answers.build_prompts(*_answered(spark, sf_dir))


@registered(
    f"""WITH {_TOP}, cited AS (SELECT query_id, string_agg(source || ' ' || printf('%.3f', round(score, 3)) || ' ' || substr(content, 1, 500), chr(10) ORDER BY rank) AS r FROM top GROUP BY query_id)
SELECT query_id, prompt, coalesce(r, '') AS cited, CASE WHEN r IS NULL THEN '{answers.NOTHING_FOUND}' END AS note FROM prompts LEFT JOIN cited USING (query_id)"""
)
def m7_answer_requests(spark, sf_dir):
    return _cited(answers.answer_requests(*_answered(spark, sf_dir)))


def _cited(out):
    """The list of references as one text, a line for each."""
    lines = F.transform("references", lambda r: F.concat_ws(" ", r["source"], F.format_string("%.3f", F.round(r["score"], 3)), r["content"]))
    return out.select("query_id", "prompt", F.array_join(lines, "\n").alias("cited"), "note")


@registered(
    rf"""WITH {_VECS}, asked AS (SELECT item_id || '/' || v AS query_id, item_id AS request_id, v AS variant_no, CASE v WHEN 0 THEN text ELSE regexp_replace(substr(text, 1, 60), '[^A-Za-z ]', ' ', 'g') END AS query,
  e.embedding AS query_vec, CASE WHEN item_id % 2 = 0 THEN CAST(own.label AS VARCHAR) END AS user_id FROM benchmark CROSS JOIN (VALUES (0), (1)) t(v) LEFT JOIN embeddings e ON e.vec_id = item_id + v LEFT JOIN embeddings own ON own.vec_id = item_id),
queries AS (SELECT query_id, query FROM asked), chunks AS (SELECT CAST(doc_id AS VARCHAR) AS source, 0 AS chunk_index, text AS content, CAST(label AS VARCHAR) AS user_id FROM documents LEFT JOIN embeddings ON doc_id = vec_id),
{_BM25}, {_SCORES}, {_NEAR}, {_WEIGHTED.replace("rank <= 15", "rank <= 45")},
found AS (SELECT s.query_id, s.source, s.chunk_index, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.source, s.chunk_index) AS rank FROM scores s JOIN asked q USING (query_id) JOIN chunks c USING (source, chunk_index) WHERE q.user_id IS NULL OR q.user_id = c.user_id),
pool AS (SELECT DISTINCT request_id, source, chunk_index FROM (SELECT query_id, source, chunk_index FROM best WHERE rank <= 15
  UNION ALL SELECT query_id, source, chunk_index FROM found WHERE rank <= 15 AND score > 0 AND query_id NOT IN (SELECT query_id FROM near_ranked)) JOIN asked USING (query_id)),
own AS (SELECT item_id AS query_id, text AS query FROM benchmark),
p AS (SELECT query_id, source, chunk_index, content, list_distinct(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda x: x <> '')) AS a, list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '') AS b FROM pool JOIN own ON request_id = query_id JOIN chunks USING (source, chunk_index)),
scored AS (SELECT query_id, source, chunk_index, content, round(len(list_intersect(a, b)) / len(a), 6) AS score FROM p),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, chunk_index) AS rank FROM scored) WHERE rank <= 5),
ctx AS (SELECT query_id, string_agg('--- [Chunk ' || rank || '] (Source: ' || source || ') ---' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS c FROM top GROUP BY query_id),
prompts AS (SELECT query_id, '{answers.SYSTEM_TEXT}' || chr(10) || chr(10) || '[Context]' || chr(10) || coalesce(c, '') || chr(10) || chr(10) || '[Question]' || chr(10) || query || chr(10) || chr(10) || '[Answer]' || chr(10) AS prompt FROM own LEFT JOIN ctx USING (query_id)),
cited AS (SELECT query_id, string_agg(source || ' ' || printf('%.3f', round(score, 3)) || ' ' || substr(content, 1, 500), chr(10) ORDER BY rank) AS r FROM top GROUP BY query_id)
SELECT query_id, prompt, coalesce(r, '') AS cited, CASE WHEN r IS NULL THEN '{answers.NOTHING_FOUND}' END AS note FROM prompts LEFT JOIN cited USING (query_id)"""
)
def m5_ask(spark, sf_dir):
    """Every benchmark item and one rewrite of it, through hybrid search, merging, reranking and prompts.

    The vector of variant v of an item is the one numbered item + v; even items ask within their label.
    """
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    rewrite = F.regexp_replace(F.substring("text", 1, 60), "[^A-Za-z ]", " ")
    user = F.when(F.col("item_id") % 2 == 0, F.col("label").cast("string"))
    requests = b.join(e, b["item_id"] == e["vec_id"], "left").select(F.col("item_id").alias("request_id"), F.col("text").alias("query"), F.concat(F.lit("Try: "), F.to_json(F.array(rewrite))).alias("response"), user.alias("user_id"))
    of_vector = e.select((F.col("vec_id")).alias("wanted"), F.col("embedding").alias("query_vec"))
    embedded = lambda rows: rows.withColumn("wanted", F.col("request_id") + F.col("variant_no")).join(of_vector, "wanted", "left").drop("wanted")
    return _cited(answers.ask(requests, _whole(spark, sf_dir), _vectors(spark, sf_dir), embedded, 5, reranked=True))


@registered(f"WITH {_TOP} SELECT query_id, CAST(rank AS INT) AS rank, CAST(CAST(CAST(score AS DECIMAL(18, 6)) AS DECIMAL(18, 4)) AS VARCHAR) AS score, replace(substr(content, 1, 100), chr(10), ' ') || '...' AS snippet FROM top")
def p10_snippets(spark, sf_dir):
    return T.to_snippets(_answered(spark, sf_dir)[1])


@registered(f"WITH {chunks_sql(False)} SELECT source, chunk_index, 'u1' AS user_id FROM chunks")
def p8_stamp_user(spark, sf_dir):
    return files.stamp_user(chunking.split_documents(corpus(spark, sf_dir)), "u1").select("source", "chunk_index", "user_id")


@registered(
    """SELECT '/in/' || source || '/' || doc_id || '.TXT' AS source, doc_id || '.TXT' AS filename, '.txt' AS extension, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, 'unknown' AS language, text AS content FROM documents"""
)
def s3_document_metadata(spark, sf_dir):
    """Documents as file rows; the time of the run is left out."""
    path = F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", F.lit(".TXT"))
    rows = table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").alias("content"))
    return files.document_metadata(rows).drop("created_at")


_REQUESTS = """r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'inline ' || lang END AS content,
  CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 4 = 1 THEN 'gone' END AS file_path FROM documents)"""


@registered(
    f"""WITH {_REQUESTS}, t AS (SELECT r.doc_id AS request_id, CASE WHEN file_path IS NOT NULL THEN d.text ELSE r.content END AS content FROM r LEFT JOIN documents d ON file_path = CAST(d.doc_id AS VARCHAR))
SELECT request_id, content, coalesce(content, '') <> '' AS accepted FROM t"""
)
def s4_inline_or_file(spark, sf_dir):
    """Requests with inline text, with the file of their own document, with both, or with neither."""
    inline = F.expr("case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '' else concat('inline ', lang) end")
    path = F.expr("case when doc_id % 4 = 0 then cast(doc_id as string) when doc_id % 4 = 1 then 'gone' end")
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), inline.alias("content"), path.alias("file_path"))
    good, bad = files.inline_or_file(requests, corpus(spark, sf_dir))
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False))).select("request_id", "content", "accepted")


# ---- manifest, catalogue, sessions


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("hash"), F.expr("cast(length(text) / 1000 as int)").alias("chunks_count"))


def _manifest(spark, sf_dir):
    """As if every seventh document had changed and every eleventh were new since."""
    files_now = _files(spark, sf_dir).withColumn("n", F.col("path").cast("long"))
    return files_now.where("n % 11 <> 0").select("path", F.when(F.col("n") % 7 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"), F.lit(1).alias("chunks_count"))


_MAN = """files AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS hash, CAST(trunc(length(text) / 1000) AS INT) AS chunks_count, doc_id FROM documents),
man AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE hash END AS hash, 1 AS chunks_count FROM files WHERE doc_id % 11 <> 0)"""


@registered(f"WITH {_MAN} SELECT path, hash, chunks_count FROM files f WHERE NOT EXISTS (SELECT 1 FROM man m WHERE m.path = f.path AND m.hash = f.hash)")
def i1_changed_files(spark, sf_dir):
    return manifest.changed_files(_files(spark, sf_dir), _manifest(spark, sf_dir))


@registered(f"WITH {_MAN} SELECT count(*) AS skipped FROM files f JOIN man m ON m.path = f.path AND m.hash = f.hash")
def i1_skipped_count(spark, sf_dir):
    return manifest.skipped_count(_files(spark, sf_dir), _manifest(spark, sf_dir))


@registered(f"WITH {_MAN} SELECT f.path, f.hash, CASE WHEN m.hash = f.hash THEN m.chunks_count ELSE f.chunks_count END AS chunks_count FROM files f LEFT JOIN man m USING (path)")
def i2_mark_indexed(spark, sf_dir):
    old = _manifest(spark, sf_dir)
    return manifest.mark_indexed(old, manifest.changed_files(_files(spark, sf_dir), old))


@registered(f"WITH {_MAN} SELECT path, hash, chunks_count FROM man WHERE hash <> 'old'")
def i3_remove_indexed(spark, sf_dir):
    old = _manifest(spark, sf_dir)
    return manifest.remove_indexed(old, old.where("hash = 'old'"))


@registered(f"WITH {_MAN} SELECT count(*) AS indexed FROM man")
def i4_indexed_count(spark, sf_dir):
    return manifest.indexed_count(_manifest(spark, sf_dir))


def _catalog(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("_"), "doc_id", F.when(F.col("lang") == "de", ".docx").when(F.col("lang") == "fr", ".MD").otherwise(".txt"))
    return docs.select(F.col("doc_id").cast("string").alias("id"), name.alias("filename"), F.length("text").alias("filesize"), F.col("source").alias("user_id"), F.lit(1).alias("chunk_count"), F.timestamp_seconds(F.col("doc_id") % 97).alias("created_at"))


_CAT = """cat AS (SELECT CAST(doc_id AS VARCHAR) AS id, source || '_' || doc_id || CASE lang WHEN 'de' THEN '.docx' WHEN 'fr' THEN '.MD' ELSE '.txt' END AS filename, CAST(length(text) AS INT) AS filesize, source AS user_id, 1 AS chunk_count, doc_id % 97 AS created, doc_id, lang FROM documents)"""


@registered(f"WITH {_CAT} SELECT id, user_id, filename FROM cat WHERE NOT (doc_id % 5 = 0 AND user_id <> 'src3')")
def i5_delete_documents(spark, sf_dir):
    """Every fifth document is asked for, those of src3 by another user."""
    catalog = _catalog(spark, sf_dir)
    wanted = catalog.where("cast(id as long) % 5 = 0").select("id", F.when(F.col("user_id") == "src3", "other").otherwise(F.col("user_id")).alias("user_id"))
    return documents.delete_documents(catalog, wanted).select("id", "user_id", "filename")


@registered(f"WITH {_CAT} SELECT id, user_id FROM cat WHERE user_id NOT IN ('src1', 'src2')")
def i6_delete_user_cascade(spark, sf_dir):
    users = _catalog(spark, sf_dir).where("user_id in ('src1', 'src2')").select("user_id").distinct()
    return documents.delete_user_cascade(_catalog(spark, sf_dir), users).select("id", "user_id")


@registered(f"WITH {_CAT} SELECT user_id, id, filename, filesize, chunk_count, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created DESC, id) AS INT) AS place FROM cat")
def d1_list_documents(spark, sf_dir):
    return documents.list_documents(_catalog(spark, sf_dir)).drop("created_at")


@registered(f"WITH {chunks_sql(False)}, n AS (SELECT source, count(*) AS n FROM chunks GROUP BY source) SELECT owner || '_' || c.source AS filename, c.source AS filepath, CAST(length(content) AS INT) AS filesize, 'text/plain' AS mimetype, coalesce(n, 0) AS chunk_count, owner AS user_id FROM corpus c LEFT JOIN n USING (source)")
def d2_catalog_entries(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    counts = chunking.chunk_counts(docs, chunking.split_documents(docs))
    return documents.catalog_entries(docs.select("source", F.concat("owner", F.lit("_"), "source").alias("filename"), F.length("content").alias("size_bytes"), F.col("owner").alias("user_id")), counts)


@registered(f"WITH {_CAT} SELECT user_id, filename FROM cat WHERE doc_id % 3 <> 0 AND lang <> 'de'")
def d3_dedupe_uploads(spark, sf_dir):
    incoming = _catalog(spark, sf_dir).select("id", "user_id", "filename", files.extension_of(F.col("filename")).alias("extension"))
    queued = incoming.where("cast(id as long) % 3 = 0")
    return documents.dedupe_uploads(incoming, queued, files.SUPPORTED).select("user_id", "filename")


@registered(
    """WITH f AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS t, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE coalesce(t, 'New chat') END AS title, n_messages, last_turn FROM f"""
)
def d4_session_summary(spark, sf_dir):
    return documents.session_summary(table(spark, sf_dir, "conversations"))


@registered("WITH s AS (SELECT conv_id, max(turn) * 1000 + conv_id % 1000 AS updated_at FROM conversations GROUP BY conv_id) SELECT * FROM s ORDER BY updated_at DESC, conv_id LIMIT 50")
def d5_recent_sessions(spark, sf_dir):
    sessions = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t")).select("conv_id", (F.col("t") * 1000 + F.col("conv_id") % 1000).alias("updated_at"))
    return documents.recent_sessions(sessions, 50)


@registered("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id")
def d5_delete_sessions(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    return documents.delete_sessions(messages, messages.where("role = 'system'")).groupBy("conv_id").agg(F.count("*").alias("n"))


@registered("SELECT conv_id, conv_id || ':' || turn AS message_id, text, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_fragments, CASE WHEN role = 'assistant' THEN '[' || turn || ']' END AS \"references\", turn % 2 = 0 AS done FROM conversations")
def d6_assemble_messages(spark, sf_dir):
    """Words arrive as fragments; assistants' messages lead with references, every other one is closed."""
    m = table(spark, sf_dir, "conversations").withColumn("message_id", F.concat("conv_id", F.lit(":"), "turn"))
    words = m.select("conv_id", "message_id", F.posexplode(F.split("text", " ")).alias("seq", "word"))
    text = words.select("conv_id", "message_id", "seq", F.when(F.col("seq") == 0, F.col("word")).otherwise(F.concat(F.lit(" "), "word")).alias("text"), F.lit("text").alias("kind"))
    cited = m.where("role = 'assistant'").select("conv_id", "message_id", F.lit(0).alias("seq"), F.concat(F.lit("["), "turn", F.lit("]")).alias("text"), F.lit("references").alias("kind"))
    closed = m.where("turn % 2 = 0").select("conv_id", "message_id", F.lit(1 << 30).alias("seq"), F.lit(None).cast("string").alias("text"), F.lit("done").alias("kind"))
    return documents.assemble_messages(text.unionByName(cited).unionByName(closed))


@registered(f"WITH {_CAT} SELECT id, filename FROM cat WHERE contains(lower(filename), 'rc1_')")
def p11_search_filename(spark, sf_dir):
    return documents.search_filename(_catalog(spark, sf_dir), "RC1_").select("id", "filename")


@registered(f"WITH {_CAT} SELECT id, doc_id || '_' || replace(replace(filename, '_', '한 '), ' ', '_') AS stored FROM cat")
def p12_stored_filename(spark, sf_dir):
    odd = F.replace(F.col("filename"), F.lit("_"), F.lit("한 "))
    return _catalog(spark, sf_dir).select("id", T.stored_filename(odd, F.col("id")).alias("stored"))


@registered(f"WITH {_CAT} SELECT id, filename FROM cat WHERE lang <> 'de'")
def p1_filter_supported(spark, sf_dir):
    named = _catalog(spark, sf_dir).withColumn("extension", files.extension_of(F.col("filename")))
    return files.filter_hidden(files.filter_supported(named)).select("id", "filename")


@registered("SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS out FROM documents")
def s2_decode_text(spark, sf_dir):
    raw = F.encode(F.expr("replace(text, chr(10), concat(chr(13), chr(10), chr(13)))"), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", files.decode_text(raw).alias("out"))


@registered(f"WITH {_MAN} SELECT path, hash, chunks_count FROM man")
def s8_manifest_json(spark, sf_dir):
    """Every entry goes out as a JSON line and is read back."""
    return manifest.read_manifest(manifest.manifest_lines(_manifest(spark, sf_dir)))

"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prepare
from .decision_list import quality_rules
from .decontam import contamination_report
from .lang_mixture import identify_languages
from .line_align import dedup_lines
from .packing import pack_documents
from .periodic_runs import periodic_runs, run_digests
from .preference_quality import score_documents
from .quote_threads import reply_ordered
from .simhash import simhash_groups
from .small_world import build_index, search
from .spelling import count_words, spelling_variants
from .token_blocks import token_digests
from .url_filter import filter_urls, host_of, path_of

#: Fixed rules of the URL query: host, path, action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_ordered(_table(spark, sf_dir, "conversations"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_deleted", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed URLs are those of the table's spam-farm hosts."""
    pages = _table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    listed = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where(F.col("host").startswith("spam-farm."))
    return filter_urls(pages, rules, listed)


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 100."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return search(build_index(rows), rows.where(F.col("vec_id") % 100 == 0), k=10)


def one_letter_lost(doc_id: int | None, run: bytes) -> bytes:
    """One run in 199 of a document without one of its letters."""
    h = zlib.crc32(run, zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":"))
    if h % 199:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(materialise(count_words(_table(spark, sf_dir, "documents"), one_letter_lost), "words"))


def repeated_from_within(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten goes on, from some word, with copies of the words that follow there."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(_table(spark, sf_dir, "documents"), repeated_from_within))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_token_blocks,
        op3_pairwise_quality,
        op4_quote_threads,
        op5_decision_list,
        op6_line_alignment,
        op7_language_mixture,
        op8_url_filter,
        op9_residual_packing,
        op10_decontamination,
        op11_small_world,
        op12_spelling_variants,
        op13_periodic_runs,
    )
}

_PREFIX = r"^[ \t]*((?:>[ \t]?)+)"
_SHOWN = r"^[ \t]*(On|Le|Am|El)\b.*(wrote|écrit|schrieb|escribió)[ \t]*:[ \t]*$"

ORACLES: dict[str, str] = {
    "op4_quote_threads": rf"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
nm AS (SELECT row_number() OVER () AS id, * FROM m),
lines AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM nm),
lv AS (SELECT id, conv_id, turn, pos, length(regexp_replace(regexp_extract(line, '{_PREFIX}', 1), '[^>]', '', 'g')) AS level,
       lower(trim(regexp_replace(regexp_replace(line, '{_PREFIX}', ''), '\s+', ' ', 'g'))) AS line FROM lines),
edge AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY pos) THEN 1 ELSE 0 END AS opens FROM lv),
run AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY pos) AS run FROM edge),
quoted AS (SELECT id, conv_id, turn, level, run, string_agg(line, ' ' ORDER BY pos) AS passage FROM run
           WHERE level > 0 AND line <> '' GROUP BY id, conv_id, turn, level, run),
text AS (SELECT conv_id, turn, string_agg(line, ' ' ORDER BY pos) AS own FROM lv WHERE level = 0 AND line <> '' GROUP BY id, conv_id, turn),
known AS (SELECT q.id, q.conv_id, q.turn, q.level, q.run, q.passage, min(t.turn) AS source FROM quoted q JOIN text t
          ON q.conv_id = t.conv_id AND t.turn < q.turn AND contains(' ' || own || ' ', ' ' || passage || ' ')
          WHERE len(string_split(passage, ' ')) >= 5 GROUP BY ALL),
own AS (SELECT conv_id, line, min(turn) AS source FROM lv WHERE level = 0 AND line <> '' GROUP BY conv_id, line),
hit AS (SELECT conv_id, turn, level, source, sum(chars) AS chars FROM (
          SELECT conv_id, turn, level, source, length(passage) AS chars FROM known UNION ALL
          SELECT q.conv_id, q.turn, q.level, o.source, length(q.line) FROM run q ANTI JOIN known USING (id, run) JOIN own o ON q.conv_id = o.conv_id AND q.line = o.line
          WHERE q.level > 0 AND q.line <> '' AND o.source < q.turn) GROUP BY ALL),
parent AS (SELECT conv_id, turn, source AS reply_to FROM hit
           QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, chars DESC, source DESC) = 1),
up AS (SELECT conv_id, turn, reply_to AS root FROM parent
       UNION ALL SELECT u.conv_id, u.turn, p.reply_to FROM up u JOIN parent p ON u.conv_id = p.conv_id AND u.root = p.turn),
root AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY conv_id, turn),
cut AS (SELECT m.*, string_split(text, chr(10)) AS ls FROM m),
marked AS (SELECT cut.*, [length(regexp_replace(regexp_extract(x, '{_PREFIX}', 1), '[^>]', '', 'g')) FOR x IN ls] AS lvls FROM cut),
plain AS (SELECT conv_id, turn, role, text IS NULL AS none,
  regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(range(1, len(ls) + 1),
    lambda i: lvls[i] = 0 AND NOT (regexp_matches(ls[i], '{_SHOWN}') AND coalesce(lvls[i + 1], 0) > 0)), lambda i: ls[i]), chr(10)), '^\n+', ''), '\n+$', '') AS body,
  CAST(len(list_filter(lvls, lambda v: v > 0)) AS BIGINT) AS n FROM marked)
SELECT p.conv_id, coalesce(r.root, p.turn) AS thread, p.turn, p.role, CASE WHEN none THEN NULL ELSE body END AS text, q.reply_to,
  coalesce(n, 0) AS n_quoted_lines,
  '<|' || regexp_replace(coalesce(p.role, 'user'), '[^\w.-]', '_', 'g') || '|>' || chr(10) || replace(coalesce(body, ''), '<|', '< |') || chr(10) || '<|end|>' || chr(10) AS formatted
FROM plain p LEFT JOIN parent q ON p.conv_id = q.conv_id AND p.turn = q.turn LEFT JOIN root r ON p.conv_id = r.conv_id AND p.turn = r.turn
""",
    "op8_url_filter": r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, t, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (SELECT p.*, h || t AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(h || t) DESC) AS n
        FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, t))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN starts_with(host, 'spam-farm.') THEN 'block' ELSE 'allow' END) AS verdict FROM fit WHERE n = 1
""",
    "op10_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS gram FROM bs, LATERAL unnest(range(1, len(w) - size + 2)) AS u(k)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS gram FROM d, sizes, LATERAL unnest(range(1, len(w) - size + 2)) AS u(k)),
hit AS (SELECT doc_id, k, dw.size, item FROM dw JOIN win ON dw.size = win.size AND dw.gram = win.gram),
words AS (SELECT DISTINCT doc_id, k + j AS at FROM hit, LATERAL unnest(range(0, size)) AS u(j)),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
""",
}

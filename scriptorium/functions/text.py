"""Text expressions: columns in, columns out.

White space follows Unicode plus the four separators U+001C..U+001F, line ends are \\n
only, and all positions are code points.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_SPACE = r"[\s\x1c-\x1f]"
#: Texts of a batch that are normalised together.
TEXTS_AT_ONCE = 256


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"(?U)^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def _nfkc(text: pa.Array) -> pa.Array:
    """Each text in NFKC; only TEXTS_AT_ONCE of them are Python strings at a time."""
    some = (text.slice(at, TEXTS_AT_ONCE).to_pylist() for at in range(0, len(text), TEXTS_AT_ONCE))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], pa.string()) for texts in some)])


def normalize_unicode(text: Column) -> Column:
    """NFKC; Spark has no built-in for it. ASCII texts are in that form and stay in the JVM."""
    odd = text.rlike(r"[^\x00-\x7f]")
    return F.when(odd, F.arrow_udf(_nfkc, "string")(F.when(odd, text))).otherwise(text)


def normalize_whitespace(text: Column) -> Column:
    """Tabs to four blanks, line ends stripped, other runs to one blank; newlines stay."""
    tabs = F.replace(text, F.lit("\t"), F.lit("    "))
    ends = F.regexp_replace(tabs, r"(?Umd)(?:[^\S\n]|[\x1c-\x1f])+$", "")
    return F.regexp_replace(ends, r"(?U)(?:[^\S\n]|[\x1c-\x1f])+", " ")


def normalize_newlines(text: Column, max_consecutive: int = 2) -> Column:
    """Longer runs of newlines cut to max_consecutive."""
    return F.regexp_replace(text, rf"\n{{{max_consecutive + 1},}}", "\n" * max_consecutive)


def normalize_text(text: Column) -> Column:
    """NFKC, white space, newlines, strip."""
    return strip(normalize_newlines(normalize_whitespace(normalize_unicode(text))))


def normalize_pdf_text(text: Column) -> Column:
    """Joins hyphenated and wrapped lines of extracted pages; paragraphs stay apart.

    Paragraphs are what lies between runs of white space with two newlines or more.
    """
    unbroken = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)-{WHITE_SPACE}*\n{WHITE_SPACE}*", "")
    paragraphs = F.split(unbroken, rf"(?U) *\n{WHITE_SPACE}*\n *", -1)
    return strip(F.array_join(F.transform(paragraphs, lambda p: F.regexp_replace(p, r"[ \n]+", " ")), "\n\n"))


def count_korean_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[가-힯ᄀ-ᇿ㄰-㆏]"))


def count_ascii_alpha_chars(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[a-zA-Z]"))


def detect_language(text: Column, threshold: float = 0.3) -> Column:
    """ko, en or unknown by the share of Hangul and ASCII letters among both."""
    ko, en = count_korean_chars(text), count_ascii_alpha_chars(text)
    total = ko + en
    return (
        F.when(text.isNull() | (total == 0), "unknown")
        .when(ko / total >= threshold, "ko")
        .when(en / total >= threshold, "en")
        .otherwise("unknown")
    )


def split_sentences(text: Column) -> Column:
    """Sentences: cut after . ? ! before a capital or at a line end; stripped, blanks dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?Umd)(?<=[.!?]){WHITE_SPACE}+(?=[A-Z])|(?<=[.!?])$", -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def tokenize(text: Column, analyser: Callable[[Column], Column] | None = None) -> Column:
    """Lower-cased words between white space, duplicates kept; or what an analyser plug-in gives."""
    if analyser is not None:
        return analyser(text)
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"(?U){WHITE_SPACE}+"), lambda t: t != "")


def file_hash(content: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(content, 256)


def parse_query_list(response: Column) -> Column:
    """The first JSON array of strings in a model's answer, a fenced one first; else empty."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    direct = F.regexp_extract(response, r"(?s)\[.*?\]", 0)
    as_list = lambda s: F.from_json(s, "array<string>")
    return F.coalesce(F.when(fenced != "", as_list(fenced)).otherwise(as_list(direct)), F.array().cast("array<string>"))


#: Fixed key fragments of values to mask.
SENSITIVE = ("password", "token", "api_key", "apikey", "secret", "authorization", "auth", "credential", "private_key")


def mask_sensitive(record: Column) -> Column:
    """A map whose values under sensitive keys are replaced; keys match as substrings, any case."""
    return F.transform_values(record, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE)), "***MASKED***").otherwise(v))


def dot(a: Column, b: Column) -> Column:
    """Inner product; the cosine similarity of normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def rrf_score(rank: Column, k: int = 60) -> Column:
    """Reciprocal rank, ranks from 1."""
    return F.lit(1.0) / (F.lit(k) + rank)


def references(content: Column, source: Column, score: Column) -> Column:
    """A citation: the first 500 characters, the source or "unknown", the score."""
    return F.struct(F.substring(content, 1, 500).alias("content"), F.coalesce(source, F.lit("unknown")).alias("source"), score.alias("score"))


def snippet(content: Column) -> Column:
    """The first 100 characters on one line, with an ellipsis."""
    return F.concat(F.replace(F.substring(content, 1, 100), F.lit("\n"), F.lit(" ")), F.lit("..."))


def to_snippets(hits: DataFrame) -> DataFrame:
    """(query_id, rank, score, content) as shown in lists: the score with four places, the content as a snippet."""
    return hits.select("query_id", "rank", F.format_string("%.4f", F.col("score")).alias("score"), snippet(F.col("content")).alias("snippet"))


def stored_filename(name: Column, epoch_ms: Column) -> Column:
    """A safe name for an upload, prefixed by its time."""
    return F.concat_ws("_", epoch_ms.cast("string"), F.regexp_replace(name, "[^a-zA-Z0-9가-힣._-]", "_"))

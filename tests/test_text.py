from pyspark.sql import functions as F

from scriptorium.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("o")).first()["o"]


def test_whitespace(spark):
    assert one(spark, "hello   world", T.normalize_whitespace) == "hello world"
    assert one(spark, "a\tb  \n c", T.normalize_whitespace) == "a b\n c"
    assert one(spark, "hello\n\n\n\nworld", T.normalize_newlines) == "hello\n\nworld"
    assert one(spark, "   hello world   ", T.normalize_text) == "hello world"
    assert one(spark, "ＡＢＣ①", T.normalize_unicode) == "ABC1"
    assert one(spark, None, T.normalize_unicode) is None


def test_pdf_text(spark):
    assert one(spark, "atten-\ntion is\nall\n\n\nyou  need", T.normalize_pdf_text) == "attention is all\n\nyou need"
    assert one(spark, None, T.normalize_pdf_text) == ""


def test_language(spark):
    for text, want in (("한국어 문장", "ko"), ("plain words", "en"), ("한국어가 섞인 mixed", "ko"), ("", "unknown"), ("   ", "unknown"), (None, "unknown")):
        assert one(spark, text, T.detect_language) == want


def test_sentences_and_tokens(spark):
    assert one(spark, "One is. Two? Three!", T.split_sentences) == ["One is.", "Two?", "Three!"]
    assert one(spark, " A b  A ", T.tokenize) == ["a", "b", "a"]
    assert one(spark, None, T.tokenize) == []


def test_query_list(spark):
    assert one(spark, 'x ```json\n["a", "b"]\n``` y', T.parse_query_list) == ["a", "b"]
    assert one(spark, 'say ["q"] now', T.parse_query_list) == ["q"]
    assert one(spark, "none", T.parse_query_list) == []


def test_masking(spark):
    row = spark.createDataFrame([({"user": "u", "API_KEY": "k", "author": "a"},)], "m map<string,string>").select(T.mask_sensitive(F.col("m")).alias("m")).first()
    assert row["m"] == {"user": "u", "API_KEY": "***MASKED***", "author": "***MASKED***"}

"""Long texts, repeated rows, clashing columns and empty tables through the operators on messages and URLs."""

from pyspark.sql import functions as F

from scriptorium.llm import quote_threads, url_filter


def test_messages_and_urls_of_no_rows(spark):
    talk = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert quote_threads.reply_ordered(talk).count() == 0
    long = "word " * 200_000
    told = spark.createDataFrame([(1, 0, "user", long), (1, 1, "user", "> " + "word " * 50 + "\nyes"), (1, 1, "user", "> " + "word " * 50 + "\nyes")], talk.schema).withColumn("root", F.lit(1)).withColumn("thread", F.lit("x"))
    assert sorted((r["turn"], r["reply_to"]) for r in quote_threads.reply_ordered(told).collect()) == [(0, None), (1, 0)]
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("b.com", "/", "block")], "host string, path string, action string")
    listed = spark.createDataFrame([("c.org", "/" + "p" * 100_000)], "host string, path string")
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://c.org/" + "p" * 100_000), (3, ""), (None, "http://b.com/")], "page_id long, url string").withColumn("key", F.lit("r:")).withColumn("verdict", F.lit("clash"))
    got = sorted((r["page_id"] or 0, r["verdict"]) for r in url_filter.filter_urls(pages, rules, listed).collect())
    assert got == [(0, "block"), (1, "block"), (1, "block"), (2, "block"), (3, "allow")]
    assert url_filter.filter_urls(pages.where("false"), rules, listed).count() == 0

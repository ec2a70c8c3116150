"""URL filtering by listed prefixes and listed canonical URLs, with DataFrame functions only.

Listed keys go into a blocked Bloom filter: a key's hash names one 64-bit block and four
bits in it, so a probe reads one row of the filter table. Keys that may be listed go on to
an exact join with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Filter bits for each listed key, and bits set for a key.
BITS_PER_KEY, BITS_SET = 16, 4
#: A filter of at most this many blocks (16 bytes each) is broadcast; a larger one is joined by shuffle.
MOST_BROADCAST_BLOCKS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From after the first :// to the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host and path without trailing slashes; scheme, query and fragment do not count."""
    return F.concat(host, F.regexp_replace(path, r"/+$", ""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for k in range(BITS_SET):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return out


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the column key; at most `blocks` rows."""
    return listed.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))


def possible_hits(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of keys whose column key the Bloom filter of listed does not rule out."""
    blocks = max(1, -(-listed.count() * BITS_PER_KEY // 64))
    table = bloom_filter(listed, blocks)
    if blocks <= MOST_BROADCAST_BLOCKS:
        table = F.broadcast(table)
    probe = keys.withColumn("block", _block(F.col("key"), blocks)).withColumn("mask", _mask(F.col("key")))
    return probe.join(table, "block").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).drop("block", "mask", "bits")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def filter_urls(pages: DataFrame, rules: DataFrame, listed_urls: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per row of pages.

    rules(host, path, action): a rule fits its host and all subdomains if the page's path
    starts with its path; the longest host and path together win, of equals the greatest
    in order; a rule listed with both actions blocks. Pages without a fitting rule are
    blocked if listed_urls(host, path) has the same canonical URL, else allowed. A null url
    or one without :// has empty host and path and is allowed, as listed URLs without a host
    count as absent, and rules with a null host too. Repeated rows get the same verdict each;
    a URL of any length is compared whole; an empty table gives an empty result. Extra
    columns are ignored.
    """
    rule_keys = rules.where("host IS NOT NULL").select(F.concat(F.lit("r:"), "host", F.coalesce("path", F.lit(""))).alias("key"), "action").groupBy("key").agg(F.max("action").alias("action"))
    url_keys = listed_urls.where("host <> ''").select(F.concat(F.lit("u:"), canonical_url(F.col("host"), F.coalesce("path", F.lit("")))).alias("key")).distinct().withColumn("action", F.lit("block"))
    listed = rule_keys.unionByName(url_keys)
    lengths = sorted(r[0] for r in rules.select(F.length(F.coalesce("path", F.lit("")))).distinct().collect())
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = lambda parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = _let(F.split("host", r"\."), labels)
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    prefixes = F.flatten(F.transform(hosts, lambda h: F.transform(fitting, lambda n: F.concat(F.lit("r:"), h, F.substring("path", F.lit(1), n)))))
    whole = F.when(F.col("host") != "", F.array(F.concat(F.lit("u:"), canonical_url(F.col("host"), F.col("path"))))).otherwise(F.array().cast("array<string>"))
    urls = split.select("host", "path").distinct()
    keys = urls.select("host", "path", F.explode(F.concat(prefixes, whole)).alias("key"))
    is_rule = F.col("key").startswith("r:")
    hits = possible_hits(keys, listed).join(listed, "key")
    rule = F.max(F.when(is_rule, F.struct(F.length("key").alias("size"), F.substring("key", 3, 1 << 30).alias("rule"), "action")))
    found = hits.groupBy("host", "path").agg(rule.alias("best"), F.max(F.when(~is_rule, F.col("action"))).alias("listed"))
    verdict = F.coalesce(F.col("best.action"), F.col("listed"), F.lit("allow"))
    return split.join(found, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))

"""URL filter: a blocked Bloom filter of listed canonical prefixes, then an exact hash join.

A rule is (host, path, verdict). It fits its host and all subdomains when the url's path starts with the
rule's path; the longest rule (host + path, then host, then text) wins. Each url is turned into its candidate keys
(every host suffix at a label boundary x every path prefix whose length some rule has). Keys that the
Bloom filter lets through go to an exact join with the rules, so its false positives never decide; keys that it rejects go nowhere.
Every host and path is looked up once, however many pages have it.

The Bloom filter is a table of 256-bit blocks (four longs), BITS_PER_KEY bits a key, eight probes inside one
block. It is broadcast only while its computed size is at most BROADCAST_BYTES; beyond, it joins by shuffle.

Defined results: null urls and urls without `://` have empty host and path, no rule and the default verdict;
repeated rows stay repeated; an empty rule table gives every url the default; null rule fields are dropped.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
PROBES = 8
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Host suffixes at label boundaries x path prefixes of the given lengths, as one array of keys."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(fits, lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))


def _probes(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key and its four 64-bit masks."""
    where, bits = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    words = []
    for w in range(4):
        mask = F.lit(0).cast("bigint")
        for p in range(PROBES):
            at = F.shiftrightunsigned(bits, 8 * p).bitwiseAND(F.lit(255))
            mask = mask.bitwiseOR(_bit(at, w))
        words.append(mask)
    return F.pmod(where, F.lit(blocks)), words


def _bit(at: Column, word: int) -> Column:
    inside = (at >= 64 * word) & (at < 64 * (word + 1))
    return F.when(inside, F.call_function("shiftleft", F.lit(1).cast("bigint"), (at - 64 * word).cast("int"))).otherwise(F.lit(0).cast("bigint"))


def bloom_table(keys: DataFrame, blocks: int) -> DataFrame:
    """One row per occupied block: block, w0..w3."""
    block, words = _probes(F.col("key"), blocks)
    marked = keys.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, rule (host + path of the winner, else null), verdict."""
    listed = (
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
        .dropna()
        .select(F.concat("rule_host", "rule_path").alias("key"), F.length("rule_host").alias("host_len"), F.length("rule_path").alias("path_len"), "rule_verdict")
        .groupBy("key")
        .agg(F.max(F.struct("host_len", "rule_verdict")).alias("w"), F.max("path_len").alias("path_len"))
    )
    facts = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path_len")).alias("lens")).first()
    base = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not facts["n"]:
        return base.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = max(1, -(-facts["n"] * BITS_PER_KEY // 256))
    bloom = bloom_table(listed, blocks)
    if blocks * 48 <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    # A result depends on host and path alone, so every pair of them is looked up once.
    pairs = base.select("host", "path").distinct()
    one = pairs.select("host", "path", F.explode(candidate_keys(F.col("host"), F.col("path"), facts["lens"])).alias("key"))
    block, words = _probes(F.col("key"), blocks)
    hit = F.lit(True)
    for i in range(4):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    probed = one.select("*", block.alias("block"), *[w.alias(f"m{i}") for i, w in enumerate(words)]).join(bloom, "block")
    possible = probed.where(hit).select("host", "path", "key")
    exact = possible.join(listed.select("key", "w"), "key")
    best = F.max(F.struct(F.length("key").alias("n"), F.col("w.host_len").alias("h"), F.col("key").alias("rule"), F.col("w.rule_verdict").alias("verdict")))
    found = exact.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", F.col("best.verdict").alias("found"))
    return base.join(found, ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))

"""URL filter: path rules, then a blocked Bloom filter before an exact hash join.

Listed canonical URLs are hashed into a Bloom filter whose every key sets eight
bits inside one 256-bit block (one bit in each of eight words).  The filter is a
table of blocks with a bounded number of rows and is broadcast; every row is
looked up where it is read, and what the filter lets pass is joined exactly with
the list, so a false positive costs one row in that join and never a verdict.
The listed URLs found are written and counted: up to ``BROADCAST_LIST`` of them
are broadcast to the table, more are joined by a shuffle, in which adaptive
execution splits a popular URL.  DataFrame functions only.

A list entry is a canonical URL: lower-case host without a leading www., then
the path without a trailing slash or .html.  ``host/`` lists a whole host with
its subdomains.  A URL is looked up under its own canonical form and under its
host's and parent domains' ``host/`` forms.

Edge cases: null URLs or such without ``://`` have empty host and path and are
looked up under nothing; repeated URLs and list entries are folded before the
joins; an empty list lets everything pass, an empty table gives an empty one;
of rules of equal length that fit, the one given last decides; URLs are taken
whole, however long; columns of the table with the names of outputs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Upper bound of the filter's blocks (32 bytes of bits each): what is broadcast
#: stays below about 20 MB; longer lists raise only the false-positive rate.
MAX_BLOCKS = 1 << 17
#: Bits a listed URL gets in the filter while the bound allows it.
BITS_PER_KEY = 16
#: Lists of at most so many entries are broadcast in the exact join.
BROADCAST_LIST = 100_000


@dataclass(frozen=True)
class PathRule:
    """Fits its host and subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def canonical(host: Column, path: Column) -> Column:
    """The form under which a single page is listed."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/|\.html?)$", ""))


def lookup_keys(host: Column, path: Column) -> Column:
    """The page's own form, and ``h/`` for its host and each parent domain."""
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.concat(F.array_join(F.slice(labels, k, F.size(labels)), "."), F.lit("/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(F.array(canonical(host, path)), parents)))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bit of each of the block's eight words, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 5 * w).bitwiseAND(F.lit(31).cast("long")).cast("int")) for w in range(8)]


def bloom_blocks(listed: DataFrame, n_blocks: int, key: str = "key") -> DataFrame:
    """(block, w0..w7): the filter's non-empty blocks, at most ``n_blocks`` rows."""
    marks = listed.select(_block(F.col(key), n_blocks).alias("block"), *[b.alias(f"w{w}") for w, b in enumerate(_bits(F.col(key)))])
    return marks.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(8)])


def may_be_listed(keys: DataFrame, blocks: DataFrame, n_blocks: int, key: str = "key") -> DataFrame:
    """The rows of ``keys`` that the filter lets pass: all listed ones, few others."""
    probe = keys.withColumn("block", _block(F.col(key), n_blocks)).join(F.broadcast(blocks), "block")
    test = F.lit(True)
    for w, b in enumerate(_bits(F.col(key))):
        test = test & (F.col(f"w{w}").bitwiseAND(b) == b)
    return probe.filter(test).select(*keys.columns)


def listed_urls(urls: DataFrame, listed: DataFrame, url: str = "url", key: str = "key") -> DataFrame:
    """Distinct URLs of ``urls`` that a list entry covers, one column ``url``.

    Every row is looked up in the broadcast filter where it is read; only possible hits are shuffled.
    """
    listed = listed.select(F.col(key).alias("key")).where("key is not null").distinct()
    n = listed.count()
    n_blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // 256)))
    keys = urls.select(F.col(url).alias("url")).where("url is not null")
    keys = keys.select("url", F.explode(lookup_keys(host_of(F.col("url")), path_of(F.col("url")))).alias("key"))
    hits = may_be_listed(keys, bloom_blocks(listed, n_blocks), n_blocks).distinct()
    exact = F.broadcast(listed) if n <= BROADCAST_LIST else listed.hint("shuffle_hash")
    return hits.join(exact, "key").select("url").distinct()


def judge(pages: DataFrame, rules, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, listed (boolean) and verdict.

    The rule that fits decides; where none fits, a listed URL is blocked and any
    other is allowed.  Only URLs that no rule decides are looked up.
    """
    made = ("host", "path", "rule", "rule_verdict", "listed", "verdict")
    kept = [c for c in pages.columns if c not in made]
    split = pages.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": name, "rule_verdict": verdict})
    hits = materialise(listed_urls(ruled.where("rule is null"), listed, url).select(F.col("url").alias("_hit")))
    few = hits.limit(BROADCAST_LIST + 1).count() <= BROADCAST_LIST  # then the table itself is not shuffled
    return ruled.join(F.broadcast(hits) if few else hits, F.col(url) == F.col("_hit"), "left").select(
        *kept, "host", "path", "rule", F.col("_hit").isNotNull().alias("listed"),
        F.coalesce("rule_verdict", F.when(F.col("_hit").isNotNull(), "block").otherwise("allow")).alias("verdict"))

"""URL rules: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A URL can fit a rule only if one of its host's suffixes with one of its path's prefixes is listed, so these
keys are its probes. The filter answers most with a no inside the scan; the few others go to the hash join,
which drops the false positives. Built-in functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import constant, row_key, table

#: Bits of a block, and bits that a key sets in its one block.
BLOCK, PROBES = 64, 4
#: The filter may hold so many blocks (4 MB) and the joined rules so many rows before they are shuffled instead.
MAX_BLOCKS, MAX_BROADCAST_RULES = 1 << 19, 1 << 16

#: Columns that the judgement makes.
REPLACED = {"host", "path", "rule", "verdict"}

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def _mask(h: Column) -> Column:
    """PROBES bits of a block, from six bits of the hash each."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")) for k in range(PROBES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def blocks_for(rows: int) -> int:
    """A power of two of blocks, for 16 bits a key."""
    return 1 << max(0, min(math.ceil(math.log2(max(1, rows * 16 / BLOCK))), int(math.log2(MAX_BLOCKS))))


def _block(h: Column, blocks: int) -> Column:
    """Index of the block, from bits that the mask doesn't use; blocks is a power of two."""
    return F.shiftrightunsigned(h, 32).bitwiseAND(blocks - 1).cast("int")


def filter_of(rules: DataFrame, rows: int) -> list[int]:
    """The blocks of the filter over rules' keys; at most MAX_BLOCKS numbers reach the driver."""
    blocks = blocks_for(rows)
    h = F.xxhash64("rule_host", "rule_path")
    filled = (
        rules.select(_block(h, blocks).alias("block"), _mask(h).alias("mask"))
        .groupBy("block")
        .agg(F.bit_or("mask").alias("mask"))
        .collect()
    )
    out = [0] * blocks
    for block, mask in filled:
        out[block] = mask
    return out


def _pages(pages: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """page (a struct of the columns that stay), host, path and keys: the listed keys that may fit, as the filter says.

    No rule has more labels in its host than the longest one, so no longer suffix of a host can be listed.
    """
    sized = (
        rules.agg(F.collect_set(F.length("rule_path")).alias("lengths"), F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"))
        .first()
    )
    bits, blocks = constant(filter_of(rules, n_rules), "array<bigint>"), blocks_for(n_rules)
    lengths, most = constant(sorted(sized["lengths"]), "array<int>"), F.lit(sized["labels"] or 1)

    own = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in REPLACED]
    seen = pages.select(F.struct(*own).alias("page"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size("labels"), most)),
        lambda k: F.array_join(F.slice("labels", F.size("labels") - k + 1, k), "."),
    )
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(fitting, lambda n: F.struct(s.alias("rule_host"), F.left("path", n).alias("rule_path"))),
        ),
    )

    def passes(key: Column) -> Column:
        h = F.xxhash64(key["rule_host"], key["rule_path"])
        return bits[_block(h, blocks)].bitwiseAND(_mask(h)) == _mask(h)

    none = F.array().cast("array<struct<rule_host:string,rule_path:string>>")
    cut = seen.withColumn("labels", labels)
    return cut.select("page", "host", "path", F.when(F.col("host") == "", none).otherwise(F.filter(keys, passes)).alias("keys"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; rules has verdict, rule_host and rule_path.

    The longest fitting rule wins, host and path together; of equally long ones the longer host. No fitting
    rule, no :// and a null url give default and a null rule. Repeated pages stay repeated, in no order. Of rules
    listed twice, block wins. Columns named host, path, rule and verdict, in any case, are replaced; others stay,
    whatever their names. Pages that the filter rules out are neither joined nor shuffled.
    """
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    n_rules = rules.count()
    probed = _pages(pages, rules, n_rules)
    listed = F.broadcast(rules) if n_rules <= MAX_BROADCAST_RULES else rules
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("verdict"),
    )
    free = (
        probed.where(F.size("keys") == 0)
        .select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    )
    met = probed.where(F.size("keys") > 0).withColumn("row", row_key()).select("row", "page", "host", "path", F.explode("keys").alias("k"))
    judged = (
        met.join(listed, (F.col("k.rule_host") == F.col("rule_host")) & (F.col("k.rule_path") == F.col("rule_path")), "left")
        .groupBy("row")
        .agg(F.first("page").alias("page"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("verdict").isNotNull(), rank)).alias("won"))
        .select("page.*", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
    )
    return free.unionByName(judged)


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, by RULES; a null url has an empty host and path."""
    return (
        judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules_frame(spark))
        .select("page_id", "host", "path", "rule", "verdict")
    )


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(verdict, rh, rp) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), f AS (
  SELECT h.*, rh || rp AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC NULLS LAST, length(rh) DESC) AS k
  FROM h LEFT JOIN r ON host <> '' AND (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

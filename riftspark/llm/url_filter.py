"""Operator 4: URL filters.

Rules by host and path come first; the longest that fits decides. Other URLs are looked up in a list of canonical URLs:
a blocked Bloom filter of the list passes possible hits, and an exact hash join of those with the list removes the
false positives. The filter has blocks of 256 bits, eight words of 32; a key sets a bit in each word of one block.
It is a table of blocks, built by bit_or and probed by a join on the block's number: broadcast if it is small enough,
by shuffle otherwise. All rows are probed in one pass whose result is kept; only possible hits are joined with the list. Sixteen bits a key pass about one in a thousand URLs that aren't listed.

Native: DataFrame functions only.

Edge cases: a null URL or one without :// has an empty host and path, no rule, and is allowed; an empty list blocks
nothing; repeated URLs are judged alike; clashing columns are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Blocks of the filter up to which it is broadcast: 60 bytes each, 30 MB.
BROADCAST_BLOCKS = 500_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and canonical. Canonical: host without www. and default port, path without its last slashes, query
    without utm_ parameters, no fragment."""
    out = df.withColumn("__url", F.coalesce(F.col(url), F.lit(""))).withColumn("__rest", _rest(F.col("__url")))
    out = out.withColumn("__host", F.regexp_extract("__rest", "^[^/?#]*", 0))
    out = out.withColumn("__tail", F.expr("substring(__rest, length(__host) + 1)"))
    out = out.withColumn("host", lower_ascii(F.col("__host"))).withColumn("path", F.regexp_extract("__tail", "^[^?#]*", 0))
    query = F.regexp_extract("__tail", r"^[^?#]*\?([^#]*)", 1)
    rest = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")), "&")
    site = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), r":(80|443)$", "")
    canonical = F.concat(site, F.regexp_replace("path", "/+$", ""), F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))
    return out.withColumn("canonical", F.when(F.col("__rest") != "", canonical)).drop("__url", "__rest", "__host", "__tail")


def ruling(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The fitting rule of most characters (of more host, if equal) as text, and its verdict; else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) & F.startswith(F.col("path"), F.lit(r.path))
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(8)]


def bloom(listed: DataFrame, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """The filter of a kept table of canonical URLs as a kept table (block, w0..w7), and its number of blocks."""
    blocks = max(1, -(-listed.count() * bits_per_key // 256))
    keyed = listed.select(_block(F.col("canonical"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("canonical")))])
    return common.keep(keyed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]), "bloom"), blocks


def possible(df: DataFrame, table: DataFrame, blocks: int, key: str = "canonical", name: str = "possible") -> DataFrame:
    """Add the column of that name: false for no URL of the list, and for null keys."""
    # null keys are dealt out by the whole row where the filter is too large to be broadcast
    spread = -1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1 << 20))
    at = F.when(F.col(key).isNotNull(), _block(F.col(key), blocks)).otherwise(spread)
    bits = common.maybe_broadcast(table, BROADCAST_BLOCKS)
    bits = bits.select(*[F.col(c).alias(f"__{c}") for c in bits.columns])
    probed = df.withColumn("__block", at).join(bits, "__block", "left")
    hit = F.col(key).isNotNull()
    for i, m in enumerate(_masks(F.col(key))):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(m) == m)
    return probed.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__block", *[f"__w{i}" for i in range(8)])


def judge(df: DataFrame, listed: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add host, path, canonical, rule and verdict to each row. listed: a table whose column canonical is the list."""
    urls = common.keep(listed.select("canonical").where("canonical is not null").distinct(), "listed")
    table, blocks = bloom(urls)
    name, verdict = ruling(rules)
    own = [c for c in df.columns if c.lower() not in ("host", "path", "canonical", "rule", "verdict")]
    rows = parts(df.select(*[F.col(f"`{c}`") for c in own]), url).withColumn("rule", name).withColumn("verdict", verdict)
    columns = [*own, "host", "path", "canonical", "rule"]
    # URLs with a rule have no key, and so no block and no possible hit
    probed = possible(rows.withColumn("__key", F.when(F.col("verdict").isNull(), F.col("canonical"))), table, blocks, "__key", "__possible")
    probed = common.keep(probed.select(*columns, "verdict", "__possible"), "probed")
    checked = probed.where("__possible").join(urls.withColumn("__listed", F.lit(True)), "canonical", "left")
    checked = checked.select(*columns, F.when(F.col("__listed"), "block").otherwise("allow").alias("verdict"))
    others = probed.where("not __possible").select(*columns, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    return checked.unionByName(others)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page. The list: canonical URLs of which the crawl holds a copy with a utm_ parameter, that is,
    pages that were fetched through a campaign link."""
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url")
    listed = parts(pages.where(F.col("url").rlike(r"[?&]utm_[^#]*"))).select("canonical")
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = r"""
WITH a AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), b AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM a
), c AS (
  SELECT *, substr(rest, length(h) + 1) AS tail, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM b
), d AS (
  SELECT *, regexp_extract(tail, '^[^?#]*') AS path,
    array_to_string(list_filter(string_split(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS query
  FROM c
), e AS (
  SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical
  FROM d
), listed AS (
  SELECT DISTINCT canonical FROM e WHERE rest <> '' AND regexp_matches(url, '[?&]utm_[^#]*')
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM e
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM listed) AND rest <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

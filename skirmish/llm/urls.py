"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

Each key sets four bits in one 64-bit block. A URL that misses the filter is surely not listed; possible hits go on to
an exact hash join, which removes the false positives. The filter is a table of blocks, built as an aggregate and met by
block number: a join of two integers a row, which the planner broadcasts or shuffles by the table's measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.session import stage

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without a final ``.html`` or ``/``; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def bits_of(key: Column) -> Column:
    h = F.xxhash64(F.lit("bits"), key)
    parts = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def with_possible(df: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """Adds ``possible``: whether a key may be among the ``key`` values of ``listed``."""
    blocks = 1 << max(6, int(listed.count() // 4).bit_length())  # about 16 bits a key or more
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    held = stage(listed.groupBy(block.alias("block_")).agg(F.bit_or(bits_of(F.col(key))).alias("bits_")), "blocks")
    asked = bits_of(F.col(key))
    probed = df.withColumn("block_", block).join(held, "block_", "left")
    return probed.withColumn("possible", F.coalesce(F.col("bits_").bitwiseAND(asked) == asked, F.lit(False))).drop("block_", "bits_")


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row; ``listed`` holds canonical URLs in ``canonical``.

    A null url, or one without ``://``, has an empty host and path, no rule, and is allowed. Nulls in ``listed`` are
    left out, repeated ones count once. Repeated rows and null ids keep their rows; other columns are not read.
    """
    url = F.col(url_column)
    rows = pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    names = stage(listed.where("canonical is not null and canonical <> ''").select("canonical").distinct(), "listed")
    ruled = rows.withColumns({"rule": rule, "by_rule": verdict, "canonical": canonical(F.col("host"), F.col("path"))})
    settled = F.col("by_rule").isNotNull()
    probed = stage(with_possible(ruled.where(~settled), "canonical", names), "probed")
    exact = probed.where("possible").join(names.withColumn("hit", F.lit(True)), "canonical", "left")
    columns = ["page_id", "host", "path", "rule"]
    asked = exact.select(*columns, F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    free = probed.where("not possible").select(*columns, F.lit("allow").alias("verdict"))
    return ruled.where(settled).select(*columns, F.col("by_rule").alias("verdict")).unionByName(free).unionByName(asked)


def tracked(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs that are handed out with a tracking parameter somewhere in ``pages``."""
    url = F.col("url")
    return pages.where(url.contains("utm_source=")).select(canonical(host_of(url), path_of(url)).alias("canonical"))


SQL = r"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canonical,
  CASE WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN '.' || host LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN '.' || host LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN '.' || host LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN canonical <> '' AND canonical IN (SELECT canonical FROM c WHERE contains(url, 'utm_source=')) THEN 'block' ELSE 'allow' END AS verdict FROM c
"""

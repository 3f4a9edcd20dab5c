"""URL filters with DataFrame functions: host and path rules, and a blocked Bloom filter before an exact join.

Listed URLs are brought to a canonical form and hashed into a blocked Bloom filter: a table of blocks of eight 64-bit
words, in which a URL sets one bit per word of its block. A page is a possible hit if its block holds all of its eight
bits; only possible hits go on to the exact hash join with the listed URLs, which removes the false ones.

The filter has one row per block, so its size follows from its parameter; within `broadcast_blocks` it is broadcast,
beyond that the same join shuffles. The exact join never broadcasts by hint.

Cases: an empty table gives an empty table; a url of any length is one row, read by three patterns; of two rules with
equal length the first listed one wins; columns of pages whose names begin with two underscores, as this module's own do,
raise ValueError, others pass by; a null url, or one without ://, has an empty host and path, fits no rule and is not listed; listed nulls are
passed by; repeated listed URLs count once; repeated pages give repeated rows; an empty list lets everything pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower

#: Verdict, host, path of the rules; a rule fits the host, its subdomains, and paths that start with its own.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The default list, made by crossing: names, ends, languages and page numbers of link farms.
FARMS, ENDS, LANGS, PAGES = ["spam-farm", "cheap-pills", "casino-win"], ["com", "net", "org"], ["en", "de", "fr", "es"], 10_000
WORDS = 8
BITS_PER_URL = 16
BROADCAST_BLOCKS = 1 << 16  # 72 bytes each


def host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or m., path without a final slash or .html; no scheme, query or fragment. Null without a host."""
    plain = F.concat(F.regexp_replace(host(url), r"^(?:www\.|m\.)+", ""), F.regexp_replace(path(url), r"(?:/|\.html)$", ""))
    return F.when(host(url) != "", plain)


def default_list(spark: SparkSession) -> DataFrame:
    """The listed URLs that the rule above makes."""
    pages = spark.range(PAGES, numPartitions=4)
    each = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    made = pages.select("id", each(FARMS, "farm")).select("*", each(ENDS, "tld")).select("*", each(LANGS, "lang"))
    return made.select(F.concat(F.lit("http://"), "farm", F.lit(".example."), "tld", F.lit("/"), "lang", F.lit("/"), F.col("id").cast("string")).alias("url"))


def bit(name: Column, k: int) -> Column:
    """The bit that a URL sets in word k of its block."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(F.xxhash64(name, F.lit("bits")), 6 * k), F.lit(64)).cast("int"))


def block(name: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(name, F.lit("block")), F.lit(blocks))


def build(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: __block and __w0 to __w7. listed: one column `name` of canonical URLs."""
    words = [F.bit_or(bit(F.col("name"), k)).alias(f"__w{k}") for k in range(WORDS)]
    return listed.groupBy(block(F.col("name"), blocks).alias("__block")).agg(*words)


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """pages with __host, __path, __rule, __possible, __listed and __verdict."""
    if taken := [c for c in pages.columns if c.startswith("__")]:
        raise ValueError(f"columns must not begin with two underscores: {', '.join(taken)}")
    names = listed.select(canonical(F.col("url")).alias("name")).where(F.col("name").isNotNull()).distinct()
    blocks = max(1, names.count() * BITS_PER_URL // 512 + 1)
    bloom = build(names, blocks)
    if blocks <= broadcast_blocks:
        bloom = F.broadcast(bloom)
    fits = [((F.col("__host") == h) | F.endswith("__host", F.lit("." + h))) & F.startswith("__path", F.lit(p)) for _, h, p in RULES]
    longest = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][1] + RULES[i][2]))
    pick = lambda values: F.coalesce(*[F.when(fits[i], F.lit(values[i])) for i in longest])
    read = pages.withColumn("__host", host(F.col(url))).withColumn("__path", path(F.col(url))).withColumn("__name", canonical(F.col(url)))
    ruled = read.withColumn("__rule", pick([h + p for _, h, p in RULES])).withColumn("__by_rule", pick([v for v, _, _ in RULES]))
    # pages without a name meet no block, and are dealt out by their place, not gathered under null
    nowhere = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))
    probed = ruled.withColumn("__block", F.coalesce(block(F.col("__name"), blocks), nowhere)).join(bloom, "__block", "left")
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & (F.col(f"__w{k}").bitwiseAND(bit(F.col("__name"), k)) != 0)
    possible = probed.withColumn("__possible", F.coalesce(hit & F.col("__name").isNotNull(), F.lit(False))).drop("__block", *[f"__w{k}" for k in range(WORDS)])
    # only possible hits meet the list, so no task gets the many that are none
    met = possible.where("__possible").join(names.select(F.col("name").alias("__name"), F.lit(True).alias("__in")), "__name", "left")
    exact = met.unionByName(possible.where("not __possible").withColumn("__in", F.lit(None).cast("boolean")))
    verdict = F.coalesce("__by_rule", F.when(F.col("__in"), "block").otherwise("allow"))
    return exact.withColumn("__listed", F.coalesce("__in", F.lit(False))).withColumn("__verdict", verdict).drop("__in", "__name", "__by_rule")


def report(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, listed."""
    listed = default_list(pages.sparkSession) if listed is None else listed
    columns = [F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict", "listed")]
    return judge(pages.select("page_id", "url"), listed).select("page_id", *columns)


#: The same rows in SQL, the list joined directly.
SQL = r"""
WITH read AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(?:www\.|m\.)+', '') || regexp_replace(path, '(?:/|\.html)$', '') END AS name FROM read),
list AS (
  SELECT f || '.example.' || e || '/' || l || '/' || CAST(n AS VARCHAR) AS name
  FROM unnest(['spam-farm', 'cheap-pills', 'casino-win']) a(f), unnest(['com', 'net', 'org']) b(e), unnest(['en', 'de', 'fr', 'es']) c(l), range(10000) d(n)),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM named)
SELECT page_id, host, path, rule, list.name IS NOT NULL AS listed,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN list.name IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN list USING (name)
"""

"""URL rules behind a blocked Bloom filter.

Listed keys (rule host + rule path) are hashed into a blocked Bloom filter: a table of
256-bit blocks, each row four longs, so that a probe reads one block. Every distinct
(host, path) is expanded into the keys that could list it (each host suffix at a label
boundary with the path prefixes of the lengths that rules have); keys that pass their
block go to an exact hash join with the rules, which removes the false positives.

Defined results: a null url, or one without ``://``, has an empty host and path and the
default verdict; repeated rows are judged alike, a row each; an empty rule list gives
the default verdict to all; other columns are ignored; of fitting rules the longest
(host and path together) wins, then the one with the longer host; a rule that is listed
with two verdicts takes the greater name of them (block before allow).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm.common import table

#: The contract's rules: host, path, verdict.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
#: Filter blocks (48 bytes each) up to this many are broadcast; more are joined by a shuffle.
MAX_BROADCAST_BLOCKS = 200_000
PROBES = 6


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """Four longs with the key's probe bits: each probe takes 8 bits of a second hash."""
    h, words = F.xxhash64(F.lit("bits"), key), [F.lit(0).cast("long")] * 4
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 8 * i).bitwiseAND(F.lit(255))
        one = F.expr("cast(1 as bigint)")
        mask = F.call_function("shiftleft", one, bit.bitwiseAND(F.lit(63)).cast("int"))
        words = [w.bitwiseOR(F.when(F.shiftright(bit, 6) == k, mask).otherwise(F.lit(0).cast("long"))) for k, w in enumerate(words)]
    return words


def build_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block, w0..w3 of the keys in column key."""
    rows = keys.select(_block(F.col("key"), n_blocks).alias("block"), *[m.alias(f"w{k}") for k, m in enumerate(_masks(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(4)])


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """rules: host, path, verdict. Returns id, host, path, rule, verdict of each row of urls."""
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), F.length("path").alias("path_len"), "verdict")
    n_rules = rules.count()
    pages = urls.select(F.col(id_col).alias(id_col), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    if not n_rules:
        return pages.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_blocks = max(1, -(-n_rules * 10 // 256))
    blocks = build_filter(rules.select(F.col("rule").alias("key")), n_blocks)
    if n_blocks <= MAX_BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    # Distinct first: a host that a third of the rows name is judged once for each path.
    sites = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # The lengths that rules' paths have: k of them take at least k * k / 2 characters of the list.
    lengths = rules.agg(F.sort_array(F.collect_set("path_len")).alias("lengths")).scalar()
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = (
        sites.where("host <> ''")
        .withColumn("lengths", lengths)
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumns({"key": F.concat("suffix", "prefix"), "suffix_len": F.length("suffix")})
    )
    keys = keys.withColumn("block", _block(F.col("key"), n_blocks)).join(blocks, "block")
    passed = keys
    for k, m in enumerate(_masks(F.col("key"))):
        passed = passed.where(F.col(f"w{k}").bitwiseAND(m) == m)
    hits = passed.join(rules, (F.col("key") == F.col("rule")) & (F.col("suffix_len") == F.col("host_len")))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct((F.col("host_len") + F.col("path_len")).alias("n"), "host_len", "rule", "verdict")).alias("best")
    )
    out = pages.join(best, ["host", "path"], "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), r(h, pre, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""

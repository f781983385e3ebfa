"""URL filter by host-suffix and path-prefix rules, in DataFrame functions alone.

A URL is expanded into the expressions that some rule could equal: for each shape (host labels, path length) found
among the rules, the host's last labels followed by that much of the path. Expressions meet rules in an equi-join on
the first hex digits of their SHA-256; the full digests then decide, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SHORT = 8  # hex digits of the join key

# The rules of the registered query: (host, path, action).
SITE_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def url_host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, action) as a table."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules])
    return spark.range(1).select(F.inline(rows))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to `pages`; every row stays, repeated ones too.

    rules: host, path, action. A rule fits its host and all subdomains where the path starts with the rule's path.
    The longest rule (characters of host and path; then of the host; then its text) wins, and where two rows state one
    rule, `block` goes before `allow`. A null URL, or one without `://`, has an empty host and path; only the empty
    host's rules could fit it. Null fields of a rule make it fit nothing. Without a fitting rule: null rule, `default`.

    The shapes of the rules go through the driver: a few hundred at most (label counts by path lengths), however many
    rules there are. The rules themselves stay a table, so Spark picks the join by their size.
    """
    rules = rules.select("host", "path", "action").where("host is not null and path is not null and action is not null")
    known = (
        rules.select(
            F.concat("host", "path").alias("rule"),
            F.col("action"),
            F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"),
            F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("t"), (F.col("action") == "block").cast("int").alias("b")).alias("rank"),
        )
        .withColumn("key", F.substring("digest", 1, SHORT))
    )
    shapes = rules.select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("n")).distinct().collect()
    shape = F.array(*[F.struct(F.lit(s["labels"]).alias("take"), F.lit(s["n"]).alias("n")) for s in shapes]).cast("array<struct<take:int,n:int>>")
    urls = pages.select(F.col(url_col).alias("url")).where(F.col("url").isNotNull()).distinct()
    urls = urls.select("url", F.split(url_host(F.col("url")), r"\.", -1).alias("labels"), url_path(F.col("url")).alias("path"))
    expanded = urls.select("url", "labels", "path", F.inline(shape)).where("size(labels) >= take and length(path) >= n")
    suffix, prefix = F.array_join(F.expr("slice(labels, -take, take)"), "."), F.expr("substring(path, 1, n)")
    posted = expanded.select("url", F.sha2(F.concat(suffix, F.lit("\n"), prefix), 256).alias("seen"))
    best = (
        posted.withColumn("key", F.substring("seen", 1, SHORT))
        .join(known, "key")
        .where("seen = digest")
        .groupBy("url")
        .agg(F.max(F.struct("rank", "rule", "action")).alias("best"))
    )
    # Null URLs match nothing; a part of their own each spreads them over the join's tasks.
    key, part, judged, known, spread = unused(pages, "url_key", "url_part", "judged", "known", "spread")
    best = best.select(F.col("url").alias(known), F.lit(-1).alias(spread), F.col("best").alias(judged))
    url = F.col(url_col)
    out = pages.withColumns({key: F.coalesce(url, F.lit("")), part: F.when(url.isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(-1).cast("int")})
    out = out.join(best, (F.col(key) == F.col(known)) & (F.col(part) == F.col(spread)), "left")
    kept = [F.col(c) for c in pages.columns if c not in {"host", "path", "rule", "verdict"}]
    return out.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"), F.col(f"{judged}.rule").alias("rule"), F.coalesce(F.col(f"{judged}.action"), F.lit(default)).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page by SITE_RULES.

    Rows that repeat stay; a null URL, or one without `://`, has an empty host and path, no rule and the verdict allow. No
    two of these rules tie. An empty table gives no rows. Only page_id and url are read, so other columns can't clash.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, SITE_RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

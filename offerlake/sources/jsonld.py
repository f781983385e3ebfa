"""JSON-LD of pages: blocks, their objects at any depth, job postings, offers."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlake import dims
from offerlake.functions.dates import parse_datetime
from offerlake.functions.text import clean_text, once, strip_html, unescape
from offerlake.schema import canonical, settled
from offerlake.storage import place_for

# What a node is, told by its own values alone: nothing below them is looked at.
IS_OBJECT = "try_variant_get(node, '$', 'map<string, variant>') is not null"
IS_ARRAY = "try_variant_get(node, '$', 'array<variant>') is not null"
IN_ROW, STEP = 8, 11  # levels worked out on a block's own row; characters of a path for each level
BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def ld_blocks(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row for each JSON-LD block that can be read: the page's columns without its HTML, block, node (variant).

    Raw control characters inside strings (tabs, line ends) become blanks first; blocks that still can't be read go.
    """
    raw = F.transform(F.regexp_extract_all(html_col, F.lit(BLOCK), F.lit(1)), lambda x: F.regexp_replace(x, "[\\x00-\\x1f]", " "))
    keys = [c for c in pages.columns if c != html_col]
    blocks = settled(pages.select(*keys, raw.alias("__raw"))).select(*keys, F.posexplode("__raw").alias("block", "raw"))  # Spark filters by what it explodes
    return settled(blocks.withColumn("node", F.try_parse_json("raw"))).where("node is not null").drop("raw")  # parsed once


def placed(node: Column, path: Column) -> Column:
    """An object or array with its place; null for any other value. An object is told by a cast that copies none of it."""
    as_ = lambda object_: F.struct(path.alias("path"), node.alias("node"), F.lit(object_).alias("object"))
    return F.when(F.try_variant_get(node, "$", "struct<>").isNotNull(), as_(True)).when(F.try_variant_get(node, "$", "array<variant>").isNotNull(), as_(False))


def inner(level: Column) -> Column:
    """The objects and arrays that those of a level hold."""

    def below(n: Column) -> Column:
        held = F.when(n["object"], F.map_values(F.try_variant_get(n["node"], "$", "map<string, variant>"))).otherwise(F.try_variant_get(n["node"], "$", "array<variant>"))
        return F.array_compact(F.transform(held, lambda v, i: placed(v, F.concat(n["path"], F.lit("/"), F.lpad(i.cast("string"), STEP - 1, "0")))))

    return F.flatten(F.transform(level, below))


def ld_walk(blocks: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Every object of the blocks, at any depth, with its level below the top; only the wanted ones, if a condition on
    `node` is given.

    The first levels are worked out on the block's own row and written once, without what isn't wanted. Objects and arrays
    below them, which are rare, follow level by level, each one explode of those of the level before, written to a folder of
    their own in spark.checkpoint.dir, until a level has none. (The JSON parser itself takes 1000 levels; deeper blocks
    can't be read.)
    """
    spark, wanted = blocks.sparkSession, F.lit(True) if wanted is None else wanted
    path = place_for(spark, "walk")
    keys = [c for c in blocks.columns if c != "node"]
    top = F.array_compact(F.array(placed(F.col("node"), F.lit(""))))
    deeper = lambda a, _: once(inner(a["last"]), lambda own: F.struct(F.concat(a["all"], own).alias("all"), own.alias("last")))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(IN_ROW)), F.struct(top.alias("all"), top.alias("last")), deeper)["all"]
    nodes = settled(blocks.select(*keys, found.alias("__found"))).select(*keys, F.explode("__found").alias("n")).select(*keys, "n.path", (F.length("n.path") / STEP).cast("int").alias("level"), "n.node", "n.object")
    nodes.where((F.col("level") == IN_ROW) | (F.col("object") & wanted)).drop("object").write.parquet(f"{path}/{IN_ROW}")
    read = spark.read.schema(nodes.drop("object").schema).parquet(f"{path}/{IN_ROW}")
    out, level = read.where(F.col("level") < IN_ROW), read.where(F.col("level") == IN_ROW).drop("level")
    for k in itertools.count(IN_ROW):
        if level.isEmpty():
            return out
        out = out.unionByName(level.where(F.expr(IS_OBJECT) & wanted).select(*keys, "path", F.lit(k).alias("level"), "node"))
        below = spark.sql("SELECT t.* EXCEPT (node, path), concat(t.path, '/', lpad(CAST(v.pos AS STRING), 10, '0')) AS path, v.value AS node FROM {level} t, LATERAL variant_explode(t.node) v", level=level)
        below.select(*keys, "path", "node").where(f"{IS_OBJECT} or {IS_ARRAY}").write.parquet(f"{path}/{k + 1}")
        level = spark.read.schema(level.schema).parquet(f"{path}/{k + 1}")


def text_at(path: str) -> Column:
    return F.try_variant_get("node", path, "string")


def is_posting() -> Column:
    """@type is JobPosting, alone or in a list, in any case."""
    one, many = text_at("$['@type']"), F.try_variant_get("node", "$['@type']", "array<string>")
    return F.coalesce(F.lower(one) == "jobposting", F.lit(False)) | F.coalesce(F.exists(many, lambda t: F.lower(t) == "jobposting"), F.lit(False))


def postings(nodes: DataFrame, page: list[str]) -> DataFrame:
    """Job postings of a page, each url, @id or title once: the first in the order of the page."""
    key = F.coalesce(F.nullif(text_at("$.url"), F.lit("")), F.nullif(text_at("$['@id']"), F.lit("")), F.nullif(text_at("$.title"), F.lit("")), F.concat_ws("/", F.col("block").cast("string"), "path"))
    found = nodes.where(is_posting()).withColumn("key", key)
    first = F.row_number().over(W.partitionBy(*page, "key").orderBy("block", "path"))
    return found.withColumn("k", first).where("k = 1").drop("k")


def page_postings(pages: DataFrame, page: list[str], html_col: str = "html") -> DataFrame:
    """The job postings of pages, of whose objects no others are carried on."""
    return postings(ld_walk(ld_blocks(pages, html_col), is_posting()), page)


def named(path: str) -> Column:
    """Readable text of a value: a string, or an object's name or value, or a list of strings."""
    many = F.try_variant_get("node", path, "array<string>")
    plain = F.when(~F.startswith(F.coalesce(text_at(path), F.lit("")), F.lit("{")), text_at(path))
    return unescape(F.coalesce(text_at(f"{path}.name"), text_at(f"{path}.value"), F.array_join(many, ", "), plain, F.lit("")))


def location() -> Column:
    """Locality, region and country without repeats, else the place's name; Remote for telecommuting."""
    at = lambda tail: F.coalesce(text_at(f"$.jobLocation{tail}"), text_at(f"$.jobLocation[0]{tail}"))
    parts = F.array_distinct(F.array_compact(F.array(*[F.nullif(at(f".address.{k}"), F.lit("")) for k in ("addressLocality", "addressRegion", "addressCountry")])))
    plain = at(".address")
    parts = F.when(F.size(parts) > 0, parts).when(~F.startswith(plain, F.lit("{")) & (plain != ""), F.array(plain)).otherwise(F.array_compact(F.array(F.nullif(at(".name"), F.lit("")))))
    remote = F.when(F.upper(text_at("$.jobLocationType")) == "TELECOMMUTE", F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(parts, remote), ", ")


def employment() -> Column:
    """The first employment type that is known."""
    table = F.create_map(*[F.lit(x) for pair in dims.EMPLOYMENT_TYPES.items() for x in pair])
    values = F.coalesce(F.try_variant_get("node", "$.employmentType", "array<string>"), F.array(text_at("$.employmentType")))
    known = F.filter(F.transform(values, lambda v: table[F.translate(F.upper(v), "- ", "__")]), lambda c: c.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit("unknown"))


def day_rate() -> tuple[Column, Column]:
    """Bounds of a daily salary between 100 and 5000; the lower one stands for a missing upper one."""
    daily = F.upper(F.coalesce(text_at("$.baseSalary.value.unitText"), F.lit(""))).isin("DAY", "DAILY")

    def number(name: str) -> Column:
        n = F.expr(f"try_cast(try_cast(try_variant_get(node, '$.baseSalary.value.{name}', 'string') as double) as int)")
        return F.when(daily & n.between(100, 5000), n)

    low = F.coalesce(number("minValue"), number("value"))
    return low, F.coalesce(number("maxValue"), low)


def offers_from(nodes: DataFrame, source: str, *extra: str, url_col: str | None = None) -> DataFrame:
    low, high = day_rate()
    description = F.coalesce(text_at("$.description"), F.lit(""))
    rows = nodes.select(
        *extra,
        F.lit(source).alias("source"),
        F.substring(F.coalesce(F.nullif(text_at("$.identifier"), F.lit("")), text_at("$['@id']"), F.lit("")), 1, 120).alias("source_id"),
        F.coalesce(F.nullif(text_at("$.url"), F.lit("")), F.col(url_col) if url_col else F.lit("")).alias("url"),
        clean_text(named("$.title")).alias("title"),
        clean_text(named("$.hiringOrganization")).alias("company"),
        strip_html(description).alias("description"),
        description.alias("raw_html"),
        clean_text(location()).alias("location"),
        employment().alias("contract"),
        low.alias("daily_rate_min"),
        high.alias("daily_rate_max"),
        parse_datetime(text_at("$.datePosted")).alias("published_at"),
    )
    return canonical(rows, *extra)

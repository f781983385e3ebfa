"""Landed files: those that can't be read, sitemaps read in splits, snapshots of different schemas, chosen pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.operators.store import with_defaults
from offerlake.sources.pages import MISSION_URL, slug_prefilter

FILE = "file"


def read_files(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all Parquet files that can be read, each with its `file`. One that can't loses its own rows alone."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path).withColumn(FILE, F.col("_metadata.file_path"))


def quarantined(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """file, length and modified of the files in a folder that gave no row: those that can't be read, and empty ones. Only
    the folder's listing and one column of the others are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias(FILE), "length", F.col("modificationTime").alias("modified"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the two readers write local paths differently
    good = read_files(spark, path, schema).select(plain(F.col(FILE)).alias("good")).distinct()
    return listed.join(good, plain(F.col(FILE)) == F.col("good"), "left_anti")


ENTRY_END = "</url>"
ENTRY = "loc string, lastmod string, __corrupt string"


def sitemap_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each `url` element of the sitemaps in a folder: entry (its text), loc, lastmod, and corrupt (the text of
    an element that isn't XML, else null). Files are cut at the ends of elements, so a single large one is read by many
    tasks."""
    pieces = spark.read.option("lineSep", ENTRY_END).text(path).select(F.regexp_extract("value", r"(?s)<url(?:\s[^>]*)?>(?!.*<url[\s>]).*$", 0).alias("entry")).where("entry <> ''")
    entry = F.concat("entry", F.lit(ENTRY_END))
    parsed = pieces.select("entry", F.from_xml(entry, ENTRY, {"columnNameOfCorruptRecord": "__corrupt", "mode": "PERMISSIVE"}).alias("x"))
    return parsed.select("entry", F.trim("x.loc").alias("loc"), F.coalesce(F.trim("x.lastmod"), F.lit("")).alias("lastmod"), F.col("x.__corrupt").alias("corrupt"))


def sitemap_files(spark: SparkSession, path: str, wanted: str = MISSION_URL) -> DataFrame:
    """url and lastmod of the entries of a folder's sitemaps whose URL has the wanted shape; broken ones yield nothing."""
    rows = sitemap_rows(spark, path).where("corrupt is null and loc is not null")
    return rows.select(F.col("loc").alias("url"), "lastmod").where(F.col("url").rlike(wanted))


def chosen_pages(entries: DataFrame, pages: DataFrame, keywords: Sequence[str], most: int, newest: str = "lastmod") -> DataFrame:
    """The pages of the store that a sitemap's entries choose: those with a keyword in the URL, the newest `most`. The
    choice has a known bound, so Spark sends it to the pages by its own size check; beyond that it filters the pages by a
    Bloom filter of the choice before they are shuffled. Either way the HTML of other pages stays where it is."""
    chosen = slug_prefilter(entries.select("url", newest), keywords, most, newest).select("url").distinct()
    return pages.join(chosen, "url", "left_semi")


# Whole numbers, narrow ones first.
WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of both, as far as the Parquet reader can widen: whole numbers, float to double, whole
    numbers up to int to double. Other pairs of different types are an error."""
    if a == b:
        return a
    if a in WHOLE and b in WHOLE:
        return WHOLE[max(WHOLE.index(a), WHOLE.index(b))]
    if all(x in (*WHOLE[:3], T.FloatType(), T.DoubleType()) for x in (a, b)):
        return T.DoubleType()
    raise ValueError(f"{a.simpleString()} and {b.simpleString()} have no common type")


def merged_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """All columns of the versions in the order of their first mention, with their widest types, nullable."""
    kinds: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema:
            kinds[field.name] = wider(kinds[field.name], field.dataType) if field.name in kinds else field.dataType
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def read_versions(spark: SparkSession, paths: Sequence[str], defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Snapshots of different versions as one table: columns that a version lacks are null, or their default; whole numbers
    are read as the widest type that a version has. One scan; of each version only a schema goes through the driver."""
    schema = merged_schema([spark.read.parquet(p).schema for p in paths])
    return with_defaults(spark.read.schema(schema).parquet(*paths), defaults)



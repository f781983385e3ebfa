"""Tables between steps and sinks: everything is written where all executors can read it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session of one machine (tests) may go without and gets one of its
    own; on a cluster that would be a folder nobody else can read, so it is an error there."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def place_for(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of their own, read again. It stays until that folder is cleared."""
    path = place_for(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


CURRENT = "_current"


def put_version(rows: DataFrame, root: str, keep: int = 2) -> str:
    """Writes a new version of a table beside those in `root` and switches to it by one small file, written last: readers
    see the old version or the new one, and a job that is ended halfway or run again changes nothing for them. Versions
    before the last `keep` go."""
    spark = rows.sparkSession
    version = f"{versions(spark, root)[-1] + 1 if versions(spark, root) else 1:012d}"
    rows.write.mode("overwrite").parquet(f"{root}/v={version}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").text(f"{root}/{CURRENT}")
    for old in versions(spark, root)[:-keep]:
        removed(spark, f"{root}/v={old:012d}")
    return f"{root}/v={version}"


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that were switched to, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{CURRENT}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return sorted(int(r[0]) for r in spark.read.text(f"{root}/{CURRENT}").distinct().collect())  # one row a run


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The table as of the last switch, null before the first."""
    known = versions(spark, root)
    return spark.read.parquet(f"{root}/v={known[-1]:012d}") if known else None


CSV = {"header": True, "sep": ";", "escape": '"'}


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header and semicolons, quotes where needed; lists are joined by commas, times in ISO form."""
    out = [F.array_join(c, ", ").alias(c) if kind.startswith("array") else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) if kind == "timestamp" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*out).write.mode("overwrite").options(**CSV).csv(path)


JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def json_line(columns: list[str]) -> Column:
    """All columns, null ones too, times to the microsecond."""
    return F.to_json(F.struct(*columns), JSON)


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line."""
    rows.select(json_line(rows.columns).alias("value")).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


BUCKET, UNDATED = "bucket", "undated"


def bucket_of(id_: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def put_partitions(rows: DataFrame, root: str, by: str) -> None:
    """Writes rows by the values of a column: partitions that they touch are replaced, all others stay as they are."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(root)


def land(offers: DataFrame, root: str, landing: str) -> None:
    """Lands offers in a folder for each day (UTC) of publication, undated ones in one of their own, and there in one for
    this landing. A landing that is run again under its name replaces its own days; all else stays."""
    day = F.coalesce(F.date_from_unix_date(F.floor(F.unix_seconds("published_at") / 86_400).cast("int")).cast("string"), F.lit(UNDATED))
    dealt = offers.withColumn("day", day).withColumn("landing", F.lit(landing)).repartitionByRange("day", F.xxhash64("title", "url"))  # few files a day, a large day in several
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "landing").parquet(root)


def landed_since(spark: SparkSession, root: str, cutoffs: DataFrame | None = None) -> DataFrame:
    """Landed offers from the day of a cutoff on, and undated ones. `cutoffs`: one row with a timestamp, as a run log
    gives it (null: all offers); Spark reads it first and then lists only the folders of those days."""
    landed = spark.read.parquet(root).withColumn("day", F.col("day").cast("string"))
    if cutoffs is None:
        return landed
    return spark.sql(
        f"SELECT * FROM {{landed}} WHERE day = '{UNDATED}' OR day >= (SELECT coalesce(max(CAST(date_from_unix_date(CAST(floor(unix_seconds(cutoff) / 86400) AS INT)) AS STRING)), '') FROM {{cutoffs}})",
        landed=landed, cutoffs=cutoffs.toDF("cutoff"),
    )


def append_run(runs: DataFrame, path: str, run_id: str) -> None:
    """Adds a run's rows to a log; a run that is repeated under its id replaces itself."""
    runs.write.mode("overwrite").parquet(f"{path}/run={run_id}")

"""Landed files: truncated ones, sitemaps cut anywhere, versions of a table."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.sources import landing


def test_a_truncated_file_loses_its_own_rows_and_is_listed(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(40).repartition(4).write.parquet(path)
    files = sorted(glob.glob(f"{tmp_path}/in/part-*.parquet"))
    rows = landing.read_files(spark, path, "id long")
    own = {os.path.basename(r["file"]): r["count"] for r in rows.groupBy("file").count().collect()}
    assert sum(own.values()) == 40 and landing.quarantined(spark, path, "id long").count() == 0
    for crc in glob.glob(f"{tmp_path}/in/.*.crc"):
        os.remove(crc)
    with open(files[1], "r+b") as f:
        f.truncate(os.path.getsize(files[1]) // 2)
    assert landing.read_files(spark, path, "id long").count() == 40 - own[os.path.basename(files[1])]
    lost = landing.quarantined(spark, path, "id long").collect()
    assert [os.path.basename(r["file"]) for r in lost] == [os.path.basename(files[1])] and lost[0]["length"] == os.path.getsize(files[1])


def test_a_sitemap_is_cut_anywhere(spark, tmp_path):
    os.mkdir(f"{tmp_path}/maps")
    entries = [f"<url>\n <loc>https://m.example.com/fr/missions-x/{k}/data-job?a=1&amp;b=é{k}</loc>" + ("<lastmod>2024-01-05T00:00:00Z</lastmod>" if k % 2 else "") + "</url>" for k in range(4000)]
    entries[10] = "<url><loc>https://m.example.com/fr/missions-x/10/data-job"  # never closed: goes, and the next one stays
    entries[20] = "<url><loc>https://m.example.com/fr/missions-x/20/data-job<loc></url>"
    entries[30] = "<url></url>"
    with open(f"{tmp_path}/maps/all.xml", "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n' + "\n".join(entries) + "\n</urlset>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = landing.sitemap_rows(spark, f"file://{tmp_path}/maps")
        assert rows.rdd.getNumPartitions() > 8
        got = rows.collect()
        urls = [r["url"] for r in landing.sitemap_files(spark, f"file://{tmp_path}/maps", "/missions-").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    good = [k for k in range(4000) if k not in (10, 20, 30)]
    assert sorted(urls) == sorted(f"https://m.example.com/fr/missions-x/{k}/data-job?a=1&b=é{k}" for k in good)
    assert [r["entry"][:60] for r in got if r["corrupt"]] == [entries[20][:60]] and sum(r["lastmod"] != "" for r in got) == 2000


def test_versions_meet_in_their_widest_types(spark, tmp_path):
    paths = [f"file://{tmp_path}/v{k}" for k in range(3)]
    spark.createDataFrame([(1, 2, "a")], "id int, n short, notes string").write.parquet(paths[0])
    spark.createDataFrame([(2**40, 3.5)], "id long, n double").write.parquet(paths[1])
    spark.createDataFrame([(None, True)], "id int, starred boolean").write.parquet(paths[2])
    got = landing.read_versions(spark, paths, {"starred": ("boolean", False), "notes": ("string", "-")})
    assert got.dtypes == [("id", "bigint"), ("n", "double"), ("notes", "string"), ("starred", "boolean")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2.0, "a", False), (2**40, 3.5, "-", False), (None, None, "-", True)], key=str)
    with pytest.raises(ValueError, match="no common type"):
        landing.wider(T.LongType(), T.DoubleType())


def test_chosen_pages_leave_other_html_where_it_is(spark, tmp_path):
    spark.range(200).select(F.concat(F.lit("https://x/"), "id", F.lit("/"), F.when(F.col("id") % 50 == 0, "data-job").otherwise("other")).alias("url"), F.repeat(F.lit("h"), 100).alias("html")).write.parquet(f"file://{tmp_path}/pages")
    store = spark.read.parquet(f"file://{tmp_path}/pages")
    got = landing.chosen_pages(store.select("url", F.lit("2024").alias("lastmod")), store, ["data"], 3)
    assert got.count() == 3 and "SortMergeJoin" not in got._jdf.queryExecution().toString()


def test_a_key_s_repeats_go_within_the_margin_only(spark, tmp_path):
    from datetime import datetime

    from offerlake.streaming import stream

    day = lambda k: datetime(2024, 1, k)
    landings = [
        [(3, "A", day(5)), (2, "A", day(5)), (4, "B", None)],  # the first by seq of a batch; an undated one lands on day 5
        [(5, "A", day(6)), (6, "C", day(10))],  # within the margin
        [(7, "A", day(10)), (8, "D", day(7))],  # A's state has ended; D is older than day 10 less two
        [(9, "A", day(11)), (1, "C", day(11))],
        [(10, "E", day(30))],
        [(11, "A", day(30)), (12, "B", day(29))],
    ]
    for k, rows in enumerate(landings):
        spark.createDataFrame([(s, t, "", at) for s, t, at in rows], "seq long, title string, company string, published_at timestamp").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        flow = spark.readStream.schema("seq long, title string, company string, published_at timestamp").parquet(f"file://{tmp_path}/in").withColumn("landed_at", F.lit(day(5)))
        query = stream.merge_stream(stream.without_late_repeats(flow, "landed_at"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        query.awaitTermination()
    got = sorted(r["seq"] for r in spark.read.schema("seq long, cross_key string").parquet(f"file://{tmp_path}/out").collect())
    assert got == [2, 4, 6, 7, 10, 11, 12]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3  # A, B and E: what ended is gone

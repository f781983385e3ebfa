"""Sinks: versions, exports, the run log, and a stream that merges into the store."""

import csv
import glob
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerlake import storage
from offerlake.config import AS_OF, CONFIG, PROFILE, Profile
from offerlake.operators import match, score, store
from offerlake.plans import run
from offerlake.schema import canonical
from offerlake.streaming import stream


def test_versions_switch_and_old_ones_go(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert storage.current(spark, root) is None
    for k in range(4):
        storage.put_version(spark.range(k + 1), root)
    assert storage.current(spark, root).count() == 4 and len(glob.glob(f"{tmp_path}/store/v=*")) == 2
    spark.range(9).write.parquet(f"{root}/v={5:012d}")  # a job that ended before the switch
    assert storage.current(spark, root).count() == 4
    storage.put_version(spark.range(6), root)
    assert storage.current(spark, root).count() == 6


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x, "y"\nz', ["p", "q"], datetime(2024, 1, 5)), ("b", None, None, None)], "id string, title string, skills array<string>, at timestamp")
    for _ in range(2):  # again: the same files
        storage.export_csv(rows.coalesce(1), f"file://{tmp_path}/csv")
        storage.export_json(rows.coalesce(1), f"file://{tmp_path}/json")
        storage.append_run(spark.range(1), f"file://{tmp_path}/runs", "r1")
    storage.append_run(spark.range(2), f"file://{tmp_path}/runs", "r2")
    with open(glob.glob(f"{tmp_path}/csv/part-*")[0], newline="") as f:
        got = list(csv.DictReader(f, delimiter=";"))
    assert got[0] == {"id": "a", "title": 'x, "y"\nz', "skills": "p, q", "at": "2024-01-05T00:00:00"} and got[1]["title"] == ""
    with open(glob.glob(f"{tmp_path}/json/part-*")[0]) as f:
        assert [json.loads(line)["id"] for line in f] == ["a", "b"]
    assert spark.read.parquet(f"file://{tmp_path}/runs").count() == 3


def test_json_keeps_every_field(spark, tmp_path):
    from offerlake.plans import queries

    rows = spark.createDataFrame([("a", None, datetime(2024, 1, 5, 1, 2, 3, 450))], "id string, title string, at timestamp")
    storage.export_json(rows, f"file://{tmp_path}/json")
    assert json.loads(spark.read.text(f"file://{tmp_path}/json").first()[0]) == {"id": "a", "title": None, "at": "2024-01-05T01:02:03.000450Z"}
    got = queries.QUERIES["export_json_rows"](spark, "/root/testdata/sf0.001")
    want = queries.stored(spark, "/root/testdata/sf0.001").drop("seq", "score_raw").columns
    assert all(set(json.loads(r["line"])) == set(want) and json.loads(r["line"])["id"] == r["id"] for r in got.collect())


def test_stream_merges_into_the_store(spark, tmp_path):
    root, landed = f"file://{tmp_path}/store", f"file://{tmp_path}/landed"
    flow = lambda: stream.merge_into_store(spark.readStream.schema("id string, title string").parquet(landed), root, f"file://{tmp_path}/state", F.lit(AS_OF)).awaitTermination()
    spark.createDataFrame([("a", "A"), ("b", "B")], "id string, title string").write.parquet(landed)
    flow()
    marked = storage.current(spark, root).withColumn("status", F.when(F.col("id") == "a", "sent").otherwise(F.col("status")))
    storage.put_version(storage.written(marked, "marked"), root)
    spark.createDataFrame([("a", "A2"), ("c", "C")], "id string, title string").write.mode("append").parquet(landed)
    flow()
    flow()
    got = sorted((r["id"], r["title"], r["status"], r["first_seen_at"]) for r in storage.current(spark, root).collect())
    assert got == [("a", "A2", "sent", AS_OF), ("b", "B", "new", AS_OF), ("c", "C", "new", AS_OF)]


def test_ranks_count_every_row_once(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("score"))
    got = score.ranked(rows, F.desc("score"), F.asc("id")).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 501)) and [(r["score"], r["id"]) for r in got] == sorted(((k % 7, k) for k in range(500)), key=lambda x: (-x[0], x[1]))
    assert score.ranked(rows.where("false"), F.asc("id")).count() == 0


def test_without_an_inventory_only_fixed_sections(spark):
    own = Profile(skills={}, fixed=[("Langues", ["Anglais"])], transversal=["Rigueur"])
    offer = spark.createDataFrame([("a", "Data", "rigueur", [])], "id string, title string, description string, skills array<string>").withColumn("score_detail", F.struct(F.array().cast("array<string>").alias("matched_skills")))
    got = match.with_relevance(offer, own).select(match.compose_rubrics(F.col("rel"), own).alias("x")).first()["x"]
    assert [(x["label"], x["competences"]) for x in got] == [("Langues", ["Anglais"])]


def test_a_merge_writes_only_the_buckets_it_touches(spark, tmp_path):
    root, files = f"file://{tmp_path}/store", lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{tmp_path}/store/bucket=*/*.parquet")}
    rows = spark.range(1000).select(F.concat(F.lit("o"), "id").alias("id"), F.lit("old").alias("title"))
    assert store.merge_offers(rows, root, F.lit(AS_OF), 64).groupBy("change").count().collect() == [("new", 1000)]
    before = files()
    few = spark.createDataFrame([(f"o{k}", "new") for k in range(9)] + [("fresh", "new")], "id string, title string")
    buckets = {r[0] for r in few.select(storage.bucket_of("id", 64)).collect()}
    for _ in range(2):  # again: nothing new
        changes = dict(store.merge_offers(few, root, F.lit(datetime(2024, 3, 1)), 64).groupBy("change").count().collect())
    assert changes == {"updated": 10} and len(buckets) <= 10
    same = {p for p, at in before.items() if files().get(p) == at}
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in same} == set(range(64)) - buckets
    got = spark.read.parquet(root)
    assert got.count() == 1001 and got.where("title = 'new'").count() == 10 and got.where(F.col("first_seen_at") == F.lit(AS_OF)).count() == 1000


def test_only_days_from_the_cutoff_on_are_listed(spark, tmp_path):
    root = f"file://{tmp_path}/landed"
    rows = spark.range(40).select(F.col("id").cast("string").alias("title"), F.lit("u").alias("url"), F.when(F.col("id") % 10 > 0, F.expr("timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, CAST(id AS INT))")).alias("published_at"))
    for landing in ("a", "b", "b"):
        storage.land(rows.where("id % 2 = 0" if landing == "a" else "id % 2 = 1"), root, landing)
    cutoffs = spark.createDataFrame([(datetime(2024, 2, 3, 12),)], "cutoff timestamp")
    got = storage.landed_since(spark, root, cutoffs)
    assert sorted(int(r["title"]) for r in got.collect()) == [0, 10, 20, 30, *[k for k in range(33, 40)]]
    assert "PartitionFilters: [(" in got._jdf.queryExecution().toString() and storage.landed_since(spark, root, cutoffs.where("false")).count() == storage.landed_since(spark, root).count() == 40


def test_a_run_that_is_repeated_leaves_one_record_and_the_same_store(spark, tmp_path, monkeypatch):
    landed, root, log = (f"file://{tmp_path}/{x}" for x in ("landed", "store", "runs"))
    offers = lambda ids, title="Data Engineer": canonical(spark.createDataFrame([(k, f"{title} {k}", "freelance Paris", "Paris, France", datetime(2024, 1, 20), f"c{k}") for k in ids], "seq long, title string, description string, location string, published_at timestamp, company string").withColumn("source", F.lit("s")), "seq")
    go = lambda name, at: run.run_campaign(spark, landed, root, log, name, CONFIG, PROFILE, at, buckets=4).first()
    storage.land(offers(range(5)), landed, "one")
    assert (go("a", datetime(2024, 1, 21))["new_offers"], go("a", datetime(2024, 1, 21))["new_offers"]) == (5, 5)
    storage.land(offers(range(5, 8)), landed, "two")
    put = storage.append_run
    monkeypatch.setattr(storage, "append_run", lambda *_: (_ for _ in ()).throw(RuntimeError("ended")))
    with pytest.raises(RuntimeError, match="ended"):
        go("b", datetime(2024, 1, 22))  # the store is merged, the log isn't written
    monkeypatch.setattr(storage, "append_run", put)
    again = go("b", datetime(2024, 1, 22))
    assert (again["fetched"], again["kept"], again["new_offers"], again["updated_offers"]) == (8, 8, 3, 5)
    assert run.run_log(spark, log).count() == 2 and spark.read.parquet(root).groupBy("first_run").count().orderBy("first_run").collect() == [("a", 5), ("b", 3)]
    assert go("c", datetime(2024, 2, 20))["fetched"] == 8  # nothing runs between: the cutoff is the last run's
    late = go("d", datetime(2024, 2, 21))
    assert late["fetched"] == 0 and late["sources"] == "" and spark.read.parquet(root).count() == 8

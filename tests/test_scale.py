"""What keeps the work on large tables even and small: how rows are dealt out, and steps against their plain forms."""

from pyspark.sql import functions as F

from offerlake.fixture import spread


def test_rows_of_one_split_are_dealt_out(spark):
    one_row_group = spark.range(0, 1000, 1, 1).unionByName(spark.range(0, 0, 1, 7))  # eight splits, one has all rows
    sizes = [n for _, n in spread(one_row_group).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 300
    assert spread(spark.range(0, 600_000, 1, 1)).rdd.getNumPartitions() == 12  # by rows, not by cores


def test_relevance_is_compiled_and_rubrics_follow_plain_loops(spark):
    from offerlake.config import PROFILE
    from offerlake.operators import match

    shape = "id long, title string, description string, skills array<string>, score_detail struct<matched_skills:array<string>>"
    texts = ["Data Engineer Python SQL dbt", "Power BI, DAX et Excel : Power BI partout", "", "Gouvernance des données, qualité, AWS Docker"]
    rows = spark.createDataFrame([(k, t, t * 2, ["Python"] if k == 0 else None, None) for k, t in enumerate(texts)], shape)
    rel = match.with_relevance(rows, PROFILE)
    assert ".letters" not in rel._jdf.queryExecution().optimizedPlan().toString()  # no lambda over a literal list of needles
    for own, got in rel.select("rel", match.select_rubrics(F.col("rel"))).collect():
        order = sorted(own, key=lambda x: (-x.score, x.cat_ord, x.rank))
        asked = {x.category for x in own if x.score > 0}
        order.sort(key=lambda x: 1 if x.score > 0 else 2 if x.category in asked else 3)
        kept = [x for k, x in enumerate(order) if sum(y.category == x.category for y in order[:k]) < match.PER_CATEGORY]
        assert [x.competence for x in got] == [x.competence for x in kept[: match.ALL]]


def test_ranked_rows_are_worked_out_once(spark):
    """A range sort reads its input twice, for the bounds and for the rows."""
    from offerlake.operators import score

    seen = spark.sparkContext.accumulator(0)

    def counted(k):
        seen.add(1)
        return -k

    rows = spark.range(0, 100, 1, 3).withColumn("v", F.udf(counted, "long")("id"))
    got = score.ranked(rows, F.asc("v")).orderBy("pos").collect()
    assert [r["id"] for r in got] == list(range(99, -1, -1)) and [r["pos"] for r in got] == list(range(1, 101))
    assert seen.value == 100


def test_both_sides_of_a_store_come_from_one_table(spark):
    from offerlake.plans import queries

    for query in (queries.upserted, queries.with_applications):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan, query.__name__  # the offers aren't derived again for each side


def test_equal_texts_are_matched_once(spark):
    """Numbers that no needle tells apart don't make texts different; the rows are those of each offer matched by itself."""
    from offerlake.config import PROFILE
    from offerlake.operators import match, score

    texts = ["Mission SQL, TJM : 450 €", "Mission SQL, TJM : 999 €", "Mission SQL, TJM : 1999 €", "AWS S3 et K8s", "AWS S4 et K9s", "aws ś3, k8s 8", "aws ś3, k8s 7", "3S 3", "SAP BI4\n2", "SAP BI4\n5", "", None]
    offers = spark.createDataFrame([(str(k), "Data Engineer 3", t, [] if k else ["sql 1"]) for k, t in enumerate(texts)] + [("x", None, "Power BI", None)], "id string, title string, description string, skills array<string>")
    ids, classes = match.text_classes(offers, match.all_needles(PROFILE))
    assert ids.count() == 13 and classes.count() == ids.select("cls").distinct().count() == 10  # tags of the first text keep it apart from the second
    own = score.with_asked_skills(offers.na.fill("").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>"))), PROFILE)
    want = match.with_relevance(own, PROFILE).select("id", "rel", "soft", "skills").collect()
    seen = spark.sparkContext.accumulator(0)

    def made(rows):
        count = F.udf(lambda x: seen.add(1) or x, "string")
        return match.with_relevance(rows.withColumn("title", count("title")), PROFILE).select("cls", "rel", "soft", "skills")

    assert sorted(match.once_a_text(offers, PROFILE, made).collect()) == sorted(want)
    assert seen.value == 10
    text = spark.createDataFrame([("web 2.0 450",)], "t string")
    assert [text.select(match.without_numbers(F.col("t"), n)).first()[0] for n in (["s3"], ["web 2.0"])] == ["web 0.0 000", "web 2.0 450"]


def test_offers_are_read_once_for_both_sides_of_the_texts(spark):
    """The texts and the offers that they are joined to come from one pass over the offers."""
    from offerlake.config import PROFILE
    from offerlake.operators import match

    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or x, "string")
    rows = spark.createDataFrame([(str(k), "Data Engineer", f"SQL, TJM : {400 + k} €", None) for k in range(40)], "id string, title string, description string, skills array<string>")
    got = match.once_a_text(rows.withColumn("title", counted("title")), PROFILE, lambda texts: texts.select("cls", "skills"))
    assert sorted(got.collect()) == [(k, ["SQL"]) for k in sorted(map(str, range(40)))]
    assert seen.value == 40


def test_ids_of_a_batch_are_one_array():
    from offerlake.llm.bpe import byte_bpe_path, codec, lists

    own = codec(byte_bpe_path())
    ids = own.encode_batch(["aaaaaaaa banana", "", "ß 中文 aaaa"])
    assert lists(ids).to_pylist() == ids and lists([]).to_pylist() == []
    assert own.merged(["aaaaaaaa", "", "banana"])[0] == own.merged(["aaaaaaaa"])[0]


def test_scores_read_each_text_once(spark, monkeypatch):
    """Rows and scores are those of facts and score_offers, and the store that is merged twice derives its offers once."""
    from offerlake.config import AS_OF, CONFIG, PROFILE
    from offerlake.operators import score
    from offerlake.plans import campaign, queries
    from offerlake.schema import canonical

    texts = ["TJM : 450 €. SQL", "TJM entre 400 et 500 euros", "300 - 400 € par jour, full remote", "tarif journalier 700, tjm 90", "<p>Python &amp; dbt</p> 6 mois", "3 jours sur site, 550 €/j", "Salaire 45000 euros par an", "", None]
    rows = [(k, t, x, "CDI x" if k % 5 == 0 else " Data ", "s" if k % 2 else None, 500 if k == 3 else None, ["dbt"] if k == 4 else None) for k, (t, x) in enumerate((t, x) for t in texts for x in ("Paris", "Paris", "jours 450 €"))]
    offers = canonical(spark.createDataFrame(rows, "seq long, description string, location string, title string, company string, daily_rate_max int, skills array<string>"), "seq")
    want = score.score_offers(campaign.facts(offers), PROFILE, CONFIG, AS_OF).select("seq", "title", "score_raw", "score").collect()
    read, once = spark.sparkContext.accumulator(0), campaign.normalize_offers
    monkeypatch.setattr(campaign, "normalize_offers", lambda o, *a: once(o.withColumn("location", F.udf(lambda x: read.add(1) or x, "string")("location")), *a))
    got = campaign.scores(offers, PROFILE, CONFIG, AS_OF, "seq").select("seq", "title", "score_raw", "score").collect()
    assert sorted(got) == sorted(want) and len(got) == 27
    assert read.value == offers.select(*campaign.SAID).distinct().count() < 27

    monkeypatch.setattr(campaign, "normalize_offers", once)
    seen, derived = spark.sparkContext.accumulator(0), queries.offers
    monkeypatch.setattr(queries, "offers", lambda s, d: derived(s, d).withColumn("source", F.udf(lambda x: seen.add(1) or x, "string")("source")))
    n = queries.QUERIES["merge_offers"](spark, "/root/testdata/sf0.001").count()
    assert seen.value == n == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_shallow_pages_are_walked_in_one_pass(spark, tmp_path, monkeypatch):
    """Objects to any depth are those of a plain walk; only what lies deep is written level by level."""
    import json

    from offerlake.sources import jsonld

    def walk(node, path=""):
        inside = [node[k] for k in sorted(node)] if isinstance(node, dict) else node if isinstance(node, list) else []
        return ([(path, len(path) // 11)] if isinstance(node, dict) else []) + [x for i, v in enumerate(inside) for x in walk(v, f"{path}/{i:010d}")]

    def nested(n):
        node = {"@type": "JobPosting", "title": "deep"}
        for k in range(n):
            node = [node, k] if k % 3 == 2 else {"b": node, "a": None, "c": [{"x": []}, "s", 1.5, True, [[]]]}
        return node

    for name, docs in {"shallow": [nested(5), {}, [], [{"@type": "jobposting"}], "text"], "deep": [nested(9), nested(30), nested(8)]}.items():
        pages = spark.createDataFrame([(k, f'<script type="application/ld+json">{json.dumps(x)}</script><script type="application/ld+json">{{oops</script>') for k, x in enumerate(docs)], "page int, html string")
        place = iter(range(2))
        monkeypatch.setattr(jsonld, "place_for", lambda *_, name=name, place=place: f"file://{tmp_path}/{name}{next(place)}")
        got = jsonld.ld_walk(jsonld.ld_blocks(pages)).select("page", "path", "level").collect()
        assert sorted(map(tuple, got)) == sorted((k, *x) for k, doc in enumerate(docs) for x in walk(doc))
        wanted = jsonld.ld_walk(jsonld.ld_blocks(pages), jsonld.is_posting())
        assert wanted.where(~jsonld.is_posting()).count() == 0 and wanted.count() == (2 if name == "shallow" else 3)
    assert [x.name for x in tmp_path.joinpath("shallow0").iterdir()] == ["8"] and len(list(tmp_path.joinpath("deep0").iterdir())) > 20

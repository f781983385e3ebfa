"""Decisions against a greedy loop, scores on cases, the store's rules, payloads."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from offerlake.config import AS_OF, CONFIG, PROFILE
from offerlake.operators import filters, match, score, store
from offerlake.schema import OFFER, canonical
from offerlake.sources import feeds, jsonld, pages


def test_only_a_kept_offer_claims_its_key(spark):
    rng = random.Random(4)
    rows = [(k, f"key{rng.randrange(6)}", rng.choice([None, "too_old"])) for k in range(200)]
    df = spark.createDataFrame(rows, "seq int, cross_key string, reject_reason string")
    got = {r["seq"]: r["decision"] for r in filters.decided(df, "seq").collect()}
    seen, want = set(), {}
    for k, key, reason in rows:
        want[k] = "duplicate" if key in seen else "rejected" if reason else "kept"
        if want[k] == "kept":
            seen.add(key)
    assert got == want


def offer(**fields):
    base = dict(source="s", title="Data", company="c", description="", remote="unknown", contract="freelance", skills=[])
    return base | fields


def frame(spark, rows):
    return canonical(spark.createDataFrame(rows, OFFER))


def test_scores(spark):
    rows = [offer(skills=["Python"], daily_rate_max=700, remote="hybrid", published_at=AS_OF, duration_months=6.0), offer(daily_rate_max=700), offer(), offer(skills=["Java"], remote="onsite")]
    got = score.score_offers(frame(spark, rows), PROFILE, CONFIG, AS_OF).collect()
    assert [r["score"] for r in got] == [98.5, 50.0, 0.0, 7.5]
    assert got[1]["score_detail"]["ignored_signals"] == ["skills_match", "remote", "freshness", "duration"]
    assert got[3]["score_detail"]["missing_skills"] == ["Java"]


def test_upsert_keeps_annotations_and_is_idempotent(spark):
    schema = "id string, title string, status string, first_seen_at timestamp, notes string, starred boolean, discarded boolean"
    old = spark.createDataFrame([("a", "A", "sent", datetime(2024, 1, 1), "n", True, True), ("b", "B", "new", datetime(2024, 1, 1), None, None, None)], schema)
    new = spark.createDataFrame([("b", "B2"), ("c", "C")], "id string, title string")
    once = store.upsert_offers(old, new, F.lit(AS_OF))
    rows = {r["id"]: r for r in once.collect()}
    assert {k: r["change"] for k, r in rows.items()} == {"a": "unchanged", "b": "updated", "c": "new"}
    assert rows["a"]["status"] == "sent" and rows["b"]["title"] == "B2" and rows["b"]["notes"] == "" and rows["c"]["first_seen_at"] == AS_OF
    again = store.upsert_offers(once.drop("change"), new, F.lit(AS_OF))
    assert sorted(r["change"] for r in again.collect()) == ["unchanged", "updated", "updated"]


def test_feeds_isolate_bad_items(spark):
    landed = spark.createDataFrame([('{"position":"Data &amp; BI","tags":"[\'a\']"}',), ('{"legal":"notice"}',), ("{oops",), (None,)], "payload string")
    got = feeds.read_feed(landed, "remoteok").collect()
    assert [(r["title"], r["skills"], r["location"]) for r in got] == [("Data & BI", ["a"], "Remote")]
    assert feeds.corrupt_rows(landed.where("payload is not null"), "remoteok").count() == 1


def test_jsonld_tolerates_raw_line_ends_and_finds_nested_postings(spark):
    html = '<script type="application/ld+json">{"@graph":[{"@type":["Thing","JobPosting"],"title":"A\nB","url":"u"}]}</script><script type="application/ld+json">{bad</script>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>none</p>")], "page int, html string")
    got = jsonld.offers_from(jsonld.postings(jsonld.ld_walk(jsonld.ld_blocks(pages)), ["page"]), "s", "page").collect()
    assert [(r["page"], r["title"], r["url"]) for r in got] == [(1, "A B", "u")]


def test_jsonld_walks_to_any_depth(spark):
    at_level_7 = '[{"@graph":[{"mainEntity":{"itemListElement":[{"item":{"@type":"JobPosting","title":"A","url":"a"}}]}}]}]'
    at_level_40 = '{"x":[' * 20 + '{"@type":"JobPosting","title":"B","url":"b"}' + "]}" * 20
    pages = spark.createDataFrame([(k, f'<script type="application/ld+json">{x}</script>') for k, x in enumerate((at_level_7, at_level_40, "[]", "7"))], "page int, html string")
    nodes = jsonld.ld_walk(jsonld.ld_blocks(pages))
    assert sorted((r["page"], r["level"]) for r in nodes.where(jsonld.is_posting()).collect()) == [(0, 7), (1, 40)]
    got = jsonld.offers_from(jsonld.postings(nodes, ["page"]), "s", "page").collect()
    assert sorted((r["page"], r["title"]) for r in got) == [(0, "A"), (1, "B")]
    assert nodes.groupBy("page").count().orderBy("page").collect() == [(0, 5), (1, 21)]
    assert jsonld.ld_walk(jsonld.ld_blocks(pages.where("false"))).count() == 0


def test_the_first_posting_of_a_page_counts(spark):
    block = '<script type="application/ld+json">{}</script>'
    lists = [f'[{",".join(f"{{%s}}" % f""""@type":"JobPosting","title":"{t}","url":"{u}" """ for t, u in part)}]' for part in ([("B", "z"), ("A", "a")], [("C", "0")])]
    rows = [(1, "p1", "".join(block.format(x) for x in lists)), (2, "p2", "<h1>T</h1><main>body</main>"), (3, None, None)]
    got = pages.page_fallback(spark.createDataFrame(rows, "page int, url string, html string"), "s", "page").orderBy("page").collect()
    assert [(r["page"], r["title"], r["url"]) for r in got[:2]] == [(1, "B", "z"), (2, "T", "p2")] and len(got) == 2  # a page without a title has no offer


def test_caps_of_sources(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "a", "b", None]), rng.choice([None, *(f"n{i}" for i in range(300))])) for k in range(2000)]
    df = spark.createDataFrame(rows, "seq int, source string, native string")
    for caps in ({"a": 30, "gone": 500}, {}):
        seen, want = {}, set()
        for k, source, native in rows:
            mine = seen.setdefault(source, set())
            if native not in mine and len(mine) < caps.get(source, 1 << 30):
                mine.add(native)
                want.add(k)
        assert {r["seq"] for r in pages.cap_per_source(df, caps, "native", "seq").collect()} == want


def test_proposed_rate(spark):
    rows = [offer(), offer(daily_rate_max=700), offer(daily_rate_max=400), offer(daily_rate_min=600)]
    got = [r[0] for r in frame(spark, rows).select(match.proposed_rate(PROFILE)).collect()]
    assert got == [650, 700, 500, 600]


def test_entry_imports():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "campaign" in names and set(entry.oracle_sql()) <= set(names)

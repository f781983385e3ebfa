"""Pages of sources whose own rules matter: client names, first postings, pages without a title; dates; entities."""

import html
import random
from datetime import datetime
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from offerlake.functions import dates, text
from offerlake.schema import OFFER, canonical
from offerlake.sources import pages


def frame(spark, rows, extra=""):
    return spark.createDataFrame([dict(source="s", description="", remote="unknown", contract="unknown", skills=[], company="", url="u") | r for r in rows], OFFER + extra)


def test_publishers_are_no_clients_and_rates_come_from_the_description(spark):
    rows = [
        dict(title="A", company="Mindquest SAS", description="TJM : 450 €"), dict(title="TJM : 700 €", company="Banque", description="rien"), dict(title="", company="x"),
        dict(title="B", company="Client", daily_rate_min=500, daily_rate_max=None, description="TJM 300 - 400 €"), dict(title="C", company="Client", daily_rate_max=900, description="TJM 300 - 400 €"),
    ]
    got = {r["title"]: r for r in pages.mindquest(frame(spark, rows)).collect()}
    assert set(got) == {"A", "TJM : 700 €", "B", "C"} and got["A"]["company"] == "" and got["TJM : 700 €"]["company"] == "Banque"
    assert {k: (r["daily_rate_min"], r["daily_rate_max"]) for k, r in got.items()} == {"A": (450, 450), "TJM : 700 €": (None, None), "B": (500, None), "C": (300, 400)}
    assert {r["contract"] for r in got.values()} == {"freelance"}


def test_first_of_a_url_goes_by_arrival(spark):
    rows = [dict(title="", url="x", source_id="0"), dict(title="B", url="x", source_id="2", company="Freelance - Informatique"), dict(title="A", url="x", source_id="1"), dict(title="D", url="y", contract="cdi")]
    offers = frame(spark, rows).withColumn("arrived", F.when(F.col("title") == "B", 1).when(F.col("title") == "A", 2).otherwise(0))
    got = {r["url"]: r for r in pages.freelanceinfo(offers, "arrived").collect()}
    assert got["x"]["title"] == "B" and got["x"]["company"] == "" and got["x"]["contract"] == "freelance" and got["y"]["contract"] == "cdi"


POSTING = '<script type="application/ld+json">%s</script>'


def test_pages_with_and_without_postings(spark):
    two = POSTING % '[{"@type":"JobPosting","title":"First","hiringOrganization":"Own"},{"@type":"JobPosting","title":"Second"}]'
    rows = [
        (1, "u1", f"<html>{two}<h1>Other</h1><p>TJM 450 €</p></html>"), (2, "u2", '<h1>Un <b>titre</b></h1><div class="x company-box">Société <i>Z</i></div><main>Corps</main>'), (3, "u3", "<h2>none</h2>"), (4, "u4", ""), (5, "u5", None),
        (6, "u6", POSTING % '{"@type":"JobPosting","title":""}' + "<h1>heading</h1>"), (7, "u7", "<h1> </h1>"),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({"title": F.lit("clash"), "p": F.lit(1)})
    got = {r["page_id"]: r for r in pages.page_fallback(df, "s", "page_id").collect()}
    assert set(got) == {1, 2} and (got[1]["title"], got[1]["company"], got[1]["daily_rate_min"], got[1]["contract"]) == ("First", "Own", 450, "freelance")
    assert (got[2]["title"], got[2]["company"], got[2]["description"], got[2]["url"]) == ("Un titre", "Société Z", "Corps", "u2")
    posted = pages.posted_offers(df, "s", "page_id").collect()
    assert [(r["page_id"], r["title"], r["contract"], r["daily_rate_max"]) for r in posted] == [(1, "First", "unknown", 450)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_dates_mean_the_same_in_every_session(spark, zone):
    cases = {
        "2024-01-05": "2024-01-05T00:00:00", "2024-01-05T10:30:00": "2024-01-05T10:30:00", "2024-01-05 10:30:00.5": "2024-01-05T10:30:00.500000", "2024-01-05T10:30:00Z": "2024-01-05T10:30:00", "2024-01-05T10:30:00+02:00": "2024-01-05T08:30:00",
        "2024-03-10T02:30:00": "2024-03-10T02:30:00", "05/01/2024": "2024-05-01T00:00:00", "25/01/2024": "2024-01-25T00:00:00", "2024/01/25": "2024-01-25T00:00:00", "Fri, 5 Jan 2024 10:00:00 +0200": "2024-01-05T08:00:00",
        "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05T10:00:00", "5 Jan 2024": "2024-01-05T00:00:00", "": None, "soon": None, "31/31/2024": None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", F.unix_micros(dates.parse_datetime(F.col("x"))).alias("at"), dates.parse_date(F.col("x")).cast("string").alias("day"))
        got = {r["x"]: (r["at"], r["day"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    micros = lambda t: round((datetime.fromisoformat(t) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert got == {k: (None, None) if t is None else (micros(t), t[:10]) for k, t in cases.items()}


def test_entities_equal_the_standard_library(spark):
    rng = random.Random(1)
    cases = [f"&{n}" for n in html5] + [f"a &{n}x; b" for n in html5 if not n.endswith(";")] + [f"&#{k};" for k in [*range(0x100), 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1FFFE, 0x10FFFF, 0x110000, 0x1F600, 10**11]]
    cases += ["&amp;lt;", "&ampamp;", "&&&", "&notit;", "&unknown; x", "&#;", "&#x;", "AT&T", "&#X41 &#065", "&#x0000000000041;", None, "", "plain"]
    cases += ["".join(rng.choice(["&", "#", "x", "amp", "lt", "1", "2", ";", " ", "é", "copy", "notin", "😀"]) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string").withColumn("y", text.unescape(F.col("x")))
    for r in df.collect():
        assert r["y"] == (None if r["x"] is None else html.unescape(r["x"])), r["x"]


def test_tags_go_without_python(spark):
    plan = spark.range(1).select(text.strip_html(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "unescaped" not in plan


def test_canonical_offers_stay_canonical(spark):
    assert canonical(frame(spark, [dict(title="A")])).columns == [x.split()[0] for x in OFFER.replace("\n", " ").split(", ")]

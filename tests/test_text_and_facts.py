"""Text functions and facts on literal cases, in one job each."""

import pytest
from pyspark.sql import functions as F

from offerlake.functions import dates, extract, text


def values(spark, column, rows):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, x string")
    return [r[1] for r in df.select("k", column(F.col("x"))).orderBy("k").collect()]


def test_strip_html(spark):
    got = values(spark, text.strip_html, ["<p>Bonjour</p><p>Monde</p>", "<ul><li>a</li><li>b &amp; c</li></ul>", "<script>x()</script>t", None, "donnÃ©es"])
    assert got == ["Bonjour\nMonde", "- a\n- b & c", "t", "", "données"]


def test_mojibake_stays_where_it_is_none(spark):
    assert values(spark, text.fix_mojibake, ["données", "Ã©tÃ© €", None]) == ["données", "Ã©tÃ© €", None]


def test_folding_follows_the_unicode_tables(spark):
    words = ["Élève", "élève", "Tiếng Việt", "ﬁnance œuvre", "½ m²", "Ｄａｔａ", "Ĳssel", "à suivre…", "no break", "데이터 각", "𝐃ata ㎏", "straße", "", None]
    every = "".join(chr(i) for i in range(1, 0x31000) if not 0xD800 <= i <= 0xDFFF)
    parts = [every[k : k + 400] for k in range(0, len(every), 400)]
    want = [None if w is None else text.unmarked(w) for w in [*words, *parts]]
    assert want[:4] == ["Eleve", "eleve", "Tieng Viet", "finance œuvre"]
    assert values(spark, text.deaccent, [*words, *parts]) == want
    assert values(spark, text.normalize_key, ["  ÉTÉ ", None]) == ["ete", ""]


def test_short_needles_have_boundaries(spark):
    got = values(spark, lambda c: text.contains_any(text.normalize_key(c), ["bi", "data"]), ["Consultant BI", "ambition", "La DATA", "", None])
    assert got == ["bi", None, "data", None, None]


@pytest.mark.parametrize("part", ["rates"])
def test_daily_rates(spark, part):
    cases = {
        "TJM : 450 - 550 €": (450, 550),
        "TJM entre 600 et 500 euros": (500, 600),
        "550 € HT par jour": (550, 550),
        "600€/j": (600, 600),
        "TJM : 1 200 €": (1200, 1200),
        "TJM : 15000 €": (None, None),
        "Salaire 45000 euros par an": (None, None),
        "tarif journalier de 90 puis TJM 700": (700, 700),
        "": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r[0]: (r[1]["low"], r[1]["high"]) for r in df.select("x", extract.parse_daily_rate(F.col("x"))).collect()}
    assert got == cases


def test_contract_remote_duration(spark):
    key = lambda c: text.normalize_key(c)
    assert values(spark, lambda c: extract.parse_contract(key(c)), ["Stage en mission", "Mission freelance", "CDD interim", "CDI", "?", "alternance"]) == ["stage", "freelance", "cdd", "cdi", "unknown", "alternance"]
    assert values(spark, lambda c: extract.parse_remote(key(c), text.deaccent(c)), ["Full remote", "3 jours/semaine sur site", "présence sur site", "télétravail", ""]) == ["full_remote", "hybrid", "onsite", "hybrid", "unknown"]
    assert values(spark, lambda c: extract.parse_duration(text.deaccent(c)), ["6 mois", "5 ans d'expérience", "sur 2 ans", "8 semaines", "12+ months", None]) == [6.0, None, 24.0, 1.8, 12.0, None]


def test_signals_are_silent_for_a_permanent_title(spark):
    df = spark.createDataFrame([("Data CDI", "portage salarial"), ("Data", "550 € / jour"), ("Data", "statut d'indépendant"), ("Data", None)], "t string, d string")
    got = [tuple(r[0]) for r in df.select(extract.detect_signals(F.col("t"), F.col("d"))).collect()]
    assert got == [(False, None, None, None), (True, "TJM 550 EUR", 550, 550), (True, "statut d'indépendant", None, None), (False, None, None, None)]


def test_skill_quirks(spark):
    got = values(spark, lambda c: F.array_join(extract.extract_skills(text.normalize_key(c)), ","), ["R&D", "tableau de bord", "Python et CI/CD", "scalable", ""])
    assert got == ["R", "Tableau,Reporting", "Python,CI/CD", "", ""]


def test_dates(spark):
    got = values(spark, lambda c: F.date_format(dates.parse_datetime(c), "yyyy-MM-dd HH:mm"), ["2024-01-05", "2024-01-05T10:00:00Z", "Fri, 5 Jan 2024 10:00:00 +0000", "soon", "", None])
    assert got == ["2024-01-05 00:00", "2024-01-05 10:00", "2024-01-05 10:00", None, None, None]


def test_urls(spark):
    assert values(spark, text.clean_url, ["https://x.y/a?utm_source=1&b=2#f", "https://x.y/?REF=1", None, "https://x.y/a"]) == ["https://x.y/a?b=2#f", "https://x.y/", "", "https://x.y/a"]


def test_strip_html_makes_each_text_once(spark):
    """Decoding and repair name their text several times; the steps before them must not be copied for each."""
    from offerlake.functions.text import strip_html

    rows = spark.createDataFrame([("<p>a &amp;amp; b</p><br/>cafÃ©",), (None,)], "h string").select(strip_html(F.col("h")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["a &amp; b\n\ncafé", ""]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("<br") <= 2

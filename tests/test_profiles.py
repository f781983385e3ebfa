"""Needles in one pass and offers for many profiles, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from offerlake import dims
from offerlake.functions import extract, needles, text
from offerlake.operators import match, profiles

PIECES = ["python", "pl/sql", "sql", "c++", ".net", "power bi", "powerbi", "ci/cd", "r", "é", "中文", "_", "-", "/", " ", " ", ",", "x", "ß", "data", "bi", "\u0001", "a/b test", "s3"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(n)] + ["", " "]


def test_names_between_word_boundaries(spark):
    names = dims.SKILLS | {"C++": ["c++"], ".NET": [".net"]}
    bound = lambda w: (r"\b" if w[0].isalnum() else "") + re.escape(w) + (r"\b" if w[-1].isalnum() else "")
    cases = random_texts(400, 1)
    df = spark.createDataFrame([(x,) for x in cases], "k string").select("k", extract.named(F.col("k"), names).alias("found"))
    for r in df.collect():
        want = [name for name, words in names.items() if any(re.search(bound(text.folded(w)), r["k"]) for w in [name, *words])]
        assert r["found"] == want, r["k"]


def test_contains_any_equals_patterns(spark):
    cases, wanted = random_texts(400, 2), ["c++", "r", "bi", ".net", "sql", "power", "data", "s3"]
    for r in spark.createDataFrame([(x,) for x in cases], "k string").select("k", text.contains_any(F.col("k"), wanted).alias("hit")).collect():
        want = next((n for n in wanted if (re.search(rf"\b{re.escape(n)}\b", r["k"]) if len(n) <= 3 else n in r["k"])), None)
        assert r["hit"] == want, r["k"]


def test_counts_of_needles(spark):
    cases, words = random_texts(200, 3), ["sql", "r", "data", "c++", "power bi"]
    rows = text.table([text.needle(w, match.SHORT) for w in words])
    df = spark.createDataFrame([(x,) for x in cases], "k string").select("k", F.transform(rows, lambda n: needles.times(F.col("k"), text.marked(F.col("k")), n)).alias("n"))
    for r in df.collect():
        want = [len(re.findall(rf"\b{re.escape(w)}\b" if len(w) <= match.SHORT else re.escape(w), r["k"])) for w in words]
        assert r["n"] == want, r["k"]


def test_best_offers_by_skills(spark, monkeypatch):
    monkeypatch.setattr(profiles, "MEETINGS", 5)  # every key is split
    rng = random.Random(5)
    names = [f"S{k}" for k in range(8)]
    offers = [(f"o{k:03}", [rng.choice(names) for _ in range(rng.randrange(0, 4))]) for k in range(150)] + [("z", ["S0", "S0", "s0"]), ("z", ["S0"])]
    owners = [(k, [(rng.choice(names), rng.choice([1.0, 0.75, 0.45])) for _ in range(rng.randrange(0, 4))]) for k in range(40)] + [(99, [("s0", 0.45), ("S0", 1.0)])]
    got = profiles.best_by_skills(spark.createDataFrame(offers, "id string, skills array<string>"), spark.createDataFrame(owners, "profile int, skills array<struct<name:string,weight:double>>"), 4).collect()
    want = []
    for profile, own in owners:
        best = {}
        for name, w in own:
            best[name.lower()] = max(best.get(name.lower(), 0), w)
        found = sorted((-min(1.0, round(sum(best.get(x.lower(), 0) for x in skills) * 100) / (100 * len(skills))), o) for o, skills in offers if skills and any(x.lower() in best for x in skills))
        want += [(profile, k, o, -s) for k, (s, o) in enumerate(found[:4], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_best_offers_by_competences(spark, monkeypatch):
    rng = random.Random(8)
    inventory = ["SQL", "Power BI", "CI/CD", "R", "Excel (Power Query, TCD, VBA)", "ETL / ELT", "Gouvernance des données", "Spark / PySpark", "a-b", "?!"]
    words = ["sql", "power bi", "r", "excel", "etl / elt", "gouvernance", "des donnees", "spark", "ci/cd", "a-b", "mission", "?!", "data engineer", "nosqlx"]
    offers = [(f"o{k:03}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 3))), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))), [rng.choice(["SQL", "R", "Power BI"])] if k % 3 == 0 else []) for k in range(60)]
    keyed = match.with_match_keys(spark.createDataFrame(offers, "id string, title string, description string, skills array<string>").withColumn("score_detail", F.struct(F.array().cast("array<string>").alias("matched_skills"))))
    owners = [(k, rng.sample(inventory, rng.randrange(0, 5))) for k in range(30)]
    rows, asked = {r["id"]: r for r in keyed.collect()}, {}
    for id_, r in rows.items():
        for c in inventory:
            points = 120 if text.folded(c) in map(text.folded, dims.EXPECTED.get(r["family"], [])) else 0
            for p in match.patterns_of(c):
                rx = rf"\b{re.escape(p)}\b" if len(p) <= match.SHORT else re.escape(p)
                n = len(re.findall(rx, r["body_key"]))
                points += (500 if re.search(rx, r["title_key"]) else 0) + (150 + 50 * min(n, 4) if n else 0) + (300 if p in r["asked"] else 0)
            asked[id_, c] = points
    want = []
    for profile, own in owners:
        sums = [(-sum(max(asked[o, c] - k, 0) for k, c in enumerate(own) if asked[o, c]), o) for o in rows]
        want += [(profile, k, o, -s) for k, (s, o) in enumerate(sorted(x for x in sums if x[0] < 0)[:10], 1)]
    table = spark.createDataFrame(owners, "profile int, competences array<string>")
    for most in (profiles.LOOKED_UP, 2):  # with few keys in the plan, and with too many for it
        monkeypatch.setattr(profiles, "LOOKED_UP", most)
        assert sorted(map(tuple, profiles.best_by_competences(keyed, table).collect())) == sorted(want)


def test_no_profiles_no_offers(spark):
    offers = spark.createDataFrame([], "id string, skills array<string>")
    owners = spark.createDataFrame([(1, [("a", 1.0)])], "profile int, skills array<struct<name:string,weight:double>>")
    assert profiles.best_by_skills(offers, owners).count() == 0 and profiles.best_by_skills(spark.createDataFrame([("x", ["a"])], offers.schema), owners.where("false")).count() == 0


def test_profiles_meet_offers_without_loops(spark):
    offers = spark.createDataFrame([("x", ["a"])], "id string, skills array<string>")
    plan = profiles.best_by_skills(offers, spark.createDataFrame([(1, [("a", 1.0)])], "profile int, skills array<struct<name:string,weight:double>>"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_offers_that_say_the_same_are_asked_once(spark):
    """As with each offer by itself; of a text only the first offers by id are carried on."""
    from offerlake.config import PROFILE
    from offerlake.operators import score

    texts = ["Mission SQL Python, TJM : 450 €", "Power BI et DAX, 3 jours", "rien", "AWS S3 2.0"]
    offers = spark.createDataFrame([(f"o{k:03}", "Data Engineer", texts[k % 4].replace("450", str(500 + k)), []) for k in range(60)] + [(None, "Data Engineer", texts[1], [])], "id string, title string, description string, skills array<string>")
    owners = spark.createDataFrame([(1, ["Python", "SQL"]), (2, ["Power BI"]), (3, ["S3 2.0", "Python"])], "profile int, competences array<string>")
    keyed = match.with_match_keys(score.with_asked_skills(offers, PROFILE))
    want = profiles.best_by_competences(keyed, owners, 4).collect()
    got = profiles.best_by_said(offers, PROFILE, owners, 4)
    assert want and sorted(got.collect(), key=str) == sorted(want, key=str)
    ids, classes = match.text_classes(offers, match.all_needles(PROFILE))
    assert (ids.count(), classes.count()) == (61, 4)

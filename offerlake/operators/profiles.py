"""Offers for many profiles at once: who fits whom, over tables of both.

What offers ask for and what profiles have are lists of (key, points). Offers with equal lists are one class, and of a
class only the first few by id can be among a profile's best; profiles with equal lists are one class, too. Classes meet
in an inverted index by key, hot keys split, so work grows with the different lists that share a key, not with offers
times profiles. All points are whole numbers: sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlake import dims
from offerlake.config import Profile
from offerlake.functions.text import BOUNDARY, MARK, folded, normalize_key
from offerlake.operators.match import ASKED, BODY, BODY_EACH, BODY_MOST, EXPECTED, LOOSE, SHORT, TITLE, all_needles, text_classes, with_match_keys
from offerlake.operators.score import with_asked_skills
from offerlake.storage import written

POINTS = "array<struct<key:string,points:int>>"
MEETINGS = 100_000  # meetings of a key's classes that one task gets, about
GRAM = 3
LOOKED_UP = 5_000  # keys of needles that are looked up in a plan's hash set before the join; more of them aren't
BEST = 10


def classes(rows: DataFrame, id_: str, most: int | None) -> DataFrame:
    """cls, the digest of a row's points, with id and place in its class (by id, null last), and the points at place 1.
    With `most`, only so many rows of a class; they are cut in each task before they are shuffled."""
    out = rows.select(F.col(id_).alias("id"), "points", *[c for c in ("size",) if c in rows.columns])
    key = F.sha2(F.to_json(F.struct(*[c for c in out.columns if c != "id"])), 256)
    out = out.withColumn("cls", key).withColumn("place", F.row_number().over(W.partitionBy("cls").orderBy(F.asc_nulls_last("id"))))
    out = out.where(F.col("place") <= most) if most else out
    return written(out.withColumn("points", F.when(F.col("place") == 1, F.col("points"))), "classes")


def best_of(asked: DataFrame, wanted: DataFrame, worth: Callable[[Column, Column], Column], score: Callable[[Column, Column], Column], most: int = BEST) -> DataFrame:
    """profile, pos, id and score of the `most` best offers of each profile; equal scores by id.

    asked: id, points (POINTS, sorted, each key once) and size, a number that `score` may use. wanted: profile and points.
    worth(asked points, wanted points): what one shared key is worth, a whole number. score(sum of worths, size): the score,
    null or 0 for no match. Rows of either side without points match nothing.

    A key's classes on both sides multiply. Where that is more than MEETINGS, the offers' classes of the key are dealt into
    parts and the profiles' repeated for each part.
    """
    offers, profiles = classes(asked, "id", most), classes(wanted, "profile", None)
    a = offers.where("place = 1").select(F.col("cls").alias("offer_cls"), F.inline("points")).withColumnRenamed("points", "asks")
    b = profiles.where("place = 1").select(F.col("cls").alias("profile_cls"), F.inline("points")).withColumnRenamed("points", "has")
    sizes = a.groupBy("key").agg(F.count("*").alias("n")).join(b.groupBy("key").agg(F.count("*").alias("m")), "key")
    parts = written(sizes.select("key", F.ceil(F.col("n") * F.col("m") / MEETINGS).cast("int").alias("parts")), "parts")
    a = a.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("offer_cls"), F.col("parts")).cast("int")).drop("parts")
    b = b.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    sums = a.join(b, ["key", "part"]).groupBy("profile_cls", "offer_cls").agg(F.sum(worth(F.col("asks"), F.col("has"))).alias("sum"))
    firsts = offers.where("place = 1").select(F.col("cls").alias("offer_cls"), "size", F.col("id").alias("first"))
    scored = sums.join(firsts, "offer_cls").withColumn("score", score(F.col("sum"), F.col("size"))).where("score > 0")
    # The best rows lie in the best classes by (score, first id): any other class has as many rows before it.
    top = W.partitionBy("profile_cls").orderBy(F.desc("score"), "first")
    scored = scored.withColumn("k", F.row_number().over(top)).where(F.col("k") <= most).select("profile_cls", "offer_cls", "score")
    rows = scored.join(offers.select(F.col("cls").alias("offer_cls"), "id"), "offer_cls")
    best = rows.withColumn("pos", F.row_number().over(W.partitionBy("profile_cls").orderBy(F.desc("score"), "id"))).where(F.col("pos") <= most)
    return profiles.select(F.col("cls").alias("profile_cls"), F.col("id").alias("profile")).join(best, "profile_cls").select("profile", "pos", "id", "score")


def skill_points(profiles: DataFrame) -> DataFrame:
    """profile and points in hundredths from skills: array<struct<name, weight>>; a name's best weight counts."""
    rows = profiles.select("profile", F.explode("skills").alias("s")).groupBy("profile", normalize_key(F.col("s.name")).alias("key")).agg(F.max(F.round(F.col("s.weight") * 100).cast("int")).alias("points"))
    return rows.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("key", "points"))).cast(POINTS).alias("points"))


def best_by_skills(offers: DataFrame, profiles: DataFrame, most: int = BEST) -> DataFrame:
    """The offers (id, skills) of which each profile covers most: shares of the required skills by weight, 1 at most."""
    keys = F.transform("skills", normalize_key)
    points = F.array_sort(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.size(F.filter(keys, lambda x: x == k)).alias("points"))))
    asked = offers.select("id", points.cast(POINTS).alias("points"), F.size("skills").alias("size"))
    return best_of(asked, skill_points(profiles), lambda times, weight: times * weight, lambda total, size: F.least(total / (size * 100), F.lit(1.0)), most)


def competence_needles(profiles: DataFrame) -> DataFrame:
    """kind, key, competence, form, short, letters: each different competence of the profiles under what leads to it in an
    offer. Short needles stand between word boundaries and are filed by their longest word (w), others by a piece of three
    letters of it (g), needles without such a piece under an empty key that every offer has; skills asked for by name (a)
    and role families (f) lead to their competences directly."""
    names = profiles.select(F.explode("competences").alias("competence")).distinct()
    base = F.trim(normalize_key(F.regexp_replace("competence", r"\([^)]*\)", "")))
    aliases = F.create_map(*[F.lit(x) for name, own in dims.ALIASES.items() for x in (name, "\n".join(own))])
    also = F.split(aliases[F.col("competence")], "\n")
    letters = F.filter(F.concat(F.array(base), F.coalesce(also, F.array().cast("array<string>"))), lambda x: x != "")
    rows = names.select("competence", F.explode(letters).alias("letters")).withColumn("short", F.length("letters") <= SHORT)
    split_ = F.regexp_replace("letters", r"(?U)(\w+)", f"{BOUNDARY}$1{BOUNDARY}")
    form = F.when(F.col("short"), F.concat(F.lit(MARK), F.btrim(split_, F.lit(MARK)), F.lit(MARK))).otherwise(F.col("letters"))
    words = F.filter(F.split(split_, MARK), lambda w: w.rlike(r"(?U)^\w+$"))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    gram = F.when(F.length(longest) >= GRAM, F.substring(longest, 1, GRAM))
    key = F.coalesce(F.when(F.col("short"), longest).otherwise(gram), F.lit(""))
    found = rows.select(F.when(F.col("short"), "w").otherwise("g").alias("kind"), key.alias("key"), "competence", form.alias("form"), "short", "letters")
    asked = rows.select(F.lit("a").alias("kind"), F.col("letters").alias("key"), "competence", F.lit("").alias("form"), F.lit(False).alias("short"), "letters")
    expected = F.create_map(*[F.lit(x) for name, own in family_keys().items() for x in (name, "\n".join(own))])
    families = names.select("competence", F.explode(F.split(expected[normalize_key(F.col("competence"))], "\n")).alias("key"))
    return found.unionByName(asked).unionByName(families.select(F.lit("f").alias("kind"), "key", "competence", F.lit("").alias("form"), F.lit(False).alias("short"), F.lit("").alias("letters")))


def family_keys() -> dict[str, list[str]]:
    """Normalised competence -> role families that let one expect it."""
    out: dict[str, list[str]] = {}
    for family, own in dims.EXPECTED.items():
        for c in own:
            out.setdefault(folded(c), []).append(family)
    return out


def looked_up(needles: DataFrame, kind: str) -> list[str] | None:
    """The keys of a kind, if they are few enough for a plan."""
    keys = [r[0] for r in needles.where(F.col("kind") == kind).select("key").distinct().limit(LOOKED_UP + 1).collect()]
    return keys if len(keys) <= LOOKED_UP else None


def demand(keyed: DataFrame, needles: DataFrame) -> DataFrame:
    """id and points in hundredths: how much an offer with match keys (`match.with_match_keys`) asks for each competence
    that it asks for at all.

    An offer's words, pieces of words, asked skills and family are looked up among the needles in one join; what is found
    is counted in the offer's own row, before anything is shuffled, as long as Spark broadcasts the needles by their size.
    """
    title, body = F.col("title_marks"), F.col("body_marks")
    words = F.array_distinct(F.concat(F.split(title, MARK), F.split(body, MARK)))
    pieces = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= GRAM), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - GRAM + 1), lambda i: F.substring(w, i, F.lit(GRAM)))))

    def some(values: Column, kind: str) -> Column:
        known = looked_up(needles, kind)
        kept = values if known is None else F.filter(values, lambda x: x.isin(known)) if known else F.array().cast("array<string>")
        return F.transform(F.array_distinct(kept), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    every = F.array(F.lit(""))
    keys = F.concat(some(F.concat(words, every), "w"), some(F.concat(pieces, every), "g"), some(F.col("asked"), "a"), some(F.array("family"), "f"))
    met = keyed.select("id", "title_key", "body_key", "title_marks", "body_marks", F.inline(keys)).join(needles, ["kind", "key"])
    in_title, in_body = (F.when(F.col("short"), F.col(marks)).otherwise(F.col(key)) for marks, key in (("title_marks", "title_key"), ("body_marks", "body_key")))
    times = (F.octet_length(in_body) - F.octet_length(F.replace(in_body, F.col("form"), F.lit("")))) / F.octet_length("form")
    hundredths = lambda x: F.lit(int(round(100 * x)))
    text = F.when(F.contains(in_title, F.col("form")), hundredths(TITLE)).otherwise(0) + F.when(F.contains(in_body, F.col("form")), hundredths(BODY) + F.least(times.cast("int"), F.lit(BODY_MOST)) * hundredths(BODY_EACH)).otherwise(0)
    points = F.when(F.col("kind") == "a", hundredths(ASKED)).when(F.col("kind") == "f", hundredths(EXPECTED)).otherwise(text)
    sums = met.select("id", F.col("competence").alias("key"), points.alias("points")).where("points > 0").groupBy("id", "key").agg(F.sum("points").cast("int").alias("points"))
    return sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("key", "points"))).cast(POINTS).alias("points"))


def best_by_competences(keyed: DataFrame, profiles: DataFrame, most: int = BEST) -> DataFrame:
    """The offers with match keys that ask most for what each profile (profile, competences in order) has: the sum of its
    competences' relevance, each less a hundredth for its rank, in hundredths. A competence named twice has its first rank."""
    return best_of_demand(demand(keyed, written(competence_needles(profiles), "needles")), profiles, most)


def best_by_said(offers: DataFrame, profile: Profile, profiles: DataFrame, most: int = BEST) -> DataFrame:
    """`best_by_competences` for offers with id, title, readable description and tags. What a text asks for is worked out
    once, however many offers say it, and only the first of them by id, which are among the first of their class, too.
    `profile` is the one whose skills an offer is read with."""
    needles = written(competence_needles(profiles), "needles")
    loose = [r[0] for r in needles.where(F.col("letters").rlike(LOOSE)).select("letters").limit(1).collect()]
    ids, texts = text_classes(offers, [*all_needles(profile), *loose])
    place = F.row_number().over(W.partitionBy("cls").orderBy(F.asc_nulls_last("id")))
    firsts = ids.withColumn("place", place).where(F.col("place") <= most).select("id", "cls")
    asked = demand(with_match_keys(with_asked_skills(texts, profile)).withColumnRenamed("cls", "id"), needles).withColumnRenamed("id", "cls")
    return best_of_demand(firsts.join(asked, "cls").drop("cls"), profiles, most)


def best_of_demand(asked: DataFrame, profiles: DataFrame, most: int) -> DataFrame:
    asked = asked.withColumn("size", F.lit(0))
    ranks = F.transform(F.array_distinct("competences"), lambda c: F.struct(c.alias("key"), (F.array_position(F.col("competences"), c) - 1).cast("int").alias("points")))
    wanted = profiles.select("profile", F.array_sort(ranks).cast(POINTS).alias("points"))
    return best_of(asked, wanted, lambda points, rank: F.greatest(points - rank, F.lit(0)), lambda total, _: total, most)

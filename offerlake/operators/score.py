"""Score of an offer for a profile: a mean over known signals, with its explanation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlake import dims
from offerlake.config import LEVEL_WEIGHTS, NO_SKILLS_CAP, UNWEIGHTED, Config, Profile
from offerlake.functions.dates import age_days, daily_rate
from offerlake.functions.extract import extract_skills, skills_key
from offerlake.functions.text import folded, normalize_key
from offerlake.schema import settled
from offerlake.storage import written

SIGNALS = ("skills_match", "daily_rate", "remote", "freshness", "duration")

# How well each policy (full_remote, hybrid, onsite) suits a preference.
REMOTE_FIT = {"full_remote": (1.0, 0.4, 0.0), "hybrid": (1.0, 0.9, 0.3), "onsite": (0.5, 0.8, 1.0)}


def profile_skills(profile: Profile) -> list[tuple[str, str, int]]:
    """(skill, level, order) over the levels in their order."""
    flat = [(s, level) for level in LEVEL_WEIGHTS for s in profile.skills.get(level, [])]
    return [(s, level, k) for k, (s, level) in enumerate(flat)]


def skill_weights(profile: Profile) -> dict[str, float]:
    """Normalised name -> weight of its best level. A name that only matches without its accents has no level of its own."""
    exact: dict[str, float] = {}
    for s, level, _ in profile_skills(profile):
        exact.setdefault(s.lower(), LEVEL_WEIGHTS[level])
    return {folded(s): exact.get(folded(s), UNWEIGHTED) for s, _, _ in profile_skills(profile)}


def required_skills(text_key: Column) -> Column:
    """The offer's skills, else those its text (normalised) names."""
    return F.when(F.size("skills") > 0, F.col("skills")).otherwise(extract_skills(text_key))


def skills_signal(profile: Profile, required: Column) -> tuple[Column, Column, Column]:
    """Share of the required skills that the profile has, by weight; matched; missing."""
    weights = skill_weights(profile)
    if not weights:
        return F.when(F.size(required) > 0, F.lit(0.0)), F.array().cast("array<string>"), required
    by_key = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    keys = F.create_map(*[F.lit(x) for s in dims.SKILLS for x in (s, folded(s))])  # names of the taxonomy needn't be folded again
    weight = lambda s: by_key[F.coalesce(keys[s], normalize_key(s))]
    matched = F.filter(required, lambda s: weight(s).isNotNull())
    missing = F.filter(required, lambda s: weight(s).isNull())
    total = F.aggregate(F.transform(matched, weight), F.lit(0.0), lambda a, w: a + w)
    return F.when(F.size(required) > 0, F.least(total / F.size(required), F.lit(1.0))), matched, missing


def rate_signal(profile: Profile) -> Column:
    rate = daily_rate(F.col("daily_rate_min"), F.col("daily_rate_max"))
    target, floor = profile.rate_target, profile.rate_floor
    if not target:
        return F.lit(None).cast("double")
    base = floor or target * 0.7
    between = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rate - F.lit(base)) / F.lit(float(target - base)))) if target != base else F.lit(0.5)
    return F.when(rate >= target, 1.0).when(rate < (floor or 0), 0.0).when(rate.isNotNull(), between)


def remote_signal(profile: Profile) -> Column:
    fit = REMOTE_FIT.get(profile.remote.lower(), REMOTE_FIT["hybrid"])
    out = F
    for policy, value in zip(("full_remote", "hybrid", "onsite"), fit, strict=True):
        out = out.when(F.col("remote") == policy, value)
    return out


def freshness_signal(cfg: Config, as_of: datetime) -> Column:
    age = age_days(F.col("published_at"), as_of)
    return F.when(age <= 1, 1.0).when(age.isNotNull(), F.greatest(F.lit(0.0), 1 - age / max(cfg.max_age_days, 1)))


def duration_signal(profile: Profile) -> Column:
    ratio = F.nullif(F.col("duration_months"), F.lit(0.0)) / F.lit(float(profile.preferred_months or 6))
    return F.when(ratio > 2.5, 0.85).when(ratio >= 1, 1.0).when(ratio.isNotNull(), F.greatest(F.lit(0.2), ratio))


def with_required(offers: DataFrame) -> DataFrame:
    """Adds __required: the offer's skills, else those its text names."""
    keyed = settled(offers.withColumn("__text", F.when(F.size("skills") == 0, normalize_key(F.concat_ws(" ", "title", "description")))))
    return settled(keyed.withColumn("__required", required_skills(F.col("__text"))).drop("__text"))


def with_asked_skills(offers: DataFrame, profile: Profile) -> DataFrame:
    """skills and score_detail as facts and score_offers make them, of score_detail only matched_skills and missing_skills:
    all that matching needs, without rates, policies and dates."""
    named = settled(offers.withColumn("__key", skills_key()))
    required = with_required(settled(named.withColumn("skills", extract_skills(F.col("__key"))).drop("__key")))
    _, matched, missing = skills_signal(profile, F.col("__required"))
    return settled(required.withColumn("score_detail", F.struct(matched.alias("matched_skills"), missing.alias("missing_skills"))).drop("__required"))


def score_offers(offers: DataFrame, profile: Profile, cfg: Config, as_of: datetime, explained: bool = True) -> DataFrame:
    """Adds score_raw, score (one decimal) and, if it is to be explained, score_detail.

    Unknown signals leave both the sum and the weights; without any the score is 0; without the skills signal it is at
    most 50.
    """
    return weighed(with_skills_match(offers, profile), profile, cfg, as_of, explained)


def with_skills_match(offers: DataFrame, profile: Profile) -> DataFrame:
    """Adds the signal of the skills, and the matched and missing ones."""
    skills, matched, missing = skills_signal(profile, F.col("__required"))
    return with_required(offers).withColumns({"__skills_match": skills, "__matched": matched, "__missing": missing}).drop("__required")


def weighed(offers: DataFrame, profile: Profile, cfg: Config, as_of: datetime, explained: bool) -> DataFrame:
    """The score of offers that have their skills' signal, from this and the other signals."""
    out = offers.withColumns({"__daily_rate": rate_signal(profile), "__remote": remote_signal(profile), "__freshness": freshness_signal(cfg, as_of), "__duration": duration_signal(profile)})
    weight = {s: float(cfg.weights.get(s, 0)) for s in SIGNALS}
    add = lambda parts: sum(parts[1:], parts[0])
    known = add([F.when(F.col(f"__{s}").isNotNull(), weight[s]).otherwise(0.0) for s in SIGNALS])
    total = add([F.coalesce(F.col(f"__{s}"), F.lit(0.0)) * weight[s] for s in SIGNALS])
    out = out.withColumns({"__known": known, "__mean": F.when(known > 0, total / known * 100).otherwise(0.0)})
    out = out.withColumn("score_raw", F.when(F.col("__skills_match").isNull(), F.least("__mean", F.lit(NO_SKILLS_CAP))).otherwise(F.col("__mean")))
    detail = F.struct(
        *[F.round(f"__{s}", 3).alias(s) for s in SIGNALS],
        F.col("__matched").alias("matched_skills"),
        F.col("__missing").alias("missing_skills"),
        F.array_compact(F.array(*[F.when(F.col(f"__{s}").isNull(), F.lit(s)) for s in SIGNALS])).alias("ignored_signals"),
        F.round(F.col("__known") / (sum(weight.values()) or 1.0), 3).alias("covered_weight"),
    )
    out = out.withColumns({"score": F.round("score_raw", 1)} | ({"score_detail": detail} if explained else {}))
    return settled(out.drop(*[c for c in out.columns if c.startswith("__")]))


def score_band(score: Column, threshold: float) -> Column:
    return F.when(score >= threshold, "high").when(score >= threshold - 15, "middle").otherwise("low")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds pos, the place in the whole table, without sorting it in one task: the rows are written, as a range sort reads
    them twice; then a global range sort, written with each row's partition and place in it, so that a task that runs again can't change them; then the rows before each
    partition are added."""
    at = written(rows, "unranked").orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    at = written(at, "ranked")
    sizes = at.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = sizes.select("__part", "__first", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # one row a partition
    out = at.join(F.broadcast(before), "__part")  # as many rows as the sort had partitions
    return out.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__first", "__before")

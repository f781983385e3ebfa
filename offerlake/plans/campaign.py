"""A campaign: offers to facts, decisions, scores and a ranking, as one lazy plan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.config import Config, Profile
from offerlake.functions.extract import enrich_offers, normalize_offers
from offerlake.operators.filters import decided, judged
from offerlake.operators.score import score_offers, weighed, with_skills_match
from offerlake.schema import settled
from offerlake.storage import written


def facts(offers: DataFrame, contracts: bool = True) -> DataFrame:
    return settled(enrich_offers(settled(normalize_offers(offers, contracts)), contracts))


SAID = ("title", "description", "raw_html", "location", "remote", "daily_rate_min", "daily_rate_max", "duration_months", "skills")  # what the facts of a score come from
SCORED_BY = ("remote", "daily_rate_min", "daily_rate_max", "duration_months")  # beside skills and date


def scores(offers: DataFrame, profile: Profile, cfg: Config, as_of: datetime, *keep: str) -> DataFrame:
    """The columns to keep, title (trimmed), score_raw and score, as facts and score_offers make them. Every different text,
    with what its source declared, is read once. The texts and the offers that they are joined to, by a digest, come from
    one written table. Contract and status, which a score doesn't ask for, aren't read."""
    sized = lambda x: F.when(x.isNull(), "-").otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x))
    tags = F.coalesce("skills", F.array().cast("array<string>"))
    digest = F.unhex(F.sha2(F.concat(*[sized(F.col(x).cast("string")) for x in SAID if x != "skills"], F.when(F.size(tags) > 0, F.to_json(tags)).otherwise("")), 256))
    rows = written(offers.withColumns({"skills": tags, "cls": digest}).select(*dict.fromkeys(["cls", "published_at", *keep, *SAID])), "said")
    read = with_skills_match(facts(rows.select("cls", *SAID).distinct(), contracts=False), profile)
    texts = written(read.select("cls", *SCORED_BY, "__skills_match", "__matched", "__missing"), "texts")
    joined = rows.select(*dict.fromkeys(["cls", "published_at", "title", *keep])).join(texts, "cls").withColumn("title", F.trim("title"))
    return weighed(joined, profile, cfg, as_of, explained=False).select(*dict.fromkeys([*keep, "title", "score_raw", "score"]))


def campaign(offers: DataFrame, cfg: Config, profile: Profile, as_of: datetime, order: str = "seq", last_run: datetime | None = None) -> DataFrame:
    """The offers that a campaign keeps, scored. `order` tells which of two equal offers comes first; with a last run,
    only offers published since then, less the margin, are looked at."""
    cutoff = last_run - timedelta(days=cfg.refresh_margin_days) if last_run else None
    passing = judged(facts(offers), cfg, as_of, cutoff).where("reject_reason is null")  # a row that fails claims no key
    kept = decided(passing, order).where("decision = 'kept'")
    return score_offers(kept, profile, cfg, as_of)


def metrics(decided_offers: DataFrame, known_ids: DataFrame) -> DataFrame:
    """By source: offers fetched, kept, and of these new and known ones."""
    marked = decided_offers.join(known_ids.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    kept = F.col("decision") == "kept"
    return marked.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(kept).alias("kept"), F.count_if(kept & F.col("known").isNull()).alias("new"), F.count_if(kept & F.col("known").isNotNull()).alias("updated"))

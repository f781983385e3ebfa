"""Filters: each offer's first failing reason, and deduplication that depends on it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake import dims
from offerlake.config import Config
from offerlake.functions.dates import age_days, daily_rate
from offerlake.functions.extract import core_skill_count
from offerlake.functions.text import contains_any, cross_key, fingerprint, folded, normalize_key
from offerlake.schema import settled
from offerlake.storage import written


def with_keys(offers: DataFrame) -> DataFrame:
    """Normalised title, description, start of the description and location, made once for all predicates."""
    return offers.withColumns({
        "title_key": normalize_key(F.col("title")),
        "desc_key": normalize_key(F.col("description")),
        "head_key": normalize_key(F.substring("description", 1, 1500)),
        "loc_key": normalize_key(F.col("location")),
    })


KEYS = ("title_key", "desc_key", "head_key", "loc_key")


def matches_keywords(cfg: Config) -> Column:
    """A keyword in the title, or enough core skills and a keyword in the description."""
    by_title = contains_any(F.col("title_key"), cfg.keywords_any).isNotNull()
    by_text = contains_any(F.col("desc_key"), cfg.keywords_any).isNotNull()
    return by_title | ((core_skill_count(F.col("skills")) >= cfg.min_core_skills) & by_text)


def excluded_term(cfg: Config) -> Column:
    """The excluded term of the title, else the contract term of the description's first 1500 characters."""
    return F.coalesce(contains_any(F.col("title_key"), cfg.exclude_any), contains_any(F.col("head_key"), dims.DESCRIPTION_EXCLUDES))


def wanted_contracts(cfg: Config) -> list[str]:
    known = [dims.CONTRACT_ALIASES.get(folded(c)) for c in cfg.contracts]
    return list(dict.fromkeys(c for c in known if c))


def rejects_contract(cfg: Config) -> Column:
    wanted = wanted_contracts(cfg)
    return (F.col("contract") != "unknown") & ~F.col("contract").isin(wanted) if wanted else F.lit(False)


def rejects_cutoff(cutoff: datetime | None) -> Column:
    return F.coalesce(F.col("published_at") < F.lit(cutoff), F.lit(False)) if cutoff else F.lit(False)


def rejects_age(cfg: Config, as_of: datetime) -> Column:
    return F.coalesce(age_days(F.col("published_at"), as_of) > cfg.max_age_days, F.lit(False)) if cfg.max_age_days else F.lit(False)


def rejects_rate(cfg: Config) -> Column:
    rate = daily_rate(F.col("daily_rate_min"), F.col("daily_rate_max"))
    return F.coalesce(rate < cfg.min_daily_rate, F.lit(False)) if cfg.min_daily_rate else F.lit(False)


def blocked_location(cfg: Config) -> Column:
    return contains_any(F.col("loc_key"), cfg.locations_exclude)


def rejects_location(cfg: Config) -> Column:
    if not cfg.locations:
        return F.lit(False)
    outside = contains_any(F.col("loc_key"), cfg.locations).isNull()
    return outside & ~F.col("source").isin(cfg.locations_skip_sources) if cfg.locations_skip_sources else outside


def rejects_onsite(cfg: Config) -> Column:
    return ~F.col("remote").isin("full_remote", "hybrid") if cfg.remote_only else F.lit(False)


def reject_reason(cfg: Config, as_of: datetime, cutoff: datetime | None = None) -> Column:
    """The first failing predicate with its term, or null for an offer that passes all."""
    excluded, blocked = excluded_term(cfg), blocked_location(cfg)
    return F.coalesce(
        F.when(~matches_keywords(cfg), "off_keywords"),
        F.concat(F.lit("excluded_term:"), excluded),
        F.when(rejects_contract(cfg), F.concat(F.lit("contract:"), F.col("contract"))),
        F.when(rejects_cutoff(cutoff), "before_cutoff"),
        F.when(rejects_age(cfg, as_of), "too_old"),
        F.when(rejects_rate(cfg), "rate_low"),
        F.concat(F.lit("location_blocked:"), blocked),
        F.when(rejects_location(cfg), "location"),
        F.when(rejects_onsite(cfg), "not_remote"),
    )


def judged(offers: DataFrame, cfg: Config, as_of: datetime, cutoff: datetime | None = None) -> DataFrame:
    """Adds id, cross_key and reject_reason."""
    out = settled(with_keys(offers)).withColumn("reject_reason", reject_reason(cfg, as_of, cutoff)).drop(*KEYS)
    return settled(out.withColumns({"id": fingerprint(F.col("title"), F.col("company"), F.col("source")), "cross_key": cross_key(F.col("title"), F.col("company"))}))


def decided(judged_offers: DataFrame, order: str) -> DataFrame:
    """Adds decision: kept, duplicate or rejected. Only a kept offer claims its key: a row after it is a duplicate,
    whether or not it passes; a row before it that fails is rejected.

    The first passing row of a key is found by a partial aggregation and joined back, so that a key with very many
    rows is never sorted in one task. `order` is a unique column. The judged rows are written first, as both steps need
    them and a judgement costs more than reading it; leave out columns that you don't need.
    """
    rows = written(judged_offers, "judged")
    firsts = rows.where("reject_reason is null").groupBy("cross_key").agg(F.min(order).alias("first_kept"))
    out = rows.join(firsts, "cross_key", "left")
    return out.withColumn("decision", F.when(F.col(order) == F.col("first_kept"), "kept").when(F.col(order) > F.col("first_kept"), "duplicate").otherwise("rejected")).drop("first_kept")


def rejection_report(decided_offers: DataFrame) -> DataFrame:
    """Offers by reason, duplicates as one reason, the most frequent first."""
    reason = F.when(F.col("decision") == "duplicate", "duplicate").otherwise(F.col("reject_reason"))
    return decided_offers.where("decision <> 'kept'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")

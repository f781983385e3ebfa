"""JSON feeds of the sources: one adapter each, from a landed payload to canonical offers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake import dims
from offerlake.functions.dates import parse_datetime
from offerlake.functions.extract import parse_daily_rate
from offerlake.functions.text import clean_text, strip_html, unescape
from offerlake.schema import canonical

TAGS_MOST = 25


def parse_tags(raw: Column) -> Column:
    """Tags from a list in JSON, a list in single quotes, or words between commas; 25 at most."""
    text = F.coalesce(F.trim(raw), F.lit(""))
    listed = F.from_json(F.when(text.startswith("["), text), "array<string>", {"allowSingleQuotes": "true"})
    whole = F.when(F.forall(listed, lambda t: t.isNotNull()), listed)
    words = F.filter(F.transform(F.split(F.regexp_replace(text, r"^\[+|\]+$", ""), ","), lambda t: F.regexp_replace(t, r"^[ '\"]+|[ '\"]+$", "")), lambda t: t != "")
    return F.slice(F.coalesce(whole, words), 1, TAGS_MOST)


def chosen(key: Column, table: dict[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(lookup[key], F.lit("unknown"))


def or_empty(name: str) -> Column:
    return F.coalesce(F.col(f"r.{name}").cast("string"), F.lit(""))


def or_else(name: str, other: str) -> Column:
    return F.coalesce(F.nullif(F.col(f"r.{name}"), F.lit("")), F.lit(other))


@dataclass(frozen=True)
class Feed:
    """schema: what the payload's items are read as; title: the field without which an item is no offer; columns: the
    offer's columns from the parsed item `r`. Fields that can't be read are null; the item still counts."""

    name: str
    schema: str
    title: str
    columns: Callable[[], dict[str, Column]]


def adzuna() -> dict[str, Column]:
    return {
        "source_id": or_empty("id"), "url": or_empty("redirect_url"), "title": strip_html(F.col("r.title")), "company": or_empty("company.display_name"),
        "description": strip_html(F.col("r.description")), "location": or_empty("location.display_name"),
        "contract": chosen(F.lower(or_empty("contract_type")), {"contract": "freelance", "permanent": "cdi"}), "published_at": parse_datetime(F.col("r.created")),
    }


def francetravail() -> dict[str, Column]:
    labels = F.concat_ws(" · ", *[F.nullif(F.col(f"r.{c}"), F.lit("")) for c in ("typeContratLibelle", "experienceLibelle", "qualificationLibelle", "dureeTravailLibelleConverti")])
    text = strip_html(F.col("r.description"))
    return {
        "source_id": or_empty("id"),
        "url": F.coalesce(F.nullif(F.col("r.origineOffre.urlOrigine"), F.lit("")), F.concat(F.lit("https://candidat.francetravail.fr/offres/recherche/detail/"), or_empty("id"))),
        "title": strip_html(F.col("r.intitule")),
        "company": or_empty("entreprise.nom"),
        "description": F.when(labels == "", text).otherwise(F.trim(F.concat(text, F.lit("\n\n"), labels))),
        "location": or_empty("lieuTravail.libelle"),
        "contract": F.when(F.col("r.alternance"), "alternance").otherwise(chosen(F.upper(or_empty("typeContrat")), dims.CONTRACT_CODES)),
        "skills": F.slice(F.filter(F.transform(F.coalesce("r.competences", F.array().cast("array<struct<libelle:string>>")), lambda c: c["libelle"]), lambda x: x != ""), 1, TAGS_MOST),
        "published_at": parse_datetime(F.col("r.dateCreation")),
    }


def remotive() -> dict[str, Column]:
    return {
        "source_id": or_empty("id"), "url": or_empty("url"), "title": F.col("r.title"), "company": or_empty("company_name"), "description": strip_html(F.col("r.description")), "raw_html": F.col("r.description"),
        "location": or_else("candidate_required_location", "Remote"), "remote": F.lit("full_remote"), "contract": chosen(F.lower(or_empty("job_type")), dims.JOB_TYPES),
        "skills": parse_tags(F.col("r.tags")), "published_at": parse_datetime(F.col("r.publication_date")),
    }


def remoteok() -> dict[str, Column]:
    return {
        "source_id": or_empty("id"), "url": F.coalesce(F.nullif(F.col("r.url"), F.lit("")), F.col("r.apply_url")), "title": unescape(F.col("r.position")), "company": unescape(or_empty("company")),
        "description": strip_html(F.col("r.description")), "raw_html": F.col("r.description"), "location": or_else("location", "Remote"), "remote": F.lit("full_remote"),
        "skills": parse_tags(F.col("r.tags")), "published_at": parse_datetime(F.col("r.date")),
    }


def freelance_if(text: Column) -> Column:
    return F.when(F.contains(F.lower(text), F.lit("contract")), "freelance").otherwise("unknown")


def jobicy() -> dict[str, Column]:
    return {
        "source_id": or_empty("id"), "url": or_empty("url"), "title": unescape(F.col("r.jobTitle")), "company": unescape(or_empty("companyName")),
        "description": strip_html(F.coalesce(F.nullif(F.col("r.jobDescription"), F.lit("")), F.col("r.jobExcerpt"))), "location": or_else("jobGeo", "Remote"), "remote": F.lit("full_remote"),
        "contract": freelance_if(or_empty("jobType")), "skills": parse_tags(F.col("r.jobIndustry")), "published_at": parse_datetime(F.col("r.pubDate")),
    }


def himalayas() -> dict[str, Column]:
    places = F.array_join(F.coalesce("r.locationRestrictions", F.array().cast("array<string>")), ", ")
    return {
        "source_id": F.coalesce(F.nullif(F.col("r.guid"), F.lit("")), F.col("r.companySlug")), "url": F.coalesce(F.nullif(F.col("r.applicationLink"), F.lit("")), F.col("r.url")), "title": F.col("r.title"), "company": or_empty("companyName"),
        "description": strip_html(F.coalesce(F.nullif(F.col("r.description"), F.lit("")), F.col("r.excerpt"))), "location": F.when(places == "", "Remote").otherwise(places), "remote": F.lit("full_remote"),
        "contract": freelance_if(or_empty("employmentType")), "skills": parse_tags(F.col("r.categories")), "published_at": parse_datetime(F.coalesce("r.pubDate", "r.publishedDate")),
    }


def arbeitnow() -> dict[str, Column]:
    return {
        "source_id": or_empty("slug"), "url": or_empty("url"), "title": F.col("r.title"), "company": or_empty("company_name"), "description": strip_html(F.col("r.description")), "location": or_empty("location"),
        "remote": F.when(F.col("r.remote"), "full_remote").otherwise("unknown"), "skills": parse_tags(F.col("r.tags")), "published_at": parse_datetime(F.col("r.created_at")),
    }


def workingnomads() -> dict[str, Column]:
    return {
        "source_id": F.right(or_empty("url"), F.lit(60)), "url": or_empty("url"), "title": F.col("r.title"), "company": or_empty("company_name"), "description": strip_html(F.col("r.description")), "location": or_else("location", "Remote"), "remote": F.lit("full_remote"),
        "skills": F.slice(F.filter(F.transform(F.split(or_empty("tags"), ","), lambda t: F.trim(t)), lambda t: t != ""), 1, TAGS_MOST), "published_at": parse_datetime(F.col("r.pub_date")),
    }


def budget(text: Column) -> Column:
    """struct(low, high): a bare number from 100 to 2500, else the daily rate that the phrase states."""
    x = F.trim(F.coalesce(text, F.lit("")))
    bare = x.rlike(r"^\d+$")
    n = F.when(bare, x.try_cast("int"))
    return F.when(bare, F.when(n.between(100, 2500), F.struct(n.alias("low"), n.alias("high"))).otherwise(F.struct(F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high")))).otherwise(parse_daily_rate(x))


def best_remote(preferences: Column) -> Column:
    """The most favourable policy that a list of work preferences names."""
    upper, out = F.transform(preferences, lambda p: F.upper(p)), F
    for policy, words in dims.WORK_PREFERENCES.items():
        out = out.when(F.arrays_overlap(upper, F.array(*map(F.lit, words))), policy)
    return out.otherwise("unknown")


def collectivework() -> dict[str, Column]:
    slug, rate = or_empty("slug"), budget(F.col("r.budgetBrief"))
    empty = F.array().cast("array<string>")
    return {
        "source_id": F.substring(F.coalesce(F.nullif(F.col("r.id"), F.lit("")), slug), 1, 120), "url": F.concat(F.lit("https://www.collective.work/jobs/fr"), F.when(slug == "", "").otherwise(F.concat(F.lit("/"), slug))),
        "title": F.trim("r.name"), "company": or_empty("company.name"), "description": strip_html(F.col("r.description")), "location": F.coalesce(F.nullif(F.col("r.location.fullNameFrench"), F.lit("")), F.col("r.location.fullNameEnglish")),
        "remote": best_remote(F.col("r.workPreferences")), "contract": F.when(F.col("r.isPermanentContract"), "cdi").otherwise("freelance"), "daily_rate_min": rate["low"], "daily_rate_max": rate["high"],
        "skills": F.concat(F.coalesce("r.projectTypes", empty), F.coalesce("r.projectTypeSuggestions", empty)), "published_at": parse_datetime(F.col("r.publishedAt")),
    }


FEEDS = {
    f.name: f
    for f in (
        Feed("adzuna", "id string, title string, description string, contract_type string, redirect_url string, created string, company struct<display_name:string>, location struct<display_name:string>", "title", adzuna),
        Feed("francetravail", "id string, intitule string, description string, dateCreation string, typeContrat string, typeContratLibelle string, experienceLibelle string, qualificationLibelle string, dureeTravailLibelleConverti string, alternance boolean, lieuTravail struct<libelle:string>, entreprise struct<nom:string>, origineOffre struct<urlOrigine:string>, competences array<struct<libelle:string>>", "intitule", francetravail),
        Feed("remotive", "id string, url string, title string, company_name string, description string, candidate_required_location string, tags string, job_type string, publication_date string", "title", remotive),
        Feed("remoteok", "id string, url string, apply_url string, position string, company string, description string, location string, tags string, date string", "position", remoteok),
        Feed("jobicy", "id string, url string, jobTitle string, companyName string, jobDescription string, jobExcerpt string, jobGeo string, jobType string, jobIndustry string, pubDate string", "jobTitle", jobicy),
        Feed("himalayas", "guid string, companySlug string, applicationLink string, url string, title string, companyName string, description string, excerpt string, locationRestrictions array<string>, employmentType string, categories string, pubDate string, publishedDate string", "title", himalayas),
        Feed("arbeitnow", "slug string, url string, title string, company_name string, description string, location string, remote boolean, tags string, created_at string", "title", arbeitnow),
        Feed("workingnomads", "url string, title string, company_name string, description string, location string, tags string, pub_date string", "title", workingnomads),
        Feed("collectivework", "id string, slug string, name string, description string, workPreferences array<string>, isPermanentContract boolean, budgetBrief string, projectTypes array<string>, projectTypeSuggestions array<string>, publishedAt string, company struct<name:string>, location struct<fullNameFrench:string,fullNameEnglish:string>", "name", collectivework),
    )
}


def read_feed(landed: DataFrame, name: str, *extra: str, payload: str = "payload") -> DataFrame:
    """Canonical offers of one source from a column of JSON items. Items that can't be read, or without a title (such
    as a legal notice), yield nothing."""
    feed = FEEDS[name]
    item = F.from_json(payload, feed.schema, {"mode": "PERMISSIVE"})
    rows = landed.select(*extra, item.alias("r")).where(F.coalesce(F.trim(F.col(f"r.{feed.title}")), F.lit("")) != "")
    made = rows.select(*extra, F.lit(name).alias("source"), *[c.alias(k) for k, c in feed.columns().items()])
    tidy = {c: clean_text(F.col(c)) for c in ("title", "company", "location") if c in made.columns}
    return canonical(made.withColumns(tidy), *extra)


def corrupt_rows(landed: DataFrame, name: str, payload: str = "payload") -> DataFrame:
    """Landed items that aren't JSON, for a report; the others go on."""
    return landed.where(F.try_parse_json(payload).isNull())

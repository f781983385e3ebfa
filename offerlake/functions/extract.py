"""Facts from the text of an offer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake import dims
from offerlake.functions.needles import held_in
from offerlake.functions.text import bounded, contains_any, deaccent, folded, marked, normalize_key, once, strip_html, table

# The patterns of a daily rate. An amount has three or four digits, perhaps with a thousands separator,
# and is never cut out of a longer number.
AMOUNT = "(?<!\\d)(\\d{1,2}[ \u00a0\u202f]\\d{3}|\\d{3,4})(?!\\d)"
RATE_WORD = r"(?:tjm|t\.j\.m\.?|tarif\s+journalier|taux\s+journalier|prix\s+journalier|daily\s+rate|tarif\s+/?\s*jour)"
EURO = "(?:\u20ac|eur|euros?)"
PER_DAY = r"(?:ht\s*)?(?:/|par\s+)?\s*(?:j\b|jours?|days?)"
BETWEEN = "\\s*(?:[-\u2013\u2014]|\u00e0\\s|a\\s|et\\s|to\\s|/)\\s*"
FLAGS = "(?iuU)"
RANGES = [f"{FLAGS}{RATE_WORD}[^\\d\\n]{{0,30}}?{AMOUNT}{BETWEEN}{AMOUNT}", f"{FLAGS}{AMOUNT}\\s*{EURO}?\\s*{BETWEEN}{AMOUNT}\\s*{EURO}?\\s*{PER_DAY}"]
SINGLES = [f"{FLAGS}{RATE_WORD}[^\\d\\n]{{0,30}}?{AMOUNT}", f"{FLAGS}{AMOUNT}\\s*{EURO}\\s*{PER_DAY}"]
PAID_BY_DAY = f"{FLAGS}\\d{{3}}\\s*{EURO}?\\s*{PER_DAY}"  # the end of every match of the patterns that start with an amount
PLAUSIBLE = (200, 2500)
# One of these stands in every match of the patterns that start with a rate word, or with an amount.
RATE_HINTS, DAY_HINTS = ("tjm", "t.j.m", "tarif", "taux", "prix", "daily"), ("j", "day")

# Rhythm, durations, markers of an independent's status.
RHYTHM = r"(?iu)\b[1-4]\s*(?:jours?|j)\s*(?:/|par\s+)?\s*(?:semaine|sem\b)?[^.\n]{0,12}(?:sur\s+site|presentiel|au\s+bureau)"
EXPERIENCE = "(?iu)\\d{1,2}\\s*(?:ans?|annees?|years?)\\s*(?:d[e\u2019']\\s*)?(?:experience|exp\\b)"
MONTHS = [r"(?iu)(\d{1,2})\s*(?:\+\s*)?mois", r"(?iu)(\d{1,2})\s*(?:\+\s*)?months?"]
WEEKS, YEARS = r"(?iu)(\d{1,2})\s*semaines?", r"(?iu)(\d)\s*ans?\b"
INDEPENDENT = [
    r"free-?lances?", r"freelancing", r"travailleu(?:r|se)s?\s+ind[ée]pendant", r"consultants?e?s?\s+ind[ée]pendant", r"prestataires?\s+ind[ée]pendant",
    r"statut\s+(?:d'?\s*)?ind[ée]pendant", r"\ben\s+ind[ée]pendant", r"portage\s+salarial", r"soci[ée]t[ée]\s+de\s+portage", r"auto-?entrepreneur",
    r"micro-?entreprise", r"contrat\s+de\s+prestation", r"\bsasu\b", r"\beurl\b",
]
INDEPENDENT_HINTS = ("free", "ind", "portage", "entrep", "presta", "sasu", "eurl")  # one of these stands in every match
PERMANENT_TITLE = FLAGS + r"\bcdi\b|\bcontrat\s+[àa]\s+dur[ée]e\s+ind[ée]termin"


def amount(text: Column) -> Column:
    return F.regexp_replace(text, "[ \u00a0\u202f]", "").cast("int")


def plausible(value: Column) -> Column:
    return value.between(*PLAUSIBLE)


def any_in(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(w) for w in words])


def holding(text: Column, words: Sequence[str]) -> Column:
    """The text if it holds one of the words in any case, else null: patterns are only tried where their words are."""
    return F.when(once(F.lower(text), lambda low: any_in(low, words)), text)


def parse_daily_rate(text: Column) -> Column:
    """struct(low, high): the first plausible range, else the first plausible amount; fields null without one.

    Patterns go in order; within one the matches go in text order, and implausible ones are passed over.
    """

    def pair(low: Column, high: Column) -> Column:
        return F.struct(low.alias("low"), high.alias("high"))

    def read(x: Column) -> Column:
        announced, counted = F.when(any_in(x, RATE_HINTS), x), F.when(any_in(x, DAY_HINTS) & x.rlike("[0-9]{2}") & x.rlike(PAID_BY_DAY), x)
        return once(F.struct(announced.alias("announced"), counted.alias("counted")), tried)

    def tried(x: Column) -> Column:
        tries = []
        for pattern, own in zip(RANGES, (x["announced"], x["counted"]), strict=True):
            other = F.regexp_extract_all(own, F.lit(pattern), F.lit(2))  # only read where the first amounts are
            both = once(F.regexp_extract_all(own, F.lit(pattern), F.lit(1)), lambda ones: F.when(F.size(ones) > 0, F.zip_with(ones, other, lambda a, b: pair(F.least(amount(a), amount(b)), F.greatest(amount(a), amount(b))))))  # noqa: B023
            tries.append(F.get(F.filter(both, lambda r: plausible(r["low"]) & plausible(r["high"])), F.lit(0)))
        for pattern, own in zip(SINGLES, (x["announced"], x["counted"]), strict=True):
            one = F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(1)), lambda a: pair(amount(a), amount(a)))
            tries.append(F.get(F.filter(one, lambda r: plausible(r["low"])), F.lit(0)))
        return F.coalesce(*tries, pair(F.lit(None).cast("int"), F.lit(None).cast("int")))

    return once(F.lower(F.coalesce(text, F.lit(""))), read)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group), F.lit(""))


def rate_mention(text: Column) -> Column:
    """The words that announce a daily rate, or null."""
    return found(text, FLAGS + RATE_WORD)


def parse_contract(key: Column, marks: Column | None = None) -> Column:
    """From a normalised text, by priority of the hint lists; `unknown` without a hint."""
    contract_of = {h: contract for contract, hints in reversed(dims.CONTRACT_HINTS.items()) for h in hints}
    first = contains_any(key, [h for hints in dims.CONTRACT_HINTS.values() for h in hints], marks)
    return F.coalesce(F.try_element_at(F.map_from_arrays(table(list(contract_of)), table(list(contract_of.values()))), first), F.lit("unknown"))


def parse_remote(key: Column, folded_text: Column, marks: Column | None = None) -> Column:
    """full_remote, hybrid, onsite or unknown. A bare word for remote work counts as hybrid."""
    hit = lambda needles: contains_any(key, needles, marks).isNotNull()
    return F.when(hit(dims.FULL_REMOTE), "full_remote").when(hit(dims.HYBRID) | folded_text.rlike(RHYTHM), "hybrid").when(hit(dims.ONSITE), "onsite").when(hit(dims.REMOTE_WORD), "hybrid").otherwise("unknown")


def parse_duration(folded_text: Column) -> Column:
    """Months, from a folded text whose mentions of experience are left out; null without a duration."""

    def read(x: Column) -> Column:
        months = [F.when(x.contains(w), found(x, p, 1).cast("int")) for p, w in zip(MONTHS, ("mois", "month"), strict=True)]
        weeks, years = F.when(x.contains("semaine"), found(x, WEEKS, 1).cast("int")), F.when(x.contains("an"), found(x, YEARS, 1).cast("int"))
        return F.coalesce(*[F.when(m.between(1, 60), m.cast("double")) for m in months], F.round(weeks / F.lit(4.33), 1), F.when(years.between(1, 5), (years * 12).cast("double")))

    x = F.lower(F.coalesce(folded_text, F.lit("")))
    return once(once(x, lambda low: F.when(low.contains("exp"), F.regexp_replace(low, EXPERIENCE, " ")).otherwise(low)), read)


def freelance_marker(text: Column) -> Column:
    """The words that tell an independent's status, else those that announce a daily rate, else null."""
    return F.coalesce(found(holding(text, INDEPENDENT_HINTS), FLAGS + "|".join(INDEPENDENT)), rate_mention(holding(text, RATE_HINTS)))


def detect_signals(title: Column, description: Column) -> Column:
    """struct(freelance, marker, rate_min, rate_max). A permanent contract in the title silences the text."""
    blob = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))
    heard = F.struct(parse_daily_rate(blob).alias("rate"), freelance_marker(blob).alias("words"), F.coalesce(title, F.lit("")).rlike(PERMANENT_TITLE).alias("silent"))

    def told(x: Column) -> Column:
        low, high = x["rate"]["low"], x["rate"]["high"]
        amount = F.concat(F.lit("TJM "), low.cast("string"), F.when(low != high, F.concat(F.lit("-"), high.cast("string"))).otherwise(""), F.lit(" EUR"))
        marker = F.when(~x["silent"], F.coalesce(x["words"], amount))
        return F.struct(marker.isNotNull().alias("freelance"), marker.alias("marker"), F.when(~x["silent"], low).alias("rate_min"), F.when(~x["silent"], high).alias("rate_max"))

    return once(heard, told)


def named(key: Column, names: dict[str, list[str]], marks: Column | None = None) -> Column:
    """The names of which a normalised text holds one of the words, or the name itself, between word boundaries; in the
    order of the list. One pass over the text, however many words there are."""
    forms = [(k, bounded(w)) for k, (name, words) in enumerate(names.items()) for w in dict.fromkeys(map(folded, [name, *words]))]
    return F.transform(held_in(marked(key) if marks is None else marks, forms), lambda k: F.get(table(list(names)), k))


def extract_skills(key: Column) -> Column:
    """Canonical skills that a normalised text names, in taxonomy order. A skill's own name counts as one of its words."""
    return named(key, dims.SKILLS)


def core_skill_count(skills: Column) -> Column:
    return F.size(F.array_intersect(skills, F.array(*map(F.lit, dims.CORE_SKILLS))))


def role_family(title_key: Column, description_key: Column) -> Column:
    """The first family that the title names, else the description, else the generic one."""
    return F.coalesce(*[F.get(named(key, dims.ROLES), F.lit(0)) for key in (title_key, description_key)], F.lit(dims.GENERIC_ROLE))


def urgent_flag(title: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, description))
    return F.reduce(F.array(*[text.contains(w) for w in dims.URGENT]), F.lit(False), lambda a, b: a | b)


def readable(offers: DataFrame) -> DataFrame:
    """The description as text, from the page where there is none."""
    raw = F.coalesce("raw_html", F.lit("")) if "raw_html" in offers.columns else F.lit("")
    description = F.coalesce("description", F.lit(""))
    text = F.when((raw != "") & (description == ""), strip_html(raw)).when(description.contains("<"), strip_html(description)).otherwise(description)
    return offers.withColumn("description", text)


def normalize_offers(offers: DataFrame, contracts: bool = True) -> DataFrame:
    """Fills contract, remote, rates and duration from title, description and location; what a source declared stays.
    Without `contracts` the contract stays as it is, too: all that a score asks for comes without it."""
    out = readable(offers)
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "description", F.lit("\n"), F.coalesce("location", F.lit("")))
    out = out.withColumn("__blob", blob).withColumn("__folded", deaccent(F.col("__blob"))).withColumn("__key", F.lower("__folded")).withColumn("__marks", marked(F.col("__key")))
    no_rate = F.col("daily_rate_min").isNull() & F.col("daily_rate_max").isNull()
    out = out.withColumn("__rate", F.when(no_rate, parse_daily_rate(F.col("__blob"))))
    own = {"contract": F.when(F.col("contract") == "unknown", parse_contract(F.col("__key"), F.col("__marks"))).otherwise(F.col("contract"))} if contracts else {}
    return out.withColumns(own | {
        "remote": F.when(F.col("remote") == "unknown", parse_remote(F.col("__key"), F.col("__folded"), F.col("__marks"))).otherwise(F.col("remote")),
        "daily_rate_min": F.when(no_rate, F.col("__rate.low")).otherwise(F.col("daily_rate_min")),
        "daily_rate_max": F.when(no_rate, F.col("__rate.high")).otherwise(F.col("daily_rate_max")),
        "duration_months": F.coalesce("duration_months", parse_duration(F.col("__folded"))),
        "title": F.trim("title"),
    }).drop("__blob", "__folded", "__key", "__marks", "__rate")


def skills_key() -> Column:
    """The normalised text that the skills of the taxonomy are looked for in, raw tags included."""
    return normalize_key(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.array_join("skills", " ")))


def enrich_offers(offers: DataFrame, contracts: bool = True) -> DataFrame:
    """Skills of the taxonomy instead of raw tags, rates where both are missing, and freelance instead of unknown or
    fixed-term where the text says so, with what said it in freelance_marker. Without `contracts` these two stay."""
    signals = detect_signals(F.col("title"), F.col("description"))
    no_rate = F.col("daily_rate_min").isNull() & F.col("daily_rate_max").isNull()
    if not contracts:
        title = F.coalesce("title", F.lit(""))
        blob = F.concat(title, F.lit("\n"), F.coalesce("description", F.lit("")))
        out = offers.withColumn("__key", skills_key()).withColumn("__rate", F.when(no_rate & ~title.rlike(PERMANENT_TITLE), parse_daily_rate(blob)))
        rates = {f"daily_rate_{at}": F.when(no_rate, F.col(f"__rate.{name}")).otherwise(F.col(f"daily_rate_{at}")) for at, name in (("min", "low"), ("max", "high"))}
        return out.withColumns({"skills": extract_skills(F.col("__key"))} | rates).drop("__key", "__rate")
    out = offers.withColumn("__key", skills_key()).withColumn("__s", F.when(no_rate | F.col("contract").isin("unknown", "cdd"), signals))  # the others stay as they are
    promoted = F.col("__s.freelance") & F.col("contract").isin("unknown", "cdd")
    return out.withColumns({
        "skills": extract_skills(F.col("__key")),
        "daily_rate_min": F.when(no_rate, F.col("__s.rate_min")).otherwise(F.col("daily_rate_min")),
        "daily_rate_max": F.when(no_rate, F.col("__s.rate_max")).otherwise(F.col("daily_rate_max")),
        "freelance_marker": F.when(promoted, F.col("__s.marker")).otherwise(F.col("freelance_marker")),
        "contract": F.when(promoted, "freelance").otherwise(F.col("contract")),
    }).drop("__key", "__s")

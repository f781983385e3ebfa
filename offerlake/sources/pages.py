"""Pages and sitemaps: embedded state, entries, links, fallbacks, and the sources that live in pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake import dims
from offerlake.functions.dates import parse_datetime
from offerlake.functions.extract import parse_daily_rate
from offerlake.functions.text import clean_text, contains_any, normalize_key, strip_html, url_title
from offerlake.schema import FIELDS, canonical
from offerlake.sources.feeds import FEEDS
from offerlake.sources.jsonld import offers_from, page_postings

STATE = r'(?is)id="__NEXT_DATA__"[^>]*>(.*?)</script>'
MISSION_URL = r"/missions-[^/]+/\d+/[^/?#]+$"
OFFER_FIELDS = [name for name, _ in FIELDS]
PARTS = 64  # of a source's keys, ranked apart


def embedded_state(pages: DataFrame, *keys: str, html_col: str = "html") -> DataFrame:
    """One row for each mission of a page's embedded state, as JSON in `payload`; none where the path isn't there."""
    item = T.StructType.fromDDL(FEEDS["collectivework"].schema).simpleString()
    inner = f"struct<results:struct<projects:array<{item}>>>"
    shape = f"props struct<pageProps:struct<dehydratedState:struct<queries:array<struct<state:struct<data:{inner}>>>>>>"
    state = F.from_json(F.regexp_extract(html_col, STATE, 1), shape)
    projects = F.get(state["props"]["pageProps"]["dehydratedState"]["queries"], F.lit(0))["state"]["data"]["results"]["projects"]
    return pages.select(*keys, F.posexplode(projects).alias("pos", "item")).withColumn("payload", F.to_json("item")).drop("item")


def sitemap_entries(maps: DataFrame, *keys: str, xml_col: str = "xml", wanted: str = MISSION_URL) -> DataFrame:
    """url and lastmod (empty if missing) of the entries whose URL has the wanted shape."""
    entry = maps.select(*keys, F.explode(F.regexp_extract_all(xml_col, F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))).alias("entry"))
    out = entry.select(*keys, F.regexp_extract("entry", r"(?i)<loc>\s*([^<\s]+)\s*</loc>", 1).alias("url"), F.regexp_extract("entry", r"(?i)<lastmod>\s*([^<\s]+)\s*</lastmod>", 1).alias("lastmod"))
    return out.where(F.col("url").rlike(wanted))


def slug_prefilter(entries: DataFrame, keywords: Sequence[str], most: int, newest: str = "lastmod") -> DataFrame:
    """Entries whose title in the URL holds a keyword, the newest first, `most` of them: pages to read."""
    return entries.where(contains_any(normalize_key(url_title(F.col("url"))), keywords).isNotNull()).orderBy(F.desc(newest), "url").limit(most)


def page_links(pages: DataFrame, *keys: str, html_col: str = "html", pattern: str = ".", base: str = "") -> DataFrame:
    """Distinct links of a page that match, without their query, absolute."""
    href = F.explode(F.regexp_extract_all(html_col, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1)))
    links = pages.select(*keys, href.alias("href")).withColumn("href", F.regexp_extract("href", r"^[^?#]*", 0)).where(F.col("href").rlike(pattern))
    return links.select(*keys, F.when(F.col("href").startswith("/"), F.concat(F.lit(base), "href")).otherwise(F.col("href")).alias("link")).distinct()


def heading(html: Column) -> Column:
    """The text of the first h1, null without one."""
    return F.when(html.rlike(r"(?i)<h1[\s>]"), clean_text(strip_html(F.regexp_extract(html, r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1>", 1))))


def page_company(html: Column) -> Column:
    """The text of the first element whose class names a company, empty without one."""
    return clean_text(strip_html(F.regexp_extract(html, r"""(?s)<([A-Za-z0-9]+)(?=\s)[^>]*\sclass=["'][^"']*company[^"']*["'][^>]*>(.*?)</\1>""", 2)))


def with_rate_of(offers: DataFrame, text: Column) -> DataFrame:
    """Both bounds of the rate from a text, where the offer states no lower one."""
    out = offers.withColumn("__rate", F.when(F.col("daily_rate_min").isNull(), parse_daily_rate(text)))
    stated = F.col("daily_rate_min").isNotNull()
    return out.withColumns({"daily_rate_max": F.when(stated, F.col("daily_rate_max")).otherwise(F.col("__rate.high")), "daily_rate_min": F.coalesce("daily_rate_min", "__rate.low")}).drop("__rate")


def without_publisher(name: str, blanks: bool = True) -> Column:
    """The company, empty where it is the publisher of the page instead of the client."""
    company = F.lower("company") if blanks else F.replace(F.lower("company"), F.lit(" "), F.lit(""))
    return F.when(F.contains(company, F.lit(name)), "").otherwise(F.col("company"))


def assumed_freelance() -> Column:
    return F.when(F.col("contract") == "unknown", "freelance").otherwise(F.col("contract"))


def first_postings(pages: DataFrame, source: str, *keys: str, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Each page, with the first job posting on it as an offer in `p`, null without one."""
    whole = pages.select(*keys, F.col(url_col).alias("page_url"), F.col(html_col).alias("html"))
    found = offers_from(page_postings(whole, list(keys)), source, *keys, "page_url", "block", "path", url_col="page_url")
    first = found.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in found.columns if c not in keys]), F.struct("block", "path")).alias("p"))
    return whole.join(first, list(keys), "left")


def posted_offers(pages: DataFrame, source: str, *keys: str, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Offers of detail pages by the first posting of each; pages without one, or whose first has no title, have none.
    The rate is read from the whole page where the posting states none."""
    rows = first_postings(pages, source, *keys, html_col=html_col, url_col=url_col).where("p.title <> ''")
    rows = rows.select(*keys, "html", *[F.col(f"p.{c}").alias(c) for c in OFFER_FIELDS])
    return with_rate_of(rows, strip_html(F.col("html"))).drop("html")


def page_fallback(pages: DataFrame, source: str, *keys: str, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Offers of detail pages: the first job posting of the page, else its heading, company and main text. The rate is read
    from the whole page where none is stated, and an unknown contract is freelance. Pages without a title have no offer."""
    rows = first_postings(pages, source, *keys, html_col=html_col, url_col=url_col)
    main = F.regexp_extract("html", r"(?is)<main[^>]*>(.*?)</main>", 1)
    made = {"title": heading(F.col("html")), "company": page_company(F.col("html")), "description": strip_html(F.when(main == "", F.col("html")).otherwise(main)), "url": F.col("page_url"), "contract": F.lit("freelance"), "source": F.lit(source)}
    posted = F.col("p").isNotNull()
    rows = canonical(rows.select(*keys, "html", *[F.when(posted, F.col(f"p.{c}")).otherwise(made.get(c, F.lit(None))).alias(c) for c in OFFER_FIELDS]), *keys, "html")
    return with_rate_of(rows.where("title <> ''").withColumn("contract", assumed_freelance()), strip_html(F.col("html"))).drop("html")


def mindquest(offers: DataFrame, lastmod: str | None = None) -> DataFrame:
    """Offers of a marketplace of freelances: the contract is known, its own name is no client, rates stand in the text,
    and the sitemap's date, if given, says how old an offer is. Untitled ones go."""
    out = with_rate_of(offers.where("title <> ''"), F.col("description")).withColumns({"company": without_publisher("mindquest"), "contract": F.lit("freelance")})
    return out.withColumn("published_at", F.coalesce(parse_datetime(F.col(lastmod)), "published_at")) if lastmod else out


def freelanceinfo(offers: DataFrame, *arrival: str) -> DataFrame:
    """Offers of list pages: of each URL the first titled one by `arrival`; the publisher is no client, rates stand in the
    text, unknown contracts are freelance. The first ones come from a partial aggregation, however often a URL repeats."""
    titled = offers.where("title <> ''")
    first = titled.groupBy("url").agg(F.min_by(F.struct(*titled.columns), F.struct(*arrival)).alias("o")).select("o.*")
    return with_rate_of(first, F.col("description")).withColumns({"company": without_publisher("freelance-informat", blanks=False), "contract": assumed_freelance()})


def cap_per_source(offers: DataFrame, caps: dict[str, int], key: str, order: str) -> DataFrame:
    """Of each source the first row of every native key, and of those the first by `order` up to the source's cap.

    Sources without a cap aren't ranked. Those with one are ranked in parts by key first, where the largest cap is the
    bound, so that at most PARTS times as many rows of a source meet in one task.
    """
    firsts = offers.groupBy("source", key).agg(F.min(order).alias(order))
    capped = F.coalesce(F.col("source").isin(list(caps)), F.lit(False))
    most = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("source")] if caps else F.lit(0)
    place = lambda *by: F.row_number().over(W.partitionBy("source", *by).orderBy(order, key))
    parts = firsts.where(capped).withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS))).withColumn("pos", place("part")).where(F.col("pos") <= max(caps.values(), default=0))
    kept = parts.withColumn("pos", place()).where(F.col("pos") <= most).select("source", key, order).unionByName(firsts.where(~capped))
    same = [F.col(f"o.{x}").eqNullSafe(F.col(f"k.{x}")) for x in ("source", key, order)]
    return offers.alias("o").join(kept.alias("k"), same, "left_semi")


def union_sources(parts: dict[str, DataFrame], wanted: Sequence[str] | None = None) -> DataFrame:
    """The offers of the wanted sources, one under another."""
    names = [n for n in parts if wanted is None or n in wanted]
    out = parts[names[0]]
    for n in names[1:]:
        out = out.unionByName(parts[n], allowMissingColumns=True)
    return out


def snap_bucket(days: Column) -> Column:
    """The next allowed age, upwards; the largest for none, for 0 and beyond it."""
    largest = dims.AGE_BUCKETS[-1]
    out = F.when(days.isNull() | (days <= 0), largest)
    for allowed in dims.AGE_BUCKETS:
        out = out.when(days <= allowed, allowed)
    return out.otherwise(largest)

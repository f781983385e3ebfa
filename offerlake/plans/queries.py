"""Registered queries of the offer library and their SQL for DuckDB. Every query reads the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlake import dims, storage
from offerlake.config import AS_OF, CONFIG, LEVEL_WEIGHTS, PROFILE
from offerlake.fixture import FX, fx, offers
from offerlake.functions import dates, extract, text
from offerlake.functions.text import folded
from offerlake.operators import filters, match, profiles, score, store
from offerlake.plans import run
from offerlake.plans.campaign import campaign, facts, metrics, scores
from offerlake.plans.oracle_parts import AS_OF_SQL, DECIDED, FACTS, PREDICATES, any_of, first_of, identity, key, q, re2, scored, texts
from offerlake.schema import FIELDS, settled
from offerlake.sources import feeds, jsonld, landing, pages
from offerlake.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def on(kind: str, name: str, columns: Callable[[], dict], sql: str, source: Callable[[SparkSession, str], DataFrame] | None = None, keys: tuple[str, ...] = ("seq",)) -> None:
    """A query that adds columns to each row of a source."""
    read = source or {"fx": offers, "facts": lambda s, d: facts(offers(s, d)), "pages": lambda s, d: s.read.parquet(f"{d}/pages.parquet"), "documents": lambda s, d: s.read.parquet(f"{d}/documents.parquet")}[kind]
    query(name, sql)(lambda s, d: read(s, d).select(*keys, *[c.alias(k) for k, c in columns().items()]))


c = F.col


def placed(values: Column, name: str) -> Column:
    """pos (from 1) and the values of an array."""
    return F.transform(values, lambda x, i: F.struct((i + 1).alias("pos"), x.alias(name)))


def listed(values: Column, **fields: Callable[[Column], Column]) -> Column:
    """Structs from the values of an array."""
    return F.transform(values, lambda x: F.struct(*[of(x).alias(name) for name, of in fields.items()]))


def keyed_fx(s: SparkSession, d: str) -> DataFrame:
    """The derived offers with their normalised texts, made once for each row."""
    blob = F.concat_ws("\n", "title", "description", "location")
    keys = {"title_k": text.normalize_key(c("title")), "desc_k": text.normalize_key(c("description")), "both_k": text.normalize_key(F.concat_ws(" ", "title", "description")), "blob_f": text.deaccent(blob)}
    return settled(offers(s, d).withColumns(keys).withColumn("blob_k", F.lower("blob_f")))


FX_SQL = f"WITH {FACTS} "

# ---- text ----
STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '(?i)<li[^>]*>', '- ', 'g'), '<[^>]+>', ' ', 'g')"""
ENTITIES = f"replace(replace(replace(replace(replace(replace({STRIP}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
TIDY = rf"trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace({ENTITIES}, '[ \t\x{{a0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x)), chr(10)), ' ' || chr(10))"
on("pages", "strip_html", lambda: {"text": text.strip_html(c("html"))}, f"SELECT page_id, {TIDY} AS text FROM pages", keys=("page_id",))
on("documents", "clean_text", lambda: {"text": text.clean_text(c("text"))}, r"SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text FROM documents", keys=("doc_id",))
on("documents", "deaccent", lambda: {"text": text.deaccent(c("text"))}, "SELECT doc_id, strip_accents(text) AS text FROM documents", keys=("doc_id",))
on("documents", "normalize_key", lambda: {"k": text.normalize_key(c("text"))}, r"SELECT doc_id, regexp_replace(lower(strip_accents(coalesce(text, ''))), '^\s+|\s+$', '', 'g') AS k FROM documents", keys=("doc_id",))
NEEDLES = ["zzz", "loser", "the", "licence", "license", "de", "und"]
on("documents", "contains_any", lambda: {"hit": text.contains_any(text.normalize_key(c("text")), NEEDLES)}, f"SELECT doc_id, {first_of(key('text'), NEEDLES)} AS hit FROM documents", keys=("doc_id",))
on("fx", "fingerprint", lambda: {"id": text.fingerprint(c("title"), c("company"), c("source")), "cross_key": text.cross_key(c("title"), c("company"))}, FX_SQL + "SELECT seq, id, cross_key FROM a")
on("fx", "slugify", lambda: {"slug": text.slugify(F.concat_ws(" ", "title", "description"))}, FX_SQL + "SELECT seq, coalesce(nullif(trim(substr(trim(regexp_replace(lower(concat(title, ' ', description)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 45), '-'), ''), 'offre') AS slug FROM f")
on("pages", "clean_url", lambda: {"url": text.clean_url(c("url"))}, f"""
SELECT page_id, CASE WHEN url IS NULL THEN '' ELSE concat(regexp_extract(url, '^([^?#]*)', 1), CASE WHEN kept = '' THEN '' ELSE '?' || kept END, regexp_extract(url, '(#.*)$', 1)) END AS url
FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({texts(dims.TRACKING)}, lower(string_split(p, '=')[1]))), '&') AS kept FROM pages)
""", keys=("page_id",))
on("documents", "is_truncated", lambda: {"truncated": text.is_truncated(F.concat(F.coalesce("text", F.lit("")), F.when(c("doc_id") % 3 == 0, "… ").otherwise("")))}, r"SELECT doc_id, doc_id % 3 = 0 OR ends_with(regexp_replace(coalesce(text, ''), '\s+$', ''), '…') AS truncated FROM documents", keys=("doc_id",))
on("fx", "fix_mojibake", lambda: {"text": text.fix_mojibake(F.decode(F.encode("description", "UTF-8"), "ISO-8859-1"))}, FX_SQL + "SELECT seq, description AS text FROM f")
on("pages", "url_title", lambda: {"title": text.url_title(c("url"))}, "SELECT page_id, replace(string_split(rtrim(url, '/'), '/')[-1], '-', ' ') AS title FROM pages", keys=("page_id",))

# ---- dates and numbers ----
on("fx", "parse_datetime", lambda: {"at": dates.parse_datetime(F.when(c("seq") % 4 == 0, "not a date").when(c("seq") % 4 == 1, F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(c("seq") % 4 == 2, F.date_format("published_at", "yyyy-MM-dd")).otherwise(F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss '+0000'")))}, FX_SQL + "SELECT seq, CASE WHEN seq % 4 > 0 THEN published_at END AS at FROM f")
on("fx", "parse_date", lambda: {"day": dates.parse_date(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"))}, FX_SQL + "SELECT seq, published_at::DATE AS day FROM f")
on("fx", "age_days", lambda: {"age": dates.age_days(c("published_at"), AS_OF)}, FX_SQL + "SELECT seq, age::DOUBLE AS age FROM e2")
on("facts", "daily_rate", lambda: {"rate": dates.daily_rate(c("daily_rate_min"), c("daily_rate_max"))}, FX_SQL + "SELECT seq, rate FROM e2")

# ---- facts ----
rate = lambda: extract.parse_daily_rate(c("description"))
on("fx", "parse_daily_rate", lambda: {"low": rate()["low"], "high": rate()["high"]}, FX_SQL + "SELECT seq, lo AS low, hi AS high FROM a")
on("fx", "rate_mention", lambda: {"mention": extract.rate_mention(c("description"))}, FX_SQL + "SELECT seq, CASE WHEN seq % 6 IN (0, 1) THEN 'TJM' END AS mention FROM a")
on("fx", "parse_contract", lambda: {"contract": extract.parse_contract(c("blob_k"))}, FX_SQL + "SELECT seq, contract0 AS contract FROM a", source=keyed_fx)
on("fx", "parse_remote", lambda: {"remote": extract.parse_remote(c("blob_k"), c("blob_f"))}, FX_SQL + "SELECT seq, remote FROM a", source=keyed_fx)
on("fx", "parse_duration", lambda: {"months": extract.parse_duration(text.deaccent(c("description")))}, FX_SQL + "SELECT seq, months FROM a")
on("fx", "freelance_marker", lambda: {"marker": extract.freelance_marker(c("description"))}, FX_SQL + "SELECT seq, CASE WHEN seq % 3 = 0 THEN 'freelance' WHEN seq % 6 IN (0, 1) THEN 'TJM' END AS marker FROM a")
signals = lambda: extract.detect_signals(c("title"), c("description"))
on("fx", "detect_signals", lambda: {"freelance": signals()["freelance"], "marker": signals()["marker"], "rate_min": signals()["rate_min"], "rate_max": signals()["rate_max"]}, FX_SQL + "SELECT seq, marker IS NOT NULL AS freelance, marker, CASE WHEN seq % 11 <> 9 THEN lo END AS rate_min, CASE WHEN seq % 11 <> 9 THEN hi END AS rate_max FROM a")
joined = lambda x: F.array_join(x, ",")
on("fx", "extract_skills", lambda: {"skills": joined(extract.extract_skills(c("both_k")))}, FX_SQL + "SELECT seq, array_to_string(skills, ',') AS skills FROM e", source=keyed_fx)
on("facts", "core_skill_count", lambda: {"core": extract.core_skill_count(c("skills"))}, FX_SQL + "SELECT seq, core::INTEGER AS core FROM e2")
on("fx", "role_family", lambda: {"family": extract.role_family(c("title_k"), c("desc_k"))}, FX_SQL + "SELECT seq, family FROM e", source=keyed_fx)
NORMAL = ("seq", "contract", "remote", "daily_rate_min", "daily_rate_max", "duration_months")
query("normalize_offers", FX_SQL + "SELECT seq, contract0 AS contract, remote, lo AS daily_rate_min, hi AS daily_rate_max, months AS duration_months FROM a")(lambda s, d: extract.normalize_offers(offers(s, d)).select(*NORMAL))
query("enrich_offers", FX_SQL + "SELECT seq, contract, remote, lo AS daily_rate_min, hi AS daily_rate_max, months AS duration_months, freelance_marker, array_to_string(skills, ',') AS skills FROM e")(lambda s, d: facts(offers(s, d)).select(*NORMAL, "freelance_marker", joined("skills").alias("skills")))
on("fx", "urgent_flag", lambda: {"urgent": extract.urgent_flag(c("title"), F.concat("description", F.when(c("seq") % 9 == 0, " Démarrage ASAP").otherwise("")))}, FX_SQL + "SELECT seq, seq % 9 = 0 AS urgent FROM f")

# ---- filters ----
keyed = lambda s, d: filters.with_keys(facts(offers(s, d)))
for name, column, sql in (
    ("match_keywords", lambda: filters.matches_keywords(CONFIG), PREDICATES["keywords"]),
    ("excluded_term", lambda: filters.excluded_term(CONFIG), PREDICATES["excluded"]),
    ("filter_contract", lambda: filters.rejects_contract(CONFIG), PREDICATES["contract"]),
    ("filter_since_last_run", lambda: filters.rejects_cutoff(datetime(2024, 1, 18)), "coalesce(published_at < TIMESTAMP '2024-01-18 00:00:00', false)"),
    ("filter_age", lambda: filters.rejects_age(CONFIG, AS_OF), PREDICATES["age"]),
    ("filter_rate", lambda: filters.rejects_rate(CONFIG), PREDICATES["rate"]),
    ("filter_location_block", lambda: filters.blocked_location(CONFIG), PREDICATES["blocked"]),
    ("filter_location_allow", lambda: filters.rejects_location(CONFIG), PREDICATES["location"]),
    ("filter_remote_only", lambda: filters.rejects_onsite(replace(CONFIG, remote_only=True)), "remote NOT IN ('full_remote', 'hybrid')"),
):
    on("keyed", name, lambda column=column: {"result": column()}, FX_SQL + f"SELECT seq, {sql} AS result FROM e2", source=keyed)
judged = lambda s, d: filters.judged(facts(offers(s, d)), CONFIG, AS_OF)
decided = lambda s, d: filters.decided(judged(s, d).select("seq", "id", "source", "cross_key", "reject_reason"), "seq")
DECIDED_SQL = f"WITH {DECIDED} "
query("reject_reason", DECIDED_SQL + "SELECT seq, reject_reason FROM j")(lambda s, d: judged(s, d).select("seq", "reject_reason"))
query("dedup_cross_source", DECIDED_SQL + "SELECT seq, cross_key, decision FROM d")(lambda s, d: decided(s, d).select("seq", "cross_key", "decision"))
query("rejection_report", DECIDED_SQL + "SELECT CASE WHEN decision = 'duplicate' THEN 'duplicate' ELSE reject_reason END AS reason, count(*) AS n FROM d WHERE decision <> 'kept' GROUP BY 1")(lambda s, d: filters.rejection_report(decided(s, d)))

# ---- scores ----
SCORED_SQL = f"WITH {FACTS} {scored('e2')} "
scored_all = lambda s, d: score.score_offers(facts(offers(s, d)), PROFILE, CONFIG, AS_OF)
on("facts", "skill_overlap", lambda: {"matched": joined(score.skills_signal(PROFILE, c("skills"))[1]), "missing": joined(score.skills_signal(PROFILE, c("skills"))[2])}, SCORED_SQL + "SELECT seq, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing FROM s0")
for name, column, sql in (
    ("score_skills", lambda: score.skills_signal(PROFILE, c("skills"))[0], "s_skills"),
    ("score_rate", lambda: score.rate_signal(PROFILE), "s_rate"),
    ("score_remote", lambda: score.remote_signal(PROFILE), "s_remote"),
    ("score_freshness", lambda: score.freshness_signal(CONFIG, AS_OF), "s_fresh"),
    ("score_duration", lambda: score.duration_signal(PROFILE), "s_months"),
):
    on("facts", name, lambda column=column: {"signal": F.round(column(), 6)}, SCORED_SQL + f"SELECT seq, round({sql}, 6) AS signal FROM s1")
query("score_total", SCORED_SQL + "SELECT seq, round(score_raw, 6) AS score FROM s")(lambda s, d: scored_all(s, d).select("seq", F.round("score_raw", 6).alias("score")))
query("weighted_score", SCORED_SQL + "SELECT seq, round(score_raw, 6) AS mean, round(known / 100.0, 3)::DOUBLE AS covered FROM s")(lambda s, d: scored_all(s, d).select("seq", F.round("score_raw", 6).alias("mean"), c("score_detail.covered_weight").alias("covered")))
query("score_explain", SCORED_SQL + """SELECT seq, array_to_string(matched, ',') AS matched, array_to_string(missing, ',') AS missing,
  array_to_string(list_filter([CASE WHEN s_skills IS NULL THEN 'skills_match' END, CASE WHEN s_rate IS NULL THEN 'daily_rate' END, CASE WHEN s_remote IS NULL THEN 'remote' END, CASE WHEN s_fresh IS NULL THEN 'freshness' END, CASE WHEN s_months IS NULL THEN 'duration' END], lambda x: x IS NOT NULL), ',') AS ignored FROM s""")(
    lambda s, d: scored_all(s, d).select("seq", joined("score_detail.matched_skills").alias("matched"), joined("score_detail.missing_skills").alias("missing"), joined("score_detail.ignored_signals").alias("ignored"))
)
query("score_band", SCORED_SQL + "SELECT seq, CASE WHEN score_raw >= 65 THEN 'high' WHEN score_raw >= 50 THEN 'middle' ELSE 'low' END AS band FROM s")(lambda s, d: scored_all(s, d).select("seq", score.score_band(c("score_raw"), CONFIG.apply_threshold).alias("band")))
query("rank_offers", SCORED_SQL + "SELECT seq, row_number() OVER (ORDER BY round(score_raw, 6) DESC, seq) AS pos FROM s")(lambda s, d: score.ranked(scored_all(s, d).select("seq", F.round("score_raw", 6).alias("score")), F.desc("score"), F.asc("seq")).select("seq", "pos"))
CAMPAIGN_SQL = DECIDED_SQL + ", k AS (SELECT * FROM d WHERE decision = 'kept') " + scored("k")
kept = lambda s, d: campaign(offers(s, d), CONFIG, PROFILE, AS_OF)
query("campaign", CAMPAIGN_SQL + "SELECT seq, id, source, title, company, contract, remote, lo AS daily_rate_min, hi AS daily_rate_max, months AS duration_months, array_to_string(skills, ',') AS skills, round(score_raw, 6) AS score FROM s")(
    lambda s, d: kept(s, d).select("seq", "id", "source", "title", "company", "contract", "remote", "daily_rate_min", "daily_rate_max", "duration_months", joined("skills").alias("skills"), F.round("score_raw", 6).alias("score"))
)
query("top_offers", CAMPAIGN_SQL + "SELECT seq, round(score_raw, 6) AS score FROM s ORDER BY 2 DESC, 1 LIMIT 20")(lambda s, d: kept(s, d).select("seq", F.round("score_raw", 6).alias("score")).orderBy(F.desc("score"), "seq").limit(20))


# ---- store ----
status_of = lambda: F.element_at(F.array(*map(F.lit, dims.STATUSES)), (c("seq") % 8 + 1).cast("int"))
STATUS_SQL = f"({texts(dims.STATUSES)})[seq % 8 + 1]"


def stored(s: SparkSession, d: str) -> DataFrame:
    """A store of derived offers: the even orders, with annotations by remainder."""
    return as_stored(scored_all(s, d))


def as_stored(scored: DataFrame) -> DataFrame:
    return annotated(scored).withColumns({"id": own_id(), "first_seen_at": F.lit(datetime(2024, 1, 1)), "score": F.round("score_raw", 6)})


def annotated(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"status": status_of(), "notes": F.when(c("seq") % 5 == 0, "note").otherwise(""), "starred": c("seq") % 6 == 0, "discarded": c("seq") % 7 == 0})


STORE_SQL = f"""WITH {FACTS} {scored('e2')},
st AS (SELECT * REPLACE (substr(sha1(concat({identity("concat(title, ' ', seq)")}, '|', {identity('company')}, '|', source)), 1, 16) AS id), {STATUS_SQL} AS status, CASE WHEN seq % 5 = 0 THEN 'note' ELSE '' END AS notes,
  seq % 6 = 0 AS starred, seq % 7 = 0 AS discarded, round(score_raw, 6) AS score FROM s) """


def upserted(s: SparkSession, d: str) -> DataFrame:
    own = storage.written(stored(s, d).select("id", "seq", "title", "score", "status", "first_seen_at", "notes", "starred", "discarded"), "both_sides")
    existing = own.where("seq % 4 < 2")
    incoming = own.where("seq % 4 >= 1").withColumn("title", F.upper("title"))
    return store.upsert_offers(existing, incoming, F.lit(AS_OF))


query("upsert_offers", STORE_SQL + f"""SELECT id, seq, CASE WHEN seq % 4 >= 1 THEN upper(title) ELSE title END AS title, score, CASE WHEN seq % 4 < 2 THEN status ELSE 'new' END AS status,
  CASE WHEN seq % 4 < 2 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE {AS_OF_SQL} END AS first_seen_at, CASE WHEN seq % 4 < 2 THEN notes ELSE '' END AS notes, seq % 4 < 2 AND starred AS starred, seq % 4 < 2 AND discarded AS discarded,
  CASE seq % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'updated' ELSE 'new' END AS change FROM st""")(upserted)


def merged_in_two(s: SparkSession, d: str) -> DataFrame:
    """The same two sides as `upsert_offers`, merged one after the other into a store on disk; annotations are made between."""
    scored = scores(offers(s, d), PROFILE, CONFIG, AS_OF, "seq", "company", "source")
    bare = storage.written(as_stored(scored).select("id", "seq", "title", "score"), "both_sides")
    root = storage.place_for(s, "store")
    store.merge_offers(bare.where("seq % 4 < 2"), root, F.lit(datetime(2024, 1, 1)))
    marked = storage.written(annotated(s.read.parquet(root)), "marked")  # what users do to offers meanwhile
    storage.put_partitions(marked, root, storage.BUCKET)
    store.merge_offers(bare.where("seq % 4 >= 1").withColumn("title", F.upper("title")), root, F.lit(AS_OF))
    return s.read.parquet(root).drop(storage.BUCKET)


query("merge_offers", STORE_SQL + f"""SELECT id, seq, CASE WHEN seq % 4 >= 1 THEN upper(title) ELSE title END AS title, score, CASE WHEN seq % 4 < 2 THEN status ELSE 'new' END AS status,
  CASE WHEN seq % 4 < 2 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE {AS_OF_SQL} END AS first_seen_at, CASE WHEN seq % 4 < 2 THEN notes ELSE '' END AS notes, seq % 4 < 2 AND starred AS starred, seq % 4 < 2 AND discarded AS discarded FROM st""")(merged_in_two)


def landed_days(s: SparkSession, d: str) -> DataFrame:
    """Derived offers landed by day and read again from a cutoff that a table gives."""
    root = storage.place_for(s, "landed")
    storage.land(offers(s, d), root, "all")
    cutoffs = offers(s, d).agg((F.max("published_at") - F.expr("INTERVAL 12 DAYS 5 HOURS")).alias("cutoff"))
    return storage.landed_since(s, root, cutoffs).groupBy("day").agg(F.count("*").alias("n"))


query("landed_since", FX_SQL + "SELECT coalesce(strftime(published_at, '%Y-%m-%d'), 'undated') AS day, count(*) AS n FROM f WHERE published_at IS NULL OR published_at::DATE >= (SELECT (max(published_at) - INTERVAL '12' DAY - INTERVAL '5' HOUR)::DATE FROM f) GROUP BY 1")(landed_days)


def two_runs(s: SparkSession, d: str) -> DataFrame:
    """Two runs over a growing folder: what was published until 25 January, then the rest. Their records."""
    landed, root, log = (storage.place_for(s, name) for name in ("landed", "store", "runs"))
    storage.land(offers(s, d).where("published_at < '2024-01-26'"), landed, "january")
    run.run_campaign(s, landed, root, log, "first", CONFIG, PROFILE, datetime(2024, 1, 26))
    storage.land(offers(s, d).where("published_at is null or published_at >= '2024-01-26'"), landed, "later")
    run.run_campaign(s, landed, root, log, "second", CONFIG, PROFILE, AS_OF)
    return run.run_log(s, log).select("run", "started_at", "sources", "fetched", "kept", "new_offers", "updated_offers")


def run_sql(landed: str, as_of: str) -> str:
    return "(WITH " + f"f AS (SELECT * FROM ({FX}) WHERE {landed})".join(part.replace(AS_OF_SQL, as_of) for part in DECIDED.split(f"f AS ({FX})")) + " SELECT id, source, decision FROM d)"


FIRST_RUN = "TIMESTAMP '2024-01-26 00:00:00'"
query("run_campaign", f"""WITH r1 AS {run_sql("published_at < TIMESTAMP '2024-01-26'", FIRST_RUN)}, r2 AS {run_sql("published_at IS NULL OR published_at >= TIMESTAMP '2024-01-24'", AS_OF_SQL)}, known AS (SELECT id FROM r1 WHERE decision = 'kept')
SELECT 'first' AS run, {FIRST_RUN} AS started_at, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS fetched, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'kept') AS new_offers, 0::BIGINT AS updated_offers FROM r1
UNION ALL SELECT 'second', {AS_OF_SQL}, string_agg(DISTINCT source, ',' ORDER BY source), count(*), count(*) FILTER (decision = 'kept'), count(*) FILTER (decision = 'kept' AND id NOT IN (FROM known)), count(*) FILTER (decision = 'kept' AND id IN (FROM known)) FROM r2""")(two_runs)


def offer_events(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.element_at(F.array(*map(F.lit, ["status", "note", "star", "discard"])), (c("event_id") % 4 + 1).cast("int"))
    value = F.when(kind == "status", F.element_at(F.array(*map(F.lit, dims.STATUSES)), (F.floor(c("event_id") / 4) % 8 + 1).cast("int"))).when(kind == "note", c("event_type")).when(kind == "discard", (F.floor(c("event_id") / 4) % 2).cast("string")).otherwise("")
    return e.select(c("user_id").alias("offer_id"), kind.alias("kind"), value.alias("value"), "ts", "event_id")


EVENTS_SQL = f"""WITH ev AS (SELECT user_id AS offer_id, ['status', 'note', 'star', 'discard'][event_id % 4 + 1] AS kind, ts, event_id, event_type, event_id // 4 AS n FROM events),
v AS (SELECT *, CASE kind WHEN 'status' THEN ({texts(dims.STATUSES)})[n % 8 + 1] WHEN 'note' THEN event_type WHEN 'discard' THEN (n % 2)::VARCHAR ELSE '' END AS value FROM ev) """
LAST = "arg_max(value, struct_pack(a := ts, b := event_id)) FILTER (kind = '{k}')"
query("apply_status_events", EVENTS_SQL + f"SELECT offer_id, coalesce({LAST.format(k='status')}, 'new') AS status, min(ts) FILTER (kind = 'status' AND value = 'sent') AS sent_at FROM v GROUP BY 1")(lambda s, d: store.fold_events(offer_events(s, d)).select("offer_id", "status", "sent_at"))
query("fold_annotations", EVENTS_SQL + f"SELECT offer_id, coalesce({LAST.format(k='note')}, '') AS notes, count(*) FILTER (kind = 'star') % 2 = 1 AS starred, coalesce({LAST.format(k='discard')} = '1', false) AS discarded FROM v GROUP BY 1")(lambda s, d: store.fold_events(offer_events(s, d)).select("offer_id", "notes", "starred", "discarded"))


def applied(s: SparkSession, d: str) -> DataFrame:
    """Applications of the offers whose number divides by 3: two versions of each."""
    return applications_of(stored(s, d))


def applications_of(rows: DataFrame) -> DataFrame:
    own = rows.where("seq % 3 = 0")
    return own.select(c("id").alias("offer_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("ord"), "seq").withColumn("status", F.when(c("ord") == 2, "drafted").otherwise("new")).withColumns({"subject": F.when(c("seq") % 2 == 0, "Hello"), "proposed_rate": (c("seq") % 700).cast("int")})


def with_applications(s: SparkSession, d: str) -> DataFrame:
    own = storage.written(stored(s, d).select("id", "seq", "status"), "both_sides")
    return store.save_applications(applications_of(own), own).select("seq", "status")


query("save_application", STORE_SQL + "SELECT seq, CASE WHEN status = 'new' AND seq % 3 = 0 THEN 'drafted' ELSE status END AS status FROM st")(with_applications)
query("application_pipeline", STORE_SQL + "SELECT seq, status, (seq % 700)::INTEGER AS proposed_rate, CASE status WHEN 'interview' THEN 0 WHEN 'replied' THEN 1 WHEN 'sent' THEN 2 WHEN 'drafted' THEN 3 ELSE 4 END AS funnel FROM st WHERE seq % 3 = 0")(
    lambda s, d: store.application_pipeline(stored(s, d).select("id", "seq", "status"), applied(s, d).where("ord = 2").select("offer_id", "proposed_rate")).select("seq", "status", "proposed_rate", "funnel")
)
query("get_application", STORE_SQL + "SELECT id AS offer_id, seq, 'drafted' AS status, CASE WHEN seq % 2 = 0 THEN 'Hello' ELSE '' END AS subject, (seq % 700)::INTEGER AS proposed_rate FROM st WHERE seq % 3 = 0 AND starts_with(id, 'a')")(lambda s, d: store.get_application(applied(s, d).where("ord = 2"), c("offer_id").startswith("a")).select("offer_id", "seq", "status", "subject", "proposed_rate"))
query("list_offers", STORE_SQL + "SELECT id, seq, score FROM st WHERE score >= 40 AND NOT discarded AND status = 'sent' ORDER BY score DESC, published_at DESC NULLS LAST, id LIMIT 50")(lambda s, d: store.list_offers(stored(s, d), 40, status="sent").select("id", "seq", "score"))
query("apply_targets", STORE_SQL + "SELECT id, seq, score FROM st WHERE score >= 40 AND NOT discarded AND status = 'new' ORDER BY score DESC, published_at DESC NULLS LAST, id LIMIT 10")(lambda s, d: store.list_offers(stored(s, d), 40, new_only=True, limit=10).select("id", "seq", "score"))
query("get_offer_prefix", STORE_SQL + "SELECT id, seq FROM st WHERE starts_with(id, 'a') ORDER BY id LIMIT 1")(lambda s, d: store.get_offer(stored(s, d), "a").select("id", "seq"))
query("counts_by_status", STORE_SQL + "SELECT status, count(*) AS n FROM st WHERE NOT discarded GROUP BY 1")(lambda s, d: store.counts_by(annotated(offers(s, d)), "status"))
query("counts_by_source", STORE_SQL + "SELECT source, count(*) AS n FROM st WHERE NOT discarded GROUP BY 1")(lambda s, d: store.counts_by(annotated(offers(s, d)), "source"))
query("report_stats", STORE_SQL + "SELECT count(*) AS total, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'drafted') AS n_drafted, count(*) FILTER (status = 'sent') AS n_sent, (SELECT coalesce(round(avg(score))::BIGINT, 0) FROM st WHERE starred AND NOT discarded) AS avg_score FROM st WHERE NOT discarded")(
    lambda s, d: store.report_stats(stored(s, d), c("starred"))
)
query("field_coverage", FX_SQL + "SELECT source, count(*) AS n, count(rate) AS with_rate, count(*) FILTER (remote <> 'unknown') AS with_remote, count(months) AS with_duration, max(length(description)) AS longest, round(avg((seq % 4 = 1)::INT), 6) AS truncated, median(length(description)) AS median_length FROM e2 GROUP BY 1")(
    lambda s, d: facts(offers(s, d)).groupBy("source").agg(F.count("*").alias("n"), F.count(dates.daily_rate(c("daily_rate_min"), c("daily_rate_max"))).alias("with_rate"), F.count_if(c("remote") != "unknown").alias("with_remote"), F.count("duration_months").alias("with_duration"), F.max(F.length("description")).cast("long").alias("longest"), F.round(F.avg(text.is_truncated(F.concat("description", F.when(c("seq") % 4 == 1, "…").otherwise(""))).cast("int")), 6).alias("truncated"), F.median(F.length("description")).alias("median_length"))
)
query("campaign_metrics", DECIDED_SQL + "SELECT source, count(*) AS fetched, count(*) FILTER (decision = 'kept') AS kept, count(*) FILTER (decision = 'kept' AND seq % 2 = 1) AS new, count(*) FILTER (decision = 'kept' AND seq % 2 = 0) AS updated FROM d GROUP BY 1")(
    lambda s, d: (lambda all_: metrics(all_, all_.where("decision = 'kept' and seq % 2 = 0")))(decided(s, d))
)
def csv_back(rows: DataFrame) -> DataFrame:
    """The rows written as CSV and read again; lists come back as text. The writer quotes empty texts, so they stay apart
    from nulls if the reader is told to take another word for null."""
    path = storage.place_for(rows.sparkSession, "csv")
    storage.export_csv(rows, path)
    shape = ", ".join(f"{name} {'string' if kind.startswith('array') else kind}" for name, kind in rows.dtypes)
    return rows.sparkSession.read.options(**storage.CSV).option("emptyValue", "").option("nullValue", "\u0001").schema(shape).csv(path)


query("export_csv_rows", STORE_SQL + "SELECT id, score, title, company, source, location, remote, contract, lo AS daily_rate_min, hi AS daily_rate_max, months AS duration_months, published_at, status, array_to_string(skills, ', ') AS skills, concat('https://jobs.example.com/', seq) AS url FROM st")(lambda s, d: csv_back(stored(s, d).select("id", "score", "title", "company", "source", "location", "remote", "contract", "daily_rate_min", "daily_rate_max", "duration_months", "published_at", "status", "skills", "url")))
EXPORTED = ("id", *[name for name, _ in FIELDS], "score", "score_detail", "status", "first_seen_at", "notes", "starred", "discarded")


def json_back(rows: DataFrame) -> DataFrame:
    """The rows written as JSON, all their columns, and the lines read again."""
    path = storage.place_for(rows.sparkSession, "json")
    storage.export_json(rows, path)
    return rows.sparkSession.read.text(path).select(F.get_json_object("value", "$.id").alias("id"), c("value").alias("line"))


ISO_SQL = "'%Y-%m-%dT%H:%M:%S.%fZ'"
query("export_json_rows", STORE_SQL + f"""SELECT id, to_json(struct_pack(id := id, source := source, source_id := seq::VARCHAR, url := concat('https://jobs.example.com/', seq), title := title, company := company, description := description, raw_html := '',
  location := location, remote := remote, contract := contract, daily_rate_min := lo, daily_rate_max := hi, freelance_marker := freelance_marker, duration_months := months, skills := skills, published_at := strftime(published_at, {ISO_SQL}), score := score,
  score_detail := struct_pack(skills_match := round(s_skills, 3), daily_rate := round(s_rate, 3), remote := round(s_remote, 3), freshness := round(s_fresh, 3), duration := round(s_months, 3), matched_skills := matched, missing_skills := missing,
    ignored_signals := list_filter([CASE WHEN s_skills IS NULL THEN 'skills_match' END, CASE WHEN s_rate IS NULL THEN 'daily_rate' END, CASE WHEN s_remote IS NULL THEN 'remote' END, CASE WHEN s_fresh IS NULL THEN 'freshness' END, CASE WHEN s_months IS NULL THEN 'duration' END], lambda x: x IS NOT NULL),
    covered_weight := round(known / 100.0, 3)::DOUBLE), status := status, first_seen_at := strftime(TIMESTAMP '2024-01-01 00:00:00', {ISO_SQL}), notes := notes, starred := starred, discarded := discarded))::VARCHAR AS line FROM st""")(lambda s, d: json_back(stored(s, d).select(*EXPORTED)))
query("json_roundtrip", FX_SQL + "SELECT seq, array_to_string(skills, ',') AS skills, published_at FROM e")(
    lambda s, d: facts(offers(s, d)).select("seq", F.from_json(F.to_json(F.struct("skills", "published_at")), "skills array<string>, published_at timestamp").alias("r")).select("seq", joined("r.skills").alias("skills"), "r.published_at")
)
query("schema_evolution", STORE_SQL + "SELECT id, false AS starred, notes, 'none' AS labels FROM st")(lambda s, d: store.with_defaults(stored(s, d).drop("starred"), {"starred": ("boolean", False), "notes": ("string", ""), "labels": ("string", "none")}).select("id", "starred", "notes", "labels"))


def runs(s: SparkSession, d: str) -> DataFrame:
    """A run log: one run for each day of the derived offers."""
    daily = offers(s, d).groupBy(F.to_date("published_at").alias("day")).agg(F.count("*").alias("fetched"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources")).where("day is not null")
    return daily.select(F.datediff("day", F.lit("2023-01-01")).alias("id"), c("day").cast("timestamp").alias("started_at"), "sources", "fetched")


RUNS_SQL = f"WITH {FACTS}, r AS (SELECT published_at::DATE AS day, count(*) AS fetched, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM f WHERE published_at IS NOT NULL GROUP BY 1) "
query("run_log", RUNS_SQL + "SELECT date_diff('day', DATE '2023-01-01', day)::INTEGER AS id, day::TIMESTAMP AS started_at, sources, fetched FROM r")(runs)
query("last_run_at", RUNS_SQL + "SELECT max(day)::TIMESTAMP AS last_run_at FROM r")(lambda s, d: store.last_run_at(runs(s, d)))
query("last_runs", RUNS_SQL + "SELECT date_diff('day', DATE '2023-01-01', day)::INTEGER AS id, fetched FROM r ORDER BY 1 DESC LIMIT 10")(lambda s, d: runs(s, d).select("id", "fetched").orderBy(F.desc("id")).limit(10))


# ---- sources ----
def landed(s: SparkSession, d: str, **fields) -> DataFrame:
    """Derived offers wrapped into payloads; every seventeenth isn't JSON."""
    item = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return fx(s, d).select("seq", F.when(c("seq") % 17 == 0, "{broken").otherwise(item).alias("payload"))


sid, iso = lambda: c("seq").cast("string"), lambda: F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
url = lambda: F.concat(F.lit("https://jobs.example.com/"), c("seq").cast("string"))
tags = lambda: F.array(F.lit("sql"), F.concat(F.lit("t"), c("seq").cast("string")))
WRAPPED: dict[str, tuple[Callable[[], dict], dict[str, str]]] = {
    "adzuna": (
        lambda: {"id": sid(), "title": c("title"), "description": c("description"), "redirect_url": url(), "created": iso(), "contract_type": F.when(c("seq") % 3 == 0, "contract").when(c("seq") % 3 == 1, "permanent"), "company": F.struct(c("company").alias("display_name")), "location": F.struct(c("location").alias("display_name"))},
        {"contract": "CASE seq % 3 WHEN 0 THEN 'freelance' WHEN 1 THEN 'cdi' ELSE 'unknown' END", "remote": "'unknown'", "location": "location", "skills": "''"},
    ),
    "francetravail": (
        lambda: {"id": sid(), "intitule": c("title"), "description": c("description"), "dateCreation": iso(), "typeContrat": F.when(c("seq") % 3 == 0, "LIB").when(c("seq") % 3 == 1, "MIS").otherwise("XXX"), "alternance": c("seq") % 5 == 0, "lieuTravail": F.struct(c("location").alias("libelle")), "entreprise": F.struct(c("company").alias("nom")), "origineOffre": F.struct(url().alias("urlOrigine")), "competences": F.array(F.struct(F.lit("SQL").alias("libelle")))},
        {"contract": "CASE WHEN seq % 5 = 0 THEN 'alternance' WHEN seq % 3 = 0 THEN 'freelance' WHEN seq % 3 = 1 THEN 'cdd' ELSE 'unknown' END", "remote": "'unknown'", "location": "location", "skills": "'SQL'"},
    ),
    "remotive": (
        lambda: {"id": sid(), "url": url(), "title": c("title"), "company_name": c("company"), "description": c("description"), "candidate_required_location": c("location"), "tags": tags(), "job_type": F.when(c("seq") % 2 == 0, "contract").otherwise("full_time"), "publication_date": iso()},
        {"contract": "CASE WHEN seq % 2 = 0 THEN 'freelance' ELSE 'cdi' END", "remote": "'full_remote'", "location": "coalesce(nullif(location, ''), 'Remote')", "skills": "concat('sql,t', seq)"},
    ),
    "remoteok": (
        lambda: {"id": sid(), "url": url(), "position": F.when(c("seq") % 10 > 0, c("title")), "company": c("company"), "description": c("description"), "location": c("location"), "tags": F.concat(F.lit("['sql', 't"), sid(), F.lit("']")), "date": iso()},
        {"contract": "'unknown'", "remote": "'full_remote'", "location": "coalesce(nullif(location, ''), 'Remote')", "skills": "concat('sql,t', seq)", "where": "seq % 10 > 0"},
    ),
    "jobicy": (
        lambda: {"id": sid(), "url": url(), "jobTitle": c("title"), "companyName": c("company"), "jobDescription": c("description"), "jobGeo": c("location"), "jobType": F.when(c("seq") % 2 == 0, F.array(F.lit("Contract"))).otherwise(F.array(F.lit("Full-Time"))), "jobIndustry": tags(), "pubDate": iso()},
        {"contract": "CASE WHEN seq % 2 = 0 THEN 'freelance' ELSE 'unknown' END", "remote": "'full_remote'", "location": "coalesce(nullif(location, ''), 'Remote')", "skills": "concat('sql,t', seq)"},
    ),
    "himalayas": (
        lambda: {"guid": sid(), "applicationLink": url(), "title": c("title"), "companyName": c("company"), "excerpt": c("description"), "locationRestrictions": F.array(F.lit("France"), F.lit("Spain")), "employmentType": F.when(c("seq") % 2 == 0, "Contractor").otherwise("Full Time"), "categories": tags(), "pubDate": iso()},
        {"contract": "CASE WHEN seq % 2 = 0 THEN 'freelance' ELSE 'unknown' END", "remote": "'full_remote'", "location": "'France, Spain'", "skills": "concat('sql,t', seq)"},
    ),
    "arbeitnow": (
        lambda: {"slug": sid(), "url": url(), "title": c("title"), "company_name": c("company"), "description": c("description"), "location": c("location"), "remote": c("seq") % 2 == 0, "tags": tags(), "created_at": iso()},
        {"contract": "'unknown'", "remote": "CASE WHEN seq % 2 = 0 THEN 'full_remote' ELSE 'unknown' END", "location": "location", "skills": "concat('sql,t', seq)"},
    ),
    "workingnomads": (
        lambda: {"url": url(), "title": c("title"), "company_name": c("company"), "description": c("description"), "location": c("location"), "tags": F.concat(F.lit("sql, t"), sid()), "pub_date": iso()},
        {"contract": "'unknown'", "remote": "'full_remote'", "location": "coalesce(nullif(location, ''), 'Remote')", "skills": "concat('sql,t', seq)", "source_id": "right(concat('https://jobs.example.com/', seq), 60)"},
    ),
    "collectivework": (
        lambda: {"id": sid(), "slug": sid(), "name": c("title"), "description": c("description"), "workPreferences": F.when(c("seq") % 3 == 0, F.array(F.lit("ON_SITE"), F.lit("hybrid"))).otherwise(F.array(F.lit("Remote"), F.lit("HYBRID"))), "isPermanentContract": c("seq") % 4 == 0, "budgetBrief": F.when(c("seq") % 2 == 0, F.lit("700")).otherwise("TJM HT max 454 €"), "projectTypes": tags(), "publishedAt": iso(), "company": F.struct(c("company").alias("name")), "location": F.struct(c("location").alias("fullNameFrench"))},
        {"contract": "CASE WHEN seq % 4 = 0 THEN 'cdi' ELSE 'freelance' END", "remote": "CASE WHEN seq % 3 = 0 THEN 'hybrid' ELSE 'full_remote' END", "location": "location", "skills": "concat('sql,t', seq)", "url": "concat('https://www.collective.work/jobs/fr/', seq)", "rate": "CASE WHEN seq % 2 = 0 THEN 700 ELSE 454 END"},
    ),
}
OUT = ("seq", "source", "source_id", "url", "title", "company", "description", "location", "remote", "contract", "daily_rate_min", "published_at")
for name, (fields, want) in WRAPPED.items():
    query(f"src_{name}", FX_SQL + f"""SELECT seq, '{name}' AS source, {want.get('source_id', 'seq::VARCHAR')} AS source_id, {want.get('url', "concat('https://jobs.example.com/', seq)")} AS url, title, company, description, {want['location']} AS location, {want['remote']} AS remote,
      {want['contract']} AS contract, {want.get('rate', 'NULL')}::INTEGER AS daily_rate_min, published_at, {want['skills']} AS skills FROM f WHERE seq % 17 <> 0 AND {want.get('where', 'true')}""")(
        lambda s, d, name=name, fields=fields: feeds.read_feed(landed(s, d, **fields()), name, "seq").select(*OUT, joined("skills").alias("skills"))
    )
query("corrupt_rows", FX_SQL + "SELECT seq, '{broken' AS payload FROM f WHERE seq % 17 = 0")(lambda s, d: feeds.corrupt_rows(landed(s, d, **WRAPPED["adzuna"][0]()), "adzuna"))
on("fx", "parse_tags", lambda: {"tags": joined(feeds.parse_tags(F.when(c("seq") % 3 == 0, F.concat(F.lit('["a", "b'), sid(), F.lit('"]'))).when(c("seq") % 3 == 1, F.concat(F.lit("['a', 'b"), sid(), F.lit("']"))).otherwise(F.concat(F.lit("a , b"), sid()))))}, FX_SQL + "SELECT seq, concat('a,b', seq) AS tags FROM f")
on("fx", "best_remote", lambda: {"remote": feeds.best_remote(F.when(c("seq") % 3 == 0, F.array(F.lit("ON_SITE"), F.lit("hybrid"))).when(c("seq") % 3 == 1, F.array(F.lit("remote"))).otherwise(F.array(F.lit("other"))))}, FX_SQL + "SELECT seq, ['hybrid', 'full_remote', 'unknown'][seq % 3 + 1] AS remote FROM f")
on("fx", "budget_field", lambda: {"low": feeds.budget(F.when(c("seq") % 3 == 0, (c("seq") % 3000).cast("string")).when(c("seq") % 3 == 1, "TJM HT max 454 €").otherwise(""))["low"]}, FX_SQL + "SELECT seq, CASE seq % 3 WHEN 0 THEN CASE WHEN seq % 3000 BETWEEN 100 AND 2500 THEN seq % 3000 END WHEN 1 THEN 454 END::INTEGER AS low FROM f")
on("fx", "snap_bucket", lambda: {"bucket": pages.snap_bucket((c("seq") % 40).cast("int"))}, FX_SQL + "SELECT seq, CASE WHEN seq % 40 = 0 THEN 31 WHEN seq % 40 <= 1 THEN 1 WHEN seq % 40 <= 3 THEN 3 WHEN seq % 40 <= 7 THEN 7 WHEN seq % 40 <= 14 THEN 14 ELSE 31 END AS bucket FROM f")
query("union_sources", FX_SQL + "SELECT source, count(*) AS n FROM f WHERE source IN ('adzuna', 'remoteok') GROUP BY 1")(lambda s, d: pages.union_sources({n: offers(s, d).where(c("source") == n) for n in ("adzuna", "freework", "francetravail", "remoteok")}, ["adzuna", "remoteok"]).groupBy("source").agg(F.count("*").alias("n")))
query("cap_per_source", FX_SQL + "SELECT seq, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM (SELECT source, title, company, min(seq) AS seq FROM f GROUP BY ALL)) WHERE k <= CASE source WHEN 'adzuna' THEN 20 ELSE 35 END")(
    lambda s, d: pages.cap_per_source(offers(s, d).withColumn("native", F.concat_ws("|", "title", "company")), {"adzuna": 20, "freework": 35, "francetravail": 35, "remoteok": 35}, "native", "seq").select("seq", "source")
)


def ld_pages(s: SparkSession, d: str) -> DataFrame:
    """Derived offers as job postings inside pages: plain, within @graph, or in an item list, with a broken block now and then."""
    node = F.to_json(F.struct(F.when(c("seq") % 2 == 0, "JobPosting").otherwise("jobposting").alias("@type"), c("title"), F.regexp_replace("description", "'", "").alias("description"), iso().alias("datePosted"), F.array(F.lit("OTHER"), F.when(c("seq") % 2 == 0, "CONTRACTOR").otherwise("full-time")).alias("employmentType"), F.struct(c("company").alias("name")).alias("hiringOrganization"),
        F.struct(F.struct(c("location").alias("addressLocality"), F.lit("FR").alias("addressCountry")).alias("address")).alias("jobLocation"), F.struct(F.struct((c("seq") % 6000).alias("minValue"), F.lit("DAY").alias("unitText")).alias("value")).alias("baseSalary"), sid().alias("identifier"), url().alias("url")))
    shaped = F.when(c("seq") % 3 == 0, node).when(c("seq") % 3 == 1, F.concat(F.lit('{"@graph":[{"@type":"Thing"},'), node, F.lit(", "), node, F.lit("]}"))).otherwise(F.concat(F.lit('{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":'), node, F.lit("}]}")))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), shaped, F.lit('</script><script type="application/ld+json">{oops</script></html>'))
    return fx(s, d).select("seq", html.alias("html"))


query("jsonld_blocks", FX_SQL + "SELECT seq, 0 AS block FROM f")(lambda s, d: jsonld.ld_blocks(ld_pages(s, d)).select("seq", "block"))
query("jsonld_walk", FX_SQL + "SELECT seq, CASE seq % 3 WHEN 0 THEN 6 WHEN 1 THEN 14 ELSE 8 END::BIGINT AS objects FROM f")(lambda s, d: jsonld.ld_walk(jsonld.ld_blocks(ld_pages(s, d))).groupBy("seq").agg(F.count("*").alias("objects")))
query("jsonld_postings", FX_SQL + "SELECT seq, title FROM f")(lambda s, d: jsonld.page_postings(ld_pages(s, d), ["seq"]).select("seq", jsonld.text_at("$.title").alias("title")))
query("jsonld_offers", FX_SQL + """SELECT seq, seq::VARCHAR AS source_id, title, company, concat(CASE WHEN location = '' THEN '' ELSE location || ', ' END, 'FR') AS location, CASE WHEN seq % 2 = 0 THEN 'freelance' ELSE 'cdi' END AS contract,
  CASE WHEN seq % 6000 BETWEEN 100 AND 5000 THEN seq % 6000 END::INTEGER AS daily_rate_min, published_at FROM f""")(
    lambda s, d: jsonld.offers_from(jsonld.page_postings(ld_pages(s, d), ["seq"]), "page", "seq").select("seq", "source_id", "title", "company", "location", "contract", "daily_rate_min", "published_at")
)
ld_offers = lambda s, d: jsonld.offers_from(jsonld.page_postings(ld_pages(s, d), ["seq"]), "page", "seq")


def market_pages(s: SparkSession, d: str) -> DataFrame:
    """Detail pages. Two in three hold two postings, the first without a title now and then; publishers stand beside
    client names, rates in the salary, in the posting's text or only in the page's; some pages have no heading."""
    publisher = F.when(c("seq") % 8 == 0, "Mindquest SAS").when(c("seq") % 8 == 4, "Freelance - Informatique").otherwise(F.concat(F.lit("Client "), (c("seq") % 50).cast("string")))
    title = F.when(c("seq") % 10 == 3, "").otherwise(F.concat(F.lit("Offre "), sid()))
    words = F.concat(F.lit("Mission data."), F.when(c("seq") % 4 == 1, F.concat(F.lit(" TJM entre 400 et "), (450 + c("seq") % 200).cast("string"), F.lit(" euros"))).otherwise(""))
    salary = F.when(c("seq") % 4 == 2, F.to_json(F.struct(F.struct((300 + c("seq") % 400).alias("minValue"), F.lit("DAY").alias("unitText")).alias("value")))).otherwise("null")
    posting = lambda name, own: F.concat(F.lit('{"@type":"JobPosting","title":"'), name, F.lit('","url":"'), own, F.lit('","description":"'), words, F.lit('","hiringOrganization":{"name":"'), publisher, F.lit('"},"employmentType":"'), F.when(c("seq") % 5 == 0, "FULL_TIME").otherwise("?"), F.lit('","datePosted":"2024-01-02","baseSalary":'), salary, F.lit("}"))
    both = F.concat(F.lit('<script type="application/ld+json">[{"@type":"Organization"},'), posting(title, F.concat(F.lit("https://m.example/"), (c("seq") % 1000).cast("string"))), F.lit(","), posting(F.lit("Autre"), F.lit("https://m.example/autre")), F.lit("]</script>"))
    head = F.when(c("seq") % 7 != 1, F.concat(F.lit("<h1 class='t'>Page <b>"), sid(), F.lit("</b></h1>"))).otherwise("<h2>Rien</h2>")
    body = F.concat(head, F.lit('<div class="job company-name"><a href="/x">'), publisher, F.lit("</a></div><main><p>Corps "), sid(), F.lit("</p>"), F.when(c("seq") % 4 == 3, F.concat(F.lit("<p>"), (500 + c("seq") % 100).cast("string"), F.lit(" EUR HT par jour</p>"))).otherwise(""), F.lit("</main>"))
    html = F.concat(F.lit("<html>"), F.when(c("seq") % 3 > 0, both).otherwise(""), F.lit("<body>"), body, F.lit("</body></html>"))
    return fx(s, d).select("seq", F.concat(F.lit("https://page.example/"), sid()).alias("url"), html.alias("html"))


MARKET_SQL = FX_SQL.rstrip() + """, mp AS (SELECT seq, seq % 3 > 0 AS posted, CASE WHEN seq % 10 = 3 THEN '' ELSE concat('Offre ', seq) END AS title, concat('https://m.example/', seq % 1000) AS url,
  CASE seq % 8 WHEN 0 THEN 'Mindquest SAS' WHEN 4 THEN 'Freelance - Informatique' ELSE concat('Client ', seq % 50) END AS company, CASE WHEN seq % 5 = 0 THEN 'cdi' ELSE 'unknown' END AS contract,
  CASE seq % 4 WHEN 2 THEN 300 + seq % 400 WHEN 1 THEN 400 END::INTEGER AS text_low, CASE seq % 4 WHEN 2 THEN 300 + seq % 400 WHEN 1 THEN 450 + seq % 200 END::INTEGER AS text_high,
  CASE WHEN seq % 4 = 2 THEN 300 + seq % 400 END::INTEGER AS salary, CASE WHEN seq % 4 = 3 THEN 500 + seq % 100 END::INTEGER AS page_rate FROM f) """
market_first = lambda s, d, name: pages.posted_offers(market_pages(s, d), name, "seq")
market_all = lambda s, d, name: jsonld.offers_from(jsonld.page_postings(market_pages(s, d).drop("url"), ["seq"]), name, "seq", "block", "path")
MARKET = ("seq", "title", "company", "contract", "daily_rate_min", "daily_rate_max")
query("src_mindquest", MARKET_SQL + """SELECT seq, title, CASE WHEN contains(lower(company), 'mindquest') THEN '' ELSE company END AS company, 'freelance' AS contract, text_low AS daily_rate_min, text_high AS daily_rate_max,
  CASE WHEN seq % 2 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS published_at FROM (SELECT * FROM mp WHERE title <> '' UNION ALL SELECT * REPLACE ('Autre' AS title) FROM mp) WHERE posted""")(
    lambda s, d: pages.mindquest(market_all(s, d, "mindquest").withColumn("lastmod", F.when(c("seq") % 2 == 0, "2024-01-05").otherwise("")), "lastmod").select(*MARKET, "published_at")
)
query("src_freelanceinfo", MARKET_SQL + """SELECT seq, title, CASE WHEN contains(replace(lower(company), ' ', ''), 'freelance-informat') THEN '' ELSE company END AS company, CASE WHEN contract = 'unknown' THEN 'freelance' ELSE contract END AS contract,
  text_low AS daily_rate_min, text_high AS daily_rate_max FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS k FROM (SELECT * FROM mp WHERE title <> '' UNION ALL SELECT * REPLACE ('Autre' AS title, 'https://m.example/autre' AS url) FROM mp) WHERE posted) WHERE k = 1""")(
    lambda s, d: pages.freelanceinfo(market_all(s, d, "freelanceinfo"), "seq", "block", "path").select(*MARKET)
)
query("src_lesjeudis", MARKET_SQL + "SELECT seq, title, company, contract, coalesce(salary, page_rate) AS daily_rate_min, coalesce(salary, page_rate) AS daily_rate_max FROM mp WHERE posted AND title <> ''")(
    lambda s, d: market_first(s, d, "lesjeudis").select(*MARKET)
)
query("market_fallback", MARKET_SQL + """SELECT seq, CASE WHEN posted THEN title ELSE concat('Page ', seq) END AS title, company, CASE WHEN posted AND contract <> 'unknown' THEN contract ELSE 'freelance' END AS contract,
  coalesce(CASE WHEN posted THEN salary END, page_rate) AS daily_rate_min, coalesce(CASE WHEN posted THEN salary END, page_rate) AS daily_rate_max, CASE WHEN posted THEN url ELSE concat('https://page.example/', seq) END AS url
  FROM mp WHERE CASE WHEN posted THEN title <> '' ELSE seq % 7 <> 1 END""")(lambda s, d: pages.page_fallback(market_pages(s, d), "freework", "seq").select(*MARKET, "url"))


def state_pages(s: SparkSession, d: str) -> DataFrame:
    item = F.to_json(F.struct(sid().alias("id"), c("title").alias("name")))
    state = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"dehydratedState":{"queries":[{"state":{"data":{"results":{"projects":['), item, F.lit("]}}}}]}}}}</script>"))
    return fx(s, d).select("seq", F.when(c("seq") % 5 > 0, state).otherwise("<html></html>").alias("html"))


query("embedded_state", FX_SQL + "SELECT seq, seq::VARCHAR AS source_id, title FROM f WHERE seq % 5 > 0")(lambda s, d: feeds.read_feed(pages.embedded_state(state_pages(s, d), "seq"), "collectivework", "seq").select("seq", "source_id", "title"))
query("sitemap_entries", FX_SQL + "SELECT seq, concat('https://m.example.com/fr/missions-x/', seq, '/data-job') AS url, CASE WHEN seq % 2 = 0 THEN '2024-01-05' ELSE '' END AS lastmod FROM f WHERE seq % 3 > 0")(
    lambda s, d: pages.sitemap_entries(fx(s, d).select("seq", F.concat(F.lit("<urlset><url><loc>https://m.example.com/fr/"), F.when(c("seq") % 3 > 0, "missions-x/").otherwise("list/"), sid(), F.lit("/data-job</loc>"), F.when(c("seq") % 2 == 0, "<lastmod>2024-01-05</lastmod>").otherwise(""), F.lit("</url></urlset>")).alias("xml")), "seq")
)
query("slug_prefilter", f"SELECT page_id, url FROM pages WHERE {any_of(key(chr(114) + 'eplace(string_split(rtrim(url, ' + q('/') + '), ' + q('/') + ')[-1], ' + q('-') + ', ' + q(' ') + ')'), ['html', 'page'])} ORDER BY page_id DESC, url LIMIT 100")(
    lambda s, d: pages.slug_prefilter(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), ["html", "page"], 100, "page_id")
)
query("page_links", r"""SELECT DISTINCT page_id, CASE WHEN starts_with(l, '/') THEN 'https://site.example' || l ELSE l END AS link FROM (SELECT page_id, regexp_extract(unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)), '^[^?#]*') AS l FROM pages) WHERE regexp_matches(l, '^/[a-z]')""")(
    lambda s, d: pages.page_links(s.read.parquet(f"{d}/pages.parquet"), "page_id", pattern="^/[a-z]", base="https://site.example")
)
query("page_fallback", f"SELECT * FROM (SELECT page_id, {TIDY.replace('html,', 'h1,')} AS title, 'freelance' AS contract FROM (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages)) WHERE title <> ''")(
    lambda s, d: pages.page_fallback(s.read.parquet(f"{d}/pages.parquet"), "freework", "page_id").select("page_id", "title", "contract")
)



# ---- landed files ----
def half_broken(s: SparkSession, d: str) -> DataFrame:
    """Landed offers among files that aren't Parquet: rows read of each source, and files that gave none."""
    path = storage.place_for(s, "files")
    rows = offers(s, d).select("seq", "source", "title")
    rows.write.parquet(path)
    s.range(1).select(F.lit("PAR1 cut off").alias("value")).coalesce(1).write.mode("append").text(path)
    read = landing.read_files(s, path, rows.schema).groupBy(c("source").alias("name")).agg(F.count("*").alias("n"))
    lost = landing.quarantined(s, path, rows.schema).where("length > 0").agg(F.lit("(quarantined)").alias("name"), F.count("*").alias("n"))
    return read.unionByName(lost)


query("quarantined_files", FX_SQL + "SELECT source AS name, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT '(quarantined)', 1")(half_broken)


def page_sitemap(s: SparkSession, d: str) -> DataFrame:
    """A sitemap of all pages, with missing dates, other elements and broken entries, read again."""
    path = storage.place_for(s, "sitemap")
    p = s.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    loc = F.replace(c("url"), F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("  <url>\n    <loc> "), loc, F.lit(" </loc>"), F.when(c("page_id") % 3 == 0, "<lastmod>2024-01-05</lastmod>").otherwise(""), F.when(c("page_id") % 7 == 0, "<priority>0.5</url>").otherwise("<changefreq>daily</changefreq></url>"))
    p.select(F.concat(F.lit("<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>"), entry, F.lit("\n</urlset>")).alias("value")).write.text(path)
    return landing.sitemap_files(s, path, r"/(en|fr)/[0-9]+")


query("sitemap_files", "SELECT trim(url) AS url, CASE WHEN page_id % 3 = 0 THEN '2024-01-05' ELSE '' END AS lastmod FROM pages WHERE page_id % 7 <> 0 AND regexp_matches(url, '/(en|fr)/[0-9]+')")(page_sitemap)
CHOSEN_SQL = f"SELECT url FROM pages WHERE {any_of(key(chr(114) + 'eplace(string_split(rtrim(url, ' + q('/') + '), ' + q('/') + ')[-1], ' + q('-') + ', ' + q(' ') + ')'), ['html', 'page'])} ORDER BY page_id DESC, url LIMIT 100"
query("slug_pages", f"SELECT * FROM (SELECT page_id, {TIDY.replace('html,', 'h1,')} AS title, 'freelance' AS contract FROM (SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages WHERE url IN ({CHOSEN_SQL}))) WHERE title <> ''")(
    lambda s, d: pages.page_fallback(landing.chosen_pages(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url"), s.read.parquet(f"{d}/pages.parquet"), ["html", "page"], 100, "page_id"), "freework", "page_id").select("page_id", "title", "contract")
)


def three_versions(s: SparkSession, d: str) -> DataFrame:
    """Three snapshots: a small score and no stars, then stars and a long score, then a fractional rate and no notes."""
    path, rows = storage.place_for(s, "versions"), offers(s, d).select("seq", "title")
    notes, starred = F.concat(F.lit("n"), c("seq").cast("string")), c("seq") % 2 == 0
    rows.where("seq % 3 = 0").withColumns({"score": (c("seq") % 100).cast("int"), "notes": notes, "rate": (c("seq") % 7).cast("int")}).write.parquet(f"{path}/v1")
    rows.where("seq % 3 = 1").withColumns({"score": c("seq") * 1000, "notes": notes, "starred": starred}).write.parquet(f"{path}/v2")
    rows.where("seq % 3 = 2").withColumns({"score": (c("seq") % 50).cast("smallint"), "starred": starred, "rate": c("seq") / 4}).write.parquet(f"{path}/v3")
    return landing.read_versions(s, [f"{path}/v{k}" for k in (1, 2, 3)], {"notes": ("string", ""), "starred": ("boolean", False)})


query("snapshot_versions", FX_SQL + """SELECT seq, title, CASE seq % 3 WHEN 0 THEN seq % 100 WHEN 1 THEN seq * 1000 ELSE seq % 50 END::BIGINT AS score, CASE seq % 3 WHEN 0 THEN (seq % 7)::DOUBLE WHEN 2 THEN seq / 4.0::DOUBLE END::DOUBLE AS rate,
  CASE WHEN seq % 3 < 2 THEN concat('n', seq) ELSE '' END AS notes, seq % 3 > 0 AND seq % 2 = 0 AS starred FROM f""")(three_versions)

# ---- matching ----
for_match = lambda s, d: stored(s, d)
own_id = lambda: text.fingerprint(F.concat_ws(" ", "title", c("seq").cast("string")), c("company"), c("source"))
said = lambda s, d: extract.readable(offers(s, d)).withColumn("title", F.trim("title")).select(own_id().alias("id"), "title", "description", "skills")
related = lambda rows: match.with_relevance(rows.select("cls", "title", "description", "skills", "score_detail"), PROFILE)


def lines(s: SparkSession, d: str, own: Callable[[], Column] | None = None, rows: Callable[[DataFrame], DataFrame] = related) -> DataFrame:
    """id and the fields of the lines that a text has, one row for each offer and line: those in `own`, from `rows` of the
    texts, made once a text; without `own` the rows have them."""
    made = lambda texts: rows(texts) if own is None else rows(texts).select("cls", own().alias("lines"))
    return match.once_a_text(said(s, d), PROFILE, made).select("id", F.inline("lines"))


rel = lambda: c("rel")


def relevance_sql() -> str:
    """CTE rel over st: one row for each offer and competence."""
    parts = []
    for cat_ord, (category, names) in enumerate(PROFILE.competences.items()):
        for rank, name in enumerate(names):
            parts.append(f"SELECT id, seq, {q(category)} AS category, {cat_ord} AS cat_ord, {q(name)} AS competence, {rank} AS rank, {one_score(name, True)} - {rank} * 0.01::DOUBLE AS score FROM m")
    asked = f"list_transform(list_concat(skills, matched), lambda x: {key('x')})"
    return f", m AS (SELECT id, seq, title_key, substr(desc_key, 1, 8000) AS body, {asked} AS asked, family FROM st), rel AS ({' UNION ALL '.join(parts)}) "


def rx_of(pattern: str) -> str:
    return "\\b" + re2(pattern) + "\\b" if len(pattern) <= match.SHORT else re2(pattern)


def one_score(name: str, with_asked: bool) -> str:
    total = ["0::DOUBLE"]
    if with_asked:
        families = [f for f, own in dims.EXPECTED.items() if folded(name) in map(folded, own)]
        total.append(f"CASE WHEN family IN ({', '.join(map(q, families)) or 'NULL'}) THEN 1.2 ELSE 0 END")
    for p in match.patterns_of(name):
        rx = q(rx_of(p))
        total.append(f"CASE WHEN regexp_matches(title_key, {rx}) THEN 5.0 ELSE 0 END")
        total.append(f"(SELECT CASE WHEN n > 0 THEN 1.5 + least(n, 4) * 0.5 ELSE 0 END FROM (SELECT len(regexp_extract_all(body, {rx})) AS n))")
        if with_asked:
            total.append(f"CASE WHEN list_contains(asked, {q(p)}) THEN 3.0 ELSE 0 END")
    return "(" + " + ".join(total) + ")::DOUBLE"


MATCH_SQL = STORE_SQL + relevance_sql()
query("competence_relevance", MATCH_SQL + "SELECT id, category, competence, round(score, 4) AS score FROM rel")(lambda s, d: lines(s, d, lambda: listed(rel(), category=lambda x: x["category"], competence=lambda x: x["competence"], score=lambda x: F.round(x["score"], 4))))
TRANSVERSAL_SQL = STORE_SQL + ", m AS (SELECT id, title_key, substr(desc_key, 1, 8000) AS body FROM st), t AS (" + " UNION ALL ".join(f"SELECT id, {q(t)} AS skill, {i} AS ord, {one_score(t, False)} - {i} * 0.01::DOUBLE AS score FROM m" for i, t in enumerate(PROFILE.transversal)) + ") "
query("transversal_top4", TRANSVERSAL_SQL + "SELECT id, skill, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord)::INTEGER AS pos FROM t) WHERE pos <= 4")(lambda s, d: lines(s, d, lambda: placed(match.transversal_top(), "skill")))
query("rubric_selection", MATCH_SQL + """, p AS (SELECT *, CASE WHEN score > 0 THEN 1 WHEN max(score) OVER (PARTITION BY id, category) > 0 THEN 2 ELSE 3 END AS pass FROM rel),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY pass, score DESC, cat_ord, rank) AS k FROM p)
  SELECT id, competence, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pass, score DESC, cat_ord, rank)::INTEGER AS pos FROM k WHERE k <= 4) WHERE pos <= 12""")(lambda s, d: lines(s, d, lambda: placed(F.transform(match.select_rubrics(rel()), lambda x: x["competence"]), "competence")))
FIXED_SQL = ", ".join(f"({k}, {q(label)}, {texts(own)})" for k, (label, own) in enumerate(PROFILE.fixed))
# The fill of a line is what is left after all lines before it took what they could.
query("rubric_fill", TRANSVERSAL_SQL.rstrip() + MATCH_SQL.removeprefix(STORE_SQL).replace(", m AS (", ", mm AS (", 1).replace(" FROM m ", " FROM mm ").replace(" FROM m)", " FROM mm)") + f""", p AS (SELECT *, CASE WHEN score > 0 THEN 1 WHEN max(score) OVER (PARTITION BY id, category) > 0 THEN 2 ELSE 3 END AS pass FROM rel),
  k AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY pass, score DESC, cat_ord, rank) AS k FROM p),
  ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pass, score DESC, cat_ord, rank) AS spot FROM k WHERE k <= 4) WHERE spot <= 12),
  l0 AS (SELECT id, category, array_agg(competence ORDER BY score DESC, cat_ord, rank) AS own, max(score) AS best, min(cat_ord) AS cat_ord FROM ch GROUP BY 1, 2),
  l1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY best DESC, cat_ord) AS line FROM l0) WHERE line <= 5),
  l2 AS (SELECT id, category, line, list_concat(own, list_filter(every, lambda x: NOT list_contains(own, x))) AS competences, greatest(len(own), least(len(every), 2)) AS size, len(every) AS most
    FROM l1 JOIN (SELECT id, category, array_agg(competence ORDER BY score DESC, cat_ord, rank) AS every FROM rel GROUP BY 1, 2) USING (id, category) WHERE len(every) >= 2),
  l3 AS (SELECT *, greatest(least(most, 4) - size, 0) AS room, 12 - sum(size) OVER (PARTITION BY id) AS free FROM l2),
  l4 AS (SELECT *, greatest(least(room, free - coalesce(sum(room) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS more FROM l3)
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, line)::INTEGER AS line, label, array_to_string(own, ',') AS competences FROM (
    SELECT id, 0 AS part, 0 AS line, {q(match.TRANSVERSAL_LABEL)} AS label, array_agg(skill ORDER BY score DESC, ord)[1:4] AS own FROM t GROUP BY id
    UNION ALL SELECT id, 1, x.k, x.label, x.own FROM st CROSS JOIN (VALUES {FIXED_SQL}) x(k, label, own)
    UNION ALL SELECT id, 2, line, category, competences[1:size + more] FROM l4)""")(
    lambda s, d: lines(s, d, lambda: F.transform(match.compose_rubrics(rel(), PROFILE), lambda x, i: F.struct((i + 1).alias("line"), x["label"].alias("label"), joined(x["competences"]).alias("competences"))))
)


# ---- many profiles ----
INVENTORY = [name for own in PROFILE.competences.values() for name in own]


def customer_profiles(s: SparkSession, d: str) -> DataFrame:
    """A profile for each customer: six skills of three levels, two to five competences of the inventory, by its number."""
    k = c("c_custkey")
    level = lambda j: F.element_at(F.array(*map(F.lit, LEVEL_WEIGHTS.values())), (j % 3 + 1).cast("int"))
    at = lambda names, i: F.element_at(text.table(names), (i % len(names) + 1).cast("int"))
    skills = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.struct(at(list(dims.SKILLS), k * 3 + j * 11).alias("name"), level(j).alias("weight")))
    competences = F.transform(F.sequence(F.lit(0), (k % 4 + 1).cast("int")), lambda j: at(INVENTORY, k * 5 + j * (1 + 2 * (F.floor(k / len(INVENTORY)) % 5))))
    return s.read.parquet(f"{d}/customer.parquet").select(k.alias("profile"), skills.alias("skills"), competences.alias("competences"))


TOP_SQL = "SELECT profile, pos, id, score FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, id)::INTEGER AS pos FROM x WHERE score > 0) WHERE pos <= 10"
query("profiles_by_skills", STORE_SQL.rstrip() + f""", ps AS (SELECT c_custkey AS profile, ({texts(list(dims.SKILLS))})[(c_custkey * 3 + j * 11) % {len(dims.SKILLS)} + 1] AS skill, [{', '.join(str(round(w * 100)) for w in LEVEL_WEIGHTS.values())}][j % 3 + 1] AS weight FROM customer, range(0, 6) r(j)),
  os AS (SELECT id, unnest(skills) AS skill, len(skills) AS n FROM st), x AS (SELECT profile, id, least(sum(weight)::DOUBLE / (any_value(n) * 100), 1.0::DOUBLE) AS score FROM ps JOIN os USING (skill) GROUP BY 1, 2) """ + TOP_SQL)(
    lambda s, d: profiles.best_by_skills(stored(s, d).select("id", "skills"), customer_profiles(s, d))
)
query("profiles_by_competences", MATCH_SQL.rstrip() + f""", pc AS (SELECT c_custkey AS profile, j AS place, ({texts(INVENTORY)})[(c_custkey * 5 + j * (1 + 2 * ((c_custkey // {len(INVENTORY)}) % 5))) % {len(INVENTORY)} + 1] AS competence FROM customer, LATERAL (SELECT unnest(range(0, 2 + c_custkey % 4)) AS j)),
  dm AS (SELECT id, competence, round((score + rank * 0.01) * 100)::BIGINT AS points FROM rel WHERE score + rank * 0.01 > 0.001), x AS (SELECT profile, id, sum(greatest(points - place, 0))::BIGINT AS score FROM pc JOIN dm USING (competence) GROUP BY 1, 2) """ + TOP_SQL)(
    lambda s, d: profiles.best_by_said(said(s, d), PROFILE, customer_profiles(s, d))
)

BULLETS = match.bullet_tools(PROFILE)
BULLET_SQL = MATCH_SQL + ", b(kind, block, block_ord, bullet_ord, variant_ord, text, pinned, optional, tools) AS (VALUES " + ", ".join(f"({q(b[0])}, {q(b[1])}, {b[2]}, {b[3]}, {b[4]}, {q(b[5])}, {b[6]}, {b[7]}, {texts(b[8])})" for b in BULLETS) + """),
  bs AS (SELECT ids.id, b.*, coalesce((SELECT sum(greatest(score, 0)) FROM rel WHERE rel.id = ids.id AND list_contains(b.tools, rel.competence)), 0) AS score FROM (SELECT DISTINCT id FROM st) ids CROSS JOIN b),
  bv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, kind, block, optional, bullet_ord ORDER BY round(score, 6) DESC, variant_ord) AS k FROM bs) WHERE k = 1),
  bo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, kind, block ORDER BY pinned DESC, round(score, 6) DESC, optional, bullet_ord)::INTEGER AS pos FROM bv WHERE NOT optional OR score >= 2.0) WHERE pos <= 6),
  bb AS (SELECT id, kind, block, block_ord, sum(score) AS block_score FROM bo GROUP BY ALL) """
ordered = lambda rows: settled(related(rows).select("cls", match.bullet_order(match.bullet_variants(rel(), PROFILE), PROFILE).alias("blocks")))
shown = lambda x, *names: [x[name].alias(name) for name in names]
query("bullet_variant", BULLET_SQL + "SELECT id, block, bullet_ord, optional, variant_ord, round(score, 4) AS score FROM bv")(lambda s, d: lines(s, d, lambda: F.transform(match.bullet_variants(rel(), PROFILE), lambda x: F.struct(*shown(x, "block", "bullet_ord", "optional", "variant_ord"), F.round(x["score"], 4).alias("score")))))
query("bullet_order", BULLET_SQL + "SELECT id, block, bullet_ord, optional, pos FROM bo")(lambda s, d: lines(s, d, lambda: F.flatten(F.transform("blocks", lambda x: F.transform(x["bullets"], lambda b, i: F.struct(*shown(b, "block", "bullet_ord", "optional"), (i + 1).alias("pos"))))), ordered))
query("block_scores", BULLET_SQL + "SELECT id, block, round(block_score, 4) AS block_score FROM bb")(lambda s, d: lines(s, d, lambda: F.transform("blocks", lambda x: F.struct(x["block"].alias("block"), F.round(x["block_score"], 4).alias("block_score"))), ordered))
query("project_order", BULLET_SQL + "SELECT id, block, row_number() OVER (PARTITION BY id, kind ORDER BY CASE WHEN kind = 'project' THEN -block_score ELSE 0 END, block_ord)::INTEGER AS pos FROM bb")(lambda s, d: lines(s, d, lambda: match.block_order(c("blocks"), PROFILE), ordered))
query("adaptation_summary", BULLET_SQL + "SELECT id, block, array_to_string(tools, ', ') AS tools, optional FROM (SELECT *, row_number() OVER (PARTITION BY id, kind, block ORDER BY pos) AS r FROM bo WHERE score > 0) WHERE r = 1")(lambda s, d: lines(s, d, lambda: F.transform(match.adaptation_summary(c("blocks")), lambda b: F.struct(b["block"].alias("block"), F.array_join(b["tools"], ", ").alias("tools"), b["optional"].alias("optional"))), ordered))
NAMED_SQL = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'regexp_matches(desc_key, {q(rx_of(p))})' for p in match.patterns_of(n))} THEN {q(n)} END" for own in PROFILE.competences.values() for n in own) + "], lambda x: x IS NOT NULL)"
on("fx", "bullet_tools", lambda: {"tools": joined(match.tools_named(c("desc_k"), PROFILE))}, FX_SQL + f"SELECT seq, array_to_string({NAMED_SQL}, ',') AS tools FROM a", source=keyed_fx)
pairs = lambda table: ", ".join(f"({q(a)}, {q(b)}, {k})" for a, own in table.items() for k, b in enumerate(own))
TOPIC_SQL = MATCH_SQL + f""", top AS (SELECT id, pos, competence AS topic, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cat_ord, rank)::INTEGER AS pos FROM rel WHERE score > 0) WHERE pos <= 6),
  adj(topic, implied, ord) AS (VALUES {pairs(dims.ADJACENT)}),
  imp AS (SELECT id, implied AS topic, row_number() OVER (PARTITION BY id ORDER BY pos, ord)::INTEGER AS pos FROM (SELECT id, implied, x.pos AS pos, x.ord AS ord FROM (SELECT t.id, a.implied, min(struct_pack(pos := t.pos, ord := a.ord)) AS x FROM top t JOIN adj a ON a.topic = t.topic GROUP BY 1, 2)) i WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.id = i.id AND top.topic = i.implied)),
  qu(topic, question, ord) AS (VALUES {pairs(dims.QUESTIONS)}),
  gap AS (SELECT id, unnest(missing) AS topic, generate_subscripts(missing, 1)::INTEGER AS pos FROM st),
  plan AS (SELECT id, topic, reason, row_number() OVER (PARTITION BY id ORDER BY k, pos)::INTEGER AS pos FROM (SELECT id, topic, x.k AS k, x.pos AS pos, x.reason AS reason FROM (SELECT id, topic, min(struct_pack(k := k, pos := pos, reason := reason)) AS x
    FROM (SELECT id, topic, 0 AS k, pos, 'gap' AS reason FROM gap UNION ALL SELECT id, topic, 1, pos, 'cited' FROM top UNION ALL SELECT id, topic, 2, pos, 'implied' FROM imp) WHERE list_contains({texts(dims.REVISION_TOPICS)}, topic) GROUP BY 1, 2))),
  refs(ref, client, tool, ord) AS (VALUES {', '.join(f'({k}, {q(r[0])}, {q(t)}, {i})' for k, r in enumerate(PROFILE.references) for i, t in enumerate(r[2]))}),
  ev AS (SELECT id, ref, client, string_agg(tool, ', ' ORDER BY ord) AS tools FROM (SELECT DISTINCT t.id, r.* FROM top t JOIN refs r ON contains(lower(t.topic), lower(r.tool)) OR contains(lower(r.tool), lower(t.topic))) GROUP BY ALL) """
topics = lambda rows: settled(related(rows).select("cls", match.skill_gaps().alias("gaps"), match.key_topics(rel()).alias("topics")))
implied = lambda: match.adjacent_topics(c("topics"))
query("key_topics", TOPIC_SQL + "SELECT id, pos, topic FROM top")(lambda s, d: lines(s, d, lambda: placed(c("topics"), "topic"), topics))
query("adjacent_topics", TOPIC_SQL + "SELECT id, pos, topic FROM imp")(lambda s, d: lines(s, d, lambda: placed(implied(), "topic"), topics))
query("topic_questions", TOPIC_SQL + "SELECT id, t.topic, question FROM top t JOIN qu USING (topic)")(lambda s, d: lines(s, d, lambda: F.transform(match.topic_questions(match.numbered(c("topics"))), lambda x: F.struct(*shown(x, "topic", "question"))), topics))
query("skill_gaps", TOPIC_SQL + "SELECT id, pos, topic FROM gap")(lambda s, d: lines(s, d, lambda: placed(match.skill_gaps(), "topic"), lambda rows: rows))
query("revision_plan", TOPIC_SQL + "SELECT id, pos, topic, reason FROM plan WHERE pos <= 6")(lambda s, d: lines(s, d, lambda: F.transform(match.revision_plan(c("gaps"), c("topics"), implied()), lambda x, i: F.struct((i + 1).alias("pos"), *shown(x, "topic", "reason"))), topics))
query("evidence_refs", TOPIC_SQL + "SELECT id, client, tools FROM ev")(lambda s, d: lines(s, d, lambda: F.transform(match.evidence(c("topics"), PROFILE), lambda x: F.struct(*shown(x, "client", "tools"))), topics))
query("experience_proof", TOPIC_SQL + "SELECT t.id, t.topic, coalesce((SELECT arg_min(client, ref) FROM refs r WHERE contains(lower(t.topic), lower(r.tool)) OR contains(lower(r.tool), lower(t.topic))), 'default') AS proof FROM top t")(lambda s, d: lines(s, d, lambda: F.transform("topics", lambda t: F.struct(t.alias("topic"), match.experience_proof(PROFILE, t).alias("proof"))), topics))
query("interview_pack", TOPIC_SQL + """SELECT id, 'topic' AS section, pos, topic AS item, '' AS reason FROM top UNION ALL SELECT id, 'implied', pos, topic, '' FROM imp
  UNION ALL SELECT id, 'question', (t.pos * 10 + ord)::INTEGER, question, t.topic FROM (SELECT id, pos, topic FROM top UNION ALL SELECT id, pos + 100, topic FROM imp) t JOIN qu USING (topic)
  UNION ALL SELECT id, 'gap_question', pos, topic, '' FROM gap WHERE pos <= 5 UNION ALL SELECT id, 'revision', pos, topic, reason FROM plan WHERE pos <= 6 UNION ALL SELECT id, 'evidence', ref, client, tools FROM ev""")(lambda s, d: lines(s, d, rows=lambda texts: match.interview_lines(related(texts), PROFILE, "cls")))
query("expected_competences", f"WITH {FACTS}, x(family, competence, ord) AS (VALUES {pairs(dims.EXPECTED)}) SELECT seq, competence FROM e JOIN x USING (family)")(
    lambda s, d: keyed_fx(s, d).select("seq", F.explode(match.looked_up(dims.EXPECTED, extract.role_family(c("title_k"), c("desc_k")))).alias("competence"))
)
query("watch_flags", STORE_SQL + "SELECT seq, true AS watch_rate, rate IS NOT NULL AS rate_shown, len(missing) > 0 AS watch_gaps, coalesce(months > 0, false) AS watch_duration, seq % 3 = 0 AS watch_truncated FROM st")(lambda s, d: for_match(s, d).select("seq", *[v.alias(k) for k, v in match.watch_flags(PROFILE, text.is_truncated(F.concat("description", F.when(c("seq") % 3 == 0, "…").otherwise("")))).items()]))
query("proposed_rate", STORE_SQL + "SELECT seq, CASE WHEN rate IS NULL THEN 650 WHEN rate >= 650 THEN rate ELSE greatest(500, least(650, rate)) END AS proposed FROM st")(lambda s, d: for_match(s, d).select("seq", match.proposed_rate(PROFILE).alias("proposed")))
query("availability", FX_SQL + "SELECT seq, CASE WHEN published_at IS NULL THEN 'two_weeks' WHEN seq % 2 = 0 THEN 'now' ELSE strftime(published_at + INTERVAL '60' DAY, '%Y-%m-%d') END AS available FROM f")(
    lambda s, d: offers(s, d).select("seq", match.availability(F.to_date(c("published_at") + F.when(c("seq") % 2 == 0, F.expr("INTERVAL '0' DAY")).otherwise(F.expr("INTERVAL '60' DAY"))), AS_OF).alias("available"))
)
OWNED = texts([x for own in PROFILE.skills.values() for x in own])
HIGH = f"array_to_string(CASE WHEN len(matched) > 0 THEN matched WHEN len(list_filter(skills, lambda x: list_contains({OWNED}, x))) > 0 THEN list_filter(skills, lambda x: list_contains({OWNED}, x)) ELSE {texts(PROFILE.skills['expert'][:3])} END[1:5], ',')"
HIGH = HIGH.replace("CASE WHEN len(matched)", "(CASE WHEN len(matched)").replace("END[1:5]", "END)[1:5]")
query("highlights", STORE_SQL + f"SELECT seq, {HIGH} AS highlights FROM st")(lambda s, d: for_match(s, d).select("seq", joined(match.highlights(PROFILE)).alias("highlights")))
query("draft_applications", STORE_SQL + f"SELECT id AS offer_id, 'drafted' AS status, {HIGH} AS highlights, array_to_string(missing[1:5], ',') AS gaps, CASE WHEN rate IS NULL THEN 650 WHEN rate >= 650 THEN rate ELSE greatest(500, least(650, rate)) END AS proposed_rate FROM st WHERE score >= 65 AND status = 'new'")(
    lambda s, d: for_match(s, d).where((c("score") >= CONFIG.apply_threshold) & (c("status") == "new")).select(c("id").alias("offer_id"), F.lit("drafted").alias("status"), joined(match.highlights(PROFILE)).alias("highlights"), joined(F.slice("score_detail.missing_skills", 1, 5)).alias("gaps"), match.proposed_rate(PROFILE).alias("proposed_rate"))
)
LEVELS = score.profile_skills(PROFILE)
query("profile_skills", FX_SQL + ", p(skill, level, ord) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {k})" for a, b, k in LEVELS) + ") SELECT p.skill, level, ord, count(e.seq) AS offers FROM p LEFT JOIN (SELECT seq, unnest(skills) AS skill FROM e) e USING (skill) GROUP BY ALL")(
    lambda s, d: s.createDataFrame(LEVELS, "skill string, level string, ord int").join(facts(offers(s, d)).select("seq", F.explode("skills").alias("skill")), "skill", "left").groupBy("skill", "level", "ord").agg(F.count("seq").alias("offers"))
)


# ---- streams ----
LANDINGS = 5


def in_landings(s: SparkSession, rows: DataFrame, landing: Column, flow: Callable[[DataFrame, str], StreamingQuery]) -> None:
    """Lands rows in LANDINGS steps; after each, the stream reads what is new, from the state it left."""
    place = storage.place_for(s, "stream")
    rows = storage.written(rows.withColumn("landing", landing.cast("int")), "landing")
    for k in range(LANDINGS):
        rows.where(c("landing") == k).write.mode("append").parquet(f"{place}/landed")
        flow(s.readStream.schema(rows.schema).parquet(f"{place}/landed"), f"{place}/state").awaitTermination()


def stream_campaign(s: SparkSession, d: str) -> DataFrame:
    """The campaign over a file stream of the derived offers, landed out of order: what the table holds at its end equals
    the batch's."""
    root = storage.place_for(s, "firsts")
    flow = lambda rows, state: stream.merge_firsts(stream.passing(rows, CONFIG, PROFILE, AS_OF).select("seq", "cross_key", F.round("score_raw", 6).alias("score")), root, state)
    in_landings(s, offers(s, d), LANDINGS - 1 - F.pmod("seq", F.lit(LANDINGS)), flow)
    return s.read.parquet(root).select("seq", "score")


query("stream_campaign", CAMPAIGN_SQL + "SELECT seq, round(score_raw, 6) AS score FROM s")(stream_campaign)


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """Offers with a keyword, a landing for each nine days of publication, some of them one or two landings late: what
    passes the stream is its whole output."""
    out = storage.place_for(s, "passed")
    steps = F.floor(c("seq") % 45 / 9)
    landing = F.least(LANDINGS - 1 - F.when(c("published_at").isNull(), c("seq") % 5).otherwise(steps) + F.when(c("seq") % 20 == 7, 1).when(c("seq") % 20 == 13, 2).otherwise(0), F.lit(LANDINGS - 1))
    rows = facts(offers(s, d)).select("seq", "title", "company", "description", "location", "skills", "published_at")

    def flow(landed: DataFrame, state: str) -> StreamingQuery:
        known = filters.with_keys(landed).where(filters.matches_keywords(CONFIG)).withColumn("landed_at", F.lit(AS_OF) - F.make_dt_interval((LANDINGS - 1 - c("landing")) * 9))
        return stream.merge_stream(stream.without_late_repeats(known, "landed_at"), out, state)

    in_landings(s, rows, landing, flow)
    return s.read.schema("seq long, cross_key string").parquet(out).select("seq", "cross_key")


def stream_sql() -> str:
    """The stream's rule landing by landing: late rows go, a key's first row passes unless its state holds."""
    parts = [f"""src AS (SELECT seq, cross_key, least({LANDINGS - 1} - CASE WHEN published_at IS NULL THEN seq % 5 ELSE (seq % 45) // 9 END + CASE seq % 20 WHEN 7 THEN 1 WHEN 13 THEN 2 ELSE 0 END, {LANDINGS - 1}) AS b, published_at FROM e2 WHERE {PREDICATES['keywords']}),
  ev AS (SELECT *, coalesce(published_at, {AS_OF_SQL} - to_days((9 * ({LANDINGS - 1} - b))::INTEGER)) AS ev FROM src), s0 AS (SELECT '' AS cross_key, TIMESTAMP '2000-01-01' AS until WHERE false)"""]
    for b in range(LANDINGS):
        parts.append(f"w{b} AS (SELECT coalesce((SELECT max(ev) FROM ev WHERE b < {b}) - INTERVAL '2' DAY, TIMESTAMP '1970-01-01') AS mark)")
        parts.append(f"c{b} AS (SELECT cross_key, min(seq) AS seq, arg_min(ev, seq) AS ev FROM ev, w{b} WHERE b = {b} AND ev > mark GROUP BY cross_key)")
        parts.append(f"p{b} AS (SELECT c.* FROM c{b} c LEFT JOIN s{b} s USING (cross_key), w{b} WHERE s.until IS NULL OR s.until < mark)")
        parts.append(f"s{b + 1} AS (SELECT cross_key, ev + INTERVAL '2' DAY AS until FROM p{b} UNION ALL SELECT * FROM s{b} WHERE cross_key NOT IN (SELECT cross_key FROM p{b}))")
    return FX_SQL.rstrip() + ", " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT seq, cross_key FROM p{b}" for b in range(LANDINGS))


query("stream_dedup", stream_sql())(stream_dedup)

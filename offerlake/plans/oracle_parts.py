"""Pieces of DuckDB SQL for the oracles: the derived offers with facts by arithmetic, decisions and scores."""

from __future__ import annotations

from collections.abc import Sequence

from offerlake import dims
from offerlake.config import AS_OF, CONFIG, LEVEL_WEIGHTS, PROFILE, UNWEIGHTED
from offerlake.fixture import FX
from offerlake.functions.text import folded


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def texts(values: Sequence[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]::VARCHAR[]"


def re2(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


def has(key: str, needle: str, bounded_up_to: int = 3) -> str:
    n = folded(needle)
    return f"regexp_matches({key}, {q(chr(92) + 'b' + re2(n) + chr(92) + 'b')})" if len(n) <= bounded_up_to else f"contains({key}, {q(n)})"


def first_of(key: str, needles: Sequence[str]) -> str:
    return "CASE " + " ".join(f"WHEN {has(key, n)} THEN {q(n)}" for n in needles) + " END" if needles else "NULL::VARCHAR"


def any_of(key: str, needles: Sequence[str]) -> str:
    return "(" + " OR ".join(has(key, n) for n in needles) + ")"


def word(key: str, name: str) -> str:
    n = folded(name)
    edge = lambda c: "\\b" if c.isalnum() else ""
    return f"regexp_matches({key}, {q(edge(n[0]) + re2(n) + edge(n[-1]))})"


def skills_in(key: str) -> str:
    parts = [f"CASE WHEN {' OR '.join(word(key, n) for n in [name, *words])} THEN {q(name)} END" for name, words in dims.SKILLS.items()]
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def family_in(key: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(word(key, n) for n in [f, *words])} THEN {q(f)}" for f, words in dims.ROLES.items()) + " END"


def key(text: str) -> str:
    return f"trim(lower(strip_accents({text})))"


def identity(text: str) -> str:
    return f"regexp_replace(lower({text}), '[^a-z0-9]+', '', 'g')"


AS_OF_SQL = f"TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}'"

# Facts follow from the order's numbers, so the patterns that Spark reads them with are checked by other means.
FACTS = f"""
f AS ({FX}),
a AS (SELECT *,
  CASE seq % 6 WHEN 0 THEN (SELECT CASE WHEN v BETWEEN 200 AND 2500 THEN v END FROM (SELECT price % 3000 AS v))
    WHEN 1 THEN least(400 + seq % 300, 450 + cust % 300) WHEN 2 THEN 300 + seq % 500 END::INTEGER AS lo,
  CASE seq % 6 WHEN 0 THEN (SELECT CASE WHEN v BETWEEN 200 AND 2500 THEN v END FROM (SELECT price % 3000 AS v))
    WHEN 1 THEN greatest(400 + seq % 300, 450 + cust % 300) WHEN 2 THEN 300 + seq % 500 END::INTEGER AS hi,
  CASE cust % 5 WHEN 0 THEN (1 + cust % 18)::DOUBLE WHEN 1 THEN 1.8 WHEN 3 THEN 24.0 END AS months,
  CASE seq % 5 WHEN 0 THEN 'full_remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' WHEN 3 THEN 'hybrid' ELSE CASE WHEN cust % 7 IN (2, 3) THEN 'hybrid' ELSE 'unknown' END END AS remote,
  CASE WHEN seq % 11 = 5 THEN 'stage' WHEN seq % 3 = 0 OR cust % 5 = 1 THEN 'freelance' WHEN seq % 3 = 1 THEN 'cdd' WHEN seq % 11 = 9 THEN 'cdi' ELSE 'unknown' END AS contract0,
  CASE WHEN seq % 11 <> 9 THEN CASE WHEN seq % 3 = 0 THEN 'freelance' WHEN seq % 6 IN (0, 1) THEN 'TJM' WHEN seq % 6 = 2 THEN concat('TJM ', 300 + seq % 500, ' EUR') END END AS marker,
  {key('title')} AS title_key, {key('description')} AS desc_key, {key('substr(description, 1, 1500)')} AS head_key, {key('location')} AS loc_key,
  substr(sha1(concat({identity('title')}, '|', {identity('company')}, '|', source)), 1, 16) AS id,
  substr(sha1(concat({identity('title')}, '|', {identity('company')})), 1, 16) AS cross_key
  FROM (SELECT f.*, CAST(floor(o.o_totalprice) AS BIGINT) AS price FROM f JOIN orders o ON o.o_orderkey = f.seq)),
e AS (SELECT *, CASE WHEN marker IS NOT NULL AND contract0 IN ('unknown', 'cdd') THEN 'freelance' ELSE contract0 END AS contract,
  CASE WHEN marker IS NOT NULL AND contract0 IN ('unknown', 'cdd') THEN marker END AS freelance_marker,
  {skills_in("concat(title_key, ' ', desc_key)")} AS skills,
  coalesce({family_in('title_key')}, {family_in('desc_key')}, '{dims.GENERIC_ROLE}') AS family,
  epoch_us({AS_OF_SQL}::TIMESTAMP) AS now_us FROM a),
e2 AS (SELECT *, (now_us - epoch_us(published_at)) / 86400000000.0 AS age, coalesce(nullif(hi, 0), nullif(lo, 0)) AS rate,
  len(list_filter(skills, lambda s: list_contains({texts(dims.CORE_SKILLS)}, s))) AS core FROM e)
"""

CUTOFF = "TIMESTAMP '2024-01-18 00:00:00'"
PREDICATES = {
    "keywords": f"({any_of('title_key', CONFIG.keywords_any)} OR (core >= {CONFIG.min_core_skills} AND {any_of('desc_key', CONFIG.keywords_any)}))",
    "excluded": f"coalesce({first_of('title_key', CONFIG.exclude_any)}, {first_of('head_key', dims.DESCRIPTION_EXCLUDES)})",
    "contract": "(contract <> 'unknown' AND contract <> 'freelance')",
    "age": f"coalesce(age > {CONFIG.max_age_days}, false)",
    "rate": f"coalesce(rate < {CONFIG.min_daily_rate}, false)",
    "blocked": first_of("loc_key", CONFIG.locations_exclude),
    "location": f"(NOT {any_of('loc_key', CONFIG.locations)})",
}
DECIDED = (
    FACTS
    + f""",
j AS (SELECT *, coalesce(CASE WHEN NOT {PREDICATES['keywords']} THEN 'off_keywords' END, 'excluded_term:' || {PREDICATES['excluded']},
  CASE WHEN {PREDICATES['contract']} THEN 'contract:' || contract END, CASE WHEN {PREDICATES['age']} THEN 'too_old' END,
  CASE WHEN {PREDICATES['rate']} THEN 'rate_low' END, 'location_blocked:' || {PREDICATES['blocked']}, CASE WHEN {PREDICATES['location']} THEN 'location' END) AS reject_reason FROM e2),
d0 AS (SELECT *, min(CASE WHEN reject_reason IS NULL THEN seq END) OVER (PARTITION BY cross_key) AS first_kept FROM j),
d AS (SELECT *, CASE WHEN seq = first_kept THEN 'kept' WHEN seq > first_kept THEN 'duplicate' ELSE 'rejected' END AS decision FROM d0)
"""
)

WEIGHTS = {folded(s): LEVEL_WEIGHTS[level] for level in reversed(list(LEVEL_WEIGHTS)) for s in PROFILE.skills.get(level, [])}


def scored(of: str) -> str:
    """CTEs s0 to s over the rows of a CTE: signals, score and explanation."""
    own = texts(list(WEIGHTS))
    weight = "CASE " + " ".join(f"WHEN {key('x')} = {q(n)} THEN {w}" for n, w in WEIGHTS.items()) + f" ELSE {UNWEIGHTED} END"
    target, floor = PROFILE.rate_target, PROFILE.rate_floor
    return f""",
s0 AS (SELECT *, list_filter(skills, lambda x: list_contains({own}, {key('x')})) AS matched, list_filter(skills, lambda x: NOT list_contains({own}, {key('x')})) AS missing FROM {of}),
s1 AS (SELECT *,
  CASE WHEN len(skills) > 0 THEN least(1.0, coalesce(list_sum(list_transform(matched, lambda x: {weight})), 0) / len(skills))::DOUBLE END AS s_skills,
  CASE WHEN rate >= {target} THEN 1.0 WHEN rate < {floor} THEN 0.0 WHEN rate IS NOT NULL THEN (rate - {floor}) / {float(target - floor)}::DOUBLE END::DOUBLE AS s_rate,
  CASE remote WHEN 'full_remote' THEN 1.0 WHEN 'hybrid' THEN 0.9 WHEN 'onsite' THEN 0.3 END::DOUBLE AS s_remote,
  CASE WHEN age <= 1 THEN 1.0 WHEN age IS NOT NULL THEN greatest(0.0, 1 - age / {CONFIG.max_age_days}) END::DOUBLE AS s_fresh,
  CASE WHEN months / 6 > 2.5 THEN 0.85 WHEN months / 6 >= 1 THEN 1.0 WHEN months > 0 THEN greatest(0.2, months / 6) END::DOUBLE AS s_months FROM s0),
s2 AS (SELECT *, 45 * (s_skills IS NOT NULL)::INT + 20 * (s_rate IS NOT NULL)::INT + 15 * (s_remote IS NOT NULL)::INT + 10 * (s_fresh IS NOT NULL)::INT + 10 * (s_months IS NOT NULL)::INT AS known,
  45 * coalesce(s_skills, 0) + 20 * coalesce(s_rate, 0) + 15 * coalesce(s_remote, 0) + 10 * coalesce(s_fresh, 0) + 10 * coalesce(s_months, 0) AS total FROM s1),
s AS (SELECT *, CASE WHEN s_skills IS NULL THEN least(50.0, m) ELSE m END AS score_raw FROM (SELECT *, CASE WHEN known > 0 THEN total / known * 100 ELSE 0 END AS m FROM s2))
"""

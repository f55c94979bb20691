"""DuckDB equivalents of the registered queries, composed from common table expressions."""

from __future__ import annotations

from goldlink.functions import dictionaries as d
from goldlink.plans.candidates import CANDIDATE_SQL


def _case(column: str, table: dict[str, str]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + " END"


STRIP = lambda c: f"trim({c}, chr(32) || chr(9) || chr(10) || chr(13))"
DIGITS = lambda c: f"regexp_replace({c}, '[^0-9]', '', 'g')"

PHONE = (
    f"CASE WHEN phone LIKE '+44%' AND length({DIGITS('phone')}) BETWEEN 9 AND 12 THEN '+' || {DIGITS('phone')} "
    f"WHEN phone NOT LIKE '+%' AND length({DIGITS('phone')}) IN (7, 10) THEN '+1' || {DIGITS('phone')} END"
)


def date_sql(c: str) -> str:
    months = _case(f"lower(regexp_extract({c}, '{d.MONTH_YEAR}', 1))", d.MONTHS)
    present = ", ".join(f"'{x}'" for x in d.PRESENT)
    return f"""CASE WHEN lower({c}) IN ({present}) THEN 'Present'
      WHEN regexp_matches({c}, '{d.MONTH_YEAR}') THEN regexp_extract({c}, '{d.MONTH_YEAR}', 2) || '-' || {months}
      WHEN TRY_CAST(regexp_extract({c}, '{d.NUMERIC_MONTH_YEAR}', 1) AS INT) BETWEEN 1 AND 12 THEN regexp_extract({c}, '{d.NUMERIC_MONTH_YEAR}', 2) || '-' || lpad(regexp_extract({c}, '{d.NUMERIC_MONTH_YEAR}', 1), 2, '0')
      WHEN TRY_CAST(regexp_extract({c}, '{d.ISO_DATE}', 2) AS INT) BETWEEN 1 AND 12 THEN regexp_extract({c}, '{d.ISO_DATE}', 1) || '-' || regexp_extract({c}, '{d.ISO_DATE}', 2)
      WHEN regexp_matches({c}, '^[0-9]{{4}}$') THEN {c} END"""


#: city, region, code of a location of one part without a known last word, or of two parts.
def location_sql(c: str) -> str:
    parts = f"string_split({c}, ',')"
    first, last = f"trim({parts}[1])", f"trim({parts}[-1])"
    word, head = f"regexp_extract({c}, '^(.*\\S)\\s+(\\S+)$', 2)", f"regexp_extract({c}, '^(.*\\S)\\s+(\\S+)$', 1)"
    names = {v.lower(): k.upper() for k, v in d.US_STATES.items()}
    country = lambda x: _case(f"lower({x})", d.COUNTRIES)
    return f"""CASE WHEN {c} IS NULL THEN NULL
      WHEN len({parts}) = 1 THEN CASE WHEN {country(word)} IS NOT NULL THEN {head} || ', ' || {country(word)} WHEN {country(c)} IS NOT NULL THEN {country(c)}
        WHEN {_case(f"lower({c})", d.CITIES)} IS NOT NULL THEN {c} || ', ' || {_case(f"lower({c})", d.CITIES)} ELSE {c} END
      WHEN {country(last)} IS NOT NULL THEN {first} || ', ' || {country(last)}
      WHEN {_case(f"lower({last})", d.US_STATES)} IS NOT NULL THEN {first} || ', ' || upper({last}) || ', US'
      WHEN {_case(f"lower({last})", names)} IS NOT NULL THEN {first} || ', ' || {_case(f"lower({last})", names)} || ', US'
      WHEN {_case(f"lower({first})", d.CITIES)} IS NOT NULL THEN {first} || ', ' || {last} || ', ' || {_case(f"lower({first})", d.CITIES)}
      ELSE {c} END"""


def title_sql(c: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({c}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '')"


def skill_sql(c: str) -> str:
    return f"CASE WHEN {STRIP(c)} = '' THEN NULL ELSE coalesce({_case(f'lower({STRIP(c)})', d.SKILLS)}, {title_sql(STRIP(c))}) END"


WEIGHT = lambda default: f"CASE source_type WHEN 'csv' THEN 0.8::DOUBLE WHEN 'ats_json' THEN 0.9::DOUBLE WHEN 'resume_pdf' THEN 0.7::DOUBLE WHEN 'recruiter_notes' THEN 0.5::DOUBLE ELSE {default}::DOUBLE END"

FLAT = f"""
c AS ({CANDIDATE_SQL}),
n AS (SELECT record_id, source_type, source_path, {STRIP('name')} AS full_name, lower({STRIP('email')}) AS email, {PHONE} AS phone, {location_sql('location')} AS location,
  {skill_sql('skill_a')} AS skill_a, {skill_sql('skill_b')} AS skill_b, company AS current_company, title AS current_title,
  company, title, {date_sql('start_date')} AS start_date, {date_sql('end_date')} AS end_date, institution, degree, link,
  {WEIGHT('0.0')} AS w, {WEIGHT('0.5')} AS wc FROM c)"""

KEYS = """
k AS (SELECT DISTINCT record_id, key_type, key FROM (SELECT record_id, 'email' AS key_type, email AS key FROM n UNION ALL SELECT record_id, 'phone', phone FROM n) WHERE key <> ''),
hubs AS (SELECT key_type, key, min(record_id) AS hub FROM k GROUP BY ALL HAVING count(*) > 1),
edges AS (SELECT DISTINCT record_id AS src, hub AS dst FROM k JOIN hubs USING (key_type, key) WHERE record_id <> hub)"""

CLUSTERS = """
links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT record_id AS a, record_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
cl AS (SELECT a AS record_id, min(b) AS cluster_id FROM reach GROUP BY a),
m AS (SELECT cl.cluster_id, n.* FROM n JOIN cl USING (record_id))"""


def scalar_cte(field: str) -> str:
    return f"""
s_{field} AS (SELECT cluster_id, count(*) AS cnt, count(DISTINCT lower(trim({field}))) AS forms,
  (array_agg({field} ORDER BY w DESC, record_id))[1] AS v1, (array_agg(wc ORDER BY w DESC, record_id))[1] AS c1,
  (array_agg({field} ORDER BY w DESC, length({field}) DESC, record_id))[1] AS v2, (array_agg(wc ORDER BY w DESC, length({field}) DESC, record_id))[1] AS c2
  FROM m WHERE trim({field}) <> '' GROUP BY cluster_id),
r_{field} AS (SELECT cluster_id, CASE WHEN cnt = 1 OR forms = 1 THEN v1 ELSE v2 END AS value,
  CASE WHEN cnt = 1 THEN c1 WHEN forms = 1 THEN least(c1 + 0.05::DOUBLE * (cnt - 1), 1.0::DOUBLE) ELSE c2 END AS confidence,
  CASE WHEN cnt = 1 THEN 'direct' WHEN forms = 1 THEN 'agreement' ELSE 'trust_weight' END AS method FROM s_{field})"""


LISTS = {
    "emails": ["(email, email)"],
    "phones": ["(phone, phone)"],
    "links": ["(lower(link), link)"],
    "skills": ["(lower(skill_a), skill_a)", "(CASE WHEN skill_b = skill_a THEN NULL ELSE lower(skill_b) END, skill_b)"],
    "experience": ["(lower(trim(company)) || '::' || lower(trim(title)), company || '/' || title || '/' || coalesce(start_date, '-') || '/' || coalesce(end_date, '-'))"],
    "education": ["(lower(trim(institution)) || '::' || lower(trim(degree)), institution || '/' || degree)"],
}


def list_cte(field: str) -> str:
    rows = " UNION ALL ".join(f"SELECT cluster_id, record_id, w, wc, {i} AS pos, x[1] AS key, x[2] AS v, start_date, end_date FROM (SELECT *, list_value({pair[1:-1]}) AS x FROM m)" for i, pair in enumerate(LISTS[field]))
    return f"""
u_{field} AS (SELECT * FROM ({rows}) WHERE key <> ''),
f_{field} AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, key ORDER BY w DESC, record_id, pos) AS rn FROM u_{field}),
r_{field} AS (SELECT cluster_id, string_agg(v, '|' ORDER BY w DESC, record_id, pos) FILTER (rn = 1) AS value, count(*) FILTER (rn = 1) AS cnt,
  least(max(wc) + 0.05::DOUBLE * (count(DISTINCT record_id) - 1), 1.0::DOUBLE) AS confidence, count(DISTINCT record_id) AS sources FROM f_{field} GROUP BY cluster_id)"""


PENALTIES = f"""
p_emails AS (SELECT cluster_id, count(*) AS total, count(*) FILTER (NOT regexp_matches(v, '^{d.EMAIL}$')) AS bad FROM f_emails WHERE rn = 1 GROUP BY cluster_id),
p_phones AS (SELECT cluster_id, count(*) AS total, count(*) FILTER (NOT regexp_matches(v, '{d.E164[1:]}')) AS bad FROM (SELECT cluster_id, rn, v FROM f_phones) WHERE rn = 1 GROUP BY cluster_id),
p_dates AS (SELECT cluster_id, count(*) AS total, count(*) FILTER (NOT regexp_matches(x, '{d.YEAR_MONTH}')) AS bad FROM (
  SELECT cluster_id, unnest([start_date, end_date]) AS x FROM f_experience WHERE rn = 1) WHERE x IS NOT NULL AND x <> '' AND x <> 'Present' GROUP BY cluster_id)""".replace("'\\+", "'^\\+")

_P = lambda p, weight: f"CASE WHEN coalesce({p}.bad, 0) > 0 THEN round(greatest(CONF - {weight}::DOUBLE * ({p}.bad / {p}.total::DOUBLE), 0.0::DOUBLE), 4) ELSE CONF END"

SCALARS = ("full_name", "current_company", "current_title", "location")
WEIGHTS = (("full_name", 2.0), ("emails", 2.0), ("phones", 1.5), ("location", 1.0), ("skills", 1.5), ("experience", 1.0), ("education", 1.0), ("current_company", 1.0), ("current_title", 1.0), ("links", 0.5))


def _scored() -> str:
    ids = "ids AS (SELECT DISTINCT cluster_id FROM m)"
    joins = " ".join(f"LEFT JOIN r_{f} USING (cluster_id)" for f, _ in WEIGHTS) + " LEFT JOIN p_emails USING (cluster_id) LEFT JOIN p_phones USING (cluster_id) LEFT JOIN p_dates USING (cluster_id)"
    conf = {f: f"r_{f}.confidence" for f, _ in WEIGHTS}
    conf["emails"] = _P("p_emails", 0.1).replace("CONF", conf["emails"])
    conf["phones"] = _P("p_phones", 0.2).replace("CONF", conf["phones"])
    conf["experience"] = _P("p_dates", 0.1).replace("CONF", conf["experience"])
    columns = ", ".join(f"r_{f}.value AS {f}, coalesce({conf[f]}, 0.0::DOUBLE) AS {f}_confidence" for f, _ in WEIGHTS)
    points = "0.0::DOUBLE + " + " + ".join(f"CASE WHEN {f} IS NULL THEN 0.0::DOUBLE ELSE {f}_confidence * {w}::DOUBLE END" for f, w in WEIGHTS)
    weights = "0.0::DOUBLE + " + " + ".join(f"CASE WHEN {f} IS NULL THEN {w if w >= 2 else 0.0}::DOUBLE ELSE {w}::DOUBLE END" for f, w in WEIGHTS)
    return f"{ids}, wide AS (SELECT cluster_id, {columns} FROM ids {joins}), scored AS (SELECT *, CASE WHEN {weights} > 0 THEN round(({points}) / ({weights}), 4) ELSE 0.0 END AS overall_confidence FROM wide)"


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


MERGED = [FLAT, KEYS, CLUSTERS, *[scalar_cte(f) for f in SCALARS], *[list_cte(f) for f in LISTS], PENALTIES, _scored()]


def flat(select: str) -> str:
    return f"{with_(FLAT)} {select}"


def scored(select: str) -> str:
    return f"{with_(*MERGED)} {select}"

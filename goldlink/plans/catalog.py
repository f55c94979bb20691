"""Registered queries of the record-linkage engine and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldlink.functions import dictionaries as d
from goldlink.functions import normalize as nz
from goldlink.functions.text import find_all, title_case
from goldlink.operators import extract
from goldlink.operators.merge import merge
from goldlink.operators.project import project
from goldlink.operators.resolve import match_keys, resolve_entities, star_edges
from goldlink.operators.score import score
from goldlink.operators.validate import validate
from goldlink.plans import oracles as o
from goldlink.plans import scratch
from goldlink.plans.candidates import candidates, raw_candidates
from goldlink.plans.policy import ProjectionConfig
from goldlink.plans.scratch import materialize
from goldlink.sources import registry, sink

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve_entities(materialize(nz.normalize(candidates(spark, sf_dir)), "normalized"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(merge(_resolved(spark, sf_dir)), rounding=F.round)


# --- extraction from text -------------------------------------------------------------------------


@query(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{d.EMAIL}'))) AS email FROM documents")
def extract_emails(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(find_all(F.col("text"), d.EMAIL)).alias("email"))


@query(f"SELECT page_id, unnest(list_distinct(regexp_extract_all(concat_ws(' ', url, html), '{d.URL.replace(chr(39), chr(39) * 2)}'))) AS url FROM pages")
def extract_urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(find_all(F.concat_ws(" ", "url", "html"), d.URL)).alias("url"))


@query(f"SELECT doc_id, phone FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{d.PHONE}'))) AS phone FROM documents) WHERE length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 7")
def extract_phones(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(extract.phones_in(F.col("text"))).alias("phone"))


NOTE_SQL = (
    "concat('Name', CAST(c_custkey AS STRING), chr(10), 'u', CAST(c_custkey AS STRING), '@mail.example', chr(10), 'Phone: (555) 123-', lpad(CAST(c_custkey % 9000 AS STRING), 4, '1'), chr(10), "
    "'Currently at ', c_mktsegment, '.', chr(10), 'Title; Lead', chr(10), 'Based in Paris', chr(10), 'Skills: sql, go / rust', chr(10), 'Very sharp, see https://example.org/', CAST(c_custkey AS STRING))"
)


@query("SELECT c_custkey // 3 * 3 AS file, c_custkey % 3 AS position, 'Name' || c_custkey AS full_name, 'u' || c_custkey || '@mail.example' AS email, '(555) 123-' || lpad(CAST(c_custkey % 9000 AS STRING), 4, '1') AS phone, c_mktsegment AS company, 'Lead' AS title, 'Paris' AS location, 'sql|go|rust' AS skills, 'https://example.org/' || c_custkey AS link FROM customer")
def notes_blocks(spark, sf_dir):
    """Three notes a text, divided by rules, back into records."""
    notes = _table(spark, sf_dir, "customer").selectExpr("c_custkey - c_custkey % 3 AS file", "c_custkey", f"{NOTE_SQL} AS note")
    files = notes.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "note"))), lambda x: x["note"]), "\n\n---\n\n").alias("text"), (F.min("c_custkey") % 3).alias("first"))
    records = extract.parse_blocks(files.select(F.concat_ws(":", "file", "first").alias("source_path"), "text"))
    file, first = (F.split("source_path", ":")[i].cast("long") for i in (0, 1))
    one = lambda c: F.array_join(c, "|")
    return records.select(file.alias("file"), (F.col("position") + first).alias("position"), "full_name", one("emails").alias("email"), one("phones").alias("phone"), F.col("current_company").alias("company"), F.col("current_title").alias("title"), "location", one("skills").alias("skills"), one("links").alias("link"))


RESUME_SQL = (
    "concat('Resume', chr(10), 'Name', CAST(s_suppkey AS STRING), chr(10), 's', CAST(s_suppkey AS STRING), '@mail.example', chr(10), 'Berlin, DE', chr(10), chr(10), 'SKILLS', chr(10), 'old', chr(10), 'Skills:', chr(10), "
    "'• Python, SQL | Go', chr(10), 'I have spent many years on a very long list of things that make up a sentence here', chr(10), 'Work Experience', chr(10), 'Acme', CAST(s_nationkey AS STRING), ' | Engineer Jan 2020 - Present', chr(10), "
    "'did things well', chr(10), 'Globex - Analyst 2018 - 2019', chr(10), 'Education', chr(10), 'State University', chr(10), 'BS Physics', chr(10), '2015', chr(10), 'Tech Institute', chr(10), 'MS')"
)


@query(
    "SELECT s_suppkey, 'Name' || s_suppkey AS full_name, 's' || s_suppkey || '@mail.example' AS email, 'Berlin, DE' AS location, 'Python|SQL|Go' AS skills, "
    "'Acme' || s_nationkey || '/Engineer/Jan 2020/Present|Globex/Analyst/2018/2019' AS experience, 'State University/BS Physics/2015|Tech Institute/MS/' AS education, 'Acme' || s_nationkey AS company, 'Engineer' AS title FROM supplier"
)
def resume_sections(spark, sf_dir):
    """Sections, skills, experience and education of a résumé text."""
    files = _table(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS source_path", f"{RESUME_SQL} AS text")
    records = extract.parse_resumes(files)
    line = lambda c, *names: F.array_join(F.transform(c, lambda e: F.concat_ws("/", *[e[n] for n in names])), "|")
    return records.select(
        F.col("source_path").cast("long").alias("s_suppkey"), "full_name", F.array_join("emails", "|").alias("email"), "location", F.array_join("skills", "|").alias("skills"),
        line("experience", "company", "title", "start_date", "end_date").alias("experience"), line("education", "institution", "degree", "year").alias("education"),
        F.col("current_company").alias("company"), F.col("current_title").alias("title"),
    )


# --- sources --------------------------------------------------------------------------------------


def _written(files: dict[str, DataFrame]) -> list[str]:
    """A text file of each name, with the rows' ``line`` in order of ``i``, in one new shared folder."""
    spark = next(iter(files.values())).sparkSession
    jvm, target = spark._jvm, scratch.folder(spark, "source")
    for name, rows in files.items():
        parts = scratch.folder(spark, "source-parts")
        rows.coalesce(1).sortWithinPartitions("i").select("line").write.text(parts)
        path = jvm.org.apache.hadoop.fs.Path(parts)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        part = [x.getPath() for x in store.listStatus(path) if x.getPath().getName().startswith("part-")][0]
        store.mkdirs(jvm.org.apache.hadoop.fs.Path(target))
        store.rename(part, jvm.org.apache.hadoop.fs.Path(target, name))
    return registry.discover(spark, target)


def _line(spark: SparkSession, i: int, text: str) -> DataFrame:
    return spark.range(1).selectExpr(f"CAST({i} AS BIGINT) AS i", f"'{text}' AS line")


@query("SELECT c_custkey AS position, nullif('N' || c_custkey, 'N') AS full_name, CASE WHEN c_custkey % 5 > 0 THEN 'e' || c_custkey || '@mail.example' ELSE '' END AS email, CASE WHEN c_custkey % 2 = 0 THEN 'says \"hi\", ok' ELSE c_mktsegment END AS company, 'a|b c' AS skills FROM customer WHERE c_custkey > 0")
def csv_scan(spark, sf_dir):
    """Header synonyms, quotes, unknown columns and blank cells, over a written file."""
    rows = _table(spark, sf_dir, "customer").where("c_custkey > 0").selectExpr(
        "c_custkey AS i",
        "concat('N', CAST(c_custkey AS STRING), ',', CASE WHEN c_custkey % 5 > 0 THEN concat(' e', CAST(c_custkey AS STRING), '@mail.example') ELSE '' END, ',', CASE WHEN c_custkey % 2 = 0 THEN '\"says \"\"hi\"\", ok\"' ELSE c_mktsegment END, ',x,\"a, b c,\"') AS line",
    )
    head = spark.sql("SELECT CAST(-1 AS BIGINT) AS i, 'Full Name, E-MAIL ,Employer,unknown,Skills' AS line")
    records, _ = registry.extract(spark, _written({"source.csv": head.unionByName(rows)}))
    key = F.regexp_extract("full_name", r"(\d+)", 1).cast("long")
    return records.select(key.alias("position"), "full_name", F.array_join("emails", "|").alias("email"), F.col("current_company").alias("company"), F.array_join("skills", "|").alias("skills"))


JSON_LINE = (
    "concat('{\"', CASE WHEN c_custkey % 2 = 0 THEN 'applicant_name' ELSE 'name' END, '\":\"N', CAST(c_custkey AS STRING), '\",\"contact\":', CASE c_custkey % 3 WHEN 0 THEN 'null,\"email\":\"top@mail.example\"' "
    "WHEN 1 THEN '{\"email\":[\" a@mail.example\",\"b@mail.example\",7],\"phone\":15551234567}' ELSE '{\"mail\":\"m@mail.example\",\"phone\":[1,\"2\"]}' END, ',\"skills_list\":[],\"skills\":\"x, y\",\"location\":{\"city\":\"C\",\"state\":\"\",\"country\":\"US\"}"
    ",\"experience\":[{\"organization\":\"O\",\"role\":\"R\",\"from\":\"2020\"},5],\"education\":[{\"school\":\"S\",\"graduation_year\":2019}],\"github\":\"g\",\"links\":[\"l\",null]}')"
)


@query(
    "SELECT c_custkey AS k, 'N' || c_custkey AS full_name, CASE c_custkey % 3 WHEN 0 THEN 'top@mail.example' WHEN 1 THEN 'a@mail.example|b@mail.example' ELSE 'm@mail.example' END AS emails, "
    "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '15551234567' ELSE '1|2' END AS phones, 'x|y' AS skills, 'C, US' AS location, 'O/R/2020/' AS experience, 'S//2019' AS education, 'g|l' AS links FROM customer"
)
def json_scan(spark, sf_dir):
    """Fallback chains and polymorphic members of an array of objects."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS i", f"concat(',', {JSON_LINE}) AS line")
    ends = spark.sql("SELECT CAST(-1 AS BIGINT) AS i, '[7' AS line UNION ALL SELECT 9223372036854775807, ']'")
    records, _ = registry.extract(spark, _written({"source.json": ends.unionByName(rows)}))
    line = lambda c, *names: F.array_join(F.transform(c, lambda e: F.concat_ws("/", *[e[n] for n in names])), "|")
    return records.select(
        F.regexp_extract("full_name", r"(\d+)", 1).cast("long").alias("k"), "full_name", *[F.array_join(c, "|").alias(c) for c in ("emails", "phones", "skills")], "location",
        line("experience", "company", "title", "start_date", "end_date").alias("experience"), line("education", "institution", "degree", "year").alias("education"), F.array_join("links", "|").alias("links"),
    )


@query(
    "SELECT 1 - c_custkey % 2 AS file, position, full_name, email FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) AS position, "
    "CASE WHEN c_custkey % 5 > 0 THEN 'N' || c_custkey END AS full_name, CASE WHEN c_custkey % 3 > 0 THEN 'e' || c_custkey || '@mail.example' ELSE '' END AS email FROM customer) WHERE full_name IS NOT NULL OR email <> ''"
)
def csv_files(spark, sf_dir):
    """Files of different headers in order of their paths; rows with neither name nor e-mail go, but count as places."""
    rows = _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS i", "CASE WHEN c_custkey % 5 > 0 THEN concat('N', CAST(c_custkey AS STRING)) ELSE ' ' END AS name", "CASE WHEN c_custkey % 3 > 0 THEN concat('e', CAST(c_custkey AS STRING), '@mail.example') ELSE '' END AS email"
    )
    odd = rows.where("i % 2 = 1").selectExpr("i", "concat(email, ',Analyst,', name) AS line")
    even = rows.where("i % 2 = 0").selectExpr("i", "concat(name, ',', email, ',Analyst') AS line")
    paths = _written({"b.csv": _line(spark, -1, "name,email,title").unionByName(even), "a.csv": _line(spark, -1, "Email,Title,Full Name").unionByName(odd)})
    records, _ = registry.extract(spark, paths)
    place = F.shiftright("record_id", registry.FILE_BITS)
    return records.select(place.alias("file"), "position", "full_name", F.array_join("emails", "|").alias("email"))


@query(
    "SELECT CASE c_custkey % 3 WHEN 0 THEN 'a.json' ELSE 'c.csv' END AS file, 'N' || c_custkey AS full_name, 'e' || c_custkey || '@mail.example' AS email, FALSE AS failed FROM customer WHERE c_custkey % 3 <> 1 "
    "UNION ALL SELECT 'b.json', NULL, NULL, TRUE"
)
def failed_sources(spark, sf_dir):
    """A file that breaks off gives no records and is reported; the others are read. Of repeated members the last counts."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS i", "CAST(c_custkey AS STRING) AS k")
    good = rows.where("i % 3 = 0").selectExpr("i", """concat(',{"name":"N', k, '","email":"first@mail.example","email":"e', k, '@mail.example"}') AS line""")
    cut = rows.where("i % 3 = 1").selectExpr("i", """concat(',{"name":"N', k, '"}') AS line""")
    flat = rows.where("i % 3 = 2").selectExpr("i", "concat('N', k, ',e', k, '@mail.example') AS line")
    whole = _line(spark, -1, "[7").unionByName(good).unionByName(_line(spark, 2**63 - 1, "]"))
    paths = _written({"a.json": whole, "b.json": _line(spark, -1, "[7").unionByName(cut), "c.csv": _line(spark, -1, "name,email").unionByName(flat)})
    records, failed = registry.extract(spark, paths)
    name = F.regexp_extract("source_path", "([^/]+)$", 1).alias("file")
    none = F.lit(None).cast("string")
    lost = spark.createDataFrame([(p,) for p in failed], "source_path string").select(name, none.alias("full_name"), none.alias("email"), F.lit(True).alias("failed"))
    return records.select(name, "full_name", F.array_join("emails", "|").alias("email"), F.lit(False).alias("failed")).unionByName(lost)


# --- standardizers --------------------------------------------------------------------------------


@query(o.flat("SELECT record_id, coalesce(email, '') AS email FROM n"))
def normalize_email(spark, sf_dir):
    return raw_candidates(spark, sf_dir).select("record_id", F.array_join(nz.emails(F.array_compact(F.array("email"))), "|").alias("email"))


@query(o.flat("SELECT record_id, phone FROM n"))
def normalize_phone(spark, sf_dir):
    return raw_candidates(spark, sf_dir).select("record_id", nz.phone(F.col("phone")).alias("phone"))


@query(o.flat("SELECT record_id, start_date, end_date FROM n"))
def normalize_date(spark, sf_dir):
    return raw_candidates(spark, sf_dir).select("record_id", nz.date(F.col("start_date")).alias("start_date"), nz.date(F.col("end_date")).alias("end_date"))


@query(f"SELECT n_nationkey, {o._case('lower(trim(n_name))', d.COUNTRIES)} AS code, {o._case('lower(trim(r_name))', d.COUNTRIES)} AS region_code FROM nation JOIN region ON n_regionkey = r_regionkey")
def normalize_country(spark, sf_dir):
    joined = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return joined.select("n_nationkey", nz.country(F.col("n_name")).alias("code"), nz.country(F.col("r_name")).alias("region_code"))


@query(o.flat("SELECT record_id, location FROM n"))
def normalize_location(spark, sf_dir):
    return raw_candidates(spark, sf_dir).select("record_id", nz.location_text(F.col("location")).alias("location"))


@query(o.flat("SELECT record_id, concat_ws('|', skill_a, CASE WHEN skill_b = skill_a THEN NULL ELSE skill_b END) AS skills FROM n"))
def normalize_skills(spark, sf_dir):
    return raw_candidates(spark, sf_dir).select("record_id", F.array_join(nz.skills(F.array("skill_a", "skill_b")), "|").alias("skills"))


@query(f"SELECT p_partkey, {o.title_sql('p_name')} AS name, {o.title_sql('p_type')} AS type FROM part")
def title_words(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", title_case(F.col("p_name")).alias("name"), title_case(F.col("p_type")).alias("type"))


# --- linkage --------------------------------------------------------------------------------------


@query(f"{o.with_(o.FLAT, o.KEYS)} SELECT key_type, key, record_id FROM k", "match_keys")
def keys(spark, sf_dir):
    return match_keys(nz.normalize(candidates(spark, sf_dir))).select("key_type", "key", "record_id")


@query(f"{o.with_(o.FLAT, o.KEYS)} SELECT src, dst FROM edges", "star_edges")
def edges(spark, sf_dir):
    return star_edges(nz.normalize(candidates(spark, sf_dir)))


@query(f"{o.with_(o.FLAT, o.KEYS, o.CLUSTERS)} SELECT record_id, cluster_id FROM cl")
def entity_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir).select("record_id", "cluster_id")


# --- merging, scoring -----------------------------------------------------------------------------


def _merged_scalar(field):
    def run(spark, sf_dir):
        f = F.col(field)
        merged = merge(_resolved(spark, sf_dir)).where(f["value"].isNotNull())
        return merged.select("cluster_id", f["value"].alias("value"), F.round(f["confidence"], 6).alias("confidence"), F.get(f["provenance"], F.lit(0))["method"].alias("method"))

    return run


for _f in o.SCALARS:
    query(f"{o.with_(o.FLAT, o.KEYS, o.CLUSTERS, o.scalar_cte(_f))} SELECT cluster_id, value, round(confidence, 6) AS confidence, method FROM r_{_f}", f"merge_{_f}")(_merged_scalar(_f))


def _shown(field: str):
    value = F.col(field)["value"]
    if field == "experience":
        return F.array_join(F.transform(value, lambda e: F.concat_ws("/", e["company"], e["title"], F.coalesce(e["start_date"], F.lit("-")), F.coalesce(e["end_date"], F.lit("-")))), "|")
    if field == "education":
        return F.array_join(F.transform(value, lambda e: F.concat_ws("/", e["institution"], e["degree"])), "|")
    return F.array_join(value, "|")


def _merged_list(field):
    def run(spark, sf_dir):
        f = F.col(field)
        merged = merge(_resolved(spark, sf_dir)).where(F.size(f["value"]) > 0)
        return merged.select("cluster_id", _shown(field).alias("value"), F.round(f["confidence"], 6).alias("confidence"), F.size(f["provenance"]).cast("long").alias("sources"))

    return run


for _f in o.LISTS:
    query(f"{o.with_(o.FLAT, o.KEYS, o.CLUSTERS, o.list_cte(_f))} SELECT cluster_id, value, round(confidence, 6) AS confidence, sources FROM r_{_f}", f"merge_{_f}")(_merged_list(_f))


@query(o.scored("SELECT cluster_id, round(emails_confidence, 4) AS emails, round(phones_confidence, 4) AS phones, round(experience_confidence, 4) AS experience FROM scored"))
def format_penalties(spark, sf_dir):
    return _scored(spark, sf_dir).select("cluster_id", *[F.round(F.col(f)["confidence"], 4).alias(f) for f in ("emails", "phones", "experience")])


@query(o.scored("SELECT cluster_id, overall_confidence FROM scored"))
def overall_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("cluster_id", "overall_confidence")


@query(o.scored("SELECT cluster_id, full_name, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, location, coalesce(skills, '') AS skills, coalesce(experience, '') AS experience, coalesce(education, '') AS education, current_company, current_title, coalesce(links, '') AS links, overall_confidence FROM scored"))
def golden_records(spark, sf_dir):
    """Candidates → normalize → resolve → merge → score."""
    lists = [_shown(f).alias(f) if f in o.LISTS else F.col(f)["value"].alias(f) for f, _ in o.WEIGHTS]
    by_name = {f: c for (f, _), c in zip(o.WEIGHTS, lists, strict=True)}
    order = ("full_name", "emails", "phones", "location", "skills", "experience", "education", "current_company", "current_title", "links")
    return _scored(spark, sf_dir).select("cluster_id", *[by_name[f] for f in order], "overall_confidence")


# --- projection, validation -----------------------------------------------------------------------


def _config(policy: str) -> ProjectionConfig:
    fields = [{"source_field": "full_name", "output_field": "name"}, {"source_field": "phones", "output_field": "phone_list", "include_confidence": True}, {"source_field": "emails", "output_field": "emails"}, {"source_field": "nothing", "output_field": "none"}]
    return ProjectionConfig.of({"fields": fields[: 3 if policy == "error" else 4], "on_missing": policy, "include_metadata": False})


_NAME = "to_json(full_name)"
_LIST = lambda f: f"'[\"' || replace({f}, '|', '\",\"') || '\"]'"
_OVERALL = "'\"overall_confidence\":' || CASE WHEN overall_confidence = 0 THEN '0.0' ELSE CAST(overall_confidence AS STRING) END"
_RICH = f"'{{\"value\":' || {_LIST('phones')} || ',\"confidence\":' || CAST(phones_confidence AS STRING) || '}}'"


def _projected(policy):
    def run(spark, sf_dir):
        done, _ = project(_scored(spark, sf_dir), _config(policy))
        parsed = F.from_json("output", "name string, phone_list struct<value:array<string>,confidence:double>, emails array<string>, none string, overall_confidence double")
        keys = F.array_join(F.array_sort(F.json_object_keys("output")), ",")
        rows = done.select("cluster_id", parsed.alias("p"), keys.alias("keys"))
        return rows.select("cluster_id", "keys", "p.name", F.array_join("p.phone_list.value", "|").alias("phones"), F.round("p.phone_list.confidence", 4).alias("phones_confidence"), F.array_join("p.emails", "|").alias("emails"), "p.overall_confidence")

    return run


_KEYS = {
    "null": "'emails,name,none,overall_confidence,phone_list'",
    "omit": "array_to_string(list_filter([CASE WHEN emails IS NOT NULL THEN 'emails' END, CASE WHEN full_name IS NOT NULL THEN 'name' END, 'overall_confidence', CASE WHEN phones IS NOT NULL THEN 'phone_list' END], lambda x: x IS NOT NULL), ',')",
    "error": "'emails,name,overall_confidence,phone_list'",
}
for _p, _k in _KEYS.items():
    _where = " WHERE full_name IS NOT NULL AND phones IS NOT NULL AND emails IS NOT NULL" if _p == "error" else ""
    query(o.scored(f"SELECT cluster_id, {_k} AS keys, full_name AS name, phones, CASE WHEN phones IS NOT NULL THEN round(phones_confidence, 4) END AS phones_confidence, emails, overall_confidence FROM scored{_where}"), f"project_{_p}")(_projected(_p))


@query(o.scored("SELECT cluster_id, 'Required field ''' || CASE WHEN full_name IS NULL THEN 'full_name'' (projected as ''name' WHEN phones IS NULL THEN 'phones'' (projected as ''phone_list' ELSE 'emails'' (projected as ''emails' END || ''') is missing.' AS message FROM scored WHERE full_name IS NULL OR phones IS NULL OR emails IS NULL"))
def project_rejects(spark, sf_dir):
    scored = materialize(_scored(spark, sf_dir), "scored")
    _, rejects = project(scored, _config("error"))
    return rejects.join(scored.select("profile_id", "cluster_id"), "profile_id").select("cluster_id", "message")


@query(
    o.scored(
        "SELECT cluster_id, 'emails[' || (row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, record_id, pos) - 1) || ']' AS field, 'warning' AS severity, 'Email ''' || v || ''' does not match expected format.' AS message, "
        f"NOT regexp_matches(v, '^{d.EMAIL}$') AS bad FROM f_emails WHERE rn = 1 QUALIFY bad"
    ).replace("SELECT cluster_id, 'emails['", "SELECT * EXCLUDE (bad) FROM (SELECT cluster_id, 'emails['")
    + ")"
)
def validate_issues(spark, sf_dir):
    done, _ = project(_scored(spark, sf_dir), _config("null"))
    # explode_outer: from a plain explode the optimizer infers a filter, which repeats the whole expression of the issues
    rows = validate(done, _config("null")).select("cluster_id", F.explode_outer("issues").alias("x")).where("x is not null")
    return rows.select("cluster_id", "x.field", "x.severity", "x.message")


_CONTRIBUTIONS = """
given AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cnt, min(lower(trim(full_name))) OVER (PARTITION BY cluster_id) = max(lower(trim(full_name))) OVER (PARTITION BY cluster_id) AS alike FROM m WHERE trim(full_name) <> ''),
won AS (SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, CASE WHEN alike THEN 0 ELSE length(full_name) END DESC, record_id) = 1)
SELECT cluster_id, 'full_name' AS field, source_type, source_path, full_name AS original_value, CASE WHEN cnt = 1 THEN 'direct' WHEN alike THEN 'agreement' ELSE 'trust_weight' END AS method FROM won
UNION ALL SELECT cluster_id, 'emails', source_type, source_path, email, 'union' FROM m WHERE email <> ''"""


@query(o.with_(o.FLAT, o.KEYS, o.CLUSTERS, _CONTRIBUTIONS))
def project_provenance(spark, sf_dir):
    """Which record gave a name, and which gave e-mail addresses, read back from the output."""
    fields = [{"source_field": f, "output_field": f, "include_provenance": "yes"} for f in ("full_name", "emails")]
    done, _ = project(_scored(spark, sf_dir), ProjectionConfig.of({"fields": fields, "include_metadata": False, "ignored": 1}))
    source = "struct<provenance:array<struct<field:string,source_type:string,source_path:string,original_value:{},method:string>>>"
    read = F.from_json("output", f"full_name {source.format('string')}, emails {source.format('array<string>')}")
    parts = [
        done.select("cluster_id", F.explode_outer(read[f]["provenance"]).alias("e")).where("e is not null").select("cluster_id", "e.field", "e.source_type", "e.source_path", value.alias("original_value"), "e.method")
        for f, value in (("full_name", F.col("e.original_value")), ("emails", F.array_join("e.original_value", "|")))
    ]
    return parts[0].unionByName(parts[1])


_REPORTS = """ SELECT cluster_id, cluster_id % 4 <> 1 AS is_valid, CASE WHEN n > 0 THEN cluster_id % 4 <> 1 END AS reported,
  CASE WHEN n > 0 THEN (cluster_id % 4 = 1)::INT END AS errors, CASE WHEN n > 0 THEN n - (cluster_id % 4 = 1)::INT END AS warnings, concat_ws('|',
  CASE WHEN cluster_id % 3 = 0 THEN 'phone_list.confidence/warning/Confidence -0.5 is outside [0.0, 1.0] range.|phone_list[0]/warning/Phone ' || chr(39) || 'bad' || cluster_id || chr(39) || ' is not in E.164 format.' END,
  CASE cluster_id % 4 WHEN 0 THEN 'overall_confidence/warning/Confidence 1.5 is outside [0.0, 1.0] range.' WHEN 1 THEN 'overall_confidence/error/Confidence must be a number, got null.' END) AS issues
FROM (SELECT cluster_id, 2 * (cluster_id % 3 = 0)::INT + (cluster_id % 4 < 2)::INT AS n FROM (SELECT DISTINCT cluster_id FROM cl))"""


@query(o.with_(o.FLAT, o.KEYS, o.CLUSTERS) + _REPORTS)
def validate_reports(spark, sf_dir):
    """Confidences that are missing or out of range and phone numbers in a bad format, read back from the report in the output."""
    third, quarter = F.col("cluster_id") % 3 == 0, F.col("cluster_id") % 4
    bad = F.array(F.concat(F.lit("bad"), F.col("cluster_id").cast("string")))
    phones = F.col("phones").withField("value", F.when(third, bad).otherwise(F.col("phones.value"))).withField("confidence", F.when(third, -0.5).otherwise(F.col("phones.confidence")))
    overall = F.when(quarter == 0, 1.5).when(quarter > 1, F.col("overall_confidence"))
    spoilt = materialize(_scored(spark, sf_dir).withColumn("phones", phones).withColumn("overall_confidence", overall), "spoilt")
    config = ProjectionConfig.of({"fields": [{"source_field": "full_name", "output_field": "name"}, {"source_field": "phones", "output_field": "phone_list", "include_confidence": True}], "include_metadata": False})
    done, _ = project(spoilt, config)
    kind = "_validation struct<is_valid:boolean,error_count:int,warning_count:int,issues:array<struct<field:string,severity:string,message:string>>>"
    rows = validate(done, config).select("cluster_id", "is_valid", F.from_json("output", kind)["_validation"].alias("r"))
    issues = F.array_join(F.transform("r.issues", lambda x: F.concat_ws("/", x["field"], x["severity"], x["message"])), "|")
    return rows.select("cluster_id", "is_valid", F.col("r.is_valid").alias("reported"), F.col("r.error_count").alias("errors"), F.col("r.warning_count").alias("warnings"), F.coalesce(issues, F.lit("")).alias("issues"))


@query(o.scored("SELECT full_name AS name, coalesce(emails, '') AS emails, overall_confidence FROM scored"))
def sink_lines(spark, sf_dir):
    """JSON lines as written by the sink and read again."""
    config = ProjectionConfig.of({"fields": [{"source_field": "full_name", "output_field": "name"}, {"source_field": "emails", "output_field": "emails"}], "include_metadata": False})
    done, _ = project(_scored(spark, sf_dir), config)
    path = scratch.folder(spark, "sink-lines")
    sink.write_lines(done, path)
    lines = spark.read.schema("name string, emails array<string>, overall_confidence double").json(path)
    return lines.select("name", F.coalesce(F.array_join("emails", "|"), F.lit("")).alias("emails"), "overall_confidence")

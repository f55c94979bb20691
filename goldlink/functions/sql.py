"""The scalar standardizers as SQL functions of a session; they are inlined into plans, so no Python runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from goldlink.functions import dictionaries as d


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(table: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{_text(k)}, {_text(v)}" for k, v in table.items()) + ")"


def _date(x: str) -> str:
    month, number, iso = (_text(p) for p in (d.MONTH_YEAR, d.NUMERIC_MONTH_YEAR, d.ISO_DATE))
    part = lambda p, i: f"regexp_extract({x}, {p}, {i})"
    valid = lambda p, i: f"try_cast({part(p, i)} AS INT) BETWEEN 1 AND 12"
    return f"""CASE WHEN lower({x}) IN ({", ".join(map(_text, d.PRESENT))}) THEN 'Present'
      WHEN {x} RLIKE {month} THEN concat({part(month, 2)}, '-', try_element_at({_map(d.MONTHS)}, lower({part(month, 1)})))
      WHEN {valid(number, 1)} THEN concat({part(number, 2)}, '-', lpad({part(number, 1)}, 2, '0'))
      WHEN {valid(iso, 2)} THEN concat({part(iso, 1)}, '-', {part(iso, 2)})
      WHEN {x} RLIKE '^[0-9]{{4}}$' THEN {x} END"""


STRIP = r"regexp_replace({}, '(?U)^\\s+|\\s+$', '')"
TITLE = r"array_join(transform(regexp_extract_all({}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), w -> initcap(w)), '')"


def definitions() -> dict[str, str]:
    """Name → body over a string argument ``x``."""
    bare = STRIP.format("x")
    return {
        "strip_text": bare,
        "title_case": TITLE.format("x"),
        "normalize_email": f"nullif(lower({bare}), '')",
        "normalize_country": f"try_element_at({_map(d.COUNTRIES)}, lower({bare}))",
        "normalize_skill": f"coalesce(try_element_at({_map(d.SKILLS)}, lower({bare})), nullif({TITLE.format(bare)}, ''))",
        "normalize_date": _date(bare),
        "is_e164": f"coalesce(x RLIKE {_text(d.E164)}, false)",
        "is_email": f"coalesce(x RLIKE {_text('^' + d.EMAIL + '$')}, false)",
    }


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions in the session and return their names."""
    for name, body in definitions().items():
        kind = "BOOLEAN" if name.startswith("is_") else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    return list(definitions())

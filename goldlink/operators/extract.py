"""Records out of free text: blocks of notes, and résumés, as expressions over the lines of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldlink.functions import dictionaries as d
from goldlink.functions.text import capture, filled, find_all, split_filled, strip
from goldlink.plans.schema import EDUCATION, EXPERIENCE


def lines_of(text: Column) -> Column:
    """Stripped non-blank lines."""
    return split_filled(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def phones_in(text: Column) -> Column:
    """Number-like runs of at least seven digits."""
    return F.filter(find_all(text, d.PHONE), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) >= 7)


def first_of(lines: Column, pattern: str) -> Column:
    """The capture of the first line that matches."""
    return F.get(F.filter(F.transform(lines, lambda x: capture(x, pattern)), lambda x: x.isNotNull()), F.lit(0))


def section(lines: Column, name: str) -> Column:
    """Lines under the last header of that name, up to the next header; null where there is none.

    Lines before any header belong to no section, and a repeated header starts its section anew.
    """
    bare = F.transform(lines, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"\s*:?\s*$", ""), r"\s+", "")))
    words = lambda names: [n.replace(" ", "") for n in names]
    places = lambda names: F.filter(F.transform(bare, lambda x, i: F.when(x.isin(words(names)), i)), lambda i: i.isNotNull())
    at = places(d.SECTIONS[name])
    heads = places([n for names in d.SECTIONS.values() for n in names])
    start = F.array_max(at)
    stop = F.coalesce(F.array_min(F.filter(heads, lambda i: i > start)), F.size(lines))
    return F.when(start.isNotNull(), F.slice(lines, F.coalesce(start, F.lit(0)) + 2, F.greatest(F.coalesce(stop - start - 1, F.lit(0)), F.lit(0))))


def skills_in(lines: Column) -> Column:
    """Short items of list-like lines; sentences are skipped."""
    words = lambda x: F.size(F.split(strip(x), r"(?U)\s+"))
    bare = F.transform(lines, lambda x: F.regexp_replace(strip(x), r"^[•\-*>▪►]\s*", ""))
    listed = F.filter(bare, lambda x: (F.length(x) <= 100) & (words(x) <= 15))
    items = F.flatten(F.transform(listed, lambda x: F.transform(F.split(x, r"[,|;•]+"), lambda y: F.btrim(strip(y), F.lit("•-* ")))))
    return F.filter(items, lambda x: (F.length(x) > 1) & (words(x) <= 4))


def experience_in(lines: Column) -> Column:
    """An entry for each line with a date range or of the form ``company - title``."""

    def entry(line):
        rest = strip(F.regexp_replace(line, d.DATE_RANGE, ""))
        blank = F.lit("")
        return F.struct(
            F.coalesce(strip(capture(rest, d.TWO_PARTS, 1)), blank).alias("company"),
            F.coalesce(strip(capture(rest, d.TWO_PARTS, 2)), blank).alias("title"),
            F.coalesce(strip(capture(line, d.DATE_RANGE, 1)), blank).alias("start_date"),
            F.coalesce(strip(capture(line, d.DATE_RANGE, 2)), blank).alias("end_date"),
        )

    found = F.filter(lines, lambda x: x.rlike(d.DATE_RANGE) | strip(F.regexp_replace(x, d.DATE_RANGE, "")).rlike(d.TWO_PARTS))
    return F.coalesce(F.transform(found, entry), F.array().cast(f"array<{EXPERIENCE}>"))


def education_in(lines: Column) -> Column:
    """Institution line, degree line, year line: a fold, as a year closes an entry that has begun."""
    entry_type = EDUCATION
    none = F.lit(None).cast(entry_type)
    state = f"struct<done:array<{entry_type}>,open:{entry_type}>"
    start = F.struct(F.array().cast(f"array<{entry_type}>").alias("done"), none.alias("open")).cast(state)

    def made(institution, degree, year):
        return F.struct(institution.alias("institution"), degree.alias("degree"), year.alias("year")).cast(entry_type)

    def step(s, line):
        year = F.regexp_extract(line, r"\b((?:19|20)\d{2})\b", 1)
        begun = F.coalesce(s["open"]["institution"] != "", F.lit(False))
        closes = begun & (year != "")
        done = F.when(closes, F.concat(s["done"], F.array(made(s["open"]["institution"], s["open"]["degree"], year)))).otherwise(s["done"])
        going = F.when(closes, none).when(~begun, made(line, F.lit(""), year)).otherwise(made(s["open"]["institution"], line, s["open"]["year"]))
        return F.struct(done.alias("done"), going.alias("open")).cast(state)

    finish = lambda s: F.when(F.coalesce(s["open"]["institution"] != "", F.lit(False)), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
    return F.coalesce(F.aggregate(lines, start, step, finish), F.array().cast(f"array<{entry_type}>"))


def header_location(lines: Column) -> Column:
    """The first of six lines that names a known city and holds no e-mail."""
    cities = r"(?i)\b(?:" + "|".join(d.HEADER_CITIES) + r")\b"
    return F.get(F.filter(F.slice(lines, 1, 6), lambda x: ~x.rlike(d.EMAIL) & x.rlike(cities)), F.lit(0))


def split_blocks(text: Column) -> Column:
    """Blocks between rule lines; without any rule, between runs of two or more blank lines."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    by_rule = F.split(text, d.BLOCK_RULE)
    return F.filter(F.transform(F.when(F.size(by_rule) > 1, by_rule).otherwise(F.split(text, d.BLANK_LINES)), strip), lambda x: x != "")


def parse_blocks(files: DataFrame, require_key: bool = False) -> DataFrame:
    """Records of notes files (source_path, text); ``require_key`` drops blocks with neither e-mail nor phone."""
    blocks = files.select("source_path", F.posexplode(split_blocks(F.col("text"))).alias("position", "block")).withColumn("lines", lines_of(F.col("block")))
    labels = (d.SKILLS_LABEL, d.COMPANY_LABEL, d.TITLE_LABEL, d.LOCATION_LABEL)

    def plain(x):
        taken = x.rlike(d.EMAIL) | F.startswith(x, F.lit("+")) | F.startswith(x, F.lit("("))
        for label in labels:
            taken = taken | x.rlike(label)
        return ~taken & (F.length(x) < 60)

    lines = F.col("lines")
    value = lambda label: F.rtrim(strip(first_of(lines, label)), F.lit("."))
    found = F.filter(F.transform(lines, lambda x: capture(x, d.SKILLS_LABEL)), lambda x: x.isNotNull())
    records = blocks.select(
        F.lit("recruiter_notes").alias("source_type"),
        "source_path",
        F.col("position").cast("long").alias("position"),
        F.rtrim(F.get(F.filter(lines, plain), F.lit(0)), F.lit(":")).alias("full_name"),
        find_all(F.col("block"), d.EMAIL).alias("emails"),
        phones_in(F.col("block")).alias("phones"),
        value(d.LOCATION_LABEL).alias("location"),
        F.flatten(F.transform(found, lambda x: split_filled(x, r"[,;|/]+"))).alias("skills"),
        F.array().cast(f"array<{EXPERIENCE}>").alias("experience"),
        F.array().cast(f"array<{EDUCATION}>").alias("education"),
        value(d.COMPANY_LABEL).alias("current_company"),
        value(d.TITLE_LABEL).alias("current_title"),
        find_all(F.col("block"), d.URL).alias("links"),
        F.to_json(F.struct(F.col("block").alias("raw_block"))).alias("raw_metadata"),
    )
    kept = records.where((filled(F.col("full_name")).isNotNull()) | (F.size("emails") > 0))
    return kept.where((F.size("emails") > 0) | (F.size("phones") > 0)) if require_key else kept


def parse_resumes(files: DataFrame) -> DataFrame:
    """One record for each résumé text (source_path, text) that has any line."""
    read = files.withColumn("lines", lines_of(F.col("text"))).where(F.size("lines") > 0)
    lines, text = F.col("lines"), F.col("text")
    name = F.filter(lines, lambda x: ~((x.rlike(d.EMAIL) & (F.length(x) < 60)) | F.startswith(x, F.lit("+")) | F.startswith(x, F.lit("(")) | F.lower(x).isin("resume", "curriculum vitae", "cv")))
    parsed = read.select(
        F.lit("resume_pdf").alias("source_type"),
        "source_path",
        F.lit(0).cast("long").alias("position"),
        F.get(name, F.lit(0)).alias("full_name"),
        find_all(text, d.EMAIL).alias("emails"),
        phones_in(text).alias("phones"),
        header_location(lines).alias("location"),
        F.coalesce(skills_in(section(lines, "skills")), F.array().cast("array<string>")).alias("skills"),
        experience_in(section(lines, "experience")).alias("experience"),
        education_in(section(lines, "education")).alias("education"),
        find_all(text, d.URL).alias("links"),
        F.to_json(F.struct(F.length(text).alias("extracted_text_length"))).alias("raw_metadata"),
    )
    first = F.get("experience", F.lit(0))
    return parsed.withColumns({"current_company": first["company"], "current_title": first["title"]})

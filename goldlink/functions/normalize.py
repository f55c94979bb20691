"""Standardizers of contact, date, location and skill values, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldlink.functions import dictionaries as d
from goldlink.functions.text import capture, filled, let, lookup, split_filled, strip, title_case

STRINGS = "array<string>"


def email(c: Column) -> Column:
    return F.lower(strip(c))


def emails(c: Column) -> Column:
    """Stripped and lower-cased, blanks dropped; not deduplicated, not validated."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast(STRINGS)), email), lambda x: x != "")


#: Country calling codes of one and two digits; all others have three.
CALLING_CODES_1 = ("1", "7")
CALLING_CODES_2 = tuple("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Lengths of a national number, where they differ from 4 digits up to 15 in all.
NATIONAL_LENGTHS = {"1": (7, 10), "7": (10, 10), "33": (9, 9), "34": (9, 9), "44": (7, 10), "46": (6, 10), "61": (6, 10), "65": (8, 8), "81": (8, 11), "82": (5, 11), "86": (7, 12), "91": (8, 11)}
#: Codes whose national numbers keep a leading zero.
KEEP_ZERO = ("39", "1", "7")


def phone(c: Column, region_code: str = "1") -> Column:
    """E.164, or null. Numbers without ``+`` are read with the calling code given (1: North American plan).

    Extensions (``ext. 12``, ``x12``, ``#12``) are cut off; vanity letters after a leading digit group are read from a keypad; for
    the North American plan 7-digit local numbers count as possible, as length is all that is tested.
    """
    bare = F.regexp_replace(strip(c), r"(?i)\s*(?:;ext=|ext\.?|extension|x|#)\s*\d{1,7}\s*$", "")

    def dialled(text: Column) -> Column:
        """The leading run of digits and punctuation, from the first + or digit; vanity letters as digits."""
        vanity = text.rlike(r"^\+?[\d\s().\-]*\d[\d\s().\-]*[A-Za-z]{3,}[A-Za-z\d\s().\-]*$")
        keyed = F.when(vanity, F.translate(F.upper(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")).otherwise(text)
        return strip(F.regexp_extract(keyed, r"^[^+(\d]*([+(\d][+\d\s().\-/]*)", 1))

    def split(lead: Column) -> Column:
        """Whether a country code follows, and the digits after the international prefix."""
        digits = F.regexp_replace(lead, "[^0-9]", "")
        plus = F.startswith(lead, F.lit("+"))
        abroad = plus | F.startswith(digits, F.lit("011"))
        return F.struct(abroad.alias("abroad"), F.when(abroad & ~plus, F.substr(digits, F.lit(4))).otherwise(digits).alias("digits"))

    def coded(x: Column) -> Column:
        digits = x["digits"]
        found = F.when(F.substring(digits, 1, 1).isin(*CALLING_CODES_1), 1).when(F.substring(digits, 1, 2).isin(*CALLING_CODES_2), 2).when(F.substring(digits, 1, 1) != "0", 3).otherwise(0)
        trunk = (F.lit(region_code) == "1") & (F.length(digits) == 11) & F.startswith(digits, F.lit("1"))
        return F.struct(
            F.when(x["abroad"], F.substr(digits, F.lit(1), found)).otherwise(F.lit(region_code)).alias("code"),
            F.when(x["abroad"], F.substr(digits, found + 1)).when(trunk, F.substr(digits, F.lit(2))).otherwise(digits).alias("rest"),
        )

    def checked(x: Column) -> Column:
        code = x["code"]
        zero = ~code.isin(*KEEP_ZERO) & F.startswith(x["rest"], F.lit("0"))
        return let(F.when(zero, F.substr(x["rest"], F.lit(2))).otherwise(x["rest"]), lambda rest: F.when(possible(code, F.length(rest)), F.concat(F.lit("+"), code, rest)))

    def possible(code: Column, n: Column) -> Column:
        table = F.create_map(*[y for k, v in NATIONAL_LENGTHS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
        usual = F.array(F.lit(4), F.lit(15) - F.length(code))
        bounds = F.coalesce(F.try_element_at(table, code), usual)
        return (F.length(code) > 0) & n.between(F.get(bounds, F.lit(0)), F.get(bounds, F.lit(1))) & ((code != "1") | n.isin(7, 10))

    return let(let(let(dialled(bare), split), coded), checked)


def phones(c: Column, region_code: str = "1") -> Column:
    found = F.transform(F.coalesce(c, F.array().cast(STRINGS)), lambda x: phone(x, region_code))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def date(c: Column) -> Column:
    """``YYYY-MM``, ``YYYY``, ``Present`` or null; the first rule that applies decides."""
    return let(filled(c), _date)


def _date(text: Column) -> Column:
    month, year = capture(text, d.MONTH_YEAR, 1), capture(text, d.MONTH_YEAR, 2)
    number = F.lpad(capture(text, d.NUMERIC_MONTH_YEAR, 1), 2, "0")
    iso = capture(text, d.ISO_DATE, 2)
    valid = lambda m: m.try_cast("int").between(1, 12)
    return F.coalesce(
        F.when(F.lower(text).isin(*d.PRESENT), F.lit("Present")),
        F.when(month.isNotNull(), F.concat(year, F.lit("-"), lookup(d.MONTHS, F.lower(month)))),
        F.when(valid(number), F.concat(capture(text, d.NUMERIC_MONTH_YEAR, 2), F.lit("-"), number)),
        F.when(valid(iso), F.concat(capture(text, d.ISO_DATE, 1), F.lit("-"), iso)),
        capture(text, r"^(\d{4})$", 1),
    )


def experience_dates(c: Column) -> Column:
    return F.transform(c, lambda e: e.withField("start_date", date(e["start_date"])).withField("end_date", date(e["end_date"])))


def country(c: Column, table: dict[str, str] = d.COUNTRIES) -> Column:
    """ISO 3166 alpha-2 code of a country name or abbreviation, or null."""
    return lookup(table, F.lower(strip(c)))


def location(c: Column, prefer_us_state: bool = False) -> Column:
    """struct<city, region, country_code, raw>.

    A country is looked for before a US state, so ``San Francisco, CA`` is in Canada; ``prefer_us_state`` turns the two round where
    two parts are given.
    """
    text = let(filled(c), lambda t: F.struct(t.alias("text"), c.alias("raw"), split_filled(t, ",").alias("parts")))
    return let(text, lambda x: _place(x, prefer_us_state))


def _place(x: Column, prefer_us_state: bool) -> Column:
    text, parts = x["text"], x["parts"]
    n, first, second = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    none = F.lit(None).cast("string")

    def made(city, region, code):
        return F.struct(city.alias("city"), region.alias("region"), code.alias("country_code"), x["raw"].alias("raw"))

    def one(words: Column) -> Column:
        """One part: its last word as a country, all of it as a country, a known city, or just a name."""
        by_word, whole = words["code"], country(text)
        named = F.when(whole.isNotNull(), made(none, none, whole)).otherwise(made(text, none, lookup(d.CITIES, F.lower(text))))
        return F.when(by_word.isNotNull(), made(words["head"], none, by_word)).otherwise(named)

    names = {v.lower(): k.upper() for k, v in d.US_STATES.items()}

    def more(last: Column) -> Column:
        """Several parts: the last one as a country, a state's abbreviation or name; else the first as a known city."""
        low, code = F.lower(last), country(last)
        as_country = F.when(code.isNotNull(), made(first, F.when(n >= 3, second), code))
        as_state = made(first, F.upper(last), F.lit("US"))
        is_state = lookup(d.US_STATES, low).isNotNull()
        rules = F.when(is_state & (n == 2), as_state).when(code.isNotNull(), as_country) if prefer_us_state else F.when(code.isNotNull(), as_country)
        city = lookup(d.CITIES, F.lower(first))
        return rules.when(is_state, as_state).when(lookup(names, low).isNotNull(), made(first, lookup(names, low), F.lit("US"))).when(city.isNotNull(), made(first, second, city)).otherwise(made(first, last, none))

    ends = r"(?Us)^(.*\S)\s+(\S+)$"
    words = F.struct(strip(capture(text, ends, 1)).alias("head"), country(capture(text, ends, 2)).alias("code"))
    return F.when(text.isNull(), made(none, none, none)).when(n <= 1, let(words, one)).otherwise(let(F.try_element_at(parts, F.lit(-1)), more))


def location_text(c: Column, prefer_us_state: bool = False) -> Column:
    """``city, region, CC`` where a country was found; otherwise the text as it was."""
    shown = lambda p: F.concat_ws(", ", F.nullif(p["city"], F.lit("")), F.nullif(p["region"], F.lit("")), p["country_code"])
    return let(location(c, prefer_us_state), lambda p: F.when(p["country_code"].isNotNull(), shown(p)).otherwise(p["raw"]))


def skill(c: Column, table: dict[str, str] = d.SKILLS) -> Column:
    """Canonical name of a skill; unknown ones in title case; null for blanks."""
    return let(filled(c), lambda text: F.coalesce(lookup(table, F.lower(text)), title_case(text)))


def skills(c: Column, table: dict[str, str] = d.SKILLS) -> Column:
    found = F.transform(F.coalesce(c, F.array().cast(STRINGS)), lambda x: skill(x, table))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def normalize(records: DataFrame, region_code: str = "1", prefer_us_state: bool = False) -> DataFrame:
    """Standardize every field of raw records; links, education and metadata stay as they are."""
    return records.withColumns(
        {
            "full_name": strip(F.col("full_name")),
            "emails": emails(F.col("emails")),
            "phones": phones(F.col("phones"), region_code),
            "location": location_text(F.col("location"), prefer_us_state),
            "skills": skills(F.col("skills")),
            "experience": experience_dates(F.col("experience")),
            "current_company": strip(F.col("current_company")),
            "current_title": strip(F.col("current_title")),
        }
    )

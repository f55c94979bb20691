"""Standardizers, table by table."""

import pytest
from pyspark.sql import functions as F

from goldlink.functions import normalize as nz
from goldlink.functions.text import strip, title_case


def apply(spark, make, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


PHONES = [
    ("(212) 555-0142", "+12125550142"), ("212-555-0142", "+12125550142"), ("212.555.0142", "+12125550142"), ("2125550142", "+12125550142"), ("+1 212 555 0142", "+12125550142"),
    ("+12125550142", "+12125550142"), ("1-212-555-0142", "+12125550142"), ("+91-80123-45678", "+918012345678"), ("+44 20 7123 4567", "+442071234567"), ("+44 (0)20 7123 4567", "+442071234567"),
    ("  (212) 555-0142\t", "+12125550142"), ("(212) 555-0142 ext. 7", "+12125550142"), ("555-0142", "+15550142"), ("1-800-FLOWERS", "+18003569377"), ("011 44 20 7123 4567", "+442071234567"),
    (None, None), ("", None), ("   ", None), ("not-a-phone", None), ("abc", None), ("12", None), ("123456", None), ("+0 123 4567", None), ("21255501429999", None),
]


def test_phone(spark):
    assert apply(spark, nz.phone, [p for p, _ in PHONES]) == [e for _, e in PHONES]


def test_phone_list(spark):
    got = apply(spark, nz.phones, [["(212) 555-0142", "x", None, "+12125550142", "+91-80123-45678"], [], None], "array<string>")
    assert got == [["+12125550142", "+918012345678"], [], []]


DATES = [
    ("January 2022", "2022-01"), ("Jan 2022", "2022-01"), ("december 2023", "2023-12"), ("Feb. 2024", "2024-02"), ("01/2022", "2022-01"), ("1/2022", "2022-01"), ("12-2023", "2023-12"), ("06.2024", "2024-06"),
    ("2022-01-15", "2022-01"), ("2022-01", "2022-01"), ("2022", "2022"), (" 2022 ", "2022"), ("Present", "Present"), ("current", "Present"), ("Now", "Present"), ("ONGOING", "Present"), ("from March 2021 on", "2021-03"),
    (None, None), ("", None), ("  ", None), ("garbage", None), ("Sept 2022", None), ("01/15/2022", None), ("13/2022", None), ("20222", None),
]


def test_date(spark):
    assert apply(spark, nz.date, [x for x, _ in DATES]) == [e for _, e in DATES]


def test_experience_dates(spark):
    kind = "array<struct<company:string,title:string,start_date:string,end_date:string>>"
    got = apply(spark, nz.experience_dates, [[("A", "B", "Jan 2020", "Present"), ("C", None, "?", None)], [], None], kind)
    assert [(e.start_date, e.end_date) for e in got[0]] == [("2020-01", "Present"), (None, None)] and got[1:] == [[], None]


def test_country(spark):
    cases = [("United States", "US"), (" usa ", "US"), ("U.K.", "GB"), ("India", "IN"), ("in", "IN"), ("South Korea", "KR"), ("Atlantis", None), ("", None), (None, None)]
    assert apply(spark, nz.country, [x for x, _ in cases]) == [e for _, e in cases]


LOCATIONS = [
    ("Boston, US", ("Boston", None, "US")), ("Mumbai, India", ("Mumbai", None, "IN")), ("Boston, Massachusetts", ("Boston", "MA", "US")), ("New York, NY", ("New York", "NY", "US")), ("Boston US", ("Boston", None, "US")),
    ("Pune", ("Pune", None, "IN")), ("India", (None, None, "IN")), ("San Francisco, CA", ("San Francisco", None, "CA")), ("Austin, Texas, USA", ("Austin", "Texas", "US")), ("a, b, c, France", ("a", "b", "FR")),
    ("Paris, Somewhere", ("Paris", "Somewhere", "FR")), ("Nowhere, Else", ("Nowhere", "Else", None)), ("Nowhere", ("Nowhere", None, None)), ("United States of America", ("United States of", None, "US")),
    (None, (None, None, None)), ("", (None, None, None)), (" , ", (None, None, None)),
]


def test_location(spark):
    got = apply(spark, nz.location, [x for x, _ in LOCATIONS])
    # a lone comma keeps its text as the city; only the country matters there
    assert [(g.city, g.region, g.country_code) for g in got[:-1]] == [e for _, e in LOCATIONS[:-1]] and got[-1].country_code is None


def test_location_text_and_state_first(spark):
    assert apply(spark, nz.location_text, [" Boston, Massachusetts", "  Nowhere ", None, "India"]) == ["Boston, MA, US", "  Nowhere ", None, "IN"]
    assert apply(spark, lambda c: nz.location_text(c, True), ["San Francisco, CA", "Toronto, Canada"]) == ["San Francisco, CA, US", "Toronto, CA"]


SKILLS = [
    ("ML", "Machine Learning"), ("Machine-Learning", "Machine Learning"), ("Python3", "Python"), ("reactjs", "React"), ("React.js", "React"), ("JS", "JavaScript"), ("k8s", "Kubernetes"), (" sklearn ", "scikit-learn"), ("c++", "C++"),
    ("basket-weaving-3d", "Basket-Weaving-3D"), ("skill2x iOS", "Skill2X Ios"), ("éTÉ", "Été"), (None, None), ("", None), ("\t ", None),
]


def test_skill(spark):
    assert apply(spark, nz.skill, [x for x, _ in SKILLS]) == [e for _, e in SKILLS]


def test_skill_list(spark):
    assert apply(spark, nz.skills, [["ML", "Python", "machine learning", "", None, "SomeFramework"], []], "array<string>") == [["Machine Learning", "Python", "Someframework"], []]


def test_emails_keep_repeats(spark):
    assert apply(spark, nz.emails, [[" A@B.co ", "a@b.CO", " ", "bad"], None], "array<string>") == [["a@b.co", "a@b.co", "bad"], []]


@pytest.mark.parametrize("text,want", [(" \t x y \n", "x y"), ("", ""), (" ", "")])
def test_strip(spark, text, want):
    assert apply(spark, strip, [text]) == [want]


def test_title_case(spark):
    assert apply(spark, title_case, ["o'neil mcdonald 3d", None]) == ["O'Neil Mcdonald 3D", None]


def test_standardizing_twice_changes_nothing(spark):
    phones = [p for _, p in PHONES if p and len(p) > 9]
    assert apply(spark, nz.phone, phones) == phones
    dates = [e for _, e in DATES if e]
    assert apply(spark, nz.date, dates) == dates
    skills = [e for _, e in SKILLS if e]
    assert apply(spark, nz.skill, skills) == skills
    places = ["Boston, US", "Pune, IN", "Austin, Texas, US", "San Francisco, CA", "Nowhere, Else"]
    once = apply(spark, nz.location_text, places)
    assert apply(spark, nz.location_text, once) == once

"""Components, resolution, merging and scoring against local versions."""

import random

import pytest

from goldlink.functions.normalize import normalize
from goldlink.operators import components
from goldlink.operators.components import connected_components
from goldlink.operators.merge import merge
from goldlink.operators.resolve import resolve_entities, star_edges
from goldlink.operators.score import score
from goldlink.plans.policy import EnginePolicy
from goldlink.plans.schema import RECORD


def record(i, source="csv", **fields):
    base = {"record_id": i, "source_type": source, "source_path": f"{source}.x", "position": i, "full_name": None, "emails": [], "phones": [], "location": None, "skills": [], "experience": [], "education": [], "current_company": None, "current_title": None, "links": [], "raw_metadata": None}
    return tuple({**base, **fields}[c.split()[0]] for c in RECORD.split(", ") if c.split()[0] in base)


def frame(spark, *records):
    return spark.createDataFrame(list(records), RECORD)


def profiles(spark, *records, policy=EnginePolicy()):
    return {r["cluster_id"]: r for r in score(merge(resolve_entities(frame(spark, *records)), policy), policy).collect()}


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("seed,n,m,local", [(1, 60, 40, 0), (2, 200, 260, 0), (3, 50, 400, 0), (1, 60, 40, 1000), (4, 300, 330, 1000)])
def test_components_random(spark, monkeypatch, seed, n, m, local):
    monkeypatch.setattr(components, "LOCAL", local)
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    want = union_find(n, edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


def test_components_with_written_minima(spark, monkeypatch):
    monkeypatch.setattr(components, "SMALL", 0)
    monkeypatch.setattr(components, "LOCAL", 0)
    rng = random.Random(9)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(80)] + [(0, i) for i in range(60, 90)]
    want = union_find(90, edges)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {i: want[i] for i in {x for a, b in edges if a != b for x in (a, b)}}


@pytest.mark.parametrize("local", [0, 1000])
def test_components_shapes(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    path = [(i, i + 1) for i in range(120)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path + star + [(5, 5), (None, 3)], "src bigint, dst bigint")).collect()}
    assert {got[i] for i in range(121)} == {0} and {got[1000 + i] for i in range(80)} == {1000}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_resolution(spark):
    df = frame(
        spark,
        record(1, emails=["a@x.co"]), record(2, emails=[" A@X.co"], phones=["+15550001111"]), record(3, phones=["+15550001111"]), record(4, emails=["b@x.co", "c@x.co"]), record(5, emails=["c@x.co"]),
        record(6, full_name="same"), record(7, full_name="same"), record(8, emails=["+15550001111"]), record(9, emails=["", " "]), record(10, emails=None, phones=None),
    )
    assert {r["record_id"]: r["cluster_id"] for r in resolve_entities(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10}
    assert resolve_entities(df.limit(0)).count() == 0


def test_a_key_that_everyone_shares_stays_linear(spark):
    df = frame(spark, *[record(i, phones=["+15550001111"]) for i in range(300)])
    assert star_edges(df).count() == 299
    assert {r["cluster_id"] for r in resolve_entities(df).collect()} == {0}


def test_scalar_rules(spark):
    mail = {"emails": ["k@x.co"]}
    one = profiles(spark, record(1, full_name="Ann", **mail))[1]
    assert (one.full_name.value, one.full_name.confidence, one.full_name.provenance[0].method) == ("Ann", 0.8, "direct")
    agree = profiles(spark, record(1, "csv", full_name="ann ", **mail), record(2, "ats_json", full_name="Ann", **mail))[1].full_name
    assert (agree.value, agree.confidence, agree.provenance[0].method, agree.provenance[0].source_type) == ("Ann", 0.9 + 0.05, "agreement", "ats_json")
    conflict = profiles(spark, record(1, "csv", full_name="Annabelle", **mail), record(2, "ats_json", full_name="Ann", **mail), record(3, "csv", full_name="Annabelle", **mail))[1].full_name
    assert (conflict.value, conflict.confidence, conflict.provenance[0].method, len(conflict.provenance)) == ("Ann", 0.9, "trust_weight", 1)
    tie = profiles(spark, record(1, full_name="Ann", **mail), record(2, full_name="Anna B", **mail), record(3, full_name="Anna C", **mail))[1].full_name
    assert tie.value == "Anna B"
    none = profiles(spark, record(1, full_name=" ", **mail))[1].full_name
    assert (none.value, none.confidence, none.provenance) == (None, 0.0, [])
    odd = profiles(spark, record(1, "other", full_name="X", **mail), record(2, "recruiter_notes", full_name="Y", **mail))[1].full_name
    assert (odd.value, odd.confidence) == ("Y", 0.5)
    many = profiles(spark, *[record(i, "ats_json", full_name="A", **mail) for i in range(10)])[0].full_name
    assert many.confidence == 1.0


def test_list_rules(spark):
    a = record(1, "csv", emails=["K@x.co"], skills=["Go", "SQL"], links=["http://b"])
    b = record(2, "ats_json", emails=["k@x.co", "z@x.co"], skills=["sql", " "], links=[])
    c = record(3, "resume_pdf", emails=["k@x.co"], skills=[" "])
    p = profiles(spark, a, b, c)[1]
    assert p.emails.value == ["k@x.co", "z@x.co"] and p.emails.confidence == 1.0 and [x.source_type for x in p.emails.provenance] == ["ats_json", "csv", "resume_pdf"]
    assert p.skills.value == ["sql", "Go"] and p.skills.provenance[0].original_value == ["sql", " "] and p.skills.confidence == 0.9 + 0.05
    assert p.links.value == ["http://b"] and p.links.confidence == 0.8 and p.phones.value == [] and p.phones.provenance == []
    assert p.sources_used == ["csv.x", "ats_json.x", "resume_pdf.x"]


def test_collections(spark):
    mail = {"emails": ["k@x.co"]}
    a = record(1, "csv", experience=[("acme ", "DEV", "2020-01", None), ("", "", "2019-01", None)], education=[("MIT", "BS", "2019"), (None, None, "1")], **mail)
    b = record(2, "ats_json", experience=[("Acme", "dev", "2021-02", "Present"), ("B", None, None, None)], education=[("mit", "bs ", "2020"), ("MIT", "MS", None)], **mail)
    p = profiles(spark, a, b)[1]
    assert [(e.company, e.start_date) for e in p.experience.value] == [("Acme", "2021-02"), ("B", None)]
    assert [(e.institution, e.degree, e.year) for e in p.education.value] == [("mit", "bs ", "2020"), ("MIT", "MS", None)]
    assert len(p.experience.provenance) == 2 and p.education.confidence == 0.9 + 0.05


def test_penalties_and_overall(spark):
    p = profiles(spark, record(1, "ats_json", full_name="A", emails=["bad", "a@x.co"], phones=["12", "+15550001111"], experience=[("A", "B", "2022", "Present"), ("C", "D", "2020-01", "nope")]))[1]
    assert p.emails.confidence == pytest.approx(0.85) and p.phones.confidence == pytest.approx(0.8) and p.experience.confidence == pytest.approx(0.8333, abs=1e-4)
    want = (0.9 * 2 + 0.85 * 2 + 0.8 * 1.5 + round(0.9 - 0.1 * 2 / 3, 4)) / 6.5
    assert p.overall_confidence == pytest.approx(want, abs=1e-4)
    alone = profiles(spark, record(1, skills=["Go"]))[1]
    assert alone.overall_confidence == pytest.approx(0.8 * 1.5 / 5.5, abs=1e-4)
    assert profiles(spark, record(1))[1].overall_confidence == 0.0


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(4)
    rows = [record(i, rng.choice(["csv", "ats_json", "resume_pdf"]), full_name=rng.choice(["Al", "Bo", "Cleo"]), emails=[f"u{i % 7}@x.co"], skills=rng.sample(["Go", "SQL", "R"], 2)) for i in range(40)]
    a = profiles(spark, *rows)
    rng.shuffle(rows)
    assert a == profiles(spark, *rows)


def test_policy_is_checked():
    with pytest.raises(ValueError):
        EnginePolicy(criticality={"age": 1.0})
    with pytest.raises(ValueError):
        EnginePolicy(trust={"csv": 2.0})


def test_normalize_end_to_end(spark):
    df = normalize(frame(spark, record(1, full_name=" A ", emails=[" X@Y.co"], phones=["212-555-0142"], location="Boston US", skills=["ml"], current_title=" t ")))
    r = df.collect()[0]
    assert (r.full_name, r.emails, r.phones, r.location, r.skills, r.current_title) == ("A", ["x@y.co"], ["+12125550142"], "Boston, US", ["Machine Learning"], "t")

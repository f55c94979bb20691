"""Projection, validation, sources, sinks and the command line."""

import json

import pytest

from goldlink.__main__ import main
from goldlink.operators.merge import merge
from goldlink.operators.project import project
from goldlink.operators.resolve import resolve_entities
from goldlink.operators.score import score
from goldlink.operators.validate import validate
from goldlink.plans import pipeline
from goldlink.plans.policy import ProjectionConfig
from goldlink.sources import delimited, documents, registry, semistructured
from tests.test_linkage import frame, record


def scored(spark, *records):
    return score(merge(resolve_entities(frame(spark, *records))))


def config(*fields, **rest):
    return ProjectionConfig.of({"fields": [{"source_field": f[0], "output_field": f[1], **(f[2] if len(f) > 2 else {})} for f in fields], **rest})


def out(df):
    return [json.loads(r["output"]) for r in df.orderBy("cluster_id").collect()]


def test_rename_rich_and_order(spark):
    p = scored(spark, record(1, full_name="Zoë \"Q\"", emails=["a@x.co"], experience=[("A", "B", "2020-01", None)]))
    c = config(("emails", "mail", {"include_confidence": True, "include_provenance": "yes"}), ("full_name", "name"), ("experience", "jobs"), ("location", "where", {"include_confidence": True}))
    done, rejects = project(p, c, ["bad.txt"])
    got = out(done)[0]
    assert list(got) == ["mail", "name", "jobs", "where", "overall_confidence", "_metadata"]
    assert got["mail"] == {"value": ["a@x.co"], "confidence": 0.8, "provenance": [{"field": "emails", "source_type": "csv", "source_path": "csv.x", "original_value": ["a@x.co"], "method": "union"}]}
    assert got["name"] == 'Zoë "Q"' and got["jobs"] == [{"company": "A", "title": "B", "start_date": "2020-01", "end_date": None}] and got["where"] is None
    assert got["_metadata"]["sources_failed"] == ["bad.txt"] and rejects.count() == 0


def test_missing_policies(spark):
    p = scored(spark, record(1, full_name="A", emails=["a@x.co"]), record(2, emails=["b@x.co"]))
    fields = (("full_name", "name"), ("nothing", "n"))
    flags = {"include_metadata": False, "include_overall_confidence": False}
    assert out(project(p, config(*fields, on_missing="null", **flags))[0]) == [{"name": "A", "n": None}, {"name": None, "n": None}]
    assert out(project(p, config(*fields, on_missing="omit", **flags))[0]) == [{"name": "A"}, {}]
    done, rejects = project(p, config(fields[0], on_missing="error", **flags))
    assert out(done) == [{"name": "A"}] and "full_name" in rejects.collect()[0]["message"]


def test_repeated_output_name_takes_the_last(spark):
    p = scored(spark, record(1, full_name="A", emails=["a@x.co"]))
    got = out(project(p, config(("full_name", "x"), ("links", "l"), ("emails", "x"), include_metadata=False))[0])[0]
    assert list(got) == ["x", "l", "overall_confidence"] and got["x"] == ["a@x.co"]


def test_validation(spark):
    p = scored(spark, record(1, full_name="A", emails=["bad", "a@x.co"], phones=["12"]))
    c = config(("emails", "contact_emails"), ("phones", "phones", {"include_confidence": True}), ("full_name", "_email"), include_metadata=False)
    row = validate(project(p, c)[0], c).collect()[0]
    assert [(i.field, i.severity) for i in row["issues"]] == [("contact_emails[0]", "warning"), ("phones[0]", "warning")] and row["is_valid"]
    assert json.loads(row["output"])["_validation"]["warning_count"] == 2
    assert not validate(project(p, c)[0], c, strict=True).collect()[0]["is_valid"]
    clean = config(("full_name", "name"), include_metadata=False)
    good = validate(project(p, clean)[0], clean).collect()[0]
    assert "_validation" not in json.loads(good["output"]) and good["is_valid"] and good["issues"] == []
    broken = project(p, c)[0].withColumn("overall_confidence", project(p, c)[0]["overall_confidence"] + 1)
    assert any(i.field == "overall_confidence" for i in validate(broken, c).collect()[0]["issues"])


@pytest.mark.parametrize("bad", [{}, {"fields": []}, {"fields": [{"source_field": "a"}]}, {"fields": [{"source_field": "id", "output_field": "x"}]}, {"fields": [{"source_field": "links", "output_field": "x"}], "on_missing": "drop"}, {"fields": [{"source_field": "links", "output_field": "x", "include_confidence": "perhaps"}]}])
def test_bad_configs(bad):
    with pytest.raises(ValueError):
        ProjectionConfig.of(bad)


CSV = 'Name,E-mail,Employer,Mobile,skills,City,extra,employer\nAda Byte," ADA@x.co ",Acme,212-555-0142,"Go, ml,,SQL",Boston US,?,\n\n,,Nobody,,,,,\n"Quo ""T"", Jr.",,First,,,,,Last\nShort,s@x.co\n'


def read(spark, folder, **options):
    paths = registry.discover(spark, f"file://{folder}")
    records, failed = registry.extract(spark, paths, **options)
    return {r["full_name"] or r["emails"][0]: r for r in records.collect()}, [p.rsplit("/", 1)[-1] for p in failed]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + CSV.encode())
    (tmp_path / "bad.csv").write_bytes(b"name\n\xff\xfe\xff\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.CSV").write_text("name,email\n")
    (tmp_path / "skip.xyz").write_text("x")
    got, failed = read(spark, tmp_path)
    assert set(got) == {"Ada Byte", 'Quo "T", Jr.', "Short"} and failed == ["bad.csv"]
    ada = got["Ada Byte"]
    assert (ada.emails, ada.phones, ada.skills, ada.location, ada.current_company, ada.source_type) == (["ADA@x.co"], ["212-555-0142"], ["Go", "ml", "SQL"], "Boston US", "Acme", "csv")
    assert got['Quo "T", Jr.'].current_company == "Last" and json.loads(ada.raw_metadata)["original_row"]["extra"] == "?"
    assert ada.record_id < got["Short"].record_id
    assert delimited.read(spark, [f"file:{tmp_path}/a.csv"], strict=True)[0].count() == 0


def test_many_csv_files_are_one_plan(spark, tmp_path):
    for i in range(40):
        head, cell = [("name,email", f"N{i},e{i}@x.co"), ("E-MAIL,id,Full Name", f"e{i}@x.co,7,N{i}"), ('"na""me",mail', f"?,e{i}@x.co")][i % 3]
        (tmp_path / f"f{i:02d}.csv").write_text(f"{head}\n{cell}\n,\nSecond,,Second\n")
    records, failed = registry.extract(spark, registry.discover(spark, f"file://{tmp_path}"))
    rows = sorted(records.collect(), key=lambda r: r["record_id"])
    assert failed == [] and [r["emails"] for r in rows if r["emails"] and r["emails"][0] != "Second"] == [[f"e{i}@x.co"] for i in range(40)]
    assert {(r["record_id"] >> registry.FILE_BITS) for r in rows} == set(range(40)) and max(r["position"] for r in rows) == 3


def test_json(spark, tmp_path):
    people = [
        {"applicant_name": "", "name": "Ann", "contact": {"email": " a@x.co ", "phone": 2125550142}, "skills_list": [], "skills": "Go, SQL", "location": {"city": "Rome", "state": "", "country": "Italy"}, "position_applied": "Dev", "title": "Old", "linkedin": " l ", "links": ["m", None, 3]},
        {"full_name": "Bob", "contact": None, "email": ["b@x.co", 4], "phone": ["1", 2], "experience": [{"organization": "O", "position": "P", "from": "2020", "to": "2021"}, "x"], "education": [{"university": "U", "qualification": "BS", "year": 2019}]},
        {"contact": "text", "skills": ["Go"]}, "junk", 7, {"email": "only@x.co"}, {"name": 5, "email": "n@x.co"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(people))
    (tmp_path / "b.json").write_text(json.dumps({"candidate_name": "Cy"}))
    for name, text in (("c", "null"), ("d", "42"), ("e", ""), ("f", "{broken")):
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "g.json").write_bytes(b'[{"name": "L\xff"}]')
    (tmp_path / "h.json").write_text('{"name": "A", "email": "a@x.co", "name": "Dup", "phone": 2125550142.7, "x": NaN}')
    (tmp_path / "i.json").write_text('[{"name": "Tail"}] {')
    got, failed = read(spark, tmp_path)
    assert set(got) == {"Ann", "Bob", "only@x.co", "Cy", "Dup"} and failed == ["f.json", "g.json", "i.json"]
    assert got["Dup"].phones == ["2125550142"] and got["Dup"].emails == ["a@x.co"]
    ann, bob = got["Ann"], got["Bob"]
    assert (ann.emails, ann.phones, ann.skills, ann.location, ann.current_title, ann.links) == (["a@x.co"], ["2125550142"], ["Go", "SQL"], "Rome, Italy", "Dev", ["l", "m", "3"])
    assert bob.emails == ["b@x.co"] and bob.phones == ["1", "2"] and tuple(bob.experience[0]) == ("O", "P", "2020", "2021") and tuple(bob.education[0]) == ("U", "BS", "2019")
    assert ann.record_id < bob.record_id < got["Cy"].record_id


NOTES = "Heading\n=======\nAnn Lee:\nann@x.co\n(212) 555-0142\nWorks at Acme.\nrole: Lead\nFrom Paris\nStack; Go, SQL / R\nsee https://x.co/a 12\r\n---\n\nbob@x.co\nnothing else\n***\n \n"


def test_json_comes_in_pieces():
    people = [{"name": f"N{i}", "note": 'a "quoted" ]}, {[ text \\\\', "n": i * 1.5} for i in range(300)] + [1234567, "x", None, [1], {}]
    for indent in (None, 1):
        text = json.dumps(people, indent=indent)
        for size in (1, 7, 1000, len(text)):
            splitter, got = semistructured.Splitter(), []
            for at in range(0, len(text), size):
                got += splitter.feed(text[at : at + size])
            got += splitter.feed("", last=True)
            assert [i for i, _ in got] == [*range(300), 304] and [json.loads(x) for _, x in got] == [*people[:300], {}]
    for bad in ("[{}", "[{} {}]", "[,]", "[{},]", "{} {}", "[1 2]", '{"a": }'):
        splitter = semistructured.Splitter()
        with pytest.raises(ValueError):
            list(splitter.feed(bad)), list(splitter.feed("", last=True))


def test_a_large_array_keeps_all_rows(spark, tmp_path):
    one = json.dumps({"name": "N", "email": "e@x.co", "skills": ["s" * 900, "t" * 900]})
    (tmp_path / "big.json").write_text("[" + ",".join([one] * 12_000) + "]")
    records, failed = registry.extract(spark, registry.discover(spark, f"file://{tmp_path}"))
    assert failed == [] and records.count() == 12_000


def test_notes(spark, tmp_path):
    (tmp_path / "n.txt").write_text(NOTES)
    (tmp_path / "l.txt").write_bytes("Zoé\nz@x.co\n\n\n\nYann\ny@x.co\n".encode("latin-1"))
    assert read(spark, tmp_path) == ({}, ["l.txt", "n.txt"])
    got, failed = read(spark, tmp_path, enable_notes=True)
    assert failed == [] and set(got) == {"Heading", "Ann Lee", "nothing else", "Zoé", "Yann"}
    ann = got["Ann Lee"]
    assert (ann.emails, ann.phones, ann.current_company, ann.current_title, ann.location, ann.skills, ann.links) == (["ann@x.co"], ["(212) 555-0142"], "Acme", "Lead", "Paris", ["Go", "SQL", "R"], ["https://x.co/a"])
    kept, _ = documents.read_notes(spark, [f"file://{tmp_path}/n.txt"], require_key=True)
    assert {r["full_name"] for r in kept.collect()} == {"Ann Lee", "nothing else"}


RESUME = """CV
ann@x.co
Ann Lee
Austin, TX +1 212 555 0142

Experience
Acme — Lead Dev  Jan 2020 – Present
built much
Skills
old
EDUCATION:
State University 2010
BS Physics
2012
Tech College
Work experience:
Beta, Analyst
2015 - 2017
Technical Skills
- Go, SQL | R; a very long thing of words
This line is a sentence that goes on for far too many words to be any list of skills at all
"""


def test_resume_text(spark):
    from goldlink.operators.extract import parse_resumes

    df = spark.createDataFrame([("r", RESUME), ("blank", " \n")], "source_path string, text string")
    got = parse_resumes(df).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.full_name, r.emails, r.location, r.skills) == ("Ann Lee", ["ann@x.co"], "Austin, TX +1 212 555 0142", ["Go", "SQL"])
    assert [tuple(e) for e in r.experience] == [("Beta", "Analyst", "", ""), ("", "", "2015", "2017")] and r.current_company == "Beta"
    assert [tuple(e) for e in r.education] == [("State University 2010", "BS Physics", "2012"), ("Tech College", "", "")]


def test_unreadable_pdf_gives_nothing(spark, tmp_path):
    (tmp_path / "r.pdf").write_bytes(b"%PDF-1.4 nothing")
    assert read(spark, tmp_path) == ({}, ["r.pdf"])


def test_run_and_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(CSV)
    (folder / "b.json").write_text(json.dumps([{"name": "Ada B. Byte", "contact": {"email": "ada@x.co"}, "skills": ["python3"]}]))
    (folder / "n.txt").write_text(NOTES)
    fields = [{"source_field": f, "output_field": f} for f in ("full_name", "emails", "phones", "skills")]
    (tmp_path / "c.json").write_text(json.dumps({"fields": fields, "extra": 1}))
    made = pipeline.run(spark, f"file://{folder}", ProjectionConfig.load(str(tmp_path / "c.json")))
    got = out(made.validated)
    assert [g["full_name"] for g in got] == ["Ada B. Byte", 'Quo "T", Jr.', "Short"] and got[0]["skills"] == ["Python", "Go", "Machine Learning", "SQL"]
    assert got[0]["_metadata"]["sources_failed"] == [f"file:{folder}/n.txt"] and got[1]["emails"] is None
    assert main(["--input-dir", str(folder), "--config", str(tmp_path / "c.json"), "--output-dir", str(tmp_path / "o")]) == 0
    written = json.loads((tmp_path / "o" / "all_candidates.json").read_text())
    assert len(written) == 3 and json.loads((tmp_path / "o" / "candidate_1.json").read_text()) == written[0]
    (tmp_path / "bad.json").write_text("{}")
    assert main(["--input-dir", str(folder), "--config", str(tmp_path / "bad.json")]) == 1
    (tmp_path / "none").mkdir()
    assert main(["--input-dir", str(tmp_path / "none"), "--config", str(tmp_path / "c.json")]) == 1
    assert main(["--input-dir", str(folder), "--config", str(tmp_path / "c.json"), "--output-dir", str(tmp_path / "l"), "--format", "lines"]) == 0

import re
import time

from goldlink.llm import licenses
from tests.llm.helpers import SF, edge_documents, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_against_brute_force(spark):
    extra = spark.createDataFrame(
        [(900, "The MIT-License; (GNU General\nPublic License) and Apache License, mit license"), (901, "mit licensed mitlicense MIT, License"), (902, "mit mit license license apache licence"), (903, "MITé license")],
        "doc_id bigint, text string",
    )
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(edge_documents(spark).select("doc_id", "text")).unionByName(extra)
    want = sorted(((r["doc_id"] or -1, *brute(r["text"])) for r in rows(docs)), key=repr)
    got = rows(licenses.op5_licenses(docs))
    assert want == sorted(((r["doc_id"] or -1, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=repr)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert licenses.op5_licenses(docs.limit(0)).count() == 0


def test_expressions():
    post = lambda s: licenses.shunting_yard(licenses.tokenize_expression(s, 0))
    assert post("MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert post("(MIT OR GPL-2.0+) AND ISC") == ["MIT", "GPL-2.0+", "or", "ISC", "and"]
    assert post("GPL-2.0 WITH Classpath-exception-2.0 OR MIT") == ["GPL-2.0", "Classpath-exception-2.0", "with", "MIT", "or"]
    assert post("MIT and more words") == ["MIT", "more", "and"]
    for bad in ("", "OR MIT", "(MIT", "MIT AND", "()"):
        assert post(bad) is None
    assert licenses.evaluate(post("MIT OR GPL-2.0")) == (["mit", "gpl"], True)
    assert licenses.evaluate(post("MIT AND GPL-2.0"))[1] is False
    got = licenses.Scanner().scan("x\n# SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nSPDX-License-Identifier: AND\n")
    assert got[5] == "gpl,mit,spdx-invalid,spdx-permissive" and got[1] == 0
    assert licenses.evaluate(post("GPL-2.0 WITH (A OR B) AND MIT")) == (["gpl", "mit"], False)
    for name, label in (("MIT-anything", licenses.UNKNOWN), ("isc-x", licenses.UNKNOWN), ("LicenseRef-mine", licenses.CUSTOM)):
        assert licenses.evaluate(post(name)) == ([label], False)


def test_long_texts_take_linear_time():
    start = time.time()
    got = licenses.Scanner().scan("mit license " * 80_000)
    assert got[1:4] == (80_000, 0, 159_998)
    assert licenses.Scanner().scan("SPDX-License-Identifier: " + " OR ".join(["MIT"] * 50_000))[5] == "mit,spdx-permissive"
    assert licenses.Scanner().scan("SPDX-License-Identifier: (MIT\n" * 20_000)[5] == "spdx-invalid"
    assert time.time() - start < 10


def test_labels_and_score_against_their_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for r, d in zip(sorted(rows(licenses.op5_licenses(docs)), key=lambda x: x["doc_id"]), sorted(rows(docs), key=lambda x: x["doc_id"]), strict=True):
        line = f" {' '.join(WORD.findall(re.sub('[A-Z]', lambda m: m[0].lower(), d['text'] or '')))} "
        want = {label for phrase, label in {**licenses.BASE, **licenses.MORE}.items() if f" {phrase} " in line}
        found = set(filter(None, r["labels"].split(",")))
        tagged = "spdx-license-identifier:" in (d["text"] or "").lower()
        assert want == found or (tagged and want < found)
        doubt = 1.0
        for label in found:
            doubt *= 1 - licenses.WEIGHT.get(label, 0.8)
        assert abs(r["score"] - (1 - doubt)) < 1e-9

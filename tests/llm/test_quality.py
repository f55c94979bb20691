import re
from collections import Counter

import numpy as np

from goldlink.llm import quality
from goldlink.llm.common import content_hashes
from tests.llm.helpers import edge_documents, rows

BIG = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    model = quality.fit(docs, train, most_labelled=1500)
    scored = {r["doc_id"]: r for r in rows(quality.classify(docs.join(test.select("doc_id"), "doc_id", "left_semi"), model))}
    pairs = [(scored[r["doc_id"]]["quality_keep"], r["quality"]) for r in rows(test)]
    good = [k for k, q in pairs if q == 1]
    bad = [k for k, q in pairs if q == 0]
    assert np.mean(good) >= 0.995 and np.mean(bad) <= 0.1
    assert all(0 <= r["quality_score"] <= 1 for r in scored.values())


def test_edges_and_degenerate_labels(spark):
    docs = edge_documents(spark).withColumnRenamed("taken", "quality_score")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (99, 0, 0), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model.constant == 1.0
    got = quality.classify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "quality_score", "quality_keep"]
    assert all(r["quality_keep"] for r in rows(got)) and got.count() == docs.count()
    assert quality.fit(docs, labels.limit(0)).constant == 1.0
    both = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, 0)], labels.schema)
    assert len(rows(quality.op9_quality(docs, both))) == docs.count()
    assert quality.op9_quality(docs.limit(0), both).count() == 0


def test_views_exchange_labels():
    rng = np.random.default_rng(0)
    row = lambda y: [(np.array([y], dtype=np.int32), np.ones(1, dtype=np.float32)), (np.array([y if rng.random() < 0.9 else 1 - y], dtype=np.int32), np.ones(1, dtype=np.float32))]
    y = np.array([i % 2 for i in range(200)], dtype=float)
    model = quality.co_train([row(int(t)) for t in y], y, quality.ask_rows([row(i % 2) for i in range(200)]))
    agreed = lambda y: [(np.array([y], dtype=np.int32), np.ones(1, dtype=np.float32))] * 2  # noqa: E731 - drawn rows may have views that disagree
    assert model.score(agreed(1)) > 0.8 > 0.2 > model.score(agreed(0))
    assert abs(sum(model.share) - 1) < 1e-9 and model.share[0] > model.share[1]


def test_short_texts_stay_near_the_prior(spark):
    model = quality.fit(spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet"), most_labelled=1500)
    for text in ("One.", "Short one.", "", "A few clean words here."):
        assert model.score(quality.features(text, "en", "src0", len(text))) >= 0.5


def plain_features(text, lang, source, n_chars):
    """The content view, counted word by word."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    n, weight = len(words), {}
    for size, first, tokens, scale in ((quality.WORDS, quality.SHAPES, words, 0.5),):
        cells = Counter()
        for w in tokens:
            data = np.frombuffer(w, np.uint8)
            cells[first + int(content_hashes(data, np.array([0]), np.array([len(data)]))[0][0] % np.uint64(size))] += 1
        length = np.sqrt(sum(np.log1p(c) ** 2 for c in cells.values()))
        weight |= {i: np.log1p(c) / length * n / (n + 24) * scale for i, c in cells.items()}
    return weight


def test_features_and_scores_against_a_plain_version(spark):
    docs = rows(edge_documents(spark)) + rows(spark.read.parquet(f"{BIG}/documents.parquet").limit(40))
    columns = [[d[c] for d in docs] for c in ("text", "lang", "source", "n_chars")]
    together = [v.rows() for v in quality.views_of(*columns)]
    rng = np.random.default_rng(3)
    model = quality.Model([rng.normal(size=s) for s in quality.SIZES], [(1.5, 0.1), (0.5, -0.2)], [0.7, 0.3])
    scores = model.scores(quality.views_of(*columns))
    for i, d in enumerate(docs):
        alone = quality.features(*[c[i] for c in columns])
        for a, b in zip(alone, (together[0][i], together[1][i])):
            assert (np.sort(a[0]) == np.sort(b[0])).all() and abs(a[1].sum() - b[1].sum()) < 1e-4
        want = plain_features(*[c[i] for c in columns])
        got = {int(k): float(x) for k, x in zip(*alone[0]) if quality.SHAPES <= k < quality.SHAPES + quality.WORDS}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
        logit = sum(s * (a * sum(w[j] * x for j, x in zip(*v)) + b) for v, w, (a, b), s in zip(alone, model.weights, model.scale, model.share))
        assert abs(scores[i] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_pseudo_labels_come_from_the_whole_corpus(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet").limit(800), spark.read.parquet(f"{BIG}/labels.parquet")
    clean = labels.where("quality is not null")
    ask = quality.ask_corpus(docs, clean, seed=1)
    weights = [np.zeros(s) for s in quality.SIZES]
    weights[0][-1], weights[1][448] = 9.0, -9.0  # one view is sure of good, the other of bad, everywhere
    first = ask(weights, (3, 2), 0.95, [set(), set()])
    assert [len(x) for x in first] == [3, 2] and all(label == 1 - v for v in (0, 1) for _, _, label in first[v])
    known = {r[0] for r in clean.select("doc_id").collect()}
    assert not known & {i for x in first for i, _, _ in x}
    again = ask(weights, (3, 2), 0.95, [{i for i, _, _ in x} for x in first])
    assert not {i for i, _, _ in first[0]} & {i for i, _, _ in again[0]} and len(again[0]) == 3

import re

import pytest

from goldlink.llm import mixing
from tests.llm.helpers import SF, edge_documents, rows


def fill(sizes, weights, total, limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / w > limit * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / w for s in open_}
        for s in over:
            target[s] = limit * sizes[s]
            open_.discard(s)


def check(docs, got, block=16):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"] or -1, size(r["text"])) for r in docs) == sorted((r["doc_id"] or -1, r["size"]) for r in got)
    sizes = {}
    for r in docs:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    want = fill(sizes, (5, 2, 1), sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        # a block of rounding, and a short last block in each epoch
        assert abs(taken[s] - want[s]) <= 4 * block, (s, taken[s], want[s])


def test_targets_and_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rows(mixing.mix(docs))
    check(rows(docs), got)
    again = rows(mixing.mix(docs.repartition(5)))
    key = lambda x: sorted((r["doc_id"], r["taken"]) for r in x)
    assert key(got) == key(again)


def test_edges(spark):
    docs = edge_documents(spark)
    check(rows(docs), rows(mixing.mix(docs, bucket_rows=2)))
    assert mixing.op6_mixing(docs.limit(0)).count() == 0
    empty = docs.where("doc_id = 3")
    assert [(r["size"], r["target"], r["taken"]) for r in rows(mixing.op6_mixing(empty))] == [(0, 0.0, 0)]


def test_apportionment_against_highest_quotients(spark):
    targets = [("a", 1000.0), ("b", 333.0), ("c", 333.0), ("d", 12.0), ("e", 0.0)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(targets)], "place int, target double")
    from pyspark.sql import functions as F

    got = {(r["place"], r["shard"]): r["upto"] for r in rows(mixing.apportion(df, F.lit(101), 8))}
    for shard in range(8):
        seats = [0] * len(targets)
        for _ in range(101 * (shard + 1) // 8):
            seats[max(range(len(targets)), key=lambda i: (targets[i][1] / (seats[i] + 0.5), -i))] += 1
        assert [got[i, shard] for i in range(len(targets))] == seats


def test_pieces_tile_whole_epochs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in rows(mixing.mix(docs)):
        for epoch in range(3):
            spans = sorted((p["from_word"], p["to_word"]) for p in r["pieces"] if p["epoch"] == epoch)
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(0 <= a < b <= r["size"] for a, b in spans)


def test_copies_have_pieces_of_their_own(spark):
    data = [(7, "a b  c\n d e f\tg " * 10, "x", "en", 160)] * 40 + [(None, f"w{i} " * 30, "y", "de", 90) for i in range(20)] + [(None, f"w{i % 3} " * 30, "z", None, None) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    words = lambda got: {s: sum(len(r["text"].split()) for r in got if r["source"] == s) for s in "xyz"}
    got, again = rows(mixing.mixed_rows(df)), rows(mixing.mixed_rows(df.repartition(7)))
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    taken = rows(mixing.mix(df))
    check(data_rows(df), taken)
    assert words(got) == {s: sum(r["taken"] for r in taken if r["source"] == s) for s in "xyz"}
    assert all(r["text"] in t for r in got for t in [next(t for _, t, s, _, _ in data if s == r["source"] and r["text"] in t)])


def test_pieces_of_one_pass_give_the_text_again(spark):
    text = "  def f(x):\n\treturn x  # é\n\n" * 60
    df = spark.createDataFrame([(1, text, "a"), (2, "filler " * 5000, "b")], "doc_id bigint, text string, source string")
    got = [r["text"] for r in rows(mixing.mixed_rows(df, weights=(1, 1), n_shards=3)) if r["doc_id"] == 1]
    assert "".join(sorted(got, key=len)).count("def f(x):\n\treturn x") >= 55 and all(t in text for t in got)


def data_rows(df):
    return rows(df.select("doc_id", "text", "source"))

from collections import Counter

import corpus_pipeline
from goldlink.llm import bpe, mixing
from tests.llm.helpers import SF, edge_documents, rows
from tests.llm.test_near_text import brute as near_brute
from tests.llm.test_suffix import brute as suffix_brute


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, SF).cache()
    assert set(kept.columns) == set(docs.columns) and 0 < kept.count() <= docs.count()
    near = corpus_pipeline.near_dedup(spark, kept, SF).cache()
    want = near_brute([(r["doc_id"], r["text"]) for r in rows(kept)], 5)
    assert sorted(r["doc_id"] for r in rows(near)) == sorted(d for d, _, _, k in want if k)
    cut = corpus_pipeline.repeat_dedup(spark, near, SF).cache()
    before = {r["doc_id"]: r for r in rows(near)}
    gone = suffix_brute([(d, r["text"]) for d, r in before.items()])
    for r in rows(cut):
        n, removed, _, _ = gone[r["doc_id"]]
        left = len(r["text"].encode())
        assert n - removed <= left <= n - removed + 6 * 4 * max(1, removed) and (removed or r["text"] == before[r["doc_id"]]["text"])
        assert r["n_chars"] == len(r["text"]) and r["source"] == before[r["doc_id"]]["source"]
    mixed = corpus_pipeline.source_mix(spark, cut, SF).cache()
    taken = {r["doc_id"]: r["taken"] for r in rows(mixing.op6_mixing(cut))}
    words = Counter()
    for r in rows(mixed):
        words[r["doc_id"]] += len(r["text"].split())
    assert {d: t for d, t in taken.items() if t} == dict(words)
    last = rows(corpus_pipeline.tokens(spark, mixed, SF))
    encoder, decoder = bpe.codec(bpe.default_vocabulary(), bpe.default_pattern())
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in last)
    assert Counter(decoder.decode(r["ids"]) for r in last) == Counter(r["text"] for r in rows(mixed))


def test_run_and_edges(spark, tmp_path):
    edge_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = rows(corpus_pipeline.run(spark, str(tmp_path)))
    assert got and all(r["decodes"] for r in got)
    empty = edge_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

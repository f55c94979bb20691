import zlib
from collections import Counter

from goldlink.llm import sharding
from tests.llm.helpers import SF, edge_documents, rows


def check(documents, dealt, n=8):
    shards = {}
    for r in dealt:
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    counts = [len(shards.get(s, [])) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(documents)
    assert set(shards) <= set(range(n))


def test_law_and_contents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, got = rows(docs), rows(sharding.op1_sharding(docs))
    check(want, got)
    assert Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in want) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert {r["law"] for r in got} == {"rows"}


def test_order_is_seeded_and_independent_of_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda d: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows(d))
    a = key(sharding.shuffle_into_shards(docs))
    assert a == key(sharding.shuffle_into_shards(docs.repartition(7)))
    assert a != key(sharding.shuffle_into_shards(docs, seed=1))


def test_edge_rows_and_clashing_columns(spark):
    docs = edge_documents(spark)
    got = sharding.shuffle_into_shards(docs, n_shards=3, min_buckets=4)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "taken", "shard", "slot"]
    check(rows(docs), rows(got), 3)
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0


def test_fisher_yates_is_a_permutation():
    for n in (0, 1, 2, 50):
        assert sorted(sharding.fisher_yates(n, 3, 9).tolist()) == list(range(n))
    first = Counter(int(sharding.fisher_yates(5, s, 1)[0]) for s in range(2000))
    assert min(first.values()) > 300


def test_write(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()

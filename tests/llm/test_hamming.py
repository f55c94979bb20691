import random

from goldlink.llm import hamming
from tests.llm.helpers import SF, rows


def brute(codes, queries, k):
    out = set()
    for q, a in queries:
        near = sorted((sum(bin(x ^ y).count("1") for x, y in zip(a, c)), i is None, i) for i, c in codes)[:k]
        out |= {(q, r + 1, i, d) for r, (d, _, i) in enumerate(near)}
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    base = [[rng.randrange(65536) for _ in range(4)] for _ in range(5)]
    codes = [(i, [x ^ (1 << rng.randrange(16)) if rng.random() < 0.5 else x for x in rng.choice(base)]) for i in range(150)]
    codes += [(1000 + i, base[0]) for i in range(60)] + [(2000 + i, [rng.randrange(65536) for _ in range(4)]) for i in range(50)]
    df = spark.createDataFrame(codes, "id bigint, code array<int>")
    queries = codes[::37]
    for k in (1, 7):
        got = {(r["query_id"], r["rank"], r["id"], r["distance"]) for r in rows(hamming.top_k(df, spark.createDataFrame(queries, df.schema), k))}
        assert got == brute(codes, queries, k)


def test_fewer_rows_than_k_nulls_and_empty(spark):
    codes = [(1, [0]), (2, [65535]), (None, [3]), (4, None), (2, [65535])]
    df = spark.createDataFrame(codes, "id bigint, code array<int>")
    got = sorted((r["rank"], r["distance"], r["id"] or -1) for r in rows(hamming.top_k(df, df.where("id = 1"), 10)))
    assert got == [(1, 0, 1), (2, 2, -1), (3, 16, 2), (4, 16, 2)]
    assert hamming.top_k(df.limit(0), df.limit(0), 3).count() == 0


def test_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = rows(vectors)
    code = lambda v: [sum(1 << i for i in range(16) if v[low + i] > 0) for low in range(0, 64, 16)]
    codes = [(r["vec_id"], code(r["embedding"])) for r in data]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in rows(hamming.op10_hamming_top_k(vectors))}
    assert got == brute(codes, [c for c in codes if c[0] % 100 == 0], 10)


def test_narrow_segments_many_components_and_uneven_lengths(spark):
    rng = random.Random(8)
    codes = [(i, [rng.randrange(32) for _ in range(3)]) for i in range(80)]
    df = spark.createDataFrame(codes, "id bigint, code array<int>")
    got = {(r["query_id"], r["rank"], r["id"], r["distance"]) for r in rows(hamming.top_k(df, spark.createDataFrame(codes[:9], df.schema), 4, segment=5))}
    assert got == brute(codes, codes[:9], 4)
    assert hamming.segment_bits(51_282, 64) == 16 and hamming.segment_bits(10**9, 1024) <= 25 and hamming.segment_bits(3, 1) == 1
    data = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([70, 90]))]) for i in range(0, 1200, 20)] + [(1, None), (2, []), (3, [float("nan")])]
    vectors = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    bits = [(i, [sum(1 << b for b, x in enumerate(v) if x > 0)]) for i, v in data if v and v[0] == v[0]]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in rows(hamming.op10_hamming_top_k(vectors))}
    assert got == brute(bits, [c for c in bits if c[0] % 100 == 0], 10)


def test_segments_weigh_probes_against_codes_met(spark):
    far = hamming.expected_distance(51_282, 64, 10)
    asked, met = hamming.expected_work(51_282, 64, hamming.cheapest_segment(51_282, 64, 10), far)
    assert far == 18 and asked < 1000 and met < 20_000  # segments of log2(rows) bits ask 8,248 times
    assert [hamming.expected_work(10, 4, 2, 4)[0], hamming.expected_distance(10, 4, 10), hamming.cheapest_segment(1, 1, 10)] == [7, 4, 1]
    assert hamming.expected_work(1024, 64, 10, 0)[1] == 1 and hamming.expected_work(1024, 64, 10, 6)[1] == 6 + 64  # seven segments, the last of 4 bits
    rng = random.Random(2)
    data = [(i, [rng.uniform(-1, 1) for _ in range(40)]) for i in range(0, 6000, 4)]
    assert hamming.cheapest_segment(len(data), 40, 10) < hamming.segment_bits(len(data), 40)
    bits = [(i, [sum(1 << b for b, x in enumerate(v) if x > 0)]) for i, v in data]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in rows(hamming.op10_hamming_top_k(spark.createDataFrame(data, "vec_id bigint, embedding array<float>")))}
    assert got == brute(bits, [c for c in bits if c[0] % 100 == 0], 10)

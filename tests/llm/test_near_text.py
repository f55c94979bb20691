import random
import re
from collections import defaultdict

import numpy as np

from goldlink.llm import near_text
from goldlink.llm.common import shingle_set, shingle_sets
from tests.llm.helpers import SF, edge_documents, rows

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def word_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(n, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute(pairs, n, percent=80):
    """[(id, text)] → [(id, size, component id, kept)] in the same order."""
    sets = word_sets([t for _, t in pairs], n)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in index[g]:
                shared[j] += 1
            index[g].append(i)
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(pairs[i][0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(d, len(s), first[find(i)], d is not None and d == first[find(i)]) for i, ((d, _), s) in enumerate(zip(pairs, sets))]


def check(df, n, **options):
    pairs = [(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(near_text.near_duplicates(df, shingle_words=n, **options))]
    assert sorted(got, key=repr) == sorted(brute(pairs, n), key=repr)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, 2)
    check(docs, 5)


def edited(words, rng, share):
    return " ".join(rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words)


def test_large_groups_branching_scans_and_blocks(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120)]
    data = [(i, edited(base, rng, 0.03)) for i in range(120)] + [(200 + i, " ".join(base)) for i in range(40)]
    data += [(300 + i, edited(["the", "of"] * 20 + base[:20], rng, 0.2)) for i in range(80)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    check(df, 2)
    check(df, 2, small=16, block=25)
    check(df, 2, small=4, most_depth=4, block=10)


def test_edges(spark):
    docs = edge_documents(spark)
    check(docs, 2)
    check(docs, 5)
    assert near_text.op7_near_duplicates(docs.limit(0)).count() == 0


def test_threshold_is_exact():
    a = np.stack([np.arange(100, dtype=np.uint64)] * 2)
    assert near_text.linked(a, a[:, :80], 80) and not near_text.linked(a, a[:, :79], 80)
    other = a.copy()
    other[1, 79:] += np.uint64(1)  # equal in half of the digest only
    assert not near_text.linked(a, other, 80)


def test_words_that_defeat_power_sums_stay_apart(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows(near_text.near_duplicates(df, shingle_words=2))}
    assert got == {1: 1, 2: 2, 3: 1}


def test_rows_are_decided_one_by_one(spark):
    t, u, v = (" ".join(f"{c}{i}" for i in range(30)) for c in "tuv")
    data = [(3, t, 1), (5, t, 2), (5, u, 3), (7, v, 4), (7, v, 5), (None, u, 6), (None, None, 7), (None, None, 8), (9, " ", 9)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, rid int")
    got = [(r["doc_id"], r["text"]) for r in rows(near_text.deduplicate(df))]
    assert sorted(got, key=repr) == sorted([(3, t), (5, u), (7, v), (None, None), (None, None), (9, " ")], key=repr)
    assert near_text.deduplicate(df).columns == df.columns and near_text.deduplicate(df.limit(0)).count() == 0


def test_shingles_of_few_words():
    size = lambda text, n: shingle_set(text, n).shape[1]
    assert size("One two", 5) == 1 and size(" \t", 2) == 0 and size(None, 2) == 0 and size("x x x x", 2) == 1
    assert (shingle_set("A\tb  c", 2) == shingle_set("a b\nC", 2)).all()
    texts = ["one two three", None, "", "x " * 50 + "y" * 70, "a b", " lead trail "]
    assert all((a == shingle_set(t, 2)).all() for a, t in zip(shingle_sets(texts, 2, at_once=16), texts))


def test_crowded_small_nodes_are_compared_by_blocks(spark, monkeypatch):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120)]
    data = [(i, edited(base, rng, 0.07)) for i in range(60)] + [(100 + i, edited(base, rng, 0.02)) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    for listed in (0, 1000):
        monkeypatch.setattr(near_text, "LISTED", listed)
        check(df, 2, block=10)

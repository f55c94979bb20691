import hashlib
import random

import numpy as np

from goldlink.llm import suffix
from tests.llm.helpers import SF, edge_documents, rows


def brute(docs, length=100):
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(b[s : s + length])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def check(df, **options):
    want = brute([(r["doc_id"], r["text"]) for r in rows(df.select("doc_id", "text"))])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix.op3_suffix(df, **options))}
    assert got == want
    return want


def test_documents_against_brute_force(spark):
    assert sum(x[1] for x in check(spark.read.parquet(f"{SF}/documents.parquet")).values()) > 0


def test_periodic_overlapping_and_partial_copies(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = ["a" * 500, "ab" * 300, passage, "x" + passage[:150] + "y" + passage[20:], passage, None, "", "z" * 99, "z" * 100, "q" * 40 + "z" * 100, passage[:99], passage[:100], passage[1:101] + passage[0:100], "a" * 100 + "b" + "a" * 99]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(df)
    check(df, batch_bytes=400, part_bytes=256)


def test_suffix_array_against_sorting():
    rng = random.Random(4)
    for length in (1, 3, 5, 6, 17, 100):
        for alphabet in ("a", "ab", "\0a", "abcdefgh \0"):
            raw = "".join(rng.choice(alphabet) for _ in range(400)).encode()
            starts = np.array(sorted(rng.sample(range(len(raw) - length + 1), 200)))
            order, again = suffix.suffix_array(np.frombuffer(raw, np.uint8), starts, length)
            want = sorted(range(len(starts)), key=lambda i: (raw[starts[i] : starts[i] + length], i))
            assert order.tolist() == want
            text = [raw[starts[i] : starts[i] + length] for i in want]
            assert again.tolist() == [False] + [a == b for a, b in zip(text, text[1:])]


def test_index_levels_are_sorted_and_stay_geometric():
    rng = random.Random(1)
    for length, alphabet in ((100, "ab"), (20, "abc"), (9, "a\0"), (100, "abcdefgh")):
        words = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(12)]
        raw = "".join(rng.choice(words) for _ in range(150)).encode()
        data = np.frombuffer(raw, np.uint8)
        family, seen = suffix.LogSuffixIndex(data, length), set()
        for lo in range(0, len(raw) - length, 130):
            hi = min(lo + 130, len(raw) - length)
            want = []
            for p in range(lo, hi):
                want.append(raw[p : p + length] in seen)
                seen.add(raw[p : p + length])
            places = np.arange(lo, hi)
            assert family.add(places, data[lo : hi + length], places - lo).tolist() == want
            sizes = [len(level) for level in family.levels]
            assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
            for level in family.levels:
                text = [raw[p : p + length] for p in level.tolist()]
                assert all(a < b for a, b in zip(text, text[1:]))


def test_edge_rows_and_text_output(spark):
    docs = edge_documents(spark)
    got = suffix.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_bytes", "n_removed", "spans"]
    assert got.count() == docs.count()
    text = "é" * 60 + "end"
    two = spark.createDataFrame([(1, text, 5), (2, "a" + text, 6)], "doc_id bigint, text string, spans int")
    out = {r["doc_id"]: r for r in rows(suffix.remove_repeats(two))}
    assert out[1]["text"] == text[:1] * 0 + out[1]["text"] and "�" not in out[2]["text"] and out[2]["text"] == "a"
    assert suffix.op3_suffix(docs.limit(0)).count() == 0


def test_index_holds_different_stretches_only():
    data = np.frombuffer(b"abcabcabxabc", dtype=np.uint8)
    first, text = suffix.different(data, np.array([0, 9, 3, 6, 6]), np.array([3, 3, 3, 3, 2]))
    assert first.tolist() == [True, False, False, True, True] and text.tobytes() == b"abcabxab"


def test_equal_stretches_of_many_documents(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(90))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(30))) + passage[rng.randrange(40) :] + word()) for i in range(60)]
    check(spark.createDataFrame(docs, "doc_id bigint, text string"), part_bytes=2000, batch_bytes=3000)

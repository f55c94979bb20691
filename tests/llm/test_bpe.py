import hashlib
import tracemalloc

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from goldlink.llm import bpe
from tests.llm.helpers import SF, edge_documents, rows


@pytest.fixture(scope="module")
def tools():
    ranks = bpe.load_ranks(bpe.default_vocabulary())
    return bpe.Encoder(ranks, bpe.default_pattern()), bpe.Decoder(ranks), tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_matches_tiktoken(tools, text):
    encoder, decoder, reference = tools
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert decoder.decode(ids, 3) == text


def test_hard_texts(tools):
    encoder, decoder, reference = tools
    for text in ("", "a" * 5000, "abab" * 800, " \n\t " * 100, "1234567890" * 200, "😀é日本" * 300, "it's we'll x'RE", "  x", "=" * 777, "<|endoftext|>"):
        assert encoder.encode(text) == reference.encode_ordinary(text)
        assert decoder.decode(encoder.encode(text), 1) == text


def test_automaton_regrows(tools):
    ranks = bpe.load_ranks(bpe.default_vocabulary())
    small = bpe.Encoder(ranks, bpe.default_pattern(), 5)
    small.transducer.most_states = 50
    text = open(bpe.__file__).read()
    assert small.encode(text) == tools[2].encode_ordinary(text)


def test_utf8_machine_on_any_split():
    data = "aé日😀z".encode() + b"\xff\xe0\x80a\xf0\x9f"
    for cut in range(len(data) + 1):
        m = bpe.Utf8Machine()
        assert m.feed(data[:cut]) + m.feed(data[cut:]) + m.close() == data.decode("utf-8", "replace")
    m = bpe.Utf8Machine()
    assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.close() == data.decode("utf-8", "replace")


def test_query_and_columns(spark, tools):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(edge_documents(spark), allowMissingColumns=True)
    texts = [(r["doc_id"], r["text"] or "") for r in rows(docs)]
    want = sorted((d or -1, len(i := tools[2].encode_ordinary(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, t in texts)
    assert want == sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(bpe.op4_bpe(docs)))
    edge = edge_documents(spark)
    back = bpe.decode_column(bpe.encode_column(edge).drop("text"))
    assert sorted(r["text"] for r in rows(back)) == sorted(r["text"] or "" for r in rows(edge))
    assert bpe.op4_bpe(edge.limit(0)).count() == 0


def test_an_encoder_keeps_nothing_of_a_task_but_the_vocabulary():
    encoder, _ = bpe.codec(bpe.default_vocabulary(), bpe.default_pattern())
    encoder.forget()
    text = " ".join(chr(97 + i % 26) * (1 + i % 3) + str(i * 7919) + chr(97 + i % 17) + "tion" for i in range(4000))
    tracemalloc.start()
    before = encoder.encode(text)
    learnt = tracemalloc.get_traced_memory()[0]
    encoder.forget()
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert not any((*encoder.transducer.edges, encoder.transducer.pairs, encoder.transducer.alone, encoder.pieces, encoder.pieces.old))
    assert left < 0.2 * learnt and encoder.encode(text) == before

import hashlib

import duckdb

from goldlink.llm import chat
from tests.llm.helpers import SF, rows

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_matches_the_sql_oracle(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(chat.OP2_SQL).df().sort_values("conv_id").reset_index(drop=True)
    got = chat.op2_chat(spark.read.parquet(f"{SF}/conversations.parquet")).toPandas().sort_values("conv_id").reset_index(drop=True)
    assert (got[want.columns].astype(str) == want.astype(str)).all().all()


def test_prefixes_targets_and_round_trip(spark):
    hard = "a\\<|im_end|>\\\\<\\|x</s>[INST]<<SYS>>\n<|im_sep|>\\"
    data = [(1, 2, "user", "last", 0), (1, 0, "user", hard, 1), (1, 1, "assistant", "réply " + hard, 2), (2, 0, "assistant", None, 3), (3, 0, None, "", 4), (None, 5, "assis<|tant", "x", 5), (2, 0, "assistant", None, 3)]
    turns = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, example int")
    examples = chat.format_conversations(turns)
    got = rows(examples.select("*", chat.masked_text(examples).alias("loss"), chat.read_turns(examples.text).alias("turns")))
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [r["trainable"] for r in one] == [True, False] and one[0]["loss"] == "réply " + hard and one[1]["loss"] == ""
    assert one[1]["text"].startswith(one[0]["text"])
    assert [(t["role"], t["text"]) for t in one[1]["turns"]] == [("user", hard), ("assistant", "réply " + hard), ("user", "last")]
    assert one[0]["text"][one[0]["loss_start"] : one[0]["loss_end"]].replace("\\", "") in one[0]["text"].replace("\\", "")
    assert sum(r["conv_id"] == 2 for r in got) == 2
    digest = {r["conv_id"]: r for r in rows(chat.op2_chat(turns))}
    assert digest[1]["turns_sha256"] == sha(f"user\n{hard}\nassistant\nréply {hard}\nuser\nlast\n") and digest[1]["loss_sha256"] == sha("réply " + hard)
    assert digest[3]["turns_sha256"] == sha("\n\n") and digest[3]["loss_chars"] == 0
    assert digest[-1]["n_turns"] == 2 and digest[-1]["loss_sha256"] == sha("</s>[INST] ok [/INST]")
    assert [r["conv_id"] for r in rows(chat.op2_chat(turns.limit(0)))] == [-1]


def test_no_python_in_the_plan(spark):
    plan = chat.op2_chat(spark.read.parquet(f"{SF}/conversations.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

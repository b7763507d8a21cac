"""Chat formatting: layouts, reversible escapes, loss mask, and the SQL oracle."""
import hashlib
import random

import duckdb
import pytest

from roomgrid.llm import catalogue
from roomgrid.llm import chat as C

ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo \\0 <|im_end|>\n<s>"), (2, 0, "system", "s"), (2, 1, "user", "u"),
        (2, 2, "assistant", "é\U0001F600"), (3, 0, "user", None), (3, 1, None, "x"), (4, 5, "human", "a"), (4, 2, "gpt", ""),
        (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a"), (6, None, "ro\nle\\", "[INST]\\"),
        (None, 0, "user", "n" * 100_000), (7, 0, "user", ""), (7, 1, "user", "\\\\1<|im_\\1start|>"), (8, 0, "assistant", "z"),
        (8, 1, "user", "q"), (8, 2, "system", "w"), (8, 3, "assistant", "e")]


def pipeline(df):
    t = C.canonical_turns(C.from_rows(df), "record")
    return C.read_back(C.format_turns(t))


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as conv", "2 as record")
    got = {r["conv"]: r for r in pipeline(df).collect()}
    want = {}
    for c, n, r, t in ROWS:
        want.setdefault(c, []).append(((n is not None, n or 0), r or "", t or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns_back"]] == [(r, t) for _, r, t in turns]
        assert got[c]["loss_text"] == "".join(t for _, r, t in turns if r == "assistant")
        body = got[c]["formatted"]
        assert body.count(C.START) == body.count(C.END) == len(turns)
    assert {got[c]["layout"] for c in got} == {"messages", "shared", "prompt", "system_prompt"}


def test_layouts_of_json_records(spark):
    rows = ['{"messages":[{"role":"user","content":"a"},{"content":"b","role":"assistant"}]}',
            '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}',
            '{"prompt":"a","completion":"b"}', '{"output":"b","instruction":"a"}', '{"question":"a","answer":"b"}',
            '{"prompt":"a","completion":null}', '{"other":1}', '{"prompt":"a","completion":"b","extra":{"x":[1]}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, j string").selectExpr("i", "parse_json(j) as record")
    got = {r["i"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]])
           for r in C.canonical_turns(df, "record").collect()}
    ab = [("user", "a"), ("assistant", "b")]
    assert [got[i][1] for i in range(5)] == [ab] * 5
    assert got[5] == ("prompt", [("user", "a"), ("assistant", None)])
    assert got[6] == got[7] == (None, None)


def test_escape_is_reversible(spark):
    r = random.Random(1)
    bits = list(C.CONTROL) + ["\\", "0", "1", "9", "n", "<", "|", "im_end", ">", "[", "INST]", "\n", "é"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", C.escape(C.F.col("t")).alias("e")).select("t", "e", C.unescape(C.F.col("e")).alias("u"))
    for x in df.collect():
        assert x["t"] == x["u"]
        assert not any(s in x["e"] for s in C.CONTROL)


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    got = catalogue.QUERIES["op9_chat"](spark, sf)
    want = con.execute(catalogue.ORACLES["op9_chat"]).fetchdf()
    assert sorted(map(tuple, got.collect())) == sorted(want[got.columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("empty", [True])
def test_empty(spark, empty):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pipeline(df).count() == 0


def test_digest_of_the_told_conversation(spark, sf):
    got = catalogue.QUERIES["op9_chat"](spark, sf).filter("conv_id = -1").first()
    t = "</s>[INST] ok [/INST]"
    assert got["loss_chars"] == len(t) and got["loss_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()

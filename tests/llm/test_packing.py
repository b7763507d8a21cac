"""Tokenisation against ``tokenizers``; packing against exhaustive search and its invariants."""
import random
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from roomgrid.llm import packing as P
from roomgrid.llm import tokens as K
from roomgrid.llm import words as W

PT = pytest.importorskip("public_tokenizers")
PATH = PT.path("byte_bpe_50k.json")


def test_units_give_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer
    r = random.Random(2)
    bits = [" ", "  ", "\n", "\t", " ", " ", "　", "\x85", "\x1c", "'s", "'ll", "a", "B", "é", "ß", "1",
            "23", "!", "|", "<|endoftext|>", "日本", "🙂", "\r\n", "_", "​", " the"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["", "z" * 5000]
    ids, n = K.UnitTokenizer(PATH).encode(W.as_large_strings(pa.array(texts)))
    at = np.concatenate([[0], np.cumsum(n)])
    whole = Tokenizer.from_file(PATH)
    for i, e in enumerate(whole.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i]:at[i + 1]].tolist() == e.ids, texts[i]


def fewest(items, cap):
    @lru_cache(None)
    def go(rest):
        if not rest:
            return 0
        first, others = rest[0], rest[1:]
        best = len(rest)
        for mask in range(1 << len(others)):
            s = first + sum(o for k, o in enumerate(others) if mask >> k & 1)
            if s <= cap:
                best = min(best, 1 + go(tuple(o for k, o in enumerate(others) if not mask >> k & 1)))
        return best
    return go(tuple(sorted(items, reverse=True)))


def test_bin_completion_is_optimal_on_small_inputs():
    r = random.Random(4)
    for _ in range(60):
        items = [r.randint(1, 20) for _ in range(r.randint(1, 8))]
        counts = {s: items.count(s) for s in items}
        got = P.bin_completion(counts, 20)
        assert sum(n for _, n in got) == fewest(items, 20)
        used = {}
        for f, n in got:
            assert sum(f) <= 20
            for s in f:
                used[s] = used.get(s, 0) + n
        assert used == counts


def check_packing(rows, docs, cap):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    want = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        k = -(-len(ids) // cap)
        head = len(ids) - (k - 1) * cap
        for p in range(k):
            a, b = (0, head) if p == 0 else (head + (p - 1) * cap, head + p * cap)
            want.append((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= cap
    return len(by)


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 7)   # ranks over several buckets
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["alpha", "beta é", "the\n", "x1!"]) for _ in range(r.randint(0, 90))))
            for i in range(150)]
    docs += [(7, docs[7][1]), (None, "a b"), (900, None), (901, ""), (902, "many words " * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "2 as id", "3 as _b")
    rows = P.pack_documents(df, PATH, capacity=64).collect()
    n = check_packing(rows, docs, 64)
    assert n <= -(-sum(r["length"] for r in rows) // 64) * 1.05 + 1
    assert P.pack_documents(df.limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    from tokenizers import Tokenizer
    docs = [(1, "one two three"), (2, "four"), (3, None)]
    got = P.sequences(spark.createDataFrame(docs, "doc_id long, text string"), PATH, capacity=32).collect()
    tok = Tokenizer.from_file(PATH)
    parts = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    assert [x for s in got for x in s["ids"]] == [x for s in got for i in s["ids_of"] for x in parts[i]]
    assert sorted(i for s in got for i in s["ids_of"]) == [1, 2, 3]

"""The trie against dictionaries and the scores against a plain bigram model."""
import math
import random
import re
from collections import Counter

import numpy as np

from roomgrid.llm import lm as L
from roomgrid.llm.ngram_trie import EliasFano, Trie

RX = re.compile(r"[^\x20\x09-\x0D]+")


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((1, 1), (1, 10**12), (5, 3), (1000, 10**9), (1000, 500), (3000, 2**50)):
        v = np.sort(r.integers(0, top, n))
        e = EliasFano.build(v)
        assert (e.get(np.arange(n)) == v.astype(np.uint64)).all()
        x = np.concatenate([v, v + 1, r.integers(0, top + 100, 500), [0, top, 2 * top]])
        assert (e.successor(x) == np.searchsorted(v, x, side="left")).all()


def test_trie():
    r = random.Random(2)
    pairs = sorted({(r.randint(1, 60), r.choice([1, 2, 3, r.randint(1, 10**6)])) for _ in range(3000)})
    logp = np.array([-r.random() * 5 for _ in pairs])
    a, b = np.array(pairs).T
    t = Trie.mapped(Trie.levels(a, b, logp))
    assert np.abs(t.find(a, b) - logp).max() < 1e-4
    other = [(r.randint(0, 70), r.randint(0, 2 * 10**6)) for _ in range(3000)]
    other = np.array([p for p in other if p not in set(pairs)]).T
    assert np.isnan(t.find(*other)).all()
    assert len(Trie(Trie.levels(a[:0], b[:0], logp[:0])).find(a, b)) == len(a)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(rows, prior):
    toks = [(i, tr, RX.findall(lower(t or "")) + [None]) for i, tr, t in rows]
    c, c2 = Counter(), Counter()
    for _, tr, w in toks:
        if tr:
            c.update(w)
            c2.update(zip([None] + w[:-1], w))
    n, v = sum(c.values()), len(c)
    norm = n + 0.5 * (v + 1)
    out = []
    for i, tr, w in toks:
        base = sum(math.log10((c[x] + 0.5) / norm) for x in w)
        s = sum(math.log10((c2[a, b] + prior * (c[b] + 0.5) / norm) / (c[a] + prior)) for a, b in zip([None] + w[:-1], w))
        out.append((i, tr, len(w), sum(c[x] > 0 for x in w), n, base, s))
    return out


def corpus():
    r = random.Random(5)
    words = [f"w{k}" for k in range(50)] + ["The", "É", "the", "x\x1cy"]
    rows = [(i, i % 5 != 1, r.choice([" ", "\n"]).join(r.choice(words[:r.randint(1, 54)]) for _ in range(r.randint(0, 60))))
            for i in range(300)]
    rows += [(i, i % 5 != 1, "is onhe. " * 40) for i in range(300, 340)]
    return rows + [(400, True, None), (401, False, ""), (None, True, "a b"), (7, True, "again"), (7, True, "again"),
                   (402, False, "never seen words"), (403, True, "long text " * 5000)]


def compare(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5]))
        assert abs(g[6] - w[6]) < 1e-3 * g[2] + 1e-6 * abs(w[6])


def test_scores_match_brute_force(spark, monkeypatch):
    # many segments and shards, and contexts that are split
    for name, value in (("SEGMENT_BYTES", 3000), ("WORD_ENTRIES", 500), ("PAIR_TOKENS", 700)):
        monkeypatch.setattr(L, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, train boolean, text string").selectExpr("*", "1 as seg", "2 as id", "3 as t")
    compare(L.score(df.repartition(3), L.F.col("train")).collect(), brute(rows, L.PRIOR))


def test_edges(spark):
    schema = "doc_id long, train boolean, text string"
    assert L.score(spark.createDataFrame([], schema), L.F.col("train")).count() == 0
    rows = [(1, False, "a b"), (2, False, None)]
    got = L.score(spark.createDataFrame(rows, schema), L.F.col("train")).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [
        (1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]


def test_beats_the_base_on_held_out_prose(spark):
    r = random.Random(9)
    follow = {k: [r.randint(0, 199) for _ in range(4)] for k in range(200)}

    def text():
        w = [r.randint(0, 199)]
        while len(w) < 80:
            w.append(r.choice(follow[w[-1]]))
        return " ".join(f"t{x}" for x in w)

    rows = [(i, i % 5 != 1, text()) for i in range(400)]
    got = L.score(spark.createDataFrame(rows, "doc_id long, train boolean, text string"), L.F.col("train"), prior=10.0).collect()
    held = [x for x in got if not x["train"]]
    assert all(x["score"] > x["base_score"] for x in held)

"""Quality classifier: held-out accuracy on planted texts, and defined results at the edges."""
import random

import numpy as np
import pyarrow as pa

from roomgrid.llm import quality as Q


def corpus(n=600, seed=4):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéiorstn") for _ in range(r.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(5, 120))]
        bad = i % 4 == 0
        if bad:
            w = ([x + r.choice(["$$$", "%%%"]) for x in w] if i % 8 else [x for x in w[:9] for _ in range(9)])
        rows.append((i, " ".join(w).capitalize() + ".", int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id long, label int")
    model = Q.fit(docs, labels)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", Q.score(Q.F.col("text"), model).alias("s")).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert np.mean(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values())
    again = Q.fit(docs.repartition(5), labels.repartition(2))
    assert np.allclose(model, again, atol=1e-6)


def test_sample_bound_and_edges(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "a b"), (0, rows[0][1])],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 1), (901, 0), (5000, 1), (None, 1), (3, None), (4, 1)],
                                   "doc_id long, label int")
    model = Q.fit(docs, labels, max_rows=100)
    out = docs.select("doc_id", Q.score(Q.F.col("text"), model).alias("s")).collect()
    assert len(out) == docs.count() and all(x["s"] is not None for x in out)
    none = Q.fit(docs, labels.limit(0))
    assert {x["s"] for x in docs.select(Q.score(Q.F.col("text"), none).alias("s")).collect()} == {0.5}
    assert Q.fit(docs.limit(0), labels).sum() == 0
    assert docs.limit(0).select(Q.score(Q.F.col("text"), model)).count() == 0


def test_score_is_a_sparse_dot_product():
    r = np.random.default_rng(2)
    model = r.normal(size=(1 << Q.BITS) + 1).astype(np.float32)
    texts = ["One two two THREE 4 five!", "", "x " * 3000]
    for t, s in zip(texts, Q.score_texts(pa.array(texts), model)):
        _, place, value = Q.features(Q.W.as_large_strings(pa.array([t])))
        assert abs(s - 1 / (1 + np.exp(-np.clip(model[place] @ value + model[-1], -35, 35)))) < 1e-6


def test_words_match_the_pattern():
    import re
    r = random.Random(1)
    bits = [" ", "\t", "\n", "\x0b", "\r", "\x1c", "\x85", " ", "a", "é", "\U0001F600", "Zz", "|"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 30))) for _ in range(500)]
    w = Q.W.Words(Q.W.as_large_strings(pa.array(texts)))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert w.count.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end)] == flat
    assert len(set(w.hash.tolist())) == len(set(flat))


def test_features_of_few_texts_are_held_at_a_time():
    import tracemalloc

    import pandas as pd
    r = np.random.default_rng(5)
    words = np.array(["w%d" % i for i in range(3000)])
    texts = [" ".join(r.choice(words, 2000)) for _ in range(400)]
    labels = (np.arange(400) % 2).astype(float)
    peaks = []
    for run in (lambda: Q._train_shard(pd.Series(texts), labels, Q.BITS, 1),
                lambda: Q.score_texts(pa.array(texts), np.zeros((1 << Q.BITS) + 1, np.float32))):
        tracemalloc.start()
        run()
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        tracemalloc.stop()
    assert max(peaks) < 150, peaks

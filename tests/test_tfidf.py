"""Hashed TF-IDF against plain Python; frequencies grow batch by batch."""
import hashlib
import math
import re
from collections import Counter

import pytest

from roomgrid.operators import embed as EM

TEXTS = [(1, "Two rooms, two baths"), (2, "rooms near water"), (3, ""), (4, None), (5, "water water WATER"), (6, "- | -"), (7, "Zimmer für zwei")]


def bucket(tok, dim):
    return int(hashlib.sha256(tok.encode()).hexdigest()[:8], 16) % dim


def counts(text, dim):
    return Counter(bucket(t, dim) for t in re.findall(r"[^\W_]+", (text or "").lower()))


def plain(texts, seen, dim):
    n = len(seen)
    df = Counter(b for _, t in seen for b in counts(t, dim))
    out = {}
    for k, t in texts:
        w = {b: c * (math.log((1 + n) / (1 + df[b])) + 1) for b, c in counts(t, dim).items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        out[k] = [w.get(b, 0.0) / norm for b in range(dim)]
    return out


@pytest.mark.parametrize("dim", [5, 64])
def test_vectors_after_each_batch(spark, tmp_path, dim):
    df = spark.createDataFrame(TEXTS, "id long, text string")
    path = str(tmp_path / "df")
    for upto in (3, 7, 7):          # the last batch runs twice and counts once
        ids = (1, 3) if upto == 3 else (4, 7)
        EM.add_document_frequencies(df.filter(df.id.between(*ids)), "id", "text", path, f"b{upto}", dim)
        idf = EM.inverse_frequencies(spark, path, dim)
        assert idf.count() == dim
        got = {r.id: r for r in EM.hashed_tfidf(df, "id", "text", idf, dim, "double").collect()}
        want = plain(TEXTS, [t for t in TEXTS if t[0] <= upto], dim)
        for k, t in TEXTS:
            assert got[k].embedding == pytest.approx(want[k])
            assert (got[k].n_tokens, got[k].nnz) == (sum(counts(t, dim).values()), len(counts(t, dim)))


def test_earlier_texts_are_not_read_and_no_texts(spark, tmp_path):
    path = str(tmp_path / "df")
    none = spark.createDataFrame([], "id long, text string")
    EM.add_document_frequencies(none, "id", "text", path, "0")
    idf = EM.inverse_frequencies(spark, path)
    assert {r.idf for r in idf.collect()} <= {1.0, None}
    assert EM.hashed_tfidf(none, "id", "text", idf).count() == 0
    assert len(spark.read.parquet(path).filter("bucket < -1").collect()) == 0

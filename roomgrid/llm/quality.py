"""Quality classifier: hashed word n-gram logistic regression trained by
follow-the-regularised-leader (FTRL-proximal) updates, scored as sparse dot products.

Features of a text, each an n-gram of words hashed into ``2 ** bits`` places:

* the lower-cased word, and pairs of neighbouring words;
* runs of three word shapes (letter case, digits, punctuation, length class, "equals the
  word before"), which carry over to words that no labelled text has;
* the length class of the text and whether it has any word.

Every family is weighted by its share of the text, so a score does not drift with length.

Training: a sample of the labelled rows of at most about ``max_rows`` (documented bound;
chosen by a hash of the id) is dealt over ``shards`` groups; each runs FTRL over its rows
for ``epochs`` passes, and the shard weights are averaged (iterative parameter mixing with
one mix).  The model is one dense vector of ``2 ** bits`` floats, so its size is fixed.

Defined results: null and empty texts have the length feature only and get a score; null
labels, and labelled ids without a document, take no part; several labels of one id count
as the largest; repeated rows are scored alike; with no labelled row at all every score is
0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomgrid.llm import words as W

BITS = 18
MAX_ROWS = 24_000
SHARDS = 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
SCALE = 6.0
SLICE_BYTES = 1 << 20  # text whose features are held at a time, some 60 times its size

_KIND = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower or non-ASCII, 4 digit, 8 punctuation
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (1 if "A" <= _c <= "Z" else 2 if "a" <= _c <= "z" or _b >= 128
                 else 4 if _c.isdigit() else 8)


def features(col: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all features of a batch of texts."""
    w = W.Words(col, lower=True)
    n, dim = len(w.hash), np.uint64((1 << bits) - 1)
    rows, places, values = [], [], []
    share = SCALE / np.maximum(w.count, 1)

    def add(doc, h, value):
        rows.append(doc)
        places.append((h & dim).astype(np.int64))
        values.append(value)

    if n:
        size = w.end - w.start
        kinds = _KIND[w.buf]
        gap = np.zeros(len(kinds), dtype=bool)
        gap[w.start] = True
        has = np.bitwise_or.reduceat(np.where(W._SPACE[w.buf], 0, kinds).astype(np.uint8), w.start)
        same = np.zeros(n, dtype=np.uint64)
        if n > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        length = np.minimum(np.log2(size + 1.0) * 1.5, 15).astype(np.uint64)
        cap = (kinds[w.start] == 1).astype(np.uint64)
        shape = (has.astype(np.uint64) | (cap << np.uint64(4)) | (same << np.uint64(5))
                 | (length << np.uint64(6)))
        add(w.doc, W.mix(w.hash + np.uint64(1)), share[w.doc])
        pair, doc = W.windows(w, 2)
        add(doc, W.mix(pair + np.uint64(2)), share[doc])
        for k in (1, 3):
            if n >= k:
                h = shape[:n - k + 1] + np.uint64(0x51ED)
                for j in range(1, k):
                    h = W.chain(h, shape[j:n - k + 1 + j])
                ok = w.doc[:n - k + 1] == w.doc[k - 1:]
                doc = w.doc[:n - k + 1][ok]
                add(doc, W.mix(h[ok] + np.uint64(2 + k)), share[doc])
    every = np.arange(w.n_docs)
    size_class = np.log2(w.count + 1.0).astype(np.uint64) + np.uint64(77)
    add(every, W.mix(size_class * np.uint64(1_000_003)), np.ones(w.n_docs))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(values)


def _train_shard(texts: pd.Series, labels: np.ndarray, bits: int, epochs: int) -> np.ndarray:
    """FTRL-proximal over the rows of one shard, in their order."""
    dim = 1 << bits
    z, n2 = np.zeros(dim + 1), np.zeros(dim + 1)
    col = W.as_large_strings(pa.array(texts, type=pa.string(), from_pandas=True))
    rows = []
    for a, b in W.slices(col, SLICE_BYTES):
        r, p, v = features(col.slice(a, b - a), bits)
        key, back = np.unique(r * dim + p, return_inverse=True)
        val = np.bincount(back, weights=v)
        cut = np.searchsorted(key, np.arange(b - a + 1) * dim)
        for i in range(b - a):
            s = slice(cut[i], cut[i + 1])
            rows.append((np.append(key[s] - i * dim, dim).astype(np.int32),
                         np.append(val[s], 1.0).astype(np.float32), labels[a + i]))
    for _ in range(epochs):
        for idx, x, y in rows:
            zi, ni = z[idx], n2[idx]
            root = np.sqrt(ni)
            w = -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2)
            w[np.abs(zi) <= L1] = 0.0
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            g2 = g * g
            z[idx] = zi + g - (np.sqrt(ni + g2) - root) / ALPHA * w
            n2[idx] = ni + g2
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n2)) / ALPHA + L2)
    w[np.abs(z) <= L1] = 0.0
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "label", bits: int = BITS, max_rows: int = MAX_ROWS,
        shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (``2 ** bits`` places and, last, the bias) from labelled documents."""
    lab = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
           .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull())
           .groupBy("_id").agg(F.max("_y").alias("_y")))
    n = lab.count()
    if n > max_rows:  # the documented bound of the training sample
        lab = lab.filter(F.pmod(F.xxhash64(F.lit(17), "_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
            .join(F.broadcast(lab), "_id")  # at most about max_rows narrow rows
            .withColumn("_shard", F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(shards))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # a seeded order that the arrival of the rows cannot change
        pdf = pdf.sort_values("_t", kind="stable", na_position="first")
        key = pd.util.hash_array(pdf["_id"].to_numpy())
        pdf = pdf.iloc[np.argsort(key, kind="stable")]
        w = _train_shard(pdf["_t"], pdf["_y"].to_numpy(), bits, epochs)
        at = np.flatnonzero(w)
        return pd.DataFrame({"place": at, "w": w[at]})

    parts = rows.groupBy("_shard").applyInPandas(run, "place long, w double")
    used = max(1, min(shards, n))
    # at most 2 ** bits + 1 rows, whatever the corpus
    got = parts.groupBy("place").agg(F.sum("w").alias("w")).toPandas()
    out = np.zeros((1 << bits) + 1, dtype=np.float32)
    out[got["place"].to_numpy(dtype=np.int64)] = got["w"].to_numpy(dtype=np.float64) / used
    return out


def score_texts(col: pa.Array, model: np.ndarray, bits: int = BITS) -> np.ndarray:
    col = W.as_large_strings(col)
    out = []
    for a, b in W.slices(col, SLICE_BYTES):
        r, p, v = features(col.slice(a, b - a), bits)
        dot = np.bincount(r, weights=model[p] * v, minlength=b - a) + model[-1]
        out.append(1.0 / (1.0 + np.exp(-np.clip(dot, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def score(text: Column, model: np.ndarray, bits: int = BITS) -> Column:
    """Probability of label 1 as a column."""
    @F.arrow_udf(T.DoubleType())
    def run(t: pa.Array) -> pa.Array:
        return pa.array(score_texts(t, model, bits), type=pa.float64())
    return run(text)

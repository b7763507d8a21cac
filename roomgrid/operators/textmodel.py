"""Multinomial naive Bayes over token/gram counts, trained and applied as Spark jobs.

Used for language identification (character n-grams) and intent classification
(word tokens).  With Laplace smoothing, the log score of class c for a document with
token counts tf(g) is

    ln P(c) + sum_g tf(g) * ln((n_cg + 1) / (T_c + V))
  = ln P(c) - N_doc * ln(T_c + V) + sum_{g seen in training} tf(g) * ln(n_cg + 1)

(n_cg: count of g in class c, T_c: total tokens of c, V: vocabulary size, N_doc: tokens
in the document).  A trained model is three parquet tables below one folder: the counts,
one row of class weights per token, and the classes.  Scoring joins every token occurrence
to its weight row once and sums the classes in one aggregate per document; as the weights
are read from files, Spark knows their size and broadcasts them only while they are under
``spark.sql.autoBroadcastJoinThreshold``, else it shuffles and AQE splits hot tokens.

Character n-grams are counted inside the rows (``fit_grams``, ``predict_grams``): no row for an
occurrence, and each text is scored where it is read.  The tasks hold the weights while these take
at most ``MODEL_BYTES``; a larger model (many scripts) is joined as above, with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomgrid.session import scratch_path

SLICE_BYTES = 1 << 20    # text that is counted at a time
MODEL_BYTES = 32 << 20   # weights that are sent to every task


def letter_text(text: Column) -> Column:
    """Lower-cased letters, every other run as one space, with a space at both ends; '' for
    a text without letters.  So a text of one letter still has a trigram."""
    t = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" "), t, F.lit(" ")))


def char_grams(text: Column, n: int) -> Column:
    """All overlapping character n-grams of a text, in one pass of the regex engine."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def n_char_grams(text: Column, n: int) -> Column:
    return F.greatest(F.length(text) - n + 1, F.lit(0))


def _places(code: np.ndarray, size: int) -> tuple[int, np.ndarray]:
    """(number of distinct values, each element's place among them); all values are under ``size``."""
    if size > 2 * len(code) + 4096:
        values, place = np.unique(code, return_inverse=True)
        return len(values), place
    seen = np.zeros(size, bool)
    seen[code] = True
    place = np.cumsum(seen)
    return int(place[-1]) if size else 0, place[code] - 1


def grams_of(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Slices of a text column: (first row, number of rows, row of each n-gram, its place in the
    grams, the distinct grams).  A gram is n neighbouring code points of one text."""
    col = texts.cast(pa.large_string()).fill_null("")
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))])
    a = 0
    while a < len(col):
        b = min(max(int(np.searchsorted(ends, ends[a] + SLICE_BYTES, side="right")) - 1, a + 1), len(col))
        part = col.slice(a, b - a)
        size = pc.utf8_length(part).to_numpy(zero_copy_only=False)
        points = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(b - a), size)
        at = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
        letters, code = _places(points, 0x110000)
        gram, many = code[at], letters
        for j in range(1, n):
            if many * letters >= 1 << 62:
                many, gram = _places(gram, many)
            gram, many = gram * letters + code[at + j], many * letters
        many, gram = _places(gram, many)
        first = np.zeros(many, np.int64)
        first[gram] = at
        text = points[first[:, None] + np.arange(n)].tobytes().decode("utf-32-le")
        yield a, b - a, row[at], gram, pa.array([text[i:i + n] for i in range(0, len(text), n)], pa.string())
        a = b


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


@dataclass
class NBModel:
    path: str
    counts: DataFrame        # (label, token, n)
    weights: DataFrame       # (token, w): ln(n + 1) by class, in the order of ``classes``
    classes: list[tuple]     # [(label, n_docs, total_tokens)], one entry for each class
    vocab: int

    def class_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.classes, "label string, n_docs long, total long")

    @cached_property
    def table(self) -> tuple[pa.Array, np.ndarray] | None:
        """(tokens, weights by class and token), or None for a model over ``MODEL_BYTES``."""
        if self.vocab * 8 * (len(self.classes) + 2) > MODEL_BYTES:
            return None
        t = self.weights.toArrow().combine_chunks()
        flat = t["w"].combine_chunks().flatten() if t.num_rows else pa.array([], pa.float64())
        return (t["token"].combine_chunks().cast(pa.string()),
                np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(-1, len(self.classes)).T))


def load(spark: SparkSession, path: str) -> NBModel:
    """A model that ``fit`` saved."""
    classes = spark.read.schema("label string, n_docs long, total long, vocab long").parquet(f"{path}/classes")
    rows = sorted((r["label"], r["n_docs"], r["total"], r["vocab"]) for r in classes.collect())
    return NBModel(path, spark.read.schema("label string, token string, n long").parquet(f"{path}/counts"),
                   spark.read.schema("token string, w array<double>").parquet(f"{path}/weights"),
                   [r[:3] for r in rows], rows[0][3] if rows else 0)


def fit(docs: DataFrame, tokens: Column, label: Column, path: str | None = None) -> NBModel:
    """docs -> a saved model (below the shared scratch folder unless ``path`` is given).
    Counts have partial aggregation before the shuffle, so a frequent token or a dominant
    label does not load one task.  Rows without a label take no part.  ``explode_outer`` +
    a null filter is used instead of ``explode``: for ``explode`` the optimizer infers a
    ``size(tokens) > 0`` filter and builds every token array once more for it."""
    t = docs.filter(label.isNotNull()).select(label.cast("string").alias("label"), tokens.alias("toks"))
    occ = t.select("label", F.explode_outer("toks").alias("token")).filter(F.col("token").isNotNull())
    return _save(docs, label, occ.groupBy("label", "token").agg(F.count(F.lit(1)).alias("n")), path)


def fit_grams(docs: DataFrame, letters: Column, n: int, label: Column, path: str | None = None) -> NBModel:
    """``fit`` on the character n-grams of a text: a row for each label and gram of a slice of
    texts, not for each occurrence."""
    rows = docs.filter(label.isNotNull()).select(label.cast("string").alias("label"), letters.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, rows, row, gram, names in grams_of(batch.column(1), n):
                own = batch.column(0).slice(a, rows).dictionary_encode()
                key = own.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64) * len(names) + gram
                many, place = _places(key, len(own.dictionary) * len(names))
                at = np.zeros(many, np.int64)
                at[place] = key
                yield pa.RecordBatch.from_arrays(
                    [own.dictionary.take(pa.array(at // max(len(names), 1))), names.take(pa.array(at % max(len(names), 1))),
                     pa.array(np.bincount(place, minlength=many), pa.int64())], names=["label", "token", "n"])

    found = rows.mapInArrow(run, "label string, token string, n long")
    return _save(docs, label, found.groupBy("label", "token").agg(F.sum("n").alias("n")), path)


def _save(docs: DataFrame, label: Column, found: DataFrame, path: str | None) -> NBModel:
    """The model of the counts (label, token, n) of labelled texts."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "nb-model")
    docs = docs.filter(label.isNotNull())
    found.write.parquet(f"{path}/counts")
    counts = spark.read.schema("label string, token string, n long").parquet(f"{path}/counts")
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    ndocs = docs.groupBy(label.cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n_docs"))
    rows = ndocs.join(totals, "label", "left").collect()          # one row for each class
    classes = sorted((r["label"], int(r["n_docs"]), int(r["total"] or 0)) for r in rows)
    vocab = counts.select("token").distinct().count()
    (spark.createDataFrame([(*c, vocab) for c in classes], "label string, n_docs long, total long, vocab long")
     .coalesce(1).write.parquet(f"{path}/classes"))
    order = F.array(*[F.lit(c[0]) for c in classes]).cast("array<string>")
    (counts.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"))
     .select("token", F.transform(order, lambda c: F.log(F.coalesce(F.col("m")[c], F.lit(0)) + F.lit(1.0))).alias("w"))
     .write.parquet(f"{path}/weights"))
    return load(spark, path)


def predict(model: NBModel, docs: DataFrame, key: str, tokens: Column,
            n_tokens: Column | None = None) -> DataFrame:
    """-> (key, label, score, posterior) for the best class (score desc, label asc on ties).
    ``n_tokens`` (tokens per document) may be given as a cheap expression so that the
    token arrays are built only once.  Without any class nothing is predicted."""
    labels = [c[0] for c in model.classes]
    if not labels:
        return _nothing(docs, key)
    occ = (docs.select(key, F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())
           .join(model.weights, "token"))
    part = occ.groupBy(key).agg(F.array(*[F.sum(F.col("w")[i]) for i in range(len(labels))]).alias("s"))
    n_tok = docs.select(key, (n_tokens if n_tokens is not None else F.size(tokens))
                        .cast("long").alias("n_tok"))
    return _best(model, n_tok.join(part, key, "left"), key)


def predict_grams(model: NBModel, docs: DataFrame, key: str, letters: Column, n: int) -> DataFrame:
    """``predict`` by the character n-grams of a text, each text read once and summed inside its
    row.  As there, the texts of one key add up, and a null key has no sums."""
    if not model.classes:
        return _nothing(docs, key)
    if model.table is None:
        return predict(model, docs, key, char_grams(letters, n), n_char_grams(letters, n))
    tokens, weights = model.table

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def sums(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), len(weights)))
        for a, rows, row, gram, names in grams_of(texts, n):
            at = pc.index_in(names, value_set=tokens)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            own = np.zeros((len(weights), len(names)))
            own[:, known] = weights[:, at.drop_null().to_numpy()]
            for i, w in enumerate(own):
                out[a:a + rows, i] = np.bincount(row, weights=w[gram], minlength=rows)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(weights)), pa.array(out.ravel()))

    rows = docs.select(key, n_char_grams(letters, n).cast("long").alias("n_tok"), sums(letters).alias("_s"))
    every = Window.partitionBy(key)
    s = F.array(*[F.sum(F.col("_s")[i]).over(every) for i in range(len(weights))])
    return _best(model, rows.select(key, "n_tok", F.when(F.col(key).isNotNull(), s).alias("s")), key)


def _nothing(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key)).limit(0).select(key, F.lit(None).cast("string").alias("label"),
                                                   F.lit(None).cast("double").alias("score"),
                                                   F.lit(None).cast("double").alias("posterior"))


def _best(model: NBModel, j: DataFrame, key: str) -> DataFrame:
    """(key, n_tok, s: sums of weights by class) -> (key, label, score, posterior)."""
    total_docs = sum(c[1] for c in model.classes)
    constant = F.array(*[F.struct(F.lit(c[0]).alias("label"), F.lit(math.log(c[1] / total_docs)).alias("prior"),
                                  F.lit(math.log(c[2] + model.vocab) if c[2] + model.vocab else 0.0).alias("denom"))
                         for c in model.classes])
    j = j.withColumn("_c", F.transform(
        constant, lambda c, i: F.struct((c["prior"] - F.col("n_tok") * c["denom"]
                                         + F.coalesce(F.col("s")[i], F.lit(0.0))).alias("score"), c["label"].alias("label"))))
    # best = max score, ties to the smallest label (the classes are in that order)
    j = j.withColumn("_b", F.aggregate("_c", F.col("_c")[0], lambda acc, x: F.when(
        x["score"] > acc["score"], x).otherwise(acc)))
    # posterior of the best class: 1 / sum_c exp(s_c - s_best)
    post = F.lit(1.0) / F.aggregate("_c", F.lit(0.0), lambda acc, x: acc + F.exp(x["score"] - F.col("_b")["score"]))
    return j.select(F.col(key), F.col("_b.label").alias("label"), F.col("_b.score").alias("score"),
                    post.alias("posterior"))

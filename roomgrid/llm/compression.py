"""Quality rules by compression bands.

A text is compressed whole and in fixed chunks (zstandard).  The ratio of raw to compressed
bytes must lie in a band that depends on the length, as longer prose compresses better:
above it the text repeats itself, below it the text is noise or encoded data.  A text fails
when its whole ratio is out of band, or when chunks with more than ``CHUNK_SHARE`` of its
bytes are out of theirs (long texts with a bad part).  These bands are wide around prose of
any language and mean nothing for texts under 256 bytes, which pass.

``limits`` draws narrower bands from the corpus itself: for each quarter of an octave of length,
the median ratio of all distinct texts and their median deviation from it (a text is out beyond
``CUTOFF`` of the usual robust z-score).  Both are running medians over five neighbouring
classes, so that a large group of near copies, which have one length, does not pull them.  The
counts are exact, of ratios in thousandths: at most a few thousand numbers a class, whatever
the size of the corpus, and the same on every run.  ``judge`` applies both kinds of bands.

``measure`` also counts what simple rules need: words, characters in words, symbols,
repeated lines, and words in repeated windows of three words.

Defined results: a null text is an empty one (all counts 0, ratios 1, in band); each row is
measured alone, so repeated rows and ties are judged alike, and copies count once in the limits;
an empty table gives no rows.  Classes of fewer than ``MIN_TEXTS`` distinct texts have no limits
of their own: there the wide bands alone decide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomgrid.llm import words as W

LEVEL = 3
CHUNK = 2048
CHUNK_SHARE = 0.25
# (bytes from, lowest ratio, highest ratio)
BANDS = ((0, 0.0, float("inf")), (256, 1.15, 2.6), (1024, 1.45, 2.9), (4096, 1.55, 3.3), (16384, 1.6, 3.8))
CHUNK_BAND = (1.35, 3.0)
CLASSES_PER_OCTAVE = 4
SHORTEST = 256
MIN_TEXTS = 50
CUTOFF = 3.5            # of (x - median) / (1.4826 * median deviation)
NEIGHBOURS = 2

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")

SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("ratio", T.DoubleType()), T.StructField("chunk_share", T.DoubleType()),
    T.StructField("in_band", T.BooleanType()), T.StructField("n_bytes", T.LongType())])


def band(n_bytes: int) -> tuple[float, float]:
    return next((lo, hi) for a, lo, hi in reversed(BANDS) if n_bytes >= a)


def ratios(raw: bytes, compress) -> tuple[float, float]:
    """(whole ratio, share of the bytes in chunks out of their band); a rest of under half a
    chunk belongs to the chunk before it."""
    if not raw:
        return 1.0, 0.0
    whole = len(raw) / len(compress(raw))
    if len(raw) < 2 * CHUNK:
        return whole, 0.0
    cuts = list(range(0, len(raw) - CHUNK // 2, CHUNK)) + [len(raw)]
    bad = 0
    for a, b in zip(cuts, cuts[1:]):
        if not CHUNK_BAND[0] <= (b - a) / len(compress(raw[a:b])) <= CHUNK_BAND[1]:
            bad += b - a
    return whole, bad / len(raw)


def repeat_words(w: W.Words) -> np.ndarray:
    """Words of each row that lie in a three-word window found twice or more in the row."""
    out = np.zeros(w.n_docs, np.int64)
    if len(w.hash) < 3:
        return out
    h = W.chain(W.chain(w.hash[:-2], w.hash[1:-1]), w.hash[2:])
    at = np.flatnonzero(w.doc[:-2] == w.doc[2:])
    key = W.chain(w.doc[at].astype(np.uint64), h[at])
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[n[back] > 1]
    mark = np.zeros(len(w.hash), bool)
    for k in range(3):
        mark[twice + k] = True
    return np.bincount(w.doc[mark], minlength=w.n_docs).astype(np.int64)


def dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line and not _SPACES.fullmatch(line):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def measure_texts(col: pa.Array) -> pa.StructArray:
    import zstandard
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    col = W.as_large_strings(col)
    parts: list[list] = [[] for _ in SCHEMA]
    for a, b in W.slices(col):
        part = col.slice(a, b - a)
        w = W.Words(part)
        # bytes of words that begin a character
        heads = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80, dtype=np.int64)])
        chars = np.bincount(w.doc, weights=heads[w.end] - heads[w.start], minlength=b - a).astype(np.int64)
        texts = part.to_pylist()
        two = [ratios(t.encode(), compress) for t in texts]
        ok = []
        for t, (whole, share) in zip(texts, two):
            lo, hi = band(len(t.encode()))
            ok.append(lo <= whole <= hi and share <= CHUNK_SHARE)
        for out, values in zip(parts, (
                w.count, chars, [len(_SYMBOLS.findall(t)) for t in texts], [dup_lines(t) for t in texts],
                repeat_words(w), [x for x, _ in two], [x for _, x in two], ok, [len(t.encode()) for t in texts])):
            out.extend(np.asarray(values).tolist())
    return pa.StructArray.from_arrays(
        [pa.array(p, pa.bool_() if f.dataType == T.BooleanType() else pa.float64() if f.dataType == T.DoubleType()
                  else pa.int64()) for p, f in zip(parts, SCHEMA)], names=SCHEMA.names)


def measure(text: Column) -> Column:
    """All counts, ratios and the verdict ``in_band`` of a text as one struct column."""
    @F.arrow_udf(SCHEMA)
    def run(t: pa.Array) -> pa.Array:
        return measure_texts(t)
    return run(text)


def length_class(n_bytes: Column) -> Column:
    return F.floor(CLASSES_PER_OCTAVE * F.log2(F.greatest(n_bytes, F.lit(1)).cast("double"))).cast("int")


def _weighted_median(value: str, by: str) -> Column:
    """The smallest value that half of the counts ``n`` do not exceed; a window expression over
    a column of running counts ``upto``."""
    part = Window.partitionBy(by)
    return F.min(F.when(2 * F.col("upto") >= F.sum("n").over(part), F.col(value))).over(part)


def limits(measured: DataFrame) -> DataFrame:
    """(length_class, low, high) from rows with ``measure``'s fields and ``digest``, a hash of the
    text.  A row for each length class of enough distinct texts, some hundred at most."""
    rows = measured.filter((F.col("n_bytes") >= SHORTEST) & F.col("in_band")).select(
        length_class(F.col("n_bytes")).alias("length_class"), F.round(F.col("ratio") * 1000).cast("long").alias("bin"), "digest")
    # at most 3,800 bins a class: nothing below works on more rows than that
    bins = rows.distinct().groupBy("length_class", "bin").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("length_class")
    mid = bins.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("texts", F.sum("n").over(whole)) \
        .withColumn("middle", _weighted_median("bin", "length_class"))
    far = mid.groupBy("length_class", "texts", "middle", F.abs(F.col("bin") - F.col("middle")).alias("off")).agg(F.sum("n").alias("n"))
    spread = far.withColumn("upto", F.sum("n").over(whole.orderBy("off"))) \
        .withColumn("deviation", _weighted_median("off", "length_class"))
    classes = spread.filter(F.col("texts") >= MIN_TEXTS).select("length_class", "middle", "deviation").distinct()
    near = Window.partitionBy().orderBy("length_class").rangeBetween(-NEIGHBOURS, NEIGHBOURS)

    def smooth(c: str) -> Column:
        return F.percentile(c, F.lit(0.5)).over(near)

    wide = F.lit(CUTOFF * 1.4826) * smooth("deviation")
    return classes.select("length_class", ((smooth("middle") - wide) / 1000).alias("low"), ((smooth("middle") + wide) / 1000).alias("high"))


def judge(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """The rows with ``passes``: inside the wide bands and, where their length class has limits,
    inside those.  ``bands`` has a row for each length class, so it is broadcast."""
    limited = F.col("n_bytes") >= SHORTEST
    inside = F.coalesce(F.col("ratio").between(F.col("low"), F.col("high")), F.lit(True))
    return measured.withColumn("length_class", length_class(F.col("n_bytes"))).join(F.broadcast(bands), "length_class", "left") \
        .withColumn("passes", F.col("in_band") & (~limited | inside)).drop("low", "high", "length_class")

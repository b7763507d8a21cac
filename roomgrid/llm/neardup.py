"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Texts are sets of shingles (five words; a shorter text with words is one shingle) with a
weight of 1 to ``MOST``, rising with the occurrences.  Each weighted shingle is a Poisson process whose arrivals,
at a rate equal to its weight, fall on one of ``m`` registers; a register keeps the shingle
of its earliest arrival.  Arrivals later than the latest register minimum cannot matter, so
the drawing stops there (early termination).  Two texts agree in a register with their
probability Jaccard similarity, which is at least the Jaccard similarity of the shingle sets
over ``MOST``, however differently the shared passages repeat.

1. One pass over the texts yields a 128-bit digest of the word sequence, the signature and
   its band keys.  Exact copies collapse to one node, their digest, by a keyed minimum.
2. Band buckets of two or more texts propose pairs with a centre only: the member whose
   buckets are the largest, as the origin of a group of copies is.  So a bucket of n texts
   gives n - 1 pairs.  Two texts at 0.8 share a bucket with a probability of 0.9996 or more
   (24 bands of 4 at 0.8 / 1.1).
3. Pairs are verified on their whole texts: Jaccard of the shingle sets at or above
   ``threshold``.  Only pairs that the numbers of their shingles alone keep under it are spared.
4. Linked texts form classes (connected components).  Buckets that still hold texts of
   several classes are the rest: in tiles of bounded size, each text of a smaller class is
   compared with all texts of other classes at once, and only links are emitted, one for each
   text and other class.  So no link between classes that share a bucket is lost, and no pair
   is expanded.

Defined results: a null text or null id is alone (its class is its own id); texts without any
word are copies of each other; rows of equal words are exact copies, whatever their spaces;
repeated rows stay rows, in one class; rows that share an id are classed by their own texts, and
any of them may give a class its id; other columns, whatever their names, are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomgrid.llm import words as W
from roomgrid.llm.components import connected_components
from roomgrid.session import scratch_path

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 96
BANDS = 24
MOST = 1.1             # weight of a shingle without end of occurrences
TILE_CHARS = 4 << 20   # text of a bucket's tile; two tiles are compared in one piece


def shingles(words: W.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all shingles; a text of 1 to n - 1 words is one shingle."""
    h, doc = W.windows(words, n)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(short) == 0:
        return h, doc
    own, _ = sequence_digest(words)
    order = np.argsort(np.concatenate([doc, short]), kind="stable")
    return np.concatenate([h, W.mix(own[short])])[order], np.concatenate([doc, short])[order]


def sequence_digest(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's word sequence."""
    out = []
    n = len(words.hash)
    first = words.first_word[:-1]
    has = words.count > 0
    pos = np.arange(n) - np.repeat(first, words.count)
    p = W.powers(int(words.count.max()) + 1 if n else 1)
    for salt in (1, 2):
        d = np.zeros(words.n_docs, np.uint64)
        if n:
            part = W.mix(words.hash + np.uint64(salt)) * p[pos]
            d[has] = np.add.reduceat(part, first[has])
        out.append(W.mix(d + words.count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return out[0], out[1]


def signatures(words: W.Words, m: int = REGISTERS, n: int = SHINGLE) -> np.ndarray:
    """ProbMinHash signatures (rows x m, 32-bit); rows without shingles stay zero."""
    h, doc = shingles(words, n)
    out = np.zeros((words.n_docs, m), np.uint32)
    if len(h) == 0:
        return out
    _, at, tf = np.unique(W.chain(doc.astype(np.uint64), h), return_index=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    h, doc, rate = h[at[order]], doc[at[order]], MOST - (MOST - 1.0) / tf[order]
    present, row = np.unique(doc, return_inverse=True)
    best = np.full(len(present) * m, np.inf)
    who = np.zeros(len(present) * m, np.uint64)
    time = np.zeros(len(h))
    step = 0
    while len(h):
        draw = W.mix(h + np.uint64((step * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64)))
        time = time - np.log(W.uniform(draw)) / rate
        place = row * m + (W.mix(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, place, time)
        won = time == best[place]
        who[place[won]] = h[won]
        latest = best.reshape(-1, m).max(axis=1)
        go = time < latest[row]          # later arrivals cannot change a register
        h, time, rate, row = h[go], time[go], rate[go], row[go]
        step += 1
    out[present] = (W.mix(who) >> np.uint64(32)).astype(np.uint32).reshape(-1, m)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sig.shape[1] // bands
    keys = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            k = W.chain(k, sig[:, b * rows + r].astype(np.uint64))
        keys[:, b] = k
    return keys


SIG_SCHEMA = "id {}, has_text boolean, d1 long, d2 long, chars long, size long, bands array<long>"


def fingerprint(docs: DataFrame, id_col: str, text_col: str, m: int, bands: int, n: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = W.as_large_strings(batch.column(1))
            known = batch.column(1).is_valid()
            for a, b in W.slices(text):
                w = W.Words(text.slice(a, b - a))
                some = w.count > 0
                keys = band_keys(signatures(w, m, n), bands).view(np.int64)
                h, doc = shingles(w, n)
                _, at = np.unique(W.chain(doc.astype(np.uint64), h), return_index=True)
                size = np.bincount(doc[at], minlength=w.n_docs)
                d1, d2 = sequence_digest(w)
                flat = pa.array(keys[some].ravel())
                offs = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), known.slice(a, b - a),
                     pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(np.diff(w.offs)),
                     pa.array(size.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offs), flat)],
                    names=["id", "has_text", "d1", "d2", "chars", "size", "bands"])

    return rows.mapInArrow(run, SIG_SCHEMA.format(docs.schema[id_col].dataType.simpleString()))


def jaccard_texts(a: pa.Array, b: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """Jaccard similarity of the shingle sets of paired texts."""
    a, b = W.as_large_strings(a), W.as_large_strings(b)
    out = np.zeros(len(a))
    for lo, hi in W.slices(a):
        for x, y in W.slices(b.slice(lo, hi - lo)):
            sets = []
            for col in (a, b):
                h, d = shingles(W.Words(col.slice(lo + x, y - x)), n)
                sets.append(np.unique(W.chain(d.astype(np.uint64), h), return_index=True)[0::1] + (d,))
            (u, ui, ud), (v, vi, vd) = sets
            na = np.bincount(ud[ui], minlength=y - x)
            nb = np.bincount(vd[vi], minlength=y - x)
            _, iu, _ = np.intersect1d(u, v, assume_unique=True, return_indices=True)
            both = np.bincount(ud[ui][iu], minlength=y - x)
            out[lo + x:lo + y] = both / np.maximum(na + nb - both, 1)
    return out


def node(d1: Column, d2: Column) -> Column:
    """126 bits of a digest as one number, which stands for all texts with that word sequence."""
    high = F.shiftrightunsigned(d1, 2).cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")
    return (high + d2.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("decimal(38,0)")


@F.arrow_udf(T.StructType().add("d1", T.LongType()).add("d2", T.LongType()))
def digest(text: pa.Array) -> pa.Array:
    col = W.as_large_strings(text)
    d1, d2 = np.zeros(len(col), np.uint64), np.zeros(len(col), np.uint64)
    for a, b in W.slices(col):
        d1[a:b], d2[a:b] = sequence_digest(W.Words(col.slice(a, b - a)))
    return pa.StructArray.from_arrays([pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], names=["d1", "d2"])


def text_node(text: str) -> Column:
    d = digest(F.col(text))
    return node(d["d1"], d["d2"])


def _texts_of(reps: DataFrame, copies: DataFrame, texts: DataFrame) -> DataFrame:
    """(rep, t): one text of each of the given nodes.  The nodes and their smallest ids are
    written first, so that Spark knows how many there are when it plans the join: few are
    broadcast, many are shuffled, and the texts pass Spark's runtime Bloom filter before.  That
    is built for a side which a comparison narrows, hence the one that holds for all."""
    spark = reps.sparkSession
    path = scratch_path(spark, "wanted")
    reps.groupBy("rep").agg(F.count("*").alias("n")).join(copies.select("rep", "low"), "rep").write.parquet(path)
    wanted = spark.read.parquet(path).filter("n > 0").select("rep", "low")
    few = texts.join(wanted, F.col("id") == F.col("low")).filter(text_node("t") == F.col("rep"))   # an id may have other texts
    return few.groupBy("rep").agg(F.min("t").alias("t"))


def _verify(pairs: DataFrame, copies: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Pairs (a, b) of nodes -> links whose texts are similar enough."""
    pairs = pairs.checkpoint()
    few = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")), copies, texts)

    @F.arrow_udf(T.DoubleType())
    def jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(jaccard_texts(a, b, n))

    return (pairs.join(few.select(F.col("rep").alias("a"), F.col("t").alias("ta")), "a")
            .join(few.select(F.col("rep").alias("b"), F.col("t").alias("tb")), "b")
            .filter(jaccard("ta", "tb") >= threshold - 1e-12).select("a", "b").checkpoint())


def links_in_piece(reps: np.ndarray, classes: np.ndarray, minor: np.ndarray, col: pa.Array,
                   threshold: float, n: int) -> list[tuple[int, int]]:
    """Row pairs of a piece that link different classes, one for each text of a smaller class
    and other class.  A text is compared with all others at once: the texts of each of its
    shingles are counted."""
    w = W.Words(col)
    h, doc = shingles(w, n)
    _, at = np.unique(W.chain(doc.astype(np.uint64), h), return_index=True)
    at.sort()
    h, doc = h[at], doc[at]
    _, code = np.unique(h, return_inverse=True)
    size = np.bincount(doc, minlength=len(reps))
    cut = np.concatenate([[0], np.cumsum(size)])
    holders = doc[np.argsort(code, kind="stable")]        # the texts of each shingle, by code
    many = np.bincount(code)
    start = np.cumsum(many) - many
    least = threshold - 1e-12
    out = []
    for x in np.flatnonzero(minor & (size > 0)):
        other = (classes != classes[x]) & (np.minimum(size, size[x]) >= least * np.maximum(size, size[x]))
        if not other.any():
            continue
        own = code[cut[x]:cut[x + 1]]
        c = many[own]
        at = np.arange(c.sum()) + np.repeat(start[own] - np.cumsum(c) + c, c)
        shared = np.bincount(holders[at], minlength=len(reps))
        near = np.flatnonzero(other & (shared >= least * (size + size[x] - shared)))
        _, first = np.unique(classes[near], return_index=True)
        out += [(int(x), int(y)) for y in near[first]]
    return out


def _rest(buckets: DataFrame, reps: DataFrame, classes: DataFrame, copies: DataFrame, texts: DataFrame,
          threshold: float, n: int) -> DataFrame:
    """Verified links between different classes that share a bucket.

    A bucket is dealt into tiles of about ``TILE_CHARS`` of text, those of its largest class
    (major) apart from all others (minor), and each minor tile meets every tile once.  The
    members are written before that, so that the driver plans their joins once and alone."""
    rows = (buckets.filter("n > 2").select("key", "rep").join(classes, F.col("rep") == F.col("node"), "left")
            .join(reps.select("rep", "chars"), "rep")
            .select("key", "rep", "chars", F.coalesce("component", "rep").alias("class")).checkpoint())
    per = rows.groupBy("key", "class").agg(F.count("*").alias("c"), F.sum("chars").alias("chars"))
    tiles = lambda c: F.ceil(c / F.lit(TILE_CHARS)).cast("int") + 1
    split = (per.groupBy("key").agg(F.count("*").alias("k"), F.sum("chars").alias("all"),
                                    F.max(F.struct("c", "chars", "class")).alias("major")).filter("k > 1")
             .select("key", F.col("major.class").alias("major"), tiles(F.col("major.chars")).alias("t_major"),
                     tiles(F.col("all") - F.col("major.chars")).alias("t_minor")))
    rows = rows.join(split, "key").withColumn("minor", F.col("class") != F.col("major"))
    tile = F.pmod(F.xxhash64("rep"), F.when(F.col("minor"), F.col("t_minor")).otherwise(F.col("t_major"))).cast("int")
    rows = rows.withColumn("tile", tile)
    # a piece is a pair of tiles: (minor, minor) or (minor, -1 - major)
    pieces = F.when(~F.col("minor"), F.expr("transform(sequence(0, t_minor - 1), i -> struct(i as x, -1 - tile as y))")
                    ).otherwise(F.expr("""concat(
                        transform(sequence(0, t_minor - 1), i -> struct(least(i, tile) as x, greatest(i, tile) as y)),
                        transform(sequence(0, t_major - 1), j -> struct(tile as x, -1 - j as y)))"""))
    rows = rows.select("key", "rep", "class", "minor", F.explode(pieces).alias("p")).checkpoint()
    rows = (rows.join(_texts_of(rows, copies, texts), "rep").select("key", "p.x", "p.y", "rep", "class", "minor", "t")
            .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "rep"))
    kind = dict(rows.dtypes)["rep"]

    def links_of(t: pa.Table) -> pa.RecordBatch:
        ids = t.column("rep").combine_chunks()
        cls = t.column("class").to_pandas().factorize()[0]
        minor = t.column("minor").to_numpy().astype(bool)
        found = links_in_piece(ids, cls, minor, W.as_large_strings(t.column("t")), threshold, n)
        return pa.RecordBatch.from_arrays([ids.take(pa.array([p[k] for p in found], pa.int64())) for k in (0, 1)],
                                          names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []    # the rows of the piece at the end of what was read
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if sum(t.num_rows for t in held) > 1:
                yield links_of(pa.concat_tables(held))
            held.clear()

        for batch in batches:
            t = pa.Table.from_batches([batch])
            k = list(zip(*(t.column(c).to_pylist() for c in ("key", "x", "y"))))
            a = 0
            for b in range(1, len(k) + 1):
                if b == len(k) or k[b] != k[a]:
                    if k[a] != last:
                        yield from done()
                    held.append(t.slice(a, b - a))
                    last, a = k[a], b
        yield from done()

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct().checkpoint()


def _classes(base: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Signatures and texts (id, t) -> (rep, low, class): the nodes, their smallest ids, and
    the node that stands for their class."""
    part = base.filter(F.col("id").isNotNull() & F.col("has_text")).withColumn("rep", node(F.col("d1"), F.col("d2")))
    copies = part.groupBy("rep").agg(F.min("id").alias("low")).checkpoint()
    reps = (part.filter(F.size("bands") > 0).join(copies, "rep").filter("id = low")
            .groupBy("rep").agg(F.first(F.struct("size", "bands", "chars")).alias("s"))
            .select("rep", "s.size", "s.bands", "s.chars").checkpoint())
    keys = reps.select("rep", "size", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = keys.join(sizes, "key").checkpoint()
    weight = buckets.groupBy("rep").agg(F.sum("n").alias("weight"))
    best = buckets.select("key", "rep", "size").join(weight, "rep")
    centres = (best.groupBy("key").agg(F.max_by(F.struct("rep", "size"), F.struct("weight", F.xxhash64("rep"), "rep")).alias("c"))
               .select("key", F.col("c.rep").alias("centre"), F.col("c.size").alias("centre_size")))
    star = (buckets.join(centres, "key").filter("rep != centre")
            .filter(F.least("size", "centre_size") >= (threshold - 1e-12) * F.greatest("size", "centre_size"))
            .select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())
    links = _verify(star, copies, texts, threshold, shingle)
    classes = connected_components(links, "a", "b")
    more = _rest(buckets, reps, classes, copies, texts, threshold, shingle)
    if not more.isEmpty():
        classes = connected_components(
            classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")), "a", "b")
    return (copies.join(classes, F.col("rep") == F.col("node"), "left")
            .select("rep", "low", F.coalesce("component", "rep").alias("class")))


def _read(docs: DataFrame, id_col: str, text_col: str, m: int, bands: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    base = fingerprint(docs, id_col, text_col, m, bands, shingle).checkpoint()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("id is not null and t is not null")
    return base, texts


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, shingle: int = SHINGLE, m: int = REGISTERS,
                    bands: int = BANDS) -> DataFrame:
    """One row (id, class_id) for each row of ``docs``."""
    base, texts = _read(docs, id_col, text_col, m, bands, shingle)
    classes = _classes(base, texts, threshold, shingle).checkpoint()
    least = classes.groupBy("class").agg(F.min("low").alias("class_id"))
    named = classes.join(least, "class").select("rep", "class_id")
    alone = F.col("id").isNull() | ~F.col("has_text")
    return (base.select("id", F.when(~alone, node(F.col("d1"), F.col("d2"))).alias("rep"))
            .join(named, "rep", "left")
            .select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id")))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                  shingle: int = SHINGLE, m: int = REGISTERS, bands: int = BANDS) -> DataFrame:
    """The documents with one of each class: that of the smallest id, and of several rows with
    that id and word sequence the one with the smallest text.  Rows without an id or a text stay.

    Only ids with several rows need their texts' digests again; for the others the id decides."""
    base, texts = _read(docs, id_col, text_col, m, bands, shingle)
    classes = _classes(base, texts, threshold, shingle)
    first = (classes.groupBy("class").agg(F.min(F.struct("low", "rep")).alias("f"))
             .select(F.col("f.low").alias("low"), F.col("f.rep").alias("rep")).checkpoint())
    path = scratch_path(docs.sparkSession, "several")      # written, as usually none has, and the plan should know
    (base.filter(F.col("id").isNotNull() & F.col("has_text")).groupBy(F.col("id").alias("low")).agg(F.count("*").alias("n"))
     .filter("n > 1").write.parquet(path))
    several = docs.sparkSession.read.parquet(path).filter("n > 1").select("low")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("low"),
                       F.col(text_col).alias("t"))
    known = rows.filter("low is not null and t is not null")
    once = known.join(first.join(several, "low", "left_anti"), "low", "left_semi").select("row")
    again = (known.join(several, "low", "left_semi").join(first, "low").filter(text_node("t") == F.col("rep"))
             .groupBy("low", "rep").agg(F.min_by("row", "t").alias("row")).select("row"))
    kept = rows.filter("low is null or t is null").select("row").unionAll(once).unionAll(again)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

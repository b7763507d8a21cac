"""SimHash near-duplicates by bit-sliced comparison.

A text's words (runs of ``[^\\x20\\x09-\\x0D]``, A-Z lowered) give shingles of ``SHINGLE``
words joined by one space, repeats included; a text of fewer words is one shingle.  A bit of
the fingerprint is set if it is set in over half of the shingles' XXH64 values (seed 42).
Fingerprints that differ in at most ``RADIUS`` bits are linked.

1. One pass over the texts yields the fingerprints; equal ones collapse by a keyed minimum.
2. The 64 bits are cut into radius + 2 parts.  Two fingerprints within the radius agree in two
   parts at least, so each pair of parts is one table of buckets and no link is lost.  The bits
   on which a bucket of over ``BLOCK`` fingerprints does not agree yet are cut in the same way,
   up to ``LEVELS`` times; what is still too large is dealt into tiles, and each pair of tiles
   is compared once.  So no task gets more than two tiles of a bucket.
3. A block of fingerprints is held as 64 vertical bit planes.  The distances of one
   fingerprint to 64 others are one word of each carry-save counter; a word whose 64 distances
   all exceed the radius is abandoned.  A block emits one link less than each of its components
   has members, never all pairs.
4. Connected components of the links, then the smallest id of each.

Defined results: a null text is a text without words, whose fingerprint is zero and is linked
like any other; a row without an id gets its component's smallest id (null if none has one);
repeated rows stay rows; other columns, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomgrid.llm import words as W
from roomgrid.llm.components import connected_components

SHINGLE = 3
RADIUS = 3
SEED = 42
BLOCK = 4096      # fingerprints of a bucket that are compared with each other at once
LEVELS = 3        # times that an over-full bucket is dealt by more bits
QUERIES = 512     # fingerprints compared with a block at a time
HASHES = 1 << 18  # shingles hashed at a time
LOOKS = (15, 19, 23, 31, 47)   # planes after which exhausted words are abandoned

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
# each byte's bits as eight bytes of 0 or 1, least first
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def joined_words(text: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, each followed by one space; starts; ends; words of each row)."""
    buf, offs = W.buffers(text)
    n_docs = len(text)
    space = W._SPACE[buf]
    border = np.zeros(len(buf) + 1, dtype=bool)
    border[offs] = True
    edge = border[:-1].copy()
    if len(buf):
        edge[1:] |= space[:-1]
    start = np.flatnonzero(~space & edge)
    stop = border[1:].copy()
    if len(buf):
        stop[:-1] |= space[1:]
    end = np.flatnonzero(~space & stop) + 1
    count = np.diff(np.searchsorted(start, offs)) if n_docs else np.zeros(0, np.int64)
    size = end - start + 1
    out_end = np.cumsum(size)
    out = np.full(int(out_end[-1]) if len(size) else 0, 0x20, np.uint8)
    place = np.ones(len(out), dtype=bool)
    place[out_end - 1] = False
    out[place] = W._LOWER[buf[~space]]
    return out.tobytes(), out_end - size, out_end - 1, count


def fingerprints(text: pa.Array, n: int = SHINGLE) -> np.ndarray:
    """Fingerprints (64-bit unsigned) of a large_string array without nulls."""
    out = np.zeros(len(text), np.uint64)
    for a, b in W.slices(text):
        out[a:b] = _fingerprints(text.slice(a, b - a), n)
    return out


def _fingerprints(text: pa.Array, n: int) -> np.ndarray:
    buf, start, end, count = joined_words(text)
    number = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))   # shingles of each row
    cut = np.concatenate([[0], np.cumsum(number)])
    word = np.concatenate([[0], np.cumsum(count)])
    ones = np.zeros((len(count), 64), np.int64)
    for a in range(0, int(cut[-1]), HASHES):
        b = min(a + HASHES, int(cut[-1]))
        k = np.arange(a, b)
        doc = np.searchsorted(cut, k, side="right") - 1
        first = word[doc] + k - cut[doc]
        last = first + np.minimum(count[doc], n) - 1
        spans = map(buf.__getitem__, map(slice, start[first].tolist(), end[last].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, spans, repeat(SEED)), np.uint64, b - a)
        lanes = _SPREAD[h.astype("<u8").view(np.uint8).reshape(-1, 8)]     # eight counters in a word
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        since = k - a - np.repeat(new, np.diff(np.append(new, b - a)))
        piece = np.flatnonzero(since % 255 == 0)                           # no counter passes 255
        part = np.add.reduceat(lanes, piece, axis=0).view(np.uint8).astype(np.int64)
        np.add.at(ones, doc[piece], part)
    bits = (2 * ones > number[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(fingerprints(W.as_large_strings(text)).view(np.int64))


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: bit j of word w of plane b is bit b of fingerprint 64 w + j."""
    wide = np.zeros(-(-len(prints) // 64) * 64, "<u8")
    wide[:len(prints)] = prints
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def neighbours(prints: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Words of the symmetric link matrix: bit j of [i, w] is set if fingerprints i and
    64 w + j, another one, differ in at most ``radius`` bits."""
    plane = planes(prints)
    n, width = len(prints), plane.shape[1]
    out = np.zeros((n, width), np.uint64)
    digits = radius.bit_length()
    spare = (1 << digits) - 1 - radius             # so that the counters overflow beyond the radius
    for lo in range(0, n, QUERIES):
        q = prints[lo:lo + QUERIES]
        row, col = np.divmod(np.arange(len(q) * width), width)
        count = [np.full(len(row), _ALL if spare >> d & 1 else 0, np.uint64) for d in range(digits)]
        over = np.zeros(len(row), np.uint64)
        for b in range(64):
            own = np.uint64(0) - (q >> np.uint64(b) & np.uint64(1))
            carry = plane[b][col] ^ own[row]
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            over |= carry
            if b in LOOKS:
                go = np.flatnonzero(over != _ALL)
                row, col, over = row[go], col[go], over[go]
                count = [c[go] for c in count]
        out[lo + row, col] = ~over
    if n % 64:
        out[:, -1] &= np.uint64((1 << n % 64) - 1)
    i = np.arange(n)
    out[i, i // 64] &= ~(np.uint64(1) << (i % 64).astype(np.uint64))
    return out


def spanning_links(prints: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) of each component of distinct, ascending fingerprints."""
    near = neighbours(prints, radius)
    seen = np.zeros(len(prints), dtype=bool)
    members, roots = [], []
    for i in np.flatnonzero(near.any(axis=1)):
        if seen[i]:
            continue
        seen[i] = True
        front = np.array([i])
        while len(front):
            reach = np.bitwise_or.reduce(near[front], axis=0)
            found = np.unpackbits(reach.astype("<u8").view(np.uint8), bitorder="little")[:len(prints)]
            front = np.flatnonzero(found.astype(bool) & ~seen)
            seen[front] = True
            members.append(front)
            roots.append(np.full(len(front), i))
    if not members:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return prints[np.concatenate(members)], prints[np.concatenate(roots)]


def refined(mask: int, radius: int) -> list[int]:
    """Masks of more bits: of those outside ``mask``, cut into radius + 2 parts, each two."""
    free = [b for b in range(64) if not mask >> b & 1]
    parts = [free[k::radius + 2] for k in range(radius + 2)]
    return [mask | sum(1 << b for b in x + y) for x, y in combinations(parts, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pieces(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints -> (mask, bits, x, y, fp): groups of at most about two blocks, in
    one of which every two fingerprints within the radius meet."""
    spark = prints.sparkSession
    masks, rows, done = [0], prints.select("fp", F.lit(0).cast("long").alias("mask")), []
    for level in range(LEVELS):
        steps = [(m, r) for m in masks for r in refined(m, radius)]
        masks = sorted({r for _, r in steps})
        table = spark.createDataFrame([(_signed(m), _signed(r)) for m, r in steps], "mask long, next long")
        rows = (rows.join(F.broadcast(table), "mask")      # at most (parts choose 2) ^ LEVELS rows
                .select("fp", F.col("next").alias("mask"), F.col("fp").bitwiseAND(F.col("next")).alias("bits")))
        if level:
            rows = rows.distinct()                         # tables of different masks can refine to one
        sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1")
        met = rows.join(sizes, ["mask", "bits"]).checkpoint()
        done.append(met.filter(F.col("n") <= BLOCK).select(
            "mask", "bits", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp"))
        rows = met.filter(F.col("n") > BLOCK)
        if rows.isEmpty():
            break
        if level < LEVELS - 1:
            rows = rows.select("fp", "mask")
    else:
        tiles = F.ceil(F.col("n") / BLOCK).cast("int") + 1
        tile = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        pair = F.explode(F.expr("filter(transform(sequence(0, k - 1), i -> "
                                "struct(least(i, t) as x, greatest(i, t) as y)), p -> p.x < p.y)"))
        done.append(rows.withColumn("k", tiles).withColumn("t", tile).select("mask", "bits", "fp", pair.alias("p"))
                    .select("mask", "bits", "p.x", "p.y", "fp"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that connect all within the radius."""
    group = ["mask", "bits", "x", "y"]
    rows = _pieces(prints, radius).repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, last = [], 0, None   # rows of whole groups, then of the one at the end

        def compared() -> pa.RecordBatch:
            u, v = spanning_links(np.unique(np.concatenate(held)), radius)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            fp = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            new = np.zeros(len(fp), dtype=bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last is not None and tuple(int(c[0]) for c in cols) != last
            last = tuple(int(c[-1]) for c in cols)
            a = 0
            for b in np.flatnonzero(new):
                held.append(fp[a:b])
                held_key += b - a
                a = b
                if held_key >= BLOCK:      # only at the border of a group
                    yield compared()
                    held_key = 0
            held.append(fp[a:])
            held_key += len(fp) - a
        if held_key:
            yield compared()

    return rows.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id) of each row of ``docs``."""
    base = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")).checkpoint()
    low = base.groupBy("fp").agg(F.min("id").alias("low"))
    classes = connected_components(links(low.select("fp"), radius).checkpoint())
    named = classes.join(low, F.col("node") == F.col("fp"))
    least = named.groupBy("component").agg(F.min("low").alias("least"))
    linked = named.join(least, "component").select("fp", "least")
    return (base.join(low, "fp").join(linked, "fp", "left")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    F.coalesce("least", "low").alias("component_id")))

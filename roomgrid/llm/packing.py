"""Best-fit packing of tokenised documents into sequences by bin completion.

Documents longer than the capacity are cut (the first piece is the shorter one); a piece's
place depends on its length alone, so pieces of one length are interchangeable and the
packing problem is the histogram of lengths: at most ``capacity`` counts however large the
corpus.  Bin completion with branch and bound solves it:

* a node takes the largest remaining piece and enumerates fillings of the rest of its
  sequence, dropping dominated ones (some of the chosen pieces could be exchanged for one
  remaining piece of at least their size that still fits);
* a filling is used as often as the counts allow in one step, the fillings of least waste
  first, so the first descent is a best-fit packing and becomes the incumbent;
* a node is pruned when its waste exceeds what a packing with one sequence less than the
  incumbent may waste, and the search ends at the volume bound or after ``nodes`` nodes.

The steps give patterns (lengths, how often).  The pieces then find their places in Spark: a
piece's rank among those of its length, counted in parallel over hash buckets, selects the
pattern, the sequence and the offset by one search in the pattern table (at most a row for
each length of each pattern).

Defined results: a null text is empty and yields the end id alone; null ids are kept;
repeated rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from roomgrid.llm import tokens
from roomgrid.llm import words as W

CAPACITY = 1024
END_ID = 2
NODES = 2_500
BUCKET_ROWS = 50_000


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]) of every document."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.UnitTokenizer(tokenizer_path)
        for ids_col, text in gathered(batches, tokens.CHUNK_BYTES):
            for a, b in W.slices(text, tokens.CHUNK_BYTES):
                ids, count = tok.encode(text.slice(a, b - a))
                total = count + 1
                n_pieces = -(-total // capacity)
                doc = np.repeat(np.arange(b - a), n_pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                head = total - (n_pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                flat = np.full(int(total.sum()), end_id, "<u4")
                stop = np.cumsum(total)
                keep = np.ones(len(flat), bool)
                keep[stop - 1] = False
                flat[keep] = ids
                at = (stop - total)[doc] + start
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * x:4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist())]
                cols = [ids_col.slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                        pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    # the pieces lie end to end, in order
                    cols.append(pa.ListArray.from_arrays(
                        pa.array(np.append(at, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    cols, names=["id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    return rows.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of consecutive batches put together up to about ``max_bytes``."""
    held, size = [], 0
    for batch in batches:
        text = W.as_large_strings(batch.column(1))
        held.append((batch.column(0), text))
        size += text.nbytes
        if size >= max_bytes:
            yield pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([t for _, t in held])
            held, size = [], 0
    if held:
        yield pa.concat_arrays([x for x, _ in held]), pa.concat_arrays([t for _, t in held])


# ---------------------------------------------------------------- bin completion
class _Search:
    def __init__(self, counts: dict[int, int], capacity: int, nodes: int):
        self.cap, self.nodes = capacity, nodes
        self.left = dict(counts)
        self.bits = sum(1 << s for s, n in counts.items() if n)
        volume = sum(s * n for s, n in counts.items())
        self.volume = volume
        alone = sum(n for s, n in counts.items() if 2 * s > capacity)
        self.bound = max(-(-volume // capacity), alone)
        self.best: list[tuple[tuple[int, ...], int]] | None = None
        self.best_bins = sum(counts.values()) + 1

    def largest(self, limit: int) -> int:
        """Largest remaining length of at most ``limit`` (0: none)."""
        b = self.bits & ((2 << limit) - 1)
        return b.bit_length() - 1 if b else 0

    def change(self, filling: tuple[int, ...], times: int) -> None:
        for s in filling:
            n = self.left[s] = self.left[s] - times
            if n:
                self.bits |= 1 << s
            else:
                self.bits &= ~(1 << s)

    def times(self, filling: tuple[int, ...]) -> int:
        return min(self.left[s] // filling.count(s) for s in set(filling))

    def dominated(self, filling: tuple[int, ...], slack: int) -> bool:
        for k in range(1, min(len(filling), 3) + 1):
            for part in set(combinations(filling, k)):
                s = sum(part)
                x = self.largest(s + slack)
                if x > s or (x == s and k > 1):
                    return True
        return False

    def fillings(self, first: int, steps: int = 120, most: int = 4) -> list[tuple[int, tuple[int, ...]]]:
        """(waste, lengths) of undominated fillings around ``first``, least waste first."""
        out: list[tuple[int, tuple[int, ...]]] = []
        self.change((first,), 1)
        budget = [steps]

        def extend(slack: int, top: int, taken: tuple[int, ...]) -> None:
            x = self.largest(min(slack, top))
            if not x:
                out.append((slack, taken))
                return
            tried = 0
            while x and budget[0] > 0 and tried < 12 and sum(w == 0 for w, _ in out) < most:
                budget[0] -= 1
                tried += 1
                self.change((x,), 1)
                extend(slack - x, x, taken + (x,))
                self.change((x,), -1)
                x = self.largest(x - 1)

        extend(self.cap - first, self.cap, ())
        if not out:     # the step limit fell before any filling was complete: best fit
            slack, taken = self.cap - first, ()
            while x := self.largest(slack):
                self.change((x,), 1)
                taken, slack = taken + (x,), slack - x
            self.change(taken, -1)
            out.append((slack, taken))
        good = [(w, f) for w, f in sorted(set(out), key=lambda e: (e[0], tuple(-s for s in e[1])))[:4 * most]
                if not self.dominated(f, w)] or [min(out)]
        self.change((first,), -1)
        return [(w, (first,) + f) for w, f in good[:most]]

    def run(self) -> list[tuple[tuple[int, ...], int]]:
        """Depth first with an explicit stack: (choices, next choice, applied step)."""
        path: list[tuple[tuple[int, ...], int]] = []
        stack: list[list] = []
        bins = waste = 0
        while True:
            self.nodes -= 1
            first = self.largest(self.cap)
            down = True
            if not first:
                if bins < self.best_bins:
                    self.best, self.best_bins = list(path), bins
                down = False
            elif self.best is not None and waste > (self.best_bins - 1) * self.cap - self.volume:
                down = False
            if self.best is not None and (self.best_bins <= self.bound or self.nodes <= 0):
                return self.best
            if down:
                stack.append([self.fillings(first), 0])
            while stack:
                choices, k = stack[-1]
                if len(path) == len(stack):      # undo this level's step
                    filling, n = path.pop()
                    self.change(filling, -n)
                    bins -= n
                    waste -= n * (self.cap - sum(filling))
                if k < len(choices):
                    stack[-1][1] += 1
                    w, filling = choices[k]
                    n = self.times(filling)
                    self.change(filling, n)
                    path.append((filling, n))
                    bins += n
                    waste += n * w
                    break
                stack.pop()
            else:
                return self.best or []


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY,
                   nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a sequence, number of such sequences) that use up ``counts``."""
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    return _Search(counts, capacity, nodes).run()


def pattern_table(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, offset), by length and rank."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for filling, n in patterns:
        offset = 0
        for s in sorted(set(filling), reverse=True):
            m = filling.count(s)
            rows.append((s, used.get(s, 0), m, seq, offset))
            used[s] = used.get(s, 0) + m * n
            offset += m * s
        seq += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(lengths: DataFrame, keys: list[str], capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have a ``length`` (1 to capacity).
    ``keys`` order the rows of one length.  ``lengths`` is read several times: pass a
    written table or a checkpoint."""
    counts = {r["length"]: r["count"] for r in lengths.groupBy("length").count().collect()}  # <= capacity rows
    table = pattern_table(bin_completion(counts, capacity, nodes))
    width = 1 + max([0, *counts.values()])
    starts = table[:, 0] * width + table[:, 1]

    @F.arrow_udf(T.LongType())
    def find(length: pa.Array, rank: pa.Array) -> pa.Array:
        s, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        row = table[np.searchsorted(starts, s * width + r, side="right") - 1]
        j = r - row[:, 1]
        return pa.array((row[:, 3] + j // row[:, 2]) * (2 * capacity) + row[:, 4] + (j % row[:, 2]) * s)

    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    rows = lengths.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = (rows.groupBy("length", "_b").count()
              .select("length", "_b", (F.sum("count").over(Window.partitionBy("length").orderBy("_b")) - F.col("count"))
                      .alias("_before")))
    order = Window.partitionBy("length", "_b").orderBy(*keys)
    return (rows.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_b"])
            .withColumn("_at", find(F.col("length"), F.col("_rank") + F.col("_before")))
            .withColumn("sequence_id", F.floor(F.col("_at") / (2 * capacity)).cast("long"))
            .withColumn("offset", F.pmod("_at", F.lit(2 * capacity)).cast("long"))
            .drop("_b", "_rank", "_before", "_at"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id).checkpoint()
    return place(cut, ["id", "piece", "ids_crc32"], capacity).select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
              capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents in them."""
    cut = pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids=True).checkpoint()
    placed = place(cut, ["id", "piece", "ids_crc32"], capacity)
    part = F.sort_array(F.collect_list(F.struct("offset", "id", "piece", "ids")))
    return (placed.groupBy("sequence_id").agg(part.alias("p"))
            .select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.id").alias("ids_of"),
                    F.col("p.offset").alias("offsets")))

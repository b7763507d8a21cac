"""The trie of all conversation prefixes, from sorted sequences and range minima.

A conversation is a sequence of turns; each distinct sequence of its first d turns is a node
at depth d, and the conversations that begin with it are the node's members.

1. Each conversation becomes one row: the 128-bit digests of its turns, and their words.
2. The rows are sorted by (digests, id) over range partitions, so members of a node lie next
   to each other, however many there are, and those that end at the node come first, by id.
   Ranges split even equal sequences, by id.  ``lcp[i]`` is the number of first turns that
   row i shares with the row before; a small table has it for the rows at range borders.
3. In each range a sparse table holds the minima of ``lcp`` over all spans of 2^k rows.  For
   every prefix of every row two binary searches over it, independent of each other, give how
   far left and right all rows share the prefix.  A node is the prefix of its leftmost row.
4. Sums over a node's subtree are differences of running sums over the sorted rows: a row that
   the next one does not repeat or extend is a leaf; and each row after the node's first
   saves the words of the turns that it shares with the row before, less those above the node.
5. Nodes across a border of ranges (no more than the turns shared there) come as parts, which
   are added up by key; all other nodes are whole where they are found.

No text is shuffled.  One conversation's digests (16 bytes a turn) and words are one row.

Defined results: null roles and texts are empty; rows without a conversation id take no part;
turns of one number are in the order of role and digest, null numbers first; repeated rows are
repeated turns; other columns, whatever their names, are not read; without conversations there
is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST = 16  # bytes of a turn's digest

_WORD = "[^\\x20\\x09-\\x0D]+"
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
# key: digest of a node across a border; above: key of a parent across a border; ends: ids, joined
PART = NODE + ", key binary, above binary, part int, shared long, prefix_words long, ends string"
_PART_COLS = [c.split()[0] for c in PART.split(", ")]


def turn_lists(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """Rows by turn -> (conv, turns): each conversation's digests (hex) and words in order."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    one = F.struct(F.col(turn).alias("turn"), r.alias("role"),
                   F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)).alias("digest"),
                   F.regexp_count(t, F.lit(_WORD)).cast("long").alias("words"))
    return (rows.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), one.alias("one"))
            .groupBy("conv").agg(F.array_sort(F.collect_list("one")).alias("turns"))
            .select("conv", F.transform("turns", lambda x: F.struct(x["digest"], x["words"])).alias("turns")))


def with_heads(lists: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Replace the first ``heads`` turns (at most ``most``) of each conversation by those of the
    conversation ``base``: all if it has fewer, none if it is absent."""
    first = lists.select(F.col("conv").alias("_of"), F.slice("turns", 1, most).alias("_first"))
    own = lists.withColumn("_of", base).withColumn("_h", heads.cast("int"))
    kept = F.when(F.size("turns") > F.col("_h"), F.expr("slice(turns, _h + 1, size(turns) - _h)")).otherwise(
        F.expr("slice(turns, 1, 0)"))
    taken = F.coalesce(F.expr("slice(_first, 1, _h)"), F.expr("slice(turns, 1, 0)"))
    return own.join(first, "_of", "left").select("conv", F.concat(taken, kept).alias("turns"))


def sorted_rows(lists: DataFrame) -> DataFrame:
    """(part, conv, path, words) in the order of (path, conv) over and in the parts."""
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    rows = lists.select("conv", path.alias("path"), F.transform("turns", lambda x: x["words"]).alias("words"))
    return (rows.repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
            .select(F.spark_partition_id().alias("part"), "conv", "path", "words").checkpoint())


def common(a: bytes, b: bytes) -> int:
    """First turns that two paths share."""
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    x, y = (np.frombuffer(p, np.uint8, n * DIGEST).reshape(n, DIGEST) for p in (a, b))
    return int((x != y).any(axis=1).argmax())


def borders(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """part -> turns shared with the row before its first, and with the row after its last;
    -1 at either end of all rows.  The driver gets two numbers for each range."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first if first is not None else batch.slice(0, 1)
                last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield pa.RecordBatch.from_arrays([first.column(0), first.column(1), last.column(1)], names=["part", "first", "last"])

    edge = rows.select("part", "path").mapInArrow(ends, "part int, first binary, last binary")

    def shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None                       # one row for each range, in order
        for f in frames:
            out = []
            for part, first, last in zip(f["part"], f["first"], f["last"]):
                out.append((part, -1 if before is None else common(bytes(before), bytes(first))))
                before = last
            yield pd.DataFrame(out, columns=["part", "left"])

    left = {r["part"]: r["left"] for r in edge.repartition(1).sortWithinPartitions("part").mapInPandas(
        shared, "part int, left long").collect()}
    parts = sorted(left)
    return {p: (left[p], left[parts[k + 1]] if k + 1 < len(parts) else -1) for k, p in enumerate(parts)}


class RangeMinimum:
    """Sparse table: level k holds the minimum of the 2^k values from each place."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            half, low = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest r >= at such that all values in at + 1 .. r are at least ``least``."""
        r = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            low = self.levels[k]
            ok = np.flatnonzero(r + 1 < len(low))
            ok = ok[low[r[ok] + 1] >= least[ok]]
            r[ok] += 1 << k
        return r

    def left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest l <= at such that all values in l + 1 .. at are at least ``least``."""
        l = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            start = l - (1 << k) + 1
            ok = np.flatnonzero(start >= 1)
            ok = ok[self.levels[k][start[ok]] >= least[ok]]
            l[ok] -= 1 << k
        return l

    def least(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Minimum of the values in l .. r."""
        k = np.log2(r - l + 1).astype(np.int64)
        out = np.empty(len(l), self.levels[0].dtype)
        for level in np.unique(k):
            on = np.flatnonzero(k == level)
            low = self.levels[level]
            out[on] = np.minimum(low[l[on]], low[r[on] - (1 << level) + 1])
        return out


def prefix_keys(path: bytes, most: int) -> list[bytes]:
    """Keys of the prefixes of 0 .. most turns, by a running digest."""
    h, out = hashlib.md5(), []
    for k in range(most + 1):
        if k:
            h.update(path[(k - 1) * DIGEST:k * DIGEST])
        out.append(h.digest() + k.to_bytes(8, "big"))
    return out


def nodes_of_range(part: int, conv: np.ndarray, path: list[bytes], words: list, edge: tuple[int, int]) -> pd.DataFrame:
    """Nodes (whole, or parts of those across a border) of sorted rows."""
    m = len(conv)
    size = np.array([len(p) // DIGEST for p in path], np.int64)
    lcp = np.empty(m + 1, np.int64)                       # lcp[m]: with the first row of the next range
    lcp[0], lcp[m] = edge
    for i in range(1, m):
        lcp[i] = common(path[i - 1], path[i])
    start = np.concatenate([[0], np.cumsum(size + 1)])    # prefixes of row i: start[i] .. start[i] + size[i]
    row = np.repeat(np.arange(m), size + 1)
    depth = np.arange(start[m]) - start[row]
    flat = np.zeros(start[m], np.int64)
    flat[depth > 0] = np.concatenate([np.asarray(w, np.int64) for w in words])
    run = np.cumsum(flat)
    above = run - run[start[row]]                         # words of each prefix
    shared = above[start[:-1] + np.maximum(lcp[:m], 0)]
    shared_run = np.concatenate([[0], np.cumsum(shared)])
    leaf_run = np.concatenate([[0], np.cumsum(size > lcp[1:])])
    table, low = RangeMinimum(lcp[:m]), RangeMinimum(conv)
    l, r = table.left(row, depth), table.right(row, depth)
    own = np.flatnonzero(l == row)                        # a node's prefix in its leftmost row
    l, r, d = l[own], r[own], depth[own]
    up_l, up_r = table.left(l, d - 1), table.right(l, d - 1)    # the parent, by the prefix one turn shorter

    def crossing(l, r, d):
        return (l == 0) & (d <= lcp[0]), (r == m - 1) & (d <= lcp[m])

    again, goes_on = crossing(l, r, d)                    # part of a node of the range before, of the next one
    up_again, up_goes_on = crossing(up_l, up_r, d - 1)
    across, up_across = again | goes_on, (d > 0) & (up_again | up_goes_on)
    parent = low.least(up_l, up_r).astype(object)
    parent[(d == 0) | up_across] = None
    # a child begins at each row that leaves the row before at the node's depth, and goes on
    begin = np.flatnonzero((lcp[:m] >= 0) & (size > lcp[:m]))
    begin = np.sort(lcp[begin] * (m + 1) + begin)
    children = (np.searchsorted(begin, d * (m + 1) + r, side="right") - np.searchsorted(begin, d * (m + 1) + l, side="right")
                + ((size[l] > d) & ~((l == 0) & (d < lcp[0]))))
    saved = shared_run[r + 1] - shared_run[np.where(again, l, l + 1)]    # of all rows but the node's first
    above_node = np.where(d > 0, above[start[l] + np.maximum(d - 1, 0)], 0)
    # rows equal to row i, which are the conversations that end at its whole path
    new = np.append(True, (size[1:] != size[:-1]) | (lcp[1:m] != size[1:]))
    runs = np.append(np.flatnonzero(new), m)
    last = runs[np.searchsorted(runs, np.arange(m), side="right")]
    first_keys = prefix_keys(path[0], max(lcp[0], 0))
    last_keys = prefix_keys(path[-1], max(lcp[m], 0))
    n = len(own)
    key, up, ends = [None] * n, [None] * n, [None] * n
    sha = np.full(n, hashlib.sha256(b"").hexdigest(), object)
    for j in np.flatnonzero((size[l] == d) | across | up_across):
        i, k = int(l[j]), int(d[j])
        if across[j]:
            key[j] = first_keys[k] if again[j] else last_keys[k]
        if up_across[j]:
            up[j] = first_keys[k - 1] if up_again[j] else last_keys[k - 1]
        if size[i] == k:
            ids = ",".join(map(str, conv[i:last[i]].tolist()))
            if across[j]:
                ends[j] = ids
            else:
                sha[j] = hashlib.sha256(ids.encode()).hexdigest()
    count = r - l + 1
    return pd.DataFrame({
        "conv_id": low.least(l, r), "depth": d, "parent_conv_id": pd.array(parent, dtype="Int64"), "n_convs": count,
        "n_children": children, "n_leaves": leaf_run[r + 1] - leaf_run[l],
        "saved_tokens": saved - (count - 1) * above_node, "ends_sha256": sha, "key": key, "above": up,
        "part": part, "shared": saved, "prefix_words": above_node, "ends": ends})[_PART_COLS]


def trie(lists: DataFrame) -> DataFrame:
    """(conv, turns) -> one row for each node."""
    rows = sorted_rows(lists)
    edges = borders(rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)                               # one range of the sorted rows
        held = [f for f in held if len(f)]
        if held:
            f = pd.concat(held, ignore_index=True)
            part = int(f["part"].iloc[0])
            yield nodes_of_range(part, f["conv"].to_numpy(np.int64), [bytes(p) for p in f["path"]],
                                 f["words"].tolist(), edges[part])

    found = rows.mapInPandas(run, PART).checkpoint()
    parts = found.filter("key is not null")
    merged = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("above"),
        F.first("parent_conv_id", True).alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        (F.sum("shared") - (F.sum("n_convs") - 1) * F.first("prefix_words")).alias("saved_tokens"))
    merged = merged.join(_joined_ends(parts), "key")
    node = [c.split()[0] for c in NODE.split(", ")]
    every = found.filter("key is null").select(*node, "above").unionByName(merged.select(*node, "above"))
    parent = merged.select(F.col("key").alias("above"), F.col("conv_id").alias("parent"))
    below = every.filter("above is not null").join(parent, "above").withColumn("parent_conv_id", F.col("parent"))
    return every.filter("above is null").select(*node).unionByName(below.select(*node))


def _joined_ends(parts: DataFrame) -> DataFrame:
    """key -> ends_sha256 of nodes across borders, their ids streamed in order."""
    rows = (parts.select("key", "part", "ends").repartition("key").sortWithinPartitions("key", "part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, digest, some = None, None, False
        for f in frames:
            done = []
            for k, ends in zip(f["key"], f["ends"]):
                if key is None or bytes(k) != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest, some = bytes(k), hashlib.sha256(), False
                if ends is not None:
                    digest.update((("," if some else "") + ends).encode())
                    some = True
            yield pd.DataFrame(done, columns=["key", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])

    return rows.mapInPandas(run, "key binary, ends_sha256 string")


def oracle_sql(crc: str, base: str, heads: str) -> str:
    """DuckDB SQL: all prefixes as strings, subtrees by joining each node to its ancestors."""
    return f"""
WITH {crc},
r AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {heads} AS h, {base} AS b FROM (SELECT DISTINCT c FROM r), crc),
own AS (SELECT i.c, 0 AS k, r.p, r.role, r.text FROM ids i JOIN r ON r.c = i.b AND r.p <= i.h
        UNION ALL SELECT i.c, 1, r.p, r.role, r.text FROM ids i JOIN r ON r.c = i.c AND r.p > i.h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k, p) AS d,
                 md5(length(role) || ':' || role || text) AS g,
                 len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM own),
paths AS (SELECT c, d, string_agg(g, '') OVER (PARTITION BY c ORDER BY d) AS key, w FROM turns
          UNION ALL SELECT c, 0, '', 0 FROM ids),
long AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
node AS (SELECT key, any_value(p.d) AS d, min(p.c) AS conv_id, count(*) AS n, any_value(w) AS w,
                coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE p.d = long.n), '') AS ends
         FROM paths p JOIN long USING (c) GROUP BY key),
child AS (SELECT left(key, len(key) - 32) AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
sub AS (SELECT p.key, sum((b.n - 1) * b.w) AS saved, count(*) FILTER (WHERE child.key IS NULL) AS leaves
        FROM node b LEFT JOIN child USING (key) JOIN paths p ON p.c = b.conv_id AND p.d <= b.d GROUP BY p.key)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs,
       coalesce(child.n, 0) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
       sha256(node.ends) AS ends_sha256
FROM node JOIN sub USING (key) LEFT JOIN child USING (key)
LEFT JOIN node up ON node.d > 0 AND up.key = left(node.key, len(node.key) - 32)"""

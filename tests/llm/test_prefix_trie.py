"""Prefix trie: nodes against a plain trie, range minima, borders of ranges, edge cases."""
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from roomgrid.llm import catalogue
from roomgrid.llm import prefix_trie as P

COLS = [c.split()[0] for c in P.NODE.split(", ")]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t))


def plain_nodes(convs):
    """{id: [(role, text)]} -> the node rows, by walking down from the root."""
    out = []

    def walk(members, d, parent):
        ends = sorted(c for c in members if len(convs[c]) == d)
        below = {}
        for c in members:
            if len(convs[c]) > d:
                below.setdefault(convs[c][d], []).append(c)
        own = (len(members) - 1) * (words(convs[members[0]][d - 1][1]) if d else 0)
        kids = [walk(v, d + 1, min(members)) for v in below.values()]
        leaves, saved = sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids)
        out.append((min(members), d, parent, len(members), len(below), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if convs:
        walk(sorted(convs), 0, None)
    return sorted(out, key=repr)


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def got(df):
    assert df.columns == COLS
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def ranges(spark):
    """Many small ranges, as a large table has."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_extents_by_sparse_table():
    rng = np.random.default_rng(1)
    for m in (1, 2, 3, 7, 8, 33, 100):
        v = rng.integers(-1, 5, m)
        t = P.RangeMinimum(v)
        for at in range(m):
            for least in range(-1, 6):
                r = l = at
                while r + 1 < m and v[r + 1] >= least:
                    r += 1
                while l >= 1 and v[l] >= least:
                    l -= 1
                a, d = np.array([at]), np.array([least])
                assert (t.left(a, d)[0], t.right(a, d)[0]) == (l, r)
                assert t.least(np.array([l]), np.array([r]))[0] == v[l:r + 1].min()


def make(rng, n):
    """Conversations with much in common: copies of one, extensions, turnless ones."""
    turns = [("user", "a b"), ("assistant", "c"), ("user", "a  b"), ("", "x y z"), ("user", "")]
    convs = {}
    for c in rng.sample(range(3000), n):
        kind = rng.random()
        if kind < 0.35:
            convs[c] = [turns[0], turns[1], turns[0]]
        elif kind < 0.5:
            convs[c] = [turns[0]] * rng.randint(0, 60)
        else:
            convs[c] = [rng.choice(turns) for _ in range(rng.randint(0, 6))]
    return convs


@pytest.mark.parametrize("seed", range(4))
def test_against_a_plain_trie(ranges, seed):
    rng = random.Random(seed)
    convs = make(rng, (1, 9, 60, 300)[seed])
    rows = [(c, [(hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest(), words(t)) for r, t in v]) for c, v in convs.items()]
    df = ranges.createDataFrame(rows, "conv long, turns array<struct<digest:string,words:long>>")
    assert got(P.trie(df)) == plain_nodes(convs)


def test_rows_heads_nulls_and_repeats(ranges):
    rng = random.Random(7)
    rows = [(5, None, None, None), (5, 1, "user", "q"), (5, 1, "user", "q"), (None, 0, "user", "lost"), (0, 2, "user", "b"),
            (0, 1, "system", "s"), (0, None, None, ""), (7, 0, "user", "long " * 50_000), (25, 0, "user", "no base")]
    for c in range(40, 140):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b c"])))
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [v[2:] for v in sorted(l, key=lambda v: (*v[:3], hashlib.md5(f"{len(v[2])}:{v[2]}{v[3]}".encode()).hexdigest()))]
             for c, l in convs.items()}
    df = ranges.createDataFrame([(*r, 1, 2, "x", "y") for r in rows],
                                "conv_id long, turn long, role string, text string, conv int, _of int, turns string, part string")
    conv = F.col("conv")
    lists = P.with_heads(P.turn_lists(df), conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3)
    assert got(P.trie(lists)) == plain_nodes(rebuilt(convs))


def test_no_rows_and_only_turnless(ranges):
    empty = ranges.createDataFrame([], "conv long, turns array<struct<digest:string,words:long>>")
    assert got(P.trie(empty)) == []
    df = ranges.createDataFrame([(k, []) for k in (30, 4, 200)], "conv long, turns array<struct<digest:string,words:long>>")
    assert got(P.trie(df)) == plain_nodes({4: [], 30: [], 200: []})


def test_query_against_sql(ranges, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.execute(catalogue.ORACLES["op13_prefix_trie"]).fetchall(), key=repr)
    assert got(catalogue.QUERIES["op13_prefix_trie"](ranges, sf)) == want

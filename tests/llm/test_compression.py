"""Compression bands and the simple counts against plain Python."""
import base64
import random
import re

import pyarrow as pa
import zstandard

from roomgrid.llm import compression as C

RX = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = RX.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if RX.search(line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i:i + 3]), []).append(i)
    rep = {i + k for v in where.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)


def texts():
    r = random.Random(3)
    bits = ["a", "bé", "c|d", "##", "\n", " ", "\t", "\x0b", "\x1c", " ", "日本", "\U0001F600", "x\n", "a b c\n", "a b c\n"]
    return [None, "", " ", "\n\n", "a", "a b c a b c", "x " * 20_000] + [
        "".join(r.choice(bits) + r.choice(["", " "]) for _ in range(r.randint(0, 60))) for _ in range(400)]


def test_counts_match_brute_force():
    got = C.measure_texts(pa.array(texts())).to_pylist()
    for t, g in zip(texts(), got):
        assert tuple(g.values())[:5] == brute(t), t


def test_bands():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeiorstln") for _ in range(r.randint(2, 9))) for _ in range(1500)]
    prose = " ".join(r.choice(words[:60] + words) for _ in range(3000))
    noise = base64.b64encode(r.randbytes(9000)).decode()
    cases = {prose: True, prose[:700]: True, "the same line again\n" * 300: False, noise: False,
             prose[:9000] + noise: False, "short": True, "": True}
    got = C.measure_texts(pa.array(list(cases))).to_pylist()
    assert [g["in_band"] for g in got] == list(cases.values())
    raw = prose.encode()
    assert got[0]["ratio"] == len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw))


def test_as_column(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())], "doc_id long, text string, ratio int")
    got = df.select("doc_id", "ratio", C.measure(C.F.col("text")).alias("m")).collect()
    assert [tuple(x["m"])[:5] for x in sorted(got)] == [brute(t) for t in texts()]
    assert df.limit(0).select(C.measure(C.F.col("text"))).count() == 0


def plain_limits(rows):
    """(class: (low, high)) of (ratio, n_bytes, in_band, digest) rows, by the definition."""
    import math
    import statistics
    seen = {(math.floor(4 * math.log2(b)), round(r * 1000), d) for r, b, ok, d in rows if ok and b >= 256}
    of = {}
    for c, v, _ in seen:
        of.setdefault(c, []).append(v)
    mid = {}
    for c, v in of.items():
        if len(v) >= C.MIN_TEXTS:
            low = statistics.median_low(v)
            mid[c] = (low, statistics.median_low([abs(x - low) for x in v]))
    out = {}
    for c in mid:
        near = [mid[k] for k in mid if abs(k - c) <= 2]
        m, s = (statistics.median(x[i] for x in near) for i in (0, 1))
        out[c] = ((m - 3.5 * 1.4826 * s) / 1000, (m + 3.5 * 1.4826 * s) / 1000)
    return out


def measured(spark, rows):
    return spark.createDataFrame([(i, r, b, ok, d) for i, (r, b, ok, d) in enumerate(rows)],
                                 "id long, ratio double, n_bytes long, in_band boolean, digest long")


def corpus(n=1800, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        b = int(2 ** r.uniform(7, 11))
        out.append((1.2 + b.bit_length() / 20 + r.gauss(0, 0.05) + (i % 50 == 0) * 0.6, b, r.random() < 0.97, i))
    return out + out[:40]


def test_limits_match_plain_python(spark):
    rows = corpus()
    got = {x.length_class: (x.low, x.high) for x in C.limits(measured(spark, rows)).collect()}
    want = plain_limits(rows)
    assert len(want) > 5 and got.keys() == want.keys()
    for c in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[c], want[c]))


def test_judge_and_a_hot_group(spark):
    rows = corpus()
    # near copies of one length: half of all texts, all of one ratio that prose may have
    hot = rows + [(1.7, 600, True, 10_000 + i) for i in range(len(rows))]
    for case in (rows, hot):
        m = measured(spark, case)
        got = {x.id: x.passes for x in C.judge(m, C.limits(m)).collect()}
        want = plain_limits(case)
        for i, (ratio, b, ok, _) in enumerate(case):
            low, high = want.get(int(C.np.floor(4 * C.np.log2(b))), (0, 9)) if b >= 256 else (0, 9)
            assert got[i] == (ok and low <= ratio <= high)
        prose = [i for i in range(1800) if i % 50 and rows[i][2] and rows[i][1] >= 256]
        odd = [i for i in range(0, 1800, 50) if rows[i][2] and rows[i][1] >= 256]
        assert sum(got[i] for i in prose) >= 0.97 * len(prose) and not any(got[i] for i in odd)
    few = measured(spark, rows[:30])
    assert C.limits(few).count() == 0 and {x.id: x.passes for x in C.judge(few, C.limits(few)).collect()} == \
        {i: x[2] for i, x in enumerate(rows[:30])}
    none = few.limit(0)
    assert C.judge(none, C.limits(none)).count() == 0


def test_query_rejects_by_the_method_alone(spark):
    import __spark_entry__ as E
    got = E.queries()["op10_compression"](spark, "/root/testdata/sf0.01").cache()
    alone = got.filter("NOT base_failed AND NOT kept")
    assert 0 < alone.count() < 0.1 * got.count() and got.filter("base_failed AND kept").count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got.count() == docs.count() and got.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    got.unpersist()

"""The pipeline's stages against brute force on a small table folder."""
import random
from collections import Counter

import pytest

import corpus_pipeline as P
from roomgrid.llm import mixing, secrets
from tests.llm.test_mixing import RX, targets
from tests.llm.test_neardup import brute
from tests.llm.test_packing import check_packing
from tests.llm.test_secrets import h


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    vocab = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 5 == 0
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        t = " ".join(x + "$$$" if bad else x for x in w)
        if i % 7 == 1:
            t += f" password={h(i, 18)} end"
        rows.append((i, t, "en", f"src{i % 3}", len(t)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    for i in range(240, 300):     # near copies of clean rows
        j = r.choice([k for k in range(240) if k % 5])
        w = rows[j][1].split(" ")
        if r.random() < 0.5:
            w[r.randrange(len(w))] = "changed"
        t = " ".join(w)
        rows.append((i, t, "en", rows[j][3], len(t)))
    rows += [(300, None, None, None, None), (301, "", "en", "src1", 0), (None, rows[1][1], "en", "src0", 5), rows[2], rows[2]]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols = docs.columns
    kept = P.STAGES[0][1](spark, docs, d).checkpoint()
    assert kept.columns == cols
    a = [tuple(x) for x in kept.collect()]
    clean = [x for x in rows if x[1] and "$$$" not in x[1]]
    assert sum(x in a for x in clean) >= 0.99 * len(clean)
    assert not [x for x in a if x[1] and "$$$" in x[1]]

    once = P.STAGES[1][1](spark, kept, d).checkpoint()
    assert once.columns == cols
    b = [tuple(x) for x in once.collect()]
    classes = brute(sorted({(x[0], x[1]) for x in a if x[0] is not None and x[1] is not None}))
    want = {i for i, c in classes.items() if i == c} | {x[0] for x in a if x[0] is not None and x[1] is None}
    assert Counter(x[0] for x in b if x[0] is not None) == Counter(want)
    assert sum(x[0] is None for x in b) == sum(x[0] is None for x in a)

    masked = P.STAGES[2][1](spark, once, d).checkpoint()
    assert masked.columns == cols
    c = [tuple(x) for x in masked.collect()]
    assert len(c) == len(b)
    by = {x[0]: x for x in c}
    for x in b:
        if x[1] and "password=" in x[1]:
            assert secrets.MASK in by[x[0]][1] and "password=" + secrets.MASK in by[x[0]][1]
        else:
            assert by[x[0]] == x

    mixed = P.STAGES[3][1](spark, masked, d).checkpoint()
    assert mixed.columns == cols
    m = [tuple(x) for x in mixed.collect()]
    sizes, taken = Counter(), Counter()
    for x in c:
        sizes[x[3]] += len(RX.findall(x[1] or ""))
    for x in m:
        taken[x[3]] += len(RX.findall(x[1]))
    for s, t in targets(dict(sizes)).items():
        assert abs(taken[s] - t) <= mixing.BLOCK * 2 + 0.02 * t

    packed = P.STAGES[4][1](spark, mixed, d).collect()
    check_packing(packed, [(x[0], x[1]) for x in m], 1024)


def test_run_and_empty(spark, folder, tmp_path):
    d, _ = folder
    out = P.run(spark, d)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    assert out.count() > 100
    e = str(tmp_path)
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{e}/{t}.parquet")
    assert P.run(spark, e).count() == 0

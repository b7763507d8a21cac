"""Near-duplicate classes against brute force over all pairs of texts."""
import random
import re

from roomgrid.llm import neardup as N

RX = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = RX.findall(t)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows, threshold=0.8):
    """id -> class over rows (id, text) with non-null fields."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [(i, shingle_set(t)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            same = (not x and not y) or (x and y and len(x & y) / len(x | y) >= threshold - 1e-12)
            if same:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(400)]
    rows, i = [], 0
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        for _ in range(r.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(r.randint(0, max(0, len(w) // 30))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((i, r.choice([" ", "\n", "  "]).join(w)))
            i += 1
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = dict(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_rest_finds_links_that_the_centre_misses(spark):
    """Chains: neighbours are similar, the ends are not; with few bands most links
    share a bucket whose centre is similar to one end only."""
    r = random.Random(5)
    w = [f"x{k}" for k in range(300)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(w)))
        for _ in range(3):
            w[r.randrange(300)] = f"y{r.randrange(10**6)}"
    got = dict(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_shared_passages_that_repeat_differently(spark):
    """Set similarity over 0.8, half of the shared passage 50 times in one text only."""
    r = random.Random(8)
    rows = []
    for g in range(80):
        w = [f"g{g}w{k}" for k in range(200)]
        own = [[f"g{g}{x}{k}" for k in range(r.randint(15, 22))] for x in "ab"]
        rows += [(2 * g, " ".join(w + own[0])), (2 * g + 1, " ".join(w[:100] * 50 + w[100:] + own[1]))]
    want = brute(rows)
    assert len(set(want.values())) < 100
    got = dict(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want


def test_edge_cases(spark):
    rows = [(5, None), (6, None), (None, "a b c"), (None, None), (7, ""), (8, " \n"), (9, "a"), (10, "a"),
            (11, "a b c"), (11, "a b c"), (12, "a  b\tc"), (13, "long " * 30_000), (14, "long " * 30_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as id", "3 as a")
    got = sorted(map(tuple, N.near_duplicates(df).collect()), key=repr)
    want = [(5, 5), (6, 6), (7, 7), (8, 7), (9, 9), (10, 9), (11, 11), (11, 11), (12, 11), (13, 13), (14, 13),
            (None, None), (None, None)]
    assert got == sorted(want, key=repr)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    import pyarrow as pa

    from roomgrid.llm import words as W
    a = [f"t{k}" for k in range(500)]
    b = a[:400] + [f"u{k}" for k in range(100)]
    w = W.Words(pa.array([" ".join(a), " ".join(b)], pa.large_string()))
    s = N.signatures(w, 2048)
    x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_join_parts_tile_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE_CHARS", 300)
    rows = corpus(9)
    got = dict(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), m=16, bands=16).collect())
    assert got == brute(rows)


def test_rows_that_share_an_id(spark):
    """Two texts of one id: none is lost, and neither is a copy of either."""
    r = random.Random(17)
    a, b, c = (" ".join(r.choice("abcdefghij") * 3 + str(r.randrange(50)) for _ in range(60)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "y"), (9, b.replace(" ", "  "), "z"), (1, b, "w"), (2, c, "v"), (2, c + " more", "u"), (None, a, "n"),
            (3, None, "t"), (3, None, "t"), (None, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string").selectExpr("*", "rep as low", "rep as row", "rep as t", "rep as `_d`")
    out = N.first_of_each(df)
    assert out.columns == df.columns
    kept = sorted((x["doc_id"], x["text"]) for x in out.collect() if x["doc_id"] is not None and x["text"] is not None)
    assert kept in ([(1, a), (1, b), (2, c)], [(1, a), (1, b), (2, c + " more")], sorted([(1, a), (1, b), (2, c)]),
                    sorted([(1, a), (1, b), (2, c + " more")]))
    rest = [tuple(x)[:3] for x in out.collect() if x["doc_id"] is None or x["text"] is None]
    assert sorted(rest, key=repr) == sorted([(None, a, "n"), (3, None, "t"), (3, None, "t"), (None, None, "s")], key=repr)
    classes = [tuple(x) for x in N.near_duplicates(df).collect()]
    assert len(classes) == len(rows) and (9, 1) in classes


def test_components_take_few_tasks(spark):
    from roomgrid.llm.components import connected_components
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(60, 140)] + [(5, None), (3, 3)], "u long, v long")
    sc = spark.sparkContext
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sc.setJobGroup("few-tasks", "components")
        got = {(x.node, x.component) for x in connected_components(links).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == {(i, 1) for i in range(1, 41)} | {(i, 60) for i in range(60, 140)}
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert 0 < tasks < 600      # 715 with a union of both directions


def test_no_step_plans_many_exchanges_at_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i % 7 * 50:i % 7 * 50 + 50] + ["x"] * (i % 3)), "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame, seen = type(df), []
    before = frame.checkpoint

    def checkpoint(self, *a, **k):
        seen.append(self._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return before(self, *a, **k)

    monkeypatch.setattr(frame, "checkpoint", checkpoint)
    got = dict(N.near_duplicates(df).collect())
    assert [got[i] for i in range(60)] == [i % 7 for i in range(60)]
    assert 0 < max(seen) <= 10, seen

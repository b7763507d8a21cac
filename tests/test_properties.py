"""Property tests against brute force on small random fixtures."""
import numpy as np
from hypothesis import given, settings, strategies as st

from roomgrid.operators import search as S


@settings(max_examples=8, deadline=None)
@given(seed=st.integers(0, 10_000), k=st.integers(1, 4), t=st.sampled_from([-0.5, 0.0, 0.3]))
def test_knn_equals_brute_force(spark, seed, k, t):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(30, 5)).round(2)
    q = rng.normal(size=(4, 5)).round(2)
    emb = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)],
                                "id long, embedding array<float>")
    qs = spark.createDataFrame([(100 + j, [float(x) for x in v]) for j, v in enumerate(q)],
                               "query_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.id) for r in S.knn(emb, qs, t, k, block_bytes=7 * 5 * 8).collect())
    ef, qf = e.astype(np.float32).astype(np.float64), q.astype(np.float32).astype(np.float64)
    want = []
    for j, qv in enumerate(qf):
        sims = ef @ qv / (np.linalg.norm(ef, axis=1) * np.linalg.norm(qv))
        cand = [(round(float(s), 6), i) for i, s in enumerate(sims) if s > t]
        cand.sort(key=lambda x: (-x[0], x[1]))
        want += [(100 + j, r + 1, i) for r, (_, i) in enumerate(cand[:k])]
    assert got == sorted(want)


@settings(max_examples=6, deadline=None)
@given(seed=st.integers(0, 10_000), mx=st.integers(1, 3), chunk=st.sampled_from([5, 30, 10**6]))
def test_limiter_equals_counter_with_ttl(spark, seed, mx, chunk):
    """Brute force: a counter per user that every request increments and re-arms for
    `gap` seconds; allowed while the counter is <= max."""
    import datetime as dt
    from roomgrid.operators import ratelimit as RL
    rng = np.random.default_rng(seed)
    rows, t = [], {u: 0.0 for u in range(3)}
    for i in range(120):
        u = int(rng.integers(0, 3))
        t[u] += float(rng.choice([0.5, 2.0, 9.999, 10.0, 25.0]))
        rows.append((i, u, t[u]))
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, u, base + dt.timedelta(seconds=s)) for i, u, s in rows],
                               "event_id long, user_id long, ts timestamp")
    got = {r.event_id: r.allowed for r in RL.sessions(df, 10, mx, chunk_seconds=chunk).collect()}
    state = {}
    for i, u, s in sorted(rows, key=lambda r: (r[2], r[0])):
        n, expires = state.get(u, (0, -1.0))
        n = 1 if s >= expires else n + 1
        state[u] = (n, s + 10)
        assert got[i] == (n <= mx)

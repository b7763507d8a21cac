"""SimHash: fingerprints, bit-sliced comparison, links and components against brute force."""
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from roomgrid.llm import catalogue
from roomgrid.llm import simhash as S
from roomgrid.llm import words as W


def plain_print(text):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """[(id, text)] -> sorted rows (id, fingerprint, component)."""
    prints = [plain_print(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                top[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, f"{prints[i]:016x}", low.get(find(i))) for i, (k, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def near(base, rng, bits):
    for b in rng.choice(64, bits, replace=False):
        base = base ^ (np.uint64(1) << np.uint64(b))
    return base


def test_fingerprints_of_many_texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "A b", "a b", "É a B", "x\x0by z " * 400, "abc", "def", "q r s t"]
    texts += [" ".join(rng.choice(["a", "Bc", "dé", "\t", "e\x0bf"]) for _ in range(rng.randint(0, 900))) for _ in range(40)]
    assert S.fingerprints(W.as_large_strings(pa.array(texts))).tolist() == [plain_print(t) for t in texts]
    assert len(S.fingerprints(W.as_large_strings(pa.array([], pa.string())))) == 0


def test_hashing_in_pieces(monkeypatch):
    text = W.as_large_strings(pa.array(["a b c d " * 100, "", "x y", "k l m n o p"]))
    want = S.fingerprints(text).tolist()
    monkeypatch.setattr(S, "HASHES", 7)
    assert S.fingerprints(text).tolist() == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    f = np.unique(np.concatenate([base, [near(x, rng, k) for x in base[:200] for k in (1, 2, 3, 4, 5, 6)]]).astype(np.uint64))
    bits = np.unpackbits(S.neighbours(f, radius).astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :len(f)]
    want = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    np.fill_diagonal(want, False)
    assert (bits.astype(bool) == want).all()


def test_links_connect_all_and_only_near(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    chain = [base[0]]
    for _ in range(60):
        chain.append(near(chain[-1], rng, 3))
    # one over-full bucket: all agree but for the twelve lowest bits
    hot = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64)) | np.uint64(0xABCD << 40)
    f = np.unique(np.concatenate([base, chain, hot, [near(x, rng, 3) for x in base]]).astype(np.uint64))
    close = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3
    comp = np.arange(len(f))
    while True:
        new = np.array([comp[row].min() for row in close])
        if (new == comp).all():
            break
        comp = new
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    for block in (4096, 40):
        monkeypatch.setattr(S, "BLOCK", block)
        place = {int(x): i for i, x in enumerate(f.view(np.int64))}
        top = list(range(len(f)))

        def find(i):
            while top[i] != i:
                i = top[i]
            return i

        pairs = S.links(df).collect()
        for r in pairs:
            i, j = place[r["u"]], place[r["v"]]
            assert comp[i] == comp[j]
            top[max(find(i), find(j))] = min(find(i), find(j))
        assert [find(i) for i in range(len(f))] == comp.tolist()
        assert len(pairs) < 20 * len(f)


def test_operator_against_brute_force(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)]
    rows = [(None, "only copies"), (7, "only copies"), (3, None), (4, ""), (5, " \n"), (6, "a"), (6, "a"), (None, "no id")]
    for k in range(100, 130):
        t = [rng.choice(pool) for _ in range(rng.randint(1, 300))]
        rows.append((k, " ".join(t)))
        rows.append((k + 1000, "  ".join(t).upper()))
        if len(t) > 100:
            t[rng.randrange(len(t))] = "other"
            rows.append((k + 2000, "\n".join(t)))
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, fp int, low int, node int")
    assert got(S.near_duplicates(df)) == plain_components(rows)
    assert got(S.near_duplicates(df.limit(0))) == []


def test_query_on_the_given_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(catalogue.QUERIES["op12_simhash"](spark, sf)) == plain_components(rows)

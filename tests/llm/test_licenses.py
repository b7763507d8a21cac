"""License scans: planted notices, whole and damaged, with their spans."""
import random
import re

import pyarrow as pa

from roomgrid.llm import licenses as L
from roomgrid.llm import words as W

TOKEN = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def planted():
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abdeénrst") for _ in range(r.randint(2, 8))) for _ in range(n))
    rows, want = [], {}
    for i in range(200):
        name, text = L.TEMPLATES[i % len(L.TEMPLATES)]
        a, b = prose(r.randint(0, 40)), prose(r.randint(0, 40))
        body = text.upper() if i % 4 == 1 else text.replace(" ", "\n * ") if i % 4 == 2 else text
        if i % 4 == 3 and len(text.split()) >= 12:
            w = text.split()
            w[7] = "changed"
            body = " ".join(w[:9] + ["extra"] + w[9:])
        head = a + ("\n" if a else "")
        rows.append((i, head + body + "\n" + b))
        want[i] = (name, len(head), body)
    return rows + [(1000, prose(300)), (1001, None), (1002, ""), (1003, "the license")], want


def test_planted_notices(spark):
    rows, want = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as license")
    got = {}
    text = dict(rows)
    for m in L.scan(df).collect():
        got.setdefault(m["doc_id"], []).append(m)
    assert set(got) == set(want)
    for i, (name, start, body) in want.items():
        best = max(got[i], key=lambda m: m["words"])
        assert best["license"] == name, (i, got[i])
        assert best["start"] == start
        span = text[i][best["start"]:best["start"] + best["length"]]
        assert TOKEN.findall(span)[-1] == TOKEN.findall(body)[-1]
        whole = [t.lower() for t in TOKEN.findall(body)]
        assert best["words"] <= len(whole) and best["coverage"] >= (0.8 if i % 4 == 3 else 1.0)
    assert L.scan(df.limit(0)).count() == 0


def test_names_and_versions_decide(spark):
    want = {
        "Licensed under the BSD License": {"BSD"}, "Licensed under the new BSD License": {"BSD"},
        "Licenced under the MIT License": {"MIT"}, "Licensed under the terms of the MIT License": {"MIT"},
        "Licensed under the Frobnicate License": set(), "Licensed under the very free Frobnicate License": set(),
        "licensed under the GNU General Public License": {"GPL"},
        "licensed under the GNU Library General Public License": set(),
        "licensed under the GNU Lesser General Public License": {"LGPL"},
        "licensed under the GNU Lesser General Public License, version 2.1": {"LGPL-2.1"},
        "licensed under the GNU Affero General Public License": {"AGPL"},
        "licensed under the GNU General Public License, version 2": {"GPL-2.0"},
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License": set(),
        "under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 1 of the License": set(),
        "Licensed under the Mozilla Public License": {"MPL"}, "Licensed under the zlib License": {"zlib"},
        "Licensed under the Apache 2.0 License": {"Apache-2.0"}, "Licensed under the Apache License": {"Apache"},
        "Licensed under CC BY 3.0": {"CC-BY"}, "Licensed under CC BY-SA 3.0": {"CC-BY-SA"},
        "Licensed under CC BY-NC-ND 4.0": {"CC-BY-NC-ND-4.0"}, "Licensed under CC BY 4.0": {"CC-BY-4.0"},
    }
    notices = list(want)
    rows = [(i, f"some prose before\n{t}\nother prose after it") for i, t in enumerate(notices)]
    got = {t: set() for t in notices}
    for m in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[notices[m["doc_id"]]].add(m["license"])
    assert got == want


def naive(template, text):
    """Most equal words over all alignments (longest common subsequence in the region)."""
    m = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i, x in enumerate(template):
        for j, y in enumerate(text):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_alignment_against_full_table():
    import numpy as np
    r = random.Random(7)
    for _ in range(100):
        t = [r.randint(0, 50) for _ in range(r.randint(4, 20))]
        x = list(t)
        if r.random() < 0.5:
            x[r.randrange(len(x))] = 99
        if r.random() < 0.5:
            x.insert(r.randrange(len(x)), 98)
        pre, post = [r.randint(60, 90) for _ in range(r.randint(0, 9))], [r.randint(60, 90) for _ in range(3)]
        equal, a, b = L.align(np.array(t), np.array(pre + x + post), len(pre))
        assert equal == naive(t, x)
        assert a <= len(pre) + 1 and b >= len(pre) + len(x) - 1


def test_fingerprints_cover_shared_passages():
    r = random.Random(1)
    a = [f"w{r.randint(0, 99)}" for _ in range(200)]
    texts = [" ".join(a[i:i + L.GRAM + L.WINDOW - 1]) for i in range(0, 190, 7)]
    whole = set(L.winnow(L.tokenised(W.as_large_strings(pa.array([" ".join(a)]))))[0].tolist())
    for t in texts:
        assert whole & set(L.winnow(L.tokenised(W.as_large_strings(pa.array([t]))))[0].tolist())

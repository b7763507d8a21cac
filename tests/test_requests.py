"""Attribute search for a table of requests against a plain reading of ``ilike``."""
import random
import re

from roomgrid.operators import requests as R


def like(pattern, value):
    out, k = ".*", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return re.fullmatch(out + ".*", value, re.I | re.S) is not None


def plain(listings, asked, limit):
    out = []
    for r, place, most, kind in asked:
        ids = sorted(i for i, a, t, p in listings
                     if (not place or a is not None and like(place, a)) and (not kind or t is not None and like(kind, t))
                     and (most is None or p is not None and p == p and p <= most))
        out += [(r, k + 1, i) for k, i in enumerate(ids[:limit])]
    return sorted(out)


def frames(spark, listings, asked):
    return (spark.createDataFrame(listings, "id long, location string, property_type string, price double"),
            spark.createDataFrame(asked, "request_id long, location string, max_price double, property_type string"))


def test_against_plain_reading(spark):
    rng = random.Random(4)
    places = ["Nairobi West", "nairobi", "Mombasa", "MoMBasa 100%", "a_b", "ab", "", None, "Ümlaut Straße", "x\\y", "Kisumu\nRoad"]
    kinds = ["2BR", "Studio", "bed_sitter", "BED SITTER", None, "1", "one % two"]
    prices = [None, float("nan"), 0.0, -5.0, 99.99, 99.991, 100.0, 1e15, -1e15, *[rng.uniform(0, 5000) for _ in range(30)]]
    listings = [(i, rng.choice(places), rng.choice(kinds), rng.choice(prices)) for i in range(700)]
    patterns = [None, "", "%", "_", "n", "NA", "nai", "robi w", "mo%sa", "m_m", "a_b", "a\\_b", "100\\%", "\\%", "zzz", "ü", "ss", "%%", "__", "i\nr", "\\x"]
    asked = [(k, rng.choice(patterns), rng.choice([None, 0.0, 99.99, 99.9905, 250.5, 3000.0, 1e16, -1e16, -5.0]),
              rng.choice([None, "", "b", "br", "studio", "SIT", "% two", "_", "o%e"])) for k in range(400)]
    lst, req = frames(spark, listings, asked)
    for limit in (100, 7):
        got = sorted(tuple(x) for x in R.search_by_requests(lst, req, limit).collect())
        assert got == plain(listings, asked, limit)


def test_no_rows_and_no_nested_loop(spark):
    lst, req = frames(spark, [(1, "a", "b", 1.0)], [(1, "a", None, None)])
    assert R.search_by_requests(lst.limit(0), req).count() == 0
    assert R.search_by_requests(lst, req.limit(0)).count() == 0
    out = R.search_by_requests(lst, req)
    assert [tuple(x) for x in out.collect()] == [(1, 1, 1)]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

"""Steps that must not grow with pairs, tokens or listings: same results, bounded rows."""
import random

import numpy as np
from pyspark.sql import functions as F

from roomgrid.operators import embed as EM
from roomgrid.operators import language as LANG
from roomgrid.operators import requests as REQ
from roomgrid.operators import search as S
from roomgrid.operators import textmodel as NB


def test_lsh_blocks_hold_the_best_of_every_query(spark):
    r = np.random.default_rng(1)
    e = [(i, [float(x) for x in r.normal(size=8)]) for i in range(300)] + [(None, [1.0] * 8), (900, None), (901, [0.0] * 8)]
    emb = spark.createDataFrame(e + e[:3], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, v) for i, v in e[:20]], "query_id long, embedding array<float>")
    key = lambda rows: sorted((x.query_id, x.rank, x.id, x.similarity) for x in rows.collect())
    exact = key(S.knn(emb, q, 0.1, 4, dim=8))
    assert key(S.lsh_candidates(emb, q, 0.1, 4, 8, tables=40, bits=1, block_bytes=8 * 8 * 50)) == exact
    assert len(S.lsh_candidates(emb.limit(0), q, 0.1, 4, 8).collect()) == 0


def test_listings_that_no_request_can_get_are_dropped_early(spark):
    r = random.Random(2)
    offers = [(i, r.choice(["here", "there", None]), "flat", r.choice([None, float("nan"), *(r.randint(0, 900) / 4 for _ in range(9))]))
              for i in range(6000)]
    requests = [(k, r.choice(["here", "her", "%", None]), r.choice([None, -1.0, r.randint(0, 240) / 1.0]), r.choice(["flat", "", "x"])) for k in range(40)]
    lst = spark.createDataFrame(offers, "id long, location string, property_type string, price double")
    asked = spark.createDataFrame(requests, "request_id long, location string, max_price double, property_type string")
    got = {}
    for x in REQ.search_by_requests(lst, asked, 5).collect():
        got.setdefault(x.request_id, []).append((x.rank, x.id))
    for k, place, price, kind in requests:
        ids = [i for i, a, t, p in offers if (not place or (a and (place == "%" or place in a))) and (not kind or kind in t)
               and (price is None or (p is not None and p <= price))][:5]
        assert [i for _, i in sorted(got.get(k, []))] == ids
    offer = lst.withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    assert REQ.can_be_first(offer, 5).count() < 1000


def test_tokens_are_counted_inside_rows(spark):
    rows = [(1, "a b a"), (1, "b c"), (2, None), (None, "a"), (3, "z z"), (3, "z z")]
    df = spark.createDataFrame(rows, "id long, text string")
    of = {t: spark.range(1).select(EM.bucket_of(F.lit(t))).first()[0] for t in "abcz"}
    got = sorted(((x.id, x.cnt) for x in EM.bucket_counts(df, "id", "text").collect()), key=lambda x: (x[0] or 0, str(x[1])))
    one = {of["a"]: 2, of["b"]: 2, of["c"]: 1}
    assert got == [(None, {}), (1, one), (1, one), (2, {}), (3, {of["z"]: 4}), (3, {of["z"]: 4})]
    top = {x.id: x.top for x in EM.hashed_tf(df, "id", "text").select("id", EM.heaviest(F.col("cnt")).alias("top")).collect()}
    assert top == {None: None, 1: min(of["a"], of["b"]), 2: None, 3: of["z"]}


def test_json_lines_may_be_compressed_in_files_of_some_rows(spark, tmp_path):
    from roomgrid.sources.files import write_jsonl
    write_jsonl(spark.range(10, numPartitions=1), str(tmp_path / "out"), "gzip", 4)
    assert len(list((tmp_path / "out").glob("*.json.gz"))) == 3
    assert spark.read.schema("id long").json(str(tmp_path / "out")).count() == 10


def test_parts_of_a_stream_are_read_by_all_cores(spark, tmp_path):
    from roomgrid.streaming.files import write_in_order
    seen = spark.sparkContext.accumulator(0)
    mark = F.udf(lambda x: (seen.add(1), x)[1], "long").asNondeterministic()
    df = spark.range(100, numPartitions=4).select(F.col("id"), F.spark_partition_id().alias("task"), mark("id").alias("x"))
    folder = write_in_order(df, "id", 2, str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 2
    back = spark.read.parquet(folder)
    assert back.count() == 100 and back.select("task").distinct().count() == 4


def test_language_grams_are_counted_inside_rows(spark, monkeypatch):
    """No row for an occurrence, and the same model and predictions as with such rows."""
    r = random.Random(3)
    text = lambda: r.choice([None, "", "4!", "a", "Ab", "".join(r.choice("abé ßж語.9\n") for _ in range(r.randint(1, 90)))])
    rows = [(r.choice([None, 1, 2, *range(3, 200)]), text(), r.choice(["en", "sw", "de", None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(3)
    letters = NB.letter_text(F.col("text"))
    monkeypatch.setattr(NB, "SLICE_BYTES", 500)
    for n in (1, 3, 5):
        old, new = NB.fit(df, NB.char_grams(letters, n), F.col("lang")), NB.fit_grams(df, letters, n, F.col("lang"))
        assert sorted(map(tuple, new.counts.collect())) == sorted(map(tuple, old.counts.collect()))
        assert (new.classes, new.vocab) == (old.classes, old.vocab)
        key = lambda p: sorted(((x.id, x.label, round(x.score, 6), round(x.posterior, 6)) for x in p.collect()), key=str)
        inside = NB.predict_grams(new, df, "id", letters, n)
        joined = NB.predict(old, df, "id", NB.char_grams(letters, n), NB.n_char_grams(letters, n))
        assert key(inside) == key(joined)
        large = NB.load(spark, new.path)
        large.table = None        # as a model over the limit has it
        assert key(NB.predict_grams(large, df, "id", letters, n)) == key(joined)
    out = LANG.detect(LANG.train_profile(df), df, "id")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    blank = LANG.train_profile(df.limit(0).union(spark.createDataFrame([(1, "4!", "en")], df.schema)))
    assert {x.lang for x in LANG.detect(blank, df.filter("text = 'a'"), "id").collect()} <= {"en"}
    assert {x.lang for x in LANG.detect(LANG.train_profile(df.limit(0)), df.filter("text = 'a'"), "id").collect()} <= {"other"}


def test_grams_are_code_points(spark):
    df = spark.createDataFrame([(1, "x𐐀𐐨y𝒜")], "id long, text string")
    m = LANG.train_profile(df.withColumn("lang", F.lit("en")), n=2)
    assert {x.token for x in m.counts.collect()} == {" x", "x𐐨", "𐐨𐐨", "𐐨y", "y𝒜", "𝒜 "}


def test_keywords_stand_between_spaces(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(["poa", "Sasa", "mat", "x", " ", "\n", "\u3000", "\x1c", ",", "", "bed moja", "Bed moja"]) for _ in range(4)) for _ in range(400)]
    got = [tuple(x) for x in spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
           .select("t", LANG.keyword_stage(F.col("t"))).collect()]
    for t, k in got:
        words = (t or "").lower().split()
        assert k == ("other" if not words else "sheng" if set(words) & set(LANG.SHENG_KEYWORDS) else None), repr(t)

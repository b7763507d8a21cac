"""Unit tests on hand-written rows: one per reference quirk / falsy rule / boundary."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from roomgrid.functions.text import (compose_listing_text, extract_listing_id,
                                     normalize_user_key, tail_after)
from roomgrid.operators import dialogue as DLG
from roomgrid.operators import integrity as I
from roomgrid.operators import language as LANG
from roomgrid.operators import load as LD
from roomgrid.operators import ratelimit as RL
from roomgrid.operators import search as S
from roomgrid.operators.rerank import filter_listings, rerank_score


def test_user_key_normalisation(spark):
    rows = [(" whatsapp:+254700 ",), ("+254700",), ("whatsapp:whatsapp:254700",), ("",), (None,)]
    out = spark.createDataFrame(rows, "r string").select(normalize_user_key(F.col("r")).alias("k"))
    assert [r.k for r in out.collect()] == ["whatsapp:254700"] * 3 + ["anon", "anon"]


def test_route_order_and_substring_rule(spark):
    rows = [("I need a current flat", "fallback"),      # 'rent' inside 'current' -> search
            ("save 1234abcd", "search_listings"),      # search label wins over save prefix
            ("save 1234abcd", "fallback"),
            ("please book viewing", "fallback"),
            ("Inquire about it", "greeting"),
            ("hello", "greeting"),
            ("   \n", "greeting"),
            ("anything", "fallback")]
    df = spark.createDataFrame(rows, "text string, intent string")
    got = [r.r for r in df.select(DLG.route(F.col("text"), F.col("intent")).alias("r")).collect()]
    assert got == ["search", "search", "save", "inquiry", "inquiry", "greeting", "blank", "fallback"]
    wb = df.select(DLG.route(F.col("text"), F.col("intent"), word_boundary=True).alias("r")).first().r
    assert wb == "fallback"


def test_id_extraction_and_inquiry_tail(spark):
    df = spark.createDataFrame([("inquire 5e3f-0a1b2c is it free?",), ("save 1234",),
                                ("inquire 0000abcd",)], "t string")
    df = DLG.parse_commands(df, "t")
    got = [(r.listing_ref, r.inquiry_message) for r in df.collect()]
    assert got[0] == ("5e3f-0a1b2c", "is it free?")
    assert got[1] == (None, None)
    assert got[2] == ("0000abcd", DLG.DEFAULT_INQUIRY)
    strict = DLG.parse_commands(spark.createDataFrame([("inquire 0000abcd",)], "t string"), "t",
                                strict_tail=True).first()
    assert strict.inquiry_message == ""


def test_label_normalisation_strict_and_default(spark):
    rows = [("search_listings.",), ("greeting!",), ("banana",), ("",), ("save_listing now",)]
    df = spark.createDataFrame(rows, "raw string")
    lab, conf = DLG.normalize_label(F.col("raw"))
    slab, _ = DLG.normalize_label(F.col("raw"), strict=True)
    got = [(r.l, r.c, r.s) for r in df.select(lab.alias("l"), conf.alias("c"), slab.alias("s")).collect()]
    assert got == [("search_listings", 0.9, "fallback"), ("greeting", 0.9, "greeting"),
                   ("fallback", 0.5, "fallback"), ("fallback", 0.0, "fallback"),
                   ("save_listing", 0.9, "fallback")]


def test_keyword_language_stage(spark):
    rows = [("",), ("niko area", ), ("sasa, bro",), ("bed moja please",), ("hello there",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.k for r in df.select(LANG.keyword_stage(F.col("t")).alias("k")).collect()]
    assert got == ["other", "sheng", None, None, None]   # punctuation sticks; 'Bed moja' never
    sp = [r.k for r in df.select(LANG.keyword_stage(F.col("t"), strip_punct=True).alias("k")).collect()]
    assert sp[2] == "sheng"


def test_critique_phrases(spark):
    df = spark.createDataFrame([("SORRY, none",), ("All good",), (None,)], "r string")
    ok, dec, _ = DLG.critique(F.col("r"))
    assert [(x.o, x.d) for x in df.select(ok.alias("o"), dec.alias("d")).collect()] == \
        [(False, "revise"), (True, "stop"), (True, "stop")]


def test_compose_text_falsy_fields(spark):
    df = spark.createDataFrame(
        [("T", "", None, "studio", None, None, None, [], 0.0, 12.0),
         ("A", "d", "loc", None, "Furnished", "water", None, ["wifi", "gym"], 12000.0, None)],
        "title string, description string, location string, property_type string, furnishing string,"
        " utilities string, renovations string, amenities array<string>, price double, size_sqm double")
    got = [r.t for r in df.select(compose_listing_text().alias("t")).collect()]
    assert got == ["T | studio | Size: 12.0 sqm",
                   "A | d | loc | Furnished | water | Amenities: wifi, gym | Price: 12000.0"]


def test_rerank_score_rules(spark):
    df = spark.createDataFrame(
        [(0.5, "Studio Apartment", 1000.0, "Unfurnished", 4.0),
         (None, None, 0.0, None, None),
         (0.5, "studio", 2000.0, "furnished", 0.0)],
        "similarity double, property_type string, price double, furnishing string, rating double")
    sc = rerank_score(F.col("similarity"), F.col("property_type"), F.col("price"), F.col("furnishing"),
                      F.col("rating"), p_type="studio", p_max_price=1500, p_furnishing="furnished")
    got = [round(r.s, 9) for r in df.select(sc.alias("s")).collect()]
    boost = max(0, 0.2 - 500 / 1501 * 0.2)
    assert got[0] == round(0.5 + 0.2 + boost + 0.1 + 0.4, 9)   # 'Unfurnished' matches too
    assert got[1] == 0.0
    assert got[2] == round(0.5 + 0.2 + boost + 0.1, 9)         # symmetric price boost


def test_attribute_search_optional_conjuncts(spark):
    df = spark.createDataFrame([(1, "Kilimani", 900.0, "studio"), (2, "K_limani", 0.0, "bedsitter"),
                                (3, "Westlands", 100.0, None)],
                               "id long, location string, price double, property_type string")
    assert filter_listings(df).count() == 3
    assert [r.id for r in filter_listings(df, location="K_l").collect()] == [1, 2]   # '_' wildcard
    assert [r.id for r in filter_listings(df, location="K_l", escape=True).collect()] == [2]
    assert [r.id for r in filter_listings(df, max_price=0).collect()] == [2]          # 0 filters


def _vec_df(spark, rows, idc):
    return spark.createDataFrame(rows, f"{idc} long, embedding array<float>")


def test_knn_threshold_strict_zero_vector_and_blocks(spark):
    emb = _vec_df(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]),
                          (5, [1.0, 0.0])], "id")
    q = _vec_df(spark, [(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, [-1.0, 0.0])], "query_id")
    a = S.knn(emb, q, threshold=0.7071067811865476, k=5)
    b = S.knn(emb, q, threshold=0.7071067811865476, k=5, block_bytes=32)
    ra = sorted((r.query_id, r.rank, r.id, r.similarity) for r in a.collect())
    rb = sorted((r.query_id, r.rank, r.id, r.similarity) for r in b.collect())
    assert ra == rb
    # ties broken by id; the 45-degree vector sits at the threshold (strict >) or just
    # above it through rounding -- either way the zero vector never matches
    assert [x[2] for x in ra if x[0] == 10][:2] == [1, 5]
    assert all(x[0] == 10 for x in ra)


def test_knn_string_ids_bad_vectors_and_many_ties(spark):
    rows = [(f"k{i:05d}", [1.0, 2.0]) for i in range(10_000)]
    rows += [("null", None), ("short", [1.0]), ("hole", [1.0, None]), ("nan", [float("nan"), 1.0]), (None, [1.0, 2.0])]
    emb = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = spark.createDataFrame([("q1", [1.0, 2.0]), ("q2", [2.0]), ("q3", None)], "query_id string, embedding array<float>")
    for size in (1 << 24, 10_000):
        got = S.knn(emb, q, 0.5, 5, dim=2, block_bytes=size).orderBy("rank").collect()
        assert [(r.query_id, r.id) for r in got] == [("q1", f"k{i:05d}") for i in range(5)]
    bad = S.vector_rejects(emb.withColumnRenamed("id", "listing_id"), 2).collect()
    assert {r.listing_id: r.reject_reason for r in bad} == {
        "null": "missing vector", "short": "wrong dimension", "hole": "bad component", "nan": "bad component"}


def test_knn_native_single_equals_kernel(spark):
    emb = _vec_df(spark, [(i, [float(i % 3), float(i % 5) + 0.5, 1.0]) for i in range(40)], "id")
    q = [0.3, 0.9, 0.1]
    nat = S.knn_single_native(emb, q, 0.1, 7).collect()
    ker = S.knn(emb, _vec_df(spark, [(0, q)], "query_id"), 0.1, 7).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in nat] == [(r.id, r.similarity) for r in ker]


def _events(spark, secs):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 1, base + dt.timedelta(seconds=s)) for i, s in enumerate(secs)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def test_limiter_boundary_and_denied_extend(spark):
    ev = _events(spark, [0, 1, 2, 3, 18.0, 18.0 + 14.999, 18.0 + 14.999 + 15.0, 100])
    out = RL.sessions(ev, 15, 2).orderBy("event_id").collect()
    assert [r.session_no for r in out] == [1, 1, 1, 1, 2, 2, 3, 4]
    assert [r.allowed for r in out] == [True, True, False, False, True, True, True, True]


def test_limiter_chunked_equals_unchunked(spark):
    import random
    rnd = random.Random(3)
    secs, t = [], 0.0
    for _ in range(300):
        t += rnd.choice([0.5, 3, 10, 14.999, 15, 40, 400])
        secs.append(t)
    ev = _events(spark, secs)
    a = [(r.event_id, r.session_no, r.ordinal) for r in RL.sessions(ev, 15, 3, chunk_seconds=20).collect()]
    b = [(r.event_id, r.session_no, r.ordinal) for r in RL.sessions(ev, 15, 3, chunk_seconds=10**9).collect()]
    assert sorted(a) == sorted(b)


def test_get_or_create_is_idempotent(spark):
    existing = spark.createDataFrame([("1", "+1", "old", "a@x")], "id string, contact_number string, name string, email string")
    inc = spark.createDataFrame([(2, "+1", "new", "b@x"), (1, "+2", "n2", "first"), (5, "+2", "n3", "late")],
                                "pos long, contact_number string, name string, email string")
    once = LD.get_or_create(existing, inc, "contact_number", "pos", "l-", ["name", "email"])
    rows = {r.contact_number: r for r in once.collect()}
    assert rows["+1"].name == "old" and not rows["+1"].is_new
    assert rows["+2"].email == "first" and rows["+2"].is_new
    twice = LD.get_or_create(once.drop("is_new"), inc, "contact_number", "pos", "l-", ["name", "email"])
    assert twice.filter("is_new").count() == 0 and twice.count() == 2


def test_upsert_latest_keeps_keys_unique(spark):
    ex = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    inc = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, arr long")
    out = {r.k: r.v for r in LD.upsert_latest(ex, inc, "k", "arr").collect()}
    assert out == {1: "a", 2: "y", 3: "z"}


def test_labelled_csv_drops_malformed(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text('text,intent\n"find a room, cheap",search_listings\nonly_one_field\n'
                 'a,b,c\nhi,greeting\n', encoding="utf-8")
    df = LD.read_labelled_text(spark, str(p))
    assert sorted((r.text, r.intent) for r in df.collect()) == [
        ("find a room, cheap", "search_listings"), ("hi", "greeting")]


def test_nested_json_load_and_admission(spark, tmp_path):
    recs = [{"landlord": {"name": "L", "contact_number": "+1"}, "complex": None,
             "listing": {"title": "Room", "price": 9000.0, "amenities": ["wifi"]}},
            {"landlord": None, "complex": {"name": "C"}, "listing": {"title": "X"}}]
    p = tmp_path / "listings.json"
    p.write_text(json.dumps(recs))
    df = LD.read_nested_records(spark, str(p))
    adm = LD.admission(df).select("admitted", "reject_reason").collect()
    assert [(r.admitted, r.reject_reason) for r in adm] == [(True, None), (False, "missing landlord")]
    ll, cx, li = LD.split_nested(df)
    assert ll.filter(F.col("name").isNotNull()).count() == 1 and cx.count() == 1 and li.count() == 2


def test_row_policies():
    assert I.policy_allows("listings", "DELETE")
    assert not I.policy_allows("users", "INSERT")
    assert not I.policy_allows("listings_embeddings", "SELECT")


def test_delete_follows_the_foreign_keys(spark):
    tables = {"p": spark.createDataFrame([(1,), (2,)], "id long"),
              "c": spark.createDataFrame([(10, 1, None), (11, 2, 10), (12, None, 11), (13, 2, 11)], "id long, pid long, nid long"),
              "d": spark.createDataFrame([(20, 10), (21, 11)], "id long, cid long")}
    keys = dict.fromkeys(tables, "id")
    fks = [("c", "pid", "p", "cascade"), ("d", "cid", "c", "cascade")]
    left = I.delete(tables, keys, fks, {"p": tables["p"].filter("id = 1").selectExpr("id as key")})
    assert {t: sorted(r.id for r in df.collect()) for t, df in left.items()} == {"p": [2], "c": [11, 12, 13], "d": [21]}
    left = I.delete({k: tables[k] for k in "pc"}, keys, [("c", "pid", "p", "set_null")],
                    {"p": tables["p"].filter("id = 1").selectExpr("id as key")})
    assert {r.id: r.pid for r in left["c"].collect()} == {10: None, 11: 2, 12: None, 13: 2}
    out = I.orphans({"p": tables["p"].filter("id = 2"), "c": tables["c"]}, keys, [("c", "pid", "p", "cascade")]).collect()
    assert [tuple(r) for r in out] == [("c", "pid", "10")]


def test_json_bodies_quarantine_and_jsonl_sink(spark, tmp_path):
    from roomgrid.sources.files import parse_message_bodies, write_jsonl
    raw = spark.createDataFrame([('{"message": "habari, niko Kasarani"}',), ('{"msg": 1}',), ("not json",)],
                                "body string")
    good, bad = parse_message_bodies(raw)
    assert [r.text for r in good.collect()] == ["habari, niko Kasarani"]
    assert bad.count() == 2
    out = str(tmp_path / "traces")
    write_jsonl(good.select("text"), out)
    write_jsonl(good.select("text"), out)
    back = spark.read.schema("text string").json(out)
    assert [r.text for r in back.collect()] == ["habari, niko Kasarani"] * 2


def test_numbers_and_whitespace_as_python(spark):
    from roomgrid.functions.text import blank, num_str, strip_ws
    values = [0.0, 900.0, 15000000.0, 1.5e7 + 0.25, 123456789012.5, 9.99e15, 1e16, 1.5e300, 0.001, 0.00012, 1.25e-5, -2e8, 0.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.s for r in df.select(num_str(F.col("v")).alias("s")).collect()] == [str(v) for v in values]
    texts = ["\t+254700\n", "\u00a0 \u2003", "\x1c a\u3000", "", " x y "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(strip_ws(F.col("t")).alias("s"), blank(F.col("t")).alias("b"), normalize_user_key(F.col("t")).alias("k")).collect()
    assert [r.s for r in got] == [t.strip() for t in texts]
    assert [r.b for r in got] == [not t.strip() for t in texts]
    assert [got[0].k, got[1].k] == ["whatsapp:254700", "anon"]


def test_keys_beyond_eight_digits_stay_whole(spark):
    from roomgrid.sources import views as V
    df = spark.createDataFrame([(5,), (123_456_789,), (12_345_678_901,)], "k long")
    assert [r.p for r in df.select(V.pad8(F.col("k")).alias("p")).collect()] == ["00000005", "123456789", "12345678901"]
    cv = spark.createDataFrame([(1_234_567_890, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    m = V.messages_from(cv, 10 ** 12).select("from_raw").collect()
    assert "1234567890" in m[0].from_raw


def test_language_of_featureless_and_short_texts(spark):
    train = spark.createDataFrame([("the house and the room", "en"), ("la casa y la sala", "es"), ("la casa", "es")],
                                  "text string, lang string")
    model = LANG.train_profile(train)
    df = spark.createDataFrame([(1, "12"), (2, "99 !!"), (3, ""), (4, "la"), (5, "the"), (6, None), (7, "niko")], "id long, text string")
    got = {r.id: r.lang for r in LANG.detect(model, df, "id").collect()}
    assert got == {1: "other", 2: "other", 3: "other", 4: "es", 5: "en", 6: "other", 7: "sheng"}


def test_text_model_save_and_load(spark, tmp_path):
    from roomgrid.operators import textmodel as NB
    rows = [("save this room", "save"), ("hello there", "greet"), ("hello", "greet")]
    df = spark.createDataFrame(rows, "text string, intent string")
    model = NB.fit(df, NB.word_tokens(F.col("text")), F.col("intent"), str(tmp_path / "m"))
    again = NB.load(spark, str(tmp_path / "m"))
    ask = spark.createDataFrame([(1, "save this please"), (2, "hello you"), (3, "")], "id long, text string")
    a, b = (sorted(map(tuple, NB.predict(m, ask, "id", NB.word_tokens(F.col("text"))).collect())) for m in (model, again))
    assert a == b
    assert [x[1] for x in a] == ["save", "greet", "greet"]
    assert 0.5 < a[0][3] < 1


def test_lookup_keeps_every_row_once(spark):
    table = spark.createDataFrame([("2", "a"), ("1", "a"), ("3", "b"), ("4", None)], "id string, name string")
    assert sorted(map(tuple, LD.first_per_key(table, "name", ["id"]).collect())) == [("a", "1"), ("b", "3")]


def test_conform_rejects_types_and_nulls(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType()),
                           T.StructField("title", T.StringType()), T.StructField("ok", T.BooleanType())])
    df = spark.createDataFrame([("a", "1", "t"), ("b", "x", "t"), ("c", None, None), ("d", "y", None)], "id string, n string, title string")
    good, bad = LD.conform(df, schema, {"ok": F.lit(True)}, ["title"])
    assert [tuple(r) for r in good.collect()] == [("a", 1, "t", True)]
    assert {r.id: r.reject_reason for r in bad.collect()} == {"b": "type:n", "c": "null:title", "d": "type:n,null:title"}


def test_ingest_keeps_the_store(spark):
    import hashlib

    from roomgrid.operators import embed as EM
    cols = ("id long, title string, description string, location string, property_type string, furnishing string,"
            " utilities string, renovations string, amenities array<string>, price double, size_sqm double, landlord_id long")
    row = lambda i, t, ll=1: (i, t, None, None, None, None, None, None, None, None, None, ll)
    listings = spark.createDataFrame([row(1, "same text"), row(2, "new text"), row(3, "no landlord", None), row(None, "lost"),
                                      row(5, None)], cols)
    digest = hashlib.sha256(b"same text").hexdigest()
    store = spark.createDataFrame([(1, digest, [9.0], dt.datetime(2020, 1, 1)), (2, "old", [8.0], dt.datetime(2020, 1, 1)),
                                   (7, "x", [7.0], dt.datetime(2020, 1, 1))],
                                  "listing_id long, text_hash string, embedding array<float>, updated_at timestamp")
    now = dt.datetime(2024, 1, 1)
    got = {r.listing_id: r for r in EM.ingest(listings, store, F.lit(now)).collect()}
    assert {k: r.action for k, r in got.items()} == {1: "unchanged", 2: "update", 3: "insert", 7: "kept"}
    assert got[1].embedding == [9.0] and got[7].embedding == [7.0] and got[1].updated_at == dt.datetime(2020, 1, 1)
    assert len(got[2].embedding) == EM.HASH_DIM and abs(sum(x * x for x in got[2].embedding) - 1) < 1e-5
    assert got[2].updated_at == now and got[3].updated_at == now
    _, bad = EM.ingest_split(listings)
    assert {(r.id, r.reject_reason) for r in bad.collect()} == {(None, "missing id"), (5, "empty text")}
    embed = EM.model_udf(lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    got = spark.createDataFrame([("abc",), (None,)], "t string").select(embed("t").alias("v")).collect()
    assert [(r.v.embedding, r.v.error) for r in got] == [([3.0, 1.0], None), ([0.0, 1.0], None)]


def test_model_failures_stay_with_their_rows(spark):
    from roomgrid.operators import embed as EM

    def model(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("refused")
        return [[1.0, 2.0] if t != "long" else [1.0] for t in texts]
    rows = [(i, "bad" if i % 97 == 5 else "long" if i == 400 else None if i == 7 else "ok") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    out = EM.embed_rows(df, "t", model, 2)
    wrong = {i: "RuntimeError: refused" for i, t in rows if t == "bad"}
    wrong[400] = "ValueError: the embedding function must return a vector of length 2 for each text"
    got = out.collect()
    assert len(got) == 1000
    assert {r.id: r.reject_reason for r in got if r.reject_reason is not None} == wrong
    assert all(r.embedding == (None if r.id in wrong else [1.0, 2.0]) for r in got)
    assert out.filter("reject_reason is null").count() == 1000 - len(wrong)
    assert EM.embed_rows(df.filter("id < 0"), "t", model, 2).count() == 0


def test_message_source_and_chat_append(spark, tmp_path):
    from roomgrid.sources.files import append_rows, read_messages
    p = tmp_path / "in.json"
    p.write_text('{"message_id": 1, "from_raw": "+254", "text": "habari", "ts": "2024-01-01T00:00:00Z"}\n{"message_id": 2}\n')
    m = read_messages(spark, str(p)).orderBy("message_id").collect()
    assert [(r.message_id, r.from_raw, r.text) for r in m] == [(1, "+254", "habari"), (2, None, None)]
    rows = spark.createDataFrame([("a", "u", "hi", "yo", 1), ("b", "u", None, "yo", 2)],
                                 "id string, user_id string, user_message string, bot_response string, extra int")
    out = str(tmp_path / "chats")
    bad = append_rows(rows, "chats", out)
    append_rows(rows, "chats", out)
    back = spark.read.parquet(out)
    assert back.columns == ["id", "user_id", "user_message", "bot_response", "created_at"] and back.count() == 2
    assert [(r.id, r.reject_reason) for r in bad.collect()] == [("b", "null:user_message")]

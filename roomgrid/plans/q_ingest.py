"""Registered ingest queries: text composition, hashing embedder, embedding ingest,
rejects and summary, text retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgrid.functions.text import compose_listing_text
from roomgrid.operators import embed as EM
from roomgrid.operators import search as S
from roomgrid.plans.registry import register
from roomgrid.session import scratch_path
from roomgrid.sources import views as V
from roomgrid.sources.tables import read_split, read_table

COMPOSE_SQL = """
substring(concat_ws(' | ', nullif(title, ''), nullif(description, ''), nullif(location, ''),
                   nullif(property_type, ''), nullif(furnishing, ''), nullif(utilities, ''),
                   nullif(renovations, ''),
                   CASE WHEN len(amenities) > 0 THEN 'Amenities: ' || array_to_string(amenities, ', ') END,
                   CASE WHEN coalesce(price, 0) <> 0 THEN 'Price: ' || CAST(price AS VARCHAR) END,
                   CASE WHEN coalesce(size_sqm, 0) <> 0 THEN 'Size: ' || CAST(size_sqm AS VARCHAR) || ' sqm' END),
          1, 16000)"""

WORDS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
BUCKET = f"(('0x' || substring(sha256(tok), 1, 8))::BIGINT % {EM.HASH_DIM})"


def _listing_texts(spark, d):
    """The listings' texts, made and read by all cores however few files the table has."""
    return V.listings(spark, d, read_split).select(F.col("id").alias("listing_id"), compose_listing_text().alias("text"))


def _written(emb):
    """The vectors, written once: the search counts them before it reads them."""
    path = scratch_path(emb.sparkSession, "listing-vectors")
    emb.select("listing_id", "embedding").write.parquet(path)
    return emb.sparkSession.read.parquet(path)


@register("compose_text", views=("listings_v",), sql=f"SELECT id, {COMPOSE_SQL} AS text FROM listings_v")
def compose_text(spark, d):
    """Embedding text per listing: present fields in order, amenities, price, size."""
    return V.listings(spark, d).select("id", compose_listing_text().alias("text"))


@register("embed_hash", views=("listings_v",), sql=f"""
WITH t AS (SELECT id, {COMPOSE_SQL} AS text FROM listings_v),
k AS (SELECT id, unnest({WORDS.format(x='text')}) AS tok FROM t),
b AS (SELECT id, {BUCKET} AS bucket, count(*) AS cnt FROM k GROUP BY id, bucket)
SELECT t.id AS listing_id, coalesce(sum(cnt), 0)::BIGINT AS n_tokens, count(bucket)::BIGINT AS nnz,
       arg_max(bucket, (cnt, -bucket)) AS top_bucket
FROM t LEFT JOIN b USING (id) GROUP BY t.id
""")
def embed_hash(spark, d):
    """Feature-hashing embedder over the composed text (sparse counts, then the dense
    normalised vector); reported as token count, non-zero buckets, heaviest bucket."""
    e = EM.hashed_tf(_listing_texts(spark, d), "listing_id", "text")
    return e.select("listing_id", "n_tokens", "nnz", EM.heaviest(F.col("cnt")).alias("top_bucket"))


# A stored vector's text hash: the current one for ids divisible by three, else an old one.
NOW, BEFORE = "2024-06-01 00:00:00", "2024-01-01 00:00:00"


def digits(vec):
    """A vector as text, three decimals each: what the oracle compares."""
    return F.array_join(F.transform(vec, lambda x: F.round(x.cast("double") * 1000).cast("int").cast("string")), ",")


def stored(spark, d):
    texts = V.listings(spark, d).select(F.col("id").alias("vec_id"), F.sha2(compose_listing_text(), 256).alias("h"))
    return read_table(spark, d, "embeddings").join(texts, "vec_id", "left").select(
        F.col("vec_id").alias("listing_id"),
        F.when((F.col("vec_id") % 3 == 0) & F.col("h").isNotNull(), F.col("h")).otherwise("old").alias("text_hash"),
        "embedding", F.lit(BEFORE).cast("timestamp").alias("updated_at"))


@register("embedding_ingest", views=("ingest_v", "listings_v"), sql=f"""
WITH t AS (SELECT id AS listing_id, {COMPOSE_SQL} AS text FROM ingest_v),
g AS (SELECT listing_id, text, sha256(text) AS h FROM t WHERE listing_id IS NOT NULL AND text <> ''),
s AS (SELECT e.vec_id AS listing_id, e.embedding,
             CASE WHEN e.vec_id % 3 = 0 AND l.id IS NOT NULL THEN sha256({COMPOSE_SQL}) ELSE 'old' END AS old
      FROM embeddings e LEFT JOIN listings_v l ON l.id = e.vec_id),
k AS (SELECT listing_id, unnest({WORDS.format(x='text')}) AS tok FROM g),
b AS (SELECT listing_id, {BUCKET} AS bucket, count(*) AS cnt FROM k GROUP BY 1, 2),
nrm AS (SELECT listing_id, sqrt(sum(cnt * cnt)) AS norm FROM b GROUP BY 1),
dims AS (SELECT unnest(generate_series(0, {EM.HASH_DIM - 1})) AS i),
made AS (SELECT g.listing_id, string_agg(CAST(CAST(round(coalesce(CAST(CAST(b.cnt / nrm.norm AS FLOAT) AS DOUBLE), 0.0) * 1000) AS INTEGER)
                AS VARCHAR), ',' ORDER BY dims.i) AS v
         FROM g CROSS JOIN dims LEFT JOIN b ON b.listing_id = g.listing_id AND b.bucket = dims.i
                LEFT JOIN nrm ON nrm.listing_id = g.listing_id GROUP BY g.listing_id),
old AS (SELECT listing_id, string_agg(CAST(CAST(round(CAST(x AS DOUBLE) * 1000) AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS v
        FROM (SELECT listing_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM s) GROUP BY listing_id),
j AS (SELECT coalesce(g.listing_id, s.listing_id) AS listing_id, coalesce(g.h, s.old) AS text_hash,
             CASE WHEN g.h IS NULL THEN 'kept' WHEN s.listing_id IS NULL THEN 'insert'
                  WHEN s.old = g.h THEN 'unchanged' ELSE 'update' END AS action
      FROM g FULL OUTER JOIN s ON s.listing_id = g.listing_id)
SELECT j.listing_id, j.text_hash, j.action, CASE WHEN j.action IN ('insert', 'update') THEN made.v ELSE old.v END AS vector,
       CASE WHEN j.action IN ('insert', 'update') THEN TIMESTAMP '{NOW}' ELSE TIMESTAMP '{BEFORE}' END AS updated_at
FROM j LEFT JOIN made USING (listing_id) LEFT JOIN old USING (listing_id)
""")
def embedding_ingest(spark, d):
    """Compose -> embed -> upsert: the whole store after the batch, vectors included."""
    out = EM.ingest(V.ingest_batch(spark, d), stored(spark, d), F.lit(NOW).cast("timestamp"))
    return out.select("listing_id", "text_hash", "action", digits(F.col("embedding")).alias("vector"), "updated_at")


@register("ingest_rejects", views=("ingest_v",), sql=f"""
WITH t AS (SELECT id, title, {COMPOSE_SQL} AS text FROM ingest_v)
SELECT id, title, CASE WHEN id IS NULL THEN 'missing id' ELSE 'empty text' END AS reject_reason
FROM t WHERE id IS NULL OR text = ''
""")
def ingest_rejects(spark, d):
    _, bad = EM.ingest_split(V.ingest_batch(spark, d))
    return bad.select("id", "title", "reject_reason")


PLAIN_DIM = 3


def plain_model(texts):
    """A stand-in for a hosted model, with its faults: a batch with an empty text or one that
    names parking fails as a whole."""
    if any(t == "" for t in texts):
        raise ValueError("no input")
    if any("arking" in t for t in texts):
        raise RuntimeError("refused")
    return [[len(t), t.count(" "), t.count("|")] for t in texts]


@register("model_embeddings", views=("ingest_v",), sql=f"""
WITH t AS (SELECT id, title, {COMPOSE_SQL} AS text FROM ingest_v)
SELECT id, title,
       CASE WHEN text = '' THEN 'ValueError: no input' WHEN contains(text, 'arking') THEN 'RuntimeError: refused' END AS reject_reason,
       CASE WHEN text <> '' AND NOT contains(text, 'arking')
            THEN len(text) || ',' || (len(text) - len(replace(text, ' ', ''))) || ',' || (len(text) - len(replace(text, '|', '')))
       END AS vector
FROM t
""")
def model_embeddings(spark, d):
    """Embedding by a model that fails on some rows: the others keep their vectors, the failing
    ones are rejects with the model's error."""
    t = V.ingest_batch(spark, d).withColumn("text", compose_listing_text())
    vector = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return EM.embed_rows(t, "text", plain_model, PLAIN_DIM) \
        .select("id", "title", "reject_reason", vector.alias("vector"))


@register("ingest_summary", views=("ingest_v",), sql=f"""
WITH t AS (SELECT id, {COMPOSE_SQL} AS text FROM ingest_v)
SELECT count(*) AS n_listings, count(*) FILTER (WHERE id IS NULL OR text = '') AS n_rejected,
       count(*) FILTER (WHERE NOT (id IS NULL OR text = '')) AS n_embedded
FROM t
""")
def ingest_summary(spark, d):
    t = V.ingest_batch(spark, d).withColumn("text", compose_listing_text())
    bad = F.col("id").isNull() | (F.col("text") == "")
    return t.agg(F.count(F.lit(1)).alias("n_listings"), F.sum(bad.cast("long")).alias("n_rejected"),
                 F.sum((~bad).cast("long")).alias("n_embedded"))


RETRIEVE_THRESHOLD = 0.1


@register("retrieve_text", views=("listings_v",), sql=f"""
WITH t AS (SELECT id AS k, {COMPOSE_SQL} AS text FROM listings_v),
q AS (SELECT item_id AS k, text FROM benchmark),
lb AS (SELECT k, {BUCKET} AS bucket, count(*) AS cnt FROM (SELECT k, unnest({WORDS.format(x='text')}) AS tok FROM t) GROUP BY 1, 2),
qb AS (SELECT k, {BUCKET} AS bucket, count(*) AS cnt FROM (SELECT k, unnest({WORDS.format(x='text')}) AS tok FROM q) GROUP BY 1, 2),
ln AS (SELECT k, sqrt(sum(cnt * cnt)) AS n FROM lb GROUP BY 1), qn AS (SELECT k, sqrt(sum(cnt * cnt)) AS n FROM qb GROUP BY 1),
s AS (SELECT qb.k AS query_id, lb.k AS id, sum(qb.cnt * lb.cnt) / (min(qn.n) * min(ln.n)) AS sim
      FROM qb JOIN lb USING (bucket) JOIN qn ON qn.k = qb.k JOIN ln ON ln.k = lb.k GROUP BY 1, 2),
r AS (SELECT query_id, id, round(sim, 6) AS similarity FROM s WHERE sim > {RETRIEVE_THRESHOLD}),
best AS (SELECT query_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, id FROM r)
SELECT query_id, round(CAST(max(similarity) AS DOUBLE), 4) AS best_similarity, count(*) AS n,
       count(*) FILTER (WHERE id IN (SELECT id FROM listings_v)) AS n_listed
FROM best WHERE rank <= 5 GROUP BY query_id
""")
def retrieve_text(spark, d):
    """Text search: the benchmark items are embedded with the same hashing embedder as the
    listing texts, matched with the vector search in double precision, and joined to the listings."""
    lst = V.listings(spark, d)
    emb = _written(EM.hashed_tf(_listing_texts(spark, d), "listing_id", "text", kind="double"))
    q = read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    qe = EM.hashed_tf(q, "query_id", "text", kind="double").select("query_id", "embedding")
    hits = S.match_listings(emb, lst, qe, RETRIEVE_THRESHOLD, 5, columns=["id", "property_type"], dim=EM.HASH_DIM)
    return hits.groupBy("query_id").agg(F.round(F.max("similarity"), 4).alias("best_similarity"), F.count("*").alias("n"),
                                        F.count("property_type").alias("n_listed"))


# Document frequencies come from two batches; the first one runs twice and counts once.
TFIDF_SQL = f"""
t AS (SELECT id AS k, {COMPOSE_SQL} AS text FROM listings_v),
tk AS (SELECT k, {BUCKET} AS bucket, count(*) AS cnt FROM (SELECT k, unnest({WORDS.format(x='text')}) AS tok FROM t) GROUP BY 1, 2),
idf AS (SELECT bucket, ln((1 + (SELECT count(*) FROM t)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM tk GROUP BY 1),
lb AS (SELECT k, bucket, cnt, cnt * idf AS w FROM tk JOIN idf USING (bucket)),
ln AS (SELECT k, sqrt(sum(w * w)) AS n FROM lb GROUP BY 1)"""




def _idf(spark, docs):
    path = scratch_path(spark, "document-frequencies")
    halves = [docs.filter(F.col("listing_id") % 2 == r) for r in (0, 1)]
    for batch, part in (("0", halves[0]), ("1", halves[1]), ("0", halves[0])):
        EM.add_document_frequencies(part, "listing_id", "text", path, batch)
    return EM.inverse_frequencies(spark, path)


@register("embed_tfidf", views=("listings_v",), sql=f"""
WITH {TFIDF_SQL}, dims AS (SELECT unnest(generate_series(0, {EM.HASH_DIM - 1})) AS i)
SELECT t.k AS listing_id, string_agg(CAST(CAST(round(coalesce(lb.w / ln.n, 0.0) * 1000) AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS vector,
       coalesce(sum(lb.cnt), 0)::BIGINT AS n_tokens, count(lb.bucket)::BIGINT AS nnz
FROM t CROSS JOIN dims LEFT JOIN lb ON lb.k = t.k AND lb.bucket = dims.i LEFT JOIN ln ON ln.k = t.k GROUP BY t.k
""")
def embed_tfidf(spark, d):
    """Hashed TF-IDF vectors of all listing texts, frequencies counted batch by batch."""
    docs = _listing_texts(spark, d)
    e = EM.hashed_tfidf(docs, "listing_id", "text", _idf(spark, docs), kind="double")
    return e.select("listing_id", digits(F.col("embedding")).alias("vector"), "n_tokens", "nnz")


@register("retrieve_tfidf", views=("listings_v",), sql=f"""
WITH {TFIDF_SQL}, q AS (SELECT item_id AS k, text FROM benchmark),
qt AS (SELECT k, {BUCKET} AS bucket, count(*) AS cnt FROM (SELECT k, unnest({WORDS.format(x='text')}) AS tok FROM q) GROUP BY 1, 2),
qb AS (SELECT k, bucket, cnt * coalesce(idf, ln(1 + (SELECT count(*) FROM t)) + 1) AS w FROM qt LEFT JOIN idf USING (bucket)),
qn AS (SELECT k, sqrt(sum(w * w)) AS n FROM qb GROUP BY 1),
s AS (SELECT qb.k AS query_id, lb.k AS id, sum(qb.w * lb.w) / (min(qn.n) * min(ln.n)) AS sim
      FROM qb JOIN lb USING (bucket) JOIN qn ON qn.k = qb.k JOIN ln ON ln.k = lb.k GROUP BY 1, 2),
r AS (SELECT query_id, id, round(sim, 6) AS similarity FROM s WHERE sim > {RETRIEVE_THRESHOLD}),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM r)
SELECT query_id, rank, b.id, l.property_type, similarity FROM b JOIN listings_v l ON l.id = b.id WHERE rank <= 5
""")
def retrieve_tfidf(spark, d):
    """Text search with weighted terms: the benchmark items against the listing texts, both under
    the same frequencies; every hit with its rank."""
    lst, docs = V.listings(spark, d), _listing_texts(spark, d)
    idf = _idf(spark, docs)
    emb = _written(EM.hashed_tfidf(docs, "listing_id", "text", idf, kind="double"))
    q = read_table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    qe = EM.hashed_tfidf(q, "query_id", "text", idf, kind="double").select("query_id", "embedding")
    hits = S.match_listings(emb, lst, qe, RETRIEVE_THRESHOLD, 5, columns=["id", "property_type"], dim=EM.HASH_DIM)
    return hits.select("query_id", "rank", "id", "property_type", "similarity")

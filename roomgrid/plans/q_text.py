"""Registered language-identification and intent-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgrid.operators import language as LANG
from roomgrid.operators import textmodel as NB
from roomgrid.plans.oracle_views import (keyword_stage_sql, map_code_sql, nb_intent_ctes,
                                         nb_lang_ctes)
from roomgrid.plans.registry import register
from roomgrid.sources import views as V
from roomgrid.sources.tables import read_split


@register("lang_keywords", views=("messages_v",), sql=f"""
SELECT message_id, {keyword_stage_sql('text')} AS lang_kw FROM messages_v
""")
def lang_keywords(spark, d):
    """Keyword stage only: 'other' for blank, 'sheng' on a keyword token, else null."""
    return V.messages(spark, d).select("message_id", LANG.keyword_stage(F.col("text")).alias("lang_kw"))


@register("lang_profile", sql=f"""
WITH {nb_lang_ctes('p', 'documents', 'doc_id', 'text')}
SELECT c.label AS lang, c.token AS gram, c.n,
       round(ln((c.n + 1.0) / (k.total + v.v)), 6) AS logp
FROM p_counts c JOIN p_cls k USING (label) CROSS JOIN p_voc v
""")
def lang_profile(spark, d):
    """Character trigram profile per language from the labelled documents."""
    model = LANG.train_profile(read_split(spark, d, "documents"))
    return LANG.profile_table(model).select("lang", "gram", "n",
                                            F.round("logp", 6).alias("logp"))


@register("lang_ngram", sql=f"""
WITH {nb_lang_ctes('p', 'documents', 'doc_id', 'text')}
SELECT d.doc_id,
       coalesce({keyword_stage_sql('d.text')}, {map_code_sql('b.label')}) AS lang_pred
FROM documents d LEFT JOIN p_best b ON b.k = d.doc_id
""")
def lang_ngram(spark, d):
    """Full language id of every document: keyword stage, then the trigram model."""
    docs = read_split(spark, d, "documents")
    model = LANG.train_profile(docs)
    out = LANG.detect(model, docs.select("doc_id", "text"), "doc_id")
    return out.select("doc_id", F.col("lang").alias("lang_pred"))


# ---- intent classifier (naive Bayes on word tokens) ----------------------------------
INTENT_CUTOFF = 0.6


def intent_model(msgs, path=None):
    """The five-intent model, from the messages' told intents."""
    return NB.fit(msgs, NB.word_tokens(F.col("text")), F.col("told_intent"), path)


def with_intent(msgs, model, key="message_id"):
    """Messages + ``predicted`` and ``intent``: the class posterior is a real confidence, and
    below the cutoff the intent is 'fallback'."""
    p = NB.predict(model, msgs.select(key, "text"), key, NB.word_tokens(F.col("text")))
    p = p.select(key, F.col("label").alias("predicted"),
                 F.when(F.col("posterior") >= INTENT_CUTOFF, F.col("label")).otherwise(F.lit("fallback")).alias("intent"))
    return msgs.join(p, key, "left").withColumn("intent", F.coalesce("intent", F.lit("fallback")))


@register("intent_train_counts", views=("messages_v",), sql=f"""
WITH {nb_intent_ctes(INTENT_CUTOFF)}
SELECT label, token, n FROM i_cnt
""")
def intent_train_counts(spark, d):
    """Training job: (intent, token, count) of the word-token naive Bayes model."""
    return intent_model(V.messages(spark, d)).counts


@register("intent_predict", views=("messages_v",), sql=f"""
WITH {nb_intent_ctes(INTENT_CUTOFF)}
SELECT k AS message_id, predicted, intent FROM intents
""")
def intent_predict(spark, d):
    """Classify every message into the five intents."""
    msgs = V.messages(spark, d)
    return with_intent(msgs, intent_model(msgs)).select("message_id", "predicted", "intent")

"""Language identification: slang keyword stage, then a character n-gram naive Bayes
model trained on labelled text (a Spark job), then the reference's code mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomgrid.functions.text import SPACE, blank, split_ws
from roomgrid.operators import textmodel as nb

# The reference's Sheng keyword list, in its order.  Membership is tested
# against lower-cased whitespace tokens, so the entry with a capital and a space can
# never match, and punctuation stays attached to tokens.
SHENG_KEYWORDS = [
    "poa", "sasa", "msee", "hao", "niko", "rada", "mbona", "nani", "chill", "flani",
    "ngoja", "buda", "sijui", "fanya", "piga", "genje", "keja", "single", "Bed moja", "mtaa",
    "mraazi", "bonga", "wazi", "stage", "tulia", "hama", "kuinama", "westi", "kanairo", "kasa",
    "tao", "bukla", "punch", "mat", "caretaker",
]
GRAM = 3


def keyword_stage(text: Column, strip_punct: bool = False) -> Column:
    """'other' for blank text, 'sheng' when a whitespace token is a keyword, else null."""
    if strip_punct:
        toks = F.transform(split_ws(F.lower(text)), lambda t: F.regexp_replace(t, r"^\p{P}+|\p{P}+$", ""))
        hit = F.arrays_overlap(toks, F.array(*[F.lit(k) for k in SHENG_KEYWORDS]))
    else:  # one search, no list of tokens
        hit = F.lower(text).rlike(rf"(?:\A|{SPACE})(?:{'|'.join(k for k in SHENG_KEYWORDS if ' ' not in k)})(?:{SPACE}|\z)")
    return F.when(blank(text), F.lit("other")).when(hit, F.lit("sheng"))


def map_code(code: Column) -> Column:
    """'sw' stays, any 'en*' becomes 'en', other codes unchanged, none -> 'other'."""
    return (F.when(code.isNull(), F.lit("other"))
            .when(code == "sw", F.lit("sw"))
            .when(code.startswith("en"), F.lit("en"))
            .otherwise(code))


def train_profile(labelled: DataFrame, text: str = "text", lang: str = "lang",
                  n: int = GRAM, path: str | None = None) -> nb.NBModel:
    """Gram counts per language over the letters of labelled texts, saved at ``path``."""
    return nb.fit_grams(labelled, nb.letter_text(F.col(text)), n, F.col(lang), path)


def profile_table(model: nb.NBModel) -> DataFrame:
    """(lang, gram, n, logp) with Laplace smoothing."""
    spark = model.counts.sparkSession
    cls = model.class_table(spark).select("label", "total")
    return (model.counts.join(F.broadcast(cls), "label")
            .select(F.col("label").alias("lang"), F.col("token").alias("gram"), "n",
                    F.log((F.col("n") + 1.0) / (F.col("total") + F.lit(float(model.vocab))))
                    .alias("logp")))


def detect(model: nb.NBModel, df: DataFrame, key: str, text: str = "text",
           n: int = GRAM) -> DataFrame:
    """-> df + lang: keyword stage first; otherwise the n-gram model's best language; a text
    without any letter has no feature and is 'other'."""
    # no filter here: it would be pushed below a repartition and run where the scan runs; and
    # the keyword stage belongs below the join, whose output may be few partitions
    todo = df.select(key, nb.letter_text(F.col(text)).alias("_letters"))
    pred = nb.predict_grams(model, todo, key, F.col("_letters"), n).select(key, F.col("label").alias("code"))
    kw = df.withColumn("_kw", keyword_stage(F.col(text))) \
        .withColumn("_has", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return kw.join(pred, key, "left").withColumn(
        "lang", F.coalesce("_kw", map_code(F.when(F.col("_has"), F.col("code"))))).drop("code", "_kw", "_has")

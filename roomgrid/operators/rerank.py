"""Attribute-boosted re-ranking and attribute search, as Column expressions.

Score of a candidate (reference semantics, "present" = Python truthiness, so empty
strings, 0 and null are absent):
    similarity (0 when absent)
    + 0.2  if the type parameter and the candidate type are present and the parameter,
           lower-cased, is a substring of the candidate type, lower-cased
    + max(0, 0.2 - |price - max_price| / (max_price + 1) * 0.2)
           if max_price and price are present (symmetric: over budget boosts too)
    + 0.1  if furnishing parameter and value present and a case-insensitive substring
           (so "furnished" also boosts "Unfurnished")
    + neighborhood_rating / 10  if present
Ranking: score desc, then input order (the reference's sort is stable).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present_str(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(""))


def present_num(c: Column) -> Column:
    return c.isNotNull() & (c != F.lit(0))


def _lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rerank_score(similarity: Column, property_type: Column, price: Column, furnishing: Column,
                 rating: Column, p_type=None, p_max_price=None, p_furnishing=None,
                 exact_furnishing: bool = False) -> Column:
    """Parameters may be Python literals (one request) or Columns (a request table)."""
    zero = F.lit(0.0)
    score = F.coalesce(similarity.cast("double"), zero)
    if p_type is not None:
        pt = _lit_or_col(p_type)
        score = score + F.when(present_str(pt) & present_str(property_type)
                               & F.lower(property_type).contains(F.lower(pt)), F.lit(0.2)).otherwise(zero)
    if p_max_price is not None:
        mp = _lit_or_col(p_max_price).cast("double")
        boost = F.greatest(zero, F.lit(0.2) - F.abs(price - mp) / (mp + F.lit(1.0)) * F.lit(0.2))
        score = score + F.when(present_num(mp) & present_num(price), boost).otherwise(zero)
    if p_furnishing is not None:
        pf = _lit_or_col(p_furnishing)
        match = (F.lower(furnishing) == F.lower(pf)) if exact_furnishing else \
            F.lower(furnishing).contains(F.lower(pf))
        score = score + F.when(present_str(pf) & present_str(furnishing) & match,
                               F.lit(0.1)).otherwise(zero)
    score = score + F.when(present_num(rating), rating.cast("double") / F.lit(10.0)).otherwise(zero)
    return score


def rerank(candidates: DataFrame, top_k: int = 5, group: str = "query_id",
           order_col: str = "input_rank", **params) -> DataFrame:
    """Candidates: (group, id, similarity, property_type, price, furnishing,
    neighborhood_rating, input_rank).  Params: p_type, p_max_price, p_furnishing as
    literals or Columns of the candidate rows."""
    c = candidates.withColumn("score", rerank_score(
        F.col("similarity"), F.col("property_type"), F.col("price"), F.col("furnishing"),
        F.col("neighborhood_rating"), **params))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), F.col(order_col).asc())
    return c.withColumn("rerank", F.row_number().over(w)).filter(F.col("rerank") <= top_k)


def filter_listings(listings: DataFrame, location: str | None = None,
                    max_price: float | None = None, property_type: str | None = None,
                    escape: bool = False, limit: int | None = 100) -> DataFrame:
    """Attribute search: optional conjuncts (location and type by truthiness, max_price
    by ``is not None`` so 0 filters), ``ilike '%x%'`` with the caller text used as a
    pattern (``escape=True`` matches it literally).  Deterministic order by id before
    the limit."""
    preds = []

    def contains_ci(col, x):
        if escape:
            return F.lower(F.col(col)).contains(x.lower())
        return F.col(col).ilike(f"%{x}%")

    if location:
        preds.append(contains_ci("location", location))
    if max_price is not None:
        preds.append(F.col("price") <= F.lit(float(max_price)))
    if property_type:
        preds.append(contains_ci("property_type", property_type))
    out = listings.filter(reduce(lambda a, b: a & b, preds)) if preds else listings
    out = out.orderBy("id")
    return out.limit(limit) if limit is not None else out

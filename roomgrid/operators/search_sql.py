"""The search function as a SQL table function.

``register_match_listings`` puts a listing table and its embeddings behind one temporary
function, to be called from any statement of the session:

    SELECT * FROM match_listings(array(0.1D, ...), 0.5D, 5)

It returns the listing's declared columns and the similarity, as ``search.match_listings``
does for a table of queries.  The body is plain SQL, so Catalyst sees through the call: the
vectors are scored once, where they are read, each task keeps its best ``k`` (a constant ``k``
becomes a limit below the exchange), and only k keys meet the listings.

Defined results: vectors that are null, of another dimension than the query, or hold null or
non-finite components match nothing, nor does a null query; ties go to the smaller id;
listings without a vector and vectors without a listing are not returned; columns of the model
that the given listings lack are null, other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgrid import schemas as SC

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)"


def declared(listings: DataFrame) -> DataFrame:
    """The listings in the columns of the model, in order; keys keep their type."""
    have = dict(listings.dtypes)
    return listings.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(
            have.get(f.name, f.dataType.simpleString()) if f.name == "id" or f.name.endswith("_id")
            else f.dataType).alias(f.name)
        for f in SC.LISTINGS])


def register_match_listings(spark: SparkSession, listings: DataFrame, embeddings: DataFrame,
                            name: str = "match_listings") -> None:
    """Create or replace the function ``name(query, threshold, k)`` over ``listings`` and
    ``embeddings`` (listing_id, embedding).  The two frames become the session's views
    ``<name>_listings`` and ``<name>_embeddings``."""
    rows = declared(listings)
    rows.createOrReplaceTempView(f"{name}_listings")
    embeddings.select("listing_id", "embedding").createOrReplaceTempView(f"{name}_embeddings")
    columns = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    out = ", ".join(f"l.{c}" for c in rows.columns)
    dot, mine, theirs = (_DOT.format(a=a, b=b) for a, b in (
        ("e.embedding", f"{name}.query"), ("e.embedding", "e.embedding"), (f"{name}.query", f"{name}.query")))
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, threshold DOUBLE, k INT)
        RETURNS TABLE ({columns}, similarity DOUBLE)
        RETURN
        SELECT {out}, b.similarity
        FROM (SELECT id, sim, round(sim, 6) AS similarity,
                     row_number() OVER (ORDER BY round(sim, 6) DESC NULLS LAST, id) AS place
              FROM (SELECT e.listing_id AS id, nanvl(try_divide({dot}, sqrt({mine}) * sqrt({theirs})), NULL) AS sim
                    FROM {name}_embeddings e LEFT SEMI JOIN {name}_listings k ON k.id = e.listing_id)) b
        JOIN {name}_listings l ON l.id = b.id
        WHERE b.place <= {name}.k AND b.sim > {name}.threshold""")

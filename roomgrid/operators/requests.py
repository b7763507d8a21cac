"""Attribute search for a table of requests: ``ilike '%x%'`` on location and type, a price
limit, every conjunct optional, the first ``limit`` listings by id for each request.

No request meets every listing:
* **Patterns** meet the distinct values of an attribute through an inverted index of their
  grams (all of up to three letters, and the empty one that every value has).  A pattern's
  literal runs give its grams, of the longest length that it has; it meets the values of its
  rarest gram, and ``ilike`` decides.  So ``%``, ``_``, short and empty patterns are exact.
* **Pairs.**  Requests with equal patterns share their matches.  A pair of patterns reaches the
  listings through the values of that pattern which fewer listings have, and the other pattern
  filters by a semi join with its values.
* **Listings** of equal attributes are in the same answers, so of these only those are kept that
  can be among the first: a listing goes that has ``limit`` cheaper or equal ones before it.
* **Prices** are numbers of ``LEVELS`` digits.  For a pair, each run of leading digits keeps its
  first ``limit`` listings.  The prices below a request's are, on each level, the runs that
  share its digits up to there and go on with a smaller one: a few short lists, however many
  listings the pair has.  Rows of the same whole number compare by their price.

Null or empty patterns do not filter, nor does a null price; a listing without a price fails
every price limit, and one without the attribute every pattern.  A backslash makes the next
sign literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 100
LEVELS = 12      # digits of a price, each of DIGIT bits
DIGIT = 4
SHARDS = 32      # of equal attributes, at first


def grams_of(text: Column, n: int) -> Column:
    """All grams of n letters; none for shorter texts."""
    return F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))


def value_index(values: DataFrame) -> DataFrame:
    """(value) -> (gram, value): grams of 0 to 3 letters of the lower-cased value."""
    low = F.lower("value")
    return values.select("value", F.explode(F.array_distinct(F.concat(
        F.array(F.lit("")), grams_of(low, 1), grams_of(low, 2), grams_of(low, 3)))).alias("gram"))


def pattern_grams(pattern: str) -> Column:
    """Grams that every match of ``%pattern%`` holds: those of its literal runs, of three
    letters if there are any, else of two, of one, or the empty one."""
    runs = F.split(F.regexp_replace(F.lower(F.col(pattern)), r"\\.?", "%"), "[%_]+")
    of = [F.flatten(F.transform(runs, lambda r, n=n: grams_of(r, n))) for n in (3, 2, 1)]
    best = F.array(F.lit(""))
    for g in reversed(of):
        best = F.when(F.size(g) > 0, g).otherwise(best)
    return F.array_distinct(best)


def matches(pattern: str, value: str) -> Column:
    """``value ilike '%pattern%'``, where a backslash before an ordinary sign is that sign."""
    plain = F.regexp_replace(F.col(pattern), r"\\([^%_\\])", "$1")
    return F.call_function("ilike", F.col(value), F.concat(F.lit("%"), plain, F.lit("%")))


def pattern_values(patterns: DataFrame, values: DataFrame) -> DataFrame:
    """(pattern) and (value, n) -> (pattern, value, n) of all matches."""
    index = value_index(values)
    count = index.groupBy("gram").agg(F.count("*").alias("holders"))
    rarest = (patterns.filter("pattern is not null").distinct()
              .select("pattern", F.explode(pattern_grams("pattern")).alias("gram"))
              .join(count, "gram", "left")
              .groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("holders", F.lit(0)), "gram")).alias("gram")))
    met = rarest.join(index, "gram").filter(matches("pattern", "value"))
    return met.select("pattern", "value").join(values, "value")


def can_be_first(offers: DataFrame, limit: int) -> DataFrame:
    """(id, location, property_type, price) without the listings that no request can get.  Those
    of equal attributes, by id, lie in runs of ``limit``, ``limit``, 2 ``limit``, 4 ``limit``, ...;
    the ``limit``-th lowest price of a run is a bound for the prices in all later ones.  The
    first run stays whole, for requests without a price.  Runs are first found in shards of the
    ids, so that attributes which most listings have are not one group; what a shard drops, the
    whole would drop."""
    for shards in (SHARDS, 1):
        group = ["location", "property_type", "_shard"]
        rows = offers.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
        place = F.row_number().over(Window.partitionBy(*group).orderBy("id", "price")) - 1
        rows = rows.withColumn("_place", place).withColumn("_run", F.when(F.col("_place") < limit, 0).otherwise(
            F.floor(F.log2(F.floor(F.col("_place") / limit))) + 1).cast("int"))
        cheap = F.row_number().over(Window.partitionBy(*group, "_run").orderBy(F.col("price").asc_nulls_last()))
        rows = rows.withColumn("_bound", F.when(cheap == limit, F.col("price")))
        earlier = Window.partitionBy(*group).orderBy("_run").rangeBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("_bound", F.min("_bound").over(earlier))
        stays = (F.col("_run") == 0) | (F.col("price").isNotNull() & (F.col("_bound").isNull() | (F.col("price") < F.col("_bound"))))
        offers = rows.filter(stays).select("id", "location", "property_type", "price").checkpoint()
    return offers


def price_number(price: Column) -> Column:
    """Hundredths of a price as a number of ``LEVELS`` digits that keeps the order."""
    half = 1 << (LEVELS * DIGIT - 1)
    return (F.floor(F.greatest(F.lit(-half / 128.0), F.least(F.lit(half / 128.0), price)) * 100) + half).cast("long")


def first_level(*numbers: DataFrame) -> int:
    """The first level whose digits differ among all ``number``s; the ones before decide nothing."""
    ends = [x for df in numbers for x in df.agg(F.min("number"), F.max("number")).first() if x is not None]
    return next((k for k in range(LEVELS) if ends and min(ends) >> (LEVELS - 1 - k) * DIGIT != max(ends) >> (LEVELS - 1 - k) * DIGIT), LEVELS - 1)


def leading(number: str, first: int = 0) -> Column:
    """One (level, above, digit) for each level from ``first`` on: the digits before it, and its own."""
    return F.explode(F.array(*[F.struct(
        F.lit(k).alias("level"), F.shiftright(number, (LEVELS - k) * DIGIT).alias("above"),
        F.shiftright(number, (LEVELS - 1 - k) * DIGIT).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")) for k in range(first, LEVELS)]))


def search_by_requests(listings: DataFrame, requests: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Requests (request_id, location, max_price, property_type) -> (request_id, rank, id)."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    asked = requests.select("request_id", some("location").alias("lp"), some("property_type").alias("tp"),
                            F.col("max_price").cast("double").alias("max_price"))
    asked = asked.withColumn("pair", F.to_json(F.struct("lp", "tp")))
    pairs = asked.select("pair", "lp", "tp").distinct()
    price = F.col("price").cast("double")
    offers = can_be_first(listings.select("id", "location", "property_type", F.when(~F.isnan(price), price).alias("price")), limit)

    def met(pattern: str, column: str) -> DataFrame:
        values = offers.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        return pattern_values(pairs.select(F.col(pattern).alias("pattern")), values)

    by_place, by_type = met("lp", "location").checkpoint(), met("tp", "property_type").checkpoint()
    size = lambda m, p, out: m.groupBy(F.col("pattern").alias(p)).agg(F.sum("n").alias(out))
    sized = (pairs.join(size(by_place, "lp", "n_lp"), "lp", "left").join(size(by_type, "tp", "n_tp"), "tp", "left")
             .na.fill(0, ["n_lp", "n_tp"]))
    first = F.when(F.col("lp").isNotNull() & (F.col("tp").isNull() | (F.col("n_lp") <= F.col("n_tp"))), "place") \
        .when(F.col("tp").isNotNull(), "type")
    sized = sized.withColumn("first", first).checkpoint()

    def reached(side: str, own: str, mine: DataFrame, column: str, other: str, theirs: DataFrame, their_column: str) -> DataFrame:
        rows = (sized.filter(F.col("first") == side).join(mine.select(F.col("pattern").alias(own), "value"), own)
                .join(offers, F.col("value") == F.col(column)).select("pair", other, "id", "price", their_column))
        both = theirs.select(F.col("pattern").alias(other), F.col("value").alias(their_column))
        held = rows.filter(F.col(other).isNotNull()).join(both, [other, their_column], "left_semi")
        return rows.filter(F.col(other).isNull()).select("pair", "id", "price").unionByName(held.select("pair", "id", "price"))

    found = (reached("place", "lp", by_place, "location", "tp", by_type, "property_type")
             .unionByName(reached("type", "tp", by_type, "property_type", "lp", by_place, "location")))
    open_ = sized.filter("first is null").select("pair").first()      # the pair without patterns, if asked
    if open_:
        found = found.unionByName(offers.select(F.lit(open_["pair"]).alias("pair"), "id", "price"))
    found = found.checkpoint()

    def lowest(rows: DataFrame, *group: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy("id")
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)

    priced = found.filter("price is not null").withColumn("number", price_number(F.col("price")))
    point = (asked.filter("max_price is not null").select("pair", "max_price").distinct()
             .withColumn("number", price_number(F.col("max_price"))))
    first = first_level(priced, point)
    runs = lowest(priced.select("pair", "id", leading("number", first).alias("run")).select("pair", "id", "run.*"),
                  "pair", "level", "above", "digit").select("pair", "level", "above", F.col("digit").alias("lower"), "id")
    equal = lowest(priced, "pair", "price").select("pair", "number", "price", "id")
    below = (point.select("pair", "max_price", leading("number", first).alias("run")).select("pair", "max_price", "run.*")
             .join(runs, ["pair", "level", "above"]).filter("lower < digit").select("pair", "max_price", "id"))
    beside = point.join(equal, ["pair", "number"]).filter("price <= max_price").select("pair", "max_price", "id")
    limited = lowest(below.unionByName(beside), "pair", "max_price")
    whole = lowest(found, "pair").select("pair", "id", "rank")
    out = (asked.join(limited, ["pair", "max_price"]).select("request_id", "rank", "id")
           .unionByName(asked.filter("max_price is null").join(whole, "pair").select("request_id", "rank", "id")))
    return out.select("request_id", F.col("rank").cast("long").alias("rank"), "id")

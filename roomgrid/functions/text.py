"""Scalar text helpers as Column expressions (JVM side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (reference semantics): listing ids in message text are the first run of
# eight or more hex digits or dashes; the sender channel prefix; the anonymous user.
ID_PATTERN = r"([0-9a-fA-F\-]{8,})"
CHANNEL_PREFIX = "whatsapp:"
ANON = "anon"
COMPOSE_SEPARATOR = " | "
COMPOSE_CAP = 16000   # default of ``compose_listing_text(cap=...)``: the embedding model's limit
COMPOSE_FIELDS = ["title", "description", "location", "property_type", "furnishing",
                  "utilities", "renovations"]


# The characters that Python's ``str.isspace`` accepts, as one regex class (the
# characters themselves, so that every engine reads the same class).
SPACE = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: all leading/trailing Unicode whitespace."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def split_ws(c: Column) -> Column:
    """Python ``str.split()`` of a stripped text."""
    return F.split(strip_ws(c), f"{SPACE}+")


def blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(f"[^{SPACE[1:]}"), F.lit(False))


def nonempty(c: Column) -> Column:
    """String truthiness: '' and null are absent."""
    return F.nullif(c, F.lit(""))


def num_str(c: Column) -> Column:
    """A float as Python prints it: '900.0', '15000000.0', '1.5e+16', '5e-05'."""
    d = c.cast("double")
    raw, size = d.cast("string"), F.abs(d)
    plain = F.regexp_replace(raw.cast("decimal(38,20)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.regexp_extract(raw, "E(-?\\d+)$", 1).cast("int")
    exponent = F.concat(F.regexp_replace(F.regexp_replace(raw, "E.*$", ""), "\\.0$", ""),
                        F.when(power < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(power)))
    return (F.when(F.isnan(d), "nan").when(size == float("inf"), F.when(d > 0, "inf").otherwise("-inf"))
            .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), exponent)
            .when((size >= 1e7) | ((size < 1e-3) & (size > 0)), plain).otherwise(raw))


def normalize_user_key(raw: Column) -> Column:
    """trim -> drop every channel prefix -> strip leading '+' -> add the channel prefix.
    An empty sender becomes the anonymous user (the reference's fallback, made reachable)."""
    core = F.regexp_replace(F.replace(strip_ws(raw), F.lit(CHANNEL_PREFIX), F.lit("")), r"^\++", "")
    return F.when(blank(raw), F.lit(ANON)) \
        .otherwise(F.concat(F.lit(CHANNEL_PREFIX), core))


def extract_listing_id(text: Column) -> Column:
    """First id-looking run in the text, or null (regexp_extract gives '' on no match)."""
    return F.nullif(F.regexp_extract(text, ID_PATTERN, 1), F.lit(""))


def tail_after(text: Column, token: Column) -> Column:
    """Text after the first occurrence of ``token``, whitespace-stripped ('' when the
    token ends the text)."""
    start = F.instr(text, token) + F.length(token)
    return strip_ws(F.call_function("substr", text, start))


def compose_listing_text(cols: dict[str, Column] | None = None, cap: int | None = COMPOSE_CAP) -> Column:
    """Embedding text of a listing: present fields in fixed order, then amenities, price
    and size, joined by ' | ', cut after ``cap`` characters (code points; None: never)."""
    c = cols or {}

    def col(n):
        return c.get(n, F.col(n))

    parts = [nonempty(col(n).cast("string")) for n in COMPOSE_FIELDS]
    amen = col("amenities")
    parts.append(F.when(F.size(amen) > 0, F.concat(F.lit("Amenities: "), F.array_join(amen, ", "))))
    price, size = col("price"), col("size_sqm")
    parts.append(F.when(price.isNotNull() & (price != 0), F.concat(F.lit("Price: "), num_str(price))))
    parts.append(F.when(size.isNotNull() & (size != 0),
                        F.concat(F.lit("Size: "), num_str(size), F.lit(" sqm"))))
    text = F.concat_ws(COMPOSE_SEPARATOR, *parts)
    return text if cap is None else F.substring(text, 1, cap)


def first_token(c: Column) -> Column:
    return F.element_at(split_ws(c), 1)

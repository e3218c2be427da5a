"""Text expressions of item and profile texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .literals import joined, name_in, per_text

REVIEW_CHARS, AUTHOR_CHARS, DESCRIPTION_CHARS, BROKEN_AUTHOR_CHARS = 500, 100, 200, 50


def item_text(name: Column, artist: Column) -> Column:
    """"name by artist", a missing artist being Unknown."""
    return F.concat(name, F.lit(" by "), F.coalesce(artist, F.lit("Unknown")))


def strip(text: Column) -> Column:
    """Without the white space, of any kind, at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def meta_text(title: Column, author: Column, description: Column) -> Column:
    """"title by author. description", missing parts being empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(part(title), F.lit(" by "), part(author), F.lit(". "), part(description))


def embedding_input(review: Column, title: Column, author: Column, description: Column) -> tuple[Column, Column]:
    """(text, source): a review that isn't blank, cut to 500 characters, else the metadata text."""
    use = ~is_blank(review)
    return (
        F.when(use, F.substring(review, 1, REVIEW_CHARS)).otherwise(meta_text(title, author, description)),
        F.when(use, F.lit("review")).otherwise(F.lit("metadata")),
    )


def author_name(raw: Column) -> Column:
    """The name of an author given as a JSON object, as the text of a Python dict, or as plain text; never evaluated.

    Malformed objects give their first 50 characters, plain text its first 100.
    """
    r = F.coalesce(raw, F.lit(""))
    return F.when(r.startswith("{"), per_text(name_in, BROKEN_AUTHOR_CHARS)(F.when(r.startswith("{"), r))).otherwise(F.substring(r, 1, AUTHOR_CHARS))


def description_text(raw: Column) -> Column:
    """A description given as a JSON list, as the text of a Python list, or as plain text: joined by spaces, cut to 200 characters; never evaluated."""
    r = F.coalesce(raw, F.lit(""))
    return F.when(r.startswith("["), per_text(joined, DESCRIPTION_CHARS)(F.when(r.startswith("["), r))).otherwise(F.substring(r, 1, DESCRIPTION_CHARS))


def try_epoch(ts: Column) -> Column:
    """Milliseconds given as digits; anything else is null and sorts last."""
    return F.when(ts.rlike("^[0-9]+$"), ts.try_cast("bigint"))


def time_order(ts: Column) -> Column:
    """What stamps are ordered by: digits as numbers, then any other text as text, then missing ones."""
    number = F.when(ts.rlike("^[0-9]+$"), ts.try_cast("decimal(38,0)"))
    return F.struct(F.when(number.isNotNull(), 0).when(ts.isNotNull(), 1).otherwise(2).alias("kind"), number.alias("number"), F.when(number.isNull(), ts).alias("text"))


def user_seed(user: Column) -> Column:
    """The first four bytes of the id's md5 as an unsigned big-endian number."""
    return F.conv(F.substring(F.md5(user.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_order(id_: Column) -> Column:
    return F.md5(id_.cast("string"))

"""From raw ratings, reviews and metadata to train and test rows with their texts, in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import interactions as I
from ..operators.ordinals import seeded_sample
from ..sources import intake, tables
from ..sources.shared import keep

RATINGS = tables.RATINGS
REVIEWS = tables.REVIEWS
PLACE = ("batch", "file", "line")
METADATA = tables.METADATA


@dataclass
class Prepared:
    """rows: user_id, item_id, split, rn, embedding_input, embedding_source; items: their metadata; tail: items with one train row; rejected: table, file, line, text of lines left out."""

    rows: DataFrame
    items: DataFrame
    tail: DataFrame
    rejected: DataFrame

    def part(self, name: str) -> DataFrame:
        return self.rows.where(F.col("split") == name).select("user_id", "item_id", "embedding_input", "embedding_source")

    def write(self, folder: str) -> None:
        for name in ("train", "test"):
            tables.write_csv(self.part(name), f"{folder}/{name}", ["user_id", "item_id"])
        tables.write_csv(self.items, f"{folder}/item_meta", ["item_id"])
        tables.write_csv(self.tail, f"{folder}/longtail_items", ["item_id"])


def first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in order of files and lines; one row a key and task is shuffled."""
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct(*PLACE)).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*")


def prepare(spark: SparkSession, raw: str, store: str, low: int = 20, high: int = 200, users: int | None = 2000, seed: int = 42, fraction: float = 0.2) -> Prepared:
    """raw holds the folders ratings (CSV), reviews and metadata (JSON lines), gz or not; store keeps what was read, so that a further call reads new files alone.

    Users with low to high different items; of those the `users` that the seeded generator draws from their sorted ids
    (None: all). Reviews of other pairs and metadata of other items are dropped by semi-joins before anything else.
    """
    key = F.col("parent_asin").alias("item_id")
    ratings = intake.take(spark, f"{raw}/ratings", f"{store}/ratings", "csv", RATINGS).select("user_id", key, "timestamp", *PLACE)
    reviews = intake.take(spark, f"{raw}/reviews", f"{store}/reviews", "jsonl", REVIEWS).select("user_id", key, "text", *PLACE)
    metadata = intake.take(spark, f"{raw}/metadata", f"{store}/metadata", "jsonl", METADATA).select(key, "title", "author", "description", *PLACE)
    pairs = first_rows(ratings.dropna(subset=["user_id", "item_id"]), ["user_id", "item_id"])
    chosen = I.filter_users(pairs.select("user_id", "item_id", T.time_order(F.col("timestamp")).alias("ts")), low, high)
    if users is not None:
        chosen = chosen.join(seeded_sample(chosen, "user_id", users, seed).select("user_id"), "user_id", "left_semi")
    split = keep(I.chrono_split(chosen, fraction))  # three uses
    texts = first_rows(reviews.join(split.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"), ["user_id", "item_id"]).select("user_id", "item_id", "text")
    wanted = split.select("item_id").distinct()
    known = first_rows(metadata.join(wanted, "item_id", "left_semi"), ["item_id"])
    items = wanted.join(known, "item_id", "left").select("item_id", F.coalesce("title", F.lit("")).alias("title"), T.author_name(F.col("author")).alias("author"), T.description_text(F.col("description")).alias("description"))
    body, source = T.embedding_input(F.col("text"), F.col("title"), F.col("author"), F.col("description"))
    rows = split.join(texts, ["user_id", "item_id"], "left").join(items, "item_id", "left")
    rows = rows.select("user_id", "item_id", "split", "rn", body.alias("embedding_input"), source.alias("embedding_source"))
    bad = None
    for name, schema in (("ratings", RATINGS), ("reviews", REVIEWS), ("metadata", METADATA)):
        part = intake.rejected(spark, f"{store}/{name}", schema).select(F.lit(name).alias("table"), "file", "line", "rejected")
        bad = part if bad is None else bad.unionByName(part)
    return Prepared(rows, items, I.long_tail(I.part(split, "train")), bad)

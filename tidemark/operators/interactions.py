"""From raw events to a chronological train and test split, the item popularity and the long tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hash_order

def _user() -> Window:
    return Window.partitionBy("user_id")


def dedup(events: DataFrame, order: list[str | Column]) -> DataFrame:
    """The first event of each (user_id, item_id) in the given order; rows without user or item are dropped."""
    w = Window.partitionBy("user_id", "item_id").orderBy(*order)
    return events.dropna(subset=["user_id", "item_id"]).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("user_id", "item_id", "ts")


def user_activity(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(F.count("item_id").alias("n"))


def filter_users(interactions: DataFrame, low: int, high: int) -> DataFrame:
    """Interactions of users with low to high of them, both included."""
    return interactions.withColumn("_n", F.count("item_id").over(_user())).where(F.col("_n").between(low, high)).drop("_n")


def sample_users(interactions: DataFrame, n: int) -> DataFrame:
    """Interactions of the n users that come first by the md5 of their id."""
    chosen = interactions.select("user_id").distinct().orderBy(hash_order(F.col("user_id")), "user_id").limit(n)
    return interactions.join(chosen, "user_id", "left_semi")


def chrono_split(interactions: DataFrame, fraction: float = 0.2) -> DataFrame:
    """interactions with rn (from 1, by time and item), n_train and split: the last max(1, round(fraction n)) of each user are test."""
    rn = F.row_number().over(_user().orderBy(F.col("ts").asc_nulls_last(), "item_id"))
    n = F.count(F.lit(1)).over(_user())
    df = interactions.withColumn("rn", rn).withColumn("_n", n).withColumn("n_train", F.col("_n") - F.greatest(F.lit(1), F.round(F.lit(fraction) * F.col("_n")).cast("int")))
    return df.withColumn("split", F.when(F.col("rn") <= F.col("n_train"), "train").otherwise("test")).drop("_n")


def part(split: DataFrame, name: str) -> DataFrame:
    return split.where(F.col("split") == name).drop("split")


def item_popularity(train: DataFrame) -> DataFrame:
    return train.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def long_tail(train: DataFrame) -> DataFrame:
    """Items that one user alone has in train."""
    return item_popularity(train).where("n = 1").select("item_id")


def boundary_check(split: DataFrame) -> DataFrame:
    """For each user whether no train event is later than a test event."""
    train, test = F.col("split") == "train", F.col("split") == "test"
    df = split.groupBy("user_id").agg(F.max(F.when(train, F.col("ts"))).alias("last_train"), F.min(F.when(test, F.col("ts"))).alias("first_test"))
    return df.select("user_id", F.coalesce(F.col("last_train") <= F.col("first_test"), F.lit(True)).alias("in_order"))


def eligible_users(split: DataFrame) -> DataFrame:
    """Users with both train and test rows."""
    return split.groupBy("user_id").agg(F.countDistinct("split").alias("n")).where("n = 2").select("user_id")

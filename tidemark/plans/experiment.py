"""The whole experiment: interactions -> split -> five systems -> recall tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import interactions as I
from ..operators import metrics as Q
from ..operators import recommend as R
from ..sources.shared import keep


@dataclass
class Experiment:
    """interactions (user_id, item_id, ts) and vectors (item_id, v), with the parameters of a run."""

    interactions: DataFrame
    vectors: DataFrame
    k: int = R.K
    m: int = R.M
    fraction: float = 0.2
    empty_profile: str = "none"

    @cached_property
    def split(self) -> DataFrame:
        """Written once, rows of a user together, so that what follows starts without the shuffles of the interactions."""
        return keep(I.chrono_split(self.interactions, self.fraction))

    @cached_property
    def train(self) -> DataFrame:
        return I.part(self.split, "train")

    @cached_property
    def test(self) -> DataFrame:
        return I.part(self.split, "test")

    @cached_property
    def tail(self) -> DataFrame:
        return I.long_tail(self.train)

    @cached_property
    def catalog(self) -> DataFrame:
        """Vectors of items that train or test holds."""
        known = R.of_items(self.split.select("item_id"), self.vectors).distinct()
        return R.of_catalog(self.vectors, known)

    def makers(self) -> dict[str, Callable[[], DataFrame]]:
        return {
            "Random": lambda: R.random_items(self.train, self.catalog, self.m),
            "Popularity": lambda: R.popularity(self.train, self.m),
            "ItemKNN": lambda: R.item_neighbours(self.train, self.m),
            "Content": lambda: R.content(self.train, self.catalog, self.m),
            "ActiveCentroid": lambda: R.active_centroid(self.train, self.catalog, self.m, self.k, empty_profile=self.empty_profile),
        }

    def lists(self) -> dict[str, DataFrame]:
        return {system: make() for system, make in self.makers().items()}

    def results(self) -> DataFrame:
        return Q.per_user(self.makers(), self.test, self.tail, I.eligible_users(self.split), self.m)

    def lift(self) -> DataFrame:
        return Q.lift(Q.summary(self.results()), self.catalog.count(), self.m)


def hash_embedding(docs: DataFrame, dims: int = 64) -> DataFrame:
    """doc_id, dim and value: counts of hashed lower-case tokens, L2-normalised. A stand-in for a sentence encoder, not one."""
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("w")).where("w <> ''")
    dim = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint"), F.lit(dims)).cast("int")
    counts = words.groupBy("doc_id", dim.alias("dim")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    length = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(length, "doc_id").select("doc_id", "dim", F.round(F.col("n") / F.col("length"), 6).alias("value"))

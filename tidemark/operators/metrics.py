"""Recall, long-tail recall, summaries, lift, ratios, coverage profiles and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep

SYSTEMS = ["Random", "Popularity", "ItemKNN", "Content", "ActiveCentroid"]


def per_user(lists: dict[str, DataFrame | Callable[[], DataFrame]], test: DataFrame, tail: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """user_id, system, recall and lt_recall (null where a user has no long-tail test item) for every user and system.

    lists: what each system returns, or a function that makes it. One system after another leaves its hits alone, so the disk that its
    lists took is free for the next.
    """
    spark = test.sparkSession
    flagged = keep(test.select("user_id", "item_id").distinct().join(tail.withColumn("lt", F.lit(1)), "item_id", "left").select("user_id", "item_id", "lt"))
    size = users.join(flagged.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("lt").alias("n_lt")), "user_id", "left")
    hits = None
    for system, df in lists.items():
        part = (df() if callable(df) else df).where(F.col("rank") <= k).select("user_id", "item_id").join(flagged, ["user_id", "item_id"])
        part = keep(part.groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"), F.count("lt").alias("lt_hits")).select(F.lit(system).alias("system"), "user_id", "hits", "lt_hits"))
        hits = part if hits is None else hits.unionByName(part)
    systems = spark.createDataFrame([(s,) for s in lists], "system string")
    grid = size.crossJoin(F.broadcast(systems)).join(hits, ["system", "user_id"], "left")
    hits, lt_hits = F.coalesce("hits", F.lit(0)), F.coalesce("lt_hits", F.lit(0))
    return grid.select(
        "user_id", "system", F.coalesce(F.try_divide(hits.cast("double"), F.col("n")), F.lit(0.0)).alias("recall"), F.try_divide(lt_hits.cast("double"), F.nullif(F.col("n_lt"), F.lit(0))).alias("lt_recall")
    )


def summary(results: DataFrame) -> DataFrame:
    """For each system the mean recalls (missing ones left out), users, eligible users and users with hits."""
    return results.groupBy("system").agg(
        F.avg("recall").alias("recall"),
        F.avg("lt_recall").alias("lt_recall"),
        F.count(F.lit(1)).alias("n_users"),
        F.count("lt_recall").alias("n_eligible"),
        F.count_if(F.col("recall") > 0).alias("n_hit"),
        F.count_if(F.col("lt_recall") > 0).alias("n_lt_hit"),
    )


def lift(table: DataFrame, catalog_size: int, m: int = 10, base: str = "Random", content: str = "Content") -> DataFrame:
    """summary() with the lift over the base system's mean, over chance (m / catalog size), and the long-tail ratio to the content system."""
    one = table.agg(F.max(F.when(F.col("system") == base, F.col("recall"))).alias("_base"), F.max(F.when(F.col("system") == content, F.col("lt_recall"))).alias("_content"))
    return table.crossJoin(F.broadcast(one)).select(
        "system",
        "recall",
        "lt_recall",
        F.try_divide("recall", F.nullif("_base", F.lit(0.0))).alias("lift_empirical"),
        F.try_divide(F.col("recall"), F.lit(m / catalog_size if catalog_size else None).cast("double")).alias("lift_theoretical"),
        F.try_divide("lt_recall", F.nullif("_content", F.lit(0.0))).alias("lt_content_ratio"),
    )


def delta(first: DataFrame, second: DataFrame) -> DataFrame:
    """Change of the mean recalls from one summary to another."""
    b = second.select("system", F.col("recall").alias("_r"), F.col("lt_recall").alias("_l"))
    return first.join(b, "system").select("system", (F.col("_r") - F.col("recall")).alias("recall_delta"), (F.col("_l") - F.col("lt_recall")).alias("lt_recall_delta"))


def ordered(table: DataFrame, better: list[str], metric: str = "recall") -> DataFrame:
    """One row: whether the metric falls along the systems in `better`."""
    value = [F.max(F.when(F.col("system") == s, F.col(metric))) for s in better]
    test = F.lit(True)
    for a, b in zip(value, value[1:]):
        test = test & (a > b)
    return table.agg(F.coalesce(test, F.lit(False)).alias("in_order"))


def gate(table: DataFrame, expected: dict[str, tuple[float, float]], tolerance: float = 2e-4) -> None:
    """Stop if a system's mean recalls are not the expected ones."""
    found = {r["system"]: (r["recall"], r["lt_recall"]) for r in table.where(F.col("system").isin(list(expected))).collect()}
    for system, want in expected.items():
        have = found.get(system)
        if have is None or any(h is None or abs(h - w) > tolerance for h, w in zip(have, want)):
            raise ValueError(f"{system}: {have} instead of {want}")


def join_coverage(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of base, and the percentage that each part, and all parts together, cover."""
    df = base.select(key)
    for name, p in parts.items():
        df = df.join(p.select(key).distinct().withColumn(f"has_{name}", F.lit(True)), key, "left")
    has = {n: F.col(f"has_{n}").isNotNull() for n in parts}
    every = F.lit(True)
    for h in has.values():
        every = every & h
    share = lambda c: F.round(100 * F.avg(c.cast("int")), 6)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *(share(h).alias(f"pct_{n}") for n, h in has.items()), share(every).alias("pct_all"))


def overlap_profile(train: DataFrame, test: DataFrame, vectors: DataFrame, tail: DataFrame) -> DataFrame:
    """One row of set sizes: items of train, test, vectors and tail, and how they overlap."""
    flag = lambda df, c: df.select("item_id").distinct().withColumn(c, F.lit(1))
    df = flag(train, "a").join(flag(test, "b"), "item_id", "full").join(flag(vectors, "e"), "item_id", "full").join(flag(tail, "t"), "item_id", "full")
    both = lambda x, y: F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
    return df.agg(
        F.count("a").alias("train_items"), F.count("b").alias("test_items"), F.count("e").alias("vector_items"), F.count("t").alias("tail_items"),
        both("a", "b").alias("train_test"), both("a", "e").alias("train_vector"), both("b", "e").alias("test_vector"), both("b", "t").alias("test_tail"), both("t", "e").alias("tail_vector"),
    )


def data_profile(split: DataFrame, tail: DataFrame) -> DataFrame:
    """One row: users, items, rows of both parts, rows a user, and the long-tail share of the train items."""
    train = F.col("split") == "train"
    one = split.agg(
        F.countDistinct("user_id").alias("n_users"), F.countDistinct("item_id").alias("n_items"), F.countDistinct(F.when(train, F.col("item_id"))).alias("n_train_items"),
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"),
    )
    return one.crossJoin(tail.agg(F.count(F.lit(1)).alias("n_tail"))).select(
        "*", F.round((F.col("n_train") + F.col("n_test")) / F.col("n_users"), 6).alias("rows_a_user"), F.round(100 * F.col("n_tail") / F.col("n_train_items"), 6).alias("pct_tail")
    )


CI = "system string, metric string, mean double, low double, high double, n long"
METRICS = ("recall", "lt_recall")


def bootstrap_shared(results: DataFrame, systems: list[str], n_boot: int = 10_000, seed: int = 42) -> DataFrame:
    """Percentile intervals of the mean with one generator for all, drawn in order of systems, recall before long-tail recall, users sorted as text.

    The one generator makes this a single task, for published figures of bounded size; see bootstrap().
    """

    def run(table):
        df = table.to_pandas()
        df["user_id"] = df["user_id"].astype(str)
        rng, out = np.random.default_rng(seed), []
        for system in systems:
            rows = df[df["system"] == system].sort_values("user_id")
            for metric in ("recall", "lt_recall"):
                x = rows[metric].dropna().to_numpy(float)
                if len(x):
                    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(n_boot)])
                    out.append((system, metric, x.mean(), *np.percentile(means, [2.5, 97.5]), len(x)))
        columns = list(zip(*out)) if out else [[]] * 6
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("system", "metric", "mean", "low", "high", "n"), columns, (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))})

    return results.select("user_id", "system", "recall", "lt_recall", F.lit(1).alias("_one")).groupBy("_one").applyInArrow(run, CI)


#: Multipliers of the weights' hash, below 2^31 so that products with 32 bits fit a signed number of 64 (fixed values of these resamples).
MIX = (1540483477, 741103597, 1274126177)
WORD = (1 << 32) - 1


def poisson_steps() -> list[int]:
    """Numbers of 32 bits from which a uniform one stands for a Poisson value of mean 1 above 0, above 1, ..."""
    steps, term, total = [], math.exp(-1), 0.0
    for k in range(1, 14):
        total += term
        term /= k
        steps.append(math.floor(total * 2**32))
    return steps


def poisson_weights(a: np.ndarray, b: np.ndarray, n_boot: int) -> np.ndarray:
    """(users, replicas) weights, hashed from two 32-bit keys of each user and the replica's number."""
    y = (np.arange(n_boot, dtype=np.int64)[None, :] * MIX[0] + a[:, None]) & WORD
    y = ((y ^ (y >> 15)) * MIX[1]) & WORD
    y = ((y ^ (y >> 13) ^ b[:, None]) * MIX[2]) & WORD
    return np.searchsorted(np.array(poisson_steps()), (y ^ (y >> 16)).ravel(), "right").reshape(y.shape).astype(float)


def bootstrap(results: DataFrame, n_boot: int = 10_000, seed: int = 42, systems: list[str] | None = None) -> DataFrame:
    """Percentile intervals of the mean in one pass: place, system, metric, mean, low, high, n (users with a value) and hits (values above 0).

    Each user has a Poisson weight of mean 1 in every replica, hashed from both, the same for all systems and metrics. Tasks add weighted
    sums of all replicas, which merge; a replica's mean is its weighted mean. systems: in the order of the result (those found, by name).
    """
    if systems is None:
        systems = sorted(r["system"] for r in results.select("system").distinct().collect())
    cells = [(s, m) for s in systems for m in METRICS]
    wide = results.groupBy("user_id").agg(*(F.max(F.when(F.col("system") == s, F.col(m))).alias(f"x{i}") for i, (s, m) in enumerate(cells)))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string")))
    number = lambda i: F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("bigint")
    columns = [f"{kind}{i}" for kind in "swh" for i in range(len(cells))]

    def run(batches):
        total, plain = None, 0  # plain: every user once, and the values above 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                x = np.column_stack([part.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(cells))])
                known = ~np.isnan(x)
                w = poisson_weights(part.column("a").to_numpy(), part.column("b").to_numpy(), n_boot)
                both = np.hstack([np.where(known, x, 0), known])
                total = w.T @ both + (0 if total is None else total)
                plain = plain + np.concatenate([both.sum(axis=0), (np.where(known, x, 0) > 0).sum(axis=0)])
        if total is not None:
            every = np.vstack([plain, np.hstack([total, np.zeros((n_boot, len(cells)))])])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n_boot, dtype=np.int32)), *(pa.array(c) for c in every.T)], names=["replica", *columns])

    partial = wide.select(number(0).alias("a"), number(1).alias("b"), *(f"x{i}" for i in range(len(cells)))).mapInArrow(run, "replica int, " + ", ".join(f"{c} double" for c in columns))
    merged = partial.groupBy("replica").agg(*(F.sum(c).alias(c) for c in columns))
    mean = lambda i: F.try_divide(f"s{i}", F.nullif(F.col(f"w{i}"), F.lit(0.0)))
    real = lambda c: F.max(F.when(F.col("replica") < 0, c))
    ends = lambda i: F.percentile(F.when(F.col("replica") >= 0, mean(i)), F.array(F.lit(0.025), F.lit(0.975)))
    found = merged.agg(*(x for i in range(len(cells)) for x in (ends(i).alias(f"e{i}"), real(mean(i)).alias(f"m{i}"), real(F.col(f"w{i}")).alias(f"n{i}"), real(F.col(f"h{i}")).alias(f"h{i}"))))
    row = lambda i, s, m: F.struct(F.lit(i).alias("place"), F.lit(s).alias("system"), F.lit(m).alias("metric"), F.col(f"m{i}").alias("mean"), F.col(f"e{i}")[0].alias("low"), F.col(f"e{i}")[1].alias("high"), F.col(f"n{i}").cast("bigint").alias("n"), F.col(f"h{i}").cast("bigint").alias("hits"))
    return found.select(F.inline(F.array(*(row(i, s, m) for i, (s, m) in enumerate(cells))))).where("n > 0")

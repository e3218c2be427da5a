"""Places of rows in a global order, and samples that are drawn as places."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialise


def ordinals(ids: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The distinct values of a column with `at`, their place from 0 in rising order, and their number.

    Values are dealt by range; each range is numbered by itself and moved by the sizes of the ranges before it, of which
    the driver gets one number each. Nulls are left out.
    """
    values = ids.select(column).where(F.col(column).isNotNull()).distinct()
    dealt = materialise(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))  # ranges are found by sampling: kept, so that both uses see the same
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, start = 0, []
    for part, n in sorted(sizes.items()):
        start.append((part, before))
        before += n
    moved = F.broadcast(dealt.sparkSession.createDataFrame(start, "_part int, _start bigint"))  # a row for each range
    at = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1 + F.col("_start")
    return dealt.join(moved, "_part").select(column, at.cast("bigint").alias("at")), before


def seeded_sample(ids: DataFrame, column: str, n: int, seed: int = 42) -> DataFrame:
    """The values that ``random.Random(seed).sample(sorted(values), n)`` draws, with `draw`, their place in its list; all, if there are fewer.

    Only the n places that the generator draws are on the driver.
    """
    placed, count = ordinals(ids, column)
    drawn = random.Random(seed).sample(range(count), min(n, count))
    places = ids.sparkSession.createDataFrame(list(zip(drawn, range(len(drawn)))), "at bigint, draw int")
    return placed.join(F.broadcast(places) if n <= 100_000 else places, "at").select(column, "draw")


#: Odd multipliers of the round function, below 2^31 so that products with 32 bits fit a signed number of 64 (fixed values of this permutation).
ROUNDS = ((1540483477, 15), (741103597, 13), (1274126177, 16), (668265263, 14))


def half_bits(n: int) -> int:
    """Bits of each half of the permuted numbers: the least with 4^bits >= n."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def permuted(x: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """A permutation of 0..n-1 for each row of four 32-bit keys: a Feistel network over 4^half_bits(n) numbers, walked until a number is below n."""
    bits = half_bits(n)
    mask, word = (1 << bits) - 1, (1 << 32) - 1
    x = x.astype(np.int64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right, own = x[todo] >> bits, x[todo] & mask, keys[todo]
        for r, (factor, shift) in enumerate(ROUNDS):
            y = ((right ^ own[:, r]) * factor) & word
            y = ((y ^ (y >> shift)) * ROUNDS[r - 1][0]) & word
            left, right = right, left ^ ((y ^ (y >> 16)) & mask)
        x[todo] = (left << bits) | right
        todo = todo[x[todo] >= n]
    return x


def drawn_places(seen: DataFrame, count: int, m: int) -> DataFrame:
    """user_id, at and rank: the first m places, in the order of the user's own permutation, that `taken` (an array of places) doesn't hold.

    m + (places taken) draws are enough for a user, whatever the number of places is.
    """
    user = seen.schema["user_id"].dataType.simpleString()
    digest = F.md5(F.col("user_id").cast("string"))
    keys = F.array(*(F.conv(F.substring(digest, 1 + 8 * r, 8), 16, 10).cast("bigint") for r in range(4)))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                taken = part.column("taken").to_pylist()
                n = np.minimum(count, m + np.array([len(t) for t in taken], np.int64))
                which = np.repeat(np.arange(len(n)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.array(part.column("keys").to_pylist(), np.int64).reshape(-1, 4)
                at = permuted(step, own[which], count)
                flat = np.array([p for t in taken for p in t], np.int64)
                held = np.repeat(np.arange(len(taken)), [len(t) for t in taken])
                free = ~np.isin(which * max(count, 1) + at, held * max(count, 1) + flat)
                which, at = which[free], at[free]
                first = np.searchsorted(which, which)
                rank = np.arange(len(which)) - first + 1
                keep = rank <= m
                yield pa.RecordBatch.from_arrays([part.column("user_id").take(pa.array(which[keep])), pa.array(at[keep]), pa.array(rank[keep].astype(np.int32))], names=["user_id", "at", "rank"])

    return seen.select("user_id", "taken", keys.alias("keys")).mapInArrow(run, f"user_id {user}, at bigint, rank int")

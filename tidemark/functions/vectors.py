"""Expressions over array<double> columns, and Arrow batches of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to the denominator of a cosine and to a norm that divides a vector.
EPS = 1e-8
#: Digits to which scores are rounded before they are ranked.
DIGITS = 6


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def normalise(v: Column) -> Column:
    return F.transform(v, lambda x: x / (norm(v) + EPS))


#: Keys whose sums a task holds before it passes them on.
HELD_KEYS = 10_000


def mean_vector(df: DataFrame, keys: list[str], vector: str = "v", out: str = "v") -> DataFrame:
    """The mean vector of each key: tasks add up whole vectors, so a key's shuffle is a vector for each task that met it.

    The second round adds the tasks' sums, and is done by key in a stream too.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    small = df.select(*keys, vector).withColumnRenamed(vector, "_sum").withColumn("_n", F.lit(1).cast("bigint"))
    partial = small.mapInArrow(_summed(keys, False), f"{kinds}, _sum array<double>, _n bigint")
    dealt = partial.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_summed(keys, True), f"{kinds}, _sum array<double>, _n bigint").select(*keys, F.transform("_sum", lambda x: x / F.col("_n")).alias(out))


def _summed(keys: list[str], last: bool):
    """Sums of vectors by key; last: rows come sorted by key, and a key is passed on whole when the next one comes."""

    def run(batches):
        held: dict = {}
        types: list = []

        def out(some):
            columns = [pa.array([k[i] for k in some], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([held[k][0].tolist() for k in some], pa.list_(pa.float64())), pa.array([held[k][1] for k in some], pa.int64())], names=[*keys, "_sum", "_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(k).type for k in keys]
            named = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            x, n = matrix(batch.column("_sum")), batch.column("_n").to_numpy()
            number: dict = {}
            which = np.array([number.setdefault(k, len(number)) for k in named])
            order = np.argsort(which, kind="stable")
            first = np.searchsorted(which[order], np.arange(len(number)))
            sums, counts = np.add.reduceat(x[order], first, axis=0), np.add.reduceat(n[order], first)
            for k, i in number.items():
                if k in held:
                    held[k] = (held[k][0] + sums[i], held[k][1] + int(counts[i]))
                else:
                    held[k] = (sums[i], int(counts[i]))
            done = [k for k in held if k != named[-1]] if last else list(held) if len(held) > HELD_KEYS else []
            if done:
                yield out(done)
                for k in done:
                    del held[k]
        if held:
            yield out(list(held))

    return run


def matrix(column) -> np.ndarray:
    """(rows, dimensions) of an Arrow list column whose lists have one length."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)

"""Stage tables in buckets, and histories that no task holds."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import interactions as I
from tidemark.operators import recommend as R
from tidemark.plans import queries
from tidemark.sources import stages


def table(spark, path, rows):
    spark.createDataFrame(rows, "user_id long, item_id long, ts long").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_versions_follow_inputs_and_parameters(spark, tmp_path):
    raw, base, made = str(tmp_path / "raw"), str(tmp_path / "stages"), []

    def stage(df, **more):
        return stages.bucketed(spark, base, "s", [df], lambda: made.append(1) or df, ["user_id"], ["ts"], 4, **more).orderBy("user_id", "item_id").collect()

    one = table(spark, raw, [(u, i, u * i) for u in range(9) for i in range(5)])
    rows = stage(one, low=1)
    assert len(rows) == 45 and stage(one, low=1) == rows and len(made) == 1
    assert stage(one, low=2) == rows and len(made) == 2  # a parameter changed
    assert stage(one, low=1) == rows and len(made) == 2  # the first version is still there
    two = table(spark, raw, [(1, 1, 1)])
    assert len(stage(two, low=1)) == 1 and len(made) == 3  # the input changed


def test_a_broken_stage_is_made_again(spark, tmp_path):
    df, base = table(spark, str(tmp_path / "raw"), [(1, 2, 3)]), str(tmp_path / "stages")
    args = (spark, base, "broken", [df], lambda: df, ["user_id"], ["ts"], 2)
    stages.bucketed(*args)
    version = stages.fingerprint(spark, [df], {"keys": ["user_id"], "order": ["ts"], "buckets": 2})
    (tmp_path / "stages" / "broken" / version / stages.MANIFEST).unlink()
    (tmp_path / "stages" / "broken" / version / "half.parquet").write_bytes(b"x")
    assert stages.bucketed(*args).count() == 1 and stages.read_manifest(spark, f"{base}/broken/{version}")["buckets"] == 2


def test_no_shuffle_behind_a_stage(spark, tmp_path):
    """Split, anti-join of seen items and hits of staged tables by user: no Exchange."""
    rows = [(u, i, (u * i) % 7) for u in range(20) for i in range(12)]
    one, base = table(spark, str(tmp_path / "raw"), rows), str(tmp_path / "stages")
    stage = lambda name, df: stages.bucketed(spark, base, name, [df], lambda: df, ["user_id"], ["ts", "item_id"], 4)
    log = stage("log", one)
    split = I.chrono_split(I.filter_users(I.dedup(log, ["ts"]), 2, 100))
    lists = stage("lists", table(spark, str(tmp_path / "lists"), [(u, i, 0) for u in range(20) for i in range(5, 20)]))
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition"):
        spark.conf.set(name, "-1" if "auto" in name else "false")
    try:
        train, test = I.part(split, "train"), I.part(split, "test")
        new = lists.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        hits = new.join(test.select("user_id", "item_id"), ["user_id", "item_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
        found = {r["user_id"]: r["hits"] for r in hits.collect()}
        assert found and all(n <= 2 for n in found.values())
        for df in (split, hits):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition"):
            spark.conf.unset(name)


def near(a, b):
    a, b = ({(r["user_id"], r["cluster"]): r["v"] for r in df.collect()} for df in (a, b))
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_spread_histories_equal_grouped_ones(spark, sf_dir):
    e = queries.on_events(spark, sf_dir)
    plain = R.centroids(e.train, e.catalog)
    assert near(plain, R.centroids(e.train, e.catalog, heavy=0))  # all are heavy
    sizes = sorted(r["n_train"] for r in e.train.select("user_id", "n_train").distinct().collect())
    assert near(plain, R.centroids(e.train, e.catalog, heavy=sizes[len(sizes) // 2]))  # some are
    spark.catalog.clearCache()


@pytest.mark.parametrize("init", ["farthest", "kmeans++"])
def test_spread_histories_with_ties_and_few_vectors(spark, init):
    rng = np.random.default_rng(3)
    rows = [(1, i, i, [float(i % 2), 1.0]) for i in range(8)] + [(2, i, i, [1.0, 1.0]) for i in range(5)] + [(3, 1, 1, [1.0, 2.0])]
    rows += [(4, i, i, (np.array([10.0, 0.0]) * (i % 3) + rng.normal(size=2) * 0.01).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rn int, v array<double>").withColumn("n_train", F.lit(99))
    got = R.spread_centroids(df, 3, init)
    if init == "farthest":
        assert near(got, R._grouped_centroids(df, 3, init))
    found = {r["user_id"]: [] for r in got.collect()}
    for r in got.collect():
        found[r["user_id"]].append(r["v"])
    assert set(found) == {1, 2, 4} and all(len(v) == 3 for v in found.values())
    if init == "farthest":
        assert sorted(round(v[0]) for v in found[4]) == [0, 10, 20]

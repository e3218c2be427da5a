"""Cells, neighbour products, keyed samples, ordinals and sums: equal to plain versions, whatever the skew."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.vectors import mean_vector
from tidemark.operators import blocks as B
from tidemark.operators import metrics as Q
from tidemark.operators import ordinals as O
from tidemark.operators import recommend as R
from tidemark.plans.queries import QUERIES


def train_of(spark, pairs):
    return spark.createDataFrame(pairs, "user_id long, item_id long")


def listed(df):
    return sorted((r["user_id"], r["rank"], r["item_id"], r["score"]) for r in df.collect())


def clustered(spark, rng, items=300, users=40):
    """Items in tight groups of directions, and users near one group each."""
    centres = rng.normal(size=(6, 16)) * 3
    x = centres[np.arange(items) % 6] + rng.normal(size=(items, 16)) * 0.05
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, v array<double>")
    asked = spark.createDataFrame([(u, (centres[u % 6] + rng.normal(size=16) * 0.02).tolist()) for u in range(users)], "user_id long, v array<double>")
    return vectors, asked


def test_cells_give_the_plain_result_and_rule_cells_out(spark):
    vectors, asked = clustered(spark, np.random.default_rng(1))
    train = train_of(spark, [(u, (7 * u + k) % 300) for u in range(40) for k in range(20)])
    got = R.nearest_items(asked, train, vectors, 5, cell=20)
    assert listed(got) == listed(R.nearest_items_plain(asked, train, vectors, 5))
    cells = B.Cells(vectors, 20)
    assert cells.count >= 15
    least = R.nearest_items_plain(asked, train, vectors, 5).groupBy("user_id").agg(F.min("score").alias("least"))
    further = cells.others(asked.join(least, "user_id")).count()
    assert further < 40 * (cells.count - 1) / 2  # the cells of other directions
    assert cells.others(asked.withColumn("least", F.lit(None).cast("double"))).count() == 40 * (cells.count - 1)  # without a bound all of them


def test_cells_with_repeated_zero_and_few_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(i, [0.0, 0.0]) for i in range(30, 40)] + [(40, [2.0, -1.0]), (41, [-1.0, -2.0])]
    vectors = spark.createDataFrame(rows, "item_id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [-1.0, -2.0])], "user_id long, v array<double>")
    train = train_of(spark, [(u, i) for u in (1, 2, 3) for i in range(0, 25)])
    for cell in (4, 10_000):
        assert listed(R.nearest_items(asked, train, vectors, 12, cell=cell)) == listed(R.nearest_items_plain(asked, train, vectors, 12))


@pytest.mark.parametrize("sizes", [(16_384, 1024, 200_000, 1 << 20), (5, 4, 6, 8)])
def test_neighbours_with_an_item_that_all_have(spark, monkeypatch, sizes):
    for name, value in zip(("USER_BLOCK", "ITEM_BLOCK", "PIECE", "ADDED"), sizes):
        monkeypatch.setattr(B, name, value)
    rng = np.random.default_rng(4)
    a = (rng.random((30, 25)) < 0.2).astype(float)
    a[:, 3] = 1
    norm = a / np.maximum(np.sqrt(a.sum(axis=0)), 1e-9)
    score = np.round(a @ (norm.T @ norm - np.diag(np.diag(norm.T @ norm))), 6)
    known = np.flatnonzero(a.sum(axis=0))
    want = []
    for u in range(30):
        unseen = [i for i in known if not a[u, i]]
        unseen.sort(key=lambda i: (-score[u, i], i))
        want += [(u, r + 1, int(i), score[u, i]) for r, i in enumerate(unseen[:6])]
    got = listed(R.item_neighbours(train_of(spark, [(u, i) for u, i in zip(*(x.tolist() for x in np.nonzero(a)))]), 6))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)


def test_neighbours_by_text_ids_and_fill(spark):
    train = train_of(spark, [(1, 1), (1, 2), (2, 2), (2, 3)]).withColumn("item_id", F.concat(F.lit("i"), F.col("item_id").cast("string")))
    catalog = spark.createDataFrame([(f"i{k}",) for k in (0, 1, 8, 9)], "item_id string")
    got = listed(R.item_neighbours(train, 4, catalog))
    assert [(g[0], g[2]) for g in got] == [(1, "i3"), (1, "i0"), (1, "i8"), (1, "i9"), (2, "i1"), (2, "i0"), (2, "i8"), (2, "i9")]


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation_holds_every_place_once(n):
    keys = np.random.default_rng(n).integers(0, 1 << 32, (3, 4))
    for k in keys:
        assert sorted(O.permuted(np.arange(n), np.repeat(k[None], n, axis=0), n).tolist()) == list(range(n))


def test_random_items_are_uniform_and_unseen(spark):
    catalog = spark.createDataFrame([(3 * i,) for i in range(50)], "item_id long")
    train = train_of(spark, [(u, 3 * k) for u in range(2000) for k in (u % 50, 7)])
    got = R.random_items(train, catalog, 5)
    assert got.join(train, ["user_id", "item_id"]).count() == 0
    rows = got.toPandas()
    assert (rows.groupby("user_id").size() == 5).all()
    for rank in (1, 5):
        n = rows[rows["rank"] == rank].groupby("item_id").size().reindex([3 * i for i in range(50)], fill_value=0)
        free = n.drop(21)  # all have seen 7
        assert n[21] == 0 and ((free - 2000 / 49) ** 2 / (2000 / 49)).sum() < 100  # 48 degrees of freedom
    some = spark.createDataFrame([(1, i) for i in range(49)], "user_id long, item_id long")
    few = spark.createDataFrame([(i,) for i in range(50)], "item_id long")
    assert [r["item_id"] for r in R.random_items(some, few, 5).collect()] == [49]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ordinals_and_seeded_samples(spark, kind):
    ids = list({random.Random(9).randrange(10**6) for _ in range(700)}) + [x for x in range(500)]
    ids = [f"u{i}" for i in ids] if kind == "string" else ids
    df = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], f"user_id {kind}").repartition(7)
    placed, n = O.ordinals(df, "user_id")
    assert [r["user_id"] for r in placed.orderBy("at").collect()] == sorted(set(ids)) and n == len(set(ids))
    assert [r["at"] for r in placed.orderBy("at").collect()] == list(range(n))
    drawn = O.seeded_sample(df, "user_id", 40, 42).orderBy("draw").collect()
    assert [r["user_id"] for r in drawn] == random.Random(42).sample(sorted(set(ids)), 40)
    assert O.seeded_sample(df, "user_id", 10**6).count() == n and O.seeded_sample(df.limit(0), "user_id", 3).count() == 0


def test_mean_vectors_of_a_hot_key(spark, monkeypatch):
    from tidemark.functions import vectors

    monkeypatch.setattr(vectors, "HELD_KEYS", 3)
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"k{i % 40}", i % 2, rng.normal(size=5).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "a string, b int, v array<double>").repartition(9)
    got = {(r["a"], r["b"]): r["v"] for r in mean_vector(df, ["a", "b"]).collect()}
    keys = {r[:2] for r in rows}
    assert set(got) == keys
    for k in keys:
        assert np.allclose(got[k], np.mean([r[2] for r in rows if r[:2] == k], axis=0))


def test_poisson_weights_and_merged_sums(spark):
    a, b = np.random.default_rng(1).integers(0, 1 << 32, (2, 3000))
    w = Q.poisson_weights(a, b, 200)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1
    rows = spark.createDataFrame([(u, s, float((u * k) % 7 < 2), None if u % 3 else float(u % 2)) for u in range(300) for k, s in ((1, "A"), (3, "B"))], "user_id long, system string, recall double, lt_recall double")
    one, many = ([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in Q.bootstrap(rows.repartition(p), 500).orderBy("place").collect()] for p in (1, 5))
    assert one == many and [r[:3] for r in one] == [(0, "A", "recall"), (1, "A", "lt_recall"), (2, "B", "recall"), (3, "B", "lt_recall")]
    assert one[1][6] == 100 and one[1][7] == 50


def test_the_long_tail_queries_have_a_long_tail(spark, sf_dir):
    rows = {r["system"]: r for r in QUERIES["tail_system_summary"](spark, sf_dir).collect()}
    assert all(r["n_eligible"] > 50 and r["lt_recall"] is not None for r in rows.values()) and sum(r["n_lt_hit"] for r in rows.values()) > 0
    assert QUERIES["tail_items"](spark, sf_dir).count() > 100
    assert QUERIES["tail_data_profile"](spark, sf_dir).first()["pct_tail"] > 5
    spark.catalog.clearCache()


@pytest.mark.parametrize("text", [False, True])
def test_neighbours_from_met_histories(spark, text):
    """Groups of users with items of their own: a block meets the histories of its groups alone, and lists are those of the blocked product."""
    rng = np.random.default_rng(9)
    pairs = [(int(u), int(100 * (u // 20) + i)) for u in range(400) for i in rng.choice(60, 6, replace=False)] + [(400, 5000), (401, 5001), (401, 5002)]
    train = train_of(spark, pairs)
    if text:
        train = train.select(F.format_string("u%05d", "user_id").alias("user_id"), F.format_string("i%05d", "item_id").alias("item_id"))
    near = B.met_histories(train)
    assert near.where("own").count() == 402 and near.count() < 3 * 402
    got = listed(R.ranked(B.met_products(train, near, 10), 10))
    assert got == listed(R.ranked(B.product_blocks(train, 10), 10)) and len(got) == 4020


def test_many_met_histories_take_the_blocked_product(spark, monkeypatch):
    train = train_of(spark, [(u, i) for u in range(40) for i in range(u % 7, 12)])
    assert B.met_histories(train) is not None
    monkeypatch.setattr(B, "BLOCK_PAIRS", 100)
    assert B.met_histories(train) is None
    monkeypatch.setattr(B, "CO_USERS", 1)
    assert B.met_histories(train) is None and len(listed(R.item_neighbours(train))) > 0


@pytest.mark.parametrize("cell", [4, 1000])
def test_items_of_one_vector_are_compared_once(spark, cell):
    """300 items of 10 vectors: lists are the plain ones, whatever users have seen of a vector's items."""
    x = np.random.default_rng(10).normal(size=(10, 4))
    vectors = spark.createDataFrame([(i, x[i % 10].tolist()) for i in range(300)], "item_id long, v array<double>")
    asked = spark.createDataFrame([(u, (x[u % 10] + 0.1).tolist()) for u in range(12)], "user_id long, v array<double>")
    train = train_of(spark, [(u, i) for u in range(12) for i in range(u % 10, 300, 10)[: 3 * u]] + [(5, i) for i in range(0, 300, 7)])
    assert listed(R.nearest_items(asked, train, vectors, 10, cell)) == listed(R.nearest_items_plain(asked, train, vectors, 10))


def test_neighbours_of_many_items_with_few_users(spark):
    """More items in a block than a user has sums: the same lists."""
    rng = np.random.default_rng(11)
    train = train_of(spark, sorted({(int(u), int(i)) for u in range(300) for i in rng.choice(5000, 5)}))
    got = listed(R.ranked(B.met_products(train, B.met_histories(train), 10), 10))
    assert got == listed(R.ranked(B.product_blocks(train, 10), 10)) and len(got) == 3000


def test_met_histories_shuffle_pairs_once(spark, monkeypatch):
    """Pairs become histories in one shuffle; after it no shuffle has a row for each user and item. Repeated pairs count once."""
    kept, keep = [], B.keep
    monkeypatch.setattr(B, "keep", lambda df: (kept.append(df._jdf.queryExecution().executedPlan().toString()), keep(df))[1])
    train = train_of(spark, [(u, 100 * (u // 20) + (7 * u + 3 * k) % 60) for u in range(200) for k in range(6)])
    near = B.met_histories(train.unionByName(train))
    shuffles = [x for plan in kept for x in plan.splitlines() if "Exchange" in x]
    assert sum("rangepartitioning" in x for x in shuffles) == 1 and not any("hashpartitioning(user_id" in x or "hashpartitioning(user_id#" in x for x in shuffles)
    got = listed(R.ranked(B.met_products(train, near, 10), 10))
    assert got == listed(R.ranked(B.product_blocks(train, 10), 10)) and len(got) == 2000

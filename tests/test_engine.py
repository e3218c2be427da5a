"""Semantics that the tables don't show: ties, gaps, fallbacks, edge rows."""

from __future__ import annotations

import datetime as dt
import gzip
import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import interactions as I
from tidemark.operators import metrics as Q
from tidemark.operators import recommend as R
from tidemark.plans import queries
from tidemark.sources import tables as S

DAY = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(u, i, DAY + dt.timedelta(days=d)) for u, i, d in rows], "user_id long, item_id long, ts timestamp_ntz")


def train_of(spark, rows):
    return I.part(I.chrono_split(log(spark, rows), 1e-9), "train")


def test_dedup_keeps_the_earliest_and_drops_missing(spark):
    df = log(spark, [(1, 5, 3), (1, 5, 1), (1, None, 0), (None, 5, 0)])
    assert [r["ts"] for r in I.dedup(df, ["ts"]).collect()] == [DAY + dt.timedelta(days=1)]


@pytest.mark.parametrize("n,kept", [(19, 0), (20, 20), (200, 200), (201, 0)])
def test_user_range_is_inclusive(spark, n, kept):
    assert I.filter_users(log(spark, [(1, i, i) for i in range(n)]), 20, 200).count() == kept


@pytest.mark.parametrize("n,test", [(1, 1), (2, 1), (3, 1), (7, 1), (8, 2), (10, 2)])
def test_split_size(spark, n, test):
    split = I.chrono_split(log(spark, [(1, i, 0) for i in range(n)]))
    assert sorted(r["item_id"] for r in I.part(split, "test").collect()) == list(range(n - test, n))


def test_long_tail_counts_train_alone(spark):
    split = log(spark, [(1, 1, 0), (2, 1, 0), (1, 2, 1), (2, 3, 2)])
    assert [r["item_id"] for r in I.long_tail(split).orderBy("item_id").collect()] == [2, 3]


def test_popularity_ties_go_to_the_smaller_item(spark):
    train = log(spark, [(1, 9, 0), (2, 8, 0), (3, 7, 0), (3, 6, 1)])
    got = [r["item_id"] for r in R.popularity(train, 2).where("user_id = 1").orderBy("rank").collect()]
    assert got == [6, 7]


def test_neighbours_match_the_matrix_product(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((12, 9)) < 0.4).astype(float)
    train = log(spark, [(u, i, 0) for u, i in zip(*(x.tolist() for x in np.nonzero(a)))])
    norm = a / np.maximum(np.sqrt(a.sum(axis=0)), 1e-9)
    score = np.round(a @ (norm.T @ norm), 6)
    got = {(r["user_id"], r["item_id"]): r["score"] for r in R.item_neighbours(train, 9).collect()}
    for u in range(12):
        for i in range(9):
            if a[u].any() and not a[u, i] and a[:, i].any():
                assert got[u, i] == pytest.approx(score[u, i], abs=2e-6)


def test_lists_hold_no_seen_item_and_dense_ranks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(12)], "item_id long, v array<double>")
    train = train_of(spark, [(u, (u * 3 + k) % 12, k) for u in range(4) for k in range(6)])
    for df in (R.content(train, vectors), R.active_centroid(train, vectors), R.random_items(train, vectors), R.popularity(train), R.item_neighbours(train)):
        assert df.join(train, ["user_id", "item_id"]).count() == 0
        for r in df.groupBy("user_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d")).collect():
            assert r["m"] == r["n"] == r["d"]


def test_equal_vectors_tie_by_item(spark):
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in (4, 2, 3, 1)], "item_id long, v array<double>")
    got = R.content(train_of(spark, [(1, 4, 0), (1, 99, 1)]), vectors).orderBy("rank").collect()
    assert [r["item_id"] for r in got] == [1, 2, 3]


def test_fallbacks(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id long, v array<double>")
    train = train_of(spark, [(1, 0, 0), (1, 1, 1), (1, 77, 2), (2, 70, 0), (2, 71, 1)])
    none = {r["user_id"] for r in R.active_centroid(train, vectors).collect()}
    popular = {r["user_id"] for r in R.active_centroid(train, vectors, empty_profile="popularity").collect()}
    assert none == {1} and popular == {1, 2}


def test_other_users_do_not_change_content(spark):
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(20)], "item_id long, v array<double>")
    rows = [(u, (u * 7 + k * 3) % 20, k) for u in range(3) for k in range(8)]
    all_, one = (R.active_centroid(train_of(spark, r), vectors).where("user_id = 1").orderBy("rank").collect() for r in (rows, [x for x in rows if x[0] == 1]))
    assert all_ == one


def test_recall_and_its_missing_values(spark):
    test = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "user_id long, item_id long")
    tail = spark.createDataFrame([(2,)], "item_id long")
    recs = spark.createDataFrame([(1, 2, 1.0, 1), (1, 9, 0.5, 2)], "user_id long, item_id long, score double, rank int")
    got = {r["user_id"]: (r["recall"], r["lt_recall"]) for r in Q.per_user({"X": recs}, test, tail, test.select("user_id").distinct()).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, None)}


def test_bootstraps_agree(spark):
    rows = spark.createDataFrame([(str(u), "X", float(u % 4 == 0), None if u % 2 else 1.0) for u in range(200)], "user_id string, system string, recall double, lt_recall double")
    a, b = ({r["metric"]: r for r in f.collect()} for f in (Q.bootstrap(rows, 4000), Q.bootstrap_shared(rows, ["X"], 4000)))
    for m in ("recall", "lt_recall"):
        assert a[m]["mean"] == pytest.approx(b[m]["mean"]) and a[m]["low"] == pytest.approx(b[m]["low"], abs=0.02) and a[m]["n"] == b[m]["n"]


def test_gate_stops(spark):
    table = spark.createDataFrame([("X", 0.1, 0.2)], "system string, recall double, lt_recall double")
    Q.gate(table, {"X": (0.1, 0.2)})
    with pytest.raises(ValueError):
        Q.gate(table, {"X": (0.1, 0.21)})


def test_texts(spark):
    row = lambda *c: spark.range(1).select(*c).first()
    lit = F.lit
    assert row(T.item_text(lit("a"), lit(None).cast("string")))[0] == "a by Unknown"
    assert list(row(*T.embedding_input(lit(" \n "), lit("t"), lit("a"), lit(None).cast("string")))) == ["t by a. ", "metadata"]
    assert [row(T.author_name(lit(x)))[0] for x in ('{"name": "A B"}', "{'name': 'A', 'x': 1}", "plain", "{bad", None, "{}")] == ["A B", "A", "plain", "{bad", "", ""]
    assert [row(T.description_text(lit(x)))[0] for x in ('["a", "b"]', "['a','b']", "plain", "[bad", None)] == ["a b", "a b", "plain", "[bad", ""]
    assert row(T.try_epoch(lit("12")), T.try_epoch(lit("x"))) == (12, None)


def test_readers(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "x.tsv").write_text("u\t2009\ta\tNone\tt\tNA\nshort\t1\n\nlong\t1\t2\t3\t4\t5\t\n")
    (p / "y.tsv.gz").write_bytes(gzip.compress(b'v\t2010\t\t"q\t\t\n'))
    plain = S.read_listens(spark, str(tmp_path)).orderBy("user_id").collect()
    assert [(r["user_id"], r["artist_id"], r["artist_name"]) for r in plain] == [("short", None, None), ("u", "a", "None"), ("v", None, '"q')]
    assert S.read_listens(spark, str(tmp_path), pandas_na=True).where("track_name is not null").count() == 0
    (p / "x.jsonl").write_text('{"user_id": "u", "text": "x"}\nbroken\n')
    assert S.read_jsonl(spark, str(p / "x.jsonl"), S.REVIEWS).count() == 1
    (p / "r.csv").write_text('user_id,system,recall@10,long_tail_recall@10\nu,S,0.5,\nv,"S, ""x""",0.0,1.0\n')
    got = S.read_results(spark, str(p / "r.csv")).orderBy("user_id").collect()
    assert got[0]["lt_recall"] is None and got[1]["system"] == 'S, "x"'


def test_empty_tables(spark):
    train = I.part(I.chrono_split(log(spark, [(1, 1, 0)]).limit(0)), "train")
    vectors = spark.createDataFrame([], "item_id long, v array<double>")
    for df in (R.content(train, vectors), R.active_centroid(train, vectors), R.random_items(train, vectors), R.popularity(train), R.item_neighbours(train)):
        assert df.count() == 0


def test_csv_holds_whole_texts(spark):
    """Long texts with quotes, line ends, separators and backslashes come back whole from the CSV sink and source."""
    from tidemark.plans.queries import CSV_BEGINNING, csv_copy

    texts = ['"', "x" * 200 + '"', 'say "yes", or\nno\\' * 2000, "one\ttwo,,\n\n\"\"" * 500 + " end ", "a\\\"b" * 300, "back\\"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert {r["doc_id"]: r["text"] for r in csv_copy(spark, docs).collect()} == {i: CSV_BEGINNING + t for i, t in enumerate(texts)}


def test_bootstrap_queries_draw_the_default_resamples(spark, sf_dir, monkeypatch):
    from tidemark.plans import queries

    drawn = []
    for name in ("bootstrap", "bootstrap_shared"):
        make = getattr(Q, name)
        monkeypatch.setattr(Q, name, lambda *a, make=make, **k: drawn.append(inspect.signature(make).bind(*a, **k)) or make(*a, **k))
    for name in ("bootstrap_ci", "bootstrap_ci_shared"):
        queries.QUERIES[name](spark, sf_dir)
    for call in drawn:
        call.apply_defaults()
    assert [c.arguments["n_boot"] for c in drawn] == [10_000, 10_000]

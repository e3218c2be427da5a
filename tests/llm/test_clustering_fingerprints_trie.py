"""Operators 11 to 13 against SQL and plain versions, and their edge rows."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.compare import duck, same
from tidemark.llm import centroid_clustering, fingerprints, prefix_trie


def stored(path, name, columns):
    pq.write_table(pa.table(columns), path / f"{name}.parquet")
    return str(path)


def plain(df):
    """Missing parents as -1, so that a comparison doesn't depend on how missing numbers are held."""
    return df.assign(parent_conv_id=df.parent_conv_id.fillna(-1).astype("int64"))


# 11 centroid clustering


def test_clustering_sql(spark, sf_dir):
    same(centroid_clustering.op11_centroid_clustering(spark, sf_dir).toPandas(), duck(sf_dir, centroid_clustering.oracle_sql()))


@pytest.mark.parametrize("n,repeats", [(1, 0), (3, 2), (700, 0), (700, 3), (64, 64)])
def test_dual_trees_find_the_nearest(n, repeats):
    rng = np.random.default_rng(n + repeats)
    x = np.floor(rng.normal(size=(n, 6)) * 9 + 40 * rng.integers(0, 4, (n, 1)))
    x[:repeats] = x[0]
    tree = centroid_clustering.CoverTree(x, 4)
    y = x[tree.order]
    for (starts, centres, radii), (below, _, _) in zip(tree.levels, [*tree.levels[1:], tree.levels[-1]]):
        assert starts[0] == 0 and (np.diff(starts) > 0).all() and set(starts) <= set(below)
        for s, e, c, r in zip(starts, [*starts[1:], n], centres, radii):
            assert s <= c < e and np.sqrt(((y[s:e] - y[c]) ** 2).sum(axis=1)).max() == r
    centroids = [list(map(int, v)) for v in rng.integers(-20, 150, (30, 6))]
    centroids[7] = centroids[4]
    near = centroid_clustering.Assigner(centroids, 6)
    label, d = near(tree, y)
    all_ = ((y[:, None] - np.array(centroids)) ** 2).sum(axis=2)
    assert (label == all_.argmin(axis=1)).all() and (d == all_.min(axis=1)).all()
    if n == 700:
        assert near.compared < n * 30 / 3  # most pairs are dropped by bounds


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) if abs(64 * float(x)) < 2**53 else int(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]

    def nearest():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, w)) for w in c]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, g, _, v in nearest():
            groups[g].append(v)
        for g, members in groups.items():
            c[g] = [sum(col) // len(members) for col in zip(*members)]
    return nearest(), c


def test_clustering_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).round(3).tolist()) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(60, 90)]  # a third are one vector
    rows += [(3, rows[3][1]), (100, [1e25] * 64), (101, [-1e25] * 64), (102, [1e25] * 63 + [3.0]), (103, None), (104, []), (105, [1.0] * 63), (106, [None] + [1.0] * 63), (107, [float("nan")] + [1.0] * 63), (108, [float("inf")] + [1.0] * 63), (109, [0.0] * 64), (110, [5e5] * 64)]
    df = spark.createDataFrame([(i, v, 9, 9.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double")
    found, centroids = centroid_clustering.cluster(centroid_clustering.kept(df, 64), size=16)
    out = centroid_clustering.with_inertia(found, centroids).toPandas()
    want, c = brute_clusters(rows)
    assert centroids == c
    assert collections.Counter(zip(out.vec_id, out.cluster)) == collections.Counter((i, g) for i, g, _, _ in want)
    fits = {(i, g): d for i, g, d, _ in want}
    for r in out.itertuples():
        d = fits[r.vec_id, r.cluster]
        assert r.distance == d if d < 2**63 else np.isnan(r.distance)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_clustering_of_few(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    found, centroids = centroid_clustering.cluster(centroid_clustering.kept(df, 64))
    out = centroid_clustering.with_inertia(found, centroids).toPandas()
    assert len(centroids) == 3 and len(out) == 3 and out[out.vec_id.notna()].cluster.nunique() == 1 and (out.inertia == 0).all()
    found, centroids = centroid_clustering.cluster(centroid_clustering.kept(df.limit(0), 64))
    assert centroids == [] and centroid_clustering.with_inertia(found, centroids).count() == 0


# 12 document fingerprints

TEXTS = ["", None, " \n\t\r\n", "one", "one", "One line. Two sentences! Three?", "a\nb\nc", "c\nb\na", "a\nb\nc\nb", "é" * 2001, "x y. " * 3000, "same line\n" * 5000, "tail\n\n\nhead", "\U0001f600 wide \U0001f600\nthere. Here", "a\rb"]


def test_fingerprints_sql(spark, sf_dir):
    same(fingerprints.op12_fingerprints(spark, sf_dir).toPandas(), duck(sf_dir, fingerprints.oracle_sql()))


@pytest.mark.parametrize("ids", [list(range(len(TEXTS))), [None, None, 5, 5, 5, -7, 2**62, -(2**63), 2**63 - 1, 1, 3, 900, 901, 10**12, 0]])
def test_fingerprints_edges_sql(spark, tmp_path, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", 2)
    folder = stored(tmp_path, "documents", {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(TEXTS), "part": pa.array([1] * len(ids)), "n_chars": pa.array([0] * len(ids)), "v": pa.array(["x"] * len(ids))})
    rows = fingerprints.op12_fingerprints(spark, folder).toPandas()
    assert len(rows) == len(ids) and rows.near_edited.between(0, 1).all() and rows.near_next.between(0, 1).all()
    same(rows, duck(folder, fingerprints.oracle_sql()))


def test_fingerprints_of_none_and_one(spark, tmp_path):
    folder = stored(tmp_path, "documents", {"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    assert fingerprints.op12_fingerprints(spark, folder).count() == 0
    folder = stored(tmp_path, "documents", {"doc_id": pa.array([4], pa.int64()), "text": pa.array(["abcd\nef"])})
    row = fingerprints.op12_fingerprints(spark, folder).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest() and row.near_next == 1.0


def test_fingerprints_add_and_subtract(spark):
    """Inserting and deleting paragraphs equals the fingerprint of the changed text; order doesn't matter."""
    rng = random.Random(2)
    rows = []
    for i in range(30):
        kept, gone = ([f"line {rng.randrange(40)}. And {rng.randrange(40)}!" for _ in range(rng.randrange(6))] for _ in range(2))
        both = kept + gone
        rng.shuffle(both)
        rows.append((i, "\n".join(both), "\n".join(kept), "\n".join(gone)))
    df = spark.createDataFrame(rows, "doc_id long, whole string, kept string, gone string")
    of = {c: fingerprints.fingerprints(df, ["doc_id"], c).withColumnRenamed("v", c) for c in ("whole", "kept", "gone")}
    got = of["whole"].join(of["kept"], "doc_id").join(of["gone"], "doc_id")
    got = got.select(F.col("whole") == fingerprints.inserted(F.col("kept"), F.col("gone")), fingerprints.deleted(F.col("whole"), F.col("gone")) == F.col("kept"))
    assert got.count() == 30 and all(all(r) for r in got.collect())


def test_fingerprint_query_has_no_python_workers(spark, sf_dir):
    plan = fingerprints.op12_fingerprints(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "ExistingRDD" not in plan
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1  # texts are shuffled once


# 13 conversation prefix trie


def brute_trie(sequences):
    """{conv: list of (role, text)} -> rows of all nodes."""
    members = collections.defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    rows = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in own if len(sequences[c]) == len(p))
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), children[p], sum(not children[q] for q in below), sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows)


def brute_rebuilt(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def rows_of(df):
    return sorted(map(tuple, plain(df.toPandas())[["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]].itertuples(index=False)))


def test_trie_sql(spark, sf_dir):
    same(plain(prefix_trie.op13_prefix_trie(spark, sf_dir).toPandas()), plain(duck(sf_dir, prefix_trie.oracle_sql())))


def test_trie_edges(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "b", "é", None, ""])) for c in range(60) if c not in (15, 20) for t in range(rng.randrange(1, 7))]
    rows += [(70 + i, 0, "user", "hot") for i in range(40)]  # copies
    rows += [(7, None, "user", "z"), (7, 3, "user", "z"), (None, 1, "user", "a"), rows[5], rows[5], (500, 0, "user", "long " * 20_000), (2**62, 0, "u", "x"), (2**62, 1, "u", "y")]
    folder = stored(tmp_path, "conversations", dict(zip(("conv_id", "turn", "role", "text"), (pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))))) | {"parent": pa.array([1] * len(rows)), "depth": pa.array([1] * len(rows))})
    want = brute_trie(brute_rebuilt(rows))
    assert rows_of(prefix_trie.op13_prefix_trie(spark, folder)) == want
    df = spark.read.parquet(folder + "/conversations.parquet")
    assert prefix_trie.op13_prefix_trie(spark, folder).count() == len(want)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.own_turns(df.limit(0)))).count() == 0


def sequences(spark, texts):
    """{conv: list of texts} as a table, one hash a turn."""
    name = lambda t: hashlib.sha256(t.encode()).digest()[: prefix_trie.SYMBOL]
    return spark.createDataFrame([(c, bytearray(b"".join(map(name, t))), [len(x.encode()) for x in t]) for c, t in texts.items()], "conv_id long, symbols binary, sizes array<long>")


@pytest.mark.parametrize("run_bytes,fan,ranges", [(300, 2, 1), (400, 3, 4), (1 << 20, 128, 9)])
def test_trie_of_hot_groups_over_ranges_and_runs(spark, monkeypatch, run_bytes, fan, ranges):
    """A third of the conversations are copies, a third share a long beginning; nodes span ranges, runs are merged in passes."""
    monkeypatch.setattr(prefix_trie, "PIECE", 50)
    monkeypatch.setattr(prefix_trie, "ROWS", 7)
    monkeypatch.setattr(prefix_trie, "HELD", 2)
    rng = random.Random(ranges)
    long = [f"t{i}" for i in range(30)]
    texts = {c: long if c % 3 == 0 else long[: rng.randrange(31)] + [rng.choice("abc")] if c % 3 == 1 else [rng.choice("abcd") for _ in range(rng.randrange(6))] for c in range(150)}
    want = brute_trie({c: [("", x) for x in t] for c, t in texts.items()})
    assert rows_of(prefix_trie.trie(sequences(spark, texts), run_bytes, fan, ranges)) == want


def test_merge_never_looks_at_shared_turns_again(tmp_path, monkeypatch):
    """Runs that share a long beginning: each comparison starts behind what both are known to share."""
    rng = random.Random(1)
    start = b"".join(hashlib.md5(bytes([i])).digest() for i in range(200))
    records = [(s := start + bytes([rng.randrange(4)]) * 16 * rng.randrange(1, 4), i, bytes(len(s) // 2)) for i in range(400)]
    runs = [list(prefix_trie.sorted_run(records[i::8])) for i in range(8)]
    compared = []
    real = prefix_trie.shared
    monkeypatch.setattr(prefix_trie, "shared", lambda a, b, known: compared.append(real(a, b, known) - known) or real(a, b, known))
    out = list(prefix_trie.merged([iter(r) for r in runs]))
    assert [r[1:3] for r in out] == sorted(r[:2] for r in records)
    before = b""
    for lcp, symbols, _, _ in out:
        assert lcp == real(before, symbols, 0)
        before = symbols
    assert sum(c > 100 for c in compared) <= 8  # only the first game of each run reads the beginning
    few = list(prefix_trie.external_sort(iter(records), str(tmp_path), 2000, 2))
    assert [r[1:3] for r in few] == [r[1:3] for r in out] and not list(tmp_path.iterdir())


def test_task_leaves_no_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "scratch", lambda: str(tmp_path))
    rows = list(prefix_trie.finished_nodes(iter([(b"a" * 16, 1, b"\0" * 8), (b"", 2, b"")]), -1, None, str(tmp_path), 10, 2))
    assert sum(map(len, rows)) == 2 and not list(tmp_path.iterdir())

"""Centroid clustering by dual-tree Lloyd iterations, exact on integer vectors.

Vectors go into blocks, each with a cover tree that is built once; every round a tree is built over the centroids and
the two are walked down together. A pair of nodes is dropped when the nearest that any of its centroids can be is
farther than some centroid surely is; the pairs of leaves that are left are compared exactly. Blocks follow the table's own
partitions, so nothing is shuffled but sums: a cluster's sum is one row a component for each task.

Defined results: vectors of another width, null, or holding null or non-finite components (or any that `scale` makes
infinite) take no part. Equal distances go to the smaller cluster number. Repeated rows are vectors of their own. Starts of
equal hash are ordered by their components, those of null vec_id come last; with fewer vectors than k there are
as many clusters as vectors. Distances and sums are exact at any size; a column is null where its value doesn't fit a long.
Other columns of the table are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches, table, tidied

#: Vectors of a block, and the most that a leaf of its tree has on average.
BLOCK, LEAF = 1024, 4
#: Integers up to this are exact in a double, squares and their sums included.
EXACT = float(1 << 53)
LIMB = 40
LONGEST = (1 << 63) - 1
PAIRS = 1 << 16
CODES = (np.int8, np.int16, np.int32, np.float64)


class CoverTree:
    """Nested nets of the rows of x: level 0 has one centre, each next level halves the distance within which every row has a centre.

    Rows are put in tree order (`order`), in which every node's rows are a range. A level is (starts, centres,
    radii): where its nodes begin, the place of their centre and the distance of their farthest row.
    """

    def __init__(self, x: np.ndarray, leaf: int = 1):
        n = len(x)
        scaled = x / max(1.0, np.abs(x).max(initial=0))  # only the shape of the tree depends on these distances
        norms = (scaled**2).sum(axis=1)
        far = np.sqrt(np.maximum(norms[:, None] + norms - 2 * scaled @ scaled.T, 0))
        chosen, radius, near = [0], [np.inf], far[0].copy()
        while len(chosen) < max(1, n // leaf) and near.max() > 0:  # the row farthest from all centres is the next centre
            j = int(near.argmax())
            chosen.append(j)
            radius.append(near[j])
            near = np.minimum(near, far[j])
        sizes, r = [1], radius[1] if len(radius) > 1 else 0.0
        while sizes[-1] < len(chosen):
            r /= 2
            sizes.append(max(sizes[-1], int((np.array(radius) > r).sum())))
        sizes = sorted(set(sizes))
        chosen = np.array(chosen)
        of = far[:, chosen[: sizes[-1]]].argmin(axis=1)
        of[chosen[: sizes[-1]]] = np.arange(sizes[-1])
        above = [of]
        for size in sizes[-2::-1]:  # a centre's parent: itself, or the nearest centre of the level above
            parent = far[np.ix_(chosen[: above[-1].max(initial=0) + 1], chosen[:size])].argmin(axis=1)
            parent[:size] = np.arange(size)
            above.append(parent[above[-1]])
        self.order = np.lexsort(above)  # the top level is the last and so the first key
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        x = x[self.order]
        self.levels = []
        for node in reversed(above):
            node = node[self.order]
            starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            centres = place[chosen[node[starts]]]
            lengths = np.diff(np.append(starts, n))
            radii = np.maximum.reduceat(distance(x, np.repeat(x[centres], lengths, axis=0)), starts)
            self.levels.append((starts, centres, radii))

    def children(self, level: int, nodes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First child and behind the last, in the next level, of nodes of a level."""
        starts, below = self.levels[level][0], self.levels[level + 1][0]
        ends = np.append(starts[1:], n)
        return np.searchsorted(below, starts[nodes]), np.searchsorted(below, ends[nodes])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, with the precision of doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt(((a - b) ** 2).sum(axis=1))


def spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of several ranges in a row, and the range that each belongs to."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n), which


def product(first, last, first2, last2):
    """All pairs of a number of the one range and one of the other, range by range."""
    a, which = spans(first, last)
    b, at = spans(first2[which], last2[which])
    return a[at], b


class Assigner:
    """The nearest of integer centroids, given as lists of Python integers, to the rows of blocks."""

    def __init__(self, centroids: list[list[int]], dims: int):
        self.exact = np.array([[int(v) for v in c] for c in centroids], object).reshape(len(centroids), dims)
        self.c = self.exact.astype(float)
        self.tree = CoverTree(self.c)
        self.c = self.c[self.tree.order]
        self.number = self.tree.order
        self.exact = self.exact[self.tree.order]
        self.largest = np.abs(self.c).max(initial=0)
        self.compared = 0  # pairs of a vector and a centroid that were compared exactly

    def squared(self, x: np.ndarray, p: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Exact squared distances of pairs, as doubles where those are exact, else as Python integers."""
        small = 4 * x.shape[1] * max(np.abs(x).max(initial=0), self.largest) ** 2 < EXACT
        if small:
            return ((x[p] - self.c[c]) ** 2).sum(axis=1)
        out = np.empty(len(p), object)
        for i, (a, b) in enumerate(zip(p.tolist(), c.tolist())):
            out[i] = sum((int(u) - v) ** 2 for u, v in zip(x[a], self.exact[b]))
        return out

    def __call__(self, tree: CoverTree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of the rows of x, which are in the order of their tree."""
        n, k = len(x), len(self.c)
        label = np.full(n, -1)
        slack = 1e-12 * x.shape[1] * (np.abs(x).max(initial=0) + self.largest)
        nodes, others = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.full(1, np.inf)
        last, least = len(tree.levels) - 1, len(self.tree.levels) - 1
        for t in range(max(last, least) + 1):
            i, j = min(t, last), min(t, least)
            starts, centres, radii = tree.levels[i]
            starts2, centres2, radii2 = self.tree.levels[j]
            ends, ends2 = np.append(starts[1:], n), np.append(starts2[1:], k)
            d = np.concatenate([distance(x[centres[nodes[s : s + PAIRS]]], self.c[centres2[others[s : s + PAIRS]]]) for s in range(0, len(nodes), PAIRS)]) if len(nodes) else np.zeros(0)
            np.minimum.at(bound, nodes, d + radii[nodes])  # the centre itself is a centroid
            with np.errstate(invalid="ignore"):
                keep = ~(d - radii[nodes] - radii2[others] > bound[nodes] * (1 + 1e-9) + slack)
            nodes, others = nodes[keep], others[keep]
            one = (np.bincount(nodes, minlength=len(starts))[nodes] == 1) & (ends2[others] - starts2[others] == 1)
            rows, which = spans(starts[nodes[one]], ends[nodes[one]])
            label[rows] = starts2[others[one]][which]  # whole nodes that have one centroid left
            nodes, others = nodes[~one], others[~one]
            if t == max(last, least):
                p, c = product(starts[nodes], ends[nodes], starts2[others], ends2[others])
                self.compared += len(p)
                exact = self.squared(x, p, c)
                best = np.lexsort((self.number[c], exact, p)) if exact.dtype != object else np.array(sorted(range(len(p)), key=lambda q: (p[q], exact[q], self.number[c[q]])), np.int64)
                p, c = p[best], c[best]
                first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else best[:0]
                label[p[first]] = c[first]
                break
            first, behind = tree.children(i, nodes, n) if i < last else (nodes, nodes + 1)
            first2, behind2 = self.tree.children(j, others, k) if j < least else (others, others + 1)
            if i < last:  # children inherit their parent's bound
                of = np.searchsorted(starts, tree.levels[i + 1][0], "right") - 1
                bound = bound[of]
            nodes, others = product(first, behind, first2, behind2)
        return self.number[label], self.squared(x, np.arange(n), label)


def kept(df: DataFrame, dims: int, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v, the integers floor(scale * x) as doubles, of the vectors that take part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scale * x.cast("double")) < F.lit(float("inf"))))
    whole = F.col(vector).isNotNull() & (F.size(vector) == dims) & F.coalesce(fine, F.lit(False))
    large = F.lit(float(1 << 53))  # beyond it a double is an integer already
    return df.where(whole).select("vec_id", F.transform(vector, lambda x: F.when(F.abs(scale * x.cast("double")) < large, F.floor(F.when(F.abs(scale * x.cast("double")) < large, scale * x.cast("double"))).cast("double")).otherwise(scale * x.cast("double"))).alias("v"))


def blocks(vectors: DataFrame, dims: int, size: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Blocks of the rows of each partition: ids, the rows in the order of their cover tree (code is the type of a component), and its levels."""

    def made(ids, rows):
        x = np.concatenate(rows).reshape(-1, dims)
        tree = CoverTree(x, leaf)
        x = x[tree.order]
        most = np.abs(x).max()
        code = next(i for i, t in enumerate(CODES) if i == 3 or most <= np.iinfo(t).max)
        ids = pa.concat_arrays(ids).take(pa.array(tree.order))
        level = [np.concatenate(a) for a in zip(*tree.levels)]
        columns = {
            "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "code": pa.array([code], pa.int32()), "x": pa.array([x.astype(CODES[code]).tobytes()], pa.binary()),
            "sizes": pa.array([[len(s) for s, _, _ in tree.levels]], pa.list_(pa.int32())), "starts": pa.array([level[0].astype(np.int32).tobytes()], pa.binary()), "centres": pa.array([level[1].astype(np.int32).tobytes()], pa.binary()), "radii": pa.array([level[2].tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        ids, rows, n = [], [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(part.num_rows)
                ids.append(part.column("vec_id").cast(pa.int64()))
                rows.append(part.column("v").flatten().to_numpy(zero_copy_only=False))
                n += part.num_rows
                if n == size:
                    yield made(ids, rows)
                    ids, rows, n = [], [], 0
        if n:
            yield made(ids, rows)

    small_batches(vectors.sparkSession)
    return vectors.select("vec_id", "v").mapInArrow(tidied(run), "ids array<bigint>, code int, x binary, sizes array<int>, starts binary, centres binary, radii binary")


class Stored:
    """The tree of a stored block."""

    children = CoverTree.children

    def __init__(self, row: dict, dims: int):
        self.x = np.frombuffer(row["x"], CODES[row["code"]]).reshape(-1, dims).astype(float)
        ends = np.cumsum([0, *row["sizes"]])
        arrays = [np.frombuffer(row[c], t) for c, t in (("starts", np.int32), ("centres", np.int32), ("radii", np.float64))]
        self.levels = [tuple(a[s:e] for a in arrays) for s, e in zip(ends, ends[1:])]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def sums(stored: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of the vectors nearest to each centroid; the driver gets a row a component of a centroid.

    Sums are exact: in each task as Python integers, then in limbs of 40 bits.
    """

    def run(batches):
        near, total, count = Assigner(centroids, dims), {}, {}
        for row in _rows(batches):
            tree = Stored(row, dims)
            label, _ = near(tree, tree.x)
            exact = len(label) * np.abs(tree.x).max(initial=0) < EXACT
            for c in np.unique(label).tolist():
                own = tree.x[label == c]
                s = own.sum(axis=0).tolist() if exact else [sum(map(int, column)) for column in own.T]
                total[c] = [a + int(b) for a, b in zip(total.get(c, [0] * dims), s)]
                count[c] = count.get(c, 0) + len(own)
        out = []
        for c, s in total.items():
            out.append((c, -1, 0, count[c]))
            for d, v in enumerate(s):
                sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
                while v:
                    out.append((c, d, limb, sign * (v & ((1 << LIMB) - 1))))
                    v >>= LIMB
                    limb += 1
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["cluster", "dim", "limb", "value"])

    parts = stored.mapInArrow(tidied(run), "cluster int, dim int, limb int, value bigint")
    found: dict = {}
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect():
        n, s = found.setdefault(r["cluster"], [0, [0] * dims])
        if r["dim"] < 0:
            found[r["cluster"]][0] = int(r["value"])
        else:
            s[r["dim"]] += int(r["value"]) << (LIMB * r["limb"])
    return {c: (n, s) for c, (n, s) in found.items()}


def starts(vectors: DataFrame, k: int) -> list[list[int]]:
    """The k vectors of least sha256 of 1:vec_id, in that order."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return [[int(x) for x in r["v"]] for r in vectors.orderBy(hashed.asc_nulls_last(), "v").limit(k).select("v").collect()]


def assigned(stored: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """vec_id, cluster and distance (squared; null beyond a long)."""

    def run(batches):
        near = Assigner(centroids, dims)
        for row in _rows(batches):
            tree = Stored(row, dims)
            label, d = near(tree, tree.x)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(label, pa.int32()), pa.array([int(v) if v <= LONGEST else None for v in d.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(tidied(run), "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, size: int = BLOCK) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of the rows of kept(), and the final centroids."""
    centroids = starts(vectors, k)
    stored = materialise(blocks(vectors, dims, size))
    for _ in range(rounds if centroids else 0):
        for c, (n, s) in sums(stored, centroids, dims).items():
            centroids[c] = [v // n for v in s]
    return (assigned(stored, centroids, dims) if centroids else stored.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint")), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(kept(table(spark, sf_dir, "embeddings"), 64)))


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """rows with the distances summed over their cluster and over all, and the hash of their centroid."""
    spark, rows = rows.sparkSession, materialise(rows)
    known = F.count("distance") == F.count(F.lit(1))
    found = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}  # a row a cluster
    fits = lambda s: None if s is None or s > LONGEST else int(s)
    every = None if None in found.values() else fits(sum(found.values()))
    of = [(c, fits(s), every, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in found.items()]
    return rows.join(F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")), "cluster")


def oracle_sql(k: int = 16, rounds: int = 3) -> str:
    """DuckDB: every vector against every centroid, in whole numbers."""
    step = """d{i} as materialized (select v.vec_id, v.v, c.cluster, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from vec v, c{i} c),
 a{i} as materialized (select vec_id, v, arg_min(cluster, (distance, cluster)) as cluster, min(distance) as distance from d{i} group by vec_id, v)"""
    move = """s{i} as (select cluster, j, sum(x) as s, count(*) as n from (select cluster, unnest(range(64)) as j, unnest(v) as x from a{i}) group by cluster, j),
 m{i} as (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as v from s{i} group by cluster),
 c{j} as materialized (select o.cluster, coalesce(m.v, o.v) as v from c{i} o left join m{i} m on o.cluster = m.cluster)"""
    parts = [
        "vec as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"c0 as materialized (select (row_number() over (order by sha256('1:' || vec_id)) - 1)::int as cluster, v from vec order by sha256('1:' || vec_id) limit {k})",
    ]
    for i in range(rounds):
        parts += [step.format(i=i), move.format(i=i, j=i + 1)]
    parts.append(step.format(i=rounds))
    return f"""with {", ".join(parts)}
select a.vec_id, a.cluster, a.distance, (sum(a.distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(a.distance) over ())::bigint as inertia,
 sha256(list_aggregate(list_transform(c.v, lambda x: x::varchar), 'string_agg', ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on a.cluster = c.cluster"""

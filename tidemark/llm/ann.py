"""Approximate nearest neighbours by additive quantisation (operator 5).

A vector is coded as a sum of BOOKS full-dimensional codewords. The codebooks are fitted on the driver on
at most SAMPLE vectors (those of least hashed id): residual k-means, then rounds of beam-search
encoding and a least-squares update of all codewords at once. Every row is encoded by beam search
and stored with its codes.

Vectors are coded by their direction: every row is divided by its own norm in double precision, so that no
large or small vector spoils the codes of the others.

Rows and queries are dealt into groups and blocks, and each (block, group) cell is a task's work: inner
products with all codewords go into lookup tables, and the sums over a row's codes together with its norm
rank the group's rows for each query. The best RERANK rows of a group are compared by the exact distance on the original
vectors first. No row is nearer than its code less the error of its code, so the k-th best distance rules out the rows whose codes lie
further away; every row that it doesn't rule out is compared too. So the k nearest of all rows are found whatever the codes are worth;
good codes save comparisons. A cell passes on k rows a query.

Nearness is the Euclidean distance in double precision; ties go to the smaller vec_id, also where
more rows than RERANK share one code. The queries are the rows whose vec_id is divisible by 100; of rows
that share such a vec_id the least vector asks.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows without a vec_id; rows that share the query's vec_id
count as its own; equal vectors are all returned; vectors may have any finite size; fewer than k candidates give fewer rows; empty in, empty out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, tidied

BOOKS, WORDS, BEAM = 16, 256, 6
SAMPLE, ROUNDS, KMEANS_STEPS = 8000, 2, 8
#: Queries of a block and rows of a group; queries whose tables are held at once.
QUERY_BLOCK, GROUP, HELD = 4096, 16384, 256
#: Bytes of vectors of a group at most.
GROUP_BYTES = 16 << 20
#: Rows of a group that are compared first.
RERANK = 512
BATCH = 4096
#: What the rounding of single precision may take from a cosine or a length of 1.
SLACK = 2e-5


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(n, M) codes: after each codebook the `beam` sums nearest to each row are kept."""
    n, (m, k, d) = len(x), books.shape
    codes = np.zeros((n, 1, m), np.uint8)
    rest = x[:, None, :].astype(np.float32)
    error = (rest**2).sum(axis=2)
    for i in range(m):
        b = rest.shape[1]
        cost = error[:, :, None] - 2 * (rest.reshape(-1, d) @ books[i].T).reshape(n, b, k) + (books[i] ** 2).sum(axis=1)
        keep = min(beam if i + 1 < m else 1, b * k)
        cost = cost.reshape(n, -1)
        best = np.argpartition(cost, keep - 1, axis=1)[:, :keep]
        row = np.arange(n)[:, None]
        error, which, word = cost[row, best], best // k, best % k
        codes = codes[row, which]
        codes[:, :, i] = word
        rest = rest[row, which] - books[i][word]
    return codes[:, 0]


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[i][codes[:, i]] for i in range(len(books)))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 1) -> np.ndarray:
    """(M, K, d) codebooks."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = max(1, min(words, len(x)))
    out, rest = np.zeros((books, words, x.shape[1]), np.float32), x.copy()
    for i in range(books):
        centres = rest[rng.choice(len(rest), words, replace=False)]
        for _ in range(KMEANS_STEPS):
            near = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
            n = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            sums = np.add.reduceat(rest[order], np.minimum(np.cumsum(n) - n, len(rest) - 1), axis=0)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        near = ((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)
        out[i] = centres
        rest = rest - centres[near]
    for _ in range(ROUNDS):  # all codewords at once: (B'B + r) C = B'x with B the 0/1 matrix of codes
        codes = np.concatenate([encode(x[i : i + 1024], out) for i in range(0, len(x), 1024)]).astype(np.int64) + np.arange(books) * words
        gram, right = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(right, codes[:, i], x)
            for j in range(books):
                np.add.at(gram, (codes[:, i], codes[:, j]), 1.0)
        ridge = 1e-2
        gram[np.diag_indices_from(gram)] += ridge
        out = np.linalg.solve(gram, right + ridge * out.reshape(books * words, -1)).reshape(out.shape).astype(np.float32)
    return out


def directions64(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their norms, and the norms; no square leaves the range of numbers."""
    most = np.abs(x).max(axis=1, keepdims=True)
    part = x / most
    length = np.sqrt((part**2).sum(axis=1, keepdims=True))
    with np.errstate(over="ignore"):
        return part / length, (most * np.minimum(length, np.finfo(float).max / most))[:, 0]


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit, norm = directions64(x)
    return unit.astype(np.float32), norm


def valid(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & whole & F.exists(v, lambda x: x != 0))


def build_index(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, embedding, codes, _row: a number of its own) of every valid row, and the codebooks (None without rows)."""
    rows = valid(vectors, vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"))
    length = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return rows, None
    rows = rows.where(F.size("embedding") == length["d"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    books = fit(directions(np.array(sample["embedding"].tolist(), float))[0])
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in encode(directions(x)[0], books)], pa.binary())], names=["vec_id", "embedding", "codes"])

    coded = rows.mapInArrow(tidied(run), "vec_id long, embedding array<double>, codes binary")
    return materialise(coded.withColumn("_row", F.monotonically_increasing_id())), books


def lowest(score: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) columns of the n least scores of each row, equal ones by column."""
    if score.shape[1] <= n:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    last = np.partition(score, n - 1, axis=1)[:, n - 1 : n]
    under, equal = score < last, score == last
    take = under | (equal & (np.cumsum(equal, axis=1) <= n - under.sum(axis=1, keepdims=True)))
    return np.nonzero(take)[1].reshape(len(score), n)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, also where squares leave the range of numbers."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = a - b
        out = np.sqrt((d**2).sum(axis=1))
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-150))
        if len(odd):
            most = np.abs(d[odd]).max(axis=1, initial=0)
            most = np.where(np.isfinite(most) & (most > 0), most, 1)
            out[odd] = most * np.sqrt(((d[odd] / most[:, None]) ** 2).sum(axis=1))
        return out


def first_found(query: np.ndarray, rows: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k rows nearest to the query, ties by vec."""
    d = distances(rows, query[None])
    order = np.lexsort((vec, d))[:k]
    return order, d[order]


def nearest_of_cell(q: np.ndarray, own: np.ndarray, x: np.ndarray, vec: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int, rerank: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and distances of each query's k nearest rows of a cell; own: the queries' ids, whose rows don't count.

    The sums of table entries choose the `rerank` rows that are compared first. A row is no nearer than its code is, less the error of its code;
    so the k-th best distance found rules out the rows whose codes lie beyond, and the others are compared too.
    """
    unit64, norm = directions64(x)
    code = decoded(codes, books).astype(float)
    error, length = np.sqrt(((unit64 - code) ** 2).sum(axis=1)) + SLACK, (code**2).sum(axis=1)
    asked64, size = directions64(q)
    cosine = np.zeros((len(q), len(x)), np.float32)
    for book, c in zip(books, codes.T):
        cosine += np.take(asked64.astype(np.float32) @ book.T, c, axis=1)
    with np.errstate(over="ignore", under="ignore"):
        ratio = np.minimum(norm / size[:, None], 1e150)
    score = ratio * (ratio - 2 * cosine)
    with np.errstate(invalid="ignore"):
        bound = np.sqrt(np.maximum(1 - 2 * ratio * (cosine + SLACK) + ratio**2 * length, 0)) - ratio * error - SLACK
    mine = own[:, None] == vec
    score[mine] = np.inf
    first = lowest(score, rerank)
    out, plain = [], None
    for i in range(len(q)):
        at = first[i][~mine[i, first[i]]]
        best, far = first_found(q[i], x[at], vec[at], k)
        with np.errstate(over="ignore"):
            left = ~mine[i] if len(far) < k else ~mine[i] & ~(bound[i] > far[-1] / size[i] * (1 + 1e-9))
        left[at] = False
        left = np.flatnonzero(left)
        if 4 * len(left) > len(x):  # little is ruled out: the squares of all, as products, with the bounds of their rounding
            if plain is None:
                plain = asked64 @ unit64.T
            with np.errstate(over="ignore", invalid="ignore"):
                r = ratio[i, left]
                square, blur = 1 + r * r - 2 * r * plain[i, left], (1 + r) ** 2 * (x.shape[1] + 8) * 4e-16
                if len(far) == k:
                    left = left[~(square - blur > (far[-1] / size[i]) ** 2 * (1 + 1e-9))]
                elif len(left) > k:
                    left = left[~(square - blur > np.partition(np.where(np.isfinite(square + blur), square + blur, np.inf), k - 1)[k - 1])]
        if len(left):
            every = np.concatenate([at[best], left])
            some, far = first_found(q[i], x[every], vec[every], k)
            out.append((every[some], far))
        else:
            out.append((at[best], far))
    return out


def nearest(index: DataFrame, asked: DataFrame, books: np.ndarray, k: int, rerank: int) -> DataFrame:
    """query_id, vec_id and score of each query's k nearest rows of every group of the index; asked: query_id and query."""
    group = max(k, min(GROUP, GROUP_BYTES // (8 * books.shape[2])))
    groups, blocks = (max(1, -(-x.count() // n)) for x, n in ((index, group), (asked, QUERY_BLOCK)))
    shared = index.sparkSession.sparkContext.broadcast(books)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.select("vec_id", "_row", "codes", "embedding", number("_row", groups).alias("g"), every(blocks).alias("b"))
    queries = asked.select("query_id", "query", number("query_id", blocks).alias("b"), every(groups).alias("g"))

    def cell(rows: pa.Table, queries: pa.Table) -> pa.Table:
        books = shared.value
        vec, ids = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        found = []
        if len(vec) and len(ids):
            order = np.lexsort((rows.column("_row").to_numpy(), vec))
            x, q = (t.column(c).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t, c in ((rows, "embedding"), (queries, "query")))
            codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(vec), len(books))[order]
            x, vec = x[order], vec[order]
            for i in range(0, len(ids), HELD):
                near = nearest_of_cell(q[i : i + HELD], ids[i : i + HELD], x, vec, codes, books, k, rerank)
                found += [(np.full(len(at), ids[i + n]), vec[at], far) for n, (at, far) in enumerate(near)]
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(np.concatenate([empty[c], *(f[c] for f in found)])) for c in range(3)], names=["query_id", "vec_id", "score"])

    return rows.groupBy("b", "g").cogroup(queries.groupBy("b", "g")).applyInArrow(cell, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, every: int = 100, k: int = 10, rerank: int = RERANK, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows of each query."""
    index, books = build_index(vectors, vector)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = index.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))
    found = nearest(index, materialise(asked), books, k, rerank)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found of each query among all embeddings."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

"""Top-M products in blocks: users against item vectors, and users against item neighbours.

Both sides are dealt to cells of (user block, item block). A cell is a stretch of sorted rows that a task reads as a
stream: the block's items first, then what is compared with them. What a task holds is bounded by the block, not by
users, catalogue or history.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.vectors import DIGITS, EPS, matrix
from ..sources.shared import keep

#: Items of a cell, pivots at most, users compared at once.
ITEM_CELL, PIVOTS, AT_ONCE = 16_384, 64, 256
#: Users and items of a block of the sparse product (its sums are a dense matrix), and entries of a stored piece of it.
USER_BLOCK, ITEM_BLOCK, PIECE = 16_384, 1024, 200_000
#: Sums that are added at once.
ADDED = 1 << 20
#: Buyers of a user's item on average, and pairs that a block of users meets, up to which neighbours are counted from the histories themselves.
CO_USERS, BLOCK_PAIRS = 256, 4_000_000


def _key(df: DataFrame, column: str, parts: int):
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _parallel(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def best_of(score: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the m largest scores of each row, larger first, the smaller column first among equals; -inf never."""
    rows, n = score.shape
    if n > 4 * m:  # those that may be among the m best; equal ones at the edge included
        least = np.partition(score, n - m, axis=1)[:, n - m]
        row, col = np.nonzero(score >= least[:, None])
    else:
        row, col = np.repeat(np.arange(rows), n), np.tile(np.arange(n), rows)
    value = score[row, col]
    row, col, value = row[keep := np.isfinite(value)], col[keep], value[keep]
    order = np.lexsort((col, -value, row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < m], col[rank < m]


class Cells:
    """Cells of items that lie in similar directions: each nearest to one of a few pivots, a pivot's items split by hash.

    `radius` is the widest angle between a pivot and its items, so no item of a cell is nearer to a vector than the pivot's angle
    less the radius. The driver holds the pivots and two numbers for each.
    """

    def __init__(self, vectors: DataFrame, size: int = ITEM_CELL, pivots: int = PIVOTS):
        self.vectors, n = vectors, vectors.count()
        self.pivots = None
        if n <= size:
            self.first, self.parts, self.radius = [0], [1], [np.pi]
            return
        chosen = vectors.select("item_id", "v").orderBy(F.md5(F.col("item_id").cast("string")), "item_id").limit(min(pivots, -(-n // size) * 4))
        self.pivots = _unit(np.array([r["v"] for r in chosen.collect()], float))
        found = {r["pivot"]: r for r in self.placed().groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect()}
        self.parts = [-(-found[p]["n"] // size) if p in found else 0 for p in range(len(self.pivots))]
        self.radius = [found[p]["angle"] if p in found else 0.0 for p in range(len(self.pivots))]
        self.first = list(np.cumsum([0, *self.parts[:-1]]))

    @property
    def count(self) -> int:
        return sum(self.parts)

    def placed(self) -> DataFrame:
        """item_id, v, pivot and the angle to it."""
        if self.pivots is None:
            return self.vectors.select("item_id", "v", F.lit(0).alias("pivot"), F.lit(0.0).alias("angle"))
        pivots = self.pivots

        def run(batches):
            for batch in batches:
                cos = _unit(matrix(batch.column("v"))) @ pivots.T
                p = cos.argmax(axis=1)
                angle = np.arccos(np.clip(cos[np.arange(len(p)), p], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("v"), pa.array(p.astype(np.int32)), pa.array(angle)], names=["item_id", "v", "pivot", "angle"])

        fields = self.vectors.select("item_id", "v").schema.fields
        return self.vectors.select("item_id", "v").mapInArrow(run, StructType([*fields, *StructType.fromDDL("pivot int, angle double").fields]))

    def items(self) -> DataFrame:
        """item_id, v and their cell."""
        if self.pivots is None:
            return self.vectors.select("item_id", "v", F.lit(0).alias("cell"))
        at = lambda a: F.element_at(F.array(*(F.lit(int(x)) for x in a)), F.col("pivot") + 1)
        return self.placed().select("item_id", "v", (at(self.first) + F.pmod(F.xxhash64("item_id"), at(self.parts))).cast("int").alias("cell"))

    def home(self, queries: DataFrame) -> DataFrame:
        """queries (user_id, v) with one cell each, of the pivot nearest to it."""
        return queries.select("user_id", "v", F.lit(0).alias("cell")) if self.pivots is None else self._visits(queries.withColumn("least", F.lit(None).cast("double")), True)

    def others(self, queries: DataFrame) -> DataFrame:
        """queries (user_id, v, least: the score that an item must reach) with every further cell that may hold such an item."""
        return self._visits(queries, False)

    def _visits(self, queries: DataFrame, home: bool) -> DataFrame:
        pivots, radius, first, parts = self.pivots, np.array(self.radius), np.array(self.first), np.array(self.parts)
        used = np.flatnonzero(parts)

        def run(batches):
            for batch in batches:
                cos = _unit(matrix(batch.column("v"))) @ pivots[used].T
                near = cos.argmax(axis=1)
                if home:
                    row, cell = np.arange(len(near)), first[used][near]
                else:
                    bound = np.maximum(np.cos(np.maximum(np.arccos(np.clip(cos, -1, 1)) - radius[used], 0)), 0)
                    least = batch.column("least").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    row, p = np.nonzero(bound >= least[:, None] - 2 * 10.0**-DIGITS)
                    n = parts[used][p]
                    cell = np.repeat(first[used][p], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    row = np.repeat(row, n)
                    other = cell != first[used][near][row]
                    row, cell = row[other], cell[other]
                yield pa.RecordBatch.from_arrays([batch.column("user_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(cell.astype(np.int32))], names=["user_id", "v", "cell"])

        fields = queries.select("user_id", "v").schema.fields
        return queries.select("user_id", "v", "least").mapInArrow(run, StructType([*fields, *StructType.fromDDL("cell int").fields]))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def cell_best(visits: DataFrame, items: DataFrame, seen: DataFrame, cells: int, m: int) -> DataFrame:
    """user_id, item_id and score: the m best unseen items of every visited cell.

    visits (user_id, v, cell), items (item_id, v, cell, ids: the items that have the vector v, of which item_id is the least), seen (user_id, item_id, cell).
    A vector is compared once, however many items have it. Items are copied to as many user blocks as
    it takes to keep all cores busy; a seen pair goes to its one cell.
    """
    blocks = max(1, -(-_parallel(visits) // cells))
    item, user = (visits.sparkSession, items.schema["item_id"].dataType, visits.schema["user_id"].dataType)[1:]
    no = lambda kind: F.lit(None).cast(kind)
    block = _key(visits, "user_id", blocks).alias("block")
    many = f"array<{item.simpleString()}>"
    rows = items.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "cell", F.lit(0).alias("kind"), no(user).alias("user_id"), F.lit(0).alias("part"), "item_id", "v", "ids")
    rows = rows.unionByName(seen.select(block, "cell", F.lit(1).alias("kind"), "user_id", F.lit(0).alias("part"), "item_id", no("array<double>").alias("v"), no(many).alias("ids")))
    rows = rows.unionByName(visits.select(block, "cell", F.lit(1).alias("kind"), "user_id", F.lit(1).alias("part"), no(item).alias("item_id"), "v", no(many).alias("ids")))

    def run(batches):
        at, ids, vectors, norms, sharing, group = None, [], [], None, [], {}
        users, asked, last, known = [], [], None, []
        hidden: list[list] = []

        def flush():
            nonlocal users, asked, hidden
            if users and len(ids):
                q = np.array(asked, float)
                score = np.round(q @ vectors.T / (np.sqrt((q**2).sum(axis=1))[:, None] * norms + EPS), DIGITS)
                for r, own in enumerate(hidden):
                    for g, n in Counter(group[i] for i in own).items():
                        if n == len(sharing[g]):
                            score[r, g] = -np.inf
                if len(group) == len(ids):
                    row, col = best_of(score, m)
                    found, value = ids[col].tolist(), score[row, col]
                else:
                    row, found, value = best_sharing(score, sharing, hidden, m)
                out = pa.RecordBatch.from_arrays([pa.array([users[r] for r in row.tolist()], arrow_user), pa.array(found, arrow_item), pa.array(value)], names=["user_id", "item_id", "score"])
            else:
                out = None
            users, asked, hidden = [], [], []
            return out

        arrow_user = arrow_item = None
        for batch in batches:
            arrow_user, arrow_item = batch.schema.field("user_id").type, batch.schema.field("item_id").type
            block, cell, kind, part = (batch.column(c).to_numpy() for c in ("block", "cell", "kind", "part"))
            stretch = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])]))
            for s, e in zip(stretch, [*stretch[1:], len(kind)]):
                if (block[s], cell[s]) != at:
                    if (out := flush()) is not None:
                        yield out
                    at, ids, vectors, last, known, sharing = (block[s], cell[s]), [], [], None, [], []
                piece = batch.slice(s, e - s)
                if kind[s] == 0:
                    ids.append(piece.column("item_id").to_numpy(zero_copy_only=False))
                    vectors.append(matrix(piece.column("v")))
                    sharing += [x.values.to_numpy(zero_copy_only=False) for x in piece.column("ids")]
                    continue
                if isinstance(ids, list):
                    if not ids:
                        continue  # a cell without items
                    ids, vectors = np.concatenate(ids), np.concatenate(vectors)
                    order = np.argsort(ids, kind="stable")
                    ids, vectors, sharing = ids[order], vectors[order], [sharing[i] for i in order]
                    group = {i: g for g, own in enumerate(sharing) for i in own.tolist()}
                    norms = np.sqrt((vectors**2).sum(axis=1))
                for u, p, i, v in zip(piece.column("user_id").to_pylist(), part[s:e].tolist(), piece.column("item_id").to_pylist(), piece.column("v")):
                    if u != last:
                        last, known = u, []
                    if p == 0:
                        known.append(i)
                        continue
                    users.append(u)
                    asked.append(v.values.to_numpy())
                    hidden.append(known)
                    if len(users) >= AT_ONCE and (out := flush()) is not None:
                        yield out
        if (out := flush()) is not None:
            yield out

    schema = StructType([StructField("user_id", user), StructField("item_id", item), *StructType.fromDDL("score double").fields])
    dealt = rows.repartition(blocks * cells, "block", "cell").sortWithinPartitions("block", "cell", "kind", "user_id", "part")
    return dealt.mapInArrow(run, schema)


def best_sharing(score: np.ndarray, sharing: list[np.ndarray], hidden: list[list], m: int) -> tuple[np.ndarray, list, np.ndarray]:
    """Rows, items and scores of the m best items of each row that it doesn't hide; sharing: the items of each column, at least one of which isn't hidden where the score isn't -inf."""
    rows, found, value = [], [], []
    for r, s in enumerate(score):
        least = np.partition(s, len(s) - m)[len(s) - m] if len(s) > m else -np.inf
        columns = np.flatnonzero((s >= least) & (s > -np.inf))
        if not len(columns):
            continue
        items, own = np.concatenate([sharing[c] for c in columns]), np.repeat(s[columns], [len(sharing[c]) for c in columns])
        if hidden[r]:
            free = ~np.isin(items, hidden[r])
            items, own = items[free], own[free]
        order = np.lexsort((items, -own))[:m]
        rows.append(np.full(len(order), r))
        found += items[order].tolist()
        value.append(own[order])
    return np.concatenate([np.zeros(0, int), *rows]), found, np.concatenate([np.zeros(0), *value])


def neighbour_products(t: DataFrame, m: int) -> DataFrame:
    """user_id, item_id and score: the m unseen items, or more, with the largest sums of cosine weights to the user's items.

    t holds (user_id, item_id), repeated or not. Where items have few users and blocks of users meet a bounded number of histories, each
    block gets those histories; else the products of items are summed in blocks of both sides. Both give the same.
    """
    near = met_histories(t)
    return product_blocks(t.distinct(), m) if near is None else met_products(t, near, m)


def met_histories(t: DataFrame) -> DataFrame | None:
    """block, own (whether the user is one of the block), user_id, ids and ns (each item's users): the histories that share an item with a block's users; None where they are too many.

    A block is a stretch of users in order of their ids, so neighbours in it often meet the same histories. Pairs are shuffled once, to become
    histories; what follows moves whole histories, and for each block its items with the blocks that have them.
    """
    pairs = t.select("user_id", "item_id").dropna()
    users = pairs.agg(F.approx_count_distinct("user_id")).first()[0]
    size = max(1, min(USER_BLOCK, -(-users // (2 * _parallel(t)))))
    histories = pairs.repartitionByRange(max(1, -(-users // size)), "user_id").groupBy("user_id").agg(F.collect_set("item_id").alias("ids"))
    histories = keep(histories.withColumn("own_block", F.spark_partition_id()))
    places = histories.select("own_block", F.explode("ids").alias("item_id")).groupBy("item_id", "own_block").agg(F.count(F.lit(1)).alias("n"))
    items = keep(places.groupBy("item_id").agg(F.sum("n").cast("int").alias("n"), F.collect_list("own_block").alias("blocks")))
    one = items.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("square")).first()
    if not one["n"] or one["square"] > CO_USERS * one["n"]:
        return None
    theirs = items.select(F.explode("blocks").alias("own_block"), "item_id", "n", "blocks")
    kinds = ", ".join(f"{c} {histories.schema[c].dataType.simpleString()}" for c in ("user_id", "own_block", "ids"))
    held = keep(histories.groupBy("own_block").cogroup(theirs.groupBy("own_block")).applyInArrow(_met, f"{kinds}, ns array<int>, blocks array<int>"))
    met = held.select(F.explode("blocks").alias("block"), F.size("ids").alias("k")).groupBy("block").agg(F.sum("k").alias("k")).agg(F.count(F.lit(1)).alias("blocks"), F.max("k").alias("k")).first()
    if met["k"] > BLOCK_PAIRS:
        return None
    dealt = held.select(F.explode("blocks").alias("block"), "own_block", "user_id", "ids", "ns").repartition(met["blocks"], "block")  # as many tasks as blocks, however few bytes
    return dealt.select("block", (F.col("block") == F.col("own_block")).alias("own"), "user_id", "ids", "ns")


def _met(histories: pa.Table, items: pa.Table) -> pa.Table:
    """A block's histories with the number of users of each item, and the blocks that have any of a history's items."""
    ids, blocks = histories.column("ids").combine_chunks(), items.column("blocks").combine_chunks()
    place = pc.index_in(ids.flatten(), value_set=items.column("item_id").combine_chunks()).to_numpy()
    ns = items.column("n").to_numpy()[place].astype(np.int32)
    first = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
    begin = np.concatenate([[0], np.cumsum(blocks.value_lengths().to_numpy())])
    blocks = blocks.flatten().to_numpy()
    found, ends, step = [], [np.zeros(1, np.int64)], max(1, ADDED // (int(blocks.max(initial=0)) + 1))
    for s in range(0, histories.num_rows, step):
        own = place[first[s] : first[min(s + step, histories.num_rows)]]
        of = np.repeat(np.arange(min(step, histories.num_rows - s)), np.diff(first[s : s + step + 1]))
        has = np.zeros((of[-1] + 1, int(blocks.max()) + 1), bool)
        has[_spread(of, begin[own], begin[own + 1], blocks)] = True
        found.append(np.nonzero(has)[1].astype(np.int32))
        ends.append(ends[-1][-1] + np.cumsum(has.sum(axis=1)))
    lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ns)), pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))]
    return pa.table({"user_id": histories.column("user_id"), "own_block": histories.column("own_block"), "ids": ids, "ns": lists[0], "blocks": lists[1]})


#: Stretches of a row of sums for each item of a list; the m-th largest of their maxima is a bound that the m best sums reach.
STRETCHES = 16


def met_products(t: DataFrame, near: DataFrame, m: int) -> DataFrame:
    """neighbour_products() from the histories that each block of users meets; items without a common user follow with score 0 by id, as far as a list may need them."""
    item, user = t.schema["item_id"].dataType, t.schema["user_id"].dataType
    longest = t.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    fill = np.array([r["item_id"] for r in t.select("item_id").dropna().distinct().orderBy("item_id").limit(2 * m + longest).collect()])

    def cell(table: pa.Table) -> pa.Table:
        arrow_user, arrow_item = table.schema.field("user_id").type, table.schema.field("ids").type.value_type
        lists = table.column("ids").combine_chunks()
        edges = lists.offsets.to_numpy().astype(np.int64)
        names, flat = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        edges, flat = edges - edges[0], flat.astype(np.int32)
        stretches = STRETCHES * m
        width = -(-len(names) // stretches) * stretches
        weight = np.zeros(width)
        weight[flat] = 1 / np.sqrt(table.column("ns").combine_chunks().flatten().to_numpy().astype(float))
        order = np.argsort(flat, kind="stable")
        holders = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(edges))[order]
        first = np.searchsorted(flat[order], np.arange(len(names) + 1))
        own = np.flatnonzero(table.column("own").to_numpy())
        held = np.concatenate([[0], np.cumsum(np.diff(first)[flat])])  # holders of the items before a place
        each = int((held[edges[own + 1]] - held[edges[own]]).sum() * max(1.0, np.diff(edges).mean()) / max(1, len(own))) + 1  # sums that a user gets
        sparse = 8 * each < len(names)
        found, step = [], max(1, ADDED // (each if sparse else max(each, width)))
        for s in range(0, len(own), step):
            rows = own[s : s + step]
            user_of, j = _spread(np.arange(len(rows)), edges[rows], edges[rows + 1], flat)
            pair, v = _spread(np.arange(len(j)), first[j], first[j + 1], holders)
            other = v != rows[user_of[pair]]  # what a user has isn't listed
            pair, v = pair[other], v[other]
            met, back = np.unique(user_of[pair] * table.num_rows + v, return_inverse=True)
            shared = np.bincount(back, weight[j[pair]])
            begins, v = np.divmod(met, table.num_rows)
            place, i = _spread(begins * width, edges[v], edges[v + 1], flat)
            place += i
            added = np.repeat(shared, edges[v + 1] - edges[v])
            if sparse:
                place, back = np.unique(place, return_inverse=True)
                score = np.round(np.bincount(back, added) * weight[place % width], DIGITS)
                kept = (score > 0) & ~np.isin(place, user_of * width + j)
                row, col = np.divmod(place[kept], width)
                value = score[kept]
            else:
                score = np.bincount(place, added, len(rows) * width).reshape(len(rows), -1)
                score *= weight
                score[user_of, j] = 0
                bound = np.partition(score.reshape(len(rows), -1, stretches).max(axis=1), stretches - m, axis=1)[:, stretches - m]
                row, col = np.nonzero(score >= np.maximum(bound - 2 * 10.0**-DIGITS, 10.0**-DIGITS / 4)[:, None])
                value = np.round(score[row, col], DIGITS)
                row, col, value = row[value > 0], col[value > 0], value[value > 0]
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < m
            row, col, value = row[top], col[top], value[top]
            ids = names[col]
            n = np.bincount(row, minlength=len(rows))
            for r in np.flatnonzero(n < m):
                more = fill[~np.isin(fill, names[flat[edges[rows[r]] : edges[rows[r] + 1]]]) & ~np.isin(fill, ids[row == r])][: m - n[r]]
                found.append((np.full(len(more), rows[r]), more, np.zeros(len(more))))
            found.append((rows[row], ids, value))
        if not found:
            return pa.table({"user_id": pa.array([], arrow_user), "item_id": pa.array([], arrow_item), "score": pa.array([], pa.float64())})
        who, what, score = (np.concatenate([f[c] for f in found]) for c in range(3))
        return pa.table({"user_id": table.column("user_id").combine_chunks().take(pa.array(who)), "item_id": pa.array(what.tolist(), arrow_item), "score": pa.array(score)})

    schema = StructType([StructField("user_id", user), StructField("item_id", item), *StructType.fromDDL("score double").fields])
    return near.groupBy("block").applyInArrow(cell, schema)


def _spread(name: np.ndarray, start: np.ndarray, stop: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values from start to stop of each row, and the row's name beside each."""
    n = stop - start
    place = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
    return np.repeat(name, n), values[place]


def product_blocks(t: DataFrame, m: int) -> DataFrame:
    """user_id, item_id and score: of every item block the m unseen items with the largest sums of cosine weights to the user's items.

    t holds distinct (user_id, item_id). Common users of two items are counted inside histories and summed map-side; the counts, in
    pieces of both orders by item block, pass by blocks of users, whose sums are a dense matrix of USER_BLOCK x ITEM_BLOCK. A popular item's
    neighbours are many pieces, not one row or task.
    """
    spark = t.sparkSession
    sizes = t.agg(F.approx_count_distinct("user_id").alias("u"), F.approx_count_distinct("item_id").alias("i"), F.count(F.lit(1)).alias("n")).first()
    user_blocks, item_blocks = -(-sizes["u"] // USER_BLOCK) or 1, -(-sizes["i"] // ITEM_BLOCK) or 1
    if user_blocks * item_blocks < _parallel(t):  # enough cells for all cores
        user_blocks = -(-_parallel(t) // item_blocks)
    item, user = t.schema["item_id"].dataType, t.schema["user_id"].dataType
    name = item.simpleString()
    weights = t.groupBy("item_id").agg((1 / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("w"))
    histories = t.groupBy("user_id").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    ones = histories.select(F.posexplode("items").alias("p", "a"), "items")
    counts = ones.select("a", F.explode(F.slice("items", F.col("p") + 2, F.size("items"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pieces = _packed(counts.select("a", "b", "n", _key(counts, "a", item_blocks).alias("cell_a"), _key(counts, "b", item_blocks).alias("cell_b")), name)
    own = weights.withColumn("cell", _key(weights, "item_id", item_blocks)).groupBy("cell").agg(F.collect_list(F.struct("item_id", "w")).alias("e"))
    own = own.select("cell", F.col("e.item_id").alias("ids"), F.col("e.w").alias("x"))
    users = t.join(weights, "item_id").groupBy("user_id").agg(F.collect_list(F.struct("item_id", "w")).alias("e"))
    users = users.select(_key(users, "user_id", user_blocks).alias("block"), "user_id", F.col("e.item_id").alias("ids"), F.col("e.w").alias("x"))
    no = lambda kind: F.lit(None).cast(kind)
    blocks = F.explode(F.sequence(F.lit(0), F.lit(user_blocks - 1))).alias("block")
    cells = F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))).alias("cell")
    rows = own.select(blocks, "cell", F.lit(0).alias("kind"), no(user).alias("user_id"), "ids", no(f"array<{name}>").alias("others"), "x")
    rows = rows.unionByName(users.select("block", cells, F.lit(1).alias("kind"), "user_id", "ids", no(f"array<{name}>").alias("others"), "x"))
    rows = rows.unionByName(pieces.select(blocks, "cell", F.lit(2).alias("kind"), no(user).alias("user_id"), "ids", "others", "x"))

    def run(batches):
        at, cell = None, None
        user_type = item_type = None
        for batch in batches:
            user_type, item_type = batch.schema.field("user_id").type, batch.schema.field("ids").type.value_type
            block, part, kind = (batch.column(c).to_numpy() for c in ("block", "cell", "kind"))
            for r in range(batch.num_rows):
                if (block[r], part[r]) != at:
                    if cell is not None and len(cell.users):
                        yield cell.best(m, user_type, item_type)
                    at, cell = (block[r], part[r]), ProductCell()
                ids, x = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ids", "x"))
                if kind[r] == 0:
                    cell.items(ids, x)
                elif kind[r] == 1:
                    cell.user(batch.column("user_id")[r].as_py(), ids, x)
                else:
                    cell.add(ids, batch.column("others")[r].values.to_numpy(zero_copy_only=False), x)
        if cell is not None and len(cell.users):
            yield cell.best(m, user_type, item_type)

    schema = StructType([StructField("user_id", user), StructField("item_id", item), *StructType.fromDDL("score double").fields])
    dealt = rows.repartition(user_blocks * item_blocks, "block", "cell").sortWithinPartitions("block", "cell", "kind")
    return dealt.mapInArrow(run, schema)


def _packed(counts: DataFrame, item: str) -> DataFrame:
    """Entries (j, i, n) in both orders as pieces (cell of i; ids, others, x) of many: a row for each cell that a task meets in PIECE pairs."""

    def rows(held):
        a, b, n, of_a, of_b = (np.concatenate([h[c] for h in held]) for c in range(5))
        cell = np.concatenate([of_b, of_a])
        order = np.lexsort((np.concatenate([a, b]), cell))
        j, i, x, cell = np.concatenate([a, b])[order], np.concatenate([b, a])[order], np.concatenate([n, n])[order].astype(float), cell[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        ends = pa.array(np.append(first, len(cell)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (j, i, x)]
        return pa.RecordBatch.from_arrays([pa.array(cell[first], pa.int32()), *lists], names=["cell", "ids", "others", "x"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "n", "cell_a", "cell_b")])
                n += batch.num_rows
            if n >= PIECE:
                yield rows(held)
                held, n = [], 0
        if n:
            yield rows(held)

    return counts.mapInArrow(run, f"cell int, ids array<{item}>, others array<{item}>, x array<double>")


class ProductCell:
    """The sums of one block of users over one block of items, into which entries of the neighbour matrix are added."""

    def __init__(self):
        self.ids = self.weight = self.sums = None
        self.users, self.histories, self.given = [], [], []

    def items(self, ids: np.ndarray, weight: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.weight = ids[order], weight[order]

    def user(self, user, ids: np.ndarray, weight: np.ndarray) -> None:
        self.users.append(user)
        self.histories.append(ids)
        self.given.append(weight)

    def _begin(self) -> None:
        """The histories by item: whose they are, for entries of the item's neighbours."""
        self.sums = np.zeros((len(self.users), 0 if self.ids is None else len(self.ids)))
        flat = np.concatenate(self.histories)
        owner = np.repeat(np.arange(len(self.users)), [len(h) for h in self.histories])
        order = np.argsort(flat, kind="stable")
        self.owner, self.w = owner[order], np.concatenate(self.given)[order]
        self.held, first = np.unique(flat[order], return_index=True)
        self.edges = np.append(first, len(flat))

    def add(self, j: np.ndarray, i: np.ndarray, n: np.ndarray) -> None:
        """Each user that has j gets n (the common users of j and i), times the weight of j, for i. j comes sorted."""
        if not self.users or self.ids is None:
            return
        if self.sums is None:
            self._begin()
        at = np.searchsorted(self.held, j)
        known = at < len(self.held)
        known[known] = self.held[at[known]] == j[known]
        at, column, n = at[known], np.searchsorted(self.ids, i[known]), n[known]
        first, k = self.edges[at], self.edges[at + 1] - self.edges[at]
        ends = np.cumsum(k)
        start = 0
        while start < len(at):  # as many entries at once as have ADDED sums, or one
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + ADDED, "right")))
            own = k[start:stop]
            place = np.arange(own.sum()) + np.repeat(first[start:stop] - np.cumsum(own) + own, own)
            to = self.owner[place] * len(self.ids) + np.repeat(column[start:stop], own)
            np.add.at(self.sums.reshape(-1), to, np.repeat(n[start:stop], own) * self.w[place])
            start = stop

    def best(self, m: int, user_type, item_type) -> pa.RecordBatch:
        if self.sums is None:
            self._begin()
        found, items, scores = [], [], []
        if self.ids is not None:
            column = np.searchsorted(self.ids, self.held)
            here = column < len(self.ids)
            here[here] = self.ids[column[here]] == self.held[here]
            k = np.diff(self.edges)
            self.sums *= self.weight
            np.round(self.sums, DIGITS, out=self.sums)
            self.sums.reshape(-1)[self.owner[np.repeat(here, k)] * len(self.ids) + np.repeat(column, k)[np.repeat(here, k)]] = -np.inf  # what they have seen
        for s in range(0, len(self.users), AT_ONCE):
            score = self.sums[s : s + AT_ONCE]
            row, col = best_of(score, m)
            found += [self.users[s + r] for r in row.tolist()]
            items += self.ids[col].tolist() if self.ids is not None else []
            scores.append(score[row, col])
        return pa.RecordBatch.from_arrays([pa.array(found, user_type), pa.array(items, item_type), pa.array(np.concatenate(scores))], names=["user_id", "item_id", "score"])

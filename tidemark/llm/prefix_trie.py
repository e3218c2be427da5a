"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is the sequence of its turns, each turn 16 bytes of the hash of its role and text. Spark deals sequences by
range of (sequence, conv_id), so that no first turn and no group of equal conversations is too large for a task. Each
task sorts its range: runs carry the number of leading turns that a sequence shares with the one before, runs beyond
one go to Spark's local disk, and a loser tree merges them without looking at shared turns again. The sorted stream moves
an open path of nodes; those that the next sequence leaves are finished. Nodes that several ranges share (they lie
on the paths at a range's ends) come as one part a range; all their numbers are sums, so one grouping completes them.

Defined results: rows of null conv_id belong to no conversation; null role or text is empty; rows of one conversation with
equal turn are ordered by role, then text, and repeated rows are turns of their own. conv_id % 5 has the sign of conv_id. Other
columns of the table are ignored. Without any conversation there are no rows, not even the root. A conversation's
hashes (24 bytes a turn) are one row, as a document's text is.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import pickle
import shutil
import struct
import tempfile
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small_batches, table, tidied

SYMBOL = 16
#: Bytes of a sorted run, runs merged at once, bytes of conv_ids in one piece of a shared node's list.
RUN_BYTES, FAN, PIECE = 4 << 20, 128, 1 << 16
#: Rows of finished nodes in one batch, and batches kept in memory until their parents' numbers are known.
ROWS, HELD = 4096, 8
#: Shared nodes up to which they are broadcast to their children.
FEW_SHARED = 100_000
ROOT = b"\0" * SYMBOL
HEAD = struct.Struct("<qII")


def shared(a: bytes, b: bytes, known: int) -> int:
    """Leading symbols that a and b share, of which some are known."""
    i, n, step = SYMBOL * known, min(len(a), len(b)), SYMBOL
    while i < n:
        j = min(i + step, n)
        if a[i:j] == b[i:j]:
            i, step = j, 2 * step
        elif j - i <= SYMBOL:
            break
        else:
            step = max(SYMBOL, (j - i) // (2 * SYMBOL) * SYMBOL)
    return i // SYMBOL


class Runs:
    """Sorted runs of (lcp, symbols, conv_id, sizes): the last in memory, those before it in files of a scratch folder."""

    def __init__(self, folder: str):
        self.folder, self.files, self.written = folder, [], 0

    def write(self, records) -> None:
        path = os.path.join(self.folder, f"run-{self.written}")
        self.written += 1
        with open(path, "wb") as f:
            for lcp, symbols, conv, sizes in records:
                f.write(HEAD.pack(conv, lcp, len(symbols)) + symbols + sizes)
        self.files.append(path)

    def read(self, path: str):
        with open(path, "rb") as f:
            while head := f.read(HEAD.size):
                conv, lcp, n = HEAD.unpack(head)
                symbols = f.read(n)
                yield lcp, symbols, conv, f.read(n // SYMBOL * 8)
        os.remove(path)


def sorted_run(records: list):
    """(symbols, conv_id, sizes) in order, with the symbols shared with the one before."""
    records.sort(key=lambda r: r[:2])
    before = b""
    for symbols, conv, sizes in records:
        yield shared(before, symbols, 0), symbols, conv, sizes
        before = symbols


def merged(streams: list):
    """One sorted stream of several by a loser tree that knows how much each candidate shares with the last winner."""
    k = len(streams)
    heads = [next(s, None) for s in streams]
    lcps = [0] * k
    losers = [-1] * k

    def loses(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of streams a and b, with what the loser shares with the winner noted."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if lcps[a] != lcps[b]:  # the one that shares more with the last winner comes first
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        n = shared(x[1], y[1], lcps[a])
        at, end = SYMBOL * n, SYMBOL * (n + 1)
        p, q = (x[1][at:end], x[2], a), (y[1][at:end], y[2], b)
        winner, loser = (a, b) if p < q else (b, a)
        lcps[loser] = n
        return winner, loser

    def play(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = loses(play(2 * node), play(2 * node + 1))
        return winner

    winner = play(1) if k > 1 else 0
    while heads[winner] is not None:
        _, symbols, conv, sizes = heads[winner]
        yield lcps[winner], symbols, conv, sizes
        heads[winner] = following = next(streams[winner], None)
        lcps[winner] = following[0] if following else 0
        node = (winner + k) // 2
        while node >= 1 and k > 1:
            winner, losers[node] = loses(winner, losers[node])
            node //= 2


def external_sort(records, folder: str, run_bytes: int = RUN_BYTES, fan: int = FAN):
    """records (symbols, conv_id, sizes) as a sorted stream of (lcp, symbols, conv_id, sizes)."""
    runs, held, n = Runs(folder), [], 0
    for r in records:
        held.append(r)
        n += len(r[0]) + len(r[2]) + 100
        if n >= run_bytes:
            runs.write(sorted_run(held))
            held, n = [], 0
    while len(runs.files) > fan:
        some, runs.files = runs.files[:fan], runs.files[fan:]
        runs.write(merged([runs.read(p) for p in some]))
    yield from merged([*(runs.read(p) for p in runs.files), sorted_run(held)])


class Path:
    """The open path of a sorted stream; nodes that are left are handed to `found` as lists in the order of FIELDS.

    A node is shared where it lies on the first `left` turns of the first sequence (-1: there is no range before), or on the
    prefix `right` that the last one shares with the range behind (None: there is none). Its numbers are this range's part: it is left for good, counted as its parent's child
    and freed of its own last text's bytes in the last of its ranges alone.
    """

    def __init__(self, left: int, right: bytes | None, found, piece):
        self.left, self.right, self.found, self.piece = left, right, found, piece
        self.path: list[dict] = []
        self.numbers = 0

    def node(self, depth: int, name: bytes, size: int, symbols: bytes) -> dict:
        here = {"number": self.numbers, "name": name, "depth": depth, "size": size, "least": None, "convs": 0, "children": 0, "leaves": 0, "saved": 0, "sha": None, "ids": [], "bytes": 0}
        here["before"] = depth <= self.left and self.numbers == depth  # opened by the first sequence
        here["behind"] = self.right is not None and SYMBOL * depth <= len(self.right) and symbols[: SYMBOL * depth] == self.right[: SYMBOL * depth]
        self.numbers += 1
        return here

    def leave(self, depth: int) -> None:
        """Close the nodes deeper than depth."""
        while len(self.path) > depth + 1 or (depth < 0 and self.path):
            here = self.path.pop()
            above = self.path[-1] if self.path else None
            goes_on = here["behind"] and depth < 0  # in the range behind
            if not goes_on:
                here["leaves"] += here["last"]
                here["saved"] -= here["size"]
            here["saved"] += here["convs"] * here["size"]
            if above:
                above["least"] = here["least"] if above["least"] is None else min(above["least"], here["least"])
                above["convs"] += here["convs"]
                above["children"] += not goes_on
                above["leaves"] += here["leaves"]
                above["saved"] += here["saved"]
            if here["before"] or here["behind"]:
                self.flush(here)
            self.found(here, above)

    def flush(self, here: dict) -> None:
        if here["ids"]:
            self.piece(here["name"], here["ids"])
            here["ids"], here["bytes"] = [], 0

    def add(self, lcp: int, symbols: bytes, conv: int, sizes: bytes) -> None:
        n = len(symbols) // SYMBOL
        if not self.path:
            self.path.append(self.node(0, ROOT, 0, symbols))
        if lcp < len(self.path) - 1:
            self.leave(lcp)
        if n > len(self.path) - 1:
            self.path[-1]["last"] = 0
            bytes_ = struct.unpack(f"<{n}q", sizes)
            for d in range(len(self.path), n + 1):
                name = hashlib.blake2b(self.path[-1]["name"] + symbols[SYMBOL * (d - 1) : SYMBOL * d], digest_size=SYMBOL).digest()
                self.path.append(self.node(d, name, bytes_[d - 1], symbols))
                self.path[-1]["last"] = 0
        here = self.path[-1]
        here["last"] = 1  # the last sequence through a node ends there only if the node has no child
        here["least"] = conv if here["least"] is None else min(here["least"], conv)
        here["convs"] += 1
        if here["before"] or here["behind"]:
            here["ids"].append(conv)
            here["bytes"] += 9
            if here["bytes"] >= PIECE:
                self.flush(here)
        else:
            text = str(conv)
            if here["sha"] is None:
                here["sha"] = hashlib.sha256(text.encode())
            else:
                here["sha"].update(f",{text}".encode())


NODES = "kind int, name binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, first bigint, ids string"
FULL, SHARED, PIECES = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()


def scratch() -> str:
    """A folder for one task's files in Spark's own local directories."""
    base = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.mkdtemp(prefix="prefix-trie-", dir=base if base and os.path.isdir(base) else None)


def finished_nodes(sequences, left: int, right: bytes | None, folder: str, run_bytes: int = RUN_BYTES, fan: int = FAN):
    """Lists of rows (NODES) of a range of sequences (symbols, conv_id, sizes), in pieces of ROWS.

    A node's parent is finished after it: rows wait, on disk beyond a few, until the least conv_id of each node is known by number.
    """
    least, rows, waiting = array("q"), [], []

    def keep(row):
        rows.append(row)
        if len(rows) >= ROWS:
            waiting.append(rows[:])
            rows.clear()
            if len(waiting) > HELD:
                with open(os.path.join(folder, "nodes"), "ab") as f:
                    for w in waiting:
                        pickle.dump(w, f)
                waiting.clear()

    def found(here, above):
        if here["number"] >= len(least):
            least.extend([0] * (here["number"] + 1 - len(least)))
        least[here["number"]] = here["least"]
        part = here["before"] or here["behind"]
        split = above is not None and (above["before"] or above["behind"])
        sha = None if part else here["sha"].hexdigest() if here["sha"] else EMPTY
        keep([SHARED if part else FULL, here["name"] if part else None, above["name"] if split else None, here["least"], here["depth"], None if above is None or split else above["number"],
              here["convs"], here["children"], here["leaves"], here["saved"], sha, None, None])

    def piece(name, ids):
        keep([PIECES, name, None, None, None, None, None, None, None, None, None, ids[0], ",".join(map(str, ids))])

    path = Path(left, right, found, piece)
    for r in external_sort(sequences, folder, run_bytes, fan):
        path.add(*r)
    if path.path:
        path.leave(-1)

    def named(some):
        for r in some:
            if r[5] is not None:
                r[5] = least[r[5]]
        return some

    spooled = os.path.join(folder, "nodes")
    if os.path.exists(spooled):
        with open(spooled, "rb") as f, contextlib.suppress(EOFError):
            while True:
                yield named(pickle.load(f))
    for w in (*waiting, rows):
        if w:
            yield named(w)


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (from 0), symbol (hexadecimal) and size (bytes of the text) of every turn."""
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    name = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return t.withColumn("at", at).select("conv_id", "at", F.substring(name, 1, 2 * SYMBOL).alias("symbol"), F.octet_length("text").cast("bigint").alias("size"))


def taken(conv: Column) -> Column:
    """How many turns a conversation takes from the one that it branches off."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(9)).cast("int")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """conv_id, symbols and sizes of every conversation: the first turns of the one it branches off, then its own behind as many."""
    row = lambda conv, part, at, symbol, size: F.struct(conv.alias("conv_id"), F.lit(part).alias("part"), at.alias("at"), symbol.alias("symbol"), size.alias("size"))
    c, at, symbol, size = (F.col(x) for x in ("conv_id", "at", "symbol", "size"))
    own = F.when(at >= taken(c), row(c, 1, at, symbol, size)).otherwise(row(c, 2, at, F.lit(None).cast("string"), F.lit(None).cast("bigint")))
    others = F.sequence(F.when(c > 0, 0).otherwise(1 - every), F.when(c < 0, 0).otherwise(every - 1))
    heads = F.transform(others, lambda k: row(F.try_add(c, k.cast("bigint")), 0, at, symbol, size))
    heads = F.filter(heads, lambda r: r["conv_id"].isNotNull() & (taken(r["conv_id"]) > at))
    heads = F.when((c % every == 0) & (at < most), heads).otherwise(F.filter(F.array(own), lambda r: F.lit(False)))
    rows = turns.select(F.explode(F.concat(F.array(own), heads)).alias("r")).select("r.*")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("part") < 2, F.struct("part", "at", "symbol", "size")))).alias("turns"), F.max("part").alias("whole"))
    symbols = F.unhex(F.array_join(F.transform("turns", lambda t: t["symbol"]), ""))
    return grouped.where("whole > 0").select("conv_id", symbols.alias("symbols"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def trie(sequences: DataFrame, run_bytes: int = RUN_BYTES, fan: int = FAN, ranges: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv_id, symbols, sizes)."""
    order = ("symbols", "conv_id")
    dealt = sequences.repartitionByRange(*order) if ranges is None else sequences.repartitionByRange(ranges, *order)
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()))
    ends = sorted(tuple(r) for r in dealt.groupBy("part").agg(F.min("symbols"), F.max("symbols")).collect())  # a row for each range
    ends = [(p, bytes(a), bytes(b)) for p, a, b in ends]
    common = [shared(x[2], y[1], 0) for x, y in zip(ends, ends[1:])]
    sides = {p: (common[i - 1] if i else -1, last[: SYMBOL * common[i]] if i < len(common) else None) for i, (p, _, last) in enumerate(ends)}

    def run(batches):
        part = []

        def records():
            for batch in batches:
                if batch.num_rows and not part:
                    part.append(batch.column("part")[0].as_py())
                for symbols, conv, sizes in zip(batch.column("symbols"), batch.column("conv_id").to_pylist(), batch.column("sizes").to_pylist()):
                    yield symbols.as_py(), conv, struct.pack(f"<{len(sizes)}q", *sizes)

        stream = records()
        first = next(stream, None)
        if first is None:
            return
        left, right = sides[part[0]]
        folder = scratch()
        try:
            for rows in finished_nodes(chain([first], stream), left, right, folder, run_bytes, fan):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    small_batches(sequences.sparkSession)
    nodes = materialise(dealt.mapInArrow(tidied(run), NODES))
    return completed(nodes)


NAMES = [c.split()[0] for c in NODES.split(", ")]
TYPES = [{"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]] for c in NODES.split(", ")]
NUMBERS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def list_hashes(pieces: DataFrame) -> DataFrame:
    """name and the hash of the comma-joined ids of its pieces, a stream in order of their first ids."""

    def run(batches):
        name, sha, out = None, None, []
        for batch in batches:
            for n, ids in zip(batch.column("name").to_pylist(), batch.column("ids").to_pylist()):
                if n != name:
                    if name is not None:
                        out.append((name, sha.hexdigest()))
                    name, sha = n, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
        if name is not None:
            out.append((name, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], names=["name", "ends"])

    return pieces.select("name", "first", "ids").repartition("name").sortWithinPartitions("name", "first").mapInArrow(run, "name binary, ends string")


def completed(nodes: DataFrame) -> DataFrame:
    """The finished nodes and, from their parts, the shared ones, with their parents' conv_id."""
    parts = nodes.where(F.col("kind") == SHARED).groupBy("name").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in NUMBERS))
    whole = materialise(parts.join(list_hashes(nodes.where(F.col("kind") == PIECES)), "name", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))))
    columns = ["conv_id", "depth", "parent_conv_id", *NUMBERS, "ends_sha256"]
    own = whole.select("parent", "conv_id", "depth", F.lit(None).cast("bigint").alias("parent_conv_id"), *NUMBERS, "ends_sha256")
    both = nodes.where(F.col("kind") == FULL).select("parent", *columns).unionByName(own)
    above = whole.select(F.col("name").alias("parent"), F.col("conv_id").alias("above"))
    if whole.count() <= FEW_SHARED:
        above = F.broadcast(above)
    return both.join(above, "parent", "left").select(*(F.coalesce("parent_conv_id", "above").alias(c) if c == "parent_conv_id" else F.col(c) for c in columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(own_turns(table(spark, sf_dir, "conversations"))))


def oracle_sql() -> str:
    """DuckDB: every prefix of every rebuilt conversation as a list, grouped; the checksum bit by bit."""
    return """
with ids as (select distinct conv_id from conversations where conv_id is not null),
steps as (select conv_id, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as s from ids),
h as (select conv_id, xor(list_reduce(list_prepend(4294967295, s), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, case when a & 1 = 1 then 3988292384 else 0 end) end), 4294967295) % 9 as h from steps),
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n from conversations where conv_id is not null),
r as (select h.conv_id, t.n, 0 as part, role, text from h join t on t.conv_id = h.conv_id - h.conv_id % 5 and t.n <= h.h
 union all select h.conv_id, t.n, 1, role, text from h join t on t.conv_id = h.conv_id and t.n > h.h),
s as (select h.conv_id, coalesce(any_value(q.turns), []) as turns from h left join (select conv_id, list({'role': role, 'text': text} order by part, n) as turns from r group by conv_id) q on q.conv_id = h.conv_id group by h.conv_id),
p as (select conv_id, len(turns) as len, unnest(range(len(turns) + 1)) as d, turns from s),
member as (select conv_id, d, turns[1:d] as prefix, len = d as ends from p),
node as (select d, prefix, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256,
 (count(*) - 1) * (case when d > 0 then strlen(prefix[d].text) else 0 end) as own from member group by d, prefix),
family as (select n.d, n.prefix, count(*) as n_children from node c join node n on n.d = c.d - 1 and n.prefix = c.prefix[1:c.d - 1] where c.d > 0 group by n.d, n.prefix),
rated as (select n.*, coalesce(f.n_children, 0) as n_children from node n left join family f on f.d = n.d and f.prefix = n.prefix),
below as (select a.d, a.prefix, sum(x.own) as saved_tokens, count(*) filter (where x.n_children = 0) as n_leaves from rated a join rated x on x.d >= a.d and x.prefix[1:a.d] = a.prefix group by a.d, a.prefix)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens::bigint as saved_tokens, n.ends_sha256
from rated n join below b on b.d = n.d and b.prefix = n.prefix left join node u on n.d > 0 and u.d = n.d - 1 and u.prefix = n.prefix[1:n.d - 1]"""

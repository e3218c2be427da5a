"""Best-fit packing: pattern packing by non-negative least squares (operator 2).

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most
``capacity`` numbers) goes to the driver, where the plan is made:

1. enumerate the patterns of one to three lengths that fill a sequence exactly;
2. fit repeat counts x >= 0 to the histogram h by least squares, min |A x - h|, by accelerated
   projected gradients on the sparse pattern matrix A;
3. round the counts so that their running sum is kept, and cut them to what the histogram holds;
4. pack the residual lengths best-fit in decreasing order, all pieces of a length at a time.

The plan is a list of slots for each length. Each piece takes the slot of its rank among the pieces
of its length; ranks come from windows over (length, salt), with the counts of the salts before
added. The salts of a length follow its count, so one length held by a third of all pieces is dealt over many tasks.

Defined results: a null or empty text is a piece with the end token alone; repeated rows are packed
each; an empty table gives no rows; extra columns of the pieces are kept.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, Recent, sliced, tidied, utf8

CAPACITY = 2048
#: Pieces of a length that meet in a task for their ranks, on the average, in more than SALTS tasks; up to there 256.
SALTED, SALTS = 1 << 16, 64
#: Gradient steps of the least-squares fit.
STEPS = 150
#: Stems and tails remembered in a Python worker; up to twice as many are held.
CACHE = 300_000
#: Kind of each byte: 0 blank, 1 ASCII punctuation, 2 ASCII letter or digit, 3 other.
KINDS = np.array([0 if c in b" \n\t\r" else 3 if c > 126 or c < 33 else 2 if chr(c).isalnum() else 1 for c in range(256)], np.uint8)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Tokens:
    """Ids of texts by a tokenizer that drops blanks, met words being remembered.

    Blanks always part words (its pattern matches no blank), letters are lower-cased one by one, and
    a match never joins the last letter of a word to punctuation behind it; so a text's ids are those
    of its words, and a word's are those of its stem and its tail, the ASCII punctuation at its end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.parts = Recent(CACHE)

    def known(self, parts: list[str]) -> list[bytes]:
        """The ids (unsigned, 32 bits) of different stems and tails."""
        new = self.parts.missing(set(parts))
        for part, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.parts.new[part] = array("I", e.ids).tobytes()
        return list(map(self.parts.new.__getitem__, parts))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and the place where each text's begin (n + 1 of them).

        Arrow tells the parts apart and numbers them: a string array over the texts' own bytes whose
        elements are runs of blanks, stems and tails.
        """
        body, at = utf8(texts)
        if not len(body):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        kind = KINDS[body]
        edge = np.ones(len(body) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[at] = True
        cuts = np.flatnonzero(edge)
        kind = np.append(kind[cuts[:-1]], 0)  # of each run of a kind
        first = np.zeros(len(cuts), bool)
        first[np.searchsorted(cuts, at)] = True
        tail = (kind[1:] == 1) & (kind[:-1] == 2) & ~first[1:]
        tail[:-1] &= (kind[2:] == 0) | first[2:]
        cut = first | (kind == 0)
        cut[1:] |= (kind[:-1] == 0) | tail
        cut[-1] = True
        cuts = cuts[cut].astype(np.int32)
        runs = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(LOWER[body])]).dictionary_encode()
        number = runs.indices.to_numpy()
        ids = self.known(runs.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        n = size[number]
        ends = np.cumsum(n)
        out = flat[np.repeat(begin[number] - (ends - n), n) + np.arange(ends[-1])]
        return out, np.concatenate([[0], ends])[np.searchsorted(cuts, at)]


@functools.lru_cache(maxsize=1)
def loaded(path: str) -> Tokens:
    """Kept by a Python worker for its next tasks."""
    return Tokens(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id") -> DataFrame:
    """key, piece, start, length and ids (unsigned little-endian 32-bit) of each text's pieces; end_id closes each text."""
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

    def run(batches):
        tokens = loaded(tokenizer)
        for batch in sliced(batches, "text", 4 << 20):
            ids, at = tokens(batch.column("text"))
            ids, at = np.insert(ids, at[1:], end_id), at + np.arange(len(at))
            many = -(-np.diff(at) // capacity)
            row = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(np.diff(at)[row] - start, capacity)
            edges = np.append(at[row] + start, at[-1]).astype(np.int32) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u4"))])],
                names=[key, "piece", "start", "length", "ids"],
            )

    fields = [docs.select(key).schema.fields[0], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())]
    return docs.select(key, "text").mapInArrow(tidied(run), StructType(fields))


def patterns(capacity: int) -> np.ndarray:
    """(n, 3) lengths, falling, of which one to three (the others 0) sum to capacity."""
    a, b = np.meshgrid(np.arange(capacity + 1), np.arange(capacity + 1), indexing="ij")
    keep = (b <= a) & (a + b <= capacity) & (capacity - a - b <= b)
    a, b = a[keep], b[keep]
    return np.stack([a, b, capacity - a - b], axis=1).astype(np.int32)


def fit(pattern: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 with least |A x - histogram|^2, where A counts the lengths of each pattern."""
    size = len(histogram)
    usage = np.bincount(pattern.ravel(), minlength=size).astype(float)
    usage[0] = 0
    flat = pattern.ravel()
    forward = lambda x: np.bincount(flat, np.repeat(x, 3), size)
    target = histogram.astype(float)
    target[0] = 0
    # bound of the largest eigenvalue of A'A: rows of A sum to usage, columns to 3 at most
    rate = 1.0 / (3.0 * max(1.0, usage.max()))
    x = np.zeros(len(pattern))
    y, t = x, 1.0
    for _ in range(steps):
        rest = forward(y) - target
        rest[0] = 0
        new = np.maximum(0, y - rate * rest[pattern].sum(axis=1))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


class Plan:
    """Slots for the pieces of each length: the n-th piece goes to slot n."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.slots: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.slots[length].append((count, sequence, offset))

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def arrays(self) -> tuple[np.ndarray, ...]:
        """start, sequence, offset of each run of slots, which are numbered by length."""
        runs = [x for s in self.slots for x in s]
        start = np.concatenate([[0], np.cumsum([c for c, _, _ in runs])]).astype(np.int64)[:-1]
        return start, np.array([s for _, s, _ in runs], np.int64), np.array([o for _, _, o in runs], np.int64)


def make_plan(histogram: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> Plan:
    """histogram: number of pieces of each length from 0 to capacity."""
    plan, left = Plan(capacity), histogram.astype(np.int64).copy()
    known = patterns(capacity)
    # only patterns of lengths that occur can be used
    known = known[((left[known] > 0) | (known == 0)).all(axis=1)]
    if len(known):
        x = fit(known, left, steps)
        run = np.cumsum(x)
        count = np.floor(run + 0.5).astype(np.int64)
        count = np.diff(count, prepend=0)
        for i in np.flatnonzero(count).tolist():
            lengths, n = [v for v in known[i].tolist() if v], int(count[i])
            for v in set(lengths):
                n = min(n, int(left[v]) // lengths.count(v))
            if n > 0:
                sequence, offset = plan.open(n), 0
                for v in lengths:
                    plan.place(v, n, sequence, offset)
                    left[v] -= n
                    offset += v
    # residual: open sequences by what remains in them, as (first sequence, count)
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for v in range(capacity, 0, -1):
        n, at = int(left[v]), v
        while n:
            while at <= capacity and not room[at]:
                at += 1
            if at <= capacity:
                sequence, count = room[at].pop()
                use = min(n, count)
                plan.place(v, use, sequence, capacity - at)
                if count > use:
                    room[at].append((sequence + use, count - use))
                if at > v:
                    room[at - v].append((sequence, use))
                    at = min(at, max(v, at - v))
                n -= use
            else:
                each = min(capacity // v, n)
                count = n // each
                sequence = plan.open(count)
                for k in range(each):
                    plan.place(v, count, sequence, k * v)
                room[capacity - each * v].append((sequence, count))
                n -= each * count
                at = v
    return plan


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, salted: int = SALTED) -> DataFrame:
    """pieces (with length) and sequence_id and offset; order: columns that tell the pieces of a length apart.

    The pieces of a length are dealt over a salt for each `salted` of them, and over up to SALTS in any case.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    own = [c for c in pieces.columns if c not in {"sequence_id", "offset", "_salt", "_salts", "_rank"}]
    spark, pieces = pieces.sparkSession, materialise(pieces.select(*own))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each length
        histogram[r["length"]] = r["n"]
    salts = np.maximum(-(-histogram // salted), np.clip(-(-histogram // 256), 1, SALTS))
    many = spark.createDataFrame([(v, int(salts[v])) for v in range(capacity + 1)], "length long, _salts int")
    dealt = pieces.join(F.broadcast(many), "length").withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts")).cast("int"))
    start, sequence, offset = make_plan(histogram, capacity).arrays()
    column = np.cumsum(salts) - salts  # where each length's salts begin
    counts = np.zeros(int(salts.sum()), np.int64)
    for r in dealt.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).collect():  # at most SALTS rows for each length, and one for each `salted` pieces
        counts[column[r["length"]] + r["_salt"]] = r["n"]
    before = np.cumsum(counts) - counts  # lengths and their salts are numbered as the slots are
    shared = spark.sparkContext.broadcast((column, before, start, sequence, offset))

    def run(batches):
        column, before, start, sequence, offset = shared.value
        for b in batches:
            length, salt, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_rank"))
            slot = before[column[length] + salt] + rank - 1
            at = np.searchsorted(start, slot, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(sequence[at] + slot - start[at]), pa.array(offset[at])], names=[*own, "sequence_id", "offset"])

    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)))
    fields = [pieces.schema[c] for c in own]
    return ranked.mapInArrow(tidied(run), StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Digest of the pieces of all texts and their places."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = token_pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of all pieces of all documents."""
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

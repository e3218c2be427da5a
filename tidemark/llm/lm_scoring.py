"""LM scoring: online logistic context mixing of hashed-context bit predictors (operator 4).

A text is its UTF-8 bytes and an end symbol; each symbol is a row of binary decisions along a Huffman
tree that depends on the bytes before (so the decisions add up to a proper probability). Four
predictors give each decision a log-odds from counts of a hashed context: the byte before, three
bytes before, the beginning of the word, and that with the word before. A gate, chosen by how sure
the two word predictors are, picks the weights that combine them; a second stage refines the mixed
probability by what came true at that gate and level.

All parts learn from training documents alone, and all training documents take part:

1. symbols are counted behind the pairs of bytes before them, for the trees;
2. six sevenths of the training documents are counted into the tables of the predictors: every task
   adds up its own tables, the sums meet block by block;
3. on the last seventh the weights are learnt online, block after block, in each partition, and
   averaged by the number of decisions; the refining stage counts what came true.

The tables grow with the root of the training text (table_bits()), as different contexts about do, up
to 2^MOST_BITS slots a predictor, which bounds what an executor holds. Scoring is one pass over the
whole texts.

The plain base of the contract (add-one word counts) needs the count of every different word: each
batch of texts (a chunk) sends the 64-bit hashes of its different words and their counts to shards; a shard
adds them up and replies each word's whole count to every chunk that has it, where the documents'
sums are made. A word, however common, is one number a chunk on both ways.

Defined results: a null or empty text is its end symbol and end token; a null doc_id is taken as
empty text for the split; repeated rows are each learnt from and scored, texts that share a doc_id each
by themselves; empty in, empty out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, materialise, null_safe_text, sliced, tidied, utf8
from .near_dedup import _BLANK, _GOLD, _LOWER, _M1, _M2, _P, _PINV, mix, powers, word_hashes

END = 256
#: Bits of a slot's number: fewest, and most (48 MB of tables in an executor, 400 MB of counts in a counting task).
LEAST_BITS, MOST_BITS = 16, 24
#: Slots of each block in which the tables of the tasks are added up.
BLOCK = 1 << 16
PREDICTORS = 4
CHUNK = 1 << 17
#: Pairs of bytes that have a tree of their own.
PAIRS = 512
#: Place of the log-odds in a decision.
ODDS = 32
#: Steps from -REACH to REACH to which mixed log-odds are rounded for the cost of a decision.
COSTS = 1024
#: Weight blocks: decisions between two updates of the weights.
STEP = 1 << 16
LEVELS, REACH = 33, 8.0
HELD_OUT, TUNED, FOLDS = 2, 3, 7
SHARD_BYTES = 24 << 20


def table_bits(n_bytes: int) -> int:
    """Bits of a slot's number for so many bytes of training text: different contexts grow about as the root of a text."""
    return min(MOST_BITS, max(LEAST_BITS, 6 + -(-max(1, n_bytes).bit_length() // 2)))


class Codes:
    """Binary decisions of each symbol in the tree of the bytes before it, with the log-odds of each node, and what a node does to a context's slot (of 2^width).

    before: counts of (byte before, symbol). pairs: pairs of bytes (first * 256 + second) that have a tree of
    their own, and the counts of the symbols behind each; behind other pairs the tree is that of the second byte.
    """

    def __init__(self, before: np.ndarray, pairs: np.ndarray | None = None, behind: np.ndarray | None = None, width: int = 21):
        pairs = np.zeros(0, np.int64) if pairs is None else pairs
        counts = np.concatenate([before, behind]) if len(pairs) else before
        self.tree = np.tile(np.arange(256), 256)  # of each pair
        self.tree[pairs] = 256 + np.arange(len(pairs))
        start, length, path, n = np.zeros((len(counts), 257), np.int64), np.zeros((len(counts), 257), np.int64), [], 0
        first = before.sum(axis=0) * 1e-4 + 1e-3
        total = 0
        for t, row in enumerate(counts):
            heap = [(float(c), s) for s, c in enumerate(row + first)]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            inner = 257
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                parent[a[1]], parent[b[1]] = (inner, 0), (inner, 1)
                heapq.heappush(heap, (a[0] + b[0], inner))
                inner += 1
            came = np.zeros((257 + 256, 2))  # of each inner node: how often 0 and 1
            weight = np.zeros(257 + 256)
            weight[:257] = row
            for at in range(257 + 255):  # children come before their parents
                up, bit = parent[at]
                weight[up] += weight[at]
                came[up, bit] = weight[at]
            odds = _odds(came[:, 1], came[:, 0]).tolist()
            own: list[int] = []  # bit, node and odds of each decision
            for s in range(257):
                at, up = s, []
                while at in parent:
                    at, bit = parent[at]
                    up += (odds[at], n + at - 257, bit)
                start[t, s], length[t, s] = total + len(own) // 3, len(up) // 3
                own += reversed(up)
            path.append(np.array(own, np.int64).reshape(-1, 3))
            total += len(path[-1])
            n += 256
        self.start, self.length, self.width = start.ravel(), length.ravel().astype(np.uint8), width
        bit, node, odds = np.concatenate(path).T
        with np.errstate(over="ignore"):
            spread = (mix(node.astype(np.uint64) + np.uint64(77)) >> np.uint64(64 - width)).astype(np.int64)
        #: Of each decision of each path: its bit, what it does to a slot, and above ODDS the node's own log-odds as a byte.
        self.path = odds.astype(np.uint8).astype(np.int64) << ODDS | spread << 1 | bit


def _odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Log-odds in sixteenths."""
    return np.clip(np.rint(16 * np.log((ones + 0.4) / (zeros + 0.4))), -127, 127).astype(np.int8)


def symbols(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with the end of each text, the byte before each (0 at a start), and where each text begins (n + 1)."""
    begin = at + np.arange(len(at))
    out = np.full(begin[-1], END, np.int64)
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    out[inside] = body
    return out, _earlier(out, begin), begin


def _earlier(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """What stands before each place of its text, 0 at a start."""
    out = np.zeros(len(x), x.dtype)
    out[1:] = x[:-1]
    out[begin[:-1]] = 0
    return out


def contexts(sym: np.ndarray, before: np.ndarray, two: np.ndarray, begin: np.ndarray, width: int) -> list[np.ndarray]:
    """For each symbol a slot (of 2^width) for the contexts of three bytes, of the word's beginning, and of that and the word before."""
    n = len(sym)
    with np.errstate(over="ignore"):
        three = before + (two << 8) + (_earlier(two, begin) << 16)
        low = np.minimum(sym, 255).astype(np.uint8)
        first = np.zeros(n, bool)
        first[1:] = _BLANK[low[:-1]]
        first[begin[:-1]] = True
        words = np.flatnonzero(first)
        size = np.diff(words, append=n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWER[low] * powers(_P, n), out=total[1:])
        prefix = total[:n] - np.repeat(total[words], size)
        prefix *= np.repeat(powers(_PINV, n + 1)[words], size)
        last = prefix[words - 1] * _M2 + _GOLD
        last[np.searchsorted(words, begin[:-1])] = 0  # none in a text's first word
        pair = prefix * np.uint64(3)
        pair += np.repeat(last, size)
        out = []
        for x in (three.astype(np.uint64), prefix + np.uint64(12345), pair):
            x = x ^ (x >> np.uint64(31))
            x *= _GOLD
            x >>= np.uint64(64 - width)
            out.append(x.view(np.int64))
        return out


def decisions(codes: Codes, body: np.ndarray, at: np.ndarray):
    """Level after level of the trees: the symbols (by a place in one order, in which those that go deeper come first) and, for the first of them, their decisions (of Codes.path) and doubled slots with the bit of each hashed predictor.

    First comes that order.
    """
    sym, before, begin = symbols(body, at)
    two = _earlier(before, begin)
    at_pair = codes.tree[two * 256 + before] * 257 + sym
    n = codes.length[at_pair]
    order = np.argsort(np.uint8(255) - n, kind="stable")
    yield order
    start = codes.start[at_pair[order]]
    context = [2 * c[order] for c in contexts(sym, before, two, begin, codes.width)]
    left = len(n) - np.cumsum(np.bincount(n))  # symbols that go deeper than each level
    for level in range(int(n.max(initial=0))):
        m = int(left[level])
        path = codes.path[start[:m] + level]
        moved = path & ((2 << codes.width) - 1)
        yield path, [c[:m] ^ moved for c in context]


SURE = np.array([0 if v == 0 else 1 if abs(v) < 24 else 2 for v in [*range(128), *range(-128, 0)]], np.uint8)  # indexed by the byte


def looked_up(tables: list[np.ndarray], path: np.ndarray, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(predictors, decisions) log-odds in sixteenths, the gate and the bit of each decision."""
    x = np.empty((PREDICTORS, len(path)), np.int8)
    x[0] = path >> ODDS
    for k, (t, s) in enumerate(zip(tables, slots)):
        np.take(t, s >> 1, out=x[k + 1])
    return x, SURE[x[3].view(np.uint8)] * 3 + SURE[x[2].view(np.uint8)], path & 1


GATES = 9


class Mixer:
    def __init__(self):
        self.weights = np.full((GATES, PREDICTORS + 1), 0.35, np.float32)
        self.weights[:, -1] = 0
        self.grown = np.full(self.weights.shape, 1.0)
        self.came = np.zeros((GATES * LEVELS, 2))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.weights.astype(np.float32)
        z = w[:, -1][gate]
        for k in range(len(x)):
            z += w[:, k][gate] * (x[k] * np.float32(1 / 16))
        return np.clip(z, -REACH * 1.3, REACH * 1.3)

    @staticmethod
    def level(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate.astype(np.int64) * LEVELS + np.clip(np.rint((z + np.float32(REACH)) * np.float32((LEVELS - 1) / (2 * REACH))), 0, LEVELS - 1).astype(np.int64)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        """One step down the gradient of the coding cost of these decisions, and the counts of the refining stage."""
        z = self.mixed(x, gate)
        rest = bit - 1 / (1 + np.exp(-z))
        step = np.zeros(self.weights.shape)
        for k in range(len(x)):
            step[:, k] = np.bincount(gate, rest * x[k] * (1 / 16), GATES)
        step[:, -1] = np.bincount(gate, rest, GATES)
        step /= np.sqrt(len(bit))
        self.grown += step**2
        self.weights = (self.weights + 0.05 * step / np.sqrt(self.grown)).astype(np.float32)
        at = self.level(z, gate)
        for b in (0, 1):
            self.came[:, b] += np.bincount(at[bit == b], minlength=GATES * LEVELS)

    def refined(self) -> np.ndarray:
        centre = 1 / (1 + np.exp(-np.tile(np.linspace(-REACH, REACH, LEVELS), GATES)))
        return ((self.came[:, 1] + 4 * centre) / (self.came.sum(axis=1) + 4)).astype(np.float32)

    def chance(self, z: np.ndarray, gate: int, refined: np.ndarray) -> np.ndarray:
        """The probability of 1 at mixed log-odds z: half from them, half from what came true near them."""
        came = np.interp(z, np.linspace(-REACH, REACH, LEVELS), refined[gate * LEVELS : (gate + 1) * LEVELS])
        return 0.5 / (1 + np.exp(-z)) + 0.5 * came


class Costs:
    """What a decision costs, by tables, for log-odds rounded to COSTS steps (so the two bits still have probabilities that add up to 1)."""

    def __init__(self, mixer: Mixer, refined: np.ndarray):
        w = mixer.weights.astype(np.float64)
        odds = np.arange(256, dtype=np.uint8).view(np.int8) / 16
        last, word = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
        gate = SURE[last] * np.int64(3) + SURE[word]
        scale = COSTS / (2 * REACH)
        step = lambda z: (scale * z).astype(np.float32)
        words = step(w[gate, 3] * odds[last] + w[gate, 2] * odds[word] + w[gate, -1])
        self.first, self.third = (step(w[:, k : k + 1] * odds[None, :]).ravel() for k in (0, 1))
        least, most = (int(f(words) + f(self.first) + f(self.third)) for f in (np.min, np.max))
        self.words = (words - np.float32(least - 2.5)).ravel()  # so that cutting rounds, and no step is negative
        self.gate, self.steps = (gate * 256).ravel(), most - least + 5
        p = np.stack([mixer.chance(np.clip((np.arange(self.steps) + least - 2) / scale, -1.3 * REACH, 1.3 * REACH), g, refined) for g in range(GATES)])
        self.cost = -np.log2(np.stack([1 - p, p], axis=1)).ravel()  # by gate, bit, step

    def __call__(self, tables: list[np.ndarray], path: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
        """Bits that each decision costs."""
        three, word, last = (t[s >> 1].view(np.uint8) for t, s in zip(tables, slots))
        pair = last.astype(np.int64) << 8
        pair |= word
        gate = self.gate[pair]
        z = self.words[pair]
        z += self.first[gate + (path >> ODDS)]
        z += self.third[gate + three]
        at = z.astype(np.int64)
        gate >>= 7
        gate |= path & 1
        gate *= self.steps
        at += gate
        return self.cost[at]


def _texts(docs: DataFrame, *folds: int) -> DataFrame:
    return docs.where(F.col("_fold").isin(list(folds))).select("text")


def fit_codes(docs: DataFrame) -> Codes:
    """The trees of single bytes and of the PAIRS most frequent pairs, from what comes behind them in all texts."""

    def run(batches):
        total = np.zeros(65536 * 257, np.int32)
        for batch in sliced(batches, "text", 4 * CHUNK):
            sym, before, begin = symbols(*utf8(batch.column("text")))
            np.add.at(total, (_earlier(before, begin) * 256 + before) * 257 + sym, np.int32(1))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // 257, pa.int32()), pa.array(at % 257, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "symbol", "n"])

    counts = materialise(docs.mapInArrow(tidied(run), "pair int, symbol int, n long").groupBy("pair", "symbol").agg(F.sum("n").alias("n")))
    before = np.zeros((256, 257), np.int64)
    for r in counts.groupBy(F.pmod("pair", F.lit(256)).alias("before"), "symbol").agg(F.sum("n").alias("n")).collect():  # at most 65,792 rows
        before[r["before"], r["symbol"]] = r["n"]
    most = counts.groupBy("pair").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "pair").limit(PAIRS)
    pairs = sorted(r["pair"] for r in most.collect())
    place, behind = {p: i for i, p in enumerate(pairs)}, np.zeros((len(pairs), 257), np.int64)
    for r in counts.where(F.col("pair").isin(pairs)).collect():  # at most 257 rows a pair
        behind[place[r["pair"]], r["symbol"]] = r["n"]
    return Codes(before, np.array(pairs, np.int64), behind, table_bits(int(before.sum())))


def fit_tables(docs: DataFrame, codes: Codes) -> list[np.ndarray]:
    """Log-odds in sixteenths of each hashed predictor's slots, from counts over all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches):
        codes = shared.value
        tables = [np.zeros(2 << codes.width, np.int32) for _ in range(PREDICTORS - 1)]
        for batch in sliced(batches, "text", CHUNK):
            levels = decisions(codes, *utf8(batch.column("text")))
            next(levels)
            for _, slots in levels:
                for t, s in zip(tables, slots):
                    np.add.at(t, s, np.int32(1))  # of the table's own type: many times faster
        press = zstandard.ZstdCompressor(level=1)
        for k, t in enumerate(tables):
            for b in range(0, len(t), 2 * BLOCK):
                part = t[b : b + 2 * BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b // (2 * BLOCK)], pa.int32()), pa.array([press.compress(part.tobytes())], pa.binary())], names=["k", "block", "counts"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:  # one after another: a sum is held, not what is summed
            for c in batch.column("counts"):
                total = total + np.frombuffer(open_.decompress(c.as_py()), np.int32)
        odds = _odds(total[1::2], total[::2])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([odds.tobytes()], pa.binary())], names=["k", "block", "odds"])

    out = [np.zeros(1 << codes.width, np.int8) for _ in range(PREDICTORS - 1)]
    counted = docs.mapInArrow(tidied(run), "k int, block int, counts binary")
    for r in counted.groupBy("k", "block").applyInArrow(add, "k int, block int, odds binary").collect():  # at most 3 * 2^MOST_BITS bytes
        part = np.frombuffer(r["odds"], np.int8)
        out[r["k"]][r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out


def fit_mixer(docs: DataFrame, codes: Codes, tables: list[np.ndarray]) -> Mixer:
    shared = docs.sparkSession.sparkContext.broadcast((codes, tables))

    def run(batches):
        codes, tables = shared.value
        mixer, seen = Mixer(), 0
        for batch in sliced(batches, "text", CHUNK):
            levels = decisions(codes, *utf8(batch.column("text")))
            next(levels)
            parts = [looked_up(tables, path, slots) for path, slots in levels]
            x, gate, bit = (np.concatenate(p, axis=-1) for p in zip(*parts))
            steps = -(-len(bit) // STEP)
            for i in range(steps):  # each step sees all levels
                mixer.learn(x[:, i::steps], gate[i::steps], bit[i::steps])
            seen += len(bit)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([mixer.weights.ravel().tolist()], pa.list_(pa.float64())), pa.array([mixer.came.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "weights", "came"])

    rows = docs.mapInArrow(tidied(run), "n long, weights array<double>, came array<double>")
    long = rows.select("n", F.posexplode(F.concat(F.transform("weights", lambda w: w * F.col("n")), "came")).alias("i", "v"))
    found = {r["i"]: (r["v"], r["n"]) for r in long.groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}
    mixer = Mixer()
    if found:
        size = mixer.weights.size
        mixer.weights = np.array([found[i][0] / found[i][1] for i in range(size)], np.float32).reshape(mixer.weights.shape)
        mixer.came = np.array([found[size + i][0] for i in range(mixer.came.size)]).reshape(mixer.came.shape)
    return mixer


def score(docs: DataFrame, codes: Codes, tables: list[np.ndarray], mixer: Mixer) -> DataFrame:
    """docs without text, with n_bytes and bits: the total coding cost of each text with its end."""
    shared = docs.sparkSession.sparkContext.broadcast((codes, tables, Costs(mixer, mixer.refined())))

    def make():
        codes, tables, costs = shared.value

        def work(batch):
            body, at = utf8(batch.column("text"))
            levels = decisions(codes, body, at)
            text = np.repeat(np.arange(len(at) - 1), np.diff(at) + 1)[next(levels)]
            total = np.zeros(len(text))
            for path, slots in levels:
                total[: len(path)] += costs(tables, path, slots)
            return [pa.array(np.diff(at)), pa.array(np.bincount(text, total, len(at) - 1))]

        return work

    return append_columns(docs, make, "n_bytes long, bits double", CHUNK, drop=("text",))


def unigram(docs: DataFrame) -> DataFrame:
    """doc_id, _h, n_tokens, n_known, log_sum (of log10(c + 1)) of each row of docs (doc_id, _h, text, _train), and train_tokens and train_types of all."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    end = mix(np.array([987654321], np.uint64))

    def send(batches):
        for k, batch in enumerate(sliced(batches, "text", 2 << 20)):
            h, first = word_hashes(*utf8(batch.column("text")))
            n = np.diff(first) + 1
            doc = np.repeat(np.arange(len(n)), n)
            words = np.empty(n.sum(), np.uint64)
            ends = np.cumsum(n) - 1
            inside = np.ones(len(words), bool)
            inside[ends] = False
            words[inside], words[ends] = h, end[0]
            order = np.argsort(words)
            order = order[np.argsort((words[order] % np.uint64(shards)).astype(np.uint32), kind="stable")]
            words, doc = words[order], doc[order].astype(np.uint32)
            new = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            kind = words[new]
            train = np.add.reduceat(batch.column("_train").to_numpy(zero_copy_only=False).astype(np.int64)[doc], new)
            many = np.diff(np.append(new, len(words)))
            cuts = np.searchsorted((kind % np.uint64(shards)).astype(np.int64), np.arange(shards + 1))
            press = zstandard.ZstdCompressor(level=1).compress
            task = TaskContext.get().partitionId()
            rows = [(s, press(kind[a:b].tobytes()), press(train[a:b].astype(np.uint32).tobytes()), *(None,) * 5) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            # what the chunk needs to use the replies: the documents of its words, in the order in which they were sent
            rows.append((-1 - (task << 32 | k), None, None, press(many.astype(np.uint32).tobytes()), press(doc.tobytes()), batch.column("doc_id").to_pylist(), batch.column("_h").to_pylist(), n.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{task}/{k}"] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4)), *(pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in (5, 6, 7))],
                names=["chunk", "shard", "words", "train", *own],
            )

    own = ["many", "docs", "ids", "own", "n"]
    kept = "many binary, docs binary, ids array<long>, own array<long>, n array<long>"

    def reply(table):
        k = len(table)
        if table.column("shard")[0].as_py() < 0:  # a chunk's own
            counts, tokens, types = [None] * k, 0, 0
        else:
            open_ = zstandard.ZstdDecompressor().decompress
            column = lambda c, kind: [np.frombuffer(open_(x.as_py()), kind) for x in table.column(c)]
            words = column("words", np.uint64)
            kinds, at = np.unique(np.concatenate(words), return_inverse=True)
            count = np.bincount(at, np.concatenate(column("train", np.uint32)), len(kinds)).astype(np.int64)
            press = zstandard.ZstdCompressor(level=1).compress
            counts = [press(count[x].tobytes()) for x in np.split(at, np.cumsum([len(w) for w in words])[:-1])]
            tokens, types = int(count.sum()), int((count > 0).sum())
        one = [0] * (k - 1)
        new = {"counts": pa.array(counts, pa.binary()), "tokens": pa.array([tokens, *one], pa.int64()), "types": pa.array([types, *one], pa.int64())}
        return pa.table({**{c: table.column(c) for c in ("chunk", "shard", *own)}, **new})

    sent = docs.mapInArrow(tidied(send), f"chunk string, shard long, words binary, train binary, {kept}")
    replied = materialise(sent.groupBy("shard").applyInArrow(reply, f"chunk string, shard long, {kept}, counts binary, tokens long, types long"))
    total = replied.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("types"), F.lit(0)).alias("v")).first()

    def join(table):
        chunk, *rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
        open_ = zstandard.ZstdDecompressor().decompress
        count = np.concatenate([np.frombuffer(open_(r["counts"]), np.int64) for r in rows])
        many, doc = (np.frombuffer(open_(chunk[c]), np.uint32) for c in ("many", "docs"))
        sums = np.bincount(doc, np.repeat(np.log10(count + 1), many), len(chunk["n"]))
        known = np.bincount(doc, np.repeat(count > 0, many), len(chunk["n"])).astype(np.int64)
        return pa.table({"doc_id": pa.array(chunk["ids"], pa.int64()), "_h": pa.array(chunk["own"], pa.int64()), "n_tokens": pa.array(chunk["n"], pa.int64()), "n_known": pa.array(known, pa.int64()), "log_sum": pa.array(sums)})

    out = replied.groupBy("chunk").applyInArrow(join, "doc_id long, _h long, n_tokens long, n_known long, log_sum double")
    return out.withColumn("train_tokens", F.lit(total["n"]).cast("long")).withColumn("train_types", F.lit(total["v"]).cast("long"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits, n_bytes and bits_per_byte of docs (doc_id, text)."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text"), fold.alias("_fold")).withColumn("_h", F.xxhash64("text"))
    train = [f for f in range(FOLDS) if f != HELD_OUT]  # the base's fold is HELD_OUT alone
    counted = _texts(docs, *(f for f in train if f != TUNED))
    codes = fit_codes(counted)
    tables = fit_tables(counted, codes)
    mixer = fit_mixer(_texts(docs, TUNED), codes, tables)
    scored = score(docs.select("doc_id", "_h", "text"), codes, tables, mixer)
    base = unigram(docs.select("doc_id", "_h", "text", (F.col("_fold") != HELD_OUT).cast("int").alias("_train")))
    # rows of one doc_id and one text have one result, which all of them get
    base = base.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).agg(*(F.first(c).alias(c) for c in ("n_tokens", "n_known", "log_sum", "train_tokens", "train_types")))
    out = scored.join(base, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens",
        (F.col("log_sum") - F.col("n_tokens") * F.log10(F.col("train_tokens") + F.col("train_types") + F.lit(1.0))).alias("base_score"),
        (-F.col("bits") * F.log10(F.lit(2.0))).alias("score"), "bits", "n_bytes", F.try_divide("bits", F.col("n_bytes").cast("double")).alias("bits_per_byte"),
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """score_documents() of all documents."""
    out = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


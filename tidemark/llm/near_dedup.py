"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles (operator 6).

Texts are words lower-cased A-Z; shingles are runs of five words (all words of a shorter text), and a
shingle weighs its count times its inverse document frequency, which is that of 1% of the documents for all
rarer ones: what a large group of copies shares isn't common for that. Two documents are near duplicates at
a weighted Jaccard similarity of 0.8 or more, and the classes are the connected components.

1. Document frequencies of all shingles over all documents: each chunk of texts sends its sorted shingle
   hashes to shards, which count them and send the chunk back the document frequency of each. Every
   shingle weighs by its own; a document keeps those of its shingles for the comparisons. Shards know
   a hash by 32 bits and those of the shard's number; where two shingles fall together they are counted as one.
2. Each document gets ROWS x BANDS consistent weighted samples; those with one content share one
   representative, the least doc_id.
3. Representatives with an equal band meet in a bucket. A similarity of 0.8 needs 0.8 of a text's weight
   in shingles that another text also has; so those with more than 0.2 in shingles that no other
   text in any bucket has are linked to none and leave. Each bucket then first compares all members with
   one pivot, the member that shares most bands with others. After the links found so far are
   joined, members outside the largest component of a bucket are compared with the members of other
   components there, block by block, so that only links leave a task. So every pair that shares a band ends in one class or is compared, and a
   large group of near copies costs a few comparisons for each member, not one for each pair.
4. Comparisons drop pairs whose samples agree in under half (at a similarity of 0.8 that has a
   chance of about 1e-5) and verify the others by the exact weighted Jaccard similarity of the whole
   texts.

A pair at exactly 0.8 shares none of the bands with a chance of 2e-4; above that it falls fast.

Defined results: a document without words (null, empty, blank) is a class of its own; texts with the
same words are one class; repeated rows are returned each; a null doc_id is returned with a null
class; empty in, empty out; other columns are kept, but for class_id, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, materialise, null_safe_text, release, sliced, tidied, utf8

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Part of all documents from which on a shingle counts as common; rarer ones weigh alike, so that copies don't weigh less the more there are.
COMMON = 0.01
#: Bytes of text for each shard of the shingle counts.
SHARD_BYTES = 16 << 20
CHUNK = 1 << 20
#: Members of a bucket that meet in a task.
BLOCK = 1024

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_P = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2^64
_PINV = pow(_P, -1, 2**64)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + np.uint64(1)
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.empty(1 << max(10, (n - 1).bit_length()), np.uint64)
        out[0], done = 1, 1
        while done < len(out):
            out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 2**64))
            done *= 2
        _powers[base] = have = out
    return have[:n]


def word_hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts body[at[i]:at[i + 1]], and the number of words before each text."""
    n = len(body)
    word = ~_BLANK[body]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = at[(at > 0) & (at < n)]
    first[edges] = word[edges]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[body] * powers(_P, n), out=total[1:])
    h = mix((total[ends] - total[starts]) * powers(_PINV, n + 1)[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, at)


def shingles(body: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each text: hash, count, the place where each text's begin (n + 1 of them), and 128-bit content keys (n x 2)."""
    with np.errstate(over="ignore"):
        w, first = word_hashes(body, at)
        n_docs, n_words = len(at) - 1, np.diff(first)
        doc = np.repeat(np.arange(n_docs), n_words)
        place = np.arange(len(w)) - first[:-1][doc]
        key = np.zeros((n_docs, 2), np.uint64)
        if len(w):
            for k, salt in enumerate((0x1234567, 0x89ABCDF)):
                part = mix(w * np.uint64(2 * salt + 1) + place.astype(np.uint64) * _GOLD + np.uint64(salt))
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
                key[:, k] = mix(sums[first[1:]] - sums[first[:-1]] + n_words.astype(np.uint64))
        s = np.zeros(len(w), np.uint64)
        for i in range(min(size, len(w))):
            t = w[i:] * np.uint64(2 * (i + 1) * 0x632BE59BD9B4E019 + 1 & 2**64 - 1)
            inside = place[i:] >= i  # the word i places on is still in the same text
            s[: len(w) - i] += np.where(inside, t, np.uint64(0))
        keep = place < np.maximum(n_words - size + 1, 1)[doc]
        s, doc = mix(s[keep]), doc[keep]
        order = np.argsort(s)
        small = np.uint16 if n_docs < 65536 else np.int64
        order = order[np.argsort(doc[order].astype(small), kind="stable")]
        s, doc = s[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(s)))
        return s[begin], count, np.searchsorted(doc[begin], np.arange(n_docs + 1)), key


class Weights:
    """Counts times inverse document frequencies, of which the largest (of a shingle in COMMON of the documents, or in two, at most) is 1."""

    def __init__(self, n_docs: int):
        self.n_docs, self.least = n_docs, max(2, int(np.ceil(COMMON * n_docs)))

    def __call__(self, counts: np.ndarray, df: np.ndarray) -> np.ndarray:
        idf = lambda x: 1 + np.log(self.n_docs / np.minimum(np.maximum(x, self.least), max(self.n_docs, self.least)))
        return counts * idf(df) / idf(self.least)

    def of(self, batch, text: str = "text", df: str = "df") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """shingles() of texts without counts and keys, and with the weights; df: the packed document frequencies of each text's shingles."""
        s, count, begin, _ = shingles(*utf8(batch.column(text)))
        return s, self(count, unpacked(batch.column(df).to_pylist(), np.uint32)), begin


def unpacked(blobs: list, kind) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor().decompress
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(open_(x), kind) for x in blobs)])


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 32-bit numbers: their differences, byte by byte."""
    steps = np.diff(x.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(unpacked([blob], np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, and the doc_ids, hashes, packed bytes and packed offsets of its texts."""

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for k, batch in enumerate(sliced(batches, "text", CHUNK)):
            body, at = utf8(batch.column("text"))
            arrays = [pa.array([f"{TaskContext.get().partitionId()}/{k}"]), *(pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "hash")), *(pa.array([press(x.tobytes())], pa.binary()) for x in (body, at))]
            yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "doc_id", "hash", "body", "at"])

    return materialise(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(tidied(pack), "chunk string, doc_id array<long>, hash array<long>, body binary, at binary"))


def document_frequencies(packed: DataFrame, bits: int) -> DataFrame:
    """chunk, shard and df: the packed document frequencies, over all chunks, of the chunk's different shingle hashes in that shard, in order."""

    def send(batches):
        for batch in batches:
            for chunk, body, at in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body", "at"))):
                s, _, _, _ = shingles(unpacked([body], np.uint8), unpacked([at], np.int64))
                s >>= np.uint64(32 - bits)  # as many bits as the shard's number and 32 more
                s.sort()
                new = np.ones(len(s), bool)
                new[1:] = s[1:] != s[:-1]
                begin = np.flatnonzero(new)
                count = np.diff(np.append(begin, len(s)))
                s = s[begin]
                edges = np.searchsorted(s, np.arange(2**bits + 1, dtype=np.uint64) << np.uint64(32))
                many = np.flatnonzero(count > 1)
                cuts = np.searchsorted(many, edges)
                out = [(k, pack_sorted(s[a:b]), (many[c:d] - a).astype(np.uint32).tobytes(), count[many[c:d]].astype(np.uint32).tobytes()) for k, (a, b, c, d) in enumerate(zip(edges[:-1], edges[1:], cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.string()), pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))], names=["chunk", "shard", "hashes", "at", "n"])

    def reply(table):
        press = zstandard.ZstdCompressor(level=1).compress
        values, counts = [], []
        for h, at, n in zip(*(table.column(c).to_pylist() for c in ("hashes", "at", "n"))):
            values.append(unpack_sorted(h))
            c = np.ones(len(values[-1]), np.uint32)
            c[np.frombuffer(at, np.uint32)] = np.frombuffer(n, np.uint32)
            counts.append(c)
        ends = np.cumsum([len(v) for v in values])
        values, counts = np.concatenate(values), np.concatenate(counts)
        order = np.argsort(values)
        values = values[order]
        new = np.append(True, values[1:] != values[:-1])
        total = np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(new))
        df = np.empty(len(values), np.uint32)
        df[order] = total[np.cumsum(new) - 1]
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "df": pa.array([press(x.tobytes()) for x in np.split(df, ends[:-1])], pa.binary())})

    sent = packed.select("chunk", "body", "at").mapInArrow(tidied(send), "chunk string, shard int, hashes binary, at binary, n binary")
    return sent.groupBy("shard").applyInArrow(reply, "chunk string, shard int, df binary")


def shared_weight(texts: DataFrame, weights: Weights) -> DataFrame:
    """doc_id and the weight of each text's shingles that another text also has, or a little more; texts: doc_id, text and df.

    Shingles meet by 32 bits and their shard's; where two fall together they count as shared.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / SHARD_BYTES)))))
    given = texts.sparkSession.sparkContext.broadcast(weights)

    def send(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for k, batch in enumerate(sliced(batches, "text", CHUNK)):
            s, w, begin = given.value.of(batch)
            doc = np.repeat(np.arange(len(begin) - 1, dtype=np.uint32), np.diff(begin))
            order = np.argsort(s)
            s, w, doc = s[order] >> np.uint64(32 - bits), w[order], doc[order]
            edges = np.searchsorted(s, np.arange(2**bits + 1, dtype=np.uint64) << np.uint64(32))
            ids, chunk = batch.column("doc_id").to_pylist(), f"{TaskContext.get().partitionId()}/{k}"
            rows = [(i, press(s[a:b].astype(np.uint32).tobytes()), press(doc[a:b].tobytes()), press(w[a:b].astype(np.float32).tobytes()), ids if i == 0 else None) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a or i == 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)), pa.array([len(ids)] * len(rows), pa.int32()), pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
                names=["chunk", "shard", "value", "doc", "w", "n", "ids"],
            )

    def reply(table):
        open_ = zstandard.ZstdDecompressor().decompress
        values = [np.frombuffer(open_(x.as_py()), np.uint32) for x in table.column("value")]
        flat = np.sort(np.concatenate(values))
        twice = np.unique(flat[1:][flat[1:] == flat[:-1]])
        sums = []
        for v, doc, w, n in zip(values, table.column("doc"), table.column("w"), table.column("n").to_pylist()):
            hit = np.zeros(len(v), bool)
            if len(twice):
                hit = twice[np.minimum(np.searchsorted(twice, v), len(twice) - 1)] == v
            doc, w = np.frombuffer(open_(doc.as_py()), np.uint32), np.frombuffer(open_(w.as_py()), np.float32)
            sums.append(np.bincount(doc[hit], w[hit], n).tobytes())
        return pa.table({"chunk": table.column("chunk"), "sums": pa.array(sums, pa.binary()), "ids": table.column("ids")})

    def join(table):
        total = np.sum([np.frombuffer(x) for x in table.column("sums").to_pylist()], axis=0)
        ids = next(x for x in table.column("ids").to_pylist() if x is not None)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "shared": pa.array(total)})

    sent = texts.select("doc_id", "text", "df").mapInArrow(tidied(send), "chunk string, shard int, value binary, doc binary, w binary, n int, ids array<long>")
    return sent.groupBy("shard").applyInArrow(reply, "chunk string, sums binary, ids array<long>").groupBy("chunk").applyInArrow(join, "doc_id long, shared double")


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at the middles of 65,536 equal parts, and its logarithm."""
    q = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - np.exp(-mid) * (1 + mid) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return low.astype(np.float32), np.log(low).astype(np.float32)


_tables: list = []


def samples(hashes: np.ndarray, weights: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) consistent weighted samples, 32 bits each; texts without shingles get zeros."""
    if not _tables:
        _tables.extend(_quantiles())
    gamma, log_gamma = _tables
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, n), np.uint32)
    if not len(full):
        return out
    starts, low = begin[:-1][full], np.uint64(0xFFFF)
    log_w = np.log(weights).astype(np.float32)
    name = (hashes >> np.uint64(32)).astype(np.int64)
    plain = not log_w.any()
    with np.errstate(over="ignore"):
        for j in range(n):
            x = (hashes + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)) * _M1
            x ^= x >> np.uint64(29)
            x *= _M2
            x ^= x >> np.uint64(32)
            r = gamma[(x & low).astype(np.intp)]
            b = ((x >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
            log_c = log_gamma[((x >> np.uint64(16)) & low).astype(np.intp)]
            if plain:  # all logarithms 0: t is 0
                a = log_c - r * (1 - b)
                packed = (a * np.float32(1 << 22)).astype(np.int64) << 32 | name
            else:
                t = np.floor(log_w / r + b)
                a = log_c - r * (t - b + 1)
                packed = (a * np.float32(1 << 22)).astype(np.int64) << 32 | ((name + t.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF)
            out[full, j] = (np.minimum.reduceat(packed, starts) & 0xFFFFFFFF).astype(np.uint32)
    return out


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, hash (of the text), content (key of the words; null without words), weight, sample (array<int>), bands (array<long>) and df (packed, of the different shingles in order of their hashes)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / SHARD_BYTES)))))

    def sign(chunk, replies):
        press = zstandard.ZstdCompressor(level=1).compress
        ids, hashes, body, at = (chunk.column(c)[0].as_py() for c in ("doc_id", "hash", "body", "at"))
        s, count, begin, key = shingles(unpacked([body], np.uint8), unpacked([at], np.int64))
        replies = replies.sort_by("shard")
        df = unpacked(replies.column("df").to_pylist(), np.uint32)
        df = df[np.unique(s >> np.uint64(32 - bits), return_inverse=True)[1]]
        w = shared.value(count, df)
        sig = samples(s, w, begin, BANDS * ROWS)
        some = np.diff(begin) > 0
        total = np.concatenate([[0.0], np.cumsum(w)])[begin]
        with np.errstate(over="ignore"):
            bands = np.zeros((len(sig), BANDS), np.uint64)
            for i in range(ROWS):
                bands = mix(bands * _GOLD + sig[:, i::ROWS].astype(np.uint64) + np.uint64(1))
        lists = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).ravel().view(kind)))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "hash": pa.array(hashes, pa.int64()), "content": pa.array([k.tobytes() if y else None for k, y in zip(key, some)], pa.binary()), "weight": pa.array(np.diff(total)),
            "sample": lists(sig, np.int32), "bands": lists(bands, np.int64), "df": pa.array([press(df[a:b].tobytes()) for a, b in zip(begin[:-1], begin[1:])], pa.binary()),
        })

    packed = chunks(docs)
    replies = document_frequencies(packed, bits)
    return packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(sign, "doc_id long, hash long, content binary, weight double, sample array<int>, bands array<long>, df binary")


def verified(pairs: DataFrame, weights: Weights) -> DataFrame:
    """The pairs (a, b, text_a, df_a, text_b, df_b) whose weighted Jaccard similarity is SIMILARITY or more, with it."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def make():
        weights = shared.value

        def work(batch):
            sides = []
            for side in ("a", "b"):
                s, w, begin = weights.of(batch, f"text_{side}", f"df_{side}")
                sides.append((s, w, np.repeat(np.arange(len(begin) - 1), np.diff(begin))))
            h = np.concatenate([x[0] for x in sides])
            w = np.concatenate([x[1] for x in sides])
            pair = np.concatenate([x[2] for x in sides])
            order = np.lexsort((h, pair))
            h, w, pair = h[order], w[order], pair[order]
            twice = np.flatnonzero((h[1:] == h[:-1]) & (pair[1:] == pair[:-1]))
            low = np.bincount(pair[twice], np.minimum(w[twice], w[twice + 1]), batch.num_rows)
            both = np.bincount(pair, w, batch.num_rows) - low
            return [pa.array(np.where(both > 0, low / np.maximum(both, 1e-300), 0.0))]

        return work

    out = append_columns(pairs, make, "similarity double", most_bytes=CHUNK, column="text_a", drop=("text_a", "df_a", "text_b", "df_b"))
    return out.where(F.col("similarity") >= SIMILARITY)


def linked(table: pa.Table, weights: Weights) -> pa.Table:
    """Edges between the outside members of a block of a bucket and the other members of a block, each pair in the first band that it shares."""
    from pyarrow import compute as pc

    split = [table.filter(m).combine_chunks() for m in (table.column("outside"), pc.invert(table.column("outside")))]
    n = BANDS * ROWS
    rep, label, sample, main = [], [], [], np.array(split[1].column("_main").to_pylist(), bool)
    for t in split:
        rep.append(t.column("rep").to_numpy())
        label.append(t.column("label").to_numpy())
        sample.append(t.column("sample").combine_chunks().flatten().to_numpy().reshape(-1, n))
    pairs_a, pairs_b = [], []
    if len(rep[0]) and len(rep[1]):
        band = int(table.column("band")[0].as_py())
        (s, w, begin), (s2, w2, begin2) = (weights.of(t) for t in split)
        names, at = np.unique(np.concatenate([s, s2]), return_inverse=True)
        at, at2 = at[: len(s)], at[len(s) :]
        total, total2 = (np.add.reduceat(x, y[:-1]) for x, y in ((w, begin), (w2, begin2)))
        dense = np.zeros(len(names))
        for u in range(len(rep[0])):
            same = sample[1] == sample[0][u]
            near = (2 * same.sum(axis=1) >= n) & (label[1] != label[0][u]) & (main | (rep[1] > rep[0][u]))
            near &= np.minimum(total2, total[u]) >= SIMILARITY * np.maximum(total2, total[u]) * (1 - 1e-9)
            near = np.flatnonzero(near & (_bands(same).argmax(axis=1) == band))
            if not len(near):
                continue
            mine = slice(begin[u], begin[u + 1])
            dense[at[mine]] = w[mine]
            size = np.diff(begin2)[near]
            ends = np.cumsum(size)
            which = np.arange(ends[-1]) + np.repeat(begin2[near] - ends + size, size)
            low = np.add.reduceat(np.minimum(dense[at2[which]], w2[which]), ends - size)
            dense[at[mine]] = 0
            found = near[low >= SIMILARITY * (total[u] + total2[near] - low)]
            pairs_a += [int(rep[0][u])] * len(found)
            pairs_b += rep[1][found].tolist()
    return pa.table({"a": pa.array(pairs_a, pa.int64()), "b": pa.array(pairs_b, pa.int64())})


def _bands(same: np.ndarray) -> np.ndarray:
    """(pairs, BANDS) whether all samples of a band agree; band k has the samples k * ROWS to k * ROWS + ROWS - 1."""
    return same.reshape(len(same), BANDS, ROWS).all(axis=2)


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """v and label (the least vertex of its component) of all vertices of edges (a, b): labels pass along edges and are followed to their own label, until nothing changes."""
    both = materialise(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"v": "u", "label": "other"}), "u").groupBy("v").agg(F.min("other").alias("other"))
        new = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        far = new.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = materialise(new.join(far, "label", "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) without text, with class_id: the least doc_id of each document's class of near duplicates."""
    plain = docs.select("doc_id", null_safe_text().alias("text"))
    weights = Weights(max(1, plain.count()))
    signed = materialise(signatures(plain, weights))
    release(docs.sparkSession)
    reps = signed.where("content is not null and doc_id is not null").groupBy("content").agg(F.min(F.struct("doc_id", "hash")).alias("least"), F.first("df").alias("df"), F.first("sample").alias("sample"), F.first("bands").alias("bands"), F.first("weight").alias("weight"))
    reps = materialise(reps.select("content", F.col("least.doc_id").alias("rep"), F.col("least.hash").alias("hash"), "sample", "bands", "weight", "df"))
    members = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(members.join(sizes, ["band", "bucket"]).select("band", "bucket", "rep"))
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    involved = reps.withColumnRenamed("rep", "doc_id").join(involved, "doc_id", "left_semi").select("doc_id", "hash", "df")
    texts = plain.withColumn("hash", F.xxhash64("text")).join(involved, ["doc_id", "hash"]).groupBy("doc_id").agg(F.min(F.struct("text", "df")).alias("_t"))
    texts = materialise(texts.select("doc_id", "_t.text", "_t.df"))
    sketch = reps.select("rep", "sample", "weight").join(shared_weight(texts, weights).withColumnRenamed("doc_id", "rep"), "rep")
    release(docs.sparkSession)
    sketch = materialise(sketch.where(F.col("shared") >= SIMILARITY * F.col("weight") * (1 - 1e-5)).drop("shared"))
    members = members.join(sketch.select("rep"), "rep", "left_semi")
    sizes = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = members.join(sizes, ["band", "bucket"])
    score = members.groupBy("rep").agg(F.sum("n").alias("score"))
    members = materialise(members.join(score, "rep"))

    def compared(pairs: DataFrame) -> DataFrame:
        """Edges among candidate pairs (a, b)."""
        for side in ("a", "b"):
            pairs = pairs.join(sketch.select(F.col("rep").alias(side), F.col("sample").alias(f"s_{side}"), F.col("weight").alias(f"w_{side}")), side)
        same = F.size(F.filter(F.zip_with("s_a", "s_b", lambda x, y: x == y), lambda x: x))
        near = pairs.where((same * 2 >= BANDS * ROWS) & (F.least("w_a", "w_b") >= SIMILARITY * F.greatest("w_a", "w_b") * (1 - 1e-9))).select("a", "b")
        for side in ("a", "b"):
            near = near.join(texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"), F.col("df").alias(f"df_{side}")), side)
        return verified(near, weights).select("a", "b")

    shared = docs.sparkSession.sparkContext.broadcast(weights)
    order = F.struct("score", -F.col("rep"))
    pivots = members.groupBy("band", "bucket").agg(F.max_by("rep", order).alias("pivot"))
    first = members.join(pivots, ["band", "bucket"]).where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    release(docs.sparkSession)
    edges = materialise(compared(first))
    release(docs.sparkSession)
    labels = components(edges)

    # what is left: members outside the largest component of their bucket against all other components there
    now = materialise(members.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("band", "bucket", "rep", F.coalesce("label", "rep").alias("label")))
    parts = now.groupBy("band", "bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("band", "bucket").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all"), F.max("n").alias("most")).where("parts > 1")
    open_ = now.join(largest, ["band", "bucket"]).join(sketch.select("rep", "sample"), "rep").join(texts.withColumnRenamed("doc_id", "rep"), "rep")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    outer, inner = blocks(F.col("all") - F.col("most")), blocks(F.col("all"))
    h = F.xxhash64("rep")
    row = ["band", "bucket", "rep", "label", "sample", "text", "df"]
    outside = open_.where("label <> main").select(*row, F.lit(True).alias("outside"), F.pmod(h, outer).alias("i"), F.explode(F.sequence(F.lit(0), inner - 1)).alias("j"))
    against = open_.select(*row, (F.col("label") == F.col("main")).alias("_main"), F.lit(False).alias("outside"), F.explode(F.sequence(F.lit(0), outer - 1)).alias("i"), F.pmod(h, inner).alias("j"))
    dealt = outside.withColumn("_main", F.lit(False)).unionByName(against)
    more = materialise(dealt.groupBy("band", "bucket", "i", "j").applyInArrow(lambda t: linked(t, shared.value), "a long, b long").distinct())
    labels = components(edges.union(more))

    classes = reps.select("content", "rep").join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("content", F.coalesce("label", "rep").alias("class_id"))
    by_doc = signed.select("doc_id", "content").join(classes, "content", "left").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.drop("text", "class_id").join(by_doc, "doc_id", "left")
    return out.withColumn("class_id", F.coalesce("class_id", "doc_id"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id and class_id of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

"""Suffix-array dedup: every byte of a long string that an earlier document holds is removed (operator 7).

A string of ``length`` bytes is earlier if it also starts in a document with a smaller doc_id. To
shard the sorting exactly, each window of ``length`` bytes is named by the least hash of its K-byte
strings; windows side by side with one name form a segment, and all segments of a name go to one
shard. So equal windows always meet, whatever documents they are in.

1. Each document's names meet by shard, as 32 bits each; only segments whose name several documents
   have go on.
2. Batches of documents cut their texts into those segments. Of equal segments in a batch only those of
   the least doc_id are sent on; all others are certainly removed, and leave at once. So a group of
   copies sends a segment for each batch, not for each document.
3. A shard drops names that only one document has, keeps one of all equal segments, leaves out those that
   share no half window with another of their name, and sorts the
   suffixes of those whose name is left with several by external induced sorting with common prefixes
   (``induced_sort``), whose text, names and queues go to disk beyond a limit. Suffixes that agree in
   ``length`` bytes are one run; windows whose run has a smaller doc_id are removed.
4. The removed ranges meet the texts by doc_id and are cut out.

Defined results: null and empty texts, and texts shorter than ``length``, lose nothing; strings never
cross documents; repeats within a document alone stay; rows of one doc_id are one document if their
texts are equal (rows of one doc_id with different texts are cut by the ranges of all of them); a
null doc_id neither loses nor removes anything; other columns are kept, those named like a result
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_safe_text, sliced, small_batches, tidied, utf8
from .induced_sort import LIMIT, Store, suffixes
from .near_dedup import _GOLD, _M1, _M2, mix, powers

LENGTH = 50
K = 16
#: Column by which texts are dealt.
KEY = "_key"
CHUNK = 2 << 20
#: Bytes of segments for each shard; a segment is about 66 bytes for 17 new ones.
SHARD_BYTES, SPREAD = 24 << 20, 4
_P = 0x9FB21C651E98DF25
_PINV = pow(_P, -1, 2**64)


def short_hashes(body: np.ndarray) -> np.ndarray:
    """Hashes of all strings of K bytes."""
    with np.errstate(over="ignore"):
        x = body.astype(np.uint64)
        for shift in (1, 2, 4):
            x = x[:-shift] << np.uint64(8 * shift) | x[shift:]
        h = (x[:-8] * _M1) ^ (x[8:] * _GOLD)
        h = (h ^ (h >> np.uint64(32))) * _M2
        return h ^ (h >> np.uint64(29))


def names(body: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of `length` bytes the least hash of its K-byte strings."""
    h = short_hashes(body)
    width, span = 1, length - K + 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :])


def segments(body: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """name, text number, start (in body), and size in bytes of each segment."""
    n = len(body) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return np.zeros(0, np.uint64), none, none, none
    name = names(body, length)
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    whole = doc[:n] == doc[length - 1 :]
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:n] != doc[: n - 1]) | ~whole[:-1]
    begin = np.flatnonzero(new & whole)
    stop = np.flatnonzero(np.append(new[1:] | ~whole[1:], True) & whole) + 1
    return name[begin], doc[begin].astype(np.int64), begin, stop - begin + length - 1


def _blocks(size: np.ndarray, most: int = 1 << 19):
    """Slices of ranges that hold about `most` bytes together."""
    part = (np.cumsum(size) - 1) // most if len(size) else size
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(size) else size
    return zip(edges.tolist(), np.append(edges[1:], len(size)).tolist())


def hashed(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, which come by start."""
    out = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for a, b in _blocks(size):
            low, high = int(start[a]), int((start[a:b] + size[a:b]).max())
            part, at = body[low:high], start[a:b] - low
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_P, len(part)), out=total[1:])
            out[a:b] = mix((total[at + size[a:b]] - total[at]) * powers(_PINV, len(part) + 1)[at] + size[a:b].astype(np.uint64) * _GOLD)
    return out


def gathered(body: np.ndarray, start: np.ndarray, size: np.ndarray, gap: int = 0) -> np.ndarray:
    """The bytes of ranges one behind the other, each with `gap` zeros behind it."""
    ends = np.cumsum(size + gap)
    out = np.zeros(int(ends[-1]) if len(size) else 0, np.uint8)
    for a, b in _blocks(size):
        n = size[a:b]
        to = np.cumsum(n) - n
        step = np.arange(n.sum())
        out[np.repeat(ends[a:b] - n - gap - to, n) + step] = body[np.repeat(start[a:b] - to, n) + step]
    return out


def unlike(body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each range but the first differs from the one before it, byte by byte, of ranges whose sizes are equal if their hashes are."""
    out = size[1:] != size[:-1]
    at = np.flatnonzero(~out)
    for a, b in _blocks(size[at]):
        i = at[a:b]
        n = size[i]
        differ = gathered(body, start[i], n) != gathered(body, start[i + 1], n)
        out[i] = np.add.reduceat(differ, np.cumsum(n) - n) > 0
    return out


def kinds(name: np.ndarray, h: np.ndarray, body: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each segment differs from the one before it; segments come by name, hash and size."""
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (h[1:] != h[:-1]) | (size[1:] != size[:-1])
    at = np.flatnonzero(~new)  # equal as far as 64 bits of hash say
    if len(at):
        use = np.union1d(at - 1, at)
        new[use[1:]] |= unlike(body, start[use], size[use]) & ~new[use[1:]]
    return new


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each doc joined where they touch."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    first = np.append(True, doc[1:] != doc[:-1])
    group = np.cumsum(first) - 1
    base = group * (int(stop.max()) + 1)
    high = np.maximum.accumulate(stop + base)
    new = first.copy()
    new[1:] |= (start + base)[1:] > high[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], (high - base)[np.append(at[1:] - 1, len(doc) - 1)]


RANGES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def related(body: np.ndarray, start: np.ndarray, size: np.ndarray, name: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which segments (all different, by start) may share a window with another of their name.

    A window holds its name's K-byte string, and at least half of its other bytes stand on one side of that; so
    segments that share a window share the string with those bytes to its left or to its right.
    """
    side = (length - K + 1) // 2
    key, of = [], []
    for a, b in _blocks(size):
        low = int(start[a])
        h = short_hashes(body[low : int(start[b - 1] + size[b - 1])])
        first, many = start[a:b] - low, size[a:b] - K + 1
        least = np.repeat(np.minimum.reduceat(h, np.stack([first, np.minimum(first + many, len(h) - 1)], axis=1).ravel())[::2], many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.flatnonzero(h[np.repeat(first, many) + step] == least)
        segment, q = np.repeat(np.arange(a, b), many)[at], step[at]
        for fits, begin, salt in ((q >= side, q - side, 0), (q + K + side <= size[segment], q, 1)):
            s = segment[fits]
            if len(s):
                with np.errstate(over="ignore"):
                    key.append(mix(hashed(body, start[s] + begin[fits], np.full(len(s), K + side)) + name[s].astype(np.uint64) * _GOLD + np.uint64(salt)))
                of.append(s)
    out = np.zeros(len(size), bool)
    if key:
        key, of = np.concatenate(key), np.concatenate(of)
        order = np.argsort(key, kind="stable")
        out[of[order][_several(key[order], of[order])]] = True
    return out


def runs_in_shard(body: np.ndarray, start: np.ndarray, size: np.ndarray, least: np.ndarray, length: int = LENGTH, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it) of the windows that a segment of a smaller `least` also holds; segments are all different. limit: bytes of the sort that stay in memory."""
    store, ends = Store(limit), np.cumsum(size + 1)
    begin, n = ends - size - 1, int(ends[-1]) + 1
    text = store.table(n + 64, np.uint8)
    for a, b in _blocks(size, 1 << 20):
        part = gathered(body, start[a:b], size[a:b], 1)
        part += np.uint8(2)  # UTF-8 has no byte over 0xF4
        part[ends[a:b] - 1 - begin[a]] = 1
        text[begin[a] : ends[b - 1]] = part
    owner = store.table(n, np.int32)
    for a, b in _blocks(size, 1 << 20):
        owner[begin[a] : ends[b - 1]] = np.repeat(np.arange(a, b), size[a:b] + 1)
    owner[n - 1] = len(size) - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    open_p, open_s = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the run that isn't ended

    def close(p: np.ndarray, s: np.ndarray, new: np.ndarray) -> None:
        at = np.flatnonzero(new)
        own = least[s]
        smallest = np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(p))))
        hit = smallest < own
        found.append((s[hit], p[hit] - begin[s[hit]]))

    low = length  # least common prefix since the last window
    for p, lcp in suffixes(text, n, length, store):
        # between windows lie suffixes too short to matter: minima over the places in between
        s = owner[p]
        use = np.flatnonzero((p - begin[s] <= size[s] - length) & (p < n - 1))
        if not len(use):
            low = min(low, int(lcp.min()))
            continue
        cut = np.append(0, use[:-1] + 1)
        least_lcp = np.minimum.reduceat(lcp[: use[-1] + 1], cut)
        least_lcp[0] = min(int(least_lcp[0]), low)
        low = min(length, int(lcp[use[-1] + 1 :].min(initial=length)))
        new = least_lcp < length
        p, s = np.append(open_p, p[use]), np.append(open_s, s[use])
        new = np.append(np.arange(len(open_p)) == 0, new)
        new[0] = True
        last = int(np.flatnonzero(new)[-1])
        if last:
            close(p[:last], s[:last], new[:last])
        open_p, open_s = p[last:], s[last:]
    if len(open_p):
        close(open_p, open_s, np.arange(len(open_p)) == 0)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _several(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which rows have a key, of sorted ones, that holds several values."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return np.repeat(np.minimum.reduceat(value, edge) != np.maximum.reduceat(value, edge), np.diff(np.append(edge, len(key))))


def _tags(name: np.ndarray) -> np.ndarray:
    return (name >> np.uint64(32)).astype(np.uint32)


def shared_names(docs: DataFrame, shards: int, length: int = LENGTH) -> DataFrame:
    """doc_id and tags (32 bits of the names, sorted) of the segments whose name another document also has; a few more, where two names share a tag."""

    def send(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for k, batch in enumerate(sliced(batches, "text", CHUNK)):
            name, doc, _, _ = segments(*utf8(batch.column("text")), length)
            shard = (name % np.uint64(shards)).astype(np.int64)
            tag = _tags(name)
            order = np.lexsort((tag, doc, shard))
            shard, tag, doc = shard[order], tag[order], doc[order].astype(np.uint32)
            edges = np.searchsorted(shard, np.arange(shards + 1))
            ids, chunk = batch.column("doc_id").to_pylist(), f"{TaskContext.get().partitionId()}/{k}"
            rows = [(s, press(tag[a:b].tobytes()), press(doc[a:b].tobytes()), ids if s == 0 else None) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a or s == 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)), pa.array([press(np.array(ids, np.int64)[np.unique(doc[edges[r[0]] : edges[r[0] + 1]])].tobytes()) for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["chunk", "shard", "tag", "doc", "own", "ids"],
            )

    def flag(table):
        open_ = zstandard.ZstdDecompressor().decompress
        tags, ids, docs = [], [], []
        for t, d, o in zip(*(table.column(c) for c in ("tag", "doc", "own"))):
            tags.append(np.frombuffer(open_(t.as_py()), np.uint32))
            docs.append(np.frombuffer(open_(d.as_py()), np.uint32))
            ids.append(np.frombuffer(open_(o.as_py()), np.int64)[np.unique(docs[-1], return_inverse=True)[1]])
        tag, own = np.concatenate(tags), np.concatenate(ids)
        order = np.argsort(tag)
        edge = np.flatnonzero(np.append(True, tag[order][1:] != tag[order][:-1])) if len(tag) else np.zeros(0, np.int64)
        hit = np.zeros(len(tag), bool)
        if len(tag):
            several = np.minimum.reduceat(own[order], edge) != np.maximum.reduceat(own[order], edge)
            hit[order] = np.repeat(several, np.diff(np.append(edge, len(tag))))
        cuts = np.cumsum([0, *map(len, tags)])
        parts = [(t[hit[a:b]].tobytes(), d[hit[a:b]].tobytes()) for t, d, a, b in zip(tags, docs, cuts[:-1], cuts[1:])]
        return pa.table({"chunk": table.column("chunk"), "tag": pa.array([x for x, _ in parts], pa.binary()), "doc": pa.array([x for _, x in parts], pa.binary()), "ids": table.column("ids")})

    def by_document(table):
        tag = np.frombuffer(b"".join(table.column("tag").to_pylist()), np.uint32)
        doc = np.frombuffer(b"".join(table.column("doc").to_pylist()), np.uint32)
        ids = next(x for x in table.column("ids").to_pylist() if x is not None)
        order = np.lexsort((tag, doc))
        tag, doc = tag[order], doc[order]
        kind, at = np.unique(doc, return_index=True)
        ends = np.append(at[1:], len(doc))
        return pa.table({"doc_id": pa.array([ids[d] for d in kind.tolist()], pa.int64()), "tags": pa.array([np.unique(tag[a:b]).tobytes() for a, b in zip(at, ends)], pa.binary())})

    sent = docs.mapInArrow(tidied(send), "chunk string, shard int, tag binary, doc binary, own binary, ids array<long>")
    flagged = sent.groupBy("shard").applyInArrow(flag, "chunk string, tag binary, doc binary, ids array<long>")
    return flagged.groupBy("chunk").applyInArrow(by_document, "doc_id long, tags binary")


def with_tags(name: np.ndarray, doc: np.ndarray, tags: list[bytes | None]) -> np.ndarray:
    """Which segments have a name whose tag is among their document's."""
    lists = [np.frombuffer(t or b"", np.uint32) for t in tags]
    own = np.concatenate([t.astype(np.uint64) | np.uint64(i << 32) for i, t in enumerate(lists)]) if lists else np.zeros(0, np.uint64)
    if not len(own) or not len(name):
        return np.zeros(len(name), bool)
    key = _tags(name).astype(np.uint64) | doc.astype(np.uint64) << np.uint64(32)
    return own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key


def removed_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, start and stop (byte places) of ranges to remove; ranges of a document may overlap. docs: KEY, text and more, of keyed()."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-SPREAD * total // SHARD_BYTES))

    def send(batches):
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches, "text", CHUNK):
            body, at = utf8(batch.column("text"))
            name, doc, start, size = segments(body, at, length)
            use = with_tags(name, doc, batch.column("tags").to_pylist())  # none without a doc_id
            name, doc, start, size = name[use], doc[use], start[use], size[use]
            ids = batch.column(KEY).to_numpy()[doc]
            h = hashed(body, start, size)
            order = np.lexsort((ids, size, h, name))
            name, doc, start, size, ids, h = (x[order] for x in (name, doc, start, size, ids, h))
            first = np.flatnonzero(kinds(name, h, body, start, size))
            least = np.repeat(ids[first], np.diff(np.append(first, len(name))))
            place = start - at[doc]
            gone = ids > least
            rows = merged(ids[gone], place[gone], (place + size)[gone])
            lists = [[], [], [], [], [], [], []]
            blob = lambda a, kind: press(a.astype(kind).tobytes())
            name, start, size, ids, place = (x[~gone] for x in (name, start, size, ids, place))
            shard = (name % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((start, shard))
            name, start, size, ids, place, shard = (x[order] for x in (name, start, size, ids, place, shard))
            edges = np.searchsorted(shard, np.arange(shards + 1))
            for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:
                    for x, v in zip(lists, (s, press(gathered(body, start[a:b], size[a:b]).tobytes()), blob(size[a:b], np.uint32), blob(_tags(name[a:b]), np.uint32), blob(ids[a:b], np.int64), blob(place[a:b], np.int64), None)):
                        x.append(v)
            if len(rows[0]):  # ranges that are certain pass through a shard unchanged
                for x, v in zip(lists, (int(rows[0][0]) % shards, None, None, None, blob(rows[0], np.int64), blob(rows[1], np.int64), blob(rows[2], np.int64))):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(lists[0], pa.int32()), *(pa.array(x, pa.binary()) for x in lists[1:])], names=["shard", "bytes", "size", "name", "ids", "place", "stop"])

    def resolve(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        rows = lambda x: pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in x], schema=RANGES)
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, kind, r=r: np.frombuffer(open_(batch.column(c)[r].as_py()), kind)
                if batch.column("stop")[r].is_valid:
                    yield rows((get("ids", np.int64), get("place", np.int64), get("stop", np.int64)))
                    continue
                for x, v in zip(parts, (get("bytes", np.uint8), get("size", np.uint32), get("name", np.uint32), get("ids", np.int64), get("place", np.int64))):
                    x.append(v)
        if not parts[0]:
            return
        body, size, name, ids, place = (np.concatenate(x) for x in parts)
        del parts
        size = size.astype(np.int64)
        start = np.cumsum(size) - size
        order = np.argsort(name, kind="stable")
        order = order[_several(name[order], ids[order])]  # names that one document has alone leave
        if not len(order):
            return
        keep = np.sort(order)
        body = gathered(body, start[keep], size[keep])
        size, name, ids, place = size[keep], name[keep], ids[keep], place[keep]
        start = np.cumsum(size) - size
        h = hashed(body, start, size)
        order = np.lexsort((ids, size, h, name))
        new = kinds(name[order], h[order], body, start[order], size[order])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        one = order[new]  # of equal segments that of the least doc_id
        least = ids[one]
        gone = ids > least[kind]
        yield rows(merged(ids[gone], place[gone], (place + size)[gone]))
        # a name of one kind of segment has no more to say; the others are sorted
        open_kinds = _several(name[one], np.arange(len(one)))
        if not open_kinds.any():
            return
        number = np.flatnonzero(open_kinds)
        number = number[np.argsort(start[one[number]])]
        number = number[related(body, start[one[number]], size[one[number]], name[one[number]], length)]
        if not len(number):
            return
        use = one[number]
        which, offset = runs_in_shard(body, start[use], size[use], least[number], length)
        if len(which):
            own = np.flatnonzero(~gone)
            own = own[np.argsort(kind[own], kind="stable")]
            begin = np.searchsorted(kind[own], np.arange(len(one) + 1))
            which, low, high = merged(which, offset, offset + length)
            which = number[which]
            n = (begin[1:] - begin[:-1])[which]
            at = own[np.repeat(begin[which] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            yield rows(merged(ids[at], place[at] + np.repeat(low, n), place[at] + np.repeat(high, n)))

    known = docs.where("doc_id is not null").select("doc_id", "text")
    tags = shared_names(known, shards, length).withColumnRenamed("doc_id", "_doc")
    # all columns go along and no row is left out, so that Spark deals the texts once for this join and the one in dedup()
    tagged = docs.join(tags, F.col(KEY) == F.col("_doc"), "left").withColumn("tags", F.when(F.col("doc_id").isNotNull(), F.col("tags")))
    sent = tagged.mapInArrow(tidied(send), "shard int, bytes binary, size binary, name binary, ids binary, place binary, stop binary")
    return sent.groupBy("shard").applyInArrow(resolve, "doc_id long, start long, stop long")


def dedup(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """docs with kept (the bytes left, binary), n_bytes, n_removed and n_spans.

    as_text: kept is a string, without the bytes of characters that a cut has broken.
    """
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    out = ["kept", "n_bytes", "n_removed", "n_spans"]
    docs = docs.drop(*out, "_ranges", "_doc", KEY).withColumn("text", null_safe_text())
    small_batches(docs.sparkSession)
    # rows without a doc_id are dealt by their text, and meet nothing
    own = docs.schema.fields
    docs = docs.withColumn(KEY, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")))
    ranges = removed_ranges(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("_ranges"))
    joined = docs.join(ranges.withColumnRenamed("doc_id", "_doc"), F.col(KEY) == F.col("_doc"), "left")
    joined = joined.withColumn("_ranges", F.when(F.col("doc_id").isNotNull(), F.col("_ranges"))).drop("_doc", KEY)
    own = [f for f in own if f.name != "text"]

    def run(batches):
        for batch in sliced(batches, "text", CHUNK):
            body, at = utf8(batch.column("text"))
            column = batch.column("_ranges").fill_null([])
            flat = column.flatten()
            doc = np.repeat(np.arange(len(at) - 1), pc.list_value_length(column).to_numpy(zero_copy_only=False))
            doc, start, stop = merged(doc, flat.field("start").to_numpy(), flat.field("stop").to_numpy())
            stop = np.minimum(stop, (at[1:] - at[:-1])[doc])
            start = np.minimum(start, stop)
            change = np.zeros(len(body) + 1, np.int32)
            np.add.at(change, at[doc] + start, 1)
            np.add.at(change, at[doc] + stop, -1)
            keep = np.cumsum(change[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(keep)])[at]
            n = np.diff(at)
            kept = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(body[keep].tobytes())])
            if as_text:
                kept = pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), kept, pa.array(n), pa.array(n - np.diff(left)), pa.array(np.bincount(doc, minlength=len(n)))], names=[*(f.name for f in own), *out])

    return joined.mapInArrow(tidied(run), StructType([*own, StructField("kept", StringType() if as_text else BinaryType()), *(StructField(c, LongType()) for c in out[1:])]))


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of all documents."""
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

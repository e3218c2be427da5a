"""Byte-level BPE encoding and decoding (operator 8).

Texts are split by the tokenizer's pattern. The different matches of a batch that were not met
before are encoded together: they are dealt by length into padded numpy matrices of token ranks, and
in each round every row merges its leftmost pair of least rank. The rank of a pair comes from an
open-addressing hash table; the columns behind a merge move one place left, and finished rows leave
the matrix. Matches too long for a matrix go through a heap. Decoding gathers the bytes of all ids
at once.

Defined results: a null or empty text has no ids and decodes to nothing; ties between equal pairs go
to the left; repeated texts are encoded alike; other columns are kept, but for ``ids`` and
``decoded``, which are replaced. Texts are whole at any length; the memory of a task is bounded by
its batch (4 MB of text, or one text) and a cache of CACHE matches.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, append_columns

NONE = np.int32(2**31 - 1)
#: Matches of more bytes are merged with a heap instead of a matrix.
LONG = 512
#: Rows of a matrix times its columns.
CELLS = 1 << 20
#: Matches remembered in a task.
CACHE = 200_000
PLAIN = frozenset(",.;:!?")
HASH = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left rank, right rank) -> rank of the merged token, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int], size: int):
        self.bits = max(8, int(len(pairs) * 3).bit_length())
        self.size = size
        n = 1 << self.bits
        self.keys = np.full(n, -1, np.int64)
        self.ranks = np.full(n, NONE, np.int32)
        left = np.array([a * size + b for a, b in pairs], np.int64)
        rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        at, self.probes = self.slot(left), 0
        while len(left):  # each round seats, of the keys that want a free slot, the last one
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]
            seated = self.keys[at] == left
            self.ranks[at[seated]] = rank[seated]
            left, rank, at = left[~seated], rank[~seated], (at[~seated] + 1) & (n - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        for _ in range(self.probes - 1):
            todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
            if not len(todo):
                break
            keys_left = keys[todo]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = np.where(self.keys[at[todo]] == keys_left, self.ranks[at[todo]], NONE)
        return out


class Bpe:
    """The vocabulary at path (base64 token and rank in each line) and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.findall = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = pairs
        self.table = PairTable(pairs, size)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.array([len(x) for x in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.chunks, self.matches = Recent(CACHE // 2), Recent(CACHE)

    def merged(self, row: bytes) -> np.ndarray:
        """The ids of one long match: a heap of (rank, place) over a linked list."""
        ids = self.single[np.frombuffer(row, np.uint8)].tolist()
        n = len(ids)
        after, before, get = [*range(1, n), -1], [*range(-1, n - 1)], self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (x := get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := get((ids[h], r))) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge_matrix(self, rows: list[bytes]) -> list[bytes]:
        """The ids of matches of about one length, as the bytes of 32-bit numbers."""
        n, width = len(rows), max(map(len, rows))
        lengths = np.fromiter(map(len, rows), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width][np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        pair = np.full((n, width), NONE, np.int32)
        inner = np.arange(width - 1) < lengths[:, None] - 1
        pair[:, : width - 1][inner] = self.table(ids[:, : width - 1][inner], ids[:, 1:width][inner])
        done, live = [b""] * n, np.arange(n)
        columns = np.arange(width)
        while len(live):
            best = pair.argmin(axis=1)
            each = np.arange(len(live))
            rank = pair[each, best]
            over = rank == NONE
            if over.any():
                for i in np.flatnonzero(over).tolist():
                    done[live[i]] = ids[i, : lengths[i]].tobytes()
                stay = ~over
                live, ids, pair, best, rank, lengths = live[stay], ids[stay], pair[stay], best[stay], rank[stay], lengths[stay]
                if not len(live):
                    break
                if (width := int(lengths.max())) < pair.shape[1]:
                    ids, pair, columns = ids[:, : width + 1], pair[:, :width], columns[:width]
                each = np.arange(len(live))
            moved = np.minimum(columns + (columns > best[:, None]), width)
            ids[:, :width] = np.take_along_axis(ids, moved, axis=1)
            pair = np.take_along_axis(pair, np.minimum(moved, width - 1), axis=1)
            pair[:, -1] = NONE
            ids[each, best] = rank
            lengths = lengths - 1
            ids[each, lengths] = -1
            right = ids[each, best + 1]
            pair[each, best] = np.where(right >= 0, self.table(rank, np.maximum(right, 0)), NONE)
            some = np.flatnonzero(best > 0)
            left = best[some] - 1
            pair[some, left] = self.table(ids[some, left], rank[some])
        return done

    def encode_matches(self, new: list[str]) -> None:
        """Put the ids of these matches into the cache."""
        known = self.matches.new
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for text in new:
            raw = text.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                known[text] = np.int32(rank).tobytes()
            elif len(raw) > LONG:
                known[text] = self.merged(raw).tobytes()
            else:
                by_width.setdefault(-(-len(raw) // 4), []).append((text, raw))
        for width, rows in by_width.items():
            step = max(1, CELLS // (4 * width))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                for (text, _), ids in zip(part, self.merge_matrix([raw for _, raw in part])):
                    known[text] = ids

    def cut(self, chunk: str) -> list[str]:
        """The pattern's matches in a chunk; plain words need no search, as letters of one run are one match."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in PLAIN and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.findall(chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of 32-bit numbers.

        A text in which each space stands before a non-blank character may be cut before its spaces
        without change to the matches; such chunks are remembered too,
        without their space.
        """
        parts = [None if double_blank(t) else t.split(" ") for t in texts]
        seen = set()
        for p in parts:
            if p is not None:
                seen.update(p[1:])
        chunks = self.chunks.missing(seen)
        found = [self.cut(" " + c) for c in chunks]
        whole = [self.findall(t) if p is None else self.findall(p[0]) for t, p in zip(texts, parts)]
        need = {m for f in found for m in f}
        need.update(*whole)
        self.encode_matches(self.matches.missing(need))
        known, matches = self.chunks.new, self.matches.new
        known.update((c, b"".join([matches[m] for m in f])) for c, f in zip(chunks, found))
        get = known.__getitem__
        return [b"".join([matches[m] for m in w] + ([] if p is None else [*map(get, p[1:])])) for p, w in zip(parts, whole)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the place behind each id's bytes."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return np.zeros(0, np.uint8), ends
        return self.bytes[np.repeat(self.start[ids] - ends + lengths, lengths) + np.arange(ends[-1])], ends


double_blank = re.compile(r" (?:\s|$)").search


@functools.lru_cache(maxsize=2)
def loaded(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs without text, with ids (array<int>) and decoded (the bytes that the ids stand for)."""

    def make():
        bpe = loaded(path, pattern)

        def work(batch):
            texts = batch.column("text").fill_null("").to_pylist()
            rows = bpe.encode(texts)
            ids = np.frombuffer(b"".join(rows), np.int32)
            at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
            body, ends = bpe.decode(ids)
            ends = np.concatenate([[0], ends]).astype(np.int64)[at]
            return [
                pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body.tobytes())]),
            ]

        return work

    return append_columns(docs, make, "ids array<int>, decoded binary", drop=("text",))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of encode_decode() over all documents with the public byte-level vocabulary."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

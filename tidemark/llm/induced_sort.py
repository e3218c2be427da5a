"""External induced suffix sorting with common prefixes, by queues that go to disk and recursion on names.

The suffixes of a text are sorted as far as `depth` bytes. Suffixes that begin where a rising run
follows a falling one (leftmost-S) are sorted first: one induction sorts the pieces between them,
the pieces get names, and the shorter text of names is sorted by the same method, again and again, until
its names are all different or one name is as deep as `depth` asks. A second induction then carries the
sorted suffixes to all others: left to right for the falling (L) ones, right to left for the rising (S)
ones.

An induction is a priority queue of tuples (place, common prefix with the tuple before) whose rank is
their order: a batch taken from the front sends the tuples of the preceding suffixes to the queues of
their first bytes, so each queue stays sorted, and is read once, in order. The common prefix of two
tuples that become neighbours is one more than the least common prefix of all tuples between their
origins, which a table of minima over the batch gives. Texts of names have too many symbols for a queue
each: there a queue is a range of names, which is sorted when its turn comes.

A Store bounds what is in memory: beyond its limit all queues go to one file, and texts, types, names and
orders larger than a part of it lie in files that are mapped, not read. All files are gone with the sort.
What one range of names holds is in memory: RANGE tuples, or all of a name that occurs more often. The
order comes out as a stream, from the largest suffix down.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queues and of tables that stay in memory.
LIMIT = 32 << 20
#: Tuples taken from a queue at once, and tuples of a range of names.
BATCH, RANGE = 1 << 18, 1 << 18


class Store:
    """Memory for queues and tables up to a limit, and files beyond."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self.held, self.spilled, self.mapped, self.queues, self.file = limit, 0, 0, 0, [], None

    def table(self, n: int, kind) -> np.ndarray:
        """n zeros."""
        size = n * np.dtype(kind).itemsize
        if size <= self.limit // 8:
            return np.zeros(n, kind)
        self.mapped += size
        return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))

    def queue(self) -> Queue:
        self.queues.append(out := Queue(self))
        return out

    def make_room(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for q in self.queues:
            q.to_disk()
        self.held = 0

    def write(self, x: np.ndarray) -> int:
        self.file.seek(0, 2)
        at = self.file.tell()
        self.file.write(np.ascontiguousarray(x))
        self.spilled += x.nbytes
        return at

    def read(self, at: int, n: int, kind) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(bytearray(self.file.read(n * np.dtype(kind).itemsize)), kind)


class Queue:
    """First in, first out, for blocks of places and common prefixes (or none)."""

    def __init__(self, store: Store):
        self.store, self.blocks, self.count = store, [], 0

    def push(self, place: np.ndarray, lcp: np.ndarray | None = None) -> None:
        if not len(place):
            return
        last = self.blocks[-1] if self.blocks else None
        if last is not None and last[0] is not None and len(last[0]) + len(place) <= 4096:  # small pieces make one block
            self.blocks[-1] = (np.concatenate([last[0], place]), None if lcp is None else np.concatenate([last[1], lcp]))
        else:
            self.blocks.append((place.copy(), None if lcp is None else lcp.copy()))
        self.count += len(place)
        self.store.held += place.nbytes + (0 if lcp is None else lcp.nbytes)
        if self.store.held > self.store.limit:
            self.store.make_room()

    def to_disk(self) -> None:
        for i, b in enumerate(self.blocks):
            if b[0] is not None:
                self.blocks[i] = (None, len(b[0]), b[0].dtype, self.store.write(b[0]), None if b[1] is None else self.store.write(b[1]))

    def _get(self, block) -> tuple[np.ndarray, np.ndarray | None]:
        if block[0] is not None:
            self.store.held = max(0, self.store.held - block[0].nbytes - (0 if block[1] is None else block[1].nbytes))
            return block
        _, n, kind, place, lcp = block
        return self.store.read(place, n, kind), None if lcp is None else self.store.read(lcp, n, np.uint8)

    def drain(self, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """All that was pushed, block by block, in order or from the last block on; what is pushed meanwhile comes at the next call."""
        blocks, self.blocks, self.count = self.blocks[::-1] if backwards else self.blocks, [], 0
        for i in range(len(blocks)):
            yield self._get(blocks[i])
            blocks[i] = None

    def all(self) -> np.ndarray:
        """All places that were pushed."""
        return np.concatenate([np.zeros(0, np.int32), *(p for p, _ in self.drain())])


def _parts(n: int, backwards: bool = False) -> Iterator[tuple[int, int]]:
    edges = [(i, min(n, i + BATCH)) for i in range(0, n, BATCH)]
    return iter(edges[::-1] if backwards else edges)


class Text:
    """Symbols (the last the only least one) with the type of each suffix."""

    def __init__(self, t: np.ndarray, n: int, store: Store):
        """t: n symbols, for bytes with 64 zeros behind them."""
        self.t, self.n, self.store = t, n, store
        self.rising = store.table(n, bool)
        after_symbol, after_type, count = -1, True, 0
        for a, b in _parts(n, backwards=True):
            x = t[a:b].astype(np.int64)
            step = np.sign(np.append(x[1:], after_symbol if b < n else -1) - x)
            if b == n:
                step[-1] = 1
            at = np.where(step != 0, np.arange(len(x)), len(x))
            nxt = np.minimum.accumulate(at[::-1])[::-1]
            self.rising[a:b] = np.append(step, 1 if after_type else -1)[nxt] > 0
            after_symbol, after_type = int(x[0]), bool(self.rising[a])
        if t.dtype == np.uint8:
            self.words = np.ndarray((n + 56,), "V8", buffer=t, strides=(1,))  # eight bytes from each place on

    def is_lms(self, place: np.ndarray) -> np.ndarray:
        return (place > 0) & self.rising[place] & ~self.rising[place - 1]

    def lms(self) -> Iterator[np.ndarray]:
        """Places of the leftmost-S suffixes, block by block."""
        for a, b in _parts(self.n):
            r = self.rising[max(0, a - 1) : b]
            yield (np.flatnonzero(r[1:] & ~r[:-1]) + max(1, a)).astype(np.int32 if self.n < 1 << 31 else np.int64)

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Common prefixes of the suffixes at a and b, counted up to depth (250 at most), of bytes."""
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        for i in range(0, depth, 8):
            x, y = (self.words[np.minimum(p[open_] + i, self.n)].view(">u8") for p in (a, b))
            x = (x ^ y).astype(np.uint64)
            lead = np.full(len(x), 8)
            differ = x != 0
            lead[differ] = _lead(x[differ])
            out[open_] += lead
            open_ = open_[~differ]
            if not len(open_):
                break
        return np.minimum(out, depth).astype(np.uint8)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
        """Whether `size` symbols (of which depth count) from a and b on are equal."""
        if self.t.dtype == np.uint8:
            most = np.minimum(size, min(depth, 248))
            return self.common(a, b, min(int(most.max(initial=0)), 248)) >= most
        out, open_ = np.ones(len(a), bool), np.arange(len(a))
        for i in range(min(depth, int(size.max(initial=0)))):
            open_ = open_[size[open_] > i]
            equal = self.t[a[open_] + i] == self.t[b[open_] + i]
            out[open_[~equal]] = False
            open_ = open_[equal]
        return out


def _lead(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of 64-bit numbers that aren't 0."""
    out = np.zeros(len(x), np.int64)
    for bits, count in ((32, 4), (16, 2), (8, 1)):
        low = x < np.uint64(1) << np.uint64(64 - bits)
        out += count * low
        x = np.where(low, x << np.uint64(bits), x)
    return out


class Induction:
    """Sends the suffixes before those scanned to the queues of their first bytes."""

    def __init__(self, text: Text, rising: bool, depth: int, carry: bool):
        self.text, self.rising, self.depth, self.carry = text, rising, depth, carry
        self.queues = [text.store.queue() for _ in range(256)]
        self.run = np.zeros(256, np.uint8)  # least common prefix since the last tuple sent to each queue

    def scan(self, place: np.ndarray, lcp: np.ndarray | None) -> None:
        for a, b in _parts(len(place)):
            self._scan(place[a:b], None if lcp is None else lcp[a:b])

    def _scan(self, place: np.ndarray, lcp: np.ndarray | None) -> None:
        before = place - 1
        use = np.flatnonzero((before >= 0) & (self.text.rising[before] == self.rising))
        if not len(use):
            if self.carry:
                self.run = np.minimum(self.run, lcp.min())
            return
        first = self.text.t[before[use]]
        order = np.argsort(first, kind="stable")
        use, first = use[order], first[order]
        kinds, starts = np.unique(first, return_index=True)
        ends = np.append(starts[1:], len(first))
        out = None
        if self.carry:
            levels, width = [lcp], 1
            while 2 * width <= len(lcp):
                levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
                width *= 2
            prev = np.empty(len(use), np.int64)
            prev[1:] = use[:-1]
            prev[starts] = -1
            level = np.frexp((use - prev).astype(np.float64))[1] - 1
            out = np.empty(len(use), np.uint8)
            for k in np.unique(level).tolist():
                at = np.flatnonzero(level == k)
                out[at] = np.minimum(levels[k][prev[at] + 1], levels[k][use[at] - (1 << k) + 1])
            out[starts] = np.minimum(out[starts], self.run[kinds])
            after = np.minimum.accumulate(lcp[::-1])[::-1]  # least from each place of the batch on
            self.run = np.minimum(self.run, after[0])
            last = use[ends - 1] + 1
            self.run[kinds] = np.where(last < len(lcp), after[np.minimum(last, len(lcp) - 1)], self.depth)
            out = np.minimum(out + 1, self.depth).astype(np.uint8)
        moved = before[use]
        for c, a, b in zip(kinds.tolist(), starts.tolist(), ends.tolist()):
            self.queues[c].push(moved[a:b], None if out is None else out[a:b])

    def bucket(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """The tuples of a first byte, in order, each block being scanned before the next is given."""
        new = True
        while self.queues[c].count:
            for p, x in self.queues[c].drain():
                if new and self.carry:
                    x = x.copy()
                    x[0] = 0  # nothing in common with the byte before
                new = False
                yield p, x
                self.scan(p, x)


def induce(text: Text, seeds: list[Queue], depth: int, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None, bool]]:
    """All suffixes from the largest down, in blocks of one type: places, common prefixes with the one before (the next larger), and whether they are S.

    seeds: for each byte its leftmost-S suffixes, rising.
    """
    one = lambda a, b: text.common(a, b, depth)[0]
    left, falling = Induction(text, False, depth, carry), [text.store.queue() for _ in range(256)]
    for c in range(256):
        last = None
        for p, x in left.bucket(c):
            falling[c].push(p, x)
            last = p[-1:]
        for k, (s, x) in enumerate(seeds[c].drain()):
            if carry and k == 0:
                x = x.copy()
                x[0] = one(last, s[:1]) if last is not None else 0
            left.scan(s, x)
    right = Induction(text, True, depth, carry)
    for c in range(255, -1, -1):
        last = None
        for p, x in right.bucket(c):
            yield p, x, True
            last = p[-1:]
        if c == 0:  # the end of the text, which nothing precedes in order
            p, x = np.array([text.n - 1], np.int32), np.zeros(1, np.uint8)
            yield p, x if carry else None, True
            right.scan(p, x if carry else None)
            last = p
        next_ = None  # of the block just given its first tuple's common prefix with the one below
        for p, x in falling[c].drain(backwards=True):
            back = None
            if carry:
                back = np.empty(len(p), np.uint8)
                back[1:] = x[:0:-1]
                back[0] = next_ if next_ is not None else one(last, p[-1:]) if last is not None else 0
                next_ = x[0]
            yield p[::-1], back, False
            right.scan(p[::-1], back)


def _named(text: Text, order: Iterator[np.ndarray], depth: int) -> tuple[Text | None, np.ndarray, int]:
    """The text of names of the pieces that begin at leftmost-S suffixes, and their places.

    order: these places from the largest piece down. The text is None if all names differ; the places then come
    in that order's reverse, and else in the order of the text.
    """
    store, n = text.store, text.n
    after, count, last = store.table(n // 2 + 1, np.int32), 0, None  # the piece's length, by half its place
    for p in text.lms():
        if len(p):
            if last is not None:
                after[last // 2] = p[0] - last + 1
            after[p[:-1] // 2] = np.diff(p) + 1
            last, count = int(p[-1]), count + len(p)
    if last is not None:
        after[last // 2] = 1
    name, falling, kinds, before, done = store.table(n // 2 + 1, np.int32), store.table(count, np.int32), 0, None, 0
    for p in order:
        if not len(p):
            continue
        q = p if before is None else np.append(before, p)
        size = after[q // 2]
        new = size[1:] != size[:-1]
        at = np.flatnonzero(~new)
        new[at] = ~text.same(q[1:][at], q[:-1][at], size[1:][at], depth)
        if before is None:
            new = np.append(True, new)
        number = kinds + np.cumsum(new)
        name[p // 2] = number
        kinds, before = int(number[-1]), p[-1:]
        falling[count - done - len(p) : count - done] = p[::-1]
        done += len(p)
    if kinds == count:
        return None, falling, kinds
    short, places, done = store.table(count, np.int32), falling, 0
    for p in text.lms():
        short[done : done + len(p)] = kinds + 1 - name[p // 2]
        places[done : done + len(p)] = p
        done += len(p)
    return Text(short, count, store), places, kinds


def _chained(symbol: np.ndarray, parent: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The order of items by symbol, then by the item behind (parent; those behind which is none, the first len(tie), come first, by tie).

    Ranks of items that others lie before are made finer by the rank of what is behind them, then behind that
    twice as far, and so on.
    """
    n, free = len(symbol), len(tie)
    child = parent >= 0
    whole = np.zeros(n, np.int64)
    whole[:free] = tie
    order = np.lexsort((whole, child, symbol))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    at = order[child[order]]  # children, those of one symbol side by side
    if not len(at):
        return order
    new = np.append(True, symbol[at][1:] != symbol[at][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[at] = rank[at][first]  # of equal ones that of the first
    up = parent.copy()
    while True:
        tied = np.zeros(len(at), bool)
        tied[1:] = rank[at][1:] == rank[at][:-1]
        tied[:-1] |= tied[1:]
        open_ = at[tied]
        if not len(open_):
            break
        behind = np.where(up[open_] >= 0, rank[up[open_]], -1)
        by = np.lexsort((behind, rank[open_]))
        mine, behind = rank[open_][by], behind[by]
        group = np.append(True, mine[1:] != mine[:-1])
        start = np.flatnonzero(group)[np.cumsum(group) - 1]
        fine = group | np.append(True, behind[1:] != behind[:-1])
        within = np.flatnonzero(fine)[np.cumsum(fine) - 1] - start
        known = up[open_] >= 0
        jump = np.where(known, up[np.maximum(up[open_], 0)], -1)
        if not known.any():  # what is left is equal
            break
        rank[open_[by]] = mine + within
        up[open_] = jump
        at = open_[by]
    return np.argsort(rank, kind="stable")


def _sweep(text: Text, edges: np.ndarray, given: list[Queue], rising: bool, depth: int) -> list[Queue]:
    """The suffixes of one type of a text of names, range by range, in the order of the sweep (falling for S), induced from those given in that order."""
    t, store = text.t, text.store
    inbox, found = ([store.queue() for _ in given] for _ in range(2))
    for r in reversed(range(len(given))) if rising else range(len(given)):
        new, old = inbox[r].all(), given[r].all()
        place, kind = [new, old], [np.zeros(len(new), np.int64), np.ones(len(old), np.int64)]
        parent = [np.full(len(new) + len(old), -1)]
        tie = np.concatenate([np.arange(len(new)), np.arange(len(old))])
        last, at = np.concatenate(place), np.arange(len(new) + len(old))
        total = len(last)
        while len(last):  # what they send to this same range, and so on
            before = last - 1
            own = np.flatnonzero(before >= 0)
            own = own[text.rising[before[own]] == rising]
            own = own[(t[before[own]] >= edges[r]) & (t[before[own]] < edges[r + 1])]
            last, parent_ = before[own], at[own]
            at = np.arange(total, total + len(last))
            total += len(last)
            place.append(last)
            parent.append(parent_)
            kind.append(np.zeros(len(last), np.int64))
        place, parent, kind = np.concatenate(place), np.concatenate(parent), np.concatenate(kind)
        if not len(place):
            continue
        order = _chained(t[place].astype(np.int64) * (-2 if rising else 2) + kind, parent, tie)
        place = place[order]
        found[r].push(place[kind[order] == 0])
        before = place - 1
        before = before[before >= 0]
        before = before[text.rising[before] == rising]
        before = before[(t[before] < edges[r]) | (t[before] >= edges[r + 1])]
        to = np.searchsorted(edges, t[before], "right") - 1
        order = np.argsort(to, kind="stable")
        kinds, starts = np.unique(to[order], return_index=True)
        for k, part in zip(kinds.tolist(), np.split(before[order], starts[1:])):
            inbox[k].push(part)
    return found


def _dealt(text: Text, edges: np.ndarray, places: Iterator[np.ndarray]) -> list[Queue]:
    """Places by the range of their symbol, in the order in which they come."""
    out = [text.store.queue() for _ in edges[1:]]
    for p in places:
        to = np.searchsorted(edges, text.t[p], "right") - 1
        order = np.argsort(to, kind="stable")
        kinds, starts = np.unique(to[order], return_index=True)
        for k, part in zip(kinds.tolist(), np.split(p[order], starts[1:])):
            out[k].push(part)
    return out


def _sorted_names(text: Text, kinds: int, depth: int) -> np.ndarray:
    """The places of a text of the names 1 to kinds in suffix order, as far as depth names."""
    t, store, n = text.t, text.store, text.n
    count = store.table(kinds + 1, np.int32)
    for a, b in _parts(n):
        np.add.at(count, t[a:b], 1)
    edges, total = [1], 0
    for a, b in _parts(kinds + 1):  # names until a range is full
        run = np.cumsum(count[a:b].astype(np.int64)) + total
        total = int(run[-1])
        part = run // RANGE
        edges += (np.flatnonzero(np.diff(part)) + 1 + a).tolist()
    edges = np.unique(np.append([e for e in edges if 1 <= e <= kinds], kinds + 1))
    out, done = store.table(n, np.int32), 0

    def by_symbol(queue: Queue) -> np.ndarray:
        p = queue.all()
        return p[np.argsort(t[p], kind="stable")]

    if depth <= 1 or kinds == n:
        for q in _dealt(text, edges, (np.arange(a, b, dtype=np.int32) for a, b in _parts(n))):
            p = by_symbol(q)
            out[done : done + len(p)] = p
            done += len(p)
        return out

    def induced(seeds: list[Queue]) -> tuple[list[Queue], list[Queue]]:
        """L suffixes of each range, rising, and S suffixes, falling."""
        falling = _sweep(text, edges, seeds, False, depth)
        held, back = [q.all() for q in falling] if n <= RANGE else None, [store.queue() for _ in falling]
        keep = [store.queue() for _ in falling]
        for r, q in enumerate(falling):
            p = held[r] if held is not None else q.all()
            keep[r].push(p)
            back[r].push(p[::-1])
        return keep, _sweep(text, edges, back, True, depth)

    seeds = _dealt(text, edges, text.lms())
    for q in seeds:
        p = by_symbol(q)
        q.push(p)
    _, rising = induced(seeds)

    def pieces() -> Iterator[np.ndarray]:
        for q in reversed(rising):
            p = q.all()
            yield p[text.is_lms(p)]
        yield np.array([n - 1], np.int32)

    short, places, many = _named(text, pieces(), depth)
    if short is not None:
        order = _sorted_names(short, many, depth // 2 + 1)
        ordered = (places[order[a:b]] for a, b in _parts(len(order)))
    else:
        ordered = (places[a:b] for a, b in _parts(len(places)))
    falling, rising = induced(_dealt(text, edges, ordered))
    out[0], done = n - 1, 1
    for low, high in zip(falling, rising):
        p = np.concatenate([low.all(), high.all()[::-1]])
        p = p[np.argsort(2 * t[p].astype(np.int64) + text.rising[p], kind="stable")]
        out[done : done + len(p)] = p
        done += len(p)
    return out


def suffixes(t: np.ndarray, n: int, depth: int, store: Store | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places, common prefixes with the place before, up to depth), from the largest suffix down, sorted as far as depth.

    t: n bytes of which the last is the only 0, and 64 zeros behind them. The order of suffixes that agree in
    depth bytes is any.
    """
    store = store or Store()
    text = Text(t, n, store)

    def seeded(places: Iterator[np.ndarray], carry: bool) -> list[Queue]:
        out, before = [store.queue() for _ in range(256)], None
        for p in places:
            if not len(p):
                continue
            lcp = None
            if carry:
                q = p if before is None else np.append(before, p)
                lcp = text.common(q[1:], q[:-1], depth)
                lcp = np.append(np.uint8(0), lcp) if before is None else lcp
                before = p[-1:]
            order = np.argsort(t[p], kind="stable")
            kinds, starts = np.unique(t[p[order]], return_index=True)
            ends = np.append(starts[1:], len(p))
            for c, a, b in zip(kinds.tolist(), starts.tolist(), ends.tolist()):
                out[c].push(p[order[a:b]], None if lcp is None else lcp[order[a:b]])
        return out

    rough = induce(text, seeded(text.lms(), False), depth, False)
    short, places, kinds = _named(text, (p[text.is_lms(p)] for p, _, rising in rough if rising), depth)
    if short is not None:
        order = _sorted_names(short, kinds, depth // 2 + 1)
        ordered = (places[order[a:b]] for a, b in _parts(len(order)))
    else:
        ordered = (places[a:b] for a, b in _parts(len(places)))
    for p, lcp, _ in induce(text, seeded(ordered, True), depth, True):
        yield p, lcp

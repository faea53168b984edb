"""Induced suffix sorting of one shard, with common prefixes.

Suffixes are sorted by inducing: the sampled ones (an S-type suffix after an L-type one) are sorted by
their names, in a recursion on the shorter text of names; from their order a first scan induces all
L-type suffixes and a second all S-type ones.  Both scans run on priority queues that spill sorted runs
to disk; their entries carry the suffix and its common prefix with the entry queued before it.  The
text is a memory-mapped file.  Memory holds the queues' buffers, and besides them the sampled suffixes,
their names and the arrays of types, which grow with the shard.

At some 140 microseconds a byte this is too slow for a whole corpus (README), which
:mod:`driftline.llm.suffix` handles; here it is the order itself, for shards.
"""

from __future__ import annotations

import heapq
import os
import tempfile

import numpy as np


class DiskQueue:
    """A queue of integer tuples, smallest first, that keeps at most ``room`` of them in memory."""

    def __init__(self, folder: str, width: int, room: int):
        self.folder, self.width, self.room = folder, width, room
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (next tuple, run, iterator) of each spilled run
        self.runs = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.room:
            self.heap.sort()
            path = os.path.join(self.folder, f"run-{id(self)}-{self.runs}")
            np.array(self.heap, dtype=np.int64).tofile(path)
            self.heap = []
            rows = self._read(path)
            heapq.heappush(self.heads, (next(rows), self.runs, rows))
            self.runs += 1

    def _read(self, path: str, block: int = 4096):
        size = os.path.getsize(path) // (8 * self.width)
        for at in range(0, size, block):
            part = np.fromfile(path, dtype=np.int64, count=self.width * min(block, size - at), offset=8 * self.width * at)
            yield from map(tuple, part.reshape(-1, self.width).tolist())
        os.unlink(path)

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run, rows = self.heads[0]
            following = next(rows, None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, run, rows))
            return item
        return heapq.heappop(self.heap)


class _Writer:
    """Rows of two integers, written a block at a time."""

    def __init__(self, out, block: int = 1 << 14):
        self.out, self.block, self.rows = out, block, []

    def put(self, row: tuple[int, int]) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.block:
            self.flush()

    def flush(self) -> None:
        np.array(self.rows, dtype=np.int64).tofile(self.out)
        self.rows = []


class _Prefixes:
    """Smallest common prefix since the last entry queued for each character."""

    def __init__(self, limit: int, unique: int):
        self.least: dict[int, int] = {}
        self.limit = limit
        self.unique = unique  # characters below occur once: separators

    def scanned(self, lcp: int) -> None:
        for c, v in self.least.items():
            if lcp < v:
                self.least[c] = lcp

    def queued(self, c: int) -> int:
        """Common prefix of the suffix queued now and the last one queued for the same character."""
        if c < self.unique:
            return 0
        known = self.least.get(c)
        self.least[c] = self.limit
        return 0 if known is None else min(self.limit, known + 1)


def _common(text, a: int, b: int, limit: int) -> int:
    n = min(limit, len(text) - max(a, b))
    differ = np.nonzero(text[a : a + n] != text[b : b + n])[0]
    return int(differ[0]) if len(differ) else n


def _types(text) -> np.ndarray:
    """True where a suffix is S-type: smaller than the one after it; the last character, smallest of all, is."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))  # > 0: S, < 0: L, 0: as the next one
    at = np.where(step != 0, np.arange(n - 1), n)
    follows = np.minimum.accumulate(at[::-1])[::-1]
    s = np.ones(n, dtype=bool)
    s[:-1] = np.append(step, 1)[np.minimum(follows, n - 1)] > 0
    return s


def _induce(text, small: np.ndarray, sampled, folder: str, room: int, limit: int, unique: int = 0):
    """(positions, common prefixes with the next larger suffix) of all suffixes in descending order, from sampled ones in ascending order."""
    lefts = DiskQueue(folder, 4, room)  # (character, order of queueing, suffix, common prefix with the last of this character)
    near, count, last = _Prefixes(limit, unique), 0, None
    spill = os.path.join(folder, f"left-{id(lefts)}")
    with open(spill, "wb") as out:
        written = _Writer(out)
        sampled = iter(sampled)
        star = next(sampled, None)
        while star is not None or lefts.peek() is not None:
            head = lefts.peek()
            if head is not None and (star is None or head[0] <= text[star]):
                c, _, i, lcp = lefts.pop()
                if last is not None and (text[last] != c or small[last]):
                    lcp = _common(text, last, i, limit)
                written.put((i, lcp))
            else:
                i, star = star, next(sampled, None)
                lcp = 0 if last is None else _common(text, last, i, limit)
            near.scanned(lcp)
            last = i
            if i and not small[i - 1]:
                lefts.push((int(text[i - 1]), count, i - 1, near.queued(int(text[i - 1]))))
                count += 1
        written.flush()
    left = np.memmap(spill, dtype=np.int64, mode="r").reshape(-1, 2) if os.path.getsize(spill) else np.zeros((0, 2), dtype=np.int64)
    rights, near, count, last, at = DiskQueue(folder, 4, room), _Prefixes(limit, unique), 0, None, len(left)
    rights.push((-int(text[-1]), -1, len(text) - 1, 0))  # the last character's suffix follows from no other
    before = None
    while at or rights.peek() is not None:
        head = rights.peek()
        if head is not None and (not at or -head[0] >= text[left[at - 1][0]]):
            _, _, i, lcp = rights.pop()
            if last is not None and (text[last] != text[i] or not small[last]):
                lcp = 0 if text[last] != text[i] else _common(text, last, i, limit)
        else:
            at -= 1
            i = int(left[at][0])
            lcp = before if last is not None and not small[last] and before is not None else (0 if last is None else _common(text, last, i, limit))
            before = int(left[at][1]) if at and text[left[at - 1][0]] == text[i] else None
        if last is not None and small[i]:
            before = None
        yield i, (0 if last is None else lcp)
        near.scanned(lcp)
        last = i
        if i and small[i - 1]:
            rights.push((-int(text[i - 1]), count, i - 1, near.queued(int(text[i - 1]))))
            count += 1
    del left
    os.unlink(spill)


def _sorted(text, folder: str, room: int, limit: int, unique: int = 0):
    """Suffixes of an integer text that ends with its smallest character, in descending order, as :func:`_induce` gives them."""
    small = _types(text)
    starts = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    if len(starts) > 1:
        # a first induction from any order by first character sorts the sampled substrings
        rough = starts[np.argsort(text[starts], kind="stable")]
        star = np.zeros(len(text), dtype=bool)
        star[starts] = True
        order = [i for i, _ in _induce(text, small, rough.tolist(), folder, room, 0) if star[i]][::-1]
        ends = dict(zip(starts.tolist(), [*starts[1:].tolist(), len(text) - 1]))
        names, name = np.zeros(len(text), dtype=np.int64), 0
        for a, b in zip(order, order[1:]):
            na, nb = ends[a] - a + 1, ends[b] - b + 1
            name += na != nb or not np.array_equal(text[a : a + na], text[b : b + nb])
            names[b] = name
        if name + 1 < len(starts):
            shorter = names[starts]
            ranks = [i for i, _ in _sorted(shorter, folder, room, 0)][::-1]
            order = [int(starts[i]) for i in ranks]
    else:
        order = starts.tolist()
    return _induce(text, small, order, folder, room, limit, unique)


def suffix_order(texts: list[bytes], limit: int = 100, room: int = 1 << 18):
    """Yield (document, position, common prefix with the suffix before it) of all suffixes of ``texts`` in ascending order.

    Prefixes end with their document and count up to ``limit``.  Documents are laid end to end with a
    separator of its own after each.  Runs and the text lie in a temporary folder of this machine that
    is removed at the end.
    """
    n = len(texts)
    if not sum(map(len, texts)):
        return
    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "text")
        with open(path, "wb") as f:
            for k, t in enumerate(texts):
                (np.frombuffer(t, dtype=np.uint8).astype(np.int32) + n).tofile(f)
                np.array([n - 1 - k], dtype=np.int32).tofile(f)
        text = np.memmap(path, dtype=np.int32, mode="r")
        out = os.path.join(folder, "order")
        with open(out, "wb") as f:
            written = _Writer(f)
            for row in _sorted(text, folder, room, limit, n):
                written.put(row)
            written.flush()
        rows = np.memmap(out, dtype=np.int64, mode="r").reshape(-1, 2)
        ends = np.cumsum([len(t) + 1 for t in texts])
        lcp = 0
        for k in range(len(rows) - 1, -1, -1):
            i, following = rows[k].tolist()
            if text[i] >= n:
                doc = int(np.searchsorted(ends, i, side="right"))
                yield doc, i - int(ends[doc]) + len(texts[doc]) + 1, lcp
            lcp = following


def order_shards(docs, shards: int, limit: int = 100):
    """(shard, rank, doc_id, position, lcp) of every suffix of ``docs(doc_id, text, ...)``, documents dealt to shards by a hash.

    ``lcp`` is the common prefix with the suffix before it in the shard.  Null texts and null ids count
    as empty and -1; other columns are not read.
    """
    from pyspark.sql import functions as F

    from driftline.llm.common import whole_text

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    def run(group):
        import pyarrow as pa

        names = group.column("doc_id").to_numpy()
        found = np.fromiter(suffix_order([t.as_py().encode() for t in group.column("text")], limit), dtype=[("doc", "i8"), ("at", "i8"), ("lcp", "i8")])
        doc, at, lcp = (np.ascontiguousarray(found[k]) for k in ("doc", "at", "lcp"))
        shard = group.column("shard")[0].as_py()
        return pa.table([pa.array(np.full(len(at), shard)), pa.array(np.arange(len(at))), pa.array(names[doc]), pa.array(at), pa.array(lcp)], names=["shard", "rank", "doc_id", "position", "lcp"])

    return rows.groupBy("shard").applyInArrow(run, "shard long, rank long, doc_id long, position long, lcp long")

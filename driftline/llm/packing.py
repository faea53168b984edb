"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

Documents are dealt at random (a seeded hash) into groups of bounded size; each group is packed by
itself, so no task holds more than one group and no step sees the whole corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import partitions_for, whole_text

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Documents a partition is dealt, and rows a batch holds.
PART_DOCS, FLUSH = 4096, 4096


class CapacityTree:
    """A tournament tree: each leaf is a bin's free room, each inner node the larger of its two."""

    def __init__(self, bins: int, room: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.room = room
        self.best = [room] * (2 * self.width)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin that has room for it, and return that bin."""
        node = 1
        while node < self.width:
            node *= 2
            if self.best[node] < size:
                node += 1
        self.best[node] -= size
        bin_ = node - self.width
        while node > 1:
            node //= 2
            left, right = self.best[2 * node], self.best[2 * node + 1]
            top = left if left >= right else right
            if self.best[node] == top:
                break
            self.best[node] = top
        return bin_


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Indices of ``sizes`` by bin; every size is from 1 to ``room``."""
    if not sizes:
        return []
    tree = CapacityTree(len(sizes), room)
    bins: list[list[int]] = []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        b = tree.place(sizes[k])
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def plan(lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token of every document once.

    Full stretches of ``room`` tokens stand alone.  The remainders go through first-fit decreasing;
    then the emptiest bins are cut up to fill the gaps of the others, and what is left in the last
    bin is cut at powers of two, which need no padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        full = n // room
        out += [[(d, k * room, room)] for k in range(full)]
        if n % room:
            rest.append((d, full * room, n % room))
    bins = [[rest[k] for k in b] for b in first_fit_decreasing([p[2] for p in rest], room)]
    open_ = []
    for b in bins:
        used = sum(p[2] for p in b)
        (out if used == room else open_).append(b if used == room else [room - used, b])
    open_.sort(key=lambda x: x[0])
    first, last = 0, len(open_) - 1
    while first < last:
        gap, taker = open_[first]
        giver = open_[last][1]
        while gap and giver:
            d, s, n = giver.pop()
            take = min(gap, n)
            taker.append((d, s + n - take, take))
            if take < n:
                giver.append((d, s, n - take))
            gap -= take
        open_[first][0] = gap
        if not gap:
            out.append(taker)
            first += 1
        if not giver:
            last -= 1
    if first == last:
        out += powers_of_two(open_[first][1])
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut pieces into sequences whose lengths are the powers of two in their total."""
    left, out, k, used = sum(p[2] for p in pieces), [], 0, 0
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        row = []
        while size:
            d, s, n = pieces[k]
            take = min(size, n - used)
            row.append((d, s + used, take))
            size -= take
            used += take
            if used == n:
                k, used = k + 1, 0
        out.append(row)
    return out


def pack(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 0, group_docs: int = 512, seed: int = 7) -> DataFrame:
    """Pack the token ids of ``docs(doc_id, text, ...)`` into sequences of at most ``room`` tokens.

    Returns one row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset (the piece's place there).  A document's ids end with ``end_id``.

    A row's group is a seeded hash of its doc_id, its length and its place in the partition it is read in,
    so repeated rows and null ids spread over all groups too.  A task holds one document and the remainders
    of one group, fewer than ``room`` ids each: full stretches are written as they come.

    A null text is an empty one (its only id is ``end_id``).  Rows with a null doc_id, or with the same
    doc_id as another, are packed like any other row.  Very long texts are cut into several sequences.
    No documents give no rows.  Other columns, whatever their names, are not read.
    """
    count = docs.count()
    groups = max(1, -(-count // group_docs))
    parts = partitions_for(docs.sparkSession, count, PART_DOCS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.length("text"), F.monotonically_increasing_id()), F.lit(groups)))
    rows = rows.repartitionById(parts, F.pmod("group", F.lit(parts)).cast("int")).sortWithinPartitions("group", "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        from driftline.llm.vocabulary import encoder

        encode = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        out: list[list] = [[] for _ in kinds]
        now, sequences, rest = None, 0, []

        def put(*row):
            for col, value in zip(out, row):
                col.append(value)

        def close():
            """Pack the remainders (doc_id, start, ids, all tokens) of the group."""
            nonlocal sequences, rest
            for sequence in plan([len(ids) for _, _, ids, _ in rest], room):
                at = 0
                for d, s, n in sequence:
                    doc, start, ids, total = rest[d]
                    put(doc, start + s, n, ids[s : s + n].tobytes(), total, (now << 32) + sequences, at)
                    at += n
                sequences += 1
            sequences, rest = 0, []

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

        for batch in batches:
            for doc, text, group in zip(batch.column(0), batch.column(1), batch.column(2)):
                doc, group = doc.as_py(), group.as_py()
                if group != now:
                    if rest or sequences:
                        close()
                    now = group
                ids = np.concatenate([encode(text.as_py()), end])
                full = len(ids) // room * room
                for s in range(0, full, room):
                    put(doc, s, room, ids[s : s + room].tobytes(), len(ids), (now << 32) + sequences, 0)
                    sequences += 1
                    if len(out[0]) >= FLUSH:
                        yield table()
                        out = [[] for _ in kinds]
                if full < len(ids):
                    rest.append((doc, full, ids[full:], len(ids)))
                if len(out[0]) >= FLUSH:
                    yield table()
                    out = [[] for _ in kinds]
        if rest:
            close()
        yield table()

    return rows.mapInArrow(run, SCHEMA)

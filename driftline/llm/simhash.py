"""SimHash near-duplicates: bit-sliced comparison with carry-save counters.

Distinct fingerprints are dealt to tables keyed by some of their bit blocks, so that any two within
the radius share a key in one table at least.  Inside a run of rows the bits are stored as vertical
planes, 64 fingerprints a machine word; the distances of one fingerprint to 64 others grow at once in
bitwise counters, and a word is abandoned once all its lanes exceed the radius.

``near_duplicates`` links fingerprints within a few bits.  ``similar_texts`` links texts by the Jaccard
similarity of their word shingles: a pair of 0.8 lies some ten bits apart, too far for bit blocks, so
its tables are keyed by a few least hashes of the shingles; the same comparison with a wide radius picks
candidates there, and an exact check of the shingle sets follows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import map_array, partitions_for, put_array, scratch, spool, tidy, whole_text
from driftline.llm.graph import components, with_least

BITS = 64
#: Rows of one bucket that are compared in one task at most; larger buckets are cut into blocks and every pair of blocks is compared.
BLOCK = 1024
#: Planes read before the words still alive are picked out.
FIRST = 24
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str, width: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; the whole sequence if it has fewer words, none without words."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([h(flat, seed)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[: -width]])
    return np.array([h(flat[a:b], seed) for a, b in zip(starts.tolist(), (ends[width - 1 :] - 1).tolist())], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without any."""
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    return majority(shingles(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): each whole text's fingerprint as a signed long; rows stay where they are."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    @tidy
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _add(ones, a, b):
    """Carry-save adder: the sum bit and the carry of three."""
    x = ones ^ a
    return x ^ b, (ones & a) | (x & b)


class _Counters:
    """Bitwise counters of distances up to seven, or up to 31 if ``wide``; lanes beyond that are marked in ``over``."""

    def __init__(self, shape, wide: bool = False):
        self.planes = [np.zeros(shape, dtype=np.uint64) for _ in range(5 if wide else 3)]
        self.over = np.zeros(shape, dtype=np.uint64)

    def add8(self, x):
        fours = []
        ones, twos, *more = self.planes
        for k in (0, 4):
            ones, ta = _add(ones, x[k], x[k + 1])
            ones, tb = _add(ones, x[k + 2], x[k + 3])
            twos, f = _add(twos, ta, tb)
            fours.append(f)
        more[0], carry = _add(more[0], *fours)
        for k in range(1, len(more)):
            more[k], carry = more[k] ^ carry, more[k] & carry
        self.planes = [ones, twos, *more]
        self.over |= carry

    def within(self, radius: int):
        """Lanes whose count is at most ``radius``, read from the highest bit down."""
        more, same = self.over.copy(), ~self.over
        for k in range(len(self.planes) - 1, -1, -1):
            if radius >> k & 1:
                same &= self.planes[k]
            else:
                more |= same & self.planes[k]
                same &= ~self.planes[k]
        return ~more

    def take(self, at):
        out = object.__new__(_Counters)
        out.planes, out.over = [x[at] for x in self.planes], self.over[at]
        return out


def close_pairs(fps: np.ndarray, radius: int):
    """Yield index arrays (a, b), a < b, of all pairs of ``fps`` at most ``radius`` (under 32) bits apart."""
    n = len(fps)
    words = -(-n // 64)
    bits = np.zeros((words * 64, BITS), dtype=np.uint8)
    bits[:n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view("<u8")
    masks = np.where(bits[:n].T.astype(bool), ONES, np.uint64(0))
    step = max(1, (1 << 14) // words)
    for q0 in range(0, n, step):
        q = slice(q0, min(n, q0 + step))
        low = q0 // 64  # lanes before the first query were compared already
        count = _Counters((q.stop - q0, words - low), radius > 7)
        for p in range(0, FIRST, 8):
            count.add8([planes[k, None, low:] ^ masks[k, q, None] for k in range(p, p + 8)])
        alive = np.nonzero(count.within(radius) & valid[None, low:])
        count = count.take(alive)
        at, word = alive[0] + q0, alive[1] + low
        for p in range(FIRST, BITS, 8):
            count.add8([planes[k, word] ^ masks[k, at] for k in range(p, p + 8)])
            keep = np.nonzero(count.within(radius) & valid[word])[0]
            if len(keep) < len(at):
                count, at, word = count.take(keep), at[keep], word[keep]
            if not len(at):
                break
        if len(at):
            hit = count.within(radius) & valid[word]
            lanes = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(lanes)
            a, b = at[k], word[k] * 64 + lane
            ordered = a < b
            yield a[ordered], b[ordered]


def forest(fps: np.ndarray, radius: int):
    """(node, root) arrays that join every linked fingerprint of one run to its component's smallest."""
    root = np.arange(len(fps))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in close_pairs(fps, radius):
        far = root[a] != root[b]
        for x, y in zip(a[far].tolist(), b[far].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    roots = np.array([find(k) for k in range(len(fps))], dtype=np.int64)
    odd = np.nonzero(roots != np.arange(len(fps)))[0]
    return fps[odd], fps[roots[odd]]


def tables(radius: int, count: int) -> list[list[int]]:
    """Which bits key each table: radius + k blocks taken k at a time, k so that buckets stay near a few thousand."""
    k = 1
    while k < radius and count >> (BITS * k // (radius + k)) > 4 * BLOCK:
        k += 1
    edges = [BITS * b // (radius + k) for b in range(radius + k + 1)]
    out = [[bit for b in blocks for bit in range(edges[b], edges[b + 1])] for blocks in combinations(range(radius + k), k)]
    assert len(out) == comb(radius + k, k)
    return out


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


CELL = ["table", "key", "i", "j"]


def cells(keyed: DataFrame, member: str) -> DataFrame:
    """``keyed(member, table, key, ...)`` by cells (table, key, i, j) of bounded size that together hold every pair of a key.

    Keys of one member go.  A larger key is cut into blocks by a hash of the member, and each pair of blocks is a cell.
    """
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    out = keyed.join(sizes, ["table", "key"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    out = out.withColumn("own", F.pmod(F.xxhash64(member, "table"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "blocks", "own", "other")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v) edges among the distinct fingerprints ``fps(fp)`` that span every component of the link graph."""
    spark = fps.sparkSession
    count = fps.count()
    keys = F.array([F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_mask(b)).cast("long")).alias("key")) for t, b in enumerate(tables(radius, count))])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.table", "k.key")
    parts = partitions_for(spark, count, 1 << 17)

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        held, rows = [], 0

        def flush(data):
            fps = np.unique(data[:, 0]).view(np.uint64)
            node, root = forest(fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(root.view(np.int64))], schema=schema)

        for batch in batches:
            held.append(np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)]))
            rows += len(held[-1])
            if rows < BLOCK:
                continue
            data = np.concatenate(held)
            ends = np.nonzero((data[1:, 1:] != data[:-1, 1:]).any(axis=1))[0] + 1
            at = 0
            while len(data) - at >= BLOCK:  # a run ends with a cell
                fit = np.searchsorted(ends, at + BLOCK, side="right")
                end = ends[fit - 1] if fit and ends[fit - 1] > at else ends[fit] if fit < len(ends) else 0
                if not end:
                    break
                yield flush(data[at:end])
                at = end
            held, rows = [data[at:]], len(data) - at
        if rows:
            yield flush(np.concatenate(held))

    return cells(keyed, "fp").select("fp", *CELL).repartition(parts, *CELL).sortWithinPartitions(*CELL).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """Class ids of ``docs(doc_id, text, ...)`` under "fingerprints at most ``radius`` bits apart", closed transitively.

    Returns doc_id, fingerprint (16 hexadecimal digits) and component_id, the class's smallest doc_id.

    Null and wordless texts have fingerprint zero and are linked like any other.  Texts of any length
    are read whole.  Equal rows and repeated ids are kept as rows; a row without doc_id has its class's
    smallest id (null if the class has none).  An empty table gives an empty table.  Other columns are not read.
    """
    marked = spool(fingerprints(docs, width, seed), "fingerprints")
    distinct = spool(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = spool(components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp"), "roots")
    named = distinct.join(named_roots(distinct, roots), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named_roots(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component_id) of all nodes in a component of two or more: the smallest ``first`` in it.

    Minima are partial aggregates by root; each root's name goes back to its nodes as its hubs' and the others' do.
    """
    linked = roots.select(F.col("root").alias("u"), F.col("fp").alias("v"))
    linked = linked.unionByName(linked.select("u", F.col("u").alias("v")).distinct())
    firsts = linked.join(distinct.withColumnRenamed("fp", "v"), "v")
    return with_least(firsts, "first").select(F.col("v").alias("fp"), F.col("m").alias("component_id"))


#: Least hashes a key is made of, and keys a text has: a pair of similarity 0.8 shares a key with probability 0.997.
LEAST, KEYS = 3, 8
#: Bits within which pairs of similarity 0.8 lie (of 8999 such pairs in 51,282 texts the farthest were 22 apart).
WIDE = 24
_ODD = np.random.default_rng(5).integers(0, 2**63, LEAST * KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> tuple[bytes, int, int, list[int]]:
    """Of a set of shingle hashes: a 128-bit name, its size, its fingerprint and its table keys."""
    from xxhash import xxh3_128_digest, xxh64_intdigest

    least = np.concatenate([(hashes[k : k + (1 << 14)][None] * _ODD[:, None]).min(axis=1)[None] for k in range(0, len(hashes), 1 << 14)]).min(axis=0) if len(hashes) else np.zeros(len(_ODD), dtype=np.uint64)
    keys = [xxh64_intdigest(x.tobytes()) for x in least.reshape(KEYS, LEAST)]
    return xxh3_128_digest(hashes.tobytes()), len(hashes), majority(hashes), keys


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def alike_links(sets: list[np.ndarray], fps: np.ndarray, threshold: float, radius: int = WIDE):
    """Index pairs of sets at least ``threshold`` alike (Jaccard) that span their components.

    The bit-sliced comparison picks the pairs within ``radius`` bits; sizes and what is linked already rule out most.
    """
    size = np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in close_pairs(fps, radius):
        near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            u, v = find(x), find(y)
            if u == v:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= threshold * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                root[max(u, v)] = min(u, v)
                yield x, y


def similar_texts(docs: DataFrame, threshold: float = 0.8, width: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, component_id) of ``docs(doc_id, text, ...)``: texts joined by a shingle-set Jaccard of at least ``threshold``, closed transitively.

    Words are as in :func:`shingles`; equal sets are one node.  A pair of similarity s shares no key with probability
    (1 - s^LEAST)^KEYS, 0.003 at 0.8 and less above; no pair below the threshold is linked.  Hashes stand for shingles.

    Null and wordless texts have the empty set and form one class.  Texts of any length are read whole.  Rows with
    equal or null ids are kept as rows; a class without any id has a null one.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    @tidy
    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            found = [sketch(np.unique(shingles(t.as_py(), width, seed))) for t in batch.column(1)]
            names, sizes, fps, keys = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(_signed(fps), pa.int64()), pa.array([_signed(k) for k in keys], pa.list_(pa.int64()))], names=["doc_id", "name", "size", "fp", "keys"])

    marked = spool(rows.mapInArrow(mark, "doc_id long, name binary, size long, fp long, keys array<long>"), "sketches")
    # the numbers of nodes are fixed once the table is written
    nodes = spool(marked.groupBy("name").agg(F.min("doc_id").alias("first"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.filter("size > 0").select("node", "fp", F.posexplode("keys").alias("table", "key"))
    meeting = spool(cells(keyed, "node"), "cells")
    # the sets of nodes that meet another, from one text each
    asked = spool(meeting.select("node").distinct().join(nodes.select("node", "name", "first"), "node"), "asked")

    folder, n = scratch(spark, "sets"), partitions_for(spark, asked.count(), 1 << 12)

    @tidy
    def gather(batches):
        import pyarrow as pa

        from xxhash import xxh3_128_digest

        for batch in batches:
            out: list[list] = [[], []]
            for text, node, name in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = np.unique(shingles(text.as_py(), width, seed)).tobytes()
                if xxh3_128_digest(data) == name:  # rows that share the id may hold other texts
                    out[0].append(node)
                    out[1].append(data)
            yield pa.RecordBatch.from_arrays([pa.array([x % n for x in out[0]], pa.int32()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["part", "node", "set"])

    @tidy
    def write(batches):
        """Each part's sets as one array beside their nodes and ends, to be memory-mapped."""
        import pyarrow as pa

        parts: dict[int, dict[int, bytes]] = {}
        for batch in batches:
            for part, node, data in zip(*(batch.column(c).to_pylist() for c in range(3))):
                parts.setdefault(part, {})[node] = data
        for part, sets in parts.items():
            nodes = sorted(sets)
            put_array(f"{folder}/nodes-{part:06d}.npy", np.array(nodes, dtype=np.int64))
            put_array(f"{folder}/ends-{part:06d}.npy", np.cumsum([len(sets[x]) // 8 for x in nodes]))
            put_array(f"{folder}/sets-{part:06d}.npy", np.frombuffer(b"".join(sets[x] for x in nodes), dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int32())], names=["parts"])

    texts = rows.join(asked.select("node", "name", "first"), F.col("doc_id").eqNullSafe(F.col("first"))).select("text", "node", "name")
    texts.mapInArrow(gather, "part int, node long, set binary").repartitionById(n, "part").mapInArrow(write, "parts int").agg(F.sum("parts")).first()
    cells_at_once = partitions_for(spark, meeting.count(), 1 << 16)

    @tidy
    def compare(batches):
        import pyarrow as pa

        opened: dict[int, tuple] = {}

        def set_of(node):
            part = node % n
            if part not in opened:
                opened[part] = tuple(map_array(f"{folder}/{k}-{part:06d}.npy") for k in ("nodes", "ends", "sets"))
            nodes, ends, values = opened[part]
            at = int(np.searchsorted(nodes, node))
            return values[int(ends[at - 1]) if at else 0 : int(ends[at])]

        def edges(held):
            unique = sorted(held.items())
            fps = np.array([f for _, f in unique], dtype=np.int64).view(np.uint64)
            found = list(alike_links([set_of(x) for x, _ in unique], fps, threshold))
            return [unique[a][0] for a, _ in found], [unique[b][0] for _, b in found]

        now, held = None, {}
        u: list[int] = []
        v: list[int] = []
        for batch in batches:
            for *cell, node, fp in zip(*(batch.column(c).to_pylist() for c in (*CELL, "node", "fp"))):
                if cell != now:
                    if len(held) > 1:
                        a, b = edges(held)
                        u += a
                        v += b
                    now, held = cell, {}
                held[node] = fp
        if len(held) > 1:
            a, b = edges(held)
            u += a
            v += b
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    found = meeting.select(*CELL, "node", "fp").repartition(cells_at_once, *CELL).sortWithinPartitions(*CELL).mapInArrow(compare, "u long, v long")
    roots = spool(components(found).withColumnRenamed("node", "fp"), "roots")
    distinct = nodes.select(F.col("node").alias("fp"), "first")
    named = distinct.join(named_roots(distinct, roots), "fp", "left").select(F.col("fp").alias("node"), F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(nodes.select("name", "node").join(named, "node"), "name").select("doc_id", "component_id")

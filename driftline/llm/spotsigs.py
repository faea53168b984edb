"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Every occurrence of an anchor word gives one signature: the anchor and the next content words.  A
text's fingerprint is the multiset of its signatures, kept as sorted 32-bit hashes (the k-th
occurrence of a signature hashes differently, so multiset Jaccard is plain Jaccard).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftline.llm.common import whole_text

#: A fixed list: common function words of English, German, French and Spanish; they are anchors and never content words.
ANCHORS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his i if in is it its not of on or our she so that the their there they this to was we were will with you "
    "aber als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so und von vor war wie wird zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sont sur un une vous "
    "al como con de del el ella en es esta este ha hay la las le lo los más me mi no nos o para pero por que se si sin son su sus un una y ya".split()
)
SPARSE = np.uint64(4)
#: Blocks that the documents' order is cut into at most.
BLOCKS = 1 << 14
_WORD = re.compile(r"[^\W_]+")
_KNOWN: dict[str, int] = {}
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _hashes(words: list[str]) -> np.ndarray:
    known = _KNOWN
    if len(known) > 500_000:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def signatures(text: str, chain: int = 2, distance: int = 1) -> np.ndarray:
    """Sorted hashes of the text's signatures, ``chain`` content words each, ``distance`` content words apart.

    Tables, lists and code have few common words, so every SPARSE-th content word, chosen by its hash,
    is an anchor as well.  A text without a complete anchor chain uses every word as an anchor; one without words is hashed whole.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return np.array([xxh64_intdigest(text) & 0xFFFFFFFF] if text else [], dtype=np.uint32)
    h = _hashes(words)
    common = np.array([w in ANCHORS for w in words])
    content = np.nonzero(~common)[0]
    anchors = np.nonzero(common | (h % SPARSE == 0))[0]
    first = np.searchsorted(content, anchors, side="right")
    whole = first + (chain - 1) * distance < len(content)
    anchors, first = anchors[whole], first[whole]
    if len(anchors):
        s = h[anchors] * _MIX[0]
        for k in range(chain):
            s = _mixed(s + h[content[first + k * distance]] * _MIX[k + 1])
    else:
        padded = np.concatenate([h, np.zeros(chain, dtype=np.uint64)])
        s = h * _MIX[0]
        for k in range(chain):
            s = _mixed(s + padded[k + 1 : k + 1 + len(h)] * _MIX[k + 1])
    s.sort()
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))  # number the repeats
    s = _mixed(s + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * _MIX[3])
    return np.unique((s >> np.uint64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; 0 without counting if their sizes already keep it below ``floor``."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < floor * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (small + large - both)


def in_order(docs: DataFrame, per_block: int = 4096) -> DataFrame:
    """(doc_id, text, block, guest) dealt by block and sorted by descending doc_id within it.

    Blocks are ranges of doc_id.  Each block's highest document also visits, as a guest at the end, the
    next block above, whose lowest document it follows; the very highest visits the lowest block.
    There is a block per ``per_block`` rows, but no more than BLOCKS: they bound the boundaries and visits, which
    stand in the plan.  A block is sorted on disk and read row by row, so it may be of any size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    blocks = min(BLOCKS, max(64, -(-rows.count() // per_block)))
    cuts = rows.agg(F.percentile_approx("key", [k / blocks for k in range(1, blocks)], 20 * blocks).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    below = lambda values: F.size(F.filter(values, lambda x: x < F.col("key")))
    lit = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    step = max(1, int(len(cuts) ** 0.5))  # two levels, so that a row meets a few cuts only
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    place = F.greatest(below(lit([g[0] for g in groups])) - 1, F.lit(0)) if groups else F.lit(0)
    rows = rows.withColumn("_g", place.cast("int"))
    rows = rows.withColumn("block", F.col("_g") * step + below(F.get(F.array(*map(lit, groups)), F.col("_g")))).drop("_g") if groups else rows.withColumn("block", F.lit(0)).drop("_g")
    tops = sorted(map(tuple, rows.groupBy("block").agg(F.max("key")).collect()))
    visit = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    guests = spark.createDataFrame([], "key long, block int") if not visit else spark.sql("SELECT CAST(key AS BIGINT) AS key, CAST(block AS INT) AS block FROM VALUES " + ", ".join(f"({k}{'L' if k > -(2**63) else ''}, {b})" if k > -(2**63) else f"(bigint('{k}'), {b})" for k, b in visit.items()) + " AS t(key, block)")
    places = F.array(F.struct(F.col("block").alias("block"), F.lit(False).alias("guest")))
    goes = F.when(F.col("to").isNotNull(), F.concat(places, F.array(F.struct(F.col("to").alias("block"), F.lit(True).alias("guest"))))).otherwise(places)
    rows = rows.join(F.broadcast(guests.withColumnRenamed("block", "to")), "key", "left")  # one row per block
    rows = rows.select("doc_id", "text", "key", F.inline(goes))
    return rows.repartitionById(blocks, "block").sortWithinPartitions("block", "guest", F.desc("key"), "text").select("doc_id", "text", "block", "guest")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, chain: int = 2, distance: int = 1, flush: int = 1000) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text, ...)``, of an edited copy of each text, and their likeness.

    The edited text ends with the beginning of the next document (by descending doc_id, the first after
    the last) in place of its own second half.  Returns doc_id, n_chars, edited_sha256, fingerprint and
    edited_fingerprint (hexadecimal signature hashes), near_edited and near_next.

    A null text is empty; an empty text's fingerprint is empty and equals only another empty one.  Rows
    that share a doc_id follow each other by text; null ids come last.  A single row is its own next
    document; no rows give none.  Long texts are used whole.  Other columns are not read.
    """

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        out: list[list] = [[] for _ in kinds]
        before = None  # (block, doc_id, text, fingerprint) still without its next document
        hexed = lambda s: s.astype(">u4").tobytes().hex()

        def close(text, mark):
            _, doc, own, sig = before
            half = len(own) // 2
            edited = own[: len(own) - half] + text[:half]
            new = sig if edited == own else signatures(edited, chain, distance)
            row = (doc, len(own), hashlib.sha256(edited.encode()).hexdigest(), hexed(sig), hexed(new), likeness(sig, new), likeness(sig, mark))
            for col, value in zip(out, row):
                col.append(value)

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

        for batch in batches:
            for doc, text, block, guest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if before is None and guest:
                    continue
                text = text.as_py()
                mark = signatures(text, chain, distance)
                if before:
                    close(text, mark)
                before = None if guest else (block, doc, text, mark)
                if len(out[0]) >= flush:
                    yield table()
                    out = [[] for _ in kinds]
        yield table()

    return in_order(docs).mapInArrow(run, SCHEMA)


#: Sets of one cell that are compared in one task at most; larger cells are cut into blocks and every pair of blocks is compared.
BLOCK = 512


def _linked(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of sets at least ``threshold`` alike that span their components; sizes rule out most."""
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for at, a in enumerate(order):
        for b in order[at + 1 :]:
            if len(sets[a]) < threshold * len(sets[b]):
                break  # all later ones are longer still
            x, y = find(a), find(b)
            if x != y and likeness(sets[a], sets[b], threshold) >= threshold:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, chain: int = 2, distance: int = 1) -> DataFrame:
    """(doc_id, class_id) of ``docs(doc_id, text, ...)``: documents joined by likeness of at least ``threshold``, closed transitively.

    Equal signature sets are merged first.  Sets are partitioned by length into bands in which sizes
    differ by at most the threshold's factor; alike sets share one of their first signatures and lie in
    one band or two neighbouring ones.  Sets that meet there are compared by pruned Jaccard.

    class_id is the class's smallest doc_id.  Null and empty texts have the empty set and form one class.
    Rows with null or repeated ids are kept; an empty table gives no rows; other columns are not read.
    """
    from driftline.llm.common import partitions_for, spool
    from driftline.llm.graph import components

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def mark(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [signatures(t.as_py(), chain, distance).astype(np.int64).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "sigs"])

    marked = spool(rows.mapInArrow(mark, "doc_id long, sigs array<long>").withColumn("node", F.xxhash64("sigs")), "spots")
    sets = spool(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("sigs").alias("sigs")), "sets")
    n = F.size("sigs")
    band = F.floor(F.log(n.cast("double")) / F.lit(-float(np.log(threshold)))).cast("int")
    prefix = F.slice("sigs", F.lit(1), (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int"))
    placed = sets.filter(n > 0).select("node", band.alias("own"), F.explode(prefix).alias("sig"))
    placed = placed.select("node", "sig", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("band"))
    counts = placed.groupBy("sig", "band").agg(F.count("*").alias("n")).filter("n > 1")
    cells = placed.join(counts, ["sig", "band"]).withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    cells = cells.withColumn("mine", F.pmod(F.xxhash64("node", "sig"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("node", F.xxhash64("sig", "band").alias("cell"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    cells = cells.join(sets.select("node", "sigs"), "node")

    def compare(batches):
        import pyarrow as pa

        def edges(rows):
            nodes = sorted({r[0]: r[1] for r in rows}.items())
            found = _linked([np.array(s, dtype=np.int64) for _, s in nodes], threshold)
            return [(nodes[a][0], nodes[b][0]) for a, b in found]

        now, held, out = None, [], []
        for batch in batches:
            for node, cell, i, j, sigs in zip(*(batch.column(c).to_pylist() for c in ("node", "cell", "i", "j", "sigs"))):
                if (cell, i, j) != now:
                    out += edges(held)
                    now, held = (cell, i, j), []
                held.append((node, sigs))
        out += edges(held)
        u, v = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    parts = partitions_for(docs.sparkSession, 1, 1)
    links = cells.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(compare, "u long, v long")
    classes = sets.select("node", "first").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    return marked.select("doc_id", "node").join(classes.join(least, "root").select("node", "class_id"), "node").select("doc_id", "class_id")

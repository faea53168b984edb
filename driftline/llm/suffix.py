"""Removal of repeated byte strings: every 100-byte string that also starts earlier, exactly.

The strings of a corpus are its suffixes' prefixes.  Sorting all suffixes externally needs far more
time and disk than the corpus allows here (README), so the order's only use, finding equal prefixes,
is reached by inducing from sampled suffixes instead:

1. Sample.  A window's sample is the least hashed 32-byte string in it; equal windows have equal
   samples.  Consecutive windows with one sample form a run, 2.7 % as many as there are bytes.  Tasks
   send each distinct run's content hash once, to the range of its sample.
2. Induce.  If a sample has one run content only, its runs are equal as a whole; if it has several,
   or may repeat inside a run, its runs are taken apart into windows.  Repeated runs and such windows
   are looked up in arrays that the ranges wrote, and their first places gathered per content hash.
3. Remove.  Each window that is not at its content's first place is repeated; the union of such
   windows is cut out of the document.

All exchanges are sums over hash ranges, so copies, common lines and passages are merged before they
are shuffled, and no group meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import map_array, partitions_for, put_array, scratch, tidy, whole_text
from driftline.llm.lm import _by_part, _dealt, _file, _from_planes, _packed, _planes, _range, _unpacked, mix

GRAM = 32
GROUP = 1 << 19
SEGMENT = 1 << 22
FLUSH = 1 << 20
#: What a map task gathers before it merges; what is left is sent if it is over half of that.
HELD = 1 << 19
#: Documents whose results are made at a time.
SLICE = 1024
_SEED = np.random.default_rng(10)
_VALUES = _SEED.integers(0, 2**64, (3, 256), dtype=np.uint64)
_ODD = [np.uint64(int(x) | 1) for x in _SEED.integers(0, 2**63, 8)]
_BASES = [np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xC2B2AE3D27D4EB4D)]
_POWERS: list[list[np.ndarray]] = [[np.ones(1, dtype=np.uint64)] * 2, [np.ones(1, dtype=np.uint64)] * 2]


def _powers(k: int, n: int):
    if len(_POWERS[k][0]) < n:
        n = max(n, 1 << 16)
        for j, b in enumerate((_BASES[k], np.uint64(pow(int(_BASES[k]), -1, 2**64)))):
            x = np.full(n, b, dtype=np.uint64)
            x[0] = 1
            _POWERS[k][j] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[k]


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` consecutive values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Runs:
    """The runs of several documents laid end to end: sample, first window, number of windows, document.

    ``ends`` are the documents' ends in ``raw``; no run has a window that crosses one.
    """

    def __init__(self, raw: np.ndarray, ends: np.ndarray, width: int):
        self.raw, self.width = raw, width
        h = _VALUES[2][raw]
        for j, size in enumerate((1, 2, 4, 8, 16)):
            h = h[:-size] * _ODD[j] + h[size:]
        self.gram = mix(h)
        least = _sliding(self.gram, width - GRAM + 1, np.minimum)
        n = len(least)
        crossing = np.bincount(np.clip(ends - width + 1, 0, n), minlength=n + 1) - np.bincount(np.minimum(ends, n), minlength=n + 1)
        inside = np.cumsum(crossing[:n]) == 0
        self.least = np.where(inside, least, np.uint64(0))
        turn = np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]), [True]])
        self.first = np.nonzero(turn[:-1] & inside)[0]
        self.windows = np.nonzero(turn[1:] & inside)[0] + 1 - self.first
        self.low = least[self.first]
        self.sample = mix(self.low + _ODD[6])  # least hashes are small; mixed again they fill all ranges alike
        self.doc = np.searchsorted(ends, self.first, side="right")
        self._sums = None

    def drop_last(self) -> int:
        """Leave out the last run and return its first window."""
        cut = int(self.first[-1])
        self.first, self.windows, self.low, self.sample, self.doc = (x[:-1] for x in (self.first, self.windows, self.low, self.sample, self.doc))
        return cut

    def hashes(self, starts: np.ndarray, lengths) -> np.ndarray:
        """Content hashes of stretches, the mix of two polynomials over different byte tables."""
        n = len(self.raw)
        if self._sums is None:
            self._sums = [np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_VALUES[k][self.raw] * _powers(k, n)[0][:n], dtype=np.uint64)]) for k in (0, 1)]
        ends = starts + lengths
        a, b = ((s[ends] - s[starts]) * _powers(k, n)[1][starts] for k, s in enumerate(self._sums))
        return mix(a ^ mix(b + np.asarray(lengths).astype(np.uint64)))

    def contents(self) -> np.ndarray:
        return self.hashes(self.first, self.windows + (self.width - 1))

    def may_repeat(self) -> np.ndarray:
        """Runs whose sample may stand twice in one window, so that windows of one run may be equal."""
        reach = self.width - GRAM
        pad = np.zeros(reach, dtype=np.uint64)
        high = _sliding(np.concatenate([pad, self.least, pad]), reach + 1, np.maximum)
        at = np.nonzero(high == self.gram)[0]
        tied = self.gram[at[1:]][(np.diff(at) <= reach) & (self.gram[at[1:]] == self.gram[at[:-1]])]
        long = self.windows > reach + 1
        return np.isin(self.low, tied) | long if len(tied) else long


def stretches(docs: list, texts, width: int):
    """(Runs, document of each run as its index in ``docs``, place of each run's first window in it).

    Short documents are laid end to end in groups; one longer than SEGMENT is read in stretches that
    end where a run does.
    """
    held, names, size = [], [], 0

    def group():
        ends = np.cumsum([len(t) for t in held])
        runs = Runs(np.frombuffer(b"".join(held), dtype=np.uint8), ends, width)
        base = np.concatenate([[0], ends[:-1]])
        return runs, np.array(names)[runs.doc], runs.first - base[runs.doc]

    for k, text in enumerate(texts):
        text = (text.as_py() or "").encode()
        if len(text) < width:
            continue
        if len(text) > SEGMENT:
            yield from _long(k, np.frombuffer(text, dtype=np.uint8), width)
            continue
        held.append(text)
        names.append(k)
        size += len(text)
        if size >= GROUP:
            yield group()
            held, names, size = [], [], 0
    if held:
        yield group()


def _long(k: int, raw: np.ndarray, width: int):
    at, size = 0, SEGMENT
    while len(raw) - at >= width:
        part = raw[at : at + size]
        runs = Runs(part, np.array([len(part)]), width)
        offset = at
        if at + size < len(raw):
            if len(runs.first) == 1:  # one run is longer than the stretch
                size *= 2
                continue
            at += runs.drop_last()
            size = SEGMENT
        else:
            at = len(raw)
        yield runs, np.full(len(runs.first), k), runs.first + offset


class Table:
    """Sorted 64-bit keys with columns beside them, one memory-mapped file set per hash range."""

    def __init__(self, folder: str, kind: str, columns: str, parts: int):
        self.folder, self.kind, self.columns, self.parts, self.open = folder, kind, columns, parts, {}

    def write(self, part: int, keys: np.ndarray, *columns) -> None:
        put_array(_file(self.folder, f"{self.kind}k", part), keys)
        for name, column in zip(self.columns, columns):
            put_array(_file(self.folder, f"{self.kind}{name}", part), column)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which keys are there, and their columns (0 elsewhere)."""
        at = np.argsort(keys)
        q = keys[at]
        hit = np.zeros(len(q), dtype=bool)
        out = [np.zeros(len(q), dtype=np.int64) for _ in self.columns]
        edges = np.searchsorted(_range(q, self.parts), np.arange(self.parts + 1))
        for part in np.nonzero(edges[1:] > edges[:-1])[0].tolist():
            if part not in self.open:
                self.open[part] = [map_array(_file(self.folder, f"{self.kind}{c}", part)) for c in "k" + self.columns]
            k, *columns = self.open[part]
            if not len(k):
                continue
            s = slice(edges[part], edges[part + 1])
            place = np.minimum(np.searchsorted(k, q[s]), len(k) - 1)
            hit[s] = k[place] == q[s]
            for o, c in zip(out, columns):
                o[s] = np.where(hit[s], c[place], 0)
        back = np.empty(len(at), dtype=np.int64)
        back[at] = np.arange(len(at))
        return hit[back], [o[back] for o in out]


class Places:
    """Content hashes with their first place (document, position) and whether there are several places."""

    def __init__(self, least: int = FLUSH):
        self.parts, self.size, self.least = [], 0, least

    def add(self, keys, docs, at, several=None) -> None:
        self.parts.append((keys, docs, at, np.zeros(len(keys), dtype=bool) if several is None else several))
        self.size += len(keys)
        if self.size > self.least:
            self.merge()
            self.least = max(self.least, 2 * self.size)

    def merge(self):
        if not self.parts:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        keys, docs, at, several = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((at, docs, keys))
        keys, docs, at, several = keys[order], docs[order], at[order], several[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.nonzero(new)[0]
        several = np.logical_or.reduceat(several, first) | (np.diff(np.append(first, len(keys))) > 1) if len(first) else several
        self.parts = [(keys[first], docs[first], at[first], several)]
        self.size = len(first)
        return self.parts[0]

    def take(self):
        """What :meth:`merge` gives; nothing is held afterwards."""
        out = self.merge()
        self.parts, self.size = [], 0
        return out


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def _order_keys(column) -> np.ndarray:
    return np.array([2**63 - 1 if x is None else x for x in column.to_pylist()], dtype=np.int64)


def _samples(rows: DataFrame, samples: Table, whole: Table, width: int) -> None:
    """Write the samples whose runs must be taken apart, and the contents of whole runs that repeat."""
    n = samples.parts

    @tidy
    def collect(batches):
        import pyarrow as pa

        parts: list = []
        size = 0

        def merged():
            s, c, odd, again = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((c, s))
            s, c, odd, again = s[order], c[order], odd[order], again[order]
            first = np.nonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])]))[0]
            count = np.diff(np.append(first, len(s)))
            return s[first], c[first], np.logical_or.reduceat(odd, first), np.logical_or.reduceat(again, first) | (count > 1)

        def sent():
            s, c, odd, again = merged()
            edges = np.searchsorted(_range(s, n), np.arange(n + 1))
            flags = odd.astype(np.uint8) | again.astype(np.uint8) << 1
            for lo in range(0, n, 64):
                some = [(r, slice(edges[r], edges[r + 1])) for r in range(lo, min(n, lo + 64)) if edges[r] < edges[r + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in some], pa.int32()), pa.array([_packed(s[q]) for _, q in some], pa.binary()), pa.array([c[q].tobytes() for _, q in some], pa.binary()), pa.array([flags[q].tobytes() for _, q in some], pa.binary())],
                    names=["part", "samples", "contents", "flags"],
                )

        for batch in batches:
            for runs, _, _ in stretches([], batch.column(1), width):
                parts.append((runs.sample, runs.contents(), runs.may_repeat(), np.zeros(len(runs.sample), dtype=bool)))
                size += len(runs.sample)
                if size > HELD:
                    parts = [merged()]
                    size = len(parts[0][0])
                    if size > HELD // 2:
                        yield from sent()
                        parts, size = [], 0
        if parts:
            yield from sent()

    @tidy
    def write(batches):
        import pyarrow as pa

        for part, blobs in _by_part(batches):
            s = np.concatenate([_unpacked(b[0]) for b in blobs])
            c = np.concatenate([np.frombuffer(b[1], dtype=np.uint64) for b in blobs])
            flags = np.concatenate([np.frombuffer(b[2], dtype=np.uint8) for b in blobs])
            order = np.lexsort((c, s))
            s, c, flags = s[order], c[order], flags[order]
            first = np.nonzero(np.concatenate([[True], s[1:] != s[:-1]]))[0]
            ends = np.append(first[1:], len(s))
            apart = np.bitwise_or.reduceat(flags & 1, first).astype(bool) | (c[first] != c[ends - 1])
            again = np.bitwise_or.reduceat(flags & 2, first).astype(bool) | (ends - first > 1)
            samples.write(part, s[first][apart])
            whole.write(part, s[first][~apart & again])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    made = _dealt(rows.mapInArrow(collect, "part int, samples binary, contents binary, flags binary"), n).mapInArrow(write, "part int")
    _fill(made, n, lambda part: (samples.write(part, np.zeros(0, dtype=np.uint64)), whole.write(part, np.zeros(0, dtype=np.uint64))))


def _fill(made: DataFrame, n: int, empty) -> None:
    """Run the job, and write empty arrays for ranges that got no rows."""
    done = {r[0] for r in made.collect()}  # a number per range
    for part in range(n):
        if part not in done:
            empty(part)


def _units(runs: Runs, docs: np.ndarray, places: np.ndarray, samples: Table, whole: Table):
    """(hash, document, place, windows) of all units that may repeat: whole runs, or the windows of runs taken apart."""
    apart, again = (np.nonzero(t.find(runs.sample)[0])[0] for t in (samples, whole))
    count = runs.windows[apart]
    run = np.concatenate([again, np.repeat(apart, count)])
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    step = np.concatenate([np.zeros(len(again), dtype=np.int64), step])
    windows = np.concatenate([runs.windows[again], np.ones(count.sum(), dtype=np.int64)])
    return runs.hashes(runs.first[run] + step, windows + (runs.width - 1)), docs[run], places[run] + step, windows


def _firsts(rows: DataFrame, samples: Table, whole: Table, places: Table, width: int) -> None:
    n = places.parts

    @tidy
    def collect(batches):
        import pyarrow as pa

        def sent():
            keys, docs, at, several = found.take()
            edges = np.searchsorted(_range(keys, n), np.arange(n + 1))
            for lo in range(0, n, 64):
                some = [(r, slice(edges[r], edges[r + 1])) for r in range(lo, min(n, lo + 64)) if edges[r] < edges[r + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in some], pa.int32()), *(pa.array([pack(x[q]) for _, q in some], pa.binary()) for pack, x in ((_packed, keys), (_planes, docs), (_planes, at), (lambda f: np.packbits(f).tobytes(), several)))],
                    names=["part", "keys", "docs", "at", "several"],
                )

        found = Places(HELD)
        for batch in batches:
            names = _order_keys(batch.column("doc_id"))
            for runs, docs, places_ in stretches(names, batch.column("text"), width):
                keys, docs, places_, _ = _units(runs, docs, places_, samples, whole)
                found.add(keys, names[docs], places_)
                if found.least > HELD:  # merging left more than half
                    yield from sent()
                    found = Places(HELD)
        yield from sent()

    @tidy
    def write(batches):
        import pyarrow as pa

        for part, blobs in _by_part(batches):
            found = Places()
            for keys, docs, at, several in blobs:
                keys = _unpacked(keys)
                found.add(keys, _from_planes(docs), _from_planes(at), np.unpackbits(np.frombuffer(several, dtype=np.uint8), count=len(keys)).astype(bool))
            keys, docs, at, several = found.merge()
            places.write(part, keys[several], docs[several], at[several])
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32())], names=["part"])

    made = _dealt(rows.mapInArrow(collect, "part int, keys binary, docs binary, at binary, several binary"), n).mapInArrow(write, "part int")
    none = np.zeros(0, dtype=np.int64)
    _fill(made, n, lambda part: places.write(part, none.astype(np.uint64), none, none))


def repeated(column, texts, samples: Table, whole: Table, places: Table, width: int) -> list[list]:
    """For each document of a batch the (start, end) of its maximal stretches that repeat earlier strings."""
    names = _order_keys(column)
    starts = [np.zeros((2, 0), dtype=np.int64)]
    lengths = [np.zeros(0, dtype=np.int64)]
    for runs, docs, at in stretches(names, texts, width):
        keys, docs, at, windows = _units(runs, docs, at, samples, whole)
        hit, (first_doc, first_at) = places.find(keys)
        later = hit & ((first_doc < names[docs]) | ((first_doc == names[docs]) & (first_at < at)))
        starts.append(np.stack([docs[later], at[later]]))
        lengths.append(windows[later] + (width - 1))
    (docs, s), length = np.concatenate(starts, axis=1), np.concatenate(lengths)
    order = np.lexsort((s, docs))
    docs, s, length = docs[order], s[order], length[order]
    out: list[list] = [[] for _ in range(len(names))]
    if not len(s):
        return out
    far = int((s + length).max()) + 2  # keeps documents apart on one axis
    e = np.maximum.accumulate(docs * far + s + length)
    first = np.nonzero(np.concatenate([[True], docs[1:] * far + s[1:] > e[:-1]]))[0]
    last = np.append(first[1:], len(s)) - 1
    for d, a, b in zip(docs[first].tolist(), s[first].tolist(), (e[last] - docs[last] * far).tolist()):
        out[d].append((a, b))
    return out


def remove_repeats(docs: DataFrame, width: int = 100, docs_per_part: int = 4096) -> DataFrame:
    """Cut each byte out of ``docs(doc_id, text, ...)`` that a ``width``-byte string covers which also starts earlier.

    Earlier is in a document with a smaller doc_id, or further left in the same one; strings are judged
    on the input and lie within one document's UTF-8 bytes.  Returns doc_id, n_bytes, n_removed, spans
    (start, length of maximal cuts, in bytes) and kept (the remaining bytes).

    A null text is empty; texts shorter than ``width`` stay whole.  Rows with a null doc_id come after
    all others.  Rows that share a doc_id count as one document: strings at the same place in them are
    not earlier than each other, so equal rows are both kept.  Very long texts are read in stretches.
    An empty table gives no rows.  Other columns are not read.  Strings are equal if their 64-bit
    hashes are; among n strings that may repeat, about n * n / 2**65 pairs are confused.
    """
    rows = _documents(docs)
    find = _finder(rows, width, docs_per_part)

    @tidy
    def run(batches):
        import pyarrow as pa

        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                out: list[list] = [[], [], [], []]
                for spans, text in zip(find(part.column(0), part.column(1)), part.column(1)):
                    data = text.as_py().encode()
                    for col, value in zip(out, (len(data), sum(e - s for s, e in spans), [{"start": s, "length": e - s} for s, e in spans], b"".join(_rest(data, spans)))):
                        col.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), spans_type, pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,length:long>>, kept binary")


def _rest(data: bytes, spans: list) -> list[bytes]:
    """The stretches of a document that the cuts leave."""
    edges = [0, *(x for span in spans for x in span), len(data)]
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2])]


def _finder(rows: DataFrame, width: int, docs_per_part: int):
    """Gather the corpus's repeats; a function from columns of doc_id and text to each document's (start, end) cuts."""
    if width < GRAM:
        raise ValueError(f"width must be at least {GRAM}")
    spark = rows.sparkSession
    n = partitions_for(spark, rows.count(), docs_per_part)
    folder = scratch(spark, "repeats")
    samples, whole, places = Table(folder, "s", "", n), Table(folder, "w", "", n), Table(folder, "p", "da", n)
    _samples(rows, samples, whole, width)
    _firsts(rows, samples, whole, places, width)
    return lambda docs, texts: repeated(docs, texts, samples, whole, places, width)


def without_repeats(docs: DataFrame, width: int = 100, docs_per_part: int = 4096) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the repeats cut out of ``text``, all columns and rows kept but emptied ones.

    A character of which a byte is cut goes as a whole.  Rows whose text was cut to nothing go; rows
    that were empty or null before stay as they are.
    """
    find = _finder(_documents(docs), width, docs_per_part)

    @tidy
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                texts, keep = [], []
                for spans, text in zip(find(part.column("doc_id"), part.column(at)), part.column(at)):
                    text = text.as_py()
                    if spans:
                        text = "".join(b.decode("utf-8", "ignore") for b in _rest(text.encode(), spans))
                    texts.append(text)
                    keep.append(not spans or bool(text))
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

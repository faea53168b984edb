"""Interpolated modified Kneser-Ney bigram model, counted in Spark and stored as sorted hash arrays.

Three passes over the corpus, each one map over whole texts:

1. words: every task sums the counts of its words; hash ranges are merged and written as sorted
   arrays.  A word's id is its rank.  A second hash tells whether two words share the first.
2. bigrams: every task sums its pairs of ids; ranges of the mixed pair are merged and written, and
   each range passes on how many followers a word has (by count 1, 2, 3 and more) and how many
   different words come before it, to the ranges of those words only, where it is summed per word and
   written beside the words.
3. scores: workers memory-map the arrays they need and look sorted queries up in them.

Nothing but one row of totals per range reaches the driver.  The order is two: at three, the arrays
and shuffles of a corpus of mostly distinct trigrams exceed four times its size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import exists, map_array, partitions_for, put_array, remove, scratch, tidy, whole_text

GROUP_BYTES = 1 << 21
FLUSH = 1 << 22
#: Keys a map task holds at most before it sends what it has.
SPILL = 1 << 23
END = np.uint64(0x5EED0FE0D0C5)
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_U32 = np.uint64(32)


def _tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    space = np.zeros(256, dtype=bool)
    space[list(_SPACES)] = True
    return lower, space


_LOWER, _SPACE = _tables()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (multiplications by odd numbers and xor-shifts)."""
    h = (h ^ (h >> _U32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U32)


_UNMIX = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def unmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U32)) * _UNMIX
    h = (h ^ (h >> _U32)) * _UNMIX
    return h ^ (h >> _U32)


def different_words(data: bytes, seed: int = 0) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """The different words of ``data``, A-Z lower-cased: sorted hashes and bytes; which one stands where, and each word's start.

    Words are told apart by their bytes (Arrow's dictionary encoding); each different one is hashed with XXH64.
    """
    import pyarrow as pa
    from xxhash import xxh64_intdigest

    raw = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    gap = np.concatenate([[True], _SPACE[raw], [True]])
    edge = gap[1:] != gap[:-1]
    starts, ends = np.nonzero(edge & gap[:-1])[0], np.nonzero(edge & gap[1:])[0]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), [], starts, starts
    words = raw[~gap[1:-1]]  # the words' bytes without the gaps
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(words)]).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    h = np.fromiter((xxh64_intdigest(w, seed) for w in distinct), dtype=np.uint64, count=len(distinct))
    order = np.argsort(h, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return h[order], [distinct[k] for k in order.tolist()], place[coded.indices.to_numpy()], starts


def word_hashes(data: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``data``, A-Z lower-cased."""
    h, _, which, starts = different_words(data, seed)
    return h[which], starts


class Tokens:
    """The tokens of several texts in order; each text ends with END.

    ``distinct`` are the sorted hashes of the different tokens and ``counts`` how often they occur;
    ``at`` is each token's place among them and ``doc`` its text.
    """

    def __init__(self, texts: list[bytes], seed: int = 0):
        sizes = np.array([len(t) + 1 for t in texts])
        h, self.words, which, starts = different_words(b"\n".join(texts), seed)
        doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
        length = np.bincount(doc, minlength=len(texts)) + 1
        self.end = int(np.searchsorted(h, END))
        self.distinct = np.insert(h, self.end, END)
        self.counts = np.insert(np.bincount(which, minlength=len(h)), self.end, len(texts))
        self.at = np.full(length.sum(), self.end, dtype=np.int64)
        self.at[np.arange(len(which)) + doc] = which + (which >= self.end)
        self.doc = np.repeat(np.arange(len(texts)), length)

    def checks(self, seed: int) -> np.ndarray:
        """A second hash of each different token, by which equal first hashes of unlike words are found out."""
        from xxhash import xxh64_intdigest

        h = np.fromiter((xxh64_intdigest(w, seed) for w in self.words), dtype=np.uint64, count=len(self.words))
        return np.insert(h, self.end, 0)


def groups(column):
    """Texts of an Arrow column in groups of about GROUP_BYTES; (first row, texts) each."""
    held, size, first = [], 0, 0
    for k, text in enumerate(column):
        held.append(text.as_py().encode())
        size += len(held[-1]) + 1
        if size >= GROUP_BYTES:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


class Counter:
    """Counts of 64-bit keys, kept as sorted arrays that are merged now and then.

    Keys may come with check values; equal keys with unlike ones are kept apart.
    """

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None, checks: np.ndarray | None = None) -> None:
        if counts is None:
            keys = np.sort(keys)
        self.parts.append(_summed(keys, counts, checks))
        self.size += len(self.parts[-1][0])
        if self.size > FLUSH and len(self.parts) > 8:
            self._merge()

    def full(self) -> bool:
        return self.size > SPILL

    def take(self) -> tuple:
        """Keys, counts and, if there are any, checks; the counter is empty afterwards."""
        self._merge()
        out = self.parts[0] if self.parts else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        self.parts, self.size = [], 0
        return out

    def _merge(self) -> None:
        if len(self.parts) > 1:
            columns = [np.concatenate(x) for x in zip(*self.parts)]
            at = np.argsort(columns[0], kind="stable")
            self.parts = [_summed(*(c[at] for c in columns))]
            self.size = len(self.parts[0][0])


def _summed(keys, counts, checks=None):
    """Sorted keys once each, with the sums of their counts."""
    if not len(keys):
        return (keys, np.zeros(0, dtype=np.int64)) + (() if checks is None else (checks,))
    turn = keys[1:] != keys[:-1]
    if checks is not None:
        turn = turn | (checks[1:] != checks[:-1])
    new = np.nonzero(np.concatenate([[True], turn]))[0]
    sums = np.diff(np.append(new, len(keys))) if counts is None else np.add.reduceat(counts, new)
    return (keys[new], sums) + (() if checks is None else (checks[new],))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, one byte plane after another: their leading zeros compress in the shuffle."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _planes(counts: np.ndarray) -> bytes:
    return counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _words64(values: np.ndarray) -> bytes:
    return values.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel().astype(np.int64)


def _range(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit values each key lies in."""
    return ((h >> _U32) * np.uint64(n) >> _U32).astype(np.int64)


def _emit(ranges, n, names, *columns):
    """Batches of a row per range that has keys; each column is (array, how it is packed)."""
    import pyarrow as pa

    edges = np.searchsorted(ranges, np.arange(n + 1))
    some = np.nonzero(edges[1:] > edges[:-1])[0]
    for lo in range(0, len(some), 64):  # bounded batches
        part = some[lo : lo + 64].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array([pack(c[edges[r] : edges[r + 1]]) for r in part], pa.binary()) for c, pack in columns)], names=names)


def _by_part(batches):
    """Rows of one partition by range: each range's blobs lie together, as the partition is sorted by range."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield now, held


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartitionById(n, "part").sortWithinPartitions("part")


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from the numbers of keys that occur 1 to 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return np.array([0.0] + [min(max(x, 0.05), k + 1 - 0.05) for k, x in enumerate(d)])


def _file(folder: str, kind: str, part: int) -> str:
    return f"{folder}/{kind}-{part:06d}.npy"


def _offsets(folder: str) -> np.ndarray:
    """The ranges' first ids, and the number of words; a file, as it grows with the ranges."""
    return map_array(f"{folder}/offsets.npy")


class Words:
    """The memory-mapped words: hash -> id, count and what was gathered about it."""

    def __init__(self, folder: str, facts: bool):
        self.folder, self.offsets, self.facts, self.open = folder, _offsets(folder), facts, {}

    def _part(self, part: int):
        if part not in self.open:
            kinds = ("wh", "wc", "wf") if self.facts else ("wh",)
            self.open[part] = [map_array(_file(self.folder, k, part)) for k in kinds]
        return self.open[part]

    def find(self, h: np.ndarray):
        """ids (-1: unknown), counts and facts of sorted hashes."""
        n = len(self.offsets) - 1
        ids = np.full(len(h), -1, dtype=np.int64)
        counts, facts = np.zeros(len(h), dtype=np.int64), np.zeros((len(h), 4), dtype=np.int64)
        edges = np.searchsorted(_range(h, n), np.arange(n + 1))
        for part in np.nonzero(edges[1:] > edges[:-1])[0]:
            if self.offsets[part + 1] == self.offsets[part]:
                continue
            q = slice(edges[part], edges[part + 1])
            arrays = self._part(int(part))
            at = np.minimum(np.searchsorted(arrays[0], h[q]), len(arrays[0]) - 1)
            hit = arrays[0][at] == h[q]
            ids[q] = np.where(hit, self.offsets[part] + at, -1)
            if self.facts:
                counts[q] = np.where(hit, arrays[1][at], 0)
                facts[q] = np.where(hit[:, None], arrays[2][at], 0)
        return ids, counts, facts


class Bigrams:
    """The memory-mapped pair counts.  Counts from 255 on stand apart, so that most take a byte; a range without pairs has no files."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self.open = folder, parts, {}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Counts of sorted mixed pairs."""
        out = np.zeros(len(h), dtype=np.int64)
        edges = np.searchsorted(_range(h, self.parts), np.arange(self.parts + 1))
        for part in np.nonzero(edges[1:] > edges[:-1])[0].tolist():
            if part not in self.open:
                there = exists(_file(self.folder, "bh", part))
                self.open[part] = [map_array(_file(self.folder, k, part)) for k in ("bh", "bc", "bi", "bl")] if there else None
            if self.open[part] is None:
                continue
            keys, small, at_large, large = self.open[part]
            q = slice(edges[part], edges[part + 1])
            at = np.minimum(np.searchsorted(keys, h[q]), len(keys) - 1)
            got = np.where(keys[at] == h[q], small[at], 0).astype(np.int64)
            full = np.nonzero(got == 255)[0]
            got[full] = large[np.searchsorted(at_large, at[full])]
            out[q] = got
        return out


def _write_bigrams(folder: str, part: int, keys: np.ndarray, counts: np.ndarray) -> None:
    large = np.nonzero(counts >= 255)[0]
    for kind, array in (("bh", keys), ("bc", np.minimum(counts, 255).astype(np.uint8)), ("bi", large), ("bl", counts[large])):
        put_array(_file(folder, kind, part), array)


def _pairs(ids: np.ndarray, doc: np.ndarray, start: int) -> np.ndarray:
    """Contexts of tokens: the id before, or ``start`` at a document's first token."""
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    return np.where(first, start, np.concatenate([[start], ids[:-1]]))


def fit(texts: DataFrame, docs_per_part: int = 8192) -> dict:
    """Count ``texts(text)`` and write the model; returns where it is and its totals.

    Two words whose hashes are equal are found out by their check values, and the count starts again with another seed.
    """
    spark = texts.sparkSession
    documents = texts.count()
    n = partitions_for(spark, documents, docs_per_part)
    for seed in range(0, 16, 2):
        folder = scratch(spark, "lm")
        v, tokens, clashes = _fit_words(texts, folder, n, seed)
        if not clashes:
            break
        remove(folder)
    else:
        raise ValueError("words with equal 64-bit hashes under every seed tried")
    model = {"folder": folder, "parts": n, "words": v, "tokens": tokens, "documents": documents, "seed": seed}
    if v >= 2**32 - 1:
        raise ValueError("pairs of ids are packed in 64 bits: at most 2**32 - 2 distinct words")
    if not v:
        return model | {"d1": discounts([0] * 4), "d2": discounts([0] * 4), "pairs": 0, "rest": 1.0}
    return model | _fit_bigrams(texts, folder, n, v, seed, documents)


def _fit_words(texts: DataFrame, folder: str, n: int, seed: int) -> tuple[int, int, int]:
    """Write each range's words and counts, and the ranges' first ids; the words, the tokens and the hashes that two words share."""
    names = ["part", "keys", "counts", "checks"]

    @tidy
    def count(batches):
        counter = Counter()

        def send():
            keys, counts, *checks = counter.take()
            return _emit(_range(keys, n), n, names, (keys, _packed), (counts, _planes), (checks[0] if checks else keys, _words64))

        for batch in batches:
            for _, group in groups(batch.column(0)):
                found = Tokens(group, seed)
                counter.add(found.distinct, found.counts, found.checks(seed + 1))
                if counter.full():
                    yield from send()
        yield from send()

    @tidy
    def write(batches):
        import pyarrow as pa

        for part, blobs in _by_part(batches):
            counter = Counter()
            for keys, counts, checks in blobs:
                counter.add(_unpacked(keys), _from_planes(counts), np.frombuffer(checks, dtype=np.uint64))
            keys, counts, _ = counter.take()
            put_array(_file(folder, "wh", part), keys)
            put_array(_file(folder, "wc", part), counts)
            clashes = int((keys[1:] == keys[:-1]).sum())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (len(keys), pa.int64()), (int(counts.sum()), pa.int64()), (clashes, pa.int64()))], names=["part", "distinct", "tokens", "clashes"])

    found = _dealt(texts.mapInArrow(count, "part int, keys binary, counts binary, checks binary"), n).mapInArrow(write, "part int, distinct long, tokens long, clashes long").collect()  # a row a range
    distinct = np.zeros(n, dtype=np.int64)
    for r in found:
        distinct[r["part"]] = r["distinct"]
    put_array(f"{folder}/offsets.npy", np.concatenate([[0], np.cumsum(distinct)]))
    return int(distinct.sum()), sum(r["tokens"] for r in found), sum(r["clashes"] for r in found)


def _fit_bigrams(texts: DataFrame, folder: str, n: int, v: int, seed: int, documents: int) -> dict:
    """Write each range's pairs and each word's facts; returns discounts and totals."""
    names = ["part", "keys", "counts"]

    @tidy
    def count(batches):
        vocabulary, counter = Words(folder, False), Counter()

        def send():
            keys, counts = counter.take()
            return _emit(_range(keys, n), n, names, (keys, _packed), (counts, _planes))

        for batch in batches:
            for _, group in groups(batch.column(0)):
                found = Tokens(group, seed)
                ids = vocabulary.find(found.distinct)[0][found.at]
                counter.add(mix(_pairs(ids, found.doc, v).astype(np.uint64) << _U32 | ids.astype(np.uint64)))
                if counter.full():
                    yield from send()
        yield from send()

    facts_names = ["part", "before", "followers"]

    @tidy
    def write(batches):
        """Write a range's pairs; send on how often a word stands first (by count 1, 2, 3 and more) and last (0) in a pair."""
        import pyarrow as pa

        ends = _offsets(folder)[1:]
        for part, blobs in _by_part(batches):
            counter = Counter()
            for keys, counts in blobs:
                counter.add(_unpacked(keys), _from_planes(counts))
            keys, counts = counter.take()
            _write_bigrams(folder, part, keys, counts)
            pair = unmix(keys)
            context, word = (pair >> _U32).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            facts, sums = _summed(np.sort(np.concatenate([context * 4 + np.minimum(counts, 3), word * 4])).astype(np.uint64), None)
            # a document's start counts with the last range; ranges without facts get no row
            to = np.minimum(np.searchsorted(ends, (facts // np.uint64(4)).astype(np.int64), side="right"), n - 1)
            yield from _emit(to, n, facts_names, (facts, _packed), (sums, _planes))
            total = np.array([len(keys), *((counts == k).sum() for k in (1, 2, 3, 4))], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n - 1], pa.int32()), pa.array([b""], pa.binary()), pa.array([_planes(total)], pa.binary())], names=facts_names)  # without keys: the totals

    @tidy
    def write_facts(batches):
        import pyarrow as pa

        offsets = _offsets(folder)
        for part, rows in _by_part(batches):
            low = int(offsets[part])
            size = offsets[part + 1] - low + (part == n - 1)
            facts, totals = np.zeros((size, 4), dtype=np.int64), np.zeros(5, dtype=np.int64)
            for before, followers in rows:
                if not before:
                    totals += _from_planes(followers)
                    continue
                key = _unpacked(before).astype(np.int64)
                facts[key // 4 - low, (key % 4 - 1) % 4] += _from_planes(followers)  # keys are distinct within a blob
            put_array(_file(folder, "wf", part), facts.astype(np.uint32 if facts.max(initial=0) < 2**32 else np.uint64))
            inside = facts[: offsets[part + 1] - low, 3]
            start = facts[-1, :3].tolist() if part == n - 1 else [0, 0, 0]
            sums = [*totals.tolist(), *(int((inside == k).sum()) for k in (1, 2, 3, 4)), int((inside >= 3).sum()), *start]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=[f"x{k}" for k in range(len(sums))])

    rows = _dealt(_dealt(texts.mapInArrow(count, "part int, keys binary, counts binary"), n).mapInArrow(write, "part int, before binary, followers binary"), n)
    sums = rows.mapInArrow(write_facts, ", ".join(f"x{k} long" for k in range(13))).groupBy().sum().first()  # a row a range
    pairs, n1, n2, n3, n4, m1, m2, m3, m4, more, *start = sums
    d2, d1 = discounts([n1, n2, n3, n4]), discounts([m1, m2, m3, m4])
    return {"d1": d1, "d2": d2, "pairs": pairs, "rest": float((d1[1] * m1 + d1[2] * m2 + d1[3] * more) / pairs), "start": float(d2[1:] @ np.array(start) / documents)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of ``docs(doc_id, text)`` in place; scores are log10 probabilities."""
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    v, tokens = model["words"], model["tokens"]

    @tidy
    def run(batches):
        import pyarrow as pa

        vocabulary, pairs = Words(model["folder"], True), Bigrams(model["folder"], model["parts"])
        d1, d2, rest = model["d1"], model["d2"], model["rest"]

        def tokens_of(group):
            found = Tokens(group, model["seed"])
            doc, at = found.doc, found.at
            if not v:
                zero = np.zeros(len(at))
                return doc, zero, np.zeros(len(at), dtype=bool), zero
            ids, counts, facts = vocabulary.find(found.distinct)
            preceded = facts[:, 3]
            low = (preceded - d1[np.minimum(preceded, 3)]) / model["pairs"] + rest / (v + 1)
            low = np.where(ids >= 0, low, rest / (v + 1))
            back = np.where(counts > 0, facts[:, :3] @ d2[1:] / np.maximum(counts, 1), 1.0)
            first = np.concatenate([[True], doc[1:] != doc[:-1]])
            word = ids[at]
            before = np.concatenate([[0], at[:-1]])
            context = np.where(first, v, ids[before])
            mass = np.where(first, model["documents"], counts[before])
            weight = np.where(first, model["start"], back[before])
            known = (word >= 0) & (context >= 0)
            keys, where = np.unique(mix(context[known].astype(np.uint64) << _U32 | word[known].astype(np.uint64)), return_inverse=True)
            c = np.zeros(len(word), dtype=np.int64)
            c[known] = pairs.find(keys)[where]
            p = (c - d2[np.minimum(c, 3)]) / np.maximum(mass, 1) + weight * low[at]
            base = (counts[at] + 0.5) / (tokens + 0.5 * (v + 1))
            return doc, np.log10(base), counts[at] > 0, np.log10(p)

        for batch in batches:
            for first, group in groups(batch.column(1)):
                doc, base, known, logp = tokens_of(group)
                k = len(group)
                sums = [np.bincount(doc, minlength=k), np.bincount(doc, weights=known, minlength=k).astype(np.int64), np.bincount(doc, weights=base, minlength=k), np.bincount(doc, weights=logp, minlength=k)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, k), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def perplexities(docs: DataFrame) -> DataFrame:
    """Train on the rows of ``docs(doc_id, text, ...)`` outside the held-out fold and score all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (per token).

    A null text counts as empty (its only token is the end).  Unknown words share one word's
    probability.  A row with a null doc_id is in the training fold; rows with equal ids are scored one
    by one.  Texts of any length are read whole; a task sends what it has counted once that exceeds SPILL keys.  Without training rows every probability is 1.  An
    empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    model = fit(rows.filter(~held_out()).select("text"))
    scored = score(rows, model)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))

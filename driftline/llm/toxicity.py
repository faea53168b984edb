"""Toxicity by weak supervision.

1. Voters.  From a bounded sample of labelled rows, words and word beginnings that occur in toxic
   texts almost only become lexicons and patterns; a fixed list of insults is one more.
2. Label model.  A latent-class generative model, fitted by EM without labels, estimates how often
   each voter fires in either class, and the correlations left within the classes; correlated voters
   share their weight.
3. Classifier.  A linear (logistic) model over the lexicon's entries is trained on the posterior
   labels and scores every whole text.  doc_id, lang, source and labels are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import spool, tidy, whole_text

#: A fixed lexicon: common English insults.
INSULTS = ("asshole", "bastard", "bitch", "clown", "coward", "creep", "cretin", "crap", "damn", "disgusting", "dumb", "fool", "freak", "garbage", "hate", "idiot", "idiotic", "imbecile", "jerk", "kill", "liar", "loser", "lunatic", "moron", "moronic", "pathetic", "pig", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless")
PREFIXES = (3, 4, 5, 6, 7, 8)
SEVERAL = 4
WORD_FOLDS, PREFIX_FOLDS = 4, 2
_WORD = re.compile(r"[^\W\d_]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _features(words: set[str]) -> set[str]:
    """Words, and beginnings (marked by a star) of longer words."""
    out = set(words)
    for n in PREFIXES:
        out |= {w[:n] + "*" for w in words if len(w) > n}
    return out


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, n): the sample's texts with each feature, summed per task before the shuffle."""

    def run(batches):
        import pyarrow as pa

        every, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                found = _features(set(_words(text.as_py())))
                every.update(found)
                if label:
                    toxic.update(found)
        names = list(toxic)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[x] for x in names], pa.int64()), pa.array([every[x] for x in names], pa.int64())], names=["feature", "toxic", "n"])
        # texts without the feature's toxic side matter only for features seen on it elsewhere
        names = [x for x in every if x not in toxic]
        for k in range(0, len(names), 1 << 16):
            part = names[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([0] * len(part), pa.int64()), pa.array([every[x] for x in part], pa.int64())], names=["feature", "toxic", "n"])

    rows = sample.select("text", "toxic").mapInArrow(run, "feature string, toxic long, n long")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def _hits(sample: DataFrame, index: dict[str, int]) -> list:
    """Per sampled text: its number of words, and its features with hashes of the word and the one before, and how often they stand there so."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words_, ids_, before_, which_, times_ = [], [], [], [], []
            labels = batch.column("toxic")
            for text in batch.column("text"):
                words = _words(text.as_py())
                found: Counter = Counter()
                known: dict[str, list[tuple[int, int]]] = {}
                last = ""
                for w in words:
                    here = known.get(w)
                    if here is None:
                        code = zlib.crc32(w.encode())
                        here = known[w] = [(index[x], code) for x in _features({w}) if x in index]
                    if here:
                        code = zlib.crc32(last.encode())
                        found.update([(i, code, c) for i, c in here])
                    last = w
                words_.append(len(words))
                for col, values in zip((ids_, before_, which_), zip(*found) if found else ((), (), ())):
                    col.append(list(values))
                times_.append(list(found.values()))
            columns = [pa.array(x, pa.list_(pa.int64())) for x in (ids_, before_, which_, times_)]
            yield pa.RecordBatch.from_arrays([labels, pa.array(words_, pa.int64()), *columns], names=["toxic", "words", "ids", "before", "which", "times"])

    return sample.select("text", "toxic").mapInArrow(run, "toxic int, words long, ids array<long>, before array<long>, which array<long>, times array<long>").collect()  # a bounded sample's entries


def label_model(votes: np.ndarray, rounds: int = 60, same: float = 0.9) -> tuple[np.ndarray, dict]:
    """Posterior of the hidden class for 0/1 ``votes`` (texts x voters), and what was estimated.

    EM for the prior and each voter's firing rate in either class.  Voters that correlate above
    ``same`` are one voter repeated, which would otherwise become the class itself: they share a weight
    of 1 from the start.  After a first EM, the correlations of the voters' residuals within the classes
    lower each voter's weight to 1 / (1 + the sum of its absolute correlations), and EM runs again.
    """
    n, m = votes.shape
    every = _correlations(votes - votes.mean(axis=0))
    weight = start = 1 / np.maximum(1, (every > same).sum(axis=0))
    for turn in range(2):
        p = np.clip(2 * votes @ weight / weight.sum(), 0.02, 0.98)
        for _ in range(rounds):
            prior = np.clip(p.mean(), 1e-3, 0.5)
            on = (votes.T @ p + 1) / (p.sum() + 2)
            off = (votes.T @ (1 - p) + 0.1) / ((1 - p).sum() + 10)
            on = np.maximum(on, off)
            gain = np.log(prior / (1 - prior)) + (votes * (weight * np.log(on / off)) + (1 - votes) * (weight * np.log((1 - on) / (1 - off)))).sum(axis=1)
            p = 1 / (1 + np.exp(-np.clip(gain, -30, 30)))
        corr = _correlations(votes - (p[:, None] * on + (1 - p)[:, None] * off))
        if not turn:
            weight = np.minimum(start, 1 / (1 + np.abs(corr).sum(axis=0) - np.abs(np.diag(corr))))
    return p, {"prior": float(p.mean()), "fires_toxic": on, "fires_clean": off, "correlations": corr, "weights": weight}


def _correlations(residual: np.ndarray) -> np.ndarray:
    spread = np.sqrt((residual**2).mean(axis=0)) + 1e-9
    return residual.T @ residual / len(residual) / np.outer(spread, spread)


def fit_linear(rows: list[np.ndarray], size: int, target: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights and bias by accelerated gradient descent; each row lists its present features."""
    n = len(rows)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if lengths.sum() else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(n), lengths)
    w, b = np.zeros(size), -2.0
    vw, vb = w.copy(), b
    mass = np.where(target > 0.5, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
    for k in range(rounds):
        z = vb + np.bincount(owner, weights=vw[flat], minlength=n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * mass
        step = 4.0
        nw = vw - step * (np.bincount(flat, weights=g[owner], minlength=size) + l2 * vw)
        nb = vb - step * g.sum()
        speed = k / (k + 3)
        vw, vb = nw + speed * (nw - w), nb + speed * (nb - b)
        w, b = nw, nb
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, support: int = 3, purity: float = 0.5) -> dict:
    """Fit on ``labels(doc_id, toxic)`` rows that ``docs`` has; at most about ``max_labelled`` of them.

    The sample is the rows whose hashed id lies below a share, so it is spread over all documents.  An entry
    occurs in ``support`` toxic texts of the sample or more.  Returns the classifier: weights by feature, and a bias.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_labelled / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) < F.lit(int(share * (1 << 52))))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(known), "doc_id")  # max_labelled rows at most
    sample = spool(sample.select("text", "toxic"), "labelled")
    counts = spool(_counts(sample).filter(F.col("toxic") >= support), "features")
    total, toxic, tried = sample.agg(F.count("*"), F.sum("toxic")).first() + counts.agg(F.count("*")).first()
    base = {"weights": dict.fromkeys(INSULTS, 2.5), "bias": -4.0, "again": 0.0, "several": [0.0] * SEVERAL}
    if not tried:
        return base
    # so much likelier than by chance that, of all features tried, hardly one passes by luck
    rate, share = (toxic + 0.5) / (total + 1), F.col("toxic") / F.col("n")
    gain = F.col("toxic") * F.log(share / rate) + F.when(share < 1, (F.col("n") - F.col("toxic")) * F.log((1 - share) / (1 - rate))).otherwise(0)
    strong = counts.filter((share >= purity) & (gain >= np.log(tried) + 2)).select("feature").collect()  # entries of a bounded sample
    if not strong:
        return base
    names = sorted({r["feature"] for r in strong} | set(INSULTS))
    index = {x: k for k, x in enumerate(names)}
    hits = _hits(sample, index)
    # a true entry turns up after many different words of toxic texts; the words of one much-copied text do not
    ids, before, which, count, bad = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*((r["ids"], r["before"], r["which"], r["times"], np.full(len(r["ids"]), r["toxic"])) for r in hits)))
    ids, before, which, count, bad = (x.astype(np.int64) for x in (ids, before, which, count, bad))
    times = np.bincount(ids, minlength=len(names))
    harmful, harmless = (np.bincount(np.unique((ids << 32 | before)[bad == k]) >> 32, minlength=len(names)) for k in (1, 0))
    keep = (harmful >= support) & (harmful >= 0.5 * np.bincount(ids, weights=count * bad, minlength=len(names))) & (harmful >= purity * (harmful + harmless))
    # a true pattern holds for several words, and still does without its commonest one
    is_prefix = np.array([x.endswith("*") for x in names])
    forms, at = np.unique(ids << 32 | which, return_inverse=True)
    harm, every = (np.bincount(at, weights=x, minlength=len(forms)) for x in (count * bad, count))
    for k in np.nonzero(is_prefix & keep)[0]:
        own = slice(*np.searchsorted(forms, [k << 32, (k + 1) << 32]))
        rest = np.delete(np.arange(own.start, own.stop), np.argmax(harm[own]))
        keep[k] = len(rest) >= 2 and harm[rest].sum() >= purity * every[rest].sum()
    fixed = np.array([x in INSULTS for x in names])
    keep |= fixed & (times == 0)
    # how many different words of a text have an entry, up to SEVERAL
    several = [len({x for i, x in zip(r["ids"], r["which"]) if keep[i]}) for r in hits]
    again = [_occurrences(r, keep) > 1 for r in hits]
    rows = [np.unique(np.array(r["ids"], dtype=np.int64)) for r in hits]
    rows = [r[keep[r]] for r in rows]
    words = np.maximum(1, np.array([r["words"] for r in hits]))
    fold = np.array([zlib.crc32(x.encode()) for x in names])
    voters = [~is_prefix & (fold % WORD_FOLDS == k) for k in range(WORD_FOLDS)] + [is_prefix & (fold % PREFIX_FOLDS == k) for k in range(PREFIX_FOLDS)] + [fixed]
    columns = [np.array([v[r].any() for r in rows]) for v in voters]
    columns += [np.array(again), np.array(several) >= 2, np.array(several) >= 3, np.array(several) / words >= 0.01]
    posterior, _ = label_model(np.column_stack(columns).astype(float))
    # beside the entries: an entry stands there again; there are two, three, four different ones
    size = len(names)
    w, b = fit_linear([np.concatenate([r, [size] * a, np.arange(size + 2, size + 1 + min(k, SEVERAL))]).astype(np.int64) for r, a, k in zip(rows, again, several)], size + 1 + SEVERAL, posterior)
    return {"weights": {x: float(w[k]) for x, k in index.items() if keep[k] and w[k]}, "bias": b, "again": float(w[size]), "several": [float(x) for x in w[size + 1 :]]}


def _occurrences(row, keep: np.ndarray) -> int:
    """How many words of a text have an entry, repeats included; a word's entries count once."""
    times: dict[int, Counter] = {}
    for i, x, n in zip(row["ids"], row["which"], row["times"]):
        if keep[i]:
            times.setdefault(x, Counter())[i] += n
    return sum(max(c.values()) for c in times.values())


def scorer(model: dict):
    """A function from an Arrow column of texts (nulls: empty) to the classifier's probabilities."""
    weights, bias, again, several = (model[k] for k in ("weights", "bias", "again", "several"))
    words = {x: w for x, w in weights.items() if not x.endswith("*")}
    starts = {n: {x[:-1]: w for x, w in weights.items() if x.endswith("*") and len(x) == n + 1} for n in PREFIXES}

    def one(text: str) -> float:
        every = _words(text)
        found = set(every)
        entries = found & words.keys()
        z = bias + sum(words[x] for x in entries)
        for n, table in starts.items():
            here = {w for w in found if len(w) > n and w[:n] in table}
            z += sum(table[x] for x in {w[:n] for w in here})
            entries |= here
        if entries and sum(w in entries for w in every) > 1:
            z += again
        return z + sum(several[1 : len(entries)])

    def probabilities(column) -> np.ndarray:
        z = np.clip(np.array([one(t.as_py() or "") for t in column], dtype=float), -30, 30)
        return 1 / (1 + np.exp(-z))

    return probabilities


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score): the classifier's probability for every row of ``docs(doc_id, text, ...)``, in place."""
    probabilities = scorer(model)

    @tidy
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(batch.column(1)))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs(text, ...)`` scored below ``threshold``, with all their columns, in place."""
    probabilities = scorer(model)

    @tidy
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Score ``docs(doc_id, text, ...)``, learning from ``labels(doc_id, toxic)`` outside the held-out rows.

    Returns doc_id, held_out, score and predicted (1 from ``threshold`` on).  A null text counts as
    empty; an empty text's score is the bias alone.  Null or repeated labels: nulls are left out and a
    document is toxic if any of its labels says so.  Without usable labels the fixed lexicon scores.
    Rows with null or repeated ids are scored row by row; no rows give none; other columns are not read.
    """
    model = train(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

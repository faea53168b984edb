"""Near copies by shingle similarity, components with hubs, wide bit-sliced distances, top-k bounds, licence rows, chat logs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import chat, graph, license, queries, simhash, topk
from tests.llm.test_corpus_operators import classes, documents


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def similar_classes(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    root = classes(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b]) >= threshold])
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in root]


@pytest.mark.parametrize("block", [1024, 8])
def test_similar_texts_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te") for b in ("ra", "no", "vi", "ple", "dor", "st")]
    base = [[rng.choice(words) for _ in range(160)] for _ in range(5)]
    rows = []
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(70, None), (71, ""), (72, " \n "), (73, "one two"), (74, "ONE  two"), (75, "one two three four five six"), (None, rows[3][1]), (None, None), (3, rows[9][1]), (76, " ".join(base[0] * 40))]
    got = simhash.similar_texts(documents(spark, rows)).collect()
    want = sorted(((i if i is not None else -1), c) for (i, _), c in zip(rows, similar_classes(rows)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.component_id) for r in got) == want and 6 < len({c for _, c in want}) < 60


def test_similar_texts_of_an_empty_table(spark):
    assert simhash.similar_texts(documents(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [8, 15, 24, 31])
def test_wide_distances(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for k in range(150, 300):
        bits = rng.choice(64, rng.integers(0, 40), replace=False).astype(np.uint64)
        f[k] = f[k - 150] ^ np.bitwise_or.reduce(np.uint64(1) << bits) if len(bits) else f[k - 150]
    got = {(int(a), int(b)) for x, y in simhash.close_pairs(f, radius) for a, b in zip(x, y)}
    assert got == {(i, int(j)) for i in range(300) for j in i + 1 + np.nonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius)[0]}


def test_keys_of_a_similar_pair_meet():
    """Of pairs at 0.8 the stated share has a key in common."""
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(400):
        h = np.unique(rng.integers(0, 2**64, 220, dtype=np.uint64))
        a, b = simhash.sketch(np.sort(h[:198])), simhash.sketch(np.sort(h[22:220]))  # 176 of 220 in common
        met += bool(set(a[3]) & set(b[3]))
    assert met >= 396


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 3)
    rng = random.Random(5)
    edges = [(0, k) for k in range(1, 200)] + [(300 + k, 300) for k in range(1, 150)] + [(500 + k, 501 + k) for k in range(40)] + [(rng.randrange(1, 200), 700)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {k: 0 for k in range(1, 200)} | {700: 0} | {300 + k: 300 for k in range(1, 150)} | {500 + k: 500 for k in range(1, 41)}
    assert got == want


def test_hubs_are_joined_by_broadcast_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 10)
    pairs = spark.createDataFrame([(0, k) for k in range(500)] + [(k, k + 1) for k in range(1, 300)], "u long, v long")
    out = graph.with_least(pairs, "v")
    assert {(r.u, r.v, r.m) for r in out.collect()} == {(0, k, 0) for k in range(500)} | {(k, k + 1, k + 1) for k in range(1, 300)}
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()


# ---- top-k


def test_bound_stops_early_where_vectors_lean_to_few_directions():
    rng = np.random.default_rng(1)
    scale = np.exp(-np.arange(24) / 2.0)
    v = np.floor(4096 * rng.normal(size=(4000, 24)) * scale)
    lists = topk.Lists(np.arange(4000), v)
    for q in range(0, 200, 10):
        ids, scores = lists.top(v[q], q, 5)
        every = v @ v[q]
        every[q] = -np.inf
        order = np.lexsort((np.arange(4000), -every))[:5]
        assert ids.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert lists.read < 0.7 * 20 * 4000


def test_bound_is_never_below_an_unread_score():
    rng = np.random.default_rng(2)
    for _ in range(40):
        v = rng.integers(-50, 51, (60, 7)).astype(float)
        lists, q = topk.Lists(np.arange(60), v), rng.integers(-50, 51, 7).astype(float)
        for depth in (1, 5, 20, 40):
            met = {int(x) for j in range(7) if q[j] for x in (lists.order[60 - depth :, j] if q[j] > 0 else lists.order[:depth, j])}
            unread = [v[i] @ q for i in range(60) if i not in met]
            assert not unread or max(unread) <= lists.bound(q, depth) + 1e-6


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(df, F.col("vec_id") == 0).collect()


# ---- licences


def scanned(spark, rows):
    return license.scan(spark.createDataFrame(rows, "file_id long, path string, text string, is_licence_file boolean, licence string, score int"))


def test_rows_that_share_an_id_keep_their_own_licence(spark):
    mit = "Released under the MIT License."
    rows = [(1, "d/x", mit, False, "z", 1), (1, "d/x", "plain words", False, "z", 1), (2, "d/y", mit, False, "z", 1), (2, "d/y", mit, False, "z", 1), (None, None, mit, None, "z", 1), (None, None, None, None, "z", 1), (3, "", mit, True, "z", 1)]
    got = sorted((str(r.file_id), str(r.path), str(r.licence), r.how) for r in scanned(spark, rows).collect())
    assert got == sorted([("1", "d/x", "MIT", "header"), ("1", "d/x", "MIT", "inherited"), ("2", "d/y", "MIT", "header"), ("2", "d/y", "MIT", "header"), ("None", "None", "MIT", "header"), ("None", "None", "None", "none"), ("3", "", "MIT", "header")])


def test_lines_without_a_licence_word_are_compared(spark):
    got = {r.file_id: r.licence for r in scanned(spark, [(1, "a/b", "code\n" * 9 + "CC BY-NC 4.0", None, "z", 1), (2, "c/d", "code\n" * 9 + "under CC BY 4.0", None, "z", 1)]).collect()}
    assert got[2] == "CC-BY-4.0"


def test_every_line_at_the_threshold_with_a_telling_word_passes_the_gate():
    import math
    import re
    from collections import Counter

    gate, vectors, idf = re.compile(license.line_gate()), {}, {}
    for k, _, token, i, w in license.weights():
        vectors.setdefault(k, {})[token] = w
        idf[token] = i
    rng = random.Random(7)
    tokens, hits = sorted(idf), 0
    for _ in range(20000):
        k = rng.choice(list(vectors))
        words = [t for t in vectors[k] if rng.random() < 0.6] + [rng.choice(tokens) for _ in range(rng.randrange(3))]
        bag = Counter(words)
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        if norm and max(sum(n * idf[t] * v.get(t, 0) for t, n in bag.items()) / norm for v in vectors.values()) >= 0.6:
            if not set(words) - license.COMMON:
                continue
            hits += 1
            assert gate.search(" ".join(words)) and any(len(set(words) & set(names)) >= least for names, least in license.needed(0.6))
    assert hits > 2000


def test_a_directory_of_many_files_is_looked_up_once(spark):
    rows = [(0, "src/LICENSE", "Released under the MIT License.", True, "z", 1)] + [(k, f"src/deep/er/f{k}", "words", None, "z", 1) for k in range(1, 400)] + [(1000, "src/deep/er/f1", "words", None, "z", 1)]
    got = scanned(spark, rows).groupBy("licence", "how", "from_directory").count().collect()
    assert {(r.licence, r.how, r.from_directory, r["count"]) for r in got} == {("MIT", "header", None, 1), ("MIT", "inherited", "src", 400)}


# ---- chat


def test_the_query_s_log_holds_every_kind_of_event_and_folds_back(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "an answer of several words"), (1, 1, "assistant", "an answer of several words"), (1, 1, None, "x"), (1, 2, "assistant", None), (None, None, "assistant", "ab"), (2, 0, "assistant", ""), (2, 1, "user", "\U0001f600 long " * 2000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, seq int, kind int")
    log = chat.as_log(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted((str(r.conv_id), str(r.turn), r.role, r.text) for r in chat.fold(log).collect())
    assert got == sorted((str(c), str(t), r or "", x or "") for c, t, r, x in rows)


def test_chat_query_reads_the_log(spark, monkeypatch):
    """Without the folding of drafts the query's texts would be others."""
    d = "/root/testdata/sf0.001"
    right = {r.conv_id: r.turns_sha256 for r in queries.op9_chat(spark, d).collect()}
    monkeypatch.setattr(chat, "fold", lambda log: log.filter("kind = 'message'").select("conv_id", "turn", F.col("seq").alias("place"), "role", "text"))
    wrong = {r.conv_id: r.turns_sha256 for r in queries.op9_chat(spark, d).collect()}
    assert right.keys() == wrong.keys() and all(right[c] != wrong[c] for c in right)
    assert dict(queries.op9_chat(spark, d).dtypes)["n_turns"] == "bigint"

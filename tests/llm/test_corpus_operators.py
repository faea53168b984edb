"""Each operator against a brute-force statement of it, and on awkward tables."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm import bpe, chat, license, lm, packing, queries, simhash, spotsigs, suffix, topk, toxicity
from driftline.llm.graph import components
from driftline.llm.vocabulary import encoder, library, load, merge_rank_is_id

D = "/root/testdata/sf0.001"
PATH = queries.tokenizer_file()
EXTRA = ", part string, block int, key int, fp string, score string, n int, id int, h int, length int, places array<int>"
SCHEMA = "doc_id long, text string" + EXTRA


def documents(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "p", 1, 2, "f", "s", 3, 4, 5, 6, [7]) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["the", "of", "Alpha", "beta", "gamma", "delta", "and", "a", "Zürich", "x9", "über"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    out += [out[3], out[3] + " end", out[5][: len(out[5]) // 2], "", "  \n\t ", "ab" * 300, "é" * 260, "x" * 1000, out[7] + "\n" + out[8], out[8] + " " + out[7]]
    return out


@pytest.fixture(scope="module")
def awkward(texts):
    rows = list(enumerate(texts))
    return [*rows, (1000, None), (None, texts[0]), (None, None), (7, texts[7]), (7, texts[7]), (8, "another text")]


def test_awkward_tables_keep_every_row(spark, awkward):
    docs = documents(spark, awkward)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    n = len(awkward)
    assert lm.perplexities(docs).count() == n
    assert toxicity.classify(docs, labels).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert spotsigs.compare_edited(docs).count() == n
    assert bpe.round_trip(docs, PATH).count() == n
    assert suffix.remove_repeats(docs).count() == n
    pieces = packing.pack(docs, PATH).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("s")).toPandas()
    assert pieces.s.sum() == sum(len(library(PATH).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in awkward)


def test_empty_tables(spark):
    docs = documents(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (lm.perplexities(docs), toxicity.classify(docs, labels), simhash.near_duplicates(docs), spotsigs.compare_edited(docs), bpe.round_trip(docs, PATH), suffix.remove_repeats(docs), suffix.without_repeats(docs), packing.pack(docs, PATH)):
        assert out.count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, seq long, kind string, role string, text string")).count() == 0
    assert license.scan(spark.createDataFrame([], "file_id long, path string, text string, is_licence_file boolean")).count() == 0


# ---- language model


def test_language_model_by_hand(spark, texts):
    df = lm.perplexities(documents(spark, list(enumerate(texts)))).toPandas().set_index("doc_id")
    tok = {i: t.encode().lower().split() + [b"</s>"] for i, t in enumerate(texts)}
    train = [i for i in tok if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for i in train for w in tok[i])
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for i in train for p in zip([b"<s>"] + tok[i][:-1], tok[i]))
    cc = collections.Counter(pairs.values())
    d2 = lm.discounts([cc[k] for k in (1, 2, 3, 4)])
    before, mass, after = collections.defaultdict(lambda: [0, 0, 0]), collections.Counter(), collections.Counter()
    for (a, b), k in pairs.items():
        before[a][min(k, 3) - 1] += 1
        mass[a] += k
        after[b] += 1
    pc = collections.Counter(after.values())
    d1 = lm.discounts([pc[k] for k in (1, 2, 3, 4)])
    rest = sum(d1[min(k, 3)] * m for k, m in pc.items()) / len(pairs)

    def p(a, b):
        low = ((after[b] - d1[min(after[b], 3)]) / len(pairs) if b in after else 0) + rest / (v + 1)
        if a not in mass:
            return low
        k = pairs.get((a, b), 0)
        return (k - d2[min(k, 3)]) / mass[a] + sum(x * y for x, y in zip(d2[1:], before[a])) / mass[a] * low

    for i, t in tok.items():
        r = df.loc[i]
        assert r.held_out == (i not in train) and r.n_tokens == len(t) and r.n_known == sum(c[w] > 0 for w in t) and r.train_tokens == n
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), abs_tol=1e-7)
        assert math.isclose(r.score, sum(math.log10(p(a, w)) for a, w in zip([b"<s>"] + t[:-1], t)), abs_tol=1e-7)
    for a in list(mass)[:4]:  # probabilities of all words and of the unknown one add up to 1
        assert math.isclose(sum(p(a, w) for w in c) + sum(x * y for x, y in zip(d2[1:], before[a])) / mass[a] * rest / (v + 1), 1.0, abs_tol=1e-9)


def test_word_hashes_and_mixing():
    h, at = lm.word_hashes(b"  Foo bar\x0bfoo\tBAR\x1cx ")
    assert list(at) == [2, 6, 10, 14] and h[0] == h[2] and h[1] != h[3] and lm.word_hashes(b"")[0].size == 0
    x = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (lm.unmix(lm.mix(x)) == x).all()


def test_model_beats_the_base_on_held_out_texts(spark):
    df = queries.op1_lm(spark, "/root/testdata/sf0.01").filter("held_out").toPandas()
    assert df.score.sum() > df.base_score.sum()


# ---- toxicity


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    df = queries.op2_toxicity(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    hit = ((df.predicted == 1) & (df.toxic == 1)).sum()
    assert hit / (df.predicted == 1).sum() > 0.9 and hit / (df.toxic == 1).sum() > 0.8
    assert df.score.between(0, 1).all() and ((df.score >= 0.7) == (df.predicted == 1)).all()


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    vote = lambda on, off: np.where(y, rng.random(4000) < on, rng.random(4000) < off)
    good = [vote(0.8, 0.03) for _ in range(3)]
    noisy = vote(0.3, 0.1)
    p, found = toxicity.label_model(np.column_stack([*good, noisy, noisy, noisy]).astype(float))
    assert abs(found["prior"] - 0.2) < 0.08 and ((p > 0.5) == y).mean() > 0.9
    assert sum(found["weights"][3:]) < 1.05 < sum(found["weights"][:3])  # three copies count as one voter, three voters as more


def test_without_labels_the_fixed_lexicon_scores(spark):
    docs = documents(spark, [(1, "you stupid idiot moron"), (2, "a fine day"), (3, None)])
    got = {r.doc_id: r.predicted for r in toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


# ---- packing


def test_packing_holds_every_token_once(spark, texts):
    rows = [*enumerate(texts), (99, " ".join(f"w{k}" for k in range(3000)))]
    df = packing.pack(documents(spark, rows), PATH, group_docs=20).toPandas()
    for i, t in rows:
        want = np.array(library(PATH).encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        got = df[df.doc_id == i].sort_values("start")
        assert b"".join(got.ids) == want.tobytes() and list(got.start) == [0, *got.length.cumsum()[:-1]] and set(got.doc_tokens) == {len(want)}
    for _, s in df.groupby("sequence_id"):
        s = s.sort_values("offset")
        total = s.length.sum()
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and (total == 1024 or total & (total - 1) == 0)


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(0, 60))]
        room, bins = [], []
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            for b, r in enumerate(room):
                if r >= sizes[k]:
                    room[b] -= sizes[k]
                    bins[b].append(k)
                    break
            else:
                room.append(50 - sizes[k])
                bins.append([k])
        assert packing.first_fit_decreasing(sizes, 50) == bins


# ---- licences


def test_licence_inheritance_takes_the_nearest_ancestor(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.", True),
        (2, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0.", True),
        (3, "a/b/c/x.py", "no words of that kind", None),
        (4, "a/y.py", None, None),
        (5, "z.py", "", None),
        (6, "a/b/c/w.py", "code\n" * 9 + "# Licensed under CC BY-NC 4.0.", None),
        (7, None, "nothing", None),
        (8, "a/b/c/v.py", "a licence of no known kind at all", None),
    ]
    got = {r.file_id: (r.licence, r.how, r.from_directory) for r in license.scan(spark.createDataFrame(rows, "file_id long, path string, text string, is_licence_file boolean")).collect()}
    assert got == {1: ("MIT", "header", None), 2: ("Apache-2.0", "header", None), 3: ("Apache-2.0", "inherited", "a/b"), 4: ("MIT", "inherited", "a"), 5: (None, "none", None), 6: ("CC-BY-NC-4.0", "header", None), 7: (None, "none", None), 8: ("Apache-2.0", "inherited", "a/b")}


def test_wrapped_headers_tags_and_full_texts_have_their_licence(spark):
    from pathlib import Path

    gpl = """
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
    hashed = lambda t: "#!/usr/bin/env python\n# x.py - a tool\n" + "".join(f"# {x}".rstrip() + "\n" for x in t.split("\n"))
    starred = lambda t: "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.split("\n")) + " */\n"
    bare = lambda t: "/*\n" + t + "*/\n"
    text = lambda n: (Path(license.__file__).parent / "licences" / f"{n}.txt").read_text()
    code = "def f(x):\n    return x + 1\n\n" * 40
    want, rows = {}, []

    def put(licence, body):
        want[len(rows)] = licence
        rows.append((len(rows), f"d{len(rows)}/f", body, None))

    for licence, header in (("GPL-3.0", gpl), ("GPL-2.0", gpl.replace("version 3", "version 2")), ("AGPL-3.0", gpl.replace("GNU General", "GNU Affero General")), ("MIT", text("MIT")), ("BSD-2-Clause", text("BSD-2-Clause")), ("BSD-3-Clause", text("BSD-3-Clause")), ("ISC", text("ISC"))):
        for style in (hashed, starred, bare):
            put(licence, style("Copyright (C) 2019 Some One\n\n" + header) + code)
    for tag, licence in (("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0-or-later", "GPL-2.0"), ("GPL-3.0-only", "GPL-3.0"), ("BSD-3-Clause", "BSD-3-Clause"), ("MPL-2.0", "MPL-2.0")):
        put(licence, f"// SPDX-License-Identifier: {tag}\n" + code)
    for licence in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSD-2-Clause", "BSD-3-Clause", "MIT"):
        put(licence, "Copyright 2020 Some Two\n\n" + text(licence))
    put("GPL-2.0", text("GPL-2.0").split("How to Apply These Terms")[0])
    put(None, "// SPDX-License-Identifier: Unheard-9\n" + code)
    put(None, "The permission to enter was given by the mayor, and the copyright of the song stayed with its singer.\n\n" * 5)
    got = {r.file_id: r.licence for r in license.scan(spark.createDataFrame(rows, "file_id long, path string, text string, is_licence_file boolean")).collect()}
    assert got == want


# ---- SimHash


def brute_fingerprint(text):
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_simhash_classes_by_brute_force(spark, awkward):
    df = simhash.near_duplicates(documents(spark, awkward)).toPandas()
    fps = [brute_fingerprint(t or "") for _, t in awkward]
    assert sorted(df.fingerprint) == sorted(f"{f:016x}" for f in fps)
    root = classes(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for r, (i, _) in zip(root, awkward):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted((str(i), f"{f:016x}", str(least.get(r))) for (i, _), f, r in zip(awkward, fps, root))
    text = lambda x: "None" if x != x or x is None else str(int(x))
    assert sorted((text(r.doc_id), r.fingerprint, text(r.component_id)) for r in df.itertuples()) == want


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    f = rng.integers(0, 2**64, 700, dtype=np.uint64)
    f[300:500] = f[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    f[600:] = f[0] ^ np.arange(100, dtype=np.uint64)
    got = {(int(a), int(b)) for x, y in simhash.close_pairs(f, radius) for a, b in zip(x, y)}
    assert got == {(i, int(j)) for i in range(700) for j in i + 1 + np.nonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius)[0]}


def test_tables_share_a_key_within_the_radius():
    rng = random.Random(4)
    for count in (10, 10**7, 10**10, 10**13):
        masks = [sum(1 << b for b in t) for t in simhash.tables(4, count)]
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not flips & m for m in masks)


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(9)
    f = np.unique(np.concatenate([np.arange(200, dtype=np.uint64) * np.uint64(3), rng.integers(0, 2**64, 100, dtype=np.uint64)]))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long"), 2).collect()
    index = {int(x): k for k, x in enumerate(f.view(np.int64))}
    got = classes(len(f), [(index[e.u], index[e.v]) for e in edges])
    want = classes(len(f), [(i, int(j)) for i in range(len(f)) for j in i + 1 + np.nonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 2)[0]])
    pair = lambda r: {(a, b) for a in range(len(r)) for b in range(a) if r[a] == r[b]}
    assert pair(got) == pair(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(5, 5), (101, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 31)} | {k: 100 for k in range(101, 140)}


# ---- SpotSigs


def test_edited_texts_and_likeness(spark, awkward):
    df = spotsigs.compare_edited(documents(spark, awkward)).toPandas()
    low = -(2**63)
    rows = sorted(((low if i is None else i, t or "") for i, t in awkward), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        x = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + x[:half]
        a, b, c = (spotsigs.signatures(s) for s in (t, e, x))
        jaccard = lambda p, q: 1.0 if not len(p) and not len(q) else len(set(p) & set(q)) / len(set(p) | set(q))
        want.append((len(t), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    assert sorted((r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.itertuples()) == sorted(want)


def test_signatures_of_equal_and_unlike_texts():
    a = "the quick brown fox jumps over the lazy dog and runs to the old river bank"
    assert spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures(a)) == 1
    assert spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures(a + " at night of the storm wind")) > 0.5
    assert spotsigs.likeness(spotsigs.signatures(a), spotsigs.signatures("!!!")) == 0 == spotsigs.likeness(spotsigs.signatures("?"), spotsigs.signatures("!"))
    assert spotsigs.likeness(spotsigs.signatures(a)[:2], spotsigs.signatures(a), 0.9) == 0  # sizes alone decide


@pytest.mark.parametrize("block", [512, 4])
def test_similarity_classes_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te") for b in ("ra", "no", "vi", "ple", "dor", "st")] + ["the", "of", "and", "to"]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(6)]
    rows = []
    for i in range(60):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w[: len(w) - rng.randrange(0, 12)])))
    rows += [(60, ""), (61, None), (None, rows[0][1]), (62, "!!!")]
    sets = [set(spotsigs.signatures(t or "").tolist()) for _, t in rows]
    alike = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    root = classes(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b]) >= 0.8])
    least = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id) for r in spotsigs.near_duplicates(documents(spark, rows)).collect())
    assert got == sorted((-1 if i is None else i, least[r]) for r, (i, _) in zip(root, rows)) and 3 < len(set(root)) < 40


# ---- BPE


def test_streaming_encoder_equals_the_library(texts):
    rng = random.Random(5)
    more = [*texts, "'s 'll don't", "a" * 3000, "ab" * 2500, " " * 900 + "z", "\n\n \t x", "1" * 800, "!" * 700 + "a", "日本語" * 300, "a　b c", "<|endoftext|> x", "tail <|endoftext|>"]
    more += ["".join(rng.choice("ab 'st1!é\n") for _ in range(rng.randrange(300))) for _ in range(150)]
    assert merge_rank_is_id(PATH)
    for window in (16, 17, 64):
        encode = bpe.Encoder(PATH, window)
        for t in more:
            if "<|" in t:
                assert bpe.encode_text(PATH, t) == library(PATH).encode(t, add_special_tokens=False).ids
                continue
            got = [i for k in range(0, len(t), 37) for i in encode.feed(t[k : k + 37])] + encode.close()
            assert got == library(PATH).encode(t, add_special_tokens=False).ids, (window, t[:50])
    assert all((encoder(PATH)(t) == library(PATH).encode(t, add_special_tokens=False).ids).all() for t in more if t)


def test_lookahead_bounds_how_far_a_cut_reaches():
    v = load(PATH)
    reach = bpe.sufficient_lookahead(v)
    assert reach >= v.longest - 1
    merge = bpe.Encoder(PATH).merge_piece
    rng = random.Random(6)
    for _ in range(200):
        w = "".join(rng.choice(["the", "ing", "er", "a", "re", "x", "tion", "aaaa"]) for _ in range(300)).encode()
        cut = len(w) - rng.randrange(1, 200)
        ends = lambda ids: np.cumsum([len(v.bytes[i]) for i in ids])
        a, b = ends(merge(w)), ends(merge(w[:cut]))
        assert [x for x in a if x <= cut - reach] == [x for x in b if x <= cut - reach]


def test_decoder_is_the_library_s():
    rng = random.Random(7)
    decode = bpe.Decoder(PATH)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(25)]
        got = "".join(decode.feed(ids[k : k + 2]) for k in range(0, 25, 2)) + decode.close()
        assert got == library(PATH).decode(ids, skip_special_tokens=False)


# ---- top-k


def test_threshold_algorithm_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(150)]
    rows += [(200, None), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (206, [float("inf")] * 6), (None, [1.0] * 6), (208, [1.0, 2.0]), (210, [3.0, 1.0]), (212, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 9, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = collections.defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 2 == 0, 5, 1.5, 40, 16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = [(i, [math.floor(1.5 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in ok:
        if i % 2 == 0:
            all_ = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:5]
            assert got.pop(i, []) == [(k + 1, j, -s) for k, (s, j) in enumerate(all_)]
    assert not got


# ---- chat


def test_events_fold_into_final_messages(spark):
    e = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 3, "regenerate", None, "G"), (1, 1, 4, "delta", None, "ood day"),
        (1, 2, 5, "message", "user", "x"), (1, 2, 6, "edit", None, "y"),
        (2, 0, 0, "delta", "assistant", "only"), (2, 1, 1, None, None, None), (None, 0, 0, "message", "user", "lost"),
        (3, 0, 0, "message", "user", "a"), (3, 0, 0, "message", "user", "a"),
    ]
    schema = "conv_id long, turn long, seq long, kind string, role string, text string, e int, s int, at int"
    back = chat.read_back(chat.format_chats(spark.createDataFrame([(*r, 1, 2, 3) for r in e], schema))).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in back}
    assert got == {1: ([("user", "hi"), ("assistant", "Good day"), ("user", "y")], "Good day"), 2: ([("assistant", "only"), ("", "")], "only"), None: ([("user", "lost")], ""), 3: ([("user", "a"), ("user", "a")], "")}


def test_control_strings_come_back(spark):
    rng = random.Random(3)
    bits = ["<|im_start|>", "<|im_end|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "<\\s>", "a", "\n", "é", "\U0001f600", "\x01", "\\n"]
    rows = [(i, t, t, "message", rng.choice(["assistant", "user", "".join(rng.choice(bits) for _ in range(3))]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(60) for t in range(3)]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, seq long, kind string, role string, text string"))).collect()
    for r in out:
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[4], x[5]) for x in own]
        assert r.loss_text == "".join(x[5] for x in own if x[4] == "assistant")
        assert r.formatted.count("<|im_end|>") == 3 and "</s>" not in r.formatted and "[INST]" not in r.formatted


# ---- repeats


def brute_repeats(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w in seen:
                cut[k : k + width] = b"\1" * width
            seen.add(w)
        out[i] = (len(b), sum(cut), sum(1 for k in range(len(b)) if cut[k] and not (k and cut[k - 1])), bytes(x for x, y in zip(b, cut) if not y))
    return out


def test_repeats_by_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(70):
        k = rng.random()
        if k < 0.3 and rows:
            t = rng.choice(rows)[1]
            p = rng.randrange(len(t) + 1)
            t = t[:p] + rng.choice("xyz") + t[p:]
        elif k < 0.5:
            t = rng.choice(["ab", "a", "abc", "x" * 40 + "y", "xyz " * 12 + "q", "é"]) * rng.randrange(1, 200)
        elif k < 0.7 and rows:
            t = "".join(rng.choice(rows)[1][rng.randrange(50) :][: rng.randrange(300)] for _ in range(4))
        else:
            t = "".join(rng.choice("ab é") for _ in range(rng.randrange(900)))
        rows.append((i, t))
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(documents(spark, rows)).collect()}
    assert got == brute_repeats(rows)


def test_runs_do_not_depend_on_groups_and_stretches(monkeypatch):
    rng = random.Random(1)
    texts = ["ab" * 3000, "".join(rng.choice("ab é") for _ in range(5000)), "x" * 7000, "".join(rng.choice(["hello world this is ", " foo"]) for _ in range(800)), "short", None]

    def found(segment, group):
        monkeypatch.setattr(suffix, "SEGMENT", segment)
        monkeypatch.setattr(suffix, "GROUP", group)
        return {x for r, d, p in suffix.stretches([], pa.array(texts), 100) for x in zip(d.tolist(), p.tolist(), r.windows.tolist(), r.contents().tolist())}

    assert found(1 << 22, 1 << 20) == found(1 << 22, 3000) == found(700, 3000) == found(200, 10)


def test_equal_rows_are_both_kept(spark):
    t = "a long enough text to hold more than a hundred bytes, which is needed for anything to be cut out of it at all, so it goes on"
    got = {(r.doc_id, r.n_removed) for r in suffix.remove_repeats(documents(spark, [(1, t), (1, t), (2, t), (None, t)])).collect()}
    assert got == {(1, 0), (2, len(t)), (None, len(t))}


# ---- the registered queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    rows = lambda df: sorted(map(repr, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert rows(queries.queries()[name](spark, D).toPandas()) == rows(con.sql(queries.oracle_sql()[name]).df())

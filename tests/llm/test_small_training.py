"""The language model where most ranges stay empty, and words that simple hashes confuse."""

import zlib

import pytest

from driftline.llm import common, lm


@pytest.mark.parametrize("words", [1, 3, 40])
def test_few_training_words_over_many_ranges(spark, words):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        ids = list(range(40))
        train = [i for i in ids if zlib.crc32(str(i).encode()) % 5 != 1][:1]
        held = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 1][:3]
        rows = [(i, " ".join(f"w{k}" for k in range(words))) for i in train] + [(i, f"w1 w0 unseen{i} w2") for i in held]
        out = {r.doc_id: r for r in lm.perplexities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert len(out) == 4 and out[train[0]].train_tokens == words + 1
        assert all(out[i].n_tokens == 5 and out[i].n_known == 1 + sum(f"w{k}" in {f"w{j}" for j in range(words)} for k in (0, 1, 2)) and out[i].score < 0 for i in held)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomial_hashes_confuse_are_two(spark):
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    out = {r.doc_id: r for r in lm.perplexities(spark.createDataFrame([(ids[0], f"{a} {a} x"), (ids[1], b)], "doc_id long, text string")).collect()}
    n, v = 6, 4  # a, a, x, b and two ends; four different
    import math

    assert math.isclose(out[ids[1]].base_score, math.log10(1.5 / (n + 0.5 * (v + 1))) + math.log10(2.5 / (n + 0.5 * (v + 1))))


def test_equal_hashes_of_two_words_start_the_count_again(spark, monkeypatch):
    import xxhash

    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda w, seed=0: real(w, seed) if seed != 0 or w not in (b"one", b"two") else 77)
    found = lm.Tokens([b"one two one"], 0)
    counter = lm.Counter()
    counter.add(found.distinct, found.counts, found.checks(1))
    keys, counts, checks = counter.take()
    assert sorted(counts.tolist()) == [1, 1, 2] and sorted(keys.tolist()).count(77) == 2 and len(set(checks.tolist())) == 3


def test_tasks_send_what_exceeds_the_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i, i + 30))) for i in range(0, 200)], "doc_id long, text string")
    want = {r.doc_id: r.score for r in lm.perplexities(rows).collect()}
    monkeypatch.setattr(lm, "GROUP_BYTES", 100)
    monkeypatch.setattr(lm.Counter, "full", lambda self: self.size > 50)
    got = {r.doc_id: r.score for r in lm.perplexities(rows).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(Session())

"""Registered queries over texts with very long runs and over repeated rows, on their own small tables."""

import hashlib
import random

import numpy as np
import pytest

from driftline.llm import bpe, packing, queries
from driftline.llm.vocabulary import library

PATH = queries.tokenizer_file()


@pytest.fixture(scope="module")
def long_runs(spark, tmp_path_factory):
    texts = ["x" + " " * 1_200_000 + "y", "\t" * 300_000, "\n" * 150_000 + "a", " \n" * 100_000, "q" * 150_000, "<|endoftext|>" + " " * 200_000 + "<|endoftext|> end", None, "", "short one"]
    folder = str(tmp_path_factory.mktemp("runs"))
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, texts


def test_bpe_of_long_runs_equals_the_library(spark, long_runs):
    folder, texts = long_runs
    got = {r.doc_id: r for r in queries.op7_bpe(spark, folder).collect()}
    for i, t in enumerate(texts):
        ids = library(PATH).encode(t or "", add_special_tokens=False).ids
        decoded = library(PATH).decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_packing_of_long_runs(spark, long_runs):
    folder, texts = long_runs
    got = queries.op3_packing(spark, folder).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        n = len(library(PATH).encode(t or "", add_special_tokens=False).ids) + 1
        assert got.loc[i, "sum(length)"] == got.loc[i, "max(doc_tokens)"] == n


def test_repeated_rows_spread_over_groups(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 3000, "doc_id long, text string").repartition(5)
    pieces = packing.pack(docs, PATH, group_docs=100).toPandas()
    groups = pieces.groupby(pieces.sequence_id // 2**32).length.sum()
    assert len(groups) > 20 and groups.max() < 200 * 4 and pieces.length.sum() == 3000 * pieces.doc_tokens[0]


def test_what_waits_stays_small_whatever_the_run():
    encode = bpe.Encoder(PATH)
    for ch in " \t\nx1!é":
        for _ in range(300):
            encode.feed(ch * 1024)
            assert len(encode.waiting) <= 2 * encode.window and len(encode.inside or b"") <= 2 * (encode.stretch + 4 * encode.window)
        assert encode.close() is not None


def test_short_texts_pass_through_the_transducer():
    """Tokens come out before the text ends, so the end alone does not encode it."""
    encode = bpe.Encoder(PATH, 16)
    text = "a short text of some forty characters it is"
    early = encode.feed(text)
    assert len(early) > 3 and early + encode.close() == library(PATH).encode(text, add_special_tokens=False).ids


def test_random_texts_with_control_strings_and_unassigned_characters():
    rng = random.Random(3)
    bits = [*"ab 'st1!é\n\t", "<|endoftext|>", "<|", "<|endoftext", "'ll", " " * 24, "՘", "\U000323b0", "日本", "\x1c", "\x85", "　", "½", "a" * 8, "\U0001f600"]
    for window in (16, 17, 1024):
        encode = bpe.Encoder(PATH, window)
        for _ in range(300):
            t = "".join(rng.choice(bits) * rng.choice([1, 1, 2, 30]) for _ in range(rng.randrange(60)))
            step = rng.choice([1, 7, 37, 5000])
            got = [i for k in range(0, len(t), step) for i in encode.feed(t[k : k + step])] + encode.close()
            assert got == library(PATH).encode(t, add_special_tokens=False).ids

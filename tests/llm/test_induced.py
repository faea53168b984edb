"""Induced suffix sorting against sorting by comparison, and the repeats that the order shows."""

import random

import pytest

from driftline.llm import induced, suffix
from tests.llm.test_corpus_operators import documents


def plain(data, limit):
    order, out = sorted(range(len(data)), key=lambda i: data[i:]), []
    for k, i in enumerate(order):
        n = 0
        if k:
            j = order[k - 1]
            while n < limit and i + n < len(data) and j + n < len(data) and data[i + n] == data[j + n]:
                n += 1
        out.append((i, n))
    return out


@pytest.mark.parametrize("room", [3, 1000])
def test_order_and_common_prefixes(room):
    rng = random.Random(0)
    for k in range(150):
        data = bytes(rng.choice(b"ab" if k % 3 else b"abcdxyz") for _ in range(rng.randrange(0, 60))) * (4 if k % 7 == 0 else 1)
        assert list(induced.suffix_order([data], 10, room)) == [(0, *x) for x in plain(data, 10)]


def test_queue_spills_and_stays_in_order(tmp_path):
    rng = random.Random(1)
    queue, want = induced.DiskQueue(str(tmp_path), 2, 5), []
    for k in range(200):
        queue.push((rng.randrange(50), k))
    while queue.peek() is not None:
        want.append(queue.pop())
    assert want == sorted(want) and len(want) == 200 and not list(tmp_path.iterdir())


def test_repeats_are_what_the_order_shows(spark):
    rng = random.Random(2)
    line = "a line of sixty bytes or so that many documents have in them\n" * 2
    rows = [(i, "".join(rng.choice([line, "".join(rng.choice("abcd ") for _ in range(150))]) for _ in range(4))) for i in range(12)]
    docs = documents(spark, rows)
    cut = {(r.doc_id, p) for r in suffix.remove_repeats(docs).collect() for s in r.spans for p in range(s.start, s.start + s.length)}
    order = induced.order_shards(docs, 1).orderBy("rank").collect()
    shown, group = set(), []
    for r in [*order, None]:
        if r is None or r.lcp < 100:
            for doc, at in sorted(group)[1:]:
                shown |= {(doc, p) for p in range(at, at + 100)}
            group = []
        if r is not None:
            group.append((r.doc_id, r.position))
    assert cut == shown and cut

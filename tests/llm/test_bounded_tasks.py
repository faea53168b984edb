"""What a map task of the repeats' passes holds doesn't grow with the rows it reads."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from driftline.llm import suffix
from driftline.llm.common import shared_root


class Captured(Exception):
    pass


class Rows:
    def mapInArrow(self, run, schema):
        raise Captured(run)


def mapped(job):
    """The function that a pass maps over its rows."""
    with pytest.raises(Captured) as caught:
        job(Rows())
    return caught.value.args[0]


def batches(count):
    rng = np.random.default_rng(3)
    for k in range(count):
        texts = [rng.integers(97, 123, 4000, dtype=np.uint8).tobytes().decode() for _ in range(64)]
        yield pa.RecordBatch.from_arrays([pa.array(range(64 * k, 64 * k + 64), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def peak(run, count):
    tracemalloc.start()
    rows = sum(batch.num_rows for batch in run(batches(count)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most, rows


def test_map_tasks_send_what_exceeds_a_bound(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix, "GROUP", 1 << 15)
    monkeypatch.setattr(suffix, "HELD", 1 << 12, raising=False)
    folder = shared_root(spark) + "/bounded"
    tables = [suffix.Table(folder, kind, columns, 4) for kind, columns in (("s", ""), ("w", ""), ("p", "da"))]
    seen = [runs.sample for batch in batches(48) for runs, _, _ in suffix.stretches([], batch.column(1), 100)]
    every = np.unique(np.concatenate(seen))
    edges = np.searchsorted(suffix._range(every, 4), np.arange(5))
    for part in range(4):
        tables[0].write(part, every[:0])
        tables[1].write(part, every[edges[part] : edges[part + 1]])
    for run in (mapped(lambda rows: suffix._samples(rows, *tables[:2], 100)), mapped(lambda rows: suffix._firsts(rows, *tables, 100))):
        few, many = peak(run, 6), peak(run, 48)
        assert many[1] > 4 * few[1] > 0  # it sends as it goes
        assert many[0] < 1.6 * few[0]


@pytest.mark.parametrize("held", [8, 64])
def test_sending_early_changes_no_result(spark, monkeypatch, held):
    rng = np.random.default_rng(4)
    pieces = ["".join(rng.choice(list("abcdé "), 130)) for _ in range(12)]
    docs = spark.createDataFrame([(int(k), "".join(pieces[j] for j in rng.integers(0, 12, 5))) for k in rng.permutation(60)], "doc_id long, text string").coalesce(2)

    def result():
        cut = suffix.remove_repeats(docs).collect()
        kept = suffix.without_repeats(docs).collect()
        return sorted(map(repr, cut)), sorted(map(repr, kept))

    want = result()
    monkeypatch.setattr(suffix, "HELD", held)
    monkeypatch.setattr(suffix, "SLICE", 7)
    assert result() == want

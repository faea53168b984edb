"""The pipeline's stages against brute force on a small table."""

import corpus_pipeline as pipeline
from driftline.llm import packing, queries, toxicity
from driftline.llm.common import spool
from tests.llm.test_corpus_operators import brute_repeats
from tests.llm.test_near_copies import similar_classes

D = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{D}/labels.parquet").filter(~toxicity.held_out()))
    given = {r.doc_id: r.text for r in docs.collect()}
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = {i: t for i, t in given.items() if score[i] < 0.7}
    docs = spool(pipeline.STAGES[0][1](spark, docs, D), "a")
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want and 0 < len(want) < len(given)

    ids = sorted(want)
    first = {}
    for i, c in zip(ids, similar_classes([(i, want[i]) for i in ids])):
        first.setdefault(c, i)
    want = {i: want[i] for i in first.values()}
    docs = spool(pipeline.STAGES[1][1](spark, docs, D), "b")
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == want and len(want) < len(ids)

    kept = {i: b.decode("utf-8", "ignore") for i, (_, _, _, b) in brute_repeats(want.items()).items()}
    docs = spool(pipeline.STAGES[2][1](spark, docs, D), "c")
    got = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == columns and got == {i: t for i, t in kept.items() if t or not want[i]}
    assert docs.filter("n_chars != length(text)").count() == 0 and got != want

    packed = pipeline.STAGES[3][1](spark, docs, D).toPandas()
    whole = packing.pack(docs, queries.tokenizer_file()).toPandas()
    assert len(packed) == len(whole) and set(packed.doc_id) == set(got)


def test_run_gives_the_stages_result(spark):
    assert pipeline.run(spark, D).count() > 0


def test_stages_take_awkward_rows(spark):
    """Nulls in every column, repeated rows and ids, empty texts and columns of clashing names pass every stage."""
    long = "a passage of more than a hundred bytes that stands in several documents of this table and is therefore cut from all but one. "
    rows = [(1, long * 3, "en", None, 5, "x"), (1, long * 3, "en", None, 5, "x"), (2, None, None, None, None, None), (None, "words of a row without an id", "en", "web", 1, "y"), (None, None, None, None, None, None), (3, "", "en", "web", 0, "y"), (4, "you stupid idiot moron loser", "en", "web", 1, "z"), (5, "another text " * 50 + long, "de", "web", 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = spool(stage(spark, docs, D), name)
        assert docs.columns == columns
    left = docs.collect()
    assert {r.doc_id for r in left} >= {1, 5} and sum(r.doc_id == 1 for r in left) == 2 and not any(r.doc_id == 4 for r in left)
    pieces = pipeline.STAGES[-1][1](spark, docs, D)
    assert pieces.select("doc_id").distinct().count() == len({r.doc_id for r in left})
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), D).count() == 0 and all(stage(spark, docs.limit(0), D).count() == 0 for _, stage in pipeline.STAGES[:-1])

import numpy as np

from driftline.sources import series as src
from driftline.streaming import online


def test_stream_equals_batch_over_several_triggers(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = {i: rng.normal(i, 1 + i, 50).round(3) for i in range(3)}
    folder = tmp_path / "in"
    for k, (lo, hi) in enumerate([(0, 20), (20, 33), (33, 50)]):
        rows = [(i, t, float(v[t])) for i, v in values.items() for t in range(lo, hi)]
        spark.createDataFrame(rows, "id long, seq long, x double").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema("id long, seq long, x double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = online.detect(stream).writeStream.format("memory").queryName("scores").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.id, r.t): r.score for r in spark.table("scores").collect()}
    rows = [(i, t + 1, float(v[t])) for i, v in values.items() for t in range(50)]
    batch = online.detect_batch(src.split(spark.createDataFrame(rows, "id long, time long, x double"), 32))
    want = {(r.id, r.t): r.score for r in batch.collect()}
    assert got.keys() == want.keys() and len(got) == 3 * 18
    assert all(abs(got[k] - want[k]) < 1e-8 for k in got) and all(0 <= s <= 1 for s in got.values())

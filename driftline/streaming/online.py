"""Online scoring: each series is calibrated on its first values and scored value by value.

State per series is a calibration record and two reflected walks, so it does not grow with the
stream.  Every input row past the history gives exactly one score within [0, 1].
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n long, s1 double, s2 double, up double, down double, top double"
OUTPUT = "id long, t long, score double"


def step(state: tuple, x: float, history: int, k: float) -> tuple[tuple, float | None]:
    """One value: the new state, and a score once the history is complete."""
    n, s1, s2, up, down, top = state
    if n < history:
        return (n + 1, s1 + x, s2 + x * x, up, down, top), None
    mu = s1 / history
    sd = max(math.sqrt(max((s2 - history * mu * mu) / max(history - 1, 1), 0.0)), 1e-9)
    z = (x - mu) / sd
    up, down = max(0.0, up + z - k), max(0.0, down - z - k)
    top = max(top, up, down)
    return (n + 1, s1, s2, up, down, top), 1 - math.exp(-top / math.sqrt(n - history + 1))


def detect(stream: DataFrame, history: int = 32, k: float = 0.5, announce: bool = False) -> DataFrame:
    """(id, t, score) of a streaming ``(id, seq, x)``; rows of one trigger are taken in order of seq.

    With ``announce`` a series yields a record with t -1 and no score once its history is complete.
    """

    def run(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        rows = []
        for x in pd.concat(list(chunks)).sort_values("seq").x:
            now, score = step(now, float(x), history, k)
            if score is not None:
                rows.append((key[0], now[0] - 1 - history, score))
            elif announce and now[0] == history:
                rows.append((key[0], -1, None))
        state.update(now)
        yield pd.DataFrame(rows, columns=["id", "t", "score"]).astype({"score": "float64"})

    return stream.groupBy("id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def trailing_means(stream: DataFrame, width: int) -> DataFrame:
    """(id, t, mean) over the last ``width`` values of a streaming ``(id, seq, x)``: a window by count, which time windows can't be.

    State per series is the window's values, so it does not grow with the stream.
    """

    def run(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = []
        for x in pd.concat(list(chunks)).sort_values("seq").x:
            held = (held + [float(x)])[-width:]
            rows.append((key[0], n, sum(held) / len(held)))
            n += 1
        state.update((held, n))
        yield pd.DataFrame(rows, columns=["id", "t", "mean"])

    return stream.groupBy("id").applyInPandasWithState(run, "id long, t long, mean double", "held array<double>, n long", "append", GroupStateTimeout.NoTimeout)


def run_available(scores: DataFrame) -> DataFrame:
    """Run a streaming query over all that its source has now, and read its output table."""
    import tempfile
    import uuid

    spark = scores.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="driftline-")
    folder = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = scores.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(scores.schema).parquet(f"{folder}/out")


def detect_batch(series: DataFrame, k: float = 0.5) -> DataFrame:
    """The same scores of a series table by window functions."""
    from driftline.operators import calibration, features
    from driftline.sources.series import history

    rows = features.cusum(features.prepared(series, calibration.moments(history(series))), k, "c")
    return rows.select("id", "t", (1 - F.exp(-F.col("c_n"))).alias("score"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts and sums by time window with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

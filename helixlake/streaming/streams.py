"""Structured Streaming: ticks, windows with late data, an equilibrium detector, a workflow state machine, merged sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helixlake.session import shared_dir

#: Allowed moves of a workflow: state, event, next state.
MOVES = [
    ("idle", "start", "design"), ("design", "pass", "simulate"), ("simulate", "pass", "engineer"), ("engineer", "pass", "validate"), ("validate", "pass", "learn"),
    ("validate", "fail", "design"), ("learn", "loop", "design"), ("learn", "finish", "done"),
]


def ticks(spark: SparkSession, per_second: int = 60) -> DataFrame:
    """(timestamp, value): a stream of simulation ticks."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def table_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet table, one file or a folder of them, as a stream of its files; times without a zone are read as the session's."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per window; events later than the watermark allows are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of stretches of a user's events without a gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def merged(*streams: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """Streams of the same columns as one; of rows with the same key within the watermark the first counts."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def equilibria(ticks_: DataFrame, tolerance: float = 0.005, least: int = 60) -> DataFrame:
    """(run, step, length): a row whenever a run's value has changed by less than the tolerance ``least`` times in a row."""

    def detect(key, frames: Iterator, state: GroupState):
        import pandas as pd

        before, length = state.get if state.exists else (None, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("step")
        for step, value in zip(rows["step"], rows["value"]):
            calm = before is not None and abs(value - before) / max(abs(before), 1e-9) < tolerance
            length = length + 1 if calm else 0
            if length == least:
                out.append((key[0], int(step), length))
            before = float(value)
        state.update((before, length))
        yield pd.DataFrame(out, columns=["run", "step", "length"])

    return ticks_.groupBy("run").applyInPandasWithState(detect, "run long, step long, length long", "before double, length long", "append", GroupStateTimeout.NoTimeout)


def workflow(events: DataFrame) -> DataFrame:
    """(project, seq, event, state, iteration, moved): every event (project, seq, event) with the state it leads to; a loop counts an iteration."""
    moves = {(a, e): b for a, e, b in MOVES}

    def fold(key, frames: Iterator, state: GroupState):
        import pandas as pd

        at, iteration = state.get if state.exists else ("idle", 1)
        out = []
        for seq, event in pd.concat(list(frames)).sort_values("seq")[["seq", "event"]].itertuples(index=False):
            to = moves.get((at, event))
            iteration += event == "loop" and to is not None
            at = to or at
            out.append((key[0], int(seq), event, at, int(iteration), to is not None))
        state.update((at, int(iteration)))
        yield pd.DataFrame(out, columns=["project", "seq", "event", "state", "iteration", "moved"])

    return events.groupBy("project").applyInPandasWithState(fold, "project long, seq long, event string, state string, iteration long, moved boolean", "state string, iteration long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, with its checkpoint and output in the shared folder, and read the result.

    In complete and update mode the rows of every trigger are kept with their batch, and those of the last
    one (complete) are returned.
    """
    spark = stream.sparkSession
    to = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{to}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/out/batch={number}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{to}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    own = spark.read.parquet(f"{to}/out")
    last = own.agg(F.max("batch")).first()[0]
    return own.where(F.col("batch") == last).drop("batch")

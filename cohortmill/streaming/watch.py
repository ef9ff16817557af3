"""Run logs, limits, job states and arriving files as streams."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cohortmill.operators import registry
from cohortmill.operators.logs import DICE_NAMES, NUMBERS, line_fields
from cohortmill.session import dropped, importable, written

FIELDS = [*NUMBERS, *DICE_NAMES]
EPOCHS = "run_id string, epoch long, " + ", ".join(f"{f} double" for f in FIELDS)
_OPEN = "epoch long, last long, " + ", ".join(f"{f} double" for f in FIELDS)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of lines `run<TAB>seq<TAB>line` from files dropped into a folder; seq orders the lines of a run."""
    raw = spark.readStream.schema("value string").text(path)
    p = F.split("value", "\t", 3)
    return raw.select(p[0].alias("run_id"), p[1].cast("long").alias("seq"), p[2].alias("line"))


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = dict(zip(["epoch", "last", *FIELDS], state.get, strict=True)) if state.exists else {"epoch": None, "last": -1} | dict.fromkeys(FIELDS)
    out = []

    def close() -> None:
        if held["epoch"] is not None and held["train_loss"] is not None and held["epoch"] > held["last"]:
            out.append([key[0], held["epoch"], *[held[f] for f in FIELDS]])
            held["last"] = held["epoch"]

    # a micro-batch brings a run's lines in any order of files: they are put in order of seq first
    for row in pd.concat(list(frames)).sort_values("seq").itertuples():
        if not pd.isna(row.epoch_mark):
            close()
            held.update(dict.fromkeys(FIELDS), epoch=int(row.epoch_mark))
        for f in FIELDS:
            v = getattr(row, f)
            if not pd.isna(v):
                held[f] = float(v)
    state.update(tuple([held["epoch"], held["last"], *[held[f] for f in FIELDS]]))
    if out:
        yield pd.DataFrame(out, columns=["run_id", "epoch", *FIELDS])


def tail_epochs(lines: DataFrame) -> DataFrame:
    """A stream of epochs: an epoch is given out when the next one begins, if it has a training loss and is later than
    the last one given out; the state of a run is its open epoch."""
    importable(lines.sparkSession)
    rows = line_fields(lines).select("run_id", "seq", "epoch_mark", *FIELDS)
    return rows.groupBy("run_id").applyInPandasWithState(_advance, EPOCHS, _OPEN, "append", GroupStateTimeout.NoTimeout)


def slo_watch(epochs: DataFrame, limits: dict[str, float] | None = None, keep_s: int | None = None) -> DataFrame:
    """The first epoch of each run that meets all limits, once a run. Of a stream the state of a run is one flag, and
    epochs of a run come in order from tail_epochs(); of a table it is a plain minimum. With keep_s the flag of a run that has
    had no such epoch for so many seconds of processing time is given up, so that state doesn't grow with all runs ever seen."""
    ok = F.lit(True)
    for c, least in (limits or {"dice_myo": 0.90, "dice_lv": 0.90, "dice_rv": 0.85}).items():
        ok = ok & (F.col(c) >= least)
    met = epochs.where(ok)
    if not epochs.isStreaming:
        rest = [c for c in met.columns if c not in ("run_id", "epoch")]
        return met.groupBy("run_id").agg(F.min(F.struct("epoch", *rest)).alias("r")).select("run_id", "r.*").select(*met.columns)
    columns, kind = met.columns, ", ".join(f"`{c}` {k}" for c, k in met.dtypes)

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fresh = not state.exists
        state.update((True,))
        if keep_s is not None:
            state.setTimeoutDuration(keep_s * 1000)
        if fresh:
            yield pd.concat(list(frames)).nsmallest(1, "epoch")[columns]

    timer = GroupStateTimeout.NoTimeout if keep_s is None else GroupStateTimeout.ProcessingTimeTimeout
    return met.groupBy("run_id").applyInPandasWithState(first, kind, "told boolean", "append", timer)


#: Seconds after which a job that is not heard of has failed, and the states that end a job.
SILENCE_S, ENDED = 300, ("completed", "failed")


def job_watch(events: DataFrame, key: str, state: Column, order: list[str], ended: tuple[str, ...] = ENDED, silence_s: int = SILENCE_S) -> DataFrame:
    """A stream of (key, state, n_events, timed_out): a row for each job of a micro-batch, its last state by `order` so far.

    A timer of processing time is set with every event of a job that has not ended; a job that is silent for silence_s
    comes out once as failed, timed_out. The state of a job that ended or failed goes with its row, so that a job
    ends once and only open jobs are remembered; an event after that begins it anew. Timers are looked at
    whenever a micro-batch runs, so that such a stream goes on until it is stopped: with the availableNow trigger it would
    not end. Null keys are left out.
    """
    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("job"), state.cast("string").alias("state"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    places = [f"o{i}" for i in range(len(order))]
    kind = f"`{key}` {events.schema[key].dataType.simpleString()}, state string, n_events long, timed_out boolean"

    def advance(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            _, n, _ = held.get
            held.remove()
            yield pd.DataFrame([[k[0], "failed", n, True]], columns=[key, "state", "n_events", "timed_out"])
            return
        name, n, last = held.get if held.exists else (None, 0, None)
        at = pickle.loads(last) if last is not None else None
        for pdf in frames:
            n += len(pdf)
            for *now, s in pdf[[*places, "state"]].itertuples(index=False):
                if at is None or tuple(now) >= at:
                    at, name = tuple(now), s
        if name in ended:
            held.remove()
        else:
            held.update((name, n, pickle.dumps(at)))
            held.setTimeoutDuration(silence_s * 1000)
        yield pd.DataFrame([[k[0], name, n, False]], columns=[key, "state", "n_events", "timed_out"])

    return rows.groupBy("job").applyInPandasWithState(advance, kind, "state string, n long, at binary", "update", GroupStateTimeout.ProcessingTimeTimeout)


def job_progress(events: DataFrame, key: str, state: Column, order: list[str], ended: Column | None = None) -> DataFrame:
    """Per job the last state and the number of events (update mode); `ended` adds whether the job is over."""
    out = events.withColumn("__s", state).groupBy(key).agg(F.max_by("__s", F.struct(*order)).alias("state"), F.count("*").alias("n_events"))
    return out if ended is None else out.withColumn("over", ended)


def timed_out(jobs: DataFrame, now: Column, started: str, limit_s: int = 300) -> DataFrame:
    """jobs with state failed where one still runs after the limit."""
    late = ~F.col("state").isin("completed", "failed") & ((now.cast("double") - F.col(started).cast("double")) > limit_s)
    return jobs.withColumn("state", F.when(late, "failed").otherwise(F.col("state")))


def ingest_stream(spark: SparkSession, path: str, seed_key: Callable[[Column], Column], out: str, checkpoint: str) -> StreamingQuery:
    """Files that arrive become registry rows: a batch appends jobs(job_id, twin_id, status, size, sha256), job_id being
    the content's hash; files whose job is there already add nothing, so that a repeated batch is harmless. The table
    is partitioned by the first two hex digits of the hash, and a batch reads those partitions alone that it touches."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    kind = "job_id string, twin_id string, status string, size int, sha256 string, prefix string"

    def put(batch: DataFrame, _: int) -> None:
        sha = F.sha2("content", 256)
        rows, rows_path = written(batch.select(sha.alias("job_id"), seed_key(sha).alias("twin_id"), F.length("content").alias("size"), sha.alias("sha256")).dropDuplicates(["job_id"]), "arrived")
        touched = [r[0] for r in rows.select(F.substring("job_id", 1, 2)).distinct().collect()]  # 256 at most
        session = batch.sparkSession
        empty = session.createDataFrame([], kind)
        try:
            old = session.read.schema(kind).parquet(out).where(F.col("prefix").isin(touched))
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = empty
        fresh = rows.join(old.select("job_id"), "job_id", "left_anti")
        jobs = registry.register_jobs(empty.drop("prefix"), fresh).withColumn("prefix", F.substring("job_id", 1, 2))
        jobs.write.mode("append").partitionBy("prefix").parquet(out)
        dropped(session, rows_path)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

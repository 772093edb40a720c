"""Documents assembled from a stream of words that come late and out of order.

A document's words wait in state until the watermark says that the document has been quiet for long
enough; then they leave together, in order, and utterances, baselines and markup are worked out by the
same DataFrame operators as in batch.  A document that has left is remembered for a while, so that
words that still come for it are told apart instead of beginning a second one."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import speech
from .sessions import accepted as judged

# the driver starts a worker of its own for stateful processors, which does not see shipped files
for _module in (__name__, judged.__module__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # stores of an executor share buffers and a cache, else each has its own
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}

_BUCKET = "__bucket"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State with timers and lists needs the state store on disk: set for what starts within."""
    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def packed(rows: pd.DataFrame) -> tuple[bytes]:
    """Rows as one state value."""
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


def unpacked(values: Iterator[tuple]) -> pd.DataFrame:
    return pd.concat([pa.ipc.open_stream(v[0]).read_pandas() for v in values], ignore_index=True)


class _Documents(StatefulProcessor):
    """Holds the words of a bucket's documents until each has been quiet for ``idle`` milliseconds of
    event time, and the documents' names for ``keep`` more.  A bucket looks through what it holds at
    most once in ``idle``."""

    def __init__(self, time: str, idle: int, keep: int):
        self.time, self.idle, self.keep = time, idle, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.words = handle.getListState("words", "data binary")
        #: Documents that have left, and when.
        self.gone = handle.getValueState("gone", "data binary")

    def _gone(self) -> pd.DataFrame:
        held = self.gone.get()
        return pd.DataFrame({"doc_id": [], "at": []}) if held is None else unpacked(iter([held]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        given = pd.concat(list(rows), ignore_index=True).drop(columns=_BUCKET, errors="ignore")
        late = given["doc_id"].isin(self._gone()["doc_id"])
        if late.any():
            yield given[late].assign(late=True)
            given = given[~late]
        if len(given):
            if not self.words.exists():
                self.handle.registerTimer(_ms(given[self.time].max()) + self.idle)
            self.words.appendValue(packed(given))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, gone = timerValues.getCurrentWatermarkInMs(), self._gone()
        gone = gone[gone["at"] + self.keep > now]
        ends = [int(gone["at"].min()) + self.keep] if len(gone) else []
        if self.words.exists():
            held = unpacked(self.words.get())
            latest = held.groupby("doc_id", dropna=False)[self.time].transform("max")
            quiet = latest + pd.Timedelta(milliseconds=self.idle) <= pd.Timestamp(now, unit="ms")
            self.words.clear()
            if quiet.any():
                names = held.loc[quiet, "doc_id"].drop_duplicates()
                gone = pd.concat([gone, pd.DataFrame({"doc_id": names, "at": now})]) if len(gone) else pd.DataFrame({"doc_id": names, "at": now})
                ends.append(now + self.keep)
                yield held[quiet].assign(late=False)
            if not quiet.all():
                self.words.appendValue(packed(held[~quiet]))
                ends.append(max(_ms(latest[~quiet].min()) + self.idle, now + 1))
        self.gone.update(packed(gone)) if len(gone) else self.gone.clear()
        if ends:
            self.handle.registerTimer(min(ends))

    def close(self) -> None:
        pass


def _ms(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


def finished_documents(words: DataFrame, time: str = "ts", late: str = "10 minutes", idle_ms: int = 60_000, keep_ms: int = 3_600_000, buckets: int = 64) -> DataFrame:
    """``words`` (doc_id, ``time``, ...) of a stream, a document's all in one batch once it has been
    quiet for ``idle_ms``, with ``late`` false; and with ``late`` true words that came for a document
    after that.  What is behind the watermark (as is all that is not after the epoch) is dropped by
    Spark and counted in the query's progress.  Documents share a state by bucket: take some for each
    task, so that the open documents of one fit a task's memory.  Start it within ``keyed_state``."""
    kind = T.StructType([*words.schema.fields, T.StructField("late", T.BooleanType())])
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    return words.withWatermark(time, late).withColumn(_BUCKET, bucket).groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=_Documents(time, idle_ms, keep_ms), outputStructType=kind, outputMode="append", timeMode="eventTime"
    )


def dropped_rows(query: StreamingQuery) -> int:
    """Rows of a query that came behind the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def assembled_into(
    words: DataFrame, path: str, time: str = "ts", late: str = "10 minutes", idle_ms: int = 60_000, keep_ms: int = 3_600_000, buckets: int = 64,
    classify: Callable[[DataFrame], DataFrame] = speech.with_emotion,
) -> tuple[DataFrame, DataFrame, int]:
    """Run a stream of words over what is there; gives the markup of all documents finished so far,
    the late words so far, and how many words this run dropped behind the watermark.

    A batch's documents and late words are written under its number in ``path``, which executors
    share, so a batch that is repeated after a failure writes the same files again.  A later call with
    the same ``path`` goes on where the last one ended."""
    spark = words.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        # written, not cached: cached words fill the executors, and tasks elsewhere fetch them whole
        left = f"{path}/left/batch={batch}"
        rows.write.mode("overwrite").parquet(left)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(left)
        own, there = [c for c in rows.columns if c not in ("late", time)], {r[0] for r in rows.select("late").distinct().collect()}
        if False in there:
            speech.assembled(rows.where("NOT late").select(*own), classify=classify).write.mode("overwrite").parquet(f"{path}/markup/batch={batch}")
        if True in there:
            rows.where("late").write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        _files(spark, left).delete(_path(spark, left), True)

    with keyed_state(spark):
        stream = finished_documents(words, time, late, idle_ms, keep_ms, buckets)
        query = stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = lambda part, kind: spark.read.schema(kind).parquet(f"{path}/{part}") if _there(spark, f"{path}/{part}") else spark.createDataFrame([], kind)
    return found("markup", "doc_id long, markup string").drop("batch"), found("late", stream.schema).drop("batch"), dropped_rows(query)


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_path(spark, path))


#: The bucket of requests whose client is null.
_NOBODY = -1


class _Limiter(StatefulProcessor):
    """Requests of a bucket's clients wait until the watermark has passed them and are then judged in
    order, each client by itself."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.window = limit, round(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "data binary")
        #: Clients and times, in microseconds, of accepted requests that the window may still hold.
        self.held = handle.getValueState("held", "data binary")
        #: The earliest timer, so that a batch registers one only for what is earlier.
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        given = pd.concat(list(rows), ignore_index=True).drop(columns=_BUCKET, errors="ignore")
        self.waiting.appendValue(packed(given))
        self._wake(-(-int(_micros(given["ts"]).min()) // 1000))
        return iter(())

    def _wake(self, at: int) -> None:
        if not self.timer.exists() or at < self.timer.get()[0]:
            self.timer.update((at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.timer.exists() and self.timer.get()[0] > timerValues.getCurrentWatermarkInMs():
            return  # a timer that an earlier one has done the work of
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = unpacked(iter([self.held.get()])) if self.held.exists() else None
        rows = unpacked(self.waiting.get()) if self.waiting.exists() else None
        if rows is not None:
            at = _micros(rows["ts"])
            due, rest = rows[at <= passed], rows[at > passed]
            if len(due):
                due, held = self._judged(due, held)
                yield due.assign(named=key[0] != _NOBODY)
                self.waiting.clear()
                if len(rest):
                    self.waiting.appendValue(packed(rest))
            if len(rest):
                self._wake(-(-int(_micros(rest["ts"]).min()) // 1000))
        if held is not None:
            held = held[held["at"] + self.window > passed]  # what comes later finds no other in its window
        if held is None or held.empty:
            self.held.clear()
        else:
            self.held.update(packed(held))
            self._wake(-(-int(held["at"].max() + self.window) // 1000))

    def _judged(self, due: pd.DataFrame, held: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """``due`` in the order of time with ``ok``, and what is held after it."""
        due = due.sort_values("ts", kind="stable")
        before = due.iloc[:0][["client"]].assign(at=0) if held is None else held
        code = pd.factorize(pd.concat([before["client"], due["client"]], ignore_index=True), use_na_sentinel=False)[0]
        old, new = code[: len(before)], code[len(before) :]
        order = np.argsort(new, kind="stable")
        times, ends = _micros(due["ts"])[order].tolist(), np.flatnonzero(np.diff(new[order], append=-1)) + 1
        window: dict[int, list[int]] = {}
        for c, t in zip(old.tolist(), before["at"].tolist(), strict=True):
            window.setdefault(c, []).append(t)
        ok, first, rows, kept = np.empty(len(due), bool), 0, [], []
        for end in ends.tolist():
            c = int(new[order[first]])
            ok[order[first:end]], left = judged(times[first:end], window.pop(c, []), self.limit, self.window)
            rows += [order[first]] * len(left)
            kept += left
            first = end
        still = before[np.isin(old, np.fromiter(window, np.int64, len(window)))]
        now = due.iloc[rows][["client"]].assign(at=np.array(kept, np.int64))
        return due.assign(ok=ok), now if still.empty else pd.concat([still, now], ignore_index=True)

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy("datetime64[us]").astype(np.int64)


def ordered_limit(requests: DataFrame, limit: int, seconds: float = 60.0, late: str = "1 minute", buckets: int = 64) -> DataFrame:
    """(client, ts, ok) of a stream of requests, as ``sessions.rate_limited`` judges a batch, whatever
    order they come in: a request waits until the watermark has passed it.  A client's state is what
    waits and at most ``limit`` accepted times, and goes once those have left the window.  Clients share
    a state by bucket, so that a batch costs a call for each bucket, not for each client: take some for
    each task, so that what waits in one fits a task's memory.  Start it within ``keyed_state``."""
    kind = requests.schema["client"].dataType
    bucket = F.when(F.col("client").isNull(), F.lit(_NOBODY).cast("long")).otherwise(F.pmod(F.xxhash64("client"), F.lit(buckets)))
    # without nulls: pandas would make doubles of all numbers of a batch that has one
    client = F.coalesce("client", F.lit(0).cast(kind)) if isinstance(kind, T.NumericType) else F.col("client")
    rows = requests.withWatermark("ts", late).select(bucket.alias(_BUCKET), client.alias("client"), "ts")
    out = rows.groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=_Limiter(limit, seconds), outputStructType=f"client {kind.simpleString()}, ts timestamp, ok boolean, named boolean", outputMode="append", timeMode="eventTime"
    )
    return out.select(F.when(F.col("named"), F.col("client")).alias("client"), "ts", "ok")

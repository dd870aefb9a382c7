"""Live state of calls: charged when they start, closed by their finish, interrupted by a timeout, refused after a failed clean call.

A journal row is (item, call, round, event, at, ok) with the events call_started
and call_finished; other events only move the clock.  Of repeated rows the earliest
counts.  A call is

* finished, where a finish lies at or before the start plus the timeout,
* interrupted otherwise; a finish that comes later changes nothing,
* refused, and not charged, where the item's round 0 failed or was interrupted before the call started,
* unstarted, and not charged, where only a finish is known.

`call_states` says so for a table, `live_states` for a stream, where every call
comes out once, when the watermark has passed its deadline.  A stream drops rows
that lie more than `late` behind the newest row of the batches before, as any
watermark does; `late` is the promise of its source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "item long, call long, state string, charged int, started timestamp, finished timestamp"


def call_states(rows: DataFrame, timeout_s: int) -> DataFrame:
    """OUT for a finite journal: a row a call."""

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("event") == kind, F.struct("at", F.coalesce("ok", F.lit(False)).alias("ok"), "round")))

    c = rows.where(F.col("event").isin("call_started", "call_finished")).groupBy("item", "call").agg(first("call_started").alias("s"), first("call_finished").alias("f"))
    deadline = F.col("s.at") + F.make_dt_interval(secs=F.lit(timeout_s))
    done = F.coalesce(F.col("f.at") <= deadline, F.lit(False))
    c = c.withColumns({"deadline": deadline, "done": done})
    failed = F.when((F.col("s.round") == 0) & ~(F.col("done") & F.col("f.ok")), F.when(F.col("done"), F.col("f.at")).otherwise(F.col("deadline")))
    c = c.withColumn("stop", F.min(failed).over(Window.partitionBy("item")))
    state = F.when(F.col("s").isNull(), "unstarted").when(F.coalesce(F.col("s.at") > F.col("stop"), F.lit(False)), "refused").when(F.col("done"), "finished").otherwise("interrupted")
    return c.select("item", "call", state.alias("state"), state.isin("finished", "interrupted").cast("int").alias("charged"), F.col("s.at").alias("started"), F.when(state.isin("finished", "unstarted"), F.col("f.at")).alias("finished"))


class Calls(StatefulProcessor):
    """Per item: its calls that are not closed, a timer for the deadline of each, and when its clean call failed."""

    def __init__(self, timeout_s: int):
        self.timeout = timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "call long", "start long, finish long, ok boolean, round long")
        self.stop = handle.getValueState("stop", "at long")

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        changed: dict[int, list] = {}
        for pdf in rows:
            for call, event, at, ok, round_ in zip(pdf["call"], pdf["event"], pdf["at"], pdf["ok"], pdf["round"], strict=True):
                if event not in ("call_started", "call_finished"):
                    continue
                call, ms = int(call), int(pd.Timestamp(at).value // 1_000_000)
                if call not in changed:
                    known = self.open.getValue((call,))
                    changed[call] = [*(known or (None, None, None, None)), self._deadline(known) if known else None]
                c = changed[call]
                ok = bool(ok) if ok is not None and ok == ok else False
                if event == "call_started" and (c[0] is None or (ms, int(round_)) < (c[0], c[3])):
                    c[0], c[3] = ms, int(round_)
                elif event == "call_finished" and (c[1] is None or (ms, ok) < (c[1], c[2])):
                    c[1], c[2] = ms, ok
        for call, (*c, before) in changed.items():
            self.open.updateValue((call,), tuple(c))
            after = self._deadline(c)
            if before != after:  # a timer may serve several calls: it stays, and finds nothing due
                self.handle.registerTimer(after)
        yield pd.DataFrame(columns=["item", "call", "state", "charged", "started", "finished"])

    def _deadline(self, c: Any) -> int:
        return (c[0] if c[0] is not None else c[1]) + self.timeout

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        due = sorted((c[0] is None, c[0] or 0, call[0], tuple(c)) for call, c in self.open.iterator() if self._deadline(c) <= now)
        for _, _, call, (start, finish, ok, round_) in due:
            done = start is not None and finish is not None and finish <= start + self.timeout
            stop = self.stop.get()
            if start is None:
                state = "unstarted"
            elif stop is not None and start > stop[0]:
                state = "refused"
            else:
                state = "finished" if done else "interrupted"
            if start is not None and round_ == 0 and not (done and ok):
                failed = finish if done else start + self.timeout
                if stop is None or failed < stop[0]:
                    self.stop.update((failed,))
            out.append((key[0], call, state, int(state in ("finished", "interrupted")), start, finish if state in ("finished", "unstarted") else None))
            self.open.removeKey((call,))
        pdf = pd.DataFrame(out, columns=["item", "call", "state", "charged", "started", "finished"])
        for c in ("started", "finished"):
            pdf[c] = pd.to_datetime(pdf[c], unit="ms")
        yield pdf

    def close(self) -> None:
        pass


def live_states(stream: DataFrame, timeout_s: int, late: str) -> DataFrame:
    """OUT for a stream of journal rows; the session must keep state in RocksDB (see `run_live`)."""
    keyed = stream.withWatermark("at", late).groupBy("item")
    return keyed.transformWithStateInPandas(Calls(timeout_s), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def run_live(stream: DataFrame, timeout_s: int, late: str, out: str, checkpoint: str) -> None:
    """Take in what is there and append the calls that are closed to `out`; a further call goes on with the state that was kept."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = live_states(stream, timeout_s, late).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)

import datetime
import random

import pytest
from pyspark.sql import functions as F

from pairlens.sources import writers
from pairlens.streaming import calls, journal

EVENTS = "k long, kind string, at timestamp"


def events(spark, n=10_000):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 977 % 4_000_000)
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id") % 3).alias("kind"), at.alias("at"))


def paths(tmp_path):
    return str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")


def test_intake_keeps_every_row_of_two_halves_and_of_many_files(spark, tmp_path):
    e = events(spark)
    log, out, cp = paths(tmp_path)
    for part in (e.where("at >= timestamp'2023-12-10'"), e.where("at < timestamp'2023-12-10' or k % 2 = 0")):
        writers.append(part.repartition(3), log)
        journal.intake(spark, log, EVENTS, ["k"], out, cp, ["kind"], files=2)
    got = journal.taken(spark, out, EVENTS)
    assert got.count() == 10_000 == got.select("k").distinct().count() and got.exceptAll(e).isEmpty()
    log, out, cp = paths(tmp_path / "many")
    writers.append(e.repartition(120), log)
    journal.intake(spark, log, EVENTS, ["k"], out, cp, files=50)
    assert journal.taken(spark, out, EVENTS).count() == 10_000 and len(journal.parts(spark, out)) == 3


def test_a_batch_that_is_killed_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    log, out, cp = paths(tmp_path)
    writers.append(events(spark, 300).repartition(2), log)
    journal.intake(spark, log, EVENTS, ["k"], out, cp)
    writers.append(events(spark, 500).repartition(2), log)
    whole = journal.remove

    def killed(spark, path):
        if path.endswith("_pending") and journal.read_text(spark, path):
            raise RuntimeError("killed behind the write, before the commit")
        whole(spark, path)

    monkeypatch.setattr(journal, "remove", killed)
    with pytest.raises(Exception, match="killed"):
        journal.intake(spark, log, EVENTS, ["k"], out, cp)
    monkeypatch.undo()
    assert journal.read_text(spark, f"{out}/_pending") == "1" and journal.taken(spark, out, EVENTS).count() == 300
    journal.intake(spark, log, EVENTS, ["k"], out, cp)
    got = journal.taken(spark, out, EVENTS)
    assert got.count() == 500 == got.select("k").distinct().count()
    journal.commit(events(spark, 500), 1, out, ["k"], [], EVENTS)
    assert journal.taken(spark, out, EVENTS).count() == 500


def test_lock_drift_and_another_checkpoint_are_refused(spark, tmp_path):
    log, out, cp = paths(tmp_path)
    writers.append(events(spark, 10), log)
    with journal.writer_lock(spark, out), pytest.raises(journal.JournalError, match="being written by"):
        journal.intake(spark, log, EVENTS, ["k"], out, cp)
    journal.intake(spark, log, EVENTS, ["k"], out, cp, ["kind"])
    with pytest.raises(journal.JournalError, match="checkpoint"):
        journal.intake(spark, log, EVENTS, ["k"], out, str(tmp_path / "cp2"), ["kind"])
    writers.append(events(spark, 3).withColumn("kind", F.lit("other")), log)
    with pytest.raises(Exception, match="differ from what was taken"):
        journal.intake(spark, log, EVENTS, ["k"], out, cp, ["kind"])
    assert journal.taken(spark, out, EVENTS).count() == 10


def test_null_keys_and_repeated_rows_in_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(None, "b", None), (None, "a", None), (1, None, None), (1, None, None)], EVENTS)
    _, out, _ = paths(tmp_path)
    for n in (0, 1):
        journal.commit(rows.repartition(3), n, out, ["k"], [], EVENTS)
    assert sorted((r.k or 0, r.kind) for r in journal.taken(spark, out, EVENTS).collect()) == [(0, "a"), (1, None)]


def test_running_summary_and_windows(spark, tmp_path):
    log, _, cp = paths(tmp_path)
    writers.append(events(spark, 90), log)
    raw = spark.readStream.schema(EVENTS).json(log).withColumn("ok", F.col("k") % 2 == 0)
    journal.run_summary(journal.summary(raw, ["kind"], "ok"), "running", cp)
    assert {(r.kind, r.n, r.rate) for r in spark.table("running").collect()} == {("t0", 30, 0.5), ("t1", 30, 0.5), ("t2", 30, 0.5)}
    journal.run_once(journal.windowed(raw, "at", ["kind"]), str(tmp_path / "w"), str(tmp_path / "cp3"))


def call_rows(seed):
    rng, rows, start = random.Random(seed), [], datetime.datetime(2024, 1, 1)
    for item in range(25):
        t = start + datetime.timedelta(seconds=item * 90)
        for k in range(rng.randint(1, 5)):
            call = item * 10 + k
            if rng.random() < 0.9:
                rows.append((item, call, k, "call_started", t, None))
            if rng.random() < 0.1:
                rows.append((item, call, k, "call_started", t + datetime.timedelta(seconds=3), None))
            if rng.random() < 0.85:
                rows.append((item, call, k, "call_finished", t + datetime.timedelta(seconds=rng.randint(0, 80)), rng.random() < 0.7))
            t += datetime.timedelta(seconds=rng.choice([0, 30, 60]))
    return sorted(rows, key=lambda r: r[4])


CALL = "item long, call long, round int, event string, at timestamp, ok boolean"


def plain_states(rows, timeout=60):
    """Calls by a walk over sorted rows."""
    first, out = {}, []
    for item, call, k, event, at, ok in sorted(rows, key=lambda r: (r[4], bool(r[5]))):
        first.setdefault((item, call), {}).setdefault(event, (at, k, ok))
    limit, stop = datetime.timedelta(seconds=timeout), {}
    for (item, _), c in first.items():
        if (s := c.get("call_started")) and s[1] == 0:
            f = c.get("call_finished")
            done = f is not None and f[0] <= s[0] + limit
            if not (done and f[2]):
                stop[item] = f[0] if done else s[0] + limit
    for (item, call), c in first.items():
        s, f = c.get("call_started"), c.get("call_finished")
        if s is None:
            out.append((item, call, "unstarted", 0))
        elif item in stop and s[0] > stop[item]:
            out.append((item, call, "refused", 0))
        else:
            out.append((item, call, "finished" if f and f[0] <= s[0] + limit else "interrupted", 1))
    return sorted(out)


def test_live_states_equal_the_table_form_over_a_restart(spark, tmp_path):
    rows = call_rows(3)
    log, out, cp = paths(tmp_path)
    half = len(rows) // 2
    want = calls.call_states(spark.createDataFrame(rows, CALL), 60)
    assert sorted(tuple(r)[:4] for r in want.collect()) == plain_states(rows) and len({r.state for r in want.collect()}) == 4
    for part in (rows[:half], [*rows[half:], (-1, -1, 0, "closed", datetime.datetime(2024, 2, 1), None)]):
        spark.createDataFrame(part, CALL).write.mode("append").json(log)
        calls.run_live(spark.readStream.schema(CALL).json(log), 60, "1 second", out, cp)
    assert sorted(map(str, spark.read.schema(calls.OUT).parquet(out).collect())) == sorted(map(str, want.collect()))


def test_states_of_no_calls(spark):
    assert calls.call_states(spark.createDataFrame([], CALL), 5).count() == 0

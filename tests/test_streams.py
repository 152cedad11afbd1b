"""Runs as streams: map state with timers, and an event log that is written and read exactly once."""

import json
import os
import tracemalloc

import pytest

from sieveline.sources import rowlog, service
from sieveline.streaming import lifecycle

EVENTS = "request_id string, seq long, event string, stage string, message string, ts timestamp"


def files(spark, folder, *batches):
    """One JSON file a batch, in order."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        text = "\n".join(json.dumps(dict(zip(("request_id", "seq", "event", "stage", "message", "ts"), r))) for r in rows)
        (folder / f"{i}.json").write_text(text + "\n")
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(folder))


def started(run, seq, hour, stage="planner", message="Plan"):
    return run, seq, "stage_started", stage, message, f"2026-01-01T{hour:02}:00:00Z"


def through(stream, name, checkpoint):
    stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def test_stages_live_on_between_batches_and_abandoned_runs_go(spark, tmp_path):
    events = files(
        spark, tmp_path / "in",
        [started("a", 1, 0), started("gone", 1, 0)],
        [("a", 2, "stage_completed", "planner", "Plan completed", "2026-01-01T00:30:00Z"), started("a", 3, 0, "searcher", "Search")],
        [("a", 4, "run_completed", None, "Search completed", "2026-01-01T00:50:00Z"), started("late", 1, 9)],
        [started("late", 2, 9, "searcher", "Search")],
    )
    got = through(lifecycle.stream_states(events, idle_ms=3_600_000, late="5 minutes"), "lives", tmp_path / "ck").collect()
    last = {r["request_id"]: r for r in got}
    assert last["a"]["finished"] and json.loads(last["a"]["stages"]) == [["planner:Plan", "completed"], ["searcher:Search", "completed"], ["run:Search", "completed"]]
    assert last["gone"]["abandoned"] and not last["gone"]["finished"] and json.loads(last["gone"]["stages"]) == [["planner:Plan", "active"]]
    assert [r["abandoned"] for r in got if r["request_id"] == "late"] == [False, False]
    # Only the run that goes on has state.
    state = spark.read.format("statestore").option("stateVarName", "stages").load(str(tmp_path / "ck"))
    assert {r["key"]["request_id"] for r in state.select("key").collect()} == {"late"}


def test_a_stream_without_times_gives_no_run_up(spark, tmp_path):
    events = files(spark, tmp_path / "in", [started("a", 1, 0)], [("a", 2, "run_failed", None, "Search failed", "2026-01-01T00:00:00Z")]).drop("ts")
    got = through(lifecycle.stream_states(events), "untimed", tmp_path / "ck").collect()
    assert [(r["finished"], r["abandoned"]) for r in got] == [(False, False), (True, False)]
    assert json.loads(got[-1]["stages"]) == [["planner:Plan", "active"], ["run:Search failed", "failed"]]


ROWS = "key string, n long, text string"


def test_a_batch_appended_twice_is_there_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1, "x\ny"), ("b", 2, "é"), ("a", 0, "first"), (None, 5, None), (None, 4, "n")], ROWS).repartition(3)
    assert [rowlog.append(rows, path, ["key"], "n") for _ in range(2)] == [3, 0]
    more = rows.unionByName(spark.createDataFrame([("c", 9, "new")], ROWS))
    assert rowlog.append(more, f"file://{path}", ["key"], "n") == 1
    assert sorted(map(tuple, rowlog.stored(spark, path, ROWS).collect()), key=str) == [("a", 0, "first"), ("b", 2, "é"), ("c", 9, "new"), (None, 4, "n")]
    assert rowlog.stored(spark, path, ROWS, upto=1).count() == 3
    assert rowlog.append(rows.limit(0), path, ["key"], "n") == 0 and rowlog.stored(spark, str(tmp_path / "none"), ROWS).count() == 0
    with pytest.raises(Exception, match="is taken"):
        rows.write.format("row_log").mode("append").option("path", path).option("base", 0).save()
    assert rowlog.stored(spark, path, ROWS).count() == 4


def test_attempts_that_failed_leave_nothing(spark, tmp_path):
    """The first attempt's file is written, its task fails, and a second one succeeds: as Spark does, with local[4,2]."""
    folder, columns = rowlog._Folder(str(tmp_path / "log")), ["key", "n"]
    writer = rowlog._Writer({"path": str(tmp_path / "log")}, columns)
    writer.write(iter([{"key": "a", "n": 1}]))  # lost: its message never comes
    writer.commit([writer.write(iter([{"key": "a", "n": 1}])), writer.write(iter([]))])
    assert rowlog.stored(spark, str(tmp_path / "log"), ROWS).select("key", "n").collect() == [("a", 1)]
    lost = writer.write(iter([{"key": "b", "n": 2}]))
    writer.abort([lost, None])
    with pytest.raises(FileNotFoundError):
        folder.read("files", lost.file)
    assert folder.next == 1


def test_a_stream_into_and_out_of_the_log(spark, tmp_path):
    events = "request_id string, seq long, event string, stage string, message string"
    path, out = str(tmp_path / "log"), str(tmp_path / "copy")
    batch = lambda *rows: rowlog.append(spark.createDataFrame(rows, events), path, ["request_id", "seq"], "seq")

    def through_to_copy():
        query = rowlog.stream(spark, path, events).writeStream.format("row_log").option("path", out).option("name", "copy").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()

    batch(("a", 1, "run_started", None, "Started search"), ("a", 2, "stage_started", "planner", "Plan"))
    through_to_copy()
    batch(("a", 2, "stage_started", "planner", "Plan"), ("a", 3, "run_completed", None, "Search completed"))
    through_to_copy()
    through_to_copy()
    copied = rowlog.stored(spark, out, events)
    assert [r["seq"] for r in copied.orderBy("seq").collect()] == [1, 2, 3]
    assert {r["status"] for r in lifecycle.stage_states(copied).collect()} == {"completed"}
    # A batch that was committed before the stream knew is not committed again.
    writer = rowlog._Writer({"path": out, "name": "copy"}, ["request_id", "seq"])
    writer.commit([writer.write(iter([{"request_id": "a", "seq": 3}]))], 1)
    assert rowlog.stored(spark, out, events).count() == 3


def test_a_table_of_requests_is_asked(spark):
    asked = spark.createDataFrame([(i, "bad" if i % 10 == 3 else f"q{i}", None) for i in range(50)], "place long, q string, nothing string")
    got = service.ask_all(asked, "tests.replayed_answers:answer", ["place"], tasks=3, at_once=2, attempts=3, title="T").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(50))
    assert all((r["payload"], r["error"], r["attempts"]) == (None, "TimeoutError: slow", 3) if r["place"] % 10 == 3 else f"/q{r['place']}" in r["payload"] and r["attempts"] == 1 and r["error"] is None for r in got)
    assert service.ask_all(asked.limit(0), "tests.replayed_answers:answer", ["place", "q"], title="T").count() == 0


def test_row_log_holds_a_row_at_a_time(tmp_path):
    folder, columns, rows = rowlog._Folder(str(tmp_path / "log")), ["key", "n"], 50_000
    tracemalloc.start()
    try:
        written = rowlog._write(folder, ({"key": "é " * 20, "n": i} for i in range(rows)), columns)
        assert sum(n for _, n in rowlog._read(folder, written.file, columns)) == rows * (rows - 1) // 2
        assert tracemalloc.get_traced_memory()[1] < 4_000_000  # the file has 15 MB
    finally:
        tracemalloc.stop()
    assert rowlog._write(folder, iter(()), columns).file is None and list(rowlog._read(folder, None, columns)) == []

"""A run's events: what it emits, how errors are reported, and the stages as a client shows them, in batch and as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.fixed import RUN_FAILED

#: A stage's name for the client: its stage, and its message without the ending.
_ID = "concat(coalesce(stage, 'run'), ':', regexp_replace(message, ' completed$', ''))"


def run_events(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """(request_id, seq, event, stage, message, code, error, details) of finished runs, in the order a run emits them.

    runs(request_id, error_kind, error_message): kind null where the run ended well. stages(request_id, place, stage,
    message, completed): each is started and, where it was, completed. A value error is an invalid query of the planner with
    its own message; any other is internal, with a fixed message and its own in the details.
    """
    none = F.lit(None).cast("string")
    value = F.col("error_kind") == "value_error"
    begun = runs.select("request_id", F.lit(-1).alias("place"), F.lit(0).alias("part"), F.lit("run_started").alias("event"), none.alias("stage"), F.lit("Started search").alias("message"), none.alias("code"), none.alias("error"), none.alias("details"))
    step = lambda part, event, message, df: df.select("request_id", "place", F.lit(part).alias("part"), F.lit(event).alias("event"), "stage", message.alias("message"), none.alias("code"), none.alias("error"), none.alias("details"))
    end = runs.select(
        "request_id", F.lit(1 << 30).alias("place"), F.lit(2).alias("part"), F.when(F.col("error_kind").isNull(), "run_completed").otherwise("run_failed").alias("event"),
        F.when(value, "planner").alias("stage"), F.when(F.col("error_kind").isNull(), "Search completed").otherwise("Search failed").alias("message"),
        F.when(value, "invalid_query").when(F.col("error_kind").isNotNull(), "internal_error").alias("code"),
        F.when(value, F.col("error_message")).when(F.col("error_kind").isNotNull(), RUN_FAILED).alias("error"), F.when(F.col("error_kind").isNotNull() & ~value, F.col("error_message")).alias("details"))
    rows = begun.unionByName(step(0, "stage_started", F.col("message"), stages)).unionByName(step(1, "stage_completed", F.concat("message", F.lit(" completed")), stages.where("completed"))).unionByName(end)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("request_id").orderBy("place", "part"))).drop("place", "part")


def stage_states(events: DataFrame) -> DataFrame:
    """(request_id, id, first_seq, status): every stage a client shows, once all events are in.

    A stage is as its last own event says: started, completed or failed; one that is active when another begins is
    completed, and the end of a good run completes all but failed ones. A run's start and end are stages of their own.
    """
    kind = F.when(F.col("event").isin("run_started", "stage_started", "repair_started"), "active").when(F.col("event").isin("stage_completed", "run_completed"), "completed").otherwise("failed")
    e = events.select("request_id", "seq", F.expr(_ID).alias("id"), kind.alias("status"), (F.col("event") == "run_completed").alias("done"))
    run = e.groupBy("request_id").agg(F.max(F.when(F.col("status") == "active", F.col("seq"))).alias("last_start"), F.bool_or("done").alias("good"))
    own = e.groupBy("request_id", "id").agg(F.min("seq").alias("first_seq"), F.max_by(F.struct("seq", "status"), "seq").alias("l")).join(run, "request_id")
    over = (F.col("l.status") == "active") & (F.col("good") | (F.col("l.seq") < F.col("last_start")))
    return own.select("request_id", "id", "first_seq", F.when(over, "completed").otherwise(F.col("l.status")).alias("status"))


def _reduce(stages: list[list[str]], event: str, name: str) -> list[list[str]]:
    """The stages [id, status] after one event."""
    status = "active" if event in ("run_started", "stage_started", "repair_started") else "completed" if event in ("stage_completed", "run_completed") else "failed"
    out = [[i, status if i == name else "completed" if status == s == "active" else s] for i, s in stages]
    out += [] if any(i == name for i, _ in out) else [[name, status]]
    return [[i, s if s == "failed" else "completed"] for i, s in out] if event == "run_completed" else out


class StageProcessor(StatefulProcessor):
    """A run's stages as map state, id -> (place, status), and a timer that ends runs of which nothing is heard any more."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms  # None: no timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.stages = handle, handle.getMapState("stages", "id string", "place int, status string")

    def _now(self) -> list[list[str]]:
        rows = sorted((place, name, status) for (name,), (place, status) in self.stages.iterator())
        return [[name, status] for _, name, status in rows]

    def _stop_timers(self) -> None:
        for timer in list(self.handle.listTimers()) if self.idle_ms is not None else []:
            self.handle.deleteTimer(timer)

    def _row(self, key: tuple, stages: list[list[str]], finished: bool, abandoned: bool) -> pd.DataFrame:
        return pd.DataFrame({"request_id": [key[0]], "stages": [json.dumps(stages)], "finished": [finished], "abandoned": [abandoned]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before, last, finished = self._now(), 0, False
        stages = before
        for r in sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: r["seq"]):
            stages, finished = _reduce(stages, r["event"], r["id"]), finished or r["event"] in ("run_completed", "run_failed")
            last = max(last, int(r["at"]))
        self._stop_timers()
        if finished:
            self.stages.clear()
        else:
            old = dict(map(tuple, before))
            for place, (name, status) in enumerate(stages):
                if old.get(name) != status:
                    self.stages.updateValue((name,), (place, status))
            if self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, stages, finished, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        stages = self._now()
        self.stages.clear()
        yield self._row(key, stages, False, True)

    def close(self) -> None:
        pass


def stream_states(events: DataFrame, idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """The same from a stream of events(request_id, seq, event, stage, message[, ts]): (request_id, stages JSON, finished,
    abandoned) of each run whenever a batch has events of it, and once more when it is given up.

    A run's state is a map of its stages, of which a batch writes the changed ones. It goes when the run has ended, or when
    nothing was heard for `idle_ms` by the events' ts and their watermark; events without ts give no run up. A run heard of
    again later begins anew. Needs Spark's RocksDB state store, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = "ts" in events.columns
    rows = events.withWatermark("ts", late) if timed else events
    at = F.unix_millis("ts") if timed else F.lit(0).cast("long")
    rows = rows.select("request_id", "seq", "event", F.expr(_ID).alias("id"), at.alias("at"), *(["ts"] if timed else []))
    return rows.groupBy("request_id").transformWithStateInPandas(StageProcessor(idle_ms if timed else None), "request_id string, stages string, finished boolean, abandoned boolean", "Update", "EventTime" if timed else "None")


def stage_rows(figures: DataFrame, place: dict[str, int]) -> DataFrame:
    """Stages of runs for run_events() from the figures they showed: each stage once, in the order of `place`, completed."""
    order = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    return figures.select("request_id", "stage").distinct().select("request_id", F.try_element_at(order, F.col("stage")).alias("place"), "stage", F.concat(F.lit("Running "), "stage").alias("message"), F.lit(True).alias("completed"))


def replay(events: DataFrame, rate: DataFrame) -> DataFrame:
    """Finished runs' events as a stream that emits the n-th events of all runs at the rate's n-th value; for trials."""
    return rate.select((F.col("value") + 1).alias("seq")).join(events, "seq")

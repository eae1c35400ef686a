"""Rules on live samples that arrive out of order, with clips that end.

Samples of a clip wait in state, in event-time order, until they are older than
the clip's newest sample by more than ``late``; then the rule sees them.  What
arrives older than that is not lost silently: it comes out as a row of kind
``late``.  A clip ends when the watermark has passed its newest sample by
``idle``: the rule sees what still waits, gives the alarm that the batch rule
gives at the end of a clip, and all state of the clip is removed.

State of a clip is a few numbers and the samples of the last ``late`` seconds.
Queries have to start with ``rocksdb``, as ``run_to_the_end`` does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .run import shared_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "kind string, value double, fired_at double, ts timestamp"


class OnsetRule:
    """N hits in the last M samples: the time of the first of them."""

    def __init__(self, n: int, m: int):
        self.n, self.m = n, m

    def fresh(self) -> dict:
        return {"seen": 0, "hits": []}

    def step(self, s: dict, rows: Sequence[tuple]) -> tuple[float, float] | None:
        for _, t, hit in rows:
            s["seen"] += 1
            if not hit:
                continue
            # hits that can still share a frame with this one
            s["hits"] = [h for h in s["hits"] if h[0] > s["seen"] - self.m] + [[s["seen"], t]]
            if len(s["hits"]) >= self.n:
                return s["hits"][0][1], t
        return None

    def finish(self, s: dict) -> tuple[float, float] | None:
        return None


class StayRule:
    """Entrants (``gap=0``) or loiterers: the last detection once ``settle_s`` seconds brought no new one, or the clip ended."""

    def __init__(self, need: int, gap: int, settle_s: float, delay: float = 0.0, value: str = "at"):
        self.need, self.gap, self.settle_s, self.delay, self.value = need, gap, settle_s, delay, value

    def fresh(self) -> dict:
        return {"seen": 0, "runs": {}, "found": [], "latest": None, "last_new": None, "t": None}

    def step(self, s: dict, rows: Sequence[tuple]) -> tuple[float, float] | None:
        i = 0
        while i < len(rows):
            t = s["t"] = rows[i][1]
            s["seen"] += 1
            while i < len(rows) and rows[i][1] == t:
                _, _, track, qualified = rows[i]
                if qualified:
                    self._seen(s, str(track), t)
                i += 1
            if s["latest"] is not None and t - s["last_new"] >= self.settle_s:
                return s["latest"] + self.delay, t
        # runs that cannot go on are forgotten
        s["runs"] = {k: r for k, r in s["runs"].items() if s["seen"] - r[2] <= self.gap + 1}
        return None

    def _seen(self, s: dict, name: str, t: float) -> None:
        n, since, at = s["runs"].get(name, (0, t, s["seen"]))
        if s["seen"] - at - 1 > self.gap:
            n, since = 0, t
        s["runs"][name] = (n + 1, since, s["seen"])
        if n + 1 >= self.need and name not in s["found"]:
            s["found"].append(name)
            v = t if self.value == "at" else since
            s["latest"] = v if s["latest"] is None else max(s["latest"], v)
            s["last_new"] = t

    def finish(self, s: dict) -> tuple[float, float] | None:
        return None if s["latest"] is None else (s["latest"] + self.delay, s["t"])


def _same(v):
    return v


def _whole(v):
    return None if v is None or v != v else int(v)


class _Ordered(StatefulProcessor):
    def __init__(self, rule, columns: dict[str, str], key: str, late_us: int, idle_us: int):
        self.rule, self.columns, self.kinds, self.key, self.late_us, self.idle_us = rule, list(columns), list(columns.values()), key, late_us, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, as each call to the state store is a message to the JVM and back
        self.handle = handle
        self.clip = handle.getValueState("clip", "high bigint, bound bigint, done boolean, state string, waiting string")

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        kinds, values, fired, us = zip(*rows)
        ts = np.array([np.datetime64("NaT") if u is None else np.datetime64(u, "us") for u in us], "datetime64[ns]")
        return pd.DataFrame({
            self.key: [key[0]] * len(rows), "kind": list(kinds), "value": np.array(values, "float64"), "fired_at": np.array(fired, "float64"), "ts": ts,
        })

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            for _ in rows:
                pass
            return
        # whole numbers that pandas holds as floats, where a sample has none, are whole again
        plain = [_whole if kind == "bigint" else _same for kind in ("bigint", *self.kinds)]
        names = ["us", *self.columns]
        new = [r for frame in rows for r in zip(*[map(f, frame[c].tolist()) for f, c in zip(plain, names)])]
        kept = self.clip.get()
        high, bound, done, state, waiting = (None, None, False, json.dumps(self.rule.fresh()), "[]") if kept is None else kept
        out = [("late", None, None, r[0]) for r in new if bound is not None and r[0] < bound]
        new = [r for r in new if bound is None or r[0] >= bound]
        if new:
            newest = max(r[0] for r in new)
            if high is None:
                # a clip has one timer, which is set anew when it goes off and the clip has gone on
                self.handle.registerTimer((newest + self.idle_us) // 1000)
            high = newest if high is None else max(high, newest)
            bound = high - self.late_us if bound is None else max(bound, high - self.late_us)
            held = [*map(tuple, json.loads(waiting)), *new]
            ready = sorted((r for r in held if r[0] < bound), key=lambda r: r[0])
            rest = [r for r in held if r[0] >= bound]
            if not done and ready:
                s = json.loads(state)
                alarm = self.rule.step(s, ready)
                done, state = alarm is not None, "{}" if alarm is not None else json.dumps(s)
                if alarm is not None:
                    out.append(("alarm", *alarm, None))
            self.clip.update((high, bound, done, state, json.dumps(rest)))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        high, _, done, state, waiting = self.clip.get()
        ends = (high + self.idle_us) // 1000
        if ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
            return
        if not done:
            s = json.loads(state)
            ready = sorted(map(tuple, json.loads(waiting)), key=lambda r: r[0])
            alarm = self.rule.step(s, ready) or self.rule.finish(s)
            if alarm is not None:
                yield self._rows(key, [("alarm", *alarm, None)])
        self.clip.clear()

    def close(self) -> None:
        pass


def _ordered(
    samples: DataFrame, rule, columns: dict[str, str], late_s: float, idle_s: float, horizon_s: float | None, key: str, ts: str
) -> DataFrame:
    """``clip, kind, value, fired_at, ts``: alarms, and rows that came too late.

    Rows older than the newest of all clips by ``horizon_s`` (``late_s`` and
    ``idle_s`` together, if not given) are dropped and counted by Spark.
    """
    kind = samples.schema[key].dataType.simpleString()
    horizon = late_s + idle_s if horizon_s is None else horizon_s
    held = samples.select(key, ts, F.unix_micros(ts).alias("us"), *columns).withWatermark(ts, f"{int(horizon * 1000)} milliseconds")
    processor = _Ordered(rule, columns, key, int(late_s * 1e6), int(idle_s * 1e6))
    return held.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {OUT}", "Append", "EventTime")


def live_onsets(
    samples: DataFrame, n: int, m: int, late_s: float, idle_s: float, horizon_s: float | None = None, key: str = "clip", ts: str = "ts"
) -> DataFrame:
    """N-of-M onsets from ``clip, ts, t, hit``; an alarm has the onset as ``value``."""
    return _ordered(samples, OnsetRule(n, m), {"t": "double", "hit": "boolean"}, late_s, idle_s, horizon_s, key, ts)


def live_stays(
    boxes: DataFrame, need: int, gap: int, settle_s: float, late_s: float, idle_s: float, delay: float = 0.0, value: str = "at",
    horizon_s: float | None = None, key: str = "clip", ts: str = "ts",
) -> DataFrame:
    """Alarms of entrants (``gap=0``) or loiterers from ``clip, ts, t, track, qualified``.

    One row per box; a sample without boxes has one row with a NULL track, as time must pass.
    """
    columns = {"t": "double", "track": "bigint", "qualified": "boolean"}
    return _ordered(boxes, StayRule(need, gap, settle_s, delay, value), columns, late_s, idle_s, horizon_s, key, ts)


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store that timers and lists in state need, for queries started inside; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_the_end(build: Callable[[DataFrame], DataFrame], stream: DataFrame | None = None, arrivals: Sequence[DataFrame] = (), ts: str = "ts"):
    """Runs a rule over all there is, then ends every clip; returns the rows and the last query.

    Input is a stream, or tables that arrive one after the other.  Each arrival
    is a run of its own from the same checkpoint.  Clips end when time goes on
    without them: after the last arrival a row without a clip, far ahead of all
    others, takes time there.
    """
    spark = (stream if stream is not None else arrivals[0]).sparkSession
    schema = (stream if stream is not None else arrivals[0]).schema
    folder = shared_folder(spark)
    spark.createDataFrame([], schema).write.parquet(f"{folder}/in")
    more = spark.readStream.schema(schema).parquet(f"{folder}/in")
    rows = build(more if stream is None else stream.unionByName(more))
    nothing = [F.expr("timestamp'2200-01-01'").alias(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    query = None
    for arrival in [*(arrivals if stream is None else [None]), spark.range(1).select(*nothing)]:
        if arrival is not None:
            arrival.write.mode("append").parquet(f"{folder}/in")
        writer = rows.writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", f"{folder}/state")
        with rocksdb(spark):
            query = writer.format("parquet").option("path", f"{folder}/out").start()
            query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out"), query

"""Stateful as-of lookup of two streams: updates and the requests that ask for them.

Both sides arrive as streams.  State is kept of every key (a flight, or an airport
and slot): the latest update of every effective time, and the requests not yet
answered.  Keys are bundled by their hash, and a bundle has one state, one timer
and one call a batch, as a call for every key would take longer than its rows.  The updates' event time is the clock.  A request for time ``t`` is
answered once the watermark has reached ``t``, when no update issued up to then
can still come in; an event-time timer wakes the bundle for it.  Updates older than the
visible history are dropped from the state, and a bundle without updates and
requests is removed by its last timer.

Late rows have a fixed fate.

* An update issued at or before the watermark is not used (Spark counts it in
  ``numRowsDroppedByWatermark`` where it drops it first).
* A request whose time the watermark has passed is answered at once from what
  the state still holds, and marked ``late``.  Requests never move the clock,
  so none is dropped.
* A row of the update feed with an empty key and its time is a heartbeat: it
  moves the clock when there is nothing else to tell.

Progress, state and timers live in the checkpoint, so a query that is started
again goes on where it stopped, and its file sink holds every answer once.
Each micro-batch reduces repeated updates and requests before the shuffle, so
a hot key sends one row an effective time and Arrow batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gatecast.functions.timeops import US_PER_MINUTE, add_us, ceil_slot, epoch_us
from gatecast.operators.asof import DEP
from gatecast.operators.weather import WEATHER_OUT, _slotted
from gatecast.schemas import ETD_SCHEMA, LAMP_SCHEMA, LABELS_SCHEMA, VISIBLE_HISTORY_HOURS
from gatecast.session import fresh_dir

UPDATE, REQUEST, HEARTBEAT = 0, 1, 2
HOUR_US = 60 * US_PER_MINUTE
NOTHING = -(1 << 63)  # the issue time of no update
BUNDLES = 1024  # groups of keys; each has one state
STATE = "told array<string>, at array<bigint>, issue array<bigint>, value array<string>, asker array<string>, asked array<bigint>, rows array<bigint>"
WHOLE_PERIOD = 1_000_000  # files a trigger: all that a replayed period has


def _order(value: str) -> list:
    """Sort key of a payload: its fields in order, null first."""
    return [(v is not None, v if v is not None else 0) for v in json.loads(value).values()]


def _fresher(a: tuple[int, str], b: tuple[int, str]) -> bool:
    """Whether update ``a`` (issue time, payload) beats ``b`` of the same effective time."""
    return a[0] > b[0] if a[0] != b[0] else _order(a[1]) > _order(b[1])


def answer(known: dict[int, tuple[int, str]], at: int, visible_us: int) -> tuple[int, str] | None:
    """The update with the greatest effective time up to ``at``, if it was issued less than ``visible_us`` before."""
    best = max((k for k in known if k <= at), default=None)
    if best is None or known[best][0] <= at - visible_us:
        return None
    return known[best]


def _step(visible_us: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = state.getCurrentWatermarkMs() * 1000
        known: dict[str, dict[int, tuple[int, str]]] = {}
        asked: dict[tuple[str, int], int] = {}
        if state.exists:
            told, at, issue, value, asker, times, rows = state.get
            for k, a, i, v in zip(told, at, issue, value):
                known.setdefault(k, {})[a] = (i, v)
            asked = dict(zip(zip(asker, times), rows))
        late: dict[tuple[str, int], int] = {}
        if not state.hasTimedOut:
            for frame in frames:
                for kind, k, at, issue, value, n in zip(*(frame[c].tolist() for c in ("kind", "key", "at", "issue", "value", "n"))):
                    if kind == UPDATE and issue > clock:
                        own = known.setdefault(k, {})
                        if at not in own or _fresher((issue, value), own[at]):
                            own[at] = (issue, value)
                    elif kind == REQUEST:
                        due = late if at < clock else asked
                        due[k, at] = due.get((k, at), 0) + n
        ready = {ask: n for ask, n in asked.items() if ask[1] <= clock}
        out = []
        for answers, is_late in ((ready, False), (late, True)):
            for (k, at), n in answers.items():
                out.append((k, at, n, *(answer(known.get(k, {}), at, visible_us) or (NOTHING, "")), is_late))
        asked = {ask: n for ask, n in asked.items() if ask[1] > clock}
        held = [(k, at, *v) for k, own in known.items() for at, v in own.items() if v[0] > clock - visible_us]
        if held or asked:
            told, at, issue, value = map(list, zip(*held)) if held else ([], [], [], [])
            state.update((told, at, issue, value, [k for k, _ in asked], [t for _, t in asked], [*asked.values()]))
            wake = min([*(t for _, t in asked), max(issue) + visible_us] if held else (t for _, t in asked))
            state.setTimeoutTimestamp(max(wake, clock) // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "n", "issue", "value", "late"])

    return run


def _reduced(rows: DataFrame) -> DataFrame:
    """Within each Arrow batch: the freshest updates of an effective time, requests counted."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asks = frame["kind"] == REQUEST
            updates = frame[~asks]
            if len(updates):
                yield updates[updates["issue"] == updates.groupby(["key", "kind", "at"], dropna=False)["issue"].transform("max")]
            if asks.any():
                yield frame[asks].groupby(["key", "kind", "at", "issue"], dropna=False, as_index=False).agg(
                    {"n": "sum", "value": "first"})[frame.columns]

    return rows.mapInPandas(run, rows.schema)


def lookup_stream(updates: DataFrame, requests: DataFrame, keys: list[str], visible_us: int, delay: str,
                  bundles: int = BUNDLES) -> DataFrame:
    """Streaming answers: ``keys``, ``at``, ``n``, ``issue``, ``value`` and ``late``.

    ``updates`` has ``keys``, ``at`` (microseconds from which the update
    counts), ``issue`` (its event time, microseconds) and ``value`` (JSON); a row
    with an empty first key is a heartbeat.  ``requests`` has ``keys`` and
    ``at``; equal requests of a batch become one answer with their number
    ``n``.  No key or time may be null.  An update may arrive ``delay`` behind the clock.
    ``bundles`` is fixed by the checkpoint: take more where a bundle's visible history would not fit a task.
    """
    names = ["key", "kind", "at", "issue", "value", "n"]
    key = _json(*keys).alias("key")
    kind = F.when(F.col(keys[0]) == "", F.lit(HEARTBEAT)).otherwise(F.lit(UPDATE))
    told = _reduced(updates.select(key, kind.alias("kind"), "at", "issue", "value", F.lit(1).cast("long").alias("n")).select(*names))
    told = told.withColumn("clock", F.timestamp_micros("issue")).withWatermark("clock", delay)
    asks = requests.select(key, F.lit(REQUEST).alias("kind"), "at", F.col("at").alias("issue"), F.lit("").alias("value"),
                           F.lit(1).cast("long").alias("n"))
    # no event time: requests neither move the clock nor fall behind it
    asks = _reduced(asks).withColumn("clock", F.lit(None).cast("timestamp"))
    both = told.unionByName(asks).withColumn("bundle", F.pmod(F.xxhash64("key"), F.lit(bundles)))
    found = both.groupBy("bundle").applyInPandasWithState(
        _step(visible_us), "key string, at bigint, n bigint, issue bigint, value string, late boolean", STATE, "append",
        GroupStateTimeout.EventTimeTimeout)
    some = F.col("issue") != NOTHING
    parsed = F.from_json("key", ", ".join(f"{k} {updates.schema[k].dataType.simpleString()}" for k in keys))
    return found.withColumn("key", parsed).select("key.*", "at", "n", F.when(some, F.col("issue")).alias("issue"),
                                                  F.when(some, F.col("value")).alias("value"), "late")


def _json(*columns) -> F.Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _time(us: str) -> F.Column:
    return F.when(F.col(us).isNotNull(), add_us(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(us)))


def estimate_stream(updates: DataFrame, requests: DataFrame, delay: str = "1 hour",
                    visible_hours: int = VISIBLE_HISTORY_HOURS, bundles: int = BUNDLES) -> DataFrame:
    """J6 + T2 over streams of estimate updates and requests.

    A row per distinct request and batch: ``gufi, timestamp, airport, rows,
    update_timestamp,`` estimate and ``late``.  An update counts from the
    quarter-hour at or after its issue.
    """
    told = updates.select("gufi", "airport", epoch_us(ceil_slot("timestamp")).alias("at"), epoch_us("timestamp").alias("issue"),
                          _json(epoch_us(DEP).alias("estimate")).alias("value"))
    asks = requests.select("gufi", "airport", epoch_us("timestamp").alias("at"))
    found = lookup_stream(told, asks, ["gufi", "airport"], visible_hours * HOUR_US, delay, bundles)
    parsed = found.withColumn("estimate", F.from_json("value", "estimate bigint")["estimate"])
    return parsed.select("gufi", _time("at").alias("timestamp"), "airport", F.col("n").alias("rows"),
                         _time("issue").alias("update_timestamp"), _time("estimate").alias(DEP), "late")


def weather_stream(forecasts: DataFrame, requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """J7 over streams of forecasts and requests: a row per distinct (airport, timestamp) and batch, with its freshest forecast.

    Keys are (airport, served slot), so a busy airport spreads over many bundles.
    """
    weather = {f.name: f.dataType for f in LAMP_SCHEMA.fields if f.name in WEATHER_OUT}
    cells = [epoch_us(c).alias(c) if c == "forecast_timestamp" else F.col(c) for c in WEATHER_OUT]
    served = _slotted(forecasts).select("airport", epoch_us("slot").alias("slot"), epoch_us("issue_timestamp").alias("at"),
                                        epoch_us("issue_timestamp").alias("issue"), _json(*cells).alias("value"))
    # a heartbeat has no lead of 30 minutes, so it serves no slot
    beats = forecasts.where("airport = ''").select("airport", F.lit(0).cast("long").alias("slot"), epoch_us("timestamp").alias("at"),
                                                   epoch_us("timestamp").alias("issue"), F.lit("{}").alias("value"))
    asks = requests.select("airport", epoch_us("timestamp").alias("slot"), epoch_us("timestamp").alias("at"))
    found = lookup_stream(served.where("airport <> ''").unionByName(beats), asks, ["airport", "slot"], 2 * HOUR_US, delay)
    parsed = F.from_json("value", ", ".join(f"{c} {'bigint' if c == 'forecast_timestamp' else t.simpleString()}" for c, t in weather.items()))
    out = found.withColumn("w", parsed).select("*", "w.*")
    return out.select("airport", _time("at").alias("timestamp"), F.col("n").alias("rows"), _time("issue").alias("issue_timestamp"),
                      *[_time(c).alias(c) if c == "forecast_timestamp" else F.col(c) for c in WEATHER_OUT], "late")


FEEDS = {"updates": ETD_SCHEMA, "forecasts": LAMP_SCHEMA, "requests": LABELS_SCHEMA}


def read_feed(spark: SparkSession, path: str, feed: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(FEEDS[feed]).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_to_feed(rows: DataFrame, path: str, feed: str, whole: bool = True) -> None:
    """One more file of a feed, or (not ``whole``) as many as the rows have partitions."""
    rows = rows.select(*FEEDS[feed].names)
    (rows.coalesce(1) if whole else rows).write.mode("append").parquet(path)


def heartbeat(spark: SparkSession, path: str, feed: str, at_us: int) -> None:
    """Tell a feed's readers that the time is ``at_us``."""
    def cell(f: T.StructField) -> F.Column:
        return _time("at") if f.name == "timestamp" else F.lit("") if f.name in ("airport", "gufi") else F.lit(None)

    row = spark.range(1).select(F.lit(at_us).alias("at")).select(*[cell(f).cast(f.dataType).alias(f.name) for f in FEEDS[feed].fields])
    append_to_feed(row, path, feed)


def start(answers: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True):
    """Write streaming answers to a parquet folder; returns the query."""
    w = answers.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def finish(query):
    """Wait for a query that works off all that has arrived; raises what stopped it."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def run_available(answers: DataFrame, out_dir: str, checkpoint: str):
    return finish(start(answers, out_dir, checkpoint))


def replay(spark: SparkSession, updates: DataFrame, requests: DataFrame, feed: str, answers, periods: int = 3, run=None) -> DataFrame:
    """Feed tables to ``answers(updates stream, requests stream)`` period by period; the sink's rows.

    Each period's files are worked off by a newly started query on the same
    checkpoint.  A final heartbeat lets every request come due and every state end.
    Only the times of the first and last row come to the driver.  ``run(updates stream, requests stream, folder,
    checkpoint)`` may start another query than the plain sink.
    """
    run = run or (lambda u, r, out, checkpoint: run_available(answers(u, r), out, checkpoint))
    times = updates.select(epoch_us("timestamp").alias("t")).union(requests.select(epoch_us("timestamp").alias("t")))
    lo, hi = times.agg(F.min("t"), F.max("t")).first()
    dirs = {name: fresh_dir(spark, f"feed-{name}") for name in (feed, "requests", "answers", "checkpoint")}
    if lo is None:
        lo = hi = 0
    step = (hi - lo) // periods + 1
    for k in range(periods):
        within = epoch_us("timestamp").between(lo + k * step, lo + (k + 1) * step - 1)
        append_to_feed(updates.where(within), dirs[feed], feed, whole=False)
        append_to_feed(requests.where(within), dirs["requests"], "requests", whole=False)
        if k == periods - 1:
            heartbeat(spark, dirs[feed], feed, hi + 3 * VISIBLE_HISTORY_HOURS * HOUR_US)
        # one batch a period, however many files it has: a second one would find its updates late
        run(read_feed(spark, dirs[feed], feed, WHOLE_PERIOD), read_feed(spark, dirs["requests"], "requests", WHOLE_PERIOD),
            dirs["answers"], dirs["checkpoint"])
    return spark.read.parquet(dirs["answers"])

"""Structured Streaming jobs. Windows and sessions are built-in operators; rules that judge a key's rows one after the other
keep state of their own. Every job takes and gives a streaming DataFrame.

Rules judge rows in event time: a row is held until the watermark has passed it, when no earlier one can come any more, and
then judged after all that are before it. So neither the order of files nor where a trigger ends changes a result. Held rows
are in the state store (RocksDB, on disk), by groups of keys and runs of time, and come back a run at a time. The last rows of
a stream wait for a later event or the end mark that its source sends. A key's rows are one task's work, as the rules ask for."""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerlake.sources.shared import stored

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of the shortest run of held rows, and the rows that a run has on average at least.
SLICE, RUN = 3600, 200
#: Keys are dealt to so many groups by hash, whose state is kept together. A checkpoint holds for one number only.
GROUPS = 1024
#: One state column for rules whose state is a small Python value.
STATE = "held binary"


def _kept(state: GroupState, fresh):
    return pickle.loads(state.get[0]) if state.exists else fresh


def _keep(state: GroupState, value) -> None:
    state.update((pickle.dumps(value),))


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files (or one file) as a stream, with the schema of what is there; event times carry a zone."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    stream = reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may match a file or a folder
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now and read what it wrote. Append goes to files, exactly once; the last state
    of the other modes goes to a table that each batch replaces."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    # A query takes the settings of its start with it; the session's own come back.
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        running = writer.start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def tumbling_counts(events: DataFrame, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"))


class Rule:
    """Judges one key's rows in order. state: any small value that pickle takes, fresh() at first."""

    def fresh(self):
        raise NotImplementedError

    def step(self, state, micros: int, row: tuple) -> tuple[object, list[tuple]]:
        """The next state, and what the row gives."""
        raise NotImplementedError


class _InOrder(StatefulProcessor):
    """Holds rows (micros, key, columns) of a group of keys, in runs of time, until the watermark has passed them. A run is as
    long as it takes to have some rows, so what is asked of the state store grows with the rows by far less than one a row."""

    def __init__(self, rule: Rule, key: str, columns: Sequence[str], out: Sequence[str], slice_seconds: int):
        self.rule, self.columns, self.out, self.width = rule, ["micros", key, *columns], list(out), slice_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "start long, number long", "rows binary")
        self.states = handle.getValueState("states", "value binary")
        #: How many runs there were, and the one timer that is set (0: none).
        self.progress = handle.getValueState("progress", "runs long, timer long")

    def _runs(self, rows: list[tuple]) -> dict[int, list[tuple]]:
        """Rows by the start of their run."""
        width = self.width
        while True:
            runs: dict[int, list[tuple]] = {}
            for row in rows:
                runs.setdefault(row[0] // width * width, []).append(row)
            if len(runs) <= 2 or len(rows) >= RUN * len(runs):
                return runs
            width *= 6

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, timer = self.progress.get() if self.progress.exists() else (0, 0)
        first = None
        for batch in rows:
            columns = [batch[c].tolist() if c == "micros" else batch[c].astype(object).where(batch[c].notna(), None).tolist() for c in self.columns]
            for start, run in self._runs(list(zip(*columns))).items():
                number += 1
                self.held.updateValue((start, number), (pickle.dumps(run),))
                low = min(r[0] for r in run)
                first = low if first is None else min(first, low)
        if first is not None:
            self.progress.update((number, self._timer(timer, first)))
        return iter(())

    def _timer(self, timer: int, micros: int) -> int:
        """The timer that is set once a row of that time waits."""
        wanted = micros // 1000 + 1
        if timer and timer <= wanted:
            return timer
        if timer:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(wanted)
        return wanted

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        starts: dict[int, list[tuple]] = {}
        for at in self.held.keys():
            starts.setdefault(at[0], []).append(tuple(at))
        order = sorted(starts)
        passed = [start for start in order if start < watermark]
        first = order[len(passed)] if len(passed) < len(order) else None
        states = pickle.loads(self.states.get()[0]) if self.states.exists() else {}
        waiting: list[tuple] = []
        given: list[tuple] = []
        changed = False
        for i, start in enumerate(passed):
            # Rows of runs that start later are none of those before that start.
            until = passed[i + 1] if i + 1 < len(passed) else watermark
            for at in starts[start]:
                rows = pickle.loads(self.held.getValue(at)[0])
                due, rest = [r for r in rows if r[0] < watermark], [r for r in rows if r[0] >= watermark]
                waiting += due
                if not rest:
                    self.held.removeKey(at)
                    continue
                low = min(r[0] for r in rest)
                first = low if first is None else min(first, low)
                if due:
                    self.held.updateValue(at, (pickle.dumps(rest),))
            waiting.sort(key=_place)
            cut = bisect_left(waiting, until, key=lambda r: r[0])
            for micros, k, *row in waiting[:cut]:
                states[k], found = self.rule.step(states[k] if k in states else self.rule.fresh(), micros, row)
                given += [(k, *g) for g in found]
            waiting, changed = waiting[cut:], changed or cut > 0
            if len(given) >= 10_000:
                yield pd.DataFrame(given, columns=self.out)
                given = []
        if given:
            yield pd.DataFrame(given, columns=self.out)
        if changed:
            self.states.update((pickle.dumps(states),))
        self.progress.update((self.progress.get()[0], 0 if first is None else self._timer(0, first)))

    def close(self) -> None:
        pass


def _place(row: tuple) -> tuple:
    """Rows in order of time, then of their columns; nulls first."""
    return row[0], *[(x is not None, x) for x in row[2:]]


def in_order(stream: DataFrame, key: str, columns: Sequence[str], rule: Rule, out: str, late: str = "1 hour", slice_seconds: int = SLICE) -> DataFrame:
    """The rule's rows (`out`, after the key) for each key's rows in order of ts, then of `columns`. Rows that come `late`
    after a newer one are dropped, as everywhere in streams; rows without a time or key take no part. State is kept by GROUPS
    groups of keys: a call of the store for each key and row would take longer than all else."""
    rows = stream.withWatermark("ts", late).filter(F.col("ts").isNotNull() & F.col(key).isNotNull())
    group = F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("_group")
    rows = rows.select(group, key, "ts", F.unix_micros("ts").alias("micros"), *[c for c in dict.fromkeys(columns) if c != key])
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {out}"
    names = [key, *[part.split()[0] for part in out.split(", ")]]
    return rows.groupBy("_group").transformWithStateInPandas(_InOrder(rule, key, columns, names, slice_seconds), schema, "Append", "EventTime")


@dataclass
class Reorder(Rule):
    most_held: int

    def fresh(self):
        return 1, {}, {}

    def step(self, state, micros, row):
        (due, waiting, seen), (n, c), out = state, row, []
        known = waiting.get(n, seen.get(n))
        if known is not None or n < due:
            return state, [(n, "duplicate" if known in (None, c) else "conflict")]
        waiting[n] = c
        while waiting and (due in waiting or len(waiting) > self.most_held):
            if due not in waiting:
                out.append((due, "gap"))
                due = min(waiting)
            seen[due] = waiting.pop(due)
            out.append((due, "released"))
            seen.pop(due - self.most_held, None)
            due += 1
        return (due, waiting, seen), out


@dataclass
class TokenBucket(Rule):
    rate: float
    burst: float
    costed: bool

    def fresh(self):
        return self.burst, None

    def step(self, state, micros, row):
        left, last = state
        left = self.burst if last is None else min(self.burst, left + (micros - last) / 1e6 * self.rate)
        want = float(row[1]) if self.costed else 1.0
        passed = want <= left
        return (left - want * passed, micros), [(row[0], passed)]


@dataclass
class Repeats(Rule):
    seconds: int

    def fresh(self):
        return None, 0

    def step(self, state, micros, row):
        (last, at), now = state, micros // 1_000_000
        new = last is None or row[1] != last or now - at > self.seconds
        return (row[1], now), [(row[0],)] if new else []


@dataclass
class Lockout(Rule):
    most: int
    window: int
    lock: int

    def fresh(self):
        return None, 0, None

    def step(self, state, micros, row):
        start, n, until = state
        if until is not None and micros < until:
            return state, [(row[0], True)]
        if start is None or micros - start >= self.window * 1_000_000:
            start, n = micros, 0
        n += 1
        if n >= self.most:
            return (None, 0, micros + self.lock * 1_000_000), [(row[0], self.lock > 0)]
        return (start, n, until), [(row[0], False)]


def reordered(frames: DataFrame, key: str, sequence: str, checksum: str, most_held: int = 1024, late: str = "1 hour") -> DataFrame:
    """Frames of each stream in order. A number seen before with the same checksum is a duplicate, with another a
    conflict; beyond `most_held` waiting frames the gap is given up and reported."""
    stream = frames.withColumn(sequence, F.col(sequence).cast("long")).withColumn(checksum, F.col(checksum).cast("string"))
    return in_order(stream, key, [sequence, checksum], Reorder(most_held), "sequence long, outcome string", late)


def _type(stream: DataFrame, c: str) -> str:
    return f"{c} {stream.schema[c].dataType.simpleString()}"


def rate_limited(events: DataFrame, key: str, id_col: str, rate: float, burst: float, cost: str | None = None, late: str = "1 hour") -> DataFrame:
    """Token bucket: `rate` tokens a second up to `burst`; an event passes if its cost is there."""
    return in_order(events, key, [id_col, *([cost] if cost else [])], TokenBucket(rate, burst, bool(cost)), f"{_type(events, id_col)}, passed boolean", late)


def first_of_repeats(events: DataFrame, key: str, id_col: str, value: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Events whose value differs from the last one of the key, or comes more than `seconds` after it."""
    return in_order(events, key, [id_col, value], Repeats(seconds), _type(events, id_col), late)


def lockouts(failures: DataFrame, key: str, id_col: str, most: int = 5, window: int = 300, lock: int = 900, late: str = "1 hour") -> DataFrame:
    """Failures counted in windows that start with the first of them; at `most` the key is locked for a while."""
    return in_order(failures, key, [id_col], Lockout(most, window, lock), f"{_type(failures, id_col)}, locked boolean", late)


def staged(rows: DataFrame, path: str, parts: int, jitter: int = 6 * 3600) -> str:
    """Write `rows` as a stream would bring them: in `parts` steps of time, each row up to `jitter` seconds early, and an end
    mark, a row so late that the watermark passes all others. Returns the delay that no row exceeds."""
    rows = stored(rows.withColumn("ts", F.col("ts").cast("timestamp")), "staged")
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if low is None:
        rows.write.parquet(path)
        return "1 hour"
    span = (high - low) // 1_000_000 + 1
    early = F.pmod(F.xxhash64(*rows.columns), F.lit(jitter + 1))
    slot = F.least(F.greatest(F.floor(((F.unix_micros("ts") - low) / 1_000_000 - early) * parts / span), F.lit(0)), F.lit(parts - 1))
    for part in range(parts):
        rows.filter(slot == part).write.mode("append").parquet(path)
    late = -(-span // parts) + jitter
    rows.limit(1).withColumn("ts", F.timestamp_micros(F.lit(high + (late + 3600) * 1_000_000))).coalesce(1).write.mode("append").parquet(path)
    return f"{late} seconds"


def leases(beats: DataFrame, key: str, id_col: str, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """A row when a key's heartbeat has stopped for `seconds` of event time."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, n = _kept(state, (0.0, 0))
            state.remove()
            yield pd.DataFrame([(k[0], n)], columns=[key, "attempts"])
            return
        at, n = _kept(state, (0.0, 0))
        for batch in batches:
            at, n = max(at, *(t.timestamp() for t in batch["ts"])), n + len(batch)
        _keep(state, (at, n))
        state.setTimeoutTimestamp(max(int((at + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    kind = beats.schema[key].dataType.simpleString()
    return beats.withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, attempts long", STATE, "append", GroupStateTimeout.EventTimeTimeout)

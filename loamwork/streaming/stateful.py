"""Keyed streams with state of their own: sessions closed by timers, alerts with hysteresis, first events.

Each is a StatefulProcessor under transformWithState, with its state in RocksDB.  Every key's
state is let go by an event-time timer, so what is kept follows the keys that are active within the
watermark and not all that were ever seen.  Times travel as microseconds since 1970.

Sessions and first events have as many keys as users, and a call into the state costs the same for
one key as for a thousand: keys are dealt over BUCKETS groups, whose state is one table each.

A restarted query goes on from its checkpoint: open sessions, counts and raised alerts are in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import run_available, timed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
US, BUCKET = "event_us", "__bucket"
#: Groups that keys are dealt over.  A checkpoint goes on with the number it was begun with.
BUCKETS = 512


def micros(text: str) -> int:
    """Microseconds of "30 minutes", "1 day" and the like."""
    n, unit = text.split()
    return int(n) * {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}[unit.rstrip("s")]


def _due(us):
    """The millisecond at which all of a time in microseconds has passed."""
    return -(-us // 1000)


class Bucketed(StatefulProcessor):
    """Many keys under one grouping key, so that calls into the state grow with the buckets and not with the keys.

    What a bucket holds is one Arrow table of all its keys; its one timer stands at the time when
    the first of them is due.  The keys of a bucket agree in which of the key columns are null.
    """

    def __init__(self, keys: list[str], buckets: int):
        self.keys, self.buckets = keys, buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "due long, rows binary")

    def named(self, key) -> list[str]:
        """The key columns that aren't null in this bucket."""
        return [k for i, k in enumerate(self.keys) if not key[0] // self.buckets >> i & 1]

    def held(self) -> tuple[int | None, pd.DataFrame | None]:
        if not self.state.exists():
            return None, None
        due, rows = self.state.get()
        return due, pa.ipc.open_stream(bytes(rows)).read_pandas()

    def hold(self, before: int | None, rows: pd.DataFrame, due: np.ndarray) -> None:
        """Keep rows, of which the first is due at the least of `due`, in milliseconds."""
        if not len(rows):
            self.state.clear()
            return
        first = int(due.min())
        table = pa.Table.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.state.update((first, sink.getvalue().to_pybytes()))
        if first != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(first)

    def sent(self, rows: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
        return rows.assign(**{k: None for k in self.keys if k not in rows})[columns]

    def close(self) -> None:
        pass


class Sessions(Bucketed):
    """Events less than `gap` apart are one session; it is sent when the watermark passes its end.

    Several sessions of a key can be open, as events come in any order within the watermark; an
    event between two joins them.
    """

    def __init__(self, key: str, gap_us: int, buckets: int = BUCKETS):
        super().__init__([key], buckets)
        self.gap = gap_us

    def due(self, rows: pd.DataFrame) -> np.ndarray:
        return _due(rows["last_us"].to_numpy() + self.gap)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys = self.named(key)
        before, held = self.held()
        parts = [] if held is None else [held]
        for part in rows:
            us = part[US].to_numpy()
            parts.append(self.joined(part[keys].assign(first_us=us, last_us=us, n_events=1), keys))
        open_ = self.joined(pd.concat(parts, ignore_index=True), keys)
        self.hold(before, open_, self.due(open_))
        return iter(())

    def joined(self, rows: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
        code = rows.groupby(keys, sort=False).ngroup().to_numpy() if keys else np.zeros(len(rows), dtype=np.int64)
        order = np.lexsort((rows["first_us"].to_numpy(), code))
        rows, code = rows.iloc[order], code[order]
        last = rows["last_us"].groupby(code).cummax().to_numpy()
        first = rows["first_us"].to_numpy()
        at = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (first[1:] - last[:-1] >= self.gap))))
        ends = np.append(at[1:], len(rows)) - 1
        return rows.iloc[at].assign(last_us=last[ends], n_events=np.add.reduceat(rows["n_events"].to_numpy(), at))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self.held()
        if held is None:
            return
        due = self.due(held)
        over = due <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.hold(None, held[~over], due[~over])
        if over.any():
            yield self.sent(held[over], [*self.keys, "first_us", "last_us", "n_events"])


class Alerts(StatefulProcessor):
    """Rates of bad rows by key and window: raised above `high`, cleared only below `low`.

    A window is judged when the watermark passes its end, in order of time.  Windows without rows
    say nothing.
    """

    def __init__(self, key: str, size_us: int, high: float, low: float):
        if low > high:
            raise ValueError("low is at most high")
        self.key, self.size, self.high, self.low = key, size_us, high, low

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "start long", "n long, bad long")
        self.raised = handle.getValueState("raised", "on boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [part["bad"].groupby(part[US].to_numpy() // self.size * self.size).agg(["size", "sum"]) for part in rows]
        for s, more, worse in pd.concat(found).groupby(level=0).sum().itertuples():
            n, b = self.counts.getValue((int(s),)) if self.counts.containsKey((int(s),)) else (0, 0)
            self.counts.updateValue((int(s),), (n + int(more), b + int(worse)))
            self.handle.registerTimer(_due(int(s) + self.size))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        on = bool(self.raised.get()[0]) if self.raised.exists() else False
        sent = []
        for (start,) in sorted(tuple(k) for k in self.counts.keys()):
            if _due(start + self.size) > now:
                break
            n, bad = self.counts.getValue((start,))
            self.counts.removeKey((start,))
            rate = bad / n
            if (not on and rate > self.high) or (on and rate < self.low):
                on = not on
                sent.append((key[0], start, "raised" if on else "cleared", n, bad))
        if on:
            self.raised.update((True,))
        else:
            self.raised.clear()  # a key at rest has no state
        if sent:
            yield pd.DataFrame(sent, columns=[self.key, "start_us", "change", "n_rows", "n_bad"])

    def close(self) -> None:
        pass


class First(Bucketed):
    """The first row to come of each key; it is known until `hold` after its own time has passed."""

    def __init__(self, columns: list[str], hold_us: int, buckets: int = BUCKETS):
        super().__init__(columns, buckets)
        self.held_for = hold_us

    def due(self, rows: pd.DataFrame) -> np.ndarray:
        return _due(rows[US].to_numpy() + self.held_for)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keys = self.named(key)
        least = lambda d: d.groupby(keys, sort=False, as_index=False)[US].min() if keys else d[[US]].min().to_frame().T
        new = least(pd.concat([least(part[[*keys, US]]) for part in rows], ignore_index=True))
        before, held = self.held()
        if held is not None:
            both = pd.concat([held, new], ignore_index=True)
            known = both.duplicated(keys) if keys else pd.Series(both.index > 0)
            new = both[~known].iloc[len(held) :]
        if len(new):
            known = new if held is None else pd.concat([held, new], ignore_index=True)
            self.hold(before, known, self.due(known))
            yield self.sent(new, [*self.keys, US])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, held = self.held()
        if held is not None:
            due = self.due(held)
            over = due <= max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
            self.hold(None, held[~over], due[~over])
        return iter(())


def _keyed(df: DataFrame, key: str | list[str], processor: StatefulProcessor, out: str, column: str, delay: str, *more) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    d = timed(df.filter(F.col(column).isNotNull()), column, delay)
    d = d.select(*keys, column, F.unix_micros(column).alias(US), *more)
    if isinstance(processor, Bucketed):
        # the bucket's number tells which keys are null: beside nulls, pandas would turn whole numbers into floats
        nulls = sum((F.col(k).isNull().cast("long") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
        whole = [k for k in keys if isinstance(d.schema[k].dataType, T.IntegralType)]
        d = d.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(processor.buckets)) + nulls * processor.buckets)
        d, keys = d.withColumns({k: F.coalesce(k, F.lit(0).cast(d.schema[k].dataType)) for k in whole}), [BUCKET]
    return d.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def closed_sessions(df: DataFrame, user: str, column: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user, session_start, session_end, n_events) of a stream, each session when it is over."""
    kind = df.schema[user].dataType.simpleString()
    d = _keyed(df, user, Sessions(user, micros(gap)), f"{user} {kind}, first_us long, last_us long, n_events long", column, delay)
    return d.select(user, F.timestamp_micros("first_us").alias("session_start"), F.timestamp_micros(F.col("last_us") + micros(gap)).alias("session_end"), "n_events")


def rate_alerts(df: DataFrame, key: str, bad: str, high: float, low: float, column: str = "ts", size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(key, window_start, change, n_rows, n_bad): where a key's rate of bad rows rose above high or then fell below low."""
    kind = df.schema[key].dataType.simpleString()
    d = _keyed(df, key, Alerts(key, micros(size), high, low), f"{key} {kind}, start_us long, change string, n_rows long, n_bad long", column, delay, F.coalesce(F.expr(bad), F.lit(False)).alias("bad"))
    return d.select(key, F.timestamp_micros("start_us").alias("window_start"), "change", "n_rows", "n_bad")


def first_events(df: DataFrame, keys: list[str], column: str = "ts", hold: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(keys, column): the first event of each key to come; a key that was silent for `hold` may come again."""
    out = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    d = _keyed(df, keys, First(keys, micros(hold)), f"{out}, {US} long", column, delay)
    return d.select(*keys, F.timestamp_micros(US).alias(column))


def drain(df: DataFrame, path: str, checkpoint: str) -> int:
    """What is there into Parquet, with state in RocksDB; goes on from the checkpoint.  Returns late rows.

    A partition of state costs the same in every batch, with rows or without: a new query has no
    more of them than two for each core.  A checkpoint goes on with the number it was begun with.
    """
    spark = df.sparkSession
    conf, few = spark.conf, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(few)}
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        return run_available(df, path, checkpoint)
    finally:
        for k, v in before.items():
            conf.set(k, v)

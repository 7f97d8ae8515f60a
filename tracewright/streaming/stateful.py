"""Streams with state of their own: assembly that gives a group out at its end record, and descriptors of live processes.

State is kept in RocksDB, by key; both processors read a key's state once for each micro-batch and write what has changed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewright import schema
from tracewright.functions import exprs as X
from tracewright.operators.enrich import descriptor_sets, named

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Serials in a row that share a key of state: calls of Python for a key cost more than a serial's few records.
SERIALS = 1024

CALL = "pid int, ppid int, syscall int, success boolean, exit_value bigint, comm string, exe string, subj string, a0 decimal(20,0), a1 decimal(20,0), a2 decimal(20,0), a3 decimal(20,0)"
PATH = "item int, nametype string, name string"
PART = f"ts_ms bigint, {CALL}, saddr string, cwd string, argv array<string>, called boolean, ended boolean, expires bigint"
GROUP = f"serial bigint, ts_ms bigint, {CALL}, paths array<struct<item:int,nametype:string,name:string>>, saddr string, cwd string, argv array<string>"
CALL_FIELDS = [c.split()[0] for c in CALL.split(", ") if c[0] != "0"]
PART_FIELDS = ["ts_ms", *CALL_FIELDS, "saddr", "cwd", "argv", "called", "ended", "expires"]


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start here keep their state in RocksDB, which such processors need; a query holds on to what it started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Assembly(StatefulProcessor):
    """Records of SERIALS serials in a row until each one's call and end record are there; what has no call by the time that expires is forgotten.

    Side records may come before their call or, within a micro-batch, after the end record. Later ones wait for a call
    that doesn't come, and expire. State is of serials that wait alone, and is read once for all of them, so most serials
    come and go within a micro-batch without any.
    """

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "serial bigint", f"{PART}, paths array<struct<{PATH.replace(' ', ':')}>>".replace(",:", ", "))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = {k[0]: v for k, v in self.waiting.iterator()}
        now: dict[int, tuple[dict, list]] = {}
        for r in rows:
            if r.serial not in now:
                kept = before.get(r.serial)
                now[r.serial] = (dict(zip(PART_FIELDS, kept)), [tuple(p) for p in kept[len(PART_FIELDS)]]) if kept else (dict.fromkeys(PART_FIELDS), [])
            part, paths = now[r.serial]
            part["ts_ms"] = max(r.ts_ms, part["ts_ms"] or 0)
            if r.rec_type == "SYSCALL" and not part["called"]:
                part |= {c: r[c] for c in CALL_FIELDS} | {"called": True}
            elif r.rec_type == "EOE":
                part["ended"] = True
            elif r.rec_type == "PATH" and r.kept:
                paths.append((r.item, r.nametype, r.name))
            for c in ("saddr", "cwd", "argv"):
                if r[c] is not None:
                    part[c] = r[c]
        timers = {p[PART_FIELDS.index("expires")] for p in before.values()}
        for serial, (part, paths) in now.items():
            if part["called"] and part["ended"]:
                if serial in before:
                    self.waiting.removeKey((serial,))
                part |= {"serial": serial, "paths": sorted(paths)}
                yield Row(**{c: part[c] for c in GROUP_FIELDS})
                continue
            if serial not in before:
                part["expires"] = part["ts_ms"] + self.delay_ms
                if part["expires"] not in timers:
                    timers.add(part["expires"])
                    self.handle.registerTimer(part["expires"])
            self.waiting.updateValue((serial,), (*[part[c] for c in PART_FIELDS], paths))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        for serial in [k[0] for k, v in self.waiting.iterator() if v[PART_FIELDS.index("expires")] <= until]:
            self.waiting.removeKey((serial,))
        yield from ()

    def close(self) -> None:
        pass


GROUP_FIELDS = ["serial", "ts_ms", *CALL_FIELDS, "paths", "saddr", "cwd", "argv"]


def assemble(parsed: DataFrame, delay_ms: int = 600_000, subject: str | None = "docker-default") -> DataFrame:
    """A stream of parsed records as rows of one serial each, given out in the micro-batch that has its end record.

    Groups without a call or an end are dropped when the watermark, delay_ms behind the latest record, has passed them by as much again.
    """
    timed = parsed.where("serial is not null").withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", f"{delay_ms} milliseconds")
    noise = ~X.is_record_noise(F.col("name"))
    columns = ["serial", "event_time", "rec_type", "ts_ms", *CALL_FIELDS, "item", "nametype", "name", "saddr", "cwd", "argv"]
    run = F.floor(F.col("serial") / F.lit(SERIALS)).cast("long").alias("run")
    rows = timed.select(*columns, F.coalesce(noise, F.lit(True)).alias("kept"), run).groupBy("run").transformWithState(Assembly(delay_ms), GROUP, "Append", "EventTime")
    rows = rows.where((F.col("pid") > 0) & (F.col("success") | F.col("saddr").isNotNull()))
    return rows if subject is None else rows.where(F.col("subj") == subject)


class Descriptors(StatefulProcessor):
    """What each descriptor of a process means, forgotten when the process exits; asks: columns with descriptors, by the name of the answer."""

    def __init__(self, columns: list[str], asks: dict[str, str]):
        self.columns, self.asks = columns, asks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meant = handle.getMapState("meant", "fd bigint", "target string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = {k[0]: v[0] for k, v in self.meant.iterator()}
        now = dict(before)
        for r in sorted(rows, key=lambda r: (r.ts_ms, r.serial)):
            yield Row(**{c: r[c] for c in self.columns}, **{name: now.get(r[c]) for name, c in self.asks.items()})
            if r.exits:
                now.clear()
            elif r.sets is not None and r.fd is not None:
                now[r.fd] = r.sets
        if before and not now:
            self.meant.clear()
            return
        for fd in before.keys() - now.keys():
            self.meant.removeKey((fd,))
        for fd, target in now.items():
            if before.get(fd) != target:
                self.meant.updateValue((fd,), (target,))

    def close(self) -> None:
        pass


def with_meanings(events: DataFrame, keep: list[str], asks: dict[str, str]) -> DataFrame:
    calls = named(events)
    number = lambda c: F.col(c).cast("long").alias(c)
    fds = [number(c) for c in dict.fromkeys(["fd", *asks.values()]) if c not in keep]
    rows = calls.select(*[number(c) if c in ("fd", *asks.values(), "pid") else F.col(c) for c in keep], *fds, descriptor_sets(calls).alias("sets"), (F.col("syscall_name") == "exit_group").alias("exits"))
    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"{name} string" for name in asks])
    return rows.groupBy("container_id", "pid").transformWithState(Descriptors(keep, asks), out, "Append", "None")


def fd_targets(events: DataFrame) -> DataFrame:
    """container_id, pid, serial, fd, fd_target over a stream of events: what their descriptor last meant before them, since their process last exited.

    Events of a process are taken in order of time within a micro-batch, and micro-batches as they come. Nothing is kept of
    processes that have exited.
    """
    return with_meanings(events, ["container_id", "pid", "serial", "ts_ms", "fd"], {"fd_target": "fd"}).drop("ts_ms")


def looked_up(events: DataFrame) -> DataFrame:
    """A stream of events with what their descriptors mean: fd_target, and of kernel transfers that read a file, source (its path)."""
    keep = ["container_id", "pid", "serial", "ts_ms", "ppid", "syscall", "flags", "fd", "path", "channel"]
    rows = with_meanings(events, keep, {"fd_target": "fd", "source": "src_fd"})
    is_file = ~F.startswith("source", F.lit("net:")) & ~F.startswith("source", F.lit("mq:"))
    moved = F.col("syscall").isin([k for k, v in schema.SYSCALLS.items() if v in schema.OPS["transfer", "Read"].split()])
    return rows.withColumn("source", F.when(moved & is_file, F.col("source")))


class Attribution(StatefulProcessor):
    """Events of a time slot until all markers that bear on it have come; then each gets the action of its time."""

    def __init__(self, gap_ms: int, width_ms: int):
        self.gap_ms, self.width_ms = gap_ms, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "serial bigint, ts_ms bigint")
        self.marks = handle.getListState("marks", "ts_ms bigint, starts boolean, action_id bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events, marks = [], []
        for r in rows:
            if r.starts is None:
                events.append((r.serial, r.ts_ms))
            else:
                marks.append((r.ts_ms, r.starts, r.action_id))
        fresh = not self.events.exists() and not self.marks.exists()
        if events:
            self.events.appendList(events)
        if marks:
            self.marks.appendList(marks)
        if fresh:
            self.handle.registerTimer((key[1] + 1) * self.width_ms + self.gap_ms)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        marks = [tuple(m) for m in self.marks.get()] if self.marks.exists() else []
        events = [tuple(e) for e in self.events.get()] if self.events.exists() else []
        starts = sorted((ts, action) for ts, is_start, action in marks if is_start)
        ends: dict[int, int] = {}
        for ts, is_start, action in marks:
            if not is_start:
                ends[action] = max(ts, ends.get(action, ts))
        times = [ts for ts, _ in starts]
        open_ = [(ts, action) for ts, action in starts if action not in ends]
        for serial, ts in events:
            yield Row(container_id=key[0], serial=serial, ts_ms=ts, action_id=self.action_at(ts, starts, times, ends, open_))
        self.events.clear()
        self.marks.clear()

    def action_at(self, ts: int, starts: list, times: list, ends: dict, open_: list) -> int:
        """The action whose interval holds ts (the latest), else the latest that is open, else the next one if it starts within the gap, else 0."""
        k = bisect_right(times, ts)
        inside = [action for _, action in starts[:k] if ts <= ends.get(action, ts)]
        if inside:
            return inside[-1]
        before = [action for start, action in open_ if start <= ts]
        if before:
            return before[-1]
        k = bisect_left(times, ts + 1)
        return starts[k][1] if k < len(starts) and starts[k][0] - ts < self.gap_ms else 0

    def close(self) -> None:
        pass


def timed(events: DataFrame, marks: DataFrame, gap_ms: int = 2000, delay_ms: int = 0, longest_ms: int = 86_400_000, width_ms: int = 3_600_000, salts: int = 4) -> DataFrame:
    """container_id, serial, ts_ms, action_id over a stream of events and one of markers (container_id, ts_ms, kind start or end, action_id).

    Both streams have a watermark, delay_ms behind their latest row, and the one behind holds. Events wait in the state of their
    container and time slot (a busy one's in several) until it has passed the slot and the gap after it: a marker counts wherever
    it comes in either stream before that, so markers that come after their events still win. A start bears on slots up to longest_ms after it.
    """
    marked = lambda df: df.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", f"{delay_ms} milliseconds")
    slot = lambda c: F.floor(c / F.lit(width_ms)).cast("long")
    salt = F.pmod(F.xxhash64("serial"), F.lit(salts)).cast("int").alias("salt")
    own = marked(events).select("container_id", slot(F.col("ts_ms")).alias("slot"), salt, "event_time", F.col("serial").cast("long").alias("serial"), "ts_ms", F.lit(None).cast("boolean").alias("starts"), F.lit(None).cast("long").alias("action_id"))
    starts = F.col("kind") == "start"
    first = F.when(starts, slot(F.col("ts_ms") - gap_ms)).otherwise(slot(F.col("ts_ms")))
    told = marked(marks).withColumn("slot", F.explode(F.sequence(first, slot(F.col("ts_ms") + longest_ms)))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    told = told.select("container_id", "slot", "salt", "event_time", F.lit(None).cast("long").alias("serial"), "ts_ms", starts.alias("starts"), F.col("action_id").cast("long").alias("action_id"))
    out = "container_id string, serial bigint, ts_ms bigint, action_id bigint"
    return own.unionByName(told).groupBy("container_id", "slot", "salt").transformWithState(Attribution(gap_ms, width_ms), out, "Append", "EventTime")

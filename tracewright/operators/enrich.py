"""Who a process is, and which action an event belongs to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.shared import discard, stash

HOUR = 3_600_000


def syscall_table(spark: SparkSession, names: dict[int, str] | None = None) -> DataFrame:
    """syscall, syscall_name, class, op: one row per call known; a fixed small dimension."""
    ops = {call: key for key, calls in schema.OPS.items() for call in calls.split()}
    rows = [(k, v, *ops.get(v, (None, None)), v in schema.AUDITED) for k, v in (names or schema.SYSCALLS).items()]
    return spark.createDataFrame(rows, "syscall int, syscall_name string, class string, op string, audited boolean")


def syscall_names(spark: SparkSession, path: str) -> dict[int, str]:
    """Numbers and names of all calls out of a C header in text (lines "#define __NR_name number")."""
    line = F.col("value")
    part = lambda i: F.regexp_extract(line, r"^\s*#\s*define\s+__NR_(\w+)\s+(\d+)\s*$", i)
    rows = spark.read.text(path).select(part(2).try_cast("int").alias("number"), part(1).alias("name")).where("number is not null")
    # a few hundred rows by nature
    return {r["number"]: r["name"] for r in rows.collect()}


def named(events: DataFrame) -> DataFrame:
    """Events with the name, class and op of their call; numbers that aren't known are called unknown."""
    dim = F.broadcast(syscall_table(events.sparkSession))
    return events.join(dim, "syscall", "left").withColumn("syscall_name", F.coalesce("syscall_name", F.lit("unknown")))


def audited(events: DataFrame) -> DataFrame:
    """Events whose call the audit policy records; opens only where they succeeded (by success, or else a descriptor that isn't negative)."""
    rows = events.join(F.broadcast(syscall_table(events.sparkSession).where("audited").select("syscall", F.col("op").alias("audited_op"))), "syscall")
    opened = F.col("success") if "success" in events.columns else F.coalesce(F.col("fd") >= 0, F.lit(True))
    return rows.where((F.coalesce("audited_op", F.lit("")) != "Open") | opened).drop("audited_op")


def processes(events: DataFrame) -> DataFrame:
    """One row per (container_id, pid): parent and first sight, latest non-empty comm, cmdline and exe, whether it has exited.

    What an exec resolved its file to goes before the program that a record names; records of other calls count
    only without an exec.
    """
    last = lambda x, when: F.max_by(x, F.when(when & x.isNotNull() & (x != ""), F.col("serial")))
    latest = lambda c: last(F.col(c), F.lit(True)).alias(c)
    has = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string")
    execs = F.col("syscall").isin([k for k, v in schema.SYSCALLS.items() if v in ("execve", "execveat")])
    exe = F.coalesce(last(F.coalesce(F.nullif(has("path"), F.lit("")), has("exe")), execs), last(has("exe"), F.lit(True)))
    return events.groupBy("container_id", "pid").agg(
        F.min("serial").alias("first_seq"), F.min_by("ts_ms", "serial").alias("first_ts"), F.min_by("ppid", "serial").alias("ppid"),
        latest("comm"), latest("cmdline"), exe.alias("exe"), F.bool_or(F.col("syscall") == 231).alias("exited"), F.count("*").alias("n_events"),
    )


def children(procs: DataFrame) -> DataFrame:
    """container_id, pid, child: the children of each process, a row each."""
    return procs.select("container_id", F.col("ppid").alias("pid"), F.col("pid").alias("child"))


def children_text(procs: DataFrame) -> DataFrame:
    """Children of each process as one text, in order of pid; it gathers a parent's children into a row."""
    return procs.groupBy("container_id", F.col("ppid").alias("pid")).agg(F.array_join(F.array_sort(F.collect_list("pid")), ",").alias("children"), F.count("*").alias("n_children"))


def action_at_time(events: DataFrame, actions: DataFrame, gap_ms: int = 2000, width_ms: int = HOUR) -> DataFrame:
    """Events with action_id: the action whose interval holds the time, else the next one if it starts within the gap, else 0.

    Intervals of a container don't overlap; an open one (end_ms null) holds all later times. Actions are listed
    under each time slot that they or the gap before them touch, so events meet them by an equality of
    container and slot, spread over slots: no container is sorted or gathered as a whole.
    """
    slot = lambda c: F.floor(c / F.lit(width_ms)).cast("long")
    item = F.struct("start_ms", "end_ms", "action_id")
    closed = actions.where("end_ms is not null").select("container_id", item.alias("a"), F.explode(F.sequence(slot(F.col("start_ms") - gap_ms), slot(F.col("end_ms")))).alias("slot"))
    opened = actions.where("end_ms is null").select("container_id", item.alias("a"), F.explode(F.sequence(slot(F.col("start_ms") - gap_ms), slot(F.col("start_ms")))).alias("slot"))
    slots = closed.unionByName(opened).groupBy("container_id", "slot").agg(F.array_sort(F.collect_list("a")).alias("__near"))
    # one open action per container at most: the latest
    late = actions.where("end_ms is null").groupBy("container_id").agg(F.max(F.struct("start_ms", "action_id")).alias("__open"))
    out = events.withColumn("slot", slot(F.col("ts_ms"))).join(slots, ["container_id", "slot"], "left").join(late, "container_id", "left")
    ts, near = F.col("ts_ms"), F.coalesce("__near", F.array().cast(slots.schema["__near"].dataType))
    inside = F.filter(near, lambda a: (a["start_ms"] <= ts) & (a["end_ms"].isNull() | (ts <= a["end_ms"])))
    later = F.filter(near, lambda a: (a["start_ms"] > ts) & (a["start_ms"] - ts < gap_ms))
    now = F.when(F.col("__open")["start_ms"] <= ts, F.col("__open")["action_id"])
    found = F.coalesce(F.try_element_at(inside, F.lit(-1))["action_id"], now, F.try_element_at(later, F.lit(1))["action_id"], F.lit(0).cast("long"))
    return out.withColumn("action_id", found).drop("slot", "__near", "__open")


def roots(procs: DataFrame) -> DataFrame:
    """root_pid and depth of each process: its oldest ancestor along parents that were seen before their child, and how far up that is.

    Each round halves what is left of every chain, and adds up how far it went; rounds end when no pointer moves.
    """
    parent = procs.select("container_id", F.col("pid").alias("ppid"), F.col("first_seq").alias("parent_seq"))
    known = procs.select("container_id", "pid", "ppid", "first_seq").join(parent, ["container_id", "ppid"], "left")
    below = F.coalesce(F.col("parent_seq") < F.col("first_seq"), F.lit(False))
    at = stash(known.select("container_id", "pid", F.when(below, F.col("ppid")).otherwise(F.col("pid")).cast("long").alias("root_pid"), below.cast("int").alias("depth")), "roots")
    last = at
    while True:
        up = at.select("container_id", F.col("pid").alias("root_pid"), F.col("root_pid").alias("next"), F.col("depth").alias("more"))
        moved = stash(at.join(up, ["container_id", "root_pid"]).select("container_id", "pid", "root_pid", "next", (F.col("depth") + F.col("more")).alias("depth")), "roots")
        if moved.where("next <> root_pid").isEmpty():
            discard(moved)
            return at
        at = moved.select("container_id", "pid", F.col("next").alias("root_pid"), "depth")
        discard(last)
        last = moved


def attributed(procs: DataFrame, actions: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """container_id, pid, root_pid, depth, action_id: processes inherit the action of their root's first event."""
    tree = roots(procs)
    first = procs.select("container_id", F.col("pid").alias("root_pid"), F.col("first_ts").alias("ts_ms"))
    at = action_at_time(first, actions, gap_ms).select("container_id", "root_pid", "action_id")
    return tree.join(at, ["container_id", "root_pid"]).select("container_id", "pid", "root_pid", "depth", "action_id")


def routed(events: DataFrame, at: DataFrame, actions: DataFrame | None = None, gap_ms: int = 2000) -> DataFrame:
    """Events with action_id, that of their process (at: container_id, pid, action_id), whenever they happen.

    Events of processes that ``at`` doesn't know go by time where ``actions`` are given, else to 0.
    """
    rows = events.join(at.select("container_id", "pid", F.col("action_id").alias("own_action")), ["container_id", "pid"], "left")
    if actions is None:
        return rows.withColumn("action_id", F.coalesce("own_action", F.lit(0).cast("long"))).drop("own_action")
    lost = action_at_time(rows.where("own_action is null").drop("own_action"), actions, gap_ms)
    return rows.where("own_action is not null").withColumnRenamed("own_action", "action_id").unionByName(lost)


def descriptor_sets(calls: DataFrame) -> Column:
    """What a call makes of its descriptor: opens that succeeded, connects and binds, and queues opened."""
    name = F.col("syscall_name")
    sets = F.when(name.isin("open", "openat", "openat2", "creat") & (F.col("fd") >= 0), F.col("path"))
    return sets.when(name.isin("connect", "bind"), F.concat(F.lit("net:"), "addr")).when(name.isin("mq_open", "msgget") & (F.col("fd") >= 0), F.concat(F.lit("mq:"), "channel"))


def last_before(rows: DataFrame, keys: list[str], order: list[str], width_ms: int = HOUR, **values: Column) -> DataFrame:
    """rows with, under each name, the last of its non-null values among the key's rows before, in order of ts_ms and then of order.

    Keys are cut into time slices: a slice is looked through by itself, and gets the last value of the slices before it, of which
    there is a row each. So one key of many rows is spread over tasks.
    """
    cut, place = [*keys, "slice"], F.struct("ts_ms", *order)
    rows = rows.withColumns({"slice": F.floor(F.col("ts_ms") / F.lit(width_ms)), **{f"{n}_value": v for n, v in values.items()}})
    lasts = rows.groupBy(*cut).agg(*[F.max_by(f"{n}_value", F.when(F.col(f"{n}_value").isNotNull(), place)).alias(n) for n in values])
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select(*cut, *[F.last(n, True).over(earlier).alias(f"{n}_carried") for n in values])
    here = Window.partitionBy(*cut).orderBy("ts_ms", *order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"{n}_here": F.last(f"{n}_value", True).over(here) for n in values})
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in cut]
    out = out.alias("a").join(carried.alias("b"), reduce(lambda x, y: x & y, same)).select("a.*", *[F.col(f"b.{n}_carried") for n in values])
    return out.withColumns({n: F.coalesce(f"{n}_here", f"{n}_carried") for n in values}).drop("slice", *[f"{n}_{x}" for n in values for x in ("value", "here", "carried")])


def descriptors(events: DataFrame, asks: dict[str, Column], width_ms: int = HOUR) -> DataFrame:
    """container_id, serial and, for each ask (name: a column with the descriptor, null where none is asked for), what it meant before the event.

    Only calls that give a descriptor its meaning, those that ask, and exits take part. A meaning counts if its process hasn't exited since.
    """
    calls = named(events)
    keys = ["container_id", "pid", "ts_ms", "serial"]
    at = F.struct("ts_ms", "serial")
    exits = calls.where("syscall_name = 'exit_group'").select(*keys, F.lit(None).cast("long").alias("of"), F.lit(None).cast("string").alias("sets"), F.lit(None).cast("string").alias("ask"))
    sets = calls.withColumn("sets", descriptor_sets(calls)).where("sets is not null").select(*keys, F.col("fd").cast("long").alias("of"), "sets", F.lit("~").alias("ask"))
    wanted = F.filter(F.array(*[F.struct(fd.cast("long").alias("of"), F.lit(name).alias("ask")) for name, fd in asks.items()]), lambda a: a["of"].isNotNull())
    asking = calls.select(*keys, F.inline(wanted)).select(*keys, "of", F.lit(None).cast("string").alias("sets"), "ask")
    # a call asks before it sets
    rows = sets.unionByName(asking).withColumn("asked", F.col("sets").isNull())
    told = last_before(rows.withColumn("later", ~F.col("asked")), ["container_id", "pid", "of"], ["serial", "later"], width_ms, meant=F.when(F.col("sets").isNotNull(), F.struct(at.alias("at"), "sets"))).where("asked").drop("asked", "later")
    ended = last_before(told.unionByName(exits.withColumn("meant", F.lit(None).cast(told.schema["meant"].dataType))), ["container_id", "pid"], ["serial"], width_ms, gone=F.when(F.col("ask").isNull(), at)).where("ask is not null")
    target = F.when(F.col("gone").isNull() | (F.col("meant.at") > F.col("gone")), F.col("meant.sets"))
    return ended.groupBy("container_id", "serial").agg(*[F.max(F.when(F.col("ask") == name, target)).alias(name) for name in asks])


def with_channels(events: DataFrame) -> DataFrame:
    """Events with their channel; sends and receives that name none have that of their descriptor, or null."""
    asks = F.when(F.col("syscall_name").isin("mq_timedsend", "mq_timedreceive", "msgsnd", "msgrcv") & (F.coalesce("channel", F.lit("")) == ""), F.col("fd"))
    found = descriptors(events, {"meant": asks}).where(F.startswith("meant", F.lit("mq:"))).select("container_id", "serial", F.expr("substring(meant, 4)").alias("meant"))
    return events.join(found, ["container_id", "serial"], "left").withColumn("channel", F.coalesce(F.nullif("channel", F.lit("")), "meant")).drop("meant")


def fd_targets(events: DataFrame, width_ms: int = HOUR) -> DataFrame:
    """Events with fd_target: what their descriptor last meant before them, since their process last exited.

    Opens that succeeded and connects or binds give a descriptor its meaning.
    """
    calls = named(events)
    at = F.struct("ts_ms", "serial")
    sets = descriptor_sets(calls)
    rows = last_before(calls, ["container_id", "pid", "fd"], ["serial"], width_ms, meant=F.when(sets.isNotNull(), F.struct(at.alias("at"), sets.alias("sets"))))
    rows = last_before(rows, ["container_id", "pid"], ["serial"], width_ms, gone=F.when(F.col("syscall_name") == "exit_group", at))
    return rows.withColumn("fd_target", F.when(F.col("gone").isNull() | (F.col("meant.at") > F.col("gone")), F.col("meant.sets"))).drop("meant", "gone")


def container_of(proc_cgroup: DataFrame, hops: int | None = 10) -> DataFrame:
    """pid, container_id out of (pid, ppid, line) of cgroup texts, and host where there is one: a process's own, or else its nearest
    ancestor's within so many hops (None: however far up), or else the only one that its host has.

    Ancestors are found by doubling: each round looks as far up as all rounds before together. Processes of different hosts don't meet.
    """
    line = F.col("line")
    patterns = [r"docker-([0-9a-f]{12,})\.scope", r"/docker/([0-9a-f]{12,})", r"cri-containerd-([0-9a-f]{12,})\.scope"]
    own = reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in patterns])
    own = F.when(~F.lower(line).rlike("buildkit|buildx"), F.left(own, F.lit(12)))
    host = F.col("host") if "host" in proc_cgroup.columns else F.lit("")
    now = proc_cgroup.groupBy(host.alias("host"), "pid").agg(F.min("ppid").alias("up"), F.min(own).alias("id"))
    now = stash(now.select("host", "pid", "up", F.lit(1).alias("far"), "id", F.when(F.col("id").isNotNull(), 0).alias("found")), "ancestors")
    # no ancestor is further up than there are processes, whatever circles their parents make
    reach, most = 1, now.count() if hops is None else hops
    while reach <= most and (hops is not None or not now.where("found is null and up is not null").isEmpty()):
        above = now.select("host", F.col("pid").alias("up"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("id").alias("theirs"), (F.col("found")).alias("beyond"))
        rows = now.join(above, ["host", "up"], "left")
        id_, found = F.coalesce("id", "theirs"), F.coalesce("found", F.col("far") + F.col("beyond"))
        new = stash(rows.select("host", "pid", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), id_.alias("id"), found.alias("found")), "ancestors")
        discard(now)
        now, reach = new, reach * 2
    rows = now.select("host", "pid", F.when(F.col("found") <= most, F.col("id")).alias("id"))
    only = rows.groupBy("host").agg(F.count_distinct("id").alias("n"), F.min("id").alias("only"))
    out = rows.join(only, "host").select("host", "pid", F.coalesce("id", F.when(F.col("n") == 1, F.col("only"))).alias("container_id"))
    return out if "host" in proc_cgroup.columns else out.drop("host")


def session_actions(events: DataFrame, gap_ms: int, width_ms: int = HOUR) -> DataFrame:
    """container_id, action_id, command, start_ms, end_ms, n_events: actions by gaps, where nobody declares any.

    An action goes on as long as its container's events follow each other within the gap; its command is that of its first event with one.
    Sessions are made within time slots first, so that a busy container is spread over tasks; what meets over the slots' borders is then
    joined, of which there is a row for each slot at least.
    """
    time, slot = F.timestamp_millis("ts_ms"), F.floor(F.col("ts_ms") / F.lit(width_ms))
    first = F.min_by("cmdline", F.when(F.coalesce("cmdline", F.lit("")) != "", F.struct("ts_ms", "serial")))
    told = F.min(F.when(F.coalesce("cmdline", F.lit("")) != "", F.struct("ts_ms", "serial")))
    pieces = events.groupBy("container_id", slot.alias("slot"), F.session_window(time, f"{gap_ms} milliseconds")).agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"), first.alias("command"), told.alias("told"))
    order = Window.partitionBy("container_id").orderBy("start_ms")
    new = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order) > gap_ms, F.lit(True))
    pieces = pieces.withColumn("new", new.cast("long")).withColumn("action_id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy("container_id", "action_id").agg(F.min_by("command", "told").alias("command"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n").alias("n_events"))


def ip_owner(claims: DataFrame) -> DataFrame:
    """ip, container_id: an explicit claim wins, the latest of them; else the first seen."""
    order = F.struct(F.when(F.col("explicit"), 0).otherwise(1), F.when(F.col("explicit"), -F.col("ts_ms")).otherwise(F.col("ts_ms")), "container_id")
    return claims.groupBy("ip").agg(F.min_by("container_id", order).alias("container_id"))


def pair_boundaries(marks: DataFrame) -> DataFrame:
    """container_id, action_id, command, start_ms, end_ms out of marks (container_id, ts_ms, kind start or end, command)."""
    order = Window.partitionBy("container_id").orderBy("ts_ms", "kind")
    nxt = marks.withColumns({"next_kind": F.lead("kind").over(order), "next_ms": F.lead("ts_ms").over(order)}).where("kind = 'start'")
    ids = Window.partitionBy("container_id").orderBy("ts_ms")
    return nxt.select("container_id", F.row_number().over(ids).cast("long").alias("action_id"), "command", F.col("ts_ms").alias("start_ms"), F.when(F.col("next_kind") == "end", F.col("next_ms")).alias("end_ms"))


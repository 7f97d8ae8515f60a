"""Facts of events: what was done to processes, files, sockets and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators.enrich import descriptors, named


QUEUE_CALLS = ("msgsnd", "mq_timedsend", "msgrcv", "mq_timedreceive")


def op_events(events: DataFrame, *keep: str) -> DataFrame:
    """class, op, path of each fact, and the columns ``keep``; an exec makes two (process and file).

    Calls without a meaning make none, nor do sends and receives on a queue that isn't known.
    """
    rows = named(events).where("class is not null").where(~F.col("syscall_name").isin(*QUEUE_CALLS) | (F.coalesce("channel", F.lit("")) != ""))
    op = F.when((F.col("class") == "file") & (F.col("op") == "Open") & X.is_write(F.coalesce("flags", F.lit(0))), "OpenWrite").otherwise(F.col("op"))
    fact = lambda kind, o, path: F.struct(kind.alias("class"), o.alias("op"), path.alias("path"))
    own = fact(F.when(F.col("class") == "transfer", "file").otherwise(F.col("class")), op, F.when(F.col("class") == "file", F.col("path")))
    facts = F.when(F.col("op") == "Exec", F.array(own, fact(F.lit("file"), F.lit("Exec"), F.col("path")))).otherwise(F.array(own))
    return rows.select("container_id", "serial", "ts_ms", "pid", "syscall_name", "comm", "addr", "channel", *keep, F.inline(facts))


def kernel_transfers(events: DataFrame, *keep: str) -> DataFrame:
    """container_id, serial, pid, label, source, target of transfers between descriptors inside the kernel: what these meant, null if unknown.

    The source descriptor is src_fd, or fd where events have no src_fd.
    """
    has = lambda c: F.col(c).cast("long") if c in events.columns else F.lit(None).cast("long")
    moved = F.col("class") == "transfer"
    source, target = F.coalesce(has("src_fd"), has("fd")), has("dst_fd")
    found = descriptors(events, {"source": F.when(moved, source), "target": F.when(moved, target)})
    rows = named(events).where(moved).select("container_id", "serial", "pid", "syscall_name", source.alias("from_fd"), target.alias("to_fd"), *keep).join(found, ["container_id", "serial"], "left")
    said = lambda meant, fd: F.coalesce(meant, F.concat(F.lit("fd:"), fd))
    a, b = said("source", "from_fd"), said("target", "to_fd")
    label = F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit("(kernel:"), "syscall_name", F.lit(" "), a, F.lit(" → "), b, F.lit(")"))).otherwise(F.concat(F.lit("(kernel:"), "syscall_name", F.lit(")")))
    return rows.select("container_id", "serial", "pid", label.alias("label"), "source", "target", *keep)


def file_access(events: DataFrame) -> DataFrame:
    """container_id, path, role, pid, action_id, first_seq, first_ms: distinct accesses; events need action_id.

    Roles: writer, reader, executor, deleter (unlink), modifier (rename, chmod, chown). A transfer reads the file
    of its source. Reading a file counts only if the process hadn't written it before.
    """
    moved = kernel_transfers(events, "action_id", "ts_ms").where("source is not null and not startswith(source, 'net:') and not startswith(source, 'mq:')")
    rows = accesses(events, moved)
    written = F.min(F.when(F.col("role") == "writer", F.col("first_seq"))).over(Window.partitionBy("container_id", "path", "pid"))
    rows = rows.withColumn("written", written)
    return rows.where((F.col("role") != "reader") | F.col("written").isNull() | (F.col("first_seq") < F.col("written"))).select("container_id", "path", "role", "pid", "action_id", "first_seq", "first_ms")


def accesses(events: DataFrame, moved: DataFrame) -> DataFrame:
    """As file_access, with all reads; moved: (container_id, pid, action_id, serial, ts_ms, source) of transfers that read a file."""
    ops = named(events).where(F.col("path").isNotNull() & (F.col("path") != ""))
    role = F.when(F.col("op") == "Open", F.when(X.is_write(F.coalesce("flags", F.lit(0))), "writer").otherwise("reader")).when(F.col("op") == "Exec", "executor")
    role = role.when(F.col("op") == "Unlink", "deleter").when(F.col("op").isin("Rename", "Chmod", "Chown"), "modifier")
    rows = ops.select("container_id", "path", "pid", role.alias("role"), "action_id", "serial", "ts_ms").where("role is not null")
    rows = rows.unionByName(moved.select("container_id", F.col("source").alias("path"), "pid", F.lit("reader").alias("role"), "action_id", "serial", "ts_ms"))
    return rows.groupBy("container_id", "path", "pid", "role", "action_id").agg(F.min("serial").alias("first_seq"), F.min("ts_ms").alias("first_ms"))


def ipc_access(events: DataFrame) -> DataFrame:
    """container_id, channel, role, pid, action_id, first_ms: distinct senders and receivers; events come from with_channels."""
    rows = named(events).where(F.col("syscall_name").isin(*QUEUE_CALLS))
    role = F.when(F.col("syscall_name").isin("msgsnd", "mq_timedsend"), "sender").otherwise("receiver")
    return rows.where("channel is not null and channel <> ''").groupBy("container_id", "channel", role.alias("role"), "pid", "action_id").agg(F.min("ts_ms").alias("first_ms"))


def op_counts(ops: DataFrame) -> DataFrame:
    """Facts per (container, action, pid, class, op), with the first of them."""
    return ops.groupBy("container_id", "action_id", "pid", "class", "op").agg(F.count("*").alias("n"), F.min("serial").alias("first_seq"), F.min_by("path", "serial").alias("first_path"))


def connections(events: DataFrame) -> DataFrame:
    """container_id, pid, direction, addr: distinct connects (also by sending) and listens of each process."""
    rows = named(events).where(F.col("syscall_name").isin("connect", "sendto", "bind") & F.col("addr").isNotNull())
    return rows.select("container_id", "pid", F.when(F.col("syscall_name") == "bind", "listen").otherwise("connect").alias("direction"), "addr").distinct()


def open_files(events: DataFrame) -> DataFrame:
    return named(events).where((F.col("op") == "Open") & (F.col("path") != "")).select("container_id", "pid", "path").distinct()

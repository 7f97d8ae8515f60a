"""Audit records: text lines to typed columns, and records of one serial to one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import exprs as X

HEADER = r"audit\((\d+)(?:\.(\d+))?:(\d+)\)"


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """rec_type, line of audit logs in text files, read at once or as a stream."""
    lines = (spark.readStream if stream else spark.read).text(path)
    return lines.select(F.regexp_extract("value", r"type=(\w+)", 1).alias("rec_type"), F.col("value").alias("line"))


def parse(records: DataFrame) -> DataFrame:
    """Typed fields of each record; those that its type doesn't have are null, so unused ones are pruned."""
    line = F.col("line")
    # one scan for all keys, and one for all values
    keys, values = X.fields(line)
    records = records.select("rec_type", "line", keys.alias("keys"), values.alias("values"))
    raw = lambda key: X.value_of(F.col("keys"), F.col("values"), key)
    get = lambda key: X.unquoted(raw(key))
    number = lambda key: F.coalesce(get(key).try_cast("long"), F.lit(0).cast("long"))
    hexed = lambda key: F.coalesce(X.raw_hex(get(key)), F.lit("0"))
    text = lambda key: X.hex_text(get(key), X.is_quoted(raw(key)))
    group = lambda i: F.regexp_extract(line, HEADER, i)
    millis = F.coalesce(group(2).try_cast("long"), F.lit(0).cast("long"))
    argc = F.coalesce(get("argc").try_cast("int"), F.lit(0))

    def argument(i):
        value = raw(F.concat(F.lit("a"), i.cast("string")))
        return X.hex_text(X.unquoted(value), X.is_quoted(value))

    argv = F.when((F.col("rec_type") == "EXECVE") & (argc > 0), F.transform(F.sequence(F.lit(0), F.greatest(argc - 1, F.lit(0))), argument))
    is_call, is_path = F.col("rec_type") == "SYSCALL", F.col("rec_type") == "PATH"
    return records.select(
        "rec_type", "line", group(3).try_cast("long").alias("serial"), (group(1).try_cast("long") * 1000 + millis).alias("ts_ms"),
        F.when(is_call, number("pid").cast("int")).alias("pid"), F.when(is_call, number("ppid").cast("int")).alias("ppid"),
        F.when(is_call, number("syscall").cast("int")).alias("syscall"), F.when(is_call, F.coalesce(get("success") == "yes", F.lit(False))).alias("success"),
        F.when(is_call, F.coalesce(get("exit").try_cast("long"), F.lit(-1).cast("long"))).alias("exit_value"),
        F.when(is_call, F.substring(X.decode_comm(F.coalesce(get("comm"), F.lit(""))), 1, 16)).alias("comm"), F.when(is_call, F.coalesce(text("exe"), F.lit(""))).alias("exe"),
        F.when(is_call, F.coalesce(get("subj"), F.lit(""))).alias("subj"), F.when(is_call, hexed("a0").cast("decimal(20,0)")).alias("a0"),
        *[F.when(is_call, hexed(a).cast("decimal(20,0)")).alias(a) for a in ("a1", "a2", "a3")],
        F.when(is_path, number("item").cast("int")).alias("item"), F.when(is_path, X.strip_overlay(text("name"))).alias("name"), F.when(is_path, F.coalesce(get("nametype"), F.lit(""))).alias("nametype"),
        F.when(F.col("rec_type") == "SOCKADDR", F.regexp_extract(get("saddr"), "^([0-9A-Fa-f]*)", 1)).alias("saddr"),
        F.when(F.col("rec_type") == "CWD", text("cwd")).alias("cwd"), argv.alias("argv"),
    )


def assemble(parsed: DataFrame, subject: str | None = "docker-default") -> DataFrame:
    """One row per serial that has a SYSCALL and an end record, of the subject (None: all), that succeeded or has an address.

    Records gather by serial, a handful each; nothing else is grouped.
    """
    path = F.when((F.col("rec_type") == "PATH") & ~X.is_record_noise(F.col("name")), F.struct("item", "nametype", "name"))
    call = F.when(F.col("rec_type") == "SYSCALL", F.struct("ts_ms", "pid", "ppid", "syscall", "success", "exit_value", "comm", "exe", "subj", "a0", "a1", "a2", "a3"))
    rows = parsed.where("serial is not null").groupBy("serial").agg(
        F.max(call).alias("call"), F.array_sort(F.collect_list(path)).alias("paths"), F.max("saddr").alias("saddr"), F.max("cwd").alias("cwd"),
        F.max("argv").alias("argv"), F.bool_or(F.col("rec_type") == "EOE").alias("ended"),
    )
    rows = rows.where("call is not null and ended").select("serial", "call.*", "paths", "saddr", "cwd", "argv")
    rows = rows.where((F.col("pid") > 0) & (F.col("success") | F.col("saddr").isNotNull()))
    return rows if subject is None else rows.where(F.col("subj") == subject)


def first_path(paths: str = "paths"):
    """The first path that isn't a parent's, or else the first."""
    own = F.filter(paths, lambda p: p["nametype"] != "PARENT")
    return F.coalesce(F.try_element_at(own, F.lit(1))["name"], F.try_element_at(F.col(paths), F.lit(1))["name"])


def classify(groups: DataFrame, names: DataFrame) -> DataFrame:
    """Syscall groups as events: name, cmdline, path, flags, ret, addr, fd, src_fd, dst_fd, channel; names: (syscall, syscall_name)."""
    rows = groups.join(F.broadcast(names.select("syscall", "syscall_name")), "syscall", "left").withColumn("syscall_name", F.coalesce("syscall_name", F.lit("unknown")))
    name, one = F.col("syscall_name"), first_path()
    a = {k: F.col(k).cast("long") for k in ("a1", "a2")} | {"a0": F.when(F.col("a0") < F.lit("9223372036854775808").cast("decimal(20,0)"), F.col("a0").cast("long"))}
    opens, metas = name.isin("openat", "openat2", "open", "creat"), name.isin("rename", "renameat", "renameat2", "unlink", "unlinkat", "chmod", "fchmodat", "chown", "fchownat")
    nets = name.isin("connect", "bind", "sendto", "sendmsg", "sendmmsg", "recvmsg", "recvmmsg") & F.col("saddr").isNotNull()
    flags = F.when(name.isin("openat", "openat2"), a["a2"]).when(name == "open", a["a1"]).when(name == "creat", F.lit(577)).when(metas, F.lit(0))
    channel = F.when(name == "msgget", F.concat(F.lit("sysv_mq:"), "exit_value")).when(name.isin("msgsnd", "msgrcv", "msgctl"), F.concat(F.lit("sysv_mq:"), "a0"))
    channel = channel.when(name == "mq_open", F.concat(F.lit("posix_mq:"), F.coalesce(one, F.lit(""))))
    fd = F.when(opens | name.isin("msgget", "mq_open"), F.col("exit_value")).when(nets | name.isin("msgsnd", "msgrcv", "msgctl", "mq_timedsend", "mq_timedreceive"), a["a0"])
    src = F.when(name == "sendfile", a["a1"]).when(name.isin("splice", "copy_file_range", "tee"), a["a0"])
    dst = F.when(name == "sendfile", a["a0"]).when(name.isin("splice", "copy_file_range"), a["a2"]).when(name == "tee", a["a1"])
    return rows.withColumns({
        "path": F.when(opens | metas | name.isin("execve", "execveat"), X.canonical_path(F.coalesce(one, F.lit("")))), "flags": flags.cast("long"), "ret": F.when(opens | metas, F.col("exit_value")),
        "addr": F.when(nets, X.decode_sockaddr(F.col("saddr"))["display"]), "fd": fd, "src_fd": src, "dst_fd": dst, "channel": channel, "cmdline": F.array_join("argv", " "),
    })

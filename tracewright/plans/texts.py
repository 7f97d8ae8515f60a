"""Queries over audit text: the derived events written as audit records, then parsed, assembled and classified again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators import enrich, facts, graph
from tracewright.plans import derived
from tracewright.shared import stash
from tracewright.sources import records
from tracewright.streaming import stateful, stream


def raw_records(events: DataFrame) -> DataFrame:
    """rec_type, line: a SYSCALL, an end record and, where they apply, PATH, SOCKADDR and EXECVE records of each event."""
    head = F.concat(F.lit("msg=audit("), F.expr("ts_ms div 1000"), F.lit("."), F.lpad((F.col("ts_ms") % 1000).cast("string"), 3, "0"), F.lit(":"), "serial", F.lit("): "))
    rec = lambda kind, body: F.struct(F.lit(kind).alias("rec_type"), F.concat(F.lit(f"type={kind} "), head, body).alias("line"))
    a0 = F.when(F.col("syscall").isin(42, 49, 242, 243), F.col("fd")).when(F.col("syscall") == 40, F.col("dst_fd")).when(F.col("syscall").isin(69, 70), F.substring_index("channel", ":", -1).cast("long")).otherwise(F.lit(0))
    exit_value = F.when(F.col("syscall") == 68, F.substring_index("channel", ":", -1).cast("long")).otherwise(F.col("fd"))
    a1 = F.when(F.col("syscall") == 40, F.col("src_fd")).otherwise(F.lit(0))
    ok = F.when(F.col("k") == 99, "no").otherwise("yes")
    subject = F.when(F.col("serial") % 10 == 0, "unconfined").otherwise("docker-default")
    call = F.concat(F.lit("arch=c000003e syscall="), "syscall", F.lit(" success="), ok, F.lit(" exit="), exit_value, F.lit(" a0="), F.lower(F.hex(a0)), F.lit(" a1="), F.lower(F.hex(a1)), F.lit(" a2="), F.lower(F.hex("flags")), F.lit(' a3=0 ppid='), "ppid", F.lit(" pid="), "pid", F.lit(' comm="'), "comm", F.lit('" exe="/usr/bin/'), "comm", F.lit('" subj='), subject, F.lit(' key="k"'))
    octets = F.transform(F.split(F.substring_index("addr", ":", 1), r"\."), lambda x: F.lpad(F.hex(x.cast("int")), 2, "0"))
    port = F.lpad(F.hex(F.substring_index("addr", ":", -1).cast("int")), 4, "0")
    address = F.concat(F.lit("saddr=0200"), port, F.array_join(octets, ""), F.lit("0000000000000000SADDR={saddr_fam=inet}"))
    named = F.coalesce("path", F.when(F.col("syscall") == 240, F.substring_index("channel", ":", -1)))
    words = F.split("cmdline", " ")
    args = F.concat(F.lit('argc=3 a0="'), words[0], F.lit('" a1="'), words[1], F.lit('" a2='), F.hex(F.encode(words[2], "UTF-8")))
    parts = F.array(rec("SYSCALL", call), F.when(named.isNotNull(), rec("PATH", F.concat(F.lit('item=0 name="'), named, F.lit('" inode=1 nametype=NORMAL')))), F.when(F.col("addr").isNotNull(), rec("SOCKADDR", address)), F.when(F.col("cmdline").isNotNull(), rec("EXECVE", args)), rec("EOE", F.lit("")))
    return events.select(F.inline(F.filter(parts, lambda p: p.isNotNull())))


def classified(rows: DataFrame) -> DataFrame:
    out = records.classify(rows, enrich.syscall_table(rows.sparkSession))
    return out.select("serial", "ts_ms", "pid", "ppid", "syscall", "comm", "path", "addr", "channel", F.nullif("cmdline", F.lit("")).alias("cmdline"))


def audit_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(records.assemble(records.parse(raw_records(derived.stashed(spark, sf_dir)))))


ROUNDTRIP = """SELECT serial, ts_ms, pid, ppid, syscall, comm, CASE WHEN syscall = 59 AND path IS NULL OR path LIKE '/proc/%' THEN '' ELSE path END AS path, addr, channel, cmdline
FROM ev WHERE serial % 10 <> 0 AND (k <> 99 OR addr IS NOT NULL)"""


def assemble_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.assemble(records.parse(raw_records(derived.stashed(spark, sf_dir))), None)
    return rows.select("serial", F.size("paths").alias("n_paths"), F.coalesce(F.size("argv"), F.lit(0)).alias("n_args"), "saddr", "success", "subj", F.col("a2").cast("long").alias("a2"))


ASSEMBLED = """SELECT serial, CASE WHEN path IS NULL AND syscall <> 240 OR path LIKE '/proc/%' THEN 0 ELSE 1 END AS n_paths, CASE WHEN cmdline IS NULL THEN 0 ELSE 3 END AS n_args,
CASE WHEN addr IS NOT NULL THEN '0200' || CASE WHEN addr LIKE '%:8080' THEN '1F90' ELSE '0050' END || CASE WHEN addr LIKE '127.%' THEN '7F000001' WHEN addr LIKE '0.%' THEN '00000000' ELSE '0A0000' || printf('%02X', CAST(regexp_extract(addr, '10.0.0.([0-9]+):', 1) AS INT)) END || '0000000000000000' END AS saddr,
k <> 99 AS success, CASE WHEN serial % 10 = 0 THEN 'unconfined' ELSE 'docker-default' END AS subj, CAST(flags AS BIGINT) AS a2 FROM ev WHERE k <> 99 OR addr IS NOT NULL"""


def sockaddr_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    byte = F.lpad(F.hex(k), 2, "0")
    saddr = (
        F.when(k % 6 == 0, F.concat(F.lit("020001BB0A0000"), byte, F.lit("0000000000000000")))
        .when(k % 6 == 1, F.concat(F.lit("0A0000500000000000000000000000000000FFFF0A0000"), byte))
        .when(k % 6 == 2, F.concat(F.lit("01002F746D702F"), F.hex(F.encode(F.lpad(k.cast("string"), 2, "0"), "UTF-8")), F.lit("00")))
        .when(k % 6 == 3, F.concat(F.lit("10000000"), byte, F.lit("000000")))
        .when(k % 6 == 4, F.concat(F.lit("0A0000500000000020010DB80000000000000000000000"), byte))
        .otherwise(F.concat(byte, F.lit("00")))
    )
    return derived.stashed(spark, sf_dir).select("serial", X.decode_sockaddr(saddr)["display"].alias("display"))


SOCKADDR = """SELECT serial, CASE k % 6 WHEN 0 THEN concat('10.0.0.', CAST(k AS VARCHAR), ':443') WHEN 1 THEN concat('10.0.0.', CAST(k AS VARCHAR), ':80') WHEN 2 THEN 'unix:/tmp/' || lpad(CAST(k AS VARCHAR), 2, '0')
WHEN 3 THEN 'netlink:' || CASE WHEN k = 3 THEN 'firewall' WHEN k = 9 THEN 'audit' WHEN k = 15 THEN 'kobject_uevent' WHEN k = 21 THEN 'crypto' ELSE 'unknown' END
WHEN 4 THEN concat('[2001:db8::', printf('%x', k), ']:80') ELSE CASE WHEN k = 17 THEN 'packet:raw' ELSE concat('af', CAST(k AS VARCHAR)) END END AS display FROM ev"""


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    rows = derived.stashed(spark, sf_dir).where("path is not null")
    return rows.select(
        "serial", X.canonical_path(F.concat(F.lit("/a/.//b/../.."), path, F.lit("/x/.."))).alias("canonical"), X.strip_overlay(F.concat(F.lit("/var/lib/docker/overlay2/abc/merged"), path)).alias("merged"),
        X.strip_overlay(F.concat(F.lit("/run/rootfs/overlayfs/77"), path)).alias("overlayfs"), X.is_receipt_noise(path).alias("receipt_noise"), X.is_flow_noise(path).alias("flow_noise"), X.is_graph_noise(path).alias("graph_noise"),
        X.is_baseline_sensitive(path).alias("sensitive"), X.short_path(path).alias("short"), X.glob_match(path, F.lit("/data/*")).alias("under_data"), X.glob_match(path, F.lit("*.json")).alias("is_json"),
    )


PATHS = """SELECT serial, path AS canonical, path AS merged, path AS overlayfs, path LIKE '/proc/%' OR path LIKE '/usr/lib/%' OR path LIKE '/usr/bin/%' AS receipt_noise, path LIKE '/proc/%' OR path LIKE '/usr/lib/%' AS flow_noise,
path LIKE '/proc/%' AS graph_noise, path IN ('/etc/passwd', '/etc/crontab') AS sensitive, path AS short, path LIKE '/data/%' AS under_data, path LIKE '%.json' AS is_json FROM ev WHERE path IS NOT NULL"""


def command_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.stashed(spark, sf_dir).where("cmdline is not null")
    k = F.col("k")
    quoted = F.concat(F.lit("<\"a\\\n&"), "cmdline", F.lit("\">"))
    command = F.concat("cmdline", F.lit(" -o /tmp/Xy9Abc"), k, F.lit(".o 10.0.0."), k, F.lit(":80"))
    return rows.select("serial", X.normal_command(command).alias("normal"), X.truncated(command, 30).alias("short"), X.decode_comm(F.hex(F.encode(F.concat("comm", F.lit("-worker")), "UTF-8"))).alias("comm"), X.process_label(F.col("comm"), F.col("pid")).alias("label"), X.raw_hex(F.concat(F.hex("pid"), F.lit("zz"))).alias("pid_back"), X.escaped(quoted).alias("dot"), X.escaped(quoted, "html").alias("html"))


COMMANDS = """SELECT serial, concat(comm, ' /tmp/job', CAST(k AS VARCHAR), ' <ADDR> -o <TMP> <ADDR>') AS normal, left(c, 27) || '...' AS short, comm || '-worker' AS comm, concat(comm, ':', CAST(pid AS VARCHAR)) AS label, CAST(pid AS VARCHAR) AS pid_back,
'<\\"a\\\\\\n&' || cmdline || '\\">' AS dot, '&lt;&quot;a\\' || chr(10) || '&amp;' || cmdline || '&quot;&gt;' AS html FROM (SELECT *, concat(cmdline, ' -o /tmp/Xy9Abc', CAST(k AS VARCHAR), '.o 10.0.0.', CAST(k AS VARCHAR), ':80') AS c FROM ev WHERE cmdline IS NOT NULL)"""


def kernel_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.kernel_transfers(derived.stashed(spark, sf_dir))


TRANSFERS = """SELECT e.container_id, e.serial, e.pid, concat('(kernel:sendfile ', coalesce(a.target, concat('fd:', CAST(src_fd AS VARCHAR))), ' → ', coalesce(b.target, concat('fd:', CAST(dst_fd AS VARCHAR))), ')') AS label, a.target AS source, b.target AS target
FROM ev e LEFT JOIN meant a ON a.serial = e.serial AND a.ask = 'source' LEFT JOIN meant b ON b.serial = e.serial AND b.ask = 'target' WHERE syscall = 40"""


def parsed_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers out of audit text: parsed, assembled, classified, and their descriptors looked up."""
    raw = raw_records(derived.stashed(spark, sf_dir))
    rows = records.classify(records.assemble(records.parse(raw), None), enrich.syscall_table(spark)).withColumn("container_id", F.lit("one")).drop("syscall_name")
    return facts.kernel_transfers(rows).select("serial", "pid", "label", "source", "target")


# what text loses: failed calls without an address, and which of the paths of an open is a process's memory
PARSED_TRANSFERS = """SELECT serial, pid, concat('(kernel:sendfile ', coalesce(source, concat('fd:', CAST(src_fd AS VARCHAR))), ' → ', coalesce(target, concat('fd:', CAST(dst_fd AS VARCHAR))), ')') AS label, source, target FROM met"""


def container_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each root's cgroup text names its container; the others get it from their ancestors."""
    procs = enrich.processes(derived.stashed(spark, sf_dir))
    name = F.concat(F.lit("0::/system.slice/docker-"), F.lpad(F.substring("container_id", 2, 9), 12, "0"), F.lit("abcdef.scope"))
    return enrich.container_of(procs.select("pid", "ppid", F.when(F.col("ppid") == 1, name).otherwise("0::/").alias("line")), hops=None)


RESOLUTION = "SELECT pid, max(id) AS container_id FROM ancestors GROUP BY pid"


def stream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a stream reads folders, so the table is picked from its folder by name
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(derived.VIEW, events=rows)


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.running_counts(stream_of(spark, sf_dir))


COUNTS = "SELECT container_id, class, op, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM ev JOIN calls ON calls.syscall = ev.syscall GROUP BY 1, 2, 3"


def stream_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.running_processes(stream_of(spark, sf_dir))


def stream_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream, late or not, by the time they carry: they meet the table of actions without state."""
    timed = enrich.action_at_time(stream_of(spark, sf_dir), derived.actions(spark), derived.GAP_MS)
    return stream.drained(timed.select("serial", "container_id", "action_id"))


def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finite stream assembled: what the watermark has passed as a stream, and the records that still wait at its end as a batch."""
    rows = stream.drained(stream.assemble(records.parse(raw_records(stream_of(spark, sf_dir)))))
    last = records.assemble(records.parse(raw_records(derived.stashed(spark, sf_dir).where(F.col("ts_ms") >= stream.waiting_from(rows)))))
    last = last.join(rows.select("serial"), "serial", "left_anti")
    return classified(rows.unionByName(last.select(rows.columns)))


def stream_assemble_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a stream as they are given out at their end records."""
    return classified(stream.drained(stateful.assemble(records.parse(raw_records(stream_of(spark, sf_dir))))))


def stream_fd_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.drained(stateful.fd_targets(stream_of(spark, sf_dir))).select("serial", "container_id", "pid", "fd", "fd_target")


def marker_stream(spark: SparkSession) -> DataFrame:
    """Starts and ends of the actions, as a stream of their own."""
    ends = F.array(F.struct(F.col("start_ms").alias("ts_ms"), F.lit("start").alias("kind")), F.struct(F.col("end_ms").alias("ts_ms"), F.lit("end").alias("kind")))
    marks = stash(derived.actions(spark).select("container_id", "action_id", F.inline(ends)), "marks")
    return spark.readStream.schema(marks.schema).parquet(marks._stash_path)


def stream_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the actions that a stream of markers declares; what still waits when both streams have ended is looked up as a batch."""
    rows = stream.drained(stateful.timed(stream_of(spark, sf_dir), marker_stream(spark), derived.GAP_MS))
    rest = derived.stashed(spark, sf_dir).join(rows.select("container_id", "serial"), ["container_id", "serial"], "left_anti")
    late = enrich.action_at_time(rest, derived.actions(spark), derived.GAP_MS).select(rows.columns)
    return rows.unionByName(late).select("serial", "container_id", "ts_ms", "action_id")


def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges out of the running state of a stream: they are those of the whole table."""
    forks, hubs = stream.running_graph(stream_of(spark, sf_dir))
    return graph.edges(forks, hubs).select("container_id", "src", "dst", "channel_type", "event_count", "first_seen", "last_seen")


EDGE_TIMES = """SELECT a.container_id, a.pid AS src, b.pid AS dst, a.channel_type, count(*) AS event_count, min(greatest(a.seen_ms, b.seen_ms)) AS first_seen, max(greatest(a.seen_ms, b.seen_ms)) AS last_seen
  FROM hubs a JOIN hubs b ON a.side = 'in' AND b.side = 'out' AND a.channel_type = b.channel_type AND a.container_id = b.container_id AND a.hub = b.hub AND a.pid <> b.pid GROUP BY 1, 2, 3, 4
  UNION ALL SELECT f.container_id, src, dst, channel_type, event_count, first_ts, first_ts FROM forks f JOIN procs p ON p.container_id = f.container_id AND p.pid = f.dst"""


RESOLVED = "SELECT serial, container_id, pid, fd, last_value(sets IGNORE NULLS) OVER (PARTITION BY container_id, pid, epoch, fd ORDER BY ts_ms, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fd_target FROM fds"


#: (query, SQL's body) by name; bodies name the expressions of the query registry.
TEXT_QUERIES = {
    "audit_parse_roundtrip": (audit_parse_roundtrip, ROUNDTRIP), "assemble_groups": (assemble_groups, ASSEMBLED), "sockaddr_decode": (sockaddr_decode, SOCKADDR), "path_functions": (path_functions, PATHS),
    "command_functions": (command_functions, COMMANDS), "kernel_transfers": (kernel_transfers, TRANSFERS), "container_resolution": (container_resolution, RESOLUTION), "stream_counts": (stream_counts, COUNTS),
    "stream_processes": (stream_processes, "SELECT container_id, pid, first_seq, n_events, exited FROM procs"),
    "stream_attribution": (stream_attribution, "SELECT serial, container_id, action_id FROM timed"),
    "stream_assemble_at_end": (stream_assemble_at_end, ROUNDTRIP), "stream_fd_resolution": (stream_fd_resolution, RESOLVED), "stream_edges": (stream_edges, EDGE_TIMES), "stream_timed": (stream_timed, "SELECT serial, container_id, ts_ms, action_id FROM timed"),
    "stream_assemble": (stream_assemble, ROUNDTRIP), "parsed_transfers": (parsed_transfers, PARSED_TRANSFERS),
}

"""Operators on small tables, and registered queries against DuckDB."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import exprs as X
from tracewright.operators import enrich, facts, graph, receipts, rules, views
from tracewright.plans import queries
from tracewright.shared import stash
from tracewright.streaming import stream

SF = "/root/testdata/sf0.001"
EVENT = "serial long, ts_ms long, container_id string, pid long, ppid long, syscall int, flags int, fd long, comm string, path string, addr string, channel string, cmdline string"
ACTION = "container_id string, action_id long, command string, start_ms long, end_ms long"


@pytest.fixture(scope="module")
def staged(spark):
    """A file is staged by one process in action 1, and sent by another in action 2."""
    rows = [
        (1, 1000, "a", 10, 1, 59, 0, None, "sh", None, None, None, "sh stage.sh"), (2, 1100, "a", 10, 1, 257, 0, 3, "sh", "/etc/passwd", None, None, None), (3, 1200, "a", 10, 1, 257, 577, 4, "sh", "/tmp/data.txt", None, None, None),
        (4, 5000, "a", 11, 1, 59, 0, None, "curl", None, None, None, "curl 10.0.0.9"), (5, 5100, "a", 11, 1, 257, 0, 3, "curl", "/tmp/data.txt", None, None, None), (6, 5200, "a", 11, 1, 42, 0, 5, "curl", None, "10.0.0.9:80", None, None),
        (7, 5300, "a", 11, 1, 40, 0, 3, "curl", None, None, None, None), (8, 5400, "a", 11, 1, 231, 0, None, "curl", None, None, None, None), (9, 5500, "a", 11, 1, 40, 0, 3, "curl", None, None, None, None),
    ]
    events = spark.createDataFrame(rows, EVENT)
    actions = spark.createDataFrame([("a", 1, "stage", 900, 2000), ("a", 2, "send", 4900, None)], ACTION)
    return events, actions


def test_actions_by_time(spark, staged):
    events, actions = staged
    got = {r.serial: r.action_id for r in enrich.action_at_time(events, actions).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(4, 10), 2)}
    times = spark.createDataFrame([(1, 899, "a"), (2, 2001, "a"), (3, 3000, "a"), (4, 900, "b"), (5, 2000, "a")], "serial long, ts_ms long, container_id string")
    assert {r.serial: r.action_id for r in enrich.action_at_time(times, actions).collect()} == {1: 1, 2: 0, 3: 2, 4: 0, 5: 1}


def test_descriptors_forget_at_exit(staged):
    got = {r.serial: r.fd_target for r in enrich.fd_targets(staged[0]).collect()}
    assert got[7] == "/tmp/data.txt" and got[9] is None
    moved = staged[0].withColumns({"src_fd": F.when(F.col("syscall") == 40, F.col("fd")), "dst_fd": F.when(F.col("syscall") == 40, F.lit(5)), "fd": F.when(F.col("syscall") != 40, F.col("fd"))})
    rows = {r.serial: r for r in facts.kernel_transfers(moved).collect()}
    assert {k: r.label for k, r in rows.items()} == {7: "(kernel:sendfile /tmp/data.txt → net:10.0.0.9:80)", 9: "(kernel:sendfile fd:3 → fd:5)"}
    assert (rows[7].source, rows[7].target, rows[9].source) == ("/tmp/data.txt", "net:10.0.0.9:80", None)
    assert {r.label for r in facts.kernel_transfers(staged[0]).collect()} == {"(kernel:sendfile)"}


def test_descriptors_of_one_long_session(spark):
    """A process of many calls is cut into slices, and each slice knows what the ones before meant."""
    rng = np.random.default_rng(6)
    calls = [(int(rng.choice([257, 42, 0, 1, 40, 231], p=[0.2, 0.1, 0.3, 0.2, 0.17, 0.03])), int(rng.integers(3, 8)), int(rng.integers(3, 8)), int(t)) for t in np.sort(rng.integers(0, 50 * 3_600_000, 3000))]
    rows = [(i, t, "a", 5 + (i % 9 == 0), 1, c, 0, fd, "x", f"/f{i}" if c == 257 else None, f"1.1.1.1:{i}" if c == 42 else None, None, None, other) for i, (c, fd, other, t) in enumerate(calls)]
    events = spark.createDataFrame(rows, EVENT + ", dst_fd long").repartition(5)
    meant, want, moved = {}, {}, {}
    for i, t, _, pid, _, c, _, fd, _, path, addr, _, _, dst in rows:
        want[i] = meant.get((pid, fd))
        if c == 40:
            moved[i] = (want[i], meant.get((pid, dst)))
        if c == 231:
            meant = {k: v for k, v in meant.items() if k[0] != pid}
        elif c in (257, 42):
            meant[pid, fd] = path or f"net:{addr}"
    assert {r.serial: r.fd_target for r in enrich.fd_targets(events).collect()} == want
    assert {r.serial: (r.source, r.target) for r in facts.kernel_transfers(events).collect()} == moved


def test_cross_action_flow_and_detections(spark, staged):
    events, actions = staged
    timed = stash(enrich.action_at_time(events, actions), "timed")
    ops = stash(facts.op_events(timed, "action_id"), "ops")
    access, procs, pids = stash(facts.file_access(timed), "files"), stash(enrich.processes(events), "procs"), receipts.action_pids(ops)
    flows = [tuple(r) for r in receipts.cross_action_flows(access, pids).collect()]
    assert flows == [("a", 2, "/tmp/data.txt", 1, 10, 11)]
    assert [(r.src, r.dst, r.channel) for r in graph.file_flow_edges(access).collect()] == [(10, 11, "file:/tmp/data.txt")]
    scores = procs.select("container_id", "pid", F.lit(1.0).alias("score"))
    found = rules.detections(ops, access, procs, facts.connections(events), facts.open_files(events), scores, rules.rule_table(spark))
    assert {(r.action_id, r.technique, r.pid) for r in found.collect()} == {(2, "T1105", 11), (2, "T1071", 11)}


def event(serial, ts, pid, ppid, syscall, comm, path=None, flags=0, fd=None, addr=None, channel=None, cmdline=None):
    return (serial, ts, "a", pid, ppid, syscall, flags, fd, comm, path, addr, channel, cmdline)


def test_facts_go_to_the_action_of_their_process(spark):
    """A process that an action left behind writes on during the next one: what it writes is the first one's, and the next one's readers get it from there."""
    rows = [
        event(1, 1000, 20, 1, 59, "sh", cmdline="sh job.sh"), event(2, 1100, 21, 20, 59, "tar", "/usr/bin/tar", cmdline="tar x"), event(3, 5100, 21, 20, 257, "tar", "/srv/late.out", 577, 4),
        event(4, 5200, 30, 1, 59, "cat", cmdline="cat"), event(5, 5300, 30, 1, 257, "cat", "/srv/late.out", 0, 3), event(6, 9000, 21, 20, 231, "tar"), event(7, 9100, 40, 1, 59, "ls", cmdline="ls"),
    ]
    events = spark.createDataFrame(rows, EVENT)
    actions = spark.createDataFrame([("a", 1, "one", 900, 2000), ("a", 2, "two", 5000, 6000)], ACTION)
    procs = stash(enrich.processes(events), "procs")
    assert {r.pid: r.exe for r in procs.collect()} == {20: None, 21: "/usr/bin/tar", 30: None, 40: None}
    at = stash(enrich.attributed(procs, actions), "at")
    routed = stash(enrich.routed(events, at), "routed")
    assert {r.serial: r.action_id for r in routed.collect()} == {1: 1, 2: 1, 3: 1, 6: 1, 4: 2, 5: 2, 7: 0}
    # processes that aren't known go by time
    lost = enrich.routed(events, at.where("pid <> 21"), actions)
    assert {r.serial: r.action_id for r in lost.collect()} == {1: 1, 2: 1, 3: 2, 6: 0, 4: 2, 5: 2, 7: 0}
    ops, access = stash(facts.op_events(routed, "action_id"), "ops"), stash(facts.file_access(routed), "files")
    pids = stash(receipts.action_pids(ops), "pids")
    flows = [tuple(r) for r in receipts.cross_action_flows(access, pids).collect()]
    assert flows == [("a", 2, "/srv/late.out", 1, 21, 30)]
    assert {(r.pid, r.first_action) for r in views.first_actions(procs, ops).collect()} == {(20, 1), (21, 1), (30, 2), (40, 0)}
    counts = receipts.process_counts(ops, receipts.process_summary(ops, procs))
    assert {(r.action_id, r.n_unique, r.n_forked, r.n_exited) for r in counts.collect()} == {(0, 1, 0, 0), (1, 2, 0, 1), (2, 1, 0, 0)}
    # a fork shows in the receipt of either process's action
    scores = procs.select("container_id", "pid", F.lit(1.0).alias("score"), F.lit(1.0).alias("initial"))
    forks, hubs = stash(graph.fork_edges(procs), "forks"), stash(graph.hub_links(access, facts.ipc_access(routed)), "hubs")
    opened, conns = facts.open_files(events), facts.connections(events)
    none = spark.createDataFrame([], "ip string, container_id string")
    diff = receipts.data_flow_diff(flows_df := receipts.cross_action_flows(access, pids), receipts.reads_by_process(access, opened, pids, flows_df), receipts.writes_by_process(access, pids), forks, hubs, pids, receipts.network_flows(conns, pids, none), receipts.preexisting_influence(forks, hubs, pids, scores))
    assert {(r.action_id, r.verb, r.subject, r.detail) for r in diff.collect()} == {(1, "fork", "20", "21"), (1, "read", "21", "/srv/late.out"), (1, "write", "21", "/srv/late.out"), (2, "flow", "30", "/srv/late.out from action 1")}
    diff = stash(diff, "diff")
    merged = {(r.action_id, r.verb, r.detail, r.comm, r.pids) for r in receipts.merged(diff, procs, pids=True).collect()}
    assert (1, "fork", "tar", "sh", "20") in merged
    found = rules.detections(ops, access, procs, conns, opened, scores, rules.rule_table(spark))
    groups = graph.action_communities(procs, forks, hubs, scores, pids)
    whole = receipts.receipts(actions, ops, receipts.process_summary(ops, procs), groups, diff, found).orderBy("action_id", "section", "nth").collect()
    one = [r.line for r in whole if r.action_id == 1]
    assert one == ["Command: one", "Duration: 1.1s | 6 events", "2 unique, 0 forked, 1 exited", "[sh:20] $ sh job.sh", "[tar:21] $ tar x", "read 21 /srv/late.out", "write 21 /srv/late.out", "fork 20 21", ". T1560 21 Archive creation (staging data): tar x"]


def test_queues_by_descriptor(spark):
    """A send names no queue but a descriptor: the queue is the one opened under it since the process's last exit."""
    rows = [
        event(1, 10, 5, 1, 240, "a", fd=7, channel="posix_mq:/jobs"), event(2, 20, 5, 1, 242, "a", fd=7), event(3, 30, 6, 1, 240, "b", fd=3, channel="posix_mq:/jobs"), event(4, 40, 6, 1, 243, "b", fd=3), event(5, 50, 6, 1, 243, "b", fd=4),
        event(6, 60, 6, 1, 231, "b"), event(7, 70, 6, 1, 243, "b", fd=3), event(8, 80, 8, 1, 69, "c", channel="sysv_mq:4"), event(9, 90, 5, 1, 257, "a", "/tmp/f", 0, 7), event(10, 99, 5, 1, 242, "a", fd=7),
    ]
    events = stash(enrich.with_channels(spark.createDataFrame(rows, EVENT).withColumn("action_id", F.lit(1).cast("long"))), "events")
    assert {r.serial: r.channel for r in events.collect()} == {1: "posix_mq:/jobs", 2: "posix_mq:/jobs", 3: "posix_mq:/jobs", 4: "posix_mq:/jobs", 5: None, 6: None, 7: None, 8: "sysv_mq:4", 9: None, 10: None}
    access = facts.ipc_access(events)
    assert {(r.channel, r.role, r.pid) for r in access.collect()} == {("posix_mq:/jobs", "sender", 5), ("posix_mq:/jobs", "receiver", 6), ("sysv_mq:4", "sender", 8)}
    assert [(r.src, r.dst, r.channel) for r in graph.ipc_flow_edges(access).collect()] == [(5, 6, "posix_mq:/jobs")]
    # a send on an unknown queue is no fact
    assert {r.serial for r in facts.op_events(events).collect()} == {1, 2, 3, 4, 6, 8, 9}


def test_labels_colours_and_order(spark):
    names = spark.createDataFrame([("a", "a", 1), ("a", "b", 2), ("a", "c", 3)], "a string, z string, n int")
    assert [r[0] for r in names.select(graph.label_of(F.col("a"), F.col("z"), F.col("n"))).collect()] == ["a", "a+b", "a+2 others"]
    scores = spark.createDataFrame([(1.0,), (0.5,), (0.1,), (0.09,)], "s double")
    assert [r[0] for r in scores.select(X.edge_colour(F.col("s"))).collect()] == ["#cc0000", "#cc8080", "#cce6e6", "#cccccc"]
    found = spark.createDataFrame([("a", 2, "T2", 1, 1), ("a", 1, "T1", 1, 1), ("a", 9, "T3", 1, 3)], "container_id string, action_id long, technique string, pid long, severity int")
    assert [r.technique for r in rules.by_severity(found).orderBy("nth").collect()] == ["T3", "T1", "T2"]


@pytest.mark.parametrize("globs", [True, False])
def test_patterns_of_a_large_rule_table(spark, globs):
    """Ten thousand rules meet paths by equality, whatever stars they have, and find what a test of each pattern finds."""
    rng = np.random.default_rng(4)
    parts = ["etc", ".ssh", "id_rsa", "a", "b_c", "100%", "log", "x.y", "logins.json", "tmp"]
    name = lambda: "".join(f"/{rng.choice(parts)}" for _ in range(rng.integers(1, 5)))
    paths = sorted({name() for _ in range(400)} | {"/home/a/.ssh/authorized_keys", "/root/.ssh/id_rsa", "ab"})
    patterns = ["*/.ssh/authorized_keys*", "*/.ssh/id_*", "*", "*a*", "/etc/*/log", "*b_c*", "a?", "/etc", "*.y", "/tmp*", "*/100%*", "/etc/*.json", "???"]
    while len(patterns) < 10_000:
        x = list(name())
        for _ in range(rng.integers(0, 3)):
            x[rng.integers(len(x))] = str(rng.choice(["*", "?"])) if globs else "*"
        patterns.append("".join(x) + ("*" if rng.random() < 0.3 else ""))
    table = rules.rule_table(spark, [("r", "open", p, "", "", f"T{i}", 1) for i, p in enumerate(patterns)])
    got = rules.touching(spark.createDataFrame([(p,) for p in paths], "path string"), table, globs)

    def fits(path, pattern):
        if globs:
            return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), path) is not None or ("*" not in pattern and "?" not in pattern and path.startswith(pattern + "/"))
        return pattern == "*" or (path.endswith(pattern[1:]) if pattern[0] == "*" else path.startswith(pattern.removesuffix("*")))

    few = set(range(13)) | {int(i) for i in rng.choice(len(patterns), 400)}
    assert {(r.path, r.rule) for r in got.collect() if r.rule in few} == {(p, i) for p in paths for i in few if fits(p, patterns[i])}
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_of_calls(spark, tmp_path):
    (tmp_path / "unistd.h").write_text("#ifndef X\n#define __NR_read 0\n# define __NR_statx\t332\n#define OTHER 5\n#endif\n")
    names = enrich.syscall_names(spark, str(tmp_path / "unistd.h"))
    assert names == {0: "read", 332: "statx"}
    assert {r.syscall_name for r in enrich.syscall_table(spark, names).collect()} == {"read", "statx"}


def test_containers_of_processes(spark):
    rows = [(5, 1, "0::/system.slice/docker-0123456789abcdef.scope"), (6, 5, "0::/"), (7, 6, "0::/"), (8, 99, "0::/"), (9, 1, "1:name=x:/docker/fedcba9876543210"), (10, 9, "0::/buildkit/docker-aaaaaaaaaaaa.scope")]
    table = spark.createDataFrame(rows, "pid int, ppid int, line string")
    assert {r.pid: r.container_id for r in enrich.container_of(table).collect()} == {5: "0123456789ab", 6: "0123456789ab", 7: "0123456789ab", 8: None, 9: "fedcba987654", 10: "fedcba987654"}
    # with a single container, all others are its own
    assert {r.pid: r.container_id for r in enrich.container_of(table.where("pid in (5, 8)")).collect()} == dict.fromkeys((5, 8), "0123456789ab")
    # ten hops and no more; pids of another host are others
    chain = spark.createDataFrame([(h, i, i - 1, f"0::/docker/{h * 12}" if i == 1 else "0::/") for h in "ab" for i in range(1, 14)] + [("b", 50, 1, "0::/docker/cccccccccccc"), ("a", 50, 1, "0::/docker/dddddddddddd")], "host string, pid int, ppid int, line string")
    got = {(r.host, r.pid): r.container_id for r in enrich.container_of(chain).collect()}
    assert [got["a", i] for i in (1, 2, 11, 12, 13)] == ["a" * 12] * 3 + [None] * 2 and [got["b", i] for i in (7, 12, 50)] == ["b" * 12, None, "c" * 12]
    # or however far up, in circles too; two containers, so that nothing is told by exclusion
    ring = spark.createDataFrame([("a", 70, 71, "0::/"), ("a", 71, 70, "0::/"), ("a", 72, 72, "0::/")], chain.schema)
    far = {(r.host, r.pid): r.container_id for r in enrich.container_of(chain.union(ring), hops=None).collect()}
    assert [far[h, i] for h in "ab" for i in (1, 11, 12, 13)] == ["a" * 12] * 4 + ["b" * 12] * 4 and [far["a", i] for i in (50, 70, 72)] == ["d" * 12, None, None]


def test_policy_and_paths(spark):
    rows = [(1, 257, 3, True), (2, 257, -2, False), (3, 59, None, False), (4, 0, 3, True)]
    table = spark.createDataFrame(rows, "serial int, syscall int, fd long, success boolean")
    assert {r.serial for r in enrich.audited(table).collect()} == {r.serial for r in enrich.audited(table.drop("success")).collect()} == {1, 3}
    paths = spark.createDataFrame([("/a",), ("/b",), ("/a",)], "p string").select(X.path_id(F.col("p"))).collect()
    assert paths[0] == paths[2] != paths[1]


def test_export(spark, tmp_path):
    status = spark.createDataFrame([("a", 5, 1), ("b", 5000, 1), ("c", 5, 0)], "container_id string, n_processes long, n_actions long")
    lines = spark.createDataFrame([("a", "x"), ("b", "y")], "container_id string, line string")
    views.export(status, {"lines": lines}, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/lines").collect()[0].line == "x" and spark.read.json(f"{tmp_path}/containers").count() == 1


def test_stream_that_goes_on(spark, tmp_path):
    """A query on a trigger picks up what comes; its partial rows merge to the counts of all of it."""
    source, at = str(tmp_path / "in"), str(tmp_path / "state")
    spark.range(5).write.parquet(source)
    rows = spark.readStream.schema("id long").parquet(source)
    count = lambda c, name: lambda df: df.groupBy().agg(F.sum(c).alias(name))
    query, store = stream.follow(rows, lambda b: b.groupBy().agg(F.count("*").alias("n")), count("n", "n"), at, processingTime="100 milliseconds")
    try:
        query.processAllAvailable()
        spark.range(7).write.mode("append").parquet(source)
        query.processAllAvailable()
    finally:
        query.stop()
    assert store.read().first().n == 12


def test_receipt_sink_and_removal(spark, tmp_path):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "container_id string, n int")
    views.write_receipts({"lines": table}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/lines").where("container_id = 'b'").count() == 2
    assert [tuple(r) for r in views.without_containers({"t": table}, ["b"])["t"].collect()] == [("a", 1)]


def test_scores_spread_and_stop(spark):
    edges = spark.createDataFrame([("a", 1, 2, "fork"), ("a", 2, 3, "file"), ("a", 3, 1, "mqueue"), ("a", 3, 4, "file")], "container_id string, src long, dst long, channel_type string")
    start = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, 0.0)], "container_id string, pid long, score double")
    got = graph.propagate(start, edges)
    assert {r.pid: round(r.score, 6) for r in got.collect()} == {1: 1.0, 2: 0.9, 3: 0.45, 4: 0.225}
    again = graph.propagate(got.select("container_id", "pid", "score"), edges)
    assert again.where("score > initial").isEmpty() and again.where("score < 0 or score > 1").isEmpty()


FILES = "container_id string, path string, role string, pid long, action_id long, first_seq long, first_ms long"
QUEUES = "container_id string, channel string, role string, pid long, action_id long, first_ms long"
PROCS = "container_id string, pid long, ppid long, first_seq long, first_ts long, comm string, cmdline string, exe string, exited boolean"


def random_flows(spark, seed):
    """Files and queues of two containers: hot ones, shared sets, processes on both sides."""
    rng = np.random.default_rng(seed)
    files, queues = set(), set()
    for c in "ab":
        for pid in range(60):
            kin = pid % 7
            for k in rng.choice(40, rng.integers(0, 25), replace=False):
                files.add((c, f"/d/{k if pid % 3 else kin * 5 + k % 5}", str(rng.choice(["writer", "reader", "executor", "deleter"])), pid, 1))
            for k in rng.choice(16, rng.integers(0, 16), replace=False) if pid % 4 else range(kin, kin + 11):
                queues.add((c, f"q{k}", "sender" if (pid + k) % 3 else "receiver", pid, 1))
    files = spark.createDataFrame([(*r, i, 10 * i) for i, r in enumerate(sorted(files))], FILES)
    queues = spark.createDataFrame([(*r, 7 * i) for i, r in enumerate(sorted(queues))], QUEUES)
    procs = spark.createDataFrame([(c, pid, pid // 2 if pid else None, pid + 1, pid, "x" if pid % 5 else "y", f"x {pid}", "/bin/x", False) for c in "ab" for pid in range(60)], PROCS)
    return procs, files, queues


@pytest.mark.parametrize("seed", [1, 2])
def test_factorised_graph_does_what_pairs_do(spark, seed):
    """Scores, communities and counts over hubs are those over all pairs of processes."""
    procs, files, queues = random_flows(spark, seed)
    forks, hubs = stash(graph.fork_edges(procs), "forks"), stash(graph.hub_links(files, queues), "hubs")
    pairs = stash(graph.edges(forks, hubs), "pairs")
    rows = [r.asDict() for r in pairs.collect()]
    access = [tuple(r) for r in files.collect()]
    wrote = {(c, f, p) for c, f, role, p, *_ in access if role == "writer"}
    used = {(c, f, p) for c, f, role, p, *_ in access if role in ("reader", "executor")} - wrote
    want = Counter((c, p, q) for c, f, p in wrote for d, g, q in used if (c, f) == (d, g))
    assert {(r["container_id"], r["src"], r["dst"]): r["event_count"] for r in rows if r["channel_type"] == "file"} == want
    assert {r.container_id: r.n_edges for r in graph.edge_counts(forks, hubs).collect()} == Counter(r["container_id"] for r in rows)
    # counts by groups, whatever the size from which sets are no longer listed, with a process in two groups
    at = procs.select("container_id", "pid", F.explode(F.array_distinct(F.array(F.col("pid") % 3, F.lit(1)))).alias("a"))
    to = procs.where("pid % 5 > 0").select("container_id", "pid", (F.col("pid") % 2).alias("b"))
    found = Counter((r["container_id"], r["channel_type"], a, r["dst"] % 2) for r in rows if r["channel_type"] != "fork" and r["dst"] % 5 for a in {r["src"] % 3, 1})
    for most in (0, 4):
        assert {(r.container_id, r.channel_type, r.a, r.b): r.n for r in graph.pair_counts(hubs, at, to, most).collect()} == found
    start = procs.select("container_id", "pid", F.when(F.col("pid") % 11 == 3, 1.0).otherwise(0.0).alias("score"))
    score = lambda df: {(r.container_id, r.pid): round(r.score, 9) for r in df.collect()}
    assert score(graph.propagate(start, forks, hubs)) == score(graph.propagate(start, pairs))
    strong = [(r["container_id"], r["src"], r["dst"]) for r in rows if r["channel_type"] != "fork" and r["event_count"] >= 10]
    names = {(r.container_id, r.pid): r.comm for r in procs.collect()}
    strong += [(r["container_id"], r["src"], r["dst"]) for r in rows if r["channel_type"] == "fork" and names[r["container_id"], r["src"]] == names[r["container_id"], r["dst"]]]
    links = spark.createDataFrame(strong, "container_id string, src long, dst long")
    member = lambda df: {(r.container_id, r.pid): r.community for r in df.collect()}
    assert strong and member(graph.community_members(procs, forks, hubs)) == member(graph.components(procs, links))
    some = procs.where("pid % 4 = 1").select("container_id", "pid")
    few = {(r.container_id, r.src, r.dst, r.channel_type) for r in graph.edges(forks, hubs, among=some).collect()}
    assert few == {(r["container_id"], r["src"], r["dst"], r["channel_type"]) for r in rows if r["src"] % 4 == 1 and r["dst"] % 4 == 1}
    times = {(r.container_id, r.channel_type, r.hub, r.side, r.pid): r.seen_ms for r in hubs.collect()}
    for r in rows[:: max(1, len(rows) // 40)]:
        if r["channel_type"] != "fork":
            of = {h for c, kind, h, side, p in times if (c, kind, side, p) == (r["container_id"], r["channel_type"], "in", r["src"])}
            met = [max(times[r["container_id"], r["channel_type"], h, "in", r["src"]], times[k]) for h in of if (k := (r["container_id"], r["channel_type"], h, "out", r["dst"])) in times]
            assert (r["event_count"], r["first_seen"], r["last_seen"]) == (len(met), min(met), max(met))


def test_a_hot_file_makes_no_pairs(spark):
    """Ten thousand writers and as many readers of one file: a hundred million pairs, which nobody makes."""
    n = 10_000
    ids = spark.range(2 * n).select(F.lit("a").alias("container_id"), F.lit("/d/hot").alias("path"), F.when(F.col("id") < n, "writer").otherwise("reader").alias("role"), F.col("id").alias("pid"), F.lit(1).cast("long").alias("action_id"), F.col("id").alias("first_ms"))
    queues = ids.select("container_id", F.lit("q").alias("channel"), F.when(F.col("pid") % 2 == 0, "sender").otherwise("receiver").alias("role"), "pid", "action_id", "first_ms")
    procs = ids.select("container_id", "pid", F.lit(None).cast("long").alias("ppid"), F.col("pid").alias("first_seq"), F.col("pid").alias("first_ts"), F.lit("x").alias("comm"))
    forks, hubs = stash(graph.fork_edges(procs), "forks"), stash(graph.hub_links(ids, queues), "hubs")
    start = procs.select("container_id", "pid", F.when(F.col("pid") == 4, 1.0).otherwise(0.0).alias("score"))
    got = graph.propagate(start, forks, hubs)
    # an even writer's score goes to all readers by the file, and to all odd ones by the queue, from where odd writers pass it on
    assert {(r.kind, r.score): r["count"] for r in got.groupBy((F.col("pid") % 2 + 2 * (F.col("pid") >= n).cast("int")).alias("kind"), F.round("score", 6).alias("score")).count().collect()} == {(0, 1.0): 1, (0, 0.0): n // 2 - 1, (1, 0.7): n // 2, (2, 0.5): n // 2, (3, 0.7): n // 2}
    assert graph.edge_counts(forks, hubs).first().n_edges == n * n + n * n
    assert graph.community_members(procs, forks, hubs).where("community <> pid").isEmpty()


def test_counts_of_different_sets_make_no_pairs(spark):
    """Thirty thousand writers and as many readers of one file, each with another file of its own: nine hundred million pairs, of which nobody makes one to count them."""
    n = 30_000
    ids = spark.range(2 * n).withColumn("side", F.when(F.col("id") < n, "in").otherwise("out"))
    hubs = ids.select(F.lit("a").alias("container_id"), F.lit("file").alias("channel_type"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("own "), "id"))).alias("hub"), "side", F.col("id").alias("pid"))
    assert [tuple(r) for r in graph.pair_counts(stash(hubs, "hubs")).collect()] == [("a", "file", n * n)]


def test_scores_action_by_action(spark):
    """A process born after its parent was raised starts from there, which one fixpoint over all time can't tell; each action has its changes."""
    procs = spark.createDataFrame([("a", *r, f"p{r[0]}", None, None, False) for r in [(2, 1, 1, 50), (20, 1, 2, 60), (30, 1, 3, 70), (10, 1, 4, 1100), (11, 10, 5, 1150), (12, 11, 6, 1160), (21, 20, 7, 5100), (31, 30, 8, 5200), (32, 31, 9, 5300), (40, 2, 10, 9000)]], PROCS)
    files = spark.createDataFrame([("a", "/d/f", "writer", 12, 1, 1, 1200), ("a", "/d/f", "reader", 20, 1, 2, 1300), ("a", "/d/g", "writer", 32, 2, 3, 5400), ("a", "/d/g", "reader", 10, 2, 4, 1400), ("a", "/d/h", "writer", 10, 1, 5, 1500), ("a", "/d/h", "reader", 2, 1, 6, 9100)], FILES)
    queues = spark.createDataFrame([], QUEUES)
    actions = spark.createDataFrame([("a", 1, "one", 1000, 2000), ("a", 2, "two", 5000, 6000)], ACTION)
    forks = graph.fork_edges(procs)
    got = {(r.epoch, r.pid): round(r.score, 9) for r in graph.taint_by_epoch(procs, forks, files, queues, actions, 100).collect()}
    # 21 has 0.9 of what 20 was raised to; 31 and 32 come of a parent without a score; 2 gets its file after both, and 40 is born then, outside
    assert got == {(1, 2): 0.0, (1, 20): 0.405, (1, 30): 0.0, (1, 10): 1.0, (1, 11): 0.9, (1, 12): 0.81, (2, 21): 0.3645, (2, 31): 1.0, (2, 32): 0.9, (3, 2): 0.5, (3, 40): 0.45}
    at = enrich.attributed(procs, actions, 100)
    once = graph.propagate(graph.initial_scores(procs, at), forks, graph.hub_links(files, queues))
    assert {r.pid: round(r.score, 9) for r in once.where("pid in (21, 31, 32)").collect()} == {21: 0.3645, 31: 0.0, 32: 0.0}


def test_actions_that_reach_a_process(spark):
    """A daemon of the first action that takes files of two others has all three, as has what it hands on to, while scores count."""
    files = spark.createDataFrame([("a", "/d/two", "writer", 20, 2, 1, 1), ("a", "/d/two", "reader", 10, 1, 2, 2), ("a", "/d/three", "writer", 30, 3, 3, 3), ("a", "/d/three", "reader", 10, 1, 4, 4), ("a", "/d/out", "writer", 10, 1, 5, 5), ("a", "/d/out", "reader", 40, 4, 6, 6), ("a", "/d/far", "writer", 40, 4, 7, 7), ("a", "/d/far", "reader", 50, 0, 8, 8)], FILES)
    hubs = graph.hub_links(files, spark.createDataFrame([("a", "q", "sender", 50, 0, 9), ("a", "q", "receiver", 50, 0, 9), ("a", "q", "receiver", 60, 0, 9)], QUEUES))
    scores = spark.createDataFrame([("a", p, 1.0 if p < 50 else 0.0) for p in (10, 20, 30, 40, 50, 60)], "container_id string, pid long, score double")
    at = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("a", 30, 3), ("a", 40, 4), ("a", 50, 0), ("a", 60, 0)], "container_id string, pid long, action_id long")
    none = spark.createDataFrame([], "container_id string, src long, dst long, channel_type string")
    got = {}
    for r in graph.reached_by(scores, at, none, hubs).collect():
        got.setdefault(r.pid, {})[r.action_id] = round(r.score, 9)
    assert got == {10: {1: 1.0, 2: 0.5, 3: 0.5}, 20: {2: 1.0}, 30: {3: 1.0}, 40: {4: 1.0, 1: 0.5, 2: 0.25, 3: 0.25}, 50: {4: 0.5, 1: 0.25, 2: 0.125, 3: 0.125}, 60: {4: 0.35, 1: 0.175}}


def test_actions_by_gaps(spark):
    """Sessions go on over the borders of time slots, and end where nobody does anything for the gap."""
    hour = 3_600_000
    times = [hour - 20, hour - 10, hour + 90, hour + 104, hour + 204, 5 * hour, 5 * hour + 99, 9 * hour]
    rows = [(i, t, "a" if i != 7 else "b", None if i == 0 else f"c{i}") for i, t in enumerate(times)]
    got = enrich.session_actions(spark.createDataFrame(rows, "serial long, ts_ms long, container_id string, cmdline string"), 100)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "c1", hour - 20, hour + 204, 5), ("a", 2, "c5", 5 * hour, 5 * hour + 99, 2), ("b", 1, "c7", 9 * hour, 9 * hour, 1)]


def test_roots_of_a_long_chain(spark):
    """A chain of ten thousand is done in a logarithmic number of rounds; its scores are powers of the decay."""
    n, rounds = 10_000, []
    procs = spark.range(1, n + 1).select(F.lit("a").alias("container_id"), F.col("id").alias("pid"), (F.col("id") - 1).alias("ppid"), F.col("id").alias("first_seq"), F.col("id").alias("first_ts"))
    kept = enrich.stash
    enrich.stash = lambda df, tag: (rounds.append(tag), kept(df, tag))[1]
    try:
        got = enrich.roots(procs)
    finally:
        enrich.stash = kept
    assert len(rounds) <= 16 and got.where("root_pid <> 1 or depth <> pid - 1").isEmpty() and got.count() == n
    scores = {r.pid: r.score for r in graph.initial_scores(procs, got.withColumn("action_id", F.lit(1).cast("long"))).where("pid < 5").collect()}
    assert {k: round(v, 9) for k, v in scores.items()} == {1: 0.0, 2: 1.0, 3: 0.9, 4: 0.81}


def test_compressed_lists(spark):
    paths = [f"/d/f{i:03d}.txt" for i in range(100, 110)] + ["/e/a", "/e/b", "/s/secret_1"] + [f"/m/{c}" for c in "abcdefg"] + ["/g/x1", "/g/x3", "/g/x9"]
    df = spark.createDataFrame([(1, p) for p in paths] + [(2, "/d/only")], "pid long, path string")
    got = {r.pid: r.files for r in receipts.compressed(df, "pid").collect()}
    assert got == {1: "/d/f{100..109}.txt, /e/{a,b}, /g/{x1,x3,x9}, /m/{a,b,... g} (7 files), /s/secret_1", 2: "/d/only"}


def test_boundaries_and_owners(spark):
    marks = spark.createDataFrame([("a", 10, "start", "x"), ("a", 20, "end", None), ("a", 30, "start", "y")], "container_id string, ts_ms long, kind string, command string")
    assert sorted(tuple(r) for r in enrich.pair_boundaries(marks).collect()) == [("a", 1, "x", 10, 20), ("a", 2, "y", 30, None)]
    claims = spark.createDataFrame([("1.1.1.1", "a", False, 1), ("1.1.1.1", "b", False, 2), ("2.2.2.2", "a", False, 1), ("2.2.2.2", "c", True, 5)], "ip string, container_id string, explicit boolean, ts_ms long")
    assert {tuple(r) for r in enrich.ip_owner(claims).collect()} == {("1.1.1.1", "a"), ("2.2.2.2", "c")}


ORACLES = [
    "derived_events", "op_events", "process_table", "action_at_time", "attributed_action", "fd_resolution", "file_access", "ipc_access", "file_flow_edges", "taint_scores", "cross_action_flows", "network_flows",
    "receipts", "receipt_text", "communities", "action_communities", "rule_detections", "event_rule_globs", "session_actions", "legend", "experiment_receipt", "reached_by_actions", "detections_by_severity", "data_flow_diff", "preexisting_influence", "edge_times", "kernel_transfers", "parsed_transfers", "audit_parse_roundtrip", "sockaddr_decode", "path_functions", "container_resolution", "stream_counts", "stream_processes", "stream_attribution", "stream_assemble_at_end", "stream_fd_resolution", "stream_edges", "stream_assemble", "experiment_graph",
]


@pytest.mark.parametrize("name", ORACLES)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    want = sorted((tuple(dict(zip(rel.columns, r))[c] for c in got.columns) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_counted_flows_are_those_of_the_rows(spark):
    """flow_counts has the numbers of the rows that data_flow_diff makes, with processes in two actions and edges within one."""
    procs, files, queues = random_flows(spark, 3)
    forks, hubs = stash(graph.fork_edges(procs), "forks"), stash(graph.hub_links(files, queues), "hubs")
    pids = stash(procs.where("pid % 7 > 0").select("container_id", F.explode(F.array_distinct(F.array(F.col("pid") % 3, F.col("pid") % 2))).alias("action_id"), "pid"), "pids")
    scores = stash(procs.select("container_id", "pid", (F.col("pid") % 10 / 10).alias("score"), F.when(F.col("pid") % 4 == 1, 0.0).otherwise(F.col("pid") % 10 / 10).alias("initial")), "scores")
    flows = spark.createDataFrame([("a", 1, "/f", 2, 5)], "container_id string, action_id long, path string, writer_action long, pid long")
    reads = spark.createDataFrame([("a", 1, 5, "/g"), ("b", 2, 5, "/g"), ("b", 2, 8, "/g")], "container_id string, action_id long, pid long, path string")
    network = spark.createDataFrame([("a", 1, 5, "connect", "1.1.1.1:1", None), ("a", 1, 5, "listen", "0.0.0.0:1", None)], "container_id string, action_id long, pid long, direction string, addr string, owner string")
    rows = receipts.data_flow_diff(flows, reads, reads, forks, hubs, pids, network, receipts.preexisting_influence(forks, hubs, pids, scores))
    want = Counter((r.container_id, r.action_id, r.verb) for r in rows.collect())
    got = receipts.flow_counts(flows, reads, reads, forks, hubs, pids, network, scores)
    assert {(r.container_id, r.action_id, r.verb): r.n for r in got.collect()} == want
    assert {"influence", "mqueue", "fork"} <= {v for *_, v in want}


def shuffled(spark, df):
    """df's rows, and how many bytes it took to shuffle for them."""
    def total():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before, rows = total(), df.collect()
    return rows, total() - before


@pytest.mark.parametrize("few", [0, 2, 16])
def test_pairs_of_processes_with_few_and_many_hubs(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_HUBS", few)
    monkeypatch.setattr(graph, "PAIRED", 3)
    rng = np.random.default_rng(5)
    links = {("c", t, f"/h{h:02}", s, int(p)) for t in ("file", "mqueue") for s in ("in", "out") for p in range(12) for h in rng.choice(20, rng.integers(1, 7), replace=False)}
    links = [(*x, int(rng.integers(0, 100))) for x in sorted(links)]
    hubs = spark.createDataFrame(links, "container_id string, channel_type string, hub string, side string, pid long, seen_ms long")
    met = {}
    for _, t, h, s, p, a in links:
        for _, t2, h2, s2, p2, b in links:
            if (s, s2) == ("in", "out") and (t, h) == (t2, h2) and p != p2:
                met.setdefault((p, p2, t), []).append((h, max(a, b)))
    want = {(p, p2, t, ("file:" if t == "file" else "") + min(x)[0], len(x), min(m for _, m in x), max(m for _, m in x)) for (p, p2, t), x in met.items()}
    got = graph.pairs_of(hubs).select("src", "dst", "channel_type", "channel", "event_count", "first_seen", "last_seen").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    got = graph.pairs_of(hubs, timed=False).select("src", "dst", "channel_type", "channel", "event_count").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == {w[:5] for w in want}


def test_pairs_are_not_shuffled(spark):
    """Six hundred writers and as many readers of a file make 360 000 edges; what is shuffled goes with the accesses, not with the edges."""
    hubs = spark.range(1200).select(F.lit("c").alias("container_id"), F.lit("file").alias("channel_type"), F.lit("/f").alias("hub"), F.when(F.col("id") < 600, "in").otherwise("out").alias("side"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("pid"), F.col("id").alias("seen_ms"))
    rows, size = shuffled(spark, graph.pairs_of(hubs).agg(F.count("*"), F.sum("event_count")))
    assert tuple(rows[0]) == (360_000, 360_000) and size < 600_000


def test_flows_between_processes_are_not_shuffled(spark):
    """Four hundred processes of action 1 and as many of action 2: one side writes a file and sends to a queue, the other reads and receives."""
    n = 400
    procs = spark.range(2 * n).select(F.lit("c").alias("container_id"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("pid"), F.when(F.col("id") < n, 1).otherwise(2).cast("long").alias("action_id"), F.col("id").alias("first_ms"))
    procs = stash(procs, "many")
    role = lambda a, b: F.when(F.col("action_id") == 1, a).otherwise(b).alias("role")
    files = procs.select("*", F.lit("/f").alias("path"), role("writer", "reader"), F.col("first_ms").alias("first_seq"))
    hubs, pids = graph.hub_links(files.limit(0), procs.select("*", F.lit("q").alias("channel"), role("sender", "receiver"))), procs.select("container_id", "action_id", "pid")
    rows, size = shuffled(spark, receipts.cross_action_flows(files, pids).agg(F.count("*"), F.count_distinct("writer"), F.count_distinct("pid")))
    assert tuple(rows[0]) == (n * n, n, n) and size < 1_000_000
    by_action = receipts.cross_action_flows(files, pids, False)
    explained = receipts.explained_reads(files, pids)
    assert sorted(map(tuple, explained.collect())) == sorted({(r.container_id, r.action_id, r.pid, r.path) for r in by_action.collect()}) and explained.count() == n
    none = lambda schema: spark.createDataFrame([], schema)
    forks = none("container_id string, src long, dst long, channel_type string, channel string, event_count long, seen_ms long")
    reads, network = none("container_id string, action_id long, pid long, path string"), none("container_id string, action_id long, pid long, direction string, addr string, owner string")
    influence = none("container_id string, action_id long, src long, dst long, channel_type string")
    diff = receipts.data_flow_diff(by_action.limit(0), reads, reads, forks, hubs, pids, network, influence)
    rows, size = shuffled(spark, diff.groupBy("action_id").agg(F.count("*").alias("n")))
    assert {r.action_id: r.n for r in rows} == {1: n * n, 2: n * n} and size < 1_000_000


def test_merged_flows_count_queues_without_pairs(spark):
    """Lines over queues merged by counts are those merged out of rows, with processes on both sides, in two actions and in none; no pairs are shuffled for them."""
    procs, files, queues = random_flows(spark, 3)
    forks, hubs = stash(graph.fork_edges(procs), "forks"), stash(graph.hub_links(files, queues), "hubs")
    pids = stash(procs.where("pid % 7 > 0").select("container_id", F.explode(F.array_distinct(F.array(F.col("pid") % 3, F.col("pid") % 2))).alias("action_id"), "pid"), "pids")
    none = lambda schema: spark.createDataFrame([], schema)
    flows, reads = none("container_id string, action_id long, path string, writer_action long, pid long"), none("container_id string, action_id long, pid long, path string")
    network, influence = none("container_id string, action_id long, pid long, direction string, addr string, owner string"), none("container_id string, action_id long, src long, dst long, channel_type string")
    diff = lambda h: receipts.data_flow_diff(flows, reads, reads, forks, h, pids, network, influence)
    want = sorted(map(tuple, receipts.merged(diff(hubs), procs, pids=True).collect()))
    got = receipts.merged(diff(None), procs, pids=True, queued=receipts.queue_lines(hubs, pids, procs))
    assert sorted(map(tuple, got.collect())) == want and any(w[3] == "mqueue" for w in want)
    n = 400
    many = stash(spark.range(2 * n).select(F.lit("c").alias("container_id"), "id", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("pid"), F.lit("sh").alias("comm")), "many")
    hubs = many.select("container_id", F.lit("mqueue").alias("channel_type"), F.lit("q").alias("hub"), F.when(F.col("id") < n, "in").otherwise("out").alias("side"), "pid", F.col("id").alias("seen_ms"))
    rows, size = shuffled(spark, receipts.merged(diff(None).limit(0), many, queued=receipts.queue_lines(hubs, many.select("container_id", "pid", F.lit(1).cast("long").alias("action_id")), many)))
    assert [r.n for r in rows] == [n * n] and size < 1_000_000


def test_best_pairs_of_hubs_are_not_sorted(spark):
    """The two largest scores of two processes, also where scores tie or a process came before with a smaller one; plans sort no rows that come."""
    came = [("h", 1, 0.5), ("h", 1, 0.9), ("h", 2, 0.9), ("h", 3, 0.9), ("g", 4, 0.3), ("g", 4, 0.2), ("f", 5, 0.4), ("f", 6, 0.7), ("f", 6, 0.1), ("f", 7, 0.6)]
    got = graph.best_pairs(spark.createDataFrame(came, "hub string, by long, score double"), ["hub"])
    rows = {h: sorted((r.score, r.by) for r in got.collect() if r.hub == h) for h in "hgf"}
    assert [s for s, _ in rows["h"]] == [0.9, 0.9] and len({p for _, p in rows["h"]}) == 2 and rows["g"] == [(0.3, 4)] and rows["f"] == [(0.6, 7), (0.7, 6)]
    assert "Window" not in got._jdf.queryExecution().toString()


def test_lines_between_processes_are_numbered_without_sorting_them(spark):
    """A receipt's lines over queues, forks and influence stand where sorting puts them, with processes on both sides, in two actions and in none, and
    pids of few and many digits; what is shuffled goes with the accesses."""
    wide = lambda df, *names: df.withColumns({c: F.when(F.col(c) % 3 == 0, F.col(c) * 1000).otherwise(F.col(c)) for c in names})
    procs, files, queues = random_flows(spark, 3)
    procs, files, queues = stash(wide(procs, "pid", "ppid"), "procs"), wide(files, "pid"), wide(queues, "pid")
    forks, hubs = stash(graph.fork_edges(procs), "forks"), stash(graph.hub_links(files, queues), "hubs")
    pids = stash(procs.where("pid % 7 > 0").select("container_id", F.explode(F.array_distinct(F.array(F.col("pid") % 3, F.col("pid") % 2))).alias("action_id"), "pid"), "pids")
    scores = stash(procs.select("container_id", "pid", (F.col("pid") % 10 / 10).alias("score"), F.when(F.col("pid") % 4 == 1, 0.0).otherwise(F.col("pid") % 10 / 10).alias("initial")), "scores")
    flows = spark.createDataFrame([("a", 1, "/f", 2, 5)], "container_id string, action_id long, path string, writer_action long, pid long")
    reads = spark.createDataFrame([("a", 1, 5, "/g"), ("b", 2, 5, "/g"), ("b", 2, 8, "/g")], "container_id string, action_id long, pid long, path string")
    network = spark.createDataFrame([("a", 1, 5, "connect", "1.1.1.1:1", None), ("a", 1, 5, "listen", "0.0.0.0:1", None)], "container_id string, action_id long, pid long, direction string, addr string, owner string")
    none = lambda schema: spark.createDataFrame([], schema)
    actions = spark.createDataFrame([("a", 1, "one", 1, 2), ("b", 2, "two", 1, 2)], ACTION)
    ops, summary = none("container_id string, action_id long, class string, op string"), none("container_id string, action_id long, command string, n long, first_seq long, pid long, name string, cmdline string")
    groups, found = none("container_id string, action_id long, community_id long, size long, label string"), none("container_id string, action_id long, technique string, pid long, severity int, description string")
    whole = receipts.data_flow_diff(flows, reads, reads, forks, hubs, pids, network, receipts.preexisting_influence(forks, hubs, pids, scores))
    want = sorted(map(tuple, receipts.receipts(actions, ops, summary, groups, whole, found).collect()))
    alone = receipts.data_flow_diff(flows, reads, reads, forks, None, pids, network, None)
    got = receipts.receipts(actions, ops, summary, groups, alone, found, receipts.placed_lines(forks, hubs, pids, scores))
    assert sorted(map(tuple, got.collect())) == want
    assert {"fork", "mqueue", "influence", "flow", "listen"} <= {w[4].split()[0] for w in want}
    text = receipts.receipt_text(alone, receipts.placed_lines(forks, hubs, pids, scores))
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, receipts.receipt_text(whole).collect()))
    n = 600
    many = stash(spark.range(2 * n).select(F.lit("c").alias("container_id"), "id", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("pid"), F.when(F.col("id") < n, 1).otherwise(2).cast("long").alias("action_id")), "many")
    hubs = many.select("container_id", F.lit("mqueue").alias("channel_type"), F.lit("q").alias("hub"), F.when(F.col("id") < n, "in").otherwise("out").alias("side"), "pid", F.col("id").alias("seen_ms"))
    between = receipts.placed_lines(forks.limit(0), hubs, many.select("container_id", "action_id", "pid"), scores.limit(0))
    rows, size = shuffled(spark, receipts.receipts(actions, ops, summary, groups, alone.limit(0), found, between).where("section = 3").groupBy("action_id").agg(F.count("*").alias("n"), F.max("nth").alias("last")))
    assert {r.action_id: (r.n, r.last) for r in rows} == {1: (n * n, n * n), 2: (n * n, n * n)} and size < 1_000_000


def test_epochs_are_counted_without_time_slots(spark):
    """A row's epoch counts the actions that have ended before it, with an open one and containers without any; slots of time aren't listed, and a row's own action stays."""
    actions = spark.createDataFrame([("a", 1, "one", 1000, 2000), ("a", 2, "two", 5000, 6000), ("b", 1, "one", 1000, None)], ACTION)
    rows = spark.createDataFrame([("a", 0, 9), ("a", 2000, 9), ("a", 2001, 9), ("a", 6000, 9), ("a", 6001, 9), ("b", 1, 9), ("b", 9000, 9), ("c", 5, 9)], "container_id string, first_ms long, action_id long")
    got = graph.epochs_of(rows, actions, "first_ms")
    assert sorted((r.container_id, r.first_ms, r.epoch, r.action_id) for r in got.collect()) == [("a", 0, 1, 9), ("a", 2000, 1, 9), ("a", 2001, 2, 9), ("a", 6000, 2, 9), ("a", 6001, 3, 9), ("b", 1, 1, 9), ("b", 9000, 1, 9), ("c", 5, 1, 9)]
    assert "Generate" not in got._jdf.queryExecution().toString()


def test_drawn_edges_of_processes_with_other_columns(spark):
    """Processes asked for may have columns of any name, labels and scores say: edges among them are the same, and are drawn."""
    procs, files, queues = random_flows(spark, 3)
    forks, hubs = stash(graph.fork_edges(procs), "forks"), stash(graph.hub_links(files, queues), "hubs")
    nodes = procs.where("pid % 4 = 1").select("container_id", "pid", F.lit("x").alias("label"), F.lit(0).alias("hub"), F.lit(0.5).alias("score"), F.lit("c").alias("colour"))
    want = sorted(map(tuple, graph.edges(forks, hubs, among=nodes.select("container_id", "pid")).collect()))
    assert sorted(map(tuple, graph.edges(forks, hubs, among=nodes).collect())) == want != []
    drawn = views.graph_edges(graph.edges(forks, hubs, among=nodes), nodes)
    assert sorted((r.container_id, r.src, r.dst, r.channel_type) for r in drawn.collect()) == [w[:4] for w in want] and {r.colour for r in drawn.collect()} == {"#cc8080"}


def test_experiment_graph_of_labelled_processes(spark):
    """The registered graph's shown processes have labels, as its edges do: those are drawn between them, beside their files and addresses."""
    procs, files, queues = random_flows(spark, 3)
    forks, hubs = stash(graph.fork_edges(procs), "forks"), stash(graph.hub_links(files, queues), "hubs")
    scores = stash(procs.select("container_id", "pid", (F.col("pid") % 10 / 10).alias("score")), "scores")
    nodes = stash(views.graph_nodes(procs, scores, procs.select("container_id", "pid", F.lit(1).cast("long").alias("action_id")), most=20), "nodes")
    conns = spark.createDataFrame([("a", 9, "connect", "10.0.0.2:80"), ("a", 59, "listen", "10.0.0.1:80")], "container_id string, pid long, direction string, addr string")
    experiments = spark.createDataFrame([("e", ["a"])], "experiment_id string, container_ids array<string>")
    owners = spark.createDataFrame([("10.0.0.2", "a")], "ip string, container_id string")
    data = views.data_edges(files, views.shown_files(files))
    got = views.experiment_graph(experiments, nodes, views.graph_edges(graph.edges(forks, hubs, among=nodes), nodes), data, conns, owners, scores).collect()
    shown = {r.pid for r in nodes.where("container_id = 'a'").collect()}
    every = {(str(r.src), str(r.dst), r.channel_type) for r in graph.edges(forks, hubs).where("container_id = 'a'").collect() if {r.src, r.dst} <= shown}
    assert {(r.source, r.target, r.label) for r in got if r.kind == "process"} == every and len(every) > 20
    assert {(r.source, r.target, r.label) for r in got if r.kind == "network"} == {("9", "10.0.0.2:80", "connect"), ("10.0.0.1:80", "59", "listen")} and {"process", "file", "network"} == {r.kind for r in got}


def test_epochs_are_those_of_all_actions(spark):
    """The registered query goes by each of the thirty actions, in code and SQL, and an epoch in which nobody is born still spreads what its accesses bring."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["taint_epochs"]).fetchall())
    got = queries.queries()["taint_epochs"](spark, SF).select("container_id", "epoch", "pid", "score")
    assert sorted(map(tuple, got.collect())) == want and max(w[1] for w in want) > 20
    procs = spark.createDataFrame([("a", 5, None, 1, 10, "x", None, None, False), ("a", 6, None, 2, 20, "x", None, None, False), ("a", 7, None, 3, 30, "x", None, None, False)], PROCS)
    files = spark.createDataFrame([("a", "/d/f", "writer", 6, 1, 4, 40), ("a", "/d/f", "reader", 7, 1, 5, 5400), ("a", "/d/f", "reader", 5, 1, 6, 5500), ("a", "/d/g", "reader", 5, 1, 7, 50), ("a", "/d/g", "writer", 5, 1, 8, 9100), ("a", "/d/g", "writer", 6, 1, 9, 9200)], FILES)
    actions = spark.createDataFrame([("a", 1, "one", 15, 100), ("a", 2, "two", 5000, 6000), ("a", 3, "three", 9000, 9500)], ACTION)
    rows = graph.taint_by_epoch(procs, graph.fork_edges(procs), files, spark.createDataFrame([], QUEUES), actions, 1)
    # 5, the first of all, gets /d/f in the second epoch; nothing of /d/g in the third, as it has written that itself by then
    assert sorted((r.epoch, r.pid, r.score) for r in rows.collect()) == [(1, 5, 0.0), (1, 6, 1.0), (1, 7, 1.0), (2, 5, 0.5)]


def test_removed_containers_leave_nothing_behind(spark):
    """The removed containers' events are gone before anything is made of them, and so is what the kept tables were made of; the rows are the SQL's."""
    from tracewright.shared import shared_dir

    folder = f"{shared_dir(spark)}/tracewright"
    there = lambda: {n for n in os.listdir(folder) if n.rsplit("-", 1)[0] in ("events", "routed", "attributed", "files", "queues")} if os.path.isdir(folder) else set()
    con, before = duckdb.connect(), there()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rel = con.sql(queries.oracle_sql()["removed_containers"])
    got = queries.queries()["removed_containers"](spark, SF).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)
    assert there() == before

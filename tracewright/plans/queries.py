"""The registered queries over the derived audit view, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.operators import enrich, facts, graph, receipts, rules, views
from tracewright.plans import derived, texts
from tracewright.shared import discard, stash


class Tables:
    """The operators' tables for one input, each made when it is asked for, and made once.

    Those that several others are made of are stashed. ``until``: time after which nothing is seen.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, until: int | None = None):
        self.spark, self.sf_dir, self.until = spark, sf_dir, until
        self.made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["made"]
        if name not in made:
            df = MAKERS[name](self)
            made[name] = stash(df, name) if name in SHARED else df
        return made[name]


def events_of(t: Tables) -> DataFrame:
    rows = derived.events(t.spark, t.sf_dir)
    return rows if t.until is None else rows.where(F.col("ts_ms") <= t.until)


#: Silence after which a container's next event begins an action of its own.
SESSION_GAP_MS = 1_800_000

SHARED = {"events", "procs", "attributed", "routed", "ops", "files", "queues", "hubs", "forks", "pids", "conns", "opened", "scores", "action_flows", "found", "groups_of_actions"}

MAKERS: dict[str, Callable[[Tables], DataFrame]] = {
    "events": events_of,
    "actions": lambda t: derived.actions(t.spark),
    "owners": lambda t: derived.owners(t.spark),
    "experiments": lambda t: derived.experiments(t.spark),
    "timed": lambda t: enrich.action_at_time(t.events, t.actions, derived.GAP_MS),
    "procs": lambda t: enrich.processes(t.events),
    "attributed": lambda t: enrich.attributed(t.procs, t.actions, derived.GAP_MS),
    # facts belong to their process's action, whenever they happen
    "routed": lambda t: enrich.with_channels(enrich.routed(t.events, t.attributed)),
    "ops": lambda t: facts.op_events(t.routed, "action_id"),
    "files": lambda t: facts.file_access(t.routed),
    "queues": lambda t: facts.ipc_access(t.routed),
    "conns": lambda t: facts.connections(t.events),
    "opened": lambda t: facts.open_files(t.events),
    "pids": lambda t: receipts.action_pids(t.ops),
    "forks": lambda t: graph.fork_edges(t.procs),
    "hubs": lambda t: graph.hub_links(t.files, t.queues),
    "edges": lambda t: graph.edges(t.forks, t.hubs),
    "initial": lambda t: graph.initial_scores(t.procs, t.attributed),
    "scores": lambda t: graph.propagate(t.initial, t.forks, t.hubs),
    "sessions": lambda t: enrich.session_actions(t.events, SESSION_GAP_MS),
    "members": lambda t: graph.community_members(t.procs, t.forks, t.hubs),
    "groups": lambda t: graph.communities(t.procs, t.members, t.scores),
    "flows": lambda t: receipts.cross_action_flows(t.files, t.pids),
    "action_flows": lambda t: receipts.cross_action_flows(t.files, t.pids, False),
    "reads": lambda t: receipts.reads_by_process(t.files, t.opened, t.pids, receipts.explained_reads(t.files, t.pids)),
    "writes": lambda t: receipts.writes_by_process(t.files, t.pids),
    "network": lambda t: receipts.network_flows(t.conns, t.pids, t.owners),
    "influence": lambda t: receipts.preexisting_influence(t.forks, t.hubs, t.pids, t.scores),
    "found": lambda t: rules.detections(t.ops, t.files, t.procs, t.conns, t.opened, t.scores, rules.rule_table(t.spark)),
    "status": lambda t: views.container_status(t.procs, graph.edge_counts(t.forks, t.hubs), t.actions),
    "nodes": lambda t: views.graph_nodes(t.procs, t.scores, t.attributed),
    "drawn": lambda t: views.graph_edges(graph.edges(t.forks, t.hubs, among=t.nodes), t.nodes),
    "shown": lambda t: views.shown_files(t.files),
    "diff": lambda t: receipts.data_flow_diff(t.action_flows, t.reads, t.writes, t.forks, t.hubs, t.pids, t.network, t.influence),
    # without lines over queues, which are as many as pairs of processes
    "unqueued": lambda t: receipts.data_flow_diff(t.action_flows, t.reads, t.writes, t.forks, None, t.pids, t.network, t.influence),
    "flow_counts": lambda t: receipts.flow_counts(t.action_flows, t.reads, t.writes, t.forks, t.hubs, t.pids, t.network, t.scores),
    "summary": lambda t: receipts.process_summary(t.ops, t.procs),
    "groups_of_actions": lambda t: graph.action_communities(t.procs, t.forks, t.hubs, t.scores, t.pids),
    # without lines between two processes, which are placed instead of sorted
    "alone": lambda t: receipts.data_flow_diff(t.action_flows, t.reads, t.writes, t.forks, None, t.pids, t.network, None),
    "receipt": lambda t: receipts.receipts(t.actions, t.ops, t.summary, t.groups_of_actions, t.alone, t.found, receipts.placed_lines(t.forks, t.hubs, t.pids, t.scores)),
}

# DuckDB's side of the derived view and of the tables above, as common table expressions.
CTE = {
    "b": """SELECT *, CAST((ts_ms - 1704067200000) // 864000000 AS INT) AS part FROM (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id // 8 AS idx, user_id % 8 AS c, epoch_us(ts) // 1000 AS ts_ms FROM events)""",
    "t": """SELECT event_id AS serial, ts_ms, concat('c', CAST(c AS VARCHAR)) AS container_id, 1000 + user_id + 100000 * part AS pid,
  CASE WHEN idx = 0 THEN 1 ELSE 1000 + ((idx - 1) // 2) * 8 + c + 100000 * part END AS ppid, event_id % 10 AS e10, event_id % 6 AS e6,
  CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 5 = 4 THEN 231 WHEN e10 = 6 THEN 56 WHEN e10 = 7 THEN 62 WHEN e10 = 8 THEN 319 ELSE 59 END WHEN 'click' THEN CASE WHEN e6 = 5 THEN 49 ELSE 42 END
    WHEN 'purchase' THEN CASE e10 WHEN 7 THEN 82 WHEN 8 THEN 90 ELSE 257 END WHEN 'view' THEN CASE WHEN event_id % 4 = 3 THEN 40 WHEN event_id % 16 = 1 THEN 0 WHEN event_id % 16 = 5 THEN 1 ELSE 257 END
    ELSE CASE e6 WHEN 0 THEN CASE WHEN k % 25 = 24 THEN 68 ELSE 69 END WHEN 1 THEN 70 WHEN 2 THEN 87 WHEN 3 THEN 240 WHEN 4 THEN 242 ELSE 243 END END AS syscall,
  CASE WHEN event_type = 'purchase' AND e10 NOT IN (7, 8) THEN 577 ELSE 0 END AS flags, 3 + event_id % 5 AS fd,
  CASE user_id % 5 WHEN 0 THEN 'sh' WHEN 1 THEN 'curl' WHEN 2 THEN 'python3' WHEN 3 THEN 'gcc' ELSE 'nc' END AS comm, k FROM b""",
    "ev": """SELECT serial, ts_ms, container_id, pid, ppid, syscall, flags, fd, comm, k, concat('/bin/', comm) AS exe,
  CASE WHEN syscall = 59 AND k % 10 <> 9 THEN CASE WHEN k % 2 = 0 THEN '/usr/bin/' || comm END WHEN syscall NOT IN (257, 87, 82, 90, 59) THEN NULL WHEN k = 0 THEN '/etc/passwd' WHEN k = 1 THEN '/proc/1/maps'
    WHEN k = 2 THEN '/usr/lib/libc.so' WHEN k = 3 THEN '/etc/crontab' ELSE concat('/data/d', CAST(k % 10 AS VARCHAR), '/f_', lpad(CAST(k AS VARCHAR), 3, '0'), '.json') END AS path,
  CASE WHEN syscall = 42 THEN CASE WHEN k % 12 = 11 THEN '127.0.0.1:80' ELSE concat('10.0.0.', CAST(k % 12 AS VARCHAR), ':80') END WHEN syscall = 49 THEN CASE WHEN k % 3 = 0 THEN '0.0.0.0:80' ELSE '10.0.0.1:8080' END END AS addr,
  CASE WHEN syscall IN (68, 69, 70) THEN concat('sysv_mq:', CAST(k % 7 AS VARCHAR)) WHEN syscall = 240 THEN concat('posix_mq:/q', CAST(k % 3 AS VARCHAR)) END AS channel,
  CASE WHEN syscall = 59 THEN concat(comm, ' /tmp/job', CAST(k AS VARCHAR), ' http://10.0.0.', CAST(k % 12 AS VARCHAR), '/') END AS cmdline,
  CASE WHEN syscall = 40 THEN fd END AS src_fd, CASE WHEN syscall = 40 THEN 3 + serial // 5 % 5 END AS dst_fd FROM t""",
    "calls": """SELECT * FROM (VALUES (59, 'process', 'Exec'), (231, 'process', 'Exit'), (56, 'process', 'Fork'), (319, 'process', 'Fork'), (62, 'process', 'Signal'), (68, 'process', 'Signal'), (69, 'process', 'Signal'),
  (70, 'process', 'Signal'), (240, 'process', 'Signal'), (242, 'process', 'Signal'), (243, 'process', 'Signal'), (257, 'file', 'Open'), (87, 'file', 'Unlink'), (82, 'file', 'Rename'), (90, 'file', 'Chmod'),
  (0, 'file', 'Read'), (1, 'file', 'Write'), (40, 'transfer', 'Read'), (42, 'net', 'Connect'), (49, 'net', 'Bind')) v(syscall, class, op)""",
    "fds": """SELECT *, CASE WHEN syscall = 257 THEN path WHEN syscall IN (42, 49) THEN 'net:' || addr WHEN syscall IN (68, 240) THEN 'mq:' || channel END AS sets,
  coalesce(sum(CASE WHEN syscall = 231 THEN 1 ELSE 0 END) OVER (PARTITION BY container_id, pid ORDER BY ts_ms, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM ev""",
    "asks": "SELECT serial, container_id, pid, epoch, ts_ms, fd AS of_fd, 'fd' AS ask FROM fds WHERE syscall IN (242, 243) UNION ALL SELECT serial, container_id, pid, epoch, ts_ms, src_fd, 'source' FROM fds WHERE syscall = 40 UNION ALL SELECT serial, container_id, pid, epoch, ts_ms, dst_fd, 'target' FROM fds WHERE syscall = 40",
    "meant": """SELECT a.serial, a.ask, arg_max(s.sets, (s.ts_ms, s.serial)) AS target FROM asks a JOIN fds s ON s.sets IS NOT NULL AND s.container_id = a.container_id AND s.pid = a.pid AND s.epoch = a.epoch AND s.fd = a.of_fd
  AND (s.ts_ms < a.ts_ms OR s.ts_ms = a.ts_ms AND s.serial < a.serial) GROUP BY 1, 2""",
    "actions": """SELECT concat('c', CAST(c AS VARCHAR)) AS container_id, n AS action_id, 'day ' || n AS command,
  1704067200000 + (n - 1) * 86400000 + 3600000 AS start_ms, 1704067200000 + (n - 1) * 86400000 + 79200000 AS end_ms FROM range(8) r(c), range(1, 31) s(n)""",
    "owners": "SELECT concat('10.0.0.', CAST(c AS VARCHAR)) AS ip, concat('c', CAST(c AS VARCHAR)) AS container_id FROM range(8) r(c)",
    "members": "SELECT CASE WHEN c < 4 THEN 'exp-1' ELSE 'exp-2' END AS experiment_id, CASE WHEN c < 4 THEN 'first' ELSE 'second' END AS name, concat('c', CAST(c AS VARCHAR)) AS container_id FROM range(8) r(c)",
    "timed": """SELECT ev.*, coalesce((SELECT max(action_id) FROM actions a WHERE a.container_id = ev.container_id AND ev.ts_ms BETWEEN start_ms AND end_ms),
  (SELECT arg_min(action_id, start_ms) FROM actions a WHERE a.container_id = ev.container_id AND start_ms > ts_ms AND start_ms - ts_ms < 3600000), 0) AS action_id FROM ev""",
    "procs": """SELECT container_id, pid, min(serial) AS first_seq, arg_min(ts_ms, serial) AS first_ts, arg_min(ppid, serial) AS ppid, arg_max(comm, serial) AS comm,
  arg_max(cmdline, serial) FILTER (cmdline <> '') AS cmdline, coalesce(arg_max(coalesce(path, exe), serial) FILTER (syscall = 59), arg_max(exe, serial)) AS exe, bool_or(syscall = 231) AS exited, count(*) AS n_events FROM ev GROUP BY ALL""",
    "routed": """SELECT ev.* REPLACE (coalesce(channel, CASE WHEN m.target LIKE 'mq:%' THEN substr(m.target, 4) END) AS channel), a.action_id
  FROM ev JOIN attributed a ON a.container_id = ev.container_id AND a.pid = ev.pid LEFT JOIN meant m ON m.serial = ev.serial AND m.ask = 'fd'""",
    "ops": """SELECT container_id, serial, action_id, pid, comm, addr, class, op, path FROM (
  SELECT r.* EXCLUDE (path), CASE class WHEN 'transfer' THEN 'file' ELSE class END AS class, CASE WHEN op = 'Open' AND flags & 579 <> 0 THEN 'OpenWrite' ELSE op END AS op, CASE WHEN class = 'file' THEN path END AS path
    FROM routed r JOIN calls c ON c.syscall = r.syscall WHERE r.syscall NOT IN (69, 70, 242, 243) OR channel IS NOT NULL
  UNION ALL SELECT r.* EXCLUDE (path), 'file', 'Exec', path FROM routed r WHERE syscall = 59)""",
    "files": """SELECT container_id, path, role, pid, action_id, first_seq, first_ms FROM (
  SELECT *, min(first_seq) FILTER (role = 'writer') OVER (PARTITION BY container_id, path, pid) AS written FROM (
    SELECT container_id, path, pid, action_id, CASE WHEN syscall = 87 THEN 'deleter' WHEN syscall IN (82, 90) THEN 'modifier' WHEN syscall = 59 THEN 'executor' WHEN flags & 579 <> 0 THEN 'writer' ELSE 'reader' END AS role, min(serial) AS first_seq, min(ts_ms) AS first_ms
    FROM (SELECT container_id, path, pid, action_id, syscall, flags, serial, ts_ms FROM routed WHERE path IS NOT NULL
      UNION ALL SELECT container_id, target, pid, action_id, 257, 0, r.serial, r.ts_ms FROM routed r JOIN meant m ON m.serial = r.serial AND m.ask = 'source' WHERE target LIKE '/%') GROUP BY ALL)) WHERE role <> 'reader' OR written IS NULL OR first_seq < written""",
    "queues": "SELECT container_id, channel, CASE WHEN syscall IN (69, 242) THEN 'sender' ELSE 'receiver' END AS role, pid, action_id, min(ts_ms) AS first_ms FROM routed WHERE channel IS NOT NULL AND syscall IN (69, 70, 242, 243) GROUP BY ALL",
    "conns": "SELECT DISTINCT container_id, pid, CASE syscall WHEN 42 THEN 'connect' ELSE 'listen' END AS direction, addr FROM ev WHERE syscall IN (42, 49)",
    "opened": "SELECT DISTINCT container_id, pid, path FROM ev WHERE syscall = 257",
    "pids": "SELECT DISTINCT container_id, action_id, pid FROM ops WHERE class = 'process'",
    "forks": """SELECT p.container_id, p.ppid AS src, p.pid AS dst, 'fork' AS channel_type, concat('fork (child of pid ', CAST(p.ppid AS VARCHAR), ')') AS channel, CAST(1 AS BIGINT) AS event_count
  FROM procs p JOIN procs q ON p.container_id = q.container_id AND p.ppid = q.pid AND q.first_seq < p.first_seq""",
    "fileflow": """SELECT w.container_id, w.pid AS src, u.pid AS dst, 'file' AS channel_type, 'file:' || min(w.path) AS channel, count(*) AS event_count
  FROM (SELECT DISTINCT container_id, path, pid FROM files WHERE role = 'writer') w JOIN (SELECT DISTINCT container_id, path, pid FROM files WHERE role IN ('reader', 'executor')) u
    ON w.container_id = u.container_id AND w.path = u.path
  WHERE NOT EXISTS (SELECT 1 FROM files x WHERE x.role = 'writer' AND x.container_id = u.container_id AND x.path = u.path AND x.pid = u.pid)
    AND NOT (w.path LIKE '/proc/%' OR w.path LIKE '/usr/lib/%' OR contains(w.path, '.so')) GROUP BY 1, 2, 3""",
    "ipcflow": """SELECT s.container_id, s.pid AS src, r.pid AS dst, 'mqueue' AS channel_type, min(s.channel) AS channel, count(*) AS event_count
  FROM (SELECT DISTINCT container_id, channel, pid FROM queues WHERE role = 'sender') s JOIN (SELECT DISTINCT container_id, channel, pid FROM queues WHERE role = 'receiver') r
    ON s.container_id = r.container_id AND s.channel = r.channel AND s.pid <> r.pid GROUP BY 1, 2, 3""",
    "gaps": f"SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY container_id ORDER BY ts_ms, serial) <= {SESSION_GAP_MS} AS goes_on FROM ev",
    "numbers": "SELECT *, CAST(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY container_id ORDER BY ts_ms, serial ROWS UNBOUNDED PRECEDING) AS BIGINT) AS action_id FROM gaps",
    "sessions": "SELECT container_id, action_id, arg_min(cmdline, (ts_ms, serial)) FILTER (cmdline <> '') AS command, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n_events FROM numbers GROUP BY 1, 2",
    "hubs": """SELECT container_id, 'file' AS channel_type, path AS hub, CASE role WHEN 'writer' THEN 'in' ELSE 'out' END AS side, pid, min(first_ms) AS seen_ms FROM files f
  WHERE role IN ('writer', 'reader', 'executor') AND NOT (path LIKE '/proc/%' OR path LIKE '/usr/lib/%' OR contains(path, '.so'))
    AND (role = 'writer' OR NOT EXISTS (SELECT 1 FROM files x WHERE x.role = 'writer' AND x.container_id = f.container_id AND x.path = f.path AND x.pid = f.pid)) GROUP BY ALL
  UNION ALL SELECT container_id, 'mqueue', channel, CASE role WHEN 'sender' THEN 'in' ELSE 'out' END, pid, min(first_ms) FROM queues GROUP BY ALL""",
    "edges": "SELECT * FROM forks UNION ALL SELECT * FROM fileflow UNION ALL SELECT * FROM ipcflow",
    "attributed": """WITH RECURSIVE up AS (SELECT container_id, pid, pid AS root_pid, 0 AS d FROM procs
    UNION ALL SELECT up.container_id, up.pid, f.src, d + 1 FROM up JOIN forks f ON f.container_id = up.container_id AND f.dst = up.root_pid),
  r AS (SELECT container_id, pid, arg_max(root_pid, d) AS root_pid FROM up GROUP BY 1, 2)
  SELECT r.*, t.action_id FROM r JOIN procs p ON p.container_id = r.container_id AND p.pid = r.root_pid JOIN timed t ON t.serial = p.first_seq""",
    "ancestors": """SELECT pid, ppid, CASE WHEN ppid = 1 THEN lpad(substr(container_id, 2), 12, '0') END AS id, ppid AS at FROM procs
  UNION ALL SELECT u.pid, u.ppid, CASE WHEN p.ppid = 1 THEN lpad(substr(p.container_id, 2), 12, '0') END, p.ppid FROM ancestors u JOIN procs p ON p.pid = u.at""",
    "initial": """WITH RECURSIVE f AS (SELECT container_id, arg_min(pid, first_seq) AS first_pid FROM procs GROUP BY 1),
  s AS (SELECT a.container_id, a.pid, CASE WHEN a.pid = f.first_pid THEN 0.0::DOUBLE WHEN a.action_id > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM attributed a JOIN f USING (container_id) WHERE a.pid = a.root_pid
    UNION ALL SELECT a.container_id, a.pid, CASE WHEN s.score = 0 AND a.action_id > 0 THEN 1.0::DOUBLE ELSE s.score * 0.9::DOUBLE END
    FROM s JOIN forks k ON k.container_id = s.container_id AND k.src = s.pid JOIN attributed a ON a.container_id = k.container_id AND a.pid = k.dst)
  SELECT * FROM s""",
    "links": "SELECT container_id, src, dst, max(CASE channel_type WHEN 'fork' THEN 0.9::DOUBLE WHEN 'file' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END) AS decay FROM edges GROUP BY 1, 2, 3",
    "births": """SELECT p.container_id, p.pid, f.src AS parent, 1 + (SELECT count(*) FROM actions w WHERE w.container_id = p.container_id AND w.end_ms < p.first_ts) AS epoch,
    p.pid <> (SELECT arg_min(q.pid, q.first_seq) FROM procs q WHERE q.container_id = p.container_id) AND (EXISTS (SELECT 1 FROM actions w WHERE w.container_id = p.container_id AND p.first_ts BETWEEN w.start_ms AND w.end_ms)
      OR EXISTS (SELECT 1 FROM actions w WHERE w.container_id = p.container_id AND w.start_ms > p.first_ts AND w.start_ms - p.first_ts < 3600000)) AS active
    FROM procs p LEFT JOIN forks f ON f.container_id = p.container_id AND f.dst = p.pid""",
    "moved": """SELECT f.container_id, path AS hub, pid, CASE role WHEN 'writer' THEN 'in' ELSE 'out' END AS side, 0.5::DOUBLE AS decay, 1 + (SELECT count(*) FROM actions w WHERE w.container_id = f.container_id AND w.end_ms < f.first_ms) AS epoch FROM files f
      WHERE role IN ('writer', 'reader', 'executor') AND NOT (path LIKE '/proc/%' OR path LIKE '/usr/lib/%' OR contains(path, '.so'))
    UNION ALL SELECT q.container_id, channel, pid, CASE role WHEN 'sender' THEN 'in' ELSE 'out' END, 0.7::DOUBLE, 1 + (SELECT count(*) FROM actions w WHERE w.container_id = q.container_id AND w.end_ms < q.first_ms) FROM queues q""",
    "lines": """SELECT e, container_id, src, dst, max(decay) AS decay FROM (
    SELECT e, container_id, parent AS src, pid AS dst, 0.9::DOUBLE AS decay FROM births, range(1, 32) r(e) WHERE parent IS NOT NULL AND epoch <= e
    UNION ALL SELECT e, a.container_id, a.pid, b.pid, a.decay FROM range(1, 32) r(e) JOIN moved a ON a.side = 'in' AND a.epoch <= e JOIN moved b ON b.side = 'out' AND b.epoch <= e AND b.container_id = a.container_id AND b.hub = a.hub AND b.decay = a.decay AND b.pid <> a.pid
      WHERE a.decay = 0.7 OR NOT EXISTS (SELECT 1 FROM moved x WHERE x.side = 'in' AND x.epoch <= e AND x.container_id = b.container_id AND x.hub = b.hub AND x.pid = b.pid)) GROUP BY 1, 2, 3, 4""",
    # an epoch for each of 30 actions and one more, of 7 rounds in which processes are born, and 24 in which scores spread; pid -1 keeps the time
    "steps": """WITH RECURSIVE s AS (SELECT CAST(1 AS BIGINT) AS e, 0 AS r, '' AS container_id, CAST(-1 AS BIGINT) AS pid, 0.0::DOUBLE AS score UNION ALL (
    WITH n AS (SELECT CASE WHEN r = 31 THEN e + 1 ELSE e END AS e, CASE WHEN r = 31 THEN 0 ELSE r + 1 END AS r, r AS before, e AS now, container_id, pid, score FROM s WHERE NOT (e = 31 AND r = 31)),
    got AS (SELECT n.container_id, l.dst AS pid, max(n.score * l.decay) AS got FROM n JOIN lines l ON n.before BETWEEN 7 AND 30 AND l.e = n.now AND l.container_id = n.container_id AND l.src = n.pid WHERE n.score >= 0.1 GROUP BY 1, 2)
    SELECT n.e, n.r, n.container_id, n.pid, greatest(n.score, coalesce(got.got, 0)) FROM n LEFT JOIN got ON got.container_id = n.container_id AND got.pid = n.pid
    UNION ALL SELECT c.e, c.r, b.container_id, b.pid, CASE WHEN coalesce(p.score, 0) > 0 THEN p.score * 0.9::DOUBLE WHEN b.active THEN 1.0 ELSE 0.0 END FROM n c JOIN births b ON c.pid = -1 AND c.before < 7 AND b.epoch = c.now
      LEFT JOIN n p ON p.container_id = b.container_id AND p.pid = b.parent LEFT JOIN n x ON x.container_id = b.container_id AND x.pid = b.pid WHERE x.pid IS NULL AND (b.parent IS NULL OR p.pid IS NOT NULL)))
  SELECT * FROM s""",
    "reached": """WITH RECURSIVE s AS (SELECT i.container_id, action_id, i.pid, score, 0 AS d FROM initial i JOIN attributed a ON a.container_id = i.container_id AND a.pid = i.pid AND action_id > 0
    UNION SELECT l.container_id, action_id, l.dst, max(s.score * l.decay), s.d + 1 FROM s JOIN links l ON l.container_id = s.container_id AND l.src = s.pid WHERE s.score >= 0.1 AND s.d < 24 GROUP BY 1, 2, 3, 5)
  SELECT * FROM s""",
    "scores": """WITH RECURSIVE s AS (SELECT container_id, pid, score, 0 AS d FROM initial
    UNION SELECT l.container_id, l.dst, max(s.score * l.decay), s.d + 1 FROM s JOIN links l ON l.container_id = s.container_id AND l.src = s.pid WHERE s.score >= 0.1 AND s.d < 24 GROUP BY 1, 2, 4)
  SELECT i.container_id, i.pid, max(s.score) AS score, any_value(i.score) AS initial FROM initial i JOIN s ON s.container_id = i.container_id AND s.pid = i.pid GROUP BY 1, 2""",
    "noise": "SELECT DISTINCT path, path LIKE '/proc/%' OR path LIKE '/usr/lib/%' OR path LIKE '/usr/bin/%' OR contains(path, '.so') AS noise FROM ev WHERE path IS NOT NULL",
    "flows": """SELECT DISTINCT w.container_id, p.action_id, w.path, w.action_id AS writer_action, w.pid AS writer, u.pid FROM files w
  JOIN (SELECT DISTINCT container_id, path, pid FROM files WHERE role IN ('reader', 'executor')) u ON u.container_id = w.container_id AND u.path = w.path
  JOIN pids p ON p.container_id = u.container_id AND p.pid = u.pid JOIN noise n ON n.path = w.path AND NOT noise
  WHERE w.role = 'writer' AND w.action_id <> 0 AND w.action_id <> p.action_id
    AND NOT EXISTS (SELECT 1 FROM files x WHERE x.role = 'writer' AND x.container_id = u.container_id AND x.path = u.path AND x.pid = u.pid)""",
    "reads": """SELECT DISTINCT r.container_id, p.action_id, r.pid, r.path FROM (SELECT container_id, pid, path FROM files WHERE role IN ('reader', 'executor') UNION SELECT container_id, pid, path FROM opened) r
  JOIN pids p ON p.container_id = r.container_id AND p.pid = r.pid JOIN noise n ON n.path = r.path AND NOT noise
  WHERE NOT EXISTS (SELECT 1 FROM flows f WHERE f.container_id = r.container_id AND f.action_id = p.action_id AND f.pid = r.pid AND f.path = r.path)""",
    "writes": "SELECT DISTINCT f.container_id, f.action_id, f.pid, f.path FROM files f JOIN pids p USING (container_id, action_id, pid) JOIN noise n ON n.path = f.path AND NOT noise WHERE role = 'writer'",
    "network": "SELECT c.container_id, p.action_id, c.pid, direction, addr, o.container_id AS owner FROM conns c JOIN pids p USING (container_id, pid) LEFT JOIN owners o ON split_part(c.addr, ':', 1) = o.ip",
    "influence": """SELECT e.container_id, p.action_id, e.src, e.dst, e.channel_type FROM edges e JOIN scores a ON a.container_id = e.container_id AND a.pid = e.src AND a.score >= 0.1
  JOIN scores d ON d.container_id = e.container_id AND d.pid = e.dst AND d.score > d.initial JOIN pids p ON p.container_id = e.container_id AND p.pid = e.src
  WHERE NOT EXISTS (SELECT 1 FROM pids q WHERE q.container_id = e.container_id AND q.action_id = p.action_id AND q.pid = e.dst)""",
    "tools": "SELECT * FROM (VALUES ('curl', 'T1105', 2, 'Curl/wget download'), ('gcc', 'T1027.004', 1, 'Source compilation'), ('nc', 'T1059.004', 3, 'Netcat/socat (reverse shell tool)')) v(tool, technique, severity, name)",
    "found": """SELECT container_id, action_id, technique, pid, severity, description FROM (
  SELECT DISTINCT o.container_id, o.action_id, technique, o.pid, severity, name || ': ' || p.cmdline AS description
  FROM ops o JOIN procs p ON o.container_id = p.container_id AND o.pid = p.pid JOIN tools ON tool = p.comm WHERE class = 'process' AND op = 'Exec'
  UNION ALL SELECT DISTINCT container_id, action_id, CASE path WHEN '/etc/passwd' THEN 'T1098' ELSE 'T1053.003' END, pid, 3, CASE path WHEN '/etc/passwd' THEN 'Passwd/shadow modification: ' ELSE 'Cron job modification: ' END || path
  FROM files WHERE role = 'writer' AND path IN ('/etc/passwd', '/etc/crontab')
  UNION ALL SELECT DISTINCT o.container_id, o.action_id, 'T1071', o.pid, 1, 'Outbound network connection: ' || CASE WHEN len(l) <= 3 THEN array_to_string(l, ', ') ELSE l[1] || ', ' || l[2] || ' +' || (len(l) - 2) || ' more' END
  FROM ops o JOIN scores s ON s.container_id = o.container_id AND s.pid = o.pid AND s.score >= 0.1 JOIN remotes r ON r.container_id = o.container_id AND r.pid = o.pid WHERE class = 'net') WHERE action_id > 0""",
    "remotes": "SELECT container_id, pid, list_sort(list(addr)) AS l FROM conns WHERE direction = 'connect' AND addr NOT LIKE '127.%' GROUP BY 1, 2",
    "diff": """SELECT DISTINCT * FROM (SELECT container_id, action_id, 0 AS rank, 'flow' AS verb, CAST(pid AS VARCHAR) AS subject, path || ' from action ' || writer_action AS detail FROM flows
  UNION ALL SELECT container_id, action_id, 1, 'read', CAST(pid AS VARCHAR), path FROM reads UNION ALL SELECT container_id, action_id, 2, 'write', CAST(pid AS VARCHAR), path FROM writes
  UNION ALL SELECT f.container_id, p.action_id, 3, channel_type, CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM edges f JOIN pids p ON p.container_id = f.container_id AND p.pid IN (f.dst, f.src) WHERE channel_type <> 'file'
  UNION ALL SELECT container_id, action_id, 4, 'connect', CAST(pid AS VARCHAR), addr || coalesce(' (' || owner || ')', '') FROM network WHERE direction = 'connect'
  UNION ALL SELECT container_id, action_id, 5, 'listen', CAST(pid AS VARCHAR), addr FROM network WHERE direction = 'listen'
  UNION ALL SELECT container_id, action_id, 6, 'influence', CAST(src AS VARCHAR), dst || ' by ' || channel_type FROM influence)""",
    "nodes": "SELECT container_id, pid, score FROM scores QUALIFY row_number() OVER (PARTITION BY container_id ORDER BY score DESC, pid) <= 50",
    "ulinks": """SELECT f.container_id, f.src AS a, f.dst AS b FROM forks f JOIN procs p ON p.container_id = f.container_id AND p.pid = f.src JOIN procs q ON q.container_id = f.container_id AND q.pid = f.dst AND p.comm = q.comm
  UNION SELECT f.container_id, f.dst, f.src FROM forks f JOIN procs p ON p.container_id = f.container_id AND p.pid = f.src JOIN procs q ON q.container_id = f.container_id AND q.pid = f.dst AND p.comm = q.comm
  UNION SELECT container_id, src, dst FROM edges WHERE channel_type <> 'fork' AND event_count >= 10 UNION SELECT container_id, dst, src FROM edges WHERE channel_type <> 'fork' AND event_count >= 10""",
    "reach": "SELECT container_id, pid, pid AS node FROM procs UNION SELECT r.container_id, r.pid, l.b FROM reach r JOIN ulinks l ON l.container_id = r.container_id AND l.a = r.node",
    "groups": """SELECT m.container_id, community, count(*) AS size, arg_max(p.pid, {'l': coalesce(length(cmdline), 0), 'p': -p.pid}) AS representative_pid, round(avg(score), 6) AS avg_score,
  string_agg(DISTINCT comm, ',' ORDER BY comm) AS label, string_agg(CAST(p.pid AS VARCHAR), ',' ORDER BY p.pid) AS members
  FROM (SELECT container_id, pid, min(node) AS community FROM reach GROUP BY 1, 2) m JOIN procs p ON p.container_id = m.container_id AND p.pid = m.pid JOIN scores s ON s.container_id = m.container_id AND s.pid = m.pid GROUP BY 1, 2""",
    "alinks": """SELECT DISTINCT e.container_id, p.action_id, e.src AS a, e.dst AS b FROM edges e JOIN pids p ON p.container_id = e.container_id AND p.pid = e.src JOIN pids q ON q.container_id = e.container_id AND q.pid = e.dst AND q.action_id = p.action_id
  JOIN procs x ON x.container_id = e.container_id AND x.pid = e.src JOIN procs y ON y.container_id = e.container_id AND y.pid = e.dst WHERE CASE channel_type WHEN 'fork' THEN x.comm = y.comm ELSE event_count >= 10 END""",
    "areach": """SELECT container_id, action_id, pid, pid AS node FROM pids UNION SELECT r.container_id, r.action_id, r.pid, CASE r.node WHEN l.a THEN l.b ELSE l.a END
  FROM areach r JOIN alinks l ON l.container_id = r.container_id AND l.action_id = r.action_id AND r.node IN (l.a, l.b)""",
    "agroups": """SELECT *, row_number() OVER (PARTITION BY container_id, action_id ORDER BY size DESC, community) - 1 AS community_id, CASE WHEN len(names) <= 2 THEN array_to_string(names, '+') ELSE names[1] || '+' || (len(names) - 1) || ' others' END AS label FROM (
  SELECT m.container_id, m.action_id, community, count(*) AS size, list_sort(list(DISTINCT comm)) AS names, arg_max(p.pid, {'l': coalesce(length(cmdline), 0), 'p': -p.pid}) AS representative_pid
  FROM (SELECT container_id, action_id, pid, min(node) AS community FROM areach GROUP BY 1, 2, 3) m JOIN procs p ON p.container_id = m.container_id AND p.pid = m.pid GROUP BY 1, 2, 3)""",
    "summary": """SELECT o.container_id, action_id, concat(p.comm, ' ', split_part(p.cmdline, ' ', 2), ' <ADDR>') AS command, count(*) AS n, min(serial) AS first_seq, arg_min(o.pid, serial) AS pid, arg_min(p.comm, serial) AS name, arg_min(p.cmdline, serial) AS cmdline
  FROM ops o JOIN procs p ON p.container_id = o.container_id AND p.pid = o.pid WHERE class = 'process' AND op = 'Exec' GROUP BY 1, 2, 3""",
    "counts": """SELECT o.container_id, o.action_id, coalesce(any_value(n_unique), 0) AS n_unique, count(*) FILTER (op = 'Fork') AS n_forked, count(*) FILTER (op = 'Exit') AS n_exited
  FROM ops o LEFT JOIN (SELECT container_id, action_id, count(*) AS n_unique FROM summary GROUP BY 1, 2) u ON u.container_id = o.container_id AND u.action_id = o.action_id WHERE class = 'process' GROUP BY 1, 2""",
    "receipt": """SELECT container_id, action_id, section, CAST(row_number() OVER (PARTITION BY container_id, action_id, section ORDER BY a, b, line) AS INT) AS nth, line FROM (
  SELECT container_id, action_id, 0 AS section, 0 AS a, '' AS b, 'Command: ' || command AS line FROM actions
  UNION ALL SELECT a.container_id, a.action_id, 0, 1, '', 'Duration: 75600.0s | ' || (SELECT count(*) FROM ops o WHERE o.container_id = a.container_id AND o.action_id = a.action_id) || ' events' FROM actions a
  UNION ALL SELECT container_id, action_id, 1, -1, '', n_unique || ' unique, ' || n_forked || ' forked, ' || n_exited || ' exited' FROM counts WHERE n_unique > 0 OR n_forked > 0
  UNION ALL SELECT container_id, action_id, 1, first_seq, command, '[' || name || ':' || pid || '] $ ' || cmdline || CASE WHEN n > 1 THEN ' (x' || n || ')' ELSE '' END FROM summary
  UNION ALL SELECT container_id, action_id, 2, community_id, '', label || ' (' || size || ' processes)' FROM agroups WHERE size > 3
  UNION ALL SELECT container_id, action_id, 2, 1099511627776, '', '+ ' || sum(size) FILTER (size <= 3) || ' individual processes' FROM agroups GROUP BY 1, 2 HAVING max(size) > 3 AND min(size) <= 3
  UNION ALL SELECT container_id, action_id, 3, rank, detail || ' ' || subject || ' ' || verb, verb || ' ' || subject || ' ' || detail FROM diff
  UNION ALL SELECT container_id, action_id, 4, -severity, technique || ' ' || description || ' ' || lpad(CAST(pid AS VARCHAR), 12, '0'), [' ', '.', '!', '!!'][severity + 1] || ' ' || technique || ' ' || pid || ' ' || description FROM found)""",
    "seen": """SELECT serial, ts_ms, pid, src_fd, dst_fd, syscall, CASE WHEN syscall = 257 AND fd >= 0 THEN CASE WHEN path LIKE '/proc/%' THEN '' ELSE path END WHEN syscall IN (42, 49) THEN 'net:' || addr
    WHEN syscall IN (68, 240) THEN 'mq:' || channel END AS sets, CASE WHEN syscall = 68 THEN k % 7 ELSE fd END AS sets_fd FROM ev WHERE k <> 99 OR addr IS NOT NULL""",
    "life": "SELECT *, coalesce(sum(CASE WHEN syscall = 231 THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY ts_ms, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM seen",
    "met": """SELECT x.serial, x.pid, x.src_fd, x.dst_fd, arg_max(s.sets, (s.ts_ms, s.serial)) FILTER (s.sets_fd = x.src_fd) AS source, arg_max(s.sets, (s.ts_ms, s.serial)) FILTER (s.sets_fd = x.dst_fd) AS target
    FROM life x LEFT JOIN life s ON s.sets IS NOT NULL AND s.pid = x.pid AND s.epoch = x.epoch AND (s.ts_ms < x.ts_ms OR s.ts_ms = x.ts_ms AND s.serial < x.serial) WHERE x.syscall = 40 GROUP BY ALL""",
    "listed": """SELECT *, count(*) OVER w AS n_all, count(*) FILTER (NOT s) OVER w AS n_plain, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS name,
  regexp_extract(path, '/([^0-9/]*)([0-9]+)([^/]*)$', 1) AS p, regexp_extract(path, '/([^0-9/]*)([0-9]+)([^/]*)$', 2) AS num, regexp_extract(path, '/([^0-9/]*)([0-9]+)([^/]*)$', 3) AS x
  FROM (SELECT *, contains(path, '/etc/passwd') AS s FROM opened) WINDOW w AS (PARTITION BY container_id, pid)""",
    "dirs": """SELECT container_id, pid, dir, count(*) AS n, list_sort(list(name)) AS names, min(num) AS low, max(num) AS high, min(p) AS p, min(x) AS x,
  count(DISTINCT p || '|' || x || '|' || length(num)) = 1 AND min(length(num)) > 0 AND max(TRY_CAST(num AS BIGINT)) - min(TRY_CAST(num AS BIGINT)) + 1 = count(*) AS gapless
  FROM listed WHERE NOT s AND n_all > 3 AND n_plain > 3 GROUP BY 1, 2, 3""",
    "status": """SELECT container_id, n_processes, n_exited, n_edges, CAST(30 AS BIGINT) AS n_actions, CAST(NULL AS BIGINT) AS active_action
  FROM (SELECT container_id, count(*) AS n_processes, count(*) FILTER (exited) AS n_exited FROM procs GROUP BY 1) JOIN (SELECT container_id, count(*) AS n_edges FROM edges GROUP BY 1) USING (container_id)""",
    "shown": """SELECT container_id, path, CASE WHEN s THEN 'sensitive' WHEN x THEN 'executed' WHEN d THEN 'deleted' ELSE 'data' END AS class, right(path, 45) AS label FROM (
  SELECT container_id, path, contains(path, '/etc/passwd') AS s, bool_or(role = 'writer') AS w, bool_or(role = 'deleter') AS d, bool_or(role = 'reader') AS r, bool_or(role = 'executor') AS x, bool_or(role = 'modifier') AS m
  FROM files WHERE path NOT LIKE '/proc/%' GROUP BY container_id, path) WHERE (w OR r OR d OR m) AND (s OR d OR m OR (w AND (r OR x)))""",
}


def sql(body: str) -> str:
    """A statement with the expressions that it and they name, in order."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if re.search(rf"\b(FROM|JOIN)\s+\(?{name}\b", text, re.I) and name not in needed:
                visit(CTE[name].replace(f"FROM {name} ", ""))
                needed.append(name)

    visit(body)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in needed) + "\n" if needed else "") + body


def query(columns: str) -> Callable[[Callable[[Tables], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """A query of the tables that returns the named columns."""

    def wrap(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(Tables(spark, sf_dir)).select(*columns.split())

    return wrap


QUERIES: dict[str, tuple[str, Callable[[Tables], DataFrame], str | None]] = {}


def register(name: str, columns: str, make: Callable[[Tables], DataFrame], body: str | None) -> None:
    QUERIES[name] = (columns, make, body)


register("derived_events", "serial ts_ms container_id pid ppid syscall flags fd comm exe path addr channel cmdline src_fd dst_fd", lambda t: t.events, "SELECT serial, ts_ms, container_id, pid, ppid, syscall, flags, fd, comm, exe, path, addr, channel, cmdline, src_fd, dst_fd FROM ev")
register("op_events", "container_id serial action_id pid class op path addr", lambda t: t.ops, "SELECT container_id, serial, action_id, pid, class, op, path, addr FROM ops")
register("routed_events", "serial container_id pid action_id channel", lambda t: t.routed, "SELECT serial, container_id, pid, action_id, channel FROM routed")
register("process_table", "container_id pid first_seq first_ts ppid comm cmdline exe exited n_events", lambda t: t.procs, "SELECT * FROM procs")
register("process_children", "container_id pid children n_children", lambda t: enrich.children_text(t.procs), "SELECT container_id, ppid AS pid, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS children, count(*) AS n_children FROM procs GROUP BY 1, 2")
register("action_at_time", "serial container_id ts_ms action_id", lambda t: t.timed, "SELECT serial, container_id, ts_ms, action_id FROM timed")
register("attributed_action", "container_id pid root_pid action_id", lambda t: t.attributed, "SELECT container_id, pid, root_pid, action_id FROM attributed")
register("fd_resolution", "serial container_id pid fd fd_target", lambda t: enrich.fd_targets(t.events),
  "SELECT serial, container_id, pid, fd, last_value(sets IGNORE NULLS) OVER (PARTITION BY container_id, pid, epoch, fd ORDER BY ts_ms, serial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fd_target FROM fds")
register("file_access", "container_id path role pid action_id first_seq", lambda t: t.files, "SELECT container_id, path, role, pid, action_id, first_seq FROM files")
register("ipc_access", "container_id channel role pid action_id", lambda t: t.queues, "SELECT container_id, channel, role, pid, action_id FROM queues")
register("action_event_counts", "container_id action_id pid class op n first_seq", lambda t: facts.op_counts(t.ops), "SELECT container_id, action_id, pid, class, op, count(*) AS n, min(serial) AS first_seq FROM ops GROUP BY ALL")
register("first_file_events", "container_id action_id pid op first_path", lambda t: facts.op_counts(t.ops).where("class = 'file'"), "SELECT container_id, action_id, pid, op, arg_min_null(path, serial) AS first_path FROM ops WHERE class = 'file' GROUP BY ALL")
register("connections", "container_id pid direction addr", lambda t: t.conns, "SELECT * FROM conns")
register("fork_edges", "container_id src dst channel_type channel event_count", lambda t: t.forks, "SELECT * FROM forks")
register("file_flow_edges", "container_id src dst channel_type channel event_count", lambda t: graph.file_flow_edges(t.files), "SELECT * FROM fileflow")
register("ipc_flow_edges", "container_id src dst channel_type channel event_count", lambda t: graph.ipc_flow_edges(t.queues), "SELECT * FROM ipcflow")
register("hub_links", "container_id channel_type hub side pid seen_ms", lambda t: t.hubs, "SELECT * FROM hubs")
register("edge_times", "container_id src dst channel_type event_count first_seen last_seen", lambda t: t.edges,
  texts.EDGE_TIMES)
register("taint_init", "container_id pid score", lambda t: t.initial.withColumn("score", F.round("score", 9)), "SELECT container_id, pid, round(score, 9) AS score FROM initial")
register("taint_scores", "container_id pid score", lambda t: t.scores.withColumn("score", F.round("score", 9)), "SELECT container_id, pid, round(score, 9) AS score FROM scores")
register("newly_tainted", "container_id pid score", lambda t: t.scores.where("score >= 0.1 and initial < 0.1").withColumn("score", F.round("score", 9)), "SELECT container_id, pid, round(score, 9) AS score FROM scores WHERE score >= 0.1 AND initial < 0.1")
register("communities", "container_id community size representative_pid avg_score label members", lambda t: t.groups.drop("label").join(graph.community_texts(t.procs, t.members), ["container_id", "community"]).withColumn("avg_score", F.round("avg_score", 6)), "SELECT * FROM groups")
register("community_members", "container_id pid community", lambda t: t.members, "SELECT container_id, pid, min(node) AS community FROM reach GROUP BY 1, 2")
register("cross_action_flows", "container_id action_id path writer_action writer pid", lambda t: t.flows, "SELECT * FROM flows")
register("reads_by_process", "container_id action_id pid path", lambda t: t.reads, "SELECT * FROM reads")
register("writes_by_process", "container_id action_id pid path", lambda t: t.writes, "SELECT * FROM writes")
register("file_list_compressed", "container_id pid files", lambda t: receipts.compressed(t.opened, "container_id", "pid"),
  """SELECT container_id, pid, string_agg(item, ', ' ORDER BY item) AS files FROM (SELECT container_id, pid, path AS item FROM listed WHERE s OR n_all <= 3 OR n_plain <= 3
  UNION ALL SELECT container_id, pid, CASE WHEN n = 1 THEN dir || '/' || names[1] WHEN n >= 3 AND gapless THEN dir || '/' || p || '{' || low || '..' || high || '}' || x
    WHEN n <= 5 THEN dir || '/{' || array_to_string(names, ',') || '}' ELSE dir || '/{' || names[1] || ',' || names[2] || ',... ' || names[-1] || '} (' || n || ' files)' END FROM dirs) GROUP BY 1, 2""")  # fmt: skip
register("network_flows", "container_id action_id pid direction addr owner", lambda t: t.network, "SELECT * FROM network")
register("cross_container_flows", "experiment_id source target addr", lambda t: receipts.cross_container_flows(t.conns, t.owners, t.experiments),
  "SELECT DISTINCT m.experiment_id, c.container_id AS source, o.container_id AS target, addr FROM conns c JOIN owners o ON direction = 'connect' AND c.addr = o.ip || ':80' JOIN members m ON m.container_id = c.container_id JOIN members n ON n.container_id = o.container_id AND n.experiment_id = m.experiment_id WHERE c.container_id <> o.container_id")
register("preexisting_influence", "container_id action_id src dst channel_type", lambda t: t.influence, "SELECT * FROM influence")
register("process_summary", "container_id action_id command n first_seq pid name cmdline", lambda t: t.summary, "SELECT * FROM summary")
register("process_counts", "container_id action_id n_unique n_forked n_exited", lambda t: receipts.process_counts(t.ops, t.summary), "SELECT * FROM counts")
register("action_communities", "container_id action_id community_id community size label representative_pid", lambda t: t.groups_of_actions, "SELECT container_id, action_id, community_id, community, size, label, representative_pid FROM agroups")
register("receipts", "container_id action_id section nth line", lambda t: t.receipt, "SELECT * FROM receipt")
register("rule_detections", "container_id action_id technique pid severity description", lambda t: t.found, "SELECT * FROM found")
register("detections_by_severity", "container_id nth action_id technique pid severity", lambda t: rules.by_severity(t.found),
  "SELECT container_id, CAST(row_number() OVER (PARTITION BY container_id ORDER BY severity DESC, action_id, technique, pid) AS INT) AS nth, action_id, technique, pid, severity FROM found")
register("technique_rollup", "container_id action_id technique severity mark n n_descriptions example", lambda t: rules.technique_rollup(t.found),
  "SELECT container_id, action_id, technique, max(severity) AS severity, [' ', '.', '!', '!!'][max(severity) + 1] AS mark, count(*) AS n, count(DISTINCT description) AS n_descriptions, min(description) AS example FROM found GROUP BY 1, 2, 3")
register("data_flow_diff", "container_id action_id rank verb subject detail", lambda t: t.diff, "SELECT * FROM diff")
register("merged_flows", "container_id action_id rank verb detail comm n pids", lambda t: receipts.merged(t.unqueued, t.procs, pids=True, queued=receipts.queue_lines(t.hubs, t.pids, t.procs)),
  """SELECT d.container_id, action_id, rank, verb, CASE rank WHEN 3 THEN coalesce(q.comm, '?') ELSE detail END AS detail, coalesce(p.comm, '?') AS comm, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(subject AS BIGINT))), ',') AS pids
  FROM diff d LEFT JOIN procs p ON p.container_id = d.container_id AND CAST(p.pid AS VARCHAR) = d.subject LEFT JOIN procs q ON rank = 3 AND q.container_id = d.container_id AND CAST(q.pid AS VARCHAR) = d.detail GROUP BY 1, 2, 3, 4, 5, 6""")  # fmt: skip
register("receipt_text", "container_id action_id receipt", lambda t: receipts.receipt_text(t.alone, receipts.placed_lines(t.forks, t.hubs, t.pids, t.scores)), "SELECT container_id, action_id, string_agg(verb || ' ' || subject || ' ' || detail, chr(10) ORDER BY rank, detail, subject, verb) AS receipt FROM diff GROUP BY 1, 2")
register("action_list", "container_id action_id command start_ms end_ms total_events process_events", lambda t: views.action_list(t.actions, t.ops),
  "SELECT a.container_id, a.action_id, command, start_ms, end_ms, count(o.serial) AS total_events, count(o.serial) FILTER (class = 'process') AS process_events FROM actions a LEFT JOIN ops o ON o.container_id = a.container_id AND o.action_id = a.action_id GROUP BY 1, 2, 3, 4, 5")
register("container_status", "container_id n_processes n_exited n_edges n_actions active_action", lambda t: t.status, "SELECT * FROM status")
register("listed_containers", "container_id n_processes", lambda t: views.listed_containers(t.status), "SELECT container_id, n_processes FROM status WHERE n_processes <= 1500")
register("hidden_containers", "listed hidden", lambda t: views.hidden_containers(t.status, 150), "SELECT count(*) FILTER (n_processes <= 150) AS listed, count(*) FILTER (n_processes > 150) AS hidden FROM status")
register("shown_files", "container_id path class label", lambda t: t.shown, "SELECT * FROM shown")
register("graph_nodes", "container_id pid label cmd action_id score", lambda t: t.nodes,
  "SELECT container_id, pid, concat(comm, ':', CAST(pid AS VARCHAR)) AS label, cmdline AS cmd, action_id, round(score, 9) AS score FROM procs JOIN scores USING (container_id, pid) JOIN attributed USING (container_id, pid) QUALIFY row_number() OVER (PARTITION BY container_id ORDER BY score DESC, pid) <= 50")
register("graph_edges", "container_id src dst channel_type channel event_count label colour", lambda t: t.drawn,
  "SELECT e.*, e.channel_type AS label, CASE WHEN a.score >= 0.1 THEN printf('#cc%02x%02x', 255 - CAST(floor(a.score * 255) AS INT), 255 - CAST(floor(a.score * 255) AS INT)) ELSE '#cccccc' END AS colour FROM edges e JOIN nodes a ON a.container_id = e.container_id AND a.pid = e.src JOIN nodes b ON b.container_id = e.container_id AND b.pid = e.dst")
register("data_edges", "container_id path pid verb", lambda t: views.data_edges(t.files, t.shown), "SELECT DISTINCT f.container_id, f.path, pid, CASE role WHEN 'writer' THEN 'write' WHEN 'reader' THEN 'read' WHEN 'executor' THEN 'exec' WHEN 'modifier' THEN 'chmod' ELSE 'delete' END AS verb FROM files f JOIN shown s USING (container_id, path)")
register("endpoints", "container_id addr direction n_pids pids", lambda t: views.endpoints(t.conns, pids=True), "SELECT container_id, addr, direction, count(*) AS n_pids, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY pid) AS pids FROM conns WHERE addr NOT LIKE '0.0.0.0:%' GROUP BY 1, 2, 3")
register("entry_points", "container_id pid ppid comm", lambda t: views.entry_points(t.procs), "SELECT container_id, pid, ppid, comm FROM procs p WHERE ppid <> 0 AND NOT EXISTS (SELECT 1 FROM procs q WHERE q.container_id = p.container_id AND q.pid = p.ppid)")
register("first_actions", "container_id pid first_action", lambda t: views.first_actions(t.procs, t.ops),
  "SELECT p.container_id, p.pid, coalesce(min(o.action_id), 0) AS first_action FROM procs p LEFT JOIN ops o ON o.container_id = p.container_id AND o.pid = p.pid AND class = 'process' AND o.action_id > 0 GROUP BY 1, 2")
register("experiment_totals", "experiment_id name container_id n_processes n_exited n_edges n_actions", lambda t: views.experiment_totals(t.experiments, t.status, t.actions), "SELECT experiment_id, name, m.container_id, n_processes, n_exited, n_edges, n_actions FROM members m LEFT JOIN status USING (container_id)")


register("audited_events", "serial container_id syscall", lambda t: enrich.audited(t.events), "SELECT serial, container_id, syscall FROM ev WHERE syscall NOT IN (231, 56, 62, 319, 0, 1)")
register("event_rule_matches", "container_id serial pid technique severity", lambda t: rules.event_matches(t.events, rules.rule_table(t.spark)),
  """SELECT container_id, serial, pid, technique, severity FROM ev JOIN tools ON tool = comm WHERE syscall = 59 UNION ALL SELECT container_id, serial, pid, 'T1071', 1 FROM ev WHERE syscall = 42
  UNION ALL SELECT container_id, serial, pid, 'T1048', 2 FROM ev WHERE syscall = 40 UNION ALL SELECT container_id, serial, pid, 'T1053.003', 3 FROM ev WHERE syscall IN (257, 82) AND path = '/etc/crontab'
  UNION ALL SELECT container_id, serial, pid, 'T1098', 3 FROM ev WHERE syscall = 257 AND path = '/etc/passwd' UNION ALL SELECT container_id, serial, pid, 'T1620', 3 FROM ev WHERE syscall = 319
  UNION ALL SELECT container_id, serial, pid, 'T1222.002', 2 FROM ev WHERE syscall = 90 AND path LIKE '/etc/%'""")  # fmt: skip
GLOB_PATHS = {4: "/home/a/.ssh/authorized_keys", 5: "/root/.ssh/id_rsa", 6: "/home/b/.mozilla/f1/logins.json", 7: "/srv/.ssh/known_hosts", 8: "/etc/shadow.d/x", 9: "/etc/shadowed"}


def with_glob_paths(events: DataFrame) -> DataFrame:
    """Events whose files of some numbers are such that only real globs tell what they are."""
    path = F.col("path")
    for k, name in GLOB_PATHS.items():
        path = F.when(F.startswith(F.col("path"), F.lit("/data/")) & (F.col("k") == k), F.lit(name)).otherwise(path)
    return events.withColumn("path", path)


register("event_rule_globs", "container_id serial pid technique severity", lambda t: rules.event_matches(with_glob_paths(t.events), rules.rule_table(t.spark), globs=True),
  """SELECT container_id, serial, pid, technique, severity FROM ev JOIN tools ON tool = comm WHERE syscall = 59 UNION ALL SELECT container_id, serial, pid, 'T1071', 1 FROM ev WHERE syscall = 42
  UNION ALL SELECT container_id, serial, pid, 'T1048', 2 FROM ev WHERE syscall = 40 UNION ALL SELECT container_id, serial, pid, 'T1053.003', 3 FROM ev WHERE syscall IN (257, 82) AND path = '/etc/crontab'
  UNION ALL SELECT container_id, serial, pid, 'T1098', 3 FROM ev WHERE syscall = 257 AND path = '/etc/passwd' UNION ALL SELECT container_id, serial, pid, 'T1620', 3 FROM ev WHERE syscall = 319
  UNION ALL SELECT container_id, serial, pid, 'T1222.002', 2 FROM ev WHERE syscall = 90 AND (path LIKE '/etc/%' OR path LIKE '/data/%' AND k IN (8, 9))
  UNION ALL SELECT container_id, serial, pid, 'T1098.004', 3 FROM ev WHERE syscall = 257 AND path LIKE '/data/%' AND k = 4 UNION ALL SELECT container_id, serial, pid, 'T1552.001', 3 FROM ev WHERE syscall = 257 AND path LIKE '/data/%' AND k IN (5, 7)
  UNION ALL SELECT container_id, serial, pid, 'T1555', 3 FROM ev WHERE syscall = 257 AND path LIKE '/data/%' AND k = 6""")  # fmt: skip
register("cross_container_edges", "experiment_id source target n_pids", lambda t: receipts.cross_container_edges(t.conns, t.owners, t.experiments, t.scores),
  """SELECT m.experiment_id, c.container_id AS source, o.container_id AS target, count(DISTINCT c.pid) AS n_pids FROM conns c JOIN owners o ON direction = 'connect' AND c.addr = o.ip || ':80' JOIN members m ON m.container_id = c.container_id
  JOIN members n ON n.container_id = o.container_id AND n.experiment_id = m.experiment_id JOIN scores s ON s.container_id = c.container_id AND s.pid = c.pid AND s.score >= 0.1 WHERE c.container_id <> o.container_id GROUP BY 1, 2, 3""")  # fmt: skip
register("experiment_action_receipt", "experiment_id action_id verb n_containers n", lambda t: receipts.experiment_action(t.flow_counts, t.experiments),
  "SELECT experiment_id, action_id, verb, count(DISTINCT d.container_id) AS n_containers, count(*) AS n FROM diff d JOIN members m ON m.container_id = d.container_id GROUP BY 1, 2, 3")
register("community_display", "container_id shown hidden_processes", lambda t: receipts.shown_communities(t.groups), "SELECT container_id, count(*) FILTER (size > 3) AS shown, CAST(coalesce(sum(size) FILTER (size <= 3), 0) AS BIGINT) AS hidden_processes FROM groups GROUP BY 1")
register("ip_ownership", "ip container_id", lambda t: enrich.ip_owner(t.events.where("addr is not null").select(F.substring_index("addr", ":", 1).alias("ip"), "container_id", (F.col("serial") % 7 == 0).alias("explicit"), "ts_ms")),
  "SELECT ip, container_id FROM (SELECT split_part(addr, ':', 1) AS ip, container_id, row_number() OVER (PARTITION BY split_part(addr, ':', 1) ORDER BY CASE WHEN serial % 7 = 0 THEN 0 ELSE 1 END, CASE WHEN serial % 7 = 0 THEN -ts_ms ELSE ts_ms END, container_id) AS nth FROM ev WHERE addr IS NOT NULL) WHERE nth = 1")
register("session_actions", "container_id action_id command start_ms end_ms n_events", lambda t: t.sessions, "SELECT container_id, action_id, command, start_ms, end_ms, n_events FROM sessions")
register("reached_by_actions", "container_id pid action_id score", lambda t: graph.reached_by(t.initial, t.attributed, t.forks, t.hubs).withColumn("score", F.round("score", 9)), "SELECT container_id, pid, action_id, round(max(score), 9) AS score FROM reached WHERE score >= 0.1 GROUP BY 1, 2, 3")
register("taint_epochs", "container_id epoch pid score", lambda t: graph.taint_by_epoch(t.procs, t.forks, t.files, t.queues, t.actions, derived.GAP_MS).withColumn("score", F.round("score", 9)),
  """SELECT s.container_id, s.e AS epoch, s.pid, round(s.score, 9) AS score FROM steps s LEFT JOIN steps b ON b.r = 31 AND b.e = s.e - 1 AND b.container_id = s.container_id AND b.pid = s.pid WHERE s.r = 31 AND s.pid >= 0 AND (b.pid IS NULL OR s.score > b.score)""")  # fmt: skip
register("experiment_receipt", "experiment_id section container_id nth line", lambda t: receipts.experiment_receipt(t.experiments, t.actions, t.ops, t.procs, t.conns, t.pids, t.owners),
  """SELECT experiment_id, section, container_id, CAST(row_number() OVER (PARTITION BY experiment_id, section, container_id ORDER BY a, line) AS INT) AS nth, line FROM (
  SELECT DISTINCT experiment_id, 0 AS section, '' AS container_id, 0 AS a, '=== Experiment Receipt: ' || name || ' ===' AS line FROM members UNION ALL SELECT experiment_id, 0, '', 1, 'Containers: ' || count(*) FROM members GROUP BY 1
  UNION ALL SELECT experiment_id, 1, container_id, -2, 'Container ' || container_id FROM members WHERE container_id IN (SELECT container_id FROM procs)
  UNION ALL SELECT experiment_id, 1, m.container_id, -1, '30 actions, ' || (SELECT count(*) FROM procs p WHERE p.container_id = m.container_id) || ' processes, ' || (SELECT count(*) FROM ops o WHERE o.container_id = m.container_id AND action_id > 0) || ' events' FROM members m WHERE container_id IN (SELECT container_id FROM procs)
  UNION ALL SELECT experiment_id, 1, m.container_id, action_id, 'Action #' || action_id || ': day ' || action_id || ' (' || count(*) || ' events)' FROM members m JOIN ops o ON o.container_id = m.container_id AND action_id > 0 GROUP BY 1, 3, 4
  UNION ALL SELECT DISTINCT m.experiment_id, 2, c.container_id, 1, p.comm || ':' || p.pid || ' [' || c.container_id || '] -> ' || addr || ' [' || o.container_id || ']' FROM conns c JOIN procs p ON p.container_id = c.container_id AND p.pid = c.pid
    JOIN owners o ON direction = 'connect' AND c.addr = o.ip || ':80' JOIN members m ON m.container_id = c.container_id JOIN members n ON n.container_id = o.container_id AND n.experiment_id = m.experiment_id WHERE c.container_id <> o.container_id
  UNION ALL SELECT m.experiment_id, 3, c.container_id, 1, p.comm || ':' || p.pid || ' [' || c.container_id || '] connects ' || addr || coalesce(' (' || o.container_id || ')', '') FROM conns c JOIN procs p ON p.container_id = c.container_id AND p.pid = c.pid
    LEFT JOIN owners o ON split_part(c.addr, ':', 1) = o.ip JOIN members m ON m.container_id = c.container_id WHERE direction = 'connect' AND EXISTS (SELECT 1 FROM pids q WHERE q.container_id = c.container_id AND q.pid = c.pid))""")  # fmt: skip
register("turn_boundaries", "container_id action_id start_ms end_ms", lambda t: enrich.pair_boundaries(t.spark.read.parquet(f"{t.sf_dir}/conversations.parquet").selectExpr("cast(conv_id as string) as container_id", "turn as ts_ms", "case when role = 'user' then 'start' else 'end' end as kind", "text as command")),
  """SELECT container_id, CAST(row_number() OVER (PARTITION BY container_id ORDER BY start_ms) AS BIGINT) AS action_id, start_ms, end_ms FROM (SELECT CAST(conv_id AS VARCHAR) AS container_id, turn AS start_ms, role,
  CASE WHEN lead(role) OVER w <> 'user' THEN lead(turn) OVER w END AS end_ms FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, CASE WHEN role = 'user' THEN 'start' ELSE 'end' END)) WHERE role = 'user'""")  # fmt: skip


NOON = derived.DAY0 + 10 * 86_400_000 + 43_200_000


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the receipts of the actions that run at a time say by then, or those of action 0 where none runs."""
    t = Tables(spark, sf_dir, NOON)
    now = t.actions.where(F.col("start_ms") <= NOON).where((F.col("end_ms") >= NOON) | F.col("end_ms").isNull()).groupBy("container_id").agg(F.max("action_id").alias("now"))
    # what a receipt says depends on the processes of its own action alone
    known = t.events.select("container_id").distinct().join(now, "container_id", "left").select("container_id", F.coalesce("now", F.lit(0).cast("long")).alias("action_id"))
    asked = stash(known, "asked")
    t.made["pids"] = stash(t.pids.join(asked, ["container_id", "action_id"], "left_semi"), "pids")
    rows = t.diff.join(asked, ["container_id", "action_id"], "left_semi")
    return rows.select("container_id", "action_id", "rank", "verb", "subject", "detail")


def removed_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of containers without two. These leave with their events, as no table mixes containers; what the kept tables were made of goes once they are."""
    t = Tables(spark, sf_dir)
    left = views.without_containers({"events": events_of(t), "actions": t.actions}, ["c3", "c5"])
    t.made["events"], t.made["actions"] = stash(left["events"], "events"), left["actions"]
    procs, forks, hubs = t.procs, t.forks, t.hubs
    for name in ("events", "routed", "attributed", "files", "queues"):
        discard(t.made[name])
    return views.container_status(procs, graph.edge_counts(forks, hubs), t.actions)


register("legend", "container_id action_id command colour", lambda t: views.legend(t.sessions),
  f"SELECT container_id, action_id, left(command, 30) AS command, {[fill for fill, _ in schema.ACTION_COLOURS]}[(action_id - 1) % 20 + 1] AS colour FROM sessions")
register("experiment_graph", "experiment_id kind container_id source target label",
  lambda t: views.experiment_graph(t.experiments, t.nodes, t.drawn, views.data_edges(t.files, t.shown), t.conns, t.owners, t.scores),
  """SELECT DISTINCT m.experiment_id, kind, m.container_id, source, target, label FROM (
  SELECT e.container_id, 'process' AS kind, CAST(src AS VARCHAR) AS source, CAST(dst AS VARCHAR) AS target, channel_type AS label FROM edges e JOIN nodes a ON a.container_id = e.container_id AND a.pid = e.src JOIN nodes b ON b.container_id = e.container_id AND b.pid = e.dst
  UNION ALL SELECT f.container_id, 'file', CASE role WHEN 'writer' THEN CAST(f.pid AS VARCHAR) ELSE f.path END, CASE role WHEN 'writer' THEN f.path ELSE CAST(f.pid AS VARCHAR) END, CASE role WHEN 'writer' THEN 'write' WHEN 'reader' THEN 'read' ELSE 'exec' END
    FROM files f JOIN shown s ON s.container_id = f.container_id AND s.path = f.path JOIN nodes n ON n.container_id = f.container_id AND n.pid = f.pid WHERE role IN ('writer', 'reader', 'executor')
  UNION ALL SELECT c.container_id, 'network', CASE direction WHEN 'connect' THEN CAST(c.pid AS VARCHAR) ELSE addr END, CASE direction WHEN 'connect' THEN addr ELSE CAST(c.pid AS VARCHAR) END, direction
    FROM conns c JOIN nodes n ON n.container_id = c.container_id AND n.pid = c.pid WHERE addr NOT LIKE '0.0.0.0:%') g JOIN members m ON m.container_id = g.container_id
  UNION SELECT m.experiment_id, 'cross', c.container_id, CAST(c.pid AS VARCHAR), o.container_id || ':80', addr FROM conns c JOIN owners o ON direction = 'connect' AND c.addr = o.ip || ':80' JOIN members m ON m.container_id = c.container_id
    JOIN members n ON n.container_id = o.container_id AND n.experiment_id = m.experiment_id JOIN scores s ON s.container_id = c.container_id AND s.pid = c.pid AND s.score >= 0.1 WHERE c.container_id <> o.container_id""")  # fmt: skip

#: (query, SQL) of queries over other tables than Tables makes as a rule.
WHOLE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "snapshot_receipts": (snapshot, sql("SELECT container_id, action_id, rank, verb, subject, detail FROM diff WHERE action_id = 11").replace("AS ts_ms FROM events)", f"AS ts_ms FROM events) WHERE ts_ms <= {NOON}")),
    "removed_containers": (removed_containers, sql("SELECT * FROM status WHERE container_id NOT IN ('c3', 'c5')")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: query(columns)(make) for name, (columns, make, _) in QUERIES.items()} | {name: q for name, (q, _) in texts.TEXT_QUERIES.items()}
    return out | {name: q for name, (q, _) in WHOLE.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: sql(body) for name, (_, _, body) in QUERIES.items() if body} | {name: sql(body) for name, (_, body) in texts.TEXT_QUERIES.items()}
    return out | {name: body for name, (_, body) in WHOLE.items()}

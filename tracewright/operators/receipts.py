"""Receipts: what happened within an action, as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.functions import exprs as X
from tracewright.operators.graph import at_hubs, edge_of_code, pair_counts, pairs_of, placed_edges, with_codes
from tracewright.shared import stash


def action_pids(ops: DataFrame) -> DataFrame:
    """Processes with a process fact in an action."""
    return ops.where("class = 'process'").select("container_id", "action_id", "pid").distinct()


def cross_action_flows(access: DataFrame, pids: DataFrame, by_writer: bool = True) -> DataFrame:
    """container_id, action_id, path, writer_action, writer, pid: files that an action's processes read or run, never having
    written them, and that were written in another action. Hot files are joined by path and container, pairs of writer and user only;
    without ``by_writer`` a file's writers are one for each action, and so there are no pairs of processes."""
    rows = access.where((F.col("action_id") >= 0) & ~X.is_receipt_noise(F.col("path")))
    wrote = rows.where("role = 'writer'").select("container_id", "path", F.col("pid").alias("writer"), F.col("action_id").alias("writer_action")).distinct()
    users = rows.where("role in ('reader', 'executor')").select("container_id", "path", "pid").distinct()
    users = users.join(wrote.select("container_id", "path", F.col("writer").alias("pid")).distinct(), ["container_id", "path", "pid"], "left_anti").join(pids.select("container_id", "action_id", "pid").distinct(), ["container_id", "pid"])
    who = ["writer"] if by_writer else []
    wrote = wrote.where("writer_action <> 0").select("container_id", "path", "writer_action", *who).distinct()
    out = at_hubs(stash(wrote, "wrote"), stash(users, "users"), ["container_id", "path"]).where("writer_action <> action_id")
    # rows are distinct by themselves, as both sides are
    return out.select("container_id", "action_id", "path", "writer_action", *who, "pid")


def explained_reads(access: DataFrame, pids: DataFrame) -> DataFrame:
    """container_id, action_id, pid, path of cross_action_flows, a row for each instead of one for each action that wrote the file: its first and last such action tell whether there is another."""
    rows = access.where((F.col("action_id") >= 0) & ~X.is_receipt_noise(F.col("path")))
    wrote = rows.where("role = 'writer'").select("container_id", "path", "pid").distinct()
    by = rows.where("role = 'writer' and action_id <> 0").groupBy("container_id", "path").agg(F.min("action_id").alias("low"), F.max("action_id").alias("high"))
    users = rows.where("role in ('reader', 'executor')").select("container_id", "path", "pid").distinct().join(wrote, ["container_id", "path", "pid"], "left_anti")
    users = users.join(pids.select("container_id", "action_id", "pid").distinct(), ["container_id", "pid"])
    return users.join(by, ["container_id", "path"]).where("low <> action_id or high <> action_id").select("container_id", "action_id", "pid", "path")


def reads_by_process(access: DataFrame, opened: DataFrame, pids: DataFrame, flows: DataFrame) -> DataFrame:
    """container_id, action_id, pid, path: what an action's processes read, ran or opened at any time, less what flows explain."""
    rows = access.where("role in ('reader', 'executor')").select("container_id", "pid", "path").union(opened.select("container_id", "pid", "path"))
    rows = rows.where(~X.is_receipt_noise(F.col("path"))).distinct().join(pids, ["container_id", "pid"])
    return rows.join(flows.select("container_id", "action_id", "pid", "path").distinct(), ["container_id", "action_id", "pid", "path"], "left_anti").select("container_id", "action_id", "pid", "path")


def writes_by_process(access: DataFrame, pids: DataFrame) -> DataFrame:
    rows = access.where((F.col("role") == "writer") & ~X.is_receipt_noise(F.col("path"))).select("container_id", "action_id", "pid", "path").distinct()
    return rows.join(pids, ["container_id", "action_id", "pid"], "left_semi")


def compressed(files: DataFrame, *keys: str) -> DataFrame:
    """files (keys, path): per key one string of its distinct paths, long lists of a directory shortened.

    Up to three paths, and sensitive ones always, stand as they are. Of a directory with more: names that
    differ in one number without gaps become a range, up to five become a list, more become the first two
    and the last.
    """
    rows = files.select(*keys, "path").distinct().withColumn("plain", ~X.is_receipt_sensitive(F.col("path")))
    counts = rows.groupBy(*keys).agg(F.count_if("plain").alias("n_plain"), F.count("*").alias("n_all"))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = rows.join(counts, list(keys)).withColumn("one", ~F.col("plain") | (F.col("n_all") <= 3) | (F.col("n_plain") <= 3))
    rows = rows.withColumns({"dir": F.when(~F.col("one"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "name": name})
    part = lambda i: F.regexp_extract("name", r"^([^0-9]*)([0-9]+)(.*)$", i)
    rows = rows.withColumns({"prefix": part(1), "number": part(2), "suffix": part(3)})
    value = F.col("number").try_cast("long")
    single = rows.where("one").select(*keys, F.col("path").alias("item"))
    by_dir = rows.where("not one").groupBy(*keys, "dir").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"), F.min("number").alias("low"), F.max("number").alias("high"), F.min("prefix").alias("p"), F.min("suffix").alias("s"),
        ((F.count_distinct("prefix", "suffix", F.length("number")) == 1) & (F.min(F.length("number")) > 0) & (F.max(value) - F.min(value) + 1 == F.count("*"))).alias("gapless"),
    )
    names = F.col("names")
    spread = F.concat("dir", F.lit("/"), "p", F.lit("{"), "low", F.lit(".."), "high", F.lit("}"), "s")
    many = F.concat("dir", F.lit("/{"), names[0], F.lit(","), names[1], F.lit(",... "), F.element_at(names, -1), F.lit("} ("), "n", F.lit(" files)"))
    item = F.when(F.col("n") == 1, F.concat("dir", F.lit("/"), names[0])).when((F.col("n") >= 3) & F.col("gapless"), spread).when(F.col("n") <= 5, F.concat("dir", F.lit("/{"), F.array_join("names", ","), F.lit("}"))).otherwise(many)
    rows = single.unionByName(by_dir.select(*keys, item.alias("item")))
    return rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("item")), ", ").alias("files"))


def process_summary(ops: DataFrame, procs: DataFrame) -> DataFrame:
    """container_id, action_id, command, n, first_seq, pid, name, cmdline: execs by their process's command line, alike up to generated names and addresses, with the first of them."""
    execs = ops.where("class = 'process' and op = 'Exec'").join(procs.select("container_id", "pid", "exe", "cmdline", F.col("comm").alias("name")), ["container_id", "pid"])
    execs = execs.where(~X.is_runtime(F.col("exe"), F.coalesce("name", F.lit(""))))
    command = X.normal_command(F.coalesce(F.nullif("cmdline", F.lit("")), F.col("name"), F.lit("?")))
    first = lambda c: F.min_by(c, "serial").alias(c)
    return execs.withColumn("command", command).groupBy("container_id", "action_id", "command").agg(F.count("*").alias("n"), F.min("serial").alias("first_seq"), first("pid"), first("name"), first("cmdline"))


def process_counts(ops: DataFrame, summary: DataFrame) -> DataFrame:
    """container_id, action_id, n_unique, n_forked, n_exited: how many different commands an action has, and its forks and exits."""
    n = ops.where("class = 'process'").groupBy("container_id", "action_id").agg(F.count_if(F.col("op") == "Fork").alias("n_forked"), F.count_if(F.col("op") == "Exit").alias("n_exited"))
    unique = summary.groupBy("container_id", "action_id").agg(F.count("*").alias("n_unique"))
    return n.join(unique, ["container_id", "action_id"], "left").select("container_id", "action_id", F.coalesce("n_unique", F.lit(0).cast("long")).alias("n_unique"), "n_forked", "n_exited")


def network_flows(conns: DataFrame, pids: DataFrame, owners: DataFrame) -> DataFrame:
    """container_id, action_id, pid, direction, addr, owner: connections of an action's processes, with the container that owns the address."""
    rows = conns.join(pids, ["container_id", "pid"]).withColumn("ip", X.address_ip(F.col("addr")))
    return rows.join(owners.select("ip", F.col("container_id").alias("owner")), "ip", "left").select("container_id", "action_id", "pid", "direction", "addr", "owner")


def cross_container_flows(conns: DataFrame, owners: DataFrame, experiments: DataFrame) -> DataFrame:
    """experiment_id, source, target, addr: connections between two containers of one experiment."""
    members = experiments.select("experiment_id", F.explode("container_ids").alias("member")).distinct()
    rows = conns.where("direction = 'connect'").withColumn("ip", X.address_ip(F.col("addr"))).join(owners.select("ip", F.col("container_id").alias("target")), "ip").where("container_id <> target")
    rows = rows.join(members, F.col("container_id") == F.col("member")).drop("member")
    both = members.select(F.col("experiment_id").alias("e"), F.col("member").alias("m"))
    rows = rows.join(both, (F.col("experiment_id") == F.col("e")) & (F.col("target") == F.col("m")), "left_semi")
    return rows.select("experiment_id", F.col("container_id").alias("source"), "target", "addr").distinct()


def cross_container_edges(conns: DataFrame, owners: DataFrame, experiments: DataFrame, scores: DataFrame) -> DataFrame:
    """experiment_id, source, target, n_pids: cross-container flows of tainted processes, as edges between containers."""
    tainted = conns.join(scores.where(F.col("score") >= schema.TAINTED).select("container_id", "pid"), ["container_id", "pid"], "left_semi")
    flows = cross_container_flows(tainted, owners, experiments)
    users = tainted.where("direction = 'connect'").select(F.col("container_id").alias("source"), "addr", "pid")
    return flows.join(users, ["source", "addr"]).groupBy("experiment_id", "source", "target").agg(F.count_distinct("pid").alias("n_pids"))


def experiment_action(counts: DataFrame, experiments: DataFrame) -> DataFrame:
    """experiment_id, action_id, verb, n_containers, n: one action's flows over all containers of an experiment. counts: as of flow_counts."""
    members = experiments.select("experiment_id", F.explode("container_ids").alias("container_id"))
    return counts.join(members, "container_id").groupBy("experiment_id", "action_id", "verb").agg(F.count_distinct("container_id").alias("n_containers"), F.sum("n").alias("n"))


def experiment_receipt(experiments: DataFrame, actions: DataFrame, ops: DataFrame, procs: DataFrame, conns: DataFrame, pids: DataFrame, owners: DataFrame) -> DataFrame:
    """experiment_id, section, container_id, nth, line: the whole receipt of each experiment, a row for a line.

    Sections: 0 header, 1 containers with their actions that have events, 2 connections between containers of the experiment, 3 network of
    each container's processes in actions. Lines are numbered within a section and container; container_id is empty in the header.
    """
    members = experiments.select("experiment_id", F.explode("container_ids").alias("container_id")).distinct()
    short, one = F.left("container_id", F.lit(12)), F.lit(1)
    part = lambda df, section, at, line: df.select("experiment_id", F.lit(section).alias("section"), "container_id", at.cast("long").alias("at"), line.alias("line"))
    head = experiments.withColumn("container_id", F.lit(""))
    n_ops = ops.groupBy("container_id", "action_id").agg(F.count("*").alias("n"))
    listed = actions.where("end_ms is not null").join(n_ops, ["container_id", "action_id"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    totals = listed.groupBy("container_id").agg(F.count("*").alias("n_actions"), F.sum("n").alias("n_events"))
    known = members.join(procs.groupBy("container_id").agg(F.count("*").alias("n_processes")), "container_id").join(totals, "container_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    told = members.join(listed.where("action_id > 0 and n > 0"), "container_id")
    labels = procs.select("container_id", "pid", X.process_label(F.col("comm"), F.col("pid")).alias("label"))
    named = conns.where("direction = 'connect'").join(labels, ["container_id", "pid"]).withColumn("ip", X.address_ip(F.col("addr"))).join(owners.select("ip", F.col("container_id").alias("owner")), "ip", "left")
    named = members.join(named, "container_id")
    over = named.where("owner <> container_id").join(members.select("experiment_id", F.col("container_id").alias("owner")), ["experiment_id", "owner"], "left_semi")
    own = named.join(pids.select("container_id", "pid").distinct(), ["container_id", "pid"], "left_semi")
    text = F.concat
    rows = [
        part(head, 0, F.lit(0), text(F.lit("=== Experiment Receipt: "), "name", F.lit(" ==="))), part(head, 0, one, text(F.lit("Containers: "), F.size("container_ids"))),
        part(known, 1, F.lit(-2), text(F.lit("Container "), short)), part(known, 1, F.lit(-1), text(zero("n_actions"), F.lit(" actions, "), "n_processes", F.lit(" processes, "), zero("n_events"), F.lit(" events"))),
        part(told, 1, F.col("action_id"), text(F.lit("Action #"), "action_id", F.lit(": "), F.coalesce("command", F.lit("")), F.lit(" ("), "n", F.lit(" events)"))),
        part(over, 2, one, text("label", F.lit(" ["), short, F.lit("] -> "), "addr", F.lit(" ["), F.left("owner", F.lit(12)), F.lit("]"))).distinct(),
        part(own, 3, one, text("label", F.lit(" ["), short, F.lit("] connects "), "addr", F.coalesce(text(F.lit(" ("), "owner", F.lit(")")), F.lit("")))),
    ]
    nth = F.row_number().over(Window.partitionBy("experiment_id", "section", "container_id").orderBy("at", "line"))
    return reduce(DataFrame.unionByName, rows).withColumn("nth", nth).select("experiment_id", "section", "container_id", "nth", "line")


def shown_communities(groups: DataFrame, most: int = 3) -> DataFrame:
    """container_id, shown, hidden_processes: how many groups of more than so many members there are, and the processes of the rest."""
    return groups.groupBy("container_id").agg(F.count_if(F.col("size") > most).alias("shown"), F.coalesce(F.sum(F.when(F.col("size") <= most, F.col("size"))), F.lit(0)).alias("hidden_processes"))


def preexisting_influence(forks: DataFrame, hubs: DataFrame, pids: DataFrame, scores: DataFrame) -> DataFrame:
    """container_id, action_id, src, dst, channel_type: edges from tainted processes of an action to processes outside it that were raised by others.

    forks: edges between two processes; hubs: those over files and queues, of which pairs are made for such processes alone.
    """
    sources, raised = influence_ends(pids, scores)
    pids = pids.select("container_id", "action_id", "pid").distinct()
    over = pairs_of(hubs, sources.join(pids, ["container_id", "pid"]), with_actions(raised, pids, "theirs"), False, ~F.array_contains("theirs", F.col("action_id")))
    return outside(influence_forks(forks, sources, raised), pids).unionByName(over.select("container_id", "action_id", "src", "dst", "channel_type"))


def with_actions(who: DataFrame, pids: DataFrame, name: str) -> DataFrame:
    """who (container_id, pid) with the actions of each as an array of this name, of which a process has a few."""
    own = pids.groupBy("container_id", "pid").agg(F.array_sort(F.collect_set("action_id")).alias(name))
    return who.distinct().join(own, ["container_id", "pid"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))


def influence_ends(pids: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(container_id, pid) of tainted processes of actions, and of processes that were raised by others."""
    tainted = scores.where(F.col("score") >= schema.TAINTED).select("container_id", "pid")
    raised = scores.where(F.col("score") > F.col("initial")).select("container_id", "pid")
    return tainted.join(pids.select("container_id", "pid").distinct(), ["container_id", "pid"], "left_semi"), raised


def influence_forks(forks: DataFrame, sources: DataFrame, raised: DataFrame) -> DataFrame:
    rows = forks.join(sources.withColumnRenamed("pid", "src"), ["container_id", "src"], "left_semi").join(raised.withColumnRenamed("pid", "dst"), ["container_id", "dst"], "left_semi")
    return rows.select("container_id", "src", "dst", "channel_type")


def outside(rows: DataFrame, pids: DataFrame) -> DataFrame:
    """container_id, action_id, src, dst, channel_type: edges from an action's processes to those that aren't."""
    rows = rows.join(pids.select("container_id", "action_id", F.col("pid").alias("src")), ["container_id", "src"])
    return rows.join(pids.select("container_id", "action_id", F.col("pid").alias("dst")), ["container_id", "action_id", "dst"], "left_anti").select("container_id", "action_id", "src", "dst", "channel_type")


def of_actions(between: DataFrame, pids: DataFrame) -> DataFrame:
    """container_id, action_id, src, dst, channel_type: edges of which either end is the action's."""
    ends = between.select("container_id", "src", "dst", "channel_type", F.explode(F.array_distinct(F.array("src", "dst"))).alias("pid"))
    return ends.join(pids.select("container_id", "action_id", "pid"), ["container_id", "pid"]).select("container_id", "action_id", "src", "dst", "channel_type").distinct()


def flow_row(df: DataFrame, rank: int, verb: Column, subject: Column, detail: Column) -> DataFrame:
    return df.select("container_id", "action_id", F.lit(rank).alias("rank"), verb.alias("verb"), subject.cast("string").alias("subject"), detail.alias("detail"))


def single_flows(flows: DataFrame, reads: DataFrame, writes: DataFrame, network: DataFrame) -> list[DataFrame]:
    """Rows of data_flow_diff that are those of one process each."""
    return [
        flow_row(flows, 0, F.lit("flow"), F.col("pid"), F.concat("path", F.lit(" from action "), "writer_action")), flow_row(reads, 1, F.lit("read"), F.col("pid"), F.col("path")), flow_row(writes, 2, F.lit("write"), F.col("pid"), F.col("path")),
        flow_row(network.where("direction = 'connect'"), 4, F.lit("connect"), F.col("pid"), F.concat("addr", F.coalesce(F.concat(F.lit(" ("), "owner", F.lit(")")), F.lit("")))),
        flow_row(network.where("direction = 'listen'"), 5, F.lit("listen"), F.col("pid"), F.col("addr")),
    ]


def flow_counts(flows: DataFrame, reads: DataFrame, writes: DataFrame, forks: DataFrame, hubs: DataFrame, pids: DataFrame, network: DataFrame, scores: DataFrame) -> DataFrame:
    """container_id, action_id, verb, n: how many rows of each verb data_flow_diff has, where those over hubs are counted without making pairs."""
    key = ["container_id", "action_id"]
    pids = pids.select("container_id", "pid", "action_id").distinct()
    n = F.lit(1).cast("long").alias("n")
    rows = [reduce(DataFrame.unionByName, single_flows(flows, reads, writes, network)).distinct().select(*key, "verb", n), of_actions(forks.select("container_id", "src", "dst", "channel_type"), pids).select(*key, F.col("channel_type").alias("verb"), n)]
    # edges that an action's process is at either end of: from it, to it, less those within
    queues, to = hubs.where("channel_type <> 'file'"), pids.withColumnRenamed("action_id", "to_action")
    rows += [
        pair_counts(queues, sources=pids).select(*key, F.col("channel_type").alias("verb"), "n"), pair_counts(queues, targets=pids).select(*key, F.col("channel_type").alias("verb"), "n"),
        pair_counts(queues, pids, to).where("action_id = to_action").select(*key, F.col("channel_type").alias("verb"), (-F.col("n")).alias("n")),
    ]
    # influence: edges from an action's tainted processes to raised ones, less those within
    sources, raised = (stash(df, "ends") for df in influence_ends(pids, scores))
    own, within = sources.join(pids, ["container_id", "pid"]), raised.join(to, ["container_id", "pid"])
    rows += [
        outside(influence_forks(forks, sources, raised), pids).select(*key, F.lit("influence").alias("verb"), n), pair_counts(hubs, own, raised).select(*key, F.lit("influence").alias("verb"), "n"),
        pair_counts(hubs, own, within).where("action_id = to_action").select(*key, F.lit("influence").alias("verb"), (-F.col("n")).alias("n")),
    ]
    return reduce(DataFrame.union, rows).groupBy(*key, "verb").agg(F.sum("n").alias("n")).where("n > 0")


def data_flow_diff(flows: DataFrame, reads: DataFrame, writes: DataFrame, forks: DataFrame, hubs: DataFrame | None, pids: DataFrame, network: DataFrame, influence: DataFrame | None) -> DataFrame:
    """container_id, action_id, rank, verb, subject, detail: the action's flows of all kinds, distinct, to be sorted by rank, detail, subject. Without hubs, those over queues are left out; without influence, all between two processes."""
    pids = pids.select("container_id", "action_id", "pid").distinct()
    if influence is None:
        return reduce(DataFrame.unionByName, single_flows(flows, reads, writes, network)).distinct()
    if hubs is None:
        forked = flow_row(of_actions(forks, pids), 3, F.col("channel_type"), F.col("src"), F.col("dst").cast("string"))
        return reduce(DataFrame.unionByName, [*single_flows(flows, reads, writes, network)]).distinct().unionByName(forked).unionByName(influence_rows(influence))
    # files show as reads and writes; all else between two processes, of which either is the action's
    queues = hubs.where("channel_type <> 'file'")
    senders = queues.where("side = 'in'").select("container_id", "pid")
    columns = ["container_id", "action_id", "src", "dst", "channel_type"]
    # those from the action's processes, and those to them from others
    from_, to = pairs_of(queues, sources=pids, timed=False), pairs_of(queues, with_actions(senders, pids, "theirs"), pids, False, ~F.array_contains("theirs", F.col("action_id")))
    own = [of_actions(forks, pids), from_.select(*columns), to.select(*columns)]
    # rows between two processes are distinct by themselves
    return reduce(DataFrame.unionByName, [
        reduce(DataFrame.unionByName, single_flows(flows, reads, writes, network)).distinct(), *[flow_row(df, 3, F.col("channel_type"), F.col("src"), F.col("dst").cast("string")) for df in own],
        influence_rows(influence),
    ])


def influence_rows(influence: DataFrame) -> DataFrame:
    return flow_row(influence, 6, F.lit("influence"), F.col("src"), F.concat(F.col("dst").cast("string"), F.lit(" by "), "channel_type"))


def queue_lines(hubs: DataFrame, pids: DataFrame, procs: DataFrame) -> DataFrame:
    """container_id, action_id, verb, src, other, n: how many processes of each command (other) a process sends to over queues, of those lines
    of data_flow_diff that an action has; counted without making pairs."""
    queues, pids = hubs.where("channel_type <> 'file'"), pids.select("container_id", "pid", "action_id").distinct()
    end = lambda side: queues.where(F.col("side") == side).select("container_id", "pid").distinct()
    src = end("in").withColumn("src", F.col("pid"))
    dst = end("out").join(procs.select("container_id", "pid", F.col("comm").alias("other")), ["container_id", "pid"], "left").withColumn("other", F.coalesce("other", F.lit("?")))
    from_, to = stash(src.join(pids, ["container_id", "pid"]), "ends"), stash(dst.join(pids.withColumnRenamed("action_id", "to_action"), ["container_id", "pid"]), "ends")
    row = lambda df, action, sign: df.select("container_id", F.col(action).alias("action_id"), F.col("channel_type").alias("verb"), "src", "other", (F.lit(sign) * F.col("n")).alias("n"))
    # from the action's processes, to them, less those within
    rows = [row(pair_counts(queues, from_, dst), "action_id", 1), row(pair_counts(queues, src, to), "to_action", 1), row(pair_counts(queues, from_, to).where("action_id = to_action"), "action_id", -1)]
    return reduce(DataFrame.union, rows).groupBy("container_id", "action_id", "verb", "src", "other").agg(F.sum("n").alias("n")).where("n > 0")


def merged(diff: DataFrame, procs: DataFrame, pids: bool = False, queued: DataFrame | None = None) -> DataFrame:
    """Lines of data_flow_diff that differ in processes alone, merged by their commands, with their number and the first and last pid.

    Lines between two processes name the other one's command. pids: all pids as one text as well, which gathers a line's
    processes into a row. queued: lines over queues as of queue_lines, if diff is without them.
    """
    names = procs.select("container_id", F.col("pid").cast("string").alias("subject"), "comm")
    others = names.select("container_id", F.col("subject").alias("detail"), F.col("comm").alias("other"), F.lit(3).alias("rank"))
    rows = diff.join(names, ["container_id", "subject"], "left").join(others, ["container_id", "rank", "detail"], "left")
    detail = F.when(F.col("rank") == 3, F.coalesce("other", F.lit("?"))).otherwise(F.col("detail"))
    columns = ["container_id", "action_id", "rank", "verb", "detail", "comm"]
    rows = rows.select(*columns[:4], detail.alias("detail"), F.coalesce("comm", F.lit("?")).alias("comm"), F.col("subject").cast("long").alias("pid"), F.lit(1).cast("long").alias("n"))
    if queued is not None:
        named = queued.join(procs.select("container_id", F.col("pid").alias("src"), "comm"), ["container_id", "src"], "left")
        rows = rows.unionByName(named.select("container_id", "action_id", F.lit(3).alias("rank"), "verb", F.col("other").alias("detail"), F.coalesce("comm", F.lit("?")).alias("comm"), F.col("src").cast("long").alias("pid"), "n"))
    texts = [F.array_join(F.array_sort(F.collect_set("pid")), ",").alias("pids")] if pids else []
    return rows.groupBy(*columns).agg(F.sum("n").alias("n"), F.min("pid").alias("first_pid"), F.max("pid").alias("last_pid"), *texts)


def placed_lines(forks: DataFrame, hubs: DataFrame, pids: DataFrame, scores: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """Under their rank, the lines of data_flow_diff between two processes, as placed_edges has them: 3 over queues and forks, 6 influence."""
    pids = stash(pids.select("container_id", "action_id", "pid").distinct(), "pids-of-actions")
    queues = hubs.where("channel_type <> 'file'")
    units = queues.select("container_id", F.lit("").alias("unit"), F.col("channel_type").alias("kind"), F.concat("channel_type", F.lit(":"), "hub").alias("hub"), "side", "pid")
    receivers = with_actions(queues.where("side = 'out'").select("container_id", "pid"), pids, "theirs")
    direct = of_actions(forks, pids).select("container_id", F.lit("").alias("unit"), F.col("channel_type").alias("kind"), "action_id", "src", "dst")
    out = {3: placed_edges(units, direct, pids, receivers, True)}
    sources, raised = (stash(df, "ends") for df in influence_ends(pids, scores))
    units = hubs.select("container_id", F.col("channel_type").alias("unit"), F.col("channel_type").alias("kind"), "hub", "side", "pid")
    direct = outside(influence_forks(forks, sources, raised), pids).select("container_id", F.col("channel_type").alias("unit"), F.col("channel_type").alias("kind"), "action_id", "src", "dst")
    return out | {6: placed_edges(units, direct, sources.join(pids, ["container_id", "pid"]), with_actions(raised, pids, "theirs"), False)}


def line_of(rank: int, src: Column, dst: Column, kind: Column) -> Column:
    """The line of an edge, as data_flow_diff's columns make it."""
    return F.concat_ws(" ", kind, src, dst) if rank == 3 else F.concat(F.lit("influence "), src, F.lit(" "), dst, F.lit(" by "), kind)


def numbered_lines(rank: int, placed: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(container_id, action_id, nth, line) of an action's lines of a rank, and (container_id, action_id, n): how many there are."""
    rows = with_codes(placed, lists).select("container_id", "action_id", "dst", "at", F.posexplode("codes").alias("i", "code"))
    src, kind = edge_of_code(F.col("code"))
    rows = rows.select("container_id", "action_id", (F.col("at") + F.col("i") + 1).alias("nth"), line_of(rank, src.cast("string"), F.col("dst").cast("string"), kind).alias("line"))
    return rows, placed.groupBy("container_id", "action_id").agg(F.sum("n").alias("n"))


def receipts(actions: DataFrame, ops: DataFrame, summary: DataFrame, groups: DataFrame, diff: DataFrame, found: DataFrame, between: dict[int, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """container_id, action_id, section, nth, line: each action's whole receipt, a row for a line.

    Sections: 0 header, 1 processes, 2 communities of more than three, 3 flows, 4 detections by severity. Lines of
    a section are numbered in its order, for each action by itself; no receipt is gathered into one row. between: lines between two
    processes as of placed_lines, if diff is without them; their numbers come from those of their target, so they aren't sorted.
    """
    key = ["container_id", "action_id"]
    n = ops.groupBy(*key).agg(F.count("*").alias("n"))
    head = actions.join(n, key, "left").select(*key, F.concat(F.lit("Command: "), F.coalesce("command", F.lit(""))).alias("a"), F.concat(F.lit("Duration: "), F.coalesce(F.round((F.col("end_ms") - F.col("start_ms")) / 1000, 1).cast("decimal(18,1)").cast("string"), F.lit("open")), F.lit("s | "), F.coalesce("n", F.lit(0)), F.lit(" events")).alias("b"))
    part = lambda df, section, line, *order: df.select(*key, F.lit(section).alias("section"), F.struct(*order).alias("order"), line.alias("line"))
    counts = process_counts(ops, summary)
    times = F.when(F.col("n") > 1, F.concat(F.lit(" (x"), "n", F.lit(")"))).otherwise(F.lit(""))
    said = F.concat(F.lit("["), "name", F.lit(":"), "pid", F.lit("]"), F.when(F.coalesce("cmdline", F.lit("")) != "", F.concat(F.lit(" $ "), "cmdline")).otherwise(F.lit("")), times)
    shown = groups.where("size > 3")
    small = groups.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("size") <= 3, F.col("size"))), F.lit(0)).alias("small"), F.count_if(F.col("size") > 3).alias("large")).where("small > 0 and large > 0")
    text = lambda *xs: F.concat(*xs)
    zero, none = F.lit(0).cast("long"), F.lit("")
    rows = [
        part(head, 0, F.col("a"), zero, none), part(head, 0, F.col("b"), F.lit(1).cast("long"), none),
        part(counts.where("n_unique > 0 or n_forked > 0"), 1, text("n_unique", F.lit(" unique, "), "n_forked", F.lit(" forked, "), "n_exited", F.lit(" exited")), F.lit(-1).cast("long"), none),
        part(summary, 1, said, F.col("first_seq"), F.col("command")),
        part(shown, 2, text("label", F.lit(" ("), "size", F.lit(" processes)")), F.col("community_id").cast("long"), none),
        part(small, 2, text(F.lit("+ "), "small", F.lit(" individual processes")), F.lit(1 << 40).cast("long"), none),
        part(diff, 3, F.concat_ws(" ", "verb", "subject", "detail"), F.col("rank").cast("long"), F.concat_ws(" ", "detail", "subject", "verb")),
        part(found, 4, text(X.severity_mark(F.col("severity")), F.lit(" "), "technique", F.lit(" "), "pid", F.lit(" "), "description"), (-F.col("severity")).cast("long"), F.concat_ws(" ", "technique", "description", F.lpad(F.col("pid").cast("string"), 12, "0"))),
    ]
    rows = [r.select(*key, "section", F.col("order").cast("struct<a:bigint,b:string>").alias("order"), "line") for r in rows]
    all_rows = reduce(DataFrame.unionByName, rows)
    alone = all_rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "section").orderBy("order", "line")))
    if not between:
        return alone.select(*key, "section", "nth", "line")
    alone, rank = stash(alone, "alone"), F.col("order")["a"]
    out, ranks = [], sorted(between)
    lines = {r: numbered_lines(r, *between[r]) for r in ranks}
    # lines of a rank come after all of lower ones, whichever kind they are
    totals = reduce(DataFrame.unionByName, [lines[r][1].withColumn("rank", F.lit(r).cast("long")) for r in ranks]).unionByName(alone.where("section = 3").groupBy(*key, rank.alias("rank")).agg(F.count("*").alias("n")))
    totals = stash(totals, "totals")
    before = lambda r, which: totals.where((F.col("rank") < r) & which).groupBy(*key).agg(F.sum("n").alias("before"))
    place = (F.col("nth") + F.coalesce("before", F.lit(0).cast("long"))).cast("int").alias("nth")
    out.append(alone.where((F.col("section") != 3) | (rank < ranks[0])).select(*key, "section", "nth", "line"))
    for r, beyond in zip(ranks, [*ranks[1:], None]):
        out.append(lines[r][0].join(F.broadcast(before(r, F.lit(True))), key, "left").select(*key, F.lit(3).alias("section"), place, "line"))
        later = alone.where((F.col("section") == 3) & (rank > r) & (F.lit(True) if beyond is None else rank < beyond))
        out.append(later.join(before(r + 1, F.col("rank").isin(ranks)), key, "left").select(*key, "section", place, "line"))
    return reduce(DataFrame.unionByName, out)


def receipt_text(diff: DataFrame, between: dict[int, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """One text per action: its lines in order of rank, detail, subject; lines that tie in these (a fork and a queue between the same two) go by verb.

    between: lines between two processes as of placed_lines, if diff is without them; those of one target are joined by themselves, and an
    action gathers a piece for each target instead of a line for each pair.
    """
    line = F.concat_ws(" ", "verb", "subject", "detail")
    key, none = ["container_id", "action_id"], F.lit("")
    rows = diff.select(*key, F.struct("rank", "detail", "subject", "verb", line.alias("line")).alias("piece"))
    for rank, (placed, lists) in (between or {}).items():
        dst = F.col("dst").cast("string")
        told = with_codes(placed, lists).where("n > 0").withColumn("lines", F.transform("codes", lambda c: line_of(rank, edge_of_code(c)[0].cast("string"), F.col("dst").cast("string"), edge_of_code(c)[1])))  # noqa: B023
        detail = dst if rank == 3 else F.concat(dst, F.lit(" by "), "unit")
        rows = rows.union(told.select(*key, F.struct(F.lit(rank).alias("rank"), detail.alias("detail"), none.alias("subject"), none.alias("verb"), F.array_join("lines", "\n").alias("line")).alias("piece")))
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["line"]), "\n").alias("receipt"))

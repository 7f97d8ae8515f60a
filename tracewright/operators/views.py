"""Tables for lists and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.functions import exprs as X


def action_list(actions: DataFrame, ops: DataFrame) -> DataFrame:
    n = ops.groupBy("container_id", "action_id").agg(F.count("*").alias("total_events"), F.count_if(F.col("class") == "process").alias("process_events"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return actions.join(n, ["container_id", "action_id"], "left").select("container_id", "action_id", "command", "start_ms", "end_ms", zero("total_events"), zero("process_events"))


def container_status(procs: DataFrame, edge_counts: DataFrame, actions: DataFrame) -> DataFrame:
    """container_id, n_processes, n_exited, n_edges, n_actions, active_action. edge_counts: (container_id, n_edges)."""
    p = procs.groupBy("container_id").agg(F.count("*").alias("n_processes"), F.count_if("exited").alias("n_exited"))
    a = actions.groupBy("container_id").agg(F.count_if(F.col("end_ms").isNotNull()).alias("n_actions"), F.max(F.when(F.col("end_ms").isNull(), F.col("action_id"))).alias("active_action"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return p.join(edge_counts.select("container_id", "n_edges"), "container_id", "left").join(a, "container_id", "left").select("container_id", "n_processes", "n_exited", zero("n_edges"), zero("n_actions"), "active_action")


def listed_containers(status: DataFrame, most: int = 1500) -> DataFrame:
    """Containers worth listing: with an action, and not too many processes."""
    return status.where((F.col("n_actions") >= 1) & (F.col("n_processes") <= most))


def hidden_containers(status: DataFrame, most: int = 1500) -> DataFrame:
    """listed, hidden: how many containers are worth listing, and how many are not."""
    worth = (F.col("n_actions") >= 1) & (F.col("n_processes") <= most)
    return status.agg(F.count_if(worth).alias("listed"), F.count_if(~worth).alias("hidden"))


def shown_files(access: DataFrame) -> DataFrame:
    """container_id, path, class: files with a flow between processes, sensitive, deleted, modified, or written and used."""
    rows = access.where(~X.is_graph_noise(F.col("path")))
    has = lambda role: F.bool_or(F.col("role") == role)
    # by process first: a hot file is aggregated before its processes meet
    by_pid = rows.groupBy("container_id", "path", "pid").agg(has("writer").alias("w"), has("deleter").alias("d"), has("modifier").alias("m"), has("executor").alias("x"), has("reader").alias("r"))
    any_ = lambda c: F.bool_or(c).alias(c)
    out = by_pid.groupBy("container_id", "path").agg(any_("w"), any_("d"), any_("m"), any_("x"), any_("r"), F.bool_or((F.col("r") | F.col("x")) & ~F.col("w")).alias("others"))
    sensitive = X.is_graph_sensitive(F.col("path"))
    crosses = F.col("w") & F.col("others")
    only_run = F.col("x") & ~F.col("w") & ~F.col("r") & ~F.col("d") & ~F.col("m")
    keep = ~only_run & (crosses | sensitive | F.col("d") | F.col("m") | F.col("w") & (F.col("r") | F.col("x")))
    kind = F.when(sensitive, "sensitive").when(F.col("x"), "executed").when(F.col("d"), "deleted").otherwise("data")
    return out.where(keep).select("container_id", "path", kind.alias("class"), X.short_path(F.col("path")).alias("label"))


def graph_nodes(procs: DataFrame, scores: DataFrame, at: DataFrame, most: int = 50) -> DataFrame:
    """The processes of highest score of each container's graph, with action, label and colour."""
    rows = procs.join(scores.select("container_id", "pid", "score"), ["container_id", "pid"]).join(at.select("container_id", "pid", "action_id"), ["container_id", "pid"], "left")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("container_id").orderBy(F.col("score").desc(), "pid"))).where(F.col("nth") <= most)
    action = F.coalesce("action_id", F.lit(0).cast("long"))
    cmd = F.when(F.startswith(F.coalesce("cmdline", F.lit("")), F.lit("runc")), F.col("exe")).otherwise(F.col("cmdline"))
    return rows.select("container_id", "pid", X.process_label(F.col("comm"), F.col("pid")).alias("label"), cmd.alias("cmd"), action.alias("action_id"), F.round("score", 9).alias("score"), X.blended(X.action_colour(action), F.col("score")).alias("colour"), "exited")


def graph_edges(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between shown processes, labelled by their type and coloured by their source's score."""
    ends = nodes.select("container_id", "pid")
    rows = graph.join(nodes.select("container_id", F.col("pid").alias("src"), "score"), ["container_id", "src"]).join(ends.withColumnRenamed("pid", "dst"), ["container_id", "dst"], "left_semi")
    return rows.select("container_id", "src", "dst", "channel_type", "channel", "event_count", F.col("channel_type").alias("label"), X.edge_colour(F.col("score")).alias("colour"))


def experiment_graph(experiments: DataFrame, nodes: DataFrame, edges: DataFrame, data: DataFrame, conns: DataFrame, owners: DataFrame, scores: DataFrame) -> DataFrame:
    """experiment_id, kind, container_id, source, target, label: the graphs of an experiment's containers, and the connections of tainted processes between them.

    Kinds: process, file, network and cross; sources and targets are pids, paths and addresses, in the direction of the flow.
    """
    members = experiments.select("experiment_id", F.explode("container_ids").alias("container_id")).distinct()
    shown = nodes.select("container_id", "pid")
    row = lambda df, kind, source, target, label: df.select("container_id", F.lit(kind).alias("kind"), source.cast("string").alias("source"), target.cast("string").alias("target"), label.alias("label"))
    files = data.where("verb in ('write', 'read', 'exec')").join(shown, ["container_id", "pid"], "left_semi")
    out = F.col("verb") == "write"
    nets = conns.where(X.is_endpoint(F.col("addr"))).join(shown, ["container_id", "pid"], "left_semi")
    to = F.col("direction") == "connect"
    rows = row(edges, "process", F.col("src"), F.col("dst"), F.col("channel_type"))
    rows = rows.union(row(files, "file", F.when(out, F.col("pid").cast("string")).otherwise(F.col("path")), F.when(out, F.col("path")).otherwise(F.col("pid").cast("string")), F.col("verb")))
    rows = rows.union(row(nets, "network", F.when(to, F.col("pid").cast("string")).otherwise(F.col("addr")), F.when(to, F.col("addr")).otherwise(F.col("pid").cast("string")), F.col("direction")))
    inner = rows.join(members, "container_id").select("experiment_id", "kind", "container_id", "source", "target", "label")
    tainted = conns.where("direction = 'connect'").join(scores.where(F.col("score") >= schema.TAINTED).select("container_id", "pid"), ["container_id", "pid"], "left_semi").withColumn("ip", X.address_ip(F.col("addr")))
    far = tainted.join(owners.select("ip", F.col("container_id").alias("owner")), "ip").where("container_id <> owner").join(members, "container_id")
    far = far.join(members.select("experiment_id", F.col("container_id").alias("owner")), ["experiment_id", "owner"], "left_semi")
    listens = F.concat("owner", F.lit(":"), F.substring_index("addr", ":", -1))
    cross = far.select("experiment_id", F.lit("cross").alias("kind"), "container_id", F.col("pid").cast("string").alias("source"), listens.alias("target"), F.col("addr").alias("label"))
    return inner.union(cross).distinct()


def legend(actions: DataFrame) -> DataFrame:
    """action_id, command (shortened), colour of each container's actions, in order of their numbers."""
    return actions.where("action_id > 0").select("container_id", "action_id", F.left("command", F.lit(30)).alias("command"), X.action_colour(F.col("action_id")).alias("colour"))


def without_containers(tables: dict[str, DataFrame], gone: list[str]) -> dict[str, DataFrame]:
    """The tables without all rows of some containers."""
    return {name: df.where(~F.col("container_id").isin(gone)) if gone else df for name, df in tables.items()}


def data_edges(access: DataFrame, shown: DataFrame) -> DataFrame:
    verb = F.create_map(*[F.lit(x) for kv in {"writer": "write", "reader": "read", "executor": "exec", "deleter": "delete", "modifier": "chmod"}.items() for x in kv])
    rows = access.join(shown.select("container_id", "path"), ["container_id", "path"], "left_semi")
    return rows.select("container_id", "path", "pid", verb[F.col("role")].alias("verb")).distinct()


def endpoint_users(conns: DataFrame) -> DataFrame:
    """container_id, addr, direction, pid: who uses an endpoint, a row each; wildcard addresses are left out."""
    return conns.where(X.is_endpoint(F.col("addr"))).select("container_id", "addr", "direction", "pid").distinct()


def endpoints(conns: DataFrame, pids: bool = False) -> DataFrame:
    """Remote and local endpoints with the number of their users; pids: these as one text as well, which gathers them into a row."""
    texts = [F.array_join(F.array_sort(F.collect_list("pid")), ",").alias("pids")] if pids else []
    return endpoint_users(conns).groupBy("container_id", "addr", "direction").agg(F.count("*").alias("n_pids"), *texts)


def entry_points(procs: DataFrame) -> DataFrame:
    """Processes whose parent isn't in their container."""
    parent = procs.select("container_id", F.col("pid").alias("ppid"))
    return procs.where("ppid <> 0").join(parent, ["container_id", "ppid"], "left_anti").select("container_id", "pid", "ppid", "comm")


def first_actions(procs: DataFrame, ops: DataFrame) -> DataFrame:
    """The first action in which each process has a process fact, or 0."""
    first = ops.where("class = 'process' and action_id > 0").groupBy("container_id", "pid").agg(F.min("action_id").alias("first_action"))
    return procs.select("container_id", "pid").join(first, ["container_id", "pid"], "left").select("container_id", "pid", F.coalesce("first_action", F.lit(0).cast("long")).alias("first_action"))


def experiment_totals(experiments: DataFrame, status: DataFrame, actions: DataFrame) -> DataFrame:
    rows = experiments.select("experiment_id", "name", F.explode("container_ids").alias("container_id"))
    return rows.join(status, "container_id", "left").select("experiment_id", "name", "container_id", "n_processes", "n_exited", "n_edges", "n_actions")


def write_receipts(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table in a folder of its own, partitioned by container."""
    for name, df in tables.items():
        df.write.mode("overwrite").partitionBy("container_id").format(form).save(f"{path}/{name}")


def export(status: DataFrame, tables: dict[str, DataFrame], path: str, most: int = 1500) -> None:
    """Everything about the containers worth listing, as JSON lines: each table (with container_id) in a folder of its own."""
    worth = listed_containers(status, most).select("container_id")
    write_receipts({name: df.join(worth, "container_id", "left_semi") for name, df in {"containers": status, **tables}.items()}, path, "json")

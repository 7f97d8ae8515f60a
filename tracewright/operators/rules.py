"""Matching of behaviour against detection rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.functions import exprs as X
from tracewright.operators.enrich import named
from tracewright.shared import stash


def rule_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """rule, name, syscalls, files, processes, excluded, technique, severity; a caller may pass rules of their own."""
    rows = [(i, n, s.split(), f.split(), p.split(), e.split(), t, v) for i, (n, s, f, p, e, t, v) in enumerate(rules or schema.RULES)]
    return spark.createDataFrame(rows, "rule int, name string, syscalls array<string>, files array<string>, processes array<string>, excluded array<string>, technique string, severity int")


#: Rows of a rule table, by pattern or by call, up to which it is broadcast.
BROADCAST_ROWS = 10_000


def few(df: DataFrame) -> DataFrame:
    """df, a stash, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def touching(paths: DataFrame, rules: DataFrame, globs: bool = False) -> DataFrame:
    """path, rule: rules with a file pattern that each distinct path fits.

    Patterns are those of exprs.glob_match, with stars at an end only, or real globs. They are listed under what a path that fits must
    have, its first or last letters, a folder or name in it, or three letters in a row, so that paths meet them by equality, and
    are then tested in full. Only patterns without three letters in a row are tested on each path.
    """
    patterns = rules.select("rule", F.explode("files").alias("pattern")).distinct()
    index = stash(patterns.select("rule", "pattern", X.glob_key(F.col("pattern")).alias("at") if globs else X.ends_key(F.col("pattern")).alias("at")), "patterns")
    # as many as there are lengths of patterns
    lengths = {(r["kind"], r["n"]) for r in index.select("at.kind", "at.n").distinct().collect()}
    keys = X.path_keys(F.col("path"), lengths)
    rows = paths.select("path").where("path is not null").distinct().select("path", F.explode(F.array_distinct(keys)).alias("at"))
    fits = X.full_glob_match(F.col("path"), F.col("pattern")) if globs else X.glob_match(F.col("path"), F.col("pattern"))
    return rows.join(few(index), "at").where(fits).select("path", "rule").distinct()


def matches(subjects: DataFrame, rules: DataFrame, touched: DataFrame | None, *key: str) -> DataFrame:
    """subjects (key columns, syscall_name, exe, comm) with each rule that fits them.

    Rules meet subjects by call, an equality; a rule table of few rows is broadcast. touched: (key, rule) of
    the rules whose file patterns a subject's files fit; those without patterns need none.
    """
    by_call = stash(rules.withColumn("syscall_name", F.explode("syscalls")), "rules")
    rows = subjects.join(few(by_call), "syscall_name").where(~X.is_runtime(F.col("exe"), F.coalesce("comm", F.lit(""))))
    base = F.element_at(F.split(F.coalesce("exe", F.lit("")), "/"), -1)
    names = F.array(base, F.coalesce("comm", F.lit("")))
    rows = rows.where(~F.arrays_overlap("excluded", names) & ((F.size("processes") == 0) | F.arrays_overlap("processes", names)))
    free = rows.where(F.size("files") == 0)
    if touched is not None:
        free = free.unionByName(rows.where(F.size("files") > 0).join(touched.select(*key, "rule").distinct(), [*key, "rule"], "left_semi").select(rows.columns))
    return free.drop("syscalls", "files", "processes", "excluded")


def detections(ops: DataFrame, access: DataFrame, procs: DataFrame, conns: DataFrame, opened: DataFrame, scores: DataFrame, rules: DataFrame) -> DataFrame:
    """container_id, action_id, technique, pid, severity, description: one row per action, technique and process.

    Execs are tested as execve, written files as openat, and network use of tainted processes as connect, in
    this order; the first that fits counts. Plain outbound connections need a remote address.
    """
    who = procs.select("container_id", "pid", "exe", "comm", "cmdline")
    by_path = stash(touching(opened.select("path").union(access.where("role = 'writer'").select("path")), rules), "touching")
    touched = stash(opened.join(by_path, "path").select("container_id", "pid", "rule").distinct(), "touched")
    remotes = conns.where((F.col("direction") == "connect") & ~X.is_local_address(F.col("addr"))).groupBy("container_id", "pid").agg(F.array_sort(F.collect_set("addr")).alias("remotes"))
    key = ["container_id", "pid"]
    execs = ops.where("class = 'process' and op = 'Exec'").groupBy("container_id", "action_id", "pid").agg(F.min("serial").alias("seq"))
    execs = execs.join(who, key).withColumn("syscall_name", F.lit("execve"))
    told = F.when(F.coalesce(F.col("cmdline"), F.lit("")) != "", F.concat("name", F.lit(": "), X.truncated(F.col("cmdline"), 80))).otherwise(F.col("name"))
    first = matches(execs, rules, touched, *key).select("container_id", "action_id", "pid", "rule", "name", "technique", "severity", F.lit(1).alias("pass"), "seq", told.alias("description"))
    wrote = access.where("role = 'writer'").select("container_id", "action_id", "pid", F.col("first_seq").alias("seq"), "path")
    wrote = wrote.join(who, key).withColumn("syscall_name", F.lit("openat"))
    second = matches(wrote, rules, by_path, "path").select("container_id", "action_id", "pid", "rule", "name", "technique", "severity", F.lit(2).alias("pass"), "seq", F.concat("name", F.lit(": "), "path").alias("description"))
    used = ops.where("class = 'net'").groupBy("container_id", "action_id", "pid").agg(F.min("serial").alias("seq")).join(scores.where(F.col("score") >= schema.TAINTED).select(key), key, "left_semi")
    used = used.join(who, key).join(remotes, key, "left").withColumn("syscall_name", F.lit("connect"))
    n = F.size(F.coalesce("remotes", F.array().cast("array<string>")))
    said = F.when(n == 0, F.col("name")).when(n <= 3, F.concat("name", F.lit(": "), F.array_join("remotes", ", "))).otherwise(F.concat("name", F.lit(": "), F.array_join(F.slice("remotes", 1, 2), ", "), F.lit(" +"), n - 2, F.lit(" more")))
    third = matches(used, rules, touched, *key).where((n > 0) | (F.col("technique") != "T1071")).select("container_id", "action_id", "pid", "rule", "name", "technique", "severity", F.lit(3).alias("pass"), "seq", said.alias("description"))
    once = Window.partitionBy("container_id", "action_id", "technique", "pid").orderBy("pass", "seq", "rule", "description")
    rows = first.unionByName(second).unionByName(third).where("action_id > 0").withColumn("nth", F.row_number().over(once))
    return rows.where("nth = 1").select("container_id", "action_id", "technique", "pid", "severity", "description")


def event_matches(events: DataFrame, rules: DataFrame, globs: bool = False) -> DataFrame:
    """Every event against the rules by its own call and path, whatever the call is: container_id, serial, pid, technique, severity.

    globs: file patterns are real globs, of which the whole path must fit, instead of those that detections() knows.
    """
    exe = F.col("exe") if "exe" in events.columns else F.lit(None).cast("string")
    subjects = named(events).select("container_id", "serial", "pid", "syscall_name", exe.alias("exe"), "comm", "path")
    return matches(subjects, rules, touching(events, rules, globs), "path").select("container_id", "serial", "pid", "technique", "severity").distinct()


def by_severity(found: DataFrame) -> DataFrame:
    """Detections with their place in each container's list: the most severe first, then by action."""
    key = ["container_id", "severity", "action_id"]
    # places within an action's detections of one severity, after those of the groups before: no container is sorted as a whole
    before = Window.partitionBy("container_id").orderBy(F.col("severity").desc(), "action_id").rowsBetween(Window.unboundedPreceding, -1)
    groups = found.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy("technique", "pid"))
    return found.withColumn("within", within).join(groups, key).withColumn("nth", (F.col("before") + F.col("within")).cast("int")).drop("before", "within")


def technique_rollup(found: DataFrame) -> DataFrame:
    return found.groupBy("container_id", "action_id", "technique").agg(
        F.max("severity").alias("severity"), F.count_distinct("description").alias("n_descriptions"), F.count("*").alias("n"), F.min("description").alias("example"),
    ).withColumn("mark", X.severity_mark(F.col("severity")))

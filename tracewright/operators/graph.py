"""The graph between processes: edges, scores that spread along them, communities.

Flows over files and queues are kept as a factorised graph: processes link to hubs (a file or a queue), and hubs to
processes. It has one row for an access, where pairs of processes would be as many as a hub's writers times its
readers. Scores and communities work on hubs; rows for pairs are made for the pairs that are asked for.

Functions with ``key`` work within each value of these columns, a container as a rule, or an action in it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.functions import exprs as X
from tracewright.operators.enrich import action_at_time
from tracewright.shared import discard, stash

EDGE = ["container_id", "src", "dst", "channel_type", "channel", "event_count"]
CONTAINER = ("container_id",)
#: Event count from which an edge joins communities.
LEAST_EVENTS = 10
#: Hubs of a process up to which all sets within them are listed, a thousand at most.
SMALL_SET = 10
#: Hubs of a process up to which each of its accesses carries the others along.
FEW_HUBS = 16
#: Rows of a hub's sources that meet its targets in one task.
PAIRED = 1024


def fork_edges(procs: DataFrame) -> DataFrame:
    """Parent to child, where the parent was seen before."""
    parent = procs.select(F.col("container_id").alias("c"), F.col("pid").alias("src"), F.col("first_seq").alias("parent_seq"))
    rows = procs.join(parent, (F.col("container_id") == F.col("c")) & (F.col("ppid") == F.col("src")) & (F.col("parent_seq") < F.col("first_seq")))
    return rows.select("container_id", "src", F.col("pid").alias("dst"), F.lit("fork").alias("channel_type"), F.concat(F.lit("fork (child of pid "), "src", F.lit(")")).alias("channel"), F.lit(1).cast("long").alias("event_count"), F.col("first_ts").alias("seen_ms"))


def hub_links(files: DataFrame, queues: DataFrame) -> DataFrame:
    """container_id, channel_type, hub, side, pid, seen_ms: the factorised graph of flows over files and queues.

    Side "in": writers of a file, senders of a queue. Side "out": those that read or run a file without ever writing it, and a
    queue's receivers. A process gives nothing to itself: in a queue that it both sends to and receives from, it is on both sides.
    seen_ms is the first time of that access.
    """
    seen = lambda df: F.min("first_ms" if "first_ms" in df.columns else F.lit(None).cast("long")).alias("seen_ms")
    rows = files.where(~X.is_flow_noise(F.col("path")) & F.col("role").isin("writer", "reader", "executor"))
    side = F.when(F.col("role") == "writer", "in").otherwise("out")
    rows = rows.groupBy("container_id", F.col("path").alias("hub"), "pid", side.alias("side")).agg(seen(files))
    wrote = rows.where("side = 'in'").select("container_id", "hub", "pid")
    used = rows.where("side = 'out'").join(wrote, ["container_id", "hub", "pid"], "left_anti")
    flows = rows.where("side = 'in'").unionByName(used).withColumn("channel_type", F.lit("file"))
    sent = queues.groupBy("container_id", F.col("channel").alias("hub"), "pid", F.when(F.col("role") == "sender", "in").otherwise("out").alias("side")).agg(seen(queues))
    return flows.unionByName(sent.withColumn("channel_type", F.lit("mqueue"))).select("container_id", "channel_type", "hub", "side", "pid", "seen_ms")


def pairs_of(hubs: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None, timed: bool = True, where: Column | None = None) -> DataFrame:
    """Edges over hubs between the processes asked for (container_id, pid), as rows like those of fork_edges, with first_seen and last_seen if timed.

    Without sources or targets all of them count. One edge for each (src, dst, type): its channel is the first of the hubs by name, its
    event_count their number. Over a hub, two processes have met when the later of them had come to it. Sources and targets may have more
    columns, of different names, which come along: a process then has edges for each of its rows, less those that fail ``where``.

    Pairs aren't grouped: each process with up to FEW_HUBS carries its other hubs along, so that a pair is made at the first hub that
    both have and knows the rest by itself; only accesses are shuffled. Pairs with a process of more hubs are made by every hub and grouped.
    """
    of, met = ["container_id", "channel_type"], F.greatest("src_ms", "dst_ms")
    ends = {name: carried(hubs.where(F.col("side") == side), name, who) for side, name, who in (("in", "src", sources), ("out", "dst", targets))}
    extra = [c for who in (sources, targets) if who is not None for c in who.columns if c not in ("container_id", "pid")]
    ok = F.col("src") != F.col("dst")
    ok = ok if where is None else ok & where

    def joined(few_src: bool, few_dst: bool) -> DataFrame:
        few = lambda name, is_few: ends[name].where(F.col(f"{name}_few") == is_few)
        return at_hubs(few("src", few_src), few("dst", few_dst)).where(ok)

    def shared(when: str) -> Column:
        return ((F.col(f"src_{when}_mask").bitwiseAND(F.col(f"dst_{when}_mask"))) != 0) & F.arrays_overlap(f"src_{when}", f"dst_{when}")

    first = joined(True, True).where(~shared("before"))
    common = F.array_intersect("src_after", "dst_after")
    columns = ["container_id", "src", "dst", "channel_type", "hub"]
    if timed:
        at = lambda name: F.map_from_arrays(f"{name}_after", f"{name}_after_ms")
        times = F.transform(common, lambda x: F.greatest(at("src")[x], at("dst")[x]))
        one = first.where(~shared("after")).select(*columns, F.lit(1).cast("long").alias("event_count"), met.alias("first_seen"), met.alias("last_seen"), *extra)
        more = first.where(shared("after")).select(*columns, met.alias("met"), common.alias("common"), times.alias("times"), *extra)
        more = more.select(*columns, (F.size("common") + 1).cast("long").alias("event_count"), F.least("met", F.array_min("times")).alias("first_seen"), F.greatest("met", F.array_max("times")).alias("last_seen"), *extra)
        rows = one.unionByName(more)
    else:
        rows = first.select(*columns, F.when(shared("after"), F.size(common) + 1).otherwise(1).cast("long").alias("event_count"), *extra)
    many = reduce(DataFrame.unionByName, [joined(*few) for few in ((False, True), (True, False), (False, False))])
    seen = [F.min(met).alias("first_seen"), F.max(met).alias("last_seen")] if timed else []
    rows = rows.unionByName(many.groupBy(*columns[:4], *extra).agg(F.min("hub").alias("hub"), F.count("*").alias("event_count"), *seen))
    channel = F.when(F.col("channel_type") == "file", F.concat(F.lit("file:"), "hub")).otherwise(F.col("hub"))
    return rows.select(*columns[:4], channel.alias("channel"), "event_count", *(["first_seen", "last_seen"] if timed else []), *extra)


def carried(links: DataFrame, name: str, who: DataFrame | None) -> DataFrame:
    """Accesses of one side as (container_id, channel_type, hub, name, name_ms, columns of who), with the hubs of the process that come before and after by name.

    name_few: whether it has up to FEW_HUBS; of others no hubs are carried. Masks have a bit for each hub carried: sets whose masks share none have nothing in common.
    """
    of = ["container_id", "channel_type"]
    rows = links.select(*of, "hub", "pid", "seen_ms")
    if who is not None:
        own = who.distinct()
        rows = rows.join(own.select("container_id", "pid").distinct(), ["container_id", "pid"], "left_semi")
    n = rows.groupBy(*of, "pid").agg(F.count("*").alias("n"))
    rows = rows.join(n, [*of, "pid"])
    lists = rows.where(F.col("n") <= FEW_HUBS).groupBy(*of, "pid").agg(F.array_sort(F.collect_list(F.struct("hub", "seen_ms"))).alias("own"))
    few = lists.select(*of, "pid", "own", F.posexplode("own").alias("nth", "at"))
    before, after = F.slice("own", 1, F.col("nth")), F.slice("own", F.col("nth") + 2, F.size("own"))
    mask = lambda hubs: F.aggregate(hubs, F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(h["hub"]), F.lit(64)).cast("int"))))
    few = few.select(
        *of, F.col("at.hub").alias("hub"), "pid", F.col("at.seen_ms").alias("ms"), F.lit(True).alias("few"), before["hub"].alias("before"), mask(before).alias("before_mask"),
        after["hub"].alias("after"), after["seen_ms"].alias("after_ms"), mask(after).alias("after_mask"),
    )
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    many = rows.where(F.col("n") > FEW_HUBS).select(
        *of, "hub", "pid", F.col("seen_ms").alias("ms"), F.lit(False).alias("few"), none.alias("before"), zero.alias("before_mask"), none.alias("after"), F.array().cast("array<bigint>").alias("after_ms"), zero.alias("after_mask"),
    )
    out = few.unionByName(many)
    out = out if who is None else out.join(own, ["container_id", "pid"])
    return stash(out.select(*of, "hub", F.col("pid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in few.columns if c not in (*of, "hub", "pid")], *([] if who is None else [c for c in own.columns if c not in ("container_id", "pid")])), f"{name}-carried")


def at_hubs(sources: DataFrame, targets: DataFrame, by: Sequence[str] = ("container_id", "channel_type", "hub")) -> DataFrame:
    """Sources and targets joined where ``by`` is equal. A hub's sources are cut into blocks of some PAIRED rows, each of which meets all its targets in one task."""
    blocks = sources.groupBy(*by).agg(F.ceil(F.count("*") / F.lit(PAIRED)).cast("int").alias("blocks"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = [*by, "block"]
    a = sources.join(blocks, list(by)).withColumn("block", F.pmod(F.xxhash64(*[c for c in sources.columns if c not in by]), F.col("blocks")).cast("int")).drop("blocks")
    b = targets.join(blocks, list(by)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return a.repartition(parts, *key).join(b.repartition(parts, *key), key).drop("block")


#: Decimal digits that a pid has at most where pids are ordered as texts.
PID_DIGITS = 16
#: Kinds of edges in order of their names; at most 16 of them, as a code has a sixteenth for each.
KINDS = sorted(schema.DECAY)


def edge_code(pid: Column, kind: Column) -> Column:
    """A number that orders (pid, kind) as their texts do: the pid's digits filled up with zeros, how many there are, and the kind's place."""
    pid = pid.cast("long")
    digits = F.length(pid.cast("string"))
    tens = F.array(*[F.lit(10**i).cast("long") for i in range(PID_DIGITS + 1)])
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i).cast("long"))])[kind]
    known = (pid >= 0) & (digits <= PID_DIGITS) & place.isNotNull()
    return F.when(known, (pid * F.get(tens, PID_DIGITS - digits) * 20 + digits) * 16 + place).otherwise(F.raise_error(F.lit("no order is known for such a pid or kind")).cast("long"))


def edge_of_code(code: Column) -> tuple[Column, Column]:
    """pid and kind of a number that edge_code made."""
    div = lambda a, b: F.call_function("div", a, b)
    order = div(code, F.lit(16))
    tens = F.array(*[F.lit(10**i).cast("long") for i in range(PID_DIGITS + 1)])
    pid = div(div(order, F.lit(20)), F.get(tens, (F.lit(PID_DIGITS) - order % 20).cast("int")))
    return pid, F.get(F.array(*[F.lit(k) for k in KINDS]), (code % 16).cast("int"))


def placed_edges(hubs: DataFrame, direct: DataFrame, sources: DataFrame, targets: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Where the edges of actions into each process stand among all of their action, in order of target, unit, source and kind as texts. No pair is sorted.

    hubs: container_id, unit, kind, hub, side, pid, of which sources (container_id, pid, action_id) give their actions edges to those targets
    (container_id, pid, theirs) that aren't of that action themselves; with ``whole``, a target's own actions have its edges from all
    processes. direct: edges of actions between two processes (container_id, unit, kind, action_id, src, dst).

    Returns (container_id, unit, action_id, dst, class, scope, selves, more, n, at): edges from ``at`` on are the codes of the class and scope without
    ``selves`` and with ``more``, n of them; and (container_id, unit, class, scope, codes): the sorted codes of all sources of processes
    with the same hubs, in an action or (scope -1) at all. A list is as long as one process's edges.
    """
    of = ["container_id", "unit"]
    ins = hubs.where("side = 'in'").select(*of, "hub", "pid", edge_code(F.col("pid"), F.col("kind")).alias("code"))
    outs = stash(hubs.where("side = 'out'").join(targets.select("container_id", "pid"), ["container_id", "pid"], "left_semi").select(*of, "hub", "pid"), "outs")
    sent = ins.join(sources, ["container_id", "pid"]).select(*of, "hub", F.col("action_id").alias("scope"), "code")
    if whole:
        sent = sent.union(ins.select(*of, "hub", F.lit(-1).cast("long").alias("scope"), "code"))
    at_hub = sent.groupBy(*of, "hub", "scope").agg(F.collect_list("code").alias("codes"))
    members, hubs_of = classes(outs.select("container_id", F.col("unit").alias("channel_type"), F.lit("out").alias("side"), "hub", "pid"))
    who = stash(members.select("container_id", F.col("channel_type").alias("unit"), "pid", "class").join(targets, ["container_id", "pid"]), "targets")
    # actions that all of a class are of need no list of their own
    n_class = who.groupBy(*of, "class").agg(F.count("*").alias("n_class"))
    within = who.select(*of, "class", F.explode("theirs").alias("scope")).groupBy(*of, "class", "scope").agg(F.count("*").alias("n")).join(n_class, [*of, "class"]).where("n = n_class")
    within = within.groupBy(*of, "class").agg(F.collect_list("scope").alias("within"))
    asked = hubs_of.select("container_id", F.col("channel_type").alias("unit"), "class", "hub").join(within, [*of, "class"], "left")
    met = asked.join(at_hub, [*of, "hub"]).where("within is null or not array_contains(within, scope)").groupBy(*of, "class", "scope").agg(F.collect_list("codes").alias("all"))
    lists = stash(met.select(*of, "class", "scope", F.sort_array(F.array_distinct(F.flatten("all"))).alias("codes")).withColumn("n", F.size("codes").cast("long")), "lists")
    selves = ins.join(outs, [*of, "hub", "pid"]).groupBy(*of, "pid").agg(F.collect_set("code").alias("selves"))
    rows = who.join(lists.select(*of, "class", "scope", "n"), [*of, "class"])
    columns = [*of, "action_id", F.col("pid").alias("dst"), "class", "scope", "n"]
    none = F.array().cast("array<bigint>")
    placed = rows.where("scope >= 0 and not array_contains(theirs, scope)").withColumn("action_id", F.col("scope")).select(*columns, none.alias("selves"))
    if whole:
        own = rows.where("scope < 0").join(selves, [*of, "pid"], "left").withColumn("selves", F.coalesce("selves", none))
        placed = placed.unionByName(own.withColumn("action_id", F.explode("theirs")).select(*columns, "selves"))
    more = direct.groupBy(*of, "action_id", "dst").agg(F.collect_list(edge_code(F.col("src"), F.col("kind"))).alias("more"))
    placed = placed.join(more, [*of, "action_id", "dst"], "full").withColumns({"selves": F.coalesce("selves", none), "more": F.coalesce("more", none)})
    placed = placed.withColumn("n", F.coalesce("n", F.lit(0).cast("long")) - F.size("selves") + F.size("more"))
    order = Window.partitionBy("container_id", "action_id").orderBy(F.col("dst").cast("string"), "unit").rowsBetween(Window.unboundedPreceding, 0)
    return stash(placed.withColumn("at", F.sum("n").over(order) - F.col("n")), "placed"), lists.drop("n")


def with_codes(placed: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of placed_edges with the sorted codes of each."""
    by = ["container_id", "unit", "class", "scope"]
    few = placed.where("class is null").withColumn("codes", F.col("more"))
    rows = at_hubs(placed.where("class is not null"), lists, by)
    rest = F.when(F.size("selves") > 0, F.array_except("codes", "selves")).otherwise(F.col("codes"))
    codes = F.when(F.size("more") > 0, F.sort_array(F.concat(rest, "more"))).otherwise(rest)
    return rows.withColumn("codes", codes).unionByName(few.withColumn("codes", F.sort_array("codes")))


def file_flow_edges(access: DataFrame) -> DataFrame:
    queues = access.limit(0).select("container_id", F.lit("").alias("channel"), "role", "pid", "action_id")
    return pairs_of(hub_links(access, queues).where("channel_type = 'file'"), timed=False).select(EDGE)


def ipc_flow_edges(access: DataFrame) -> DataFrame:
    files = access.limit(0).select("container_id", F.lit("").alias("path"), "role", "pid", "action_id")
    return pairs_of(hub_links(files, access).where("channel_type = 'mqueue'"), timed=False).select(EDGE)


def edges(forks: DataFrame, hubs: DataFrame, extra: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Edges as pairs, one per (src, dst, type), with the first and last time seen: all of them, or those among some processes (container_id, pid).

    extra: more edges between two processes (pipes, say), like those of fork_edges.
    """
    direct = forks if extra is None else forks.unionByName(extra)
    # other columns would come along on both ends
    among = among if among is None else among.select("container_id", "pid").distinct()
    for end in ("src", "dst"):
        direct = direct if among is None else direct.join(among.withColumnRenamed("pid", end), ["container_id", end], "left_semi")
    return direct.select(*EDGE, F.col("seen_ms").alias("first_seen"), F.col("seen_ms").alias("last_seen")).unionByName(pairs_of(hubs, among, among))


def edge_counts(forks: DataFrame, hubs: DataFrame) -> DataFrame:
    """container_id, n_edges: how many edges there are, one per (src, dst, type). Those over hubs are counted without making pairs."""
    both = pair_counts(hubs).select("container_id", "n").union(forks.select("container_id", F.lit(1).cast("long").alias("n")))
    return both.groupBy("container_id").agg(F.sum("n").alias("n_edges"))


def pair_counts(hubs: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None, most: int = SMALL_SET) -> DataFrame:
    """container_id, channel_type, groups of both sides, n: how many edges over hubs there are from the sources (container_id, pid, and columns of
    groups) to the targets (likewise; group columns of the two differ in name). A process in several groups counts in each of them.

    Two processes meet if a set of hubs is part of both of theirs, so pairs that meet are the alternating sum, over all sets, of how many
    sources have the set times how many targets do. Each process with up to ``most`` hubs lists the sets within its own, and work
    goes with the number of processes. Of those with more, classes with equal sets of hubs are joined by hub, and counted as often as
    their sizes' product.
    """
    of = ["container_id", "channel_type"]
    members, hubs_of = classes(hubs)
    size = F.col("n") <= most

    def end(side: str, who: DataFrame | None, name: str) -> tuple[list[str], DataFrame, DataFrame, DataFrame]:
        rows = members.where(F.col("side") == side)
        rows = rows if who is None else rows.join(who.distinct(), ["container_id", "pid"])
        groups = [] if who is None else [c for c in who.columns if c not in ("container_id", "pid")]
        sizes = stash(rows.groupBy(*of, "class", size.alias("small"), *groups).agg(F.count("*").alias(f"n_{name}")), "sizes")
        links = hubs_of.where(F.col("side") == side).join(sizes.select(*of, "class", "small").distinct(), [*of, "class"])
        own = links.where("small").groupBy(*of, "class").agg(F.array_sort(F.collect_list("hub")).alias("own"))
        empty = F.array(F.array().cast("array<string>"))
        sets = F.aggregate("own", empty, lambda got, x: F.concat(got, F.transform(got, lambda s: F.concat(s, F.array(x)))))
        sets = own.select(*of, "class", F.explode(sets).alias("hubs")).where("size(hubs) > 0").join(sizes, [*of, "class"])
        return groups, sizes, links, sets.groupBy(*of, "hubs", *groups).agg(F.sum(f"n_{name}").alias(f"n_{name}"))

    from_, n_a, links_a, sets_a = end("in", sources, "a")
    to, n_b, links_b, sets_b = end("out", targets, "b")
    product = F.col("n_a") * F.col("n_b")
    cols = [*of, *from_, *to]
    counted = sets_a.join(sets_b, [*of, "hubs"]).select(*cols, F.when(F.size("hubs") % 2 == 1, product).otherwise(-product).alias("n"))
    a, b = (df.select(*of, "hub", F.col("class").alias(f"class_{x}"), F.col("small").alias(f"few_{x}")) for df, x in ((links_a, "a"), (links_b, "b")))
    met = a.where("not few_a").join(b, [*of, "hub"]).select(*of, "class_a", "class_b")
    met = met.union(a.where("few_a").join(b.where("not few_b"), [*of, "hub"]).select(*of, "class_a", "class_b")).distinct()
    for sizes, x in ((n_a, "a"), (n_b, "b")):
        met = met.join(sizes.withColumnRenamed("class", f"class_{x}").drop("small"), [*of, f"class_{x}"])
    counted = counted.union(met.select(*cols, product.alias("n")))
    # a process on both sides of a hub makes no edge with itself
    selves = hubs.where("side = 'in'").select(*of, "hub", "pid").join(hubs.where("side = 'out'").select(*of, "hub", "pid"), [*of, "hub", "pid"]).select(*of, "pid").distinct()
    for who in (sources, targets):
        selves = selves if who is None else selves.join(who.distinct(), ["container_id", "pid"])
    return counted.union(selves.select(*cols, F.lit(-1).cast("long").alias("n"))).groupBy(*cols).agg(F.sum("n").alias("n")).where("n > 0")


def classes(hubs: DataFrame, key: Sequence[str] = CONTAINER) -> tuple[DataFrame, DataFrame]:
    """(key, channel_type, side, pid, class) and (key, channel_type, side, class, hub): processes with equal sets of hubs on a side are one class.

    Sets are told apart by their size and two sums of 64-bit hashes, so no set is gathered; a class is its smallest pid.
    """
    of = [*key, "channel_type", "side"]
    total = lambda seed: F.sum(F.xxhash64("hub", F.lit(seed)).cast("decimal(38,0)"))
    marks = hubs.groupBy(*of, "pid").agg(F.count("*").alias("n"), total(1).alias("m1"), total(2).alias("m2"))
    marks = stash(marks, "marks")
    leaders = marks.groupBy(*of, "n", "m1", "m2").agg(F.min("pid").alias("class"))
    members = stash(marks.join(leaders, [*of, "n", "m1", "m2"]).select(*of, "pid", "class", "n"), "members")
    leads = members.where("pid = class").select(*of, "pid", "class")
    return members, hubs.join(leads, [*of, "pid"]).select(*of, "class", "hub")


def strong_links(hubs: DataFrame, least_events: int = LEAST_EVENTS, key: Sequence[str] = CONTAINER) -> DataFrame:
    """key, src, dst: links that join the same processes as edges over least_events hubs or more do.

    Classes of processes stand for their members. Two classes can only share so many hubs if they share one beside the
    least_events - 1 most frequent of each: only those are joined, rare hubs first, and candidates are then counted. Members link
    to the first of their class, and to one of the class it meets.
    """
    of = [*key, "channel_type"]
    members, hubs_of = classes(hubs, key)
    large = members.where(F.col("n") >= least_events)
    hubs_of = hubs_of.join(large.where("pid = class").select(*of, "side", "class"), [*of, "side", "class"], "left_semi")
    often = hubs_of.groupBy(*of, "hub").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy(*of, "side", "class").orderBy(F.col("often").desc(), "hub"))
    listed = stash(hubs_of.join(often, [*of, "hub"]).withColumn("rank", rank), "hubs-of-classes")
    end = lambda df, side, name: df.where(F.col("side") == side).select(*of, "hub", F.col("class").alias(name))
    rare = listed.where(F.col("rank") >= least_events)
    tried = stash(end(rare, "in", "a").join(end(rare, "out", "b"), [*of, "hub"]).select(*of, "a", "b").distinct(), "tried")
    common = tried.join(end(listed, "in", "a"), [*of, "a"]).join(end(listed, "out", "b"), [*of, "b", "hub"])
    strong = stash(common.groupBy(*of, "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least_events).select(*of, "a", "b"), "strong")
    # all members of both classes are joined, as each of one has an edge with each other of the other
    lead = lambda side, name: large.where(F.col("side") == side).select(*of, F.col("class").alias(name), "pid")
    inner = lead("in", "a").join(strong.select(*of, "a", "b"), [*of, "a"]).select(*key, F.col("pid").alias("src"), F.col("b").alias("dst"))
    outer = lead("out", "b").join(strong.select(*of, "b").distinct(), [*of, "b"]).select(*key, F.col("pid").alias("src"), F.col("b").alias("dst"))
    return inner.union(outer).where("src <> dst").distinct()


def initial_scores(procs: DataFrame, roots: DataFrame) -> DataFrame:
    """score of each process at first sight: a container's first has none; one without a scored parent has 1; others have their parent's, decayed.

    roots: (container_id, pid, root_pid, depth, action_id). Processes share their root's action, so a score is that of the root,
    decayed as often as the process is below it; processes outside any action have none.
    """
    first = procs.groupBy("container_id").agg(F.min_by("pid", "first_seq").alias("first_pid"))
    rows = roots.select("container_id", "pid", "root_pid", "depth", "action_id").join(first, "container_id")
    unscored = F.col("root_pid") == F.col("first_pid")
    below = F.when(unscored, F.when(F.col("depth") > 0, F.pow(F.lit(schema.DECAY["fork"]), F.col("depth") - 1)).otherwise(F.lit(0.0))).otherwise(F.pow(F.lit(schema.DECAY["fork"]), "depth"))
    return rows.select("container_id", "pid", F.when(F.col("action_id") > 0, below).otherwise(F.lit(0.0)).alias("score"))


def decays(kind: Column) -> Column:
    return F.create_map(*[x for k, v in schema.DECAY.items() for x in (F.lit(k), F.lit(v))])[kind]


def propagate(scores: DataFrame, direct: DataFrame, hubs: DataFrame | None = None, rounds: int = 30) -> DataFrame:
    """container_id, pid, score, initial: the largest score that reaches each process, decayed along every edge on the way.

    direct: edges between two processes (container_id, src, dst, channel_type); hubs: those over files and queues, as of hub_links.
    A hub keeps the two largest scores that come in, of two processes: each process on its other side gets the first that isn't its
    own. Only scores of 0.1 or more spread, so with decays of 0.9 at most 22 rounds change anything. Each round spreads from the
    processes that the last one raised alone, through the hubs that they reach, and is stashed.
    """
    if max(schema.DECAY.values()) ** rounds >= schema.TAINTED:
        raise ValueError("scores would still spread after so many rounds")
    links = stash(direct.groupBy("container_id", F.col("src").alias("pid"), "dst").agg(F.max(decays(F.col("channel_type"))).alias("decay")), "links")
    made = [links]
    if hubs is not None:
        sides = [stash(hubs.where(F.col("side") == s).select("container_id", "channel_type", "hub", "pid"), f"hubs-{s}") for s in ("in", "out")]
        made += sides
    hub = ["container_id", "channel_type", "hub"]
    now = stash(scores.select("container_id", "pid", "score", F.col("score").alias("initial")), "scores")
    raised, last, top = now.select("container_id", "pid", "score"), [now], None
    for _ in range(rounds):
        sent = raised.where(F.col("score") >= schema.TAINTED)
        got = sent.join(links, ["container_id", "pid"]).select("container_id", F.col("dst").alias("pid"), (F.col("score") * F.col("decay")).alias("got"))
        gone = []
        if hubs is not None:
            came = stash(sent.join(sides[0], ["container_id", "pid"]).select(*hub, "pid", "score"), "came")
            both = came if top is None else came.unionByName(top.select(*hub, "pid", "score"))
            best = both.groupBy(*hub, "pid").agg(F.max("score").alias("score"))
            nth = F.row_number().over(Window.partitionBy(*hub).orderBy(F.col("score").desc(), "pid"))
            new_top = stash(best.withColumn("nth", nth).where("nth <= 2"), "top")
            touched = new_top.join(came.select(*hub).distinct(), hub, "left_semi").select(*hub, F.col("pid").alias("by"), "score")
            over = touched.join(sides[1], hub).where("pid <> by").select("container_id", "pid", (F.col("score") * decays(F.col("channel_type"))).alias("got"))
            got = got.unionByName(over)
            gone = [came] + ([top] if top is not None else [])
            top = new_top
        got = got.groupBy("container_id", "pid").agg(F.max("got").alias("got"))
        new = now.join(got, ["container_id", "pid"], "left").withColumn("up", F.coalesce(F.col("got") > F.col("score") + 1e-9, F.lit(False)))
        new = stash(new.select("container_id", "pid", F.when(F.col("up"), F.col("got")).otherwise(F.col("score")).alias("score"), "initial", "up"), "scores")
        raised = new.where("up").select("container_id", "pid", "score")
        now = new.drop("up")
        for old in [*last, *gone]:
            discard(old)
        last = [new]
        if raised.isEmpty():
            break
    for old in [*made, *([top] if top is not None else [])]:
        discard(old)
    return now


def best_pairs(came: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, by's process ("by"), score: the largest score that came, and the largest of another process; kept by aggregation, so nothing is sorted."""
    # stashed, as of scores that tie any may be first, but the same one in both places
    first = stash(came.groupBy(*by).agg(F.max_by("by", "score").alias("one"), F.max("score").alias("most")), "firsts")
    rest = came.join(first, list(by)).where("by <> one").groupBy(*by).agg(F.max_by("by", "score").alias("by"), F.max("score").alias("score"))
    return first.select(*by, F.col("one").alias("by"), F.col("most").alias("score")).unionByName(rest)


def reached_by(scores: DataFrame, at: DataFrame, direct: DataFrame, hubs: DataFrame, rounds: int = 30, rows_per_part: int = 500_000) -> DataFrame:
    """container_id, pid, action_id, score: every action whose taint reaches a process with a score that counts, and the largest that does.

    An action's taint starts from the scores (container_id, pid, score) of its own processes (at: container_id, pid, action_id) and is
    decayed along every edge on the way. Actions spread side by side, each with a best pair of its own in a hub, so a process may
    be reached by many. A round takes up what the last one has raised, and is stashed; only rows that count are kept. Tasks grow in number,
    not in size: some rows_per_part rows of the result each.
    """
    if max(schema.DECAY.values()) ** rounds >= schema.TAINTED:
        raise ValueError("scores would still spread after so many rounds")
    key, hub = ["container_id", "action_id"], ["container_id", "channel_type", "hub"]
    links = stash(direct.groupBy("container_id", F.col("src").alias("pid"), "dst").agg(F.max(decays(F.col("channel_type"))).alias("decay")), "links")
    sides = [stash(hubs.where(F.col("side") == s).select(*hub, "pid"), f"hubs-{s}") for s in ("in", "out")]
    start = scores.join(at.where("action_id > 0").select(*key, "pid"), ["container_id", "pid"]).where(F.col("score") >= schema.TAINTED)
    now = stash(start.select(*key, "pid", "score", F.lit(True).alias("up")), "reached")
    # at most a row for each process and each action in which its container has any
    most = scores.count() * start.select("action_id").distinct().count()
    parts = max(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // rows_per_part))
    top = None
    for _ in range(rounds):
        raised = now.where("up").drop("up")
        got = raised.join(links, ["container_id", "pid"]).select(*key, F.col("dst").alias("pid"), (F.col("score") * F.col("decay")).alias("score"))
        # a hub's best pair changes by what the raised ones bring alone
        came = raised.join(sides[0], ["container_id", "pid"]).select("action_id", *hub, F.col("pid").alias("by"), "score")
        new_top = stash(best_pairs(came if top is None else came.unionByName(top), ["action_id", *hub]), "top")
        fresh = new_top if top is None else new_top.join(top.select("action_id", *hub, "by", F.col("score").alias("was")), ["action_id", *hub, "by"], "left").where("was is null or score > was").select(new_top.columns)
        got = got.unionByName(fresh.join(sides[1], hub).where("pid <> by").select(*key, "pid", (F.col("score") * decays(F.col("channel_type"))).alias("score")))
        got = got.where(F.col("score") >= schema.TAINTED).withColumn("old", F.lit(None).cast("double"))
        rows = now.select(*key, "pid", "score", F.col("score").alias("old")).unionByName(got.groupBy(*key, "pid").agg(F.max("score").alias("score"), F.max("old").alias("old")))
        rows = rows.repartition(parts, *key, "pid").groupBy(*key, "pid").agg(F.max("score").alias("score"), F.max("old").alias("old"))
        up = F.coalesce(F.col("score") > F.col("old") + 1e-9, F.lit(True))
        new = stash(rows.select(*key, "pid", F.when(up, F.col("score")).otherwise(F.col("old")).alias("score"), up.alias("up")), "reached")
        for old in [now, *([top] if top is not None else [])]:
            discard(old)
        now, top = new, new_top
        if now.where("up").isEmpty():
            break
    for old in (links, *sides, *([top] if top is not None else [])):
        discard(old)
    return now.select("container_id", "pid", "action_id", "score")


def epochs_of(rows: DataFrame, actions: DataFrame, ts: str) -> DataFrame:
    """rows with epoch: the number of the container's first action that hasn't ended by ts, or of those there are and one more."""
    # a row for each container; listing time slots instead would begin at the first second of time
    ends = actions.where("end_ms is not null").groupBy("container_id").agg(F.collect_list("end_ms").alias("ends"))
    gone = F.coalesce(F.size(F.filter("ends", lambda end: end < F.col(ts))), F.lit(0))
    return rows.join(F.broadcast(ends), "container_id", "left").select(*rows.columns, (F.when(F.col("ends").isNull(), 0).otherwise(gone) + 1).cast("long").alias("epoch"))


def births(procs: DataFrame, forks: DataFrame) -> DataFrame:
    """container_id, pid, outer, grown, fresh of processes (container_id, pid, epoch, active): what its ancestors within the epoch make of a score at birth.

    outer: the first ancestor of an earlier epoch, or null. A score x of it gives x * grown, if it isn't 0, else fresh. A child of a process
    without a score has 1 within an action, else none; others have their parent's, decayed: such rules make one such rule together,
    so ancestors are passed in a logarithmic number of rounds.
    """
    own = procs.select("container_id", "pid", "epoch", "active")
    parent = own.select("container_id", F.col("pid").alias("src"), F.col("epoch").alias("before"))
    up = forks.select("container_id", "src", F.col("dst").alias("pid")).join(parent, ["container_id", "src"])
    rows = own.join(up, ["container_id", "pid"], "left").withColumn("inner", F.when(F.col("before") == F.col("epoch"), F.col("src")))
    fresh = F.when(F.col("active"), F.lit(1.0)).otherwise(F.lit(0.0))
    now = stash(rows.select("container_id", "pid", "inner", F.when(F.col("inner").isNull(), F.col("src")).alias("outer"), F.lit(schema.DECAY["fork"]).alias("grown"), fresh.alias("fresh")), "births")
    while not now.where("inner is not null").isEmpty():
        above = now.select("container_id", F.col("pid").alias("inner"), F.col("inner").alias("next"), F.col("outer").alias("beyond"), F.col("grown").alias("more"), F.col("fresh").alias("theirs"))
        rows = now.join(above, ["container_id", "inner"], "left")
        passed = F.col("inner").isNotNull()
        new = stash(rows.select(
            "container_id", "pid", F.when(passed, F.col("next")).alias("inner"), F.when(passed, F.col("beyond")).otherwise(F.col("outer")).alias("outer"), F.when(passed, F.col("grown") * F.col("more")).otherwise(F.col("grown")).alias("grown"),
            F.when(passed & (F.col("theirs") > 0), F.col("grown") * F.col("theirs")).otherwise(F.col("fresh")).alias("fresh"),
        ), "births")
        discard(now)
        now = new
    return now.drop("inner")


#: Processes up to which those that a round has raised are broadcast to the accesses.
RAISED_ROWS = 200_000


def taint_by_epoch(procs: DataFrame, forks: DataFrame, files: DataFrame, queues: DataFrame, actions: DataFrame, gap_ms: int = 2000, rounds: int = 30) -> DataFrame:
    """container_id, epoch, pid, score: what each action changes, when scores spread at its end over what has been seen by then.

    Unlike the fixpoint over all time, a process that is born after its parent was raised starts from the raised score, and nothing
    flows back in time: a file counts from the epoch of its access on. Rows are those of processes that the epoch brings or raises.
    Epochs follow each other, as each begins with the scores and the hubs' best pairs of the one before. An epoch takes up what it brings:
    its processes, and its accesses of processes and hubs that have a score already; from there on work is as in propagate.
    """
    if max(schema.DECAY.values()) ** rounds >= schema.TAINTED:
        raise ValueError("scores would still spread after so many rounds")
    timed = epochs_of(procs.select("container_id", "pid", F.col("first_ts").alias("ts_ms"), "first_seq"), actions, "ts_ms")
    active = action_at_time(timed, actions, gap_ms).withColumn("active", F.col("action_id") > 0)
    first = procs.groupBy("container_id").agg(F.min_by("pid", "first_seq").alias("first_pid"))
    known = stash(active.join(first, "container_id").withColumn("active", F.col("active") & (F.col("pid") != F.col("first_pid"))), "known")
    born = stash(births(known, forks).join(known.select("container_id", "pid", "epoch"), ["container_id", "pid"]), "born")
    lines = forks.join(born.select("container_id", F.col("pid").alias("dst"), "epoch"), ["container_id", "dst"])
    lines = stash(lines.groupBy("container_id", F.col("src").alias("pid"), "dst", "epoch").agg(F.max(decays(F.col("channel_type"))).alias("decay")), "epoch-forks")
    hub, who = ["container_id", "channel_type", "hub"], ["container_id", "pid"]
    side = lambda giver: F.when(F.col("role") == giver, "in").otherwise("out").alias("side")
    used = files.where(~X.is_flow_noise(F.col("path")) & F.col("role").isin("writer", "reader", "executor"))
    seen = epochs_of(used, actions, "first_ms").select("container_id", F.lit("file").alias("channel_type"), F.col("path").alias("hub"), side("writer"), "pid", "epoch")
    seen = seen.unionByName(epochs_of(queues, actions, "first_ms").select("container_id", F.lit("mqueue").alias("channel_type"), F.col("channel").alias("hub"), side("sender"), "pid", "epoch"))
    seen = stash(seen.groupBy(*hub, "side", "pid").agg(F.min("epoch").alias("epoch")), "epoch-accesses")
    ins = seen.where("side = 'in'").drop("side")
    # a file gives nothing any more to a process that has written it
    wrote = ins.where("channel_type = 'file'").select(*hub, "pid", F.col("epoch").alias("until"))
    outs = stash(seen.where("side = 'out'").drop("side").join(wrote, [*hub, "pid"], "left").where("until is null or epoch < until"), "epoch-outs")
    tainted, none = F.col("score") >= schema.TAINTED, F.lit(None).cast("double")
    now, top, changes = None, None, []
    # a number of actions, which follow each other by nature
    for epoch in range(1, (born.select("epoch").union(seen.select("epoch")).agg(F.max("epoch")).first()[0] or 0) + 1):
        new = born.where(F.col("epoch") == epoch)
        if now is None:
            start = new.select(*who, F.col("fresh").alias("score"), none.alias("before"))
        else:
            x = now.select("container_id", F.col("pid").alias("outer"), F.col("score").alias("x"))
            start = new.join(x, ["container_id", "outer"], "left").select(*who, F.when(F.coalesce("x", F.lit(0.0)) > 0, F.col("x") * F.col("grown")).otherwise(F.col("fresh")).alias("score"), none.alias("before"))
            start = start.unionByName(now.select(*who, "score", F.col("score").alias("before")))
        old, now = now, stash(start.withColumn("up", F.col("before").isNull()), "scores")
        if old is not None:
            discard(old)
        open_ = outs.where((F.col("epoch") <= epoch) & (F.col("until").isNull() | (F.col("until") > epoch)))
        for nth in range(rounds):
            raised = now.where(F.col("up") & tainted).select(*who, "score")
            n = raised.count()
            if nth and not n:
                break
            raised = F.broadcast(raised) if n <= RAISED_ROWS else raised
            came = raised.join(ins.where(F.col("epoch") <= epoch), who).select(*hub, "pid", "score", none.alias("was"))
            if not nth:
                held = now.where(~F.col("up") & tainted).select(*who, "score")
                came = came.unionByName(held.join(ins.where(F.col("epoch") == epoch), who).select(*hub, "pid", "score", none.alias("was")))
            both = came if top is None else came.unionByName(top.select(*hub, "pid", "score", F.col("score").alias("was")))
            best = both.groupBy(*hub, "pid").agg(F.max("score").alias("score"), F.max("was").alias("was"))
            order = Window.partitionBy(*hub).orderBy(F.col("score").desc(), F.col("was").desc_nulls_last(), "pid")
            new_top = stash(best.withColumn("nth", F.row_number().over(order)).where("nth <= 2").select(*hub, "pid", "score", F.coalesce(F.col("score") > F.col("was"), F.lit(True)).alias("fresh")), "top")
            # what hubs have anew goes to all on their other side, what they have at all to those that come to them now
            given = new_top.select(*hub, F.col("pid").alias("by"), "score", "fresh").join(open_.select(*hub, "pid", (F.col("epoch") == epoch).alias("comes")), hub)
            given = given.where((F.col("fresh") | F.col("comes") if not nth else F.col("fresh")) & (F.col("pid") != F.col("by")))
            got = given.select(*who, (F.col("score") * decays(F.col("channel_type"))).alias("got"))
            down = raised.join(lines.where(F.col("epoch") <= epoch), who).select("container_id", F.col("dst").alias("pid"), (F.col("score") * F.col("decay")).alias("got"))
            got = got.unionByName(down).groupBy(*who).agg(F.max("got").alias("got"))
            up = F.coalesce(F.col("got") > F.col("score") + 1e-9, F.lit(False))
            new = stash(now.drop("up").join(got, who, "left").select(*who, F.when(up, F.col("got")).otherwise(F.col("score")).alias("score"), "before", up.alias("up")), "scores")
            for old in (now, *([top] if top is not None else [])):
                discard(old)
            now, top = new, new_top
        changed = now.where(F.col("before").isNull() | (F.col("score") > F.col("before")))
        changes.append(stash(changed.select("container_id", F.lit(epoch).cast("long").alias("epoch"), "pid", "score"), "changed"))
    for old in (known, born, lines, seen, outs, *[df for df in (now, top) if df is not None]):
        discard(old)
    if not changes:
        return procs.limit(0).select("container_id", F.lit(0).cast("long").alias("epoch"), "pid", F.lit(0.0).alias("score"))
    return procs.sparkSession.read.schema(changes[0].schema).parquet(*[df._stash_path for df in changes])


def components(nodes: DataFrame, links: DataFrame, key: Sequence[str] = CONTAINER) -> DataFrame:
    """key, pid, community: the smallest pid that can be reached over links (key, src, dst). Labels spread and jump."""
    both = links.select(*key, "src", "dst").union(links.select(*key, "dst", "src")).distinct()
    both = stash(both.select(*key, F.col("src").alias("via"), F.col("dst").alias("pid")), "both")
    now = stash(nodes.select(*key, "pid", F.col("pid").alias("community")), "labels")
    last = now
    while True:
        near = both.join(now.select(*key, F.col("pid").alias("via"), "community"), [*key, "via"]).groupBy(*key, "pid").agg(F.min("community").alias("near"))
        spread = now.join(near, [*key, "pid"], "left").withColumn("low", F.least("community", "near"))
        up = now.select(*key, F.col("pid").alias("low"), F.col("community").alias("lower"))
        new = stash(spread.join(up, [*key, "low"]).select(*key, "pid", F.col("community").alias("old"), F.least("low", "lower").alias("community")), "labels")
        now = new.drop("old")
        discard(last)
        last = new
        if new.where("old <> community").isEmpty():
            discard(both)
            return now


def community_members(procs: DataFrame, forks: DataFrame, hubs: DataFrame, least_events: int = LEAST_EVENTS, key: Sequence[str] = CONTAINER) -> DataFrame:
    """key, pid, community: forks of the same command first, then groups that edges over enough hubs join; a community is its smallest pid."""
    names = procs.select(*key, "pid", "comm")
    a, b = names.select(*key, F.col("pid").alias("src"), F.col("comm").alias("ca")), names.select(*key, F.col("pid").alias("dst"), F.col("comm").alias("cb"))
    alike = forks.join(a, [*key, "src"]).join(b, [*key, "dst"]).where("ca = cb").select(*key, "src", "dst")
    known = hubs.join(names.select(*key, "pid"), [*key, "pid"], "left_semi")
    return components(procs, alike.unionByName(strong_links(known, least_events, key)), key)


def label_of(first: Column, second: Column, n: Column) -> Column:
    """a, a+b, or a+n others, out of the first and last of n names."""
    return F.when(n == 0, F.lit("")).when(n == 1, first).when(n == 2, F.concat(first, F.lit("+"), second)).otherwise(F.concat(first, F.lit("+"), n - 1, F.lit(" others")))


def communities(procs: DataFrame, members: DataFrame, scores: DataFrame, key: Sequence[str] = CONTAINER) -> DataFrame:
    """key, community, size, representative_pid (of the longest command line), avg_score, label. members: as of community_members."""
    rows = members.join(procs.select(*key, "pid", "cmdline", "comm"), [*key, "pid"]).join(scores.select(*key, "pid", "score"), [*key, "pid"])
    length = F.length(F.coalesce("cmdline", F.lit("")))
    by_name = rows.groupBy(*key, "community", "comm").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max(F.struct(length.alias("length"), (-F.col("pid")).alias("minus"))).alias("longest"))
    label = label_of(F.min("comm"), F.max("comm"), F.count("comm"))
    return by_name.groupBy(*key, "community").agg(F.sum("n").alias("size"), (-F.max("longest")["minus"]).alias("representative_pid"), (F.sum("total") / F.sum("n")).alias("avg_score"), label.alias("label"))


def community_texts(procs: DataFrame, members: DataFrame) -> DataFrame:
    """container_id, community, label, members: a community's commands and pids, each as one text, which gathers a community into a row."""
    rows = members.join(procs.select("container_id", "pid", "comm"), ["container_id", "pid"])
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return rows.groupBy("container_id", "community").agg(text(F.collect_set("comm")).alias("label"), text(F.collect_list("pid")).alias("members"))


def action_communities(procs: DataFrame, forks: DataFrame, hubs: DataFrame, scores: DataFrame, pids: DataFrame, least_events: int = LEAST_EVENTS) -> DataFrame:
    """container_id, action_id, community_id, community, size, label, representative_pid, avg_score: communities among an action's processes alone, numbered from the largest.

    community is the smallest pid of it.
    """
    key = ("container_id", "action_id")
    own = pids.select(*key, "pid")
    inside = stash(procs.select("container_id", "pid", "comm", "cmdline").join(own, ["container_id", "pid"]), "inside")
    end = lambda name: own.select(*key, F.col("pid").alias(name))
    links = forks.select("container_id", "src", "dst").join(end("src"), ["container_id", "src"]).join(end("dst"), [*key, "dst"])
    members = stash(community_members(inside, links, hubs.join(own, ["container_id", "pid"]), least_events, key), "action-communities")
    rows = communities(inside, members, scores.select("container_id", "pid", "score").join(own, ["container_id", "pid"]), key)
    order = Window.partitionBy(*key).orderBy(F.col("size").desc(), "community")
    return rows.withColumn("community_id", F.row_number().over(order) - 1)

"""Exact Jaccard self-join on word shingles by T-occurrence search, down to connected components.

Documents with equal shingle sets form a class; from there on a class stands for its documents. A class
of n shingles needs T = ceil(t n) in common with any partner, so it is a query that asks for the classes
that occur T times in the inverted lists of its shingles, as DivideSkip answers it: the T - 1 longest lists
are set aside, the short ones are merged, and a class that is found there often enough is looked for in
the long ones by bisection. What differs from the algorithm on one machine is where its steps run:

1. *Queries without an answer.* Under the order of hash values, two sets with Jaccard t or more share at
   least l of their first n - ceil(t n) + l shingles. Those are indexed first; a class that shares fewer of
   them with any other has no partner and asks nothing. This is what most documents do.
2. *Lists.* All shingles of the classes that remain are indexed. A class with fewer than T shared ones
   leaves; its T - 1 longest lists are set aside. Lists that many documents share (licences, quoted
   passages) never make pairs so.
3. *Merging and probing.* A list is spread over tasks, so the short lists of all queries are merged by a
   join on shingle and a count for each pair, not by one heap. Before that, each class is compared with the
   class that leads most of its lists, likely the original that others copy; linked ones share a component,
   and pairs within one are not counted any more, so a group of alike documents costs one comparison each.
   Candidates then meet in one group for each query (of at most about GROUP_ROWS), where DivideSkip runs as
   published: a heap merges the short lists of the query, long ones are probed, on whole sets.

Indexes travel as arrays (a row holds the postings of a batch for one bucket of shingles); buckets and
groups are bounded by the number of buckets, which follows spark.sql.shuffle.partitions. Lists hold 31 bits
of a shingle's hash beside its bucket, so that two shingles may share a list: this makes more candidates,
never fewer (see ``apart``). Comparisons use whole sets of 64-bit hashes.

Null text and texts without words have no shingles and link with nothing; equal rows are in one
component; null ids take part, and a component's id is its smallest non-null one; ties (lists of one
length, leaders of as many lists) go by hash; other columns are ignored, whatever their names; an empty
table gives no rows. A very long text is hashed in one task, in memory of about 50 times its size.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import sized, stash
from tracewright.llm.shingles import U2, U4, U8, Sets, batches_of, shingle_sets, tidied

#: Classes beyond which a list of them is no longer broadcast but joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Comparisons with one class that go to one group.
GROUP_ROWS = 1000
#: Copies from which on a class meets its documents by a broadcast.
HOT = 500

BLOBS = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of a set of n with any partner: ceil(percent n / 100)."""
    return -(-n * percent // 100)


def spare(n: np.ndarray) -> np.ndarray:
    """Shingles that a prefix has beyond the shortest that is exact, plus one."""
    return n // 16 + 1


def row(bucket: int, kind: int, *arrays: np.ndarray) -> tuple:
    return (bucket, kind, *[x.tobytes() for x in arrays], *[b""] * (5 - len(arrays)))


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["bucket", "kind", "a", "b", "c", "d", "e"]
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)


def index(docs: DataFrame, width: int, buckets: int, prefix: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """Postings of docs (doc_id, text) by bucket of shingle, of each set's first prefix(n) or all; and (kind 0) its documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for b in batches_of(batches):
            sets = shingle_sets(b.column(1), width)
            sig = sets.signatures()
            ids = b.column(0)
            known = np.asarray(ids.is_valid()).astype(np.int8)
            turn += 1
            rows = [row(turn % buckets, 0, np.asarray(ids.fill_null(0)).astype(np.int64), known, sets.n.astype(np.int64), sig)]
            # equal sets in a batch post once
            _, one = np.unique(sig, return_index=True)
            chosen = np.zeros(len(sig), bool)
            chosen[one] = True
            keep = chosen[sets.doc]
            if prefix:
                keep &= sets.rank < prefix(sets.n)[sets.doc]
            rows += tiles(sets, sig, keep, buckets)
            yield to_batch(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, BLOBS)


def apart(short: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Shortened shingles of sets (place tells which) with those that fall together in a set moved up to free numbers.

    What a set then takes up only depends on what is in it, and a part of it never takes up anything else: two sets
    have as many numbers in common as they have shingles in common, at least.
    """
    order = np.lexsort((short, place))
    key = (place[order].astype(np.int64) << 33) + short[order].astype(np.int64)
    step = np.arange(len(key))
    out = np.empty(len(short), np.int64)
    out[order] = (np.maximum.accumulate(key - step) + step) & ((1 << 33) - 1)
    return out.astype(U4)


def tiles(sets: Sets, sig: np.ndarray, keep: np.ndarray, buckets: int) -> list[tuple]:
    """One row per bucket: 31 bits of each posting's shingle, apart within a document, its document's place, and the signatures and sizes by place."""
    tokens, doc = sets.tokens[keep], sets.doc[keep]
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    short, doc = ((tokens >> np.uint64(20)) & np.uint64(0x7FFFFFFF)).astype(U4)[order], doc[order]
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    out, begin = [], 0
    for k, end in enumerate(ends.tolist()):
        if end > begin:
            places, place = np.unique(doc[begin:end], return_inverse=True)
            out.append(row(k, 1, apart(short[begin:end], place), place.astype(U4 if len(places) > 65_535 else U2), sig[places], sets.n[places].astype(U4)))
        begin = end
    return out


def lists(blobs: DataFrame, buckets: int) -> DataFrame:
    """Postings of shingles that two classes or more have, by bucket of class; documents pass through."""

    def work(df: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(r) for r in df[df["kind"] == 0].itertuples(index=False)]
        some = df[df["kind"] == 1]
        if len(some):
            here = int(some["bucket"].iloc[0])
            token, sig, n = [], [], []
            for a, b, c, d in zip(some["a"], some["b"], some["c"], some["d"]):
                t, s, m = np.frombuffer(a, U4), np.frombuffer(c, np.int64), np.frombuffer(d, U4)
                place = np.frombuffer(b, U4 if len(s) > 65_535 else U2)
                token.append(t)
                sig.append(s[place])
                n.append(m[place])
            token, sig, n = np.concatenate(token), np.concatenate(sig), np.concatenate(n)
            order = np.lexsort((sig, token))
            token, sig, n = token[order], sig[order], n[order]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
            token, sig, n = token[fresh], sig[fresh], n[fresh]
            _, which, length = np.unique(token, return_inverse=True, return_counts=True)
            length = length[which]
            shared = length > 1
            token, sig, n, length = token[shared], sig[shared], n[shared], length[shared]
            to = (sig.view(U8) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((sig, to))
            token, sig, n, length, to = token[order], sig[order], n[order], length[order], to[order]
            begin = 0
            for k, end in enumerate(np.cumsum(np.bincount(to, minlength=buckets)).tolist()):
                if end > begin:
                    own, first, count = np.unique(sig[begin:end], return_index=True, return_counts=True)
                    back = np.argsort(first)
                    rows.append((k, 2 + here, token[begin:end].tobytes(), length[begin:end].astype(U4).tobytes(), own[back].tobytes(), n[begin:end][first[back]].astype(U4).tobytes(), count[back].astype(U4).tobytes()))
                begin = end
        return pd.DataFrame(rows, columns=["bucket", "kind", "a", "b", "c", "d", "e"])

    return blobs.groupBy("bucket").applyInPandas(tidied(work), BLOBS)


def documents_of(blobs: DataFrame) -> DataFrame:
    """doc_id, n, sig of the documents that an index has seen."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, known, n, sig in zip(*(b.column(c).to_pylist() for c in "abcd")):
                ids = pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(known, np.int8) == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(n, np.int64)), pa.array(np.frombuffer(sig, np.int64))], ["doc_id", "n", "sig"])

    return blobs.where("kind = 0").select("a", "b", "c", "d").mapInArrow(work, "doc_id long, n long, sig long")


def survivors(blobs: DataFrame, needed: Callable[[np.ndarray], np.ndarray], keep_lists: bool) -> DataFrame:
    """Classes (sig, n) with needed(n) shared shingles or more; or (token, sig, n, weight): what is left of their lists without the needed(n) - 1 longest.

    ``weight`` tells how much of a class others share, and how many: the original of many copies has the most.
    """

    def work(df: pd.DataFrame) -> pd.DataFrame:
        token, length, sig, n = [], [], [], []
        for kind, a, b, c, d, e in zip(df["kind"], df["a"], df["b"], df["c"], df["d"], df["e"]):
            count = np.frombuffer(e, U4)
            token.append(np.frombuffer(a, U4).astype(np.int64) + ((kind - 2) << 32))
            length.append(np.frombuffer(b, U4))
            sig.append(np.repeat(np.frombuffer(c, np.int64), count))
            n.append(np.repeat(np.frombuffer(d, U4), count))
        token, length, sig, n = (np.concatenate(x) for x in (token, length, sig, n))
        own, which, count = np.unique(sig, return_inverse=True, return_counts=True)
        size = np.zeros(len(own), np.int64)
        size[which] = n
        least = needed(size)
        passed = count >= least
        if not keep_lists:
            return pd.DataFrame({"token": 0, "sig": own[passed], "n": size[passed], "weight": 0.0})
        weight = np.bincount(which, np.log2(length), len(own)) / size
        order = np.lexsort((token, -length.astype(np.int64), sig))
        token, which = token[order], which[order]
        rank = np.arange(len(which)) - (np.cumsum(count) - count)[which]
        kept = passed[which] & (rank >= least[which] - 1)
        return pd.DataFrame({"token": token[kept], "sig": own[which[kept]], "n": size[which[kept]], "weight": weight[which[kept]]})

    return blobs.where("kind >= 2").groupBy("bucket").applyInPandas(tidied(work), "token long, sig long, n long, weight double")


def restricted(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """The rows of docs whose id is in ids (doc_id): by broadcast if those are few, else by a shuffle."""
    ids = ids.select(F.col("doc_id").alias("wanted"))
    return docs.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")


def overlaps(query: np.ndarray, others: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Which of the others (sorted arrays) share least[i] elements or more with query, by DivideSkip.

    The others' elements are inverted into lists by element of the query. The longest lists are set aside;
    the short ones are merged by a heap to count each candidate, and a candidate that can still reach its overlap is
    searched for in the long ones by bisection.
    """
    elements = np.concatenate(others) if others else query[:0]
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    at = np.searchsorted(query, elements)
    at[at == len(query)] = 0
    hit = query[at] == elements if len(query) else np.zeros(len(elements), bool)
    order = np.argsort(at[hit], kind="stable")
    at, owner = at[hit][order], owner[hit][order]
    length = np.bincount(at, minlength=len(query))
    # as many long lists as DivideSkip's rule of thumb gives, and fewer than the least overlap asked for
    fewest, longest = int(least.min()) if len(least) else 0, int(length.max()) if len(length) else 0
    aside = min(max(fewest - 1, 0), int(fewest / (0.0085 * np.log2(max(longest, 2)) + 1)))
    is_long = np.zeros(len(query), bool)
    if aside and longest > 1:
        is_long[np.argsort(-length, kind="stable")[:aside]] = True
    ends = np.cumsum(length)
    short = [owner[e - n : e].tolist() for e, n in zip(ends[~is_long].tolist(), length[~is_long].tolist()) if n]
    count = np.zeros(len(others), np.int64)
    # the heap gives owners in order, each as often as it occurs
    for i, group in itertools.groupby(heapq.merge(*short)):
        count[i] = sum(1 for _ in group)
    hopeful = (count > 0) & (count + int(is_long.sum()) >= least)
    probe = query[is_long]
    for i in np.flatnonzero(hopeful).tolist():
        place = np.searchsorted(others[i], probe)
        place[place == len(others[i])] = 0
        count[i] += int((others[i][place] == probe).sum())
    return hopeful & (count >= least)


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets (sig, tokens) have the similarity: those with one x together, at most about GROUP_ROWS a group."""
    groups = pairs.groupBy("x").agg(F.ceil(F.count("*") / F.lit(GROUP_ROWS)).cast("int").alias("parts"))
    theirs = pairs.join(groups, "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int")).select("x", "part", "y")
    theirs = theirs.join(sets, theirs["y"] == sets["sig"]).select("x", "part", "y", "tokens")
    own = groups.join(sets, groups["x"] == sets["sig"]).select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("x").alias("y"), "tokens")

    def work(df: pd.DataFrame) -> pd.DataFrame:
        x = df["x"].iloc[0]
        mine = (df["y"] == x).to_numpy()
        query = np.frombuffer(df["tokens"][mine].iloc[0], U8)
        rest = df[~mine]
        others = [np.frombuffer(t, U8) for t in rest["tokens"]]
        sizes = np.array([len(o) for o in others], np.int64)
        # overlap / (a + b - overlap) >= percent / 100
        least = -(-percent * (sizes + len(query)) // (100 + percent))
        ok = overlaps(query, others, least)
        return pd.DataFrame({"x": x, "y": rest["y"][ok]})

    return own.unionByName(theirs).groupBy("x", "part").applyInPandas(work, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """sig, comp of every class in links (x, y): comp is the smallest sig that can be reached. Labels spread and jump, a stash a round."""
    both = stash(links.select("x", "y").union(links.select("y", "x")).distinct(), "links")
    labels = stash(both.groupBy(F.col("x").alias("sig")).agg(F.min(F.least("x", "y")).alias("comp")), "labels")
    while True:
        seen = both.join(labels, both["y"] == labels["sig"]).groupBy(F.col("x").alias("to")).agg(F.min("comp").alias("near"))
        spread = labels.join(seen, labels["sig"] == seen["to"]).select("sig", "comp", F.least("comp", "near").alias("next"))
        roots = labels.select(F.col("sig").alias("root"), F.col("comp").alias("root_comp"))
        moved = stash(spread.join(roots, spread["next"] == roots["root"]).select("sig", "comp", F.least("next", "root_comp").alias("next")), "labels")
        labels = moved.select("sig", F.col("next").alias("comp"))
        if moved.where("next <> comp").isEmpty():
            return labels


def whole_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """sig, tokens: whole sets of the classes in members (sig, doc_id)."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            sets = shingle_sets(b.column(1), width)
            data = [sets.tokens[e - n : e].tobytes() for e, n in zip(sets.ends.tolist(), sets.n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(sets.signatures()), pa.array(data, pa.large_binary()).cast(pa.binary())], ["sig", "tokens"])

    sets = restricted(docs, members, members.count()).mapInArrow(whole, "sig long, tokens binary")
    return stash(sets.join(members.select("sig"), "sig", "left_semi").dropDuplicates(["sig"]), "sets")


def meetings(kept: DataFrame, groups: DataFrame, percent: int, ratio: float = 1.02) -> DataFrame:
    """Pairs x, y of different components that meet in lists often enough for the overlap that their sizes need.

    Classes are dealt to steps of size. For two steps it is known how many of the kept lists a pair shares at
    least; all of these but one, the longest, are set aside once more, and the pair must meet in as many of the
    rest as its overlap then still asks for.
    """
    marked = kept.join(groups, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    mixed = marked.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("length")).where("low < high")
    marked = marked.join(mixed.select("token", "length"), "token")
    rank = F.row_number().over(Window.partitionBy("sig").orderBy(F.col("length").desc(), "token"))
    marked = marked.select("token", "sig", "n", "comp", rank.alias("rank"), F.floor(F.log("n") / F.lit(math.log(ratio))).cast("int").alias("step"))
    marked = stash(marked, "mixed-lists")
    most = math.ceil(math.log(100 / percent) / math.log(ratio)) + 1
    t = percent / (100 + percent)

    def aside(large: Column, apart: Column) -> Column:
        # of sets of a and b <= a, t * (a + b) are common, and less than percent / 100 * a of these were set aside
        below, above = F.pow(F.lit(ratio), large - apart), F.pow(F.lit(ratio), large + 1)
        return F.greatest(F.lit(0), F.ceil(t * below - (percent / 100 - t) * above - 1e-6).cast("int") - 1)

    def spread(large: Callable[[Column], Column]) -> DataFrame:
        steps = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda d: F.col("rank") > aside(large(d), d))
        out = marked.withColumn("apart", F.explode(steps)).withColumn("large", large(F.col("apart")))
        return out.withColumn("aside", aside(F.col("large"), F.col("apart")))

    a, b = spread(lambda d: F.col("step")), spread(lambda d: F.col("step") + d)
    side = lambda df, k: df.select("token", "large", "apart", *[F.col(c).alias(c + k) for c in ("sig", "n", "comp", "aside")])
    keys = ["token", "large", "apart"]
    close = (F.col("compa") != F.col("compb")) & ((F.col("apart") > 0) | (F.col("siga") < F.col("sigb"))) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    a, b = side(a, "a"), side(b, "b").select(*[F.col(c).alias(f"b_{c}") for c in keys], "sigb", "nb", "compb")
    # Spark takes the exploded rows for as many bytes as their file and would broadcast them, up to most + 1 for each row of it
    met = a.join(b.hint("merge"), (F.col("token") == F.col("b_token")) & (F.col("large") == F.col("b_large")) & (F.col("apart") == F.col("b_apart")) & close)
    overlap = F.ceil((F.col("na") + F.col("nb")) * F.lit(percent) / F.lit(100 + percent))
    set_aside = F.ceil(F.greatest("na", "nb") * F.lit(percent) / F.lit(100)) - 1 + F.col("aside")
    met = met.groupBy("siga", "sigb", "na", "nb", F.col("asidea").alias("aside")).agg(F.count("*").alias("lists")).where(F.col("lists") >= overlap - set_aside)
    return met.select(F.least("siga", "sigb").alias("x"), F.greatest("siga", "sigb").alias("y")).distinct()


def join(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of docs (doc_id, text).

    n_links counts the links found between the document's class and others; copies and links inside a
    component that other links imply are not counted.
    """
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select("doc_id", "text")
    prefix = lambda n: n - need(n, percent) + spare(n)
    first = stash(lists(index(docs, width, buckets, prefix), buckets), "prefix-lists")
    rows = stash(documents_of(first), "sets")
    classes = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    hopeful = survivors(first, lambda n: spare(need(n, percent)), False)
    left = stash(hopeful.join(classes.select("sig", "doc_id"), "sig").select("sig", "doc_id"), "hopeful")
    count = left.count()
    chosen = restricted(docs, left, count)
    second = lists(index(chosen, width, buckets, None), buckets)
    kept = stash(survivors(second, lambda n: need(n, percent), True), "kept-lists")

    def leaders(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["token", "weight", "sig"], ascending=[True, False, True], ignore_index=True)
        x = df.groupby("token")["sig"].transform("first")
        some = pd.DataFrame({"y": df["sig"], "x": x})[df["sig"] != x]
        return some.groupby(["y", "x"], as_index=False).size().rename(columns={"size": "lists"})

    by_bucket = kept.withColumn("bucket", F.pmod("token", F.lit(buckets * 4)).cast("int"))
    led = by_bucket.groupBy("bucket").applyInPandas(tidied(leaders), "y long, x long, lists long")
    led = led.groupBy("y", "x").agg(F.sum("lists").alias("lists")).groupBy("y").agg(F.max_by("x", F.struct("lists", "x")).alias("x"))
    led = stash(led.select("x", "y"), "leaders")
    ends = lambda pairs: pairs.select(F.col("y").alias("sig")).union(pairs.select("x")).distinct()
    members = stash(ends(led).join(left, "sig"), "members")
    sets = whole_sets(docs, members, width)
    links = stash(compare(led, sets, percent), "links")
    groups = components(links)
    rest = stash(meetings(kept, groups, percent), "rest")
    if not rest.isEmpty():
        # classes that led nobody in the end
        others = stash(ends(rest).join(left, "sig").join(members.select("sig"), "sig", "left_anti"), "members")
        if not others.isEmpty():
            sets = sets.unionByName(whole_sets(docs, others, width))
        links = stash(links.union(compare(rest, sets, percent)), "links")
        groups = components(links)
    degree = links.select(F.col("x").alias("sig")).union(links.select("y")).groupBy("sig").agg(F.count("*").alias("n_links"))
    named = groups.join(degree, "sig").join(classes.select("sig", "doc_id"), "sig")
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "comp").select("sig", "n_links", "component_id")
    known = classes.select("sig", "doc_id", "copies").join(named, "sig", "left").select("sig", "copies", F.coalesce("component_id", "doc_id").alias("component_id"), "n_links")
    known = stash(known, "classes")
    # classes of many copies are few: at most one for so many documents
    hot = stash(known.where(F.col("copies") >= HOT), "hot-classes").select("sig", "component_id", "n_links", F.lit(True).alias("hot"))
    full = rows.where("n > 0").join(sized(hot), "sig", "left")
    cold = full.where("hot is null").drop("component_id", "n_links").join(known.where(F.col("copies") < HOT).select("sig", "component_id", "n_links"), "sig")
    found = full.where("hot").select("doc_id", "n", "component_id", "n_links").union(cold.select("doc_id", "n", "component_id", "n_links"))
    found = found.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))

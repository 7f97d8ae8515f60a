"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is in proportion to a preference (in the registered query and in
the pipeline it grows with the length of the document), so that its source comes to its target; no document
is expected more than ``most`` times, and what that takes away goes to the source's others. The whole
part of the expected copies is certain; the rest is a sample with unequal inclusion odds: documents are
ranked by random odds u / (1 - u) over inclusion odds p / (1 - p), and those ranked first are taken until
their words reach what the source still lacks. u comes from a hash of the id, so reruns and retries agree.

No source is sorted as a whole: ranks are cut into ranges, sums by range tell where a source's limit
falls, and that range is cut again until few documents are left in it, which alone are ranked one by one.
Sources meet documents by a salted join.

Null text has size 0; a null source is a source of its own, after the others; a null id's random number
comes from its text; repeated rows, alike in all that is read, have the same number and are ranked as one
with so many copies, so they don't pile up in a task; ties in rank go by hash of id, size and ``keep``;
columns that aren't read or kept are left out, whatever their names; an empty table gives no rows. Of a
very long text only the words are counted, in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import is_small, n_words, stash

#: Bits of rank, and then of the hash that breaks ties, that each cut uses, and how many there are.
CUT_BITS, RANK_BITS, TIE_BITS = 6, 48, 12
#: Rows of a source that are ranked one by one at most, unless nothing tells more of them apart.
RANKED = 1024
SALTS = 16


def unit(key: Column, seed: str) -> Column:
    """A number in (0, 1) fixed by key and seed, with 52 random bits."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def by_length(size: Column) -> Column:
    """A preference that grows by a quarter of the shortest's with each doubling of the words."""
    return (F.length(F.bin(size + 1)) + 3) / F.lit(4.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, size): share of all sizes dealt by weight.

    Sources in code point order, null last, take the weights in turn; no target exceeds ``most`` times its
    source's size, and the excess goes to the others by weight. Windows run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    by = by.withColumn("ratio", F.col("source_size") * F.lit(most) / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # the level at which this source and all with a larger ratio would be filled, those below being full
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - full * F.lit(most)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    by = by.withColumn("level", level)
    found = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    capped = F.col("source_size") * F.lit(most)
    return by.select("source", "source_size", F.when(found.isNull() | (F.col("ratio") <= found), capped).otherwise(found * F.col("weight")).cast("double").alias("target"))


def scales(sizes: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """goals (source, source_size, target) with scale and full: expected copies are scale * wish, or ``most`` where wish is above full.

    sizes: (source, size, wish). A window runs over one row for each wish that a source has, of which
    there are few by their rounding.
    """
    levels = sizes.groupBy("source", "wish").agg(F.sum("size").alias("words"))
    levels = levels.join(goals.withColumnRenamed("source", "source2"), F.col("source").eqNullSafe(F.col("source2"))).drop("source2")
    above = Window.partitionBy("source").orderBy(F.col("wish").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    # if all with a larger wish are full, the others share what is left; the largest wish that this doesn't fill is the limit
    full_words = F.coalesce(F.sum("words").over(above), F.lit(0))
    weight = F.sum(F.col("wish") * F.col("words")).over(whole) - F.coalesce(F.sum(F.col("wish") * F.col("words")).over(above), F.lit(0.0))
    levels = levels.withColumn("scale", F.when(weight > 0, (F.col("target") - full_words * F.lit(most)) / weight))
    fits = F.col("scale").isNotNull() & (F.col("scale") * F.col("wish") < F.lit(most))
    found = levels.groupBy("source", "source_size", "target").agg(F.max(F.when(fits, F.struct("wish", "scale"))).alias("found"))
    return found.select("source", "source_size", "target", F.col("found.scale").alias("scale"), F.col("found.wish").alias("full"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix:", preference: Column | str = "length", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and the columns ``keep`` for every row of docs (doc_id, source, text).

    ``preference``: "length" (by_length), "equal", or a positive column of docs, rounded to a 32nd of a
    doubling: the relative number of copies wished for a document. Expected copies never exceed ``most``.
    """
    size = n_words("text")
    if isinstance(preference, str):
        wish = by_length(size) if preference == "length" else F.lit(1.0)
    else:
        wish = F.coalesce(F.pow(F.lit(2.0), F.round(F.log2(F.when(preference > 0, preference.cast("double"))) * 32) / 32), F.lit(1.0))
    # names that no column of the caller's has
    own = {c: f"{c}__{uuid.uuid4().hex[:6]}" for c in keep}
    random = unit(F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))), seed)
    rows = docs.select("doc_id", "source", size.alias("size"), wish.alias("wish"), random.alias("u"), F.spark_partition_id().alias("part"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    # of rows alike in everything that counts, those of a partition are one
    rows = stash(rows.groupBy("doc_id", "source", "size", "wish", "u", "part", *own.values()).agg(F.count("*").alias("rows")), "sizes")
    sizes = rows.select("source", (F.col("size") * F.col("rows")).alias("size"), "wish")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    goals = stash(scales(sizes, targets(sizes, weights, share, most), most).withColumn("key", key).drop("source"), "targets")
    some = meet(rows.withColumns({"key": key, "salt": (F.col("u") * F.lit(SALTS)).cast("int")}), goals)
    filled = F.when(F.col("full").isNull() | (F.col("wish") > F.col("full")), F.lit(float(most))).otherwise(F.greatest(F.lit(0.0), F.col("scale") * F.col("wish")))
    copies = F.when(F.col("source_size") > 0, filled).otherwise(F.lit(0.0))
    some = some.withColumn("whole", F.floor(copies)).withColumn("p", copies - F.col("whole"))
    # odds u / (1 - u) over odds p / (1 - p), carried on to (0, 1) in the same order
    some = some.withColumn("rank", F.when(F.col("p") > 0, F.col("u") / (F.lit(1.0) - F.col("u")) / (F.col("p") / (F.lit(1.0) - F.col("p")))))
    place = F.floor(F.col("rank") / (F.lit(1.0) + F.col("rank")) * F.lit(float(1 << RANK_BITS)))
    some = some.withColumns({"place": F.least(place, F.lit((1 << RANK_BITS) - 1)), "tie": F.pmod(F.xxhash64("doc_id", "size", *own.values()), F.lit(1 << TIE_BITS)), "words": F.col("size") * F.col("rows")})
    some = stash(some.drop("wish", "scale", "full"), "ranked")
    lacks = stash(some.groupBy("key").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("lacks")), "lacks")
    limits, bits = limits_of(some.where("rank is not null").select("key", "salt", "place", "tie", "words"), lacks)
    judged = meet(some, limits, "left").withColumn("head", head(bits))
    order = Window.partitionBy("key").orderBy("place", "tie", "rank", "doc_id", "size", "part", *own.values()).rowsBetween(Window.unboundedPreceding, -1)
    inner = judged.where("head = range").withColumn("left", F.col("lacks") - F.col("before") - F.coalesce(F.sum("words").over(order), F.lit(0)))
    # rows alike are taken one after the other while half of the next still fits
    fit = F.when(F.col("rows") == 1, (F.col("size") / F.lit(2.0) <= F.col("left")).cast("long")).when(F.col("size") == 0, F.when(F.col("left") >= 0, F.col("rows")))
    inner = inner.withColumn("picked", F.greatest(F.lit(0), F.least("rows", F.coalesce(fit, F.floor(F.col("left") / F.col("size") + F.lit(0.5))))).cast("long")).drop("left")
    # no range: all that are ranked are taken
    taken = F.col("rank").isNotNull() & (F.col("range").isNull() | (F.col("head") < F.col("range")))
    outer = judged.where("rank is null or range is null or head <> range").withColumn("picked", F.when(taken, F.col("rows")).otherwise(F.lit(0)).cast("long"))
    out = outer.unionByName(inner).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    out = out.withColumn("copies", F.col("whole") + (F.col("nth") <= F.col("picked")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(n).alias(c) for c, n in own.items()])


def meet(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """rows (key, salt, ...) with table, a stash of a row for each source: broadcast if small, else joined by key and salt."""
    if is_small(table):
        return rows.join(F.broadcast(table), "key", how)
    return rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], how)


def head(bits: int) -> Column:
    """The first bits of a row's place, then of its tie."""
    if bits <= RANK_BITS:
        return F.shiftright("place", RANK_BITS - bits)
    return F.shiftleft("place", bits - RANK_BITS) + F.shiftright("tie", RANK_BITS + TIE_BITS - bits)


def limits_of(inside: DataFrame, lacks: DataFrame) -> tuple[DataFrame, int]:
    """key, lacks, range, before of each source: the range of ranked rows, by their first so many bits, that its limit falls into.

    inside: (key, salt, place, tie, words). Range is null where all words together don't go beyond what is
    lacking. Windows run over the ranges of a cut, 64 for each source.
    """
    limits, bits = lacks.withColumn("before", F.lit(0).cast("long")), 0
    earlier = Window.partitionBy("key").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        bits += CUT_BITS
        # rows of the last range, by the next bits
        sums = inside.groupBy("key", head(bits).alias("cut")).agg(F.sum("words").alias("words"), F.count("*").alias("n"))
        sums = sums.join(limits.select("key", "lacks", "before"), "key").withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        ends = sums.where("before + words > lacks").groupBy("key").agg(F.min(F.struct("cut", "before", "n")).alias("end"))
        now = limits.select("key", "lacks").join(ends, "key", "left")
        limits = stash(now.select("key", "lacks", F.col("end.cut").alias("range"), F.coalesce("end.before", F.lit(0).cast("long")).alias("before"), F.col("end.n").alias("n")), "limits")
        most = limits.agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= RANKED or bits == RANK_BITS + TIE_BITS:
            return limits.drop("n"), bits
        inside = stash(meet(inside, limits.select("key", F.col("range").alias("limit"))).where(head(bits) == F.col("limit")).drop("limit"), "inside")


def repeated(docs: DataFrame, mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs, each as often as mixed (key, copies) says; keys must be distinct or their rows alike."""
    of, n, nth = (f"{name}__{uuid.uuid4().hex[:6]}" for name in ("of", "n", "nth"))
    copies = mixed.groupBy(F.col(key).alias(of)).agg(F.max("copies").cast("int").alias(n))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    joined = docs.alias("d").join(copies, F.col(f"d.`{key}`").eqNullSafe(F.col(of))).where(F.col(n) > 0)
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias(nth)).drop(nth)

"""Removal of repeated passages by content-defined chunks of lines.

A rolling hash over the hashes of two lines in a row marks places; a chunk ends at a mark that no other
mark precedes directly, so chunks have two lines or more and boundaries depend on three lines only: they
come back in step soon after an insertion. Chunks of several lines that occur more than once in the corpus
are removed everywhere but at their first place (by doc_id, then place), after their bytes are compared.

A passage seldom begins and ends at boundaries, so windows are units beside the chunks: from each line on, and up
to each line, the fewest lines in a row (two at least) that have ``long_line`` words, and single lines of so many words. A unit that
stands elsewhere before is removed: all its lines stand there in a row, in one document. A passage of that many words is
covered by the windows within it. Chunks themselves need no length, but a word. Only runs of lines can hold a repeated
window of which each pair of neighbours occurs more than once, so windows are made within such runs alone. A place
that overlaps the first one, in a text that repeats itself, isn't another place.

Everything is DataFrame expressions. Only hashes are counted for all documents; texts are gathered for
hashes that repeat, and grouped as texts, which is the byte comparison. Hot chunks are aggregated before
the shuffle. Tables of hashes and places are broadcast if they are small by their bytes, else joined by a
shuffle; texts are never broadcast.

Null text stays null; empty text stays empty; rows alike in doc_id and text are one document, of which all
rows keep the same; null ids come first; extra columns pass through, those named like a result (n_lines,
n_removed_lines) under their own name beside it, which is then renamed with a trailing underscore; ties
don't occur, as no two places are the same; an empty table gives no rows. A very long text is handled by
one task, in memory of a few times its size and in time that follows its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, n_words, sized, stash

#: Sorts of units: a content-defined chunk, two lines in a row (to find runs of lines), a long line, a window of long_line words.
CHUNK, PAIR, LINE, WINDOW = 0, 1, 2, 3


def hashed_lines(text: Column) -> tuple[Column, Column]:
    """A text's lines and a 48-bit hash of each."""
    lines = F.split(text, "\n")
    value = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 12), 16, 10).cast("long")
    return lines, F.transform(lines, value)


def with_units(docs: DataFrame, long_line: int, texts: bool) -> DataFrame:
    """doc_id, row (a number for the row's id and text), sort, at, size, hash (of sort and text) and, if asked for, text of each unit."""
    lines, values = hashed_lines(F.col("text"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), lines.alias("lines"), values.alias("v"))
    v, n = F.col("v"), F.size("lines")
    marked = F.transform("v", lambda x, i: F.when(i > 0, F.pmod(F.get(v, i - 1) * 31 + x, F.lit(1021)) < 510).otherwise(F.lit(False)))
    rows = rows.withColumn("m", F.when(n >= 0, marked))
    m, all_lines = F.col("m"), F.col("lines")
    ends = F.filter(F.transform(m, lambda x, i: F.when((i == n - 1) | (x & ~F.coalesce(F.get(m, i - 1), F.lit(False))), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("ends", ends)
    e = F.col("ends")
    starts = F.concat(F.array(F.lit(0)), F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))))

    def unit(sort: int, at: Column, size: Column, text: Column) -> Column:
        out = [F.lit(sort).alias("sort"), at.alias("at"), size.alias("size"), F.xxhash64(F.lit(sort), text).alias("hash")]
        return F.struct(*out, *([text.alias("text")] if texts else []))

    chunks = F.zip_with(starts, e, lambda a, z: F.when(z - a > 1, unit(CHUNK, a, z - a, F.array_join(F.slice(all_lines, a + 1, z - a), "\n"))))
    pairs = F.transform(all_lines, lambda x, i: F.when(i < n - 1, unit(PAIR, i, F.lit(2), F.concat(x, F.lit("\n"), F.get(all_lines, i + 1)))))
    # a text of so many characters at least: counting words is for long lines only
    enough = lambda x: (F.length(x) >= 2 * long_line - 1) & (n_words(x) >= long_line)
    singles = F.transform(all_lines, lambda x, i: F.when(enough(x), unit(LINE, i, F.lit(1), x)))
    units = F.filter(F.concat(chunks, pairs, singles), lambda u: u.isNotNull())
    # outer, as Spark would else repeat the whole chain of expressions in a filter before it
    return rows.select("doc_id", "row", F.explode_outer(F.when(n > 0, units)).alias("u")).where("u is not null").select("doc_id", "row", "u.*")


def first_places(some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, first) of hashes that one repeated text has, and (hash, text, first) of repeated texts where several share a hash."""
    place = F.struct("doc_id", "row", "at").alias("place")
    texts = stash(some.groupBy("hash", "text").agg(F.min(place).alias("first"), F.count("*").alias("n")), "texts")
    single = texts.groupBy("hash").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.min("n").alias("n"))
    mixed = stash(single.where("texts > 1").select("hash"), "mixed")
    plain = stash(single.where("texts = 1 and n > 1").select("hash", "first"), "firsts")
    return plain, texts.where("n > 1").join(sized(mixed), "hash", "left_semi").select("hash", "text", "first")


def windows(pairs: DataFrame, long_line: int) -> DataFrame:
    """Units of windows within the runs of lines that pairs (doc_id, row, at, text) make."""
    key = ["doc_id", "row", "run"]
    rank = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("at"))
    runs = pairs.select("doc_id", "row", "at", "text").distinct().withColumn("run", F.col("at") - rank)
    runs = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("pairs"))
    both = F.transform("pairs", lambda p: F.split(p["text"], "\n"))
    lines = F.concat(F.array(F.get(F.get(both, 0), 0)), F.transform(both, lambda x: F.get(x, 1)))
    runs = stash(runs.select(*key, F.col("pairs")[0]["at"].alias("first_line"), lines.alias("lines")), "runs")
    # words before a line and up to it; one line counts as long_line words at most, which changes no window
    counted = runs.select(*key, F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "lines")).alias("nth", "line"))
    so_far = F.sum(F.least(n_words("line"), F.lit(long_line))).over(Window.partitionBy(*key).orderBy("nth")).alias("so_far")
    counted = counted.select(*key, "nth", so_far)
    order = Window.partitionBy(*key).orderBy("so_far")
    counted = counted.withColumns({"to": F.min("nth").over(order.rangeBetween(long_line, 2 * long_line - 1)), "since": F.max("nth").over(order.rangeBetween(1 - 2 * long_line, -long_line))})
    ends = F.array(F.struct((F.col("nth") + 1).alias("a"), F.col("to").alias("z")), F.struct((F.col("since") + 1).alias("a"), F.col("nth").alias("z")))
    ends = counted.select(*key, F.inline(ends)).where("z > a").distinct()
    own = runs.select(*[F.col(c).alias(f"own_{c}") for c in key], "first_line", "lines")
    ends = ends.join(own, (F.col("row") == F.col("own_row")) & (F.col("run") == F.col("own_run")) & F.col("doc_id").eqNullSafe(F.col("own_doc_id")))
    text = F.array_join(F.slice("lines", F.col("a"), F.col("z") - F.col("a") + 1), "\n")
    size = (F.col("z") - F.col("a") + 1).cast("int")
    units = ends.select("doc_id", "row", F.lit(WINDOW).alias("sort"), (F.col("first_line") + F.col("a") - 1).cast("int").alias("at"), size.alias("size"), text.alias("text"))
    return units.select("doc_id", "row", "sort", "at", "size", F.xxhash64("sort", "text").alias("hash"), "text")


def gone_lines(docs: DataFrame, long_line: int) -> DataFrame:
    """doc_id, row, gone: sorted numbers of the lines of each document (doc_id, text) that go."""
    counted = with_units(docs, long_line, False).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    repeated = stash(counted, "repeated")
    found = stash(with_units(docs, long_line, True).join(sized(repeated), "hash", "left_semi").where(F.col("text").rlike(WORD) | (F.col("sort") == PAIR)), "repeats")
    some = found.where(F.col("sort") != PAIR)
    some = stash(some.unionByName(windows(found.where(F.col("sort") == PAIR), long_line).select(some.columns)), "candidates")
    plain, mixed = first_places(some)
    place = F.struct("doc_id", "row", "at").alias("place")
    units = some.select("hash", place, "size")
    p, first = F.col("place"), F.col("first")
    elsewhere = ~(p["doc_id"].eqNullSafe(first["doc_id"]) & (p["row"] == first["row"]) & (p["at"] < first["at"] + F.col("size")))
    later = units.join(sized(plain), "hash").where(elsewhere).select("place", "size")
    if not mixed.isEmpty():
        later = later.unionByName(some.select("hash", "text", place, "size").join(mixed, ["hash", "text"]).where(elsewhere).select("place", "size"))
    lines = later.select("place.doc_id", "place.row", F.explode(F.sequence(F.col("place.at"), F.col("place.at") + F.col("size") - 1)).alias("line")).distinct()
    return lines.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def dedup(docs: DataFrame, long_line: int = 50) -> DataFrame:
    """docs with text shortened, and n_lines and n_removed_lines of each row."""
    gone = stash(gone_lines(docs.select("doc_id", "text"), long_line), "gone")
    taken = {c.lower() for c in docs.columns}
    free = lambda name: name if name.lower() not in taken else free(f"{name}_")
    of, of_id, lines_gone = free("gone_of"), free("gone_of_id"), free("gone_lines")
    small = gone.select(F.col("row").alias(of), F.col("doc_id").alias(of_id), F.col("gone").alias(lines_gone))
    rows = docs.join(sized(small), (F.xxhash64("doc_id", "text") == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(of_id)), "left")
    lines, g = F.split("text", "\n"), F.col(lines_gone)
    before = lambda k: F.when(k > 0, F.get(g, k - 1) + 1).otherwise(F.lit(0))
    after = lambda k: F.coalesce(F.get(g, k), F.size(lines))
    # what stands between one line that goes and the next
    parts = F.transform(F.sequence(F.lit(0), F.size(g)), lambda k: F.slice(lines, before(k) + 1, after(k) - before(k)))
    text = F.when(g.isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    n_lines = F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(F.lit(0)).cast("long").alias(free("n_lines"))
    n_gone = F.when(g.isNotNull(), F.size(g)).otherwise(F.lit(0))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], n_lines, n_gone.cast("long").alias(free("n_removed_lines")))

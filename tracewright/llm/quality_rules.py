"""Quality rules: counts on whole texts, and divergence from language references.

A document's characters by class, and its words by a list of its language's common words (in either case,
without marks at their end), are two histograms. References are the mean histograms of all documents of
the language that pass the base rules and the length guards; where most of a language's documents are bad,
a caller passes references of a better corpus. A document is rejected where the Jensen-Shannon distance
(base 2, from 0 to 1) of either histogram exceeds its threshold; texts below the guards are not judged by
it, as their histograms say little.

Everything is DataFrame expressions on one row; only the references are an aggregate, of one row per
language listed, and one for the rest. Repeated windows are told by 64-bit hashes within a text.

Null text has no words and fails the base rules; an unlisted or null language is compared by characters
with the mean of all languages; repeated rows are judged alike; a distance at its limit passes; null ids
are kept and columns beside doc_id, text and lang are ignored, whatever their names; an empty table gives
no rows. A very long text is handled by one task, in memory of about ten times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, stash

#: Common words by language.
COMMON = {
    "de": "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als".split(),
    "en": "the of and to a in is that it for was on with as be by are this at from".split(),
    "es": "de la que el en y los las se del un por con no una su para es al lo".split(),
    "fr": "de la le et les en des un du une que est pour par dans avec qui pas sur au".split(),
}
#: Classes of characters; all others are one more class.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": "0-9", "space": r"\x20\x09-\x0D", "stop": ".,;:!?", "symbol": "#*$%&|<>"}
REST = "other"
N_COMMON = 20
LETTERS = "abcdefghijklmnopqrst"
#: Taken off the ends of words before they are looked for in a list.
MARKS = ".,;:!?"


def class_counts(text: str, rest: str) -> list[Column]:
    """Characters of each class, in the order of CLASSES, then the others; rest: text without small letters and blanks, which most of it is."""
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    counts = {k: F.length(F.regexp_replace(rest, f"[^{c}]+", "")) for k, c in CLASSES.items() if k != "lower"}
    counts |= {"lower": F.length(text) - F.length(rest) - blanks, "space": counts["space"] + blanks}
    all_classes = [counts[k] for k in CLASSES]
    return [*all_classes, F.length(text) - sum(all_classes[1:], all_classes[0])]


def features(docs: DataFrame) -> DataFrame:
    """One row per document: the base counts and the two histograms as arrays of counts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).alias("lang"), text.alias("text"))
    rows = rows.withColumns({"words": F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), "rest": F.regexp_replace("text", r"[\p{Ll}\x20]+", "")})
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    n = F.size("words")
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    h = F.col("hashes")
    rows = rows.withColumn("windows", F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0))))
    listed = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    rows = rows.withColumn("list", F.element_at(listed, F.col("lang")))
    common = F.col("list")
    # a letter for each word: which of the list it is, or none; counted by what is left without a letter
    bare = F.split(F.lower(F.array_join("words", " ")), " ")
    letter = F.transform(bare, lambda w: F.substring(F.lit(f"-{LETTERS}"), F.array_position(common, F.rtrim(w, F.lit(MARKS))).cast("int") + 1, F.lit(1)))
    rows = rows.withColumns({"letters": F.when(common.isNotNull(), F.array_join(letter, "")), "classes": F.array(*class_counts("text", "rest"))})
    rows = rows.withColumn("hits", F.array(*[F.length("letters") - F.length(F.replace("letters", F.lit(x), F.lit(""))) for x in LETTERS]))
    hits, classes = F.col("hits"), F.col("classes")
    rows = rows.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), (F.length("text") - classes[list(CLASSES).index("space")]).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "classes",
        F.when(common.isNotNull(), F.concat(hits, F.array(n - sum((hits[i] for i in range(N_COMMON)), F.lit(0))))).alias("terms"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.col("windows")).alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", placed)
    at = F.col("placed")
    repeated = F.filter(at, lambda x, j: (F.get(at, j - 1)["h"] == x["h"]) | (F.get(at, j + 1)["h"] == x["h"]))
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    cover = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
    covered = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), cover, lambda acc: acc["n"])
    symbols = F.col("classes")[list(CLASSES).index("symbol")].cast("long")
    return rows.withColumns({"n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), "n_symbols": symbols}).drop("windows", "placed")


def shares(counts: str, n: int) -> list[Column]:
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return [F.when(total > 0, F.col(counts)[i] / total) for i in range(n)]


def js_distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance of a histogram of counts from a reference distribution of as many bins; null where either is missing."""
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)

    def part(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (half(p) + half(q)) / 2

    parts = F.zip_with(counts, reference, lambda c, q: part(c / total, q))
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))))


def judge(docs: DataFrame, min_chars: int = 200, min_words: int = 50, char_limit: tuple[float, float] = (0.115, 0.8), word_limit: tuple[float, float] = (0.13, 1.45), references: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, char_js, word_js, kept of each row of docs (doc_id, text, lang).

    A limit (a, b) is a distance of a + b / sqrt(n_words): the histograms of shorter texts stray further by chance.
    ``references``: documents to take the references from, if not docs.
    """
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    rows = stash(features(docs).withColumn("base_failed", failed), "quality")
    n_classes = len(CLASSES) + 1
    base = rows if references is None else stash(features(references).withColumn("base_failed", failed), "quality")
    good = base.where(~F.col("base_failed") & (F.col("n_words") >= min_words) & (F.aggregate("classes", F.lit(0), lambda a, x: a + x) >= min_chars))
    means = [F.avg(x) for x in shares("classes", n_classes)], [F.avg(x) for x in shares("terms", N_COMMON + 1)]
    refs = good.groupBy("lang").agg(F.array(*means[0]).alias("ref_classes"), F.array(*means[1]).alias("ref_terms"))
    # one row per listed language at most, so small enough to broadcast; the pooled one serves all others
    pooled = good.agg(F.array(*means[0]).alias("all_classes"))
    refs = stash(refs.where("lang is not null").withColumnRenamed("lang", "ref_lang"), "references")
    rows = rows.join(F.broadcast(refs), F.col("lang") == F.col("ref_lang"), "left")
    every = pooled.first()["all_classes"]
    rest = F.array(*[F.lit(x) for x in every]) if every and every[0] is not None else F.lit(None).cast("array<double>")
    rows = rows.withColumn("ref_classes", F.coalesce("ref_classes", rest))
    chars = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    rows = rows.withColumns({"char_js": js_distance("classes", "ref_classes"), "word_js": js_distance("terms", "ref_terms")})
    limit = lambda ab: F.lit(ab[0]) + F.lit(ab[1]) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    off = (chars >= min_chars) & (F.col("char_js") > limit(char_limit)) | (F.col("n_words") >= min_words) & (F.col("word_js") > limit(word_limit))
    kept = ~F.col("base_failed") & ~F.coalesce(off, F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "char_js", "word_js")

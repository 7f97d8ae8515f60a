"""Groups of spelling variants: words one edit apart, found by walking a trie that is a table.

The trie is a table of edges between nodes, a node being what words begin with; chains without a choice are
one edge, so an edge has a label of one letter or more. A state is (word, position, node, edits): so much of the
word has been used up on the way to the node, with so many edits. Level by level all states are joined with the
edges that leave their nodes; where a state with one edit has used up its word at a node where a word ends, that
word is a neighbour.

* States without an edit only stand on the path of their own word, so all of them are there at the start. An edit
  can be told only where the neighbour's path leaves the word's own, and that is a node with a choice, or one where a
  word ends: the first level tries replacement, insertion and deletion there, along edges that begin with another letter.
* Later levels must match. They are few, as most states die on their first label; each is written, so an executor's
  loss costs one level.
* Paths would be wide near the root. So an edit is looked for in the second half of the word only, in a trie of
  the words, and in the first half in a trie of the words reversed: every walk begins below half a word, and the
  upper part of neither trie is needed.

Nodes go by a 64-bit hash of what they stand for, computed along a word in linear time; two that share a hash
would only make more candidates, and every pair found is compared letter by letter at the end. Words that many
words resemble (a hot node) make as many states as there are letters to choose from, not pairs of words.

Texts that are null or have no word give none; a null id leaves all of its words as they are; repeated rows count
as often as they occur; ties in frequency go to the word first in code-point order; an empty table gives no rows;
other columns are ignored, whatever their names. A very long text is split in one task, in memory of a few
times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import discard, sized, stash

#: Runs of letters that count as words.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of the hash of what leads to a node, by the place of each letter.
BASE = np.uint64(0x9E3779B97F4A7C15)

NODES = "side int, wid long, depth int, node long, next int, start boolean"


def word_counts(docs: DataFrame, typo_every: int | None = None, least_length: int = 1, least_count: int = 1) -> DataFrame:
    """word, n of whole texts (doc_id, text), A to Z in lower case, of so many letters and occurrences at least.

    typo_every: every run whose crc32 beside its document's id is divisible by it loses the letter that the crc32 picks.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("word"))
    if typo_every:
        crc = F.crc32(F.encode(F.concat("id", F.lit(":"), "word"), "UTF-8"))
        at = F.pmod(crc, F.length("word")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.pmod(crc, F.lit(typo_every)) == 0, less).otherwise(F.col("word")).alias("word"))
    counts = runs.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def first_depth(length: np.ndarray, side: int) -> np.ndarray:
    """Where the walks of words begin, in the trie of words (side 0) or of words reversed (side 1)."""
    return length // 2 if side == 0 else length - length // 2


def nodes(words: DataFrame) -> DataFrame:
    """The nodes of each word's (wid, word) lower half in both tries: hash, the letter that follows (-1: the word ends), whether walks begin there."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            letters = np.frombuffer("".join(df["word"]).encode("utf-32-le"), "<u4").astype(np.int64)
            length = df["word"].str.len().to_numpy(np.int64)
            begin = np.cumsum(length) - length
            powers = np.multiply.accumulate(np.full(max(length, default=1), BASE))
            for side in (0, 1):
                first = first_depth(length, side)
                # a neighbour may be a letter longer, and then begins a letter later
                low = np.maximum(first - 1, 0)
                place = np.arange(len(letters)) - np.repeat(begin, length)
                own = letters if side == 0 else letters[np.repeat(begin + length - 1, length) - place]
                sums = np.concatenate([[np.uint64(0)], np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers[place])])
                n = length - low + 1
                which = np.repeat(np.arange(len(length)), n)
                depth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
                at = begin[which] + depth
                after = np.where(depth < length[which], np.append(own, -1)[at], -1)
                yield pd.DataFrame({"side": np.int32(side), "wid": df["wid"].to_numpy()[which], "depth": depth, "node": (sums[at] - sums[begin[which]]).view(np.int64), "next": after, "start": depth >= first[which]})

    return words.select("wid", "word").mapInPandas(work, NODES)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (side, node, label, child, ends: the word that ends at child), and states without an edit (side, wid, node, rest, here: the word that ends at node)."""
    all_nodes = stash(nodes(words), "nodes")
    choice = F.min("next") < F.max("next")
    forks = all_nodes.groupBy("side", "node").agg((choice | (F.min("next") == -1)).alias("kept")).where("kept").select("side", "node")
    path = Window.partitionBy("side", "wid").orderBy("depth")
    rows = all_nodes.join(forks, ["side", "node"], "left_semi").withColumns({"child": F.lead("node").over(path), "to": F.lead("depth").over(path)})
    text = words.select("wid", "word", F.reverse("word").alias("back"))
    rows = rows.join(text, "wid").withColumn("spelt", F.when(F.col("side") == 0, F.col("word")).otherwise(F.col("back")))
    rows = stash(rows.select("side", "wid", "depth", "node", "child", "start", "word", F.substring("spelt", F.col("depth") + 1, F.col("to") - F.col("depth")).alias("label"), F.substring("spelt", F.col("depth") + 1, F.length("spelt")).alias("rest")), "paths")
    ends = rows.where("child is null").select("side", F.col("node").alias("child"), F.col("word").alias("ends"))
    edges = rows.where("child is not null").select("side", "node", "label", "child").distinct().join(ends, ["side", "child"], "left")
    here = ends.select("side", F.col("child").alias("node"), F.col("ends").alias("here"))
    states = rows.where("start").select("side", "wid", "node", "rest").join(here, ["side", "node"], "left")
    discard(all_nodes)
    return stash(edges.select("side", "node", "label", "child", "ends"), "edges"), stash(states, "states")


def neighbours(words: DataFrame) -> DataFrame:
    """word, near: words (wid, word) and those of them that differ from them by exactly one letter inserted, deleted or replaced."""
    edges, begun = trie(words)
    along = sized(edges)
    label, rest = F.col("label"), F.col("rest")
    length = F.length(label)

    def used(tail, skipped: int):
        """What is left of rest after its first letters, so many, and then the tail of a label; null if that isn't there."""
        return F.when((F.length(rest) >= F.length(tail) + skipped) & (F.substring(rest, F.lit(skipped + 1), F.length(tail)) == tail), F.substring(rest, F.length(tail) + (skipped + 1), F.length(rest)))

    other = F.substring(label, 1, 1) != F.substring(rest, 1, 1)
    tail = F.substring(label, F.lit(2), length)
    ways = F.array(used(tail, 1), used(tail, 0), used(label, 1))
    first = begun.join(along, ["side", "node"]).where(other).select("side", "wid", F.col("child").alias("node"), "ends", F.explode(F.array_distinct(F.filter(ways, lambda x: x.isNotNull()))).alias("rest"))
    now = stash(first, "frontier")
    # a last letter deleted
    found = [stash(begun.where((F.length("rest") == 1) & F.col("here").isNotNull()).select("wid", F.col("here").alias("near")), "near")]
    while not now.isEmpty():
        found.append(stash(now.where((F.col("rest") == "") & F.col("ends").isNotNull()).select("wid", F.col("ends").alias("near")).distinct(), "near"))
        step = now.where("rest <> ''").drop("ends").join(along, ["side", "node"]).select("side", "wid", F.col("child").alias("node"), "ends", used(label, 0).alias("rest")).where("rest is not null")
        last, now = now, stash(step.distinct(), "frontier")
        discard(last)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.distinct().join(words.select("wid", "word"), "wid")
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form): the last of the forms of forms. Forms are more frequent, so there is a last one."""
    last = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        now = last.select("word", "root")
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return now
        discard(last)
        last = moved


def variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n).

    A word's form is the most frequent word one edit from it, if that occurs ratio times as often as the word at least.
    """
    words = stash(counts.where("word <> ''").withColumn("wid", F.monotonically_increasing_id()), "words")
    pairs = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    best = stash(best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n")), "best")
    rows = words.join(best, "word", "left").withColumn("is_form", F.coalesce(F.col("near_n") >= F.col("n") * ratio, F.lit(False)))
    rows = stash(rows.select("word", F.when(F.col("is_form"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("near_n")).alias("form_n")), "forms")
    top = roots(rows.where("form is not null"))
    return rows.join(top, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""A corpus pipeline of five stages over documents.

Each stage works on what the one before it kept, which lies in between as Parquet, and all but the last
return the columns of documents, whatever further ones there are. Empty tables pass through all stages. Very
long texts are handled as in the operators: by one task each, in memory that is a multiple of their size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import classifier, line_dedup, mixing, ngram_join, packing
from tracewright.llm.common import WORD, sized, stash, table
from tracewright.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject.

    Null and empty texts are judged by their metadata; repeated rows, and texts that tie in all that is looked at, stay
    or go together; a score at the limit stays; columns of any name pass through.
    """
    return classifier.kept(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand elsewhere before; those of which nothing is left are gone.

    Null and empty texts stay as they are; rows alike in id and text are one document, and all stay; null ids come
    first, and no two places tie. n_chars follows the text where that was shortened; columns of any name pass through.
    """
    out = line_dedup.dedup(docs)
    lines, removed = (F.col(f"`{c}`") for c in out.columns[len(docs.columns) :])
    columns = {c: F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns}
    return out.where((removed == 0) | (removed < lines)).select(*columns.values())


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, stashed with a number of each row of its own, as ids may be null or repeat; and the name of that column, which docs don't have."""
    taken, name = {c.lower() for c in docs.columns}, "row_number"
    while name in taken:
        name += "_"
    return stash(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one of the smallest id, null ids last.

    Texts without words group with nothing but rows alike in a non-null id and text. Of rows that tie in id the one of the
    smaller hash of its text stays, of repeated rows any one; columns of any name pass through.
    """
    rows, number = numbered(docs)
    own = rows.select(F.col(number).alias("row"), "doc_id", "text")
    groups = ngram_join.join(own.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("of"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("group"))
    wordless = ~F.coalesce("text", F.lit("")).rlike(WORD)
    members = own.select("row", "doc_id", F.xxhash64("text").alias("hash"), wordless.alias("wordless"), F.when(wordless, F.col("text")).alias("blank"))
    members = members.join(groups, F.col("row") == F.col("of"))
    alone = F.when(F.col("wordless"), F.when(F.col("doc_id").isNull(), F.col("row")))
    same = ["group", F.when(F.col("wordless"), F.col("doc_id")).alias("same_id"), "blank", alone.alias("alone")]
    members = stash(members.select("row", *same, F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash", "row").alias("place")), "members")
    firsts = members.groupBy("group", "same_id", "blank", "alone").agg(F.min("place")["row"].alias("first"))
    gone = stash(members.join(firsts, F.col("row") == F.col("first"), "left_anti").select(F.col("row").alias(number)), "gone")
    return rows.join(sized(gone), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix's proportions, each as often as the mix takes it.

    Texts without words have size 0 and are taken or left like others; null ids are drawn by their texts; repeated rows
    tie in rank and are told apart by their sizes and places; columns of any name pass through.
    """
    rows, number = numbered(docs)
    return mixing.repeated(rows, mixing.mix(rows, keep=(number,)), number).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; null and empty texts are an end id alone.

    Repeated rows and ids are documents each; pieces of one length tie, and go anywhere; other columns don't matter.
    """
    # less text at once than where packing runs alone, as executors still hold what earlier stages took
    return packing.pack(packing.cut(docs, vocabulary("word_bpe_49k.json"), bytes_most=3_000_000))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: No SQL expresses a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact top-k search by inner product, a block of documents at a time.

Vectors are rows of integer term weights. They are dealt by hash to shards of bounded size; a shard orders
its vectors so that alike ones stand together and cuts them into ranges, the blocks. Of a block it keeps
each term's largest and smallest weight and a forward index (the block's weights as a matrix). A query sums
each term's best contribution over the block's extremes: no document of the block scores more. Blocks are
visited by falling bound, scored whole through their forward index, until the bound falls below the query's
k-th score so far; blocks at that score are still scored, as ties go to the smaller id.

Shards are indexed once, a row each, and stay where they are: queries are packed into chunks of bounded size,
and as many chunks at a time as AT_ONCE_BYTES hold are broadcast past all shards. A first pass over one shard gives every query a
k-th score that the other shards start from; the shards' lists then meet in a ranking per query.

Vectors that are null, or hold a null or non-finite component, take no part, and neither do null ids. Repeated
rows are candidates as often as they occur (they travel once, with a number), and a repeated query asks for all its
rows together; rows with the query's own id are never its candidates; ties in score go to
the smaller id; fewer candidates than k are all returned; vectors of different lengths don't meet; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import stash

#: Vectors in a block, vectors in a shard and queries in a chunk (about, and at most).
BLOCK, SHARD, CHUNK = 64, 8192, 2048
#: Bytes of a shard, of a chunk, and of chunks that are broadcast at once, at most (about): longer vectors make smaller ones.
SHARD_BYTES, CHUNK_BYTES, AT_ONCE_BYTES = 4 << 20, 1 << 20, 32 << 20


def quantised(vectors: DataFrame, id_column: str, vector: str, scale: int = 256, **keep: Column) -> DataFrame:
    """id, weights (floor(scale * x) of each component) and the columns to keep; rows that can't take part are left out."""
    x = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    kept = [c.alias(name) for name, c in keep.items()]
    return vectors.where(fine & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("weights"), *kept)


def parts_of(n: int, most: int, room: int, longest: int) -> int:
    """Into how many parts n vectors go, of so many at most, and of so many bytes."""
    return max(1, -(-n // max(1, min(most, room // (8 * longest)))))


class Shard:
    """The blocks of one shard: bounds and forward indexes."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, copies: np.ndarray):
        """ids, weights and copies in the order of the blocks."""
        self.ids, self.weights, self.copies = ids, weights, copies
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high, self.low = np.maximum.reduceat(weights, self.starts), np.minimum.reduceat(weights, self.starts)

    @staticmethod
    def order(ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Vectors by the signs of the terms that vary most, the most varied first."""
        by_spread = np.argsort(-weights.var(0), kind="stable")[:24]
        return np.lexsort((ids, *[(weights[:, d] > 0) for d in by_spread[::-1]]))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int, int, int]]:
        """(query, id, score, copies, number of the query) of each query's best k here that score at least its floor."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        out = []
        for i in range(len(queries)):
            at_least = int(floor[i])
            places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for b in np.argsort(-bounds[i], kind="stable").tolist():
                if bounds[i, b] < at_least:
                    break
                a = self.starts[b]
                s = self.weights[a : a + BLOCK] @ queries[i]
                good = (s >= at_least) & (self.ids[a : a + BLOCK] != query_ids[i])
                if good.any():
                    places, scores = np.concatenate([places, a + np.flatnonzero(good)]), np.concatenate([scores, s[good]])
                    if len(places) >= k:
                        best = np.lexsort((self.ids[places], -scores))[:k]
                        places, scores = places[best], scores[best]
                        at_least = max(at_least, int(scores[-1]))
            out += [(int(query_ids[i]), int(self.ids[p]), int(s), int(self.copies[p]), i) for p, s in zip(places, scores)]
        return out


FOUND = "query_id long, vec_id long, score long, copies long"
PACKED = "part int, size int, ids binary, weights binary, floors binary, copies binary"


def packed(rows: DataFrame, ordered: bool) -> DataFrame:
    """A row for each part and vector length of rows (part, size, id, weights, floor, copies): their ids, weights, floors and copies end to end."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id", ignore_index=True)
        ids, weights = df["id"].to_numpy(np.int64), np.stack(df["weights"].to_list()).astype(np.int64)
        order = Shard.order(ids, weights) if ordered else np.arange(len(ids))
        blobs = (ids[order], weights[order], df["floor"].to_numpy(np.int64)[order], df["copies"].to_numpy(np.int64)[order])
        return pd.DataFrame([(df["part"].iloc[0], df["size"].iloc[0], *[x.tobytes() for x in blobs])], columns=["part", "size", "ids", "weights", "floors", "copies"])

    return rows.groupBy("part", "size").applyInPandas(one, PACKED)


def search_shards(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best k of each shard for each query; both sides are packed, and few chunks of queries are given at once, to be broadcast."""
    asked = queries.select("size", F.col("ids").alias("query_ids"), F.col("weights").alias("query_weights"), "floors", F.col("copies").alias("query_copies"))
    pairs = index.select("size", "ids", "weights", "copies").join(F.broadcast(asked), "size")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples(index=False):
                shard = Shard(np.frombuffer(r.ids, np.int64), np.frombuffer(r.weights, np.int64).reshape(-1, r.size), np.frombuffer(r.copies, np.int64))
                found = shard.search(np.frombuffer(r.query_ids, np.int64), np.frombuffer(r.query_weights, np.int64).reshape(-1, r.size), np.frombuffer(r.floors, np.int64), k)
                found = pd.DataFrame(found, columns=["query_id", "vec_id", "score", "copies", "query"]).astype("int64")
                yield found.assign(copies=found["copies"] * np.frombuffer(r.query_copies, np.int64)[found["query"]]).drop(columns="query")

    return pairs.mapInPandas(work, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    each = found.select("query_id", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int"))))
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (id, weights) that is_query picks, the k best of all rows of other ids."""
    # a row that occurs k times fills a query's places
    some = F.least(F.count("*"), F.lit(k)).alias("copies")
    rows = stash(rows.where(F.size("weights") > 0).groupBy("id", "weights").agg(some), "vectors")
    queries = stash(rows.where(is_query), "queries")
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(1))).first()
    m = queries.count()
    shards, chunks = parts_of(n, SHARD, SHARD_BYTES, longest), parts_of(m, CHUNK, CHUNK_BYTES, longest)
    at_once = max(1, AT_ONCE_BYTES * chunks // (8 * longest * max(1, m)))
    size, low = F.size("weights").alias("size"), F.lit(-(1 << 62)).cast("long")
    part = lambda seed, many: F.pmod(F.xxhash64("id", "weights", F.lit(seed)), F.lit(many)).cast("int").alias("part")
    index = stash(packed(rows.select(part(1, shards), size, "id", "weights", F.lit(0).cast("long").alias("floor"), "copies"), True), "index")

    def asked(floors: DataFrame | None) -> DataFrame:
        own = queries.withColumn("floor", low) if floors is None else queries.join(floors, F.col("id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("floor", low))
        return stash(packed(own.select(part(2, chunks), size, "id", "weights", "floor", "copies"), False), "chunks")

    def found(index: DataFrame, asked: DataFrame) -> DataFrame:
        some = [search_shards(index, asked.where(F.col("part").between(c, c + at_once - 1)), k) for c in range(0, chunks, at_once)]
        return reduce(DataFrame.unionByName, [stash(x, "found") for x in some])

    pilot = found(index.where("part = 0"), asked(None))
    if shards > 1:
        # the k-th score of one shard alone: a query may meet it in rows of several lengths, or twice, never too high
        floors = pilot.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(low).alias("floor"))
        pilot = pilot.unionByName(found(index.where("part > 0"), asked(floors)))
    return best(pilot, k).select("query_id", "rank", "vec_id", "score")

"""Hard negatives of anchors by one-bit codes that bound every score, exact in what they return.

A vector, less the mean of its shard, is turned by a fixed rotation (signs and Hadamard transforms, which keep
lengths and inner products) and coded by the signs of its components. Beside the code stands its alignment, the
inner product of vector and code, and the length of what the code leaves over. What is left over is coded in
the same way, LEVELS times in all.

A query is turned too and its components are cut to eight bits, so that its inner product with a code comes from
counts of common bits. Times the alignments, and summed, that estimates a score. How far off it can be is certain:
what the last code leaves over stands at a right angle to the code, so by Cauchy and Schwarz it adds no more than its
length times the length of the query's part at a right angle to the code; what cutting the query adds is bounded
by the sum of what was cut off. Only vectors whose interval can reach a query's list are scored, in integers.

1. *Positives*: the best of an anchor's label. The k-th largest lower bound of a shard's rows of that label is a limit
   below which no upper bound counts.
2. *Negatives*: for each positive score, the best of the rows of other labels between two shares of it. A limit is
   taken from rows whose whole interval lies inside.

Vectors are dealt by hash to shards of bounded size, which stay where they are; anchors are packed into chunks of
bounded size and broadcast past the shards, as many at once as AT_ONCE_BYTES hold; each shard returns its best for
each list, and the lists of all shards are ranked in the end.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Repeated rows are candidates
as often as they occur (they travel once, with a number), and a repeated anchor has its rows as often; rows with
the anchor's own id are never its candidates. Ties in score go to the smaller id. Vectors of different lengths
don't meet. An empty table gives no rows; extra columns are ignored, whatever their names. Scores are 64-bit
integers; components so large that a sum of products leaves 64 bits are not meant for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import stash
from tracewright.llm.topk_search import AT_ONCE_BYTES, CHUNK, CHUNK_BYTES, SHARD, SHARD_BYTES, parts_of

#: Codes of a vector, one of what the other leaves over; bits of a query's component; queries that meet a shard at a time.
LEVELS, BITS, TOGETHER = 4, 8, 64
#: No score, in a list of scores.
NONE = np.iinfo(np.int64).min


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned, with zeros up to a power of two of 64 or more components."""
    n = max(64, 1 << (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng(n).choice([-1.0, 1.0], (2, n))
    for s in signs:
        out *= s
        half = 1
        while half < n:
            v = out.reshape(len(x), n // (2 * half), 2, half)
            out = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], 2).reshape(len(x), n)
            half *= 2
        out /= np.sqrt(n)
    return out


def bits_of(on: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """The codes of a shard's vectors: bits, alignments and lengths left over, by level."""

    def __init__(self, weights: np.ndarray):
        w = weights.astype(np.float64)
        self.mean = w.mean(0)
        rest = rotated(w - self.mean)
        self.n = rest.shape[1]
        self.reach = np.sqrt((rest * rest).sum(1)) + np.sqrt((self.mean**2).sum())
        self.bits, self.along, self.left = [], [], []
        for _ in range(LEVELS):
            on = rest >= 0
            along = np.abs(rest).sum(1) / np.sqrt(self.n)
            rest = rest - np.where(on, 1.0, -1.0) * (along / np.sqrt(self.n))[:, None]
            self.bits.append(bits_of(on))
            self.along.append(along)
            self.left.append(np.sqrt((rest * rest).sum(1)))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each query (row) with each vector (column)."""
        q = queries.astype(np.float64)
        u = rotated(q)
        low = u.min(1, keepdims=True)
        step = np.maximum((u.max(1, keepdims=True) - low) / (2**BITS - 1), np.finfo(float).tiny)
        cut = np.rint((u - low) / step)
        lost = np.abs(u - (low + step * cut)).sum(1) / np.sqrt(self.n)
        planes = [bits_of((cut.astype(np.int64) >> j) & 1 == 1) for j in range(BITS)]
        length = np.sqrt((u * u).sum(1))
        score = (q @ self.mean)[:, None] + np.zeros(len(self.reach))
        off = 1e-9 * length[:, None] * self.reach + 0.5
        for bits, along in zip(self.bits, self.along):
            ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
            common = sum((np.bitwise_count(p[:, None, :] & bits).sum(2, dtype=np.int64) << j for j, p in enumerate(planes)), np.zeros((len(q), len(bits)), np.int64))
            at = (low * (2 * ones - self.n) + step * (2 * common - cut.sum(1, keepdims=True))) / np.sqrt(self.n)
            score += along * at
            off += along * lost[:, None]
        aside = np.sqrt(np.maximum(length[:, None] ** 2 - np.maximum(np.abs(at) - lost[:, None], 0) ** 2, 0))
        off += self.left[-1] * aside
        return score - off, score + off


def limit_of(low: np.ndarray, k: int) -> float:
    """The k-th largest of some lower bounds."""
    return np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf


Rows = tuple[np.ndarray, np.ndarray]


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Shard:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, copies: np.ndarray, weights: np.ndarray):
        self.ids, self.labels, self.copies, self.weights = ids, labels, copies, weights
        self.codes = Codes(weights)
        self.scored = 0

    def score(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        self.scored += len(places)
        return self.weights[places] @ query

    def positives(self, query: np.ndarray, open_: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(0, places, scores) of the best k of the rows that are open."""
        places = np.flatnonzero(open_ & (high >= limit_of(low[open_], k)))
        scores = self.score(places, query)
        best = best_of(self.ids[places], scores, k)
        return [(0, places[best], scores[best])]

    def negatives(self, query: np.ndarray, open_: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, ranges: list[tuple[int, int, int]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(key, places, scores) of the best k of the open rows within each range (key, least, most)."""
        near = np.zeros(len(low), bool)
        for _, least, most in ranges:
            inside = open_ & (low >= least) & (high <= most)
            near |= open_ & (low <= most) & (high >= max(least, limit_of(low[inside], k)))
        places = np.flatnonzero(near)
        scores = self.score(places, query)
        out = []
        for key, least, most in ranges:
            own = (scores >= least) & (scores <= most)
            best = best_of(self.ids[places[own]], scores[own], k)
            out.append((key, places[own][best], scores[own][best]))
        return out


SHARDS = "size int, ids binary, labels binary, copies binary, weights binary"
CHUNKS = "part int, size int, keys binary, query_ids binary, query_labels binary, query_weights binary, wanted binary"
FOUND = "key long, of long, vec_id long, score long, copies long"


def shards_of(rows: DataFrame) -> DataFrame:
    """rows (part, id, label, copies, weights): a row for each part and length, end to end."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        blob = lambda c: df[c].to_numpy(np.int64).tobytes()
        weights = np.stack(df["weights"].to_list()).astype(np.int64)
        return pd.DataFrame([(weights.shape[1], blob("id"), blob("label"), blob("copies"), weights.tobytes())], columns=["size", "ids", "labels", "copies", "weights"])

    return rows.groupBy("part", F.size("weights")).applyInPandas(one, SHARDS)


def chunks_of(anchors: DataFrame, k: int) -> DataFrame:
    """anchors (part, key, id, label, weights, wanted: scores, k at most): a row for each part and length, end to end."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        blob = lambda c: df[c].to_numpy(np.int64).tobytes()
        weights = np.stack(df["weights"].to_list()).astype(np.int64)
        wanted = np.full((len(df), k), NONE)
        for i, w in enumerate(df["wanted"]):
            wanted[i, : len(w)] = w
        return pd.DataFrame([(df["part"].iloc[0], weights.shape[1], blob("key"), blob("id"), blob("label"), weights.tobytes(), wanted.tobytes())], columns=CHUNKS.replace(",", "").split()[::2])

    return anchors.groupBy("part", F.size("weights")).applyInPandas(one, CHUNKS)


def search(shards: DataFrame, chunks: DataFrame, n_chunks: int, at_once: int, k: int, share: tuple[int, int] | None) -> DataFrame:
    """key, of, vec_id, score, copies of each shard's best: positives (of: 0), or where a share is given negatives for each wanted score (of)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for r in df.itertuples(index=False):
                read = lambda x: np.frombuffer(x, np.int64)
                shard = Shard(read(r.ids), read(r.labels), read(r.copies), read(r.weights).reshape(-1, r.size))
                keys, ids, labels, wanted = read(r.keys), read(r.query_ids), read(r.query_labels), read(r.wanted).reshape(-1, k)
                queries = read(r.query_weights).reshape(-1, r.size)
                rows = []
                for begin in range(0, len(keys), TOGETHER):
                    low, high = shard.codes.bounds(queries[begin : begin + TOGETHER])
                    for i, (lo, hi) in enumerate(zip(low, high), begin):
                        others = shard.ids != ids[i]
                        if share is None:
                            lists = shard.positives(queries[i], others & (shard.labels == labels[i]), lo, hi, k)
                        else:
                            ranges = [(p, -(-share[0] * p // 100), share[1] * p // 100) for p in wanted[i].tolist() if p != NONE]
                            lists = shard.negatives(queries[i], others & (shard.labels != labels[i]), lo, hi, k, ranges)
                        for of, places, scores in lists:
                            rows += [(keys[i], of, a, s, c) for a, s, c in zip(shard.ids[places], scores, shard.copies[places])]
                yield pd.DataFrame(rows, columns=["key", "of", "vec_id", "score", "copies"]).astype("int64")

    some = [chunks.where(F.col("part").between(c, c + at_once - 1)).drop("part") for c in range(0, n_chunks, at_once)]
    return reduce(DataFrame.unionByName, [stash(shards.join(F.broadcast(c), "size").mapInPandas(work, FOUND), "found") for c in some])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each key and list, repeated rows as often as they occur, with their rank."""
    each = found.select("key", "of", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int"))).alias("copy"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("key", "of").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, k: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label, weights. For each row that is_anchor picks and each of its k best rows of the same label (positives),
    the k best rows of other labels whose score is between two shares (in percent) of the positive's.
    """
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("weights") > 0)).select("id", F.col("label").cast("long").alias("label"), "weights")
    rows = stash(rows.groupBy("id", "label", "weights").agg(F.count("*").alias("copies")), "vectors")
    anchors = stash(rows.where(is_anchor).withColumn("key", F.monotonically_increasing_id()), "anchors")
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(1))).first()
    m = anchors.count()
    n_shards, n_chunks = parts_of(n, SHARD, SHARD_BYTES, longest), parts_of(m, CHUNK, CHUNK_BYTES, longest)
    at_once = max(1, AT_ONCE_BYTES * n_chunks // (8 * longest * max(1, m)))
    part: Callable[[str, int], Column] = lambda c, many: F.pmod(F.xxhash64(c, "weights"), F.lit(many)).cast("int").alias("part")
    shards = stash(shards_of(rows.select(part("id", n_shards), "id", "label", "copies", "weights")), "shards")
    asking = anchors.select(part("key", n_chunks), "key", "id", "label", "weights")
    none = F.array().cast("array<bigint>").alias("wanted")
    first = search(shards, stash(chunks_of(asking.select("*", none), k), "chunks"), n_chunks, at_once, k, None)
    positives = stash(ranked(first, k).select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth")), "positives")
    wanted = positives.groupBy("key").agg(F.array_sort(F.collect_set("positive_score")).alias("wanted"))
    second = search(shards, stash(chunks_of(asking.join(wanted, "key"), k), "chunks"), n_chunks, at_once, k, share)
    negatives = ranked(second, k).select("key", F.col("of").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.join(negatives, ["key", "positive_score"]).join(anchors.select("key", F.col("id").alias("anchor_id"), "copies"), "key")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

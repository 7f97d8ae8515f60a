"""Best-fit packing of token pieces with certified bin counts.

``cut`` encodes documents and cuts those longer than the capacity. ``pack`` deals the pieces below
capacity to partitions of bounded size, packs each by best-fit decreasing and compares its bins with
the best dual-feasible-function lower bound of its lengths. A partition that meets its bound is
certified: no packing of its pieces needs fewer sequences. Partitions with a gap, and the emptiest
sequence of every other one, exchange their documents: these are dealt anew and packed again, and the
new packing counts if it needs fewer sequences. Rounds end when the bound of all lengths together is
met or an exchange gains nothing; as each one before takes fewer sequences, they do end.

Null text is an empty document (its end id alone); repeated rows are packed each for itself; pieces alike
in length go in the order of a number that each row gets; null ids and extra columns are harmless (only
doc_id and text are read); an empty table gives no rows. A very long text is encoded by one task, in
memory of a few times its size.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import stash
from tracewright.llm.encoding import encoder
from tracewright.llm.shingles import batches_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, part int, bin int, offset long, fill int, bins int, bound int"


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False, bytes_most: int = 8_000_000) -> DataFrame:
    """Pieces of each document's ids and end id; all but a document's last are as long as the capacity. bytes_most: text that is encoded at once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches_of(batches, 1, bytes_most):
            rows = []
            for doc, data in zip(b.column(0).to_pylist(), codec.encode(b.column(1))):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    ids = data[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(ids) // 4, zlib.crc32(ids), *([np.frombuffer(ids, "<u4").tolist()] if with_ids else ())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECES + ", ids array<long>" * with_ids)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Least number of bins for counts[x] items of each length x, by three families of dual-feasible functions."""
    x = np.arange(capacity + 1, dtype=np.int64)
    total = int((counts * x).sum())
    best = -(-total // capacity)
    if not total:
        return 0
    number, length = np.cumsum(counts), np.cumsum(counts * x)
    # U(e): lengths over capacity - e count as a whole bin, those below e as nothing
    e = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - e]
    middle = length[capacity - e] - length[e - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    # u(k): x rounds down to a multiple of 1 / k where x * (k + 1) isn't a whole number of bins
    for k in range(1, 41):
        f = np.where((x * (k + 1)) % capacity == 0, x * k, (x * (k + 1)) // capacity * capacity)
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    # phi(e): those over half a bin count by what they leave free
    for e in np.unique(np.flatnonzero(counts[: capacity // 2 + 1]))[::-1][:64]:
        if e:
            c = capacity // e
            f = np.where(2 * x > capacity, c - (capacity - x) // e, np.where(x >= e, 1, 0))
            best = max(best, -(-int((counts * f).sum()) // int(c)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (taken in decreasing order), and the fill of each bin.

    A bit set of the free room in open bins gives the tightest bin by one shift, whatever their number.
    """
    at, offset = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill, rooms = [], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        at[i], offset[i] = b, fill[b]
        fill[b] += n
        room -= n
        open_bins[room].append(b)
        rooms |= 1 << room
    return at, offset, np.array(fill, np.int32)


def pack_parts(pieces: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Deals pieces (uid, ...) to parts and packs each; every row tells its partition's bins and bound."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("uid", ignore_index=True)
        lengths = df["length"].to_numpy()
        at, offset, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        return df.assign(bin=at, offset=offset, fill=fill[at], bins=len(fill), bound=bound)

    dealt = pieces.select(*PIECES_KEPT, F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(parts)).cast("int").alias("part"))
    return dealt.groupBy("part").applyInPandas(one, PACKED)


PIECES_KEPT = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_part: int = 8192) -> DataFrame:
    """Sequence and offset of each piece (doc_id, piece, start, length, ids_crc32; lengths 1 to capacity)."""
    pieces = stash(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -F.col("uid") - 1, "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    # one row per length below capacity: bounded by the capacity
    counts = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("length").count().collect():
        counts[r[0]] = r[1]
    bound, n = lower_bound(counts, capacity), int(counts.sum())
    done: list[DataFrame] = []
    if n:
        shape = lambda n: max(1, -(-n // rows_per_part))
        now = stash(pack_parts(rest, shape(n), 0, capacity), "packed")
        settled = 0
        for k in itertools.count():
            now = now.withColumn("sequence_id", (F.lit(k).cast("long") * (1 << 24) + F.col("part")) * (1 << 24) + F.col("bin"))
            per_bin = now.groupBy("part", "bin", "bins", "bound").agg(F.max("fill").alias("fill"))
            emptiest = per_bin.groupBy("part").agg(F.min_by(F.struct("bin", "fill"), F.struct("fill", "bin")).alias("least"), F.max("bins").alias("n"), (F.max("bins") > F.max("bound")).alias("gap"))
            used = emptiest.agg(F.sum("n"), F.count("*")).first()
            if used[0] + settled <= bound or used[1] == 1:
                break
            to = emptiest.select("part", "gap", F.col("least.bin").alias("least"))
            marked = now.join(to, "part").withColumn("moves", F.col("gap") | (F.col("bin") == F.col("least")))
            moving = marked.where("moves")
            old = moving.agg(F.count("*"), F.count_distinct("sequence_id")).first()
            again = stash(pack_parts(moving, shape(old[0]), k + 1, capacity), "packed")
            new = again.groupBy("part").agg(F.max("bins").alias("n")).agg(F.sum("n")).first()[0]
            if new >= old[1]:
                break
            done.append(marked.where(~F.col("moves")).drop("gap", "least", "moves"))
            settled += used[0] - old[1]
            now = again
        done.append(now)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = full.select(columns)
    for x in done:
        out = out.unionByName(x.select(columns))
    return out

"""Near duplicates among embeddings by product quantisation, exact in what it links.

Vectors that are equal form a class; from there on a class stands for its rows. Classes are dealt to inverted
lists by their nearest coarse centroid. A list keeps, for each of its vectors, the codes of the residual
(the vector less its centroid) in every subspace, and how far the coded vector is from the true one.

* *Sufficient probes.* A vector looks into a list only if one of the list's vectors can be close enough: its
  distance from the bisector between its own centroid and the list's must not exceed the distance that the least
  cosine means, nor may its distance from the centroid by more than that exceed the list's radius. Lists that
  don't pass hold no partner, so nothing is lost. A pair of lists is looked into from one side.
* *Table lookup.* Within a list, squared distances from the vector itself to all coded vectors are sums of table
  entries, one for each subspace. By the triangle inequality a pair can only be close enough if that distance
  exceeds the limit by no more than the coded vector's own error: all others are passed over.
* *Rerank.* What remains is compared by its cosine in double precision.

The centroids and codebooks are fitted on a bounded sample (SAMPLE vectors, the first by hash, of the most
frequent length); every vector is indexed. They decide how much is looked at, never what is found. Lists are
cut into blocks of BLOCK vectors, and blocks meet blocks, so a hot list is spread over tasks. Blocks stay where they
are: a run of them (CHUNK_BYTES) at a time is broadcast past all, so what is written grows with the vectors, where
sending each vector to the lists it probes would grow with their square. A pair of blocks gives each vector's number
of links and at most one edge for a vector, not pairs: a large group of near copies makes no quadratic output.

Null vectors, those with a null or non-finite component and those of length zero link with nothing; vectors
of different lengths link with nothing (lengths other than the most frequent have one list each, without codes);
repeated rows and equal vectors link with each other; null ids take part, and a component's id is its
smallest non-null one; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import sized, stash
from tracewright.llm.ngram_join import components

#: Vectors that centroids and codebooks are fitted on, and bytes of them at most.
SAMPLE, SAMPLE_BYTES = 16_384, 32_000_000
#: Vectors of a block (and bytes, about, at most), vectors that a list should have, and lists at most.
BLOCK, BLOCK_BYTES, LIST, LISTS = 1024, 2 << 20, 1024, 4096
#: Bytes of blocks that are broadcast at a time, about.
CHUNK_BYTES = 32 << 20
#: Subspaces, codewords of each, and what is allowed for rounding in distances of unit vectors.
SUBSPACES, WORDS, SLACK = 16, 256, 1e-3

CODED = "cls long, copies long, size int, list int, far double, vector binary, codes binary, error double"
FOUND = "kind int, a long, b long"


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids of x (k rows at most), from evenly spread first ones."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)[0]
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row of x, and the distance."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    near = d.argmin(1)
    return near, np.sqrt(np.maximum(((x - centres[near]) ** 2).sum(1), 0))


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows by powers of two, which changes no cosine, so that squares neither overflow nor vanish."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


@dataclass
class Model:
    """Centroids, and codebooks of residuals by subspace, for vectors of one length; others have one list and no codes."""

    size: int
    centres: np.ndarray
    parts: list[np.ndarray]
    books: list[np.ndarray]

    @staticmethod
    def fit(units: np.ndarray, n: int) -> Model:
        """units: a sample of n vectors, of unit length."""
        size = units.shape[1]
        centres = k_means(units, int(np.clip(n // LIST, 1, min(LISTS, max(1, len(units) // 4)))))
        rest = units - centres[nearest(units, centres)[0]]
        parts = np.array_split(np.arange(size), min(SUBSPACES, size))
        return Model(size, centres, parts, [k_means(rest[:, p], min(WORDS, len(rest))) for p in parts])

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector: list, distance from its centroid, codes, and distance of the coded vector."""
        if units.shape[1] != self.size:
            return np.zeros(len(units), int), np.zeros(len(units)), np.zeros((len(units), 0), np.uint8), np.zeros(len(units))
        home, far = nearest(units, self.centres)
        rest = units - self.centres[home]
        codes = np.stack([nearest(rest[:, p], b)[0] for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return home, far, codes, np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, units: np.ndarray, home: np.ndarray, radius: np.ndarray, limit: float) -> np.ndarray:
        """Whether each vector has to look into each list."""
        to = np.sqrt(np.maximum((units * units).sum(1)[:, None] - 2 * units @ self.centres.T + (self.centres**2).sum(1), 0))
        own = to[np.arange(len(units)), home][:, None]
        apart = np.sqrt(np.maximum((self.centres**2).sum(1)[:, None] - 2 * self.centres @ self.centres.T + (self.centres**2).sum(1), 0))[home]
        # a distance from the plane between two centroids, by which a vector beyond it is further away at least
        beyond = to**2 - own**2 <= 2 * apart * (limit + SLACK) + SLACK
        return beyond & (to <= radius + limit + SLACK) & (radius >= 0)

    def hopeful(self, units: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray, limit: float) -> np.ndarray:
        """Whether each vector (column) can be within the limit of each coded vector (row) of list at."""
        if units.shape[1] != self.size:
            return np.ones((len(error), len(units)), bool)
        rest = (units - self.centres[at]).astype(np.float32)
        total = np.zeros((len(error), len(units)), np.float32)
        for m, (p, book) in enumerate(zip(self.parts, self.books)):
            book = book.astype(np.float32)
            x = rest[:, p]
            table = (book * book).sum(1)[:, None] - 2 * book @ x.T + (x * x).sum(1)
            total += table[codes[:, m]]
        return total <= (((limit + SLACK + error) ** 2) + SLACK)[:, None]


def links_of(mine: np.ndarray, theirs: np.ndarray, hopeful: np.ndarray, least: float) -> np.ndarray:
    """hopeful (rows: theirs, columns: mine) without pairs whose cosine is below least."""
    step = max(1, (4 << 20) // mine.shape[1])
    out = np.zeros_like(hopeful)
    norm = lambda x: np.sqrt((x * x).sum(1))
    a, b = norm(theirs), norm(mine)
    y, x = np.nonzero(hopeful)
    for i in range(0, len(y), step):
        r, c = y[i : i + step], x[i : i + step]
        out[r, c] = np.einsum("ij,ij->i", theirs[r], mine[c]) / (a[r] * b[c]) >= least
    return out


def spanning(link: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links (rows x columns) join, one for a row or column at most."""
    far = np.iinfo(np.int64).max
    of_row, of_column = rows.copy(), columns.copy()
    some_row, some_column = link.any(1), link.any(0)
    while True:
        low_row = np.minimum(of_row, np.where(link, of_column[None, :], far).min(1)) if link.size else of_row
        low_column = np.minimum(of_column, np.where(link, low_row[:, None], far).min(0)) if link.size else of_column
        if (low_row == of_row).all() and (low_column == of_column).all():
            break
        of_row, of_column = low_row, low_column
    edges = [*zip(rows[some_row].tolist(), of_row[some_row].tolist()), *zip(columns[some_column].tolist(), of_column[some_column].tolist())]
    return [(a, b) for a, b in set(edges) if a != b]


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, vector (null where it can't link)."""
    x = F.col(vector).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.when(fine, x).alias("vector"))


def coded(classes: DataFrame, model: Model) -> DataFrame:
    """Each class with its list, codes and errors; model is small by its bounds."""
    shared = classes.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for size, some in df.groupby(df["vector"].map(len), sort=False):
                raw = scaled(np.stack(some["vector"].to_list()).astype(np.float64))
                home, far, codes, error = shared.value.encode(raw / np.sqrt((raw * raw).sum(1))[:, None])
                yield pd.DataFrame({"cls": some["cls"].to_numpy(), "copies": some["copies"].to_numpy(), "size": size, "list": home, "far": far, "vector": [x.tobytes() for x in raw], "codes": [x.tobytes() for x in codes], "error": error})

    return classes.mapInPandas(work, CODED)


def pack(df: pd.DataFrame, extra: dict[str, object]) -> pd.DataFrame:
    cls = df["cls"].to_numpy(np.int64)
    blob = lambda c: b"".join(df[c])
    return pd.DataFrame([{**extra, "ids": cls.tobytes(), "copies": df["copies"].to_numpy(np.int64).tobytes(), "vectors": blob("vector"), "codes": blob("codes"), "errors": df["error"].to_numpy(np.float64).tobytes()}])


PACKED = "size int, list int, part int, blocks int, ids binary, copies binary, vectors binary, codes binary, errors binary"


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of the lists: rows have size, list, part and, of their list, blocks."""

    def one(df: pd.DataFrame) -> pd.DataFrame:
        return pack(df.sort_values("cls"), {c: df[c].iloc[0] for c in ("size", "list", "part", "blocks")})

    return rows.groupBy("size", "list", "part").applyInPandas(one, PACKED)


def runs_of(blocks: DataFrame) -> list[list[tuple[int, int, int]]]:
    """Keys (size, list, part) of the blocks in order, in runs of CHUNK_BYTES at most, or of one block. There is a key for some BLOCK vectors."""
    weight = sum((F.octet_length(c) for c in ("ids", "copies", "vectors", "codes", "errors")), F.lit(0))
    out, room = [], 0
    for *key, n in blocks.select("size", "list", "part", weight).orderBy("size", "list", "part").collect():
        if not out or n > room:
            out.append([])
            room = CHUNK_BYTES
        out[-1].append(tuple(key))
        room -= n
    return out


def found(blocks: DataFrame, run: list[tuple[int, int, int]], radii: dict[int, float], model: Model, least: float, limit: float) -> DataFrame:
    """kind 0: a class (a) and its number of links (b); kind 1: an edge of a spanning forest. What vectors of the blocks find in a run of blocks, which is broadcast.

    radii: of each list of the model's length, at most LISTS. A block looks into itself and those that come after it, so each pair of blocks meets once.
    """
    at = F.struct("size", "list", "part")
    key = lambda k: F.struct(*[F.lit(x).cast("int").alias(c) for c, x in zip(("size", "list", "part"), k)])
    theirs = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in blocks.where((at >= key(run[0])) & (at <= key(run[-1]))).select("size", "list", "part", "ids", "copies", "vectors", "codes", "errors").orderBy("size", "list", "part").collect()]
    shared = blocks.sparkSession.sparkContext.broadcast((model, radii, theirs))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, radii, theirs = shared.value
        radius = np.array([radii.get(k, -1.0) for k in range(len(model.centres))])
        for df in batches:
            for r in df.itertuples(index=False):
                all_ids, all_copies, raw = np.frombuffer(r.ids, np.int64), np.frombuffer(r.copies, np.int64), np.frombuffer(r.vectors).reshape(-1, r.size)
                all_units = raw / np.sqrt((raw * raw).sum(1))[:, None]
                if r.size == model.size:
                    need = model.probes(all_units, np.full(len(raw), r.list), radius, limit)
                    need[:, r.list] = True
                else:
                    need = np.ones((len(raw), 1), bool)
                for size, k, part, ids, copies, vectors, codes, errors in theirs:
                    if size != r.size or (k, part) < (r.list, r.part) or not need[:, k].any():
                        continue
                    some = need[:, k]
                    x_ids, x_copies, x, units = all_ids[some], all_copies[some], raw[some], all_units[some]
                    y_ids, y = np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, size)
                    hopeful = model.hopeful(units, k, np.frombuffer(codes, np.uint8).reshape(len(y), -1), np.frombuffer(errors), limit)
                    if (k, part) == (r.list, r.part):
                        hopeful &= y_ids[:, None] > x_ids[None, :]
                    link = links_of(x, y, hopeful, least)
                    if not link.any():
                        continue
                    to_x, to_y = link.T @ np.frombuffer(copies, np.int64), link @ x_copies
                    rows = [(0, a, n) for a, n in zip(x_ids.tolist(), to_x.tolist()) if n] + [(0, a, n) for a, n in zip(y_ids.tolist(), to_y.tolist()) if n]
                    rows += [(1, a, b) for a, b in spanning(link, y_ids, x_ids)]
                    yield pd.DataFrame(rows, columns=["kind", "a", "b"])

    out = stash(blocks.where(at <= key(run[-1])).select("size", "list", "part", "ids", "copies", "vectors").mapInPandas(work, FOUND), "links")
    shared.destroy()
    return out


def near(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row: rows link whose vectors have a cosine of least or more."""
    spark = vectors.sparkSession
    rows = stash(usable(vectors, id_column, vector), "vectors")
    classes = rows.where("vector is not null").groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = stash(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    lengths = classes.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size, n = lengths or (1, 0)
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    sample = classes.where(F.size("vector") == size).orderBy(F.xxhash64("vector"), "cls").limit(most).select("vector").toPandas()["vector"]
    raw = scaled(np.stack(sample.to_list()).astype(np.float64)) if len(sample) else np.ones((1, size))
    model = Model.fit(raw / np.sqrt((raw * raw).sum(1))[:, None], n)
    index = stash(coded(classes.select("cls", "copies", "vector"), model), "codes")
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size")))))
    figures = stash(index.groupBy("size", "list").agg(F.ceil(F.count("*") / F.max(block)).cast("int").alias("blocks"), F.max("far").alias("radius")), "lists")
    radii = {r["list"]: r["radius"] for r in figures.where(F.col("size") == size).collect()}
    part = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("part")
    blocks = blocks_of(index.join(sized(figures), ["size", "list"]).select(*index.columns, part, "blocks"))
    # each block is read again for each run, so they are dealt out once
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stash(blocks.repartition(parts, F.xxhash64("list", "part", "size")), "blocks")
    limit = float(np.sqrt(max(0.0, 2 - 2 * least)))
    met = [found(blocks, run, radii, model, least, limit) for run in runs_of(blocks)]
    pairs = spark.read.schema(met[0].schema).parquet(*[df._stash_path for df in met]) if met else spark.createDataFrame([], FOUND)
    links = pairs.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("links"))
    groups = components(pairs.where("kind = 1").select(F.col("a").alias("x"), F.col("b").alias("y")))
    groups = groups.select(F.col("sig").alias("cls"), "comp")
    named = classes.select("cls", "vector", "first", "copies").join(links, "cls", "left").join(groups, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "comp").select(F.col("vector").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("vector is not null").join(named, F.col("vector") == F.col("of")).select("id", "n_links", "component_id")
    alone = rows.where("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))

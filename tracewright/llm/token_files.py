"""Token ids as Arrow files of fixed-size lists.

``write`` range-partitions documents by id, encodes each partition in id order and writes one Arrow
file per partition: record batches of equal numbers of sequences, each a fixed-size list of ``seq_len``
ids beside a fixed-size list of mask bytes, eight places each, the first in the lowest bit (0: padding after the partition's
last id, else 1; ``SequenceFile.places`` unpacks them). Batches are uncompressed, so a memory map gives any sequence and its mask without copying. The index, a Parquet table,
has a row per document: file, place of its first id in that file, number of ids.

A file's name holds the task attempt, and the index names the files of committed attempts only; what
lost or speculative attempts leave behind is never read.

Null text is an empty document (its end id alone); null ids sort first; repeated rows are documents of
their own, and rows of one id stand in any order; other columns of the input are ignored, whatever their
names; an empty table gives an empty index. A very long text is encoded by one task, in memory of a few
times its size; it is written in record batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import scratch
from tracewright.llm.encoding import encoder, largest_id
from tracewright.llm.shingles import batches_of

INDEX = "part int, file string, doc_id long, local_start long, n_tokens long"
#: Sequences in a record batch; all batches of a file but the last have as many.
BATCH_ROWS = 256


def schema(seq_len: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), seq_len)), ("mask", pa.list_(pa.uint8(), -(-seq_len // 8)))])


def qualified(spark: SparkSession, path: str) -> str:
    """path as a URI of the file system that Spark would write it to, so that all executors mean the same place."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = system.makeQualified(jvm_path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


class SequenceWriter:
    """Appends ids to one Arrow file; memory holds one record batch."""

    def __init__(self, uri: str, seq_len: int, wide: bool):
        from pyarrow import fs

        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.seq_len, self.schema = seq_len, schema(seq_len, wide)
        self.room = np.zeros(BATCH_ROWS * seq_len, self.dtype)
        self.used = 0
        system, path = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.sink = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def append(self, ids: np.ndarray) -> None:
        while len(ids):
            n = min(len(ids), len(self.room) - self.used)
            self.room[self.used : self.used + n] = ids[:n]
            self.used += n
            ids = ids[n:]
            if self.used == len(self.room):
                self.flush()

    def flush(self) -> None:
        rows = -(-self.used // self.seq_len)
        if rows:
            self.room[self.used : rows * self.seq_len] = 0
            mask = np.packbits((np.arange(rows * self.seq_len) < self.used).reshape(rows, self.seq_len), axis=1, bitorder="little")
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), n) for v, n in ((self.room[: rows * self.seq_len], self.seq_len), (mask, mask.shape[1]))]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.used = 0

    def close(self) -> None:
        self.flush()
        self.writer.close()
        self.sink.close()


class SequenceFile:
    """Random access to one Arrow file of sequences; local files are memory-mapped and not copied."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)
        self.source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.seq_len = self.reader.schema.field("ids").type.list_size
        self.at, self.flat, self.mask = -1, None, None

    def batch(self, k: int) -> None:
        if k != self.at:
            b = self.reader.get_batch(k)
            self.at, (self.flat, self.mask) = k, (b.column(c).values.to_numpy(zero_copy_only=True) for c in (0, 1))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask (a bit for each place) of sequence i, both views of the file."""
        self.batch(i // BATCH_ROWS)
        here = slice(i % BATCH_ROWS * self.seq_len, (i % BATCH_ROWS + 1) * self.seq_len)
        n = -(-self.seq_len // 8)
        return self.flat[here], self.mask[i % BATCH_ROWS * n : (i % BATCH_ROWS + 1) * n]

    def places(self, mask: np.ndarray) -> np.ndarray:
        """A mask as booleans, one for each place."""
        return np.unpackbits(mask, count=self.seq_len, bitorder="little").astype(bool)

    def span(self, start: int, n: int) -> np.ndarray:
        """The n ids from place start on."""
        per, parts = BATCH_ROWS * self.seq_len, []
        while n > 0:
            self.batch(start // per)
            got = self.flat[start % per : start % per + n]
            parts.append(got)
            start, n = start + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, "<u2")])

    def close(self) -> None:
        self.source.close()


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, seq_len: int = 2048, to: str | None = None, parts: int | None = None) -> DataFrame:
    """Encodes docs (doc_id, text) into Arrow files below ``to`` and returns the index.

    Ids take two bytes where the tokenizer's largest one and the end id allow it. ``parts``: number of range partitions
    (default: spark.sql.shuffle.partitions).
    """
    to = qualified(docs.sparkSession, to or scratch(docs.sparkSession, "token-files"))
    wide = max(largest_id(tokenizer), end_id) > 65_535

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, out = encoder(tokenizer, "<u4" if wide else "<u2"), None
        end, task, at = np.array([end_id], codec.dtype), TaskContext.get(), 0
        part = task.partitionId()
        uri = f"{to}/files/seq-{part:06d}-{task.taskAttemptId()}.arrow"
        for b in batches_of(batches, 1, 8_000_000):
            starts, sizes = [], []
            for data in codec.encode(b.column(1)):
                ids = np.frombuffer(data, codec.dtype)
                out = out or SequenceWriter(uri, seq_len, wide)
                out.append(ids)
                out.append(end)
                starts.append(at)
                sizes.append(len(ids) + 1)
                at += sizes[-1]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([uri] * n, pa.string()), b.column(0).cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                ["part", "file", "doc_id", "local_start", "n_tokens"],
            )
        if out:
            out.close()

    # rows of one id, or of none, go to several files by their texts
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    dealt = rows.repartitionByRange(parts, "doc_id", "hash") if parts else rows.repartitionByRange("doc_id", "hash")
    dealt.sortWithinPartitions("doc_id", "hash").select("doc_id", "text").mapInArrow(encode, INDEX).write.parquet(f"{to}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{to}/index")


def placed(index: DataFrame) -> DataFrame:
    """The index with ``start``: the number of ids of all documents before, over all files.

    Its window runs over one row per file, not over documents.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("ids")).select("part", before.alias("before"))
    return index.join(files, "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before")


def read(index: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads every document's ids back: the index's columns, ids_crc32 and, if asked for, ids."""
    fields = [f for f in index.schema.fields if f.name != "file"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            crc, ids = [], []
            for uri, start, n in zip(*(b.column(c).to_pylist() for c in ("file", "local_start", "n_tokens"))):
                if uri != name:
                    if file:
                        file.close()
                    name, file = uri, SequenceFile(uri)
                got = file.span(start, n).astype("<u4")
                crc.append(zlib.crc32(got.tobytes()))
                ids.append(got.tolist() if with_ids else None)
            cols = [b.column(f.name) for f in fields] + [pa.array(crc, pa.int64())]
            names = [f.name for f in fields] + ["ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return index.repartition("file").sortWithinPartitions("file", "local_start").mapInArrow(load, f"{kinds}, ids_crc32 long" + ", ids array<long>" * with_ids)

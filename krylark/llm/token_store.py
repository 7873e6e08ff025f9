"""Token ids in Arrow stream files: fixed-size-list batches of equal-length sequences with their masks.

Shard k holds a range of ascending ids.  ``tokens-k.arrow`` is an Arrow file of ``seq`` (fixed-size list of
unsigned ids, of 16 bits where the vocabulary fits, else of 32) and ``mask`` (fixed-size list of booleans, false for
the padding at the end of the shard);
``index-k.arrow`` has a row per document.  Row i is at a fixed place, so a memory-mapped file gives any sequence
without a copy.  Files are written under a temporary name in the shared folder and renamed, so a task that runs
twice leaves the same whole file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, map_arrow, shared_dir, small_batches, word_cache

SEQ_LEN = 1024
#: Sequences in an Arrow batch.
BATCH = 256


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Appends ids and writes them as full sequences; holds less than one batch."""

    def __init__(self, sink, seq_len: int, kind=np.uint32):
        self.n, self.kind = seq_len, kind
        self.schema = pa.schema([("seq", pa.list_(pa.from_numpy_dtype(kind), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.zeros(len(ids), bool)
        mask[:real] = True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.n) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.n * BATCH:
            whole = np.concatenate(self.held)
            step = self.n * BATCH
            for at in range(0, len(whole) - step + 1, step):
                self._put(whole[at:at + step], step)
            rest = whole[len(whole) // step * step:].copy()
            self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        if self.size:
            ids = np.concatenate(self.held)
            pad = -len(ids) % self.n
            self._put(np.concatenate([ids, np.zeros(pad, self.kind)]), len(ids))
        self.out.close()


class Published:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)

    def __enter__(self):
        self.sink = self.fs.open_output_stream(self.temp)
        return self.sink

    def __exit__(self, kind, *_):
        self.sink.close()
        if kind is None:
            self.fs.move(self.temp, self.path)
        else:
            self.fs.delete_file(self.temp)


INDEX = pa.schema([("doc", pa.int64()), ("null_doc", pa.bool_()), ("start", pa.int64()), ("n", pa.int64())])


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, keep_space: bool, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, folder: str | None = None) -> list[tuple[int, int, int]]:
    """Writes every document's ids and its end id; returns (shard, documents, tokens) of the shards, in order.

    Documents are dealt by ranges of the id and sorted, so shard by shard the ids ascend (nulls first; rows with
    the same id by a hash of the text).  An empty table gives empty shards; a text of any length is encoded in parts.  Null texts are empty: the end id alone.  ``folder`` is a URI that all executors share.
    What comes back to the driver is one row for each task.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        words = word_cache(tokenizer, keep_space)
        kind = np.uint16 if max(words.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        total = count = 0
        with Published(f"{folder}/tokens-{shard:06d}.arrow") as sink, Published(f"{folder}/index-{shard:06d}.arrow") as side:
            out, index = SequenceWriter(sink, seq_len, kind), pa.ipc.new_file(side, INDEX)
            for b in by_bytes(batches):
                for at, ids, n in words.encode_column(b.column(1), end_id):
                    out.add(ids.astype(kind, copy=False))
                    starts = total + np.cumsum(n) - n
                    doc = b.column(0).slice(at, len(n))
                    index.write_batch(pa.RecordBatch.from_arrays([doc.fill_null(0), doc.is_null(), pa.array(starts), pa.array(n)], schema=INDEX))
                    total, count = total + int(n.sum()), count + len(n)
            out.close()
            index.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([count], pa.int64()), pa.array([total], pa.int64())], names=["shard", "documents", "tokens"])

    df = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    order = ("doc", F.xxhash64("text"))  # rows that share an id are dealt by their texts, so no id is one task's
    df = df.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    with small_batches(spark):
        stats = map_arrow(df, run, "shard int, documents long, tokens long").collect()
    return sorted((r.shard, r.documents, r.tokens) for r in stats)


def open_sequences(uri: str) -> pa.Table:
    """The sequences and masks of a shard; memory-mapped where the file is local."""
    fs, path = open_fs(uri)
    source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
    return pa.ipc.open_file(source).read_all()


def read_documents(spark, folder: str, shards: list[tuple[int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """A row per document, from the files alone: id, global start, ``n_tokens`` and ``ids_crc32``."""
    base, table = 0, []
    for shard, count, tokens in shards:
        if count:
            table.append((shard, base))
        base += tokens
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, path = open_fs(f"{folder}/tokens-{shard:06d}.arrow")
                source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
                chunks = pa.ipc.open_file(source)
                side_fs, side = open_fs(f"{folder}/index-{shard:06d}.arrow")
                index = pa.ipc.open_file(side_fs.open_input_file(side))
                at, loaded, held = 0, 0, np.zeros(0, np.uint16)  # held: ids from place ``at`` on
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    starts, n = part.column(2).to_numpy(), part.column(3).to_numpy()
                    crc = np.empty(len(n), np.int64)
                    for i, (s, m) in enumerate(zip(starts.tolist(), n.tolist())):
                        if s + m > at + len(held):
                            more = [held[s - at:]]
                            at, have = s, len(more[0])
                            while have < m and loaded < chunks.num_record_batches:
                                seq = chunks.get_batch(loaded).column(0)
                                more.append(seq.flatten().to_numpy())
                                have, loaded = have + len(more[-1]), loaded + 1
                            held = np.concatenate(more)
                        crc[i] = zlib.crc32(held[s - at:s - at + m].astype(np.uint32))
                    doc = pa.array(part.column(0).to_numpy(), mask=part.column(1).to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(starts + first), part.column(3), pa.array(crc)], names=schema.names)

    if not table:
        return spark.createDataFrame([], schema)
    df = spark.createDataFrame(table, "shard int, first long").repartition(len(table))
    return map_arrow(df, run, schema)

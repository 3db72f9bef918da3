"""Token-ID output: Arrow IPC files with fixed-size-list batches of equal-length sequences and masks.

Documents are range-partitioned by doc_id; each partition writes one file of sequences and one index of its documents to a
folder that all executors share, so the files in order hold the documents in ascending doc_id order. A file's rows are
``input_ids: fixed_size_list<uint16>`` (uint32 for vocabularies over 65,536 ids) and ``mask: fixed_size_list<bool>`` (false
on the padding that ends a file), whose buffers a memory map exposes without a copy: row k of a batch is the slice
[k*L, (k+1)*L) of its ids and of its mask bits.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written
from .encoding import MEMO, encoder, release

SEQUENCE = 1024
#: Sequences in one record batch of a file.
BATCH = 256


_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


def filesystem(uri: str):
    """pyarrow's file system and the path in it, for file, hdfs, s3(a) and gs URIs; plain paths are local."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class SequenceWriter:
    """Appends id arrays to one sequence file; ``close`` pads the last sequence and writes the footer."""

    def __init__(self, sink, length: int = SEQUENCE, kind: pa.DataType = pa.uint32()):
        self._schema = _schema(length, kind)
        self._out = pa.ipc.new_file(sink, self._schema)
        self._length, self._held, self._n = length, [], 0
        self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self._held.append(ids)
        self._n += len(ids)
        self.written += len(ids)
        if self._n >= self._length * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._held) if self._held else np.empty(0, "<u4")
        size = self._length * BATCH
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._batch(ids[at : at + size], size)
        tail = ids[whole:]
        if last and len(tail):  # the only batch of another size, and the only padding
            self._batch(np.concatenate([tail, np.zeros(-len(tail) % self._length, "<u4")]), len(tail))
            tail = tail[:0]
        self._held, self._n = [tail], len(tail)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        kind = self._schema.field(0).type.value_type
        as_list = lambda a: pa.FixedSizeListArray.from_arrays(a, self._length)
        columns = [as_list(pa.array(ids.astype(kind.to_pandas_dtype()), kind)), as_list(pa.array(np.arange(len(ids)) < real, pa.bool_()))]
        self._out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._schema))

    def close(self) -> None:
        self._flush(True)
        self._out.close()


class SequenceReader:
    """Random access to a sequence file: ``sequence(k)`` and ``ids(start, n)`` are views of the mapped buffers.

    Opening reads the footer and the last batch; all batches before it hold as many sequences as the first.
    """

    def __init__(self, source):
        self._file = pa.ipc.open_file(source)
        self.length = self._file.schema.field("input_ids").type.list_size
        self._n = self._file.num_record_batches
        self._held: dict[int, tuple[np.ndarray, pa.BooleanArray]] = {}
        self._each = self._rows(0)
        self._last = self._rows(self._n - 1)

    def _rows(self, k: int) -> int:
        return len(self._batch(k)[0]) // self.length if 0 <= k < self._n else 0

    def _batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of batch k as views of the file's buffers; one batch is held."""
        if k not in self._held:
            batch = self._file.get_batch(k)
            self._held = {k: (batch.column(0).flatten().to_numpy(), batch.column(1).flatten())}
        return self._held[k]

    def __len__(self) -> int:
        return max(0, self._n - 1) * self._each + self._last

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Sequence k and its mask, both without a copy: the mask is Arrow's bit array."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        ids, mask = self._batch(k // self._each)
        at = k % self._each * self.length
        return ids[at : at + self.length], mask.slice(at, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Real ids [start, start + n) of the file."""
        out = []
        while n > 0:
            if start // self.length >= len(self):
                raise ValueError("reading beyond a file's ids")
            b, at = divmod(start, self._each * self.length)
            ids, mask = self._batch(b)
            take = min(n, len(ids) - at)
            if not mask[at + take - 1].as_py():
                raise ValueError("reading beyond a file's ids")
            out.append(ids[at : at + take])
            start, n = start + take, n - take
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint32)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 2, length: int = SEQUENCE, remember: int = MEMO) -> DataFrame:
    """Encode all documents and write them in ascending doc_id order; returns the manifest.

    Manifest: ``file, index, base`` (ids in all files before it), ``n_ids, n_docs``, one row per file. Null texts are
    empty, nulls in doc_id stand first, rows that share a doc_id are ordered by their text's hash, then
    text (so that a doc_id repeated in many rows is split too), an empty table writes no file. A
    task writes under a name of its own attempt, and only files in the manifest count, so retries leave no wrong data.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    run_id = uuid.uuid4().hex[:8]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, remember)
        context = TaskContext.get()
        name = f"{run_id}-{context.partitionId():06d}-{context.taskAttemptId()}"
        writer, end, low, n_docs = None, np.array([end_id], "<u4"), None, 0
        fs, path = filesystem(folder)
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs.create_dir(path, recursive=True)
                sink, index_sink = fs.open_output_stream(f"{path}/{name}.arrow"), fs.open_output_stream(f"{path}/{name}.index.arrow")
                writer = SequenceWriter(sink, length, encode.kind)
                index = pa.ipc.new_file(index_sink, _INDEX)
                low = b.column(0)[0].as_py()
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                starts, sizes = [], []
                for ids in encode.ids_of(part.column(1).to_pylist()):
                    starts.append(writer.written)
                    writer.add(np.concatenate([ids, end]))
                    sizes.append(len(ids) + 1)
                index.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=_INDEX))
                n_docs += part.num_rows
        if writer is not None:
            n = writer.written
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}.arrow"], "index": [f"{folder}/{name}.index.arrow"], "low": pa.array([low], pa.int64()), "part": pa.array([context.partitionId()], pa.int64()), "n_ids": [n], "n_docs": [n_docs]})
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    parts = written(ordered.mapInArrow(write, "file string, index string, low long, part long, n_ids long, n_docs long"), "manifest")
    base = F.expr("coalesce(sum(n_ids) over (order by part rows between unbounded preceding and 1 preceding), 0L)")  # a row per file
    return parts.select("file", "index", base.alias("base"), "n_ids", "n_docs")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start`` (over all files), ``n_tokens, ids_crc32`` of each document, read back from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                fs, path = filesystem(r["file"])
                local = fs.type_name == "local"
                reader = SequenceReader(pa.memory_map(path) if local else fs.open_input_file(path))
                index = pa.ipc.open_file(fs.open_input_file(filesystem(r["index"])[1]))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    crc = [zlib.crc32(reader.ids(s, n).astype("<u4")) for s, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(part.column(1).to_numpy() + r["base"], pa.int64()), part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")

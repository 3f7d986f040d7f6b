"""Token-id files: Arrow stream files of fixed-size-list batches.

Documents are dealt by ranges of their id, tokenised and written in ascending id order. A
file is an Arrow IPC stream whose batches hold ``ids`` (fixed_size_list[length] of
uint16, or uint32 for vocabularies beyond 65,536) and ``mask`` (fixed_size_list<bool>[length], true for an id, false for padding): all sequences have one
length, so sequence k lies at a fixed place of its batch and a memory-mapped file is read
without a copy. A second stream beside it (``.index``) holds each document's id, first
position and count.

A task writes under a name of its own attempt and renames the finished file, so a retried or
repeated task leaves one whole file. Only names and counts go through Spark; the manifest has
a row per file and sums counts up to each file's first global position.

Files live in the shared folder, reached by pyarrow's filesystems (local, HDFS, S3 and so on).

Defined results: a null text counts as empty (the end id only); repeated ids follow each
other in any order; null ids come first; an empty table gives no files and no rows; extra
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.common import id_and_text, new_path
from stratagraph.llm.tokenise import WordEncoder, groups, load

LENGTH, END_ID = 1024, 1
#: Sequences in a batch, and bytes of text that a file is meant to hold.
BATCH_SEQUENCES, FILE_BYTES = 1024, 32 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def schemas(id_type: pa.DataType, length: int, dtype: str) -> tuple[pa.Schema, pa.Schema]:
    data = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(dtype)), length)), ("mask", pa.list_(pa.bool_(), length))])
    return data, pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """Appends documents' ids to one file and its index."""

    def __init__(self, folder: str, id_type: pa.DataType, length: int, dtype: str = "<u2"):
        self.fs, self.folder = _filesystem(folder)
        self.name, self.length = uuid.uuid4().hex, length
        self.data_schema, self.index_schema = schemas(id_type, length, dtype)
        self.sinks = [self.fs.open_output_stream(f"{self.folder}/_{self.name}.{kind}") for kind in ("arrows", "index")]
        self.data, self.index = (pa.ipc.new_stream(s, k) for s, k in zip(self.sinks, (self.data_schema, self.index_schema), strict=True))
        self.dtype, self.rest, self.total = dtype, np.empty(0, dtype), 0

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.data.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.data_schema))

    def append(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(counts)], schema=self.index_schema))
        self.total += len(ids)
        held, step = np.concatenate([self.rest, ids.astype(self.dtype)]), self.length * BATCH_SEQUENCES
        whole = len(held) // step * step
        for at in range(0, whole, step):
            self._write(held[at : at + step], np.ones(step, bool))
        self.rest = held[whole:].copy()

    def close(self, last_name: str) -> None:
        if len(self.rest):
            n = -(-len(self.rest) // self.length) * self.length
            ids, mask = np.zeros(n, self.dtype), np.zeros(n, bool)
            ids[: len(self.rest)], mask[: len(self.rest)] = self.rest, True
            self._write(ids, mask)
        for writer, sink, kind in zip((self.data, self.index), self.sinks, ("arrows", "index"), strict=True):
            writer.close()
            sink.close()
            self.fs.move(f"{self.folder}/_{self.name}.{kind}", f"{self.folder}/{last_name}.{kind}")


def _write(folder: str, tokenizer: str, length: int, end_id: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer = WordEncoder(tokenizer), None
        part = TaskContext.get().partitionId()
        for batch in batches:
            if not len(batch):
                continue
            writer = writer or Writer(folder, id_type, length, "<u2" if load(tokenizer).get_vocab_size() <= 1 << 16 else "<u4")
            for own, texts, _ in groups(batch.column("text")):
                ids, at = encoder.encode(texts)
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                writer.append(batch.column("doc_id").take(pa.array(own)), ids, np.diff(at) + 1)
        if writer:
            writer.close(f"part-{part:06d}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"part-{part:06d}"]), pa.array([writer.total], pa.int64())], names=["part", "file", "n_ids"])

    return run


def open_ids(folder: str, file: str) -> list[pa.RecordBatch]:
    """A file's batches; memory-mapped, hence without a copy, where the folder is local."""
    from pyarrow import fs

    system, path = _filesystem(folder)
    path = f"{path}/{file}.arrows"
    source = pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
    return list(pa.ipc.open_stream(source))


def sequence(batches: list[pa.RecordBatch], k: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """The ids and mask (bits) of sequence ``k`` of a file, without a copy: all batches but the last are full."""
    batch = batches[k // BATCH_SEQUENCES]
    length, k = batch.schema.field("ids").type.list_size, k % BATCH_SEQUENCES
    return batch.column("ids").values.to_numpy()[k * length : (k + 1) * length], batch.column("mask").values.slice(k * length, length)


def _read(folder: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                data = open_ids(folder, file)
                flat = [b.column("ids").values.to_numpy() for b in data]
                first = np.cumsum([0, *map(len, flat)])
                with system.open_input_stream(f"{root}/{file}.index") as source:
                    for index in pa.ipc.open_stream(source):
                        sums = []
                        for at, n in zip(index.column("start").to_pylist(), index.column("n_tokens").to_pylist(), strict=True):
                            k, crc = int(np.searchsorted(first, at, "right")) - 1, 0
                            while n:  # a document may run over several batches
                                part = flat[k][at - first[k] : at - first[k] + n]
                                crc = zlib.crc32(part.astype("<u4"), crc)
                                at, n, k = at + len(part), n - len(part), k + 1
                            sums.append(crc)
                        starts = pa.array(index.column("start").to_numpy() + base)
                        yield pa.RecordBatch.from_arrays([index.column("doc_id").cast(id_type), starts, index.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write the files; the manifest: ``(part, file, n_ids, base)``, base being the ids in files before."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = df.sparkSession
    docs = id_and_text(df, id_col, text_col)
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The row's number lets ranges part rows of one id; ids alone decide the order, so a repeated task deals alike.
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(max(1, -(-size // FILE_BYTES)), "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")
    rows = dealt.mapInArrow(_write(folder, tokenizer or default_tokenizer(), length, end_id, to_arrow_type(df.schema[id_col].dataType)), "part long, file string, n_ids long").collect()
    base, out = 0, []
    for r in sorted(rows):  # a row per file
        out.append((r.part, r.file, r.n_ids, base))
        base += r.n_ids
    return spark.createDataFrame(out, "part long, file string, n_ids long, base long")


def read(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """Per document of the files: ``(doc_id, start, n_tokens, ids_crc32)``, start counted over all files."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(id_type)
    files = manifest.count()
    return manifest.repartition(max(1, files), "part").mapInArrow(_read(folder, to_arrow_type(kind)), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to a new folder of the shared place and read them back."""
    folder = new_path(df.sparkSession, "tokens")
    return read(write(df, folder, id_col, text_col), folder, df.schema[id_col].dataType.simpleString().replace("bigint", "long"))

"""Token ids in Arrow IPC files of equal-length sequences.

Documents are range-partitioned by id; each task encodes its documents in order, appends the end
id to each, packs the ids into sequences of ``length`` and writes one IPC file whose record
batches hold two fixed-size-list columns: ``ids`` (smallest unsigned type for the vocabulary) and
``mask`` (true: a token, false: padding, only at the end of a file).  Record batches of a memory-
mapped file are random-access and zero-copy.  Beside it lies a small IPC index (doc_id, start,
n_tokens).  File names carry a random part, and only files named in the manifest (rows of the
tasks that succeeded) count, so a repeated or lost task leaves no wrong file behind.

Defined results: null text is the empty text (its document is the end id alone); null doc_id
comes first; equal ids are ordered by a hash of the text, fully repeated rows are encoded one by
one; an empty table writes no file; a long text streams through several batches.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, pinned, scratch_path
from .tokens import filesystem, word_encoder

LENGTH = 1024
BATCH = 512  # sequences in a record batch


def file_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


def _batch(schema: pa.Schema, ids: np.ndarray, length: int) -> pa.RecordBatch:
    rows = -(-len(ids) // length)
    full = np.zeros(rows * length, dtype=ids.dtype)
    full[: len(ids)] = ids
    mask = np.arange(rows * length) < len(ids)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (full, mask)]
    return pa.record_batch(lists, schema=schema)


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    length: int = LENGTH,
) -> DataFrame:
    """Encode all rows in ascending id order into ``folder``; returns the manifest (one row for
    each file: shard, path, n_docs, n_tokens), already written."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = d.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches):
        encoder = word_encoder(tokenizer_path)
        schema = file_schema(encoder.dtype, length)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        size, step = encoder.dtype.itemsize, length * BATCH
        fs, root = filesystem(folder)
        shard = TaskContext.get().partitionId()
        path = f"{root}/part-{shard:06d}-{uuid.uuid4().hex}.arrow"
        out, held, pending, total = None, [], 0, 0
        ids, starts, counts = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    sink = fs.open_output_stream(path)
                    out = pa.ipc.new_file(sink, schema)
                code = encoder.encode(text.as_py()) + end
                n = len(code) // size
                ids.append(doc_id)
                starts.append(total)
                counts.append(n)
                held.append(code)
                total, pending = total + n, pending + n
                if pending >= step:
                    flat = np.frombuffer(b"".join(held), dtype=encoder.dtype)
                    cut = len(flat) // step * step
                    for lo in range(0, cut, step):
                        out.write_batch(_batch(schema, flat[lo : lo + step], length))
                    held, pending = [flat[cut:].tobytes()], len(flat) - cut
        if out is None:
            return
        if pending:
            out.write_batch(_batch(schema, np.frombuffer(b"".join(held), dtype=encoder.dtype), length))
        out.close()
        sink.close()
        index = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": starts, "n_tokens": counts})
        with fs.open_output_stream(path + ".index") as s, pa.ipc.new_file(s, index.schema) as w:
            w.write_table(index, max_chunksize=65_536)
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "path": [f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}"], "n_docs": [len(ids)], "n_tokens": [total]}
        )

    manifest = ranged.mapInArrow(lean(write), "shard long, path string, n_docs long, n_tokens long")
    return pinned(manifest, "token-manifest")


def open_sequences(path: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to a file's record batches; local files are memory-mapped (zero copy)."""
    fs, name = filesystem(path)
    return pa.ipc.open_file(pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence, by its number in the file."""
    batch, at = reader.get_batch(row // BATCH), row % BATCH
    return (batch["ids"][at].values.to_numpy(), batch["mask"][at].values.to_numpy(zero_copy_only=False))


def _streams(reader):
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch["ids"].flatten().to_numpy()
        used = batch["mask"].flatten()
        yield ids if used.true_count == len(used) else ids[: used.true_count]


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())
    files = files.repartitionByRange(n, "shard") if n > 1 else files

    def read(batches):
        for pdf in batches:
            for path, base, shard in pdf[["path", "base", "shard"]].itertuples(index=False):
                reader = open_sequences(path)
                stream, chunk, at = _streams(reader), np.empty(0, dtype="<u2"), 0
                index = open_sequences(path + ".index")
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    crcs = []
                    for n_tokens in part["n_tokens"].to_pylist():
                        crc = 0
                        while n_tokens:
                            if at == len(chunk):
                                chunk, at = next(stream), 0
                            own = chunk[at : at + n_tokens]
                            crc = zlib.crc32(own.astype("<u4"), crc)
                            at, n_tokens = at + len(own), n_tokens - len(own)
                        crcs.append(crc)
                    yield pd.DataFrame(
                        {
                            "doc_id": part["doc_id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
                            "start": part["start"].to_numpy() + base,
                            "n_tokens": part["n_tokens"].to_numpy(),
                            "ids_crc32": crcs,
                            "shard": shard,
                        }
                    )

    return files.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, **options) -> DataFrame:
    """Write all documents and read the files back (folder: default under spark.checkpoint.dir)."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read_documents(write_token_files(docs, tokenizer_path, folder, **options))

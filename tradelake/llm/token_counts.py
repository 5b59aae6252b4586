"""Token counts of documents in flat, unindexed token files, by a separator scan.

A file is nothing but little-endian ids; documents end with the separator id.  Files are cut into
blocks of ``block_tokens``; each block is one record that any task can read on its own.  A task
finds all separators of a block with one vectorised comparison.  A document that began in an
earlier block is stitched by a prefix scan over the blocks of its file: separators before the
block (its ordinal) and the last separator position before it (its start).

Defined results: two separators in a row are an empty document of 0 tokens; ids after the last
separator are a last, unterminated document; an empty file has none.  For ``document_counts``:
null text is the empty text, repeated rows are separate documents, an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pinned, scratch_path
from .tokens import filesystem, id_type, rank_encoder

BLOCK_TOKENS = 2_000_000


def write_flat_files(
    docs: DataFrame, ranks_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One flat file for each input partition, no shuffle of texts: the documents' ids, each
    followed by the separator (the first id beyond the ranks).  Returns, written, one row for
    each document: path, ordinal, doc_id; rows of failed attempts never appear."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def write(batches):
        encoder = rank_encoder(ranks_path)
        dtype = id_type(encoder.n_vocab + 1)
        end = np.array([encoder.n_vocab], dtype=dtype).tobytes()
        fs, root = filesystem(folder)
        name = f"flat-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        out, done = None, 0
        for batch in batches:
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            for text in batch["text"].to_pylist():
                out.write(np.array(encoder.encode_ordinary(text), dtype=dtype).tobytes() + end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{folder.rstrip('/')}/{name}"] * n), pa.array(range(done, done + n), pa.int64()), batch["doc_id"]],
                names=["path", "ordinal", "doc_id"],
            )
            done += n
        if out is not None:
            out.close()

    return pinned(d.mapInArrow(write, "path string, ordinal long, doc_id long"), "flat-documents")


def separator_scan(paths: DataFrame, separator: int, vocabulary: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``paths``: column path.  Per document: path, ordinal (from 0), start, n_tokens (without
    the separator)."""
    dtype = id_type(vocabulary)
    paths = paths.select("path").distinct()

    def blocks(batches):
        for pdf in batches:
            for path in pdf["path"]:
                fs, name = filesystem(path)
                n = fs.get_file_info(name).size // dtype.itemsize
                k = np.arange(-(-n // block_tokens))
                yield pd.DataFrame({"path": path, "block": k, "first": k * block_tokens, "total": n})

    cut = paths.mapInPandas(blocks, "path string, block long, first long, total long")
    cut = cut.repartition("path", "block")

    def scan(batches):
        for pdf in batches:
            for path, block, first, total in pdf.itertuples(index=False):
                n = min(block_tokens, total - first)
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(int(first) * dtype.itemsize)
                    ids = np.frombuffer(f.read(int(n) * dtype.itemsize), dtype=dtype)
                at = np.flatnonzero(ids == separator) + first
                if first + n == total and n and ids[-1] != separator:
                    at = np.append(at, total)  # an unterminated last document
                if len(at):
                    before = pd.array([None, *at[:-1]], dtype="Int64")
                    yield pd.DataFrame({"path": path, "block": block, "k": np.arange(len(at)), "at": at, "before": before})

    found = pinned(cut.mapInPandas(scan, "path string, block long, k long, at long, before long"), "separators")
    sums = found.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"))
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        "path", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("done"), F.max("last").over(upto).alias("carry")
    )
    start = F.coalesce("before", "carry", F.lit(-1)) + 1
    return found.join(carry, ["path", "block"]).select(
        "path", (F.col("done") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens")
    )


def document_counts(docs: DataFrame, ranks_path: str, folder: str | None = None, **options) -> DataFrame:
    """Token counts of all documents, read from flat files that Spark writes from them."""
    folder = folder or scratch_path(docs.sparkSession, "flat-tokens")
    n = rank_encoder(ranks_path).n_vocab
    listed = write_flat_files(docs, ranks_path, folder, **options)
    counts = separator_scan(listed, n, n + 1)
    return listed.join(counts, ["path", "ordinal"]).select("doc_id", "n_tokens", "ordinal", "start")

"""Blocks of documents, and packed arrays to send between blocks and shards."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.common import BATCH_ROWS, batches_of, shared_folder

#: A block ends with the document that brings it to so many characters.
BLOCK_BYTES = 8 << 20
#: Files of the bucketed table; with more blocks than this a file holds several, still handled one by one.
MAX_BUCKETS = 8192


def blocked(docs: DataFrame, total: int, limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (``total`` bytes of ``text``) with a column ``block long``, from a table bucketed by block.

    Blocks are runs of rows of one input partition. The table lies in the shared folder;
    grouping by ``block`` reads whole buckets, so that no text is shuffled again.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")

    def number(batches):
        block, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            lengths = [len(t) if t else 0 for t in batch.column(at).to_pylist()]
            ids = np.empty(len(lengths), np.int64)
            for i, n in enumerate(lengths):
                ids[i] = block
                size += n
                if size >= limit:
                    block, size = block + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], [*batch.schema.names, "block"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    numbered = docs.mapInArrow(number, f"{fields}, block long")
    buckets = min(MAX_BUCKETS, max(8, 2 * math.ceil(total / limit)))
    name = f"tidemark_blocks_{uuid.uuid4().hex}"
    with batches_of(spark, BATCH_ROWS):
        numbered.write.bucketBy(buckets, "block").option("path", shared_folder(spark)).option("compression", "zstd").format("parquet").saveAsTable(name)
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the catalog's entry; the files are the caller's and stay
    return rows


def pack_array(values: np.ndarray) -> bytes:
    """An integer array as compressed bytes: differences if it is sorted, bytes by their rank."""
    import zstandard

    v = values.astype("<u8" if values.dtype == np.uint64 else "<i8")
    kind = b"u" if v.dtype == np.uint64 else b"i"
    rising = len(v) > 1 and bool((v[1:] >= v[:-1]).all())
    if rising:
        v = np.append(v[:1], v[1:] - v[:-1])
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T)
    return kind + (b"d" if rising else b"-") + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_array(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[2:]), np.uint8).reshape(8, -1)
    v = np.ascontiguousarray(raw.T).reshape(-1).view(np.uint64 if blob[:1] == b"u" else np.int64)
    return np.cumsum(v, dtype=v.dtype) if blob[1:2] == b"d" else v

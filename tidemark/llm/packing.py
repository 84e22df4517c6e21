"""Packing by concatenate and cut.

First pass: every document's ids (and the id that ends it) go to a table in the shared
folder, with the partition that made them and the offset inside it. The partitions' token
totals, one row each, get prefix sums: they turn local offsets into global ones. Second
pass: fixed windows of ``length`` tokens cut the stream; a document that crosses window
borders becomes one boundary record for each window it touches. No row is shuffled.

A null or empty text is its end id alone. A very long text spans many sequences, as one piece
in each. Repeated rows are separate documents; rows are packed in the order of the table, so
ties need no rule. Only the last sequence has padding. An empty table gives no pieces. Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters
from tidemark.llm.common import release, table, written

LENGTH, END_ID = 1024, 0
#: The pattern that byte-level vocabularies cut texts with before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids, as the tokenizer file (byte-level BPE) gives them.

    tiktoken does the same merges some times faster; what it cannot take goes to tokenizers.
    """
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(_slow(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@functools.lru_cache(maxsize=2)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """First pass: ``doc_id, part, at, n, ids``; ids as little-endian unsigned 32-bit."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        release()
        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for f in frames:
            # one end id after each text
            blobs = [np.append(encode(t), np.uint32(end_id)).astype("<u4").tobytes() if t else np.array([end_id], "<u4").tobytes() for t in f["text"]]
            n = np.array([len(b) // 4 for b in blobs], np.int64)
            ends = at + np.cumsum(n)
            yield pd.DataFrame({"doc_id": f["doc_id"], "part": part, "at": ends - n, "n": n, "ids": blobs})
            at = int(ends[-1]) if len(n) else at

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, part int, at long, n long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``."""
    rows = written(tokenized(docs, path, end_id))
    # one row for each partition of the input
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    at, size = F.col("base") + F.col("at"), F.lit(length).cast("long")
    placed = rows.join(F.broadcast(base), "part").withColumn("g", at)

    def piece(s):
        """What window ``s`` holds of the document."""
        first = F.greatest(s * size, F.col("g"))
        n = F.least((s + 1) * size, F.col("g") + F.col("n")) - first
        start = first - F.col("g")
        ids = F.substring("ids", (4 * start + 1).cast("int"), (4 * n).cast("int"))
        return F.struct(start.alias("start"), n.alias("length"), ids.alias("ids"), s.alias("sequence_id"), (first - s * size).alias("offset"))

    windows = F.sequence(F.floor(F.col("g") / size), F.floor((F.col("g") + F.col("n") - 1) / size))
    pieces = placed.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(windows, piece)).alias("p"))
    return pieces.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")


def sequences(pieces: DataFrame) -> DataFrame:
    """One row for each sequence: its pieces in order and its ids (little-endian, 32-bit)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"), joined.alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}

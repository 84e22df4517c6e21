"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by single spaces, as UTF-8, closed by the byte 255.
Each byte is eight binary decisions. For every decision there is a tree over the last
``DEPTH`` bytes; its nodes hold Krichevsky-Trofimov estimates, and a node's weighted
probability is the mean of its own estimate and of the product of its children's. Trained
on whole counts, the tree then predicts as the mixture over all depths that this implies; a
context never seen predicts 1/2. The score is the text's log10 probability.

Work is cut twice. Blocks are sets of documents (about ``BLOCK_BYTES`` of text, by hash of
doc_id); shards are sets of keys: words by hash, byte strings by their last two context
bytes. A block sends its distinct keys with their training counts to the shards, shards add
them up, and answer each block with what its keys need: a word's count, a byte string's code
length. The requests to a shard that gets more than ``SALT_BYTES`` (a frequent context) are
salted by block, and only such a shard's model is copied to each salt. Nodes above the shards
are at most 255 * 257 numbers. ``DEPTH`` is the model's size: contexts longer than that are
not told apart.

Null and empty texts are the end token alone. Rows without doc_id count as training rows.
Very long texts are handled in pieces of a block's work; a block has one text at least.
Repeated rows and ties count and score each. An empty table gives no rows. Only ``doc_id`` and
``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_bytes, written

DEPTH, END = 5, b"\xff"
BLOCK_BYTES, SHARD_BYTES, SALT_BYTES = 8 << 20, 12 << 20, 64 << 20
#: Bytes whose strings are sorted at a time.
STEP_BYTES = 2 << 20
WORDS, STRINGS = 0, 1


# ---- keys and counts -------------------------------------------------------------------


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts; lists that are sorted merge fast."""
    k, c = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k = k[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c[order], first)


def deflate(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=0).astype("<i8").tobytes())


def inflate(blob: bytes) -> np.ndarray:
    import zstandard

    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8"))


def squeeze(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def expand(blob: bytes, kind: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def byte_strings(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts its key (last context byte first, the byte itself last); keys of each text."""
    pad = bytes(depth)
    a = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    n = max(0, len(a) - depth)
    key = np.zeros(n, np.int64)
    for d in range(1, depth + 1):
        key = (key << 8) | a[depth - d : depth - d + n]
    key = (key << 8) | a[depth:]
    # positions of padding are none of a text's
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    inside = np.ones(len(a), bool)
    inside[(starts[:, None] + np.arange(depth)).ravel()] = False
    return key[inside[depth:]], sizes


def steps(texts: list[bytes]):
    """Index ranges of about ``STEP_BYTES`` each."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_shard(words: pa.LargeBinaryArray, shards: int) -> np.ndarray:
    """Shard of each word, by a hash of its bytes and their places."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    size = np.diff(offsets)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat((offsets[:-1] - offsets[0]).astype(np.uint64), size)
    h = (data + np.uint64(1) + (place << np.uint64(8))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    out, some = np.zeros(len(words), np.uint64), size > 0
    if len(data):
        out[some] = np.add.reduceat(h, (offsets[:-1] - offsets[0])[some])
    return ((out >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def string_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> 8 * (DEPTH - 1)) * 40503 >> 4) % shards


def by_shard(shard: np.ndarray) -> list[np.ndarray]:
    """Index arrays of each shard, in order."""
    # 16-bit numbers are sorted by radix
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
    return [x for x in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(x)]


class Block:
    """A block's distinct words and byte strings, the same whenever they are computed.

    ``words`` are sorted, the end token b"" among them at ``end``; ``place`` has the index of
    each word of the texts, ``size`` the words of each text.
    """

    def __init__(self, texts: list[str | None]):
        split = [(t or "").encode().lower().split() for t in texts]
        self.plain = [b" ".join(w) + END for w in split]
        self.size = np.array([len(w) for w in split], np.int64)
        coded = pa.array([*itertools.chain.from_iterable(split), b""], pa.large_binary()).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.sorted = coded.dictionary.take(order)
        self.words = self.sorted.to_pylist()
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        place = rank[coded.indices.to_numpy()]
        self.place, self.end = place[:-1], int(place[-1])

    def strings(self):
        """For some texts at a time: their range, the distinct keys, each byte's place among them, bytes of each."""
        for a, z in steps(self.plain):
            k, size = byte_strings(self.plain[a:z])
            place, keys = pd.factorize(k)
            yield (a, z), keys, place, size


def block_requests(block: int, texts: list, train: np.ndarray, shards: int) -> list[tuple]:
    """(block, shard, kind, keys, counts) rows of one block."""
    b, rows = Block(texts), []
    counts = np.bincount(b.place[np.repeat(train, b.size)], minlength=len(b.words)).astype(np.int64)
    counts[b.end] = int(train.sum())
    shard = word_shard(b.sorted, shards)
    for p in by_shard(shard):
        own = b" ".join([b.words[i] for i in p.tolist()])
        rows.append((block, int(shard[p[0]]), WORDS, squeeze(np.frombuffer(own, np.uint8)), squeeze(counts[p].astype("<i8"))))
    found_keys, found_counts = [], []
    for (a, z), keys, place, size in b.strings():
        learnt = np.bincount(place[np.repeat(train[a:z], size)], minlength=len(keys)).astype(np.int64)
        order = np.argsort(keys)
        found_keys.append(keys[order])
        found_counts.append(learnt[order])
    k, c = add_up(found_keys, found_counts)
    shard = string_shard(k, shards)
    for p in by_shard(shard):
        rows.append((block, int(shard[p[0]]), STRINGS, deflate(k[p]), squeeze(c[p].astype("<i8"))))
    return rows


def split_words(blob: bytes) -> list[bytes]:
    return expand(blob, np.uint8).tobytes().split(b" ")


# ---- the trees -------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def gamma_tables(size: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Logs of gamma(n + 1/2) and gamma(n + 1) for n below ``size``."""
    n = np.arange(1, size)
    return 0.5 * math.log(math.pi) + np.append(0, np.cumsum(np.log(n - 0.5))), np.append(0, np.cumsum(np.log(n)))


def log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """Log of gamma(n + 1/2) or gamma(n + 1): small whole numbers by table, others by Stirling's series."""
    table = gamma_tables()[0 if half else 1]
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(table))
    if len(large):
        y = n[large] + (0.5 if half else 1)
        out[large] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""
    return log_gamma(n0, True) + log_gamma(n1, True) - math.log(math.pi) - log_gamma(n0 + n1, False)


def weigh(kt: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of inner nodes and the share of their own estimate."""
    return np.logaddexp(kt, children) - math.log(2), 1 / (1 + np.exp(np.clip(children - kt, -700, 700)))


def levels(keys: np.ndarray, counts: np.ndarray, bit: int, top: int, depth: int = DEPTH) -> list[tuple]:
    """Nodes of the trees of one binary decision, from ``depth`` up to ``top``.

    A level has the nodes' ids (the symbol's leading bits, then context bytes), both counts,
    the share of the own estimate and, last, the weighted log probability.
    """
    node = (((keys & 255) >> (8 - bit)) << 8 * depth) | (keys >> 8)
    ones = counts * ((keys >> (7 - bit)) & 1)
    order = np.argsort(node, kind="stable")
    node, n, n1 = node[order], counts[order].astype(float), ones[order].astype(float)
    out, weighted = [], np.zeros(0)
    for d in range(depth, top - 1, -1):
        if d < depth:
            node = node >> 8
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
        node = node[first]
        n, n1 = (np.add.reduceat(x, first) if len(first) else x for x in (n, n1))
        kt = log_kt(n - n1, n1)
        if d == depth:
            share, weighted = np.ones(len(node)), kt
        else:
            weighted, share = weigh(kt, np.add.reduceat(weighted, first) if len(first) else weighted)
        out.append((node, n - n1, n1, share, weighted))
    return out


def mixed(p: np.ndarray, node: np.ndarray, ones: np.ndarray, level: tuple) -> np.ndarray:
    """One step towards the root: deeper predictions ``p`` mixed with the level's own."""
    ids, n0, n1, share = level[:4]
    if not len(ids):
        return np.full(len(node), 0.5)
    at = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
    own = (np.where(ones, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
    return np.where(ids[at] == node, share[at] * own + (1 - share[at]) * p, 0.5)


def top_part(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """What a shard's trees give to the nodes of depth 1: (bit, node, n0, n1, children)."""
    rows = []
    for bit in range(8):
        node, n0, n1, _, weighted = levels(keys, counts, bit, 2)[-1]
        node = node >> 8
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
        if len(first):
            rows += zip([bit] * len(first), node[first].tolist(), *(np.add.reduceat(x, first).tolist() for x in (n0, n1, weighted)), strict=True)
    return rows


def top_levels(rows: list[tuple]) -> list[list[tuple]]:
    """Depths 1 and 0 of each binary decision, from the sums of all shards."""
    out = []
    for bit in range(8):
        own = sorted(r[1:] for r in rows if r[0] == bit)
        node = np.array([r[0] for r in own], np.int64)
        n0, n1, children = (np.array([r[k] for r in own], float) for k in (1, 2, 3))
        found = []
        for d in (1, 0):
            if d == 0 and len(node):
                node = node >> 8
                first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                node, n0, n1, children = node[first], *(np.add.reduceat(x, first) for x in (n0, n1, weighted))
            weighted, share = weigh(log_kt(n0, n1), children)
            found.append((node, n0, n1, share))
        out.append(found)
    return out


def code_lengths(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, top: list[list[tuple]]) -> np.ndarray:
    """Bits of each wanted key's byte in its context, under the trees of the shard and the top."""
    bits = np.zeros(len(wanted))
    for bit in range(8):
        node = (((wanted & 255) >> (8 - bit)) << 8 * DEPTH) | (wanted >> 8)
        ones = (wanted >> (7 - bit)) & 1 == 1
        p = np.full(len(wanted), 0.5)
        for d, level in zip(range(DEPTH, -1, -1), [*levels(keys, counts, bit, 2), *top[bit]], strict=True):
            p = mixed(p, node >> 8 * (DEPTH - d), ones, level)
        bits -= np.log2(p)
    return bits


# ---- jobs ------------------------------------------------------------------------------


def salted(requests: DataFrame) -> DataFrame:
    """Adds ``salt``: the requests to one shard, where they are many, in groups of about ``SALT_BYTES``."""
    sizes = requests.groupBy("kind", "shard").agg(F.ceil(F.sum(F.length("keys") + F.length("counts")) / SALT_BYTES).cast("int").alias("salts"))
    several = sizes.filter("salts > 1")
    rows = requests.join(several, ["kind", "shard"], "left")
    return rows.withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("block"), "salts").cast("int"))


def score(docs: DataFrame, held_out) -> DataFrame:
    """Scores of every document of ``doc_id, text``; ``held_out`` (a column) marks what is not learnt from.

    ``score`` is the log10 probability, ``bits_per_byte`` the code length for each byte.
    """
    spark = docs.sparkSession
    total = text_bytes(docs)
    blocks, shards = max(1, math.ceil(total / BLOCK_BYTES)), max(1, math.ceil(total / SHARD_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    place = F.pmod(F.coalesce(F.xxhash64(F.col("doc_id")), F.xxhash64("text")), F.lit(blocks)).cast("int")
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"), place.alias("block"))

    def ask(key, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(block_requests(int(key[0]), f["text"].tolist(), ~f["held"].to_numpy(bool), shards), columns=["block", "shard", "kind", "keys", "counts"])

    requests = written(rows.groupBy("block").applyInPandas(ask, "block int, shard int, kind int, keys binary, counts binary"))
    requests = salted(requests)

    def merge(key, f: pd.DataFrame) -> pd.DataFrame:
        if key[0] == WORDS:
            sums: Counter = Counter()
            for k, c in zip(f["keys"], f["counts"], strict=True):
                for w, n in zip(split_words(k), expand(c, "<i8").tolist(), strict=True):
                    if n:
                        sums[w] += n
            own = sorted(sums)
            keys, counts = squeeze(np.frombuffer(b" ".join(own), np.uint8)), np.array([sums[w] for w in own], "<i8")
        else:
            k, c = add_up([inflate(x) for x in f["keys"]], [expand(x, "<i8") for x in f["counts"]])
            keys, counts = deflate(k[c > 0]), c[c > 0].astype("<i8")
        return pd.DataFrame([(key[0], key[1], int(f["salts"].iloc[0]), keys, squeeze(counts), len(counts), int(counts.sum()))], columns=["kind", "shard", "salts", "keys", "counts", "types", "tokens"])

    merged = "kind int, shard int, salts int, keys binary, counts binary, types long, tokens long"
    # requests to a large shard are added up salt by salt first
    part = requests.groupBy("kind", "shard", "salt").applyInPandas(merge, merged)
    model = written(part.filter("salts = 1").unionByName(part.filter("salts > 1").groupBy("kind", "shard").applyInPandas(merge, merged)) if not requests.filter("salts > 1").isEmpty() else part)
    sizes = model.filter(F.col("kind") == WORDS).agg(F.coalesce(F.sum("types"), F.lit(0)).alias("v"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()

    def tops(frames):
        for f in frames:
            found = [r for k, c in zip(f["keys"], f["counts"], strict=True) for r in top_part(inflate(k), expand(c, "<i8"))]
            yield pd.DataFrame(found, columns=["bit", "node", "n0", "n1", "children"])

    parts = model.filter(F.col("kind") == STRINGS).select("keys", "counts").mapInPandas(tops, "bit int, node long, n0 double, n1 double, children double")
    # at most 255 * 256 rows: a symbol's leading bits and one context byte
    sums = parts.groupBy("bit", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("children").alias("children"))
    top = spark.sparkContext.broadcast(top_levels([tuple(r) for r in sums.collect()]))

    def answer(key, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if key[0] == WORDS:
            counts = dict(zip(split_words(known["keys"][0]), expand(known["counts"][0], "<i8").tolist(), strict=True)) if len(known) and known["types"][0] else {}
            for block, blob in zip(asked["block"], asked["keys"], strict=True):
                out.append((block, key[1], WORDS, squeeze(np.array([counts.get(w, 0) for w in split_words(blob)], "<f8"))))
        else:
            keys, counts = (inflate(known["keys"][0]), expand(known["counts"][0], "<i8")) if len(known) else (np.zeros(0, np.int64),) * 2
            wanted = [inflate(x) for x in asked["keys"]]
            all_wanted = np.unique(np.concatenate(wanted)) if wanted else np.zeros(0, np.int64)
            bits = code_lengths(all_wanted, keys, counts, top.value)
            for block, k in zip(asked["block"], wanted, strict=True):
                out.append((block, key[1], STRINGS, squeeze(bits[np.searchsorted(all_wanted, k)].astype("<f4"))))
        return pd.DataFrame(out, columns=["block", "shard", "kind", "answers"])

    models = model.select("kind", "shard", "keys", "counts", "types", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asked = requests.select("kind", "shard", "salt", "block", "keys")
    answers = asked.groupBy("kind", "shard", "salt").cogroup(models.groupBy("kind", "shard", "salt")).applyInPandas(answer, "block int, shard int, kind int, answers binary")
    n, v = sizes["n"], sizes["v"]

    def scored(f: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        b = Block(f["text"].tolist())
        by = {(int(s), int(k)): a for s, k, a in zip(got["shard"], got["kind"], got["answers"], strict=True)}
        count, shard = np.zeros(len(b.words)), word_shard(b.sorted, shards)
        for p in by_shard(shard):
            count[p] = expand(by[int(shard[p[0]]), WORDS], "<f8")
        logs = np.log10((count + 1) / (n + v + 1))
        per = np.repeat(np.arange(len(f)), b.size)
        known = np.bincount(per, count[b.place] > 0, len(f)).astype(np.int64) + int(count[b.end] > 0)
        base = np.bincount(per, logs[b.place], len(f)) + logs[b.end]
        found = list(b.strings())
        strings = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for _, k, _, _ in found)]))
        bits, shard = np.zeros(len(strings)), string_shard(strings, shards)
        for p in by_shard(shard):
            bits[p] = expand(by[int(shard[p[0]]), STRINGS], "<f4")
        total_bits = np.zeros(len(f))
        for (a, z), keys, at, size in found:
            total_bits[a:z] = np.add.reduceat(bits[np.searchsorted(strings, keys)][at], np.cumsum(size) - size)
        n_bytes = np.array([len(p) for p in b.plain], np.int64)
        return pd.DataFrame(
            {
                "doc_id": f["doc_id"].to_numpy(),
                "held_out": f["held"].to_numpy(bool),
                "n_tokens": b.size + 1,
                "n_known": known,
                "train_tokens": n,
                "base_score": base,
                "score": -total_bits * math.log10(2),
                "n_bytes": n_bytes,
                "bits_per_byte": total_bits / n_bytes,
            }
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scored, schema)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), held)


QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLES: dict[str, str] = {}

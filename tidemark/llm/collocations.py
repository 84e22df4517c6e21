"""Phrase collocations by dynamic itemset counting.

The corpus is encoded once into blocks of word numbers, and blocks are dealt to ``SHARDS`` shards.
Steps scan one shard after another, again and again. Words are counted from the first step on. A
two-word phrase is counted from the step after both words reached the threshold, a three-word
phrase from the step after both of its pairs did; each ends when it has seen every shard once.
So one scan counts phrases of several lengths, and most are done long before a pass for each
length would be.

A shard's blocks ask for the numbers of the words that have reached the threshold by a join on
their own vocabularies, not on their tokens. Phrases are exact whole-number keys. Whether pairs
have reached the threshold is asked of two Bloom filters of at most ``MAX_BITS`` bits each: what
they let through besides is counted too, only earlier or in vain, and never twice for a shard, as
every phrase keeps the shards that it has seen; they lose nothing. So results are exact.

Words, pieces and scores are as ``score`` says. Phrases have two or three words.

Cases: null and empty texts have no words; a null language is ``und``; very long texts are a block
of their own and counted whole; equal rows count each; an empty table gives no rows; phrases tie
by score, occurrences and then their bytes; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_ROWS, batches_of, discard, release, shared_folder, table, written

MINIMUM, OVERLAP, TOP, SHARDS = 10, 50, 2000, 2
#: Bytes of text after which a block ends.
BLOCK_BYTES = 8 << 20
#: Bits of a Bloom filter: at most, and for each of its keys.
MAX_BITS, KEY_BITS = 1 << 28, 16
#: Numbers of words are below this, so that two make a key.
MAX_WORDS = 1 << 31
#: Parts of a language whose first rows are sought apart.
SALTS = 64
_LOWER = bytes((c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c) for c in range(256))
_BLOCKS = "kind int, shard int, block long, tokens binary, lang string, word binary, local int, n long"


def encode_texts(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of words from 1 (0 between pieces), the distinct words, and their counts."""
    a = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    inside = (a != 32) & (a != 10)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype("<i8")
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])])
    coded = words.dictionary_encode()
    local = coded.indices.to_numpy().astype(np.int32) + 1
    lines = np.cumsum(a == 10, dtype=np.int32)[starts]
    return np.insert(local, np.flatnonzero(np.diff(lines)) + 1, 0), coded.dictionary, np.bincount(local, minlength=len(coded.dictionary) + 1)[1:]


def _encode(shards: int):
    import zstandard

    def flush(block: int, texts: dict[str, list[bytes]]):
        tokens, base = [], 0
        shard = (block + (block >> 24)) % shards
        for lang, own in sorted(texts.items()):
            local, words, counts = encode_texts(own)
            k = len(words)
            if k:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([1] * k, pa.int32()), pa.array([shard] * k, pa.int32()), pa.array([block] * k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([lang] * k), words.cast(pa.binary()), pa.array(np.arange(base + 1, base + k + 1, dtype=np.int32)), pa.array(counts.astype(np.int64))],
                    names=[x.split()[0] for x in _BLOCKS.split(", ")],
                )
                tokens += [np.where(local > 0, local + base, 0).astype("<i4"), np.zeros(1, "<i4")]
                base += k
        if base:
            blob = zstandard.ZstdCompressor(level=1).compress(np.concatenate(tokens).tobytes())
            yield pa.RecordBatch.from_pylist([{"kind": 0, "shard": shard, "block": block, "tokens": blob}], schema=_arrow_schema())

    def run(batches):
        block, size, texts = TaskContext.get().partitionId() << 24, 0, {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from flush(block, texts)
                    block, size, texts = block + 1, 0, {}
                    release()
        yield from flush(block, texts)
        release()

    return run


def _arrow_schema() -> pa.Schema:
    return pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("lang", pa.string()), ("word", pa.binary()), ("local", pa.int32()), ("n", pa.int64())])


def encoded(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Blocks ``shard, block, tokens`` and their vocabularies ``shard, block, lang, word, local, n``."""
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    with batches_of(spark, BATCH_ROWS):
        texts.mapInArrow(_encode(shards), _BLOCKS).write.option("compression", "zstd").partitionBy("kind", "shard").parquet(path)
    read = lambda kind: spark.read.schema(_BLOCKS).parquet(path).filter(F.col("kind") == kind)
    return read(0).select("shard", "block", "tokens"), read(1).select("shard", "block", "lang", F.col("word").cast("string").alias("word"), "local", "n")


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bits of a Bloom filter of ``bits`` (a power of two) for each key."""
    out, h = [], keys.astype(np.uint64)
    for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(m)
        out.append((h >> np.uint64(35)) & np.uint64(bits - 1))
    return out


def has(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for p in places(keys, 64 * len(bloom)):
        found &= (bloom[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))).astype(np.uint64) & np.uint64(1) == 1
    return found


def blooms(pairs: DataFrame, n: int, recent_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Filters over all pairs ``a, reach`` and over those that reached the threshold since ``recent_from``."""
    bits = max(1 << 16, min(MAX_BITS, 1 << (KEY_BITS * max(n, 1) - 1).bit_length()))

    def part(batches):
        for batch in batches:
            a, recent = batch.column(0).to_numpy(), batch.column(1).to_numpy() >= recent_from
            at = np.concatenate(places(a, bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            which, inverse = np.unique(word, return_inverse=True)
            every, late = np.zeros(len(which), np.uint64), np.zeros(len(which), np.uint64)
            np.bitwise_or.at(every, inverse, bit)
            np.bitwise_or.at(late, inverse, np.where(np.tile(recent, 3), bit, np.uint64(0)))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(every.view(np.int64)), pa.array(late.view(np.int64))], names=["w", "every", "late"])

    rows = pairs.select("a", "reach").mapInArrow(part, "w long, every long, late long").groupBy("w").agg(F.bit_or("every").alias("every"), F.bit_or("late").alias("late")).toArrow()
    out = np.zeros((2, bits // 64), np.uint64)
    for k, name in enumerate(("every", "late")):  # at most MAX_BITS / 64 rows
        out[k, rows.column("w").to_numpy()] = rows.column(name).to_numpy().view(np.uint64)
    return out[0], out[1]


def _count(step: int, shards: int, filters):
    """Counts a block's phrases that are active in this step: ``a, b, until, n`` (b: the third word or 0)."""
    import zstandard

    def run(blocks: pa.Table, known: pa.Table) -> pa.Table:
        a, b, until, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for blob in blocks.column("tokens").to_pylist() if known.num_rows else ():
            tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i4")
            number, reach = np.zeros(int(tokens.max()) + 1, np.int64), np.zeros(int(tokens.max()) + 1, np.int32)
            local = known.column("local").to_numpy()
            number[local], reach[local] = known.column("id").to_numpy(), known.column("reach").to_numpy()
            ids, since = number[tokens], reach[tokens]
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            pairs, inverse = np.unique((ids[:-1][both] << 32) | ids[1:][both], return_inverse=True)
            last = np.zeros(len(pairs), np.int32)
            last[inverse] = np.maximum(since[:-1], since[1:])[both]
            active = last >= step - shards
            a.append(pairs[active])
            b.append(np.zeros(active.sum(), np.int32))
            until.append(last[active] + shards)
            n.append(np.bincount(inverse, minlength=len(pairs))[active])
            if filters is not None and len(pairs):
                every, late = (has(f, pairs) for f in filters.value)
                at = np.full(len(both), -1, np.int64)
                at[both] = inverse
                first, second = at[:-1], at[1:]
                three = (first >= 0) & (second >= 0)
                three[three] = every[first[three]] & every[second[three]] & (late[first[three]] | late[second[three]])
                codes, where, many = np.unique(first[three] * (len(number) + 1) + tokens[2:][three], return_index=True, return_counts=True)
                a.append(pairs[first[three][where]])
                b.append(ids[2:][three][where].astype(np.int32))
                until.append(np.full(len(codes), 3 * shards, np.int32))
                n.append(many)
        release()  # what the block before has left
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "until": np.concatenate(until), "n": np.concatenate(n)})

    return run


def _reached_words(counts: DataFrame, state: DataFrame | None, step: int, minimum: int, base: int) -> tuple[DataFrame, DataFrame, int]:
    """The words' new state and those that reached the threshold now, with numbers from ``base`` on."""
    rows = counts.select("lang", "word", "n", F.lit(None).cast("int").alias("reach"))
    rows = rows if state is None else rows.unionByName(state.select("lang", "word", "n", "reach"))
    rows = rows.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.min("reach").alias("reach"))
    rows = rows.withColumn("reach", F.coalesce("reach", F.when(F.col("n") >= minimum, F.lit(step)))).withColumn("part", F.spark_partition_id())
    state = written(rows)
    new = state.filter(F.col("reach") == step)
    per = sorted((r["part"], r["count"]) for r in new.groupBy("part").count().collect())  # a number for each partition
    starts, total = [], base
    for part, n in per:
        starts.append((part, total))
        total += n
    if total >= MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} words reach the threshold")
    first = F.broadcast(state.sparkSession.createDataFrame(starts, "part int, first long"))
    number = F.col("first") + F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    return state, written(new.join(first, "part").select("lang", "word", number.alias("id"), "reach")), total


def _merged(counts: DataFrame, state: DataFrame | None, step: int, shards: int, minimum: int) -> DataFrame:
    """Adds a step's counts to ``a, b, n, seen, until, reach``, but for a shard that a phrase has seen."""
    bit = 1 << (step % shards)
    rows = counts.select("a", "b", F.lit(0).cast("long").alias("n"), F.lit(0).alias("seen"), "until", F.lit(None).cast("int").alias("reach"), F.col("n").alias("now"))
    rows = rows if state is None else rows.unionByName(state.withColumn("now", F.lit(0).cast("long")))
    rows = rows.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("seen").alias("seen"), F.max("until").alias("until"), F.min("reach").alias("reach"), F.sum("now").alias("now"))
    fresh = (F.col("now") > 0) & (F.col("seen").bitwiseAND(F.lit(bit)) == 0)
    rows = rows.withColumn("n", F.col("n") + F.when(fresh, F.col("now")).otherwise(0)).withColumn("seen", F.when(fresh, F.col("seen").bitwiseOR(F.lit(bit))).otherwise(F.col("seen")))
    rows = rows.withColumn("reach", F.coalesce("reach", F.when(F.col("n") >= minimum, F.lit(step)))).drop("now")
    return rows.filter((F.col("n") >= minimum) | (F.col("until") > step))


def count_phrases(docs: DataFrame, minimum: int = MINIMUM, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words ``id, lang, word, f``, frequent phrases ``a, b, f``, and ``lang, n``."""
    spark = docs.sparkSession
    blocks, vocabulary = encoded(docs, shards)
    words = phrases = None
    known: list[DataFrame] = []
    numbers, step, last_word, last_pair, pairs = 0, 0, -shards - 1, -shards - 1, 0
    while step < shards or max(last_word, last_pair) >= step - shards:
        own = vocabulary.filter(F.col("shard") == step % shards)
        if known and max(last_word, last_pair) >= step - shards:
            look = own.join(_union(known), ["lang", "word"]).select("block", "local", "id", "reach")
            filters = None
            if last_pair >= step - shards:
                filters = spark.sparkContext.broadcast(blooms(phrases.filter("b = 0 AND reach IS NOT NULL"), pairs, step - shards))
            each = blocks.filter(F.col("shard") == step % shards).select("block", "tokens").groupBy("block").cogroup(look.groupBy("block"))
            before, phrases = phrases, written(_merged(each.applyInArrow(_count(step, shards, filters), "a long, b int, until int, n long"), phrases, step, shards, minimum))
            if before is not None:
                discard(before)
            if filters is not None:
                filters.destroy()
            new = phrases.filter("b = 0 AND reach IS NOT NULL").agg(F.count("*").alias("n"), F.max("reach").alias("r")).first()
            pairs, last_pair = new["n"], new["r"] if new["r"] is not None else last_pair
        if step < shards:
            before, had = words, numbers
            words, new, numbers = _reached_words(own.groupBy("lang", "word").agg(F.sum("n").alias("n")), words, step, minimum, numbers)
            if before is not None:
                discard(before)
            if numbers > had:
                known.append(new)
                last_word = step
        step += 1
    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))
    if phrases is None:
        phrases = spark.createDataFrame([], "a long, b int, n long")
    if not known:
        return spark.createDataFrame([], "id long, lang string, word string, f long"), phrases.select("a", "b", F.col("n").alias("f")), sizes
    frequent = _union(known).join(words.select("lang", "word", F.col("n").alias("f")), ["lang", "word"])
    return frequent.select("id", "lang", "word", "f"), phrases.filter(F.col("n") >= minimum).select("a", "b", F.col("n").alias("f")), sizes


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def score(words: DataFrame, phrases: DataFrame, sizes: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases that no longer one covers.

    The score of a cut is floor(1000000 * a * a / (l * r)) for the phrase's, the first part's and
    the rest's occurrences; the lowest cut counts, then the earliest.
    """
    first, low = F.shiftright("a", 32), F.col("a").bitwiseAND(F.lit(0xFFFFFFFF))
    word = lambda x: F.shiftleft(x.cast("long"), 32)
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    behind = word(low).bitwiseOR(F.col("b").cast("long"))
    cuts = F.when(F.col("b") == 0, F.array(cut(1, word(first), word(low)))).otherwise(F.array(cut(1, word(first), behind), cut(2, F.col("a"), word(F.col("b")))))
    parts = phrases.filter("b = 0").select(F.col("a").alias("key"), "f").unionByName(words.select(word(F.col("id")).alias("key"), "f"))
    side = lambda name, value: parts.select(F.col("key").alias(name), F.col("f").alias(value))
    rows = phrases.select("a", "b", "f", F.explode(cuts).alias("c")).select("a", "b", "f", "c.*").join(side("left", "l"), "left").join(side("right", "r"), "right")
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    value = F.call_function("div", wide("f") * wide("f") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    best = rows.groupBy("a", "b", "f").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("best"))
    covers = phrases.filter("b <> 0").select(F.explode(F.array("a", behind)).alias("a"), "f").groupBy("a").agg(F.max("f").alias("cover"))
    covers = covers.withColumn("b", F.lit(0))
    kept = best.join(covers, ["a", "b"], "left").filter(F.col("cover").isNull() | (100 * F.col("cover") < overlap * F.col("f")))
    name = lambda k: words.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), *([F.col("lang")] if k == 1 else []))
    kept = kept.withColumns({"i1": first, "i2": low, "i3": F.col("b").cast("long")}).join(name(1), "i1").join(name(2), "i2").join(name(3), "i3", "left")
    return kept.join(sizes, "lang").select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")


def top(scored: DataFrame, most: int = TOP) -> DataFrame:
    """Each language's first rows with ``rank``: firsts of ``SALTS`` parts, then of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    firsts = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= most)
    ranked = firsts.drop("salt", "place").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= most)


def collocations(docs: DataFrame, minimum: int = MINIMUM, overlap: int = OVERLAP, most: int = TOP, shards: int = SHARDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's strongest phrases."""
    return top(score(*count_phrases(docs, minimum, shards), overlap), most)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_CTES = rf"""
p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
f AS MATERIALIZED (SELECT lang, phrase, 1 AS k, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w) AS phrase FROM w) GROUP BY ALL
      UNION ALL SELECT lang, phrase, 2, count(*) FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM w) GROUP BY ALL
      UNION ALL SELECT lang, phrase, 3, count(*) FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM w) GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= {MINIMUM}),
u AS (SELECT lang, phrase, k, a, 1 AS cut, ws[1] AS p, CASE WHEN k = 2 THEN ws[2] ELSE ws[2] || ' ' || ws[3] END AS q FROM c
      UNION ALL SELECT lang, phrase, k, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
v AS (SELECT u.lang, u.phrase, u.k, a, cut, x.f AS l, y.f AS r, {1_000_000} * a * a // (x.f * y.f) AS score FROM u
      JOIN f x ON x.lang = u.lang AND x.phrase = p JOIN f y ON y.lang = u.lang AND y.phrase = q),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a AS f FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(f) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
z AS (SELECT b.*, n.n FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase JOIN n ON n.lang = b.lang WHERE m.f IS NULL OR 100 * m.f < {OVERLAP} * a)"""
_SQL = f"""WITH {_CTES} SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= {TOP}"""

QUERIES = {"op13_collocations": op13_collocations}
ORACLES = {"op13_collocations": _SQL}

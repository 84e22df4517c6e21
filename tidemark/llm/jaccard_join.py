"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. Two sets of similarity t differ in at
most (1 - t) / (1 + t) of the sum of their sizes. So, per band of sizes, tokens are dealt by
hash to more buckets than a linked pair can differ in; each bucket is sketched by XOR. A
pair that links has at least one bucket, and one that is not empty, with the same sketch:
these are the join keys (see ``join_keys`` for documents with too many empty buckets). A longer
parity sketch, whose Hamming distance is never above the sets' difference, rejects pairs
early; texts of the rest are compared exactly.

Equal sets are one class first. Every class is compared with one other, of those that are the
smallest of its keys' groups the one it meets most often; what components leave apart is then
compared class by class across components of a group, in chunks of bounded size. No other pairs are formed, and no link that joins
two components is lost. Null and empty texts have size 0 and link with nothing. Repeated
rows are of one class. Rows without doc_id have a null component.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, table, written

SHINGLE, PERCENT = 3, 90
#: Sizes of a band differ by this factor; least spare buckets; ways to deal tokens to buckets; bits of the long sketch for each token.
BAND_RATIO, SPARE, SEEDS, SKETCH_BITS = 1.5, 2, 24, 4
#: Larger groups of a key are compared in numpy; so many members at a time with as many others.
FEW, CHUNK = 32, 2000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
MAX_KNOWN = 300_000
#: Ids whose texts are wanted are broadcast up to this count (8 MB), and shuffled beyond it.
MAX_BROADCAST = 1_000_000
PAIRS_AT_A_TIME = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], size: int) -> set:
    """The document's set; the whole sequence where it is shorter than a shingle."""
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)}  # noqa: B905


class Hasher:
    """Shingle hashes, with a bounded memory of words."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > MAX_KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if not len(h):
            return h
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, np.uint64(n))
        for i in range(n):
            out = mix(out * _K[0] + h[i : len(h) - n + 1 + i])
        return np.unique(out)


@functools.lru_cache(maxsize=8)
def band_edges(most: int = 1 << 40) -> np.ndarray:
    edges = [1]
    while edges[-1] < most:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
    return np.array(edges, np.int64)


def bands_of(n: int, percent: int) -> list[int]:
    """The size's own band and the larger ones that a partner may be in."""
    edges = band_edges()
    own = int(np.searchsorted(edges, n, "right")) - 1
    out = [own]
    while 100 * n >= percent * edges[out[-1] + 1]:
        out.append(out[-1] + 1)
    return out


@functools.lru_cache(maxsize=1024)
def band_buckets(band: int, percent: int) -> tuple[int, int]:
    """Buckets of a band and how many of a document's may be empty.

    So many buckets that the smallest set with a partner in the band leaves no more of them
    empty than that, three deviations included.
    """
    d = (100 - percent) * 2 * (int(band_edges()[band + 1]) - 1) // (100 + percent)
    if not d:
        return 1, 0
    n, k = max(1, percent * int(band_edges()[band]) // 100), d + 1 + SPARE
    while k <= d + d // 2:  # beyond, buckets hold single tokens; the few sets that fail try other seeds
        empty = math.exp(-n / k)
        if k * empty + 3 * math.sqrt(k * empty * (1 - empty)) <= k - d - 1:
            break
        k += 1 + k // 64
    return k, k - d - 1


def most_different(n: int, band: int, percent: int) -> int:
    """Tokens that a set of ``n`` and a linked one of the band, or of its own and not smaller, may differ in."""
    most = min(int(band_edges()[band + 1]) - 1, 100 * n // percent)
    return (100 - percent) * (n + max(n, most)) // (100 + percent)


def join_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set of token hashes, at least one of them shared with any set that links.

    Of a band's buckets the first ones do: as many as the set may differ in from its largest
    partner there, and one more, and the spare ones. A set with more empty buckets than spare ones
    deals its tokens once more by another seed, and so on: of two sets, the one that ends first
    shares a full bucket with the other by its last seed. Empty buckets are keys only after the
    last of the seeds.
    """
    out = []
    for band in bands_of(len(h), percent):
        k, spare = band_buckets(band, percent)
        used = min(k, most_different(len(h), band, percent) + 1 + spare)
        for seed in range(SEEDS):
            g = mix(h + np.uint64(seed * int(_K[2]) % 2**64)) if seed else h
            bucket = ((g >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            inside = np.flatnonzero(bucket < used)
            order = inside[np.argsort(bucket[inside], kind="stable")]
            b = bucket[order]
            first = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else b
            full, sketch = b[first], np.bitwise_xor.reduceat(mix(h[order]), first) if len(b) else h[:0]
            enough = used - len(full) <= spare
            if not enough and seed == SEEDS - 1:
                none = np.setdiff1d(np.arange(used), full)
                full, sketch = np.append(full, none), np.append(sketch, np.zeros(len(none), np.uint64))
            out.append(mix(sketch ^ mix(np.array([band + (seed << 16)], np.uint64) * _K[0] + full.astype(np.uint64))))
            if enough:
                break
    return np.concatenate(out).view(np.int64)


def parity_sketch(h: np.ndarray) -> bytes:
    """A power of two of bits, ``SKETCH_BITS`` a token at least; each token flips one.

    The halves of a sketch, XORed, are the sketch of half the length.
    """
    bits = max(512, 1 << (SKETCH_BITS * len(h) - 1).bit_length())
    odd = np.bincount((mix(h ^ _K[0]) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint64)
    while x.nbytes > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def difference(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded: at most the sets' difference."""
    size = min(len(a), len(b))
    x, y = folded(a, size), folded(b, size)
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def sketched(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``doc_id, n, sig, most, sketch, keys`` of every document; most: the largest size of its band."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        hasher = Hasher(shingle)
        for f in frames:
            rows = []
            for key, text in zip(f["doc_id"], f["text"], strict=True):
                h = hasher(words_of(text))
                if len(h):
                    most = int(band_edges()[bands_of(len(h), percent)[0] + 1]) - 1
                    rows.append((key, len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), most, parity_sketch(h), join_keys(h, percent)))
                else:
                    rows.append((key, 0, None, None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "sig", "most", "sketch", "keys"]).astype({"most": "Int64"})
            yield out.assign(doc_id=f["doc_id"].to_numpy() if not f["doc_id"].hasnans else out["doc_id"].astype("Int64"))

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n long, sig binary, most long, sketch binary, keys array<long>")


def texts_of(docs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, text`` of the documents that the pairs ``a, b`` name; the table of their ids."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    side = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids
    # dealt by id once: both joins with the pairs use that exchange
    return docs.select(F.col("doc_id").alias("id"), "text").join(side, "id").dropDuplicates(["id"]), ids


def linked(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose texts link, written out."""
    pairs = written(pairs)
    texts, ids = texts_of(docs, pairs)

    def run(frames):
        sets: dict = {}

        def of(key, text):
            if key not in sets:
                if len(sets) > 100:
                    sets.clear()
                sets[key] = shingles(words_of(text), shingle)
            return sets[key]

        for f in frames:
            keep = []
            for a, b, x, y in zip(f["a"], f["b"], f["text_a"], f["text_b"], strict=True):
                p, q = of(a, x), of(b, y)
                common = len(p & q)
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield f.loc[keep, ["a", "b"]]

    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    # rows hold two whole texts: few of them at a time, whatever their length
    found = written(full.mapInPandas(run, "a long, b long"), PAIRS_AT_A_TIME)
    discard(pairs, ids)
    return found


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id in ``edges`` (``a, b``).

    Large-star and small-star rounds, until nothing changes; each round is written out.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        # large star: neighbours above a node are tied to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        last, now = now, written(small.filter("a <> b").distinct())
        discard(last)
        state = now.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before:
            break
        before = state
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("id"), "component").unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def differ_at_most(a: str, b: str, percent: int) -> Column:
    """Tokens that two linked sets of so many may differ in."""
    return F.floor((100 - percent) * (F.col(a) + F.col(b)) / (100 + percent))


def sizes_allow(percent: int) -> Column:
    """A link's sizes ``n_a, n_b`` are no further apart than this."""
    return percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b")


def across(groups: DataFrame, sketches: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of different components inside the groups (``key, id, component, n, most``) that the sketches allow.

    Small groups are joined with themselves; larger ones are compared in numpy, chunk by chunk.
    A pair that has no larger group in common must share as many keys as the smaller set has
    buckets in the larger one's band, without those that the two may differ in. Also the
    table that the pairs are read from.
    """
    apart = groups.groupBy("key").agg(F.count("*").alias("g"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    rows = written(groups.join(apart.select("key", "g"), "key"))
    few, many = rows.filter(F.col("g") <= FEW), rows.filter(F.col("g") > FEW)
    names = ("id", "component", "n", "most")
    one, other = (few.select("key", *[F.col(x).alias(f"{x}_{c}") for x in names]) for c in ("a", "b"))
    met = one.join(other, "key").filter("id_a > id_b AND component_a <> component_b").filter(sizes_allow(percent))
    met = met.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n_a", "n_b", "most_a", "most_b")])
    # the smaller set's largest partner in the band of the larger one
    met = met.withColumns({"low": F.least("n_a", "n_b"), "top": F.when(F.col("n_a") > F.col("n_b"), F.col("most_a")).otherwise(F.col("most_b"))})
    met = met.withColumn("top", F.greatest("low", F.least("top", F.floor(100 * F.col("low") / percent))))
    enough = F.col("c") > differ_at_most("low", "top", percent) - differ_at_most("n_a", "n_b", percent)
    # a pair that also meets in a larger group may show fewer keys here, and is compared there
    small = met.filter(enough).select("a", "b")
    found = allowed(small, sketches, percent).unionByName(_between_chunks(many, sketches, percent)).distinct()
    return found, rows


def allowed(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches differ in no more bits than a link may differ in tokens."""

    def run(frames):
        for f in frames:
            differ = np.array([difference(x, y) for x, y in zip(f["sketch_a"], f["sketch_b"], strict=True)], np.int64)
            keep = (100 + percent) * differ <= (100 - percent) * (f["n_a"] + f["n_b"]).to_numpy(np.int64)
            yield f.loc[keep, ["a", "b"]]

    for c in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
    return pairs.filter(sizes_allow(percent)).mapInPandas(run, "a long, b long")


def _between_chunks(groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    rows = groups.select("key", "id", "component", "g").join(sketches.select("id", "n", "sketch"), "id")
    chunks = F.ceil(F.col("g") / CHUNK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates("id").sort_values("id")
        ids, comp, n = f["id"].to_numpy(), f["component"].to_numpy(), f["n"].to_numpy(np.int64)
        shortest = min(map(len, f["sketch"]))
        bits = np.stack([folded(s, shortest) for s in f["sketch"]])
        found = []
        for i in range(len(ids) - 1):
            rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            if len(rest):
                differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(1, dtype=np.int64)
                possible = rest[(100 + percent) * differ <= (100 - percent) * (n[rest] + n[i])]
                found += [(ids[j], ids[i]) for j in possible]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long")


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document of ``doc_id, text``."""
    rows = written(sketched(docs, shingle, percent))
    some = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("sig").agg(F.min("doc_id").alias("id")))
    # one document stands for each class: the smallest, or any equal row of it
    first = some.join(classes, "sig").filter("doc_id = id")  # rows may repeat
    sketches = written(first.select("id", "n", "most", "sketch").dropDuplicates(["id"]))
    # one exchange by key serves both the smallest ids and the join with them
    keys = first.select("id", F.explode("keys").alias("key")).repartition("key")
    shared = keys.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep < last").select("key", "rep")
    groups = written(keys.join(shared.hint("shuffle_hash"), "key"))
    sizes = written(rows.select("doc_id", "n", "sig"))
    discard(rows)
    # at first each class meets the one it shares most keys with; what that leaves apart meets all
    common = groups.filter("id <> rep").groupBy("id", "rep").agg(F.count("*").alias("c"))
    best = common.groupBy("id").agg(F.max(F.struct("c", (-F.col("rep")).alias("b"))).alias("m"))
    pairs = best.select(F.col("id").alias("a"), (-F.col("m.b")).alias("b"))
    links = linked(allowed(pairs, sketches, percent), docs, shingle, percent)
    labels = written(components(links))
    nodes = sketches.select("id", "n", "most").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = written(groups.select("key", "id").join(nodes, "id"))
    discard(groups)
    rest, grouped = across(labelled, sketches, percent)
    more = linked(rest, docs, shingle, percent)
    discard(labelled, grouped, sketches)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    of_class = classes.join(labels, "id", "left").select("sig", F.coalesce("component", "id").alias("component"))
    full = sizes.join(of_class, "sig", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
r AS (SELECT doc_id AS a, doc_id AS m FROM w UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.a WHERE r.m < e.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.m) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id GROUP BY ALL"""

QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLES = {"op10_ngram_jaccard": _SQL}

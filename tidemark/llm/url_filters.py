"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Level 1 holds the listed keys; level 2 those other keys of the corpus that level 1 lets
pass wrongly; level 3 the listed keys that level 2 lets pass, and so on until no key
passes wrongly. As the levels are built over every key that the corpus has, a key is
listed exactly if the first level that lacks it is an even one. A test reads a few bits
and needs no join.

Null or malformed URLs have an empty host and path; the empty host is an ordinary key.
Repeated rows give repeated results. Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_name, shared_folder, table, written

#: Bits for each key and hash functions of a level: about one key in 100 passes wrongly.
BITS_PER_KEY, HASHES = 10, 7
#: A level of more 64-bit words than this (8 MB) is not sent with the tasks; keys are then
#: split into shards by hash, each shard's levels stay under the limit, and a job of its own
#: tests the rows of each shard, so that no task gets the words of two.
MAX_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query, and the terms that mark a listed host.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
LISTED_TERMS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"))).otherwise(found)
    return found


def _bit(key: Column, level: int, hash_no: int, bits: int) -> Column:
    """Position of a key's bit by double hashing."""
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    step = F.pmod(b, F.lit(bits - 1)) + 1
    return F.pmod(F.pmod(a, F.lit(bits)) + F.lit(hash_no) * step, F.lit(bits))


def _level(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row ``words array<bigint>``: the level's bits."""
    at = F.explode(F.array_distinct(F.array(*[_bit(F.col("key"), level, h, bits) for h in range(HASHES)])))
    at = keys.select(at.alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
    word = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(bit).alias("bits"))
    blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("bits"))
    dense = word.unionByName(blank).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("s")).select(F.transform("s", lambda x: x["bits"]).alias("words"))


def _has(words: Column, key: Column, level: int, bits: int) -> Column:
    test = F.lit(True)
    for h in range(HASHES):
        at = _bit(key, level, h, bits)
        word = F.get(words, F.floor(at / 64).cast("int"))
        test = test & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
    return test


@dataclass
class Cascade:
    """Levels of one shard count; ``test`` is exact for each key of the universe."""

    spark: SparkSession
    shards: int
    levels: list[list[tuple[int, str]]]  # by shard: bits and the folder of each level's row

    def shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.shards)).cast("int")

    def test(self, key: Column, shard: int = 0) -> Column:
        """Whether a key of this shard is listed; reads the words of this shard alone."""
        levels = self.levels[shard]
        inside = F.lit(len(levels) % 2 == 1)
        for n in reversed(range(len(levels))):
            bits, frame = levels[n]
            inside = F.when(_has(frame.scalar(), key, n, bits), inside).otherwise(F.lit(n % 2 == 1))
        return inside

    def mark(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the test of their column ``key`` under ``name``.

        One shard is tested in place. Of several, rows are written by shard once; each shard's
        are then read, tested and written by a job that carries that shard's words only.
        """
        if self.shards == 1:
            return rows.withColumn(name, self.test(F.col(key)))
        at, top = free_name(rows, "shard"), shared_folder(self.spark)
        dealt = rows.withColumn(at, self.shard(F.col(key)))
        dealt.write.option("compression", "zstd").partitionBy(at).parquet(f"{top}/dealt")
        for shard in range(self.shards):
            mine = self.spark.read.schema(dealt.schema).parquet(f"{top}/dealt").filter(F.col(at) == shard).drop(at)
            mine.withColumn(name, self.test(F.col(key), shard)).write.option("compression", "zstd").parquet(f"{top}/tested/shard={shard}")
        return self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())])).option("recursiveFileLookup", True).parquet(f"{top}/tested")


def build_cascade(universe: DataFrame) -> Cascade:
    """Builds the levels from rows ``key string, listed boolean``, one for each key there is."""
    spark = universe.sparkSession
    keys = written(universe.groupBy("key").agg(F.bool_or("listed").alias("listed")))
    listed = keys.filter("listed").count()
    shards = max(1, math.ceil(listed * BITS_PER_KEY / 64 / MAX_WORDS))
    levels: list[list] = []
    if shards > 1:  # dealt out once, so that a shard's job reads its own keys only
        path, dealt = shared_folder(spark), keys.withColumn("shard", Cascade(spark, shards, []).shard(F.col("key")))
        dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    for shard in range(shards):
        mine = keys if shards == 1 else spark.read.schema(dealt.schema).parquet(path).filter(F.col("shard") == shard)
        into, others, own = mine.filter("listed").select("key"), mine.filter(~F.col("listed")).select("key"), []
        count = into.count()
        while count:
            bits = 64 * max(2, math.ceil(count * BITS_PER_KEY / 64))
            row = written(_level(into, len(own), bits))
            own.append((bits, row))
            wrong = written(others.filter(_has(row.scalar(), F.col("key"), len(own) - 1, bits)))
            into, others, count = wrong, into, wrong.count()
        levels.append(own)
    return Cascade(spark, shards, levels)


def judge(pages: DataFrame, listed: Column | DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of the rows of ``pages`` (``page_id``, ``url``).

    ``listed`` is the block list: a table with a column ``key`` (hosts, lower case; nulls and
    repeated keys do no harm), or an expression that tells of a column ``key`` whether it is
    listed. It is asked once for each distinct host, and the cascade then stands for it. Other
    columns of ``pages`` are not taken, so that none can clash. Of rules of equal length that
    fit, the one greater in text order wins.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = rows.select(F.col("host").alias("key"))
    if isinstance(listed, DataFrame):
        own = listed.select(F.col("key").cast("string"), F.lit(True).alias("listed"))
        # a listed host without pages is no key of the universe
        both = own.unionByName(hosts.withColumn("listed", F.lit(False))).groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_and("listed").alias("alone"))
        universe = both.filter("NOT alone").select("key", "listed")
    else:
        universe = hosts.distinct().withColumn("listed", F.coalesce(listed, F.lit(False)))
    rows = build_cascade(universe).mark(rows, "host", "listed")
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.action"), method).alias("verdict"))


def _pattern(terms: tuple[str, ...]) -> str:
    return r"(^|\.)(" + "|".join(terms) + r")\."


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), F.col("key").rlike(_pattern(LISTED_TERMS)))


def _sql() -> str:
    fits = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(RULES, key=lambda r: -len(r.text))]
    rule = " ".join(f"WHEN {f} THEN '{r.text}'" for r, f in fits)
    action = " ".join(f"WHEN {f} THEN '{r.action}'" for r, f in fits)
    return f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {action} WHEN regexp_matches(host, '{_pattern(LISTED_TERMS)}') THEN 'block' ELSE 'allow' END AS verdict
FROM h"""


QUERIES = {"op9_url_filters": op9_url_filters}
ORACLES = {"op9_url_filters": _sql()}

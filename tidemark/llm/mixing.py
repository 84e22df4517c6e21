"""Mixing sources to target weights by systematic sampling.

Sources are ranked by code point, null last, and weigh ``WEIGHTS`` in turn. They share the words
of the whole table by weight; a source gets at most ``MOST`` times its own words, and what that
leaves over goes to the others by weight, until none is above. Every document of a source then
expects the same number of copies, its target over its size. These expectations are summed up in
the order of size, a random offset is added, and a document is taken once for every whole number
that its own step crosses. In the order of size, the words taken differ from the target by less
than the source's longest document.

Rows go to ranges of (source, size, doc_id), so that a source with most of the rows is many
ranges; ranks are counts of the ranges before and places inside the own range. Copies are counted
in whole numbers of 2**-32, so that no rounding takes a document more than ``MOST`` times.

Cases: null and empty texts have size 0 and count as documents (``taken`` 0); a null source is one
source, the last; documents of equal size follow each other by ``doc_id``, equal rows are each a
document of their own; a table without words has targets 0; a table without rows gives none; very
long texts are counted whole; other columns are kept in a struct, so that none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, words, written

WEIGHTS, MOST, SEED, ONE = (5, 2, 1), 3, 17, 1 << 32


def word_count(text: str = "text") -> Column:
    return F.size(words(F.col(text))).cast("long")


def _rank(sources: DataFrame) -> DataFrame:
    """Sources with ``rank``, their place in the order of ``part`` and ``key``."""
    w = Window.orderBy("part")  # one row for each range
    first = sources.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(w) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return sources.withColumn("inside", inside).join(first, "part").withColumn("rank", F.col("before") + F.col("inside")).drop("before", "inside", "part")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``key, source_size, target, ratio`` (of copies, in ``ONE``s) from ``key, source_size, rank``.

    Each round of resharing is one sum over the sources; the driver holds two numbers.
    """
    one = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", one.cast("long"))
    wide = lambda c: c.cast("decimal(19,0)")
    whole, heft = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, over, before = whole, heft, None
    while over != before:
        above = wide(most * F.col("source_size")) * F.lit(max(over, 1)).cast("decimal(19,0)") < wide(F.col("weight")) * F.lit(left).cast("decimal(19,0)")
        row = sources.agg(F.coalesce(F.sum(F.when(above, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0))).first()
        before, left, over = over, whole - row[0], heft - row[1]
    share = wide(F.col("weight")) * F.lit(left).cast("decimal(19,0)")
    target = F.when(above, (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * left).cast("double") / float(max(over, 1)))
    # rounded down: the expected copies of a document, at most ``most``
    below = wide(F.col("source_size")) * F.lit(max(over, 1)).cast("decimal(19,0)")
    ratio = F.when(F.col("source_size") == 0, 0).when(above, most * ONE).otherwise(F.call_function("div", share * F.lit(ONE).cast("decimal(10,0)"), F.nullif(below, F.lit(0).cast("decimal(38,0)"))))
    return sources.select("key", "source_size", target.alias("target"), ratio.cast("long").alias("ratio"))


def plan(docs: DataFrame, size: Column, source: str = "source", order: str = "doc_id", keep: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``row`` (struct of ``keep``, all columns if None), ``size, source_size, target, copies``."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.concat(F.lit("a"), F.col(source)), F.lit("b"))  # null sorts last
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"), key.alias("key"), size.alias("size"), F.col(order).alias("order"))
    rows = written(rows.repartitionByRange(n, "key", "size", "order").withColumn("part", F.spark_partition_id()))
    groups = written(rows.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    sources = groups.groupBy("key").agg(F.sum("words").alias("source_size"), F.min("part").alias("part"))
    shares = written(targets(_rank(sources), weights, most))
    start = groups.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).join(shares, "key").select("key", "part", "before", "source_size", "target", "ratio")
    place = F.row_number().over(Window.partitionBy("part", "key").orderBy("size", "order")) - 1
    placed = rows.withColumn("place", place).join(start, ["part", "key"])
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("key"))), 1, 8), 16, 10).cast("decimal(20,0)")
    step = lambda k: F.call_function("div", offset + k.cast("decimal(19,0)") * F.col("ratio").cast("decimal(11,0)"), F.lit(ONE).cast("decimal(10,0)"))
    at = F.col("before") + F.col("place")
    return placed.select("row", "size", "source_size", "target", (step(at + 1) - step(at)).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each as often as it takes them."""
    taken = plan(docs, word_count(), **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), word_count(), keep=["doc_id"])
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_WATER = f"""
d AS (SELECT doc_id, coalesce('a' || source, 'b') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT key, CAST(sum(size) AS HUGEINT) AS size, [{', '.join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)} AS INTEGER) + 1]::HUGEINT AS weight FROM d GROUP BY key),
p AS (SELECT *, sum(size) OVER () - coalesce(sum({MOST} * size) OVER w, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS heft FROM s
      WINDOW w AS (ORDER BY CAST(size AS DOUBLE) / CAST(weight AS DOUBLE), key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT key, size, weight, {MOST} * size * heft < weight * lft AS above FROM p),
l AS (SELECT coalesce(sum(size) - coalesce(sum({MOST} * size) FILTER (above), 0), 0) AS lft, greatest(coalesce(sum(weight) FILTER (NOT above), 0), 1) AS heft FROM a),
t AS (SELECT key, size AS source_size, CASE WHEN above THEN CAST({MOST} * size AS DOUBLE) ELSE CAST(weight * lft AS DOUBLE) / CAST(heft AS DOUBLE) END AS target,
      CASE WHEN size = 0 THEN 0::HUGEINT WHEN above THEN {MOST * ONE}::HUGEINT ELSE CAST(weight * lft AS HUGEINT) * {ONE} // CAST(heft * size AS HUGEINT) END AS ratio,
      CAST(('0x' || md5('{SEED}-' || key)[1:8])::UBIGINT AS HUGEINT) AS u FROM a, l),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY size, doc_id NULLS FIRST) - 1 AS HUGEINT) AS k FROM d)"""
_SQL = f"WITH {_WATER} SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(((u + (k + 1) * ratio) // {ONE} - (u + k * ratio) // {ONE}) * size AS BIGINT) AS taken FROM r JOIN t USING (key)"

QUERIES = {"op12_mixing": op12_mixing}
ORACLES = {"op12_mixing": _SQL}

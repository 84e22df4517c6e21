"""Sources and sinks of impression logs.

Parts are committed: they are written aside, held in a manifest with their rows, bounds and
checksums, moved under their final names and marked as finished last.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = "site_id site_domain site_category app_id app_domain app_category device_id device_ip device_model banner_pos device_conn_type C14 C17 C20 C21".split()
RAW_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("click", T.ByteType()), T.StructField("hour", T.StringType()), *[T.StructField(c, T.StringType()) for c in STRINGS]])

_VIEW = """
event_id AS row_index, lpad(CAST(event_id AS STRING), 20, '0') AS id,
CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS click,
date_format(ts, 'yyMMddHH') AS hour, CAST(floor(unix_timestamp(ts) / 3600) AS BIGINT) AS hour_no,
CASE WHEN k < 40 THEN 'S_APP' WHEN k >= 95 AND ts >= TIMESTAMP '2024-01-30 00:00:00' THEN concat('site_new_', k) ELSE concat('site_', k % 20) END AS site_id,
CASE WHEN k < 40 THEN 'sd_none' ELSE concat('sd_', k % 8) END AS site_domain, concat('sc_', k % 4) AS site_category,
CASE WHEN k < 40 THEN concat('app_', k % 15) ELSE 'app_none' END AS app_id,
CASE WHEN k < 40 THEN concat('ad_', k % 6) ELSE 'ad_none' END AS app_domain, concat('ac_', k % 3) AS app_category,
CASE WHEN user_id % 3 = 0 THEN concat('dev_', user_id) ELSE 'D_UNKNOWN' END AS device_id,
concat('ip_', user_id % 60) AS device_ip, concat('model_', user_id % 11) AS device_model,
CAST(event_id % 3 AS STRING) AS banner_pos, CAST(user_id % 4 AS STRING) AS device_conn_type,
concat('c14_', k) AS C14, concat('c17_', k % 10) AS C17, concat('c20_', k % 7) AS C20, concat('c21_', k % 5) AS C21,
(k + 1) / 102.0D AS p1, (user_id % 97 + 1) / 99.0D AS p2
"""


def as_impressions(events: DataFrame) -> DataFrame:
    """The impression log that an ``events`` table stands for, with two predictions p1, p2."""
    parsed = events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))
    return parsed.selectExpr(*_split_expressions(_VIEW))


def _split_expressions(text: str) -> list[str]:
    """The select list, cut at the commas that stand outside brackets."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; ``scoring`` marks those of the last 24 hours, whose labels count as hidden."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    log = as_impressions(spark.read.parquet(f"{sf_dir}/events.parquet"))
    last = log.agg(F.max("hour_no").alias("h")).first()["h"]
    return log.withColumn("scoring", F.col("hour_no") >= F.lit((last or 0) - 23))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset, in local mode only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def scan_raw(spark: SparkSession, path: str | list[str], labelled: bool = True) -> DataFrame:
    """A CSV log under the fixed schema; the header is held against it, and missing columns raise."""
    schema = RAW_SCHEMA if labelled else T.StructType([f for f in RAW_SCHEMA if f.name != "click"])
    header = spark.read.text(path).first()
    missing = [f.name for f in schema if header and f.name not in header[0].split(",")]
    if missing:
        raise ValueError(f"the log lacks columns {missing}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _hadoop(spark, path)
    return store.exists(at)


def canonical(df: DataFrame, folder: str, fingerprint: str) -> DataFrame:
    """Converts once to zstd Parquet under the content's fingerprint; a finished copy is read again.

    Only ``_SUCCESS`` tells a finished copy: what a failed job has left is written anew.
    """
    spark, path = df.sparkSession, f"{folder}/{fingerprint}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def source_order(df: DataFrame, name: str = "source_index") -> DataFrame:
    """Numbers the rows of a file scan 0, 1, ... in the order of their files' paths and places.

    A split's rows follow each other in one task, so a row's place is its distance from the split's
    first row, and splits start at the prefix sums of those before: nothing is sorted but splits. A
    compressed file is one split; ``write_parts`` deals its rows out by their numbers afterwards.
    ``df`` must be the scan itself, with nothing that moves rows.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    # written once: both uses below see the same numbers
    df.select("*", split.alias("__split"), F.monotonically_increasing_id().alias("__at")).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    splits = rows.groupBy("__split").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    files = splits.groupBy(F.col("__split.file").alias("__file")).agg(F.sum("__n").alias("__rows"))
    files = files.select("__file", (F.sum("__rows").over(Window.orderBy("__file")) - F.col("__rows")).alias("__base"))  # a row for each file
    w = Window.partitionBy("__split.file").orderBy("__split.start")
    starts = splits.select("__split", "__first", (F.sum("__n").over(w) - F.col("__n")).alias("__own"), F.col("__split.file").alias("__file")).join(files, "__file")
    index = F.col("__base") + F.col("__own") + F.col("__at") - F.col("__first")
    # a row for each split; by the size of its packed files Spark may take the rows themselves for the small side
    return rows.join(F.broadcast(starts), "__split").select(*df.columns, index.alias(name))


def write_parts(df: DataFrame, path: str, index: str, rows: int) -> DataFrame:
    """Commits ``df`` as files ``part-00000.parquet``, ... of ``rows`` rows (the last may have fewer).

    ``index`` numbers the rows from 0 without gaps (``dense_index``, ``source_order``), which gives
    each part's exact bounds. Parts go to a staging folder first; their rows, bounds and checksums
    are read back from there into ``_manifest``; then files are moved, and ``_SUCCESS`` is set last.
    Returns the manifest. No rows, or numbers that are not 0, 1, ..., raise and leave nothing.
    """
    spark = df.sparkSession
    if exists(spark, f"{path}/_SUCCESS"):
        raise FileExistsError(path)
    span = df.agg(F.count("*").alias("n"), F.min(index).alias("a"), F.max(index).alias("b")).first()
    if not span["n"]:
        raise ValueError("there are no rows to write")
    if (span["a"], span["b"]) != (0, span["n"] - 1):
        raise ValueError(f"{index} does not number {span['n']} rows from 0")
    parts, stage = -(-span["n"] // rows), f"{path}/_staging-{uuid.uuid4().hex}"
    part = F.floor(F.col(index) / rows).cast("int")
    df.repartitionById(parts, part).sortWithinPartitions(index).write.option("compression", "zstd").parquet(stage)
    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)
    bounds = spark.read.parquet(stage).groupBy(file.alias("staged")).agg(F.count("*").alias("rows"), F.min(index).alias("first_row"), F.max(index).alias("last_row"), F.countDistinct(index).alias("n"))
    manifest = bounds.join(checksums(spark, stage).withColumnRenamed("file", "staged"), "staged").withColumn("part", F.floor(F.col("first_row") / rows).cast("int"))
    name = F.concat(F.lit("part-"), F.lpad(F.col("part").cast("string"), 5, "0"), F.lit(".parquet"))
    manifest.withColumn("file", F.when(F.col("part") > 99999, F.concat(F.lit("part-"), F.col("part"), F.lit(".parquet"))).otherwise(name)).write.parquet(f"{path}/_manifest")
    manifest = spark.read.parquet(f"{path}/_manifest")
    wrong = manifest.filter((F.col("n") != F.col("rows")) | (F.col("last_row") - F.col("first_row") + 1 != F.col("rows"))).count()
    if wrong or manifest.count() != parts:
        for left in (stage, f"{path}/_manifest"):
            at, store = _hadoop(spark, left)
            store.delete(at, True)
        raise ValueError(f"{index} repeats or lacks numbers")
    for r in manifest.select("staged", "file").toLocalIterator():  # a name for each part
        at, store = _hadoop(spark, f"{stage}/{r['staged']}")
        if not store.rename(at, _hadoop(spark, f"{path}/{r['file']}")[0]):
            raise OSError(f"cannot move {r['staged']}")
    at, store = _hadoop(spark, stage)
    store.delete(at, True)
    at, store = _hadoop(spark, f"{path}/_SUCCESS")
    store.create(at).close()
    return manifest.select("part", "file", "rows", "first_row", "last_row", "bytes", "sha256")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed parts; a folder without ``_SUCCESS``, or a part that its manifest does not have, raises."""
    if not exists(spark, f"{path}/_SUCCESS"):
        raise ValueError(f"{path} is not finished")
    known = spark.read.parquet(f"{path}/_manifest").select("file", "bytes", "sha256")
    now = checksums(spark, path, "part-*.parquet").select("file", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    off = known.join(now, "file", "full_outer").filter(~(F.col("b").eqNullSafe(F.col("bytes")) & F.col("s").eqNullSafe(F.col("sha256"))))
    bad = [r["file"] for r in off.select("file").orderBy("file").limit(5).collect()]
    if bad:
        raise ValueError(f"missing, new or altered parts: {bad}")
    return spark.read.option("pathGlobFilter", "part-*.parquet").parquet(path)


def dense_index(df: DataFrame, coarse: str, *order: str, name: str = "dense_index") -> DataFrame:
    """Numbers rows 0, 1, ... in the order of ``coarse`` and then ``order``.

    Rows are dealt out in ranges of that order and sorted there, once; a row's number is its place in
    its range and the rows of earlier ranges. So neither one hour nor one value is a task of its own.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, coarse, *order).sortWithinPartitions(coarse, *order).withColumn("__at", F.monotonically_increasing_id())
    sorted_.write.option("compression", "zstd").parquet(path)  # the numbers below must be those of one run
    rows = spark.read.schema(sorted_.schema).parquet(path)
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    base = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))  # a row for each range
    return rows.join(F.broadcast(base), part == F.col("__part")).withColumn(name, F.col("__base") + place).drop("__at", "__part", "__base")


def write_shards(df: DataFrame, path: str, order: str, rows: int, low: int, high: int) -> None:
    """Ordered parts of at most ``rows`` rows: row ranges of ``order`` (dense) become files."""
    parts = max(1, -(-(high - low) // rows))
    shard = F.floor((F.col(order) - low) / rows).cast("int")
    df.withColumn("shard", shard).repartitionByRange(parts, "shard").sortWithinPartitions("shard", order).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def checksums(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """``file, bytes, sha256`` of every Parquet file of that name below ``path`` (not in ``_`` folders)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256, rows`` of every Parquet file below ``path``."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = spark.read.option("recursiveFileLookup", True).parquet(path).groupBy(name.alias("file")).agg(F.count("*").alias("rows"))
    return checksums(spark, path).join(rows, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("bigint")))


def changed_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """``file, state`` of files that are missing, new or altered against an earlier ``inventory``."""
    now = inventory(spark, path).select("file", F.struct("bytes", "sha256", "rows").alias("now"))
    then = manifest.select("file", F.struct("bytes", "sha256", "rows").alias("then"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "altered")
    return now.join(then, "file", "full").select("file", state.alias("state")).filter("state IS NOT NULL")


def write_lines(rows: DataFrame, path: str, *by: str) -> DataFrame:
    """Writes the column ``line`` as text files, in a folder for each value of ``by``; returns ``by, files, lines, bytes``.

    No rows raise. Lines are whole rows: a line break inside one would be read back as two, and raises.
    """
    broken = rows.agg(F.count("*").alias("n"), F.count_if(F.col("line").rlike("[\\r\\n]") | F.col("line").isNull()).alias("bad")).first()
    if not broken["n"] or broken["bad"]:
        raise ValueError(f"{broken['bad']} of {broken['n']} rows are no lines")
    rows.select("line", *by).write.partitionBy(*by).text(path)
    back = rows.sparkSession.read.text(path).withColumn("__file", F.input_file_name())
    return back.groupBy(*by).agg(F.countDistinct("__file").alias("files"), F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"))


def write_lookup(lookup: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Writes a fitted lookup in the order of its keys, as zstd Parquet; returns the inventory.

    Repeated keys raise before anything is written: a join with them would repeat rows.
    """
    repeated = lookup.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"the lookup repeats values of {keys}")
    lookup.orderBy(*keys).write.option("compression", "zstd").parquet(path)
    return inventory(lookup.sparkSession, path)


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON, a line for each row; nulls are written, so that every line has all names."""
    report.write.option("ignoreNullFields", False).json(path)


#: Modulus and base of ``ordered_identity``; digits of a row's position.
PRIME, BASE, DIGITS = (1 << 61) - 1, 1_000_003, 64


def powers() -> list[list[int]]:
    """``BASE ** (d * DIGITS ** k)`` modulo ``PRIME`` for each digit d of a position, k from 0 to 6."""
    return [[pow(BASE, d * DIGITS**k, PRIME) for d in range(DIGITS)] for k in range(7)]


def ordered_identity(df: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """``rows, identity``: the rows' hashes times the base's power at their place, summed modulo ``PRIME``.

    Sums of stretches add up, so no task sees all rows; unlike a sum or XOR of hashes, the identity
    changes if two rows change places or one comes twice. ``index`` numbers the rows from 0.
    """
    wide = lambda x: x.cast("decimal(19,0)")
    mod = lambda x: F.pmod(x, F.lit(PRIME).cast("decimal(19,0)")).cast("bigint")
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])
    value = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    rest = F.col(index)
    for digits in powers():
        digit = F.pmod(rest, F.lit(DIGITS))
        value = mod(wide(value) * wide(F.element_at(F.lit(digits), (digit + 1).cast("int"))))
        rest = F.shiftright(rest, DIGITS.bit_length() - 1)
    return df.select(value.alias("v")).agg(F.count("*").alias("rows"), mod(F.coalesce(F.sum(F.col("v").cast("decimal(38,0)")), F.lit(0))).alias("identity"))


#: The columns of a raw log beside id, click and hour.
RAW_STRINGS = "C1 banner_pos site_id site_domain site_category app_id app_domain app_category device_id device_ip device_model device_type device_conn_type C14 C15 C16 C17 C18 C19 C20 C21".split()


def raw_columns(log: DataFrame) -> DataFrame:
    """The log with the raw columns that the impression view itself does not need."""
    number = lambda c: F.regexp_extract(F.col(c), "[0-9]+$", 0).cast("int")
    return log.withColumns(
        {
            "C1": F.concat(F.lit("c1_"), number("C20") % 3),
            "device_type": F.when(F.col("device_id") == "D_UNKNOWN", "1").otherwise("0"),
            "C15": F.when(F.col("site_id") == "S_APP", "c15_320").otherwise("c15_300"),
            "C16": F.when(number("C21") == 0, "c16_250").otherwise("c16_50"),
            "C18": F.concat(F.lit("c18_"), number("C17") % 4),
            "C19": F.when(number("C14") % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("c19_"), number("C14") % 9)),
        }
    )


def column_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, distinct, nulls, top, top_rows`` of each column, from one pass: values are counted as (column, value) pairs.

    Null counts as a value; of equally frequent values the first in order is the top one.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.explode(pairs).alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    nulls = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value").isNull().alias("none"), "value"))
    return counts.groupBy("column").agg(F.count("*").alias("distinct"), nulls.alias("nulls"), best.alias("b")).select("column", "distinct", "nulls", F.col("b.value").alias("top"), (-F.col("b.n")).alias("top_rows"))

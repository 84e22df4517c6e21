"""The history operators over event streams.

Micro-batches come from ``maxFilesPerTrigger`` and ``availableNow``; results go to Parquet in
the shared folder. State is per key, held by buckets of keys. Rows of a key that reach the processor
in one batch are put in order there, so batches must follow each other in time: ``ordered_stream`` sees to that
and bounds a batch, and a row older than its key's state raises. Streams that do come out of order
are for ``timed.timed_history``. Rows later than the watermark go to a side table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.impressions import shared_folder

#: Rows of a slice of whole hours, about; an hour with more is a slice of its own.
SLICE_ROWS, LEAST_SLICES = 2_000_000, 3
#: Buckets of keys; each is called once a batch.
KEY_BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``events``, a file or a folder of files, as a stream with a UTC event time.

    Files come in no order of time, so all that are there make one batch.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern: a path without one must be a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def ordered_stream(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    """``event_stream`` for state per key: at least ``LEAST_SLICES`` batches, of about ``SLICE_ROWS`` rows, and a key's rows come in order.

    One job writes the log by slices of whole hours, with a key's rows of a slice in one file; files
    then get the slices' order as their times, which is the order they are read in. How files are
    dealt to batches does not matter.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    counts = [(r["h"], r["count"]) for r in events.groupBy(hour.alias("h")).count().orderBy(F.asc_nulls_first("h")).collect()]  # one row an hour
    if counts and counts[0][0] is None:
        raise ValueError("events without a time have no place in the order")
    most = min(SLICE_ROWS, -(-sum(n for _, n in counts) // LEAST_SLICES))
    number, rows, sliced = -1, most, []
    for h, n in counts:
        number, rows = (number, rows + n) if rows + n <= most and number >= 0 else (number + 1, n)
        sliced.append((h, number))
    folder, files = f"{shared_folder(spark)}/slices", int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = F.broadcast(spark.createDataFrame(sliced, "h long, slice int"))
    events.join(slices, hour == F.col("h")).drop("h").repartition(files, key).sortWithinPartitions("slice").write.partitionBy("slice").parquet(folder)
    _order_files(spark, folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(folder)


def _order_files(spark: SparkSession, folder: str) -> None:
    """Sets the files' times in the order of their slices, a second apart."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in store.listStatus(top) if s.getPath().getName().startswith("slice=")]
    for path in names:
        at = 1_000_000_000_000 + 1000 * int(path.getName().removeprefix("slice="))
        for file in store.listStatus(path):
            store.setTimes(file.getPath(), at, -1)


def run(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there now and returns what it wrote."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    query = df.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def hourly_clicks(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows and clicks of each key and hour, once the hour is over."""
    hour = F.window("ts", "1 hour")
    sums = events.withWatermark("ts", "0 seconds").groupBy(key, hour).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return sums.select(key, F.floor(F.unix_timestamp("window.start") / 3600).alias("hour_no"), "n", "clicks")


def refuse(hour: int, last: int | None) -> None:
    """Raises for a row of an hour before that of the state: its history would be wrong, and that of later rows."""
    if last is not None and hour < last:
        raise ValueError(f"a row of hour {hour} comes after one of hour {last}: order the stream, or use timed_history")


class _Buckets(StatefulProcessor):
    """State of all keys of a bucket, ``width`` numbers a key, read and written once a batch.

    A call for each key and batch would be keys times batches, both of which grow with the log.
    """

    reads: tuple[str, ...]
    writes: tuple[str, ...]
    width: int

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("past", "names array<string>, numbers array<bigint>")

    def advance(self, s: list[int], rows: Iterator[tuple], out: list[tuple]) -> tuple:
        """Goes through a key's new rows, (name, *reads), in order; returns its new state."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["name", "hour_no", "event_id"])
        names, numbers = self.state.get() if self.state.exists() else ((), ())
        past = {name: numbers[i * self.width : (i + 1) * self.width] for i, name in enumerate(names)}
        out: list[tuple] = []
        for name, own in groupby(zip(*(new[c].tolist() for c in ("name", *self.reads)), strict=True), itemgetter(0)):
            past[name] = self.advance(past.get(name, [0] * self.width), own, out)
        self.state.update((list(past), [int(x) for s in past.values() for x in s]))
        yield pd.DataFrame(out, columns=list(self.writes))

    def close(self) -> None:
        pass


class Impressions(_Buckets):
    """Earlier rows, hours since the last, earlier rows in the hour."""

    reads, width = ("event_id", "hour_no"), 3
    writes = ("event_id", "prior_impressions", "hours_since_previous", "prior_in_hour")

    def advance(self, s, rows, out):
        total, last, inside = s
        for _, event, hour in rows:
            refuse(hour, last if total else None)
            inside = inside if total and last == hour else 0
            out.append((event, total, hour - last if total else 0, inside))
            total, last, inside = total + 1, hour, inside + 1
        return total, last, inside


class Clicks(_Buckets):
    """Completed-hour click history; an hour's labels wait until a row of a later hour comes."""

    reads, width = ("event_id", "hour_no", "click", "scoring"), 10
    writes = ("event_id", "prior_clicks", "prior_nonclicks", "hours_since_click", "impressions_since_click", "click_pattern")

    def __init__(self, bits: int = 4):
        self.bits = bits

    def advance(self, s, rows, out):
        names = "n pos clicked since pattern length labelled hour hour_n hour_pos".split()
        s, mask = dict(zip(names, s, strict=True)), (1 << self.bits) - 1
        for _, event, hour, click, scoring in rows:
            refuse(hour, s["hour"] if s["hour_n"] or s["n"] else None)
            if s["hour_n"] and s["hour"] < hour:  # the waiting hour is complete
                hit, gap = s["hour_pos"] > 0, s["hour"] - s["labelled"] if s["n"] else 1
                s["pattern"] = ((s["pattern"] << min(gap, self.bits)) | hit) & mask
                s["length"] = min(s["length"] + gap, self.bits)
                s["n"], s["pos"] = s["n"] + s["hour_n"], s["pos"] + s["hour_pos"]
                s["since"] = 0 if hit else s["since"] + s["hour_n"]
                s["clicked"] = s["hour"] if hit else s["clicked"]
                s["labelled"], s["hour_n"], s["hour_pos"] = s["hour"], 0, 0
            out.append((event, s["pos"], s["n"] - s["pos"], hour - s["clicked"] if s["pos"] else 0, s["since"], (s["length"] << self.bits) | s["pattern"]))
            if not scoring:  # scoring rows read the state and leave it alone
                s["hour"], s["hour_n"], s["hour_pos"] = hour, s["hour_n"] + 1, s["hour_pos"] + click
        return tuple(s[x] for x in names)


def _bucketed(events: DataFrame, key: str, *columns):
    """The columns by bucket of the key; a key that is null is one as any other."""
    name = F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n"))
    return events.select(F.pmod(F.xxhash64(name), F.lit(KEY_BUCKETS)).alias("bucket"), name.alias("name"), *columns).groupBy("bucket")


def prior_impressions(events: DataFrame, key: str = "user_id") -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = _bucketed(events, key, "event_id", F.floor(F.unix_timestamp("ts") / 3600).alias("hour_no"))
    return rows.transformWithStateInPandas(Impressions(), "event_id long, prior_impressions long, hours_since_previous long, prior_in_hour long", "append", "none")


def click_history(events: DataFrame, scoring_from: int, key: str = "user_id", bits: int = 4) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = _bucketed(events, key, "event_id", hour.alias("hour_no"), (F.col("event_type") == "click").cast("long").alias("click"), (hour >= scoring_from).alias("scoring"))
    schema = "event_id long, prior_clicks long, prior_nonclicks long, hours_since_click long, impressions_since_click long, click_pattern long"
    return rows.transformWithStateInPandas(Clicks(bits), schema, "append", "none")


def route_late(stream: DataFrame, allowed_hours: int, arrivals: Sequence[Callable[[], None]] = ()) -> tuple[DataFrame, DataFrame]:
    """Runs the stream; rows more than ``allowed_hours`` behind what earlier batches held go aside.

    Each of ``arrivals`` adds files, however many, after those before have been processed. Returns (on time, late). ``hour_no`` is the event time.
    """
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    highest: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        edge = max(highest) - allowed_hours if highest else None
        late = F.lit(False) if edge is None else F.col("hour_no") < edge
        batch.withColumn("late", late).withColumn("batch", F.lit(number)).write.mode("append").partitionBy("late").parquet(f"{folder}/out")
        top = batch.agg(F.max("hour_no").alias("h")).first()["h"]
        highest.extend([top] if top is not None else [])
        batch.unpersist()

    for arrive in arrivals or [lambda: None]:
        arrive()
        stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").withColumn("late", F.col("late").cast("boolean"))
    return rows.filter("NOT late"), rows.filter("late")


def enrich(stream: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """Left joins of the stream with frozen lookups; unknown keys give null."""
    for key, table in lookups.items():
        stream = stream.join(table, key, "left")
    return stream

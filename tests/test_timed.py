import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import history as Y
from tidemark.streaming import timed as T

SCHEMA = "user_id string, event_id long, ts timestamp, event_type string"


def log(spark, n=400, seed=4):
    g = np.random.default_rng(seed)
    minutes = np.sort(g.integers(0, 60 * 60, n))
    rows = [(["hot", "a", "b", None][min(3, int(g.exponential(0.7)))], i, int(m), "click" if g.random() < 0.3 else "view") for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "user_id string, event_id long, m int, event_type string")
    return df.select("user_id", "event_id", (F.timestamp_seconds(F.lit(1_700_000_000 // 3600 * 3600) + F.col("m") * 60)).alias("ts"), "event_type").persist()


def run(spark, folder, parts, allowed, scoring_from):
    stream = lambda: T.timed_history(spark.readStream.schema(SCHEMA).parquet(folder), allowed, scoring_from)
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    out = T.run_arrivals(stream, [lambda p=p: p.write.mode("append").parquet(folder) for p in parts])
    return {r["event_id"]: tuple(r)[1:] for r in out.collect()}


def batch(df, scoring_from):
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = df.select("user_id", F.col("event_id").alias("row_index"), hour.alias("hour_no"), (F.col("event_type") == "click").cast("int").alias("click"), (hour >= scoring_from).alias("scoring"))
    seen = Y.impression_history(rows, "user_id")
    state = Y.click_state(rows, "user_id").withColumnsRenamed({"user_id": "k", "hour_no": "h"})
    both = seen.join(state, F.col("user_id").eqNullSafe(F.col("k")) & (F.col("hour_no") == F.col("h")))
    names = T._COLUMNS[2:]
    return {r["row_index"]: (r["hour_no"], (False, *[r[c] for c in names])) for r in both.collect()}


def hours_of(df):
    return {r["event_id"]: r["h"] for r in df.select("event_id", F.floor(F.unix_timestamp("ts") / 3600).alias("h")).collect()}


def test_three_batches_out_of_order_with_restarts_equal_batch(spark, tmp_path):
    """Rows up to five hours late are waited for: nothing is late, and hours that are closed equal the batch."""
    df = log(spark)
    top = df.agg(F.max("ts")).first()[0]
    shift = F.col("event_id") % 7 == 0  # some rows come one part later
    part = F.floor(F.col("event_id") / 134) + shift.cast("int")
    parts = [df.filter(part == k).repartition(3) for k in range(4)]
    first = min(hours_of(df).values()) + 40
    got = run(spark, str(tmp_path / "in"), parts, 30, first)
    closed = int((top.timestamp() - 30 * 3600) // 3600)
    want = {k: v for k, (h, v) in batch(df, first).items() if h < closed}
    assert len(want) > 100 and got == want


def test_late_rows_are_marked_and_change_nothing(spark, tmp_path):
    df = log(spark)
    hours = hours_of(df)
    late = df.filter("event_id % 10 = 3 AND event_id < 200")
    rest = df.join(late.select("event_id"), "event_id", "left_anti").select(*df.columns)
    first = min(hours.values()) + 40
    got = run(spark, str(tmp_path / "in"), [rest, late], 2, first)
    top = rest.agg(F.max("ts")).first()[0]
    closed = int((top.timestamp() - 2 * 3600) // 3600)
    want = {k: v for k, (h, v) in batch(rest, first).items() if h < closed}
    marked = {r["event_id"]: (True, *[None] * 8) for r in late.collect() if hours[r["event_id"]] < closed}
    assert len(marked) == late.count() and got == want | marked


class Waiting:
    """A key's state in memory; counts what is read of the waiting rows."""

    def __init__(self):
        self.rows, self.past, self.timers, self.read = [], None, set(), 0

    def getValueState(self, *_):
        return type("V", (), {"exists": lambda _: self.past is not None, "get": lambda _: self.past, "update": lambda _, v: setattr(self, "past", v)})()

    def getListState(self, *_):
        def get(_):
            self.read += len(self.rows)
            return iter(list(self.rows))

        return type("L", (), {"get": get, "appendList": lambda _, r: self.rows.extend(r), "put": lambda _, r: setattr(self, "rows", list(r)), "clear": lambda _: setattr(self, "rows", [])})()

    def registerTimer(self, at):
        self.timers.add(at)


def test_waiting_rows_are_read_once_for_each_advance():
    """A key with a row in each of 500 hours: half of them closed at one advance, the others at the next."""
    import pandas as pd

    at = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda _: ms, "getExpiryTimeInMs": lambda _: ms})()
    state, op, out = Waiting(), T.TimedHistory(), []
    op.init(state)
    rows = pd.DataFrame({"hour_no": range(1000, 1500), "event_id": range(500), "click": [i % 3 == 0 for i in range(500)], "scoring": False})
    list(op.handleInputRows(("k",), iter([rows[250:], rows[:250]]), at(0)))
    for mark in (1250 * T.HOUR, 1500 * T.HOUR):
        while min(state.timers, default=mark + 1) <= mark:
            timer = min(state.timers)
            state.timers.remove(timer)
            out += [x for f in op.handleExpiredTimer(("k",), at(mark), at(timer)) for x in f["event_id"].tolist()]
    assert out == list(range(500)) and not state.rows
    assert state.read < 2000  # 125,000 with a timer for each hour


def test_the_state_store_setting_is_put_back(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    run(spark, str(tmp_path / "in"), [log(spark, 40)], 1, 10**9)
    assert spark.conf.get(name) == before


def test_a_row_older_than_the_state_raises(spark, tmp_path):
    import pytest

    from tidemark.streaming import history as H

    df = log(spark, 60).filter("user_id = 'hot'")
    for k, make in enumerate((H.prior_impressions, lambda s: H.click_history(s, 10**9))):
        folder = str(tmp_path / f"in{k}")
        df.filter("event_id >= 30").coalesce(1).write.parquet(folder)  # the earlier file has the later hours
        df.filter("event_id < 30").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        with pytest.raises(Exception, match="comes after one of hour"):
            H.run(make(stream))


def test_slices_are_read_in_order_whatever_their_number(spark, monkeypatch):
    from tidemark.queries import spark as Q
    from tidemark.streaming import history as H

    small = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, Q.stream_click_history(spark, small).collect()))
    monkeypatch.setattr(H, "LEAST_SLICES", 1)
    one = rows()
    monkeypatch.setattr(H, "LEAST_SLICES", 7)
    assert rows() == one and len(one) > 0


def test_a_batch_calls_buckets_not_keys(spark, tmp_path):
    """Many keys share a call and its state; keys that are null are one more key; batches follow each other."""
    import json

    from tidemark.streaming import history as H

    rows = [(i, None if u == 0 else u, 3600 * h, "click" if i % 5 == 0 else "view") for i, (h, u) in enumerate((h, u) for h in range(4) for u in range(40))]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    calls, before = [], H.KEY_BUCKETS
    H.KEY_BUCKETS = 3
    try:
        for part in (0, 1):
            df.filter((F.col("event_id") >= 80) == bool(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            out = H.prior_impressions(stream)
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            calls += [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) for p in q.recentProgress) if p["stateOperators"]]
    finally:
        H.KEY_BUCKETS = before
    got = {r["event_id"]: tuple(r)[1:] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: (i // 40, int(i >= 40), 0) for i in range(160)}
    assert 0 < max(calls) <= 3
